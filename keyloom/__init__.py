"""Keyspace analytics on PySpark: versioned key-value data as DataFrames."""
