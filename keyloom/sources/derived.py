"""Keyspaces, logs and runs derived from the test tables, as SQL for either engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOW = 1706659200000

_SQL = {
    "kv_log": """
        SELECT event_id + 1 AS lsn, 0 AS pos, CASE event_type WHEN 'error' THEN 'delete' ELSE 'put' END AS op,
               concat('user:', user_id) AS key,
               CASE event_type WHEN 'error' THEN NULL ELSE concat(event_type, ':', props) END AS value,
               CASE event_type WHEN 'view' THEN {ms} + 3600000 WHEN 'click' THEN {ms} + 2592000000 ELSE 0 END AS expire_at
        FROM events""",
    "kv_orders": """
        SELECT concat('order:', o_orderstatus, ':', o_orderkey) AS key, o_orderpriority AS value,
               CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1706659200000 + (o_orderkey % 7 - 3) * 86400000 END AS expire_at
        FROM orders""",
    "kv_docs": """
        SELECT concat('doc:', lang, ':', doc_id) AS key, text AS value, CAST(0 AS BIGINT) AS expire_at FROM documents""",
    "kv_numeric": """
        SELECT concat('part:', p_partkey) AS key,
               CASE p_size % 5 WHEN 0 THEN concat('00', p_size) WHEN 1 THEN concat('-', p_size)
                               WHEN 2 THEN concat('+', p_size) WHEN 3 THEN p_name ELSE CAST(p_size AS STRING) END AS value,
               CAST(0 AS BIGINT) AS expire_at
        FROM part""",
    "kv_counters": """
        SELECT concat('part:', p_partkey) AS key, CASE WHEN p_size % 5 = 3 THEN p_name ELSE CAST(p_size AS STRING) END AS value,
               CAST(CASE WHEN p_size % 4 = 0 THEN 1806659200000 ELSE 0 END AS BIGINT) AS expire_at
        FROM part""",
    "lsm_runs": """
        SELECT rk, lpad(CAST(o_orderkey AS STRING), 8, '0') AS key, (rk = 1 AND o_orderkey % 5 = 0) AS is_delete,
               concat('r', rk, ':', o_orderstatus) AS value
        FROM orders CROSS JOIN (VALUES (0), (1), (2), (3)) t(rk) WHERE o_orderkey % (rk + 2) = 0""",
    "samples": """
        SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS v FROM lineitem""",
    "cmd_log": """
        SELECT user_id % 8 AS conn, event_id AS seq, {ms} AS now_ms,
               CASE event_type WHEN 'click' THEN 'incr' WHEN 'view' THEN 'get' WHEN 'purchase' THEN 'append'
                               WHEN 'signup' THEN 'set' ELSE 'del' END AS name,
               concat('user:', user_id) AS key,
               CASE event_type WHEN 'purchase' THEN '1' WHEN 'signup' THEN '100' END AS arg
        FROM events""",
}
_TABLES = {"kv_log": "events", "kv_orders": "orders", "kv_docs": "documents", "kv_numeric": "part", "kv_counters": "part", "lsm_runs": "orders", "samples": "lineitem", "cmd_log": "events"}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{_TABLES[name]}.parquet")
    sql = _SQL[name].format(ms="unix_millis(CAST(ts AS TIMESTAMP))").replace(f"FROM {_TABLES[name]}", "FROM {src}")
    return spark.sql(sql, src=table)


def duck(*names: str) -> str:
    """WITH clause of the derivations for DuckDB."""
    parts = [f"{n} AS ({_SQL[n].format(ms='(epoch_us(ts) // 1000)')})" for n in names]
    return "WITH " + ", ".join(parts) + " "
