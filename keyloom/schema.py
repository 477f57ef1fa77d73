"""Schemas and limits of the keyspace model.

A keyspace is a relation of binary keys, binary values and absolute expiry times in Unix
milliseconds, 0 for never.  Its state is the fold of an ordered mutation log.
"""

KS = "key binary, value binary, expire_at bigint"
LOG = "lsn bigint, pos int, op string, key binary, value binary, expire_at bigint"
CMDS = "conn bigint, seq bigint, now_ms bigint, args array<binary>"
REPLIES = "conn bigint, seq bigint, kind string, i bigint, s binary, err string, elems array<struct<kind:string,i:bigint,s:binary>>"

INT64_MAX, INT64_MIN = (1 << 63) - 1, -(1 << 63)
MAX_VALUE_BYTES = 512 << 20
MAX_KEYS_REPLY = 1_000_000
SCAN_COUNT, SCAN_COUNT_MAX = 10, 100_000
RECORD_OVERHEAD = 64
