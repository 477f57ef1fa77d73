"""Continuous ingestion: commands folded into keyed state, and log batches into runs.

State is kept by key with no processing-time expiry: a record's own expire_at is compared
with the clock that a command carries.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.lsm import Store
from ..plans.log import newest
from ..plans.machine import Machine

OUTPUT = "key binary, conn bigint, seq bigint, kind string, i bigint, s binary, err string"


class KeyFold(StatefulProcessor):
    """Runs a key's commands of each batch in order over its record."""

    def init(self, handle) -> None:
        self.record = handle.getValueState("record", "value binary, expire_at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        k, out = bytes(key[0]), []
        held = self.record.get()
        machine = Machine({k: (bytes(held[0]), int(held[1]))} if held is not None else {})
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for row in batch.itertuples(index=False):
            kind, i, s, err, _ = machine.run([bytes(a) for a in row.args], int(row.now_ms))
            out.append((k, row.conn, row.seq, kind, i, s, err))
        if k in machine.records:
            self.record.update(machine.records[k])
        elif held is not None:
            self.record.clear()
        frame = pd.DataFrame(out, columns=["key", "conn", "seq", "kind", "i", "s", "err"])
        frame["i"] = frame["i"].astype("Int64")
        yield frame

    def close(self) -> None:
        pass


def fold_stream(cmds: DataFrame, mode: str = "Update") -> DataFrame:
    """Replies of a stream of single-key commands (conn, seq, now_ms, args); files take them in mode Append."""
    keyed = cmds.withColumn("key", F.get("args", F.lit(1)))
    return keyed.groupBy("key").transformWithStateInPandas(
        statefulProcessor=KeyFold(), outputStructType=OUTPUT, outputMode=mode, timeMode="None"
    )


def ingest(log: DataFrame, store: Store, checkpoint: str, compact_at: int | None = None):
    """Write every micro-batch of a log stream as a sorted run, then compact what is due.

    A batch that runs again after a failure is recognised by its number, which the
    manifest keeps.  Batches count in the order of their arrival, so records that come
    late are written too, and within a batch by lsn.
    """

    def batch(rows: DataFrame, number: int) -> None:
        last = rows.agg(F.max("lsn")).first()[0]
        if last is None or number <= store.manifest().last_batch:
            return
        if rows.where("op = 'flushall'").limit(1).count():
            store.flush_all(store.manifest().last_lsn)
        folded = newest(rows).select(
            "key",
            (F.col("op") == "delete").alias("is_delete"),
            "value",
            F.coalesce("expire_at", F.lit(0)).alias("expire_at"),
        )
        store.flush(folded, last, number)
        if compact_at is not None:
            while store.compact_once(compact_at):
                pass

    return log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
