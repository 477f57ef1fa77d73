"""Counters, keyspace facts and the log-linear latency histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs

REPORTED = (("p50", 0.5), ("p95", 0.95), ("p99", 0.99), ("p999", 0.999))


def keyspace(ks: DataFrame, now: int) -> DataFrame:
    """keys, expires, bytes, expired over a keyspace."""
    alive = exprs.is_live(F.lit(now))
    return ks.agg(
        F.count_if(alive).alias("keys"),
        F.count_if(alive & (F.col("expire_at") != 0)).alias("expires"),
        F.sum(F.when(alive, exprs.memory_usage())).cast("bigint").alias("bytes"),
        F.count_if(~alive).alias("expired"),
    )


def histogram(samples: DataFrame, value: str = "v") -> DataFrame:
    """bucket, n: counts of the log-linear buckets; merging histograms is adding their counts."""
    return samples.select(exprs.histogram_bucket(F.col(value)).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("bucket").agg(F.sum("n").cast("bigint").alias("n"))


def quantiles(hist: DataFrame, qs: list[float]) -> DataFrame:
    """q, value: smallest value of the first bucket that reaches ceil(q * total).

    The histogram is a few thousand rows whatever the samples, so one task may sum it.
    """
    running = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    total = hist.agg(F.sum("n").alias("total"))
    rows = hist.withColumn("upto", F.sum("n").over(running)).join(F.broadcast(total))
    asked = hist.sparkSession.createDataFrame([(q,) for q in qs], "q double")
    met = rows.join(F.broadcast(asked), F.col("upto") >= F.ceil(F.col("q") * F.col("total")))
    return met.groupBy("q").agg(F.min("bucket").alias("b")).select("q", exprs.bucket_floor("b").alias("value"))


def summary(samples: DataFrame, value: str = "v", qs=(0.5, 0.95, 0.99, 0.999)) -> DataFrame:
    """n, min, mean, max and the quantiles of samples, in one row."""
    facts = samples.agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max")
    )
    wide = quantiles(histogram(samples, value), list(qs)).groupBy().pivot("q", list(qs)).agg(F.first("value"))
    return facts.join(wide)


def report(samples: DataFrame, by: str, seconds: float, value: str = "v") -> DataFrame:
    """A row for each ``by``: n, per_sec, min, mean, max and the histogram's p50, p95, p99 and p999."""
    hist = samples.select(by, exprs.histogram_bucket(F.col(value)).alias("bucket")).groupBy(by, "bucket").agg(F.count(F.lit(1)).alias("n"))
    # a few thousand buckets each, so a task may hold those of one
    upto = F.sum("n").over(Window.partitionBy(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy(by))
    seen = hist.withColumn("upto", upto).withColumn("total", total)
    wide = seen.groupBy(by).agg(
        *(F.min(F.when(F.col("upto") >= F.ceil(F.lit(q) * F.col("total")), F.col("bucket"))).alias(name) for name, q in REPORTED)
    )
    facts = samples.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max")
    )
    rate = (F.col("n") / F.lit(float(seconds))).alias("per_sec")
    return facts.join(wide, by).select(by, "n", rate, "min", "mean", "max", *(exprs.bucket_floor(name).alias(name) for name, _ in REPORTED))


def markdown(table: DataFrame) -> str:
    """A small report as a Markdown table."""
    rows = [table.columns, ["---"] * len(table.columns), *([f"{v:.2f}" if isinstance(v, float) else str(v) for v in r] for r in table.collect())]
    return "".join("| " + " | ".join(r) + " |\n" for r in rows)


def commands(cmds: DataFrame) -> DataFrame:
    """name, calls, first_ms, last_ms."""
    return cmds.groupBy("name").agg(F.count(F.lit(1)).alias("calls"), F.min("now_ms").alias("first_ms"), F.max("now_ms").alias("last_ms"))


def hit_ratio(hits, misses):
    """h / (h + m), 0 where nothing was asked."""
    total = hits + misses
    return F.when(total == 0, F.lit(0.0)).otherwise(hits / total)


def clients(cmds: DataFrame) -> DataFrame:
    """conn, calls, last_name, age_ms, idle_from: what CLIENT LIST shows of each connection."""
    return cmds.groupBy("conn").agg(
        F.count(F.lit(1)).alias("calls"),
        F.max_by("name", "seq").alias("last_name"),
        (F.max("now_ms") - F.min("now_ms")).alias("age_ms"),
        F.max("now_ms").alias("idle_from"),
    )


def info(ks: DataFrame, cmds: DataFrame, now: int) -> DataFrame:
    """section, field, value: the parts of INFO that a relation can answer."""
    k = keyspace(ks, now).select(
        F.lit("keyspace").alias("section"),
        F.explode(F.create_map(F.lit("keys"), F.col("keys"), F.lit("expires"), F.col("expires"), F.lit("bytes"), F.col("bytes"))).alias("field", "value"),
    )
    c = commands(cmds).select(F.lit("commandstats").alias("section"), F.concat(F.lit("cmdstat_"), "name").alias("field"), F.col("calls").alias("value"))
    n = cmds.agg(F.countDistinct("conn").alias("n")).select(F.lit("clients").alias("section"), F.lit("connected_clients").alias("field"), F.col("n").alias("value"))
    t = cmds.agg(F.count(F.lit(1)).alias("n")).select(F.lit("stats").alias("section"), F.lit("total_commands_processed").alias("field"), F.col("n").alias("value"))
    return k.unionByName(c).unionByName(n).unionByName(t)


def metrics(ks: DataFrame, cmds: DataFrame, now: int) -> DataFrame:
    """metric, labels, value: the same facts as exporter rows."""
    return info(ks, cmds, now).select(
        F.concat(F.lit("keyloom_"), "section").alias("metric"), F.create_map(F.lit("field"), F.col("field")).alias("labels"), F.col("value").cast("double").alias("value")
    )
