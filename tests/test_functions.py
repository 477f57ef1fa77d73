import re

import pytest
from pyspark.sql import functions as F

from keyloom.functions import exprs
from keyloom.functions.glob import is_trivial, matches, to_regex
from keyloom.functions.text import argument_int, format_double, format_float, parse_float, strict_int
from keyloom.operators import stats

GLOBS = [
    ("*", "", True), ("*", "abc", True), ("", "", True), ("", "a", False), ("h?llo", "hello", True), ("h?llo", "hllo", False),
    ("h*llo", "heeello", True), ("h[ae]llo", "hello", True), ("h[ae]llo", "hillo", False), ("h[^e]llo", "hallo", True),
    ("h[^e]llo", "hello", False), ("h[a-b]llo", "hallo", True), ("h[c-a]llo", "hbllo", True), (r"\*", "*", True), (r"\*", "a", False),
    ("\\", "\\", True), ("[abc", "b", True), ("[abc", "d", False), ("[", "a", False), ("[^", "a", True), ("a**b", "axxb", True),
]


@pytest.mark.parametrize("pattern, subject, want", GLOBS)
def test_glob(pattern, subject, want):
    rx = to_regex(pattern.encode()).replace(r"\z", r"\Z")
    assert bool(re.match(rx, subject)) == want


def test_glob_in_spark(spark):
    rows = spark.createDataFrame([(p, s, w) for p, s, w in GLOBS], "p string, s string, w boolean").collect()
    for r in rows:
        got = spark.createDataFrame([(r.s.encode(),)], "k binary").select(matches("k", r.p.encode()).alias("m")).first().m
        assert got == r.w, r
    assert is_trivial(b"**") and not is_trivial(b"")


def test_integers():
    good = {b"0": 0, b"-1": -1, b"+7": 7, b"+007": 7, b"-0": 0, b"9223372036854775807": (1 << 63) - 1}
    assert {k: strict_int(k) for k in good} == good
    assert [strict_int(x) for x in (b"9223372036854775808", b"", b"-", b"1a", b" 1", b"007")] == [None] * 6
    assert argument_int(b"007") == 7 and argument_int(b" 7") is None


def test_floats():
    assert format_float(10.6) == "10.6" and format_float(1e23) == "100000000000000000000000" and format_float(-0.0) == "0"
    assert format_float(10.0) == "10" and format_double(1e17) == "1e+17" and format_double(3.0) == "3"
    assert parse_float(b"nope") is None and parse_float(b"inf") is None and parse_float(b"1e3") == 1000.0


def test_ranges(spark):
    v = spark.createDataFrame([(b"This is a string",)], "v binary")
    cases = {(0, 3): b"This", (-3, -1): b"ing", (0, -1): b"This is a string", (10, 100): b"string", (-1, -3): b"", (100, 200): b"", (-100, -90): b"T", (5, 5): b"i", (0, 0): b"T"}
    for (a, b), want in cases.items():
        assert bytes(v.select(exprs.get_range("v", a, b).alias("r")).first().r) == want
    assert bytes(v.select(exprs.set_range(F.lit(None).cast("binary"), 5, b"world").alias("r")).first().r) == b"\0" * 5 + b"world"


def test_saturating_sum_and_ttl(spark):
    row = spark.range(1).select(
        exprs.sat_add(F.lit((1 << 63) - 2), F.lit(5)).alias("a"), exprs.ttl(F.lit(1000), 1000, F.lit(2001)).alias("t"), exprs.ttl(F.lit(1), 1, F.lit(0)).alias("n")
    ).first()
    assert (row.a, row.t, row.n) == ((1 << 63) - 1, 2, -1)


def test_histogram_matches_plain_sum(spark):
    values = [0, 1, 255, 256, 257, 1000, 5000, 123456, 1 << 40, (1 << 55) - 1, (1 << 53) + 1, (1 << 63) - 1]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")

    def bucket(v):
        if v < 256:
            return v
        m = v.bit_length() - 1
        return 256 + (m - 8) * 128 + ((v >> (m - 7)) & 127)

    got = {r.v: r.b for r in df.select("v", exprs.histogram_bucket("v").alias("b")).collect()}
    assert got == {v: bucket(v) for v in values}
    assert {r.bucket for r in stats.histogram(df).collect()} == {bucket(v) for v in values}
    index = spark.createDataFrame([(i,) for i in {bucket(v) for v in values}], "i bigint")
    floors = {r.i: r.f for r in index.select("i", exprs.bucket_floor("i").alias("f")).collect()}
    assert all(floors[bucket(v)] <= v and bucket(floors[bucket(v)]) == bucket(v) for v in values)
    assert stats.summary(df).first().n == len(values)
