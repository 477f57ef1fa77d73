import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from keyloom.llm import exact_dedup as exact
from keyloom.llm import jaccard_join as join
from keyloom.llm import suffix_dedup as suffix
from keyloom.llm.common import read_documents
from tests.conftest import SMALL

from . import brute

EDGE = "doc_id long, text string, _digest string, sid string, spans string, source string"


def edge(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in rows], EDGE)


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def near_copies():
    rng = random.Random(4)
    base, rows = [f"w{k}" for k in range(40)], []
    for i in range(220):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(40)] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(w)))
    for i in range(300, 420):
        w = [f"y{k}" for k in range(rng.randint(3, 14))]
        if rng.random() < 0.5:
            w[-1] = f"z{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    return rows + [(900, None), (901, ""), (902, "  "), (903, "A b"), (904, "a B"), (905, "a"), (906, "é " * 3000)]


def test_jaccard_join(spark):
    for df in (edge(spark, near_copies()), read_documents(spark, SMALL)):
        classes, links = join.jaccard_join(spark, df)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in classes.collect()}
        assert got == brute.jaccard_components(rows_of(df))
        assert links.where("a = b").isEmpty()


def test_jaccard_join_edges(spark):
    classes, links = join.jaccard_join(spark, edge(spark, []))
    assert classes.isEmpty() and links.isEmpty()
    twice = join.jaccard_join(spark, edge(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None)]))[0].collect()
    assert sorted((r.doc_id is None, r.component_id) for r in twice if r.n_shingles) == [(False, 1), (False, 1), (True, 1)]


def by_rows(rows):
    """What brute force says of rows whose doc_ids are null or repeated: sorted (doc_id, n, component)."""
    plain = brute.jaccard_components([(k, t) for k, (_, t) in enumerate(rows)])
    ids = {}
    for k, (_, c) in plain.items():
        ids.setdefault(c, []).append(rows[k][0])
    least = {c: min((i for i in some if i is not None), default=None) for c, some in ids.items()}
    return sorted(((rows[k][0], n, least[c]) for k, (n, c) in plain.items()), key=str)


def test_jaccard_join_null_and_repeated_ids(spark):
    a, o = [" ".join(f"{x}{k}" for k in range(40)) for x in "ao"]
    rows = [(1, a), (1, o), (2, a + " b"), (3, o + " p"), (None, o + " q"), (None, "z " + a), (None, "lone words of a text without id")]
    rows += [(None, " ".join(f"n{k}" for k in range(30))), (None, " ".join(f"n{k}" for k in range(31)))]
    got = join.jaccard_join(spark, edge(spark, rows))[0]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == by_rows(rows)


def test_jaccard_join_when_hashes_of_sets_clash(spark):
    rows = near_copies()
    for bits in (3, 7):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in join.jaccard_join(spark, edge(spark, rows), id_bits=bits)[0].collect()}
        assert got == brute.jaccard_components(rows)


def test_jaccard_join_families_in_blocks(spark, monkeypatch):
    """Varied copies of texts that are not there themselves, most pairs just short of a link."""
    for name, value in (("LONG", 8), ("FREQUENT", 6), ("BLOCK_SETS", 16)):
        monkeypatch.setattr(join, name, value)
    rng = random.Random(3)
    rows = []
    for i in range(240):
        w = [f"b{i % 3}_{k}" for k in range(120)]
        for k in rng.sample(range(120), rng.choice([2, 3, 3, 4])):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in join.jaccard_join(spark, edge(spark, rows))[0].collect()}
    assert got == brute.jaccard_components(rows)
    assert 6 < len({c for _, c in got.values()}) < 240


def test_overlaps_and_spanning_links():
    rng = np.random.default_rng(2)
    for most, count in ((40, 30), (4000, 30), (70, 200)):
        sets = [np.unique(rng.integers(0, most, rng.integers(1, 60))).astype(np.uint64) for _ in range(2 * count)]
        a, b = sets[:count], sets[count:]
        assert (join.overlaps(a, b) == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()
    linked = rng.random((40, 50)) < 0.02
    links = join.spanning(linked)
    assert all(linked[i, j] for i, j in links) and len(links) < 90
    root = brute.united([(("r", i), ("c", j)) for i, j in zip(*np.nonzero(linked))])
    assert root == brute.united([(("r", i), ("c", j)) for i, j in links])


def test_jaccard_join_long_lists(spark, monkeypatch):
    """Passages that many sets share, and copies of them that differ a little."""
    monkeypatch.setattr(join, "LONG", 4)
    monkeypatch.setattr(join, "FREQUENT", 3)
    rng = random.Random(8)
    passages = [[f"p{k}_{j}" for j in range(60)] for k in range(3)]
    rows = []
    for i in range(150):
        own = [f"d{i // 3}_{j}" for j in range(rng.choice([8, 14, 20, 60]))]
        w = rng.choice(passages) + own if rng.random() < 0.7 else own + rng.choice(passages) + rng.choice(passages)
        if rng.random() < 0.7:
            w = list(w)
            w[rng.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in join.jaccard_join(spark, edge(spark, rows))[0].collect()}
    assert got == brute.jaccard_components(rows)
    assert 3 < len({c for _, c in got.values()}) < 147


def test_components_of_long_chains(spark):
    """Chains and a hub whose ids are random, in rising and in falling order."""
    rng = random.Random(6)
    ids = list({rng.getrandbits(64) - 2**63 for _ in range(5000)})
    rng.shuffle(ids)
    chains = [ids[:2000], sorted(ids[2000:3200]), sorted(ids[3200:4400], reverse=True)]
    links = [(a, b) for c in chains for a, b in zip(c, c[1:])] + [(ids[4400], x) for x in ids[4401:]]
    frame = spark.createDataFrame([(min(x), max(x)) for x in links], "a long, b long")
    got = {r.v: r.root for r in join.components(spark, frame, join.shared_dir(spark), "t").collect()}
    assert got == {x: min(c) for c in (*chains, ids[4400:]) for x in c}


def test_boundary_follows_cost():
    assert join.boundary({4: 1000, 60: 1000}, 1000.0) >= 4
    assert join.boundary({60: 1000}, 0.0) < 60
    assert [join.prefix_size(n) for n in (3, 4, 100)] == [1, 2, 26]


def test_exact_dedup(spark):
    docs = read_documents(spark, SMALL)
    for df in (docs, edge(spark, [(1, "Ab"), (2, "aB"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 200_000), (8, "X" * 200_000)])):
        rows = [(i, (t or "").translate({65 + k: 97 + k for k in range(26)})) for i, t in rows_of(df)]
        groups = {}
        for i, t in rows:
            groups.setdefault(t, []).append(i)
        want = {i: (max(groups[t]), len(groups[t]), i == max(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows}
        assert {r.doc_id: tuple(r)[1:] for r in exact.exact_dedup(spark, df).collect()} == want


def test_exact_dedup_repeats_and_empty(spark):
    got = exact.exact_dedup(spark, edge(spark, [(3, ""), (3, ""), (None, None)])).collect()
    assert [r.keep_id for r in got] == [3, 3, 3] and sum(r.kept for r in got) == 1
    assert exact.exact_dedup(spark, edge(spark, [])).isEmpty()


def test_exact_dedup_of_some_files_of_a_folder(spark, tmp_path):
    for k in range(3):
        edge(spark, [(k, "same"), (k + 10, f"own {k}")]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")
    files = sorted(str(f) for f in (tmp_path / "docs").glob("*.parquet"))
    for some in (files[:1], files[:2], files):
        df = spark.read.parquet(*some)
        got = {r.doc_id: r.group_size for r in exact.exact_dedup(spark, df).collect()}
        assert got == {r.doc_id: len(some) if r.text == "same" else 1 for r in df.collect()}


def test_exact_dedup_keeps_its_state_between_arrivals(spark, tmp_path):
    arrivals = [[(5, "A b"), (2, "other"), (9, None)], [(7, "a B"), (1, "new")], [], [(3, "a b"), (8, "NEW"), (4, "")]]
    seen = []
    for rows in arrivals:
        seen += [(i, (t or "").lower()) for i, t in rows]
        groups = {}
        for i, t in seen:
            groups.setdefault(t, []).append(i)
        got = exact.exact_dedup(spark, edge(spark, rows), folder=f"file://{tmp_path}/store").collect()
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == sorted((i, max(groups[t]), len(groups[t]), i == max(groups[t])) for i, t in seen)


def test_exact_dedup_compares_bytes_with_earlier_arrivals(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact, "normalised", weak)
    for rows in ([(1, "ab"), (2, "x")], [(3, "ac")], [(4, "ab")]):
        got = exact.exact_dedup(spark, edge(spark, rows), folder=f"file://{tmp_path}/store").collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == {1: (4, 2), 2: (2, 1), 3: (3, 1), 4: (4, 2)}


def weak(docs):
    """A digest of the first character alone."""
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    return docs.withColumn("_norm", text).withColumn("_digest", F.encode(F.substring(text, 1, 1), "utf-8"))


def test_exact_dedup_compares_bytes_under_one_digest(spark, monkeypatch):
    monkeypatch.setattr(exact, "normalised", weak)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact.exact_dedup(spark, edge(spark, [(1, "ab"), (2, "AB"), (3, "ac"), (4, "b")])).collect()}
    assert got == {1: (2, 2), 2: (2, 2), 3: (3, 1), 4: (4, 1)}


def test_suffix_dedup(spark):
    rng = random.Random(5)
    parts = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(5, 90))) for _ in range(20)] + ["a" * 120, "ab" * 70]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 5)))) for i in range(120)]
    rows += [(300, None), (301, ""), (302, "x" * 49), (303, "x" * 50), (304, "x" * 51)]
    for df in (edge(spark, rows).repartition(5), read_documents(spark, SMALL)):
        got = {r.doc_id: tuple(r)[1:] for r in suffix.digest_columns(suffix.suffix_dedup(spark, df)).collect()}
        assert got == brute.suffix_removed(rows_of(df))
    assert suffix.suffix_dedup(spark, edge(spark, [])).isEmpty()
    nulls = suffix.suffix_dedup(spark, edge(spark, [(None, "q" * 60), (None, "q" * 60), (5, "q" * 60)])).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in nulls) == [(False, 0), (True, 60), (True, 60)]


def test_loser_tree_merges_front_coded_runs():
    import numpy as np

    rng = np.random.default_rng(1)
    runs, keys = [], []
    for n in (0, 1, 7, 50, 200):
        rows = np.unique(rng.integers(97, 99, (n, 12), dtype=np.uint8), axis=0)
        keys += [r.tobytes() for r in rows]
        runs.append(suffix.Run(suffix.front_code(rows), len(rows), 12))
    out, last = [], b""
    for r, _, common in suffix.merge(runs):
        key = runs[r].key
        same = next((k for k in range(12) if key[k : k + 1] != last[k : k + 1]), 12)
        assert common == (same if last else 0)
        out.append(key)
        last = key
    assert out == sorted(keys)


def test_suffix_windows_are_told_apart_by_bytes(monkeypatch):
    """With a hash that takes almost all windows for one, the answers are the same."""
    from keyloom.llm import suffix_dedup as sd

    rng, length = np.random.default_rng(4), 50
    left = length - sd.GRAM
    rows = rng.integers(0, 2, (400, length + left + 2), dtype=np.uint8)
    rows[:, :40] = 1  # many windows that differ in few bytes
    rows[200:] = rows[:200]
    rows[200:, length + 20 :] ^= 1
    rows[:, -2], rows[:, -1] = rng.integers(40, length + 1, 400), rng.integers(0, left + 1, 400)
    first, last, group = rng.integers(0, 900, 400), rng.integers(900, 999, 400), np.sort(rng.integers(0, 3, 400))
    want = sd._answers(rows, first, last, group, length)
    monkeypatch.setattr(sd, "mix64", lambda x: np.asarray(x, dtype=np.uint64) & np.uint64(1))
    assert len(want) and np.array_equal(sd._answers(rows, first, last, group, length), want)


def test_suffix_windows_are_grouped_in_little_memory():
    """A row of merged suffixes costs less than a number for each of its offsets would."""
    import tracemalloc

    from keyloom.llm import suffix_dedup as sd

    rng, length, n = np.random.default_rng(6), 50, 100_000
    rows = rng.integers(97, 123, (n, 2 * length - sd.GRAM + 2), dtype=np.uint8)
    rows[n // 2 :] = rows[: n // 2]
    rows[:, -2], rows[:, -1] = length, length - sd.GRAM
    first, group = np.arange(n), np.arange(n) % (n // 2) // 3
    tracemalloc.start()
    got = sd._answers(rows, first, first, group, length)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = [[r, 0, length - sd.GRAM, r - n // 2] for r in range(n // 2, n)]
    assert sorted(got.tolist()) == want and peak < 350 * n


def test_suffix_parts_end_with_an_anchor(spark, monkeypatch):
    """Merged in parts of one anchor each, answers are those of brute force."""
    from keyloom.llm import suffix_dedup as sd

    rng = random.Random(8)
    parts = ["".join(rng.choice("ab ") for _ in range(80)) for _ in range(6)] + ["c" * 90]
    rows = [(i, "".join(rng.choice(parts) for _ in range(3))) for i in range(60)]
    monkeypatch.setattr(sd, "PART_ROWS", 1)
    got = {r.doc_id: tuple(r)[1:] for r in sd.digest_columns(sd.suffix_dedup(spark, edge(spark, rows).repartition(3))).collect()}
    assert got == brute.suffix_removed(rows)


def test_shingles_of_a_large_batch_take_little_memory():
    import tracemalloc

    import pyarrow as pa

    from keyloom.llm import textops

    rng = random.Random(9)
    words = [f"w{k}" for k in range(5000)]
    column = pa.array([" ".join(rng.choices(words, k=300)) for _ in range(3000)])
    tracemalloc.start()
    assert sum(len(s) for _, s in textops.shingle_sets(column)) > 800_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 << 20
