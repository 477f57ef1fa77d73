import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keyloom.llm import langid, mixing, piece_lattice, quality_forest, secret_scan, token_store, url_filter
from keyloom.llm.common import read_documents
from keyloom.llm.queries import URL_RULES, tokenizer_file
from tests.conftest import SMALL

from . import brute

EDGE = "doc_id long, text string, source string, lang string, size string, ids string, part string"


def edge(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", "x", "x", "x") for i, t, s in rows], EDGE)


ODD = [(1, "A b", "z"), (2, "a c", "z"), (None, None, "q"), (3, "", None), (3, "w", None), (3, "w", None)]


def test_url_rules_by_literals_and_by_join(spark, monkeypatch):
    pages = spark.createDataFrame(
        [(1, "http://good.org/a", '<a href="http://ok.net/x">'), (2, "http://ok.net/x", "<a href=//fine.net>"), (3, "http://spam.net/", '<a HREF="https://BAD.com/de/1">'),
         (4, "http://Bad.com/de/1", None), (5, None, None), (6, "nourl", "x"), (7, "http://lone.net", ""), (8, "x://a.example.org/en/12?q", ""), (8, "x://a.example.org/en/12?q", "")],
        "page_id long, url string, html string",
    )
    want = [
        (1, "good.org", "/a", "org/", "allow"), (2, "ok.net", "/x", None, "allow"), (3, "spam.net", "/", None, "block"),
        (4, "bad.com", "/de/1", "com/de/", "block"), (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "lone.net", "", None, "allow"),
        (8, "a.example.org", "/en/12", "example.org/en/1", "block"), (8, "a.example.org", "/en/12", "example.org/en/1", "block"),
    ]
    for most in (500, 0):
        monkeypatch.setattr(url_filter, "LITERAL_RULES", most)
        got = url_filter.url_filter(spark, pages, URL_RULES).orderBy("page_id").collect()
        assert [tuple(r)[:5] for r in got] == want
    assert url_filter.url_filter(spark, pages.limit(0), URL_RULES).isEmpty()


def test_page_rank_against_a_plain_loop(spark):
    links = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", "c")]
    edges = spark.createDataFrame(links, "src string, dst string")
    seeds = spark.createDataFrame([("a", 0.5), ("d", 0.5)], "host string, weight double")
    from keyloom.llm.common import shared_dir

    got = {r.host: r.score for r in url_filter.walk(spark, edges, seeds, shared_dir(spark), "t", 0.85, 12).collect()}
    score = {"a": 0.5, "d": 0.5}
    for _ in range(12):
        new = {"a": 0.075, "d": 0.075}
        for x, y in links:
            new[y] = new.get(y, 0) + 0.85 * score.get(x, 0) / sum(s == x for s, _ in links)
        score = new
    assert got == pytest.approx(score)


def test_walks_go_on_until_they_settle(spark):
    """A host 23 links from a blocked one, and scores on a cycle against the solved equations."""
    chain = [f"h{k}.net" for k in range(23)] + ["bad.com"]
    pages = [(k, f"http://{a}/x", f'<a href="http://{b}/">') for k, (a, b) in enumerate(zip(chain, chain[1:]))] + [(99, "http://bad.com/de/1", None)]
    got = url_filter.url_filter(spark, spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES).collect()
    assert {r.verdict for r in got} == {"block"} and len(got) == 24

    from keyloom.llm.common import shared_dir

    links = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "a")]
    seeds = spark.createDataFrame([("a", 1.0)], "host string, weight double")
    score = {r.host: r.score for r in url_filter.walk(spark, spark.createDataFrame(links, "src string, dst string"), seeds, shared_dir(spark), "t", 0.85).collect()}
    m = np.array([[0, 0.5, 1], [1, 0, 0], [0, 0.5, 0]])
    exact = np.linalg.solve(np.eye(3) - 0.85 * m, [0.15, 0, 0])
    assert [score[h] for h in "abc"] == pytest.approx(exact.tolist(), rel=1e-8)


def test_secret_scan(spark):
    rng = random.Random(2)
    parts = ["token", "Secret", "api_key", "APIKEY", "=", ": ", " ", '"', "'", "abc", "0123456789abcdef", "AKIA", "ABCDEFGH12", "é\n", ".", "passwd=secret:"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30))), "s") for i in range(300)] + [(801, None, "s"), (802, "", "s")]
    rows += [(803, "see Zx9kQ2mVt7RwY8uNbL4pH3sD here", "s"), (804, "the createDefaultMessageHandlerFactory name", "s"), (805, "word " * 60_000, "s")]
    model = secret_scan.train(spark, spark.createDataFrame(secret_scan.labelled_samples(), "label string, text string"))
    for df in (edge(spark, rows), read_documents(spark, SMALL)):
        text = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
        for r in secret_scan.secret_scan(spark, df, model).collect():
            base = brute.secret_spans(text[r.doc_id])
            assert [tuple(x) for x in r.base] == base
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(b[1] == k for b in base) for k in range(3))
            more = [(s.start, s.stop) for s in r.spans if s.kind == 3]
            assert more == ([(4, 28)] if r.doc_id == 803 else []) or r.doc_id < 801
    assert secret_scan.secret_scan(spark, edge(spark, []), model).isEmpty()


def test_token_store(spark):
    path = tokenizer_file("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(1)
    bits = [" ", "  ", "a", "b'll", "'s", "'", "'re've", "\n", "\t", "é", "字", "!!", "\u00a0", "\u2003", "<|endoftext|>", "12", "²", "\x1c", "\u0378", "\U0001f600", "’"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    got = [x for _, _, some in token_store.encode(pa.array(texts), path, 2, 2) for x in some]
    for s, x in zip(texts, got, strict=True):
        assert np.frombuffer(x, np.uint16).tolist() == [*library.encode(s, add_special_tokens=False).ids, 2], s
    for df in (edge(spark, [*ODD, (5, "x <|endoftext|> y", "z"), (5, "one more of it", None)]), read_documents(spark, SMALL), edge(spark, [])):
        for part_bytes in (1000, 1 << 20):
            got = sorted(map(tuple, token_store.token_store(spark, df, path, part_bytes=part_bytes).collect()), key=lambda r: r[1])
            rows = df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
            want, start = [], 0
            for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
                ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
                want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
                start += len(ids)
            assert got == want


def test_pre_tokens_of_every_sure_character():
    """Each character of the basic plane that the tables claim to know, among others, as the library cuts it."""
    path = tokenizer_file("byte_bpe_50k.json")
    pre = Tokenizer.from_file(path).pre_tokenizer
    token_store.cut(np.array([0, 1]), np.frombuffer(b"a", np.uint8))
    sure = [chr(k) for k in np.flatnonzero(token_store._tables["all"] != token_store._UNSURE) if not 0xD800 <= k < 0xE000]
    assert len(sure) > 40_000
    for k in range(0, len(sure), 500):
        text = "".join(f"a{c}b{c} {c}1{c}{c}!{c}\n{c}'s" for c in sure[k : k + 500])
        data = np.frombuffer(text.encode(), np.uint8)
        start, unsure = token_store.cut(np.array([0, len(data)]), data)
        place = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])])
        assert not len(unsure) and start.tolist() == [int(place[a]) for _, (a, _) in pre.pre_tokenize_str(text)]


def test_long_texts_are_cut_where_no_token_reaches(monkeypatch):
    path = tokenizer_file("byte_bpe_50k.json")
    text = " ".join(f"word{k}'s  and\n{k}" for k in range(2000)) + "x" * 3000
    whole = next(token_store.encode(pa.array([text]), path, 2, 2))
    monkeypatch.setattr(token_store.textops, "CHUNK_BYTES", 500)
    data = np.frombuffer(text.encode(), np.uint8)
    pieces = list(token_store._pieces(data, 500))
    assert len(pieces) > 20 and [a for a, _ in pieces[1:]] == [b for _, b in pieces[:-1]]
    encoder = token_store._encoders[path, 2]
    assert whole[2][0][:-2] == b"".join(encoder.texts(np.array([0, b - a]), data[a:b])[0].tobytes() for a, b in pieces)


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, u in ((0, 0), (1, 0), (1, 99), (3000, 100_000), (700, 50), (300, 2**62)):
        v = np.sort(rng.integers(0, u + 1, n))
        ef = token_store.EliasFano.encode(v, u)
        assert [ef[i] for i in range(n)] == v.tolist()
        again, end = token_store.EliasFano.unpack(b"xx" + ef.packed(), 2, u)
        assert [again[i] for i in range(n)] == v.tolist() and end == 2 + len(ef.packed())
    for names in ([None, 4], [-(2**63), 2**63 - 1], [None, None], [7, 7]):
        shard = token_store.Shard(token_store.pack(names, [b"\1\0\2\0", b"\3\0"], 2))
        assert [shard.doc_id(i) for i in (0, 1)] == names
        assert shard.document(0).tolist() == [1, 2] and shard.document(1).tolist() == [3]


def _paths(model, unit, literal):
    out = []

    def go(i, score, ids):
        if i == len(unit):
            out.append((score, ids))
            return
        for n in range(1, min(16, len(unit) - i) + 1):
            piece = unit[i : i + n]
            barred = any(k in literal for k in range(i, i + n)) or piece_lattice.SPACE in piece[1:]
            one = None if barred else model.ids_by_name.get(piece)
            if one is not None:
                go(i + n, score + model.score_by_name[piece], [*ids, one])
            elif n == 1:
                some = [model.byte_id[b] for b in piece.encode()]
                go(i + 1, score + model.byte_score * len(some), ids + some)

    go(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


def test_n_best_segmentations_against_all_paths():
    model = piece_lattice.lattice(tokenizer_file("piece_bpe_32k.model"))
    encoder, rng = piece_lattice.Encoder(model), random.Random(3)
    for _ in range(80):
        t = "".join(rng.choice(["ab", "the", "ing", " ", "\n", "é", "▁", "字", "x1"]) for _ in range(rng.randint(1, 4)))
        want = _paths(model, piece_lattice.SPACE + t.replace(" ", piece_lattice.SPACE), {k + 1 for k, c in enumerate(t) if c == "▁"})[:4]
        ((ids, _, score, units, at),) = encoder.encode([t])
        best = encoder.nbest(units, at, 4)
        assert score == pytest.approx(want[0][0]) and [x for x, _ in best] == pytest.approx([want[0][0] - w[0] for w in want])
        assert model.decode(np.frombuffer(ids, np.uint16).tolist()) == t


def test_n_best_segmentations_with_runs_of_spaces():
    """Against every path over the library's own vocabulary, with nothing barred but literal U+2581."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    model = piece_lattice.lattice(tokenizer_file("piece_bpe_32k.model"))
    names = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    cost = {p: float(-np.log(3 + min(max(0.0, -sp.get_score(i)), sp.get_piece_size()))) for p, i in names.items()}

    def paths(text):
        whole, best = piece_lattice.SPACE + text.replace(" ", piece_lattice.SPACE), [[(0.0, [])]]
        literal = {k + 1 for k, c in enumerate(text) if c == piece_lattice.SPACE}
        for j in range(1, len(whole) + 1):
            found = []
            for i in range(j):
                piece, bare = whole[i:j], not any(k in literal for k in range(i, j))
                if bare and piece in names:
                    found += [(s + cost[piece], [*ids, names[piece]]) for s, ids in best[i]]
                elif j == i + 1:
                    some = [model.byte_id[b] for b in piece.encode()]
                    found += [(s + model.byte_score * len(some), ids + some) for s, ids in best[i]]
            best.append(sorted(found, key=lambda x: -x[0])[:6])
        return best[-1]

    encoder, rng = piece_lattice.Encoder(model, space_runs=True), random.Random(4)
    texts = ["a   b", "▁▁x", "  x", " ▁ x", "   ", "a\n    return x", " " * 40 + "if", "x" + " " * 15 + "y "]
    texts += ["".join(rng.choice(["ab", "the", " ", "  ", " " * 7, "\n", "é", "▁", "字"]) for _ in range(rng.randint(1, 7))) for _ in range(150)]
    for t in texts:
        want = paths(t)[:4]
        ((ids, _, score, units, at),) = encoder.encode([t])
        best = encoder.nbest(units, at, 4)
        assert score == pytest.approx(want[0][0]), t
        assert [x for x, _ in best] == pytest.approx([want[0][0] - w[0] for w in want], abs=1e-9), t
        assert model.decode(np.frombuffer(ids, np.uint16).tolist()) == t
    (row,) = encoder.encode(["a   b"])
    assert np.frombuffer(row[0], np.uint16).tolist() in (sp.encode("a   b"), [names["▁a"], names["▁▁"], names["▁b"]])


def test_long_fragments_against_short_ones(monkeypatch):
    """Solved place by place or as arrays, a fragment has the same paths."""
    model, rng = piece_lattice.lattice(tokenizer_file("piece_bpe_32k.model")), random.Random(5)
    texts = ["".join(rng.choice(["the", "ing", "qz", "é", "字", "a", "a"]) for _ in range(12)) for _ in range(30)] + ["a" * 60]
    one, two = (piece_lattice.Encoder(model, space_runs=True) for _ in range(2))
    facts = lambda e: [(ids, size, score, [x for x, _ in e.nbest(units, at, 5)]) for ids, size, score, units, at in e.encode(texts)]
    want = facts(one)
    monkeypatch.setattr(piece_lattice, "LONG", 3)
    got = facts(two)
    for x, y in zip(got, want):
        assert x[1:] == y[1:] and model.decode(np.frombuffer(x[0], np.uint16).tolist()) == model.decode(np.frombuffer(y[0], np.uint16).tolist())


def test_a_word_of_a_million_characters():
    model, rng = piece_lattice.lattice(tokenizer_file("piece_bpe_32k.model")), random.Random(7)
    for text in ("x" * 1_000_000, "".join(rng.choices("abcdefghijklmnop", k=1_000_000))):
        began = time.process_time()
        encoder = piece_lattice.Encoder(model, space_runs=True)
        ((ids, size, _, units, at),) = encoder.encode([text])
        assert len(encoder.nbest(units, at, 4)) == 4
        assert time.process_time() - began < 60
        assert model.decode(np.frombuffer(ids, np.uint16).tolist()) == text


def test_long_texts_part_by_part(monkeypatch):
    model, rng = piece_lattice.lattice(tokenizer_file("piece_bpe_32k.model")), random.Random(8)
    text = "".join(rng.choice(["the ", "ing", "  ", "\n", "é ", "▁"]) for _ in range(3000))
    whole = piece_lattice.Encoder(model, space_runs=True).texts([text, "", "a b"])
    monkeypatch.setattr(piece_lattice, "PART_CHARS", 100)
    encoder = piece_lattice.Encoder(model, space_runs=True)
    parts = encoder.texts([text, "", "a b"])
    for a, b in zip(whole, parts):
        assert a[0].tolist() == b[0].tolist() and a[1] == b[1] and a[2] == pytest.approx(b[2]) and a[5] and b[5]
    assert len(encoder.nbest(parts[0][3], parts[0][4], 4)) == 4


def test_pieces_round_trip(spark):
    path = tokenizer_file("piece_bpe_32k.model")
    for df in (edge(spark, [*ODD, (9, "▁ \n é" * 50, "z"), (10, "x" * 30_000, "z")]), read_documents(spark, SMALL), edge(spark, [])):
        encoded = piece_lattice.encode_documents(df, path)
        assert encoded.where("NOT round_trip").isEmpty()
        texts = sorted((r.text or "") for r in df.select("text").collect())
        assert sorted(r.text for r in piece_lattice.decode_documents(encoded, path).collect()) == texts


def test_quality_counts_and_forest(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    df = read_documents(spark, SMALL)
    text = {r.doc_id: r.text for r in df.collect()}
    got = quality_forest.quality(spark, df, labels).collect()
    for r in got:
        n, *rest = brute.quality_counts(text[r.doc_id])
        repeats = rest[-1]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 10 or 100 * repeats > 20 * n) and not (r.kept and r.base_failed)
    odd = edge(spark, [*ODD, (20, "a b c d e " * 4, "z"), (21, "x\n\nx\n x\nx", "z")])
    for r in quality_forest.quality(spark, odd, labels.limit(0)).collect():
        t = {20: "a b c d e " * 4, 21: "x\n\nx\n x\nx"}.get(r.doc_id)
        if t:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.quality_counts(t)
            assert r.kept != r.base_failed
    assert quality_forest.quality(spark, edge(spark, []), labels).isEmpty()


def test_forest_cut_counts_all_labelled_documents(spark):
    """The cut-off is the quantile over every document labelled good, however many there are."""
    rng = np.random.default_rng(12)
    docs = [(i, " ".join(f"{'Aa1|!#'[k % 6]}{k}" for k in rng.integers(0, rng.integers(20, 3000), rng.integers(12, 40))), "z") for i in range(6000)]
    labels = spark.createDataFrame([(i, 1) for i in range(6000)], "doc_id long, quality int")
    rows = quality_forest.quality(spark, edge(spark, docs), labels).collect()
    good = [r for r in rows if not r.base_failed]
    cut = np.quantile([r.anomaly for r in good], 1 - quality_forest.MAX_LOSS, method="higher")
    assert len(good) > 5500 and {r.doc_id for r in good if r.kept} == {r.doc_id for r in good if r.anomaly <= cut}


def test_forest_isolates_what_lies_apart():
    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.normal(0.5, 0.02, (300, 3)), [[0.95, 0.1, 0.9]]])
    forest = quality_forest.IsolationForest(rows[:-1], np.zeros(3), np.ones(3))
    score = forest.score(rows)
    assert score[-1] > score[:-1].max()


def test_mix(spark):

    for df in (read_documents(spark, SMALL), edge(spark, ODD)):
        taken, plan = mixing.mix(spark, df)
        rows = taken.collect()
        assert len(rows) == df.count()
        by_source = {}
        for r in rows:
            s = by_source.setdefault(r.source, [0, 0, r.target, r.source_size])
            s[0] += r["size"]
            s[1] += r.taken
            assert 0 <= r.taken <= 3 * r["size"]
        for size, got, target, source_size in by_source.values():
            assert size == source_size and got == int(target) and target <= 3 * size + 1e-9
        assert sum(t for _, _, t, _ in by_source.values()) == pytest.approx(sum(s for s, *_ in by_source.values()))
        assert sorted(map(tuple, taken.collect()), key=repr) == sorted(map(tuple, mixing.mix(spark, df)[0].collect()), key=repr)
        assert plan.groupBy("source", "block", "pass_no").count().where("count > 1").isEmpty()
    assert mixing.mix(spark, edge(spark, []))[0].isEmpty()


def test_targets_stop_at_three_sizes():
    got = mixing.targets({"a": 100, "b": 1, "c": 100})
    assert got["b"] == 3 and sum(got.values()) == pytest.approx(201) and got["c"] == pytest.approx(3 * got["a"])


def test_network_gradients():
    net = langid.Network(["a", "b"])
    data, mask = langid._padded([b"abc", b"de", b"xyzw"])
    label = np.array([0, 1, 1])
    _, grads = net.step(data, mask, label)
    for w, g in zip(net.weights(), grads):
        at = tuple(np.unravel_index(np.abs(g).argmax(), g.shape))
        old, e = w[at], 1e-5
        w[at] = old + e
        up, _ = net.step(data, mask, label)
        w[at] = old - e
        down, _ = net.step(data, mask, label)
        w[at] = old
        assert (up - down) / (2 * e) == pytest.approx(g[at], abs=1e-6)


def test_language(spark):
    df = read_documents(spark, "/root/testdata/sf0.01")
    lang = {r.doc_id: r.lang for r in df.collect()}
    frozen = langid.fit(spark, df)
    rows = langid.language(spark, df, frozen).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    out = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert sum(out) >= 0.97 * len(out)
    odd = {r.text: (r.lang_pred, r.score) for r in langid.language(spark, edge(spark, [(1, " 12 ", "z"), (None, None, "q"), (3, "字", "z"), (4, "the of and " * 9000, "z")]), frozen, carry=True).select("_row.text", "lang_pred", "score").collect()}
    assert odd[" 12 "] == ("und", 0.0) and odd[None] == ("und", 0.0) and odd["字"][0] != "und"
    assert langid.language(spark, edge(spark, [])).isEmpty()


def test_added_secrets_on_held_out_samples(spark):
    """Random strings and identifiers that the chains were not trained on, in prose, one a text."""
    from keyloom.llm.secret_scan import labelled_samples, secret_scan

    held = [(k, label, f"the old value {text} was kept in place") for k, (label, text) in enumerate(labelled_samples(300, seed=77))]
    held = [(k, label, text) for k, label, text in held if len(text.split()[3]) >= 20]
    docs = spark.createDataFrame([(k, text) for k, _, text in held], "doc_id bigint, text string")
    found = {r.doc_id for r in secret_scan(spark, docs).where("size(spans) > 0").collect()}
    random_ones = {k for k, label, _ in held if label == "random"}
    recall, precision = len(found & random_ones) / len(random_ones), len(found & random_ones) / len(found)
    print(f"recall {recall:.3f}, precision {precision:.3f}, of {len(random_ones)} random and {len(held) - len(random_ones)} ordinary")
    assert recall >= 0.9 and precision >= 0.9
