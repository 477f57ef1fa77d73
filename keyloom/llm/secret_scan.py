"""Secret scans: fixed patterns, then character Markov models of what they miss.

Three patterns find assignments, access keys and hexadecimal strings.  Other long runs
of key characters are candidates for the models: two first-order Markov chains over
characters, one of random strings and one of ordinary identifiers, give a candidate the
log-likelihood ratio of having been drawn at random.  Both are estimated from labelled
samples, and the cut-off is calibrated on them.

All of it is DataFrame expressions: positions come from the lengths of what a pattern
matches and of what lies between, and the chains are one array of whole thousandths of
log ratios, indexed by character pairs.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = (
    r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: A run of the class is found whole or not at all, so its least length may stand in the pattern.
ACCESS, HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
#: What the models judge; a run of fewer characters says too little.
CANDIDATE, MIN_LENGTH = r"[A-Za-z0-9+/_-]{20,}", 20
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
_SIDE = len(ALPHABET) + 1  # and 0 for any other character
_SPAN = "array<struct<start:int,kind:int,stop:int>>"

#: Everyday words and name parts, of which ordinary identifiers are made.
WORDS = (
    "account address after again answer archive array balance before between bottom branch buffer button cache "
    "change channel check child client close color column comment config connect content context control count "
    "create current customer data date default delete detail device direct display document domain down driver "
    "element empty enable encode engine error event export factory feature field file filter final first folder "
    "format forward frame function general global group handler hash header height help history host image import "
    "index info input insert instance integer internal item iterator join keyboard label language last layer left "
    "length level library limit line link list load local location lock logger login machine manager map market "
    "master member memory menu message method middle minimum model module monitor mouse name network next node "
    "normal number object office offset open option order output owner package page panel parent parse partner "
    "path pattern person phone picture player point policy port position power prefix previous print process "
    "product profile program project property protocol provider public query queue random range reader record "
    "region remote render report request reset resource response result right root route sample scale schedule "
    "schema screen script search section select sender server service session setting shape share simple size "
    "source space start state static status storage stream string style subject submit system table target task "
    "template test text theme thread time title tool total trace track transfer tree trigger type under unit "
    "update upload user util value vector version video view visible voice warning water width window word worker "
    "write year zone abend anderen arbeit aussen beispiel deutsch entwicklung fenster gesellschaft haus jahr "
    "kinder leben menschen nummer ordnung sprache stadt strasse verbindung welt wissenschaft zeit zusammen agua "
    "cambio ciudad cuenta desarrollo ejemplo empresa entrada escuela estado gobierno historia idioma lugar mundo "
    "noticia palabra persona pregunta programa respuesta salida semana sistema tiempo trabajo usuario valor ventana "
    "annee bonjour chemin compte demande document enfant exemple fichier gouvernement histoire langue maison monde "
    "nombre nouveau ouverture parole personne probleme question reponse semaine systeme temps travail ville voiture"
).split()


def labelled_samples(n: int = 3000, seed: int = 3) -> list[tuple[str, str]]:
    """(label, text): ``n`` random strings and ``n`` ordinary identifiers, the same every time."""
    rng, out = random.Random(seed), []
    alphabets = (ALPHABET[:62], ALPHABET[:64], ALPHABET, ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62])
    for i in range(n):
        letters = alphabets[i % len(alphabets)]
        out.append(("random", "".join(rng.choice(letters) for _ in range(rng.randint(20, 48)))))
    for i in range(n):
        parts = [rng.choice(WORDS) for _ in range(rng.randint(3, 7))]
        if i % 6 == 1:
            parts = [p.capitalize() for p in parts]
        elif i % 6 == 2:
            parts = [p.upper() for p in parts]
        elif i % 6 == 3:
            parts.append(str(rng.randint(0, 2030)))
        elif i % 6 == 4:
            parts = [parts[0], *(p.capitalize() for p in parts[1:])]
        out.append(("ordinary", ("", "", "_", "-", "", "/")[i % 6].join(parts)))
    return out


def _codes(text):
    """Places of the characters in ALPHABET, from 1; 0 for others."""
    return F.transform(F.split(text, ""), lambda c: F.when(c == "", F.lit(0)).otherwise(F.instr(F.lit(ALPHABET), c)))


def train(spark: SparkSession, samples: DataFrame, margin: float = 1.0) -> tuple[list[int], int]:
    """(weights, cut-off) from samples with columns label ('random' or 'ordinary') and text.

    Weights are thousandths of log ratios of the smoothed pair probabilities, by first
    and second character.  The cut-off, a mean per pair, lies ``margin`` thirds of the
    way between the highest ordinary and the mean random sample above the former.
    Counts are aggregated in Spark; the driver sees one number a pair.
    """
    codes = samples.select("label", _codes(F.col("text")).alias("c")).where("size(c) > 1")
    pairs = codes.select(
        "label", F.explode(F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c")), lambda a, b: a * _SIDE + b)).alias("pair")
    )
    counts = {label: [0.5] * (_SIDE * _SIDE) for label in ("random", "ordinary")}
    for r in pairs.groupBy("label", "pair").count().collect():
        counts[r["label"]][r["pair"]] += r["count"]
    rows = {k: [sum(v[a * _SIDE : (a + 1) * _SIDE]) for a in range(_SIDE)] for k, v in counts.items()}
    weights = [
        round(
            1000
            * (
                math.log(counts["random"][i] / rows["random"][i // _SIDE])
                - math.log(counts["ordinary"][i] / rows["ordinary"][i // _SIDE])
            )
        )
        for i in range(_SIDE * _SIDE)
    ]
    ratio = samples.select("label", mean_ratio(F.col("text"), weights).alias("r"))
    got = {r["label"]: r for r in ratio.groupBy("label").agg(F.max("r").alias("top"), F.avg("r").alias("mean")).collect()}
    top = got["ordinary"]["top"] if "ordinary" in got else 0
    mean = got["random"]["mean"] if "random" in got else 1000
    return weights, int(top + margin * max(0, mean - top) / 3)


def mean_ratio(text, weights: list[int]):
    """Mean log-likelihood ratio per character pair, in thousandths."""
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")
    codes = _codes(text)
    pairs = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes)), lambda a, b: a * _SIDE + b)
    total = F.aggregate(pairs, F.lit(0).cast("long"), lambda acc, p: acc + F.get(table, p))
    return F.floor(total / F.greatest(F.length(text) - 1, F.lit(1)))


def _found(text, pattern: str, kind: int, accept):
    """Spans of the accepted matches of ``pattern``; ``accept`` judges (match, group 2)."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    second = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == 0 else matches
    between = F.split(text, pattern, -1)
    steps = F.zip_with(
        F.zip_with(F.slice(between, 1, F.size(matches)), matches, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("m"))),
        second,
        lambda x, g: F.struct(x["gap"].alias("gap"), x["m"].alias("m"), g.alias("g")),
    )
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {_SPAN})").alias("out"))

    def add(acc, x):
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["m"])
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("stop"))
        return F.struct(
            end.alias("at"), F.when(accept(x["m"], x["g"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out")
        )

    found = F.aggregate(steps, start, add, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.expr(f"cast(array() as {_SPAN})"))


def _written(spans):
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def secret_scan(spark: SparkSession, docs: DataFrame, model: tuple[list[int], int] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base, spans; one row for each document.

    ``base`` and ``spans`` are arrays of (start, kind, stop) by start, then kind: places
    in code points, the end exclusive, kinds numbered as in KINDS.  ``spans`` adds to the
    base ones the candidates that the models find random and that touch no base span.
    Null text is empty and has no spans.  Rows are judged each by itself, repeated and
    null doc_ids too; an empty table gives an empty result; further columns are ignored.
    """
    if model is None:
        model = train(spark, spark.createDataFrame(labelled_samples(), "label string, text string"))
    weights, cut = model
    text = F.col("_text")
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    every = lambda m, g: F.lit(True)
    found = rows.select(
        "doc_id",
        _found(text, ASSIGN, 0, lambda m, g: F.length(g) >= 12).alias("_assign"),
        _found(text, ACCESS, 1, every).alias("_access"),
        _found(text, HEX, 2, every).alias("_hex"),
        _found(text, CANDIDATE, 3, lambda m, g: m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (mean_ratio(m, weights) > cut)).alias("_odd"),
    ).withColumn("_base", F.array_sort(F.concat("_assign", "_access", "_hex")))
    apart = F.filter(
        "_odd", lambda s: ~F.exists("_base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
    )
    return found.withColumn("_more", apart).select(
        "doc_id",
        *(F.size(c).cast("long").alias(n) for c, n in (("_assign", "n_assign"), ("_access", "n_access"), ("_hex", "n_hex"), ("_more", "n_markov"))),
        F.col("_base").alias("base"),
        F.array_sort(F.concat("_base", "_more")).alias("spans"),
    )


def digest_columns(found: DataFrame) -> DataFrame:
    """The spans as text, and a SHA-256 of the base ones."""
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans")
    )
