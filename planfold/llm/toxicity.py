"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

Features: density and weight of lexicon words, how many stand near a second-person word, capitals, punctuation, marks, obfuscated and
stretched words, length. The lexicon is learned: word beginnings (4 and 5 letters) far more frequent in toxic texts. To keep training
honest, each half of the training rows gets its features from the lexicon of the other half; scoring uses the lexicon of both.

Labels are read from rows whose crc32(doc_id as text) mod 4 is not 2 and whose document is there. At most TRAIN_ROWS of them, chosen by class, fit the
models: three fifths grow the trees, two fifths calibrate. Lang, source, doc_id and labels are never inputs of a score.

Defined results: null or empty text is scored like any text, with all features 0; a doc_id with several labels counts as toxic if
one says so; null labels are left out; with fewer than MIN_CLASS labelled texts of either class, or none to grow or to calibrate with, the score
is 0, as nothing was learned. Rows that repeat a doc_id are scored one by one. Extra columns are ignored by scored(), kept by drop_toxic()."""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planfold.llm.common import cut, fold, map_texts, table, without, written

TRAIN_ROWS, LEXICON_ROWS, MIN_CLASS = 20_000, 2_000, 5
THRESHOLD, TREES, DEPTH = 0.3, 20, 3
#: A lexicon entry: in so many toxic texts at least, with odds so many times those in other texts, and so surely (G-test).
MIN_TEXTS, MIN_ODDS, MIN_G = 3, 6.0, 12.0
NEAR = 5
#: Second-person words of the languages at hand.
SECOND_PERSON = frozenset("you your yours yourself u ur thou tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer tú ti usted ustedes tus vosotros vuestro".split())
_EDGE = ".,;:!?\"'()[]<>|-*#$%&"
_OBFUSCATED = re.compile(r"[A-Za-z][0-9@$*!|]+[A-Za-z]")
_STRETCHED = re.compile(r"([A-Za-z])\1\1")
_UPPER, _LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])
FEATURES = 12


def stems(tokens: list[str]) -> set[str]:
    """Beginnings of 4 and 5 letters; the length tells them apart."""
    return {t[:4] for t in tokens if len(t) >= 4} | {t[:5] for t in tokens if len(t) >= 5}


def _tokens(text: str) -> list[str]:
    return [t.strip(_EDGE) for t in text.lower().split()]


def features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    if not text:
        return [0.0] * FEATURES
    tokens = _tokens(text)
    n = len(tokens) or 1
    hits, weights = [], []
    for i, t in enumerate(tokens):
        w = lexicon.get(t[:5]) or lexicon.get(t[:4])
        if w and len(t) >= 4:
            hits.append(i)
            weights.append(w)
    second = [i for i, t in enumerate(tokens) if t in SECOND_PERSON]
    near = sum(any(tokens[j] in SECOND_PERSON for j in range(max(0, i - NEAR), min(n, i + NEAR + 1))) for i in hits) if second else 0
    raw = text.encode()
    letters = len(raw) - len(raw.translate(None, _LETTERS)) or 1
    size = len(raw)
    return [
        len(hits) / n, sum(weights) / n, math.log1p(len(hits)), max(weights, default=0.0), math.log1p(sum(weights)),
        near / len(hits) if hits else 0.0, len(second) / n,
        (len(raw) - len(raw.translate(None, _UPPER))) / letters, (raw.count(b"!") + raw.count(b"?")) / size,
        sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"@"))) / size, sum(1 for _ in _OBFUSCATED.finditer(text)) / n, sum(1 for _ in _STRETCHED.finditer(text)) / n,
    ]


def labelled(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, toxic, part, half, weight): the training rows, at most `rows`, among labels that have a document; part: 0 to 4.

    Beyond `rows` each class keeps those with the smallest hash, toxic ones half of all rows or whatever the others leave; weight is how
    many labels of its class a row stands for, so that rare toxic texts are learned and scores still follow their true share."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic") == 1).cast("int").alias("toxic")).where(fold(F.col("doc_id")) != 2)
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("_mixed", F.xxhash64(F.lit("toxicity"), "doc_id"))
    known = written(known)
    n = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    clean, toxic = n.get(0, 0), n.get(1, 0)
    most = {1: min(toxic, max(rows // 2, rows - clean))}
    most[0] = min(clean, rows - most[1])
    parts = [known.where(F.col("toxic") == x).orderBy("_mixed", "doc_id").limit(k).withColumn("weight", F.lit(n[x] / k)) for x, k in most.items() if k]
    both = parts[0].union(parts[1]) if len(parts) == 2 else parts[0] if parts else known.limit(0).withColumn("weight", F.lit(1.0))
    return cut(both.select("doc_id", "toxic", F.pmod("_mixed", F.lit(5)).alias("part"), F.pmod(F.shiftright("_mixed", 8), F.lit(2)).cast("int").alias("half"), "weight"))


def learned_lexicons(train: DataFrame) -> list[dict[str, float]]:
    """[of half 0, of half 1, of both]: stem -> log odds. Counted in tasks, summed by stem; only entries that pass come back."""
    totals = {(r.half, r.toxic): r.n for r in train.groupBy("half", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}

    def count(batch: pa.RecordBatch):
        found: dict[str, list[int]] = {}
        for text, toxic, half in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "half")), strict=True):
            for s in stems(_tokens(text or "")):
                found.setdefault(s, [0, 0, 0, 0])[2 * half + (toxic == 1)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array([c[i] for c in found.values()], pa.int64()) for i in range(4))], names=["stem", "c0", "p0", "c1", "p1"])

    sums = map_texts(train, ["text", "toxic", "half"], "stem string, c0 long, p0 long, c1 long, p1 long", count).groupBy("stem").agg(*(F.sum(c).alias(c) for c in ("c0", "p0", "c1", "p1")))
    sums = cut(sums.where(f"p0 + p1 >= {MIN_TEXTS}"))
    out = []
    for halves in ((0,), (1,), (0, 1)):
        clean, toxic = (sum(totals.get((h, x), 0) for h in halves) for x in (0, 1))
        a, b = (F.expr(" + ".join(f"{x}{h}" for h in halves)).cast("double") for x in "pc")
        odds = F.log((a + 0.5) / (F.lit(float(toxic)) - a + 0.5)) - F.log((b + 0.5) / (F.lit(float(clean)) - b + 0.5))
        g = lambda k, n: F.when(k > 0, k * F.log(k * (toxic + clean) / ((a + b) * n))).otherwise(0.0)
        rows = sums.select("stem", a.alias("a"), odds.alias("odds"), (2 * (g(a, toxic) + g(b, clean))).alias("g")) if toxic and clean else None
        best = rows.where((F.col("a") >= MIN_TEXTS) & (F.col("odds") >= math.log(MIN_ODDS)) & (F.col("g") >= MIN_G)).orderBy(F.desc("g"), "stem").limit(LEXICON_ROWS).collect() if rows is not None else []
        out.append({r.stem: float(r.odds) for r in best})
    return out


def measured(docs: DataFrame, lexicons: list[dict[str, float]], *more: str) -> DataFrame:
    """docs(text, half, ...) -> features array<double>; a null half takes the lexicon of both halves."""
    def each(batch: pa.RecordBatch):
        rows = [features(t, lexicons[2 if h is None else 1 - h]) for t, h in zip(batch.column("text").to_pylist(), batch.column("half").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in more), pa.array(rows, pa.list_(pa.float64()))], names=[*more, "features"])

    kinds = dict(docs.dtypes)
    return map_texts(docs, [*more, "text", "half"] if "half" not in more else [*more, "text"], ", ".join(f"{c} {kinds[c]}" for c in more) + ", features array<double>", each)


def scored(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, toxic) -> doc_id, held_out, score, predicted."""
    docs = docs.select("doc_id", "text")
    sample = labelled(docs, labels, train_rows)
    train = written(docs.join(F.broadcast(sample), "doc_id"))  # at most train_rows rows of a few bytes are sent
    counts = {(r.toxic, r.grows): r["count"] for r in train.groupBy("toxic", (F.col("part") < 3).alias("grows")).count().collect()}
    clean, toxic = (sum(n for (x, _), n in counts.items() if (x == 1) == (want == 1)) for want in (0, 1))
    held_out = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out")
    score = F.lit(0.0)
    if min(clean, toxic) < MIN_CLASS or len(counts) < 4:
        rows = docs
    else:
        lexicons = learned_lexicons(train)
        rows = cut(measured(train, lexicons, "toxic", "part", "half", "weight").select(F.col("toxic").cast("double").alias("label"), "part", "weight", array_to_vector("features").alias("features"))).coalesce(4)  # bounded, as train_rows are
        trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, maxBins=32, subsamplingRate=1.0, seed=7, weightCol="weight").fit(rows.where("part < 3"))
        p = vector_to_array("probability")[1]
        steps = IsotonicRegression(featuresCol="p", labelCol="label", weightCol="weight").fit(trees.transform(rows.where("part >= 3")).select(p.alias("p"), "label", "weight"))
        rows = measured(docs.withColumn("half", F.lit(None).cast("int")), lexicons, "doc_id").select("doc_id", array_to_vector("features").alias("features"))
        rows = steps.transform(trees.transform(rows).select("doc_id", p.alias("p")))
        # calibrated steps are flat; a fiftieth of the trees' own probability keeps the order within a step
        score = 0.98 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("prediction"))) + 0.02 * F.col("p")
    return rows.select("doc_id", held_out, score.cast("double").alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the documents predicted toxic."""
    return without(docs, scored(docs, labels).where("predicted = 1"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
