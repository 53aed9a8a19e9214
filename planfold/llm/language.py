"""Language ID by multilingual mixture inference.

A document is a mixture of languages: each of its byte trigrams comes from a language with the document's proportions, under that
language's trigram model. Expectation-maximisation estimates the proportions; the set of languages is the one of the likeliest k
languages whose likelihood less 0.5 * log(trigrams) for each further language is best. The largest proportion in the set names the
document.

Models are fitted on texts with a lang whose crc32(doc_id as text) mod 4 is not 2: about TRAIN_ROWS of each language, chosen by hash
(all of them where there are fewer). Lang, source and doc_id are never inputs of a prediction.

Defined results: null text, or text without a letter: 'und', score 0; no labelled text at all: 'und' for all. Rows are predicted one
by one, so repeated rows don't matter. Extra columns are ignored by identified()."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planfold.llm.common import fold, map_texts, table

TRAIN_ROWS = 3_000
BUCKETS = 1 << 15
ROUNDS, SET_ROUNDS = 8, 4
#: Texts that are fitted together, and numbers (trigrams times languages) in a table of theirs, about.
TOGETHER, CELLS = 250, 4_000_000
SMOOTH = 0.5
#: Digits, punctuation and controls count as blanks.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LETTER = re.compile(r"[^\W\d_]")


def trigrams(text: str) -> np.ndarray:
    """Buckets of the text's byte trigrams, words apart by one blank."""
    plain = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_PLAIN).split()) + b" "
    a = np.frombuffer(plain, np.uint8).astype(np.uint32)
    h = (a[:-2] * np.uint32(0x9E3779B1)) ^ (a[1:-1] * np.uint32(0x85EBCA77)) ^ (a[2:] * np.uint32(0xC2B2AE3D))
    return ((h * np.uint32(0x27D4EB2F)) >> np.uint32(17)) & np.uint32(BUCKETS - 1)


def trained(docs: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log-free trigram probabilities: languages x BUCKETS), at most languages * BUCKETS counts on the driver."""
    known = docs.where("lang is not null and text is not null").where(fold(F.col("doc_id")) != 2)
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return [], np.empty((0, BUCKETS), np.float32)
    share = F.create_map(*(x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, rows / counts[lang])))))
    chosen = known.where(F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)

    def count(batch: pa.RecordBatch):
        sums: dict[str, np.ndarray] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            sums[lang] = sums.get(lang, 0) + np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, seen in sums.items():
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], names=["lang", "bucket", "n"])

    sums = map_texts(chosen, ["lang", "text"], "lang string, bucket long, n long", count).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table_ = np.full((len(langs), BUCKETS), SMOOTH, np.float64)
    for r in sums.collect():
        table_[langs.index(r.lang), r.bucket] += r.n
    return langs, (table_ / table_.sum(axis=1, keepdims=True)).astype(np.float32)


def mixtures(texts: list[np.ndarray], model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best language, score) of each text, given as trigram buckets; all texts of a batch go through each round together."""
    n, langs = len(texts), len(model)
    best, score = np.zeros(n, np.int64), np.zeros(n)
    seen = [np.bincount(t, minlength=1) for t in texts]
    grams = [np.flatnonzero(s) for s in seen]
    sizes = np.array([len(g) for g in grams])
    full = np.flatnonzero(sizes)
    if not len(full):
        return best, score
    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    of = np.repeat(np.arange(len(full)), sizes[full])
    weight = np.concatenate([seen[i][grams[i]] for i in full]).astype(np.float32)
    p = model[:, np.concatenate([grams[i] for i in full])]
    total = np.add.reduceat(weight, starts)

    def settle(share: np.ndarray, rounds: int) -> np.ndarray:
        for _ in range(rounds):
            part = p * share[:, of]
            part *= weight / part.sum(axis=0)
            share = np.add.reduceat(part, starts, axis=1) / total
        return share

    share = settle(np.full((langs, len(full)), 1 / langs, np.float32), ROUNDS)
    rank = np.argsort(np.argsort(-share, axis=0, kind="stable"), axis=0, kind="stable")
    top, chosen, grows = np.full(len(full), -np.inf), None, np.ones(len(full), bool)  # a text's set grows while it gains
    for k in range(1, langs + 1):
        part = np.where(rank < k, np.maximum(share, 1e-6), 0).astype(np.float32)
        part = settle(part / part.sum(axis=0), SET_ROUNDS if k > 1 else 0)
        likely = np.add.reduceat(weight * np.log((p * part[:, of]).sum(axis=0)), starts).astype(np.float64) - 0.5 * (k - 1) * np.log(total)
        grows = better = grows & (likely > top + 1e-9)
        if not better.any():
            break
        top, chosen = np.where(better, likely, top), part if chosen is None else np.where(better, part, chosen)
    best[full] = chosen.argmax(axis=0)
    # few trigrams say little: shrunk towards an even mixture
    score[full] = (total * chosen.max(axis=0) + 1) / (total + langs)
    return best, score


def identified(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang) -> doc_id, held_out, lang_pred, score."""
    langs, model = trained(docs)

    def each(batch: pa.RecordBatch):
        texts = batch.column("text").to_pylist()
        said = [bool(t and langs and _LETTER.search(t)) for t in texts]
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        at, grams, cells = [], [], 0
        for j, text in enumerate(texts):
            if said[j]:
                at.append(j)
                grams.append(trigrams(text))
                cells += len(langs) * min(BUCKETS, len(grams[-1]))
            if at and (cells > CELLS or len(at) == TOGETHER or j == len(texts) - 1):
                for k, b, s in zip(at, *(x.tolist() for x in mixtures(grams, model)), strict=True):
                    names[k], scores[k] = langs[b], min(1.0, max(0.0, s))
                at, grams, cells = [], [], 0
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    found = map_texts(docs, ["doc_id", "text"], "doc_id long, lang_pred string, score double", each)
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "documents"))
