"""SimHash near-duplicates: documents whose 64-bit fingerprints differ in two bits at most are linked.

A-Z are lower-cased; words are [^\\x20\\x09-\\x0D]+; features are three-word shingles, repeats included, joined by a blank (fewer words: the
whole sequence). A bit of the fingerprint is 1 if it is set in over half of the shingles' XXH64 (seed 42).

Only distinct fingerprints are compared. Two within two bits agree in at least two of four 16-bit fields, so each fingerprint goes to six
buckets, by the 32 bits of two fields. A bucket of more than FULL members is split again: its members still differ in two of the free
bits at most, so they agree in one of three parts of these, and go to three smaller buckets by that part; and so on. With FREE free bits
or fewer a bucket can't be full, so all are bounded and no pair is lost.

Comparison is bit-sliced: a bucket's members lie side by side, bit p of 64 members in one word of plane p. Shifted by s members, exclusive
or and a carry-save counter of two bit planes and an overflow plane compare 64 pairs at once; words whose pairs are all over the radius are left out of the rest. Of
a bucket's links only a spanning forest is put out.

Defined results: null and empty texts, and those without words, have fingerprint zero and are linked like any other. Rows that repeat a
doc_id each have their own fingerprint; a null doc_id is never a component's id, and a component without any other has null. Extra
columns are ignored."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planfold.llm.common import LOWER, map_texts, raw_texts, table, without, written
from planfold.llm.graph import components

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Members from which a bucket is split, and free bits at which it can't have more.
FULL, FREE = 1024, 10
#: Bytes of a text whose shingles are hashed at once, and members that are laid side by side, about.
PIECE, LANES = 1 << 20, 1 << 15
_FULL_WORD = np.uint64(0xFFFFFFFFFFFFFFFF)


def _pieces(text: bytes):
    """A text in pieces that end behind a word, with the last words of each also before the next."""
    if len(text) <= PIECE:
        yield text.split()
        return
    at, before = 0, []
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = before + text[at:end].split()
        yield words
        before, at = words[-(SHINGLE - 1) :], end


def fingerprint(text: bytes) -> int:
    """Of a text in UTF-8."""
    import xxhash

    n, ones, few = 0, np.zeros(64, np.int64), []
    digest = xxhash.xxh64_intdigest
    for words in _pieces(text.translate(LOWER)):
        if len(words) >= SHINGLE:
            h = np.array([digest(b"%b %b %b" % t, SEED) for t in zip(words, words[1:], words[2:], strict=False)], "<u8")
            n += len(h)
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        few = words if n == 0 else few
    if n == 0:
        if not few:
            return 0
        return digest(b" ".join(few), SEED)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batch: pa.RecordBatch):
    found = np.array([fingerprint(t) for t in raw_texts(batch)], np.uint64)
    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def _fields(mask: int, parts: int) -> list[int]:
    """The bits of a mask in `parts` runs of about equal length."""
    bits = [i for i in range(64) if mask >> i & 1]
    return [sum(1 << int(i) for i in run) for run in np.array_split(bits, parts)]


#: Bits by which the first buckets are made: each pair of the four fields.
FIRST = [a | b for a, b in combinations(_fields((1 << 64) - 1, 4), RADIUS)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _dealt(members: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
    """members(agreed, fp) -> (agreed, key, fp): for each mask of bits agreed so far the buckets of the wider masks it leads to."""
    wider = F.coalesce(*(F.when(F.col("agreed") == _signed(m), F.array(*(F.lit(_signed(w)).cast("long") for w in wide))) for m, wide in masks.items()))
    return members.select("fp", F.explode(wider).alias("agreed")).select("agreed", F.col("fp").bitwiseAND(F.col("agreed")).alias("key"), "fp")


def lanes(fps: np.ndarray, planes: list[int]) -> np.ndarray:
    """Bit planes of fingerprints: a row of words for each plane, 64 members to a word, with a word of zeros behind."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, planes]
    padded = np.zeros((len(planes), 64 * (-(-len(fps) // 64) + 1)), np.uint8)
    padded[:, : len(fps)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def _shifted(row: np.ndarray, words: np.ndarray, s: int) -> np.ndarray:
    """The given words of a plane that is shifted down by s members; zeros come in at the end."""
    q, r = divmod(s, 64)
    last = row.shape[-1] - 1
    low = row[np.minimum(words + q, last)]
    if not r:
        return low
    return low >> np.uint64(r) | row[np.minimum(words + q + 1, last)] << np.uint64(64 - r)


def close_pairs(fps: np.ndarray, bucket: np.ndarray, planes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """fps side by side, the buckets in falling order of size, and planes that may differ -> pairs (i, j), i < j, of a bucket within RADIUS."""
    rows = lanes(fps, planes)
    sizes = np.bincount(bucket)
    left, right = [], []
    for s in range(1, int(sizes.max(initial=0))):
        active = int(sizes[sizes > s].sum())  # these members come first
        valid = np.zeros(64 * -(-active // 64), np.uint8)
        end = min(active, len(fps) - s)
        valid[:end] = bucket[:end] == bucket[s : s + end]
        alive = np.packbits(valid, bitorder="little").view("<u8")
        words = np.flatnonzero(alive)
        alive = alive[words]
        one = two = over = np.zeros(len(words), np.uint64)
        for k in range(0, len(planes), 2):
            a = rows[k][words] ^ _shifted(rows[k], words, s)
            b = rows[k + 1][words] ^ _shifted(rows[k + 1], words, s) if k + 1 < len(planes) else np.zeros_like(a)
            # a full adder takes a, b and the ones; its carry goes to the twos; three and more are over
            half = a ^ b
            carry = a & b | one & half
            one = one ^ half
            over = over | two & carry
            two = two ^ carry
            over = over | two & one
            if k % 8 == 6:
                stay = np.flatnonzero(alive & ~over)
                if not len(stay):
                    words = words[:0]
                    break
                if len(stay) < len(words):
                    words, alive, one, two, over = words[stay], alive[stay], one[stay], two[stay], over[stay]
        if len(words):
            hits = np.unpackbits((alive & ~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            w, bit = np.nonzero(hits)
            left.append(words[w] * 64 + bit)
            right.append(left[-1] + s)
    none = np.empty(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member that each of n members reaches over the links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        for ends in (i, j, label[i], label[j]):
            np.minimum.at(new, ends, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(batch: pa.RecordBatch):
    """(a, b) fingerprints linked, of rows (agreed, fps)."""
    agreed = batch.column("agreed").to_numpy()
    sizes = np.diff(batch.column("fps").offsets.to_numpy())
    fps = batch.column("fps").flatten().to_numpy().view(np.uint64)
    starts = np.cumsum(sizes) - sizes
    for mask in np.unique(agreed):
        planes = [p for p in range(64) if not int(mask) >> p & 1]
        mine = np.flatnonzero(agreed == mask)
        mine = mine[np.argsort(-sizes[mine], kind="stable")]
        group = 0
        while group < len(mine):
            last = group + max(1, int(np.searchsorted(np.cumsum(sizes[mine[group:]]), LANES, "right")))
            some = mine[group:last]
            n = sizes[some]
            at = np.repeat(starts[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
            here = fps[at]
            i, j = close_pairs(here, np.repeat(np.arange(len(some)), n), planes)
            root = forest(len(here), i, j)
            far = np.flatnonzero(root != np.arange(len(here)))
            if len(far):
                yield pa.RecordBatch.from_arrays([pa.array(here[far].view(np.int64)), pa.array(here[root[far]].view(np.int64))], names=["a", "b"])
            group = last


def linked(fps: DataFrame) -> DataFrame:
    """fps(fp), distinct -> (a, b): links that lead from each fingerprint to all that it reaches within RADIUS bits."""
    members, masks, found = fps.select(F.lit(0).cast("long").alias("agreed"), "fp"), {0: FIRST}, None
    while True:
        dealt = _dealt(members, masks)
        sizes = dealt.groupBy("agreed", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sizes = written(sizes)
        free = 64 - min(w.bit_count() for wide in masks.values() for w in wide)
        full = f"n > {FULL}" if free > FREE else "false"
        # only members of buckets with several travel to their bucket
        some = dealt.join(sizes.where(f"not ({full})").hint("merge"), ["agreed", "key"])
        buckets = some.groupBy("agreed", "key").agg(F.collect_set("fp").alias("fps"))
        links = written(map_texts(buckets, ["agreed", "fps"], "a long, b long", _links, 4096).distinct())
        found = links if found is None else found.union(links)
        if free <= FREE or sizes.where(full).isEmpty():
            return found
        members = written(dealt.join(sizes.where(full).hint("merge"), ["agreed", "key"]).select("agreed", "fp").distinct())
        wider = [w for wide in masks.values() for w in wide]
        masks = {w: [w | part for part in _fields(~w & (1 << 64) - 1, RADIUS + 1)] for w in wider}


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> one row for each row of docs: doc_id, fingerprint, component_id."""
    prints = written(map_texts(docs, ["doc_id", "text"], "doc_id long, fp long", _fingerprints))
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(linked(nodes.select("fp")))
    placed = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    places = placed.join(written(lowest).hint("merge"), "root").select("fp", "component_id")
    return prints.join(written(places).hint("merge"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: the one with the smallest doc_id. Rows without doc_id stay."""
    return without(docs, near_duplicates(docs).where("doc_id <> component_id"))


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
