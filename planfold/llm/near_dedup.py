"""Near-duplicate documents: MinHash bands give candidates, sequential Bayesian comparison of signature batches prunes them,
and the survivors are confirmed on their full shingle sets.

Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; a document's set holds its distinct five-word shingles (fewer words: the whole
sequence as one). Documents are linked when 100 * |A n B| >= 75 * |A u B|.

Copies never meet in pairs: documents with equal sets form a class, whose smallest doc_id stands for it. Between classes, a document
is compared with the most central one of its buckets (that shares the most buckets with others); then, in buckets that still hold
several components, with their smallest and largest member; then the members outside the component of the smallest one with all members of other components. A pair that shares no band is
missed with probability (1 - s**BAND_ROWS)**BANDS, 5e-6 at s = 0.75.

Defined results: null or empty text, or one without words: n_shingles 0, alone, kept. Rows that repeat a doc_id are one document
whose links are the union of theirs. Extra columns are ignored by near_duplicates() and kept by drop_near_duplicates()."""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planfold.llm.common import LOWER, cut, few, map_texts, raw_texts, table, without, written
from planfold.llm.graph import components

SHINGLE, PERCENT = 5, 75
BANDS, BAND_ROWS = 32, 4
HASHES = BANDS * BAND_ROWS
#: Signature bits kept of each hash for the Bayesian comparison, and hashes compared in a batch.
BITS, BATCH = 4, 32
#: Chance at which a candidate may be given up though it is similar enough.
MISS = 1e-6
#: Rounds of comparisons with the ends of buckets, and pairs a document from which a round takes one for each.
ROUNDS, MANY = 8, 8
#: Members of a bucket that one task compares with the others, about.
SLOT = 2_000
_M = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _tables() -> tuple[np.ndarray, int, int, np.ndarray, np.ndarray]:
    """Random values of bytes, an odd base with its inverse modulo 2**64, and the hash functions."""
    r = np.random.RandomState(20240607)
    draw = lambda n: _mixed(r.randint(0, 2**62, n).astype(np.uint64) * np.uint64(4) + np.arange(n, dtype=np.uint64))
    base = 0x9E3779B97F4A7C15 | 1
    return draw(256), base, pow(base, -1, 2**64), draw(HASHES) | np.uint64(1), draw(HASHES)


_powers: dict[int, np.ndarray] = {}
#: Powers that a worker keeps; longer texts make their own and let them go.
KEPT_POWERS = 1 << 20


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(min(max(n, 4096) * 2, max(n, KEPT_POWERS)), base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if len(have) <= KEPT_POWERS:
            _powers[base] = have
    return have[:n]


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles. A shingle is a stretch of the text whose words are joined by one
    space, so all of them come from prefix sums of byte values times powers of an odd base."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    values, base, inverse, _, _ = _tables()
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(SHINGLE, len(words))
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(values[np.frombuffer(joined, np.uint8)] * _power(base, len(joined)), out=sums[1:])
    s, e = starts[: len(words) - k + 1], ends[k - 1 :]
    return np.unique(_mixed((sums[e] - sums[s]) * _power(inverse, len(joined))[s] + (e - s).astype(np.uint64)))


def signature(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one bucket id for each band, BITS bits of each MinHash value packed into longs)."""
    _, _, _, a, b = _tables()
    low = np.full(HASHES, _M, np.uint64)
    for i in range(0, len(h), 1024):
        np.minimum(low, (a[:, None] * h[None, i : i + 1024] + b[:, None]).min(axis=1), out=low)
    low = _mixed(low)
    bucket = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in low.reshape(BANDS, BAND_ROWS).T:
        bucket = _mixed(bucket * np.uint64(0x9E3779B97F4A7C15) + column)
    per = 64 // BITS
    nibbles = (low & np.uint64(2**BITS - 1)).reshape(-1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))
    return bucket.view(np.int64), np.bitwise_or.reduce(nibbles, axis=1).view(np.int64)


def _lists(rows: list[np.ndarray | None]) -> pa.Array:
    sizes = [0 if x is None else len(x) for x in rows]
    full = [x for x in rows if x is not None and len(x)]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(full) if full else np.empty(0, np.int64)))


def _sketches(batch: pa.RecordBatch):
    n, k1, k2, buckets, codes = [], [], [], [], []
    for text in raw_texts(batch):
        h = shingle_set(text)
        n.append(len(h))
        if len(h):
            with np.errstate(over="ignore"):
                x, y = _mixed(h), _mixed(h + np.uint64(0x632BE59BD9B4E019))
                pair = np.array([x.sum(dtype=np.uint64), y.sum(dtype=np.uint64)], np.uint64).view(np.int64)
            bucket, code = signature(h)
        else:
            pair, bucket, code = (None, None), None, None
        for to, x in ((k1, pair[0]), (k2, pair[1]), (buckets, bucket), (codes, code)):
            to.append(x)
    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), _lists(buckets), _lists(codes)], names=["doc_id", "n_shingles", "k1", "k2", "buckets", "codes"])


def _sets(batch: pa.RecordBatch):
    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists([shingle_set(t).view(np.int64) for t in raw_texts(batch)])], names=["node", "shingles"])


@cache
def least_matches() -> list[int]:
    """For each number of hashes compared (BATCH, 2 * BATCH, ...), the fewest matches with which similarity may still reach the
    threshold: below, its posterior probability (uniform prior; a match has probability s + (1 - s) / 2**BITS) is under MISS."""
    grid = [(i + 0.5) / 2000 for i in range(2000)]
    found = []
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            logs = [m * math.log(p := s + (1 - s) / 2**BITS) + (n - m) * math.log(1 - p) for s in grid]
            top = max(logs)
            weights = [math.exp(x - top) for x in logs]
            if sum(w for s, w in zip(grid, weights, strict=True) if s >= PERCENT / 100) >= MISS * sum(weights):
                found.append(m)
                break
    return found


def _may_link(a: str, b: str, last_only: bool = False) -> str:
    """SQL condition on two rows with n_shingles and the codes as columns c0, c1, ...: sizes allow the threshold, and no batch of the signature rules it out (last_only: the whole signature doesn't)."""
    per, said = 64 // BITS, [f"100 * least({a}.n_shingles, {b}.n_shingles) >= {PERCENT} * greatest({a}.n_shingles, {b}.n_shingles)"]
    differ = []
    for i in range(HASHES // per):
        x = f"({a}.c{i} ^ {b}.c{i})"
        pairs = f"({x} | shiftrightunsigned({x}, 1))"
        differ.append(f"bit_count(({pairs} | shiftrightunsigned({pairs}, 2)) & 1229782938247303441L)")
    for k, least in list(enumerate(least_matches(), 1))[-1 if last_only else 0 :]:
        said.append(f"{k * BATCH} - ({' + '.join(differ[: k * BATCH // per])}) >= {least}")
    return " and ".join(said)


def _sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, shingles) of the documents in ids(doc_id). The ids are counted and, if they are few, sent to the scan; beyond, the texts
    are joined by a shuffle."""
    return map_texts(docs.join(few(cut(ids.distinct())), "doc_id", "left_semi"), ["doc_id", "text"], "node long, shingles array<long>", _sets)


#: SQL: are the sets of rows x and y similar enough? 100 * c >= PERCENT * (|x| + |y| - c), with c common shingles.
_SIMILAR = f"{100 + PERCENT} * size(array_intersect(x.shingles, y.shingles)) >= {PERCENT} * (size(x.shingles) + size(y.shingles))"


def _confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs(a, b) whose full sets are similar enough. Only documents in a pair are shingled again."""
    sets = _sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.struct("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.struct("shingles").alias("y")), "b")
    return both.where(_SIMILAR).select("a", "b")  # components() makes them distinct: here that would tie them to the join's tasks


def _open_buckets(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members, with their components, of the buckets that still hold several; first and last: the components of low and high."""
    placed = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ends = [F.max(F.when(F.col("node") == F.col(x), F.col("component"))).alias(y) for x, y in (("low", "first"), ("high", "last"))]
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most"), *ends).where("least < most").drop("least", "most")
    return placed.join(written(mixed).hint("merge"), "bucket")


def _dealt(x: DataFrame, y: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join by bucket with a slot to join by as well: large buckets of x are dealt over slots of about SLOT rows, and
    each of their rows of y goes to all of those slots."""
    slots = written(x.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / SLOT).alias("slots"))).hint("merge")
    dealt = x.join(slots, "bucket").withColumn("slot", F.pmod(F.xxhash64("node"), "slots")).drop("slots")
    return dealt, y.join(slots, "bucket").withColumn("slot", F.explode(F.expr("sequence(0L, slots - 1)"))).drop("slots")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> one row for each row of docs: doc_id, n_shingles, component_id, kept."""
    docs = docs.select("doc_id", "text")
    sketches = written(map_texts(docs, ["doc_id", "text"], "doc_id long, n_shingles long, k1 long, k2 long, buckets array<long>, codes array<long>", _sketches))
    full = sketches.where("n_shingles > 0")
    classes = full.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"))
    nodes = written(full.join(classes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "n_shingles", "codes", "buckets"))
    dealt = nodes.select("node", F.explode("buckets").alias("bucket"))
    shared = dealt.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
    # what is known of buckets is written before it meets their members, so that Spark splits the large ones in the join
    members = written(dealt.join(written(shared).hint("merge"), "bucket"))
    # longs of their own, as tests read them often
    code_columns = [F.col("codes")[i].alias(f"c{i}") for i in range(HASHES * BITS // 64)]
    codes = nodes.select("node", F.struct("n_shingles", *code_columns).alias("code"))

    def compared(pairs: DataFrame) -> DataFrame:
        """Links among pairs(a, b): first by signature batches, then on full sets."""
        left = pairs.join(codes.select(F.col("node").alias("a"), F.col("code").alias("x")), "a")
        likely = left.join(codes.select(F.col("node").alias("b"), F.col("code").alias("y")), "b").where(F.expr(_may_link("x", "y"))).select("a", "b")
        return written(_confirmed(docs, written(likely)))

    # 1. Each document with the most central one of its buckets: one pair a document gathers groups of any size.
    central = members.groupBy("node").agg(F.sum("n").alias("degree"))
    hubs = members.join(central, "node").groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("node")).alias("k"))).alias("hub"))
    nearest = members.join(written(hubs).hint("merge"), "bucket").where("node <> -hub.k").groupBy("node").agg((-F.max("hub")["k"]).alias("hub"))
    tried = cut(nearest.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct())
    found = components(compared(tried))
    # 2. In buckets that still hold several components, their smallest and their largest member with all outside its component: one
    #    pair a document and round while there are many, so that what a round joins needs no more pairs; then all of them.
    ends = "filter(array(struct(least(low, node) as a, greatest(low, node) as b, first as c), struct(least(high, node) as a, greatest(high, node) as b, last as c)), p -> p.a < p.b and p.c <> component)"
    for round_ in range(ROUNDS):
        stars = _open_buckets(members, found).select("node", F.inline(F.expr(ends))).select("node", "a", "b").distinct()
        stars = cut(stars.join(tried, ["a", "b"], "left_anti"))
        n, nodes_left = stars.agg(F.count(F.lit(1)), F.approx_count_distinct("node")).first()
        if not n:
            break
        many = n > MANY * nodes_left and round_ < ROUNDS - 1
        batch = stars.groupBy("node").agg(F.min(F.struct(F.xxhash64("a", "b"), "a", "b")).alias("p")).select("p.a", "p.b") if many else stars.select("a", "b")
        batch = cut(batch.distinct())
        found, tried = _joined(found, compared(batch)), tried.union(batch)
        if not many:
            break
    # 3. What the ends left: members outside the first component with members of all other components. Such pairs can be many and
    #    links few, so pairs are never rows: first each member looks whether its bucket has a partner that the signature allows, then
    #    only those members get their sets, and the join itself tests these. A pair is tested in the first bucket it shares.
    open_ = _open_buckets(members, found).where("n > 2 and node <> low and node <> high").select("bucket", "node", "component", "first")
    open_ = written(open_.join(nodes, "node").select("bucket", "node", "component", "first", "n_shingles", "buckets", F.array_position("buckets", F.col("bucket")).alias("band"), *code_columns))
    alone = open_.where("component <> first")
    apart = "x.bucket = y.bucket and x.slot = y.slot and x.component <> y.component and (y.component = x.first or x.node < y.node)"
    test = F.expr(f"{apart} and {_may_link('x', 'y')}")
    some, all_ = _dealt(alone, open_)
    near = some.alias("x").join(all_.alias("y"), test, "left_semi").union(all_.alias("y").join(some.alias("x"), test, "left_semi"))
    near = cut(near.select("bucket", "node").distinct())
    if not near.isEmpty():
        sets = written(_sets_of(docs, near.select(F.col("node").alias("doc_id"))))
        full = written(open_.join(near, ["bucket", "node"]).join(sets, "node"))
        some, all_ = _dealt(full.where("component <> first"), full)
        # short, as the JVM compiles no long methods: the whole signature at once, the first shared band, the sets
        once = "array_position(zip_with(x.buckets, y.buckets, (p, q) -> p = q), true) = x.band"
        full_test = F.expr(f"{apart} and {_may_link('x', 'y', last_only=True)} and {once} and {_SIMILAR}")
        links = some.alias("x").join(all_.alias("y"), full_test).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
        found = _joined(found, written(links.distinct()))
    places = classes.join(found, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("component_id"))
    out = sketches.select("doc_id", "n_shingles", "k1", "k2").join(places, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links."""
    return found if links.isEmpty() else components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one document of each group: the one with the smallest doc_id. Rows without doc_id stay."""
    return without(docs, near_duplicates(docs).where("not kept"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
