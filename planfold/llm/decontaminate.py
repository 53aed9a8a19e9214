"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items; each text is scanned once.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z. A window is 10 consecutive words of an item; an item of fewer words, but
not none, is one window. A document word inside any occurrence of a window is hit.

The automaton is broadcast, so its size is checked: item texts are summed first, and beyond BLOCK_CHARS they go into several
automata of about that size (items by a hash). Then the findings of one automaton are written before the items of the next come to
the driver, and merged by document in the end.

Defined results: null text has no words; items without words match nothing; equal items are each found; rows that repeat a doc_id
are reported one by one. Extra columns are ignored by contamination() and kept by drop_contaminated()."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planfold.llm.common import map_texts, raw_texts, table, without, written

WINDOW = 10
#: Characters of items in one automaton (about 100 bytes of memory each).
BLOCK_CHARS = 4_000_000
#: A-Z lower-cased, separators blank, all else kept (bytes from 0x80 up belong to words).
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_automata: dict[str, tuple] = {}


def plain_words(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


def _automaton(key: str, items: list[tuple[int, str]]) -> tuple:
    """The automaton over ' w1 w2 ... ' and, for each window, its length in words and its items. Built once in a worker."""
    import ahocorasick

    if key not in _automata:
        windows: dict[str, tuple[int, set]] = {}
        for item_id, text in items:
            words = [w.decode() for w in plain_words((text or "").encode())]
            for i in range(max(1, len(words) - WINDOW + 1) if words else 0):
                part = words[i : i + WINDOW]
                windows.setdefault(f" {' '.join(part)} ", (len(part), set()))[1].add(item_id)
        machine = ahocorasick.Automaton()
        for window, found in windows.items():
            machine.add_word(window, found)
        if windows:
            machine.make_automaton()
        _automata.clear()
        _automata[key] = (machine, bool(windows))
    return _automata[key]


def _scan(items: list[tuple[int, str]]):
    """For each text: number of words, hit words as [first, last) word ranges, items found."""
    key = hashlib.sha256(repr(items).encode()).hexdigest()

    def each(batch: pa.RecordBatch):
        machine, any_ = _automaton(key, items)
        n, ranges, found = [], [], []
        for text in raw_texts(batch):
            words = plain_words(text)
            n.append(len(words))
            hits, of = [], set()
            if words and any_:
                joined = f" {b' '.join(words).decode()} "
                ends = [(end, *value) for end, value in machine.iter(joined)]
                if ends:
                    # the scan's offsets are mapped to words by the blanks before them
                    blanks = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le"), np.uint32) == 32)
                    last = 0
                    for end, size, ids in ends:
                        stop = int(np.searchsorted(blanks, end))
                        of |= ids
                        if hits and stop - size <= last:
                            while hits and hits[-1][0] > stop - size:
                                hits.pop()
                            if hits and hits[-1][1] >= stop - size:
                                hits[-1] = (hits[-1][0], stop)
                            else:
                                hits.append((stop - size, stop))
                        else:
                            hits.append((stop - size, stop))
                        last = stop
            ranges.append([{"a": a, "b": b} for a, b in hits])
            found.append(sorted(of))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(n, pa.int64()), pa.array(ranges, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "row", "n_words", "ranges", "items"])

    return each


def _item_blocks(benchmark: DataFrame, block_chars: int):
    """(blocks, a function from a block's number to its items): blocks of block_chars characters at most, about."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = -(-chars // block_chars) or 1
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    return blocks, lambda k: [tuple(r) for r in dealt.where(F.col("block") == k).select("item_id", "text").orderBy("item_id", "text").collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> doc_id, n_words, n_hit, n_items, items_sha256, contaminated, ranges, items."""
    schema = "doc_id long, row long, n_words long, ranges array<struct<a: int, b: int>>, items array<long>"
    blocks, items = _item_blocks(benchmark, block_chars)
    if blocks == 1:
        found = map_texts(docs.withColumn("row", F.lit(0).cast("long")), ["doc_id", "row", "text"], schema, _scan(items(0)))
    else:
        rows, found = docs.withColumn("row", F.xxhash64("text")), None
        for k in range(blocks):
            part = written(map_texts(rows, ["doc_id", "row", "text"], schema, _scan(items(k))))
            found = part if found is None else found.union(part)
        # equal rows (same doc_id and text) stay apart: each block reports each of them once
        found = found.groupBy("doc_id", "row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("ranges"))).alias("ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.count(F.lit(1)).alias("copies"))
        found = found.withColumn("again", F.explode(F.expr(f"sequence(1, cast(copies / {blocks} as int))")))
    hit = "aggregate(ranges, named_struct('n', 0L, 'to', 0), (s, r) -> named_struct('n', s.n + greatest(0, r.b - greatest(r.a, s.to)), 'to', greatest(s.to, r.b)), s -> s.n)"
    ids = "array_join(array_sort(transform(items, i -> cast(i as string))), ',')"
    return found.selectExpr("doc_id", "n_words", f"{hit} as n_hit", "cast(size(items) as long) as n_items", f"sha2({ids}, 256) as items_sha256", "size(items) > 0 as contaminated", "ranges", "items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a window of the benchmark."""
    return without(docs, contamination(docs, benchmark).where("contaminated"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
