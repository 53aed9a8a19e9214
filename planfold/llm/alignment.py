"""Cross-tokenizer alignment: how the tokens of tokenizer A (byte-level BPE) and B (piece BPE with byte fallback) of one text overlap, and in
how many documents of the corpus each pair of ids does.

Method. The distinct id pairs of the corpus get places 0 .. n-1 by a minimal perfect hash: they are dealt over shards by a hash, and each
shard searches displacements (pilots) for its buckets until every key has a place of its own; the key itself is kept at its place, so a
lookup verifies it. Each task adds up a dense vector of document counts, indexed by place; the vectors are summed as a tree. A second
pass aligns the documents again and looks the counts up. Hash, keys and counts are sent to the tasks for SLICE_KEYS pairs at a time; with
more pairs there is a pass for each slice, whose results are added.

Alignment works on chunks: runs of a text that begin with a blank or line end after a plain character and before one that isn't blank.
Neither tokenizer ever joins such a blank to what stands before it (A's pattern cuts there, no piece of B has a blank behind another
character, or a line end), so ids, groups and links of a chunk don't depend on its neighbours, and a worker remembers those of chunks that recur.
Whatever else the text holds stays inside its chunk, up to the whole text.

Defined results: each row is a document, also where doc_id repeats or is null. Texts null, empty, or whose tokens' joined bytes differ
from blank + text (a text with U+2581, say) have zeros and no groups. Extra columns are ignored."""

from __future__ import annotations

import hashlib
import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planfold.llm.common import map_texts, raw_texts, table, written
from planfold.llm.sums import summed

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs whose hash, keys and counts are sent to the tasks at a time (about 22 bytes each), and pairs in a shard, about.
SLICE_KEYS, SHARD_KEYS = 4_000_000, 40_000
#: Keys in a bucket, about, and pilots tried at once.
LOAD, TRIES = 3, 256
#: An id pair as one long: A's id above, B's id in the low bits.
B_BITS = 24
#: Chunks that a worker remembers, at most; bytes up to which a chunk is encoded together with others.
REMEMBERED, IN_A_ROW = 700_000, 200
#: Bytes of text, and rows, that are aligned at once, about; a text is never split.
PIECE, ROWS = 12 << 20, 4000

_SEED, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: one to one."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (_mixed(keys.astype(np.uint64) ^ _SEED) % np.uint64(shards)).astype(np.int64)


class PairHash:
    """Minimal perfect hash of one shard's keys: pilots by bucket and the keys by place."""

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        buckets = max(1, -(-n // LOAD))
        h = _mixed(keys.astype(np.uint64))
        of = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        sizes = np.bincount(of, minlength=buckets)
        starts = np.cumsum(sizes) - sizes
        self.pilots, self.keys, taken = np.zeros(buckets, np.int32), np.empty(n, np.int64), np.zeros(n, bool)
        by_size = np.argsort(-sizes, kind="stable")
        for bucket in by_size[: np.count_nonzero(sizes > 1)]:
            who = order[starts[bucket] : starts[bucket] + sizes[bucket]]
            pilot = 0
            while True:
                at = _places(h[who][None, :], np.arange(pilot, pilot + TRIES, dtype=np.uint64)[:, None], n)
                free = ~taken[at].any(axis=1)
                for i in np.flatnonzero(free):
                    if len(set(at[i].tolist())) == len(who):
                        break
                else:
                    pilot += TRIES
                    continue
                break
            self.pilots[bucket], taken[at[i]], self.keys[at[i]] = pilot + i, True, keys[who]
        # keys alone in their bucket take the places that are left, named as -1 - place
        alone = by_size[sizes[by_size] == 1]
        left = np.flatnonzero(~taken)
        self.pilots[alone], self.keys[left] = -1 - left, keys[order[starts[alone]]]


def _places(h: np.ndarray, pilots: np.ndarray, n) -> np.ndarray:
    return (_mixed(h ^ (pilots + np.uint64(1)) * _STEP) % np.uint64(n) if np.isscalar(n) else _mixed(h ^ (pilots + np.uint64(1)) * _STEP) % n).astype(np.int64)


class PairIndex:
    """The hashes of several shards as one: keys -> places 0 .. n-1, or -1 for keys that are not among them."""

    def __init__(self, rows: list, shards: int):
        rows = sorted(rows, key=lambda r: r.shard)
        self.shards = shards
        pilots, keys = [np.frombuffer(r.pilots, np.int32) for r in rows], [np.frombuffer(r["keys"], np.int64) for r in rows]
        none = np.empty(0, np.int64)
        self.pilots, self.keys = np.concatenate([none.astype(np.int32), *pilots]), np.concatenate([none, *keys])
        here = np.array([r.shard for r in rows], np.int64)
        self.n, self.buckets, self.first, self.first_pilot = (np.zeros(shards, np.int64) for _ in range(4))
        self.n[here], self.buckets[here] = [len(x) for x in keys], [len(x) for x in pilots]
        self.first, self.first_pilot = np.cumsum(self.n) - self.n, np.cumsum(self.buckets) - self.buckets

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        shard = shard_of(keys, self.shards)
        known = np.flatnonzero(self.n[shard] > 0)
        if len(known):
            k, s = keys[known], shard[known]
            h = _mixed(k.astype(np.uint64))
            pilot = self.pilots[self.first_pilot[s] + (h % self.buckets[s].astype(np.uint64)).astype(np.int64)].astype(np.int64)
            hashed = _places(h, np.maximum(pilot, 0).astype(np.uint64), self.n[s].astype(np.uint64))
            at = self.first[s] + np.where(pilot < 0, -1 - pilot, hashed)
            out[known] = np.where(self.keys[at] == k, at, -1)
        return out


def _byte_of() -> dict[str, int]:
    """The characters by which byte-level BPE writes bytes; those that print stand for themselves, the others follow from
    U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Aligner:
    """Aligns texts by their chunks. What a chunk has is kept by its number: tokens of both kinds, groups, where its links (pairs, repeats
    included) and its groups as text begin. A chunk whose tokens' joined bytes are not its own counts -1 tokens. Chunks met for the
    first time go through both tokenizers together."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a process for each core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = _byte_of()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if max(len(self.bytes_a), len(self.bytes_b)) > 10**7:
            raise ValueError("ids of more than seven digits")
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.cuts = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        self.prefix = self.b.piece_to_id("▁")
        self.ranks = self._ranks(path_a)
        # ids as text, eight bytes each, padded with zeros; behind them a comma, or what ends a group's side
        digits = [str(i).encode() for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.said_as = {c: np.array([d + c for d in digits], "S8").view("<u8") for c in (b",", b"|", b";")}
        self.forget()

    def _ranks(self, path: str):
        """The faster encoder with A's vocabulary, where A's ids are the order of its merges; else None, and A encodes all."""
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        merges = [m if isinstance(m, list) else m.split(" ") for m in said["model"].get("merges", [])]
        vocabulary = said["model"]["vocab"]
        plain = said["pre_tokenizer"].get("type") == "ByteLevel" and said["pre_tokenizer"].get("use_regex") and not said["pre_tokenizer"].get("add_prefix_space") and not said.get("normalizer")
        if not plain or sorted(vocabulary.values())[: 256 + len(merges)] != list(range(256 + len(merges))) or any(vocabulary[x + y] != 256 + k for k, (x, y) in enumerate(merges)):
            return None
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks={self.bytes_a[i]: i for i in range(256 + len(merges))}, special_tokens={})

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.said: list[bytes] = []
        self.counts = np.zeros((0, 4), np.int64)
        self.links = np.empty(0, np.int64)

    def chunk_starts(self, b: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Bytes of blank + text, in a row, and where each begins -> starts of chunks. Behind a text's last byte comes the next one's blank."""
        start = np.zeros(len(b), bool)
        if self.cuts and len(b) > 2:
            plain = (b > 32) & (b < 127)
            plain[1:] |= (b[:-1] == 0xC3) & (b[1:] >= 0x80)
            start[1:-1] = ((b[1:-1] == 32) | (b[1:-1] == 10)) & plain[:-2] & (b[2:] > 32)
        start[firsts] = True
        return np.flatnonzero(start)

    def _one_by_one(self, chunks: list[bytes]) -> list[tuple[list[int], list[int]] | None]:
        """Ids by A and by B, or None where their bytes are not the chunk. B sets a blank before what it encodes: it takes the place of the
        chunk's own, or goes if that is a line end."""
        texts = [c.decode() for c in chunks]
        out = []
        for c, x, ib in zip(chunks, self.a.encode_batch_fast(texts, add_special_tokens=False), self.b.encode([t if t[0] == "\n" else t[1:] for t in texts], num_threads=1), strict=True):
            if c[0] == 10:
                ib = ib[1:] if ib[:1] == [self.prefix] else []
            same = len(c) > 1 and b"".join(map(self.bytes_a.__getitem__, x.ids)) == c and b"".join(map(self.bytes_b.__getitem__, ib)) == c
            out.append((x.ids, ib) if same else None)
        return out

    def _in_a_row(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A's ids, number of them by chunk, B's ids, number of them, which chunks are good) of chunks that end with a plain character: as
        one text. If its bytes don't come out or a token crosses chunks, halves of them; a few are encoded one by one."""
        said = b" a" + b"".join(chunks)
        text = said.decode()
        a, b = self.ranks.encode_to_numpy(text, disallowed_special=()).astype(np.int64), np.array(self.b.encode(text[1:]), np.int64)
        ends, at = 2 + np.cumsum([0, *map(len, chunks)]), []
        for ids, lengths, parts in ((a, self.length_a, self.bytes_a), (b, self.length_b, self.bytes_b)):
            stops = np.cumsum(lengths[ids])
            place = np.searchsorted(stops, ends)
            if stops[-1] == len(said) and (stops[place] == ends).all() and b"".join(map(parts.__getitem__, ids.tolist())) == said:
                at.append(place + 1)
        if len(at) == 2:
            return a[at[0][0] :], np.diff(at[0]), b[at[1][0] :], np.diff(at[1]), np.ones(len(chunks), bool)
        if len(chunks) > 32:
            halves = [self._in_a_row(c) for c in (chunks[: len(chunks) // 2], chunks[len(chunks) // 2 :])]
            return tuple(np.concatenate(x) for x in zip(*halves, strict=True))
        return self._flat(self._one_by_one(chunks))

    @staticmethod
    def _flat(found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids = [[x[k] if x else [] for x in found] for k in (0, 1)]
        (a, n_a), (b, n_b) = ((np.array(list(chain.from_iterable(x)), np.int64), np.array([len(i) for i in x], np.int64)) for x in ids)
        return a, n_a, b, n_b, np.array([x is not None for x in found], bool)

    def learn(self, chunks: list[bytes]) -> None:
        """All chunks in a row: two tokens overlap in one stretch without ends inside, so the stretches between neighbouring ends of
        tokens are the links; groups end where tokens of both kinds do, as chunks do."""
        closed = [self.ranks is not None and 1 < len(c) <= IN_A_ROW and c[1] > 32 and (32 < c[-1] < 127 or c[-1] >= 128 and c[-2] == 0xC3) for c in chunks]
        chunks = [c for c, x in zip(chunks, closed, strict=True) if x] + [c for c, x in zip(chunks, closed, strict=True) if not x]
        n = sum(closed)
        parts = [self._in_a_row(chunks[:n])] if n else []
        parts += [self._flat(self._one_by_one(chunks[n:]))] if n < len(chunks) else []
        a, n_a, b, n_b, good = (np.concatenate(x) for x in zip(*parts, strict=True))
        at = np.flatnonzero(good).tolist()
        n_a, n_b = n_a[good], n_b[good]
        a_ends, b_ends, ends = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b]), np.cumsum([len(chunks[i]) for i in at], dtype=np.int64)
        size = int(ends[-1]) + 1 if at else 1
        at_a, at_b = np.zeros(size, bool), np.zeros(size, bool)
        at_a[a_ends], at_b[b_ends] = True, True
        shared = at_a & at_b
        before = lambda x: np.cumsum(x) - x
        stops = np.flatnonzero(at_a | at_b)
        links = a[before(at_a)[stops]] << B_BITS | b[before(at_b)[stops]]
        group = before(shared)
        order = np.argsort(np.concatenate([2 * group[a_ends], 2 * group[b_ends] + 1]), kind="stable")
        said = np.concatenate([np.where(shared[e], self.said_as[last][i], self.said_as[b","][i]) for e, i, last in ((a_ends, a, b"|"), (b_ends, b, b";"))])[order].view(np.uint8)
        until = np.concatenate([[0], np.cumsum((said != 0).reshape(-1, 8).sum(axis=1))])[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
        said = said[said != 0].tobytes()
        counts = np.full((len(chunks), 4), 0, np.int64)
        counts[~good, 0] = -1
        counts[good] = np.stack([n_a, n_b, np.diff(np.cumsum(shared)[ends], prepend=0), np.diff(np.searchsorted(stops, ends, "right"), prepend=0)], axis=1)
        self.number.update(zip(chunks, range(len(self.said), len(self.said) + len(chunks)), strict=True))
        texts = [b""] * len(chunks)
        for k, i in enumerate(at):
            texts[i] = said[until[k] : until[k + 1] - 1]
        self.said += texts
        self.counts, self.links = np.concatenate([self.counts, counts]), np.concatenate([self.links, links])

    def numbers(self, chunks: list[bytes]) -> np.ndarray:
        found = list(map(self.number.get, chunks))
        if None in found:
            new = [c for c, x in zip(chunks, found, strict=True) if x is None]
            if len(self.number) + len(new) > REMEMBERED and self.number:
                self.forget()
                new = chunks
            self.learn(new)
            found = list(map(self.number.__getitem__, chunks))
        return np.array(found, np.int64)

    def texts(self, texts: list[bytes]) -> Texts:
        full = [b" " + t if t else b"" for t in texts]
        firsts = np.cumsum([0, *map(len, full)])[:-1]
        said = np.flatnonzero([len(t) > 0 for t in full])
        joined = np.frombuffer(b"".join(full), np.uint8)
        starts = self.chunk_starts(joined, firsts[said])
        places = np.append(starts, len(joined)).astype(np.int32)
        runs = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(joined)]).dictionary_encode()
        numbers = self.numbers(runs.dictionary.to_numpy(zero_copy_only=False).tolist())
        return Texts(self, len(texts), said[np.searchsorted(firsts[said], starts, "right") - 1], runs.indices.to_numpy(), numbers)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, each value once."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), starts[1], ..."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Texts:
    """Aligned texts: for each chunk in a row its text (of) and its place among the distinct chunks (which); good says of which texts the
    bytes agree."""

    def __init__(self, known: Aligner, n: int, of: np.ndarray, which: np.ndarray, numbers: np.ndarray):
        self.counts, self.sizes = known.counts[numbers, :3], known.counts[numbers, 3]
        fine = self.counts[:, 0] >= 0
        self.good = np.bincount(of, minlength=n) > 0
        self.good[of[~fine[which]]] = False
        keep = self.good[of]
        self.n, self.of, self.which, self.chunks, self.said, self.numbers = n, of[keep], which[keep], len(numbers), known.said, numbers
        first = np.cumsum(known.counts[:, 3]) - known.counts[:, 3]
        self.links = known.links[_runs(first[numbers], self.sizes)]

    def total(self, by_chunk: np.ndarray) -> np.ndarray:
        """A number of each chunk, added up by text."""
        sums = np.concatenate([[0], np.cumsum(by_chunk[self.which])])
        ends = np.searchsorted(self.of, np.arange(self.n + 1))
        return sums[ends[1:]] - sums[ends[:-1]]

    def per_chunk(self, by_link: np.ndarray) -> np.ndarray:
        """A number of each link of the distinct chunks, added up by chunk."""
        sums = np.concatenate([[0], np.cumsum(by_link.astype(np.int64))])
        ends = np.cumsum(self.sizes)
        return sums[ends] - sums[ends - self.sizes]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs and in how many of the texts each is linked."""
        keys = distinct(self.links)
        code, m = np.searchsorted(keys, self.links), max(1, len(keys))
        once = distinct(self.of.astype(np.int64) * max(1, self.chunks) + self.which)
        of, which = np.divmod(once, max(1, self.chunks))
        at = _runs((np.cumsum(self.sizes) - self.sizes)[which], self.sizes[which])
        held = distinct(np.repeat(of, self.sizes[which]) * m + code[at])
        counts = np.bincount(held % m, minlength=len(keys))
        return keys[counts > 0], counts[counts > 0]

    def groups_sha256(self) -> list[str]:
        ends = np.searchsorted(self.of, np.arange(self.n + 1)).tolist()
        words = list(map(self.said.__getitem__, self.numbers[self.which].tolist()))
        return [hashlib.sha256(b";".join(words[ends[i] : ends[i + 1]])).hexdigest() if self.good[i] else "" for i in range(self.n)]


_workers: dict[tuple[str, str], Aligner] = {}


def _path(name: str) -> str:
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


def aligner(a: str, b: str) -> Aligner:
    if (a, b) not in _workers:
        _workers[a, b] = Aligner(_path(a), _path(b))
    return _workers[a, b]


def _pieces(batch: pa.RecordBatch, a: str, b: str):
    """(aligned texts, their rows of the batch) of pieces of a batch."""
    texts, i = raw_texts(batch), 0
    while i < len(texts):
        z, length = i, 0
        while z < len(texts) and (z == i or length + len(texts[z]) <= PIECE):
            length += len(texts[z])
            z += 1
        yield aligner(a, b).texts(texts[i:z]), batch.slice(i, z - i)
        i = z


def linked_pairs(docs: DataFrame, a: str = TOKENIZER_A, b: str = TOKENIZER_B) -> DataFrame:
    """(keys array<long>, counts array<long>): for each piece of documents its distinct linked pairs, and the number of documents that
    hold each."""

    def each(batch: pa.RecordBatch):
        for texts, _ in _pieces(batch, a, b):
            keys, counts = texts.pairs()
            yield pa.RecordBatch.from_arrays([pa.array([keys], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64()))], names=["keys", "counts"])

    return map_texts(docs, ["text"], "keys array<long>, counts array<long>", each, ROWS)


def pair_hashes(pieces: DataFrame) -> tuple[DataFrame, int, int]:
    """(shard, pilots, keys) of the distinct pairs, written; the number of shards, and of pairs."""
    keys = written(pieces.select(F.explode("keys").alias("key")).distinct())
    n = keys.count()
    shards = max(1, -(-n // SHARD_KEYS))

    def placed(batch: pa.RecordBatch):
        k = batch.column("key")
        yield pa.RecordBatch.from_arrays([k, pa.array(shard_of(k.to_numpy(), shards))], names=["key", "shard"])

    def built(rows: pa.Table) -> pa.Table:
        found = PairHash(np.sort(rows.column("key").to_numpy()))
        return pa.table({"shard": rows.column("shard")[:1].combine_chunks(), "pilots": pa.array([found.pilots.tobytes()], pa.binary()), "keys": pa.array([found.keys.tobytes()], pa.binary())})

    return written(map_texts(keys, ["key"], "key long, shard long", placed, 100_000).groupBy("shard").applyInArrow(built, "shard long, pilots binary, keys binary")), shards, n


def pair_counts(pieces: DataFrame, index: PairIndex) -> np.ndarray:
    """Documents that hold each pair, by its place in the index."""
    spark = pieces.sparkSession
    sent, size = spark.sparkContext.broadcast(index), len(index.keys)

    def each(batches):
        find, total = sent.value, None
        for batch in batches:
            for i in range(0, batch.num_rows, 8):
                part = batch.slice(i, 8)
                keys = part.column("keys").flatten().to_numpy()
                at = find(keys)
                total = np.zeros(size, np.int64) if total is None else total
                np.add.at(total, at[at >= 0], part.column("counts").flatten().to_numpy()[at >= 0])
        return total

    tasks = min(spark.sparkContext.defaultParallelism, pieces.rdd.getNumPartitions())
    try:
        return summed(pieces.coalesce(max(1, tasks)), each, tasks, size, np.int64)
    finally:
        sent.destroy()


_OUT = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def alignments(docs: DataFrame, a: str = TOKENIZER_A, b: str = TOKENIZER_B) -> DataFrame:
    """docs(doc_id, text, ...) -> one row each: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best: links whose pair's count is the highest of its A id in the whole corpus; count_sum: sum of the pairs' counts over all links."""
    spark = docs.sparkSession
    pieces = written(linked_pairs(docs, a, b))
    hashes, shards, n = pair_hashes(pieces)
    slices = max(1, -(-n // SLICE_KEYS))
    found, best = [], np.zeros(0, np.int64)
    for s in range(slices):
        index = PairIndex(hashes.where(F.col("shard") % slices == s).collect(), shards)
        counts = pair_counts(pieces, index)
        of = index.keys >> B_BITS
        if len(of) and of.max() >= len(best):
            best = np.concatenate([best, np.zeros(of.max() + 1 - len(best), np.int64)])
        np.maximum.at(best, of, counts)
        found.append((index, counts) if slices == 1 else None)

    def looked_up(index: PairIndex, counts: np.ndarray) -> DataFrame:
        sent = spark.sparkContext.broadcast((index, counts, best))

        def each(batch: pa.RecordBatch):
            find, count, most = sent.value
            for texts, rows in _pieces(batch, a, b):
                at = find(texts.links)
                value = np.where(at >= 0, count[at] if len(count) else 0, 0)
                is_best = (at >= 0) & (value == most[texts.links >> B_BITS]) if len(most) else at >= 0
                numbers = [*texts.counts.T, texts.sizes, texts.per_chunk(is_best), texts.per_chunk(value)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(texts.total(x), pa.int64()) for x in numbers), pa.array(texts.groups_sha256(), pa.string()), rows.column("key")], names=["doc_id", *_OUT, "groups_sha256", "key"])

        keyed = docs.select("doc_id", "text", (F.sha2("text", 256) if slices > 1 else F.lit(None).cast("string")).alias("key"))
        return map_texts(keyed, ["doc_id", "text", "key"], "doc_id long, " + ", ".join(f"{c} long" for c in _OUT) + ", groups_sha256 string, key string", each, ROWS)

    if slices == 1:
        return looked_up(*found[0]).drop("key")
    # a pass for each slice; rows equal in doc_id and text are told apart by their number alone
    parts = []
    for s in range(slices):
        index = PairIndex(hashes.where(F.col("shard") % slices == s).collect(), shards)
        parts.append(written(looked_up(index, pair_counts(pieces, index)).groupBy("doc_id", "key", "groups_sha256", *_OUT).agg(F.count(F.lit(1)).alias("rows"))))
    both = parts[0]
    for p in parts[1:]:
        both = both.union(p)
    same = [F.first(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "rows")]
    added = both.groupBy("doc_id", "key").agg(*same, F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return added.withColumn("_row", F.explode(F.expr("sequence(1L, rows)"))).select("doc_id", *_OUT, "groups_sha256")


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(table(spark, sf_dir, "documents"))
