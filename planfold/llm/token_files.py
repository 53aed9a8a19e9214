"""Token-ID output: frequency-ranked ids in byte-aligned variable-length code, control bytes apart from data bytes.

A token file is a folder with two tables. `blocks` holds runs of documents in ascending doc_id order, one binary block in a row:

    magic b"PFT1", documents n (u32), ids m (u64), doc_ids (i64 * n), id counts (u32 * n), control bytes, data bytes

with part and block as its place in the order, and the number of ids before it in its part. Every id is replaced by its rank (0: the most frequent id of the corpus; ties by
id), written little-endian in 1 to 4 data bytes. Two bits in the control bytes, four ids to a byte from the lowest bits up, hold
the number of data bytes less one. `ranks` maps ranks back to ids; it has at most one row for each id of the vocabulary.

Spark writes both tables, so the files live in any store, tasks may be retried and no path is local to a machine.

Defined results: null text counts as empty; an empty text is the end id alone; rows that repeat a doc_id follow each other, ordered
by a hash of the text; a null doc_id comes first (stored as the smallest long). Extra columns are ignored."""

from __future__ import annotations

import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planfold.llm.common import map_texts, raw_texts, shared_folder, table

MAGIC = b"PFT1"
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
#: Ids in a block, about; a document is never split.
BLOCK_IDS = 1 << 18
#: Runs whose ids a worker remembers, twice: those since the last turn and those of the turn before.
REMEMBERED = 300_000
#: Data bytes of the four ids that a control byte describes.
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)
_NO_ID = -(2**63)
BLOCKS = "part int, block long, before long, doc_ids array<long>, counts array<long>, ids binary"
FILES = "part int, block long, before long, first_doc_id long, n_ids long, data binary"
#: Rows of the table of ids hold about 1 MB: pages and row groups are measured after each, and few rows go to a Python worker at once.
SMALL_GROUPS = {"parquet.block.size": str(32 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
BLOCKS_AT_ONCE = 8


#: Classes of bytes: blanks, letters (a-z, A-Z and the bytes of U+00C0 to U+00FF), marks, digits, and all that takes the whole tokenizer.
_BLANK, _LETTER, _MARK, _DIGIT, _ODD = range(5)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _BLANK
_CLASS[33:127] = _MARK
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _CLASS[0xC3] = _CLASS[0x80:0xC0] = _LETTER
_CLASS[ord("'")] = _ODD
#: Lower case of the letters: A-Z, and U+00C0 to U+00DE, whose second byte rises by 32 as well.
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_LOW[0x80:0x9F] += 32
#: Bytes of text that are cut up at once.
PIECE = 4 << 20


def runs_of(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes -> (starts of runs, which bytes are blanks, the bytes with plain letters lower-cased).

    A run is what the tokenizer's pattern takes as one token to be: letters, one digit, or marks. Stretches
    between blanks that hold anything whose tokens depend on more (other alphabets, combining marks, apostrophes, the opening of an
    added token, controls) stay whole and as they are."""
    kind = _CLASS[b]
    lead = b == 0xC3
    # bytes from 0x80 up count as letters only in pairs C3 xx, but for the two signs among those
    high = b >= 0x80
    if high.any():
        second = np.zeros(len(b), bool)
        second[1:] = lead[:-1]
        kind[high & ~lead & ~second] = _ODD
        kind[second & ((b == 0x97) | (b == 0xB7))] = _ODD
    opens = np.flatnonzero(b == ord("<"))
    if len(opens):
        kind[opens[b[np.minimum(opens + 1, len(b) - 1)] == ord("|")]] = _ODD
    start = np.empty(len(b), bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= kind == _DIGIT
    blank = kind == _BLANK
    start &= ~blank
    odd = np.flatnonzero(kind == _ODD)
    low = _LOW[b]
    if len(odd):
        new = np.empty(len(b), bool)  # first bytes of stretches
        new[0] = True
        new[1:] = blank[:-1] & ~blank[1:]
        stretch = np.flatnonzero(new)
        whole = np.unique(np.searchsorted(stretch, odd, "right") - 1)
        first, last = stretch[whole], np.append(stretch, len(b))[whole + 1]
        inside = np.zeros(len(b) + 1, np.int8)
        inside[first] += 1
        inside[last] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        start &= ~inside | new
        low[inside] = b[inside]
    return np.flatnonzero(start), blank, low


class RunIds(dict):
    """From a run of text (bytes) to its ids, as little-endian u32 bytes. The ids of a text are those of its runs in a row, and runs
    recur.

    Lower-case words of letters below U+0100 are left as they are by the tokenizer's normalisation and are one token run each: new ones
    go to its model together, apart by blanks, and come apart where an id ends a word. Everything else takes the whole tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.before: dict[bytes, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix = self.tokenizer.model.end_of_word_suffix
        self.is_last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.is_last[[i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith(suffix)]] = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.byte_names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def learn(self, runs: list[bytes]) -> None:
        if len(self) > REMEMBERED:
            self.before = dict(self)
            self.clear()
        words, names = [], []
        for run in runs:
            if (found := self.before.get(run)) is not None:
                self[run] = found
            elif run.isalpha() and run.islower():  # of bytes: ASCII letters alone
                words.append(run)
                names.append(run.decode())
            else:
                text = run.decode()
                if text.isalpha() and text.islower() and max(text) < "Ā":
                    words.append(run)
                    names.append(run.decode("latin-1").translate(self.byte_names))
                else:
                    self[run] = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if words:
            ids = np.array(self.model.encode_batch_fast([" ".join(names)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * np.flatnonzero(self.is_last[ids]) + 4).tolist()
            raw = ids.tobytes()
            self.update(zip(words, (raw[x:y] for x, y in zip([0, *ends], ends, strict=False)), strict=True))

    def piece(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts of runs, number of ids of each run, all ids) of a piece of text."""
        starts, blank, low = runs_of(b)
        if not len(starts):
            return starts, starts, np.empty(0, "<u4")
        said = ~blank
        places = np.append(np.cumsum(said, dtype=np.int32)[starts] - 1, np.count_nonzero(said)).astype(np.int32)
        runs = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(low[said])]).dictionary_encode()
        words = runs.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = list(map(self.get, words))
        if None in known:
            at = [i for i, ids in enumerate(known) if ids is None]
            new = [words[i] for i in at]
            self.learn(new)
            for i, ids in zip(at, map(self.__getitem__, new), strict=True):
                known[i] = ids
        sizes = np.fromiter(map(len, known), np.int64, len(known)) >> 2
        flat = np.frombuffer(b"".join(known), "<u4")
        at, which = np.cumsum(sizes) - sizes, runs.indices.to_numpy()
        counts = sizes[which]
        ends = np.cumsum(counts)
        where = np.repeat(at[which] - ends + counts, counts) + np.arange(ends[-1])
        return starts, counts, flat[where]

    def texts(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids), the end ids included."""
        joined = b"\n".join(texts) + b"\n"
        firsts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        counts, said, a = np.ones(len(texts), np.int64), [], 0
        while a < len(joined):
            z = len(joined)
            if z - a > PIECE:  # cut after the last blank of the piece, or else the first one behind it
                z = max(joined.rfind(b" ", a, a + PIECE), joined.rfind(b"\n", a, a + PIECE)) + 1
                if z <= a:
                    z = min((k for k in (joined.find(b" ", a + PIECE), joined.find(b"\n", a + PIECE)) if k >= 0), default=len(joined) - 1) + 1
            starts, n, ids = self.piece(np.frombuffer(joined, np.uint8, z - a, a))
            of = np.searchsorted(firsts, starts + a, "right") - 1
            counts += np.bincount(of, n, len(texts)).astype(np.int64)
            said.append(ids)
            a = z
        ids = np.concatenate(said) if said else np.empty(0, "<u4")
        ends = np.cumsum(counts)
        out = np.empty(ends[-1] if len(ends) else 0, "<u4")
        at_end = np.zeros(len(out), bool)
        at_end[ends - 1] = True
        out[at_end], out[~at_end] = end_id, ids
        return counts, out


_workers: dict[str, RunIds] = {}


def _tokenizer_path(name: str) -> str:
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


def tokenised(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """(part, block, before, doc_ids, counts, ids): a row for each block of documents in ascending doc_id order, range-partitioned by
    it; ids as u32 bytes with the end ids, counts of them by document. The task that makes a whole part numbers its blocks and counts
    the ids before each, and a row is never split, so later reads may deal out the rows in any way."""

    def each(batches):
        encode = _workers.get(tokenizer)
        if encode is None:
            encode = _workers[tokenizer] = RunIds(_tokenizer_path(tokenizer))
        doc_ids, counts, ids, part, number, before, size = [], [], [], None, 0, 0, 0

        def out():
            columns = [pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([before], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([np.concatenate(counts)], pa.list_(pa.int64())), pa.array([b"".join(ids)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "block", "before", "doc_ids", "counts", "ids"])

        for batch in batches:
            texts, numbers, a = raw_texts(batch), batch.column("doc_id").to_pylist(), 0
            while a < len(texts):
                z, length = a, 0
                while z < len(texts) and z - a < 2000 and (z == a or length + len(texts[z]) <= PIECE):
                    length += len(texts[z])
                    z += 1
                n, said = encode.texts(texts[a:z], end_id)
                part = batch.column("part")[0].as_py() if part is None else part
                doc_ids += numbers[a:z]
                counts.append(n)
                ids.append(said.tobytes())
                size += len(said)
                a = z
                if size >= BLOCK_IDS:
                    yield out()
                    doc_ids, counts, ids, number, before, size = [], [], [], number + 1, before + size, 0
        if doc_ids:
            yield out()

    ordered = docs.select("doc_id", "text").withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    return ordered.withColumn("part", F.spark_partition_id()).select("doc_id", "part", "text").mapInArrow(each, BLOCKS)


def id_ranks(ids: DataFrame) -> DataFrame:
    """(rank, id, n) over all ids of the corpus, the most frequent first. The vocabulary bounds its rows."""

    def count(batch: pa.RecordBatch):
        seen = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), "<u4"))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], names=["id", "n"])

    counts = map_texts(ids, ["ids"], "id long, n long", count, BLOCKS_AT_ONCE).groupBy("id").agg(F.sum("n").alias("n"))
    ranked = sorted(counts.collect(), key=lambda r: (-r.n, r.id))
    return ids.sparkSession.createDataFrame([(k, r.id, r.n) for k, r in enumerate(ranked)], "rank long, id long, n long")


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """u32 ranks -> (control bytes, data bytes)."""
    r = ranks.astype("<u4")
    more = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    four = np.concatenate([more, np.zeros(-len(r) % 4, np.uint8)]).reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = r.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) <= more[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks, by looking up each control byte's four lengths."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    d = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    out = d[at]
    for k in (1, 2, 3):
        if len(i := np.flatnonzero(lengths > k)):
            out[i] |= d[at[i] + k] << np.uint32(8 * k)
    return out


def block_of(doc_ids: list[int | None], counts: list[int], ids: bytes, rank_of: np.ndarray) -> bytes:
    flat = np.frombuffer(ids, "<u4")
    control, data = pack(rank_of[flat])
    numbers = np.array([_NO_ID if d is None else d for d in doc_ids], "<i8")
    return b"".join([MAGIC, struct.pack("<IQ", len(counts), len(flat)), numbers.tobytes(), np.array(counts, "<u4").tobytes(), control, data])


def read_block(block: bytes, id_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, id counts, all ids) of a block."""
    if block[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    n, m = struct.unpack_from("<IQ", block, 4)
    doc_ids, at = np.frombuffer(block, "<i8", n, 16), 16 + 8 * n
    counts, at = np.frombuffer(block, "<u4", n, at), at + 4 * n
    width = (m + 3) // 4
    return doc_ids, counts, id_of[unpack(block[at : at + width], block[at + width :], m)].astype("<u4")


def _array(ranks: DataFrame, key: str, value: str) -> np.ndarray:
    rows = ranks.select(key, value).collect()
    out = np.zeros(max((r[0] for r in rows), default=-1) + 1, np.uint32)
    for k, v in rows:
        out[k] = v
    return out


def write_token_files(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> None:
    """Tokenises once into a compressed table of blocks that is already in order, counts ids, then writes blocks and ranks under path."""
    spark = docs.sparkSession
    ids_path = f"{path}/ids"
    tokenised(docs, tokenizer, end_id).write.options(**SMALL_GROUPS).option("compression", "zstd").parquet(ids_path)
    ids = spark.read.schema(BLOCKS).parquet(ids_path)
    ranks = id_ranks(ids)
    ranks.coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = _array(ranks, "id", "rank")

    def blocks(batch: pa.RecordBatch):
        for part, number, before, doc_ids, counts, b in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "before", "doc_ids", "counts", "ids")), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([before], pa.int64()), pa.array([doc_ids[0]], pa.int64()), pa.array([len(b) // 4], pa.int64()), pa.array([block_of(doc_ids, counts, b, rank_of)], pa.binary())], names=["part", "block", "before", "first_doc_id", "n_ids", "data"])

    map_texts(ids, ids.columns, FILES, blocks, BLOCKS_AT_ONCE).write.option("compression", "zstd").parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document, decoded from the files: doc_id, start, n_tokens, ids_crc32.

    start comes from the ids before each block in its part and the sums of the parts, as many as range partitions."""
    blocks = spark.read.schema(FILES).parquet(f"{path}/blocks")
    id_of = _array(spark.read.schema("rank long, id long, n long").parquet(f"{path}/ranks"), "rank", "id")
    sizes, starts, at = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect(), {}, 0
    for row in sizes:
        starts[row.part], at = at, at + row.n

    def documents(batch: pa.RecordBatch):
        for part, before, data in zip(*(batch.column(c).to_pylist() for c in ("part", "before", "data")), strict=True):
            doc_ids, counts, ids = read_block(data, id_of)
            ends = np.cumsum(counts, dtype=np.int64)
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]
            numbers = pa.array([None if d == _NO_ID else d for d in doc_ids.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([numbers, pa.array(starts[part] + before + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_texts(blocks, ["part", "before", "data"], "doc_id long, start long, n_tokens long, ids_crc32 long", documents, BLOCKS_AT_ONCE)


def encoded(docs: DataFrame) -> DataFrame:
    """Writes docs as token files to a new shared folder and reads them back."""
    path = shared_folder(docs.sparkSession)
    write_token_files(docs, path)
    return read_token_files(docs.sparkSession, path)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
