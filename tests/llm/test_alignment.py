"""Alignment against whole-text encoding and brute-force counts; the hash of pairs."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from planfold.llm import alignment
from tests.llm.conftest import ODD


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path(alignment.TOKENIZER_A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.TOKENIZER_B))


def plain(texts, tokenizers):
    """Each text encoded as a whole, links by comparing all byte ranges that can overlap, counts over all texts."""
    a, b = tokenizers
    byte = alignment._byte_of()
    rows, held = [], Counter()
    for text in texts:
        said = (" " + (text or "")).encode()
        ia, ib = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        ba = [bytes(byte[c] for c in a.id_to_token(i)) for i in ia]
        bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if not text or b"".join(ba) != said or b"".join(bb) != said:
            rows.append(([], [], [], []))
            continue
        spans = [[], []]
        for side, parts in enumerate((ba, bb)):
            at = 0
            for p in parts:
                spans[side].append((at, at + len(p)))
                at += len(p)
        links, j = [], 0
        for i, (s, e) in enumerate(spans[0]):
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(ib) and spans[1][k][0] < e:
                links.append((ia[i], ib[k]))
                k += 1
        ends, groups = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}), []
        low = 0
        for e in ends:
            groups.append(([x for x, s in zip(ia, spans[0], strict=True) if low < s[1] <= e], [x for x, s in zip(ib, spans[1], strict=True) if low < s[1] <= e]) if len(text) < 3000 else None)
            low = e
        rows.append((ia, ib, groups, links))
        held.update(set(links))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for ia, ib, groups, links in rows:
        said = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups) if None not in groups else None
        sha = "" if not groups else None if said is None else hashlib.sha256(said.encode()).hexdigest()
        out.append((len(ia), len(ib), len(groups), len(links), sum(held[k] == best[k[0]] for k in links), sum(held[k] for k in links), sha))
    return out


PARTS = ["the", "Héllo", "wörld", "  ", "\n", "\n ", " \t", "l'été", "don't", "123", "<s>", "</s>", "<|endoftext|>", "<0x41>", "日本語", "Привет мир", "é", " ", "　", "á", "😀", "a_b-c", "...", "aaaaaaaaaaaaaaaaaaaaaaa", " ", "x", "\r\n", "÷", "\x00", "\x7f", "ﬁ", "İ"]


def texts_of(n, seed):
    r = random.Random(seed)
    out = ["".join(r.choice(PARTS) + r.choice(["", " ", " ", "  "]) for _ in range(r.randrange(1, 25))) for _ in range(n)]
    return out + [None, "", " ", "  ", "▁ a", "x " * 40, "The same text.", "The same text.", "a  ", " a", "\n"]


def rows_of(df):
    return [tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.orderBy("doc_id").collect()]


def check(got, expected):
    assert len(got) == len(expected)
    for g, e in zip(got, expected, strict=True):
        assert g[:6] == e[:6]
        assert e[6] is None or g[6] == e[6]


def test_against_whole_texts(spark, documents, tokenizers):
    texts = texts_of(300, 3)
    docs = documents(list(enumerate(texts)))
    check(rows_of(alignment.alignments(docs)), plain(texts, tokenizers))


def test_slices_give_the_same(spark, documents, tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE_KEYS", 150)
    monkeypatch.setattr(alignment, "SHARD_KEYS", 40)
    texts = texts_of(60, 5)
    check(rows_of(alignment.alignments(documents(list(enumerate(texts))))), plain(texts, tokenizers))


def test_odd_rows(spark, documents, tokenizers):
    check(sorted(rows_of(alignment.alignments(documents(ODD)))), sorted(plain([t for _, t in ODD], tokenizers), key=lambda r: (*r[:6], r[6] or "")))
    assert alignment.alignments(documents([])).collect() == []
    got = alignment.alignments(documents([(None, "a b"), (1, None)])).collect()
    assert {(r.doc_id, r.n_a) for r in got} == {(None, 2), (1, 0)}


def test_whole_table(spark, sf, tokenizers):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id")
    texts = [r.text for r in docs.collect()]
    check(rows_of(alignment.op11_cross_tokenizer_alignment(spark, sf)), plain(texts, tokenizers))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 20_000])
def test_pair_hash_is_minimal_and_perfect(n):
    keys = np.unique(np.random.RandomState(n).randint(0, 1 << 48, n))
    found = alignment.PairHash(keys)
    assert sorted(found.keys.tolist()) == keys.tolist()

    class Row(dict):
        __getattr__ = dict.__getitem__

    index = alignment.PairIndex([Row(shard=0, pilots=found.pilots.tobytes(), keys=found.keys.tobytes())], 1)
    assert sorted(index(keys).tolist()) == list(range(len(keys)))
    others = np.setdiff1d(np.arange(1000) << 20 | 7, keys)
    assert (index(others) == -1).all()
