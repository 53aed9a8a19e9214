"""Fingerprints and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from planfold.llm import simhash
from tests.llm.conftest import LONG, ODD, WORD, lower_az


def plain_print(text):
    words = WORD.findall(lower_az(text or ""))
    if not words:
        return 0
    said = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in said]
    return sum(1 << p for p in range(64) if 2 * sum(x >> p & 1 for x in h) > len(h))


def plain_components(prints, ids):
    """Smallest id reached, by comparing all pairs of fingerprints."""
    x = np.array(prints, np.uint64)
    parent = list(range(len(x)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(x)):
        d = np.bitwise_count(x ^ x[i])
        for j in np.flatnonzero(d <= 2).tolist():
            parent[root(max(i, j))] = root(min(i, j)) if root(i) != root(j) else parent[root(max(i, j))]
    least = {}
    for i, k in enumerate(ids):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return [least.get(root(i)) for i in range(len(x))]


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "a b c", "a b c d e f a b c d", "É é\x0b ß 😀 ñ", LONG])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == plain_print(text)


def test_pieces_change_nothing(monkeypatch):
    for size in (1, 7, 50):
        monkeypatch.setattr(simhash, "PIECE", size)
        for text in ("one", "one two", "  one   two  three ", "a b c d e f g " * 30, "x" * 200 + " y z " + "w" * 99):
            assert simhash.fingerprint(text.encode()) == plain_print(text)


def cluster(r, n, flips, bits=range(64)):
    """n fingerprints, each a few flips from an earlier one."""
    out = [r.getrandbits(64)]
    while len(out) < n:
        x = r.choice(out)
        for p in r.sample(list(bits), r.randrange(flips + 1)):
            x ^= 1 << p
        out.append(x)
    return out


@pytest.mark.parametrize("full,free", [(1024, 10), (6, 2)])
def test_linked_reaches_all(spark, monkeypatch, full, free):
    monkeypatch.setattr(simhash, "FULL", full)
    monkeypatch.setattr(simhash, "FREE", free)
    r = random.Random(full)
    prints = cluster(r, 150, 3) + cluster(r, 150, 5, range(9)) + [r.getrandbits(64) for _ in range(300)] + [0, 3, 7, 15]
    prints = sorted(set(prints))
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    links = [(x.a, x.b) for x in simhash.linked(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()]
    at = {x: i for i, x in enumerate(signed)}
    label = simhash.forest(len(prints), np.array([at[a] for a, _ in links]), np.array([at[b] for _, b in links]))
    assert label.tolist() == plain_components(prints, list(range(len(prints))))


def test_a_bucket_that_every_field_fills(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FULL", 8)
    monkeypatch.setattr(simhash, "FREE", 3)
    prints = list(range(0, 512, 3))  # all alike but for nine bits
    links = simhash.linked(spark.createDataFrame([(x,) for x in prints], "fp long")).collect()
    at = {x: i for i, x in enumerate(prints)}
    label = simhash.forest(len(prints), np.array([at[x.a] for x in links]), np.array([at[x.b] for x in links]))
    assert label.tolist() == plain_components(prints, list(range(len(prints))))


def rows(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def plain(pairs):
    prints = [plain_print(t) for _, t in pairs]
    return sorted(((d, f"{p:016x}", c) for (d, _), p, c in zip(pairs, prints, plain_components(prints, [d for d, _ in pairs]), strict=True)), key=str)


def test_odd_rows(spark, documents):
    pairs = [*ODD, (None, "no id"), (None, "one"), (20, LONG + " end"), (21, "No  ID")]
    assert rows(simhash.near_duplicates(documents(pairs))) == plain(pairs)
    assert simhash.near_duplicates(documents([])).collect() == []
    kept = {r.doc_id for r in simhash.drop_near_duplicates(documents(pairs)).collect()}
    assert {1, 5, 6, None} <= kept and 7 not in kept and 2 not in kept


def test_whole_table(spark, sf):
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows(simhash.op13_simhash_near_dedup(spark, sf)) == plain(pairs)


def test_word_is_the_contract():
    assert re.fullmatch(WORD, "a\x1cb")
    assert "a\x1cb c".encode().split() == [b"a\x1cb", b"c"]
