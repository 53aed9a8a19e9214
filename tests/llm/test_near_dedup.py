import random

import pytest
from tests.llm.conftest import ODD, WORD, lower_az

from planfold.llm import near_dedup
from planfold.llm.graph import components


def shingles(text):
    w = WORD.findall(lower_az(text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets, parent = {}, {}
    for d, t in rows:
        sets.setdefault(d, []).append(shingles(t))
        parent[d] = d

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flat = [(d, s) for d, all_ in sets.items() for s in all_ if s]
    for i, (a, x) in enumerate(flat):
        for b, y in flat[:i]:
            if 100 * len(x & y) >= 75 * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {d: root(d) for d in parent}


def compare(spark_df, rows):
    expected = brute(rows)
    got = near_dedup.near_duplicates(spark_df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == expected[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)
    assert sorted((r.doc_id, r.n_shingles) for r in got) == sorted((d, len(shingles(t))) for d, t in rows)


def test_odd_rows(documents):
    compare(documents(ODD), ODD)


def test_empty_table(documents):
    assert near_dedup.near_duplicates(documents([])).count() == 0


@pytest.mark.parametrize("slot", [2000, 2])
def test_chains_copies_and_unrelated(documents, monkeypatch, slot):
    monkeypatch.setattr(near_dedup, "SLOT", slot)
    monkeypatch.setattr(near_dedup, "KEPT_POWERS", 4096 if slot > 2 else 100)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, n = [], 0
    for _ in range(12):
        words = [word() for _ in range(rng.choice([12, 60, 200]))]
        for _ in range(8):  # each changes the one before: chains whose ends are no longer similar
            rows.append((n := n + 1, " ".join(words)))
            words = list(words)
            words[rng.randrange(len(words))] = word()
    rows += [(n + 1 + i, rows[0][1].upper()) for i in range(30)]
    compare(documents(rows), rows)


def test_drop_keeps_columns(documents):
    df = documents([(3, "a b c d e f"), (1, "a b c d e f"), (2, "x y"), (4, None)])
    out = near_dedup.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 4]


def test_posterior_bounds_are_safe():
    for k, least in enumerate(near_dedup.least_matches(), 1):
        n = near_dedup.BATCH * k
        assert 0 < least < n * 0.75


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, 101: 100}  # the smallest of each stands for itself


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
