"""Whitening against a dense eigendecomposition, exact integers and odd rows."""

import math

import numpy as np
import pytest

from planfold.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n long, component int, x int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], SCHEMA)


def plain(rows, k):
    """Dense: numbers as in the contract."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in good]
    fit = sorted(set(map(tuple, x)))
    n, d = len(fit), len(fit[0])
    s = [sum(r[j] for r in fit) for j in range(d)]
    c = np.array(fit, float) - np.array(s) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    deviation = {(i, tuple(v)): sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for (i, v), r in zip(good, x, strict=True)}
    return good, n, deviation, (np.array(x, float) - np.array(s) / n) @ u[:, :k] / np.sqrt(np.maximum(e[:k], 1e-30)), e[:k] / e.sum()


def compare(got, rows, k):
    good, n, deviation, z, share = plain(rows, k)
    assert len(got) == len(good) * k and {r.n for r in got} == {n}
    assert max(r.identity_error for r in got) < 1e-9
    by = {(r.vec_id, r.component): r for r in got}
    for c in range(k):
        mine = np.array([by[i, c + 1].whitened for i, _ in good])
        sign = np.sign(mine @ z[:, c])
        assert np.abs(mine - sign * z[:, c]).max() < 1e-8
        assert abs(by[good[0][0], c + 1].explained - share[c]) < 1e-10
    for i, v in good:
        assert by[i, 1].deviation == deviation[i, tuple(v)]


@pytest.mark.parametrize("d", [1, 5, 16, 40])
def test_against_dense(spark, d):
    r = np.random.RandomState(d)
    m = r.standard_normal((300, d)) * (1 + 3 * r.rand(d)) + r.rand(d)
    rows = [(i, v) for i, v in enumerate(m.tolist())]
    rows += [(1000 + i, v) for i, v in rows[:20]]
    compare(whitening.whitened(frame(spark, rows)).collect(), rows, min(d, 16))


@pytest.mark.parametrize("d,want,spectrum", [(200, 16, "falling"), (300, 10, "flat"), (120, 8, "ties"), (90, 16, "low rank")])
def test_leading_pairs(d, want, spectrum):
    """The eigensolver beyond the size of its search space."""
    r = np.random.RandomState(d)
    q, _ = np.linalg.qr(r.standard_normal((d, d)))
    e = {"falling": 0.9 ** np.arange(d), "flat": 1 + r.rand(d), "ties": np.repeat(np.arange(d // 4, 0, -1.0), 4), "low rank": np.concatenate([[5.0, 3, 2], np.zeros(d - 3)])}[spectrum]
    v = (q * e) @ q.T
    calls = []
    values, vectors, residuals = whitening.leading_pairs(lambda u: calls.append(u.shape[1]) or v @ u, d, want)
    assert np.abs(values - np.sort(e)[::-1][:want]).max() < 1e-12 * e.max()
    assert residuals.max() < 1e-12 * e.max()
    assert np.abs(vectors.T @ vectors - np.eye(want)).max() < 1e-12
    assert len(calls) < 400


def test_search_space_is_cut(monkeypatch):
    monkeypatch.setattr(whitening, "SPACE", 24)
    test_leading_pairs(200, 16, "falling")


def test_odd_rows(spark):
    nan, inf = math.nan, math.inf
    base = [(i, [math.sin(i * k) for k in range(1, 5)]) for i in range(1, 40)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0]), (103, [nan, 1.0, 1.0, 1.0]), (104, [1.0, inf, 0.0, 0.0]), (105, [1.0, 2.0]), (106, [1e300, 0.0, 0.0, 0.0]), (107, None)]
    got = whitening.whitened(frame(spark, base + odd)).collect()
    compare(got, base, 4)
    assert whitening.whitened(frame(spark, odd[:2])).collect() == []
    assert whitening.whitened(frame(spark, [])).collect() == []
    one = whitening.whitened(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (None, [0.5, 0.25])])).collect()
    assert len(one) == 6 and all(r.whitened is None and r.deviation == 0 and r.n == 1 and r.explained is None for r in one)


def test_constant_dimension_and_large_entries(spark):
    r = np.random.RandomState(1)
    rows = [(i, [7.0, a, b * 1000, 600.0 * c]) for i, (a, b, c) in enumerate(r.standard_normal((100, 3)).tolist())]
    got = whitening.whitened(frame(spark, rows)).collect()
    assert {r.component for r in got if r.whitened is None} == {4}
    assert max(r.identity_error for r in got) < 1e-9
    big = [(i, [a * 1e9, b * 1e9]) for i, (a, b) in enumerate(r.standard_normal((50, 2)).tolist())]
    found = {x.vec_id: x.deviation for x in whitening.whitened(frame(spark, big)).collect()}
    _, _, deviation, _, _ = plain(big, 2)
    for i, v in big:
        exact = deviation[i, tuple(v)]
        assert found[i] == (exact if exact < 2**63 else None)


def test_many_tasks_are_summed_as_a_tree(spark, monkeypatch):
    from planfold.llm import sums

    monkeypatch.setattr(sums, "FAN_IN", 2)
    rows = spark.range(0, 900, 1, 9)

    def each(batches):
        total = np.zeros(5, np.int64)
        for b in batches:
            x = b.column("id").to_numpy()
            total += np.bincount(x % 5, x, 5).astype(np.int64)
        return total

    assert sums.summed(rows, each, 9, 5, np.int64, segment=2).tolist() == [sum(range(k, 900, 5)) for k in range(5)]


def test_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    compare(whitening.op12_embedding_whitening(spark, sf).collect(), rows, 16)
