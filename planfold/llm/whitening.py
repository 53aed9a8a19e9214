"""Embedding whitening: vectors projected on the leading eigenvectors of their covariance, each direction scaled to variance 1.

Entries c become whole numbers x = floor(64 c) + 1000000. The fit list holds each distinct x vector once; it is packed into blocks of
rows and written. Its covariance is never formed: Jacobi-Davidson needs products V u alone, each a job in which every task centres its
rows and multiplies, C'(C u), for all directions of a step at once; the tasks' sums are added as a tree.

Jacobi-Davidson. The driver holds a search space of at most SPACE + 2 * COMPONENTS directions. Rayleigh-Ritz on it gives approximate pairs; for
those not yet good the correction equation (I - QQ')(V - e I)(I - QQ') t = -r, with Q the locked and the present vectors, is solved
roughly by MINRES, whose steps for all pairs share their products; the corrections extend the space, which restarts from its leading
Ritz vectors when it is full. Pairs whose residuals reach double precision are locked, the leading ones first, until as many are as are
wanted and none outside is larger. At the end one Rayleigh-Ritz on the locked vectors sets their values.

Defined results: rows whose vector is null or empty, or holds null, non-finite or so large entries that x is no long (|c| over 7e16), are
dropped; so are vectors of another length than most have (ties: the longer). deviation is null where it is no long. Components without variance (to double precision) have whitened
null and don't count for identity_error, which is null if there are no others. There are min(16, length) components. Rows that repeat
are kept; extra columns are ignored."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planfold.llm.common import map_texts, table, written
from planfold.llm.sums import summed

COMPONENTS = 16
#: Directions kept in the search space, and beyond them at a restart; MINRES steps for a correction, and the part of the residual at which it stops.
SPACE, SPARE, STEPS, GOAL = 64, 6, 5, 0.02
#: Residual, relative to the largest eigenvalue, that counts as double precision; a pair that has stopped improving counts from STALLED.
TOLERANCE, STALLED = 64 * 2.0**-52, 1e-10
SCALE, SHIFT, LARGEST = 64, 1_000_000, 7e16
#: Bytes of a block of the fit list as doubles, about.
BLOCK_BYTES = 1 << 20
_KINDS = (np.dtype("<i2"), np.dtype("<i4"), np.dtype("<i8"))


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """Rows with a vector whose entries are all there and finite."""
    return vectors.where(F.expr(f"size({column}) > 0 and forall({column}, e -> e is not null and abs(e) < {LARGEST}D)"))


def _matrix(batch: pa.RecordBatch, column: str, d: int) -> np.ndarray:
    """x - SHIFT of a batch's vectors."""
    return np.floor(SCALE * batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64).reshape(-1, d)


def _least_kind(top: int) -> np.dtype:
    return next(k for k in _KINDS if top < np.iinfo(k).max)


def fit_blocks(vectors: DataFrame, column: str, d: int) -> DataFrame:
    """(n, width, data): the distinct x vectors, many to a row, each entry in as few bytes as the block needs. A vector's own bytes, in
    the least width that holds it, tell it from others."""

    def packed(batch: pa.RecordBatch):
        x = _matrix(batch, column, d)
        top = np.abs(x).max(axis=1, initial=0)
        low = 0
        for kind in _KINDS:
            high = np.iinfo(kind).max
            some = x[(top >= low) & (top < high)].astype(kind)
            low = high
            if len(some):
                ends = pa.py_buffer((np.arange(len(some) + 1) * kind.itemsize * d).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(some), [None, ends, pa.py_buffer(some)])], names=["x"])

    rows = max(1, BLOCK_BYTES // (8 * d))

    def blocks(batches):
        held, n = [], 0
        for batch in batches:
            held += batch.column("x").to_pylist()
            n += batch.num_rows
            while len(held) >= rows:
                yield out(held[:rows])
                held = held[rows:]
        if held:
            yield out(held)

    def out(held):
        x = np.concatenate([np.frombuffer(h, f"<i{len(h) // d}").astype(np.int64)[None, :] for h in held])
        kind = _least_kind(int(np.abs(x).max()))
        return pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int32()), pa.array([kind.itemsize], pa.int32()), pa.array([x.astype(kind).tobytes()], pa.binary())], names=["n", "width", "data"])

    distinct = map_texts(vectors, [column], "x binary", packed, max(1, (8 << 20) // (8 * d))).distinct()
    return written(distinct.mapInArrow(blocks, "n int, width int, data binary"))


class Covariance:
    """Covariance of the fit list as an operator: n, S (exact, of x - SHIFT), trace, and products with few directions."""

    def __init__(self, blocks: DataFrame, d: int):
        self.blocks, self.d = blocks, d
        self.tasks = max(1, blocks.rdd.getNumPartitions())
        parts = self._sum(_moments(d), 2 * d + 1, np.int64)
        self.n = int(parts[-1])
        # of each entry the bits from 2**31 up and those below are added apart
        self.sums = [int(h) * 2**31 + int(low) for h, low in zip(parts[:d], parts[d : 2 * d], strict=True)]
        self.mean = np.array([s / self.n if self.n else 0.0 for s in self.sums])
        self.trace = float(self._sum(_squares(self.mean), 1, np.float64)[0]) / self.n if self.n else 0.0
        self.products = 0

    def _sum(self, each: Callable, size: int, dtype) -> np.ndarray:
        d = self.d

        def run(batches):
            total = None
            for batch in batches:
                for width, data in zip(batch.column("width").to_pylist(), batch.column("data").to_pylist(), strict=True):
                    part = each(np.frombuffer(data, f"<i{width}").reshape(-1, d))
                    total = part if total is None else total + part
            return total

        return summed(self.blocks, run, self.tasks, size, dtype)

    def times(self, u: np.ndarray) -> np.ndarray:
        self.products += 1
        return self._sum(_product(self.mean, u), u.size, np.float64).reshape(u.shape) / self.n

    def projected(self, u: np.ndarray) -> np.ndarray:
        """Covariance of the rows' projections on u."""
        return self._sum(_gram(self.mean, u), u.shape[1] ** 2, np.float64).reshape(u.shape[1], -1) / self.n


def _moments(d: int) -> Callable:
    def each(x):
        x = x.astype(np.int64)
        return np.concatenate([(x >> 31).sum(axis=0), (x & (2**31 - 1)).sum(axis=0), [len(x)]])

    return each


def _squares(mean: np.ndarray) -> Callable:
    return lambda x: np.array([((x - mean) ** 2).sum()])


def _product(mean: np.ndarray, u: np.ndarray) -> Callable:
    def each(x):
        c = x - mean
        return c.T @ (c @ u)

    return each


def _gram(mean: np.ndarray, u: np.ndarray) -> Callable:
    def each(x):
        z = (x - mean) @ u
        return z.T @ z

    return each


def _minres(times: Callable, values: np.ndarray, q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rough solutions t of (I - qq')(V - e I)(I - qq') t = b, a column for each value e, by MINRES; the columns share their products."""
    project = lambda x: x - q @ (q.T @ x)
    unit = lambda x, s: np.divide(x, s, out=np.zeros_like(x), where=s > 0)
    r = project(b)
    first = beta = np.linalg.norm(r, axis=0)
    v, v_old = unit(r, beta), np.zeros_like(r)
    w = w_old = x = np.zeros_like(r)
    eta, c, c_old, s, s_old = beta.copy(), np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(STEPS):
        y = project(times(v) - v * values)
        alpha = (v * y).sum(axis=0)
        y = y - alpha * v - beta * v_old
        following = np.linalg.norm(y, axis=0)
        turned = c * alpha - c_old * s * beta
        rho, rho_2, rho_3 = np.hypot(turned, following), s * alpha + c_old * c * beta, s_old * beta
        c_old, s_old = c, s
        c, s = unit(turned, rho), unit(following, rho)
        w, w_old = unit(v - rho_3 * w_old - rho_2 * w, rho), w
        x = x + c * eta * w
        eta = -s * eta
        v, v_old, beta = unit(y, following), v, following
        if (np.abs(eta) <= GOAL * first).all():
            break
    return project(x)


def _orthogonal(t: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """Orthonormal basis of what the columns of t add to the others' spaces."""
    t = t / np.maximum(np.linalg.norm(t, axis=0), np.finfo(float).tiny)
    for _ in range(3):
        for q in others:
            t = t - q @ (q.T @ t)
        u, s, _ = np.linalg.svd(t, full_matrices=False)
        t = u[:, s > 1e-8 * max(1.0, s[0] if len(s) else 0)] if t.shape[1] else t
    return t


def leading_pairs(times: Callable, d: int, want: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `want` largest eigenvalues of the symmetric operator on d dimensions, their unit vectors, and the residuals' norms."""
    draw = np.random.RandomState(12)
    space = _orthogonal(draw.standard_normal((d, min(d, want + SPARE))))
    image = times(space)
    locked, values, history = np.zeros((d, 0)), np.zeros(0), []
    while True:
        h = space.T @ image
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        space, image = space @ s, image @ s
        residual = image - space * theta
        size = np.linalg.norm(residual, axis=0)
        scale = np.abs(np.concatenate([theta[:1], values[:1]])).max(initial=np.finfo(float).tiny)
        whole = space.shape[1] + locked.shape[1] >= d
        need = want - locked.shape[1]
        # the first pair not locked, as long as it has got no better in three rounds
        history.append((locked.shape[1], size[0] / scale if len(size) else 0.0))
        stalled = len(history) > 3 and len({k for k, _ in history[-4:]}) == 1 and history[-1][1] > history[-4][1] / 2
        good = 0
        while good < len(theta) and (whole or size[good] <= (STALLED if stalled else TOLERANCE) * scale) and (good < need or theta[good] > min([*values, *theta[:good]])):
            good += 1
        locked, values = np.hstack([locked, space[:, :good]]), np.concatenate([values, theta[:good]])
        space, image, theta, residual, size = space[:, good:], image[:, good:], theta[good:], residual[:, good:], size[good:]
        need = want - locked.shape[1]
        if not len(theta) or need <= 0 and theta[0] <= np.sort(values)[-want] + TOLERANCE * scale:
            break
        if space.shape[1] > SPACE:
            keep = max(need, 1) + SPARE
            space, image = space[:, :keep], image[:, :keep]
        some = np.flatnonzero(size[: max(need, 1)] > TOLERANCE * scale)
        present = space[:, : max(need, 1)]
        correction = _minres(times, theta[some], _orthogonal(np.hstack([locked, present])), -residual[:, some])
        fresh = _orthogonal(correction, locked, space)
        if not fresh.shape[1]:
            fresh = _orthogonal(draw.standard_normal((d, 2)), locked, space)
        if fresh.shape[1]:
            space, image = np.hstack([space, fresh]), np.hstack([image, times(fresh)])
    basis = _orthogonal(locked)
    image = times(basis)
    h = basis.T @ image
    theta, s = np.linalg.eigh((h + h.T) / 2)
    at = np.argsort(-theta, kind="stable")[:want]
    vectors, image, theta = basis @ s[:, at], image @ s[:, at], theta[at]
    return theta, vectors, np.linalg.norm(image - vectors * theta, axis=0)


def whitened(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row and component."""
    rows = usable(vectors, column)
    sizes = rows.groupBy(F.size(column).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    schema = f"{key} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], schema)
    d = sizes.d
    rows = rows.where(F.size(column) == d)
    v = Covariance(fit_blocks(rows, column, d), d)
    k = min(components, d)
    e, u, _ = leading_pairs(v.times, d, k)
    u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    varies = e > 64 * d * np.finfo(float).eps * max(e[0], 0.0)
    scaled = u[:, varies] / np.sqrt(e[varies])
    error = float(np.abs(v.projected(scaled) - np.eye(scaled.shape[1])).max()) if varies.any() else None
    share = [float(x) / v.trace if v.trace > 0 else None for x in np.maximum(e, 0.0)]
    n, mean, sums = v.n, v.mean, v.sums
    whole = np.array([float(s) for s in sums])

    def deviation(x: np.ndarray) -> list:
        off = n * x.astype(np.float64) - whole
        if n * np.abs(x).max(initial=0).astype(float) + np.abs(whole).max() < 2**61 and (off**2).sum(axis=1).max(initial=0) < 2**62:
            off = n * x - np.array(sums, np.int64)
            return (off * off).sum(axis=1).tolist()
        exact = [sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x.tolist()]
        return [t if t < 2**63 else None for t in exact]

    def each(batch: pa.RecordBatch):
        x = _matrix(batch, column, d)
        z = np.full((len(x), k), np.nan)
        z[:, varies] = (x - mean) @ scaled
        of = np.repeat(np.arange(len(x)), k)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(key).take(pa.array(of)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(of), n, np.int64)), pa.array(deviation(x), pa.int64()).take(pa.array(of)),
                pa.array(z.reshape(-1), from_pandas=True), pa.array(share * len(x), pa.float64()), pa.array([error] * len(of), pa.float64()),
            ],
            names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
        )

    return map_texts(rows.select(F.col(key).cast("long").alias(key), column), [key, column], schema, each)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
