"""Sums of dense vectors over tasks, added up as a tree, so that neither the driver nor one task takes in the vectors of all tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors that one task adds up, at each level of the tree.
FAN_IN = 32
_ROWS = "part int, segment int, data binary"


def vector_rows(part: int, vector: np.ndarray, segment: int) -> Iterator[pa.RecordBatch]:
    """A task's vector as rows (part, segment, data) of `segment` entries each; segments of zeros are left out."""
    flat = vector.reshape(-1)
    for k, i in enumerate(range(0, len(flat), segment)):
        piece = flat[i : i + segment]
        if piece.any():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([piece.tobytes()], pa.binary())], names=["part", "segment", "data"])


def summed(rows: DataFrame, each: Callable, tasks: int, size: int, dtype, segment: int = 1 << 16) -> np.ndarray:
    """The sum of the vectors of `size` entries that each(batches, part) gives, one for each of the tasks that read `rows`.

    Up to FAN_IN tasks' vectors are added at a time, in an order fixed by the tasks' numbers, so that reruns agree to the last bit. The
    sum itself, which must be small by its caller's bounds, comes to the driver."""
    kind = np.dtype(dtype)

    def vectors(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        total = each(batches)
        if total is not None:
            yield from vector_rows(part, np.ascontiguousarray(total, kind), segment)

    def added(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("part").to_numpy())
        data = table.column("data").to_pylist()
        total = np.frombuffer(data[order[0]], kind).copy()
        for i in order[1:]:
            total += np.frombuffer(data[i], kind)
        first = table.column("part")[int(order[0])].as_py() // FAN_IN
        return pa.table({"part": pa.array([first], pa.int32()), "segment": table.column("segment")[:1].combine_chunks(), "data": pa.array([total.tobytes()], pa.binary())})

    found, left = rows.mapInArrow(vectors, _ROWS), tasks
    while left > FAN_IN:
        found = found.groupBy("segment", F.floor(F.col("part") / FAN_IN).alias("branch")).applyInArrow(added, _ROWS)
        left = -(-left // FAN_IN)
    out = np.zeros(size, kind)
    for r in sorted(found.collect(), key=lambda r: (r.segment, r.part)):
        piece = np.frombuffer(r.data, kind)
        out[r.segment * segment : r.segment * segment + len(piece)] += piece
    return out
