"""Running totals over a whole table in a global order, with no task that sees more than one range of it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planfold.llm.common import cut


def running_totals(df: DataFrame, order: list, value: str, place: str = "place", upto: str = "upto") -> DataFrame:
    """df with place (0, 1, 2, ... in the given order) and upto (sum of value up to and with the row).

    The rows are range-partitioned and sorted, and this layout is frozen by a checkpoint. Each range's count and sum (one row for
    each partition) come to the driver; then every range adds what lies before it. Columns that break ties make reruns agree."""
    laid = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()))
    starts, n, total = {}, 0, 0
    for r in laid.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("v")).orderBy("_range").collect():
        starts[r._range] = (n, total)
        n, total = n + r.n, total + (r.v or 0)
    schema = T.StructType([*df.schema.fields, T.StructField(place, T.LongType()), T.StructField(upto, T.LongType())])
    names = [f.name for f in df.schema.fields]

    def run(batches):
        at = None
        for batch in batches:
            if batch.num_rows:
                at = at or starts[batch.column("_range")[0].as_py()]
                values = batch.column(value).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                sums = at[1] + np.cumsum(values)
                places = at[0] + np.arange(batch.num_rows)
                at = (at[0] + batch.num_rows, int(sums[-1]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(places), pa.array(sums)], names=[*names, place, upto])

    return laid.mapInArrow(run, schema)
