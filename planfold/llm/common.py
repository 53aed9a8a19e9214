"""What the operators of this subpackage share: reading tables, cutting lineage, word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words in most of the contracts: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
#: Ids (16 bytes each) that are broadcast at most.
BROADCAST_IDS = 1_000_000
#: For bytes.translate: A-Z lower-cased, all else kept.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, which the cluster names.

    Only in local mode (tests) a temporary folder takes its place where that is unset; elsewhere that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="planfold-"))
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Small tables of loops: written to the shared checkpoint folder, so a lost executor costs nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Larger intermediate tables: written as Parquet to the shared folder and read back."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame, weight: Column | None = None) -> DataFrame:
    """A written table as the small side of a join: for the tasks where its rows (and what they weigh together) are BROADCAST_IDS at
    most, by a shuffle of both sides beyond."""
    weight = F.lit(0) if weight is None else weight
    rows, heavy = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(weight), F.lit(0))).first()
    return F.broadcast(df) if max(rows, heavy) <= BROADCAST_IDS else df.hint("merge")


def without(docs: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs without the rows whose key is in gone; rows without a key stay. The ids are counted and, up to BROADCAST_IDS of them,
    sent to the scan, so that no text moves; beyond, both sides are shuffled."""
    return docs.join(few(cut(gone.where(F.col(key).isNotNull()).select(key).distinct())), key, "left_anti").select(*docs.columns)


def map_texts(df: DataFrame, columns: list[str], schema: str, each: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], rows: int = 1000) -> DataFrame:
    """mapInArrow over the named columns alone. Spark's batches, which its own limit of bytes bounds, are dealt out in slices of `rows`
    rows at most; no setting of the session is touched."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                yield from each(batch.slice(i, rows))

    return df.select(*columns).mapInArrow(run, schema)


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts as UTF-8 bytes; null counts as empty."""
    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]


def lower_az(text: Column) -> Column:
    """A-Z alone lower-cased, as the contracts ask; lower() would touch other alphabets too."""
    return F.translate(text, UPPER_AZ, LOWER_AZ)


def fold(doc_id: Column) -> Column:
    """Remainder that splits labelled rows: 2 is held out."""
    return F.crc32(doc_id.cast("string")) % 4


def size_word_rule(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text, null as 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")
