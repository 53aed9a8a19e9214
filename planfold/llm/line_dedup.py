"""Line dedup: lines are hashed, distinct documents counted for each hash, and frequent lines dropped from all documents but one.

A line's key is the line without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased. Keys of at least MIN_CHARS code points found in at least
MIN_DOCS documents lose all their lines except in the largest doc_id that holds them. Documents are put together again from the
lines left, in order, joined by a line feed.

Only hashes are shuffled to find the keys (128 bits: xxhash64, murmur3 and CRC-32); documents are counted distinct after partial
sums. The frequent keys are written before they meet the lines, so that what both sides hold is known: up to BROADCAST_IDS keys go to
the tasks, more are joined by a shuffle of their own, whose hot keys Spark splits. In the same way texts only move where the lines to
drop are too many to be sent to the scan.

Defined results: null or empty text is one empty line; rows that repeat a doc_id count as one document; rows without doc_id are
neither counted nor changed. Extra columns are ignored by deduplicated_lines()."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planfold.llm.common import LOWER_AZ, UPPER_AZ, few, table, written

MIN_CHARS, MIN_DOCS = 40, 5
_KEY = f"translate(trim(both ' \\t\\n\\u000b\\u000c\\r' from l), '{UPPER_AZ}', '{LOWER_AZ}')"


def deduplicated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_lines, n_dropped, text (the lines left)."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    each = docs.where("doc_id is not null").select("doc_id", "th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "l")).where(F.length("l") >= min_chars)
    keys = each.selectExpr("doc_id", "th", "pos", f"{_KEY} as k").where(F.length("k") >= min_chars)
    lines = written(keys.selectExpr("doc_id", "th", "pos", "xxhash64(k) as h", "cast(hash(k) as bigint) * 4294967296 + crc32(k) as g"))
    counted = lines.groupBy("h", "g").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("last"))
    frequent = written(counted.where(F.col("n") >= min_docs).select("h", "g", "last"))
    drops = lines.join(few(frequent), ["h", "g"]).where("doc_id <> last").groupBy("doc_id", "th").agg(F.collect_set("pos").alias("gone"))
    drops = written(drops)
    out = docs.join(few(drops, F.size("gone")), ["doc_id", "th"], "left").withColumn("lines", F.split("text", "\n", -1))
    left = "case when gone is null then lines else transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i]) end"
    out = out.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.expr(left).alias("left"))
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.size("left")).alias("n_dropped"), F.array_join("left", "\n").alias("text"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


_SQL_KEY = f"translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER_AZ}', '{LOWER_AZ}')"
ORACLE_SQL = f"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
keyed as (select doc_id, pos, l, {_SQL_KEY} as k from lines),
frequent as (select k, max(doc_id) as last from keyed where length(k) >= {MIN_CHARS} group by k having count(distinct doc_id) >= {MIN_DOCS}),
judged as (select doc_id, pos, l, f.k is not null and f.last <> doc_id as gone from keyed left join frequent f using (k))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(l, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from judged group by doc_id
"""
