"""Mixing sources to target weights by weighted fair queueing.

Sources in code-point order (null last) weigh WEIGHTS, repeating, and share the budget: all sizes together. A target stops at MOST
times its source's size; the excess is shared again by weight until none is above. Each document, shuffled by a hash, gets a virtual
finish time: its source's tokens up to and with it, divided by the source's target. Copies of later rounds (a source may be gone
through MOST times) finish one source size later each. All copies are range-sorted by finish time over the whole cluster and cut off
where their running total passes the budget, so each source stops within a document of its target.

Totals run over ranges (order.running_totals), never over one source in one task, whatever share a source has.

Defined results: null text has size 0; documents of size 0 take nothing, and mixed() keeps one of each; a source of size 0 has target
0; rows that repeat are documents of their own, and in mixed() rows equal in doc_id, source and text share their copies evenly,
rounded down. Extra columns are ignored by mix() and kept by mixed()."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planfold.llm.common import cut, size_word_rule, table
from planfold.llm.order import running_totals

WEIGHTS, MOST, SEED = (5, 2, 1), 3, 17


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> tuple[DataFrame, int]:
    """sizes(source, size) -> (source, source_size, before, weight, target), and the budget."""
    sums = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    ranked = running_totals(sums.withColumn("none", F.col("source").isNull()), ["none", "source"], "source_size")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = cut(ranked.select("source", "source_size", "place", (F.col("upto") - F.col("source_size")).alias("before"), weight.alias("weight")))
    budget = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:  # each round caps at least one more source; most corpora need a few
        above = F.col("weight") * F.lit(level) > most * F.col("source_size")
        row = ranked.agg(F.sum(F.when(above, most * F.col("source_size")).otherwise(0)).alias("full"), F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("open"), F.sum(above.cast("int")).alias("n")).first()
        if not row.open or row.n == capped:
            break
        capped, level = row.n, (budget - row.full) / row.open
    target = F.least(most * F.col("source_size").cast("double"), F.col("weight") * F.lit(float(level)))
    return ranked.withColumn("target", target), budget


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, size, source_size, target, taken, copies, h (the hash that shuffles)."""
    sized = docs.select("doc_id", "source", size_word_rule(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "source", "text").alias("h"))
    sized = cut(sized)
    targets, budget = source_targets(sized, weights, most)
    ranked = running_totals(sized.join(targets, sized.source.eqNullSafe(targets.source)).drop(targets.source), ["place", "h", "doc_id"], "size", "row", "upto")
    finish = lambda e: (F.lit(e) * F.col("source_size") + F.col("upto") - F.col("before")) / F.col("target")
    timed = cut(ranked.withColumn("finish", F.when(F.col("target") > 0, F.array(*(finish(e) for e in range(most))))))
    # every copy, in the order of finish times; those after time 2 can't be reached, as all targets are met at time 1
    copies = timed.where("size > 0").select("row", "size", F.posexplode("finish").alias("round", "time")).where("time <= 2")
    queued = running_totals(copies, ["time", "row", "round"], "size", "turn", "used")
    last = queued.where(F.col("used") <= budget).agg(F.max(F.struct("time", "row", "round")).alias("last")).first()["last"]
    served = F.lit(0)
    if last is not None:
        edge = F.struct(F.lit(last["time"]), F.lit(last["row"]).cast("long"), F.lit(last["round"]).cast("int"))
        for e in range(most):
            served = served + F.when(F.struct(F.element_at("finish", e + 1), "row", F.lit(e).cast("int")) <= edge, 1).otherwise(0)
    n = F.when(F.col("size") == 0, 1).when(F.col("target") > 0, served).otherwise(0)
    out = timed.withColumn("copies", n.cast("int"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "h")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """docs as the mix takes them: each row as many times as it has copies."""
    plan = mix(docs, weights, most, seed).groupBy("h").agg(F.floor(F.sum("copies") / F.count(F.lit(1))).cast("int").alias("_copies")).where("_copies > 0")
    plan = plan.withColumnRenamed("h", "_mix_h")
    rows = docs.select("*", F.xxhash64(F.lit(seed), "doc_id", "source", "text").alias("_mix_h")).join(plan, "_mix_h")
    return rows.select(*docs.columns, F.explode(F.sequence(F.lit(1), "_copies")).alias("_copy")).select(*docs.columns)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
