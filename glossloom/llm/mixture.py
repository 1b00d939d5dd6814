"""Problem 9: sources mixed to target shares of all tokens, with capped repeats, by Pareto order sampling.

The total is given, or the largest at which no source needs more copies than allowed. A source's
documents all get the certain whole copies; the rest of its budget is filled by Pareto order sampling of
a fixed number of documents: each has an inclusion probability and a random number, and those with the
least quotient of random odds and inclusion odds are taken. Probabilities fall with the root of a
document's size; where one would pass 1 the document is certain and the excess goes to the others,
found exactly from the numbers of documents per size. The fixed number is that at which the tokens
expected are the budget. The cut is found on a histogram of the quotients and then exactly within one
bin, so no source is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from glossloom.llm.tokens import DEFAULT_VOCABULARY, token_count
from glossloom.session import Scratch

BINS = 65536
#: Sources up to which their plan is sent to every task.
MOST_SOURCES = 10_000


def random_draw(key: Column, seed: int) -> Column:
    """A number in (0, 1) fixed by key and seed, so that a lost task draws the same again."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 12).cast("double")
    return (bits + 0.5) / float(1 << 52)


def sized(spark: SparkSession, documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``doc_id``, ``source``, ``tokens`` of each document once, kept in a table because it is read twice."""
    docs = documents.where("doc_id is not null and source is not null and text is not null").selectExpr("doc_id", "source", "text")
    counted = docs.select("doc_id", "source", token_count("text", vocabulary).alias("tokens"))
    return Scratch(spark).save(counted.groupBy("doc_id").agg(F.min("source").alias("source"), F.max("tokens").alias("tokens")))


def plan(sizes: DataFrame, weights: DataFrame, total: float | None = None) -> DataFrame:
    """Per source of the list: budget, whole copies for all and tokens left to sample.

    Shares are scaled to the sources that have tokens. Without a ``total`` the scarcest source sets it;
    with one, a source that can't reach its share of it gives all its copies and the others keep to their
    budgets. Repeated rows of the list count once; rows with a null source, share or cap, or a share or
    cap of zero or below, are left out.
    """
    w = weights.select("source", F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats")).distinct()
    w = w.dropna().where("target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    have = sizes.where("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("have"), F.count(F.lit(1)).alias("docs"))
    all_ = W.partitionBy()  # one row per source of the list
    p = w.join(have, "source", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    there = F.when(F.col("have") > 0, F.col("target_share"))
    p = p.withColumn("share", there / F.sum(there).over(all_))
    most = F.min(F.col("max_repeats") * F.col("have") / F.col("share")).over(all_)
    p = p.withColumn("total", most if total is None else F.lit(float(total)))
    p = p.withColumn("budget", F.least(F.col("share") * F.col("total"), F.col("max_repeats") * F.col("have").cast("double")))
    p = p.withColumn("whole", F.floor(F.col("budget") / F.col("have") + 1e-12).cast("int"))
    rest = F.col("budget") - F.col("whole") * F.col("have")
    # Less than half a token is rounding; at the cap nothing is left to sample.
    return p.withColumn("rest", F.when((rest < 0.5) | (F.col("whole") >= F.col("max_repeats")), F.lit(0.0)).otherwise(rest))


def _certain(per_size: DataFrame, goal: str, weight: Column) -> DataFrame:
    """Per source the size up to which documents are certain and the rate ``c`` of the others' probability ``c / sqrt(tokens)``.

    The probabilities times ``weight`` sum up to ``goal``. ``per_size`` has a row per source and size, so a
    source's window holds no more rows than there are different sizes.
    """
    by = W.partitionBy("source").orderBy("tokens")
    before = F.coalesce(F.sum(F.col("n") * weight).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum(F.col("n") * weight / F.sqrt("tokens")).over(by.rowsBetween(W.currentRow, W.unboundedFollowing))
    x = per_size.withColumn("_c", (F.col(goal) - before) / onward).withColumn("_sure", F.col("_c") >= F.sqrt("tokens"))
    return x.groupBy("source").agg(F.coalesce(F.max(F.when(F.col("_sure"), F.col("tokens"))), F.lit(0)).alias("upto"), F.min_by(F.when(~F.col("_sure"), F.col("_c")), F.when(~F.col("_sure"), F.col("tokens"))).alias("c"))


def draw_plan(sizes: DataFrame, weights: DataFrame, total: float | None = None) -> DataFrame:
    """Per source with tokens: ``whole``, the number ``take`` of documents to sample, ``upto`` and ``c``.

    A document's inclusion probability is 1 up to ``upto`` tokens and ``c / sqrt(tokens)`` beyond; they sum up to ``take``.
    """
    p = plan(sizes, weights, total).where("have > 0").select("source", "whole", "rest")
    per_size = sizes.where("tokens > 0").groupBy("source", "tokens").agg(F.count(F.lit(1)).cast("double").alias("n")).join(p.where("rest > 0"), "source")
    hit = _certain(per_size, "rest", F.col("tokens")).select(F.col("source").alias("_s"), "upto", "c")
    pi = F.when(F.col("tokens") <= F.col("upto"), 1.0).otherwise(F.col("c") / F.sqrt("tokens"))
    per_size = per_size.join(hit, F.col("source") == F.col("_s")).withColumn("_pi", F.coalesce(pi, F.lit(1.0)))
    take = per_size.groupBy("source").agg(F.round(F.sum(F.col("n") * F.col("_pi"))).alias("take")).select(F.col("source").alias("_t"), "take")
    fixed = per_size.select("source", "tokens", "n").join(take, F.col("source") == F.col("_t"))
    rate = _certain(fixed, "take", F.lit(1.0)).select(F.col("source").alias("_r"), "upto", "c")
    out = p.join(take, F.col("source") == F.col("_t"), "left").join(rate, F.col("source") == F.col("_r"), "left")
    return out.select("source", "whole", F.coalesce("take", F.lit(0.0)).cast("long").alias("take"), "upto", "c")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """A table to be sent to every task if it has few rows; else joins choose for themselves."""
    return F.broadcast(df) if rows <= MOST_SOURCES else df


def mixture(sizes: DataFrame, weights: DataFrame, seed: int = 1, total: float | None = None) -> DataFrame:
    """``doc_id``, ``source``, ``tokens``, ``copies`` of the documents drawn.

    No document gets more than its source's ``max_repeats`` copies. The number of documents sampled beyond
    the whole copies is fixed, so a source's tokens miss its budget only by the spread of sizes; a seed
    gives one draw. Sources not on the list and empty texts are not drawn.
    """
    scratch = Scratch(sizes.sparkSession)
    p = scratch.save(draw_plan(sizes, weights, total).withColumnRenamed("source", "_s"), n=F.count(F.lit(1)))
    n = scratch.metric(p, "n")
    d = sizes.where("tokens > 0").join(_small(p, n), F.col("source") == F.col("_s"))
    u = random_draw(F.col("doc_id"), seed)
    pi = F.when(F.col("tokens") <= F.col("upto"), 1.0).otherwise(F.col("c") / F.sqrt("tokens"))
    quotient = F.when(pi >= 1, 0.0).otherwise((u / (1 - u)) / (pi / (1 - pi)))
    d = d.withColumn("_q", F.when(F.col("take") > 0, quotient))
    d = d.withColumn("_bin", F.least(F.floor(F.col("_q") / (1 + F.col("_q")) * BINS), F.lit(BINS - 1)).cast("int"))

    # The bin the last document is in, and how many are in the bins before.
    bins = d.where("_q is not null").groupBy("source", "_bin").agg(F.count(F.lit(1)).alias("_n"), F.max("take").alias("_r"))
    bins = bins.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy("source").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    cut = bins.where("_before < _r and _before + _n >= _r").select(F.col("source").alias("_cs"), F.col("_bin").alias("_cb"), "_before")
    d = d.join(_small(cut, n), F.col("source") == F.col("_cs"), "left")
    below = d.where("_q is null or _bin <> _cb").withColumn("_in", F.coalesce(F.col("_bin") < F.col("_cb"), F.lit(False)))
    rank = F.row_number().over(W.partitionBy("source").orderBy("_q", "doc_id"))
    edge = d.where("_bin = _cb").withColumn("_in", F.col("_before") + rank <= F.col("take"))
    drawn = below.unionByName(edge).withColumn("copies", (F.col("whole") + F.col("_in").cast("int")).cast("int"))
    return drawn.where("copies > 0").select("doc_id", "source", "tokens", "copies")


def shares(sizes: DataFrame, weights: DataFrame, seed: int = 1, total: float | None = None) -> DataFrame:
    """Per source: target, attainable and actual share, tokens, documents and copies in the mixture.

    Sources of the list without documents and sources without a place on the list come out with 0.
    """
    m = mixture(sizes, weights, seed, total).groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens_drawn"), F.count(F.lit(1)).alias("docs_drawn"), F.max("copies").alias("most_copies")
    )
    p = plan(sizes, weights, total).select(F.col("source").alias("_s"), "target_share", F.col("share").alias("attainable_share"), "max_repeats")
    rest = sizes.select(F.col("source").alias("_n")).distinct()
    p = p.join(rest, F.col("_s") == F.col("_n"), "full").select(F.coalesce("_s", "_n").alias("_s"), "target_share", "attainable_share", "max_repeats")
    out = p.join(m, F.col("_s") == F.col("source"), "left").drop("source")
    whole = F.sum("tokens_drawn").over(W.partitionBy())  # one row per source
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(
        F.col("_s").alias("source"), "target_share", "attainable_share", (F.coalesce("tokens_drawn", F.lit(0)) / whole).alias("actual_share"),
        zero("tokens_drawn"), zero("docs_drawn"), zero("most_copies"), "max_repeats",
    )
