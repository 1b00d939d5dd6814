"""Problem 1: references to records that do not exist, or not at that point.

Parents are integer intervals ``[lo, hi)`` within a group (a key's time in force in microseconds, or
the ids of a table per snapshot, each an interval of length one). Sorted and compressed they form
contiguous runs; a reference is matched as-of to the run that starts at or before it and is an orphan
when it lies beyond that run's end or before the first run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: 90 days in microseconds: a block of the time axis.
TIME_BLOCK = 90 * 86_400_000_000
#: Ids per block of an id axis; a block holds at most half as many runs.
ID_BLOCK = 256


def contiguous_runs(parents: DataFrame, keys: Sequence[str], lo: str, hi: str, block: int, last: int) -> DataFrame:
    """Runs of integer parent intervals, cut at blocks of the axis.

    Returns ``keys``, ``_blk`` and ``_runs`` (sorted array of ``{lo, hi}``), one row per key and block
    that holds a run. Rows with a null ``lo`` or any null key name nothing and are left out; a null
    ``hi`` is open-ended; ``last`` is the greatest point ever looked up. Overlapping and touching
    intervals and repeated rows merge.
    """
    p = parents.select(*keys, F.col(lo).cast("long").alias("_lo"), F.coalesce(F.col(hi).cast("long"), F.lit(last + 1)).alias("_hi"))
    p = p.dropna(subset=[*keys, "_lo"]).withColumn("_hi", F.least("_hi", F.lit(last + 1))).where("_hi > _lo")
    p = p.groupBy(*keys, "_lo").agg(F.max("_hi").alias("_hi"))
    b = F.lit(block)
    at = F.explode(F.sequence(F.floor(F.col("_lo") / b), F.floor((F.col("_hi") - 1) / b)))
    p = p.withColumn("_blk", at)
    p = p.withColumn("_lo", F.greatest("_lo", F.col("_blk") * b)).withColumn("_hi", F.least("_hi", (F.col("_blk") + 1) * b))
    before = W.partitionBy(*keys, "_blk").orderBy("_lo").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(*keys, "_blk").orderBy("_lo").rowsBetween(W.unboundedPreceding, 0)
    p = p.withColumn("_new", (F.col("_lo") > F.coalesce(F.max("_hi").over(before), F.col("_lo") - 1)).cast("int"))
    p = p.withColumn("_run", F.sum("_new").over(upto))
    p = p.groupBy(*keys, "_blk", "_run").agg(F.min("_lo").alias("lo"), F.max("_hi").alias("hi"))
    return p.groupBy(*keys, "_blk").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("_runs"))


def orphans(
    refs: DataFrame,
    record: str,
    keys: Sequence[Column | str],
    point: Column | str,
    parents: DataFrame,
    parent_keys: Sequence[Column | str],
    lo: Column | str,
    hi: Column | str | None,
    block: int,
    carry: Sequence[str] = (),
    refers: Sequence[int] | None = None,
) -> DataFrame:
    """The references for which no parent is in force at ``point``.

    Returns ``record`` and the ``carry`` columns. ``refers`` holds the places in ``keys`` of the columns that refer, by default
    all. A row with a null among these is no reference; one with a null in another key or a null
    ``point`` can match nothing and is an orphan. Repeated rows come out once. An empty parent table makes every reference an orphan, an empty reference table gives no
    rows. Other columns of either table are never touched, so their names cannot clash.
    """
    as_col = lambda x: F.col(x) if isinstance(x, str) else x
    n = len(keys)
    k = [f"_k{i}" for i in range(n)]
    r = refs.select(
        F.col(record).alias("_rec"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)],
        *[as_col(c).alias(a) for c, a in zip(keys, k)], as_col(point).cast("long").alias("_p"),
    ).dropna(subset=k if refers is None else [k[i] for i in refers])
    last = r.agg(F.max("_p")).first()[0]
    last = 0 if last is None else last
    open_end = F.lit(None).cast("long") if hi is None else as_col(hi).cast("long")
    p = parents.select(*[as_col(c).alias(a) for c, a in zip(parent_keys, k)], as_col(lo).cast("long").alias("_l"), open_end.alias("_h"))
    runs = contiguous_runs(p, k, "_l", "_h", block, last)
    r = r.withColumn("_blk", F.floor(F.col("_p") / F.lit(block)))
    # The reference side is never the build side, so a hot key is split by adaptive skew joins.
    j = r.join(runs, [*k, "_blk"], "left")
    preceding = F.try_element_at(F.filter("_runs", lambda x: x["lo"] <= F.col("_p")), F.lit(-1))
    found = F.coalesce(preceding["hi"] > F.col("_p"), F.lit(False))
    out = j.where(~found).select(F.col("_rec").alias(record), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)])
    return out.distinct()
