"""Problem 4: per-key results where a few keys hold most records.

Rows are grouped by key *and value* before they are grouped by key. After that step a key has one
weighted row per distinct value, spread over all tasks; distinct counts, modes, percentiles and
rankings follow exactly from the weighted values, each with map-side combine.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from glossloom.session import Scratch


def value_frequencies(df: DataFrame, keys: Sequence[str], values: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """One row per key and value with its number of rows ``n_rows`` and the ``extra`` aggregates.

    Null keys and null values are groups of their own.
    """
    return df.groupBy(*keys, *values).agg(F.count(F.lit(1)).alias("n_rows"), *extra)


def top_per_key(df: DataFrame, keys: Sequence[str], value: str, order: str, k: int, min_values: int) -> DataFrame:
    """For each key with at least ``min_values`` distinct values, the ``k`` values with the greatest ``order``.

    Of equal ``order`` the greater value comes first; nulls come last. Returns ``keys``, ``value`` and
    ``rank``. A value that stands in several rows takes its greatest ``order``. A null value is not
    counted and not ranked. The ranking keeps ``k`` rows of a key in each task before it shuffles, so no
    task sees a whole hot key.
    """
    weighted = value_frequencies(df.where(F.col(value).isNotNull()), keys, [value], [F.max(order).alias("_order")])
    w = W.partitionBy(*keys).orderBy(F.col("_order").desc_nulls_last(), F.col(value).desc())
    top = weighted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*keys, value, "rank")
    # Read as one frame of arrays per key so that the join below is on few, short rows.
    best = top.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", value))).alias("_best"))
    # Counted by order so that both branches read the same columns and share one shuffle.
    n = F.count("_order") + F.count_if(F.col("_order").isNull())
    sizes = weighted.groupBy(*keys).agg(n.alias("_n")).where(F.col("_n") >= min_values)
    return best.join(_renamed(sizes, keys), _eq(keys), "left_semi").select(*keys, F.inline("_best").alias("rank", value))


def profile(df: DataFrame, keys: Sequence[str], value: str, block: Callable[[Column], Column], percentile: float = 0.5) -> DataFrame:
    """Per key: rows, distinct values, the most frequent value and a percentile, all exact.

    Returns ``keys``, ``n_rows``, ``n_null``, ``n_distinct``, ``mode_value`` (of equally frequent ones the
    least) and ``percentile_value`` (the least value with at least that share of the non-null rows at or
    below it). A key whose values are all null has nulls there; an empty table gives no rows.

    ``block`` is a monotone, coarser function of the value (a day of a timestamp, a leading digit). The
    running weight is taken over a key's blocks first and then inside the one block that holds the
    percentile, so a hot key's distinct values are never ordered in one task.
    """
    # Written once: three plans read it.
    vf = Scratch(df.sparkSession).save(value_frequencies(df.select(*keys, F.col(value).alias("_v")), keys, ["_v"]))
    mode = F.min_by("_v", F.struct(-F.col("n_rows"), F.col("_v"))).alias("_m")
    blocks = vf.where("_v is not null").groupBy(*keys, block(F.col("_v")).alias("_b")).agg(
        F.sum("n_rows").alias("_w"), F.count(F.lit(1)).alias("_d"), F.max("n_rows").alias("_top"), mode
    )
    over = W.partitionBy(*keys)
    blocks = blocks.withColumn("_upto", F.sum("_w").over(over.orderBy("_b"))).withColumn("_need", F.ceil(F.lit(percentile) * F.sum("_w").over(over)))
    per_key = blocks.groupBy(*keys).agg(
        F.sum("_w").alias("_rows"), F.sum("_d").alias("n_distinct"), F.min_by("_m", F.struct(-F.col("_top"), F.col("_m"))).alias("mode_value"),
        F.min(F.when(F.col("_upto") >= F.col("_need"), F.struct("_b", (F.col("_need") - F.col("_upto") + F.col("_w")).alias("left")))).alias("_at"),
    )
    there = _renamed(per_key.select(*keys, F.col("_at._b").alias("_pb"), F.col("_at.left").alias("_left")), keys)
    inside = vf.where("_v is not null").withColumn("_b", block(F.col("_v")))
    inside = inside.join(there, _eq(keys) & (F.col("_b") == F.col("_pb")))
    inside = inside.withColumn("_run", F.sum("n_rows").over(W.partitionBy(*keys).orderBy("_v"))).where("_run >= _left")
    pct = _renamed(inside.groupBy(*keys).agg(F.min("_v").alias("percentile_value")), keys)
    nulls = vf.groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"), F.sum(F.when(F.col("_v").isNull(), F.col("n_rows")).otherwise(0)).alias("n_null"))
    out = nulls.join(_renamed(per_key.select(*keys, "n_distinct", "mode_value"), keys), _eq(keys), "left").select(
        *nulls.columns, F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), "mode_value"
    )
    return out.join(pct, _eq(keys), "left").select(*keys, "n_rows", "n_null", "n_distinct", "mode_value", "percentile_value")


def _renamed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_r{i}" for i, k in enumerate(keys)})


def _eq(keys: Sequence[str]) -> Column:
    """Null-safe equality of ``keys`` and their counterparts of :func:`_renamed`."""
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r{i}"))
    return cond
