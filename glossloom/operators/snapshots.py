"""Problem 2: what changed between consecutive full snapshots of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def next_date(snap: DataFrame, date: str) -> DataFrame:
    """Each snapshot date with the one before and the one after it; one row per snapshot ever taken."""
    d = snap.select(F.col(date).alias("_d")).where(F.col(date).isNotNull()).distinct()
    w = W.orderBy("_d")
    return d.select("_d", F.lag("_d").over(w).alias("_prev"), F.lead("_d").over(w).alias("_next"))


def changes(snap: DataFrame, date: str, key: str, ignore: Sequence[str] = (), repeated_rows_once: bool = True) -> DataFrame:
    """Records added, removed or changed between each snapshot and the next.

    ``EXCEPT ALL`` both ways between a snapshot and its successor: both differences come from one
    signed count over whole rows (the plan Catalyst rewrites each ``EXCEPT ALL`` into, shared by the
    two directions), so identical rows are gone before any record is compared. The residues of the two
    directions are then full-joined by date and key.

    Returns ``dump_date`` (the later date), ``record_id``, ``change_kind``. Columns in ``ignore`` do not
    count; null equals null and differs from any value. With ``repeated_rows_once`` repeated rows of a
    snapshot count once, else a differing number of copies is a change. Rows without a date belong to
    no snapshot; a null key is compared like any other key. One snapshot or none gives no rows.
    """
    cols = [c for c in snap.columns if c not in {date, key, *ignore}]
    rows = snap.select(F.col(date).alias("_d"), F.col(key).alias("_key"), *[F.col(c).alias(f"_v{i}") for i, c in enumerate(cols)])
    v = [f"_v{i}" for i in range(len(cols))]
    dates = next_date(snap, date)
    # As the older side a row stands under the next date, as the newer side under its own.
    sides = F.array(
        F.struct(F.col("_next").alias("at"), F.lit(1).alias("old"), F.lit(0).alias("new")),
        F.struct(F.when(F.col("_prev").isNotNull(), F.col("_d")).alias("at"), F.lit(0).alias("old"), F.lit(1).alias("new")),
    )
    two = rows.join(F.broadcast(dates), "_d").withColumn("_s", F.explode(sides)).where("_s.at is not null")
    signed = two.groupBy(F.col("_s.at").alias("at"), "_key", *v).agg(F.sum("_s.old").alias("old"), F.sum("_s.new").alias("new"))
    if repeated_rows_once:
        signed = signed.withColumn("old", F.least("old", F.lit(1))).withColumn("new", F.least("new", F.lit(1)))
    old_only = signed.where("old > new").select("at", F.col("_key").alias("_ko"), F.lit(True).alias("_gone")).distinct()
    new_only = signed.where("new > old").select(F.col("at").alias("_an"), F.col("_key").alias("_kn"), F.lit(True).alias("_come")).distinct()
    both = old_only.join(new_only, (F.col("at") == F.col("_an")) & F.col("_ko").eqNullSafe(F.col("_kn")), "full")
    return both.select(
        F.date_format(F.coalesce("at", "_an"), "yyyy-MM-dd").alias("dump_date"), F.coalesce("_ko", "_kn").alias("record_id"),
        F.when(F.col("_gone") & F.col("_come"), "changed").when(F.col("_gone"), "removed").otherwise("added").alias("change_kind"),
    )
