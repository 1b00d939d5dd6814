"""Languages, their sets and varieties: code resolution, lineage and scope, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossloom.functions.text import RENAMED, SHORTHAND, code_map
from glossloom.operators.hierarchy import hierarchy
from glossloom.session import Scratch


def code_dim(languages: DataFrame, varieties: DataFrame) -> DataFrame:
    """``key``, ``code``, ``variety_code``: all codes with the language they file under.

    A variety files under its nearest language, through any number of parents that are varieties; one
    that leads to no language, or only into a loop, has no row. Of equally near languages the least counts.
    """
    scratch = Scratch(varieties.sparkSession)
    own = languages.select(F.col("code").alias("key"), "code", F.lit(None).cast("string").alias("variety_code"), F.lit(0).alias("_level"))
    v = varieties.where("code is not null and parent is not null").select(F.col("code").alias("key"), F.col("parent").alias("_up")).distinct()
    above = v.select(F.col("key").alias("_k2"), F.col("_up").alias("_up2"))
    last = seen = scratch.save(v.withColumn("_level", F.lit(1)))
    while not last.isEmpty():
        up = last.join(above, F.col("_up") == F.col("_k2")).select("key", F.col("_up2").alias("_up"), (F.col("_level") + 1).alias("_level")).distinct()
        # A pair met before closes a loop.
        last = scratch.save(up.join(seen.select("key", "_up"), ["key", "_up"], "left_anti").select("key", "_up", "_level"))
        seen = seen.unionByName(last)
    found = seen.join(own.select(F.col("key").alias("_k"), "code"), F.col("_up") == F.col("_k")).select("key", "code", F.col("key").alias("variety_code"), "_level")
    nearest = own.unionByName(found).groupBy("key").agg(F.min(F.struct("_level", "code", "variety_code")).alias("_n"))
    return nearest.select("key", "_n.code", "_n.variety_code")


def canonical_code(raw: Column | str) -> Column:
    """A code after renames and shorthand."""
    c = F.col(raw) if isinstance(raw, str) else raw
    return F.coalesce(F.try_element_at(code_map(RENAMED), c), F.try_element_at(code_map(SHORTHAND), c), c)


def with_code(df: DataFrame, column: str, dim: DataFrame, code: str, variety: str) -> DataFrame:
    """``df`` with the language and variety a raw code files under, by two joins with the small code table.

    Exact first; else whatever the case, if the part before the first dash agrees exactly. An unknown
    code passes through as itself.
    """
    base = lambda c: F.substring_index(c, "-", 1)
    exact = dim.select(F.col("key").alias("_ek"), F.col("code").alias("_ec"), F.col("variety_code").alias("_ev"))
    loose = dim.groupBy(F.lower("key").alias("_lk"), base("key").alias("_lb")).agg(F.min(F.struct("key", "code", "variety_code")).alias("_l"))
    want = canonical_code(column)
    j = df.join(exact, want == F.col("_ek"), "left").join(loose, (F.lower(want) == F.col("_lk")) & (base(want) == F.col("_lb")), "left")
    known = F.col("_ek").isNotNull()
    j = j.withColumns({
        code: F.when(known, F.col("_ec")).otherwise(F.coalesce("_l.code", want)), variety: F.when(known, F.col("_ev")).otherwise(F.col("_l.variety_code"))
    })
    return j.drop("_ek", "_ec", "_ev", "_lk", "_lb", "_l")


def resolve(codes: DataFrame, column: str, dim: DataFrame) -> DataFrame:
    """``column``, ``code``, ``variety_code`` for each distinct raw code."""
    return with_code(codes.select(column).where(F.col(column).isNotNull()).distinct(), column, dim, "code", "variety_code")


def is_reconstructed_code(code: Column | str, kind: Column | str | None = None) -> Column:
    """Whether a code names a reconstructed language; an unknown code does if it ends in ``-pro``."""
    c = F.col(code) if isinstance(code, str) else code
    known = F.lit(None).cast("boolean") if kind is None else (F.col(kind) if isinstance(kind, str) else kind) == "reconstructed"
    return F.coalesce(known, c.endswith("-pro"))


def set_paths(spark: SparkSession, sets: DataFrame) -> DataFrame:
    """``code``, ``root``, ``path`` (root first, joined by colons), ``depth`` of each language set."""
    h = hierarchy(spark, sets.select(F.lit("set").alias("tree"), F.col("code").alias("node"), F.col("superset").alias("parent")))
    return h.select(F.col("node").alias("code"), "root", F.array_join("path", ":").alias("path"), "depth")


def in_scope(entries: DataFrame, lang: str, languages: DataFrame, paths: DataFrame, families: list[str]) -> DataFrame:
    """The entries whose language belongs to one of the root ``families``.

    An unknown code is tried once more as the part before its first dash.
    """
    root = languages.select(F.col("code").alias("_lc"), "family").join(paths.select(F.col("code").alias("_pc"), "root"), F.col("family") == F.col("_pc"), "left")
    root = root.select("_lc", F.coalesce("root", "family").alias("_root"))
    alt = root.select(F.col("_lc").alias("_lc2"), F.col("_root").alias("_root2"))
    e = entries.join(root, F.col(lang) == F.col("_lc"), "left").join(alt, F.substring_index(lang, "-", 1) == F.col("_lc2"), "left")
    chosen = F.when(F.col("_lc").isNotNull(), F.col("_root")).otherwise(F.col("_root2"))
    return e.where(chosen.isin(*families)).select(*[entries[c] for c in entries.columns])


def colliding_codes(*dims: DataFrame) -> DataFrame:
    """Codes that differ only in case between the given tables of ``code``."""
    codes = dims[0].select("code")
    for x in dims[1:]:
        codes = codes.unionByName(x.select("code"))
    n = codes.distinct().groupBy(F.lower("code").alias("folded")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("code")), ",").alias("codes"))
    return n.where("n > 1")
