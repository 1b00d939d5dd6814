"""Edges of rendered etymology trees that the graph lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossloom.functions.text import accent_folded, strip_star
from glossloom.operators.nested import tree_rows
from glossloom.session import Scratch


def tree_edges(trees: DataFrame) -> DataFrame:
    """``tree_id``, parent and child term of each link of rendered trees; a child is its parent's source.

    Nodes with no term make no link. The root's own term comes from the tree's text.
    """
    rows = tree_rows(trees).where("term <> ''")
    root = trees.select("tree_id", F.get_json_object("tree_json", "$.lang").alias("lang"), F.coalesce(F.nullif(F.get_json_object("tree_json", "$.term"), F.lit("")), F.get_json_object("tree_json", "$.alt")).alias("term"))
    nodes = rows.select("tree_id", F.col("node_path").alias("p"), "lang", "term").unionByName(root.distinct().select("tree_id", F.lit("").alias("p"), "lang", "term"))
    up = nodes.select(F.col("tree_id").alias("_t"), F.col("p").alias("_p"), F.col("lang").alias("dst_lang"), F.col("term").alias("dst_term"))
    j = rows.join(up, (F.col("tree_id") == F.col("_t")) & (F.col("parent_path") == F.col("_p")))
    return j.where("dst_term is not null and dst_term <> ''").select("tree_id", "keyword", F.col("lang").alias("src_lang"), F.col("term").alias("src_term"), "dst_lang", "dst_term").distinct()


def folded(c: Column | str) -> Column:
    """A term to compare by: without star, marks and case."""
    return F.lower(accent_folded(strip_star(c)))


def missing(tree: DataFrame, edges: DataFrame) -> DataFrame:
    """Tree links that no edge of the graph states, comparing terms without marks."""
    k = lambda c, a: folded(c).alias(a)
    have = edges.select(F.col("src_lang_code").alias("_sl"), k("src_headword", "_sh"), F.col("dst_lang_code").alias("_dl"), k("dst_headword", "_dh")).distinct()
    t = tree.withColumns({"_a": folded("src_term"), "_b": folded("dst_term")})
    cond = (F.col("src_lang") == F.col("_sl")) & (F.col("_a") == F.col("_sh")) & (F.col("dst_lang") == F.col("_dl")) & (F.col("_b") == F.col("_dh"))
    return t.join(have, cond, "left_anti").drop("_a", "_b")


def report(trees: DataFrame, edges: DataFrame, out: str) -> tuple[int, int, int]:
    """Write all missing links of ``trees`` to the table ``out``; the numbers of readable trees, their links and missing ones."""
    scratch = Scratch(trees.sparkSession)
    links = scratch.save(tree_edges(trees))
    missing(links, edges).orderBy("src_lang", "src_term", "dst_lang", "dst_term", "keyword", "tree_id").write.parquet(out)
    whole = trees.where(F.trim("tree_json").startswith("{") & F.try_parse_json("tree_json").isNotNull()).select("tree_id")
    # Trees too deep to be parsed there are known by their links.
    n_trees = whole.unionByName(links.select("tree_id")).distinct().count()
    counts = n_trees, links.count(), trees.sparkSession.read.parquet(out).count()
    scratch.delete(scratch.path(links))
    return counts


def first_tree_words(entries: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` different words, in file order, whose etymology asks for a rendered tree."""
    asks = F.exists("etymology_templates", lambda t: t["name"].isin("etymon", "ety") & (F.try_element_at(t["args"], F.lit("tree")) == "1"))
    return entries.where(asks).groupBy("lang_code", "word").agg(F.min(order).alias("first")).orderBy("first").limit(n)
