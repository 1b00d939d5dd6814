"""Staged terms, edges and section claims merged into a graph of terms.

Every step is an aggregate with map-side combine or an equi-join whose staged side can be split, so hub
terms need no special care. Keys stay (language, headword) throughout; ids come last, in key order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from glossloom.functions.text import MACRON_BREVE, anchor_index, length_folded
from glossloom.session import Scratch


def term_keys(terms: DataFrame) -> DataFrame:
    """One row per (language, headword): whether it is reconstructed and whether it has a sense.

    The flags of rows with a sense outweigh those of mere mentions. Rows with a null key are no terms.
    """
    real = F.bool_or(F.when(F.col("has_sense"), F.col("is_reconstructed")))
    return terms.where("lang_code is not null and headword is not null").groupBy("lang_code", "headword").agg(
        F.coalesce(real, F.bool_or("is_reconstructed")).alias("is_reconstructed"), F.bool_or("has_sense").alias("has_sense")
    )


def aliases(keys: DataFrame) -> DataFrame:
    """``lang_code``, ``from_headword``, ``to_headword``: stubs that differ from another term in length marks only.

    A stub has such a mark, no sense and is not reconstructed. It is folded into its only twin with a
    sense, else into its only twin without a mark; with several candidates it stays.
    """
    k = keys.where("not is_reconstructed").withColumn("_fold", length_folded("headword"))
    marked = k.withColumn("_marked", F.col("_fold") != F.col("headword"))
    # A decomposed form without a mark also differs from its headword; look for the marks themselves.
    marked = marked.withColumn("_marked", F.col("_marked") & _has_length_mark(F.col("headword")))
    stub = marked.where("_marked and not has_sense").select("lang_code", F.col("headword").alias("from_headword"), "_fold")
    twin = marked.where("has_sense or not _marked").select(F.col("lang_code").alias("_l"), F.col("headword").alias("_h"), F.col("_fold").alias("_f"), F.col("has_sense").alias("_real"))
    pairs = stub.join(twin, (F.col("lang_code") == F.col("_l")) & (F.col("_fold") == F.col("_f")) & (F.col("from_headword") != F.col("_h")))
    best = pairs.groupBy("lang_code", "from_headword").agg(
        F.min(F.when(F.col("_real"), F.col("_h"))).alias("_one"), F.count_if("_real").alias("_n_real"), F.min("_h").alias("_any"), F.count(F.lit(1)).alias("_n")
    )
    return best.where("_n_real = 1 or _n = 1").select("lang_code", "from_headword", F.coalesce("_one", "_any").alias("to_headword"))


def _has_length_mark(c: Column) -> Column:
    import unicodedata

    marked = "".join(ch for cp in [*range(0xC0, 0x590), *range(0x1E00, 0x2000)] if set(unicodedata.normalize("NFD", ch := chr(cp))) & set(MACRON_BREVE))
    return c.rlike(f"[{marked}{MACRON_BREVE}]")


def alias_folded(df: DataFrame, lang: str, headword: str, alias: DataFrame) -> DataFrame:
    """``df`` with ``headword`` replaced where it is a stub."""
    a = alias.select(F.col("lang_code").alias("_al"), F.col("from_headword").alias("_af"), F.col("to_headword").alias("_at"))
    j = df.join(a, (F.col(lang) == F.col("_al")) & (F.col(headword) == F.col("_af")), "left")
    return j.withColumn(headword, F.coalesce("_at", headword)).drop("_al", "_af", "_at")


def id_sections(claims: DataFrame) -> DataFrame:
    """The section each declared id names, where all declarations agree."""
    c = claims.where("wiktionary_id is not null").groupBy("lang_code", "headword", "wiktionary_id").agg(F.min("section").alias("section"), F.max("section").alias("_m"))
    return c.where("section = _m").drop("_m")


def listing_sections(claims: DataFrame) -> DataFrame:
    """The section each listed descendant stands in, where all lists agree."""
    c = claims.where("listed_headword is not null").groupBy("lang_code", "headword", "listed_lang_code", "listed_headword").agg(F.min("section").alias("section"), F.max("section").alias("_m"))
    return c.where("section = _m").drop("_m")


def unknown_language_share(edges: DataFrame, languages: DataFrame) -> DataFrame:
    """Edges, and edges with an end in an unknown language."""
    known = languages.select("code").distinct()
    s, t = known.withColumnRenamed("code", "_s"), known.withColumnRenamed("code", "_t")
    j = edges.select("src_lang_code", "dst_lang_code").groupBy("src_lang_code", "dst_lang_code").agg(F.count(F.lit(1)).alias("_n"))
    j = j.join(s, F.col("src_lang_code") == F.col("_s"), "left").join(t, F.col("dst_lang_code") == F.col("_t"), "left")
    lost = F.when(F.col("_s").isNull() | F.col("_t").isNull(), F.col("_n")).otherwise(0)
    return j.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_edges"), F.coalesce(F.sum(lost), F.lit(0)).alias("n_unknown"))


def stated_edges(edges: DataFrame, claims: DataFrame, alias: DataFrame, languages: DataFrame) -> DataFrame:
    """Edges between known languages with folded ends and the section their source is stated to have.

    A declared id counts first, then a list on the source's page if the edge names no section of its
    destination, then the section the edge came with.
    """
    known = languages.select("code").distinct()
    e = edges.select(
        "src_lang_code", "src_headword", "src_section", "src_variety_code", "dst_lang_code", "dst_headword", "dst_section", "rel_type", "anchor", "piece_order", "src_wiktionary_id"
    ).distinct()
    for end in ("src", "dst"):
        e = e.join(known.withColumnRenamed("code", "_k"), F.col(f"{end}_lang_code") == F.col("_k"), "left_semi")
        e = alias_folded(e, f"{end}_lang_code", f"{end}_headword", alias)
    e = e.where(~((F.col("src_lang_code") == F.col("dst_lang_code")) & (F.col("src_headword") == F.col("dst_headword"))))
    i = id_sections(claims).toDF("_il", "_ih", "_ii", "_is")
    l = listing_sections(claims).toDF("_ll", "_lh", "_lll", "_llh", "_ls")  # noqa: E741
    e = e.join(i, (F.col("src_lang_code") == F.col("_il")) & (F.col("src_headword") == F.col("_ih")) & (F.col("src_wiktionary_id") == F.col("_ii")), "left")
    listed = (F.col("src_lang_code") == F.col("_ll")) & (F.col("src_headword") == F.col("_lh")) & (F.col("dst_lang_code") == F.col("_lll")) & (F.col("dst_headword") == F.col("_llh"))
    e = e.join(l, listed & (F.col("dst_section") == 0), "left")
    e = e.withColumn("stated_section", F.coalesce("_is", "_ls", "src_section"))
    return e.drop("_il", "_ih", "_ii", "_is", "_ll", "_lh", "_lll", "_llh", "_ls", "src_section", "src_wiktionary_id")


SIDES = ["src_lang_code", "src_headword", "dst_lang_code", "dst_headword", "dst_section"]


def spread_sections(stated: DataFrame) -> DataFrame:
    """A silent edge takes the section its siblings state, if those who state one agree."""
    n = F.nullif(F.col("stated_section"), F.lit(0))
    g = stated.groupBy(*SIDES).agg(F.min(n).alias("_lo"), F.max(n).alias("_hi")).where("_lo = _hi")
    r = g.toDF(*[f"_g{i}" for i in range(len(SIDES))], "_lo", "_hi")
    cond = F.lit(True)
    for i, c in enumerate(SIDES):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    j = stated.join(r, cond & (F.col("stated_section") == 0), "left")
    return j.withColumn("src_section", F.coalesce(F.nullif(F.col("stated_section"), F.lit(0)), "_lo", F.lit(0))).select(*stated.columns, "src_section").drop("stated_section")


def first_edges(edges: DataFrame) -> DataFrame:
    """One edge per ends, sections and relation: that of the lowest template number, then anchor."""
    key = ["src_lang_code", "src_headword", "src_section", "dst_lang_code", "dst_headword", "dst_section", "rel_type"]
    pick = F.struct(F.coalesce(anchor_index("anchor"), F.lit(1 << 30)).alias("i"), "anchor", "src_variety_code", "piece_order")
    return edges.groupBy(*key).agg(F.min(pick).alias("_p")).select(*key, "_p.src_variety_code", "_p.anchor", "_p.piece_order")


def merged_edges(edges: DataFrame, claims: DataFrame, alias: DataFrame, languages: DataFrame) -> DataFrame:
    """The edges of the graph from staged edges, section claims and aliases."""
    return first_edges(spread_sections(stated_edges(edges, claims, alias, languages)))


def same_term_edges(edges: DataFrame, alias: DataFrame, languages: DataFrame) -> DataFrame:
    """Edges whose ends alias folding made one term, counted per term."""
    e = edges.where("src_lang_code = dst_lang_code").select("src_lang_code", "dst_lang_code", "src_headword", "dst_headword")
    e = e.join(languages.select(F.col("code").alias("_k")).distinct(), F.col("src_lang_code") == F.col("_k"), "left_semi")
    e = alias_folded(alias_folded(e, "src_lang_code", "src_headword", alias), "dst_lang_code", "dst_headword", alias)
    return e.where("src_headword = dst_headword").groupBy(F.col("src_lang_code").alias("lang_code"), F.col("src_headword").alias("headword")).agg(F.count(F.lit(1)).alias("n_edges"))


def undeclared_ids(edges: DataFrame, terms: DataFrame, claims: DataFrame, alias: DataFrame) -> DataFrame:
    """Ids cited on pages with numbered sections that no claim declares, with the edges citing them."""
    e = edges.where("src_wiktionary_id is not null").select(F.col("src_lang_code").alias("lang_code"), F.col("src_headword").alias("headword"), F.col("src_wiktionary_id").alias("wiktionary_id"))
    e = alias_folded(e, "lang_code", "headword", alias)
    cited = e.groupBy("lang_code", "headword", "wiktionary_id").agg(F.count(F.lit(1)).alias("n_edges"))
    pages = terms.where("section <> 0 and has_sense").select("lang_code", "headword").distinct()
    declared = claims.where("wiktionary_id is not null").select("lang_code", "headword", "wiktionary_id").distinct()
    return cited.join(pages, ["lang_code", "headword"], "left_semi").join(declared, ["lang_code", "headword", "wiktionary_id"], "left_anti").select("lang_code", "headword", "wiktionary_id", "n_edges")


def numbered(spark: SparkSession, df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Ids 1, 2, ... in the order of unique ``keys``, without ordering all rows in one task.

    Rows are range-partitioned and numbered within partitions; a partition's offset is the number of
    rows before it, from one count per partition.
    """
    scratch = Scratch(spark)
    parts = scratch.save(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()))
    sizes = parts.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("_pid").alias("_p"), "_first", before.alias("_before"))  # one row per partition
    j = parts.join(F.broadcast(offsets), F.col("_pid") == F.col("_p"))
    return j.withColumn(name, (F.col("_before") + F.col("_mid") - F.col("_first") + 1).cast("long")).select(name, *df.columns)


def terms_numbered(spark: SparkSession, terms: DataFrame, languages: DataFrame, alias: DataFrame | None = None) -> DataFrame:
    """``term_id``, ``lang_code``, ``headword``, ``is_reconstructed`` of the terms of known languages that no alias replaces."""
    keys = term_keys(terms)
    alias = aliases(keys) if alias is None else alias
    gone = alias.select(F.col("lang_code").alias("_l"), F.col("from_headword").alias("_h"))
    lang = languages.select("code").distinct()
    kept = keys.join(lang, F.col("lang_code") == F.col("code"), "left_semi").join(gone, (F.col("lang_code") == F.col("_l")) & (F.col("headword") == F.col("_h")), "left_anti")
    return numbered(spark, kept.select("lang_code", "headword", "is_reconstructed"), ["lang_code", "headword"], "term_id")


def _ids(term: DataFrame) -> DataFrame:
    return term.select("term_id", F.col("lang_code").alias("_l"), F.col("headword").alias("_h"))


def senses_of(terms: DataFrame, term: DataFrame) -> DataFrame:
    """The different senses of numbered terms; nulls are equal."""
    real = terms.where("has_sense").select("lang_code", "headword", "section", "part_of_speech", "gloss").distinct()
    return real.join(_ids(term), (F.col("lang_code") == F.col("_l")) & (F.col("headword") == F.col("_h"))).select("term_id", "section", "part_of_speech", "gloss")


def edges_of(merged: DataFrame, term: DataFrame, variety: DataFrame) -> DataFrame:
    """Merged edges with the ids of their ends and of their source's variety, null where it has none that is known."""
    e = merged
    for end in ("src", "dst"):
        i = _ids(term).withColumnRenamed("term_id", f"{end}_term_id")
        e = e.join(i, (F.col(f"{end}_lang_code") == F.col("_l")) & (F.col(f"{end}_headword") == F.col("_h"))).drop("_l", "_h")
    v = variety.select(F.col("variety_id").alias("src_variety_id"), F.col("code").alias("_v"))
    e = e.join(v, F.col("src_variety_code") == F.col("_v"), "left")
    return e.select("src_term_id", "src_section", "dst_term_id", "dst_section", "rel_type", "src_variety_id", "src_variety_code", "anchor", "piece_order")


def varieties_numbered(spark: SparkSession, varieties: DataFrame) -> DataFrame:
    """``variety_id``, ``code``, ``name``, ``lang_code`` of each variety; of several rows of a code the least counts."""
    one = varieties.where("code is not null").groupBy("code").agg(F.min(F.struct("name", F.col("parent").alias("lang_code"))).alias("_x"))
    return numbered(spark, one.select("code", "_x.name", "_x.lang_code"), ["code"], "variety_id")


def pickable(term: DataFrame, sense: DataFrame, edge: DataFrame) -> DataFrame:
    """Terms with a sense that are an end of some edge other than a mention."""
    ends = edge.where("rel_type <> 'mention'").select(F.explode(F.array("src_term_id", "dst_term_id")).alias("term_id")).distinct()
    return term.join(sense.select("term_id").distinct(), "term_id", "left_semi").join(ends, "term_id", "left_semi")


def graph(spark: SparkSession, terms: DataFrame, edges: DataFrame, claims: DataFrame, languages: DataFrame, varieties: DataFrame) -> dict[str, DataFrame]:
    """``term``, ``sense``, ``edge``, ``variety`` and ``pickable_term`` of the graph, with ids."""
    scratch = Scratch(spark)
    alias = scratch.save(aliases(term_keys(terms)))
    term = scratch.save(terms_numbered(spark, terms, languages, alias))
    sense = scratch.save(senses_of(terms, term))
    variety = scratch.save(varieties_numbered(spark, varieties))
    edge = scratch.save(edges_of(merged_edges(edges, claims, alias, languages), term, variety))
    return {"term": term, "sense": sense, "edge": edge, "variety": variety, "pickable_term": pickable(term, sense, edge).select("term_id", "lang_code")}
