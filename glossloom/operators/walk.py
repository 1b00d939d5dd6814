"""Bounded, capped, cycle-safe walks over a graph of terms, many anchors at once.

A walk goes level by level. Each level is one plan: expand, dedupe, cap. All anchors share it, and the
frontier is written between levels. Edges are kept directed, in blocks by their near end and sorted by
it, so a level reads only the blocks and the id range its frontier has. Ranking keeps only ``cap`` rows
of a parent in each task before it shuffles, and counts are separate aggregates, so a hub with very
many children is never gathered in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from glossloom.session import Scratch

# Relation types from the most to the least binding; mentions are never walked.
PRIORITY = [
    "inherited", "borrowed", "learned_borrowing", "semi_learned_borrowing", "transliteration", "derived", "shortening", "metathesis", "calque",
    "semantic_loan", "compound", "blend", "univerbation", "affix", "reduplication", "surface_analysis", "root", "influence", "alt_form", "inflection",
]
#: Relations beyond which a walk doesn't go on.
NON_TRANSITIVE = ("influence", "semantic_loan", "calque")
CAP, LIMIT = 10, 100
#: Greatest rank of a relation of descent; those beyond take words apart or are looser still.
DESCENT = 8
#: Blocks of directed edges by near end, and files a block is spread over. Blocks are noted in the bits of a long.
BLOCKS, FILES = 64, 4
BY_BLOCK = "block"
#: Rows up to which a frontier is sent to every task.
BROADCAST_ROWS = 50_000
#: Terms with a sense up to which their section counts are sent to every task.
BROADCAST_COUNTS = 500_000
EDGE = ("src_term_id", "src_section", "dst_term_id", "dst_section", "rel_type", "anchor", "piece_order")


def priority(rel: Column | str) -> Column:
    """Rank of a relation type; null for mentions and unknown types."""
    c = F.col(rel) if isinstance(rel, str) else rel
    return reduce(lambda w, t: w.when(c == t[1], F.lit(t[0])), list(enumerate(PRIORITY))[1:], F.when(c == PRIORITY[0], F.lit(0)))


def section_counts(senses: DataFrame) -> DataFrame:
    """Number of distinct sections with a sense, per term."""
    return senses.groupBy("term_id").agg(F.count_distinct("section").alias("n_sections"))


def block_of(term: Column | str) -> Column:
    """The block of a term's edges."""
    return F.pmod(F.xxhash64((F.col(term) if isinstance(term, str) else term).cast("long")), F.lit(BLOCKS)).cast("int")


def directed(edges: DataFrame, senses: DataFrame, down: bool) -> DataFrame:
    """The edges that can be walked, with near and far end, rank and the number of their source's sections."""
    near, far = ("src", "dst") if down else ("dst", "src")
    e = edges.select(*EDGE).withColumn("priority", priority("rel_type")).where("priority is not null")
    scratch = Scratch(edges.sparkSession)
    n = scratch.save(section_counts(senses).withColumnRenamed("term_id", "_t"), rows=F.count(F.lit(1)))
    # Two numbers a row: sent to every task while there are few, so the edges are not shuffled for them.
    n = F.broadcast(n) if scratch.metric(n, "rows") <= BROADCAST_COUNTS else n
    e = e.join(n, F.col("src_term_id") == F.col("_t"), "left").drop("_t").withColumn("n_sections", F.coalesce("n_sections", F.lit(0)).cast("long"))
    ends = {"near": f"{near}_term_id", "far": f"{far}_term_id", "near_section": f"{near}_section", "far_section": f"{far}_section"}
    return e.withColumns({k: F.col(c) for k, c in ends.items()})


def write_directed(edges: DataFrame, senses: DataFrame, down: bool, path: str) -> None:
    """Write the directed edges in blocks; a block with a hub is spread over several files."""
    e = directed(edges, senses, down).withColumn(BY_BLOCK, block_of("near"))
    e = e.repartition(BY_BLOCK, F.pmod(F.hash("far"), F.lit(FILES))).sortWithinPartitions(BY_BLOCK, "near")
    e.write.mode("overwrite").option("compression", "zstd").partitionBy(BY_BLOCK).parquet(path)


def _section_ok(down: bool, wanted: Column) -> Column:
    """Downwards an edge without a section fits any; upwards only a walker without one does."""
    fits = (wanted == 0) | (F.col("near_section") == wanted)
    return (F.col("near_section") == 0) | fits if down else fits


def _from(e: DataFrame, frontier: DataFrame, scratch: Scratch, key: str) -> tuple[DataFrame, DataFrame]:
    """The edges in the frontier's blocks and id range, and the frontier, sent to every task if it is small."""
    n, blocks, lo, hi = (scratch.metric(frontier, m) for m in ("open", "blocks", "lo", "hi"))
    mask = (blocks or 0) & ((1 << 64) - 1)
    if BY_BLOCK in e.columns:
        e = e.where(F.col(BY_BLOCK).isin([b for b in range(BLOCKS) if mask >> b & 1]))
    e = e.where(F.col("near").between(lo, hi))
    return e, F.broadcast(frontier) if n <= BROADCAST_ROWS else frontier


def _seen(key: str, grows: Column) -> dict[str, Column]:
    """What is noted of a frontier while it is written: rows to expand, their blocks (a bit each) and id range."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), block_of(key))
    of = lambda c: F.when(grows, c)
    return {"open": F.count(of(F.lit(1))), "blocks": F.bit_or(of(bit)), "lo": F.min(of(F.col(key))), "hi": F.max(of(F.col(key)))}


def _first_hop(e: DataFrame, anchors: DataFrame, scratch: Scratch, down: bool, cap: int) -> DataFrame:
    e, a = _from(e, anchors, scratch, "anchor_id")
    few = scratch.metric(anchors, "open") * cap <= BROADCAST_ROWS
    x = e.join(a, F.col("near") == F.col("anchor_id")).where(_section_ok(down, F.col("section")) & ~F.array_contains("exclude", F.col("far").cast("long")))
    kids = x.groupBy("anchor_id", "far").agg(F.min("priority").alias("_best"))
    top = kids.withColumn("_r", F.row_number().over(W.partitionBy("anchor_id").orderBy("_best", "far"))).where(F.col("_r") <= cap)
    totals = kids.groupBy("anchor_id").agg(F.count(F.lit(1)).alias("total_children")).withColumnRenamed("anchor_id", "_a2")
    top = top.join(totals, F.col("anchor_id") == F.col("_a2")).select(F.col("anchor_id").alias("_a"), F.col("far").alias("_f"), "total_children")
    x = x.join(F.broadcast(top) if few else top, (F.col("anchor_id") == F.col("_a")) & (F.col("far") == F.col("_f")))
    return x.withColumns({"depth": F.col("depth") + (1 if down else -1), "path": F.array(F.col("far").cast("long")), "is_cycle": F.lit(False)})


def _grows(down: bool) -> Column:
    """Whether a row is expanded: no cycle, not at the limit, not beyond a relation that ends a line, not at a homograph."""
    grow = (~F.col("is_cycle")) & ~F.col("rel_type").isin(*NON_TRANSITIVE) & (F.abs("depth") < LIMIT)
    return grow if down else grow & (F.col("etymology_count") < 2)


def _next_hop(e: DataFrame, frontier: DataFrame, scratch: Scratch, down: bool, cap: int) -> DataFrame:
    e, f = _from(e, frontier, scratch, "far")
    f = f.where(_grows(down)).select("anchor_id", F.col("far").alias("_from"), F.col("far_section").alias("_wanted"), F.col("path").alias("_path"), F.col("depth").alias("_depth"))
    x = e.join(f, F.col("near") == F.col("_from")).where(_section_ok(down, F.col("_wanted")))
    x = x.withColumns({
        "path": F.concat("_path", F.array(F.col("far").cast("long"))), "is_cycle": F.array_contains("_path", F.col("far").cast("long")),
        "depth": F.col("_depth") + (1 if down else -1),
    })
    # One row per anchor, child and section: the lowest priority, then parent, then the rest as tie-breaks.
    row = F.struct("priority", "near", "src_section", "dst_section", "path", "src_term_id", "dst_term_id", "rel_type", "anchor", "piece_order", "is_cycle", "depth", "n_sections")
    one = x.groupBy("anchor_id", "far", "far_section").agg(F.min(row).alias("_row")).select("anchor_id", "far", "far_section", "_row.*")
    totals = one.groupBy("anchor_id", "near").agg(F.count(F.lit(1)).alias("total_children"))
    w = W.partitionBy("anchor_id", "near").orderBy("priority", "far", "far_section")
    return one.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).join(totals, ["anchor_id", "near"])


def walk(spark: SparkSession, edges: DataFrame, senses: DataFrame | None, anchors: DataFrame, down: bool = True, cap: int = CAP) -> DataFrame:
    """The rows of all levels of the walks from ``anchors`` (``anchor_id``, optional ``section``, ``depth``, ``exclude``).

    ``edges`` are directed edges as :func:`write_directed` keeps them in blocks, or plain ones, which are
    directed first. Returns the edges met with ``anchor_id``, signed ``depth``, ``near`` and ``far``,
    ``is_cycle``, ``total_children`` of the parent at that level, and upwards ``etymology_count``, downwards
    ``src_section_unstated``. An unknown anchor has no rows. ``section`` and ``exclude`` hold for the
    first level only. A term met again on its own path comes out once, marked, and isn't expanded.
    """
    scratch = Scratch(spark)
    defaults = {"section": "cast(0 as int)", "depth": "cast(0 as int)", "exclude": "cast(array() as array<bigint>)"}
    given = lambda c: f"coalesce({c}, {defaults[c]}) as {c}" if c in anchors.columns else f"{defaults[c]} as {c}"
    a = anchors.selectExpr("anchor_id", *[given(c) for c in defaults]).where("anchor_id is not null").dropDuplicates(["anchor_id"])
    a = scratch.save(a, **_seen("anchor_id", F.lit(True)))
    if "near" not in edges.columns:  # written once, as every level reads them; not worth ordering for one walk
        edges = scratch.save(directed(edges, senses, down))
    state = ["anchor_id", "near", "far", "far_section", *EDGE, "depth", "path", "is_cycle", "total_children", "etymology_count"]

    def finished(level: DataFrame) -> DataFrame:
        level = level.withColumn("etymology_count", F.when(F.col("src_section") == 0, F.col("n_sections")).otherwise(F.lit(0)).cast("long"))
        return scratch.save(level.select(*state), **_seen("far", _grows(down)))

    if scratch.metric(a, "open"):
        levels = [finished(_first_hop(edges, a, scratch, down, cap))]
    else:
        blank = {"anchor_id": a.schema["anchor_id"].dataType, "depth": "int", "path": "array<long>", "is_cycle": "boolean", "total_children": "long", "etymology_count": "long"}
        levels = [edges.limit(0).select(*[F.lit(None).cast(blank[c]).alias(c) if c in blank else c for c in state])]
    while scratch.metric(a, "open") and scratch.metric(levels[-1], "open") and len(levels) < LIMIT:
        levels.append(finished(_next_hop(edges, levels[-1], scratch, down, cap)))
    out = reduce(DataFrame.unionByName, levels).drop("path", "far_section")
    return out.withColumn("src_section_unstated", F.col("etymology_count") >= 2) if down else out


def overflow(rows: DataFrame, cap: int = CAP) -> DataFrame:
    """Children left out per anchor and parent; a parent expanded on two levels reports the deeper one."""
    last = rows.groupBy("anchor_id", "near").agg(F.max_by("total_children", F.struct(F.abs("depth"), "total_children")).alias("_n"))
    return last.where(F.col("_n") > cap).select("anchor_id", F.col("near").alias("parent_id"), (F.col("_n") - cap).alias("n_hidden"))


def source_ref(date: Column, lang: Column, headword: Column, section: Column | None = None, anchor: Column | None = None) -> Column:
    """Citation of a term or edge: ``wiktionary:<date>:<lang>:<headword>[:<section>][#<anchor>]``."""
    out = F.concat(F.lit("wiktionary:"), F.date_format(date, "yyyy-MM-dd"), F.lit(":"), lang, F.lit(":"), headword)
    if section is not None:
        out = F.concat(out, F.when(F.coalesce(section, F.lit(0)) > 0, F.concat(F.lit(":"), section.cast("string"))).otherwise(""))
    if anchor is not None:
        out = F.concat(out, F.when(anchor.isNotNull(), F.concat(F.lit("#"), anchor)).otherwise(""))
    return out


def first_gloss(senses: DataFrame) -> DataFrame:
    """Per term the first gloss by section, part of speech (nulls first) and gloss."""
    return senses.where("gloss is not null").groupBy("term_id").agg(F.min_by("gloss", F.struct("section", "part_of_speech", "gloss")).alias("gloss"))


def hydrate(ids: DataFrame, terms: DataFrame, languages: DataFrame, senses: DataFrame) -> DataFrame:
    """Terms by id with language, first gloss and whether they have no sense (a red link)."""
    t = terms.join(ids.select(F.col("term_id").alias("_i")).distinct(), F.col("term_id") == F.col("_i"), "left_semi")
    t = t.join(languages.select("language_id", F.col("code").alias("lang_code"), F.col("name").alias("lang_name")), "language_id")
    have = senses.select(F.col("term_id").alias("_s")).distinct()
    t = t.join(have, F.col("term_id") == F.col("_s"), "left").withColumn("is_redlink", F.col("_s").isNull()).drop("_s")
    g = first_gloss(senses).withColumnRenamed("term_id", "_g")
    return t.join(g, F.col("term_id") == F.col("_g"), "left").drop("_g", "language_id")


def merge_parallel(edges: DataFrame) -> DataFrame:
    """Parallel edges as one: relation types by priority, pieces, and whether every section is unstated."""
    e = edges.where(priority("rel_type").isNotNull()).groupBy("src_term_id", "dst_term_id").agg(
        F.sort_array(F.collect_set(F.struct(priority("rel_type").alias("p"), F.col("rel_type").alias("r")))).alias("_r"),
        F.min("piece_order").alias("piece_order"), F.bool_and(F.col("src_section") == 0).alias("src_section_unstated"), F.count(F.lit(1)).alias("n_edges"),
    )
    return e.select("src_term_id", "dst_term_id", F.array_join(F.transform("_r", lambda x: x["r"]), ",").alias("rel_types"), F.col("_r")[0]["r"].alias("primary_type"), "piece_order", "src_section_unstated", "n_edges")


def drawn_under(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """For each node of a tree the one neighbour it is drawn under.

    ``nodes`` has ``anchor_id`` (the focus), ``term_id`` and signed ``depth``; ``edges`` has ``anchor_id``,
    ``src_term_id``, ``dst_term_id``, ``rel_type`` and ``piece_order``. An edge can place its end away from
    the focus: its source on the ancestors' side, its destination on the other. It does if the other end
    is a step nearer, or at the same depth if the relation is one of descent; the latter come first, then
    the lower rank, then the lesser neighbour. A node no edge places stands under the focus, without a rank.
    Returns ``anchor_id``, ``term_id``, ``parent_id``, ``rank``, ``piece_order``.
    """
    one = edges.where(priority("rel_type").isNotNull()).groupBy("anchor_id", "src_term_id", "dst_term_id").agg(F.min(F.struct(priority("rel_type").alias("rank"), "piece_order")).alias("_e"))
    ends = one.select("anchor_id", F.explode(F.array(
        F.struct(F.col("src_term_id").alias("node"), F.col("dst_term_id").alias("other"), F.lit(True).alias("up")), F.struct(F.col("dst_term_id").alias("node"), F.col("src_term_id").alias("other"), F.lit(False).alias("up")),
    )).alias("x"), "_e.*").select("anchor_id", "x.*", "rank", "piece_order")
    at = nodes.select("anchor_id", "term_id", "depth").distinct()
    own = at.toDF("_a1", "term_id", "_d1")
    far = at.toDF("_a2", "_t2", "_d2")
    x = ends.join(own, (F.col("anchor_id") == F.col("_a1")) & (F.col("node") == F.col("term_id"))).join(far, (F.col("anchor_id") == F.col("_a2")) & (F.col("other") == F.col("_t2")))
    x = x.where((F.col("node") != F.col("anchor_id")) & (F.col("up") == (F.col("_d1") <= 0)))
    step = F.col("_d1") + F.when(F.col("up"), 1).otherwise(-1)
    same = (F.col("_d1") == F.col("_d2")) & (F.col("rank") <= DESCENT)
    x = x.where((F.col("_d2") == step) | same)
    best = x.groupBy("anchor_id", "term_id").agg(F.min(F.struct((~same).alias("direct"), "rank", "other", "piece_order")).alias("_b")).toDF("_ba", "_bt", "_b")
    out = at.where(F.col("term_id") != F.col("anchor_id")).join(best, (F.col("anchor_id") == F.col("_ba")) & (F.col("term_id") == F.col("_bt")), "left")
    return out.select("anchor_id", "term_id", F.coalesce("_b.other", F.col("anchor_id")).alias("parent_id"), "_b.rank", "_b.piece_order")
