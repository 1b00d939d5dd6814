"""Queries of the text problems 5, 7, 8, 9 and 10 over whole tables; their SQL is in :mod:`glossloom.llm.oracles`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossloom.llm import canonical, chunks, leaks, lookalikes, mixture
from glossloom.llm.oracles import ORACLE
from glossloom.session import table

__all__ = ["ORACLE", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    named = lambda df, f: df.select(F.lit(f).alias("rec_field"), "id_a", "id_b")
    words = lookalikes.lookalike_pairs(table(spark, d, "stg_term"), "occurrence_id", "headword", "lang_code")
    marks = lookalikes.lookalike_pairs(table(spark, d, "language_record"), "lang_id", "strip_marks")
    return named(words, "headword").unionByName(named(marks, "strip_marks"))


def p5_canonical(spark: SparkSession, d: str) -> DataFrame:
    """The canonical spelling of each distinct headword of a language."""
    c = lookalikes.canonical_spellings(table(spark, d, "stg_term"), "headword", "lang_code")
    return c.select(F.col("_grp").alias("lang_code"), F.col("_txt").alias("headword"), F.col("_canon").alias("canonical"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.mapped_citations(spark, table(spark, d, "raw_citation"), table(spark, d, "language_record"), table(spark, d, "lemma_ref"))


def p7_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values that mean no entry, with the number of citations they stand in."""
    c = table(spark, d, "raw_citation").distinct().selectExpr("citation_id", "stack(2, 'lang_text', lang_text, 'src_text', src_text) as (raw_field, raw)")
    none = p7_found(spark, d).where("matched_key = ''").drop("matched_key")
    return c.join(none, ["citation_id", "raw_field"]).groupBy("raw_field", "raw").agg(F.count_distinct("citation_id").alias("n_citations"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_item")).select("doc_id", "item_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Per item: texts it leaked into and the longest run of its words there."""
    hits = leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_item")).groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n_docs"), F.max("n_words").alias("longest_run")
    )
    items = table(spark, d, "eval_item").select("item_id", "task").distinct()
    return items.join(hits, "item_id", "left").select("item_id", "task", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("longest_run", F.lit(0)).alias("longest_run"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mixture(mixture.sized(spark, table(spark, d, "documents")), table(spark, d, "source_weight"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.shares(mixture.sized(spark, table(spark, d, "documents")), table(spark, d, "source_weight"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts that had to be cut: those with a second piece."""
    return chunks.oversized(table(spark, d, "documents"))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunks.pieces(table(spark, d, "documents"))


def p10_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Per text: checksum of its pieces put together again, gaps between them, pieces over the limit, whether it was cut."""
    p = chunks.pieces(table(spark, d, "documents"))
    own = F.struct("piece_no", "start_char", "end_char", "n_tokens", F.substring("text", F.col("start_char") - F.col("overlap_start") + 1, F.col("end_char") - F.col("start_char")).alias("t"))
    one = p.groupBy("doc_id").agg(F.sort_array(F.collect_list(own)).alias("p"))
    gaps = F.filter("p", lambda x, i: x["start_char"] != F.when(i == 0, 0).otherwise(F.get("p", i - 1)["end_char"]))
    over = F.filter("p", lambda x: x["n_tokens"] > chunks.LIMIT)
    return one.select(
        "doc_id", F.md5(F.array_join(F.transform("p", lambda x: x["t"]), "").cast("binary")).alias("text_md5"), F.size(gaps).cast("bigint").alias("n_gaps"),
        F.size(over).cast("bigint").alias("n_over_limit"), (F.size("p") > 1).alias("is_cut"),
    )


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (p5_found, p5_canonical, p7_found, p7_unmatched, p8_found, p8_report, p9_mixture, p9_shares, p10_found, p10_pieces, p10_round_trip)
}
