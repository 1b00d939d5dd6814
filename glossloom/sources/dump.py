"""Dictionary dumps, edge files and rendered pages as sources and sinks."""

from __future__ import annotations

import html
import json
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossloom.operators.normalize import ENTRY_SCHEMA
from glossloom.sources import files


def read_entries(spark: SparkSession, path: str, parts: int | None = None) -> DataFrame:
    """Entries of a JSON-lines dump, plain or gzipped; ``parts`` spreads a gzip file, which can't be split.

    Blank lines, redirects, lines that are no JSON, that lack a word or language or whose fields have
    other types than declared are left out; :func:`rejected_lines` counts them.
    """
    lines = spark.read.text(path)
    return entries_of(lines.repartition(parts) if parts else lines)


def entries_of(lines: DataFrame) -> DataFrame:
    """The entries of JSON lines (``value``)."""
    return _judged(lines).where("_why is null").select(F.from_json("value", ENTRY_SCHEMA).alias("e")).select("e.*")


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines left out, by reason."""
    return _judged(spark.read.text(path)).where("_why is not null").groupBy(F.col("_why").alias("reason")).agg(F.count(F.lit(1)).alias("n_lines"))


def _judged(lines: DataFrame) -> DataFrame:
    v = F.try_parse_json("value")
    full = ENTRY_SCHEMA + ", _bad string"
    shape = F.schema_of_variant(v)
    text = lambda name: shape.rlike(rf"^OBJECT<(?:.*, )?{name}: STRING[,>]")
    parsed = F.from_json("value", full, {"columnNameOfCorruptRecord": "_bad"})
    why = (
        F.when(F.trim("value") == "", "blank").when(v.isNull(), "not JSON").when(~shape.startswith("OBJECT<"), "no object")
        .when(F.get_json_object("value", "$.redirect").isNotNull(), "redirect").when(parsed["_bad"].isNotNull() | ~text("word") | ~text("lang_code"), "wrong type or missing field")
        .when((parsed["word"] == "") | (parsed["lang_code"] == ""), "wrong type or missing field")
    )
    return lines.withColumn("_why", why)


def field_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """Dotted paths of all fields of a schema, through arrays, in order."""
    out = []
    for f in schema.fields:
        path, t = f"{prefix}{f.name}", f.dataType
        out.append(path)
        while isinstance(t, T.ArrayType):
            t = t.elementType
        if isinstance(t, T.StructType):
            out += field_paths(t, path + ".")
    return out


def declared_paths() -> list[str]:
    return sorted(field_paths(T._parse_datatype_string(ENTRY_SCHEMA)))


def write_filtered(entries: DataFrame, path: str) -> None:
    """The declared fields of entries, and beside them the list of fields they were trimmed to."""
    entries.write.mode("overwrite").parquet(path)
    files.replace(entries.sparkSession, path.rstrip("/") + ".fields.json", json.dumps(declared_paths()))


def check_fields(spark: SparkSession, path: str) -> None:
    """Refuse a trimmed dump that lacks a declared field or says nothing of its fields."""
    side = path.rstrip("/") + ".fields.json"
    if not files.exists(spark, side):
        raise ValueError(f"{path} has no list of its fields; filter it again")
    missing = sorted(set(declared_paths()) - set(json.loads(files.read(spark, side))))
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}; filter it again")


#: Staged items: terms, edges and claims.
ITEM_SCHEMAS = {
    "stg_term": "lang_code string, headword string, section smallint, is_reconstructed boolean, part_of_speech string, gloss string, has_sense boolean",
    "stg_edge": "src_lang_code string, src_headword string, src_section smallint, src_variety_code string, dst_lang_code string, dst_headword string, dst_section smallint, "
    "rel_type string, anchor string, piece_order smallint, src_wiktionary_id string",
    "stg_section_claim": "lang_code string, headword string, section smallint, wiktionary_id string, listed_lang_code string, listed_headword string",
}


def write_items(items: dict[str, DataFrame], path: str) -> None:
    """Staged terms, edges and claims, a table each, put in place together when all are written."""
    spark = next(iter(items.values())).sparkSession
    part = f"{path.rstrip('/')}.part"
    files.delete(spark, part)
    try:
        for name, df in items.items():
            want = T._parse_datatype_string(ITEM_SCHEMAS[name]) if name in ITEM_SCHEMAS else df.schema
            df.select(*[F.col(f.name).cast(f.dataType) for f in want.fields]).write.parquet(f"{part}/{name}")
        files.move(spark, part, path.rstrip("/"))
    finally:
        files.delete(spark, part)


def read_items(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The staged tables of a path with their declared types; a missing one is an error."""
    return {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in ITEM_SCHEMAS.items()}


def to_json_lines(items: dict[str, DataFrame]) -> DataFrame:
    """All items as compact JSON lines; edges have ``rel_type``, claims a ``listed_headword`` or ``wiktionary_id``."""
    lines = [df.select(F.to_json(F.struct(*df.columns)).alias("value")) for df in items.values()]
    out = lines[0]
    for x in lines[1:]:
        out = out.unionByName(x)
    return out


def split_json_lines(lines: DataFrame, schemas: dict[str, str] = ITEM_SCHEMAS) -> dict[str, DataFrame]:
    """The items of JSON lines by kind: edges by ``rel_type``, claims by page and claim fields, else terms."""
    edge = F.get_json_object("value", "$.rel_type").isNotNull()
    claim = ~edge & (F.get_json_object("value", "$.listed_headword").isNotNull() | F.get_json_object("value", "$.wiktionary_id").isNotNull())
    kinds = {"stg_edge": edge, "stg_section_claim": claim, "stg_term": ~edge & ~claim}
    return {k: lines.where(kinds[k]).select(F.from_json("value", s).alias("x")).select("x.*") for k, s in schemas.items()}


def is_current(built: str, source: str) -> bool:
    """Whether a built file exists and is no older than its source."""
    return os.path.exists(built) and os.path.getmtime(built) >= os.path.getmtime(source)


def newest_dump(folder: str) -> str | None:
    """The latest date among ``wiktextract-data-<date>.jsonl.gz`` in a folder."""
    dates = [m[1] for n in os.listdir(folder) if (m := re.fullmatch(r"wiktextract-data-(\d{4}-\d{2}-\d{2})\.jsonl\.gz", n))]
    return max(dates, default=None)


def served_date(page: str) -> str:
    """The dump date a download page names."""
    import datetime

    m = re.search(r"enwiktionary dump dated (\d{4}-\d{2}-\d{2})", page)
    if not m:
        raise ValueError("the page names no dump date")
    return datetime.date.fromisoformat(m[1]).isoformat()


def rendered_trees(pages: DataFrame, column: str = "html") -> DataFrame:
    """``lang_code``, ``tree_json`` of every etymology tree rendered in a page."""

    @F.pandas_udf("array<struct<lang_code:string,tree_json:string>>")
    def trees(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pattern = re.compile(r'data-lang="([^"]*)"[^>]*?data-ety-tree-json="([^"]*)"')
        for s in batches:
            yield pd.Series([[{"lang_code": a, "tree_json": html.unescape(b)} for a, b in pattern.findall(t or "")] for t in s], dtype=object)

    x: Column = trees(F.col(column))
    return pages.select(F.explode(x).alias("x")).select("x.*")
