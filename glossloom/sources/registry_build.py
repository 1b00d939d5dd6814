"""The language registry's tables from exported language data and ISO 639 statements.

Exports are JSON objects from code to record, as a dictionary's data module gives them; statements are
rows of item, property and value. They are joined by code alone: a record's own item often stands for a
broader or another language.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Properties of ISO 639 codes, and the fields of a rule on the marks page titles drop.
ISO_1, ISO_2, ISO_3, ISO_5 = "P218", "P219", "P220", "P1798"
RULE_FIELDS = ("remove_diacritics", "remove_exceptions", "from", "to")


def export(spark: SparkSession, path: str) -> DataFrame:
    """``code``, ``raw`` (JSON) of each record of an export."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("code", "raw"))


def _of(name: str) -> Column:
    return F.nullif(F.get_json_object("raw", f"$['{name}']"), F.lit(""))


def _list(name: str) -> Column:
    parts = F.filter(F.split(_of(name), ","), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts)


def _strip_rule(rule: Column) -> Column:
    """Marks and exceptions of a rule, stated once or per script; rules by program and exceptions by pattern are skipped."""

    def of(text: str | None) -> dict:
        try:
            rule = json.loads(text) if text else None
        except ValueError:
            rule = None
        if not isinstance(rule, dict):
            return {"marks": None, "exceptions": None}
        stated = [rule] if any(f in rule for f in RULE_FIELDS) else [r for r in rule.values() if isinstance(r, dict)]
        marks, kept = "", []
        for r in stated:
            marks += "".join(c for c in r.get("remove_diacritics") or "" if c not in marks)
            listed = r.get("remove_exceptions") or []
            for x in listed.values() if isinstance(listed, dict) else listed:
                x = unicodedata.normalize("NFC", x)
                if "%" not in x and x not in kept:
                    kept.append(x)
        return {"marks": "".join(dict.fromkeys(marks)) or None, "exceptions": kept or None}

    @F.pandas_udf("struct<marks:string,exceptions:array<string>>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = [of(t) for t in s]
            yield pd.DataFrame({k: pd.Series([r[k] for r in rows], dtype=object) for k in ("marks", "exceptions")})

    return read(rule)


def iso_codes(languages: DataFrame, statements: DataFrame) -> DataFrame:
    """``code``, ``iso639_1``, ``iso639_2b``, ``iso639_3`` by code.

    A code of three letters is its own ISO 639-3 code if that exists. One of two letters belongs to the
    only item that states it; that item's only ISO 639-3 code counts, and of its ISO 639-2 codes the
    only one that isn't an ISO 639-3 code too.
    """
    said = lambda p: statements.where(F.col("property") == p).select("item", "value").distinct()
    three = said(ISO_3)
    known = three.select(F.col("value").alias("_v")).distinct()
    by_three = languages.where(F.length("code") == 3).join(known, F.col("code") == F.col("_v"), "left_semi").select("code", F.lit(None).cast("string").alias("iso639_1"), F.lit(None).cast("string").alias("iso639_2b"), F.col("code").alias("iso639_3"))
    only = lambda df, name: df.groupBy("item").agg(F.min("value").alias(name), F.max("value").alias("_m")).where(F.col(name) == F.col("_m")).drop("_m")
    item = said(ISO_1).groupBy(F.col("value").alias("code")).agg(F.min("item").alias("item"), F.max("item").alias("_m")).where("item = _m").drop("_m")
    two = languages.where(F.length("code") == 2).select("code").join(item, "code")
    two = two.join(only(three, "iso639_3"), "item", "left").join(only(said(ISO_2).join(three, ["item", "value"], "left_anti"), "iso639_2b"), "item", "left")
    return by_three.unionByName(two.select("code", F.col("code").alias("iso639_1"), "iso639_2b", "iso639_3"))


def build(languages: DataFrame, families: DataFrame, varieties: DataFrame, statements: DataFrame) -> dict[str, DataFrame]:
    """``language_record``, ``language_set`` and ``variety`` of exports (``code``, ``raw``) and statements.

    Empty and missing fields are null. A family that names itself as its parent is a root; its
    proto-language is the one named, else the code with ``-pro`` behind it if that is a language.
    """
    lang = languages.select(
        "code", _of("1").alias("name"), _of("type").alias("kind"), _of("3").alias("family"), _of("2").cast("bigint").alias("wikidata_qid"), _list("4").alias("scripts"),
        _list("wikimedia_codes").alias("wikimedia_codes"), _strip_rule(_of("strip_diacritics")).alias("_rule"),
    )
    record = lang.join(iso_codes(lang, statements), "code", "left").select("*", F.col("_rule.marks").alias("strip_marks"), F.col("_rule.exceptions").alias("strip_exceptions")).drop("_rule")
    codes = languages.select("code").union(varieties.select("code")).distinct().withColumnRenamed("code", "_c")
    five = statements.where(F.col("property") == ISO_5).select(F.col("value").alias("_five")).distinct()
    fam = families.select("code", _of("1").alias("name"), F.nullif(_of("3"), F.col("code")).alias("superset"), _of("protoLanguage").alias("_proto"), _of("2").cast("bigint").alias("wikidata_qid"))
    fam = fam.join(codes, F.concat("code", F.lit("-pro")) == F.col("_c"), "left").join(five, F.col("code") == F.col("_five"), "left")
    sets = fam.select("code", "name", "superset", F.coalesce("_proto", "_c").alias("proto_language_code"), "wikidata_qid", F.col("_five").alias("iso639_5"))
    return {"language_record": record, "language_set": sets, "variety": varieties.select("code", _of("1").alias("name"), _of("parent").alias("parent"), _of("2").cast("bigint").alias("wikidata_qid"))}
