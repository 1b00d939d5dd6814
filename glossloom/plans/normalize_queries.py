"""Queries of the normalizing operators over a small dictionary, and over the staged edges written back as entries."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossloom.functions import text as X
from glossloom.operators import normalize as N
from glossloom.plans.graph_queries import Query
from glossloom.session import Scratch, table
from glossloom.sources import dump

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return put


# Languages: code, name, marks titles drop, words kept as they are. Varieties: code, language.
LANGUAGES = [("qa", "Avan", "́", ["ṓ"]), ("qb", "Bren", None, None), ("qc", "Cevi", None, None), ("qd-pro", "Proto-Dorian", None, None)]
VARIETIES = [("qa-old", "qa"), ("qvx", "qb"), ("qvy", "qvx")]


def _entry(word: str, *templates: tuple[str, dict], lang: str = "qa", **more) -> dict:
    calls = [{"name": n, "args": {str(k): v for k, v in a.items()}} for n, a in templates]
    return {"word": word, "lang_code": lang, "etymology_templates": calls, "senses": [{"glosses": [f"{word}, glossed"]}]} | more


def _form(word: str, tag: str, of: str, *tags: str, **more) -> dict:
    return {"word": word, "lang_code": "qa", "senses": [{"tags": [tag, *tags], tag.replace("-", "_"): [{"word": of}]}]} | more


#: A dictionary with an entry or more for each way of naming sources.
ENTRIES = [
    _entry("melu", ("inh", {1: "qa", 2: "qd-pro", 3: "*meluz", 5: "a tree"}), etymology_number="2", pos="noun"),
    _entry("tavo", ("bor", {1: "qa", 2: "qb, qc", 3: "tav//tavu", "id": "x1"})),
    _entry("zoro", ("der", {1: "qa", 2: "qb", 3: "", 4: "zor<id:k2>"}), ("uder", {1: "qa", 2: "qb", 3: "-"})),
    _entry("lume", ("lbor", {1: "qa", 2: "qvx", 3: "lum"}), ("slbor", {1: "qa", 2: "qvy", 3: "lumy"}), ("cal", {1: "qa", 2: "QVX", 3: "lumx"})),
    _entry("nelasi", ("prefix", {1: "qa", 2: "ne", 3: "lasi"}), ("pre", {1: "qa", 2: "ne", 3: "lasi"})),
    _entry("lasitu", ("suffix", {1: "qa", 2: "lasi", 3: "tu"}), ("suf", {1: "qa", 2: "", 3: "tu"})),
    _entry("palimo", ("confix", {1: "qa", 2: "pa", 3: "li", 4: "mo"}), ("infix", {1: "qa", 2: "palo", 3: "im"})),
    _entry("pori", ("af", {1: "qa", 2: "po", "alt1": "poo", 3: "qb:ri<id:z>"}), ("com", {1: "qa", 2: "po", 4: "gap"})),
    _entry("doker", ("surf", {1: "+suf", 2: "qa", 3: "dok", 4: "er"}), ("surf", {1: "+qa-verb", 2: "doka"}), ("surf", {1: "qa", 2: "do", 3: "ker"})),
    _entry("kari", ("root", {1: "qa", 2: "qd-pro", 3: "*kar-", 4: "*kir-", "id": "r1", "id2": "r2"}), ("m", {1: "qb", 2: "kara", 3: "karra"}), ("m", {1: "qb", 2: "kara"})),
    _entry("lon", ("clipping", {1: "qa", 2: "", 3: "longa, longo"}), ("bf", {1: "qa", 2: "lonal"}), ("sa-root", {1: "lonk"}), ("hi-derform", {1: "x", 2: "lonh"})),
    _entry("mari", ("etymon", {1: "qa", 2: ":inh", 3: "qd-pro:*mar<ety:der<qb:maro<ety:bor<qc:maru>>>>"})),
    _entry("komi", ("etymon", {1: "qa", 2: "ko", 3: ":af", 4: "ko<id:k>", 5: "mi", 6: ":zz", 7: "never"}), ("ety", {1: "qa", 2: "['stringified'", 3: ":inh", 4: "lost"})),
    _entry("nomi", ("etymon", {1: "qa", 2: ":bor", 3: "qc:<alt:nomu><ety:af<no><mu><q:late>>"}), ("odd", {1: "qa"}), ("odd", {1: "qb"}), ("cog", {1: "qb", 2: "nom"})),
    _entry("same", ("inh", {1: "qa", 2: "qa", 3: "same"}), ("der", {1: "qa", 2: "qa-old", 3: "same"}), ("blend", {1: "qa", 2: "sa", 3: "me"})),
    _entry("same", ("der", {1: "qa", 2: "qa", 3: "same"}), etymology_number="1"),
    _entry("reku", ("inh+", {1: "qd-pro", 2: "qd-pro", 3: "*reka"}), lang="qd-pro", original_title="Reconstruction:Proto-Dorian/reku"),
    _form("melus", "form-of", "mēlu m"), _form("meluto", "form-of", "mélu m or pl"), _form("lonely", "form-of", "absent"),
    _form("melou", "alt-of", "melu"), _form("ml", "alt-of", "melu", "abbreviation"), _form("mel", "alt-of", "two words"),
    _form("tavos", "form-of", "tavo", etymology_templates=[{"name": "inh", "args": {"1": "qa", "2": "qb", "3": "unread"}}]),
    _entry("gap", ("etymid", {1: "qa", 2: " hole "}), ("etymon", {1: "qa", "id": "void"}), etymology_number="3", senses=[{"senseid": ["qa:break", "other"]}, {"glosses": [""]}]),
    {
        "word": "gapa", "lang_code": "qb", "etymology_number": "1", "derived": [{"word": "gapal"}, {"word": ""}],
        "descendants": [{"lang_code": "qa", "word": "*gap", "descendants": [{"lang_code": "qvx", "word": "gapu"}, {"word": "nolang"}]}, {"lang_code": "qc", "word": "gep"}],
    },
    _entry("melu", ("inh", {1: "qa", 2: "qd-pro", 3: "*meluz", 5: "a tree"}), etymology_number="2", pos="noun"),
]


def _dictionary(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines = spark.createDataFrame([(json.dumps(e),) for e in ENTRIES], "value string")
    lang = spark.createDataFrame(LANGUAGES, "code string, name string, strip_marks string, strip_exceptions array<string>")
    return dump.entries_of(lines), lang, spark.createDataFrame(VARIETIES, "code string, parent string")


def _values(rows: list[tuple], columns: str) -> str:
    lit = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "select * from (values " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") as t({columns})"


_EDGE = ["src_lang_code", "src_headword", "src_variety_code", "dst_lang_code", "dst_headword", "dst_section", "rel_type", "anchor", "piece_order", "src_wiktionary_id"]

# What the dictionary states; each row checked against its entry by hand.
_EDGES = [
    ("qa", "dok", None, "qa", "doker", 0, "surface_analysis", "etymology_templates:0:surf", 1, None),
    ("qa", "-er", None, "qa", "doker", 0, "surface_analysis", "etymology_templates:0:surf", 2, None),
    ("qa", "doka", None, "qa", "doker", 0, "surface_analysis", "etymology_templates:1:surf", 1, None),
    ("qa", "do", None, "qa", "doker", 0, "surface_analysis", "etymology_templates:2:surf", 1, None),
    ("qa", "ker", None, "qa", "doker", 0, "surface_analysis", "etymology_templates:2:surf", 2, None),
    ("qd-pro", "kar-", None, "qa", "kari", 0, "root", "etymology_templates:0:root", None, "r1"),
    ("qd-pro", "kir-", None, "qa", "kari", 0, "root", "etymology_templates:0:root", None, "r2"),
    ("qb", "karra", None, "qa", "kari", 0, "mention", "etymology_templates:1:m", None, None),
    ("qb", "kara", None, "qa", "kari", 0, "mention", "etymology_templates:2:m", None, None),
    ("qa", "ko", None, "qa", "komi", 0, "affix", "etymology_templates:0:etymon", 1, "k"),
    ("qa", "mi", None, "qa", "komi", 0, "affix", "etymology_templates:0:etymon", 2, None),
    ("qa", "ko", None, "qa", "komi", 0, "derived", "etymology_templates:0:etymon", None, None),
    ("qa", "lasi", None, "qa", "lasitu", 0, "affix", "etymology_templates:0:suffix", 1, None),
    ("qa", "-tu", None, "qa", "lasitu", 0, "affix", "etymology_templates:0:suffix", 2, None),
    ("qa", "-tu", None, "qa", "lasitu", 0, "affix", "etymology_templates:1:suf", 2, None),
    ("qa", "longa", None, "qa", "lon", 0, "shortening", "etymology_templates:0:clipping", None, None),
    ("qa", "longo", None, "qa", "lon", 0, "shortening", "etymology_templates:0:clipping", None, None),
    ("qa", "lonal", None, "qa", "lon", 0, "shortening", "etymology_templates:1:bf", None, None),
    ("sa", "lonk", None, "qa", "lon", 0, "root", "etymology_templates:2:sa-root", None, None),
    ("hi", "lonh", None, "qa", "lon", 0, "derived", "etymology_templates:3:hi-derform", None, None),
    ("qb", "lum", "qvx", "qa", "lume", 0, "learned_borrowing", "etymology_templates:0:lbor", None, None),
    ("qb", "lumy", "qvy", "qa", "lume", 0, "semi_learned_borrowing", "etymology_templates:1:slbor", None, None),
    ("QVX", "lumx", None, "qa", "lume", 0, "calque", "etymology_templates:2:cal", None, None),
    ("qb", "maro", None, "qd-pro", "mar", 0, "derived", "etymology_templates:0:etymon", None, None),
    ("qd-pro", "mar", None, "qa", "mari", 0, "inherited", "etymology_templates:0:etymon", None, None),
    ("qc", "maru", None, "qb", "maro", 0, "borrowed", "etymology_templates:0:etymon", None, None),
    ("qa", "melu", None, "qa", "melou", 0, "alt_form", "senses:0:alt_of", None, None),
    ("qd-pro", "meluz", None, "qa", "melu", 2, "inherited", "etymology_templates:0:inh", None, None),
    ("qa", "melu", None, "qa", "melus", 0, "inflection", "senses:0:form_of", None, None),
    ("qa", "melu", None, "qa", "meluto", 0, "inflection", "senses:0:form_of", None, None),
    ("qa", "ne-", None, "qa", "nelasi", 0, "affix", "etymology_templates:0:prefix", 1, None),
    ("qa", "lasi", None, "qa", "nelasi", 0, "affix", "etymology_templates:0:prefix", 2, None),
    ("qa", "ne-", None, "qa", "nelasi", 0, "affix", "etymology_templates:1:pre", 1, None),
    ("qa", "lasi", None, "qa", "nelasi", 0, "affix", "etymology_templates:1:pre", 2, None),
    ("qc", "nomu", None, "qa", "nomi", 0, "borrowed", "etymology_templates:0:etymon", None, None),
    ("qc", "no", None, "qc", "nomu", 0, "affix", "etymology_templates:0:etymon", 1, None),
    ("qc", "mu", None, "qc", "nomu", 0, "affix", "etymology_templates:0:etymon", 2, None),
    ("qa", "pa-", None, "qa", "palimo", 0, "affix", "etymology_templates:0:confix", 1, None),
    ("qa", "li", None, "qa", "palimo", 0, "affix", "etymology_templates:0:confix", 2, None),
    ("qa", "-mo", None, "qa", "palimo", 0, "affix", "etymology_templates:0:confix", 3, None),
    ("qa", "palo", None, "qa", "palimo", 0, "affix", "etymology_templates:1:infix", 1, None),
    ("qa", "-im-", None, "qa", "palimo", 0, "affix", "etymology_templates:1:infix", 2, None),
    ("qa", "poo", None, "qa", "pori", 0, "affix", "etymology_templates:0:af", 1, None),
    ("qb", "ri", None, "qa", "pori", 0, "affix", "etymology_templates:0:af", 2, "z"),
    ("qa", "po", None, "qa", "pori", 0, "compound", "etymology_templates:1:com", 1, None),
    ("qd-pro", "reka", None, "qd-pro", "reku", 0, "inherited", "etymology_templates:0:inh+", None, None),
    ("qa", "sa", None, "qa", "same", 0, "blend", "etymology_templates:2:blend", 1, None),
    ("qa", "me", None, "qa", "same", 0, "blend", "etymology_templates:2:blend", 2, None),
    ("qb", "tav", None, "qa", "tavo", 0, "borrowed", "etymology_templates:0:bor", None, "x1"),
    ("qb", "tavu", None, "qa", "tavo", 0, "borrowed", "etymology_templates:0:bor", None, "x1"),
    ("qc", "tav", None, "qa", "tavo", 0, "borrowed", "etymology_templates:0:bor", None, "x1"),
    ("qc", "tavu", None, "qa", "tavo", 0, "borrowed", "etymology_templates:0:bor", None, "x1"),
    ("qa", "tavo", None, "qa", "tavos", 0, "inflection", "senses:0:form_of", None, None),
    ("qb", "zor", None, "qa", "zoro", 0, "derived", "etymology_templates:0:der", None, "k2"),
]
_CLAIMS = [
    ("qa", "gap", 3, "break", None, None),
    ("qa", "gap", 3, "hole", None, None),
    ("qa", "gap", 3, "other", None, None),
    ("qa", "gap", 3, "void", None, None),
    ("qb", "gapa", 1, None, "qa", "gap"),
    ("qb", "gapa", 1, None, "qb", "gapal"),
    ("qb", "gapa", 1, None, "qb", "gapu"),
    ("qb", "gapa", 1, None, "qc", "gep"),
]
_TERMS = [
    ("QVX", False, 1, 0, 0, 0),
    ("hi", False, 1, 0, 0, 0),
    ("qa", False, 45, 24, 16, 1),
    ("qb", False, 10, 1, 0, 0),
    ("qc", False, 6, 0, 0, 0),
    ("qd-pro", True, 6, 1, 1, 0),
    ("sa", False, 1, 0, 0, 0),
]


def _normalized(spark: SparkSession) -> dict[str, DataFrame]:
    return N.normalize(*_dictionary(spark))


@query(_values(_EDGES, ", ".join(_EDGE)))
def normalize_edges(spark: SparkSession, d: str) -> DataFrame:
    return _normalized(spark)["stg_edge"].select(*_EDGE)


@query(_values(_CLAIMS, "lang_code, headword, section, wiktionary_id, listed_lang_code, listed_headword"))
def normalize_claims(spark: SparkSession, d: str) -> DataFrame:
    return _normalized(spark)["stg_section_claim"]


@query(_values(_TERMS, "lang_code, is_reconstructed, n_headwords, n_with_sense, n_glosses, n_pos"))
def normalize_terms(spark: SparkSession, d: str) -> DataFrame:
    t = _normalized(spark)["stg_term"].groupBy("lang_code", "is_reconstructed")
    return t.agg(F.count_distinct("headword").alias("n_headwords"), F.count_if("has_sense").alias("n_with_sense"), F.count("gloss").alias("n_glosses"), F.count("part_of_speech").alias("n_pos"))


@query(_values([("same term", 1), ("variety", 1), ("section", 1)], "kind, n_edges"))
def normalize_loops(spark: SparkSession, d: str) -> DataFrame:
    """Edges from a term to itself that the dictionary states, by kind."""
    return _normalized(spark)["loops"]


@query(_values([("odd", 2), ("etymon:zz", 1)], "name, n"))
def normalize_unmapped(spark: SparkSession, d: str) -> DataFrame:
    """Templates and codes without a meaning; those known to state no ancestry don't count."""
    return N.unmapped_names(_dictionary(spark)[0])


# Relation type -> template that states it, by the places its arguments have.
_SOURCE_SECOND = {
    "inherited": "inh", "borrowed": "bor", "learned_borrowing": "lbor", "semi_learned_borrowing": "slbor", "derived": "der", "calque": "cal",
    "semantic_loan": "sl", "transliteration": "translit", "root": "root",
}
_PIECES = {"affix": "af", "compound": "com", "blend": "blend", "univerbation": "univerbation", "surface_analysis": "surf"}
_ONE = {"mention": "m", "shortening": "clipping", "reduplication": "reduplication"}
_CODE = {"metathesis": "metathesis", "influence": "influence"}
_ALL = _SOURCE_SECOND | _PIECES | _ONE | dict.fromkeys(_CODE, "etymon")


def written_back(edges: DataFrame) -> DataFrame:
    """Staged edges as dictionary lines (``value``), an entry each; relations that no template states are left out."""
    kind = F.col("rel_type")
    arg = lambda *a: F.create_map(*[x if not isinstance(x, str) else F.lit(x) for x in a])
    src, word, dst = F.col("src_lang_code"), F.col("src_headword"), F.col("dst_lang_code")
    args = (
        F.when(kind.isin(*_SOURCE_SECOND), arg("1", dst, "2", src, "3", word)).when(kind.isin(*_PIECES), arg("1", src, "2", word)).when(kind.isin(*_ONE), arg("1", src, "2", word))
        .when(kind.isin(*_CODE), arg("1", dst, "2", F.concat(F.lit(":"), kind), "3", F.concat(src, F.lit(":"), word)))
    )
    name = F.try_element_at(X.code_map(_ALL), kind)
    template = F.array(F.struct(name.alias("name"), args.alias("args")))
    number = F.when(F.col("dst_section") > 0, F.col("dst_section").cast("string"))
    entry = F.struct(F.col("dst_headword").alias("word"), dst.alias("lang_code"), number.alias("etymology_number"), template.alias("etymology_templates"))
    return edges.where(kind.isin(*_ALL)).select(F.to_json(entry).alias("value"))


_NAMES = "case rel_type " + " ".join(f"when '{k}' then '{v}'" for k, v in _ALL.items()) + " end"


@query(f"""select distinct src_lang_code, src_headword, dst_lang_code, dst_headword, dst_section, rel_type, 'etymology_templates:0:' || {_NAMES} as anchor,
  cast(case when rel_type in ({", ".join(f"'{k}'" for k in _PIECES)}) then 1 end as smallint) as piece_order
from stg_edge where {_NAMES} is not null and not (src_lang_code = dst_lang_code and src_headword = dst_headword)""")
def normalize_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The staged edges written back as entries and normalized again."""
    entries = dump.entries_of(written_back(table(spark, d, "stg_edge")))
    items = N.normalize(entries, table(spark, d, "language_record"), table(spark, d, "variety"))
    return items["stg_edge"].select("src_lang_code", "src_headword", "dst_lang_code", "dst_headword", "dst_section", "rel_type", "anchor", "piece_order").distinct()


@query("""with e as (select lang_code, headword, section, is_reconstructed, part_of_speech, gloss, has_sense from stg_term), n as (
  select src_lang_code, src_headword, src_section, false, null, null, false from stg_edge union all select dst_lang_code, dst_headword, dst_section, false, null, null, false from stg_edge)
select lang_code, count(*) as n_terms, count(distinct headword) as n_headwords, count(*) filter (has_sense) as n_with_sense from (select * from e union all select * from n) group by 1""")
def staged_terms(spark: SparkSession, d: str) -> DataFrame:
    """Rows of all staged terms: those written for a page and one for either end of each edge."""
    cols = ["lang_code", "headword", "section", "has_sense"]
    e = table(spark, d, "stg_edge")
    ends = [e.select(*[F.col(f"{s}_{c}").alias(c) for c in cols[:3]], F.lit(False).alias("has_sense")) for s in ("src", "dst")]
    t = reduce(DataFrame.unionByName, [table(spark, d, "stg_term").select(*cols), *ends])
    return t.groupBy("lang_code").agg(F.count(F.lit(1)).alias("n_terms"), F.count_distinct("headword").alias("n_headwords"), F.count_if("has_sense").alias("n_with_sense"))


@query("""with g as (select *, row_number() over (order by trees.tree_id) as line from (select distinct tree_id, lang_code, page from ety_tree where tree_id is not null and lang_code is not null and page is not null) trees)
select lang_code, page as word, min(line) as first from g group by 1, 2 order by first limit 100""")
def first_tree_words(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred words, in the order of the dump, whose etymology asks for a rendered tree."""
    from glossloom.operators import crosscheck, merge

    pages = table(spark, d, "ety_tree").select("tree_id", "lang_code", "page").where("tree_id is not null and lang_code is not null and page is not null").distinct()
    lines = merge.numbered(spark, pages, ["tree_id", "lang_code", "page"], "line")
    ask = F.array(F.struct(F.lit("etymon").alias("name"), F.create_map(F.lit("tree"), F.lit("1")).alias("args")))
    entries = Scratch(spark).save(lines.select("line", "lang_code", F.col("page").alias("word"), ask.alias("etymology_templates")))
    return crosscheck.first_tree_words(entries, "line", 100)
