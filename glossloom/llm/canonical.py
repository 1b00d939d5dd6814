"""Problem 7: freely entered values mapped to the closest entry of a reference list, in SQL only.

A reference string is cut into k+1 segments, k being its edit budget. Whatever k edits do to it, one
segment survives, at a position shifted by at most the edits before and after it. So the segments are
joined by equality with the value's substrings at the positions possible; ``levenshtein`` verifies the
few pairs left, and values without a pair come out of an anti-join.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossloom.session import Scratch

# Latin letters without a decomposition and their base letters.
_BASES = {"ð": "d", "þ": "t", "đ": "d", "æ": "a", "œ": "o", "ø": "o", "ł": "l", "ı": "i", "ħ": "h", "ŋ": "n", "ß": "s"}


def _fold_table() -> tuple[str, str]:
    """Lower-case Latin letters with marks and their base letters, from the decompositions."""
    pairs = dict(_BASES)
    for cp in [*range(0xE0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(cp))
        if len(base) > 1 and base[0].isascii() and base[0].islower():
            pairs[chr(cp)] = base[0]
    return "".join(pairs), "".join(pairs.values())


FOLD_FROM, FOLD_TO = _fold_table()
#: The largest edit budget of any entry.
MOST = 4
#: Default lists for :func:`language_matches`: words that make a language name more specific, which a value
#: may put last or shorten.
QUALIFIERS = ("old", "middle", "proto")
#: Words around a name that say nothing.
FILLERS = ("from", "in", "the", "of", "lang", "language")


class Dialect:
    """The few spellings in which Spark SQL and the ANSI dialect of the tests differ."""

    def __init__(self, spark: bool = True):
        self.spark = spark

    def sub(self, col: str, pattern: str, to: str) -> str:
        p = "r'" + pattern.replace("'", r"\x27") + "'" if self.spark else "'" + pattern.replace("'", "''") + "'"
        return f"regexp_replace({col}, {p}, '{to}')" if self.spark else f"regexp_replace({col}, {p}, '{to.replace('$', chr(92))}', 'g')"

    def words(self, col: str) -> str:
        return f"split({col}, ' ')" if self.spark else f"string_split({col}, ' ')"

    def fold(self, col: str) -> str:
        """Lower case, blanks and dashes of one kind, no marks, nothing that does not show."""
        out = f"lower({col})"
        out = self.sub(out, r"[\x{300}-\x{36F}\x{200B}-\x{200F}\x{2060}\x{FEFF}\x{AD}\x{B7}]", "")
        out = self.sub(out, r"[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+", " ")
        out = self.sub(out, r"[\x{2010}-\x{2015}\x{2212}]", "-")
        return f"translate({out}, '{FOLD_FROM}', '{FOLD_TO}')"


def name_form(d: Dialect, col: str, qualifiers: Sequence[str] = QUALIFIERS, fillers: Sequence[str] = FILLERS) -> str:
    """A language name as entered, brought to 'qualifier name' in lower case; also used on the list."""
    out = d.fold(col)
    for q in qualifiers:  # shortened with a full stop, e.g. "o." or "midd."
        heads = "|".join(q[:n] for n in range(len(q) - 1, 0, -1))
        out = d.sub(out, rf"(^|[ ,(])({heads})\. ?", f"$1{q} ")
    out = d.sub(out, r"[^a-z0-9]+", " ")
    out = f"trim({out})"
    if fillers:
        out = d.sub(out, rf"^(({'|'.join(fillers)}) )+", "")
        out = d.sub(out, rf"( ({'|'.join(fillers)}))+$", "")
    return d.sub(out, rf"^(.+) ({'|'.join(qualifiers)})$", "$2 $1") if qualifiers else out


def lemma_form(d: Dialect, col: str) -> str:
    """A lemma as entered without gloss, wiki marks, quotes and stars; words stay apart."""
    out = d.fold(col)
    out = d.sub(out, r"\([^()]*\)|\x{2018}[^\x{2019}]*\x{2019}", " ")
    out = d.sub(out, r"\{\{[a-z+-]+\||\}\}|\[\[|\]\]", " ")
    out = d.sub(out, r"[*\x27\x{22}\x{201C}-\x{201F}\x{2018}\x{2019}.,;:?!]+", "")
    out = d.sub(out, r"-", "")
    return f"trim({d.sub(out, ' +', ' ')})"


def budget(col: str) -> str:
    """Edit budget of a lemma by its length; two letters swapped are two edits."""
    return f"case when length({col}) >= 10 then 4 when length({col}) = 9 then 3 when length({col}) >= 6 then 2 when length({col}) >= 3 then 1 else 0 end"


def name_budget(col: str) -> str:
    return f"case when length({col}) >= 6 then 2 when length({col}) >= 3 then 1 else 0 end"


def pigeonhole_sql(values: str, refs: str) -> str:
    """SQL for the best entry of ``refs(key, r, k)`` for each ``values(raw, v)``: ``raw``, ``key``, ``dist``.

    Of equally close entries the longest, that is the most specific, counts, then the least key. ``k`` must be below the length of ``r``.
    """
    return f"""
with cut as (
  select key, r, k, length(r) as len, length(r) div (k + 1) as base, length(r) % (k + 1) as extra from {refs} where r <> ''
), seg as (
  select key, r, k, len, i,
         (i - 1) * base + greatest(0, i - 1 - (k + 1 - extra)) + 1 as at,
         base + case when i > k + 1 - extra then 1 else 0 end as wide
  from cut lateral view explode(sequence(1, k + 1)) as i
), shape as (select distinct len, k, i, at, wide from seg),
word as (select distinct v, length(v) as n from {values} where v <> ''),
near as (
  select v, n, len from word lateral view explode(sequence(greatest(1, n - {MOST}), n + {MOST})) as len
), probe as (
  select v, near.len, shape.k, i, p, substring(v, p, wide) as piece
  from near join shape on near.len = shape.len and abs(n - near.len) <= shape.k
  lateral view explode(filter(
    sequence(at - shape.k, at + shape.k),
    p -> p >= 1 and p + wide - 1 <= n and abs(p - at) <= i - 1 and abs(p - at - (n - near.len)) <= shape.k + 1 - i
  )) as p
), pair as (
  select distinct probe.v, seg.key, seg.r, seg.k
  from probe join seg on probe.len = seg.len and probe.k = seg.k and probe.i = seg.i and probe.piece = substring(seg.r, seg.at, seg.wide)
), verified as (
  select v, key, -length(r) as brief, levenshtein(v, r, k) as dist from pair where levenshtein(v, r, k) >= 0
)
select raw, min_by(key, struct(dist, brief, key)) as key, min(dist) as dist
from {values} join verified using (v) group by raw
"""


def map_values(spark: SparkSession, entered: DataFrame, refs: DataFrame, value_form: str, value_variants: str, ref_form: str, k: str) -> DataFrame:
    """``raw``, ``key``, ``dist`` for each distinct entered value that means an entry.

    ``entered`` has ``raw``; ``refs`` has ``key`` and ``name``; ``value_form`` is SQL for the array ``w`` of
    the parts of ``raw``, ``value_variants`` SQL for the array of forms of ``w`` to try, ``ref_form`` and
    ``k`` SQL for the form of ``name`` and its budget.
    Null and empty values and names match nothing; repeated rows count once.
    """
    tag = f"{id(entered):x}_{id(refs):x}"
    entered.select("raw").createOrReplaceTempView(f"_raw_{tag}")
    refs.select("key", "name").createOrReplaceTempView(f"_ref_{tag}")
    # Few bytes but much work: as many parts as the session's shuffles have, whatever the size.
    once = spark.sql(f"select distinct raw from _raw_{tag} where raw is not null")
    once.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "raw").createOrReplaceTempView(f"_once_{tag}")
    spark.sql(f"select raw, {value_form} as w from _once_{tag}").createOrReplaceTempView(f"_word_{tag}")
    spark.sql(f"select raw, v from _word_{tag} lateral view explode(array_distinct({value_variants})) as v").createOrReplaceTempView(f"_val_{tag}")
    spark.sql(f"select distinct key, r, {k.format(col='r')} as k from (select key, {ref_form} as r from _ref_{tag} where name is not null)").createOrReplaceTempView(f"_form_{tag}")
    # One row per distinct value that was matched; kept, because several plans read it.
    return Scratch(spark).save(spark.sql(pigeonhole_sql(f"_val_{tag}", f"_form_{tag}")))


def with_unmatched(spark: SparkSession, entered: DataFrame, found: DataFrame) -> DataFrame:
    """``id``, ``raw``, ``key`` of every entered row; '' where no entry is meant (the anti-join)."""
    tag = f"{id(entered):x}_{id(found):x}"
    entered.select("id", "raw").createOrReplaceTempView(f"_ent_{tag}")
    found.select("raw", "key").createOrReplaceTempView(f"_fnd_{tag}")
    return spark.sql(
        f"select distinct id, raw, key from _ent_{tag} join _fnd_{tag} using (raw) "
        f"union all select distinct e.id, e.raw, '' as key from _ent_{tag} e left anti join _fnd_{tag} f on e.raw = f.raw where e.raw is not null"
    )


def language_codes(languages: DataFrame) -> DataFrame:
    """``code``, ``alias``: every code that names a language, its own first."""
    return languages.selectExpr(
        "code", "explode(concat(array(code, iso639_1, iso639_2b, iso639_3), coalesce(wikimedia_codes, array()))) as alias"
    ).where("alias is not null and alias <> ''").selectExpr("code", "lower(alias) as alias").distinct()


def code_tokens(d: Dialect, col: str) -> str:
    """The words of a value that may be codes."""
    return d.words(f"trim({d.sub(d.fold(col), r'[^a-z0-9-]+', ' ')})")


def language_matches(spark: SparkSession, citations: DataFrame, languages: DataFrame, qualifiers: Sequence[str] = QUALIFIERS, fillers: Sequence[str] = FILLERS) -> DataFrame:
    """``raw``, ``key`` (language code) of each distinct ``lang_text`` that means a language.

    A name, in full, shortened, reordered or misspelled, counts before a code in the same value; names
    are compared whole, so the most specific name is the one met. Codes go through the same join with
    no edits allowed, that is with one segment, and are tried for what no name was found for. Nulls and
    empty values match nothing.
    """
    d = Dialect()
    form = lambda col: name_form(d, col, qualifiers, fillers)
    raw = citations.selectExpr("lang_text as raw")
    # A code in brackets or before a dash may stand beside the name.
    bare = d.sub("raw", r"[\[(][A-Za-z0-9-]+[\])] *$|^ *[A-Za-z0-9]+(-pro)? +- +", "")
    by_name = map_values(spark, raw, languages.selectExpr("code as key", "name"), f"array({form('raw')}, {form(bare)})", "w", form("name"), name_budget("{col}")).select("raw", "key")
    left = raw.join(by_name.select(F.col("raw").alias("_known")), F.col("raw") == F.col("_known"), "left_anti")
    by_code = map_values(spark, left, language_codes(languages).selectExpr("code as key", "alias as name"), code_tokens(d, "raw"), "w", "name", "0").select("raw", "key")
    return by_name.unionByName(by_code)


def lemma_matches(spark: SparkSession, citations: DataFrame, lemmas: DataFrame) -> DataFrame:
    """``raw``, ``key`` (lemma id as a string) of each distinct ``src_text`` that means a lemma.

    Tried are all runs of the value's words, joined, but those too long for any lemma and its edits: any
    number of blanks may have slipped into the lemma, and a language name may stand before or behind it.
    """
    d = Dialect()
    form = lambda col: f"replace({lemma_form(d, col)}, ' ', '')"
    longest = lemmas.selectExpr(f"{form('headword')} as r").selectExpr(f"max(length(r) + {budget('r')})").first()[0] or 1
    runs = (
        f"flatten(transform(sequence(1, size(w)), i -> filter(transform(sequence(i, least(size(w), i + {longest} - 1)), "
        f"j -> array_join(slice(w, i, j - i + 1), '')), v -> length(v) <= {longest})))"
    )
    return map_values(
        spark, citations.selectExpr("src_text as raw"), lemmas.selectExpr("cast(lemma_id as string) as key", "headword as name"),
        d.words(lemma_form(d, "raw")), runs, form("name"), budget("{col}"),
    ).select("raw", "key")


def mapped_citations(spark: SparkSession, citations: DataFrame, languages: DataFrame, lemmas: DataFrame) -> DataFrame:
    """``citation_id``, ``raw_field``, ``matched_key`` for each citation and non-null field.

    Rows without an id are left out; repeated rows count once. An empty list leaves every value unmatched.
    """
    c = citations.where("citation_id is not null")
    langs = with_unmatched(spark, c.selectExpr("citation_id as id", "lang_text as raw"), language_matches(spark, c, languages))
    words = with_unmatched(spark, c.selectExpr("citation_id as id", "src_text as raw"), lemma_matches(spark, c, lemmas))
    pick = lambda df, name: df.selectExpr("id as citation_id", f"'{name}' as raw_field", "key as matched_key")
    return pick(langs, "lang_text").unionByName(pick(words, "src_text"))
