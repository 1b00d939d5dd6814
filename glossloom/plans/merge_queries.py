"""Queries of the merge operators over the staged tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossloom.functions import registry as R
from glossloom.functions import text as X
from glossloom.operators import merge as M
from glossloom.plans.graph_queries import Query
from glossloom.session import Scratch, table

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return put


def _t(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in names]


_KEYS = """keys as (select lang_code, headword, coalesce(bool_or(is_reconstructed) filter (has_sense), bool_or(is_reconstructed)) as is_reconstructed,
  bool_or(has_sense) as has_sense from stg_term where lang_code is not null and headword is not null group by 1, 2)"""
# Decomposition of the marked letters that occur, enough to compare by.
_FOLD = "translate(replace(replace(replace(replace({0}, 'ǟ', 'ä'), 'ā̈', 'ä'), chr(772), ''), chr(774), ''), 'āēīōūăĕĭŏŭǖ', 'aeiouaeiouü')"
_ALIAS = f"""{_KEYS}, k as (select *, nfc_normalize({_FOLD.format("nfc_normalize(headword)")}) as f, headword from keys where not is_reconstructed),
m as (select *, f <> nfc_normalize(headword) as marked from k),
alias as (select s.lang_code, s.headword as from_headword, coalesce(min(t.headword) filter (t.has_sense), min(t.headword)) as to_headword
  from m s join m t on s.lang_code = t.lang_code and s.f = t.f and s.headword <> t.headword and (t.has_sense or not t.marked)
  where s.marked and not s.has_sense group by 1, 2 having count(*) filter (t.has_sense) = 1 or count(*) = 1)"""
_ID = """ids as (select lang_code, headword, wiktionary_id, min(section) as section from stg_section_claim where wiktionary_id is not null
  group by 1, 2, 3 having count(distinct section) = 1)"""
_LIST = """lists as (select lang_code, headword, listed_lang_code, listed_headword, min(section) as section from stg_section_claim
  where listed_headword is not null group by 1, 2, 3, 4 having count(distinct section) = 1)"""
_STATED = f"""{_ALIAS}, {_ID}, {_LIST}, cited as (
  select distinct e.src_lang_code, coalesce(sa.to_headword, e.src_headword) as src_headword, e.src_variety_code, e.dst_lang_code,
    coalesce(da.to_headword, e.dst_headword) as dst_headword, e.dst_section, e.rel_type, e.anchor, e.piece_order, e.src_section, e.src_wiktionary_id
  from stg_edge e left join alias sa on sa.lang_code = e.src_lang_code and sa.from_headword = e.src_headword
  left join alias da on da.lang_code = e.dst_lang_code and da.from_headword = e.dst_headword
  where e.src_lang_code in (select code from language_record) and e.dst_lang_code in (select code from language_record)
), stated as (
  select c.*, coalesce(i.section, l.section, c.src_section) as stated from cited c
  left join ids i on i.lang_code = c.src_lang_code and i.headword = c.src_headword and i.wiktionary_id = c.src_wiktionary_id
  left join lists l on c.dst_section = 0 and l.lang_code = c.src_lang_code and l.headword = c.src_headword and l.listed_lang_code = c.dst_lang_code and l.listed_headword = c.dst_headword
  where not (c.src_lang_code = c.dst_lang_code and c.src_headword = c.dst_headword)
), spread as (
  select *, case when stated <> 0 then stated when min(nullif(stated, 0)) over w = max(nullif(stated, 0)) over w then min(nullif(stated, 0)) over w else 0 end as src_sec
  from stated window w as (partition by src_lang_code, src_headword, dst_lang_code, dst_headword, dst_section)
)"""


@query(f"with {_KEYS} select * from keys")
def term_key_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return M.term_keys(table(spark, d, "stg_term"))


def _alias(spark: SparkSession, d: str) -> DataFrame:
    return M.aliases(M.term_keys(table(spark, d, "stg_term")))


@query(f"with {_ALIAS} select * from alias")
def alias_fold(spark: SparkSession, d: str) -> DataFrame:
    return _alias(spark, d)


# strip_accents also drops U+034F, whose combining class is 0; a stand-in that is no mark keeps it.
@query("select distinct headword, replace(strip_accents(replace(headword, chr(847), chr(57344))), chr(57344), chr(847)) as folded from stg_term where headword is not null")
def accent_fold(spark: SparkSession, d: str) -> DataFrame:
    """Every headword without combining marks."""
    t = table(spark, d, "stg_term").where("headword is not null").select("headword").distinct()
    return t.select("headword", X.accent_folded("headword").alias("folded"))


@query(f"with {_ID} select * from ids")
def id_section_pick(spark: SparkSession, d: str) -> DataFrame:
    return M.id_sections(table(spark, d, "stg_section_claim"))


@query(f"with {_LIST} select * from lists")
def listing_section_pick(spark: SparkSession, d: str) -> DataFrame:
    return M.listing_sections(table(spark, d, "stg_section_claim"))


@query("select count(*) as n_edges, count(*) filter (src_lang_code is null or dst_lang_code is null or src_lang_code not in (select code from language_record) "
       "or dst_lang_code not in (select code from language_record)) as n_unknown from stg_edge")  # fmt: skip
def unknown_language_share(spark: SparkSession, d: str) -> DataFrame:
    return M.unknown_language_share(*_t(spark, d, "stg_edge", "language_record"))


_EDGE_KEY = "src_lang_code, src_headword, src_sec as src_section, dst_lang_code, dst_headword, dst_section, rel_type"


@query(f"with {_STATED} select {_EDGE_KEY}, anchor, piece_order, src_variety_code from spread "
       "qualify row_number() over (partition by src_lang_code, src_headword, src_sec, dst_lang_code, dst_headword, dst_section, rel_type "
       "order by coalesce(try_cast(split_part(anchor, ':', 2) as int), 1073741824), anchor, src_variety_code nulls first, piece_order nulls first) = 1")  # fmt: skip
def edge_dedupe_first_anchor(spark: SparkSession, d: str) -> DataFrame:
    e, c, lang = _t(spark, d, "stg_edge", "stg_section_claim", "language_record")
    return M.merged_edges(e, c, _alias(spark, d), lang)


@query(f"with {_STATED} select src_sec as src_section, count(*) as n_edges, count(*) filter (stated = 0 and src_sec <> 0) as n_spread from spread group by 1")
def section_spread(spark: SparkSession, d: str) -> DataFrame:
    """Resolved sections and how many edges took theirs from a sibling."""
    e, c, lang = _t(spark, d, "stg_edge", "stg_section_claim", "language_record")
    s = M.stated_edges(e, c, _alias(spark, d), lang).withColumn("_st", F.col("stated_section"))
    return M.spread_sections(s).groupBy("src_section").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if((F.col("_st") == 0) & (F.col("src_section") != 0)).alias("n_spread"))


@query(f"""with {_ALIAS} select e.src_lang_code as lang_code, coalesce(s.to_headword, e.src_headword) as headword, count(*) as n_edges from stg_edge e
left join alias s on s.lang_code = e.src_lang_code and s.from_headword = e.src_headword left join alias t on t.lang_code = e.dst_lang_code and t.from_headword = e.dst_headword
where e.src_lang_code = e.dst_lang_code and e.src_lang_code in (select code from language_record)
and coalesce(s.to_headword, e.src_headword) = coalesce(t.to_headword, e.dst_headword) group by all""")
def same_term_edges(spark: SparkSession, d: str) -> DataFrame:
    e, lang = _t(spark, d, "stg_edge", "language_record")
    return M.same_term_edges(e, _alias(spark, d), lang)


@query(f"""with {_ALIAS}, c as (select e.src_lang_code as lang_code, coalesce(s.to_headword, e.src_headword) as headword, src_wiktionary_id as wiktionary_id from stg_edge e
left join alias s on s.lang_code = e.src_lang_code and s.from_headword = e.src_headword where src_wiktionary_id is not null)
select lang_code, headword, wiktionary_id, count(*) as n_edges from c
where exists (select 1 from stg_term t where t.lang_code = c.lang_code and t.headword = c.headword and t.section <> 0 and t.has_sense)
and not exists (select 1 from stg_section_claim q where q.lang_code = c.lang_code and q.headword = c.headword and q.wiktionary_id = c.wiktionary_id) group by all""")
def undeclared_ids(spark: SparkSession, d: str) -> DataFrame:
    e, t, c = _t(spark, d, "stg_edge", "stg_term", "stg_section_claim")
    return M.undeclared_ids(e, t, c, _alias(spark, d))


@query(f"""with {_ALIAS}, kept as (select lang_code, headword from keys k where lang_code in (select code from language_record)
  and not exists (select 1 from alias a where a.lang_code = k.lang_code and a.from_headword = k.headword))
select row_number() over (order by lang_code, headword) as term_id, lang_code, headword from kept""")
def merged_terms(spark: SparkSession, d: str) -> DataFrame:
    return M.terms_numbered(spark, *_t(spark, d, "stg_term", "language_record")).select("term_id", "lang_code", "headword")


_TERM = f"""{_ALIAS}, kept as (select lang_code, headword from keys k where lang_code in (select code from language_record)
  and not exists (select 1 from alias a where a.lang_code = k.lang_code and a.from_headword = k.headword)),
term as (select row_number() over (order by lang_code, headword) as term_id, lang_code, headword from kept)"""


@query(f"""with {_TERM} select distinct term_id, section, part_of_speech, gloss from stg_term s join term t on t.lang_code = s.lang_code and t.headword = s.headword where has_sense""")
def merged_senses(spark: SparkSession, d: str) -> DataFrame:
    t, lang = _t(spark, d, "stg_term", "language_record")
    return M.senses_of(t, Scratch(spark).save(M.terms_numbered(spark, t, lang)))


@query(f"""with {_STATED}, {_TERM[_TERM.index("kept as"):]}, vars as (select code, row_number() over (order by code) as variety_id from (select distinct code from variety where code is not null)),
one as (select * from spread qualify row_number() over (partition by src_lang_code, src_headword, src_sec, dst_lang_code, dst_headword, dst_section, rel_type
  order by coalesce(try_cast(split_part(anchor, ':', 2) as int), 1073741824), anchor, src_variety_code nulls first, piece_order nulls first) = 1)
select s.term_id as src_term_id, src_sec as src_section, t.term_id as dst_term_id, dst_section, rel_type, variety_id as src_variety_id, anchor, piece_order
from one join term s on s.lang_code = src_lang_code and s.headword = src_headword join term t on t.lang_code = dst_lang_code and t.headword = dst_headword left join vars v on v.code = src_variety_code""")
def merged_edges_by_id(spark: SparkSession, d: str) -> DataFrame:
    """The edges of the graph with the ids of their ends and varieties."""
    t, e, c, lang, var = _t(spark, d, "stg_term", "stg_edge", "stg_section_claim", "language_record", "variety")
    scratch = Scratch(spark)
    alias = scratch.save(M.aliases(M.term_keys(t)))
    term = scratch.save(M.terms_numbered(spark, t, lang, alias))
    return M.edges_of(M.merged_edges(e, c, alias, lang), term, M.varieties_numbered(spark, var)).drop("src_variety_code")


@query("""select anchor_name as template, rel_type, n_edges from (select split_part(anchor, ':', 3) as anchor_name, rel_type, count(*) as n_edges from stg_edge group by all)""")
def template_tally(spark: SparkSession, d: str) -> DataFrame:
    """Edges by template and relation."""
    return table(spark, d, "stg_edge").groupBy(X.anchor_name("anchor").alias("template"), "rel_type").agg(F.count(F.lit(1)).alias("n_edges"))


@query("""with c as (select code as key, code, cast(null as varchar) as variety_code from language_record union select v.code, v.parent, v.code from variety v join language_record l on l.code = v.parent),
raw as (select distinct upper(code) as raw_code from variety union select code from variety union select lang_code from stg_term where lang_code is not null),
x as (select raw_code, c.code, c.variety_code from raw join c on raw_code = key),
y as (select raw_code, arg_min(c.code, key) as code, arg_min(c.variety_code, key) as variety_code from raw left join c on lower(raw_code) = lower(key) and split_part(raw_code, '-', 1) = split_part(key, '-', 1)
  where raw_code not in (select raw_code from x) group by 1)
select * from x union all select raw_code, coalesce(code, raw_code), variety_code from y""")
def language_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Every code in use, and varieties' codes in another case, as the language they file under."""
    lang, var, terms = _t(spark, d, "language_record", "variety", "stg_term")
    raw = var.select(F.upper("code").alias("raw_code")).unionByName(var.selectExpr("code as raw_code")).unionByName(terms.selectExpr("lang_code as raw_code"))
    return R.resolve(raw, "raw_code", R.code_dim(lang, var))


@query("""with recursive s as (select distinct code, superset from language_set), p as (
  select code, code as root, code as path, 0 as depth from s where superset is null or superset not in (select code from s)
  union all select s.code, p.root, p.path || ':' || s.code, p.depth + 1 from s join p on s.superset = p.code)
select s.code, coalesce(p.root, '') as root, p.path, cast(coalesce(p.depth, -1) as int) as depth from (select distinct code from s) s left join p using (code)""")
def set_paths(spark: SparkSession, d: str) -> DataFrame:
    return R.set_paths(spark, table(spark, d, "language_set"))


@query("""with recursive s as (select distinct code, superset from language_set), p as (
  select code, code as root from s where superset is null or superset not in (select code from s) union all select s.code, p.root from s join p on s.superset = p.code),
l as (select distinct code, coalesce(root, family) as root from (select r.code, r.family, p.root from language_record r left join p on p.code = r.family))
select count(*) as n_terms from stg_term t left join l on l.code = t.lang_code left join l m on m.code = split_part(t.lang_code, '-', 1)
where case when l.code is not null then l.root else m.root end in ('zaa', 'zbh')""")
def scope_filter(spark: SparkSession, d: str) -> DataFrame:
    """Terms of the languages in two of the root families."""
    lang, sets, terms = _t(spark, d, "language_record", "language_set", "stg_term")
    return R.in_scope(terms, "lang_code", lang, R.set_paths(spark, sets), ["zaa", "zbh"]).agg(F.count(F.lit(1)).alias("n_terms"))


@query("""select code, name, case when lower(code) = 'old' then 0 when lower(code) like 'old%' then 1 else 2 end as rank from language_record
where lower(code) like 'old%' or lower(name) like '%old%'""")
def language_search_rank(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "language_record").select("code", "name", X.search_rank("old", "code", "name").alias("rank"))
    return t.where("rank is not null").orderBy("rank", "code")


@query("select term_id, headword, case when coalesce(is_reconstructed, false) then '*' || headword else headword end as shown from (select distinct term_id, headword, is_reconstructed from term_snapshot)")
def display_headwords(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "term_snapshot").select("term_id", "headword", "is_reconstructed").distinct()
    return t.select("term_id", "headword", X.display_headword("headword", F.coalesce("is_reconstructed", F.lit(False))).alias("shown"))


def _folded_sql(c: str) -> str:
    return f"lower(replace(strip_accents(replace(regexp_replace({c}, '^\\*', ''), chr(847), chr(57344))), chr(57344), chr(847)))"


@query(f"""with recursive t as (
  select distinct tree_id, tree_json from ety_tree where tree_json is not null and json_valid(tree_json) and json_type(tree_json) = 'OBJECT'
), walk as (
  select tree_id, cast(tree_json as json) as j, cast(null as json) as rel, cast(null as varchar) as dst_lang, cast(null as varchar) as dst_term,
    json_extract_string(tree_json, '$.lang') as lang, coalesce(nullif(json_extract_string(tree_json, '$.term'), ''), json_extract_string(tree_json, '$.alt')) as term, 0 as lvl from t
  union all
  select tree_id, x, r, lang, term, coalesce(json_extract_string(x, '$.lang'), ''), coalesce(nullif(json_extract_string(x, '$.term'), ''), json_extract_string(x, '$.alt'), ''), lvl + 1
  from (select tree_id, lang, term, lvl, r, json_extract(r, '$.terms[' || i || ']') as x from (select *, unnest(range(cast(json_array_length(r, '$.terms') as bigint))) as i
        from (select tree_id, lang, term, lvl, json_extract(j, '$.children[' || k || ']') as r from (select *, unnest(range(cast(json_array_length(j, '$.children') as bigint))) as k
              from walk where json_type(j, '$.children') = 'ARRAY')) where json_type(r, '$.terms') = 'ARRAY'))
), link as (
  select distinct tree_id, coalesce(json_extract_string(rel, '$.keyword'), '') as keyword, lang as src_lang, term as src_term, dst_lang, dst_term from walk where lvl > 0 and term <> '' and dst_term <> ''
), have as (select distinct src_lang_code as sl, {_folded_sql("src_headword")} as sh, dst_lang_code as dl, {_folded_sql("dst_headword")} as dh from stg_edge)
select * from link where not exists (select 1 from have where sl = src_lang and sh = {_folded_sql("src_term")} and dl = dst_lang and dh = {_folded_sql("dst_term")})""")
def missing_edges_anti(spark: SparkSession, d: str) -> DataFrame:
    """Links of rendered trees that no staged edge states."""
    from glossloom.operators import crosscheck

    return crosscheck.missing(crosscheck.tree_edges(table(spark, d, "ety_tree")), table(spark, d, "stg_edge"))


@query("""select p_partkey, i as piece, case when i = 1 and not ends_with(w, '-') then w || '-' when i = n and i > 1 and not starts_with(w, '-') then '-' || w else w end as shown
from (select p_partkey, len(s) as n, unnest(range(1, len(s) + 1)) as i, s[i] as w from (select p_partkey, string_split(p_name, ' ') as s from part))""")
def affix_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The words of a name as pieces of a confix: the first with a trailing, the last with a leading dash."""
    s = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("s"))
    s = s.select("p_partkey", F.size("s").alias("n"), F.posexplode("s").alias("i", "w"))
    side = F.when(F.col("i") == 0, "trailing").when(F.col("i") == F.col("n") - 1, "leading")
    return s.select("p_partkey", (F.col("i") + 1).alias("piece"), F.coalesce(X.affix_dash("w", side), "w").alias("shown"))


@query("""select code, trim(x) as alias from (select distinct code, unnest(string_split(concat_ws(', ', code, iso639_1, iso639_2b, iso639_3), ',')) as x from language_record) where trim(x) <> ''""")
def directional_langs(spark: SparkSession, d: str) -> DataFrame:
    """Comma lists of language codes, one row per code."""
    t = table(spark, d, "language_record").select("code", F.concat_ws(", ", "code", "iso639_1", "iso639_2b", "iso639_3").alias("list")).distinct()
    return t.select("code", F.explode(X.lang_codes("list")).alias("alias"))
