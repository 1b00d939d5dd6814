"""Queries of the graph operators over the adapter graph, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossloom.operators import walk as G
from glossloom.operators.api import first_from, summaries
from glossloom.operators.merge import pickable
from glossloom.plans.adapter import EDGES, LANGUAGES, SENSES, TERMS, ansi, frame
from glossloom.session import Scratch, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_PRIO = "(case rel_type " + " ".join(f"when '{t}' then {i}" for i, t in enumerate(G.PRIORITY)) + " end)"
_WITH = f"e0 as ({ansi(EDGES)}), sense as ({ansi(SENSES)}), term as ({ansi(TERMS)}), language as ({ansi(LANGUAGES)})"


def query(sql: str | None = None, name: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE[name or f.__name__] = sql
        return f

    return put


def walk_sql(anchors: str, down: bool, cap: int = G.CAP) -> str:
    near, far = ("src", "dst") if down else ("dst", "src")
    fits = lambda s: f"({s} = 0 or near_section = {s}{' or near_section = 0' if down else ''})"
    step = "+ 1" if down else "- 1"
    etym = "case when src_section = 0 then coalesce((select n from sec where term_id = src_term_id), 0) else 0 end"
    cols = "anchor_id, near, far, far_section, src_term_id, src_section, dst_section, rel_type, priority"
    stop = "" if down else "and w.etymology_count < 2"
    return f"""
with recursive {_WITH},
sec as (select term_id, count(distinct section) as n from sense group by 1),
e as (select *, {near}_term_id as near, {far}_term_id as far, {near}_section as near_section, {far}_section as far_section, {_PRIO} as priority from e0 where {_PRIO} is not null),
a as ({anchors}),
w as (
  select {cols}, {etym} as etymology_count, 0 {step} as depth, [far] as path, false as is_cycle, total_children from (
    select *, max(dr) over (partition by anchor_id) as total_children from (
      select *, dense_rank() over (partition by anchor_id order by best, far) as dr from (
        select *, min(priority) over (partition by anchor_id, far) as best from e join a on near = anchor_id where {fits("section")})))
  where dr <= {cap}
  union all
  select {cols}, {etym}, depth, path, is_cycle, total from (
    select *, row_number() over (partition by anchor_id, near order by priority, far, far_section) as rn, count(*) over (partition by anchor_id, near) as total from (
      select *, row_number() over (partition by anchor_id, far, far_section order by priority, near, src_section, dst_section, path) as d from (
        select w.anchor_id, e.near, e.far, e.far_section, e.src_term_id, e.src_section, e.dst_section, e.rel_type, e.priority,
               w.depth {step} as depth, list_append(w.path, e.far) as path, list_contains(w.path, e.far) as is_cycle
        from e join w on e.near = w.far
        where {fits("w.far_section")} and not w.is_cycle and w.rel_type not in ('influence', 'semantic_loan', 'calque') and abs(w.depth) < {G.LIMIT} {stop}))
    where d = 1)
  where rn <= {cap}
)
select anchor_id, depth, near as parent_id, far as child_id, far_section as child_section, rel_type, is_cycle, total_children, etymology_count from w"""


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return frame(spark, d, EDGES), frame(spark, d, SENSES)


def _walked(spark: SparkSession, d: str, anchors: DataFrame, down: bool) -> DataFrame:
    e, s = _graph(spark, d)
    rows = G.walk(spark, e, s, anchors, down)
    return rows.select(
        "anchor_id", "depth", F.col("near").alias("parent_id"), F.col("far").alias("child_id"), F.col("dst_section" if down else "src_section").alias("child_section"),
        "rel_type", "is_cycle", "total_children", "etymology_count",
    )


_REGIONS = "select cast(1 + r_regionkey as bigint) as anchor_id, 0 as section from region"
_NATIONS = "select cast(1001 + n_nationkey as bigint) as anchor_id, 0 as section from nation"
_SUPPLIERS = "select cast(10001 + s_suppkey as bigint) as anchor_id, 1 as section from supplier"
_CUSTOMERS = "select cast(100001 + c_custkey as bigint) as anchor_id, 0 as section from customer"
_PARTS = "select cast(1000001 + p_partkey as bigint) as anchor_id, 0 as section from part"


def _anchors(spark: SparkSession, d: str, sql: str) -> DataFrame:
    name = sql.rsplit(" ", 1)[1]
    return spark.sql(sql.replace(f"from {name}", "from {t}"), t=table(spark, d, name))


for _name, _sql, _down in (
    ("walk_descendants_region", _REGIONS, True), ("walk_batch_nations", _NATIONS, True), ("walk_section_suppliers", _SUPPLIERS, True),
    ("walk_ancestors_customer", _CUSTOMERS, False), ("walk_homograph_stop", _PARTS, False),
):
    query(walk_sql(_sql, _down), _name)(lambda spark, d, s=_sql, down=_down: _walked(spark, d, _anchors(spark, d, s), down))


_OVER = f"with w as ({{}}) select anchor_id, parent_id, arg_max(total_children, (abs(depth), total_children)) - {G.CAP} as n_hidden from w group by all having n_hidden > 0"


@query(_OVER.format(walk_sql(_REGIONS, True)))
def walk_overflow(spark: SparkSession, d: str) -> DataFrame:
    """Children the cap hides below each parent of the regions' walks."""
    return G.overflow(G.walk(spark, *_graph(spark, d), _anchors(spark, d, _REGIONS)))


@query(f"""with {_WITH}
select t.term_id, headword, is_reconstructed, code as lang_code, name as lang_name, not exists (select 1 from sense s where s.term_id = t.term_id) as is_redlink,
  (select arg_min(gloss, (section, coalesce(part_of_speech, ''), gloss)) from sense s where s.term_id = t.term_id and gloss is not null) as gloss
from term t join language using (language_id)""")
def tree_nodes_hydrated(spark: SparkSession, d: str) -> DataFrame:
    t = frame(spark, d, TERMS)
    return G.hydrate(t, t, frame(spark, d, LANGUAGES), frame(spark, d, SENSES))


@query(f"""with {_WITH}
select src_term_id, dst_term_id, anchor, dst_section, 'wiktionary:' || strftime(m.d, '%Y-%m-%d') || ':' || code || ':' || headword
  || case when dst_section > 0 then ':' || dst_section else '' end || '#' || anchor as citation
from e0 join term on term_id = dst_term_id join language using (language_id), (select cast(max(o_orderdate) as date) as d from orders) m""")
def edge_citations(spark: SparkSession, d: str) -> DataFrame:
    e, t, lang = frame(spark, d, EDGES), frame(spark, d, TERMS), frame(spark, d, LANGUAGES)
    date = table(spark, d, "orders").agg(F.max("o_orderdate")).first()[0]
    x = e.join(t, F.col("dst_term_id") == F.col("term_id")).join(lang, "language_id")
    return x.select("src_term_id", "dst_term_id", "anchor", "dst_section", G.source_ref(F.lit(date), F.col("code"), F.col("headword"), F.col("dst_section"), F.col("anchor")).alias("citation"))


@query(f"""with {_WITH}, p as (select *, {_PRIO} as p from e0 where {_PRIO} is not null)
select src_term_id, dst_term_id, array_to_string(list_transform(list_sort(list_distinct(list((p, rel_type)))), lambda x: x[2]), ',') as rel_types, arg_min(rel_type, p) as primary_type,
  min(piece_order) as piece_order, bool_and(src_section = 0) as src_section_unstated, count(*) as n_edges from p group by 1, 2""")
def parallel_edge_merge(spark: SparkSession, d: str) -> DataFrame:
    return G.merge_parallel(frame(spark, d, EDGES))


@query(f"""with w as ({walk_sql(_REGIONS, True)}), nod as (
  select anchor_id, child_id as node, min(depth) as d from w where child_id <> anchor_id group by all union all select distinct anchor_id, anchor_id, 0 from w
), e as (select w.anchor_id, parent_id as other, child_id as node, min({_PRIO}) as rank from w group by all),
x as (
  select e.anchor_id, e.node, other, rank, n.d <> o.d as direct from e join nod n on n.anchor_id = e.anchor_id and n.node = e.node join nod o on o.anchor_id = e.anchor_id and o.node = e.other
  where n.d > 0 and (o.d = n.d - 1 or (o.d = n.d and rank <= 8))
), best as (select *, row_number() over (partition by anchor_id, node order by direct, rank, other) as k from x)
select a.anchor_id, a.node as term_id, coalesce(b.other, a.anchor_id) as parent_id, b.rank from nod a left join best b on b.anchor_id = a.anchor_id and b.node = a.node and k = 1 where a.node <> a.anchor_id""")
def parent_pick(spark: SparkSession, d: str) -> DataFrame:
    """The one neighbour each term of the regions' trees is drawn under."""
    rows = Scratch(spark).save(G.walk(spark, *_graph(spark, d), _anchors(spark, d, _REGIONS)))
    at = rows.where("far <> anchor_id").groupBy("anchor_id", F.col("far").alias("term_id")).agg(F.min("depth").alias("depth"))
    at = at.unionByName(rows.select("anchor_id", F.col("anchor_id").alias("term_id"), F.lit(0).alias("depth")).distinct())
    return G.drawn_under(at, rows).select("anchor_id", "term_id", "parent_id", "rank")


_PICKABLE = f"""{_WITH}, pickable as (
  select t.term_id, t.language_id from term t where exists (select 1 from sense s where s.term_id = t.term_id)
  and t.term_id in (select src_term_id from e0 where rel_type <> 'mention' union select dst_term_id from e0 where rel_type <> 'mention'))"""


@query(f"with {_PICKABLE} select * from pickable")
def pickable_terms(spark: SparkSession, d: str) -> DataFrame:
    e, s = _graph(spark, d)
    return pickable(frame(spark, d, TERMS), s, e).select("term_id", "language_id")


@query(f"with {_PICKABLE} select code, name from language l where exists (select 1 from pickable p where p.language_id = l.language_id)")
def languages_with_pickable(spark: SparkSession, d: str) -> DataFrame:
    p = pickable_terms(spark, d).select("language_id").distinct()
    return frame(spark, d, LANGUAGES).join(p, "language_id", "left_semi").select("code", "name").orderBy("code")


@query(f"""with {_PICKABLE}, r as (select language_id, min(term_id) lo, max(term_id) hi from pickable group by 1)
select language_id, min(term_id) as term_id from pickable join r using (language_id) where term_id >= lo + cast(floor(0.37 * (hi - lo + 1)) as bigint) group by 1""")
def random_term_probe(spark: SparkSession, d: str, draw: float = 0.37) -> DataFrame:
    """For each language the first pickable term at or after a drawn point of its id range."""
    return first_from(pickable_terms(spark, d), ["language_id"], draw)


@query(f"""with {_WITH}, r as (select *, row_number() over (partition by term_id, section order by part_of_speech nulls first, gloss nulls last) k from sense)
select t.term_id, coalesce(section, 0) as section, part_of_speech, gloss from term t left join (select * from r where k = 1) s using (term_id)""")
def term_summaries(spark: SparkSession, d: str) -> DataFrame:
    """One summary per term and section; a red link has one of section 0 without a gloss."""
    return summaries(frame(spark, d, TERMS), frame(spark, d, SENSES))


@query(f"""with {_WITH} select term_id, count(*) as n_senses, array_to_string(list(section || '/' || coalesce(part_of_speech, '-') || '/' || coalesce(gloss, '-')
  order by section, part_of_speech nulls first, gloss nulls first), '; ') as senses from sense group by 1""")
def term_senses(spark: SparkSession, d: str) -> DataFrame:
    """The senses of each term in order."""
    s = frame(spark, d, SENSES).groupBy("term_id").agg(F.count(F.lit(1)).alias("n_senses"), F.sort_array(F.collect_list(F.struct("section", "part_of_speech", "gloss"))).alias("_s"))
    text = F.transform("_s", lambda x: F.concat(x["section"].cast("string"), F.lit("/"), F.coalesce(x["part_of_speech"], F.lit("-")), F.lit("/"), F.coalesce(x["gloss"], F.lit("-"))))
    return s.select("term_id", "n_senses", F.array_join(text, "; ").alias("senses"))


@query(f"with {_WITH} select rel_type, count(*) as n_edges from e0 group by 1")
def rel_type_tally(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, EDGES).groupBy("rel_type").agg(F.count(F.lit(1)).alias("n_edges")).orderBy(F.desc("n_edges"), "rel_type")
