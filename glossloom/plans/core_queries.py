"""Queries of the general problems 1, 2, 3, 4 and 6 over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossloom.operators import hierarchy as H
from glossloom.operators import nested, references, skew, snapshots
from glossloom.session import Scratch, table

Query = Callable[[SparkSession, str], DataFrame]


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _reference_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Orphans of both tables with the month they were loaded in."""
    month = lambda df: df.withColumn("_month", F.date_format("loaded_at", "yyyy-MM"))
    terms = references.orphans(
        month(table(spark, d, "stg_term")), "occurrence_id", ["lang_code"], micros("loaded_at"),
        table(spark, d, "language_record"), ["code"], micros("added_at"), micros("retired_at"), references.TIME_BLOCK, ["_month"],
    )
    edges = references.orphans(
        month(table(spark, d, "stg_edge").where("src_wiktionary_id <> ''")), "edge_id",
        ["src_lang_code", "src_headword", "src_wiktionary_id"], micros("loaded_at"),
        table(spark, d, "stg_section_claim"), ["lang_code", "headword", "wiktionary_id"], micros("loaded_at"), micros("retired_at"),
        references.TIME_BLOCK, ["_month"], refers=[2],
    )
    named = lambda df, t, c: df.select(F.lit(t).alias("ref_table"), F.col(c).alias("record_id"), "_month")
    return named(terms, "stg_term", "occurrence_id").unionByName(named(edges, "stg_edge", "edge_id"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _reference_orphans(spark, d).select("ref_table", "record_id").distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table and month of loading."""
    return _reference_orphans(spark, d).groupBy("ref_table", F.col("_month").alias("month")).agg(F.count_distinct("record_id").alias("n_orphans"))


def p1_snapshot_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Edges of a snapshot whose source or destination term is not in the term snapshot of that date."""
    edges = table(spark, d, "edge_snapshot").select("dump_date", "edge_id", F.explode(F.array("src_term_id", "dst_term_id")).alias("term"))
    terms = table(spark, d, "term_snapshot")
    out = references.orphans(edges, "edge_id", ["dump_date"], "term", terms, ["dump_date"], "term_id", F.col("term_id") + 1, references.ID_BLOCK, ["dump_date", "term"])
    return out.select(F.date_format("dump_date", "yyyy-MM-dd").alias("dump_date"), "edge_id", F.col("term").alias("term_id"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    one = lambda name, key: snapshots.changes(table(spark, d, name), "dump_date", key, ["loaded_at"]).select(F.lit(name).alias("snap_table"), "record_id", "dump_date", "change_kind")
    return one("term_snapshot", "term_id").unionByName(one("edge_snapshot", "edge_id"))


def p2_summary(spark: SparkSession, d: str) -> DataFrame:
    return p2_found(spark, d).groupBy("snap_table", "dump_date", "change_kind").agg(F.count(F.lit(1)).alias("n_records"))


def tree_links(spark: SparkSession, d: str) -> DataFrame:
    sets = table(spark, d, "language_set").select(F.lit("language_set").alias("tree"), F.col("code").alias("node"), F.col("superset").alias("parent"))
    e = table(spark, d, "stg_edge").where("rel_type = 'inherited'")
    end = lambda s: F.concat(F.col(f"{s}_lang_code"), F.lit(":"), F.col(f"{s}_headword"))
    ends = e.select(F.explode(F.array(F.struct(end("dst").alias("node"), end("src").alias("parent")), F.struct(end("src").alias("node"), F.lit(None).cast("string").alias("parent")))).alias("x"))
    return sets.unionByName(ends.select(F.lit("edge").alias("tree"), "x.node", "x.parent"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    h = H.hierarchy(spark, tree_links(spark, d), paths=False)
    return h.select(F.col("tree").alias("tree_name"), "node", F.col("root").alias("root_node"), "depth")


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    """Path and number of descendants of each node."""
    h = H.hierarchy(spark, tree_links(spark, d))
    return h.select(F.col("tree").alias("tree_name"), "node", F.array_join("path", " > ").alias("path"), "n_descendants")


def p3_loops(spark: SparkSession, d: str) -> DataFrame:
    """Nodes without a root: those on a loop and those only below one."""
    h = H.hierarchy(spark, tree_links(spark, d), paths=False).where("depth < 0")
    return h.select(F.col("tree").alias("tree_name"), "node", "on_loop")


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Each node of every tree with every node below it, read off the chain intervals."""
    links = tree_links(spark, d)
    scratch = Scratch(spark)
    h = scratch.save(H.hierarchy(spark, links, paths=False))
    below = H.descendants(h, h.select("tree", "node"))
    return below.select(F.col("tree").alias("tree_name"), F.col("node").alias("ancestor"), "descendant", F.col("steps").cast("int").alias("steps"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    keys = ["src_lang_code", "src_headword", "rel_type"]
    return skew.top_per_key(table(spark, d, "stg_edge"), keys, "edge_id", "loaded_at", 3, 20).select(*keys, "edge_id")


def p4_profile(spark: SparkSession, d: str) -> DataFrame:
    """Per source term and relation: distinct, commonest and median language code of its destinations."""
    keys = ["src_lang_code", "src_headword", "rel_type"]
    e = table(spark, d, "stg_edge").select(*keys, "dst_lang_code")
    return skew.profile(e, keys, "dst_lang_code", lambda v: F.substring(v, 1, 2))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.tree_rows(table(spark, d, "ety_tree"))


def p6_members(spark: SparkSession, d: str) -> DataFrame:
    """Every plain member of every object of a tree, whatever its name, with the link to its parent object."""
    r = nested.records(table(spark, d, "ety_tree"), "tree_id", "tree_json")
    return r.select(F.col("record_id").alias("tree_id"), "table_name", "node_path", "parent_path", F.explode("members").alias("member", "value"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_report, p1_snapshot_orphans, p2_found, p2_summary, p3_found, p3_paths, p3_descendants, p3_loops, p4_found, p4_profile, p6_found, p6_members)
}

_P1 = """
select 'stg_term' as ref_table, occurrence_id as record_id, loaded_at from stg_term t
where lang_code is not null and not exists (select 1 from language_record l where l.code = t.lang_code
  and l.added_at <= t.loaded_at and (l.retired_at is null or l.retired_at > t.loaded_at))
union all
select 'stg_edge', edge_id, loaded_at from stg_edge e
where src_wiktionary_id is not null and src_wiktionary_id <> '' and not exists (select 1 from stg_section_claim c
  where c.lang_code = e.src_lang_code and c.headword = e.src_headword and c.wiktionary_id = e.src_wiktionary_id
  and c.loaded_at <= e.loaded_at and (c.retired_at is null or c.retired_at > e.loaded_at))
"""


def _p2_sql(name: str, key: str, cols: str) -> str:
    return f"""
select '{name}' as snap_table, coalesce(o.{key}, n.{key}) as record_id, strftime(coalesce(o.nxt, n.dump_date), '%Y-%m-%d') as dump_date,
  case when o.{key} is null then 'added' when n.{key} is null then 'removed' else 'changed' end as change_kind
from (select s.*, d.nxt from (select distinct dump_date, {key}, {cols} from {name}) s
      join (select dump_date, lead(dump_date) over (order by dump_date) nxt from (select distinct dump_date from {name})) d using (dump_date) where nxt is not null) o
full join (select distinct dump_date, {key}, {cols} from {name} where dump_date > (select min(dump_date) from {name})) n
  on o.nxt = n.dump_date and o.{key} = n.{key}
where o.{key} is null or n.{key} is null or ({", ".join("o." + c.strip() for c in cols.split(","))}) is distinct from ({", ".join("n." + c.strip() for c in cols.split(","))})
"""


_P2 = (
    _p2_sql("term_snapshot", "term_id", "lang_code, headword, is_reconstructed")
    + " union all "
    + _p2_sql("edge_snapshot", "edge_id", "src_term_id, src_section, dst_term_id, dst_section, rel_type, src_variety_code, anchor, piece_order")
)
_LINKS = """
links as (
  select tree_name, node, min(parent) as parent from (
    select 'language_set' as tree_name, s.code as node, p.code as parent from language_set s left join (select distinct code from language_set) p on p.code = s.superset
    union all select 'edge', dst_lang_code || ':' || dst_headword, src_lang_code || ':' || src_headword from stg_edge where rel_type = 'inherited'
    union all select 'edge', src_lang_code || ':' || src_headword, null from stg_edge where rel_type = 'inherited'
  ) group by 1, 2
), walk as (
  select tree_name, node, node as root_node, 0 as depth, node as path from links where parent is null
  union all
  select l.tree_name, l.node, w.root_node, w.depth + 1, w.path || ' > ' || l.node from links l join walk w on l.tree_name = w.tree_name and l.parent = w.node
)"""
_P3 = f"""with recursive {_LINKS}
select l.tree_name, l.node, coalesce(w.root_node, '') as root_node, cast(coalesce(w.depth, -1) as int) as depth
from links l left join walk w on l.tree_name = w.tree_name and l.node = w.node"""
_UP = """, up as (
  select tree_name, node as anc, node as des, 0 as steps from links
  union all
  select u.tree_name, l.parent, u.des, u.steps + 1 from up u join links l on u.tree_name = l.tree_name and l.node = u.anc where l.parent is not null and u.steps < 200
)"""
# From nodes under a root only, which no loop can reach, so no limit of steps is needed.
_P3_ALL = f"""with recursive {_LINKS}, below as (
  select tree_name, node as ancestor, node as descendant, 0 as steps from walk
  union all
  select b.tree_name, b.ancestor, l.node, b.steps + 1 from below b join links l on l.tree_name = b.tree_name and l.parent = b.descendant
)
select tree_name, ancestor, descendant, steps from below where steps > 0"""
_P4 = """
with e as (select distinct src_lang_code, src_headword, rel_type, edge_id, loaded_at from stg_edge),
r as (select *, count(*) over (partition by src_lang_code, src_headword, rel_type) n,
  row_number() over (partition by src_lang_code, src_headword, rel_type order by loaded_at desc, edge_id desc) k from e)
select src_lang_code, src_headword, rel_type, edge_id from r where n >= 20 and k <= 3"""
_P4_PROFILE = """
with nulls as (select src_lang_code, src_headword, rel_type, count(*) as n_rows, count(*) filter (dst_lang_code is null) as n_null from stg_edge group by all),
f as (select src_lang_code, src_headword, rel_type, dst_lang_code v, count(*) n from stg_edge group by all),
w as (select *, sum(n) over (partition by src_lang_code, src_headword, rel_type order by v) run,
  sum(n) over (partition by src_lang_code, src_headword, rel_type) al from f where v is not null),
r as (select src_lang_code, src_headword, rel_type, count(*) as n_distinct, arg_min(v, (-n, v)) as mode_value, min(case when run >= ceil(0.5 * al) then v end) as percentile_value from w group by all)
select n.*, coalesce(n_distinct, 0) as n_distinct, mode_value, percentile_value from nulls n left join r
  on n.src_lang_code is not distinct from r.src_lang_code and n.src_headword is not distinct from r.src_headword and n.rel_type is not distinct from r.rel_type"""
_P6 = """
with recursive t as (
  select distinct tree_id, tree_json from ety_tree where tree_json is not null and json_valid(tree_json) and json_type(tree_json) = 'OBJECT'
), walk as (
  select tree_id, cast(tree_json as json) as j, '' as node_path, '' as parent_path, cast(null as json) as rel, 0 as lvl from t
  union all
  select tree_id, json_extract(r, '$.terms[' || i || ']'), case when node_path = '' then '' else node_path || '/' end || k || '.' || i, node_path, r, lvl + 1
  from (select tree_id, node_path, lvl, k, r, unnest(range(cast(json_array_length(r, '$.terms') as bigint))) as i
        from (select tree_id, node_path, lvl, k, json_extract(j, '$.children[' || k || ']') as r
              from (select tree_id, node_path, lvl, j, unnest(range(cast(json_array_length(j, '$.children') as bigint))) as k
                    from walk where json_type(j, '$.children') = 'ARRAY'))
        where json_type(r, '$.terms') = 'ARRAY')
)
select tree_id, node_path, parent_path, coalesce(json_extract_string(rel, '$.keyword'), '') as keyword, coalesce(json_extract_string(j, '$.lang'), '') as lang,
  coalesce(nullif(json_extract_string(j, '$.term'), ''), json_extract_string(j, '$.alt'), '') as term
from walk where lvl > 0"""
# The parent object of a value in an array, or in an array in an array, is above the brackets.
_P6_MEMBERS = r"""
with t as (select distinct tree_id, tree_json from ety_tree where tree_json is not null and json_valid(tree_json) and json_type(tree_json) = 'OBJECT'),
n as (select tree_id, x.key, x.atom, x.type, x.path, x.fullkey from t, json_tree(tree_json) x),
plain as (select tree_id, case when ends_with(fullkey, ']') then '' else key end as member, atom, case when ends_with(fullkey, ']') then fullkey else path end as node_path from n where type not in ('OBJECT', 'ARRAY'))
select tree_id, case when node_path = '$' then '' else regexp_extract(regexp_replace(node_path, '(\[[0-9]+\])+$', ''), '[^.]*$') end as table_name, node_path,
  case when node_path = '$' then '' else regexp_replace(node_path, '\.[^.]*$', '') end as parent_path, member, json_extract_string(atom, '$') as value from plain"""

ORACLE: dict[str, str] = {
    "p1_found": f"select distinct ref_table, record_id from ({_P1})",
    "p1_report": f"select ref_table, strftime(loaded_at, '%Y-%m') as month, count(distinct record_id) as n_orphans from ({_P1}) group by all",
    "p1_snapshot_orphans": """
select distinct strftime(e.dump_date, '%Y-%m-%d') as dump_date, edge_id, term as term_id
from (select dump_date, edge_id, unnest([src_term_id, dst_term_id]) as term from edge_snapshot) e
where term is not null and not exists (select 1 from term_snapshot t where t.dump_date = e.dump_date and t.term_id = e.term)""",
    "p2_found": _P2,
    "p2_summary": f"select snap_table, dump_date, change_kind, count(*) as n_records from ({_P2}) group by all",
    "p3_found": _P3,
    "p3_paths": f"""with recursive {_LINKS}{_UP}
select l.tree_name, l.node, w.path, case when w.path is not null then n end as n_descendants
from links l left join walk w on l.tree_name = w.tree_name and l.node = w.node
left join (select tree_name, anc, count(*) - 1 as n from up group by all) c on c.tree_name = l.tree_name and c.anc = l.node""",
    "p3_loops": f"""with recursive {_LINKS}{_UP}
select l.tree_name, l.node, exists (select 1 from up u where u.tree_name = l.tree_name and u.des = l.node and u.anc = l.node and u.steps > 0) as on_loop
from links l left join walk w on w.tree_name = l.tree_name and w.node = l.node where w.node is null""",
    "p3_descendants": _P3_ALL,
    "p4_found": _P4,
    "p4_profile": _P4_PROFILE,
    "p6_found": _P6,
    "p6_members": _P6_MEMBERS,
}
