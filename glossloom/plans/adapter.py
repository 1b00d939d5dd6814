"""A graph of terms over the order-entry tables, as SQL that Spark and the tests' engine both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossloom.session import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

_DIGIT = "cast(substring(o_orderpriority, 1, 1) as int)"
EDGES = f"""
select cast(1 + n_regionkey as bigint) as src_term_id, 0 as src_section, cast(1001 + n_nationkey as bigint) as dst_term_id, 0 as dst_section,
       'inherited' as rel_type, 'etymology_templates:' || n_nationkey || ':inh' as anchor, cast(null as int) as piece_order from {{nation}}
union all select 1001 + c_nationkey, 0, 100001 + c_custkey, 0, 'borrowed', 'etymology_templates:' || c_nationkey || ':bor', null from {{customer}}
union all select 1001 + s_nationkey, 0, 10001 + s_suppkey, 0, 'derived', 'etymology_templates:' || s_nationkey || ':der', null from {{supplier}}
union all select 100001 + o_custkey, 0, 10000001 + o_orderkey, {_DIGIT},
       case {_DIGIT} when 1 then 'inherited' when 2 then 'derived' when 3 then 'compound' when 4 then 'calque' else 'mention' end,
       'etymology_templates:' || {_DIGIT} || ':pri', null from {{orders}}
union all select 10000001 + o_orderkey, {_DIGIT}, 100001 + o_custkey, 0, 'alt_form', 'senses:0:alt_of', null from {{orders}} where o_orderstatus = 'P'
union all select distinct 10001 + l_suppkey, cast(1 + l_partkey % 2 as int), 1000001 + l_partkey, 0, 'compound', 'etymology_templates:1:com', null from {{lineitem}}
union all select 1000001 + l_partkey, 0, 10000001 + l_orderkey, 0, 'affix', 'etymology_templates:' || min(l_linenumber) || ':af', min(l_linenumber)
       from {{lineitem}} group by l_partkey, l_orderkey
"""
TERMS = """
select cast(1 + r_regionkey as bigint) as term_id, 1 as language_id, r_name as headword, false as is_reconstructed from {region}
union all select 1001 + n_nationkey, 2, n_name, false from {nation}
union all select 10001 + s_suppkey, 3, s_name, false from {supplier}
union all select 100001 + c_custkey, 4, c_name, c_acctbal < 0 from {customer}
union all select 1000001 + p_partkey, 5, p_name || ' ' || p_partkey, false from {part}
union all select 10000001 + o_orderkey, 6, 'order-' || o_orderkey, false from {orders}
"""
LANGUAGES = """
select 1 as language_id, 'rg' as code, 'Region' as name union all select 2, 'na', 'Nation' union all select 3, 'su', 'Supplier'
union all select 4, 'cu', 'Customer' union all select 5, 'pa', 'Part' union all select 6, 'or', 'Order'
"""
SENSES = f"""
select cast(1 + r_regionkey as bigint) as term_id, 0 as section, cast(null as string) as part_of_speech, r_name as gloss from {{region}}
union all select 1001 + n_nationkey, 0, 'name', n_name from {{nation}}
union all select 10001 + s_suppkey, 1, 'noun', s_name from {{supplier}}
union all select 10001 + s_suppkey, 2, null, null from {{supplier}}
union all select 100001 + c_custkey, 0, 'noun', c_mktsegment from {{customer}} where c_acctbal >= 0
union all select 1000001 + p_partkey, 1, 'noun', p_type from {{part}}
union all select 1000001 + p_partkey, 2, 'adj', p_brand from {{part}} where p_size % 2 = 1
union all select 10000001 + o_orderkey, {_DIGIT}, 'verb', o_orderstatus from {{orders}}
"""


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One of the views above over a data directory."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def ansi(sql: str) -> str:
    """The same view for an engine with the tables registered by name."""
    return sql.format(**{t: t for t in TABLES}).replace("as string", "as varchar")
