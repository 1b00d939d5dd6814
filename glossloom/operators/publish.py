"""Checks before a graph goes live, and the swap of generations."""

from __future__ import annotations

import datetime
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossloom.operators import merge as M
from glossloom.operators import walk
from glossloom.sources import files

#: Greatest share of edges with an end in an unknown language, and greatest change in size.
UNKNOWN_SHARE, DRIFT = 0.001, 0.10
TABLES = ("term", "sense", "edge", "pickable_term", "language", "variety", "dataset")
#: Edge tables for walks, and whether they lead down.
WALKED = {"edge_by_src": True, "edge_by_dst": False}
#: After so many hours a lock counts as left behind.
LOCK_HOURS = 24


class GateError(ValueError):
    """A graph that must not go live."""


@contextmanager
def single_writer(spark: SparkSession, base: str) -> Iterator[None]:
    """At most one load at a time: a lock file made exclusively, failing at once if there is one.

    A lock older than :data:`LOCK_HOURS` is that of a load that died, and is taken over.
    """
    path = f"{base}/_lock"
    if files.exists(spark, path) and time.time() - files.modified(spark, path) / 1000 > LOCK_HOURS * 3600:
        files.delete(spark, path)
    if not files.create(spark, path, uuid.uuid4().hex):
        raise GateError(f"another load holds {path}")
    try:
        yield
    finally:
        files.delete(spark, path)


def check_languages(n_edges: int, n_unknown: int) -> None:
    if n_edges and n_unknown / n_edges > UNKNOWN_SHARE:
        raise GateError(f"{n_unknown} of {n_edges} edges have an end in an unknown language")


def check_drift(name: str, new: int, live: int) -> None:
    if live and abs(new - live) / live > DRIFT:
        raise GateError(f"{name}: {new} rows against {live} live")


def check_graph(tables: dict[str, DataFrame]) -> None:
    """Keys are unique, no edge joins a term to itself, there is one data set."""
    term, edge = tables["term"], tables["edge"]
    for df, key in ((term, ["lang_code", "headword"]), (edge, ["src_term_id", "dst_term_id", "dst_section", "rel_type", "src_section"])):
        if df.groupBy(*key).count().where("count > 1").limit(1).count():
            raise GateError(f"{', '.join(key)} is not unique")
    if edge.where("src_term_id = dst_term_id or anchor is null or anchor = ''").limit(1).count():
        raise GateError("an edge joins a term to itself or has no anchor")
    if tables["dataset"].count() != 1:
        raise GateError("there must be one data set")


def live_generation(spark: SparkSession, base: str) -> str | None:
    pointer = f"{base}/_live"
    return f"{base}/{files.read(spark, pointer).strip()}" if files.exists(spark, pointer) else None


def swap(spark: SparkSession, base: str, generation: str, attempts: int = 3, waits: tuple[float, ...] = (5, 15)) -> None:
    """Make a generation live by replacing the pointer in one step."""
    for n in range(attempts):
        try:
            files.replace(spark, f"{base}/_live", generation.rsplit("/", 1)[1])
            return
        except OSError:
            if n + 1 == attempts:
                raise
            time.sleep(waits[min(n, len(waits) - 1)])


def open_graph(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The live generation's tables, also as temporary views."""
    at = live_generation(spark, base)
    if at is None:
        raise GateError(f"nothing is live in {base}")
    out = {t: spark.read.parquet(f"{at}/{t}") for t in (*TABLES, *WALKED)}
    for name, df in out.items():
        df.createOrReplaceTempView(name)
    return out


def load(
    spark: SparkSession, base: str, terms: DataFrame, edges: DataFrame, claims: DataFrame, languages: DataFrame, varieties: DataFrame, dump_date: datetime.date, drift: bool = True
) -> str:
    """Merge staged items into a new generation, check it and make it live; a failure leaves the live one.

    Edges are also kept directed, in blocks by either end, so a walk in either direction reads only what it
    needs. Statistics of the tables are kept beside them for :func:`statistics`.
    """
    with single_writer(spark, base):
        counts = M.unknown_language_share(edges, languages).first()
        if not counts["n_edges"] and not terms.limit(1).count():
            raise GateError("there is nothing to load")
        check_languages(counts["n_edges"], counts["n_unknown"])
        tables = M.graph(spark, terms, edges, claims, languages, varieties)
        lang = languages.where("code is not null").groupBy("code").agg(F.min(F.struct("name", "kind")).alias("x")).select("code", "x.*")
        tables["language"] = M.numbered(spark, lang, ["code"], "language_id")
        tables["dataset"] = spark.createDataFrame([(dump_date,)], "dump_date date")
        check_graph(tables)
        at = live_generation(spark, base)
        if drift and at:
            for name in ("term", "edge"):
                check_drift(name, tables[name].count(), spark.read.parquet(f"{at}/{name}").count())
        generation = f"{base}/gen-{dump_date.isoformat()}-{uuid.uuid4().hex[:8]}"
        for name in TABLES:
            df = tables[name]
            if name == "edge":
                df = df.repartitionByRange("src_term_id", "dst_term_id").sortWithinPartitions("src_term_id")
            elif name == "term":
                df = df.repartitionByRange("lang_code", "headword").sortWithinPartitions("lang_code", "headword")
            elif name == "sense":
                df = df.repartitionByRange("term_id", "section").sortWithinPartitions("term_id")
            df.write.parquet(f"{generation}/{name}")
        for name, down in WALKED.items():
            walk.write_directed(tables["edge"], tables["sense"], down, f"{generation}/{name}")
        statistics(spark, generation).coalesce(1).write.parquet(f"{generation}/_statistics")
        swap(spark, base, generation)
        return generation


def statistics(spark: SparkSession, generation: str) -> DataFrame:
    """Per table and column: rows, nulls, approximate number of different values, least and greatest value as text."""
    out = []
    for name in TABLES:
        df = spark.read.parquet(f"{generation}/{name}")
        per = [F.struct(F.lit(c).alias("column_name"), (F.count(F.lit(1)) - F.count(c)).alias("n_nulls"), F.approx_count_distinct(c).alias("n_different"), F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("greatest")) for c in df.columns]
        one = df.agg(F.count(F.lit(1)).alias("n_rows"), F.array(*per).alias("x"))
        out.append(one.select(F.lit(name).alias("table_name"), "n_rows", F.inline("x")))
    return reduce(DataFrame.unionByName, out)
