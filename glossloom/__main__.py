"""Command line: parse, fetch-dump, filter, sync-languages, normalize, load, crosscheck, all."""

from __future__ import annotations

import argparse
import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from glossloom.operators import crosscheck, normalize, publish
from glossloom.sources import dump, fetch, registry_build

#: Command -> what it does and its arguments.
COMMANDS = {
    "parse": ("count the entries of a dump, by language, and the lines left out", ["dump"]),
    "fetch-dump": ("fetch the dump a page serves, unless it is there", ["page_url", "file_url", "folder"]),
    "filter": ("trim a dump to the declared fields", ["dump", "out"]),
    "sync-languages": ("build the registry of exports and statements", ["exports", "out"]),
    "normalize": ("entries to staged terms, edges and claims", ["entries", "registry", "out"]),
    "load": ("staged items to a new live graph", ["items", "registry", "graph", "date"]),
    "crosscheck": ("links of rendered trees that no edge states", ["items", "trees", "out"]),
    "all": ("filter, normalize and load", ["dump", "registry", "work", "graph", "date"]),
}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="glossloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name, (said, args) in COMMANDS.items():
        c = sub.add_parser(name, help=said)
        for a in args:
            c.add_argument(a)
        if name in ("load", "all"):
            c.add_argument("--skip-drift", action="store_true")
    a = p.parse_args(argv)
    if a.command == "fetch-dump":
        print(fetch.fetch_dump(a.page_url, a.file_url, a.folder))
        return 0
    spark = SparkSession.builder.appName("glossloom").getOrCreate()
    registry = lambda: [spark.read.parquet(f"{a.registry}/{n}.parquet") for n in ("language_record", "variety")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if a.command == "parse":
        n = dump.read_entries(spark, a.dump, parts).groupBy("lang_code").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang_code")
        total = n.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        print(f"{total[0]:,} entries in {total[1]:,} languages")
        for r in n.limit(30).collect():
            print(f"{r['n']:,} {r['lang_code']}")
        for r in dump.rejected_lines(spark, a.dump).orderBy("reason").collect():
            print(f"left out: {r['n_lines']:,} {r['reason']}")
    elif a.command == "filter":
        dump.write_filtered(dump.read_entries(spark, a.dump, parts), a.out)
    elif a.command == "sync-languages":
        exports = [registry_build.export(spark, f"{a.exports}/{n}.json") for n in ("languages", "families", "varieties")]
        for name, df in registry_build.build(*exports, spark.read.schema("item bigint, property string, value string").json(f"{a.exports}/iso639.jsonl")).items():
            df.write.mode("overwrite").parquet(f"{a.out}/{name}.parquet")
    elif a.command == "crosscheck":
        print("checked {:,} trees: {:,} edges, {:,} missing".format(*crosscheck.report(spark.read.parquet(a.trees), spark.read.parquet(f"{a.items}/stg_edge"), a.out)))
    if a.command == "all":
        a.entries, a.items = f"{a.work}/entries", f"{a.work}/items"
        a.out = a.items
        dump.write_filtered(dump.read_entries(spark, a.dump, parts), a.entries)
    if a.command in ("normalize", "all"):
        dump.check_fields(spark, a.entries)
        items = normalize.normalize(spark.read.parquet(a.entries), *registry())
        dump.write_items({n: items[n] for n in dump.ITEM_SCHEMAS}, a.out)
        for kind, n in items["loops"].orderBy(F.desc("n_edges"), "kind").collect():
            print(f"left out: {n:,} edges of a term to itself ({kind})")
    if a.command in ("load", "all"):
        print(publish.load(spark, a.graph, *dump.read_items(spark, a.items).values(), *registry(), datetime.date.fromisoformat(a.date), not a.skip_drift))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
