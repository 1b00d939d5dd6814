"""The general problems' operators on small tables: nulls, empty tables, ties, repeats, clashing names."""

import datetime
import json
import random
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from glossloom import __main__ as cli
from glossloom.functions import registry
from glossloom.operators import hierarchy, merge, nested, references, skew, snapshots
from glossloom.plans import core_queries, merge_queries


# -- 1 -------------------------------------------------------------------------------------------
REFS = "id long, k string, p long, _k0 string, _runs string"
PARENTS = "k string, a long, b long, id long"


def _orphans(spark, refs, parents, block=7):
    r = spark.createDataFrame([(*x, "clash", "clash") for x in refs], REFS)
    p = spark.createDataFrame([(*x, 0) for x in parents], PARENTS)
    return sorted(x.id for x in references.orphans(r, "id", ["k"], "p", p, ["k"], "a", "b", block).collect())


def test_orphans_random(spark):
    rnd = random.Random(3)
    keys = ["x", "y", "", None]
    refs = [(i, rnd.choice(keys), rnd.choice([None, *range(-5, 60)])) for i in range(300)]
    refs += refs[:40]
    parents = []
    for _ in range(25):
        a = rnd.choice([None, *range(-10, 60)])
        parents.append((rnd.choice(keys), a, None if a is None or rnd.random() < 0.2 else a + rnd.randrange(-2, 12)))
    parents += parents[:5]
    want = sorted({i for i, k, p in refs if k is not None and (p is None or not any(q == k and a is not None and a <= p and (b is None or b > p) for q, a, b in parents))})
    assert _orphans(spark, refs, parents) == want


def test_references_with_null_companion_keys(spark, tmp_path):
    day = lambda n: datetime.datetime(2026, 1, n)
    terms = [(1, "la", day(5)), (2, None, day(5)), (3, "zz", day(5))]
    edges = [(1, "la", "a", "x", day(5)), (2, None, "a", "x", day(5)), (3, "la", None, "x", day(5)), (4, None, None, "x", day(5)), (5, None, "a", None, day(5)), (6, "la", "a", "", day(5)), (7, "la", "a", "y", day(5)), (8, "la", "a", "x", None)]
    claims = [("la", "a", "x", day(1), None), (None, "a", "x", day(1), None), ("la", None, "x", day(1), None), ("la", "a", None, day(1), None)]
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    put(terms, "occurrence_id long, lang_code string, loaded_at timestamp", "stg_term")
    put([("la", day(1), None)], "code string, added_at timestamp, retired_at timestamp", "language_record")
    put(edges, "edge_id long, src_lang_code string, src_headword string, src_wiktionary_id string, loaded_at timestamp", "stg_edge")
    put(claims, "lang_code string, headword string, wiktionary_id string, loaded_at timestamp, retired_at timestamp", "stg_section_claim")
    want = [("stg_edge", i) for i in (2, 3, 4, 7, 8)] + [("stg_term", 3)]
    assert sorted(tuple(r) for r in core_queries.p1_found(spark, str(tmp_path)).collect()) == want
    assert {(r.ref_table, r.month): r.n_orphans for r in core_queries.p1_report(spark, str(tmp_path)).collect()} == {("stg_edge", "2026-01"): 4, ("stg_edge", None): 1, ("stg_term", "2026-01"): 1}


def test_orphans_of_empty_tables(spark):
    assert _orphans(spark, [(1, "x", 5)], []) == [1]
    assert _orphans(spark, [], [("x", 1, 2)]) == []


# -- 2 -------------------------------------------------------------------------------------------
def test_changes(spark):
    rows = [
        ("2024-01-01", 1, "a", None, 1), ("2024-01-01", 1, "a", None, 2), ("2024-01-01", 2, "b", 1, 1), ("2024-01-01", 3, "c", 1, 1), ("2024-01-01", None, "n", 1, 1),
        ("2024-02-01", 1, "a", 5, 1), ("2024-02-01", 2, "b", 1, 9), ("2024-02-01", 4, "d", 1, 1), ("2024-02-01", None, "m", 1, 1), ("2024-02-01", 4, "d", 1, 1),
        (None, 9, "x", 1, 1),
    ]
    snap = spark.createDataFrame(rows, "dump_date string, key long, at string, old int, loaded int").withColumn("dump_date", F.to_date("dump_date"))
    got = {(r.record_id, r.change_kind) for r in snapshots.changes(snap, "dump_date", "key", ["loaded"]).collect()}
    assert got == {(1, "changed"), (3, "removed"), (4, "added"), (None, "changed")}
    many = {(r.record_id, r.change_kind) for r in snapshots.changes(snap, "dump_date", "key", ["loaded"], repeated_rows_once=False).collect()}
    assert many == got
    assert snapshots.changes(snap.where("dump_date = '2024-01-01'"), "dump_date", "key").count() == 0
    assert snapshots.changes(snap.limit(0), "dump_date", "key").count() == 0


# -- 3 -------------------------------------------------------------------------------------------
def _brute_tree(parent):
    out = {}
    for n in parent:
        path, at = [n], n
        while (p := parent[at]) is not None and p not in path:
            path.append(p)
            at = p
        out[n] = None if p is not None else path[::-1]
    return out


@pytest.mark.parametrize("shape", ["random", "chain"])
def test_hierarchy(spark, shape):
    rnd = random.Random(5)
    n = 120
    parent = {f"n{i}": (f"n{i - 1}" if shape == "chain" else f"n{rnd.randrange(i)}") if i and (shape == "chain" or rnd.random() < 0.95) else None for i in range(n)}
    parent |= {"l0": "l2", "l1": "l0", "l2": "l1", "under": "l1", "self": "self", "leaf": "self"}
    rows = [("t", k, v, 1, "x") for k, v in parent.items()] * 2 + [("t", "n0", "unknown", 1, "x"), ("t", None, "n0", 1, "x"), (None, "n0", None, 1, "x")]
    links = spark.createDataFrame(rows, "tree string, node string, parent string, id int, root string")
    h = hierarchy.hierarchy(spark, links).cache()
    got = {r.node: r for r in h.collect()}
    want = _brute_tree(parent)
    assert set(got) == set(want)
    below = Counter(a for path in want.values() if path for a in path[:-1])
    spans = defaultdict(list)
    for k, path in want.items():
        r = got[k]
        if path is None:
            assert (r.root, r.depth, r.path) == ("", -1, None) and r.on_loop == (k in ("l0", "l1", "l2", "self"))
        else:
            assert (r.root, r.depth, r.path, r.n_descendants) == (path[0], len(path) - 1, path, below[k])
            spans[r.root].append(r.first_pos)
    assert all(sorted(x) == list(range(len(x))) for x in spans.values())
    of = spark.createDataFrame([("t", "n0"), ("t", "n3"), ("t", "l0"), ("t", "none")], "tree string, node string")
    pairs = {(r.node, r.descendant, r.steps) for r in hierarchy.descendants(h, of).collect()}
    assert pairs == {(a, k, len(p) - 1 - p.index(a)) for k, p in want.items() if p for a in ("n0", "n3") if a in p[:-1]}


def test_hierarchy_of_nothing(spark):
    empty = spark.createDataFrame([], "tree string, node string, parent string")
    assert hierarchy.hierarchy(spark, empty).count() == 0
    loops = spark.createDataFrame([("t", "a", "b"), ("t", "b", "a")], "tree string, node string, parent string")
    assert {(r.node, r.depth) for r in hierarchy.hierarchy(spark, loops).collect()} == {("a", -1), ("b", -1)}


def test_long_way_into_a_loop(spark):
    parent = {"a": "b", "b": "c", "c": "a", **{f"t{i}": f"t{i - 1}" if i else "b" for i in range(40)}, "alone": "alone", "root": None}
    links = spark.createDataFrame([("t", k, v) for k, v in parent.items()], "tree string, node string, parent string")
    got = {r.node: (r.depth, r.on_loop) for r in hierarchy.hierarchy(spark, links, paths=False).collect()}
    assert got == {k: (0, False) if k == "root" else (-1, k in ("a", "b", "c", "alone")) for k in parent}


def test_descendants_over_blocks(spark):
    rnd = random.Random(7)
    parent = {f"n{i}": (f"n{i - 1}" if i < 300 else f"n{rnd.randrange(i)}") if i else None for i in range(600)} | {"a": "b", "b": "a"}
    links = spark.createDataFrame([(t, k, v) for t in ("s", "t") for k, v in parent.items()], "tree string, node string, parent string")
    h = hierarchy.hierarchy(spark, links, paths=False).cache()
    got = sorted((r.tree, r.node, r.descendant, r.steps) for r in hierarchy.descendants(h, links).collect())
    assert got == sorted((t, a, k, i) for t in ("s", "t") for k, p in _brute_tree(parent).items() if p for i, a in enumerate(p[-2::-1], 1))


def test_all_descendants_cover_both_trees(spark, tmp_path):
    spark.createDataFrame([("ine", None), ("gem", "ine"), ("gem", "ine"), ("x", "y"), ("y", "x")], "code string, superset string").write.parquet(f"{tmp_path}/language_set.parquet")
    edges = [("la", "a", "fr", "b", "inherited"), ("fr", "b", "ht", "c", "inherited"), ("fr", "b", "ht", "d", "borrowed"), ("q", "l", "q", "l", "inherited"), ("ine", "gem", "gem", "ine", "inherited")]
    spark.createDataFrame(edges * 2, "src_lang_code string, src_headword string, dst_lang_code string, dst_headword string, rel_type string").write.parquet(f"{tmp_path}/stg_edge.parquet")
    got = sorted(tuple(r) for r in core_queries.p3_descendants(spark, str(tmp_path)).collect())
    assert got == [("edge", "fr:b", "ht:c", 1), ("edge", "ine:gem", "gem:ine", 1), ("edge", "la:a", "fr:b", 1), ("edge", "la:a", "ht:c", 2), ("language_set", "ine", "gem", 1)]


# -- 4 -------------------------------------------------------------------------------------------
def test_top_per_key(spark):
    rows = [("a", None, i, i // 2, "z") for i in range(6)] * 2 + [("b", "x", 1, None, "z"), ("b", "x", 2, None, "z"), ("b", "x", None, 9, "z"), ("c", "x", 1, 5, "z")]
    df = spark.createDataFrame(rows, "k string, l string, v int, o int, n_rows string")
    got = sorted((r.k, r.v, r["rank"]) for r in skew.top_per_key(df, ["k", "l"], "v", "o", 3, 2).collect())
    assert got == [("a", 3, 3), ("a", 4, 2), ("a", 5, 1), ("b", 1, 2), ("b", 2, 1)]
    assert skew.top_per_key(df.limit(0), ["k"], "v", "o", 3, 1).count() == 0


def test_profile(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["hot"] * 8 + ["b", None]), rnd.choice([None, *range(30)])) for _ in range(500)] + [("none", None)] * 3
    df = spark.createDataFrame(rows, "k string, v int")
    got = {r.k: r for r in skew.profile(df, ["k"], "v", lambda v: F.floor(v / 4), 0.25).collect()}
    by = defaultdict(list)
    for k, v in rows:
        by[k].append(v)
    assert set(got) == set(by)
    for k, vs in by.items():
        full = sorted(v for v in vs if v is not None)
        c = Counter(full)
        mode = min(c, key=lambda v: (-c[v], v)) if c else None
        pct = full[-(-len(full) // 4) - 1] if full else None
        assert (got[k].n_rows, got[k].n_null, got[k].n_distinct, got[k].mode_value, got[k].percentile_value) == (len(vs), len(vs) - len(full), len(c), mode, pct)


# -- 6 -------------------------------------------------------------------------------------------
def _walk(i, text):
    try:
        top = json.loads(text, parse_constant=lambda c: 1 / 0)
    except Exception:  # noqa: BLE001
        return []
    out, stack = [], [(top, "")] if isinstance(top, dict) else []
    s = lambda x: "" if x is None or isinstance(x, (dict, list)) else x if isinstance(x, str) else json.dumps(x)
    while stack:
        node, path = stack.pop()
        for r, rel in enumerate(node.get("children") if isinstance(node.get("children"), list) else []):
            for t, e in enumerate(rel["terms"] if isinstance(rel, dict) and isinstance(rel.get("terms"), list) else []):
                here = f"{path}/{r}.{t}" if path else f"{r}.{t}"
                d = e if isinstance(e, dict) else {}
                out.append((i, here, path, s(rel.get("keyword")), s(d.get("lang")), s(d.get("term")) or s(d.get("alt"))))
                if d:
                    stack.append((e, here))
    return out


def _some_json(rnd, depth=0):
    def value():
        return rnd.choice(["x", "ü\\u00e9\"\\", "", None, 5, -1.5e3, True, "\t", "[{,:}]", "😀"])

    node = {k: value() for k in rnd.sample(["lang", "term", "alt", "note", "status"], rnd.randrange(5))}
    if depth < 5 and rnd.random() < 0.8:
        node["children"] = [
            rnd.choice([{"keyword": value(), "terms": [rnd.choice([_some_json(rnd, depth + 1), None, 3, []]) for _ in range(rnd.randrange(3))]}, {"keyword": "k", "terms": value()}, None, "s"])
            for _ in range(rnd.randrange(4))
        ]
    return node


def test_nested_against_parser():
    rnd = random.Random(11)
    texts = []
    for _ in range(1500):
        t = json.dumps(_some_json(rnd), ensure_ascii=rnd.random() < 0.5, indent=rnd.choice([None, None, 1]), separators=rnd.choice([None, (",", ":")]))
        if rnd.random() < 0.4:
            i = rnd.randrange(len(t) + 1)
            t = rnd.choice([t[:i], t[:i] + rnd.choice('{}[]:,"\\ 0n') + t[i:], t[:i] + t[i + 1 :], t + "}", "[" + t + "]", t + "\x00"])
        texts.append(t)
    texts += ["", " ", "null", '"a"', "[]", '{"a":NaN}', '{"a":01}', '{"a" "b"}', "﻿{}", '{"children":[{"terms":[{"term":"a","term":"b"}]}]}']
    got = nested.flatten(list(range(len(texts))), [t.encode() for t in texts])
    assert sorted(zip(*got.values())) == sorted(x for i, t in enumerate(texts) for x in _walk(i, t))


def test_nested_deep_and_dirty(spark):
    deep = '{"children":[{"keyword":"k","terms":[' * 2000 + '{"term":"z"}' + "]}]}" * 2000
    df = spark.createDataFrame([(1, deep, "x"), (1, deep, "x"), (2, None, "x"), (None, deep, "x"), (3, "", "x")], "tree_id long, tree_json string, keyword string")
    rows = nested.tree_rows(df).collect()
    assert len(rows) == 2000 and {r.tree_id for r in rows} == {1}
    assert nested.tree_rows(df.limit(0)).count() == 0


def _records(i, value, table="", path="$", up="", pos=None):
    if isinstance(value, list):
        for k, x in enumerate(value):
            yield from _records(i, x, table, f"{path}[{k}]", up, k)
    elif isinstance(value, dict):
        text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
        yield i, table, path, up, pos, {k: text(v) for k, v in value.items() if not isinstance(v, (dict, list))}
        for k, v in value.items():
            if isinstance(v, dict):
                yield from _records(i, v, k, f"{path}.{k}", path)
            elif isinstance(v, list):
                yield from _records(i, v, k, f"{path}.{k}", path)
    else:
        yield i, table, path, up, pos, {"": value if value is None or isinstance(value, str) else json.dumps(value)}


def test_records_of_any_shape(spark):
    rnd = random.Random(6)

    def some(depth):
        plain = lambda: rnd.choice(["x", "", None, 5, True, "a\"b", "\u00fc"])
        if depth == 0:
            return plain()
        kind = rnd.random()
        if kind < 0.6:
            return {rnd.choice(["id", "name", "items", "odd key", "position", "node_path"]): some(depth - 1) for _ in range(rnd.randrange(4))}
        return [some(depth - 1) for _ in range(rnd.randrange(3))] if kind < 0.8 else plain()

    whole = [(i, {"a": some(4), "b": some(3), "items": [some(2), some(1)]}) for i in range(200)]
    rows = [(i, json.dumps(v, ensure_ascii=rnd.random() < 0.5)) for i, v in whole]
    df = spark.createDataFrame(rows + rows[:20] + [(900, None), (901, "{"), (902, "[1]"), (None, "{}"), (903, "{}"), (904, '{"a":1,"a":{"b":2}}')], "tree_id long, t string").withColumn("members", F.lit("clash"))
    rec = nested.records(df, "tree_id", "t").cache()
    got = sorted(((r.record_id, r.table_name, r.node_path, r.parent_path, r.position, r.members) for r in rec.collect()), key=repr)
    want = [x for i, v in [*whole, (903, {}), (904, {"a": {"b": 2}})] for x in _records(i, v)]
    assert got == sorted(want, key=repr)
    tables = nested.related_tables(rec)
    assert sum(t.count() for t in tables.values()) == len(want)
    assert {"record_id", "node_path", "parent_path", "position", "position_"} <= set(tables["a"].columns)
    # Every row has its parent in one of the tables.
    every = rec.select("record_id", F.col("node_path").alias("parent_path"))
    assert rec.where("node_path <> '$'").join(every, ["record_id", "parent_path"], "left_anti").count() == 0
    assert nested.related_tables(rec, {"items": ["id"]})["items"].columns == ["record_id", "node_path", "parent_path", "position", "id"]
    assert nested.records(df.limit(0), "tree_id", "t").count() == 0


# -- crosscheck ----------------------------------------------------------------------------------
def test_crosscheck_reports_every_missing_link(spark, tmp_path, capsys):
    tree = lambda i: json.dumps({"lang": "fr", "term": f"w{i}", "children": [{"keyword": "inh", "terms": [{"lang": "la", "term": f"s{i}"}]}]})
    rows = [(i, tree(i)) for i in range(40)] * 2 + [(50, '{"lang":"fr","term":"alone"}'), (51, "{broken"), (52, None), (53, "[]")]
    spark.createDataFrame(rows, "tree_id long, tree_json string").write.parquet(f"{tmp_path}/trees")
    edges = [("la", f"s{i}", "fr", f"w{i}") for i in range(3)]
    spark.createDataFrame(edges, "src_lang_code string, src_headword string, dst_lang_code string, dst_headword string").write.parquet(f"{tmp_path}/items/stg_edge")
    cli.main(["crosscheck", f"{tmp_path}/items", f"{tmp_path}/trees", f"{tmp_path}/out"])
    assert {(r.tree_id, r.src_term, r.dst_term) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(i, f"s{i}", f"w{i}") for i in range(3, 40)}
    assert "checked 41 trees: 40 edges, 37 missing" in capsys.readouterr().out


# -- codes ---------------------------------------------------------------------------------------
def test_codes_of_deep_varieties(spark):
    lang = spark.createDataFrame([("la",), ("fr",)], "code string")
    rows = [("v1", "la"), *[(f"v{i}", f"v{i - 1}") for i in range(2, 9)], ("a", "b"), ("b", "a"), ("self", "self"), ("x", "unknown"), ("n", None), (None, "la"), ("near", "fr"), ("near", "v3"), ("under", "near")]
    var = spark.createDataFrame(rows * 2, "code string, parent string")
    got = sorted((tuple(r) for r in registry.code_dim(lang, var).collect()), key=lambda r: r[0])
    assert got == sorted([("la", "la", None), ("fr", "fr", None), ("near", "fr", "near"), ("under", "fr", "under"), *[(f"v{i}", "la", f"v{i}") for i in range(1, 9)]], key=lambda r: r[0])
    assert {tuple(r) for r in registry.code_dim(lang, var.limit(0)).collect()} == {("la", "la", None), ("fr", "fr", None)}


# -- folding -------------------------------------------------------------------------------------
def test_accent_fold_of_all_headwords(spark, tmp_path):
    want = {
        "": "", "plain": "plain", "é": "e", "e\u0301": "e", "ậ": "a", "a\u0302\u0323": "a", "a\u0323\u0302": "a", "\u0301": "", "Ἄρης": "Αρης", "йод": "иод", "ёж": "еж",
        "ａ\u0304": "ａ", "x₂": "x₂", "a\u200bb": "a\u200bb", "a\u034fb": "a\u034fb", "한": "\u1112\u1161\u11ab", "が": "か", "ø": "ø", "😀": "😀",
    }
    spark.createDataFrame([(w,) for w in [*want, *want, None]], "headword string").write.parquet(f"{tmp_path}/stg_term.parquet")
    got = merge_queries.accent_fold(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {r.headword: r.folded for r in got} == want
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))
    assert want == {w: plain(w) for w in want}


# -- merging -------------------------------------------------------------------------------------
def test_aliases(spark):
    rows = [
        ("la", "ā", False, False), ("la", "a", False, True), ("la", "ē", False, False), ("la", "e", False, False), ("la", "ī", True, False), ("la", "i", False, True),
        ("la", "ō", False, False), ("la", "ŏ", False, True), ("la", "o", False, True), ("la", "ū", False, False), ("la", "ŭ", False, True), ("la", "u", False, False),
    ]
    keys = spark.createDataFrame(rows, "lang_code string, headword string, is_reconstructed boolean, has_sense boolean")
    assert {(r.from_headword, r.to_headword) for r in merge.aliases(keys).collect()} == {("ā", "a"), ("ē", "e"), ("ū", "ŭ")}


def test_sections_and_first_anchor(spark):
    lang = spark.createDataFrame([("en", "English", "regular"), ("la", "Latin", "regular")], "code string, name string, kind string")
    e = "src_lang_code string, src_headword string, src_section smallint, src_variety_code string, dst_lang_code string, dst_headword string, dst_section smallint, rel_type string, anchor string, piece_order smallint, src_wiktionary_id string"
    edge = lambda dst, i, wid=None, section=0, lang="en": ("la", "a", 0, None, lang, dst, section, "derived", f"etymology_templates:{i}:der", None, wid)
    edges = spark.createDataFrame([edge("b", 10, "x"), edge("b", 2), edge("c", 1, section=1), edge("d", 1), edge("d", 3, section=2), edge("q", 1, lang="zz"), edge("e", 1, "bad")], e)
    c = "lang_code string, headword string, section smallint, wiktionary_id string, listed_lang_code string, listed_headword string"
    claims = spark.createDataFrame([("la", "a", 2, "x", None, None), ("la", "a", 3, None, "en", "d"), ("la", "a", 1, "bad", None, None), ("la", "a", 2, "bad", None, None)], c)
    none = spark.createDataFrame([], "lang_code string, from_headword string, to_headword string")
    got = {(r.dst_headword, r.dst_section, r.src_section, r.anchor.split(":")[1]) for r in merge.merged_edges(edges, claims, none, lang).collect()}
    assert got == {("b", 0, 2, "2"), ("c", 1, 0, "1"), ("d", 0, 3, "1"), ("d", 2, 0, "3"), ("e", 0, 0, "1")}
    share = merge.unknown_language_share(edges, lang).first()
    assert (share.n_edges, share.n_unknown) == (7, 1)
