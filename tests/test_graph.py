"""Walks, loading and lookups on tiny graphs."""

import datetime
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from glossloom.operators import api, publish
from glossloom.operators import walk as G
from glossloom.sources import files

EDGE = "src_term_id long, src_section int, dst_term_id long, dst_section int, rel_type string, anchor string, piece_order int"
SENSE = "term_id long, section int, part_of_speech string, gloss string"


def _brute(edges, n_sections, anchor, down, cap):
    """The level rules written with plain lists."""
    rank = {t: i for i, t in enumerate(G.PRIORITY)}
    es = [dict(near=e[0] if down else e[2], far=e[2] if down else e[0], ns=e[1] if down else e[3], fs=e[3] if down else e[1], ss=e[1], src=e[0], rel=e[4], p=rank[e[4]], ds=e[3]) for e in edges if e[4] in rank]
    ok = lambda e, s: s == 0 or e["ns"] == s or (down and e["ns"] == 0)
    etym = lambda e: n_sections.get(e["src"], 0) if e["ss"] == 0 else 0
    hop = [e for e in es if e["near"] == anchor]
    best = {}
    for e in hop:
        best[e["far"]] = min(best.get(e["far"], 99), e["p"])
    keep = sorted(best, key=lambda f: (best[f], f))[:cap]
    level = [(e, [e["far"]], False, len(best)) for e in hop if e["far"] in keep]
    out, depth = [], 1
    while level and depth < 20:
        out += [(depth if down else -depth, e["near"], e["far"], e["fs"], e["rel"], cyc, tot) for e, _, cyc, tot in level]
        grown = defaultdict(list)
        for e, path, cyc, _ in level:
            if cyc or e["rel"] in G.NON_TRANSITIVE or (not down and etym(e) >= 2):
                continue
            for x in es:
                if x["near"] == e["far"] and ok(x, e["fs"]):
                    grown[x["far"], x["fs"]].append((x["p"], x["near"], x["ss"], x["ds"], path + [x["far"]], x["far"] in path, x))
        one = defaultdict(list)
        for c in grown.values():
            m = min(c, key=lambda r: r[:5])
            one[m[1]].append(m)
        level = [(m[6], m[4], m[5], len(ms)) for ms in one.values() for m in sorted(ms, key=lambda m: (m[0], m[6]["far"], m[6]["fs"]))[:cap]]
        depth += 1
    return sorted(out)


@pytest.mark.parametrize("down", [True, False])
def test_walk_against_plain_lists(spark, down):
    rnd = random.Random(7)
    edges = set()
    for _ in range(60):
        a, b = rnd.sample(range(1, 18), 2)
        rel = rnd.choice(["inherited", "derived", "mention", "calque", "affix"])
        edges.add((a, rnd.randrange(3), b, rnd.randrange(3), rel, f"etymology_templates:0:{rel}", None))
    edges = list(edges)
    sense = [(i, s, None, None) for i in range(1, 18) for s in range(rnd.randrange(4))]
    n = defaultdict(set)
    for i, s, _, _ in sense:
        n[i].add(s)
    anchors = spark.createDataFrame([(1,), (2,), (3,), (99,)], "anchor_id long")
    rows = G.walk(spark, spark.createDataFrame(edges, EDGE), spark.createDataFrame(sense, SENSE), anchors, down, cap=3).collect()
    for a in (1, 2, 3, 99):
        got = sorted((r.depth, r.near, r.far, r.dst_section if down else r.src_section, r.rel_type, r.is_cycle, r.total_children) for r in rows if r.anchor_id == a)
        assert got == _brute(edges, {k: len(v) for k, v in n.items()}, a, down, 3)


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("graph"))
    lang = spark.createDataFrame([("en", "English", "regular"), ("la", "Latin", "regular")], "code string, name string, kind string")
    var = spark.createDataFrame([("la-lat", "Late Latin", "la")], "code string, name string, parent string")
    term = "lang_code string, headword string, section smallint, is_reconstructed boolean, part_of_speech string, gloss string, has_sense boolean"
    terms = spark.createDataFrame([
        ("en", "bank", 1, False, "noun", "edge of a river", True), ("en", "bank", 2, False, "noun", "money house", True), ("la", "ripa", 0, False, None, None, False),
        ("en", "banker", 0, False, "noun", "keeper", True), ("la", "banca", 0, False, "noun", None, True),
    ], term)
    edge = "src_lang_code string, src_headword string, src_section smallint, src_variety_code string, dst_lang_code string, dst_headword string, dst_section smallint, rel_type string, anchor string, piece_order smallint, src_wiktionary_id string"
    edges = spark.createDataFrame([
        ("la", "ripa", 0, None, "en", "bank", 1, "derived", "etymology_templates:0:der", None, None), ("la", "banca", 0, None, "en", "bank", 2, "borrowed", "etymology_templates:0:bor", None, None),
        ("en", "bank", 0, None, "en", "banker", 0, "affix", "etymology_templates:0:af", 1, None),
    ], edge)
    claims = spark.createDataFrame([], "lang_code string, headword string, section smallint, wiktionary_id string, listed_lang_code string, listed_headword string")
    args = (spark, base, terms, edges, claims, lang, var)
    publish.load(*args, datetime.date(2024, 1, 1))
    return base, args, api.Graph(spark, publish.open_graph(spark, base))


def test_lookups(graph):
    g = graph[2]
    assert [(r.section, r.gloss) for r in g.terms("en", "bank")] == [(1, "edge of a river"), (2, "money house")]
    assert [(r.section, r.gloss) for r in g.terms("la", "ripa")] == [(0, None)] and g.terms("en", "none") == []
    i = g.terms("en", "bank")[0].term_id
    d = g.term(i)
    assert d["sourceRef"] == "wiktionary:2024-01-01:en:bank" and not d["isRedlink"] and len(d["senses"]) == 2
    assert g.term(g.terms("la", "ripa")[0].term_id)["isRedlink"]
    assert [r.code for r in g.languages()] == ["en", "la"]
    assert g.random_term(0.0) is not None and g.random_term(0.0, "zz") is None
    with pytest.raises(api.NotFound):
        g.term(9999)


def test_trees(graph):
    g = graph[2]
    i = g.terms("en", "bank")[0].term_id
    s = g.tree_slice(i)
    assert sorted((n["headword"], n["depth"]) for n in s["nodes"]) == [("banca", -1), ("bank", 0), ("banker", 1), ("ripa", -1)]
    assert [e["srcSectionUnstated"] for e in s["edges"] if e["relType"] == "affix"] == [True]
    one = g.tree_slice(i, 1)
    assert sorted(n["headword"] for n in one["nodes"]) == ["bank", "banker", "ripa"]
    assert g.tree_slice(9999) is None
    up = g.expand(i, "up", 0, [g.terms("la", "ripa")[0].term_id])
    assert [n["headword"] for n in up["nodes"]] == ["banca"]
    assert len(api.merged_slice(one, i, "up", up)["nodes"]) == 4
    page = lambda *a: api.resolve_page(g, *a)
    assert [page(*a)["kind"] for a in (("en", "bank"), ("en", "bank", 2), ("la", "ripa", 7), ("en", "zzz"))] == ["homograph", "tree", "tree", "notfound"]
    assert page("en", "bank", 2)["slice"]["section"] == 2
    for bad in ("0", "x", "99999999999"):
        with pytest.raises(api.BadRequest):
            api.parse_id(bad)


def test_a_word_with_one_numbered_section_shows_its_own(spark):
    t = _tables(spark, [(1, "en", "w"), (2, "en", "x")], [(1, 0, 2, 3, "derived", "a", None)], [(2, 3, "noun", "g")])
    page = api.resolve_page(api.Graph(spark, t), "en", "x")
    assert page["slice"]["section"] == 3 and {n["headword"] for n in page["slice"]["nodes"]} == {"w", "x"}


def _tables(spark, terms, edges, senses):
    term = spark.createDataFrame([(*x, False) for x in terms], "term_id long, lang_code string, headword string, is_reconstructed boolean")
    return {
        "term": term, "sense": spark.createDataFrame(senses, SENSE), "edge": spark.createDataFrame(edges, EDGE), "language": spark.createDataFrame([(1, "en", "English")], "language_id int, code string, name string"),
        "dataset": spark.createDataFrame([(datetime.date(2024, 1, 1),)], "dump_date date"), "pickable_term": term.select("term_id", "lang_code"),
    }


def test_hidden_counts_by_direction(spark):
    # A focus with 13 parents and 12 children hides three and two.
    edges = [(100 + i, 0, 1, 0, "derived", "a", None) for i in range(13)] + [(1, 0, 200 + i, 0, "derived", "a", None) for i in range(12)]
    terms = [(1, "en", "f")] + [(e[0] if e[0] != 1 else e[2], "en", f"w{k:02}") for k, e in enumerate(edges)]
    g = api.Graph(spark, _tables(spark, terms, edges, []))
    s = g.tree_slice(1)
    assert s["overflow"] == [{"id": 1, "direction": "up", "hidden": 3}, {"id": 1, "direction": "down", "hidden": 2}]
    more = g.expand(1, "down", 0, [n["term_id"] for n in s["nodes"]])
    assert len(more["nodes"]) == 2 and more["overflow"] == []
    both = api.merged_slice(s, 1, "down", more)
    assert both["overflow"] == [{"id": 1, "direction": "up", "hidden": 3}] and len(both["nodes"]) == 23 and len(both["edges"]) == 22
    drawn = api.parents(spark, both)
    core, hidden = api.core_nodes(both, drawn)
    assert len(core) == 11 and hidden == {1: 12 + 3}  # 22 children, ten of them shown
    core, hidden = api.core_nodes(both, drawn, expanded=[1])
    assert len(core) == 23 and hidden == {1: 3}


def test_a_term_on_both_sides_stays_above(spark):
    # 2 is parent and child of 1; 3 is reached only through 2, 4 without it.
    edges = [(2, 0, 1, 0, "derived", "a", None), (1, 0, 2, 0, "derived", "b", None), (2, 0, 3, 0, "derived", "c", None), (1, 0, 4, 0, "derived", "d", None), (4, 0, 5, 0, "affix", "e", 2), (4, 0, 5, 0, "derived", "f", None)]
    g = api.Graph(spark, _tables(spark, [(i, "en", f"w{i}") for i in range(1, 6)], edges, []))
    s = g.tree_slice(1)
    assert {n["term_id"]: n["depth"] for n in s["nodes"]} == {1: 0, 2: -1, 4: 1, 5: 2}
    # On later steps one edge stands for parallel ones, that of the lowest rank.
    assert sorted((e["src"], e["dst"], e["relType"]) for e in s["edges"]) == [(1, 2, "derived"), (1, 4, "derived"), (2, 1, "derived"), (4, 5, "derived")]


def test_steps():
    steps = [(1, 2), (2, 3), (3, 1), (3, 4), (1, 5), (5, 4)]
    assert api.steps_from(1, steps) == {1: 0, 2: 1, 5: 1, 3: 2, 4: 2}
    assert api.steps_from(1, steps, barred={5, 3}) == {1: 0, 2: 1}
    assert api.steps_from(9, []) == {9: 0}


def test_drawn_under(spark):
    nodes = {1: 0, 2: -1, 3: -1, 4: -2, 5: 1, 6: 1, 7: 2, 8: 2, 9: -3}
    edges = [
        (2, 1, "inherited"), (3, 1, "derived"), (3, 2, "inherited"),  # 3 goes through 2, a descent at its own depth
        (4, 3, "affix"), (4, 2, "affix"), (4, 2, "root"), (2, 4, "inherited"),  # equal rank: the lesser; an edge the wrong way doesn't count
        (1, 5, "borrowed"), (1, 6, "affix"), (5, 6, "affix"),  # taking apart is no descent
        (5, 7, "affix"), (6, 7, "derived"), (5, 8, "mention"),  # 8 has no edge that counts
        (9, 2, "derived"),  # two steps at once
    ]
    at = spark.createDataFrame([(1, n, d) for n, d in nodes.items()], "anchor_id long, term_id long, depth int")
    e = spark.createDataFrame([(1, *x, k) for k, x in enumerate(edges)], "anchor_id long, src_term_id long, dst_term_id long, rel_type string, piece_order int")
    got = {r.term_id: (r.parent_id, r["rank"]) for r in G.drawn_under(at, e).collect()}
    assert got == {2: (1, 0), 3: (2, 0), 4: (2, 13), 5: (1, 1), 6: (1, 13), 7: (6, 5), 8: (1, None), 9: (1, None)}
    assert G.drawn_under(at.limit(0), e).count() == 0


def test_sibling_order():
    order = [("un-", 1, False), ("do", 2, False), ("alpha", None, False), ("beta", None, False), ("-able", 3, False), ("", None, True)]
    assert sorted(reversed(order), key=lambda x: api.sibling_key(*x)) == order


def test_walks_read_only_their_blocks(spark, tmp_path):
    rnd = random.Random(1)
    edges = spark.createDataFrame([(rnd.randrange(1, 400), 0, rnd.randrange(400, 5000), 0, "derived", "a", None) for _ in range(3000)], EDGE)
    senses = spark.createDataFrame([(1, 1, None, None), (1, 2, None, None)], SENSE)
    G.write_directed(edges, senses, True, f"{tmp_path}/down")
    kept = spark.read.parquet(f"{tmp_path}/down")
    anchors = spark.createDataFrame([(5,)], "anchor_id long")
    scratch = G.Scratch(spark)
    a = scratch.save(anchors, **G._seen("anchor_id", F.lit(True)))
    e, _ = G._from(kept, a, scratch, "anchor_id")
    assert len(e.inputFiles()) == len(kept.inputFiles())  # files are listed, but
    assert e.select("block").distinct().count() == 1 and {r.near for r in e.select("near").distinct().collect()} == {5}
    plan = e._jdf.queryExecution().executedPlan().toString()
    assert "block" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    got = G.walk(spark, kept, None, anchors).collect()
    assert sorted((r.near, r.far) for r in got) == sorted((r.near, r.far) for r in G.walk(spark, edges, senses, anchors).collect())
    assert G.walk(spark, kept, None, anchors.limit(0)).count() == 0


def test_gates(graph, spark):
    base, args, _ = graph
    live = publish.live_generation(spark, base)
    with pytest.raises(publish.GateError):  # half the terms are gone
        publish.load(*args[:2], args[2].limit(1), args[3].where("dst_headword = 'banker'"), *args[4:], datetime.date(2024, 2, 1))
    with publish.single_writer(spark, base), pytest.raises(publish.GateError):
        publish.load(*args, datetime.date(2024, 2, 1))
    assert publish.live_generation(spark, base) == live
    publish.check_languages(10_000, 10)
    with pytest.raises(publish.GateError):
        publish.check_languages(10_000, 11)
    publish.check_drift("term", 110, 100)
    with pytest.raises(publish.GateError):
        publish.check_drift("term", 111, 100)


def test_a_dead_lock_is_taken_over(spark, tmp_path, monkeypatch):
    files.create(spark, f"{tmp_path}/_lock", "dead")
    with pytest.raises(publish.GateError), publish.single_writer(spark, str(tmp_path)):
        pass
    monkeypatch.setattr(publish, "LOCK_HOURS", -1)
    with publish.single_writer(spark, str(tmp_path)):
        assert files.exists(spark, f"{tmp_path}/_lock")
    assert not files.exists(spark, f"{tmp_path}/_lock")


def test_generation(graph, spark):
    live = publish.live_generation(spark, graph[0])
    stats = {(r.table_name, r.column_name): r for r in spark.read.parquet(f"{live}/_statistics").collect()}
    assert stats["edge", "rel_type"].n_rows == 3 and stats["edge", "src_variety_id"].n_nulls == 3 and stats["term", "headword"].least == "banca"
    t = publish.open_graph(spark, graph[0])
    assert {"near", "block", "n_sections"} <= set(t["edge_by_dst"].columns) and t["edge_by_dst"].count() == 3
    assert [tuple(r) for r in t["variety"].select("variety_id", "code", "lang_code").collect()] == [(1, "la-lat", "la")]
