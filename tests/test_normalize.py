"""Templates to edges, on entries of the kinds the dump holds."""

import json

import pytest

from glossloom.operators import chains
from glossloom.operators import normalize as N
from glossloom.sources import dump

LANGS = [
    ("qa", "Avan", None, None), ("qb", "Bren", None, None), ("qc", "Cevi", None, None), ("qe", "Elor", "\u0304\u0306", None), ("qf", "Fosk", "\u0301", None), ("qd-pro", "Proto-Dorian", None, None), ("qg-pro", "Proto-Gall", None, None),
]
VARS = [("qcx", "qc"), ("qe-new", "qe")]


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    lang = spark.createDataFrame(LANGS, "code string, name string, strip_marks string, strip_exceptions array<string>")
    var = spark.createDataFrame(VARS, "code string, parent string")

    def go(*entries):
        path = tmp_path_factory.mktemp("dump") / "d.jsonl"
        path.write_text("\n".join(json.dumps(e, ensure_ascii=False) if not isinstance(e, str) else e for e in entries))
        return N.normalize(dump.read_entries(spark, str(path)), lang, var)

    return go


def edges(items):
    return sorted((r.src_lang_code, r.src_headword, r.dst_lang_code, r.dst_headword, r.rel_type, r.anchor, r.piece_order, r.src_wiktionary_id, r.src_variety_code) for r in items["stg_edge"].collect())


def entry(word, lang, *templates, **more):
    return {"word": word, "lang_code": lang, "etymology_templates": [{"name": n, "args": {str(k): v for k, v in a.items()}} for n, a in templates]} | more


def test_directional(run):
    got = run(entry("zemul", "qd-pro", ("inh", {1: "qd-pro", 2: "qg-pro", 3: "*zam-", 5: "hollow"}), pos="noun", senses=[{"glosses": ["cave", "den"]}]))
    assert edges(got) == [("qg-pro", "zam-", "qd-pro", "zemul", "inherited", "etymology_templates:0:inh", None, None, None)]
    terms = {(r.headword, r.has_sense, r.is_reconstructed, r.gloss) for r in got["stg_term"].collect()}
    assert ("zam-", False, True, None) in terms and ("zemul", True, True, "cave") in terms


def test_chain_and_variety(run):
    # Two chains under one code; the second goes through a variety.
    got = edges(run(entry("drolo", "qa", ("etymon", {1: "qa", 2: ":der", 3: "qb:drul<ety:cal<qd-pro:*dr\u016bla>>", 4: "qcx:drolt<ety:inh<drolte>>"}))))
    assert [(g[0], g[1], g[2], g[3], g[4], g[8]) for g in got] == [
        ("qb", "drul", "qa", "drolo", "derived", None),
        ("qc", "drolt", "qa", "drolo", "derived", "qcx"),
        ("qc", "drolte", "qc", "drolt", "inherited", "qcx"),
        ("qd-pro", "dr\u016bla", "qb", "drul", "calque", None),
    ]


def test_affixes(run):
    calls = [
        (("suffix", {1: "qa", 2: "lasi", 3: "tur"}), [("-tur", "affix", 2), ("lasi", "affix", 1)]),
        (("pre", {1: "qa", 2: "ne", 3: "lasi"}), [("lasi", "affix", 2), ("ne-", "affix", 1)]),
        (("confix", {1: "qa", 2: "o", 3: "u"}), [("-u", "affix", 2), ("o-", "affix", 1)]),
        (("suffix", {1: "qa", 2: "", 3: "tur"}), [("-tur", "affix", 2)]),
        (("af", {1: "qa", 2: "vo", "alt1": "voo", 3: "qe:zi<id:k>"}), [("voo", "affix", 1), ("zi", "affix", 2)]),
        (("surf", {1: "+suf", 2: "qa", 3: "dok", 4: "al"}), [("-al", "surface_analysis", 2), ("dok", "surface_analysis", 1)]),
        (("surf", {1: "+qa-agent", 2: "dok"}), [("dok", "surface_analysis", 1)]),
    ]
    got = edges(run(*[entry(f"word{i}", "qa", t) for i, (t, _) in enumerate(calls)]))
    for i, (_, want) in enumerate(calls):
        assert sorted((g[1], g[4], g[6]) for g in got if g[3] == f"word{i}") == want


def test_other_families(run):
    got = edges(run(entry(
        "word", "qa", ("root", {1: "qa", 2: "qg-pro", 3: "*ta-", 4: "*to-", "id": "x", "id2": "y"}), ("m", {1: "qe", 2: "p", 3: "pp"}), ("clip", {1: "qa", 2: "", 3: "u,v"}),
        ("sa-root", {1: "r"}), ("bor", {1: "qa", 2: "qe, qf", 3: "s//t"}), ("unmapped", {1: "z"}),
    )))
    assert [(g[0], g[1], g[4], g[7]) for g in got] == sorted([
        ("qg-pro", "ta-", "root", "x"), ("qg-pro", "to-", "root", "y"), ("qe", "pp", "mention", None), ("qa", "u", "shortening", None), ("qa", "v", "shortening", None),
        ("sa", "r", "root", None), ("qe", "s", "borrowed", None), ("qe", "t", "borrowed", None), ("qf", "s", "borrowed", None), ("qf", "t", "borrowed", None),
    ])


def test_inflection_needs_a_page(run):
    form = {"word": "gulon", "lang_code": "qf", "senses": [{"tags": ["plural", "form-of"], "form_of": [{"word": "gul\u00e1 f"}]}]}
    assert edges(run(form)) == []
    got = edges(run(form, {"word": "gula", "lang_code": "qf"}))
    assert got == [("qf", "gula", "qf", "gulon", "inflection", "senses:0:form_of", None, None, None)]


def test_forms_only_pages_give_no_templates(run):
    e = entry("gulon", "qa", ("inh", {1: "qa", 2: "qb", 3: "x"}), senses=[{"tags": ["form-of"], "form_of": [{"word": "gul"}]}])
    assert edges(run(e)) == []


def test_equal_entries_count_once(run):
    e = entry("zemul", "qa", ("bor", {1: "qa", 2: "qb", 3: "zam"}))
    assert len(edges(run(e, e, e | {"pos": "verb"}))) == 2
    listed = {"word": "zam", "lang_code": "qb", "etymology_number": "1"}
    lists = [listed | {"descendants": [{"lang_code": "qa", "word": w}]} for w in ("x", "y")]
    assert {r.listed_headword for r in run(*lists)["stg_section_claim"].collect()} == {"x", "y"}


def test_claims(run):
    a = entry("vo", "qa", ("etymid", {1: "qa", 2: "shore"}), ("etymon", {1: "qa", "id": "net"}), etymology_number="2", senses=[{"senseid": ["qa:knot"]}])
    b = {"word": "voo", "lang_code": "qb", "etymology_number": "4", "descendants": [{"lang_code": "qc", "word": "vu", "descendants": [{"lang_code": "qa", "word": "vo", "descendants": [{"lang_code": "qe", "word": "v"}]}]}]}
    rows = run(a, b)["stg_section_claim"].collect()
    assert sorted((r.section, r.wiktionary_id or "", r.listed_lang_code or "") for r in rows) == [(2, "knot", ""), (2, "net", ""), (2, "shore", ""), (4, "", "qa"), (4, "", "qc"), (4, "", "qe")]


def test_rejected_lines(spark, tmp_path):
    p = tmp_path / "d.jsonl"
    p.write_text("\n".join(['{"word":"a","lang_code":"qa"}', "", "not json", "[1]", '{"title":"x","redirect":"y"}', '{"word":5,"lang_code":"qa"}', '{"word":"","lang_code":"qa"}', '{"word":"a","lang_code":"qa","senses":3}']))
    assert dump.read_entries(spark, str(p)).count() == 1
    assert {r.reason: r.n_lines for r in dump.rejected_lines(spark, str(p)).collect()} == {"blank": 1, "not JSON": 1, "no object": 1, "redirect": 1, "wrong type or missing field": 3}


def test_nested_chains():
    assert list(chains.chain_slots("a", "qa")) == []
    assert [x[:5] for x in chains.chain_slots("-<ety:bor<qe:x<ety:der<y>>>>", "qa")] == [("qe", "y", "qe", "x", "derived")]
    two = list(chains.chain_slots("w<ety:af<a><b><unc:1>>", "qa"))
    assert [(x[1], x[5]) for x in two] == [("a", 1), ("b", 2)]
    deep = "x" + "".join(f"<ety:inh<t{i}" for i in range(3000)) + ">>" * 3000
    assert len(list(chains.chain_slots(deep, "qa"))) == 3000


def test_unmapped_codes_are_counted(spark, tmp_path):
    e = entry("w", "qa", ("etymon", {1: "qa", 2: ":zz", 3: "qe:a", 4: ":inh", 5: "qb:b<ety:yy<qc:c><qe:d<ety:inh<qe:f>>>>"}), ("ety", {1: "qa", 2: ":zz<q>", "tree": "qe:x<ety:xx<qe:y>>"}), ("odd", {1: "z"}), ("bor", {1: "qa", 2: "qe", 3: "s"}))
    (tmp_path / "d.jsonl").write_text(json.dumps(e))
    got = [tuple(r) for r in N.unmapped_names(dump.read_entries(spark, f"{tmp_path}/d.jsonl")).collect()]
    assert got == [("etymon:yy", 2), ("etymon:zz", 2), ("etymon:xx", 1), ("odd", 1)]
