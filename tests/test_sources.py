"""Sources, the registry's builder, the command line and functions on text."""

import json
import pathlib

import pytest
from pyspark.sql import functions as F

from glossloom import __main__ as cli
from glossloom.functions import text as X
from glossloom.operators import publish
from glossloom.plans import normalize_queries as Q
from glossloom.sources import dump, fetch, files, registry_build

LANGUAGES = {
    "qa": {"1": "Avan", "2": 11, "3": "fa", "4": "Latn,Cyrl", "type": "regular", "wikimedia_codes": "qa,qas", "strip_diacritics": {"remove_diacritics": "\u0301\u0300", "remove_exceptions": ["e\u0301", "%a\u0301"]}},
    "qbb": {"1": "Bren", "2": None, "type": "regular", "strip_diacritics": {"Latn": {"remove_diacritics": "\u0304"}, "Cyrl": {"remove_diacritics": "\u0304\u0301", "remove_exceptions": {"1": "\u0451"}}}},
    "qcc": {"1": "Cevi", "type": "appendix-constructed", "strip_diacritics": "by-program"},
    "fa-pro": {"1": "Proto-Fa", "type": "reconstructed", "strip_diacritics": {"from": ["x"], "to": ["y"]}},
    "qd": {"1": "Doru", "type": "regular", "3": "", "4": ""},
}
FAMILIES = {"fa": {"1": "Fa", "3": "top", "2": 5}, "top": {"1": "Top", "3": "top"}, "fb": {"1": "Fb", "3": "fa", "protoLanguage": "qa-old"}, "fc": {"1": "Fc"}}
VARIETIES = {"qa-old": {"1": "Old Avan", "parent": "qa", "2": 12}, "fc-pro": {"1": "Proto-Fc", "parent": "qa"}}
ISO = [
    (1, "P218", "qa"), (1, "P220", "qaa"), (1, "P219", "qaa"), (1, "P219", "ava"), (2, "P220", "qbb"), (3, "P218", "qd"), (4, "P218", "qd"), (3, "P220", "qdd"), (9, "P1798", "fa"), (1, "P218", "qa")
]


@pytest.fixture(scope="module")
def exports(tmp_path_factory):
    d = tmp_path_factory.mktemp("exports")
    for name, x in (("languages", LANGUAGES), ("families", FAMILIES), ("varieties", VARIETIES)):
        (d / f"{name}.json").write_text(json.dumps(x))
    (d / "iso639.jsonl").write_text("\n".join(json.dumps({"item": i, "property": p, "value": v}) for i, p, v in ISO))
    return d


def test_registry(spark, exports, tmp_path):
    cli.main(["sync-languages", str(exports), str(tmp_path)])
    got = {r.code: r for r in spark.read.parquet(f"{tmp_path}/language_record.parquet").collect()}
    assert set(got) == set(LANGUAGES)
    a, b = got["qa"], got["qbb"]
    assert (a.name, a.kind, a.family, a.wikidata_qid, a.scripts, a.wikimedia_codes) == ("Avan", "regular", "fa", 11, ["Latn", "Cyrl"], ["qa", "qas"])
    assert (a.iso639_1, a.iso639_2b, a.iso639_3) == ("qa", "ava", "qaa") and (a.strip_marks, a.strip_exceptions) == ("\u0301\u0300", ["\xe9"])
    assert (b.iso639_1, b.iso639_3, b.wikidata_qid, b.scripts) == (None, "qbb", None, None) and (b.strip_marks, b.strip_exceptions) == ("\u0304\u0301", ["\u0451"])
    # Not stated, stated by two items, no rule on marks.
    assert all(got[c].iso639_3 is None and got[c].iso639_1 is None and got[c].strip_marks is None for c in ("qcc", "qd", "fa-pro")) and got["qd"].family is None
    sets = {r.code: r for r in spark.read.parquet(f"{tmp_path}/language_set.parquet").collect()}
    assert {c: (r.superset, r.proto_language_code, r.iso639_5) for c, r in sets.items()} == {"fa": ("top", "fa-pro", "fa"), "top": (None, None, None), "fb": ("fa", "qa-old", None), "fc": (None, "fc-pro", None)}
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/variety.parquet").collect()} == {("qa-old", "Old Avan", "qa", 12), ("fc-pro", "Proto-Fc", "qa", None)}


def test_all_in_one(spark, tmp_path, capsys):
    (tmp_path / "dump.jsonl").write_text("\n".join([*map(json.dumps, Q.ENTRIES), "", "no json", '{"redirect":"x"}']))
    spark.createDataFrame([(*x, "regular") for x in Q.LANGUAGES], "code string, name string, strip_marks string, strip_exceptions array<string>, kind string").write.parquet(f"{tmp_path}/registry/language_record.parquet")
    spark.createDataFrame([(c, c, p) for c, p in Q.VARIETIES], "code string, name string, parent string").write.parquet(f"{tmp_path}/registry/variety.parquet")
    cli.main(["parse", f"{tmp_path}/dump.jsonl"])
    said = capsys.readouterr().out
    assert said.startswith(f"{len(Q.ENTRIES)} entries in 3 languages") and "left out: 1 not JSON" in said and "left out: 1 redirect" in said
    with pytest.raises(publish.GateError):  # names languages the registry lacks
        cli.main(["all", f"{tmp_path}/dump.jsonl", f"{tmp_path}/registry", f"{tmp_path}/work", f"{tmp_path}/graph", "2024-05-01"])
    items = dump.read_items(spark, f"{tmp_path}/work/items")
    assert items["stg_edge"].count() == len(Q._EDGES) and not files.exists(spark, f"{tmp_path}/work/items.part")
    lines = dump.to_json_lines(items)
    back = dump.split_json_lines(lines)
    assert all(sorted(map(tuple, back[n].collect()), key=str) == sorted(map(tuple, items[n].collect()), key=str) for n in items)
    # Trimmed with fewer fields than declared, or without saying so.
    files.replace(spark, f"{tmp_path}/work/entries.fields.json", json.dumps(["word"]))
    with pytest.raises(ValueError, match="lacks"):
        dump.check_fields(spark, f"{tmp_path}/work/entries")
    files.delete(spark, f"{tmp_path}/work/entries.fields.json")
    with pytest.raises(ValueError, match="no list"):
        dump.check_fields(spark, f"{tmp_path}/work/entries")


def test_a_failed_write_leaves_the_old_items(spark, tmp_path):
    e = spark.createDataFrame([("a",)], "lang_code string")
    spark.createDataFrame([("old",)], "x string").write.parquet(f"{tmp_path}/items/stg_term")
    with pytest.raises(Exception):  # noqa: B017
        dump.write_items({"stg_term": e}, f"{tmp_path}/items")
    assert spark.read.parquet(f"{tmp_path}/items/stg_term").first()[0] == "old" and not files.exists(spark, f"{tmp_path}/items.part")


def test_files(spark, tmp_path):
    at = f"{tmp_path}/f"
    assert files.create(spark, at, "one \xe9") and not files.create(spark, at, "two") and files.read(spark, at) == "one \xe9"
    files.replace(spark, at, "three")
    assert files.read(spark, at) == "three" and files.names(spark, str(tmp_path))[-1] == "f" and files.modified(spark, at) > 0
    files.delete(spark, at)
    assert not files.exists(spark, at) and files.names(spark, f"{tmp_path}/none") == []


def test_fetch(tmp_path):
    page, data = tmp_path / "page.html", tmp_path / "data.gz"
    page.write_text("<p>enwiktionary dump dated 2024-03-01</p>")
    data.write_bytes(b"x" * 5000)
    got = fetch.fetch_dump(page.as_uri(), data.as_uri(), str(tmp_path))
    assert pathlib.Path(got).read_bytes() == data.read_bytes() and got.endswith("wiktextract-data-2024-03-01.jsonl.gz")
    assert dump.newest_dump(str(tmp_path)) == "2024-03-01"
    with pytest.raises(ValueError):
        dump.served_date("nothing here")
    with pytest.raises(OSError):
        fetch.download((tmp_path / "none").as_uri(), f"{tmp_path}/to")
    assert not (tmp_path / "to.part").exists()


def test_rendered_trees(spark):
    html = """<div data-lang="qa" class="x" data-ety-tree-json="{&quot;lang&quot;:&quot;qa&quot;}"></div><div data-lang="qb" data-ety-tree-json="[]">"""
    rows = dump.rendered_trees(spark.createDataFrame([(html,), (None,), ("",)], "html string")).collect()
    assert [tuple(r) for r in rows] == [("qa", '{"lang":"qa"}'), ("qb", "[]")]


def _one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def test_text_functions(spark):
    lit = F.lit
    cases = [
        (X.display_headword(lit("a"), lit(True)), "*a"), (X.node_label(lit("a"), lit(True), lit("Avan")), "*a (Avan)"), (X.tree_url(lit("qa"), lit("a b/c\xe9!")), "/tree/qa/a%20b%2Fc%C3%A9!"),
        (X.tree_url(lit("qa"), lit("x"), lit(2)), "/tree/qa/x?etym=2"), (X.rate_limit_key(lit("10.0.0.1")), "10.0.0.1"), (X.rate_limit_key(lit("2001:db8::1")), "2001:db8:0:0"),
        (X.rate_limit_key(lit("::ffff:1.2.3.4")), "::ffff:1.2.3.4"), (X.redacted(lit("postgres://u:secret@h/db")), "postgres://u:***@h/db"), (X.strip_star(lit("**a")), "*a"),
        (X.has_term(lit("-")), False), (X.has_term(lit(" ")), False), (X.has_term(lit(None).cast("string")), False), (X.has_term(lit("a")), True), (X.section_of(lit("12")), 12),
        (X.section_of(lit("99999")), 0), (X.section_of(lit("2a")), 0), (X.section_of(lit("\xb2")), 0), (X.lang_prefix(lit("qa:x")), "qa"), (X.lang_prefix(lit("Q a:x")), None),
        (X.inline_id(lit("x<id: k >")), "k"), (X.strip_inline(lit("x <id:k>")), "x"), (X.anchor_index(lit("etymology_templates:10:der")), 10), (X.trim_labels(lit("a m or f by sense"), ["m", "f"]), "a"),
        (X.length_folded(lit("\u0101\u0113")), "ae"), (X.accent_folded(lit("\u1ead")), "a"),
        (X.strip_diacritics(lit("\u0451\u0301\u0430\u0301"), lit("\u0301\u0308"), F.array(lit("\u0451"))), "\u0451\u0430"),
    ]
    for c, want in cases:
        assert _one(spark, c) == want
    assert _one(spark, X.alternants(lit("a//b // -"))) == ["a", "b"] and _one(spark, X.lang_codes(lit("a, b,,"))) == ["a", "b"]
