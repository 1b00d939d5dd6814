"""The text problems' operators against brute force and round trips."""

import random
import string
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from glossloom.llm import canonical, chunks, leaks, lookalikes, mixture
from glossloom.llm.tokens import encoding, token_count


# -- 5 -------------------------------------------------------------------------------------------
SAME = [
    ("abc", "\uff41\uff42\uff43"), ("abc", "\u0430b\u0441"), ("\xe9", "e\u0301"), ("\u1ead", "a\u0302\u0323"), ("a\u200bb", "ab"), ("a\xa0b", "a b"), ("a-b", "a\u2011b"), (" ab", "ab "), ("\ufb01n", "fin"),
    ("e\u034f\u0323\u0302", "\u1ec7"), ("\u03bf", "o"), ("\u0439", "\u0438\u0306"), ("a\u0308\u0323", "a\u0323\u0308"), ("\ufeffx", "x"), ("\u200b", ""), ("o\ufb03ce", "\u043effice"), ("\uff76\uff9e", "\u30ac"),
]
DIFFERENT = [("a", "A"), ("e", "é"), ("h", "ʰ"), ("1", "₁"), ("ab", "a b"), ("n", "п"), ("o", "0"), ("̄̌", "̌̄"), ("æ", "ae"), ("a-b", "a–b"), ("l", "1")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(a, b):
    assert a != b and lookalikes.bucket(a) == lookalikes.bucket(b)
    assert lookalikes.classes([a, "other", b]) == ([[0, 2]])
    assert len(set(lookalikes.canonical([(a, 1), (b, 2), ("other", 1)]))) == 2


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different_look(a, b):
    assert len(set(lookalikes.canonical([(a, 1), (b, 2)]))) == 2


def test_automaton_counts_edits():
    t = lookalikes.Trie()
    for i, w in enumerate(["house", "mouse", "ｈоuse", "ho​uses", "home"]):
        t.add(w, i)
    assert t.near("house") == [0, 2]
    assert t.near("house", 1) == [0, 1, 2, 3]
    assert t.near("hоme", 2) == [0, 2, 4]


def test_tries_hold_spellings_as_written():
    t = lookalikes.Trie()
    for i, w in enumerate(["coc", "\u0441\u043e\u0441", "c\u043ec", "\ufb01t", "fit", "fi", " coc\u200b"]):
        t.add(w, i)
    assert {"c", "\u0441", "f", "\ufb01", " "} == set(t.root)  # look-alikes are different edges
    assert t.near("\u0441oc") == [0, 1, 2, 6] and t.near("f\u0456t") == [3, 4] and t.near("\ufb01") == [5]
    assert t.near("fat") == [] and t.near("fat", 1) == [3, 4]


def test_canonical_spelling_of_a_class():
    # Its own table form first, then the most frequent; alone, by the table.
    assert lookalikes.canonical([("\u0441\u043e\u0441", 9), ("coc", 1)]) == ["coc", "coc"]
    assert lookalikes.canonical([("\u043c\u0430\u043c\u0430", 5), ("\u043ca\u043c\u0430", 9)]) == ["\u043ca\u043c\u0430"] * 2
    assert lookalikes.canonical([("\uff58", 1)]) == ["x"]


def test_classes_against_the_table():
    rnd = random.Random(2)
    parts = ["a", "\u0430", "e", "\xe9", "e\u0301", "\ufb01", "fi", "f", "i", " ", "\xa0", "\u200b", "\xad", "\uff27", "\uff9e", "\u30ab", "\u30ac", "-", "\u2010", "\u0323", "\u0302", "\u034f", "\t", "\ufb03"]
    words = list(dict.fromkeys("".join(rnd.choice(parts) for _ in range(rnd.randrange(6))) for _ in range(6000)))
    by = defaultdict(list)
    for w in words:
        by[lookalikes.bucket(w)].append(w)
    got = {frozenset(ws[i] for i in like) for ws in by.values() for like in lookalikes.classes(ws)}
    want = defaultdict(set)
    for w in words:
        want[lookalikes.visible(w)].add(w)
    assert got == {frozenset(x) for x in want.values() if len(x) > 1} and len(got) > 100


def test_a_hot_spelling(spark):
    rows = [(i, "x", "coc") for i in range(500)] + [(1000, "x", "\u0441oc"), (1001, "x", "c\u043ec"), (1000, "x", "\u0441oc")]
    df = spark.createDataFrame(rows, "id long, g string, t string")
    got = {(r.id_a, r.id_b) for r in lookalikes.lookalike_pairs(df, "id", "t", "g").collect()}
    assert got == {(i, j) for i in range(500) for j in (1000, 1001)} | {(1000, 1001)}


def test_pairs_against_brute_force(spark):
    rnd = random.Random(4)
    swap = {"a": "а", "o": "ο", "e": "е", "c": "с"}
    rows = []
    for i in range(400):
        w = "".join(rnd.choice("aoecé ") for _ in range(rnd.randrange(1, 4)))
        if rnd.random() < 0.5:
            w = "".join(swap.get(ch, ch) if rnd.random() < 0.5 else ch + ("‍" if rnd.random() < 0.2 else "") for ch in w)
        rows.append((i, rnd.choice(["x", "x", "y", None]), rnd.choice([w, w, w, None])))
    rows += rows[:30] + [(900, "x", ""), (901, "x", "​"), (902, "x", " "), (None, "x", "a")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "id long, g string, t string, _txt string, _n int")
    got = {(r.id_a, r.id_b) for r in lookalikes.lookalike_pairs(df, "id", "t", "g").collect()}
    full = {r for r in rows if None not in r}
    want = {(a[0], b[0]) for a in full for b in full if a[0] < b[0] and a[1] == b[1] and a[2] != b[2] and lookalikes.visible(a[2]) == lookalikes.visible(b[2])}
    assert got == want
    assert lookalikes.lookalike_pairs(df.limit(0), "id", "t", "g").count() == 0


# -- 7 -------------------------------------------------------------------------------------------
def test_pigeonhole_finds_all(spark):
    rnd = random.Random(9)
    refs = ["".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 13))) for _ in range(60)]
    values = []
    for r in refs * 4:
        v = list(r)
        for _ in range(rnd.randrange(5)):
            i = rnd.randrange(len(v) + 1)
            v[i : i + rnd.randrange(2)] = rnd.choice(["", "a", "z"])
        values.append("".join(v))
    k = lambda r: 4 if len(r) >= 10 else 3 if len(r) == 9 else 2 if len(r) >= 6 else 1 if len(r) >= 3 else 0
    ent = spark.createDataFrame([(v,) for v in [*values, None, "", values[0]]], "raw string")
    ref = spark.createDataFrame([(f"{i:03}", r) for i, r in enumerate(refs)] + [("x", None), ("y", "")], "key string, name string")
    got = {(r.raw, r.key, r.dist) for r in canonical.map_values(spark, ent, ref, "array(raw)", "w", "name", canonical.budget("{col}")).collect()}
    con = duckdb.connect()
    want = set()
    for v in set(values) - {""}:
        near = [(d, -len(r), f"{i:03}") for i, r in enumerate(refs) if (d := con.execute("select levenshtein(?, ?)", [v, r]).fetchall()[0][0]) <= k(r)]
        if near:
            want.add((v, min(near)[2], min(near)[0]))
    assert got == want


def test_citations(spark):
    lang = spark.createDataFrame([
        ("qdq", "Kabenokish", "q0", None, "xqdq", ["zz-d"]), ("qqo", "Old Kabenokish", None, None, None, None), ("qfu-pro", "Proto-Kabenokish", None, "bfu", None, None), ("qbk", "Penaroi", None, None, None, None)
    ], "code string, name string, iso639_1 string, iso639_2b string, iso639_3 string, wikimedia_codes array<string>")
    lemma = spark.createDataFrame([(1, "qdq", "liikypyröwös", "g"), (2, "qdq", "motēhomūgo", "reed")], "lemma_id int, lang_code string, headword string, gloss string")
    langs = {
        "Kabenokish:": "qdq", "kabenokish old": "qqo", "O. Kabenokish": "qqo", "Kabenokish (Old)": "qqo", "Prot. Kabenokish": "qfu-pro", "pROTO–kABENOKSIH": "qfu-pro", "[xqdq]": "qdq", "QFU-PRO": "qfu-pro",
        "the Old Kabenokish language": "qqo", "qqo - Old Kabenokish": "qqo", "Pēnarói": "qbk", "Middle Mepirikese": "", "n/a": "", "": "", " ": "", "bfu": "qfu-pro", "Old Kábenokish lang.": "qqo", "zz-d": "qdq",
    }
    words = {
        "*motēhomūgo": "2", "[[motēhomūgo]]": "2", "motēhomūgo ‘reed’": "2", "Old Kabenokish moteho mugo": "2", "MOTĒHOMŪGO (reed)": "2", "''liikyypröwös''": "1", "{{m|liikypyröwös}}": "1", "li​ikypy·röwös": "1", "unknown": "", "?": ""
    }
    rows = [(i, x, None) for i, x in enumerate(langs)] + [(100 + i, None, x) for i, x in enumerate(words)]
    df = spark.createDataFrame([*rows, *rows[:5], (None, "qdq", "x")], "citation_id long, lang_text string, src_text string").withColumn("key", F.lit("clash"))
    got = {(r.citation_id, r.raw_field): r.matched_key for r in canonical.mapped_citations(spark, df, lang, lemma).collect()}
    assert got == {(i, "lang_text"): k for i, k in enumerate(langs.values())} | {(100 + i, "src_text"): k for i, k in enumerate(words.values())}


def test_lemma_in_many_pieces(spark):
    lemma = spark.createDataFrame([(1, "qdq", "liikypyröwös", "g"), (2, "qdq", "motēhomūgo", "reed"), (3, "qdq", None, None)], "lemma_id int, lang_code string, headword string, gloss string")
    words = {
        "m o t ē h o m ū g o a tall kind of reed": "2", "Old Kabenokish l i i k y p y r ö w ö s Middle Mepirikese dialect": "1", "m o t ē h o m ū g o": "2", "li ik yp yr öw ös from somewhere else": "1",
        "a b c d e f g h i j k": "", "liikypyröwös": "1", "": "",
    }
    df = spark.createDataFrame([(w,) for w in [*words, None]], "src_text string")
    got = {r.raw: r.key for r in canonical.lemma_matches(spark, df, lemma).collect()}
    assert got == {w: k for w, k in words.items() if k}
    assert canonical.lemma_matches(spark, df, lemma.limit(0)).count() == 0


# -- 8 -------------------------------------------------------------------------------------------
def test_leaks_against_brute_force(spark):
    rnd = random.Random(6)
    vocab = ["".join(rnd.choice(string.ascii_lowercase) for _ in range(rnd.randrange(1, 8))) for _ in range(25)]
    say = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(say(rnd.randrange(8, 30)))) for i in range(12)]
    docs = []
    for d in range(120):
        w = say(rnd.randrange(0, 60))
        if rnd.random() < 0.7:
            src = rnd.choice(items)[1].split()
            a = rnd.randrange(len(src))
            w[len(w) // 2 : len(w) // 2] = src[a : a + rnd.randrange(8, 18)]
        docs.append((d, rnd.choice([" ", " ", ", ", " '' "]).join(x.upper() if rnd.random() < 0.3 else x for x in w)))
    docs += [(500, None), (None, items[0][1]), (501, ""), (502, ("pad " * 300_000) + items[0][1] + " pad"), docs[0]]
    want = set()
    for d, t in docs:
        if d is None or t is None:
            continue
        s = " " + " ".join(leaks.normal_words(t)) + " "
        for i, x in items:
            w = x.split()
            if any(" " + " ".join(w[k : k + 12]) + " " in s for k in range(len(w) - 11)):
                want.add((d, i))
    dd = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1))
    ii = spark.createDataFrame([*items, (99, None), (98, "too short")], "item_id int, text string")
    got = leaks.leaks(dd, ii).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 10
    assert leaks.leaks(dd, ii.limit(0)).count() == 0 and leaks.leaks(dd.limit(0), ii).count() == 0


def test_leaks_with_edits(spark):
    item = "the quick brown fox jumps over the lazy dog while seven grey wolves watch from the hill"
    doc = "so the quick browm fox jumps over the lazy dog whle seven grey wolves watch from afar"
    dd, ii = spark.createDataFrame([(1, doc)], "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id int, text string")
    assert leaks.leaks(dd, ii).count() == 0
    assert [(r.doc_id, r.item_id, r.n_words) for r in leaks.leaks(dd, ii, exact=False).collect()] == [(1, 7, 0)]


def _zipf(rnd, n_words, n_items, length):
    vocab = ["".join(rnd.choice(string.ascii_lowercase) for _ in range(rnd.randrange(2, 9))) for _ in range(n_words)]
    say = lambda n: rnd.choices(vocab, [1 / (r + 2) for r in range(n_words)], k=n)
    return say, [(i, " ".join(say(length))) for i in range(n_items)]


def test_leaks_in_small_tiles(monkeypatch):
    rnd = random.Random(3)
    for hits, piece in ((2000, 1024), (500, 300)):
        monkeypatch.setattr(leaks, "HITS_AT_ONCE", hits)
        monkeypatch.setattr(leaks, "PIECE", piece)
        monkeypatch.setattr(leaks, "SLICE_CHARS", 3000)
        say, items = _zipf(rnd, 40, 30, 40)
        items.append((99, " ".join(["la"] * 200)))  # every q-gram everywhere
        texts = [" ".join(say(200)) for _ in range(15)] + [" ".join(["la"] * 300), " ".join([*say(2000), *["la"] * 12, *say(10)])]
        for n in range(15):
            w, src = texts[n].split(), rnd.choice(items)[1].split()
            w[90:90] = src[5:17]
            texts[n] = " ".join(w)
        index = leaks.Items(items, 12)
        got = {(n, f[0]) for n, found in enumerate(index.found(texts, True)) for f in found}
        runs = lambda w: {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        want = {(n, i) for n, t in enumerate(texts) for i, x in items if runs(t.split()) & runs(x.split())}
        assert got == want and {(15, 99), (16, 99)} <= got


def test_leak_slices_and_blocks():
    text = "a b " * 50 + "word " * 400 + "x" * 900 + " end"
    parts = list(leaks.slices(text, 3, 200))
    assert parts[0] + [w for p in parts[1:] for w in p[3:]] == leaks.normal_words(text)
    assert [len(b) for b in leaks.item_blocks([(1, "a" * 60), (2, "b" * 50), (3, "c" * 40), (4, "d" * 500), (5, "e")], 100)] == [1, 2, 1, 1]


def test_edited_passages_are_recalled():
    rnd = random.Random(5)
    say, items = _zipf(rnd, 3000, 40, 60)
    index = leaks.Items(items, 12)
    texts, want = [], []
    for n in range(300):
        item, words = rnd.choice(items)
        a = rnd.randrange(48)
        s = " ".join(words.split()[a : a + 12])
        for _ in range(rnd.randrange(3)):
            k = rnd.randrange(1, len(s) - 1)
            s = s[:k] + rnd.choice(["", "q", s[k] + "z"]) + s[k + 1 :]
        texts.append(" ".join([*say(50), s, *say(50)]))
        want.append(item)
    met = sum(w in {f[0] for f in found} for w, found in zip(want, index.found(texts, False)))
    assert met == 300


def test_memory_of_a_large_item_list():
    import resource
    import subprocess
    import sys

    code = (
        "import random, resource\nfrom glossloom.llm import leaks\nfrom tests.llm.test_text import _zipf\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\nsay, items = _zipf(random.Random(1), 5000, 5000, 60)\n"
        "index = leaks.Items(items, 12)\nindex.found([' '.join(say(1000)) for _ in range(3)], True)\n"
        "print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout
    assert int(out.split()[-1]) < 400  # a block of 1.8 million characters


# -- 9 -------------------------------------------------------------------------------------------
def _weights(spark, *rows):
    return spark.createDataFrame([*rows], "source string, target_share double, max_repeats int")


def test_mixture(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice(["a"] * 6 + ["b", "c", "off"]), rnd.choice([0, 5, 40, rnd.randrange(1, 400)])) for i in range(3000)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, tokens long").cache()
    weights = _weights(spark, ("a", 0.4, 1), ("b", 0.3, 3), ("c", 0.2, 4), ("absent", 0.1, 2), ("b", 0.3, 3), (None, 0.5, 1))
    drawn = mixture.mixture(sizes, weights).collect()
    assert len({r.doc_id for r in drawn}) == len(drawn)
    cap = {"a": 1, "b": 3, "c": 4}
    assert all(1 <= r.copies <= cap[r.source] for r in drawn)
    total = sum(r.tokens * r.copies for r in drawn)
    for s, share in {"a": 0.4, "b": 0.3, "c": 0.2}.items():
        assert abs(sum(r.tokens * r.copies for r in drawn if r.source == s) / total - share / 0.9) < 0.02
    assert sorted(map(tuple, drawn)) == sorted(map(tuple, mixture.mixture(sizes.repartition(5), weights).collect()))
    assert sorted(map(tuple, drawn)) != sorted(map(tuple, mixture.mixture(sizes, weights, seed=2).collect()))
    rep = {r.source: r for r in mixture.shares(sizes, weights).collect()}
    assert rep["absent"].tokens_drawn == 0 and rep["off"].target_share is None and abs(sum(r.actual_share for r in rep.values()) - 1) < 1e-9
    assert mixture.mixture(sizes.limit(0), weights).count() == 0 and mixture.mixture(sizes, weights.limit(0)).count() == 0


def test_mixture_of_a_given_total(spark):
    sizes = spark.createDataFrame([(i, "a" if i < 400 else "b", 10) for i in range(500)], "doc_id long, source string, tokens long")
    weights = _weights(spark, ("a", 0.5, 1), ("b", 0.5, 2))
    rep = lambda **k: {r.source: r for r in mixture.shares(sizes, weights, **k).collect()}
    assert {s: r.tokens_drawn for s, r in rep(total=1000).items()} == {"a": 500, "b": 500}
    assert {s: r.tokens_drawn for s, r in rep().items()} == {"a": 2000, "b": 2000}
    # Beyond what the scarcest has, it gives all its copies and the others keep to their budgets.
    assert {s: r.tokens_drawn for s, r in rep(total=6000).items()} == {"a": 3000, "b": 2000}


def test_mixture_odds(spark):
    # Many sources alike are many draws: small documents are certain, the others' odds fall with the root of their size.
    rnd, n = random.Random(4), 60
    size = [rnd.choice([1, 1, 50, 200, 900]) for _ in range(300)]
    sizes = spark.createDataFrame([(s * 1000 + i, f"s{s}", t) for s in range(n) for i, t in enumerate(size)] + [(10**6, "b", 12_000)], "doc_id long, source string, tokens long").cache()
    weights = _weights(spark, *((f"s{s}", 1.0, 1) for s in range(n)), ("b", 1.0, 1))
    p = {r.source: r for r in mixture.draw_plan(sizes, weights).collect()}["s7"]
    pi = [1.0 if t <= p.upto else p.c / t**0.5 for t in size]
    assert p.upto == 1 and abs(sum(pi) - p.take) < 1e-6 and max(v for v, t in zip(pi, size) if t > 1) < 1
    assert abs(sum(v * t for v, t in zip(pi, size)) - 12_000) < 300
    by = defaultdict(list)
    for r in mixture.mixture(sizes, weights).where("source <> 'b'").select("source", "tokens").collect():
        by[r.source].append(r.tokens)
    assert {len(x) for x in by.values()} == {p.take} and len(by) == n  # fixed size
    for t in (1, 50, 200, 900):
        want = sum(v for v, u in zip(pi, size) if u == t)
        assert abs(sum(x.count(t) for x in by.values()) / n - want) < 4 * (want / n) ** 0.5 + 0.02 * want


def test_token_count(spark):
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("ậ😀",)], "t string")
    got = [r[0] for r in df.select(token_count("t")).collect()]
    assert got == [2, 0, None, len(encoding().encode_ordinary("ậ😀"))]


# -- 10 ------------------------------------------------------------------------------------------
def _text(rnd):
    word = lambda: "".join(rnd.choice("abcdeéжậ漢😀") for _ in range(rnd.randrange(1, 9)))
    sentence = lambda: " ".join(word() for _ in range(rnd.randrange(1, 20))) + rnd.choice([". ", "! ", "? "])
    block = lambda: rnd.choice(["", "* "]) + "".join(sentence() for _ in range(rnd.randrange(1, 6)))
    return rnd.choice(["\n\n", "\r\n\r\n", "\n"]).join(rnd.choice([f"== {word()} ==", f"=== {word()} ===", block(), block()]) for _ in range(rnd.randrange(1, 30)))


def test_pieces_round_trip(spark):
    rnd = random.Random(12)
    docs = [(i, _text(rnd)) for i in range(60)] + [(100, "x" * 3000), (101, "漢" * 2000), (102, ""), (103, None), (None, "y"), (104, "a. " * 2000), (105, " " * 5000), (106, "\n\n" * 900 + "z")]
    df = spark.createDataFrame(docs + docs[:3], "doc_id long, text string").withColumn("piece_no", F.lit(9))
    limit, overlap = 120, 20
    by = defaultdict(list)
    for r in chunks.pieces(df, limit, overlap).collect():
        by[r.doc_id].append(r)
    enc = encoding()
    assert set(by) == {d for d, t in docs if d is not None and t is not None}
    for d, t in docs:
        if d is None or t is None:
            continue
        ps = sorted(by[d], key=lambda r: r.piece_no)
        assert "".join(t[p.start_char : p.end_char] for p in ps) == t
        assert [p.piece_no for p in ps] == list(range(len(ps)))
        assert (len(ps) > 1) == (len(enc.encode_ordinary(t)) > limit)
        for a, b in zip([None, *ps], ps):
            assert b.text == t[b.overlap_start : b.end_char] and b.n_tokens == len(enc.encode_ordinary(b.text)) <= limit
            if a is not None and len(t) < 3000 and d < 100:
                assert a.start_char <= b.overlap_start < b.start_char


@pytest.mark.parametrize("eol", ["\n", "\r\n", "\r"])
def test_pieces_cut_at_boundaries(eol):
    enc = encoding()
    cut = lambda t, limit=120: [t[a:b] for a, b, _, _ in chunks.Text(t, enc).pieces(limit, 10)]
    heads = "".join(f"== part {i} =={eol}" + "word " * 40 + eol * 2 for i in range(6))
    assert len(cut(heads)) > 2 and all(p.startswith("== part") for p in cut(heads))
    # The end of an oversized section isn't joined to the next, nor a heading left behind alone.
    big = eol.join(["# A", "word " * 300, "# B", "word " * 30, "# C", "word " * 10])
    assert [p[:3] for p in cut(big) if "#" in p] == ["# A", "# B"] and not any(p.rstrip() == "# A" or ("# B" in p and not p.startswith("# B")) for p in cut(big))
    # An item keeps the items below it.
    items = eol.join(f"* item {i}{eol}" + eol.join(f"** sub {i}.{j} " + "w " * 10 for j in range(3)) for i in range(8))
    assert len(cut(items)) == 8 and all(p.startswith("* item") for p in cut(items))
    rows = eol.join(["{| class=x", *(f"|-{eol}| cell {i} || " + "w " * 20 for i in range(12))])
    assert len(cut(rows)) > 2 and all(p.startswith("|-") for p in cut(rows)[1:])
    blocks = (eol * 2).join("word " * 30 for _ in range(6))
    assert all(p.endswith(eol * 2) for p in cut(blocks)[:-1])


def test_oversized(spark):
    df = spark.createDataFrame([(1, "word " * 3000), (1, "word " * 3000), (2, "short"), (3, None), (None, "word " * 3000), (4, "")], "doc_id long, text string")
    assert [r.doc_id for r in chunks.oversized(df).collect()] == [1]
    assert chunks.oversized(df.limit(0)).count() == 0
