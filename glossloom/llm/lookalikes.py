"""Problem 5: one form for texts that look the same.

The vocabulary (distinct spellings with their counts) is put into tries as it is written, one per
language and bucket of first letters and length. A weighted edit automaton walks each trie:
substituting a look-alike, dropping or inserting a character that does not show, and swapping a
ligature for its letters cost 0, any other edit costs 1. At a budget of 0 a spelling reaches exactly
the spellings that look like it, of which one is chosen as the canonical one; a spelling that reaches
no other is normalised by the table. Spellings that are their own table form are only reached: two of
them never look the same.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossloom.session import Scratch

# Letters of one script with the shape of a Latin letter, as pairs "look-alike, Latin letter".
SAME_SHAPE = dict(
    pair.split()
    for pair in """
а a; с c; ԁ d; е e; ɡ g; һ h; і i; ј j; ӏ l; о o; р p; ԛ q; ѕ s; у y; ѵ v; ԝ w; х x; ӕ æ; ә ə;
А A; В B; С C; Е E; Ԍ G; Н H; І I; Ј J; К K; Ӏ I; М M; О O; Р P; Ԛ Q; Ѕ S; Т T; Ԝ W; Х X; Ү Y; Ѵ V; Ӕ Æ; Ә Ə;
ο o; ν v; ϳ j; ϲ c; Α A; Β B; Ε E; Ζ Z; Η H; Ι I; Κ K; Μ M; Ν N; Ο O; Ρ P; Τ T; Υ Y; Χ X; Ϲ C; Ϳ J;
օ o; ս u; հ h; ց g; ո n; զ q; Օ O; Ս U
""".replace("\n", " ").split(";")
)
#: Hyphens; longer dashes look different.
HYPHENS = "˗‐‑‒⁃−﹣－"
#: Characters that do not show although they are no format characters.
HIDDEN = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


def ignorable(ch: str) -> bool:
    """Whether a character does not show: format characters, joiners, selectors and fillers."""
    return ord(ch) in HIDDEN or unicodedata.category(ch) in ("Cf", "Cc") and ch not in "\t\n\r\x0b\x0c\x85" and not 0x600 <= ord(ch) <= 0x605


def _spread(ch: str) -> str:
    """A character as the plain characters it looks like: width, ligatures, blanks, hyphens, shape."""
    if ch.isascii() and ch > " ":
        return ch
    if ch.isspace():
        return " "
    if ch in HYPHENS:
        return "-"
    how, _, to = unicodedata.decomposition(ch).partition("> ")
    if how in ("<wide", "<narrow") or how == "<compat" and ("LIGATURE" in unicodedata.name(ch, "") or 0x1C4 <= ord(ch) <= 0x1CC or 0x1F1 <= ord(ch) <= 0x1F3):
        return "".join(_spread(c) for x in to.split() for c in unicodedata.normalize("NFD", chr(int(x, 16))))
    return SAME_SHAPE.get(ch, ch)


class _Spread(dict):
    def __missing__(self, ch: str) -> str:
        out = "" if ignorable(ch) else "".join(_spread(c) for c in unicodedata.normalize("NFD", _spread(ch)))
        self[ch] = out
        return out


#: Character to what shows of it ('' if nothing does), filled on use.
SHOWN = _Spread()


def visible(text: str) -> str:
    """The table form: what shows of a text, decomposed, marks in canonical order, blanks at the ends cut."""
    return unicodedata.normalize("NFD", "".join([SHOWN[c] for c in text])).strip(" ")


def composed(text: str) -> str:
    """The table form with marks composed again."""
    return unicodedata.normalize("NFC", visible(text))


def bucket(text: str) -> str:
    """Where a spelling is looked for: what shows of its first letters, and how many letters show."""
    if text.isascii() and text.isprintable():
        letters = text.replace(" ", "")
    else:
        letters = "".join([c for ch in text for c in SHOWN[ch] if c != " " and not unicodedata.combining(c)])
    return f"{letters[:2]}{len(letters) % 32:x}"


def symbols(text: str) -> list[str]:
    """A spelling as the symbols a trie holds: decomposed, with runs of marks in canonical order.

    Characters that do not show stay in, as edges of cost 0, but behind the marks they would cut apart.
    """
    if text.isascii():
        return list(text)
    out: list[str] = []
    marks: list[str] = []
    hidden: list[str] = []
    for ch in unicodedata.normalize("NFD", text):
        look = SHOWN[ch]
        if not look:
            hidden.append(ch)
        elif unicodedata.combining(look[0]):
            marks.append(look)
        else:
            if marks or hidden:
                out += unicodedata.normalize("NFD", "".join(marks)) + "".join(hidden)
                marks, hidden = [], []
            out.append(ch)
    out += unicodedata.normalize("NFD", "".join(marks)) + "".join(hidden)
    return out


class Trie:
    """A trie of spellings as they are written, walked by the weighted edit automaton.

    A node is a dict from symbol to node; the references that end there stand under ''.
    """

    __slots__ = ("root", "like", "silent", "blank", "alphabet")

    def __init__(self):
        self.root: dict = {}
        self.alphabet: set[str] = set()
        self.like: dict[str, list[tuple[str, str]]] = {}  # letter -> symbols that begin with its look, and what is left of them
        self.silent: list[str] = []
        self.blank: list[str] = []

    def add(self, text: str, ref: int) -> None:
        node = self.root
        for ch in symbols(text):
            to = node.get(ch)
            if to is None:
                to = node[ch] = {}
                if ch not in self.alphabet:
                    self._learn(ch)
            node = to
        node.setdefault("", []).append(ref)

    def _learn(self, ch: str) -> None:
        self.alphabet.add(ch)
        look = SHOWN[ch]
        if not look:
            self.silent.append(ch)
        else:
            self.like.setdefault(look[0], []).append((ch, look[1:]))
            if look == " ":
                self.blank.append(ch)

    def near(self, text: str, budget: int = 0) -> list[int]:
        """References of all spellings within ``budget`` edits; look-alikes, ligatures and hidden characters are free.

        Blanks at either end are free too.
        """
        word = [c for ch in symbols(text) for c in SHOWN[ch]]
        while word and word[-1] == " ":
            word.pop()
        while word and word[0] == " ":
            del word[0]
        # A state is a node and what is left of the ligature that led to it.
        states = {(id(self.root), ""): (self.root, "", 0)}
        self._free(states, budget, [*self.silent, *self.blank])
        for c in word:
            nxt: dict[tuple[int, str], tuple[dict, str, int]] = {}
            for node, rest, cost in states.values():
                if rest:
                    steps = [(node, rest[1:], cost)] if rest[0] == c else []
                else:
                    steps = [(node[ch], more, cost) for ch, more in self.like.get(c, ()) if ch in node]
                if cost < budget:
                    steps.append((node, rest, cost + 1))  # a letter too many
                    if rest:
                        steps.append((node, rest[1:], cost + 1))
                    else:
                        steps += [(to, SHOWN[ch][1:], cost + 1) for ch, to in node.items() if ch and SHOWN[ch]]
                for to, more, spent in steps:
                    self._keep(nxt, to, more, spent)
            if not nxt:
                return []
            states = nxt
            if self.silent or budget:
                self._free(states, budget, self.silent)
        self._free(states, budget, [*self.silent, *self.blank])
        return sorted({ref for node, rest, _ in states.values() if not rest for ref in node.get("", ())})

    @staticmethod
    def _keep(states: dict, node: dict, rest: str, cost: int) -> bool:
        was = states.get((id(node), rest))
        if was is not None and was[2] <= cost:
            return False
        states[id(node), rest] = (node, rest, cost)
        return True

    def _free(self, states: dict, budget: int, symbols_: list[str]) -> None:
        """Adds all states reached over the given symbols for nothing, and over any other for an edit."""
        stack = list(states.values())
        while stack:
            node, rest, cost = stack.pop()
            steps = [] if rest else [(node[ch], "", cost) for ch in symbols_ if ch in node]
            if cost < budget:  # a letter missing
                steps += [(node, rest[1:], cost + 1)] if rest else [(to, SHOWN[ch][1:], cost + 1) for ch, to in node.items() if ch and SHOWN[ch]]
            for step in steps:
                if self._keep(states, *step):
                    stack.append(step)


def own_form(text: str) -> bool:
    """Whether a spelling is its own table form."""
    return text.isprintable() and text == text.strip(" ") if text.isascii() else text == composed(text)


def classes(spellings: list[str]) -> list[list[int]]:
    """The places of the spellings of one bucket that look the same as another, class by class."""
    walkers = [i for i, t in enumerate(spellings) if not own_form(t)]
    if not walkers or len(spellings) < 2:
        return []
    trie = Trie()
    for i, t in enumerate(spellings):
        trie.add(t, i)
    out, met = [], set()
    for i in walkers:
        if i not in met:
            like = trie.near(spellings[i])
            met.update(like)
            if len(like) > 1:
                out.append(like)
    return out


def canonical(spellings: list[tuple[str, int]]) -> list[str]:
    """The canonical spelling of each spelling (text, rows) of one bucket.

    Of a class a spelling that is its own table form is preferred, then the most frequent, then the least.
    """
    out: list[str | None] = [None] * len(spellings)
    for like in classes([t for t, _ in spellings]):
        pick = min(like, key=lambda j: (not own_form(spellings[j][0]), -spellings[j][1], spellings[j][0]))
        for j in like:
            out[j] = spellings[pick][0]
    return [composed(t) if o is None else o for (t, _), o in zip(spellings, out)]


_WORDS = T.StructType([T.StructField("_grp", T.StringType()), T.StructField("_txt", T.StringType()), T.StructField("_n", T.LongType())])
_BUCKETS = T.StructType([*_WORDS.fields, T.StructField("_shape", T.StringType())])
_CANON = T.StructType([T.StructField("_grp", T.StringType()), T.StructField("_txt", T.StringType()), T.StructField("_canon", T.StringType())])
_PAIR = T.StructType([T.StructField("_grp", T.StringType()), T.StructField("_a", T.StringType()), T.StructField("_b", T.StringType())])


def _shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(_shape=[bucket(t) for t in b["_txt"]])


def _by_bucket(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, list[tuple[str, int]]]]:
    """Group and spellings of each bucket; rows come sorted by both, so one is held at a time."""
    key, held = None, []
    for b in batches:
        for g, t, n, s in zip(b["_grp"].tolist(), b["_txt"].tolist(), b["_n"].tolist(), b["_shape"].tolist()):
            if (g, s) != key:
                if held:
                    yield key[0], held
                key, held = (g, s), []
            held.append((t, n))
    if held:
        yield key[0], held


def _framed(rows: Iterator[tuple], schema: T.StructType) -> Iterator[pd.DataFrame]:
    done: list[tuple] = []
    for r in rows:
        done.append(r)
        if len(done) >= 20_000:
            yield pd.DataFrame(done, columns=schema.names)
            done = []
    yield pd.DataFrame(done, columns=schema.names)


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    return _framed(((g, t, c) for g, held in _by_bucket(batches) for (t, _), c in zip(held, canonical(held))), _CANON)


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows() -> Iterator[tuple]:
        for g, held in _by_bucket(batches):
            texts = [t for t, _ in held]
            for like in classes(texts):
                for k, i in enumerate(like):
                    for j in like[k + 1 :]:
                        yield g, texts[i], texts[j]

    return _framed(rows(), _PAIR)


def _vocabulary(df: DataFrame, text: Column | str, group: Column | str | None) -> DataFrame:
    """The distinct spellings of each group, bucket by bucket.

    The vocabulary is grouped before it is shuffled, so a text that makes up a third of all rows is one row here.
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    grp = F.lit("") if group is None else as_col(group).cast("string")
    words = df.select(grp.alias("_grp"), as_col(text).alias("_txt")).dropna().groupBy("_grp", "_txt").agg(F.count(F.lit(1)).alias("_n"))
    return words.mapInPandas(_shapes, _BUCKETS).repartition("_grp", "_shape").sortWithinPartitions("_grp", "_shape")


def canonical_spellings(df: DataFrame, text: Column | str, group: Column | str | None = None) -> DataFrame:
    """``_grp``, ``_txt``, ``_canon``: the canonical spelling of each distinct spelling within its group.

    Null texts and null groups are left out; without a group all texts are compared with each other. An
    empty text looks like any text of which nothing shows.
    """
    return _vocabulary(df, text, group).mapInPandas(_walk, _CANON)


def lookalike_pairs(df: DataFrame, record: str, text: str, group: Column | str | None = None) -> DataFrame:
    """Pairs of records of one group whose texts differ in code points but look the same.

    Returns ``id_a`` < ``id_b``. Records with a null id, text or group take part in no pair; repeated
    rows count once. Spellings are paired first and records joined to them, so a spelling many records
    share never meets itself; the pairs of records are the result asked for, so spellings with many
    records give many. :func:`canonical_spellings` is the compact form.
    """
    pairs = Scratch(df.sparkSession).save(_vocabulary(df, text, group).mapInPandas(_pairs, _PAIR))
    grp = F.lit("") if group is None else (F.col(group) if isinstance(group, str) else group).cast("string")
    rec = df.select(grp.alias("_g"), F.col(text).alias("_t"), F.col(record).cast("bigint").alias("_id")).dropna()
    ends = pairs.select(F.col("_grp").alias("_pg"), F.explode(F.array("_a", "_b")).alias("_pt")).distinct()
    rec = rec.join(ends, (F.col("_g") == F.col("_pg")) & (F.col("_t") == F.col("_pt")), "left_semi").distinct()
    other = rec.select(F.col("_g").alias("_g2"), F.col("_t").alias("_t2"), F.col("_id").alias("_id2"))
    one = pairs.join(rec, (F.col("_grp") == F.col("_g")) & (F.col("_a") == F.col("_t"))).select("_grp", "_b", "_id")
    both = one.join(other, (F.col("_grp") == F.col("_g2")) & (F.col("_b") == F.col("_t2")) & (F.col("_id") != F.col("_id2")))
    return both.select(F.least("_id", "_id2").alias("id_a"), F.greatest("_id", "_id2").alias("id_b")).distinct()
