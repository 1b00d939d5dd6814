"""Problem 10: texts over a token limit cut into pieces by structure-tree packing.

A text is a tree: sections under headings, blocks between blank lines, list items with the items below
them and table rows, lines, sentences, words, and last single characters. A node within the limit is
taken whole and not looked into; an oversized one is replaced by its packed children; neighbouring
siblings are merged bottom-up as long as they fit, but the end of an oversized section never with the
section behind it. Each piece but the first starts with the end of the one before.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossloom.llm.tokens import DEFAULT_VOCABULARY, encoding, safe
from glossloom.session import rows_once

LIMIT, OVERLAP = 2048, 128
#: Tokens by which separately encoded pieces may differ from their share of the whole text's tokens.
SLACK = 8
#: Where lines begin and end, whichever of CRLF, LF and CR ends them.
_BOL, _EOL = r"(?:(?<=[\n\r])(?!(?<=\r)\n)|\A)", r"(?=[ \t]*(?:[\r\n]|\Z))"
#: Headings of depth 1 to 6: runs of = around, or of # before, a line.
_HEADING = regex.compile(rf"{_BOL}(?:(={{1,6}})[^\n\r=][^\n\r]*?=+|(#{{1,6}}) [^\n\r]*?){_EOL}")
#: List items by the length of their mark or their indentation, and the beginnings of table rows and of marked-up items.
_ITEM = regex.compile(rf"{_BOL}(?:([*#:;]+)[ \t]*(?=\S)|([ \t]*)(?:[-+•]|\d{{1,3}}[.)])[ \t]+(?=\S)|(\|(?!-))|\|-|[ \t]*<(?:li|tr|p|div|h[1-6])\b)", regex.I)
_BREAKS = (
    regex.compile(r"(?>\r\n|\r|\n)(?:[ \t]*(?>\r\n|\r|\n))+"),  # blocks
    regex.compile(r"\r\n|\r|\n"),  # lines
    regex.compile(r"[.!?…。！？]+[\"'”’»)\]]*\s+"),  # sentences
    regex.compile(r"\s+"),  # words
)
_AFTER_HEADING = regex.compile(r"[ \t]*(?>\r\n|\r|\n)(?:[ \t]*(?>\r\n|\r|\n))*+")
#: Levels of the tree: six of sections, blocks, three of items, lines, sentences, words, characters.
BLOCKS, ITEMS, LINES = 6, 7, 10
WORDS = LINES + len(_BREAKS) - 1

RESULT = T.StructType(
    [T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.IntegerType()) for c in ("piece_no", "start_char", "end_char", "overlap_start", "n_tokens")], T.StructField("text", T.StringType())]
)


class Text:
    """One text with its token boundaries."""

    def __init__(self, text: str, enc):
        self.text, self.enc = text, enc
        tokens = enc.encode_ordinary(safe(text))
        self.n_tokens = len(tokens)
        self.headings = [(m.start(), len(m.group(1) or m.group(2))) for m in _HEADING.finditer(text)] if self.n_tokens else []
        at_heading = {s for s, _ in self.headings}
        #: The first and the last place behind each heading's line and the blank lines after it: none is a place to cut.
        self.behind = [m.span() for h in _HEADING.finditer(text) if (m := _AFTER_HEADING.match(text, h.end()))] if self.headings else []
        depth = lambda m: len(m[1]) if m[1] else 1 + len(m[2].expandtabs(4)) // 2 if m[2] else 2 if m[3] else 1
        self.items = [(m.start(), depth(m)) for m in _ITEM.finditer(text) if m.start() not in at_heading]
        # Characters at which tokens start: byte offsets of tokens against those of characters.
        at, self.starts = 0, []
        char, byte = 0, 0
        widths = [len(b) for b in enc.decode_tokens_bytes(tokens)] if tokens else []
        clean = safe(text)
        for w in widths:
            while byte < at:
                o = ord(clean[char])
                byte += 1 if o < 0x80 else 2 if o < 0x800 else 3 if o < 0x10000 else 4
                char += 1
            self.starts.append(char)
            at += w

    def size(self, a: int, b: int) -> int:
        """Tokens that start within a span."""
        return bisect.bisect_left(self.starts, b) - bisect.bisect_left(self.starts, a)

    def exact(self, a: int, b: int) -> int:
        return len(self.enc.encode_ordinary(safe(self.text[a:b])))

    def _behind_heading(self, at: int) -> bool:
        i = bisect.bisect_left(self.behind, (at, 0)) - 1
        return i >= 0 and self.behind[i][0] < at <= self.behind[i][1]

    def children(self, a: int, b: int, level: int) -> list[tuple[int, int]]:
        """The parts of a node on the next level; the node itself if it has none there."""
        within = lambda marks: marks[bisect.bisect_left(marks, (a + 1, 0)) : bisect.bisect_left(marks, (b, 0))]
        if level < BLOCKS:
            cuts = [s for s, depth in within(self.headings) if depth <= level + 1]
        elif ITEMS <= level < LINES:
            cuts = [s for s, depth in within(self.items) if depth <= level - ITEMS + 1]
        elif level < WORDS:
            cuts = [m.end() for m in _BREAKS[0 if level == BLOCKS else level - LINES + 1].finditer(self.text, a, b) if m.end() < b and not (level <= LINES and self._behind_heading(m.end()))]
        else:
            at = bisect.bisect_left(self.starts, a + 1)
            cuts = sorted({c for c in self.starts[at : bisect.bisect_left(self.starts, b)] if a < c < b})
        edges = [a, *cuts, b]
        return list(zip(edges, edges[1:]))

    def pack(self, limit: int, span: tuple[int, int] | None = None) -> list[tuple[int, int]]:
        """Spans within the limit that make up the text, or a span of it, in order."""
        # Without recursion: nodes waiting for their parts to be packed stand on the stack. A packed
        # part is (start, end, whether it is a whole node).
        done: list[list[tuple[int, int, bool]]] = [[]]
        stack: list[tuple[int, int, int]] = [(*(span or (0, len(self.text))), 0)]
        while stack:
            a, b, level = stack.pop()
            if level < 0:  # all parts of a node are packed: merge them
                parts = done.pop()
                done[-1] += self._merged(parts, limit, -level <= BLOCKS)
            elif self.size(a, b) <= limit or b - a <= 1 or level > WORDS:
                done[-1].append((a, b, True))
            else:
                parts = self.children(a, b, level)
                if len(parts) == 1:
                    stack.append((a, b, level + 1))
                else:
                    done.append([])
                    stack.append((a, b, -level - 1))
                    stack += [(x, y, level + 1) for x, y in reversed(parts)]
        return [(a, b) for a, b, _ in done[0]]

    def _merged(self, parts: list[tuple[int, int, bool]], limit: int, sections: bool) -> list[tuple[int, int, bool]]:
        """Neighbouring parts joined while they fit; of sections only whole ones, so none is joined to a piece of another."""
        out: list[tuple[int, int, bool]] = []
        for a, b, whole in parts:
            if out and (not sections or whole and out[-1][2]) and self.size(out[-1][0], b) <= limit:
                out[-1] = (out[-1][0], b, whole and out[-1][2])
            else:
                out.append((a, b, whole))
        # To the level above all these are pieces of one oversized node.
        return [(a, b, False) for a, b, _ in out]

    def overlap_from(self, a: int, overlap: int, floor: int) -> int:
        """Where the overlap before a piece begins: at a word, at most ``overlap`` tokens back."""
        at = bisect.bisect_left(self.starts, a)
        first = max(self.starts[max(0, at - overlap)] if self.starts else 0, floor)
        if overlap <= 0 or first >= a:
            return a
        m = _BREAKS[-1].search(self.text, max(first - 1, 0), a)
        return m.end() if m and m.end() < a else first

    def pieces(self, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
        """(start, end, overlap start, tokens) of each piece; one whole piece if the text is within the limit."""
        if self.n_tokens <= limit:
            return [(0, len(self.text), 0, self.n_tokens)]
        room = max(1, limit - overlap - SLACK)
        out: list[tuple[int, int, int, int]] = []
        waiting = [(a, b, room) for a, b in reversed(self.pack(room))]
        while waiting:
            a, b, room = waiting.pop()
            back = overlap if out else 0
            o = self.overlap_from(a, back, out[-1][0]) if back else a
            n = self.exact(o, b)
            if n > limit and self.exact(a, b) > limit and b - a > 1:
                # Encoded on its own it is longer than its share of the text: packed again to less.
                less = max(1, room * 3 // 4)
                parts = self.pack(less, (a, b))
                if len(parts) == 1:
                    parts = [(a, (a + b) // 2), ((a + b) // 2, b)]
                waiting += [(x, y, less) for x, y in reversed(parts)]
                continue
            while n > limit and back:  # only the overlap is too long: as much of it as fits
                back -= max(1, min(back, n - limit))
                o = self.overlap_from(a, back, out[-1][0]) if back else a
                n = self.exact(o, b)
            out.append((a, b, o, n))
        return out


def pieces(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``doc_id``, ``piece_no`` (from 0), ``start_char``, ``end_char``, ``overlap_start``, ``n_tokens``, ``text``.

    ``text`` runs from ``overlap_start`` to ``end_char`` and has at most ``limit`` tokens; the spans from
    ``start_char`` to ``end_char`` make up the whole text in order. The overlap begins at a word and has at
    most ``overlap`` tokens; it is shorter only where the piece would pass the limit. Texts within the
    limit are one piece. Null ids and null texts give no rows, an empty text one empty piece; repeated rows count once.
    """
    if not 0 <= overlap <= limit // 2 - SLACK:
        raise ValueError("the overlap must be below half the limit")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(vocabulary)
        for b in batches:
            rows: list[tuple] = []
            size = 0
            for d, t in zip(b["doc_id"].tolist(), b["text"].tolist()):
                # A token is at least a byte, so a text with no more bytes than the limit is within it.
                if len(t) <= limit and len(t.encode("utf-8", "replace")) <= limit:
                    spans = [(0, len(t), 0, len(enc.encode_ordinary(safe(t))))]
                else:
                    spans = Text(t, enc).pieces(limit, overlap)
                for i, (a, z, o, n) in enumerate(spans):
                    rows.append((d, i, a, z, o, n, t[o:z]))
                    size += z - o
                if size > 1 << 23:
                    yield pd.DataFrame(rows, columns=RESULT.names)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=RESULT.names)

    docs = documents.selectExpr("cast(doc_id as bigint) as doc_id", "text").where("doc_id is not null and text is not null")
    return rows_once(docs, "doc_id").mapInPandas(cut, RESULT)


def oversized(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``doc_id`` of the texts :func:`pieces` cuts; texts with no more bytes than the limit can't be among them and are not read further."""
    docs = documents.select("doc_id", "text").where(F.octet_length("text") > limit)
    return pieces(docs, limit, overlap, vocabulary).where("piece_no = 1").select("doc_id").distinct()
