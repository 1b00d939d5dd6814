"""Problem 8: held-out passages inside a corpus, by q-gram lemma filtering.

Both sides are brought to one string of lower-case words. Every character q-gram of a text that an item
also holds is a hit on the diagonal (text position - item position). Hits are counted in overlapping
bands of diagonals: a passage of w characters copied with at most e edits leaves at least
``w + 1 - q * (e + 1)`` hits in one band, so bands with fewer are dropped without loss. What is left is
verified by a banded alignment, and an exact check of whole words may follow.

Memory is bounded whatever the texts and items hold. Stretches of text with too few known q-grams for
any item are dropped first; the rest is looked up in tiles of text and item positions that overlap by a
passage and hold at most :data:`HITS_AT_ONCE` hits, so frequent q-grams never meet all at once; bands
are aligned in pieces of :data:`PIECE` item characters. The items are read in blocks of
:data:`BLOCK_CHARS` characters, each one more scan of the texts. Texts are never shuffled and read whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Q = 8
#: Edits a copied passage may have and still be kept for verification.
EDITS = 2
#: Greatest total length of the items, in characters; a longer list is refused, not cut.
MOST_ITEM_CHARS = 20_000_000
#: Item characters indexed at once in a task; a longer item is a block of its own.
BLOCK_CHARS = 2_000_000
#: Hits held at once.
HITS_AT_ONCE = 1 << 19
#: Slots in which hits of bands are counted before they are sorted.
SLOTS = 1 << 20
#: Cells of the bands aligned side by side, and item characters a piece of a band has.
CELLS_AT_ONCE = 1 << 20
PIECE = 1024
#: Characters of text looked up at once.
SLICE_CHARS = 1 << 19

_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_GAP = regex.compile(r"\s(?!\p{M})")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.int64((1 << 32) - 1)
RESULT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("share", T.DoubleType())])


def normal_words(text: str) -> list[str]:
    """Words of a text: runs of letters and digits, whatever their case and composition."""
    return _WORD.findall(unicodedata.normalize("NFC", text).casefold())


def slices(text: str, over: int, size: int = SLICE_CHARS) -> Iterator[list[str]]:
    """The words of a text in slices of about ``size`` characters cut at blanks, each led by the last ``over`` words before it."""
    at, held = 0, []
    while True:
        m = _GAP.search(text, at + size) if at + size < len(text) else None
        end = m.end() if m else len(text)
        words = held + normal_words(text[at:end])
        yield words
        if end >= len(text):
            return
        at, held = end, words[-over:] if over else []


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray) -> np.ndarray:
    """Hashes of all q-grams, by position."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(Q):
        h ^= codes[k : k + n]
        h *= _MIX
        h ^= h >> np.uint64(29)
    return h


def _runs(ids: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` word numbers, by position."""
    h = np.zeros(max(len(ids) - n + 1, 0), np.uint64)
    for k in range(n if len(h) else 0):
        h = (h ^ ids[k : k + len(h)].astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(31)
    return h


class Items:
    """The q-gram index of a block of held-out items."""

    def __init__(self, items: list[tuple[int, str]], min_words: int, edits: int = EDITS):
        self.min_words, self.edits = min_words, edits
        self.ids: list[int] = []
        spelled, width = [], []
        for item, text in items:
            words = normal_words(text)
            if len(words) < min_words:
                continue
            ends = np.cumsum([0, *(len(w) + 1 for w in words)])
            width.append(int((ends[min_words:] - ends[:-min_words]).min()) + 1)
            spelled.append(" " + " ".join(words) + " \0")
            self.ids.append(item)
        self.width = np.array(width, np.int64)
        #: Hits a band must have, per item, and the text a passage of any item takes up at most.
        self.need = np.maximum(1, self.width + 1 - Q * (edits + 1))
        self.span = int(self.width.max(initial=0)) + edits + Q
        self.first = np.cumsum([0, *map(len, spelled)])[:-1].astype(np.int64)
        self.codes = _codes("".join(spelled))
        self.last = np.append(self.first[1:], len(self.codes)) - 1  # where an item ends
        h = _grams(self.codes)
        ok = np.ones(len(h), bool)
        for e in self.last:
            ok[max(0, e - Q + 1) : e + 1] = False
        at = np.flatnonzero(ok)
        h = h[at]
        order = np.argsort(h, kind="stable")
        h, at = h[order], at[order]
        new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
        self.gram = h[new]
        #: Number of the q-gram and position in ``codes``, sorted.
        self.key = ((np.cumsum(new) - 1) << 32) | at
        # A direct-address filter in front of the binary search: most q-grams of a text are in no item.
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.gram >> np.uint64(44)).astype(np.int64)] = True

    def words(self, item: int) -> list[str]:
        s = self.codes[self.first[item] : self.last[item]]
        return s.tobytes().decode("utf-32-le", "surrogatepass").split()

    def regions(self, codes: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
        """Bands with enough shared q-grams, as rows (part, item, first diagonal, first and last text position hit).

        ``codes`` are parts of texts one after another, beginning at ``starts``; no q-gram reaches across a
        part's end, which is a character no item has.
        """
        h = _grams(codes)
        if not len(h) or not len(self.gram):
            return
        at = np.flatnonzero(self.bits[(h >> np.uint64(44)).astype(np.int64)])
        g = np.searchsorted(self.gram, h[at])
        known = self.gram[np.minimum(g, len(self.gram) - 1)] == h[at]
        at, g = at[known], g[known]
        # A passage has its hits at as many places within its span; what has fewer around it is in no passage.
        least, n = int(self.need.min()), len(at)
        if n < least:
            return
        full = np.flatnonzero(at[least - 1 :] - at[: n - least + 1] < self.span)
        if not len(full):
            return
        cover = np.zeros(n + 1, np.int64)
        cover[full] += 1
        np.add.at(cover, np.searchsorted(at, at[full] + self.span), -1)
        keep = np.cumsum(cover[:-1]) > 0
        yield from self._tiles(at[keep], g[keep], 0, len(self.codes), starts)

    def _tiles(self, at: np.ndarray, g: np.ndarray, low: int, high: int, starts: np.ndarray) -> Iterator[np.ndarray]:
        """Bands of the text positions ``at`` against the item positions from ``low`` to ``high``, tile by tile."""
        waiting = [(at, g, low, high)]
        while waiting:
            at, g, low, high = waiting.pop()
            lo = np.searchsorted(self.key, (g << 32) | low)
            n = np.searchsorted(self.key, (g << 32) | high) - lo
            some = n > 0
            at, g, lo, n = at[some], g[some], lo[some], n[some]
            if not len(at):
                continue
            text_wide, item_wide = int(at[-1] - at[0]), high - low
            if n.sum() <= HITS_AT_ONCE or max(text_wide, item_wide) <= 4 * self.span:
                yield self._bands(at, lo, n, starts)
            elif text_wide >= item_wide or item_wide <= 4 * self.span:
                mid = (int(at[0]) + int(at[-1])) // 2
                left, right = np.searchsorted(at, mid + self.span), np.searchsorted(at, mid)
                waiting += [(at[right:], g[right:], low, high), (at[:left], g[:left], low, high)]
            else:
                mid = (low + high) // 2
                waiting += [(at, g, mid, high), (at, g, low, min(high, mid + self.span))]

    def _bands(self, at: np.ndarray, lo: np.ndarray, n: np.ndarray, starts: np.ndarray) -> np.ndarray:
        k = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(at, n)
        pos = self.key[k] & _LOW
        item = np.searchsorted(self.first, pos, "right") - 1
        part = np.searchsorted(starts, at, "right") - 1
        diag = (at - starts[part]) - (pos - self.first[item])
        size = 2 * (self.edits + 1)  # a band this wide, every half of it a new one, holds any e edits' drift
        half = size // 2
        shift = (len(self.codes) // half + 2) * half
        # Each diagonal belongs to the band that starts in its half and to the one before.
        owner, band = part * len(self.ids) + item, (diag + shift) // half
        # Counted by a short hash first: a band has at most the hits of its slot, so most are dropped unsorted.
        need, slot = self.need[item], (owner * 40503 + band) & (SLOTS - 1)
        n_slot = np.bincount(slot, minlength=SLOTS)
        n_slot += np.roll(n_slot, -1)
        mine, before = n_slot[slot] >= need, n_slot[slot - 1] >= need
        keys = np.concatenate(((owner[mine] << 28) + band[mine], (owner[before] << 28) + band[before] - 1))
        if not len(keys):
            return np.zeros((0, 5), np.int64)
        order = np.argsort(keys, kind="stable")
        keys, where = keys[order], np.concatenate((at[mine], at[before]))[order]
        begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        count = np.diff(np.append(begin, len(keys)))
        own = keys[begin] >> 28
        good = count >= self.need[own % len(self.ids)]
        if not good.any():
            return np.zeros((0, 5), np.int64)
        own, first = own[good], (keys[begin][good] & ((1 << 28) - 1)) * half - shift
        most, least = np.maximum.reduceat(where, begin)[good], np.minimum.reduceat(where, begin)[good]
        p = own // len(self.ids)
        return np.column_stack((p, own % len(self.ids), first, least - starts[p], most - starts[p]))

    def aligned(self, parts: list[np.ndarray], regions: np.ndarray) -> set[tuple[int, int]]:
        """The (part, item) whose bands hold a local alignment good enough for a passage.

        A match scores 1, an edit -Q. All pieces of bands are aligned side by side, an item character at a time.
        """
        wide = 2 * (self.edits + 1)
        pieces = []
        for p, i, diag, low, high in regions.tolist():
            # In item positions, a passage's length beyond the hits at either end.
            a, z = max(0, low - diag - wide - self.span), min(int(self.last[i] - self.first[i]), high - diag + wide + self.span)
            pieces += [(min(z, b + PIECE) - b, p, i, diag, b) for b in range(a, max(a + 1, z - self.span), PIECE - self.span if PIECE > 2 * self.span else PIECE)]
        if self.span * 2 >= PIECE:  # passages longer than a piece: whole bands
            pieces = [(int(self.last[i] - self.first[i]), p, i, diag, 0) for p, i, diag, _, _ in regions.tolist()]
        pieces.sort()
        out: set[tuple[int, int]] = set()
        at = 0
        while at < len(pieces):
            # As many as fit; the longest is the last.
            take = 1
            while at + take < len(pieces) and (take + 1) * (pieces[at + take][0] + wide) <= CELLS_AT_ONCE:
                take += 1
            some = [x for x in pieces[at : at + take] if (x[1], x[2]) not in out]
            at += take
            if some:
                scores = self._scores(parts, some, wide)
                out |= {(p, i) for (_, p, i, _, _), s in zip(some, scores.tolist()) if s >= int(self.width[i]) - self.edits * (Q + 1)}
        return out

    def _scores(self, parts: list[np.ndarray], pieces: list[tuple[int, int, int, int, int]], wide: int) -> np.ndarray:
        n, rows = len(pieces), max(x[0] for x in pieces)
        item = np.full((n, rows), 0xFFFFFFFE, np.uint32)
        text = np.full((n, rows + wide), 0xFFFFFFFF, np.uint32)
        for k, (length, p, i, diag, b) in enumerate(pieces):
            item[k, :length] = self.codes[self.first[i] + b : self.first[i] + b + length]
            t = diag + b
            lo, hi = max(0, t), min(len(parts[p]), t + length + wide)
            if hi > lo:
                text[k, lo - t : hi - t] = parts[p][lo:hi]
        score = np.zeros((n, wide + 1), np.int32)
        best = np.zeros(n, np.int32)
        slope = (Q * np.arange(wide)).astype(np.int32)
        for j in range(rows):
            hit = text[:, j : j + wide] == item[:, j : j + 1]
            step = score[:, :-1] + np.where(hit, np.int32(1), np.int32(-Q))
            np.maximum(step, score[:, 1:] - Q, out=step)  # a character of the item without a partner
            np.maximum(step, 0, out=step)
            # A character of the text without a partner: carried along the row.
            score[:, :-1] = np.maximum.accumulate(step + slope, axis=1) - slope
            np.maximum(best, score.max(axis=1), out=best)
        return best

    def found(self, texts: list[str], exact: bool) -> list[list[tuple[int, int, float]]]:
        """Per text: (item id, longest run of whole words, share of the item's windows met)."""
        met: dict[tuple[int, int], np.ndarray] = {}
        held: list[tuple[int, list[str], np.ndarray]] = []
        size = 0

        def look() -> None:
            codes = [c for _, _, c in held]
            starts = np.cumsum([0, *map(len, codes)])[:-1]
            likely: set[tuple[int, int]] = set()
            for bands in self.regions(np.concatenate(codes), starts):
                new = [r for r in bands.tolist() if (r[0], r[1]) not in likely]
                if new:
                    likely |= self.aligned(codes, np.array(new, np.int64))
            for part, item in sorted(likely):
                doc, words, _ = held[part]
                m = self._windows(words, item)
                if m.any() or not exact:
                    was = met.get((doc, item))
                    met[doc, item] = m if was is None else was | m

        # An edited passage may have a word more per edit.
        over = self.min_words + self.edits + 1
        for n, t in enumerate(texts):
            for words in slices(t, over):
                codes = _codes(" " + " ".join(words) + " \0")
                if held and size + len(codes) > SLICE_CHARS:
                    look()
                    held.clear()
                    size = 0
                held.append((n, words, codes))
                size += len(codes)
        if held:
            look()
        out: list[list[tuple[int, int, float]]] = [[] for _ in texts]
        for (n, item), m in sorted(met.items()):
            edge = np.flatnonzero(np.diff(np.concatenate(([0], m.astype(np.int8), [0]))))
            run = int((edge[1::2] - edge[::2]).max()) if len(edge) else 0
            out[n].append((self.ids[item], run + self.min_words - 1 if run else 0, float(m.mean())))
        return out

    def _windows(self, words: list[str], item: int) -> np.ndarray:
        """Which runs of ``min_words`` words of an item stand in a text, word by word."""
        mine = self.words(item)
        number = {w: i for i, w in enumerate(dict.fromkeys(mine), 1)}
        a = np.array([number[w] for w in mine], np.int64)
        b = np.array([number.get(w, 0) for w in words], np.int64)
        m = np.zeros(max(len(a) - self.min_words + 1, 0), bool)
        ha, hb = _runs(a, self.min_words), _runs(b, self.min_words)
        if not len(hb):
            return m
        order = np.argsort(hb, kind="stable")
        at = np.minimum(np.searchsorted(hb[order], ha), len(hb) - 1)
        at = order[at]
        for k in np.flatnonzero(hb[at] == ha):
            m[k] = bool((a[k : k + self.min_words] == b[at[k] : at[k] + self.min_words]).all())
        return m


def item_blocks(listed: list[tuple[int, str]], size: int = BLOCK_CHARS) -> list[list[tuple[int, str]]]:
    """The items in blocks of about ``size`` characters."""
    out: list[list[tuple[int, str]]] = []
    room = 0
    for item, text in listed:
        if not out or len(text) > room:
            out.append([])
            room = size
        out[-1].append((item, text))
        room -= len(text)
    return out


def leaks(documents: DataFrame, items: DataFrame, min_words: int = 12, exact: bool = True) -> DataFrame:
    """``doc_id``, ``item_id``, ``n_words``, ``share``: the texts that hold a passage of an item.

    A passage is ``min_words`` consecutive words of the item, word by word if ``exact``, else with up to
    :data:`EDITS` edited characters. ``n_words`` is the longest run met (0 if only an edited one) and
    ``share`` the share of the item's runs of ``min_words`` met. Items with fewer words, null ids and null
    or empty texts give no rows; repeated rows count once; an empty list of items gives no rows.
    """
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size > MOST_ITEM_CHARS:
        raise ValueError(f"the items have {size} characters; at most {MOST_ITEM_CHARS} are sent to every task")
    listed = [(r[0], r[1]) for r in items.where("item_id is not null and text is not null").select("item_id", "text").distinct().orderBy("item_id", "text").collect()]
    docs = documents.selectExpr("cast(doc_id as bigint) as doc_id", "text").where("doc_id is not null and text is not null and text <> ''")

    def scan(block: list[tuple[int, str]]) -> DataFrame:
        sent = documents.sparkSession.sparkContext.broadcast(block)

        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = Items(sent.value, min_words)
            for b in batches:
                rows = [(d, *f) for d, found in zip(b["doc_id"].tolist(), index.found(b["text"].tolist(), exact)) for f in found]
                yield pd.DataFrame(rows, columns=RESULT.names)

        return docs.mapInPandas(look, RESULT)

    hits = reduce(DataFrame.unionByName, [scan(b) for b in item_blocks(listed) or [[]]])
    return hits.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"), F.max("share").alias("share"))
