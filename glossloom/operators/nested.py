"""Problem 6: deeply nested JSON to flat, linked rows by vectorised structural indexing.

A block of texts is treated as one byte array. Bitmaps of quotes (less escaped ones), brackets and
delimiters are built over it, prefix sums give string interiors and nesting depth, and sorting the
structural bytes by text and depth puts each container's members next to each other. Grammar,
member names, values and array positions are then read off by comparing neighbours; no text is walked
byte by byte and depth is limited by nothing but the text. :func:`records` takes JSON of any shape to
linked tables; :func:`tree_rows` reads the trees of this project.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossloom.session import rows_once

#: Bytes of text indexed at once; bounds the memory of the bitmaps. A longer text is a block of its own.
BLOCK_BYTES = 1 << 20

# Kinds of entry of a container, in the order of the transition tables below.
OPEN, CLOSE, COMMA, COLON, KEY, VALUE = range(6)
_IN_OBJECT = np.zeros((6, 6), bool)
for _a, _b in ((OPEN, KEY), (OPEN, CLOSE), (KEY, COLON), (COLON, VALUE), (VALUE, COMMA), (VALUE, CLOSE), (COMMA, KEY)):
    _IN_OBJECT[_a, _b] = True
_IN_ARRAY = np.zeros((6, 6), bool)
for _a, _b in ((OPEN, VALUE), (OPEN, CLOSE), (VALUE, COMMA), (VALUE, CLOSE), (COMMA, VALUE)):
    _IN_ARRAY[_a, _b] = True

_SCALAR = re.compile(rb"(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)\Z")
_CLASS = np.zeros(256, np.uint8)  # 1 structural, 2 blank, 0 the rest
for _c in b"{}[]:,":
    _CLASS[_c] = 1
for _c in b" \t\r\n\0":
    _CLASS[_c] = 2
_ESCAPABLE = np.zeros(256, bool)
_ESCAPABLE[np.frombuffer(b'"\\/bfnrtu', np.uint8)] = True
_HEX = np.zeros(256, bool)
_HEX[np.frombuffer(b"0123456789abcdefABCDEF", np.uint8)] = True

SCHEMA = T.StructType(
    [T.StructField("tree_id", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("node_path", "parent_path", "keyword", "lang", "term")]]
)


class Index:
    """Structural index of a block of JSON texts.

    ``ok`` tells per text whether it is one valid JSON object. Tokens are structural bytes, strings and
    scalars in order: ``start``, ``end`` (exclusive), ``doc``. ``members`` are (object token, name, value
    token) and ``elements`` the values of arrays, sorted by array and position.
    """

    def __init__(self, texts: list[bytes]):
        self.buf = buf = b"\0".join(texts) + b"\0"
        b = np.frombuffer(buf, np.uint8)
        n, n_docs = len(b), len(texts)
        lengths = np.fromiter((len(t) for t in texts), np.int64, n_docs)
        first = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        bad = np.zeros(n_docs, bool)
        doc_of = lambda at: np.searchsorted(first, at, "right") - 1
        # A NUL inside a text would look like the end of one.
        nul = np.flatnonzero(b == 0)
        if len(nul) != n_docs:
            bad[doc_of(np.setdiff1d(nul, first + lengths))] = True

        # Quotes that no odd run of backslashes precedes.
        at = np.arange(n, dtype=np.int64)
        slash = b == 92
        if slash.any():
            plain = np.maximum.accumulate(np.where(slash, -1, at))
            run_before = np.concatenate(([0], at[:-1] - plain[:-1]))  # backslashes just before each byte
            quote = (b == 34) & (run_before % 2 == 0)
            starts = np.flatnonzero(slash & (run_before % 2 == 0))
        else:
            quote, starts = b == 34, np.zeros(0, np.int64)
        total = np.cumsum(quote)
        base = np.concatenate(([0], total))[first]
        per_doc = total[first + lengths] - base
        bad |= per_doc % 2 == 1
        docs = np.repeat(np.arange(n_docs), lengths + 1)
        inside = ((total - base[docs]) % 2 == 1) & ~quote  # strictly between the quotes
        # String contents: no control bytes, only known escapes.
        bad[docs[inside & (b < 32)]] = True
        if len(starts):
            nxt = b[np.minimum(starts + 1, n - 1)]
            wrong = ~inside[starts] | ~_ESCAPABLE[nxt]
            u = starts[nxt == 117]
            for k in range(2, 6):
                miss = ~_HEX[b[np.minimum(u + k, n - 1)]]
                bad[docs[u[miss]]] = True
            bad[docs[starts[wrong]]] = True

        cls = np.where(inside | quote, 3, _CLASS[b])
        bare = cls == 0
        edge = np.diff(np.concatenate(([0], bare.astype(np.int8), [0])))
        s_at, s_end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        q_at = np.flatnonzero(quote & ~bad[docs])
        opening, closing = q_at[0::2], q_at[1::2]
        p_at = np.flatnonzero(cls == 1)
        start = np.concatenate((p_at, opening, s_at))
        end = np.concatenate((p_at + 1, closing + 1, s_end))
        order = np.argsort(start, kind="stable")
        start, end = start[order], end[order]
        keep = ~bad[docs[start]]
        start, end = start[keep], end[keep]
        byte, doc = b[start], docs[start]
        is_open = (byte == 123) | (byte == 91)
        is_close = (byte == 125) | (byte == 93)
        is_string = byte == 34
        is_scalar = _CLASS[byte] == 0
        is_scalar &= ~is_string
        cache: dict[bytes, bool] = {}
        for i in np.flatnonzero(is_scalar):
            v = buf[start[i] : end[i]]
            if v not in cache:
                cache[v] = bool(_SCALAR.match(v))
            if not cache[v]:
                bad[doc[i]] = True

        # Depth by prefix sums, restarted at each text.
        step = is_open.astype(np.int64) - is_close
        depth = np.cumsum(step)  # after the token
        t_first = np.searchsorted(doc, np.arange(n_docs), "left")
        before = np.concatenate(([0], depth))[t_first]
        depth = depth - before[doc] if len(doc) else depth
        outer = depth - step  # before the token
        bad[doc[depth < 0]] = True
        n_tok = np.bincount(doc, minlength=n_docs)
        bad |= n_tok == 0
        t_last = np.minimum(t_first + n_tok - 1, max(len(doc) - 1, 0))
        if len(doc):
            bad |= (depth[t_last] != 0) | (byte[np.minimum(t_first, len(doc) - 1)] != 123)
            bad[doc[(outer == 0) & (np.arange(len(doc)) != t_first[doc])]] = True  # a second value at the top

        # Entries of each container: openers and closers at their inner level, all values at the outer one.
        n_t = len(start)
        tok = np.arange(n_t)
        inner = tok[is_open]
        outside = tok[~is_close]
        e_tok = np.concatenate((inner, outside, tok[is_close]))
        e_lvl = np.concatenate((depth[inner], outer[outside], outer[is_close]))
        kind_of = np.full(n_t, VALUE)
        kind_of[byte == 44] = COMMA
        kind_of[byte == 58] = COLON
        e_kind = np.concatenate((np.full(len(inner), OPEN), kind_of[outside], np.full(is_close.sum(), CLOSE)))
        top = (e_lvl == 0) | bad[doc[e_tok]]
        e_tok, e_lvl, e_kind = e_tok[~top], e_lvl[~top], e_kind[~top]
        order = np.lexsort((e_tok, e_lvl, doc[e_tok]))
        e_tok, e_kind = e_tok[order], e_kind[order]
        m = len(e_tok)
        if m:
            box = e_tok[np.maximum.accumulate(np.where(e_kind == OPEN, np.arange(m), 0))]
            in_object = byte[box] == 123
            prev = np.concatenate(([CLOSE], e_kind[:-1]))
            key = in_object & (e_kind == VALUE) & is_string[e_tok] & ((prev == OPEN) | (prev == COMMA))
            e_kind = np.where(key, KEY, e_kind)
            prev = np.concatenate(([CLOSE], e_kind[:-1]))
            fits = np.where(in_object, _IN_OBJECT[prev, e_kind], _IN_ARRAY[prev, e_kind])
            fits = np.where(e_kind == OPEN, prev == CLOSE, fits)
            closes = e_kind == CLOSE
            fits &= ~closes | (byte[e_tok] == byte[box] + 2)
            bad[doc[e_tok[~fits]]] = True
            k = np.flatnonzero(key & ~bad[doc[e_tok]])
            self.member_box, self.member_key, self.member_value = box[k], e_tok[k], e_tok[k + 2]
            v = np.flatnonzero(~in_object & (e_kind == VALUE) & ~bad[doc[e_tok]])
            self.element_box, self.element = box[v], e_tok[v]
        else:
            self.member_box = self.member_key = self.member_value = self.element_box = self.element = np.zeros(0, np.int64)
        self.start, self.end, self.byte, self.doc, self.ok = start, end, byte, doc, ~bad
        self.root = t_first
        counts = np.bincount(self.element_box, minlength=n_t)
        self.size = counts
        by_box = np.argsort(self.element_box, kind="stable")
        self.element = self.element[by_box]
        self.offset = np.concatenate(([0], np.cumsum(counts)))[:-1] if n_t else counts

    def text(self, token: int) -> str | None:
        """The value of a string or scalar token; None for null and for containers."""
        raw = self.buf[self.start[token] : self.end[token]]
        if raw[:1] == b'"':
            if b"\\" not in raw:
                return raw[1:-1].decode("utf-8", "replace")
            return json.loads(raw.decode("utf-8", "replace")).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        return None if raw in (b"null", b"{", b"[") else raw.decode()

    def expand(self, arrays: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each array token: (which of ``arrays``, position, element token), in order."""
        n = self.size[arrays]
        which = np.repeat(np.arange(len(arrays)), n)
        pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return which, pos, self.element[np.repeat(self.offset[arrays], n) + pos]


def _names(ix: Index) -> dict[str, np.ndarray]:
    """The members used here, looked up in one pass over the names."""
    wanted = {json.dumps(n).encode(): n for n in ("children", "keyword", "terms", "lang", "term", "alt")}
    out = {n: np.full(len(ix.start), -1, np.int64) for n in wanted.values()}
    buf, start, end = ix.buf, ix.start, ix.end
    boxes, keys, values = ix.member_box.tolist(), ix.member_key, ix.member_value.tolist()
    for box, s, e, k, v in zip(boxes, start[keys].tolist(), end[keys].tolist(), keys.tolist(), values):
        raw = buf[s:e]
        name = wanted.get(raw)
        if name is None and b"\\" in raw and ix.text(k) in out:
            name = ix.text(k)
        if name is not None:
            out[name][box] = v
    return out


def flatten(ids: list[int], texts: list[bytes]) -> dict[str, list]:
    """Rows of :data:`SCHEMA` for a block of texts."""
    ix = Index(texts)
    rows: dict[str, list] = {c: [] for c in SCHEMA.names}
    if not len(ix.start):
        return rows
    m = _names(ix)
    good = np.flatnonzero(ix.ok)
    nodes, paths = ix.root[good], [""] * len(good)

    def arrays(of: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
        v = m[name][of]
        keep = np.flatnonzero((v >= 0) & (ix.byte[v] == 91))
        return keep, v[keep]

    def said(token: int) -> str:
        return "" if token < 0 else ix.text(token) or ""

    while len(nodes):
        keep, arr = arrays(nodes, "children")
        which, r, rel = ix.expand(arr)
        owner = keep[which]
        obj = ix.byte[rel] == 123
        owner, r, rel = owner[obj], r[obj], rel[obj]
        has, arr = arrays(rel, "terms")
        which, t, term = ix.expand(arr)
        owner, r, rel = owner[has][which], r[has][which], rel[has][which]
        new = []
        keywords = {k: said(m["keyword"][k]) for k in np.unique(rel)}
        for o, a, k, c, e, d, is_obj in zip(owner.tolist(), r.tolist(), rel.tolist(), t.tolist(), term.tolist(), ix.doc[term].tolist(), (ix.byte[term] == 123).tolist()):
            up = paths[o]
            here = f"{up}/{a}.{c}" if up else f"{a}.{c}"
            rows["tree_id"].append(ids[d])
            rows["node_path"].append(here)
            rows["parent_path"].append(up)
            rows["keyword"].append(keywords[k])
            rows["lang"].append(said(m["lang"][e]) if is_obj else "")
            rows["term"].append((said(m["term"][e]) or said(m["alt"][e])) if is_obj else "")
            new.append(here)
        nodes, paths = term, new
        sub = np.flatnonzero(ix.byte[nodes] == 123)
        nodes, paths = nodes[sub], [paths[i] for i in sub]
    return rows


def _texts(df: DataFrame, record_id: str, text: str) -> DataFrame:
    return df.selectExpr(f"cast(`{record_id}` as bigint) as tree_id", f"`{text}` as tree_json").where("tree_id is not null and tree_json is not null")


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Ids and texts in blocks of about :data:`BLOCK_BYTES`."""
    for pdf in batches:
        ids: list[int] = []
        texts: list[bytes] = []
        size = 0
        for i, s in zip(pdf["tree_id"].tolist(), pdf["tree_json"].tolist()):
            raw = s.encode("utf-8", "surrogatepass")
            if texts and size + len(raw) > BLOCK_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(raw)
            size += len(raw)
        if texts:
            yield ids, texts


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for ids, texts in _packed(batches):
        rows = flatten(ids, texts)
        if rows["tree_id"]:  # a frame without rows has no types
            yield pd.DataFrame(rows, columns=SCHEMA.names)


def tree_rows(trees: DataFrame, tree_id: str = "tree_id", tree_json: str = "tree_json") -> DataFrame:
    """One row per element of any ``terms`` array, linked to its parent by path.

    Returns ``tree_id``, ``node_path``, ``parent_path``, ``keyword``, ``lang``, ``term``. A text that is
    null, empty, unreadable or no JSON object gives no rows, as does a null id; unknown members are
    skipped; of repeated members the last counts; missing and null values and elements that are no
    object give ''. Repeated rows count once; an id with two different texts
    gives the rows of both.
    """
    return rows_once(_texts(trees, tree_id, tree_json), "tree_id").mapInPandas(_blocks, SCHEMA)


# -- records of any shape -----------------------------------------------------------------------

RECORDS = T.StructType(
    [T.StructField("record_id", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("table_name", "node_path", "parent_path")], T.StructField("position", T.IntegerType()), T.StructField("members", T.MapType(T.StringType(), T.StringType()))]
)
#: Member names up to which :func:`related_tables` makes columns of them by itself.
MOST_NAMES = 10_000


def record_rows(ids: list[int], texts: list[bytes]) -> Iterator[tuple]:
    """Rows of :data:`RECORDS` for a block of texts, parents before their children."""
    ix = Index(texts)
    order = np.argsort(ix.member_box, kind="stable")
    box, key, value = ix.member_box[order], ix.member_key[order].tolist(), ix.member_value[order].tolist()
    begin = np.searchsorted(box, np.arange(len(ix.start) + 1)).tolist()
    byte, size, offset, element = ix.byte.tolist(), ix.size.tolist(), ix.offset.tolist(), ix.element.tolist()
    names: dict[bytes, str] = {}
    for d in np.flatnonzero(ix.ok).tolist():
        waiting: list[tuple[int, str, str, str, int | None]] = [(int(ix.root[d]), "", "$", "", None)]
        while waiting:
            at, table, path, up, position = waiting.pop()
            if byte[at] == 91:  # an array in an array
                waiting += [(element[offset[at] + i], table, f"{path}[{i}]", up, i) for i in reversed(range(size[at]))]
                continue
            if byte[at] != 123:  # a value in an array
                yield ids[d], table, path, up, position, {"": ix.text(at)}
                continue
            said: dict[str, int] = {}
            for m in range(begin[at], begin[at + 1]):
                raw = ix.buf[ix.start[key[m]] : ix.end[key[m]]]
                if raw not in names:
                    names[raw] = ix.text(key[m])
                said[names[raw]] = value[m]
            members, below = {}, []
            for name, v in said.items():
                if byte[v] == 123:
                    below.append((v, name, f"{path}.{name}", path, None))
                elif byte[v] == 91:
                    below += [(element[offset[v] + i], name, f"{path}.{name}[{i}]", path, i) for i in range(size[v])]
                else:
                    members[name] = ix.text(v)
            yield ids[d], table, path, up, position, members
            waiting += reversed(below)


def _record_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for ids, texts in _packed(batches):
        rows = list(record_rows(ids, texts))
        for k in range(0, len(rows), 50_000):
            yield pd.DataFrame(rows[k : k + 50_000], columns=RECORDS.names)


def records(df: DataFrame, record_id: str, text: str) -> DataFrame:
    """Every object of JSON texts of any shape as one flat row that keeps the link to its parent.

    Returns ``record_id``, ``table_name`` (the member the object or its array is the value of, '' at the
    top), ``node_path`` (as in ``$.children[0].terms[1]``), ``parent_path``, ``position`` in its array
    (null elsewhere) and ``members``, its plain values by name, as text. A plain value in an array is
    a row with one member ''. Of repeated members the last counts; nulls stay as null values. Texts that
    are null, unreadable or no JSON object give no rows, as does a null id; repeated rows count once.
    """
    return rows_once(_texts(df, record_id, text), "tree_id").mapInPandas(_record_batches, RECORDS)


def related_tables(rows: DataFrame, columns: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """:func:`records` as one flat table per ``table_name`` with a column per member.

    A table's parent rows are those with its ``record_id`` and ``parent_path`` as ``node_path``. Without
    ``columns`` the member names found are used, and refused beyond :data:`MOST_NAMES`; a member named
    like a link column gets an underscore behind it, and one without a name is ``value``.
    """
    if columns is None:
        found = rows.select("table_name", F.explode_outer(F.map_keys("members")).alias("m")).distinct().limit(MOST_NAMES + 1).collect()
        if len(found) > MOST_NAMES:
            raise ValueError(f"more than {MOST_NAMES} members; name the columns")
        columns = {t: sorted(r["m"] for r in found if r["table_name"] == t and r["m"] is not None) for t in sorted({r["table_name"] for r in found})}
    links = ["record_id", "node_path", "parent_path", "position"]
    called = lambda m: f"{m}_" if m in links else m or "value"
    return {t: rows.where(F.col("table_name") == t).select(*links, *[F.try_element_at("members", F.lit(m)).alias(called(m)) for m in names]) for t, names in columns.items()}
