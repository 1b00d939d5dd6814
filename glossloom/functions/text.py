"""Column functions on terms, templates and glosses."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Shorthand language codes written with a full stop.
SHORTHAND = {"EL.": "la-ecc", "LL.": "la-lat", "ML.": "la-med", "NL.": "la-new", "VL.": "la-vul"}
# Codes that were renamed; they are tried before the shorthand.
RENAMED = {"sa-cls": "cls", "sa-ved": "vsn", "roa-oan": "roa-ona", "grc-epc": "grc-epi", "khn": "ahr", "uun": "pzh"}
MACRON_BREVE = "̄̆"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_markers(x: Column | str) -> Column:
    """Without private-use markers of plane 15."""
    return F.regexp_replace(_c(x), r"[\x{F0000}-\x{FFFFD}]", "")


def strip_star(x: Column | str) -> Column:
    """Without one leading asterisk, the mark of a reconstructed form."""
    return F.regexp_replace(_c(x), r"^\*", "")


def is_starred(x: Column | str) -> Column:
    return _c(x).startswith("*")


def strip_inline(x: Column | str) -> Column:
    """The text before the first inline annotation."""
    return F.trim(F.substring_index(_c(x), "<", 1))


def inline_id(x: Column | str) -> Column:
    """The text of the first ``<id:...>``; null if empty or absent."""
    return F.nullif(F.trim(F.regexp_extract(_c(x), r"<id:([^<>]*)>", 1)), F.lit(""))


def has_term(x: Column | str) -> Column:
    """Whether a slot names a term: not null, not blank, not a lone dash."""
    return F.coalesce((F.trim(_c(x)) != "") & (_c(x) != "-"), F.lit(False))


def lang_prefix(x: Column | str) -> Column:
    """The language before a colon, or null if what stands there is no code."""
    head = F.substring_index(_c(x), ":", 1)
    ok = head.isin(*SHORTHAND) | head.rlike(r"^[a-z][a-z0-9]+(-[A-Za-z0-9]+)*$")
    return F.when(_c(x).contains(":") & ok, head)


def without_lang_prefix(x: Column | str) -> Column:
    return F.when(lang_prefix(x).isNotNull(), F.substring(_c(x), F.locate(":", _c(x)) + 1, F.length(_c(x)))).otherwise(_c(x))


def lang_and_term(x: Column | str) -> Column:
    """Struct of ``lang`` (or null) and ``term``; a term missing before its annotations falls back to ``<alt:...>``."""
    plain = strip_inline(x)
    term = F.trim(without_lang_prefix(plain))
    alt = F.trim(F.regexp_extract(_c(x), r"<alt:([^<>]*)>", 1))
    return F.struct(lang_prefix(plain).alias("lang"), F.when(term == "", alt).otherwise(term).alias("term"))


def lang_codes(x: Column | str) -> Column:
    """The codes of a comma list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(_c(x), ","), lambda v: F.trim(v)), lambda v: v != "")


def alternants(x: Column | str) -> Column:
    """The terms of a slot that lists alternatives with ``//``."""
    return F.filter(F.transform(F.split(strip_inline(x), "//"), lambda v: F.trim(v)), has_term)


def affix_dash(x: Column | str, side: Column | str) -> Column:
    """A piece with the dash its side calls for: ``leading``, ``trailing``, ``both`` or null."""
    t, s = _c(x), _c(side)
    t = F.when(s.isin("leading", "both") & ~t.startswith("-"), F.concat(F.lit("-"), t)).otherwise(t)
    return F.when(s.isin("trailing", "both") & ~t.endswith("-"), F.concat(t, F.lit("-"))).otherwise(t)


def trim_labels(x: Column | str, labels: list[str]) -> Column:
    """Without trailing grammatical labels such as gender, joined by "or" and perhaps followed by "by sense"."""
    one = "|".join(labels)
    return F.regexp_replace(_c(x), rf"(?: (?:{one}))+(?: or(?: (?:{one}))+)*(?: by sense)?$", "")


def section_of(x: Column | str) -> Column:
    """The section a numbered etymology has; 0 unless it is ASCII digits of at most 32767."""
    n = F.when(_c(x).rlike(r"^[0-9]+$"), _c(x)).try_cast("int")
    return F.coalesce(F.when(n <= 32767, n), F.lit(0)).cast("smallint")


def first_gloss(senses: Column | str) -> Column:
    """The first gloss of the first sense that has one."""
    return F.get(F.filter(F.transform(_c(senses), lambda s: F.get(s["glosses"], F.lit(0))), lambda g: g.isNotNull()), F.lit(0))


def anchor_index(x: Column | str) -> Column:
    """The number in ``etymology_templates:<i>:<name>``; templates are ordered by it as a number."""
    return F.split_part(_c(x), F.lit(":"), F.lit(2)).try_cast("int")


def anchor_name(x: Column | str) -> Column:
    return F.split_part(_c(x), F.lit(":"), F.lit(3))


def search_rank(query: str, code: Column | str, name: Column | str) -> Column:
    """Rank of a language for a search text: exact code, code prefix, part of the name; null for no match."""
    q = query.strip().lower()
    if not q:
        return F.lit(None).cast("int")
    code, name = F.lower(_c(code)), F.lower(_c(name))
    return F.when(code == q, 0).when(code.startswith(q), 1).when(name.contains(q), 2)


def display_headword(headword: Column | str, reconstructed: Column | str) -> Column:
    return F.when(_c(reconstructed), F.concat(F.lit("*"), _c(headword))).otherwise(_c(headword))


def entry_url(lang_name: Column | str, headword: Column | str, reconstructed: Column | str) -> Column:
    """Path of a term's dictionary page, spaces as underscores, the rest percent-encoded."""
    enc = lambda c: F.regexp_replace(F.url_encode(F.replace(c, F.lit(" "), F.lit("_"))), r"%2F", "/")
    lang = enc(_c(lang_name))
    page = F.when(_c(reconstructed), F.concat(F.lit("Reconstruction:"), lang, F.lit("/"), enc(_c(headword)))).otherwise(enc(_c(headword)))
    return F.concat(page, F.lit("#"), lang)


def node_label(headword: Column | str, reconstructed: Column | str, lang_name: Column | str) -> Column:
    """A term with its language in brackets, as a node of a tree is labelled."""
    return F.concat(display_headword(headword, reconstructed), F.lit(" ("), _c(lang_name), F.lit(")"))


def tree_url(lang_code: Column | str, headword: Column | str, section: Column | str | None = None) -> Column:
    """Path of a term's tree, percent-encoded, with the section if there is one."""

    def enc(c: Column) -> Column:
        c = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
        for ch in "!'()~":  # these need no encoding
            c = F.replace(c, F.lit(f"%{ord(ch):02X}"), F.lit(ch))
        return c

    path = F.concat(F.lit("/tree/"), enc(_c(lang_code)), F.lit("/"), enc(_c(headword)))
    if section is None:
        return path
    return F.concat(path, F.coalesce(F.concat(F.lit("?etym="), _c(section).cast("string")), F.lit("")))


def rate_limit_key(address: Column | str) -> Column:
    """What requests are counted by: an IPv4 address as it is, of an IPv6 address its first 64 bits."""
    import ipaddress

    def key(t: str | None) -> str | None:
        if t is None or ":" not in t or "." in t:
            return t
        try:
            groups = ipaddress.IPv6Address(t).exploded.split(":")[:4]
        except ValueError:
            return t
        return ":".join(f"{int(g, 16):x}" for g in groups)

    @F.pandas_udf("string")
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(key)

    return keys(_c(address))


def redacted(x: Column | str) -> Column:
    """A connection string or message with the password masked."""
    return F.regexp_replace(F.regexp_replace(_c(x), r"(://[^:/@\s]+:)[^@\s]+@", "$1***@"), r"(?i)(password=)[^\s&]+", "$1***")


def _fold(drop) -> Column:
    @F.pandas_udf("string")
    def fold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if not drop(c)))

    return fold


def length_folded(x: Column | str) -> Column:
    """Decomposed and without macrons and breves only. ASCII never reaches Python."""
    c = _c(x)
    return F.when(c.rlike(r"^[\x00-\x7F]*$"), c).otherwise(_fold(lambda ch: ch in MACRON_BREVE)(F.when(~c.rlike(r"^[\x00-\x7F]*$"), c)))


def accent_folded(x: Column | str) -> Column:
    """Decomposed and without any combining mark."""
    c = _c(x)
    return F.when(c.rlike(r"^[\x00-\x7F]*$"), c).otherwise(_fold(unicodedata.combining)(F.when(~c.rlike(r"^[\x00-\x7F]*$"), c)))


def strip_diacritics(text: Column | str, marks: Column | str, exceptions: Column | str) -> Column:
    """A page title as its language spells it: ``marks`` deleted from the decomposed text except within ``exceptions``."""

    @F.pandas_udf("string")
    def strip(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for t, m, e in batches:
            yield pd.Series([_stripped(a, b, c) for a, b, c in zip(t, m, e)], dtype=object)

    return strip(_c(text), _c(marks), _c(exceptions))


def _stripped(text: str | None, marks: str | None, exceptions) -> str | None:
    if text is None or not marks:
        return text
    nfc = unicodedata.normalize("NFC", text)
    keep = [] if exceptions is None else [x for x in exceptions if x]
    out, i, gone = [], 0, set(unicodedata.normalize("NFD", marks))
    plain: list[str] = []

    def flush() -> None:
        out.append("".join(c for c in unicodedata.normalize("NFD", "".join(plain)) if c not in gone))
        plain.clear()

    while i < len(nfc):
        hit = next((x for x in keep if nfc.startswith(x, i)), None)
        if hit is None:
            plain.append(nfc[i])
            i += 1
        else:
            flush()
            out.append(hit)
            i += len(hit)
    flush()
    return unicodedata.normalize("NFC", "".join(out))


def code_map(aliases: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
