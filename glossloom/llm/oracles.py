"""SQL of the text problems' queries, written without the operators' code.

Rules and letters are stated again here as plain SQL, so that a wrong one shows up as a difference.
"""

from __future__ import annotations

import unicodedata

# Look-alike letters and the Latin letters they look like, in the same places.
_CYRILLIC = "асԁеһіјӏорԛѕуѵԝхӕәАВСЕԌНІЈКӀМОРԚЅТԜХҮѴӔӘ"
_CYR_LATIN = "acdehijlopqsyvwxæəABCEGHIJKIMOPQSTWXYVÆƏ"
_GREEK = "ονϳϲΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ"
_GRE_LATIN = "ovjcABEZHIKMNOPTYXCJ"
_ARMENIAN = "օսհցոզՕՍ"
_ARM_LATIN = "ouhgnqOU"
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F)))


def _with_marks() -> dict[str, str]:
    """Look-alike letters with a mark that are characters of their own, and what they look like."""
    nfc = lambda t: unicodedata.normalize("NFC", t)
    pairs = zip(_CYRILLIC + _GREEK + _ARMENIAN, _CYR_LATIN + _GRE_LATIN + _ARM_LATIN)
    return {nfc(a + chr(m)): nfc(b + chr(m)) for a, b in pairs for m in range(0x300, 0x370) if len(nfc(a + chr(m))) == 1}


_MARKED = _with_marks()
_ONE = {a: b for a, b in _MARKED.items() if len(b) == 1}
_MORE = {a: b for a, b in _MARKED.items() if len(b) > 1}


def _quoted(s: str) -> str:
    return s.replace("'", "''")


def _shown(c: str) -> str:
    """What shows of a text: hidden characters out, blanks and hyphens of one kind, letters of one shape, marks composed."""
    bare = f"regexp_replace({c}, '[\\x{{AD}}\\x{{34F}}\\x{{200B}}-\\x{{200F}}\\x{{2060}}-\\x{{2064}}\\x{{FEFF}}]', '', 'g')"
    bare = f"regexp_replace({bare}, '[\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]', ' ', 'g')"
    bare = f"regexp_replace({bare}, '[\\x{{2D7}}\\x{{2010}}-\\x{{2012}}\\x{{2043}}\\x{{2212}}\\x{{FE63}}\\x{{FF0D}}]', '-', 'g')"
    for a, b in ({"ɡ": "g", "ﬁ": "fi", "ﬂ": "fl"} | _MORE).items():
        bare = f"replace({bare}, '{a}', '{b}')"
    many, plain = _CYRILLIC + _GREEK + _ARMENIAN + "".join(_ONE), _CYR_LATIN + _GRE_LATIN + _ARM_LATIN + "".join(_ONE.values())
    letters = f"translate(nfc_normalize({bare}), '{many}{_quoted(_WIDE)}', '{plain}{_quoted(_NARROW)}')"
    return f"trim(nfc_normalize({letters}))"


def _pairs(field: str, tab: str, rec: str, text: str, group: str) -> str:
    side = f"(select distinct {group} as g, {rec} as id, {text} as t, {_shown(text)} as s from {tab} where {text} is not null and {group} is not null)"
    return f"select '{field}' as rec_field, a.id as id_a, b.id as id_b from {side} a join {side} b on a.g = b.g and a.s = b.s and a.t <> b.t and a.id < b.id"


P5 = _pairs("headword", "stg_term", "occurrence_id", "headword", "lang_code") + " union all " + _pairs("strip_marks", "language_record", "lang_id", "strip_marks", "''")
P5_CANONICAL = f"""
with w as (select lang_code, headword, count(*) as n, {_shown("headword")} as s from stg_term where lang_code is not null and headword is not null group by lang_code, headword),
c as (select lang_code, s, count(*) as spellings, arg_min(headword, (headword <> s, -n, headword)) as best from w group by lang_code, s)
select lang_code, headword, case when spellings > 1 then best else s end as canonical from w join c using (lang_code, s)"""


def _plain(c: str) -> str:
    """Lower case, without marks and hidden characters."""
    out = f"regexp_replace(strip_accents(lower({c})), '[\\x{{300}}-\\x{{36F}}\\x{{200B}}-\\x{{200F}}\\x{{2060}}\\x{{FEFF}}\\x{{AD}}\\x{{B7}}]', '', 'g')"
    out = f"regexp_replace({out}, '[\\s\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{3000}}]+', ' ', 'g')"
    return f"translate(regexp_replace({out}, '[\\x{{2010}}-\\x{{2015}}\\x{{2212}}]', '-', 'g'), 'ðþđæœøłıħŋß', 'dtdaoolihns')"


_P7 = rf"""
with asked as (select distinct lang_text as raw from raw_citation where lang_text is not null),
spelt as (
  select 'asked' as side, raw as id, {_plain("raw")} as s from asked
  union all select 'asked', raw, {_plain("regexp_replace(raw, '[\\[(][A-Za-z0-9-]+[\\])] *$|^ *[A-Za-z0-9]+(-pro)? +- +', '', 'g')")} from asked
  union all select 'listed', code, {_plain("name")} from language_record where name is not null
), full_ as (
  select side, id, regexp_replace(regexp_replace(regexp_replace(s, '(^|[ ,(])(ol|o)\. ?', '\1old ', 'g'),
    '(^|[ ,(])(middl|midd|mid|mi|m)\. ?', '\1middle ', 'g'), '(^|[ ,(])(prot|pro|pr|p)\. ?', '\1proto ', 'g') as s from spelt
), word as (
  select side, id, regexp_replace(regexp_replace(trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')), '^((from|in|the|of|lang|language) )+', ''), '( (from|in|the|of|lang|language))+$', '') as s from full_
), form as (
  select distinct side, id, regexp_replace(s, '^(.+) (old|middle|proto)$', '\2 \1') as s from word
), by_name as (
  select a.id as raw, arg_min(l.id, (levenshtein(a.s, l.s), -length(l.s), l.id)) as key from form a, form l
  where a.side = 'asked' and l.side = 'listed' and a.s <> '' and levenshtein(a.s, l.s) <= case when length(l.s) >= 6 then 2 when length(l.s) >= 3 then 1 else 0 end group by a.id
), token as (
  select raw, unnest(string_split(trim(regexp_replace({_plain("raw")}, '[^a-z0-9-]+', ' ', 'g')), ' ')) as alias from asked
), code as (
  select code, lower(unnest([code, iso639_1, iso639_2b, iso639_3] || coalesce(wikimedia_codes, []))) as alias from language_record
), by_code as (select raw, arg_min(code, (-length(alias), code)) as key from token join code using (alias) where alias <> '' group by raw),
lemma as (select cast(lemma_id as varchar) as key, replace(replace({_plain("headword")}, ' ', ''), '-', '') as r from lemma_ref where headword is not null),
said as (select distinct src_text as raw from raw_citation where src_text is not null),
parts as (select raw, string_split(trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace({_plain("raw")}, '\([^()]*\)|\x{{2018}}[^\x{{2019}}]*\x{{2019}}', ' ', 'g'),
  '\{{\{{[a-z+-]+\||\}}\}}|\[\[|\]\]', ' ', 'g'), '[*\x27\x22\x{{201C}}-\x{{201F}}\x{{2018}}\x{{2019}}.,;:?!]+', '', 'g'), '-', ''), ' +', ' ', 'g')), ' ') as w from said),
heads as (select raw, w, unnest(range(1, len(w) + 1)) as i from parts),
runs as (select distinct raw, array_to_string(w[i:j], '') as v from (select raw, w, i, unnest(range(i, len(w) + 1)) as j from heads)),
by_word as (
  select raw, arg_min(key, (levenshtein(v, r), -length(r), key)) as key from runs, lemma
  where abs(length(v) - length(r)) <= 4 and v <> '' and levenshtein(v, r) <= case when length(r) >= 10 then 4 when length(r) = 9 then 3 when length(r) >= 6 then 2 when length(r) >= 3 then 1 else 0 end group by raw
), found as (
  select distinct citation_id, 'lang_text' as raw_field, lang_text as raw, coalesce(n.key, c.key, '') as matched_key
  from raw_citation r left join by_name n on n.raw = r.lang_text left join by_code c on c.raw = r.lang_text where lang_text is not null and citation_id is not null
  union all
  select distinct citation_id, 'src_text', src_text, coalesce(w.key, '') from raw_citation r left join by_word w on w.raw = r.src_text where src_text is not null and citation_id is not null
)"""
P7 = _P7 + " select citation_id, raw_field, matched_key from found"
P7_UNMATCHED = _P7 + " select raw_field, raw, count(distinct citation_id) as n_citations from found where matched_key = '' group by raw_field, raw"

_P8 = """
with w as (select distinct item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from eval_item),
win as (select item_id, i, array_to_string(w[i:i + 11], ' ') as t from (select item_id, w, unnest(range(1, len(w) - 10)) as i from w)),
d as (select distinct doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents),
run as (select distinct doc_id, array_to_string(w[i:i + 11], ' ') as t from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from d)),
hit as (select distinct doc_id, item_id, i from run join win using (t))"""
P8 = _P8 + " select distinct doc_id, item_id from hit"
# Runs of windows one after another, by the difference of window and rank.
P8_REPORT = _P8 + """,
met as (select doc_id, item_id, count(*) + 11 as words from (select *, i - row_number() over (partition by doc_id, item_id order by i) as g from hit) group by doc_id, item_id, g),
per as (select item_id, count(distinct doc_id) as n_docs, max(words) as longest_run from met group by item_id)
select e.item_id, e.task, coalesce(n_docs, 0) as n_docs, coalesce(longest_run, 0) as longest_run from (select distinct item_id, task from eval_item) e left join per using (item_id)"""

# A token has more than a byte on average and no text is near the limit: those beyond it have eight times
# its bytes and more, the others less than its bytes.
P10 = "select distinct doc_id from documents where strlen(text) > 4 * 2048"
P10_ROUND_TRIP = "select distinct doc_id, md5(text) as text_md5, cast(0 as bigint) as n_gaps, cast(0 as bigint) as n_over_limit, strlen(text) > 4 * 2048 as is_cut from documents where text is not null"

ORACLE: dict[str, str] = {
    "p5_found": P5, "p5_canonical": P5_CANONICAL, "p7_found": P7, "p7_unmatched": P7_UNMATCHED, "p8_found": P8, "p8_report": P8_REPORT, "p10_found": P10, "p10_round_trip": P10_ROUND_TRIP
}
