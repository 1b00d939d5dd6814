"""Template names, relation codes and labels of the dictionary's mark-up."""

# Template name, the way it names its sources, relation type.
TEMPLATES = [
    ("inh", "directional", "inherited"), ("inherited", "directional", "inherited"), ("inh+", "directional", "inherited"),
    ("inh-lite", "directional", "inherited"), ("bor", "directional", "borrowed"), ("borrowed", "directional", "borrowed"),
    ("bor+", "directional", "borrowed"), ("ubor", "directional", "borrowed"), ("obor", "directional", "borrowed"),
    ("abor", "directional", "borrowed"), ("unadapted borrowing", "directional", "borrowed"), ("psm", "directional", "borrowed"),
    ("lbor", "directional", "learned_borrowing"), ("learned borrowing", "directional", "learned_borrowing"),
    ("slbor", "directional", "semi_learned_borrowing"), ("der", "directional", "derived"), ("derived", "directional", "derived"),
    ("uder", "directional", "derived"), ("der+", "directional", "derived"), ("der-lite", "directional", "derived"),
    ("pseudo-loan", "directional", "derived"), ("cal", "directional", "calque"), ("calque", "directional", "calque"),
    ("clq", "directional", "calque"), ("pcal", "directional", "calque"), ("partial calque", "directional", "calque"),
    ("pclq", "directional", "calque"), ("sl", "directional", "semantic_loan"), ("semantic loan", "directional", "semantic_loan"),
    ("translit", "directional", "transliteration"), ("transliteration", "directional", "transliteration"), ("af", "affix", "affix"),
    ("affix", "affix", "affix"), ("prefix", "affix", "affix"), ("suffix", "affix", "affix"), ("suf", "affix", "affix"), ("infix", "affix", "affix"),
    ("confix", "affix", "affix"), ("sa-af", "affix", "affix"), ("com", "affix", "compound"), ("compound", "affix", "compound"),
    ("sa-com", "affix", "compound"), ("surf", "affix", "surface_analysis"), ("blend", "affix", "blend"), ("univerbation", "affix", "univerbation"),
    ("contraction", "affix", "shortening"), ("m", "mention", "mention"), ("mention", "mention", "mention"), ("m+", "mention", "mention"),
    ("root", "root", "root"), ("clipping", "single", "shortening"), ("back-formation", "single", "shortening"), ("bf", "single", "shortening"),
    ("ellipsis", "single", "shortening"), ("abbrev", "single", "shortening"), ("initialism", "single", "shortening"),
    ("acronym", "single", "shortening"), ("short for", "single", "shortening"), ("apheretic form", "single", "shortening"),
    ("sylabbr", "single", "shortening"), ("clipcomp", "single", "shortening"), ("deverbal", "single", "derived"),
    ("nominalization", "single", "derived"), ("denominal verb", "single", "derived"), ("vrd", "single", "derived"),
    ("reduplication", "single", "reduplication"),
]
# Template -> (language, argument, relation type).
IMPLIED = {"sa-root": ("sa", "1", "root"), "it-deverbal": ("it", "1", "derived"), "hi-derform": ("hi", "2", "derived")}
# Templates whose arguments are relation codes with the terms that follow them.
ETYMON = ["etymon", "ety"]
# Other spellings of template names.
SPELLINGS = {
    "pre": "prefix", "com+": "com", "compound+": "compound", "surface analysis": "surf", "univ": "univerbation", "back-form": "back-formation",
    "backform": "back-formation", "backformation": "back-formation", "clip": "clipping", "nom": "nominalization", "m-lite": "m", "con": "confix",
}
# Code within etymon templates and inline chains, relation type.
CODES = [
    ("inh", "inherited"), ("bor", "borrowed"), ("ubor", "borrowed"), ("obor", "borrowed"), ("psm", "borrowed"), ("lbor", "learned_borrowing"),
    ("slbor", "semi_learned_borrowing"), ("der", "derived"), ("derived", "derived"), ("from", "derived"), ("vrd", "derived"), ("uder", "derived"),
    ("deverbal", "derived"), ("denominal", "derived"), ("denom", "derived"), ("nom", "derived"), ("nominalization", "derived"), ("root", "root"),
    ("af", "affix"), ("affix", "affix"), ("sa-af", "affix"), ("vrd-af", "affix"), ("afeq", "surface_analysis"), ("calque", "calque"),
    ("cal", "calque"), ("clq", "calque"), ("pcal", "calque"), ("partial calque", "calque"), ("blend", "blend"), ("univ", "univerbation"),
    ("univerbation", "univerbation"), ("clip", "shortening"), ("clipping", "shortening"), ("bf", "shortening"), ("back-formation", "shortening"),
    ("ellipsis", "shortening"), ("ellip", "shortening"), ("abbr", "shortening"), ("abbrev", "shortening"), ("abbreviation", "shortening"),
    ("acro", "shortening"), ("init", "shortening"), ("sylabbr", "shortening"), ("apheretic", "shortening"), ("redup", "reduplication"),
    ("reduplication", "reduplication"), ("metathesis", "metathesis"), ("translit", "transliteration"), ("transliteration", "transliteration"),
    ("sl", "semantic_loan"), ("semantic loan", "semantic_loan"), ("influence", "influence"),
]
#: Relation types whose terms are pieces in an order.
PIECEWISE = ("affix", "blend", "univerbation", "surface_analysis")
#: Names in an inline chain that modify a term; the others are terms.
CHAIN_MODIFIERS = ("alt", "lit", "pos", "q", "ref", "t", "unc")
# Labels behind a lemma's name, and tags of senses that name another word.
GENDER_LABELS = ["m", "f", "n", "c", "pf", "impf", "pl", "du", "anim", "inan", "pers", "npers"]
NOT_A_SPELLING = [
    "abbreviation", "initialism", "acronym", "romanization", "symbol", "clipping", "ellipsis", "contraction",
]
# Templates that state no ancestry.
IGNORED = [
    "cog", "cognate", "ncog", "noncog", "doublet", "dbt", "piecewise doublet", "internationalism", "intnat", "unk", "unknown", "unc", "uncertain",
    "onomatopoeic", "onomatopoeia", "onom", "coin", "coinage", "coined", "named-after", "named-after/list", "yesno", "glossary", "m-g", "lit",
    "nonlemma", "non-lemma", "dercat", "etydate", "etymid", "lang", "lg", "langname", "ref", "R", "wp", "sup", "!", "senseno", "sense", "taxfmt",
    "taxlink", "word", "col-top", "zh-l", "zh-m", "ja-r", "str left", "str index-lite/logic", "str_index-lite", "fa-xlit", "xlit", "inc-ext", "q",
    "qualifier", "gloss", "gl", "nb...", "interproject-box", "participle of", "circa2", "C.E.", "CE", "egy-h", "ic", "or else", "as-verb set",
    "as-verb-c", "hi-verb set", "mr-verb set", "ca-verb-obj", "es-verb-obj", "it-verb-obj", "gentrade", "lena", "vern", "pagename", "smallcaps",
    "commonscat", "angbr", "IPAfont", "wikidata lexeme", "PIE word", "displaced", "metathesis", "rebracketing", "from", "der-lite/lang", "nl", "s",
    "n-g", "defdate", "ltc-l", "ar-root",
]
