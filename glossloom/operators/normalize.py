"""Dictionary entries to typed edges, terms and section claims.

Each template's arguments become an array of source slots by one expression chosen by the template's
family, so entries are read and exploded once. Only the recursive notations leave the JVM. Language codes
are resolved by joins with the small code table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossloom.functions import registry as R
from glossloom.functions import text as X
from glossloom.operators import chains
from glossloom.operators import vocabulary as V
from glossloom.session import Scratch

ENTRY_SCHEMA = (
    "word string, lang_code string, etymology_number string, original_title string, pos string, "
    "senses array<struct<glosses:array<string>,tags:array<string>,form_of:array<struct<word:string>>,alt_of:array<struct<word:string>>,senseid:array<string>>>, "
    "etymology_templates array<struct<name:string,args:map<string,string>>>, descendants string, derived array<struct<word:string>>"
)


def template_dim() -> dict[str, tuple[str, str, str]]:
    """Template name as written -> (name it behaves as, family, relation type)."""
    out = {name: (name, family, rel) for name, family, rel in V.TEMPLATES}
    out |= {name: (name, "implied", rel) for name, (_, _, rel) in V.IMPLIED.items()}
    out |= {name: (name, "etymon", "") for name in V.ETYMON}
    return out | {spelt: out[name] for spelt, name in V.SPELLINGS.items()}


def _arg(args: Column, key: Column | str) -> Column:
    return F.try_element_at(args, F.lit(key) if isinstance(key, str) else key)


def _nonempty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


_RAW = "array<struct<lang:string,raw:string,piece:int,last:int,id:string>>"


def _raw_slots(a: Column, name: Column, family: Column, entry_lang: Column) -> Column:
    """The source slots of one template's arguments ``a``: language, text as written, piece and id."""
    nth = F.sequence(F.lit(1), F.size(a) + 1)
    # Numbered arguments count as far as they go without a gap.
    run = lambda first: F.filter(nth, lambda i: F.forall(F.sequence(F.lit(1), i), lambda j: F.map_contains_key(a, (j + first - 1).cast("string"))))
    none = F.lit(None)

    def slot(lang: Column, raw: Column, piece: Column = none, last: Column = none, wid: Column = none) -> Column:
        return F.struct(lang.alias("lang"), raw.alias("raw"), piece.cast("int").alias("piece"), last.cast("int").alias("last"), wid.cast("string").alias("id"))

    three = F.coalesce(_nonempty(_arg(a, "3")), _arg(a, "4"))
    directional = F.transform(X.lang_codes(_arg(a, "2")), lambda x: slot(x, three, wid=_nonempty(_arg(a, "id"))))

    one = F.coalesce(_arg(a, "1"), F.lit(""))
    flagged = (name == "surf") & one.startswith("+")
    own = flagged & F.startswith(one, F.concat(F.lit("+"), entry_lang, F.lit("-")))
    offset = F.when(flagged & ~own, 1).otherwise(0)
    lang = F.when(own, entry_lang).when(flagged, F.coalesce(_arg(a, "2"), F.lit(""))).otherwise(one)
    n = lambda word, i: F.concat(F.lit(word), i.cast("string"))
    affix = F.transform(run(offset + 2), lambda i: slot(
        lang, F.coalesce(_nonempty(_arg(a, n("alt", i))), _arg(a, (i + offset + 1).cast("string"))), i, F.size(run(offset + 2)), _nonempty(_arg(a, n("id", i)))
    ))
    root = F.transform(run(F.lit(3)), lambda i: slot(
        _arg(a, "2"), _arg(a, (i + 2).cast("string")), wid=F.coalesce(_nonempty(_arg(a, n("id", i))), F.when(i == 1, _nonempty(_arg(a, "id"))))
    ))
    mention = F.array(slot(one, F.coalesce(_nonempty(_arg(a, "3")), _arg(a, "2"))))
    single = F.transform(F.split(F.coalesce(_nonempty(_arg(a, "2")), _arg(a, "3"), F.lit("")), ","), lambda t: slot(one, F.trim(t)))
    out = F.when(family == "directional", directional).when(family == "affix", affix).when(family == "root", root).when(family == "mention", mention).when(family == "single", single)
    for t, (fixed, at, _) in V.IMPLIED.items():
        out = out.when(name == t, F.array(slot(F.lit(fixed), _arg(a, at))))
    return out.cast(_RAW)


def _read_slots(t: DataFrame) -> DataFrame:
    """One row per slot of plain templates with its language, terms joined by ``//``, dash side, piece and id."""
    s = t.withColumn("s", F.explode(_raw_slots(F.col("args"), F.col("behaves"), F.col("family"), F.col("lang_code"))))
    s = s.select("entry_id", "i", "name", "behaves", "family", "rel", F.try_element_at("args", F.lit("1")).alias("one"), "s.*").where("lang <> ''")
    affix = F.col("family") == "affix"
    s = s.where(~affix | X.has_term("raw")).withColumn("_parts", F.when(affix, X.lang_and_term("raw")))
    flag = F.try_element_at(X.code_map({"+suf": "suffix", "+suffix": "suffix", "+pre": "prefix", "+prefix": "prefix", "+con": "confix"}), F.col("one"))
    s = s.withColumn("_kind", F.when(F.col("behaves") == "surf", F.coalesce(flag, F.lit("surf"))).otherwise(F.col("behaves")))
    first, last, kind = F.col("piece") == 1, F.col("piece") == F.col("last"), F.col("_kind")
    side = (
        F.when((kind == "confix") & first, "trailing").when((kind == "confix") & last, "leading").when((kind == "prefix") & ~last, "trailing")
        .when(kind.isin("suffix", "suf") & ~first, "leading").when((kind == "infix") & ~first, "both")
    )
    wid = F.when(F.col("family").isin("directional", "affix", "root"), F.coalesce(X.inline_id("raw"), "id"))
    return s.select(
        "entry_id", "i", "name", F.coalesce("_parts.lang", "lang").alias("src_lang"), F.coalesce("_parts.term", "raw").alias("src_term"), F.when(affix, side).alias("side"),
        F.lit(None).cast("string").alias("dst_lang"), F.lit(None).cast("string").alias("dst_term"), F.col("rel").alias("rel_type"), F.when(affix, F.col("piece")).alias("piece_order"), wid.alias("src_id"),
    )


def entries_with_section(entries: DataFrame) -> DataFrame:
    """Valid entries, repeated ones once, with an id, their section and whether all their senses only point at lemmas."""
    formed = F.coalesce(F.forall("senses", lambda s: F.array_contains(s["tags"], "form-of") & (F.size(s["form_of"]) > 0)), F.lit(False)) & (F.size("senses") > 0)
    e = entries.where("word <> '' and lang_code <> ''")
    own = F.coalesce(F.col("original_title").startswith("Reconstruction:"), F.lit(False))
    e = e.withColumns({"section": X.section_of("etymology_number"), "forms_only": F.coalesce(formed, F.lit(False)), "on_reconstruction": own})
    told = [F.coalesce(F.col(c), F.lit("\x1e")) for c in ("word", "lang_code", "etymology_number", "original_title", "pos", "descendants")]
    told += [F.coalesce(F.to_json(c), F.lit("\x1e")) for c in ("senses", "etymology_templates", "derived")]
    return e.withColumn("entry_id", F.md5(F.concat_ws("\x1f", *told))).dropDuplicates(["entry_id"])


def _templates(entries: DataFrame) -> DataFrame:
    """One row per template of entries that have a sense of their own, without stringified copies."""
    dim = template_dim()
    as_map = lambda k: X.code_map({n: v[k] for n, v in dim.items()})
    t = entries.where("not forms_only").select("entry_id", "lang_code", "word", F.posexplode("etymology_templates").alias("i", "t"))
    name = F.col("t.name")
    t = t.select("entry_id", "lang_code", "word", "i", name.alias("name"), F.col("t.args").alias("args"), *[F.try_element_at(as_map(k), name).alias(c) for k, c in enumerate(("behaves", "family", "rel"))])
    copied = F.exists(F.map_values("args"), lambda v: v.rlike(r"^\[(?:['\"]|<[A-Z]+\()"))
    return t.where(~((F.col("family") == "etymon") & F.coalesce(copied, F.lit(False))))


def raw_edges(entries: DataFrame) -> DataFrame:
    """Edges as stated, before codes are resolved: entry, slots, anchor; inflections are candidates."""
    t = _templates(entries).where("family is not null")
    none = F.lit(None).cast("string")
    plain = _read_slots(t.where("family <> 'etymon'"))
    etym = t.where("family = 'etymon'").select("entry_id", "i", "name", F.explode(chains.etymon(F.col("args"), F.col("lang_code"))).alias("s")).select("entry_id", "i", "name", "s.*", none.alias("side"))
    both = plain.unionByName(etym)
    both = both.withColumn("anchor", F.concat_ws(":", F.lit("etymology_templates"), F.col("i").cast("string"), F.col("name"))).drop("i", "name")

    s = entries.select("entry_id", "lang_code", F.posexplode("senses").alias("i", "s"))
    form = F.get("s.form_of", F.lit(0))["word"]
    alt = F.get("s.alt_of", F.lit(0))["word"]
    blocked = F.arrays_overlap("s.tags", F.array(*[F.lit(x) for x in V.NOT_A_SPELLING]))
    f = s.where(F.array_contains("s.tags", "form-of")).select("entry_id", "lang_code", "i", X.trim_labels(form, V.GENDER_LABELS).alias("w"), F.lit("inflection").alias("rel"), F.lit("form_of").alias("kind"))
    a = s.where(F.array_contains("s.tags", "alt-of") & ~blocked).select("entry_id", "lang_code", "i", alt.alias("w"), F.lit("alt_form").alias("rel"), F.lit("alt_of").alias("kind"))
    senses = f.unionByName(a).where(X.has_term("w") & ~F.col("w").rlike(r"\s"))
    senses = senses.select(
        "entry_id", F.concat_ws(":", F.lit("senses"), F.col("i").cast("string"), F.col("kind")).alias("anchor"), F.col("lang_code").alias("src_lang"), F.col("w").alias("src_term"),
        none.alias("side"), none.alias("dst_lang"), none.alias("dst_term"), F.col("rel").alias("rel_type"), F.lit(None).cast("int").alias("piece_order"), none.alias("src_id"),
    )
    return both.unionByName(senses)


def _resolved(df: DataFrame, lang: str, term: str, dim: DataFrame, to: str) -> DataFrame:
    """Adds ``<to>_lang_code``, ``_headword``, ``_variety_code`` and ``_is_reconstructed`` of a reference."""
    df = R.with_code(df, lang, dim, "_code", "_var")
    head = F.trim(X.strip_inline(X.strip_markers(term)))
    return df.withColumns({
        f"{to}_lang_code": F.coalesce("_code", lang), f"{to}_variety_code": F.col("_var"), f"{to}_headword": X.strip_star(head),
        f"{to}_is_reconstructed": X.is_starred(head) | R.is_reconstructed_code(F.coalesce("_var", "_code", lang)),
    }).drop("_code", "_var")


def own_terms(entries: DataFrame, dim: DataFrame) -> DataFrame:
    """The term of each entry: ``entry_id``, ``dst_lang_code``, ``dst_headword``, flags, section, part of speech, gloss."""
    e = _resolved(entries, "lang_code", "word", dim, "dst")
    rec = F.col("dst_is_reconstructed") | F.col("on_reconstruction")
    return e.select("entry_id", "dst_lang_code", "dst_headword", rec.alias("dst_is_reconstructed"), F.col("section").alias("dst_section"), F.nullif("pos", F.lit("")).alias("part_of_speech"), F.nullif(X.first_gloss("senses"), F.lit("")).alias("gloss"))


def normalize(entries: DataFrame, languages: DataFrame, varieties: DataFrame) -> dict[str, DataFrame]:
    """``stg_term``, ``stg_edge`` and ``stg_section_claim`` of raw dictionary entries, and ``loops``.

    An inflection stands only if its lemma has a page, found by the spelling as cited less length marks,
    or as its language titles it; its source is respelled as the page is. Edges from a term to itself are
    dropped and counted by kind in ``loops``. An entry without any other edge than inflections still gives
    its own term.
    """
    # Kept as tables: each is read several times below.
    scratch = Scratch(entries.sparkSession)
    dim = scratch.save(R.code_dim(languages, varieties))
    e = scratch.save(entries_with_section(entries))
    own = scratch.save(own_terms(e, dim))
    raw = raw_edges(e).join(own.drop("part_of_speech", "gloss"), "entry_id")
    raw = raw.where(F.col("src_lang").isNotNull() & (F.col("src_lang") != "")).withColumn("src_term", F.explode(X.alternants(X.strip_markers("src_term"))))
    raw = _resolved(raw.withColumn("src_term", X.affix_dash("src_term", "side")).drop("side"), "src_lang", "src_term", dim, "src")
    inner = raw.where("dst_term is not null").drop("dst_lang_code", "dst_headword", "dst_is_reconstructed", "dst_section")
    inner = _resolved(inner, "dst_lang", "dst_term", dim, "dst").drop("dst_variety_code").withColumn("dst_section", F.lit(0).cast("smallint"))
    raw = raw.where("dst_term is null").unionByName(inner).withColumn("src_section", F.lit(0).cast("smallint"))

    raw = scratch.save(raw)

    # Inflections need the page of their lemma: as cited, else as the language titles its pages.
    pages = own.select("dst_lang_code", "dst_headword").distinct().withColumn("_fold", X.length_folded("dst_headword"))
    pages = pages.groupBy(F.col("dst_lang_code").alias("_pl"), F.col("_fold").alias("_pf")).agg(F.min("dst_headword").alias("_page"))
    rules = languages.select(F.col("code").alias("_lc"), "strip_marks", "strip_exceptions").dropDuplicates(["_lc"])
    infl = raw.where("rel_type = 'inflection'").join(rules, F.col("src_lang_code") == F.col("_lc"), "left").withColumns({
        "_as_cited": X.length_folded("src_headword"), "_titled": X.length_folded(X.strip_diacritics("src_headword", "strip_marks", "strip_exceptions"))
    })
    first = infl.join(pages, (F.col("src_lang_code") == F.col("_pl")) & (F.col("_as_cited") == F.col("_pf")), "left").withColumnRenamed("_page", "_p1").drop("_pl", "_pf")
    second = first.join(pages, (F.col("src_lang_code") == F.col("_pl")) & (F.col("_titled") == F.col("_pf")), "left")
    found = second.where("_p1 is not null or _page is not null").withColumn("src_headword", F.coalesce("_p1", "_page"))
    edges = raw.where("rel_type <> 'inflection'").unionByName(found.select(*raw.columns))

    loop = (F.col("src_lang_code") == F.col("dst_lang_code")) & (F.col("src_headword") == F.col("dst_headword"))
    kind = F.when(F.col("rel_type") == "inflection", "inflection").when(F.col("src_variety_code").isNotNull(), "variety").when(F.col("dst_section") > 0, "section").otherwise("same term")
    loops = edges.where(loop).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n_edges"))
    edges = edges.where(~loop)

    cols = ["lang_code", "headword", "section", "is_reconstructed", "part_of_speech", "gloss", "has_sense"]
    end = lambda s: edges.select(
        F.col(f"{s}_lang_code").alias("lang_code"), F.col(f"{s}_headword").alias("headword"), F.col(f"{s}_section").alias("section"), F.col(f"{s}_is_reconstructed").alias("is_reconstructed"),
        F.lit(None).cast("string").alias("part_of_speech"), F.lit(None).cast("string").alias("gloss"), F.lit(False).alias("has_sense"),
    )
    pages_rows = own.select(F.col("dst_lang_code").alias("lang_code"), F.col("dst_headword").alias("headword"), F.col("dst_section").alias("section"), F.col("dst_is_reconstructed").alias("is_reconstructed"), "part_of_speech", "gloss", F.lit(True).alias("has_sense"))
    terms = pages_rows.select(*cols).unionByName(end("src").select(*cols)).unionByName(end("dst").select(*cols)).distinct()
    edge = edges.select(
        "src_lang_code", "src_headword", "src_section", "src_variety_code", "dst_lang_code", "dst_headword", "dst_section", "rel_type", "anchor",
        F.col("piece_order").cast("smallint").alias("piece_order"), F.col("src_id").alias("src_wiktionary_id"),
    )
    return {"stg_term": terms, "stg_edge": edge, "stg_section_claim": section_claims(e, dim), "loops": loops}


def section_claims(entries: DataFrame, dim: DataFrame) -> DataFrame:
    """Ids declared and terms listed by numbered sections."""
    e = _resolved(entries.where("section > 0"), "lang_code", "word", dim, "page")
    tpl = F.filter("etymology_templates", lambda t: t["name"].isin("etymid", "etymon"))
    ids = F.transform(tpl, lambda t: F.trim(F.when(t["name"] == "etymid", _arg(t["args"], "2")).otherwise(_arg(t["args"], "id"))))
    sense = F.flatten(F.transform("senses", lambda s: F.coalesce(s["senseid"], F.array().cast("array<string>"))))
    sense = F.transform(sense, lambda i: F.trim(F.when(F.startswith(i, F.concat(F.col("lang_code"), F.lit(":"))), F.substring(i, F.length("lang_code") + 2, F.length(i))).otherwise(i)))
    none = F.array().cast("array<string>")
    e = e.withColumn("_ids", F.concat(F.coalesce(ids, none), F.coalesce(sense, none)))
    page = [F.col("page_lang_code").alias("lang_code"), F.col("page_headword").alias("headword"), "section"]
    null = F.lit(None).cast("string")
    declared = e.select(*page, F.explode("_ids").alias("wiktionary_id"), null.alias("listed_lang_code"), null.alias("listed_headword")).where("wiktionary_id <> ''")
    d = e.select(*page, F.explode(chains.listed_terms("descendants")).alias("x")).select("lang_code", "headword", "section", F.col("x.lang_code").alias("_ll"), F.col("x.word").alias("_lw"))
    w = e.withColumn("_ll", F.col("lang_code")).select(*page, "_ll", F.explode("derived.word").alias("_lw")).where("_lw <> ''")
    listed = _resolved(d.unionByName(w), "_ll", "_lw", dim, "listed").select("lang_code", "headword", "section", null.alias("wiktionary_id"), "listed_lang_code", "listed_headword")
    return declared.unionByName(listed).distinct()


def unmapped_names(entries: DataFrame, limit: int | None = 30) -> DataFrame:
    """Template names that have no meaning here and aren't known to have none, most frequent first.

    A code without a meaning within an etymon template or its chains counts as ``etymon:<code>``, once per use.
    """
    known = [*template_dim(), *V.IGNORED, ","]
    e = entries_with_section(entries)
    t = e.where("not forms_only").select(F.explode("etymology_templates.name").alias("name")).where(~F.col("name").isin(*known))
    codes = _templates(e).where("family = 'etymon'").select(F.explode(chains.unknown_etymon_codes(F.col("args"), F.col("lang_code"))).alias("name"))
    n = t.unionByName(codes).groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name")
    return n.limit(limit) if limit else n
