"""The law side: where an Act's sections went in the code, and what a citation resolves to. All joins and Column expressions.

Outcomes are columns, never guesses: what cannot be told is null or flagged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lawloom.functions.markers import path_markers
from lawloom.functions.text import act_slug, slug

# --- source credits --------------------------------------------------------------------------------------------------------------

# Patterns of source credits.
_ENACTED = r"^\(\s*((?:[A-Z][a-z]{2,8}\.?\s+\d{1,2},\s+\d{4},\s+ch\.\s+\d+[A-Za-z]?)|(?:Pub\.\s*L\.\s*\d+[-–—]\d+))"
_NUMBER = r"§{1,2}\s*([0-9][0-9A-Za-z.\-–—]*)(?:\[([0-9][0-9A-Za-z.\-–—]*)\])?"
_LAW = r"(Pub\. L\. \d+[–—-]\d+|[A-Z][a-z]{2,8}\.?\s+\d{1,2},\s+\d{4},\s+ch\.\s+\d+[A-Za-z]?)"
_DATE = r"([A-Z][a-z]{2,8}\.?\s+\d{1,2},\s+\d{4})"


def _or_null(c: Column) -> Column:
    return F.when(c != "", c)


def first_clause(credit: Column) -> Column:
    return F.element_at(F.split(credit, ";"), 1)


def credit_origin(credit: Column) -> tuple[Column, Column, Column]:
    """(Act as enacted, its section number, its title) of the law that enacted a section; nulls where the credit does not tell."""
    first = first_clause(credit)
    enacted = _or_null(F.regexp_replace(F.regexp_extract(first, _ENACTED, 1), r"\s+", " "))
    number = F.coalesce(_or_null(F.regexp_extract(first, _NUMBER, 2)), _or_null(F.regexp_extract(first, _NUMBER, 1)))
    head = F.regexp_extract(first, rf"(?s)^(.*?){_NUMBER}", 1)
    known = enacted.isNotNull() & number.isNotNull()
    whole = known & ~first.rlike(r"§\s*[0-9][^,;]*\(part\)")
    title = F.upper(_or_null(F.regexp_extract(head, r"(?i)\btitle\s+([IVXLCDM]+|[0-9]+[A-Z]?)\b", 1)))
    return F.when(whole, enacted), F.when(whole, number), F.when(whole & ~head.rlike(r"\bdiv\.?\s+[A-Z]{1,2}\b"), title)


def section_origins(code_section: DataFrame) -> DataFrame:
    """enacted_as, act_key, act_section, act_title, title, section of each section whose credit tells."""
    act, number, title = credit_origin(F.col("source_credit"))
    rows = code_section.select(
        act.alias("enacted_as"), number.alias("act_section"), title.alias("act_title"), "title", "section"
    ).where("enacted_as is not null")
    return rows.withColumn("act_key", act_slug(F.col("enacted_as")))


def act_sections(origins: DataFrame) -> DataFrame:
    """act_key, act_section, and the one place it went to; a number claimed by several places has none."""
    place = F.struct("title", "section")
    one = F.count_distinct(place) == 1
    return origins.groupBy("act_key", "act_section").agg(
        F.min("enacted_as").alias("enacted_as"), F.when(one, F.min(place)).alias("place"), F.count_distinct(place).alias("claims")
    ).select("act_key", "enacted_as", "act_section", "place.title", "place.section", "claims")


def act_conflicts(origins: DataFrame) -> DataFrame:
    return act_sections(origins).where("claims > 1").select("act_key", "act_section", "claims")


def act_titles(origins: DataFrame) -> DataFrame:
    """act_key, act_title, seq, title, section: the places of an Act's title in the order of the Act's own numbers."""
    rows = origins.where("act_title is not null").groupBy("act_key", "act_title", "title", "section").agg(F.min("act_section").alias("act_section"))
    number = F.regexp_extract("act_section", r"^(\d+)", 1).cast("int")
    w = Window.partitionBy("act_key", "act_title").orderBy(number.asc_nulls_last(), F.regexp_extract("act_section", r"^\d*(.*)$", 1), "title", "section")
    return rows.withColumn("seq", F.row_number().over(w) - 1).select("act_key", "act_title", "seq", "title", "section")


def credit_summary(credit: Column) -> dict[str, Column]:
    """What a credit says: enacted_by, section, added_by, amendments, latest_law, latest_date."""
    body = F.regexp_replace(F.regexp_replace(F.trim(credit), r"^\(", ""), r"\)\z", "")
    clauses = F.filter(F.transform(F.split(body, ";"), F.trim), lambda c: c != "")
    first, last = F.get(clauses, F.lit(0)), F.when(F.size(clauses) > 1, F.element_at(clauses, -1))
    dates = F.regexp_extract_all(last, F.lit(_DATE))
    return {
        "enacted_by": _or_null(F.regexp_extract(first, _LAW, 1)),
        "section": F.coalesce(_or_null(F.regexp_extract(first, r"§+\s*([0-9][0-9A-Za-z.\-–—]*)(?:\[([^\]]+)\])?", 2)), _or_null(F.regexp_extract(first, r"§+\s*([0-9][0-9A-Za-z.\-–—]*)", 1))),
        "added_by": _or_null(F.regexp_extract(first, r"as added\s+(Pub\. L\. \d+[–—-]\d+)", 1)),
        "amendments": F.greatest(F.size(clauses) - 1, F.lit(0)).cast("bigint"),
        "latest_law": _or_null(F.regexp_extract(last, _LAW, 1)),
        "latest_date": F.when(F.size(dates) > 0, F.element_at(dates, -1)),
    }


# Labels of note topics.
NOTE_TOPICS = {
    "amendments": "Amendments",
    "changeOfName": "Change of name",
    "codification": "Codification",
    "editorialNotes": "Editorial note",
    "effectiveDate": "Effective date",
    "effectiveDateOfAmendment": "Effective date of amendment",
    "execDoc": "Executive document",
    "executiveOrder": "Executive order",
    "historicalAndRevision": "Historical and revision notes",
    "miscellaneous": "Note",
    "priorProvisions": "Prior provisions",
    "prospectiveAmendment": "Prospective amendment",
    "referencesInText": "References in text",
    "removalDescription": "Removal",
    "repeals": "Repeals",
    "savings": "Savings provision",
    "shortTitle": "Short title",
    "shortTitleOfAmendment": "Short title of amendment",
    "statutoryNotes": "Statutory note",
    "transferOfFunctions": "Transfer of functions",
}


def topic_label(topic: Column) -> Column:
    t = F.trim(F.coalesce(topic, F.lit("")))
    words = F.lower(F.regexp_replace(t, "([a-z0-9])([A-Z])", "$1 $2"))
    known = F.create_map(*[F.lit(x) for kv in NOTE_TOPICS.items() for x in kv])
    made = F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, F.lit(2), F.length(words)))
    return F.when((t == "") | (t == "note"), "Note").otherwise(F.coalesce(F.try_element_at(known, t), made))


# --- labels and links ------------------------------------------------------------------------------------------------------------


def law_id(enacted_as: Column, span: Column) -> Column:
    """Congress and number, joined by a hyphen, of the public law that an Act is."""
    both = F.concat_ws(" ", F.coalesce(enacted_as, F.lit("")), F.coalesce(span, F.lit("")))
    p = r"Pub\. L\. (\d{1,3})[–—-](\d{1,4})"
    return F.when(both.rlike(p), F.concat(F.regexp_extract(both, p, 1), F.lit("-"), F.regexp_extract(both, p, 2)))


def enacting_clause(credit: Column) -> Column:
    first = first_clause(F.regexp_replace(F.coalesce(credit, F.lit("")), r"^\s*\(", ""))
    return F.element_at(F.split(first, r",\s*as\s+(?:added|amended|renumbered)\b"), 1)


def division_agrees(division: Column, credit: Column) -> Column:
    """A division that a credit names must be the one cited."""
    named = F.regexp_extract(enacting_clause(credit), r"\bdiv\.?\s+([A-Z]{1,2})\b", 1)
    return (named == "") | F.coalesce(division == named, F.lit(False))


def range_label(title: Column, span: Column) -> Column:
    """Where the sections of an Act stand; null for shapes that say nothing."""
    stop = lambda c: F.when(c.endswith("."), c).otherwise(F.concat(c, F.lit(".")))
    whole = F.regexp_extract(span, r"(?i)^title\s+([0-9]{1,2}[A-Za-z]?)\b", 1)
    return (
        F.when(span.isNull() | (span == "") | (span == "varies"), F.lit(None).cast("string"))
        .when(whole != "", stop(F.concat(F.lit("Its sections stand all over title "), whole)))
        .when(span.rlike(r"^[0-9][A-Za-z0-9\-–—]*\s") & (title != ""), stop(F.concat(F.lit("Its sections begin at "), title, F.lit(" U.S.C. "), span)))
        .when(span.rlike(r"(?i)^Pub\. L\.\s*\d{1,3}[–—-]\d{1,4}"), stop(F.concat(F.lit("It is "), span)))
    )


# Prefixes of levels in identifiers, in the order in which they are tried, and the words of their addresses.
LEVELS = {"sch": "subchapter", "spt": "subpart", "sd": "subdivision", "st": "subtitle", "ch": "chapter", "pt": "part", "d": "division"}
_CODE_TEXT = "https://www.law.cornell.edu/uscode/text/"


def crumb_link(identifier: Column) -> Column:
    """Address of a unit of the code; null where a level is unknown."""
    clean = F.regexp_replace(F.coalesce(identifier, F.lit("")), "[–—]", "-")
    shape = r"^/us/usc/t([0-9]+[A-Za-z]?)((?:/[A-Za-z]+[A-Za-z0-9-]*)*)\z"
    parts = F.filter(F.split(F.regexp_extract(clean, shape, 2), "/"), lambda s: s != "")

    def level(s: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for prefix, word in LEVELS.items():
            out = out.when(s.startswith(prefix) & (F.length(s) > len(prefix)), F.concat(F.lit(f"{word}-"), F.substring(s, F.lit(len(prefix) + 1), F.length(s))))
        return out

    made = F.transform(parts, level)
    path = F.concat(F.lit(_CODE_TEXT), F.regexp_extract(clean, shape, 1), F.when(F.size(made) > 0, F.concat(F.lit("/"), F.array_join(made, "/"))).otherwise(""))
    return F.when(clean.rlike(shape) & ~F.exists(made, lambda x: x.isNull()), path)


def code_links(title: Column, section: Column) -> Column:
    house = F.concat(F.lit("https://uscode.house.gov/view.xhtml?req=granuleid:USC-prelim-title"), title, F.lit("-section"), section, F.lit("&num=0&edition=prelim"))
    return F.array(F.concat(F.lit(_CODE_TEXT), title, F.lit("/"), section), house, F.concat(F.lit("https://www.govinfo.gov/link/uscode/"), title, F.lit("/"), section))


def law_links(congress: Column, law: Column) -> Column:
    return F.array(
        F.concat(F.lit("https://www.govinfo.gov/link/plaw/"), congress, F.lit("/public/"), law),
        F.concat(F.lit("https://www.congress.gov/public-laws/"), congress, F.lit("th-congress")),
    )


# --- resolution ------------------------------------------------------------------------------------------------------------------

# How a note says that a section has moved, in the order in which the ways are tried.
MOVES = ("editorially reclassified as", "transferred to", "renumbered")


def _move(way: str) -> str:
    """``<way> section 77 of Title 9`` or ``of this title``: the number, then the title."""
    words = r"\s+".join(way.split())
    return rf"(?i)\b{words}\s+(?:section|chapter)\s+(\d+[A-Za-z0-9–-]*)\s+of\s+(?:this\s+title|title\s+(\d+[A-Z]?))"


SCOPE_BUDGET = 6000
KEY = ("kind", "title", "part", "section", "subsection", "congress", "law", "volume", "page", "act_name", "act_section", "division", "where", "short_title", "act_title")


def cite_key(columns: list[str]) -> Column:
    """One string for all that decides what a citation resolves to; empty parts are left out."""
    parts = []
    for name in KEY:
        if name in columns:
            c = F.array_join(F.col("where"), ">") if name == "where" else F.concat(F.lit("t"), F.col(name)) if name == "act_title" else F.col(name)
            parts.append(_or_null(c))
    for flag, word in (("et_seq", "etseq"), ("sub_from_head", "head")):
        if flag in columns:
            on = F.col(flag) if flag == "et_seq" else F.col(flag).isNotNull()
            parts.append(F.when(on, word))
    return F.concat_ws("|", *parts)


def moved_to(title: Column, heading: Column, notes: Column) -> Column:
    """``title:section`` that an emptied section was moved to."""
    hay = F.concat_ws(" \n ", F.coalesce(heading, F.lit("")), F.transform(F.coalesce(notes, F.array()), lambda n: F.coalesce(n["text"], F.lit(""))))
    out = []
    for p in map(_move, MOVES):
        section = F.regexp_replace(F.regexp_extract(hay, p, 1), "–", "-")
        out.append(F.when(section != "", F.concat(F.coalesce(_or_null(F.regexp_extract(hay, p, 2)), title), F.lit(":"), section)))
    return F.coalesce(*out)


def resolve_code(cites: DataFrame, code_title: DataFrame, code_section: DataFrame, code_node: DataFrame) -> DataFrame:
    """One row per citation (cite_key, title, section, subsection, from_head): outcome, focus, dropped levels, moved_to, entries.

    Outcomes: title_absent, section_absent, moved, stub, section (none asked deeper), provision, run_in, head_level, focus_missing.
    A section's later entries under one number are counted, the first one answers.
    """
    cites = cites.withColumn("slug", slug(F.col("section")))
    titles = code_title.select("title", F.lit(True).alias("have_title")).distinct()
    first = F.min_by(F.struct("heading", "lead", "notes"), "entry")
    sections = code_section.groupBy("title", "slug").agg(first.alias("sec"), F.count_distinct("entry").alias("entries"))
    # the paths of a section, which bounds them; so each citation is answered where it meets its section, once
    paths = code_node.groupBy("title", "slug").agg(F.collect_set("path").alias("paths"))
    met = cites.join(titles, "title", "left").join(sections, ["title", "slug"], "left").join(paths, ["title", "slug"], "left")
    marks = path_markers(F.col("subsection"))
    n = F.size(marks)
    lead = F.coalesce(F.col("sec.lead"), F.lit(""))
    held = F.coalesce("paths", F.array().cast("array<string>"))
    # candidates in the order of preference: the path itself, run-in levels dropped, the head's level dropped
    run_in = F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda d: (d < n) & F.forall(F.slice(marks, F.lit(1), d), lambda m: F.instr(lead, m) > 0)),
        lambda d: F.struct(F.array_join(F.slice(marks, d + 1, n), "").alias("path"), F.lit("run_in").alias("how"), F.array_join(F.slice(marks, F.lit(1), d), "").alias("dropped")),
    )
    direct = F.array(F.struct(F.col("subsection").alias("path"), F.lit("provision").alias("how"), F.lit("").alias("dropped")))
    head = F.when(
        F.col("from_head") & (n >= 2) & ~F.array_contains(held, F.get(marks, F.lit(0))),
        F.array(F.struct(F.array_join(F.slice(marks, F.lit(2), n), "").alias("path"), F.lit("head_level").alias("how"), F.get(marks, F.lit(0)).alias("dropped"))),
    ).otherwise(F.slice(direct, 1, 0))
    met = met.withColumn("focus", F.when(F.coalesce("subsection", F.lit("")) != "", F.get(F.filter(F.concat(direct, run_in, head), lambda t: F.array_contains(held, t["path"])), F.lit(0))))
    empty = F.col("paths").isNull() & (F.trim(lead) == "")
    moved = moved_to(F.col("title"), F.col("sec.heading"), F.col("sec.notes"))
    outcome = (
        F.when(F.col("sec").isNull() & F.col("have_title").isNull(), "title_absent")
        .when(F.col("sec").isNull(), "section_absent")
        .when(empty & moved.isNotNull(), "moved")
        .when(empty, "stub")
        .when(F.coalesce(F.col("subsection"), F.lit("")) == "", "section")
        .when(F.col("focus").isNotNull(), F.col("focus.how"))
        .otherwise("focus_missing")
    )
    known = F.col("sec").isNotNull()
    return met.select(
        "cite_key", outcome.alias("outcome"), F.when(known, F.col("focus.path")).alias("focus_path"), F.when(known, F.col("focus.dropped")).alias("dropped"),
        F.when(empty, moved).alias("moved_to"), "entries",
    )


def resolve_acts(cites: DataFrame, sections: DataFrame) -> DataFrame:
    """Citations (cite_key, enacted_as, act_section) with the title and section they went to; null where the Act's index has none."""
    keyed = cites.withColumn("act_key", act_slug(F.col("enacted_as")))
    return keyed.join(sections.select("act_key", "act_section", "title", "section"), ["act_key", "act_section"], "left").select(*cites.columns, "title", "section")


def unit_label(c: Column) -> Column:
    """``DIVISION A`` of ``Division A--Heading``."""
    return F.upper(F.regexp_replace(F.trim(F.element_at(F.split(c, r"\s*(?:--|[—–])\s*"), 1)), r"\s+", " "))


def under_path(have: Column, want: Column) -> Column:
    """Whether units (outermost first) begin with those asked for."""
    n = F.size(want)
    return (n <= F.size(have)) & (F.transform(F.slice(have, F.lit(1), F.greatest(n, F.lit(0))), unit_label) == F.transform(want, unit_label))


def _flat(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def narrow_law_sections(cites: DataFrame, plaw_section: DataFrame) -> DataFrame:
    """Citations (cite_key, law_id, number, where_path, short_title) with the entries they mean: by unit path, else by short title, else all."""
    rows = cites.join(plaw_section, ["law_id", "number"])
    w = Window.partitionBy("cite_key")
    by_path = F.coalesce(under_path(F.col("ancestors"), F.col("where_path")), F.lit(False)) & F.col("where_path").isNotNull()
    want = _flat(F.col("short_title"))
    by_title = (F.length(want) >= 12) & (F.instr(_flat(F.get("ancestors", F.lit(0))), want) > 0)
    rows = rows.withColumns({"by_path": by_path, "by_title": by_title})
    rows = rows.withColumns({
        "of": F.count("*").over(w), "n_path": F.sum(F.col("by_path").cast("int")).over(w), "n_title": F.sum(F.col("by_title").cast("int")).over(w),
    })
    path_narrows = (F.col("n_path") > 0) & (F.col("n_path") < F.col("of"))
    title_narrows = ~path_narrows & (F.col("of") > 1) & (F.col("n_title") == 1)
    keep = F.when(path_narrows, F.col("by_path")).when(title_narrows, F.col("by_title")).otherwise(F.lit(True))
    how = F.when(path_narrows, "path").when(title_narrows, "title")
    return rows.where(keep).select("cite_key", "law_id", "number", "entry", "of", how.alias("narrowed_by"))


def _unit_prefixes(path: Column) -> Column:
    """Units from the outermost to each depth, as one string for each depth."""
    labels = F.transform(path, unit_label)
    return F.transform(F.sequence(F.lit(1), F.size(path)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(labels, F.lit(1), k), ">").alias("units")))


def law_division(cites: DataFrame, plaw_toc: DataFrame, most: int = 20) -> DataFrame:
    """Citations of a unit (cite_key, law_id, where_path) with its first provisions; a path deeper than the contents is shortened from the inside.

    Both sides meet on the law and the units down to a depth. How many provisions stand there is counted once for each, and only the
    first ``most`` of them (a report's length) go to the citations.
    """
    wanted = cites.where("size(where_path) > 0").select("cite_key", "law_id", F.size("where_path").alias("asked"), F.explode(_unit_prefixes(F.col("where_path"))).alias("w")).select("cite_key", "law_id", "asked", "w.*")
    held = plaw_toc.where("size(where_path) > 0").select("law_id", "num", "seq", F.explode(_unit_prefixes(F.col("where_path"))).alias("w")).select("law_id", "num", "seq", "w.units")
    unit = Window.partitionBy("law_id", "units")
    listed = held.withColumns({"total": F.count("*").over(unit), "rank": F.row_number().over(unit.orderBy("seq"))}).where(F.col("rank") <= most)
    units = listed.where("rank = 1").select("law_id", "units")
    deepest = wanted.join(units, ["law_id", "units"]).groupBy("cite_key").agg(F.max(F.struct("depth", "law_id", "units", "asked")).alias("x")).select("cite_key", "x.*")
    return deepest.join(listed, ["law_id", "units"]).select("cite_key", "law_id", "num", "rank", "total", (F.col("asked") - F.col("depth")).alias("dropped_levels"))


def title_hits(cites: DataFrame, code_section: DataFrame) -> DataFrame:
    """doc_id, title, cites, held: how many citations of the code each document makes per title, and how many of those sections are held."""
    held = code_section.select("title", "slug", F.lit(1).alias("hit")).distinct()
    keyed = cites.where("kind = 'usc'").withColumn("slug", slug(F.col("section")))
    return keyed.join(held, ["title", "slug"], "left").groupBy("doc_id", "title").agg(F.count("*").alias("cites"), F.count("hit").alias("held"))


# --- provisions ------------------------------------------------------------------------------------------------------------------


def ancestor_chain(wanted: DataFrame, code_node: DataFrame) -> DataFrame:
    """Rows (cite_key, title, slug, entry, path) with the nodes on the way to them: the longest run of prefixes that all exist."""
    marks = path_markers(F.col("path"))
    steps = wanted.select(
        "cite_key", "title", "slug", "entry", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(marks)), lambda k: F.array_join(F.slice(marks, F.lit(1), k), ""))).alias("step", "prefix")
    ).where("prefix <> ''")
    first = code_node.groupBy("title", "slug", "entry", F.col("path").alias("prefix")).agg(F.min("ord").alias("ord"))
    met = steps.join(first, ["title", "slug", "entry", "prefix"], "left")
    w = Window.partitionBy("cite_key").orderBy("step")
    unbroken = F.min(F.col("ord").isNotNull().cast("int")).over(w) == 1
    return met.withColumn("ok", unbroken).where("ok").select("cite_key", F.col("step").cast("int"), F.col("prefix").alias("path"), "ord")


def flat_text(code_node: DataFrame) -> DataFrame:
    """title, slug, entry and the whole text in preorder, one line per node."""
    line = F.trim(F.concat_ws(" ", F.coalesce("marker", F.lit("")), F.coalesce("text", F.lit(""))))
    rows = code_node.groupBy("title", "slug", "entry").agg(F.sort_array(F.collect_set(F.struct("ord", line.alias("line")))).alias("xs"))
    return rows.select("title", "slug", "entry", F.array_join("xs.line", "\n").alias("text"))


def _prefixes(path: Column) -> Column:
    """The path's prefixes, from none of it to all."""
    ms = path_markers(path)
    return F.transform(F.sequence(F.lit(0), F.size(ms)), lambda k: F.array_join(F.slice(ms, F.lit(1), k), ""))


def default_scope(wanted: DataFrame, code_node: DataFrame) -> DataFrame:
    """Rows (cite_key, title, slug, entry, path) with the scope to show: the parent, unless its text is too long. Lengths are summed once for each provision."""
    marks = path_markers(F.col("path"))
    keyed = wanted.withColumn("parent", F.array_join(F.slice(marks, F.lit(1), F.greatest(F.size(marks) - 1, F.lit(0))), ""))
    size = F.length(F.trim(F.concat_ws(" ", F.coalesce("marker", F.lit("")), F.coalesce("text", F.lit("")))))
    sums = code_node.where("path is not null").select("title", "slug", "entry", size.alias("chars"), F.explode(_prefixes(F.col("path"))).alias("parent")).groupBy("title", "slug", "entry", "parent").agg(F.sum("chars").alias("chars"))
    met = keyed.join(sums, ["title", "slug", "entry", "parent"], "left")
    return met.select("cite_key", F.when(F.coalesce("chars", F.lit(0)) > SCOPE_BUDGET, F.col("path")).otherwise(F.col("parent")).alias("scope"))


def provision_view(wanted: DataFrame, code_node: DataFrame) -> DataFrame:
    """Rows (cite_key, title, slug, entry, path) with the nodes that are shown for them and how: on_path for those above, and of the scope, which is the parent's provision, focus, under or dimmed.

    Wanted paths and nodes meet on the scope and on the paths above it, so a citation meets the nodes it shows and no others of the section.
    """
    key = ["title", "slug", "entry"]
    nodes = code_node.where("path is not null").select(*key, "ord", F.col("path").alias("node")).distinct()
    marks = path_markers(F.col("path"))
    rows = wanted.select("cite_key", *key, F.col("path").alias("focus"), F.array_join(F.slice(marks, F.lit(1), F.greatest(F.size(marks) - 1, F.lit(0))), "").alias("scope"))
    above = rows.select("cite_key", *key, F.explode(_prefixes(F.col("scope"))).alias("node")).join(nodes, [*key, "node"])
    held = nodes.withColumn("scope", F.explode(_prefixes(F.col("node")))).where("node <> scope")
    focus, node = F.col("focus"), F.col("node")
    how = F.when(node == focus, "focus").when((focus == "") | node.startswith(focus), "under").otherwise("dimmed")
    shown = rows.join(held, [*key, "scope"]).select("cite_key", "ord", "node", how.alias("how"))
    whole = rows.where("focus = ''").join(nodes.where("node = ''"), key).select("cite_key", "ord", "node", F.lit("focus").alias("how"))
    return above.where("node <> ''").select("cite_key", "ord", "node", F.lit("on_path").alias("how")).unionByName(shown).unionByName(whole)


def clean_addition(text: Column) -> Column:
    """Added law as shown: no quotes that open a line, no blanks at line ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?m)^([ \t]*)(?:``|‘‘|[\"“])", "$1"), r"(?m)[ \t]+$", ""))


def effects(ops: DataFrame, texts: DataFrame) -> DataFrame:
    """Operations (am_id, op_seq, type, text, title, slug) held against the law's text (title, slug, text) as it is now.

    ``found`` tells whether what is struck stands there. ``status``: no_law (nothing to compare with), stands, gone, or read for
    operations that strike nothing. ``unmatched`` tells of the whole amendment whether anything it strikes is gone.
    """

    def flat(c: Column) -> Column:
        return F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, "``|''|‘‘|’’|[“”]", '"'), r"\s+", " ")))

    met = ops.join(texts.select("title", "slug", flat(F.col("text")).alias("law_text")), ["title", "slug"], "left")
    strikes, held = F.col("type") == "strike", F.col("law_text").isNotNull()
    found = F.when(strikes, F.coalesce(F.contains("law_text", flat(F.col("text"))), F.lit(False)))
    status = F.when(~held, "no_law").when(~strikes, "read").when(found, "stands").otherwise("gone")
    out = met.select("am_id", "op_seq", "type", found.alias("found"), status.alias("status"))
    return out.withColumn("unmatched", F.max((F.col("status") == "gone").cast("int")).over(Window.partitionBy("am_id")) == 1)


def memoised(cites: DataFrame, resolve) -> DataFrame:
    """Citations with what ``resolve`` tells of each distinct key: it sees every key once, whatever it is cited from, and its answers are joined back."""
    keyed = cites.withColumn("cite_key", cite_key(cites.columns))
    answers = resolve(keyed.dropDuplicates(["cite_key"]))
    return keyed.join(answers, "cite_key", "left")


def export_resolved(resolved: DataFrame, path: str, by: str = "kind") -> DataFrame:
    """Write resolved citations as JSON, a folder for each value of ``by``; an unresolved one is a row with an error."""
    resolved.withColumn("error", F.when(F.col("outcome").isNull(), "unresolved")).write.mode("overwrite").partitionBy(by).json(path)
    return resolved.sparkSession.read.json(path)


#: What a reader must be told of a resolved citation, in the order in which it is told.
CARDS = (
    "implied", "relative", "range", "via_act", "act_title", "also", "caveat", "whole_act", "act_range", "run_in", "head_level", "stub", "missing", "effect", "credit", "notes", "links", "as_of",
)


def context_cards(columns: list[str]) -> Column:
    """Codes of CARDS whose column is there and true, in order."""
    return F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in CARDS if c in columns]))


# --- dispatch --------------------------------------------------------------------------------------------------------------------


def popular_name_table(spark) -> DataFrame:
    """The table of Act names: a fixed number of rows."""
    from lawloom.functions.citations import popular_names

    rows = [(a.name, a.title, a.section, a.range, a.enacted_as) for a in popular_names()]
    return spark.createDataFrame(rows, "act_name string, head_title string, head_section string, act_range string, act_enacted string")


def dispatch(
    cites: DataFrame, names: DataFrame, sections: DataFrame, titles: DataFrame, code_section: DataFrame, plaw_section: DataFrame, plaw_toc: DataFrame
) -> DataFrame:
    """Where each citation (cite_key, kind, title, section, act_name, act_section, act_title, division, where, congress, law, short_title) leads.

    ``source`` is the first that holds of: for an Act a division held as law text, a title or section the Act's index knows, the law's
    own text, the head of the Act; for a public law a division, a section that was codified (if the code's credit agrees on the
    division), the law's own text, the head of the Act that the short title names, else outside. Null keys never match.
    """
    by_short = names.select(F.lower("act_name").alias("short_key"), F.col("head_title").alias("short_title_no"), F.col("head_section").alias("short_section"))
    enacted = F.when(F.col("kind") == "publaw", F.concat(F.lit("Pub. L. "), F.col("congress"), F.lit("-"), F.col("law"))).otherwise(F.col("act_enacted"))
    number = F.when(F.col("kind") == "publaw", F.concat(F.col("congress"), F.lit("-"), F.col("law"))).otherwise(law_id(F.col("act_enacted"), F.col("act_range")))
    rows = cites.join(names, "act_name", "left").join(by_short, F.lower(F.col("short_title")) == F.col("short_key"), "left")
    rows = rows.withColumns({
        "act_key": act_slug(enacted), "law_id": number,
        "unit": F.when(F.col("division").isNotNull() & F.col("act_section").isNull(), F.coalesce(F.get("where", F.lit(0)), F.concat(F.lit("DIVISION "), F.col("division")))),
    })
    known = sections.where("title is not null").select("act_key", "act_section", F.col("title").alias("to_title"), F.col("section").alias("to_section"))
    opened = titles.where("seq = 0").select("act_key", "act_title", F.col("title").alias("open_title"), F.col("section").alias("open_section"))
    units = plaw_toc.select("law_id", unit_label(F.get("where_path", F.lit(0))).alias("unit"), F.lit(True).alias("unit_held")).distinct()
    held = plaw_section.select("law_id", F.col("number").alias("act_section"), F.lit(True).alias("text_held")).distinct()
    credits = code_section.groupBy(F.col("title").alias("to_title"), F.col("slug").alias("to_slug")).agg(F.min_by("source_credit", "entry").alias("credit"))
    rows = (
        rows.join(known, ["act_key", "act_section"], "left").join(opened, ["act_key", "act_title"], "left").join(units, ["law_id", "unit"], "left")
        .join(held, ["law_id", "act_section"], "left").withColumn("to_slug", slug(F.col("to_section"))).join(credits, ["to_title", "to_slug"], "left")
    )
    is_act, is_law = F.col("kind") == "act", F.col("kind") == "publaw"
    agrees = division_agrees(F.col("division"), F.col("credit")) & F.col("to_slug").isNotNull()
    source = (
        F.when(F.col("kind") == "usc", "code")
        .when(F.col("kind") == "cfr", "regulation")
        .when((is_act | is_law) & F.col("unit_held"), "law_division")
        .when(is_act & F.col("open_title").isNotNull() & F.col("act_section").isNull(), "act_title")
        .when(F.col("to_title").isNotNull() & (is_act | (is_law & agrees)), "act_section")
        .when((is_act | is_law) & F.col("text_held"), "law_text")
        .when(is_act & F.col("head_title").isNotNull(), "act_head")
        .when(is_law & F.col("short_title_no").isNotNull(), "act_head")
        .when(is_law | (F.col("kind") == "stat"), "outside")
        .when(F.col("kind") == "internal", "internal")
        .otherwise("unknown")
    )
    rows = rows.withColumn("source", source)

    def place(code: str, known_: str, opened_: str, head: str, short: str) -> Column:
        s = F.col("source")
        return F.when(s.isin("code", "regulation"), F.col(code)).when(s == "act_section", F.col(known_)).when(s == "act_title", F.col(opened_)).when(s == "act_head", F.coalesce(head, short))

    return rows.select(
        "cite_key", "source", place("title", "to_title", "open_title", "head_title", "short_title_no").alias("to_title"),
        place("section", "to_section", "open_section", "head_section", "short_section").alias("to_section"),
        F.when(F.col("source").isin("law_division", "law_text", "outside"), F.col("law_id")).alias("law_id"),
    )
