"""Visually identical text with different characters, brought to one form.

Unicode's quick-check properties, and a property of our own (the character prints like others), tell at a glance where a text may
not be in its canonical form. Only these segments, each with the stable character before it as boundary context, are decomposed,
folded and composed again; the results are spliced into the unchanged rest. Most rows have no such segment and never leave the JVM.

What prints alike: canonical equivalents, full-width and half-width forms, spaces of any width, ligatures, the hyphens, letters of
other scripts that share their glyph with a Latin one, and characters without a glyph (zero-width, soft hyphen, direction marks).
Visible differences stay: case, accents, digits, raised figures, dashes, quotes, white space that is more or less.

Defined results: null and empty texts and lists are no cases; lists are compared element by element, a null element only equals a
null; repeated rows count once; pairs are of different strings only, smaller id first; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawloom.session import written

# Letters and marks whose glyph is that of a Latin letter or of plain punctuation, script by script.
LOOK_ALIKES = {
    # Cyrillic
    **dict(zip("аеорсухіѕјһԁԛԝӏүѵӕ", "aeopcyxisjhdqwlyvæ")),
    **dict(zip("АВЕКМНОРСТУХІЅЈԌԚԜҮѴӔ", "ABEKMHOPCTYXISJGQWYVÆ")),
    # Greek
    **dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧͿϹ", "ABEZHIKMNOPTYXJC")),
    **dict(zip("ονϲϳ", "ovcj")),
    # Armenian
    **dict(zip("օոսհյզցՕՍԼ", "onuhjqgOUL")),
    # Cherokee
    **dict(zip("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᎶᏃᏒᏔᏚᏙᏞᏟᏢᏦᏴ", "DRTAJEWMHYGZRWSVLCPKB")),
    # Latin letters of other use
    **dict(zip("ɑɡᴄᴏᴠᴡᴢꜱᴜ", "agcovwzsu")),
    # punctuation
    "‐": "-",
    "‑": "-",
    "․": ".",
    "ʼ": "’",
    # a blank that is no separator
    "\u2800": " ",
}
# Ranges of characters that are drawn as nothing (Default_Ignorable_Code_Point).
NO_GLYPH = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F),
    (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
#: Characters the JVM can pass at once; all are stable, which a test proves.
PLAIN = r"\x09\x0A\x0D\x20-\x7E¡-¬®-ıĴ-ſ‒-―‘-‟†-•…"

_invisible = frozenset(p for a, b in NO_GLYPH for p in range(a, b + 1))


def fold_char(c: str) -> str:
    """What one decomposed character becomes, before composition."""
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    if ord(c) in _invisible:
        return ""
    category = unicodedata.category(c)
    if category == "Zs":
        return " "
    tag, *points = (unicodedata.decomposition(c) or " ").split()[:1] or [""]
    if tag in ("<wide>", "<narrow>"):
        return "".join(fold_char(x) for x in unicodedata.normalize("NFKD", c))
    if tag == "<compat>" and category in ("Lu", "Ll", "Lt", "Nl"):
        parts = unicodedata.normalize("NFKD", c)
        if parts.isalpha() and parts.isascii() and (len(parts) > 1 or category == "Nl"):
            return parts
    return c


@lru_cache(maxsize=1)
def _properties() -> tuple[re.Pattern, dict[int, str]]:
    """Segments that the quick check cannot pass, and the fold of single characters; over all code points there are."""
    seconds: set[str] = set()
    fold: dict[int, str] = {}
    doubtful: list[int] = []
    for p in chain(range(0x80, 0xD800), range(0xE000, 0x110000)):
        c = chr(p)
        d = unicodedata.decomposition(c)
        if d and d[0] != "<" and " " in d:
            seconds.update(chr(int(x, 16)) for x in d.split()[1:])
        if d or p in _invisible or c in LOOK_ALIKES or unicodedata.category(c) == "Zs":
            if (f := fold_char(c)) != c:
                fold[p] = f
            doubtful.append(p)
        elif unicodedata.combining(c):
            doubtful.append(p)
    seconds.update(map(chr, range(0x1161, 0x1176)))  # Hangul vowels and finals compose with what precedes
    seconds.update(map(chr, range(0x11A8, 0x11C3)))
    whole = {*doubtful, *map(ord, seconds)} - set(range(0x80))
    unstable = sorted(p for p in whole if unicodedata.combining(chr(p)) or chr(p) in seconds or _whole(chr(p), fold) != chr(p))
    ranges: list[list[int]] = []
    for p in unstable:
        if ranges and ranges[-1][1] == p - 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    chars = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)
    return re.compile(f"[^{chars}]?[{chars}]+"), fold


def _whole(text: str, fold: dict[int, str]) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(fold))


def canonical(text: str) -> str:
    """The one form of all texts that look like this one."""
    if text.isascii():
        return text
    segments, fold = _properties()
    return segments.sub(lambda m: _whole(m[0], fold), text)


def canonical_brute(text: str) -> str:
    """The same by folding the whole text."""
    return _whole(text, _properties()[1])


def may_be_unstable(c: Column) -> Column:
    """What is of ASCII alone, as many bytes as characters, is stable; else characters are looked at."""
    return (F.octet_length(c) != F.length(c)) & c.rlike(f"[^{PLAIN}]")


def canonical_rows(rows: DataFrame) -> DataFrame:
    """src, id, parts (array<string>) and form: the parts in canonical form. Rows that pass the quick check are not handed to Python."""
    doubtful = F.exists("parts", lambda x: F.coalesce(may_be_unstable(x), F.lit(False)))
    rows = rows.withColumn("doubtful", doubtful)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = [[x if x is None else canonical(x) for x in parts] for parts in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(forms, pa.list_(pa.string()))], names=["src", "id", "parts", "form"])

    schema = "src string, id bigint, parts array<string>, form array<string>"
    changed = rows.where("doubtful").select("src", "id", "parts").mapInArrow(run, schema)
    return rows.where("not doubtful").select("src", "id", "parts", F.col("parts").alias("form")).unionByName(changed)


def provision_rows(code_node: DataFrame, cfr_section: DataFrame) -> DataFrame:
    nodes = code_node.where("text <> ''").select(F.lit("code_node").alias("src"), F.col("node_id").alias("id"), F.array("text").alias("parts"))
    rules = cfr_section.where("size(paragraphs) > 0").select(
        F.lit("cfr_section").alias("src"), F.col("reg_id").alias("id"), F.col("paragraphs").alias("parts")
    )
    return nodes.unionByName(rules).where("id is not null")


#: Members of a group that one task pairs with others.
GROUP_SLICE = 10_000


def same_look_members(rows: DataFrame) -> DataFrame:
    """src, f1, f2 (two hashes of the form), id, s1, s2 (two hashes of the string), changed, members: rows whose form more than one string has.

    One row for each row of the input, however often a form comes; this is what scales. Texts travel no further than to be hashed.
    """

    def two(c: str) -> list[Column]:
        whole = F.transform(c, lambda x: F.coalesce(F.concat(F.lit("="), x), F.lit("-")))  # a null element is no empty one
        return [F.xxhash64(F.size(c), whole), F.xxhash64(F.lit(7), F.size(c), whole)]

    (f1, f2), (s1, s2) = two("form"), two("parts")
    keyed = canonical_rows(rows).select(
        "src", "id", f1.alias("f1"), f2.alias("f2"), s1.alias("s1"), s2.alias("s2"), (F.col("form") != F.col("parts")).alias("changed")
    )
    keyed = written(keyed, "forms")
    form = ["src", "f1", "f2"]
    groups = keyed.groupBy(*form).agg(F.count("*").alias("members"), *[g(s).alias(f"{n}_{s}") for s in ("s1", "s2") for n, g in (("least", F.min), ("most", F.max))])
    several = groups.where("least_s1 <> most_s1 or least_s2 <> most_s2").select(*form, "members")
    return keyed.join(several, form)


def same_look_groups(rows: DataFrame) -> DataFrame:
    """Distinct src, id, form_id, string_id: rows with one form_id look the same; those with different string_id are different strings."""
    return same_look_members(rows).select("src", "id", F.hex("f1").alias("form_id"), F.hex("s1").alias("string_id")).distinct()


def same_look_pairs(rows: DataFrame) -> DataFrame:
    """src, id_a, id_b of different strings with one form, from the groups.

    Two strings of one form cannot both be the form itself, so one side of the join are only the rows that were changed. A large group
    is joined in slices: each changed row meets every slice of the others.
    """
    members = same_look_members(rows).withColumn("slices", F.ceil(F.col("members") / GROUP_SLICE).cast("int"))
    changed = members.where("changed").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    others = members.withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    a, b = changed.alias("a"), others.alias("b")
    pairs = a.join(b, F.expr("a.src = b.src and a.f1 = b.f1 and a.f2 = b.f2 and a.slice = b.slice and a.id <> b.id and (a.s1 <> b.s1 or a.s2 <> b.s2)"))
    return pairs.select("a.src", F.least("a.id", "b.id").alias("id_a"), F.greatest("a.id", "b.id").alias("id_b")).distinct()


def canonical_texts(rows: DataFrame) -> DataFrame:
    """src, id and the canonical text, elements one below the other."""
    return canonical_rows(rows).select("src", "id", F.array_join("form", "\n").alias("form")).distinct()
