"""Amendatory instructions of one text: heads, targets, operations, the walk through the amended provision, and relative citations.

A head says which provision "is amended"; its body, up to the next head, holds operations and the words that move a cursor through
the provision. Spans are places in the whole text throughout.
"""

from __future__ import annotations

import copy
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property, lru_cache

from lawloom.functions import markers as mk
from lawloom.functions.citations import Citation
from lawloom.functions.reading import CLOSE, MARKER, OPEN, QUOTES, Reader, Span, closes, first_marker, folded, matches, opens, places, without_last, without_last_marker, words
from lawloom.functions.structure import Bill, Outline

# Limits, in characters.
MAX_BODY, MAX_BLOCK, BLOCK_WINDOW, BLOCK_GAP = 2500, 60_000, 200, 120
AFTER_STRIKE, PAIR_DISTANCE, ANCHOR_WINDOW, UNIT_WINDOW, DESTINATION_WINDOW = 60, 100, 260, 200, 160
REF_WINDOW, REF_ITEMS, LIST_WINDOW = 80, 8, 40
MAX_OPERAND, MAX_ANCHOR, MAX_ANCHOR_AFTER, STRIKE_GAP, INSERT_GAP, UNIT_GAP = 400, 300, 200, 60, 120, 60
MIDDLES = {"section": 240, "each": 120, "such": 120, "unit": 200}
TABLE_NAME, ACT_NAME, NAMED_ACT, TAX_REACH = (3, 120), 90, 80, 400
PUNCTUATION = {"period": ".", "semicolon": ";", "comma": ",", "colon": ":"}

# Words that phrases are made of.
UNITS = "|".join(u + s for u in mk.UNIT_DEPTH for s in ("", "s"))
_LISTED_UNITS = "|".join(u + s for u in ("subsection", "paragraph", "subparagraph", "clause", "item", "section") for s in ("", "s"))
_INNER_UNITS = "subsection|subsections|paragraph|paragraphs|subparagraph|subparagraphs|clause|clauses"
_SMALL_UNITS = "subsection|paragraph|subparagraph|clause|subclause|item|subitem|section"
_MARKS = "period|semicolon|comma|colon"
_EACH_PLACE = "each place it appears|each place it occurs|each place they appear|each place they occur"
_subject = re.compile(r"\b(?:[Ss]ection|[Cc]hapter|[Pp]art|[Tt]itle|[Ss]ubchapter|[Ss]ubtitle|[Ss]ub(?:section|paragraph)s?|[Pp]aragraphs?|[Cc]lauses?|[Ee]ach|[Tt]he)\b")
_verb = re.compile(r"\s+(?:is|are)\s+(amended|repealed|redesignated)")
_stops = re.compile(rf"\n[ \t]*\n|\.\s*--|\.\s+SEC\.|\.\s*{MARKER}\s|;")
_longest_stop = 12  # what may follow the white space of a stop
_parens = re.compile("[()]")
_roman = re.compile(r"\s+(?:[IVXLC]+|[A-Z])\b")
_inner_number = re.compile(r"\s+(?:[IVXLC0-9]+[A-Za-z]*|[A-Z]\b)")
_capital = re.compile(r"\s+[A-Z]")
_of_year = re.compile(r"\s+of\s+\d{4}")
_item = re.compile(rf"^[ \t]*({MARKER})[ \t]+", re.M)
_striking = re.compile(r"strik(?:e|ing)", re.I)
_inserting = re.compile(r"insert(?:ing)?", re.I)
_redesignating = re.compile(r"redesignat(?:e|ing)", re.I)
_other_verb = re.compile("strik|insert", re.I)
_block_verb = re.compile(r"\b(?:strik|insert|redesignat)", re.I)
_no_insert, _no_strike = re.compile("insert", re.I), re.compile("strik", re.I)
_adding = words("adding at the end the following")
_insert_word = words("insert|inserting")
_whenever = words("whenever in this")
#: What each of the verbs begins with.
_stems = {_striking: "strik", _inserting: "insert", _insert_word: "insert", _redesignating: "redesignat", _adding: "adding"}
_read_as = re.compile(r"\bto\s+read\s+as\s+follows\s*:", re.I)
_LONGEST_UNIT, _last_word = max(map(len, UNITS.split("|"))), re.compile(r"[^\W\d_]+\Z")
_unit_word = re.compile(rf"\b(?:{UNITS})\s+(?=\()", re.I)
_destination = re.compile(r"\s+[0-9]+[A-Za-z]*(?:[-–—][0-9A-Za-z]+)?")
_separator = re.compile(r"\s*(?:,\s*(?:(?:and|or)\s+)?|\b(?:and|or|through|to)\b)\s*", re.I)
_range_word = re.compile(r"\b(?:through|to)\b", re.I)
_new_part = re.compile(r"(?:SUB)?(?:PART|TITLE|CHAPTER)\s+[A-Z0-9]+\s*(?:--|[—–])|DIVISION\s+[A-Z0-9]+\s*(?:--|[—–])")
_new_section = re.compile(r"SEC(?:TION)?\.?\s+[0-9]+[A-Za-z0-9–-]*\.")
_opener, _closer = re.compile(OPEN), re.compile(CLOSE)
_punctuation = re.compile(r"[\s,;]*")
_SURE_STYLES = ((re.compile(r"\d+"), 1), (re.compile("[a-hj-uwyz]"), 0), (re.compile("[A-HJ-UWYZ]"), 2))


@dataclass
class Op:
    type: str
    text: str | None = None
    start: int | None = None
    end: int | None = None
    operand: str | None = None
    punctuation: bool = False
    all: bool = False
    at_end: bool = False
    replaces: int | None = None
    relation: str | None = None
    anchor: str | None = None
    unit_anchor: str | None = None
    placement: str | None = None
    scope: str | None = None
    scope_from_head: bool = False
    exact: bool = False
    range_end: bool = False
    new_section: bool = False
    from_units: str | None = None
    to_units: str | None = None


@dataclass
class Nav:
    """A step of the walk, or a reference made on the way."""

    start: int
    end: int
    text: str
    unit: str
    markers: str
    path: str
    exact: bool = False
    range: tuple[str, str] | None = None
    inserted: bool = False


@dataclass
class Head:
    kind: str
    start: int
    end: int
    unit: str
    verb: str
    inner: str = ""
    section: str = ""
    subsection: str = ""
    middle: str = ""
    such: str = ""


@dataclass
class Amendment:
    start: int
    end: int
    unit: str
    section: str
    subsection: str
    verb: str
    target: Citation | None
    act_name: str | None
    ops: list[Op]
    steps: list[Nav] = field(default_factory=list)
    refs: list[Nav] = field(default_factory=list)
    distributed: bool = False
    via_instruction: int | None = None
    id: str = ""


# --- heads and targets -----------------------------------------------------------------------------------------------------------


def begins_clause(text: str, at: int) -> bool:
    """Whether an instruction may begin here: on a new line, behind a mark, a dash or a parenthesis, or behind ``That``."""
    if at == 0 or text[at - 1] == "\n":
        return True
    before = at
    while before and text[before - 1].isspace():
        before -= 1
    last = text[before - 1 : before]
    if before < at:
        return last in (".", ";", ":", ")", "—", "–") or text[max(0, before - 2) : before] == "--" or (text[:before].endswith("That") and not text[before - 5 : before - 4].isalnum())
    return last in ("—", "–") or text[max(0, before - 2) : before] == "--"


def clear_way(text: str, start: int, end: int) -> bool:
    """Whether nothing between two places ends a sentence; a semicolon within parentheses doesn't."""
    for m in _stops.finditer(text, start, _skip(text, end) + _longest_stop):
        if m.start() >= end:
            return True
        if m[0] != ";":
            return False
        after = _parens.search(text, m.end())
        if not after or after[0] == "(":
            return False
    return True


@lru_cache(maxsize=4)
def _verbs_of(text: str) -> tuple[list[int], list[int]]:
    """Of each ``is amended`` and the like: where the white space before it begins and ends."""
    starts, words_ = [], []
    for at in places(text, ("amended", "repealed", "redesignated")):
        end = _back(text, at)
        word = end - 2 if text.endswith("is", 0, end) else end - 3 if text.endswith("are", 0, end) else 0
        if (start := _back(text, word)) < word and _verb.match(text, start):
            starts.append(start)
            words_.append(word)
    return starts, words_


def next_verb(text: str, at: int) -> re.Match | None:
    """``_verb.search``, for which the text is read once."""
    starts, words_ = _verbs_of(text)
    k = bisect_right(words_, at)
    return _verb.match(text, max(at, starts[k])) if k < len(starts) else None


def verb_after(text: str, at: int, most: int, verbs: str = "amended|repealed") -> re.Match | None:
    """``is amended`` and the like, if it follows in the same sentence."""
    m = next_verb(text, at)
    return m if m and m.start() - at <= most and m[1] in verbs.split("|") and clear_way(text, at, m.start()) else None


def _inner_unit(r: Reader) -> bool:
    """``Subsection (c)``; nothing else of the kind is taken."""
    start = r.at
    if r.say(_INNER_UNITS, True):
        r.blanks()
        if r.path():
            return True
    r.at = start
    return False


def _section_head(text: str, at: int) -> Head | None:
    r = Reader(text, at)
    if _inner_unit(r):
        if not r.say("of", True):
            return None
        r.say("such", True)
        r.blanks()
    unit_at = r.at
    unit = r.say("section|chapter|part|title", True)
    if not unit or not (number := r.number()):
        return None
    shown, path = text[unit_at : unit_at + len(unit)], r.path()
    m = verb_after(text, r.at, MIDDLES["section"], "amended|repealed|redesignated")
    return m and Head("section", at, m.end(), shown, m[1], text[at:unit_at], number, path, text[r.at : m.start()])


def _each_head(text: str, at: int) -> Head | None:
    r = Reader(text, at)
    if not r.say("each of the following", True):
        return None
    m = verb_after(text, r.at, MIDDLES["each"])
    return m and Head("each", at, m.end(), " ".join(text[at : m.start()].split()), m[1])


def _such_head(text: str, at: int) -> Head | None:
    r = Reader(text, at)
    if not _inner_unit(r):
        return None
    unit = " ".join(text[at : r.at].split())
    if not r.say("of such", True) or not (such := r.say("section|subsection|paragraph", True)):
        return None
    m = verb_after(text, r.at, MIDDLES["such"], "amended|repealed|redesignated")
    return m and Head("such", at, m.end(), unit, m[1], subsection="".join(mk.markers(unit)), middle=text[r.at : m.start()], such=such)


def _unit_subject(r: Reader) -> bool:
    """Takes what is amended, when it is a table, an analysis, a unit without a section, or a whole Act."""
    start, text = r.at, r.text
    if r.say("the table of sections|the table of contents", True) and r.say("for|in|at the beginning of", True) or r.say("the analysis for", True):
        least, most = TABLE_NAME
        m = next_verb(text, r.at + least)
        if m and m.start() - r.at <= most + MIDDLES["unit"] and clear_way(text, r.at, m.start()):
            r.at = m.start()
            return True
        return False
    if r.say("subchapter|subtitle", True):
        return bool(r.take(_inner_number))
    if r.say("title|part|chapter", True):
        return bool(r.take(_roman))
    if r.say("the", True) and r.take(_capital):
        act = next((m for m in re.finditer(r"Act\b", text[r.at : r.at + ACT_NAME + 3]) if m.start() >= 2), None)
        if act and clear_way(text, r.at, r.at + act.start()):
            r.at += act.end()
            r.take(_of_year)
            return True
    r.at = start
    return False


def _unit_head(text: str, at: int) -> Head | None:
    r = Reader(text, at)
    if not _unit_subject(r):
        return None
    m = verb_after(text, r.at, MIDDLES["unit"])
    return m and Head("unit", at, m.end(), " ".join(text[at : r.at].split()), m[1], middle=text[r.at : m.start()])


HEADS = {"section": _section_head, "each": _each_head, "such": _such_head, "unit": _unit_head}
#: Kinds of head that a word can begin; any other of the words begins a unit within a section.
_BEGINS = {
    "section": ("section",), "each": ("each",), "the": ("unit",), "subchapter": ("unit",), "subtitle": ("unit",),
    **dict.fromkeys(("title", "part", "chapter"), ("section", "unit")),
}


def heads(text: str) -> list[Head]:
    """Of all kinds, in order; one that begins inside the one before is dropped."""
    found: list[Head] = []
    free = dict.fromkeys(HEADS, 0)
    for at in places(text, ("section", "chapter", "part", "title", "paragraph", "clause", "each", "the"), ("sub",)) if _verbs_of(text)[0] else ():
        if (m := _subject.match(text, at)) and begins_clause(text, at):
            for kind in _BEGINS.get(m[0].lower(), ("section", "such")):
                if m.start() >= free[kind] and (h := HEADS[kind](text, m.start())):
                    found.append(h)
                    free[kind] = h.end
    out: list[Head] = []
    for h in sorted(found, key=lambda h: (h.start, -h.end)):
        if not out or h.start >= out[-1].end:
            out.append(h)
    return out


def declares_tax_code(text: str) -> bool:
    """Whether ``tax_code_spans`` has anything to look for in the structure of a bill."""
    return next(matches(_whenever, "whenever", text), None) is not None


def tax_code_spans(bill: Bill) -> list[Span]:
    """Where an unnamed section is one of the tax code, by a declaration at the head of the unit."""
    spans: list[Span] = []
    for m in matches(_whenever, "whenever", bill.text):
        r = Reader(bill.text, m.end())
        kind = r.say("division|Act|title|subtitle")
        code = words("Internal Revenue Code of 1986").search(bill.text, r.at)
        if not kind or not code or code.start() - r.at > TAX_REACH:
            continue
        starts = sorted(d.start for d in bill.divisions if d.label.split()[0].lower() == kind)
        k = bisect_right(starts, m.start())
        if kind == "act" or k == 0:
            return [(0, len(bill.text))]
        spans.append((starts[k - 1], starts[k] if k < len(starts) else len(bill.text)))
    return spans


class Targets:
    """Finds what a head amends; remembers the last target, which the next head may refer to."""

    def __init__(self, bill: Bill, cites: list[Citation]) -> None:
        self.cites, self.starts = cites, [c.start for c in cites]
        self.tax = tax_code_spans(bill)
        self.last: Citation | None = None

    def within(self, start: int, end: int) -> list[Citation]:
        return self.cites[bisect_right(self.starts, start - 1) : bisect_right(self.starts, end - 1)]

    def of(self, h: Head) -> Citation | None:
        here = self.within(h.start, h.end)
        codified = next((c for c in here if c.kind in ("usc", "cfr") and not c.note), None)
        act = next((c for c in here if c.kind == "act"), None)
        law = next((c for c in here if c.kind in ("publaw", "stat")), None)
        self.last = codified or act or (law and self._law(h, law)) or self._tax(h) or self._such_title(h) or self._such_unit(h)
        return self.last

    @staticmethod
    def _law(h: Head, c: Citation) -> Citation:
        if c.kind != "publaw" or not h.section or c.act_section:
            return c
        m = re.search(r"\bdiv(?:ision)?\.?\s+([A-Z]{1,2})\b", f"{h.inner}{h.unit} {h.middle}", re.I)
        return replace(c, act_section=h.section, subsection=h.subsection, division=m[1].upper() if m else None)

    @staticmethod
    def _implied(h: Head, key: str, title: str, section: str, path: str, text: str, why: str) -> Citation:
        return Citation("usc", text, h.start, h.end, title=title, section=section, subsection=path, implied=why, id=f"{key}{h.start}")

    def _tax(self, h: Head) -> Citation | None:
        if h.kind != "section" or h.unit.lower() != "section" or not any(a <= h.start < b for a, b in self.tax):
            return None
        if re.search(r"\bof\s+(?:the|such|title)\s", h.middle, re.I):
            return None
        return self._implied(h, "i", "26", h.section, h.subsection, f"section {h.section}{h.subsection}", "Internal Revenue Code of 1986")

    def _such_title(self, h: Head) -> Citation | None:
        if h.kind != "section" or h.unit.lower() != "section":
            return None
        if not re.search(r"\bsuch\s+title\b", h.middle, re.I) and h.inner.split()[-1:] != ["such"]:
            return None
        before = self.cites[: bisect_right(self.starts, h.start - 1)]
        c = next((c for c in reversed(before) if c.kind == "usc" and c.title), None)
        return c and self._implied(h, "s", c.title, h.section, h.subsection, f"section {h.section}{h.subsection} of title {c.title}", f"title {c.title}")

    def _such_unit(self, h: Head) -> Citation | None:
        t = self.last
        if not h.such or not h.subsection or not t or t.kind != "usc" or not t.title or not t.section or t.note:
            return None
        path = ("" if h.such == "section" else t.subsection or "") + h.subsection
        why = f"section {t.section} of title {t.title}"
        return self._implied(h, "u", t.title, t.section, path, f"{h.unit} of {why}", why)


# --- operations ------------------------------------------------------------------------------------------------------------------


def begun_in(what: re.Pattern, stem: str, text: str, start: int, end: int) -> Iterator[re.Match]:
    """``matches``, of matches that begin in a stretch of text but may end behind it."""
    for m in matches(what, stem, text, start):
        if m.start() >= end:
            break
        yield m


def read_block(text: str, at: int) -> Span | None:
    """The quoted block that follows, without its quotes: as far as the same convention closes it."""
    opener = _opener.search(text, at, at + BLOCK_WINDOW)
    if not opener or opener.start() - at > BLOCK_GAP or re.search("[`‘]", text[at : opener.start()]) or _block_verb.search(text[at : opener.end()]):
        return None
    start = opener.end()
    end = text.find(QUOTES[opener[0]], start)
    return (start, end) if 0 <= end and end - start <= MAX_BLOCK else None


class Body:
    """Reads the operations between a head and the next."""

    def __init__(self, text: str, start: int, end: int) -> None:
        self.text, self.start, self.end = text, start, end
        self.taken: list[Span] = []

    def _spanned(self, kind: str, span: Span, **rest) -> Op:
        return Op(kind, self.text[slice(*span)], *span, **rest)

    def _after(self, verb: re.Pattern, at: int = 0) -> Iterator[tuple[int, Reader]]:
        """(where it begins, reader behind it) of each such verb."""
        for m in matches(verb, _stems[verb], self.text, max(at, self.start), self.end):
            yield m.start(), Reader(self.text, m.end(), self.end)

    def _beside_quoted(self) -> Iterator[Op]:
        """``inserting after "X" ... "Y"``"""
        free = 0
        for start, r in self._after(_inserting):
            if start < free:
                continue
            r.say("immediately")
            side = r.say("after|before")
            r.blanks()
            if not side or not (anchor := r.quoted(MAX_ANCHOR)) or not (words_ := r.next_quoted(INSERT_GAP, MAX_OPERAND, _other_verb)):
                continue
            free = r.at
            self.taken.append((start, r.at))
            yield self._spanned("insert", words_, relation=side, anchor=self.text[slice(*anchor)])

    def _struck_marks(self) -> Iterator[Op]:
        """``striking the period at the end``, or a mark that another replaces"""
        for start, r in self._after(_striking):
            r.say("out")
            if r.say("the") and (mark := r.say(_MARKS)):
                at_end = r.say("at the end|at end")
                end = r.at
                if r.say("of|in"):
                    r.say("such")
                    if r.say(UNITS):
                        r.blanks()
                        r.path()
                        end = r.at
                r.at = end
                if not at_end:
                    r.say(",")
                    if not r.say("and insert|and inserting"):
                        continue
                yield self._spanned("strike", (start, end), operand=PUNCTUATION[mark], at_end=True, punctuation=True)

    def _inserted_marks(self) -> Iterator[Op]:
        """``inserting a semicolon``"""
        for start, r in self._after(_inserting):
            r.say("in lieu thereof")
            if r.say("a|an|the") and (mark := r.say(_MARKS)):
                self.taken.append((start, r.at))
                yield self._spanned("insert", (start, r.at), operand=PUNCTUATION[mark], punctuation=True)

    def _behind_units(self) -> Iterator[Op]:
        """``inserting after paragraph (8) the following: "(9) ..."``"""
        for start, r in self._after(_insert_word):
            r.say("immediately")
            if self.text[start - 1 : start].isalpha() or not r.say("after"):
                continue
            r.say("the")
            if r.say(UNITS) and r.blanks(1) and (unit := r.path()) and (block := read_block(self.text, r.at)):
                self.taken.append((start, max(r.at, block[1])))
                yield self._spanned("insert", block, unit_anchor=unit)

    def _quoted(self, kind: str, verb: re.Pattern, gap: int, unless: re.Pattern) -> Iterator[Op]:
        """Any other words struck or inserted. Behind what was taken before, the search goes on."""
        at = self.start
        while found := next(self._after(verb, at), None):
            start, r = found
            at = r.at
            if r.text[r.at : r.at + 1].isalpha() or not (span := r.next_quoted(gap, MAX_OPERAND, unless)):
                continue
            hit = next((s for s in self.taken if start < s[1] and r.at > s[0]), None)
            if hit:
                at = max(min(r.at, hit[1]), start + 1)
                continue
            at = r.at
            yield self._spanned(kind, span)

    def quoted_and_marks(self) -> list[Op]:
        ops = [*self._beside_quoted(), *self._struck_marks(), *self._inserted_marks(), *self._behind_units()]
        ops += self._quoted("strike", _striking, STRIKE_GAP, _no_insert)
        return ops + list(self._quoted("insert", _inserting, INSERT_GAP, _no_strike))

    @staticmethod
    def _listed(r: Reader) -> Span | None:
        """``paragraphs (2), (3), and (4)``"""
        r.blanks(1)
        start = r.at
        if not r.say(_LISTED_UNITS):
            return None
        r.blanks()
        if not r.marker():
            return None
        end = r.at
        while r.say(",|and|or|through"):
            r.blanks()
            if not r.marker():
                break
            end = r.at
        r.at = end
        return start, end

    def others(self, h: Head) -> list[Op]:
        ops = []
        for _, r in self._after(_redesignating):
            if (a := self._listed(r)) and r.say("as") and (b := self._listed(r)):
                ops.append(Op("redesignate", from_units=self.text[slice(*a)], to_units=self.text[slice(*b)]))
        moved = bool(ops)
        for _, r in self._after(_adding):
            block = read_block(self.text, r.at)
            ops.append(self._spanned("add-at-end", block) if block else Op("add-at-end"))
        if h.verb == "repealed":
            ops.append(Op("repeal"))
        if h.verb == "redesignated" and not moved:
            r = Reader(self.text, self.start, min(len(self.text), self.start + DESTINATION_WINDOW))
            while r.blanks(1) or r.text[r.at : r.at + 1] == ",":
                r.at += r.text[r.at : r.at + 1] == ","
            if r.say("as section") and (number := r.take(_destination)):
                ops.append(Op("redesignate", from_units=f"{h.unit} {h.section}{h.subsection}".strip(), to_units=f"section {number[0].strip()}{r.path()}"))
        return ops

    def _rewritten(self) -> Iterator[int]:
        """Where a block is announced that a provision is to read as."""
        for m in begun_in(_read_as, "to", self.text, self.start, self.end):
            yield m.end()
        for m in begun_in(words("by striking"), "by", self.text, self.start, self.end):
            r = Reader(self.text, m.end())
            r.say("the")
            if not (r.say(UNITS) and r.blanks(1) and r.path() and r.say("and inserting")):
                continue
            r.say("in lieu thereof")
            if r.say("the following"):
                yield r.at

    def replacements(self, ops: list[Op]) -> None:
        """Blocks that a provision is to read as; an operation already read from the same words becomes the replacement."""
        for at in self._rewritten():
            block = read_block(self.text, at)
            if not block:
                continue
            same = next((o for o in ops if o.start is not None and o.start < block[1] and o.end > block[0]), None)
            if same is None:
                same = Op("replace")
                ops.append(same)
            same.type, same.text, (same.start, same.end) = "replace", self.text[block[0] : block[1]], block
            same.placement = same.relation = same.anchor = None


def _past_closer(r: Reader) -> Reader:
    r.blanks()
    r.take(_closer)
    r.blanks()
    return r


def _links(text: str, at: int, end: int, mark: bool) -> bool:
    """Whether the words between a strike and an insertion make the second replace the first."""
    r = _past_closer(Reader(text, at, end))
    comma = r.say(",")
    if mark:
        r.say("and|or")
    else:
        if r.say(_EACH_PLACE):
            r.say(",")
        elif not comma:
            r.say(",")
        if not r.say("and insert|and inserting"):
            return False
        r.say("in lieu thereof")
        r.blanks()
        r.take(_opener)
    r.blanks()
    return r.at == end


def _unit_before(text: str, start: int) -> str | None:
    """The unit after which words are inserted that come last before a place."""
    low = max(0, start - UNIT_WINDOW)
    end = start
    for opener in QUOTES:
        bare = text[low:end].rstrip()
        if bare.endswith(opener):
            end = low + len(bare) - len(opener)
            break
    found = None
    for m in words("inserting after|insert after").finditer(text, low, end):
        r = Reader(text, m.end(), end)
        r.say("the")
        if not text[m.start() - 1 : m.start()].isalpha() and r.say(UNITS) and r.blanks(1) and (path := r.path()):
            if end - r.at <= UNIT_GAP and not _opener.search(text, r.at, end):
                found = found or path
    return found


def pair_up(text: str, ops: list[Op]) -> None:
    """Tell of each strike how often, and of each insertion where."""
    spans = sorted((o for o in ops if o.start is not None), key=lambda o: o.start)
    for before, op in zip([None, *spans], spans):
        if op.type == "strike":
            op.all = op.all or bool(words(_EACH_PLACE).search(text, op.end, op.end + AFTER_STRIKE))
            r = _past_closer(Reader(text, op.end, min(len(text), op.end + AFTER_STRIKE)))
            r.say(",")
            op.at_end = op.at_end or bool(r.say("at the end"))
        elif op.type == "insert" and not (op.relation and op.anchor) and not op.unit_anchor:
            if before and before.type == "strike" and op.start - before.end < PAIR_DISTANCE and _links(text, min(before.end, op.start), op.start, op.punctuation):
                op.replaces = before.start
                continue
            r = _past_closer(Reader(text, op.end, min(len(text), op.end + ANCHOR_WINDOW)))
            side = r.say("after|before")
            if side and r.blanks(1) and (anchor := r.quoted(MAX_ANCHOR_AFTER)):
                op.relation, op.anchor = side, text[slice(*anchor)]
            elif unit := _unit_before(text, op.start):
                op.unit_anchor = unit


# --- the walk --------------------------------------------------------------------------------------------------------------------


@dataclass
class Item:
    """Markers of one provision in a list, and where they stand."""

    markers: str
    start: int
    end: int


@dataclass
class UnitPhrase:
    """``paragraphs (1), (2), and (3)``"""

    unit: str
    items: list[Item]
    range: tuple[str, str] | None

    @property
    def depth(self) -> int:
        return mk.UNIT_DEPTH[self.unit]


@dataclass
class Phrase:
    """A unit phrase and those it is of, from the inside out."""

    start: int
    end: int
    units: list[UnitPhrase]


def _unit_phrase(r: Reader) -> UnitPhrase | None:
    start = r.at
    unit = r.say(UNITS)
    if not unit or not r.blanks(1):
        r.at = start
        return None
    first = r.at
    items: list[Item] = []
    while path := r.path():
        items.append(Item(path, r.at - len(path), r.at))
        end = r.at
        if not r.take(_separator):
            break
    if not items:
        r.at = start
        return None
    r.at = end
    spread = _range_word.search(r.text, first, end)
    if len(items) > 1:
        items = items[: len(mk.leading_style([x.markers for x in items]))]
    return UnitPhrase(unit.removesuffix("s"), items, (items[0].markers, items[-1].markers) if len(items) > 1 and spread else None)


@lru_cache(maxsize=64)  # a walk comes to a phrase twice
def phrase_at(text: str, at: int, end: int | None = None) -> Phrase | None:
    r = Reader(text, at, end)
    units: list[UnitPhrase] = []
    while unit := _unit_phrase(r):
        units.append(unit)
        stop = r.at
        if not r.say("of") or not r.blanks(1):
            break
    return Phrase(at, stop, units) if units else None


def phrases(text: str, at: int = 0, end: int | None = None, before: int | None = None) -> Iterator[Phrase]:
    """All in a stretch of text that begin ``before`` a place, none inside another."""
    free, stop = at, len(text) if end is None else end
    mark = text.find("(", at, stop)
    while mark >= 0:
        # The word before the parenthesis; one that is longer than any unit doesn't match at its cut.
        word = _last_word.search(text, max(at, _back(text, mark) - _LONGEST_UNIT), _back(text, mark))
        if word and before is not None and word.start() >= before:
            break
        if word and word.start() >= free and _unit_word.match(text, word.start(), stop) and (p := phrase_at(text, word.start(), end)):
            free = p.end
            yield p
        mark = text.find("(", mark + 1, stop)


def put(path: list[mk.Level], depth: int, markers: str) -> list[mk.Level]:
    return mk.above(path, depth) + [(m, depth + k) for k, m in enumerate(mk.markers(markers))]


def addresses(p: Phrase, at: list[mk.Level]) -> list[list[mk.Level]]:
    """An address for each item of the first unit, below the units it is of, below where the walk stands."""
    for outer in sorted(p.units[1:], key=lambda u: u.depth):
        at = put(at, outer.depth, outer.items[0].markers)
    first = p.units[0]
    return [put(at, first.depth, item.markers) for item in first.items]


def _stolen(text: str, at: int, end: int) -> bool:
    """Whether a list item is rather the marker of the next line."""
    line = text.rfind("\n", 0, max(at, 0)) + 1
    before = text[line:at].strip(" \t")
    if not line or (before and before not in QUOTES):
        return False
    r = Reader(text, end, end + LIST_WINDOW)
    while r.text[r.at : r.at + 1] in (" ", "\t"):
        r.at += 1
    return not (r.text[r.at : r.at + 1] in (",", ";", ".", ")") or r.marker() or (not r.text[r.at : r.at + 1].isspace() and r.say("and|or|through|to|of|as|respectively")))


def _gives_instruction(before: str, comma: bool) -> bool:
    """Whether an instruction may begin behind these words of a line: at its head, or behind a mark; ``(1) and by`` may come between."""
    before = without_last_marker(without_last(before, "and|by"))
    return not before or before.endswith(("--", "—", "–", ".", ";", ":")) or (comma and before.endswith(",")) or bool(re.search(r"\bamended\Z", before))


class Walk:
    """Follows the words that move through the amended provision, line by line."""

    def __init__(self, text: str, start: int, end: int, base: str) -> None:
        self.text = text
        self.here = [(m, k) for k, m in enumerate(mk.markers(base))]
        self.steps: list[Nav] = []
        self.refs: list[Nav] = []
        self.used: list[Span] = []
        self.quotes = list(_quotations(text, start, end))
        lines, at, inside = text[start:end].split("\n"), start, False
        for k, line in enumerate(lines):
            inside = inside or opens(line)
            if inside:
                inside = not closes(line)
            elif "(" in line or (k + 1 < len(lines) and "(" in lines[k + 1]):
                self._line(line, f"{line} {lines[k + 1]}" if k + 1 < len(lines) else line, at)
            at += len(line) + 1

    def _free(self, start: int, end: int, spans: list[Span]) -> bool:
        return not any(start < b and end > a for a, b in spans)

    def _emit(self, out: list[Nav], p: Phrase, at: int, found: list[list[mk.Level]]) -> None:
        first = p.units[0]
        for k, (item, path) in enumerate(zip(first.items, found)):
            start, end = at + (p.start if k == 0 else item.start), at + item.end
            if k == 0 or not _stolen(self.text, at + item.start, end):
                out.append(Nav(start, end, self.text[start:end], first.unit, item.markers, mk.join(path), range=first.range))

    def _leads(self, ways: str, probe: str, line: str, at: int) -> Iterator[tuple[int, Phrase]]:
        """(where the leading words begin, phrase behind them) of those that begin on the line, outside quotations."""
        for m in words(ways).finditer(probe):
            start = m.start()
            if start < len(line) and not probe[start - 1 : start].isalnum() and (p := phrase_at(probe, _skip(probe, m.end()))):
                if self._free(at + start, at + p.end, self.quotes):
                    yield start, p

    def _line(self, line: str, probe: str, at: int) -> None:
        for start, p in self._leads("in", probe, line, at):
            if _gives_instruction(probe[:start], False):
                found = addresses(p, self.here)
                self.used.append((at + p.start, at + p.end))
                self._emit(self.steps, p, at, found)
                self.here = found[0]
        for start, p in self._leads("in the matter preceding|in the matter following", probe, line, at) if "matter" in probe.lower() else ():
            path = addresses(p, self.here)[0]
            if len(path) > 1 and _gives_instruction(probe[:start], True):
                self.here = path[:-1]
                span = at + start, at + p.end
                self.used.append(span)
                self.steps.append(Nav(*span, self.text[slice(*span)], "matter", p.units[0].items[0].markers, mk.join(self.here), exact=True))
        for p in phrases(probe, before=len(line)):
            if self._free(at + p.start, at + p.end, self.quotes) and self._free(at + p.start, at + p.end, self.used):
                self._emit(self.refs, p, at, addresses(p, self.here))


def _back(text: str, at: int) -> int:
    while at and text[at - 1].isspace():
        at -= 1
    return at


def _skip(text: str, at: int) -> int:
    while text[at : at + 1].isspace():
        at += 1
    return at


def _quotations(text: str, start: int, end: int) -> Iterator[Span]:
    """Quotations from opener to the first closer of any convention."""
    at = start
    while (opener := _opener.search(text, at, end)) and (closer := _closer.search(text, opener.end(), end)):
        yield opener.start(), closer.end()
        at = closer.end()


# --- scopes ----------------------------------------------------------------------------------------------------------------------


def set_scopes(ops: list[Op], steps: list[Nav], base: str) -> None:
    """Where each operation works: the last step before it, else the head; blocks go to the level their own first marker asks for."""
    for op in ops:
        if op.start is not None:
            step = None
            for s in steps:
                if s.start > op.start:
                    break
                step = s
            if step:
                op.scope, op.exact = step.path, step.exact
            elif base:
                op.scope, op.scope_from_head = base, True
    for op in ops:
        if not op.text:
            continue
        if op.type == "add-at-end" and op.scope and (own := first_marker(op.text, quote=False)):
            op.scope = mk.join(mk.above(mk.levels(op.scope), mk.depth(own)))
        elif op.type == "insert" and op.unit_anchor and (own := first_marker(op.text)):
            chain = [x for x in mk.markers(op.unit_anchor) if mk.depth(x) <= mk.depth(own)]
            if chain:
                op.placement = "after-unit"
                if not (op.scope or "").endswith("".join(chain)):
                    op.scope = mk.join(mk.above(mk.levels(op.scope), mk.depth(chain[0]))) + "".join(chain)
        elif op.type == "replace" and (own := first_marker(op.text)) and not (op.scope or "").endswith(own):
            op.scope = (op.scope or "") + own


def mark_blocks(ops: list[Op], target: Citation | None) -> None:
    for op in ops:
        if op.type == "add-at-end" and target and target.et_seq:
            op.range_end = True
        block = op.type in ("add-at-end", "replace") or (op.type == "insert" and op.placement == "after-unit")
        if block and op.text:
            r = Reader(op.text, 0)
            r.blanks()
            r.take(_opener)
            r.blanks()
            op.new_section = bool(r.take(_new_section) or r.take(_new_part))


def _goes_on(text: str, at: int, end: int) -> bool:
    """Whether a reference continues into an address of its own, perhaps behind further items."""
    for _ in range(REF_ITEMS):
        r = Reader(text, at, end)
        r.take(_punctuation)
        r.take(_opener)
        r.blanks()
        start = r.at
        if _addressed(r):
            return True
        r.at = start
        r.say("and|or")
        r.blanks()
        if not r.path():
            return False
        at = r.at
    return False


def _addressed(r: Reader) -> bool:
    """``thereof``, ``of such Act``, ``of section 5``, ``of the Harbor Act``..."""
    if r.say("thereof"):
        return True
    if not r.say("of"):
        return False
    after = r.at
    if r.say("that|such"):
        return bool(r.say(f"{_SMALL_UNITS}|Act|title|chapter|determination"))
    if r.say("this"):
        return bool(r.say("Act|title|chapter"))
    if r.say("section|sections|title") and r.number():
        return True
    r.at = after
    the = r.say("the")
    if r.say("|".join(u + s for u in _SMALL_UNITS.split("|") for s in ("", "s"))):
        r.blanks()
        return r.text[r.at : r.at + 1] == "(" and r.at < r.end
    if not the or not r.blanks(1) or not r.text[r.at : r.at + 1].isalpha():
        return False
    name = re.match(rf"[^;.]{{0,{ACT_NAME}}}?(?:Act|Code)\b", r.text[r.at + 1 : r.end], re.I)
    return name is not None


class BlockRefs:
    """References inside new law, composed against the place where the block goes."""

    def __init__(self, text: str) -> None:
        self.text = text

    @cached_property
    def outline(self) -> Outline:
        return Outline(self.text)

    def read(self, start: int, end: int, walked: str | None) -> Iterator[Nav]:
        leading = first_marker(self.text[start:end])
        if not leading:
            return
        base = mk.above(mk.levels(walked), mk.depth(leading))
        own = {(m.marker, m.depth) for m in self.outline.between(start, end)}
        for p in phrases(self.text, start, end):
            if _goes_on(self.text, p.end, min(end, p.end + REF_WINDOW)):
                continue
            first = p.units[0]
            d = first.depth
            for k, (item, path) in enumerate(zip(first.items, addresses(p, base))):
                marker = mk.markers(item.markers)[0]
                sure = next((x for style, x in _SURE_STYLES if style.fullmatch(marker[1:-1])), d)
                gaps = any(x != n for n, (_, x) in enumerate(path))
                if (len(p.units) == 1 and (marker, d) in own) or sure != d or gaps or (k and _stolen(self.text, item.start, item.end)):
                    continue
                at = p.start if k == 0 else item.start
                yield Nav(at, item.end, self.text[at : item.end], first.unit, item.markers, mk.join(path), range=first.range, inserted=True)

    def of(self, ops: list[Op], target: Citation | None, steps: list[Nav], base: str, start: int, end: int) -> list[Nav]:
        if not target or target.kind not in ("usc", "cfr") or not target.section or target.et_seq or target.note:
            return []
        out: list[Nav] = []
        for m in begun_in(_read_as, "to", self.text, start, end):
            if block := read_block(self.text, m.end()):
                walked = base
                for s in steps:
                    if s.start > m.start():
                        break
                    walked = s.path
                out += self.read(*block, walked)
        for op in ops:
            added = (op.type == "add-at-end" and not op.range_end) or (op.type == "insert" and op.placement == "after-unit")
            if added and op.text and op.start is not None:
                out += self.read(op.start, op.end, op.scope)
        return out


# --- all of it -------------------------------------------------------------------------------------------------------------------


def listed(text: str, start: int, end: int) -> list[Span]:
    """Items (A), (B), (C)... of a list, as long as the letters follow each other."""
    marks = [(m[1][1:-1], m.start(1)) for m in _item.finditer(text, start, min(len(text), end + MAX_OPERAND)) if m.start() < end and len(m[1]) <= 5]
    run = 0
    while run < len(marks) and marks[run][0] == chr(65 + run):
        run += 1
    stops = [p for _, p in marks[1:]] + [end]
    return [(marks[k][1], stops[k]) for k in range(run)]


def _act_named(text: str) -> str | None:
    """The first Act that a text says something is of."""
    for m in re.finditer(r"of\s+the\s+(?=[A-Z])", text):
        act = re.match(rf"[A-Z][^(]{{2,{NAMED_ACT}}}?Act", text[m.end() :])
        if act:
            end = m.end() + act.end()
            year = _of_year.match(text, end)
            return text[m.end() : year.end() if year else end]
    return None


def _item_target(text: str, start: int, end: int) -> tuple[str, str, str]:
    """Unit, number and path of the provision that a list item names."""
    for m in re.finditer(r"(?:[Ss]ection|[Cc]hapter|[Pp]art|[Tt]itle)(?=\s)", text[start:end]):
        r = Reader(text, start + m.end(), end)
        if number := r.number():
            return m[0], number, r.path()
    return "Section", "", ""


def _spread(h: Head, text: str, items: list[Span], ops: list[Op], targets: Targets) -> Iterator[Amendment]:
    """One amendment for each listed provision, with the instruction's operations."""
    for start, end in items:
        here = targets.within(start, end)
        target = next((c for c in here if c.kind in ("usc", "cfr")), None) or next((c for c in here if c.kind == "act"), None)
        yield Amendment(
            start, end, *_item_target(text, start, end), h.verb, target, _act_named(text[start:end]),
            copy.deepcopy(ops), distributed=True, via_instruction=h.start,
        )


def _one(h: Head, end: int, ops: list[Op], body: Body | None, target: Citation | None, blocks: BlockRefs) -> Amendment:
    path = h.subsection + "".join(mk.markers(h.inner))
    cited = (target.subsection if target else "") or ""
    base = path if cited and path.startswith(cited) and len(path) > len(cited) else cited or path
    out = Amendment(h.start, end, h.unit, h.section, path, h.verb, target, _act_named(h.middle), ops)
    if body:
        walk = Walk(body.text, h.end, end, base)
        body.replacements(ops)
        set_scopes(ops, walk.steps, base)
        mark_blocks(ops, target)
        out.steps, out.refs = walk.steps, walk.refs + blocks.of(ops, target, walk.steps, base, h.end, end)
    return out


#: How far an instruction is read: what it amends, also the walk through it, or everything.
TARGET, WALK, ALL = 0, 1, 2


def extract(text: str, cites: list[Citation], bill: Bill, depth: int = ALL) -> list[Amendment]:
    """All of a text; what is beyond ``depth`` is left out."""
    found = heads(text)
    targets, blocks = Targets(bill, cites), BlockRefs(text)
    out: list[Amendment] = []
    for k, h in enumerate(found):
        end = min(found[k + 1].start if k + 1 < len(found) else len(text), h.end + MAX_BODY, len(text))
        target = targets.of(h)
        body = Body(text, h.end, end)
        ops: list[Op] = []
        # Of operations, only insertions and additions bring references of their own to the walk.
        if depth == ALL or (depth == WALK and any(folded(text).find(stem, h.end, end) >= 0 for stem in ("insert", "adding"))):
            ops = body.quoted_and_marks()
            pair_up(text, ops)
            ops += body.others(h)
        if h.kind == "each":
            colon = text.find(":", h.end)
            if items := listed(text, colon + 1 if 0 <= colon < end else h.end, end):
                out += _spread(h, text, items, ops, targets)
                continue
        out.append(_one(h, end, ops, body if depth > TARGET else None, target, blocks))
    for k, a in enumerate(out):
        a.id = f"a{k}"
    return out


def relative(cites: list[Citation], amendments: list[Amendment]) -> list[Citation]:
    """Steps and references as citations of the amended provision; they displace the citations they overlap."""
    extra: list[Citation] = []
    for a in amendments:
        t = a.target
        if not t or t.kind not in ("usc", "cfr"):
            continue
        head = a.subsection if not t.subsection else ""
        for n in a.steps + a.refs:
            extra.append(
                replace(
                    t, id=f"r{len(extra)}", text=n.text, start=n.start, end=n.end, subsection=n.path, relative=True, rel_unit=n.unit, rel_markers=n.markers,
                    rel_from=n.range[0] if n.range else None, rel_to=n.range[1] if n.range else None, via_amendment=a.id, via_target=t.text,
                    sub_from_head=head if head and n.path.startswith(head) else None, inserted_law=n.inserted,
                )
            )
    spans = sorted((e.start, e.end) for e in extra)
    starts = [s for s, _ in spans]
    reach = list(_running_max(e for _, e in spans))

    def displaced(c: Citation) -> bool:
        k = bisect_right(starts, c.end - 1)
        return k > 0 and reach[k - 1] > c.start

    return sorted([c for c in cites if not displaced(c)] + extra, key=lambda c: c.start)


def _running_max(values: Iterator[int]) -> Iterator[int]:
    most = -1
    for v in values:
        most = max(most, v)
        yield most


_verbs = re.compile(r"\b(?:is|are)\s+(?:amended|repealed)\b")


def uncovered(text: str, amendments: list[Amendment]) -> int:
    """Instructing verbs outside every amendment."""
    spans = sorted((a.via_instruction if a.via_instruction is not None else a.start, a.end) for a in amendments)
    starts = [s for s, _ in spans]
    reach = list(_running_max(e for _, e in spans))
    return sum(not (k := bisect_right(starts, m.start())) or reach[k - 1] < m.start() for m in _verbs.finditer(text))
