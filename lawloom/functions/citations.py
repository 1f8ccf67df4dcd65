"""Citations in one text.

A citation begins with a word or a number that tells what it may be; from there a reader takes its parts. What is found is put in the
order of the forms, which decides ties between spans of equal place, length and rank, and one pass settles overlaps.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from importlib import resources

from lawloom.functions.markers import ladder
from lawloom.functions.reading import MARKER, Reader, folded, matches, numbers, places
from lawloom.functions.structure import Block, block_at, quoted_blocks

# --- names of Acts ---------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True, eq=False)
class Act:
    entry_no: int
    name: str
    title: str
    section: str
    range: str
    enacted_as: str
    sections_match: bool
    offset_note: bool
    year_optional: bool = False
    other_names: tuple[str, ...] = ()

    @cached_property
    def names(self) -> tuple[str, ...]:
        """All its names, longest first."""
        own = (self.name, *self.other_names)
        bare = tuple(re.sub(r" of \d{4}$", "", n) for n in own) if self.year_optional else ()
        return tuple(sorted({*own, *bare}, key=lambda n: (-len(n), n)))

    @cached_property
    def pattern(self) -> str:
        """Its names as an expression: words may be parted by white space or dashes, commas may be missing, # is a digit."""
        return "(?:" + "|".join(map(_spelt, self.names)) + ")"

    @cached_property
    def exact(self) -> re.Pattern:
        return re.compile(rf"{self.pattern}\b")

    @cached_property
    def loose(self) -> re.Pattern:
        return re.compile(rf"{self.pattern}\b", re.I)


def _spelt(name: str) -> str:
    parts = [re.escape(w).replace("\\#", r"\d").replace(",", ",?").replace("'", "['’]") for w in re.split(r"[\s–—-]+", name)]
    return r"[\s–—-]+".join(parts)


@lru_cache(maxsize=1)
def popular_names() -> tuple[Act, ...]:
    lines = resources.files("lawloom.functions").joinpath("popular_names.tsv").read_text(encoding="utf-8").split("\n")[2:]
    acts = []
    for line in filter(None, lines):
        name, title, section, span, enacted, match, note, year, others = line.split("\t")
        acts.append(Act(len(acts), name, title, section, span, enacted, bool(match), bool(note), bool(year), tuple(filter(None, others.split("; ")))))
    return tuple(acts)


@lru_cache(maxsize=1)
def _acts_by_word() -> dict[str, tuple[Act, ...]]:
    """Acts by the first word of a name, in small letters."""
    found: dict[str, list[Act]] = {}
    for a in popular_names():
        for first in dict.fromkeys(_word.match(n)[0].lower() for n in a.names):
            found.setdefault(first, []).append(a)
    return {w: tuple(a) for w, a in found.items()}


_word = re.compile(r"[A-Za-z]+")
_whole_words = re.compile(r"\b[A-Za-z]+")


def acts_at(text: str, at: int) -> Iterator[tuple[Act, int]]:
    """Acts whose name stands at a place in just these letters, and where it ends."""
    if first := _word.match(text, at):
        for a in _acts_by_word().get(first[0].lower(), ()):
            if m := a.exact.match(text, at):
                yield a, m.end()


def find_act(name: str | None) -> Act | None:
    """By a name as a text gives it: first an Act of which it is the whole name, else one within it, in table order."""
    if not name:
        return None
    name = " ".join(name.split())
    whole = (a for a in popular_names() if re.fullmatch(a.pattern, name, re.I))
    part = (a for a in popular_names() if re.search(a.pattern, name, re.I))
    return next(whole, None) or next(part, None)


# --- citations -------------------------------------------------------------------------------------------------------------------


@dataclass
class Citation:
    kind: str
    text: str
    start: int
    end: int
    title: str | None = None
    section: str | None = None
    subsection: str | None = None
    et_seq: bool = False
    note: bool = False
    via_act: str | None = None
    sub_from_prose: bool = False
    unit: str | None = None
    part: str | None = None
    congress: str | None = None
    law: str | None = None
    act_name: str | None = None
    act_section: str | None = None
    act_title: str | None = None
    division: str | None = None
    where: list[str] | None = None
    short_title: str | None = None
    volume: str | None = None
    page: str | None = None
    ref_type: str | None = None
    scope: str | None = None
    inserted: Block | None = None
    implied: str | None = None
    relative: bool = False
    rel_unit: str | None = None
    rel_markers: str | None = None
    rel_from: str | None = None
    rel_to: str | None = None
    via_amendment: str | None = None
    via_target: str | None = None
    sub_from_head: str | None = None
    inserted_law: bool = False
    id: str = ""

    @property
    def ladder(self) -> list[str] | None:
        return None if self.subsection is None else ladder(self.subsection)


# Ranks of kinds where spans overlap; a note to the code ranks below a public law.
RANK = {"usc": 5.0, "cfr": 5.0, "publaw": 4.0, "stat": 4.0, "act": 3.0, "internal": 1.0}
NOTE_RANK = 3.5
# Limits, in characters and steps.
NOTE_WINDOW, UNIT_NAME, CHAIN_STEPS, SHORTEST_NAME, LONGEST_NAME, PROSE_TO_CODE = 8, 5, 4, 5, 140, 120

# Words and numbers that citations begin with or are made of.
_code = r"U\.?\s?S\.?\s?C\.?"
_dash = r"\s*[–—-]\s*"
_law = re.compile(rf"(?:Pub(?:lic)?\.?\s*L(?:aw)?\.?|P\.\s?L\.)\s*(?:No\.?\s*)?(\d{{1,3}}){_dash}(\d{{1,4}})")
_any_law = re.compile(rf"\b{_law.pattern}", re.I)
_stat = re.compile(r"\b(\d{1,3})\s+Stat\.\s*(\d{1,5})", re.I)
_title_of_code = re.compile(rf"\b(\d{{1,2}}[A-Z]?)\s*{_code}\s*", re.I)
_title_of_rules = re.compile(r"\b(\d{1,2})\s*C\.?\s?F\.?\s?R\.?\s*", re.I)
_signs = re.compile(r"§+\s*")
_code_section = re.compile(r"\d+[A-Za-z]*(?:[–—-]\s*\d+[A-Za-z]*)?")
_inner_section = re.compile(r"[0-9]+[A-Za-z0-9–—-]*")
_rule_number = re.compile(r"([0-9]+[A-Za-z]?)(\.[0-9]+[A-Za-z0-9-]*)?")
_code_title = re.compile(r"\s*(\d{1,2}[A-Z]?)(?=,)")
_act_title = re.compile(r"\s*([IVXLCDM]{1,7}|\d{1,3}[A-Z]?)\s+of\s+(?:the\s+)?")
_division_name = re.compile(r"[A-Z]{1,2}\Z")
_section = re.compile(rf"\b(sections?|sec\.)\s+([0-9]+[A-Za-z]*)((?:{MARKER})*)", re.I)
_small_units = re.compile(r"\b(subsections?|paragraphs?|subparagraphs?|clauses?)\s+(?=\()", re.I)
_units = "titles?|subtitles?|parts?|subparts?|chapters?|subchapters?|divisions?"
_unit_word = re.compile(rf"\b(?:{'|'.join(f'[{u[0].upper()}{u[0]}]{u[1:]}' for u in _units.split('|'))}|[Dd]iv\.)(?=\s)")
_step = re.compile(rf"({_unit_word.pattern[2:]})\s+([A-Za-z0-9]{{1,7}})\s+of\s+")
_bracket = re.compile(r"[();\n]")
_name_end = re.compile(r"[();]")
_no_name = re.compile(
    rf"\n[ \t]*\n|[Ss]ections?\s|{_unit_word.pattern[2:]}|\bas\s+(?:amended|added|authorized|enacted|in\s+effect|so)\b", re.M
)
_join = re.compile(r"\s*(?:,|and|or)(?=[\s(,])")
_note = re.compile(r"\s*note\b", re.I)
Step = tuple[str, str]


def _singular(unit: str) -> str:
    unit = unit.upper().rstrip(".").removesuffix("S")
    return "DIVISION" if unit == "DIV" else unit


def chain_division(steps: list[Step]) -> str | None:
    """The division that a chain of units names first."""
    return next((number.upper() for unit, number in steps if _singular(unit) == "DIVISION" and len(number) <= 2), None)


def chain_path(steps: list[Step], outer: str | None = None) -> list[str] | None:
    """Units of a chain that a text names from the inside out, outermost first."""
    path = [outer.upper()] if outer else []
    path += [f"{_singular(unit)} {number.upper()}" for unit, number in reversed(steps)]
    return path or None


def _chain(r: Reader, most: int = CHAIN_STEPS) -> list[Step]:
    """Steps such as ``title II of division B of``."""
    steps: list[Step] = []
    while len(steps) < most and (m := _step.match(r.text, r.at)) and len(m[2]) <= UNIT_NAME:
        steps.append((m[1], m[2]))
        r.at = m.end()
    return steps


def _cite(kind: str, text: str, start: int, end: int, **fields) -> Citation:
    return Citation(kind, text[start:end], start, end, **fields)


def _numbered(what: re.Pattern, text: str) -> Iterator[re.Match]:
    """``what.finditer`` for an expression that begins with a number."""
    free = 0
    for at in numbers(text):
        if at >= free and (m := what.match(text, at)):
            free = m.end()
            yield m


def _of_code(text: str) -> Iterator[Citation]:
    """``42 U.S.C. 1395x(s)(2) et seq.``"""
    for m in _numbered(_title_of_code, text):
        r = Reader(text, m.end())
        r.take(_signs)
        if number := r.take(_code_section):
            path = r.path()
            more = bool(r.say("et seq.|et seq|and following"))
            yield _cite("usc", text, m.start(), r.at, title=m[1], section="".join(number[0].split()), subsection=path, et_seq=more)


def _of_rules(text: str) -> Iterator[Citation]:
    """``40 CFR part 60`` and ``40 CFR 60.1(a)``."""
    for m in _numbered(_title_of_rules, text):
        r = Reader(text, m.end())
        r.take(_signs)
        unit = (r.say("part|parts|subpart|subparts|chapter|chapters|subchapter|subchapters") or "").removesuffix("s")
        r.blanks()
        if number := r.take(_rule_number):
            path = r.path()
            whole = number[2] is not None and not unit.startswith(("part", "chapter"))
            yield _cite(
                "cfr", text, m.start(), r.at, title=m[1], unit=unit or ("section" if whole else "part"), part=number[1] if whole else number[0],
                section=number[0] if whole else "", subsection=path,
            )


def _by_section(text: str, m: re.Match) -> Iterator[tuple[int, Citation]]:
    """What the words after ``section N(a)`` make of it, with the place of the form among all forms."""
    number, path = m[2], m[3]
    if m[1][1:] in ("ection", "ections"):
        yield from _by_outer(text, m)
    if m[1].lower() != "sections":
        r = Reader(text, m.end())
        if r.say("of this") and (scope := r.say("Act|title|section")):
            yield 13, _cite("internal", text, m.start(), r.at, ref_type="section", section=number, subsection=path, scope=scope)


def _by_outer(text: str, m: re.Match) -> Iterator[tuple[int, Citation]]:
    number, path, start = m[2], m[3], m.start()
    r = Reader(text, m.end())
    plain = r.say("of", True) and r.blanks(1)
    if plain:
        after = r.at
        if r.say("title", True) and (title := r.take(_code_title)):
            r.at += 1
            if r.say("United States Code", True):
                yield 1, _cite("usc", text, start, r.at, title=title[1], section=number, subsection=path)
        r.at = after
        if r.say("the", True) and r.blanks(1):
            for act, end in acts_at(text, r.at):
                if act.sections_match:
                    yield 2, _cite("usc", text, start, end, title=act.title, section=number, subsection=path, via_act=act.name)
        r.at = after
        steps = _chain(r)
        where = {"act_section": number, "subsection": path, "division": chain_division(steps), "where": chain_path(steps)}
        if law := _law.match(text, r.at):
            yield 8, _cite("publaw", text, start, law.end(), congress=law[1], law=law[2], **where)
        yield from _by_named_law(text, m, r, steps)
    r.at = m.end()
    while more := r.take(_join):  # further sections' paths: ``(a), (b), and (c)``
        r.blanks()
        r.path()
    if r.say("of", True) and r.blanks(1):
        steps = _chain(r)
        where = {"act_section": number, "subsection": path, "division": chain_division(steps), "where": chain_path(steps)}
        if r.say("the", True) and r.blanks(1):
            for act, end in acts_at(text, r.at):
                if act.enacted_as and not act.sections_match:
                    yield 5, _cite("act", text, start, end, act_name=act.name, **where)


def _by_named_law(text: str, m: re.Match, r: Reader, outer: list[Step]) -> Iterator[tuple[int, Citation]]:
    """``section 5 of the Harbor Act (33 U.S.C. 7; title II of Public Law 110-3)``: the units in the parentheses come before those outside."""
    if r.say("the", True):
        r.blanks()
    bracket = _name_end.search(text, r.at)
    if not bracket or bracket[0] != "(":
        return
    name = text[r.at : bracket.start()].rstrip()
    if not SHORTEST_NAME <= len(name) <= LONGEST_NAME or _no_name.search(text, r.at, bracket.start()):
        return
    r.at = bracket.end()
    r.blanks()
    stop = _bracket.search(text, r.at)
    if stop and stop[0] == ";" and re.search(rf"{_code}|Stat\.", text[r.at : stop.start()]):
        r.at = stop.end()
        r.blanks()
    inner = _chain(r)
    if law := r.take(_law):
        yield 10, _cite(
            "publaw", text, m.start(), r.at, congress=law[1], law=law[2], act_section=m[2], subsection=m[3], short_title=" ".join(name.split()),
            division=chain_division(inner) or chain_division(outer), where=chain_path(inner) or chain_path(outer),
        )


def _by_unit(text: str) -> Iterator[tuple[int, Citation]]:
    """Titles of Acts, and divisions of Acts and of public laws with the units inside them."""
    free: dict[int, int] = {}
    for start in places(text, ("title", "part", "chapter", "div"), ("sub",)):
        if not (m := _unit_word.match(text, start)):
            continue
        r = Reader(text, m.end())
        if m[0] in ("Title", "title", "Titles", "titles") and (t := r.take(_act_title)):
            for act, end in acts_at(text, r.at):
                if act.enacted_as:
                    yield 4, _cite("act", text, start, end, act_name=act.name, act_title=t[1].upper())
        r.at = start
        steps = _chain(r, CHAIN_STEPS + 1)
        if not steps or steps[-1][0][:2] not in ("Di", "di") or steps[-1][0].endswith(".") or not _division_name.match(steps[-1][1]):
            continue
        name = steps[-1][1].upper()
        if len(steps) <= CHAIN_STEPS and start >= free.get(-1, 0) and (law := _law.match(text, r.at)):
            free[-1] = law.end()
            yield 9, _cite("publaw", text, start, law.end(), congress=law[1], law=law[2], division=name, where=chain_path(steps))
        if any(_singular(unit) == "DIVISION" for unit, _ in steps[:-1]):
            continue
        if r.say("the", True):
            r.blanks()
        for act, end in acts_at(text, r.at):
            if start >= free.get(act.entry_no, 0):
                free[act.entry_no] = end
                yield 3, _cite("act", text, start, end, act_name=act.name, division=name, where=chain_path(steps[:-1], f"DIVISION {name}"))


def _by_small_unit(text: str) -> Iterator[tuple[int, Citation]]:
    """``subsection (h) of section 502 of the Harbor Act (42 U.S.C. 1472)``, and units of this bill."""
    for start in places(text, ("subsection", "paragraph", "clause"), ("sub",)):
        if not (m := _small_units.match(text, start)):
            continue
        r = Reader(text, m.end())
        if not (path := r.path()):
            continue
        end = r.at
        while r.take(_join):
            r.blanks()
            r.path()
        if m[1].islower() and r.say("of"):
            if r.say("such section", True) or (r.say("section|sections", True) and r.number()):
                r.path()
                bracket = _bracket.search(text, r.at)
                if bracket and bracket[0] == "(" and bracket.start() - r.at <= PROSE_TO_CODE and not re.search(r"[Ss]ections?\s", text[r.at : bracket.start()]):
                    r.at = bracket.end()
                    r.blanks()
                    if title := r.take(_title_of_code):
                        r.take(_signs)
                        if (number := r.take(_inner_section)) and r.say(")"):
                            section = "".join(number[0].split())
                            yield 11, _cite("usc", text, m.start(), r.at, title=title[1], section=section, subsection=path, sub_from_prose=True)
        unit = m[1].lower()
        if not unit.endswith("s"):
            yield from ((13, c) for c in _own_unit(text, m.start(), end, unit, path))


def _own_unit(text: str, start: int, end: int, unit: str, path: str) -> Iterator[Citation]:
    r = Reader(text, end)
    if r.say("of"):
        such = r.say("such")
        if r.say("section") and (number := r.number()):
            outer = r.path()
            if r.say("of this") and (scope := r.say("Act|title")):
                yield _cite("internal", text, start, r.at, ref_type="section", section=number, subsection=outer + path, scope=scope)
                return
        r.at = end
        if r.say("of") and (not such or r.say("such")) and r.say("section|title"):
            return
    yield _cite("internal", text, start, end, ref_type=unit, section="", subsection=path, scope="section")


def _names(text: str) -> Iterator[Citation]:
    """Names of Acts in letters of any case; each Act is looked for on from where its last name ended."""
    acts = _acts_by_word()
    firsts = acts.keys() & set(_word.findall(" ".join(set(folded(text).split()))))
    free: dict[int, int] = {}
    for at in places(text, tuple(firsts)):
        m = _whole_words.match(text, at)
        for a in acts.get(m[0].lower(), ()) if m else ():
            if m.start() >= free.get(a.entry_no, 0) and (name := a.loose.match(text, m.start())):
                free[a.entry_no] = name.end()
                yield _cite("act", text, m.start(), name.end(), act_name=a.name)


def forms(text: str) -> Iterator[tuple[int, Citation]]:
    """All that may be a citation, with the place of its form in the order of forms."""
    yield from ((0, c) for c in _of_code(text))
    for m in matches(_section, "sec", text):
        yield from _by_section(text, m)
    yield from _by_unit(text)
    yield from ((6, c) for c in _of_rules(text))
    yield from ((7, _cite("publaw", text, *m.span(), congress=m[1], law=m[2])) for at in places(text, ("pub", "p.")) if (m := _any_law.match(text, at)))
    yield from _by_small_unit(text)
    yield from ((12, _cite("stat", text, *m.span(), volume=m[1], page=m[2])) for m in _numbered(_stat, text))
    yield from ((14, c) for c in _names(text))


def rank(c: Citation) -> float:
    return NOTE_RANK if c.kind == "usc" and c.note else RANK[c.kind]


def settle(found: list[Citation]) -> list[Citation]:
    """Disjoint citations in order: left to right, each against the last one kept; the higher rank wins, then the longer span."""
    kept: list[Citation] = []
    for c in sorted(found, key=lambda c: (c.start, -c.end, -rank(c))):
        last = kept[-1] if kept else None
        if last is None or c.start >= last.end:
            kept.append(c)
        elif (rank(c), c.end - c.start) > (rank(last), last.end - last.start):
            kept[-1] = c
    return kept


def extract(text: str, blocks: list[Block] | None = None) -> list[Citation]:
    found = [c for _, c in sorted(forms(text), key=lambda x: x[0])]
    for c in found:
        c.note = c.kind == "usc" and bool(_note.match(text, c.end, c.end + NOTE_WINDOW))
    blocks = quoted_blocks(text) if blocks is None else blocks
    out = settle(found)
    for k, c in enumerate(out):
        c.id = f"c{k}"
        if c.kind == "internal":
            c.inserted = block_at(blocks, c.start)
    return out
