"""References within a bill: which of its sections, or which provision near by, they mean."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from lawloom.functions import markers as mk
from lawloom.functions.citations import Citation
from lawloom.functions.reading import first_marker
from lawloom.functions.structure import Bill, Mark, Outline, Section


@dataclass
class Place:
    start: int
    section: Section
    ambiguous: bool = False
    guess: bool = False


def _division(s: Section | None) -> str:
    return s.ancestors[0].label if s and s.ancestors else ""


def section_named(bill: Bill, number: str, at: int) -> Section | None:
    """By number; of several, the first in the outermost division of the reference."""
    hits = [s for s in bill.sections if s.num == number]
    if len(hits) > 1:
        own = _division(bill.section_at(at))
        return next((s for s in hits if own and _division(s) == own), hits[0])
    return hits[0] if hits else None


def enclosing(marks: list[Mark], start: int, end: int, at: int, depth: int) -> tuple[int, int]:
    """The provision a reference stands in that is above ``depth``."""
    above = [m for m in marks if m.pos < at and m.depth < depth]
    inner = above[-1] if above else Mark(start, "", -1)
    stop = next((m.pos for m in marks if m.pos > inner.pos and m.depth <= inner.depth), end)
    return inner.pos, stop


def descend(outline: Outline, start: int, end: int, path: list[str]) -> list[int]:
    """Places of the last marker of a path, each marker sought inside the provisions of the one before."""
    spans = [(start, end)]
    for k, marker in enumerate(path):
        hits = [m for a, b in spans for m in outline.between(a, b) if m.marker == marker]
        if k == len(path) - 1:
            return [m.pos for m in hits]
        d = mk.depth(marker)
        spans = [(h.pos, next((m.pos for m in outline.between(h.pos + 1, end) if m.depth <= d), end)) for h in hits]
    return []


def locate(bill: Bill, outline: Outline, c: Citation) -> Place | None:
    path = mk.markers(c.subsection)
    if c.ref_type == "section" and c.section:
        s = section_named(bill, c.section, c.start)
        if not s:
            return None
        hits = descend(outline, s.start, s.end, path) if path else []
        return Place(hits[0] if hits else s.start, s)
    s = bill.section_at(c.start)
    if not s or not path:
        return None
    bounds = (c.inserted.start, c.inserted.end) if c.inserted else (s.start, s.end)
    depth = mk.UNIT_DEPTH.get(c.ref_type or "", mk.depth(path[0]))
    outside = lambda hits: [p for p in hits if not c.start <= p <= c.end]
    hits = outside(descend(outline, *enclosing(outline.between(*bounds), *bounds, c.start, depth), path))
    guess = not hits
    hits = hits or outside(descend(outline, *bounds, path))
    if not hits:
        return None
    return Place(min(hits, key=lambda p: abs(p - c.start)), s, guess or len(hits) > 1, guess)


def _fate_in_block(text: str, c: Citation, p: Place | None) -> str:
    """Of a reference in new law: found in its own block, above what the block begins with, or left alone."""
    if p and c.inserted.start <= p.start < c.inserted.end:
        return "inBlock"
    leading = first_marker(text[c.inserted.start : c.inserted.end])
    depth = mk.UNIT_DEPTH.get(c.ref_type or "")
    return "headAbove" if leading and depth is not None and depth < mk.depth(leading) else "declined"


def fates(bill: Bill, outline: Outline, cites: list[Citation]) -> Iterator[dict]:
    """What became of each internal reference that no composed citation displaced, and of those composed."""
    for c in cites:
        if c.relative:
            yield {"cite_id": c.id, "fate": "composed", "start": None, "section": None, "ambiguous": False, "guess": False}
        elif c.kind == "internal":
            p = locate(bill, outline, c)
            if c.inserted and c.ref_type != "section":
                fate = _fate_in_block(bill.text, c, p)
            else:
                fate = "inBill" if p else "unresolved"
            yield {"cite_id": c.id, "fate": fate, "start": p and p.start, "section": p and p.section.num, "ambiguous": bool(p and p.ambiguous), "guess": bool(p and p.guess)}
