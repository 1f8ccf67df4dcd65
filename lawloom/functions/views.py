"""A bill as it is shown: paragraphs, the citations that tile them, and the instructions that open or cover them."""

from __future__ import annotations

from dataclasses import dataclass

from lawloom.functions.reading import first_marker, opens
from lawloom.functions.structure import Bill, continues_heading, lines_of, section_head, unit_label, wrapped

_UNIT_WORDS = ("DIVISION", "TITLE", "Subtitle", "CHAPTER", "SECTION", "SEC.")


def _begins(line: str) -> bool:
    """Whether a line opens a paragraph: with a marker, a quotation, a unit's name or a number with a period."""
    first, _, rest = line.strip().partition(" ")
    if opens(line) or first_marker(line, quote=False):
        return True
    return (first in _UNIT_WORDS and bool(rest)) or (first[:-1].isdigit() and first.endswith(".") and bool(rest))


@dataclass
class Paragraph:
    start: int
    end: int
    kind: str
    section: str | None


def paragraphs(bill: Bill) -> list[Paragraph]:
    heads = {s.start: s for s in bill.sections}
    out: list[Paragraph] = []
    now: Paragraph | None = None
    title, closed, counted = "", False, False
    before: str | None = None
    for start, line in lines_of(bill.text):
        end = start + len(line)
        previous, before = before, line
        if not line.strip():
            now = None
            continue
        heading = now is not None and now.kind in ("section", "division")
        if heading and not closed and continues_heading(line, title):
            now.end = end
            title += line.strip() if title.endswith("-") else " " + line.strip()
            closed = counted and title.rstrip().endswith(".")
            continue
        sec, unit = heads.get(start), (unit_label(line) or ("", None))[1]
        begins = _begins(line) and not (first_marker(line, quote=False) and wrapped(previous, line))
        if now is None or sec or unit or begins or heading:
            kind = ("run_in" if sec.run_in else "section") if sec else "division" if unit else "text"
            now = Paragraph(start, end, kind, sec.num if sec else None)
            head = section_head(line)
            counted = head is not None and not head.run_in
            title = head.heading if counted else line
            closed = counted and title.rstrip().endswith(".")
            out.append(now)
        else:
            now.end = end
    return out


def tiles(paras: list[Paragraph], cites: list[tuple[int, int, str]]) -> list[tuple[int, int, int, str | None]]:
    """(paragraph, start, end, citation or none): the text of each paragraph; a citation stays whole where it starts."""
    out: list[tuple[int, int, int, str | None]] = []
    cites = sorted(cites, key=lambda c: c[0])
    used, k = 0, 0
    for n, p in enumerate(paras):
        at = max(p.start, used)
        while k < len(cites) and cites[k][0] < at:
            k += 1
        while at < p.end and k < len(cites) and cites[k][0] < p.end:
            start, end, cid = cites[k]
            k += 1
            if start < at:
                continue
            if start > at:
                out.append((n, at, start, None))
            out.append((n, start, end, cid))
            at = end
        if at < p.end:
            out.append((n, at, p.end, None))
            at = p.end
        used = max(used, at)
    return out
