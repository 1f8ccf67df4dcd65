"""Rows of text from positioned glyph runs of one page."""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

# Row tolerance, share of the page that can be margin, least gap, least numbers, share that must ascend, edge tolerance.
ROW, MARGIN, GAP, NUMBERS, ASCENDING, EDGE = 2, 0.35, 8, 4, 0.6, 2
_number = re.compile(r"\s*[0-9]{1,2}\s*")
_broken, _goes_on = re.compile("[a-z]-$"), re.compile("[a-z]")


@dataclass(slots=True)
class Run:
    x: float
    y: float
    width: float
    str: str


def rows_of(runs: list[Run]) -> list[list[Run]]:
    """Top to bottom; a row ends where a run lies lower than its first one by more than the tolerance."""
    out: list[list[Run]] = []
    for r in sorted((r for r in runs if r.str and r.str.strip()), key=lambda r: -r.y):
        if not out or out[-1][0].y - r.y > ROW:
            out.append([])
        out[-1].append(r)
    return [sorted(row, key=lambda r: r.x) for row in out]


def _column(by_edge: dict[int, list[int]]) -> tuple[int, int] | None:
    """(numbers, edge) of the fullest column whose numbers mostly count up."""
    best = None
    for edge, numbers in by_edge.items():
        steps = sum(b == a + 1 for a, b in zip(numbers, numbers[1:]))
        if len(numbers) >= NUMBERS and steps >= (len(numbers) - 1) * ASCENDING and (best is None or len(numbers) > best[0]):
            best = (len(numbers), edge)
    return best


def gutter(rows: list[list[Run]], page_width: float) -> tuple[str, int] | None:
    """(edge, place) of the column of line numbers; numbers set to the right win a tie."""
    left: dict[int, list[int]] = defaultdict(list)
    right: dict[int, list[int]] = defaultdict(list)
    for row in rows:
        if len(row) >= 2 and _number.fullmatch(row[0].str) and row[0].x <= page_width * MARGIN and row[1].x - row[0].x - row[0].width >= GAP:
            left[int(row[0].x + 0.5)].append(int(row[0].str))
            right[int(row[0].x + row[0].width + 0.5)].append(int(row[0].str))
    a, b = _column(left), _column(right)
    if b and (not a or b[0] >= a[0]):
        return "right", b[1]
    return ("left", a[1]) if a else None


def page_text(runs: list[Run], page_width: float) -> str:
    rows = rows_of(runs)
    side = gutter(rows, page_width)
    lines: list[str] = []
    for row in rows:
        if side and len(row) >= 2 and _number.fullmatch(row[0].str):
            edge = row[0].x + (row[0].width if side[0] == "right" else 0)
            row = row[1:] if abs(edge - side[1]) <= EDGE else row
        line, end = "", None
        for r in row:
            apart = end is not None and r.x - end > 1 and not line[-1:].isspace() and not r.str[:1].isspace()
            line += (" " if apart else "") + r.str
            end = r.x + r.width
        lines.append(" ".join(line.split()))
    return "\n".join(rejoin([x for x in lines if x]))


def rejoin(lines: list[str]) -> list[str]:
    """Words that a hyphen broke over lines."""
    out: list[str] = []
    for line in lines:
        if out and _goes_on.match(line) and _broken.search(out[-1]):
            out[-1] = out[-1][:-1] + line
        else:
            out.append(line)
    return out
