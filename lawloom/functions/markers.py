"""Outline markers such as ``(a)(2)(B)``: their depths, styles and paths, for one text and as Column expressions."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from lawloom.functions.reading import MARKER

_marker = re.compile(MARKER)
# Units and their depths.
UNIT_DEPTH = {"subsection": 0, "paragraph": 1, "subparagraph": 2, "clause": 3, "subclause": 4, "item": 5, "subitem": 6}
# The first style that a marker's body has decides its depth; any other body is a subparagraph.
STYLE_DEPTH = [
    (r"\d+", 1),
    (r"[IVXLC]{2,}", 4),
    (r"[ivxlc]{2,}", 3),
    (r"[a-z]{2}", 5),
    (r"[A-Z]{2}", 6),
    (r"[ivx]", 3),
    (r"[IVX]", 4),
    (r"[a-z]", 0),
    (r"[A-Z]", 2),
]
_styles = [(re.compile(p), d) for p, d in STYLE_DEPTH]
_numberings = [("digit", r"\d+"), ("lower", "[a-z]+"), ("upper", "[A-Z]+"), ("lower roman", "[ivxlcdm]+"), ("upper roman", "[IVXLCDM]+")]
_numberings = [(n, re.compile(p)) for n, p in _numberings]
_unsure = re.compile(r"\([ivxIVX]\)")

Level = tuple[str, int]


def markers(path: str | None) -> list[str]:
    return _marker.findall(path or "")


@lru_cache(maxsize=4096)
def depth(marker: str) -> int:
    body = marker[1:-1]
    return next((d for p, d in _styles if p.fullmatch(body)), 2)


def levels(path: str | None) -> list[Level]:
    """Markers with depths; one that may be a letter or a numeral goes right below what precedes it."""
    out: list[Level] = []
    for m in markers(path):
        below = out[-1][1] + 1 if out else 0
        out.append((m, below if _unsure.fullmatch(m) else depth(m)))
    return out


def join(path: list[Level]) -> str:
    return "".join(m for m, _ in path)


def above(path: list[Level], d: int) -> list[Level]:
    return [x for x in path if x[1] < d]


def ladder(path: str | None) -> list[str]:
    """The path's prefixes, from none of it to all."""
    ms = markers(path)
    return ["".join(ms[:k]) for k in range(len(ms) + 1)]


def numberings(marker: str) -> set[str]:
    body = re.sub(r"[()]", "", marker)
    return {n for n, p in _numberings if p.fullmatch(body)}


def leading_style(items: list[str]) -> list[str]:
    """Items of a list up to the first that fits no numbering of all before it."""
    common: set[str] | None = None
    for k, item in enumerate(items):
        first = markers(item)[:1]
        if not first:
            return items[: max(k, 1)]
        own = numberings(first[0])
        if own:
            shared = own if common is None else common & own
            if not shared:
                return items[: max(k, 1)]
            common = shared
    return items


def marker_depth(c: Column) -> Column:
    """``depth`` as an expression."""
    body = F.substring(c, F.lit(2), F.length(c) - 2)
    out = F.when(body.rlike(rf"\A(?:{STYLE_DEPTH[0][0]})\z"), STYLE_DEPTH[0][1])
    for p, d in STYLE_DEPTH[1:]:
        out = out.when(body.rlike(rf"\A(?:{p})\z"), d)
    return out.otherwise(2)


def path_markers(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({MARKER})"))


def path_ladder(c: Column) -> Column:
    """``ladder`` as an expression."""
    ms = path_markers(c)
    return F.transform(F.sequence(F.lit(0), F.size(ms)), lambda n: F.array_join(F.slice(ms, F.lit(1), n), ""))


def widened(c: Column) -> Column:
    """The path without its last marker; null at the root."""
    ms = path_markers(c)
    return F.when(F.size(ms) > 0, F.array_join(F.slice(ms, F.lit(1), F.size(ms) - 1), ""))
