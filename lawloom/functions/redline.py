"""An amendment drawn on the law it amends: segments kept, deleted, inserted, or found to be in force already, and each operation's outcome.

Operations are used once, in document order of the provision's nodes; that makes the drawing sequential within one provision.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from lawloom.functions import markers as mk
from lawloom.functions.reading import OPEN, first_marker, without_last_marker

# Limits.
ENACTED_MIN, DISTINCTIVE, KNOWN_PREFIX, KNOWN_MIN, NEAR_MIN, NEAR_SPAN = 24, 4, 80, 24, 4, 40
REWRITE_SHARE, REWRITE_WORDS, LONG_WORD = 0.95, 8, 2
# What folding makes one character of: pairs of quotes, curly quotes, dashes, white space.
_same = [("\"", ("``", "''", "‘‘", "’’", "“", "”")), ("—", ("--", "–", "—"))]
_runs = re.compile("|".join(re.escape(x) for _, ways in _same for x in ways) + r"|\s+|[^\s]", re.S)
_folded = {x: one for one, ways in _same for x in ways}
_openers = re.compile(rf"^([ \t]*){OPEN}", re.M)
_EDGE = " \t\n\r\f\v;.,:"


@dataclass
class Folded:
    """Text with quotes, dashes, white space and case made one; each character knows its place."""

    norm: str
    start: list[int]
    end: list[int]


def fold(text: str) -> Folded:
    out, start, end = [], [], []
    for m in _runs.finditer(text):
        char = _folded.get(m[0]) or (" " if m[0].isspace() else m[0].lower())
        for c in char:
            out.append(c)
            start.append(m.start())
            end.append(m.end())
    return Folded("".join(out), start, end)


def norm(text: str) -> str:
    return fold(text).norm


def _word(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c == "_")


def occurrences(folded: Folded, needle: str | None) -> list[tuple[int, int]]:
    """Places of the needle; where it begins or ends with a word, only whole words."""
    n = norm(needle or "").strip()
    out, hay = [], folded.norm
    at = hay.find(n) if n else -1
    while at >= 0:
        after = at + len(n)
        cut = (_word(n[0]) and at > 0 and _word(hay[at - 1])) or (_word(n[-1]) and after < len(hay) and _word(hay[after]))
        if not cut:
            out.append((folded.start[at], folded.end[after - 1]))
        at = hay.find(n, at + 1)
    return out


def place_scope(scope: str, from_head: bool, paths: set[str]) -> tuple[str, str | None, bool]:
    """(scope, scope before, lost): a scope the provision has; shortened from its end, else from its front, else the whole if only the head named it."""
    exists = lambda s: any(p.startswith(s) for p in paths)
    if not scope or exists(scope):
        return scope, None, False
    ms = mk.markers(scope)
    for other in ["".join(ms[:k]) for k in range(len(ms) - 1, 0, -1)] + ["".join(ms[k:]) for k in range(1, len(ms))]:
        if exists(other):
            return other, scope, False
    return ("", scope, False) if from_head else (scope, None, True)


def in_law(whole: str, added: str) -> bool:
    """Whether the law already holds the beginning of an addition."""
    needle = norm(_openers.sub(r"\1", added)).strip()[:KNOWN_PREFIX].strip()
    return len(needle) >= KNOWN_MIN and needle in norm(whole)


def beside(text: str, at: int, added: str) -> bool:
    """Whether an addition already stands at its place."""
    needle = norm(added).strip(_EDGE)
    if len(needle) < NEAR_MIN:
        return False
    span = len(needle) + NEAR_SPAN
    after = norm(text[at : at + span]).lstrip(_EDGE)
    before = norm(text[max(0, at - span) : at]).rstrip(_EDGE)
    return after.startswith(needle) or before.endswith(needle)


def rewrite_in_force(provision: str, block: str) -> bool:
    """Whether nearly all words of a replacement stand in the provision."""
    words = lambda s: [w for w in re.split("[^a-z0-9]+", norm(_openers.sub(r"\1", s))) if len(w) > LONG_WORD]
    want = words(block)
    have = set(words(provision))
    return bool(provision) and len(want) >= REWRITE_WORDS and sum(w in have for w in want) / len(want) >= REWRITE_SHARE


@dataclass
class Work:
    """One operation and what became of it."""

    seq: int
    type: str
    text: str | None
    start: int | None = None
    scope: str = ""
    exact: bool = False
    all: bool = False
    at_end: bool = False
    replaces: int | None = None
    relation: str | None = None
    anchor: str | None = None
    placement: str | None = None
    range_end: bool = False
    new_section: bool = False
    from_head: bool = False
    widened: str | None = None
    lost: bool = False
    outcome: str | None = None

    @property
    def structural(self) -> bool:
        return self.type == "add-at-end" or (self.type == "insert" and self.placement == "after-unit")


@dataclass
class Mark:
    start: int
    end: int
    kind: str


@dataclass
class Redline:
    ops: list[Work]
    whole: str
    stale: bool = False
    struck: dict[int, tuple[int, int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        folded = fold(self.whole)
        live = [o for o in self.ops if o.text is not None and not o.lost]
        self.work = [o for o in live if o.type in ("strike", "insert") and not o.structural]
        self.additions = [o for o in live if o.structural]
        self.replacements = [o for o in live if o.type == "replace"]
        telling = [o for o in self.work if o.type == "strike" and sum(c.isascii() and c.isalnum() for c in o.text) >= DISTINCTIVE]
        self.stale = bool(telling) and not any(occurrences(folded, o.text) for o in telling)

    def _open(self, kind: str, path: str) -> list[Work]:
        fits = lambda o: not o.scope or (path == o.scope if o.exact else path.startswith(o.scope))
        return [o for o in self.work if o.type == kind and o.outcome is None and fits(o)]

    def apply(self, text: str, path: str) -> list[tuple[str, str]]:
        """Segments of one passage."""
        if not text or not self.work:
            return [("keep", text)] if text else []
        folded = fold(text)
        marks: list[Mark] = []
        added: list[tuple[int, str]] = []
        here: set[int] = set()
        for o in self._open("strike", path):
            hits = occurrences(folded, o.text)
            if hits and not o.all:
                hits = hits[-1:] if o.at_end else hits[:1]
                if o.at_end and text[hits[0][1] :].strip(_EDGE):
                    continue
            if hits:
                marks += [Mark(*h, "del") for h in hits]
                o.outcome = "drawn"
                self.struck[o.start] = hits[-1]
                here.update(h[0] for h in hits)
        for o in self._open("insert", path):
            if o.replaces is not None:
                spot = self.struck.get(o.replaces)
                if spot and spot[0] in here:
                    if not self.stale:
                        added.append((spot[1], o.text))
                        o.outcome = "drawn"
                elif self.stale and len(o.text.strip()) >= ENACTED_MIN:
                    self._enacted(o, folded, marks, here, None)
            elif o.anchor and (hits := occurrences(folded, o.anchor)):
                at = hits[0][0] if o.relation == "before" else hits[0][1]
                if beside(text, at, o.text):
                    self._enacted(o, folded, marks, here, at)
                elif not self.stale:
                    added.append((at, o.text))
                    o.outcome = "drawn"
        return weave(text, marks, added)

    @staticmethod
    def _enacted(o: Work, folded: Folded, marks: list[Mark], here: set[int], near: int | None) -> None:
        hits = occurrences(folded, o.text)
        if hits:
            hit = min(hits, key=lambda h: abs(h[0] - near)) if near is not None else hits[-1] if o.at_end else hits[0]
            marks.append(Mark(*hit, "was"))
            here.add(hit[0])
            o.outcome = "enacted"

    def added_at(self, path: str) -> list[Work]:
        """Blocks to draw at the end of a provision."""
        out = []
        for o in self.additions:
            if o.outcome is None and o.scope == path:
                skipped = o.range_end or o.new_section
                o.outcome = "skipped" if skipped else "applied" if in_law(self.whole, o.text) else "withheld" if self.stale else "drawn"
                if o.outcome == "drawn":
                    out.append(o)
        return out

    def replaced_at(self, path: str, provision: str) -> Work | None:
        o = next((o for o in self.replacements if o.outcome is None and o.scope == path), None)
        if o:
            o.outcome = "in_force" if rewrite_in_force(provision, o.text) else "marked"
        return o

    def applied_paths(self) -> set[str]:
        """Paths of provisions that an addition already in the law brought."""
        out = set()
        for o in self.additions:
            if in_law(self.whole, o.text):
                base = without_last_marker(o.scope) if o.placement == "after-unit" else o.scope
                out |= {base + own for line in o.text.split("\n") if (own := first_marker(line))}
        return out

    def close(self) -> None:
        """Outcomes of what found no place."""
        for o in self.ops:
            if o.outcome is None:
                o.outcome = (
                    "lost" if o.lost
                    else "stranded" if o.structural or o.type == "replace"
                    else ("withheld" if self.stale else "missing") if o.type in ("strike", "insert") and o.text is not None
                    else "none"
                )


def weave(text: str, marks: list[Mark], added: list[tuple[int, str]]) -> list[tuple[str, str]]:
    """Marks that do not overlap and insertions by place; where both meet, the mark comes first."""
    events: list[tuple[int, int, int, Mark | str]] = []
    reach = 0
    for m in sorted(marks, key=lambda m: (m.start, -m.end)):
        if m.start >= reach or not events:
            events.append((m.start, 0, len(events), m))
            reach = m.end
    events += [(at, 1, k, s) for k, (at, s) in enumerate(sorted(added, key=lambda x: x[0]))]
    out: list[tuple[str, str]] = []
    cursor = 0
    for at, _, _, what in sorted(events, key=lambda e: e[:3]):
        if at > cursor:
            out.append(("keep", text[cursor:at]))
            cursor = at
        if isinstance(what, Mark):
            out.append((what.kind, text[what.start : what.end]))
            cursor = max(cursor, what.end)
        else:
            out.append(("ins", re.sub(r"\s+", " ", what)))
    out.append(("keep", text[cursor:]))
    return [x for x in out if x[1]]


@dataclass
class Node:
    path: str
    marker: str
    heading: str
    text: str


def _subtree(nodes: list[Node], k: int, with_headings: bool) -> str:
    own = nodes[k].path
    lines = []
    for n in nodes[k:]:
        if not n.path.startswith(own):
            break
        head = f"{n.heading}.--" if with_headings and n.heading else ""
        lines.append(f"{n.marker} {head}{n.text}".strip())
    return "\n".join(lines)


def draw(ops: list[Work], lead: str, nodes: list[Node]) -> tuple[list[tuple[str, str, str]], Redline]:
    """(path, kind, text) of all segments of a section whose nodes come in preorder, and the operations with their outcomes."""
    paths = {n.path for n in nodes}
    for o in ops:
        if paths:
            o.scope, o.widened, o.lost = place_scope(o.scope, o.from_head, paths)
    whole = "\n".join([lead, *(f"{n.marker} {n.text}".strip() for n in nodes)])
    red = Redline(ops, whole)
    out = [("", kind, text) for kind, text in red.apply(lead, "")]
    open_paths: list[str] = []

    def leave(until: str | None) -> None:
        while open_paths and (until is None or not until.startswith(open_paths[-1])):
            path = open_paths.pop()
            out.extend((path, "ins", o.text) for o in red.added_at(path))

    for k, n in enumerate(nodes):
        leave(n.path)
        if o := red.replaced_at(n.path, _subtree(nodes, k, True)):
            out.append((n.path, "ins" if o.outcome == "marked" else "was", o.text))
        out += [(n.path, kind, text) for kind, text in red.apply(n.text, n.path)]
        open_paths.append(n.path)
    leave(None)
    out += [("", "ins", o.text) for o in red.added_at("")]
    red.close()
    return out, red
