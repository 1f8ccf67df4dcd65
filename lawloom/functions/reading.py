"""A reader that moves over statutory text and takes what such text is made of: words, numbers, outline markers, quotations.

Whoever looks for a phrase finds the word it begins with, puts a reader there, and takes the parts one after the other; a part that
isn't there leaves the reader where it is. So each phrase of the law is a few lines of code, and its limits are numbers in them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

Span = tuple[int, int]

# The four conventions of quotation, opener and closer.
QUOTES = {"``": "''", "‘‘": "’’", "“": "”", '"': '"'}
#: The same as expressions, and an outline marker.
OPEN = "(?:" + "|".join(QUOTES) + ")"
CLOSE = "(?:" + "|".join(QUOTES.values()) + ")"
MARKER = r"\([A-Za-z0-9]{1,8}\)"

_blanks = re.compile(r"\s*")
_digits, _at_word = re.compile(r"\d+"), re.compile(r"\b")
_marker = re.compile(MARKER)
_path = re.compile(f"(?:{MARKER})+")
_opener = re.compile(OPEN)
_closer = re.compile(CLOSE)
_last_marker = re.compile(rf"{MARKER}\Z")
SECTION_NUMBER = re.compile(r"[0-9]+[A-Za-z]*")


@lru_cache(maxsize=None)
def words(ways: str, case: bool = False) -> re.Pattern:
    """Any of some wordings, parted by ``|``: a blank in one is any white space, and its last word ends there. With ``case``, only a first letter may be large or small."""
    out = []
    for way in sorted(ways.split("|"), key=len, reverse=True):
        way = r"\s+".join(map(re.escape, way.split()))
        if case:
            way = re.sub(r"^[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", way)
        out.append(way + (r"\b" if way[-1].isalnum() else ""))
    return re.compile("(?:" + "|".join(out) + ")", 0 if case else re.I)


@lru_cache(maxsize=4)
def folded(text: str) -> str:
    """The text in small letters, each in its place: what ``re.I`` takes for a letter of ASCII stands as that letter."""
    return text.lower() if text.isascii() else text.replace("İ", "i").lower().replace("ſ", "s").replace("ı", "i")


def matches(what: re.Pattern, stem: str, text: str, start: int = 0, end: int | None = None) -> Iterator[re.Match]:
    """``what.finditer`` for an expression whose every match begins with ``stem`` in letters of any case: the places where that stands are found without trying the expression at each."""
    low, stop = folded(text), len(text) if end is None else end
    at = low.find(stem, start, stop)
    while at >= 0:
        m = what.match(text, at, stop)
        if m:
            yield m
        at = low.find(stem, m.end() if m else at + 1, stop)


@lru_cache(maxsize=4)
def numbers(text: str) -> list[int]:
    """Where numbers begin that no word stands right before."""
    rest = text
    for c in () if text.isascii() else "“”‘’–—§":
        rest = rest.replace(c, "")
    if not rest.isascii():  # may have digits of other scripts
        return [m.start() for m in _digits.finditer(text) if _at_word.match(text, m.start())]
    out = []
    for digit in "0123456789":
        at = text.find(digit)
        while at >= 0:
            if _at_word.match(text, at):
                out.append(at)
            at = text.find(digit, at + 1)
    return sorted(out)


def places(text: str, stems: tuple[str, ...], before: tuple[str, ...] = ()) -> list[int]:
    """Where words may begin that have one of ``stems``, perhaps behind one of ``before``, in order."""
    low, out = folded(text), []
    for stem in stems:
        at = low.find(stem)
        while at >= 0:
            out.append(at - next((len(b) for b in before if low.startswith(b, max(0, at - len(b)), at)), 0))
            at = low.find(stem, at + 1)
    return sorted(set(out))


@lru_cache(maxsize=None)
def _said(ways: str, case: bool) -> re.Pattern:
    whole = words(ways, case)
    return re.compile(rf"\s*({whole.pattern})", whole.flags)


class Reader:
    """A place in a text, which moves on with each part taken, as far as ``end``."""

    __slots__ = ("text", "at", "end")

    def __init__(self, text: str, at: int, end: int | None = None) -> None:
        self.text, self.at, self.end = text, at, len(text) if end is None else end

    def take(self, what: re.Pattern) -> re.Match | None:
        m = what.match(self.text, self.at, self.end)
        if m:
            self.at = m.end()
        return m

    def blanks(self, least: int = 0) -> bool:
        start = self.at
        self.at = _blanks.match(self.text, start, self.end).end()
        return self.at - start >= least

    def say(self, ways: str, case: bool = False) -> str | None:
        """One of the wordings, after white space if there is any; its words in small letters with one blank between."""
        m = _said(ways, case).match(self.text, self.at, self.end)
        if m is None:
            return None
        self.at = m.end()
        said = m[1].lower()
        return said if said.isalpha() else " ".join(said.split())

    def number(self) -> str:
        """A section number after white space."""
        start = self.at
        if self.blanks(1) and (m := self.take(SECTION_NUMBER)):
            return m[0]
        self.at = start
        return ""

    def marker(self) -> str:
        m = self.take(_marker)
        return m[0] if m else ""

    def path(self) -> str:
        m = self.take(_path)
        return m[0] if m else ""

    def quoted(self, most: int) -> Span | None:
        """What the quotation that opens here holds, up to the first closer of any convention."""
        if m := _opener.match(self.text, self.at, self.end):
            if close := _closer.search(self.text, m.end() + 1, min(self.end, m.end() + most + 2)):
                if close.start() - m.end() <= most:
                    self.at = close.end()
                    return m.end(), close.start()
        return None

    def next_quoted(self, reach: int, most: int, unless: re.Pattern) -> Span | None:
        """What the next quotation holds that opens within ``reach`` characters, if no word of ``unless`` stands before it."""
        start = self.at
        for m in _opener.finditer(self.text, start, min(self.end, start + reach + 2)):
            if m.start() - start > reach or unless.search(self.text, start, m.start()):
                break
            self.at = m.start()
            if found := self.quoted(most):
                return found
        self.at = start
        return None


def opens(text: str) -> bool:
    """Whether the first thing in a line is the opening of a quotation."""
    return bool(_opener.match(text.lstrip()))


def closes(text: str) -> bool:
    """Whether a closer other than the plain mark stands in a line."""
    return "''" in text or "’’" in text or "”" in text


def first_marker(text: str, quote: bool = True) -> str:
    """The marker that a text begins with, after an opening quotation if ``quote``."""
    r = Reader(text, 0)
    r.blanks()
    if quote and r.take(_opener):
        r.blanks()
    return r.marker()


def without_last(text: str, ways: str) -> str:
    """Without a last word and the white space before and after it, if it is one of ``ways``."""
    bare = text.rstrip()
    for way in ways.split("|"):
        if len(bare) < len(text) and bare.lower().endswith(way):
            return bare[: -len(way)].rstrip()
    return bare


def without_last_marker(text: str) -> str:
    return _last_marker.sub("", text).rstrip()
