"""Deeply nested semi-structured records, shredded into columns and put together again as flat tables.

A file holds a record and ``also`` further ones, its entries; an entry has notes, and a tree of provisions of unknown depth. The shredder
walks a file once and writes a column for each leaf path, that is for each field of an entry, of a note, and of a provision at each
depth of ``children``. A column has the repetition level of every entry of it (0 begins a file, 1 another entry, 2 + j another element
at depth j below), the definition level (how many of the repeated ancestors exist, and at the full number of them whether the field is
absent, null or has a value) and the values alone. Where an element has nothing below it, one entry of a lower definition level stands in
the columns right below; deeper ones are implied.

The tables (one for each repeated ancestor: entries, notes, provisions) are rebuilt from the level sequences, a whole batch at a time:
the rows of a depth are its entries of full ancestry, the parent of a row is found by counting the entries that begin a new parent, and
the preorder number of a row follows from the sizes of the subtrees before it.

There is no shuffle but the one that removes repeated rows.

Defined results: content that is null, cut off or no JSON object gives no row, at whatever depth it ends; a tree, ``children``, ``notes`` or ``also`` may be a list, one
object, or either as a JSON string; what is neither (null, a number, an empty
object, a broken string) holds nothing, also inside a list; an absent,
null or empty path is the parent's path followed by the marker, and ``path_is`` tells which it was; an ``also`` element that is no record still takes its number.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Definition levels above the number of the ancestors: the field is absent, null, or has a value.
ABSENT, NULL, VALUE = 0, 1, 2
STATES = np.array(["absent", "null", "value"])
ENTRY = {"title": "title", "section": "section", "heading": "heading", "lead": "lead", "source_credit": "sourceCredit", "release_point": "releasePoint"}
NOTE = {"topic": "topic", "heading": "heading", "text": "text"}


_TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\.)*")|([^\s\[\]{},:"]+))')
_END = re.compile(r"[ \t\n\r]*\Z")


def _deep(text: str):
    """What ``json.loads`` gives, at any depth: containers are kept on a list, only strings, numbers and words are left to ``json``."""
    done: list = []  # the value, once it is whole
    open_: list[tuple[list | dict, str | None]] = []  # container and, in an object, the key whose value comes
    state, at = "value", 0
    while match := _TOKEN.match(text, at):
        at = match.end()
        mark, string, other = match.groups()
        inside = open_[-1][0] if open_ else None
        if state in ("value", "first value") and mark in ("[", "{"):
            open_.append(([], None) if mark == "[" else ({}, None))
            state = "first value" if mark == "[" else "first key"
            continue
        if state in ("value", "first value") and not mark:
            value = json.loads(string or other)
        elif state in ("key", "first key") and string:
            open_[-1] = (inside, json.loads(string))
            state = "colon"
            continue
        elif state == "colon" and mark == ":":
            state = "value"
            continue
        elif state == "more" and open_ and mark == ",":
            state = "key" if isinstance(inside, dict) else "value"
            continue
        elif open_ and (state in ("more", "first value") and mark == "]" and isinstance(inside, list) or state in ("more", "first key") and mark == "}" and isinstance(inside, dict)):
            value = open_.pop()[0]
        else:
            raise ValueError(f"no JSON at {match.start()}")
        if not open_:
            done.append(value)
            break
        above, key = open_[-1]
        if isinstance(above, dict):
            above[key] = value
        else:
            above.append(value)
        state = "more"
    if not done or not _END.match(text, at):
        raise ValueError("no whole JSON value")
    return done[0]


def _load(text: str):
    try:
        return json.loads(text)
    except RecursionError:
        return _deep(text)


def _objects(value) -> list[dict]:
    """The objects a repeated field holds, whatever shape it was written in."""
    if isinstance(value, str):
        try:
            value = _load(value)
        except ValueError:
            return []
    if isinstance(value, dict):
        value = [value]
    return [x for x in value if x and isinstance(x, dict)] if isinstance(value, list) else []


def _elements(value) -> list:
    """Like ``_objects``, but elements keep their numbers."""
    if isinstance(value, str):
        try:
            value = _load(value)
        except ValueError:
            return []
    return [value] if isinstance(value, dict) else value if isinstance(value, list) else []


def _written(value) -> str:
    """What ``json.dumps`` gives, at any depth."""
    out: list[str] = []
    stack = [(value, False)]
    while stack:
        x, plain = stack.pop()
        if plain:
            out.append(x)
        elif isinstance(x, (dict, list)) and x:
            inside = [(k, v) for k, v in x.items()] if isinstance(x, dict) else [(None, v) for v in x]
            parts = [("{" if isinstance(x, dict) else "[", True)]
            for n, (k, v) in enumerate(inside):
                parts.append((", " * (n > 0) + (json.dumps(k, ensure_ascii=False) + ": " if k is not None else ""), True))
                parts.append((v, False))
            parts.append(("}" if isinstance(x, dict) else "]", True))
            stack += reversed(parts)
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


def _leaf(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if not isinstance(value, list):
        try:
            return json.dumps(value, ensure_ascii=False)
        except RecursionError:
            return _written(value)
    frames: list[tuple] = [(iter(value), [])]
    while True:
        rest, lines = frames[-1]
        for x in rest:
            if isinstance(x, list):
                frames.append((iter(x), []))
                break
            if x is not None:
                lines.append(_leaf(x))
        else:
            frames.pop()
            if not frames:
                return "\n".join(lines)
            frames[-1][1].append("\n".join(lines))


class Column:
    """A leaf path: a repetition and a definition level for each entry, and the values where there are any."""

    __slots__ = ("rep", "full", "values", "ancestors")

    def __init__(self, ancestors: int) -> None:
        self.ancestors = ancestors
        self.rep: list[int] = []
        self.full: list[int] = []
        self.values: list = []

    def none(self, r: int, existing: int) -> None:
        self.rep.append(r)
        self.full.append(existing)

    def put(self, r: int, element: dict, name: str) -> None:
        self.rep.append(r)
        value = element.get(name)
        if value is not None:
            self.full.append(self.ancestors + VALUE)
            self.values.append(value if isinstance(value, str) else _leaf(value))
        else:
            self.full.append(self.ancestors + (NULL if name in element else ABSENT))

    def levels(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.rep, np.int64), np.array(self.full, np.int64)

    def rows(self) -> list:
        """The field of every element: its value, or none."""
        level = np.array(self.full, np.int64)
        out = np.full(len(level), None, object)
        out[level == self.ancestors + VALUE] = self.values
        return out[level >= self.ancestors].tolist()

    def states(self) -> np.ndarray:
        level = np.array(self.full, np.int64)
        return STATES[level[level >= self.ancestors] - self.ancestors]


class Group:
    """The columns of the fields of one repeated element."""

    def __init__(self, fields: tuple[str, ...], ancestors: int) -> None:
        self.columns = {f: Column(ancestors) for f in fields}
        self.all = list(self.columns.items())

    def none(self, r: int, existing: int) -> None:
        for _, c in self.all:
            c.none(r, existing)

    def put(self, r: int, element: dict) -> None:
        for f, c in self.all:
            c.put(r, element, f)

    def levels(self) -> tuple[np.ndarray, np.ndarray]:
        return self.all[0][1].levels()


class Shredder:
    """Columns of one batch: fields of entries, of their notes, and of provisions by depth. Only fields asked for are written."""

    def __init__(self, entry: tuple[str, ...] = (), note: tuple[str, ...] = (), leaves: tuple[str, ...] = ()) -> None:
        self.files: list[int] = []
        self.entry = Group(entry or ("section",), 1)
        self.note = Group(note, 2) if note else None
        self.leaves = leaves
        self.depths: list[Group] = []

    def _depth(self, k: int) -> Group:
        if k == len(self.depths):
            self.depths.append(Group(self.leaves, k + 2))
        return self.depths[k]

    def add(self, shard_id: int, record: dict) -> None:
        self.files.append(shard_id)
        for k, one in enumerate([record, *_elements(record.get("also"))]):
            r = min(k, 1)
            if not isinstance(one, dict):
                self.entry.none(r, 0)
                if self.note:
                    self.note.none(r, 0)
                if self.leaves:
                    self._depth(0).none(r, 0)
                continue
            self.entry.put(r, one)
            if self.note:
                notes = _objects(one.get("notes"))
                for n, note in enumerate(notes):
                    self.note.put(2 if n else r, note)
                if not notes:
                    self.note.none(r, 1)
            if self.leaves:
                self._tree(r, _objects(one.get("tree")))

    def _tree(self, r: int, top: list[dict]) -> None:
        if not top:
            self._depth(0).none(r, 1)
            return
        # (depth, siblings still to write, repetition level of the next one); 2 + k is another sibling at depth k
        stack = [(0, iter(top), r)]
        while stack:
            k, siblings, r = stack[-1]
            node = next(siblings, None)
            if node is None:
                stack.pop()
                continue
            stack[-1] = (k, siblings, k + 2)
            self._depth(k).put(r, node)
            below = node.get("children")
            kids = _objects(below) if below else ()
            # seen from the column below, a new parent begins: the level is at most k + 2
            if kids:
                stack.append((k + 1, iter(kids), r))
            else:
                self._depth(k + 1).none(r, k + 2)


def _entries(s: Shredder) -> tuple[np.ndarray, np.ndarray]:
    """shard_id and number of every entry, those that are no records included."""
    rep, _ = s.entry.levels()
    file = np.cumsum(rep == 0) - 1
    first = np.flatnonzero(rep == 0)
    return np.array(s.files, np.int64)[file], np.arange(len(rep)) - first[file]


def assemble(s: Shredder) -> dict[str, np.ndarray | list]:
    """Provisions in preorder within their depth, from the level sequences: place of the entry, ord, parent_ord, path, its state and the leaves."""
    depth = len(s.depths)
    rows = []  # by depth: parent's row in the depth above, or the entry's place
    for k, group in enumerate(s.depths):
        rep, full = group.levels()
        # an entry of level <= k + 1 repeats something above depth k: it belongs to the next parent
        rows.append((np.cumsum(rep <= k + 1) - 1)[full >= k + 2])
    sizes = [np.ones(len(p), np.int64) for p in rows]
    for k in range(depth - 1, 0, -1):
        if len(rows[k]):
            sizes[k - 1] += np.bincount(rows[k], sizes[k], len(rows[k - 1])).astype(np.int64)
    roots: list[np.ndarray] = []
    ords: list[np.ndarray] = []
    parents: list[np.ndarray] = []
    paths: list[list[str]] = []
    leaves: dict[str, list] = {n: [] for n in s.leaves}
    for k in range(depth):
        up, size = rows[k], sizes[k]
        before = np.cumsum(size) - size  # of all rows of this depth; less what lies before the first sibling
        first = np.ones(len(up), bool)
        first[1:] = up[1:] != up[:-1]
        offset = before - np.maximum.accumulate(np.where(first, before, 0)) if len(up) else before
        if k == 0:
            roots.append(up)
            parents.append(np.full(len(up), -1, np.int64))
            ords.append(offset)
        else:
            roots.append(roots[k - 1][up])
            parents.append(ords[k - 1][up])
            ords.append(ords[k - 1][up] + 1 + offset)
        own = {n: c.rows() for n, c in s.depths[k].all}
        for n in s.leaves:
            leaves[n] += own[n]
        pairs = zip(own["path"], own["marker"])
        if k == 0:
            paths.append([p or (m or "") for p, m in pairs])
        else:
            above = paths[k - 1]
            paths.append([p or above[u] + (m or "") for (p, m), u in zip(pairs, up.tolist())])
    cat = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
    return {
        "root": cat(roots),
        "ord": cat(ords),
        "parent_ord": cat(parents),
        "path": [p for x in paths for p in x],
        "path_is": [x for g in s.depths for x in g.columns["path"].states().tolist()],
        "leaves": leaves,
    }


def _shredded(shredder: Shredder, shard_ids: list, contents: list) -> Shredder:
    for shard_id, content in zip(shard_ids, contents):
        if content:
            try:
                record = _load(content)
            except ValueError:
                continue
            if isinstance(record, dict):
                shredder.add(shard_id, record)
    return shredder


def shred_batch(shard_ids: list, contents: list, leaves: tuple[str, ...], states: bool = False) -> pa.RecordBatch:
    s = _shredded(Shredder(leaves=leaves), shard_ids, contents)
    t = assemble(s)
    files, entries = _entries(s)
    columns = {
        "shard_id": pa.array(files[t["root"]], pa.int64()),
        "entry": pa.array(entries[t["root"]], pa.int32()),
        "ord": pa.array(t["ord"], pa.int32()),
        "parent_ord": pa.array(t["parent_ord"], pa.int32()),
        "path": pa.array(t["path"], pa.string()),
        **{n: pa.array(t["leaves"][n], pa.string()) for n in leaves if n != "path"},
        **({"path_is": pa.array(t["path_is"], pa.string())} if states else {}),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def entry_batch(shard_ids: list, contents: list) -> pa.RecordBatch:
    s = _shredded(Shredder(entry=tuple(ENTRY.values())), shard_ids, contents)
    files, entries = _entries(s)
    held = s.entry.levels()[1] >= 1
    fields = [pa.array(s.entry.columns[f].rows(), pa.string()) for f in ENTRY.values()]
    return pa.RecordBatch.from_arrays([pa.array(files[held], pa.int64()), pa.array(entries[held], pa.int32()), *fields], names=["shard_id", "entry", *ENTRY])


def note_batch(shard_ids: list, contents: list) -> pa.RecordBatch:
    s = _shredded(Shredder(note=tuple(NOTE.values())), shard_ids, contents)
    files, entries = _entries(s)
    rep, full = s.note.levels()
    of = (np.cumsum(rep <= 1) - 1)[full >= 2]
    first = np.ones(len(of), bool)
    first[1:] = of[1:] != of[:-1]
    number = np.arange(len(of)) - np.maximum.accumulate(np.where(first, np.arange(len(of)), 0)) if len(of) else of
    fields = [pa.array(s.note.columns[f].rows(), pa.string()) for f in NOTE.values()]
    return pa.RecordBatch.from_arrays([pa.array(files[of], pa.int64()), pa.array(entries[of], pa.int32()), pa.array(number, pa.int32()), *fields], names=["shard_id", "entry", "note", *NOTE])


#: Files that are shredded together.
TOGETHER = 1000


def _by_batch(shard_file: DataFrame, schema: str, made) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, TOGETHER):
                part = b.slice(k, TOGETHER)
                yield made(part.column(0).to_pylist(), part.column(1).to_pylist())

    return shard_file.where("content is not null and shard_id is not null").select("shard_id", "content").mapInArrow(run, schema)


def _strings(names) -> str:
    return "".join(f", {n} string" for n in names)


def shred_provisions(shard_file: DataFrame, leaves: tuple[str, ...] = ("path", "marker", "heading", "text"), states: bool = False) -> DataFrame:
    """One row per provision: shard_id, entry, ord, parent_ord, path, the other leaves, and with ``states`` what its own path was."""
    schema = "shard_id bigint, entry int, ord int, parent_ord int, path string" + _strings([x for x in leaves if x != "path"] + ["path_is"] * states)
    return _by_batch(shard_file, schema, lambda ids, contents: shred_batch(ids, contents, leaves, states))


def shred_entries(shard_file: DataFrame) -> DataFrame:
    """One row per record of a file, its own and those it holds also: shard_id, entry and its plain fields."""
    return _by_batch(shard_file, "shard_id bigint, entry int" + _strings(ENTRY), entry_batch)


def shred_notes(shard_file: DataFrame) -> DataFrame:
    """One row per note: shard_id, entry, note, topic, heading, text."""
    return _by_batch(shard_file, "shard_id bigint, entry int, note int" + _strings(NOTE), note_batch)


def provisions(shard_file: DataFrame) -> DataFrame:
    """Distinct shard_id, entry, ord, parent_ord, path."""
    return shred_provisions(shard_file, ("path", "marker")).drop("marker").distinct()
