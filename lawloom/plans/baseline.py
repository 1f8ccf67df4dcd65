"""The same operators in one thread of plain Python over the same files: what the queries on Spark are held against.

Each function does the whole of its query's work on ``d`` and returns how many rows come out. Texts are made by the query's own
recipe, outside the clock; everything else counts, reading included.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict

import pyarrow.parquet as pq

from lawloom.functions import amend, citations, markers, redline, structure
from lawloom.operators import shred

BASELINES: dict = {}


def baseline(f):
    BASELINES[f.__name__] = f
    return f


def rows(d: str, name: str, *columns: str) -> list[tuple]:
    t = pq.read_table(f"{d}/{name}.parquet", columns=list(columns))
    return list(zip(*(t.column(c).to_pylist() for c in columns)))


def _slug(s: str) -> str:
    return re.sub("[^a-z0-9]", "_", s.lower())


def _squeeze(s: str | None) -> str | None:
    return None if s is None else "".join(s.split())


@baseline
def title_hit_rate(d: str) -> int:
    held = {x for x in rows(d, "code_section", "title", "slug")}
    seen = {x for x in rows(d, "citation", "doc_id", "cite_id", "kind", "title", "section") if x[3] is not None and x[4] is not None and x[2] == "usc"}
    count: Counter = Counter()
    for doc, _, _, title, section in seen:
        count[doc, title] += 1
        count[doc, title, "held"] += (title, _slug(section)) in held
    return len(count)


@baseline
def top_public_laws(d: str) -> int:
    seen = {x for x in rows(d, "citation", "doc_id", "cite_id", "kind", "congress", "law") if x[2] == "publaw"}
    return len(Counter(x[3:] for x in seen).most_common(25))


@baseline
def usc_outcomes(d: str) -> int:
    titles = {t for (t,) in rows(d, "code_title", "title")}
    first: dict = {}
    for t, s, e, h, lead, notes in rows(d, "code_section", "title", "slug", "entry", "heading", "lead", "notes"):
        if (t, s) not in first or e < first[t, s][0]:
            first[t, s] = (e, h, lead or "", notes)
    paths = set(rows(d, "code_node", "title", "slug", "path"))
    bodies = {x[:2] for x in paths}
    seen = {(_squeeze(t), _squeeze(s), _squeeze(p or "")) for k, t, s, p in rows(d, "citation", "kind", "title", "section", "subsection") if k == "usc" and t is not None and s is not None}
    out = Counter()
    for t, s, p in seen:
        key = (t, _slug(s))
        if key not in first:
            out["section_absent" if t in titles else "title_absent"] += 1
            continue
        lead = first[key][2]
        if key not in bodies and not lead.strip():
            out["stub"] += 1
            continue
        ms = markers.markers(p)
        tries = [p] + ["".join(ms[k:]) for k in range(1, len(ms)) if all(m in lead for m in ms[:k])]
        out["section" if not p else "provision" if any((*key, x) in paths for x in tries) else "focus_missing"] += 1
    return sum(out.values())


@baseline
def act_index_build(d: str) -> int:
    number = re.compile(r"§{1,2}\s*([0-9][0-9A-Za-z.\-–—]*)(?:\[([0-9][0-9A-Za-z.\-–—]*)\])?")
    act = re.compile(r"^\(\s*((?:[A-Z][a-z]{2,8}\.?\s+\d{1,2},\s+\d{4},\s+ch\.\s+\d+[A-Za-z]?)|(?:Pub\.\s*L\.\s*\d+[-–—]\d+))")
    places = defaultdict(set)
    for t, s, credit in rows(d, "code_section", "title", "section", "source_credit"):
        head = (credit or "").split(";")[0]
        if (a := act.match(head)) and (n := number.search(head)):
            places[a[1], n[2] or n[1]].add((t, s))
    return len(places)


@baseline
def flatten_text(d: str) -> int:
    whole = defaultdict(set)
    for t, s, e, o, m, x in rows(d, "code_node", "title", "slug", "entry", "ord", "marker", "text"):
        whole[t, s, e].add((o, f"{m or ''} {x or ''}".strip()))
    return len({k: "\n".join(x for _, x in sorted(v)) for k, v in whole.items()})


@baseline
def ancestor_chain(d: str) -> int:
    nodes = set(rows(d, "code_node", "node_id", "title", "slug", "entry", "path", "ord"))
    first: dict = {}
    for _, t, s, e, p, o in nodes:
        if p is not None:
            first[t, s, e, p] = min(o, first.get((t, s, e, p), o))
    n = 0
    for _, t, s, e, p, _ in nodes:
        for prefix in markers.ladder(p or "")[1:]:
            if (t, s, e, prefix) not in first:
                break
            n += 1
    return n


def _each(read):
    return lambda texts: sum(len(read(t)) for t in texts)


def _operations(text: str) -> list:
    cites = citations.extract(text)
    return [o for a in amend.extract(text, cites, structure.parse_bill(text)) for o in a.ops]


#: Over the texts of the query of that name.
OVER_TEXTS = {
    "usc_scan": _each(lambda t: [m for m in re.finditer(r"(?i)\b(\d{1,2}[A-Z]?)\s*U\.?\s?S\.?\s?C\.?\s*(?:§+\s*)?(\d+[A-Za-z]*(?:[–—-]\s*\d+[A-Za-z]*)?)((?:\([A-Za-z0-9]{1,8}\))*)", t)]),
    "usc_citations": _each(citations.extract),
    "strike_insert_ops": _each(_operations),
    "bill_sections": _each(lambda t: structure.parse_bill(t).sections),
}


@baseline
def redline_segments(d: str) -> int:
    n = 0
    for k, name, brand in rows(d, "part", "p_partkey", "p_name", "p_brand"):
        text = f"The item zq{k} is free." if k % 3 == 2 else f"The item zq{k} and the like are free."
        struck = "and the like are" if k % 3 == 2 else f"zq{k}"
        ops = [redline.Work(0, "strike", struck, 10, scope="(a)"), redline.Work(1, "insert", f"xq{k}", 20, scope="(a)", replaces=10)]
        n += len(redline.draw(ops, "", [redline.Node("(a)", "(a)", "", text)])[0])
    return n


@baseline
def p1_found(d: str) -> int:
    titles = {_squeeze(t) for (t,) in rows(d, "code_title", "title")}
    spans = defaultdict(list)
    for t, s, a, b in rows(d, "code_section", "title", "slug", "loaded_at", "removed_at"):
        spans[_squeeze(t), _squeeze(s)].append((a, b))
    paths = {(_squeeze(t), _squeeze(s), _squeeze(p)) for t, s, p in rows(d, "code_node", "title", "slug", "path")}
    issues: dict = {}
    for t, n, day in rows(d, "cfr_section", "title", "number", "as_of"):
        key = (_squeeze(t), _squeeze(n))
        issues[key] = min(day, issues.get(key, day))
    out = set()
    for doc, cite, kind, t, s, p, at in rows(d, "citation", "doc_id", "cite_id", "kind", "title", "section", "subsection", "cited_at"):
        t, s, p = _squeeze(t), _squeeze(s), _squeeze(p)
        if kind not in ("usc", "cfr") or not t or not s:
            continue
        if kind == "cfr":
            lacks = None if (t, s) in issues and at and issues[t, s] <= f"{at:%Y-%m-%d}" else "cfr_section"
        else:
            key = (t, _slug(s))
            held = at is not None and any(a is not None and a <= at and (b is None or b > at) for a, b in spans.get(key, ()))
            lacks = "code_title" if t not in titles else "code_section" if not held else "code_node" if p and (*key, p) not in paths else None
        if lacks:
            out.add((doc, cite, lacks, at and f"{at:%Y-%m}"))
    return len(out)


@baseline
def p2_found(d: str) -> int:
    newest: dict = {}
    for i, g, s, content, at in rows(d, "shard_file", "shard_id", "grp", "stem", "content", "written_at"):
        if (g, s) not in newest or (at, i) > newest[g, s][0]:
            newest[g, s] = ((at, i), len((content or "").encode()))
    entries, seen = defaultdict(list), set()
    for i, g, parts, sizes, at in rows(d, "bundle_index", "idx_id", "grp", "parts", "part_bytes", "at_list"):
        if i not in seen:
            seen.add(i)
            for x in at or ():
                k = x["part_no"]
                fits = 0 <= k < len(parts) and x["byte_offset"] + x["byte_length"] <= sizes[k]
                entries[g, x["stem"]].append((fits, x["byte_length"]))
    faults = [k for k in newest.keys() | entries.keys() if k not in newest or len(entries[k]) != 1 or not entries[k][0][0] or entries[k][0][1] != newest[k][1]]
    return len(faults)


@baseline
def p5_found(d: str) -> int:
    out = set()

    def walk(shard_id: int, entry: int, nodes: list, parent: int, above: str, at: list) -> None:
        for x in nodes:
            own = at[0]
            at[0] += 1
            path = x.get("path") or above + (x.get("marker") or "")
            out.add((shard_id, entry, own, parent, path))
            walk(shard_id, entry, shred._objects(x.get("children")), own, path, at)

    for shard_id, content in rows(d, "shard_file", "shard_id", "content"):
        try:
            record = json.loads(content or "")
        except ValueError:
            continue
        if isinstance(record, dict):
            for k, x in enumerate([record, *shred._elements(record.get("also"))]):
                if isinstance(x, dict):
                    walk(shard_id, k, shred._objects(x.get("tree")), -1, "", [0])
    return len(out)
