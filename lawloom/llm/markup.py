"""Markup residue in text documents: which kinds of element a text holds, and the clean text with its structure kept.

A text is cut into flat blocks at blank lines (code that spans blank lines stays one block). Each block is described by its word count
and link density, those of its neighbours, and counts of marks that can mean an element: some are sure signs, some mean different
things in different notations (``#`` is a heading here and a numbered list there), and some occur in plain prints too. One decision
tree per kind, trained on a small table of labelled documents, tells from these which elements a block holds. A further tree tells
the furniture of a page (bars of links and what stands between them) from its text; there words, link density and the neighbours
decide, and clean text goes without it. All blocks of a batch are described first and pass the trees together. The file's media type
and extension are not consulted. There is no shuffle but the one that removes repeated rows.

Defined results: null and empty texts have no kinds and a null or empty clean text; line ends are unified; text inside code is not
read as markup; a <pre> that begins the body is a wrapper; repeated rows count once, and rows of one file_id with different texts
count each; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lawloom.llm.markup_examples import FURNITURE, KINDS, documents
from lawloom.session import spread

FEATURES = (
    "words", "link_density", "words_before", "words_after", "link_density_before", "link_density_after", "words_a_line",
    "ends_sentence", "html_heading", "tex_heading", "equals_heading", "underlined", "hashes", "html_list", "tex_list", "bullets",
    "numbers", "code", "formula", "dollars", "table", "pipes", "tags", "entities", "emphasis", "links", "templates", "commands",
)

_CODE = re.compile(
    r"^(?P<f>```+|~~~+)[^\n`]*\n.*?(?:^(?P=f)[ \t]*$|\Z)"
    r"|\\begin\{(?P<e>verbatim\*?|lstlisting|minted)\}.*?\\end\{(?P=e)\}"
    r"|\\verb\*?(?P<d>[^\w\s])[^\n]*?(?P=d)"
    r"|<pre\b[^>]*>\s*<code\b.*?</code>\s*</pre>"
    r"|<(?P<t>code|source|syntaxhighlight|samp|tt|kbd)\b[^>]*>.*?</(?P=t)\s*>"
    r"|(?<![`\w])`(?!`)[^`]*?[^`]`(?!`)",
    re.S | re.M | re.I,
)
_PRE = re.compile(r"<pre\b[^>]*>.*?</pre\s*>", re.S | re.I)
_FORMULA = re.compile(
    r"<math\b.*?</math\s*>|\$\$.+?\$\$|\\\[.+?\\\]|\\\(.+?\\\)"
    r"|\\begin\{(?P<e>equation\*?|align\*?|displaymath|math|eqnarray\*?)\}.*?\\end\{(?P=e)\}",
    re.S | re.I,
)
_DOLLARS = re.compile(r"(?<![\\$\w])\$(?![\s$])(?=[^$\n]*(?:\\[a-zA-Z]|[_^]))[^$\n]*[^\s\\$]\$(?!\d)")
_TABLE = re.compile(r"<table\b.*?</table\s*>|<t[rdh]\b[^>]*>|\\begin\{(?P<e>tabular\*?|longtable)\}.*?\\end\{(?P=e)\}|^\{\|.*?^\|\}", re.S | re.M | re.I)
_PIPES = re.compile(r"^ {0,3}\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$", re.M)
_PIPE_ROW = re.compile(r"^\|.*\|[ \t]*$", re.M)
_HTML_HEADING = re.compile(r"</?h[1-6]\b[^>]*>", re.I)
_TEX_HEADING = re.compile(r"\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?(?:\[[^\]]*\])?\{[^}]*\}")
_EQUALS = re.compile(r"^(={2,6})[ \t]*[^=\n][^\n]*?\1[ \t]*$", re.M)
_UNDERLINED = re.compile(r"(?<!\n)\n(?:={3,}|-{3,})[ \t]*$", re.M)
_HASHES = re.compile(r"^#{1,6}[ \t]+\S", re.M)
_HTML_LIST = re.compile(r"</?(?:[uo]l|li|d[ltd])\b[^>]*>", re.I)
_TEX_LIST = re.compile(r"\\(?:begin|end)\{(?:itemize|enumerate|description)\}|\\item\b(?:\[[^\]]*\])?")
_BULLETS = re.compile(r"^ {0,3}(?:[-+*]|\*\*+)[ \t]+(?![-*_ \t]*$)(?!\*[ \t]+\*)\S", re.M)
_NUMBERS = re.compile(r"^ {0,3}\d{1,3}[.)][ \t]+\S", re.M)
_COMMENT = re.compile(r"<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", re.S | re.I)
_TAG = re.compile(r"</?[a-z][a-z0-9]*(?:\s[^<>]*|/)?>|<!doctype[^>]*>", re.I)
_ENTITY = re.compile(r"&(?:[a-z][a-z0-9]{1,20}|#\d{1,6}|#x[0-9a-f]{1,5});", re.I)
_QUOTED = re.compile(r"``[^`'\n]*''")
_EMPHASIS = re.compile(
    r"\*\*(?=\S)[^*\n]+?(?<=\S)\*\*|(?<![_\w])__(?=\S)[^_\n]+?(?<=\S)__(?![_\w])|~~(?=\S)[^~\n]+?~~|'''?(?=\S)[^'\n][^\n]*?'''?"
    r"|(?<![*\w])\*(?=[^\s*])[^*\n]+(?<=[^\s*])\*(?![*\w])|(?<![_\w])_(?=[^\s_])[^_\n]+(?<=[^\s_])_(?![_\w])"
)
_LINK = re.compile(r"!?\[[^\]\n]*\]\([^)\s]*\)|\[\^[^\]\n]+\]:?|\[\[[^\]\n]+\]\]|\[https?://[^\]\n]+\]|<a\b[^>]*>.*?</a\s*>|\\href\{[^}]*\}\{[^}]*\}", re.S | re.I)
_TEMPLATE = re.compile(r"\{\{[^{}\n]*\}\}|__[A-Z]{4,}__|<ref\b[^>]*/?>|</ref\s*>", re.I)
_COMMAND = re.compile(r"\\[a-zA-Z]+\*?[ \t]*[\[{]|\\(?:noindent|par|newpage|clearpage|maketitle|tableofcontents|bigskip|medskip|smallskip|linebreak|hfill|centering|LaTeX|TeX|ldots|dots|S|P)\b|\\[$%&#_{}]|^%[^\n]*|(?<!\\)\\\\[ \t]*$", re.M)
_QUOTE_LINE = re.compile(r"^> +\S", re.M)
_SENTENCE_END = re.compile(r"[.;:?!][\"”’)\]]*\s*$")
_WORD = re.compile(r"\w+")


def unify(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


_GAP = re.compile(r"\n[ \t]*(?:\n[ \t]*)+(?=\n|$)|\n[ \t]*\n")
_code_signs = re.compile(r"[`<\\]|~~~").search


def blocks(text: str) -> list[str]:
    """Flat blocks: at blank lines, unless those are inside code."""
    keep = [m.span() for m in _CODE.finditer(text) if "\n" in m[0]] if _code_signs(text) and "\n\n" in text else []
    out, at = [], 0
    for m in _GAP.finditer(text):
        if keep and any(a < m.start() < b for a, b in keep):
            continue
        out.append(text[at : m.start()])
        at = m.end()
    out.append(text[at:])
    return [b for b in out if b.strip()]


_signs = re.compile(r"[<\\`$|\[{&*_~'%>#=+-]|^ {0,3}\d{1,3}[.)][ \t]", re.M).search
_AT = {n: k for k, n in enumerate(FEATURES)}


def _lines(row: list[float], text: str, words: int) -> None:
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    row[_AT["words"]] = words
    row[_AT["words_a_line"]] = words / max(1, len(lines))
    row[_AT["ends_sentence"]] = sum(bool(_SENTENCE_END.search(x)) for x in lines) / max(1, len(lines))


def marks(block: str) -> list[float]:
    """The features of one block, without its neighbours. What a sign must hold is looked for before its pattern is."""
    row = [0.0] * len(FEATURES)
    if not _signs(block):
        _lines(row, block, len(block.split()))
        return row

    def put(name: str, n: float) -> None:
        row[_AT[name]] = n

    text, angle, slash = block, "<" in block, "\\" in block
    code = tags = 0
    if angle or slash or "`" in text or "~~~" in text:
        text, code = _CODE.subn(" \x01 ", text)
    if angle:
        code += sum(not re.search(r"<body\b[^>]*>\s*$", text[: m.start()], re.I) for m in _PRE.finditer(text))
        text, tags = _COMMENT.subn(" ", text)
    put("code", code)
    if angle or slash or "$" in text:
        if angle or slash or "$$" in text:
            text, n = _FORMULA.subn(" \x02 ", text)
            put("formula", n)
        if "$" in text and (slash or "_" in text or "^" in text):
            text, n = _DOLLARS.subn(" \x02 ", text)
            put("dollars", n)
    if angle:
        put("html_heading", len(_HTML_HEADING.findall(text)))
    tables = ""
    if angle or slash or "{|" in text:
        tables = " ".join(m[0] for m in _TABLE.finditer(text))
        text, n = _TABLE.subn(" \x03 ", text)
        put("table", n)
    if "|" in text and (n := len(_PIPES.findall(text))):
        put("pipes", n)
        text = _PIPE_ROW.sub(" \x03 ", _PIPES.sub(" ", text))
    links = _LINK.findall(text) if angle or slash or "[" in text else ()
    words = len((_TAG.sub(" ", text) if angle else text).split())
    if links:
        put("link_density", sum(len(re.sub(r"\(\S*\)|<[^>]*>|https?://\S*", " ", x).split()) for x in links) / max(1, words))
        put("links", len(links))
    _lines(row, text, words)
    if slash:
        text, n = _TEX_HEADING.subn(" ", text)
        put("tex_heading", n)
    if "==" in text:
        put("equals_heading", len(_EQUALS.findall(text)))
    if "---" in text or "===" in text:
        put("underlined", len(_UNDERLINED.findall(text)))
    if "#" in text:
        put("hashes", len(_HASHES.findall(text)))
    if angle:
        put("html_list", len(_HTML_LIST.findall(text)))
    if slash:
        text, n = _TEX_LIST.subn(" ", text)
        put("tex_list", n)
    if "* " in text or "- " in text or "+ " in text or "\t" in text:
        put("bullets", len(_BULLETS.findall(text)))
    put("numbers", len(_NUMBERS.findall(text)))
    if angle:
        text = _HTML_LIST.sub(" ", _HTML_HEADING.sub(" ", text))
    if links:
        text = _LINK.sub(" ", text)
    if angle or "{{" in text or "__" in text:
        text, n = _TEMPLATE.subn(" ", text)
        put("templates", n)
    if angle:
        text, n = _TAG.subn(" ", text)
        tags += n
    put("tags", tags)
    if "&" in block:
        put("entities", len(_ENTITY.findall(text)) + len(_ENTITY.findall(tables)))
    emphasis = len(_QUOTE_LINE.findall(block)) if ">" in block else 0
    if "*" in text or "_" in text or "~~" in text or "''" in text:
        emphasis += len(_EMPHASIS.findall(_QUOTED.sub(" ", text)))
    put("emphasis", emphasis)
    if slash or "%" in text:
        put("commands", len(_COMMAND.findall(text)))
    return row


_NEIGHBOURS = [(_AT[f"{what}_{side}"], _AT[what], step) for what in ("words", "link_density") for side, step in (("before", -1), ("after", 1))]


def describe(found: Sequence[list[str]]) -> np.ndarray:
    """Feature rows of the blocks of texts, one below the other, neighbours in the same text included."""
    x = np.array([marks(b) for text in found for b in text]).reshape(-1, len(FEATURES))
    number = np.repeat(np.arange(len(found)), [len(text) for text in found])
    for to, of, step in _NEIGHBOURS:
        if step < 0:
            x[1:, to] = np.where(number[1:] == number[:-1], x[:-1, of], 0)
        else:
            x[:-1, to] = np.where(number[1:] == number[:-1], x[1:, of], 0)
    return x


class Tree:
    """A binary decision tree grown by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 12) -> None:
        self.yes = float(y.mean()) if len(y) else 0.0
        self.feature = -1
        if depth == 0 or self.yes in (0.0, 1.0):
            return
        best = None
        for j in range(x.shape[1]):
            order = np.argsort(x[:, j], kind="stable")
            v, t = x[order, j], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            n, a = len(y), cut + 1.0
            p, q = t[cut] / a, (t[-1] - t[cut]) / (n - a)
            gini = (a * p * (1 - p) + (n - a) * q * (1 - q)) / n
            k = int(gini.argmin())
            if best is None or gini[k] < best[0] - 1e-12:
                best = (gini[k], j, (v[cut[k]] + v[cut[k] + 1]) / 2)
        if best is None:
            return
        _, self.feature, self.cut = best
        left = x[:, self.feature] <= self.cut
        self.low, self.high = Tree(x[left], y[left], depth - 1), Tree(x[~left], y[~left], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.yes >= 0.5)
        out = np.empty(len(x), bool)
        left = x[:, self.feature] <= self.cut
        out[left], out[~left] = self.low.predict(x[left]), self.high.predict(x[~left])
        return out


#: Marks that are sure signs of a kind; their sums, the marks that mean several things, and words, density and neighbours are what a tree sees.
_SURE = {
    "heading": ("html_heading", "tex_heading", "equals_heading", "underlined"),
    "list": ("html_list", "tex_list"),
    "code": ("code",),
    "formula": ("formula", "dollars"),
    "table": ("table", "pipes"),
    "other": ("tags", "entities", "emphasis", "links", "templates", "commands"),
}
_OPEN = ("hashes", "bullets", "numbers", "words", "link_density", "words_a_line", "ends_sentence", "words_before", "words_after", "link_density_before", "link_density_after")
SEEN = (*_SURE, *_OPEN)
#: What is told of the neighbours of a block.
AROUND = ("words_before", "words_after", "link_density_before", "link_density_after")


def seen(x: np.ndarray) -> np.ndarray:
    """The columns that trees see."""
    sums = [x[:, [_AT[n] for n in names]].sum(axis=1) for names in _SURE.values()]
    return np.column_stack([*sums, x[:, [_AT[n] for n in _OPEN]]])


def train(table: list[list[tuple[str, str]]], without: tuple[str, ...] = ()) -> dict[str, Tree]:
    """One tree per kind from labelled documents; columns of ``without`` are blank to all of them."""
    x = seen(describe([[b for _, b in d] for d in table]))
    x[:, [SEEN.index(n) for n in without]] = 0
    labels = [kinds for d in table for kinds, _ in d]
    return {name: Tree(x, np.array([letter in kinds for kinds in labels], float)) for letter, name in {**KINDS, FURNITURE: "furniture"}.items()}


@lru_cache(maxsize=1)
def trees() -> dict[str, Tree]:
    return train(documents())


def told(found: Sequence[list[str]], grown: dict[str, Tree] | None = None) -> list[list[set[str]]]:
    """By text and block: the kinds of element, and ``furniture``."""
    grown = trees() if grown is None else grown
    x = seen(describe(found))
    answers = {name: tree.predict(x).tolist() for name, tree in grown.items()}
    names, out, at = list(answers), [], 0
    for text in found:
        out.append([{n for n in names if answers[n][k]} for k in range(at, at + len(text))])
        at += len(text)
    return out


def block_kinds(found: list[str]) -> list[set[str]]:
    return told([found])[0] if found else []


def kinds(texts: Sequence[str | None], grown: dict[str, Tree] | None = None) -> list[list[str]]:
    """The kinds of element in each text."""
    found = [blocks(unify(t)) if t else [] for t in texts]
    if not any(found):
        return [[] for _ in texts]
    return [sorted(set().union(*text) - {"furniture"}) for text in told(found, grown)]


# --- clean text -------------------------------------------------------------------------------------------------------------------


def _fenced(m: re.Match) -> str:
    whole = m[0]
    body = re.sub(r"^(```+|~~~+)[^\n]*\n|\n?(```+|~~~+)[ \t]*$", "", whole) if whole[0] in "`~" and whole[:2] != "`" and len(whole) > 5 and whole[:3] in ("```", "~~~") else whole
    body = re.sub(r"^\\begin\{[^}]*\}(?:\[[^\]]*\])?\n?|\n?\\end\{[^}]*\}$", "", body)
    body = re.sub(r"^\\verb\*?(\W)(.*)\1$", r"\2", body, flags=re.S)
    if body.startswith("<"):
        body = html.unescape(re.sub(r"^(?:<(?:pre|code|source|syntaxhighlight|samp|tt|kbd|nowiki)\b[^>]*>\s*)+|(?:\s*</(?:pre|code|source|syntaxhighlight|samp|tt|kbd|nowiki)\s*>)+$", "", body, flags=re.I))
    if body == whole and body[:1] == "`":
        return body
    return f"\n```\n{body.strip(chr(10))}\n```\n" if "\n" in whole or whole[0] in "~<" or whole.startswith("\\begin") else f"`{body}`"


def _formula(m: re.Match) -> str:
    s = re.sub(r"^\\begin\{[^}]*\}|\\end\{[^}]*\}$", "", m[0])
    s = re.sub(r"^(?:\\\[|\\\(|\$\$?)|(?:\\\]|\\\)|\$\$?)$", "", s)
    s = re.sub(r"<mfrac>\s*<(\w+)>(.*?)</\1>\s*<(\w+)>(.*?)</\3>\s*</mfrac>", r"(\2)/(\4)", s, flags=re.S | re.I)
    return f"${html.unescape(re.sub(r'<[^>]*>', '', s)).strip()}$"


def _rows(m: re.Match) -> str:
    s = m[0]
    if s[:1] == "\\":
        rows = [[c for c in r.split("&")] for r in re.sub(r"\\(?:begin|end)\{[^}]*\}(?:\{[^}]*\})?|\\hline", "", s).split("\\\\")]
    elif s[:1] == "{":
        rows = [re.split(r"\s*(?:\|\||!!)\s*", line[1:]) for line in s.split("\n") if line[:1] in "|!" and line[:2] not in ("|-", "|}", "|+")]
    elif s[:6].lower() == "<table":
        rows = [re.findall(r"<t[dh]\b[^>]*>(.*?)(?=</?t[dhr]\b|</table|$)", r, re.S | re.I) for r in re.split(r"<tr\b[^>]*>", s, flags=re.I)]
    else:
        return " "
    lines = ["| " + " | ".join(" ".join(c.split()) for c in r) + " |" for r in rows if any(c.strip() for c in r)]
    return "\n" + "\n".join(lines) + "\n"


def clean_block(block: str, found: set[str]) -> str:
    """One block as clean text: # headings, - lists, fenced code, $formulas$ and | tables | stay, all other markup goes."""
    held: list[str] = []

    def hold(s: str) -> str:
        held.append(s)
        return f"\x00{len(held) - 1}\x00"

    text = _CODE.sub(lambda m: hold(_fenced(m)), block) if "code" in found else block
    text = _COMMENT.sub("", text)
    if "formula" in found:
        text = _DOLLARS.sub(lambda m: hold(_formula(m)), _FORMULA.sub(lambda m: hold(_formula(m)), text))
    if "table" in found:
        text = _PIPES.sub("", _TABLE.sub(_rows, text))
    if "heading" in found:
        text = re.sub(r"<h([1-6])\b[^>]*>(.*?)</h\1\s*>", lambda m: "\n" + "#" * int(m[1]) + " " + " ".join(m[2].split()) + "\n", text, flags=re.S | re.I)
        text = re.sub(r"\\(part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?(?:\[[^\]]*\])?\{([^}]*)\}", lambda m: "#" * (1 + ("section" in m[1]) + m[1].count("sub")) + " " + m[2], text)
        text = re.sub(r"^(={2,6})[ \t]*(.*?)[ \t]*\1[ \t]*$", lambda m: "#" * len(m[1]) + " " + m[2], text, flags=re.M)
        text = re.sub(r"^([^\n]+)\n(={3,}|-{3,})[ \t]*$", lambda m: ("# " if m[2][0] == "=" else "## ") + m[1], text, flags=re.M)
        text = re.sub(r"^(#{1,6}[ \t]+[^\n]*?)[ \t]+#+[ \t]*$", r"\1", text, flags=re.M)
    if "list" in found:
        text = re.sub(r"\s*(?:<li\b[^>]*>\s*|\\item\b(?:\[[^\]]*\])?[ \t]*)", "\n- ", text, flags=re.I)
        text = re.sub(r"</?(?:[uo]l|li|d[ltd])\b[^>]*>|\\(?:begin|end)\{(?:itemize|enumerate|description)\}", "", text, flags=re.I)
        text = re.sub(r"^ {0,3}(?:[-+]|\*+)[ \t]+(?:\[[ xX]\][ \t]+)?", "- ", text, flags=re.M)
        if "heading" not in found:
            text = re.sub(r"^#+[ \t]+", "- ", text, flags=re.M)
    if "other" in found:
        text = re.sub(r"!\[([^\]\n]*)\]\([^)\s]*\)|\[([^\]\n^][^\]\n]*)\]\([^)\s]*\)", lambda m: m[1] or m[2] or "", text)
        text = re.sub(r"\[\[(?:Category|File|Image):[^\]]*\]\]|\[\^[^\]\n]+\]:?|<ref\b[^>]*>.*?</ref\s*>|<ref\b[^>]*/>", "", text, flags=re.S | re.I)
        text = re.sub(r"\[\[(?:[^\]|\n]*\|)?([^\]\n]*)\]\]", r"\1", text)
        text = re.sub(r"\[https?://\S+[ \t]*([^\]\n]*)\]", r"\1", text)
        text = _TEMPLATE.sub("", re.sub(r"^> +(?=\S)", "", text, flags=re.M))
        text = re.sub(r"\\href\{[^}]*\}\{([^}]*)\}|\\footnote\{[^}]*\}|\\cite\{[^}]*\}", lambda m: m[1] or "", text)
        text = re.sub(r"^%[^\n]*\n?", "", text, flags=re.M)
        text = re.sub(r"\\(?:documentclass|usepackage|begin|end|label|ref|title|author|date)(?:\[[^\]]*\])?\{[^}]*\}", "", text)
        text = re.sub(r"\\(?:textbf|textit|emph|underline|texttt)\{([^}]*)\}", r"\1", text)
        text = re.sub(r"\\(?:noindent|par|maketitle|newpage|clearpage)\b[ \t]*", "", text)
        text = re.sub(r"\\([$%&#_{}])", r"\1", text)
        text = re.sub(r"<br\s*/?>|</p>|</div>", "\n", text, flags=re.I)
        text = html.unescape(_TAG.sub("", text))
        quoted = _QUOTED.sub(lambda m: hold(m[0]), text)
        text = _EMPHASIS.sub(lambda m: m[0].strip("*_~'"), quoted)
    text = re.sub(r"\x00(\d+)\x00", lambda m: held[int(m[1])], text)
    return re.sub(r"[ \t]+$", "", re.sub(r"\n{3,}", "\n\n", text), flags=re.M).strip("\n")


def clean(texts: Sequence[str | None], grown: dict[str, Tree] | None = None) -> list[str | None]:
    """The texts without markup and furniture."""
    found = [blocks(unify(t)) if t else [] for t in texts]
    answers = told(found, grown) if any(found) else [[] for _ in texts]
    out: list[str | None] = []
    for text, bs, ks in zip(texts, found, answers):
        parts = [clean_block(b, k) for b, k in zip(bs, ks) if "furniture" not in k]
        out.append("\n\n".join(p for p in parts if p.strip()) if text else text)
    return out


#: Texts whose blocks pass the trees together.
TOGETHER = 256


def _by_batch(rows: DataFrame, schema: str, made) -> DataFrame:
    """``made`` of (ids, texts, trees) for pieces of each batch; the trees are grown once, by the driver, and are of a fixed size."""
    grown = rows.sparkSession.sparkContext.broadcast(trees())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, TOGETHER):
                part = b.slice(k, TOGETHER)
                yield made(part.column(0).to_pylist(), part.column(1).to_pylist(), grown.value)

    return spread(rows, "file_id").mapInArrow(run, schema)


def found_elements(files: DataFrame) -> DataFrame:
    """Distinct file_id, elem."""

    def made(ids: list, texts: list, grown: dict[str, Tree]) -> pa.RecordBatch:
        rows = [(i, k) for i, own in zip(ids, kinds(texts, grown)) for k in own]
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([k for _, k in rows], pa.string())], names=["file_id", "elem"])

    return _by_batch(files.where("file_id is not null and text <> ''").select("file_id", "text"), "file_id bigint, elem string", made).distinct()


def clean_files(files: DataFrame) -> DataFrame:
    """Distinct file_id, text."""

    def made(ids: list, texts: list, grown: dict[str, Tree]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(clean(texts, grown), pa.string())], names=["file_id", "text"])

    return _by_batch(files.where("file_id is not null").select("file_id", "text").distinct(), "file_id bigint, text string", made)
