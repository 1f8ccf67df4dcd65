"""A small labelled table of documents, from which the decision trees for markup are trained.

A document is a list of blocks in order, each with the kinds of marked-up element in it (letters as in KINDS, FURNITURE for what belongs
to the page and not to the text; none for plain text).
"""

from itertools import cycle

#: h heading, l list, c code, f formula, t table, o other markup
KINDS = {"h": "heading", "l": "list", "c": "code", "f": "formula", "t": "table", "o": "other"}
FURNITURE = "b"

_TITLE = "Granary inspection rules"
_LONG = "Every keeper of a granary shall open it to the inspector on the first day of each month, and pay $40 for each missed day."
_ITEM = "Each keeper shall count the sacks before the first frost and report them."
_CODE = ["weigh(sack_9)", '{"kind":"sack","n":"9"}', "<bin id=\"b9\"><n>9</n></bin>", "SELECT n FROM sack WHERE n = 9", "sort --by weight", "for (const s of sacks) {\n  weigh(s, 9);\n}"]
_MATH = [r"A_{9} + B \ge 92", r"\frac{9 x}{y + 92}", r"r \le \sqrt{92} + 9", r"S = 0.9 \times \min(A, B)", r"x_i^2 = 4"]


def _plain() -> list[str]:
    return [
        _LONG,
        _ITEM,
        _TITLE.upper() + ".",
        "SEC. 9. " + _TITLE.upper() + ".",
        "    (1) " + _LONG + "\n    (2) " + _ITEM,
        "    (a) " + _ITEM,
        "_" * 40,
        "-" * 40,
        "* * * * *",
        "Dues* are paid monthly. *See table 9.",
        "The word ``keeper'' has its usual meaning, see item #9.",
        "[Sic] The copy skips line 9.",
        "If A < B and B > 9 the first share counts.",
        "The M&K share is 9 percent of $5 to $9, or $90 in all.",
        "Copies lie under D:\\acts\\act9 since then.",
        "Put day {number} in place of ~ where 1/2 or 3/4 (approx. 9) applies.",
        "x = 9 and y = 92, by the tables.",
        "The entry act_note_text has 9 lines.",
        "SESSION NO. 9",
        _LONG + " " + _LONG,
        "An “eligible keeper” – or a naïve one – pays $9,000 to $12,000.",
        "1.5 sacks and 2.5 sacks make 4 sacks.",
        "Act No. 9 ends 2*3*4 sacks.",
    ]


def examples() -> list[tuple[str, str]]:
    """(kinds, block)"""
    rows: list[tuple[str, str]] = [("", p) for p in _plain()]
    add = lambda kinds, *blocks: rows.extend((kinds, b) for b in blocks)
    add("h", "# " + _TITLE, "## " + _TITLE + " ##", "### Keeper fund", "#### Small mill transfer study", _TITLE + "\n" + "=" * 20, _TITLE + "\n" + "-" * 24)
    add("h", "== " + _TITLE + " ==", "===" + _TITLE + "===", "==== Mill fund ====", f"\\section{{{_TITLE}}}", f"\\section[short]{{{_TITLE}}}", f"\\subsection*{{{_TITLE}}}", f"\\chapter{{{_TITLE}}}")
    add("h", f"<h1>{_TITLE}</h1>", f'<H2 class="sec" id="s9">{_TITLE}</H2>', f"<h4\n>{_TITLE}</h4>")
    for mark in ("- ", "* ", "+ ", "1. ", "- [ ] ", "# ", "## ", "** "):
        second = "2. " if mark == "1. " else mark
        add("l", mark + _ITEM + "\n" + second + _LONG, mark + _LONG, mark + _ITEM + "\n" + second + _ITEM + "\n" + second + _LONG)
    add("l", f"<ul>\n<li>{_ITEM}</li>\n<li>{_LONG}</li>\n</ul>", f"<OL>\n<li>{_ITEM}\n<li>{_LONG}\n</OL>", f"<li>{_ITEM}</li>", f"<li>{_ITEM}", f"\\item {_ITEM}")
    add("l", f"\\begin{{itemize}}\n\\item {_ITEM}\n  \\item[(a)] {_LONG}\n\\end{{itemize}}".replace("$", ""), f"\\begin{{enumerate}}\n\\item {_ITEM}\n\\end{{enumerate}}")
    add("lo", f"\\begin{{itemize}}\n\\item {_LONG}\n\\end{{itemize}}".replace("$", "\\$"), f"<div><ul>\n<li>{_ITEM}\n</ul>", f"- **Each keeper** shall count.\n- {_ITEM}", f"* {_ITEM} [[Mill|mills]]")
    for k, c in enumerate(_CODE):
        h = c.replace("<", "&lt;").replace(">", "&gt;")
        add("c", f"```\n{c}\n```", f"~~~\n{c}\n~~~", f"```js\n{c}\n```", f"<pre><code>{h}</code></pre>", f'<pre class="src"><code class="lang-x">{h}</code></pre>')
        add("c", f"\\begin{{verbatim}}\n{c}\n\\end{{verbatim}}", f"\\begin{{lstlisting}}[language=x]\n{c}\n\\end{{lstlisting}}", f"\\begin{{verbatim*}}\n{c}\n\\end{{verbatim*}}", f"<source>{c}</source>")
        add("c", f"<code><nowiki>{c}</nowiki></code>", f'<syntaxhighlight lang="text">\n{c}\n</syntaxhighlight>', f"Type `{c}` here.", f"\\verb|{c.splitlines()[0]}| works.")
        add("co", f"<p>Type <code>{h}</code> first.</p>", f"<p>{_LONG}</p>\n<pre><code>{h}</code></pre>")
    for m in _MATH:
        add("f", f"$$\n{m}\n$$", f"The part is ${m}$ in all.", f"\\[ {m} \\]", f"where \\({m}\\) holds.", f"\\begin{{equation}}\n{m}\n\\end{{equation}}", f"The part is <math>{m}</math>.")
        add("fo", f"<p>Take \\({m}\\) as the part.</p>")
    add("fo", "<p>Take <math><mi>B</mi><mo>=</mo><mn>9</mn></math> as the part.</p>")
    add("f", "Take <math><mfrac><mn>9</mn><mi>n</mi></mfrac></math> as the part.")
    add("t", f"| item | n |\n|---|---:|\n| {_TITLE} | 9 |\n| Mill fund | 92 |", f'{{| class="wikitable"\n! item !! n\n|-\n| {_TITLE} || 9\n|}}')
    add("t", f"<table><tr><td>{_TITLE}</td><td align=right>9</td></tr></table>", f"\\begin{{tabular}}{{lr}}\n{_TITLE} & 9 \\\\\nMill fund & 92 \\\\\n\\end{{tabular}}")
    add("to", f"<div><table><tr><td>{_TITLE}</td></tr></table>", f"<table><tr><td>{_TITLE}&nbsp;</td></tr></table>")
    add("o", f"<p>{_LONG}</p>", f"<p>{_LONG}", f"<div style='margin:2px'>{_LONG}<br/>{_LONG}</div>", "<html><head><meta name='topic' content='Mills'></head>\n<body>", "</body></html>", "</pre></body></html>")
    add("o", "<html><body><pre>\n&lt;DOC&gt;\nSESSION NO. 9", "<br>" + _ITEM, f"<p>{_LONG}&nbsp;<a href=\"https://mill.example/t9\">see text</a></p>", f"{_LONG} &sect;&#160;9", "&lt;b&gt;Mill fund&lt;/b&gt;", f"{_LONG} &amp;c.")
    add("o", f"<script>var v=9;</script><p>{_LONG}</p>", f"<!-- draft 9 --><p>{_LONG}</p>", f"<p>Every <b>keeper</b> of <i>mills</i> pays.</p>", "<!-- draft 9 -->", "&#8220;Keeper&#8221;")
    add("o", f"**Every keeper** of a granary. {_LONG}", f"__Every keeper__ pays. {_LONG}", f"{_LONG} ![seal](https://mill.example/a9.png)", f"{_LONG}[^5]", f"{_LONG} ~~struck words~~", f"{_LONG} [see t9](https://mill.example/t9)", "[^5]: A note on keepers.", "*Every keeper* pays.", "_Every keeper_ pays.", f"> {_ITEM}")
    add("o", f"'''Every keeper''' of a granary. {_LONG}", f"''Every keeper'' pays. {_LONG}", f"{_LONG} [[Mill:keepers|keepers]]", f"{_LONG} [https://mill.example/t9 text]", "{{Infobox mill|number=9|topic=Keepers}}", f"{_LONG}<ref name=\"n9\">Our notes 9.</ref>", f"{_LONG}\n[[Category:Mills]]", "__NOTOC__")
    add("o", "\\documentclass{article}\n\\begin{document}\n" + _ITEM, "\\end{document}", f"\\textbf{{Every keeper}} pays. {_ITEM}", f"\\emph{{Every keeper}} pays. {_ITEM}", f"{_ITEM} \\footnote{{Our notes 9.}}", f"{_ITEM}\n% todo: check \\cite{{act9}}", f"\\noindent {_ITEM}", f"{_ITEM} \\href{{https://mill.example/t9}}{{text}}", "Each keeper pays \\$40 a day.")
    return rows


def _link(name: str) -> str:
    return f'<a href="https://mill.example/{name}">{name}</a>'


_BARS = [
    " | ".join(map(_link, ("Home", "Acts", "Search"))),
    "[Home](https://mill.example) [Acts](https://mill.example/acts)",
    f"<ul><li>{_link('Rules')}</li><li>{_link('Forms')}</li><li>{_link('Mills')}</li></ul>",
    f"<p>{_link('Terms')} {_link('Privacy')} {_link('Contact')}</p>",
    "[[Main page]] [[Mill:index|Index]] [[Help]]",
]
_BETWEEN = ["Print Share Save", "Menu", "SESSION NO. 9", "Page 9 of 92", "You are here:"]


def _pages() -> list[list[tuple[str, str]]]:
    """Pages with their furniture: bars of links stand together, and little stands between them; a link in running text stands between long blocks."""
    out = []
    kinds = ["bo", "bo", "blo", "bo", "bo"]
    for k, bar in enumerate(_BARS):
        other, mine = (k + 1) % len(_BARS), (kinds[k], bar)
        across = (kinds[other], _BARS[other])
        out.append([mine, across, ("ho" if k % 2 else "h", "<p><h1>Mills</h1>" if k % 2 else "# " + _TITLE), ("", _LONG), ("", _ITEM), mine])
        out.append([mine, ("b", _BETWEEN[k]), across, ("", _LONG), ("", _LONG)])
        out.append([across, mine, ("o", f"<p>{_LONG}</p>"), ("", _ITEM), across])
        out.append([mine, ("", _ITEM), ("h", "# " + _TITLE), ("", _ITEM), across, ("", _LONG), mine])
        out.append([("", _LONG), ("", _LONG), across, ("b", _BETWEEN[(k + 2) % 5]), mine])
        out.append([("", _BETWEEN[k]), ("", _LONG), ("", _BETWEEN[(k + 3) % 5]), ("", _ITEM)])
        out.append([("", _LONG), ("o", f"<p>{_link('see')} {_link('rule')} {_link('9')}</p>"), ("", _LONG), ("o", f"{_LONG} [Acts](https://mill.example/acts)"), ("", _ITEM)])
        out.append([("", _LONG), ("lo", f"<ul><li>{_link('Rules')} {_ITEM}</li><li>{_ITEM}</li></ul>"), ("", _ITEM), ("o", f"See {_link('Mill rule 9')}."), ("", _LONG)])
    short = [("h", "== Mills =="), ("o", "'''Every''' [[Mill|mill]]."), ("l", "* One\n* Two"), ("o", "See [rule 9](https://mill.example/r9)."), ("", "It is new."), ("o", f"<p>Read {_link('this')}.</p>")]
    return out + [short, short[::-1], [short[1], short[3], short[5]]]


def documents() -> list[list[tuple[str, str]]]:
    """Every labelled block in running text, in four places: between long blocks, at either end, and beside a heading."""
    text = cycle([("", _LONG), ("", _ITEM), ("", "    (1) " + _LONG), ("", "SEC. 9. " + _TITLE.upper() + ".")])
    head = cycle([("h", "# " + _TITLE), ("h", "== " + _TITLE + " =="), ("h", _TITLE + "\n" + "-" * 24)])
    out = []
    for k, row in enumerate(examples()):
        places = ([next(text), row, next(text)], [row, next(text), next(text)], [next(text), next(text), row], [next(head), row, next(head), next(text)])
        out += [places[k % 4], places[(k + 1) % 4]]
    return out + _pages()
