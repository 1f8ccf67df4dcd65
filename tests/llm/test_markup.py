import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lawloom.llm import markup
from lawloom.llm.markup_examples import FURNITURE, KINDS, documents

HELD_OUT = [
    ("", "No boat < 9 m may pass; fees are $3 to $7.\r\n\r\n    (1) First.\r\n    (2) Second.\r\n\r\n* * * * *\r\n\r\nSEC. 2. BOATS."),
    ("", "The word ``boat'' has 2*3*4 meanings_here and there_too, see C:\\boats\\x."),
    ("h", "### Boats\n\nSome text follows here."),
    ("h", "Boats and ships\n---------------\n\nText."),
    ("l", "# Boats pay two coins for every day they stay in port.\n# Ships pay four coins for every day they stay in port."),
    ("l", "3) Boats pay.\n4) Ships pay."),
    ("co", "<p>See <tt>x &lt; 1</tt> now</p>"),
    ("c", "```py\nprint('<b>')\n\n# not a heading\n```"),
    ("f", "It is $a_i + b$ then."),
    ("ft", "| a | b |\n| --- | --- |\n| $x^2$ | 1 |"),
    ("o", "<HTML><BODY><PRE>\nSEC. 1. BOATS.\n\n    (1) Boats.\n</PRE></BODY></HTML>"),
    ("hlo", "<body><h2 id=a>Boats</h2><ol><li>One<li>Two</ol></body>"),
    ("hlfo", "\\section{Boats}\n\n\\begin{itemize}\n\\item One\n\\end{itemize}\n\nWe have \\(x\\) and pay \\$9."),
    ("o", "Boats[^1] and [ships](https://ship.example)."),
    ("o", "{{Stub}}\nBoats are ''fast''."),
]


NAMES = {**KINDS, FURNITURE: "furniture"}


def test_training_table_is_learned():
    for d in documents():
        assert markup.block_kinds([b for _, b in d]) == [{NAMES[x] for x in kinds} for kinds, _ in d], d


def _a(name):
    return f'<a href="/x/{name}">{name.title()}</a>'


_BOAT = "No boat longer than nine metres may pass the lock unless the keeper has been told of it on the day before and has agreed."
_SHORT = "Every boat pays two coins, or four if it carries salt."
_NAV = f"{_a('start')} - {_a('boats')} - {_a('ports')} - {_a('rules')}"
_FOOT = f"<p>{_a('imprint')} {_a('data')}</p>"
#: Documents with other words than the training table's; letters as there.
HELD_OUT_PAGES = [
    [("bo", _NAV), ("bo", _FOOT), ("o", "<h1>".replace("h1", "div") + _BOAT + "</div>"), ("", _SHORT), ("bo", _NAV)],
    [("bo", _NAV), ("b", "Log in"), ("bo", "[Up](/u) [Down](/d)"), ("h", "## Boats of the port"), ("", _BOAT), ("", _BOAT)],
    [("", _BOAT), ("", _SHORT), ("bo", "[Up](/u) [Down](/d)"), ("b", "Last seen in May"), ("bo", _NAV)],
    [("", "Port paper"), ("", _BOAT), ("", "No. 12"), ("", _BOAT)],
    [("", _BOAT), ("o", f"<p>{_a('annex')}</p>"), ("", _BOAT), ("", _SHORT)],
    [("", _BOAT), ("o", f"[The annex to the rules on boats](/annex)"), ("", _BOAT), ("o", f"{_SHORT} {_a('more')}")],
    [("h", "# Boats of the port"), ("", _BOAT), ("l", f"# {_SHORT}\n# {_BOAT}"), ("h", "# Ships"), ("", _SHORT)],
    [("bo", f"<div>{_a('start')} {_a('rules')}</div>"), ("b", "Small print"), ("bo", _FOOT), ("l", f"* {_SHORT}"), ("", _BOAT)],
]


def accuracy(without=()):
    grown = markup.train(documents(), without)
    got = markup.told([[b for _, b in d] for d in HELD_OUT_PAGES], grown)
    pairs = [(k, {NAMES[x] for x in kinds}) for ks, d in zip(got, HELD_OUT_PAGES) for k, (kinds, _) in zip(ks, d)]
    return sum(a == b for a, b in pairs) / len(pairs)


def test_neighbours_and_density_tell_furniture():
    everything, alone, marks_only = accuracy(), accuracy(markup.AROUND), accuracy((*markup.AROUND, "link_density", "words", "words_a_line"))
    print(f"held-out blocks told right: {everything:.3f}; without neighbours {alone:.3f}; by marks alone {marks_only:.3f}")
    assert everything >= 0.95 and everything > alone > marks_only
    cuts = {name: _features(tree) for name, tree in markup.trees().items()}
    assert {"link_density", "link_density_before", "link_density_after", "words_after"} <= cuts["furniture"]
    assert "words" in cuts["heading"] and "words" in cuts["list"]


def _features(tree):
    return set() if tree.feature < 0 else {markup.SEEN[tree.feature]} | _features(tree.low) | _features(tree.high)


def test_furniture_is_no_element_and_goes_from_clean_text():
    page = "\n\n".join(b for _, b in HELD_OUT_PAGES[1])
    assert markup.kinds([page]) == [["heading", "other"]]
    assert markup.clean([page]) == [f"## Boats of the port\n\n{_BOAT}\n\n{_BOAT}"]


@pytest.mark.parametrize("letters, text", HELD_OUT)
def test_held_out_texts(letters, text):
    assert markup.kinds([text]) == [sorted(KINDS[x] for x in letters)]


def test_clean_text_keeps_structure():
    text = (
        "<html><body>\n<h2>Boats</h2>\n\n<p>A <b>boat</b> &amp; a ship.</p>\n\n<ul>\n<li>One\n<li>Two\n</ul>\n\n"
        "<pre><code>a &lt; b</code></pre>\n\nwhere \\(x^2\\) holds.\n\n<table><tr><td>a</td><td>1</td></tr></table>\n</body></html>"
    )
    assert markup.clean([text])[0] == "## Boats\n\nA boat & a ship.\n\n- One\n- Two\n\n```\na < b\n```\n\nwhere $x^2$ holds.\n\n| a | 1 |"
    tex = "\\subsection*{Boats}\n\n\\emph{Every} boat pays \\$9.\n\n\\begin{enumerate}\n\\item One\n\\end{enumerate}\n\n\\begin{tabular}{lr}\na & 1 \\\\\nb & 2 \\\\\n\\end{tabular}"
    assert markup.clean([tex])[0] == "### Boats\n\nEvery boat pays $9.\n\n- One\n\n| a | 1 |\n| b | 2 |"
    wiki = "=== Boats ===\n\n'''Every''' [[Boat|boat]].\n\n* One\n* Two\n\n<source>a < b</source>"
    assert markup.clean([wiki])[0] == "### Boats\n\nEvery boat.\n\n- One\n- Two\n\n```\na < b\n```"


def test_plain_text_is_left_alone():
    text = "SEC. 2. BOATS.\n\n    (1) A boat pays $3 to $7.\n\n* * * * *"
    assert markup.clean([text])[0] == text
    assert markup.clean([None, ""]) == [None, ""] and markup.clean([]) == []


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab1 \n\r\t#*-=`$\\{}[]()<>/|_~&;'!%.,\x00"), max_size=60))
def test_nothing_crashes(text):
    markup.kinds([text, None])
    markup.clean([text.replace("\x00", "")])


def test_long_text_is_quick():
    markup.kinds(["a " * 50_000 + "<p" * 2000 + "`" * 2001 + "$x" * 2000])


def test_tables(spark):
    rows = [(1, "# Boats", 0), (1, "# Boats", 0), (2, None, 0), (3, "", 0), (None, "# x", 0), (4, "<p>x</p>", 0)]
    d = spark.createDataFrame(rows, "file_id bigint, text string, elem int")
    assert sorted(tuple(r) for r in markup.found_elements(d).collect()) == [(1, "heading"), (4, "other")]
    assert sorted((r.file_id, r.text) for r in markup.clean_files(d).where("file_id <> 2").collect()) == [(1, "# Boats"), (3, ""), (4, "x")]
    assert markup.found_elements(d.limit(0)).count() == 0 and markup.clean_files(d.limit(0)).count() == 0
