import time

import pytest

from docmill.llm import markup as m
from docmill.llm.markup import clean, strip_markup

PLAIN = ["For values a < b and c > 3 the cell is left empty.", "R&D and Q&A share one drawer.", "Costs rose from $40 to $65 in that quarter.", "The volume is 3 * 4 * 5.", "The field names are row_count and file_size_kb.", "See [3] and [draft] at the back.", "The words {net} and {gross} are placeholders.", "The old path C:\\temp\\new\\archive was moved.", "if (a < b && c > d) return a;", "– a dash\n• a bullet\n(1) a number", "Ticket #482 in C# or F#", "=> and <-", "5^2 = 25, about 100%", "The score was 3:2 -- a surprise.", "A ~ mark", "Sum = x[i] + x[j], for i != j.", "", "x" * 100_000]


@pytest.mark.parametrize("text", PLAIN)
def test_plain_text_is_left_alone(text):
    assert clean(text) == (text, 0)


CASES = {
    "<p>One <b>two</b></p>": "One two", "a &amp; b": "a & b", "x<br>y": "x\ny", "no partner</p>": "no partner",
    "# Head": "Head", "**bold** text": "bold text", "先看*命令行*，": "先看命令行，", "see [the page](a/b.md) now": "see the page now",
    "- [x] done": "- done", "```\na < b\n```": "a < b", "| a | b |\n|---|---|\n| 1 | 2 |": "a\tb\n1\t2", "word[^1]": "word",
    "== Head ==": "Head", "''it'' and [[page|name]]": "it and name", "text{{cn}} more": "text more", "{| class=x\n|-\n| a || b\n|}": "a\tb",
    "\\section{Head}": "Head", "\\emph{word} and~\\cite{x} more": "word and more", "$v = \\frac{s}{t}$": "v = s / t",
    "\\begin{tabular}{ll}\na & b \\\\\n\\end{tabular}": "a\tb", "\\begin{itemize}\n \\item one\n\\end{itemize}": "- one", "再$x_{4}$ 次": "再x_4 次",
    "<script>var n = 1 < 2;</script>kept": "kept", "<pre><code>a &lt; b\n  c</code></pre>": "a < b\n  c",
}


@pytest.mark.parametrize("text", CASES)
def test_markup_becomes_text(text):
    out, marks = clean(text)
    assert marks > 0 and out == CASES[text]


def test_link_lists_lose_to_text():
    body = "A long paragraph, with commas, that says a good deal. " * 8
    out, _ = clean(f"<ul><li><a href='a'>Home</a></li><li><a href='b'>News</a></li></ul><div><p>{body}</p></div>")
    assert "Home" not in out and body.strip() in out


def test_table(spark):
    df = spark.createDataFrame([("1", None, 1), ("2", "", 1), ("3", "plain", 1), ("4", "<b>x</b>", 1), ("4", "<b>x</b>", 1)], "parent_id string, content string, marks int")
    got = sorted((r.parent_id, r.clean_text, r.marks) for r in strip_markup(df, ["parent_id"], "content").collect() if r.clean_text is not None)
    assert got == [("2", "", 0), ("3", "plain", 0), ("4", "x", 2), ("4", "x", 2)]
    assert strip_markup(df.limit(0), ["parent_id"], "content").count() == 0


@pytest.mark.parametrize("token", ["<!-- ", '<a href="x.md" ', '<div class="a" id=\'b\' ', '<a href="x.md\n'])
def test_a_token_without_partner_takes_nothing_behind_it(token):
    out, marks = clean(f"Before.\n\n{token}The rest of it,\n\nand more.")
    assert marks > 0 and "The rest of it," in out and "and more." in out and "<" not in out and "href" not in out


def test_best_container_and_its_siblings():
    links = "".join(f"<li><a href='/{i}'>Menu entry {i}</a></li>" for i in range(8))
    body = "".join(f"<p>Paragraph {i} says, at some length, what the page is about, and why.</p>" for i in range(6))
    page = f"<html><body><ul>{links}</ul><div><h2>Title</h2>{body}<table><tr><td>1</td><td>2</td></tr></table></div><p>A closing line.</p></body></html>"
    text, marks = m.clean(page)
    assert marks > 30 and "Menu entry" not in text and "Title" in text and "Paragraph 5" in text and "1\t2" in text and text.endswith("A closing line.")


def test_marks_come_from_the_tree():
    root = m.Parser().parse("# Head\n\nplain *word* here\n\n<!-- note -->\n<b>x</b>")
    held = []
    stack = [root]
    while stack:
        node = stack.pop()
        held.append(node.marks)
        stack += node.children
    assert sum(held) == m.rate(root) == m.clean("# Head\n\nplain *word* here\n\n<!-- note -->\n<b>x</b>")[1] > 4


def test_time_grows_with_the_text():
    for part in ("<pre>x ", "<ref>x ", "\\begin{a}\n", "<div>", "<li>a\n", "```x\n", "1. a\n", "<a href='x'>", "```a\n<b>x</b>\n```\ntext <i>y</i>\n"):
        started = time.perf_counter()
        m.clean(part * 10_000)
        assert time.perf_counter() - started < 10, part


def test_private_signs_and_formulas():
    assert m.clean("\uf8f05\uf8f1 \ufdd0 $\\frac{a}{b}$") == ("\uf8f05\uf8f1 \ufdd0 a / b", 1)
    assert m.clean("".join(map(chr, range(0xFDD0, 0xFDF0))) + " $\\frac{a}{b}$")[0].endswith(" a / b")


GOLDEN = {
    "html": [("<p>One</p><p>Two</p>", "One\nTwo"), ("<h1>T</h1>text", "T\n\ntext"), ("<ul><li>a</li><li>b</li></ul>", "- a\n- b"), ("<ol><li>a</li><li>b</li></ol>", "1. a\n2. b"), ("a &amp; b", "a & b"), ("<b>bold</b> and <i>it</i>", "bold and it"), ("<pre>x  =  1</pre>", "x  =  1"), ("a<br>b", "a\nb"), ("<script>x()</script>after", "after"), ("<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>", "a\tb\n1\t2"), ("x <!-- no --> y", "x  y"), ("lost </div> tag", "lost\n tag")],
    "markdown": [("# T\n\ntext", "T\n\ntext"), ("- a\n- b", "- a\n- b"), ("1. a\n2. b", "1. a\n2. b"), ("**b** and *i*", "b and i"), ("`x = 1`", "x = 1"), ("```py\nx = 1\n```", "x = 1"), ("> quoted", "quoted"), ("see [it](http://x.org) there now", "see it there now"), ("![alt](a.png)", "alt"), ("| a | b |\n| --- | --- |\n| 1 | 2 |", "a\tb\n1\t2"), ("Title\n=====\nbody", "Title\n\nbody"), ("~~gone~~", "gone")],
    "wiki": [("== T ==\ntext", "T\n\ntext"), ("'''b''' and ''i''", "b and i"), ("[[Page|label]] stands in this line", "label stands in this line"), ("* a\n** b", "- a\n  - b"), (": a\n: b", "- a\n- b"), ("{| class=x\n|-\n! a !! b\n|-\n| 1 || 2\n|}", "a\tb\n1\t2"), ("text{{cn}} goes on", "text goes on"), ("__NOTOC__\ntext", "text"), ("[http://x.org label] stands in this line", "label stands in this line"), ("a<ref>note</ref> b", "a b")],
    "latex": [("\\section{T}\ntext", "T\n\ntext"), ("\\textbf{b} and \\emph{i}", "b and i"), ("$\\frac{a}{b}$", "a / b"), ("\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}", "- a\n- b"), ("\\begin{verbatim}\nx  = 1\n\\end{verbatim}", "x  = 1"), ("\\begin{tabular}{ll}\na & b \\\\\n1 & 2 \\\\\n\\end{tabular}", "a\tb\n1\t2"), ("text\\footnote{note} on", "text (note) on"), ("see~\\cite{x} there", "see there"), ("a \\& b", "a & b"), ("% remark\ntext", "text")],
}


@pytest.mark.parametrize("kind", GOLDEN)
def test_golden(kind):
    assert [(source, m.clean(source)[0]) for source, _ in GOLDEN[kind]] == GOLDEN[kind]
