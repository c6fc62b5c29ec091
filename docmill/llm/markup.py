"""Markup residue: HTML, Markdown, wiki markup and LaTeX become clean text that keeps headings, lists, code, tables and formulas.

A text is parsed into one tree, whatever markups it mixes: line constructs (headings, lists, quotes, tables, fences,
environments) and HTML elements become containers, the rest paragraphs. Paragraphs then pass points for their length and
commas to their ancestors, discounted by the share of linked text; the best container and its siblings of some worth are
kept and written out as plain text. Every node knows how many constructs of markup it was made of: a text whose tree has none
is no case.
"""

from __future__ import annotations

import html
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

#: Element names of HTML and of wiki pages.
BLOCK_TAGS = set("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead title tr ul syntaxhighlight source gallery poem references br".split())
INLINE_TAGS = set("a abbr acronym audio b base bdi bdo big button canvas cite code col colgroup data datalist del dfn em embed font i iframe img input ins kbd label link map mark meta meter object optgroup option output param picture progress q rp rt ruby s samp select slot small span strike strong sub sup svg template textarea time track tt u var video wbr ref math nowiki noinclude includeonly onlyinclude script style noscript".split())
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED_TAGS = {"script", "style", "template", "head", "noscript"}
#: LaTeX commands that take no braces, and macros in braces.
BARE_COMMANDS = "item|hline|toprule|midrule|bottomrule|noindent|indent|newpage|clearpage|pagebreak|linebreak|newline|par|maketitle|tableofcontents|centering|raggedright|bigskip|medskip|smallskip|small|large|Large|tiny|bfseries|itshape|quad|qquad|ldots|dots|LaTeX|TeX|appendix|today"
MACROS = "code|noformat|toc|quote|panel|info|note|warning|tip|color|anchor|section|column|children|excerpt|expand|status|jira"
MATH_SIGNS = "alpha α beta β gamma γ delta δ epsilon ε lambda λ mu μ pi π rho ρ sigma σ tau τ phi φ omega ω times × cdot · pm ± leq ≤ geq ≥ neq ≠ approx ≈ infty ∞ sum ∑ int ∫ partial ∂ to →".split()
_math = dict(zip(MATH_SIGNS[::2], MATH_SIGNS[1::2]))

_tag = regex.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s+[^<>]*|\s*/)?)>|<!--.*?-->|<!--|<!DOCTYPE[^>]*>|<\?[a-z]+[^>]*\?>|<!\[CDATA\[|\]\]>|-->", regex.S | regex.I)
_cut_tag = regex.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)(?:\s+[a-z-]+\s*=\s*(?:\"[^\"<>\n]*+\"?|'[^'<>\n]*+'?))++[ \t]*/?(?=[^<>]*\Z)", regex.I)
_entity = regex.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,31}|#\d{1,7}|#[xX][0-9A-Fa-f]{1,6});")
_fence = regex.compile(r"^[ \t]*(```+|~~~+)[ \t]*([\w+#.-]*)[ \t]*$")
_atx = regex.compile(r"^ {0,3}(#{1,6})[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$")
_wiki_head = regex.compile(r"^[ \t]*(={2,6})[ \t]*([^=\s](?:.*[^=\s])?)[ \t]*\1[ \t]*$")
_jira_head = regex.compile(r"^[ \t]*h([1-6])\.[ \t]+(.*)$")
_setext = regex.compile(r"^ {0,3}(={3,}|-{3,})[ \t]*$")
_rule = regex.compile(r"^ {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,}|-{4,})$")
_task = regex.compile(r"^([ \t]*)(?:[-*+]|\d+[.)])[ \t]+\[([ xX])\][ \t]+(.*)$")
_bullet = regex.compile(r"^([ \t]*)([-+]|[*#:;]{1,6})[ \t]+(\S.*)$")
_number = regex.compile(r"^([ \t]*)(\d{1,3})\.[ \t]+(\S.*)$")
_quote = regex.compile(r"^[ \t]*((?:>[ \t]?)+)(.*)$")
_row = regex.compile(r"^[ \t]*\|(?![-}+])(.*)\|[ \t]*$")
_row_rule = regex.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$")
_wiki_open, _wiki_close = regex.compile(r"^[ \t]*:*\{\|.*$"), regex.compile(r"^[ \t]*\|\}[ \t]*$")
_wiki_line = regex.compile(r"^[ \t]*(\|-|\|\+|[|!])(.*)$")
_begin, _end = regex.compile(r"^[ \t]*\\begin\{([A-Za-z]+\*?)\}(.*)$"), regex.compile(r"^[ \t]*\\end\{([A-Za-z]+\*?)\}[ \t]*$")
_section = regex.compile(r"^[ \t]*\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\{((?:[^{}]|\{[^{}]*\})*)\}(.*)$")
_comment = regex.compile(r"^[ \t]*%+[ \t]?\S.*$|^%+$")
_display = regex.compile(r"^[ \t]*(?:\$\$(.+?)\$\$|\\\[(.+?)\\\])[ \t]*$")
_macro_line = regex.compile(rf"^[ \t]*\{{(?:{MACROS})(?:[:=|][^{{}}]*)?\}}[ \t]*$", regex.I)
_macro_pair = regex.compile(rf"(?<!\\[A-Za-z]{{1,20}}\*?)\{{({MACROS})(?:[:=|][^{{}}]*)?\}}(.*?)\{{\1\}}", regex.I | regex.S)
_macro = regex.compile(rf"(?<!\\[A-Za-z]{{1,20}}\*?)\{{(?:{MACROS})(?:[:=|][^{{}}]*)?\}}", regex.I)
_switch = regex.compile(r"__(?:NOTOC|TOC|FORCETOC|NOEDITSECTION|NOINDEX|INDEX)__|\[TOC\]|\[\[_TOC_\]\]", regex.I)
_target = r"(?:[^\s()<>\[\]|]|\([^\s()]*\))"
#: Inline constructs: (pattern, what stays, whether the kept text is linked). Applied in this order.
_inline: list[tuple[regex.Pattern, object, bool]] = [
    (_switch, "", False),
    (regex.compile(rf"!\[([^\[\]\n]*)\]\({_target}*(?:[ \t]+[\"'][^\"'\n]*[\"'])?\)"), r"\1", False),
    (regex.compile(r"\[\[(?:File|Image|Datei|Fichier|Archivo|Файл|文件):([^\[\]\n|]*)(?:\|[^\[\]\n]*)?\]\]", regex.I), "", False),
    (regex.compile(r"\[\[(?:[^\[\]\n|]*\|)?([^\[\]\n|]+)\]\]"), r"\1", True),
    (regex.compile(rf"\[([^\[\]\n]+)\]\({_target}*(?:[ \t]+[\"'][^\"'\n]*[\"'])?\)"), r"\1", True),
    (regex.compile(r"\[([^\[\]\n|]+)\|[^\[\]\n|\s]+\]"), r"\1", True),
    (regex.compile(r"\[(?:https?|ftp)://[^\s\]]+[ \t]+([^\[\]\n]+)\]"), r"\1", True),
    (regex.compile(r"<(?:https?://|mailto:)([^\s<>]+)>"), r"\1", True),
    (regex.compile(r"(?m)^[ \t]*\[\^?[^\[\]\n]+\]:[ \t]+\S.*$"), "", False),
    (regex.compile(r"\[\^[^\[\]\s]+\]"), "", False),
    (regex.compile(r"\[([^\[\]\n]+)\]\[[^\[\]\n]*\]"), r"\1", True),
    (regex.compile(r"\{\{\{?[^{}\n]*(?:\{\{[^{}\n]*\}\}[^{}\n]*)*\}?\}\}"), lambda m: _template(m[0]), False),
    (regex.compile(r"\{\{(?=\w)[^{}\n]*$|^[^{}\n]*\w\}\}(?=\s|$)", regex.M), lambda m: m[0].replace("{{", "").replace("}}", ""), False),
    (regex.compile(r"``([^`\n]{1,200}?)''"), "“\\1”", False),
    (regex.compile(r"'''''([^'\n]+)'''''|'''([^'\n]+)'''|(?<!')''(?=[^\s'])([^\n]+?)(?<=[^\s'])''(?!')"), lambda m: m[1] or m[2] or m[3], False),
    (regex.compile(r"(?<!`)(`+)(?!`)([^`\n]+)(?<!`)\1(?!`)"), r"\2", False),
    (regex.compile(r"\*\*\*(?=\S)([^*\n]+?)(?<=\S)\*\*\*|\*\*(?=\S)([^*\n]+?)\*\*|\*\*([^*\n]+?)(?<=\S)\*\*"), lambda m: m[1] or m[2] or m[3], False),
    (regex.compile(r"(?<![\w\\])__(?=\S)([^_\n]+?)(?<=\S)__(?![\w])|(?<=[\p{Han}\p{Kana}，。；：、])__(?=\S)([^_\n]+?)(?<=\S)__|(?<!\w)__(?=\S)([^_\n]+?)(?<=\S)__(?=[\p{Han}])"), lambda m: m[1] or m[2] or m[3], False),
    (regex.compile(r"~~([^~\n]*[^~\s][^~\n]*?)~~"), r"\1", False),
    (regex.compile(r"(?<![*\\])\*(?=[^\s*])([^*\n]*?)(?<=[^\s*])\*(?!\*)"), r"\1", False),
    (regex.compile(r"(?<![\w\\])_(?=[^\s_])([^_\n]*?)(?<=[^\s_])_(?!\w)"), r"\1", False),
    (_macro_pair, r"\2", False),
    (_macro, "", False),
]
_formula = regex.compile(r"\$\$(?=\S)([^$\n]+?)\$\$|\\\[(.+?)\\\]|\\\((.+?)\\\)|(?<!\\)\$((?:\\[A-Za-z]+|[A-Za-z])(?:[_^]\{[^{}$\n]*\}[^$\n]{0,80}?|\{[^{}$\n]*\}[^$\n]{0,80}?)?)(?<=[}A-Za-z\d])\$(?![A-Za-z]*\d*\$)(?<=\\[A-Za-z]+\$|\}\$)|(?<![\\$A-Za-z0-9])\$(?=[^\s$\d]|\d+[^$\n]*[\\^_=])([^$\n]*?[^\s$\\])\$(?![A-Za-z0-9])")
_argument = r"\{((?:[^{}\n]|\{[^{}\n]*\})*)\}"
_link_command = regex.compile(rf"\\(?:href|url|hyperref){_argument}{_argument}")
_drop_command = regex.compile(rf"[~ ]?\\(?:label|cite[a-z]*|ref|eqref|pageref|index|vspace|hspace|usepackage|documentclass|input|include|bibliography|bibliographystyle|footnotemark)\*?(?:\[[^\[\]\n]*\])?{_argument}(?:{_argument})?")
_note_command = regex.compile(rf"\\(?:footnote|thanks|marginpar)\*?{_argument}")
_text_command = regex.compile(rf"\\[A-Za-z]+\*?(?:\[[^\[\]\n]*\])?{_argument}")
_bare_command = regex.compile(rf"\\(?:{BARE_COMMANDS})(?![A-Za-z])\*?[ \t]?")
_line_break = regex.compile(r"[ \t]*(?<![\w:])\\\\(?:\[[^\]\n]*\])?[ \t]*$", regex.M)
_escape = regex.compile(r"(?<![\\\w])\\([&%$#_{}])")
_commas = regex.compile(r"[,，、;；]")


@dataclass
class Node:
    """A container or a paragraph: kind, level, text of a leaf, children; what scoring adds."""

    kind: str
    level: int = 0
    text: str = ""
    children: list[Node] = field(default_factory=list)
    linked: int = 0
    marks: int = 0
    items: int = 0
    score: float = 0.0
    points: float = 0.0
    size: int = 0
    links: int = 0

    def density(self) -> float:
        """Share of linked text, once size and links are summed up."""
        return self.links / max(1, self.size)


def _template(source: str) -> str:
    """What stays of a template call: a bare word is text that was wrapped, everything else is a reference to a page."""
    inner = source.strip("{}").strip()
    return "" if "|" in inner or "=" in inner or inner.lower() in {"cn", "citation needed", "stub", "toc", "clear", "reflist"} else inner


def _brace_free(text: str) -> str:
    return text.replace("{", "").replace("}", "")


def formula(source: str) -> str:
    """A formula in LaTeX as plain text: fractions with a slash, roots as sqrt, letters and signs by name."""
    text = source.strip()
    for _ in range(4):
        text, n = regex.subn(r"\\[dt]?frac\{([^{}]*)\}\{([^{}]*)\}", r"\1 / \2", text)
        text, m = regex.subn(r"\\sqrt\{((?:[^{}]|\{[^{}]*\})*)\}", r"sqrt(\1)", text)
        if not n + m:
            break
    text = regex.sub(r"\\(?:text|mathrm|mathbf|mathit|operatorname)\{([^{}]*)\}", r"\1", text)
    text = regex.sub(r"([\^_])\{(\w)\}", r"\1\2", text)
    text = regex.sub(r"\\([A-Za-z]+)", lambda m: _math.get(m[1], m[1]), text)
    return regex.sub(r"([\^_])\{([^{}]*)\}", r"\1(\2)", text).replace("\\,", " ").replace("\\;", " ")


class Parser:
    """Builds the tree of one text and counts its markup."""

    def __init__(self) -> None:
        self.marks = self.given = 0
        self.linked = 0
        self.depth = 0

    def add(self, parent: Node, node: Node) -> Node:
        """Hangs a node into the tree; it takes the constructs that were recognised since the node before."""
        node.marks, self.given = self.marks - self.given, self.marks
        parent.children.append(node)
        return node

    def inline(self, text: str) -> str:
        """A run of text without its inline markup; linked signs are counted."""
        self.linked = 0
        if not _special.search(text):
            return text
        held: list[str] = []
        free = [c for c in _stand_ins if c not in text] if _formula.search(text) else []

        def keep(m: regex.Match) -> str:
            self.marks += 1
            held.append(formula(next(g for g in m.groups() if g is not None)))
            return f"{free[0]}{len(held) - 1}{free[1]}" if len(free) > 1 else held[-1]

        text = _formula.sub(keep, text)
        for pattern, stays, is_link in _inline:
            if is_link:
                for m in pattern.finditer(text):
                    self.linked += len(m[1])
            text, n = pattern.subn(stays, text)
            self.marks += n
        if "\\" in text:
            for m in _link_command.finditer(text):
                self.linked += len(m[2])
            for pattern, stays in ((_link_command, r"\2"), (_drop_command, ""), (_note_command, r" (\1)")):
                text, n = pattern.subn(stays, text)
                self.marks += n
            for _ in range(3):
                text, n = _text_command.subn(r"\1", text)
                self.marks += n
                if not n:
                    break
            for pattern, stays in ((_bare_command, ""), (_line_break, ""), (_escape, r"\1")):
                text, n = pattern.subn(stays, text)
                self.marks += n
        if held and len(free) > 1:
            text = regex.sub(f"{free[0]}(\\d+){free[1]}", lambda m: held[int(m[1])], text)
        return text

    def entities(self, text: str) -> str:
        def one(m: regex.Match) -> str:
            plain = html.unescape(m[0])
            if plain == m[0]:
                return plain
            self.marks += 1
            return plain.replace("\xa0", " ")

        return _entity.sub(one, text) if "&" in text else text

    # lines

    def lines(self, text: str, root: Node) -> None:
        """Markdown, wiki and LaTeX line constructs under root."""
        lines = text.split("\n")
        i, para = 0, []
        endless: set[str] = set()  # fences that nothing closes further on
        last_end = {m[1].rstrip("*"): j for j, line in enumerate(lines) if "\\end" in line and (m := _end.match(line))}

        def flush() -> None:
            if para:
                clean = self.inline("\n".join(para))
                self.add(root, Node("p", text=clean, linked=self.linked))
                para.clear()

        def leaf(kind: str, source: str, level: int = 0) -> None:
            flush()
            self.marks += 1
            clean = self.inline(source)
            self.add(root, Node(kind, level, clean, linked=self.linked))

        while i < len(lines):
            line = lines[i]
            if not line.strip():
                flush()
                self.add(root, Node("gap"))
            elif m := _fence.match(line):
                closes = lambda j: lines[j].lstrip().startswith(m[1]) and not lines[j].strip().strip(m[1][0])  # noqa: E731,B023
                end = None if m[1] in endless else next((j for j in range(i + 1, len(lines)) if closes(j)), None)
                if end is None:
                    endless.add(m[1])
                flush()
                self.marks += 1
                if end is not None:
                    self.add(root, Node("code", text="\n".join(lines[i + 1 : end])))
                    i = end
            elif (m := _begin.match(line)) is not None:
                flush()
                if last_end.get(m[1].rstrip("*"), -1) > i and self.depth < DEEPEST:
                    self.depth += 1
                    i = self.environment(lines, i, m[1].rstrip("*"), root)
                    self.depth -= 1
                else:  # without its end it takes nothing with it
                    self.marks += 1
            elif _end.match(line) or _macro_line.match(line) or _comment.match(line):
                flush()
                self.marks += 1
            elif m := _section.match(line):
                leaf("h", m[2], {"part": 1, "chapter": 1, "section": 1, "subsection": 2}.get(m[1], 3))
                if m[3].strip():
                    para.append(m[3])
            elif m := _display.match(line):
                flush()
                self.marks += 1
                self.add(root, Node("formula", text=formula(m[1] or m[2])))
            elif _wiki_open.match(line):
                flush()
                i = self.wiki_table(lines, i, root)
            elif m := _wiki_head.match(line):
                leaf("h", m[2], len(m[1]) - 1)
            elif (m := _jira_head.match(line)) or (m := _atx.match(line)) and m[2]:
                level = int(m[1]) if m[1].isdigit() else len(m[1])
                body = m[2]
                after = lines[i + 1] if i + 1 < len(lines) else ""
                before = lines[i - 1] if i else ""
                listed = m[1] == "#" and not _atx_tail.search(line) and any(x.startswith(("# ", "## ")) for x in (before, after)) and (len(body) > 60 or body[-1:] in ".。!?")
                leaf("item" if listed else "h", body, level)
            elif _setext.match(line) and para and len(para) == 1:
                head = para.pop()
                leaf("h", head, 1 if "=" in line else 2)
            elif _row_rule.match(line) or _rule.match(line) or _setext.match(line):
                flush()
                self.marks += 1
            elif m := _row.match(line):
                flush()
                self.marks += 1
                cells = [self.inline(c.strip()) for c in m[1].split("|")]
                self.add(root, Node("row", text="\t".join(cells)))
            elif m := _task.match(line):
                leaf("item", m[3], len(m[1].expandtabs(4)) // 2 + 1)
            elif m := _bullet.match(line):
                leaf("item", m[3], max(len(m[2]), len(m[1].expandtabs(4)) // 2 + 1))
            elif m := _number.match(line):
                flush()
                self.marks += 1
                clean = self.inline(m[3])
                self.add(root, Node("number", len(m[1].expandtabs(4)) // 2 + 1, clean, linked=self.linked))
            elif m := _quote.match(line):
                flush()
                self.marks += 1
                body = self.add(root, Node("quote"))
                if self.depth < DEEPEST:
                    self.depth += 1
                    self.lines(m[2], body)
                    self.depth -= 1
                else:
                    self.add(body, Node("p", text=self.inline(m[2])))
            else:
                para.append(line)
            i += 1
        flush()
        if self.marks > self.given:
            self.add(root, Node("gap"))

    def environment(self, lines: list[str], i: int, name: str, root: Node) -> int:
        """A LaTeX environment from line i; returns its last line."""
        self.marks += 1
        depth, j = 1, i
        body: list[str] = []
        while depth and j + 1 < len(lines):
            j += 1
            if (m := _begin.match(lines[j])) and m[1].rstrip("*") == name:
                depth += 1
            elif (m := _end.match(lines[j])) and m[1].rstrip("*") == name:
                depth -= 1
            if depth:
                body.append(lines[j])
        text = "\n".join(body)
        if name in {"verbatim", "lstlisting", "minted", "alltt", "Verbatim"}:
            self.add(root, Node("code", text=text))
        elif name in {"equation", "align", "displaymath", "math", "gather", "eqnarray", "multline"}:
            self.add(root, Node("formula", text=formula(text)))
        elif name in {"tabular", "tabularx", "longtable", "array"}:
            table = Node("table")
            for row in regex.split(r"\\\\(?:\[[^\]]*\])?", regex.sub(r"\\(?:hline|toprule|midrule|bottomrule)\b", "", text)):
                if row.strip():
                    self.add(table, Node("row", text="\t".join(self.inline(c.strip()).strip() for c in regex.split(r"(?<!\\)&", row))))
            self.add(root, table)
        elif name in {"itemize", "enumerate", "description"}:
            inner = Node("list")
            items = regex.split(r"(?m)^[ \t]*\\item(?![A-Za-z])(?:\[([^\]\n]*)\])?[ \t]*", text)
            if items[0].strip():
                self.lines(items[0], inner)
            for k, (label, item) in enumerate(zip(items[1::2], items[2::2])):
                part = Node("li" if name != "enumerate" else "ol", level=k + 1)
                self.lines(((label + ": ") if label else "") + item.strip("\n"), part)
                self.add(inner, part)
            self.add(root, inner)
        else:
            inner = Node("quote" if name in {"quote", "quotation", "verse"} else "div")
            self.lines(text, inner)
            self.add(root, inner)
        return j

    def wiki_table(self, lines: list[str], i: int, root: Node) -> int:
        """A wiki table from line i; returns its last line."""
        self.marks += 1
        table, cells, j = Node("table"), [], i
        while j + 1 < len(lines):
            j += 1
            if _wiki_close.match(lines[j]):
                break
            m = _wiki_line.match(lines[j])
            if not m:
                if lines[j].strip():
                    j -= 1
                    break
                continue
            if m[1] == "|-":
                if cells:
                    self.add(table, Node("row", text="\t".join(cells)))
                cells = []
            elif m[1] == "|+":
                self.add(table, Node("p", text=self.inline(m[2].strip())))
            else:
                for cell in regex.split(r"\|\||!!", m[2]):
                    cells.append(self.inline(regex.sub(r"^[^|\[\]{}]*=[^|]*\|(?!\|)", "", cell).strip()))
        if cells:
            self.add(table, Node("row", text="\t".join(cells)))
        self.add(root, table)
        return j

    # elements

    def parse(self, text: str) -> Node:
        """The tree of a whole text."""
        root = Node("root")
        stack: list[tuple[str, Node]] = [("root", root)]
        buffer: list[str] = []
        text = text.replace("\r\n", "\n")
        cut = _cut_tag.search(text)
        if cut and cut[2].lower() in BLOCK_TAGS | INLINE_TAGS:
            self.marks += 1
            text = text[: cut.start()] + text[cut.end() :]
        if "<" not in text and "-->" not in text and "]]>" not in text:
            self.lines(self.entities(text) if _entity.search(text) else text, root)
            root.marks += self.marks - self.given
            return root

        link_start: list[int] = []
        held = 0  # signs in the buffer

        def put(part: str) -> None:
            nonlocal held
            buffer.append(part)
            held += len(part)

        def taken() -> str:
            nonlocal held
            source, held = "".join(buffer), 0
            buffer.clear()
            return source

        def flush() -> None:
            if buffer:
                source = taken()
                top = stack[-1][1]
                if top.kind == "code":
                    top.text += self.entities(source)
                elif source.strip():
                    own, linked = self.entities(source.strip("\n")), self.linked_text
                    before = len(top.children)
                    self.lines(own, top)
                    if linked and len(top.children) > before:
                        top.children[-1].linked += linked
                elif "\n" in source and top.kind not in {"list", "table", "tbody", "thead", "row"}:
                    self.add(top, Node("gap"))
                self.linked_text = 0

        self.linked_text = 0
        fences = self._code_spans(text)
        at = fence = 0
        raw_until = None
        tags = list(_tag.finditer(text))
        ends: dict[str, list[int]] = {}  # where elements close
        for m in tags:
            if m[1]:
                ends.setdefault(m[2].lower(), []).append(m.start())
        closes_later = lambda name: name in ends and ends[name][-1] >= at
        open_now: Counter[str] = Counter()
        for m in tags:
            while fence < len(fences) and fences[fence][1] <= m.start():
                fence += 1
            if m.start() < at or fence < len(fences) and fences[fence][0] <= m.start():
                continue
            name = (m[2] or "").lower()
            if m[2] and name not in BLOCK_TAGS and name not in INLINE_TAGS:
                continue
            if raw_until and not (m[1] and name == raw_until):
                continue
            put(text[at : m.start()])
            at = m.end()
            self.marks += 1
            if not m[2]:
                continue
            if raw_until:
                if raw_until in DROPPED_TAGS:
                    taken()
                elif raw_until == "math":
                    source = taken()
                    self.add(stack[-1][1], Node("formula", text=formula(self.entities(source))))
                else:
                    flush()
                    stack.pop()
                raw_until = None
                continue
            closing, void = bool(m[1]), name in VOID_TAGS and name != "source" or m[3].rstrip().endswith("/")
            if name in DROPPED_TAGS or name == "math":
                if not closing and not void and closes_later(name):
                    flush()
                    raw_until = name
            elif name in {"pre", "syntaxhighlight", "source"}:
                if not closing and closes_later(name):
                    flush()
                    node = Node("code")
                    self.add(stack[-1][1], node)
                    stack.append((name, node))
            elif name == "a":
                if closing and link_start:
                    self.linked_text += max(0, held - link_start.pop())
                elif not closing:
                    link_start.append(held)
            elif name == "ref":
                if not closing and not void and closes_later("ref"):
                    at = text.index(">", ends["ref"][bisect_left(ends["ref"], at)]) + 1
            elif name == "br":
                put("\n" if stack[-1][1].kind != "row" else " ")
            elif name in {"td", "th"}:
                if closing:
                    put("\t")
            elif name in BLOCK_TAGS:
                if stack[-1][1].kind == "row":
                    stack[-1][1].text += self.inline(self.entities(taken())).strip().replace("\t ", "\t")
                else:
                    flush()
                if closing:
                    while open_now[name]:
                        popped = stack.pop()[0]
                        open_now[popped] -= 1
                        if popped == name:
                            break
                elif not void:
                    if name in {"p", "li", "tr", "dt", "dd"} and stack[-1][0] in ({"p"} if name == "p" else {name, "p"}):
                        open_now[stack.pop()[0]] -= 1
                    kind = {"ul": "list", "ol": "list", "dl": "list", "tr": "row", "blockquote": "quote"}.get(name, "h" if regex.fullmatch(r"h[1-6]", name) else name)
                    node = Node(kind, int(name[1]) if kind == "h" else 0)
                    if name == "li":
                        ordered = next((n for n, _ in reversed(stack) if n in {"ul", "ol"}), "ul") == "ol"
                        node = Node("ol" if ordered else "li", level=1 + stack[-1][1].items)
                        stack[-1][1].items += 1
                    self.add(stack[-1][1], node)
                    if len(stack) <= DEEPEST:  # deeper ones stand beside each other
                        stack.append((name, node))
                        open_now[name] += 1
        put(text[at:])
        if stack[-1][1].kind == "row":
            stack[-1][1].text += self.inline(self.entities(taken())).strip()
        flush()
        root.marks += self.marks - self.given
        return root

    @staticmethod
    def _code_spans(text: str) -> list[tuple[int, int]]:
        """Fenced code, in which angle brackets are code."""
        return [m.span() for m in regex.finditer(r"(?ms)^[ \t]*(```+|~~~+)[^\n]*\n.*?^[ \t]*\1[ \t]*$|^\\begin\{(?:verbatim|lstlisting)\}.*?^\\end\{(?:verbatim|lstlisting)\}", text)]


#: Noncharacters that stand for formulas while a text is worked on; those that the text itself holds are not used.
_stand_ins = [chr(c) for c in range(0xFDD0, 0xFDF0)]
#: Containers within containers from which on their lines are taken as paragraphs.
DEEPEST = 40
_atx_tail = regex.compile(r"\S[ \t]+#+[ \t]*$")
_special = regex.compile(r"[*_~`\[\]{}\\$]|''|<")


#: Points from which a sibling is worth keeping, and its share of the best container's.
WORTH, SHARE = 0.5, 0.2


def rate(root: Node) -> int:
    """Paragraphs pass points up: one, one a comma, one a hundred signs (three at most), less the share of linked text; whole to the parent, halves and thirds further up. Returns the constructs of markup in the tree."""
    order, stack = [], [(root, ())]
    while stack:
        node, above = stack.pop()
        order.append((node, above))
        stack += [(c, (*above, node)) for c in node.children]
    marks = 0
    for node, above in reversed(order):  # children before parents
        marks += node.marks
        node.size = len(node.text) + sum(c.size for c in node.children)
        node.links = node.linked + sum(c.links for c in node.children)
        node.points += sum(c.points for c in node.children)
        if not node.children and node.kind != "gap" and node.text:
            points = 1 + len(_commas.findall(node.text)) + min(3, node.size / 100)
            if node.kind in {"code", "formula", "h", "row"}:
                points += 2
            node.points = points * (1 - node.density())
            for steps, parent in enumerate(reversed(above)):
                parent.score += node.points / (1 if steps == 0 else 2 * steps)
    return marks


def best_part(root: Node) -> list[Node]:
    """The container with most points, and beside it and beside each container around it the siblings that are worth keeping: those with points of their own (links hardly have any), and headings, code, formulas and tables."""
    best, stack, around = root, [(root, ())], ()
    while stack:
        node, above = stack.pop()
        if node.children and node.score * (1 - node.density()) > best.score * (1 - best.density()):
            best, around = node, above
        stack += [(c, (*above, node)) for c in node.children]
    enough = min(WORTH, SHARE * best.score)
    chain = {id(n) for n in (*around, best)}
    worth = lambda n: id(n) in chain or n.kind in {"gap", "h", "code", "formula", "row", "table"} or n.points >= enough
    for node in around or ((best,) if best is root else ()):
        kept = [n for n in node.children if worth(n)]
        node.children = kept if any(n.kind != "gap" for n in kept) else node.children
    return root.children


def write(nodes: list[Node], depth: int = 0) -> list[str]:
    """Plain lines: headings stand alone, items have a dash or number, rows tabs, code keeps its blanks."""
    out: list[str] = []
    numbered = 0  # numbered lines that end the output
    seen = 0
    for n in nodes:
        for line in out[seen:]:
            numbered = numbered + 1 if _number_line.match(line) else 0
        seen = len(out)
        if n.kind == "gap":
            if out and out[-1]:
                out.append("")
        elif n.kind in {"h", "table", "list", "code", "formula", "quote", "div", "p"} or n.kind in BLOCK_TAGS and n.kind not in {"li", "row", "ol"}:
            body = (n.text.split("\n") if n.text.strip() else []) + write(n.children, depth + (n.kind == "list"))
            while body and not body[-1].strip():
                body.pop()
            if n.kind == "h":
                body = [" ".join(x.strip() for x in body if x.strip())] if body else []
                if body and out and out[-1]:
                    out.append("")
                out += [*body, ""] if body else []
            else:
                out += [x if n.kind == "code" else x.rstrip() for x in body]
        elif n.kind == "row":
            text = n.text or "\t".join(x for x in write(n.children) if x)
            out.append(text.rstrip("\t ").replace("\n", " "))
        elif n.kind in {"item", "number", "li", "ol"}:
            body = [x for x in [*(n.text.split("\n") if n.text else []), *write(n.children, depth)] if x.strip()]
            level = n.level if n.kind in {"item", "number"} else max(1, depth)
            sign = "- " if n.kind in {"item", "li"} else f"{n.level if n.kind == 'ol' else 1 + numbered}. "
            if body:
                out.append("  " * (level - 1) + sign + body[0].strip())
                out += ["  " * level + x.strip() if not x.lstrip().startswith(("- ",)) else x for x in body[1:]]
        elif n.children:
            out += write(n.children, depth)
        elif n.text:
            out += n.text.split("\n")
    return out


_number_line = regex.compile(r"\s*\d+\. ")


def clean(text: str) -> tuple[str, int]:
    """(clean text, number of markup constructs). A text without markup comes back as it is."""
    root = Parser().parse(text)
    marks = rate(root)
    if not marks:
        return text, 0
    lines = write(best_part(root))
    return regex.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip("\n"), marks


def strip_markup(docs: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys..., clean_text, marks): each text without markup and the number of constructs that were found.

    marks is 0 and the text unchanged where there is no markup, be it HTML (elements, entities, comments, with or without
    partner), Markdown, wiki markup or LaTeX. Null stays null with 0 marks; the empty text is clean. Scripts, styles, comments
    and reference marks go; captions of images stay. Repeated rows are kept, other columns ignored. Row by row, no shuffle.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*key, *(clean(text) if text else (text, 0))) for *key, text in batch.itertuples(index=False, name=None)]
            yield pd.DataFrame(rows, columns=[*keys, "clean_text", "marks"])

    return docs.select(*keys, F.col(text_col)).mapInPandas(run, schema + ", clean_text string, marks int")
