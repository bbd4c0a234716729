"""Markup residue in text documents (problem 5).

A text with HTML, Markdown, wiki or LaTeX constructs is parsed to a tree of nodes (headings, paragraphs,
lists, items, tables, rows, code blocks, formulas, links, hidden parts, and a mark for each kind of
construct), whatever mixture of notations it has. Each node is content or residue. A tree-structured
graphical model joins each node's evidence and that of its parent and children; sum-product messages
go up and down the tree. A document is found if the marginal of one of its marks says residue, and
nodes whose marginal says so are left out of its clean text.

The potentials are counted on labelled pages: documents of the corpus without any sign of markup, a
bounded sample, that are written as pages in one of the notations with navigation, scripts, footers
and the like around them, and with sentences that use such signs plainly. They are read by the same
parser, and a node is labelled by whether its words are the document's, not by what the model sees.

Defined cases: null ids are left out; null and empty texts have no markup; repeated rows
give repeated results; an empty table gives an empty result; extra columns are ignored; texts are
used whole, and nesting deeper than the parser's limit is cut flat, not lost.
"""

from __future__ import annotations

import html
import math
import random
import re
from dataclasses import dataclass, field
from functools import lru_cache
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.runtime import map_arrow

# Elements of HTML, and of wiki text that has such (fixed values).
ELEMENTS = "a abbr address article aside audio b big blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em embed fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark math meta nav noscript nowiki object ol optgroup option p param pre q ref s samp script section select small source span strike strong style sub summary sup syntaxhighlight table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr"
BLOCKS = {*"address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()}
VOID = {*"br hr img input link meta col source track wbr param embed".split()}
HIDDEN = {*"script style template head iframe object button select".split()}
_NAMES = "|".join(sorted(ELEMENTS.split(), key=len, reverse=True))

TAG = re.compile(rf"</?(?:{_NAMES})(?:\s[^<>]*)?/?>|<!--|<!doctype\b[^<>]*>|<!\[CDATA\[", re.I)
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
PATHS = re.compile(r"\b[A-Za-z]:\\\S*|\\\\\w[\w.$-]*\\\S*")

#: Constructs that show markup, by notation.
CONSTRUCTS = {
    "markdown": [
        r"(?:\A|\n[ \t]*\n)\ufeff?#{1,6} [^\s#]|\n#{2,6} [^\W\d]",
        r"!?\[[^\]\[\n]+\]\([^()\s]+(?: \"[^\"\n]*\")?\)",
        r"(?<![\w*])\*{2,3}[^\s*](?:[^*\n]*[^\s*])?\*{2,3}(?![\w*])",
        r"(?<![\w_])__[^\s_](?:[^_\n]*[^\s_])?__(?![\w_])",
        r"(?<![\w*/])\*[^\s*](?:[^*\n]*[^\s*])?\*(?![\w*])",
        r"(?<![\w_/.])_[^\s_](?:[^_\n]*[^\s_])?_(?![\w_])",
        r"^[ \t]*(?:```|~~~)",
        r"(?<!`)`[^`\n]+`(?!`)",
        r"^[ \t]*\|?(?:[ \t]*:?-{2,}:?[ \t]*\|)+(?:[ \t]*:?-{2,}:?[ \t]*)?$",
        r"\$\$[^$]+\$\$",
        r"^\[[^\]\n]+\]: \S+",
        r"\[\^\w+\]",
        r"~~[^\s~][^~\n]*~~",
        r"^[ \t]*[-*+] \[[ xX]\] ",
        r"^[^\s|>#=-][^\n|]*\n(?:={3,}|-{3,})[ \t]*$",
        r"\n[ \t]*\n(?:\*{3,}|-{3,}|_{3,})[ \t]*\n[ \t]*\n",
    ],
    "wiki": [
        r"\[\[[^\[\]{}\"\n]+\]\]",
        r"(?<!')'{2,3}[^\s'](?:[^\n]*?[^\s'])?'{2,3}(?!')",
        r"^={1,6} ?[^=\s][^\n]*?[^=\s] ?={1,6}[ \t]*$",
        r"\{\{[^{}\n]+\}\}",
        r"^\{\|",
        r"^\|[-}]",
        r"^h[1-6]\. \S",
        r"\[[^\[\]|\n]+\|[^\[\]|\n]+\]",
        r"^\|\|[^|\n]+\|\|",
        r"\{(?:code|noformat|quote|panel|color|math)(?:[:|][^{}\n]*)?\}",
        r"(?<![:/\w])//[^\s/][^/\n]*//(?![\w/])",
        r"\{\{\{|\}\}\}",
        r"__(?:TOC|NOTOC|FORCETOC)__",
        r"\[https?://\S+ [^\]\n]+\]",
        r"^\^[^^\n]+\^",
    ],
    "latex": [
        r"\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{",
        r"\\item\b",
        r"\\\(.+?\\\)",
        r"\\\[[^\]]+\\\]",
        r"(?<!\\)\\[%$&#_]",
        r"(?<![\w$])\$[^$\n]*(?:\\[a-zA-Z]|\^[{\\\w]|_[{\w])[^$\n]*\$(?!\d)",
        r"\\\\[ \t]*$",
        r"\\(?:maketitle|par|noindent|hline|cdot|frac|sum|sqrt|circ|LaTeX|newpage|tableofcontents)\b",
    ],
}
_COMPILED = {k: [re.compile(x, re.M | re.S if x.startswith((r"\\\[", r"\$\$")) else re.M) for x in v] for k, v in CONSTRUCTS.items()}
#: What a text must have for any construct at all.
HINT = re.compile(r"[<&*#\[\\`~|{$_^=']|//|^h[1-6]\. |---", re.M)


def marks(text: str) -> list[tuple[str, int]]:
    """The kinds of constructs a text holds: notation and number of the kind in it."""
    out: list[tuple[str, int]] = []
    if not HINT.search(text):
        return out
    if TAG.search(text):
        out.append(("html", 0))
    if any(m[0][1] == "#" or m[0][1:] in html5 for m in ENTITY.finditer(text)):
        out.append(("html", 1))
    plain = PATHS.sub(" ", text) if "\\" in text else text
    return out + [(name, i) for name, patterns in _COMPILED.items() for i, p in enumerate(patterns) if p.search(plain)]


@dataclass
class Node:
    kind: str
    parent: int
    text: str = ""
    level: int = 0
    hidden: bool = False
    children: list[int] = field(default_factory=list)
    linked: int = 0  # characters inside links


class Tree:
    """Nodes of one document, the first being its root; parents come before their children."""

    def __init__(self):
        self.nodes = [Node("root", -1)]

    def add(self, kind: str, parent: int, text: str = "", level: int = 0, hidden: bool = False, linked: int = 0) -> int:
        self.nodes.append(Node(kind, parent, text, level, hidden, linked=linked))
        self.nodes[parent].children.append(len(self.nodes) - 1)
        return len(self.nodes) - 1


# Inline constructs and what stays of them (the kept group).
_INLINE = [
    (re.compile(r"~?\\(?:documentclass|usepackage|begin|end|label|ref|cite|pagestyle|vspace|hspace|includegraphics)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}(?:\{[^{}\n]*\})?"), ""),
    (re.compile(r"\\euro\s*(?:\{\})?"), "€"),
    (re.compile(r"!?\[([^\]\[\n]*)\]\([^()\s]*(?: \"[^\"\n]*\")?\)"), r"\1"),
    (re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)\]\]"), r"\1"),
    (re.compile(r"\[([^\[\]|\n]+)\|[^\[\]|\n]+\]"), r"\1"),
    (re.compile(r"\[https?://\S+ ([^\]\n]+)\]"), r"\1"),
    (re.compile(r"\{\{([^{}|\n]+)\}\}"), r"\1"),
    (re.compile(r"\{\{[^{}\n]*\}\}"), ""),
    (re.compile(r"\{(?:quote|panel|color|noformat|code)(?:[:|][^{}\n]*)?\}"), ""),
    (re.compile(r"\[\^\w+\]:?"), ""),
    (re.compile(r"__(?:TOC|NOTOC|FORCETOC)__"), ""),
    (re.compile(r"(?<!')'{2,5}(?=\S)([^\n]*?\S)'{2,5}(?!')"), r"\1"),
    (re.compile(r"(?<![\w*])\*{1,3}(?=[^\s*])([^*\n]*[^\s*])\*{1,3}(?![\w*])"), r"\1"),
    (re.compile(r"(?<![\w_/.])_{1,3}(?=[^\s_])([^_\n]*[^\s_])_{1,3}(?![\w_])"), r"\1"),
    (re.compile(r"~~(?=[^\s~])([^~\n]*)~~"), r"\1"),
    (re.compile(r"(?<![:/\w])//(?=[^\s/])([^/\n]*)//(?![\w/])"), r"\1"),
    (re.compile(r"(?<!`)`([^`\n]+)`(?!`)"), r"\1"),
    (re.compile(r"\\(?:emph|textbf|textit|texttt|underline|text|mbox|footnote|url|href\{[^{}]*\})\{([^{}]*)\}"), r"\1"),
    (re.compile(r"\\(?:maketitle|par|noindent|hline|newpage|tableofcontents|centering)\b\s?"), ""),
    (re.compile(r"\\([%$&#_{}])"), r"\1"),
    (re.compile(r"(?<=\S)~(?=\S)"), " "),
]


def inline(text: str) -> str:
    """Text without inline markup. Formulas in dollars or brackets stay as they are written inside."""
    if not HINT.search(text) and "~" not in text:
        return text
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        kept.append(next(x for x in m.groups() if x is not None).strip())
        return f"\ue000{len(kept) - 1}\ue001"

    text = re.sub(r"\b[A-Za-z]:\\\S*", lambda m: keep(re.match(r"(.*)", m[0], re.S)), text)
    text = re.sub(r"\$\$([^$]+)\$\$|\\\((.+?)\\\)|\\\[(.+?)\\\]|(?<![\w$\\])\$([^$\n]*(?:\\[a-zA-Z]|\^[{\\\w]|_[{\w])[^$\n]*)\$(?!\d)", keep, text)
    before = None
    while before != text:
        before = text
        for pattern, what in _INLINE:
            text = pattern.sub(what, text)
    return re.sub("\ue000(\\d+)\ue001", lambda m: kept[int(m[1])], text)


class _Dom(HTMLParser):
    """Builds the tree of a text's HTML; text between blocks goes through the line parser."""

    def __init__(self, tree: Tree):
        super().__init__(convert_charrefs=True)
        self.tree, self.stack, self.buffer, self.link, self.linked = tree, [(0, "root")], [], 0, 0

    def flush(self) -> None:
        raw, linked = "".join(self.buffer), self.linked
        self.buffer, self.linked = [], 0
        at, tag = self.stack[-1]
        hidden = any(t in HIDDEN for _, t in self.stack)
        if not raw.strip():
            return
        node = self.tree.nodes[at]
        if tag in ("pre", "code", "syntaxhighlight") or any(t == "pre" for _, t in self.stack):
            self.tree.add("code", at, raw.strip("\n"), hidden=hidden)
        elif tag == "math" or node.kind == "formula":
            self.tree.add("formula", at, raw.strip(), hidden=hidden)
        elif hidden:
            self.tree.add("text", at, raw.strip(), hidden=True, linked=linked)
        elif re.fullmatch("h[1-6]", tag) or tag in ("li", "td", "th", "dt", "dd", "a", "summary", "caption"):
            self.tree.add("text", at, " ".join(inline(raw).split()), linked=linked)
        else:
            parse_lines(raw, self.tree, at, linked)

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.buffer.append("\n")
            return
        if tag == "a":
            self.link += 1
        formula = ("class", "math") in attrs or tag == "math"
        if tag not in BLOCKS and tag not in HIDDEN and tag not in ("textarea", "noscript") and not formula and tag != "syntaxhighlight" and not (tag == "code" and not "".join(self.buffer).strip()):
            return
        self.flush()
        if tag in ("li", "p", "tr", "td", "th", "dt", "dd", "option"):  # these close what was left open
            inside = {"li": ("li", "p"), "p": ("p",), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p")}.get(tag, (tag, "p"))
            while len(self.stack) > 1 and self.stack[-1][1] in inside:
                self.stack.pop()
        elif tag in BLOCKS and self.stack[-1][1] == "p":
            self.stack.pop()
        if tag in VOID or len(self.stack) > 200:
            return
        kind = "formula" if formula else {"ul": "list", "ol": "numbered", "li": "item", "table": "table", "tr": "row", "td": "cell", "th": "cell", "pre": "pre", "nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "textarea": "textarea", "noscript": "noscript"}.get(tag, "hidden" if tag in HIDDEN else "heading" if re.fullmatch("h[1-6]", tag) else "block")
        at = self.tree.add(kind, self.stack[-1][0], level=int(tag[1]) if kind == "heading" else 0, hidden=tag in HIDDEN)
        self.stack.append((at, "math" if formula else tag))
        self.names = [*getattr(self, "names", []), tag]

    def handle_startendtag(self, tag, attrs):
        if tag == "br":
            self.buffer.append("\n")

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = max(0, self.link - 1)
        opened = [t for _, t in self.stack]
        if tag == "span" and opened[-1] == "math":
            tag = "math"
        if tag in opened[1:]:
            self.flush()
            while self.stack[-1][1] != tag:
                self.stack.pop()
            self.stack.pop()

    def handle_data(self, data):
        self.buffer.append(data)
        if self.link:
            self.linked += len(data)

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.handle_data(data[6:])


_HEADING = [re.compile(r"(#{1,6}) +(.*?)[ #]*"), re.compile(r"(={1,6}) ?(.*?[^=\s]) ?={1,6}"), re.compile(r"h([1-6])\. +(.*)"), re.compile(r"\\((?:sub)*)(?:section|chapter|paragraph|title)\*?\{(.*)\}")]
_ITEM = re.compile(r"([ \t]*)(?:([-*+•]|[*#]{2,})|(\d{1,3})[.)]|(#)|(\\item(?:\[[^\]]*\])?)) +(.*)")
_FENCE = re.compile(r"[ \t]*(?:```|~~~|\{code(?:[:|][^}]*)?\}|\{noformat\}|\\begin\{(?:verbatim|lstlisting)\}|<code>|<syntaxhighlight[^>]*>|\{\{\{)\s*[\w+-]*[ \t]*")
_UNFENCE = re.compile(r"[ \t]*(?:```|~~~|\{code\}|\{noformat\}|\\end\{(?:verbatim|lstlisting)\}|</code>|</syntaxhighlight>|\}\}\})[ \t]*")
_FORMULA = re.compile(r"[ \t]*(?:\$\$|\\\[|\\begin\{(?:equation|align|displaymath)\*?\})[ \t]*(.*?)[ \t]*(\$\$|\\\]|\\end\{(?:equation|align|displaymath)\*?\})?[ \t]*")
_UNFORMULA = re.compile(r"(.*?)[ \t]*(?:\$\$|\\\]|\\end\{(?:equation|align|displaymath)\*?\})[ \t]*")


def parse_lines(raw: str, tree: Tree, at: int, linked: int = 0) -> None:
    """Adds the blocks of a text in Markdown, wiki or LaTeX, or none of these, to a node of the tree."""
    lines, i, n = raw.split("\n"), 0, 0
    paragraph: list[str] = []
    listing = table = None
    tabular = False
    cells: list[str] = []  # of the wiki table's row
    wiki_tables: list[bool] = []  # those open here; whether each has an end
    opened, closed = [], set()
    for k, x in enumerate(map(str.strip, lines)):
        if x.startswith("{|"):
            opened.append(k)
        elif x.startswith("|}") and opened:
            closed.add(opened.pop())

    def close() -> None:
        nonlocal paragraph, cells
        if cells:
            done, cells = cells, []
            row(done)
        text = "\n".join(paragraph).strip()
        paragraph = []
        if text:
            text = inline(text)
            if text.strip():
                tree.add("text", at, text, linked=linked)

    def row(cells: list[str]) -> None:
        nonlocal table
        if table is None:
            table = tree.add("table", at)
        r = tree.add("row", table)
        for c in cells:
            tree.add("text", tree.add("cell", r), " ".join(inline(c).split()))

    while i < len(lines):
        line = lines[i].rstrip("\r").lstrip("\ufeff") if i == 0 else lines[i].rstrip("\r")
        i += 1
        s = line.strip()
        if _FENCE.fullmatch(line) and any(_UNFENCE.fullmatch(x.rstrip("\r")) for x in lines[i:]):
            close()
            listing = table = None
            code = []
            while not _UNFENCE.fullmatch(lines[i].rstrip("\r")):
                code.append(lines[i].rstrip("\r"))
                i += 1
            i += 1
            tree.add("code", at, "\n".join(code))
            continue
        if s.startswith(("$$", "\\[", "\\begin{equation", "\\begin{align", "\\begin{displaymath")) and (m := _FORMULA.fullmatch(line)):
            formula, done = [m[1]], bool(m[2])
            j = i
            while not done and j < len(lines):
                end = _UNFORMULA.fullmatch(lines[j])
                formula.append(end[1] if end else lines[j])
                done = bool(end)
                j += 1
            if done:
                close()
                i, listing, table = j, None, None
                tree.add("formula", at, "\n".join(x.strip() for x in formula if x.strip()))
                continue
        if re.fullmatch(r"<math>(.*)</math>", s):
            close()
            tree.add("formula", at, s[6:-7])
            continue
        found = next(((p, m) for p in _HEADING if (m := p.fullmatch(s))), None) if s[:1] in "#=h\\" and not (wiki_tables and wiki_tables[-1]) else None
        if found and (found[0] is not _HEADING[0] or not paragraph or not found[1][2][:1].isdigit()):
            close()
            listing = table = None
            mark = found[1][1]
            tree.add("text", tree.add("heading", at, level=int(mark) if mark.isdigit() else len(mark) // 3 + 1 if "sub" in mark else max(1, len(mark))), inline(found[1][2]))
            continue
        if paragraph and re.fullmatch(r"={3,}|-{3,}", s) and len(paragraph) == 1:
            text, paragraph = paragraph[0], []
            tree.add("text", tree.add("heading", at, level=1 if s[0] == "=" else 2), inline(text))
            continue
        if s.startswith("{|") and (i - 1 in closed or i < len(lines) and lines[i].strip().startswith(("|", "!"))):
            close()
            wiki_tables.append(i - 1 in closed)
            table = None
            continue
        if wiki_tables and not wiki_tables[-1] and not s.startswith(("|", "!")):  # a table without an end: as far as its rows go
            close()
            table = None
            while wiki_tables and not wiki_tables[-1]:
                wiki_tables.pop()
        if wiki_tables:
            if s.startswith("|}"):
                close()
                wiki_tables.pop()
                table = None
            elif s.startswith("|-"):
                close()
            elif s.startswith(("|", "!")):
                cells += re.split(r"\|\||!!", s[1:])
            elif s and cells:
                cells[-1] += "\n" + s
            elif s:
                cells = [s]
            continue
        if re.match(r"\\begin\{tabular", s):
            close()
            tabular, table = True, None
            continue
        if tabular:
            if s.startswith("\\end{tabular"):
                tabular, table = False, None
            elif s.strip("\\") not in ("hline", ""):
                row([c.strip() for c in re.split(r"(?<!\\)&", re.sub(r"\\\\.*$", "", s))])
            continue
        if len(s) > 1 and s[0] in "|^" and s[-1] in "|^":
            close()
            listing = None
            if not re.fullmatch(r"[|:\- ]+", s):
                row([c.strip() for c in re.split(r"\|\||\||\^", s.strip("|^"))])
            continue
        table = None
        if re.fullmatch(r"\\(?:begin|end)\{[a-z]+\*?\}|\\documentclass.*|\\usepackage.*", s):
            close()
            kind = "numbered" if "enumerate" in s else "list"
            listing = tree.add(kind, at) if s.startswith(r"\begin{") and ("itemize" in s or "enumerate" in s) else None
            continue
        if m := _ITEM.fullmatch(line):
            if m[4] and paragraph:  # '# ' within a paragraph is a sign of the sentence
                paragraph.append(line)
                continue
            close()
            kind = "numbered" if m[3] or m[4] else "list"
            if listing is None or not m[5] and tree.nodes[listing].kind != kind:
                listing = tree.add(kind, at)
            tree.add("text", tree.add("item", listing, level=len(m[1]) // 2), inline(m[6]))
            continue
        if not s or re.fullmatch(r"\*{3,}|-{3,}|_{3,}|={3,}", s):
            close()
            if s:
                listing = None
            elif i < len(lines) and not _ITEM.fullmatch(lines[i]):
                listing = None
            continue
        if s.startswith("> "):
            s = s[2:]
            line = s
        if listing is not None and not paragraph and line[:1] in " \t" and tree.nodes[listing].children:
            last = tree.nodes[tree.nodes[listing].children[-1]].children[-1]
            tree.nodes[last].text += " " + inline(s)
            continue
        paragraph.append(line)
    close()


def parse(text: str, found: list[tuple[str, int]] | None = None) -> Tree:
    """The tree of a text; its marks are the first children of the root."""
    tree = Tree()
    for name, i in marks(text) if found is None else found:
        tree.add(f"mark {name} {i}", 0)
    if TAG.search(text) or ENTITY.search(text):
        # code and formulas of wiki text, and addresses in angles, aren't elements
        text = re.sub(r"<([\w.+-]+@[\w.-]+|https?://[^<>\s]+)>", r"&lt;\1&gt;", text)
        text = re.sub(r"<(?=[^a-zA-Z/!]|$)", "&lt;", text)
        dom = _Dom(tree)
        dom.feed(text)
        dom.close()
        dom.flush()
        again = [x for x in tree.nodes if x.text and not x.hidden and x.kind == "text" and TAG.search(x.text)]
        for x in again:  # tags that were written as entities
            x.text = TAG.sub("", x.text).strip()
    else:
        parse_lines(text, tree, 0)
    return tree


# --- the graphical model -------------------------------------------------------------------


def features(tree: Tree) -> list[tuple]:
    """Evidence of each node: its kind, length, share of linked characters, ending, digits, hiddenness, and what part of a page it is in."""
    nodes = tree.nodes
    part = [""] * len(nodes)
    for i, x in enumerate(nodes):
        part[i] = x.kind if x.kind in ("nav", "header", "footer", "aside", "form", "hidden") else part[x.parent] if i else ""
    size, linked = [len(x.text) for x in nodes], [x.linked for x in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        size[nodes[i].parent] += size[i]
        linked[nodes[i].parent] += linked[i]
    out = []
    for i, x in enumerate(nodes):
        length = 0 if not size[i] else 1 if size[i] < 25 else 2 if size[i] < 120 else 3
        density = round(min(1.0, linked[i] / size[i]) * 3) if size[i] else 0
        if x.kind.startswith("mark "):
            out.append((("kind", x.kind),))
            continue
        out.append((("kind", x.kind), ("length", length), ("density", density), ("ends", x.text.rstrip()[-1:] in ".!?:;。”“»" if x.text else None), ("digits", any(map(str.isdigit, x.text))), ("hidden", x.hidden), ("inside", part[i])))
    return out


class Model:
    """Potentials of evidence given a state (0 residue, 1 content) and of a child's state given its parent's."""

    def __init__(self, pages: list[tuple[Tree, list[int]]]):
        seen: dict[tuple, list[float]] = {}
        self.edge = [[1.0, 1.0], [1.0, 1.0]]
        self.root = [1.0, 1.0]
        totals = [1.0, 1.0]
        # a construct that no page shows is markup, as its notation's grammar has it
        seen |= {("kind", f"mark {n} {i}"): [2.0, 0.02] for n, k in [("html", 2), *((n, len(p)) for n, p in CONSTRUCTS.items())] for i in range(k)}
        for tree, labels in pages:
            self.root[labels[0]] += 1
            for x, fs, s in zip(tree.nodes, features(tree), labels):
                totals[s] += 1
                if x.parent >= 0:
                    self.edge[labels[x.parent]][s] += 1
                for f in fs:
                    seen.setdefault(f, [0.5, 0.5])[s] += 1
        self.evidence = {f: (math.log(n[0] / totals[0]), math.log(n[1] / totals[1])) for f, n in seen.items()}
        self.edge = [[math.log(v / sum(r)) for v in r] for r in self.edge]
        self.root = [math.log(v / sum(self.root)) for v in self.root]

    def marginals(self, tree: Tree) -> list[float]:
        """P(content) of each node: messages from the leaves to the root and back."""
        nodes = tree.nodes
        own = [[sum(self.evidence.get(f, (0.0, 0.0))[s] for f in fs) for s in (0, 1)] for fs in features(tree)]
        up = [[0.0, 0.0] for _ in nodes]  # message to the parent, by the parent's state
        inner = [o[:] for o in own]
        for i in range(len(nodes) - 1, 0, -1):
            for p in (0, 1):
                up[i][p] = _logsum(self.edge[p][0] + inner[i][0], self.edge[p][1] + inner[i][1])
            parent = inner[nodes[i].parent]
            parent[0] += up[i][0]
            parent[1] += up[i][1]
        down = [[0.0, 0.0] for _ in nodes]  # message from the parent, by the node's state
        down[0] = self.root[:]
        for i in range(1, len(nodes)):
            p = nodes[i].parent
            rest = [down[p][s] + inner[p][s] - up[i][s] for s in (0, 1)]
            down[i] = [_logsum(rest[0] + self.edge[0][s], rest[1] + self.edge[1][s]) for s in (0, 1)]
        out = []
        for i in range(len(nodes)):
            a, b = (down[i][s] + inner[i][s] for s in (0, 1))
            out.append(1 / (1 + math.exp(min(700.0, a - b))))
        return out


def _logsum(a: float, b: float) -> float:
    m = max(a, b)
    return m + math.log(math.exp(a - m) + math.exp(b - m))


# What stands around the text of pages, and sentences that use signs of markup plainly (fixed values).
CHROME = ["Home", "Contact", "Log in", "Search", "Menu", "About us", "Next page", "Previous", "Print this page", "Share", "Privacy", "Terms of use", "Site map", "All rights reserved.", "© 2024 Example Ltd", "Accept cookies", "Subscribe to our newsletter", "Follow us", "Back to top", "Read more"]
PLAIN = ["We ordered 3 * 4 boxes, so 12 in all.", "The cost is between $5 and $7.", "Keep it < 30 bar and > 28 bar.", "Deliver to unit # 38 and ring.", "Ask R&D or Q&A about it.", "See [5] and {2, 3} for it.", "The file is plan_v3_final here.", "Sum: 62 + 5 = 67 in total.", "Output ~83% | target 42% | next in May."]
_BARE = lambda x: " ".join(re.findall(r"[^\W_]+", x.casefold()))


def _page(rnd: random.Random, text: str) -> tuple[str, str]:
    """(page, content): a clean text written in one notation, with chrome around it in HTML; content is what is to be kept."""
    pieces = [x.strip() for x in re.split(r"\n+|(?<=[.!?]) (?=\w)", text) if re.search(r"\w", x)]
    pieces = [y for x in pieces for y in ([x, rnd.choice(PLAIN)] if rnd.random() < 0.1 else [x])]
    # headings, cells and items are short, and have no full stop
    pieces = [" ".join(x.split(" ")[: rnd.randint(1, 5)]) if rnd.random() < 0.3 else x for x in pieces]
    pieces = [x for x in (x.rstrip(".!?;:") if rnd.random() < 0.5 else x for x in pieces) if re.search(r"\w", x)]
    kind = rnd.choice(["html", "html", "html", "markdown", "wiki", "latex"])
    esc = html.escape if kind == "html" else str
    strong = {"html": "<b>{}</b>", "markdown": "**{}**", "wiki": "'''{}'''", "latex": "\\textbf{{{}}}"}[kind]
    link = {"html": '<a href="/x">{}</a>', "markdown": "[{}](x.md)", "wiki": "[[Page|{}]]", "latex": "\\emph{{{}}}"}[kind]

    def inline_marks(x: str) -> str:
        words = x.split(" ")
        if rnd.random() < 0.4:
            i = rnd.randrange(len(words))
            if re.fullmatch(r"\w+", words[i]):
                words[i] = rnd.choice([strong, link]).format(words[i])
                return " ".join(w if k == i else esc(w) for k, w in enumerate(words))
        return link.format(esc(x)) if rnd.random() < 0.15 and "[" not in x else esc(x)

    def block(some: list[str]) -> str:
        pick = rnd.random()
        if kind == "html" and pick > 0.9:
            return "<ul>" + "".join(f"<li>{link.format(esc(x))}</li>" for x in some) + "</ul>"
        lines = [inline_marks(x) for x in some]
        if 0.57 < pick < 0.65:
            return {"html": "<pre><code>{}</code></pre>", "markdown": "```\n{}\n```", "wiki": "<code>\n{}\n</code>", "latex": "\\begin{{verbatim}}\n{}\n\\end{{verbatim}}"}[kind].format("\n".join(map(esc, some)))
        if 0.65 < pick < 0.7:
            return {"html": '<span class="math">{}</span>', "markdown": "$${}$$", "wiki": "<math>{}</math>", "latex": "\\[ {} \\]"}[kind].format(esc(some[0])) + ("\n\n" if kind != "html" else "") + "\n\n".join(lines[1:])
        if kind == "html":
            if pick < 0.15:
                return f"<h2>{lines[0]}</h2>" + "".join(f"<p>{x}</p>" for x in lines[1:])
            if pick < 0.35:
                return "<ul>" + "".join(f"<li>{x}</li>" for x in lines) + "</ul>"
            if pick < 0.45:
                return "<table>" + "".join(f"<tr><td>{i}</td><td>{x}</td></tr>" for i, x in enumerate(lines)) + "</table>"
            if pick < 0.57:
                return "".join(f"<{t}>{x}</{t}>" for t, x in zip(("textarea", "noscript", "blockquote", "div"), lines * 4) if rnd.random() < 0.6) + "".join(f"<p>{x}</p>" for x in lines)
            return "".join(f"<p>{x}</p>" for x in lines)
        item, head = {"markdown": ("- {}", "## {}"), "wiki": ("* {}", "== {} =="), "latex": ("\\item {}", "\\section{{{}}}")}[kind]
        if pick < 0.3:
            listed = "\n".join(item.format(x) for x in lines)
            return f"\\begin{{itemize}}\n{listed}\n\\end{{itemize}}" if kind == "latex" else listed
        return (head.format(lines[0]) + "\n\n" if pick < 0.5 else "") + "\n\n".join(lines[pick < 0.5 :])

    blocks, at = [], 0
    while at < len(pieces):
        n = rnd.randint(1, 4)
        blocks.append(block(pieces[at : at + n]))
        at += n
    if kind != "html":
        return "\n\n".join(blocks), " ".join(pieces)
    some = lambda a, b: rnd.sample(CHROME, rnd.randint(a, b))
    links = lambda a, b: " ".join(f'<a href="/{i}">{x}</a>' for i, x in enumerate(some(a, b)))
    listed = lambda a, b: "<ul>" + "".join(f'<li><a href="/{i}">{x}</a></li>' for i, x in enumerate(some(a, b))) + "</ul>"
    extra = [f"<nav>{links(2, 6)}</nav>", f"<nav>{listed(2, 6)}</nav>", f"<header>{links(1, 3)}</header>", f"<div>{links(2, 6)}</div>", f"<footer><p>{' '.join(some(1, 3))}</p></footer>", f"<aside>{listed(1, 4)}</aside>", "<script>var a = 1; if (a) { run('x'); }</script>", "<style>p { color: red }</style>", f"<form><label>{some(1, 1)[0]}</label><select><option>one</option></select><button>{some(1, 1)[0]}</button></form>"]
    for x in rnd.sample(extra, rnd.randint(0, 5)):
        blocks.insert(rnd.choice([0, len(blocks)]), x)
    return "<html><head><title>t</title></head><body>" + "\n".join(blocks) + "</body></html>", " ".join(pieces)


def labelled_pages(texts: list[str], seed: int = 5) -> list[tuple[Tree, list[int]]]:
    """Pages made of clean texts, as the parser reads them, with a label for each node: 1 for content, if its words are the
    text's or those of a node within it are; else 0 for what stands around it, and for marks. A text as it is has content only."""
    rnd = random.Random(seed)
    out = []
    for text in texts:
        page, content = _page(rnd, text)
        if rnd.random() < 0.1:
            page = content = text + "\n" + rnd.choice(PLAIN)
        tree, whole = parse(page), f" {_BARE(content)} "
        labels = [0] * len(tree.nodes)
        for i in range(len(tree.nodes) - 1, -1, -1):
            x = tree.nodes[i]
            bare = _BARE(x.text)
            labels[i] |= bool(bare) and f" {bare} " in whole and not x.hidden
            if x.kind.startswith("mark "):
                labels[i] = int(page == content)
            elif labels[i] and x.parent > 0:
                labels[x.parent] = 1
        labels[0] = 1
        out.append((tree, labels))
    return out


#: Clean documents the model is trained on, at most, and their length in characters; where there are too few, these sentences do (fixed values).
TRAINING_PAGES, CLEAN_LENGTH = 400, (150, 6000)
SENTENCES = ["The crew weighs the cards in the yard before noon", "Send the papers to the office every quarter", "Each pump is checked by the clerk", "The lease of the store ends in spring", "Two drivers signed for the boxes", "Nobody counted the keys last week", "The roof of the shed was repaired", "All invoices are kept for ten years"]


def clean_sample(docs: DataFrame, text_col: str = "text") -> list[str]:
    """Texts without any sign of markup, a bounded sample by hash."""
    rows = docs.select(F.col(text_col).alias("text")).where(F.length("text").between(*CLEAN_LENGTH) & ~F.col("text").rlike(_SIGNS))
    return [x.text for x in rows.select("text", F.xxhash64("text").alias("h")).orderBy("h", "text").limit(TRAINING_PAGES).select("text").collect()]


def trained(texts: list[str]) -> Model:
    rnd = random.Random(11)
    more = [". ".join(rnd.choice(SENTENCES) + f" of {rnd.randint(2, 99)}" for _ in range(rnd.randint(3, 12))) + "." for _ in range(max(0, TRAINING_PAGES // 2 - len(texts)))]
    return Model(labelled_pages([*texts, *more]))


@lru_cache(1)
def default_model() -> Model:
    """The model without a corpus."""
    return trained([])


#: The least marginal a node is kept with: what is lost is worse than what stays.
KEPT = 0.3


def render(tree: Tree, keep: list[float], threshold: float = KEPT) -> list[tuple[str, int, str]]:
    """Blocks (kind, level, text) of the nodes that are content, in order."""
    out: list[tuple[str, int, str]] = []
    nodes, numbers = tree.nodes, {}

    def gather(i: int) -> str:
        x = nodes[i]
        if keep[i] < threshold:
            return ""
        return "\n".join(t for t in [x.text, *map(gather, x.children)] if t)

    work = [0]
    while work:
        i = work.pop()
        x = nodes[i]
        if keep[i] < threshold:
            continue
        if x.kind in ("heading", "item", "row"):
            inner = [gather(c) for c in x.children]
            text = "\t".join(inner) if x.kind == "row" else " ".join(" ".join(inner).split())
            if x.kind == "item":
                places = numbers.setdefault(x.parent, {c: k for k, c in enumerate(nodes[x.parent].children, 1)}) if nodes[x.parent].kind == "numbered" else {}
                out.append(("item", places.get(i, 0), text))
            elif text.strip():
                out.append((x.kind, x.level, text))
            continue
        if x.text.strip():
            out.append((x.kind if x.kind in ("code", "formula") else "text", 0, x.text))
        work.extend(reversed(x.children))
    return out


def written(blocks: list[tuple[str, int, str]]) -> str:
    """Clean text: items with a dash or number, cells with tabs, code indented, blank lines between blocks."""
    out: list[str] = []
    before = None
    for kind, level, text in blocks:
        if before is not None and not (kind == before and kind in ("item", "row")):
            out.append("")
        before = kind
        if kind == "item":
            text = f"{level}. {text}" if level else f"- {text}"
        elif kind == "code":
            text = "\n".join("    " + x for x in text.split("\n"))
        out.append(text)
    return "\n".join(out)


def convert(text: str, model: Model | None = None) -> tuple[list[str], str, list[tuple[str, int, str]]] | None:
    """(notations, clean text, blocks) of a text with markup; None for a text without."""
    found = marks(text)
    if not found:
        return None
    model = model or default_model()
    tree = parse(text.replace("\r\n", "\n").replace("\r", "\n"), found)
    keep = model.marginals(tree)
    residue = {name for (name, _), p in zip(found, keep[1:]) if p < 0.5}
    if not residue:
        return None
    blocks = render(tree, keep)
    return sorted(residue), written(blocks), blocks


#: A cheap test in the JVM: a text without any of these signs has no construct.
_SIGNS = r"[<&*#\[\\`~|{$_^=']|//|---|(?m)^h[1-6]\. "


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """(doc_id, notations, text, blocks) of the records whose text holds markup: the notations found, the clean
    text, and its blocks as (kind, level, text), kind being heading, item, row, code, formula or text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").rlike(_SIGNS))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model or trained(clean_sample(docs, text_col)))

    def make():
        model = shared.value

        def f(batch: pa.RecordBatch) -> dict:
            out = [(i, *got) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (got := convert(t, model))]
            ids, names, texts, blocks = zip(*out) if out else ((), (), (), ())
            return {"doc_id": ids, "notations": names, "text": texts, "blocks": [[{"kind": k, "level": n, "text": t} for k, n, t in b] for b in blocks]}

        return f

    return map_arrow(rows, make, f"doc_id {kind}, notations array<string>, text string, blocks array<struct<kind: string, level: int, text: string>>")
