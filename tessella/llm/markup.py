"""Markup residue in texts (problem 1): HTML, Markdown, wiki and LaTeX notation become clean text.

What comes out keeps the structure as plain lines: headings and paragraphs on lines of their own, list
items as `- item`, table rows with ` | ` between the cells, code lines as they are, formulas as `$...$`.

HTML goes through a document tree and composite text density: for every node the characters per tag,
adjusted for the share of characters in links; each node's density sum is that of its children; the
container with the greatest sum is the content, and the least density on the path from the body to it is the
threshold. What lies in the content stays; outside of it a block (a list or a table as a whole) stays only if its density
reaches the threshold, besides headings and preformatted text, which are short by nature. What never holds content
(script, style, navigation) is left out. Lists and tables are structure, so they are no containers: else the one list of
a notice would be its content and the paragraphs around it boilerplate.
Markdown, wiki and LaTeX are read by line and by inline notation; code and formulas are set aside first,
so that their signs are not taken for markup.

A language is reported only if notation of it was converted, also in what the density leaves out: a lone `<`, `*`, `#`, `_`, `$`, a backslash
or a literal bracket is no markup.

Defined results: null gives null and no languages; an empty text gives an empty text; malformed and
unclosed tags are read as browsers do (implied ends); repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
import sys
from collections.abc import Iterator
from html.entities import html5

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = HEADING | frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i iframe img input ins kbd label link mark meta object q rp rt ruby s samp script select small span strike strong style sub sup svg textarea time tt u var video wbr button canvas col colgroup embed area base map noscript option head".split())
KNOWN = BLOCK | INLINE | VOID
NO_CONTENT = frozenset("script style noscript nav aside footer iframe svg button select textarea head".split())
#: What can be the content of a page, and what stays outside of it below the threshold.
CONTAINER = frozenset("body article section main div center blockquote form details fieldset".split())
SHORT = HEADING | frozenset(["pre"])
#: Which open elements a start tag closes.
ENDS = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "thead", "tbody"), "option": ("option",)}
#: Where the search for such an element stops.
SCOPE = {"li": ("ul", "ol"), "td": ("table",), "th": ("table",), "tr": ("table",), "tbody": ("table",), "tfoot": ("table",)}

#: Fixed value: elements below this depth stay flat, as in browsers (no text is lost).
MAX_DEPTH = 512

_NAMES = "|".join(sorted(KNOWN, key=len, reverse=True))
_TAG = re.compile(rf"<!--.*?-->|<!doctype[^>]*>|<(/?)({_NAMES})((?:\s[^<>]*)?)/?>", re.I | re.S)
_ESCAPED = re.compile(rf"&lt;(?:!--|/?(?:{_NAMES})(?:\s|/|&gt;))", re.I)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
#: Code points of which three that a text does not hold mark what is set aside and the items of HTML lists: first the
#: noncharacters, which no entity stands for.
MARKS = [*range(0xFDD0, 0xFDF0), *(plane << 16 | low for plane in range(17) for low in (0xFFFE, 0xFFFF)), *range(0xE000, 0xF900), *range(0xF0000, 0xFFFFE)]


def has_entity(text: str) -> bool:
    """Whether the text holds a numeric entity or one of the named ones of HTML."""
    return any(m.group()[1] == "#" or m.group()[1:] in html5 for m in _ENTITY.finditer(text))


class Node:
    __slots__ = ("name", "children", "parent", "chars", "tags", "link_chars", "link_tags", "density", "total", "depth")

    def __init__(self, name: str, parent: Node | None):
        self.name, self.parent, self.children = name, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.depth = parent.depth + 1 if parent else 0


def tree(text: str) -> Node:
    """The document tree of HTML; strings are text children. Never fails: stray end tags are skipped."""
    root = Node("body", None)
    at, pos = root, 0
    for m in _TAG.finditer(text):
        if m.start() > pos:
            at.children.append(text[pos : m.start()])
        pos = m.end()
        name = (m.group(2) or "").lower()
        if not name or name in ("html", "body"):
            continue
        if m.group(1):
            up = at
            while up is not root and up.name != name:
                up = up.parent
            if up is not root:
                at = up.parent
            continue
        for closed in ENDS.get(name, ()):
            up, stop = at, SCOPE.get(name, ("div", "li", "td", "table"))
            while up is not root and up.name != closed and up.name not in stop:
                up = up.parent
            if up is not root and up.name == closed:
                at = up.parent
        node = Node(name, at)
        at.children.append(node)
        if name not in VOID and node.depth < MAX_DEPTH:
            at = node
    if pos < len(text):
        at.children.append(text[pos:])
    return root


def densities(root: Node) -> None:
    """Composite text density of every node, and of every node the sum of its children's densities."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += [c for c in n.children if isinstance(c, Node)]
    for n in reversed(order):
        for c in n.children:
            if isinstance(c, str):
                n.chars += len(c.strip())
            elif c.name not in NO_CONTENT:
                n.chars += c.chars
                n.tags += c.tags + 1
                n.link_tags += c.link_tags
                n.link_chars += c.link_chars
        if n.name == "a":
            n.link_chars, n.link_tags = n.chars, n.link_tags + 1
    share = root.link_chars / max(1, root.chars)
    for n in order:
        if not n.chars:
            continue
        tags, link, link_tags = max(1, n.tags), max(1, n.link_chars), max(1, n.link_tags)
        plain = max(1, n.chars - n.link_chars)
        base = math.log(max(math.e, n.chars / plain * n.link_chars + share * n.chars + math.e))
        n.density = n.chars / tags * math.log(max(1.0001, n.chars / link * tags / link_tags)) / math.log(base + 1)
    for n in order:
        n.total = sum(c.density for c in n.children if isinstance(c, Node))


def content(root: Node) -> tuple[Node, float]:
    """The node with the greatest density sum, and the threshold: the least density on its path to the body."""
    best, stack = root, [root]
    while stack:
        n = stack.pop()
        if n.total > best.total and n.name in CONTAINER:
            best = n
        stack += [c for c in n.children if isinstance(c, Node)]
    threshold, up = best.density, best
    while up is not None:
        threshold, up = min(threshold, up.density), up.parent
    return best, threshold


def _path(best: Node) -> set[int]:
    """The content and what it lies in."""
    out, up = set(), best
    while up is not None:
        out.add(id(up))
        up = up.parent
    return out


class Converter:
    """Turns one text into clean text; `syntaxes` holds the languages whose notation was converted."""

    def __init__(self) -> None:
        self.syntaxes: set[str] = set()
        self.aside: list[str] = []
        self.dropped: list[str] = []
        self.open, self.close, self.item = map(chr, MARKS[:3])

    def keep(self, body: str, syntax: str | None, block: bool = False) -> str:
        if syntax:
            self.syntaxes.add(syntax)
        self.aside.append(body)
        mark = f"{self.open}{len(self.aside) - 1}{self.close}"
        return f"\n{mark}\n" if block else mark

    # HTML
    def from_html(self, text: str) -> str:
        if _ESCAPED.search(text):
            self.syntaxes.add("html")
            text = html.unescape(text)
        if _TAG.search(text):
            self.syntaxes.add("html")
            root = tree(text)
            densities(root)
            best, threshold = content(root)
            out: list[str] = []
            self.write(root, best, _path(best), threshold, out, False, best is root)
            text = "".join(out)
        if has_entity(text):
            self.syntaxes.add("html")
            text = html.unescape(text).replace("\xa0", " ")
        return text

    def write(self, n: Node, best: Node, path: set[int], threshold: float, out: list[str], in_row: bool, inside: bool) -> None:
        """Text of a node; inside: whether it lies in the content."""
        inside = inside or n is best
        if n.name in NO_CONTENT:
            return
        if not inside and id(n) not in path and n.name in BLOCK and n.name not in SHORT:
            if n.density < threshold:
                self.dropped.append(self.raw(n))
                return
            inside = True  # a list or table stays as a whole
        name = n.name
        if name == "pre":
            raw = html.unescape(self.raw(n)).strip("\n")
            out.append(self.keep(raw, None, True))
            return
        if name == "code":
            out.append(self.keep(html.unescape(self.raw(n)), None))
            return
        if name == "br":
            out.append(" " if in_row else "\n")
            return
        if name == "tr":
            cells = []
            for c in n.children:
                if isinstance(c, Node) and c.name in ("td", "th"):
                    part: list[str] = []
                    for x in c.children:
                        self.one(x, best, path, threshold, part, True, inside)
                    cells.append(re.sub(r"\s+", " ", "".join(part)).strip())
            self.line_end(out)
            out.append(" | ".join(cells) + "\n")
            return
        block = name in BLOCK and not in_row
        if block:
            self.line_end(out)
        if name == "li":
            out.append(self.item)
        for x in n.children:
            self.one(x, best, path, threshold, out, in_row, inside)
        if block:
            self.line_end(out)

    @staticmethod
    def line_end(out: list[str]) -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    def one(self, x: Node | str, best: Node, path: set[int], threshold: float, out: list[str], in_row: bool, inside: bool) -> None:
        if isinstance(x, str):
            # a line break in HTML is a space
            out.append(re.sub(r"[ \t]*\n[ \t]*", " " if in_row else "\n", x))
        else:
            self.write(x, best, path, threshold, out, in_row, inside)

    def raw(self, n: Node) -> str:
        return "".join(c if isinstance(c, str) else "\n" if c.name == "br" else self.raw(c) for c in n.children)

    # code and formulas, which are set aside
    def protect(self, text: str) -> str:
        if "```" in text or "~~~" in text:
            text = re.sub(r"(?ms)^[ \t]*(```|~~~)[^\n`]*\n(.*?)^[ \t]*\1[ \t]*$", lambda m: self.keep(m[2].strip("\n"), "markdown", True), text)
        if "\\" in text or "$" in text:
            text = re.sub(r"(?s)\\begin\{(verbatim|lstlisting|minted)\}(?:\[[^\]\n]*\])?(.*?)\\end\{\1\}", lambda m: self.keep(m[2].strip("\n"), "latex", True), text)
            text = re.sub(r"(?s)\\begin\{(equation|align|gather|displaymath|math|eqnarray|multline)(\*?)\}(.*?)\\end\{\1\2\}", self.formula(3), text)
            text = re.sub(r"(?s)\\\[(.*?)\\\]|\\\((.*?)\\\)", self.formula(1, 2), text)
            text = re.sub(r"\$\$([^$]+?)\$\$|(?<![\\$])\$([^$\n]*?(?:\\[A-Za-z]+|[A-Za-z0-9}][_^][{A-Za-z0-9])[^$\n]*?)(?<!\\)\$(?!\$)", self.formula(1, 2), text)
        if "{{" in text:
            text = re.sub(r"(?s)\{\{\s*(?:代码|code|source)\s*\|(.*?)\}\}", lambda m: self.keep(m[1], "wiki", True), text)
        if "`" in text:
            text = re.sub(r"(?<!`)`([^`\n]+)`(?!`)", lambda m: self.keep(m[1], "markdown"), text)
        return text

    def formula(self, *groups: int):
        def run(m: re.Match) -> str:
            body = next((m[g] for g in groups if m[g] is not None), "").strip()
            return self.keep(f"${body}$", "latex")

        return run

    # line by line
    def lines(self, text: str) -> str:
        out: list[str] = []
        rows = text.split("\n")
        wiki_table = latex_table = False
        for i, row in enumerate(rows):
            line = row.strip()
            if wiki_table or line.startswith("{|"):
                self.syntaxes.add("wiki")
                wiki_table = not line.startswith("|}")
                if line.startswith(("{|", "|-", "|}", "|+")):
                    if line.startswith("|+"):
                        out.append(line[2:].strip())
                    out.append("")
                    continue
                cells = re.split(r"\|\||!!", line[1:]) if line[:1] in "|!" else [line]
                cells = [re.sub(r"^\s*(?:[a-z-]+=(?:\"[^\"]*\"|\S+)\s*)+\|", "", c).strip() for c in cells]
                joined = " | ".join(cells)
                if out and out[-1] and line[:1] in "|!":
                    out[-1] += " | " + joined
                else:
                    out.append(joined)
                continue
            if "\\" in line:
                if re.match(r"\\begin\{(tabular|array|longtable|tabularx)\}", line):
                    self.syntaxes.add("latex")
                    latex_table = True
                    continue
                if re.match(r"\\end\{(tabular|array|longtable|tabularx)\}", line):
                    latex_table = False
                    continue
                if latex_table:
                    line = re.sub(r"\\(?:hline|toprule|midrule|bottomrule)|\\cline\{[^}]*\}", "", line)
            if latex_table:
                line = re.sub(r"\\\\\s*$", "", line).strip()
                if line:
                    out.append(" | ".join(c.strip() for c in re.split(r"(?<!\\)&", line)))
                continue
            if line.startswith("|") and line.count("|") >= 2:
                bar = re.fullmatch(r"\|?(?:\s*:?-{2,}:?\s*\|)+(?:\s*:?-{2,}:?\s*)?", line)
                near = any(0 <= k < len(rows) and rows[k].strip().startswith("|") for k in (i - 1, i + 1))
                if bar or (near and line.endswith("|")):
                    self.syntaxes.add("markdown")
                    if not bar:
                        out.append(" | ".join(c.strip() for c in re.split(r"(?<!\\)\|", line.strip("|"))))
                    continue
            m = re.fullmatch(r"(={2,6})\s*(.*?[^=\s])\s*\1", line)
            if m and m[2]:
                self.syntaxes.add("wiki")
                out.append(m[2])
                continue
            if re.fullmatch(r"={3,}|-{3,}", line) and i and rows[i - 1].strip() and rows[i - 1].strip()[0] not in "=-|":
                self.syntaxes.add("markdown")
                continue
            m = re.match(r"#{1,6}[ \t]+(\S.*?)(?:[ \t]+#+)?$", line)
            if m:
                self.syntaxes.add("markdown")
                out.append(m[1])
                continue
            m = re.match(r"(?:>[ \t]?)*>[ \t]+(.*)$", line)
            if m:
                self.syntaxes.add("markdown")
                line = m[1].strip()
            m = re.match(r"(\*{2,}|:+|;)[ \t]+(\S.*)$", line)
            if m and not (m[1] == ";" and ":" not in m[2]):
                self.syntaxes.add("wiki")
                line = m[2] if m[1][0] != "*" else "- " + m[2]
            else:
                m = re.match(r"([-*+])[ \t]+(\S.*)$", line)
                if m:
                    self.syntaxes.add("markdown")
                    line = "- " + m[2]
            out.append(line)
        return "\n".join(out)

    # inline
    def inline(self, text: str) -> str:
        def drop(pattern: str, by, syntax: str, t: str) -> str:
            new = re.sub(pattern, by, t)
            if new != t:
                self.syntaxes.add(syntax)
            return new

        if "[" in text:
            text = drop(r"!?\[([^\[\]\n]*)\]\((?:https?:|mailto:|/|\.|#|www\.)[^()\s]*(?:\s+\"[^\"\n]*\")?\)", r"\1", "markdown", text)
            text = drop(r"\[\[(?:Category|分类|File|文件|Image)\s*:[^\[\]\n]*\]\]", "", "wiki", text)
            text = drop(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]+)\]\]", r"\1", "wiki", text)
            text = drop(r"\[https?://\S+\s+([^\[\]\n]+)\]", r"\1", "wiki", text)
        if "{{" in text:
            text = drop(r"\{\{[^{}|\n]*\|(?:[^{}|\n]*\|)*([^{}|\n]*)\}\}", r"\1", "wiki", text)
            text = drop(r"\{\{[^{}|\n]+\}\}", "", "wiki", text)
        if "''" in text:
            text = drop(r"'{2,5}(?=[^'\s])([^'\n]+?)(?<=[^'\s])'{2,5}", r"\1", "wiki", text)
        if "**" in text:
            text = drop(r"\*\*(?=[^\s*])([^\n]*?[^\s*])\*\*", r"\1", "markdown", text)
        if "__" in text:
            text = drop(r"(?<![A-Za-z0-9_])__(?=[^\s_])([^_\n]*[^\s_])__(?!_)", r"\1", "markdown", text)
        if "~~" in text:
            text = drop(r"~~(?=[^\s~])([^~\n]+?)~~", r"\1", "markdown", text)
        if "\\" in text:
            text = drop(r"\\textbackslash(?:\{\})?", lambda m: self.keep("\\", None), "latex", text)
            while True:  # a level of nesting each time
                new = drop(r"\\(?:textbf|textit|texttt|textsf|textsc|emph|underline|uline|mbox|text|title|author|caption|chapter\*?|section\*?|subsection\*?|subsubsection\*?|paragraph\*?)\{([^{}]*)\}", r"\1", "latex", text)
                new = drop(r"\\footnote\{([^{}]*)\}", r"（\1）", "latex", new)
                new = drop(r"\\href\{[^{}]*\}\{([^{}]*)\}", r"\1", "latex", new)
                if new == text:
                    break
                text = new
            text = drop(r"\\(?:label|cite|ref|usepackage|documentclass|vspace|hspace|includegraphics|date)\*?(?:\[[^\]\n]*\])?\{[^{}]*\}", "", "latex", text)
            text = drop(r"(?m)^[ \t]*\\item(?:\[[^\]\n]*\])?[ \t]*", "- ", "latex", text)
            text = drop(r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]\n]*\])?", "", "latex", text)
            text = drop(r"\\(?:maketitle|noindent|newline|newpage|clearpage|par|hline|centering|tableofcontents|bfseries|itshape|ldots|quad|qquad)(?![A-Za-z])", " ", "latex", text)
            text = drop(r"(?m)\\\\(?:\[[0-9a-z.]+\])?[ \t]*$", "", "latex", text)
            text = drop(r"\\([%&#_${}])", r"\1", "latex", text)
        return text

    def convert(self, text: str) -> str:
        if any(chr(c) in text for c in MARKS[:3]):
            held = set(text)
            self.open, self.close, self.item = [chr(c) for c in MARKS if chr(c) not in held][:3]
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        if _ESCAPED.search(text):
            self.syntaxes.add("html")
            text = html.unescape(text)
        if "<pre" not in text.lower():
            text = self.protect(text)
            text = self.from_html(text)
        else:
            text = self.protect(self.from_html(text))
        text = self.inline(self.lines(text))
        mark = re.compile(f"{self.open}(\\d+){self.close}")
        while mark.search(text):  # what is set aside may hold marks of what was set aside before
            text = mark.sub(lambda m: self.aside[int(m[1])], text)
        text = re.sub(f"{self.item}[ \\t\\n]*", "- ", text)
        for part in self.dropped:
            other = Converter()
            other.open, other.close, other.item, other.aside = self.open, self.close, self.item, self.aside
            other.inline(other.lines(other.protect(part)))
            self.syntaxes |= other.syntaxes
        text = "\n".join(x.rstrip() if x[:1].isspace() else x.strip() for x in text.split("\n"))
        return re.sub(r"\n{3,}", "\n\n", text).strip("\n")


def convert(text: str | None) -> tuple[str | None, list[str]]:
    """(clean text, sorted languages) of one text."""
    if text is None:
        return None, []
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 8 * MAX_DEPTH))
    c = Converter()
    clean = c.convert(text)
    return clean, sorted(c.syntaxes)


#: Java regex of what any notation above needs; texts without it are clean already. It is wider than the patterns of
#: `lines` and `inline`: a line sign counts alone, behind any white space that `str.strip` takes off.
SIGNS = r"[<*#_`\\$|]|&[a-zA-Z#]|\[\[|\]\(|\[https?://|\{\{|''|~~|(?mU)^(?:[^\S\n\r]|[\x1c-\x1f])*+(?:[-+>:;]|={2,})"


def clean_markup(df: DataFrame, key: list[str], text: str, only_marked: bool = False) -> DataFrame:
    """The key columns, clean and syntaxes (array) of every row. Texts without any sign of markup stay in the JVM."""
    rows = df.select(*key, F.col(text).alias("t"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*key).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [convert(t) for t in pdf["t"]]
            yield pdf[key].assign(clean=[c for c, _ in done], syntaxes=[s for _, s in done])

    marked = F.col("t").rlike(SIGNS)
    out = rows.filter(marked).mapInPandas(run, f"{kinds}, clean string, syntaxes array<string>")
    if only_marked:
        return out
    rest = rows.filter(~marked | F.col("t").isNull())
    return out.unionByName(rest.select(*key, F.regexp_replace("t", r"^\n+|\n+$", "").alias("clean"), F.array().cast("array<string>").alias("syntaxes")))
