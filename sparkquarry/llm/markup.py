"""Problem 3: leftover HTML, Markdown, wiki and LaTeX markup turned into clean text that keeps its structure.

Code is set aside first, then formulas, so nothing quoted in them counts or changes. HTML goes through a lenient parser
into a DOM. Its nodes get a composite text density (characters per tag, adjusted by how many of either are links); the
node whose children's densities have the greatest sum holds the content, and the least density on the path from it to the
body is the threshold: boxes beside that path go if they are under it, and so do nodes that are mostly links. What is left is written out by kind of element, and wiki, LaTeX
and Markdown marks in the text follow. Headings come out as lines behind ``#``, lists behind ``- `` or numbers, tables
as rows with `` | ``, code in fences, formulas between ``$``.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquarry.llm.frames import integers
from sparkquarry.sources import spread

KINDS = ["html", "markdown", "wiki", "latex"]

# Names of HTML elements, by what becomes of them.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = {f"h{i}": i for i in range(1, 7)}
_BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form header hgroup html main nav noscript ol p section summary table tbody tfoot thead tr ul li title".split()) | set(_HEADINGS)
_INLINE = set("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup td th tt u var button select option textarea iframe object video audio canvas colgroup head map picture svg".split())
_DROPPED = set("script style template".split())
_TAGS = _VOID | _BLOCK | _INLINE | _DROPPED | {"pre"}
#: Boxes that may lie beside the content; of what is always at a margin; and what gives a box structure.
_BOXES, _MARGINS = {"div", "section", "article", "form", "center", "details"}, {"aside", "footer", "header"}
_STRUCTURE = set(_HEADINGS) | {"ul", "ol", "dl", "table", "pre", "code"}
#: Elements that end an open one of the same kind, where the writer left out its end.
_ENDS = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_NAMES = "|".join(sorted(_TAGS, key=len, reverse=True))
_TAG = re.compile(rf"<(?:/\s*)?(?:{_NAMES})(?:\s[^<>]*|\s*/)?>|<(?:{_NAMES})\s[^<>]*$|<!doctype[^>]*>", re.I)
_COMMENT = re.compile(r"<!--.*?(?:-->|$)", re.S)
_REFERENCE = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")

_FENCE = re.compile(r"^[ \t]*(`{3,}|~{3,})([^\n`]*)\n(.*?)(?:^[ \t]*\1[`~]*[ \t]*$|\Z)", re.M | re.S)
_PRE = re.compile(r"<pre\b[^>]*>(.*?)(?:</pre\s*>|\Z)", re.I | re.S)
_CODE = re.compile(r"<(code|tt|kbd|samp)\b[^>]*>(.*?)</\1\s*>", re.I | re.S)
_VERBATIM = re.compile(r"\\begin\{(verbatim\*?|lstlisting|minted|Verbatim)\}(?:\[[^\]]*\])?(?:\{[^}]*\})?(.*?)(?:\\end\{\1\}|\Z)", re.S)
_VERB = re.compile(r"\\verb\*?([|!+])(.*?)\1")
_WIKI_CODE = re.compile(r"<(nowiki|syntaxhighlight|source)\b[^>]*>(.*?)(?:</\1\s*>|\Z)", re.I | re.S)
_LATEX_QUOTE = re.compile(r"``([^`'\n]+)''")
#: Any character within a paragraph, which a line wrap doesn't end.
_ANY = r"(?:[^\n]|\n(?!\s*\n))"
_TICKS = re.compile(rf"(?<!`)(`{{1,2}})(?!`)((?:(?!`){_ANY})+?)\1(?!`)")
_MATH = re.compile(
    r"\$\$(.+?)\$\$|\\\[(.+?)\\\]|\\\((.+?)\\\)|\\begin\{((?:equation|align|gather|multline|displaymath|math|eqnarray)\*?)\}(.*?)(?:\\end\{\4\}|\Z)"
    r"|(?<![A-Za-z0-9_\\$])\$(?=[^\s$])((?:[^$\n]|\n(?!\s*\n))*(?<![\s\\]))\$(?![0-9_$])",
    re.S,
)
_FORMULA = re.compile(r"[\\^_=+<>{}]|^[A-Za-z]$|^\d+(?:\.\d+)?$")
_TABLE_KEY = re.compile(r"\{\{TBL:[^{}\n]*\}\}")

_WIKI_TABLE = re.compile(r"^[ \t]*\{\|.*?(?:^[ \t]*\|\}|\Z)", re.M | re.S)
_WIKI_HEADING = re.compile(r"^[ \t]*(={2,6})[ \t]*([^=\n].*?)[ \t]*\1[ \t]*$", re.M)
_WIKI_LINK = re.compile(r"\[\[([^\[\]]*)\]\]")
_BRACES = re.compile(r"\{\{|\}\}")
_WIKI_BOLD = re.compile(rf"'{{2,5}}(?=[^\s'])({_ANY}+?)(?<=\S)'{{2,5}}")
_WIKI_WORD = re.compile(r"__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION|INDEX|NOINDEX|NEWSECTIONLINK)__|^#REDIRECT\b[ \t:]*", re.M | re.I)
_WIKI_URL = re.compile(r"\[(?:https?|ftp)://[^\s\]]+(?:\s+([^\[\]]+))?\](?!\()")
_WIKI_REF = re.compile(r"<ref\b[^>]*/>|<ref\b[^>]*>.*?</ref\s*>", re.I | re.S)
_WIKI_TAG = re.compile(r"</?(?:references|gallery|onlyinclude|noinclude|includeonly|poem)\b[^<>]*>", re.I)

# LaTeX commands that stand without braces.
_BARE = "item|hfill|vfill|hline|toprule|midrule|bottomrule|noindent|indent|newpage|clearpage|pagebreak|newline|linebreak|par|maketitle|tableofcontents|centering|raggedright|bigskip|medskip|smallskip|bf|it|em|tt|sc|rm|sf|bfseries|itshape|ttfamily|small|large|Large|LARGE|huge|Huge|footnotesize|scriptsize|tiny|normalsize|quad|qquad|ldots|dots|cdots|textdegree|LaTeX|TeX|alpha|beta|gamma|delta|epsilon|lambda|mu|pi|sigma|tau|phi|omega|Omega|Delta|circ|cdot|times|pm|le|leq|ge|geq|neq|approx|infty|sum|int|to|rightarrow|leftarrow|appendix|frontmatter|mainmatter|doublespacing|selectfont|protect|relax"
_ENVIRONMENT = re.compile(r"\\(begin|end)\{([^{}\n]*)\}(?:\[[^\]\n]*\]|\{[^{}\n]*\})*")
_COMMAND = re.compile(rf"(?<![\w\\:/])~?\\([A-Za-z]+)\*?((?:\[[^\]\n]*\])*)\{{([^{{}}]*)\}}|(?<![\w\\:/])\\({_BARE})(?![A-Za-z\\])(?:\[([^\]\n]*)\])?[ \t]?|(?<=[\w}}\]])~\\([A-Za-z]+)\*?((?:\[[^\]\n]*\])*)\{{([^{{}}]*)\}}|(?<=\w)\\(?:textbf|textit|emph|texttt|text[a-z]{{2}}|underline|label|ref|cite|footnote|url|href|section|subsection)\*?\{{([^{{}}]*)\}}")
_LATEX_ROW = re.compile(r"^(?=[^\n]*&)([^\n]*?)[ \t]*\\\\(?:\[[^\]\n]*\])?[ \t]*(?:\\hline)?[ \t]*$", re.M)
#: A comment, in a text that is LaTeX elsewhere.
_LATEX_COMMENT = re.compile(r"^[ \t]*%[^\n]*(?:\n|\Z)", re.M)
_GROUP = re.compile(r"\{\\(?:bf|it|em|tt|sc|rm|sf|bfseries|itshape|ttfamily|small|large|Large|huge)\b[ \t]*([^{}]*)\}")
_SECTIONS = {"part": 1, "chapter": 1, "title": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
_NO_TEXT = set("label ref eqref pageref cite citep citet input include usepackage documentclass bibliography bibliographystyle includegraphics vspace hspace setlength pagestyle thispagestyle index author date".split())

_ATX = re.compile(r"^[ \t]{0,3}(#{1,6})[ \t]+(\S.*?)[ \t]*#*[ \t]*$", re.M)
_SETEXT = re.compile(r"^([^\s|>#*+-][^\n|]*)\n[ \t]{0,3}(=+|-{2,})[ \t]*$", re.M)
_RULE = re.compile(r"^[ \t]{0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$", re.M)
_BULLET = re.compile(r"^([ \t]*)[-*+][ \t]+(?:\[([ xX])\][ \t]+)?(?=\S)(?!\d+[ \t]*[-–][ \t]*$)", re.M)
_QUOTE = re.compile(r"^[ \t]{0,3}(?:>[ \t]?)+(?=\S)", re.M)
_MD_ROW = re.compile(r"^[ \t]*\|(.*)\|[ \t]*$", re.M)
_MD_DELIMITER = re.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|?[ \t]*$")
_IMAGE = re.compile(r"!\[([^\[\]]*)\]\(([^()\n]*)\)")
_LINK = re.compile(r"\[([^\[\]]+)\]\(([^()\s]*(?:\s+\"[^\"\n]*\")?)\)")
_REF_LINK = re.compile(r"!?\[([^\[\]]+)\][ ]?\[([^\[\]\n]*)\]")
_DEFINITION = re.compile(r"^[ \t]{0,3}\[(?!\^)([^\[\]\n]+)\]:[ \t]+(\S+)[^\n]*$", re.M)
_FOOTNOTE_TEXT = re.compile(r"^[ \t]{0,3}\[\^([^\[\]\s]+)\]:[ \t]*", re.M)
_FOOTNOTE = re.compile(r"\[\^([^\[\]\s]+)\]")
_AUTOLINK = re.compile(r"<((?:https?|ftp|mailto):[^\s<>]+|[\w.+-]+@[\w-]+\.[\w.-]+)>")
_STRONG = re.compile(rf"(\*\*\*|\*\*)(?=[^\s*])({_ANY}+?)(?<=[^\s*])\1|(?<![A-Za-z0-9_])__(?![A-Z]+__|[a-z0-9_]+__)(?=[^\s_])({_ANY}+?)(?<=[^\s_])__(?![A-Za-z0-9_])|~~(?=\S)({_ANY}+?)(?<=\S)~~")
_EM = re.compile(r"(?<![A-Za-z0-9*\\])\*(?=[^\s*])((?:[^*\n]|\n(?!\s*\n))+)(?<=[^\s*])\*(?![A-Za-z0-9*])|(?<![A-Za-z0-9_\\])_(?=[^\s_])((?:[^_\n]|\n(?!\s*\n))+)(?<=[^\s_])_(?![A-Za-z0-9_])")


class Node:
    __slots__ = ("tag", "children", "parent", "chars", "tags", "link_chars", "link_tags", "density", "attrs")

    def __init__(self, tag: str, parent: Node | None, attrs=()):
        self.tag, self.parent, self.attrs, self.children = tag, parent, attrs, []


class _Tree(HTMLParser):
    """Known elements make nodes; anything else in angle brackets stays text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("body", None)

    def handle_starttag(self, tag, attrs):
        if tag not in _TAGS:
            return self.handle_data(self.get_starttag_text() or "")
        closes = _ENDS.get(tag)
        if closes:
            node, scope = self.at, {"table", "ul", "ol", "dl", "select"}
            while node.parent and node.tag not in scope:
                if node.tag in closes:
                    self.at = node.parent
                    if tag != "tr":
                        break
                node = node.parent
        node = Node(tag, self.at, attrs)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        if tag not in _TAGS:
            return self.handle_data(self.get_starttag_text() or "")
        self.at.children.append(Node(tag, self.at, attrs))

    def handle_endtag(self, tag):
        if tag not in _TAGS:
            return self.handle_data(f"</{tag}>")
        node = self.at
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def _measure(root: Node) -> None:
    """Characters, tags and the links' share of both, of every node; then its composite text density."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node)]
    for node in reversed(order):
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str)) if node.tag not in _DROPPED else 0
        below = [c for c in node.children if isinstance(c, Node)]
        node.chars = own + sum(c.chars for c in below)
        node.tags = len(below) + sum(c.tags for c in below)
        node.link_chars = node.chars if node.tag == "a" else sum(c.link_chars for c in below)
        node.link_tags = sum(c.link_tags + (c.tag == "a") for c in below)
    share = root.link_chars / max(root.chars, 1)
    for node in order:
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        base = math.log(c / max(c - node.link_chars, 1) * node.link_chars + share * c + math.e)
        inner = c / lc * t / lt
        node.density = c / t * (math.log(inner) / math.log(base) if inner > 0 and base > 1.0001 else math.log(max(inner, 1e-9)) if inner > 0 else 0.0) if c else 0.0


def _content(root: Node) -> tuple[Node, float]:
    """The node whose children's densities have the greatest sum, and the least density on its path to the body."""
    best, most, stack = root, -math.inf, [root]
    while stack:
        node = stack.pop()
        below = [c for c in node.children if isinstance(c, Node)]
        if below and (s := sum(c.density for c in below)) > most:
            best, most = node, s
        stack += below
    threshold, node = best.density, best
    while node:
        threshold = min(threshold, node.density)
        node = node.parent
    return best, threshold


def _path(node: Node | None) -> set[int]:
    """The ids of a node and all it lies in."""
    out = set()
    while node:
        out.add(id(node))
        node = node.parent
    return out


def _structured(node: Node) -> bool:
    """Whether headings, lists, tables or code lie in a node."""
    stack = [node]
    while stack:
        for c in stack.pop().children:
            if isinstance(c, Node):
                if c.tag in _STRUCTURE:
                    return True
                stack.append(c)
    return False


def _dropped(node: Node, threshold: float, path: set[int]) -> bool:
    """Boilerplate, all under the threshold: boxes beside the way to the content, those of plain kind only without structure of their own; what is mostly links, several of them. And navigation by its name."""
    if node.tag in _DROPPED or node.tag == "nav" and node.link_chars * 2 > node.chars:
        return True
    if node.density >= threshold or id(node) in path:
        return False
    if node.link_tags >= 3 and node.link_chars * 2 > node.chars and node.tag not in ("td", "th", "tr", "tbody", "thead"):
        return True
    if node.parent is None or id(node.parent) not in path:
        return False
    if node.tag not in _BOXES:
        return node.tag in _MARGINS
    return not _structured(node)


def _write(root: Node) -> str:
    _measure(root)
    best, threshold = _content(root)
    path = _path(best.parent)  # boxes go only beside it; in the content itself only what is mostly links
    items: dict[int, int] = {}
    out: list[str] = []

    # these generators yield the nodes to visit next, as they may be nested deeper than Python recurses
    def cells(row: Node):
        texts = []
        for c in row.children:
            if isinstance(c, Node) and c.tag in ("td", "th"):
                texts.append(" ".join((yield from text_of(c)).split()))
        return _BAR.join(texts)

    def text_of(node: Node):
        mark = len(out)
        yield from node.children
        text = "".join(out[mark:])
        del out[mark:]
        return text

    def visit(c: Node):
        tag = c.tag
        if tag in _HEADINGS:
            # a heading that was never closed ends at its line
            first, _, rest = (yield from text_of(c)).strip().partition("\n")
            out.append(f"\n{_HEAD * _HEADINGS[tag]} {first}\n{rest}\n")
        elif tag == "br":
            out.append("\n")
        elif tag == "hr":
            out.append("\n\n")
        elif tag == "img":
            out.append(dict(c.attrs).get("alt") or "")
        elif tag == "tr":
            text = yield from (cells(c) if any(isinstance(x, Node) and x.tag in ("td", "th") for x in c.children) else text_of(c))
            out.append(_BREAK + text + _BREAK)
        elif tag == "li":
            number = 0
            if c.parent and c.parent.tag == "ol":
                number = items[id(c.parent)] = items.get(id(c.parent), 0) + 1
            text = yield from text_of(c)
            out.append(f"{_BREAK}{f'{number}.' if number else _DASH} " + text.strip() + _BREAK)
        elif tag in ("sub", "sup"):
            text = yield from text_of(c)
            out.append(("\ue005" if tag == "sub" else "\ue006") + text)
        else:
            gap = "\n" if tag in _BLOCK else ""
            out.append(gap)
            yield from c.children
            out.append(gap)

    stack = [iter(root.children)]
    while stack:
        c = next(stack[-1], None)
        if c is None:
            stack.pop()
        elif isinstance(c, str):
            out.append(c)
        elif not (c is not best and _dropped(c, threshold, path)):
            stack.append(visit(c))
    return "".join(out)


_HELD = re.compile("\ue000(\\d+)\ue001")


class _Aside:
    """Passages set aside behind private-use characters while the rest is worked on."""

    def __init__(self):
        self.held: list[str] = []

    def put(self, text: str) -> str:
        self.held.append(text)
        return f"\ue000{len(self.held) - 1}\ue001"

    def back(self, text: str) -> str:
        n = 1
        while n:  # each holds only such as were set aside before it
            text, n = _HELD.subn(lambda m: self.held[int(m[1])], text)
        return text


#: Marks that this module writes, until the end as private-use characters, so that they don't count as markup.
_OWN = str.maketrans({"\ue002": "#", "\ue003": "-", "\ue004": "|", "\ue005": "_", "\ue006": "^"})
_HEAD, _DASH, _BAR = "\ue002", "\ue003", " \ue004 "
#: One line break, however many such meet.
_BREAK = "\ue007"
_BREAKS = re.compile("[ \t\n]*(?:\ue007[ \t\n]*)+")
_PRIVATE = re.compile("[\ue000-\ue007]")


def _wiki_table(source: str) -> str:
    rows: list[list[str]] = [[]]
    for line in source.split("\n")[1:]:
        line = line.strip()
        if line.startswith("|}"):
            break
        if line.startswith("|-"):
            rows.append([])
        elif line.startswith("|+"):
            rows.append([line[2:].strip()])
        elif line[:1] in ("|", "!"):
            parts = re.split(r"\|\||!!", line[1:])
            rows[-1] += [p.rsplit("|", 1)[-1].strip() if re.match(r"[^|\[{]*=[^|]*\|", p) else p.strip() for p in parts]
        elif rows[-1]:
            rows[-1][-1] += " " + line
    return "\n".join(_BAR.join(r) for r in rows if r)


def clean(text: str | None, heading: str | None = None, level: int | None = None) -> tuple[str, list[str]]:
    """The clean text, and the kinds of markup that were in it. ``heading`` and ``level`` are those of a block whose own heading line is no markup."""
    if not text:
        return "", []
    found: set[str] = set()
    aside = _Aside()
    own = ""
    if heading and level:
        first, sep, rest = text.partition("\n")
        if first.rstrip() == "#" * level + " " + heading.strip():
            own, text = "#" * level + " " + clean(heading)[0] + sep, rest
            if clean(heading)[1]:
                found.update(clean(heading)[1])

    def saw(kind: str, value):
        def act(m: re.Match) -> str:
            found.add(kind)
            return value(m) if callable(value) else value

        return act

    def fence(code: str) -> str:
        return "\n" + aside.put("```\n" + code.strip("\n") + "\n```") + "\n"

    t = _PRIVATE.sub("", text.replace("\r\n", "\n"))
    t = _FENCE.sub(saw("markdown", lambda m: fence(m[3])), t)
    t = _PRE.sub(saw("html", lambda m: fence(html.unescape(re.sub(r"^\s*<code\b[^>]*>|</code>\s*$", "", m[1])))), t)
    t = _VERBATIM.sub(saw("latex", lambda m: fence(m[2])), t)
    t = _VERB.sub(saw("latex", lambda m: aside.put(m[2])), t)
    t = _WIKI_CODE.sub(saw("wiki", lambda m: aside.put(m[2])), t)
    t = _CODE.sub(saw("html", lambda m: aside.put(html.unescape(m[2]))), t)
    t = _LATEX_QUOTE.sub(saw("latex", lambda m: "“" + m[1] + "”"), t)
    t = _TICKS.sub(saw("markdown", lambda m: aside.put(m[2].strip())), t)
    t = _COMMENT.sub(saw("html", ""), t)
    t = _TABLE_KEY.sub(lambda m: aside.put(m[0]), t)

    def formula(m: re.Match) -> str:
        body = next(x for x in (m[1], m[2], m[3], m[5], m[6], "") if x is not None).strip()
        if m[6] is not None and (not _FORMULA.search(body) or m.string[m.end() : m.end() + 1].isalpha() and not body.startswith("\\")):
            return m[0]
        found.add("latex")
        return aside.put(f"${re.sub(r'\s+', ' ', body)}$")

    t = _MATH.sub(formula, t)
    t = _AUTOLINK.sub(saw("markdown", lambda m: m[1]), t)
    t = _WIKI_REF.sub(saw("wiki", ""), t)
    t = _WIKI_TAG.sub(saw("wiki", ""), t)
    if "<" in t and _TAG.search(t):
        found.add("html")
        tree = _Tree()
        tree.feed(t)
        tree.close()
        t = _BREAKS.sub("\n", _write(tree.root))
    elif "&" in t and _REFERENCE.search(t):
        bare = html.unescape(t)
        if bare != t:
            found.add("html")
            t = bare if not _TAG.search(bare) else clean(bare)[0]  # markup that was escaped whole

    if "{|" in t:
        t = _WIKI_TABLE.sub(saw("wiki", lambda m: aside.put(_wiki_marks(_wiki_table(m[0]), saw)) + "\n"), t)
    t = _wiki_marks(t, saw)
    if "\\" in t:
        t = _latex_marks(t, saw, aside)
    if "latex" in found and "%" in t:
        t = _LATEX_COMMENT.sub("", t)
    t = _markdown_marks(t, saw)
    t = aside.back(t).translate(_OWN)
    t = re.sub(r"[^\S\n]+\n", "\n", t)
    return own + re.sub(r"\n{3,}", "\n\n", t).strip("\n"), [k for k in KINDS if k in found]


def _templates(t: str, saw) -> str:
    """Templates by their unnamed and named values, the inner ones first; braces that don't pair, or hold single ones, stay."""
    value = saw("wiki", lambda m: "")
    out: list[list[str]] = [[]]
    at = 0
    for m in _BRACES.finditer(t):
        out[-1].append(t[at : m.start()])
        at = m.end()
        if m[0] == "{{":
            out.append([])
        elif len(out) == 1:
            out[-1].append(m[0])
        else:
            inner = "".join(out.pop())
            if "{" in inner or "}" in inner:
                out[-1].append("{{" + inner + "}}")
            else:
                value(m)
                out[-1].append(" ".join(p.split("=", 1)[-1].strip() for p in inner.split("|")[1:]))
    out[-1].append(t[at:])
    while len(out) > 1:
        rest = out.pop()
        out[-1] += ["{{", *rest]
    return "".join(out[0])


def _wiki_marks(t: str, saw) -> str:
    if "==" in t:
        t = _WIKI_HEADING.sub(saw("wiki", lambda m: f"{_HEAD * len(m[1])} {m[2]}"), t)
    if "__" in t or "#" in t:
        t = _WIKI_WORD.sub(saw("wiki", ""), t)
    if "[" in t:
        t = _WIKI_LINK.sub(saw("wiki", lambda m: "" if re.match(r"\s*category\s*:", m[1], re.I) else m[1].rsplit("|", 1)[-1]), t)
        t = _WIKI_URL.sub(saw("wiki", lambda m: m[1] or ""), t)
    if "{{" in t:
        t = _templates(t, saw)
    if "''" in t:
        t = _WIKI_BOLD.sub(saw("wiki", lambda m: m[1]), t)
    return t


def _latex_marks(t: str, saw, aside: _Aside) -> str:
    t = _LATEX_ROW.sub(saw("latex", lambda m: _BAR.join(c.strip() for c in re.split(r"(?<!\\)&", m[1]))), t)
    t = _ENVIRONMENT.sub(saw("latex", "\n"), t)
    t = _GROUP.sub(saw("latex", lambda m: m[1]), t)

    def command(m: re.Match) -> str:
        name, arg = m[1] or m[6], m[3] if m[1] else m[8]
        if m[9] is not None:
            return m[9] if not re.match(r"\\(?:label|ref|cite)", m[0]) else ""
        if m[4]:
            if m[4] == "item":
                return _DASH + " " + (m[5] + ": " if m[5] else "")
            return {"quad": " ", "qquad": " ", "ldots": "…", "dots": "…", "newline": "\n", "par": "\n\n", "textdegree": "°", "LaTeX": "LaTeX", "TeX": "TeX"}.get(m[4], "")
        if name in _NO_TEXT:
            return ""
        if name in _SECTIONS:
            return f"\n{_HEAD * _SECTIONS[name]} {arg}\n"
        return f" ({arg})" if name == "footnote" else arg or ""

    n = 1
    while n:  # the innermost first
        t, n = _COMMAND.subn(saw("latex", command), t)
    return t


def _markdown_marks(t: str, saw) -> str:
    mark = saw("markdown", lambda m: m[0])
    if "|" in t:
        out = []
        for line in t.split("\n"):
            if "|" in line and (m := _MD_DELIMITER.match(line)):
                mark(m)
                continue
            m = _MD_ROW.match(line)
            if m and m[1].strip("| \t"):
                mark(m)
                line = _BAR.join(c.strip() for c in m[1].split("|"))
            out.append(line)
        t = "\n".join(out)
    if "#" in t:
        t = _ATX.sub(saw("markdown", lambda m: f"{m[1]} {m[2]}"), t)
    if "==" in t or "--" in t:
        t = _SETEXT.sub(saw("markdown", lambda m: f"{'#' if m[2][0] == '=' else '##'} {m[1].strip()}"), t)
    t = _RULE.sub(saw("markdown", ""), t)
    t = _BULLET.sub(saw("markdown", lambda m: f"{m[1]}- "), t)
    if ">" in t:
        t = _QUOTE.sub(saw("markdown", ""), t)
    if "[" in t:
        t = _IMAGE.sub(saw("markdown", lambda m: m[1]), t)
        t = _LINK.sub(saw("markdown", lambda m: m[1]), t)
        t = _DEFINITION.sub(saw("markdown", ""), t)
        t = _REF_LINK.sub(lambda m: saw("markdown", lambda x: x[1])(m) if not (m[1].isdigit() and m[2].isdigit()) else m[0], t)
        t = _FOOTNOTE_TEXT.sub(saw("markdown", lambda m: f"{m[1]}: "), t)
        t = _FOOTNOTE.sub(saw("markdown", ""), t)
    if "*" in t or "_" in t or "~" in t:
        t = _STRONG.sub(saw("markdown", lambda m: m[2] or m[3] or m[4]), t)
        t = _EM.sub(saw("markdown", lambda m: m[1] or m[2]), t)
    return t


_SCHEMA = "record_table string, record_id bigint, markup array<string>, text string"


def clean_markup(df: DataFrame) -> DataFrame:
    """``record_table, record_id, markup, text`` for rows ``record_table, record_id, text`` and, of blocks with headings of their own, ``heading, heading_level``.

    ``markup`` lists the kinds found (html, markdown, wiki, latex), empty for plain text. Null texts stay null, empty ones
    empty. Texts without any character that markup needs are copied in the JVM. Repeated ids keep their rows; other columns are left out.
    """
    names = set(df.columns)
    df = df.select(
        "record_table", F.col("record_id").cast("bigint").alias("record_id"), F.col("text").cast("string").alias("text"),
        *(F.col(c) if c in names else F.lit(None).cast(k).alias(c) for c, k in (("heading", "string"), ("heading_level", "int"))),
    )
    marked = F.col("text").rlike(r"[<>&\\`*_~#|=\[\]{}$+]|''|(?m)^[ \t]*-")
    plain = df.where(F.col("text").isNull() | ~marked).select("record_table", "record_id", F.array().cast("array<string>").alias("markup"), "text")

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            done = [clean(t, h if isinstance(h, str) else None, int(n) if n == n and n else None) for t, h, n in zip(pdf["text"], pdf["heading"], pdf["heading_level"])]
            yield integers(pd.DataFrame({"record_table": pdf["record_table"], "record_id": pdf["record_id"], "markup": [k for _, k in done], "text": [t for t, _ in done]}), "record_id")

    return plain.unionByName(spread(df.where(marked), "record_id").mapInPandas(run, _SCHEMA))


def marked_records(spark, sf_dir: str) -> DataFrame:
    """The project's texts that may hold markup."""
    from sparkquarry.sources import load

    none, no = F.lit(None).cast("string").alias("heading"), F.lit(None).cast("int").alias("heading_level")
    blocks = load(spark, sf_dir, "blocks").select(F.lit("blocks").alias("record_table"), F.col("block_id").alias("record_id"), "text", none, no)
    ir = load(spark, sf_dir, "ir_blocks").select(F.lit("ir_blocks").alias("record_table"), F.col("ir_block_id").alias("record_id"), F.col("content_template").alias("text"), "heading", "heading_level")
    tables = load(spark, sf_dir, "ir_tables").select(F.lit("ir_tables").alias("record_table"), F.col("table_uid").alias("record_id"), F.col("html").alias("text"), none, no)
    return blocks.unionByName(ir).unionByName(tables)
