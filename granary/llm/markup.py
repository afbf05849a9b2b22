"""Problem 2: markup residue in texts.

A text is parsed into a tree: passages, the HTML elements that hold blocks, the blocks
(headings, paragraphs, list items, code, table rows, formulas); each passage has the markup
languages it was written in. Wrapper induction separates content from template: trees of
pages of one host are aligned with each other by simple tree matching, what stays constant
becomes the host's wrapper and what varies inside it a slot. Each page is then aligned
with the wrapper, constant nodes are left out, slots and all other nodes are content and are
written as clean text that keeps the structure.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from html.entities import html5

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.arrow import map_columns
from granary.session import keep

LANGUAGES = ("html", "markdown", "wiki", "latex")

#: Signs without which no text has markup; "Q" stands for the two single quotes of wiki emphasis.
_possible = re.compile(r"[<>&*_#\[\]{}\\|`=~$]|''|\n-{3,}").search
# Names of HTML elements, and of the tags that only wiki text has.
_TAGS = (
    "a abbr address article aside audio b base blockquote body br button caption center cite code col colgroup dd del details div dl dt em embed "
    "fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark "
    "meta nav object ol option p param picture pre q s samp script section select small source span strike strong style sub summary sup svg table tbody "
    "td textarea tfoot th thead title tr tt u ul var video"
).split()
_WIKI_TAGS = "ref references nowiki gallery math syntaxhighlight".split()
_NAME = "(?:" + "|".join(sorted(_TAGS, key=len, reverse=True)) + ")"
_tag = re.compile(rf"</?{_NAME}(?:\s[^<>]*)?/?>|<!DOCTYPE[^<>]*>", re.I)
_broken_tag = re.compile(rf"</?{_NAME}(?:\s[^<>]*|/)?\Z|<{_NAME}\s+[a-z-]+\s*=\s*[\"']?[^<>\n]*(?=<|\n|\Z)|</{_NAME}(?=[\s<]|\Z)", re.I)
_cut_tag = re.compile(r"</?[A-Za-z]{0,10}\Z")
_wiki_tag = re.compile(rf"</?(?:{'|'.join(_WIKI_TAGS)})(?:\s[^<>]*)?/?>", re.I)
_comment = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_entity = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|([A-Za-z][A-Za-z0-9]{1,31}));")
_escaped_tag = re.compile(rf"&lt;(?:/?{_NAME}\b|!--)", re.I)

_fence = re.compile(r"^[ \t]*(```+|~~~+)[^\n`]*\n(.*?)(?:\n[ \t]*\1[ \t]*$|\Z)", re.S | re.M)
_pre = re.compile(r"<pre\b[^<>]*>(.*?)(?:</pre\s*>|\Z)", re.S | re.I)
_verbatim = re.compile(r"\\begin\{(verbatim|lstlisting)\}(.*?)(?:\\end\{\1\}|\Z)", re.S)
_tick = re.compile(r"(?<![`\\])`(?!`)([^`\n]+)`(?!`)")
_math = re.compile(r"\\\((.+?)\\\)|\\\[(.+?)\\\]|\$\$([^$]+?)\$\$|(?<![\w$\\])\$(?=[^\s$])((?:[^$\n\\]|\\.)+?)(?<=[^\s\\])\$(?![\w$])", re.S)
_math_sign = re.compile(r"[\\^_=+{}<>]|^[A-Za-z]$").search

_wiki_heading = re.compile(r"^(={2,6})[ \t]*([^=\n][^\n]*?)[ \t]*\1[ \t]*$", re.M)
_wiki_bold = re.compile(r"'''''(.+?)'''''|'''(.+?)'''|(?<!')''(?!')(?=\S)([^'\n]+?(?:'[^'\n]+?)*)''(?!')")
_wiki_file = re.compile(r"\[\[(?:Category|File|Image|Kategorie|Datei|Catégorie|Fichier|Categoría|Archivo|Categoria|Categorie|Bestand|Kategoria|Plik)\s*:([^\[\]\n]*)\]\]", re.I)
_wiki_link = re.compile(r"\[\[([^\[\]\n|]*\|)?([^\[\]\n]+)\]\]")
_wiki_url = re.compile(r"\[(?:https?|ftp)://[^\s\[\]]+(?:[ \t]+([^\[\]\n]+))?\](?!\()")
_wiki_template = re.compile(r"\{\{([^{}]*)\}\}")
_wiki_table = re.compile(r"^\{\|(.*?)^\|\}", re.S | re.M)
_wiki_numbered = re.compile(r"(?:^#{1,3}[ \t]*[^#\s][^\n]*[.!?]\)?[ \t]*(?:\n|\Z)){2,}", re.M)

_md_heading = re.compile(r"^(#{1,6})[ \t]+(\S[^\n]*?)[ \t]*#*[ \t]*$", re.M)
_md_setext = re.compile(r"^(?=[^\n]*[^\W\d_])([^\n=#|<>{}\\]+)\n(={3,}|-{3,})[ \t]*(?=\n|\Z)", re.M)
_md_image = re.compile(r"!\[([^\[\]\n]*)\]\(([^()\s]+)(?:[ \t]+\"[^\"\n]*\")?\)")
_md_link = re.compile(r"(?<!!)\[([^\[\]\n]+)\]\(([^()\s]+)(?:[ \t]+\"[^\"\n]*\")?\)")
_md_strong = re.compile(r"(?<![\w*])(\*{2,3})(?=[^\s*])([^*\n]+?)(?<=[^\s*])\1(?![\w*])|(?<![\w_])(_{2,3})(?=[^\s_])([^\n]+?)(?<=[^\s_])\3(?![\w_])|(?<!~)~~(?=[^\s~])([^~\n]+?)(?<=[^\s~])~~(?!~)")
_md_em = re.compile(r"(?<![\w*/\\])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?![\w*])|(?<![\w_/\\])_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?![\w_])")
_md_rule = re.compile(r"^[ \t]*\|?(?:[ \t]*:?-{3,}:?[ \t]*\|)+[ \t]*(?::?-{3,}:?)?[ \t]*$", re.M)
_md_quote = re.compile(r"^>[ \t]?(?=\S)", re.M)

_tex_command = re.compile(r"\\(?:[A-Za-z]+\*?(?=\s*[\[{])|item\b|maketitle\b|tableofcontents\b|newline\b|par\b|noindent\b|hline\b|centering\b|[%&#_](?=\s|\Z)|\\(?=\s|\Z))|\{\\(?:it|bf|em|sc|tt|sl|rm|small|large|Large|itshape|bfseries)\b")
_tex_heading = re.compile(r"\\(?:part|chapter|(?:sub)*section|(?:sub)?paragraph|title)\*?\s*\{([^{}]*)\}")
_tex_note = re.compile(r"~?\\(?:cite[tp]?|ref|eqref|label|footnote|index|pageref|vspace|hspace|includegraphics|usepackage|documentclass)\*?(?:\[[^\[\]]*\])?\{([^{}]*)\}")
_tex_wrap = re.compile(r"\\[A-Za-z]+\*?(?:\[[^\[\]\n]*\])?\{([^{}]*)\}|\{\\(?:it|bf|em|sc|tt|sl|rm|small|large|Large|itshape|bfseries)\b[ \t]*([^{}]*)\}")
_tex_env = re.compile(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\[\]\n]*\]|\{[^{}\n]*\})?")

_HELD = re.compile("\ue000(\\d+)\ue001")
_item = re.compile(r"^[ \t]*(?:([*•–▪+-])|(\d{1,3}[.)])|(#))[ \t]+")


@dataclass
class Node:
    kind: str
    text: str = ""
    languages: frozenset = frozenset()
    children: list[Node] = field(default_factory=list)

    def leaves(self) -> Iterator[Node]:
        """Blocks in the order of the text."""
        if self.kind in _BLOCKS:
            yield self
        else:
            for c in self.children:
                yield from c.leaves()

    def words(self) -> list[str]:
        return self.text.split() if not self.children else [w for c in self.children for w in c.words()]


_BLOCKS = frozenset(("text", "heading", "item", "row", "code", "formula"))
#: HTML elements that hold blocks; two private signs each mark where one begins and ends.
_HOLDERS = "table ul ol dl div section article blockquote form header footer nav aside main".split()
_BEGIN = {name: chr(0xE100 + i) for i, name in enumerate(_HOLDERS)}
_END = {name: chr(0xE140 + i) for i, name in enumerate(_HOLDERS)}
_HOLDER = re.compile("[\ue100-\ue17f]")


def _detect(text: str, held: list[tuple[str, str, str]]) -> set[str]:
    """Languages of one passage in which code and formulas are held back."""
    found = {held[int(n)][0] for n in _HELD.findall(text)} if "\ue000" in text else set()
    if "<" in text and (_tag.search(text) or _broken_tag.search(text)):
        found.add("html")
    if "&" in text and any(not (name := m[1]) or name + ";" in html5 for m in _entity.finditer(text)):
        found.add("html")
    if "=" in text and _wiki_heading.search(text) or "''" in text and "``" not in text and _wiki_bold.search(text):
        found.add("wiki")
    if "[[" in text and _wiki_link.search(text) or "[" in text and _wiki_url.search(text) or "{{" in text and _wiki_template.search(text):
        found.add("wiki")
    if "{|" in text and _wiki_table.search(text) or "<" in text and _wiki_tag.search(text):
        found.add("wiki")
    if "#" in text:
        if _wiki_numbered.search(text):
            found.add("wiki")
        elif _md_heading.search(text):
            found.add("markdown")
    if ("==" in text or "---" in text) and (_md_setext.search(text) or _md_rule.search(text)):
        found.add("markdown")
    if "](" in text and (_md_link.search(text) or _md_image.search(text)):
        found.add("markdown")
    if ("**" in text or "__" in text or "~~" in text) and _md_strong.search(text):
        found.add("markdown")
    if ("*" in text or "_" in text) and _md_em.search(text):
        found.add("markdown")
    if ">" in text and _md_quote.search(text):
        found.add("markdown")
    if "\\" in text and _tex_command.search(text):
        found.add("latex")
    return found


def _first(m: re.Match) -> str:
    return next((g for g in m.groups() if g), "")


def _open_table(m: re.Match) -> str:
    rows = []
    for row in re.split(r"^\|-[^\n]*$", m[1], flags=re.M):
        cells = [c.strip() for line in row.strip().split("\n") if line[:1] in "|!" for c in re.split(r"\|\||!!", line[1:])]
        if cells and any(cells):
            rows.append("\ue002" + " | ".join(cells))
    return "\n" + "\n".join(rows) + "\n"


_TAG_BREAKS = {
    **dict.fromkeys(("p", "div", "ul", "ol", "table", "blockquote", "section", "article", "hr", "dl", "form", "header", "footer"), "\n\n"),
    **dict.fromkeys(("br", "tr", "thead", "tbody", "dt", "dd", "option"), "\n"),
}


def _put_tag(m: re.Match) -> str:
    tag = m[0]
    name = re.match(r"</?([A-Za-z0-9]+)", tag)
    name = name[1].lower() if name else ""
    closing = tag.startswith("</")
    if re.fullmatch(r"h[1-6]", name):
        return "\n\n" if closing else "\n\n\ue003"
    if name == "li":
        return "" if closing else "\n• "
    if name in ("td", "th"):
        return " \ue004" if closing else ""
    if name == "tr" and not closing:
        return "\n\ue002"
    if name in _BEGIN and "\ue000" not in tag:
        return f"\n\n{(_END if closing else _BEGIN)[name]}\n\n"
    return _TAG_BREAKS.get(name, "")


def _put_clean(text: str, found: set[str]) -> str:
    """A passage without its markup; private signs mark headings, rows and cells."""
    if "html" in found:
        text = _tag.sub(_put_tag, text.replace("&nbsp;", " ").replace("&#160;", " "))
        text = _cut_tag.sub("", _broken_tag.sub("", text))
        text = html.unescape(text).replace("\xa0", " ")
    if "wiki" in found:
        text = _wiki_table.sub(_open_table, text)
        text = _wiki_heading.sub(lambda m: f"\n\n\ue003{m[2]}\n\n", text)
        text = _wiki_file.sub(lambda m: m[1].rsplit("|", 1)[1] if "|" in m[1] else "", text)
        text = _wiki_link.sub(lambda m: m[2], text)
        text = _wiki_url.sub(lambda m: m[1] or "", text)
        text = _wiki_template.sub(lambda m: m[1].rsplit("|", 1)[1] if "|" in m[1] else "", text)
        if "``" not in text:
            text = _wiki_bold.sub(_first, text)
        text = _wiki_tag.sub("", text)
    if "markdown" in found:
        text = _md_rule.sub("", text)
        text = re.sub(r"^[ \t]*\|(.+?)\|?[ \t]*$", lambda m: "\ue002" + " | ".join(c.strip() for c in m[1].split("|")), text, flags=re.M)
        text = _md_setext.sub(lambda m: f"\n\n\ue003{m[1].strip()}\n\n", text)
        if not _wiki_numbered.search(text):
            text = _md_heading.sub(lambda m: f"\n\n\ue003{m[2]}\n\n", text)
        text = _md_link.sub(lambda m: m[1], _md_image.sub(lambda m: m[1], text))
        text = _md_em.sub(_first, _md_strong.sub(lambda m: m[2] or m[4] or m[5], text))
        text = _md_quote.sub("", text)
    if "latex" in found:
        text = _tex_heading.sub(lambda m: f"\n\n\ue003{m[1]}\n\n", text)
        text = _tex_note.sub("", text)
        text = _tex_env.sub("\n\n", text)
        text = re.sub(r"^[ \t]*\\item(?:\[[^\[\]]*\])?[ \t]*", "• ", text, flags=re.M)
        n = 1
        while n:
            text, n = _tex_wrap.subn(lambda m: m[1] if m[1] is not None else m[2], text)
        text = re.sub(r"\\([%&#_$])", r"\1", text).replace("``", "“").replace("~", " ") if "\\" in text or "``" in text or "~" in text else text
    return text


def parse(text: str) -> Node:
    """The tree of a text: root, passages, blocks."""
    held: list[tuple[str, str, str]] = []
    escaped = bool(_escaped_tag.search(text))
    if escaped:
        text = html.unescape(text)

    def hold(language: str, kind: str, body: str) -> str:
        held.append((language, kind, body))
        return f"\ue000{len(held) - 1}\ue001"

    def formula(m: re.Match) -> str:
        body = _first(m)
        return hold("latex", "formula", body.strip()) if m[4] is None or _math_sign(body) else m[0]

    root = Node("root")
    if not _possible(text):
        root.children = [Node("passage", children=_blocks(text, held, plain=True))]
        return root
    if "```" in text or "~~~" in text:
        text = _fence.sub(lambda m: hold("markdown", "code", m[2]), text)
    if "<" in text:
        text = _pre.sub(lambda m: hold("html", "code", html.unescape(_tag.sub("", m[1]))), text)
        text = _comment.sub(lambda m: hold("html", "comment", ""), text)
    if "\\" in text:
        text = _verbatim.sub(lambda m: hold("latex", "code", m[2]), text)
    if "`" in text:
        text = _tick.sub(lambda m: hold("markdown", "span", m[1]), text)
    if "$" in text or "\\" in text:
        text = _math.sub(formula, text)
    for i, part in enumerate(re.split(r"\n[ \t]*\n", text)):
        found = _detect(part, held)
        if escaped and not i:
            found.add("html")
        blocks = _blocks(_put_clean(part, found), held) if found else _blocks(part, held, plain=True)
        if blocks or found:
            root.children.append(Node("passage", "", frozenset(found), blocks))
    return root


def _blocks(text: str, held: list[tuple[str, str, str]], plain: bool = False) -> list[Node]:
    """Blocks of a passage, inside the elements that hold them; list marks of plain text stay as they are."""
    top: list[Node] = []
    open_: list[Node] = []
    for para in re.split(r"\n[ \t]*\n", text):
        run: list[str] = []
        blocks = open_[-1].children if open_ else top

        def close(run=run, blocks=blocks):
            if run:
                blocks.append(Node("text", "\n".join(run)))
                run.clear()

        for line in para.split("\n"):
            raw = line.strip()
            if raw and _HOLDER.match(raw):
                close()
                for sign in raw:
                    _hold(sign, open_, top)
                continue
            only = _HELD.fullmatch(raw)
            if only and held[int(only[1])][1] in ("code", "formula"):
                close()
                _, kind, body = held[int(only[1])]
                blocks.append(Node(kind, body.strip("\n") if kind == "code" else body))
                continue
            shown = _HELD.sub(lambda m: "\n" + held[int(m[1])][2] + "\n" if held[int(m[1])][1] == "code" else held[int(m[1])][2], raw)
            shown = shown.strip()
            if not shown or not shown.strip("\ue002\ue003\ue004 |"):
                continue
            if shown[0] == "\ue003":
                close()
                blocks.append(Node("heading", shown[1:].replace("\ue003", "").strip()))
            elif shown[0] == "\ue002" or "\ue004" in shown:
                close()
                cells = [c.strip() for c in re.split(r"\ue004| \| ", shown.replace("\ue002", "").replace("\ue003", ""))]
                blocks.append(Node("row", "", children=[Node("cell", c) for c in cells if c]))
            elif m := _item.match(shown):
                close()
                blocks.append(Node("item", shown if plain else ("• " if not m[2] else m[2] + " ") + shown[m.end() :]))
            else:
                run.append(shown.replace("\ue003", ""))
        close()
    return top


def _hold(sign: str, open_: list[Node], top: list[Node]) -> None:
    """Begin or end an element; an end without a beginning is passed over, what is still open inside ends with it."""
    at = ord(sign) - 0xE100
    if at < 0x40:
        made = Node(_HOLDERS[at])
        (open_[-1].children if open_ else top).append(made)
        open_.append(made)
    elif any(n.kind == _HOLDERS[at - 0x40] for n in open_):
        while open_.pop().kind != _HOLDERS[at - 0x40]:
            pass


def _ends(a: list[str], b: list[str]) -> tuple[int, int]:
    """Words that two texts share at their beginning and, beyond those, at their end."""
    n = min(len(a), len(b))
    head = 0
    while head < n and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < n - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return head, tail


@dataclass
class Pattern:
    """A node of a wrapper: what all pages aligned so far have in common. A leaf has the constant words before and after its slot, all of them before
    where it has none; ``hits`` counts the pages."""

    kind: str
    before: list[str] = field(default_factory=list)
    after: list[str] = field(default_factory=list)
    slot: bool = False
    hits: int = 1
    children: list[Pattern] = field(default_factory=list)

    @staticmethod
    def of(node: Node) -> Pattern:
        if node.kind in _BLOCKS:
            return Pattern(node.kind, node.words())
        return Pattern(node.kind, children=[Pattern.of(c) for c in node.children])

    def common(self, words: list[str]) -> tuple[int, int, float]:
        """(words shared before the slot, after it, their share of the longer text)."""
        if not self.slot and self.before == words:
            return len(words), 0, 1.0
        if self.slot:
            head = _ends(self.before, words)[0]
            tail = _ends(self.after[::-1], words[head:][::-1])[0]
        else:
            head, tail = _ends(self.before, words)
        return head, tail, (head + tail) / max(len(words), len(self.before) + len(self.after), 1)

    def leaves(self) -> Iterator[Pattern]:
        if self.kind in _BLOCKS:
            yield self
        else:
            for c in self.children:
                yield from c.leaves()

    def without(self, keep_: set[int]) -> Pattern | None:
        """The tree of the leaves whose ids are kept."""
        if self.kind in _BLOCKS:
            return self if id(self) in keep_ else None
        kept = [k for c in self.children if (k := c.without(keep_))]
        return Pattern(self.kind, hits=self.hits, children=kept) if kept else None

    def to_list(self) -> list:
        return [self.kind, self.before, self.after, self.slot, [c.to_list() for c in self.children]]

    @staticmethod
    def from_list(x: list) -> Pattern:
        return Pattern(x[0], x[1], x[2], x[3], 0, [Pattern.from_list(c) for c in x[4]])


#: A leaf varies inside if at least this share of its words, and this many, are constant; else two leaves are different ones.
LEAST_CONSTANT, LEAST_WORDS = 0.5, 3


def _alike(a: Pattern, b: Node) -> float:
    """The share of words that two leaves have in common, if that makes them one leaf of a template."""
    head, tail, share = a.common(b.words())
    return share if share == 1 or share >= LEAST_CONSTANT and head + tail >= LEAST_WORDS else 0.0


def _fitting(a: Pattern, b: Node) -> float:
    return _alike(a, b) if fits(a, b) else 0.0


def _equal(a: Pattern, b: Pattern) -> float:
    return float((a.before, a.after, a.slot) == (b.before, b.after, b.slot))


def match(a: Pattern, b: Node | Pattern, weigh: Callable[[Pattern, Node | Pattern], float] = _alike) -> tuple[float, list[tuple[Pattern, Node | Pattern]]]:
    """Simple tree matching: the heaviest order-preserving mapping of nodes of the same kind, and its pairs.

    Two leaves weigh as much as the share of words they have in common, at least ``LEAST_CONSTANT``, or what ``weigh`` says; inner nodes weigh what their
    children weigh, and are matched only through these.
    """
    if a.kind != b.kind:
        return 0.0, []
    if b.kind in _BLOCKS:
        share = weigh(a, b)
        return (share, [(a, b)]) if share else (0.0, [])
    n, m = len(a.children), len(b.children)
    score = [[0.0] * (m + 1) for _ in range(n + 1)]
    inner: dict[tuple[int, int], tuple[float, list]] = {}
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            w = inner[i, j] = match(a.children[i - 1], b.children[j - 1], weigh)
            score[i][j] = max(score[i - 1][j], score[i][j - 1], score[i - 1][j - 1] + w[0])
    pairs, i, j = [], n, m
    while i and j:
        if score[i][j] == score[i - 1][j]:
            i -= 1
        elif score[i][j] == score[i][j - 1]:
            j -= 1
        else:
            pairs += inner[i, j][1]
            i, j = i - 1, j - 1
    return (score[n][m], [(a, b), *pairs]) if pairs else (0.0, [])


def _merge(wrapper: Pattern, page: Node | Pattern, of: dict[int, Pattern], room: bool) -> None:
    """Add to a wrapper what its page has more, in order; ``of`` maps page nodes to the wrapper nodes they are aligned with."""
    at = 0
    for c in page.children:
        mine = of.get(id(c))
        if mine is not None:
            at = next(i for i, x in enumerate(wrapper.children) if x is mine) + 1
            if c.kind not in _BLOCKS:
                _merge(mine, c, of, room)
        elif room:
            wrapper.children.insert(at, Pattern.of(c) if isinstance(c, Node) else c)
            at += 1


def _constants(node: Node) -> list[tuple]:
    """What of a leaf can be constant at the least: ``LEAST_WORDS`` words at its two ends, in each division; of fewer words, all."""
    words = node.words()
    if len(words) < LEAST_WORDS:
        return [(node.kind, *words)]
    return [(node.kind, i, *words[:i], *words[len(words) - LEAST_WORDS + i :]) for i in range(LEAST_WORDS + 1)]


def _recurring(pages: list[Node], least: float) -> list[Node]:
    """The pages without the leaves of which nothing can be constant on ``least`` of them."""
    pages_with = Counter(key for page in pages for key in {k for leaf in page.leaves() for k in _constants(leaf)})

    def rest(node: Node) -> Node | None:
        if node.kind in _BLOCKS:
            return node if any(pages_with[k] >= least for k in _constants(node)) else None
        kept = [k for c in node.children if (k := rest(c))]
        return Node(node.kind, node.text, node.languages, kept) if kept or node.kind == "root" else None

    return [rest(p) for p in pages]


def _align(pages: list[Node], share: float) -> Pattern | None:
    """The wrapper of pages aligned one after the other with what those before have in common."""
    least = max(2, share * len(pages))
    wrapper = Pattern("root")
    for n, page in enumerate(pages):
        _, pairs = match(wrapper, page)
        of = {}
        for a, b in pairs:
            of[id(b)] = a
            if a.kind in _BLOCKS:
                words = b.words()
                head, tail, whole = a.common(words)
                a.hits += 1
                if whole < 1 or a.slot:
                    a.before, a.after, a.slot = words[:head], words[len(words) - tail :], True
        _merge(wrapper, page, of, room=len(pages) - n >= least)
    return wrapper.without({id(x) for x in wrapper.leaves() if x.hits >= least})


def join(wrappers: Iterable[Pattern | None]) -> Pattern:
    """One wrapper with the leaves of all, equal ones once, in an order that all agree with as far as they do."""
    out = Pattern("root")
    for w in wrappers:
        if w:
            _merge(out, w, {id(b): a for a, b in match(out, w, _equal)[1]}, room=True)
    return out


def standing(wrapper: Pattern, page: Node) -> set[int]:
    """Numbers of the wrapper's leaves that stand on a page."""
    leaves = list(page.leaves())
    return {j for j, a in enumerate(wrapper.leaves()) if any(a.kind == b.kind and _fitting(a, b) for b in leaves)}


def induce(pages: list[str], share: float = 0.5, together: int = 12) -> Pattern | None:
    """The wrapper of different pages of one host: the leaves that stand on ``share`` of them. None where nothing is left.

    All pages are aligned, ``together`` at a time. A leaf on ``share`` of all pages stands on as many of the pages of some alignment, so the leaves that
    come out of any of them are all there can be; then they are counted over all pages.
    """
    least = max(2, share * len(pages))
    trees = _recurring([parse(t) for t in pages], least)
    n = max(1, -(-len(trees) // together))
    parts = [_align(trees[i::n], share) for i in range(n)]
    if n == 1:
        return parts[0]
    wrapper = join(parts)
    hits = Counter(j for page in trees for j in standing(wrapper, page))
    return wrapper.without({id(x) for j, x in enumerate(wrapper.leaves()) if hits[j] >= least})


def content(root: Node, wrapper: Pattern | None) -> tuple[Node, list[str]]:
    """(the page's tree without what is constant, the values of its slots).

    Of a leaf with a slot the slot's words stay. A page that the wrapper would empty is not one of its pages and stays whole.
    """
    if wrapper is None:
        return root, []
    of = {id(b): a for a, b in match(wrapper, root, _fitting)[1] if a.kind in _BLOCKS}
    slots: list[str] = []

    def rest(node: Node) -> Node | None:
        if node.kind in _BLOCKS:
            a = of.get(id(node))
            if a is None:
                return node
            words = node.words()
            value = " ".join(words[len(a.before) : len(words) - len(a.after)]) if a.slot else ""
            if not value:
                return None
            slots.append(value)
            return Node("text" if node.kind == "row" else node.kind, value)
        kept = [k for c in node.children if (k := rest(c))]
        return Node(node.kind, node.text, node.languages, kept) if kept or node.kind == "root" else None

    left = rest(root)
    return (left, slots) if left.children else (root, [])


def fits(a: Pattern, node: Node) -> bool:
    """Whether a page's leaf has all constant words of the wrapper's."""
    head, tail, whole = a.common(node.words())
    return head == len(a.before) and tail == len(a.after) and (a.slot or whole == 1)


def write(root: Node) -> str:
    """Clean text: blocks apart by an empty line, list items and table rows on lines of their own, code indented."""
    out: list[str] = []
    before = ""
    for b in root.leaves():
        if b.kind == "row":
            shown = " | ".join(c.text for c in b.children)
        elif b.kind == "code":
            shown = "\n".join("    " + line for line in b.text.split("\n"))
        else:
            shown = b.text
        tight = b.kind == before and b.kind in ("item", "row")
        out.append(("\n" if tight else "\n\n") + shown)
        before = b.kind
    return "".join(out).strip("\n")


def languages_of(root: Node) -> list[str]:
    return sorted({x for p in root.children for x in p.languages})


def _rows(df: DataFrame, key: str, fields: tuple[str, ...], host: str | None):
    name = F.coalesce(F.parse_url(F.col(host), F.lit("HOST")), F.lit("")) if host else F.lit("")
    name = F.coalesce(F.try_parse_url(F.col(host), F.lit("HOST")), F.lit("")) if host and hasattr(F, "try_parse_url") else name
    each = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("t")) for f in fields])
    return df.select(F.col(key).alias("k"), name.alias("h"), F.inline(each))


#: The JVM's form of the search for signs of markup: rows without any are never parsed.
_SIGNS = r"[<>&*_#\[\]{}\\|`=~$]|''|\n-{3,}"


def _wrapped(rows: DataFrame, wrappers: DataFrame, most_bytes: int, salts: int = 32) -> tuple[DataFrame, dict[tuple[str, str], str]]:
    """Rows with a column ``w`` for their host's wrapper, or without it and all wrappers, if these take at most ``most_bytes``, which is counted first."""
    size = wrappers.agg(F.sum(F.octet_length("w") + F.octet_length("h")).alias("n")).first()["n"] or 0
    if size <= most_bytes:
        return rows, {(r["h"], r["f"]): r["w"] for r in wrappers.collect()}
    salted = wrappers.select("h", "f", "w", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    joined = rows.withColumn("salt", F.pmod(F.xxhash64("k", "t"), F.lit(salts)).cast("int")).join(salted, ["h", "f", "salt"], "left")
    return joined.select("k", "h", "f", "t", "w"), {}


class Wrappers:
    """Wrappers of hosts as read from their text form, each once."""

    def __init__(self, known: dict[tuple[str, str], str]):
        self.known, self.made = known, {}

    def __call__(self, h: str, f: str, joined: str | None = None) -> Pattern | None:
        w = joined or self.known.get((h, f))
        if w is None:
            return None
        if w not in self.made:
            if len(self.made) > 1000:
                self.made.clear()
            self.made[w] = Pattern.from_list(json.loads(w))
        return self.made[w]


def learn_wrappers(df: DataFrame, key: str, fields: tuple[str, ...], host: str, share: float = 0.5, group: int = 512, least: int = 4, most_bytes: int = 8_000_000) -> DataFrame:
    """(h, f, w): the wrapper of each host and field that has one, as JSON.

    All different pages with markup take part; with fewer than ``least`` of them nothing can be told constant. They are dealt by their hash into groups of
    about ``group``, so a host that has a third of all pages is spread over tasks. What is template on ``share`` of a host's pages is so in some group:
    wrappers are induced from each group, joined, and their leaves counted over all pages of the host; those on at least ``share`` of them stay.
    """
    marked = _rows(df, key, fields, host).where(F.col("h") != "").where(F.regexp_like("t", F.lit(_SIGNS))).withColumn("x", F.xxhash64("t"))
    sizes = keep(marked.select("h", "f", "x").distinct().groupBy("h", "f").agg(F.count("*").alias("n")).where(F.col("n") >= least))
    size = sizes.agg(F.sum(F.octet_length("h") + 24).alias("n")).first()["n"] or 0
    dealt = marked.join(F.broadcast(sizes) if size <= most_bytes else sizes, ["h", "f"]).withColumn("g", F.pmod("x", F.ceil(F.col("n") / group)).cast("long"))
    pages = keep(dealt.groupBy("h", "f", "g").agg(F.sort_array(F.collect_set("t")).alias("p")))

    def learn():
        def work(hosts, names, groups):
            rows = []
            for h, f, texts in zip(hosts, names, groups):
                if made := induce(texts, share):
                    rows.append((h, f, json.dumps(made.to_list(), ensure_ascii=False)))
            return list(zip(*rows)) or [[]] * 3

        return work

    def unite():
        def work(hosts, names, parts):
            return [hosts, names, [json.dumps(join(Pattern.from_list(json.loads(w)) for w in ws).to_list(), ensure_ascii=False) for ws in parts]]

        return work

    found = map_columns(pages.select("h", "f", "p"), learn, "h string, f string, w string").groupBy("h", "f").agg(F.sort_array(F.collect_set("w")).alias("ws"))
    drafts = keep(map_columns(found, unite, "h string, f string, w string"))
    size = drafts.agg(F.sum(F.octet_length("w") + F.octet_length("h")).alias("n")).first()["n"] or 0
    if not size:
        return drafts
    rows = pages.join(F.broadcast(drafts) if size <= most_bytes else drafts, ["h", "f"]).select("h", "f", "p", "w")

    def count():
        of = Wrappers({})

        def work(hosts, names, groups, drafted):
            seen: Counter = Counter()
            for h, f, texts, w in zip(hosts, names, groups, drafted):
                wrapper = of(h, f, w)
                seen[h, f, -1] += len(texts)  # counts pages
                for t in texts:
                    seen.update((h, f, j) for j in standing(wrapper, parse(t)))
            return [*map(list, zip(*seen)), list(seen.values())]

        return work

    hits = map_columns(rows, count, "h string, f string, leaf int, n long").groupBy("h", "f", "leaf").agg(F.sum("n").alias("n"))
    hits = hits.groupBy("h", "f").agg(F.map_from_entries(F.collect_list(F.struct("leaf", "n"))).alias("hits"))  # a wrapper's leaves

    def settle():
        def work(hosts, names, drafted, counts):
            out = []
            for h, f, w, n in zip(hosts, names, drafted, map(dict, counts)):
                wrapper = Pattern.from_list(json.loads(w))
                kept = wrapper.without({id(x) for j, x in enumerate(wrapper.leaves()) if n.get(j, 0) >= share * n[-1]})
                if kept:
                    out.append((h, f, json.dumps(kept.to_list(), ensure_ascii=False)))
            return list(zip(*out)) or [[]] * 3

        return work

    return keep(map_columns(drafts.join(hits, ["h", "f"]).select("h", "f", "w", "hits"), settle, "h string, f string, w string"))


def clean(df: DataFrame, key: str = "rec_no", fields: tuple[str, ...] = ("description", "description_llm"), host: str | None = "ko_content_url", most_bytes: int = 8_000_000) -> DataFrame:
    """(key, field_name, clean_text, markup, slots): every non-null field as clean text, and the markup languages of the whole field, template included.

    ``markup`` is sorted, empty for plain text, whose signs stay as they are. Null fields give no row, blank ones an empty text. What a host's
    pages share is left out; ``slots`` are the values that vary inside it, in order. Wrappers of at most ``most_bytes`` are broadcast; beyond that, texts are joined to them.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = _rows(df, key, fields, host).where("t IS NOT NULL")
    known: dict[tuple[str, str], str] = {}
    if host:
        rows, known = _wrapped(rows, learn_wrappers(df, key, fields, host, most_bytes=most_bytes), most_bytes)
    shared = df.sparkSession.sparkContext.broadcast(known)

    def make():
        of = Wrappers(shared.value)

        def work(keys, hosts, names, texts, joined=None):
            out = []
            for i, (k, h, f, t) in enumerate(zip(keys, hosts, names, texts)):
                root = parse(t)
                left, slots = content(root, of(h, f, joined and joined[i]))
                out.append((k, f, write(left), languages_of(root), slots))
            return list(zip(*out))

        return work

    return map_columns(rows, make, f"k {kind}, field_name string, clean_text string, markup array<string>, slots array<string>").withColumnRenamed("k", key)


def marked_up(df: DataFrame, key: str = "rec_no", fields: tuple[str, ...] = ("description", "description_llm"), host: str | None = "ko_content_url") -> DataFrame:
    """(key, field_name, markup): one row per field and markup language in it, of the whole field, constant nodes and slots alike.

    Only fields with a sign that markup needs go through the parser; the others are plain by definition.
    """
    for f in fields:
        df = df.withColumn(f, F.when(F.regexp_like(f, F.lit(_SIGNS)), F.col(f)))
    return clean(df, key, fields, host).select(key, "field_name", F.explode("markup").alias("markup"))
