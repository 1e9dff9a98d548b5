"""Markup residue: which kinds a text holds, and clean text that keeps its structure (problem 7)."""

from __future__ import annotations

import html
import math
import re
from html.entities import name2codepoint
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, spread

KINDS = ("html", "latex", "markdown", "wiki")
# Element names of HTML.
TAGS = (
    "a abbr address article aside b blockquote body br button caption center cite code col dd del details dfn div dl dt em "
    "figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link "
    "main mark meta nav noscript ol option p pre q s samp script section select small span strike strong style sub summary sup "
    "table tbody td textarea tfoot th thead time title tr tt u ul var video wbr"
).split()
_BLOCKS = set("address article aside blockquote body br center dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
_DROPPED = {"script", "style", "nav", "head", "noscript", "iframe", "form", "button", "select", "textarea"}
_VOID = {"br", "hr", "img", "input", "link", "meta", "wbr", "col"}

_TAG = re.compile(r"</?(?:" + "|".join(sorted(TAGS, key=len, reverse=True)) + r")(?:\s[^<>]*)?/?>", re.I)
_HTML = re.compile(_TAG.pattern + r"|<!--|<!doctype\s|&(?:#\d{1,7}|#x[0-9a-f]{1,6});|&(?:" + "|".join(n for n in name2codepoint) + r");|&(?:nbsp|amp|lt|gt|quot|mdash|ndash|hellip)\b", re.I)
_WINDOWS_PATH = re.compile(r"\b[A-Za-z]:(?:\\[\w.-]+)+\\?")
_FENCE = re.compile(r"(?m)^(?P<f>```|~~~)[^\n`]*\n(?P<body>.*?)(?:^(?P=f)[ \t]*$|\Z)", re.S)
_VERBATIM = re.compile(r"\\begin\{(verbatim|lstlisting|minted)\}(?:\[[^\]]*\]|\{[^}]*\})*\n?(.*?)\\end\{\1\}", re.S)
_WIKI_CODE = re.compile(r"<(pre|source|syntaxhighlight|nowiki)(?:\s[^>]*)?>(.*?)</\1>", re.S | re.I)

_MATH = re.compile(r"\$\$(?P<a>.+?)\$\$|\\\[(?P<b>.+?)\\\]|\\\((?P<c>.+?)\\\)|(?<![\\$\w])\$(?P<d>[^\s$](?:[^$\n]*[^\s$\\])?)\$(?![\w$])", re.S)
_MATHLIKE = re.compile(r"[\\^_=<>+/{}]|^[A-Za-z]'?$|^[A-Za-z]\(|^\d+[A-Za-z]$|^-?[A-Za-z]\b")
_TEX = re.compile(r"\\(?:begin|end)\{|(?<![A-Za-z0-9\\])\\[A-Za-z]+\*?(?![A-Za-z])|(?<=[^\W_])\\[a-z]+\{|\w\\(?:ldots|dots|textbf|emph|textit|footnote|cite|label|ref)\b|``[^`\n]+?''|\\[%&#](?=[\s\w,.;])")
_MD_HEAD = re.compile(r"(?m)^ {0,3}#{1,6}[ \t]+\S.*$")
_MD = re.compile(
    r"\*\*(?=\S)[^*\n]+(?<=\S)\*\*|(?<!\w)__(?=\S)[^_\n]+(?<=\S)__(?!\w)|~~(?=\S)[^~\n]+~~"
    r"|(?<![\w*\\])\*(?=[^\s*])[^*\n]*?(?<=[^\s*])\*(?![\w*])|(?<![\w_\\])_(?=[^\s_])[^_\n]*?(?<=[^\s_])_(?![\w_])"
    r"|(?<!`)`(?!`)[^`\n]+`(?!`)|!?\[[^\]\n]*\]\([^)\s][^)\n]*\)|\[[^\]\n]+\]\[[^\]\n]*\]|\[\^[^\]\s]+\]|(?m:^\[[^\]\n]+\]:\s+\S)|(?m:^```|^~~~)"
    r"|(?m:^ {0,3}> \S)|(?m:^[ \t]*[-*+] \[[ xX]\] )|(?m:^\|?[ \t]*:?-{3,}:?[ \t]*\|)|(?m:^[^\n|#>\-=\s][^\n]*\n={3,}[ \t]*$)"
)
_WIKI = re.compile(
    r"\[\[[^\[\]\n]+\]\]|'''(?=\S)[^\n]+?'''|(?<![\w'`])''(?=[^\s'])[^'\n]+?(?<=\S)''(?!')|\{\{[^{}]+\}\}|(?m:^(={1,6})[^=\n].*?\1[ \t]*$)"
    r"|(?m:^\{\|)|<ref[\s>/]|\[https?://\S+ [^\]\n]+\]|__(?:NO)?TOC__|(?mi:^#redirect\b)"
)


def _math(text: str) -> bool:
    for m in _MATH.finditer(text):
        if m["d"] is None or (_MATHLIKE.search(m["d"]) and not re.match(r"\d[\d.,]*\s+[^\W\d_]{2,}", m["d"])):
            return True
    return False


def _md_heading(text: str) -> bool:
    """A line of number signs that is no list: numbered lists of wikis come in runs of lines."""
    for m in _MD_HEAD.finditer(text):
        before, after = text[: m.start()].rsplit("\n", 2), text[m.end() + 1 :].split("\n", 1)[0]
        prev = before[-2] if len(before) > 1 else ""
        if not (prev.startswith("#") or after.startswith("#")) or m.group().lstrip().startswith("##"):
            return True
    return False


def kinds_of(text: str) -> list[str]:
    """The kinds of markup in a text, in alphabetical order."""
    out = []
    plain = text
    if "```" in plain or "~~~" in plain:
        plain = _FENCE.sub("```\n", plain)
    if "\\begin{" in plain:
        plain = _VERBATIM.sub(r"\\begin{verbatim}", plain)
    if "<" in plain:
        plain = re.sub(r"<(pre|source|syntaxhighlight)(\s[^>]*)?>.*?</\1>", r"<\1\2></\1>", plain, flags=re.S | re.I)
    if ("<" in plain or "&" in plain) and (_HTML.search(plain) or "<!--" in plain):
        tags = [m.group() for m in _HTML.finditer(plain)]
        wiki_only = all(re.match(r"</?(?:ref|source|syntaxhighlight|nowiki)\b", t, re.I) for t in tags)
        if not wiki_only:
            out.append("html")
    if "\\" in plain or "``" in plain or "$" in plain:
        body = _WINDOWS_PATH.sub(" ", plain)
        if _TEX.search(body) or _math(body):
            out.append("latex")
    if any(c in plain for c in "*_`#>[~|=-") and (_MD.search(_strip_wiki(plain)) or ("#" in plain and _md_heading(plain))):
        out.append("markdown")
    if any(c in plain for c in ("[[", "''", "{{", "=", "{|", "[http", "__", "<ref", "#")) and _WIKI.search(plain):
        if out[-1:] == ["markdown"] and not _MD.search(_strip_wiki(plain)):
            out.pop()  # number signs alone are a wiki's numbered list
        out.append("wiki")
    return out


def _strip_wiki(text: str) -> str:
    """The text without what only a wiki or TeX would write, so that its characters are not read as another markup's."""
    if "[[" in text:
        text = re.sub(r"\[\[[^\[\]\n]*\]\]", " ", text)
    if "{{" in text:
        text = re.sub(r"\{\{[^{}]*\}\}", " ", text)
    if "$" in text or "\\" in text:
        text = _MATH.sub(" ", text)
        text = re.sub(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?", " ", text)
    if "``" in text and "''" in text:
        text = re.sub(r"``[^`\n]+?''", " ", text)
    if "__" in text:
        text = re.sub(r"__(?:NO)?TOC__", " ", text)
    if "<" in text:
        text = re.sub(r"<[^<>\n]*>", " ", text)
    if "http" in text:
        text = re.sub(r"https?://\S+", " ", text)
    return text


# ---- HTML -----------------------------------------------------------------------------------------------------------


class _Element:
    __slots__ = ("tag", "children", "chars", "tags", "link_chars", "link_tags", "density", "total", "thin")

    def __init__(self, tag: str):
        self.tag, self.children = tag, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.thin = False


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Element("#root")
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag not in TAGS:
            return self.handle_data(self.get_starttag_text() or "")
        if tag in ("li", "p", "dt", "dd", "tr", "td", "th", "option"):  # closed by the next of its kind
            same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag in same:
                    del self.stack[i:]
                    break
                if self.stack[i].tag in ("ul", "ol", "table", "div", "body", "dl", "tr"):
                    break
        elif tag in _BLOCKS and self.stack[-1].tag == "p" and tag not in ("br",):
            self.stack.pop()
        e = _Element(tag)
        self.stack[-1].children.append(e)
        if tag not in _VOID:
            self.stack.append(e)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def _measure(e: _Element) -> None:
    """Characters, tags, and both inside links, of every subtree (children first, without recursion)."""
    order, work = [], [(e, False)]
    while work:
        x, in_link = work.pop()
        order.append((x, in_link or x.tag == "a"))
        for c in x.children:
            if isinstance(c, _Element) and c.tag not in _DROPPED:
                work.append((c, in_link or x.tag == "a"))
    for x, link in reversed(order):
        for c in x.children:
            if isinstance(c, str):
                n = len(c.strip())
                x.chars += n
                x.link_chars += n if link else 0
            elif c.tag not in _DROPPED:
                x.chars += c.chars
                x.tags += c.tags + 1
                x.link_chars += c.link_chars
                x.link_tags += c.link_tags + (c.tag == "a")
    whole = max(1, e.chars)
    share = e.link_chars / whole
    for x, _ in reversed(order):
        if x.chars:
            plain = max(1, x.chars - x.link_chars)
            base = math.log(x.chars * x.link_chars / plain + share * x.chars + math.e)
            ratio = (x.chars / max(1, x.link_chars)) * (max(1, x.tags) / max(1, x.link_tags))
            x.density = x.chars / max(1, x.tags) * math.log(max(ratio, 1.0000001)) / math.log(base) if base > 1 else x.chars / max(1, x.tags)
        x.total = sum(c.density for c in x.children if isinstance(c, _Element) and c.tag not in _DROPPED)


def _main(body: _Element) -> _Element:
    """The subtree of the largest density sum among those at least as dense as the thinnest node on the way to the densest.

    Blocks in it that are thinner than that and mostly links, such as menus, are marked to be left out.
    """
    _measure(body)
    parents: dict[int, _Element] = {}
    nodes, work = [], [body]
    while work:
        x = work.pop()
        nodes.append(x)
        for c in x.children:
            if isinstance(c, _Element) and c.tag not in _DROPPED:
                parents[id(c)] = x
                work.append(c)
    dense = max(nodes, key=lambda x: x.density)
    threshold, x = dense.density, dense
    while id(x) in parents:
        x = parents[id(x)]
        threshold = min(threshold, x.density)
    main = max((x for x in nodes if x.density >= threshold and x.tag in ("body", "#root", "html", "div", "main", "article", "section", "td")), key=lambda x: x.total, default=body)
    for x in nodes:
        if x is not main and x.tag in _BLOCKS and x.link_tags > 1 and x.density < threshold and 2 * x.link_chars > x.chars:
            x.thin = True
    return main


def _render(e: _Element, out: list[str], pre: bool = False) -> None:
    work: list = [e]
    while work:
        x = work.pop()
        if isinstance(x, tuple):
            pre = x[0]
            continue
        if isinstance(x, str):
            out.append(x if pre else x)
            continue
        if x.tag in _DROPPED or x.thin:
            continue
        before, after = "", ""
        if x.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            before, after = "\n\n" + "#" * int(x.tag[1]) + " ", "\n\n"
        elif x.tag == "li":
            before, after = "\n- ", "\n"
        elif x.tag == "pre":
            before, after = "\n\n```\n", "\n```\n\n"
        elif x.tag in ("td", "th"):
            after = " | "
        elif x.tag == "br" or x.tag == "tr":
            before = "\n"
        elif x.tag in _BLOCKS:
            before, after = "\n\n", "\n\n"
        work.append(after)
        if x.tag == "pre":
            work.append((False,))
        work.extend(reversed(x.children))
        if x.tag == "pre":
            work.append((True,))
        work.append(before)


def html_to_text(text: str) -> str:
    """Text of a page or of a text with left-over tags; scripts, styles, navigation and comments go."""
    text = re.sub(r"<!--.*?(?:-->|\Z)", "", text, flags=re.S)
    text = re.sub(r"<(?![/!]?(?:" + "|".join(TAGS) + r")\b)", "&lt;", text, flags=re.I)
    tree = _Tree()
    tree.feed(text)
    tree.close()
    body, work = tree.root, [tree.root]  # a fragment without a body is one itself
    while work:
        x = work.pop()
        if x.tag == "body":
            body = x
            break
        work.extend(c for c in x.children if isinstance(c, _Element))
    node = _main(body)
    out: list[str] = []
    _render(node, out)
    got = "".join(out)
    if re.search(r"&(?:#\d+|#x[0-9a-fA-F]+|[A-Za-z]{2,8});", got):
        got = html.unescape(got)
    return _TAG.sub("", got)


# ---- Markdown, wiki, LaTeX ------------------------------------------------------------------------------------------


def markdown_to_text(text: str) -> str:
    text = re.sub(r"(?m)^([^\n|#>\-=\s][^\n]*)\n={3,}[ \t]*$", r"# \1", text)
    text = re.sub(r"(?m)^\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|?[ \t]*\n?", "", text)
    text = re.sub(r"(?m)^\[\^?[^\]\n]+\]:[^\n]*\n?", "", text)
    text = re.sub(r"\[\^[^\]\s]+\]", "", text)
    text = re.sub(r"!?\[([^\]\n]*)\]\([^)\n]*\)", r"\1", text)
    text = re.sub(r"\[([^\]\n]+)\]\[[^\]\n]*\]", r"\1", text)
    text = re.sub(r"\*\*(?=\S)([^*\n]+)\*\*|(?<!\w)__(?=\S)([^_\n]+)__(?!\w)|~~([^~\n]+)~~", lambda m: m[1] or m[2] or m[3], text)
    text = re.sub(r"(?<![\w*])\*(?=[^\s*])([^*\n]*?)\*(?![\w*])|(?<![\w_])_(?=[^\s_])([^_\n]*?)_(?![\w_])", lambda m: m[1] or m[2] or "", text)
    text = re.sub(r"(?<!`)`(?!`)([^`\n]+)`(?!`)", r"\1", text)
    text = re.sub(r"(?m)^ {0,3}> ?", "", text)
    text = re.sub(r"(?m)^([ \t]*)[*+] ", r"\1- ", text)
    return re.sub(r"(?m)^([ \t]*- )\[[ xX]\] ", r"\1", text)


def wiki_to_text(text: str) -> str:
    text = re.sub(r"<ref[^>/]*/>|<ref[^>]*>.*?</ref>", "", text, flags=re.S)
    changed = 1
    while changed:  # templates in templates
        text, changed = re.subn(r"\{\{([^{}]*)\}\}", lambda m: m[1].rsplit("|", 1)[-1], text)
    text = re.sub(r"\[\[(?:[^\[\]|\n]*\|)*([^\[\]|\n]*)\]\]", r"\1", text)
    text = re.sub(r"\[https?://\S+ ([^\]\n]+)\]", r"\1", text)
    text = re.sub(r"'''''|'''|(?<![\w'])''(?=\S)|(?<=\S)''(?![\w'])", "", text)
    text = re.sub(r"(?m)^(?:\{\|.*|\|\}|\|-.*)\n?", "", text)
    text = re.sub(r"(?m)^[|!][ \t]*", "", text)
    text = re.sub(r"__(?:NO)?TOC__", "", text)
    text = re.sub(r"(?m)^[*#]+ ", "- ", text)
    return re.sub(r"(?m)^(={1,6})[ \t]*([^=\n].*?)[ \t]*\1[ \t]*$", lambda m: "#" * len(m[1]) + " " + m[2], text)


def latex_to_text(text: str) -> str:
    if "\\begin{document}" in text:
        text = text.split("\\begin{document}", 1)[1].split("\\end{document}", 1)[0]
    text = re.sub(r"(?<!\\)%(?=[^\n]*$).*$", "", text, flags=re.M) if "\\section" in text or "\\begin" in text else text
    level = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
    text = re.sub(r"\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\{([^{}]*)\}", lambda m: "\n" + "#" * level[m[1]] + " " + m[2] + "\n", text)
    text = re.sub(r"\\item(?:\[([^\]]*)\])?[ \t]*", lambda m: "- " + (m[1] + " " if m[1] else ""), text)
    text = re.sub(r"\\(?:label|cite\w*|ref|eqref|pageref|bibliography\w*|usepackage|documentclass|input|include\w*|vspace|hspace|pagestyle|index)\*?(?:\[[^\]]*\])?\{[^{}]*\}", "", text)
    text = re.sub(r"\\(?:begin|end)\{(?!equation|align|gather|displaymath|math\b)[^{}]*\}(?:\[[^\]]*\]|\{[^{}]*\})*", "", text)
    kept: list[str] = []

    def formula(m: re.Match) -> str:
        body = next(x for x in m.groups() if x is not None).strip()
        if m.lastgroup == "d" and not _MATHLIKE.search(body):
            return m.group()
        kept.append(body)
        return f"\ue000{len(kept) - 1}\ue001"

    text = re.sub(r"\\begin\{(?P<e>equation|align|gather|displaymath|math)\*?\}(?P<a>.+?)\\end\{(?P=e)\*?\}", lambda m: kept.append(m["a"].strip()) or f"\ue000{len(kept) - 1}\ue001", text, flags=re.S)
    text = _MATH.sub(formula, text)
    before = None
    while text != before:  # commands in arguments
        before = text
        text = re.sub(r"\\footnote\{([^{}]*)\}", r" (\1)", text)
        text = re.sub(r"(?<![A-Za-z]:)(?<![\w.-]\\)\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}", r"\1", text)
    text = text.replace("\\ldots", "…").replace("\\dots", "…").replace("\\\\", "\n")
    paths: list[str] = []
    text = _WINDOWS_PATH.sub(lambda m: paths.append(m.group()) or f"\ue002{len(paths) - 1}\ue003", text)
    text = re.sub(r"\\[A-Za-z]+\*?(?:\{\})? ?", "", text)
    text = re.sub(r"\\([%&#_{}$])", r"\1", text)
    text = re.sub(r"``(.+?)''", r"“\1”", text).replace("{}", "")
    text = re.sub(r"(?<=\S)~(?=\S|$)", " ", text)
    text = re.sub(r"\ue002(\d+)\ue003", lambda m: paths[int(m[1])], text)
    return re.sub(r"\ue000(\d+)\ue001", lambda m: kept[int(m[1])], text)


_CONVERT = {"html": html_to_text, "latex": latex_to_text, "wiki": wiki_to_text, "markdown": markdown_to_text}


def clean(text: str, kinds: list[str] | None = None) -> str:
    """The text without markup.  Headings become lines of number signs, list items lines of a dash, code stays as it is
    between fences, formulas keep their TeX without delimiters.  A text of no kind is returned unchanged."""
    kinds = kinds_of(text) if kinds is None else kinds
    if not kinds:
        return text
    code: list[str] = []

    def hold(body: str) -> str:
        code.append(body.strip("\n"))
        return f"\n\ue010{len(code) - 1}\ue011\n"

    text = _FENCE.sub(lambda m: hold(m["body"]), text)
    text = _VERBATIM.sub(lambda m: hold(m[2]), text)
    text = _WIKI_CODE.sub(lambda m: hold(html.unescape(_TAG.sub("", m[2]))), text)
    for kind in ("html", "latex", "wiki", "markdown"):
        if kind in kinds:
            text = _CONVERT[kind](text)
    text = re.sub(r"[ \t]+\n", "\n", text)
    text = re.sub(r"\n{3,}", "\n\n", text).strip()
    return re.sub(r"\n?\ue010(\d+)\ue011\n?", lambda m: "\n```\n" + code[int(m[1])] + "\n```\n", text).strip()


def markup_kinds(documents: DataFrame, *, key: str = "doc_id", text: str = "full_text", kind: str = "doc_type", book: str = "book") -> DataFrame:
    """(key, markup, n_headings, n_items, n_code, text): one row for each kind of markup in a book, with its clean text.

    A text without markup, a null or an empty one gives no row.  Repeated keys give repeated rows; other columns are ignored.
    """
    key_type = documents.schema[key].dataType.simpleString()
    rows = documents.where(F.col(kind) == book).select(F.col(key).alias("_k"), F.col(text).alias("_t")).where(F.length("_t") > 0)

    def run(cols: dict[str, list]):
        for k, t in zip(cols["_k"], cols["_t"]):
            kinds = kinds_of(t)
            if kinds:
                c = clean(t, kinds)
                counts = (len(re.findall(r"(?m)^#{1,6} ", c)), len(re.findall(r"(?m)^[ \t]*- ", c)), len(re.findall(r"(?m)^```$", c)) // 2)
                for name in kinds:
                    yield k, name, *counts, c

    return map_rows(spread(rows), run, f"`{key}` {key_type}, markup string, n_headings int, n_items int, n_code int, text string", 128)
