"""Text blocks of an HTML page with their place in the DOM; a helper of ``style_tree``.

A tolerant reader: unknown or unclosed tags, stray end tags, broken quotes, unfinished comments and pages that
stop anywhere are read as browsers do in the main; it never fails.
"""

from __future__ import annotations

import html
import re

# Fixed values of HTML: how elements bear on text.
RAW = {"script", "style", "title", "textarea", "iframe", "noscript", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
    "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
    "tt", "u", "var",
}
#: An element of the first kind ends an open one of the second.
ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
BOUNDS = {"ul", "ol", "dl", "table", "td", "th", "body", "article", "main", "section", "nav", "aside", "div"}
CHROME_TAGS = {"nav", "footer", "aside", "form", "dialog", "menu", "button", "select", "option", "fieldset", "template", "head", "svg", "canvas", "object", "audio", "video"}
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}
CHROME_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "banner", "nav", "navbar",
    "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "footer", "header", "masthead", "cookie", "cookies", "consent",
    "gdpr", "notice", "newsletter", "subscribe", "signup", "login", "popup", "modal", "overlay", "share", "sharing", "social",
    "related", "recommended", "pagination", "pager", "toolbar", "widget", "search",
}
COMMENT_NAMES = {"comment", "comments", "commentlist", "disqus", "reply", "replies", "respond"}
FLOW = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "ul", "ol", "li", "dl", "dt", "dd", "table", "tbody", "thead", "tr", "td", "th", "figure", "figcaption", "article", "main"}

#: What the page's own markup says of a block: part of its surroundings, nothing, or running text of the article.
CHROME, OPEN, ARTICLE = 0, 1, 2

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>"']|"[^"]*"|'[^']*')*+)>|([^>]*)(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"'>]+)""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_DIGITS = re.compile(r"\d+")


def attributes(text: str) -> dict[str, str]:
    """Lower-cased names with their values; the first of a name counts."""
    found: dict[str, str] = {}
    for name, a, b, c, bare in _ATTRIBUTE.findall(text):
        found.setdefault((name or bare).lower(), html.unescape(a or b or c))
    return found


class Element:
    __slots__ = ("tag", "key", "place", "fixed", "named", "plain", "holds", "children")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None, depth: int) -> None:
        names = " ".join(_DIGITS.sub("0", attrs.get(k, "")) for k in ("id", "class")).split()
        self.tag = tag
        self.key = ".".join([tag, *sorted(set(names))])[:80].replace("/", "_")
        deep = parent is not None and parent.place.count("/") + 1 >= depth
        self.place = parent.place if deep else (parent.place + "/" if parent else "") + self.key
        in_text = parent is not None and parent.plain is not None
        tokens = {x.lower() for n in names for x in _NAME.findall(n)}
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
        chrome = tag in CHROME_TAGS or hidden or attrs.get("role", "").lower() in CHROME_ROLES or (tag == "header" and not in_text)
        self.fixed = chrome or (parent is not None and parent.fixed)
        marks = tokens & COMMENT_NAMES if tag in ("article", "h1") else tokens & (CHROME_NAMES | COMMENT_NAMES)
        self.named = [*parent.named] if parent else []
        if marks and tag not in ("html", "body", "main"):
            self.named.append(self)
        opens = tag in ("article", "main") or attrs.get("role", "").lower() in ("main", "article")
        #: None outside an article; within, whether all elements from there on are bare running text.
        self.plain = True if opens and not in_text else (parent.plain and tag in FLOW and not names if in_text else None)
        self.holds = False
        self.children: list[str] = []
        if opens and not marks:
            for e in self.named:
                e.holds = True


def blocks(page: str | None, depth: int = 12) -> tuple[list[tuple[str, int, str]], list[tuple[str, str]]]:
    """(place, kind, text) of every block of visible text in page order, and (place, style) of every element.

    The place is the path of tags with their ids and classes (digits as 0), down to ``depth`` elements; text
    deeper down belongs to the last of them. The style is the sequence of an element's children, repeats of
    one kind in a row as one. Character references are decoded, white space is one space. An element named
    like surroundings (``sidebar``, ``ad``) that holds an article is none. A null page has no blocks.
    """
    page = page or ""
    root = Element("body", {}, None, depth)
    stack, found, seen, text, at = [root], [], [root], [], 0

    def close() -> None:
        words = " ".join("".join(text).split())
        text.clear()
        if words:
            found.append((stack[-1], words))
            note(stack[-1], "#")

    def note(e: Element, child: str) -> None:
        if not e.children or e.children[-1] != child:
            e.children.append(child)

    def pop(tags: set[str]) -> None:
        """End the nearest open element of these, if no bound lies between."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                close()
                del stack[i:]
                return
            if stack[i].tag in BOUNDS:
                return

    while True:
        m = _TAG.search(page, at)
        piece = page[at : m.start() if m else len(page)]
        if piece:
            text.append(html.unescape(piece) if "&" in piece else piece)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in INLINE and not any(e.tag == tag for e in stack):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close()
                    del stack[i:]
                    break
            else:
                if tag not in INLINE:
                    close()
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                close()
            continue
        if tag in ("html", "body"):
            close()
            del stack[1:]
            continue
        attrs = attributes(m[3] if m[3] is not None else m[4] or "") if (m[3] or m[4]) else {}
        if tag in INLINE:
            e = Element(tag, attrs, stack[-1], depth)
            if not e.fixed and e.named == stack[-1].named or e.fixed and stack[-1].fixed:
                continue  # not an element of its own
        close()
        if tag in ENDS:
            for _ in range(2):
                pop(ENDS[tag])
        elif tag not in INLINE:
            pop({"p"})
        parent = stack[-1]
        e = Element(tag, attrs, parent, depth)
        if e.place != parent.place:
            note(parent, e.key)
        stack.append(e)
        seen.append(e)
    close()

    def kind(e: Element) -> int:
        if e.fixed or any(not x.holds for x in e.named):
            return CHROME
        return ARTICLE if e.plain else OPEN

    return [(e.place + "/#", kind(e), words) for e, words in found], [(e.place, "\n".join(e.children)) for e in seen if e.children]
