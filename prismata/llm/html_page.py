"""A web page as elements and text blocks, read in one pass.

Block-level elements are named by their path of tags, classes and ids (digits
folded); a text block is the text between two block borders, with character
references decoded and white space made single.  What is never shown (head,
scripts, styles, hidden elements, controls) is left out.  Blocks of menus,
footers, forms and the like are kept but ``marked`` by their element's tag or
role.  Reading takes time in proportion to the page whatever its markup: every
character is scanned a bounded number of times, and elements keep a parent
number instead of a chain of ancestors.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import xxhash

MARKUP = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
TAG_END = re.compile(r"""(?>[^>=]+|=\s*+(?:"[^"]*"|'[^']*')|=)*+>""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
RAW_END = {t: re.compile(rf"</\s*{t}", re.I) for t in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that may hold an article whole.
CONTAINERS = {"html", "body", "div", "section", "article", "main", "table", "tbody", "tr", "td", "center", "figure", "details", "ul", "ol", "dl"}
BLOCKS = CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "th", "thead", "tfoot", "caption", "blockquote", "pre", "br", "hr", "figcaption", "summary", "address", "header", "footer", "nav", "aside", "form", "fieldset", "legend", "head", "title", "option", "hgroup", "search", "menu", "dialog", "noscript"}
UNSEEN = {"head", "noscript", "template", "svg", "iframe", "object", "canvas", "audio", "video", "button", "select", "label", "datalist"}
#: Elements and roles whose text is not the article's.
BESIDE = {"nav", "footer", "aside", "form", "option", "menu", "dialog", "search"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "tablist"}
#: Whole class names or ids of what stands beside an article; they count only while the element holds the smaller part of its page's text.
NAMES = {"comments", "comment-list", "commentlist", "comments-area", "disqus_thread", "respond", "ad", "ads", "advert", "advertisement", "sidebar", "cookie-notice", "cookie-banner", "newsletter", "breadcrumbs"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
ROW_BORDER = CONTAINERS - {"tr", "td", "tbody"}
ITEM_BORDER = {"ul", "ol", "dl", "select", "div", "body"}
ENDS_P = BLOCKS - {"br"}
DIGITS = re.compile(r"\d+")
MASK = (1 << 63) - 1


def digest(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\x00".join(map(str, parts))) & MASK


class Page:
    """Elements (parallel lists, parents first) and blocks of a page.

    ``signals`` off leaves tags, roles and names without a meaning, so that only
    the template speaks.
    """

    def __init__(self, source: str, signals: bool = True):
        self.signals = signals
        self.token: list[int] = []
        self.parent: list[int] = []
        self.container: list[bool] = []
        self.semantic: list[bool] = []  # an article or main element
        self.named: list[bool] = []
        self.first: list[int] = []
        self.last: list[int] = []
        #: (text, element or -1, marked, place in the page)
        self.blocks: list[tuple[str, int, bool, int]] = []
        self._now: list[str] = []
        self._at: tuple[int, bool] = (-1, False)
        #: (tag, element, unseen, marked, inside an article)
        self._stack: list[tuple[str, int, bool, bool, bool]] = [("", -1, False, False, False)]
        self._open_tags: Counter[str] = Counter()
        self._clock = 0
        self._read(source)
        self.mass = self._masses()

    def _masses(self) -> list[int]:
        """Length of the unmarked text inside each element."""
        mass = [0] * len(self.token)
        for text, e, marked, _ in self.blocks:
            if e >= 0 and not marked:
                mass[e] += len(text)
        for e in range(len(mass) - 1, -1, -1):
            if self.parent[e] >= 0:
                mass[self.parent[e]] += mass[e]
        return mass

    def _tick(self) -> int:
        self._clock += 1
        return self._clock

    def _flush(self) -> None:
        text = " ".join("".join(self._now).split())
        self._now.clear()
        if text:
            self.blocks.append((text, *self._at, self._tick()))

    def _text(self, raw: str) -> None:
        _, e, unseen, marked, _ = self._stack[-1]
        if raw and not unseen:
            if not self._now:
                self._at = (e, marked)
            self._now.append(entities.unescape(raw))

    def _push(self, tag: str, source: str) -> None:
        if tag in BLOCKS:
            self._flush()
        if tag in ENDS_P and self._open_tags["p"]:
            self._close("p", CONTAINERS)
        for t in CLOSES.get(tag, ()):
            if self._open_tags[t]:
                self._close(t, ROW_BORDER if tag in ("tr", "td", "th", "tbody") else ITEM_BORDER)
        if tag in VOID:
            return
        _, e, unseen, marked, inside = self._stack[-1]
        attributes: dict[str, str] = {}
        if source and not unseen and (tag in BLOCKS or "hidden" in source or "role" in source):
            for m in ATTRIBUTE.finditer(source):
                attributes.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
        unseen = unseen or tag in UNSEEN or "hidden" in attributes or attributes.get("aria-hidden") == "true"
        if self.signals and not marked:
            marked = tag in BESIDE or (tag == "header" and not inside) or attributes.get("role", "").lower() in ROLES
            if marked and tag not in BLOCKS:  # within a line
                unseen, marked = True, False
        if tag in BLOCKS and not unseen:
            name, ident = attributes.get("class", ""), attributes.get("id", "")
            self.parent.append(e)
            self.token.append(digest(self.token[e] if e >= 0 else "", DIGITS.sub("0", f"{tag} {name} #{ident}")))
            e = len(self.token) - 1
            self.container.append(tag in CONTAINERS)
            self.semantic.append(self.signals and tag in ("article", "main"))
            self.named.append(self.signals and tag not in ("html", "body", "article", "main") and (ident.lower() in NAMES or not NAMES.isdisjoint(name.lower().split())))
            self.first.append(self._tick())
            self.last.append(0)
        if not source.rstrip().endswith("/") or tag in BLOCKS:
            self._stack.append((tag, e, unseen, marked, inside or tag in ("article", "main")))
            self._open_tags[tag] += 1

    def _pop(self) -> None:
        tag, e, *_ = self._stack.pop()
        self._open_tags[tag] -= 1
        if e >= 0 and self._stack[-1][1] != e:
            self.last[e] = self._tick()

    def _close(self, tag: str, border: set[str] | None = None) -> None:
        if not self._open_tags[tag]:
            return
        if border:
            for i in range(len(self._stack) - 1, 0, -1):
                t = self._stack[i][0]
                if t == tag:
                    break
                if t in border:
                    return
        while self._stack[-1][0] != tag:
            self._pop()
        self._pop()

    def _read(self, source: str) -> None:
        at = 0
        while m := MARKUP.search(source, at):
            self._text(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                stop = source.find("-->" if m[0] == "<!--" else ">", at)
                at = len(source) if stop < 0 else stop + (3 if m[0] == "<!--" else 1)
                continue
            stop = source.find(">", at)
            if stop < 0:  # an open tag at the end of the page
                at = len(source)
                break
            if source.find("=", at, stop) >= 0:
                stop = end.end() - 1 if (end := TAG_END.match(source, at)) else stop
            attributes, at, tag = source[at:stop], stop + 1, m[2].lower()
            if m[1]:
                if tag in BLOCKS:
                    self._flush()
                self._close(tag)
            elif tag in RAW:
                if tag == "title":
                    self._flush()
                end = RAW_END[tag].search(source, at)
                stop = source.find(">", end.end()) if end else -1
                at = stop + 1 if stop >= 0 else len(source)
            else:
                self._push(tag, attributes)
        self._text(source[at:])
        self._flush()
        while len(self._stack) > 1:
            self._pop()
