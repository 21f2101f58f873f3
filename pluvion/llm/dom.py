"""Blocks of text of an HTML page with their place in the element tree."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Elements by their part in a page, and words of class, id and role that mark a part.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = RAW | frozenset("head noscript template svg canvas object select datalist button audio video map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IN_HEAD = frozenset("meta link title style script base noscript template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html"
    " legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An element that ends an open one of these, found no deeper than the given containers.
CLOSES = {
    **{t: ("p", ()) for t in BLOCK - {"body", "html"}}, "li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)),
    "tr": ("tr", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)),
}
AGAINST_TAGS = frozenset("nav footer aside form menu dialog".split())
FOR_TAGS = frozenset("article main".split())
AGAINST = re.compile(
    r"(?<![a-z])(?:nav|navbar|navigation|menu\w*|footer|header|masthead|sidebar\w*|side|aside|ads?|adv|advert\w*|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notice\w*|notification\w*|alert"
    r"|popup\w*|modal|overlay|newsletter|subscri\w*|sign-?up|log-?in|register|share|sharing|social|related\w*|recommend\w*|breadcrumbs?|pagination|pager|widgets?|search\w*|form|copyright"
    r"|toolbar|taboola|outbrain|contentinfo|complementary|skip|paywall|toc|teasers?|tags|comment\w*|disqus\w*|repl(?:y|ies)|respond|discussion)(?![a-z])"
)
READERS = re.compile(r"(?<![a-z])(?:comment\w*|disqus\w*|repl(?:y|ies)|respond|discussion)(?![a-z])")
FOR = re.compile(r"(?<![a-z])(?:article\w*|content|main|post|entry|story)(?![a-z])")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[a-zA-Z/][^<]*\Z", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CAMEL = re.compile("(?<=[a-z])(?=[A-Z])")


@dataclass
class Element:
    tag: str
    parent: int
    depth: int
    against: float  # what its tag, class, id or role says against main text
    soft: bool  # said by a class or id other than of comments: void if an article lies inside
    favours: bool
    hidden: bool


@dataclass
class Block:
    parent: int
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def marks(tag: str, attributes: str) -> tuple[float, bool, bool, bool]:
    """against, soft, favours, hidden of an element by its tag and attributes."""
    given = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes.strip(" /") else {}
    hidden = tag in HIDDEN or "hidden" in given or bool(_UNSEEN.search(given.get("style", "")))
    if tag in AGAINST_TAGS:
        return 1.0, False, False, hidden
    if tag in ("html", "body"):
        return 0.0, False, False, hidden
    said = _CAMEL.sub("-", " ".join(given.get(k, "") for k in ("class", "id", "role"))).lower()
    favours = tag in FOR_TAGS or bool(FOR.search(said))
    named = [m[0] for m in AGAINST.finditer(said)]
    if favours and "header" in named:
        named.remove("header")
    if named:
        return 1.0, not READERS.search(said), False, hidden
    return (0.5 if tag == "header" else 0.0), False, favours, hidden


class Page:
    """``elements`` and ``blocks`` of an HTML text, tolerant of missing and misplaced end tags."""

    def __init__(self, source: str):
        self.elements = [Element("", -1, 0, 0.0, False, False, False)]
        self.blocks: list[Block] = []
        self.open, self.unseen, self.links, self.block = [0], 0, 0, None
        at, n, lower = 0, len(source), None
        while at < n:
            m = _TOKEN.search(source, at)
            self._text(source[at : m.start() if m else n])
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
            else:
                self._start(tag, m[3])
                if tag in RAW:
                    lower = source.lower() if lower is None and len(source.lower()) == n else lower
                    end = (lower or source).find(f"</{tag}", at)
                    at = n if end < 0 else end
        self._flush()

    def _flush(self) -> None:
        if self.block is not None:
            self.block.text = " ".join("".join(self.block.pieces).split())
            if self.block.text:
                self.blocks.append(self.block)
            self.block = None

    def _text(self, raw: str) -> None:
        if not raw or (self.unseen and not self._leave_head(raw)):
            return
        text = html.unescape(raw) if "&" in raw else raw
        if self.block is None:
            if text.isspace():
                return
            at = next(i for i in reversed(self.open) if self.elements[i].tag in BLOCK or i == 0)
            self.block = Block(at)
        self.block.pieces.append(text)
        if self.links:
            self.block.linked += len(text)

    def _leave_head(self, raw: str) -> bool:
        """Text straight inside an unclosed head begins the body."""
        if self.elements[self.open[-1]].tag == "head" and not raw.isspace():
            self._end("head")
        return not self.unseen

    def _pop(self, keep: int) -> None:
        for i in self.open[keep:]:
            e = self.elements[i]
            self.unseen -= e.hidden
            self.links -= e.tag == "a"
            if e.tag in BLOCK:
                self._flush()
        del self.open[keep:]

    def _find(self, tags: list[str], stop: tuple[str, ...]) -> int:
        """Where in the open elements the innermost of ``tags`` is; 0 if a container comes first."""
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.elements[self.open[k]].tag
            if tag in tags:
                return k
            if tag in stop or (not stop and tag in BLOCK):
                return 0
        return 0

    def _start(self, tag: str, attributes: str) -> None:
        top = self.elements[self.open[-1]].tag
        if top == "head" and tag not in IN_HEAD:
            self._end("head")
        if tag == "br":
            if self.block is not None:
                self.block.pieces.append(" ")
            return
        if tag in BLOCK:
            for closed in {("p", ()), CLOSES.get(tag, ("p", ()))}:
                if k := self._find(closed[0].split(), closed[1]):
                    self._pop(k)
            self._flush()
        if tag in VOID:
            return
        if tag == "a" and (k := self._find(["a"], ())):
            self._pop(k)
        parent = self.open[-1]
        seen = (0.0, False, False, False) if tag == "a" else marks(tag, attributes)
        self.elements.append(Element(tag, parent, self.elements[parent].depth + 1, *seen))
        self.open.append(len(self.elements) - 1)
        self.unseen += self.elements[-1].hidden
        self.links += tag == "a"

    def _end(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.elements[self.open[k]].tag == tag:
                return self._pop(k)
        if tag in BLOCK or tag == "br":
            self._flush()
