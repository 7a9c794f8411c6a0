"""A small element tree on the standard library's HTML parser."""

from __future__ import annotations

import html.parser as standard
import re
from dataclasses import dataclass, field
from html import unescape
from html.parser import HTMLParser

# HTML elements without content, and ones closed by a sibling.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
UNSHOWN = frozenset(("script", "style"))
SELF_CLOSING_SIBLINGS = {"li": {"li"}, "p": {"p"}, "option": {"option"}, "td": {"td"}, "tr": {"tr", "td"}}


# Markup as most of it is written: text, tags with quoted attributes, short comments.
_SPACE = r"[ \t\n\r\f]"
_ATTRIBUTE = rf"""{_SPACE}+([a-zA-Z][a-zA-Z0-9_:-]*)=("[^"<>]*"|'[^'<>]*')"""
_ATTRIBUTES = re.compile(_ATTRIBUTE)
_TOKEN = re.compile(
    rf"""([^<]+)|<([a-zA-Z][a-zA-Z0-9]*)((?:{_ATTRIBUTE.replace("(", "(?:")})*){_SPACE}*(/?)>|</([a-zA-Z][a-zA-Z0-9]*){_SPACE}*>"""
    rf"""|<!--[^->]*-->|<![dD][oO][cC][tT][yY][pP][eE]{_SPACE}[^<>]*>"""
)
_RAW = {tag: re.compile(rf"([^<]*)</{tag}{_SPACE}*>", re.IGNORECASE) for tag in HTMLParser.CDATA_CONTENT_ELEMENTS}
_OTHER = frozenset(getattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS", ())) | {"plaintext"}
_value = getattr(standard, "_unescape_attrvalue", unescape)
# Numbers of characters that int() may refuse for their length (its limit is never below 640 digits).
_LONG_NUMBER = re.compile(r"&#([0-9]{640,})")


@dataclass(slots=True)
class Element:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: Element | None = None
    children: list = field(default_factory=list)

    def text(self) -> str:
        """All shown text inside, in document order; no recursion, however deep."""
        found, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                found.append(node)
            elif node.tag not in UNSHOWN:
                stack.extend(reversed(node.children))
        return "".join(found)

    def walk(self) -> list[Element]:
        """Descendants in document order."""
        found, stack = [], [c for c in reversed(self.children) if not isinstance(c, str)]
        while stack:
            node = stack.pop()
            found.append(node)
            stack.extend(c for c in reversed(node.children) if not isinstance(c, str))
        return found


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.open = Element("#root")
        self.depth: dict[str, int] = {}  # open elements by tag

    def _close(self):
        self.depth[self.open.tag] -= 1
        self.open = self.open.parent

    def handle_starttag(self, tag, attrs):
        if self.open.tag in SELF_CLOSING_SIBLINGS.get(tag, ()):
            self._close()
        element = Element(tag, {k: v or "" for k, v in attrs}, self.open)
        self.open.children.append(element)
        if tag not in VOID:
            self.open = element
            self.depth[tag] = self.depth.get(tag, 0) + 1

    def handle_endtag(self, tag):
        if self.depth.get(tag):
            while self.open.tag != tag:
                self._close()
            self._close()

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)  # as browsers read <![anything[...]]>

    def handle_data(self, data):
        self.open.children.append(data)


def _plain(builder: _Builder, html: str) -> int:
    """Build from the plain markup that a page begins with; where the rest begins."""
    at, n = 0, len(html)
    while at < n:
        token = _TOKEN.match(html, at)
        if token is None:
            break
        end = token.end()
        text, tag, attrs, closed, ended = token.groups()
        if text is not None:
            builder.handle_data(unescape(text) if "&" in text else text)
        elif tag is not None:
            tag = tag.lower()
            if tag in _OTHER:
                break
            raw = None
            if tag in _RAW and not closed:
                raw = _RAW[tag].match(html, end)
                if raw is None:
                    break
            pairs = _ATTRIBUTES.findall(attrs) if attrs else ()
            builder.handle_starttag(tag, [(k.lower(), _value(v[1:-1]) if "&" in v else v[1:-1]) for k, v in pairs])
            if raw is not None:
                if raw.group(1):
                    builder.handle_data(raw.group(1))
                end = raw.end()
            if closed or raw is not None:
                builder.handle_endtag(tag)
        elif ended is not None:
            builder.handle_endtag(ended.lower())
        at = end
    return at


def parse_html(html: str) -> Element:
    """The tree of a page. What is not plain markup, and all behind it, goes through the standard parser."""
    # Eight digits without leading zeros are beyond the last character, as is any longer number.
    html = _LONG_NUMBER.sub(lambda m: f"&#{m.group(1).lstrip('0')[:8] or '0'}", html)
    builder = _Builder()
    rest = _plain(builder, html)
    if rest < len(html):
        builder.feed(html[rest:])
        builder.close()
    return builder.root


@dataclass(frozen=True)
class Match:
    """What an element must look like, and optionally be inside of."""

    tag: str = ""
    classes: tuple[str, ...] = ()
    contains: tuple[str, str] | None = None
    starts: tuple[str, str] | None = None
    equals: tuple[str, str] | None = None
    has: str = ""
    lacks: tuple[str, str] | None = None
    inside: Match | None = None

    def fits(self, element: Element) -> bool:
        if self.tag and element.tag != self.tag:
            return False
        attrs = element.attrs
        if self.classes:
            own = attrs.get("class")
            if not own or not set(self.classes) <= set(own.split()):
                return False
        if self.contains and self.contains[1] not in attrs.get(self.contains[0], ""):
            return False
        if self.starts and not attrs.get(self.starts[0], "").startswith(self.starts[1]):
            return False
        if self.equals and attrs.get(self.equals[0]) != self.equals[1]:
            return False
        if self.has and self.has not in attrs:
            return False
        if self.lacks and self.lacks[1] in attrs.get(self.lacks[0], ""):
            return False
        if self.inside:
            above = element.parent
            while above is not None and not self.inside.fits(above):
                above = above.parent
            return above is not None
        return True

    def beyond_class(self) -> tuple[bool, str | None]:
        """Whether a fit depends on more than tag and classes, and an attribute that it then needs."""
        others = [c for c in (self.contains, self.starts, self.equals) if c and c != self._of_class()]
        needed = [c[0] for c in others if c[1]] + ([self.has] if self.has else [])
        return bool(others or self.has or self.lacks or self.inside), needed[0] if needed else None

    def _of_class(self) -> tuple[str, str] | None:
        return self.contains if self.contains and self.contains[0] == "class" else None

    def may_fit(self, tag: str, classes: str) -> bool:
        part = self._of_class()
        return (
            (not self.tag or tag == self.tag) and set(self.classes) <= set(classes.split()) and (not part or part[1] in classes)
        )


def find_all(elements: list[Element], matches: tuple[Match, ...]) -> list[Element]:
    return [e for e in elements if any(m.fits(e) for m in matches)]


def find_first(elements: list[Element], matches: tuple[Match, ...]) -> Element | None:
    return next((e for e in elements if any(m.fits(e) for m in matches)), None)


class Finder:
    """Elements that fit any of several matches, found for all of them in one pass.

    What a tag and its classes decide is remembered for the next elements.
    """

    MOST = 10_000  # remembered kinds of elements

    def __init__(self, matches: list[Match]):
        self.numbers = {m: i for i, m in enumerate(dict.fromkeys(matches))}
        self.rules = [(i, m, *m.beyond_class()) for m, i in self.numbers.items()]
        self.kinds: dict[tuple[str, str | None], tuple] = {}

    def choice(self, matches: tuple[Match, ...]) -> tuple[int, ...]:
        return tuple(self.numbers[m] for m in matches)

    def _kind(self, tag: str, classes: str | None) -> tuple:
        rules = [r for r in self.rules if r[1].may_fit(tag, classes or "")]
        kind = tuple(i for i, _, more, _ in rules if not more), tuple((i, m, need) for i, m, more, need in rules if more)
        if len(self.kinds) >= self.MOST:
            self.kinds.clear()
        self.kinds[tag, classes] = kind
        return kind

    def find(self, elements: list[Element]) -> Found:
        fits: dict[int, list[tuple[int, Element]]] = {}
        for at, e in enumerate(elements):
            attrs = e.attrs
            key = e.tag, attrs.get("class")
            sure, maybe = self.kinds.get(key) or self._kind(*key)
            for i in sure:
                fits.setdefault(i, []).append((at, e))
            for i, m, need in maybe:
                if (need is None or need in attrs) and m.fits(e):
                    fits.setdefault(i, []).append((at, e))
        return Found(fits)


class Found(dict):
    """By the number of a match, the elements that fit it and their places."""

    def all(self, choice: tuple[int, ...]) -> list[Element]:
        if len(choice) == 1:
            return [e for _, e in self.get(choice[0], ())]
        places = {at: e for i in choice for at, e in self.get(i, ())}
        return [places[at] for at in sorted(places)]

    def first(self, choice: tuple[int, ...]) -> Element | None:
        found = [self[i][0] for i in choice if i in self]
        return min(found, key=lambda place: place[0])[1] if found else None
