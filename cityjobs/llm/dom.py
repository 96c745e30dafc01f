"""A page as its blocks of text, each with the path of elements it stands in."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import xxhash

# fixed values: element and class names
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NOT_TEXT = frozenset("head script style noscript template iframe object svg math canvas audio video map datalist title".split())
FURNITURE = frozenset("nav footer aside form menu dialog button select textarea fieldset".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
TEXT_LEVEL = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd td th pre blockquote figcaption caption summary address".split())
FURNITURE_NAMES = re.compile(
    r"ads?|adv|advert\w*|adsense|sponsor\w*|promo\w*|banners?|nav\w*|menus?|breadcrumbs?|sidebars?|aside|footers?|foot|headers?|masthead|cookies?|consent|gdpr|notices?"
    r"|notifications?|popups?|modals?|overlays?|newsletters?|subscri\w*|shar(?:e|es|ing)|social|related|recommend\w*|comments?|disqus\w*|respond|repl(?:y|ies)|login|signup"
    r"|search\w*|skip|pagination|pagers?|widgets?|toolbars?|copyright"
)
NEUTRAL_NAMES = re.compile(
    r"|\d+|[a-z]|box(?:es)?|list|item|items|wrap|wrapper|inner|outer|container|section|area|block|panel|module|unit|slot|group|row|col|column|columns|grid|flex|left|right|top|bottom|main|global|site|page"
    r"|primary|secondary|clearfix|cf|xs|sm|md|lg|xl|bar|link|links|button|buttons|btn|icon|icons|tools|form|posts|articles|stories|thread|hidden|visible|js"
)
#: Words that say nothing more beside a name of these kinds.
BESIDE_NAMES = (
    (frozenset("cookie cookies consent gdpr notice notices".split()), frozenset("policy message and".split())),
    (frozenset("share sharing social".split()), frozenset("on us me and".split())),
    (frozenset("login signup nav menu search footer header sidebar".split()), frozenset("up us me and on".split())),
)
HEADERS = frozenset("header headers".split())
# end of fixed values

#: Levels are told apart in paths up to this length; elements further down have the path of the last one.
PATH = 1024
#: A longer style name is known by its digest.
STYLE = 256
_RAW = frozenset("script style noscript template textarea title iframe".split())
_OPENS = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
#: One attribute, as browsers read them: quotes count right after the equals sign only.
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*|=[^\s/>=]*)(?:\s*=\s*(?:(?P<quote>[\"'])|([^\s>]*)))?")
_END = re.compile(r"[\s/]*>")
_UNQUOTED = re.compile(r"[^\s>]*")
_DIGITS = re.compile(r"\d+")
_PART = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])")


class Block(NamedTuple):
    text: str
    path: str
    in_body: bool
    furniture: bool


class Token(NamedTuple):
    """A tag, with its attributes by name (of repeated ones the first); comments and what is in raw elements are tokens without a name."""

    begin: int
    end: int
    name: str
    closes: bool
    attributes: dict[str, str]


def tokens(page: str) -> Iterator[Token]:
    """The tags of a page, in one pass that never looks back.

    A tag ends at the next ``>`` outside a quoted value. Where a quote is never closed it is
    taken as part of an unquoted value, and a tag that is never closed takes the rest of the page.
    """
    at, end = 0, len(page)
    closed = {'"': page.rfind('"'), "'": page.rfind("'")}
    while True:
        m = _OPENS.search(page, at)
        if not m:
            return
        name = (m[2] or "").lower()
        if not name:
            comment = m[0] == "<!--"
            stop = page.find("-->" if comment else ">", m.end())
            at = end if stop < 0 else stop + (3 if comment else 1)
            yield Token(m.start(), at, "", False, {})
            continue
        at, attributes = m.end(), {}
        while not (stop := _END.match(page, at)):
            part = _ATTRIBUTE.match(page, at)
            if not part:
                break
            at, value = part.end(), part[3] or ""
            if quote := part["quote"]:
                if closed[quote] >= at:
                    stop = page.index(quote, at)
                    value, at = page[at:stop], stop + 1
                else:
                    rest = _UNQUOTED.match(page, at)
                    value, at = quote + rest[0], rest.end()
            attributes.setdefault(part[1].lower(), value)
        at = stop.end() if stop else end
        if name in _RAW and not m[1]:
            stop = _raw_end(name).search(page, at)
            yield Token(m.start(), stop.end() if stop else end, "", False, {})
            at = stop.end() if stop else end
            if not stop:
                return
            continue
        yield Token(m.start(), at, name, bool(m[1]), attributes)


@cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE)


class _Node:
    __slots__ = ("tag", "path", "body", "furniture", "kids")

    def __init__(self, tag: str, path: str, body: bool, furniture: bool):
        self.tag, self.path, self.body, self.furniture, self.kids = tag, path, body, furniture, []


def says_furniture(names: list[str], in_body: bool = False) -> bool:
    """Whether names of a class or an id say page furniture and nothing else.

    ``share-buttons`` and ``col-4 sidebar`` do; ``share-price``, ``related work`` and ``ad-hoc`` name
    something else, and so does ``comments-policy``, though ``cookie-policy`` does. A header within the
    article is its headline.
    """
    parts = [p.lower() for name in names for p in _PART.split(name)]
    said = [p for p in parts if FURNITURE_NAMES.fullmatch(p) and not (in_body and p in HEADERS)]
    if not said:
        return False
    beside = {w for first, words in BESIDE_NAMES for w in words if any(p in first for p in said)}
    return all(FURNITURE_NAMES.fullmatch(p) or NEUTRAL_NAMES.fullmatch(p) or p in beside for p in parts)


def _traits(tag: str, found: dict[str, str], in_body: bool) -> tuple[str, bool, bool]:
    """Style name of an element, whether it opens the article, and whether it is page furniture.

    An id names furniture on containers only: those of headings and paragraphs are targets of links.
    """
    style = tag
    furniture = tag in FURNITURE or tag in NOT_TEXT or (tag == "header" and not in_body)
    body = tag in ("article", "main")
    if found:
        role = found.get("role", "").lower()
        furniture |= role in ROLES or ("hidden" in found and found["hidden"].lower() != "until-found")
        body |= role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody"
        classes = found.get("class", "").split()
        if classes:
            style += "." + _DIGITS.sub("", ".".join(sorted(c.lower() for c in classes)))
        if tag not in ("body", "html", "article", "main"):
            ident = found.get("id", "").split() if tag not in TEXT_LEVEL else []
            furniture |= says_furniture(classes, in_body) or says_furniture(ident, in_body)
    style = style.replace("/", "")
    return style if len(style) <= STYLE else f"{tag}.{xxhash.xxh3_64_hexdigest(style)}", body, furniture


def blocks(page: str) -> tuple[list[Block], list[tuple[str, str]]]:
    """Blocks of text in page order, and (path, sequence of child elements) of every block element.

    Missing, crossed and superfluous tags are taken as browsers take them: an end tag closes
    up to its element or is ignored, a block start closes an open paragraph. Time and memory
    are linear in the page's length, whatever its tags are like.
    """
    out: list[Block] = []
    styles: list[tuple[str, str]] = []
    root = _Node("", "", False, False)
    stack = [root]
    opened: Counter[str] = Counter()
    text: list[str] = []
    at = 0

    def flush() -> None:
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if joined:
                n = stack[-1]
                out.append(Block(joined, n.path, n.body, n.furniture))

    def close() -> None:
        n = stack.pop()
        opened[n.tag] -= 1
        styles.append((n.path, ",".join(n.kids)))

    for token in tokens(page):
        if token.begin > at:
            text.append(page[at : token.begin])
        at, tag = token.end, token.name
        if not tag:
            continue
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            continue
        flush()
        if token.closes:
            if opened[tag]:
                while stack[-1].tag != tag:
                    close()
                close()
            continue
        if tag in CLOSES_P and stack[-1].tag == "p":
            close()
        if tag == "body" and stack[-1].tag == "head":
            close()
        if tag in ("li", "dt", "dd", "option", "tr", "td", "th") and stack[-1].tag == tag:
            close()
        up = stack[-1]
        style, body, furniture = _traits(tag, token.attributes, up.body)
        if not up.kids or up.kids[-1] != style:
            up.kids.append(style)
        if tag in VOID:
            continue
        furniture |= up.furniture
        opened[tag] += 1
        path = f"{up.path}/{style}" if len(up.path) < PATH else up.path
        stack.append(_Node(tag, path, up.body or (body and not furniture), furniture))
    if at < len(page):
        text.append(page[at:])
    flush()
    while len(stack) > 1:
        close()
    return out, styles
