"""A lenient reader of HTML: the leaf blocks of a page with the features of each."""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

_TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)""",
    re.S,
)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_VALUES = re.compile(r""""[^"]*"|'[^']*'""")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
_UNSEEN = re.compile(r"""display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
#: Elements whose content is not text of the page: those of raw text, which end at the first closing
#: tag or with the page, and those of markup, which nest and hide nothing where they are not closed.
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
HIDING = frozenset("template svg object audio video canvas select datalist annotation annotation-xml".split())
INLINE = frozenset(
    "math mi mo mn ms mtext mrow msup msub msubsup mfrac msqrt mroot mfenced mover munder semantics a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter nobr output picture progress q rp rt ruby s samp small source span strike strong sub sup time track tt u var wbr link meta base embed param area col".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold parts of a page, and what share of its text a part counts for in what holds it.
PARTS = frozenset("article aside center details div fieldset footer form header main nav section td th".split())
_PASSED_UP = 0.6
#: An opening tag that closes an open element of these, up to the barrier.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
ANCESTORS = ("nav", "header", "footer", "aside", "form", "article", "main", "section", "ul", "ol", "table", "dialog", "button", "fieldset", "figure", "blockquote", "menu", "address", "details")
#: Families of words in class, id and role attributes.
FAMILIES = {
    "menu": r"nav|navbar|navigation|menu\w*|breadcrumbs?|topbar|toolbar|tabs?|pagination|pager|toc|skip",
    "advert": r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|outbrain|taboola|affiliate",
    "comment": r"comments?\w*|respond|repl(?:y|ies)|discussion|disqus|reader|guestbook",
    "side": r"side|sidebar\w*|related\w*|widgets?|rail|recommend\w*|trending|popular|more|complementary|aside|teasers?",
    "notice": r"cookies?\w*|consent|gdpr|notices?|alerts?|popup|modal|overlay|dialog|newsletter|subscri\w*|signup|paywall|toast",
    "foot": r"footer|foot|copyright|legal|colophon|contentinfo|disclaimer|bottom",
    "head": r"header|masthead|head|logo|branding|topbar|hero",
    "form": r"form|search\w*|login|contact|input|register",
    "social": r"share\w*|sharing|social\w*|follow|tweet|facebook|twitter|tags?|meta|byline|author\w*|bio|timestamp|date\w*|published|updated",
    "content": r"content|article\w*|post|entry|story|main|body|text|prose",
}
_FAMILY = {k: re.compile(rf"(?:^|-)(?:{v})(?=$|-)") for k, v in FAMILIES.items()}
#: Names that say what a page has or what an article is about, not what an element is.
_ABOUT = re.compile(r"(?:has|no|not|with|without|is|hide|show|category|tag|type|status|format|lang|js|col|theme|template)-|.*-(?:enabled|disabled|open|closed|on|off|active|count)$")
#: Of the names of these elements only the families named count: a heading or an article with a
#: misleading name is a heading or an article still.
_TRUSTED = dict.fromkeys(("main", "html", "body", "h1"), frozenset()) | {"article": frozenset(("comment", "advert"))}
TAGS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "div", "section", "article", "main", "body", "blockquote", "pre", "figcaption", "dd", "dt", "button", "footer", "header", "nav", "aside", "form")
#: What the containers around a block say together, the innermost last: nothing, content, something
#: beside it, content inside that, that inside content, the head of content.
PLACES = ("nowhere", "content", "beside", "content_in_beside", "beside_in_content", "head_of_content")
_CONTENT, _BESIDE, _HEAD = 1, 2, 3
#: Place after a container of that kind, by the place before it.
_ENTER = {_CONTENT: (1, 1, 3, 3, 4, 1), _BESIDE: (2, 4, 2, 2, 4, 4), _HEAD: (2, 5, 2, 2, 4, 5)}
_KINDS = dict.fromkeys(("article", "main"), _CONTENT) | dict.fromkeys(("nav", "footer", "aside", "form", "dialog", "menu", "fieldset", "button"), _BESIDE) | {"header": _HEAD}
FEATURES = (
    [f"in_{x}" for x in ANCESTORS] + [f"named_{x}" for x in FAMILIES] + ["hidden"] + [f"place_{x}" for x in PLACES] + [f"tag_{x}" for x in TAGS] + ["tag_other"]
    + ["length_1", "length_2", "length_3", "length_4", "links_none", "links_some", "links_most", "ends_sentence", "sentences", "sign_copyright", "first", "last", "same_parent", "always"]
    + ["outside_landmark", "outside_content", "no_content", "head_of_landmark", "link_alone"]
    + ["outside_bulk", "tail_links", "line_between"]
)
AT = {f: i for i, f in enumerate(FEATURES)}
_ANCESTOR_BIT = {x: 1 << AT[f"in_{x}"] for x in ANCESTORS}
_TAG = {x: AT[f"tag_{x}"] for x in TAGS}
_LANDMARK = _ANCESTOR_BIT["article"] | _ANCESTOR_BIT["main"]


#: Elements of text: a name that speaks of content says nothing of the rest of the page.
_TEXT = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "blockquote", "figcaption"))
_SENTENCE = frozenset(".!?:;\"'»”…)")
_HEADS = frozenset(("p", "div", "h1", "h2", "h3", "h4", "h5", "h6"))


class Block(NamedTuple):
    text: str
    features: list[int]


def _own(tag: str, attrs: str, seen: dict) -> tuple[int, int]:
    """The features that an element gives to the blocks in it, and the kind of container it is."""
    key = (tag, attrs)
    if key in seen:
        return seen[key]
    bits, kind = _ANCESTOR_BIT.get(tag, 0), _KINDS.get(tag, 0)
    if attrs:
        trusted, families = _TRUSTED.get(tag), set()
        for value in _NAMES.findall(attrs):
            for name in value.strip("\"'").split():
                name = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower().replace("_", "-")
                if not _ABOUT.match(name):
                    found = {f for f, pattern in _FAMILY.items() if pattern.search(name)}
                    # the content of something is not the content of the page
                    families |= found - {"content"} if len(found) > 1 else found
                    if found == {"content", "head"}:
                        families -= {"head"}
                        kind = kind or _HEAD
        if trusted is not None:
            families &= trusted
            kind = _KINDS.get(tag, 0)
        for f in families:
            bits |= 1 << AT[f"named_{f}"]
        beside = families - {"content", "head"}
        if beside:
            kind = _BESIDE
        elif not kind and families and tag not in _TEXT:
            kind = _HEAD if "head" in families else _CONTENT
        if _HIDDEN.search(_VALUES.sub("", attrs)) or _UNSEEN.search(attrs):
            bits |= 1 << AT["hidden"]
    if len(seen) < 10_000:
        seen[key] = bits, kind
    return bits, kind


def _below(parent: tuple, tag: str, part: int, bits: int, kind: int) -> tuple:
    """An element on the stack: tag, features of it and its ancestors, the part of the page that it is
    in or is, place, and its own features and kind."""
    return tag, parent[1] | bits, part, _ENTER[kind][parent[3]] if kind else parent[3], bits, kind


def _without_form(stack: list[tuple]) -> list[tuple]:
    """The stack as if its forms were plain: one that holds the article is the page's own."""
    out = [stack[0]]
    for tag, _, part, _, bits, kind in stack[1:]:
        out.append(_below(out[-1], tag, part, *((0, 0) if tag == "form" else (bits, kind))))
    return out


def _bulk(up: list[int], found: list[tuple]) -> list[bool]:
    """For each part of a page (up: the part around it) whether it is in the bulk: the part with the
    most text that is no link and in nothing beside the content. Of what a part has, the part around
    it counts a share, so that a few parts of like size count as one."""
    mass = [0.0] * len(up)
    for text, bits, _, links, place, part in found:
        if place in (0, 1, 5) and not bits >> AT["hidden"] & 1:
            mass[part] += max(0, len(text) - links)
    for part in range(len(up) - 1, 0, -1):
        mass[up[part]] += _PASSED_UP * mass[part]
    most = mass.index(max(mass))
    inside = [False] * len(up)
    for part in range(len(up)):
        inside[part] = part == most or part > 0 and inside[up[part]]
    return inside


def _lines(up: list[int], found: list[tuple]) -> set[int]:
    """The places of short lines, each alone in its div, that stand beside paragraphs and are not the
    first there."""
    blocks_of, paragraphs, begun, out = Counter(f[5] for f in found), {f[5] for f in found if f[2] == "p"}, set(), set()
    for i, (text, _, tag, _, _, part) in enumerate(found):
        if tag == "div" and len(text) < 80 and text[-1] not in _SENTENCE and blocks_of[part] == 1 and up[part] in paragraphs and up[part] in begun:
            out.add(i)
        begun.add(part)
    return out


def _tail(kept: list[int], found: list[tuple]) -> range:
    """The places in `kept` (the blocks of the content) of a list of links that ends it and of the short
    line above that: an article comes before, so it leads on to others."""
    first = len(kept)
    while first and found[kept[first - 1]][3] > 0.9 * len(found[kept[first - 1]][0]):
        first -= 1
    if len(kept) - first < 2 or first < 2:
        return range(0)
    head = found[kept[first - 1]]
    if len(head[0]) >= 80 or head[0][-1] in _SENTENCE or head[2] not in _HEADS or not any(found[i][0][-1] in _SENTENCE for i in kept[: first - 1]):
        return range(0)
    return range(first - 1, len(kept))


def blocks(page: str, seen: dict | None = None) -> list[Block]:
    """The leaf blocks in page order: runs of text that no block-level tag breaks, character
    references decoded, white space turned into one space, trimmed; empty ones left out."""
    seen = {} if seen is None else seen
    stack: list[tuple] = [("body", 0, 0, 0, 0, 0)]
    found: list[tuple[str, int, str, int, int, int]] = []
    up = [0]  # of each part of the page the part around it
    parts: list[str] = []
    linked = link_chars = 0
    # the open elements of HIDING: tag, and what was read before each
    hiding: list[tuple[str, int, list, list, int, int]] = []

    def flush() -> None:
        nonlocal link_chars
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                tag, bits, part, place = stack[-1][:4]
                found.append((text, bits, tag, link_chars, place, part))
        link_chars = 0

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        to = m.start() if m else n
        if to > at:
            text = page[at:to]
            if "&" in text:
                text = html.unescape(text)
            parts.append(text)
            if linked:
                link_chars += len(text.strip())
        if not m:
            break
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        attrs = (m["attrs"] if m["tag"] else m["attrs2"]) or ""
        inside = len(hiding[-1][3]) if hiding else 1  # places of the stack from which on elements are hidden
        if m["end"] or m["end2"]:
            if tag in HIDING and any(h[0] == tag for h in hiding):
                while True:
                    name, count, before, stack_, linked, link_chars = hiding.pop()
                    if name == tag:
                        break
                del found[count:]
                parts[:], stack[:] = before, stack_
                continue
            if tag == "a":
                linked = 0
            elif tag in INLINE:
                if tag == "br":
                    parts.append(" ")
            else:
                flush()
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        # what an element around them ends was not closed
                        while hiding and len(hiding[-1][3]) > i:
                            hiding.pop()
                        break
            continue
        if tag in HIDING:
            if not attrs.endswith("/"):
                hiding.append((tag, len(found), parts[:], stack[:], linked, link_chars))
            continue
        if tag in RAW:
            if not attrs.endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = close.end() if close else n
            continue
        if tag in INLINE:
            if tag == "a":
                linked = 1
            elif tag == "br":
                parts.append(" ")
            continue
        flush()
        if tag in ("html", "body", "head"):
            bits = _own(tag, attrs, seen)[0] if tag == "body" else 0
            stack[0] = ("body", stack[0][1] | (bits & (1 << AT["hidden"])), 0, 0, 0, 0)
            continue
        if stack[-1][0] == "p" and len(stack) > inside:
            stack.pop()
        if tag in CLOSES:
            close_tags, barrier = CLOSES[tag]
            for i in range(len(stack) - 1, inside - 1, -1):
                if stack[i][0] in barrier:
                    break
                if stack[i][0] in close_tags:
                    del stack[i:]
                    break
        if tag not in VOID:
            if tag in ("article", "main", "h1") and stack[-1][1] & _ANCESTOR_BIT["form"]:
                stack[:] = _without_form(stack)
            part = stack[-1][2]
            if tag in PARTS:
                up.append(part)
                part = len(up) - 1
            stack.append(_below(stack[-1], tag, part, *_own(tag, attrs, seen)))
    flush()

    lines = _lines(up, found)
    # a page that marks its article says of the rest that it is none; a line is no article
    inside = [i not in lines and place in (1, 4, 5) and (2 if bits & _LANDMARK else 1) for i, (_, bits, _, _, place, _) in enumerate(found)]
    marked = max(inside, default=0)
    bulk = _bulk(up, found)
    kept = [i for i, f in enumerate(found) if (f[4] in (1, 5) and inside[i] == marked if marked else not f[4] and bulk[f[5]])]
    tail = {kept[at] for at in _tail(kept, found)}
    out = []
    parents: list[int] = []
    for i, (text, bits, tag, links, place, part) in enumerate(found):
        f = [AT["always"], _TAG.get(tag, AT["tag_other"]), AT["place_nowhere"] + place]
        if not marked:
            f.append(AT["no_content"])
            if not bulk[part]:
                f.append(AT["outside_bulk"])
        elif inside[i] < marked:
            f.append(AT["outside_landmark"] if marked == 2 else AT["outside_content"])
        if place == 5 and bits & _LANDMARK:
            f.append(AT["head_of_landmark"])
        b = bits
        while b:
            low = b & -b
            f.append(low.bit_length() - 1)
            b ^= low
        size = len(text)
        f.append(AT["length_1"] if size < 25 else AT["length_2"] if size < 80 else AT["length_3"] if size < 250 else AT["length_4"])
        f.append(AT["links_none"] if not links else AT["links_most"] if links > 0.5 * size else AT["links_some"])
        if links > 0.9 * size:
            f.append(AT["link_alone"])
        if text[-1] in _SENTENCE:
            f.append(AT["ends_sentence"])
        if ". " in text:
            f.append(AT["sentences"])
        if "©" in text or "all rights reserved" in text.lower():
            f.append(AT["sign_copyright"])
        if i in tail:
            f.append(AT["tail_links"])
        if i in lines:
            f.append(AT["line_between"])
        if i == 0:
            f.append(AT["first"])
        if i == len(found) - 1:
            f.append(AT["last"])
        if parents and parents[-1] == bits:
            f.append(AT["same_parent"])
        parents.append(bits)
        out.append(Block(text, f))
    return out
