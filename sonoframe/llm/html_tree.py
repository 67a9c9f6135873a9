"""A small DOM for block decisions: elements that can be kept or left out, their text and their features."""

import html
import math
import re

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template title svg iframe noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul".split())
SAME_CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
TAG_GROUPS = ("article main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "nav menu", "header", "footer", "aside",
              "form fieldset input select button textarea", "table tbody tr td th", "blockquote pre figure figcaption", "html body head")
TOKEN_GROUPS = ("article content post entry story main body text prose page", "ad ads advert advertisement banner promo promotion sponsor sponsored adslot dfp",
                "nav menu navbar navigation breadcrumb breadcrumbs topbar toolbar pagination pager tabs", "comment comments reply replies discussion disqus respond responses",
                "cookie cookies consent notice alert popup modal gdpr overlay message warning", "form login signup subscribe newsletter search register",
                "footer foot copyright legal bottom", "sidebar aside widget related rail recommended share social tags header masthead head top skip")
REGIONS = ("nav", "header", "footer", "aside", "form", "article", "main")

_GROUP_OF_TAG = {t: i for i, g in enumerate(TAG_GROUPS) for t in g.split()}
_GROUP_OF_TOKEN = {t: i for i, g in enumerate(TOKEN_GROUPS) for t in g.split()}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_NAMES = re.compile(r"""\b(class|id|role|data-keep)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "parent", "depth", "kids", "tokens", "keep", "at", "own", "chars", "links", "commas", "words", "elements", "paragraphs", "inputs", "anchors", "flags")

    def __init__(self, tag, parent, attributes):
        self.tag, self.parent, self.kids, self.keep, self.at = tag, parent, [], None, len(parent.kids) if parent else 0
        self.depth = parent.depth + 1 if parent else 0
        self.tokens = [0] * len(TOKEN_GROUPS)
        for name, *values in _NAMES.findall(attributes) if attributes else ():
            value = "".join(values)
            if name.lower() == "data-keep":
                self.keep = value == "1"
                continue
            for word in _WORD.findall(value):
                if (group := _GROUP_OF_TOKEN.get(word.lower())) is not None:
                    self.tokens[group] += 1
        above = parent.flags if parent else [0] * (len(TOKEN_GROUPS) + len(REGIONS))
        self.flags = [max(a, b) for a, b in zip(above, [*map(bool, self.tokens), *(tag == t for t in REGIONS)])]
        self.own = self.chars = self.links = self.commas = self.words = self.paragraphs = self.inputs = self.anchors = 0
        self.elements = 1
        if parent:
            parent.kids.append(self)


def parse(page: str):
    """The nodes of a page in order, and its pieces of text ``(node, text)``; a piece with text None ends a block."""
    root = Node("#root", None, "")
    nodes, pieces, stack, in_link, at = [root], [], [("#root", root)], 0, 0

    def text(raw):
        if raw:
            node = stack[-1][1]
            words = html.unescape(raw)
            pieces.append((node, words))
            n = len(words.strip())
            node.own += n
            node.commas += words.count(",") + words.count(".")
            node.words += words.count(" ") + 1
            if in_link:
                node.links += n

    def close(upto):
        nonlocal in_link
        while len(stack) > upto:
            name = stack.pop()[0]
            in_link -= name == "a"
            if name not in INLINE:
                pieces.append((stack[-1][1], None))

    length = len(page)
    while at < length:
        found = _TAG.search(page, at)
        if not found:
            text(page[at:])
            break
        text(page[at:found.start()])
        at = found.end()
        ending, name, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if not name:
            continue
        name = name.lower()
        if ending:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    close(i)
                    break
            continue
        if name in UNSEEN:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else length
            continue
        if name in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        if name in SAME_CLOSES and stack[-1][0] in SAME_CLOSES[name].split():
            close(len(stack) - 1)
        parent = stack[-1][1]
        parent.anchors += name == "a"
        parent.inputs += name in ("input", "select", "button", "textarea")
        if name in VOID:
            if name in ("br", "hr"):
                pieces.append((parent, None))
            continue
        named = _NAMES.search(attributes or "")
        node = parent if name in INLINE and not named else Node(name, parent, attributes)
        if node is not parent:
            node.paragraphs += name == "p"
            nodes.append(node)
        if name not in INLINE:
            pieces.append((node, None))
        in_link += name == "a"
        stack.append((name, node))
    for node in nodes:
        node.chars = node.own
    for node in reversed(nodes):
        if node.parent:
            for part in ("chars", "links", "commas", "words", "elements", "paragraphs", "inputs", "anchors"):
                setattr(node.parent, part, getattr(node.parent, part) + getattr(node, part))
    return nodes, pieces


def features(node: Node, total: int) -> list[float]:
    """Subtree density, attribute tokens, depth and sibling statistics of a node."""
    tags = [0.0] * len(TAG_GROUPS)
    if (group := _GROUP_OF_TAG.get(node.tag)) is not None:
        tags[group] = 1.0
    up = node.parent
    kids = up.kids if up else [node]
    before = kids[node.at - 1].chars if node.at else 0
    after = kids[node.at + 1].chars if node.at + 1 < len(kids) else 0
    chars = max(1, node.chars)
    return [*tags, *map(float, node.tokens), *map(float, node.flags), math.log1p(node.chars), node.links / chars, node.commas / chars,
            node.elements / math.sqrt(chars), node.words / max(1, node.elements), math.log1p(node.own), node.own / chars, float(node.depth),
            node.at / len(kids), math.log1p(len(kids)), sum(k.tag == node.tag for k in kids) / len(kids), math.log1p(before), math.log1p(after),
            node.chars / max(1, up.chars if up else node.chars), node.chars / max(1, total), float(node.paragraphs), float(node.inputs), float(node.anchors), float(len(node.kids)),
            math.log1p(up.chars if up else 0), up.links / max(1, up.chars) if up else 0.0, float(up.paragraphs) if up else 0.0, float(up.own if up else 0)]


def joined(pieces, kept) -> str:
    """The text of kept nodes: blocks in page order, white space as single spaces."""
    return " ".join("".join(" " if words is None else words if kept(node) else "" for node, words in pieces).split())
