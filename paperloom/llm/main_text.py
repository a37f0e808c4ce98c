"""Main text of web pages by a minimum cut.

A page becomes its text blocks. A classifier gives each block a cost for being
called content and one for being called boilerplate: the capacities between the
block and the two terminals. Neighbouring blocks, and neighbours below the same
parent, are joined by edges that cost something to cut, most between those of one
tag with the same signs. The minimum cut, found
by augmenting flows, is the cheapest labelling of all blocks together.

The classifier is logistic, on the text of a block (length, links, stops) and on
the elements around it (role, class hints). Its weights are fitted on at most
SAMPLE_BLOCKS blocks of SAMPLE_PAGES whole pages, whose semantic elements say
which blocks are content. Every block is learnt twice, with its elements and without, so that the text can speak
against them: long text in an aside can be content, links in an article need not
be. A form or header around a page's articles, or most of its text, says nothing.
Scripts, styles and the like never become blocks.

Pages are handled alone in their row, so there is no shuffle. Reading is linear
in the page. Blocks whose own costs outweigh all their edges are settled before
any flow is sent, so that long pages leave small graphs.

Defined results: a null or empty page, and one without text, gives an empty
string and 0 characters. Repeated rows each get a row. Equal costs make a block
boilerplate. Broken markup is read as far as it goes: unclosed elements end with
the page, stray end tags are ignored. Only id, url and html are read. An empty
table gives an empty result.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.sampling import least, thinned

#: Pages the classifier is fitted on, and blocks of them at most.
SAMPLE_PAGES = 300
SAMPLE_BLOCKS = 20_000

# --- pages as blocks ---------------------------------------------------------------

HIDDEN = frozenset("script style template noscript head iframe object svg canvas audio video select textarea button option datalist".split())
#: Elements whose content is not markup: it lasts to the end tag.
RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead tr ul caption".split()
)
#: An opening element ends an open one of these, unless a container is between.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
    "option": {"option"},
}
SCOPES = frozenset("table ul ol dl menu div article section main aside nav body html form fieldset".split())

_MARKUP = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)(>)?|[!?])")
_ATTRIBUTES = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
_TAG_END = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")

CONTENT_HINT = re.compile(r"(?i)(?:^|[\s_-])(?:article|content|main|post|entry|story|body|text|prose)(?:$|[\s_-])")
NOISE_HINT = re.compile(
    r"(?i)(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|footer\w*|foot|"
    r"masthead|comments?|replies|disqus|notices?|cookies?|consent|gdpr|popup\w*|modal\w*|overlay|share|sharing|social|"
    r"related|recommend\w*|subscribe\w*|newsletter\w*|signup|login|form|widgets?|copyright|legal|toolbar|pagination|pager|"
    r"skip)(?:$|[\s_-])"
)
#: Noise around an article, but not an article of that name or parts of one.
OUTER_HINT = re.compile(r"(?i)(?:^|[\s_-])(?:header|tags|byline|meta|search)(?:$|[\s_-])")
NOISE_TAGS = frozenset("nav footer aside form menu dialog".split())
#: Noise only where they do not hold the page itself.
WRAPPERS = frozenset("form header".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())


@dataclass(slots=True)
class Element:
    tag: str
    number: int
    #: -1 within noise, 1 within an article or main element, 0 neither; noise wins.
    role: int = 0
    hint: int = 0
    in_link: bool = False
    hidden: bool = False
    #: The innermost open wrapper.
    wrapper: int = 0
    #: The block element above.
    parent: int = 0


@dataclass(slots=True)
class Block:
    text: str
    tag: str
    parent: int
    role: int
    hint: int
    linked: int
    words: int
    wrapper: int = 0
    #: The element itself, in which other blocks can stand.
    owner: int = 0


_TOP = Element("", 0)


def _element(tag: str, attributes: str, number: int, above: Element, wide: bool = False) -> Element:
    role, hint = above.role, above.hint
    wrapper = number if tag in WRAPPERS else above.wrapper
    parent = above.number if above.tag in BLOCK else above.parent
    if not wide and (tag in NOISE_TAGS or (tag == "header" and role < 1)):
        role = -1
    elif role == 0 and tag in ("article", "main"):
        role, hint = 1, 0  # the inner of two signs holds
    in_link = above.in_link or tag == "a"
    hidden = above.hidden or tag in HIDDEN
    if "=" not in attributes and "hidden" not in attributes.lower():
        return Element(tag, number, role, hint, in_link, hidden, wrapper, parent)
    named: dict[str, str] = {}
    for name, value in _ATTRIBUTES.findall(attributes):
        named.setdefault(name.lower(), value.strip("\"'"))
    if not wide and named.get("role", "").lower() in NOISE_ROLES:
        role = -1
    told = f"{named.get('class', '')} {named.get('id', '')}"
    if told != " " and tag not in ("html", "body") and not wide:
        if NOISE_HINT.search(told) or (role < 1 and OUTER_HINT.search(told)):
            hint = -1
        elif hint == 0 and CONTENT_HINT.search(told):
            hint = 1
    hidden = hidden or "hidden" in named or named.get("aria-hidden", "").lower() == "true"
    hidden = hidden or "display:none" in named.get("style", "").replace(" ", "").lower()
    return Element(tag, number, role, hint, in_link, hidden, wrapper, parent)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in page order, decoded, white space collapsed."""
    found, above, holding = _blocks(page, frozenset())
    wide = _wide(found, above, holding)
    return _blocks(page, wide)[0] if wide else found


def _wide(found: Sequence[Block], above: dict[int, int], holding: set[int]) -> frozenset[int]:
    """The wrappers that hold an article or main element, or more than half of the words outside links."""
    words = dict.fromkeys(above, 0)
    total = 0
    for block in found:
        said = 0 if 2 * block.linked > len(block.text) else block.words
        total += said
        if block.wrapper:
            words[block.wrapper] += said
    holding = set(holding)
    for number in sorted(above, reverse=True):  # inner ones have larger numbers
        if above[number]:
            words[above[number]] += words[number]
            if number in holding:
                holding.add(above[number])
    return frozenset(n for n in above if n in holding or 2 * words[n] > total)


def _blocks(page: str, wide: frozenset[int]) -> tuple[list[Block], dict[int, int], set[int]]:
    """Blocks, the wrapper above each wrapper, and those right above an article or main element."""
    found: list[Block] = []
    wrappers: dict[int, int] = {}
    holding: set[int] = set()
    stack: list[Element] = []
    open_tags: dict[str, int] = {}
    parts: list[str] = []
    linked = 0
    number = 0
    owner: Element | None = None

    def say(text: str) -> None:
        nonlocal linked, owner
        if not text:
            return
        above = stack[-1] if stack else None
        if above and above.hidden:
            return
        if owner is None and not text.isspace():
            owner = next((e for e in reversed(stack) if e.tag in BLOCK), Element("body", 0))
        parts.append(text)
        if above and above.in_link:
            linked += len(text.strip())

    def end_block() -> None:
        nonlocal parts, linked, owner
        if owner is not None:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                words = text.count(" ") + 1
                found.append(Block(text, owner.tag, owner.parent, owner.role, owner.hint, linked, words, owner.wrapper, owner.number))
        parts, linked, owner = [], 0, None

    def pop() -> Element:
        element = stack.pop()
        open_tags[element.tag] -= 1
        return element

    at, size = 0, len(page)
    while at < size:
        match = _MARKUP.search(page, at)
        if not match:
            say(page[at:])
            break
        say(page[at : match.start()])
        if match[2] is None:
            if match[0] == "<!--":
                end = page.find("-->", match.end())
                at = size if end < 0 else end + 3
            else:
                end = page.find(">", match.end())
                at = size if end < 0 else end + 1
            continue
        tag = match[2].lower()
        if match[3]:
            attributes, at = "", match.end()
        else:
            closed = _TAG_END.match(page, match.end())
            at = closed.end() if closed else page.find(">", match.end()) + 1
            if at <= 0:
                break  # a tag that never ends: nothing follows
            attributes = page[match.end() : at - 1]
        if match[1]:
            if tag == "br" or (tag == "p" and not open_tags.get("p")):
                continue
            if tag in BLOCK:
                end_block()
            if open_tags.get(tag):
                # A closing inline tag does not end blocks that are open inside it.
                if tag not in BLOCK and any(e.tag in BLOCK for e in _down_to(stack, tag)):
                    _remove(stack, open_tags, tag)
                    continue
                while pop().tag != tag:
                    pass
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in VOID:
            if tag in BLOCK:
                end_block()
            continue
        number += 1
        if tag in BLOCK:
            end_block()
            if open_tags.get("p") and tag not in ("html", "body"):
                _close_paragraph(stack, open_tags)
            ending = ENDS.get(tag)
            if ending:
                while any(open_tags.get(t) for t in ending):
                    place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag in ending or stack[i].tag in SCOPES), -1)
                    if place < 0 or stack[place].tag not in ending:
                        break
                    while len(stack) > place:
                        pop()
        if attributes.endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        above = stack[-1] if stack else _TOP
        element = _element(tag, attributes, number, above, number in wide)
        if tag in WRAPPERS:
            wrappers[number] = above.wrapper
        elif above.wrapper and tag in ("article", "main"):
            holding.add(above.wrapper)
        if tag in RAW:
            closing = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(page, at)
            if tag == "noscript" or tag == "title" or element.hidden or tag in HIDDEN:
                if not closing:
                    break
                at = page.find(">", closing.end())
                at = size if at < 0 else at + 1
                continue
        stack.append(element)
        open_tags[tag] = open_tags.get(tag, 0) + 1
    end_block()
    return found, wrappers, holding


def _down_to(stack: Sequence[Element], tag: str) -> Iterator[Element]:
    for element in reversed(stack):
        if element.tag == tag:
            return
        yield element


def _remove(stack: list[Element], open_tags: dict[str, int], tag: str) -> None:
    place = next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag)
    del stack[place]
    open_tags[tag] -= 1
    if tag == "a":
        for i in range(place, len(stack)):
            stack[i].in_link = i > 0 and stack[i - 1].in_link or stack[i].tag == "a"


def _close_paragraph(stack: list[Element], open_tags: dict[str, int]) -> None:
    """Ends the open paragraph, and inline elements within it, unless another block holds it."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i].tag == "p":
            for element in stack[i:]:
                open_tags[element.tag] -= 1
            del stack[i:]
            return
        if stack[i].tag in SCOPES or stack[i].tag in ("td", "th", "li", "blockquote"):
            return


# --- the classifier -----------------------------------------------------------------

STOPS = ".!?;:"
FEATURES = ("one", "words", "linked", "stops", "heading", "item", "paragraph", "short", "role", "hint")
#: The last features are of the elements around a block, the others of its text.
ELEMENTS = 2
#: Log-odds of content a fit starts from.
START = (-1.0, 0.6, -4.0, 1.5, 1.0, -0.8, 1.0, -0.5, 3.0, 3.0)
#: Costs to part neighbours, by how close they are in the tree: next to each other in the
#: page, below one parent, and there of one tag with the same signs, such as paragraphs of a text.
NEXT = 0.4
SIBLING = 0.6
ALIKE = 3.0
#: Costs are whole numbers of this many parts, so that flows end exactly.
PARTS = 1000


def features(block: Block) -> list[float]:
    stops = sum(map(block.text.count, STOPS))
    return [
        1.0,
        math.log1p(block.words),
        min(1.0, block.linked / max(1, len(block.text))),
        min(1.0, stops * 8 / max(1, block.words)),
        float(block.tag[0] == "h" and block.tag[1:].isdigit()),
        float(block.tag in ("li", "td", "th", "dd", "dt")),
        float(block.tag in ("p", "pre", "blockquote")),
        float(block.words < 5),
        # A hint of noise within an article outweighs the article.
        float(min(block.role, 0 if block.hint < 0 else 1)),
        # Long comments read like an article, so signs of noise count twice.
        float(block.hint if block.hint > 0 else 2 * block.hint),
    ]


#: Features of a block and whether it is content.
Example = tuple[Sequence[float], float]


def examples(page: str) -> Iterator[Example]:
    """The blocks of a page whose elements say what they are."""
    for block in blocks(page):
        if block.role and block.hint * block.role >= 0:
            yield features(block), float(block.role > 0)


def fit(pages: Sequence[str | Example], rounds: int = 200, rate: float = 0.5, prior: float = 0.05) -> np.ndarray:
    """Logistic regression on the blocks whose elements say what they are, with and without these, drawn to START."""
    rows, labels = [], []
    for page in pages:
        for held, content in examples(page) if isinstance(page, str) else [page]:
            rows.append(held)
            labels.append(content)
    start = np.array(START)
    if not labels or min(labels) == max(labels):
        return start
    seen, y = np.array(rows), np.array(labels * 2)
    unseen = seen.copy()
    unseen[:, -ELEMENTS:] = 0
    x = np.concatenate([seen, unseen])
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    weights = start.copy()
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-(x @ weights)))
        weights += rate * (x.T @ (balance * (y - chance)) / len(y) - prior * (weights - start))
    return weights


def sample(pages: DataFrame, *, key: str = "page_id", html: str = "html") -> list[Example]:
    """The SAMPLE_BLOCKS examples of least hash from the SAMPLE_PAGES pages of least hash, which tasks read whole."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for h, page in zip(frame["h"], frame["text"]):
                found = [(h, number, held, content) for number, (held, content) in enumerate(examples(page))]
                yield pd.DataFrame(found, columns=["h", "number", "held", "content"])

    chosen = least(thinned(pages.where(F.col(html).isNotNull()), 4 * SAMPLE_PAGES, key, html), SAMPLE_PAGES, key, html)
    found = chosen.mapInPandas(read, "h long, number long, held array<double>, content double")
    few = found.orderBy(F.xxhash64("h", "number"), "h", "number", "held").limit(SAMPLE_BLOCKS).collect()
    return [(row.held, row.content) for row in few]


# --- the cut -------------------------------------------------------------------------

Edge = tuple[int, int, int]


def minimum_cut(gain: Sequence[int], edges: Sequence[Edge]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut.

    ``gain`` is what a node pays for the sink's side, or if negative, for the
    source's. ``edges`` are ``(node, node, cost)``. Nodes whose gain outweighs
    their edges are settled at once, and shift their neighbours' gains; the rest
    is solved by blocking flows. Of several minimum cuts the one with the
    smallest source side is returned.
    """
    n = len(gain)
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    weight = [0] * n
    for a, b, cost in edges:
        near[a].append((b, cost))
        near[b].append((a, cost))
        weight[a] += cost
        weight[b] += cost
    value = list(gain)
    side: list[bool | None] = [None] * n
    ready = deque(range(n))
    while ready:
        i = ready.popleft()
        if side[i] is not None or (-weight[i] < value[i] <= weight[i]):
            continue
        side[i] = value[i] > weight[i]
        for j, cost in near[i]:
            if side[j] is None:
                value[j] += cost if side[i] else -cost
                weight[j] -= cost
                ready.append(j)
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        place = {i: k for k, i in enumerate(rest)}
        inner = [(place[a], place[b], c) for a, b, c in edges if a in place and b in place]
        for i, source in zip(rest, _flow([value[i] for i in rest], inner)):
            side[i] = source
    return [bool(s) for s in side]


def _flow(gain: Sequence[int], edges: Sequence[Edge]) -> list[bool]:
    """Dinic's blocking flows, without recursion."""
    n = len(gain)
    source, sink = n, n + 1
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def join(a: int, b: int, there: int, back: int) -> None:
        heads[a].append(len(to))
        to.append(b)
        room.append(there)
        heads[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, g in enumerate(gain):
        if g > 0:
            join(source, i, g, 0)
        elif g < 0:
            join(i, sink, -g, 0)
    for a, b, cost in edges:
        join(a, b, cost, cost)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in heads[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        tried = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                first = next(k for k, e in enumerate(path) if not room[e])
                a = to[path[first] ^ 1]
                del path[first:]
                continue
            while tried[a] < len(heads[a]):
                e = heads[a][tried[a]]
                if room[e] and level[to[e]] == level[a] + 1:
                    break
                tried[a] += 1
            if tried[a] < len(heads[a]):
                path.append(heads[a][tried[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                tried[a] += 1
            else:
                break


def label(found: Sequence[Block], weights: np.ndarray) -> list[bool]:
    """Which blocks are content."""
    if not found:
        return []
    gain = [round(c * PARTS) for c in (np.array([features(b) for b in found]) @ weights).tolist()]
    edges = [(i, i + 1, int(NEXT * PARTS)) for i in range(len(found) - 1)]
    last: dict[int, int] = {}
    like: dict[tuple[int, str, int, int], int] = {}
    for i, block in enumerate(found):
        # Loose text has its neighbours in its own element.
        before = last.get(block.owner) if block.owner in last else last.get(block.parent)
        if before is not None:
            edges.append((before, i, int(SIBLING * PARTS)))
        last[block.parent] = last[block.owner] = i
        kind = block.parent, block.tag, block.role, block.hint
        if kind in like:
            edges.append((like[kind], i, int(ALIKE * PARTS)))
        like[kind] = i
    return minimum_cut(gain, edges)


def main_text(page: str | None, weights: np.ndarray) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, kept in zip(found, label(found, weights)) if kept)


def extract(pages: DataFrame, weights: np.ndarray, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(key, url, text, n_chars)`` of every page."""
    kinds = {name: pages.schema[name].dataType.simpleString() for name in (key, url)}

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [main_text(page, weights) for page in frame["html"]]
            yield pd.DataFrame(
                {key: frame["key"].array, url: frame["url"].array, "text": texts, "n_chars": [len(t) for t in texts]}
            )

    chosen = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"))
    return chosen.mapInPandas(read, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars long")
