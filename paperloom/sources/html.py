"""HTML pages as node arrays.

Each page row gains one array of nodes in document order, elements and pieces of
text alike. An element knows the index of its last descendant, so everything
inside it is one slice of the array: finding, nesting and text joining are array
expressions within the row and need no join or shuffle.
"""

from __future__ import annotations

import html as html_lib
import html.entities as entities
from collections import Counter
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.operators.select import TEXT_CONTAINERS, Rule
from paperloom.schemas import NODE

# Elements without content.
VOID_TAGS = {
    "area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr", "image",
    "img", "input", "isindex", "keygen", "link", "menuitem", "meta", "nextid", "param", "source",
    "spacer", "track", "wbr",
}

# Pages turned into one Arrow batch; keeps the Python side small on big pages.
_PAGES_PER_BATCH = 64

_ARROW_NODE = pa.struct(
    [
        ("pos", pa.int32()),
        ("end_pos", pa.int32()),
        ("tag", pa.string()),
        ("class_attr", pa.string()),
        ("classes", pa.list_(pa.string())),
        ("attrs", pa.map_(pa.string(), pa.string())),
        ("text", pa.string()),
        ("container", pa.string()),
    ]
)


class _PageNodes(HTMLParser):
    """Node list of one page.

    An end tag closes everything down to the nearest open element of that name
    and does nothing when none is open; paragraphs are not closed by the next
    one. Any tag or comment ends the running piece of text.
    """

    def __init__(self, rules: Sequence[Rule] | None, texts: bool):
        super().__init__(convert_charrefs=False)
        self.rules = rules
        self.texts = texts
        self.rules_by_tag: dict[str, list[Rule]] = {}
        self.nodes: list[dict] = []
        self.open: list[tuple[str, dict | None]] = []
        self.open_tags: Counter[str] = Counter()
        self.containers: list[str] = []
        self.kept_open = 0
        self.closed_voids: Counter[str] = Counter()
        self.pieces: list[str] = []

    def updatepos(self, i, j):
        """Line numbers are not needed."""
        return j

    def _end_text(self) -> None:
        if not self.pieces:
            return
        text = "".join(self.pieces)
        self.pieces.clear()
        if text and self.texts and (self.rules is None or self.kept_open):
            container = self.containers[-1] if self.containers else ""
            at = len(self.nodes)
            self.nodes.append({"pos": at, "end_pos": at, "text": text, "container": container})

    def _rules_for(self, tag: str) -> list[Rule]:
        found = self.rules_by_tag.get(tag)
        if found is None:
            found = [rule for rule in self.rules if rule.tag in (None, tag)]
            self.rules_by_tag[tag] = found
        return found

    def _node(self, tag: str, attrs: list) -> dict | None:
        """Node of an element, None if no rule may match it."""
        rules = None if self.rules is None else self._rules_for(tag)
        if rules is not None and not rules:
            return None
        values = {name: value or "" for name, value in attrs}
        classes = values["class"].split() if "class" in values else []
        if rules is not None and not any(rule.may_match(tag, classes, values) for rule in rules):
            return None
        at = len(self.nodes)
        return {
            "pos": at, "end_pos": at, "tag": tag, "class_attr": " ".join(classes),
            "classes": classes, "attrs": list(values.items()),
        }

    def _pop(self) -> str:
        tag, node = self.open.pop()
        self.open_tags[tag] -= 1
        if tag in TEXT_CONTAINERS:
            self.containers.pop()
        if node is not None:
            node["end_pos"] = len(self.nodes) - 1
            self.kept_open -= 1
        return tag

    def _start(self, tag: str, attrs: list, closes_itself: bool) -> None:
        self._end_text()
        node = self._node(tag, attrs)
        if node is not None:
            self.nodes.append(node)
            self.kept_open += 1
        self.open.append((tag, node))
        self.open_tags[tag] += 1
        if tag in TEXT_CONTAINERS:
            self.containers.append(tag)
        if closes_itself:
            self._pop()

    def handle_starttag(self, tag, attrs):
        void = tag in VOID_TAGS
        self._start(tag, attrs, void)
        if void:
            self.closed_voids[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self._start(tag, attrs, True)

    def handle_endtag(self, tag):
        if self.closed_voids[tag]:
            self.closed_voids[tag] -= 1
            return
        self._end_text()
        if self.open_tags[tag]:
            while self._pop() != tag:
                pass

    def handle_data(self, data):
        self.pieces.append(data)

    def handle_charref(self, name):
        self.pieces.append(html_lib.unescape(f"&#{name};"))

    def handle_entityref(self, name):
        self.pieces.append(entities.html5.get(name + ";", "&" + name))

    def handle_comment(self, data):
        self._end_text()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def run(self, html: str) -> list[dict]:
        self.feed(html)
        self.close()
        self._end_text()
        while self.open:
            self._pop()
        return self.nodes


def page_nodes(html: str, rules: Sequence[Rule] | None = None, texts: bool = True) -> list[dict]:
    """Nodes of one page; with rules, only elements some rule may match and the
    text inside them, without texts only the elements."""
    return _PageNodes(rules, texts).run(html)


def parse_html(
    pages: DataFrame, rules: Sequence[Rule] | None = None, texts: bool = True, html: str = "html"
) -> DataFrame:
    """``pages`` with ``html`` replaced by ``nodes`` and ``parse_error``.

    Pages are parsed where they lie. ``rules`` says what the caller will look
    for and ``texts`` whether texts are wanted, so that the rest of each page
    never leaves the Python worker. A page
    with no html, or none that can be read, keeps its row with NULL nodes.
    """
    carried = [field for field in pages.schema.fields if field.name != html]
    names = [field.name for field in carried]
    schema = T.StructType(
        [*carried, T.StructField("nodes", T.ArrayType(NODE)), T.StructField("parse_error", T.StringType())]
    )

    def read(text: str | None) -> tuple[list[dict] | None, str | None]:
        try:
            return None if text is None else page_nodes(text, rules, texts), None
        except Exception as problem:  # noqa: BLE001 - one broken page must not end the job
            return None, f"unreadable page: {problem}"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, _PAGES_PER_BATCH):
                part = batch.slice(first, _PAGES_PER_BATCH)
                found = [read(text) for text in part.column(part.schema.get_field_index(html)).to_pylist()]
                columns = [part.column(part.schema.get_field_index(name)) for name in names]
                columns.append(pa.array([nodes for nodes, _ in found], pa.list_(_ARROW_NODE)))
                columns.append(pa.array([error for _, error in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "nodes", "parse_error"])

    return pages.mapInArrow(parse, schema)


def node_rows(parsed: DataFrame, *keys: str) -> DataFrame:
    """One row per node."""
    return parsed.select(*keys, F.inline("nodes"))
