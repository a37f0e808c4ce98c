"""Personal data by patterns and a semi-Markov conditional random field.

Four kinds come from fixed patterns with a check behind each (``base_spans``).
A semi-Markov model adds spans the patterns miss. It reads regions: runs of
tokens near a digit, an ``@``, a ``=`` or ``:``, or a word or prefix secrets go
with. No token is in two regions, and a region is read as one, however long it or
its spans are. In a region it chooses boundaries and kinds
together: every candidate segment of at most ``LONGEST`` tokens is scored as a
whole (shape of the span, its digits and check sum, the word before it), a kind
follows a kind at a price, and the best labelling of the region is found by
dynamic programming in time linear in its tokens. Scores are log-potentials
fitted to the likelihood by forward-backward sums over a bounded sample. Its
targets come from the patterns and from secrets in unmistakable form; without
targets the starting weights stay.

Each text is handled alone in its row, so there is no shuffle. All searches are
linear in the text: no pattern here can start twice over the same run.

Defined results: a null or empty text has no spans. Repeated rows each get a
row. Only the id and the text are read (``mask_documents`` keeps all columns).
Ties between labellings go to no entity, then to the earlier kind. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.sampling import least, thinned

#: Kinds in the order in which spans are listed; the first four have patterns.
KINDS = ("email", "ip", "card", "phone", "secret")
#: Tokens a segment may have.
LONGEST = 5
#: Tokens and characters of the pieces of regions that a fit reads.
PIECE = 40
PIECE_CHARS = 20_000
#: Documents looked at for regions (about), those with triggers kept, and pieces of regions at most.
SAMPLE_LOOK = 10_000
SAMPLE_DOCUMENTS = 2_000
SAMPLE_REGIONS = 1_500

Span = tuple[int, int]

# --- patterns ------------------------------------------------------------------

_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A run of digits that fails at its start fails anywhere in it.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    values = [ord(c) - 48 for c in reversed(digits)]
    return (sum(values[::2]) + sum(v * 2 - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def emails(text: str) -> list[Span]:
    """Spans around each ``@``; a local part never reaches into the last match."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _WORD:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            end = match.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def base_spans(text: str) -> dict[str, list[Span]]:
    """The spans of the four patterns, each kind leftmost and without overlap."""
    spans: dict[str, list[Span]] = {"email": emails(text), "ip": [], "card": [], "phone": []}
    if not _DIGIT.search(text):
        return spans
    spans["ip"] = [m.span() for m in _IP.finditer(text) if all(map(_octet, m.groups()))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans["card"].append(m.span())
    if "+" in text:
        spans["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return spans


# --- regions, segments and features ----------------------------------------------

# Looking at one character first is much faster than trying all words at each.
_TRIGGER = re.compile(
    r"[0-9@=:]++|(?=[AGPSTXagpstx])(?:(?i:passw(?:or)?d|pwd|secret|token|api[_-]?key|access[_-]?key)|AKIA|ASIA|ghp_|sk-|xox[bp]-)"
)
_TOKEN = re.compile(r"\S+")
_EDGES = "\"'`,;:!?<>[]{}.=()"
_OPEN = "\"'`,;:!?<>[]{}.=)"  # a span may begin with a bracket
_SECRET_WORD = re.compile(r"(?i)(password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|apikey)")
_ASSIGNED = re.compile(r"(?i)^(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|apikey)\s*[=:]\s*['\"]?[^\s'\"]{6,}$")
_KEY = re.compile(r"^(?:AKIA|ASIA|ghp_|sk-|xox[bp]-)[A-Za-z0-9_-]{16,}$")
_HEX = re.compile(r"^[0-9a-f]{16,}$")
_QUAD = re.compile(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")
_ADDRESS = re.compile(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$")
_DIALLED = re.compile(r"^\+?[0-9 ().-]+$")
_ASSIGNS = re.compile(r"[=:]$")
_WORDED = re.compile(r":(\s+)['\"]?[^\W\d_]+$")
_LINE_END = re.compile(r"['\"`,;\]})]*[^\S\r\n]*(?:[\r\n]|$)")

FEATURES = (
    "bias", "address", "quad", "luhn", "plus", "dialled", "grouped", "hex", "key", "assigned",
    "after_secret_word", "letters_only", "more_tokens", "digits_9_15", "decimal", "worded",
)
#: Log-potentials a fit starts from, by kind; features not named have 0.
START = {
    "email": {"bias": -6, "address": 12, "more_tokens": -6},
    "ip": {"bias": -6, "quad": 12, "more_tokens": -6},
    "card": {"bias": -6, "luhn": 10, "plus": -6, "hex": -2, "dialled": 2},
    "phone": {"bias": -8, "plus": 6, "dialled": 2, "digits_9_15": 2, "grouped": 3, "luhn": -2, "quad": -6},
    "secret": {"bias": -8, "key": 12, "assigned": 13, "after_secret_word": 6, "hex": 4, "more_tokens": -4, "worded": -6},
}
FOLLOWS = -1.0


def regions(text: str) -> Iterator[list[Span]]:
    """Tokens around triggers: runs of them with up to four tokens between, two before and three behind."""
    run: list[Span] = []
    before: list[Span] = []
    quiet = 0
    marks = (match.start() for match in _TRIGGER.finditer(text))
    mark = next(marks, None)
    if mark is None:
        return
    for match in _TOKEN.finditer(text):
        token = match.span()
        if mark is not None and mark < token[1]:
            while mark is not None and mark < token[1]:
                mark = next(marks, None)
            run = run or before
            run.append(token)
            quiet = 0
        elif run:
            run.append(token)
            quiet += 1
            if quiet > 4:
                # The last two can come before the next run, so they are not in this one.
                yield run[:-2]
                before, run, quiet = run[-2:], [], 0
        else:
            before = [*before[-1:], token]
    if run:
        yield run


def trimmed(text: str, start: int, end: int) -> Span:
    """The span without quotes and punctuation around it."""
    while start < end and text[start] in _OPEN:
        start += 1
    opened = text.find("(", start, end)
    while end > start and text[end - 1] in _EDGES and not (text[end - 1] == ")" and 0 <= opened < end):
        end -= 1
    return start, end


def features(text: str, start: int, end: int, n_tokens: int, after_word: bool) -> list[int]:
    """The places in FEATURES that hold for a span; ``after_word`` if a secret word is assigned right before."""
    span = text[start:end]
    digits = [c for c in span if "0" <= c <= "9"]
    dialled = bool(_DIALLED.match(span))
    held = [0]
    if _ADDRESS.match(span):
        held.append(1)
    if _QUAD.match(span) and all(map(_octet, span.split("."))):
        held.append(2)
    if dialled and 13 <= len(digits) <= 19 and luhn("".join(digits)):
        held.append(3)
    if span.startswith("+"):
        held.append(4)
    if dialled:
        held.append(5)
        if sum(c in " ().-" for c in span) >= 2 and re.search(r"[0-9]{3}[ .-][0-9]{4}$", span):
            held.append(6)
        if 9 <= len(digits) <= 15:
            held.append(13)
    if _HEX.match(span) and 0 < len(digits) < len(span):
        held.append(7)
    if _KEY.match(span):
        held.append(8)
    if _ASSIGNED.match(span):
        held.append(9)
        # Words after a colon that a sentence goes on with.
        worded = _WORDED.search(span)
        if worded and ("\n" in worded[1] or not _LINE_END.match(text, end)):
            held.append(15)
    elif len(span) >= 8 and after_word:
        held.append(10)
    if not digits:
        held.append(11)
    if n_tokens > 1:
        held.append(12)
    if re.match(r"^[0-9]+[.,][0-9]+$", span):
        held.append(14)
    return held


Segment = tuple[int, int, Span, list[int]]


def segments(text: str, tokens: Sequence[Span]) -> Iterator[Segment]:
    """Candidates ``(first, after, span, features)`` of at most LONGEST tokens, with a trigger or behind a secret word."""
    for first in range(len(tokens)):
        before = text[tokens[first - 2][0] if first > 1 else tokens[0][0] : tokens[first][0]].rstrip()
        before = before.rstrip("\"'")
        after_word = bool(_ASSIGNS.search(before) and _SECRET_WORD.search(before))
        for after in range(first + 1, min(first + LONGEST, len(tokens)) + 1):
            start, end = trimmed(text, tokens[first][0], tokens[after - 1][1])
            if start < end and (after_word or _TRIGGER.search(text, start, end)):
                # A span starts in its first token and ends in its last.
                if start < tokens[first][1] and end > tokens[after - 1][0]:
                    yield first, after, (start, end), features(text, start, end, after - first, after_word)


# --- the model -------------------------------------------------------------------


def start_weights() -> np.ndarray:
    weights = np.zeros((len(KINDS), len(FEATURES)))
    for kind, named in START.items():
        for feature, value in named.items():
            weights[KINDS.index(kind), FEATURES.index(feature)] = value
    return weights


def decode(n_tokens: int, found: Iterable[Segment], weights: np.ndarray) -> list[tuple[int, Segment]]:
    """The best labelling: ``(kind, segment)`` from left to right.

    ``best[j]`` is the best score of tokens before ``j``, apart for whether an
    entity ends there, as following one directly has its price. Segments are read
    once, and those that cannot gain are not kept.
    """
    ending: list[list[tuple[float, int, Segment]]] = [[] for _ in range(n_tokens + 1)]
    for segment in found:
        scores = weights[:, segment[3]].sum(axis=1)
        kind = int(scores.argmax())
        if scores[kind] > 0:
            ending[segment[1]].append((float(scores[kind]), kind, segment))
    outside, inside = [0.0], [-math.inf]
    back: list = [None]
    came: list = [False]
    for j in range(1, n_tokens + 1):
        came.append(inside[j - 1] > outside[j - 1])
        outside.append(max(outside[j - 1], inside[j - 1]))
        best, choice = -math.inf, None
        for score, kind, segment in ending[j]:
            first = segment[0]
            whole = max(outside[first], inside[first] + FOLLOWS) + score
            if whole > best:
                best, choice = whole, (kind, segment, inside[first] + FOLLOWS > outside[first])
        inside.append(best)
        back.append(choice)
    chosen, j, entity = [], n_tokens, inside[n_tokens] > outside[n_tokens]
    while j > 0:
        if entity:
            kind, segment, entity = back[j]
            chosen.append((kind, segment))
            j = segment[0]
        else:
            entity = came[j]
            j -= 1
    return chosen[::-1]


def expected(n_tokens: int, found: Sequence[Segment], weights: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The log-partition and each segment's probability for every kind, by forward-backward sums."""
    starting: list[list[int]] = [[] for _ in range(n_tokens + 1)]
    ending: list[list[int]] = [[] for _ in range(n_tokens + 1)]
    scores = [weights[:, s[3]].sum(axis=1) for s in found]
    totals = [float(np.logaddexp.reduce(s)) for s in scores]
    for number, segment in enumerate(found):
        starting[segment[0]].append(number)
        ending[segment[1]].append(number)
    out, ins = [0.0], [-math.inf]
    for j in range(1, n_tokens + 1):
        out.append(float(np.logaddexp(out[j - 1], ins[j - 1])))
        parts = [np.logaddexp(out[found[k][0]], ins[found[k][0]] + FOLLOWS) + totals[k] for k in ending[j]]
        ins.append(float(np.logaddexp.reduce(parts)) if parts else -math.inf)
    total = float(np.logaddexp(out[-1], ins[-1]))
    # Backward from a boundary, given whether an entity ends there.
    after_out, after_in = [0.0] * (n_tokens + 1), [0.0] * (n_tokens + 1)
    for j in range(n_tokens - 1, -1, -1):
        parts = [totals[k] + after_in[found[k][1]] for k in starting[j]]
        entity = float(np.logaddexp.reduce(parts)) if parts else -math.inf
        after_out[j] = float(np.logaddexp(after_out[j + 1], entity))
        after_in[j] = float(np.logaddexp(after_out[j + 1], entity + FOLLOWS))
    chances = []
    for k, segment in enumerate(found):
        reach = np.logaddexp(out[segment[0]], ins[segment[0]] + FOLLOWS)
        chances.append(np.exp(scores[k] + reach + after_in[segment[1]] - total))
    return total, chances


def targets(text: str, found: Sequence[Segment]) -> dict[int, int]:
    """Kind of the segments that are certain: pattern spans and unmistakable secrets."""
    known = {span: KINDS.index(kind) for kind, spans in base_spans(text).items() for span in spans}
    certain: dict[int, int] = {}
    taken = 0
    for number, (first, after, span, held) in enumerate(found):
        kind = known.get(span)
        if kind is None and (8 in held or (9 in held and 15 not in held) or (10 in held and 7 in held)):
            kind = KINDS.index("secret")
        if kind is not None and first >= taken:
            certain[number] = kind
            taken = after
    return certain


def fit(sample: Sequence[str], rounds: int = 20, rate: float = 2.0, prior: float = 0.02) -> np.ndarray:
    """Weights by gradient ascent on the likelihood, drawn towards the starting weights."""
    start = start_weights()
    read = []
    for text in sample:
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        found = list(segments(text, tokens))
        if found:
            read.append((len(tokens), found, targets(text, found)))
    if not any(certain for _, _, certain in read):
        return start
    weights = start.copy()
    for _ in range(rounds):
        gradient = -prior * (weights - start)
        for n_tokens, found, certain in read:
            _, chances = expected(n_tokens, found, weights)
            for number, chance in enumerate(chances):
                want = -chance
                if number in certain:
                    want[certain[number]] += 1
                gradient[:, found[number][3]] += want[:, None] / len(read)
        weights += rate * gradient
    return weights


def sample_regions(documents: DataFrame, *, key: str = "doc_id", text: str = "text") -> list[str]:
    """The SAMPLE_REGIONS pieces of regions of least hash from SAMPLE_DOCUMENTS documents with a trigger.

    Tasks read the whole texts. Bounded, and the same in any order.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for h, content in zip(frame["h"], frame["text"]):
                yield pd.DataFrame([(h, *piece) for piece in pieces(content)], columns=["h", "start", "piece"])

    looked = thinned(documents, SAMPLE_LOOK, key, text).where(F.col(text).rlike(_TRIGGER.pattern))
    found = least(looked, SAMPLE_DOCUMENTS, key, text).mapInPandas(read, "h long, start long, piece string")
    few = found.orderBy(F.xxhash64("h", "start"), "h", "start", "piece").limit(SAMPLE_REGIONS).collect()
    return [row.piece for row in few]


def pieces(text: str) -> Iterator[tuple[int, str]]:
    """``(start, piece)``: regions cut after PIECE tokens, without pieces of over PIECE_CHARS characters."""
    for tokens in regions(text):
        for i in range(0, len(tokens), PIECE):
            start, end = tokens[i][0], tokens[min(i + PIECE, len(tokens)) - 1][1]
            if end - start <= PIECE_CHARS:
                yield start, text[start:end]


# --- spans of documents ------------------------------------------------------------


def model_spans(text: str, weights: np.ndarray) -> list[tuple[str, int, int]]:
    found = []
    for tokens in regions(text):
        for kind, segment in decode(len(tokens), segments(text, tokens), weights):
            found.append((KINDS[kind], *segment[2]))
    return found


def all_spans(text: str, weights: np.ndarray) -> tuple[dict[str, list[Span]], list[tuple[str, int, int]]]:
    """Pattern spans, and all spans in order: the model's go where no pattern's are."""
    base = base_spans(text)
    listed = [(kind, *span) for kind in base for span in base[kind]]
    taken = sorted((start, end) for _, start, end in listed)
    at, reach = 0, 0
    for kind, start, end in sorted(model_spans(text, weights), key=lambda s: s[1]):
        while at < len(taken) and taken[at][0] < end:
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= start:
            listed.append((kind, start, end))
    listed.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
    return base, listed


def _joined(spans: Sequence[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def find_private(documents: DataFrame, weights: np.ndarray, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the counts of the patterns, a digest of their spans, and all spans."""
    kind = documents.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_email long, n_ip long, n_card long, n_phone long, n_secret long, base_sha256 string, spans string"

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for content in frame["text"]:
                base, listed = all_spans(content or "", weights)
                told = _joined([(k, *span) for k in KINDS[:4] for span in base[k]])
                secrets = sum(k == "secret" for k, _, _ in listed)
                digest = hashlib.sha256(told.encode()).hexdigest()
                rows.append((*(len(base[k]) for k in KINDS[:4]), secrets, digest, _joined(listed)))
            names = ["n_email", "n_ip", "n_card", "n_phone", "n_secret", "base_sha256", "spans"]
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, key, frame["key"].array)
            yield out

    read = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return read.mapInPandas(search, schema)


def masked(text: str, spans: Sequence[tuple[str, int, int]]) -> str:
    """The text with ``<KIND>`` for each span; overlapping spans become one, named by the first."""
    parts, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*parts, text[at:]]) if parts else text


def mask_documents(
    documents: DataFrame, weights: np.ndarray, *, text: str = "text", length: str | None = "n_chars"
) -> DataFrame:
    """The documents with their private spans masked; ``length`` is set anew where text changed."""
    replace = F.pandas_udf(_masker(weights), T.StringType())
    whole = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    out = documents.select(whole, replace(F.col(text)).alias("masked"))
    own = lambda name: F.col(f"row.`{name}`")
    changes = {text: F.col("masked")}
    if length in documents.columns:
        changed = F.when(F.col("masked") != own(text), F.length("masked")).otherwise(own(length))
        changes[length] = changed.cast(documents.schema[length].dataType)
    return out.select(*[changes.get(c, own(c)).alias(c) for c in documents.columns])


def _masker(weights: np.ndarray):
    def replace(texts: pd.Series) -> pd.Series:
        def one(content):
            if content is None or not _TRIGGER.search(content):
                return content
            return masked(content, all_spans(content, weights)[1])

        return texts.map(one)

    replace.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return replace
