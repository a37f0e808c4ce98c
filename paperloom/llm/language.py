"""Language identification by a bit-sliced Bloom filter over n-grams.

All n-grams of every language are kept, and marked if they make up at least
``SHARE`` of its n-grams. All languages share one Bloom filter whose rows are
language bitmasks, one for the n-grams and one for the marked ones: the AND of an
n-gram's rows gives every language that (probably) holds it at once. A text's
popcounts per language are corrected for the filter's false positives. The language
with the largest sum of both corrected shares of the text's n-grams wins, as in much
text any language has most n-grams once; its score is the share of all n-grams.

N-grams are counted per batch in the tasks and summed by key, so what is
shuffled is bounded by the n-grams of a batch, not by the text; the n-grams of
one language, which may have most documents, spread over all keys. The filter
has LOAD rows for each n-gram of the language that has most, ROWS at least, and
MASKS masks of 64 bits in all at most. Its bit slices are put together in the tasks:
n-grams become masks of filter rows there, which are OR-ed by key. Only the masks, two
longs each, come to the driver and go on by broadcast, so both are bounded whatever
the number of n-grams. All n-grams are in the filter also where it has reached its
largest size; it is wrong more often then, which the correction takes out of the shares.

Defined results: a null text or one without a letter is ``und`` with score 0;
so is every text if nothing was learned. A text with letters and no known n-gram
gets the language with most learned documents, score 0. Ties go to the language
with more learned documents, then to the lesser name. Repeated rows each count
and get a row. Null languages and null ids are not learned from. Only id, text
and language are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.sources.durable import cut_lineage

UNKNOWN = "und"
#: Least share of a language's n-grams an n-gram must have to be marked.
SHARE = 1e-4
#: Letters of an n-gram; a word's edge counts as a letter. Three fit in one long.
N = 3
#: Least rows of the filter, most masks, both powers of two, rows per n-gram, and rows an n-gram is spread over.
ROWS = 1 << 20
MASKS = 1 << 24
LOAD = 8
PROBES = 3
BITS = 21


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def _runs(texts: list[str], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Places of texts of about ``size`` characters together, so that little is in memory at once."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > size:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-grams of the texts as longs, the text of each, and which texts have a letter."""
    joined = np.frombuffer(("\n".join(["", *texts, ""])).lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    # Lower-casing can lengthen a text, so ends are found again, one newline per text.
    lengths = np.fromiter((len(t.lower()) for t in texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(lengths + 1)
    starts = ends - lengths
    letter = _letters()[joined]
    codes = np.where(letter, joined, 0).astype(np.int64)
    has = np.add.reduceat(letter.astype(np.int64), starts)[: len(texts)] > 0 if len(texts) else np.zeros(0, bool)
    # Runs of non-letters become one edge.
    keep = letter | np.r_[True, letter[:-1]]
    where = np.flatnonzero(keep)
    short = codes[where]
    if len(short) < N:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), has
    gram = (short[:-2] << (2 * BITS)) | (short[1:-1] << BITS) | short[2:]
    real = short[1:-1] > 0
    owner = np.searchsorted(ends, where[1:-1][real], side="right")
    return gram[real], owner, has


def learned_rows(documents: DataFrame, *, key: str = "doc_id") -> Column:
    """Rows a query may learn from: two thirds of the ids, by check sum."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) != 1


def count_grams(documents: DataFrame, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, gram, n)`` over all given documents."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            names, numbers = np.unique(frame["lang"].to_numpy(dtype=str), return_inverse=True)
            texts, parts = frame["text"].tolist(), []
            for start, end in _runs(texts):
                gram, owner, _ = grams(texts[start:end])
                spoken = numbers[start:end][owner]
                for number in np.unique(spoken):
                    values, counts = np.unique(gram[spoken == number], return_counts=True)
                    parts.append(pd.DataFrame({"lang": names[number], "gram": values, "n": counts}))
            if parts:
                yield pd.concat(parts).groupby(["lang", "gram"], as_index=False)["n"].sum()

    read = documents.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    read = read.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counted = read.mapInPandas(count, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(gram: np.ndarray, rows: int = ROWS) -> list[np.ndarray]:
    """The filter rows of each n-gram."""
    value = _mix(gram.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    step = _mix(value) | np.uint64(1)
    return [((value + np.uint64(i) * step) & np.uint64(rows - 1)).astype(np.int64) for i in range(PROBES)]


@dataclass(frozen=True)
class Filter:
    """``masks`` is rows x words of 64 bits: one for each language, in order of preference, then one for its marked n-grams."""

    languages: tuple[str, ...]
    masks: np.ndarray

    def false_positives(self) -> np.ndarray:
        """Per bit, how often an n-gram that lacks it seems to have it."""
        bits = (self.masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1) for i in range(2 * len(self.languages)))
        return np.array([float(b.mean()) ** PROBES for b in bits])


def _size(most: int, bits: int) -> tuple[int, int]:
    """Rows of the filter and masks in a row, for ``most`` n-grams in one language."""
    words = max(1, -(-bits // 64))
    wanted = max(ROWS, 1 << (LOAD * most - 1).bit_length()) if most else ROWS
    return min(wanted, 1 << (MASKS // words).bit_length() - 1), words


def _slices(bit: np.ndarray, gram: np.ndarray, rows: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the masks that are not zero, counted through all rows, and the masks, as longs,
    for bit ``bit[i]`` set in the rows of ``gram[i]``."""
    slot = np.concatenate([places * words + bit // 64 for places in _places(gram, rows)])
    mask = np.tile(np.uint64(1) << (bit % 64).astype(np.uint64), PROBES)
    order = np.argsort(slot, kind="stable")
    slot, mask = slot[order], mask[order]
    first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, np.int64)
    return slot[first], np.bitwise_or.reduceat(mask, first).view(np.int64) if len(slot) else np.zeros(0, np.int64)


def _dense(slot: np.ndarray, mask: np.ndarray, rows: int, words: int) -> np.ndarray:
    masks = np.zeros(rows * words, dtype=np.uint64)
    masks[slot] = mask.view(np.uint64)
    return masks.reshape(rows, words)


Grams = Iterable[tuple[str, int | np.ndarray]]


def build(kept: Grams, languages: list[str], marked: Grams = ()) -> Filter:
    """The filter of ``(language, n-gram or array of them)`` at hand; see ``learn`` for those of a table."""
    held: list[list[np.ndarray]] = [[] for _ in range(2 * len(languages))]
    number = {name: i for i, name in enumerate(languages)}
    for first, pairs in ((0, kept), (len(languages), marked)):
        for name, gram in pairs:
            held[first + number[name]].append(np.atleast_1d(np.asarray(gram, dtype=np.int64)))
    sizes = [sum(map(len, parts)) for parts in held]
    rows, words = _size(max(sizes, default=0), len(held))
    every = [gram for parts in held for gram in parts]
    gram = np.concatenate(every) if every else np.zeros(0, np.int64)
    bit = np.repeat(np.arange(len(held)), sizes)
    return Filter(tuple(languages), _dense(*_slices(bit, gram, rows, words), rows, words))


def bit_slices(numbered: DataFrame, rows: int, words: int) -> DataFrame:
    """``(slot, mask)`` of ``(bit, gram)``: the masks of the filter that are not zero."""

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            slot, mask = _slices(frame["bit"].to_numpy(np.int64), frame["gram"].to_numpy(np.int64), rows, words)
            yield pd.DataFrame({"slot": slot, "mask": mask})

    filled = numbered.mapInPandas(fill, "slot long, mask long")
    return filled.groupBy("slot").agg(F.bit_or("mask").alias("mask"))


def learn(documents: DataFrame, *, text: str = "text", lang: str = "lang", share: float = SHARE) -> Filter:
    """Counts n-grams and fills the filter in Spark; one row per language and the masks come to the driver."""
    # Totals beside the counts: a window over a language would put all its n-grams in one task.
    counted = cut_lineage(count_grams(documents, text=text, lang=lang), "grams")
    per_language = counted.groupBy("lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("grams")).collect()
    totals = {row["lang"]: row["n"] for row in per_language}
    sizes = {
        row["lang"]: row["n"]
        for row in documents.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
        .groupBy(F.col(lang).cast("string").alias("lang"))
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    }
    if not sizes:
        return Filter((), np.zeros((ROWS, 1), dtype=np.uint64))
    languages = sorted(sizes, key=lambda name: (-sizes[name], name))
    number, least = F.lit(-1), F.lit(0.0)
    for i, name in enumerate(languages):
        number = F.when(F.col("lang") == name, F.lit(i)).otherwise(number)
        least = F.when(F.col("lang") == name, F.lit(totals.get(name, 0) * share)).otherwise(least)
    rows, words = _size(max((row["grams"] for row in per_language), default=0), 2 * len(languages))
    marked = F.when(F.col("n") >= least, number + len(languages))
    bits = F.explode(F.array_compact(F.array(number, marked)))
    held = bit_slices(counted.select(bits.alias("bit"), "gram"), rows, words).toArrow()
    slot, mask = (held.column(c).to_numpy() for c in ("slot", "mask"))
    return Filter(tuple(languages), _dense(slot, mask, rows, words))


def identify(documents: DataFrame, model: Filter, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, lang_pred, score)`` for every document."""
    shared = documents.sparkSession.sparkContext.broadcast((model.languages, model.masks, model.false_positives()))

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        languages, masks, wrong = shared.value

        def told(texts: list[str]) -> tuple[list[str], np.ndarray]:
            gram, owner, has = grams(texts)
            rows = _places(gram, len(masks))
            held = masks[rows[0]]
            for more in rows[1:]:
                held &= masks[more]
            total = np.bincount(owner, minlength=len(texts))
            shares = np.zeros((len(texts), 2 * max(1, len(languages))))
            seen = np.zeros(len(texts), dtype=bool)
            for i in range(2 * len(languages)):
                bit = (held[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
                hits = np.bincount(owner, weights=bit.astype(np.float64), minlength=len(texts))
                shares[:, i] = (hits - total * wrong[i]) / np.maximum(total, 1) / (1 - wrong[i])
                seen |= hits > 0
            shares[~seen] = 0
            every, marked = np.hsplit(shares, 2)
            best = np.argmax(np.round(every + marked, 12), axis=1)  # the first of equals is preferred
            known = has & (len(languages) > 0)
            names = [languages[b] if k else UNKNOWN for b, k in zip(best, known)]
            return names, np.where(known, np.clip(every[np.arange(len(texts)), best], 0, 1), 0.0)

        for frame in frames:
            texts = [t if isinstance(t, str) else "" for t in frame["text"]]
            parts = [told(texts[start:end]) for start, end in _runs(texts)]
            yield pd.DataFrame(
                {
                    key: frame["key"].array,
                    "lang_pred": [name for names, _ in parts for name in names],
                    "score": np.concatenate([scores for _, scores in parts]) if parts else np.zeros(0),
                }
            )

    kind = documents.schema[key].dataType.simpleString()
    read = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return read.mapInPandas(decide, f"`{key}` {kind}, lang_pred string, score double")


def language_query(documents: DataFrame) -> DataFrame:
    """Learns from the learned rows, then names the language of every document."""
    model = learn(documents.where(learned_rows(documents)))
    held_out = F.coalesce(~learned_rows(documents), F.lit(False))
    return identify(documents.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )
