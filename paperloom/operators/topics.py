"""Grouping of documents by their words."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.sources.durable import cut_lineage

# Places words are hashed to, and times the centers are moved.
FEATURES = 1 << 14
ROUNDS = 5
# Vectors have this length; weights are whole numbers, so that sums of them do not
# depend on their order.
LENGTH = 1_000_000


def words(text: Column) -> Column:
    """Lower-case words of a text; none for NULL."""
    cut = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(cut, lambda word: word != "")


def _document_counts(cut: DataFrame) -> DataFrame:
    """``(word, docs)``: documents each word is in, pre-aggregated in each partition."""
    return cut.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("docs"))


def _weight(n: Column, docs: Column, total: int) -> Column:
    return n * F.log((F.lit(total) + 1.0) / (docs + 1.0))


def word_weights(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(word, n, docs, weight)``: TF-IDF of every word over all documents."""
    cut = cut_lineage(docs.select(words(F.col(text)).alias("words")), "words")
    used = cut.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    weight = _weight(F.col("n"), F.col("docs"), cut.count())
    return used.join(_document_counts(cut), "word").select("word", "n", "docs", weight.alias("weight"))


def _counted(docs: DataFrame, key: str, features: int) -> DataFrame:
    """``(key, words, vector)``: each word of a document with its number, and their places and numbers.

    Words are sorted in their row and counted by their runs, so nothing is shuffled.
    The place of a word is the first seven hex digits of its MD5; words may share one.
    """
    cut = docs.select(key, F.sort_array(words(F.col("text"))).alias("sorted"), F.lit(0).alias("zero"))
    last = F.size("sorted") - 1
    begins = F.filter(
        F.when(last >= 0, F.sequence("zero", last)).otherwise(F.array().cast("array<int>")),
        lambda i: (i == 0) | (F.get("sorted", i) != F.get("sorted", i - 1)),
    )
    runs = cut.select(key, "sorted", begins.alias("begins"))
    count = F.transform(
        "begins",
        lambda begin, i: F.struct(
            F.get("sorted", begin).alias("word"),
            (F.coalesce(F.get("begins", i + 1), F.size("sorted")) - begin).alias("n"),
        ),
    )
    counts = runs.select(key, count.alias("words"))
    place = F.transform(
        "words", lambda e: (F.conv(F.substring(F.md5(e["word"]), 1, 7), 16, 10).cast("bigint") % features).cast("int")
    )
    return counts.select(key, "words", F.struct(place.alias("places"), F.col("words.n").alias("counts")).alias("vector"))


def _slices(vectors: pd.DataFrame, entries: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """Rows of about so many entries together, so that little is in memory at once."""
    ends = np.cumsum(np.fromiter((len(each) for each in vectors["places"]), dtype=np.int64, count=len(vectors)))
    start = 0
    while start < len(vectors):
        held = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, held + entries, side="right")))
        yield vectors.iloc[start:end]
        start = end


def _weighed(vectors: pd.DataFrame, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, place and whole-number weight of each entry, and which vectors have a length."""
    features = len(idf)
    sizes = np.fromiter((len(each) for each in vectors["places"]), dtype=np.int64, count=len(vectors))
    entry = np.repeat(np.arange(len(vectors)) * features, sizes)
    entry += np.concatenate([np.zeros(0, np.int64), *vectors["places"]]).astype(np.int64)
    entry, of = np.unique(entry, return_inverse=True)
    n = np.bincount(of, weights=np.concatenate([np.zeros(0, np.int64), *vectors["counts"]]), minlength=len(entry))
    owner, place = entry // features, entry % features
    weight = n * idf[place]
    norm = np.sqrt(np.bincount(owner, weights=weight * weight, minlength=len(vectors)))
    scaled = np.rint(LENGTH * weight / np.where(norm > 0, norm, 1.0)[owner]).astype(np.int64)
    return owner, place, scaled, norm > 0


def _products(vectors: pd.DataFrame, idf: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner product of each vector with each center, and which vectors have a length.

    At most the square of ``LENGTH``, so doubles hold the sums exactly.
    """
    owner, place, weight, real = _weighed(vectors, idf)
    products = [np.bincount(owner, weights=weight * center[place], minlength=len(vectors)) for center in centers]
    return np.array(products).reshape(len(centers), len(vectors)).T.astype(np.int64), real


def _seeds(kept: DataFrame, key: str, idf: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Documents far from each other: each next one has the least greatest product
    with those before, ties by a hash of its key. One row per pass comes back."""
    features = len(idf)
    centers = np.zeros((0, features), dtype=np.int64)
    while len(centers) < k:
        chosen = centers

        @F.pandas_udf("long")
        def nearness(vectors: pd.DataFrame) -> pd.Series:
            found = [pd.Series([], dtype="Int64")]
            for few in _slices(vectors):
                products, real = _products(few, idf, chosen)
                found.append(pd.Series(products.max(axis=1, initial=0)).where(real).astype("Int64"))
            return pd.concat(found, ignore_index=True)

        digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
        ranked = kept.select(nearness("vector").alias("near"), digest.alias("digest"), "vector").where("near is not null")
        least = ranked.agg(F.min(F.struct("near", "digest", "vector"))).scalar()
        row = kept.sparkSession.range(1).select(least.alias("least")).first().least
        if row is None:  # no document has a word that others lack
            return np.zeros((k, features), dtype=np.int64)
        _, place, weight, _ = _weighed(pd.DataFrame([row.vector.asDict()]), idf)
        center = np.zeros(features, dtype=np.int64)
        center[place] = weight
        centers = np.vstack([centers, center])
    return centers


def _moved(kept: DataFrame, idf: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The mean directions of the documents nearest to each center; one without documents stays."""
    k, features = centers.shape

    def sums(frames):
        total = np.zeros((k, features), dtype=np.int64)
        for frame in chain.from_iterable(map(_slices, frames)):
            cluster = _products(frame, idf, centers)[0].argmax(axis=1)
            owner, place, weight, _ = _weighed(frame, idf)
            added = np.bincount(cluster[owner] * features + place, weights=weight, minlength=k * features)
            total += added.astype(np.int64).reshape(k, features)
        cluster, place = np.nonzero(total)
        yield pd.DataFrame({"cluster": cluster, "place": place, "total": total[cluster, place]})

    added = kept.select("vector.*").mapInPandas(sums, "cluster int, place int, total long")
    added = added.groupBy("cluster", "place").agg(F.sum("total").alias("total")).toPandas()
    total = np.zeros((k, features))
    total[added["cluster"], added["place"]] = added["total"]
    norm = np.sqrt((total * total).sum(axis=1, keepdims=True))
    return np.where(norm > 0, np.rint(LENGTH * total / np.where(norm > 0, norm, 1.0)).astype(np.int64), centers)


def _names(clustered: DataFrame, documents: int, top: int = 3) -> DataFrame:
    """``(cluster, topic)``: the heaviest words of each cluster, from one pass over counted words."""
    used = clustered.select("cluster", F.inline("words")).groupBy("cluster", "word")
    used = used.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))
    # At most one entry per cluster.
    per_word = used.groupBy("word").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("cluster", "n")).alias("uses"))
    scored = per_word.select("word", "docs", F.inline("uses"))
    scored = scored.select("cluster", "word", F.round(_weight(F.col("n"), F.col("docs"), documents), 6).alias("weight"))
    order = Window.partitionBy("cluster").orderBy(F.desc("weight"), "word")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.groupBy("cluster").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(rank, word))), x -> x.word), ' ')").alias("topic")
    )


def topic_clusters(
    docs: DataFrame,
    num_categories: int = 4,
    seed: int = 42,
    features: int = FEATURES,
    key: str = "doc_id",
    rounds: int = ROUNDS,
) -> DataFrame:
    """``(key, cluster, topic)``: spherical k-means over hashed TF-IDF, named by the
    three heaviest words of each cluster.

    Every word counts: words are hashed to ``features`` places, so there is no
    vocabulary to learn, and the centers and document counts per place, the only
    things that come to the driver, have a fixed size. Weights are whole numbers:
    the same documents give the same clusters however they lie in partitions.
    Centers start from documents far from each other. The nearest center has the
    largest product, ties to the smaller number; documents without a word that
    others lack are in cluster 0. A cluster without words has an empty name.
    """
    # Kept, so that the passes below do not cut the texts into words again.
    kept = cut_lineage(_counted(docs, key, features), "words")
    total = kept.count()
    spread_over = kept.select(F.explode(F.array_distinct("vector.places")).alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    found = spread_over.toPandas()
    held = np.zeros(features)
    held[found["place"]] = found["n"]
    idf = np.log((total + 1.0) / (held + 1.0))
    centers = _seeds(kept, key, idf, num_categories, seed)
    for _ in range(rounds):
        centers = _moved(kept, idf, centers)

    @F.pandas_udf("int")
    def nearest(vectors: pd.DataFrame) -> pd.Series:
        found = [_products(few, idf, centers)[0].argmax(axis=1) for few in _slices(vectors)]
        return pd.Series(np.concatenate([np.zeros(0, np.int64), *found]))

    clustered = cut_lineage(kept.select(key, "words", nearest("vector").alias("cluster")), "clusters")
    # One row per cluster, of which there are num_categories.
    named = clustered.join(F.broadcast(_names(clustered, total)), "cluster", "left")
    return named.select(key, "cluster", F.coalesce("topic", F.lit("")).alias("topic"))
