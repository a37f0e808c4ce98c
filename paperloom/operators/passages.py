"""Best passages of each document for each question, by BM25."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.sources.durable import cut_lineage

K1, B = 1.2, 0.75


def question_terms(question: str) -> list[str]:
    """Distinct lower-case words of a question, in order."""
    words = re.split(r"[\W_]+", question.lower())
    return list(dict.fromkeys(word for word in words if word))


def qa_passages(pages: DataFrame, questions: Sequence[str], top_k: int = 1) -> DataFrame:
    """``(doc_id, q_idx, rank, page_no, score)``: best pages of each document.

    Pages are counted against the question words in place, so page text is
    never shuffled, and the counts are kept, so text is cut into words only once
    for the corpus figures and the scores. The figures are one aggregate with a
    fixed number of columns. Only ids and scores reach the ranking, and of those each partition
    sends on ``top_k`` per document and question. Equal scores go by page
    number. Pages sharing no word with the question score 0.
    """
    asked = [question_terms(question) for question in questions]
    terms = sorted({term for words in asked for term in words})
    if not terms:
        raise ValueError("the questions hold no words")
    listed = F.array(*[F.lit(term) for term in terms])
    tokens = F.filter(F.split(F.lower(F.col("text")), r"[^\p{L}\p{N}]+"), lambda token: token != "")
    cut = pages.select("doc_id", "page_no", tokens.alias("tokens"))
    kept = cut.select(
        "doc_id",
        "page_no",
        F.size("tokens").alias("length"),
        F.filter("tokens", lambda token: token.isin(terms)).alias("found"),
    )
    frequency = F.transform(listed, lambda term: F.size("found") - F.size(F.array_remove("found", term)))
    counted = cut_lineage(kept.select("doc_id", "page_no", "length", frequency.alias("tf")), "passage-counts")
    corpus = counted.agg(
        F.struct(
            F.count(F.lit(1)).cast("double").alias("pages"),
            F.avg("length").alias("avg_length"),
            F.array(*[F.count_if(F.get("tf", F.lit(place)) > 0) for place in range(len(terms))]).alias("df"),
        )
    ).scalar()
    stated = counted.select("doc_id", "page_no", "length", "tf", corpus.alias("corpus"))

    def weight(tf: Column, df: Column) -> Column:
        idf = F.log((F.col("corpus.pages") - df + 0.5) / (df + 0.5) + 1.0)
        norm = (F.col("length") / F.col("corpus.avg_length") * B + (1 - B)) * K1
        return F.when(tf > 0, idf * tf * (K1 + 1) / (tf + norm)).otherwise(0.0)

    weighted = stated.select("doc_id", "page_no", F.zip_with("tf", "corpus.df", weight).alias("weights"))
    scores = []
    for words in asked:
        parts = [F.get("weights", F.lit(terms.index(word))) for word in words]
        scores.append(F.round(reduce(Column.__add__, parts) if parts else F.lit(0.0), 6))
    scored = weighted.select("doc_id", "page_no", F.posexplode(F.array(*scores)).alias("pos", "score"))
    order = Window.partitionBy("doc_id", "q_idx").orderBy(F.desc("score"), "page_no")
    return (
        scored.select("doc_id", "page_no", (F.col("pos") + 1).alias("q_idx"), "score")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top_k)
        .select("doc_id", "q_idx", "rank", "page_no", "score")
    )
