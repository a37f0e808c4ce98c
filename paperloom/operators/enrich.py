"""Calls to a service through a function the caller supplies."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.answers import parse_translation
from paperloom.functions.text import not_blank
from paperloom.operators.answer_store import AnswerStore, request_key
from paperloom.operators.lookup import lookup
from paperloom.sources.durable import cut_lineage

# Messages put into result columns.
TRANSLATION_FAILED = "Translation failed: "
CALL_FAILED = "API call failed: "

Service = Callable[[], Callable[..., str]]


def _accepted(send: Callable[..., str], names: Sequence[str]) -> list[str]:
    """Those of ``names`` the function has a parameter for."""
    try:
        parameters = inspect.signature(send).parameters.values()
    except (TypeError, ValueError):
        return []
    if any(parameter.kind is parameter.VAR_KEYWORD for parameter in parameters):
        return list(names)
    known = {parameter.name for parameter in parameters}
    return [name for name in names if name in known]


def ask(
    requests: DataFrame,
    payload: str,
    service: Service,
    parallelism: int | None = None,
    columns: Sequence[str] = (),
    store: AnswerStore | None = None,
    **options: object,
) -> DataFrame:
    """``requests`` plus ``result`` and ``error`` of one call per row.

    ``service`` is called once per task and returns the function that takes the
    payload; clients and waiting belong in there. The function gets the
    ``columns`` of the row and the ``options``, such as an answer budget or a
    language, by name where it has a parameter for them. An exception stays in
    its row. ``parallelism`` caps the calls in flight.

    Answers are checkpointed: they may cost money and differ from call to call,
    so a lost executor must not lead to asking again. With a ``store`` they are
    kept for later runs, and what it has is not asked again.
    """
    if store is None:
        spread = requests if parallelism is None else requests.repartition(parallelism)
        return cut_lineage(_called(spread, payload, service, columns, options))
    tasks = parallelism or requests.sparkSession.sparkContext.defaultParallelism
    key = request_key(F.col(payload), columns, options)
    kept = cut_lineage(requests.withColumn("request", key), "requests")

    def call(rows: DataFrame) -> DataFrame:
        return _called(rows.repartition(tasks), payload, service, columns, options)

    return cut_lineage(store.complete(kept, call).select(*requests.columns, "result", "error"), "answered")


def _called(
    requests: DataFrame, payload: str, service: Service, columns: Sequence[str], options: dict[str, object]
) -> DataFrame:
    """``requests`` plus ``result`` and ``error``, not yet written."""
    schema = T.StructType(
        [*requests.schema.fields, T.StructField("result", T.StringType()), T.StructField("error", T.StringType())]
    )

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        send = service()
        own = _accepted(send, columns)
        shared = {name: options[name] for name in _accepted(send, list(options))}

        def one(text: str, given: dict) -> tuple[str | None, str | None]:
            try:
                return send(text, **shared, **given), None
            except Exception as problem:  # noqa: BLE001 - reported in the row
                return None, str(problem)

        for batch in batches:
            given = batch[own].to_dict("records") if own else [{}] * len(batch)
            replies = [one(text, values) for text, values in zip(batch[payload], given)]
            yield batch.assign(
                result=pd.Series([result for result, _ in replies], dtype=object, index=batch.index),
                error=pd.Series([error for _, error in replies], dtype=object, index=batch.index),
            )

    return requests.mapInPandas(call, schema)


def enrich(
    rows: DataFrame,
    payload: Column,
    service: Service,
    spread_by: Sequence[str],
    parallelism: int | None = None,
    store: AnswerStore | None = None,
    **options: object,
) -> DataFrame:
    """``rows`` plus ``answer`` and ``answer_error``; equal payloads are asked once.

    ``store`` and ``options`` are those of ``ask``. A NULL payload is not sent and gets NULLs; such rows get a key of their own
    that meets nothing, so any number of them spreads evenly. Payloads can be
    whole prompts, so rows and answers meet on a 256-bit hash. The copies of each
    payload are counted while they are merged.
    """
    keyed = rows.withColumn("request_key", F.sha2(payload, 256))
    requests = (
        keyed.select("request_key", payload.alias("payload"))
        .groupBy("request_key")
        .agg(F.first("payload").alias("payload"), F.count(F.lit(1)).alias("_n"))
    )
    sent = requests.where(F.col("request_key").isNotNull())
    answered = ask(sent, "payload", service, parallelism, store=store, **options)
    answers = answered.select(
        "request_key", F.col("result").alias("answer"), F.col("error").alias("answer_error")
    )
    counts = answered.select(F.xxhash64("request_key").alias("_key"), "_n")
    unsent = F.when(F.col("request_key").isNull(), F.concat(F.lit("-"), F.xxhash64(*spread_by).cast("string")))
    spread = keyed.withColumn("request_key", F.coalesce("request_key", unsent))
    return lookup(spread, answers, "request_key", spread_by, counts=counts).drop("request_key")


def translate_abstracts(
    papers: DataFrame,
    service: Service,
    keys: Sequence[str] = ("ord",),
    parallelism: int | None = None,
    language: str = "zh-cn",
    store: AnswerStore | None = None,
) -> DataFrame:
    """Add ``abstract_translate``; blank abstracts give the empty string.

    The service is told the ``language`` and returns the raw answer, nested
    arrays with the translated segments first.
    """
    text = F.when(not_blank(F.col("abstract")), F.col("abstract"))
    answered = enrich(papers, text, service, keys, parallelism, store, language=language)
    translated = parse_translation(F.col("answer"), F.col("abstract"))
    message = F.concat(F.lit(TRANSLATION_FAILED), F.coalesce("answer_error", F.lit("unreadable answer")))
    return answered.select(
        *papers.columns,
        F.when(text.isNull(), "").otherwise(F.coalesce(translated, message)).alias("abstract_translate"),
    )
