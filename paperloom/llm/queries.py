"""The operators as queries over their whole tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import dialogue, hamming, language, main_text, mixing, ngram_join, packing, periodic, private, quality
from paperloom.llm import repeats, revisits, simhash

Run = Callable[[SparkSession, str], DataFrame]


def _over(table: str, operator: Callable[[DataFrame], DataFrame]) -> Run:
    return lambda spark, sf_dir: operator(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def _private(documents: DataFrame) -> DataFrame:
    return private.find_private(documents, private.fit(private.sample_regions(documents)))


def _main_text(pages: DataFrame) -> DataFrame:
    return main_text.extract(pages, main_text.fit(main_text.sample(pages)))


QUERIES: dict[str, Run] = {
    "op1_multi_index_hashing": _over("embeddings", hamming.neighbours_query),
    "op2_ngram_jaccard_join": _over("documents", ngram_join.groups),
    "op3_suffix_dedup": _over("documents", lambda documents: repeats.remove_repeats(documents).drop("kept")),
    "op4_best_fit_packing": _over("documents", packing.pack),
    "op5_poisson_mixing": _over("documents", mixing.mix),
    "op6_revisit_resolution": _over("pages", revisits.revisits_query),
    "op7_private_spans": _over("documents", _private),
    "op8_language_filters": _over("documents", language.language_query),
    "op9_main_text_cut": _over("pages", _main_text),
    "op10_quality_ledger": _over("documents", quality.rules_query),
    "op11_periodic_runs": _over("documents", periodic.runs_query),
    "op12_conversation_repair": _over("conversations", dialogue.repair_query),
    "op13_deletion_simhash": _over("documents", simhash.groups),
}

SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": ngram_join.JOIN_SQL,
    "op5_poisson_mixing": mixing.MIX_SQL,
    "op6_revisit_resolution": revisits.REVISITS_SQL,
    "op10_quality_ledger": quality.RULES_SQL,
    "op11_periodic_runs": periodic.RUNS_SQL,
    "op12_conversation_repair": dialogue.REPAIR_SQL,
}
