"""Papers packed into batches, and their classification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.answers import json_slice, parse_classification
from paperloom.functions.prompts import BATCH_TEMPLATE, MERGE_TEMPLATE, answer_budget, batch_prompt, paper_entry
from paperloom.functions.text import not_blank
from paperloom.operators.answer_store import AnswerStore
from paperloom.operators.categories import merge_categories
from paperloom.operators.enrich import Service, ask
from paperloom.operators.lookup import lookup
from paperloom.sources.durable import cut_lineage

# Results of papers the answer does not name or cannot be read for.
UNCLASSIFIED = "Unclassified"
PARSING_FAILED = "Classification parsing failed: "

CHAR_BUDGET = 20_000
CHUNK_ORDS = 1_000

BATCH_KEY = ["bucket", "batch"]


def prompt_batches(
    papers: DataFrame, budget: int = CHAR_BUDGET, chunk_ords: int = CHUNK_ORDS, bucket: str = "search_key"
) -> DataFrame:
    """Add ``bucket``, ``batch`` and the paper's prompt ``entry``.

    Batches follow the running number of characters of a bucket in ``ord`` order.
    The sum has two levels: characters per chunk of ``chunk_ords`` consecutive
    numbers are summed over chunks, and papers within their chunk. So no task sorts
    more than one chunk however large a bucket is, batches cross chunks, and the
    result does not depend on their size. Papers without a number go to chunks by
    hash, in front. Papers with a blank summary travel along without an entry.
    """
    entry = F.when(not_blank(F.col("llm_summary")), paper_entry(F.col("title"), F.col("llm_summary")))
    hashed = F.pmod(F.xxhash64("title", "llm_summary"), F.lit(1 << 10)) - (1 << 62)
    placed = (
        papers.withColumn("bucket", F.coalesce(F.col(bucket).cast("string"), F.lit("")))
        .withColumn("_chunk", F.coalesce(F.expr(f"ord div {chunk_ords}"), hashed))
        .withColumn("entry", entry)
        .withColumn("_size", F.coalesce(F.length("entry"), F.lit(0)).cast("bigint"))
    )
    chunks = Window.partitionBy("bucket").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("bucket", "_chunk").agg(F.sum("_size").alias("_sum"))
    before = sizes.select("bucket", "_chunk", F.coalesce(F.sum("_sum").over(chunks), F.lit(0)).alias("_before"))
    order = Window.partitionBy("bucket", "_chunk").orderBy("ord", "title").rowsBetween(Window.unboundedPreceding, 0)
    used = F.col("_before") + F.sum("_size").over(order)
    batch = F.greatest(F.expr(f"(_used - 1) div {budget}"), F.lit(0).cast("bigint"))
    summed = placed.join(before, ["bucket", "_chunk"]).withColumn("_used", used).withColumn("batch", batch)
    return summed.select(*papers.columns, "bucket", "entry", "batch")


def batch_context(batched: DataFrame) -> DataFrame:
    """Entries of each batch in order as one text; batches without any are left out."""
    return (
        batched.where(F.col("entry").isNotNull())
        .groupBy(*BATCH_KEY)
        .agg(
            F.count(F.lit(1)).alias("papers"),
            F.expr("array_join(transform(array_sort(collect_list(struct(ord, title, entry))), x -> x.entry), '')").alias(
                "papers_info"
            ),
        )
    )


def classification_prompts(
    context: DataFrame, words: Sequence[str], num_categories: int = 4, template: str = BATCH_TEMPLATE
) -> DataFrame:
    """Prompt and answer budget of each batch."""
    listed = F.array(*[F.lit(word) for word in words])
    prompt = batch_prompt(F.col("papers_info"), listed, num_categories, template)
    return context.select(*BATCH_KEY, prompt.alias("prompt")).withColumn("max_tokens", answer_budget(F.col("prompt")))


def ask_batches(
    prompts: DataFrame, service: Service, parallelism: int | None = None, store: AnswerStore | None = None
) -> DataFrame:
    """Answers of all batches."""
    return ask(prompts, "prompt", service, parallelism, ["max_tokens"], store)


def classify_papers(
    papers: DataFrame,
    service: Service,
    words: Sequence[str],
    num_categories: int = 4,
    template: str = BATCH_TEMPLATE,
    budget: int = CHAR_BUDGET,
    chunk_ords: int = CHUNK_ORDS,
    bucket: str = "search_key",
    parallelism: int | None = None,
    merge_template: str = MERGE_TEMPLATE,
    store: AnswerStore | None = None,
) -> DataFrame:
    """Add ``category`` from one call per batch, and more calls that merge the batches' categories.

    Titles are matched within the whole bucket, whichever batch named them first, and
    categories of several batches are brought to one set (see ``merge_categories``).
    A title no answer names is ``Unclassified``; an unreadable answer marks the
    papers sent in it only; a bucket with no summary at all gets the empty string.
    """
    batched = prompt_batches(papers, budget, chunk_ords, bucket)
    prompts = classification_prompts(batch_context(batched), words, num_categories, template)
    answers = ask_batches(prompts, service, parallelism, store)
    parsed = parse_classification(json_slice(F.coalesce("result", F.lit(""))))
    problem = F.coalesce("error", F.lit("no valid JSON"))
    read = cut_lineage(answers.select(*BATCH_KEY, parsed.alias("parsed"), problem.alias("problem")), "answers")
    found = read.select(*BATCH_KEY, F.explode("parsed.categories").alias("category", "about"))
    named = read.select("bucket", "batch", F.explode("parsed.classifications").alias("title", "named"))
    used = named.select(*BATCH_KEY, F.col("named").alias("category"), F.lit(None).cast("string").alias("about"))
    merged = merge_categories(
        found.unionByName(used).where(F.col("category").isNotNull()),
        service, num_categories, template=merge_template, parallelism=parallelism, store=store,
    )
    named = named.groupBy("bucket", "title").agg(F.min_by("named", "batch").alias("named"))
    # One key for title and bucket, so that frequent titles are split.
    key = F.to_json(F.struct("bucket", F.coalesce("title", F.lit("")).alias("title")))
    named = named.join(merged.withColumnRenamed("category", "named"), ["bucket", "named"], "left")
    table = named.select(key.alias("_named_key"), F.coalesce("merged", "named").alias("named"))
    found = lookup(batched.withColumn("_named_key", key), table, "_named_key", ["ord"])
    failed = read.where(~F.col("parsed.ok")).select(*BATCH_KEY, F.col("problem").alias("_problem"))
    sent = read.select("bucket", F.lit(True).alias("_sent")).distinct()
    marked = found.join(failed, BATCH_KEY, "left").join(sent, "bucket", "left")
    category = (
        F.when(F.col("_sent").isNull(), "")
        .when(F.col("named").isNotNull(), F.col("named"))
        .when(F.col("entry").isNotNull() & F.col("_problem").isNotNull(), F.concat(F.lit(PARSING_FAILED), F.col("_problem")))
        .otherwise(F.lit(UNCLASSIFIED))
    )
    return marked.select(*papers.columns, category.alias("category"))


def assign_category(
    papers: DataFrame, classification: DataFrame, keys: Sequence[str] = ("ord",)
) -> DataFrame:
    """Category by exact title from ``classification(title, category)``.

    The table is first brought to one row per title.
    """
    per_title = classification.groupBy("title").agg(F.max("category").alias("category"))
    found = lookup(papers, per_title, "title", spread_by=keys)
    return found.select(*papers.columns, F.coalesce("category", F.lit(UNCLASSIFIED)).alias("category"))


def category_counts(categorized: DataFrame) -> DataFrame:
    return categorized.groupBy("category").agg(F.count(F.lit(1)).alias("papers"))


def described_categories(parsed: DataFrame, *keys: str, column: str = "parsed") -> DataFrame:
    """One row per category of each answer: name, description, number of them."""
    categories = F.col(column)["categories"]
    return parsed.select(
        *keys, F.size(categories).alias("num_categories"), F.explode(categories).alias("category", "description")
    )
