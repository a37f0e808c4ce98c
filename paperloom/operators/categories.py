"""One set of categories for a search out of those its batches came up with.

Names of all batches go up a tree of merge calls: those of a bucket are dealt by hash
to prompts of about ``fan`` names, each call names at most ``num_categories`` groups
for them, and the groups go on to the next round until one prompt holds a bucket's.
Which batch named what plays no part, so the order of batches changes nothing, and a
call that fails or cannot be read leaves its names as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.answers import json_slice
from paperloom.functions.prompts import MERGE_TEMPLATE, answer_budget
from paperloom.functions.text import fill_template, not_blank, strip
from paperloom.operators.answer_store import AnswerStore
from paperloom.operators.enrich import Service, ask
from paperloom.sources.durable import cut_lineage

#: Names a merge prompt holds, about.
FAN = 40

_MERGED = "merged map<string,array<string>>"


def _counted(names: DataFrame) -> DataFrame:
    """``(bucket, total)``: different names of each bucket."""
    return names.groupBy("bucket").agg(F.count_distinct("name").alias("total"))


def merge_prompts(names: DataFrame, todo: DataFrame, num_categories: int, fan: int, template: str) -> DataFrame:
    """``(bucket, part, held, prompt)`` of the buckets in ``todo (bucket, total)``; names of a prompt in order."""
    current = names.groupBy("bucket", "name").agg(F.min("about").alias("about")).join(todo, "bucket")
    parts = F.ceil(F.col("total") / F.lit(fan))
    part = F.pmod(F.xxhash64("name", "total"), parts).alias("part")
    entries = F.array_sort(F.collect_list(F.struct("name", "about")))
    dealt = current.select("bucket", "name", "about", part).groupBy("bucket", "part").agg(entries.alias("entries"))
    lines = F.transform("entries", lambda e: F.concat(F.lit("- "), e["name"], F.lit(": "), F.coalesce(e["about"], F.lit(""))))
    prompt = fill_template(template, categories=F.array_join(lines, "\n"), num_categories=F.lit(num_categories))
    dealt = dealt.where(F.size("entries") > 1)
    return dealt.select("bucket", "part", F.col("entries.name").alias("held"), prompt.alias("prompt"))


def merge_categories(
    found: DataFrame,
    service: Service,
    num_categories: int,
    fan: int = FAN,
    template: str = MERGE_TEMPLATE,
    parallelism: int | None = None,
    store: AnswerStore | None = None,
) -> DataFrame:
    """``(bucket, category, merged)`` for every category in ``found (bucket, batch, category, about)``.

    A bucket with one batch, or with no more names than asked for, keeps them.
    """
    several = found.groupBy("bucket").agg(F.count_distinct("batch").alias("batches")).where("batches > 1").select("bucket")
    names = found.groupBy("bucket", "category").agg(F.min("about").alias("about"))
    names = cut_lineage(names.withColumn("name", F.col("category")), "categories")
    todo = cut_lineage(_counted(names).where(F.col("total") > num_categories).join(several, "bucket"), "todo")
    while not todo.isEmpty():
        prompts = merge_prompts(names, todo, num_categories, fan, template)
        asked = prompts.withColumn("max_tokens", answer_budget(F.col("prompt")))
        answers = ask(asked, "prompt", service, parallelism, ["max_tokens"], store)
        reply = F.from_json(json_slice(F.coalesce("result", F.lit(""))), _MERGED)["merged"]
        groups = answers.select("bucket", "held", F.explode(reply).alias("into", "old"))
        groups = groups.where(not_blank(F.col("into")) & F.col("old").isNotNull())
        # An old name counts only where it was asked about; named twice, the least group has it.
        old = groups.select("bucket", strip(F.col("into")).alias("into"), F.explode(F.array_intersect("old", "held")).alias("name"))
        table = old.groupBy("bucket", "name").agg(F.min("into").alias("into"))
        moved = names.join(table, ["bucket", "name"], "left")
        names = moved.select("bucket", "category", "about", F.coalesce("into", "name").alias("name"))
        names = cut_lineage(names, "categories")
        # Another round for buckets of several prompts, as long as it gets them further.
        before = todo.where(F.col("total") > fan).withColumnRenamed("total", "before")
        further = _counted(names).join(before, "bucket").where("total < before").where(F.col("total") > num_categories)
        todo = cut_lineage(further.select("bucket", "total"), "todo")
    return names.select("bucket", "category", F.col("name").alias("merged"))
