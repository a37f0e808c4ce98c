"""Quality rules as a ledger of bits.

Every rule is evaluated once per document. The ledger keeps what was measured
and one integer whose bit ``i`` says that rule ``i`` failed. Policies are named
sets of rules; applying one, or asking what a rule costs, reads bits only and
never a text. All of it is native expressions: a document stays in its row, so
there is no shuffle, and its words are sorted only if a window of them repeats.

Defined results: a null or empty text has no words, all counts 0, and fails
``few_words``. Repeated rows each get their own row. Only the id and the text
are read, so further columns cannot clash. An empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = "\t\n\x0b\f\r "
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


@dataclass(frozen=True)
class Rule:
    """``failed`` is SQL over the measures, in integers, and never null."""

    name: str
    failed: str


#: The place of a rule is its bit. New rules go to the end; none is ever moved.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "100 * n_symbols > 10 * word_chars"),
    Rule("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule("capitals", "100 * n_capitals > 50 * word_chars"),
    Rule("long_words", "word_chars > 40 * n_words"),
)

#: Versioned policies: a published one is never changed.
POLICIES = {
    "base-1": ("few_words", "repeated_words"),
    "web-1": ("few_words", "repeated_words", "symbols", "duplicate_lines", "capitals", "long_words"),
}


def mask(policy: str) -> int:
    """The bits of a policy's rules."""
    places = {rule.name: place for place, rule in enumerate(RULES)}
    return sum(1 << places[name] for name in POLICIES[policy])


def words(text: Column) -> Column:
    """Words between white space."""
    return F.array_remove(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), "")


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def measures(documents: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the measures of each whole text.

    Each array is a column of its own, so the lambdas below index arrays that are
    there already. Windows are compared by 64-bit hashes within one document.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    read = documents.select(F.col(key).alias(key), content.alias("_text"))
    split = read.select(
        key,
        "_text",
        words(F.col("_text")).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda line: F.translate(line, WHITE, "") != "").alias("_lines"),
    )
    hashed = split.select(
        key,
        F.size("_words").cast("long").alias("n_words"),
        _without(F.col("_text"), WHITE).cast("long").alias("word_chars"),
        (F.length("_text") - _without(F.col("_text"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.length("_text") - _without(F.col("_text"), CAPITALS)).cast("long").alias("n_capitals"),
        F.transform("_words", lambda word: F.xxhash64(word)).alias("_hashes"),
    )
    kept = [name for name in hashed.columns if name != "_hashes"]
    starts = F.when(F.size("_hashes") >= WINDOW, F.sequence(F.lit(0), F.size("_hashes") - WINDOW)).otherwise(
        F.array().cast("array<int>")
    )
    windows = hashed.select(
        *kept,
        F.transform(starts, lambda i: F.xxhash64(*[F.col("_hashes")[i + k] for k in range(WINDOW)])).alias("_windows"),
    )
    placed = F.transform("_windows", lambda value, i: F.struct(value.alias("value"), i.alias("i")))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    ordered = windows.select(*kept, F.when(repeats, F.sort_array(placed)).alias("_ordered"))
    last = F.size("_ordered") - 1

    def again(item: Column, i: Column) -> Column:
        before = (i > 0) & (F.col("_ordered")[F.greatest(i - 1, F.lit(0))]["value"] == item["value"])
        after = (i < last) & (F.col("_ordered")[F.least(i + 1, last)]["value"] == item["value"])
        return before | after

    found = ordered.select(
        *kept, F.sort_array(F.transform(F.filter("_ordered", again), lambda item: item["i"])).alias("_found")
    )
    fresh = F.transform(
        "_found",
        lambda start, i: F.when(i == 0, WINDOW).otherwise(
            F.least(F.lit(WINDOW), start - F.col("_found")[F.greatest(i - 1, F.lit(0))])
        ),
    )
    covered = F.aggregate(fresh, F.lit(0).cast("long"), lambda total, n: total + n)
    return found.select(key, *kept[1:], F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def ledger(documents: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the measures and ``failed_bits``."""
    bits = " | ".join(f"case when {rule.failed} then {1 << place}L else 0L end" for place, rule in enumerate(RULES))
    measured = measures(documents, key=key, text=text)
    return measured.select(key, *MEASURES, F.expr(bits).alias("failed_bits"))


def passes(policy: str, bits: str = "failed_bits") -> Column:
    """Whether no rule of the policy failed."""
    return F.col(bits).bitwiseAND(F.lit(mask(policy))) == 0


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: documents it fails, and those it alone rejects.

    The ledger is first counted by its bits, in each partition: no more rows than
    combinations of rules are shuffled. A document fails alone if clearing the
    rule's bit leaves nothing of the policy's.
    """
    whole = mask(policy)
    seen = F.col("failed_bits").bitwiseAND(F.lit(whole))
    counted = book.groupBy(seen.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    named = [(place, rule.name) for place, rule in enumerate(RULES) if whole >> place & 1]
    rules = F.explode(F.array(*[F.struct(F.lit(1 << p).alias("bit"), F.lit(n).alias("rule")) for p, n in named]))
    rows = counted.select("bits", "n", rules.alias("r")).select("bits", "n", "r.bit", "r.rule")
    failed = F.col("bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("bits") == F.col("bit")
    return rows.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(failed, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(alone, F.col("n"))), F.lit(0)).alias("n_only"),
    )


def keep_good(documents: DataFrame, *, policy: str = "web-1", key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents the policy passes, with their own columns only.

    The ledger is computed beside the row, so nothing is joined. The condition
    must read the finished bits: pushed below them, it would measure a text anew
    for every rule. A column the optimizer may not move keeps it there.
    """
    whole = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col(text).alias("text"))
    judged = ledger(whole, key="row", text="text").withColumn("_number", F.monotonically_increasing_id())
    return judged.where(passes(policy) & (F.col("_number") >= 0)).select("row.*")


# --- the registered query ----------------------------------------------------

BASE = mask("base-1")


def rules_query(documents: DataFrame) -> DataFrame:
    book = ledger(documents)
    return book.select(
        "doc_id",
        *MEASURES,
        "failed_bits",
        (~passes("base-1")).alias("base_failed"),
        passes("web-1").alias("kept"),
    )


RULES_SQL = rf"""
with read as (
  select doc_id, coalesce(text, '') as t, translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13),
    '     ') as spaced from documents),
split as (
  select doc_id, t, list_filter(string_split(spaced, ' '), lambda w: w <> '') as ws,
    list_filter(string_split(t, chr(10)), lambda l: not regexp_full_match(l, '[\x20\x09-\x0D]*')) as ls from read),
windows as (
  select doc_id, i, array_to_string(ws[i : i + 7], ' ') as w
  from split, unnest(range(1, len(ws) - 6)) r(i) where len(ws) >= 8),
twice as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, w) as n from windows) where n > 1),
covered as (
  select doc_id, count(distinct i + k) as n from twice, unnest(range(0, 8)) r(k) group by doc_id),
measured as (
  select s.doc_id, cast(len(ws) as bigint) as n_words,
    cast(length(replace(array_to_string(ws, ' '), ' ', '')) as bigint) as word_chars,
    cast(length(t) - length(translate(t, '{SYMBOLS}', '')) as bigint) as n_symbols,
    cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
    cast(coalesce(c.n, 0) as bigint) as n_repeat_words,
    cast(len(ls) as bigint) as n_lines,
    cast(length(t) - length(translate(t, '{CAPITALS}', '')) as bigint) as n_capitals
  from split s left join covered c on s.doc_id = c.doc_id),
judged as (
  select *, cast({" + ".join(f"case when {rule.failed} then {1 << place} else 0 end" for place, rule in enumerate(RULES))}
    as bigint) as failed_bits from measured)
select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, failed_bits = 0 as kept from judged
"""
