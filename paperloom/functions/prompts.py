"""Prompt texts as columns.

The three default templates are our own wording. A caller may pass any text
with the same placeholders.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import fill_template, truncate

READING_TEMPLATE = """Below is the text of a paper, then one question about it.

Text:
{pdf_content}

Question:
{question}

Answer from the text alone, in English and in Chinese. Say so if the text does not answer it.
"""

BATCH_TEMPLATE = """Group the papers below by topic. The search words were: {keywords}

{papers_info}
Make about {num_categories} groups. Put every paper into one group and reply with JSON only:
{{"categories": {{"group": "what it holds"}}, "classifications": {{"paper title": "group"}}}}
"""

MERGE_TEMPLATE = """Several lists of topics were made for parts of one collection. Here are all their topics:

{categories}

Bring them down to at most {num_categories} topics. Reply with JSON only, each old topic in one list:
{{"merged": {{"topic": ["old topic", "another old topic"]}}}}
"""

PAPER_TEMPLATE = """Name the topic of one paper; there are {num_categories} topics in all. The search words were: {keywords}

Title: {title}
Summary: {summary}

Reply with the topic name only.
"""

# Characters of document text sent with a question, and the
# answer budgets in tokens.
TEXT_LIMIT = 8000
QA_BUDGET = 1000
LONG_PROMPT = 1000
LONG_PROMPT_BUDGET = 2000
SHORT_PROMPT_BUDGET = 100


def reading_prompt(
    content: Column, question: Column, template: str = READING_TEMPLATE, limit: int | None = TEXT_LIMIT
) -> Column:
    return fill_template(template, pdf_content=truncate(content, limit), question=question)


def paper_entry(title: Column, summary: Column) -> Column:
    """How one paper appears in a batch prompt."""
    return F.concat(
        F.lit("Title: "), F.coalesce(title, F.lit("")),
        F.lit("\nSummary: "), F.coalesce(summary, F.lit("")), F.lit("\n\n"),
    )


def batch_prompt(
    papers_info: Column, words: Column, num_categories: int, template: str = BATCH_TEMPLATE
) -> Column:
    return fill_template(
        template,
        papers_info=papers_info,
        keywords=F.array_join(words, ", "),
        num_categories=F.lit(num_categories),
    )


def paper_prompt(
    title: Column, summary: Column, words: Column, num_categories: int, template: str = PAPER_TEMPLATE
) -> Column:
    return fill_template(
        template,
        title=title,
        summary=summary,
        keywords=F.array_join(words, ", "),
        num_categories=F.lit(num_categories),
    )


def answer_budget(prompt: Column) -> Column:
    return F.when(F.length(prompt) > LONG_PROMPT, LONG_PROMPT_BUDGET).otherwise(SHORT_PROMPT_BUDGET)
