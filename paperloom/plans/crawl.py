"""From a search to the finished paper table."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.prompts import BATCH_TEMPLATE
from paperloom.functions.urls import SITE, papers_file_name
from paperloom.operators.answer_store import AnswerStore
from paperloom.operators.batches import classify_papers
from paperloom.operators.enrich import Service, translate_abstracts
from paperloom.operators.metadata import metadata_from_services, metadata_waterfall, with_metadata
from paperloom.operators.pdfs import pdf_plan
from paperloom.operators.records import (
    RESULT_BLOCK,
    RESULT_STEPS,
    PaperRules,
    listing_links,
    records_for_links,
)
from paperloom.operators.select import Rule
from paperloom.sources.durable import cut_lineage
from paperloom.sources.files import file_name, write_papers


@dataclass(frozen=True)
class CrawlOptions:
    """What a run does beyond the paper records. Stages left None are skipped."""

    n: int = 10
    words: Sequence[str] = ()
    site: str = SITE
    block: Rule = RESULT_BLOCK
    steps: Sequence[Rule] = RESULT_STEPS
    rules: PaperRules = field(default_factory=PaperRules)
    manifest: DataFrame | None = None
    translate: Service | None = None
    catalogs: Mapping[str, DataFrame] | None = None
    #: Asked for titles in place of the catalogs.
    metadata_services: Mapping[str, Service] | None = None
    classify: Service | None = None
    num_categories: int = 4
    language: str = "zh-cn"
    #: Calls in flight at a time, for every service.
    parallelism: int | None = None
    #: Prompt of a batch of papers.
    template: str = BATCH_TEMPLATE
    #: Keeps answers for later runs.
    store: AnswerStore | None = None


def paper_table(listing: DataFrame, pages: DataFrame, options: CrawlOptions) -> DataFrame:
    """Papers of each search with every stage asked for.

    ``listing(search_id, page_ord, html)`` are the search pages and
    ``pages(page_id, url, html)`` the paper pages. Each stage adds columns to the
    one before; error records pass through all of them. What a stage starts from
    is written down first, as stages read their input more than once and pages
    should be parsed, and services asked, only once.
    """
    keys = ("search_id", "ord")
    links = listing_links(listing, options.n, options.block, options.steps, options.site)
    papers = records_for_links(cut_lineage(links, "links"), pages, rules=options.rules, site=options.site)

    def kept(name: str) -> AnswerStore | None:
        return options.store.part(name) if options.store else None

    stages: list[Callable[[DataFrame], DataFrame]] = []
    if options.manifest is not None:
        stages.append(lambda rows: pdf_plan(rows, options.words, options.manifest, keys))
    if options.translate is not None:
        stages.append(
            lambda rows: translate_abstracts(rows, options.translate, keys, options.parallelism, options.language, kept("translate"))
        )
    if options.metadata_services is not None:
        stages.append(
            lambda rows: with_metadata(
                rows, metadata_from_services(
                    rows, options.metadata_services, parallelism=options.parallelism, store=kept("metadata")
                ), keys
            )
        )
    elif options.catalogs is not None:
        stages.append(lambda rows: metadata_waterfall(rows, options.catalogs, keys))
    if options.classify is not None:
        stages.append(
            lambda rows: classify_papers(
                rows, options.classify, options.words, options.num_categories, options.template, bucket="search_id",
                parallelism=options.parallelism, store=kept("classify"),
            )
        )
    for stage in stages:
        papers = stage(cut_lineage(papers, "papers"))
    return papers


def save_papers(papers: DataFrame, folder: str, words: Sequence[str], name: str | None = None) -> str:
    """Write a run's papers, errors included, under a name made of its words; returns the path."""
    if not words and name is None:
        raise ValueError("words or a name are needed")
    target = name or file_name(papers.sparkSession, papers_file_name(F.array(*[F.lit(word) for word in words])))
    return write_papers(papers, posixpath.join(folder, target))
