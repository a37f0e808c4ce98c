"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import Observation
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from paperloom.queries.compare import session  # noqa: E402
from paperloom.queries.registry import QUERIES  # noqa: E402

HEADLINE = (
    "html_nodes html_tag_counts nested_select listing_links paper_records crawl_papers csv_roundtrip "
    "pdf_plan pdf_todo metadata_waterfall metadata_summary parse_metadata assign_category category_counts "
    "parse_classification parse_translation prompt_batches classification_context classify_papers enrich_dedup "
    "translate_column page_text page_stats qa_prompts qa_answers qa_wide qa_passages topic_clusters"
).split()


def timed(spark, name: str, sf_dir: str) -> float:
    """Seconds for the whole result, thrown away at the end."""
    started = time.perf_counter()
    QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def counted(spark, name: str, sf_dir: str) -> int:
    """Rows of the whole result; also the warm-up."""
    seen = Observation()
    observed = QUERIES[name].run(spark, sf_dir).observe(seen, F.count(F.lit(1)).alias("rows"))
    observed.write.format("noop").mode("overwrite").save()
    return seen.get["rows"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = session(cpus)
    seconds, rows = {}, {}
    for name in sys.argv[1:] or HEADLINE:
        rows[name] = counted(spark, name, sf_dir)
        seconds[name] = round(statistics.median(timed(spark, name, sf_dir) for _ in range(3)), 3)
    total = round(sum(seconds.values()), 3)
    result = {
        "metric": f"headline queries, median of 3 on local[{cpus}]",
        "value": total,
        "unit": "sec",
        "queries": seconds,
        "rows": rows,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
