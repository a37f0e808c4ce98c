"""Answers of a service, kept for later runs.

Every answer is bought once: requests are known by a hash of all the service is
told, what the store has is not asked again, and what is left is asked in bounded
waves, each appended to the store before the next one starts. A run that is broken
off loses at most the wave it was in.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.sources.durable import new_path

ANSWERS = T.StructType([T.StructField(name, T.StringType()) for name in ("request", "result", "error")])


@dataclass(frozen=True)
class AnswerStore:
    """A folder all executors share, to which answers are appended.

    A wave holds about ``wave`` requests. Failed calls are kept, too, and asked again
    by the next run unless ``retry_failed`` is False.
    """

    path: str
    wave: int = 10_000
    retry_failed: bool = True

    def part(self, name: str) -> AnswerStore:
        """The store of one service: the same request to another one is another request."""
        return replace(self, path=f"{self.path.rstrip('/')}/{name}")

    def _append(self, answers: DataFrame) -> None:
        answers.select("request", "result", "error").write.parquet(f"{self.path.rstrip('/')}/wave-{uuid.uuid4().hex}")

    def read(self, spark: SparkSession) -> DataFrame:
        """``(request, result, error)``, one row per request: an answer rather than a failure."""
        # A folder without waves cannot be read, so there is always an empty one.
        spark.createDataFrame([], ANSWERS).write.mode("ignore").parquet(f"{self.path.rstrip('/')}/wave-0")
        kept = spark.read.schema(ANSWERS).option("recursiveFileLookup", "true").parquet(self.path)
        best = F.min(F.struct(F.col("error").isNotNull().alias("failed"), "result", "error")).alias("best")
        return kept.groupBy("request").agg(best).select("request", "best.result", "best.error")

    def _settled(self, spark: SparkSession) -> DataFrame:
        kept = self.read(spark)
        return (kept.where(F.col("error").isNull()) if self.retry_failed else kept).select("request")

    def complete(self, requests: DataFrame, call: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``requests`` with the answers kept or now given to them.

        ``requests`` is a written table with a column ``request``; ``call`` adds
        ``result`` and ``error`` to rows. Equal requests are asked once, and each at most
        once a run.
        """
        spark = requests.sparkSession
        open_ = requests.dropDuplicates(["request"]).join(self._settled(spark), "request", "left_anti")
        path = new_path(spark, "waves")
        count = max(1, math.ceil(open_.count() / self.wave))
        number = F.pmod(F.xxhash64("request"), F.lit(count)).cast("int")
        # A folder per wave, so that a wave reads its own requests only.
        open_.withColumn("wave", number).repartition("wave").write.partitionBy("wave").parquet(path)
        for wave in range(count):
            own = spark.read.schema(T.StructType([*requests.schema.fields, T.StructField("wave", T.IntegerType())]))
            own = own.parquet(path).where(F.col("wave") == wave).drop("wave")
            self._append(call(own))
        return requests.join(self.read(spark), "request", "left")


def request_key(payload: Column, told: Sequence[str], options: Mapping[str, object]) -> Column:
    """A hash of the payload and all else a service is told."""
    parts = [F.sha2(payload, 256), F.to_json(F.struct(*told)) if told else F.lit("")]
    parts += [F.lit(f"{name}={options[name]!r}") for name in sorted(options)]
    return F.sha2(F.concat_ws("|", *parts), 256)
