"""Files in and out: PDF folders, question files and CSV tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.operators.qa import number_questions
from paperloom.operators.records import clean_nulls
from paperloom.schemas import PAPER_CSV
from paperloom.sources.split_csv import csv_records


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Hash the rows of a plain file scan over all cores if it has fewer splits.

    For small files in front of costly work; a table of any size has far more
    splits than cores and passes unchanged. Only for scans: the number of splits
    of anything behind a shuffle is known only by running it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, *keys) if scan.rdd.getNumPartitions() < cores else scan


def file_name(spark: SparkSession, name: Column) -> str:
    """A name of ``paperloom.functions.urls`` for the program, of literal words."""
    return spark.range(1).select(name.alias("name")).first().name


def pdf_listing(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, pdf_filename, length)`` of the PDF files directly in a folder.

    File contents are not read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    return files.select("path", F.substring_index("path", "/", -1).alias("pdf_filename"), "length")


def read_questions(spark: SparkSession, path: str) -> list[str]:
    """Questions of a file, one per line. The file is a typed list of questions."""
    numbered = number_questions(spark.read.text(path, wholetext=True), text="value")
    questions = [row.question for row in numbered.orderBy("q_idx").collect()]
    if not questions:
        raise ValueError(f"no questions in {path}")
    return questions


def read_papers(spark: SparkSession, path: str | Sequence[str], schema: T.StructType = PAPER_CSV) -> DataFrame:
    """CSV with a header, whose names say which column is which.

    The columns of ``schema`` come first, NULL where the file has none, then the
    file's other columns as text. Each path is read by its own header. A byte order
    mark is skipped and an empty field is NULL. A missing path raises.
    """
    paths = [path] if isinstance(path, str) else path
    read = [spark.read.csv(one, **_CSV) for one in paths]
    return _arranged(reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), read), schema)


_CSV = {"header": True, "multiLine": True, "escape": '"', "encoding": "UTF-8"}


def _arranged(rows: DataFrame, schema: T.StructType) -> DataFrame:
    known = [
        (F.col(f"`{field.name}`") if field.name in rows.columns else F.lit(None)).cast(field.dataType).alias(field.name)
        for field in schema
    ]
    return rows.select(*known, *[F.col(f"`{name}`") for name in rows.columns if name not in schema.names])


def read_split_papers(spark: SparkSession, path: str, schema: T.StructType = PAPER_CSV, position: str = "position") -> DataFrame:
    """The rows of ``read_papers`` with ``position``, their order in the files, last.

    For large files: one file is read by many tasks, quoted line breaks included (see
    ``csv_records``). All files of a folder need the same header. A file's own column
    of the name of ``position`` is left out.
    """
    names = spark.read.csv(path, **_CSV).columns
    fields = T.StructType([T.StructField(name, T.StringType()) for name in names])
    ddl = fields.toDDL()
    records = csv_records(spark, path)
    parsed = records.select(F.from_csv("record", ddl, {"escape": '"'}).alias("row"), F.col("position").alias("place"))
    rows = parsed.select(*[F.col("row").getField(name).alias(name) for name in names if name != position], F.col("place").alias(position))
    return _arranged(rows, schema)


def write_papers(papers: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """All columns to a CSV folder with headers, NULL as an empty field."""
    clean_nulls(papers).write.mode(mode).csv(
        path, header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return path


def write_answers(wide: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Wide answer table to CSV; an empty one is refused."""
    if wide.isEmpty():
        raise ValueError("no answers to save")
    return write_papers(wide, path, mode)
