"""CSV files cut into records by many tasks, although fields hold line breaks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open at the end of a line, given whether one is at its start.

    A quote opens a field only as its first character; two quotes in a field are
    one of its characters; what follows a closing quote up to the comma is plain.
    """
    if '"' not in line:
        return inside
    at, fresh = 0, not inside
    while True:
        if fresh:
            if line.startswith('"', at):
                at += 1
            else:
                at = line.find(",", at) + 1
                if not at:
                    return False
                continue
        while True:
            quote = line.find('"', at)
            if quote < 0:
                return True
            at = quote + 1
            if not line.startswith('"', at):
                break
            at += 1
        at = line.find(",", at) + 1
        if not at:
            return False
        fresh = True


def _survey(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per split, for either state at its start: the state at its end, how many records
    start in it, and whether one that was open is closed."""

    def row(place, state, starts, closed):
        return pd.DataFrame([(*place, *state, *starts, closed)], columns=_SURVEYED)

    place = None
    for frame in frames:
        for file, block, line in zip(frame["file"], frame["block"], frame["value"]):
            if (file, block) != place:
                if place:
                    yield row(place, state, starts, closed)
                place, state, starts, closed = (file, block), [False, True], [0, 0], False
            for start in (0, 1):
                starts[start] += not state[start]
            quoted = '"' in line
            state = [ends_inside(line, was) for was in state] if quoted else state
            closed = closed or not state[1]
    if place:
        yield row(place, state, starts, closed)


_SURVEYED = ["file", "block", "after_out", "after_in", "starts_out", "starts_in", "closes"]


def _begin(survey: pd.DataFrame) -> pd.DataFrame:
    """How each split of one file begins: whether inside a record, in which split
    that record starts, and how many records start before."""
    rows, inside, origin, before = [], False, 0, 0
    for split in survey.sort_values("block").itertuples():
        rows.append((split.file, split.block, inside, origin, before))
        before += split.starts_in if inside else split.starts_out
        after = split.after_in if inside else split.after_out
        if after and (not inside or split.closes):
            origin = split.block
        inside = after
    return pd.DataFrame(rows, columns=["file", "block", "inside", "origin", "before"])


def _cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole records, and the pieces of those that reach over the end of a split."""
    place, held, done = None, [], []

    def leave(whole: bool) -> None:
        text = "\n".join(held)
        blank = whole and not carried and not text.strip("\r")
        nonlocal headed
        if not blank:
            # The first record of a file that is not blank names its columns.
            first, headed = not headed and not carried, True
            done.append((place[0], place[1], origin if carried else place[1], number, whole and not carried, first, text))
        held.clear()

    for frame in frames:
        for file, block, line, start, came, before in zip(
            frame["file"], frame["block"], frame["value"], frame["inside"], frame["origin"], frame["before"]
        ):
            if (file, block) != place:
                if held:
                    leave(False)
                place, inside, origin, following = (file, block), start, came, before
                carried, number, headed = start, -1, block > 0
            if not inside:
                carried, number, following = False, following, following + 1
            held.append(line)
            inside = ends_inside(line, inside)
            if not inside:
                leave(True)
        if done:
            yield pd.DataFrame(done, columns=_CUT)
            done.clear()
    if held:
        leave(False)
        yield pd.DataFrame(done, columns=_CUT)


_CUT = ["file", "block", "origin", "number", "whole", "header", "record"]


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``(file, position, record)``: the records of CSV files without their headers.

    A file is cut into as many tasks as it has splits. One pass finds, per split,
    where quoted fields are open at its end for both ways it may begin; these
    surveys, one row per split, are followed through each file and tell every split
    how it begins. The second pass cuts records; only pieces of records that reach
    over the end of a split are shuffled. ``position`` counts the records in file
    order, files by name; it is unique and has gaps at headers and blank lines. Line
    breaks in a field stay as they are, and a field never closed reaches to the end
    of the file. What is broadcast is one row per split of the files.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    surveyed = lines.mapInPandas(
        _survey,
        "file string, block long, after_out boolean, after_in boolean, starts_out long, starts_in long, closes boolean",
    )
    begin = surveyed.groupBy("file").applyInPandas(
        _begin, "file string, block long, inside boolean, origin long, before long"
    )
    told = lines.join(F.broadcast(begin), ["file", "block"])
    cut = told.mapInPandas(
        _cut,
        "file string, block long, origin long, number long, whole boolean, header boolean, record string",
    )
    whole = cut.where(F.col("whole") & ~F.col("header")).select("file", "number", "record")
    pieces = cut.where(~F.col("whole")).groupBy("file", "origin")
    glued = pieces.agg(
        F.max("number").alias("number"),
        F.bool_or("header").alias("header"),
        F.expr("listagg(record, '\\n') within group (order by block)").alias("record"),
    )
    found = whole.unionByName(glued.where(~F.col("header")).select("file", "number", "record"))
    # One row per file.
    sizes = surveyed.groupBy("file").agg(F.sum(F.greatest("starts_out", "starts_in")).alias("n"))
    order = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("file", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("first"))
    record = F.regexp_replace("record", r"\r\z", "")
    return found.join(F.broadcast(firsts), "file").select("file", (F.col("first") + F.col("number")).alias("position"), record.alias("record"))
