import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from paperloom.sources.files import read_papers, read_split_papers
from paperloom.sources.split_csv import csv_records, ends_inside


@pytest.fixture
def tiny_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {name: spark.conf.get(name) for name in names}
    spark.conf.set(names[0], "97")
    spark.conf.set(names[1], "0")
    yield
    for name, value in old.items():
        spark.conf.set(name, value)


def test_ends_inside():
    assert not ends_inside("a,b", False) and ends_inside("a,b", True)
    assert ends_inside('a,"b', False) and not ends_inside('b",c', True)
    assert not ends_inside('"a""b",c', False) and ends_inside('"a""', False)
    # A quote within a plain field is one of its characters, also after a closed one.
    assert not ends_inside('5" disk,x', False) and not ends_inside('"a"b"c,d', False)
    assert ends_inside('b","c', True) and ends_inside('""', True) and not ends_inside('""', False)


def written(rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


def rows_of(seed, n=60):
    rng = random.Random(seed)
    pieces = ["x", "long words here", 'say "so"', "\n", ",", "é", '"', "\n\n", " "]
    field = lambda: "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 6)))
    rows = [(str(i), field() + ".", field() + ".") for i in range(n)]
    rows[n // 2] = (str(n // 2), "line\n" * 120 + ".", "over many splits")
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_records_in_order_from_many_tasks(spark, tmp_path, tiny_splits, seed):
    rows = rows_of(seed)
    path = tmp_path / "one.csv"
    path.write_text(written([("title", "url", "abstract"), *rows]), encoding="utf-8")
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 10
    papers = read_split_papers(spark, str(path), position="at").orderBy("at").select("title", "url", "abstract")
    assert [tuple(row) for row in papers.collect()] == rows
    assert sorted(papers.collect(), key=str) == sorted(
        read_papers(spark, str(path)).select("title", "url", "abstract").collect(), key=str
    )


def test_folder_blank_lines_marks_and_open_fields(spark, tmp_path, tiny_splits):
    (tmp_path / "a.csv").write_bytes(b'\xef\xbb\xbftitle,url\r\n\r\none,"u\r\n1"\r\n5" disk,x\r\n')
    (tmp_path / "b.csv").write_bytes(b'title,url\n"never closed,y\nmore')
    (tmp_path / "c.csv").write_bytes(b"title,url\n")
    found = read_split_papers(spark, str(tmp_path), position="at").orderBy("at")
    texts = [tuple(row) for row in found.select("title", "url").collect()]
    assert texts == [("one", "u\r\n1"), ('5" disk', "x"), ("never closed,y\nmore", None)]
    assert found.select("at").distinct().count() == 3
    assert csv_records(spark, str(tmp_path / "c.csv")).isEmpty()


def test_header_over_splits_and_one_task_each(spark, tmp_path, tiny_splits):
    path = tmp_path / "wide.csv"
    path.write_text('title,"own\n' + "name " * 60 + '"\nt,v\n', encoding="utf-8")
    found = csv_records(spark, str(path)).collect()
    assert [row.record for row in found] == ["t,v"]
    plan = csv_records(spark, str(path)).where(F.col("position") > 0)
    assert plan.count() == 1
