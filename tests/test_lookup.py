import pytest
from pyspark.sql import functions as F

from paperloom.operators.lookup import hot_keys, key_counts, lookup, prefilter


@pytest.fixture(scope="module")
def rows(spark):
    # "h" and NULL hold more than a third of all rows each.
    key = F.when(F.col("id") % 5 < 2, "h").when(F.col("id") % 5 < 4, F.lit(None)).otherwise((F.col("id") % 40).cast("string"))
    return spark.range(2000).select("id", key.alias("k"))


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([("h", 1), ("4", 2), ("unused", 3)], "k string, v int")


def test_hot_keys_and_their_bound(rows):
    counts = key_counts(rows, "k")
    hot = hot_keys(counts, share=0.01, min_rows=100)
    assert sorted(salts for _, salts in hot) == [8, 8]
    assert sum(salts for _, salts in hot) <= 2 / 0.01
    assert hot_keys(counts) == []


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_equals_plain(rows, table, how):
    plain = rows.join(table, "k", how)
    salted = lookup(rows, table, "k", ["id"], how, share=0.001, min_rows=20)
    assert sorted(salted.select(plain.columns).collect(), key=str) == sorted(plain.collect(), key=str)


def test_hot_rows_are_dealt_over_tasks(spark, rows, table):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        salted = lookup(rows, table, "k", ["id"], share=0.001, min_rows=20)
        sizes = salted.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        plain = rows.join(table, "k", "left").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        for name in ("autoBroadcastJoinThreshold", "adaptive.enabled"):
            spark.conf.unset(f"spark.sql.{name}")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert plain >= 800
    assert sizes < 200


def test_known_counts_are_used(rows, table, spark):
    counts = rows.groupBy("k").count().select(F.xxhash64("k").alias("_key"), F.col("count").alias("_n"))
    found = lookup(rows, table, "k", ["id"], counts=counts, share=0.001, min_rows=20)
    assert found.count() == 2000
    assert found.where("v = 1").count() == 800


def test_counts_are_bounded_by_buckets(spark, monkeypatch):
    monkeypatch.setattr("paperloom.operators.lookup.BUCKETS", 16)
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "h").otherwise(F.col("id").cast("string")).alias("k"))
    counts = key_counts(rows, "k")
    assert counts.count() == 16
    assert counts.agg(F.sum("_n")).first()[0] == 5000
    assert [salts for _, salts in hot_keys(counts, share=0.2, min_rows=100)] == [2]
    # Other keys of the hot bucket are salted, too, and their table rows copied.
    table = rows.select("k").distinct().withColumn("v", F.length("k"))
    found = lookup(rows, table, "k", ["id"], share=0.2, min_rows=100)
    assert sorted(found.collect()) == sorted(rows.join(table, "k").select(found.columns).collect())


def test_prefilter_loses_no_wanted_row_and_most_others(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("k"))
    wanted = spark.range(0, 20_000, 20).select(F.col("id").cast("string").alias("k"))
    wanted = wanted.unionByName(spark.createDataFrame([(None,), ("0",)], "k string"))
    passed = prefilter(rows, wanted, "k")
    assert passed.columns == rows.columns
    exact = rows.join(wanted.distinct(), "k", "left_semi")
    assert exact.select("id").exceptAll(passed.select("id")).isEmpty()
    assert passed.count() < exact.count() + 0.05 * 20_000
    assert prefilter(rows, wanted.limit(0), "k").isEmpty()


def test_prefilter_of_fixed_size_still_loses_none(spark, monkeypatch):
    monkeypatch.setattr("paperloom.operators.lookup.FILTER_WORDS", 4)
    rows = spark.range(2000).select("id", F.col("id").cast("string").alias("k"))
    wanted = rows.where("id % 2 = 0").select("k")
    assert wanted.exceptAll(prefilter(rows, wanted, "k").select("k")).isEmpty()


def test_prefilter_stands_below_the_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(2000).select("id", F.col("id").cast("string").alias("k"))
        wanted = rows.where("id % 40 = 0").select("k").distinct()
        plan = prefilter(rows, wanted, "k").join(wanted, "k", "left_semi")
        lines = plan._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffled = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning(k" in line)
    filtered = next(i for i, line in enumerate(lines) if "BroadcastHashJoin" in line)
    assert shuffled < filtered
