"""Splits, ranks, rebalancing (SPL-*), partition invariance."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiflow.functions.hashing import hash_key
from lexiflow.operators import splits as S
from lexiflow.operators.rank import exact_rank, hash_rank


def test_truncating_cut(spark):
    df = spark.range(90).withColumn("lang", F.lit("x"))
    out = S.split_70_30(df, ["lang"], 42)
    assert out.where("split = 'train'").count() == 62  # int(.7 * 90) = 62


def test_small_splits(spark):
    for n, train in [(1, 0), (2, 1), (3, 2)]:
        df = spark.range(n).withColumn("lang", F.lit("x"))
        assert S.split_70_30(df, ["lang"], 42).where("split = 'train'").count() == train


def test_exact_rank_equals_plain_window(spark):
    random.seed(1)
    rows = [(i, random.choice("abc")) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string").withColumn("h", hash_key(7, F.col("id")))
    plain = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("h", "id")))
    fast = exact_rank(df, ["g"], [F.col("h"), F.col("id")], F.substring("h", 1, 3), "r", None)
    a = {(r["id"], r["r"]) for r in plain.collect()}
    b = {(r["id"], r["r"]) for r in fast.collect()}
    assert a == b


def test_ranks_with_null_groups_and_ids(spark):
    rows = [(1, "a"), (2, None), (3, "a"), (None, None), (5, None), (None, "a"), (None, None)]
    df = spark.createDataFrame(rows, "id long, g string").withColumn("h", hash_key(7, F.col("id")))
    plain = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("h", "id")))
    fast = exact_rank(df, ["g"], [F.col("h"), F.col("id")], F.substring("h", 1, 3), "r", "n")
    key = lambda rs: sorted(((r["id"], r["g"], r["r"]) for r in rs), key=str)
    assert key(fast.collect()) == key(plain.collect())
    assert {(r["g"], r["n"]) for r in fast.collect()} == {("a", 3), (None, 4)}


def test_partition_invariance(spark):
    df = spark.range(500).withColumn("lang", F.when(F.col("id") % 3 == 0, "a").otherwise("b"))
    base = None
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 4, 64):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            got = sorted(tuple(r) for r in S.split_70_10_20(df.repartition(parts), ["lang"], 42)
                         .select("id", "split", "rank").collect())
            base = base or got
            assert got == base
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_splits_disjoint_and_complete(spark):
    df = spark.range(1000).withColumn("lang", F.lit("x"))
    out = S.split_70_10_20(df, ["lang"], 42)
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts == {"train": 700, "dev": 100, "test": 200}
    assert out.select("id").distinct().count() == 1000


def test_oversample(spark):
    rows = [(i, "x", "positive") for i in range(5)] + [(5, "x", "neutral"), (6, "x", "neutral"), (7, "x", "negative")]
    df = spark.createDataFrame(rows, "id long, lang string, label string")
    out = S.oversample(df, ["lang"], "label", 42, block=2)
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {"positive": 5, "neutral": 5, "negative": 5}
    originals = {r["id"] for r in out.where("copy_no = 0").collect()}
    assert originals == set(range(8))
    # every draw is a row of its own class
    bad = out.join(df.select("id", F.col("label").alias("l2")), "id").where("label <> l2").count()
    assert bad == 0


def test_dedupe_last_label(spark):
    df = spark.createDataFrame([("t", "positive", 1), ("u", "neutral", 2), ("t", "negative", 3)],
                               "text string, label string, r long")
    got = {r["text"]: (r["label"], r["r"]) for r in S.dedupe_last_label(df, [], "r").collect()}
    assert got == {"t": ("negative", 1), "u": ("neutral", 2)}


def test_class_sample_short_class(spark):
    df = spark.createDataFrame([(i, "x", "positive" if i < 5 else "neutral") for i in range(7)],
                               "id long, lang string, label string")
    out = S.class_sample(df, 3, ["lang"], "label", 42)
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {"positive": 3, "neutral": 2}
    import pytest
    with pytest.raises(ValueError):
        S.class_sample(df, 3, ["lang"], "label", 42, on_short="error")


def test_pair_random_every_target_paired(spark):
    tgt = spark.range(50).withColumnRenamed("id", "id")
    src = spark.range(100, 107)
    pairs = S.pair_random(tgt, src, [], 42)
    assert pairs.count() == 50
    assert {r["source_id"] for r in pairs.collect()} <= set(range(100, 107))


def test_hash_rank_is_seeded(spark):
    df = spark.range(20).withColumn("g", F.lit(1))
    a = [r["id"] for r in hash_rank(df, ["g"], 1).orderBy("rank").collect()]
    b = [r["id"] for r in hash_rank(df, ["g"], 2).orderBy("rank").collect()]
    assert sorted(a) == list(range(20)) and a != b
