"""Hubs, long chains and texts copied often: right components, and no task that gets all rows of one key."""

import random

import pytest
from pyspark.sql import functions as F

from lagweave.llm.common import connected_components, salted_join
from lagweave.llm.ngram_join import ngram_jaccard_join


def components(links):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


@pytest.fixture
def plain_plans(spark):
    """No plan is changed while it runs, and nothing is broadcast by size."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    for k, v in zip(kept, ("false", "-1", "16"), strict=True):
        spark.conf.set(k, v)
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def test_hub_chain_and_forest(spark):
    rng = random.Random(4)
    links = [(50_000, i) for i in range(60_000, 65_000)] + [(i, i + 1) for i in range(100, 160)] + [(60_000, 130)]
    links += [(200_000 + i, 200_000 + rng.randrange(i)) for i in range(1, 800)] + [(7, 7), (8, 9), (9, 8)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long").repartition(8)).collect()}
    want = components([x for x in links if x[0] != x[1]])
    assert got == want


def test_no_task_gets_a_hot_key(spark, plain_plans):
    rows = spark.range(100_000).select(F.lit(1).alias("k"), "id").union(spark.range(1000).select((F.col("id") + 5).cast("int").alias("k"), "id"))
    keys = rows.groupBy("k").agg(F.count("*").alias("n"))
    joined = salted_join(rows, keys.withColumn("v", F.col("k") * 2), ["k"], F.xxhash64("id"))
    per = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(per) == 101_000 and max(per) < 25_000


def test_one_text_copied_often(spark, plain_plans):
    text = " ".join(f"w{i}" for i in range(30))
    rows = spark.range(5_000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text")).union(spark.range(20_000, 22_000).select("id", F.lit(None).cast("string")))
    rows = rows.union(spark.createDataFrame([(40_000, text + " more"), (40_001, "other words here")], "doc_id long, text string"))
    found = ngram_jaccard_join(rows, 3, 90)
    per = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert max(per) < 4_000
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()}
    assert len(got) == 7_002 and all(got[i] == (28, 0) for i in range(0, 5_000, 97)) and got[40_000] == (29, 0)
    assert got[21_000] == (0, 21_000) and got[40_001] == (1, 40_001)
