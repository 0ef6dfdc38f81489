import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import rows
from reviewmill import session
from reviewmill.operators import insights
from reviewmill.operators.evaluation import with_group_split
from reviewmill.operators.insights import hash_sample
from reviewmill.operators.skew import dense_index, fits_broadcast, lookup_terms, top_n_per_group
from reviewmill.session import materialise


def test_top_n_in_a_hot_group(spark):
    rng = random.Random(1)
    data = [(i, "hot" if i % 3 else f"k{i % 7}", rng.randrange(20)) for i in range(3000)]
    df = spark.createDataFrame(data, "id int, k string, v int")
    got = sorted(rows(top_n_per_group(df, ["k"], [F.desc("v"), F.asc("id")], 5, F.col("id")).select(
        "k", "rank", "id")))
    want = []
    for key in {d[1] for d in data}:
        best = sorted((d for d in data if d[1] == key), key=lambda d: (-d[2], d[0]))[:5]
        want += [(key, i + 1, d[0]) for i, d in enumerate(best)]
    assert got == sorted(want)


@pytest.mark.parametrize("bounds", [{}, {"max_rows": 3}, {"max_rows": 0}])
def test_lookup_is_the_same_join_on_every_path(spark, bounds):
    """All terms broadcast; hot terms broadcast and the rest shuffled; all shuffled."""
    postings = spark.createDataFrame(
        [(i, t, 1) for i in range(200) for t in ["hot", f"t{i % 20}", "unknown"]], "id int, term string, tf int")
    terms = materialise(spark.createDataFrame(
        [("hot", 200, 1.0)] + [(f"t{i}", 10, 2.0 + i) for i in range(20)], "term string, df int, idf double"), "t")
    got = sorted(rows(lookup_terms(postings, terms, hot_rows=50, **bounds).select("id", "term", "idf")))
    want = sorted([(i, "hot", 1.0) for i in range(200)] + [(i, f"t{i % 20}", 2.0 + i % 20) for i in range(200)])
    assert got == want


def test_dense_index_has_no_gap(spark):
    df = spark.createDataFrame([(f"w{(i * 37) % 500:03d}",) for i in range(500)], "term string")
    got = rows(dense_index(df, "term", "idx", lambda d: materialise(d, "placed")).orderBy("term"))
    assert got == [(f"w{i:03d}", i) for i in range(500)]


def test_size_check(spark):
    df = spark.createDataFrame([("x" * 1000,)] * 10, "t string")
    assert fits_broadcast(df)
    assert not fits_broadcast(df, max_rows=9)
    assert not fits_broadcast(df, max_bytes=5000)


@pytest.mark.parametrize("edge", [1000, 7, 1])
def test_hash_sample_is_the_smallest_digests(spark, monkeypatch, edge):
    import hashlib
    monkeypatch.setattr(insights, "EDGE", edge)
    df = spark.range(5000).withColumnRenamed("id", "rid")
    order = sorted(range(5000), key=lambda i: hashlib.md5(f"7:{i}".encode()).hexdigest())
    for n in (0, 40, 2500, 4999, 5000, 9000):
        got = sorted(r[0] for r in rows(hash_sample(df, "rid", n, seed=7)))
        assert got == sorted(order[:n])
    again = spark.range(6).selectExpr("id % 2 as rid").unionAll(spark.range(300).selectExpr("7L as rid"))
    assert hash_sample(again, "rid", 100).count() == 100


def test_half_the_table_is_not_sorted_in_one_task(spark):
    half = hash_sample(spark.range(40_000).withColumnRenamed("id", "rid"), "rid", 20_000)
    plan = half._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and half.count() == 20_000


def test_group_cuts_are_exact(spark):
    df = spark.range(30_000).selectExpr("id", "case when id % 10 = 0 then 'a' when id % 10 < 4 then null else 'b' end as k")
    got = {r["k"]: (r["n"], r["t"]) for r in with_group_split(df, "id", ["k"]).groupBy("k").agg(
        F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert got == {"a": (3000, 599), None: (9000, 1799), "b": (18000, 3599)}
    assert with_group_split(df.limit(0), "id", ["k"]).count() == 0


def test_a_written_table_leaves_no_shuffle_files(spark):
    blocks = lambda: set(re.findall(r"shuffle_\d+", spark._jvm.org.apache.spark.SparkEnv.get().blockManager(
        ).diskBlockManager().getAllBlocks().mkString(" ")))
    df, before = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), blocks()
    setting = spark.conf.get(session.CLEANUP)
    table = session.materialise(df, "counted")
    assert not blocks() - before and spark.conf.get(session.CLEANUP) == setting
    assert table.count() == df.count() == 7 and table.agg(F.sum("count")).first()[0] == 1000
