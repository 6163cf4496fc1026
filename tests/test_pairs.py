"""Relatives with a greater value: all pairs, and the work on them dealt out."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marlspike import queries
from marlspike.operators.relations import greater

NAN = float("nan")


def above(a, b):
    """Spark's and DuckDB's order: NaN is the greatest, zeros are equal."""
    return a is not None and b is not None and a == a and (b != b or b > a)


@pytest.mark.parametrize(("run", "parts"), [(1, 1), (3, 2), (2048, 4)])
def test_greater_against_brute_force(spark, run, parts):
    r = random.Random(run)
    values = [None, NAN, 0.0, -0.0, -1.5, 2.0, 2.0, 7.25, float("inf"), float("-inf")]
    hosts = [(i, r.choice([1, 2, 3, None]), r.choice(["x", "y"]), r.choice(values)) for i in range(60)]
    hosts += hosts[:5]
    targets = [(i, r.choice([1, 2, 4, None]), r.choice(["x", "y"]), r.choice(values), r.choice([None, "t"])) for i in range(90)]
    targets += targets[:5]
    h = spark.createDataFrame(hosts, "h long, hg int, hs string, hv double")
    t = spark.createDataFrame(targets, "t long, tg int, ts string, tv double, note string")
    out = greater(h, t, {"hg": "tg", "hs": "ts"}, ("hv", "tv"), ["t"], run, parts)
    assert out.columns == [*h.columns, *t.columns] and out.dtypes == [*h.dtypes, *t.dtypes]
    want = Counter(repr((*a, *b)) for a in hosts for b in targets if a[1] is not None and a[1:3] == b[1:3] and above(a[3], b[3]))
    assert want and Counter(repr(tuple(x)) for x in out.collect()) == want
    assert greater(h.limit(0), t, {"hg": "tg"}, ("hv", "tv"), ["t"]).count() == greater(h, t.limit(0), {"hg": "tg"}, ("hv", "tv"), ["t"]).count() == 0


def test_pairs_of_one_group_are_dealt_out(spark, tmp_path):
    """8,000 customers of one nation in one file: their pairs are not made by the one task that reads it."""
    n = 8000
    mixed = F.pmod(F.xxhash64("id"), F.lit(5000)).cast("double")
    people = spark.range(1, n + 1).select(F.col("id").alias("c_custkey"), F.concat(F.lit("C"), "id").alias("c_name"), F.lit(7).alias("c_nationkey"), mixed.alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment"))
    people.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(7, "N7", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    made = [x["count"] for x in queries.queries()["q_rel_virtual"](spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    same = sum(x["count"] ** 2 for x in people.groupBy("c_acctbal").count().collect())
    assert sum(made) == (n * n - same) // 2
    assert max(made) < 0.7 * sum(made)
