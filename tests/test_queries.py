"""Every query over the driver's tables against its SQL in DuckDB, on made-up tables."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from marlspike import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r, d = random.Random(1), tmp_path_factory.mktemp("tables")

    def put(name, schema, rows):
        df = spark.createDataFrame(rows, schema)
        for c, t in df.dtypes:
            df = df.withColumn(c, F.col(c).cast("timestamp_ntz")) if c in ("ts", "o_orderdate", "l_shipdate") else df
        df.coalesce(1).write.parquet(f"{d}/{name}.parquet")

    day = lambda: f"199{r.randrange(2, 9)}-0{r.randrange(1, 10)}-11 00:00:00"
    put("region", "r_regionkey int, r_name string", [(i, n) for i, n in enumerate(["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"])])
    put("nation", "n_nationkey int, n_name string, n_regionkey int", [(i, f"N{i}", i % 5) for i in range(25)])
    put("customer", "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", [(i, f"C{i}", r.randrange(25), round(r.uniform(-999, 9999), 2), r.choice(["BUILDING", "MACHINERY"])) for i in range(1, 61)])
    put("supplier", "s_suppkey long, s_name string, s_nationkey int, s_acctbal double", [(i, f"S{i}", r.randrange(25), round(r.uniform(-999, 9999), 2)) for i in range(1, 21)])
    put("part", "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", [(i, r.choice(["cold apple", "warm sea", "dry"]), f"B{i % 3}", r.choice(["STANDARD", "ECO", "BOX"]), r.randrange(1, 30), 900.0 + i) for i in range(1, 51)])
    put("orders", "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string", [(i, r.randrange(1, 51), r.choice("FOP"), round(r.uniform(900, 450000), 2), day(), r.choice(["1-URGENT", "2-HIGH", "5-LOW"])) for i in range(1, 401)])
    put("lineitem", "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate string", [(r.randrange(1, 401), r.randrange(1, 51), r.randrange(1, 21), r.randrange(1, 8), float(r.randrange(1, 51)), round(r.uniform(900, 90000), 2), r.randrange(11) / 100, 0.02, r.choice("ANR"), r.choice("FO"), day()) for _ in range(1200)])
    put("events", "event_id long, ts string, user_id long, event_type string, value double, props string", [(i, day(), r.randrange(1, 80), r.choice(["view", "buy"]), r.random(), f'{{"k": {r.randrange(100)}}}') for i in range(500)])
    return str(d)


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return con


def plain(v):
    return round(v, 4) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_sql(spark, folder, duck, name):
    df = queries.queries()[name](spark, folder)
    r = duck.execute(queries.oracle_sql()[name])
    theirs = [x[0] for x in r.description]
    assert sorted(df.columns) == sorted(theirs)
    names = sorted(theirs)
    want = sorted(repr([plain(row[theirs.index(c)]) for c in names]) for row in r.fetchall())
    got = sorted(repr([plain(row[c]) for c in names]) for row in df.collect())
    assert got == want


def test_only_relations_and_joins_shuffle(spark, folder):
    """Plain scans, filters, projections and single-pass changes run without a shuffle or Python."""
    for name in ("q_filter_eq", "q_filter_string_expr", "q_json_contains", "q_json_has_key", "q_dml_update", "q_dml_delete", "q_redact", "q_migrate", "q_rel_one_to_many"):
        plan = queries.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan, name
