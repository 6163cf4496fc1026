import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marlspike.errors import FilterError, QueryError
from marlspike.operators.select import Select, expr, fn, quote
from marlspike.plans.fields import Field
from marlspike.plans.filters import Filters
from marlspike.querylog import QueryLog
from marlspike.sources.sql import Bindings, expand_lists, run_script, run_sql, split_script
from tests.bank import bank


@pytest.fixture(scope="module")
def c(spark):
    return bank(spark)


def rows(q):
    return [tuple(r) for r in (q.to_df() if isinstance(q, Select) else q).collect()]


def test_projection(c):
    q = Select(c).from_("currencies", "y")
    assert q.to_df().columns == ["ccy_code", "ccy_name", "ccy_symbol"]
    assert Select(c).from_("currencies", "y").select("y", ["code", {"name": "n"}]).to_df().columns == ["ccy_code", "n"]
    assert Select(c).from_("currencies", "y").select("y", "code").select("y", ["ccy_code"]).to_df().columns == ["ccy_code"]
    assert Select(c).from_("currencies", "y").select("y", ["ccy_name"], auto_prefix=False).to_df().columns == ["ccy_name"]
    q = Select(c).from_("currencies", "y").select(None, ["upper(y.ccy_code) AS u"]).select_computed("k", "length(y.ccy_name)").order_by("u")
    assert q.to_df().columns == ["u", "_computed_k"] and rows(q) == [("EUR", 4), ("USD", 6)]
    with pytest.raises(QueryError):
        Select(c).from_("currencies", "y").select("z", ["code"])
    with pytest.raises(Exception, match="nope"):
        Select(c).from_("currencies", "y").select("y", ["nope"])


def test_functions(c):
    q = Select(c).from_("currencies", "y").select(None, [fn("concat", expr("y.ccy_code"), "'x'").alias("v")]).order_by("v")
    assert rows(q) == [("EUR'x'",), ("USD'x'",)] and quote("it's") == "'it\\'s'"


def test_aliases(c):
    q = Select(c).from_("clients", "a")
    for bad in (lambda: q.from_("accounts", "a"), lambda: q.from_("accounts", "1x"), lambda: q.alias_of("transactions"), lambda: q.from_(Select(c).from_("clients", "z")), lambda: Select(c).to_df()):
        with pytest.raises(QueryError):
            bad()
    assert q.alias_of("clients") == "a" and q.in_from("clients") and q.in_from("clients", "a") and not q.in_from("accounts") and not q.in_from("clients", "b")
    auto = Select(c).from_("clients")
    assert auto.alias_of("clients").startswith("_a")


def test_joins(c):
    def q(kind, on=True):
        s = Select(c).from_("clients", "k").select("k", ["id"])
        j = s.join(kind, "k").to("accounts", "a")
        if on:
            j.on(Filters().eq("k.id", Field("client_id", "a")).gt("a.balance", 5))
        return s.select("a", ["id"]).order_by("k.id", "a.id")

    assert rows(q("inner")) == [(1, 1), (1, 2)]
    assert rows(q("left")) == [(1, 1), (1, 2), (2, None), (3, None)]
    assert rows(q("right")) == [(None, 3), (1, 1), (1, 2)]
    assert len(rows(q("inner", on=False))) == 9
    with pytest.raises(QueryError):
        Select(c).from_("clients", "k").join("full", "k")
    with pytest.raises(QueryError):
        Select(c).from_("clients", "k").left_join("a")
    tree = Select(c).from_("clients", "k")
    tree.inner_join("k").to("accounts", "a").on("k.client_id = a.account_client_id")
    tree.left_join("a").to("transactions", "x").on("a.account_id = x.transaction_account_id")
    assert rows(tree.select("k", ["id"]).select("x", ["reference"]).order_by("x.reference")) == [(1, "r1"), (1, "r2"), (1, "r3"), (2, "r4")]


def test_groups(c):
    q = Select(c).from_("accounts", "a").select("a", ["currency_code"]).select(None, ["count(*) AS n", "sum(a.account_balance) AS s"]).group_by("a.currency_code")
    assert sorted((r[0], r[1], float(r[2])) for r in rows(q)) == [("EUR", 2, 10.5), ("USD", 1, 7.0)]
    assert rows(q.copy().having("count(*) > 1").select(None, ["max(a.account_id) AS m"]))[0][0] == "EUR"
    assert rows(q.copy().having("1 = 0").having(Filters().eq("n", 1)))[0][0] == "USD"
    assert rows(q.copy().having(["sum(a.account_balance)", "gt", 8]))[0][0] == "EUR"
    assert [r[0] for r in rows(q.copy().order_by("n DESC"))] == ["EUR", "USD"] and [r[0] for r in rows(q.copy().order_by({"max(a.account_id)": "ASC"}))] == ["USD", "EUR"]
    assert q.total() == 2 and rows(q.count_df()) == [(2,)]
    assert rows(Select(c).from_("accounts", "a").select(None, ["count(*) AS n"]).where("1 = 0")) == [(0,)]


def test_order_and_limit(c):
    q = Select(c).from_("transactions", "x").select("x", ["id"])
    assert rows(q.copy().order_by("x.amount DESC", {"x.id": True}).limit(2, 1)) == [(3,), (2,)]
    assert rows(q.copy().order_by({"x.id": False}).limit(1)) == [(4,)] and rows(q.copy().order_by([-F.col("x.transaction_id")]).limit(1)) == [(4,)]
    for bad in (lambda: q.limit(0), lambda: q.limit(1, -1), lambda: q.order_by({"id": "up"})):
        with pytest.raises(QueryError):
            bad()
    assert q.limit(None).max is None
    n = Select(c).from_("clients", "k").select(None, ["nullif(k.client_id, 2) AS v"])
    assert rows(n.copy().order_by("v")) == [(None,), (1,), (3,)] and rows(n.copy().order_by("v DESC")) == [(3,), (1,), (None,)]
    plan = q.copy().order_by("x.amount").limit(2).to_df()._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_raw_sql(spark, c):
    assert rows(run_sql(spark, "SELECT ccy_code FROM currencies WHERE ccy_code IN (:x) AND ccy_name = :n", {"x": ["EUR", "USD"], "n": "Euro"}, c)) == [("EUR",)]
    assert rows(run_sql(spark, "SELECT ? + ?", [1, 2])) == [(3,)] and rows(run_sql(spark, "SELECT :a", Bindings().bind_named("a", 5))) == [(5,)]
    with pytest.raises(QueryError):
        Bindings().bind_named("a", 1).bind_positional(2)
    with pytest.raises(QueryError):
        Bindings().bind_positional(2).bind_named("a", 1)
    b = Bindings().bind_named(":a", 1)
    assert b.merge(b).merge(Bindings().bind_named("b", 2)).named == {"a": 1, "b": 2}
    assert expand_lists("x IN (:a) AND :ab", {"a": [1, 1, 2], "ab": 3}) == ("x IN (:a_0, :a_1) AND :ab", {"a_0": 1, "a_1": 2, "ab": 3})
    assert split_script("SELECT ';' ; -- x;\nSELECT 1 /* ; */; SELECT \"a;\"") == ["SELECT ';'", "SELECT 1", 'SELECT "a;"']
    assert rows(run_script(spark, "CREATE OR REPLACE TEMP VIEW v1 AS SELECT 7 AS x; SELECT x + 1 FROM v1")[-1]) == [(8,)]


def test_bindings(c):
    q = lambda: Select(c).from_("transactions", "x").select("x", ["id"])
    assert rows(q().bind("s", "refunded").where(Filters().eq("state", ":s"))) == [(2,)]
    assert sorted(rows(q().bind_all({"l": ["confirmed", "in_error"], "m": 2}).where(Filters().in_("state", ":l").gt("amount", ":m")))) == [(3,), (4,)]
    assert sorted(rows(q().bind(":l", [1, 4]).bind("t", "it's").where("x.transaction_id IN (:l) AND :t <> ':l'"))) == [(1,), (4,)]
    assert rows(q().bind("n", None).where(Filters().eq("reference", ":n"))) == [] and rows(q().where(Filters().eq("reference", ":r"))) == []
    with pytest.raises(FilterError):
        q().where(Filters().in_("state", ":nothing")).to_df()


def test_literals_have_their_types(spark, c):
    when = dt.datetime(1995, 1, 1, 2, 3, 4, 500000)
    values = {"d": dt.date(1995, 1, 1), "t": when, "z": when.replace(tzinfo=dt.UTC), "m": Decimal("12.50"), "big": Decimal("1E+3"), "f": 1e300, "i": 1 << 70, "b": b"\x00a", "o": True, "n": None, "s": "it's \\ :d"}
    q = Select(c).from_("currencies", "y").bind_all(values).limit(1)
    row = spark.range(1).select(*[q.expression(f":{k}").alias(k) for k in values]).first()
    want = {**values, "z": row["z"], "i": Decimal(1 << 70), "big": Decimal(1000), "b": bytearray(b"\x00a")}
    assert row.asDict() == want and spark.range(1).select(q.expression(":z = TIMESTAMP '1995-01-01 02:03:04.5Z'")).first()[0]
    for bad in (object(), Decimal("NaN"), dt.time(1), {1}):
        with pytest.raises(QueryError):
            Select(c).bind("x", bad).expression(":x")


def test_groupings(c):
    q = lambda: Select(c).from_("accounts", "a").select("a", ["client_id", "currency_code"]).select(None, ["count(*) AS n"])
    key = lambda r: tuple((x is not None, x) for x in r)
    up = [(None, None, 3), (1, None, 2), (1, "EUR", 1), (1, "USD", 1), (2, None, 1), (2, "EUR", 1)]
    both = sorted([*up, (None, "EUR", 2), (None, "USD", 1)], key=key)
    for made in (q().rollup("a.client_id", "a.currency_code"), q().group_by("ROLLUP(a.client_id, a.currency_code)"), q().grouping_sets(["a.client_id", "a.currency_code"], ["a.client_id"], [])):
        assert sorted(rows(made), key=key) == up
    for made in (q().cube("a.client_id", "a.currency_code"), q().group_by("cube (a.client_id, a.currency_code)")):
        assert sorted(rows(made), key=key) == both
    assert sorted(rows(q().group_by("GROUPING SETS ((a.client_id), (a.currency_code), ())")), key=key) == sorted([r for r in both if r[0] is None or r[1] is None], key=key)
    assert rows(q().rollup("a.client_id", "a.currency_code").having("count(*) > 2")) == [(None, None, 3)]


def test_distinct(c):
    q = Select(c).from_("accounts", "a").select("a", ["currency_code"]).distinct()
    assert rows(q.order_by("account_currency_code").limit(5)) == [("EUR",), ("USD",)]
    with pytest.raises(QueryError):
        q.order_by("a.balance").to_df()


def test_query_log(c):
    log = QueryLog(most=2)
    df = Select(c).from_("accounts", "a").to_df()
    assert len(log.run(df)) == 3 and log.run(df, lambda d: d.count(), "n") == 3
    with pytest.raises(ZeroDivisionError):
        log.run(df, lambda d: 1 / 0, "bad")
    assert [e.name for e in log.entries] == ["n", "bad"] and len(log.slowest(1)) == 1 and all(e.duration >= 0 and e.plan for e in log.entries)
