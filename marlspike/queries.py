"""Queries over the driver's tables, one for each operator, with the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike import surface
from marlspike.catalog import Catalog
from marlspike.evolve import diff, migrate
from marlspike.functions import jsonops
from marlspike.operators.dml import Delete, Insert, SoftDelete, Update
from marlspike.operators.paging import Options, TableQuery, identity_key, redact
from marlspike.operators.relations import HOST_KEY
from marlspike.operators.select import Select, expr, fn
from marlspike.plans.fields import Field
from marlspike.plans.filters import Filters
from marlspike.schema import SCHEMA, catalog_of
from marlspike.sources.sql import Bindings, run_script, run_sql
from marlspike.sources.store import MemoryStore

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str) -> Callable:
    """Register a function of a catalog under its name, with its SQL."""

    def add(f: Callable[[Catalog], DataFrame | Select]) -> Callable:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            out = f(catalog_of(spark, folder))
            return out.to_df() if isinstance(out, Select) else out

        _QUERIES[f.__name__] = run
        _SQL[f.__name__] = sql
        return f

    return add


def _from(c: Catalog, table: str, alias: str) -> Select:
    return Select(c).from_(table, alias)


# projection


@_query("SELECT * FROM region")
def q_select_star(c):
    return _from(c, "region", "r")


@_query("SELECT n_nationkey, n_name FROM nation")
def q_select_cols(c):
    return _from(c, "nation", "n").select("n", ["nationkey", "name"])


@_query("SELECT c.* FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey")
def q_select_alias_star(c):
    q = _from(c, "customer", "c").select("c")
    return q.inner_join("c").to("nation", "n").on("c.c_nationkey = n.n_nationkey")


@_query("SELECT c_custkey AS id, c_name AS label FROM customer")
def q_select_alias(c):
    return _from(c, "customer", "c").select("c", {"custkey": "id", "name": "label"})


@_query("SELECT o_orderkey, o_totalprice * 2 + 1 AS _computed_gross, upper(o_orderpriority) AS pr FROM orders")
def q_select_computed(c):
    return _from(c, "orders", "o").select("o", ["orderkey"]).select_computed("gross", "o.o_totalprice * 2 + 1").select(None, ["upper(o.o_orderpriority) AS pr"])


@_query("SELECT c_custkey, c_name FROM customer")
def q_select_dedup(c):
    return _from(c, "customer", "c").select("c", ["custkey", "name"]).select("c", ["custkey"])


@_query("SELECT p_partkey, concat(p_brand, '-', upper('x'), '-', p_size + 1) AS code, CAST(NULL AS INTEGER) AS nothing, true AS yes FROM part")
def q_functions(c):
    return _from(c, "part", "p").select("p", ["partkey"]).select(None, [fn("concat", expr("p.p_brand"), "-", fn("upper", "x"), "-", expr("cast(p.p_size + 1 as string)")).alias("code"), F.lit(None).cast("int").alias("nothing"), F.lit(True).alias("yes")])


# filters


@_query("SELECT * FROM orders WHERE o_orderstatus = 'F'")
def q_filter_eq(c):
    return _from(c, "orders", "o").where(Filters().eq("o.orderstatus", "F"))


@_query("SELECT * FROM orders WHERE o_orderstatus <> 'F'")
def q_filter_neq(c):
    return _from(c, "orders", "o").where(Filters().neq("orderstatus", "F"))


@_query("SELECT * FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 200000.5 AND o_orderkey > 10 AND o_orderkey <= 14000")
def q_filter_range(c):
    return _from(c, "orders", "o").where(Filters().gte("totalprice", "100000").lt("totalprice", 200000.5).gt("orderkey", "10").lte("orderkey", 14000))


@_query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%e%'")
def q_filter_like(c):
    return _from(c, "part", "p").select("p", ["partkey", "name"]).where(Filters().like("p.name", "%a%e%"))


@_query("SELECT p_partkey, p_type FROM part WHERE p_type NOT LIKE '%A%'")
def q_filter_not_like(c):
    return _from(c, "part", "p").select("p", ["partkey", "type"]).where(Filters().not_like("p.type", "%A%"))


@_query("""SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000
WHERE o_orderkey IS NULL OR (o_orderkey IS NOT NULL AND c_custkey < 100)""")
def q_filter_null_tests(c):
    q = _from(c, "customer", "c").select("c", ["custkey"])
    q.left_join("c").to("orders", "o").on(Filters().eq("c.custkey", Field("custkey", "o")).gt("o.totalprice", 400000))
    return q.select("o", ["orderkey"]).where(Filters().eq("o.orderkey", None).or_(lambda f: f.neq("o.orderkey", None).lt("c.custkey", 100)))


@_query("SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def q_filter_in_list(c):
    return _from(c, "orders", "o").where(["orderpriority", "in", ["1-URGENT", "2-HIGH", "1-URGENT"]])


@_query("SELECT * FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def q_filter_not_in_list(c):
    return _from(c, "orders", "o").where(["orderpriority", "not_in", ["1-URGENT", "2-HIGH"]])


@_query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def q_filter_in_subquery(c):
    sub = _from(c, "customer", "c").select("c", ["custkey"]).where(Filters().eq("c.mktsegment", "BUILDING"))
    return _from(c, "orders", "o").select("o", ["orderkey"]).where(Filters().in_("o.custkey", sub))


@_query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def q_filter_not_in_subquery(c):
    sub = _from(c, "orders", "o").select("o", ["custkey"]).where(Filters().gt("o.totalprice", 300000))
    return _from(c, "customer", "c").select("c", ["custkey"]).where(Filters().not_in("c.custkey", sub))


@_query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 1) FROM orders WHERE o_custkey < 20) OR c_custkey BETWEEN 10 AND 30")
def q_filter_not_in_nulls(c):
    # with a null among the values nothing is known to be outside: only the second condition gives rows
    sub = _from(c, "orders", "o").select(None, ["nullif(o.o_custkey, 1) AS k"]).where(Filters().lt("o.custkey", 20))
    f = Filters().not_in("c.custkey", sub).or_(lambda g: g.gte("c.custkey", 10).lte("c.custkey", 30))
    return _from(c, "customer", "c").select("c", ["custkey"]).where(f)


@_query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 200000 AND o_custkey <> 7")
def q_filter_bindings(c):
    q = _from(c, "orders", "o").select("o", ["orderkey"]).bind_all({"list": ["1-URGENT", "2-HIGH"], "low": 200000, "skip": 7})
    return q.where(Filters().in_("orderpriority", ":list").gt("totalprice", ":low")).where("o.o_custkey <> :skip")


@_query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def q_select_distinct(c):
    return _from(c, "orders", "o").select("o", ["orderstatus", "orderpriority"]).distinct()


@_query("SELECT o_orderkey FROM orders WHERE (o_totalprice > 200000) = true AND (o_orderstatus = 'F') = false")
def q_filter_bool(c):
    return _from(c, "orders", "o").select("o", ["orderkey"]).where(Filters().is_true("(o.o_totalprice > 200000)").is_false("(o.o_orderstatus = 'F')"))


@_query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
def q_filter_scalar_subquery(c):
    sub = _from(c, "orders", "x").select(None, ["avg(x.o_totalprice) * 1.5 AS a"])
    return _from(c, "orders", "o").select("o", ["orderkey"]).where(Filters().gt("o.totalprice", sub))


@_query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey > l_orderkey")
def q_filter_column(c):
    return _from(c, "lineitem", "l").select("l", ["orderkey", "linenumber", "partkey"]).where(Filters().gt("l.partkey", Field("orderkey", "l")))


@_query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 300000) AND o_orderpriority = '1-URGENT'")
def q_bool_left_assoc(c):
    return _from(c, "orders", "o").select("o", ["orderkey"]).where(Filters().eq("orderstatus", "F").or_().gt("totalprice", 300000).and_().eq("orderpriority", "1-URGENT"))


@_query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND (o_totalprice > 300000 OR o_orderpriority IN ('1-URGENT'))) OR o_custkey IS NULL")
def q_filter_string_expr(c):
    f = Filters.from_any({"_$filter": "orderstatus eq :s and (totalprice gt :p or orderpriority in :l) or custkey is_null", "_$bindings": {"s": "F", "p": 300000, "l": ["1-URGENT"]}})
    return _from(c, "orders", "o").select("o", ["orderkey"]).where(f)


@_query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 250000.5 OR o_orderpriority = '5-LOW'")
def q_filter_string_literals(c):
    return _from(c, "orders", "o").select("o", ["orderkey"]).where(Filters.from_text("o.totalprice gte 250000.5 or o.orderpriority eq '5-LOW'", {}, None, strict=False))


@_query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O' OR o_orderstatus = 'P') AND (o_totalprice < 50000 OR o_totalprice > 350000)")
def q_filter_array_form(c):
    return _from(c, "orders", "o").select("o", ["orderkey"]).where([["orderstatus", "eq", "O", "or", "orderstatus", "EQ", "P"], "and", ["totalprice", "lt", 50000, "or", "totalprice", "gt", 350000]])


@_query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND (o_totalprice < 50000 OR o_totalprice > 350000)")
def q_filter_map_form(c):
    return _from(c, "orders", "o").select("o", ["orderkey"]).where({"orderstatus": "F", "totalprice": [["lt", 50000, "or"], ["gt", 350000]]})


@_query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1995 AND o_orderkey % 2 = 1")
def q_filter_raw(c):
    return _from(c, "orders", "o").select("o", ["orderkey"]).where("year(o.o_orderdate) = 1995").and_where(expr("o.o_orderkey % 2 = 1"))


# joins and FROM


@_query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000")
def q_join_inner(c):
    q = _from(c, "orders", "o").select("o", ["orderkey"])
    q.inner_join("o").to("customer", "c").on(Filters().eq("o.custkey", Field("custkey", "c")))
    return q.select("c", ["name"]).where(Filters().gt("o.totalprice", 100000))


@_query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'")
def q_join_left(c):
    q = _from(c, "customer", "c").select("c", ["custkey"])
    q.left_join("c").to("orders", "o").on("c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P'")
    return q.select("o", ["orderkey"])


@_query("SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 350000")
def q_join_right(c):
    q = _from(c, "orders", "o").select("o", ["orderkey"])
    q.right_join("o").to("customer", "c").on("c.c_custkey = o.o_custkey AND o.o_totalprice > 350000")
    return q.select("c", ["custkey"])


@_query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def q_join_cross(c):
    q = _from(c, "region", "r").select("r", ["name"])
    q.inner_join("r").to("nation", "n")
    return q.select("n", ["name"])


@_query("SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_suppkey < n_nationkey")
def q_join_theta(c):
    q = _from(c, "supplier", "s").select("s", ["suppkey"])
    q.inner_join("s").to("nation", "n").on("s.s_suppkey < n.n_nationkey")
    return q.select("n", ["nationkey"])


@_query("""SELECT r_name, n_name, count(*) AS n, round(sum(l_extendedprice), 2) AS total
FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey
JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY r_name, n_name""")
def q_join_multi(c):
    q = _from(c, "region", "r")
    q.inner_join("r").to("nation", "n").on("r.r_regionkey = n.n_regionkey")
    q.inner_join("n").to("customer", "c").on("n.n_nationkey = c.c_nationkey")
    q.inner_join("c").to("orders", "o").on("c.c_custkey = o.o_custkey")
    q.inner_join("o").to("lineitem", "l").on("o.o_orderkey = l.l_orderkey")
    return q.select("r", ["name"]).select("n", ["name"]).select(None, ["count(*) AS n", "round(sum(l.l_extendedprice), 2) AS total"]).group_by("r.name", "n.name")


@_query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def q_join_self(c):
    q = _from(c, "nation", "a").select("a", {"name": "a"})
    q.inner_join("a").to("nation", "b").on(Filters().eq("a.regionkey", Field("regionkey", "b")).lt("a.nationkey", Field("nationkey", "b")))
    return q.select("b", {"name": "b"})


@_query("SELECT c_nationkey, CAST(sum(n) AS BIGINT) AS n FROM (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey, c_mktsegment) GROUP BY c_nationkey")
def q_derived_table(c):
    sub = _from(c, "customer", "c").select("c", ["nationkey"]).select(None, ["count(*) AS n"]).where("c.c_acctbal > 0").group_by("c.nationkey", "c.mktsegment")
    return Select(c).from_(sub, "s").select("s", ["c_nationkey"]).select(None, ["sum(s.n) AS n"]).group_by("s.c_nationkey")


@_query("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
def q_from_multi(c):
    return Select(c).from_({"nation": "n", "region": "r"}).select("n", ["name"]).select("r", ["name"]).where(Filters().eq("n.regionkey", Field("regionkey", "r")))


# aggregation


@_query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def q_group_by(c):
    return _from(c, "lineitem", "l").select("l", ["returnflag", "linestatus"]).select(None, ["round(sum(l.l_quantity), 2) AS sum_qty", "round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue", "round(avg(l.l_discount), 6) AS avg_disc", "count(*) AS n"]).group_by("l.returnflag").group_by("l.linestatus")


@_query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 1000000")
def q_group_having(c):
    return _from(c, "orders", "o").select("o", ["custkey"]).select(None, ["count(*) AS n"]).group_by("o.custkey").having("sum(o.o_totalprice) > 1000000")


@_query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 5 AND max(o_totalprice) < 400000")
def q_group_having_filters(c):
    return _from(c, "orders", "o").select("o", ["custkey"]).select(None, ["count(*) AS n"]).group_by("o.custkey").having(Filters().gt("n", 5).lt("max(o.o_totalprice)", 400000))


@_query("SELECT count(1) AS total FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey)")
def q_count_total(c):
    return _from(c, "orders", "o").select("o", ["custkey"]).where(Filters().eq("o.orderstatus", "O")).group_by("o.custkey").count_df()


@_query("SELECT count(DISTINCT o_custkey) AS customers, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, min(o_totalprice) AS low FROM orders")
def q_count_distinct(c):
    return _from(c, "orders", "o").select(None, ["count(DISTINCT o.o_custkey) AS customers", "count_if(o.o_orderstatus = 'F') AS done", "min(o.o_totalprice) AS low"])


@_query("SELECT p_brand, p_size % 5 AS bucket, count(*) AS n FROM part GROUP BY p_brand, p_size % 5")
def q_group_by_expr(c):
    return _from(c, "part", "p").select("p", ["brand"]).select(None, ["p.p_size % 5 AS bucket", "count(*) AS n"]).group_by("p.brand", "p.p_size % 5")


@_query("""SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS rn,
round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS running FROM orders""")
def q_window_raw(c):
    return _from(c, "orders", "o").select("o", ["orderkey"]).select(None, ["row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderkey) AS rn", "round(sum(o.o_totalprice) OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderkey), 2) AS running"])


# order, limit, pages


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
def q_order_limit_offset(c):
    return _from(c, "orders", "o").select("o", ["orderkey", "totalprice"]).order_by({"o.totalprice": "DESC"}, "o.orderkey ASC").limit(25, 10)


@_query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey ORDER BY max(n_nationkey) DESC LIMIT 3")
def q_order_by_aggregate(c):
    return _from(c, "nation", "n").select("n", ["regionkey"]).select(None, ["count(*) AS n"]).group_by("n.regionkey").order_by("max(n.n_nationkey) DESC").limit(3)


@_query("""SELECT c_custkey, k FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer) ORDER BY k ASC NULLS FIRST, c_custkey LIMIT 20""")
def q_order_nulls(c):
    return _from(c, "customer", "c").select("c", ["custkey"]).select(None, ["nullif(c.c_nationkey, 3) AS k"]).order_by("k", "c.custkey").limit(20)


@_query("SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 15 OFFSET 15")
def q_page_2(c):
    options = Options.parse({"page": 2, "max": 15, "filters": {"orderstatus": "F"}, "order_by": "orderkey"})
    return TableQuery(c, "orders").find(options).df


@_query("SELECT * FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 11")
def q_keyset_asc(c):
    return TableQuery(c, "orders").find(Options.parse({"cursor": 100, "max": 10})).df


@_query("SELECT * FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey < 5000 ORDER BY o_orderkey DESC LIMIT 21")
def q_keyset_desc(c):
    return TableQuery(c, "orders").where_orderstatus_neq("P").find(Options.parse({"cursor": 5000, "cursor_direction": "desc", "max": 20})).df


@_query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 300000 AND o_orderpriority LIKE '1%'")
def q_table_query(c):
    o = Options(columns=["orderkey", "orderstatus"], filters={"_$filter": "totalprice gt :p", "_$bindings": {"p": 300000}})
    return TableQuery(c, "orders").where_orderpriority_like("1%").find(o).df


# JSON


@_query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def q_json_extract(c):
    return _from(c, "events", "e").select("e", ["event_id"]).select(None, [jsonops.extract(F.col("e.props"), "k").alias("k")])


@_query("SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50 AND json_extract_string(props, '$.k') <> '77'")
def q_json_path_filter(c):
    return _from(c, "events", "e").select("e", ["event_id"]).where(Filters().gt("e.props#k", 50).neq("props#k", "77"))


@_query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') LIKE '1%' OR json_extract_string(props, '$.missing') IS NOT NULL")
def q_json_path_like(c):
    return _from(c, "events", "e").select("e", ["event_id"]).where(Filters().like("props#['k']", "1%").or_().is_not_null("props#missing"))


@_query("SELECT event_id, json_exists(props, '$.k') AS has_k, json_exists(props, '$.z') AS has_z FROM events")
def q_json_has_key(c):
    return _from(c, "events", "e").select("e", ["event_id"]).select(None, [jsonops.has_key(F.col("e.props"), "k").alias("has_k"), jsonops.has_key(F.col("e.props"), "z").alias("has_z")])


@_query("SELECT event_id FROM events WHERE json_contains(props, '{\"k\": 7}')")
def q_json_contains(c):
    return _from(c, "events", "e").select("e", ["event_id"]).where(Filters().contains("e.props", {"k": 7}))


# relations


@_query("SELECT * FROM orders WHERE o_custkey = 42")
def q_rel_one_to_many(c):
    return c.table("customer").relations["orders"].of(c, {"custkey": 42})


@_query("SELECT o_orderkey AS _computed_host_key, c.* FROM orders JOIN customer c ON c_custkey = o_custkey")
def q_rel_many_to_one(c):
    return c.table("orders").relations["customer"].batch(c)


@_query("SELECT o_orderkey AS _computed_host_key, p.* FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part p ON p_partkey = l_partkey WHERE o_totalprice > 300000")
def q_rel_through(c):
    hosts = _from(c, "orders", "o").where(Filters().gt("totalprice", 300000)).to_df()
    return c.table("orders").relations["parts"].batch(c, hosts)


@_query("SELECT n_nationkey AS _computed_host_key, o.* FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders o ON o_custkey = c_custkey")
def q_rel_join_steps(c):
    return c.table("nation").relations["orders"].batch(c)


@_query("""SELECT o.* FROM customer JOIN orders o ON o_custkey = c_custkey JOIN (VALUES (1)) ON true
WHERE c_nationkey = 7""")
def q_rel_join_steps_one(c):
    return c.table("nation").relations["orders"].of(c, {"nationkey": 7})


@_query("SELECT o_custkey AS _computed_host_key, o.* FROM orders o WHERE o_orderpriority = '1-URGENT'")
def q_rel_filtered(c):
    return c.table("customer").relations["urgent_orders"].batch(c)


def _morph_catalog(c: Catalog) -> Catalog:
    """Notes on customers and on orders, made of the events table: odd ids are about customers."""
    out = Catalog(c.spark)
    out.table_builder("customer", lambda t: t.bigint("c_custkey").string("c_name").soft_deletable().primary("c_custkey").has_many("notes", "note", {"type": "morph", "prefix": "subject"}))
    out.table_builder("orders", lambda t: t.bigint("o_orderkey").soft_deletable().primary("o_orderkey"))
    out.table_builder("note", lambda t: t.bigint("event_id").string("body").morph("subject").primary("event_id").belongs_to("customer", "customer", {"type": "morph", "prefix": "subject"}))
    e, live = c.read("events"), [F.lit(False).alias("deleted"), F.lit(None).cast("long").alias("deleted_at")]
    kind = F.when(F.col("event_id") % 2 == 1, "customer").otherwise("orders")
    out.store = MemoryStore(c.spark, {
        "customer": c.read("customer").select("c_custkey", "c_name", *live),
        "orders": c.read("orders").select("o_orderkey", *live),
        "note": e.select("event_id", F.col("event_type").alias("body"), F.col("user_id").alias("subject_id"), kind.alias("subject_type")),
    })
    return out.freeze()


@_query("SELECT c_custkey AS _computed_host_key, event_id, event_type AS body, user_id AS subject_id, 'customer' AS subject_type FROM customer JOIN events ON user_id = c_custkey WHERE event_id % 2 = 1")
def q_rel_morph(c):
    m = _morph_catalog(c)
    return m.table("customer").relations["notes"].batch(m)


@_query("SELECT event_id AS _computed_host_key, c_custkey, c_name FROM customer JOIN events ON user_id = c_custkey WHERE event_id % 2 = 1")
def q_rel_morph_parent(c):
    m = _morph_catalog(c)
    return m.table("note").relations["customer"].batch(m).drop("deleted", "deleted_at")


@_query("""SELECT c_custkey AS _computed_host_key, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderkey) AS m FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def q_rel_batch(c):
    nested = c.table("customer").relations["orders"].batch_nested(c)
    return nested.select(HOST_KEY, F.size("orders").cast("long").alias("n"), F.coalesce(F.array_max(F.transform("orders", lambda o: o["o_orderkey"])), F.lit(0)).alias("m"))


@_query("SELECT c_custkey AS _computed_host_key, count(o_orderkey) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY c_custkey")
def q_rel_count_batch(c):
    return c.table("customer").relations["urgent_orders"].count_batch(c)


@_query("""SELECT _computed_host_key, o_orderkey FROM (SELECT o_custkey AS _computed_host_key, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn <= 3""")
def q_rel_batch_limit(c):
    return c.table("customer").relations["orders"].batch(c, limit=3).select(HOST_KEY, "o_orderkey")


@_query("SELECT o_custkey AS _computed_host_key, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def q_rel_batch_last(c):
    return c.table("customer").relations["orders"].batch_one(c).select(HOST_KEY, "o_orderkey")


# changes: the resulting table


@_query("SELECT * FROM region UNION ALL SELECT 5, 'ATLANTIS' UNION ALL SELECT 6, 'MU'")
def q_dml_insert(c):
    return Insert(c, "region").values([{"regionkey": 5, "name": "ATLANTIS"}, {"regionkey": 6, "name": "MU"}]).change().new


@_query("SELECT * FROM region UNION ALL SELECT 9, 'NEW'")
def q_dml_insert_ignore(c):
    return Insert(c, "region").values([{"regionkey": 1, "name": "X"}, {"regionkey": 9, "name": "NEW"}, {"regionkey": 9, "name": "LATER"}]).on_conflict_ignore().change().new


@_query("""SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer
UNION ALL SELECT c_custkey + 1000000, c_name, c_nationkey, c_acctbal + 1, c_mktsegment FROM customer WHERE c_custkey % 10 = 0""")
def q_dml_upsert(c):
    some = c.read("customer").where("c_custkey % 10 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    both = some.unionByName(some.withColumn("c_custkey", F.col("c_custkey") + 1000000))
    return Insert(c, "customer").from_query(both).on_conflict_update(["custkey"], ["acctbal"]).change().new


@_query("SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 300000 THEN 'P' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def q_dml_update(c):
    return Update(c, "orders").set({"orderstatus": "P"}).where(Filters().gt("totalprice", 300000)).change().new


@_query("SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_acctbal < 0 OR s_nationkey IN (1, 2) THEN s_acctbal * 2 + s_suppkey ELSE s_acctbal END AS s_acctbal FROM supplier")
def q_dml_update_expr(c):
    return Update(c, "supplier", "s").set({"acctbal": expr("s.s_acctbal * 2 + s.s_suppkey")}).where(Filters().lt("s.acctbal", 0).or_().in_("s.nationkey", [1, 2])).change().new


@_query("""SELECT p_partkey, p_name, p_brand, p_type, CASE WHEN p_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10 ORDER BY p_retailprice DESC, p_partkey LIMIT 7) THEN 0 ELSE p_size END AS p_size, p_retailprice FROM part""")
def q_dml_update_limit(c):
    return Update(c, "part").set({"size": 0}).where(Filters().gt("size", 10)).order_by("part.retailprice DESC", "part.partkey").limit(7).change().new


@_query("SELECT * FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 100000)")
def q_dml_delete(c):
    return Delete(c, "orders").where(Filters().eq("orderstatus", "F").lt("totalprice", 100000)).change().new


@_query("SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 12)")
def q_dml_delete_limit(c):
    return Delete(c, "orders").order_by("orders.totalprice", "orders.orderkey").limit(12).change().new


@_query("SELECT o.* FROM orders o WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def q_dml_delete_join(c):
    d = Delete(c, "orders", "o")
    d.inner_join("o").to("customer", "c").on("o.o_custkey = c.c_custkey")
    return d.where(Filters().eq("c.mktsegment", "BUILDING")).change().new


@_query("SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 5000")
def q_dml_returning(c):
    u = Update(c, "supplier", "s").set({"name": expr("s.s_name")}).where(Filters().gt("s.acctbal", 5000))
    return u.change().affected.select("s_suppkey", "s_name")


@_query("SELECT c_custkey, c_name, c_custkey <= 50 OR c_custkey % 7 = 0 AS deleted, CAST(CASE WHEN c_custkey % 7 = 0 THEN 5 WHEN c_custkey <= 50 THEN 1000 END AS BIGINT) AS deleted_at FROM customer")
def q_soft_delete(c):
    m = Catalog(c.spark)
    m.table_builder("customer", lambda t: t.bigint("c_custkey").string("c_name").soft_deletable().primary("c_custkey"))
    gone = F.col("c_custkey") % 7 == 0
    m.store = MemoryStore(c.spark, {"customer": c.read("customer").select("c_custkey", "c_name", gone.alias("deleted"), F.when(gone, F.lit(5)).cast("long").alias("deleted_at"))})
    return SoftDelete(m.freeze(), "customer", at=1000).where(Filters().lte("c_custkey", 50)).change().new


# the rest of the surface


@_query("SELECT c_custkey, c_name, c_nationkey, 0.0::DOUBLE AS c_acctbal, c_mktsegment FROM customer")
def q_redact(c):
    return redact(c.table("customer"), c.read("customer"))


@_query("SELECT concat_ws(':', o_orderkey) AS id FROM orders")
def q_identity_key(c):
    return c.read("orders").select(identity_key(c.table("orders")).alias("id"))


@_query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey IN (1, 2, 3, 4, 5) AND o_totalprice > 1000 GROUP BY o_orderstatus")
def q_raw_sql(c):
    b = Bindings().bind_named("p", 1000).bind_array({"ids": [1, 2, 3, 4, 5]})
    return run_sql(c.spark, "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey IN (:ids) AND o_totalprice > :p GROUP BY o_orderstatus", b, c)


@_query("SELECT n_name FROM nation WHERE n_regionkey = 2")
def q_raw_script(c):
    return run_script(c.spark, "CREATE OR REPLACE TEMP VIEW two AS SELECT * FROM nation WHERE n_regionkey = 2; -- a; b\nSELECT n_name FROM two;", c)[-1]


@_query("SELECT c_custkey, c_name AS c_label, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_mktsegment, 'none' AS c_note FROM customer")
def q_migrate(c):
    columns = {k: v for k, v in SCHEMA["customer"]["columns"].items() if k not in ("name", "acctbal", "nationkey")}
    columns = {"custkey": columns["custkey"], "label": {"type": "string", "old_name": "name"}, "nationkey": {"type": "bigint"}, "mktsegment": columns["mktsegment"], "note": {"type": "string", "default": "none"}}
    old = Catalog(c.spark, c.store).load({"customer": {**SCHEMA["customer"], "constraints": SCHEMA["customer"]["constraints"][:1], "relations": {}}}).freeze()
    new = Catalog(c.spark).load({"customer": {"column_prefix": "c", "columns": columns, "constraints": SCHEMA["customer"]["constraints"][:1]}}).freeze()
    return migrate(old, new, diff(old, new))["customer"]


for _name, (_f, _sql) in surface.FOUND.items():
    _query(_sql)(_f)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


__all__ = ["oracle_sql", "queries"]
