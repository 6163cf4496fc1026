"""More queries over the driver's tables: the surface around the operators, with the same in DuckDB's SQL.

What runs on the driver (refusals, pages, hooks, migrations) comes out as rows, so that it can be
compared like everything else."""

from __future__ import annotations

import datetime as dt
import json
from collections import Counter
from collections.abc import Callable
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlspike import codegen
from marlspike import types as ty
from marlspike.catalog import Catalog
from marlspike.errors import EngineError, ValueRefused
from marlspike.evolve import MemoryLedger, Migration, Runner, diff
from marlspike.functions import jsonops
from marlspike.operators import dml
from marlspike.operators.dml import Delete, Insert, Update
from marlspike.operators.paging import Options, TableQuery
from marlspike.operators.relations import HOST_KEY, greater
from marlspike.operators.select import Select, select
from marlspike.plans.fields import parse_path, print_path
from marlspike.plans.filters import Filters, MultiScope, TableScope
from marlspike.querylog import QueryLog
from marlspike.repository import Controller, Entity, Hooks
from marlspike.schema import SCHEMA
from marlspike.sources.sql import Bindings, run_sql
from marlspike.sources.store import MemoryStore

FOUND: dict[str, tuple[Callable[[Catalog], Any], str]] = {}


def _query(sql: str) -> Callable:
    def add(f: Callable) -> Callable:
        FOUND[f.__name__] = (f, sql)
        return f

    return add


def _rows(c: Catalog, rows: list[tuple], schema: str) -> DataFrame:
    return c.spark.createDataFrame(rows, schema)


def _refused(c: Catalog, **tries: Callable[[], Any]) -> DataFrame:
    """One row for each try: its name and the kind of error that refused it, null if none did."""
    out = []
    for name, f in tries.items():
        try:
            f()
            out.append((name, None))
        except (EngineError, AttributeError) as e:
            out.append((name, type(e).__name__))
    return _rows(c, out, "name string, error string")


def _own(c: Catalog) -> Catalog:
    """Customers that can be deleted softly, with orders that go with them, in memory over the files."""
    out = Catalog(c.spark)
    out.table_builder("nation", lambda t: t.int("n_nationkey").string("n_name").int("n_regionkey").primary("n_nationkey"))
    out.table_builder(
        "customer",
        lambda t: t.bigint("c_custkey").string("c_name").foreign("c_nationkey", "nation", "n_nationkey", on_delete="restrict").float("c_acctbal", sensitive=True).string("c_mktsegment").soft_deletable().primary("c_custkey")
        .has_many("orders", "orders", select=["o_orderkey", "o_totalprice"]).has_one("nation", "nation", {"type": "columns", "columns": {"c_nationkey": "n_nationkey"}})
        .collection("rich", lambda catalog, o: catalog.read("customer").where("c_acctbal > 9000")).virtual_relation("richer", _Richer()),
    )
    out.table_builder("orders", lambda t: t.bigint("o_orderkey").foreign("o_custkey", "customer", "c_custkey", on_delete="cascade").string("o_orderstatus").float("o_totalprice").primary("o_orderkey"))
    gone = F.col("c_custkey") % 7 == 0
    out.store = MemoryStore(c.spark, {
        "nation": c.read("nation"),
        "customer": c.read("customer").select("*", gone.alias("deleted"), F.when(gone, F.lit(5)).cast("long").alias("deleted_at")),
        "orders": c.read("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"),
    })
    return out.freeze()


class _Richer:
    """Customers of a host's nation with more on their account."""

    def __call__(self, catalog: Catalog, row: dict, **options: Any) -> DataFrame:
        return catalog.read("customer").where((F.col("c_nationkey") == row["c_nationkey"]) & (F.col("c_acctbal") > row["c_acctbal"]))

    def batch(self, catalog: Catalog, hosts: DataFrame, **options: Any) -> DataFrame:
        mine = hosts.select(F.col("c_custkey").alias(HOST_KEY), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("least"))
        return greater(mine, catalog.read("customer"), {"nation": "c_nationkey"}, ("least", "c_acctbal"), ["c_custkey"])


def _from(c: Catalog, table: str, alias: str) -> Select:
    return Select(c).from_(table, alias)


# sources and projection


@_query("SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def q_schema_file(c):
    again = Catalog(c.spark, c.store).load(json.loads(c.to_json())).freeze()
    q = _from(again, "nation", "n")
    q.inner_join("n").to("region", "r").on("n.n_regionkey = r.r_regionkey")
    return q.select("r", ["name"]).select("n", ["name"])


@_query("SELECT n_name, n_regionkey FROM nation")
def q_select_unprefixed(c):
    return _from(c, "nation", "n").select("n", ["n_name", "n_regionkey"], auto_prefix=False)


@_query("SELECT c_custkey AS _computed_host_key, o_orderkey, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey")
def q_rel_projection(c):
    m = _own(c)
    return m.table("customer").relations["orders"].batch(m).select(HOST_KEY, "o_orderkey", "o_totalprice")


@_query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def q_sub_factory(c):
    return select(c, lambda q: q.from_("nation", "n").select("n", ["nationkey", "name"]).where(Filters().eq("n.regionkey", 1)))


# filters


@_query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 AND o_custkey < 500 AND o_totalprice < 300000")
def q_bool_flatten(c):
    f = Filters().eq("orderstatus", "F").and_(lambda g: g.gt("totalprice", 1000).and_(lambda h: h.lt("custkey", 500))).lt("totalprice", 300000)
    return _from(c, "orders", "o").select("o", ["orderkey"]).where(f)


@_query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def q_bool_empty_group(c):
    return _from(c, "orders", "o").select("o", ["orderkey"]).where(Filters()).where(Filters().sub_group().eq("orderstatus", "P"))


@_query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR (o_totalprice > 300000 AND o_orderpriority = '5-LOW')")
def q_filter_sub_group(c):
    q = TableQuery(c, "orders").where_orderstatus_eq("P")
    q.or_(q.sub_group().where_totalprice_gt(300000).where_orderpriority_eq("5-LOW").filters)
    return q.find().df.select("o_orderkey")


@_query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'")
def q_filter_bare_word(c):
    return _from(c, "orders", "o").select("o", ["orderkey"]).where(Filters.from_text("orderstatus eq F and orderpriority neq 5-LOW", {}))


@_query("SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'O'")
def q_scope_table(c):
    f = Filters(TableScope(c.table("orders"), "o")).gt("totalprice", 200000).eq("o.orderstatus", "O")
    return _from(c, "orders", "o").select("o", ["orderkey"]).where(f)


@_query("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000 AND c_mktsegment = 'BUILDING'")
def q_scope_multi(c):
    f = Filters(MultiScope(TableScope(c.table("orders"), "o"), TableScope(c.table("customer"), "c"))).gt("totalprice", 200000).eq("c.mktsegment", "BUILDING")
    q = _from(c, "orders", "o").select("o", ["orderkey"])
    q.inner_join("o").to("customer", "c").on("o.o_custkey = c.c_custkey")
    return q.where(f)


@_query("SELECT * FROM (VALUES ('other table', 'FilterError'), ('sensitive', 'FilterError'), ('sensitive allowed', NULL), ('no column', 'FilterError'), ('expression', 'FilterError')) AS t(name, error)")
def q_scope_refusals(c):
    t = c.table("customer")
    scope = lambda **o: Filters(TableScope(t, "c", **o))
    return _refused(c, **{"other table": lambda: scope().eq("o.orderkey", 1), "sensitive": lambda: scope().gt("acctbal", 1), "sensitive allowed": lambda: scope(allow_sensitive=True).gt("acctbal", 1), "no column": lambda: scope().eq("nope", 1), "expression": lambda: scope().where("1 = 1")})


@_query("SELECT event_id FROM events WHERE json_exists(props, '$.k') AND NOT json_exists(props, '$.z')")
def q_filter_has_key(c):
    return _from(c, "events", "e").select("e", ["event_id"]).where(Filters().has_key("e.props", "k")).where(~jsonops.has_key(F.col("e.props"), "z"))


@_query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-17' AND o_totalprice > 1234.50 AND o_orderstatus IN ('F', 'O')")
def q_bind_types(c):
    q = _from(c, "orders", "o").select("o", ["orderkey"]).bind_all({"d": dt.date(1995, 6, 17), "p": Decimal("1234.50"), "s": ["F", "O"]})
    return q.where("o.o_orderdate >= :d AND o.o_totalprice > :p AND o.o_orderstatus IN (:s)")


@_query("SELECT n_name FROM nation WHERE n_regionkey = 2 AND n_nationkey > 5")
def q_bind_positional(c):
    return run_sql(c.spark, "SELECT n_name FROM nation WHERE n_regionkey = ? AND n_nationkey > ?", [2, 5], c)


@_query("SELECT n_name FROM nation WHERE n_regionkey = 2 AND n_nationkey > 5")
def q_bind_merge(c):
    b = Bindings().bind_named("r", 2).merge(Bindings().bind_named("k", 5))
    return run_sql(c.spark, "SELECT n_name FROM nation WHERE n_regionkey = :r AND n_nationkey > :k", b, c)


# joins, groups, aliases


@_query("SELECT r_name, n_name FROM region LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 0) ON true UNION ALL SELECT r_name, n_name FROM region RIGHT JOIN nation ON true")
def q_join_outer_unconditioned(c):
    none = _from(c, "nation", "n").where(Filters().lt("n.nationkey", 0))
    a = _from(c, "region", "r").select("r", ["name"])
    a.left_join("r").to(none, "x")
    b = _from(c, "region", "r").select("r", ["name"])
    b.right_join("r").to("nation", "n")
    return a.select("x", ["n_name"]).to_df().unionByName(b.select("n", ["name"]).to_df())


@_query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def q_group_rollup(c):
    return _from(c, "orders", "o").select("o", ["orderstatus", "orderpriority"]).select(None, ["count(*) AS n", "max(o.o_totalprice) AS most"]).rollup("o.orderstatus", "o.orderpriority")


@_query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority) HAVING count(*) > 100")
def q_group_cube(c):
    return _from(c, "orders", "o").select("o", ["orderstatus", "orderpriority"]).select(None, ["count(*) AS n"]).group_by("CUBE(o.orderstatus, o.orderpriority)").having("count(*) > 100")


@_query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def q_grouping_sets(c):
    return _from(c, "orders", "o").select("o", ["orderstatus", "orderpriority"]).select(None, ["count(*) AS n"]).grouping_sets(["o.orderstatus"], ["o.orderpriority"], [])


@_query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def q_group_on_client(c):
    seen = Counter(k for k, _ in TableQuery(c, "nation").find().group_by("n_regionkey"))
    return _rows(c, list(seen.items()), "n_regionkey int, n long")


@_query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def q_alias_generated(c):
    q = Select(c).from_("nation")
    a = q.alias_of("nation")
    q.inner_join("nation").to("region").on(f"{a}.n_regionkey = {q.alias_of('region') if 'region' in q.main_alias else '_a2'}.r_regionkey")
    return q.select("nation", ["name"]).select("region", ["name"])


@_query("SELECT * FROM (VALUES ('used twice', 'QueryError'), ('bad name', 'QueryError'), ('unknown table', 'SchemaError'), ('not in query', 'QueryError'), ('sub-query without', 'QueryError'), ('by full name', NULL)) AS t(name, error)")
def q_alias_rules(c):
    q = _from(c, "nation", "n")
    return _refused(c, **{"used twice": lambda: _from(c, "nation", "n").from_("region", "n"), "bad name": lambda: _from(c, "nation", "1 n"), "unknown table": lambda: _from(c, "nope", "n"), "not in query": lambda: q.alias_of("region"), "sub-query without": lambda: Select(c).from_(q), "by full name": lambda: q.alias_of(c.table("nation"))})


@_query("SELECT true AS table_, true AS alias_, false AS other_alias, false AS joined")
def q_in_from(c):
    q = _from(c, "nation", "n")
    q.inner_join("n").to("region", "r").on("n.n_regionkey = r.r_regionkey")
    return _rows(c, [(q.in_from("nation"), q.in_from("nation", "n"), q.in_from("nation", "m"), q.in_from("region"))], "table_ boolean, alias_ boolean, other_alias boolean, joined boolean")


# pages


@_query("SELECT max(o_orderkey) AS next_cursor, count(*) AS n, true AS has_more, 'o_orderkey' AS cursor_column FROM (SELECT o_orderkey FROM orders WHERE o_orderkey > 50 ORDER BY o_orderkey LIMIT 20)")
def q_cursor_metadata(c):
    p = TableQuery(c, "orders").find(Options.parse({"cursor": 50, "max": 20})).page()
    return _rows(c, [(p["next_cursor"], len(p["items"]), p["has_more"], p["cursor_column"])], "next_cursor long, n long, has_more boolean, cursor_column string")


@_query("SELECT * FROM (VALUES ('page and cursor', 'QueryError'), ('page', NULL), ('cursor', NULL), ('max', 'QueryError'), ('order', 'QueryError')) AS t(name, error)")
def q_page_or_cursor(c):
    return _refused(c, **{"page and cursor": lambda: Options.parse({"page": 1, "cursor": 2}), "page": lambda: Options.parse({"page": 1}), "cursor": lambda: Options.parse({"cursor": 1}), "max": lambda: Options.parse({"max": 2001}), "order": lambda: Options.parse({"order_by": "a;b"})})


@_query("SELECT count(*) AS total, 30 AS on_page, 3 AS page FROM orders WHERE o_orderstatus = 'F'")
def q_page_totals(c):
    found = TableQuery(c, "orders").where_orderstatus_eq("F").find(Options.parse({"page": 3, "max": 30, "order_by": "orderkey"}))
    return _rows(c, [(found.total(), found.count(), found.page()["page"])], "total long, on_page int, page int")


@_query("SELECT n_nationkey, n_name FROM nation")
def q_lazy_scan(c):
    return _rows(c, [(r.n_nationkey, r.n_name) for r in TableQuery(c, "nation").find().lazy()], "n_nationkey int, n_name string")


@_query("SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0 AND c_mktsegment = 'BUILDING'")
def q_soft_deleted_left_out(c):
    return TableQuery(_own(c), "customer").where_c_mktsegment_eq("BUILDING").find().df.select("c_custkey")


@_query("SELECT c_custkey, c_custkey % 7 = 0 AS deleted FROM customer")
def q_soft_deleted_included(c):
    return TableQuery(_own(c), "customer").include_soft_deleted().find().df.select("c_custkey", "deleted")


@_query("SELECT event_id FROM events WHERE event_type <> 'click' AND CAST(json_extract_string(props, '$.k') AS DOUBLE) > 90")
def q_filter_by(c):
    return TableQuery(c, "events").filter_by("event_type", "neq", "click").filter_by("props", "gt", 90, "k").find().df.select("event_id")


@_query("SELECT o_orderkey FROM orders WHERE o_custkey < 100 AND (o_orderstatus = 'F' OR o_totalprice > 0)")
def q_ensure_only(c):
    o = Options.parse({"filters": ["orderstatus", "eq", "F", "or", "totalprice", "gt", 0], "max": 2000}).ensure_only(["custkey", "lt", 100])
    o.max = None
    return TableQuery(c, "orders").find(o).df.select("o_orderkey")


@_query("SELECT o_orderkey FROM orders WHERE o_custkey = 7 ORDER BY o_orderkey DESC LIMIT 5")
def q_option_scopes(c):
    o = Options.parse({"filters": {"custkey": 7}, "scopes": {"orders": {"max": 5, "order_by": "orderkey:desc", "filters": {"custkey": 7}}}}).scoped("orders")
    return TableQuery(c, "orders").find(o).df.select("o_orderkey")


@_query("SELECT * FROM (VALUES ('sensitive', 'FilterError'), ('unknown', 'FilterError'), ('raw', 'FilterError'), ('fine', NULL)) AS t(name, error)")
def q_untrusted_filters(c):
    q = lambda f: TableQuery(c, "customer").find(Options.parse({"filters": f}))
    return _refused(c, sensitive=lambda: q({"acctbal": 1}), unknown=lambda: q(["nope", "eq", 1]), raw=lambda: q("1 = 1"), fine=lambda: q(["custkey", "gt", 1]))


# JSON and dates


@_query("SELECT n_nationkey, to_json({'k': n_nationkey, 'name': n_name})::VARCHAR AS j FROM nation")
def q_json_encode(c):
    return _from(c, "nation", "n").select("n", ["nationkey"]).select(None, [jsonops.encode(F.struct(F.col("n.n_nationkey").alias("k"), F.col("n.n_name").alias("name"))).alias("j")])


@_query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def q_json_revive(c):
    return _from(c, "events", "e").select("e", ["event_id"]).select(None, [jsonops.decode(F.col("e.props"), "k long")["k"].alias("k")])


@_query("SELECT event_id, json_merge_patch(props, '{\"a\":{\"b\":1}}')::VARCHAR AS added, '{\"t\":\"x\"}' AS replaced FROM events")
def q_json_patch(c):
    add, swap = jsonops.JsonPatch().set("a.b", 1), jsonops.JsonPatch().remove("k").remove("none.here").set("t", "x")
    return c.read("events").select("event_id", add.apply_to(F.col("props")).alias("added"), swap.apply_to(F.col("props")).alias("replaced"))


@_query("SELECT * FROM (VALUES ('user.role', 2), ('tag', 1), ('[''meta.key'']', 1), ('a[''b.c''].d', 3)) AS t(path, n)")
def q_json_path_text(c):
    return _rows(c, [(print_path(parse_path(p)), len(parse_path(p))) for p in ("user.role", "tag", "['meta.key']", "a['b.c'].d")], "path string, n int")


@_query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS at, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS text FROM events")
def q_dates(c):
    d = ty.make({"type": "date"})
    at = d.encode(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return c.read("events").select("event_id", at.alias("at"), d.format_column(at).alias("text"))


# changes


@_query("SELECT 5 AS r_regionkey, 'ATLANTIS' AS r_name UNION ALL SELECT 6, 'MU'")
def q_dml_insert_returning(c):
    m = Catalog(c.spark, MemoryStore(c.spark, {"region": c.read("region")})).load({"region": {**SCHEMA["region"], "relations": {}}}).freeze()
    return Insert(m, "region").values([{"regionkey": 5, "name": "ATLANTIS"}, {"regionkey": 6, "name": "MU"}]).returning("regionkey", "name").execute()


@_query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 400000")
def q_dml_delete_returning(c):
    return Delete(_own(c), "orders").where(Filters().gt("o_totalprice", 400000)).returning("o_orderkey", "o_orderstatus").execute()


@_query("SELECT CAST(n_nationkey + 100 AS BIGINT) AS id, n_name AS name FROM nation UNION ALL SELECT 125, 'a' UNION ALL SELECT 126, 'b'")
def q_dml_auto_increment(c):
    m = Catalog(c.spark)
    m.table_builder("t", lambda t: t.id().string("name"))
    m.store = MemoryStore(c.spark, {"t": c.read("nation").select((F.col("n_nationkey") + 100).cast("long").alias("id"), F.col("n_name").alias("name"))})
    return Insert(m.freeze(), "t").values([{"name": "a"}, {"name": "b"}]).change().new


@_query("SELECT * FROM (VALUES ('same key', 'QueryError'), ('twice', 'QueryError'), ('no such nation', 'QueryError'), ('moved to none', 'QueryError'), ('still referred to', 'QueryError'), ('fine', NULL)) AS t(name, error)")
def q_dml_constraints(c):
    m = _own(c)
    row = {"c_custkey": 10**9, "c_name": "x", "c_nationkey": 1, "c_acctbal": 0.5, "c_mktsegment": "x"}
    add = lambda *rows: Insert(m, "customer").values(list(rows)).execute()
    return _refused(c, **{
        "same key": lambda: add({**row, "c_custkey": 1}), "twice": lambda: add(row, row), "no such nation": lambda: add({**row, "c_nationkey": 99}),
        "moved to none": lambda: Update(m, "customer").set({"c_nationkey": 99}).execute(), "still referred to": lambda: Delete(m, "nation").checked().execute(), "fine": lambda: add(row),
    })


@_query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def q_dml_cascade(c):
    m = _own(c)
    gone = m.read("customer").where("c_mktsegment = 'BUILDING'")
    return next(x.new for x in dml.cascade(m, m.table("customer"), gone) if x.table.name == "orders").select("o_orderkey")


@_query("SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0")
def q_constraint_orphans(c):
    m = _own(c)
    moved = m.read("customer").withColumn("c_nationkey", F.when(F.col("c_custkey") % 3 == 0, 99).otherwise(F.col("c_nationkey")))
    return next(iter(dml.orphans(m, m.table("customer"), moved).values())).select("c_custkey")


@_query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey HAVING count(*) > 1")
def q_constraint_duplicates(c):
    return dml.duplicate_keys(c.table("nation"), c.read("nation"), ["regionkey"]).select("n_regionkey", F.col("_n").alias("n"))


@_query("SELECT o_orderkey, 'orderstatus' AS broken FROM orders WHERE o_orderkey % 5 = 0")
def q_constraint_violations(c):
    df = c.read("orders").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "Z").otherwise(F.col("o_orderstatus"))).withColumn("o_orderdate", F.col("o_orderdate").cast("string"))
    return dml.violations(c.table("orders"), df).select("o_orderkey", F.array_join("_broken", ",").alias("broken"))


# relations


@_query("SELECT c_custkey, 'x' AS label, c_custkey AS o_custkey FROM customer WHERE c_custkey BETWEEN 1 AND 3")
def q_rel_fill(c):
    r = c.table("customer").relations["orders"]
    rows = [(i, r.fill({"custkey": i}, {"label": "x"})) for i in (1, 2, 3)]
    return _rows(c, [(i, x["label"], x["custkey"]) for i, x in rows], "c_custkey long, label string, o_custkey long")


@_query("SELECT a.c_custkey AS _computed_host_key, b.c_custkey FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND b.c_acctbal > a.c_acctbal")
def q_rel_virtual(c):
    m = _own(c)
    return m.table("customer").relations["richer"].batch(m, m.read("customer")).select(HOST_KEY, "c_custkey")


@_query("SELECT c_custkey FROM customer WHERE c_acctbal > 9000")
def q_collection(c):
    return Controller(_own(c), "customer").collection("rich").select("c_custkey")


@_query("SELECT * FROM (VALUES ('no key', 'SchemaError'), ('not soft', 'SchemaError'), ('nested', 'SchemaError'), ('fine', NULL)) AS t(name, error)")
def q_rel_rules(c):
    def build(link: dict | None) -> None:
        m = Catalog(c.spark)
        m.table_builder("a", lambda t: t.id().has_many("bs", "b", link))
        m.table_builder("b", lambda t: t.id().bigint("a_id", unsigned=True).morph("x"))
        m.freeze()

    return _refused(c, **{"no key": lambda: build(None), "not soft": lambda: build({"type": "morph", "prefix": "x"}), "nested": lambda: build({"type": "through", "pivot": "b", "host_to_pivot": {"type": "join", "steps": [{"join": "b"}]}}), "fine": lambda: build({"type": "columns", "columns": {"id": "a_id"}})})


# controllers, hooks, types


@_query("SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 AND c_mktsegment = 'BUILDING' THEN 'B' ELSE c_name END AS c_name FROM customer")
def q_controller_update(c):
    m = _own(c)
    Controller(m, "customer").update_all_items(["c_mktsegment", "eq", "BUILDING"], {"c_name": "B"})
    return m.read("customer").select("c_custkey", "c_name")


@_query("SELECT * FROM (VALUES ('missing', 'QueryError'), ('sensitive', 'Forbidden'), ('stopped', 'Forbidden'), ('no such hook', 'AttributeError')) AS t(name, error)")
def q_controller_refusals(c):
    m = _own(c)
    stop = Hooks().on_before_create(lambda v: False)
    return _refused(c, missing=lambda: Controller(m, "nation").add_item({"n_nationkey": 90}), sensitive=lambda: Controller(m, "customer").update_all_items(None, {"c_acctbal": 1.0}), stopped=lambda: Controller(m, "nation", stop).add_item({"n_nationkey": 90, "n_name": "x", "n_regionkey": 1}), **{"no such hook": lambda: Hooks().on_whatever(print)})


@_query("SELECT * FROM (VALUES (1, 'made', 90), (2, 'update', 90), (3, 'gone', 90)) AS t(i, what, n_nationkey)")
def q_hooks(c):
    m, seen = _own(c), []
    hooks = Hooks().on_after_entity_creation(lambda e: seen.append(("made", e.n_nationkey))).on_before_entity_update(lambda e: seen.append(("update", e.n_nationkey))).on_after_entity_deletion(lambda e: seen.append(("gone", e.n_nationkey)))
    k = Controller(m, "nation", hooks)
    k.add_item({"n_nationkey": 90, "n_name": "x", "n_regionkey": 1})
    k.update_one_item(["n_nationkey", "eq", 90], {"n_name": "y"})
    k.delete_one_item(["n_nationkey", "eq", 90])
    return _rows(c, [(i, *x) for i, x in enumerate(seen, 1)], "i int, what string, n_nationkey int")


@_query("SELECT n_nationkey, upper(n_name) AS n_name, 'n_name' AS dirty FROM nation WHERE n_nationkey = 3")
def q_entity_save(c):
    m = _own(c)
    e = Controller(m, "nation").get_item(["n_nationkey", "eq", 3])
    e.n_name = e.n_name.upper()
    new = Entity(m.table("nation"), {"n_nationkey": 3, "n_name": "", "n_regionkey": 0}, saved=True)
    new.n_name = "x"
    return m.read("nation").where("n_nationkey = 3").select("n_nationkey", F.lit(e.n_name).alias("n_name"), F.lit(",".join(new.dirty())).alias("dirty"))


@_query("SELECT * FROM (VALUES ('int', '12.9', '12'), ('int', 'a', NULL), ('bool', 'yes', NULL), ('bool', '1', 'True'), ('date', '2020-01-01', '1577836800'), ('decimal', '1.05', '1.05'), ('seven', 'seven', '7')) AS t(type, value, clean)")
def q_type_validators(c):
    seven = ty.make({"type": "int"})
    seven.pre = lambda s: s.accept(7) if s.value == "seven" else None
    out = []
    for name, value in (("int", "12.9"), ("int", "a"), ("bool", "yes"), ("bool", "1"), ("date", "2020-01-01"), ("decimal", "1.05"), ("seven", "seven")):
        try:
            out.append((name, value, str((seven if name == "seven" else ty.make({"type": name})).validate(value))))
        except ValueRefused:
            out.append((name, value, None))
    return _rows(c, out, "type string, value string, clean string")


# schemas


@_query("SELECT * FROM (VALUES (1, 'n_nationkey', 'int', false), (2, 'n_name', 'string', false), (3, 'n_regionkey', 'int', false)) AS t(i, name, type, nullable)")
def q_table_columns(c):
    return _rows(c, [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(c.table("nation").struct(), 1)], "i int, name string, type string, nullable boolean")


@_query("SELECT * FROM (VALUES (1, 'column_deleted', 'nation'), (2, 'column_renamed', 'nation'), (3, 'column_type_changed', 'nation'), (4, 'column_added', 'nation'), (5, 'index_added', 'nation')) AS t(i, kind, on_table)")
def q_diff_actions(c):
    def of(columns: dict, **more: Any) -> Catalog:
        return Catalog(c.spark).load({"nation": {"columns": columns, "constraints": [{"type": "primary_key", "columns": ["k"]}], **more}}).freeze()

    old = of({"k": {"type": "int"}, "a": {"type": "string"}, "b": {"type": "string"}, "n": {"type": "int"}})
    new = of({"k": {"type": "int"}, "x": {"type": "string", "old_name": "a"}, "n": {"type": "bigint"}, "z": {"type": "int", "default": 1}}, indexes=[{"columns": ["x"], "type": "btree"}])
    return _rows(c, [(i, a.kind, a.table) for i, a in enumerate(diff(old, new), 1)], "i int, kind string, on_table string")


@_query("SELECT n_nationkey AS k, n_name AS name, 7 AS more FROM nation")
def q_migration_run(c):
    def of(**more: dict) -> Catalog:
        return Catalog(c.spark).load({"t": {"columns": {"k": {"type": "int"}, "name": {"type": "string"}, **more}, "constraints": [{"type": "primary_key", "columns": ["k"]}]}}).freeze()

    old, new = of(), of(more={"type": "int", "default": 7})
    old.store = MemoryStore(c.spark, {"t": c.read("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))})
    Runner([Migration.between(1, "more", old, new)], MemoryLedger(), old.store).up()
    return old.store.frames["t"]


@_query("SELECT * FROM (VALUES (1, true), (2, true), (3, false)) AS t(version, done)")
def q_migration_status(c):
    r = Runner([Migration(v, f"m{v}", lambda s: None, lambda s: None) for v in (3, 1, 2)], MemoryLedger())
    r.up()
    r.rollback()
    return _rows(c, list(r.status().items()), "version int, done boolean")


@_query("SELECT 'class Region:\n    \"\"\"A row of region.\"\"\"\n\n    regionkey: int\n    name: str\n' AS python")
def q_generated_class(c):
    return _rows(c, [(codegen.generate(c, "python")["region"],)], "python string")


@_query("SELECT 'nations' AS name, count(*) AS n, true AS timed FROM nation")
def q_query_log(c):
    log = QueryLog()
    n = log.run(_from(c, "nation", "n").to_df(), lambda d: d.count(), "nations")
    return _rows(c, [(log.entries[0].name, n, log.entries[0].duration >= 0)], "name string, n long, timed boolean")

