import pytest
from pyspark.sql import functions as F

from marlspike.catalog import Catalog
from marlspike.errors import FilterError, Forbidden, QueryError, SchemaError
from marlspike.operators.dml import Insert, SoftDelete
from marlspike.operators.paging import Options, TableQuery, identity_key, parse_order, redact
from marlspike.plans.filters import Filters
from marlspike.repository import Controller, Entity, Hooks
from marlspike.streaming.tables import filter_stream, read_stream, select_stream
from tests.bank import BANK, bank, publishing


@pytest.fixture
def c(spark):
    return bank(spark)


def test_options():
    o = Options.parse({"page": "3", "max": 5, "order_by": "a:desc|b|a", "relations": "x|y|x", "_columns": "a|b", "filters": {"a": 1}, "scopes": {"s": {"max": 7}}, "extra": 1})
    assert (o.page, o.max, o.start(), o.order, o.relations, o.columns, o.form) == (3, 5, 10, {"a": True, "b": True}, ["x", "y"], ["a", "b"], {"extra": 1})
    assert o.scoped("s").max == 7 and o.scoped("none").max == 10 and Options.parse({}).page == 1
    assert parse_order("a:DESC") == {"a": False}
    for bad in ({"page": 0}, {"page": "x"}, {"max": 2001}, {"max": -1}, {"page": 1, "cursor": 2}, {"order_by": "a;b"}, {"order_by": "a:up"}, {"scopes": 1}):
        with pytest.raises(QueryError):
            Options.parse(bad)


def test_pages(c):
    q = TableQuery(c, "transactions")
    p = q.find(Options.parse({"max": 3, "order_by": "amount:desc"})).page()
    assert [r.transaction_id for r in p["items"]] == [4, 3, 2] and p["total"] == 4
    last = q.find(Options.parse({"max": 3, "page": 2, "order_by": "amount:desc"}))
    assert last.total() == 4 and last.count() == 1 and last.first().transaction_id == 1
    beyond = q.find(Options.parse({"max": 3, "page": 9}))
    assert beyond.count() == 0 and beyond.total() == 4
    assert [r.transaction_id for r in q.find(Options(max=2, order={"id": True})).lazy()] == [1, 2] and len(list(q.find().lazy())) == 4
    assert sorted(k for k, _ in q.find().group_by("transaction_state")) == ["confirmed", "confirmed", "in_error", "refunded"]
    with pytest.raises(QueryError):
        q.find().items()


def test_cursors(c):
    q = TableQuery(c, "transactions")
    p = q.find(Options.parse({"cursor": None, "max": 3})).page()
    assert [r.transaction_id for r in p["items"]] == [1, 2, 3] and (p["next_cursor"], p["has_more"], p["cursor_column"]) == (3, True, "transaction_id")
    r = q.find(Options.parse({"cursor": 3, "max": 3}))
    assert [x.transaction_id for x in r.page()["items"]] == [4] and r.page()["next_cursor"] is None and r.total() == 1
    down = q.find(Options.parse({"cursor": 4, "cursor_direction": "desc", "max": 2, "_columns": "reference"})).page()
    assert [x.transaction_reference for x in down["items"]] == ["r3", "r2"] and down["next_cursor"] == 2
    by = q.find(Options.parse({"cursor": "r1", "cursor_column": "reference", "max": 2, "order_by": "id"})).page()
    assert [x.transaction_id for x in by["items"]] == [2, 3]
    two = Catalog(c.spark, c.store)
    two.table_builder("pairs", lambda t: t.int("a").int("b").primary("a", "b"))
    with pytest.raises(QueryError):
        TableQuery(two, "pairs").find(Options.parse({"cursor": 1}))


def test_table_query(spark, c):
    ids = lambda q: sorted(r[0] for r in q.select().to_df().collect())
    q = lambda: TableQuery(c, "clients")
    assert ids(q().where_first_name_eq("Ann")) == [1] and ids(q().where_id_in([1, 3])) == [1, 3] and ids(q().where_valid_is_true()) == [1, 2, 3]
    assert ids(q().where_data_has_key("tag")) == [1, 2] and ids(q().where_data_eq("vip", "tag")) == [1] and ids(q().filter_by("data", "like", "adm%", "user.role")) == [1]
    assert "where_first_name_like" in q().helpers() and "where_first_name_is_null" not in q().helpers()
    for bad in ("where_nope_eq", "where_first_name", "other"):
        with pytest.raises(AttributeError):
            getattr(q(), bad)
    with pytest.raises(QueryError):
        q().where_valid_like("x")
    with pytest.raises(FilterError):
        q().find(Options.parse({"filters": {"email": "x"}}))
    with pytest.raises(QueryError):
        q().find(Options.parse({"_columns": "pin"}))
    only = Options.parse({"filters": ["id", "gt", 0, "or", "id", "gt", 1]}).ensure_only(["first_name", "eq", "Bob"])
    assert [r.client_id for r in q().find(only).items()] == [2]
    one = q()
    assert ids(one.where_id_eq(3).or_(one.sub_group().where_first_name_eq("Ann").filters)) == [1, 3]
    with pytest.raises(FilterError):
        q().or_(one.sub_group().where_id_eq(1).filters)  # of another query
    p = publishing(spark)
    Insert(p, "users").values([{"name": "a"}, {"name": "b"}]).execute()
    SoftDelete(p, "users").where(Filters().eq("name", "a")).execute()
    u = lambda: TableQuery(p, "users")
    assert ids(u()) == [2] and ids(u().include_soft_deleted()) == [1, 2]
    assert u().update({"name": "z"}).change().affected.count() == 1 and u().delete().change().affected.count() == 2 and u().where_id_eq(2).soft_delete().change().affected.count() == 1


def test_redaction_and_keys(c):
    df = redact(c.table("clients"), c.read("clients"))
    assert "client_pin" not in df.columns and {r.client_email for r in df.collect()} == {"***"}
    assert sorted(r[0] for r in c.read("accounts").select(identity_key(c.table("accounts"))).collect()) == ["1", "2", "3"]


def test_controller(c):
    seen = []
    hooks = Hooks().on_after_entity_creation(lambda e: seen.append(("made", e.id))).on_before_entity_update(lambda e: seen.append(("update", e.first_name))).on_after_entity_deletion(lambda e: seen.append(("gone", e.id)))
    k = Controller(c, "clients", hooks)
    made = k.add_item({"first_name": "Dee", "last_name": "D", "gender": "female"})
    assert made.id == 4 and made.is_saved() and made.data == "{}"
    assert k.update_one_item(["id", "eq", 4], {"last_name": "E"}).last_name == "E" and k.get_item(["id", "eq", 4]).last_name == "E"
    assert k.update_one_item(["id", "eq", 99], {"last_name": "E"}) is None and k.get_item(["id", "eq", 99]) is None
    assert k.update_all_items(["gender", "eq", "female"], {"valid": False}) == 2 and k.get_all_items(Options.parse({"filters": {"valid": False}})).count() == 2
    assert k.get_all_items_custom(lambda q: q.where_first_name_like("%e%")).df.count() == 1
    assert k.delete_one_item(["id", "eq", 4]).id == 4 and c.read("clients").count() == 3 and k.delete_one_item(["id", "eq", 4]) is None
    assert seen == [("made", 4), ("update", "Dee"), ("gone", 4)]
    with pytest.raises(QueryError, match="last_name"):
        k.add_item({"first_name": "x", "gender": "male"})
    for bad in (lambda: k.add_item({"id": 5, "first_name": "x", "last_name": "x", "gender": "male"}), lambda: k.delete_all_items(), lambda: k.update_one_item(["id", "eq", 1], {"id": 9}), lambda: k.update_one_item(["id", "eq", 1], {"pin": "1"}), lambda: k.update_all_items(None, {"email": "1"})):
        with pytest.raises(Forbidden):
            bad()
    assert Controller(c, "clients", Hooks().on_delete_all(lambda q: True)).delete_all_items(["id", "gt", 1]) == 2
    stop = Hooks().on_before_create(lambda v: False).on_before_create(lambda v: True)
    with pytest.raises(Forbidden):
        Controller(c, "clients", stop).add_item({})
    with pytest.raises(AttributeError):
        Hooks().on_whatever(print)


def test_entities(c):
    e = Entity(c.table("accounts"), {"account_id": 1, "label": "main", "balance": None}, saved=True)
    assert e.is_partial() and e.is_saved() and e.identity_key() == "1" and e.identity_filters() == ["id", "eq", 1]
    e.label = "main"
    assert not e.dirty()
    e.label = "new"
    assert e.dirty() == {"label": "new"} and not e.is_saved()
    with pytest.raises(QueryError):
        _ = e.currency_code
    with pytest.raises(AttributeError):
        _ = e.nope
    e.save(Controller(c, "accounts"))
    assert Controller(c, "accounts").get_item(["id", "eq", 1]).label == "new"
    n = Entity(c.table("currencies")).hydrate({"code": "GBP", "name": "Pound", "symbol": "£"})
    assert n.save(Controller(c, "currencies")).is_saved() and c.read("currencies").count() == 3
    s = Entity(c.table("clients"), {"pin": "1", "email": "x", "id": 1})
    assert s.to_dict() == {"email": "***", "id": 1} and s.to_dict(hide_sensitive=False)["pin"] == "1"


def test_relatives(c):
    k = Controller(c, "clients")
    ann = k.get_item(["id", "eq", 1])
    assert k.count_relatives(ann, "accounts") == 2 and k.relatives(ann, "transactions").count() == 3 and k.relatives_batch(c.read("clients"), "accounts").count() == 3
    assert k.create_relative(ann, "accounts", {"label": "third", "currency_code": "EUR"}).client_id == 1
    assert k.update_relative(ann, "accounts", ["label", "eq", "third"], {"label": "3"}).label == "3" and k.delete_relative(ann, "accounts", ["label", "eq", "3"]).label == "3"
    assert Controller(c, "accounts").relative(Entity(c.table("accounts"), {"client_id": 2}), "client").first_name == "Bob"
    assert {r.total for r in k.count_relatives_batch(c.read("clients").where("client_id < 3"), "accounts").collect()} == {1, 2}
    with pytest.raises(QueryError):
        k.relation("nope")


def test_virtual_relations_and_collections(spark, c):
    d = Catalog(spark, c.store).load(BANK)

    class Rich:
        def __call__(self, catalog, row, **options):
            return catalog.read("accounts").where(F.col("account_balance") > row["floor"])

        def batch(self, catalog, hosts, **options):
            return catalog.read("accounts")

    b = d.table_builder("clients")
    b.virtual_relation("rich", Rich()).collection("named", lambda catalog, o: catalog.read("clients").where("client_first_name = 'Bob'"))
    with pytest.raises(SchemaError):
        b.collection("named", None)
    k = Controller(d, "clients")
    assert k.relation("rich").of(d, {"floor": 8}).count() == 1 and k.relation("rich").batch(d, None).count() == 3 and k.collection("named").count() == 1
    with pytest.raises(QueryError):
        k.collection("nope")


def test_streams(spark, c, tmp_path):
    c.read("clients").write.parquet(f"{tmp_path}/in")
    stream = read_stream(c, "clients", f"{tmp_path}/in")
    out = filter_stream(TableQuery(c, "clients").where_first_name_in(["Ann", "Bob"]), stream)
    agg = select_stream(c, stream, "k", c.table("clients")).select("k", ["gender"]).select(None, ["count(*) AS n"]).group_by("k.gender").to_df()
    for name, df, mode in (("people", out, "append"), ("genders", agg, "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("people").count() == 2 and spark.table("genders").count() == 3
    with pytest.raises(QueryError):
        select_stream(c, stream, "k").limit(1).to_df()
