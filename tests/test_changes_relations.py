import pytest
from pyspark.sql import functions as F

from marlspike.catalog import Catalog
from marlspike.errors import QueryError, SchemaError, ValueRefused
from marlspike.operators import dml
from marlspike.operators.dml import Delete, Insert, SoftDelete, Update
from marlspike.operators.relations import HOST_KEY
from marlspike.operators.select import Select, expr
from marlspike.plans.filters import Filters
from marlspike.sources.store import JdbcStore, MemoryStore, ParquetStore
from tests.bank import bank, publishing


@pytest.fixture
def c(spark):
    return bank(spark)


def pairs(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_insert(c):
    ids = Insert(c, "currencies").values({"code": "GBP", "name": "Pound", "symbol": "£"}).returning("code").execute().collect()
    assert [r.ccy_code for r in ids] == ["GBP"] and c.read("currencies").count() == 3
    new = Insert(c, "clients").values([{"first_name": "D", "last_name": "D", "gender": "male"}] * 2).execute().collect()
    assert [r.client_id for r in new] == [4, 5] and new[0].client_data == "{}" and new[0].client_valid is True and new[0].client_created_at > 0
    for bad in (lambda: Insert(c, "currencies").values([]), lambda: Insert(c, "currencies").values([{"code": "A"}, {"name": "B"}]), lambda: Insert(c, "currencies").change()):
        with pytest.raises(QueryError):
            bad()
    with pytest.raises(ValueRefused):
        Insert(c, "clients").values({"first_name": "x", "last_name": "y", "gender": "?"}).change()
    q = Select(c).from_("currencies", "y").select("y", ["name", "symbol"]).select(None, ["concat(y.ccy_code, '2') AS ccy_code"])
    assert Insert(c, "currencies").from_query(q).change().new.count() == 6
    made = Insert(c, "clients").from_query(c.read("clients").drop("client_id")).change().affected
    assert made.count() == 5 and made.select("client_id").distinct().count() == 5 and made.agg(F.min("client_id")).first()[0] >= 6


def test_conflicts(c):
    row = lambda code, name: {"code": code, "name": name, "symbol": "s"}
    done = Insert(c, "currencies").values([row("EUR", "x"), row("NEW", "first"), row("NEW", "second")]).on_conflict_ignore().change()
    assert pairs(done.new, "ccy_code", "ccy_name") == [("EUR", "Euro"), ("NEW", "first"), ("USD", "Dollar")] and done.affected.count() == 1
    acc = lambda i, label: {"id": i, "client_id": 1, "label": label, "currency_code": "EUR"}
    assert pairs(Insert(c, "accounts").values([acc(9, "main"), acc(10, "new"), acc(1, "other")]).on_conflict_ignore().change().affected, "account_id") == [(10,)]
    done = Insert(c, "currencies").values([row("EUR", "x"), row("NEW", "y"), row("EUR", "last")]).on_conflict_update(["code"], ["name"]).change()
    assert pairs(done.new, "ccy_code", "ccy_name", "ccy_symbol") == [("EUR", "last", "€"), ("NEW", "y", "s"), ("USD", "Dollar", "$")] and done.affected.count() == 2
    done = Insert(c, "currencies").values(row("EUR", "all")).on_conflict_update().change()
    assert pairs(done.new, "ccy_code", "ccy_symbol") == [("EUR", "s"), ("USD", "$")]


def test_update(c):
    done = Update(c, "accounts").set({"label": "z"}).where(Filters().gt("balance", 5)).change()
    assert pairs(done.new, "account_id", "account_label") == [(1, "z"), (2, "z"), (3, "main")] and done.affected.count() == 2
    assert pairs(Update(c, "accounts", "a").set({"balance": expr("a.account_balance + 1"), "label": F.upper("a.account_label")}).change().new, "account_id", F.col("account_balance").cast("double"), "account_label") == [(1, 11.5, "MAIN"), (2, 8.0, "SAVE"), (3, 1.0, "MAIN")]
    assert pairs(Update(c, "accounts").set({"label": "z"}).order_by("accounts.balance DESC").limit(1).change().affected, "account_id") == [(1,)]
    assert Update(c, "clients").set({"first_name": "n"}).where(Filters().eq("pin", "x")).change().affected.count() == 0  # null is not true
    for bad in (lambda: Update(c, "accounts").change(), lambda: Update(c, "accounts").set({"label": "x"}).order_by("accounts.id").change()):
        with pytest.raises(QueryError):
            bad()


def test_delete(c):
    assert pairs(Delete(c, "accounts").where(Filters().eq("label", "main")).change().new, "account_id") == [(2,)]
    assert Delete(c, "accounts").change().new.count() == 0
    assert Delete(c, "clients").where(Filters().neq("pin", "x")).change().new.count() == 3  # rows with a null condition stay
    assert pairs(Delete(c, "transactions").order_by("transactions.amount").limit(2).change().new, "transaction_id") == [(3,), (4,)]
    d = Delete(c, "clients", "k")
    d.left_join("k").to("accounts", "a").on("k.client_id = a.account_client_id")
    assert pairs(d.where(Filters().is_null("a.id")).change().new, "client_id") == [(1,), (2,)]
    d = Delete(c, "clients", "k")
    d.inner_join("k").to("accounts", "a").on("k.client_id = a.account_client_id")
    assert pairs(d.change().new, "client_id") == [(3,)]


def test_soft_delete(spark):
    c = publishing(spark)
    Insert(c, "users").values([{"name": "a"}, {"name": "b"}]).execute()
    SoftDelete(c, "users", at=5).where(Filters().eq("name", "a")).execute()
    assert pairs(c.read("users"), "name", "deleted", "deleted_at") == [("a", True, 5), ("b", False, None)]
    assert SoftDelete(c, "users", at=9).change().affected.count() == 1
    with pytest.raises(QueryError):
        SoftDelete(c, "tags")


def test_constraints(c):
    t = c.table("accounts")
    bad = c.read("accounts").withColumn("account_client_id", F.when(F.col("account_id") == 3, 99).otherwise(1)).withColumn("account_label", F.when(F.col("account_id") == 2, "").otherwise("same"))
    assert [r._broken for r in dml.violations(t, bad).collect()] == [["label"]]
    assert dml.duplicate_keys(t, bad.withColumn("account_client_id", F.lit(1)), ["client_id", "label"]).count() == 1
    assert {k: v.count() for k, v in dml.orphans(c, t, bad).items()} == {"client_id->clients": 1, "currency_code->currencies": 0}
    gone = c.read("clients").where("client_id = 1")
    changes = {x.table.name: x for x in dml.cascade(c, c.table("clients"), gone)}
    assert pairs(changes["accounts"].new, "account_id") == [(3,)] and pairs(changes["transactions"].new, "transaction_id") == [(4,)]
    with pytest.raises(QueryError):
        dml.cascade(c, c.table("currencies"), c.read("currencies"))


def test_units_of_work(c):
    store, n = c.store, lambda: c.read("currencies").count()
    with pytest.raises(RuntimeError), store.unit():
        Delete(c, "currencies").execute()
        assert n() == 0
        raise RuntimeError
    assert n() == 2
    with store.unit():
        Insert(c, "currencies").values({"code": "A", "name": "A", "symbol": "A"}).execute()
        store.begin()
        Delete(c, "currencies").execute()
        store.rollback()
        assert n() == 3
    assert n() == 3
    with pytest.raises(QueryError):
        store.commit()


def test_parquet_versions(spark, tmp_path):
    c = Catalog(spark, ParquetStore(spark, str(tmp_path)))
    c.table_builder("notes", lambda t: t.id().string("body").index("body"))
    c.freeze()
    assert c.read("notes").count() == 0
    c.store.create(list(c.tables.values()))
    c.store.create(list(c.tables.values()))
    Insert(c, "notes").values([{"body": "a"}, {"body": "b"}]).execute()
    Update(c, "notes").set({"body": expr("upper(body)")}).where(Filters().eq("id", 2)).execute()
    assert pairs(c.read("notes"), "id", "body") == [(1, "a"), (2, "B")] and c.store.versions(c.table("notes")) == [1, 2, 3]


def test_two_writers_lose_nothing(spark, tmp_path):
    def catalog():
        c = Catalog(spark, ParquetStore(spark, str(tmp_path)))
        c.table_builder("notes", lambda t: t.id().string("body"))
        return c.freeze()

    a, b = catalog(), catalog()
    Insert(a, "notes").values({"body": "first"}).execute()
    late = Insert(b, "notes").values({"body": "late"}).change()
    Insert(a, "notes").values({"body": "second"}).execute()
    with pytest.raises(QueryError, match="has changed"):
        b.store.write(b.table("notes"), late.new)
    # both have seen the same versions: only one gets the next one
    t, seen = a.table("notes"), a.store.versions(a.table("notes"))
    other = ParquetStore(spark, str(tmp_path))
    other.versions = lambda table: seen
    a.store.publish(t, spark.createDataFrame([(7, "one")], t.struct()))
    with pytest.raises(QueryError, match="someone else"):
        other.publish(t, spark.createDataFrame([(8, "two")], t.struct()))
    assert pairs(b.read("notes"), "id", "body") == [(7, "one")] and not [x for x in (tmp_path / "notes").iterdir() if "staged" in x.name]
    (tmp_path / "notes" / "v4.claim").write_text("of one that broke off")
    with pytest.raises(QueryError, match="someone else"):
        Insert(b, "notes").values({"body": "x"}).execute()
    b.store.release(t)
    Insert(b, "notes").values({"body": "x"}).execute()
    assert pairs(a.read("notes"), "body") == [("one",), ("x",)]


def test_changes_keep_keys_and_references(c):
    acc = {"client_id": 3, "label": "new", "currency_code": "EUR"}
    for bad in (
        lambda: Insert(c, "currencies").values({"code": "EUR", "name": "x", "symbol": "x"}).execute(),
        lambda: Insert(c, "currencies").values([{"code": "A", "name": "x", "symbol": "x"}] * 2).execute(),
        lambda: Insert(c, "accounts").values({**acc, "client_id": 1, "label": "main"}).execute(),
        lambda: Insert(c, "accounts").values({**acc, "client_id": 9}).execute(),
        lambda: Insert(c, "accounts").values({**acc, "currency_code": "XXX"}).execute(),
        lambda: Update(c, "accounts").set({"label": "same"}).execute(),
        lambda: Update(c, "accounts").set({"client_id": 9}).where(Filters().eq("id", 1)).execute(),
        lambda: Delete(c, "currencies").where(Filters().eq("code", "EUR")).checked().execute(),
    ):
        with pytest.raises(QueryError):
            bad()
    assert c.read("currencies").count() == 2 and c.read("accounts").count() == 3
    Insert(c, "accounts").values(acc).execute()
    Delete(c, "clients").where(Filters().eq("id", 1)).checked().execute()  # takes its accounts and their transactions along
    assert pairs(c.read("accounts"), "account_id") == [(3,), (4,)] and pairs(c.read("transactions"), "transaction_id") == [(4,)]
    Insert(c, "currencies").values({"code": "EUR", "name": "x", "symbol": "x"}).checked(False).execute()
    assert c.read("currencies").count() == 3


def test_jdbc_options(spark):
    s = JdbcStore(spark, "postgresql", "h", "db", user="u", password="p", numPartitions="4", lowerBound="0", upperBound="9")
    c = Catalog(spark, s)
    c.table_builder("notes", lambda t: t.id(), column_prefix="note", prefix="app")
    o = s.read_options(c.freeze().table("notes"))
    assert o["url"] == "jdbc:postgresql://h:5432/db" and o["dbtable"] == "app_notes" and o["partitionColumn"] == "note_id" and o["user"] == "u"
    assert JdbcStore(spark, "sqlite", "/x.db").options["url"] == "jdbc:sqlite:/x.db" and ":3306/" in JdbcStore(spark, "mysql", "h", "d").options["url"]
    with pytest.raises(QueryError):
        JdbcStore(spark, "oracle", "h")


def test_relations(c):
    r = c.table("clients").relations["accounts"]
    assert pairs(r.of(c, {"id": 1}), "account_id") == [(1,), (2,)] and r.of(c, {"id": None}).count() == 0
    assert pairs(r.batch(c), HOST_KEY, "account_id") == [(1, 1), (1, 2), (2, 3)] and pairs(r.count_batch(c), HOST_KEY, "total") == [(1, 2), (2, 1), (3, 0)]
    nested = {x[HOST_KEY]: x.accounts for x in r.batch_nested(c).collect()}
    assert [len(nested[i]) for i in (1, 2, 3)] == [2, 1, 0]
    assert pairs(r.batch(c, limit=1), HOST_KEY, "account_id") == [(1, 1), (2, 3)] and pairs(r.batch_one(c), HOST_KEY, "account_id") == [(1, 2), (2, 3)]
    one = c.table("accounts").relations["client"]
    assert {x[HOST_KEY]: x.client.client_id for x in one.batch_nested(c).collect()} == {1: 1, 2: 1, 3: 2} and pairs(one.of(c, {"client_id": 2}), "client_id") == [(2,)]
    steps = c.table("clients").relations["transactions"]
    assert pairs(steps.batch(c), HOST_KEY, "transaction_reference") == [(1, "r1"), (1, "r2"), (1, "r3"), (2, "r4")] and pairs(steps.of(c, {"id": 2}), "transaction_reference") == [("r4",)]
    assert r.fill({"id": 7}, {"label": "x"}) == {"label": "x", "client_id": 7}
    with pytest.raises(QueryError):
        steps.fill({"id": 1}, {})


def test_morphs_and_pivots(spark):
    c = publishing(spark)
    put = lambda t, rows: Insert(c, t).values(rows).execute()
    put("users", [{"name": "a"}, {"name": "b"}])
    put("articles", [{"title": "x", "user_id": 1}, {"title": "y", "user_id": 2}])
    put("tags", [{"label": t} for t in "pqr"])
    put("taggables", [{"tag_id": g, "taggable_id": i, "taggable_type": k, "created_at": d} for g, i, k, d in [(1, 1, "articles", "2019-01-01"), (2, 1, "articles", "2021-01-01"), (2, 1, "articles", "2021-01-01"), (3, 1, "users", "2021-01-01"), (3, 2, "articles", "2021-01-01")]])
    tags = c.table("articles").relations["tags"]
    assert pairs(tags.batch(c), HOST_KEY, "label") == [(1, "p"), (1, "q"), (1, "q"), (2, "r")]  # repeated links repeat
    assert pairs(tags.of(c, {"id": 1}), "label") == [("p",), ("q",), ("q",)]
    assert pairs(c.table("articles").relations["recent_tags"].batch(c), HOST_KEY, "label") == [(1, "q"), (1, "q"), (2, "r")]
    assert pairs(c.table("users").relations["articles"].batch(c), HOST_KEY, "title") == [(1, "x"), (2, "y")]
    SoftDelete(c, "articles").where(Filters().eq("title", "x")).execute()
    assert pairs(c.table("users").relations["articles"].batch(c), HOST_KEY, "title") == [(2, "y")] and c.table("users").relations["articles"].batch(c, include_deleted=True).count() == 2


def test_child_of_a_morph_checks_its_type(spark):
    c = Catalog(spark, MemoryStore(spark))
    c.table_builder("books", lambda t: t.id().string("title").soft_deletable().has_many("reviews", "reviews", {"type": "morph", "prefix": "about"}))
    c.table_builder("reviews", lambda t: t.id().string("body").morph("about").belongs_to("book", "books", {"type": "morph", "prefix": "about"}))
    c.freeze()
    Insert(c, "books").values([{"title": "a"}, {"title": "b"}]).execute()
    Insert(c, "reviews").values([{"body": "good", "about_id": 1, "about_type": "books"}, {"body": "off", "about_id": 1, "about_type": "films"}]).execute()
    book = c.table("reviews").relations["book"]
    assert pairs(book.batch(c), HOST_KEY, "title") == [(1, "a")]
    assert book.of(c, {"about_id": 1, "about_type": "films"}).count() == 0 and book.of(c, {"about_id": 1, "about_type": "books"}).count() == 1
    assert pairs(c.table("books").relations["reviews"].count_batch(c), HOST_KEY, "total") == [(1, 1), (2, 0)]
    assert c.table("books").relations["reviews"].fill({"id": 2}, {"body": "x"}) == {"body": "x", "about_id": 2, "about_type": "books"}


def test_relation_rules(spark):
    def build(f):
        c = Catalog(spark, MemoryStore(spark))
        c.table_builder("a", lambda t: t.id())
        c.table_builder("b", lambda t: t.id().bigint("a_id", unsigned=True).morph("x"))
        f(c.table_builder("a"), c.table_builder("b"))
        c.freeze()

    for f in (
        lambda a, b: a.has_many("bs", "b"),  # no foreign key
        lambda a, b: a.belongs_to_many("bs", "b"),  # no pivot
        lambda a, b: a.has_many("bs", "b", {"type": "morph", "prefix": "x"}),  # a is not soft deletable
        lambda a, b: a.has_many("bs", "b", {"type": "morph", "prefix": "nope"}),
        lambda a, b: a.has_many("bs", "b", {"type": "through", "pivot": "b", "host_to_pivot": {"type": "join", "steps": [{"join": "b"}]}}),
        lambda a, b: a.has_many("bs", "b", {"type": "what"}),
        lambda a, b: a.has_many("bs", "b", {"type": "columns", "columns": {"id": "a_id"}}, select=["nope"]),
    ):
        with pytest.raises(SchemaError):
            build(f)
    build(lambda a, b: a.has_many("bs", "b", {"type": "columns", "columns": {"id": "a_id"}}, select=["id"]))
