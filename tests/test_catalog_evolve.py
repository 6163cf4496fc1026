import json

import pytest
from pyspark.sql import types as T

from marlspike import codegen
from marlspike.catalog import Catalog
from marlspike.errors import EngineError, QueryError, SchemaError
from marlspike.evolve import PRIORITY, JsonLedger, MemoryLedger, Migration, Runner, diff, migrate
from marlspike.operators.dml import Insert
from marlspike.sources.store import MemoryStore
from tests.bank import BANK, bank


def make(spark, f, **options):
    c = Catalog(spark, MemoryStore(spark))
    c.table_builder("t", f, **options)
    return c.freeze()


def test_names_and_structs(spark):
    c = bank(spark)
    t = c.table("accounts")
    assert t.column("id").full_name == t.column("account_id").full_name == "account_id" and c.table("accounts") is t
    s = {f.name: f for f in t.struct()}
    assert s["account_balance"].dataType == T.DecimalType(38, 18) and s["account_client_id"].dataType == T.LongType() and not s["account_label"].nullable and s["account_label"].metadata["short"] == "label"
    assert t.column("client_id").type.get("auto_increment") is None  # a reference is not generated
    for bad in ("nope", "label2"):
        with pytest.raises(SchemaError):
            t.column(bad)
    p = Catalog(spark)
    p.table_builder("items", lambda t: t.id(), prefix="app", column_prefix="item")
    assert p.table("app_items").full_name == "app_items" and p.table("items").column("id").full_name == "item_id"


def test_round_trip(spark, tmp_path):
    c = Catalog(spark).load(BANK).freeze()
    (tmp_path / "s.json").write_text(c.to_json())
    again = Catalog(spark).load(str(tmp_path / "s.json")).freeze()
    assert again.to_dict() == json.loads(c.to_json()) and diff(c, again) == []


def test_copies_and_references(spark):
    c = Catalog(spark)
    c.table_builder("a", lambda t: t.id().string("name", max=5, meta={"m": 1}))
    c.table_builder("b", lambda t: t.column("x", "cp:a.name").same_as("y", "b", "x").column("z", {"type": "ref:a.id", "nullable": True}))
    c.freeze()
    b = c.table("b")
    assert b.column("x").meta == {"m": 1} and b.column("y").type.get("max") == 5 and b.column("y").meta == {} and b.column("z").type.nullable


@pytest.mark.parametrize(
    "declare",
    [
        lambda c: c.table_builder("1x"), lambda c: c.table_builder("t", lambda t: t.string("a").string("a")), lambda c: c.table_builder("t", lambda t: t.string("a", nullable=True).primary("a")),
        lambda c: c.table_builder("t", lambda t: t.string("a").primary("b")), lambda c: c.table_builder("t", lambda t: t.column("a", "nonsense")),
        lambda c: c.table_builder("t", lambda t: t.same_as("a", "t", "b").same_as("b", "t", "a")), lambda c: c.table_builder("t", lambda t: t.foreign("a", "nope", "id")),
        lambda c: (c.table_builder("u", lambda t: t.string("s").id()), c.table_builder("t", lambda t: t.foreign("a", "u", "s"))),
        lambda c: (c.table_builder("u", lambda t: t.id()), c.table_builder("t", lambda t: t.foreign("a", "u", "id", on_delete="set_null"))),
        lambda c: (c.table_builder("u", lambda t: t.id(), morph_type="m"), c.table_builder("t", lambda t: t.id(), morph_type="m")),
        lambda c: c.table_builder("t", lambda t: t.id().index("id", "magic")), lambda c: c.table_builder("t", lambda t: t.id().index("nope")),
        lambda c: (c.table_builder("t", namespace="a"), c.table_builder("t", namespace="b")), lambda c: c.load({"t": {"columns": {}, "constraints": [{"type": "x", "columns": []}]}}),
    ],
)
def test_bad_schemas(spark, declare):
    c = Catalog(spark)
    with pytest.raises(SchemaError):
        declare(c)
        c.freeze()


def test_locked(spark):
    c = make(spark, lambda t: t.id())
    for bad in (lambda: c.table_builder("x"), lambda: c.table("t").add_column(None), lambda: c.table("t")._open()):
        with pytest.raises(SchemaError):
            bad()


def test_diff_actions(spark):
    old = Catalog(spark).load(BANK).freeze()
    spec = json.loads(json.dumps(BANK))
    spec["clients"]["columns"]["surname"] = {**spec["clients"]["columns"].pop("last_name"), "old_name": "last_name"}
    spec["clients"]["columns"]["age"] = {"type": "int", "default": 0}
    spec["clients"]["columns"]["first_name"] = {"type": "string", "max": 99}
    del spec["clients"]["columns"]["gender"]
    spec["accounts"]["constraints"] = spec["accounts"]["constraints"][:1] + spec["accounts"]["constraints"][2:3]
    spec["accounts"]["indexes"] = [{"columns": ["label"], "type": "hash"}]
    spec["notes"] = {"columns": {"id": {"type": "int"}}, "constraints": [{"type": "primary_key", "columns": ["id"]}]}
    spec["moves"] = {**spec.pop("transactions"), "old_name": "transactions"}
    spec["clients"]["relations"] = spec["accounts"]["relations"] = {}
    new = Catalog(spark).load(spec).freeze()
    got = [(a.kind, a.table) for a in diff(old, new)]
    assert sorted(got) == sorted([("foreign_key_deleted", "accounts"), ("unique_key_deleted", "accounts"), ("table_renamed", "moves"), ("column_deleted", "clients"), ("column_renamed", "clients"), ("column_type_changed", "clients"), ("column_added", "clients"), ("table_added", "notes"), ("index_added", "accounts")])
    assert [PRIORITY[k] for k, _ in got] == sorted(PRIORITY[k] for k, _ in got)
    back = [(a.kind, a.table) for a in diff(new, old)]
    assert ("table_deleted", "notes") in back and ("foreign_key_added", "accounts") in back and ("unique_key_added", "accounts") in back


@pytest.mark.parametrize("change, kinds", [
    (lambda t: t.id().string("a", nullable=True), ["column_type_changed"]), (lambda t: t.id().string("a", default="x"), ["column_type_changed"]), (lambda t: t.id().json("a"), ["column_type_changed"]),
    (lambda t: t.id().string("a").unique("a"), ["unique_key_added"]), (lambda t: t.id().string("a").primary("a"), ["primary_key_deleted", "primary_key_added"]), (lambda t: t.id().string("a"), []),
    (lambda t: t.id(), ["column_deleted"]), (lambda t: t.id().string("a").index("a", "gin"), ["index_added"]),
])
def test_single_changes(spark, change, kinds):
    assert [a.kind for a in diff(make(spark, lambda t: t.id().string("a")), make(spark, change))] == kinds


def test_rename_by_key(spark):
    old = Catalog(spark)
    old.table_builder("t", lambda t: t.id().string("a", diff_key="k"), diff_key="tk")
    new = Catalog(spark)
    new.table_builder("u", lambda t: t.id().string("b", diff_key="k"), diff_key="tk")
    assert [a.kind for a in diff(old, new)] == ["table_renamed", "column_renamed"]


def test_rows_migrate(spark):
    old = make(spark, lambda t: t.id().string("n").string("gone", default="g"))
    Insert(old, "t").values([{"n": "1"}, {"n": "2"}]).execute()
    new = make(spark, lambda t: t.id().column("number", {"type": "int", "old_name": "n"}).string("more", default="m").string("none", nullable=True))
    assert [tuple(r) for r in migrate(old, new)["t"].orderBy("id").collect()] == [(1, 1, "m", None), (2, 2, "m", None)]
    Insert(old, "t").values({"n": "three"}).execute()
    with pytest.raises(Exception, match="cannot become"):
        migrate(old, new)["t"].collect()


@pytest.mark.parametrize("kind", ["memory", "json"])
def test_runner(spark, tmp_path, kind):
    ledger = MemoryLedger() if kind == "memory" else JsonLedger(spark, f"{tmp_path}/ledger")
    ran, told = [], []
    steps = [Migration(v, f"m{v}", lambda s, v=v: ran.append(("up", v)), (lambda s, v=v: ran.append(("down", v))) if v != 3 else None) for v in (2, 1, 3)]
    r = Runner(steps, ledger, before=lambda m, way: (lambda s: ran.append("instead")) if (m.version, way) == (2, "up") else None, after=lambda m, way: told.append((m.version, way)))
    assert r.up(2) == [1, 2] and r.status() == {1: True, 2: True, 3: False} and ran == [("up", 1), "instead"]
    assert r.rollback() == [2] and r.up() == [2, 3] and [m.version for m in r.pending()] == []
    with pytest.raises(EngineError):
        r.rollback()
    skip = Runner(steps, MemoryLedger(), before=lambda m, way: False)
    assert skip.up() == [1, 2, 3] and all(skip.status().values())
    assert Runner(steps, MemoryLedger()).full() == [1, 2, 3] and told[-1] == (3, "up")
    with pytest.raises(QueryError):
        Runner([steps[0], steps[0]], ledger)


def test_migration_between(spark):
    old, new = make(spark, lambda t: t.id().string("a")), make(spark, lambda t: t.id().string("a").int("b", default=7))
    Insert(old, "t").values({"a": "x"}).execute()
    r = Runner([Migration.between(1, "add b", old, new)], MemoryLedger(), old.store)
    r.up()
    assert [tuple(x) for x in old.store.frames["t"].collect()] == [(1, "x", 7)]
    r.rollback()
    assert old.store.frames["t"].columns == ["id", "a"]


def test_migration_files(spark, tmp_path):
    old, new = make(spark, lambda t: t.id().string("a")), make(spark, lambda t: t.id().string("a").int("b", default=7))
    last = make(spark, lambda t: t.id().string("a", max=9).int("b", default=7).string("c", nullable=True))
    Migration.between(2, "Add c, too!", new, last).save(spark, str(tmp_path))
    assert Migration.between(1, "add b", old, new).save(spark, str(tmp_path)).endswith("/000000000001-add-b.json")
    with pytest.raises(Exception, match="exists"):
        Migration.between(1, "add b", old, new).save(spark, str(tmp_path))
    with pytest.raises(QueryError):
        Migration(3, "by hand", lambda s: None).save(spark, str(tmp_path))
    read = Migration.load_all(spark, str(tmp_path))
    assert [(m.version, m.label) for m in read] == [(1, "add b"), (2, "Add c, too!")]
    Insert(old, "t").values({"a": "x"}).execute()
    r = Runner(read, MemoryLedger(), old.store)
    assert r.up() == [1, 2] and [tuple(x) for x in old.store.frames["t"].collect()] == [(1, "x", 7, None)]
    assert r.rollback(2) == [2, 1] and old.store.frames["t"].columns == ["id", "a"]


def test_database_charset(spark):
    a, b = Catalog(spark, charset="utf8", collate="x"), Catalog(spark, charset="utf8mb4", collate="x")
    assert [(x.kind, x.detail, x.before) for x in diff(a, b)] == [("db_charset_changed", "utf8mb4", "utf8")] and diff(b, b) == []


def test_codegen(spark):
    c = bank(spark)
    py, ts, dart = (codegen.generate(c, x)["clients"] for x in ("python", "typescript", "dart"))
    scope: dict = {"Any": object}
    exec(py, scope)
    assert "first_name: str" in py and "pin" not in py and "email: string | null;" in ts and "final String? email;" in dart and "required this.first_name," in dart
