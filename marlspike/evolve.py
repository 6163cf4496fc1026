"""Schema evolution: the difference of two catalogs, its actions on tables, and migrations with a ledger."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlspike.catalog import Catalog, Column, Table
from marlspike.errors import EngineError, QueryError
from marlspike.operators.dml import stored

#: Actions in the order in which they apply.
PRIORITY = {
    "foreign_key_deleted": 10, "primary_key_deleted": 11, "unique_key_deleted": 12, "index_deleted": 13, "table_renamed": 14, "table_deleted": 20, "column_deleted": 21,
    "db_charset_changed": 30, "db_collate_changed": 31, "table_charset_changed": 40, "table_collate_changed": 41, "column_renamed": 50, "column_type_changed": 51, "column_added": 52,
    "table_added": 60, "row_inserted": 70, "row_updated": 71, "row_deleted": 72, "primary_key_added": 80, "unique_key_added": 81, "index_added": 82, "foreign_key_added": 83,
}


@dataclass
class Action:
    kind: str
    table: str
    detail: Any = None
    before: Any = None

    @property
    def priority(self) -> int:
        return PRIORITY[self.kind]


def _match(old: dict[str, Any], new: dict[str, Any]) -> tuple[dict[str, str], list[str], list[str]]:
    """new name -> old name of what is the same: by difference key, by declared old name, or by name; then what was added and what is gone."""
    pairs: dict[str, str] = {}
    for n, x in new.items():
        by_key = next((o for o, y in old.items() if x.diff_key and x.diff_key == y.diff_key), None)
        found = by_key or (x.old_name if x.old_name in old else None) or (n if n in old else None)
        if found is not None and found not in pairs.values():
            pairs[n] = found
    return pairs, [n for n in new if n not in pairs], [o for o in old if o not in pairs.values()]


def diff(old: Catalog, new: Catalog) -> list[Action]:
    """The actions that turn old into new, in the order to apply them."""
    old.freeze()
    new.freeze()
    out: list[Action] = []
    pairs, added, gone = _match(old.tables, new.tables)
    for n in added:
        out.append(Action("table_added", n, new.tables[n]))
        out += [Action("foreign_key_added", n, f) for f in new.tables[n].foreign_keys]
        out += [Action("index_added", n, i) for i in new.tables[n].indexes]
    for o in gone:
        out += [Action("foreign_key_deleted", o, f) for f in old.tables[o].foreign_keys]
        out.append(Action("table_deleted", o, old.tables[o]))
    for n, o in pairs.items():
        out += _diff_table(old.tables[o], new.tables[n], pairs)
    for what in ("charset", "collate"):
        if getattr(old, what) != getattr(new, what):
            out.append(Action(f"db_{what}_changed", "", getattr(new, what), getattr(old, what)))
    return sorted(out, key=lambda a: a.priority)


def _diff_table(a: Table, b: Table, tables: dict[str, str]) -> list[Action]:
    out: list[Action] = []
    if a.full_name != b.full_name:
        out.append(Action("table_renamed", b.name, b.full_name, a.full_name))
    for what in ("charset", "collate"):
        if getattr(a, what) != getattr(b, what):
            out.append(Action(f"table_{what}_changed", b.name, getattr(b, what), getattr(a, what)))
    pairs, added, gone = _match(a.columns, b.columns)
    out += [Action("column_deleted", b.name, a.columns[o]) for o in gone]
    out += [Action("column_added", b.name, b.columns[n]) for n in added]
    for n, o in pairs.items():
        x, y = a.columns[o], b.columns[n]
        if x.full_name != y.full_name:
            out.append(Action("column_renamed", b.name, y, x))
        if not x.type.same_storage(y.type):
            out.append(Action("column_type_changed", b.name, y, x))
    renamed = {o: n for n, o in pairs.items()}
    now = lambda key: tuple(renamed.get(c, c) for c in key)
    if now(a.primary_key) != tuple(b.primary_key):
        out += [Action("primary_key_deleted", b.name, a.primary_key)] if a.primary_key else []
        out += [Action("primary_key_added", b.name, b.primary_key)] if b.primary_key else []
    was, is_ = {now(k): k for k in a.unique_keys}, {tuple(k): k for k in b.unique_keys}
    out += [Action("unique_key_deleted", b.name, k) for t, k in was.items() if t not in is_]
    out += [Action("unique_key_added", b.name, k) for t, k in is_.items() if t not in was]
    back = {o: n for n, o in tables.items()}

    def foreign(f: Any, old: bool) -> tuple:
        columns = tuple(sorted((renamed.get(k, k) if old else k, v) for k, v in f.columns.items()))
        return back.get(f.reference, f.reference) if old else f.reference, columns, f.on_update, f.on_delete

    fa, fb = {foreign(f, True): f for f in a.foreign_keys}, {foreign(f, False): f for f in b.foreign_keys}
    out += [Action("foreign_key_deleted", b.name, f) for k, f in fa.items() if k not in fb]
    out += [Action("foreign_key_added", b.name, f) for k, f in fb.items() if k not in fa]
    ia, ib = {(now(i.columns), i.kind): i for i in a.indexes}, {(tuple(i.columns), i.kind): i for i in b.indexes}
    out += [Action("index_deleted", b.name, i) for k, i in ia.items() if k not in ib]
    out += [Action("index_added", b.name, i) for k, i in ib.items() if k not in ia]
    return out


def apply_to_rows(df: DataFrame, actions: list[Action], strict: bool = True) -> DataFrame:
    """One table's rows under its actions: columns dropped, renamed, cast and added, all in one projection each.

    A type change casts what can be cast; with strict, rows whose value is lost fail the query."""
    for a in sorted(actions, key=lambda a: a.priority):
        c: Column = a.detail
        if a.kind == "column_deleted":
            df = df.drop(c.full_name)
        elif a.kind == "column_renamed":
            df = df.withColumnRenamed(a.before.full_name, c.full_name)
        elif a.kind == "column_type_changed":
            value = c.type.encode(F.col(c.full_name))
            default = F.lit(stored(c, None)).cast(c.type.spark_type()) if c.type.has_default else None
            if default is not None and not c.type.nullable:
                value = F.when(F.col(c.full_name).isNull(), default).otherwise(value)
            if strict:
                lost = F.col(c.full_name).isNotNull() & value.isNull()
                value = F.when(lost, F.raise_error(F.lit(f"a value of {c.full_name} cannot become {c.type.name}")).cast(c.type.spark_type())).otherwise(value)
            df = df.withColumn(c.full_name, value)
        elif a.kind == "column_added":
            given = stored(c, None) if c.type.has_default or c.type.get("auto") else None
            df = df.withColumn(c.full_name, F.lit(given).cast(c.type.spark_type()))
    return df


def migrate(old: Catalog, new: Catalog, actions: list[Action] | None = None) -> dict[str, DataFrame]:
    """The rows of every table of new, from those of old. Keys are not enforced here: see dml.duplicate_keys() and orphans()."""
    actions = diff(old, new) if actions is None else actions
    pairs, added, _ = _match(old.tables, new.tables)
    out = {n: new.spark.createDataFrame([], new.tables[n].struct()) for n in added}
    for n, o in pairs.items():
        rows = apply_to_rows(old.read(o), [a for a in actions if a.table == n])
        out[n] = rows.select(*[c.full_name for c in new.tables[n].columns.values()])
    return out


@dataclass
class Migration:
    """A step of the schema's history. up and down get the store's catalog and change rows as they like."""

    version: int
    label: str
    up: Callable[[Any], Any]
    down: Callable[[Any], Any] | None = None
    schema: dict = field(default_factory=dict)
    before: dict = field(default_factory=dict)

    def save(self, spark: Any, folder: str) -> str:
        """Write a migration made by between() to a file of its own in a folder that Spark reaches; its path. A file that is there is not replaced."""
        if not self.schema:
            raise QueryError(f"migration {self.version} has no schemas to write")
        name = re.sub(r"[^a-z0-9]+", "-", self.label.lower()).strip("-")
        path = f"{folder.rstrip('/')}/{self.version:012d}-{name}.json"
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        out = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(p, False)
        out.write(json.dumps({"version": self.version, "label": self.label, "old": self.before, "new": self.schema}, default=str, indent=1).encode())
        out.close()
        return path

    @classmethod
    def load_all(cls, spark: Any, folder: str) -> list[Migration]:
        """The migrations that save() wrote to a folder, by version."""
        from marlspike.sources.store import MemoryStore

        found = [json.loads(r[0]) for r in spark.read.text(f"{folder.rstrip('/')}/*.json", wholetext=True).collect()]
        catalog = lambda schema: Catalog(spark, MemoryStore(spark)).load(schema).freeze()
        return sorted((cls.between(m["version"], m["label"], catalog(m["old"]), catalog(m["new"])) for m in found), key=lambda m: m.version)

    @classmethod
    def between(cls, version: int, label: str, old: Catalog, new: Catalog) -> Migration:
        """A migration made from the difference of two catalogs."""

        def run(a: Catalog, b: Catalog) -> Callable[[Any], None]:
            def do(store: Any) -> None:
                a.store = store
                with store.unit():
                    for n, df in migrate(a, b).items():
                        store.write(b.tables[n], df)

            return do

        return cls(version, label, run(old, new), run(new, old), new.to_dict(), old.to_dict())


class Runner:
    """Applies migrations in order and keeps a ledger of those that ran.

    The ledger is any object with read() -> list of versions and write(list): a JsonLedger or one of
    the caller's. before(migration, way) may return False to skip a migration (it counts as run), or
    a function that replaces it; after(migration, way) is told."""

    def __init__(self, migrations: list[Migration], ledger: Any, store: Any = None, before: Callable | None = None, after: Callable | None = None):
        versions = [m.version for m in migrations]
        if len(set(versions)) != len(versions):
            raise QueryError("two migrations have one version")
        self.migrations = sorted(migrations, key=lambda m: m.version)
        self.ledger, self.store, self.before, self.after = ledger, store, before, after

    def status(self) -> dict[int, bool]:
        done = set(self.ledger.read())
        return {m.version: m.version in done for m in self.migrations}

    def pending(self) -> list[Migration]:
        return [m for m in self.migrations if not self.status()[m.version]]

    def up(self, target: int | None = None) -> list[int]:
        return [self._run(m, "up") for m in self.pending() if target is None or m.version <= target]

    def rollback(self, steps: int = 1) -> list[int]:
        done = [m for m in self.migrations if self.status()[m.version]]
        return [self._run(m, "down") for m in done[::-1][:steps]]

    def full(self) -> list[int]:
        """Create everything at once: the last migration's schema is taken to be there, and all count as run."""
        for m in self.pending():
            self.ledger.write([*self.ledger.read(), m.version])
        return [m.version for m in self.migrations]

    def _run(self, m: Migration, way: str) -> int:
        act = m.up if way == "up" else m.down
        says = self.before(m, way) if self.before else None
        if callable(says):
            act = says
        if says is not False:
            if act is None:
                raise EngineError(f"migration {m.version} cannot be undone")
            act(self.store)
        done = [v for v in self.ledger.read() if v != m.version]
        self.ledger.write(sorted([*done, m.version] if way == "up" else done))
        if self.after:
            self.after(m, way)
        return m.version


class MemoryLedger:
    def __init__(self) -> None:
        self.versions: list[int] = []

    def read(self) -> list[int]:
        return list(self.versions)

    def write(self, versions: list[int]) -> None:
        self.versions = list(versions)


class JsonLedger:
    """Versions as a one-row JSON table in a folder that Spark reaches."""

    def __init__(self, spark: Any, path: str):
        self.spark, self.path = spark, path

    def _fs(self) -> tuple[Any, Any]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def read(self) -> list[int]:
        fs, p = self._fs()
        if not fs.exists(p):
            return []
        return json.loads(self.spark.read.text(self.path).first()[0])

    def write(self, versions: list[int]) -> None:
        self.spark.createDataFrame([(json.dumps(versions),)], "value string").coalesce(1).write.mode("overwrite").text(self.path)
