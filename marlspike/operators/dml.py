"""INSERT, UPDATE, DELETE and upserts as rewrites of whole tables: DataFrame in, DataFrame out.

Parquet cannot change in place, so each change is a Change: the table's new rows and the rows that
were affected (what RETURNING gives). Nothing is written before execute()."""

from __future__ import annotations

import datetime as dt
import enum
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlspike.catalog import Catalog, Column, Table
from marlspike.errors import QueryError
from marlspike.operators.select import Select
from marlspike.plans.filters import Raw
from marlspike.types import Json

_ORDER = "_order"


@dataclass
class Change:
    table: Table
    new: DataFrame
    affected: DataFrame


def stored(c: Column, value: Any) -> Any:
    """A validated value as the column stores it."""
    clean = c.type.validate(value.value if isinstance(value, enum.Enum) else value)
    return c.type.to_text(clean) if isinstance(c.type, Json) else clean


def _returned(df: DataFrame, table: Table, columns: list[str] | None) -> DataFrame:
    return df if not columns else df.select(*table.full_names(columns))


class _Writer:
    def __init__(self, catalog: Catalog, table: Any):
        catalog.freeze()
        self.catalog, self.table = catalog, catalog.table(table)
        self._returning: list[str] | None = None
        self._checks = True

    def checked(self, on: bool = True) -> Any:
        """Whether execute() checks keys and references (inserts and updates do so by default), or acts by the foreign keys on what refers to deleted rows (deletions do so only if told to)."""
        self._checks = on
        return self

    def returning(self, *columns: str) -> Any:
        self._returning = list(columns)
        return self

    def change(self) -> Change:
        raise NotImplementedError

    def execute(self) -> DataFrame:
        """Write the new rows and give the affected ones, if keys stay unique and references hold; else raise.

        What a checked deletion does to rows that refer to those deleted, by the foreign keys' actions, is written with it."""
        done = self.change()
        more = self.check(done) if self._checks else []
        if more:
            with self.catalog.store.unit():
                for x in [done, *more]:
                    self.catalog.store.write(x.table, x.new)
        else:
            self.catalog.store.write(self.table, done.new)
        return _returned(done.affected, self.table, self._returning)

    def check(self, done: Change) -> list[Change]:
        """Raise if the change breaks a key or a reference; the changes to other tables that it brings with it."""
        return []


def check_keys(table: Table, new: DataFrame, affected: DataFrame, keys: list[list[str]]) -> None:
    """Raise if an affected row shares a key with another row. Keys with a null never conflict."""
    for key in keys:
        cols = table.full_names(key)
        some = affected.select(*cols).dropna().distinct()
        if new.join(some, cols, "left_semi").groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").limit(1).count():
            raise QueryError(f"{table.name} has rows with the same {', '.join(key)}")


def check_references(catalog: Catalog, table: Table, affected: DataFrame, columns: set[str] | None = None) -> None:
    """Raise if an affected row refers to a missing one, by the foreign keys that have any of the columns."""
    known = {f"{'_'.join(f.columns)}->{catalog.table(f.reference).name}": f for f in table.foreign_keys}
    for name, bad in orphans(catalog, table, affected).items():
        if (columns is None or columns & set(known[name].columns)) and bad.limit(1).count():
            raise QueryError(f"{table.name} has rows that refer to missing ones: {name}")


class Insert(_Writer):
    def __init__(self, catalog: Catalog, table: Any):
        super().__init__(catalog, table)
        self.rows: list[dict[str, Any]] = []
        self.source: DataFrame | None = None
        self.mode = "fail"
        self.conflict: list[str] | None = None
        self.update: list[str] | None = None

    def values(self, rows: dict | list[dict]) -> Insert:
        """One row or several; all must name the same columns in the same order."""
        rows = [rows] if isinstance(rows, dict) else list(rows)
        if not rows or not all(rows):
            raise QueryError("there is nothing to insert")
        rows = [{self.table.column(k).name: v for k, v in r.items()} for r in rows]
        names = list((self.rows or rows)[0])
        if any(list(r) != names for r in rows):
            raise QueryError("rows to insert must have the same columns in the same order")
        self.rows += rows
        return self

    def from_query(self, source: Select | DataFrame) -> Insert:
        """Rows of a query, whose columns have this table's short or full names."""
        self.source = source.to_df() if isinstance(source, Select) else source
        return self

    def on_conflict_ignore(self) -> Insert:
        self.mode = "ignore"
        return self

    def on_conflict_update(self, conflict: list[str] | None = None, update: list[str] | None = None) -> Insert:
        """Rows whose `conflict` columns (by default the key) are there already change `update` (by default all given) instead."""
        self.mode, self.conflict, self.update = "update", conflict, update
        return self

    def _next_id(self, c: Column) -> int:
        top = self.catalog.read(self.table).agg(F.max(c.full_name)).first()[0]
        return int(top or 0) + 1

    def incoming(self) -> tuple[DataFrame, list[str]]:
        """New rows in the table's columns, with their order, and the short names of the columns given."""
        t, spark = self.table, self.catalog.spark
        auto = next((c for c in t.columns.values() if c.type.get("auto_increment")), None)
        if self.source is not None:
            given = {t.column(n).name: n for n in self.source.columns}
            df = self.source.withColumn(_ORDER, F.monotonically_increasing_id())
            out = []
            for c in t.columns.values():
                value = F.col(f"`{given[c.name]}`") if c.name in given else None
                if c is auto:
                    # ids are unique and rise, but skip numbers: rows are not brought to one task
                    made = F.lit(self._next_id(c)) + F.col(_ORDER)
                    value = made if value is None else F.coalesce(value, made)
                elif value is None:
                    value = F.lit(stored(c, None)) if c.type.has_default or c.type.get("auto") else F.lit(None)
                out.append(value.cast(c.type.spark_type()).alias(c.full_name))
            return df.select(*out, _ORDER), list(given)
        if not self.rows:
            raise QueryError("there is nothing to insert")
        names = [n for n in self.rows[0]]
        next_id = self._next_id(auto) if auto and any(r.get(auto.name) is None for r in self.rows) else 0
        data = []
        for i, r in enumerate(self.rows):
            row = []
            for c in t.columns.values():
                v = r.get(c.name)
                if c is auto and v is None:
                    v, next_id = next_id, next_id + 1
                row.append(v if isinstance(v, (Raw, SparkColumn)) else stored(c, v))
            data.append((*row, i))
        frames = []
        if all(not isinstance(v, (Raw, SparkColumn)) for row in data for v in row):
            frames.append(spark.createDataFrame(data, t.struct().add(_ORDER, "long", False)))
        else:
            one = spark.range(1)
            for row in data:
                cols = [(F.expr(v.text) if isinstance(v, Raw) else v if isinstance(v, SparkColumn) else F.lit(v)).cast(c.type.spark_type()).alias(c.full_name) for v, c in zip(row, t.columns.values(), strict=False)]
                frames.append(one.select(*cols, F.lit(row[-1]).cast("long").alias(_ORDER)))
        df = frames[0]
        for f in frames[1:]:
            df = df.unionByName(f)
        return df, names

    def change(self) -> Change:
        old = self.catalog.read(self.table)
        new, given = self.incoming()
        names = old.columns
        if self.mode == "update":
            return self._upsert(old, new, given)
        if self.mode == "ignore":
            new = without_conflicts(self.table, old, new)
        new = new.select(*names)
        return Change(self.table, old.unionByName(new), new)

    def check(self, done: Change) -> list[Change]:
        check_keys(self.table, done.new, done.affected, self.table.keys())
        check_references(self.catalog, self.table, done.affected)
        return []

    def _upsert(self, old: DataFrame, new: DataFrame, given: list[str]) -> Change:
        t = self.table
        key = t.full_names(self.conflict or t.identity())
        update = set(t.full_names(self.update if self.update is not None else given)) - set(key)
        # of several new rows with one key the last counts
        last = Window.partitionBy(*key).orderBy(F.desc(_ORDER))
        fresh = new.withColumn("_n", F.row_number().over(last)).where(F.col("_n") == 1).drop("_n", _ORDER)
        a, b = old.withColumn("_old", F.lit(True)).alias("a"), fresh.withColumn("_new", F.lit(True)).alias("b")
        both = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key], "full")
        was, comes = F.coalesce(F.col("a._old"), F.lit(False)), F.coalesce(F.col("b._new"), F.lit(False))
        cols = [F.when(~was | (comes & F.lit(c in update)), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in old.columns]
        merged = both.select(*cols, comes.alias("_hit"))
        return Change(t, merged.drop("_hit"), merged.where("_hit").drop("_hit"))


def without_conflicts(table: Table, old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows whose keys neither the table nor an earlier new row has. Keys with a null never conflict."""
    for key in table.keys():
        cols = table.full_names(key)
        known = old.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(cols)])
        new = new.join(known, [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(cols)], "left_anti")
    for key in table.keys():
        cols = table.full_names(key)
        first = Window.partitionBy(*cols).orderBy(_ORDER)
        some_null = F.lit(False)
        for c in cols:
            some_null |= F.col(c).isNull()
        new = new.withColumn("_n", F.row_number().over(first)).where((F.col("_n") == 1) | some_null).drop("_n")
    return new


class _Chooser(_Writer):
    """Rows of a table chosen by WHERE, ORDER BY and LIMIT, with or without joins."""

    def __init__(self, catalog: Catalog, table: Any, alias: str | None = None):
        super().__init__(catalog, table)
        self.alias = alias or self.table.name
        self.query = Select(catalog).from_(self.table, self.alias)

    def where(self, *items: Any) -> Any:
        self.query.where(*items)
        return self

    def or_where(self, *items: Any) -> Any:
        self.query.or_where(*items)
        return self

    def order_by(self, *orders: Any) -> Any:
        self.query.order_by(*orders)
        return self

    def limit(self, max: int) -> Any:
        self.query.limit(max)
        return self

    def inner_join(self, host: Any) -> Any:
        return _Join(self, self.query.inner_join(host))

    def left_join(self, host: Any) -> Any:
        return _Join(self, self.query.left_join(host))

    def right_join(self, host: Any) -> Any:
        return _Join(self, self.query.right_join(host))

    def marked(self) -> tuple[DataFrame, SparkColumn]:
        """The table under its alias, and whether a row is chosen.

        A plain WHERE is judged row by row. With a limit or joins the chosen keys come from a query
        of their own (a top-k, not a global ranking) and are joined."""
        df = self.catalog.read(self.table).alias(self.alias)
        if self.query.orders and self.query.max is None:
            raise QueryError("ORDER BY needs a LIMIT here")
        if self.query.max is None and not self.query.joins:
            return df, F.coalesce(self.query.filters.to_column(self.query), F.lit(False))
        key = self.table.full_names(self.table.identity())
        q = self.query.copy()
        q.items = []
        q.select(self.alias, key)
        keys = q.to_df().toDF(*[f"_k{i}" for i in range(len(key))])
        # a right join may give rows without a row of this table
        keys = keys.where(" AND ".join(f"_k{i} IS NOT NULL" for i in range(len(key)))).distinct().withColumn("_chosen", F.lit(True))
        joined = df.join(keys, [F.col(f"{self.alias}.{c}") == F.col(f"_k{i}") for i, c in enumerate(key)], "left")
        return joined, F.coalesce(F.col("_chosen"), F.lit(False))


class _Join:
    def __init__(self, owner: Any, builder: Any):
        self.owner, self.builder = owner, builder

    def to(self, target: Any, alias: str | None = None) -> _Join:
        self.builder.to(target, alias)
        return self

    def on(self, condition: Any) -> Any:
        self.builder.on(condition)
        return self.owner


class Update(_Chooser):
    def __init__(self, catalog: Catalog, table: Any, alias: str | None = None):
        super().__init__(catalog, table, alias)
        self.sets: dict[str, Any] = {}

    def check(self, done: Change) -> list[Change]:
        names = {c.name for c in self.table.columns.values() if c.full_name in self.sets}
        check_keys(self.table, done.new, done.affected, [k for k in self.table.keys() if names & {self.table.column(n).name for n in k}])
        check_references(self.catalog, self.table, done.affected, names)
        return []

    def set(self, values: dict[str, Any]) -> Update:
        """Values, or Raw and Columns over the row as it was."""
        for k, v in values.items():
            c = self.table.column(k)
            if isinstance(v, (Raw, SparkColumn)):
                self.sets[c.full_name] = (F.expr(v.text) if isinstance(v, Raw) else v).cast(c.type.spark_type())
            else:
                self.sets[c.full_name] = F.lit(stored(c, v)).cast(c.type.spark_type())
        return self

    def change(self) -> Change:
        if not self.sets:
            raise QueryError("there is nothing to set")
        if self.query.joins:
            raise QueryError("an update takes no joins")
        df, chosen = self.marked()
        names = [c.full_name for c in self.table.columns.values()]
        rows = df.select(chosen.alias("_hit"), *[F.when(chosen, self.sets[n]).otherwise(F.col(f"{self.alias}.{n}")).alias(n) if n in self.sets else F.col(f"{self.alias}.{n}").alias(n) for n in names])
        return Change(self.table, rows.drop("_hit"), rows.where("_hit").drop("_hit"))


class Delete(_Chooser):
    """Rows for which WHERE is null stay; without WHERE all go. Outer joins keep their meaning."""

    def __init__(self, catalog: Catalog, table: Any, alias: str | None = None):
        super().__init__(catalog, table, alias)
        self._checks = False

    def check(self, done: Change) -> list[Change]:
        return cascade(self.catalog, self.table, done.affected)

    def change(self) -> Change:
        df, chosen = self.marked()
        names = [F.col(f"{self.alias}.{c.full_name}") for c in self.table.columns.values()]
        rows = df.select(chosen.alias("_hit"), *names)
        return Change(self.table, rows.where(~F.col("_hit")).drop("_hit"), rows.where("_hit").drop("_hit"))


class SoftDelete(Update):
    """Mark rows as deleted; those that are already are left alone."""

    def __init__(self, catalog: Catalog, table: Any, alias: str | None = None, at: Any = None):
        super().__init__(catalog, table, alias)
        if not self.table.soft_deletes:
            raise QueryError(f"table {self.table.name} has no soft deletes")
        self.set({"deleted": True, "deleted_at": at or dt.datetime.now(dt.UTC)})

    def change(self) -> Change:
        self.query.where([f"{self.alias}.deleted", "eq", False])
        return super().change()


def violations(table: Table, df: DataFrame) -> DataFrame:
    """Rows that break a column's type, with the names of those columns in `_broken`."""
    broken = F.filter(F.array(*[F.when(c.type.invalid(F.col(c.full_name)), F.lit(c.name)) for c in table.columns.values()]), lambda x: x.isNotNull())
    return df.withColumn("_broken", broken).where(F.size("_broken") > 0)


def duplicate_keys(table: Table, df: DataFrame, key: list[str]) -> DataFrame:
    cols = table.full_names(key)
    return df.dropna(subset=cols).groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")


def orphans(catalog: Catalog, table: Table, df: DataFrame) -> dict[str, DataFrame]:
    """For each foreign key, the rows whose referenced row is missing. Null references are fine."""
    out = {}
    for f in table.foreign_keys:
        other = catalog.table(f.reference)
        mine, theirs = table.full_names(list(f.columns)), other.full_names(list(f.columns.values()))
        known = catalog.read(other).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(theirs)])
        bad = df.dropna(subset=mine).join(known, [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(mine)], "left_anti")
        out[f"{'_'.join(f.columns)}->{other.name}"] = bad
    return out


def cascade(catalog: Catalog, table: Table, deleted: DataFrame) -> list[Change]:
    """What deleting rows of a table does to those that refer to them, by each foreign key's action."""
    out: list[Change] = []
    for other in catalog.tables.values():
        for f in other.foreign_keys:
            if catalog.table(f.reference) is not table or f.on_delete == "none":
                continue
            mine, theirs = other.full_names(list(f.columns)), table.full_names(list(f.columns.values()))
            gone = deleted.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(theirs)]).distinct().withColumn("_gone", F.lit(True))
            rows = catalog.read(other).join(gone, [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(mine)], "left").drop(*[f"_k{i}" for i in range(len(mine))])
            hit = F.col("_gone").isNotNull()
            if f.on_delete == "restrict":
                if rows.where(hit).limit(1).count():
                    raise QueryError(f"rows of {other.name} still refer to {table.name}")
            elif f.on_delete == "cascade":
                change = Change(other, rows.where(~hit).drop("_gone"), rows.where(hit).drop("_gone"))
                out += [change, *cascade(catalog, other, change.affected)]
            else:
                columns = {c: other.column(c) for c in f.columns}
                value = {d.full_name: F.lit(stored(d, None) if f.on_delete == "set_default" else None).cast(d.type.spark_type()) for d in columns.values()}
                new = rows.withColumns({n: F.when(hit, v).otherwise(F.col(n)) for n, v in value.items()})
                out.append(Change(other, new.drop("_gone"), new.where(hit).drop("_gone")))
    return out
