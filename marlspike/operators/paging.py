"""Request options, table queries and results: filters, soft deletes, pages, cursors, totals."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from marlspike.catalog import Catalog, Table
from marlspike.errors import QueryError
from marlspike.operators.dml import Delete, Insert, SoftDelete, Update
from marlspike.operators.select import Select
from marlspike.plans.filters import Filters, MultiScope, TableScope
from marlspike.types import OPERATORS, UNARY

#: Rows of a page by default and at most.
PAGE, MOST = 10, 2000
_ORDER_NAME = re.compile(r"[a-zA-Z_][a-zA-Z0-9_.]*")


def parse_order(text: str) -> dict[str, bool]:
    """`name:desc|other` as {name: upwards}; a later entry for a name wins."""
    out: dict[str, bool] = {}
    for part in filter(None, text.split("|")):
        name, _, way = part.partition(":")
        if not _ORDER_NAME.fullmatch(name) or way.lower() not in ("", "asc", "desc"):
            raise QueryError(f"bad order {part!r}")
        out[name] = way.lower() != "desc"
    return out


def _whole(v: Any, what: str, low: int) -> int:
    if isinstance(v, bool) or not re.fullmatch(r"-?\d+", str(v)) or int(v) < low:
        raise QueryError(f"{what} must be a whole number of {low} or more")
    return int(v)


@dataclass
class Options:
    """What a request asks for. Untrusted parts keep the names they came with."""

    form: dict[str, Any] = field(default_factory=dict)
    filters: Any = None
    relations: list[str] = field(default_factory=list)
    collection: str | None = None
    order: dict[str, bool] = field(default_factory=dict)
    page: int | None = None
    max: int | None = None
    offset: int | None = None
    cursor: Any = None
    cursor_column: str | None = None
    cursor_up: bool = True
    uses_cursor: bool = False
    columns: list[str] | None = None
    scopes: dict[str, dict] = field(default_factory=dict)
    only: list[Any] = field(default_factory=list)

    @classmethod
    def parse(cls, request: dict[str, Any], default_max: int = PAGE, most: int = MOST) -> Options:
        r = dict(request)
        scopes = r.pop("scopes", {}) or {}
        if not isinstance(scopes, dict):
            raise QueryError("scopes must be a map")
        out = cls(scopes=scopes, filters=r.pop("filters", None), collection=r.pop("collection", None))
        relations = r.pop("relations", None) or []
        out.relations = list(dict.fromkeys(relations.split("|") if isinstance(relations, str) else relations))
        order = r.pop("order_by", None)
        out.order = parse_order(order) if isinstance(order, str) else dict(order or {})
        columns = r.pop("_columns", None)
        out.columns = list(dict.fromkeys(columns.split("|") if isinstance(columns, str) else columns)) if columns else None
        out.uses_cursor = "cursor" in r or "cursor_column" in r
        if out.uses_cursor and "page" in r:
            raise QueryError("page and cursor exclude each other")
        out.cursor, out.cursor_column = r.pop("cursor", None), r.pop("cursor_column", None)
        out.cursor_up = str(r.pop("cursor_direction", "asc")).lower() != "desc"
        out.max = _whole(r.pop("max", default_max), "max", 1)
        if out.max > most:
            raise QueryError(f"max is {most} at most")
        out.page = None if out.uses_cursor else _whole(r.pop("page", 1), "page", 1)
        out.form = r.pop("form_data", r)
        return out

    def start(self) -> int:
        if self.offset is not None:
            return self.offset
        return ((self.page or 1) - 1) * (self.max or 0)

    def ensure_only(self, filters: Any) -> Options:
        """Filters that hold whatever the request says; they stand in front of its own."""
        self.only.append(filters)
        return self

    def scoped(self, name: str) -> Options:
        return Options.parse(self.scopes.get(name, {}))


class Results:
    """Rows of a query, lazily: nothing runs before they are counted or iterated."""

    def __init__(self, query: Select, options: Options, unlimited: Select, cursor: str | None = None):
        self.query, self.options, self.unlimited, self.cursor = query, options, unlimited, cursor
        self.df = query.to_df()
        self._items: list[Row] | None = None
        self._total: int | None = None

    def items(self) -> list[Row]:
        """The rows of this page; a query without a limit has no page and must be iterated."""
        if self.query.max is None:
            raise QueryError("there is no limit; use lazy()")
        if self._items is None:
            self._items = self.df.collect()
        return self._items[: self.options.max] if self.cursor else self._items

    def count(self) -> int:
        return len(self.items()) if self.query.max is not None else self.total()

    def total(self) -> int:
        """Rows without the limit; on a page that is known to be the last it is not counted again."""
        if self._total is None:
            o = self.options
            if not self.cursor and self.query.max is not None:
                found = len(self.items())
                if found < self.query.max and (found or not o.start()):
                    self._total = o.start() + found
                    return self._total
            self._total = self.unlimited.total()
        return self._total

    def page(self) -> dict[str, Any]:
        if self.cursor is None:
            return {"items": self.items(), "page": self.options.page, "max": self.options.max, "total": self.total()}
        self.items()
        more = len(self._items) > self.options.max
        items = self.items()
        return {"items": items, "next_cursor": items[-1][self.cursor] if more else None, "cursor_column": self.cursor, "has_more": more}

    def lazy(self) -> Iterator[Row]:
        """All rows within the limit, one partition at a time on the driver."""
        return self.df.toLocalIterator(prefetchPartitions=True)

    def group_by(self, key: str | Callable[[Row], Any]) -> Iterator[tuple[Any, Row]]:
        return ((key(r) if callable(key) else r[key], r) for r in self.lazy())

    def first(self) -> Row | None:
        return next(iter(self.df.limit(1).collect()), None)


class TableQuery:
    """Queries on one table that leave out soft-deleted rows and check untrusted filters."""

    def __init__(self, catalog: Catalog, table: Any, allow_private: bool = False, allow_sensitive: bool = False):
        catalog.freeze()
        self.catalog, self.table = catalog, catalog.table(table)
        self.alias = "_t"
        self.scope = TableScope(self.table, self.alias, allow_private, allow_sensitive)
        self.filters = Filters(self.scope)
        self.include_deleted = False
        self.allowed_columns: list[str] | None = None

    def sub_group(self) -> TableQuery:
        out = TableQuery(self.catalog, self.table)
        out.scope, out.filters = self.scope, Filters(self.scope)
        return out

    def include_soft_deleted(self, on: bool = True) -> TableQuery:
        self.include_deleted = on
        return self

    def where(self, *items: Any) -> TableQuery:
        self.filters.where(*items)
        return self

    def or_(self, *items: Any) -> TableQuery:
        self.filters.or_(*items)
        return self

    def filter_by(self, column: str, op: str, value: Any = None, at_path: str | None = None) -> TableQuery:
        self.filters.add(f"{column}#{at_path}" if at_path else column, op, value)
        return self

    def __getattr__(self, name: str) -> Any:
        """where_<column>_<operator>(value), for the operators that the column's type allows."""
        if name.startswith("where_"):
            rest = name[6:]
            for op in sorted(OPERATORS, key=len, reverse=True):
                c = self.table.find(rest[: -len(op) - 1]) if rest.endswith("_" + op) else None
                if c is not None:
                    if op not in c.type.allowed_operators():
                        raise QueryError(f"column {c.name} has no operator {op}")
                    if op in UNARY:
                        return lambda: self.filter_by(c.name, op)
                    return lambda value, at_path=None: self.filter_by(c.name, op, value, at_path)
        raise AttributeError(name)

    def helpers(self) -> list[str]:
        return [f"where_{c.name}_{op}" for c in self.table.columns.values() for op in c.type.allowed_operators()]

    def _conditions(self, options: Options | None) -> Filters:
        out = Filters()
        for f in options.only if options else []:
            out.where(Filters.from_any(f))
        if not self.filters.is_empty():
            out.root.push("and", self.filters.root)
        if options and options.filters:
            # untrusted filters are checked like any others
            out.root.push("and", Filters.from_any(options.filters, self.scope).root)
        if self.table.soft_deletes and not self.include_deleted:
            out.add(f"{self.alias}.deleted", "eq", False)
        return out

    def select(self, options: Options | None = None) -> Select:
        q = Select(self.catalog).from_(self.table, self.alias)
        columns = options.columns if options else None
        if columns:
            allowed = self.allowed_columns if self.allowed_columns is not None else [c.name for c in self.table.columns.values() if not c.private]
            known = {self.table.column(c).name for c in allowed}
            for c in columns:
                if self.table.find(c) is None or self.table.column(c).name not in known:
                    raise QueryError(f"column {c!r} cannot be asked for")
            q.select(self.alias, columns)
        else:
            q.select(self.alias)
        conditions = self._conditions(options)
        if not conditions.is_empty():
            q.where(conditions)
        return q

    def find(self, options: Options | None = None) -> Results:
        options = options or Options()
        if options.uses_cursor:
            return self._by_cursor(options)
        q = self.select(options)
        unlimited = q.copy()
        for name, up in options.order.items():
            q.order_by({f"{self.alias}.{self.table.column(name).full_name}": up})
        if options.max is not None:
            q.limit(options.max, options.start())
        return Results(q, options, unlimited)

    def cursor_column(self, options: Options) -> str:
        if options.cursor_column:
            return self.table.column(options.cursor_column).full_name
        if len(self.table.primary_key) != 1:
            raise QueryError(f"{self.table.name}: a cursor column must be named")
        return self.table.column(self.table.primary_key[0]).full_name

    def _by_cursor(self, options: Options) -> Results:
        """Rows after the cursor in its column's order: a filter that reaches the scan, and a top-k of one row more than asked for."""
        name = self.cursor_column(options)
        q = self.select(options)
        if q.items and not any(getattr(w, "column", None) == name for w, _ in q.items if not isinstance(w, tuple)) and options.columns:
            q.select(self.alias, [name])
        if options.cursor is not None:
            q.where(Filters().add(f"{self.alias}.{name}", "gt" if options.cursor_up else "lt", options.cursor))
        unlimited = q.copy()
        q.order_by({f"{self.alias}.{name}": options.cursor_up})
        for other, up in options.order.items():
            full = self.table.column(other).full_name
            if full != name:
                q.order_by({f"{self.alias}.{full}": up})
        q.limit((options.max or PAGE) + 1)
        options.max = options.max or PAGE
        return Results(q, options, unlimited, name)

    # writing

    def _chooser(self, kind: type, options: Options | None, *args: Any, soft: bool = True) -> Any:
        out = kind(self.catalog, self.table, self.alias, *args)
        keep, self.include_deleted = self.include_deleted, self.include_deleted or not soft
        conditions = self._conditions(options)
        self.include_deleted = keep
        if not conditions.is_empty():
            out.where(conditions)
        if options and options.max is not None:
            out.order_by(*[{f"{self.alias}.{self.table.column(n).full_name}": up} for n, up in options.order.items()])
            out.limit(options.max)
        return out

    def insert(self, values: dict | list[dict]) -> Insert:
        return Insert(self.catalog, self.table).values(values)

    def update(self, values: dict[str, Any], options: Options | None = None) -> Update:
        return self._chooser(Update, options).set(values)

    def delete(self, options: Options | None = None) -> Delete:
        """A hard deletion; soft-deleted rows go too."""
        return self._chooser(Delete, options, soft=False)

    def soft_delete(self, options: Options | None = None) -> SoftDelete:
        return self._chooser(SoftDelete, options)


def identity_key(table: Table, alias: str | None = None) -> SparkColumn:
    """The values of a row's key, joined by ':'."""
    return F.concat_ws(":", *[F.col(f"{alias}.{c}" if alias else c).cast("string") for c in table.full_names(table.identity())])


def redact(table: Table, df: DataFrame) -> DataFrame:
    """Private columns go, sensitive ones show their stand-in (null by default)."""
    out = []
    for c in table.columns.values():
        if c.full_name not in df.columns or c.private:
            continue
        out.append(F.lit(c.redacted).cast(df.schema[c.full_name].dataType).alias(c.full_name) if c.sensitive else F.col(f"`{c.full_name}`"))
    return df.select(*out)


__all__ = ["MultiScope", "Options", "Results", "TableQuery", "identity_key", "parse_order", "redact"]
