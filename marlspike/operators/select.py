"""The SELECT builder: a description of a query that becomes one DataFrame.

Sources are aliased DataFrames, so Catalyst sees the whole query: filters and columns reach the
scans, comma joins with an equality become equi-joins, ORDER BY with LIMIT becomes a top-k."""

from __future__ import annotations

import copy
import datetime as dt
import enum
import re
from collections.abc import Callable
from decimal import Decimal
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlspike.catalog import ALIAS, Catalog, Table
from marlspike.errors import QueryError
from marlspike.functions import jsonops
from marlspike.plans.fields import Field, is_field, parse_field
from marlspike.plans.filters import Filters, Raw, Resolved

#: Prefix of the output names of computed columns.
COMPUTED = "_computed_"
JOINS = ("inner", "left", "right")


def expr(text: str) -> Raw:
    """An expression that is taken as it is, as a value of filters and updates."""
    return Raw(text)


def fn(name: str, *args: Any) -> SparkColumn:
    """A call of any SQL function by name: texts are values, Raw and Columns are expressions."""
    return F.call_function(name, *[F.expr(a.text) if isinstance(a, Raw) else a if isinstance(a, SparkColumn) else F.lit(a) for a in args])


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal(v: Any) -> str:
    """A value as an SQL literal of its own type. Values of other types than these are refused."""
    if isinstance(v, enum.Enum):
        v = v.value
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return quote(v)
    if isinstance(v, int):
        return str(v) if -(1 << 63) <= v < 1 << 63 else f"CAST('{v}' AS DECIMAL(38, 0))"
    if isinstance(v, float):
        return f"DOUBLE('{v!r}')"
    if isinstance(v, Decimal):
        digits = v.as_tuple()
        if not v.is_finite():
            raise QueryError(f"{v} cannot be bound in an expression")
        scale = max(0, -digits.exponent)
        return f"CAST('{v:f}' AS DECIMAL({min(38, max(len(digits.digits) + max(0, digits.exponent), scale + 1))}, {scale}))"
    if isinstance(v, dt.datetime):
        return f"TIMESTAMP '{v.isoformat(sep=' ')}'" if v.tzinfo else f"TIMESTAMP_NTZ '{v.isoformat(sep=' ')}'"
    if isinstance(v, dt.date):
        return f"DATE '{v.isoformat()}'"
    if isinstance(v, (bytes, bytearray)):
        return f"X'{bytes(v).hex()}'"
    raise QueryError(f"a value of type {type(v).__name__} cannot be bound in an expression")


class _Source:
    def __init__(self, alias: str, df: DataFrame, table: Table | None):
        self.alias, self.table, self.df = alias, table, df.alias(alias)
        self.columns = df.columns


#: Group texts that name several groupings at once.
_GROUPING = re.compile(r"(ROLLUP|CUBE|GROUPING\s+SETS)\s*\((.*)\)", re.I | re.S)


def split_list(text: str) -> list[str]:
    """The parts of a text between commas outside of parentheses and quotes."""
    out, depth, part = [], 0, ""
    for m in re.finditer(r"'(?:[^'\\]|\\.)*'|`[^`]*`|[(),]|[^'`(),]+|.", text, re.S):
        x = m[0]
        depth += (x == "(") - (x == ")")
        if x == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += x
    return [x.strip() for x in [*out, part] if x.strip()]


class JoinBuilder:
    """host JOIN target ON condition; without a condition every pair joins."""

    def __init__(self, query: Select, kind: str, host: str):
        self.query, self.kind, self.host = query, kind, host
        self.target: str | None = None
        self.condition: Any = None

    def to(self, target: Any, alias: str | None = None) -> JoinBuilder:
        self.target = self.query._add(target, alias)
        return self

    def on(self, condition: Any) -> Select:
        """A text, a Column, filters in any form, or a function that adds filters."""
        self.condition = condition
        return self.query


class Select:
    """Methods change the builder and return it; copy() makes an independent one. to_df() gives the rows."""

    def __init__(self, catalog: Catalog):
        self.catalog = catalog
        self.sources: dict[str, _Source] = {}
        self.main_alias: dict[str, str] = {}
        self.from_aliases: list[str] = []
        self.joins: list[JoinBuilder] = []
        self.items: list[tuple[Any, str | None]] = []
        self.filters = Filters()
        self.groups: list[Any] = []
        self.grouping: str | None = None
        self.sets: list[list[Any]] = []
        self.having_filters: Any = None
        self.orders: list[tuple[Any, bool]] = []
        self.max: int | None = None
        self.offset = 0
        self.bindings: dict[str, Any] = {}
        self.is_distinct = False
        self._made = 0

    def copy(self) -> Select:
        out = copy.copy(self)
        for k in ("sources", "main_alias", "from_aliases", "joins", "items", "groups", "orders", "bindings"):
            setattr(out, k, copy.copy(getattr(self, k)))
        out.filters = Filters()
        out.filters.root.cond, out.filters.root.items = self.filters.root.cond, list(self.filters.root.items)
        return out

    # FROM and joins

    def _new_alias(self) -> str:
        while True:
            self._made += 1
            alias = f"_a{self._made}"
            if alias not in self.sources:
                return alias

    def _add(self, what: Any, alias: str | None) -> str:
        if isinstance(what, Select):
            if alias is None:
                raise QueryError("a sub-query in FROM needs an alias")
            table, df = None, what.to_df()
        elif isinstance(what, DataFrame):
            if alias is None:
                raise QueryError("a DataFrame in FROM needs an alias")
            table, df = None, what
        else:
            table = self.catalog.table(what)
            df = self.catalog.read(table)
        alias = alias or self._new_alias()
        if not ALIAS.fullmatch(alias):
            raise QueryError(f"{alias!r} is not a valid alias")
        if alias in self.sources:
            raise QueryError(f"alias {alias} is already in use")
        self.sources[alias] = _Source(alias, df, table)
        if table is not None:
            self.main_alias.setdefault(table.name, alias)
        return alias

    def from_(self, what: Any, alias: str | None = None) -> Select:
        """Add a table, a sub-query or a DataFrame; several make a cross product. A dict maps tables to aliases."""
        if isinstance(what, dict):
            for t, a in what.items():
                self.from_(t, a)
            return self
        self.from_aliases.append(self._add(what, alias))
        return self

    def in_from(self, table: Any, alias: str | None = None) -> bool:
        t = self.catalog.find(table) if isinstance(table, str) else table
        return any(self.sources[a].table is t and alias in (None, a) for a in self.from_aliases if t is not None)

    def alias_of(self, name: Any) -> str:
        """The alias that a name stands for: an alias itself, or a table's main alias."""
        if isinstance(name, str) and name in self.sources:
            return name
        t = self.catalog.find(name) if isinstance(name, str) else name
        if t is None or t.name not in self.main_alias:
            raise QueryError(f"{name!r} is no alias or table of this query")
        return self.main_alias[t.name]

    def join(self, kind: str, host: Any) -> JoinBuilder:
        if kind not in JOINS:
            raise QueryError(f"unknown kind of join {kind!r}")
        j = JoinBuilder(self, kind, self.alias_of(host))
        self.joins.append(j)
        return j

    def inner_join(self, host: Any) -> JoinBuilder:
        return self.join("inner", host)

    def left_join(self, host: Any) -> JoinBuilder:
        return self.join("left", host)

    def right_join(self, host: Any) -> JoinBuilder:
        return self.join("right", host)

    # SELECT

    def select(self, alias: Any = None, columns: Any = None, auto_prefix: bool = True) -> Select:
        """select('c') for c.*, select('c', ['id', {'name': 'n'}]) for columns, select(None, ['count(*) as n']) for expressions."""
        if alias is None:
            for e in [columns] if isinstance(columns, (str, SparkColumn, Raw)) else columns or []:
                self._item(e.text if isinstance(e, Raw) else e, None)
            return self
        a = self.alias_of(alias)
        if columns is None:
            self._item(("*", a), None)
            return self
        pairs = columns.items() if isinstance(columns, dict) else [p for c in ([columns] if isinstance(columns, str) else columns) for p in (c.items() if isinstance(c, dict) else [(c, None)])]
        for name, out in pairs:
            full = self._full(a, name) if auto_prefix else name
            self._item(Field(full, a), out or full)
        return self

    def select_computed(self, name: str, expression: str | SparkColumn) -> Select:
        self._item(expression, COMPUTED + name)
        return self

    def _item(self, what: Any, out: str | None) -> None:
        if isinstance(what, SparkColumn) or not any(x == (what, out) for x in self.items if not isinstance(x[0], SparkColumn)):
            self.items.append((what, out))  # the same item twice is one column

    def _full(self, alias: str, name: str) -> str:
        s = self.sources[alias]
        if s.table is not None:
            return s.table.column(name).full_name
        if name not in s.columns:
            raise QueryError(f"{alias} has no column {name!r}")
        return name

    def distinct(self, on: bool = True) -> Select:
        """Rows once each, after HAVING and before ORDER BY, which then needs selected columns."""
        self.is_distinct = on
        return self

    # bindings

    def bind(self, name: str, value: Any) -> Select:
        """A value for `:name` on the right of a filter, or for `:name` in raw expressions of this query's WHERE."""
        self.bindings[name.lstrip(":")] = value.value if isinstance(value, enum.Enum) else value
        return self

    def bind_all(self, values: dict[str, Any]) -> Select:
        for k, v in values.items():
            self.bind(k, v)
        return self

    # WHERE, GROUP BY, HAVING, ORDER BY, LIMIT

    def where(self, *items: Any) -> Select:
        self.filters.where(*items)
        return self

    and_where = where

    def or_where(self, *items: Any) -> Select:
        self.filters.or_(*items)
        return self

    def group_by(self, *expressions: Any) -> Select:
        for e in expressions:
            for x in e if isinstance(e, (list, tuple)) else [e]:
                if isinstance(x, SparkColumn):
                    self.groups.append(x)
                elif found := _GROUPING.fullmatch((x or "").strip()):
                    parts = split_list(found[2])
                    if found[1].upper().startswith("GROUPING"):
                        self.grouping_sets(*[split_list(y[1:-1]) if y.startswith("(") else [y] for y in parts])
                    else:
                        getattr(self, found[1].lower())(*parts)
                elif x and x.strip():
                    self.groups.append(x)
        return self

    def rollup(self, *expressions: Any) -> Select:
        """Group by all of the expressions, by all but the last, and so on down to one group of all rows."""
        self.grouping = "rollup"
        return self.group_by(*expressions)

    def cube(self, *expressions: Any) -> Select:
        """Group by each subset of the expressions."""
        self.grouping = "cube"
        return self.group_by(*expressions)

    def grouping_sets(self, *sets: list | tuple) -> Select:
        """Group by each of the lists of expressions; an empty one is one group of all rows."""
        self.sets = [list(x) for x in sets]
        seen: list[Any] = []
        for e in (e for x in self.sets for e in x):
            if not any(e is k or (isinstance(e, str) and e == k) for k in seen):
                seen.append(e)
        self.grouping = "sets"
        return self.group_by(*seen)

    def having(self, condition: Any) -> Select:
        """Replaces what was there. Aggregates need not be selected, and output names may be used."""
        self.having_filters = condition
        return self

    def order_by(self, *orders: Any) -> Select:
        """'name', 'name DESC', {'name': 'ASC'|'DESC'|bool}. Nulls come first upwards and last downwards."""
        for o in orders:
            for x in o if isinstance(o, (list, tuple)) else [o]:
                if isinstance(x, dict):
                    for k, v in x.items():
                        if isinstance(v, str) and v.upper() not in ("ASC", "DESC"):
                            raise QueryError(f"{v!r} is no direction")
                        self.orders.append((k, v.upper() == "ASC" if isinstance(v, str) else bool(v)))
                elif isinstance(x, SparkColumn):
                    self.orders.append((x, True))
                else:
                    text = x.strip()
                    head, _, last = text.rpartition(" ")
                    self.orders.append((head.strip(), last.upper() == "ASC") if head and last.upper() in ("ASC", "DESC") else (text, True))
        return self

    def limit(self, max: int | None, offset: int = 0) -> Select:
        if max is not None and max <= 0:
            raise QueryError("a limit must be over 0")
        if offset < 0:
            raise QueryError("an offset cannot be negative")
        if max is not None:
            self.max, self.offset = max, offset
        return self

    # resolution

    def resolve(self, f: Field) -> Resolved | None:
        if f.table is not None:
            try:
                aliases = [self.alias_of(f.table)]
            except QueryError:
                return None
        else:
            aliases = list(self.sources)
        for a in aliases:
            s = self.sources[a]
            declared = s.table.find(f.column) if s.table is not None else None
            name = declared.full_name if declared is not None else f.column if f.column in s.columns else None
            if name is not None:
                return Resolved(F.col(f"{a}.`{name}`"), declared, s.table, f.path)
        if f.table is not None:
            raise QueryError(f"{f.table} has no column {f.column!r}")
        return None

    def expression(self, text: str) -> SparkColumn:
        return F.expr(self._bound(text))

    def _bound(self, text: str) -> str:
        """The text with literals for the names bound; anything else after a colon stays."""
        if not self.bindings:
            return text

        def bound(m: Any) -> str:
            if m[1] is None or m[1] not in self.bindings:
                return m[0]
            v = self.bindings[m[1]]
            values = list(dict.fromkeys(v)) if isinstance(v, (list, tuple)) else [v]
            return ", ".join(map(literal, values)) or "NULL"

        return re.sub(r"'(?:[^'\\]|\\.)*'|`[^`]*`|(?<![:\w]):(\w+)", bound, text)

    def _value(self, what: Any) -> SparkColumn:
        """A select item, group or order key: a field if it is one, else an expression."""
        if isinstance(what, SparkColumn):
            return what
        if isinstance(what, Field) or (isinstance(what, str) and is_field(what)):
            found = self.resolve(what if isinstance(what, Field) else parse_field(what))
            if found is not None:
                return jsonops.extract(found.column, found.path) if found.path else found.column
        return F.expr(str(what))

    def _conditions(self, c: Any, resolver: Any = None) -> SparkColumn:
        if c is None:
            return F.lit(True)
        if isinstance(c, SparkColumn):
            return c
        if isinstance(c, (str, Raw)):
            return F.expr(c if isinstance(c, str) else c.text)
        if isinstance(c, Filters):
            return c.to_column(resolver or self)
        if isinstance(c, (list, dict)):
            return Filters.from_any(c).to_column(resolver or self)
        return Filters().where(c).to_column(resolver or self)

    # plan

    def _joined(self) -> DataFrame:
        if not self.from_aliases:
            raise QueryError("the query has no FROM")
        done: set[int] = set()

        def attach(df: DataFrame, alias: str) -> DataFrame:
            # all joins of an alias in order, then those of each target
            mine = [j for j in self.joins if j.host == alias and id(j) not in done]
            for j in mine:
                done.add(id(j))
                if j.target is None:
                    raise QueryError("a join has no target")
                right = self.sources[j.target].df
                if j.condition is None and j.kind == "inner":
                    df = df.crossJoin(right)
                else:
                    df = df.join(right, self._conditions(j.condition), j.kind)
            for j in mine:
                df = attach(df, j.target)
            return df

        out: DataFrame | None = None
        for a in self.from_aliases:
            part = attach(self.sources[a].df, a)
            out = part if out is None else out.crossJoin(part)
        if len(done) != len(self.joins):
            raise QueryError("a join hangs off an alias that FROM does not reach")
        return out

    def rows(self) -> DataFrame:
        """FROM, joins and WHERE, under the aliases: what a select list, an update or a deletion works on."""
        df = self._joined()
        return df if self.filters.is_empty() else df.where(self.filters.to_column(self))

    def _outputs(self) -> list[tuple[SparkColumn, str]]:
        out: list[tuple[SparkColumn, str]] = []
        for what, name in self.items or [(("*", a), None) for a in self._order_of_sources()]:
            if isinstance(what, tuple):
                s = self.sources[what[1]]
                out += [(F.col(f"{s.alias}.`{c}`"), c) for c in s.columns]
                continue
            c = self._value(what)
            out.append((c, name or _name_of(c)))
        return out

    def _order_of_sources(self) -> list[str]:
        return list(self.sources)

    def to_df(self) -> DataFrame:
        outputs = self._outputs()
        names = [n for _, n in outputs]
        by_name = {n: c for c, n in outputs}

        def key(what: Any) -> SparkColumn:
            return by_name[what] if isinstance(what, str) and what in by_name else self._value(what)

        grouped = bool(self.groups) or self.having_filters is not None
        hidden = [c.alias(f"_s{i}") for i, (c, _) in enumerate(outputs)]
        sorts = [key(k).alias(f"_o{i}") for i, (k, _) in enumerate(self.orders)]
        df = self.rows()
        if grouped:
            having = [self._conditions(self.having_filters, _Named(self, by_name)).alias("_h")] if self.having_filters is not None else []
            keys = [self._value(g) for g in self.groups]
            if self.grouping == "sets":
                named = {g: k for g, k in zip(self.groups, keys, strict=True) if isinstance(g, str)}
                groups = df.groupingSets([[named[g] if isinstance(g, str) else g for g in x] for x in self.sets], *keys)
            else:
                groups = getattr(df, self.grouping or "groupBy")(*keys)
            df = groups.agg(*hidden, *sorts, *having)
            if having:
                df = df.where("_h")
        else:
            df = df.select(*hidden, *sorts)
        if self.is_distinct:
            if any(not (isinstance(k, str) and k in by_name) for k, _ in self.orders):
                raise QueryError("DISTINCT can only be ordered by output names")
            df = df.distinct()
        if self.orders:
            df = df.orderBy(*[F.col(f"_o{i}").asc_nulls_first() if up else F.col(f"_o{i}").desc_nulls_last() for i, (_, up) in enumerate(self.orders)])
        if self.max is not None:
            df = df.offset(self.offset) if self.offset else df
            df = df.limit(self.max)
        return df.select(*[F.col(f"_s{i}").alias(n) for i, n in enumerate(names)])

    def total(self) -> int:
        """The number of rows, limits included."""
        return self.to_df().count()

    def count_df(self, name: str = "total") -> DataFrame:
        return self.to_df().agg(F.count(F.lit(1)).alias(name))

    def explain(self, mode: str = "formatted") -> None:
        self.to_df().explain(mode)


class _Named:
    """Resolves output names before columns, for HAVING."""

    def __init__(self, query: Select, by_name: dict[str, SparkColumn]):
        self.query, self.by_name = query, by_name

    def resolve(self, f: Field) -> Resolved | None:
        if f.table is None and f.column in self.by_name and not f.path:
            return Resolved(self.by_name[f.column])
        return self.query.resolve(f)

    def expression(self, text: str) -> SparkColumn:
        return self.query.expression(text)


def _name_of(c: SparkColumn) -> str:
    """The name that Spark gives an expression: its alias, the last part of a column's name, or its text."""
    text = c._jc.toString()
    head, mark, last = text.rpartition(" AS ")
    if mark:
        return last.strip("`")
    return text.rsplit(".", 1)[-1] if is_field(text) else text


def select(catalog: Catalog, build: Callable[[Select], Any] | None = None) -> Select:
    """A new SELECT, optionally set up by a function."""
    q = Select(catalog)
    if build:
        build(q)
    return q
