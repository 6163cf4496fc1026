"""The filter algebra: a tree of filters that compiles to one Column.

AND and OR have no precedence. Each new filter joins all that stand before it: `a AND b OR c` is
`(a AND b) OR c`, and `a OR b AND c` is `(a OR b) AND c`."""

from __future__ import annotations

import enum
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlspike import catalog as cat
from marlspike.errors import FilterError
from marlspike.functions import jsonops
from marlspike.plans.fields import Field, is_field, parse_field
from marlspike.plans.parser import Parser
from marlspike.types import OPERATORS, UNARY, Json

#: Keys of the text form.
TEXT_KEY, BINDINGS_KEY = "_$filter", "_$bindings"


@dataclass(frozen=True)
class Raw:
    """An expression in Spark SQL that is taken as it is."""

    text: str


@dataclass
class Leaf:
    left: Any
    op: str
    right: Any = None


@dataclass
class Group:
    """Filters under one connective."""

    cond: str = "and"
    items: list = field(default_factory=list)

    def push(self, cond: str, item: Any) -> None:
        if isinstance(item, Group) and not item.items:
            return
        if self.items and cond != self.cond:
            if len(self.items) > 1:
                self.items = [Group(self.cond, self.items)]
            self.cond = cond
        elif not self.items:
            self.cond = cond
        if isinstance(item, Group) and (item.cond == self.cond or len(item.items) == 1) and (not self.items or item.cond == self.cond):
            self.items += item.items
            if len(self.items) == len(item.items) and len(item.items) > 1:
                self.cond = item.cond
        else:
            self.items.append(item)


@dataclass(frozen=True)
class Resolved:
    """A field that was found: its column in the plan, its declaration, and a path inside of it."""

    column: SparkColumn
    declared: cat.Column | None = None
    table: cat.Table | None = None
    path: tuple[str, ...] = ()


class Resolver(Protocol):
    """What a query offers to its filters."""

    def resolve(self, f: Field) -> Resolved | None: ...

    def expression(self, text: str) -> SparkColumn: ...


class TableScope:
    """Filters by untrusted users on one table: only its columns, and neither private nor sensitive ones unless allowed."""

    def __init__(self, table: cat.Table, alias: str | None = None, allow_private: bool = False, allow_sensitive: bool = False):
        self.table, self.alias = table, alias
        self.allow_private, self.allow_sensitive = allow_private, allow_sensitive

    def holds(self, f: Field) -> cat.Column | None:
        if f.table is not None and f.table not in (self.alias, self.table.name, self.table.full_name):
            return None
        return self.table.find(f.column)

    def check(self, f: Field | None) -> Field:
        c = self.holds(f) if f else None
        if c is None:
            raise FilterError(f"{f or 'this expression'} is not a column of {self.table.name}")
        if (c.private or self.table.private) and not self.allow_private:
            raise FilterError(f"column {c.name} is private")
        if c.sensitive and not self.allow_sensitive:
            raise FilterError(f"column {c.name} is sensitive")
        return Field(c.full_name, self.alias or f.table, f.path)


class MultiScope:
    """Several scopes: by the field's table or alias, else the first that has the column."""

    def __init__(self, *scopes: TableScope):
        self.scopes = list(scopes)

    def check(self, f: Field | None) -> Field:
        fits = [s for s in self.scopes if f and s.holds(f) is not None]
        if not fits:
            raise FilterError(f"{f or 'this expression'} is in no scope")
        return fits[0].check(f)


class Filters:
    """A tree under construction. Methods return the object itself."""

    def __init__(self, scope: TableScope | MultiScope | None = None):
        self.scope = scope
        self.root = Group()
        self._cond = "and"

    def is_empty(self) -> bool:
        return not self.root.items

    def sub_group(self) -> Filters:
        return Filters(self.scope)

    # building

    def _push(self, item: Any) -> Filters:
        self.root.push(self._cond, item)
        self._cond = "and"
        return self

    def add(self, left: Any, op: str, right: Any = None) -> Filters:
        op = str(op.value if isinstance(op, enum.Enum) else op).lower()
        if op not in OPERATORS:
            raise FilterError(f"unknown operator {op!r}")
        if op in UNARY and right is not None:
            raise FilterError(f"{op} takes no value")
        if op in ("eq", "neq") and right is None:
            op = "is_null" if op == "eq" else "is_not_null"
        if op in ("is_true", "is_false"):
            op, right = "eq", op == "is_true"
        if op == "has_key" and not (isinstance(right, str) and right):
            raise FilterError("has_key takes the name of a key")
        if op in ("in", "not_in"):
            if isinstance(right, (set, frozenset, tuple)):
                right = list(right)
            if not (isinstance(right, (list, Raw, DataFrame)) or hasattr(right, "to_df") or (isinstance(right, str) and right[:1] == ":")):
                raise FilterError(f"{op} takes a list, a query or an expression")
        if isinstance(left, str) and self.scope is not None:
            left = self.scope.check(parse_field(left) if is_field(left) else None)
        elif isinstance(left, Field) and self.scope is not None:
            left = self.scope.check(left)
        elif self.scope is not None and not isinstance(left, SparkColumn):
            self.scope.check(None)
        return self._push(Leaf(left, op, right))

    def and_(self, *items: Any) -> Filters:
        return self._combine("and", items)

    def or_(self, *items: Any) -> Filters:
        """With items, add each of them by OR; without, the next filter is added by OR."""
        return self._combine("or", items)

    def where(self, *items: Any) -> Filters:
        return self._combine("and", items)

    def _combine(self, cond: str, items: tuple) -> Filters:
        if not items:
            self._cond = cond
            return self
        for item in items:
            if isinstance(item, str):
                if self.scope is not None:
                    raise FilterError("raw conditions are not allowed in a scope")
                node: Any = Raw(item)
            elif isinstance(item, Raw):
                node = item
            elif isinstance(item, Filters):
                if item.scope is not self.scope and self.scope is not None:
                    raise FilterError("filters of another scope do not mix")
                node = Group(item.root.cond, list(item.root.items))
            elif isinstance(item, (list, dict)):
                node = Filters.from_any(item, self.scope).root
            elif isinstance(item, SparkColumn):
                node = item
            elif callable(item):
                sub = self.sub_group()
                item(sub)
                if sub.is_empty():
                    raise FilterError("the function added no filter")
                node = sub.root
            else:
                raise FilterError(f"{item!r} is no filter")
            self.root.push(cond, node)
        return self

    # front ends

    @classmethod
    def from_any(cls, data: Any, scope: Any = None, strict: bool = True) -> Filters:
        if isinstance(data, Filters):
            return data
        if isinstance(data, str):
            return cls.from_text(data, {}, scope, strict)
        if isinstance(data, dict):
            if TEXT_KEY in data:
                if set(data) - {TEXT_KEY, BINDINGS_KEY}:
                    raise FilterError(f"only {TEXT_KEY} and {BINDINGS_KEY} may stand together")
                return cls.from_text(data[TEXT_KEY], data.get(BINDINGS_KEY) or {}, scope, strict)
            return cls.from_map(data, scope)
        return cls.from_list(data, scope)

    @classmethod
    def from_text(cls, text: str, bindings: dict[str, Any] | None = None, scope: Any = None, strict: bool = True) -> Filters:
        if not isinstance(text, str) or not isinstance(bindings or {}, dict):
            raise FilterError("a filter text and a map of bindings are expected")
        return cls.from_list(Parser(text, bindings, strict).parse(), scope)

    @classmethod
    def from_list(cls, data: list, scope: Any = None) -> Filters:
        """[left, operator, right, 'and'|'or', ...] flat, with lists for groups, in any mixture."""
        out = cls(scope)
        i, n, cond = 0, len(data), "and"
        if not isinstance(data, (list, tuple)):
            raise FilterError(f"{data!r} is no list of filters")
        while i < n:
            x = data[i]
            if isinstance(x, (list, dict)):
                if not x:
                    raise FilterError("an empty group")
                out.root.push(cond, cls.from_any(x, scope).root)
                i += 1
            elif isinstance(x, Filters):
                out.root.push(cond, x.root)
                i += 1
            else:
                if i + 1 >= n:
                    raise FilterError(f"an operator is missing after {x!r}")
                op = data[i + 1]
                op = op.value if isinstance(op, enum.Enum) else op
                if not isinstance(op, str) or op.lower() not in OPERATORS:
                    raise FilterError(f"{op!r} is no operator")
                out._cond = cond
                if op.lower() in UNARY:
                    out.add(x, op)
                    i += 2
                else:
                    if i + 2 >= n:
                        raise FilterError(f"a value is missing after {op!r}")
                    out.add(x, op, data[i + 2])
                    i += 3
            if i < n:
                c = data[i]
                if not isinstance(c, str) or c.lower() not in ("and", "or"):
                    raise FilterError(f"'and' or 'or' is missing before {c!r}")
                cond = c.lower()
                i += 1
                if i >= n:
                    raise FilterError(f"nothing stands after {c!r}")
        return out

    @classmethod
    def from_map(cls, data: dict, scope: Any = None) -> Filters:
        """{column: value} or {column: [[operator, value, 'and'|'or'], ...]}; columns are ANDed."""
        out = cls(scope)
        for left, rules in data.items():
            if not (isinstance(rules, list) and rules and all(isinstance(r, (list, tuple)) for r in rules)):
                out.add(left, "eq", rules)
                continue
            sub, cond = cls(scope), "and"
            for r in rules:
                op, rest = str(r[0]).lower(), list(r[1:])
                if op not in OPERATORS:
                    raise FilterError(f"{op!r} is no operator")
                value = None
                if op not in UNARY:
                    if not rest:
                        raise FilterError(f"a value is missing after {op!r}")
                    value = rest.pop(0)
                sub._cond = cond
                sub.add(left, op, value)
                cond = str(rest[0]).lower() if rest else "and"
                if cond not in ("and", "or"):
                    raise FilterError(f"{cond!r} is no connective")
            out.root.push("and", sub.root)
        return out

    # compiling

    def to_column(self, resolver: Resolver) -> SparkColumn:
        return _compile(self.root, resolver)


def _helper(op: str) -> Callable:
    if op in UNARY:
        return lambda self, left: self.add(left, op)
    return lambda self, left, right: self.add(left, op, right)


for _op in OPERATORS:
    setattr(Filters, _op + ("_" if _op == "in" else ""), _helper(_op))
Filters.contains_at_path = lambda self, left, path, value: self.add(f"{left}#{path}", "contains", value)  # type: ignore[attr-defined]


def _compile(node: Any, r: Resolver) -> SparkColumn:
    if isinstance(node, Group):
        if not node.items:
            return F.lit(True)
        out = _compile(node.items[0], r)
        for x in node.items[1:]:
            out = out & _compile(x, r) if node.cond == "and" else out | _compile(x, r)
        return out
    if isinstance(node, Raw):
        return r.expression(node.text)
    if isinstance(node, SparkColumn):
        return node
    return _leaf(node, r)


def _left(left: Any, r: Resolver) -> Resolved:
    if isinstance(left, SparkColumn):
        return Resolved(left)
    if isinstance(left, Raw):
        return Resolved(r.expression(left.text))
    if hasattr(left, "to_df"):
        return Resolved(left.to_df().scalar())
    if isinstance(left, cat.Column):
        left = Field(left.full_name)
    if isinstance(left, str):
        if not is_field(left):
            return Resolved(r.expression(left))
        left = parse_field(left)
    found = r.resolve(left)
    if found is None:
        return Resolved(r.expression(str(left)))
    return found


def right_value(v: Any, declared: cat.Column | None, r: Resolver) -> SparkColumn:
    """The right operand as a Column; plain texts are values, never columns."""
    if isinstance(v, enum.Enum):
        v = v.value
    if isinstance(v, SparkColumn):
        return v
    if isinstance(v, Raw):
        return r.expression(v.text)
    if isinstance(v, (Field, cat.Column)):
        f = Field(v.full_name) if isinstance(v, cat.Column) else v
        found = r.resolve(f)
        if found is None:
            raise FilterError(f"unknown field {f}")
        return jsonops.extract(found.column, found.path) if found.path else found.column
    if hasattr(v, "to_df"):
        return v.to_df().scalar()
    if isinstance(v, DataFrame):
        return v.scalar()
    if isinstance(v, (list, dict)):
        v = json.dumps(v, separators=(",", ":"), ensure_ascii=False)
    return F.lit(declared.type.cast_for_filter(v) if declared is not None else v)


def _leaf(leaf: Leaf, r: Resolver) -> SparkColumn:
    found = _left(leaf.left, r)
    c, declared, op, right = found.column, found.declared, leaf.op, leaf.right
    bound = getattr(r, "bindings", None) or {}
    if isinstance(right, str) and right.startswith(":") and right[1:] in bound:
        right = bound[right[1:]]
        if right is None and op in ("eq", "neq"):
            op = "is_null" if op == "eq" else "is_not_null"
    if found.path:
        if declared is not None and not (isinstance(declared.type, Json) and declared.type.native()):
            raise FilterError(f"column {declared.name} holds no JSON that a path can enter")
        if op == "contains":
            return jsonops.contains(jsonops.extract_json(c, found.path), right)
        if op == "has_key":
            return jsonops.has_key(jsonops.extract_json(c, found.path), right)
        c, declared = jsonops.extract(c, found.path), None
        if isinstance(right, bool):
            right = "true" if right else "false"
        elif isinstance(right, (int, float)) and op in ("lt", "lte", "gt", "gte"):
            c = c.try_cast("double")  # texts would compare by their characters
        elif isinstance(right, (int, float)):
            right = json.dumps(right)
    if op in ("contains", "has_key") and declared is not None and not (isinstance(declared.type, Json) and declared.type.native()):
        raise FilterError(f"{op} needs a JSON column, {declared.name} is none")
    if op == "is_null":
        return c.isNull()
    if op == "is_not_null":
        return c.isNotNull()
    if op == "contains":
        return jsonops.contains(c, right)
    if op == "has_key":
        return jsonops.has_key(c, right)
    if op in ("in", "not_in"):
        if isinstance(right, str):
            raise FilterError(f"no value is bound to {right}")
        if isinstance(right, (list, tuple)):
            known = [x.value if isinstance(x, enum.Enum) else x for x in right]
            known = list(dict.fromkeys(known if declared is None else [declared.type.cast_for_filter(x) for x in known]))
            if not known:
                return F.lit(op == "not_in")
            # with a null among them, NOT IN is never true
            out = c.isin([x for x in known if x is not None]) if None not in known else c.isin([F.lit(x) for x in known])
        elif isinstance(right, Raw):
            out = c.isin(r.expression(right.text)) if "," not in right.text else r.expression(f"{_sql_of(leaf.left)} IN ({right.text})")
        else:
            out = c.isin(right.to_df() if hasattr(right, "to_df") else right)
        return ~out if op == "not_in" else out
    v = right_value(right, declared, r)
    if op in ("like", "not_like"):
        pattern = right if isinstance(right, str) else None
        out = c.like(pattern) if pattern is not None else F.like(c, v)
        return ~out if op == "not_like" else out
    return {"eq": c == v, "neq": c != v, "lt": c < v, "lte": c <= v, "gt": c > v, "gte": c >= v}[op]


def _sql_of(left: Any) -> str:
    if isinstance(left, (str, Field)):
        return str(left)
    raise FilterError("a list of expressions needs a field on its left")
