"""The schema catalog: namespaces, tables, columns, keys, indexes and relations, declared once.

Declarations are plain Python or JSON. Each table maps to a StructType whose fields carry what Spark
has no place for (short name, private, sensitive) as metadata. freeze() checks the whole and locks it."""

from __future__ import annotations

import copy
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from marlspike import types as ty
from marlspike.errors import SchemaError

NAME = re.compile(r"[a-zA-Z](?:[a-zA-Z0-9_]*[a-zA-Z0-9])?")
ALIAS = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")
REFERENCE = re.compile(r"(ref|cp):(\w+)\.(\w+)")
#: Actions of foreign keys, kinds of indexes.
ACTIONS = ("none", "set_null", "set_default", "cascade", "restrict")
INDEX_KINDS = ("btree", "hash", "fulltext", "spatial", "gin", "gist", "brin", "spgist")


@dataclass
class Column:
    name: str
    type: ty.Type
    prefix: str = ""
    private: bool = False
    sensitive: bool = False
    redacted: Any = None
    meta: dict = field(default_factory=dict)
    old_name: str | None = None
    diff_key: str | None = None
    reference: str | None = None

    @property
    def full_name(self) -> str:
        return f"{self.prefix}_{self.name}" if self.prefix else self.name

    def struct_field(self) -> T.StructField:
        meta = {"short": self.name, "private": self.private, "sensitive": self.sensitive}
        return T.StructField(self.full_name, self.type.spark_type(), self.type.nullable, meta)


@dataclass
class ForeignKey:
    reference: str
    columns: dict[str, str]  # own short name -> that of the referenced table
    name: str = ""
    on_update: str = "none"
    on_delete: str = "none"


@dataclass
class Index:
    columns: list[str]
    kind: str = "btree"
    name: str = ""


class Table:
    def __init__(self, name: str, catalog: Catalog | None = None, namespace: str = "default", prefix: str = "", column_prefix: str = "", singular: str = "", plural: str = "", private: bool = False, morph_type: str | None = None, meta: dict | None = None, old_name: str | None = None, diff_key: str | None = None, charset: str | None = None, collate: str | None = None):
        for n in (name, *[p for p in (prefix, column_prefix) if p]):
            if not NAME.fullmatch(n):
                raise SchemaError(f"{n!r} is not a valid name")
        self.name, self.catalog, self.namespace, self.prefix, self.column_prefix = name, catalog, namespace, prefix, column_prefix
        self.singular, self.plural = singular or name.rstrip("s") or name, plural or name
        self.private, self.morph_type, self.meta = private, morph_type or name, dict(meta or {})
        self.old_name, self.diff_key, self.charset, self.collate = old_name, diff_key, charset, collate
        self.columns: dict[str, Column] = {}
        self.primary_key: list[str] = []
        self.unique_keys: list[list[str]] = []
        self.foreign_keys: list[ForeignKey] = []
        self.indexes: list[Index] = []
        self.relations: dict[str, Any] = {}
        self.collections: dict[str, Callable[..., DataFrame]] = {}
        self.soft_deletes = False

    @property
    def full_name(self) -> str:
        return f"{self.prefix}_{self.name}" if self.prefix else self.name

    def _open(self) -> None:
        if self.catalog is not None and self.catalog.frozen:
            raise SchemaError(f"{self.name}: the schema is locked")

    def add_column(self, c: Column) -> Column:
        self._open()
        if not NAME.fullmatch(c.name):
            raise SchemaError(f"{c.name!r} is not a valid name")
        if c.name in self.columns or any(c.full_name == x.full_name for x in self.columns.values()):
            raise SchemaError(f"{self.name} already has a column {c.name}")
        c.prefix = c.prefix or self.column_prefix
        self.columns[c.name] = c
        return c

    def find(self, name: str) -> Column | None:
        """A column by its short or full name."""
        if name in self.columns:
            return self.columns[name]
        return next((c for c in self.columns.values() if c.full_name == name), None)

    def column(self, name: str) -> Column:
        c = self.find(name)
        if c is None:
            raise SchemaError(f"table {self.name} has no column {name!r}")
        return c

    def full_names(self, names: list[str]) -> list[str]:
        return [self.column(n).full_name for n in names]

    def identity(self) -> list[str]:
        """Short names of the primary key, or else of the first unique key."""
        key = self.primary_key or next(iter(self.unique_keys), [])
        if not key:
            raise SchemaError(f"table {self.name} has no key")
        return key

    def struct(self) -> T.StructType:
        return T.StructType([c.struct_field() for c in self.columns.values()])

    def keys(self) -> list[list[str]]:
        return [k for k in [self.primary_key, *self.unique_keys] if k]

    def foreign_to(self, other: Table) -> list[ForeignKey]:
        return [f for f in self.foreign_keys if self.catalog.table(f.reference) is other]

    def required(self) -> list[str]:
        """Columns that an insert must give: neither generated, nullable nor with a default."""
        return [c.name for c in self.columns.values() if not (c.type.nullable or c.type.has_default or c.type.get("auto_increment") or c.type.get("auto"))]

    def to_dict(self) -> dict:
        def column(c: Column) -> dict:
            out = c.type.to_dict()
            for k in ("private", "sensitive", "old_name", "diff_key", "meta"):
                if getattr(c, k):
                    out[k] = getattr(c, k)
            if c.redacted is not None:
                out["redacted"] = c.redacted
            return out

        constraints: list[dict] = []
        if self.primary_key:
            constraints.append({"type": "primary_key", "columns": list(self.primary_key)})
        constraints += [{"type": "unique_key", "columns": list(k)} for k in self.unique_keys]
        constraints += [{"type": "foreign_key", "reference": f.reference, "columns": dict(f.columns), "on_update": f.on_update, "on_delete": f.on_delete} for f in self.foreign_keys]
        return {
            "singular_name": self.singular, "plural_name": self.plural, "prefix": self.prefix, "column_prefix": self.column_prefix, "private": self.private, "morph_type": self.morph_type, "meta": self.meta,
            "soft_deletable": self.soft_deletes, "old_name": self.old_name, "diff_key": self.diff_key,
            "columns": {n: column(c) for n, c in self.columns.items()},
            "constraints": constraints,
            "indexes": [{"columns": i.columns, "type": i.kind} for i in self.indexes],
            "relations": {n: r.spec for n, r in self.relations.items() if getattr(r, "spec", None)},
        }


class TableBuilder:
    """Fluent declaration of a table's columns, keys and relations."""

    def __init__(self, table: Table):
        self.table = table

    def column(self, name: str, spec: dict | str | ty.Type, **flags: Any) -> TableBuilder:
        t = self.table
        if isinstance(spec, str):
            if not REFERENCE.fullmatch(spec):
                raise SchemaError(f"{name}: {spec!r} is not a reference to a column")
            t.add_column(Column(name, None, reference=spec, **flags))
            return self
        if isinstance(spec, dict):
            spec = dict(spec)
            for k in ("private", "sensitive", "redacted", "meta", "old_name", "diff_key", "prefix"):
                if k in spec:
                    flags.setdefault(k, spec.pop(k))
            if REFERENCE.fullmatch(str(spec.get("type"))):
                ref, over = spec.pop("type"), spec
                c = t.add_column(Column(name, None, reference=ref, **flags))
                c.meta = {**c.meta, "_over": over}
                return self
            spec = ty.make(spec)
        t.add_column(Column(name, spec, **flags))
        return self

    def _typed(self, kind: str, name: str, opts: dict) -> TableBuilder:
        return self.column(name, {"type": kind, **opts})

    def string(self, name: str, **o: Any) -> TableBuilder:
        return self._typed("string", name, o)

    def int(self, name: str, **o: Any) -> TableBuilder:
        return self._typed("int", name, o)

    def bigint(self, name: str, **o: Any) -> TableBuilder:
        return self._typed("bigint", name, o)

    def float(self, name: str, **o: Any) -> TableBuilder:
        return self._typed("float", name, o)

    def decimal(self, name: str, **o: Any) -> TableBuilder:
        return self._typed("decimal", name, o)

    def bool(self, name: str, **o: Any) -> TableBuilder:
        return self._typed("bool", name, o)

    def json(self, name: str, **o: Any) -> TableBuilder:
        return self._typed("json", name, o)

    def list(self, name: str, **o: Any) -> TableBuilder:
        return self._typed("list", name, o)

    def map(self, name: str, **o: Any) -> TableBuilder:
        return self._typed("map", name, o)

    def date(self, name: str, **o: Any) -> TableBuilder:
        return self._typed("date", name, o)

    def enum(self, name: str, **o: Any) -> TableBuilder:
        return self._typed("enum", name, o)

    def same_as(self, name: str, table: str, column: str) -> TableBuilder:
        return self.column(name, f"ref:{table}.{column}")

    def id(self, name: str = "id") -> TableBuilder:
        self.bigint(name, unsigned=True, auto_increment=True)
        return self.primary(name)

    def timestamps(self) -> TableBuilder:
        return self.date("created_at", auto=True).date("updated_at", auto=True)

    def soft_deletable(self) -> TableBuilder:
        self.table.soft_deletes = True
        return self.bool("deleted", default=False).date("deleted_at", nullable=True)

    def morph(self, prefix: str, nullable: bool = False) -> TableBuilder:
        return self.bigint(f"{prefix}_id", unsigned=True, nullable=nullable).string(f"{prefix}_type", max=64, nullable=nullable)

    def foreign(self, name: str, table: str, column: str, nullable: bool = False, **actions: str) -> TableBuilder:
        self.column(name, {"type": f"ref:{table}.{column}", **({"nullable": True} if nullable else {})})
        self.table.foreign_keys.append(ForeignKey(table, {name: column}, **actions))
        return self

    def primary(self, *columns: str) -> TableBuilder:
        self.table._open()
        self.table.primary_key = list(columns)
        return self

    def unique(self, *columns: str) -> TableBuilder:
        self.table._open()
        self.table.unique_keys.append(list(columns))
        return self

    def index(self, columns: Any, kind: str = "btree") -> TableBuilder:
        self.table._open()
        if kind not in INDEX_KINDS:
            raise SchemaError(f"unknown kind of index {kind!r}")
        self.table.indexes.append(Index([*columns] if not isinstance(columns, str) else [columns], kind))
        return self

    def private(self, on: bool = True) -> TableBuilder:
        self.table.private = on
        return self

    def collection(self, name: str, make: Callable[..., DataFrame]) -> TableBuilder:
        if name in self.table.collections or name in self.table.relations:
            raise SchemaError(f"{self.table.name} already has {name}")
        self.table.collections[name] = make
        return self

    def relation(self, name: str, kind: str, target: str, link: dict | None = None, select: Any = None) -> TableBuilder:
        from marlspike.operators.relations import Relation

        self.table._open()
        if name in self.table.relations or name in self.table.collections:
            raise SchemaError(f"{self.table.name} already has {name}")
        self.table.relations[name] = Relation(name, kind, self.table, target, link, select)
        return self

    def has_one(self, name: str, target: str, link: dict | None = None, select: Any = None) -> TableBuilder:
        return self.relation(name, "one-to-one", target, link, select)

    def has_many(self, name: str, target: str, link: dict | None = None, select: Any = None) -> TableBuilder:
        return self.relation(name, "one-to-many", target, link, select)

    def belongs_to(self, name: str, target: str, link: dict | None = None, select: Any = None) -> TableBuilder:
        return self.relation(name, "many-to-one", target, link, select)

    def belongs_to_many(self, name: str, target: str, link: dict | None = None, select: Any = None) -> TableBuilder:
        return self.relation(name, "many-to-many", target, link, select)

    def virtual_relation(self, name: str, controller: Any, paginated: bool = False) -> TableBuilder:
        from marlspike.operators.relations import VirtualRelation

        self.table._open()
        self.table.relations[name] = VirtualRelation(name, self.table, controller, paginated)
        return self


class Catalog:
    """All tables of a database, bound to a session and a store of their rows."""

    def __init__(self, spark: SparkSession | None = None, store: Any = None, charset: str | None = None, collate: str | None = None):
        self.spark, self.store = spark, store
        self.charset, self.collate = charset, collate
        self.tables: dict[str, Table] = {}
        self.frozen = False

    def table_builder(self, name: str, declare: Callable[[TableBuilder], Any] | None = None, **options: Any) -> TableBuilder:
        if self.frozen:
            raise SchemaError("the schema is locked")
        if name in self.tables:
            if self.tables[name].namespace != options.get("namespace", "default"):
                raise SchemaError(f"table {name} belongs to namespace {self.tables[name].namespace}")
            builder = TableBuilder(self.tables[name])
        else:
            t = Table(name, self, **options)
            if self.find(t.full_name):
                raise SchemaError(f"there is already a table {t.full_name}")
            self.tables[name] = t
            builder = TableBuilder(t)
        if declare:
            declare(builder)
        return builder

    def find(self, name: str) -> Table | None:
        """A table by its short or full name."""
        if name in self.tables:
            return self.tables[name]
        return next((t for t in self.tables.values() if t.full_name == name), None)

    def table(self, name: str | Table) -> Table:
        if isinstance(name, Table):
            return name
        t = self.find(name)
        if t is None:
            raise SchemaError(f"there is no table {name!r}")
        return t

    def load(self, schema: dict | str, namespace: str = "default", prefix: str = "") -> Catalog:
        """Tables from a dict, or from a JSON file by its path: columns, then keys, indexes and relations."""
        if isinstance(schema, str):
            with open(schema) as f:
                schema = json.load(f)
        builders = {}
        for name, spec in schema.items():
            opts = {"singular": spec.get("singular_name", ""), "plural": spec.get("plural_name", ""), "prefix": spec.get("prefix") or prefix}
            opts |= {k: spec[k] for k in ("column_prefix", "private", "morph_type", "meta", "old_name", "diff_key", "charset", "collate") if spec.get(k)}
            b = builders[name] = self.table_builder(name, namespace=namespace, **opts)
            for c, s in spec.get("columns", {}).items():
                b.column(c, s)
            b.table.soft_deletes = spec.get("soft_deletable", {"deleted", "deleted_at"} <= set(spec.get("columns", {})))
        for name, spec in schema.items():
            t = builders[name].table
            for c in spec.get("constraints", []):
                kind, cols = c["type"], c["columns"]
                if kind == "primary_key":
                    t.primary_key = list(cols)
                elif kind == "unique_key":
                    t.unique_keys.append(list(cols))
                elif kind == "foreign_key":
                    t.foreign_keys.append(ForeignKey(c["reference"], dict(cols), on_update=c.get("on_update", "none"), on_delete=c.get("on_delete", "none")))
                else:
                    raise SchemaError(f"{name}: unknown constraint {kind!r}")
            for i in spec.get("indexes", []):
                builders[name].index(i["columns"], i.get("type", "btree"))
        for name, spec in schema.items():
            for r, s in spec.get("relations", {}).items():
                builders[name].relation(r, s["type"], s["target"], s.get("link"), s.get("select"))
        return self

    def to_dict(self) -> dict:
        return {n: t.to_dict() for n, t in self.tables.items()}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), default=str)

    def _resolve(self, t: Table, c: Column, path: tuple[str, ...] = ()) -> None:
        if c.type is not None:
            return
        here = f"{t.name}.{c.name}"
        if here in path:
            raise SchemaError(f"columns refer to each other: {' -> '.join([*path, here])}")
        kind, table, column = REFERENCE.fullmatch(c.reference).groups()
        source = self.table(table).column(column)
        self._resolve(self.table(table), source, (*path, here))
        spec = source.type.to_dict()
        if isinstance(source.type, ty.Enum):
            spec |= {"enum_class": source.type.get("enum_class")} if source.type.get("enum_class") else {}
        if kind == "ref":
            spec.pop("auto_increment", None)
        else:
            c.meta = {**copy.deepcopy(source.meta), **c.meta}
        c.type = ty.make({**spec, **c.meta.pop("_over", {})})

    def freeze(self) -> Catalog:
        """Resolve references, check keys and relations, and lock the schema."""
        if self.frozen:
            return self
        for t in self.tables.values():
            for c in t.columns.values():
                self._resolve(t, c)
        morphs: dict[str, str] = {}
        for t in self.tables.values():
            if morphs.setdefault(t.morph_type, t.name) != t.name:
                raise SchemaError(f"{t.name} and {morphs[t.morph_type]} have the same morph type")
            for key in t.keys():
                for c in key:
                    t.column(c)
            if nullable := [c for c in t.primary_key if t.column(c).type.nullable]:
                raise SchemaError(f"{t.name}: {nullable} of the primary key may be null")
            for i in t.indexes:
                t.full_names(i.columns)
            for f in t.foreign_keys:
                other = self.table(f.reference)
                if sorted(f.columns.values()) not in [sorted(k) for k in other.keys()]:
                    raise SchemaError(f"{t.name}: a foreign key must refer to a key of {other.name}")
                for action in (f.on_update, f.on_delete):
                    if action not in ACTIONS:
                        raise SchemaError(f"{t.name}: unknown action {action!r}")
                    if action == "set_null" and not all(t.column(c).type.nullable for c in f.columns):
                        raise SchemaError(f"{t.name}: columns set to null must be nullable")
        for t in self.tables.values():
            for r in t.relations.values():
                r.check()
        self.frozen = True
        return self

    def read(self, table: str | Table) -> DataFrame:
        """The rows of a table, under full column names."""
        self.freeze()
        return self.store.read(self.table(table))
