"""Raw SQL: single statements with named or positional parameters, and scripts of several."""

from __future__ import annotations

import enum
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.catalog import Catalog
from marlspike.errors import QueryError


class Bindings:
    """Parameters of a raw statement: all named or all positional."""

    def __init__(self) -> None:
        self.named: dict[str, Any] = {}
        self.positional: list[Any] = []

    @staticmethod
    def plain(v: Any) -> Any:
        return v.value if isinstance(v, enum.Enum) else v

    def bind_named(self, name: str, value: Any) -> Bindings:
        if self.positional:
            raise QueryError("named and positional parameters do not mix")
        self.named[name.lstrip(":")] = self.plain(value)
        return self

    def bind_array(self, values: dict[str, Any]) -> Bindings:
        for k, v in values.items():
            self.bind_named(k, v)
        return self

    def bind_positional(self, *values: Any) -> Bindings:
        if self.named:
            raise QueryError("named and positional parameters do not mix")
        self.positional += [self.plain(v) for v in values]
        return self

    def merge(self, other: Bindings) -> Bindings:
        if other is not self:
            self.bind_array(other.named)
            if other.positional:
                self.bind_positional(*other.positional)
        return self


def expand_lists(sql: str, args: dict[str, Any]) -> tuple[str, dict[str, Any]]:
    """Lists among named parameters become one parameter for each element."""
    flat: dict[str, Any] = {}
    for k, v in args.items():
        if isinstance(v, (list, tuple, set)):
            parts = list(dict.fromkeys(v))
            flat |= {f"{k}_{i}": x for i, x in enumerate(parts)}
            sql = re.sub(rf":{re.escape(k)}\b", ", ".join(f":{k}_{i}" for i in range(len(parts))) or "NULL", sql)
        else:
            flat[k] = v
    return sql, flat


def run_sql(spark: SparkSession, sql: str, bindings: Bindings | dict | list | None = None, catalog: Catalog | None = None) -> DataFrame:
    """A statement over Spark's tables and, if given, those of the catalog by their full names."""
    if catalog is not None:
        register(catalog)
    if bindings is None:
        return spark.sql(sql)
    if isinstance(bindings, (list, tuple)):
        return spark.sql(sql, args=[F.lit(v) for v in bindings])
    if isinstance(bindings, Bindings):
        if bindings.positional:
            return spark.sql(sql, args=[F.lit(v) for v in bindings.positional])
        bindings = bindings.named
    sql, args = expand_lists(sql, bindings)
    return spark.sql(sql, args={k: F.lit(v) for k, v in args.items()})


def register(catalog: Catalog) -> None:
    """Temporary views of all tables, by full name."""
    for t in catalog.tables.values():
        catalog.read(t).createOrReplaceTempView(t.full_name)


def split_script(script: str) -> list[str]:
    """The statements of a script: cut at semicolons outside of quotes and comments."""
    out, buf = [], ""
    for m in re.finditer(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|;|[^'\"`;/-]+|.", script, re.S):
        text = m[0]
        if text == ";":
            out.append(buf)
            buf = ""
        elif not text.startswith(("--", "/*")):
            buf += text
    return [s.strip() for s in [*out, buf] if s.strip()]


def run_script(spark: SparkSession, script: str, catalog: Catalog | None = None) -> list[DataFrame]:
    if catalog is not None:
        register(catalog)
    return [spark.sql(s) for s in split_script(script)]
