"""Column types: what they accept, how values are stored in Spark, which filters they allow.

A type is used on the driver for single values (validate, cast_for_filter) and on columns as
expressions (invalid, encode): those never leave the JVM."""

from __future__ import annotations

import datetime as dt
import enum
import json
import re
from collections.abc import Callable
from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlspike.errors import SchemaError, ValueRefused

#: The filter operators, and those without a right operand.
OPERATORS = ("eq", "neq", "lt", "lte", "gt", "gte", "like", "not_like", "is_null", "is_not_null", "in", "not_in", "is_true", "is_false", "contains", "has_key")
UNARY = ("is_null", "is_not_null", "is_true", "is_false")

#: Element types of lists and maps.
ELEMENTS = {"string": str, "int": int, "bigint": int, "float": float, "decimal": (int, float, str, Decimal), "bool": bool, "list": list, "map": dict, "any": object}

_MISSING = object()


class Subject:
    """A value on its way through validation: undecided, accepted with a clean value, or rejected."""

    def __init__(self, value: Any):
        self.value, self.clean, self.reason, self.state = value, None, None, "undecided"

    def accept(self, clean: Any) -> None:
        self.state, self.clean, self.reason = "accepted", clean, None

    def reject(self, reason: str) -> None:
        self.state, self.reason = "rejected", reason

    def get(self) -> Any:
        if self.state != "accepted":
            raise ValueRefused(self.reason or "the value was not validated")
        return self.clean


class Type:
    """Base of all types. Options are keyword arguments and survive to_dict() and make()."""

    name = ""
    base = ""
    options: tuple[str, ...] = ()

    def __init__(self, nullable: bool = False, default: Any = _MISSING, **options: Any):
        unknown = set(options) - set(self.options)
        if unknown:
            raise SchemaError(f"{self.name}: unknown options {sorted(unknown)}")
        self.nullable, self._default, self.opts = nullable, default, options
        self.pre: Callable[[Subject], None] | None = None
        self.post: Callable[[Subject], None] | None = None
        self.check()
        if self.has_default and default is not None:
            self.validate(default)

    def check(self) -> None:
        low, high = self.opts.get("min"), self.opts.get("max")
        if low is not None and high is not None and self.order(low) > self.order(high):
            raise SchemaError(f"{self.name}: min {low} is over max {high}")

    def order(self, v: Any) -> Any:
        return v

    @property
    def has_default(self) -> bool:
        return self._default is not _MISSING

    @property
    def default(self) -> Any:
        return None if self._default is _MISSING else self._default

    def get(self, option: str, default: Any = None) -> Any:
        return self.opts.get(option, default)

    # single values

    def absent(self, v: Any) -> bool:
        return v is None

    def core(self, v: Any) -> Any:
        """The clean value, or ValueRefused."""
        raise NotImplementedError

    def validate(self, value: Any) -> Any:
        """Pre-validator, the type's own rules if that left it open, then always the post-validator."""
        s = Subject(value)
        if self.pre:
            self.pre(s)
        if s.state == "undecided":
            try:
                if self.absent(value):
                    if self.has_default:
                        s.accept(None if self.default is None else self.core(self.default))
                    elif self.nullable:
                        s.accept(None)
                    else:
                        s.reject(f"{self.name}: a value is required")
                else:
                    s.accept(self.core(value))
            except ValueRefused as e:
                s.reject(str(e))
        if self.post:
            self.post(s)
        return s.get()

    def cast_for_filter(self, value: Any) -> Any:
        """The right side of a filter as the column stores it; texts and JSON pass as they are."""
        return value

    def refuse(self, v: Any, why: str) -> ValueRefused:
        return ValueRefused(f"{self.name}: {v!r} {why}")

    def bounded(self, v: Any) -> Any:
        low, high = self.get("min"), self.get("max")
        if low is not None and v < self.order(low):
            raise self.refuse(v, f"is under {low}")
        if high is not None and v > self.order(high):
            raise self.refuse(v, f"is over {high}")
        return v

    # columns

    def spark_type(self) -> T.DataType:
        raise NotImplementedError

    def invalid(self, c: Column) -> Column:
        """True for values of a column that validate() would refuse, as far as an expression can tell."""
        return c.isNull() & F.lit(not self.nullable and not self.has_default) | F.coalesce(self.out_of_bounds(c), F.lit(False))

    def out_of_bounds(self, c: Column) -> Column:
        bad = F.lit(False)
        if self.get("min") is not None:
            bad |= c < F.lit(self.order(self.get("min")))
        if self.get("max") is not None:
            bad |= c > F.lit(self.order(self.get("max")))
        return bad

    def encode(self, c: Column) -> Column:
        """A column of any type in this type's storage; what cannot be cast becomes null."""
        return c.try_cast(self.spark_type())

    def allowed_operators(self) -> list[str]:
        """Operators that get helper methods: texts and numbers have neither truth nor JSON parts."""
        out = [o for o in OPERATORS if o not in ("is_true", "is_false", "contains", "has_key")]
        return self.only_nullable(out)

    def only_nullable(self, ops: list[str]) -> list[str]:
        return [o for o in ops if self.nullable or o not in ("is_null", "is_not_null")]

    def dirty_text(self, v: Any) -> str:
        """What two values are compared by: scalars as text, all else as JSON with its key order."""
        if isinstance(v, (dict, list)):
            return json.dumps(v)
        return "" if v is None else ("1" if v else "0") if isinstance(v, bool) else str(v)

    def to_dict(self) -> dict:
        out: dict = {"type": self.name, **self.opts}
        if self.nullable:
            out["nullable"] = True
        if self.has_default:
            out["default"] = self.default
        return out

    def same_storage(self, other: Type) -> bool:
        return self.to_dict() == other.to_dict()


def _number(t: Type, v: Any) -> Decimal:
    if isinstance(v, bool) or not isinstance(v, (int, float, str, Decimal)):
        raise t.refuse(v, "is not a number")
    try:
        n = Decimal(str(v).strip())
    except InvalidOperation:
        raise t.refuse(v, "is not a number") from None
    if not n.is_finite():
        raise t.refuse(v, "is not a number")
    return n


class String(Type):
    name = base = "string"
    options = ("min", "max", "pattern", "one_of", "truncate", "trim", "multiline", "medium", "long")

    def absent(self, v: Any) -> bool:
        # an empty text counts as missing unless it is the only way to say nothing
        return v is None or (v == "" and (self.has_default or self.nullable))

    def core(self, v: Any) -> str:
        if isinstance(v, bool) or not isinstance(v, (str, int, float, Decimal)):
            raise self.refuse(v, "is not a text")
        v = str(v)
        if not self.get("multiline", True):
            v = re.sub(r"\s+", " ", v)
        if self.get("trim"):
            v = v.strip()
        size, high = len(v.encode()), self.get("max")
        if self.get("min") is not None and size < self.get("min"):
            raise self.refuse(v, f"has under {self.get('min')} bytes")
        if high is not None and size > high:
            if not self.get("truncate"):
                raise self.refuse(v, f"has over {high} bytes")
            v = v.encode()[:high].decode("utf-8", "ignore")
        if self.get("pattern") is not None and not re.search(self.get("pattern"), v):
            raise self.refuse(v, f"does not match {self.get('pattern')}")
        if self.get("one_of") is not None and v not in self.get("one_of"):
            raise self.refuse(v, f"is none of {self.get('one_of')}")
        return v

    def spark_type(self) -> T.DataType:
        return T.StringType()

    def out_of_bounds(self, c: Column) -> Column:
        size, bad = F.octet_length(c), F.lit(False)
        if self.get("min") is not None:
            bad |= size < self.get("min")
        if self.get("max") is not None and not self.get("truncate"):
            bad |= size > self.get("max")
        if self.get("pattern") is not None:
            bad |= ~c.rlike(self.get("pattern"))
        if self.get("one_of") is not None:
            bad |= ~c.isin(list(self.get("one_of")))
        return bad


class Int(Type):
    name = base = "int"
    options = ("min", "max", "unsigned", "auto_increment")
    bits = 31

    def limits(self) -> tuple[int, int]:
        return (0, (1 << (self.bits + 1)) - 1) if self.get("unsigned") else (-(1 << self.bits), (1 << self.bits) - 1)

    def core(self, v: Any) -> int:
        n = int(_number(self, v))
        low, high = self.limits()
        if not low <= n <= high:
            raise self.refuse(v, f"is not in {low}..{high}")
        return self.bounded(n)

    def cast_for_filter(self, value: Any) -> Any:
        return None if value is None else int(_number(self, value))

    def spark_type(self) -> T.DataType:
        return T.LongType() if self.get("unsigned") else T.IntegerType()

    def out_of_bounds(self, c: Column) -> Column:
        return super().out_of_bounds(c) | (F.lit(bool(self.get("unsigned"))) & (c < 0))


class Bigint(Int):
    name = base = "bigint"
    bits = 63

    def core(self, v: Any) -> int:
        n = _number(self, v)
        if n != n.to_integral_value():
            raise self.refuse(v, "is not a whole number")
        return super().core(int(n))

    def spark_type(self) -> T.DataType:
        # unsigned values over 2^63 - 1 need the decimal form
        return T.DecimalType(20, 0) if self.get("unsigned") and (self.get("max") or 0) > (1 << 63) - 1 else T.LongType()


class Float(Type):
    name = base = "float"
    options = ("min", "max", "unsigned", "mantissa")

    def core(self, v: Any) -> float:
        n = float(_number(self, v))
        if self.get("unsigned") and n < 0:
            raise self.refuse(v, "is negative")
        return self.bounded(n)

    def cast_for_filter(self, value: Any) -> Any:
        return None if value is None else float(_number(self, value))

    def spark_type(self) -> T.DataType:
        return T.DoubleType()

    def out_of_bounds(self, c: Column) -> Column:
        return super().out_of_bounds(c) | (F.lit(bool(self.get("unsigned"))) & (c < 0))


class DecimalNumber(Type):
    name = base = "decimal"
    options = ("min", "max", "unsigned", "precision", "scale")

    def check(self) -> None:
        if (self.get("precision") or 0) > 38:
            raise SchemaError("decimal: Spark has 38 digits at most")
        super().check()

    def order(self, v: Any) -> Any:
        return Decimal(str(v))

    def core(self, v: Any) -> Decimal:
        n = _number(self, v)
        if self.get("unsigned") and n < 0:
            raise self.refuse(v, "is negative")
        return self.bounded(n)

    def cast_for_filter(self, value: Any) -> Any:
        return None if value is None else _number(self, value)

    def spark_type(self) -> T.DataType:
        return T.DecimalType(self.get("precision") or 38, self.get("scale") if self.get("scale") is not None else (0 if self.get("precision") else 18))

    def out_of_bounds(self, c: Column) -> Column:
        return super().out_of_bounds(c) | (F.lit(bool(self.get("unsigned"))) & (c < 0))


class Bool(Type):
    name = base = "bool"
    options = ("strict",)
    #: Texts that a non-strict column takes.
    TRUE, FALSE = ("true", "1", "yes", "on", "y"), ("false", "0", "no", "off", "n")

    def core(self, v: Any) -> bool:
        if isinstance(v, bool):
            return v
        if isinstance(v, (int, float)) and v in (0, 1):
            return bool(v)
        if isinstance(v, str):
            if v in ("0", "1"):
                return v == "1"
            if not self.get("strict", True) and v.lower() in self.TRUE + self.FALSE:
                return v.lower() in self.TRUE
        raise self.refuse(v, "is not a truth value")

    def cast_for_filter(self, value: Any) -> Any:
        return None if value is None else self.core(value)

    def spark_type(self) -> T.DataType:
        return T.BooleanType()

    def allowed_operators(self) -> list[str]:
        return self.only_nullable(["eq", "neq", "is_null", "is_not_null", "is_true", "is_false"])


class Json(Type):
    name = base = "json"
    options = ("native_json", "big", "json_of")

    def core(self, v: Any) -> Any:
        try:
            json.dumps(v)
        except (TypeError, ValueError):
            raise self.refuse(v, "has no JSON form") from None
        kind = self.get("json_of")
        if isinstance(kind, str) and not isinstance(v, ELEMENTS.get(kind, object)):
            raise self.refuse(v, f"is no {kind}")
        return v

    def native(self) -> bool:
        return bool(self.get("native_json", True))

    def spark_type(self) -> T.DataType:
        return T.StringType()

    def allowed_operators(self) -> list[str]:
        return self.only_nullable(["eq", "neq", "like", "not_like", "is_null", "is_not_null"] + (["contains", "has_key"] if self.native() else []))

    def to_text(self, v: Any) -> str | None:
        return None if v is None else json.dumps(v, separators=(",", ":"), ensure_ascii=False)

    def invalid(self, c: Column) -> Column:
        return super().invalid(c) | (c.isNotNull() & F.try_parse_json(c).isNull())


def element_ok(kind: Any, v: Any) -> bool:
    if kind is None or kind == "any":
        return True
    if kind in ("int", "bigint", "float") and isinstance(v, bool):
        return False
    return isinstance(v, ELEMENTS.get(kind, object)) or (kind == "float" and isinstance(v, int))


class List(Json):
    name = "list"
    options = ("list_of", "native_json", "big")

    def core(self, v: Any) -> list:
        if not isinstance(v, (list, tuple)):
            raise self.refuse(v, "is not a list")
        if not all(element_ok(self.get("list_of"), x) for x in v):
            raise self.refuse(v, f"has elements other than {self.get('list_of')}")
        return super().core(list(v))


class Map(Json):
    name = "map"
    options = ("map_of", "native_json", "big")

    def core(self, v: Any) -> dict:
        if v == "" or v == []:
            v = {}
        if not isinstance(v, dict):
            raise self.refuse(v, "is not a map")
        if not all(element_ok(self.get("map_of"), x) for x in v.values()):
            raise self.refuse(v, f"has values other than {self.get('map_of')}")
        return super().core({str(k): x for k, x in v.items()})


class Date(Type):
    """Epoch seconds, or decimals with microseconds."""

    name, base = "date", "bigint"
    options = ("format", "min", "max", "auto", "precision")

    def micro(self) -> bool:
        return self.get("precision") == "microseconds"

    def order(self, v: Any) -> Any:
        return self.epoch(v)

    def epoch(self, v: Any) -> int | Decimal:
        if isinstance(v, dt.datetime):
            v = v if v.tzinfo else v.replace(tzinfo=dt.UTC)
            n = Decimal(str(v.timestamp()))
        elif isinstance(v, dt.date):
            n = Decimal(int(dt.datetime(v.year, v.month, v.day, tzinfo=dt.UTC).timestamp()))
        else:
            try:
                n = _number(self, v)
            except ValueRefused:
                if not isinstance(v, str):
                    raise
                try:
                    return self.epoch(dt.datetime.fromisoformat(v.strip()))
                except ValueError:
                    raise self.refuse(v, "is not a date") from None
        return n if self.micro() else int(n)

    def core(self, v: Any) -> int | Decimal:
        return self.bounded(self.epoch(v))

    def validate(self, value: Any) -> Any:
        if value is None and self.get("auto") and not self.has_default:
            value = dt.datetime.now(dt.UTC)
        return super().validate(value)

    def cast_for_filter(self, value: Any) -> Any:
        return None if value is None else self.epoch(value)

    def spark_type(self) -> T.DataType:
        return T.DecimalType(20, 6) if self.micro() else T.LongType()

    def format_column(self, c: Column, pattern: str = "yyyy-MM-dd'T'HH:mm:ssXXX") -> Column:
        """Epoch seconds as text; the format 'timestamp' leaves the number."""
        if self.get("format") == "timestamp":
            return c.cast("string")
        return F.date_format(F.timestamp_seconds(c), self.get("format") or pattern)

    def encode(self, c: Column) -> Column:
        return F.coalesce(c.try_cast(self.spark_type()), F.unix_timestamp(F.try_to_timestamp(c.cast("string"))).cast(self.spark_type()))


class Enum(String):
    name, base = "enum", "string"
    options = ("enum_class", "one_of")

    def cases(self) -> list:
        kind = self.get("enum_class")
        if isinstance(kind, type) and issubclass(kind, enum.Enum):
            return [c.value for c in kind]
        return list(self.get("one_of") or [])

    def core(self, v: Any) -> str:
        v = v.value if isinstance(v, enum.Enum) else v
        if v not in self.cases():
            raise self.refuse(v, f"is none of {self.cases()}")
        return v

    def out_of_bounds(self, c: Column) -> Column:
        return ~c.isin(self.cases())

    def to_dict(self) -> dict:
        out = super().to_dict()
        if "enum_class" in out:
            out["one_of"] = self.cases()
            del out["enum_class"]
        return out


BASES = ("string", "int", "bigint", "float", "decimal", "bool", "json")
_REGISTRY: list[dict[str, type[Type]]] = [{t.name: t for t in (String, Int, Bigint, Float, DecimalNumber, Bool, Json, List, Map, Date, Enum)}]


def register_types(*kinds: type[Type]) -> None:
    """Add custom types; the latest wins. Each stands on one of the seven base types."""
    for k in kinds:
        if k.base not in BASES:
            raise SchemaError(f"{k.name}: {k.base} is not a base type")
    _REGISTRY.append({k.name: k for k in kinds})


def make(spec: dict) -> Type:
    """A type from its options, as Type.to_dict() gives them."""
    opts = dict(spec)
    name = opts.pop("type", None)
    for provider in reversed(_REGISTRY):
        if name in provider:
            return provider[name](**opts)
    raise SchemaError(f"unknown type {name!r}")
