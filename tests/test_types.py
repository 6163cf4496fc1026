import datetime as dt
import enum
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marlspike import types as ty
from marlspike.errors import SchemaError, ValueRefused

OK = object()


class Colour(enum.Enum):
    RED = "red"
    BLUE = "blue"


@pytest.mark.parametrize(
    "spec, value, want",
    [
        ({"type": "string"}, 12, "12"), ({"type": "string"}, "", ""), ({"type": "string", "nullable": True}, "", None), ({"type": "string", "default": "d"}, None, "d"),
        ({"type": "string", "multiline": False, "trim": True}, "  a \n b ", "a b"), ({"type": "string", "max": 3, "truncate": True}, "abcd", "abc"),
        ({"type": "string", "max": 1}, "é", ValueRefused), ({"type": "string", "min": 2}, "a", ValueRefused), ({"type": "string"}, None, ValueRefused), ({"type": "string"}, True, ValueRefused),
        ({"type": "string", "pattern": "^a+$"}, "aa", "aa"), ({"type": "string", "pattern": "^a+$"}, "ab", ValueRefused), ({"type": "string", "one_of": ["x"]}, "y", ValueRefused),
        ({"type": "int"}, "12.9", 12), ({"type": "int"}, 1 << 31, ValueRefused), ({"type": "int", "unsigned": True}, 1 << 31, 1 << 31), ({"type": "int", "unsigned": True}, -1, ValueRefused),
        ({"type": "int", "min": 3, "max": 5}, 6, ValueRefused), ({"type": "int"}, "a", ValueRefused), ({"type": "int"}, True, ValueRefused), ({"type": "int", "nullable": True}, None, None),
        ({"type": "bigint"}, "9000000000", 9_000_000_000), ({"type": "bigint"}, "1.5", ValueRefused), ({"type": "bigint", "unsigned": True}, (1 << 64) - 1, (1 << 64) - 1),
        ({"type": "float"}, "1e3", 1000.0), ({"type": "float", "unsigned": True}, -0.5, ValueRefused), ({"type": "float"}, "nan", ValueRefused),
        ({"type": "decimal", "max": "1.05"}, "1.06", ValueRefused), ({"type": "decimal", "max": "1.05"}, "1.04", Decimal("1.04")),
        ({"type": "bool"}, 1, True), ({"type": "bool"}, "0", False), ({"type": "bool"}, "yes", ValueRefused), ({"type": "bool", "strict": False}, "Off", False),
        ({"type": "json"}, {"a": [1]}, {"a": [1]}), ({"type": "json"}, object(), ValueRefused), ({"type": "list", "list_of": "int"}, [1, "a"], ValueRefused), ({"type": "list"}, [], []),
        ({"type": "map", "map_of": "string"}, {"a": "b"}, {"a": "b"}), ({"type": "map"}, [1], ValueRefused), ({"type": "map"}, "", {}),
        ({"type": "date"}, "2020-01-01", 1577836800), ({"type": "date"}, 5, 5), ({"type": "date", "precision": "microseconds"}, "1.25", Decimal("1.25")), ({"type": "date"}, "no date", ValueRefused),
        ({"type": "date"}, dt.date(1970, 1, 2), 86400), ({"type": "date", "min": "2020-01-01"}, "2019-12-31", ValueRefused),
        ({"type": "enum", "enum_class": Colour}, "red", "red"), ({"type": "enum", "enum_class": Colour}, Colour.BLUE, "blue"), ({"type": "enum", "enum_class": Colour}, "green", ValueRefused),
    ],
)
def test_validation(spec, value, want):
    t = ty.make(spec)
    if want is ValueRefused:
        with pytest.raises(ValueRefused):
            t.validate(value)
    else:
        assert t.validate(value) == want


def test_declarations_are_checked():
    for spec in ({"type": "int", "min": 3, "max": 1}, {"type": "nope"}, {"type": "int", "what": 1}, {"type": "decimal", "precision": 40}):
        with pytest.raises(SchemaError):
            ty.make(spec)
    with pytest.raises(ValueRefused):
        ty.make({"type": "int", "default": "x"})


def test_validators_and_states():
    t = ty.make({"type": "int"})
    t.pre = lambda s: s.accept(7) if s.value == "seven" else None
    assert t.validate("seven") == 7 and t.validate("3") == 3
    t.post = lambda s: s.reject("no odd numbers") if s.state == "accepted" and s.clean % 2 else None
    with pytest.raises(ValueRefused, match="odd"):
        t.validate("seven")
    with pytest.raises(ValueRefused):
        ty.Subject(1).get()


def test_allowed_operators():
    assert "is_null" not in ty.make({"type": "int"}).allowed_operators()
    assert "is_null" in ty.make({"type": "int", "nullable": True}).allowed_operators()
    assert ty.make({"type": "bool"}).allowed_operators() == ["eq", "neq", "is_true", "is_false"]
    assert "has_key" in ty.make({"type": "json"}).allowed_operators() and "has_key" not in ty.make({"type": "json", "native_json": False}).allowed_operators()


def test_custom_types():
    class Percent(ty.Float):
        name = "percent"

        def core(self, v):
            return super().core(str(v).rstrip("%"))

    ty.register_types(Percent)
    assert ty.make({"type": "percent"}).validate("5%") == 5.0

    class Bad(ty.Type):
        name, base = "bad", "blob"

    with pytest.raises(SchemaError):
        ty.register_types(Bad)


def test_expressions(spark):
    t = {n: ty.make(s) for n, s in {"s": {"type": "string", "max": 2}, "i": {"type": "int", "min": 0}, "j": {"type": "json", "nullable": True}, "e": {"type": "enum", "one_of": ["a"]}}.items()}
    df = spark.createDataFrame([("é", 1, "{}", "a"), ("éa", -1, "{", "b"), (None, 2, None, "a")], "s string, i int, j string, e string")
    got = df.select(*[x.invalid(F.col(n)).alias(n) for n, x in t.items()]).collect()
    assert [tuple(r) for r in got] == [(False, False, False, False), (True, True, True, True), (True, False, False, False)]
    d = ty.make({"type": "date"})
    out = spark.createDataFrame([("2020-01-01",), ("17",), ("x",)], "v string").select(d.encode(F.col("v")).alias("v"), d.format_column(d.encode(F.col("v"))).alias("f")).collect()
    assert [r.v for r in out] == [1577836800, 17, None] and out[0].f == "2020-01-01T00:00:00Z"


def test_dirty_text():
    t = ty.make({"type": "json"})
    assert t.dirty_text({"a": 1, "b": 2}) != t.dirty_text({"b": 2, "a": 1}) and t.dirty_text(True) == "1" and t.dirty_text(None) == ""
