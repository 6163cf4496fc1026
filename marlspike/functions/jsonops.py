"""JSON in text columns: extraction, containment, keys, patches. One rule for all: that of jsonb.

Static fragments and keys compile to expressions inside the JVM. Only containment of a column in
another, and patches of columns, need Python, in Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from marlspike.errors import FilterError
from marlspike.plans.fields import parse_path


def key_text(key: str) -> str:
    """The path of a key of an object, digits or not. Paths have no escapes, only two kinds of quotes."""
    if "'" not in key:
        return f"$['{key}']"
    if '"' not in key:
        return f'$["{key}"]'
    raise FilterError(f"the key {key!r} has both kinds of quotes: no path can name it")


def path_text(segments: Sequence[str]) -> str:
    """A path for variant_get, and for get_json_object if no key has a single quote."""
    return "$" + "".join(f"[{s}]" if s.isdigit() else key_text(s)[1:] for s in segments)


def extract(c: Column, path: Sequence[str] | str) -> Column:
    """The value at the path as text; null where it is missing or JSON null."""
    segments = parse_path(path) if isinstance(path, str) else list(path)
    if any("'" in s for s in segments):
        return F.try_variant_get(F.try_parse_json(c), path_text(segments), "string")
    return F.get_json_object(c, path_text(segments))


def extract_json(c: Column, path: Sequence[str]) -> Column:
    """The value at the path as JSON text, so that texts keep their quotes."""
    return F.to_json(F.try_variant_get(F.try_parse_json(c), path_text(path), "variant"))


def has_key(c: Column, key: str) -> Column:
    """Whether an object has the key, at the end of a dotted path; a JSON null counts as a value."""
    *parents, leaf = parse_path(key)
    inner = extract_json(c, parents) if parents else c
    return F.coalesce(F.array_contains(F.json_object_keys(inner), leaf), F.lit(False))


def contains(c: Column, fragment: Any) -> Column:
    """Whether the JSON text c contains the fragment: a value, a JSON text, or a Column of JSON texts."""
    if isinstance(fragment, Column):
        return _contains_udf(c, fragment)
    if isinstance(fragment, str):
        try:
            fragment = json.loads(fragment)
        except ValueError:
            raise FilterError(f"{fragment!r} is no JSON") from None
    if _unnamed(fragment):
        return _contains_udf(c, F.lit(json.dumps(fragment)))
    v = F.try_parse_json(c)
    out = _inside(v, fragment)
    if not isinstance(fragment, (list, dict)):
        # an array contains a scalar that is one of its elements
        out = out | F.exists(_elements(v), lambda e: _scalar(e, fragment))
    return F.when(c.isNotNull(), F.coalesce(out, F.lit(False)))


def _unnamed(x: Any) -> bool:
    """Whether a key has both kinds of quotes, so that no path names it."""
    if isinstance(x, dict):
        return any(("'" in k and '"' in k) or _unnamed(v) for k, v in x.items())
    return isinstance(x, list) and any(map(_unnamed, x))


def _elements(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _scalar(v: Column, x: Any) -> Column:
    if x is None:
        return F.coalesce(F.is_variant_null(v), F.lit(False))
    kind = _kind(v)
    if isinstance(x, bool):
        return F.coalesce((kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == x), F.lit(False))
    if isinstance(x, str):
        return F.coalesce((kind == "STRING") & (F.try_variant_get(v, "$", "string") == x), F.lit(False))
    number = (kind == "BIGINT") | (kind == "DOUBLE") | F.startswith(kind, F.lit("DECIMAL"))
    as_type = "bigint" if isinstance(x, int) and abs(x) < 1 << 62 else "double"
    same = F.try_variant_get(v, "$", "double") == float(x)
    if as_type == "bigint":
        same = F.when(kind == "BIGINT", F.try_variant_get(v, "$", "bigint") == x).otherwise(same)
    return F.coalesce(number & same, F.lit(False))


def _some(x: Any) -> Any:
    return lambda e: F.coalesce(_inside(e, x), F.lit(False))


def _inside(v: Column, x: Any) -> Column:
    """Objects: every key, with a value that contains the fragment's. Arrays: each element in some element."""
    if isinstance(x, dict):
        out = F.startswith(_kind(v), F.lit("OBJECT"))
        for k, sub in x.items():
            out = out & F.coalesce(_inside(F.try_variant_get(v, key_text(k), "variant"), sub), F.lit(False))
        return out
    if isinstance(x, list):
        out = F.startswith(_kind(v), F.lit("ARRAY"))
        for sub in x:
            out = out & F.exists(_elements(v), _some(sub))
        return out
    return _scalar(v, x)


def contains_value(whole: Any, part: Any, top: bool = True) -> bool:
    """The same rule on Python values."""
    if isinstance(part, dict):
        return isinstance(whole, dict) and all(k in whole and contains_value(whole[k], v, False) for k, v in part.items())
    if isinstance(part, list):
        return isinstance(whole, list) and all(any(contains_value(w, p, False) for w in whole) for p in part)
    if top and isinstance(whole, list):
        return any(not isinstance(w, (list, dict)) and contains_value(w, part, False) for w in whole)
    if isinstance(whole, bool) or isinstance(part, bool):
        return isinstance(whole, bool) and isinstance(part, bool) and whole == part
    return not isinstance(whole, (list, dict)) and whole == part


def _load(text: str | None) -> tuple[bool, Any]:
    try:
        return text is not None, None if text is None else json.loads(text)
    except ValueError:
        return False, None


def _contains_udf(c: Column, part: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(whole: pd.Series, inner: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(whole, inner, strict=True):
            (ok_a, x), (ok_b, y) = _load(a), _load(b)
            out.append(contains_value(x, y) if ok_a and ok_b else (None if a is None or b is None else False))
        return pd.Series(out, dtype="object")

    return run(c, part)


class JsonPatch:
    """Set and remove values by path; a map that a patch has changed is written back whole."""

    def __init__(self, value: Any = None):
        self.value = dict(value) if isinstance(value, dict) else {}
        self.steps: list[tuple[str, list[str], Any]] = []

    def set(self, path: str, value: Any) -> JsonPatch:
        self.steps.append(("set", parse_path(path), value))
        return self

    def remove(self, path: str) -> JsonPatch:
        self.steps.append(("remove", parse_path(path), None))
        return self

    def apply(self, value: Any = None) -> dict:
        """A patched copy: missing maps are made on the way and other values replaced; what is missing is not removed."""
        out = json.loads(json.dumps(value if isinstance(value, dict) else self.value))
        for kind, path, v in self.steps:
            at = out
            for s in path[:-1]:
                if not isinstance(at.get(s), dict):
                    if kind == "remove":
                        break
                    at[s] = {}
                at = at[s]
            else:
                if kind == "set":
                    at[path[-1]] = v
                else:
                    at.pop(path[-1], None)
        return out

    def apply_to(self, c: Column) -> Column:
        """The patch on a column of JSON texts; null counts as an empty map."""
        patch = self

        @F.pandas_udf("string")
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: json.dumps(patch.apply(_load(t)[1] or {}), separators=(",", ":"), ensure_ascii=False))

        return run(c)


def encode(c: Column) -> Column:
    """Structs, arrays and maps as JSON text."""
    return F.to_json(c)


def decode(c: Column, schema: str) -> Column:
    """Typed values from JSON text: the form of a list, map or JSON column whose elements are declared."""
    return F.from_json(c, schema)
