"""Class stubs from a catalog: Python, TypeScript and Dart."""

from __future__ import annotations

from marlspike.catalog import Catalog, Table

#: The type names of each language.
NAMES = {
    "python": {"string": "str", "int": "int", "bigint": "int", "float": "float", "decimal": "Decimal", "bool": "bool", "json": "Any", "list": "list", "map": "dict", "date": "int", "enum": "str"},
    "typescript": {"string": "string", "int": "number", "bigint": "string", "float": "number", "decimal": "string", "bool": "boolean", "json": "unknown", "list": "unknown[]", "map": "Record<string, unknown>", "date": "string", "enum": "string"},
    "dart": {"string": "String", "int": "int", "bigint": "String", "float": "double", "decimal": "String", "bool": "bool", "json": "dynamic", "list": "List<dynamic>", "map": "Map<String, dynamic>", "date": "String", "enum": "String"},
}


def class_name(table: Table) -> str:
    return "".join(p.capitalize() for p in table.singular.split("_"))


def _fields(table: Table, language: str) -> list[tuple[str, str, bool]]:
    names = NAMES[language]
    return [(c.name, names.get(c.type.name, names[c.type.base]), c.type.nullable) for c in table.columns.values() if not c.private]


def python(table: Table) -> str:
    lines = [f"class {class_name(table)}:", f'    """A row of {table.name}."""', ""]
    return "\n".join(lines + [f"    {n}: {t}{' | None' if null else ''}" for n, t, null in _fields(table, "python")]) + "\n"


def typescript(table: Table) -> str:
    body = "".join(f"\t{n}: {t}{' | null' if null else ''};\n" for n, t, null in _fields(table, "typescript"))
    return f"export interface {class_name(table)} {{\n{body}}}\n"


def dart(table: Table) -> str:
    fields = _fields(table, "dart")
    body = "".join(f"  final {t}{'?' if null and t != 'dynamic' else ''} {n};\n" for n, t, null in fields)
    args = "".join(f"    {'' if null or t == 'dynamic' else 'required '}this.{n},\n" for n, t, null in fields)
    return f"class {class_name(table)} {{\n{body}\n  {class_name(table)}({{\n{args}  }});\n}}\n"


def generate(catalog: Catalog, language: str) -> dict[str, str]:
    """The source of each public table's class, by table name."""
    make = {"python": python, "typescript": typescript, "dart": dart}[language]
    return {n: make(t) for n, t in catalog.freeze().tables.items() if not t.private}
