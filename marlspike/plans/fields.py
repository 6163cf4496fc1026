"""Field notation: [table.]column[#json.path], and paths inside JSON values."""

from __future__ import annotations

from dataclasses import dataclass

from marlspike.errors import FilterError


def parse_path(text: str) -> list[str]:
    """Segments of a path like a.b['with.dot'][0]; quotes inside brackets escape with a backslash."""
    out: list[str] = []
    i, n = 0, len(text)
    after_bracket = False
    while i < n:
        if text[i] == "[":
            i += 1
            if i < n and text[i] in "'\"":
                q, buf = text[i], ""
                i += 1
                while i < n and text[i] != q:
                    if text[i] == "\\" and i + 1 < n:
                        i += 1
                    buf += text[i]
                    i += 1
                if i >= n:
                    raise FilterError(f"unterminated quote in path {text!r}")
                i += 1
            else:
                end = text.find("]", i)
                buf = text[i:end] if end >= 0 else ""
                if not buf.isdigit():
                    raise FilterError(f"bad bracket in path {text!r}")
                i = end
            if i >= n or text[i] != "]":
                raise FilterError(f"missing ] in path {text!r}")
            i += 1
            out.append(buf)
            after_bracket = True
            continue
        if text[i] == ".":
            if not out or i + 1 >= n:
                raise FilterError(f"empty segment in path {text!r}")
            i += 1
            if text[i] in ".[":
                raise FilterError(f"empty segment in path {text!r}")
        elif after_bracket:
            raise FilterError(f"missing dot in path {text!r}")
        end = i
        while end < n and text[end] not in ".[":
            end += 1
        out.append(text[i:end])
        i, after_bracket = end, False
    if not out or "" in out:
        raise FilterError("a path cannot be empty" if not out else f"empty segment in path {text!r}")
    return out


def print_path(segments: list[str]) -> str:
    """The text of a path; parse_path() gives the segments back."""
    out = ""
    for s in segments:
        if s.replace("_", "a").replace("-", "a").isalnum() and not s.isdigit():
            out += ("." if out else "") + s
        elif s.isdigit():
            out += f"[{s}]"
        else:
            out += "['" + s.replace("\\", "\\\\").replace("'", "\\'") + "']"
    return out


@dataclass(frozen=True)
class Field:
    """A parsed field: table or alias (or None), column, and path segments (or none)."""

    column: str
    table: str | None = None
    path: tuple[str, ...] = ()

    def __str__(self) -> str:
        return (f"{self.table}." if self.table else "") + self.column + (f"#{print_path(list(self.path))}" if self.path else "")


def parse_field(text: str) -> Field:
    head, mark, path = text.partition("#")
    table, dot, column = head.strip().rpartition(".")
    if not column or (dot and not table):
        raise FilterError("a field name cannot be empty")
    return Field(column, table or None, tuple(parse_path(path)) if mark else ())


def is_field(text: str) -> bool:
    """Whether a text has the form of a field, as opposed to that of an expression."""
    try:
        f = parse_field(text)
    except FilterError:
        return False
    return all(p.replace("_", "a").isalnum() and not p[0].isdigit() for p in [f.column, *([f.table] if f.table else [])])
