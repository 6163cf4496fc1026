"""Filter expressions as text: `a eq :x and (b gt 3 or c is_null)`.

group := item (and|or item)*      item := '(' group ')' | filter      filter := field operator [value]

In strict mode values are bindings and bare words; otherwise numbers and quoted texts too. The
result is the nested list form that Filters.from_list() takes."""

from __future__ import annotations

import re
from typing import Any, NamedTuple

from marlspike.errors import FilterError
from marlspike.types import OPERATORS, UNARY


class Token(NamedTuple):
    kind: str  # open, close, binding, text, number, cond, op, word
    value: str
    at: int


_QUOTED = r"""'(?:\\'|[^'])*'|"(?:\\"|[^"])*\""""
_WORD = re.compile(rf"(?:\[(?:{_QUOTED}|[^\]'\"]*)\]|[^\s()\[])+")
_NUMBER = re.compile(r"-?\d+(?:\.\d+)?(?=[\s()]|$)")
_TEXT = re.compile(_QUOTED)
_BINDING = re.compile(r":(\w*)", re.ASCII)


def tokenize(text: str, strict: bool = True) -> list[Token]:
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c.isspace():
            i += 1
            continue
        if c in "()":
            out.append(Token("open" if c == "(" else "close", c, i))
            i += 1
        elif c == ":":
            m = _BINDING.match(text, i)
            if not m[1]:
                raise FilterError(f"empty binding name at {i} in {text!r}")
            out.append(Token("binding", m[1], i))
            i = m.end()
        elif not strict and c in "'\"":
            m = _TEXT.match(text, i)
            if not m:
                raise FilterError(f"unterminated text at {i} in {text!r}")
            out.append(Token("text", m[0][1:-1].replace("\\" + c, c), i))
            i = m.end()
        elif not strict and (m := _NUMBER.match(text, i)):
            out.append(Token("number", m[0], i))
            i = m.end()
        else:
            m = _WORD.match(text, i)
            if not m:
                raise FilterError(f"unexpected {c!r} at {i} in {text!r}")
            low = m[0].lower()
            kind = "cond" if low in ("and", "or") else "op" if low in OPERATORS else "word"
            out.append(Token(kind, low if kind != "word" else m[0], i))
            i = m.end()
    return out


class Parser:
    def __init__(self, text: str, bindings: dict[str, Any] | None = None, strict: bool = True):
        self.text, self.bindings = text, dict(bindings or {})
        self.tokens, self.at = tokenize(text, strict), 0

    def parse(self) -> list:
        if not self.tokens:
            return []
        out = self._group(0)
        if self.at < len(self.tokens):
            raise self._error("unexpected", self.tokens[self.at])
        return out

    def _error(self, what: str, token: Token | None) -> FilterError:
        where = f"{token.value!r} at {token.at}" if token else "the end"
        return FilterError(f"{what} {where} in {self.text!r}")

    def _next(self) -> Token | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def _group(self, depth: int) -> list:
        out = [self._item(depth)]
        while (t := self._next()) and t.kind == "cond":
            self.at += 1
            out += [t.value, self._item(depth)]
        return out

    def _item(self, depth: int) -> list:
        t = self._next()
        if t is None or t.kind not in ("open", "word"):
            raise self._error("a filter is missing before", t)
        self.at += 1
        if t.kind == "word":
            return self._filter(t.value)
        inner = self._group(depth + 1)
        end = self._next()
        if end is None or end.kind != "close":
            raise self._error("missing ) before", end)
        self.at += 1
        return inner

    def _filter(self, left: str) -> list:
        op = self._next()
        if op is None or op.kind != "op":
            raise self._error("an operator is missing before", op)
        self.at += 1
        if op.value in UNARY:
            return [left, op.value]
        v = self._next()
        if v is None or v.kind not in ("binding", "text", "number", "word"):
            raise self._error("a value is missing before", v)
        self.at += 1
        if v.kind == "binding":
            if v.value not in self.bindings:
                raise FilterError(f"missing value for binding :{v.value}")
            return [left, op.value, self.bindings[v.value]]
        if v.kind == "number":
            return [left, op.value, float(v.value) if "." in v.value else int(v.value)]
        return [left, op.value, v.value]
