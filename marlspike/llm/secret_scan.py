"""Secret scans: fixed patterns, and random strings that a vocabulary of tokens encodes badly."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marlspike.llm.byte_bpe import read_ranks
from marlspike.llm.common import col, map_text

#: The base patterns, in order, the group whose length counts, and the least length.
BASE = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
KINDS = ("assign", "access", "hex", "random")

#: Candidates of the efficiency test: so many characters of these at least, a digit and a letter among them.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
#: Parts of a candidate between = signs, like the value after a name; padding goes with the part before it.
_PART = re.compile(r"([^=]{16,})(=*$)?")
#: A candidate with fewer characters a token than this is random. Words of Latin script have over 2.5.
LEAST_PER_TOKEN = 2.0
#: Lengths in hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512: known digests.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
_HEX = re.compile(r"[0-9a-fA-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_SRI = re.compile(r"sha(256|384|512)-[A-Za-z0-9+/]+=*")
#: Identifiers: words and numbers joined by marks, or words in camel case with numbers at the end.
_IDENTIFIER = re.compile(r"[+/_=-]*([A-Za-z]+|[0-9]+)([+/_=-]+([A-Za-z]+[0-9]{0,4}|[0-9]+))*[+/_=-]*|[A-Za-z]?[a-z]+([A-Z][a-z]+)*[0-9]{0,4}")
#: Characters that any match of the patterns has.
_ASSIGN = re.compile(BASE[0][1], re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(BASE[1][1])
# a run of fewer digits would be dropped, and a longer one starts where its maximal run does
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the base patterns keep, in order; kind is its place in KINDS."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= BASE[0][3]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= BASE[1][3]]
    out += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(out)


def excluded(word: str) -> bool:
    """Known digests and identifiers are not secrets for being hard to encode."""
    if not (any(c.isdigit() for c in word) and any(c.isalpha() for c in word)):
        return True
    if _UUID.fullmatch(word) or _SRI.fullmatch(word) or _IDENTIFIER.fullmatch(word):
        return True
    return len(word) in DIGEST_LENGTHS and _HEX.fullmatch(word) is not None


def random_spans(text: str, taken: list[tuple[int, int, int]], n_tokens) -> list[tuple[int, int, int]]:
    """Spans of candidates, or else of their parts, with few characters a token that touch none of those taken."""
    out = []

    def is_random(word: str, a: int, b: int) -> bool:
        return not excluded(word) and not any(s < b and a < e for s, _, e in taken) and len(word) < LEAST_PER_TOKEN * n_tokens(word)

    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        if is_random(m[0], a, b):
            out.append((a, 3, b))
        elif "=" in m[0] and not excluded(m[0]):
            # a readable name would hide the value it has
            out += [(a + x.start(), 3, a + x.end()) for x in _PART.finditer(m[0]) if is_random(x[1], a + x.start(), a + x.end())]
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _maker(ranks, pattern: str):
    def make():
        import tiktoken

        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})

        def count(word: str) -> int:
            return len(enc.encode_ordinary(word))

        def run(texts: list[str | None]) -> list:
            rows = []
            for text in texts:
                text = text or ""
                base = base_spans(text)
                more = random_spans(text, base, count)
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + more))))
            return list(zip(*rows, strict=True))

        return run

    return make


def scan(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of docs.

    spans has kind:start:end in code points, end exclusive, of all base matches and of the random
    strings outside of them, by start, then kind. Null texts count as empty; ids may be null or
    repeated; no rows give no rows; other columns are ignored. Row by row, without a shuffle."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    fields = [T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex")] + [T.StructField(n, T.StringType()) for n in ("base_sha256", "spans")]
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    return map_text(rows, "text", fields, _maker(ranks, pattern), ["doc_id"])
