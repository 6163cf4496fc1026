"""Byte-level BPE through a sentencepiece model that is written directly from a vocabulary of ranks."""

from __future__ import annotations

import base64
import codecs
import hashlib
import struct
from collections.abc import Iterable
from itertools import accumulate, chain

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlspike.llm.common import map_text

#: Fixed value: the pattern of the rank files, whose matches hold no space but in front.
SPLITTABLE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What an unknown id decodes to: U+FFFD.
UNKNOWN_BYTES = b"\xef\xbf\xbd"
#: Encoded words that a task keeps at once.
MEMO_WORDS = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def byte_letters() -> list[str]:
    """One printable character for each byte: itself if printable in Latin-1, else the next one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | bytes | float) -> bytes:
    """A field of a protocol buffer: a varint, a length-delimited string or a 32-bit float."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model of the vocabulary: byte-mapped pieces scored by negative rank.

    Piece 0 is the unknown one that sentencepiece needs, so ids are places in rank order plus 1.
    Normalisation is the identity: no dummy prefix, and white space is left as it is."""
    # fixed values: field numbers and enumerators of sentencepiece_model.proto
    piece, trainer, normalizer = 1, 2, 3
    piece_text, piece_score, piece_type, type_unknown = 1, 2, 3, 2
    model_type, vocab_size, unk_id, bos_id, eos_id, pad_id, unk_piece, bpe = 3, 4, 40, 41, 42, 43, 45, 2
    name, add_dummy_prefix, remove_extra_whitespaces, escape_whitespaces = 1, 3, 4, 5

    letters = byte_letters()
    unknown = "⁇unk⁇"
    pieces = [_field(piece_text, unknown.encode()) + _field(piece_score, 0.0) + _field(piece_type, type_unknown)]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        pieces.append(_field(piece_text, "".join(letters[b] for b in token).encode()) + _field(piece_score, float(-rank)))
    spec = _field(model_type, bpe) + _field(vocab_size, len(pieces)) + _field(unk_id, 0) + _field(bos_id, -1) + _field(eos_id, -1) + _field(pad_id, -1) + _field(unk_piece, unknown.encode())
    norm = _field(name, b"identity") + _field(add_dummy_prefix, 0) + _field(remove_extra_whitespaces, 0) + _field(escape_whitespaces, 0)
    return b"".join(_field(piece, p) for p in pieces) + _field(trainer, spec) + _field(normalizer, norm)


class ByteBpe:
    """Encodes texts to ids in little-endian 32-bit form, and decodes them.

    A text is cut before each space that a character other than white space follows. Matches of the
    pattern SPLITTABLE never reach over such a place, so each part's ids are computed once and kept.
    With any other pattern a text is one part."""

    def __init__(self, ranks: dict[bytes, int], model: bytes, pattern: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ranks = ranks
        tokens = sorted(ranks.items(), key=lambda x: x[1])
        self.of_piece = np.array([0, *[rank for _, rank in tokens]], "<u4")
        self.token = {rank: token for token, rank in tokens}
        self.pattern = regex.compile(pattern)
        self.splits = pattern == SPLITTABLE
        self.letters = "".join(byte_letters())
        self.memo: dict[str, bytes] = {}

    @staticmethod
    def parts(text: str) -> list[str]:
        """The text in parts, each but the first with its space in front."""
        cut = text.split(" ")
        for x in cut[1:]:
            if not x or x[0].isspace():
                break
        else:
            return [cut[0], *[" " + x for x in cut[1:]]]
        out = [cut[0]]
        for x in cut[1:]:
            if not x or x[0].isspace():
                out[-1] += " " + x
            else:
                out.append(" " + x)
        return out

    def _learn(self, parts: Iterable[str]) -> None:
        words = {p: self.pattern.findall(p) for p in parts}
        own = sorted({w for found in words.values() for w in found})
        raw = [w.encode("utf-8", "surrogatepass") for w in own]
        # each byte is one letter, so one call maps them all
        mapped = codecs.charmap_decode(b"".join(raw), "strict", self.letters)[0]
        ends = list(accumulate(map(len, raw)))
        encoded = self.sp.encode([mapped[a:b] for a, b in zip([0, *ends], ends)], num_threads=1)
        flat = self.of_piece[np.fromiter(chain.from_iterable(encoded), np.int64)].tobytes()
        stops = [4 * n for n in accumulate(map(len, encoded))]
        # a word that is a token itself is that token, as in the library for the ranks
        own_rank = self.ranks.get
        ids = {w: flat[a:b] if (r := own_rank(x)) is None else r.to_bytes(4, "little") for w, x, a, b in zip(own, raw, [0, *stops], stops)}
        for p, found in words.items():
            self.memo[p] = b"".join([ids[w] for w in found])

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        cut = [self.parts(t or "") if self.splits else [t or ""] for t in texts]
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        unknown = {p for x in cut for p in x} - self.memo.keys()
        if unknown:
            self._learn(unknown)
        get = self.memo.__getitem__
        return [b"".join(map(get, x)) for x in cut]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the ids; an id that the vocabulary lacks, or one cut short, is U+FFFD."""
        whole = len(ids) // 4 * 4
        got = np.frombuffer(ids[:whole], "<u4").tolist()
        try:
            out = b"".join(map(self.token.__getitem__, got))
        except KeyError:
            out = b"".join([self.token.get(i, UNKNOWN_BYTES) for i in got])
        return out if whole == len(ids) else out + UNKNOWN_BYTES


def _maker(files, pattern: str, finish, *args):
    def make():
        ranks, model = files.value
        return finish(ByteBpe(ranks, model, pattern), *args)

    return make


def _digests(bpe: ByteBpe):
    def run(texts: list[str | None]) -> list:
        ids = bpe.encode_all(texts)
        return [[len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]]

    return run


def _ids(bpe: ByteBpe, verify: bool):
    def run(texts: list[str | None]) -> list:
        ids = bpe.encode_all(texts)
        if verify:
            for text, x in zip(texts, ids, strict=True):
                if bpe.decode(x) != (text or "").encode("utf-8", "surrogatepass"):
                    raise ValueError(f"ids do not decode to their text: {text[:80]!r}")
        return [[len(x) // 4 for x in ids], ids]

    return run


def _decoded(bpe: ByteBpe):
    return lambda texts: [[None if x is None else bpe.decode(x).decode("utf-8", "replace") for x in texts]]


def _files(df: DataFrame, ranks_path: str):
    ranks = read_ranks(ranks_path)
    return df.sparkSession.sparkContext.broadcast((ranks, sentencepiece_model(ranks)))


def _without(df: DataFrame, *names: str) -> list[str]:
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", n_name: str = "n_tokens", ids_name: str = "ids", verify: bool = False) -> DataFrame:
    """docs with the number of tokens and the ids (32-bit, little-endian) of each whole text; null and empty texts have none.

    Columns of docs that have those names, in any case of letters, are replaced. verify decodes each
    text's ids again and fails if the bytes differ. Row by row, in Arrow batches: no shuffle; texts
    are whole, however long; repeated rows come out as often; no rows give no rows."""
    fields = [T.StructField(n_name, T.LongType()), T.StructField(ids_name, T.BinaryType())]
    return map_text(docs, text_col, fields, _maker(_files(docs, ranks_path), pattern, _ids, verify), _without(docs, n_name, ids_name))


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """encoded with the text of each row's ids; null ids give null, empty ones an empty text.

    A token cut off inside a character, an unknown id and an id cut short give U+FFFD. A column of
    that name is replaced."""
    return map_text(encoded, ids_col, [T.StructField(name, T.StringType())], _maker(_files(encoded, ranks_path), pattern, _decoded), _without(encoded, name))


def digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, the hash of the bytes that the ids decode to, of every row.

    Null texts count as empty, ids may be null or repeated, other columns are ignored."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return map_text(rows, "text", fields, _maker(_files(docs, ranks_path), pattern, _digests), ["doc_id"])
