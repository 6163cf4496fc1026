"""Token counts with a cache by digest: only texts that no run has seen are encoded."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlspike.llm.common import SPACES, checkpoint, col, delete_path, forget, map_text, path_exists, settled, shared_path

#: Part of every tokenizer digest: counts made under another rule of normalisation are not used.
RULE = "1"
#: Words whose counts a task keeps at once, and words encoded in one call: results hold much more than ids.
MEMO_WORDS, CALL_WORDS = 300_000, 32_768
#: Up to so many misses, their digests (32 bytes each) go to every task and select the texts there.
BROADCAST_MISSES = 100_000
SCHEMA = "content binary, tokenizer string, n_tokens long"


class Tokenizer:
    """A tokenizer file: .json for tokenizers, .model for sentencepiece. Encodes without added tokens."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.file = f.read()
        self.kind = path.rsplit(".", 1)[-1]
        if self.kind not in ("json", "model"):
            raise ValueError(f"{path}: neither a .json nor a .model file")
        #: Words between white space are encoded apart: white space only separates, whatever its length.
        self.by_word = self.kind == "json" and self._drops_spaces(json.loads(self.file))
        self.digest = hashlib.sha256(f"{RULE}:{self.kind}:{self.by_word}:".encode() + self.file).hexdigest()

    @staticmethod
    def _drops_spaces(spec: dict) -> bool:
        """Whether the file turns white space to single spaces and then keeps only matches that hold none."""
        norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        norms = norm.get("normalizers", [norm])
        pres = pre.get("pretokenizers", [pre])
        first = pres[0]
        collapses = any(n.get("type") == "Replace" and n.get("pattern") == {"Regex": r"\s+"} and n.get("content") == " " for n in norms)
        known = all(n.get("type") in ("Replace", "NFC", "Lowercase") for n in norms)
        keeps = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
        branches = first.get("pattern", {}).get("Regex", " ").split("|") if keeps else [" "]
        spaceless = all(re.fullmatch(r"'\w+|\[?\\p\{[LN]\}\]?\+?|\[\^\\s\\p\{L\}\\p\{N\}\]\+", b) for b in branches)
        special = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized")) for t in spec.get("added_tokens", []))
        return collapses and known and keeps and spaceless and special


class Counter:
    """Counts the tokens of whole texts, in one task."""

    def __init__(self, file: bytes, kind: str, by_word: bool):
        self.by_word = by_word
        self.memo: dict[str, int] = {}
        if kind == "json":
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            import tokenizers

            own = tokenizers.Tokenizer.from_buffer(file)
            own.no_truncation()
            own.no_padding()
            self.count = lambda texts: [len(e.ids) for e in own.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_proto=file)
            self.count = lambda texts: [len(e) for e in sp.encode(texts, num_threads=1)]

    def __call__(self, texts: list[str | None]) -> list[int]:
        if not self.by_word:
            return self.count([t or "" for t in texts])
        words = [(t or "").split(" ") for t in texts]
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        new = list({w for x in words for w in x} - self.memo.keys())
        for at in range(0, len(new), CALL_WORDS):
            part = new[at : at + CALL_WORDS]
            self.memo.update(zip(part, self.count(part)))
        get = self.memo.__getitem__
        return [sum(map(get, x)) for x in words]


def content_digest(text: Column, by_word: bool) -> Column:
    """SHA-256 of the normalised text: null as empty, runs of white space as one space where they only separate.

    Never null, and known to be so: else joins would compute it once more, to leave out nulls."""
    text = F.coalesce(text, F.lit(""))
    return F.coalesce(F.unhex(F.sha2(F.regexp_replace(text, SPACES, " ") if by_word else text, 256)), F.lit(b""))


def read_cache(spark: SparkSession, path: str, tokenizer: Tokenizer) -> DataFrame:
    """(content, n_tokens) that the cache holds for the tokenizer, one row a text; none if there is no cache yet."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "content binary, n_tokens long")
    rows = spark.read.schema(SCHEMA).parquet(path).where(F.col("tokenizer") == tokenizer.digest)
    # writers that ran at once may have appended the same texts
    return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def _count_misses(docs: DataFrame, tokenizer: Tokenizer, wanted: DataFrame, n: int, text_col: str) -> DataFrame:
    """(content, tokenizer, n_tokens), one row for each of the n wanted digests of texts of docs."""
    file = docs.sparkSession.sparkContext.broadcast(tokenizer.file)
    kind, by_word = tokenizer.kind, tokenizer.by_word

    def make():
        count = Counter(file.value, kind, by_word)
        return lambda texts: [count(texts)]

    texts = docs.select(content_digest(col(text_col), by_word).alias("content"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    few = n <= BROADCAST_MISSES
    if few:
        texts = texts.join(F.broadcast(wanted), "content", "left_semi")
    # copies are combined before the shuffle, so a text that many rows share moves once for each task
    one = texts.groupBy("content").agg(F.first("text").alias("text"))
    if not few:
        # wanted digests are distinct; Spark would move a semi-join in front of the aggregate, and copies through the shuffle
        one = one.join(wanted, "content")
    counted = map_text(one, "text", [T.StructField("n_tokens", T.LongType())], make, ["content"])
    return counted.select("content", F.lit(tokenizer.digest).alias("tokenizer"), "n_tokens")


def count_tokens(docs: DataFrame, tokenizer: Tokenizer, cache: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row of docs.

    cache is a path that all executors reach: a Parquet table of counts by digests of content and
    tokenizer. Texts that it has are not encoded; the others are, once for each distinct one, and
    are appended. Without a path the cache is a new one, deleted once the result is written.

    Null texts count as empty; ids may be null or repeated, and repeated rows come out as often;
    texts are whole, however long; no rows give no rows; other columns, whatever their names, are
    ignored."""
    spark = docs.sparkSession
    path = cache or shared_path(spark, "token-counts")
    digest = content_digest(col(text_col), tokenizer.by_word)
    sized = checkpoint(docs.select(col(id_col).alias("doc_id"), F.coalesce(F.octet_length(col(text_col)), F.lit(0)).cast("long").alias("n_bytes"), digest.alias("content")))
    misses = checkpoint(sized.select("content").distinct().join(read_cache(spark, path, tokenizer), "content", "left_anti"))
    if n := misses.count():
        _count_misses(docs, tokenizer, misses, n, text_col).write.mode("append").parquet(path)
    forget(misses)
    known = settled(read_cache(spark, path, tokenizer), "content")
    out = sized.join(known, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    if cache is None:
        out = checkpoint(out)
        forget(sized)
        delete_path(spark, path)
    return out
