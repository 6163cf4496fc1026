"""Quality rules with risk-controlled thresholds.

Cutoffs of a few features are chosen on labelled documents so that, in each stratum, they reject at
most a given part of the good ones: an exact binomial (Clopper-Pearson) bound has to say so, at a
confidence that holds for all strata and features together."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlspike.llm.common import checkpoint, col, forget, fresh, map_text

#: Words of a window, for repeats.
WINDOW = 8
MIN_WORDS, MOST_REPEATED = 20, 30
_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
#: Words handled at once.
_BLOCK_WORDS = 400_000

#: At most this part of a stratum's good documents may be rejected by all cutoffs together, but for
#: a chance of DELTA that any cutoff of any stratum breaks its part of it.
RISK, DELTA = 0.01, 0.05
#: Up to so many strata, their cutoffs (40 bytes each) go to every task; more are joined by a shuffle.
BROADCAST_STRATA = 100_000
#: Up to so many labelled documents, their ids (8 bytes each) go to every task, and only they are read for the cutoffs.
BROADCAST_LABELS = 200_000
#: Cutoffs of each feature from lax to strict. A document with a greater value is rejected.
GRID = {
    "symbol_ratio": [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.015, 0.01],
    "dup_line_ratio": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05],
    "repeat_ratio": [0.3, 0.28, 0.26, 0.24, 0.22, 0.2, 0.18, 0.16, 0.14, 0.12, 0.1, 0.08, 0.06, 0.04],
    "word_length": [40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.0],
}


def _codes(values: np.ndarray) -> np.ndarray:
    return pd.factorize(values)[0].astype(np.int64)


def repeated_words(words: list[list[bytes]]) -> np.ndarray:
    """For each list, the words in windows of WINDOW words that it has twice or more.

    Windows get numbers by doubling: equal pairs of words, of pairs and of fours have equal numbers."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    total = int(n.sum())
    out = np.zeros(len(words), np.int64)
    if total < WINDOW:
        return out
    doc = np.repeat(np.arange(len(words)), n)
    code = _codes(np.fromiter(chain.from_iterable(words), object, total))
    for step in (1, 2, 4):
        code = _codes(code[:-step] * (int(code.max()) + 1) + code[step:])
    starts = np.flatnonzero(doc[: 1 - WINDOW] == doc[WINDOW - 1 :])
    if not len(starts):
        return out
    window = _codes(code[starts] * len(words) + doc[starts])
    starts = starts[np.bincount(window)[window] > 1]
    if not len(starts):
        return out
    edges = np.bincount(starts, minlength=total + 1)[: total + 1] - np.bincount(starts + WINDOW, minlength=total + 1)[: total + 1]
    inside = np.cumsum(edges)[:total] > 0
    return np.bincount(doc[inside], minlength=len(words)).astype(np.int64)


def text_features(texts: list[str | None]) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_lines (with a word), n_repeat_words of whole texts."""
    out = np.zeros((6, len(texts)), np.int64)
    pending: list[list[bytes]] = []
    first = waiting = 0

    def flush(end: int) -> None:
        nonlocal pending, first, waiting
        out[5, first:end] = repeated_words(pending)
        pending, first, waiting = [], end, 0

    for i, text in enumerate(texts):
        text = text or ""
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()
        out[0, i] = len(words)
        out[1, i] = len(text) - (len(raw) - len(raw.translate(None, _SPACES)))
        out[2, i] = len(raw) - len(raw.translate(None, _SYMBOLS))
        if b"\n" in raw:
            lines = [x for x in raw.split(b"\n") if x.strip(_SPACES)]
            out[3, i], out[4, i] = len(lines) - len(set(lines)), len(lines)
        else:
            out[4, i] = bool(words)
        pending.append(words)
        waiting += len(words)
        if waiting > _BLOCK_WORDS:
            flush(i + 1)
    if pending:
        flush(len(texts))
    return list(out)


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")


def with_features(docs: DataFrame, text_col: str, keep: list[str], names: list[str]) -> DataFrame:
    return map_text(docs, text_col, [T.StructField(n, T.LongType()) for n in names], lambda: text_features, keep)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


def ratios(f: dict[str, Column]) -> dict[str, Column]:
    """The features that cutoffs apply to; 0 where there is nothing to divide by."""

    def part(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    return {
        "symbol_ratio": part(f["n_symbols"], f["word_chars"]),
        "dup_line_ratio": part(f["n_dup_lines"], f["n_lines"]),
        "repeat_ratio": part(f["n_repeat_words"], f["n_words"]),
        "word_length": part(f["word_chars"], f["n_words"]),
    }


def log_binomial_tail(k: int, n: int, p: float) -> float:
    """log P(X <= k) for X ~ Binomial(n, p), 0 < p < 1, summed from its largest term down."""
    top = math.lgamma(n + 1)
    terms = [top - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, -1, -1)]
    high = max(terms)
    return min(0.0, high + math.log(sum(math.exp(t - high) for t in terms)))


def certified(k: int, n: int, risk: float, delta: float) -> bool:
    """Whether the Clopper-Pearson upper bound of k of n, at confidence 1 - delta, is at most risk."""
    if n == 0 or k >= n:
        return False
    if k > n * risk:
        return False  # then P(X <= k) is about a half or more
    return log_binomial_tail(k, n, risk) <= math.log(delta)


def choose_cutoffs(n: int, rejected: dict[str, list[int]], caught: dict[str, list[int]], risk: float, delta: float) -> dict[str, float]:
    """For each feature the certified cutoff that catches most bad documents, the laxest of equal ones; none if it catches none.

    rejected[f][i] of n good documents and caught[f][i] bad ones exceed GRID[f][i]. A feature has an
    equal part of the risk. Cutoffs are tested in fixed order, lax to strict, up to the first that
    fails: that needs no correction for their number, and any of those that passed may be chosen."""
    out = {}
    for name, counts in rejected.items():
        most = 0
        for cutoff, k, bad in zip(GRID[name], counts, caught[name], strict=True):
            if not certified(k, n, risk / len(GRID), delta):
                break
            if bad > most:
                out[name], most = cutoff, bad
    return out


def usefulness(n: int, good: dict[str, list[int]], bad: dict[str, list[int]], risk: float) -> dict[str, int]:
    """For each feature the most bad documents of a cutoff that rejects at most this part of n good ones."""
    return {f: max((b for g, b in zip(good[f], bad[f], strict=True) if g <= n * risk), default=0) for f in GRID}


def most_features(n: int, risk: float, delta: float) -> int:
    """Of how many features n good documents can certify a cutoff at all, if these share risk and delta equally."""
    return max((m for m in range(1, len(GRID) + 1) if certified(0, n, risk / m, delta / m)), default=0)


def stratum_cutoffs(n: int, rejected: dict[str, list[int]], caught: dict[str, list[int]], ranked: list[str], risk: float, delta: float) -> dict[str, float]:
    """choose_cutoffs() for the first features of `ranked`, as many as n good documents suffice for; they alone share risk and delta.

    Neither their number nor `ranked` may depend on which of the n are rejected: so the bounds hold as
    if the features had been fixed."""
    m = most_features(n, risk, delta)
    if not m:
        return {}
    some = ranked[:m]
    # choose_cutoffs() gives each feature one part in len(GRID)
    return choose_cutoffs(n, {f: rejected[f] for f in some}, {f: caught[f] for f in some}, risk * len(GRID) / m, delta / m)


def _cutoff_maker(total: dict, risk: float, part: float):
    """Cutoffs of strata from rows of their counts; total has the sums of all strata."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                good, bad = [{f: [r[f"{name}_{f}_{i}"] for i in range(len(cs))] for f, cs in GRID.items()} for name in ("good", "bad")]
                others = [{f: [total[f"{name}_{f}_{i}"] - x for i, x in enumerate(own[f])] for f in GRID} for name, own in (("good", good), ("bad", bad))]
                useful = usefulness(total["n"] - r["n"], *others, risk)
                cut = stratum_cutoffs(r["n"], good, bad, sorted(GRID, key=lambda f: -useful[f]), risk, part)
                found.append([cut.get(f) for f in GRID])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.float64()) for x in zip(*found)]], names=["stratum", *GRID])

    return run


def fit(features: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Cutoffs (stratum, one column for each feature) from features (doc_id, stratum, FEATURES) and labels (doc_id, quality).

    A document is good if all its labels say 1. Those that the base rules reject anyway don't count.
    delta is divided by the number of strata. A stratum too small for all features gives its risk to
    those that are most useful in the other strata together, so that its own good documents have no
    part in the choice. All labelled documents are counted and every stratum is fitted, in Spark;
    only the sums over all strata, one row, come to the driver."""
    known = features.join(_judged(labels), "doc_id").where(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    value = ratios({f: F.col(f) for f in FEATURES})
    names = {f"{name}_{f}_{i}": (value[f] > c) & which for f, cs in GRID.items() for i, c in enumerate(cs) for name, which in (("good", F.col("good")), ("bad", ~F.col("good")))}
    per = checkpoint(known.groupBy("stratum").agg(F.count_if("good").alias("n"), *[F.count_if(which).alias(x) for x, which in names.items()]))
    total = per.agg(F.count(F.lit(1)).alias("strata"), *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("n", *names)]).first().asDict()
    schema = T.StructType([T.StructField("stratum", features.schema["stratum"].dataType)] + [T.StructField(f, T.DoubleType()) for f in GRID])
    cut = checkpoint(per.mapInArrow(_cutoff_maker(total, risk, delta / max(1, total["strata"])), schema))
    forget(per)
    return F.broadcast(cut) if total["strata"] <= BROADCAST_STRATA else cut


def passes(f: dict[str, Column], cutoff: dict[str, Column]) -> Column:
    """Whether no cutoff rejects; a cutoff that is null, or a stratum without any, rejects nothing."""
    ok = F.lit(True)
    for name, value in ratios(f).items():
        ok &= F.coalesce(value <= cutoff[name], F.lit(True))
    return ok


def _judged(labels: DataFrame) -> DataFrame:
    """(doc_id, good) of the documents with a label."""
    return labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))


def quality_report(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every row of docs.

    kept is false if the base rules fail, or a cutoff of the document's stratum rejects it. A null
    text has no words. A null stratum is one of its own; a null id has no label. Repeated rows come
    out as often. Without labels, or without rows, only the base rules apply. Other columns, whatever
    their names, are ignored. Whole texts are read once."""
    base = docs.select(col(id_col).alias("doc_id"), col(stratum_col).alias("stratum"), col(text_col).alias("text"))
    found = checkpoint(with_features(base, "text", ["doc_id", "stratum"], list(FEATURES)))
    cut = fit(found, labels.select("doc_id", "quality"), risk, delta).withColumnRenamed("stratum", "of")
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    ok = passes({f: F.col(f) for f in FEATURES}, {f: F.col(f) for f in GRID})
    judged = found.join(cut, F.col("stratum").eqNullSafe(F.col("of")), "left")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ok).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of docs that quality_report() keeps, with all their columns and no shuffle of texts.

    Nulls, empty texts, repeated rows, and tables without rows or labels are as there; columns of any
    name stay as they are. Labelled texts are read for the cutoffs, then each row is judged where it is."""
    base = docs.select(col(id_col).alias("doc_id"), col(stratum_col).alias("stratum"), col(text_col).alias("text"))
    labelled = _judged(labels).select("doc_id")
    few = labelled.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    known = with_features(base.join(F.broadcast(labelled), "doc_id", "left_semi") if few else base, "text", ["doc_id", "stratum"], list(FEATURES))
    cut = fit(known, labels.select("doc_id", "quality"), risk, delta)
    names = fresh(docs, *FEATURES, "of", *GRID)
    feature, of, cutoff = names[: len(FEATURES)], names[len(FEATURES)], names[len(FEATURES) + 1 :]
    cut = cut.toDF(of, *cutoff)
    rows = with_features(docs, text_col, docs.columns, feature).join(cut, col(stratum_col).eqNullSafe(F.col(of)), "left")
    f = {n: F.col(x) for n, x in zip(FEATURES, feature, strict=True)}
    ok = passes(f, {n: F.col(x) for n, x in zip(GRID, cutoff, strict=True)})
    return rows.where(~base_failed(f["n_words"], f["n_repeat_words"]) & ok).select(*[col(c) for c in docs.columns])
