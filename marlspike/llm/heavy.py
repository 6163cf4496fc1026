"""Frequent values of a column by Misra-Gries summaries, with exact counts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counters in each summary. Values with over 2 / COUNTERS of all rows count as heavy.
COUNTERS = 2048


def reduce_counters(counts: dict, k: int) -> dict:
    """The k counters that a Misra-Gries summary keeps: all less the (k+1)-th largest count."""
    if len(counts) <= k:
        return counts
    cut = sorted(counts.values(), reverse=True)[k]
    return {x: c - cut for x, c in counts.items() if c > cut}


def summaries(df: DataFrame, column: str, k: int = COUNTERS) -> DataFrame:
    """One Misra-Gries summary (item, counted) for each partition, at most k rows each.

    counted is at most the item's count in the partition, and less by at most rows / (k + 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            for pair in pc.value_counts(batch.column(0).drop_null()).to_pylist():
                counts[pair["values"]] = counts.get(pair["values"], 0) + pair["counts"]
            if len(counts) > 8 * k:
                counts = reduce_counters(counts, k)
        counts = reduce_counters(counts, k)
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), schema.field(0).type), pa.array(list(counts.values()), pa.int64())], names=["item", "counted"])

    kind = df.schema[column].dataType.simpleString()
    return df.select(column).mapInArrow(run, f"item {kind}, counted long")


def heavy_items(df: DataFrame, column: str, total: int, k: int = COUNTERS) -> tuple[DataFrame, float]:
    """Candidates for the values with at least `least` rows, and that bound, 2 / k of all rows.

    Merged summaries miss at most total / (k + 1) of a value's rows, so every such value is among
    the candidates, and there are at most k + 1 of them: the result may be broadcast."""
    least = max(2.0, 2 * total / k)
    bound = max(1.0, least - total / (k + 1))
    merged = summaries(df, column, k).groupBy("item").agg(F.sum("counted").alias("counted"))
    return merged.where(F.col("counted") >= bound).select("item"), least
