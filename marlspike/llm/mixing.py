"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlspike.llm.common import WORD, checkpoint, col, fresh

#: Weights of the sources in order of code points, null last, over and over.
WEIGHTS = (3, 1, 2)
#: The mix takes this part of all words, and no document more often than MOST times.
SHARE, MOST = 1.5, 2
#: Hexadecimal digits of a document's place in the shuffled order that name its slice: 16 ** 3 slices of a source.
SLICE_DIGITS = 3
#: Slices of the finish times past 1, for the end of the budget.
TAIL_SLICES = 1 << 20


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target: words of each source and those that the mix should take of it.

    Sources share the budget by weight; one whose part would exceed `most` times its size gets just
    that, and the others share the excess by weight: target = min(most * size, level * weight). With
    the sources in order of most * size / weight, each gives a level if all before it get their
    most; that level rises as long as sources are filled and falls after, so the highest is the one.
    Works on one row for each source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    weighed = per.select("source", "source_size", pattern[(F.row_number().over(by_name) - 1) % len(weights)].alias("w"), F.row_number().over(by_name).alias("i"))
    filled = everything.orderBy((most * F.col("source_size") / F.col("w")).asc(), F.col("i"))
    before, after = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing)
    leveled = weighed.select(
        "source",
        "source_size",
        "w",
        (most * F.col("source_size")).cast("double").alias("cap"),
        ((share * F.sum("source_size").over(everything) - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0))) / F.sum("w").over(after)).alias("fair"),
    )
    level = F.max("fair").over(everything)
    return leveled.select("source", "source_size", F.least(F.col("cap"), level * F.col("w")).alias("target"))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, source, size and the shuffled place of each document, checkpointed."""
    place = F.md5(F.coalesce(col(id_col).cast("string"), F.lit("")).cast("binary"))
    more = [c.alias(k) for k, c in (extra or {}).items()]
    return checkpoint(docs.select(col(id_col).alias("doc_id"), col(source_col).alias("source"), n_words(col(text_col)).alias("size"), place.alias("place"), *more))


def mix(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The rows of sizes (doc_id, source, size, place, ...) with source_size, target, finish and taken.

    A source's documents queue in order of place, round after round. A copy's virtual finish time is
    the words of its source up to its end, divided by the source's target. All copies are taken in
    order of finish time while their words fit in the budget, share * all words.

    The running sums need no task that sees a whole source: places are cut into 4,096 slices, each
    (source, slice) is summed in a task, and slices start at the running sum of the slice totals.
    Finish times up to 1 always fit, as each source then has at most its target; the rest of the
    budget goes to the copies that finish next, found by slices of time."""
    stats = targets(sizes, weights, share, most)
    cut = sizes.withColumn("slice", F.substring("place", 1, SLICE_DIGITS))
    slices = cut.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select(F.col("source").alias("source_"), F.col("slice").alias("slice_"), F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)).alias("start"))
    starts = starts.join(stats.withColumnRenamed("source", "of"), F.col("source_").eqNullSafe(F.col("of"))).drop("of")
    inside = Window.partitionBy("source", "slice").orderBy("place", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = (
        cut.withColumn("inside", F.sum("size").over(inside))
        .join(starts, F.col("source").eqNullSafe(F.col("source_")) & (F.col("slice") == F.col("slice_")))
        .withColumn("until", F.col("start") + F.col("inside"))
        .drop("source_", "slice_", "slice", "inside", "start")
    )
    queued = checkpoint(queued)
    copies = [(F.col("until") + r * F.col("source_size")) for r in range(most)]
    in_time = sum((F.when(c <= F.col("target"), F.lit(1)).otherwise(F.lit(0)) for c in copies), F.lit(0))
    left = queued.agg((share * F.sum("size") - F.sum(in_time * F.col("size"))).alias("left")).first()["left"]
    queued = queued.withColumn("finish", F.array(*[F.when(F.col("target") > 0, c / F.col("target")) for c in copies]))
    last = _last_finish(queued, left) if left else None
    if last is None:
        more = F.lit(0)
    else:
        key = F.struct(*[F.lit(last[k]).cast(t).alias(k) for k, t in (("finish", "double"), ("source_key", "string"), ("place", "string"), ("doc_id", dict(queued.dtypes)["doc_id"]))])
        more = F.size(F.filter("finish", lambda f: (f > 1) & (F.struct(f.alias("finish"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source_key"), F.col("place").alias("place"), F.col("doc_id").alias("doc_id")) <= key)))
    return queued.withColumn("n_copies", in_time + more).withColumn("taken", F.col("size") * F.col("n_copies")).drop("until")


def _last_finish(queued: DataFrame, left: float) -> dict | None:
    """The last copy that the budget still has room for after all that finish by time 1, if any.

    left is less than the sources' next documents together, so few time slices matter: the first of
    them are summed and only the one in which the budget ends is sorted."""
    tail = queued.select(F.explode("finish").alias("finish"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source_key"), "place", "doc_id", "size").where("finish > 1 AND size > 0")
    tail = tail.withColumn("at", F.floor((F.col("finish") - 1) * TAIL_SLICES))
    times = Window.partitionBy(F.lit(0)).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    words = checkpoint(tail.groupBy("at").agg(F.sum("size").alias("words")))
    n, first = words.count(), 1024
    while True:  # more slices until they hold more words than are left, or all of them do not
        spent = words.orderBy("at").limit(first).select("at", F.sum("words").over(times).alias("total"))
        full = spent.where(F.col("total") <= left).agg(F.max("at").alias("at"), F.max("total").alias("total")).first()
        ends = spent.where(F.col("total") > left).agg(F.min("at").alias("at")).first()["at"]
        if ends is not None or first >= n:
            break
        first *= 8
    start = full["at"] if full["at"] is not None else -1
    order = ["finish", "source_key", "place", "doc_id"]
    chosen = None
    if ends is not None:
        run = Window.partitionBy("at").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        part = tail.where(F.col("at") == ends).withColumn("total", F.sum("size").over(run)).where(F.col("total") <= left - (full["total"] or 0))
        chosen = part.orderBy(*[F.desc(c) for c in order]).first()
    if chosen is None and start >= 0:
        chosen = tail.where(F.col("at") == start).orderBy(*[F.desc(c) for c in order]).first()
    return chosen.asDict() if chosen else None


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs.

    Null texts have no words and are never taken; documents without a source are one source, the
    last in order; of repeated rows each counts. No rows give no rows. Other columns are ignored."""
    return mix(sized(docs, id_col, text_col, source_col)).select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, in all its columns; never or up to MOST times.

    Documents without words take none of the budget and stay once. Rows that share an id, source and text are told apart by
    nothing, so their copies are counted together."""
    key, copies, rows, its_id, its_key, whole = fresh(docs, "key", "copies", "rows", "its_id", "its_key", "whole")
    key_of = F.xxhash64(col(id_col), col(source_col), col(text_col))
    mixed = mix(sized(docs, id_col, text_col, source_col, {"key": key_of}))
    n = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("n_copies"))
    picks = checkpoint(mixed.groupBy("doc_id", "key").agg(F.sum(n).alias(copies), F.count(F.lit(1)).alias(rows)).where(F.col(copies) > 0).withColumnRenamed("doc_id", its_id).withColumnRenamed("key", its_key))
    names = docs.columns
    keyed = docs.withColumn(key, key_of)

    def taken(rows_in: DataFrame, which: Column) -> DataFrame:
        return rows_in.join(picks.where(which), col(id_col).eqNullSafe(F.col(its_id)) & (F.col(key) == F.col(its_key)))

    def repeat(df: DataFrame) -> DataFrame:
        return df.withColumn(key, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*[col(c) for c in names])

    out = repeat(taken(keyed, F.col(rows) == 1))
    if picks.where(F.col(rows) > 1).limit(1).count():
        again = taken(keyed, F.col(rows) > 1).groupBy(its_id, its_key).agg(F.first(F.struct(*[col(c) for c in names])).alias(whole), F.first(copies).alias(copies))
        out = out.unionByName(again.withColumn(key, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*[F.col(whole).getField(c).alias(c) for c in names]))
    return out
