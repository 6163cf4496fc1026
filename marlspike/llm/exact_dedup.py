"""Exact duplicates: frequent digests by Misra-Gries and broadcast, the rest by an ordinary shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlspike.llm.common import SPACES, checkpoint, col, fresh, ordered
from marlspike.llm.heavy import COUNTERS, heavy_items


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with each run of white space replaced by one space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "), 256))


def _heavy_winners(keyed: DataFrame, counters: int) -> DataFrame:
    """(item, winner, n) of the digests that hold over 2 / counters of all rows, counted exactly.

    keyed has `digest` and the order key `rank`. At most counters + 1 rows."""
    candidates, least = heavy_items(keyed, "digest", keyed.count(), counters)
    verified = (
        keyed.join(F.broadcast(candidates), F.col("digest") == F.col("item"))
        .groupBy("item")
        .agg(F.min("rank").alias("winner"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= least)
    )
    return checkpoint(verified)


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    Of equal texts the row with the smallest id stays. A null text equals an empty one. A null id
    comes after all others; keep_id is null only where a group has no id. Of repeated rows with the
    same id and text exactly one is kept. Other columns are ignored; no rows give no rows.

    Texts are read once: (id, digest) is checkpointed, and only that is shuffled."""
    keyed = checkpoint(
        docs.select(col(id_col).alias("doc_id"), text_digest(col(text_col)).alias("digest")).select(
            "doc_id", "digest", F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("row")).alias("rank")
        )
    )
    heavy = F.broadcast(_heavy_winners(keyed, counters))
    tagged = keyed.join(heavy, F.col("digest") == F.col("item"), "left")
    frequent = tagged.where(F.col("n").isNotNull()).select("doc_id", "digest", "rank", "winner", "n")
    group = Window.partitionBy("digest")
    rest = tagged.where(F.col("n").isNull()).select("doc_id", "digest", "rank", F.min("rank").over(group).alias("winner"), F.count(F.lit(1)).over(group).alias("n"))
    return frequent.unionByName(rest).select(
        "doc_id",
        F.col("winner.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("rank.row") == F.col("winner.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of docs without exact duplicates, with all their columns.

    Keeps the row that duplicate_groups() keeps. Rows of frequent digests other than the broadcast
    winners go before any shuffle; what is left is shuffled once by digest."""
    digest, order, best, item, winner = fresh(docs, "digest", "order", "best", "item", "winner")
    names = docs.columns
    ranked = docs.withColumn(digest, text_digest(col(text_col))).withColumn(order, ordered(col(id_col)))
    keyed = checkpoint(ranked.select(F.col(digest).alias("digest"), F.col(order).alias("rank")))
    heavy = F.broadcast(_heavy_winners(keyed, counters).select(F.col("item").alias(item), F.col("winner").alias(winner)))
    ranked = ranked.join(heavy, F.col(digest) == F.col(item), "left").where(F.col(winner).isNull() | F.col(order).eqNullSafe(F.col(winner)))
    # equal ids: the smaller hash of the raw text, so that reruns agree
    first = F.min_by(F.struct(*[col(c) for c in names]), F.struct(F.col(order), F.xxhash64(col(text_col))))
    return ranked.groupBy(digest).agg(first.alias(best)).select(*[F.col(best).getField(c).alias(c) for c in names])
