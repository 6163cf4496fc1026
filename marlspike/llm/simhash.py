"""Near duplicates by SimHash: deletion-variant signatures, equality joins, connected components."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlspike.llm.common import checkpoint, col, forget, fresh, map_text, settled
from marlspike.llm.components import components

#: Words of a shingle, and the seed of its hash.
SHINGLE, SEED = 3, 42
#: Bits in which linked fingerprints may differ. Two segments: one of them differs in one bit at most.
MAX_BITS, SEGMENT = 3, 32
#: A bucket with more fingerprints than this is not joined pair by pair.
WIDE = 48
_HASHES = 1 << 16


def fingerprint(text: str | None) -> int:
    """64 bits; a bit is 1 if over half the shingles' hashes have it. No words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(line, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - SHINGLE].tolist()
    ends = ends[SHINGLE - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), _HASHES):
        part = np.array([h(line[a:b], SEED) for a, b in zip(starts[at : at + _HASHES], ends[at : at + _HASHES])], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = ones * 2 > len(starts)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _make_fingerprints():
    def run(texts: list[str | None]) -> list:
        # as signed longs
        return [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)]

    return run


def fingerprints(docs: DataFrame, text_col: str, keep: list[str], name: str) -> DataFrame:
    """The columns `keep` of docs and each whole text's fingerprint, a signed long."""
    return map_text(docs, text_col, [T.StructField(name, T.LongType())], _make_fingerprints, keep)


def _segment(fp: Column, upper: bool) -> Column:
    return F.shiftrightunsigned(fp, SEGMENT) if upper else fp.bitwiseAND(F.lit((1 << SEGMENT) - 1))


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _flips(width: int) -> Column:
    """0 and every single bit of a segment."""
    return F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(width)])


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): a key for each segment as it is and with each one of its bits deleted.

    Fingerprints that differ by MAX_BITS or less have a segment that differs by one bit or none,
    so they share a key: the whole segment's, or that with the differing bit deleted."""
    keys = []
    for upper in (0, 1):
        part = _segment(F.col("fp"), bool(upper))
        # bits 0-31: the segment; 32-37: the deleted bit, 32 for none; 38: which segment
        keys.append(part.bitwiseOR(F.lit((upper << 38) | (SEGMENT << 32)).cast("long")))
        for i in range(SEGMENT):
            keys.append(part.bitwiseAND(F.lit(~(1 << i) & ((1 << SEGMENT) - 1)).cast("long")).bitwiseOR(F.lit((upper << 38) | (i << 32)).cast("long")))
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def links(fps: DataFrame) -> DataFrame:
    """(a, b): verified links between the distinct fingerprints of fps that leave no linked ones apart.

    Buckets of the equality join with up to WIDE fingerprints give all their close pairs. In wider
    buckets, where near copies crowd together, no pairs are made: see _wide_links()."""
    shared = variants(fps)
    # most keys have one fingerprint: only the others are kept
    sizes = shared.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = checkpoint(shared.join(settled(sizes, "key"), "key"))
    narrow = rows.where(F.col("n") <= WIDE)
    a, b = narrow.select("key", F.col("fp").alias("a")), narrow.select("key", F.col("fp").alias("b"))
    close = a.join(b, ["key"]).where((F.col("a") < F.col("b")) & (_distance(F.col("a"), F.col("b")) <= MAX_BITS)).select("a", "b")
    out = checkpoint(close.unionByName(_wide_links(rows.where(F.col("n") > WIDE).select("key", "fp"))).distinct())
    forget(rows)
    return out


def _wide_links(rows: DataFrame) -> DataFrame:
    """Links that join all fingerprints of a wide bucket which a chain of close ones joins, without its pairs.

    Fingerprints of a bucket differ in one bit of its segment at most, and agree there if no bit is
    deleted. So much for the other segment: with a deleted bit, two that share a point one flip away
    from either there differ by 1 + 2 bits at most, and close ones share such a point. With none,
    close ones share a point one flip from one and two from the other; all that reach a point at one
    flip or two are then close to any that reaches it at one. Each point links its rows to one."""
    upper = F.shiftrightunsigned("key", 38) == 1
    rest = F.when(upper, _segment(F.col("fp"), False)).otherwise(_segment(F.col("fp"), True))
    whole = F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(63)) == SEGMENT
    one = F.transform(_flips(SEGMENT), lambda f: F.struct(f.alias("flip"), F.lit(1).alias("far")))
    two = F.array(*[F.lit((1 << i) | (1 << j)).cast("long") for i in range(SEGMENT) for j in range(i)])
    both = F.concat(one, F.transform(two, lambda f: F.struct(f.alias("flip"), F.lit(2).alias("far"))))
    points = rows.withColumn("rest", rest).select("key", "fp", "rest", F.explode(F.when(whole, both).otherwise(one)).alias("p"))
    points = points.select("key", "fp", F.col("rest").bitwiseXOR(F.col("p.flip")).alias("point"), F.col("p.far").alias("far"))
    center = points.where("far = 1").groupBy("key", "point").agg(F.min("fp").alias("center"))
    near = points.join(settled(center, "key", "point"), ["key", "point"]).where(F.col("fp") != F.col("center"))
    near = near.where(_distance(F.col("fp"), F.col("center")) <= MAX_BITS)
    return near.select(F.least("fp", "center").alias("a"), F.greatest("fp", "center").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id for every row of docs.

    Documents link if their fingerprints differ by 3 bits or less; component_id is the smallest id
    that links reach. Texts without words, null ones too, have fingerprint 0 and link like any
    other. A null id is never the smallest: component_id is null only if a component has no id.
    Repeated rows come out as often. No rows give no rows. Other columns are ignored.

    Texts are read once. Equal fingerprints count as one from then on."""
    marked = checkpoint(fingerprints(docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")), "text", ["doc_id"], "fp"))
    return assign(marked).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def assign(marked: DataFrame) -> DataFrame:
    """The rows of marked (doc_id, fp) with part, a fingerprint that stands for the component, and component_id."""
    classes = checkpoint(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    parts = components(links(classes.select("fp")))
    named = classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("part", F.coalesce("component", "fp"))
    first = named.groupBy("part").agg(F.min("first_id").alias("component_id"))
    by_fp = named.select("fp", "part").join(settled(first, "part"), "part").select("fp", "part", "component_id")
    return marked.join(by_fp, "fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: DataFrame | None = None) -> DataFrame:
    """The rows of docs without near duplicates: of each component, the document with its smallest id.

    groups (doc_id, component_id), like those of similar.similar_groups(), are further components:
    those of both kinds that share a document are one.

    An id stands for one document: rows that repeat it count as copies, of which one stays, that
    with the smallest hash of its text. Rows without an id stay only if their component has none."""
    gone_id, same, best, fp, its_fp, part = fresh(docs, "gone_id", "same", "best", "fp", "its_fp", "part")
    marked = checkpoint(fingerprints(docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")), "text", ["doc_id"], "fp"))
    rows = assign(marked)
    ids = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    odd = checkpoint(ids.where((F.col("doc_id") != F.col("component_id")) | (F.col("n") > 1)))
    dropped = odd.where("doc_id <> component_id").select(F.col("doc_id").alias(gone_id))
    if groups is not None:
        both = rows.select("doc_id", "component_id").unionByName(groups.select("doc_id", "component_id"))
        both = both.where("component_id < doc_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")).distinct()
        dropped = components(both).where("node <> component").select(F.col("node").alias(gone_id))
    names = docs.columns

    def one_each(df: DataFrame, key: str) -> DataFrame:
        first = df.groupBy(F.col(key)).agg(F.min_by(F.struct(*[col(c) for c in names]), F.xxhash64(col(text_col))).alias(best))
        return first.select(*[F.col(best).getField(c).alias(c) for c in names])

    kept = docs.where(col(id_col).isNotNull()).join(dropped, col(id_col) == F.col(gone_id), "left_anti")
    if odd.where("n > 1").limit(1).count():
        kept = one_each(kept.withColumn(same, col(id_col)), same)
    if marked.where("doc_id IS NULL").limit(1).count():
        lonely = checkpoint(rows.where("component_id IS NULL").select(F.col("fp").alias(its_fp), F.col("part").alias(part)).distinct())
        unnamed = fingerprints(docs.where(col(id_col).isNull()), text_col, names, fp)
        kept = kept.unionByName(one_each(unnamed.join(lonely, F.col(fp) == F.col(its_fp)), part))
    return kept
