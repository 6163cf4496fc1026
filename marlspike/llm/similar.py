"""Near duplicates by an exact Jaccard similarity of word shingles: prefixes, equality joins, components.

Sets x and y reach a similarity t only if they share t / (1 + t) of the sum of their sizes. Sort all
sets by one order: at the first member that both have, neither may have fewer members left than
that. So only the first |x| - ceil(t|x|) + 1 members of a set are keys, and a pair counts at a key
only if enough is left after it in both: no pair is missed. The order has shingles that many
documents share last, by counts over all documents, so that a common passage gives keys only to
those that have little else. Pairs that meet pass an exact filter by parity bitmaps and are then
decided by the sets themselves, so none below t passes."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlspike.llm.common import bound_batches, checkpoint, col, forget, map_text, settled
from marlspike.llm.components import components

#: Words of a shingle, and the least similarity.
SHINGLE, SIMILARITY = 5, 0.8
#: Shingles are counted by the upper bits of their hashes: 8 bytes for each of so many counters go to every task.
COUNTERS = 1 << 20
#: Parts in which the counters are added up, and groups of tasks whose counters are added up first.
_SLICES, _TASK_GROUPS = 16, 1024
#: Bits of the bitmap of a small set; it doubles until it has one for each member.
LEAST_BITS = 512
#: A key with more sets than this is not joined pair by pair at first, but by rounds of links to centres.
WIDE = 48
CENTRES, ROUNDS = 4, 3
#: Rounds of centres end where the pairs in different components are at most so many times the rows of their keys.
FEW_PAIRS = 16
#: Up to so many sets that have to be compared whole (16 bytes each) are named to every task, which then moves no other text.
BROADCAST_SETS = 500_000
#: Words whose hashes a task keeps.
_MEMO_WORDS = 500_000
#: Odd multipliers for the places of a shingle's words, and for the last mixing.
_PLACES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
_MIX = 0xBF58476D1CE4E5B9


class _WordHashes(dict):
    """64-bit hashes of words, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class Shingles:
    """Sets of shingle hashes; keeps the hashes of words from text to text."""

    def __init__(self, shingle: int = SHINGLE):
        self.n, self.words = shingle, _WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted 64-bit hashes of the different shingles, A-Z lower-cased; a text of fewer words is one shingle, one without words has none."""
        tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not tokens:
            return np.zeros(0, np.uint64)
        if len(self.words) > _MEMO_WORDS:
            self.words.clear()
        w = np.fromiter(map(self.words.__getitem__, tokens), np.uint64, len(tokens))
        k = min(self.n, len(w))
        h = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            h *= np.uint64(_PLACES[i % len(_PLACES)])
            h += w[i : len(w) - k + 1 + i]
            h ^= h >> np.uint64(31)
        h *= np.uint64(_MIX)
        h ^= h >> np.uint64(29)
        return np.unique(h)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    return Shingles(shingle)(text)


def set_name(members: np.ndarray) -> int:
    """A signed 64-bit hash of a set: equal sets have equal names."""
    name = xxhash.xxh64_intdigest(members.tobytes())
    return name - (1 << 64) if name >> 63 else name


def buckets(members: np.ndarray, n_counters: int) -> np.ndarray:
    return (members >> np.uint64(65 - n_counters.bit_length())).astype(np.int64)


def prefix(members: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first members by (count, hash): a set shares one of them with any other of this similarity.

    counts, a power of two of them, has the number of each bucket's shingles. Any counts give all
    pairs: they only spare keys."""
    n = len(members)
    if not n:
        return members
    order = np.argsort(counts[buckets(members, len(counts))], kind="stable")
    return members[order[: n - math.ceil(similarity * n - 1e-9) + 1]]


def bitmap(members: np.ndarray) -> np.ndarray:
    """Bit i is 1 if an odd number of members are i modulo the bits: two bitmaps differ in no more bits than the sets in members."""
    bits = LEAST_BITS
    while bits < len(members):
        bits *= 2
    odd = np.bincount((members & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _set_maker(shingle: int):
    def make():
        of = Shingles(shingle)

        def run(texts: list[str | None]) -> list:
            sets = [of(t) for t in texts]
            return [[set_name(x) for x in sets], [x.view(np.int64) for x in sets]]

        return run

    return make


def _prefix_maker(counts, similarity: float, shingle: int):
    def make():
        known, of = counts.value, Shingles(shingle)

        def run(texts: list[str | None]) -> list:
            sets = [of(t) for t in texts]
            return [[set_name(x) for x in sets], [len(x) for x in sets], [prefix(x, known, similarity).view(np.int64) for x in sets], [bitmap(x) for x in sets]]

        return run

    return make


def shingle_counts(some: DataFrame, shingle: int, n_counters: int = COUNTERS) -> np.ndarray:
    """Numbers of the documents' shingles by bucket, over all documents: one array of n_counters.

    Each task adds up its own and gives it in _SLICES packed parts; these are added up in two
    rounds, so that no task unpacks more than a group's parts, one after the other."""
    bound_batches(some.sparkSession)
    schema, width = "slice int, tasks int, counts binary", n_counters // _SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total, waiting, n = Shingles(shingle), np.zeros(n_counters, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0):
                x = of(text.as_py())
                waiting.append(x)
                n += len(x)
                if n > n_counters:
                    total += np.bincount(buckets(np.concatenate(waiting), n_counters), minlength=n_counters)
                    waiting, n = [], 0
        if waiting:
            total += np.bincount(buckets(np.concatenate(waiting), n_counters), minlength=n_counters)
        if total.any():
            group = TaskContext.get().partitionId() % _TASK_GROUPS
            packed = [zlib.compress(part.tobytes(), 1) for part in total.reshape(_SLICES, width)]
            yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array([group] * _SLICES, pa.int32()), pa.array(packed, pa.binary())], names=["slice", "tasks", "counts"])

    def add(parts: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for x in parts.column("counts"):
            total += np.frombuffer(zlib.decompress(x.as_buffer()), np.int64)
        return pa.table([pa.array([parts.column("slice")[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["slice", "tasks", "counts"])

    rows = some.select("text").mapInArrow(count, schema)
    for keys in (["slice", "tasks"], ["slice"]):
        rows = rows.groupBy(*keys).applyInArrow(add, schema)
    out = np.zeros((_SLICES, width), np.int64)
    for r in rows.collect():
        out[r["slice"]] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return out.ravel()


def _needed(a: Column, b: Column, similarity: float) -> Column:
    """How many members sets of these sizes share at least if they reach the similarity."""
    return similarity / (1 + similarity) * (a + b) - 1e-9


def _pairs(x: DataFrame, y: DataFrame, similarity: float, also: Column) -> DataFrame:
    """(a, b) with a < b of the rows of x and y (key; node, size and left with x or y in front) that share a key with enough left after it."""
    met = x.join(y, "key").where(also & (F.col("xnode") != F.col("ynode")) & (F.least("xleft", "yleft") >= _needed(F.col("xsize"), F.col("ysize"), similarity)))
    return met.select(F.least("xnode", "ynode").alias("a"), F.greatest("xnode", "ynode").alias("b"))


def _named(rows: DataFrame, letter: str, *more: str) -> DataFrame:
    return rows.select("key", *[F.col(c).alias(letter + c) for c in ("node", "size", "left", *more)])


def _bits_differ(a: Column, b: Column) -> Column:
    """In how many bits two bitmaps differ, the longer one folded to the length of the other."""

    def folded(x: Column, n: Column) -> Column:
        return F.when(F.size(x) > n, F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, n + 1, n), lambda p, q: p.bitwiseXOR(q))).otherwise(x)

    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(folded(a, n), folded(b, n), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, v: acc + v)


def _verified(pairs: DataFrame, nodes: DataFrame, some: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs (a, b) whose whole sets have the similarity. Only texts of sets in a pair that the bitmaps leave are read again."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("size").alias(f"{x}size"), F.col("bits").alias(f"{x}bits"))
    near = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
    # with as few shared members as needed, sets differ in all others
    most = F.col("asize") + F.col("bsize") - 2 * _needed(F.col("asize"), F.col("bsize"), similarity)
    # sizes of similar sets differ by less than a half, so one folding is enough
    left = checkpoint(near.where((F.least("asize", "bsize") >= similarity * F.greatest("asize", "bsize") - 1e-9) & (_bits_differ(F.col("abits"), F.col("bbits")) <= most)).select("a", "b"))
    n = left.count()
    if not n:
        return left
    need = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = nodes.join(need, "node").select("node", F.col("first_id").alias("doc_id"))
    fields = [T.StructField("name", T.LongType()), T.StructField("members", T.ArrayType(T.LongType()))]
    # an id may have several texts
    sets = map_text(some.join(F.broadcast(wanted) if 2 * n <= BROADCAST_SETS else wanted, "doc_id"), "text", fields, _set_maker(shingle), ["node"]).where("node = name")
    sets = checkpoint(sets.dropDuplicates(["node"]).select("node", "members"))
    both = left.join(sets.select(F.col("node").alias("a"), F.col("members").alias("ma")), "a").join(sets.select(F.col("node").alias("b"), F.col("members").alias("mb")), "b")
    reach = F.size(F.array_intersect("ma", "mb")) >= _needed(F.size("ma"), F.size("mb"), similarity)
    out = checkpoint(both.where(reach).select("a", "b"))
    forget(left, sets)
    return out


def _centres(rows: DataFrame, turn: int) -> DataFrame:
    """Up to CENTRES rows of each key, others in each turn; keys that share sets mostly share centres.

    At first those with the most members left: a set with few members rarer than a crowd's own is the
    likeliest to be what the crowd are copies of."""
    seat = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(CENTRES))
    place = F.xxhash64("node", F.lit(-1 - turn))
    best = rows.groupBy("key", seat.alias("seat")).agg(F.min_by(F.struct("node", "size", "left", "part"), F.struct(F.col("at"), place) if turn == 0 else place).alias("c"))
    return checkpoint(best.select("key", "c.*"))


def similar_parts(nodes: DataFrame, some: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(node, part): components of the similar sets of nodes (node, first_id, size, prefix, bits); sets similar to none are left out.

    Keys with up to WIDE sets give all their pairs. In wider ones, where near copies crowd, each set
    is first compared with a few centres of its key; sets that links join, by whatever key, need no
    link of their own. Once keys have few pairs in different components, or a round of centres found
    no link, or after ROUNDS of them, all such pairs are compared. So no link is lost, and work grows with the square of a
    key's sets only as far as these are unlike, though they share rare shingles and have enough
    left after those."""
    rows = nodes.select("node", "size", F.posexplode("prefix").alias("at", "key")).select("key", "node", "size", (F.col("size") - F.col("at")).alias("left"), "at")
    # most keys have one set: only the others are kept
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = checkpoint(rows.join(settled(sizes, "key"), "key"))
    narrow, open_ = shared.where(F.col("n") <= WIDE), shared.where(F.col("n") > WIDE).select("key", "node", "size", "left", "at", F.col("node").alias("part"))
    pairs = _pairs(_named(narrow, "x"), _named(narrow, "y"), similarity, F.col("xnode") < F.col("ynode"))
    unlike = F.col("xpart") != F.col("ypart")
    if any_wide := bool(open_.limit(1).count()):
        pairs = pairs.unionByName(_pairs(_named(_centres(open_, 0), "x", "part"), _named(open_, "y", "part"), similarity, unlike))
    found = _verified(pairs, nodes, some, similarity, shingle)
    parts, spent = checkpoint(components(found).withColumnRenamed("component", "part")), [shared]
    stalled = False
    for turn in range(1, ROUNDS + 1) if any_wide else ():
        placed = checkpoint(open_.drop("part").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node")))
        each = placed.groupBy("key", "part").agg(F.count(F.lit(1)).cast("double").alias("n"))
        of_key = each.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), ((F.sum("n") ** 2 - F.sum(F.col("n") ** 2)) / 2).alias("pairs"))
        apart = checkpoint(of_key.where("parts > 1").select("key", "n", "pairs"))
        n, left = apart.agg(F.sum("n"), F.sum("pairs")).first()
        open_ = checkpoint(placed.join(apart.select("key"), "key"))
        forget(placed, apart, *spent)
        spent = [open_]
        if not n:
            break
        last = turn == ROUNDS or stalled or left <= FEW_PAIRS * n
        pairs = _pairs(_named(open_ if last else _centres(open_, turn), "x", "part"), _named(open_, "y", "part"), similarity, F.col("xpart") < F.col("ypart") if last else unlike)
        new = _verified(pairs, nodes, some, similarity, shingle)
        if not (stalled := not new.limit(1).count()):
            found = found.unionByName(new)
            forget(parts)
            parts = checkpoint(components(found).withColumnRenamed("component", "part"))
        if last:
            break
    forget(*spent)
    return parts


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and component_id, the smallest id of similar documents, for every row with an id and a word.

    Documents are similar if their sets of shingles have at least this Jaccard similarity; chains of
    similar ones are one component. Equal sets count as one, so copies never form pairs. Null ids
    and texts without words are left out: nothing is known to be similar to them. Repeated rows come
    out as often; an id with several texts has a row for each. Whole texts count, however long. No
    rows give no rows. Other columns, whatever their names, are ignored."""
    some = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(some, shingle))
    fields = [T.StructField("node", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("bits", T.ArrayType(T.LongType()))]
    marked = checkpoint(map_text(some, "text", fields, _prefix_maker(counts, similarity, shingle), ["doc_id"]))
    nodes = checkpoint(marked.groupBy("node").agg(F.min("doc_id").alias("first_id"), *[F.first(c).alias(c) for c in ("size", "prefix", "bits")]))
    parts = similar_parts(nodes, some, similarity, shingle)
    alike = nodes.select("node", "first_id").join(parts, "node")
    least = alike.groupBy("part").agg(F.min("first_id").alias("component_id"))
    named = checkpoint(alike.join(settled(least, "part"), "part").select("node", "component_id"))
    # sets that are like no other stand for themselves
    alone = nodes.join(named, "node", "left_anti").select("node", F.col("first_id").alias("component_id"))
    every = checkpoint(named.unionByName(alone))
    out = checkpoint(marked.select("doc_id", "node").join(every, "node").select("doc_id", "component_id"))
    forget(marked, nodes, named, every)
    return out
