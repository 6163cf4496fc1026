"""Helpers shared by the operators: checkpoints, names, text in Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: One run of the white space that separates words, as a Java and RE2 pattern.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text handed to a text function at once; a longer text goes alone.
CHUNK_BYTES = 2_000_000
#: Bytes of an Arrow batch on its way to Python. Spark bounds only the rows by default, whatever their length.
BATCH_BYTES = 8_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may get a temporary one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and sc.getCheckpointDir() is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="marlspike-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named or sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint: rows are computed once and survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def forget(*frames: DataFrame) -> None:
    """Delete the files of checkpoints that nothing reads any more. Frames must come from checkpoint().

    Spark deletes the shuffle files of plans that have become garbage, but only once the driver
    collects it, which may be long after: so this asks for it."""
    for df in frames:
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            delete_path(df.sparkSession, file.get())
    if frames:
        frames[0].sparkSession._jvm.System.gc()


def settled(table: DataFrame, *keys: str) -> DataFrame:
    """An aggregate by keys, dealt anew by a hash, before a join by the same keys.

    Spark splits the rows of a hot key only in joins whose two sides come straight from a shuffle of
    their own; an aggregate would else share the join's. Costs a shuffle of the aggregate's rows."""
    return table.repartition(F.xxhash64(*[col(k) for k in keys]))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted that no column of df has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def ordered(key: Column) -> Column:
    """A sort key with nulls last, for min() and for sorting."""
    return F.struct(key.isNull().alias("absent"), key.alias("key"))


def bound_batches(spark: SparkSession) -> None:
    """Have the session close Arrow batches at BATCH_BYTES, unless it has a smaller bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, str((1 << 31) - 2)).lower().rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def map_text(df: DataFrame, text: str, fields: list[T.StructField], make: Callable[[], Callable[[list[str | None]], list]], keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of df (all by default) and new ones that make() computes from whole texts.

    make() runs once in each task and returns a function from a list of texts to one sequence per
    new field. It gets a few MB of text at a time, so memory does not depend on the batch size."""
    bound_batches(df.sparkSession)
    keep = df.columns if keep is None else keep
    (source,) = fresh(df, "text_in")
    cols = [col(c) for c in keep]
    inner = df.select(*cols, col(text).alias(source)) if text not in keep else df.select(*cols)
    at = len(keep) if text not in keep else keep.index(text)
    n_keep = len(keep)
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    new = [to_arrow_schema(T.StructType([f])).field(0) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy()
            start = 0
            while start < batch.num_rows:
                end, n_bytes = start, 0
                while end < batch.num_rows and (end == start or n_bytes + lengths[end] <= CHUNK_BYTES):
                    n_bytes += int(lengths[end])
                    end += 1
                part = batch.slice(start, end - start)
                made = f(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(n_keep)] + [pa.array(v, t.type) for v, t in zip(made, new, strict=True)],
                    names=list(schema.names),
                )
                start = end

    return inner.mapInArrow(run, schema)
