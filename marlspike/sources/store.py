"""Where rows are: Parquet files by table, versioned Parquet, DataFrames, and database servers."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from marlspike.catalog import Table
from marlspike.errors import QueryError


class Store:
    """Reads tables; stores that write keep what a unit of work has staged until it commits."""

    def __init__(self) -> None:
        self._levels: list[dict[str, tuple[Table, DataFrame]]] = []

    def load(self, table: Table) -> DataFrame:
        raise NotImplementedError

    def publish(self, table: Table, df: DataFrame) -> None:
        raise QueryError("this store is read-only")

    def read(self, table: Table) -> DataFrame:
        for level in reversed(self._levels):
            if table.full_name in level:
                return level[table.full_name][1]
        return self.load(table)

    def write(self, table: Table, df: DataFrame) -> None:
        if self._levels:
            self._levels[-1][table.full_name] = (table, df)
        else:
            self.publish(table, df)

    def begin(self) -> None:
        """Start a unit of work; inside of another one it is a savepoint."""
        self._levels.append({})

    def commit(self) -> None:
        """Publish what is staged, or hand it to the outer unit. Each table is replaced whole; there is no atomicity across tables."""
        if not self._levels:
            raise QueryError("no unit of work is open")
        done = self._levels.pop()
        if self._levels:
            self._levels[-1].update(done)
        else:
            for table, df in done.values():
                self.publish(table, df)

    def rollback(self) -> None:
        if not self._levels:
            raise QueryError("no unit of work is open")
        self._levels.pop()

    @contextmanager
    def unit(self) -> Iterator[Store]:
        self.begin()
        try:
            yield self
        except BaseException:
            self.rollback()
            raise
        self.commit()


class MemoryStore(Store):
    """Tables as DataFrames; those without any start empty."""

    def __init__(self, spark: SparkSession, frames: dict[str, DataFrame] | None = None):
        super().__init__()
        self.spark, self.frames = spark, dict(frames or {})

    def load(self, table: Table) -> DataFrame:
        df = self.frames.get(table.full_name, self.frames.get(table.name))
        return self.spark.createDataFrame([], table.struct()) if df is None else df

    def publish(self, table: Table, df: DataFrame) -> None:
        self.frames[table.full_name] = df


class ParquetFiles(Store):
    """Tables as `folder/name.parquet`, read-only. Filters and columns reach the scan."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__()
        self.spark, self.folder = spark, folder

    def load(self, table: Table) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table.name}.parquet")


class ParquetStore(Store):
    """Versioned tables: each write goes to a new folder, and the newest complete one is read.

    A path that is being read is never overwritten. The folder must be one that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__()
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str) -> tuple[Any, Any]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def versions(self, table: Table) -> list[int]:
        fs, p = self._fs(f"{self.folder}/{table.full_name}")
        if not fs.exists(p):
            return []
        found = []
        for s in fs.listStatus(p):
            name = s.getPath().getName()
            if name.startswith("v") and name[1:].isdigit() and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
                found.append(int(name[1:]))
        return sorted(found)

    def create(self, tables: list[Table]) -> None:
        """An empty first version of each table that has none: the schema, written down."""
        for t in tables:
            if not self.versions(t):
                self.publish(t, self.spark.createDataFrame([], t.struct()))

    def load(self, table: Table) -> DataFrame:
        seen = self.versions(table)
        if not seen:
            return self.spark.createDataFrame([], table.struct())
        return self.spark.read.parquet(f"{self.folder}/{table.full_name}/v{seen[-1]}")

    def publish(self, table: Table, df: DataFrame) -> None:
        """Write the rows as the next version; raise, and write nothing, if someone else has published one since df's was read.

        The version is claimed by a file that only one writer can make, before the folder gets its
        name: a folder that is there already is never renamed onto. A claim without its version is
        left by a writer that broke off, or is still at work; release() takes it back."""
        seen = (self.versions(table) or [0])[-1]
        fs, folder = self._fs(f"{self.folder}/{table.full_name}")
        read = {int(v) for f in df.inputFiles() for v in re.findall(rf"{re.escape(folder.toUri().getPath())}/v(\d+)/", unquote(f))}
        if read and read != {seen}:
            raise QueryError(f"{table.name} has changed: version {min(read)} was read, {seen} is the newest")
        _, staged = self._fs(f"{folder.toString()}/staged-{uuid.uuid4().hex}")
        writer = df.write
        for i in table.indexes:
            if i.kind == "btree":  # the nearest thing to an index: files sorted by its columns
                df = df.sortWithinPartitions(*table.full_names(i.columns))
                writer = df.write
                break
        writer.parquet(staged.toString())
        try:
            self._claim(fs, table, seen + 1)
            _, final = self._fs(f"{folder.toString()}/v{seen + 1}")
            if fs.exists(final) or not fs.rename(staged, final):
                raise QueryError(f"version {seen + 1} of {table.name} was written by someone else")
        except BaseException:
            fs.delete(staged, True)
            raise

    def _claim(self, fs: Any, table: Table, version: int) -> None:
        token, (_, claim) = uuid.uuid4().hex, self._fs(f"{self.folder}/{table.full_name}/v{version}.claim")
        try:
            out = fs.create(claim, False)
            out.writeBytes(token)
            out.close()
        except Py4JJavaError as e:
            raise QueryError(f"version {version} of {table.name} is being written by someone else") from e
        # where creating is not exclusive, the last writer's token is the one that is read
        got = fs.open(claim)
        try:
            if bytes(got.readNBytes(len(token))).decode() != token:
                raise QueryError(f"version {version} of {table.name} is being written by someone else")
        finally:
            got.close()

    def release(self, table: Table) -> None:
        """Take back the claim of a writer that broke off before its version was there."""
        fs, claim = self._fs(f"{self.folder}/{table.full_name}/v{(self.versions(table) or [0])[-1] + 1}.claim")
        fs.delete(claim, False)


class JdbcStore(Store):
    """Tables of a database server. The driver's jar must be on Spark's class path."""

    #: URL forms, default ports and driver classes.
    KINDS = {
        "mysql": ("jdbc:mysql://{host}:{port}/{name}", 3306, "com.mysql.cj.jdbc.Driver"),
        "postgresql": ("jdbc:postgresql://{host}:{port}/{name}", 5432, "org.postgresql.Driver"),
        "sqlite": ("jdbc:sqlite:{host}", None, "org.sqlite.JDBC"),
    }

    def __init__(self, spark: SparkSession, kind: str, host: str, name: str = "", port: int | None = None, user: str | None = None, password: str | None = None, **options: str):
        super().__init__()
        if kind not in self.KINDS:
            raise QueryError(f"unknown kind of server {kind!r}")
        url, default, driver = self.KINDS[kind]
        self.spark = spark
        self.options = {"url": url.format(host=host, port=port or default, name=name), "driver": driver, "pushDownPredicate": "true", **options}
        self.options |= {k: v for k, v in (("user", user), ("password", password)) if v is not None}

    def read_options(self, table: Table) -> dict[str, str]:
        out = {**self.options, "dbtable": table.full_name}
        key = table.primary_key
        if len(key) == 1 and "numPartitions" in out and "lowerBound" in out:
            out.setdefault("partitionColumn", table.column(key[0]).full_name)
        return out

    def load(self, table: Table) -> DataFrame:
        return self.spark.read.format("jdbc").options(**self.read_options(table)).load()

    def publish(self, table: Table, df: DataFrame) -> None:
        df.write.format("jdbc").options(**{**self.options, "dbtable": table.full_name, "truncate": "true"}).mode("overwrite").save()
