"""Filters, projections and scopes of a table on a stream: the same plan building, on an unbounded DataFrame."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from marlspike.catalog import Catalog, Table
from marlspike.errors import QueryError
from marlspike.operators.paging import TableQuery
from marlspike.operators.select import Select


def read_stream(catalog: Catalog, table: Any, folder: str, **options: str) -> DataFrame:
    """New Parquet files of a folder as a stream of the table's rows."""
    t = catalog.freeze().table(table)
    return catalog.spark.readStream.schema(t.struct()).options(**options).parquet(folder)


def select_stream(catalog: Catalog, stream: DataFrame, alias: str, table: Table | None = None) -> Select:
    """A SELECT over a stream. Limits, offsets and orders have no meaning there and are refused when it is started."""
    q = _StreamSelect(catalog)
    q.from_(stream, alias)
    q.sources[alias].table = table
    return q


class _StreamSelect(Select):
    def to_df(self) -> DataFrame:
        if self.max is not None or (self.orders and not self.groups):
            raise QueryError("a stream has no limit and no order")
        return super().to_df()


def filter_stream(query: TableQuery, stream: DataFrame) -> DataFrame:
    """The rows of a stream that a table query lets pass, soft deletes included."""
    q = select_stream(query.catalog, stream, query.alias, query.table)
    conditions = query._conditions(None)
    return (q.where(conditions) if not conditions.is_empty() else q).to_df()
