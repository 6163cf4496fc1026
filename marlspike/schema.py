"""The catalog of the driver's tables: keys, relations and column types."""

from __future__ import annotations

from pyspark.sql import SparkSession

from marlspike.catalog import Catalog
from marlspike.sources.store import ParquetFiles

_INT = {"type": "int"}
_ID = {"type": "bigint"}
_TEXT = {"type": "string"}
_REAL = {"type": "float"}

SCHEMA: dict = {
    "region": {
        "column_prefix": "r",
        "columns": {"regionkey": _INT, "name": _TEXT},
        "constraints": [{"type": "primary_key", "columns": ["regionkey"]}],
        "relations": {"nations": {"type": "one-to-many", "target": "nation"}},
    },
    "nation": {
        "column_prefix": "n",
        "columns": {"nationkey": _INT, "name": _TEXT, "regionkey": _INT},
        "constraints": [{"type": "primary_key", "columns": ["nationkey"]}, {"type": "foreign_key", "reference": "region", "columns": {"regionkey": "regionkey"}}],
        "relations": {
            "region": {"type": "many-to-one", "target": "region"},
            "customers": {"type": "one-to-many", "target": "customer"},
            "orders": {"type": "one-to-many", "target": "orders", "link": {"type": "join", "steps": [{"join": "customer"}]}},
        },
    },
    "customer": {
        "column_prefix": "c",
        "columns": {"custkey": _ID, "name": _TEXT, "nationkey": _INT, "acctbal": {"type": "float", "sensitive": True, "redacted": 0.0}, "mktsegment": _TEXT},
        "constraints": [{"type": "primary_key", "columns": ["custkey"]}, {"type": "foreign_key", "reference": "nation", "columns": {"nationkey": "nationkey"}}],
        "relations": {
            "orders": {"type": "one-to-many", "target": "orders"},
            "nation": {"type": "many-to-one", "target": "nation"},
            "urgent_orders": {"type": "one-to-many", "target": "orders", "link": {"type": "columns", "filters": ["orderpriority", "eq", "1-URGENT"]}},
        },
    },
    "supplier": {
        "column_prefix": "s",
        "columns": {"suppkey": _ID, "name": _TEXT, "nationkey": _INT, "acctbal": _REAL},
        "constraints": [{"type": "primary_key", "columns": ["suppkey"]}, {"type": "foreign_key", "reference": "nation", "columns": {"nationkey": "nationkey"}}],
    },
    "part": {
        "column_prefix": "p",
        "columns": {"partkey": _ID, "name": _TEXT, "brand": _TEXT, "type": _TEXT, "size": _INT, "retailprice": _REAL},
        "constraints": [{"type": "primary_key", "columns": ["partkey"]}],
    },
    "orders": {
        "column_prefix": "o",
        "columns": {"orderkey": _ID, "custkey": _ID, "orderstatus": {"type": "string", "one_of": ["F", "O", "P"]}, "totalprice": _REAL, "orderdate": {"type": "string"}, "orderpriority": _TEXT},
        "constraints": [{"type": "primary_key", "columns": ["orderkey"]}, {"type": "foreign_key", "reference": "customer", "columns": {"custkey": "custkey"}}],
        "relations": {
            "customer": {"type": "many-to-one", "target": "customer"},
            "lineitems": {"type": "one-to-many", "target": "lineitem"},
            "parts": {"type": "many-to-many", "target": "part", "link": {"type": "through", "pivot": "lineitem"}},
        },
    },
    "lineitem": {
        "column_prefix": "l",
        "columns": {"orderkey": _ID, "partkey": _ID, "suppkey": _ID, "linenumber": _INT, "quantity": _REAL, "extendedprice": _REAL, "discount": _REAL, "tax": _REAL, "returnflag": _TEXT, "linestatus": _TEXT, "shipdate": {"type": "string"}},
        "constraints": [
            {"type": "foreign_key", "reference": "orders", "columns": {"orderkey": "orderkey"}},
            {"type": "foreign_key", "reference": "part", "columns": {"partkey": "partkey"}},
            {"type": "foreign_key", "reference": "supplier", "columns": {"suppkey": "suppkey"}},
        ],
    },
    "events": {
        "columns": {"event_id": _ID, "ts": {"type": "string"}, "user_id": _ID, "event_type": _TEXT, "value": _REAL, "props": {"type": "json"}},
        "constraints": [{"type": "primary_key", "columns": ["event_id"]}],
    },
}


def catalog_of(spark: SparkSession, folder: str) -> Catalog:
    """The catalog over the Parquet files of a folder."""
    return Catalog(spark, ParquetFiles(spark, folder)).load(SCHEMA).freeze()
