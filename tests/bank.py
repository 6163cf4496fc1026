"""Small tables in memory: clients, accounts, transactions; users, articles, tags, taggables; books."""

from marlspike.catalog import Catalog
from marlspike.sources.store import MemoryStore

COMMON = {"data": {"type": "map", "default": {}}, "created_at": {"type": "date", "auto": True}, "updated_at": {"type": "date", "auto": True}, "valid": {"type": "bool", "default": True}}
ID = {"type": "bigint", "unsigned": True, "auto_increment": True}
NAME = {"type": "string", "min": 1, "max": 60}

BANK = {
    "clients": {
        "column_prefix": "client",
        "columns": {"id": ID, "first_name": NAME, "last_name": NAME, "gender": {**NAME, "one_of": ["male", "female", "unknown"]}, "pin": {"type": "string", "nullable": True, "private": True}, "email": {"type": "string", "nullable": True, "sensitive": True, "redacted": "***"}, **COMMON},
        "constraints": [{"type": "primary_key", "columns": ["id"]}],
        "relations": {"accounts": {"type": "one-to-many", "target": "accounts"}, "transactions": {"type": "one-to-many", "target": "transactions", "link": {"type": "join", "steps": [{"join": "accounts"}]}}},
    },
    "accounts": {
        "column_prefix": "account",
        "columns": {"id": ID, "client_id": "ref:clients.id", "label": NAME, "balance": {"type": "decimal", "unsigned": True, "default": 0}, "currency_code": "ref:currencies.code", **COMMON},
        "constraints": [{"type": "primary_key", "columns": ["id"]}, {"type": "unique_key", "columns": ["client_id", "label"]}, {"type": "foreign_key", "reference": "clients", "columns": {"client_id": "id"}, "on_delete": "cascade"}, {"type": "foreign_key", "reference": "currencies", "columns": {"currency_code": "code"}, "on_delete": "restrict"}],
        "relations": {"client": {"type": "many-to-one", "target": "clients"}, "transactions": {"type": "one-to-many", "target": "transactions"}},
    },
    "transactions": {
        "column_prefix": "transaction",
        "columns": {"id": ID, "account_id": "ref:accounts.id", "reference": {"type": "string", "max": 128}, "state": {"type": "enum", "one_of": ["in_error", "confirmed", "refunded"]}, "amount": {"type": "decimal", "precision": 12, "scale": 2, "default": 0}, "date": {"type": "date", "format": "timestamp"}},
        "constraints": [{"type": "primary_key", "columns": ["id"]}, {"type": "unique_key", "columns": ["reference"]}, {"type": "foreign_key", "reference": "accounts", "columns": {"account_id": "id"}, "on_delete": "cascade"}],
        "relations": {"account": {"type": "many-to-one", "target": "accounts"}},
    },
    "currencies": {
        "column_prefix": "ccy",
        "columns": {"code": {"type": "string", "min": 1, "max": 30}, "name": NAME, "symbol": {"type": "string", "min": 1, "max": 6}},
        "constraints": [{"type": "primary_key", "columns": ["code"]}],
    },
}


def bank(spark):
    from marlspike.operators.dml import Insert

    c = Catalog(spark, MemoryStore(spark)).load(BANK).freeze()
    put = lambda t, rows: Insert(c, t).values(rows).execute()
    put("currencies", [{"code": "EUR", "name": "Euro", "symbol": "€"}, {"code": "USD", "name": "Dollar", "symbol": "$"}])
    put("clients", [{"first_name": f, "last_name": n, "gender": g, "data": d, "email": f"{f}@x"} for f, n, g, d in [("Ann", "A", "female", {"user": {"role": "admin", "level": 3}, "tag": "vip", "meta.key": "dotted"}), ("Bob", "B", "male", {"tag": None, "list": [1, 2, {"a": 1}]}), ("Cid", "C", "unknown", {})]])
    put("accounts", [{"client_id": 1, "label": "main", "balance": "10.5", "currency_code": "EUR"}, {"client_id": 1, "label": "save", "balance": 7, "currency_code": "USD"}, {"client_id": 2, "label": "main", "balance": 0, "currency_code": "EUR"}])
    put("transactions", [{"account_id": a, "reference": r, "state": s, "amount": m, "date": d} for a, r, s, m, d in [(1, "r1", "confirmed", "1.50", 100), (1, "r2", "refunded", 2, 200), (2, "r3", "confirmed", 3, 300), (3, "r4", "in_error", 4, 400)]])
    return c


def publishing(spark):
    c = Catalog(spark, MemoryStore(spark))
    c.table_builder("users", lambda t: t.id().string("name").soft_deletable().has_many("articles", "articles"))
    c.table_builder("tags", lambda t: t.id().string("label"))
    c.table_builder("taggables", lambda t: t.id().foreign("tag_id", "tags", "id").timestamps().morph("taggable").belongs_to("tag", "tags"))
    morph = {"type": "morph", "prefix": "taggable"}
    c.table_builder("articles", lambda t: t.id().string("title").foreign("user_id", "users", "id").soft_deletable().belongs_to("user", "users").belongs_to_many("tags", "tags", {"type": "through", "pivot": "taggables", "host_to_pivot": morph}).belongs_to_many("recent_tags", "tags", {"type": "through", "pivot": "taggables", "host_to_pivot": {**morph, "filters": [["created_at", "gt", "2020-01-01"]]}}))
    return c.freeze()
