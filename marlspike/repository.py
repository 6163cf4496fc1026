"""Controllers: create, read, update and delete with authorisation hooks, events and relations."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Row

from marlspike.catalog import Catalog, Table
from marlspike.errors import Forbidden, NotFound, QueryError
from marlspike.operators.dml import stored
from marlspike.operators.paging import Options, Results, TableQuery, redact

#: Actions that hooks judge, with their defaults, and events of single rows.
ACTIONS = {
    "create": True, "create_flush": True, "read": True, "read_all": True, "update": True, "update_flush": True, "update_all": True, "update_all_flush": True,
    "delete": True, "delete_flush": True, "delete_all": False, "delete_all_flush": True, "column_update": True,
    "pk_column_write": False, "private_column_write": False, "sensitive_column_write": False,
}
EVENTS = ("after_entity_read", "before_entity_update", "after_entity_update", "before_entity_deletion", "after_entity_deletion", "after_entity_creation")


class Hooks:
    """Listeners of one table. The first that returns True or False decides; on_<action>() subscribes."""

    def __init__(self) -> None:
        self.listeners: dict[str, list[Callable]] = {}

    def __getattr__(self, name: str) -> Callable[[Callable], Hooks]:
        topic = name.removeprefix("on_before_").removeprefix("on_") if name.startswith("on_") else ""
        if topic not in ACTIONS and topic not in EVENTS and f"before_{topic}" not in EVENTS:
            raise AttributeError(name)
        topic = topic if topic in ACTIONS or topic in EVENTS else f"before_{topic}"

        def subscribe(listener: Callable) -> Hooks:
            self.listeners.setdefault(topic, []).append(listener)
            return self

        return subscribe

    def ask(self, action: str, *context: Any) -> None:
        for listener in self.listeners.get(action, []):
            says = listener(*context)
            if says is False:
                raise Forbidden(f"{action} is denied")
            if says is True:
                return
        if not ACTIONS[action]:
            raise Forbidden(f"{action} is denied")

    def tell(self, event: str, *context: Any) -> None:
        for listener in self.listeners.get(event, []):
            if listener(*context) is False:
                return


class Entity:
    """One row by short column names, with the changes since it was read or saved."""

    def __init__(self, table: Table, values: dict[str, Any] | None = None, saved: bool = False):
        object.__setattr__(self, "_table", table)
        object.__setattr__(self, "_values", {})
        object.__setattr__(self, "_before", {})
        for k, v in (values or {}).items():
            c = table.find(k)
            if c is not None:
                self._values[c.name] = v
        if saved:
            self.mark_saved()

    def __getattr__(self, name: str) -> Any:
        c = self._table.find(name)
        if c is None:
            raise AttributeError(name)
        if c.name not in self._values:
            raise QueryError(f"column {name} was not read")
        return self._values[c.name]

    def __setattr__(self, name: str, value: Any) -> None:
        c = self._table.column(name)
        self._values[c.name] = stored(c, value)

    def hydrate(self, values: dict[str, Any]) -> Entity:
        for k, v in values.items():
            setattr(self, k, v)
        return self

    def is_partial(self) -> bool:
        return set(self._values) != set(self._table.columns)

    def mark_saved(self) -> None:
        self._before.clear()
        self._before.update({k: self._table.column(k).type.dirty_text(v) for k, v in self._values.items()})

    def dirty(self) -> dict[str, Any]:
        return {k: v for k, v in self._values.items() if self._before.get(k) != self._table.column(k).type.dirty_text(v)}

    def is_saved(self) -> bool:
        return bool(self._before) and not self.dirty()

    def identity_filters(self) -> list:
        """Filters for the key, by the values that the row was read with."""
        out: list = []
        for k in self._table.identity():
            out += [*(["and"] if out else []), k, "eq", self._values.get(k)]
        return out

    def identity_key(self) -> str:
        return ":".join(str(self._values[k]) for k in self._table.identity())

    def to_dict(self, hide_sensitive: bool = True) -> dict[str, Any]:
        out = {}
        for k, v in self._values.items():
            c = self._table.column(k)
            if not (hide_sensitive and c.private):
                out[k] = c.redacted if hide_sensitive and c.sensitive else v
        return out

    def save(self, controller: Controller) -> Entity:
        return controller.save(self)


class Controller:
    """The verbs on one table. Writes are units of work of the catalog's store."""

    def __init__(self, catalog: Catalog, table: Any, hooks: Hooks | None = None):
        catalog.freeze()
        self.catalog, self.table, self.hooks = catalog, catalog.table(table), hooks or Hooks()

    def query(self) -> TableQuery:
        return TableQuery(self.catalog, self.table)

    def _entity(self, row: Row | None) -> Entity | None:
        return None if row is None else Entity(self.table, row.asDict(), saved=True)

    def _judge_columns(self, values: dict[str, Any], update: bool) -> None:
        for k in values:
            c = self.table.column(k)
            if not update and c.type.get("auto_increment") and values[k] is not None:
                raise Forbidden(f"{c.name} is generated")
            if update and c.name in self.table.primary_key:
                self.hooks.ask("pk_column_write", c, values[k])
            if c.private:
                self.hooks.ask("private_column_write", c, values[k])
            if c.sensitive:
                self.hooks.ask("sensitive_column_write", c, values[k])
            if update:
                self.hooks.ask("column_update", c, values[k])

    def add_item(self, values: dict[str, Any]) -> Entity:
        with self.catalog.store.unit():
            self.hooks.ask("create", values)
            self._judge_columns(values, update=False)
            names = {self.table.column(k).name for k in values}
            if missing := [c for c in self.table.required() if c not in names]:
                raise QueryError(f"{self.table.name}: {missing} must be given")
            entity = Entity(self.table).hydrate(values)
            self.hooks.ask("create_flush", entity)
            row = self.query().insert(entity._values or {k: None for k in self.table.columns}).execute().first()
        made = self._entity(row)
        self.hooks.tell("after_entity_creation", made)
        return made

    def get_item(self, filters: Any = None, options: Options | None = None) -> Entity | None:
        q = self.query()
        self.hooks.ask("read", q)
        if filters:
            q.where(filters)
        found = self._entity(q.find(options).first())
        if found is not None:
            self.hooks.tell("after_entity_read", found)
        return found

    def get_all_items(self, options: Options | None = None) -> Results:
        q = self.query()
        self.hooks.ask("read_all", q)
        return q.find(options or Options())

    def get_all_items_custom(self, build: Callable[[TableQuery], Any], options: Options | None = None) -> Results:
        q = self.query()
        self.hooks.ask("read_all", q)
        build(q)
        return q.find(options or Options())

    def collection(self, name: str, options: Options | None = None) -> DataFrame:
        if name not in self.table.collections:
            raise QueryError(f"{self.table.name} has no collection {name!r}")
        self.hooks.ask("read_all", self.query())
        return self.table.collections[name](self.catalog, options or Options())

    def update_one_item(self, filters: Any, values: dict[str, Any]) -> Entity | None:
        """Read one row by the filters, change it, and write it by its key."""
        with self.catalog.store.unit():
            self.hooks.ask("update", filters, values)
            self._judge_columns(values, update=True)
            entity = self.get_item(filters)
            if entity is None:
                return None
            key = entity.identity_filters()
            self.hooks.tell("before_entity_update", entity)
            entity.hydrate(values)
            self.hooks.ask("update_flush", entity)
            changed = entity.dirty()
            if changed:
                self.query().where(key).update(changed).execute()
            entity.mark_saved()
        self.hooks.tell("after_entity_update", entity)
        return entity

    def update_all_items(self, filters: Any, values: dict[str, Any], options: Options | None = None) -> int:
        """The number of changed rows. There is no limit unless options name one."""
        with self.catalog.store.unit():
            q = self.query()
            self.hooks.ask("update_all", q, values)
            self._judge_columns(values, update=True)
            if filters:
                q.where(filters)
            self.hooks.ask("update_all_flush", q, values)
            return q.update(values, options).execute().count()

    def delete_one_item(self, filters: Any, soft: bool = False) -> Entity | None:
        with self.catalog.store.unit():
            self.hooks.ask("delete", filters)
            entity = self.get_item(filters)
            if entity is None:
                return None
            self.hooks.ask("delete_flush", entity)
            self.hooks.tell("before_entity_deletion", entity)
            q = self.query().where(entity.identity_filters())
            (q.soft_delete() if soft else q.delete(Options(max=1))).execute()
        self.hooks.tell("after_entity_deletion", entity)
        return entity

    def delete_all_items(self, filters: Any = None, soft: bool = False, options: Options | None = None) -> int:
        with self.catalog.store.unit():
            q = self.query()
            self.hooks.ask("delete_all", q)
            if filters:
                q.where(filters)
            self.hooks.ask("delete_all_flush", q)
            return (q.soft_delete(options) if soft else q.delete(options)).execute().count()

    def save(self, entity: Entity) -> Entity:
        if entity._before:
            changed = entity.dirty()
            if changed:
                self.query().where(entity.identity_filters()).update(changed).execute()
            entity.mark_saved()
            return entity
        row = self.query().insert(dict(entity._values)).execute().first()
        entity._values.update(Entity(self.table, row.asDict())._values)
        entity.mark_saved()
        return entity

    # relations

    def relation(self, name: str) -> Any:
        if name not in self.table.relations:
            raise QueryError(f"{self.table.name} has no relation {name!r}")
        return self.table.relations[name]

    def relatives(self, host: Entity, name: str) -> DataFrame:
        return self.relation(name).of(self.catalog, host._values)

    def relative(self, host: Entity, name: str) -> Entity | None:
        r = self.relation(name)
        row = r.of(self.catalog, host._values).first()
        return None if row is None else Entity(r.target, row.asDict(), saved=True)

    def relatives_batch(self, hosts: DataFrame, name: str, limit: int | None = None) -> DataFrame:
        return self.relation(name).batch_nested(self.catalog, hosts, limit=limit)

    def count_relatives(self, host: Entity, name: str) -> int:
        return self.relatives(host, name).count()

    def count_relatives_batch(self, hosts: DataFrame, name: str) -> DataFrame:
        return self.relation(name).count_batch(self.catalog, hosts)

    def create_relative(self, host: Entity, name: str, values: dict[str, Any], hooks: Hooks | None = None) -> Entity:
        r = self.relation(name)
        return Controller(self.catalog, r.target, hooks).add_item(r.fill(host._values, values))

    def update_relative(self, host: Entity, name: str, filters: Any, values: dict[str, Any], hooks: Hooks | None = None) -> Entity:
        return self._relative_verb(host, name, filters, lambda c, f: c.update_one_item(f, values), hooks)

    def delete_relative(self, host: Entity, name: str, filters: Any, hooks: Hooks | None = None) -> Entity:
        return self._relative_verb(host, name, filters, lambda c, f: c.delete_one_item(f), hooks)

    def _relative_verb(self, host: Entity, name: str, filters: Any, do: Callable, hooks: Hooks | None) -> Entity:
        r = self.relation(name)
        mine = r.fill(host._values, {})
        own: list = []
        for k, v in mine.items():
            own += [*(["and"] if own else []), k, "eq", v]
        done = do(Controller(self.catalog, r.target, hooks), [own, *(["and", filters] if filters else [])])
        if done is None:
            raise NotFound(f"{self.table.name} has no such {name}")
        return done

    def shown(self, df: DataFrame) -> DataFrame:
        """Rows as they may be shown: without private columns, sensitive ones redacted."""
        return redact(self.table, df)
