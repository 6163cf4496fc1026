"""Relations between tables: links compile to chains of joins, for one host row or for many at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlspike.catalog import Catalog, Table
from marlspike.errors import QueryError, SchemaError
from marlspike.plans.fields import Field
from marlspike.plans.filters import Filters, Resolved

#: Kinds of relations and links.
KINDS = ("one-to-one", "one-to-many", "many-to-one", "many-to-many")
LINKS = ("columns", "morph", "through", "join")
#: Output column with the host's key.
HOST_KEY = "_computed_host_key"
#: Of greater(): targets in a run, and parts that the hosts of a run are dealt to.
RUN, PARTS = 2048, 4


@dataclass
class Step:
    """A join to a table: pairs of columns (of the table before, of this one), values that columns of either must have, filters."""

    table: Table
    pairs: list[tuple[str, str]]
    here: dict[str, Any] = field(default_factory=dict)
    before: dict[str, Any] = field(default_factory=dict)
    filters: Any = None


def _auto_columns(host: Table, target: Table) -> dict[str, str]:
    for f in target.foreign_to(host):
        return {theirs: own for own, theirs in f.columns.items()}
    for f in host.foreign_to(target):
        return dict(f.columns)
    raise SchemaError(f"no foreign key links {host.name} and {target.name}")


def steps_of(host: Table, target: Table, link: dict | None, depth: int = 0) -> list[Step]:
    """The joins that lead from host to target."""
    link = dict(link or {"type": "columns"})
    kind = link.get("type", "columns")
    if kind not in LINKS:
        raise SchemaError(f"unknown kind of link {kind!r}")
    if depth and kind in ("through", "join"):
        raise SchemaError(f"a {kind} link cannot be part of another link")
    catalog: Catalog = host.catalog
    if kind == "columns":
        columns = link.get("columns") or _auto_columns(host, target)
        return [Step(target, [(host.column(a).name, target.column(b).name) for a, b in columns.items()], filters=link.get("filters"))]
    if kind == "morph":
        return [_morph(host, target, link)]
    if kind == "through":
        pivot = catalog.table(link.get("pivot") or link.get("pivot_table"))
        first = steps_of(host, pivot, link.get("host_to_pivot") or _inner(link), depth + 1)
        last = steps_of(pivot, target, link.get("pivot_to_target"), depth + 1)
        last[-1].filters = _both(last[-1].filters, link.get("filters"))
        return first + last
    out, at = [], host
    for s in link.get("steps", []):
        to = catalog.table(s["join"])
        out += steps_of(at, to, s.get("link"), depth + 1)
        at = to
    if at is not target:
        out += steps_of(at, target, None, depth + 1)
    if not out:
        raise SchemaError("a join link needs steps")
    out[-1].filters = _both(out[-1].filters, link.get("filters"))
    return out


def _inner(link: dict) -> dict | None:
    """Options of the first part of a through link that stand beside its own, as in {'type': 'through', 'pivot': ..., 'link': {...}}."""
    return link.get("link")


def _both(a: Any, b: Any) -> Any:
    return b if a is None else a if b is None else [a, "and", b]


def _morph(host: Table, target: Table, link: dict) -> Step:
    prefix = link.get("prefix")

    def child_columns(child: Table) -> tuple[str, str]:
        return link.get("child_key_column") or f"{prefix}_id", link.get("child_type_column") or f"{prefix}_type"

    def is_child(t: Table) -> bool:
        return all(t.find(c) is not None for c in child_columns(t))

    if is_child(target):
        parent, child, down = host, target, True
    elif is_child(host):
        parent, child, down = target, host, False
    else:
        raise SchemaError(f"neither {host.name} nor {target.name} has the columns of the morph {prefix}")
    key = link.get("parent_key_column")
    if key is None:
        if len(parent.primary_key) != 1:
            raise SchemaError(f"the key of {parent.name} must be one column for a morph")
        key = parent.primary_key[0]
    if not parent.soft_deletes and not link.get("hard_deletes"):
        raise SchemaError(f"{parent.name} must be soft deletable to be the parent of a morph")
    child_key, child_type = child_columns(child)
    says = link.get("parent_type") or parent.morph_type
    if down:
        return Step(target, [(key, child_key)], here={child_type: says}, filters=link.get("filters"))
    return Step(target, [(child_key, key)], before={child_type: says}, filters=link.get("filters"))


class _Aliases:
    """Resolves the fields of a link's filters: the target's columns first, then the host's."""

    def __init__(self, tables: list[tuple[str, Table]]):
        self.tables = tables

    def resolve(self, f: Field) -> Resolved | None:
        for alias, t in self.tables:
            if f.table in (None, alias, t.name, t.full_name) and (c := t.find(f.column)) is not None:
                return Resolved(F.col(f"{alias}.{c.full_name}"), c, t, f.path)
        raise QueryError(f"unknown field {f} in the filters of a link")

    def expression(self, text: str) -> Any:
        return F.expr(text)


class Relation:
    def __init__(self, name: str, kind: str, host: Table, target: str, link: dict | None = None, select: Any = None):
        if kind not in KINDS:
            raise SchemaError(f"unknown kind of relation {kind!r}")
        if kind == "many-to-many" and (link or {}).get("type") != "through":
            raise SchemaError(f"{name}: many-to-many needs a through link")
        self.name, self.kind, self.host, self.target_name, self.link, self.select = name, kind, host, target, link, select
        self.spec = {"type": kind, "target": target, **({"link": link} if link else {}), **({"select": select} if select else {})}

    @property
    def target(self) -> Table:
        return self.host.catalog.table(self.target_name)

    @property
    def one(self) -> bool:
        return self.kind in ("one-to-one", "many-to-one")

    def check(self) -> None:
        self.steps()
        self.columns()

    def steps(self) -> list[Step]:
        return steps_of(self.host, self.target, self.link)

    def columns(self) -> list[str]:
        return self.target.full_names(self.select) if self.select else [c.full_name for c in self.target.columns.values()]

    def _chain(self, catalog: Catalog, first: DataFrame | None, row: dict | None) -> tuple[DataFrame | None, str]:
        """The joins up to the target, from host rows aliased _l0 or from the values of one host."""
        steps = self.steps()
        df, before = first, ("_l0", self.host)
        for i, s in enumerate(steps, 1):
            alias = f"_l{i}"
            right = catalog.read(s.table).alias(alias)
            t = s.table
            cond = F.lit(True)
            for c, v in s.here.items():
                cond &= F.col(f"{alias}.{t.column(c).full_name}") == F.lit(v)
            if df is None:
                # one host: its values are literals, and nothing of the host's table is read
                values = {self.host.column(k).name: v for k, v in row.items() if self.host.find(k)}
                for c, v in s.before.items():
                    if values.get(c, v) != v:
                        return None, alias
                for a, b in s.pairs:
                    if values.get(a) is None:
                        return None, alias
                    cond &= F.col(f"{alias}.{t.column(b).full_name}") == F.lit(values[a])
                if s.filters is not None:
                    cond &= Filters.from_any(s.filters).to_column(_Aliases([(alias, t)]))
                df = right.where(cond)
            else:
                old, was = before
                for c, v in s.before.items():
                    cond &= F.col(f"{old}.{was.column(c).full_name}") == F.lit(v)
                for a, b in s.pairs:
                    cond &= F.col(f"{old}.{was.column(a).full_name}") == F.col(f"{alias}.{t.column(b).full_name}")
                if s.filters is not None:
                    cond &= Filters.from_any(s.filters).to_column(_Aliases([(alias, t), before]))
                df = df.join(right, cond)
            before = (alias, t)
        return df, f"_l{len(steps)}"

    def _targets(self, df: DataFrame, alias: str, extra: list) -> DataFrame:
        return df.select(*extra, *[F.col(f"{alias}.{c}") for c in self.columns()])

    def _live(self, df: DataFrame, alias: str, include_deleted: bool) -> DataFrame:
        return df if include_deleted or not self.target.soft_deletes else df.where(~F.col(f"{alias}.{self.target.column('deleted').full_name}"))

    def of(self, catalog: Catalog, row: dict[str, Any], include_deleted: bool = False) -> DataFrame:
        """The relatives of one host, given as a dict; none if a value of its link is null."""
        df, alias = self._chain(catalog, None, row)
        if df is None:
            return catalog.read(self.target).select(*self.columns()).limit(0)
        return self._targets(self._live(df, alias, include_deleted), alias, [])

    def key(self, alias: str | None = None) -> Any:
        cols = [F.col(f"{alias}.{c}" if alias else c) for c in self.host.full_names(self.host.identity())]
        return (cols[0] if len(cols) == 1 else F.concat_ws(":", *cols)).alias(HOST_KEY)

    def batch(self, catalog: Catalog, hosts: DataFrame | None = None, include_deleted: bool = False, limit: int | None = None, order_by: list[str] | None = None) -> DataFrame:
        """The relatives of all hosts in one query: host key and the target's columns, repeated as links repeat.

        hosts are rows of the host's table (all by default), of any number: they are joined, not
        listed. limit is for each host, in the order of order_by or the target's key."""
        hosts = catalog.read(self.host) if hosts is None else hosts
        df, alias = self._chain(catalog, hosts.alias("_l0"), None)
        out = self._targets(self._live(df, alias, include_deleted), alias, [self.key("_l0")])
        if limit is None:
            return out
        order = self.target.full_names(order_by or self.target.identity())
        ranked = out.withColumn("_n", F.row_number().over(Window.partitionBy(HOST_KEY).orderBy(*order)))
        return ranked.where(F.col("_n") <= limit).drop("_n")

    def batch_one(self, catalog: Catalog, hosts: DataFrame | None = None, include_deleted: bool = False) -> DataFrame:
        """At most one relative for each host: of several the one with the greatest key."""
        out = self.batch(catalog, hosts, include_deleted)
        key = [c for c in self.target.full_names(self.target.identity()) if c in out.columns]
        names = [c for c in out.columns if c != HOST_KEY]
        last = F.max_by(F.struct(*names), F.struct(*(key or names))).alias("_last")
        return out.groupBy(HOST_KEY).agg(last).select(HOST_KEY, *[F.col("_last").getField(c).alias(c) for c in names])

    def batch_nested(self, catalog: Catalog, hosts: DataFrame | None = None, include_deleted: bool = False, limit: int | None = None) -> DataFrame:
        """Every host's key, with its relatives in a list (or one struct): [] or null if it has none.

        A list is as long as its host has relatives; with limit, Spark cuts each host's rows before it
        shuffles them. Use batch() for hosts with more relatives than a row should hold."""
        hosts = catalog.read(self.host) if hosts is None else hosts
        keys = hosts.select(self.key()).distinct()
        found = self.batch_one(catalog, hosts, include_deleted) if self.one else self.batch(catalog, hosts, include_deleted, limit)
        names = [c for c in found.columns if c != HOST_KEY]
        each = F.struct(*names)
        grouped = found.groupBy(HOST_KEY).agg((F.first(each) if self.one else F.collect_list(each)).alias(self.name))
        out = keys.join(grouped, HOST_KEY, "left")
        return out if self.one else out.withColumn(self.name, F.coalesce(self.name, F.array().cast(grouped.schema[self.name].dataType)))

    def count_batch(self, catalog: Catalog, hosts: DataFrame | None = None, include_deleted: bool = False) -> DataFrame:
        """The number of relatives of every host, 0 included: one query for all."""
        hosts = catalog.read(self.host) if hosts is None else hosts
        counts = self.batch(catalog, hosts, include_deleted).groupBy(HOST_KEY).agg(F.count(F.lit(1)).alias("total"))
        return hosts.select(self.key()).distinct().join(counts, HOST_KEY, "left").select(HOST_KEY, F.coalesce("total", F.lit(0)).cast("long").alias("total"))

    def fill(self, host: dict[str, Any], relative: dict[str, Any]) -> dict[str, Any]:
        """A relative with the host's key put into it; only links of one step can."""
        steps = self.steps()
        if len(steps) != 1 or (self.link or {}).get("type") in ("through", "join"):
            raise QueryError(f"{self.name}: a relative of this link cannot be filled in")
        s = steps[0]
        out = dict(relative)
        for a, b in s.pairs:
            out[b] = host.get(a, host.get(self.host.column(a).full_name))
        return {**out, **s.here}


def greater(hosts: DataFrame, targets: DataFrame, on: dict[str, str], than: tuple[str, str], key: list[str], run: int = RUN, parts: int = PARTS) -> DataFrame:
    """Each host's row beside every target that agrees with it in the columns of on and has the greater value: than names both values.

    Host columns are named first in on and than; all names must differ. Pairs may be as many as the square of the rows, so
    these are what the work is dealt out by. Targets are sorted within a group and cut into runs; a host meets
    runs whose greatest value is above its own, each as one row that is unfolded in place, so few pairs but those returned are
    compared. A run and a part of its hosts go to a task together, whatever the group's size. key names columns of the target
    that settle the order of equal values: a task that runs again must cut the same runs. Null equals and exceeds nothing;
    NaN exceeds all but itself."""
    mine, theirs = than
    groups = {f"_on{i}": (a, b) for i, (a, b) in enumerate(on.items())}
    place = F.row_number().over(Window.partitionBy(*on.values()).orderBy(theirs, *key))
    known = targets
    for c in (*on.values(), theirs):
        known = known.where(F.col(c).isNotNull())
    # the host's names are not used here, and the target's are inside the rows
    runs = known.withColumn("_run", F.floor((place - 1) / run)).groupBy(*[F.col(b).alias(k) for k, (_, b) in groups.items()], "_run").agg(F.collect_list(F.struct(*targets.columns)).alias("_rows"), F.max(theirs).alias("_top"))
    same = F.lit(True)
    for k, (a, _) in groups.items():
        same &= F.col(a) == F.col(k)
    met = hosts.join(F.broadcast(runs.drop("_rows")), same & (F.col("_top") > F.col(mine))).select(*hosts.columns, F.col("_run").alias("_met"), F.pmod(F.hash(*[F.col(c) for c in hosts.columns]), F.lit(parts)).alias("_part"))
    dealt = runs.drop("_top").withColumn("_of", F.explode(F.array(*[F.lit(i) for i in range(parts)])))
    # neither by broadcast, where tasks are those that read the hosts, nor with small partitions put together: what is small here gives many pairs
    n = int(hosts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met, dealt = met.repartition(n, *on, "_met", "_part"), dealt.repartition(n, *groups, "_run", "_of")
    pairs = met.join(dealt.hint("merge"), same & (F.col("_met") == F.col("_run")) & (F.col("_part") == F.col("_of")))
    return pairs.select(*hosts.columns, F.explode("_rows").alias("_row")).where(F.col(f"_row.{theirs}") > F.col(mine)).select(*hosts.columns, "_row.*")


class VirtualRelation:
    """Relatives that a function gives: controller(host row as dict, options) or controller.batch(hosts, options)."""

    spec = None

    def __init__(self, name: str, host: Table, controller: Callable[..., DataFrame], paginated: bool = False):
        self.name, self.host, self.controller, self.paginated = name, host, controller, paginated

    def check(self) -> None:
        if not callable(self.controller):
            raise SchemaError(f"{self.name}: the controller of a virtual relation must be callable")

    def of(self, catalog: Catalog, row: dict[str, Any], **options: Any) -> DataFrame:
        return self.controller(catalog, row, **options)

    def batch(self, catalog: Catalog, hosts: DataFrame, **options: Any) -> DataFrame:
        run = getattr(self.controller, "batch", None)
        if run is None:
            raise QueryError(f"{self.name} has no batch form")
        return run(catalog, hosts, **options)
