"""Model registry: declare models, build them in dependency order.

A model is a Python function that takes a context (``ref``, ``source``, ``config``, ``this``,
``is_incremental``) and returns a DataFrame. Materializations: view, table, incremental,
materialized_view, seed. Models without a common dependency may build at the same time: Spark's
scheduler takes jobs from several driver threads.
"""

from __future__ import annotations

import hashlib
import json
import logging
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthmill.plans import data_tests, strategies
from hearthmill.plans.store import TableStore

log = logging.getLogger("hearthmill")


@dataclass
class Model:
    name: str
    build: Callable[[Context], DataFrame]
    depends: list[str]
    materialized: str = "view"
    unique_key: list[str] = field(default_factory=list)
    strategy: str | None = None
    on_schema_change: str = "ignore"
    partition_by: list[str] = field(default_factory=list)
    options: dict = field(default_factory=dict)
    before: list[Callable[[TableStore], None]] = field(default_factory=list)
    after: list[Callable[[TableStore], None]] = field(default_factory=list)
    unique_index: list[list[str]] = field(default_factory=list)

    def fingerprint(self) -> str:
        return hashlib.md5(json.dumps([self.options, self.partition_by, self.unique_key], sort_keys=True, default=str).encode()).hexdigest()


class Context:
    """What a model sees."""

    def __init__(self, registry: Registry, model: Model, full_refresh: bool) -> None:
        self._r, self._m, self._full = registry, model, full_refresh
        self.config = model.options

    @property
    def spark(self) -> SparkSession:
        return self._r.store.spark

    def ref(self, name: str) -> DataFrame:
        if name not in self._m.depends:
            raise ValueError(f"{self._m.name} uses {name} without declaring it")
        return self._r.store.read(name)

    def source(self, name: str) -> DataFrame:
        return self._r.sources[name]()

    @property
    def this(self) -> DataFrame:
        """The model's own table as it is now."""
        return self._r.store.read(self._m.name)

    def is_incremental(self) -> bool:
        return self._m.materialized == "incremental" and not self._full and self._r.store.exists(self._m.name)


class Registry:
    def __init__(self, store: TableStore, sources: dict[str, Callable[[], DataFrame]] | None = None) -> None:
        self.store, self.sources = store, sources or {}
        self.models: dict[str, Model] = {}
        self._configs: dict[str, str] = {}

    def model(self, depends: list[str] | None = None, **options):
        """Decorator that registers a model under the function's name."""

        def add(f: Callable[[Context], DataFrame]):
            known = {k: options.pop(k) for k in list(options) if k in Model.__dataclass_fields__}
            self.models[f.__name__] = Model(f.__name__, f, list(depends or []), options=options, **known)
            return f

        return add

    # --- graph

    def order(self, select: list[str] | None = None) -> list[str]:
        """Model names, each after what it depends on; a cycle is an error. ``select`` keeps those and all below them."""
        graph = {n: [d for d in m.depends if d in self.models] for n, m in self.models.items()}
        names = list(TopologicalSorter(graph).static_order())
        if select is None:
            return names
        keep, todo = set(), list(select)
        while todo:
            n = todo.pop()
            if n not in keep:
                keep.add(n)
                todo += graph[n]
        return [n for n in names if n in keep]

    def dependents(self, name: str) -> list[str]:
        """Models that read a relation, directly or through others."""
        out: list[str] = []
        for n in self.order():
            if any(d == name or d in out for d in self.models[n].depends):
                out.append(n)
        return out

    # --- building

    def build(self, name: str, full_refresh: bool = False) -> DataFrame:
        m, s = self.models[name], self.store
        for hook in m.before:
            hook(s)
        ctx = Context(self, m, full_refresh)
        if m.materialized == "view":
            s.create_view(name, lambda: m.build(ctx))
        elif m.materialized in ("table", "seed"):
            s.write(name, m.build(ctx), m.partition_by)
        elif m.materialized == "materialized_view":
            self._materialized_view(m, ctx, full_refresh)
        elif m.materialized == "incremental":
            self._incremental(m, ctx)
        else:
            raise ValueError(f"unknown materialization: {m.materialized}")
        for keys in m.unique_index:
            bad = data_tests.unique_key(s.read(name), keys).limit(1).collect()
            if bad:
                raise strategies.DuplicateKeys(f"{name}: unique index broken by {bad[0].asDict()}")
        for hook in m.after:
            hook(s)
        return s.read(name)

    def _incremental(self, m: Model, ctx: Context) -> None:
        s = self.store
        batch = m.build(ctx)
        if not ctx.is_incremental():
            s.write(m.name, batch, m.partition_by)
            return
        target, batch = strategies.sync_schema(s.read(m.name), batch, m.on_schema_change)
        how = m.strategy or strategies.default_strategy(m.unique_key)
        if how == "append":
            if target.schema == s.read(m.name).schema:
                s.append(m.name, batch, m.partition_by)
                return
            out = strategies.append(target, batch)
        elif how == "delete_insert":
            out = strategies.delete_insert(target, batch, m.unique_key)
        elif how in ("merge", "microbatch"):
            if how == "microbatch" and not m.unique_key:
                raise ValueError("microbatch needs a unique key")
            out = strategies.merge(target, batch, m.unique_key, m.options.get("merge_update_columns"), m.options.get("merge_exclude_columns"))
        elif how == "insert_overwrite":
            out = strategies.overwrite_partitions(target, batch, m.partition_by)
        else:
            raise ValueError(f"unknown strategy: {how}")
        s.write(m.name, out, m.partition_by)

    def _materialized_view(self, m: Model, ctx: Context, full_refresh: bool) -> None:
        """Create, refresh or rebuild; ``on_configuration_change`` (apply, continue, fail) decides about a changed definition."""
        now, before = m.fingerprint(), self._configs.get(m.name)
        changed = before is not None and before != now and self.store.exists(m.name)
        if changed and not full_refresh:
            mode = m.options.get("on_configuration_change", "apply")
            if mode == "fail":
                raise strategies.SchemaChange(f"{m.name}: its configuration has changed")
            if mode == "continue":
                log.warning("%s: changed configuration left unapplied", m.name)
                return
        self.store.write(m.name, m.build(ctx), m.partition_by)
        self._configs[m.name] = now

    def run(self, select: list[str] | None = None, full_refresh: bool = False, threads: int = 1, keep_going: bool = False) -> dict[str, str]:
        """Build models in order: name -> ok, skipped or the error. Models below a failed one are skipped."""
        todo, status = self.order(select), {}
        graph = TopologicalSorter({n: [d for d in self.models[n].depends if d in todo] for n in todo})
        graph.prepare()

        def one(n: str) -> str:
            if any(status.get(d, "ok") != "ok" for d in self.models[n].depends):
                return "skipped"
            try:
                self.build(n, full_refresh)
                return "ok"
            except Exception as e:
                log.exception("model %s failed", n)
                if not keep_going:
                    raise
                return f"{type(e).__name__}: {e}"

        with ThreadPoolExecutor(threads) as pool:
            while graph.is_active():
                ready = list(graph.get_ready())
                for n, got in zip(ready, pool.map(one, ready), strict=True):
                    status[n] = got
                    graph.done(n)
        return status


def model_name(schema: str | None, custom: str | None, name: str) -> str:
    """``<schema>_<custom>.<name>``, as target and custom schema are joined."""
    where = "_".join(x for x in (schema, custom) if x)
    return f"{where}.{name}" if where else name


def row_counts(store: TableStore) -> DataFrame:
    """(table, rows): what a deploy reports."""
    return store.spark.createDataFrame(sorted(store.counts().items()), "relation string, row_count long").orderBy(F.col("relation"))
