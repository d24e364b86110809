"""The engine: contracts, views for callers, queries, validation and writes."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
import re
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from pactspark.functions import rules
from pactspark.operators import shapes, vectors
from pactspark.plans import guard
from pactspark.plans.contract import Contract, ContractError, Rule
from pactspark.plans.guard import GATE, Refused, inspect
from pactspark.plans.rewrite import Rewriter
from pactspark.plans.signer import SocketSigner
from pactspark.sources.store import ENGINE, Store


class Denied(PermissionError):
    """A decide rule refuses this caller, or the caller does not own what it would write."""


class NotFound(LookupError):
    """No such contract for this caller, whether or not it exists."""


class NotWritten(LookupError):
    """The contract has no data yet."""


class Violated(ValueError):
    """A write or read breaks rules."""


class GuaranteeFailed(RuntimeError):
    """A guarantee that denies does not hold."""


class BudgetExceeded(PermissionError):
    """A caller's privacy budget does not allow this query."""


class Budgets:
    """Epsilon spent by (budget, tenant/caller); charges all or none, before anything runs."""

    def __init__(self, limit: float = 10.0, store: Store | None = None):
        self.limit, self.limits, self.store = limit, {}, store or Store()

    @property
    def spent(self) -> dict[tuple[str, str], float]:
        return {tuple(json.loads(k)): v for k, v in self.store.get("budgets", "spent", {}).items()}

    def charge(self, caller: Mapping, costs: Mapping[str, float]) -> dict[str, float]:
        """What is left of each budget after all ``costs``; nothing is spent if one does not suffice."""
        if not costs:
            return {}
        who = f"{caller.get('tenant')}/{caller.get('id')}"
        with self.store.locked("budgets"):
            spent = self.spent
            left = {b: self.limits.get(b, self.limit) - spent.get((b, who), 0.0) - e for b, e in costs.items()}
            if short := [b for b, x in left.items() if x < -1e-12]:
                raise BudgetExceeded(f"budget {short[0]} is spent")
            for b, e in costs.items():
                spent[b, who] = spent.get((b, who), 0.0) + e
            self.store.put("budgets", "spent", {json.dumps(k): v for k, v in spent.items()})
        return left


class Cache:
    """The last answers as Arrow tables, by everything that decides them; bounded in number, bytes and age."""

    def __init__(self, most: int = 10_000, most_bytes: int = 256 << 20, seconds: float = 60):
        self.most, self.most_bytes, self.seconds, self.held, self.bytes = most, most_bytes, seconds, OrderedDict(), 0

    def get(self, key: str) -> tuple[pa.Table, dict] | None:
        found = self.held.get(key)
        if found is None or time.monotonic() - found[0] > self.seconds:
            return None
        self.held.move_to_end(key)
        return found[1]

    def put(self, key: str, answer: tuple[pa.Table, dict]) -> None:
        if key in self.held:
            self.bytes -= self.held.pop(key)[1][0].nbytes
        self.held[key] = (time.monotonic(), answer)
        self.bytes += answer[0].nbytes
        while self.held and (len(self.held) > self.most or self.bytes > self.most_bytes):
            self.bytes -= self.held.popitem(last=False)[1][1][0].nbytes


class Engine:
    """Contracts over one Spark session. ``base`` is the folder that relative bindings start from."""

    def __init__(self, spark: SparkSession, base: str, now: dt.datetime | None = None, audit: str | None = None, store: Store | None = None, signer: SocketSigner | None = None):
        self.spark, self.base, self.now, self.audit_path, self.signer = spark, base.rstrip("/"), now, audit, signer
        self.store = store or Store()
        self.documents: dict[str, Mapping] = {}
        self.contracts: dict[str, Contract] = {}
        self.frames: dict[str, DataFrame] = {}
        self.functions: dict[str, dict] = {}
        self.budgets, self.cache = Budgets(store=self.store), Cache()
        documents, self.stale = self.store.documents()
        while documents:  # parents first
            ready = [d for d in documents if d.get("inherits") in (None, *self.documents)] or documents
            for doc in ready:
                self._hold(doc)
            documents = [d for d in documents if d not in ready]

    @classmethod
    def open(cls, spark: SparkSession, root: str, **options) -> Engine:
        """An engine whose contracts, budgets and manifests live in ``root``."""
        return cls(spark, root, store=Store(f"{root.rstrip('/')}/_engine"), **options)

    @classmethod
    def in_memory(cls, spark: SparkSession, base: str = ".", **options) -> Engine:
        return cls(spark, base, **options)

    # --- contracts

    def _hold(self, doc: Mapping) -> Contract:
        made = Contract.of(doc, self.documents)
        if clash := [c.name for c in self.contracts.values() if c.table == made.table and c.name != made.name]:
            raise ContractError(f"{made.name} and {clash[0]} would share the table name {made.table}")
        self.documents[made.name], self.contracts[made.name] = doc, made
        return made

    def register(self, doc: Mapping, frame: DataFrame | None = None) -> Contract:
        """Take a document; a version that is already there may not change, and an older one may not come back."""
        made, before = Contract.of(doc, self.documents), self.contracts.get(doc.get("contract"))
        for name, pin in made.pins.items():
            self._function(name, made.owner, pin)
        if before is not None and (made.version < before.version or made.version == before.version and made.hash != before.hash and self.store.root):
            raise ContractError(f"{made.name} version {made.version} is already registered")
        made = self._hold(doc)
        self.store.put("contracts", made.name, {"engine": ENGINE, "hash": made.hash, "document": doc})
        if frame is not None:
            if missing := [c for c in made.exposed if c not in frame.columns]:
                raise ContractError(f"{made.name}: the rows lack {missing}")
            self.frames[made.name] = frame
        return made

    def publish(self, name: str, to: str) -> None:
        self.store.put("published", name, sorted({*self.store.get("published", name, []), to}))

    def unpublish(self, name: str, to: str) -> None:
        self.store.put("published", name, sorted({*self.store.get("published", name, [])} - {to}))

    def visible(self, name: str, caller: Mapping) -> Contract:
        found = self.contracts.get(name) or next((c for c in self.contracts.values() if c.table.lower() == name.lower()), None)
        if found is None or not (found.owner in (None, caller.get("tenant")) or {*self.store.get("published", found.name, [])} & {"public", caller.get("tenant")}):
            raise NotFound(f"no contract {name}")
        return found

    def names(self, caller: Mapping) -> list[str]:
        out = []
        for name in sorted(self.contracts):
            try:
                out.append(self.visible(name, caller).name)
            except NotFound:
                continue
        return out

    def add_function(self, name: str, owner: str | None, on_driver: Callable, on_rows: Callable, source: str) -> str:
        """A tenant's scalar function for rules; its pin is the digest of ``source``. A name belongs to its first owner."""
        if name in rules.FUNCTIONS or self.functions.get(name, {"owner": owner})["owner"] != owner:
            raise ContractError(f"{name} is taken")
        pin = hashlib.sha256(source.encode()).hexdigest()
        self.functions[name] = {"owner": owner, "pin": pin, "pair": (on_driver, on_rows)}
        return pin

    def _function(self, name: str, owner: str | None, pin: str) -> tuple:
        held = self.functions.get(name)
        if held is None or held["owner"] != owner or held["pin"] != pin:
            raise ContractError(f"{name} is not the function that was pinned")
        return held["pair"]

    def location(self, c: Contract) -> str:
        path = (c.path or "").removeprefix("file://")
        if ".." in Path(path).parts:
            raise Refused("a binding may not leave its base")
        return path if path.startswith("/") or "://" in path else f"{self.base}/{path}"

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _remove(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def rows(self, c: Contract) -> DataFrame:
        """All columns of the data, with the contract's enrichments; Spark prunes what a query does not read."""
        if c.name in self.frames:
            frame = self.frames[c.name]
        elif not c.path:
            raise NotWritten(f"{c.name} has no data")
        elif not self._exists(self.location(c)):
            raise NotWritten(f"{c.name} has no data yet")
        else:
            reader = self.spark.read.schema(", ".join(f"`{n}` {t}" for n, t in c.schema.items())) if c.schema else self.spark.read
            frame = reader.parquet(self.location(c))
        return self._enriched(c, frame)

    def _enriched(self, c: Contract, frame: DataFrame) -> DataFrame:
        build = self._builder(c, {}, frame)
        return frame.withColumns({f"other.{n}": build.column(rules.parse(e)) for n, e in c.enrich.items()}) if c.enrich else frame

    def _now(self) -> dt.datetime:
        return self.now or dt.datetime.now(dt.UTC).replace(tzinfo=None)

    def _builder(self, c: Contract, caller: Mapping, frame: DataFrame | None = None, dataset: Mapping | None = None) -> rules.Builder:
        pinned = {n: self._function(n, c.owner, pin) for n, pin in c.pins.items()}
        lists = {n for n, t in frame.dtypes if t.startswith("array")} if frame is not None else set()
        return rules.Builder({"now": self._now(), **caller}, set(frame.columns) if frame is not None else None, dataset, pinned, lists)

    def describe(self, name: str, caller: Mapping) -> list[tuple[str, str]]:
        return self._view(name, caller).dtypes

    # --- reading

    def _shapes(self, c: Contract, caller: Mapping) -> list[Rule]:
        build = self._builder(c, caller)
        return [r for r in c.of_op("shape") if r.unless is None or not build.truth(r.unless)]

    def _flags(self, c: Contract, build: rules.Builder) -> dict[str, Column]:
        """Each assert as a boolean that is never null: unknown fails."""
        return {r.id: F.coalesce(build.column(r.node), F.lit(False)) for r in c.of_op("assert")}

    def _decided(self, c: Contract, caller: Mapping) -> None:
        build = self._builder(c, caller)
        for r in c.of_op("decide"):
            if not build.truth(r.node):
                raise Denied(f"{c.name}: {r.id}")

    def _view(self, name: str, caller: Mapping) -> DataFrame:
        """What ``caller`` may see, before what its shapes say of whole answers: decided, admitted, enforced, masked, sampled, noised by row."""
        c = self.visible(name, caller)
        self._decided(c, caller)
        self._guaranteed(c, caller)
        frame = self.rows(c)
        build = self._builder(c, caller, frame)
        for r in c.of_op("admit"):
            frame = frame.filter(build.column(r.node))
        flags = self._flags(c, build)
        for r in c.of_op("assert"):
            if r.on_fail in ("drop", "deny"):
                frame = frame.filter(flags[r.id])
        shown = {n: F.col(f"`{n}`") for n in c.exposed}
        for r in c.of_op("transform"):
            made = build.build(r.node)
            shown[r.column] = F.lit(None).cast(frame.schema[r.column].dataType) if made is None else rules.as_column(made)
        for r in self._shapes(c, caller):
            if r.operator == "sample":
                frame = frame.filter(shapes.in_sample(F.col(r.params["key"]), float(r.params["fraction"])))
            if r.operator == "noise" and r.params.get("at") == "row":
                shown[r.params["column"]] = shown[r.params["column"]] + shapes.laplace(r.params["sensitivity"] / r.params["epsilon"])
        return frame.select(*(v.alias(n) for n, v in shown.items()))

    def view(self, name: str, caller: Mapping) -> DataFrame:
        """The governed lazy DataFrame, for plans made elsewhere; row noise is charged once, here.

        A contract whose shapes speak of answers (suppression, aggregate noise) has
        no such view: its answers leave through ``query``.
        """
        c = self.visible(name, caller)
        if held := [r.id for r in self._shapes(c, caller) if r.operator == "suppress" or r.operator == "noise" and r.params.get("at") != "row"]:
            raise Refused(f"{c.name}: {held[0]} lets answers out through query() only")
        made = self._view(name, caller)
        self.budgets.charge(caller, self._charges([c], caller, False))
        return made

    def _guaranteed(self, c: Contract, caller: Mapping) -> list[str]:
        """Annotations of guarantees that fail; one that denies raises. Unknown statistics are skipped."""
        notes, dataset = [], self.facts.get(c.name)
        for r in c.of_op("guarantee") if dataset else ():
            held = self._builder(c, caller, None, dataset).build(r.node)
            if held is False and r.on_fail == "deny":
                raise GuaranteeFailed(f"{c.name}: {r.id}")
            notes += [r.id] if held is False else []
        return notes

    def _charges(self, contracts: Sequence[Contract], caller: Mapping, aggregate: bool) -> dict[str, float]:
        costs: dict[str, float] = {}
        for c in contracts:
            for r in self._shapes(c, caller):
                if r.operator == "noise" and (aggregate or r.params.get("at") == "row"):
                    budget = r.params.get("budget", c.name)
                    costs[budget] = max(costs.get(budget, 0.0), float(r.params["epsilon"]))
        return costs

    def _prepared(self, sql: str, caller: Mapping, on_violation: str) -> tuple[list[Contract], Callable[[], tuple[DataFrame, Rewriter]], dict]:
        """The contracts of a query, and how to make its governed plan; nothing is charged or run."""
        if on_violation not in ("exclude", "refuse"):
            raise ValueError("on_violation is exclude or refuse")
        searches: dict[str, tuple] = {}
        sql = vectors.lift_searches(self._quoted(sql, caller), searches)
        session = SparkSession(self.spark.sparkContext, self.spark._jsparkSession.cloneSession())
        session.conf.set("spark.sql.runSQLOnFiles", "false")
        read, defined = inspect(session, sql)
        if hides := [n for n in defined if n.lower() in {c.table.lower() for c in self.contracts.values()} | {x.lower() for x in searches} or session.catalog.tableExists(n)]:
            raise Refused(f"WITH may not define {hides[0]}, which is a table")
        of = {t: self.visible(searches[t][0] if t in searches else t, caller) for t in sorted(read - defined)}
        found = list({c.name: c for c in of.values()}.values())
        notes = {}
        for c in found:
            self._decided(c, caller)
            notes[c.name] = self._guaranteed(c, caller)
            broken = {r.id: n for r in c.of_op("assert") if r.on_fail in ("drop", "deny") and (n := (self.facts.get(c.name) or {}).get("assertions", {}).get(r.id, {}).get("failures"))}
            if broken and on_violation == "refuse":
                raise Violated(f"{c.name}: {', '.join(f'{i} fails for {n} rows' for i, n in broken.items())}")
        k = max((int(r.params["k"]) for c in found for r in self._shapes(c, caller) if r.operator == "suppress"), default=1)
        noised = {f"{GATE}{c.name}": {r.params["column"]: r.params["sensitivity"] / r.params["epsilon"] for r in self._shapes(c, caller) if r.operator == "noise" and r.params.get("at") != "row"} for c in found}

        def plan() -> tuple[DataFrame, Rewriter]:
            rewriter = Rewriter(session, k, noised)
            views = {c.name: self._view(c.name, caller).observe(f"{GATE}{c.name}", F.count(F.lit(1)).alias("released")) for c in found}
            for table, c in of.items():
                gated = views[c.name]
                if table in searches:
                    _, column, query, most, metric = searches[table]
                    gated = vectors.nearest(gated, column, query, most, metric)
                rewriter.frame(gated._jdf.queryExecution().logical()).createOrReplaceTempView(table)
            analysed = session.sql(sql)._jdf.queryExecution().analyzed()
            guard.check_functions(analysed)
            made = rewriter.finish(rewriter.rewrite(analysed))
            guard.ensure_gated(made)
            return rewriter.frame(made), rewriter

        return found, plan, {"k": k, "notes": notes}

    def _quoted(self, sql: str, caller: Mapping) -> str:
        """Whole contract names in double quotes, as table names."""
        tables = {f'"{c.name}"': f"`{c.table}`" for c in self.contracts.values()}
        return re.sub(r"'(?:[^'\\]|\\.)*'|\"[^\"]*\"", lambda m: tables.get(m[0], m[0]), sql)

    def query(self, sql: str, caller: Mapping, on_violation: str = "exclude") -> DataFrame:
        """The answer to one read-only query over the caller's views.

        Suppression and aggregate noise are part of its plan. ``refuse`` raises where
        the last validation found rows that enforced rules leave out.
        """
        try:
            found, plan, about = self._prepared(sql, caller, on_violation)
            answer, rewriter = plan()
            self.budgets.charge(caller, {**self._charges(found, caller, False), **(self._charges(found, caller, True) if rewriter.charged else {})})
        except Exception as e:
            self._audit(sql, caller, [], refused=type(e).__name__)
            raise
        self._audit(sql, caller, [c.name for c in found])
        return shapes.withheld(answer, about["k"]) if about["k"] > 1 and not rewriter.aggregates else answer

    def check(self, sql: str, caller: Mapping) -> list[str]:
        """All checks of a query without reading a row or charging; the contracts it reads."""
        try:
            found, plan, _ = self._prepared(sql, caller, "exclude")
            plan()
        except Exception as e:
            self._audit(sql, caller, [], refused=type(e).__name__)
            raise
        return [c.name for c in found]

    def explain(self, sql: str, caller: Mapping) -> str:
        """The physical plan, for whoever runs the engine."""
        return self._prepared(sql, caller, "exclude")[1]()[0]._jdf.queryExecution().toString()

    def query_with_envelope(self, sql: str, caller: Mapping, on_violation: str = "exclude") -> tuple[pa.Table, dict]:
        """The answer as an Arrow table and what it rests on: digests, contracts, notes, released rows. Repeats come from the cache.

        Where the engine has a signer, ``signature`` is its signature of all the rest; without one, no answer.
        """
        found, _, about = self._prepared(sql, caller, on_violation)
        noisy = any(r.operator == "noise" for c in found for r in self._shapes(c, caller))
        versions = [(c.name, c.version, c.hash, json.dumps(self.facts.get(c.name), default=str, sort_keys=True)) for c in found]
        key = hashlib.sha256(json.dumps([sql, on_violation, sorted(caller.items()), versions, str(self.now)], default=str).encode()).hexdigest()
        if not noisy and (held := self.cache.get(key)):
            return self._signed(*held)
        answer = self.query(sql, caller, on_violation)
        table = answer.toArrow().combine_chunks()
        observed = answer._jdf.queryExecution().observedMetrics()
        released = {c.name: observed.get(f"{GATE}{c.name}").get().getLong(0) if observed.contains(f"{GATE}{c.name}") else None for c in found}
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        contracts = [{"contract": c.name, "version": c.version, "hash": c.hash, "view_hash": c.view_hash, "annotations": about["notes"][c.name], "released": released[c.name]} for c in found]
        envelope = {"sql_sha256": hashlib.sha256(sql.encode()).hexdigest(), "answer_sha256": hashlib.sha256(sink.getvalue()).hexdigest(), "rows": table.num_rows, "caller": caller.get("id"), "contracts": contracts, "noise": noisy}
        if not noisy:
            self.cache.put(key, (table, envelope))
        return self._signed(table, envelope)

    def _signed(self, table: pa.Table, envelope: dict) -> tuple[pa.Table, dict]:
        return table, envelope | {"signature": self.signer.sign(envelope)} if self.signer else envelope

    def aggregate(self, name: str, caller: Mapping, by: Sequence[str], values: Mapping[str, tuple[str, str]]) -> DataFrame:
        """Aggregates {alias: (count|sum|avg|min|max, column)} under the contract's suppression and noise, as ``query`` gives them."""
        c = self.visible(name, caller)
        for kind, column in values.values():
            if kind not in ("count", "sum", "avg", "min", "max") or column != "*" and column not in c.exposed:
                raise Refused(f"{kind} of {column} is not released")
        tick = lambda n: f"`{n.replace('`', '``')}`"
        outputs = [*map(tick, by), *(f"{kind}({'*' if column == '*' else tick(column)}) AS {tick(alias)}" for alias, (kind, column) in values.items())]
        groups = f" GROUP BY {', '.join(map(tick, by))}" if by else ""
        return self.query(f"SELECT {', '.join(outputs)} FROM {tick(c.table)}{groups}", caller)

    def vector_search(self, name: str, caller: Mapping, column: str, query: Sequence[float], k: int, metric: str, tie: str | None = None) -> DataFrame:
        """The nearest rows of the view; a contract with answer shapes answers in SQL only."""
        return vectors.nearest(self.view(name, caller), column, query, k, metric, tie)

    def _audit(self, what: str, caller: Mapping, contracts: list[str], refused: str | None = None) -> None:
        if self.audit_path:
            record = {"at": str(self._now()), "caller": caller.get("id"), "tenant": caller.get("tenant"), "sql_sha256": hashlib.sha256(what.encode()).hexdigest(), "contracts": contracts}
            with open(self.audit_path, "a") as out:
                out.write(json.dumps(record | ({"refused": refused} if refused else {})) + "\n")

    # --- validation

    @property
    def facts(self) -> Manifests:
        return Manifests(self.store)

    def statistics(self, name: str, columns: Sequence[str] | None = None, distinct: Sequence[str] | None = None) -> DataFrame:
        """One row of facts from one aggregation: row_count, failures, null counts, min, max, and distinct counts of ``distinct`` (null: all)."""
        c = self.contracts[name]
        frame = self.rows(c)
        return frame.agg(*self._facts_of(c, frame, columns, distinct))

    def _facts_of(self, c: Contract, frame: DataFrame, columns: Sequence[str] | None, distinct: Sequence[str] | None) -> list[Column]:
        flags = self._flags(c, self._builder(c, {}, frame))
        parts = [F.count(F.lit(1)).alias("row_count")]
        parts += [F.count_if(~f).alias(f"{i}_failures") for i, f in flags.items()]
        for n in columns if columns is not None else [x for x, t in frame.dtypes if not t.startswith(("array", "map", "struct", "binary"))]:
            at = F.col(f"`{n}`")
            parts += [F.count_if(at.isNull()).alias(f"{n}_null_count"), F.min(at).alias(f"{n}_min"), F.max(at).alias(f"{n}_max")]
            parts += [F.count_distinct(at).alias(f"{n}_distinct_count")] if distinct is None or n in distinct else []
        return parts

    def _as_facts(self, c: Contract, row: Mapping) -> dict:
        n = row["row_count"]
        facts: dict = {"row_count": n, "assertions": {}, "hash": c.hash, "written_at": (self.facts.get(c.name) or {}).get("written_at")}
        for r in c.of_op("assert"):
            failed = row[f"{r.id}_failures"]
            facts["assertions"][r.id] = {"failures": failed, "pass_rate": 1 - failed / n if n else None}
        for key in [k.removesuffix("_null_count") for k in row if k.endswith("_null_count")]:
            nulls = row[f"{key}_null_count"]
            facts[key] = {"null_count": nulls, "null_rate": nulls / n if n else None, "min": row[f"{key}_min"], "max": row[f"{key}_max"], "distinct_count": row.get(f"{key}_distinct_count")}
        return facts

    def validate(self, name: str, columns: Sequence[str] | None = None) -> dict:
        """Decide the facts that guarantees read, and remember them. Distinct values are counted where a guarantee asks for them."""
        c = self.contracts[name]
        asked = set().union(*(rules.dataset_columns(r.node, "distinct_count") for r in c.of_op("guarantee")))
        facts = self._as_facts(c, self.statistics(name, columns, sorted(asked)).first().asDict())
        self.facts.put(name, facts)
        return facts

    # --- writing

    def authorize_write(self, name: str, caller: Mapping) -> Contract:
        """The contract, if ``caller`` is of the tenant that owns it."""
        c = self.visible(name, caller)
        if c.owner is not None and caller.get("tenant") != c.owner:
            raise Denied(f"{name} belongs to another tenant")
        return c

    def _conformed(self, c: Contract, frame: DataFrame) -> DataFrame:
        """The declared columns in their order and types; without a declared schema, the rows as they come."""
        if missing := [n for n in c.schema or c.exposed if n not in frame.columns]:
            raise ContractError(f"{c.name}: the rows lack {missing}")
        return frame.select(*(F.col(f"`{n}`").cast(t).alias(n) for n, t in c.schema.items())) if c.schema else frame

    def write(self, name: str, frame: DataFrame, mode: str = "append", on_violation: str = "refuse", caller: Mapping | None = None) -> dict:
        """Write rows through their contract, and every other contract on the same place.

        ``refuse`` writes nothing if an enforced rule fails, ``exclude`` sets
        breaking rows aside with ``_violations``, ``warn`` commits all. Rows are
        staged once, the good apart from the breaking; the stage goes away, but for
        rows set aside. Facts follow an append by combining, without distinct counts.
        """
        c = self.contracts[name] if caller is None else self.authorize_write(name, caller)
        if mode not in ("append", "overwrite") or on_violation not in ("refuse", "exclude", "warn"):
            raise ValueError("mode is append or overwrite; on_violation is refuse, exclude or warn")
        if c.name in self.frames or not c.path or c.path.endswith(".parquet"):
            raise Refused(f"{name} is not writable")
        to = self.location(c)
        frame = self._conformed(c, frame)
        broken, enforced = [], []
        for other in [c, *(o for o in self.contracts.values() if o.name != c.name and o.path and o.name not in self.frames and self.location(o) == to)]:
            flags = self._flags(other, self._builder(other, {}, enriched := self._enriched(other, frame)))
            frame = enriched
            for r in other.of_op("assert"):
                if r.on_fail in ("drop", "deny") and r.id not in enforced:
                    enforced.append(r.id)
                    broken.append(F.when(~flags[r.id], F.lit(r.id)))
        plain = [n for n in frame.columns if not n.startswith("other.")]
        marks = F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")
        marked = frame.withColumn("_violations", marks).select(*(F.col(f"`{n}`") for n in plain), "_violations")
        stage = f"{os.path.dirname(to)}/_staging_{os.path.basename(to)}/{uuid.uuid4().hex}"
        marked.withColumn("_broken", F.size("_violations") > 0).write.partitionBy("_broken").parquet(stage)
        staged = self.spark.read.schema(StructType([*marked.schema.fields, StructField("_broken", BooleanType())])).parquet(stage)
        counts = staged.agg(F.count(F.lit(1)).alias("rows"), F.count_if("_broken").alias("broken"), *(F.count_if(F.array_contains("_violations", i)).alias(i) for i in enforced)).first()
        if counts["broken"] and on_violation == "refuse":
            self._remove(stage)
            raise Violated(f"{name}: {', '.join(f'{i} fails for {counts[i]} rows' for i in enforced if counts[i])}")
        good = (staged if on_violation == "warn" else staged.filter("not _broken")).drop("_violations", "_broken")
        writer = good.write.mode(mode)
        (writer.partitionBy(*c.partitioned_by) if c.partitioned_by else writer).parquet(to)
        self._carry(c, good, mode)
        aside = staged.filter("_broken").drop("_broken") if on_violation == "exclude" and counts["broken"] else marked.limit(0)
        self._remove(f"{stage}/_broken=false" if on_violation == "exclude" and counts["broken"] else stage)
        return {"rows": counts["rows"], "broken": counts["broken"], "set_aside": aside}

    def _carry(self, c: Contract, good: DataFrame, mode: str) -> None:
        """Facts after a write: counts add, extremes merge, rates follow, distinct counts become unknown; other contracts' facts lapse."""
        before = self.facts.get(c.name) if mode == "append" else None
        for other in self.contracts.values():
            if other.name != c.name and other.path and other.name not in self.frames and self.location(other) == self.location(c):
                self.facts.drop(other.name)
        if before is None or before.get("hash") != c.hash:
            self.facts.drop(c.name)
            return
        columns = [k for k, v in before.items() if isinstance(v, dict) and "null_count" in v]
        enriched = self._enriched(c, good)
        new = self._as_facts(c, enriched.agg(*self._facts_of(c, enriched, columns, [])).first().asDict())
        n = before["row_count"] + new["row_count"]
        for key in columns:
            a, b = before[key], new[key]
            nulls = a["null_count"] + b["null_count"]
            ends = {e: pick((v for v in (a[e], b[e]) if v is not None), default=None) for e, pick in (("min", min), ("max", max))}
            new[key] = {"null_count": nulls, "null_rate": nulls / n if n else None, **ends, "distinct_count": None}
        for i, held in new["assertions"].items():
            failed = held["failures"] + before["assertions"][i]["failures"]
            new["assertions"][i] = {"failures": failed, "pass_rate": 1 - failed / n if n else None}
        self.facts.put(c.name, {**new, "row_count": n, "written_at": before.get("written_at")})


class Manifests:
    """Each contract's facts in the store; times, dates and decimals come back as they went in."""

    def __init__(self, store: Store):
        self.store = store

    def get(self, name: str, default: dict | None = None) -> dict | None:
        held = self.store.get("manifests", name)
        return default if held is None else json.loads(json.dumps(held), object_hook=_revived)

    def put(self, name: str, facts: Mapping) -> None:
        self.store.put("manifests", name, json.loads(json.dumps(facts, default=_plain)))

    def drop(self, name: str) -> None:
        if self.store.get("manifests", name) is not None:
            self.store.put("manifests", name, None)

    def __setitem__(self, name: str, facts: Mapping) -> None:
        self.put(name, facts)

    def __getitem__(self, name: str) -> dict:
        return self.get(name)


def _plain(value: object) -> dict:
    return {"_type": type(value).__name__, "_value": value.isoformat() if isinstance(value, (dt.date, dt.datetime)) else str(value)}


def _revived(held: dict) -> object:
    if "_type" not in held:
        return held
    import decimal

    made = {"datetime": dt.datetime.fromisoformat, "date": dt.date.fromisoformat, "Decimal": decimal.Decimal}.get(held["_type"])
    return made(held["_value"]) if made else held["_value"]
