"""Contract documents: what a table exposes, to whom, and under which rules."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pactspark.functions import rules

OPS = ("decide", "admit", "assert", "transform", "guarantee", "shape")
ON_FAIL = ("deny", "drop", "report", "annotate")


class ContractError(ValueError):
    """A document is not a valid contract."""


@dataclass(frozen=True)
class Rule:
    id: str
    op: str
    node: tuple | None = None
    on_fail: str = "deny"
    column: str | None = None
    operator: str | None = None
    params: Mapping = field(default_factory=dict)
    unless: tuple | None = None

    @classmethod
    def of(cls, doc: Mapping) -> Rule:
        op = doc.get("op")
        if op not in OPS or not doc.get("id"):
            raise ContractError(f"a rule needs an id and one of {OPS}: {dict(doc)}")
        if op != "shape" and not doc.get("expr"):
            raise ContractError(f"{doc['id']}: no expr")
        if doc.get("on_fail", "deny") not in ON_FAIL:
            raise ContractError(f"{doc['id']}: on_fail is one of {ON_FAIL}")
        if op == "shape" and doc.get("operator") not in ("suppress", "noise", "sample"):
            raise ContractError(f"{doc['id']}: unknown shape")
        node = rules.parse(doc["expr"]) if doc.get("expr") else None
        unless = rules.parse(doc["unless"]) if doc.get("unless") else None
        if op == "decide" and "row" in rules.roots(node) or unless and "row" in rules.roots(unless):
            raise ContractError(f"{doc['id']}: may read ctx only")
        return cls(doc["id"], op, node, doc.get("on_fail", "deny"), doc.get("column"), doc.get("operator"), doc.get("params", {}), unless)


@dataclass(frozen=True)
class Contract:
    name: str
    version: int
    path: str | None
    partitioned_by: tuple[str, ...]
    exposed: tuple[str, ...]
    rules: tuple[Rule, ...]
    enrich: Mapping
    owner: str | None
    schema: Mapping
    pins: Mapping
    hash: str

    @classmethod
    def of(cls, doc: Mapping, parents: Mapping[str, Mapping] | None = None) -> Contract:
        """From a document; ``inherits`` takes the parent's binding and rules, may narrow what is exposed and add rules."""
        seen = {doc.get("contract")}
        while doc.get("inherits"):
            parent = (parents or {}).get(doc["inherits"])
            if parent is None or doc["inherits"] in seen:
                raise ContractError(f"cannot inherit {doc['inherits']!r}")
            seen.add(doc["inherits"])
            open_ = [c["name"] for c in parent.get("expose", [])]
            mine = doc.get("expose") or parent.get("expose", [])
            if extra := [c["name"] for c in mine if c["name"] not in open_]:
                raise ContractError(f"a child cannot expose {extra}")
            own = {r["id"] for r in doc.get("rules", [])}
            if clash := [r["id"] for r in parent.get("rules", []) if r["id"] in own]:
                raise ContractError(f"a child cannot replace {clash}")
            doc = {**parent, **doc, "expose": mine, "rules": [*parent.get("rules", []), *doc.get("rules", [])], "inherits": parent.get("inherits")}
        if not doc.get("contract") or not doc.get("expose"):
            raise ContractError("a contract needs a name and exposed columns")
        made = tuple(Rule.of(r) for r in doc.get("rules", []))
        if len({r.id for r in made}) < len(made):
            raise ContractError("rule ids repeat")
        exposed = tuple(c["name"] for c in doc["expose"])
        for r in made:
            if r.op == "transform" and r.column not in exposed:
                raise ContractError(f"{r.id}: transforms a column that is not exposed")
        binding = doc.get("binding") or {}
        digest = hashlib.sha256(json.dumps(doc, sort_keys=True, default=str).encode()).hexdigest()
        return cls(doc["contract"], int(doc.get("version", 1)), binding.get("parquet"), tuple(binding.get("partitioned_by", ())), exposed, made, doc.get("enrich", {}), doc.get("owner"), doc.get("schema", {}), doc.get("functions", {}), digest)

    def of_op(self, op: str) -> list[Rule]:
        return [r for r in self.rules if r.op == op]

    @property
    def view_hash(self) -> str:
        """A digest of what a view does with rows, whatever the data and the document's other parts."""
        rules_ = [(r.id, r.op, repr(r.node), r.on_fail, r.column, r.operator, sorted(r.params.items()), repr(r.unless)) for r in self.rules]
        return hashlib.sha256(json.dumps([self.exposed, rules_, sorted(self.enrich.items()), sorted(self.pins.items())], default=str).encode()).hexdigest()

    @property
    def table(self) -> str:
        return self.name.replace("/", "_")
