"""What a caller's statement may be: one read-only query, of allowed plan nodes and functions, over gated views.

The text is parsed first and checked by an allow-list of plan nodes. After
analysis the plan is walked once more: every expression of the caller's must be
one of Spark's own and not on the list of those that reach outside the query,
and every table must lie under the gate of its contract.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from py4j.java_gateway import JavaObject
from pyspark.errors import ParseException
from pyspark.sql import SparkSession

#: The plan nodes that a caller's query may be made of.
ALLOWED = set(
    "Project Filter Aggregate Join Sort GlobalLimit LocalLimit Limit Offset Distinct Deduplicate Union Intersect Except SubqueryAlias UnresolvedRelation "
    "UnresolvedWith CTE UnresolvedHaving WithWindowDefinition OneRowRelation UnresolvedInlineTable LocalRelation LateralJoin LateralSubquery Generate UnresolvedSubqueryColumnAliases UnresolvedOrderBy".split()
)
#: Expressions that run code, read the session or the files, or fail on purpose.
DENIED = set(
    "CallMethodViaReflection TryReflect StaticInvoke Invoke NewInstance ScalaUDF PythonUDF PythonUDAF PythonUDTF ScalaUDAF ScalaAggregator HiveSimpleUDF HiveGenericUDF HiveUDAFFunction "
    "InputFileName InputFileBlockStart InputFileBlockLength RaiseError AssertTrue CurrentUser SessionUser CurrentDatabase CurrentCatalog SparkVersion SparkPartitionID MonotonicallyIncreasingID "
    "GetVariable VariableReference UserDefinedExpression AesEncrypt AesDecrypt TryAesDecrypt".split()
)
_OWN = "org.apache.spark.sql.catalyst.expressions."
_NODE = re.compile(r"^[\s:+\-]*'?(?P<node>[A-Za-z]\w*)")
_RELATION = re.compile(r"'UnresolvedRelation \[(?P<name>[^\]]*)\]")
GATE = "gate:"
#: Leaves that hold no contract's rows.
_HARMLESS = ("OneRowRelation", "LocalRelation", "CTERelationRef", "UnionLoopRef", "Range", "EmptyRelation")


class Refused(PermissionError):
    """The statement is not one read-only query over visible contracts."""


class Ungated(RuntimeError):
    """A plan reads a contract's rows past its gate."""


def inspect(spark: SparkSession, sql: str) -> tuple[set[str], set[str]]:
    """Names of the tables the query reads, and names its WITH clauses define."""
    try:
        tree = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).treeString()
    except ParseException as e:
        raise Refused("not a single query") from e
    nodes, defined = [], set()
    for line in tree.splitlines():
        found = _NODE.match(line)
        if not found:
            continue
        nodes.append(found["node"])
        if found["node"] == "CTE":
            defined |= set(re.search(r"CTE \[(.*)\]", line)[1].split(", "))
    if bad := [n for n in nodes if n not in ALLOWED]:
        raise Refused(f"{bad[0]} is not part of a read-only query")
    return set(_RELATION.findall(tree)), defined


def items(seq: JavaObject) -> list[JavaObject]:
    return [seq.apply(i) for i in range(seq.size())]


def kind(node: JavaObject) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def is_gate(node: JavaObject) -> bool:
    return kind(node) == "CollectMetrics" and node.name().startswith(GATE)


def expressions(node: JavaObject) -> Iterator[JavaObject]:
    """All expressions of one plan node, depth first."""
    todo = items(node.expressions())
    while todo:
        e = todo.pop()
        yield e
        todo += items(e.children())


def check_functions(plan: JavaObject) -> None:
    """Refuse expressions above the gates that are not Spark's own or that reach outside the query."""
    todo = [plan]
    while todo:
        node = todo.pop()
        if is_gate(node):
            continue
        for e in expressions(node):
            name = kind(e)
            if name in DENIED or not e.getClass().getName().startswith(_OWN):
                raise Refused(f"{name} may not be used in a query")
            if holds_plan(e):
                todo.append(e.plan())
        todo += items(node.children())


def holds_plan(e: JavaObject) -> bool:
    return kind(e) in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery")


def ensure_gated(plan: JavaObject) -> None:
    """Every leaf that may hold rows of a contract must lie under a gate."""
    todo = [plan]
    while todo:
        node = todo.pop()
        if is_gate(node):
            continue
        children = items(node.children())
        if not children and kind(node) not in _HARMLESS:
            raise Ungated(f"{kind(node)} is read past its gate")
        todo += [e.plan() for e in expressions(node) if holds_plan(e)] + children
