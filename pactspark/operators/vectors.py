"""Vector search: distances as Catalyst expressions, the nearest rows by a top-k plan."""

from __future__ import annotations

import ast
import math
import re
import struct
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("cosine", "euclidean", "dot")


_SEARCH = re.compile(r"""'(?:[^'\\]|\\.)*'|--[^\n]*|\bvector_search\s*\(\s*(?P<table>"[^"]+"|`[^`]+`|[\w]+)\s*,\s*(?P<column>\w+)\s*,\s*\[(?P<query>[^\]]*)\]\s*,\s*(?P<k>[+-]?\d+)\s*,\s*'(?P<metric>\w+)'\s*\)""", re.I)


def lift_searches(sql: str, found: dict[str, tuple]) -> str:
    """Puts a table name for each ``vector_search(table, column, [..], k, 'metric')`` and notes its parts in ``found``."""

    def lifted(m: re.Match) -> str:
        if not m["table"]:
            return m[0]
        name = f"_search_{len(found)}"
        found[name] = (m["table"].strip('"`'), m["column"], list(ast.literal_eval(f"[{m['query']}]")), int(m["k"]), m["metric"].lower())
        return name

    return _SEARCH.sub(lifted, sql)


def distance(vector: Column, query: Sequence[float], metric: str) -> Column:
    """float64 distance; null for a null vector, null or non-finite parts, another dimension, or a zero norm under cosine."""
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}")
    if not query or not all(math.isfinite(q) for q in query):
        raise ValueError("the query vector must be non-empty and finite")
    try:
        query = [struct.unpack("f", struct.pack("f", x))[0] for x in query]  # the stored vectors' precision
    except OverflowError as e:
        raise ValueError("the query vector must fit 32-bit floats") from e
    if metric == "cosine" and not any(query):
        raise ValueError("cosine needs a query vector with a norm")
    v = vector.cast("array<double>")
    q = F.array(*(F.lit(float(x)) for x in query))
    total = lambda f: F.aggregate(F.zip_with(v, q, f), F.lit(0.0), lambda a, x: a + x)
    if metric == "dot":
        out = -total(lambda a, b: a * b)
    elif metric == "euclidean":
        out = F.sqrt(total(lambda a, b: (a - b) * (a - b)))
    else:
        norm = total(lambda a, b: a * a) * F.lit(sum(float(x) * float(x) for x in query))
        out = F.when(norm > 0, 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total(lambda a, b: a * b) / F.sqrt(norm))))
    usable = (F.size(v) == len(query)) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(usable, out)


def nearest(view: DataFrame, column: str, query: Sequence[float], k: int, metric: str, tie: str | None = None) -> DataFrame:
    """The ``k`` rows of least distance with a ``distance`` column; rows without one are left out."""
    if k < 1:
        raise ValueError("k is at least 1")
    if "distance" in view.columns:
        raise ValueError("the view exposes a column named distance")
    ranked = view.withColumn("distance", distance(F.col(column), query, metric)).filter("distance is not null")
    return ranked.orderBy("distance", *([tie] if tie else [])).limit(k)
