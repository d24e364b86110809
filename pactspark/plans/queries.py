"""The engine's registered queries, each over whole tables, with SQL for the same rows."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactspark.plans import surface
from pactspark.plans.engine import Engine

ADMIN = {"id": "root", "tenant": "acme", "roles": ["admin"], "purpose": "analytics"}
ANALYST = {"id": "ann", "tenant": "BUILDING", "roles": [], "purpose": "reporting"}
PROBE = [0.1 * (i % 7) - 0.3 for i in range(64)]

_CUSTOMERS = {
    "contract": "customers",
    "binding": {"parquet": "customer.parquet"},
    "expose": [{"name": n} for n in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")],
    "rules": [
        {"id": "on_purpose", "op": "decide", "expr": "ctx.purpose in ['analytics', 'reporting']"},
        {"id": "own", "op": "admit", "expr": "row.c_mktsegment == ctx.tenant || 'admin' in ctx.roles"},
    ],
}
_ORDERS = {"contract": "sales_orders", "binding": {"parquet": "orders.parquet"}, "expose": [{"name": n} for n in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")], "rules": [{"id": "final", "op": "assert", "expr": "row.o_orderstatus == 'F' || row.o_totalprice > 1000.0", "on_fail": "drop"}]}
_LINES = {
    "contract": "lines",
    "binding": {"parquet": "lineitem.parquet"},
    "expose": [{"name": n} for n in ("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")],
    "rules": [
        {"id": "small_discount", "op": "assert", "expr": "row.l_discount <= 0.05", "on_fail": "drop"},
        {"id": "full", "op": "assert", "expr": "row.l_quantity >= 2.0", "on_fail": "report"},
    ],
}
_NATIONS = {"contract": "nations", "binding": {"parquet": "nation.parquet"}, "expose": [{"name": n} for n in ("n_nationkey", "n_name", "n_regionkey")]}
_VECTORS = {"contract": "vectors", "binding": {"parquet": "embeddings.parquet"}, "expose": [{"name": n} for n in ("vec_id", "embedding", "label")], "rules": []}


def _engine(spark: SparkSession, sf_dir: str, *docs: dict) -> Engine:
    engine = Engine(spark, sf_dir, now=dt.datetime(2024, 1, 1))
    for doc in docs:
        engine.register(doc)
    return engine


def _with(doc: dict, *extra: dict, **fields) -> dict:
    return {**doc, **fields, "rules": [*doc.get("rules", []), *extra]}


def _masked(expr: str):
    doc = _with(_CUSTOMERS, {"id": "mask", "op": "transform", "column": "c_name", "expr": expr})
    return lambda spark, sf: _engine(spark, sf, doc).query("SELECT c_custkey, c_name FROM customers", ADMIN)


def _sql(sql: str, *docs: dict, caller: dict = ADMIN):
    return lambda spark, sf: _engine(spark, sf, *docs).query(sql, caller)


def assert_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _engine(spark, sf, _LINES).statistics("lines", []).select("row_count", "small_discount_failures", "full_failures")


def validate_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _engine(spark, sf, _LINES).statistics("lines", ["l_quantity", "l_returnflag"]).drop("small_discount_failures", "full_failures")


def write_exclude(spark: SparkSession, sf: str) -> DataFrame:
    """Write all lines through their contract, with breaking rows set aside, and count both."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="pactspark-")
    doc = {**_LINES, "binding": {"parquet": "lines"}}
    engine = Engine(spark, f"{shared.rstrip('/').removeprefix('file://')}/{uuid.uuid4().hex}")
    engine.register(doc)
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    aside = engine.write("lines", lines, on_violation="exclude")["set_aside"]
    count = lambda df, kind: df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")).withColumn("kind", F.lit(kind))
    return count(engine.view("lines", ADMIN), "kept").unionByName(count(aside, "aside"))


def suppress_groups(spark: SparkSession, sf: str) -> DataFrame:
    doc = _with(_CUSTOMERS, {"id": "cells", "op": "shape", "operator": "suppress", "params": {"k": 12}})
    return _engine(spark, sf, doc).aggregate("customers", ADMIN, ["c_nationkey", "c_mktsegment"], {"n": ("count", "*"), "top": ("max", "c_acctbal")})


def suppress_whole(spark: SparkSession, sf: str) -> DataFrame:
    doc = _with(_CUSTOMERS, {"id": "cells", "op": "shape", "operator": "suppress", "params": {"k": 5}})
    return _engine(spark, sf, doc).query("SELECT c_custkey, c_name FROM customers WHERE c_custkey < 9", ADMIN)


def noise_row(spark: SparkSession, sf: str) -> DataFrame:
    doc = _with(_CUSTOMERS, {"id": "pay", "op": "shape", "operator": "noise", "params": {"at": "row", "column": "c_acctbal", "sensitivity": 100.0, "epsilon": 1.0, "budget": "pay"}})
    return _engine(spark, sf, doc).query("SELECT c_custkey, c_acctbal FROM customers", ADMIN)


def noise_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    doc = _with(_CUSTOMERS, {"id": "totals", "op": "shape", "operator": "noise", "params": {"column": "c_acctbal", "sensitivity": 1000.0, "epsilon": 0.5}})
    return _engine(spark, sf, doc).query("SELECT c_mktsegment, count(*) AS n, sum(c_acctbal) AS total FROM customers GROUP BY c_mktsegment", ADMIN)


def _suppressed(sql: str):
    doc = _with(_CUSTOMERS, {"id": "cells", "op": "shape", "operator": "suppress", "params": {"k": 12}})
    return lambda spark, sf: _engine(spark, sf, doc).query(sql, ADMIN)


#: Under a suppression of 12: what the caller sends, and what is due of the raw table.
_SUPPRESSED = {
    "union": ("SELECT c_nationkey AS k, count(*) AS n FROM customers GROUP BY c_nationkey UNION ALL SELECT -1, count(*) FROM customers WHERE c_custkey < 9", "SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) >= 12 UNION ALL SELECT -1, count(*) FROM customer WHERE c_custkey < 9 HAVING count(*) >= 12"),
    "subquery": ("SELECT c_custkey, (SELECT max(c_acctbal) FROM customers WHERE c_custkey < 9) AS few, (SELECT max(c_acctbal) FROM customers) AS all_ FROM customers", "SELECT c_custkey, NULL AS few, (SELECT max(c_acctbal) FROM customer) AS all_ FROM customer"),
    "rollup": ("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customers GROUP BY ROLLUP (c_mktsegment, c_nationkey)", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey) HAVING count(*) >= 12"),
    "distinct": ("SELECT DISTINCT c_nationkey, c_mktsegment FROM customers", "SELECT c_nationkey, c_mktsegment FROM customer GROUP BY ALL HAVING count(*) >= 12"),
    "edge": ("SELECT c_custkey < 13 AS few, count(*) AS n FROM customers WHERE c_custkey BETWEEN 1 AND 24 GROUP BY c_custkey < 13 UNION ALL SELECT true, count(*) FROM customers WHERE c_custkey BETWEEN 1 AND 11", "SELECT c_custkey < 13 AS few, count(*) AS n FROM customer WHERE c_custkey BETWEEN 1 AND 24 GROUP BY ALL HAVING count(*) >= 12 UNION ALL SELECT true, count(*) FROM customer WHERE c_custkey BETWEEN 1 AND 11 HAVING count(*) >= 12"),
}


def _searched(sql: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        engine = _engine(spark, sf, _VECTORS)
        width = len(spark.read.parquet(f"{sf}/embeddings.parquet").select("embedding").first()[0])
        return engine.query(sql.replace("PROBE", str((PROBE * (width // len(PROBE) + 1))[:width])), ADMIN)

    return run


def _written(spark: SparkSession, mode: str) -> Engine:
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="pactspark-")
    engine = Engine(spark, f"{shared.rstrip('/').removeprefix('file://')}/{uuid.uuid4().hex}")
    engine.register({**_LINES, "binding": {"parquet": "lines"}})
    return engine


def append_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Write one half, validate, append the other: the facts that followed."""
    engine, lines = _written(spark, "warn"), spark.read.parquet(f"{sf}/lineitem.parquet")
    engine.write("lines", lines.filter("l_orderkey % 2 = 0"), on_violation="warn")
    engine.validate("lines", ["l_quantity"])
    engine.write("lines", lines.filter("l_orderkey % 2 <> 0"), on_violation="warn")
    facts = engine.facts["lines"]
    row = (facts["row_count"], facts["assertions"]["small_discount"]["failures"], facts["l_quantity"]["min"], facts["l_quantity"]["max"])
    return spark.createDataFrame([row], "row_count long, failures long, low double, high double")


def write_warn_read(spark: SparkSession, sf: str) -> DataFrame:
    engine = _written(spark, "warn")
    engine.write("lines", spark.read.parquet(f"{sf}/lineitem.parquet"), on_violation="warn")
    return engine.query("SELECT l_returnflag, count(*) AS n FROM lines GROUP BY l_returnflag", ADMIN)


def excluded_counts(spark: SparkSession, sf: str) -> DataFrame:
    engine = _written(spark, "exclude")
    aside = engine.write("lines", spark.read.parquet(f"{sf}/lineitem.parquet"), on_violation="exclude")["set_aside"]
    return aside.select(F.explode("_violations").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def sample_key(spark: SparkSession, sf: str) -> DataFrame:
    doc = _with(_CUSTOMERS, {"id": "third", "op": "shape", "operator": "sample", "params": {"fraction": 0.3, "key": "c_custkey"}})
    return _engine(spark, sf, doc).query("SELECT c_custkey FROM customers", ADMIN)


def inherit_narrowed(spark: SparkSession, sf: str) -> DataFrame:
    child = {"contract": "rich", "inherits": "customers", "expose": [{"name": "c_custkey"}, {"name": "c_acctbal"}], "rules": [{"id": "rich", "op": "admit", "expr": "row.c_acctbal > 5000.0"}]}
    return _engine(spark, sf, _CUSTOMERS, child).query("SELECT * FROM rich", ANALYST)


def enrich_extension(spark: SparkSession, sf: str) -> DataFrame:
    doc = _with(_LINES, {"id": "worth", "op": "admit", "expr": "row.other.net > 40.0"}, enrich={"net": "row.l_quantity * (1.0 - row.l_discount)"})
    return _engine(spark, sf, doc).query("SELECT l_orderkey, l_linenumber FROM lines", ADMIN)


def _search(metric: str, doc: dict = _VECTORS):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        engine = _engine(spark, sf, doc)
        width = len(spark.read.parquet(f"{sf}/embeddings.parquet").select("embedding").first()[0])
        found = engine.vector_search("vectors", ADMIN, "embedding", (PROBE * (width // len(PROBE) + 1))[:width], 10, metric, "vec_id")
        return found.select("vec_id", F.round("distance", 6).alias("distance"))

    return run


_FILTERED = _with(_VECTORS, {"id": "even", "op": "admit", "expr": "row.label % 2 == 0"})
_JOIN = "SELECT c_custkey, n_name FROM customers {} JOIN nations ON c_nationkey = n_nationkey AND n_regionkey = 1"

#: Queries that a caller sends as they are: (Spark SQL, contracts, caller, the same over raw tables).
_PLAIN = {
    "admit_tenant": ("SELECT c_mktsegment, count(*) AS n FROM customers GROUP BY c_mktsegment", (_CUSTOMERS,), ANALYST, "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY c_mktsegment"),
    "admit_admin": ("SELECT c_mktsegment, count(*) AS n FROM customers GROUP BY c_mktsegment", (_CUSTOMERS,), ADMIN, "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment"),
    "admit_none": ("SELECT c_custkey FROM customers", (_CUSTOMERS,), {**ANALYST, "tenant": "nobody"}, "SELECT c_custkey FROM customer WHERE false"),
    "assert_drop": ("SELECT l_returnflag, l_linestatus, count(*) AS n, max(l_discount) AS most FROM lines GROUP BY l_returnflag, l_linestatus", (_LINES,), ADMIN, "SELECT l_returnflag, l_linestatus, count(*) AS n, max(l_discount) AS most FROM lineitem WHERE l_discount <= 0.05 GROUP BY ALL"),
    "join_left": (_JOIN.format("LEFT"), (_CUSTOMERS, _NATIONS), ADMIN, _JOIN.format("LEFT").replace("customers", "customer").replace("nations", "nation")),
    "join_inner": (_JOIN.format(""), (_CUSTOMERS, _NATIONS), ADMIN, _JOIN.format("").replace("customers", "customer").replace("nations", "nation")),
    "rollup_segment": ("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customers GROUP BY ROLLUP (c_mktsegment, c_nationkey)", (_CUSTOMERS,), ADMIN, "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)"),
    "window_rank": ("SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS r FROM customers", (_CUSTOMERS,), ADMIN, "SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS r FROM customer"),
    "topk": ("SELECT o_orderkey, o_totalprice FROM sales_orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", (_ORDERS,), ADMIN, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' OR o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20"),
    "union_distinct": ("SELECT c_nationkey AS k FROM customers UNION SELECT n_nationkey FROM nations", (_CUSTOMERS, _NATIONS), ADMIN, "SELECT c_nationkey AS k FROM customer UNION SELECT n_nationkey FROM nation"),
    "cte_having": ("WITH t AS (SELECT o_custkey, count(*) AS n FROM sales_orders GROUP BY o_custkey HAVING count(*) > 12) SELECT o_custkey, n FROM t", (_ORDERS,), ADMIN, "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' OR o_totalprice > 1000 GROUP BY o_custkey HAVING count(*) > 12"),
}

QUERIES = {
    **{n: _sql(sql, *docs, caller=caller) for n, (sql, docs, caller, _) in _PLAIN.items()},
    "mask_sha256": _masked("hash_sha256(row.c_name)"),
    "mask_partial": _masked("partial(row.c_name, 4)"),
    "mask_redact": _masked("redact(row.c_name)"),
    "mask_null": _masked("null"),
    "mask_ternary": _masked("row.c_acctbal < 0.0 ? row.c_name : string(row.c_nationkey)"),
    "vector_cosine": _search("cosine"),
    "vector_euclidean": _search("euclidean"),
    "vector_dot": _search("dot"),
    "vector_filtered": _search("euclidean", _FILTERED),
    **{f.__name__: f for f in (assert_counts, validate_stats, write_exclude, suppress_groups, suppress_whole, noise_row, noise_aggregate, sample_key, inherit_narrowed, enrich_extension, append_facts, write_warn_read, excluded_counts)},
    **{f"suppress_{n}": _suppressed(sql) for n, (sql, _) in _SUPPRESSED.items()},
    **{n: _sql(sql, *surface.DOCUMENTS) for n, sql in surface.SPARK_SQL.items()},
    "vector_sql": _searched("SELECT vec_id, round(distance, 6) AS distance FROM vector_search(vectors, embedding, PROBE, 10, 'euclidean')"),
    "vector_two_searches": _searched("SELECT a.vec_id FROM vector_search(vectors, embedding, PROBE, 10, 'euclidean') a JOIN vector_search(vectors, embedding, PROBE, 10, 'dot') b ON a.vec_id = b.vec_id"),
}


def _nearest(distance: str, where: str = "true") -> str:
    values = ", ".join(repr(x) for x in PROBE)
    probe = f"list_transform(range(len(embedding)), lambda i: ([{values}])[1 + i % {len(PROBE)}]::FLOAT::DOUBLE)"
    return f"WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v, {probe} AS q FROM embeddings WHERE {where}), d AS (SELECT vec_id, {distance} AS d FROM v) SELECT vec_id, round(d, 6) AS distance FROM d ORDER BY d, vec_id LIMIT 10"


_L2 = "sqrt(list_sum(list_transform(list_zip(v, q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"
ORACLE_SQL = {
    **{n: sql for n, (_, _, _, sql) in _PLAIN.items()},
    "mask_sha256": "SELECT c_custkey, sha256(c_name) AS c_name FROM customer",
    "mask_partial": "SELECT c_custkey, CASE WHEN length(c_name) <= 4 THEN '***' ELSE '***' || right(c_name, 4) END AS c_name FROM customer",
    "mask_redact": "SELECT c_custkey, CASE WHEN c_name IS NOT NULL THEN '***' END AS c_name FROM customer",
    "mask_null": "SELECT c_custkey, NULL AS c_name FROM customer",
    "mask_ternary": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_name ELSE c_nationkey::VARCHAR END AS c_name FROM customer",
    "vector_cosine": _nearest("1 - list_dot_product(v, q) / sqrt(list_dot_product(v, v) * list_dot_product(q, q))"),
    "vector_euclidean": _nearest(_L2),
    "vector_dot": _nearest("-list_dot_product(v, q)"),
    "vector_filtered": _nearest(_L2, "label % 2 = 0"),
    "assert_counts": "SELECT count(*) AS row_count, count(*) FILTER (NOT coalesce(l_discount <= 0.05, false)) AS small_discount_failures, count(*) FILTER (NOT coalesce(l_quantity >= 2, false)) AS full_failures FROM lineitem",
    "validate_stats": "SELECT count(*) AS row_count, " + ", ".join(f"count(*) FILTER ({n} IS NULL) AS {n}_null_count, min({n}) AS {n}_min, max({n}) AS {n}_max, count(DISTINCT {n}) AS {n}_distinct_count" for n in ("l_quantity", "l_returnflag")) + " FROM lineitem",
    "write_exclude": "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity, CASE WHEN l_discount <= 0.05 THEN 'kept' ELSE 'aside' END AS kind FROM lineitem GROUP BY ALL",
    "suppress_groups": "SELECT c_nationkey, c_mktsegment, count(*) AS n, max(c_acctbal) AS top FROM customer GROUP BY ALL HAVING count(*) >= 12",
    "suppress_whole": "SELECT c_custkey, c_name FROM customer WHERE c_custkey < 9 AND (SELECT count(*) FROM customer WHERE c_custkey < 9) >= 5",
    **{f"suppress_{n}": sql for n, (_, sql) in _SUPPRESSED.items()},
    **surface.DUCKDB_SQL,
    "vector_sql": _nearest(_L2),
    "vector_two_searches": f"SELECT a.vec_id FROM ({_nearest(_L2)}) a JOIN ({_nearest('-list_dot_product(v, q)')}) b ON a.vec_id = b.vec_id",
    "append_facts": "SELECT count(*) AS row_count, count(*) FILTER (NOT coalesce(l_discount <= 0.05, false)) AS failures, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem",
    "write_warn_read": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_discount <= 0.05 GROUP BY l_returnflag",
    "excluded_counts": "SELECT 'small_discount' AS rule, count(*) AS n FROM lineitem WHERE NOT coalesce(l_discount <= 0.05, false)",
    "sample_key": "SELECT c_custkey FROM customer WHERE ('0x' || substr(sha256(c_custkey::VARCHAR), 1, 8))::BIGINT < 0.3 * 4294967296",
    "inherit_narrowed": "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000",
    "enrich_extension": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount <= 0.05 AND l_quantity * (1 - l_discount) > 40",
}
