"""What a caller must not be able to do, and what an engine keeps."""

import threading

import pytest
from pyspark.sql import functions as F

from pactspark.plans import guard
from pactspark.plans.contract import ContractError
from pactspark.plans.engine import BudgetExceeded, Denied, Engine, GuaranteeFailed, NotWritten, Violated
from pactspark.plans.guard import Refused, Ungated
from pactspark.sources.store import Store

ANN, BOB = {"id": "ann", "tenant": "acme"}, {"id": "bob", "tenant": "globex"}
DOC = {"contract": "c", "expose": [{"name": "id"}, {"name": "amount"}], "rules": []}
SUPPRESS = {"id": "k", "op": "shape", "operator": "suppress", "params": {"k": 5}}
NOISE = {"id": "n", "op": "shape", "operator": "noise", "params": {"column": "amount", "sensitivity": 1.0, "epsilon": 4.0}}


def rows(spark, n=40):
    return spark.range(1, n + 1).select("id", (F.col("id") * 10).cast("double").alias("amount"))


def made(spark, tmp_path, *rules, **fields):
    engine = Engine(spark, str(tmp_path))
    engine.register({**DOC, "rules": list(rules), **fields}, rows(spark))
    return engine


@pytest.mark.parametrize("sql", [
    "SELECT sum(amount) AS id FROM c WHERE id = 3 UNION ALL SELECT id FROM c WHERE id > 900",
    "SELECT any_value(amount) AS v FROM c WHERE id = 3",
    "SELECT collect_list(amount)[0] AS v FROM c WHERE id = 3",
    "SELECT percentile(amount, 0.5) AS v FROM c WHERE id = 3",
    "SELECT v FROM (SELECT max(amount) AS v FROM c WHERE id = 3) WHERE v > 0",
])
def test_no_single_row_leaves_through_an_aggregate(spark, tmp_path, sql):
    assert made(spark, tmp_path, SUPPRESS).query(sql, ANN).collect() == []


@pytest.mark.parametrize("sql", [
    "SELECT reflect('java.lang.System', 'getProperty', 'user.dir') FROM c",
    "SELECT java_method('java.lang.System', 'setProperty', 'a', 'b') FROM c",
    "SELECT input_file_name() FROM c",
    "SELECT id FROM c WHERE raise_error('x') IS NULL",
    "SELECT (SELECT try_reflect('java.lang.System', 'getProperty', 'user.dir') AS y) AS x FROM c",
    "SELECT own(id) FROM c",
    "SELECT current_user() FROM c",
])
def test_functions_that_reach_outside_are_refused(spark, tmp_path, sql):
    spark.udf.register("own", lambda x: x)
    with pytest.raises(Refused):
        made(spark, tmp_path).query(sql, ANN)


def test_public_views_charge_or_refuse(spark, tmp_path):
    for shape in (SUPPRESS, NOISE):
        engine = made(spark, tmp_path, shape)
        with pytest.raises(Refused):
            engine.view("c", ANN)
        with pytest.raises(Refused):
            engine.vector_search("c", ANN, "amount", [1.0], 1, "dot")
    engine = made(spark, tmp_path, {**NOISE, "params": {**NOISE["params"], "at": "row"}})
    engine.view("c", ANN)
    engine.view("c", ANN)
    with pytest.raises(BudgetExceeded):
        engine.view("c", ANN)


@pytest.mark.parametrize("sql", ["SELECT amount FROM c", "SELECT id FROM c WHERE amount > 3", "SELECT amount, count(*) FROM c GROUP BY amount", "SELECT id FROM c ORDER BY amount", "SELECT max(amount) FROM c", "SELECT sum(amount) OVER () AS s FROM c", "WITH t AS (SELECT amount AS a FROM c) SELECT a FROM t", "SELECT id FROM c UNION ALL SELECT amount FROM c", "SELECT amount FROM c INTERSECT SELECT amount FROM c"])
def test_a_noised_column_leaves_through_aggregates_only(spark, tmp_path, sql):
    with pytest.raises(Refused):
        made(spark, tmp_path, NOISE).query(sql, ANN)


def test_aggregate_noise_in_sql_is_charged_once_a_query(spark, tmp_path):
    engine = made(spark, tmp_path, NOISE)
    got = engine.query("SELECT n, a, k FROM (SELECT count(amount) AS n, avg(amount) AS a, count(*) AS k FROM c)", ANN).first()
    assert got["k"] == 40 and got["a"] != 205.0 and abs(got["a"] - 205) < 40
    assert engine.query("SELECT count(*) AS n FROM c", ANN).first()["n"] == 40
    assert engine.budgets.spent == {("c", "acme/ann"): 4.0}


def test_caller_predicates_stay_above_the_gate_unless_they_cannot_fail(spark, tmp_path):
    engine = made(spark, tmp_path, {"id": "own", "op": "admit", "expr": "row.id != 7"})
    plan = engine.query("SELECT id FROM c WHERE 100 / (id - 7) < 50 AND id > 3", ANN)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("CollectMetrics gate:c")
    assert "100" in above and "100" not in below and "> 3" in below


def test_a_plan_past_its_gate_is_found(spark, tmp_path):
    rows(spark).write.parquet(f"{tmp_path}/raw")
    with pytest.raises(Ungated):
        guard.ensure_gated(spark.read.parquet(f"{tmp_path}/raw").filter("id > 1")._jdf.queryExecution().analyzed())


def test_the_sessions_own_views_stay_and_threads_do_not_mix(spark, tmp_path):
    rows(spark, 3).createOrReplaceTempView("c")
    engine = made(spark, tmp_path, {"id": "own", "op": "admit", "expr": "row.id <= ctx.upto"})
    got = {}
    each = [threading.Thread(target=lambda n=n: got.update({n: engine.query("SELECT count(*) AS n FROM c", {**ANN, "upto": n}).first()["n"]})) for n in range(1, 7)]
    [t.start() for t in each]
    [t.join() for t in each]
    assert got == {n: n for n in range(1, 7)} and spark.table("c").count() == 3
    spark.catalog.dropTempView("c")


def test_guarantees_and_violations_on_read(spark, tmp_path):
    engine = made(spark, tmp_path, {"id": "big", "op": "assert", "expr": "row.amount > 20.0", "on_fail": "drop"}, {"id": "many", "op": "guarantee", "expr": "dataset.row_count > 50", "on_fail": "annotate"}, {"id": "distinct", "op": "guarantee", "expr": "dataset.nothing.distinct_count > 3"})
    engine.validate("c")
    assert engine.query("SELECT id FROM c", ANN).count() == 38
    with pytest.raises(Violated, match="big fails for 2 rows"):
        engine.query("SELECT id FROM c", ANN, on_violation="refuse")
    table, about = engine.query_with_envelope("SELECT id FROM c WHERE id * 2 > 70", ANN)
    assert table.num_rows == about["rows"] == 5 and about["contracts"][0]["annotations"] == ["many"] and about["contracts"][0]["released"] == 38
    assert engine.query_with_envelope("SELECT id FROM c WHERE id * 2 > 70", ANN)[0] is table
    engine.register({**DOC, "version": 2, "rules": [{"id": "many", "op": "guarantee", "expr": "dataset.row_count > 50", "on_fail": "deny"}]}, rows(spark))
    with pytest.raises(GuaranteeFailed):
        engine.check("SELECT id FROM c", ANN)


def test_what_an_engine_keeps(spark, tmp_path):
    engine = Engine.open(spark, str(tmp_path))
    engine.register({**DOC, "owner": "acme", "binding": {"parquet": "cells", "partitioned_by": ["part"]}, "schema": {"id": "bigint", "amount": "double", "part": "string"}, "enrich": {"twice": "row.amount * 2.0"}, "rules": [{"id": "pos", "op": "assert", "expr": "row.other.twice > 20.0", "on_fail": "drop"}]})
    with pytest.raises(NotWritten):
        engine.query("SELECT id FROM c", ANN)
    with pytest.raises(Denied):
        engine.publish("c", "public")
        engine.write("c", rows(spark), caller=BOB)
    with pytest.raises(ContractError):
        engine.write("c", rows(spark), caller=ANN)
    frame = rows(spark).withColumn("part", F.concat(F.lit("0"), (F.col("id") % 3).cast("string"))).withColumn("more", F.lit(1))
    assert engine.write("c", frame, on_violation="exclude", caller=ANN)["set_aside"].count() == 1
    again = Engine.open(spark, str(tmp_path))
    assert again.query("SELECT count(*) AS n FROM c", BOB).first()["n"] == 39
    assert dict(again._view("c", ANN).dtypes) == {"id": "bigint", "amount": "double"} and {r["part"] for r in again.rows(again.contracts["c"]).select("part").distinct().collect()} == {"00", "01", "02"}
    again.unpublish("c", "public")
    assert again.names(BOB) == [] and again.names(ANN) == ["c"]
    with pytest.raises(ContractError):
        again.register({**DOC, "rules": []})
    Store(f"{tmp_path}/_engine").put("contracts", "old", {"engine": 0, "hash": "", "document": DOC})
    assert Engine.open(spark, str(tmp_path)).stale == ["old"]
    with pytest.raises(Violated):
        again.write("c", frame, caller=ANN)
    assert len(list((tmp_path / "_staging_cells").iterdir())) == 1  # what was set aside


def test_tenant_functions_are_owned_and_pinned(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    pin = engine.add_function("halved", "acme", lambda v: v / 2, lambda c: c / 2, "halved v1")
    rule = {"id": "h", "op": "transform", "column": "amount", "expr": "halved(row.amount)"}
    engine.register({**DOC, "owner": "acme", "functions": {"halved": pin}, "rules": [rule]}, rows(spark, 2))
    assert [r["amount"] for r in engine.query("SELECT amount FROM c", ANN).collect()] == [5.0, 10.0]
    with pytest.raises(ContractError):
        engine.register({**DOC, "contract": "d", "owner": "globex", "functions": {"halved": pin}, "rules": [rule]}, rows(spark, 2))
    with pytest.raises(ContractError):
        engine.add_function("halved", "globex", abs, F.abs, "other")
    engine.add_function("halved", "acme", abs, F.abs, "halved v2")
    with pytest.raises(ContractError):
        engine.query("SELECT amount FROM c", ANN)


def test_names(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    engine.register({**DOC, "contract": "a/b"}, rows(spark))
    with pytest.raises(ContractError):
        engine.register({**DOC, "contract": "a_b"}, rows(spark))
    assert engine.query('SELECT count(*) AS n FROM "a/b" WHERE id < 4', ANN).first()["n"] == 3
    with pytest.raises(Refused):
        engine.query("WITH a_b AS (SELECT 1 AS id) SELECT id FROM a_b", ANN)
