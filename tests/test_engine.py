import pytest

from pactspark.plans.contract import ContractError
from pactspark.plans.engine import BudgetExceeded, Denied, Engine, GuaranteeFailed, NotFound, Violated
from pactspark.plans.guard import Refused

ACME, OTHER = {"id": "a", "tenant": "acme", "purpose": "analytics", "roles": []}, {"id": "b", "tenant": "globex", "purpose": "play", "roles": []}
DOC = {
    "contract": "sales/cells",
    "binding": {"parquet": "cells"},
    "expose": [{"name": "id"}, {"name": "amount"}],
    "rules": [
        {"id": "purpose", "op": "decide", "expr": "ctx.purpose == 'analytics'"},
        {"id": "positive", "op": "assert", "expr": "row.amount > 0", "on_fail": "drop"},
        {"id": "has_id", "op": "guarantee", "expr": "dataset.id.null_rate < 0.2", "on_fail": "deny"},
    ],
}


@pytest.fixture
def engine(spark, tmp_path):
    made = Engine(spark, str(tmp_path))
    made.register(DOC)
    return made


def rows(spark, *values):
    return spark.createDataFrame(list(values), "id long, amount long, secret string")


def test_write_modes_and_reading(spark, engine):
    data = rows(spark, (1, 10, "x"), (2, -1, "y"), (3, None, "z"))
    with pytest.raises(Violated):
        engine.write("sales/cells", data)
    result = engine.write("sales/cells", data, on_violation="exclude")
    assert (result["rows"], result["broken"], result["set_aside"].count()) == (3, 2, 2)
    engine.write("sales/cells", data, on_violation="warn")
    answer = engine.query("SELECT * FROM sales_cells", ACME)
    assert answer.columns == ["id", "amount"]
    assert [tuple(r) for r in answer.collect()] == [(1, 10), (1, 10)]
    assert engine.validate("sales/cells", ["id"])["assertions"]["positive"]["failures"] == 2


def test_refusals(spark, engine):
    engine.write("sales/cells", rows(spark, (1, 1, "x")))
    with pytest.raises(Denied):
        engine.query("SELECT * FROM sales_cells", OTHER)
    with pytest.raises(NotFound):
        engine.query("SELECT * FROM absent", ACME)
    for sql in ("DROP TABLE sales_cells", "INSERT INTO sales_cells VALUES (1, 2)", "SELECT 1; SELECT 2", "SET x = 1", "EXPLAIN SELECT 1", "SHOW TABLES", "CREATE VIEW v AS SELECT 1", "SELECT * FROM range(3)"):
        with pytest.raises((Refused, NotFound)):
            engine.query(sql, ACME)
    with pytest.raises(NotFound):
        engine.query(f"SELECT * FROM parquet.`{engine.base}/cells`", ACME)
    with pytest.raises(Exception, match="secret"):
        engine.query("SELECT secret FROM sales_cells", ACME).collect()


def test_a_hidden_table_in_a_subquery_is_refused(spark, engine):
    engine.write("sales/cells", rows(spark, (1, 1, "x")))
    rows(spark, (9, 9, "s")).createOrReplaceTempView("hidden")
    for sql in ("SELECT (SELECT max(id) FROM hidden) AS x FROM sales_cells", "SELECT * FROM sales_cells WHERE id IN (SELECT id FROM hidden)", "WITH t AS (SELECT * FROM hidden) SELECT * FROM t"):
        with pytest.raises(NotFound):
            engine.query(sql, ACME)


def test_a_with_name_cannot_hide_a_table(spark, engine):
    engine.write("sales/cells", rows(spark, (1, 1, "x")))
    rows(spark, (9, 9, "s")).createOrReplaceTempView("hidden")
    for sql in ("SELECT * FROM hidden, (SELECT 1 AS one) hidden", "SELECT * FROM hidden WHERE EXISTS (WITH hidden AS (SELECT 1) SELECT * FROM hidden)"):
        with pytest.raises((NotFound, Refused)):
            engine.query(sql, ACME)


def test_guarantee_that_denies(spark, engine):
    engine.write("sales/cells", rows(spark, (1, 1, "x"), (None, 2, "y")))
    engine.validate("sales/cells", ["id"])
    with pytest.raises(GuaranteeFailed):
        engine.query("SELECT * FROM sales_cells", ACME)


def test_suppression_edge_and_budget(spark, tmp_path):
    shape = {"id": "k", "op": "shape", "operator": "suppress", "params": {"k": 5}, "unless": "ctx.tenant == 'acme'"}
    noise = {"id": "n", "op": "shape", "operator": "noise", "params": {"column": "amount", "sensitivity": 1.0, "epsilon": 6.0}}
    engine = Engine(spark, str(tmp_path))
    frame = rows(spark, *((i, i, "x") for i in range(1, 10)))
    engine.register({**DOC, "contract": "c", "rules": [shape]}, frame)
    caller = {**OTHER, "tenant": "t"}
    assert engine.query("SELECT id FROM c WHERE id <= 5", caller).count() == 5
    assert engine.query("SELECT id FROM c WHERE id <= 4", caller).count() == 0
    assert engine.query("SELECT id FROM c WHERE id <= 4", ACME).count() == 4
    assert engine.query("SELECT count(*) AS n FROM c", caller).collect()[0]["n"] == 9
    assert engine.query("SELECT count(*) AS n FROM c WHERE id <= 4", caller).collect() == []
    assert [r[0] for r in engine.query("SELECT (SELECT sum(amount) FROM c WHERE id = 3) AS s FROM c", caller).collect()] == [None] * 9
    engine.register({**DOC, "contract": "m", "rules": [noise]}, frame)
    engine.aggregate("m", caller, [], {"total": ("sum", "amount")})
    with pytest.raises(BudgetExceeded):
        engine.aggregate("m", caller, [], {"total": ("sum", "amount")})
    with pytest.raises(Refused):
        engine.aggregate("m", caller, ["amount"], {"n": ("count", "*")})


def test_ownership_and_inheritance(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    engine.register({**DOC, "owner": "acme"}, rows(spark, (1, 1, "x")))
    assert engine.names(OTHER) == []
    engine.publish("sales/cells", "public")
    assert engine.names(OTHER) == ["sales/cells"]
    with pytest.raises(ContractError):
        engine.register({"contract": "child", "inherits": "sales/cells", "expose": [{"name": "secret"}]})


def test_vectors(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.8, 0.2]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0])], "id long, v array<float>")
    engine.register({"contract": "v", "expose": [{"name": "id"}, {"name": "v"}]}, frame)
    assert [r["id"] for r in engine.vector_search("v", ACME, "v", [1.0, 0.0], 9, "cosine").collect()] == [0, 1, 2]
    assert [r["id"] for r in engine.vector_search("v", ACME, "v", [1.0, 0.0], 4, "euclidean", "id").collect()] == [0, 1, 3, 2]
    with pytest.raises(ValueError):
        engine.vector_search("v", ACME, "v", [0.0, 0.0], 2, "cosine")
