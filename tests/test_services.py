import json
import os
import socket
import threading

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pactspark.__main__ import main
from pactspark.plans.engine import Engine
from pactspark.plans.signer import SigningError, SocketSigner
from pactspark.sources import formats
from pactspark.streaming.parts import write_stream

DOC = {"contract": "meters/reads", "owner": "acme", "binding": {"parquet": "reads"}, "expose": [{"name": "id"}, {"name": "kwh"}], "rules": [{"id": "pos", "op": "assert", "expr": "row.kwh >= 0.0", "on_fail": "drop"}]}
ANN = json.dumps({"id": "ann", "tenant": "acme"})


def test_commands_and_exit_codes(spark, tmp_path, capsys):
    (tmp_path / "doc.json").write_text(json.dumps(DOC))
    spark.range(5).select("id", (F.col("id") - 1).cast("double").alias("kwh")).write.parquet(f"{tmp_path}/rows")
    call = lambda *a, who=ANN: main(["--root", str(tmp_path), "--caller", who, *a])
    assert call("register", f"{tmp_path}/doc.json") == 0
    assert call("write", "meters/reads", f"{tmp_path}/rows") == 2
    assert call("write", "meters/reads", f"{tmp_path}/rows", "--on-violation", "exclude") == 0
    capsys.readouterr()
    assert call("query", 'SELECT count(*) AS n, max(kwh) AS top FROM "meters/reads"', "--format", "json") == 0
    assert json.loads(capsys.readouterr().out) == [{"n": 4, "top": 3.0}]
    for kind, read in (("arrow", lambda f: pa.ipc.open_file(f).read_all()), ("parquet", pq.read_table), ("jsonl", lambda f: pa.Table.from_pylist([json.loads(x) for x in open(f)]))):
        assert call("query", "SELECT id FROM meters_reads ORDER BY id", "--format", kind, "--out", f"{tmp_path}/answer") == 0
        assert read(f"{tmp_path}/answer").to_pylist() == [{"id": i} for i in range(1, 5)]
    assert call("query", "SELECT id FROM meters_reads", "--format", "arrow") == 1
    assert call("query", "SELECT 1 FROM meters_reads", who="{}") == 2
    assert call("query", "DROP TABLE x") == 2
    assert call("validate", "nothing") == 1
    assert call("validate", "meters/reads") == call("publish", "meters/reads", "public") == call("list", who="{}") == call("describe", "meters/reads") == call("check", "SELECT id FROM meters_reads") == call("budget") == 0


def test_a_stream_is_written_part_by_part(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    engine.register(DOC)
    for n in range(3):
        spark.range(10 * n, 10 * n + 10).select("id", F.col("id").cast("double").alias("kwh")).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, kwh double").option("maxFilesPerTrigger", 4).parquet(f"{tmp_path}/in")
    write_stream(engine, "meters/reads", stream, f"{tmp_path}/checkpoint").awaitTermination(120)
    assert engine.query("SELECT count(*) AS n FROM meters_reads", {"tenant": "acme"}).first()["n"] == 30


def test_no_answer_without_its_signature(spark, tmp_path):
    told, answers = [], [b'{"jws": "a.b.c"}\n', b'{"jws": "d.e.f"}\n', b'{"error": "no key"}\n', b'{"jws": ""}\n', b"[]\n", b"no json\n", b'{"jws": "cut']
    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        for answer in answers:
            end, _ = server.accept()
            with end, end.makefile("rb") as lines:
                told.append(json.loads(lines.readline()))
                end.sendall(answer)

    thread = threading.Thread(target=serve, daemon=True)
    thread.start()
    spark.range(3).select("id", F.lit(1.0).alias("kwh")).write.parquet(f"{tmp_path}/reads")
    engine = Engine(spark, str(tmp_path), signer=SocketSigner.tcp(*server.getsockname()))
    engine.register(DOC)
    sql, who = "SELECT id FROM meters_reads", {"tenant": "acme"}
    for jws in ("a.b.c", "d.e.f"):  # the second answer is the cache's, signed anew
        _, envelope = engine.query_with_envelope(sql, who)
        assert envelope.pop("signature") == jws and told[-1] == json.loads(json.dumps(envelope, default=str))
    for _ in answers[2:]:
        with pytest.raises(SigningError):
            engine.query_with_envelope(sql, who)
    thread.join(10)
    engine.signer = SocketSigner.tcp(*server.getsockname(), seconds=0.2)  # accepted, never answered
    with pytest.raises(SigningError, match="within 0.2 s"):
        engine.query_with_envelope(sql, who)
    server.close()
    engine.signer = SocketSigner.unix(f"{tmp_path}/nobody")
    with pytest.raises(SigningError, match="can't be reached"):
        engine.query_with_envelope(sql, who)


def test_bytes_of_answers_and_whole_files(tmp_path):
    table = pa.table({"a": [1, None], "b": ["x", "y"]})
    assert formats.as_bytes(table, "jsonl") == b'{"a": 1, "b": "x"}\n{"b": "y"}\n'
    assert pa.ipc.open_file(formats.as_bytes(table)).read_all() == table
    assert all(formats.as_bytes(pa.Table.from_batches([], table.schema), kind) == b"" for kind in formats.FORMATS)
    formats.write_file(f"{tmp_path}/f", b"old")
    with pytest.raises(TypeError):
        formats.write_file(f"{tmp_path}/f", "text")
    assert (tmp_path / "f").read_bytes() == b"old" and os.listdir(tmp_path) == ["f"]
