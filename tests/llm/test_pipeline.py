import random

import corpus_pipeline
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pactspark.llm import scratch

SCHEMA = "doc_id long, text string"


@pytest.fixture()
def folder(spark, tmp_path):
    rng = random.Random(7)
    words = [f"word{i}" for i in range(400)]
    good = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(90, 140)))
    bad = lambda: "\n".join([f"BUY {rng.choice(words).upper()} NOW !!! |"] * rng.randrange(20, 30))
    docs = [(i, good() if i % 2 else bad()) for i in range(120)]
    docs += [(1000 + i, bad()) for i in range(10)] + [(2000 + i, good()) for i in range(10)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_the_ranker_rejects_bad_documents_that_pass_the_rules(spark, folder, monkeypatch):
    def without_labelled_bad(spark, docs, sf_dir):
        return docs.filter("doc_id >= 1000 or doc_id % 2 = 1")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("rules", without_labelled_bad), ("classifier", corpus_pipeline.quality_classifier_stage), ("last", lambda spark, docs, sf_dir: docs)])
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()}
    assert not {i for i in ids if 1000 <= i < 2000}
    assert len({i for i in ids if i >= 2000}) >= 8


def test_no_pairs_is_an_error(spark, folder, tmp_path):
    one = tmp_path / "one"
    spark.read.parquet(f"{folder}/documents.parquet").write.parquet(f"{one}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").filter("quality = 1").write.parquet(f"{one}/labels.parquet")
    with pytest.raises(ValueError, match="no preference pairs"):
        corpus_pipeline.quality_classifier_stage(spark, spark.read.parquet(f"{one}/documents.parquet"), str(one))


def test_near_dedup_judges_rows_with_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, a), (None, a), (None, c), (None, c), (3, ""), (3, ""), (None, "")]
    kept = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, a), (1, b), (None, c), (3, ""), (None, "")], key=str)


@pytest.mark.parametrize("stage", ["quality_rules", "quality_classifier", "near_dedup"])
def test_stages_hand_python_small_batches(spark, folder, stage):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    try:
        dict(corpus_pipeline.STAGES)[stage](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
        long = spark.range(5000, numPartitions=1).selectExpr("id as doc_id", "repeat('word ', 1000) as text")
        got = [r["n"] for r in long.mapInArrow(sizes, "n long").collect()]
        assert len(got) > 3 and max(got) < 2 * scratch.BATCH
    finally:
        spark.conf.unset(key)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_read_in_small_tasks(spark, folder, stage):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxBytesPerBatch")
    for key in keys:
        spark.conf.unset(key)
    try:
        docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "'a' as source")
        dict(corpus_pipeline.STAGES)[stage](spark, docs, folder)
        assert [int(spark.conf.get(key)) for key in keys] == [scratch.SPLIT, scratch.ROWS, scratch.BATCH]
        for key in keys:
            spark.conf.set(key, "100")
        scratch.small_tasks(spark)
        assert [spark.conf.get(key) for key in keys] == ["100"] * 3
    finally:
        for key in keys:
            spark.conf.unset(key)


def test_saved_tables_have_small_row_groups(spark):
    rows = spark.range(1200, numPartitions=1).selectExpr("id", "randstr(40000, 1) as noise")
    saved = scratch.save(rows, "rows")
    files = [pq.ParquetFile(name.removeprefix("file:").replace("///", "/")).metadata for name in saved.inputFiles()]
    groups = [f.row_group(i).total_byte_size for f in files for i in range(f.num_row_groups)]
    assert len(groups) > 1 and max(groups) < 2 * scratch.GROUP
    assert saved.count() == 1200
