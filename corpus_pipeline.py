"""The training-data pipeline: five stages over ``documents``, each one operator.

Every stage reads what its predecessor wrote and, but for the last, returns the
columns of ``documents``. Labels are read from the same folder. The session's
Arrow batches, file splits and decoded batches are made small, so that executors
keep their memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactspark.llm import pairwise_rank, quality_rules, scratch
from pactspark.llm.mixing import mix_sources
from pactspark.llm.near_dedup import near_duplicates
from pactspark.llm.packing import pack, pieces
from pactspark.llm.queries import VOCABULARY


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    scratch.small_tasks(spark)
    forest = quality_rules.fit_rules(docs, _labels(spark, sf_dir))
    return quality_rules.apply_rules(docs, forest, prefix="_rules_").filter("_rules_kept").select(docs.columns)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranker does not reject: those scored at or above its threshold.

    It learns from the whole table of documents: the rules leave hardly any bad ones to pair.
    """
    scratch.small_tasks(spark)
    ranker = pairwise_rank.fit_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), _labels(spark, sf_dir))
    if not ranker.weights.any():
        raise ValueError("no preference pairs: the labels need documents of both kinds")
    return pairwise_rank.apply_quality(docs, ranker, prefix="_rank_").filter("_rank_predicted = 1").select(docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that with the smallest id (null ids last).

    Rows are judged by a key of their own, so ids may repeat or be null. Rows
    without words stay, one for each id and every one without id.
    """
    scratch.small_tasks(spark)
    keyed = scratch.save(docs.withColumn("_near_row", F.monotonically_increasing_id()), "keyed")
    near = near_duplicates(keyed, id_col="_near_row", k=5, per_cent=80).withColumnRenamed("doc_id", "_near_row")
    worded = F.col("n_shingles") > 0
    alike = [F.when(worded, F.col("component_id")), F.when(~worded, F.col("doc_id")), F.when(~worded & F.col("doc_id").isNull(), F.col("_near_row"))]
    groups = keyed.select("_near_row", "doc_id").join(near, "_near_row").groupBy(*alike)
    first = groups.agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_near_row"))).alias("first")).select("first._near_row")
    return keyed.join(first, "_near_row", "left_semi").select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those it does not take are gone."""
    scratch.small_tasks(spark)
    mixed = mix_sources(docs, prefix="_mixed_").filter("_mixed_times > 0")
    return mixed.withColumn("_mixed_times", F.explode(F.sequence(F.lit(1), F.col("_mixed_times").cast("int")))).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row per piece, with its ids, its sequence and its place there."""
    scratch.small_tasks(spark)
    return pieces(pack(docs, *VOCABULARY))


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Learned stages and a tokenizer decide the rows, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
