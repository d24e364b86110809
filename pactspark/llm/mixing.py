"""Mixing sources to target weights by capped water-filling.

A source's target is its weight's share of ``share`` times all words; sources
above ``epochs`` times their size are clamped there and the excess goes to the
others by weight, until none is above. The level is found from cumulative sums
over the sources ordered by cap / weight, which is the fixed point of clamping
and resharing. Each document is then taken ``floor(target / size)`` times, and
once more along a seeded order (an md5 of seed and id) while the source's rest
allows; one last document of the size nearest to what is still missing follows.

Scale: per document only (id, source, size, hash) is kept. Running sums go over
at most 65 536 hash buckets a source, and inside one bucket a source, so a
source with a third of all rows never meets in one task. Windows without keys
see one row a source. The decision is a cut per source, applied row by row; it is
broadcast only where Spark finds its table under the broadcast threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactspark.llm import scratch
from pactspark.llm.words import word_count


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.coalesce(F.md5(F.col(text_col)), F.lit(""))))))
    return docs.withColumns({"_mix_source": F.col(source_col), "_mix_size": word_count(F.col(text_col)), "_mix_hash": h, "_mix_id": F.col(id_col).cast("long")}).withColumn("_mix_bucket", F.conv(F.substring("_mix_hash", 1, 4), 16, 10).cast("int"))


def water_fill(sources: DataFrame, weights: Sequence[float], share: float, epochs: float) -> DataFrame:
    """Adds ``target`` to (_mix_source, source_size): weights by the sources' code-point order, null last."""
    by_name = Window.orderBy(F.col("_mix_source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    every = Window.partitionBy()
    w = sources.withColumn("w", weight).withColumn("cap", epochs * F.col("source_size"))
    w = w.withColumns({"total": share * F.sum("source_size").over(every), "all_w": F.sum("w").over(every)})
    upto = Window.orderBy(F.col("cap") / F.col("w"), F.col("_mix_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumns({"c": F.coalesce(F.sum("cap").over(upto), F.lit(0.0)), "u": F.coalesce(F.sum("w").over(upto), F.lit(0.0))})
    w = w.withColumn("clamped", (F.col("total") - F.col("c")) * F.col("w") > F.col("cap") * (F.col("all_w") - F.col("u")))
    w = w.withColumns({"c": F.coalesce(F.sum(F.when(F.col("clamped"), F.col("cap"))).over(every), F.lit(0.0)), "u": F.coalesce(F.sum(F.when(~F.col("clamped"), F.col("w"))).over(every), F.lit(1.0))})
    target = F.when(F.col("clamped"), F.col("cap")).otherwise(F.col("w") * (F.col("total") - F.col("c")) / F.col("u"))
    return w.select("_mix_source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, epochs: float = 2, seed: str = "mix-1", prefix: str = "") -> DataFrame:
    """``docs`` with (size, source_size, target, times, taken), each after ``prefix``, in place of columns of those names.

    size counts the words (null text: 0); times is how often the mix takes the
    document, taken is size * times and at most epochs * size. Null is a source
    of its own. Documents without words follow the whole repetitions only.
    Rows that repeat an id are decided alike; those without id are told apart by
    their texts. An empty table gives none. Only names that begin with
    ``_mix_`` are taken.
    """
    keyed = _keyed(docs, id_col, text_col, source_col, seed)
    sized = scratch.save(keyed.select("_mix_source", "_mix_id", "_mix_size", "_mix_hash", "_mix_bucket"), "sizes")
    sources = water_fill(sized.groupBy("_mix_source").agg(F.sum("_mix_size").alias("source_size")), weights, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = scratch.save(sources.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "sources")

    same = lambda a, b: a["_mix_source"].eqNullSafe(b["_mix_source"])
    buckets = sized.groupBy("_mix_source", "_mix_bucket").agg(F.sum("_mix_size").alias("n"))
    running = buckets.withColumn("before", F.sum("n").over(Window.partitionBy("_mix_source").orderBy("_mix_bucket")) - F.col("n"))
    edge = running.join(sources, same(running, sources)).drop(sources["_mix_source"]).filter("before <= rest and before + n > rest").select("_mix_source", "_mix_bucket", "before", "rest")
    edge = scratch.save(edge, "edges")
    inside = sized.join(edge, same(sized, edge) & (sized["_mix_bucket"] == edge["_mix_bucket"])).drop(edge["_mix_source"]).drop(edge["_mix_bucket"])
    inside = inside.withColumn("upto", F.col("before") + F.sum("_mix_size").over(Window.partitionBy("_mix_source").orderBy("_mix_hash", "_mix_id")))
    cuts = inside.groupBy("_mix_source").agg(
        F.max(F.when(F.col("upto") <= F.col("rest"), F.struct("_mix_hash", "_mix_id"))).alias("last"),
        F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto")).otherwise(F.col("before"))).alias("had"),
    )
    part = edge.select("_mix_source", F.col("_mix_bucket").alias("edge"))
    cuts = part.join(cuts, same(part, cuts), "left").drop(cuts["_mix_source"])
    plan = sources.join(cuts, same(sources, cuts), "left").drop(cuts["_mix_source"])
    plan = scratch.save(plan.withColumn("gap", F.when(F.col("edge").isNotNull(), F.col("rest") - F.col("had"))), "plan")

    def taken_once(at: str):
        """Whether a row lies before its source's cut; the plan's columns begin with ``at``."""
        last = F.coalesce(F.struct("_mix_hash", "_mix_id") <= F.col(f"{at}last"), F.lit(False))
        before = (F.col("_mix_bucket") < F.coalesce(f"{at}edge", F.lit(65536))) | ((F.col("_mix_bucket") == F.col(f"{at}edge")) & last)
        return F.when(F.col(f"{at}rest") > 0, before).otherwise(F.lit(False))

    misses = F.abs(F.col("_mix_size") - F.col("gap"))
    open_ = sized.join(plan, same(sized, plan)).drop(plan["_mix_source"]).filter(~taken_once("") & (F.col("_mix_size") > 0) & (misses < F.col("gap")))
    finish = open_.groupBy("_mix_source").agg(F.min(F.struct(misses.alias("misses"), "_mix_hash", "_mix_id")).alias("finish"))
    plan = scratch.save(plan.join(finish, same(plan, finish), "left").drop(finish["_mix_source"]), "plan").select(F.col("_mix_source").alias("_of"), "source_size", "target", "whole", "rest", "edge", "last", F.col("finish._mix_hash").alias("fh"), F.col("finish._mix_id").alias("fi"), F.col("finish").isNotNull().alias("finishes"))

    plan = plan.select(*(F.col(c).alias(f"_mix_{c}") for c in plan.columns))
    out = keyed.join(plan, F.col("_mix_source").eqNullSafe(F.col("_mix__of")))
    last_one = F.col("_mix_finishes") & (F.col("_mix_hash") == F.col("_mix_fh")) & F.col("_mix_id").eqNullSafe(F.col("_mix_fi"))
    times = F.col("_mix_whole") + (taken_once("_mix_") | last_one).cast("long")
    made = {"size": F.col("_mix_size"), "source_size": F.col("_mix_source_size"), "target": F.col("_mix_target"), "times": times, "taken": F.col("_mix_size") * times}
    made = {prefix + n: c for n, c in made.items()}
    return out.select(*(F.col(f"`{c}`") for c in docs.columns if c not in made), *(c.alias(n) for n, c in made.items()))
