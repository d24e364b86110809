"""Sharding by sampled splitters, law ``bytes``.

Records are ordered by (hash of the text, id), so equal texts stand together. A
size-weighted sample of keys gives quantile boundaries that cut this order into
many ranges; ranges that come out overfull are sampled again and subdivided.
Exact sums per range then place every record: its shard is the one in which the
middle of its bytes falls when all bytes are laid in a row.

Scale: the sample and the splitters are bounded by ``most_ranges`` whatever the
input (about 20 keys a range, 16 bytes each); only they and one row a range are
ever broadcast. Sorting happens within ranges, whose splitters contain the id,
so a text that a third of all rows share is spread over a third of the ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactspark.llm import scratch

_LOW = -(2**63)


def range_of(keys: np.ndarray, ids: np.ndarray, splits: np.ndarray) -> np.ndarray:
    """Number of splitters (rows of key, id, in order) at or below each (key, id)."""
    lo, hi = np.searchsorted(splits[:, 0], keys, "left"), np.searchsorted(splits[:, 0], keys, "right")
    out = lo.copy()
    tied = np.flatnonzero(lo < hi)
    for at in np.unique(lo[tied]):
        rows = tied[lo[tied] == at]
        out[rows] = at + np.searchsorted(splits[at : hi[rows[0]], 1], ids[rows], "right")
    return out


def _ranged(splits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = range_of(batch.column(3).to_numpy(), batch.column(4).to_numpy(), splits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], names=[*batch.schema.names, "part"])

    return run


def _quantiles(sample: list, cell: float) -> list[tuple[int, int]]:
    """Boundaries about every ``cell`` bytes from (key, id, weight) rows."""
    out, held = [], 0.0
    for key, own, weight in sorted(sample):
        held += weight
        if held >= cell and (not out or out[-1] < (key, own)):
            out.append((key, own))
            held = 0.0
    return out


def shard_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", ranges_per_shard: int = 8, rows_per_range: int = 100_000, most_ranges: int = 65_536, keys_per_range: int = 20) -> DataFrame:
    """One row per document: (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    size is the text's UTF-8 bytes (null: none) plus 16, the crc of a null text
    is that of an empty one, slots count from 0 in each shard without gaps.
    Null ids sort first; repeated rows get slots of their own. An empty table
    gives no rows. Shards differ by at most about their two border records; equal
    texts lie side by side, and a group of them that stands on a border is cut
    there, since this law evens out bytes. Other columns, whatever their names,
    are not read; of a very long text only numbers travel.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"))
    rows = scratch.save(rows.withColumn("own", F.coalesce("doc_id", F.lit(_LOW) + F.monotonically_increasing_id())), "keys")
    count, total, largest = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    ranges = min(most_ranges, max(shards * ranges_per_shard, -(-count // rows_per_range)))
    cell = max(1.0, total / ranges, largest)  # no range is cut finer than a record
    ranged_schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType())])

    def sample(of: DataFrame, step: float, salt: int) -> list:
        """Each record with a chance of size / step, by a hash of its key; a record of more than step always."""
        chance = F.pmod(F.xxhash64("key", "own", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
        return [tuple(r) for r in of.filter(chance < F.col("size") / step).select("key", "own", F.greatest(F.col("size").cast("double"), F.lit(step))).collect()]

    splits = _quantiles(sample(rows, cell / keys_per_range, 0), cell)
    for again in range(1, 17):
        parts = rows.mapInArrow(_ranged(np.array(splits, np.int64).reshape(-1, 2)), ranged_schema)
        full = parts.groupBy("part").agg(F.sum("size").alias("b"), F.count("*").alias("n")).filter((F.col("b") > 2 * cell) & (F.col("n") > 1)).select("part")
        if len(splits) >= 2 * most_ranges or full.isEmpty():
            break
        more = _quantiles(sample(parts.join(F.broadcast(full), "part"), cell / keys_per_range, again), cell / 2)
        if set(more) <= set(splits):
            break  # what is left is one key a range
        splits = sorted({*splits, *more})
    parts = rows.mapInArrow(_ranged(np.array(splits, np.int64).reshape(-1, 2)), ranged_schema)

    sums = parts.groupBy("part").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", F.coalesce(F.sum("b").over(ahead), F.lit(0)).alias("b0"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n0"))
    within = Window.partitionBy("part").orderBy("key", "own")
    upto = within.rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumns({"at": F.coalesce(F.sum("size").over(upto), F.lit(0)), "rank": F.row_number().over(within) - 1})
    placed = placed.join(F.broadcast(starts), "part")  # at most 2 * most_ranges rows
    middle = (2 * (F.col("b0") + F.col("at")) + F.col("size")) / (2.0 * max(total, 1))
    placed = placed.select("doc_id", "size", "text_crc32", F.least(F.lit(shards - 1), F.floor(middle * shards)).cast("int").alias("shard"), (F.col("n0") + F.col("rank")).alias("nth"))
    placed = scratch.save(placed, "placed")
    first = placed.groupBy("shard").agg(F.min("nth").alias("first"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("nth") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
