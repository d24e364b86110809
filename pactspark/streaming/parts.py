"""Streams into contracts: each micro-batch is one governed write."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pactspark.plans.engine import Engine


def write_stream(engine: Engine, name: str, stream: DataFrame, checkpoint: str, on_violation: str = "refuse", caller: Mapping | None = None, once: bool = True) -> StreamingQuery:
    """Append a stream to a contract, batch by batch; ``refuse`` ends the stream at a batch with breaking rows.

    A batch that is tried again after a failure between its commit and the
    checkpoint's is written again: give rows an id if that matters.
    """

    def part(batch: DataFrame, number: int) -> None:
        engine.write(name, batch, "append", on_violation, caller)

    writer = stream.writeStream.foreachBatch(part).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
