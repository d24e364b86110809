"""Columns computed from whole texts, appended to all columns of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}


def with_text_columns(docs: DataFrame, text_col: str, fields: Sequence[tuple[str, str]], make: Callable[[], Callable[[list], list[Sequence]]]) -> DataFrame:
    """``docs`` with ``fields`` (name, type) computed from its texts, batch by batch, without a shuffle.

    ``make`` runs once a task and gives the function from texts (None for null)
    to one sequence a field. Columns of ``docs`` with a field's name give way.
    """
    names = {n for n, _ in fields}
    kept = docs.drop(*names)
    at = kept.columns.index(text_col)
    schema = T.StructType(list(kept.schema.fields))
    for name, kind in fields:
        schema = schema.add(name, T.DataType.fromDDL(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                made = of(batch.column(at).to_pylist())
                columns = [pa.array(x, _ARROW[kind]) for x, (_, kind) in zip(made, fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *(n for n, _ in fields)])

    return kept.mapInArrow(run, schema)
