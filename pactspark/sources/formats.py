"""Answers as bytes and as files."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable

import pyarrow as pa
import pyarrow.parquet as pq


def _arrow(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _parquet(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    pq.write_table(table, sink)
    return sink.getvalue().to_pybytes()


def _json_lines(table: pa.Table) -> bytes:
    """An object per row; null fields are left out."""
    rows = ({k: v for k, v in r.items() if v is not None} for r in table.to_pylist())
    return "".join(json.dumps(r, default=str) + "\n" for r in rows).encode()


FORMATS: dict[str, Callable[[pa.Table], bytes]] = {"arrow": _arrow, "parquet": _parquet, "jsonl": _json_lines}


def as_bytes(table: pa.Table, kind: str = "arrow") -> bytes:
    """``table`` as an Arrow file, a Parquet file or JSON lines; no batches give no bytes."""
    return FORMATS[kind](table) if table.to_batches() else b""


def write_file(path: str, body: bytes) -> None:
    """``path`` holds either what it held or all of ``body``, never a part."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, part = tempfile.mkstemp(dir=folder, prefix=".part-")
    try:
        with os.fdopen(handle, "wb") as out:
            out.write(body)
            out.flush()
            os.fsync(out.fileno())
        os.replace(part, path)
    except BaseException:
        os.unlink(part)
        raise
