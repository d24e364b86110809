"""Bounded-space online packing of token sequences.

Each partition keeps at most ``open_windows`` unfinished windows. A document is
cut into whole windows and a rest; the rest goes to the open window that it
fills best, else to a new one, and where no more may be opened the fullest is
emitted first. Windows still open at the end of a partition are leftovers: those
of ``fan_in`` partitions meet, largest pieces first, in the same packer.

Scale: texts are tokenised once. A task holds the ids of its open windows, of the
document at hand and of at most ``_FLUSH`` closed windows. The leftovers that
meet are at most open_windows * fan_in windows; only their ids are shuffled.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactspark.llm import scratch

#: A window: its ids (little-endian, unsigned 32 bits), how many of them are no padding, and what stands where.
SEQUENCES = "sequence_id long, ids binary, tokens long, pieces array<struct<doc_id: long, start: long, length: long, doc_tokens: long, offset: long>>"
_PIECE = pa.struct([(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "offset")])
_FIELDS = pa.schema([("sequence_id", pa.int64()), ("ids", pa.binary()), ("tokens", pa.int64()), ("pieces", pa.list_(_PIECE)), ("final", pa.bool_()), ("task", pa.int32())])
#: Closed windows that a task holds before it hands them on.
_FLUSH = 2048
#: Beyond these characters the two libraries' Unicode tables might differ, so the reference tokenizer takes the text.
_UNCOMMON = re.compile("[^\t\n\r\x20-\x7e¡-ɏ‐-‧€]")


class Ids:
    """Ids of texts under a byte-level BPE in ``tokenizers`` format.

    Where a rank file of the same vocabulary is given, common texts are encoded
    with it (several times as fast, the same ids); special strings and uncommon
    characters always take the tokenizer itself.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.slow, self.fast = Tokenizer.from_file(tokenizer_path), None
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        if ranks_path and pattern:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def of(self, text: str) -> list[int]:
        if self.fast is None or _UNCOMMON.search(text) or any(s in text for s in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class OpenWindows:
    """Best fit over at most ``most`` open windows of ``width`` tokens.

    A window is [sequence_id, (doc_id, start, ids, doc_tokens)...], ids being bytes.
    """

    def __init__(self, width: int, most: int, first_id: int):
        self.width, self.most, self.next = width, most, first_id
        self.room = np.zeros(0, np.int64)
        self.open: list[list] = []

    def _fresh(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, piece: tuple) -> list[list]:
        """Place a piece; returns the windows that closed."""
        length = len(piece[2]) // 4
        if length == self.width:
            return [[self._fresh(), piece]]
        fits = np.where(self.room >= length, self.room, self.width + 1)
        at = int(fits.argmin()) if len(fits) else -1
        closed: list[list] = []
        if at < 0 or fits[at] > self.width:
            if len(self.open) >= self.most:
                closed = [self._pop(int(self.room.argmin()))]
            at = len(self.open)
            self.open.append([self._fresh()])
            self.room = np.append(self.room, self.width)
        self.open[at].append(piece)
        self.room[at] -= length
        return [*closed, self._pop(at)] if not self.room[at] else closed

    def _pop(self, at: int) -> list:
        self.room = np.delete(self.room, at)
        return self.open.pop(at)


def _batch(windows: list[list], width: int, pad: bytes, final: bool, task: int) -> pa.RecordBatch:
    ids, tokens, pieces = [], [], []
    for _, *rows in windows:
        at, placed = 0, []
        for own, start, part, doc_tokens in rows:
            placed.append((own, start, len(part) // 4, doc_tokens, at))
            at += len(part) // 4
        short = width - at if final and at & (at - 1) else 0
        ids.append(b"".join([*(r[2] for r in rows), pad * short]))
        tokens.append(at)
        pieces.append(placed)
    columns = [[w[0] for w in windows], ids, tokens, pieces, [final] * len(windows), [task] * len(windows)]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _FIELDS.types, strict=True)], schema=_FIELDS)


def _pack(width: int, most: int, end_id: int, pad: bytes, tokenizer: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        ids_of, windows = Ids(*tokenizer), OpenWindows(width, most, task << 32)
        closed: list[list] = []
        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*ids_of.of(text.as_py() or ""), end_id], "<u4")
                for start in range(0, len(ids), width):
                    closed += windows.add((own, start, ids[start : start + width].tobytes(), len(ids)))
                    if len(closed) >= _FLUSH:
                        yield _batch(closed, width, pad, True, task)
                        closed = []
        yield _batch(closed, width, pad, True, task)
        yield _batch(windows.open, width, pad, False, task)

    return run


def _merge(width: int, most: int, pad: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, windows, closed = None, None, []
        for batch in batches:
            for group, *piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != at:
                    closed += windows.open if windows else []
                    at, windows = group, OpenWindows(width, most, ((1 << 30) + group) << 32)
                closed += windows.add(tuple(piece))
                if len(closed) >= _FLUSH:
                    yield _batch(closed, width, pad, True, -1)
                    closed = []
        yield _batch([*closed, *(windows.open if windows else [])], width, pad, True, -1)

    return run


def pieces(sequences: DataFrame) -> DataFrame:
    """A row per piece of ``pack``'s sequences, read off their ids: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids)."""
    each = sequences.select("sequence_id", F.col("ids").alias("all"), F.explode("pieces").alias("p")).select("sequence_id", "p.*", F.expr("substring(all, int(p.offset * 4 + 1), int(p.length * 4))").alias("ids"))
    return each.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", width: int = 2048, end_id: int = 1, pad_id: int = 0, open_windows: int = 128, fan_in: int = 32) -> DataFrame:
    """A row per sequence: (sequence_id, ids, tokens, pieces), see ``SEQUENCES``.

    ids are padded with ``pad_id`` to ``width``, but where ``tokens``, the number
    of ids before the padding, is a power of two. A document's ids are its text's
    (null: empty) and ``end_id``, so every row of ``docs``, null ids and repeated
    rows included, gives at least one piece. Only documents longer than ``width``
    are cut; a very long text is tokenised by one task, which holds its ids. Other
    columns, whatever their names, are not read. An empty table gives no rows.
    """
    pad, kind = pad_id.to_bytes(4, "little"), f"{SEQUENCES}, final boolean, task int"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    packed = scratch.save(rows.mapInArrow(_pack(width, open_windows, end_id, pad, (tokenizer_path, ranks_path, pattern)), kind), "sequences")
    group = F.floor(F.col("task") / fan_in).cast("long").alias("grp")
    left = packed.filter("not final").select(group, F.col("ids").alias("all"), F.explode("pieces").alias("p"))
    left = left.select("grp", "p.doc_id", "p.start", F.expr("substring(all, int(p.offset * 4 + 1), int(p.length * 4))").alias("ids"), "p.doc_tokens")
    order = [F.col("grp"), F.octet_length("ids").desc(), F.col("doc_id"), F.col("start"), F.col("ids")]
    merged = left.repartition("grp").sortWithinPartitions(*order).mapInArrow(_merge(width, 2 * open_windows, pad), kind)
    return packed.filter("final").unionByName(merged).drop("final", "task")
