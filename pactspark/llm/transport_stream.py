"""MPEG transport streams as a media column.

A payload becomes one programme: a PAT and a PMT, then elementary packets of a
private stream, each of at most ``unit`` bytes with a presentation timestamp;
every ``gop``-th is a random-access point, before which the tables are repeated.
Reading parses the tables to find the streams, checks the continuity counters of
every PID, reassembles the elementary packets and lists timestamps and
random-access points, which are stored beside the bytes. One stream is held at a time; its transport packets are
handled as one array, not one by one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactspark.llm import scratch

# Fixed values of the transport stream format.
PACKET, SYNC, PAT_PID, PMT_PID, ES_PID, PRIVATE_TYPE, STREAM_ID = 188, 0x47, 0x0000, 0x1000, 0x0100, 0x06, 0xBD
CLOCK = 90_000


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table: int, key: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + key.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The PAT and PMT packets with counter 0."""
    pat = _section(0x00, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(0x02, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")
    wrap = lambda pid, s: np.frombuffer((bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + s).ljust(PACKET, b"\xff"), np.uint8)
    return wrap(PAT_PID, pat), wrap(PMT_PID, pmt)


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, (pts >> 14) & 0xFE | 1, (pts >> 7) & 0xFF, (pts << 1) & 0xFE | 1])


def _elementary(data: bytes, pts: int, random_access: bool) -> np.ndarray:
    """One elementary packet as transport packets, counters still 0."""
    body = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(pts) + data
    first = PACKET - 6  # header, adaptation length and flags
    count = 1 + max(0, -(-(len(body) - first) // (PACKET - 4)))
    out = np.full((count, PACKET), 0xFF, np.uint8)
    out[:, :4] = (SYNC, ES_PID >> 8, ES_PID & 0xFF, 0x10)
    flat = np.frombuffer(body, np.uint8)
    take = min(first, len(flat))
    pad = first - take
    out[0, 1] |= 0x40
    out[0, 3], out[0, 4], out[0, 5] = 0x30, 1 + pad, 0x40 if random_access else 0
    out[0, PACKET - take :] = flat[:take]
    rest = flat[take:]
    whole = len(rest) // (PACKET - 4)
    out[1 : 1 + whole, 4:] = rest[: whole * (PACKET - 4)].reshape(whole, PACKET - 4)
    if tail := len(rest) - whole * (PACKET - 4):
        pad = PACKET - 4 - tail  # an adaptation field of just that size
        out[-1, 3], out[-1, 4] = 0x30, pad - 1
        if pad > 1:
            out[-1, 5] = 0
        out[-1, PACKET - tail :] = rest[len(rest) - tail :]
    return out


def mux(payload: bytes, unit: int = 32 << 10, gop: int = 8, frame: int = CLOCK // 25) -> bytes:
    parts = []
    for n, at in enumerate(range(0, len(payload), unit)):
        key = n % gop == 0
        if key:
            parts += [t[None, :] for t in _tables()]
        parts.append(_elementary(payload[at : at + unit], (n * frame) & (1 << 33) - 1, key))
    out = np.concatenate(parts)
    pids = (out[:, 1] & 0x1F).astype(np.int32) << 8 | out[:, 2]
    for pid in np.unique(pids):
        at = pids == pid
        out[at, 3] |= (np.arange(at.sum()) & 15).astype(np.uint8)
    return out.tobytes()


def _sections(packets: np.ndarray) -> Iterator[bytes]:
    """The checked sections that the packets of one PID carry, over packet borders too."""
    held = b""
    for packet in packets:
        begin = 5 + int(packet[4]) if packet[3] & 0x20 else 4
        body = packet[begin:].tobytes()
        if packet[1] & 0x40:  # a pointer: up to there the old section goes on
            held, body = held + body[1 : 1 + body[0]], body[1 + body[0] :]
            yield from _cut(held)
            held = b""
        elif not held:
            continue
        held += body
    yield from _cut(held)


def _cut(raw: bytes) -> Iterator[bytes]:
    while len(raw) > 3 and raw[0] != 0xFF and len(raw) >= (size := 3 + (int.from_bytes(raw[1:3], "big") & 0xFFF)):
        if crc32_mpeg(raw[:size]):
            raise ValueError("a programme table fails its checksum")
        yield raw[:size]
        raw = raw[size:]


def _streams(packets: np.ndarray, pids: np.ndarray) -> list[int]:
    """The PIDs of all elementary streams, by the programme tables."""
    maps, out = [], []
    for section in _sections(packets[pids == PAT_PID]):
        for at in range(8, len(section) - 4, 4):
            if int.from_bytes(section[at : at + 2], "big"):  # programme 0 is the network's
                maps.append(int.from_bytes(section[at + 2 : at + 4], "big") & 0x1FFF)
    for pid in dict.fromkeys(maps):
        for section in _sections(packets[pids == pid]):
            at = 12 + (int.from_bytes(section[10:12], "big") & 0xFFF)
            while at + 5 <= len(section) - 4:
                out.append(int.from_bytes(section[at + 1 : at + 3], "big") & 0x1FFF)
                at += 5 + (int.from_bytes(section[at + 3 : at + 5], "big") & 0xFFF)
    if not out:
        raise ValueError("no programme table names a stream")
    return list(dict.fromkeys(out))


def _continuous(packets: np.ndarray, pid: int) -> np.ndarray:
    """Which packets of one PID bring something new; raises where its counter jumps.

    Packets without payload keep the counter; a packet may be sent twice.
    """
    full = (packets[:, 3] & 0x10) > 0
    at = np.flatnonzero(full)
    counters = packets[at, 3] & 15
    step = (counters[1:] - counters[:-1]) & 15
    again = np.concatenate([[False], (step == 0) & (packets[at[1:]] == packets[at[:-1]]).all(axis=1)])
    announced = np.concatenate([[False], ((packets[at[1:], 3] & 0x20) > 0) & (packets[at[1:], 4] > 0) & ((packets[at[1:], 5] & 0x80) > 0)])
    if (~again & ~announced & np.concatenate([[False], step != 1])).any() or (again[1:] & again[:-1]).any():
        raise ValueError(f"PID {pid}: the continuity counter jumps")
    out = np.zeros(len(packets), bool)
    out[at[~again]] = True
    return out


def _elementary_packets(es: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, int | None, bool, bytes]]:
    """(transport packet, timestamp, random access, data) of each elementary packet of one stream."""
    adapts = (es[:, 3] & 0x20) > 0
    begin = np.where(adapts, 5 + es[:, 4].astype(np.int32), 4)
    body = es[np.arange(PACKET) >= begin[:, None]].tobytes()
    offsets = np.concatenate([[0], np.cumsum(PACKET - begin)])
    starts = np.flatnonzero(es[:, 1] & 0x40)
    for row, end in zip(starts, [*offsets[starts[1:]], offsets[-1]], strict=True):
        pes = body[offsets[row] : end]
        size = int.from_bytes(pes[4:6], "big")  # 0: up to the next one
        if pes[:3] != b"\x00\x00\x01" or size and size + 6 != len(pes):
            raise ValueError("an elementary packet is broken")
        stamp = None
        if pes[7] & 0x80:
            a, b, c, d, e = pes[9:14]
            stamp = (a >> 1 & 7) << 30 | b << 22 | c >> 1 << 15 | d << 7 | e >> 1
        yield int(places[row]), stamp, bool(adapts[row] and es[row, 4] and es[row, 5] & 0x40), pes[9 + pes[8] :]


def read_stream(stream: bytes) -> dict[int, list[tuple[int, int | None, bool, bytes]]]:
    """By elementary stream: (transport packet, timestamp, random access, data) of each elementary packet."""
    if not stream or len(stream) % PACKET:
        raise ValueError("not a whole number of transport packets")
    packets = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("a transport packet lacks its sync byte")
    pids = (packets[:, 1] & 0x1F).astype(np.int32) << 8 | packets[:, 2]
    places = np.arange(len(packets))
    new = np.zeros(len(packets), bool)
    for pid in np.unique(pids):
        if pid != 0x1FFF:  # null packets count nothing
            new[pids == pid] = _continuous(packets[pids == pid], int(pid))
    packets, pids, places = packets[new], pids[new], places[new]
    return {pid: list(_elementary_packets(packets[pids == pid], places[pids == pid])) for pid in _streams(packets, pids)}


def demux(stream: bytes) -> tuple[bytes, list[tuple[int, int | None, bool]]]:
    """The payload of all streams in turn, and (transport packet, timestamp, random access) of each elementary packet."""
    units = [u for units in read_stream(stream).values() for u in units]
    return b"".join(u[3] for u in units), [u[:3] for u in units]


MEDIA = "doc_id long, n_bytes long, media binary, points array<struct<packet: long, pts: long, random_access: boolean>>"
_POINTS = pa.list_(pa.struct([("packet", pa.int64()), ("pts", pa.int64()), ("random_access", pa.bool_())]))


def _write(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), _POINTS), strict=True)], names=["doc_id", "n_bytes", "media", "points"])
        rows, held = [], 0
        for batch in batches:
            for own, text in zip(batch.column(0), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "replace")
                media = mux(raw.ljust(max(block, -(-len(raw) // block) * block), b"\x00"))
                points = [dict(zip(("packet", "pts", "random_access"), p, strict=True)) for p in demux(media)[1]]
                rows.append((own.as_py(), len(raw), media, points))
                held += len(media)
                if held > 8 << 20:
                    yield give(rows)
                    rows, held = [], 0
        if rows:
            yield give(rows)

    return run


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for own, size, media, told in zip(*batch.columns, strict=True):
            stream = media.as_py()
            payload, points = demux(stream)
            if [tuple(p.values()) for p in told.as_py()] != points:
                raise ValueError("the stored points are not those of the stream")
            keys = [t for _, t, k in points if k]
            feature = f"packets={len(stream) // PACKET};units={len(points)};first_pts={points[0][1]};last_pts={points[-1][1]};random_access={len(keys)};last_access={keys[-1]}"
            rows.append((own.as_py(), size.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stream), hashlib.sha256(stream).hexdigest(), feature))
        columns = list(zip(*rows, strict=True)) or [[] for _ in types]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in FEATURES.split(", ")])


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 64) -> DataFrame:
    """The stored media column: (doc_id, n_bytes, media, points), read back from the shared folder.

    The payload is the text's UTF-8 (null: empty) with zero bytes up to a
    positive multiple of ``block``; points lists each elementary packet's place,
    timestamp and whether it is a random-access point, so that a reader can seek.
    Equal texts give equal streams; every row, null ids and repeated rows
    included, is stored. An empty table stays empty. Other columns, whatever their
    names, are not read. A very long text is one cell, held by one task.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return scratch.save(rows.mapInArrow(_write(block), MEDIA), "media")


def media_features(media: DataFrame) -> DataFrame:
    """What the stored streams hold, parsed from their bytes."""
    return media.mapInArrow(_features, FEATURES)
