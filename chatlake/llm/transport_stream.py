"""Media columns as MPEG transport streams: written by ``mux``, read back by ``demux``.

``mux`` cuts a payload of 8-bit samples into access units, each in one elementary packet with a
presentation time, a random-access mark and a clock reference, and carries them in 188-byte packets
beside the program tables. ``demux`` knows nothing of that layout: it follows the association table
to the map tables, checks their checksums, checks every stream's continuity counters, drops
duplicates, reassembles the elementary packets and lists their timestamps and random-access points.

Both work on one value at a time with numpy over its packets; columns are mapped in Arrow batches
and never shuffled. Defined cases: null and empty payloads are 64 zero bytes after padding; a stream
with lost, repeated or damaged packets is reported in the counts rather than failing the job; bytes
after the last whole packet count as one sync error.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm.common import read

PACKET, SYNC, NULL_PID = 188, 0x47, 0x1FFF
PAT_PID, PMT_PID, ES_PID = 0, 0x1000, 0x100
PRIVATE_DATA, PRIVATE_STREAM = 0x06, 0xBD
CLOCK, SAMPLE_RATE, UNIT = 90_000, 8_000, 32_768
_TIME_MASK = (1 << 33) - 1


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ (0x04C11DB7 if c & 0x80000000 else 0)) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


@functools.lru_cache(4096)
def section_crc(data: bytes) -> int:
    """The checksum of a table section; over a section with its checksum it is 0."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + section_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10 | counter]) + b"\x00" + section).ljust(PACKET, b"\xff")


_PAT = _section(0x00, 1, b"\x00\x01" + (0xE000 | PMT_PID).to_bytes(2, "big"))
_PMT = _section(0x02, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")


def _stamp(mark: int, t: int) -> bytes:
    t &= _TIME_MASK
    return bytes([mark << 4 | t >> 29 & 0x0E | 1, t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, t << 1 & 0xFE | 1])


def _clock(t: int) -> bytes:
    return ((t & _TIME_MASK) << 15 | 0x3F << 9).to_bytes(6, "big")


def mux(payload: bytes, unit: int = UNIT, tables_every: int = 16) -> bytes:
    """A transport stream of one program with one stream of samples."""
    out, counter, tables = [], 0, 0
    for n, at in enumerate(range(0, max(len(payload), 1), unit)):
        if n % tables_every == 0:
            out += [_table_packet(PAT_PID, _PAT, tables & 15), _table_packet(PMT_PID, _PMT, tables & 15)]
            tables += 1
        data = payload[at : at + unit]
        t = at * CLOCK // SAMPLE_RATE
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(2, t) + data
        # the first packet: random access, clock; stuffing if all fits in it
        first = pes[: PACKET - 12]
        room = PACKET - 12 - len(first)
        out.append(bytes([SYNC, 0x40 | ES_PID >> 8, ES_PID & 0xFF, 0x30 | counter, 7 + room, 0x50]) + _clock(t) + b"\xff" * room + first)
        counter = counter + 1 & 15
        rest = pes[PACKET - 12 :]
        whole, left = divmod(len(rest), PACKET - 4)
        if whole:
            packets = np.empty((whole, PACKET), np.uint8)
            packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
            packets[:, 3] = 0x10 | np.arange(counter, counter + whole) & 15
            packets[:, 4:] = np.frombuffer(rest, np.uint8, whole * (PACKET - 4)).reshape(whole, PACKET - 4)
            out.append(packets.tobytes())
            counter = counter + whole & 15
        if left:
            stuffing = PACKET - 5 - left
            field_ = bytes([stuffing]) + (b"\x00" + b"\xff" * (stuffing - 1) if stuffing else b"")
            out.append(bytes([SYNC, ES_PID >> 8, ES_PID & 0xFF, 0x30 | counter]) + field_ + rest[whole * (PACKET - 4) :])
            counter = counter + 1 & 15
    return b"".join(out)


@dataclass
class Demuxed:
    payload: bytes = b""
    programs: int = 0
    streams: dict[int, int] = field(default_factory=dict)
    packets: int = 0
    units: int = 0
    timestamps: list[int] = field(default_factory=list)
    random_access: list[tuple[int, int]] = field(default_factory=list)
    sync_errors: int = 0
    crc_errors: int = 0
    continuity_errors: int = 0
    duplicates: int = 0


def _sections(data: bytes, starts: list[int]) -> Iterator[bytes]:
    """The table sections in the joined payloads of one PID; starts: where units begin."""
    for at, end in zip(starts, [*starts[1:], len(data)]):
        at += 1 + data[at] if at < end else 0
        while at + 3 <= end and data[at] != 0xFF:
            size = 3 + (int.from_bytes(data[at + 1 : at + 3], "big") & 0xFFF)
            yield data[at : at + size]
            at += size


def _time(data: bytes) -> int:
    return (data[0] >> 1 & 7) << 30 | data[1] << 22 | (data[2] >> 1) << 15 | data[3] << 7 | data[4] >> 1


def demux(media: bytes) -> Demuxed:
    """Reads a transport stream; the payload is that of all streams, by ascending PID."""
    out = Demuxed(sync_errors=int(len(media) % PACKET > 0))
    p = np.frombuffer(media, np.uint8, len(media) // PACKET * PACKET).reshape(-1, PACKET)
    out.packets = len(p)
    good = (p[:, 0] == SYNC) & (p[:, 1] < 0x80)
    if not good.all():
        out.sync_errors += int((~good).sum())
        p = p[good]
    pid = (p[:, 1] & 0x1F).astype(np.int32) << 8 | p[:, 2]
    unit_start = (p[:, 1] & 0x40) > 0
    has_field, has_data, counter = (p[:, 3] & 0x20) > 0, (p[:, 3] & 0x10) > 0, (p[:, 3] & 15).astype(np.int16)
    at = np.where(has_field, 5 + p[:, 4].astype(np.int16), 4)
    flags = np.where(has_field & (p[:, 4] > 0), p[:, 5], 0)

    def gathered(which: int) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Joined payloads, where units begin in them, and those packets' numbers."""
        mine = np.flatnonzero((pid == which) & has_data & (at < PACKET))
        step = np.diff(counter[mine]) & 15
        jump = (flags[mine[1:]] & 0x80) > 0
        again = (step == 0) & ~jump
        out.duplicates += int(again.sum())
        out.continuity_errors += int(((step != 1) & ~again & ~jump).sum())
        mine = mine[np.concatenate([[True], ~again])] if len(mine) else mine
        data = p[mine][np.arange(PACKET) >= at[mine, None]].tobytes()
        begins = np.concatenate([[0], np.cumsum(PACKET - at[mine].astype(np.int64))])[:-1]
        heads = np.flatnonzero(unit_start[mine])
        return data, begins[heads], mine[heads]

    maps = {}
    data, starts, _ = gathered(PAT_PID)
    for s in _sections(data, starts.tolist()):
        if section_crc(s):
            out.crc_errors += 1
            continue
        for i in range(8, len(s) - 4, 4):
            if number := int.from_bytes(s[i : i + 2], "big"):
                maps[number] = int.from_bytes(s[i + 2 : i + 4], "big") & 0x1FFF
    out.programs = len(maps)
    for map_pid in sorted(set(maps.values())):
        data, starts, _ = gathered(map_pid)
        for s in _sections(data, starts.tolist()):
            if section_crc(s):
                out.crc_errors += 1
                continue
            i = 12 + (int.from_bytes(s[10:12], "big") & 0xFFF)
            while i + 5 <= len(s) - 4:
                out.streams[int.from_bytes(s[i + 1 : i + 3], "big") & 0x1FFF] = s[i]
                i += 5 + (int.from_bytes(s[i + 3 : i + 5], "big") & 0xFFF)
    parts = []
    for stream in sorted(out.streams):
        data, starts, packets = gathered(stream)
        ends = [*starts[1:].tolist(), len(data)]
        for a, b, packet in zip(starts.tolist(), ends, packets.tolist()):
            unit = data[a:b]
            if unit[:3] != b"\x00\x00\x01" or len(unit) < 9:
                out.sync_errors += 1
                continue
            size = int.from_bytes(unit[4:6], "big")
            if size and len(unit) != 6 + size:
                out.sync_errors += 1
            out.units += 1
            time = _time(unit[9:14]) if unit[7] & 0x80 and len(unit) >= 14 else None
            if time is not None:
                out.timestamps.append(time)
            if flags[packet] & 0x40:
                out.random_access.append((packet, time if time is not None else -1))
            parts.append(unit[9 + unit[8] : 6 + size if size else None])
    out.payload = b"".join(parts)
    return out


def pad(data: bytes, multiple: int = 64) -> bytes:
    """Zero bytes up to a positive multiple."""
    return data.ljust(max(1, -(-len(data) // multiple)) * multiple, b"\x00")


def mux_column(df: DataFrame, key: list[str], payload: str, media: str = "media", multiple: int = 64) -> DataFrame:
    """The key columns and ``media`` (binary), the stream of each padded payload (string or binary)."""
    schema = df.select(*key, F.lit(None).cast("bigint").alias("n_bytes"), F.lit(None).cast("binary").alias(media)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                data = [x or b"" for x in part.column("payload").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in key), pa.array([len(x) for x in data], pa.int64()), pa.array([mux(pad(x, multiple)) for x in data], pa.binary())], names=[*key, "n_bytes", media])

    return df.select(*key, F.col(payload).cast("binary").alias("payload")).mapInArrow(run, schema)


DEMUXED = "payload binary, programs int, streams map<int,int>, packets bigint, units bigint, timestamps array<bigint>, random_access array<struct<packet:bigint,time:bigint>>, sync_errors bigint, crc_errors bigint, continuity_errors bigint, duplicates bigint"


def demux_column(df: DataFrame, media: str = "media") -> DataFrame:
    """Adds what ``demux`` finds in a binary column; null media is an empty stream."""
    extra = df.sparkSession.createDataFrame([], DEMUXED).schema
    names = [f.name for f in extra]
    kept = [c for c in df.columns if c not in names]
    kinds = [pa.binary(), pa.int32(), pa.map_(pa.int32(), pa.int32()), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.struct([("packet", pa.int64()), ("time", pa.int64())])), *[pa.int64()] * 4]

    def row(d: Demuxed) -> tuple:
        return d.payload, d.programs, list(d.streams.items()), d.packets, d.units, d.timestamps, [{"packet": a, "time": b} for a, b in d.random_access], d.sync_errors, d.crc_errors, d.continuity_errors, d.duplicates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = zip(*(row(demux(x or b"")) for x in part.column(media).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), *(pa.array(v, t) for v, t in zip(found, kinds, strict=True))], names=[*kept, *names])

    schema = df.select(*kept).schema
    for f in extra:
        schema = schema.add(f)
    return df.select(*kept).mapInArrow(run, schema)


def op3_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = mux_column(read(spark, sf_dir, "documents"), ["doc_id"], "text")
    found = demux_column(stored)
    return found.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.format_string(
            "programs=%d;streams=%s;packets=%d;units=%d;random_access=%d;first=%d;last=%d;errors=%d",
            "programs",
            F.array_join(F.transform(F.map_entries("streams"), lambda e: F.concat_ws(":", e["key"], e["value"])), ","),
            "packets",
            "units",
            F.size("random_access").cast("bigint"),
            F.coalesce(F.array_min("timestamps"), F.lit(-1)),
            F.coalesce(F.array_max("timestamps"), F.lit(-1)),
            F.col("sync_errors") + F.col("crc_errors") + F.col("continuity_errors"),
        ).alias("feature"),
    )
