"""Stream bodies to payload rows: server-sent events in both readings, and binary frames."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_sse(bodies: DataFrame) -> DataFrame:
    """stream_id, body -> stream_id, seq, data: every ``data:`` line, trimmed; other lines are skipped."""
    # outer, so that a body isn't made and split once more to see whether it has lines; none has no line that begins so
    lines = bodies.select("stream_id", F.posexplode_outer(F.split("body", "\n")).alias("seq", "line"))
    return lines.where(F.startswith("line", F.lit("data:"))).select("stream_id", "seq", F.btrim(F.substring("line", 6, 1 << 30), F.lit(" \t\r")).alias("data"))


def parse_sse_events(bodies: DataFrame) -> DataFrame:
    """stream_id, body -> stream_id, seq, data: the data lines of each event joined; blank lines end events."""
    events = bodies.select("stream_id", F.posexplode(F.split("body", "\r?\n\r?\n")).alias("seq", "event"))
    lines = F.filter(F.split("event", "\r?\n"), lambda x: F.startswith(x, F.lit("data:")))
    data = F.transform(lines, lambda x: F.regexp_replace(F.substring(x, 6, 1 << 30), "^ ", ""))
    return events.withColumn("lines", data).where(F.size("lines") > 0).select("stream_id", "seq", F.array_join("lines", "\n").alias("data"))


SMALLEST, LARGEST = 16, 16 << 20
#: Bytes of a header value by its type; 6 and 7 carry their length.
_WIDTHS = {0: 0, 1: 0, 2: 1, 3: 2, 4: 4, 5: 8, 8: 8, 9: 16}


def next_frame(body: bytes, at: int) -> tuple[int, dict[str, str] | None, str | None, str | None] | None:
    """(its end, headers, payload, error) of the frame that begins at a place; None if it isn't whole yet."""
    if len(body) - at < 12:
        return None
    total, head = struct.unpack_from(">II", body, at)
    if not SMALLEST <= total <= LARGEST or head > total - SMALLEST:
        return at, None, None, "the frame's length is out of bounds"
    if zlib.crc32(body[at : at + 8]) != struct.unpack_from(">I", body, at + 8)[0]:
        return at, None, None, "the frame's start doesn't match its checksum"
    if len(body) - at < total:
        return None
    inner = body[at + 12 : at + total - 4]
    if zlib.crc32(inner, zlib.crc32(body[at : at + 8])) != struct.unpack_from(">I", body, at + total - 4)[0]:
        return at, None, None, "the frame doesn't match its checksum"
    try:
        return at + total, _headers(inner[:head]), inner[head:].decode("utf-8", "replace"), None
    except (IndexError, KeyError, struct.error):
        return at, None, None, "a header can't be read"


def cut_off(rest: bytes) -> str:
    """What is wrong with a body that ends in part of a frame."""
    return "the frame's start is cut off" if len(rest) < 12 else "the frame is cut off"


def frames(body: bytes) -> Iterator[tuple[dict[str, str] | None, str | None, str | None]]:
    """(headers, payload, error) of each frame, up to the first bad one."""
    at = 0
    while at < len(body):
        found = next_frame(body, at)
        if found is None:
            yield None, None, cut_off(body[at:])
            return
        at, headers, payload, error = found
        yield headers, payload, error
        if error:
            return


def _headers(block: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at < len(block):
        size = block[at]
        name, kind = block[at + 1 : at + 1 + size].decode("utf-8", "replace"), block[at + 1 + size]
        at += 2 + size
        if kind in (6, 7):
            (width,) = struct.unpack_from(">H", block, at)
            at += 2
        else:
            width = _WIDTHS[kind]
        if at + width > len(block):
            raise IndexError
        if kind == 7 and width:
            out[name] = block[at : at + width].decode("utf-8", "replace")
        at += width
    return out


_KINDS = (pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string())


def _decoded(batches: Iterator[pa.RecordBatch], most_rows: int, most_chars: int) -> Iterator[pa.RecordBatch]:
    """The frames of all bodies, passed on as soon as there are so many frames or characters of them."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=["stream_id", "seq", "headers", "payload", "error"])

    for batch in batches:
        rows, held = [], 0
        for i, body in zip(batch.column("stream_id"), batch.column("body"), strict=True):
            for n, (h, p, e) in enumerate(frames(body.as_py() or b"")):
                rows.append((i.as_py(), n, list(h.items()) if h is not None else None, p, e))
                held += len(p or "")
                if len(rows) >= most_rows or held >= most_chars:
                    yield made(rows)
                    rows, held = [], 0
        if rows:
            yield made(rows)


def decode_event_frames(bodies: DataFrame, most_rows: int = 4096, most_chars: int = 4 << 20) -> DataFrame:
    """stream_id, body (binary) -> stream_id, seq, headers, payload, error; a stream ends with its first bad frame.

    A task holds one Arrow batch of bodies and so many decoded frames, or characters of theirs, at a time.
    """
    return bodies.select("stream_id", "body").mapInArrow(lambda batches: _decoded(batches, most_rows, most_chars), "stream_id bigint, seq bigint, headers map<string,string>, payload string, error string")
