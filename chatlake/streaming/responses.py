"""Responses as they stream in: network chunks to payloads, payloads to responses, by keyed state.

``stream_payloads`` rejoins what the network cut: lines and binary frames that end in a later chunk,
micro-batches apart. ``assemble_stream`` folds payloads into responses and emits each at its provider's own
end. Both work in append mode on ``transformWithStateInPandas``, so the query needs the RocksDB state store
(``spark.sql.streaming.stateStore.providerClass``); event time is ``ts``. What silence closes, timers of
event time close, and every stream's state is gone ``gap`` after its last row.

Rows that come twice, or after their stream was closed, are ignored; rows that come early wait for
those before them. A row with a null chunk or null fragments only moves time on.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chatlake.functions.json_text import is_json
from chatlake.functions.scalar import normalize_args
from chatlake.operators.streams import CALLS, SENTINELS, response_parts
from chatlake.sources.streams import cut_off, next_frame

#: Providers that stream binary frames; all others stream lines.
FRAMED = ("bedrock",)
#: Bytes of the longest line.
LONGEST = 1 << 20
OPEN, CLOSED = 0, 1


class Silent(StatefulProcessor):
    """A processor with one timer a key, ``gap_ms`` after its last row in event time."""

    gap_ms: int

    def moved(self, timer: int | None, last_ms: int) -> int:
        """Moves the key's timer on to the silence after a row; returns the timer."""
        due = last_ms + self.gap_ms
        if timer is not None and timer >= due:
            return timer
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(due)
        return due

    def close(self) -> None:
        pass


def rows_of(frames: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """A key's rows of one micro-batch in order."""
    return pd.concat(list(frames)).sort_values(order, kind="stable")


#: Groups of streams that share one value of state, fixed for a checkpoint's life.
BUCKETS = 512


class Bucketed(StatefulProcessor):
    """A processor of buckets of streams, each closed ``gap_ms`` after its last row in event time.

    State lies behind a socket, and a trip to it costs more than a stream's own work. So the streams of a
    bucket are one value, read and written once a micro-batch that has rows for it, and share one timer: the
    earliest that any of them was due when it was set. A timer that finds later rows is set anew.
    """

    gap_ms: int

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("streams", "timer bigint, streams binary")

    def close(self) -> None:
        pass

    def read(self, now: Any, rows: list[tuple], key: Any) -> Iterator[tuple]:
        """Output rows, without their time, of one stream's rows; changes the stream's state."""
        raise NotImplementedError

    def ended(self, now: Any, key: Any) -> Iterator[tuple]:
        """Output rows, without their time, of a stream that fell silent."""
        raise NotImplementedError

    def opened(self, provider: str) -> Any:
        """State of a new stream: an object with a slot ``due``."""
        raise NotImplementedError

    #: Columns that a stream's rows are sorted by and read with; columns that come out.
    order: list[str]
    taken: list[str]
    made: list[str]

    def _frame(self, found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(self.made, map(list, zip(*found, strict=True)), strict=True)))

    def _kept(self) -> tuple[int | None, dict]:
        timer, streams = self.held.get() if self.held.exists() else (None, None)
        return timer, pickle.loads(bytes(streams)) if streams is not None else {}

    def _keep(self, timer: int | None, streams: dict) -> None:
        if not streams:
            self.held.clear()
            return
        due = min(now.due for now in streams.values())
        if timer is not None and due < timer:
            self.handle.deleteTimer(timer)
            timer = None
        if timer is None:
            self.handle.registerTimer(due)
            timer = due
        self.held.update((timer, pickle.dumps(streams, pickle.HIGHEST_PROTOCOL)))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = rows_of(rows, ["stream_id", *self.order])
        batch = batch[batch[self.taken[0]].notna()]
        if not len(batch):
            return
        timer, streams = self._kept()
        watermark = timerValues.getCurrentWatermarkInMs()
        found: list[tuple] = []
        columns = [batch[c].astype(object).where(batch[c].notna(), None) for c in ("stream_id", "provider", "ts", *self.taken)]
        for stream, own in groupby(zip(*columns, strict=True), key=itemgetter(0)):
            own = list(own)
            now = streams.get(stream)
            if now is None:
                now = streams[stream] = self.opened(own[0][1])
            last = max(row[2] for row in own)
            now.due = max(now.due, watermark + self.gap_ms, int(pd.Timestamp(last).timestamp() * 1000) + self.gap_ms)
            found += [(stream, now.provider, *x, last) for x in self.read(now, [row[3:] for row in own], stream)]
        self._keep(timer, streams)
        if found:
            yield self._frame(found)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        _, streams = self._kept()
        reached = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        found: list[tuple] = []
        for stream, now in [x for x in streams.items() if x[1].due <= reached]:
            found += [(stream, now.provider, *x, pd.Timestamp(now.due, unit="ms", tz="UTC")) for x in self.ended(now, stream)]
            del streams[stream]
        self._keep(None, streams)
        if found:
            yield self._frame(found)


def bucketed(rows: DataFrame, buckets: int) -> GroupedData:
    """Rows that have a stream, grouped by its bucket."""
    return rows.where("stream_id is not null").withColumn("bucket", F.pmod(F.xxhash64("stream_id"), F.lit(buckets)).cast("int")).groupBy("bucket")


class _Unread:
    """State of a stream: the bytes of its last, unfinished line or frame, and chunks that came early."""

    def __init__(self, provider: str):
        self.provider, self.status, self.due = provider, OPEN, 0
        self.chunk = self.line = self.payload = 0
        self.rest = b""
        self.early: dict[int, tuple[bytes, bool]] = {}


class _Reader(Bucketed):
    order, taken = ["seq"], ["chunk", "seq", "last"]
    made = ["stream_id", "provider", "seq", "line", "data", "headers", "error", "ts"]

    def __init__(self, gap_ms: int, longest: int):
        self.gap_ms, self.longest, self.opened = gap_ms, longest, _Unread

    def _lines(self, rest: bytes, now: _Unread, last: bool) -> Iterator[tuple]:
        """(line, data, headers, error) of all lines that are complete, and of the rest at the end."""
        *lines, rest = rest.split(b"\n")
        for line in [*lines, rest] if last else lines:
            if len(line) > self.longest:
                break
            if line.startswith(b"data:"):
                yield now.line, line[5:].strip(b" \t\r").decode("utf-8", "replace"), None, None
            now.line += 1
        else:
            line = rest
        now.rest = b"" if last else rest
        if len(line) > self.longest:
            now.status = CLOSED
            yield now.line, None, None, f"a line is longer than {self.longest} bytes"

    def _frames(self, rest: bytes, now: _Unread, last: bool) -> Iterator[tuple]:
        at = 0
        while at < len(rest) and (found := next_frame(rest, at)) is not None:
            at, headers, payload, error = found
            yield now.line, payload, headers, error
            now.line += 1
            if error:
                now.status = CLOSED
                break
        now.rest = rest[at:] if now.status == OPEN else b""
        if last and now.rest:
            yield now.line, None, None, cut_off(now.rest)

    def _read(self, now: _Unread, body: bytes, last: bool) -> Iterator[tuple]:
        read = self._frames if now.provider in FRAMED else self._lines
        for line, data, headers, error in read(now.rest + body, now, last):
            yield now.payload, line, data, headers, error
            now.payload += 1
        if last:
            now.status = CLOSED
        if now.status == CLOSED:
            now.rest = b""

    def read(self, now: _Unread, rows: list[tuple], key: Any) -> Iterator[tuple]:
        for chunk, n, last in rows:
            if now.status == CLOSED or n < now.chunk:
                continue
            now.early[n] = bytes(chunk), bool(last)
            while now.status == OPEN and now.chunk in now.early:
                body, end = now.early.pop(now.chunk)
                yield from self._read(now, body, end)
                now.chunk += 1
        if now.status == CLOSED:
            now.early.clear()

    def ended(self, now: _Unread, key: Any) -> Iterator[tuple]:
        """The unfinished rest is read as the end, and chunks behind a lost one in their order."""
        if now.status == OPEN:
            yield from self._read(now, b"".join(body for _, (body, _) in sorted(now.early.items())), True)


_PAYLOAD = "stream_id {kind}, provider string, seq bigint, line bigint, data string, headers map<string,string>, error string, ts timestamp"


def stream_payloads(chunks: DataFrame, gap_ms: int = 600_000, watermark: str = "1 hour", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """stream_id, provider, seq, chunk (binary), last, ts -> stream_id, provider, seq, line, data, headers, error, ts.

    Chunks are numbered from 0 by ``seq``; ``last`` marks a stream's last one, where the network tells.
    Payloads are numbered anew; ``line`` is the number of their line or frame in the body, as
    ``parse_sse`` and ``decode_event_frames`` count. The state of a stream is at most one line or frame
    and the chunks that wait for an earlier one; the streams of a bucket are held as one value.
    """
    kind = dict(chunks.dtypes)["stream_id"]
    rows = chunks.select("stream_id", "provider", F.col("seq").cast("bigint").alias("seq"), "chunk", F.coalesce("last", F.lit(False)).alias("last"), "ts").withWatermark("ts", watermark)
    return bucketed(rows, buckets).transformWithStateInPandas(_Reader(gap_ms, longest), _PAYLOAD.format(kind=kind), "Append", "EventTime", eventTimeColumnName="ts")


def stream_deltas(payloads: DataFrame) -> DataFrame:
    """Payloads of any provider -> stream_id, provider, seq, ts and each payload's fragments, as they arrive."""
    rows = response_parts(payloads).select("stream_id", "provider", "seq", "ts", F.explode_outer("parts").alias("f"))
    return rows.select("stream_id", "provider", "seq", "ts", "f.*")


class Response:
    """What a stream has said so far, fragment by fragment."""

    def __init__(self, provider: str, calls: int = 0, most: int = -1, block: int | None = None, ended: bool = False, tokens: tuple = (None, None)):
        self.provider, self.calls, self.most, self.block, self.ended, self.tokens = provider, calls, most, block, ended, list(tokens)
        self.error: str | None = None
        self.texts: list[str] = []
        self.pieces: list[tuple[int, str]] = []
        self.names: dict[int, list[str]] = {}
        self.blocks: dict[int, int] = {}

    def take(self, fragments: Iterable[dict]) -> None:
        """One payload's fragments."""
        for f in fragments:
            self._take(f)
            if self.error is not None:
                return

    def _take(self, f: dict) -> None:
        key, block = f["call_key"], f["block"]
        if f["error"] is not None:
            self.error = f["error"]
            return
        if f["content"]:
            if block is not None:
                self.texts += ["\n"] if self.block not in (None, block) else []
                self.block = block
            self.texts.append(f["content"])
        call_id = f["call_id"]
        if f["is_start"]:
            key, self.calls = self.calls, self.calls + 1
            if block is None:
                call_id = f"call-{key + 1}"
            else:
                self.blocks[block] = key
        elif block is not None and f["args"] is not None:
            if block not in self.blocks:
                self.error = f"input fragment for block {block}, which is not a tool block"
                return
            key = self.blocks[block]
        if key is not None:
            self.most = max(self.most, key)
            own = self.names.setdefault(key, ["", ""])
            own[:] = call_id or own[0], f["call_name"] or own[1]
            if f["args"]:
                self.pieces.append((key, f["args"]))
        for i, c in enumerate(("input_tokens", "output_tokens")):
            if f[c] is not None:
                self.tokens[i] = f[c]
        self.ended = self.ended or bool(f["ends"])

    def over(self) -> bool:
        """Whether nothing more is to come: after an error or the provider's end, and usage that follows it."""
        if self.error is not None:
            return True
        return self.ended and (self.provider not in FRAMED or self.tokens[0] is not None)


_FRAGMENT_FIELDS = ("content", "block", "is_start", "call_key", "call_id", "call_name", "args", "input_tokens", "output_tokens", "ends", "error")


class _Unsaid:
    """State of a stream: its response so far, the number of the next payload, and payloads that came early."""

    def __init__(self, provider: str):
        self.provider, self.status, self.due = provider, OPEN, 0
        self.at = 0
        self.response: Response | None = Response(provider)
        self.early: dict[int, list[dict]] = {}


class _Assembler(Bucketed):
    order, taken = ["seq", "ord"], ["seq", *_FRAGMENT_FIELDS]
    made = ["stream_id", "provider", "content", "tool_calls", "input_tokens", "output_tokens", "error", "ts"]

    def __init__(self, gap_ms: int):
        self.gap_ms, self.opened = gap_ms, _Unsaid

    def _frame(self, found: list[tuple]) -> pd.DataFrame:
        return super()._frame(found).drop(columns="ts").astype({"input_tokens": "Int64", "output_tokens": "Int64"})

    def _answer(self, now: Response) -> tuple:
        if now.error is None and not now.ended and now.provider in SENTINELS:
            now.error = "stream ended without its last event"
        if now.error is not None:
            return None, None, None, None, now.error
        args: dict[int, list[str]] = {}
        for k, piece in now.pieces:
            args.setdefault(k, []).append(piece)
        calls = [dict(zip(("id", "name", "args"), (*now.names.get(k, ("", "")), "".join(args.get(k, ()))), strict=True)) for k in range(now.most + 1)]
        return "".join(now.texts), calls, *(t or 0 for t in now.tokens), None

    def read(self, now: _Unsaid, rows: list[tuple], key: Any) -> Iterator[tuple]:
        if now.status == CLOSED:
            return
        payloads: dict[int, list[dict]] = {}
        for n, *row in rows:
            if n >= now.at:
                payloads.setdefault(int(n), []).append({k: int(v) if isinstance(v, float) else v for k, v in zip(_FRAGMENT_FIELDS, row, strict=True)})
        now.early |= payloads
        while now.status == OPEN and now.at in now.early:
            now.response.take(now.early.pop(now.at))
            now.at += 1
            if now.response.over():
                now.status = CLOSED
        if now.status == CLOSED:
            yield self._answer(now.response)
            now.response = None
            now.early.clear()
        else:
            now.response.texts = ["".join(now.response.texts)]

    def ended(self, now: _Unsaid, key: Any) -> Iterator[tuple]:
        if now.status == OPEN:
            for _, own in sorted(now.early.items()):
                if not now.response.over():
                    now.response.take(own)
            yield self._answer(now.response)


_RESPONSE = "stream_id {kind}, provider string, content string, tool_calls " + CALLS + ", input_tokens bigint, output_tokens bigint, error string"


def assemble_stream(payloads: DataFrame, gap_ms: int = 600_000, buckets: int = BUCKETS) -> DataFrame:
    """Payloads (``stream_payloads``) -> stream_id, provider, content, tool_calls, input_tokens, output_tokens, error.

    A response is emitted when its provider's end, or an error, arrives; usage that follows a framed
    provider's end is waited for. Streams of providers without an end, and streams that break off, end by
    ``gap_ms`` of silence, the latter as errors. Payloads must be numbered from 0 and have a watermark on
    ``ts``. Equal to the batch functions of ``operators.streams`` on the same payloads.
    """
    kind = dict(payloads.dtypes)["stream_id"]
    fragments = stream_deltas(payloads).where("provider is not null").select("stream_id", "provider", "seq", "ord", "ts", *_FRAGMENT_FIELDS)
    made = bucketed(fragments, buckets).transformWithStateInPandas(_Assembler(gap_ms), _RESPONSE.format(kind=kind), "Append", "EventTime")
    calls = F.transform("tool_calls", lambda c: F.struct(c["id"].alias("id"), c["name"].alias("name"), normalize_args(c["args"]).alias("args")))
    made = made.withColumn("tool_calls", calls)
    wrong = (F.col("provider") == "anthropic") & F.exists("tool_calls", lambda c: ~is_json(c["args"]))
    made = made.withColumn("error", F.coalesce("error", F.when(wrong, "a tool's input is not valid JSON")))
    return made.select("stream_id", "provider", *(F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in ("content", "tool_calls", "input_tokens", "output_tokens")), "error")
