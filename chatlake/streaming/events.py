"""Structured Streaming over run events: metering, deduplication, limits.

Each function takes a streaming (or batch) DataFrame and returns one; sources and sinks are the
caller's. Event time is ``ts`` (TIMESTAMP); rows later than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from chatlake.operators.runs import LIMITS
from chatlake.streaming.responses import Silent, rows_of


def usage_windows(events: DataFrame, width: str = "1 hour", slide: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """started, tokens, requests, tool_calls, runs of each window of event time."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", watermark).groupBy(window.alias("w")).agg(
        F.sum(F.when(F.col("kind") == "model_end", F.col("input_tokens") + F.col("output_tokens")).otherwise(0)).alias("tokens"),
        F.count_if(F.col("kind") == "model_start").alias("requests"),
        F.count_if(F.col("kind") == "tool_start").alias("tool_calls"),
        F.approx_count_distinct("run_id").alias("runs"),
    )
    return out.select(F.col("w.start").alias("started"), "tokens", "requests", "tool_calls", "runs")


def dedup_events(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Each (run_id, seq) once, however often the log delivers it within the watermark."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["run_id", "seq"])


_COUNTED = ("input_tokens", "output_tokens", "requests", "tool_calls")
_KINDS = ("model_start", "model_end", "tool_start", "tool_end", "output_rejected")


class _Guard(Silent):
    """State of a run: totals of its finished rounds and of the open one, and whether it has crossed a limit."""

    def __init__(self, gap_ms: int, limits: dict[str, int]):
        self.gap_ms, self.limits = gap_ms, limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", f"{', '.join(f'{c} bigint, open_{c} bigint' for c in _COUNTED)}, round bigint, crossed boolean, timer bigint")

    def _ended(self, key: tuple, now: dict) -> pd.DataFrame | None:
        """Adds the open round to the totals; the crossing, if this round is the first to cross a limit."""
        for c in _COUNTED:
            now[c] += now[f"open_{c}"]
            now[f"open_{c}"] = 0
        totals = {**now, "total_tokens": now["input_tokens"] + now["output_tokens"]}
        hit = next((c for c in LIMITS if 0 < self.limits.get(c, 0) < totals[c]), None)
        if now["crossed"] or hit is None:
            return None
        now["crossed"] = True
        return pd.DataFrame({"run_id": [key[0]], "round": [now["round"]], "crossed_kind": [hit], "limit": [self.limits[hit]], "actual": [totals[hit]]})

    def _fields(self) -> list[str]:
        return [x for c in _COUNTED for x in (c, f"open_{c}")] + ["round", "crossed", "timer"]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = rows_of(rows, ["seq"])
        batch = batch[batch["kind"].isin(_KINDS)]
        if not len(batch):
            return
        fields = self._fields()
        now = dict(zip(fields, self.head.get() if self.head.exists() else [0] * 9 + [False, None], strict=True))
        for kind, a, b in zip(batch["kind"], batch["input_tokens"], batch["output_tokens"], strict=True):
            if kind == "model_end":
                now["open_input_tokens"] += int(a)
                now["open_output_tokens"] += int(b)
            now["open_requests"] += kind == "model_start"
            now["open_tool_calls"] += kind == "tool_start"
            if kind == "output_rejected":
                if (hit := self._ended(key, now)) is not None:
                    yield hit
                now["round"] += 1
        now["timer"] = self.moved(now["timer"], max(int(batch["ms"].max()), timerValues.getCurrentWatermarkInMs()))
        self.head.update(tuple(now[f] for f in fields))

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = dict(zip(self._fields(), self.head.get(), strict=True))
        if (hit := self._ended(key, now)) is not None:
            yield hit
        self.head.clear()


def usage_guard(events: DataFrame, limits: dict[str, int], idle_ms: int = 3_600_000, watermark: str = "1 hour") -> DataFrame:
    """run_id, round, crossed_kind, limit, actual: each run's first crossing, once, as it happens.

    Totals are compared when a round ends: at output_rejected, and for a run's last round when the
    watermark passes its last event by ``idle_ms``; then the run's state goes. Events of other kinds
    move time on. Needs the RocksDB state store.
    """
    kind = dict(events.dtypes)["run_id"]
    slim = events.withWatermark("ts", watermark).select("run_id", "seq", "kind", "ts", F.unix_millis("ts").alias("ms"), F.coalesce("input_tokens", F.lit(0)).cast("bigint").alias("input_tokens"), F.coalesce("output_tokens", F.lit(0)).cast("bigint").alias("output_tokens"))
    return slim.groupBy("run_id").transformWithStateInPandas(_Guard(idle_ms, limits), f"run_id {kind}, round bigint, crossed_kind string, `limit` bigint, actual bigint", "Append", "EventTime")
