"""A user's model run over a table of prompts: the whole loop, batch by batch, inside each task.

``model`` takes a list of requests (each a list of messages) and returns a list of responses
``{"content", "tool_calls": [{"id", "name", "args"}], "input_tokens", "output_tokens"}``; it is called
once a batch and turn. ``tools`` maps names to functions of the arguments' JSON; they and ``decoder``
raise ``Rejected`` for what the model can correct. Nothing is shuffled or collected.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.functions.scalar import INTERRUPTED, RECORDED
from chatlake.operators.runs import LIMITS


class Rejected(Exception):
    """A correctable refusal; its text goes back to the model."""


class Transient(Exception):
    """A model's failure that another attempt, or the next model, may not have."""


@dataclass
class Settings:
    turns: int = 10
    tool_retries: dict[str, int] = field(default_factory=dict)
    default_retries: int = 1
    output_retries: int = 0
    #: Attempts of each model at one answer beyond the first.
    model_retries: int = 0
    output_tool: str | None = None
    limits: dict[str, int] = field(default_factory=dict)
    instructions: str = ""


class _Run:
    def __init__(self, run_id: int, prompt: str, instructions: str, history: str | None = None):
        self.run_id, self.output, self.stage, self.error = run_id, None, None, None
        before = json.loads(history) if history else []
        self.messages = ([{"role": "system", "content": instructions}] if instructions else []) + before + [{"role": "user", "content": prompt}]
        self.events: list[dict] = []
        self.used = dict.fromkeys(("input_tokens", "output_tokens", "requests", "tool_calls"), 0)
        self.turn, self.round, self.rejections, self.done = 0, 0, {}, False

    def event(self, kind: str, **more: object) -> None:
        self.events.append({"seq": len(self.events), "kind": kind, "turn": self.turn, "round": self.round, **more})

    def fail(self, stage: str, error: str) -> None:
        self.stage, self.error, self.done = stage, error, True

    def answer(self, call: dict, content: str) -> None:
        self.messages.append({"role": "tool", "content": content, "toolCallId": call["id"], "toolName": call["name"]})


def _take(run: _Run, response: dict, tools: dict[str, Callable[[str], str]], decoder: Callable[[str], object], s: Settings) -> None:
    calls = response.get("tool_calls") or []
    run.used["input_tokens"] += response.get("input_tokens") or 0
    run.used["output_tokens"] += response.get("output_tokens") or 0
    run.event("model_end")
    run.messages.append({"role": "assistant", "content": response.get("content") or "", **({"toolCalls": calls} if calls else {})})
    final = next((c for c in calls if c["name"] == s.output_tool), None) if s.output_tool else None
    if final or not calls:
        _finish(run, final, calls, decoder, s)
        return
    for c in calls:
        if c["name"] not in tools:
            run.fail("tool", f"{c['name']}: tool was not declared for this run")
            return
    results = []
    for c in calls:  # all of a response's calls run before any failure is judged
        run.used["tool_calls"] += 1
        run.event("tool_start", tool=c["name"])
        try:
            results.append((c, tools[c["name"]](c["args"]), None))
        except Exception as e:  # noqa: BLE001  a tool is the user's code; its failure is data
            results.append((c, None, e))
        run.event("tool_end", tool=c["name"])
    for c, text, e in results:
        name = c["name"]
        if e is None:
            run.answer(c, text)
        elif isinstance(e, Rejected) and run.rejections.get(name, 0) < s.tool_retries.get(name, s.default_retries):
            run.rejections[name] = run.rejections.get(name, 0) + 1
            run.answer(c, f"Your tool call was rejected: {e}. Correct the arguments and call the tool again.")
        else:
            n = run.rejections.get(name, 0)
            run.fail("tool", f"{name}: " + (f"tool failed after {n + 1} attempts: {e}" if n else str(e)))
            return
    run.turn += 1
    if run.turn >= s.turns:
        run.fail("loop", f"no final answer within {s.turns} turns")


def _finish(run: _Run, final: dict | None, calls: list[dict], decoder: Callable[[str], object], s: Settings) -> None:
    """A round's end: usage is checked, then the output decoded, and a rejection opens the next round."""
    for c in calls:
        if final and c is not final and c["id"] != final["id"]:
            run.answer(c, INTERRUPTED)
    total = run.used | {"total_tokens": run.used["input_tokens"] + run.used["output_tokens"]}
    for name in LIMITS:
        if 0 < s.limits.get(name, 0) < total[name]:
            run.fail("usage", f"{name} {total[name]} is over {s.limits[name]}")
            return
    try:
        value = decoder(final["args"] if final else run.messages[-1]["content"])
    except Rejected as e:
        if run.round >= s.output_retries:
            run.fail("decode", str(e))
            return
        run.event("output_rejected")
        if final:
            run.answer(final, f"Your result was rejected: {e}. Correct the arguments and call {s.output_tool} again.")
        else:
            run.messages.append({"role": "user", "content": f"Your previous response was rejected: {e}. Correct it and respond again."})
        run.round, run.turn, run.rejections = run.round + 1, 0, {}
        return
    if final:
        run.answer(final, RECORDED)
    run.output, run.done = json.dumps(value), True


RUNS = "run_id bigint, output string, stage string, error string, input_tokens bigint, output_tokens bigint, requests bigint, tool_calls bigint, messages string, events string"


def _answers(model: Callable, requests: list[list[dict]]) -> list:
    """One call for all requests; where it fails as a whole, a call for each, so that only its own run fails."""
    try:
        out = list(model(requests))
        if len(out) != len(requests):
            raise ValueError(f"the model gave {len(out)} answers to {len(requests)} requests")
    except Exception as e:  # noqa: BLE001  the model is the user's code; its failure is data
        return [e] if len(requests) == 1 else [_answers(model, [r])[0] for r in requests]
    return out


def _asked(runs: list[_Run], models: list[Callable], s: Settings) -> list[tuple[_Run, dict]]:
    """The answers of all runs that get one; transient failures are retried, then passed to the next model."""
    out, waiting, failures = [], list(runs), {}
    for model in models:
        for attempt in range(1, s.model_retries + 2):
            again = []
            for r in waiting:
                r.used["requests"] += 1
                r.event("model_start")
            for r, a in zip(waiting, _answers(model, [list(r.messages) for r in waiting]) if waiting else [], strict=True):
                if not isinstance(a, Exception):
                    out.append((r, a))
                elif isinstance(a, Transient):
                    failures[id(r)] = f"model failed after {attempt} attempts: {a}" if attempt > 1 else str(a)
                    again.append(r)
                else:
                    r.fail("model", str(a))
            waiting = again
    for r in waiting:
        r.fail("model", failures[id(r)])
    return out


def batch_run(prompts: DataFrame, model: Callable[[list[list[dict]]], list[dict]] | list[Callable], tools: dict[str, Callable[[str], str]] | None = None, decoder: Callable[[str], object] = str, settings: Settings | None = None, rows: int = 256) -> DataFrame:
    """run_id, prompt[, history] -> one row a run: output or stage and error, usage, messages and events as JSON.

    ``history``: the messages before the prompt, as a JSON array. ``model``: one function, or several in
    the order of fallback; an answer may be an exception, which fails its run alone.
    """
    tools, s = tools or {}, settings or Settings()
    models = model if isinstance(model, list) else [model]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                columns = (part.column(c).to_pylist() for c in ("run_id", "prompt", "history"))
                runs = [_Run(i, p or "", s.instructions, h) for i, p, h in zip(*columns, strict=True)]
                while open_ := [r for r in runs if not r.done]:
                    for r, a in _asked(open_, models, s):
                        _take(r, a, tools, decoder, s)
                out = [{"run_id": r.run_id, "output": r.output, "stage": r.stage, "error": r.error, **r.used, "messages": json.dumps(r.messages), "events": json.dumps(r.events)} for r in runs]
                names = [x.split()[0] for x in RUNS.split(", ")]
                kinds = [pa.string() if x.endswith("string") else pa.int64() for x in RUNS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([o[n] for o in out], k) for n, k in zip(names, kinds, strict=True)], names=names)

    history = F.col("history").cast("string") if "history" in prompts.columns else F.lit(None).cast("string")
    return prompts.select("run_id", "prompt", history.alias("history")).mapInArrow(run, RUNS)
