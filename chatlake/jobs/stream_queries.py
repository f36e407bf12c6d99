"""Structured Streaming and batch runs over the given tables, and the same in DuckDB.

Streams read files of the tables, or of chunks made of them, run until nothing is left (availableNow, with
the last batch that timers and closing windows need) and write Parquet to the shared folder in append mode;
the query reads that. A row far in the future moves time on, so that all that silence closes is closed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.jobs import live
from chatlake.jobs.run_queries import LIMITS
from chatlake.jobs.run_queries import ORACLE_SQL as RUN_ORACLES
from chatlake.jobs.views import RUN_EVENTS, with_views
from chatlake.operators import batch as B
from chatlake.operators import streams as S
from chatlake.sources import streams as SRC
from chatlake.sources.shared import scratch_folder
from chatlake.streaming import events as E
from chatlake.streaming import responses as R

#: How far the row lies that moves time on.
FAR = "interval 10 years"


@contextmanager
def _state_settings(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state needs, and no more parts of state than there are cores."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.shuffle.partitions": str(min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)),
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _drained(stream: DataFrame) -> DataFrame:
    spark, at = stream.sparkSession, scratch_folder(stream.sparkSession, "stream")
    with _state_settings(spark):
        q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def _stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _stream(spark, sf_dir, "events")
    return spark.sql(RUN_EVENTS.replace("from events", "from {source}"), source=df).withColumn("ts", F.col("ts").cast("timestamp"))


def _ticked(events: DataFrame) -> DataFrame:
    """The events, and one of no kind that moves time on."""
    first = F.col("seq") == 0
    rows = events.withColumn("_at", F.explode(F.when(first, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    later = F.col("_at") == 1
    return rows.withColumns({"kind": F.when(~later, F.col("kind")), "ts": F.when(later, F.expr(f"ts + {FAR}")).otherwise(F.col("ts"))}).drop("_at")


def stream_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each payload of the chunked streams brings, lines and frames rejoined."""
    made = _drained(R.stream_deltas(R.stream_payloads(live.chunk_files(spark, sf_dir))))
    brought = ("content", "call_name", "args", "input_tokens", "output_tokens", "error")
    rows = made.withColumn("ends", F.coalesce("ends", F.lit(False))).where(F.col("ends") | F.coalesce(*(F.col(c).cast("string") for c in brought)).isNotNull())
    return rows.select("stream_id", "seq", "content", "call_id", "call_name", "args", "input_tokens", "output_tokens", "ends", "error")


def assemble_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of the chunked streams: whole, broken off, failing, and with calls."""
    out = _drained(R.assemble_stream(R.stream_payloads(live.chunk_files(spark, sf_dir))))
    calls = F.array_join(F.transform("tool_calls", lambda c: F.concat_ws(" ", c["id"], c["name"], c["args"])), ";")
    return out.select("stream_id", "content", calls.alias("calls"), "input_tokens", "output_tokens", "error")


def assemble_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same streams as whole bodies in batch: missing ends, bad JSON, errors and calls of every provider."""
    path = scratch_folder(spark, "bodies")
    live.bodies(spark, sf_dir).select("stream_id", "provider", "body").write.partitionBy("provider").parquet(path)
    whole = spark.read.parquet(path)
    out = None
    for provider, assembled in (("openai", S.assemble_openai), ("anthropic", S.assemble_anthropic), ("gemini", S.assemble_gemini), ("bedrock", S.assemble_bedrock)):
        own = whole.where(F.col("provider") == provider)
        payloads = SRC.decode_event_frames(own) if provider == "bedrock" else SRC.parse_sse(own.select("stream_id", F.col("body").cast("string").alias("body")))
        rows = assembled(payloads)
        out = rows if out is None else out.unionByName(rows)
    calls = F.array_join(F.transform("tool_calls", lambda c: F.concat_ws(" ", c["id"], c["name"], c["args"])), ";")
    return out.select("stream_id", "content", calls.alias("calls"), "input_tokens", "output_tokens", "error")


def usage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _drained(E.usage_windows(_ticked(_events(spark, sf_dir)), "1 day"))
    return out.select(F.date_format("started", "yyyy-MM-dd").alias("day"), "tokens", "requests", "tool_calls")


def dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    twice = events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return _drained(E.dedup_events(twice.select("run_id", "seq", "ts", "kind"), "400 days")).select("run_id", "seq", "kind")


def usage_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run's first crossing, that of a last round by the silence after it."""
    return _drained(E.usage_guard(_ticked(_events(spark, sf_dir)), LIMITS, idle_ms=400 * 86_400_000))


def scripted(requests: list[list[dict]]) -> list[dict]:
    """A model by rule: it looks its prompt up once, then answers with what it found."""
    out = []
    for messages in requests:
        last = messages[-1]
        if last["role"] == "tool":
            out.append({"content": "found " + last["content"], "input_tokens": 2, "output_tokens": 1})
        else:
            out.append({"content": "", "tool_calls": [{"id": "c1", "name": "look", "args": json.dumps({"q": last["content"]})}], "input_tokens": 3, "output_tokens": 2})
    return out


def _look(args: str) -> str:
    q = json.loads(args)["q"]
    if q.endswith("7"):
        raise B.Rejected("no sevens")
    return q.upper()


def batch_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("run_id"), F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("prompt"))
    return B.batch_run(prompts, scripted, {"look": _look}).select("run_id", "output", "stage", "input_tokens", "output_tokens", "requests", "tool_calls")


class _Flaky:
    """Answers with the number of messages and the prompt; every third prompt fails once, every fifth always, every seventh for good."""

    def __init__(self):
        self.seen: set[str] = set()

    def __call__(self, requests: list[list[dict]]) -> list:
        out = []
        for messages in requests:
            prompt = messages[-1]["content"]
            n = int(prompt)
            if n % 7 == 0:
                out.append(ValueError("no such model"))
            elif n % 5 == 0 or (n % 3 == 0 and prompt not in self.seen):
                self.seen.add(prompt)
                out.append(B.Transient("busy"))
            else:
                out.append({"content": f"{len(messages)} {prompt}", "input_tokens": 2, "output_tokens": 1})
        return out


def _spare(requests: list[list[dict]]) -> list[dict]:
    if any(int(m[-1]["content"]) % 11 == 0 for m in requests):
        raise B.Transient("spare is busy")
    return [{"content": f"spare {m[-1]['content']}", "input_tokens": 4, "output_tokens": 2} for m in requests]


def _checked(text: str) -> str:
    if text.startswith("spare") and int(text.split()[1]) % 2 == 0:
        raise B.Rejected("even spare")
    return text


def batch_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with a history, a decoder that rejects, retries and a second model; one failing run fails alone."""
    history = F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content")), F.struct(F.lit("assistant").alias("role"), F.lit("hello").alias("content"))))
    prompts = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("run_id"), F.col("c_custkey").cast("string").alias("prompt"), F.when(F.col("c_custkey") % 2 == 1, history).alias("history"))
    out = B.batch_run(prompts, [_Flaky(), _spare], decoder=_checked, settings=B.Settings(model_retries=1))
    return out.select("run_id", "output", "stage", "error", "input_tokens", "output_tokens", "requests")


QUERIES = {"stream_deltas": stream_deltas, "assemble_stream": assemble_stream, "assemble_bodies": assemble_bodies, "usage_windows": usage_windows, "dedup_events": dedup_events, "usage_guard": usage_guard, "batch_run": batch_run, "batch_retries": batch_retries}

_E = with_views("v_run_events")
_S = "with s as (select conv_id * 1000 + turn as stream_id, coalesce(text, '') as text, cast(ceil(length(coalesce(text, '')) / 48.0) as bigint) as n, ['openai', 'anthropic', 'gemini', 'bedrock'][(conv_id * 1000 + turn) % 4 + 1] as provider, ((conv_id * 1000 + turn) // 4) % 4 as kind from conversations)"
#: provider, kind, payload after the text, call's id, name and arguments, tokens, end, error.
_TAIL = ", ".join(
    f"('{provider}', {kind}, {i}, {rest})"
    for provider, listed in {
        "openai": {0: {0: ["null, null, null, 3, 7, false, null"], 1: ["null, null, null, null, null, true, null"]}, 1: {0: ["null, null, null, 3, 7, false, null"]}, 2: {0: ["null, null, null, null, null, false, 'decode stream chunk'"], 1: ["null, null, null, null, null, true, null"]}, 3: {0: ["'c1', 'look', '{\"a\":', null, null, false, null", "'c3', 'put', '', null, null, false, null"], 1: ["null, null, '1}', null, null, false, null"], 2: ["null, null, null, 3, 7, false, null"], 3: ["null, null, null, null, null, true, null"]}},
        "anthropic": {0: {0: ["null, null, null, 3, 1, false, null"], 1: ["null, null, null, null, 7, false, null"], 2: ["null, null, null, null, null, true, null"]}, 1: {0: ["null, null, null, 3, 1, false, null"], 1: ["null, null, null, null, 7, false, null"]}, 2: {0: ["null, null, null, null, null, false, 'overloaded_error: busy'"], 1: ["null, null, null, null, null, true, null"]}, 3: {0: ["'c1', 'look', null, null, null, false, null"], 1: ["'c3', 'put', null, null, null, false, null"], 2: ["null, null, '{\"a\":', null, null, false, null"], 3: ["null, null, '1}', null, null, false, null"], 4: ["null, null, null, 3, 1, false, null"], 5: ["null, null, null, null, 7, false, null"], 6: ["null, null, null, null, null, true, null"]}},
        "gemini": {0: {0: ["null, null, null, 3, 7, false, null"]}, 1: {0: ["null, null, null, 3, 7, false, null"]}, 2: {0: ["null, null, null, null, null, false, 'decode stream chunk'"]}, 3: {0: ["null, 'look', '{\"a\":1}', null, null, false, null", "null, 'put', '{}', null, null, false, null"], 1: ["null, null, null, 3, 7, false, null"]}},
        "bedrock": {0: {0: ["null, null, null, null, null, true, null"], 1: ["null, null, null, 3, 7, false, null"]}, 2: {0: ["null, null, null, null, null, false, 'throttlingException: slow'"], 1: ["null, null, null, null, null, true, null"], 2: ["null, null, null, 3, 7, false, null"]}, 3: {0: ["'c1', 'look', null, null, null, false, null"], 1: ["'c3', 'put', null, null, null, false, null"], 2: ["null, null, '{\"a\":', null, null, false, null"], 3: ["null, null, '1}', null, null, false, null"], 4: ["null, null, null, null, null, true, null"], 5: ["null, null, null, 3, 7, false, null"]}},
    }.items()
    for kind, payloads in listed.items()
    for i, rows in payloads.items()
    for rest in rows
)
ORACLE_SQL = {
    "stream_deltas": f"""{_S}, tail(provider, kind, i, id, name, args, tin, tout, ends, error) as (values {_TAIL})
select stream_id, k as seq, substr(text, 48 * k + 1, 48) as content, cast(null as string) as call_id, cast(null as string) as call_name, cast(null as string) as args, cast(null as bigint) as input_tokens, cast(null as bigint) as output_tokens, false as ends, cast(null as string) as error
from (select *, unnest(range(n)) as k from s) union all select stream_id, n + i, null, id, name, args, tin, tout, ends, error from s join tail using (provider, kind)""",
    "assemble_stream": f"""{_S}, r as (select *, case when kind = 1 and provider <> 'gemini' then 'stream ended without its last event' when kind = 2 then case provider when 'anthropic' then 'overloaded_error: busy' when 'bedrock' then 'throttlingException: slow' else 'decode stream chunk' end end as error from s)
select stream_id, case when error is null then text end as content, case when error is null then case when kind <> 3 then '' when provider = 'openai' then 'c1 look {{"a":1}};  {{}};c3 put {{}}' when provider = 'gemini' then 'call-1 look {{"a":1}};call-2 put {{}}' else 'c1 look {{"a":1}};c3 put {{}}' end end as calls,
case when error is null then 3::bigint end as input_tokens, case when error is null then 7::bigint end as output_tokens, error from r""",
    "usage_windows": f"""{_E} select strftime(ts, '%Y-%m-%d') as day, cast(sum(case when kind = 'model_end' then input_tokens + output_tokens else 0 end) as bigint) as tokens, count(*) filter (kind = 'model_start') as requests, count(*) filter (kind = 'tool_start') as tool_calls from v_run_events group by 1""",
    "usage_guard": RUN_ORACLES["check_usage_limits"],
    "dedup_events": f"{_E} select run_id, seq, kind from v_run_events",
    "batch_run": """select c_custkey as run_id, '"found ' || case when c_custkey % 10 = 7 then 'Your tool call was rejected: no sevens. Correct the arguments and call the tool again.' else 'P' || c_custkey end || '"' as output, cast(null as string) as stage, 5::bigint as input_tokens, 3::bigint as output_tokens, 2::bigint as requests, 1::bigint as tool_calls from customer""",
    # 7: fails at once; 5: two attempts, then the spare model, which is busy for 11 and refused by the decoder for even ones; 3: a second attempt
    "batch_retries": """with c as (select c_custkey as k, case when c_custkey % 7 = 0 then 'bad' when c_custkey % 55 = 0 then 'busy' when c_custkey % 5 = 0 then 'spare' when c_custkey % 3 = 0 then 'again' else 'plain' end as way from customer)
select k as run_id, case way when 'spare' then case when k % 2 = 1 then '"spare ' || k || '"' end when 'again' then '"' || case when k % 2 = 1 then 3 else 1 end || ' ' || k || '"' when 'plain' then '"' || case when k % 2 = 1 then 3 else 1 end || ' ' || k || '"' end as output,
case when way in ('bad', 'busy') then 'model' when way = 'spare' and k % 2 = 0 then 'decode' end as stage,
case when way = 'bad' then 'no such model' when way = 'busy' then 'model failed after 2 attempts: spare is busy' when way = 'spare' and k % 2 = 0 then 'even spare' end as error,
cast(case way when 'spare' then 4 when 'again' then 2 when 'plain' then 2 else 0 end as bigint) as input_tokens, cast(case way when 'spare' then 2 when 'again' then 1 when 'plain' then 1 else 0 end as bigint) as output_tokens,
cast(case way when 'busy' then 4 when 'spare' then 3 when 'again' then 2 else 1 end as bigint) as requests from c""",
}
ORACLE_SQL["assemble_bodies"] = ORACLE_SQL["assemble_stream"]
