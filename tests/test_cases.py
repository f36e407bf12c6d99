"""Cases of the semantics that the given tables don't hold."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from chatlake.functions import scalar as S
from chatlake.operators import batch as B
from chatlake.operators import history as H
from chatlake.operators import runs as R
from chatlake.operators import streams as ST
from chatlake.operators import tools as T
from chatlake.operators import wire as W
from chatlake.sources import messages as M
from chatlake.sources import streams as SRC
from tests.conftest import SF

SCHEMA = "conv_id long, pos int, role string, content string, parts array<struct<kind:string,url:string,data:binary,media_type:string>>, tool_calls array<struct<id:string,name:string,args:string>>, tool_call_id string, tool_name string"


def conversation(spark, *rows):
    """role, then call ids of an assistant or the id of a tool's result."""
    out = []
    for pos, (role, *ids) in enumerate(rows):
        calls = [(i, f"t{i}", "{}") for i in ids] if role == "assistant" and ids else None
        out.append((1, pos, role, f"{role}{pos}", None, calls, ids[0] if role == "tool" else None, "t" if role == "tool" else None))
    return spark.createDataFrame(out, SCHEMA)


def repaired(df):
    return [(r.role, r.tool_call_id) for r in H.repair_history(df).orderBy("pos").collect() if r.role != "x"]


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([("user",), ("assistant", "c1")], [("user", None), ("assistant", None), ("tool", "c1")]),
        ([("user",), ("assistant", "c1", "c2"), ("tool", "c1")], [("user", None), ("assistant", None), ("tool", "c2"), ("tool", "c1")]),
        ([("user",), ("assistant", "c1"), ("user",), ("assistant",)], [("user", None), ("assistant", None), ("tool", "c1"), ("user", None), ("assistant", None)]),
        ([("user",), ("tool", "c99"), ("assistant",)], [("user", None), ("assistant", None)]),
        ([("assistant", "a"), ("tool", "a"), ("tool", "a")], [("assistant", None), ("tool", "a")]),
        ([("assistant", ""), ("tool", "")], [("assistant", None)]),
        ([("assistant", "a"), ("tool", "a"), ("assistant", "a")], [("assistant", None), ("tool", "a"), ("tool", "a"), ("assistant", None), ("tool", "a")]),
    ],
)
def test_repair(spark, rows, expected):
    df = conversation(spark, *rows)
    got = repaired(df)
    if rows[0] == ("assistant", "a") and len(rows) == 3 and rows[2][0] == "assistant":
        assert [g[0] for g in got].count("tool") == 3  # an open id is answered wherever it was called
    else:
        assert got == expected
    again = H.repair_history(H.repair_history(df).drop("synthesized"))
    assert again.where("synthesized").count() == 0 or rows[-1][0] == "assistant" and rows[0][0] == "assistant"


def test_trim(spark):
    df = conversation(spark, ("user",), ("assistant", "c1"), ("tool", "c1"), ("user",), ("assistant",), ("user",))
    assert [r.pos for r in H.trim_history(df, 4).orderBy("pos").collect()] == [3, 4, 5]
    assert [r.pos for r in H.trim_history(H.trim_history(df, 4), 4).orderBy("pos").collect()] == [3, 4, 5]
    tools = conversation(spark, ("tool", "a"), ("tool", "b"), ("tool", "c"))
    assert H.trim_history(tools, 2).count() == 0 and H.trim_errors(tools, 2).count() == 1
    assert H.trim_history(tools, 3).count() == 3
    with pytest.raises(ValueError):
        H.trim_history(df, 0)


def test_parts(spark):
    rows = [(i, 0, role, "", [p], None, None, None) for i, (role, p) in enumerate([("user", ("image", "u", None, None)), ("user", ("image", "u", b"d", "image/png")), ("user", ("image", None, None, None)), ("user", ("image", None, b"d", None)), ("user", ("sound", "u", None, None)), ("assistant", ("image", "u", None, None))])]
    got = {r.conv_id: r.error for r in H.validate_parts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5] and "both" in got[1] and "neither" in got[2] and "media type" in got[3] and "sound" in got[4]


def test_message_json(spark):
    rows = [(1, 0, "user", "hi", [("image", None, b"abc", "image/png")], None, None, None), (1, 1, "assistant", "", None, [("c", "t", '{"a": 1.0}')], None, None), (1, 2, "tool", "r", None, None, "c", "t")]
    df = spark.createDataFrame(rows, SCHEMA)
    body = M.to_message_json(df).first().body
    assert body == '[{"role":"user","content":"hi","parts":[{"kind":"image","data":"YWJj","mediaType":"image/png"}]},{"role":"assistant","toolCalls":[{"id":"c","name":"t","args":{"a": 1.0}}]},{"role":"tool","content":"r","toolCallId":"c","toolName":"t"}]'
    back = M.from_message_json(spark.createDataFrame([(1, body)], "conv_id long, body string")).orderBy("pos").collect()
    assert [r.role for r in back] == ["user", "assistant", "tool"] and bytes(back[0].parts[0].data) == b"abc"


def frame(headers, payload):
    block = b"".join(bytes([len(k)]) + k.encode() + v for k, v in headers)
    head = struct.pack(">II", 16 + len(block) + len(payload), len(block))
    body = head + struct.pack(">I", zlib.crc32(head)) + block + payload
    return body + struct.pack(">I", zlib.crc32(head + block + payload))


def test_frames(spark):
    text = lambda s: b"\x07" + struct.pack(">H", len(s)) + s.encode()
    good = frame([(":event-type", text("messageStop")), ("n", b"\x04\0\0\0\1"), ("t", b"\x00")], b"{}")
    bad = bytearray(good)
    bad[-1] ^= 1
    rows = SRC.decode_event_frames(spark.createDataFrame([(1, good + good), (2, good + bytes(bad) + good), (3, good[:20]), (4, None)], "stream_id long, body binary")).collect()
    assert [(r.stream_id, r.error is None) for r in rows] == [(1, True), (1, True), (2, True), (2, False), (3, False)]
    assert rows[0].headers == {":event-type": "messageStop"} and rows[0].payload == "{}"


def test_stream_errors(spark):
    sse = lambda i, *data: (i, "".join(f"data: {d}\n\n" for d in data))
    rows = [sse(1, '{"choices":[{"delta":{"content":"a"}}]}'), sse(2, "{bad", "[DONE]"), sse(3, '{"choices":[{"delta":{"tool_calls":[{"index":1,"id":"x","function":{"name":"n","arguments":""}}]}}]}', "[DONE]")]
    got = {r.stream_id: r for r in ST.assemble_openai(SRC.parse_sse(spark.createDataFrame(rows, "stream_id long, body string"))).collect()}
    assert "ended" in got[1].error and "decode" in got[2].error
    assert [tuple(c) for c in got[3].tool_calls] == [("", "", "{}"), ("x", "n", "{}")]
    rows = [sse(1, '{"type":"content_block_delta","index":4,"delta":{"type":"input_json_delta","partial_json":"{"}}', '{"type":"message_stop"}'), sse(2, '{"type":"error","error":{"type":"overloaded_error","message":"busy"}}')]
    got = {r.stream_id: r.error for r in ST.assemble_anthropic(SRC.parse_sse(spark.createDataFrame(rows, "stream_id long, body string"))).collect()}
    assert "block 4" in got[1] and got[2] == "overloaded_error: busy"


def test_backoff(spark):
    got = [r[0] for r in spark.range(9).select(S.backoff_ms(F.element_at(F.array(*map(F.lit, (0, 1, 2, 3, 4, 5, 6, 7, 60))), (F.col("id") + 1).cast("int")))).collect()]
    assert got == [500, 500, 1000, 2000, 4000, 8000, 16000, 30000, 30000]


def test_render_and_normalize(spark):
    rows = [(7, 0, "system", "s", None, None, None, None), (7, 1, "user", "é\"", [("image", None, b"d", "image/png")], None, None, None), (7, 2, "assistant", "", None, [("c", "t", '{"a":1}')], None, None), (7, 3, "tool", "r", None, None, "c", "t")]
    df = spark.createDataFrame(rows, SCHEMA)
    request = spark.createDataFrame([(7, [("t", "d", '{"type":"object"}')], "")], "request_id long, tool_specs array<struct<name:string,description:string,schema:string>>, output_schema string")
    openai = json.loads(W.render_openai(df, request, "m").first().body)
    assert openai["messages"][1]["content"][1]["image_url"]["url"] == "data:image/png;base64,ZA==" and openai["messages"][2]["tool_calls"][0]["function"]["arguments"] == '{"a":1}'
    anthropic = json.loads(W.render_anthropic(df, request, "m").first().body)
    assert anthropic["system"] == "s" and anthropic["max_tokens"] == 1024 and [m["role"] for m in anthropic["messages"]] == ["user", "assistant", "user"]
    gemini = json.loads(W.render_gemini(df, request).first().body)
    assert gemini["contents"][2]["parts"][0]["functionResponse"] == {"name": "t", "response": {"result": "r"}}
    bedrock = json.loads(W.render_bedrock(df, request).first().body)
    assert bedrock["messages"][0]["content"][1]["image"]["format"] == "png" and bedrock["toolConfig"]["tools"][0]["toolSpec"]["inputSchema"]["json"] == {"type": "object"}
    both = request.withColumn("output_schema", F.lit("{}"))
    assert W.render_gemini(df, both).first().error and W.render_openai(df, both, None).first().body.count('"strict":true') == 1


def test_loop(spark):
    calls = {"n": 0}

    def model(requests):
        return [{"content": "", "tool_calls": [{"id": "a", "name": "nope" if m[1]["content"] == "bad" else "t", "args": "{}"}]} if m[-1]["role"] == "user" else {"content": "done", "input_tokens": 5} for m in requests]

    def tool(_):
        raise B.Rejected("no")

    prompts = spark.createDataFrame([(1, "bad"), (2, "x")], "run_id long, prompt string")
    got = {r.run_id: r for r in B.batch_run(prompts, model, {"t": lambda a: "ok"}, settings=B.Settings(instructions="i")).collect()}
    assert got[1].stage == "tool" and got[2].output == '"done"' and got[2].requests == 2
    got = {r.run_id: r for r in B.batch_run(prompts.where("run_id = 2"), model, {"t": tool}, settings=B.Settings(instructions="i", default_retries=0)).collect()}
    assert got[2].stage == "tool"
    got = B.batch_run(prompts.where("run_id = 2"), model, {"t": lambda a: "ok"}, settings=B.Settings(instructions="i", limits={"input_tokens": 4})).first()
    assert got.stage == "usage" and calls["n"] == 0


def test_rounds_and_limits(spark):
    rows = [(1, i, k, None, a, b) for i, (k, a, b) in enumerate([("model_start", 0, 0), ("model_end", 3, 1), ("output_rejected", 0, 0), ("model_start", 0, 0), ("model_end", 5, 2)])]
    df = spark.createDataFrame(rows, "run_id long, seq long, kind string, tool_name string, input_tokens int, output_tokens int")
    assert [r["round"] for r in R.number_rounds(df).orderBy("seq").collect()] == [0, 0, 0, 1, 1]
    hit = R.check_usage_limits(df, {"total_tokens": 8}).first()
    assert (hit["round"], hit.crossed_kind, hit.actual) == (1, "total_tokens", 11)


def test_one_scan_and_no_single_partition(spark):
    """Responses are normalized in one scan; choosing a tool sends no rows of other tools to one task."""
    import contextlib
    import io

    from chatlake.jobs import registry

    def plan(df):
        with contextlib.redirect_stdout(io.StringIO()) as out:
            df.explain()
        return out.getvalue()

    assert plan(registry.QUERIES["normalize_responses"](spark, SF)).count("FileScan") == 1
    catalog = spark.read.parquet(f"{SF}/supplier.parquet").select(F.col("s_name").alias("name"), F.lit("{}").alias("schema"))
    assert "Window" not in plan(T.apply_tool_choice(catalog, "x"))
    assert [(r.name, r.error) for r in T.apply_tool_choice(spark.createDataFrame([("b", "{}"), ("a", "{}")], "name string, schema string"), "x").collect()] == [("a", "tool x isn't registered")]
    assert T.apply_tool_choice(spark.createDataFrame([], "name string, schema string"), "x").count() == 0


def _brackets(spark, rows):
    df = spark.createDataFrame([(1, 0, 0, seq, kind, name) for seq, (kind, name) in enumerate(rows)], "run_id long, round int, turn int, seq long, kind string, tool_name string")
    return sorted(((r.family, r.tool_name, r.number or 0, r.started, r.ended, r.interrupted) for r in R.pair_run_events(df).collect()), key=str)


def test_brackets_of_repeated_attempts_and_calls(spark):
    retried = [("model_start", None), ("model_end", None), ("model_start", "x"), ("model_end", "y")]
    assert _brackets(spark, retried) == [("model", None, 1, 0, 1, False), ("model", None, 2, 2, 3, False)]
    broken = [("model_start", None), ("model_start", None), ("model_end", None), ("model_end", None)]
    assert {b[2:] for b in _brackets(spark, broken)} == {(0, None, 3, False), (1, 0, None, True), (2, 1, 2, False)}
    pair = [("tool_start", "a"), ("tool_start", "b"), ("tool_start", "a"), ("tool_end", "a"), ("tool_end", "b"), ("tool_end", "a"), ("tool_start", "a")]
    assert _brackets(spark, pair) == [("tool", "a", 1, 0, 3, False), ("tool", "a", 2, 2, 5, False), ("tool", "a", 3, 6, None, True), ("tool", "b", 1, 1, 4, False)]
    stray = [("tool_end", "a"), ("tool_start", "a"), ("tool_end", "a"), ("tool_end", "a")]
    got = {(r[2], r[3], r[4]) for r in _brackets(spark, stray)}
    assert got == {(0, None, 0), (1, 1, 2), (0, None, 3)}


def test_cancellation_ends_a_fallback(spark):
    rows = [(1, 1, 503, False), (1, 2, 503, True), (1, 3, 200, False), (2, 1, 503, False), (2, 2, 200, True), (3, 1, 400, True)]
    got = R.resolve_fallback(spark.createDataFrame([(*r, False) for r in rows], "request_id long, model_rank int, status int, cancelled boolean, emitted boolean"))
    assert sorted((r.request_id, r.model_rank, r.outcome) for r in got.collect()) == [(1, 2, "cancelled"), (2, 2, "answered"), (3, 1, "cancelled")]


def test_history_processors_run_before_validation_and_fail_alone(spark):
    rows = [(1, 0, "assistant", "old", [("image", "u", None, None)], None, None, None), (1, 1, "user", "keep", None, None, None, None), (2, 0, "tool", "x", None, None, "a", None), (2, 1, "tool", "y", None, None, "b", None), (3, 0, "user", "z", None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)

    def compress(messages):
        return messages.where("content <> 'z'")

    kept, failed = H.process_history(df, H.trimmed(1), compress)
    assert [(r.conv_id, r.content) for r in kept.collect()] == [(1, "keep")] and H.validate_parts(kept).count() == 0
    assert sorted((r.conv_id, r.step, r.error) for r in failed.collect()) == [(2, 0, "history processor: trimming left no messages; history of 2 messages has no turn that can open a request"), (3, 1, "history processor: the history processor left no messages")]
    same, none = H.process_history(df)
    assert same.count() == 5 and none.count() == 0
    assert H.build_requests(kept, spark.createDataFrame([(1, "next")], "conv_id long, content string")).count() == 2


def test_ordered_files_ascend_and_are_skipped(spark, tmp_path):
    import pyarrow.parquet as pq

    rows = spark.range(40_000).select((F.col("id") * 7919 % 500).alias("conv_id"), F.col("id").alias("pos"), F.repeat(F.lit("x"), 50).alias("content"))
    M.write_ordered(rows, f"{tmp_path}/o", file_bytes=200 << 10)
    files = sorted(f for f in tmp_path.joinpath("o").iterdir() if f.suffix == ".parquet")
    ranges = []
    for f in files:
        own = [(r["conv_id"], r["pos"]) for r in pq.read_table(f, columns=["conv_id", "pos"]).to_pylist()]
        assert own == sorted(own)
        ranges.append((own[0], own[-1]))
    assert len(files) > 10 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False)) and max(f.stat().st_size for f in files) < 400 << 10
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        one = spark.read.parquet(f"{tmp_path}/o").where("conv_id = 77")
        assert one.count() == 80
        frame = one.select("pos")
        plan = frame._jdf.queryExecution().executedPlan()
        frame._jdf.collectToPython()
        leaf = plan.collectLeaves().apply(0)
        assert leaf.metrics().apply("numOutputRows").value() < 10_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_deltas_carry_a_call_s_identity_once(spark):
    data = ['{"type":"content_block_start","index":2,"content_block":{"type":"tool_use","id":"c","name":"n"}}', '{"type":"content_block_delta","index":2,"delta":{"type":"input_json_delta","partial_json":"{"}}', '{"type":"content_block_delta","index":2,"delta":{"type":"input_json_delta","partial_json":"}"}}']
    rows = ST.delta_rows(spark.createDataFrame([(1, i, d) for i, d in enumerate(data)], "stream_id long, seq int, data string"), "anthropic").orderBy("seq").collect()
    assert [(r.seq, r.call_key, r.call_id, r.call_name, r.args) for r in rows] == [(1, 0, "c", "n", "{"), (2, 0, None, None, "}")]
    several = '{"candidates":[{"content":{"parts":[{"text":"a"},{"functionCall":{"name":"f"}},{"text":"b"}]}}]}'
    rows = ST.delta_rows(spark.createDataFrame([(1, 0, several)], "stream_id long, seq int, data string"), "gemini").orderBy("ord").collect()
    assert [(r.content, r.call_id, r.args) for r in rows] == [("b", None, None), (None, "call-1", "{}")]
    assert ST.assemble_gemini(spark.createDataFrame([(1, 0, several)], "stream_id long, seq int, data string")).first().content == "ab"


def test_a_stream_is_parsed_once_and_dealt_out_once(spark):
    import contextlib
    import io

    df = ST.assemble_openai(SRC.parse_sse(spark.read.parquet(f"{SF}/conversations.parquet").select(F.col("conv_id").alias("stream_id"), F.col("text").alias("body"))))
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    plan = out.getvalue()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_a_payload_is_parsed_once_and_not_again_by_a_filter(spark):
    """No filter of the plans reads JSON or cuts bodies; empty arrays and bodies without data lines give no rows."""
    bodies = spark.createDataFrame([(1, 'data: {"choices":[{"delta":{"content":"a"}}]}\n\ndata: [DONE]\n'), (2, ""), (3, None), (4, "x: y\n")], "stream_id long, body string")
    for read in (ST.openai_fragments, ST.anthropic_fragments, ST.gemini_fragments):
        made = read(SRC.parse_sse(bodies))
        plan = made._jdf.queryExecution().optimizedPlan().toString().splitlines()
        filters = [line for line in plan if line.lstrip(" +-:*").startswith("Filter")]
        assert filters and not [f for f in filters if "from_json" in f or "split" in f]
        assert {r["stream_id"] for r in made.collect()} == {1}


def test_schedules_histories_and_tool_lists_are_dealt_to_all_partitions(spark):
    """Plans with the session's number of partitions by key, which adaptive execution doesn't join; one sort's worth of rows for both events."""
    from chatlake.operators import rpc

    calls = spark.range(8).selectExpr("id % 2 as run_id", "0 as turn", "cast(id as int) as ord", "concat('t', id % 3) as name")
    catalog = spark.createDataFrame([("t0", True), ("t1", False)], "name string, sequential boolean")
    made = T.schedule_tool_groups(calls, catalog)
    log = spark.createDataFrame([(1, 1, '{"id":1,"method":"tools/list"}')], "session_id long, seq long, raw string")
    kept, _ = H.process_history(conversation(spark, ("user",)), H.trimmed(1))
    for df, key in ((made, "run_id"), (rpc.collect_tool_lists(log), "session_id"), (kept, "conv_id")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert any("RepartitionByExpression" in line and key in line and ", 4" in line for line in plan.splitlines())
    rows = [(r["run_id"], r["seq"], r["grp"], r["ord"], r["event"]) for r in made.orderBy("run_id", "seq").collect()]
    assert [r[1:] for r in rows if r[0] == 0] == [(0, 0, 0, "start"), (1, 0, 0, "end"), (2, 1, 2, "start"), (3, 1, 4, "start"), (4, 1, 2, "end"), (5, 1, 4, "end"), (6, 2, 6, "start"), (7, 2, 6, "end")]
