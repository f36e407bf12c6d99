"""Live streams against their batch twins: any chunk size, any order, duplicates, silence, and state that goes."""

import functools

import pytest
from pyspark.sql import functions as F

from chatlake.jobs import live
from chatlake.jobs.stream_queries import _state_settings
from chatlake.operators import streams as S
from chatlake.sources import streams as SRC
from chatlake.streaming import events as E
from chatlake.streaming import responses as R

START = 1_700_000_000
PAYLOAD = "stream_id long, provider string, seq long, chunk binary, last boolean, ts timestamp"


def _sse(*data: str) -> bytes:
    return "".join(f": ping\nevent: e\ndata: {d}\r\n\n" for d in data).encode()


@functools.cache
def _bodies(spark) -> list[tuple]:
    """Whole conversations of all kinds, and bodies that are spoilt in some way."""
    rows = [(r["stream_id"], r["provider"], bytes(r["body"]), r["kind"] != live.BROKEN) for r in live.bodies(spark, "/root/testdata/sf0.001").orderBy("stream_id").limit(48).collect()]
    framed = next(b for _, p, b, last in rows if p == "bedrock" and last)
    text = '{"choices":[{"delta":{"content":"é€😀"}}]}'
    odd = [
        ("azure", _sse(text, "[DONE]", text), True), ("openai", _sse(text)[:-9], True), ("openai", _sse(text, "[DONE]")[:-3], True), ("openai", b"", True), ("openai", _sse('{"choices":[]} x', "[DONE]"), True),
        ("anthropic", _sse('{"type":"content_block_delta","index":4,"delta":{"type":"input_json_delta","partial_json":"{"}}', '{"type":"message_stop"}'), True),
        ("anthropic", _sse('{"type":"content_block_start","index":0,"content_block":{"type":"tool_use","id":"t","name":"n"}}', '{"type":"content_block_delta","index":0,"delta":{"type":"input_json_delta","partial_json":"{"}}', '{"type":"message_stop"}'), True),
        ("gemini", _sse('{"candidates":[{"content":{"parts":[{"text":"a"},{"functionCall":{"name":"f"}},{"text":"b"},{"functionCall":{"name":"g","args":{"x":[1]}}}]}}]}', '{"usageMetadata":{"promptTokenCount":1}}', '{"usageMetadata":{}}'), True),
        ("bedrock", framed[:-5], True), ("bedrock", framed[:-70] + b"\0" + framed[-69:], True), ("bedrock", framed[:6], True), ("bedrock", b"\xff" * 40, True),
    ]
    return rows + [(10**6 + i, *x) for i, x in enumerate(odd)]


def _chunked(bodies: list[tuple], width: int, shuffled: bool = False) -> list[list[tuple]]:
    """Rows of two files; shuffled ones are reversed in pairs, sent twice, and some come a file early."""
    files: list[list[tuple]] = [[], []]
    for i, provider, body, last in bodies:
        own = [body[k : k + width] for k in range(0, len(body), width)] or [b""]
        for n, chunk in enumerate(own):
            at = min(2 * n // len(own), 1)
            row = (i, provider, n, bytearray(chunk), last and n == len(own) - 1, START + n)
            files[0 if shuffled and n % 5 == 2 else at].append(row)
            if shuffled and n % 3 == 0:
                files[at].append(row)
    if shuffled:
        files = [f[::-1] for f in files]
    return [files[0], [*files[1], (-1, "none", 0, None, False, START + 10**6)]]


def _source(spark, files: list[list[tuple]], schema: str, at: str):
    for n, rows in enumerate(files):
        plain = schema.replace("ts timestamp", "t long")
        spark.createDataFrame(rows, plain).withColumn("ts", F.timestamp_seconds("t")).drop("t").coalesce(1).write.parquet(f"{at}/{n}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(at)


def _drain(stream, at: str):
    """All rows in the end, and the progress of the batches."""
    spark = stream.sparkSession
    with _state_settings(spark):
        q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out"), q.recentProgress


@pytest.mark.parametrize("width,shuffled", [(23, False), (61, True), (100_000, False)])
def test_payloads_don_t_depend_on_the_chunks(spark, tmp_path, width, shuffled):
    bodies = _bodies(spark)
    read, progress = _drain(R.stream_payloads(_source(spark, _chunked(bodies, width, shuffled), PAYLOAD, f"{tmp_path}/in")), str(tmp_path))
    got = sorted((r["stream_id"], r["seq"], r["line"], r["data"], str(r["headers"]), r["error"]) for r in read.collect())
    df = spark.createDataFrame([(i, p, bytearray(b)) for i, p, b, _ in bodies], "stream_id long, provider string, body binary")
    lines = SRC.parse_sse(df.where("provider <> 'bedrock'").select("stream_id", F.col("body").cast("string").alias("body"))).select("stream_id", F.col("seq").cast("long"), "data", F.lit(None).cast("map<string,string>"), F.lit(None).cast("string"))
    frames = SRC.decode_event_frames(df.where("provider = 'bedrock'")).select("stream_id", "seq", "payload", "headers", "error")
    want: dict[int, list] = {}
    for r in sorted(lines.union(frames).collect(), key=lambda r: (r[0], r[1])):
        want.setdefault(r[0], []).append((r[1], r[2], str(r[3]), r[4]))
    assert got == sorted((i, n, *row) for i, rows in want.items() for n, row in enumerate(rows))
    assert progress[-1].stateOperators[0].numRowsTotal == 0


def test_responses_equal_the_batch_s_and_their_state_goes(spark, tmp_path):
    bodies = _bodies(spark)
    made, progress = _drain(R.assemble_stream(R.stream_payloads(_source(spark, _chunked(bodies, 37, True), PAYLOAD, f"{tmp_path}/in"))), str(tmp_path))
    got = {r["stream_id"]: (r["content"], r["tool_calls"], r["input_tokens"], r["output_tokens"], r["error"]) for r in made.collect()}
    df = spark.createDataFrame([(i, p, bytearray(b)) for i, p, b, _ in bodies], "stream_id long, provider string, body binary")
    want = {}
    for providers, assembled in ((("openai", "azure"), S.assemble_openai), (("anthropic",), S.assemble_anthropic), (("gemini",), S.assemble_gemini), (("bedrock",), S.assemble_bedrock)):
        own = df.where(F.col("provider").isin(*providers))
        payloads = SRC.decode_event_frames(own) if providers == ("bedrock",) else SRC.parse_sse(own.select("stream_id", F.col("body").cast("string").alias("body")))
        want |= {r["stream_id"]: (r["content"], r["tool_calls"], r["input_tokens"], r["output_tokens"], r["error"]) for r in assembled(payloads).collect()}
    assert got == want and made.count() == len(got) > 40
    assert len({e for *_, e in got.values()}) > 6 and sum(len(c or ()) for _, c, *_ in got.values()) > 5
    # what is left are streams that only the last silence has flushed; while they ran, a few rows a stream were held
    assert progress[-1].stateOperators[1].numRowsTotal == 0 and progress[-1].stateOperators[0].numRowsTotal <= 20
    assert max(p.stateOperators[0].numRowsTotal for p in progress) < 40 * len(bodies)


def test_lines_have_a_bound(spark, tmp_path):
    rows = [[(1, "openai", 0, bytearray(b"data: " + b"x" * 90), False, START), (1, "openai", 1, bytearray(b"y\ndata: z\n"), True, START), (2, "openai", 0, bytearray(b"data: z\n"), True, START)]]
    read, _ = _drain(R.stream_payloads(_source(spark, rows, PAYLOAD, f"{tmp_path}/in"), longest=64), str(tmp_path))
    assert sorted((r["stream_id"], r["data"], r["error"]) for r in read.collect()) == [(1, None, "a line is longer than 64 bytes"), (2, "z", None)]


EVENT = "run_id long, seq long, kind string, input_tokens int, output_tokens int, ts timestamp"


def test_a_run_s_last_round_closes_on_silence_and_each_run_crosses_once(spark, tmp_path):
    first = [(1, 0, "model_start", 0, 0, START), (1, 1, "model_end", 6, 1, START + 1), (2, 0, "model_end", 3, 0, START), (2, 1, "output_rejected", 0, 0, START + 1), (3, 0, "model_end", 9, 0, START), (3, 1, "output_rejected", 0, 0, START), (4, 0, "model_end", 1, 0, START)]
    second = [(2, 2, "model_end", 3, 0, START + 9), (3, 2, "model_end", 9, 0, START + 9), (-1, 0, None, 0, 0, START + 10**6)]
    out, progress = _drain(E.usage_guard(_source(spark, [first, second], EVENT, f"{tmp_path}/in"), {"input_tokens": 5}, idle_ms=60_000, watermark="10 seconds"), str(tmp_path))
    got = sorted((r["run_id"], r["round"], r["crossed_kind"], r["limit"], r["actual"]) for r in out.collect())
    assert got == [(1, 0, "input_tokens", 5, 6), (2, 1, "input_tokens", 5, 6), (3, 0, "input_tokens", 5, 9)]
    assert progress[-1].stateOperators[0].numRowsTotal == 0


def test_streams_share_state_by_bucket_and_close_each_in_its_own_time(spark, tmp_path):
    """Hundreds of streams in two buckets: a value of state and a timer each; a stream that goes on isn't closed with the silent ones."""
    n = 300
    text = [f'data: {{"candidates":[{{"content":{{"parts":[{{"text":"{x}"}}]}}}}]}}\n'.encode() for x in "abc"]
    first = [(i, "gemini", 0, bytearray(text[0]), False, START) for i in range(n)]
    second = [(i, "gemini", 1, bytearray(text[1]), False, START + 500) for i in range(0, n, 3)] + [(-1, "none", 0, None, False, START + 4500)]
    third = [(i, "gemini", 2, bytearray(text[2]), True, START + 4600) for i in range(0, n, 3)] + [(-1, "none", 0, None, False, START + 10**6)]
    # a gap that the first silence passes for two streams of three, and the others only just don't
    source = _source(spark, [first, second, third], PAYLOAD, f"{tmp_path}/in")
    made, progress = _drain(R.assemble_stream(R.stream_payloads(source, gap_ms=700_000, buckets=2), gap_ms=700_000, buckets=2), str(tmp_path))
    assert sorted((r["stream_id"], r["content"], r["error"]) for r in made.collect()) == [(i, "abc" if i % 3 == 0 else "a", None) for i in range(n)]
    assert max(s.numRowsTotal for p in progress for s in p.stateOperators) <= 4 and sum(s.numRowsTotal for s in progress[-1].stateOperators) == 0


def test_decoded_frames_leave_in_small_batches():
    """A batch of bodies never becomes one batch of all their frames."""
    import struct
    import zlib

    import pyarrow as pa

    def frame(payload: bytes) -> bytes:
        start = struct.pack(">II", len(payload) + 16, 0)
        start += struct.pack(">I", zlib.crc32(start))
        return start + payload + struct.pack(">I", zlib.crc32(payload, zlib.crc32(start[:8])))

    bodies = [b"".join(frame(b"%d %d" % (i, n)) for n in range(50)) for i in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array(bodies)], names=["stream_id", "body"])
    for most in ((64, 1 << 20), (1 << 20, 128)):
        made = list(SRC._decoded(iter([batch]), *most))
        assert max(b.num_rows for b in made) <= 64
        rows = [(r["stream_id"], r["seq"], r["payload"], r["error"]) for b in made for r in b.to_pylist()]
        assert rows == [(i, n, f"{i} {n}", None) for i in range(20) for n in range(50)]
