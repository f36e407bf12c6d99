"""Live responses made of the conversations: bodies of four providers, cut into network chunks that arrive over several files.

A turn's stream is of one of four providers and one of four kinds: whole, broken off without its end,
failing in the middle, and whole with two calls. Its body is its provider's: lines of JSON or binary
frames. ``chunk_files`` writes the chunks, some ahead of their turn, as the files of a streaming source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.sources.shared import drop, scratch_folder

STEP, FILES, START = 48, 3, 1_700_000_000
PROVIDERS = ("openai", "anthropic", "gemini", "bedrock")
WHOLE, BROKEN, FAILING, CALLING = range(4)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id, provider, kind, text."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("stream_id"), F.coalesce("text", F.lit("")).alias("text"))
    provider = F.element_at(F.array(*map(F.lit, PROVIDERS)), (F.col("stream_id") % 4 + 1).cast("int"))
    return rows.select("stream_id", provider.alias("provider"), (F.floor(F.col("stream_id") / 4) % 4).cast("int").alias("kind"), "text")


def _hex(number: Column, width: int) -> Column:
    return F.lpad(F.hex(number), width, "0")


def frame(headers: list[tuple[str, Column]], payload: Column) -> Column:
    """The bytes, in hexadecimal, of a binary frame with text headers."""
    parts = []
    for name, value in headers:
        raw = F.encode(value, "UTF-8")
        parts.append(F.concat(F.lit(f"{len(name):02X}{name.encode().hex().upper()}07"), _hex(F.octet_length(raw), 4), F.hex(raw)))
    header = F.concat(*parts)
    size, body = F.length(header) / 2, F.hex(F.encode(payload, "UTF-8"))
    start = F.concat(_hex((size + F.length(body) / 2 + 16).cast("bigint"), 8), _hex(size.cast("bigint"), 8))
    return F.concat(start, _hex(F.crc32(F.unhex(start)), 8), header, body, _hex(F.crc32(F.unhex(F.concat(start, header, body))), 8))


#: Payloads after the text; a binary frame's event type, or after ! its exception's, comes first.
_CALLS = {
    "openai": ['{"choices":[{"delta":{"tool_calls":[{"index":0,"id":"c1","function":{"name":"look","arguments":"{\\"a\\":"}},{"index":2,"id":"c3","function":{"name":"put","arguments":""}}]}}]}', '{"choices":[{"delta":{"tool_calls":[{"index":0,"function":{"arguments":"1}"}}]}}]}'],
    "anthropic": ['{"type":"content_block_start","index":3,"content_block":{"type":"tool_use","id":"c1","name":"look"}}', '{"type":"content_block_start","index":5,"content_block":{"type":"tool_use","id":"c3","name":"put"}}', '{"type":"content_block_delta","index":3,"delta":{"type":"input_json_delta","partial_json":"{\\"a\\":"}}', '{"type":"content_block_delta","index":3,"delta":{"type":"input_json_delta","partial_json":"1}"}}'],
    "gemini": ['{"candidates":[{"content":{"parts":[{"functionCall":{"name":"look","args":{"a":1}}},{"functionCall":{"name":"put"}}]}}]}'],
    "bedrock": ['contentBlockStart {"contentBlockIndex":3,"start":{"toolUse":{"toolUseId":"c1","name":"look"}}}', 'contentBlockStart {"contentBlockIndex":5,"start":{"toolUse":{"toolUseId":"c3","name":"put"}}}', 'contentBlockDelta {"contentBlockIndex":3,"delta":{"toolUse":{"input":"{\\"a\\":"}}}', 'contentBlockDelta {"contentBlockIndex":3,"delta":{"toolUse":{"input":"1}"}}}'],
}
_USAGE = {
    "openai": ['{"choices":[],"usage":{"prompt_tokens":3,"completion_tokens":7}}'],
    "anthropic": ['{"type":"message_start","message":{"usage":{"input_tokens":3,"output_tokens":1}}}', '{"type":"message_delta","usage":{"output_tokens":7}}'],
    "gemini": ['{"usageMetadata":{"promptTokenCount":3,"candidatesTokenCount":7}}'],
    "bedrock": [],
}
_ENDS = {"openai": ["[DONE]"], "anthropic": ['{"type":"message_stop"}'], "gemini": [], "bedrock": ["messageStop {}", 'metadata {"usage":{"inputTokens":3,"outputTokens":7}}']}
_FAILS = {"openai": ['{"choices":'], "anthropic": ['{"type":"error","error":{"type":"overloaded_error","message":"busy"}}'], "gemini": ['{"candidates":[] x'], "bedrock": ['!throttlingException {"message":"slow"}']}


def _said(provider: str, piece: Column) -> Column:
    """The payload that carries a piece of text."""
    if provider == "openai":
        return F.to_json(F.struct(F.array(F.struct(F.struct(piece.alias("content")).alias("delta"))).alias("choices")))
    if provider == "anthropic":
        return F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.lit(0).alias("index"), F.struct(F.lit("text_delta").alias("type"), piece.alias("text")).alias("delta")))
    if provider == "gemini":
        return F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(piece.alias("text"))).alias("parts")).alias("content"))).alias("candidates")))
    return F.to_json(F.struct(F.lit(0).alias("contentBlockIndex"), F.struct(piece.alias("text")).alias("delta")))


def _tail(provider: str) -> Column:
    """The payloads after the text, by kind."""
    listed = lambda *parts: F.array(*(F.lit(x) for p in parts for x in p)).cast("array<string>")
    usage, ends = _USAGE[provider], _ENDS[provider]
    return F.when(F.col("kind") == WHOLE, listed(usage, ends)).when(F.col("kind") == BROKEN, listed(usage)).when(F.col("kind") == FAILING, listed(_FAILS[provider], ends)).otherwise(listed(_CALLS[provider], usage, ends))


def _wired(provider: str, payload: Column) -> Column:
    """A payload's bytes in hexadecimal: a data line with a comment before it, or a frame."""
    if provider != "bedrock":
        return F.hex(F.encode(F.concat(F.lit(": keep-alive\ndata: "), payload, F.lit("\n\n")), "UTF-8"))
    name, body = F.substring_index(payload, " ", 1), F.regexp_extract(payload, "(?s)^[^ ]* (.*)$", 1)
    return F.when(payload.startswith("!"), frame([(":exception-type", F.substring(name, 2, 1000))], body)).otherwise(frame([(":event-type", name)], body))


def _payloads(provider: str) -> Column:
    head = F.lit("contentBlockDelta " if provider == "bedrock" else "")
    return F.concat(F.transform("cut", lambda x: F.concat(head, _said(provider, x))), _tail(provider))


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id, provider, kind, text, body (binary)."""
    n = F.ceil(F.length("text") / STEP).cast("int")
    cut = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr("text", i * STEP + 1, F.lit(STEP)))).otherwise(F.array().cast("array<string>"))
    rows = turns(spark, sf_dir).withColumn("cut", cut)
    said, wired = F.lit(None).cast("array<string>"), F.lit(None).cast("string")
    for p in PROVIDERS:
        own = F.col("provider") == p
        said = F.when(own, _payloads(p)).otherwise(said)
        wired = F.when(own, F.array_join(F.transform("payloads", lambda x: _wired(p, x)), "")).otherwise(wired)  # noqa: B023
    return rows.withColumn("payloads", said).select("stream_id", "provider", "kind", "text", F.unhex(wired).alias("body"))


def chunks(whole: DataFrame, width: Column) -> DataFrame:
    """stream_id, provider, seq, chunk, last, ts, n: bodies cut every ``width`` bytes, a second apart.

    A broken stream's last chunk isn't marked. There is always a chunk; an inner explode would make each body once more to see that.
    """
    n = F.greatest(F.ceil(F.length("body") / F.col("_width")), F.lit(1)).cast("int")
    rows = whole.withColumn("_width", width.cast("int")).withColumn("n", n).select("*", F.explode_outer(F.sequence(F.lit(0), F.col("n") - 1)).alias("seq"))
    chunk = F.substr("body", F.col("seq") * F.col("_width") + 1, F.col("_width"))
    last = (F.col("seq") == F.col("n") - 1) & (F.col("kind") != BROKEN)
    return rows.select("stream_id", "provider", F.col("seq").cast("bigint").alias("seq"), chunk.alias("chunk"), last.alias("last"), F.timestamp_seconds(F.lit(START) + F.col("seq")).alias("ts"), "n")


def chunk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A streaming source of the chunks, one file a micro-batch; some chunks come a file early, and time moves on at the end."""
    rows = chunks(bodies(spark, sf_dir), 40 + F.col("stream_id") % 97)
    at = F.floor(F.col("seq") * FILES / F.col("n"))
    ahead = (F.col("seq") % 7 == 3) & (at > 0)
    rows = rows.select("stream_id", "provider", "seq", "chunk", "last", "ts", (at - ahead.cast("int")).cast("int").alias("file"))
    tick = spark.range(1).select(F.lit(-1).cast("bigint").alias("stream_id"), F.lit("none").alias("provider"), F.lit(0).cast("bigint").alias("seq"), F.lit(None).cast("binary").alias("chunk"), F.lit(False).alias("last"), F.timestamp_seconds(F.lit(START + 10 * 86_400)).alias("ts"), F.lit(FILES - 1).alias("file"))
    path, once = scratch_folder(spark, "chunks"), scratch_folder(spark, "cut")
    rows = rows.union(tick)
    # made once, in parallel; then a file a micro-batch
    rows.write.partitionBy("file").parquet(once)
    schema = rows.drop("file").schema
    for i in range(FILES):
        spark.read.schema(schema).parquet(f"{once}/file={i}").coalesce(1).write.mode("append").parquet(f"{path}/{i}")
    drop(spark, once)
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path)
