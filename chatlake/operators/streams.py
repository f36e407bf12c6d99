"""Assembling streamed responses: provider payloads to fragments, fragments to whole responses.

Every provider's payloads become the same fragments (ord, content, block, is_start, call_key, call_id,
call_name, args, input_tokens, output_tokens, ends, error), an array a payload, parsed once. Assembly
explodes them, drops what follows a stream's first end or error and joins the rest in order: windows and
aggregations by stream over one exchange. Fragments are never sorted globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.functions.json_text import is_json
from chatlake.functions.scalar import normalize_args

DONE = "[DONE]"
_FIELDS = {"ord": "int", "content": "string", "block": "int", "is_start": "boolean", "call_key": "int", "call_id": "string", "call_name": "string", "args": "string", "input_tokens": "bigint", "output_tokens": "bigint", "ends": "boolean", "error": "string"}
FRAGMENT = f"struct<{','.join(f'{k}:{t}' for k, t in _FIELDS.items())}>"
CALLS = "array<struct<id:string,name:string,args:string>>"
#: What is read of a payload.
_SCHEMAS = {
    "openai": "struct<choices:array<struct<delta:struct<content:string,tool_calls:array<struct<index:int,id:string,function:struct<name:string,arguments:string>>>>>>,usage:struct<prompt_tokens:bigint,completion_tokens:bigint>>",
    "anthropic": "struct<type:string,index:int,message:struct<usage:struct<input_tokens:bigint,output_tokens:bigint>>,content_block:struct<type:string,id:string,name:string>,delta:struct<type:string,text:string,partial_json:string>,usage:struct<output_tokens:bigint>,error:struct<type:string,message:string>>",
    "gemini": "struct<candidates:array<struct<content:struct<parts:array<struct<text:string,functionCall:struct<name:string,args:string>>>>>>,usageMetadata:struct<promptTokenCount:bigint,candidatesTokenCount:bigint>>",
    "bedrock": "struct<contentBlockIndex:int,start:struct<toolUse:struct<toolUseId:string,name:string>>,delta:struct<text:string,toolUse:struct<input:string>>,usage:struct<inputTokens:bigint,outputTokens:bigint>,message:string>",
}
#: Providers whose payloads are read like another's.
_LIKE = {"azure": "openai"}
#: Providers whose streams end with an event of their own.
SENTINELS = ("openai", "azure", "anthropic", "bedrock")


def _fragment(**given: Column) -> Column:
    return F.struct(*(given.get(k, F.lit(None)).cast(t).alias(k) for k, t in _FIELDS.items()))


def _openai(r: Column, data: Column, bad: Column) -> Column:
    """First choice only; usage of the last payload that has one; ends with the sentinel."""
    done, delta, usage = data == DONE, F.get(r["choices"], F.lit(0))["delta"], r["usage"]
    base = _fragment(
        content=delta["content"],
        input_tokens=F.when(usage.isNotNull(), F.coalesce(usage["prompt_tokens"], F.lit(0))),
        output_tokens=F.when(usage.isNotNull(), F.coalesce(usage["completion_tokens"], F.lit(0))),
        ends=done,
        error=F.when(~done & bad, "decode stream chunk"),
    )
    calls = F.transform(
        F.when(~done, delta["tool_calls"]),
        lambda c, i: _fragment(ord=i + 1, call_key=F.coalesce(c["index"], F.lit(0)), call_id=c["id"], call_name=c["function"]["name"], args=F.coalesce(c["function"]["arguments"], F.lit(""))),
    )
    return F.concat(F.array(base), F.coalesce(calls, F.array()))


def _anthropic(r: Column, data: Column, bad: Column) -> Column:
    """Typed events; the output count of message_delta replaces that of message_start."""
    kind, delta, block, own = r["type"], r["delta"], F.coalesce(r["index"], F.lit(0)), r["content_block"]
    start = (kind == "content_block_start") & (own["type"] == "tool_use")
    piece = (kind == "content_block_delta") & (delta["type"] == "input_json_delta")
    usage = r["message"]["usage"]
    return F.array(
        _fragment(
            content=F.when((kind == "content_block_delta") & (delta["type"] == "text_delta"), delta["text"]),
            is_start=F.coalesce(start, F.lit(False)),
            block=F.when(start | piece, block),
            call_id=F.when(start, own["id"]),
            call_name=F.when(start, own["name"]),
            args=F.when(piece, F.coalesce(delta["partial_json"], F.lit(""))),
            input_tokens=F.when(kind == "message_start", F.coalesce(usage["input_tokens"], F.lit(0))),
            output_tokens=F.when(kind == "message_start", F.coalesce(usage["output_tokens"], F.lit(0))).when((kind == "message_delta") & r["usage"].isNotNull(), F.coalesce(r["usage"]["output_tokens"], F.lit(0))),
            ends=kind == "message_stop",
            error=F.when(bad, "decode stream event").when((kind == "error") & r["error"].isNotNull(), F.concat_ws(": ", r["error"]["type"], r["error"]["message"])),
        )
    )


def _gemini(r: Column, data: Column, bad: Column) -> Column:
    """Text and whole calls of the first candidate; calls are numbered over the stream; no sentinel."""
    counts = r["usageMetadata"]
    used = F.coalesce((counts["promptTokenCount"] > 0) | (counts["candidatesTokenCount"] > 0), F.lit(False))
    base = _fragment(
        input_tokens=F.when(used, F.coalesce(counts["promptTokenCount"], F.lit(0))),
        output_tokens=F.when(used, F.coalesce(counts["candidatesTokenCount"], F.lit(0))),
        error=F.when(bad, "decode stream chunk"),
    )

    def part(p: Column, i: Column) -> Column:
        said = F.coalesce(p["text"], F.lit("")) != ""
        call = ~said & p["functionCall"].isNotNull()
        return _fragment(ord=i + 1, content=F.when(said, p["text"]), is_start=call, call_name=F.when(call, p["functionCall"]["name"]), args=F.when(call, normalize_args(F.coalesce(p["functionCall"]["args"], F.lit("")))))

    parts = F.filter(F.transform(F.get(r["candidates"], F.lit(0))["content"]["parts"], part), lambda f: f["content"].isNotNull() | f["is_start"])
    return F.concat(F.array(base), F.coalesce(parts, F.array()))


def _bedrock(r: Column, data: Column, bad: Column, headers: Column, broken: Column) -> Column:
    """Frames with headers: an exception ends the stream; usage may follow the stop."""
    kind, failure = headers[":event-type"], headers[":exception-type"]
    block, text, use = F.coalesce(r["contentBlockIndex"], F.lit(0)), F.coalesce(r["delta"]["text"], F.lit("")), r["start"]["toolUse"]
    start = (kind == "contentBlockStart") & use.isNotNull()
    said = (kind == "contentBlockDelta") & (text != "")
    piece = (kind == "contentBlockDelta") & (text == "") & r["delta"]["toolUse"].isNotNull()
    wrong = kind.isin("contentBlockStart", "contentBlockDelta", "metadata") & bad
    return F.array(
        _fragment(
            content=F.when(said, text),
            is_start=F.coalesce(start, F.lit(False)),
            block=F.when(start | piece | said, block),
            call_id=F.when(start, use["toolUseId"]),
            call_name=F.when(start, use["name"]),
            args=F.when(piece, F.coalesce(r["delta"]["toolUse"]["input"], F.lit(""))),
            input_tokens=F.when(kind == "metadata", F.coalesce(r["usage"]["inputTokens"], F.lit(0))),
            output_tokens=F.when(kind == "metadata", F.coalesce(r["usage"]["outputTokens"], F.lit(0))),
            ends=kind == "messageStop",
            error=F.coalesce(broken, F.when(failure.isNotNull(), F.concat_ws(": ", failure, r["message"])), F.when(wrong, F.concat(F.lit("decode "), kind))),
        )
    )


def response_parts(payloads: DataFrame, provider: str | None = None) -> DataFrame:
    """Adds ``parts``, the fragments of each payload, to data (and headers, error of frames).

    Without a provider the column of that name says how each payload is read; one pass serves all.
    """
    read = payloads.withColumns({"_as": F.lit(provider) if provider else F.coalesce(F.create_map(*(F.lit(x) for pair in _LIKE.items() for x in pair))[F.col("provider")], F.col("provider")), "_bad": ~is_json(F.col("data"))})
    kinds = [_LIKE.get(provider, provider)] if provider else list(_SCHEMAS)
    read = read.withColumns({f"_{k}": F.from_json(F.when(F.col("_as") == k, F.col("data")), _SCHEMAS[k]) for k in kinds})
    data, bad = F.col("data"), F.col("_bad")
    frames = {"headers", "error"} <= set(payloads.columns)
    made = {"openai": _openai, "anthropic": _anthropic, "gemini": _gemini, "bedrock": lambda r, d, b: _bedrock(r, d, b, F.col("headers"), F.col("error"))}
    parts = F.lit(None).cast(f"array<{FRAGMENT}>")
    for k in kinds:
        if k != "bedrock" or frames:
            parts = F.when(F.col("_as") == k, made[k](F.col(f"_{k}"), data, bad)).otherwise(parts)
    return read.select(*payloads.columns, parts.alias("parts"))


def _exploded(parts: DataFrame) -> DataFrame:
    """A row a fragment.

    Before an inner explode Spark tests that its array is there and not empty, and parses the payload once
    more for that; an outer one has no such test.
    """
    rows = parts.select("stream_id", "seq", F.explode_outer("parts").alias("f")).where("f is not null")
    return rows.select("stream_id", "seq", "f.*")


def openai_fragments(payloads: DataFrame) -> DataFrame:
    return _exploded(response_parts(payloads, "openai"))


def anthropic_fragments(payloads: DataFrame) -> DataFrame:
    return _exploded(response_parts(payloads, "anthropic"))


def gemini_fragments(payloads: DataFrame) -> DataFrame:
    return _exploded(response_parts(payloads, "gemini"))


def bedrock_fragments(frames: DataFrame) -> DataFrame:
    """Frames: headers, payload, error."""
    return _exploded(response_parts(frames.withColumn("data", F.coalesce("payload", F.lit(""))), "bedrock"))


def numbered(fragments: DataFrame) -> DataFrame:
    """Numbers the calls that a stream opens, and gives their pieces those numbers.

    A piece belongs to the latest start of its block; pieces of blocks never opened are errors. Calls
    without a block are whole, and named by their number. Text in another block than the text before
    it begins a line.
    """
    stream = Window.partitionBy("stream_id").orderBy("seq", "ord")
    own = Window.partitionBy("stream_id", "block").orderBy("seq", "ord")
    said = F.coalesce("content", F.lit("")) != ""
    before = F.last(F.when(said, F.col("block")), ignorenulls=True).over(stream.rowsBetween(Window.unboundedPreceding, -1))
    rows = fragments.withColumn("_n", F.sum(F.when(F.col("is_start"), 1).otherwise(0)).over(stream) - 1).withColumn("_block", before)
    latest = F.last(F.when(F.col("is_start"), F.col("_n")), ignorenulls=True).over(own)
    piece = F.col("block").isNotNull() & F.col("args").isNotNull()
    rows = rows.withColumn("_latest", latest)
    key = F.when(F.col("is_start"), F.col("_n")).when(piece, F.col("_latest")).otherwise(F.col("call_key")).cast("int")
    lost = piece & ~F.coalesce("is_start", F.lit(False)) & F.col("_latest").isNull()
    return rows.withColumns({
        "call_key": key,
        "call_id": F.when(F.col("is_start") & F.col("block").isNull(), F.concat(F.lit("call-"), F.col("_n") + 1)).otherwise(F.col("call_id")),
        "content": F.when(said & (F.col("_block") != F.col("block")), F.concat(F.lit("\n"), "content")).otherwise(F.col("content")),
        "error": F.coalesce("error", F.when(lost, F.concat(F.lit("input fragment for block "), "block", F.lit(", which is not a tool block")))),
    }).drop("_n", "_block", "_latest")


def delta_rows(payloads: DataFrame, provider: str) -> DataFrame:
    """stream_id, seq, ord, content, call_key, call_id, call_name, args: what each payload forwards as it arrives.

    A call's identity comes with its first fragment. Of several texts in one payload the last is forwarded.
    """
    rows = numbered(_exploded(response_parts(payloads, provider)).withColumn("_said", F.col("content")))
    is_text, is_call = F.coalesce("_said", F.lit("")) != "", F.col("call_key").isNotNull()
    texts = rows.where(is_text & ~is_call).groupBy("stream_id", "seq").agg(F.max_by("_said", F.coalesce("ord", F.lit(0))).alias("content"))
    said = texts.select("stream_id", "seq", F.lit(0).alias("ord"), "content", *(F.lit(None).cast(t).alias(c) for c, t in (("call_key", "int"), ("call_id", "string"), ("call_name", "string"), ("args", "string"))))
    calls = rows.where(is_call)
    if provider == "anthropic":
        # a start forwards nothing; its identity goes with the call's first piece
        first = Window.partitionBy("stream_id", "call_key").orderBy("seq", "ord")
        whole = Window.partitionBy("stream_id", "call_key")
        calls = calls.withColumns({c: F.first(c, ignorenulls=True).over(whole.orderBy("seq", "ord").rowsBetween(Window.unboundedPreceding, 0)) for c in ("call_id", "call_name")})
        calls = calls.where("args is not null").withColumn("_i", F.row_number().over(first))
        calls = calls.withColumns({c: F.when(F.col("_i") == 1, F.col(c)) for c in ("call_id", "call_name")})
    return said.unionByName(calls.select("stream_id", "seq", F.coalesce("ord", F.lit(0)).alias("ord"), F.lit(None).cast("string").alias("content"), "call_key", "call_id", "call_name", F.coalesce("args", F.lit("")).alias("args")))


def filled(calls: Column, most: Column) -> Column:
    """A map of calls by number -> their array; numbers without fragments are empty calls."""
    blank = F.struct(F.lit("").alias("id"), F.lit("").alias("name"), F.lit("{}").alias("args"))
    return F.when(most.isNotNull(), F.transform(F.sequence(F.lit(0), most), lambda i: F.coalesce(F.try_element_at(calls, i), blank))).otherwise(F.array().cast(CALLS))


def assemble(fragments: DataFrame, sentinel: bool = True, stop_at_end: bool = True) -> DataFrame:
    """stream_id, content, tool_calls, input_tokens, output_tokens, error.

    The first end or error closes a stream (``stop_at_end``: else only an error does); with
    ``sentinel`` a stream without an end is an error. Everything is by stream, so one exchange serves
    the windows, the calls and the whole.
    """
    stop = F.col("error").isNotNull() | (F.coalesce("ends", F.lit(False)) if stop_at_end else F.lit(False))
    first = F.min(F.when(stop, F.col("seq"))).over(Window.partitionBy("stream_id"))
    rows = fragments.withColumn("_first", first).where(F.col("_first").isNull() | (F.col("seq") <= F.col("_first")))
    at = F.struct("seq", F.coalesce("ord", F.lit(0)).alias("ord"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("seq", F.coalesce("ord", F.lit(0)).alias("ord"), F.col(c).alias("v"))))), lambda x: x["v"]), "")
    latest = lambda c, known: F.max_by(c, F.when(known, at))
    own = rows.groupBy("stream_id", "call_key").agg(
        joined("content").alias("content"),
        F.coalesce(latest("call_id", F.coalesce("call_id", F.lit("")) != ""), F.lit("")).alias("id"),
        F.coalesce(latest("call_name", F.coalesce("call_name", F.lit("")) != ""), F.lit("")).alias("name"),
        normalize_args(joined("args")).alias("args"),
        *(latest(c, F.col(c).isNotNull()).alias(c) for c in ("input_tokens", "output_tokens")),
        F.min(F.when(F.col("error").isNotNull(), F.struct(at.alias("at"), "error"))).alias("error"),
        F.max(F.coalesce("ends", F.lit(False))).alias("ended"),
    )
    said, called = F.col("call_key").isNull(), F.col("call_key").isNotNull()
    whole = own.groupBy("stream_id").agg(
        F.coalesce(F.max(F.when(said, F.col("content"))), F.lit("")).alias("content"),
        *(F.coalesce(F.max(F.when(said, F.col(c))), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")),
        F.min("error")["error"].alias("error"),
        F.max("ended").alias("_ended"),
        F.map_from_entries(F.collect_list(F.when(called, F.struct("call_key", F.struct("id", "name", "args"))))).alias("_calls"),
        F.max("call_key").alias("_most"),
    )
    missing = F.when(~F.col("_ended"), "stream ended without its last event") if sentinel else F.lit(None).cast("string")
    out = whole.withColumn("error", F.coalesce("error", missing))
    ok = F.col("error").isNull()
    return out.select("stream_id", F.when(ok, F.col("content")).alias("content"), F.when(ok, filled(F.col("_calls"), F.col("_most"))).alias("tool_calls"), F.when(ok, F.col("input_tokens")).alias("input_tokens"), F.when(ok, F.col("output_tokens")).alias("output_tokens"), "error")


def assemble_openai(payloads: DataFrame) -> DataFrame:
    return assemble(openai_fragments(payloads))


def assemble_anthropic(payloads: DataFrame) -> DataFrame:
    out = assemble(numbered(anthropic_fragments(payloads)))
    bad = F.exists("tool_calls", lambda c: ~is_json(c["args"]))
    out = out.withColumn("error", F.coalesce("error", F.when(bad, "a tool's input is not valid JSON")))
    return out.select("stream_id", *(F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in ("content", "tool_calls", "input_tokens", "output_tokens")), "error")


def assemble_gemini(payloads: DataFrame) -> DataFrame:
    return assemble(numbered(gemini_fragments(payloads)), sentinel=False, stop_at_end=False)


def assemble_bedrock(frames: DataFrame) -> DataFrame:
    return assemble(numbered(bedrock_fragments(frames)), stop_at_end=False)
