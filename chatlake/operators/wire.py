"""Provider payloads: responses normalized to one shape, and request bodies rendered.

Normalized responses are rows: content, tool_calls, input_tokens, output_tokens, error. Raw JSON of
arguments stays text: it is spliced into bodies as it is, and read back compactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.functions.scalar import base64_text, content_text, data_url, normalize_args
from chatlake.operators.history import merge_turns

OPENAI = "struct<choices:array<struct<message:struct<content:string,tool_calls:array<struct<id:string,function:struct<name:string,arguments:string>>>>>>,usage:struct<prompt_tokens:bigint,completion_tokens:bigint>>"
ANTHROPIC = "struct<content:array<struct<type:string,text:string,id:string,name:string,input:string>>,usage:struct<input_tokens:bigint,output_tokens:bigint>>"
GEMINI = "struct<candidates:array<struct<content:struct<parts:array<struct<text:string,functionCall:struct<name:string,args:string>>>>>>,usageMetadata:struct<promptTokenCount:bigint,candidatesTokenCount:bigint>>"
BEDROCK = "struct<output:struct<message:struct<content:array<struct<text:string,toolUse:struct<toolUseId:string,name:string,input:string>>>>>,usage:struct<inputTokens:bigint,outputTokens:bigint>>"
_EMPTY = "array<struct<id:string,name:string,args:string>>"
_BROKEN = "decode response body"


def _call(id_: Column, name: Column, args: Column) -> Column:
    return F.struct(F.coalesce(id_, F.lit("")).alias("id"), F.coalesce(name, F.lit("")).alias("name"), normalize_args(F.coalesce(args, F.lit(""))).alias("args"))


def _finished(parsed: Column, read, missing: str | None = None) -> Column:
    """A struct of the normalized columns; ``read`` maps the parsed body to content, calls, tokens in and out and its list."""

    def fields(r: Column) -> Column:
        content, calls, tokens_in, tokens_out, listed = read(r)
        error = F.when(r.isNull() | F.try_parse_json("body").isNull(), F.lit(_BROKEN))
        if missing:
            error = F.coalesce(error, F.when(F.coalesce(F.size(listed), F.lit(0)) <= 0, F.lit(f"{_BROKEN}: response contained no {missing}")))
        none = F.array().cast(_EMPTY)
        values = {"content": F.coalesce(content, F.lit("")), "tool_calls": F.coalesce(calls, none), "input_tokens": F.coalesce(tokens_in, F.lit(0)), "output_tokens": F.coalesce(tokens_out, F.lit(0))}
        return F.transform(F.array(error), lambda e: F.struct(e.alias("error"), *(F.when(e.isNull(), v).alias(c) for c, v in values.items())))[0]

    # bound once, so that the body is parsed once a row
    return F.transform(F.array(parsed), fields)[0]


def _openai() -> Column:
    """The first choice; content if it is a string; arguments are strings of JSON."""
    raw = F.try_variant_get(F.try_parse_json("body"), "$.choices[0].message.content", "variant")

    def read(r: Column) -> tuple[Column, ...]:
        calls = F.transform(F.get(r["choices"], F.lit(0))["message"]["tool_calls"], lambda c: _call(c["id"], c["function"]["name"], c["function"]["arguments"]))
        return content_text(F.to_json(raw)), calls, r["usage"]["prompt_tokens"], r["usage"]["completion_tokens"], r["choices"]

    return _finished(F.from_json("body", OPENAI), read, "choices")


def _anthropic() -> Column:
    """Text blocks by line, tool_use blocks as calls, other blocks skipped."""

    def read(r: Column) -> tuple[Column, ...]:
        text = F.array_join(F.transform(F.filter(r["content"], lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "\n")
        calls = F.transform(F.filter(r["content"], lambda b: b["type"] == "tool_use"), lambda b: _call(b["id"], b["name"], b["input"]))
        return text, calls, r["usage"]["input_tokens"], r["usage"]["output_tokens"], r["content"]

    return _finished(F.from_json("body", ANTHROPIC), read)


def _has_text(part: Column) -> Column:
    return F.coalesce(part["text"], F.lit("")) != ""


def _gemini() -> Column:
    """The first candidate; calls get ids call-1, call-2 ...; a part's text wins over its call."""

    def read(r: Column) -> tuple[Column, ...]:
        parts = F.get(r["candidates"], F.lit(0))["content"]["parts"]
        text = F.array_join(F.transform(F.filter(parts, _has_text), lambda p: p["text"]), "\n")
        own = F.filter(parts, lambda p: ~_has_text(p) & p["functionCall"].isNotNull())
        calls = F.transform(own, lambda p, i: _call(F.concat(F.lit("call-"), i + 1), p["functionCall"]["name"], p["functionCall"]["args"]))
        return text, calls, r["usageMetadata"]["promptTokenCount"], r["usageMetadata"]["candidatesTokenCount"], r["candidates"]

    return _finished(F.from_json("body", GEMINI), read, "candidates")


def _bedrock() -> Column:
    """Text blocks by line, toolUse blocks as calls."""

    def read(r: Column) -> tuple[Column, ...]:
        blocks = r["output"]["message"]["content"]
        text = F.array_join(F.transform(F.filter(blocks, _has_text), lambda p: p["text"]), "\n")
        own = F.filter(blocks, lambda p: ~_has_text(p) & p["toolUse"].isNotNull())
        calls = F.transform(own, lambda p: _call(p["toolUse"]["toolUseId"], p["toolUse"]["name"], p["toolUse"]["input"]))
        return text, calls, r["usage"]["inputTokens"], r["usage"]["outputTokens"], blocks

    return _finished(F.from_json("body", BEDROCK), read)


READERS = {"openai": _openai, "azure": _openai, "anthropic": _anthropic, "gemini": _gemini, "bedrock": _bedrock}


def _normalized(payloads: DataFrame, fields: Column) -> DataFrame:
    return payloads.withColumn("_n", fields).select(*payloads.columns, "_n.*")


def normalize_openai(payloads: DataFrame) -> DataFrame:
    return _normalized(payloads, _openai())


def normalize_anthropic(payloads: DataFrame) -> DataFrame:
    return _normalized(payloads, _anthropic())


def normalize_gemini(payloads: DataFrame) -> DataFrame:
    return _normalized(payloads, _gemini())


def normalize_bedrock(payloads: DataFrame) -> DataFrame:
    return _normalized(payloads, _bedrock())


def normalize_responses(payloads: DataFrame) -> DataFrame:
    """Each row by its ``provider``, in one scan; rows of unknown providers get an error."""
    kinds = {"error": "string", "content": "string", "tool_calls": _EMPTY, "input_tokens": "bigint", "output_tokens": "bigint"}
    fields = F.struct(F.lit("unknown provider").alias("error"), *(F.lit(None).cast(t).alias(c) for c, t in kinds.items() if c != "error"))
    for provider, reader in READERS.items():
        fields = F.when(F.col("provider") == provider, reader()).otherwise(fields)
    return _normalized(payloads, fields)


def quoted(text: Column) -> Column:
    """A JSON string."""
    one = F.to_json(F.array(F.coalesce(text, F.lit(""))))
    return F.substr(one, F.lit(2), F.length(one) - 2)


def _object(**fields: Column) -> Column:
    """A JSON object of rendered values; null ones are left out."""
    items = [F.concat(F.lit(f'"{k}":'), v) for k, v in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *items), F.lit("}"))


def _list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def _if(condition: Column, value: Column) -> Column:
    return F.when(condition, value)


def _present(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def _parts(m: Column) -> Column:
    return F.coalesce(m["parts"], F.array().cast("array<struct<kind:string,url:string,data:binary,media_type:string>>"))


def _calls(m: Column) -> Column:
    return F.coalesce(m["tool_calls"], F.array().cast(_EMPTY))


def _text_or(m: Column, blocks: Column, text: Column) -> Column:
    """The text's block, if any, and the others; an empty message still has its text."""
    out = F.concat(F.when(_present(m["content"]), F.array(text)).otherwise(F.array().cast("array<string>")), blocks)
    return F.when(F.size(out) == 0, F.array(text)).otherwise(out)


def _said(m: Column, calls: Column, text: Column) -> Column:
    return F.concat(F.when(_present(m["content"]), F.array(text)).otherwise(F.array().cast("array<string>")), calls)


def _tools(specs: Column, render) -> Column:
    return F.when(F.size(specs) > 0, _list(F.transform(specs, render)))


def _schema() -> Column:
    return F.nullif(F.col("output_schema"), F.lit(""))


def render_openai(messages: DataFrame, requests: DataFrame, model: str | None) -> DataFrame:
    """request_id, body. messages: conv_id (the request), pos, role, content, parts, tool_calls, ...

    Roles map one to one; a text alone is a string, with parts an array; inline data becomes a data
    URL. Without ``model`` this is the hosted variant, which names its model in the address.
    """
    m = F.struct(*(c for c in messages.columns))
    role = F.when(F.col("role").isin("system", "assistant", "tool"), F.col("role")).otherwise("user")
    images = F.transform(_parts(m), lambda p: _object(type=F.lit('"image_url"'), image_url=_object(url=quoted(F.when(F.octet_length(p["data"]) > 0, data_url(p["media_type"], p["data"])).otherwise(p["url"])))))
    text = _object(type=F.lit('"text"'), text=quoted(F.col("content")))
    content = F.when(F.size(_parts(m)) == 0, quoted(F.col("content"))).otherwise(_list(F.concat(F.when(_present(F.col("content")), F.array(text)).otherwise(F.array().cast("array<string>")), images)))
    calls = F.when(F.size(_calls(m)) > 0, _list(F.transform(_calls(m), lambda c: _object(id=quoted(c["id"]), type=F.lit('"function"'), function=_object(name=quoted(c["name"]), arguments=quoted(c["args"]))))))
    one = _object(role=quoted(role), content=content, tool_calls=calls, tool_call_id=_if(_present(F.col("tool_call_id")), quoted(F.col("tool_call_id"))))
    bodies = messages.select("conv_id", F.struct("pos", one.alias("json")).alias("m")).groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    tools = _tools(F.col("tool_specs"), lambda t: _object(type=F.lit('"function"'), function=_object(name=quoted(t["name"]), description=_if(_present(t["description"]), quoted(t["description"])), parameters=t["schema"])))
    form = F.when(_schema().isNotNull(), _object(type=F.lit('"json_schema"'), json_schema=_object(name=F.lit('"output"'), strict=F.lit("true"), schema=_schema())))
    head = {"model": quoted(F.lit(model))} if model else {}
    return requests.join(bodies, F.col("request_id") == F.col("conv_id")).select("request_id", _object(**head, messages=_list(F.col("ms.json")), tools=tools, response_format=form).alias("body"))


def _turns(messages: DataFrame, role: dict[str, str], blocks: Column) -> DataFrame:
    """conv_id, turns (JSON list), error: merged turns; blocks: a column over ``m`` giving array<string>."""
    turns = merge_turns(messages).select("conv_id", "turn", "wire_role", F.explode("messages").alias("m")).withColumn("blocks", blocks)
    own = turns.groupBy("conv_id", "turn", "wire_role").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col("m.pos").alias("pos"), "blocks"))), lambda x: x["blocks"])).alias("blocks"))
    name = F.when(F.col("wire_role") == "assistant", role["assistant"]).otherwise(role["user"])
    key = role["blocks"]
    rendered = own.select("conv_id", F.struct("turn", F.concat(F.lit('{"role":"'), name, F.lit(f'","{key}":'), _list(F.col("blocks")), F.lit("}")).alias("json")).alias("t"))
    return rendered.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts")).select("conv_id", _list(F.col("ts.json")).alias("turns"))


def _system(messages: DataFrame) -> DataFrame:
    rows = messages.where("role = 'system'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("content", F.lit("")).alias("text")))).alias("s"))
    return rows.select(F.col("conv_id").alias("system_id"), F.col("s.text").alias("system"))


def _joined(messages: DataFrame, requests: DataFrame, turns: DataFrame) -> DataFrame:
    return requests.join(turns, F.col("request_id") == F.col("conv_id")).join(_system(messages), F.col("request_id") == F.col("system_id"), "left")


def _blocks(user: Column, tool: Column, assistant: Column) -> Column:
    role = F.col("m.role")
    return F.when(role == "assistant", assistant).when(role == "tool", F.array(tool)).otherwise(user)


def render_anthropic(messages: DataFrame, requests: DataFrame, model: str, max_tokens: int = 1024) -> DataFrame:
    """request_id, body: system texts joined by blank lines, alternating turns of blocks."""
    m = F.col("m")
    text = _object(type=F.lit('"text"'), text=quoted(m["content"]))
    calls = F.transform(_calls(m), lambda c: _object(type=F.lit('"tool_use"'), id=quoted(c["id"]), name=quoted(c["name"]), input=normalize_args(c["args"])))
    result = _object(type=F.lit('"tool_result"'), tool_use_id=quoted(m["tool_call_id"]), content=_if(_present(m["content"]), quoted(m["content"])))
    images = F.transform(
        _parts(m),
        lambda p: _object(type=F.lit('"image"'), source=F.when(_present(p["url"]), _object(type=F.lit('"url"'), url=quoted(p["url"]))).otherwise(_object(type=F.lit('"base64"'), media_type=quoted(p["media_type"]), data=quoted(base64_text(p["data"]))))),
    )
    turns = _turns(messages, {"assistant": "assistant", "user": "user", "blocks": "content"}, _blocks(_text_or(m, images, text), result, _said(m, calls, text)))
    tools = _tools(F.col("tool_specs"), lambda t: _object(name=quoted(t["name"]), description=_if(_present(t["description"]), quoted(t["description"])), input_schema=t["schema"]))
    output = F.when(_schema().isNotNull(), _object(format=_object(type=F.lit('"json_schema"'), schema=_schema())))
    system = F.array_join("system", "\n\n")
    return _joined(messages, requests, turns).select("request_id", _object(model=quoted(F.lit(model)), max_tokens=F.lit(str(max_tokens)), system=_if(_present(system), quoted(system)), messages=F.col("turns"), tools=tools, output_config=output).alias("body"))


def render_gemini(messages: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, body, error: turns of parts; a schema beside tools can't be asked for."""
    m = F.col("m")
    text = _object(text=quoted(m["content"]))
    calls = F.transform(_calls(m), lambda c: _object(functionCall=_object(name=quoted(c["name"]), args=normalize_args(c["args"]))))
    result = _object(functionResponse=_object(name=quoted(m["tool_name"]), response=_object(result=quoted(m["content"]))))
    images = F.transform(_parts(m), lambda p: F.when(_present(p["url"]), _object(fileData=_object(fileUri=quoted(p["url"])))).otherwise(_object(inlineData=_object(mimeType=quoted(p["media_type"]), data=quoted(base64_text(p["data"]))))))
    turns = _turns(messages, {"assistant": "model", "user": "user", "blocks": "parts"}, _blocks(_text_or(m, images, text), result, _said(m, calls, text)))
    system = F.when(F.size("system") > 0, _object(parts=_list(F.transform("system", lambda s: _object(text=quoted(s))))))
    tools = F.when(F.size("tool_specs") > 0, _list(F.array(_object(functionDeclarations=_list(F.transform("tool_specs", lambda t: _object(name=quoted(t["name"]), description=_if(_present(t["description"]), quoted(t["description"])), parameters=t["schema"])))))))
    config = F.when(_schema().isNotNull(), _object(responseMimeType=F.lit('"application/json"'), responseSchema=_schema()))
    error = F.when(_schema().isNotNull() & (F.size("tool_specs") > 0), "encode request: an output schema cannot be combined with tools")
    rows = _joined(messages, requests, turns).withColumn("error", error)
    return rows.select("request_id", F.when(F.col("error").isNull(), _object(contents=F.col("turns"), systemInstruction=system, tools=tools, generationConfig=config)).alias("body"), "error")


def render_bedrock(messages: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, body, error: turns of blocks; images must be inline and of an image type."""
    m = F.col("m")
    text = _object(text=quoted(m["content"]))
    calls = F.transform(_calls(m), lambda c: _object(toolUse=_object(toolUseId=quoted(c["id"]), name=quoted(c["name"]), input=normalize_args(c["args"]))))
    result = _object(toolResult=_object(toolUseId=quoted(m["tool_call_id"]), content=_list(F.array(_object(text=quoted(m["content"]))))))
    images = F.transform(_parts(m), lambda p: _object(image=_object(format=quoted(F.regexp_extract(F.coalesce(p["media_type"], F.lit("")), "^image/(.*)$", 1)), source=_object(bytes=quoted(base64_text(p["data"]))))))
    turns = _turns(messages, {"assistant": "assistant", "user": "user", "blocks": "content"}, _blocks(_text_or(m, images, text), result, _said(m, calls, text)))
    whole = F.struct(*messages.columns)
    bad = F.exists(_parts(whole), lambda p: _present(p["url"]) | ~F.coalesce(p["media_type"], F.lit("")).rlike("^image/."))
    errors = messages.where(bad & F.coalesce(~F.col("role").isin("system", "assistant", "tool"), F.lit(True))).select(F.col("conv_id").alias("bad_id")).distinct()
    system = F.when(F.size("system") > 0, _list(F.transform("system", lambda s: _object(text=quoted(s)))))
    tools = F.when(F.size("tool_specs") > 0, _object(tools=_list(F.transform("tool_specs", lambda t: _object(toolSpec=_object(name=quoted(t["name"]), description=_if(_present(t["description"]), quoted(t["description"])), inputSchema=_object(json=t["schema"])))))))
    output = F.when(_schema().isNotNull(), _object(textFormat=_object(type=F.lit('"json_schema"'), structure=_object(jsonSchema=_object(name=F.lit('"output"'), schema=quoted(_schema()))))))
    rows = _joined(messages, requests, turns).join(errors, F.col("request_id") == F.col("bad_id"), "left").withColumn("error", F.when(F.col("bad_id").isNotNull(), "unsupported content"))
    return rows.select("request_id", F.when(F.col("error").isNull(), _object(messages=F.col("turns"), system=system, toolConfig=tools, outputConfig=output)).alias("body"), "error")
