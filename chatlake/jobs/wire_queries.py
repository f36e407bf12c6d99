"""Payloads built from the conversations, normalized and rendered, and the same in DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.functions.scalar import canonical_json
from chatlake.jobs.views import messages
from chatlake.operators import wire as W

_PARTS = "array<struct<kind:string,url:string,data:binary,media_type:string>>"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def _body(provider: str) -> Column:
    n, t = F.length("text"), F.col("turn")
    call = F.struct(F.concat(F.lit("c"), t).alias("id"), F.lit("function").alias("type"), F.struct(F.col("role").alias("name"), F.format_string('{"n": %d}', n).alias("arguments")).alias("function"))
    args = F.struct(n.alias("n"))
    if provider == "openai":
        value = F.struct(F.array(F.struct(F.struct(F.col("text").alias("content"), F.array(call).alias("tool_calls")).alias("message"))).alias("choices"), F.struct(n.alias("prompt_tokens"), t.alias("completion_tokens")).alias("usage"))
    elif provider == "anthropic":
        blocks = F.array(
            F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("struct<n:int>").alias("input")),
            F.struct(F.lit("thinking").alias("type"), F.lit("x").alias("text"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("struct<n:int>").alias("input")),
            F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.concat(F.lit("c"), t).alias("id"), F.col("role").alias("name"), args.alias("input")),
        )
        value = F.struct(blocks.alias("content"), F.struct(n.alias("input_tokens"), t.alias("output_tokens")).alias("usage"))
    elif provider == "gemini":
        none = F.lit(None).cast("struct<name:string,args:struct<n:int>>")
        parts = F.array(F.struct(F.col("text"), none.alias("functionCall")), F.struct(F.lit(None).cast("string").alias("text"), F.struct(F.col("role").alias("name"), args.alias("args")).alias("functionCall")))
        value = F.struct(F.array(F.struct(F.struct(parts.alias("parts")).alias("content"))).alias("candidates"), F.struct(n.alias("promptTokenCount"), t.alias("candidatesTokenCount")).alias("usageMetadata"))
    else:
        none = F.lit(None).cast("struct<toolUseId:string,name:string,input:struct<n:int>>")
        blocks = F.array(F.struct(F.col("text"), none.alias("toolUse")), F.struct(F.lit(None).cast("string").alias("text"), F.struct(F.concat(F.lit("c"), t).alias("toolUseId"), F.col("role").alias("name"), args.alias("input")).alias("toolUse")))
        value = F.struct(F.struct(F.struct(blocks.alias("content")).alias("message")).alias("output"), F.struct(n.alias("inputTokens"), t.alias("outputTokens")).alias("usage"))
    return F.to_json(value)


PROVIDERS = ("openai", "anthropic", "gemini", "bedrock")


def normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir).withColumn("provider", F.element_at(F.array(*map(F.lit, PROVIDERS)), (F.col("conv_id") % 4 + 1).cast("int")))
    body = F.lit("{")
    for p in PROVIDERS:
        body = F.when(F.col("provider") == p, _body(p)).otherwise(body)
    payloads = rows.select("conv_id", "turn", "provider", F.when(F.col("turn") == 5, F.lit('{"choices":[],"candidates":[]}')).otherwise(body).alias("body"))
    out = W.normalize_responses(payloads)
    call = F.get("tool_calls", F.lit(0))
    return out.select("conv_id", "turn", "content", call["id"].alias("call_id"), call["name"].alias("call_name"), F.regexp_replace(call["args"], " ", "").alias("args"), "input_tokens", "output_tokens", F.col("error").isNotNull().alias("failed"))


_SPECS = "array<struct<name:string,description:string,schema:string>>"
_LOOK, _OUTPUT = '{"properties":{"q":{"type":"string"}},"type":"object"}', '{"properties":{"x":{"type":"integer"}},"type":"object"}'


def _requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Messages with images on users' turns, inline and by address, and requests with tools and output schemas."""
    n = F.col("pos") % 3
    part = F.struct(F.lit("image").alias("kind"), F.when(n == 1, F.format_string("https://img.example/%d.png", "pos")).alias("url"), F.when(n == 0, F.encode("content", "UTF-8")).alias("data"), F.lit("image/png").alias("media_type"))
    rows = messages(spark, sf_dir).withColumn("content", F.concat("content", F.lit(' "q"\n\u00e9')))
    rows = rows.withColumn("parts", F.when((F.col("role") == "user") & (n < 2), F.array(part)).cast(_PARTS))
    tool = lambda name, description: F.struct(F.lit(name).alias("name"), F.lit(description).alias("description"), F.lit(_LOOK).alias("schema"))
    specs = F.when(F.col("request_id") % 2 == 0, F.array(tool("look", "finds"), tool("put", ""))).otherwise(F.array().cast(_SPECS))
    requests = rows.select(F.col("conv_id").alias("request_id")).distinct()
    return rows, requests.select("request_id", specs.alias("tool_specs"), F.when(F.col("request_id") % 3 == 0, _OUTPUT).otherwise("").alias("output_schema"))


def rendered(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """request_id, body, error."""
    rows, requests = _requests(spark, sf_dir)
    if kind in ("openai", "anthropic"):
        return (W.render_openai if kind == "openai" else W.render_anthropic)(rows, requests, "m").withColumn("error", F.lit(None).cast("string"))
    return (W.render_gemini if kind == "gemini" else W.render_bedrock)(rows, requests)


def render(kind: str):
    """Each request's whole body, keys sorted, or the error that it has instead."""
    return lambda spark, sf_dir: rendered(spark, sf_dir, kind).select("request_id", canonical_json(F.col("body")).alias("body"), "error")


QUERIES = {"normalize_responses": normalize} | {f"render_{k}": render(k) for k in PROVIDERS}

# Bodies as DuckDB builds them, keys in their order. Of each message: text, call and image, by provider.
_TEXT = {"anthropic": """'{"text":' || c || ',"type":"text"}'"""}
_CALL = {
    "openai": """'{"function":{"arguments":"{}","name":' || n || '},"id":' || i || ',"type":"function"}'""",
    "anthropic": """'{"id":' || i || ',"input":{},"name":' || n || ',"type":"tool_use"}'""",
    "gemini": """'{"functionCall":{"args":{},"name":' || n || '}}'""",
    "bedrock": """'{"toolUse":{"input":{},"name":' || n || ',"toolUseId":' || i || '}}'""",
}
_RESULT = {
    "anthropic": """'{"content":' || c || ',"tool_use_id":' || t || ',"type":"tool_result"}'""",
    "gemini": """'{"functionResponse":{"name":' || n || ',"response":{"result":' || c || '}}}'""",
    "bedrock": """'{"toolResult":{"content":[{"text":' || c || '}],"toolUseId":' || t || '}}'""",
}
_IMAGE = {
    "openai": """'{"image_url":{"url":"' || coalesce(url, 'data:image/png;base64,' || data) || '"},"type":"image_url"}'""",
    "anthropic": """'{"source":{' || case when url is null then '"data":"' || data || '","media_type":"image/png","type":"base64"' else '"type":"url","url":"' || url || '"' end || '},"type":"image"}'""",
    "gemini": """case when url is null then '{"inlineData":{"data":"' || data || '","mimeType":"image/png"}}' else '{"fileData":{"fileUri":"' || url || '"}}' end""",
    "bedrock": """'{"image":{"format":"png","source":{"bytes":"' || data || '"}}}'""",
}
_TOOL = {
    "openai": ('"tools":[', '{"function":{%s"name":"%s","parameters":' + _LOOK + '},"type":"function"}', "]"),
    "anthropic": ('"tools":[', '{%s"input_schema":' + _LOOK + ',"name":"%s"}', "]"),
    "gemini": ('"tools":[{"functionDeclarations":[', '{%s"name":"%s","parameters":' + _LOOK + "}", "]}]"),
    "bedrock": ('"toolConfig":{"tools":[', '{"toolSpec":{%s"inputSchema":{"json":' + _LOOK + '},"name":"%s"}}', "]}"),
}
_FORM = {
    "openai": ',"response_format":{"json_schema":{"name":"output","schema":' + _OUTPUT + ',"strict":true},"type":"json_schema"}',
    "anthropic": ',"output_config":{"format":{"schema":' + _OUTPUT + ',"type":"json_schema"}}',
    "gemini": ',"generationConfig":{"responseMimeType":"application/json","responseSchema":' + _OUTPUT + "}",
    "bedrock": ',"outputConfig":{"textFormat":{"structure":{"jsonSchema":{"name":"output","schema":"' + _OUTPUT.replace('"', '\\"') + '"}},"type":"json_schema"}}',
}
_MESSAGES = """with e as (select user_id as id, event_id as pos, case event_type when 'signup' then 'user' when 'error' then 'system' when 'click' then 'tool' else 'assistant' end as role,
  event_type || ' ' || event_id || ' "q"' || chr(10) || 'é' as content, regexp_extract(props, '[0-9]+', 0)::int as k, event_type from events),
m as (select id, pos, role, content, to_json(content)::varchar as c, case when event_type = 'view' then '"call-' || k % 12 || '"' end as i, case when event_type = 'click' then '"call-' || k % 12 || '"' end as t,
  case when event_type in ('view', 'click') then '"tool_' || k % 4 || '"' end as n, role = 'user' and pos % 3 < 2 as shown, case when pos % 3 = 1 then 'https://img.example/' || pos || '.png' end as url, base64(encode(content)) as data from e)"""


def _bodies(kind: str) -> str:
    """SQL for id, body, error."""
    head, tool, tail = _TOOL[kind]
    tools = f"case when id % 2 = 0 then ',{head}{tool % (chr(34) + 'description' + chr(34) + ':' + chr(34) + 'finds' + chr(34) + ',', 'look')},{tool % ('', 'put')}{tail}' else '' end"
    form = f"case when id % 3 = 0 then '{_FORM[kind]}' else '' end"
    if kind == "openai":
        one = f"""'{{"content":' || case when shown then '[{{"text":' || c || ',"type":"text"}},' || {_IMAGE[kind]} || ']' else c end || ',"role":"' || role || '"' || coalesce(',"tool_call_id":' || t, '') || coalesce(',"tool_calls":[' || {_CALL[kind]} || ']', '') || '}}'"""
        return f"""{_MESSAGES} select id as request_id, '{{"messages":[' || string_agg({one}, ',' order by pos) || '],"model":"m"' || {form} || {tools} || '}}' as body, cast(null as string) as error from m group by id"""
    text = _TEXT.get(kind, """'{"text":' || c || '}'""")
    blocks = f"""case role when 'assistant' then {text} || coalesce(',' || {_CALL[kind]}, '') when 'tool' then {_RESULT[kind]} else {text} || case when shown then ',' || {_IMAGE[kind]} else '' end end"""
    system = {"anthropic": """',"system":' || to_json(string_agg(content, chr(10) || chr(10) order by pos))::varchar""", "gemini": """',"systemInstruction":{"parts":[' || string_agg('{"text":' || c || '}', ',' order by pos) || ']}'""", "bedrock": """',"system":[' || string_agg('{"text":' || c || '}', ',' order by pos) || ']'"""}[kind]
    inner, outer, assistant = {"anthropic": ("content", "messages", "assistant"), "gemini": ("parts", "contents", "model"), "bedrock": ("content", "messages", "assistant")}[kind]
    turn = f"""case when wire = 'assistant' then '{assistant}' else 'user' end"""
    turn = f"""'{{"{inner}":[' || blocks || '],"role":"' || {turn} || '"}}'"""
    order = {"anthropic": f"""'{{"max_tokens":1024,"messages":[' || turns || '],"model":"m"' || {form} || coalesce(system, '') || {tools} || '}}'""", "gemini": f"""'{{"contents":[' || turns || ']' || {form} || coalesce(system, '') || {tools} || '}}'""", "bedrock": f"""'{{"messages":[' || turns || ']' || {form} || coalesce(system, '') || {tools} || '}}'"""}[kind]
    error = {"anthropic": "cast(null as string)", "gemini": "case when id % 6 = 0 then 'encode request: an output schema cannot be combined with tools' end", "bedrock": "case when id in (select id from m where shown and url is not null) then 'unsupported content' end"}[kind]
    return f"""{_MESSAGES}, w as (select *, case when role = 'assistant' then 'assistant' else 'user' end as wire, {blocks} as block from m where role <> 'system'),
s as (select *, case when lag(wire) over (partition by id order by pos) = wire then 0 else 1 end as new from w), g as (select *, sum(new) over (partition by id order by pos) as turn from s),
b as (select id, turn, wire, string_agg(block, ',' order by pos) as blocks from g group by all), a as (select id, string_agg({turn}, ',' order by turn) as turns from b group by id),
y as (select id, {system} as system from m where role = 'system' group by id), r as (select id, {order} as body, {error} as error from a left join y using (id))
select id as request_id, case when error is null then body end as body, error from r"""


ORACLE_SQL = {
    "normalize_responses": """with c as (select *, conv_id % 4 as p, turn = 5 and conv_id % 4 in (0, 2) as failed, turn = 5 as bare from conversations)
select conv_id, turn, case when failed then null when bare then '' else text end as content, case when bare then null when p = 2 then 'call-1' else 'c' || turn end as call_id, case when bare then null else role end as call_name,
case when bare then null else '{"n":' || length(text) || '}' end as args, case when failed then null when bare then 0 else length(text) end as input_tokens, case when failed then null when bare then 0 else turn end as output_tokens, failed from c""",

} | {f"render_{k}": _bodies(k) for k in PROVIDERS}
