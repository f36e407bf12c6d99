"""Streams, pages, JSON-RPC logs and stored conversations over the given tables, and the same in DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.functions.scalar import call_result_text, canonical_json, command_output, content_text, data_url, is_text_media_type, normalize_args, truncate_bytes
from chatlake.jobs import live
from chatlake.jobs.views import messages, with_views
from chatlake.jobs.wire_queries import ORACLE_SQL as WIRE_ORACLES
from chatlake.jobs.wire_queries import rendered
from chatlake.operators import history as H
from chatlake.operators import rpc as RPC
from chatlake.operators import streams as S
from chatlake.operators import text as X
from chatlake.sources import messages as M
from chatlake.sources import streams as SRC
from chatlake.sources.shared import scratch_folder

STEP = 16


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("stream_id"), "text")


def _fragments(turns: DataFrame) -> DataFrame:
    """stream_id, seq, piece, n: each text in pieces of 16 characters."""
    n = F.greatest(F.ceil(F.length("text") / STEP), F.lit(1)).cast("int")
    return turns.select("stream_id", "text", n.alias("n")).select("stream_id", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("seq"), "text").select("stream_id", "seq", "n", F.substr("text", F.col("seq") * STEP + 1, F.lit(STEP)).alias("piece"))


def _sse(fragments: DataFrame, payload: Column, tail: list[str]) -> DataFrame:
    """Bodies of comments and data lines, the given ones last."""
    lines = fragments.select("stream_id", F.struct("seq", F.concat(F.lit(": keep-alive\nevent: x\ndata: "), payload, F.lit("\n\n")).alias("line")).alias("l"))
    bodies = lines.groupBy("stream_id").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    return bodies.select("stream_id", F.concat(F.array_join("ls.line", ""), *(F.lit(f"data: {t}\n\n") for t in tail)).alias("body"))


def _openai(spark: SparkSession, sf_dir: str) -> DataFrame:
    call = F.array(F.struct(F.lit(1).alias("index"), F.when(F.col("seq") == 0, "c9").alias("id"), F.struct(F.when(F.col("seq") == 0, "look").alias("name"), F.when(F.col("seq") == 0, '{"n":').otherwise(F.when(F.col("seq") == F.col("n") - 1, "1}").otherwise("")).alias("arguments")).alias("function")))
    payload = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("piece").alias("content"), F.when(F.col("n") > 1, call).alias("tool_calls")).alias("delta"))).alias("choices"), F.when(F.col("seq") == F.col("n") - 1, F.struct(F.col("n").alias("prompt_tokens"), F.lit(7).alias("completion_tokens"))).alias("usage")))
    return _sse(_fragments(_turns(spark, sf_dir)), payload, ["[DONE]", '{"choices":[{"delta":{"content":"late"}}]}'])


def parsed_sse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every data line in its place, read back from its JSON."""
    content = F.get_json_object("data", "$.choices[0].delta.content")
    return SRC.parse_sse(_openai(spark, sf_dir)).select("stream_id", "seq", content.alias("content"), (F.col("data") == S.DONE).alias("done"))


def parsed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event in its place; the last one's data is in two lines."""
    bodies = _openai(spark, sf_dir).withColumn("body", F.concat("body", F.lit('data: {"choices":[{"delta":\ndata: {"content":"two"}}]}\n\n')))
    content = F.get_json_object("data", "$.choices[0].delta.content")
    return SRC.parse_sse_events(bodies).select("stream_id", "seq", content.alias("content"), F.contains("data", F.lit("\n")).alias("lines"))


_DELTAS = ("stream_id", "seq", "ord", "content", "call_key", "call_id", "call_name", "args", "input_tokens", "output_tokens", "ends", "error")


def delta_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each payload forwards: text, the first call's parts, usage, the end, and what comes late."""
    return S.openai_fragments(SRC.parse_sse(_openai(spark, sf_dir))).select(*_DELTAS)


def delta_rows_anthropic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.anthropic_fragments(SRC.parse_sse(_anthropic(spark, sf_dir))).select("stream_id", "seq", "content", "block", "is_start", "call_id", "call_name", "args", "input_tokens", "output_tokens", "ends", "error")


def delta_rows_of(provider: str):
    """What the streams of one provider forward."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = live.bodies(spark, sf_dir).where(F.col("provider") == provider)
        payloads = SRC.decode_event_frames(own).withColumn("data", F.coalesce("payload", F.lit(""))) if provider == "bedrock" else SRC.parse_sse(own.select("stream_id", F.col("body").cast("string").alias("body")))
        return S.delta_rows(payloads, provider)

    return query


def assemble_openai(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.assemble_openai(SRC.parse_sse(_openai(spark, sf_dir)))
    call = F.get("tool_calls", F.lit(1))
    return out.select("stream_id", "content", F.size("tool_calls").alias("calls"), call["id"].alias("call_id"), call["name"].alias("name"), call["args"].alias("args"), "input_tokens", "output_tokens", "error")


def _anthropic(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.lit(0).alias("index"), F.struct(F.lit("text_delta").alias("type"), F.col("piece").alias("text")).alias("delta")))
    tail = [
        '{"type":"content_block_start","index":1,"content_block":{"type":"tool_use","id":"t1","name":"look"}}',
        '{"type":"content_block_delta","index":1,"delta":{"type":"input_json_delta","partial_json":"{\\"a\\":"}}',
        '{"type":"content_block_delta","index":1,"delta":{"type":"input_json_delta","partial_json":"2}"}}',
        '{"type":"message_start","message":{"usage":{"input_tokens":11,"output_tokens":1}}}',
        '{"type":"message_delta","usage":{"output_tokens":5}}',
        '{"type":"message_stop"}',
        '{"type":"error","error":{"type":"api_error","message":"late"}}',
    ]
    return _sse(_fragments(_turns(spark, sf_dir)), payload, tail)


def assemble_anthropic(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.assemble_anthropic(SRC.parse_sse(_anthropic(spark, sf_dir)))
    call = F.get("tool_calls", F.lit(0))
    return out.select("stream_id", "content", call["id"].alias("call_id"), call["name"].alias("name"), call["args"].alias("args"), "input_tokens", "output_tokens", "error")


def assemble_gemini(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.col("piece").alias("text"))).alias("parts")).alias("content"))).alias("candidates"), F.struct(F.col("seq").alias("promptTokenCount"), F.lit(1).alias("candidatesTokenCount")).alias("usageMetadata")))
    tail = ['{"candidates":[{"content":{"parts":[{"functionCall":{"name":"look","args":{"a":3}}},{"functionCall":{"name":"look"}}]}}]}']
    out = S.assemble_gemini(SRC.parse_sse(_sse(_fragments(_turns(spark, sf_dir)), payload, tail)))
    return out.select("stream_id", "content", F.array_join("tool_calls.id", ",").alias("ids"), F.array_join("tool_calls.args", ",").alias("args"), "input_tokens", "output_tokens", "error")


def assemble_bedrock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of each text in block 0, half in block 1, so that one line break joins them."""
    f = _fragments(_turns(spark, sf_dir))
    block = F.when(F.col("seq") < F.ceil(F.col("n") / 2), 0).otherwise(1).cast("int")
    said = f.select("stream_id", F.col("seq").cast("bigint").alias("seq"), F.lit("contentBlockDelta").alias("kind"), F.to_json(F.struct(block.alias("contentBlockIndex"), F.struct(F.col("piece").alias("text")).alias("delta"))).alias("payload"))
    ends = _turns(spark, sf_dir).select("stream_id", F.posexplode(F.array(F.struct(F.lit("messageStop").alias("kind"), F.lit("{}").alias("payload")), F.struct(F.lit("metadata").alias("kind"), F.lit('{"usage":{"inputTokens":4,"outputTokens":9}}').alias("payload")))).alias("i", "e"))
    frames = said.union(ends.select("stream_id", (F.col("i") + (1 << 40)).cast("bigint"), "e.kind", "e.payload"))
    frames = frames.select("stream_id", "seq", F.create_map(F.lit(":event-type"), F.col("kind")).alias("headers"), "payload", F.lit(None).cast("string").alias("error"))
    return S.assemble_bedrock(frames).select("stream_id", "content", "input_tokens", "output_tokens", "error")


def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", X.html_to_text(F.col("html")).alias("text"))


def _responses(pages: DataFrame, body: Column) -> DataFrame:
    return pages.select("page_id", F.when(F.col("page_id") % 7 == 0, 404).otherwise(200).alias("status"), F.when(F.col("page_id") % 5 == 0, "image/png").when(F.col("page_id") % 5 == 1, "Text/Plain; charset=utf-8").otherwise("text/html").alias("content_type"), body.alias("body"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its own bytes: the cap, then HTML to text, then the marker."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return X.page_text(_responses(pages, F.col("html")), 3000).select("page_id", "text", "error")


_CAP = 200


def truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its own bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.octet_length("text").alias("bytes"), truncate_bytes(F.col("text"), _CAP, "[fileread: file truncated at {n} bytes]").alias("text"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session a customer: requests from orders, responses to most of them, notifications between."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("k"))
    request = o.select("session_id", (F.col("k") * 10).alias("seq"), F.format_string('{"jsonrpc":"2.0","id":%d,"method":"tools/call","params":{}}', F.col("k")).alias("raw"))
    answered = o.where("k % 4 <> 0")
    body = F.when(F.col("k") % 4 == 1, F.format_string('{"jsonrpc":"2.0","id":%d.0,"result":{"ok":true}}', F.col("k"))).when(F.col("k") % 4 == 2, F.format_string('{"jsonrpc":"2.0","id":%d,"error":{"code":-32601,"message":"no"}}', F.col("k"))).otherwise(F.format_string('{"jsonrpc":"2.0","id":%d}', F.col("k")))
    response = answered.select("session_id", (F.col("k") * 10 + 5).alias("seq"), body.alias("raw"))
    other = o.select("session_id", (F.col("k") * 10 + 7).alias("seq"), F.lit('{"jsonrpc":"2.0","method":"ping"}').alias("raw")).union(answered.select("session_id", (F.col("k") * 10 + 8).alias("seq"), F.format_string('{"id":%d,"result":{"late":1}}', F.col("k"))))
    return request.union(response).union(other)


def tool_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("k"))
    request = o.select("session_id", (F.col("k") * 10).alias("seq"), F.format_string('{"id":%d,"method":"tools/list"}', F.col("k")).alias("raw"))
    page = F.format_string('{"id":%d,"result":{"tools":[{"name":"a%d","description":"d"},{"name":"b%d","inputSchema":{"x":1}}]%s}}', F.col("k"), F.col("k"), F.col("k"), F.when(F.col("k") % 3 == 0, "").otherwise(',"nextCursor":"n"'))
    return RPC.collect_tool_lists(request.union(o.select("session_id", (F.col("k") * 10 + 5).alias("seq"), page.alias("raw"))))


def result_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    items = F.array(F.struct(F.lit("text").alias("type"), F.col("p_name").alias("text")), F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")))
    n = F.col("p_partkey")
    return parts.select(n.alias("id"), call_result_text(F.when(n % 3 == 0, F.slice(items, 1, 0)).otherwise(items), n % 2 == 0, F.lit("look")).alias("text"))


def scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    n = F.col("p_partkey")
    raw = F.when(n % 3 == 0, F.format_string('{"b": %d.0, "a":1}', n)).when(n % 3 == 1, F.lit("not json")).otherwise(F.lit(' ["x"] '))
    args = F.when(n % 2 == 0, F.lit("  ")).otherwise(F.lit(' {"a": 1} '))
    kind = F.when(n % 4 == 0, "TEXT/html; charset=x").when(n % 4 == 1, "application/json").when(n % 4 == 2, "image/png")
    value = F.when(n % 3 == 0, F.lit('"hi"')).when(n % 3 == 1, F.lit("[1]")).otherwise(F.lit("null"))
    return parts.select(n.alias("id"), canonical_json(raw).alias("canonical"), normalize_args(args).alias("args"), is_text_media_type(kind).alias("is_text"), content_text(value).alias("content"), command_output(F.encode(F.col("p_name"), "utf-8"), (n % 3).cast("int"), 10).alias("output"))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = M.from_message_json(M.to_message_json(messages(spark, sf_dir)).withColumn("extra", F.lit(1)))
    call = F.get("tool_calls", F.lit(0))
    return back.select("conv_id", "pos", "role", "content", call["id"].alias("call_id"), call["args"].alias("args"), "tool_call_id")


def _hex(number: Column, width: int) -> Column:
    return F.lpad(F.hex(number), width, "0")


def _frame(kind: Column, payload: Column) -> Column:
    """The bytes, in hexadecimal, of a binary frame with one header, its event type, and a payload."""
    name = F.encode(F.lit(":event-type"), "UTF-8")
    value = F.encode(kind, "UTF-8")
    header = F.concat(_hex(F.octet_length(name), 2), F.hex(name), F.lit("07"), _hex(F.octet_length(value), 4), F.hex(value))
    size, body = F.length(header) / 2, F.hex(F.encode(payload, "UTF-8"))
    start = F.concat(_hex((size + F.length(body) / 2 + 16).cast("bigint"), 8), _hex(size.cast("bigint"), 8))
    return F.concat(start, _hex(F.crc32(F.unhex(start)), 8), header, body, _hex(F.crc32(F.unhex(F.concat(start, header, body))), 8))


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes to frames to messages; every fifth stream's last frame is spoilt, every seventh's cut off."""
    f = _fragments(_turns(spark, sf_dir))
    piece = F.to_json(F.struct(F.lit(0).alias("contentBlockIndex"), F.struct(F.col("piece").alias("text")).alias("delta")))
    one = f.select("stream_id", F.struct("seq", _frame(F.lit("contentBlockDelta"), piece).alias("hex")).alias("f"))
    said = one.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["hex"]), "").alias("hex"))
    end = F.concat(_frame(F.lit("messageStop"), F.lit("{}")), _frame(F.lit("metadata"), F.lit('{"usage":{"inputTokens":4,"outputTokens":9}}')))
    whole = F.concat("hex", end)
    spoilt = F.when(F.col("stream_id") % 5 == 0, F.concat(F.substr(whole, F.lit(1), F.length(whole) - 8), F.lit("00000000"))).when(F.col("stream_id") % 7 == 0, F.substr(whole, F.lit(1), F.length(whole) - 8)).otherwise(whole)
    return S.assemble_bedrock(SRC.decode_event_frames(said.select("stream_id", F.unhex(spoilt).alias("body")))).select("stream_id", "content", "input_tokens", "output_tokens", "error")


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part a turn, each kind of fault in turn."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    n = (F.col("conv_id") + F.col("turn")) % 6
    part = F.struct(
        F.when(n == 1, "audio").otherwise("image").alias("kind"),
        F.when(n.isin(2, 5), "http://x/y.png").otherwise("").alias("url"),
        F.when(n.isin(0, 2, 4), F.encode("text", "UTF-8")).alias("data"),
        F.when(n == 0, "image/png").otherwise("").alias("media_type"),
    )
    return H.validate_parts(rows.select("conv_id", F.col("turn").alias("pos"), "role", F.array(part).alias("parts")))


def data_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", data_url(F.lit("text/plain"), F.encode("text", "UTF-8")).alias("url"))


def sniffed(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = ("89504E470D0A1A0A", "255044462D312E37", "0001020304", "20203C68746D6C3E", "6869", "47494638396100", "FFD8FFE0")
    n = F.col("p_partkey") % len(heads)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), X.sniff_content_type(F.unhex(F.element_at(F.array(*map(F.lit, heads)), (n + 1).cast("int")))).alias("media_type"))


def message_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored conversations through real files."""
    path = scratch_folder(spark, "messages")
    M.write_messages(messages(spark, sf_dir), path)
    call = F.get("tool_calls", F.lit(0))
    return M.read_messages(spark, path).select("conv_id", "pos", "role", "content", call["id"].alias("call_id"), call["args"].alias("args"), "tool_call_id")


def request_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered bodies through real files: a body a line, requests with errors left out."""
    path = scratch_folder(spark, "requests")
    M.write_requests(rendered(spark, sf_dir, "gemini"), path)
    return spark.read.text(path).select(canonical_json(F.col("value")).alias("body"))


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file a nation: a third in binary, each with the suppliers' names in order."""
    path = scratch_folder(spark, "files")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    lines = s.groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_list("s_name")), "|").alias("line"))
    lines.select(F.when(F.col("s_nationkey") % 3 == 0, F.concat(F.lit("\x01"), "line")).otherwise(F.col("line")), "s_nationkey").write.partitionBy("s_nationkey").text(path)
    read = M.read_text_files(spark, path, 100)
    return read.select(F.regexp_extract("path", "s_nationkey=(\\d+)", 1).cast("int").alias("nation"), "media_type", "text", "error")


QUERIES = {
    "parse_sse": parsed_sse,
    "parse_sse_events": parsed_events,
    "delta_rows": delta_rows,
    "delta_rows_anthropic": delta_rows_anthropic,
    "forwarded_anthropic": delta_rows_of("anthropic"),
    "delta_rows_gemini": delta_rows_of("gemini"),
    "delta_rows_bedrock": delta_rows_of("bedrock"),
    "assemble_openai": assemble_openai,
    "assemble_anthropic": assemble_anthropic,
    "assemble_gemini": assemble_gemini,
    "assemble_bedrock": assemble_bedrock,
    "html_to_text": html_to_text,
    "truncate_bytes": truncated,
    "match_rpc": lambda s, d: RPC.match_rpc(_log(s, d)),
    "collect_tool_lists": tool_lists,
    "call_result_text": result_text,
    "scalar_functions": scalars,
    "stored_messages": stored,
    "decode_event_frames": event_frames,
    "validate_parts": validated,
    "data_url": data_urls,
    "sniff_content_type": sniffed,
    "message_files": message_files,
    "request_files": request_files,
    "text_files": text_files,
}

#: Queries that DuckDB can't express; tests compare them with sequential Python.
WITHOUT_SQL = {
    "page_text": page_text,
}

_T = "with t as (select conv_id * 1000 + turn as stream_id, text, cast(greatest(ceil(length(text) / 16.0), 1) as int) as n from conversations)"
_F = _T + ", f as (select stream_id, text, n, unnest(range(n)) as k from t)"
_BLOCKS = "|".join(sorted(X.BLOCKS, key=lambda x: (-len(x), x)))
_HTML = f"""regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html,
 '(?is)<!--.*?-->|<script(?:\\s[^>]*)?>.*?</script[^>]*>|<style(?:\\s[^>]*)?>.*?</style[^>]*>', '', 'g'),
 '(?is)</?(?:{_BLOCKS})(?:[\\s/](?:"[^"]*"|''[^'']*''|[^>"''])*)?>', chr(10), 'g'),
 '(?is)<(?:"[^"]*"|''[^'']*''|[^>"''])*>', '', 'g'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'),
 '[ \\t\\r]*\\n\\s*', chr(10), 'g'), '^\\s+', '', 'g'), '\\s+$', '', 'g')"""



def _live(provider: str, lines: int) -> str:
    """The text that the streams of a provider forward; a payload has so many lines."""
    seq = f"{lines} * k + 1" if lines > 1 else "k"
    return f"""with s as (select *, cast(ceil(length(text) / 48.0) as bigint) as n, (stream_id // 4) % 4 as kind from (select conv_id * 1000 + turn as stream_id, coalesce(text, '') as text from conversations)
 where ['openai', 'anthropic', 'gemini', 'bedrock'][stream_id % 4 + 1] = '{provider}'),
f as (select *, unnest(range(n)) as k from s) select stream_id, cast({seq} as {'int' if lines > 1 else 'bigint'}) as seq, cast(0 as int) as ord, substr(text, 48 * k + 1, 48) as content, cast(null as int) as call_key, cast(null as string) as call_id, cast(null as string) as call_name, cast(null as string) as args from f union all"""


ORACLE_SQL = {
    "parse_sse": f"""{_F} select stream_id, cast(4 * k + 2 as int) as seq, substr(text, 16 * k + 1, 16) as content, false as done from f
union all select stream_id, 4 * n, null, true from t union all select stream_id, 4 * n + 2, 'late', false from t""",
    "parse_sse_events": f"""{_F} select stream_id, cast(k as int) as seq, substr(text, 16 * k + 1, 16) as content, false as lines from f
union all select stream_id, n, null, false from t union all select stream_id, n + 1, 'late', false from t union all select stream_id, n + 2, 'two', true from t""",
    "delta_rows": f"""{_F} select stream_id, cast(4 * k + 2 as int) as seq, cast(null as int) as ord, substr(text, 16 * k + 1, 16) as content, cast(null as int) as call_key, cast(null as string) as call_id, cast(null as string) as call_name, cast(null as string) as args,
cast(case when k = n - 1 then n end as bigint) as input_tokens, cast(case when k = n - 1 then 7 end as bigint) as output_tokens, false as ends, cast(null as string) as error from f
union all select stream_id, 4 * k + 2, 1, null, 1, case when k = 0 then 'c9' end, case when k = 0 then 'look' end, case when k = 0 then '{{"n":' when k = n - 1 then '1}}' else '' end, null, null, null, null from f where n > 1
union all select stream_id, 4 * n, null, null, null, null, null, null, null, null, true, null from t
union all select stream_id, 4 * n + 2, null, 'late', null, null, null, null, null, null, false, null from t""",
    "delta_rows_anthropic": f"""{_F}, tail(i, block, starts, id, name, args, tin, tout, ends, error) as (values (0, 1, true, 't1', 'look', null, null, null, false, null), (1, 1, false, null, null, '{{"a":', null, null, false, null), (2, 1, false, null, null, '2}}', null, null, false, null),
(3, null, false, null, null, null, 11, 1, false, null), (4, null, false, null, null, null, null, 5, false, null), (5, null, false, null, null, null, null, null, true, null), (6, null, false, null, null, null, null, null, false, 'api_error: late'))
select stream_id, cast(4 * k + 2 as int) as seq, substr(text, 16 * k + 1, 16) as content, cast(null as int) as block, false as is_start, cast(null as string) as call_id, cast(null as string) as call_name, cast(null as string) as args, cast(null as bigint) as input_tokens, cast(null as bigint) as output_tokens, false as ends, cast(null as string) as error from f
union all select stream_id, 4 * n + 2 * i, null, block, starts, id, name, args, tin, tout, ends, error from t, tail""",
    "forwarded_anthropic": f"""{_live('anthropic', 3)} select stream_id, cast(3 * (n + i) + 1 as int), 0, null, 0, case when i = 2 then 'c1' end, case when i = 2 then 'look' end, case when i = 2 then '{{"a":' else '1}}' end from s, range(2, 4) t(i) where kind = 3""",
    "delta_rows_gemini": f"""{_live('gemini', 3)} select stream_id, cast(3 * n + 1 as int), cast(i as int), null, cast(i - 1 as int), 'call-' || i, case when i = 1 then 'look' else 'put' end, case when i = 1 then '{{"a":1}}' else '{{}}' end from s, range(1, 3) t(i) where kind = 3""",
    "delta_rows_bedrock": f"""{_live('bedrock', 1)} select stream_id, n + i, 0, null, case when i = 1 then 1 else 0 end, case i when 0 then 'c1' when 1 then 'c3' end, case i when 0 then 'look' when 1 then 'put' end, case i when 2 then '{{"a":' when 3 then '1}}' else '' end from s, range(4) t(i) where kind = 3""",
    "assemble_openai": f"""{_T} select stream_id, text as content, case when n > 1 then 2 else 0 end as calls, case when n > 1 then 'c9' end as call_id, case when n > 1 then 'look' end as name, case when n > 1 then '{{"n":1}}' end as args,
cast(n as bigint) as input_tokens, cast(7 as bigint) as output_tokens, cast(null as string) as error from t""",
    "assemble_anthropic": f"""{_T} select stream_id, text as content, 't1' as call_id, 'look' as name, '{{"a":2}}' as args, cast(11 as bigint) as input_tokens, cast(5 as bigint) as output_tokens, cast(null as string) as error from t""",
    "assemble_gemini": f"""{_T} select stream_id, text as content, 'call-1,call-2' as ids, '{{"a":3}},{{}}' as args, cast(n - 1 as bigint) as input_tokens, cast(1 as bigint) as output_tokens, cast(null as string) as error from t""",
    "assemble_bedrock": f"""{_T} select stream_id, case when n < 2 then text else substr(text, 1, cast(ceil(n / 2.0) as int) * 16) || chr(10) || substr(text, cast(ceil(n / 2.0) as int) * 16 + 1) end as content, cast(4 as bigint) as input_tokens, cast(9 as bigint) as output_tokens, cast(null as string) as error from t""",
    "html_to_text": f"select page_id, {_HTML} as text from pages",
    # the longest prefix of whole characters within the cap, and one mark for a character that the cap cuts
    "truncate_bytes": f"""with d as (select doc_id, text, strlen(text) as bytes, case when strlen(text) > {_CAP} then list_max(list_filter(range(0, {_CAP} + 1), lambda n: strlen(left(text, n)) <= {_CAP})) end as whole from documents)
select doc_id, cast(bytes as int) as bytes, case when bytes > {_CAP} then left(text, whole) || case when strlen(left(text, whole)) < {_CAP} then chr(65533) else '' end || chr(10) || chr(10) || '[fileread: file truncated at {_CAP} bytes]' else text end as text from d""",
    "match_rpc": """select o_custkey as session_id, o_orderkey * 10 as seq, cast(o_orderkey as string) as id, 'tools/call' as method, case when o_orderkey % 4 <> 0 then o_orderkey * 10 + 5 end as response_seq,
case when o_orderkey % 4 = 1 then '{"ok":true}' end as result, case o_orderkey % 4 when 0 then 'no response' when 2 then 'json-rpc error -32601: no' when 3 then 'response has no result' end as error from orders""",
    "collect_tool_lists": """with p as (select o_custkey as session_id, o_orderkey as k, coalesce(sum((o_orderkey % 3 = 0)::int) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding), 0) as closed from orders),
t as (select session_id, k, 0 as i, 'a' || k as name, 'd' as description, '{"type":"object"}' as schema from p where closed = 0 union all select session_id, k, 1, 'b' || k, '', '{"x":1}' from p where closed = 0)
select session_id, cast(row_number() over (partition by session_id order by k, i) - 1 as int) as ord, name, description, schema from t""",
    "call_result_text": """with x as (select p_partkey as id, case when p_partkey % 3 = 0 then '' else p_name || chr(10) || '[mcp: unsupported image content]' end as t from part)
select id, case when id % 2 = 0 then 'tool look failed' || case when t = '' then '' else ': ' || t end else t end as text from x""",
    "scalar_functions": """select p_partkey as id, case p_partkey % 3 when 0 then '{"a":1,"b":' || p_partkey || '}' when 1 then 'not json' else '["x"]' end as canonical, case when p_partkey % 2 = 0 then '{}' else '{"a": 1}' end as args, p_partkey % 4 < 2 as is_text,
case when p_partkey % 3 = 0 then 'hi' else '' end as content, (case when strlen(p_name) > 10 then substr(p_name, 1, 10) || chr(10) || chr(10) || '[shell: output truncated at 10 bytes]' else p_name end) || case when p_partkey % 3 = 0 then '' else chr(10) || chr(10) || '[shell: exited with status ' || (p_partkey % 3) || ']' end as output from part""",
    "stored_messages": f"""{with_views('v_messages')} select conv_id, cast(row_number() over (partition by conv_id order by v_messages.pos) - 1 as int) as pos, role, content, call_id, case when call_id is not null then '{{}}' end as args, tool_call_id from v_messages""",
    "decode_event_frames": """select conv_id * 1000 + turn as stream_id, case when bad is null then text end as content, case when bad is null then cast(4 as bigint) end as input_tokens, case when bad is null then cast(9 as bigint) end as output_tokens, bad as error
from (select *, case when (conv_id * 1000 + turn) % 5 = 0 then 'the frame doesn''t match its checksum' when (conv_id * 1000 + turn) % 7 = 0 then 'the frame is cut off' end as bad from conversations)""",
    "validate_parts": """with p as (select conv_id, turn as pos, role, (conv_id + turn) % 6 as n, strlen(text) > 0 as said from conversations),
e as (select *, case when role <> 'user' then 'parts belong to user messages only' when n = 1 then 'unsupported part kind audio' when n = 2 and said then 'both url and data are set' when n = 3 or (n in (0, 4) and not said) then 'neither url nor data is set' when n = 4 then 'data needs a media type' end as error from p)
select conv_id, min(pos) as pos, cast(0 as int) as part, arg_min(error, pos) as error from e where error is not null group by conv_id""",
    "data_url": "select doc_id, 'data:text/plain;base64,' || base64(encode(text)) as url from documents",
    "sniff_content_type": """select p_partkey as id, case p_partkey % 7 when 0 then 'image/png' when 1 then 'application/pdf' when 2 then 'application/octet-stream' when 3 then 'text/html; charset=utf-8' when 4 then 'text/plain; charset=utf-8' when 5 then 'image/gif' else 'image/jpeg' end as media_type from part""",
    "request_files": f"select body from ({WIRE_ORACLES["render_gemini"]}) where body is not null",
    "text_files": """with f as (select s_nationkey as nation, (case when s_nationkey % 3 = 0 then chr(1) else '' end) || string_agg(s_name, '|' order by s_name) || chr(10) as t from supplier group by s_nationkey)
select cast(nation as int) as nation, case when nation % 3 = 0 then 'application/octet-stream' else 'text/plain; charset=utf-8' end as media_type, case when nation % 3 = 0 then null when strlen(t) > 100 then substr(t, 1, 100) || chr(10) || chr(10) || '[fileread: file truncated at 100 bytes]' else t end as text, case when nation % 3 = 0 then 'unsupported media type application/octet-stream' end as error from f""",
}
ORACLE_SQL["message_files"] = ORACLE_SQL["stored_messages"]
