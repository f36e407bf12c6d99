"""Run logs, attempts and tool calls over the given tables, and the same in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.functions.scalar import INTERRUPTED, RECORDED, STATUS_TEXT, backoff_ms, classify_stage, rejection_text, stage_text, trim_error_type
from chatlake.jobs.views import catalog, view, with_views
from chatlake.operators import runs as R
from chatlake.operators import tools as T

LIMITS = {"input_tokens": 900, "output_tokens": 500, "total_tokens": 1200, "requests": 12, "tool_calls": 5}
_E = with_views("v_run_events")
_A = with_views("v_attempts")
_C = with_views("v_calls")
_ROUNDS = f"{_E}, r as (select *, coalesce(sum(case when kind = 'output_rejected' then 1 else 0 end) over (partition by run_id order by seq rows between unbounded preceding and 1 preceding), 0) as round from v_run_events)"
_SUMS = "cast(sum(case when kind = 'model_end' then input_tokens else 0 end) as bigint) as input_tokens, cast(sum(case when kind = 'model_end' then output_tokens else 0 end) as bigint) as output_tokens, count(*) filter (kind = 'model_start') as requests, count(*) filter (kind = 'tool_start') as tool_calls"
_TEXTS = "case status " + " ".join(f"when {k} then '{v}'" for k, v in STATUS_TEXT.items()) + " end"
_RETRYABLE = "(status in (408, 429) or status >= 500)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_run_events")


def classify_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.col("model_rank") % 3 == 0, F.format_string('{"error":{"message":"no %d","code":%d}}', "model_rank", "status")).when(F.col("model_rank") % 3 == 1, F.lit("<html>"))
    error_class = F.when(F.col("model_rank") % 5 == 0, "transport").when(F.col("model_rank") % 5 == 4, "decode")
    failed = view(spark, sf_dir, "v_attempts").where("status <> 200").withColumn("body", body).withColumn("error_class", error_class)
    return R.classify_errors(failed).select("request_id", "model_rank", "message", "code", "retryable")


def classify_stream_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_attempts").select("request_id", "model_rank", F.when(F.col("model_rank") % 2 == 0, "anthropic").otherwise("bedrock").alias("provider"), F.when(F.col("status") == 429, "throttlingException").when(F.col("status") == 503, "overloaded_error").otherwise("other:detail").alias("error_type"))
    return R.classify_stream_errors(rows).select("request_id", "model_rank", "status", "retryable", trim_error_type(F.col("error_type")).alias("error_type"))


def fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.resolve_fallback(view(spark, sf_dir, "v_attempts").withColumn("emitted", F.col("output_tokens") == 8).withColumn("cancelled", F.col("input_tokens") % 110 == 0))


def retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.resolve_retries(view(spark, sf_dir, "v_attempts").withColumnRenamed("model_rank", "attempt"), 4)


def rejection_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.apply_rejection_budget(R.number_rounds(_events(spark, sf_dir)), catalog(spark).select("name", "max_retries"))


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("status") == 429, "turn_limit").when(F.col("status") == 503, "cancelled").when(F.col("model_rank") % 4 == 0, "tool").otherwise("provider")
    rows = view(spark, sf_dir, "v_attempts").where("status <> 200")
    stage, error = classify_stage(source, F.lit("x")), F.concat(F.lit("status "), F.col("status").cast("string"))
    return rows.select("request_id", "model_rank", stage.alias("stage"), stage_text(stage, error).alias("text"))


def decode_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    good = F.format_string('{"status":"%s","priority":%d,"extra":1}', "o_orderstatus", F.col("o_orderkey") % 9)
    content = F.when(F.col("o_orderkey") % 5 == 0, F.concat(good, F.lit(" x"))).when(F.col("o_orderkey") % 5 == 1, F.lit('{"priority":"high"}')).when(F.col("o_orderkey") % 5 == 2, F.lit('{"priority":3}')).otherwise(good)
    out = T.decode_output(orders.select(F.col("o_orderkey").alias("run_id"), content.alias("content")), "status string, priority int")
    return out.select("run_id", F.col("value.status").alias("status"), F.col("value.priority").alias("priority"), F.col("rejection").isNotNull().alias("rejected"))


_NESTED = "id bigint, who struct<name:string,tags:array<string>>, lines array<struct<q:int,p:double>>, prices map<string,double>, ok boolean"


def decode_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested outputs: each order in turn good, wrong at some depth, with missing parts, trailed, or with a key twice."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k, n = F.col("o_orderkey"), F.col("o_orderkey") % 10
    number = F.concat(k.cast("string"), F.when(n == 1, ".0").otherwise(""))
    who = F.concat(F.lit('"who":{"name":"c'), F.col("o_custkey").cast("string"), F.lit('","tags":["a",'), F.when(n == 2, "7").otherwise('"b"'), F.lit("]},"))
    lines = F.concat(F.lit('"lines":[{"q":'), F.when(n == 7, "3000000000").otherwise((k % 50).cast("string")), F.lit(',"p":1.5},{"p":2e1,"q":'), F.when(n == 3, '"x"').otherwise("2"), F.lit("}],"))
    prices = F.concat(F.lit('"prices":'), F.when(n == 8, "[1]").when(n == 4, '{"x":null,"y":2}').otherwise('{"x":1.25,"y":2}'))
    content = F.concat(F.lit('{"id":'), number, F.lit(","), F.when(n == 5, "").otherwise(F.concat(who, lines)), prices, F.lit(',"more":{"deep":[[1]]}'), F.when(n == 9, ',"id":1').otherwise(""), F.lit("}"), F.when(n == 6, "]").otherwise(""))
    out = T.decode_output(orders.select(k.alias("run_id"), content.alias("content")), _NESTED)
    v = F.col("value")
    return out.select("run_id", v["id"].alias("id"), v["who"]["name"].alias("name"), F.array_join(v["who"]["tags"], "|").alias("tags"), F.aggregate(v["lines"], F.lit(0), lambda a, x: a + x["q"]).alias("q"), F.aggregate(v["lines"], F.lit(0.0), lambda a, x: a + x["p"]).alias("p"), v["prices"]["x"].alias("x"), F.size(v["prices"]).alias("prices"), v["ok"].alias("ok"), "rejection")


def argument_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    n = F.col("p_partkey")
    url = F.when(n % 4 == 0, F.lit("{}")).when(n % 4 == 1, F.format_string('{"url":"https://h%d.example/x"}', n)).when(n % 4 == 2, F.format_string('{"url":"ftp://h%d"}', n)).otherwise(F.lit("[1]"))
    path = F.when(n % 3 == 0, F.lit('{"path":"/etc"}')).when(n % 3 == 1, F.format_string('{"path":"a/%d"}', n)).otherwise(F.lit('{"path":"a/../b"}'))
    rows = parts.select(n.alias("id"), url.alias("url_args"), path.alias("path_args"))
    return rows.select("id", T.check_url_args(F.col("url_args")).alias("url_error"), T.check_path_args(F.col("path_args")).alias("path_error"))


def validate_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    n = F.col("p_partkey")
    rows = parts.select(n.alias("id"), F.when(n % 7 == 0, "").otherwise(F.concat(F.lit("t"), (n % 500).cast("string"))).alias("name"), F.when(n % 5 == 0, "{").otherwise("{}").alias("schema"), (n % 3 - 1).cast("int").alias("max_retries"), F.lit(10).alias("timeout_ms"))
    return T.validate_catalog(rows, "t3").select("id", "error")


def delegations(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = view(spark, sf_dir, "v_calls").select("run_id", F.concat_ws("-", "run_id", "call_id").alias("call_id"))
    attempts = view(spark, sf_dir, "v_attempts")
    children = attempts.where("status <> 400").select(F.concat_ws("-", "request_id", F.concat(F.lit("c"), "model_rank")).alias("call_id"), F.when(F.col("status") == 200, F.format_string('"done %d"', "input_tokens")).when(F.col("status") == 429, F.format_string('{"n":%d}', "input_tokens")).alias("output"), F.when(F.col("status") == 503, "child failed").alias("error"))
    return T.delegations(calls, children)


QUERIES = {
    "number_rounds": lambda s, d: R.number_rounds(_events(s, d)).select("run_id", "seq", "round"),
    "run_usage": lambda s, d: R.run_usage(_events(s, d)),
    "usage_rollup": lambda s, d: R.usage_rollup(_events(s, d)),
    "tool_usage": lambda s, d: R.tool_usage(_events(s, d)),
    "tool_stats": lambda s, d: R.tool_stats(_events(s, d)),
    "check_usage_limits": lambda s, d: R.check_usage_limits(_events(s, d), LIMITS),
    "pair_run_events": lambda s, d: R.pair_run_events(R.number_turns(R.number_rounds(_events(s, d)))),
    "classify_errors": classify_errors,
    "classify_stream_errors": classify_stream_errors,
    "resolve_fallback": fallback,
    "resolve_retries": retries,
    "backoff_ms": lambda s, d: view(s, d, "v_attempts").select("request_id", "model_rank", backoff_ms(F.col("model_rank")).alias("wait_ms")),
    "classify_stage": stages,
    "apply_rejection_budget": rejection_budget,
    "rejection_text": lambda s, d: _events(s, d).where("err is not null").select("run_id", "seq", rejection_text(F.element_at(F.array(F.lit("tool"), F.lit("output_tool"), F.lit("text")), (F.col("seq") % 3 + 1).cast("int")), F.col("err"), F.col("tool_name")).alias("text")),
    "undeclared_calls": lambda s, d: T.undeclared_calls(view(s, d, "v_calls"), catalog(s)).select("run_id", "ord", "name", "error"),
    "apply_tool_choice": lambda s, d: T.apply_tool_choice(view(s, d, "v_calls").select("run_id", "ord", "name"), "tool_2"),
    "missing_tool_choice": lambda s, d: T.apply_tool_choice(s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id")), "tool_9"),
    "schedule_tool_groups": lambda s, d: T.schedule_tool_groups(view(s, d, "v_calls"), catalog(s)),
    "schedule_single_calls": lambda s, d: T.schedule_tool_groups(view(s, d, "v_calls"), catalog(s), parallel=False),
    "close_output_calls": lambda s, d: T.close_output_calls(view(s, d, "v_calls"), "tool_3"),
    "decode_output": decode_output,
    "decode_nested": decode_nested,
    "argument_checks": argument_checks,
    "validate_catalog": validate_catalog,
    "delegations": delegations,
}


def _crossing() -> str:
    names = [n for n in R.LIMITS if LIMITS.get(n)]
    return ", ".join(f"case {' '.join(f'when {n} > {LIMITS[n]} then {pick(n)}' for n in names)} end as {alias}" for alias, pick in (("crossed_kind", lambda n: f"'{n}'"), ("limit", lambda n: f"cast({LIMITS[n]} as bigint)"), ("actual", lambda n: f"cast({n} as bigint)")))


ORACLE_SQL = {
    "number_rounds": f"{_ROUNDS} select run_id, seq, cast(round as bigint) as round from r",
    "run_usage": f"{_E} select run_id, {_SUMS} from v_run_events group by 1",
    "usage_rollup": f"""{_ROUNDS}, t as (select *, coalesce(count(*) filter (kind = 'model_end') over (partition by run_id, round order by seq rows between unbounded preceding and 1 preceding), 0) as turn from r)
select run_id, cast(round as bigint) as round, turn, {_SUMS} from t group by rollup (run_id, round, turn)""",
    "tool_usage": f"{_E} select tool_name, count(*) as tool_calls, count(distinct run_id) as runs from v_run_events where kind = 'tool_start' group by 1",
    "tool_stats": f"""{_E} select tool_name, count(*) filter (kind = 'tool_start') as executions, count(*) filter (kind = 'tool_end' and err is null) as successes,
count(*) filter (kind = 'tool_end' and err is not null and err_correctable) as rejections, count(*) filter (kind = 'tool_end' and err is not null and not err_correctable) as failures from v_run_events group by 1""",
    "check_usage_limits": f"""{_ROUNDS}, s as (select run_id, round, {_SUMS} from r group by 1, 2),
c as (select run_id, round, sum(input_tokens) over w as input_tokens, sum(output_tokens) over w as output_tokens, sum(input_tokens + output_tokens) over w as total_tokens, sum(requests) over w as requests, sum(tool_calls) over w as tool_calls from s window w as (partition by run_id order by round)),
x as (select run_id, cast(round as bigint) as round, {_crossing()} from c)
select * from x where crossed_kind is not null qualify row_number() over (partition by run_id order by round) = 1""",
    "pair_run_events": f"""{_ROUNDS}, u as (select *, count(*) filter (kind = 'model_end') over (partition by run_id, round order by seq rows between unbounded preceding and 1 preceding) as turn from r),
b as (select run_id, cast(round as bigint) as round, turn, case when kind like 'tool%' then tool_name end as tool_name, split_part(kind, '_', 1) as family, seq, kind like '%start' as s from u where kind <> 'output_rejected'),
c as (select *, count(*) filter (s) over o as starts, count(*) filter (not s) over o as ends, coalesce(lag(s) over (partition by run_id, round, turn, tool_name, family order by seq), false) as opened from b window o as (partition by run_id, round, turn, tool_name, family order by seq rows between unbounded preceding and current row)),
l as (select *, greatest(max(ends - starts) over (partition by run_id, round, turn, tool_name, family order by seq rows between unbounded preceding and current row), 0) as lost from c),
n as (select *, not s and case when family = 'model' then not opened else lost > coalesce(lag(lost) over (partition by run_id, round, turn, tool_name, family order by seq), 0) end as stray from l),
k as (select *, case when stray then null when s or family = 'model' then starts else ends - lost end as number, case when stray then seq end as alone from n)
select run_id, round, turn, tool_name, family, number, min(seq) filter (s) as started, min(seq) filter (not s) as ended, count(*) filter (s) > 0 and count(*) filter (not s) = 0 as interrupted from k group by run_id, round, turn, tool_name, family, number, alone""",
    "classify_errors": f"""{_A} select request_id, model_rank, case when model_rank % 3 = 0 then 'no ' || model_rank else {_TEXTS} end as message, case when model_rank % 3 = 0 then cast(status as string) else '' end as code,
case when model_rank % 5 = 0 then true when model_rank % 5 = 4 then false else {_RETRYABLE} end as retryable from v_attempts where status <> 200""",
    "classify_stream_errors": f"""{_A}, e as (select request_id, model_rank, model_rank % 2 = 0 as own, case status when 429 then 'throttlingException' when 503 then 'overloaded_error' else 'other' end as error_type from v_attempts)
select request_id, model_rank, case when own then 0 when error_type = 'throttlingException' then 429 else 500 end as status, case when own then error_type = 'overloaded_error' else true end as retryable, error_type from e""",
    "resolve_fallback": f"""{_A}, t as (select *, status = 200 or not {_RETRYABLE} or output_tokens = 8 or input_tokens % 110 = 0 as final from v_attempts),
p as (select request_id, coalesce(min(model_rank) filter (final), max(model_rank)) as model_rank from t group by 1)
select request_id, p.model_rank, status, case when status = 200 then 'answered' when input_tokens % 110 = 0 then 'cancelled' else 'failed' end as outcome, p.model_rank - 1 as skipped from p join t using (request_id, model_rank)""",
    "resolve_retries": f"""{_A}, t as (select *, status = 200 or not {_RETRYABLE} or model_rank >= 4 as final from v_attempts),
p as (select request_id, coalesce(min(model_rank) filter (final), max(model_rank)) as model_rank from t group by 1)
select request_id, p.model_rank as attempts, status, cast(500 * (power(2, p.model_rank - 1) - 1) as bigint) as waited_ms, case when status = 200 then null when p.model_rank > 1 then 'model failed after ' || p.model_rank || ' attempts: ' || {_TEXTS} else {_TEXTS} end as error from p join t using (request_id, model_rank)""",
    "backoff_ms": f"{_A} select request_id, model_rank, cast(least(500 * power(2, model_rank - 1), 30000) as bigint) as wait_ms from v_attempts",
    "classify_stage": f"{_A}, s as (select request_id, model_rank, status, case when status = 503 then null when status = 429 then 'loop' when model_rank % 4 = 0 then 'tool' else 'model' end as stage from v_attempts where status <> 200) select request_id, model_rank, stage, coalesce(stage || ' stage: ', '') || 'status ' || status as text from s",
    "apply_rejection_budget": f"""{_ROUNDS}, x as (select run_id, seq, tool_name, cast(round as bigint) as round, row_number() over (partition by run_id, round, tool_name order by seq) as rejection, err from r where kind = 'tool_end' and err is not null and err_correctable),
y as (select *, rejection <= cast(right(tool_name, 1) as int) % 3 as within from x)
select run_id, seq, tool_name, round, rejection, case when within then 'corrected' else 'failed' end as verdict, case when within then null when rejection > 1 then 'tool failed after ' || rejection || ' attempts: ' || err else err end as error from y""",
    "rejection_text": f"""{_E} select run_id, seq, case seq % 3 when 0 then 'Your tool call was rejected: ' || err || '. Correct the arguments and call the tool again.'
when 1 then 'Your result was rejected: ' || err || '. Correct the arguments and call ' || tool_name || ' again.' else 'Your previous response was rejected: ' || err || '. Correct it and respond again.' end as text from v_run_events where err is not null""",
    "undeclared_calls": f"{_C} select run_id, ord, name, 'tool was not declared for this run' as error from v_calls where name = 'tool_6'",
    "apply_tool_choice": f"{_C} select run_id, ord, name, cast(null as string) as error from v_calls where name = 'tool_2'",
    "missing_tool_choice": "select s_name as name, s_suppkey as id, 'tool tool_9 isn''t registered' as error from supplier order by s_name limit 1",
    "schedule_single_calls": f"""{_C}, e as (select run_id, turn, ord, unnest(['start', 'end']) as event from v_calls)
select run_id, turn, ord, event, cast(row_number() over (partition by run_id, turn, event order by ord) - 1 as bigint) as grp, row_number() over (partition by run_id, turn order by ord, event desc) - 1 as seq from e""",
    "schedule_tool_groups": f"""{_C}, a as (select run_id, turn, ord, name in ('tool_0', 'tool_3') as alone from v_calls),
o as (select *, alone or coalesce(lag(alone) over (partition by run_id, turn order by ord), true) as opens from a),
g as (select run_id, turn, cast(sum(opens::int) over (partition by run_id, turn order by ord) - 1 as bigint) as grp, ord from o),
e as (select *, 'start' as event from g union all select *, 'end' from g)
select *, row_number() over (partition by run_id, turn order by grp, event desc, ord) - 1 as seq from e""",
    "close_output_calls": f"""{_C}, f as (select run_id, min(ord) as out from v_calls where name = 'tool_3' group by 1)
select run_id, turn, ord, call_id, name, case when ord = out then '{RECORDED}' else '{INTERRUPTED}' end as content, case when ord = out then args end as final from v_calls join f using (run_id)""",
    "decode_output": """select o_orderkey as run_id, case when o_orderkey % 5 < 2 then null when o_orderkey % 5 = 2 then '' else o_orderstatus end as status,
case when o_orderkey % 5 < 2 then null when o_orderkey % 5 = 2 then 3 else o_orderkey % 9 end::int as priority, o_orderkey % 5 < 2 as rejected from orders""",
    "decode_nested": """with o as (select o_orderkey as k, o_custkey as c, o_orderkey % 10 as n from orders), r as (select *, case n when 1 then '$.id: not of type bigint' when 2 then '$.who.tags[1]: not of type string'
 when 3 then '$.lines[1].q: not of type int' when 6 then 'not JSON' when 7 then '$.lines[0].q: not of type int' when 8 then '$.prices: not of type map<string,double>' when 9 then 'a key is repeated' end as wrong from o)
select k as run_id, case when wrong is null then k end as id, case when wrong is null then case when n = 5 then '' else 'c' || c end end as name, case when wrong is null then case when n = 5 then '' else 'a|b' end end as tags,
cast(case when wrong is null then case when n = 5 then 0 else k % 50 + 2 end end as int) as q, case when wrong is null then case when n = 5 then 0.0 else 21.5 end end::double as p, case when wrong is null then case when n = 4 then 0 else 1.25 end end::double as x,
cast(case when wrong is null then 2 end as int) as prices, case when wrong is null then false end as ok, 'output isn''t JSON of the expected type: ' || wrong as rejection from r""",
    "argument_checks": """select p_partkey as id, case p_partkey % 4 when 0 then 'url is required' when 1 then null when 2 then 'url must be an absolute http or https URL' else 'arguments must be a JSON object with a string "url"' end as url_error,
case p_partkey % 3 when 0 then 'path must be relative' when 1 then null else 'path must stay inside the root' end as path_error from part""",
    "validate_catalog": """with c as (select p_partkey as id, case when p_partkey % 7 = 0 then '' else 't' || (p_partkey % 500) end as name, p_partkey % 5 = 0 as bad, p_partkey % 3 - 1 as retries from part)
select id, case when name = '' then 'a tool needs a name' when bad then 'the schema isn''t JSON' when retries < 0 then 'retries can''t be negative' when count(*) over (partition by name) > 1 then 'the name is taken' when name = 't3' then 'the name is the output tool''s' end as error from c""",
    "delegations": f"""{_C}, k as (select request_id || '-c' || model_rank as call_id, status, input_tokens from v_attempts where status <> 400)
select c.run_id, c.run_id || '-' || c.call_id as call_id, case status when 200 then 'done ' || input_tokens when 429 then '{{"n":' || input_tokens || '}}' end as content, case when status = 503 then 'child failed' end as error, case when status = 503 then 'tool' end as stage
from v_calls c left join k on k.call_id = c.run_id || '-' || c.call_id""",
}
