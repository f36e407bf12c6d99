"""Histories over the given tables, and the same in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlake.functions.scalar import INTERRUPTED, opens_conversation, resolve_instructions
from chatlake.jobs.views import messages, with_views
from chatlake.operators import history as H
from chatlake.sources.messages import write_ordered
from chatlake.sources.shared import scratch_folder

BUDGET = 4
_M = with_views("v_messages")
_EVENTS = f"""{_M}, ev as (
  select conv_id, pos, call_id as id, tool_name as name, true as is_call from v_messages where role = 'assistant' and call_id is not null
  union all select conv_id, pos, tool_call_id, tool_name, false from v_messages where role = 'tool'),
w as (select *, lag(is_call) over own as prev, lag(pos) over own as prev_pos, last_value(is_call) over (partition by conv_id, id order by pos rows between unbounded preceding and unbounded following) as pending
  from ev window own as (partition by conv_id, id order by pos))"""
_REPAIRED = f"""{_EVENTS}, body as (
  select conv_id, pos, 0 as k, role, content, tool_call_id, case when role = 'tool' then tool_name end as tool_name, false as synthesized from v_messages m
  where role <> 'tool' or exists (select 1 from w where w.conv_id = m.conv_id and w.pos = m.pos and not w.is_call and coalesce(w.prev, false))
  union all select conv_id, pos, 1, 'tool', '{INTERRUPTED}', id, name, true from w where is_call and pending),
repaired as (select conv_id, row_number() over (partition by conv_id order by body.pos, k) - 1 as pos, role, content, tool_call_id, tool_name, synthesized from body)"""
_TRIM = f"""{_M}, t as (select *, count(*) over (partition by conv_id) as n, row_number() over (partition by conv_id order by pos desc) as newest from v_messages),
f as (select *, min(case when newest <= {BUDGET} and role <> 'tool' and not (role = 'assistant' and call_id is not null) then pos end) over (partition by conv_id) as first from t)"""


def repair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir)
    before = rows.groupBy("conv_id").agg(F.count("*").alias("before"))
    after = H.repair_history(rows).groupBy("conv_id").agg(F.count("*").alias("after"), F.count_if("synthesized").alias("synthesized"))
    both = before.join(after, "conv_id", "left")
    return both.select("conv_id", (F.coalesce("after", F.lit(0)) - F.coalesce("synthesized", F.lit(0))).alias("kept"), (F.col("before") + F.coalesce("synthesized", F.lit(0)) - F.coalesce("after", F.lit(0))).alias("dropped"), F.coalesce("synthesized", F.lit(0)).alias("synthesized"))


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return customers.select(F.col("c_custkey").alias("conv_id"), F.concat(F.lit("continue, "), "c_name").alias("content"), F.col("c_mktsegment").alias("segment"))


def build_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    instructions = resolve_instructions(F.lit("Answer briefly."), F.when(F.col("segment") == "BUILDING", F.concat(F.lit("Segment "), "segment")).otherwise(""))
    out = H.build_requests(messages(spark, sf_dir), _prompts(spark, sf_dir), instructions)
    return out.select("conv_id", "pos", "role", "content", "tool_call_id")


def append_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejections = _prompts(spark, sf_dir).select("conv_id", "content", F.when(F.col("conv_id") % 2 == 0, F.lit("call-1")).alias("tool_call_id"))
    return H.append_corrections(messages(spark, sf_dir), rejections).select("conv_id", "pos", "role", "content", "tool_call_id")


def conversation_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = H.conversation_arrays(messages(spark, sf_dir))
    return arrays.select("conv_id", F.size("messages").alias("n"), F.md5(F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"])), "|")).alias("digest"))


def merge_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = H.merge_turns(messages(spark, sf_dir))
    return turns.select("conv_id", "turn", "wire_role", F.size("messages").alias("n"), F.array_min("messages.pos").alias("first_pos"), F.array_max("messages.pos").alias("last_pos"))


def trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.trim_history(messages(spark, sf_dir), BUDGET).select("conv_id", "pos", "role", "content")


def _without_errors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drops tool results; conversations that begin with a system message can't be handled."""
    first = rows.groupBy("conv_id").agg(F.min_by("role", "pos").alias("first")).where("first = 'system'")
    return rows.where("role <> 'tool'"), first.select("conv_id", F.lit("begins with a system message").alias("error"))


def processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two processors in turn: what is left of each history, or the step and error that it failed with."""
    kept, failed = H.process_history(messages(spark, sf_dir), _without_errors, H.trimmed(3))
    counts = kept.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    return counts.select("conv_id", "n", "first_pos", F.lit(None).cast("int").alias("step"), F.lit(None).cast("string").alias("error")).unionByName(failed.select("conv_id", F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("first_pos"), "step", "error"))


def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages through ordered files: how many of each conversation, in how many files, and whether each follows its predecessor."""
    path = scratch_folder(spark, "ordered")
    write_ordered(messages(spark, sf_dir), path, file_bytes=256 << 10)
    read = spark.read.parquet(path).select("conv_id", "pos", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    own = Window.partitionBy("file").orderBy("row")
    here = F.struct("conv_id", "pos")
    rows = read.withColumn("follows", F.coalesce(F.lag(here).over(own) <= here, F.lit(True)))
    # files don't overlap: a conversation that lies in two files ends one and begins the next
    ends = rows.groupBy("file").agg(F.min(here).alias("low"), F.max(here).alias("high"))
    apart = rows.groupBy("conv_id", "file").agg(F.count("*").alias("n"), F.bool_and("follows").alias("follows"), F.min(here).alias("own_low"), F.max(here).alias("own_high")).join(ends, "file")
    inside = (F.col("own_low") == F.col("low")) | (F.col("own_high") == F.col("high"))
    return apart.groupBy("conv_id").agg(F.sum("n").alias("n"), (F.bool_and("follows") & ((F.count("*") == 1) | F.bool_and(inside))).alias("in_order"))


QUERIES = {
    "repair_counts": repair_counts,
    "repair_history": lambda s, d: H.repair_history(messages(s, d)).select("conv_id", "pos", "role", "content", "tool_call_id", "tool_name", "synthesized"),
    "pair_calls_results": lambda s, d: H.pair_calls_results(messages(s, d)),
    "unanswered_calls": lambda s, d: H.unanswered_calls(messages(s, d)).drop("ord"),
    "orphan_results": lambda s, d: H.orphan_results(messages(s, d)),
    "trim_history": trim,
    "trim_errors": lambda s, d: H.trim_errors(messages(s, d), 2),
    "opens_conversation": lambda s, d: messages(s, d).select("conv_id", "pos", opens_conversation(F.col("role"), F.col("tool_calls")).alias("opens")),
    "build_requests": build_requests,
    "append_corrections": append_corrections,
    "conversation_arrays": conversation_arrays,
    "merge_turns": merge_turns,
    "process_history": processed,
    "write_ordered": ordered,
}

ORACLE_SQL = {
    "write_ordered": f"{_M} select conv_id, count(*) as n, true as in_order from v_messages group by 1",
    "process_history": f"""{_M}, b as (select conv_id, arg_min(role, pos) = 'system' as bad from v_messages group by 1), k as (select m.*, row_number() over (partition by m.conv_id order by m.pos desc) as newest, count(*) over (partition by m.conv_id) as n from v_messages m join b using (conv_id) where not bad and role <> 'tool'),
f as (select *, min(case when newest <= 3 and not (role = 'assistant' and call_id is not null) then pos end) over (partition by conv_id) as first from k)
select conv_id, count(*) as n, min(pos) as first_pos, cast(null as int) as step, cast(null as string) as error from f where n <= 3 or (newest <= 3 and pos >= first) group by 1
union all select conv_id, null, null, 0, 'history processor: ' || case when bad then 'begins with a system message' else 'the history processor left no messages' end from b where bad or conv_id not in (select conv_id from v_messages where role <> 'tool')
union all select distinct conv_id, null, null, 1, 'history processor: trimming left no messages; history of ' || n || ' messages has no turn that can open a request' from f where n > 3 and first is null""",
    "repair_counts": f"""{_REPAIRED}, a as (select conv_id, count(*) as total, count(*) filter (synthesized) as s from repaired group by 1), b as (select conv_id, count(*) as before from v_messages group by 1)
select b.conv_id, coalesce(total, 0) - coalesce(s, 0) as kept, before + coalesce(s, 0) - coalesce(total, 0) as dropped, coalesce(s, 0) as synthesized from b left join a using (conv_id)""",
    "repair_history": f"{_REPAIRED} select * from repaired",
    "pair_calls_results": f"{_EVENTS} select conv_id, pos, id as call_id, case when prev then prev_pos end as call_pos from w where not is_call",
    "unanswered_calls": f"{_EVENTS} select conv_id, pos, id as call_id, name from w where is_call and pending",
    "orphan_results": f"{_EVENTS} select conv_id, pos, id as call_id from w where not is_call and not coalesce(prev, false)",
    "trim_history": f"{_TRIM} select conv_id, pos, role, content from f where n <= {BUDGET} or (newest <= {BUDGET} and pos >= first)",
    "trim_errors": f"""{_TRIM.replace(f'newest <= {BUDGET}', 'newest <= 2')} select distinct conv_id, 'trimming left no messages; history of ' || n || ' messages has no turn that can open a request' as error from f where n > 2 and first is null""",
    "opens_conversation": f"{_M} select conv_id, pos, role <> 'tool' and not (role = 'assistant' and call_id is not null) as opens from v_messages",
    "build_requests": f"""{_REPAIRED}, p as (select c_custkey as conv_id, 'continue, ' || c_name as content, 'Answer briefly.' || case when c_mktsegment = 'BUILDING' then chr(10) || chr(10) || 'Segment ' || c_mktsegment else '' end as text from customer),
u as (select conv_id, 1 as k, pos, role, content, tool_call_id from repaired where role <> 'system' union all select conv_id, 0, 0, 'system', text, null from p union all select conv_id, 2, 0, 'user', content, null from p)
select conv_id, row_number() over (partition by conv_id order by k, u.pos) - 1 as pos, role, content, tool_call_id from u""",
    "append_corrections": f"""{_M}, l as (select conv_id, max(pos) + 1 as pos from v_messages group by 1)
select conv_id, pos, role, content, tool_call_id from v_messages union all
select c_custkey, l.pos, case when c_custkey % 2 = 0 then 'tool' else 'user' end, 'continue, ' || c_name, case when c_custkey % 2 = 0 then 'call-1' end from customer join l on l.conv_id = c_custkey""",
    "conversation_arrays": f"{_M} select conv_id, count(*) as n, md5(string_agg(role || ':' || content, '|' order by pos)) as digest from v_messages group by 1",
    "merge_turns": f"""{_M}, r as (select *, case when role = 'assistant' then 'assistant' else 'user' end as wire_role from v_messages where role <> 'system'),
i as (select *, case when lag(wire_role) over (partition by conv_id order by pos) = wire_role then 0 else 1 end as new from r),
t as (select *, sum(new) over (partition by conv_id order by pos) - 1 as turn from i)
select conv_id, cast(turn as bigint) as turn, wire_role, count(*) as n, min(pos) as first_pos, max(pos) as last_pos from t group by all""",
}
