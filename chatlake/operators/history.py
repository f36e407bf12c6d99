"""Conversation histories: pairing calls with results, repair, trimming, requests.

Messages are rows: conv_id, pos, role, content, parts, tool_calls, tool_call_id, tool_name (parts may
be missing). Windows run per conversation; a frame partitioned by ``conv_id`` once needs no further
exchange, as windows by (conv_id, call id) are satisfied by that partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.functions.scalar import INTERRUPTED, opens_conversation
from chatlake.operators.dealt import dealt

CALLS = "array<struct<id:string,name:string,args:string>>"


def _conv():
    return Window.partitionBy("conv_id")


def _call_events(messages: DataFrame) -> DataFrame:
    """One row for each call and each result that has an id, with whether the id's previous and last events are calls."""
    calls = messages.where("role = 'assistant'").select("conv_id", "pos", F.posexplode("tool_calls").alias("ord", "call")).select("conv_id", "pos", "ord", F.col("call.id").alias("call_id"), F.col("call.name").alias("name"), F.lit(True).alias("is_call"))
    results = messages.where("role = 'tool'").select("conv_id", "pos", F.lit(0).alias("ord"), F.col("tool_call_id").alias("call_id"), F.col("tool_name").alias("name"), F.lit(False).alias("is_call"))
    own = Window.partitionBy("conv_id", "call_id").orderBy("pos", "ord")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    events = calls.union(results).where("call_id is not null and call_id != ''")
    return events.withColumn("answers", ~F.col("is_call") & F.coalesce(F.lag("is_call").over(own), F.lit(False))).withColumn("pending", F.last("is_call").over(whole))


def pair_calls_results(messages: DataFrame) -> DataFrame:
    """conv_id, pos, call_id of every result with the position of the call that it answers (null: none).

    A result belongs to the latest call of its id that is still open; of several results to one
    call, the first counts; empty ids never pair.
    """
    own = Window.partitionBy("conv_id", "call_id").orderBy("pos", "ord")
    events = _call_events(messages).withColumn("before", F.lag("pos").over(own))
    return events.where(~F.col("is_call")).select("conv_id", "pos", "call_id", F.when(F.col("answers"), F.col("before")).alias("call_pos"))


def unanswered_calls(messages: DataFrame) -> DataFrame:
    """Every call whose id is still open at the end, wherever it was made."""
    return _call_events(messages).where("is_call and pending").select("conv_id", "pos", "ord", "call_id", "name")


def orphan_results(messages: DataFrame) -> DataFrame:
    """Results that answer nothing, those without an id included."""
    nameless = messages.where("role = 'tool' and (tool_call_id is null or tool_call_id = '')").select("conv_id", "pos", F.col("tool_call_id").alias("call_id"))
    return _call_events(messages).where("not is_call and not answers").select("conv_id", "pos", "call_id").union(nameless)


def repair_history(messages: DataFrame, text: str = INTERRUPTED) -> DataFrame:
    """Drops orphan results and answers open calls right after the message that made them.

    The rows get new positions from 0; ``synthesized`` tells the added ones. Repairing twice changes
    nothing.
    """
    messages = messages.repartition("conv_id")
    events = _call_events(messages)
    kept = events.where("answers").select("conv_id", "pos")
    body = messages.where("role is null or role != 'tool'").union(messages.where("role = 'tool'").join(kept, ["conv_id", "pos"], "left_semi").select(messages.columns))
    added = events.where("is_call and pending").select("conv_id", "pos", "ord", "call_id", "name")
    values = {"conv_id": F.col("conv_id"), "pos": F.col("pos"), "role": F.lit("tool"), "content": F.lit(text), "tool_call_id": F.col("call_id"), "tool_name": F.col("name")}
    kinds = dict(messages.dtypes)
    new = added.select(*(values.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in messages.columns), F.lit(True).alias("synthesized"), (F.col("ord") + 1).alias("_ord"))
    both = body.select("*", F.lit(False).alias("synthesized"), F.lit(0).alias("_ord")).unionByName(new)
    return both.withColumn("pos", F.row_number().over(_conv().orderBy("pos", "_ord")) - 1).drop("_ord")


def _trimmed(messages: DataFrame, most: int) -> DataFrame:
    if most < 1:
        raise ValueError(f"the budget must be at least 1, not {most}")
    newest = F.row_number().over(_conv().orderBy(F.col("pos").desc()))
    rows = messages.withColumn("_n", F.count("*").over(_conv())).withColumn("_newest", newest)
    opening = F.when((F.col("_newest") <= most) & opens_conversation(F.col("role"), F.col("tool_calls")), F.col("pos"))
    return rows.withColumn("_first", F.min(opening).over(_conv()))


def trim_history(messages: DataFrame, most: int) -> DataFrame:
    """The newest ``most`` messages, from the first that can open a conversation; short ones whole."""
    rows = _trimmed(messages, most).where((F.col("_n") <= most) | ((F.col("_newest") <= most) & (F.col("pos") >= F.col("_first"))))
    return rows.drop("_n", "_newest", "_first")


def trim_errors(messages: DataFrame, most: int) -> DataFrame:
    """conv_id, error: conversations of which trimming would leave nothing."""
    lost = _trimmed(messages, most).where((F.col("_n") > most) & F.col("_first").isNull()).select("conv_id", "_n").distinct()
    return lost.select("conv_id", F.format_string("trimming left no messages; history of %d messages has no turn that can open a request", F.col("_n")).alias("error"))


def trimmed(most: int) -> Callable[[DataFrame], tuple[DataFrame, DataFrame]]:
    """``trim_history`` as a processor for ``process_history``."""
    return lambda messages: (trim_history(messages, most), trim_errors(messages, most))


def process_history(messages: DataFrame, *processors: Callable[[DataFrame], DataFrame | tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Runs histories through processors in turn -> the processed messages; conv_id, step, error of those that failed.

    A processor takes messages and returns messages, or those and its errors (conv_id, error). It runs
    over all histories at once, and before their parts are validated. A history that a processor fails, or
    leaves without messages where it had some and says nothing, is out of all later steps: no request is
    made of it. The first error of a step counts. A processor that raises fails the job, as
    its error is the program's.
    """
    failed, messages = None, dealt(messages, "conv_id")
    for step, processor in enumerate(processors):
        made = processor(messages)
        made, errors = made if isinstance(made, tuple) else (made, None)
        gone = messages.select("conv_id").distinct().join(made.select("conv_id").distinct(), "conv_id", "left_anti").withColumn("error", F.lit("the history processor left no messages"))
        told = gone.withColumn("_last", F.lit(1))
        if errors is not None:
            told = told.unionByName(errors.select("conv_id", "error").withColumn("_last", F.lit(0)))
        told = told.groupBy("conv_id").agg(F.min(F.struct("_last", "error"))["error"].alias("error")).select("conv_id", F.lit(step).alias("step"), F.concat(F.lit("history processor: "), "error").alias("error"))
        messages = made.join(told.select("conv_id"), "conv_id", "left_anti").select(*made.columns)
        failed = told if failed is None else failed.unionByName(told)
    if failed is None:
        failed = messages.select("conv_id", F.lit(0).alias("step"), F.lit("").alias("error")).limit(0)
    return messages, failed


def validate_parts(messages: DataFrame) -> DataFrame:
    """conv_id, pos, part, error: each conversation's first bad part."""
    parts = messages.select("conv_id", "pos", "role", F.posexplode("parts").alias("part", "p"))
    url, data, media = (F.coalesce(F.col(f"p.{c}"), F.lit("")) != "" for c in ("url", "data", "media_type"))
    error = (
        F.when(F.coalesce(F.col("role") != "user", F.lit(True)), "parts belong to user messages only")
        .when(F.coalesce(F.col("p.kind") != "image", F.lit(True)), F.concat(F.lit("unsupported part kind "), F.coalesce("p.kind", F.lit(""))))
        .when(url & data, "both url and data are set")
        .when(~url & ~data, "neither url nor data is set")
        .when(data & ~media, "data needs a media type")
    )
    bad = parts.withColumn("error", error).where("error is not null")
    return bad.groupBy("conv_id").agg(F.min_by(F.struct("pos", "part", "error"), F.struct("pos", "part")).alias("b")).select("conv_id", "b.pos", "b.part", "b.error")


def conversation_arrays(messages: DataFrame) -> DataFrame:
    """One ordered array of messages for each conversation."""
    fields = [c for c in messages.columns if c != "conv_id"]
    fields = ["pos", *(c for c in fields if c != "pos")]
    return messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*fields)), _by_pos).alias("messages"))


def _by_pos(a: Column, b: Column) -> Column:
    return F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0)


def build_requests(history: DataFrame, prompts: DataFrame, instructions: Column | None = None) -> DataFrame:
    """Instructions, the repaired history without system rows, and the new prompt of each conversation.

    prompts: conv_id, content and what ``instructions`` (a column over it) needs.
    """
    body = repair_history(history).where("role is null or role != 'system'").drop("synthesized")
    kinds = dict(body.dtypes)

    def rows(of: DataFrame, role: str, content: Column, kind: int) -> DataFrame:
        values = {"conv_id": F.col("conv_id"), "role": F.lit(role), "content": content, "pos": F.lit(0)}
        return of.select(*(values.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in body.columns), F.lit(kind).alias("_kind"))

    parts = [body.select("*", F.lit(1).alias("_kind")), rows(prompts, "user", F.col("content"), 2)]
    if instructions is not None:
        parts.append(rows(prompts.withColumn("_text", instructions).where("_text != ''"), "system", F.col("_text"), 0))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("pos", F.row_number().over(_conv().orderBy("_kind", "pos")) - 1).drop("_kind")


def append_corrections(messages: DataFrame, rejections: DataFrame) -> DataFrame:
    """Adds conv_id, content, tool_call_id, tool_name as each conversation's last message.

    A rejection with a call id answers that call; one without is a user's message.
    """
    kinds = dict(messages.dtypes)
    last = messages.groupBy("conv_id").agg((F.max("pos") + 1).alias("pos"))
    rows = rejections.join(last, "conv_id").withColumn("role", F.when(F.col("tool_call_id").isNotNull(), "tool").otherwise("user"))
    new = rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in messages.columns))
    return messages.unionByName(new)


def merge_turns(messages: DataFrame) -> DataFrame:
    """conv_id, turn, wire_role, messages: neighbours of one role become one turn; tools speak as users.

    System rows aren't turns.
    """
    wire = F.when(F.col("role") == "assistant", "assistant").otherwise("user")
    rows = messages.where("role is null or role != 'system'").withColumn("wire_role", wire)
    order = _conv().orderBy("pos")
    change = F.coalesce(F.lag("wire_role").over(order) != F.col("wire_role"), F.lit(True)).cast("int")
    rows = rows.withColumn("_new", change).withColumn("turn", F.sum("_new").over(order) - 1)
    fields = ["pos", *(c for c in messages.columns if c not in ("conv_id", "pos"))]
    return rows.groupBy("conv_id", "turn", "wire_role").agg(F.array_sort(F.collect_list(F.struct(*fields)), _by_pos).alias("messages"))
