"""Run logs: usage, limits, rounds, retries, fallbacks and stages.

Events are rows: run_id, seq, kind (model_start, model_end, tool_start, tool_end, output_rejected),
tool_name, input_tokens, output_tokens and what an operator names. Totals are sums with map-side
combination; only what depends on order is a window per run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.functions.scalar import backoff_ms, is_retryable, status_text

#: In the order in which a crossing is reported.
LIMITS = ("input_tokens", "output_tokens", "total_tokens", "requests", "tool_calls")


def _count(kind: str) -> Column:
    return F.count_if(F.col("kind") == kind)


def _usage() -> list[Column]:
    return [
        F.sum(F.when(F.col("kind") == "model_end", F.coalesce("input_tokens", F.lit(0))).otherwise(0)).alias("input_tokens"),
        F.sum(F.when(F.col("kind") == "model_end", F.coalesce("output_tokens", F.lit(0))).otherwise(0)).alias("output_tokens"),
        _count("model_start").alias("requests"),
        _count("tool_start").alias("tool_calls"),
    ]


def number_rounds(events: DataFrame) -> DataFrame:
    """Adds ``round``: how many outputs were rejected before the event."""
    before = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("round", F.coalesce(F.sum(F.when(F.col("kind") == "output_rejected", 1).otherwise(0)).over(before), F.lit(0)))


def run_usage(events: DataFrame) -> DataFrame:
    """Tokens of successful calls, all attempts and all started tool calls of each run."""
    return events.groupBy("run_id").agg(*_usage())


def number_turns(events: DataFrame) -> DataFrame:
    """Adds ``turn``: how many model calls of its round ended before the event. Needs ``round``."""
    before = Window.partitionBy("run_id", "round").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("turn", F.count_if(F.col("kind") == "model_end").over(before))


def usage_rollup(events: DataFrame) -> DataFrame:
    """The same by run, round and turn, with subtotals and the grand total (null keys)."""
    return number_turns(number_rounds(events)).rollup("run_id", "round", "turn").agg(*_usage())


def tool_usage(events: DataFrame) -> DataFrame:
    """Per tool: its started calls and the runs that started any."""
    started = events.where(F.col("kind") == "tool_start")
    return started.groupBy("tool_name", "run_id").agg(F.count("*").alias("calls")).groupBy("tool_name").agg(F.sum("calls").alias("tool_calls"), F.count("*").alias("runs"))


def tool_stats(events: DataFrame) -> DataFrame:
    """Per tool: started, ended well, rejected with a correction, failed. Needs err, err_correctable."""
    ended = F.col("kind") == "tool_end"
    wrong = F.coalesce("err", F.lit("")) != ""
    fixable = F.coalesce("err_correctable", F.lit(False))
    return events.groupBy("tool_name").agg(
        _count("tool_start").alias("executions"), F.count_if(ended & ~wrong).alias("successes"), F.count_if(ended & wrong & fixable).alias("rejections"), F.count_if(ended & wrong & ~fixable).alias("failures")
    )


def check_usage_limits(events: DataFrame, limits: dict[str, int]) -> DataFrame:
    """run_id, round, crossed_kind, limit, actual: each run's first crossing.

    Totals so far are compared once a round, when it ends; a limit of 0 bounds nothing; of several
    crossings in one round the first of ``LIMITS`` counts.
    """
    rounds = number_rounds(events).groupBy("run_id", "round").agg(*_usage())
    so_far = Window.partitionBy("run_id").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    totals = rounds.select("run_id", "round", *(F.sum(c).over(so_far).alias(c) for c in LIMITS if c != "total_tokens"))
    totals = totals.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
    hit = F.lit(None).cast("struct<kind:string,limit:bigint,actual:bigint>")
    for name in reversed(LIMITS):
        if limits.get(name, 0) > 0:
            crossing = F.struct(F.lit(name).alias("kind"), F.lit(limits[name]).cast("bigint").alias("limit"), F.col(name).cast("bigint").alias("actual"))
            hit = F.when(F.col(name) > limits[name], crossing).otherwise(hit)
    found = totals.withColumn("hit", hit).where("hit is not null")
    first = found.groupBy("run_id").agg(F.min_by(F.struct("round", "hit"), "round").alias("f"))
    return first.select("run_id", "f.round", F.col("f.hit.kind").alias("crossed_kind"), F.col("f.hit.limit").alias("limit"), F.col("f.hit.actual").alias("actual"))


def pair_run_events(events: DataFrame, key: tuple[str, ...] = ("run_id", "round", "turn"), call: tuple[str, ...] = ("tool_name",)) -> DataFrame:
    """key, call, family, number, started, ended, interrupted: the brackets of model attempts and tool calls.

    Model attempts follow one another within ``key``, so an end belongs to the start just before it, and a
    start that the next start follows was interrupted: ``number`` is the attempt. Calls may overlap; of
    those that ``key`` and ``call`` (null for attempts) don't tell apart, the first end belongs to
    the first start that is open. Ends without a start have rows of their own and no number.
    """
    family = F.regexp_extract("kind", "^(model|tool)_(?:start|end)$", 1)
    rows = events.withColumn("family", family).where("family != ''")
    rows = rows.withColumns({c: F.when(F.col("family") == "tool", F.col(c)) for c in call}).withColumn("_start", F.col("kind").endswith("_start"))
    keys = [*key, *call, "family"]
    own = Window.partitionBy(*keys).orderBy("seq")
    before = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"_starts": F.count_if(F.col("_start")).over(before), "_ends": F.count_if(~F.col("_start")).over(before), "_opened": F.coalesce(F.lag("_start").over(own), F.lit(False))})
    # ends without a start, so far: how far the ends have ever been ahead of the starts
    rows = rows.withColumn("_lost", F.greatest(F.max(F.col("_ends") - F.col("_starts")).over(before), F.lit(0)))
    rows = rows.withColumn("_stray", ~F.col("_start") & F.when(F.col("family") == "model", ~F.col("_opened")).otherwise(F.col("_lost") > F.coalesce(F.lag("_lost").over(own), F.lit(0))))
    number = F.when(F.col("_stray"), F.lit(None)).when(F.col("_start") | (F.col("family") == "model"), F.col("_starts")).otherwise(F.col("_ends") - F.col("_lost"))
    rows = rows.withColumns({"number": number, "_alone": F.when(F.col("_stray"), F.col("seq"))})
    paired = rows.groupBy(*keys, "number", "_alone").agg(F.min(F.when(F.col("_start"), F.col("seq"))).alias("started"), F.min(F.when(~F.col("_start"), F.col("seq"))).alias("ended"))
    return paired.withColumn("interrupted", F.col("started").isNotNull() & F.col("ended").isNull()).drop("_alone")


def classify_errors(attempts: DataFrame) -> DataFrame:
    """Adds message, code and retryable to request_id, status, body, error_class of failed attempts.

    The body's own message wins over the status's text; codes of any JSON type are rendered.
    """
    parsed = F.try_parse_json("body")
    message = F.try_variant_get(parsed, "$.error.message", "string")
    code = F.coalesce(*(F.try_variant_get(parsed, p, "string") for p in ("$.error.code", "$.error.type", "$.error.status")))
    return attempts.withColumns({"message": F.coalesce(F.nullif(message, F.lit("")), status_text(F.col("status"))), "code": F.coalesce(code, F.lit("")), "retryable": is_retryable(F.col("status"), F.col("error_class"))})


def classify_stream_errors(frames: DataFrame) -> DataFrame:
    """Adds status and retryable to provider, error_type of errors inside a stream."""
    low = F.lower("error_type")
    status = (
        F.when(low == "throttlingexception", 429)
        .when(low == "validationexception", 400)
        .when(low == "accessdeniedexception", 403)
        .when(low == "resourcenotfoundexception", 404)
        .when(low == "serviceunavailableexception", 503)
        .when(low == "modeltimeoutexception", 408)
        .when(low == "modelerrorexception", 424)
        .when(low == "modelnotreadyexception", 429)
        .otherwise(500)
    )
    own = F.col("provider") == "anthropic"
    return frames.withColumn("status", F.when(own, 0).otherwise(status)).withColumn("retryable", F.when(own, F.col("error_type").isin("overloaded_error", "rate_limit_error", "api_error")).otherwise(is_retryable(F.col("status"))))


def resolve_fallback(attempts: DataFrame) -> DataFrame:
    """request_id, model_rank, status, outcome, skipped: the first success or final failure, else the last failure.

    A failure ends the search if it isn't retryable, if a fragment was already emitted, or if the caller
    had cancelled by then (``cancelled``, where that column is there; the outcome then). Failures passed
    over are counted, not reported.
    """
    ok = F.col("status") == 200
    stopped = F.coalesce("cancelled", F.lit(False)) & ~ok if "cancelled" in attempts.columns else F.lit(False)
    attempts = attempts.withColumn("_stopped", stopped)
    final = ok | ~is_retryable(F.col("status")) | F.coalesce("emitted", F.lit(False)) | F.col("_stopped")
    picked = attempts.groupBy("request_id").agg(
        F.min_by(F.struct("model_rank", "status", "_stopped"), F.when(final, F.col("model_rank"))).alias("first"), F.max_by(F.struct("model_rank", "status", "_stopped"), "model_rank").alias("last"), F.min("model_rank").alias("lowest")
    )
    chosen = F.coalesce("first", "last")
    out = picked.select("request_id", chosen["model_rank"].alias("model_rank"), chosen["status"].alias("status"), chosen["_stopped"].alias("stopped"), "lowest")
    return out.select("request_id", "model_rank", "status", F.when(F.col("status") == 200, "answered").when(F.col("stopped"), "cancelled").otherwise("failed").alias("outcome"), (F.col("model_rank") - F.col("lowest")).alias("skipped"))


def resolve_retries(attempts: DataFrame, most: int) -> DataFrame:
    """request_id, attempts, status, waited_ms, error: each call's end after at most ``most`` attempts."""
    ok = F.col("status") == 200
    final = ok | ~is_retryable(F.col("status")) | (F.col("attempt") >= most)
    end = attempts.groupBy("request_id").agg(F.min_by(F.struct("attempt", "status"), F.when(final, F.col("attempt"))).alias("first"), F.max_by(F.struct("attempt", "status"), "attempt").alias("last"))
    chosen = F.coalesce("first", "last")
    out = end.select("request_id", chosen["attempt"].alias("attempts"), chosen["status"].alias("status"))
    waits = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("attempts")), lambda i: F.when(i < F.col("attempts"), backoff_ms(i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, b: a + b)
    error = F.when(F.col("status") == 200, F.lit(None)).when(F.col("attempts") > 1, F.format_string("model failed after %d attempts: %s", "attempts", status_text(F.col("status")))).otherwise(status_text(F.col("status")))
    return out.select("request_id", "attempts", "status", waits.alias("waited_ms"), error.alias("error"))
