"""Tool calls: arguments, catalogs, rejection budgets, schedules, output calls, delegations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.functions.json_text import decoded, is_json
from chatlake.functions.scalar import INTERRUPTED, RECORDED
from chatlake.operators.dealt import dealt


def _field(args: Column, field: str) -> Column:
    return F.get_json_object(args, f"$.{field}")


def _kind(args: Column, field: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(args), f"$.{field}", "variant"))


def check_string_args(args: Column, field: str) -> Column:
    """null if the arguments are an object with a non-empty string field, else what is wrong."""
    kind = F.schema_of_variant(F.try_parse_json(args))
    bad = F.coalesce(~kind.startswith("OBJECT"), F.lit(True)) | ~is_json(args) | ~F.coalesce(_kind(args, field), F.lit("STRING")).isin("STRING", "VOID")
    return F.when(bad, F.lit(f'arguments must be a JSON object with a string "{field}"')).when(F.coalesce(_field(args, field), F.lit("")) == "", F.lit(f"{field} is required"))


def check_url_args(args: Column) -> Column:
    """As above for ``url``, which must be an absolute http or https address with a host."""
    url = _field(args, "url")
    return F.coalesce(check_string_args(args, "url"), F.when(~F.coalesce(url.rlike("(?i)^https?://[^/?#\\s]+"), F.lit(False)), "url must be an absolute http or https URL"))


def check_path_args(args: Column) -> Column:
    """As above for ``path``, which must be relative and stay below its root."""
    path = _field(args, "path")
    climbs = F.exists(F.split(path, "/"), lambda x: x == "..")
    return F.coalesce(check_string_args(args, "path"), F.when(path.startswith("/"), "path must be relative").when(climbs, "path must stay inside the root"))


def apply_tool_choice(catalog: DataFrame, name: str) -> DataFrame:
    """The chosen tool alone, or one row with an error if there is no such tool.

    The error row is the first tool's by name. It comes from one aggregate, combined before it is
    shuffled; rows of other tools go no further than their scan.
    """
    own = F.col("name") == name
    chosen = catalog.where(own).withColumn("error", F.lit(None).cast("string"))
    found = catalog.agg(F.max(F.coalesce(own, F.lit(False))).alias("known"), F.min_by(F.struct(*catalog.columns), F.struct(F.col("name").isNull().alias("null"), "name")).alias("first"))
    missing = found.where("not known").select("first.*", F.lit(f"tool {name} isn't registered").alias("error"))
    return chosen.unionByName(missing)


def validate_catalog(catalog: DataFrame, output_tool: str | None = None) -> DataFrame:
    """Adds ``error``: the first thing wrong with each declared tool, or null."""
    # rows without a name are dealt out, as their number doesn't matter
    apart = F.when(F.coalesce("name", F.lit("")) == "", F.pmod(F.xxhash64(*catalog.columns), F.lit(1024))).otherwise(F.lit(0))
    copies = F.count("*").over(Window.partitionBy("name", apart))
    name, schema = F.coalesce("name", F.lit("")), F.coalesce("schema", F.lit(""))
    error = (
        F.when(name == "", "a tool needs a name")
        .when(schema == "", "a tool needs a schema")
        .when(~is_json(F.col("schema")), "the schema isn't JSON")
        .when(F.coalesce(F.col("max_retries") < 0, F.lit(False)), "retries can't be negative")
        .when(F.coalesce(F.col("timeout_ms") < 0, F.lit(False)), "the timeout can't be negative")
        .when(F.col("_copies") > 1, "the name is taken")
    )
    if output_tool:
        error = F.coalesce(error, F.when(name == output_tool, "the name is the output tool's"))
    return catalog.withColumn("_copies", copies).withColumn("error", error).drop("_copies")


def undeclared_calls(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """Calls to tools that the catalog lacks."""
    return calls.join(catalog.select("name").distinct(), "name", "left_anti").withColumn("error", F.lit("tool was not declared for this run"))


def apply_rejection_budget(events: DataFrame, catalog: DataFrame, default: int = 1) -> DataFrame:
    """run_id, seq, tool_name, round, rejection, verdict, error: each correctable rejection in turn.

    Needs ``round``. A tool may be corrected so often a round; the next rejection fails the run.
    """
    own = Window.partitionBy("run_id", "round", "tool_name").orderBy("seq")
    rejected = events.where("kind = 'tool_end' and err is not null and err_correctable").withColumn("rejection", F.row_number().over(own))
    rows = rejected.join(catalog.select(F.col("name").alias("tool_name"), "max_retries"), "tool_name", "left").withColumn("_limit", F.coalesce("max_retries", F.lit(default)))
    within = F.col("rejection") <= F.col("_limit")
    error = F.when(~within, F.when(F.col("rejection") > 1, F.format_string("tool failed after %d attempts: %s", "rejection", "err")).otherwise(F.col("err")))
    return rows.select("run_id", "seq", "tool_name", "round", "rejection", F.when(within, "corrected").otherwise("failed").alias("verdict"), error.alias("error"))


def schedule_tool_groups(calls: DataFrame, catalog: DataFrame, parallel: bool = True) -> DataFrame:
    """run_id, turn, grp, seq, ord, event: the order in which calls start and end.

    Calls run together up to a tool that must run alone; a group starts all of its calls before it
    ends them, in the order in which they were made. Without ``parallel`` each call is its own group.
    """
    own = Window.partitionBy("run_id", "turn").orderBy("ord")
    rows = calls.join(catalog.select("name", F.coalesce("sequential", F.lit(False)).alias("alone")), "name", "left")
    rows = dealt(rows.select("run_id", "turn", "ord", F.coalesce("alone", F.lit(False)).alias("alone")), "run_id")
    opens = F.lit(not parallel) | F.col("alone") | F.coalesce(F.lag("alone").over(own), F.lit(True))
    rows = rows.withColumn("_opens", opens.cast("int")).withColumn("grp", F.sum("_opens").over(own) - 1)
    # a group's n calls start at its first's place doubled, and end n later: no sort of both events
    rows = rows.withColumn("_at", F.row_number().over(own) - 1)
    group = Window.partitionBy("run_id", "turn", "grp")
    rows = rows.withColumns({"_first": F.min("_at").over(group), "_n": F.count("*").over(group)})
    events = rows.select("*", F.explode(F.array(F.lit("start"), F.lit("end"))).alias("event"))
    seq = F.col("_first") + F.col("_at") + F.when(F.col("event") == "end", F.col("_n")).otherwise(0)
    return events.select("run_id", "turn", "grp", "ord", "event", seq.cast("int").alias("seq"))


def close_output_calls(calls: DataFrame, output_tool: str, rejections: DataFrame | None = None) -> DataFrame:
    """run_id, turn, ord, call_id, name, content, final: how the calls of a final turn are answered.

    The first call of the output tool ends the run with its arguments; calls emitted beside it are
    closed as interrupted, unless they share its id.
    """
    own = Window.partitionBy("run_id", "turn")
    chosen = F.min_by(F.struct("ord", "call_id", "args"), F.when(F.col("name") == output_tool, F.col("ord"))).over(own)
    rows = calls.withColumn("_out", chosen).where("_out is not null")
    is_out = F.col("ord") == F.col("_out.ord")
    rows = rows.where(is_out | (F.col("call_id") != F.col("_out.call_id")))
    content = F.when(is_out, F.lit(RECORDED)).otherwise(F.lit(INTERRUPTED))
    if rejections is not None:
        rows = rows.join(rejections.select("run_id", "turn", F.col("text").alias("_text")), ["run_id", "turn"], "left")
        content = F.when(is_out, F.coalesce("_text", F.lit(RECORDED))).otherwise(F.lit(INTERRUPTED))
    return rows.select("run_id", "turn", "ord", "call_id", "name", content.alias("content"), F.when(is_out, F.col("args")).alias("final"))


def delegations(calls: DataFrame, child_runs: DataFrame) -> DataFrame:
    """run_id, call_id, content, error: a child run's output as its caller's result.

    child_runs: call_id, output (JSON), error. Strings are taken as they are, other values as JSON; a
    child's failure is the caller's at the tool stage.
    """
    kind = F.schema_of_variant(F.try_parse_json("output"))
    text = F.when(kind == "STRING", F.try_variant_get(F.try_parse_json("output"), "$", "string")).otherwise(F.col("output"))
    joined = calls.join(child_runs, "call_id", "left")
    return joined.select("run_id", "call_id", F.when(F.col("error").isNull(), text).alias("content"), F.col("error"), F.when(F.col("error").isNotNull(), "tool").alias("stage"))


def decode_output(outputs: DataFrame, schema: str | T.DataType) -> DataFrame:
    """Adds ``value`` and ``rejection`` to run_id, content: JSON decoded to a type, however nested.

    Unknown fields are ignored, missing ones get their type's zero; anything else is a correctable
    rejection that names what is wrong and where (see ``decoded``).
    """
    rows = outputs.withColumn("_read", decoded(F.col("content"), schema))
    wrong = F.col("_read.error")
    return rows.select(*outputs.columns, F.when(wrong.isNull(), F.col("_read.value")).alias("value"), F.concat(F.lit("output isn't JSON of the expected type: "), wrong).alias("rejection"))
