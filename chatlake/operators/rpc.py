"""JSON-RPC logs: requests with their responses, and tool lists from their pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlake.functions.scalar import canonical_json
from chatlake.operators.dealt import dealt

_MESSAGE = "struct<id:string,method:string,params:string,result:string,error:struct<code:bigint,message:string>>"


def parse_messages(log: DataFrame) -> DataFrame:
    """Adds kind (request, notification, response, malformed) and the message's fields to session_id, seq, raw."""
    r = F.col("r")
    raw_id = F.to_json(F.try_variant_get(F.try_parse_json("raw"), "$.id", "variant"))
    rows = log.withColumn("r", F.from_json("raw", _MESSAGE)).withColumn("id", F.when(F.coalesce(raw_id, F.lit("null")) != "null", canonical_json(raw_id)))
    method = F.coalesce(r["method"], F.lit("")) != ""
    kind = F.when(method & F.col("id").isNotNull(), "request").when(method, "notification").when(F.col("id").isNotNull(), "response").otherwise("malformed")
    return rows.withColumn("kind", kind).select("session_id", "seq", "kind", "id", r["method"].alias("method"), r["params"].alias("params"), r["result"].alias("result"), r["error"].alias("error"))


def match_rpc(log: DataFrame) -> DataFrame:
    """session_id, seq, id, method, response_seq, result, error: each request with its first later response.

    Ids compare in canonical form within a session; late and unknown responses match nothing. The
    pairing is a window over (session, id): of all responses up to the id's next request the first
    counts, so an id that is used again opens anew.
    """
    rows = parse_messages(log).where("kind in ('request', 'response')")
    own = Window.partitionBy("session_id", "id").orderBy("seq")
    rows = rows.withColumn("n", F.sum(F.when(F.col("kind") == "request", 1).otherwise(0)).over(own)).where("n > 0")
    response = F.when(F.col("kind") == "response", F.struct("seq", "result", "error"))
    request = F.when(F.col("kind") == "request", F.struct("seq", "method"))
    pairs = rows.groupBy("session_id", "id", "n").agg(F.min_by(request, F.when(F.col("kind") == "request", F.col("seq"))).alias("q"), F.min_by(response, F.when(F.col("kind") == "response", F.col("seq"))).alias("a"))
    error = F.when(F.col("a").isNull(), "no response").when(F.col("a.error").isNotNull(), F.format_string("json-rpc error %d: %s", "a.error.code", "a.error.message")).when(F.col("a.result").isNull(), "response has no result")
    return pairs.select("session_id", F.col("q.seq").alias("seq"), "id", F.col("q.method").alias("method"), F.col("a.seq").alias("response_seq"), F.col("a.result").alias("result"), error.alias("error"))


def collect_tool_lists(log: DataFrame) -> DataFrame:
    """session_id, ord, name, description, schema: the pages of tools/list up to the first without a cursor."""
    pages = match_rpc(dealt(log, "session_id")).where("method = 'tools/list' and error is null").withColumn("p", F.from_json("result", "struct<tools:array<struct<name:string,description:string,inputSchema:string>>,nextCursor:string>"))
    before = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    closed = F.coalesce(F.sum(F.when(F.coalesce("p.nextCursor", F.lit("")) == "", 1).otherwise(0)).over(before), F.lit(0))
    tools = pages.withColumn("_closed", closed).where("_closed = 0").select("session_id", "seq", F.posexplode("p.tools").alias("i", "t"))
    order = Window.partitionBy("session_id").orderBy("seq", "i")
    return tools.select("session_id", (F.row_number().over(order) - 1).alias("ord"), "t.name", F.coalesce("t.description", F.lit("")).alias("description"), F.coalesce(F.col("t.inputSchema"), F.lit('{"type":"object"}')).alias("schema"))
