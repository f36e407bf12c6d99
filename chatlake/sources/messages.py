"""Persisted conversations: one JSON array of messages a row, read to rows and written back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.functions.scalar import base64_text
from chatlake.operators.text import file_text, sniff_content_type

_STORED = "array<struct<role:string,content:string,parts:array<struct<kind:string,url:string,data:string,mediaType:string>>,toolCalls:array<struct<id:string,name:string,args:string>>,toolCallId:string,toolName:string>>"


def from_message_json(rows: DataFrame) -> DataFrame:
    """conv_id, body -> messages; unknown fields are ignored, missing ones are empty."""
    m = F.col("m")
    exploded = rows.select("conv_id", F.posexplode(F.from_json("body", _STORED)).alias("pos", "m"))
    parts = F.transform(m["parts"], lambda p: F.struct(p["kind"].alias("kind"), p["url"].alias("url"), F.unbase64(p["data"]).alias("data"), p["mediaType"].alias("media_type")))
    return exploded.select("conv_id", "pos", m["role"].alias("role"), F.coalesce(m["content"], F.lit("")).alias("content"), parts.alias("parts"), m["toolCalls"].alias("tool_calls"), m["toolCallId"].alias("tool_call_id"), m["toolName"].alias("tool_name"))


def to_message_json(messages: DataFrame) -> DataFrame:
    """conv_id, body: the fixed field order, empty fields left out, arguments as the JSON they are."""
    from chatlake.operators.wire import _if, _list, _object, _present, quoted

    part = lambda p: _object(kind=quoted(p["kind"]), url=_if(_present(p["url"]), quoted(p["url"])), data=_if(F.octet_length(p["data"]) > 0, quoted(base64_text(p["data"]))), mediaType=_if(_present(p["media_type"]), quoted(p["media_type"])))
    call = lambda c: _object(id=quoted(c["id"]), name=quoted(c["name"]), args=F.coalesce(F.nullif(c["args"], F.lit("")), F.lit("{}")))
    one = _object(
        role=quoted(F.col("role")),
        content=_if(_present(F.col("content")), quoted(F.col("content"))),
        parts=_if(F.size("parts") > 0, _list(F.transform("parts", part))) if "parts" in messages.columns else F.lit(None).cast("string"),
        toolCalls=_if(F.size("tool_calls") > 0, _list(F.transform("tool_calls", call))),
        toolCallId=_if(_present(F.col("tool_call_id")), quoted(F.col("tool_call_id"))),
        toolName=_if(_present(F.col("tool_name")), quoted(F.col("tool_name"))),
    )
    rows = messages.select("conv_id", F.struct("pos", one.alias("json")).alias("m")).groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    return rows.select("conv_id", _list(F.col("ms.json")).alias("body"))


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Lines of {"conv_id": ..., "messages": [...]}."""
    lines = spark.read.text(path).select(F.get_json_object("value", "$.conv_id").cast("bigint").alias("conv_id"), F.get_json_object("value", "$.messages").alias("body"))
    return from_message_json(lines)


def write_messages(messages: DataFrame, path: str) -> None:
    to_message_json(messages).select(F.concat(F.lit('{"conv_id":'), F.col("conv_id").cast("string"), F.lit(',"messages":'), "body", F.lit("}"))).write.text(path)


def write_requests(bodies: DataFrame, path: str) -> None:
    """One request body a line; rows without one (rendering errors) are left out."""
    bodies.where("body is not null").select("body").write.text(path)


def write_ordered(rows: DataFrame, path: str, order: tuple[str, ...] = ("conv_id", "pos"), file_bytes: int = 128 << 20) -> None:
    """Writes Parquet files that ascend by ``order``, across files and within them, near ``file_bytes`` of row data each.

    One pass measures the rows; ranges of their keys are dealt to as many files and sorted there, so no
    task sees more than its range, and readers that filter by the first column skip files and row
    groups by their statistics. A key with more rows than a file holds makes one larger file; ``order``
    should tell rows apart.
    """
    size = rows.agg(F.sum(F.octet_length(F.to_json(F.struct(*rows.columns)))).alias("n")).first()["n"] or 0
    dealt = rows.repartitionByRange(max(1, -(-size // file_bytes)), *order).sortWithinPartitions(*order)
    dealt.write.parquet(path)


def read_text_files(spark: SparkSession, root: str, most: int = 1 << 20) -> DataFrame:
    """path, media_type, text, error: files below a folder; binary ones are refused by their first bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    kind = sniff_content_type(F.substring("content", 1, 512))
    rows = files.select("path", "content", kind.alias("media_type"))
    good = F.startswith("media_type", F.lit("text/"))
    return rows.select("path", "media_type", F.when(good, file_text(F.col("content"), most)).alias("text"), F.when(~good, F.concat(F.lit("unsupported media type "), "media_type")).alias("error"))
