"""Column functions over messages, JSON, errors and text; all stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sentences that conversations hold.
INTERRUPTED = "Tool call was interrupted before execution; no result was produced. Call the tool again if you need its result."
RECORDED = "Result recorded."
#: Status texts of HTTP.
STATUS_TEXT = {400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 408: "Request Timeout", 409: "Conflict", 413: "Request Entity Too Large", 422: "Unprocessable Entity", 424: "Failed Dependency", 429: "Too Many Requests", 500: "Internal Server Error", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout"}
#: Media types that hold text, besides text/*.
TEXT_TYPES = ("application/json", "application/xml", "application/yaml", "application/x-yaml", "application/xhtml+xml")


def opens_conversation(role: Column, tool_calls: Column) -> Column:
    """Whether a message can stand first: not a tool's result, nor an assistant's calls."""
    calls = F.coalesce(F.size(tool_calls), F.lit(0)) > 0
    return ~(F.coalesce(role == "tool", F.lit(False)) | (F.coalesce(role == "assistant", F.lit(False)) & calls))


def resolve_instructions(static: Column, dynamic: Column) -> Column:
    """Both parts with a blank line between; empty parts contribute nothing."""
    return F.concat_ws("\n\n", F.nullif(static, F.lit("")), F.nullif(dynamic, F.lit("")))


def backoff_ms(attempt: Column) -> Column:
    """500 ms, doubled each attempt, 30 s at most."""
    return F.least(F.lit(500) * F.pow(F.lit(2.0), F.greatest(F.lit(0), F.least(attempt - 1, F.lit(20)))), F.lit(30_000.0)).cast("bigint")


def normalize_args(args: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(args), F.lit("")), F.lit("{}"))


def canonical_json(text: Column) -> Column:
    """Sorted keys and plain numbers; what isn't JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def base64_text(data: Column) -> Column:
    """Base64 without the line breaks that the built-in function adds."""
    return F.regexp_replace(F.base64(data), "\\s", "")


def data_url(media_type: Column, data: Column) -> Column:
    return F.concat(F.lit("data:"), media_type, F.lit(";base64,"), base64_text(data))


def media_type_of(content_type: Column) -> Column:
    """The type without its parameters, in lower case."""
    return F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))


def is_text_media_type(content_type: Column, listed: tuple[str, ...] = TEXT_TYPES) -> Column:
    kind = media_type_of(content_type)
    return F.coalesce(kind.startswith("text/") | kind.isin(*listed), F.lit(False))


def truncate_bytes(text: Column, most: int, marker: str) -> Column:
    """The first bytes and a marker after a blank line, if there are more; a split character is replaced."""
    data = F.encode(text, "utf-8")
    cut = F.make_valid_utf8(F.substring(data, 1, most).cast("string"))
    return F.when(F.octet_length(text) > most, F.concat(cut, F.lit("\n\n" + marker.format(n=most)))).otherwise(text)


def trim_error_type(text: Column) -> Column:
    """What stands before the first colon or semicolon."""
    return F.regexp_extract(text, "^([^:;]*)", 1)


def is_retryable(status: Column, error_class: Column | None = None) -> Column:
    """Statuses 408, 429 and from 500; transport faults unless cancelled; never a decoding fault."""
    by_status = F.coalesce((status == 408) | (status == 429) | (status >= 500), F.lit(False))
    if error_class is None:
        return by_status
    return F.when(error_class == "transport", True).when(error_class.isin("decode", "cancelled", "deadline"), False).otherwise(by_status)


def status_text(status: Column) -> Column:
    pairs = [x for k, v in STATUS_TEXT.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), status), F.lit(""))


def call_result_text(items: Column, is_error: Column, name: Column) -> Column:
    """Text items by line, other kinds as a note; an error names its tool."""
    lines = F.transform(items, lambda x: F.when(x["type"] == "text", F.coalesce(x["text"], F.lit(""))).otherwise(F.concat(F.lit("[mcp: unsupported "), x["type"], F.lit(" content]"))))
    text = F.array_join(lines, "\n")
    failed = F.concat(F.lit("tool "), name, F.lit(" failed"), F.when(text == "", "").otherwise(F.concat(F.lit(": "), text)))
    return F.when(F.coalesce(is_error, F.lit(False)), failed).otherwise(text)


def rejection_text(kind: Column, reason: Column, tool: Column) -> Column:
    """What a model is told when an output, an output call or a tool call is rejected."""
    return (
        F.when(kind == "tool", F.concat(F.lit("Your tool call was rejected: "), reason, F.lit(". Correct the arguments and call the tool again.")))
        .when(kind == "output_tool", F.concat(F.lit("Your result was rejected: "), reason, F.lit(". Correct the arguments and call "), tool, F.lit(" again.")))
        .otherwise(F.concat(F.lit("Your previous response was rejected: "), reason, F.lit(". Correct it and respond again.")))
    )


def command_output(output: Column, exit_code: Column, most: int) -> Column:
    """A command's capped output and, unless it ended with 0, its status."""
    text = F.make_valid_utf8(F.substring(output, 1, most).cast("string"))
    capped = F.when(F.octet_length(output) > most, F.concat(text, F.lit(f"\n\n[shell: output truncated at {most} bytes]"))).otherwise(text)
    note = F.when(exit_code != 0, F.concat(F.lit("[shell: exited with status "), exit_code.cast("string"), F.lit("]")))
    return F.concat_ws("\n\n", F.nullif(capped, F.lit("")), note)


def content_text(value: Column) -> Column:
    """The string of a JSON value that is a string; empty for any other."""
    parsed = F.try_parse_json(value)
    return F.when(F.schema_of_variant(parsed) == "STRING", F.try_variant_get(parsed, "$", "string")).otherwise(F.lit(""))


def classify_stage(source: Column, error: Column) -> Column:
    """The stage at which a run failed: tool, loop, none for cancellations, and else model."""
    return F.when(source.isin("cancelled", "deadline"), F.lit(None)).when(source == "tool", "tool").when(source == "turn_limit", "loop").when(source.isin("usage", "decode"), source).when(error.isNotNull(), "model")


def stage_text(stage: Column, error: Column) -> Column:
    """A failed run's error with the stage at which it arose; errors without a stage stand alone."""
    return F.when(error.isNotNull(), F.concat(F.coalesce(F.concat(stage, F.lit(" stage: ")), F.lit("")), error))
