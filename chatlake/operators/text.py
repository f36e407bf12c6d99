"""Pages and files to text: visible text of HTML, media types, byte caps, sniffing; column expressions.

Only texts with rare character entities visit Python, where the standard library knows them all.
"""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.functions.scalar import is_text_media_type, media_type_of, truncate_bytes

#: Elements whose tags break lines.
BLOCKS = frozenset(
    "address article aside blockquote br caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table td th title tr ul".split()
)
#: White space that lines are trimmed of: the Unicode property, without the separators U+001C to U+001F.
_TRIM = "".join(chr(c) for c in range(0x3001) if chr(c).isspace() and not 0x1C <= c <= 0x1F)
#: Entities that are replaced in place, the ampersand's own last.
ENTITIES = ("lt", "gt", "quot", "apos", "nbsp", "copy", "reg", "trade", "middot", "bull", "hellip", "ndash", "mdash", "lsquo", "rsquo", "ldquo", "rdquo", "laquo", "raquo", "euro", "pound", "sect", "para", "deg", "times", "amp")

# The pieces that a page is made of. Repetitions are possessive, so that matching neither backtracks
# nor recurses however long a page or a tag is.
_NAME = "[A-Za-z0-9!-]"
_TEXT = "[^<]++"
_COMMENT = "<!--.*?-->"
_RAW = f"</?+script(?!{_NAME}).*?</script[^>]*+>|</?+style(?!{_NAME}).*?</style[^>]*+>"
_END = """(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_BLOCK = f"</?+(?:{'|'.join(sorted(BLOCKS))})(?!{_NAME}){_END}"
_INLINE = f"<(?!!--)(?!/?+(?:script|style)(?!{_NAME}))/?+{_NAME}++{_END}"
#: Stands after each piece. It can't occur within one, as no tag is without a name.
_MARK = "<>"


@F.pandas_udf(T.StringType())
def _any_entities(runs: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Every entity of each marked run of text; the marks go."""
    for part in runs:
        yield part.map(lambda x: None if x is None else "".join(map(html.unescape, x.split(_MARK))))


def _unescaped(marked: Column) -> Column:
    """Entities to characters within each run; the marks go.

    An ampersand that begins no entity of its run is escaped first, so that runs can be joined
    without making an entity across a tag.
    """
    common = "|".join(ENTITIES)
    rare = F.regexp_like(marked, F.lit(f"&(?!(?:{common});)[A-Za-z0-9#]"))
    plain = F.replace(F.regexp_replace(marked, f"&(?!(?:{common});)", "&amp;"), F.lit(_MARK), F.lit(""))
    for name in ENTITIES:
        plain = F.replace(plain, F.lit(f"&{name};"), F.lit(html.unescape(f"&{name};")))
    # nulls go to Python, and come back, where nothing is rare
    return F.coalesce(_any_entities(F.when(rare, marked)), F.when(F.contains(marked, F.lit("&")), plain).otherwise(F.replace(marked, F.lit(_MARK), F.lit(""))))


def html_to_text(page: Column) -> Column:
    """What a reader sees: markup, comments, scripts and styles go, and blocks begin lines.

    1. The page is read as far as it consists of whole pieces; an open comment, script, style or tag,
       or a ``<`` that begins none, ends it.
    2. A mark is put after each piece of text and each block's tag, and in place of all others.
    3. Blocks' tags become line breaks; entities become characters between marks, and marks go.
    4. Lines are trimmed, and empty ones dropped.
    """
    whole = F.regexp_extract(page, f"(?si)^(?:{_TEXT}|{_COMMENT}|{_RAW}|{_INLINE})*+", 0)
    marked = F.regexp_replace(whole, f"(?si)({_TEXT}|{_BLOCK})|{_COMMENT}|{_RAW}|{_INLINE}", f"$1{_MARK}")
    broken = F.regexp_replace(marked, f"(?s)<(?!>){_END}", "\n")
    lines = F.transform(F.split(_unescaped(broken), "\n"), lambda x: F.btrim(x, F.lit(_TRIM)))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def page_text(pages: DataFrame, most: int = 1 << 20) -> DataFrame:
    """Adds text and error to page_id, status, content_type, body.

    Only 2xx pages of text types are read; the body is capped before its text is taken, and the
    marker follows the text.
    """
    kind = media_type_of(F.coalesce("content_type", F.lit("")))
    good = F.coalesce((F.col("status") >= 200) & (F.col("status") < 300), F.lit(False))
    error = F.when(~good, F.concat_ws(" ", F.lit("unexpected status"), "status")).when(~is_text_media_type(F.coalesce("content_type", F.lit(""))), F.concat_ws(" ", F.lit("unsupported media type"), kind))
    marker = f"[webfetch: response truncated at {most} bytes]"
    cut = F.when(F.octet_length("body") > most, F.make_valid_utf8(F.substring(F.encode("body", "utf-8"), 1, most).cast("string"))).otherwise(F.col("body"))
    rows = pages.withColumn("error", error).withColumn("_cut", F.when(F.col("error").isNull(), cut))
    text = F.when(kind.isin("text/html", "application/xhtml+xml"), html_to_text(F.col("_cut"))).otherwise(F.col("_cut"))
    return rows.withColumn("text", F.when(F.octet_length("body") > most, F.concat(text, F.lit("\n\n" + marker))).otherwise(text)).drop("_cut")


#: What files of these types begin with, first match first. Bytes in hexadecimal, ``..`` for any.
_SIGNATURES = (
    ("3C3F786D6C", "text/xml; charset=utf-8", True),
    ("255044462D", "application/pdf", False),
    ("252150532D41646F62652D", "application/postscript", False),
    ("FEFF....", "text/plain; charset=utf-16be", False),
    ("FFFE....", "text/plain; charset=utf-16le", False),
    ("EFBBBF..", "text/plain; charset=utf-8", False),
    ("00000100", "image/x-icon", False),
    ("00000200", "image/x-icon", False),
    ("424D", "image/bmp", False),
    ("474946383761", "image/gif", False),
    ("474946383961", "image/gif", False),
    ("52494646........574542505650", "image/webp", False),
    ("89504E470D0A1A0A", "image/png", False),
    ("FFD8FF", "image/jpeg", False),
    ("464F524D........41494646", "audio/aiff", False),
    ("494433", "audio/mpeg", False),
    ("4F67675300", "application/ogg", False),
    ("4D54686400000006", "audio/midi", False),
    ("52494646........41564920", "video/avi", False),
    ("52494646........57415645", "audio/wave", False),
    ("1A45DFA3", "video/webm", False),
    ("." * 68 + "4C50", "application/vnd.ms-fontobject", False),
    ("00010000", "font/ttf", False),
    ("4F54544F", "font/otf", False),
    ("74746366", "font/collection", False),
    ("774F4646", "font/woff", False),
    ("774F4632", "font/woff2", False),
    ("1F8B08", "application/x-gzip", False),
    ("504B0304", "application/zip", False),
    ("526172211A0700", "application/x-rar-compressed", False),
    ("526172211A070100", "application/x-rar-compressed", False),
    ("0061736D", "application/wasm", False),
)
#: Tags that HTML begins with, before a space or the tag's end.
_OPENERS = ("!DOCTYPE HTML", "HTML", "HEAD", "SCRIPT", "IFRAME", "H1", "DIV", "FONT", "TABLE", "A", "STYLE", "TITLE", "B", "BODY", "BR", "P")
_WHITE = "(?:09|0A|0C|0D|20)*+"


def _either_case(text: str) -> str:
    """A pattern of a text's bytes in hexadecimal, letters in either case."""
    return "".join(f"(?:{ord(c.upper()):02X}|{ord(c.lower()):02X})" if c.isalpha() else f"{ord(c):02X}" for c in text)


def sniff_content_type(head: Column) -> Column:
    """The media type that the first 512 bytes speak for, by a table of masked signatures.

    White space may stand before markup only. Without a signature, bytes that no text holds make
    a file binary; empty and null content is text.
    """
    data = F.substring(head, 1, 512)
    hexed = F.coalesce(F.hex(data), F.lit(""))
    opened = "|".join(_either_case(f"<{t}") for t in _OPENERS)
    out = F.when(hexed.rlike(f"^{_WHITE}(?:(?:{opened})(?:20|3E)|{_either_case('<!--')})"), "text/html; charset=utf-8")
    for sign, kind, white in _SIGNATURES:
        out = out.when(hexed.rlike(f"^{_WHITE if white else ''}{sign}"), kind)
    # a box of a multiple of four bytes, all there, of a brand that begins with mp4
    size = F.coalesce(F.conv(F.substring(hexed, 1, 8), 16, 10).cast("bigint"), F.lit(0))
    box = F.substr(hexed, F.lit(1), (2 * size).cast("int"))
    is_mp4 = (size >= 12) & (size % 4 == 0) & (2 * size <= F.length(hexed)) & box.rlike("^.{8}66747970(?:6D7034|.{16}(?:.{8})*?6D7034)")
    out = out.when(is_mp4, "video/mp4")
    return out.when(hexed.rlike("^(?:..)*?(?:0[0-8BEF]|1[0-9AC-F])"), "application/octet-stream").otherwise("text/plain; charset=utf-8")


def file_text(content: Column, most: int) -> Column:
    """A file's bytes as text with the cap's marker."""
    return truncate_bytes(F.make_valid_utf8(content.cast("string")), most, "[fileread: file truncated at {n} bytes]")
