"""Whole text queries against sequential Python over every row, with the rows' own bytes; JSON and signatures."""

import html as entities
import json
import random
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chatlake.functions.json_text import decoded, is_json
from chatlake.operators.text import BLOCKS, html_to_text, sniff_content_type
from tests.conftest import SF

PIECE = re.compile(
    r"""(?P<text>[^<]+)|(?P<comment><!--.*?-->)|</?(?P<raw>script|style)(?![\w!-]).*?</(?P=raw)[^>]*>|(?P<tag></?(?P<name>(?!!--)[a-z0-9!-]+)(?:[^>"']|"[^"]*"|'[^']*')*>)""",
    re.I | re.S | re.A,
)


def visible_text(page: str) -> str:
    """The pieces of a page one after another, up to what is none."""
    at, out = 0, ""
    for m in iter(lambda: PIECE.match(page, at), None):
        if m["tag"] and m["name"].lower() in ("script", "style"):
            break
        out += entities.unescape(m["text"]) if m["text"] else "\n" if m["name"] and m["name"].lower() in BLOCKS else ""
        at = m.end()
    white = "".join(chr(c) for c in range(0x3001) if chr(c).isspace() and not 0x1C <= c <= 0x1F)
    return "\n".join(filter(None, (line.strip(white) for line in out.split("\n"))))


PAGES = [
    ("<p>one<br>two</p>three", "one\ntwo\nthree"), ("left<!-- gone --><i>right</i>", "leftright"), ("<style>p{}</style>k<script>if (a<b) {}</script>ept", "kept"), ("fish &amp; chips&copy", "fish & chips©"),
    ("2 < 3", "2"), ("2<x", "2"), ("<a title='1>0' rel=\"<p>\">q</a>", "q"), ("<!DOCTYPE html>body", "body"), ("seen<!-- open", "seen"), ("seen<script>open", "seen"), (" \t a \n\n  b ", "a\nb"),
    ("<TD>1</TD><td >2</td>", "1\n2"), ("&lt;p> and &amp;lt;", "<p> and &lt;"), ("&am<b>p;", "&amp;"), ("&#233;&#x2014;&notin;&unknown;", "é—∉&unknown;"), ("a<br/>b<hr>", "a\nb"), ("<p-x>in<b-c>line", "inline"), ("", ""), (None, None),
]


def test_html_cases(spark):
    df = spark.createDataFrame(list(enumerate(p for p, _ in PAGES)), "i int, page string")
    assert [r[0] for r in df.select(html_to_text(F.col("page")), "i").orderBy("i").collect()] == [t for _, t in PAGES]


def test_html_of_random_pieces_and_long_pages(spark):
    r = random.Random(4)
    parts = ["<", "<p>", "</li>", "<b>", "<br/>", "<!--", "-->", "<script", "<script>", "</script x>", "<style>", "</style>", "'", '"', "=", ">", "&amp;", "&am", "p;", "&lt;", "&copy", "&#65;", "&", "\n", " ", "x", "é", "　", "<a href='", "\x1c", "$1", "\\", "<>", "&amp;lt;"]
    pages = ["".join(r.choice(parts) for _ in range(r.randrange(1, 14))) for _ in range(6000)]
    pages += ["a" * 300_000 + "<p>" * 30_000 + "<a " + "b='c' " * 100_000 + ">z", "<a" + " 'q'" * 50_000, " " * 100_000 + "x", "<!-- x -->" * 50_000 + "y"]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, page string").repartition(4)
    got = {x["i"]: x["t"] for x in df.select("i", html_to_text(F.col("page")).alias("t")).collect()}
    assert [got[i] for i in range(len(pages))] == [visible_text(p) for p in pages]


HEADS = [
    (b"\x89PNG\r\n\x1a\n", "image/png"), (b"hi", "text/plain; charset=utf-8"), (b"\0\1", "application/octet-stream"), (b" \n<hTmL>", "text/html; charset=utf-8"), (b"<html5", "text/plain; charset=utf-8"), (b"<!-- x", "text/html; charset=utf-8"),
    (b"", "text/plain; charset=utf-8"), (None, "text/plain; charset=utf-8"), (b"\t<?xml ", "text/xml; charset=utf-8"), (b" %PDF-", "text/plain; charset=utf-8"), (b"%PDF-1", "application/pdf"), (b"\xfe\xff\0a", "text/plain; charset=utf-16be"),
    (b"RIFF....WEBPVP8 ", "image/webp"), (b"RIFF....WAVE", "audio/wave"), (b"RIFF....AVI ", "video/avi"), (b"FORM....AIFF", "audio/aiff"), (b"ID3x", "audio/mpeg"), (b"OggS\0", "application/ogg"), (b"\x1a\x45\xdf\xa3", "video/webm"),
    (b"\0\0\0\x10ftypmp42....", "video/mp4"), (b"\0\0\0\x14ftypisom....mp41", "video/mp4"), (b"\0\0\0\x14ftypisom....avc1", "application/octet-stream"), (b"\0\0\0\x11ftypmp42.....", "application/octet-stream"), (b"\0\0\x01\0", "image/x-icon"),
    (b"\0" * 34 + b"LP", "application/vnd.ms-fontobject"), (b"wOF2", "font/woff2"), (b"PK\3\4", "application/zip"), (b"Rar!\x1a\7\1\0", "application/x-rar-compressed"), (b"\0asm", "application/wasm"), (b"a\x1bb", "text/plain; charset=utf-8"), (b"a" * 600 + b"\0", "text/plain; charset=utf-8"),
]


def test_sniffing(spark):
    df = spark.createDataFrame([(i, None if h is None else bytearray(h)) for i, (h, _) in enumerate(HEADS)], "i int, head binary")
    assert [r[0] for r in df.select(sniff_content_type(F.col("head")), "i").orderBy("i").collect()] == [k for _, k in HEADS]


def _python_accepts(text: str | None) -> bool:
    try:
        json.loads(text, parse_constant=lambda _: 1 / 0)
    except (TypeError, ValueError, ZeroDivisionError, RecursionError):
        return False
    return True


def test_is_json_equals_the_standard_parser(spark):
    r = random.Random(6)
    parts = ['{"a":', "}", "[", "]", ",", '"b"', "1", "-1.5e3", "null", "true", " ", "\n", ":", '"\\u00e9"', "'c'", "NaN", "01", '"', "\\", "x", '{"a":1,"a":2}', "\ufeff", "\t"]
    texts = [None, "", " ", "{}", '{"a":1} x', "1,2", "1]", '1],["x"', "-", "+1", ".5", "1.", "nul", '"\t"', "/**/1", *("".join(r.choice(parts) for _ in range(r.randrange(1, 7))) for _ in range(8000))]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", is_json(F.col("t")).alias("ok")).orderBy("i").collect()
    assert [x["ok"] for x in got] == [_python_accepts(t) for t in texts]
    assert sum(x["ok"] for x in got) > 300


def test_decoded_values_zeros_ranges_and_paths(spark):
    cases = [
        ('{"n":{"i":127,"d":1},"l":[[1],[2,3]],"m":{"k":{"s":"x"}},"v":[1,"y"]}', (127, 1.0, [[1], [2, 3]], {"k": "x"}), None),
        ("{}", (0, 0.0, [], {}), None), ('{"n":null,"l":null,"m":null,"z":5}', (0, 0.0, [], {}), None), ('{"m":{"k":{}},"l":[[]]}', (0, 0.0, [[]], {"k": ""}), None),
        ('{"n":{"i":128}}', None, "$.n.i: not of type tinyint"), ('{"n":{"i":1.0}}', None, "$.n.i: not of type tinyint"), ('{"n":{"i":1e1}}', None, "$.n.i: not of type tinyint"), ('{"n":{"d":1e999}}', None, "$.n.d: not of type double"),
        ('{"l":[[1],[2,"3"]]}', None, "$.l[1][1]: not of type int"), ('{"l":[1]}', None, "$.l[0]: not of type array<int>"), ('{"m":{"k":{"s":1}}}', None, "$.m.k.s: not of type string"), ('{"n":[]}', None, "$.n: not of type struct<i:tinyint,d:double>"),
        ("[]", None, "$: not of type"), ("x", None, "not JSON"), ("{} {}", None, "not JSON"), (None, None, "not JSON"), ('{"n":{"i":1,"i":2}}', None, "a key is repeated"),
    ]
    df = spark.createDataFrame(list(enumerate(c[0] for c in cases)), "i int, t string")
    read = decoded(F.col("t"), "n struct<i:tinyint,d:double>, l array<array<int>>, m map<string,struct<s:string>>, v variant")
    for (text, want, error), r in zip(cases, df.select("i", read.alias("r")).orderBy("i").collect(), strict=True):
        if error is None:
            v = r["r"]["value"]
            assert r["r"]["error"] is None and (v["n"]["i"], v["n"]["d"], v["l"], {k: x["s"] for k, x in v["m"].items()}) == want, text
        else:
            assert r["r"]["error"].startswith(error), text
    for bad in ("d date", "m map<int,string>"):
        with pytest.raises(ValueError):
            decoded(F.col("t"), bad)


def test_decoding_parses_a_text_twice_at_any_depth(spark):
    """Once for the values and once for repeated keys; each use at each depth parsed it anew."""
    for schema in ("a int", "n struct<i:tinyint,d:double>, l array<array<int>>, m map<string,struct<s:string>>, o struct<o:struct<o:struct<o:bigint>>>"):
        plan = spark.createDataFrame([], "t string").select(decoded(F.col("t"), schema).alias("r"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("parse_json(") == 2, schema


def page(page_id, html, most=3000):
    if page_id % 7 == 0:
        return None, "unexpected status 404"
    if page_id % 5 == 0:
        return None, "unsupported media type image/png"
    data = None if html is None else html.encode()
    if data is None:
        return None, None
    text = data[:most].decode("utf-8", "replace")
    if page_id % 5 != 1:
        text = visible_text(text)
    return text + (f"\n\n[webfetch: response truncated at {most} bytes]" if len(data) > most else ""), None


def test_page_text_of_all_pages(spark, tmp_path):
    rows = [(r["page_id"], r["html"]) for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()]
    # cuts inside characters of two to four bytes, inside a tag and inside a script
    cut = [c * 2 + "<p>" + "x" * n + c * 900 for c in ("é", "€", "😀") for n in range(4)]
    cut += ["<p>a</p>" * 374 + "<a href='" + "u" * 99, "k<script>" + "s" * 4000 + "</script>t", "", None]
    rows += [(10**6 + 35 * i + at, html) for i, html in enumerate(cut) for at in (1, 2, 3)]
    pq.write_table(pa.table({"page_id": pa.array([r[0] for r in rows], pa.int64()), "html": pa.array([r[1] for r in rows], pa.string())}), f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.text, r.error) for r in entry.queries()["page_text"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, html in rows:
        assert got[i] == page(i, html), i
    assert sum(error is None and i % 5 > 1 and bool(text) for i, (text, error) in got.items()) > 20
    assert any("�" in (text or "") for text, _ in got.values())


def test_byte_cap_of_all_documents(spark, tmp_path):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    # characters of one to four bytes over the cap, at it and on both sides of it
    rows += [(10**6 + 10 * k + n, "x" * (196 + n) + c + "y" * m) for k, (c, m) in enumerate((c, m) for c in ("z", "é", "€", "😀") for m in (0, 50)) for n in range(6)]
    rows += [(2 * 10**6, None), (2 * 10**6 + 1, "")]
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}), f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.bytes, r.text) for r in entry.queries()["truncate_bytes"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        data = None if text is None else text.encode()
        want = text if data is None or len(data) <= 200 else data[:200].decode("utf-8", "replace") + "\n\n[fileread: file truncated at 200 bytes]"
        assert got[i] == (None if data is None else len(data), want), i
    assert sum("�" in (text or "") for _, text in got.values()) > 10
