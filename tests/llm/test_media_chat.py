import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from chatlake.llm import chat_template as C
from chatlake.llm import transport_stream as T
from tests.conftest import SF


def rendered(template, **env):
    return "".join(t for t, _ in C.compile_template(template)(env))


@pytest.mark.parametrize(
    "template, expected",
    [
        ("a{{ 1 + 2 }}b", "a3b"),
        ("{% if x == 'u' %}U{% elif x %}X{% else %}-{% endif %}", "X"),
        ("{% for m in ms %}{{ loop.index }}{{ m.t }}{% if not loop.last %},{% endif %}{% endfor %}", "1p,2q"),
        ("{% set y = x ~ '!' %}{{ y | upper }}", "V!"),
        ("a  {%- if true %} b {%- endif -%}  c", "a bc"),
        ("{# no #}{{ none }}{{ missing.deep }}", ""),
        ("{{ '{{' }}{{ 'a\\'b' }}", "{{a'b"),
    ],
)
def test_templates(template, expected):
    assert rendered(template, x="v", ms=[{"t": "p"}, {"t": "q"}]) == expected


@pytest.mark.parametrize("template", ["{{ x.__class__ }}", "{{ f() }}", "{% if x %}", "{% exec %}", "{{ x | nope }}", "{{ }}"])
def test_sandbox(template):
    with pytest.raises(C.TemplateError):
        C.compile_template(template)


def test_constants_fold():
    assert C.fold(C.parse("a{% if 1 == 2 %}x{% else %}{{ 'b' ~ 1 }}{% endif %}{{ 'c' | upper }}")) == (C.Out(C.Const("ab1C")),)


def test_conversations_read_back(spark):
    rows = [(1, 1, "assistant", "<|end|>\n\\|"), (1, 0, "user", None), (1, 2, None, ""), (None, 0, "assistant", "x" * 200_000), (2, 0, "user", "a"), (2, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1))
    out = {r.conv_id: r for r in C.format_digests(C.format_conversations(df)).collect()}
    assert out[1].turns_sha256 == hashlib.sha256("user\n\nassistant\n<|end|>\n\\|\n\n\n".encode()).hexdigest()
    assert out[1].loss_sha256 == hashlib.sha256("<|end|>\n\\|".encode()).hexdigest() and out[1].loss_chars == 10
    assert out[None].loss_chars == 200_000 and out[2].n_turns == 2
    assert C.format_digests(C.format_conversations(df.limit(0))).count() == 0


@pytest.mark.parametrize("size", [0, 1, 64, 157, 158, 159, 176, 340, 341, 342, 343, 32_767, 32_768, 32_769, 700_000])
def test_transport_round_trip(size):
    data = random.Random(size).randbytes(size)
    media = T.mux(data)
    found = T.demux(media)
    assert len(media) % 188 == 0 and found.payload == data and found.programs == 1
    assert found.sync_errors + found.crc_errors + found.continuity_errors + found.duplicates == 0
    assert found.units == max(1, -(-size // T.UNIT)) == len(found.random_access)
    assert found.timestamps == [i * T.UNIT * T.CLOCK // T.SAMPLE_RATE for i in range(found.units)]


def test_transport_damage():
    media = bytearray(T.mux(b"abc" * 3000))
    lost = bytes(media[: 188 * 5] + media[188 * 6 :])
    assert T.demux(lost).continuity_errors == 1
    again = bytes(media[: 188 * 5] + media[188 * 4 : 188 * 5] + media[188 * 5 :])
    assert T.demux(again).duplicates == 1 and T.demux(again).payload == b"abc" * 3000
    media[20] ^= 1
    assert T.demux(bytes(media)).crc_errors > 0 or T.demux(bytes(media)).programs == 1
    assert T.demux(b"").programs == 0 and T.demux(b"\x47" * 10).sync_errors == 1


def test_media_query_against_brute_force(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = T.op3_transport_stream(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        payload = T.pad(docs[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(docs[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_sha256 == hashlib.sha256(T.mux(payload)).hexdigest() and r.feature.endswith("errors=0")


def test_media_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, ""), (None, "é")], "doc_id long, text string").withColumn("payload", F.lit(1))
    rows = T.demux_column(T.mux_column(df, ["doc_id"], "text")).collect()
    assert sorted(len(r.payload) for r in rows) == [64, 64, 64] and T.demux_column(T.mux_column(df.limit(0), ["doc_id"], "text")).count() == 0


def test_missing_values_and_types_that_don_t_fit():
    """Missing values have no length, are in no order and hold nothing; other misfits are the template's error."""
    shown = lambda template: "".join(t for t, _ in C.compile_template(template)({"m": "x"}))
    assert shown("{{ gone | length }}{{ gone < 1 }}{{ 1 >= gone }}{{ 'a' in gone }}{{ gone + 'b' }}{{ 1 + gone }}") == shown("{{ 0 }}{{ false }}{{ false }}{{ false }}b1")
    for wrong in ("{{ m < 1 }}", "{{ m + 1 }}", "{{ 1 in 2 }}", "{{ 1 | length }}", "{{ 'a' in 1 + m }}"):
        with pytest.raises(C.TemplateError):
            shown(wrong)
