import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chatlake.llm import bpe, token_orc
from tests.conftest import SF

LETTERS = "ab'sdve  \n\t\x0b\x1c\x85\xa0éßΣσ1٣½中😀.,!́​　K<|>"


def samples(n):
    rnd = random.Random(0)
    for _ in range(n):
        s = "".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 30)))
        yield s + rnd.choice(["", "", "", "<|endoftext|>" + s, "<|ENDOFTEXT|>A"])


def test_bpe_equals_library():
    path = bpe.public_vocabulary("byte_bpe_50k.json")
    ours, theirs = bpe.load(path), Tokenizer.from_file(path)
    texts = [*samples(3000), "", "a" * 50_000, "the " * 3000, *("xyz" * n for n in range(60)), *(chr(c) + " " + chr(c) + "a" for c in range(0x300))]
    ids = [theirs.encode(s, add_special_tokens=False).ids for s in texts]
    packed = ours.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in packed] == ids
    assert ours.encode(texts[::-1])[::-1] == packed
    assert ours.decode(packed).to_pylist() == texts == [theirs.decode(x, skip_special_tokens=False) for x in ids]
    rnd = random.Random(1)
    some = [[rnd.randrange(50_257) for _ in range(9)] for _ in range(500)]
    assert ours.decode([np.array(x, "<u4").tobytes() for x in some]).to_pylist() == [theirs.decode(x, skip_special_tokens=False) for x in some]
    assert ours.decode([np.array([60_000, some[0][0]], "<u4").tobytes(), b""]).to_pylist() == [theirs.decode(some[0][:1], skip_special_tokens=False), ""]


def test_pair_tree_takes_leftmost_lowest():
    ranks = {1 << 20 | 1: (0, 2), 2 << 20 | 2: (1, 3), 2 << 20 | 1: (2, 4)}
    rnd = random.Random(2)
    for _ in range(300):
        ids = [rnd.choice([1, 1, 1, 5]) for _ in range(rnd.randint(0, 40))]
        plain = list(ids)
        while hits := [(ranks[plain[i] << 20 | plain[i + 1]][0], i) for i in range(len(plain) - 1) if plain[i] << 20 | plain[i + 1] in ranks]:
            i = min(hits)[1]
            plain[i : i + 2] = [ranks[plain[i] << 20 | plain[i + 1]][1]]
        assert bpe.PairTree(ranks).merged(ids) == plain


def test_forest_equals_tree():
    rnd = random.Random(3)
    for _ in range(20):
        pairs = {}
        for rank in range(rnd.randint(1, 60)):
            pairs.setdefault(rnd.randrange(rank // 3 + 4) << 20 | rnd.randrange(rank // 3 + 4), 4 + rank)
        ranks = {k: (rank, v) for rank, (k, v) in enumerate(pairs.items())}
        forest, byte_ids = bpe.PairForest(ranks), np.array([b % 4 for b in range(256)], np.int32)
        sequences = [bytes(rnd.randrange(256) for _ in range(rnd.choice([0, 1, 2, 3, 4, 8, 9, 17, 30, 64, 65, 127, 128, 129, 300]))) for _ in range(300)]
        got = [np.frombuffer(x, "<u4").tolist() for x in forest.merged(sequences, byte_ids)]
        assert got == [bpe.PairTree(ranks).merged([b % 4 for b in x]) for x in sequences]


def test_op10_whole_query(spark):
    import hashlib

    import pyarrow.parquet as pq

    theirs = Tokenizer.from_file(bpe.public_vocabulary("byte_bpe_50k.json"))
    want = {}
    for r in pq.read_table(f"{SF}/documents.parquet").to_pylist():
        ids = theirs.encode(r["text"] or "", add_special_tokens=False).ids
        back = theirs.decode(ids, skip_special_tokens=False)
        want[r["doc_id"]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    rows = bpe.op10_bpe(spark, SF).collect()
    assert len(rows) == len(want)
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == want


def test_bpe_columns(spark):
    path = bpe.public_vocabulary("byte_bpe_50k.json")
    df = spark.createDataFrame([(1, "Hi there"), (2, None), (2, ""), (None, "x")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    out = bpe.bpe_decode(bpe.bpe_encode(df, path), path)
    assert sorted((r.text or "") == r.decoded for r in out.collect()) == [True] * 4
    assert bpe.bpe_encode(df.limit(0), path).count() == 0


def test_word_ids_equal_library(tmp_path):
    import json

    path = bpe.public_vocabulary("word_bpe_49k.json")
    ours = token_orc.load(path)
    assert ours.cut
    texts = [*samples(3000), "", "e\u0301 \xe9t\xe9, \u01c6 stra\xdfe. ABC, \u0130x \u023a\u0181 \xe0\xe8.", "a" * 5000, *(f"a{chr(c)} {chr(c)}b{chr(c)}" for c in range(0xD000))]
    want = [x.ids for x in ours.tok.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<i4").tolist() for x in ours.encode(texts)] == want
    # another file's pieces aren't assumed to be these
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": []}):
        other = tmp_path / f"{next(iter(change))}.json"
        other.write_text(json.dumps(spec | change))
        theirs = token_orc.load(str(other))
        assert not theirs.cut
        assert [np.frombuffer(x, "<i4").tolist() for x in theirs.encode(texts[:300])] == [x.ids for x in theirs.tok.encode_batch(texts[:300], add_special_tokens=False)]


@pytest.fixture(scope="module")
def expected():
    import pyarrow.parquet as pq

    tok = Tokenizer.from_file(bpe.public_vocabulary("word_bpe_49k.json"))
    rows, start = [], 0
    for r in sorted(pq.read_table(f"{SF}/documents.parquet").to_pylist(), key=lambda r: r["doc_id"]):
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        rows.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return rows


def test_token_files(spark, tmp_path, expected):
    assert sorted(map(tuple, token_orc.op6_token_orc(spark, SF).collect())) == expected
    path = str(tmp_path / "orc")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    token_orc.write_token_files(docs, path, bpe.public_vocabulary("word_bpe_49k.json"))
    assert [r.doc_id for r in token_orc.read_token_files(spark, path, [7]).collect()] == [7]


def test_token_files_edges(spark, tmp_path):
    df = spark.createDataFrame([(3, None), (None, "a"), (1, "b b"), (1, "a")], "doc_id long, text string")
    for name, part, want in (("some", df, [(None, 0, 2), (1, 2, 2), (1, 4, 3), (3, 7, 1)]), ("none", df.limit(0), [])):
        token_orc.write_token_files(part, str(tmp_path / name), bpe.public_vocabulary("word_bpe_49k.json"))
        got = [(r.doc_id, r.start, r.n_tokens) for r in token_orc.token_index(spark, str(tmp_path / name)).collect()]
        assert sorted(got, key=lambda r: r[1]) == want


def test_files_hold_indexes_blooms_and_run_lengths(spark, tmp_path):
    """Stripe footers list row indexes, Bloom filters on ids alone, and second-version run lengths; a filter skips row groups."""
    path = str(tmp_path / "orc")
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    token_orc.write_token_files(docs.coalesce(1), path, bpe.public_vocabulary("word_bpe_49k.json"))
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files = [f for f in sorted(tmp_path.joinpath("orc").iterdir()) if f.suffix == ".orc"]
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(f)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        rows = reader.rows()
        footer = rows.readStripeFooter(reader.getStripes().get(0))
        streams = {(s.getKind().toString(), s.getColumn()) for s in footer.getStreamsList()}
        assert reader.getRowIndexStride() == 1000 and ("ROW_INDEX", 1) in streams
        assert {c for kind, c in streams if kind.startswith("BLOOM_FILTER")} == {1}
        assert {footer.getColumns(c).getKind().toString() for c in (1, 2, 3, 4)} == {"DIRECT_V2"}
        rows.close()
    found = token_orc.read_token_files(spark, path, [4321])
    assert [r.doc_id for r in found.collect()] == [4321]
    assert "EqualTo(doc_id,4321)" in found._jdf.queryExecution().toString()
