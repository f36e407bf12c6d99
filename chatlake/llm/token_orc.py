"""Token ids in ORC files: run-length encoded integers, row indexes and Bloom filters on document ids.

``write_token_files`` range-partitions the documents by id, encodes each text with the tokenizers
library inside its task, and writes one ORC file a range, so that files, stripes and rows ascend by
document id. ``read_token_files`` reads them back; stripes are read in parallel, and a filter on
``doc_id`` skips files and row groups by their statistics and Bloom filters. ``token_index`` adds
each document's place in the stream of all ids: only the ranges' sums (one row a file) meet in one
task, the rest is summed within each file.

Defined cases: null and empty texts hold the end id alone; documents with equal ids are ordered by
their text; null document ids come first; an empty table makes an empty result; further
columns aren't written.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlake.llm.bpe import beyond_low, byte_letters, low_cut, public_vocabulary
from chatlake.llm.common import SPACES, Held, column, materialise, read, scratch_path, slices

END_ID = 2
#: Words of one call of the library.
TOGETHER = 64


def piece_pattern(spec: dict) -> str | None:
    """The pattern that cuts texts into what the merges see, where that is all a tokenizer file asks for.

    Its normalizers must be NFC, white space to one space, and lower-casing; its pre-tokenizer must
    keep only a pattern's finds, none of which holds white space, as byte letters; its model must be
    plain BPE. Then a word's ids depend on the word alone, and a piece's ids on the piece.
    """
    normalizers = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    model = spec["model"]
    plain = model["type"] == "BPE" and not model.get("dropout") and model.get("unk_token") is None and model.get("continuing_subword_prefix") is None
    if (spec.get("normalizer") or {}).get("normalizers") != normalizers or len(cuts) != 2 or not plain:
        return None
    split, letters = cuts
    pattern = str((split.get("pattern") or {}).get("Regex"))
    kept = split["type"] == "Split" and split["behavior"] == "Removed" and split["invert"]
    known = re.fullmatch(r"((^|\|)('[a-z]+|\[\\p\{[LN]\}\]\+?|\[\^\\s\\p\{L\}\\p\{N\}\]\+))+", pattern)
    return pattern if kept and known and letters["type"] == "ByteLevel" and not letters["add_prefix_space"] and not letters["use_regex"] else None


class WordIds:
    """Texts -> packed ids by the tokenizers library, each distinct piece or word once a cache generation.

    Where the file's pieces are known (``piece_pattern``), texts are cut by its own pattern and the
    library merges each distinct piece. Words beyond code point ``LOW``, where normalizing may change
    more than case, go to the library as words, parted by a special token, whose id parts their ids
    again. Texts that may hold special tokens, and all texts under other files, go to it whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        added = spec.get("added_tokens", [])
        bare = [t for t in added if not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"])]
        pattern = piece_pattern(spec)
        self.cut = low_cut(pattern) if pattern and bare == added != [] else None
        self.mark = (added[0]["content"], added[0]["id"]) if self.cut else None
        self.special = tuple({t["content"][:2] for t in added})
        self.merges = self.tok.model.tokenize
        self.letters = dict(enumerate(byte_letters()))
        self.words = re.compile(f"[^{SPACES}]+").findall
        self.known = Held()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("i", x.ids).tobytes() for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _make(self, keys: list[str]) -> list[bytes]:
        """A key is a piece, or a line feed and a word."""
        words = iter(self._together([k[1:] for k in keys if k[0] == "\n"]))
        return [next(words) if k[0] == "\n" else self._merged(k) for k in keys]

    def _merged(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isalpha()):
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return array("i", [t.id for t in self.merges(piece)]).tobytes()

    def _together(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(words), TOGETHER):
            own = words[at : at + TOGETHER]
            ids = np.array(self.tok.encode_batch_fast([self.mark[0].join(own)], add_special_tokens=False)[0].ids, "<i4")
            ends = [*np.flatnonzero(ids == self.mark[1]).tolist(), len(ids)]
            packed = ids.tobytes()
            out += [packed[4 * a : 4 * b] for a, b in zip([0, *(e + 1 for e in ends[:-1])], ends, strict=True)]
        return out

    def _keys(self, text: str) -> list[str]:
        if not beyond_low(low := text.lower()):
            return self.cut(low)
        return [k for w in self.words(text) for k in ([f"\n{w}"] if beyond_low(w.lower()) else self.cut(w.lower()))]

    def encode(self, texts: list[str]) -> list[bytes]:
        rows = [self._keys(t) if self.cut and not any(s in t for s in self.special) else None for t in texts]
        distinct: set[str] = set()
        for own in rows:
            distinct.update(own or ())
        get = self.known.fill(distinct, self._make).__getitem__
        whole = iter(self._whole([t for t, own in zip(texts, rows, strict=True) if own is None]))
        return [next(whole) if own is None else b"".join(map(get, own)) for own in rows]


_LOADED: dict[str, WordIds] = {}


def load(path: str) -> WordIds:
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def encode_words(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, text -> doc_id, row (number within its partition), ids array<int> with the end id last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end, row = load(vocabulary), np.array([end_id], "<i4").tobytes(), 0
        for batch in batches:
            for part in slices(batch, "text"):
                packed = [x + end for x in words.encode([t or "" for t in column(part, "text")])]
                offsets = np.cumsum([0, *(len(x) // 4 for x in packed)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))
                rows = pa.array(np.arange(row, row := row + part.num_rows), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), rows, ids], names=["doc_id", "row", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, row bigint, ids array<int>")


def write_token_files(docs: DataFrame, path: str, vocabulary: str, stripe_mb: int = 16, bloom_fpp: float = 0.01) -> None:
    ranged = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    writer = encode_words(ranged, vocabulary).write
    for k, v in {
        "compression": "zlib",
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": str(bloom_fpp),
        "orc.stripe.size": str(stripe_mb << 20),
        "orc.row.index.stride": "1000",
    }.items():
        writer = writer.option(k, v)
    writer.orc(path)


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, row, ids; with ``doc_ids``, stripes and row groups without them are skipped."""
    df = spark.read.schema("doc_id bigint, row bigint, ids array<int>").orc(path)
    return df if doc_ids is None else df.where(F.col("doc_id").isin(doc_ids))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document: its first id's place in the stream, number of ids, and their checksum."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("ids")
            at = col.offsets.to_numpy()
            view = memoryview(np.ascontiguousarray(col.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("file"), batch.column("row"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["doc_id", "file", "row", "n_tokens", "ids_crc32"],
            )

    each = read_token_files(spark, path).withColumn("file", F.regexp_extract(F.col("_metadata.file_name"), "part-(\\d+)", 1).cast("int"))
    each = materialise(each.mapInArrow(sums, "doc_id bigint, file int, row bigint, n_tokens bigint, ids_crc32 bigint"), "token-sums")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = each.groupBy("file").agg(F.sum("n_tokens").alias("ids")).select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        each.withColumn("own", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(files, "file")
        .select("doc_id", (F.col("first") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")
    )


def op6_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_token_files(read(spark, sf_dir, "documents"), path, public_vocabulary("word_bpe_49k.json"))
    return token_index(spark, path)
