"""Ranked lexical search: a broadcast automaton of all items' terms counts them in the documents' texts.

Terms are the maximal runs of ASCII letters, digits and code points from 128, with A-Z lower-cased. A
text is read as UTF-8 with every other byte turned into a guard, and an Aho-Corasick automaton of
guard + term + guard finds all items' terms in one pass, each with its frequency; no index of
the documents is built and no text is shuffled. The automaton's outputs, term numbers, map to the items
that hold the term and how often.

1. Items become term lists, written to the shared folder. They are dealt to groups so that a group's
   terms stay near ``GROUP_BYTES``; each group has its own automaton and its own two scans.
2. The first scan counts documents, terms and each term's documents, summed within tasks and then by term.
3. The second scan scores each document against all items at once and keeps each item's best in its
   task; windows by (item, part) and then by item keep the best of all.

The weights and scores are as the contract of ``op12_lexical_search`` states them, in 64-bit integers.

Defined cases: null texts have no terms, and neither have documents or items without a letter; items
without terms, and items whose terms no document holds, have no rows; repeated items are ranked each
for itself, also under one id; repeated documents are documents of their own; equal scores are
ranked by ascending id, null ids last; with no documents or no items there are no rows; other columns
are dropped. An item whose distinct terms hold over ``MOST_BYTES`` is an error, as no automaton of
bounded size holds it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.llm.common import column, materialise, read, slices, texts

#: Bytes of a group's terms that are aimed at, and that a group must never exceed.
GROUP_BYTES, MOST_BYTES = 4 << 20, 64 << 20
#: Scores held at once while documents are ranked.
HELD = 1 << 21
_GUARD = b" "
#: Every byte as a term has it; bytes between terms become guards.
_TABLE = bytes(b | 0x20 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else _GUARD[0] for b in range(256))
DOCUMENTS, TERMS = -1, -2


def guarded(text: bytes) -> bytes:
    """A text whose terms stand between guards."""
    return b"%b%b%b" % (_GUARD, text.translate(_TABLE), _GUARD)


class Group(NamedTuple):
    """Items by number, their distinct terms, and the (term, item, times) triples sorted by term."""

    rows: np.ndarray
    terms: list[bytes]
    starts: np.ndarray
    items: np.ndarray
    times: np.ndarray


def group_of(items: list[tuple[int, list[bytes], list[int]]]) -> Group:
    """(row, distinct terms, how often each) -> the group of these items."""
    rows = np.array([r for r, _, _ in items], np.int64)
    terms = sorted({t for _, own, _ in items for t in own})
    number = {t: i for i, t in enumerate(terms)}
    triples = np.array([(number[t], i, n) for i, (_, own, times) in enumerate(items) for t, n in zip(own, times, strict=True)], np.int64).reshape(-1, 3)
    triples = triples[np.argsort(triples[:, 0], kind="stable")]
    starts = np.searchsorted(triples[:, 0], np.arange(len(terms) + 1))
    return Group(rows, terms, starts, triples[:, 1], triples[:, 2])


def automaton(terms: list[bytes]):
    """Reports the number of every term that stands between guards, overlapping guards included."""
    import ahocorasick

    out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, t in enumerate(terms):
        out.add_word((_GUARD + t + _GUARD).decode("latin-1"), i)
    out.make_automaton()
    return out


def counted(found, text: bytes) -> tuple[int, Counter]:
    """How many terms a text has, and the frequencies of the automaton's."""
    ready = guarded(text)
    n = len(ready.split())
    return n, Counter([i for _, i in found.iter(ready.decode("latin-1"))]) if n else Counter()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _item_terms(items: DataFrame) -> DataFrame:
    """item_id, text -> row, item_id, terms (distinct), times, size (bytes of the terms)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                own = [Counter(guarded(t).split()) for t in texts(part, "text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([list(c) for c in own], pa.list_(pa.binary())), pa.array([list(c.values()) for c in own], pa.list_(pa.int64())), pa.array([sum(map(len, c)) for c in own], pa.int64())],
                    names=["row", "item_id", "terms", "times", "size"],
                )

    numbered = items.select(F.monotonically_increasing_id().alias("row"), "item_id", "text")
    schema = T.StructType([*numbered.select("row", "item_id").schema.fields, *T.StructType.fromDDL("terms array<binary>, times array<bigint>, size bigint").fields])
    return numbered.mapInArrow(run, schema).where("size > 0")


def _groups(items: DataFrame, group_bytes: int, most_bytes: int) -> Iterator[Group]:
    """Groups of bounded size; each is fetched only when the one before it is done with."""
    size, most = items.agg(F.sum("size"), F.max("size")).first()
    if not size:
        return
    if most > most_bytes:
        raise ValueError(f"an item's terms hold {most} bytes; {most_bytes} are the most")
    n = -(-size // group_bytes)
    # hashed into parts of the aimed size, and cut where a part is still above it
    order = Window.partitionBy("part").orderBy("row")
    dealt = items.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(n))).withColumn("cut", F.floor((F.sum("size").over(order) - F.col("size")) / F.lit(group_bytes)))
    dealt = materialise(dealt, "item-groups")
    for part, cut in dealt.select("part", "cut").distinct().orderBy("part", "cut").collect():
        own = dealt.where((F.col("part") == part) & (F.col("cut") == cut)).select("row", "terms", "times").toArrow()
        yield group_of(list(zip(*(own.column(c).to_pylist() for c in ("row", "terms", "times")), strict=True)))


def _statistics(docs: DataFrame, held) -> dict[int, int]:
    """Term number -> documents that hold it; DOCUMENTS and TERMS -> how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, holding, documents, terms = automaton(held.value.terms), np.zeros(len(held.value.terms), np.int64), 0, 0
        for batch in batches:
            for part in slices(batch, "text"):
                for t in texts(part, "text"):
                    n, tf = counted(found, t)
                    documents += n > 0
                    terms += n
                    holding[list(tf)] += 1
        some = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array([DOCUMENTS, TERMS, *some.tolist()], pa.int64()), pa.array([documents, terms, *holding[some].tolist()], pa.int64())], names=["term", "n"])

    sums = docs.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(sums.column("term").to_pylist(), sums.column("n").to_pylist(), strict=True))


class Best:
    """The ``k`` best (score, then smaller id, nulls last) of each of some items, in bounded memory."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.parts: list[np.ndarray] = []
        self.held, self.most = 0, 4 * items * k + (1 << 16)

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """scores: a row a document, a column an item."""
        d, i = np.nonzero(scores >= self.least)
        self.parts.append(np.stack([i, scores[d, i], ids[d], null[d]]))
        self.held += len(d)
        if self.held > self.most:
            self.cut()

    def cut(self) -> np.ndarray:
        rows = np.concatenate([*self.parts, np.empty((4, 0), np.int64)], axis=1)
        rows = rows[:, np.lexsort((rows[2], rows[3], -rows[1], rows[0]))]
        first = np.searchsorted(rows[0], rows[0])
        place = np.arange(rows.shape[1]) - first
        rows = rows[:, place < self.k]
        last = place[place < self.k] == self.k - 1
        self.least[rows[0, last]] = rows[1, last]
        self.parts, self.held = [rows], rows.shape[1]
        return rows


def _scores(group: Group, weights: np.ndarray, counts: list[tuple[int, Counter]], documents: int, terms: int) -> np.ndarray:
    """A row of all items' scores for each document."""
    doc, term, worth = [], [], []
    for d, (n, tf) in enumerate(counts):
        if tf:
            m = 25 + (75 * n * documents) // terms
            doc.append(np.full(len(tf), d))
            term.append(np.fromiter(tf, np.int64, len(tf)))
            f = np.fromiter(tf.values(), np.int64, len(tf))
            worth.append((1_000_000_000 * f) // (1000 * f + 8 * m))
    out = np.zeros(len(counts) * len(group.rows), np.int64)
    if doc:
        doc, term, worth = np.concatenate(doc), np.concatenate(term), np.concatenate(worth)
        worth *= weights[term]
        many = group.starts[term + 1] - group.starts[term]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(group.starts[term], many)
        np.add.at(out, np.repeat(doc, many) * len(group.rows) + group.items[at], np.repeat(worth, many) * group.times[at])
    return out.reshape(len(counts), len(group.rows))


def _ranked(docs: DataFrame, held, weights: np.ndarray, documents: int, terms: int, k: int) -> DataFrame:
    """row, doc_id, score: each task's best documents of each of a group's items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: Group = held.value
        found, best = automaton(group.terms), Best(len(group.rows), k)
        rows = max(1, HELD // max(len(group.rows), 1))
        for batch in batches:
            for part in slices(batch, "text", rows=min(rows, 256)):
                counts = [counted(found, t) for t in texts(part, "text")]
                ids = column(part, "doc_id")
                null = np.array([x is None for x in ids], np.int64)
                best.add(_scores(group, weights, counts, documents, terms), np.array([x or 0 for x in ids], np.int64), null)
        item, score, ids, null = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(group.rows[item]), pa.array(ids, mask=null.astype(bool)), pa.array(score)], names=["row", "doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "row bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 10, group_bytes: int = GROUP_BYTES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, text; item_id, text -> item_id, rank (int), doc_id, score: each item's k best documents."""
    spark = docs.sparkSession
    listed = materialise(_item_terms(items), "item-terms")
    found = []
    for group in _groups(listed, group_bytes, most_bytes):
        held = spark.sparkContext.broadcast(group)
        sums = _statistics(docs, held)
        documents, terms = sums.get(DOCUMENTS, 0), sums.get(TERMS, 0)
        if documents:
            weights = np.array([weight(documents, sums.get(i, 0)) for i in range(len(group.terms))], np.int64)
            found.append(materialise(_ranked(docs, held, weights, documents, terms, k), "ranked"))
        held.unpersist()
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    rows = reduce(DataFrame.union, found) if found else spark.createDataFrame([], "row bigint, doc_id bigint, score bigint")
    parted = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(256))).withColumn("own", F.row_number().over(Window.partitionBy("row", "part").orderBy(*order))).where(F.col("own") <= k)
    ranks = parted.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*order))).where(F.col("rank") <= k)
    return ranks.join(listed.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
i as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from benchmark),
q as (select item_id, term, count(*) as times from (select item_id, unnest(ts) as term from i) group by 1, 2),
tf as (select r, term, count(*) as tf from (select r, unnest(ts) as term from d) group by 1, 2),
g as (select count(*) filter (len(ts) > 0) as documents, sum(len(ts))::bigint as terms from d),
w as (select term, floor(1000 * ln((2 * documents + 2)::double / (2 * df + 1)::double))::bigint as w from (select term, count(*) as df from tf group by 1), g),
n as (select r, doc_id, 25 + (75 * len(ts) * documents) // terms as m from d, g),
s as (select item_id, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score from q join w using (term) join tf using (term) join n using (r) group by 1, 2, 3)
select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0) where rank <= 10
"""
