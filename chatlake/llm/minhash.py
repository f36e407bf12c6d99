"""Near-duplicates: universal hash minima, banding, verified links, and components of the links.

1. Each text becomes its set of hashed word shingles (64 bits each) and a digest of that set.
   Equal sets are one *class*, named by the smallest row number among its documents.
2. A class's signature is the minima of ``BANDS * ROWS`` multiply-add functions. Classes that share a
   band's rows are candidates: each is joined to the first of its bucket, never to all others. A pair
   at similarity 0.8 shares no bucket with probability (1 - 0.8^10)^110 < 4e-6, and one at 0.1 shares
   one with probability 1e-8, so that chance candidates stay few where there are many documents.
3. Components of candidates are *clusters*; links are looked for within them, in blocks. First one
   block of each cluster meets all members; the links found are components already. Then every
   member outside its cluster's largest component is a query against all members, blocks of queries
   against blocks of members. A pair that is never compared therefore lies within one component, so
   no link between components is lost.
4. Within a block, pairs whose signatures agree too little are passed over (a link at 0.8 would have
   to miss by over 5 standard deviations), and the others are confirmed on the full sets unless
   they are connected already.
5. Components of links by large-star and small-star give the classes' groups; documents get theirs
   by joins on the class, in which classes and clusters with over a thousandth of all rows (so at
   most a thousand) are broadcast.

No bucket, cluster or component is gathered: buckets are sorted over ranges that may split them, and
tasks hold one block of members and one of queries, both bounded in rows and in shingles. Only
counts reach the driver. What a step no longer needs is deleted once the next one is written.

Defined cases: null, empty and blank texts have the empty set and are linked with nothing; a text
with fewer words than a shingle is one shingle; equal rows share a class; ids that occur with several
texts are rows of their own, each in its own text's group; a null id names no group, and its row is
kept; an empty table gives an empty result; other columns are dropped unless named in ``keys``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlake.llm.common import delete, joined, materialise, read, slices, texts
from chatlake.llm.components import components

BANDS, ROWS = 110, 10
#: Minima of which a sketch keeps 16 bits each.
SKETCH = 256
#: Members and queries of a block, and shingles that all of either may have.
BLOCK, BLOCK_SHINGLES = 256, 400_000
_HASH = xxhash.xxh64_intdigest


def shingles(text: bytes, size: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of ``size`` words, A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASH, words), np.uint64, len(words))
    n = min(size, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def hash_functions(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and addends of n functions a * x + b of 32-bit keys to 32 bits."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


_A, _B = hash_functions(BANDS * ROWS)
#: A random linear function of a band's minima, and an addend for each band.
_MIX = np.random.default_rng(8).integers(0, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = np.random.default_rng(9).integers(0, 1 << 63, BANDS, np.uint64)


def signature(s: np.ndarray, functions: int = BANDS * ROWS) -> np.ndarray:
    """The minima of the first functions over a set, as 32-bit integers."""
    keys = (s >> np.uint64(32)).astype(np.uint32)[:, None]
    a, b = _A[:functions], _B[:functions]
    low = np.full(functions, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(keys), 256):
        values = keys[at : at + 256] * a
        values += b
        np.minimum(low, values.min(axis=0), out=low)
    return low


def buckets_of(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit number for each band of each signature."""
    mixed = (signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64) * _MIX).sum(axis=2, dtype=np.uint64) + _BAND
    mixed ^= mixed >> np.uint64(31)
    return (mixed * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def signed(docs: DataFrame, size: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text -> doc_id, the keys, place, n_shingles, digest (of the set; null if empty), bands.

    ``place`` is a hash of the text, by which the texts that take part are found again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingles(t, size) for t in texts(part, "text")]
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                some = [s for s in sets if len(s)]
                flat = np.concatenate([buckets_of(signature(s)[None])[0] for s in some]) if some else np.empty(0, np.int64)
                offsets = np.concatenate([[0], np.cumsum([BANDS if len(s) else 0 for s in sets])]).astype(np.int32)
                kept = [n for n in part.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(n)) for n in kept), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                    names=[*kept, "n_shingles", "digest", "bands"],
                )

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *keys, F.xxhash64("text").alias("place"), "text")
    schema = own.drop("text").select("*", F.lit(None).cast("bigint").alias("n_shingles"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("array<bigint>").alias("bands")).schema
    return own.mapInArrow(run, schema)


def _hashes(*columns: str, bits: int = 27) -> list:
    """Three places in a Bloom filter of 2^bits bits."""
    return [F.shiftrightunsigned(F.xxhash64(*columns, F.lit(i)), 64 - bits).alias(f"h{i}") for i in range(3)]


def _sieve(rows: DataFrame, *columns: str, bits: int = 27) -> np.ndarray:
    """A Bloom filter of 2^bits bits (16 MB whatever the input) over some columns.

    One grouped sum of bits; at most 2^(bits - 6) words of 64 bits reach the driver. What it lets
    through beside the rows is more work and no other result.
    """
    places = rows.select(F.explode(F.array(*_hashes(*columns, bits=bits))).alias("at"))
    words = places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("set")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("set").to_numpy().view(np.uint64)
    return out


def _passes(batch: pa.RecordBatch, sieve: np.ndarray) -> pa.RecordBatch:
    passed = np.ones(batch.num_rows, bool)
    for i in range(3):
        at = batch.column(batch.schema.get_field_index(f"h{i}")).to_numpy()
        passed &= (sieve[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
    return batch.filter(pa.array(passed))


def _evidence(docs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """doc_id, text -> digest, sketch (16 bits of each minimum), shingles (sorted 64-bit hashes).

    Of the members' texts, and of the few others that pass the Bloom filter: texts are scanned in
    place and not shuffled. A row that occurs more than once comes once a partition.
    """
    held = docs.sparkSession.sparkContext.broadcast(_sieve(members, "doc_id", "place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, seen = held.value, set()
        for batch in batches:
            for part in slices(_passes(batch, sieve), "text"):
                sets = []
                for first, t in zip(part.column("h").to_pylist(), texts(part, "text"), strict=True):
                    if first not in seen:
                        seen.add(first)
                        sets.append(shingles(t, size))
                sets = [s for s in sets if len(s)]
                sketches = [(signature(s, SKETCH) & np.uint32(0xFFFF)).astype(np.uint16).tobytes() for s in sets]
                packed = [s.tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in packed], pa.binary()), pa.array(sketches, pa.binary()), pa.array(packed, pa.binary())], names=["digest", "sketch", "shingles"])

    placed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("place"), "text")
    return placed.select("text", F.xxhash64("doc_id", "place").alias("h"), *_hashes("doc_id", "place")).mapInArrow(run, "digest binary, sketch binary, shingles binary")


def _buckets(hashed: DataFrame, classes: DataFrame) -> DataFrame:
    """row, bands -> bucket, node: of the classes' first rows, and of few others of the same classes."""
    held = hashed.sparkSession.sparkContext.broadcast(_sieve(classes.withColumnRenamed("node", "row"), "row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _passes(batch, held.value)
            nodes = np.repeat(own.column("row").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([own.column("bands").flatten(), pa.array(nodes)], names=["bucket", "node"])

    return hashed.where("digest is not null").select("row", "bands", *_hashes("row")).mapInArrow(run, "bucket bigint, node bigint")


def _candidates(buckets: DataFrame) -> DataFrame:
    """bucket, node -> distinct edges that join the classes of each bucket, about one a class.

    Each class meets the first of its buckets, within ranges of sorted buckets. A class has one edge a
    band at most (and as many again across ranges): it keeps the one to its smallest neighbour, and its
    other neighbours, few among a group's many classes, are joined to that one instead.

    A range's last bucket may go on in the next range: the first nodes of each range's first and last
    buckets, two rows a range, are joined to the smallest of their bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = hub = None
        started = False

        def out(buckets: list, u: list, v: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["bucket", "u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            b, node = batch.column("bucket").to_numpy(), batch.column("node").to_numpy()
            first = np.concatenate([[b[0] != bucket if started else True], b[1:] != b[:-1]])
            starts = np.flatnonzero(first)
            hubs = np.empty(len(b), np.int64)
            run_of = np.cumsum(first) - 1
            hubs[run_of >= 0] = node[starts[run_of[run_of >= 0]]]
            if len(starts) == 0 or starts[0] > 0:
                hubs[run_of < 0] = hub
            if not started:
                yield out([int(b[0])], [int(node[0])], [None])
            started, bucket, hub = True, b[-1], hubs[-1]
            moved = hubs != node
            yield pa.RecordBatch.from_arrays([pa.nulls(int(moved.sum()), pa.int64()), pa.array(node[moved]), pa.array(hubs[moved])], names=["bucket", "u", "v"])
        if started:
            yield out([int(bucket)], [int(hub)], [None])

    found = materialise(buckets.repartitionByRange("bucket", "node").sortWithinPartitions("bucket", "node").mapInArrow(run, "bucket bigint, u bigint, v bigint"), "bucket-edges")
    ends = found.where("v is null").groupBy("bucket").agg(F.min("u").alias("v"))
    across = found.where("v is null").select("bucket", "u").join(ends, "bucket").select("u", "v").where("u != v")
    edges = found.where("v is not null").select("u", "v").union(across).withColumn("least", F.min("v").over(Window.partitionBy("u")))
    return edges.select(F.when(F.col("v") == F.col("least"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("least").alias("v")).distinct()


def _linked(rows: DataFrame, evidence: DataFrame, percent: int) -> DataFrame:
    """Compares each block's queries with its members: u, v of links that join components.

    ``rows``: block, member, query (booleans), node, component, digest; the evidence joins them last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("block", "member", "query", "node", "component", "sketch", "shingles")), strict=True))
        links = (link for _, own in itertools.groupby(rows, lambda r: r[0]) for link in _links(list(own), percent))
        while part := list(itertools.islice(links, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in part], pa.int64()), pa.array([v for _, v in part], pa.int64())], names=["u", "v"])

    # both sides grow with the data: never broadcast, whatever the size at hand
    whole = rows.join(evidence.hint("merge"), "digest").select("block", "member", "query", "node", "component", "sketch", "shingles")
    return whole.repartition("block").sortWithinPartitions("block", "node").mapInArrow(run, "u bigint, v bigint")


def _links(rows: list[tuple], percent: int) -> Iterator[tuple[int, int]]:
    """rows: (block, member, query, node, component, sketch, shingles) of one block."""
    queries, members = [r[3:] for r in rows if r[2]], [r[3:] for r in rows if r[1]]
    root = {r[4]: r[4] for r in rows}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    if not queries or not members:
        return
    sketches = np.frombuffer(b"".join(r[2] for r in members), np.uint16).reshape(len(members), -1)
    lengths = np.array([len(r[3]) // 8 for r in members])
    sets: list[frozenset | None] = [None] * len(members)
    # a link's agreement is binomial around percent / 100 at least: 5.5 standard deviations below
    p = percent / 100
    least = (p - 5.5 * (p * (1 - p) / sketches.shape[1]) ** 0.5) * sketches.shape[1]
    for q in queries:
        n = len(q[3]) // 8
        agree = (sketches == np.frombuffer(q[2], np.uint16)).sum(axis=1)
        near = np.flatnonzero((agree >= least) & (100 * np.minimum(lengths, n) >= percent * np.maximum(lengths, n)))
        own = None
        for i in near[np.argsort(-agree[near], kind="stable")].tolist():
            m = members[i]
            a, b = find(q[1]), find(m[1])
            if a == b:
                continue
            own = own if own is not None else frozenset(np.frombuffer(q[3], np.uint64).tolist())
            if sets[i] is None:
                sets[i] = frozenset(np.frombuffer(m[3], np.uint64).tolist())
            both = len(own & sets[i])
            if 100 * both >= percent * (n + len(sets[i]) - both):
                root[max(a, b)] = min(a, b)
                yield q[0], m[0]


def _numbers(upto: str):
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(upto) - 1))


def _parted(rows: DataFrame, name: str) -> DataFrame:
    """Adds how many blocks each cluster's rows fill (``name`` + s) and each row's block (``name``)."""
    sizes = rows.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias(f"{name}s"))
    return joined(rows, sizes, "cluster").withColumn(name, F.pmod(F.xxhash64("node"), F.col(f"{name}s")))


def _first_rows(members: DataFrame) -> DataFrame:
    """Each member in its block, and each cluster's first block in all of its other blocks."""
    block = F.xxhash64("cluster", "p").alias("block")
    own = members.select(F.xxhash64("cluster", "part").alias("block"), F.lit(True).alias("member"), (F.col("part") == 0).alias("query"), "node", F.col("node").alias("component"), "digest")
    away = members.where("part = 0 and parts > 1").select("*", _numbers("parts").alias("p")).where("p != part")
    return own.union(away.select(block, F.lit(False), F.lit(True), "node", "node", "digest"))


def _second_rows(members: DataFrame, strays: DataFrame) -> DataFrame:
    """Blocks of strays against blocks of all members of their clusters."""
    queries = _parted(strays.select("cluster", "node", "n_shingles", "component", "parts", "digest"), "stray")
    counts = queries.groupBy("cluster").agg(F.max("strays").alias("strays"))
    block = F.xxhash64("cluster", "p", "q").alias("block")
    left = joined(members, counts, "cluster").where("strays is not null").select("*", F.col("part").alias("p"), _numbers("strays").alias("q"))
    right = queries.select("*", F.col("stray").alias("q"), _numbers("parts").alias("p"))
    return left.select(block, F.lit(True).alias("member"), F.lit(False).alias("query"), "node", "component", "digest").union(right.select(block, F.lit(False), F.lit(True), "node", "component", "digest"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, keys: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text -> row, doc_id, the keys, n_shingles, component_id, group, kept (doc_id = component_id).

    ``group`` is null for rows that are linked with nothing, and else the number of the row's group;
    ``component_id`` is the group's smallest document id, and the row's own id where there is none.
    """
    spark = docs.sparkSession
    signatures = materialise(signed(docs, size, keys), "signatures")
    hashed = signatures.withColumn("row", F.monotonically_increasing_id())
    rows = materialise(hashed.drop("bands"), "rows")
    classes = materialise(
        rows.where("digest is not null").groupBy("digest").agg(F.min(F.struct("row", "doc_id", "place", "n_shingles")).alias("head"), F.count("*").alias("copies"), F.min("doc_id").alias("least"))
        .select("digest", F.col("head.row").alias("node"), F.col("head.doc_id").alias("doc_id"), F.col("head.place").alias("place"), F.col("head.n_shingles").alias("n_shingles"), "copies", "least"),
        "classes",
    )
    clusters = components(_candidates(_buckets(hashed, classes)), "candidates")
    clustered = materialise(clusters.withColumnRenamed("component", "cluster").join(classes.select("node", "digest", "doc_id", "place", "n_shingles"), "node"), "clustered")
    members = materialise(_parted(clustered, "part"), "members")
    delete(spark, signatures, clustered)
    evidence = materialise(_evidence(docs, members, size), "evidence")
    links = materialise(_linked(_first_rows(members), evidence, percent), "links")
    groups = components(links, "linked")
    # what the first blocks didn't settle: members outside their cluster's largest component
    now = materialise(members.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")).select("cluster", "node", "n_shingles", "part", "parts", "component", "digest"), "settled")
    sizes = now.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
    strays = materialise(joined(now.where("part != 0"), largest, "cluster").where("component != largest").drop("largest"), "strays")
    if not strays.isEmpty():
        groups = components(links.union(_linked(_second_rows(now, strays), evidence, percent)), "linked")
    named = materialise(classes.select("digest", "node", "copies", "least").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
    delete(spark, evidence, links, members, now, strays, classes)
    # a class whose group is itself alone, and holds one row, needs no join back
    least = named.groupBy("component").agg(F.min("least").alias("least_id"), F.sum("copies").alias("copies"))
    grouped = joined(named.select("digest", "component"), least.where("copies > 1"), "component").where("copies is not null").select("digest", F.col("component").alias("group"), "least_id")
    grouped = materialise(grouped, "groups")
    delete(spark, named)
    out = joined(rows, grouped, "digest")
    found = F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("least_id"))
    return out.select("row", "doc_id", *keys, "n_shingles", found.alias("component_id"), "group").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), size=2).select("doc_id", "n_shingles", "component_id", "kept")
