"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

``bpe_encode`` packs a text's token ids as little-endian unsigned 32-bit integers; ``bpe_decode``
turns such ids back into text. Both run inside Arrow batches: a row never leaves its task, so
nothing is shuffled and a lost executor only repeats its own batches.

Defined cases: null text is the empty text (no ids, decoded to ''); a piece of any length is merged
in O(n log n); ids outside the vocabulary decode to nothing; bytes that aren't UTF-8 decode to
U+FFFD; other columns pass through, and an output column replaces one of the same name.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm.common import Held, read, slices

#: Fixed by the byte-level format: how a text is cut before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Below this code point texts are cut by ``re``, with the classes spelt out, which takes half the time.
LOW = 0x250


def low_cut(pattern: str):
    """``findall`` of a pattern of white space, letters and numbers, for texts of code points below ``LOW``."""

    def ranges(kind: str) -> str:
        out: list[list[int]] = []
        for c in range(LOW):
            if regex.match(kind, chr(c)):
                if out and out[-1][1] == c - 1:
                    out[-1][1] = c
                else:
                    out.append([c, c])
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in out)

    kinds = {kind: ranges(kind) for kind in (r"\s", r"\p{L}", r"\p{N}")}
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{''.join(kinds.values())}]").replace(r"\S", f"[^{kinds[chr(92) + 's']}]")
    for kind, own in kinds.items():
        pattern = pattern.replace(f"[{kind}]", kind).replace(kind, f"[{own}]")
    return re.compile(pattern).findall


#: Searches for a code point of ``LOW`` or above.
beyond_low = re.compile(f"[^\0-{chr(LOW - 1)}]").search


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PairTree:
    """A segment tree whose leaf i holds the rank of the pair that starts at symbol i.

    A node is the smaller of its two children; keys are ``rank * 2**32 + position``, so that the
    root is the leftmost of the lowest-ranked pairs. A merge changes three leaves at most, each in
    O(log n).
    """

    NONE = 1 << 62

    def __init__(self, ranks: dict[int, tuple[int, int]]):
        self.ranks = ranks

    def merged(self, ids: list[int]) -> list[int]:
        n, none, ranks = len(ids), self.NONE, self.ranks
        if n < 2:
            return ids
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        tree, made = [none] * (2 * size), {}
        found = False
        for i in range(n - 1):
            if (hit := ranks.get(ids[i] << 20 | ids[i + 1])) is not None:
                tree[size + i] = hit[0] << 32 | i
                found = True
        if not found:
            return ids
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ids = list(ids)
        while (top := tree[1]) != none:
            i = top & 0xFFFFFFFF
            j = after[i]
            ids[i] = ranks[ids[i] << 20 | ids[j]][1]
            ids[j] = -1
            k = after[i] = after[j]
            changed = [(j, none)] if j < n - 1 else []
            if k < n:
                before[k] = i
                hit = ranks.get(ids[i] << 20 | ids[k])
                changed.append((i, none if hit is None else hit[0] << 32 | i))
            else:
                changed.append((i, none))
            if (h := before[i]) >= 0:
                hit = ranks.get(ids[h] << 20 | ids[i])
                changed.append((h, none if hit is None else hit[0] << 32 | h))
            for at, key in changed:
                at += size
                if tree[at] == key:
                    continue
                tree[at] = key
                while at > 1:
                    at >>= 1
                    a, b = tree[2 * at], tree[2 * at + 1]
                    low = a if a < b else b
                    if tree[at] == low:
                        break
                    tree[at] = low
        return [x for x in ids if x >= 0]


class PairForest:
    """``PairTree`` for many short sequences at once: one tree a column, stepped together.

    Sequences of a like number of pairs share an array whose rows are the nodes of a segment tree.
    Every step reads all roots, merges each sequence's leftmost lowest-ranked pair, sets the three
    leaves and recomputes their ancestors level by level; columns whose root is empty are done.
    """

    #: Symbols of the longest sequence that is stepped here, bits of a position, and sequences an array.
    LONGEST, BITS, WIDTH = 128, 7, 8192
    NONE = np.int32(2**31 - 1)

    def __init__(self, ranks: dict[int, tuple[int, int]]):
        if len(ranks) >= 1 << (31 - self.BITS):
            raise ValueError("too many merges for 32-bit keys")
        self.single = PairTree(ranks)
        pairs = np.fromiter(ranks, np.int64, len(ranks))
        values = np.array(list(ranks.values()), np.int32).reshape(-1, 2)
        self.made = np.zeros(len(ranks) + 1, np.int32)
        self.made[values[:, 0]] = values[:, 1]
        # an open-addressed table of the pairs, at most one part in eight full
        self.bits = max(4, (8 * len(ranks)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.NONE, np.int32)
        slots, left, self.probes = self._slots(pairs), np.arange(len(pairs)), 0
        while len(left):
            free = self.keys[slots[left]] < 0
            at, first = np.unique(slots[left[free]], return_index=True)
            put = left[free][first]
            self.keys[at], self.ranks[at] = pairs[put], values[put, 0]
            left = np.setdiff1d(left, put, assume_unique=True)
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slots(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def leaf(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The keys ``rank << BITS | position`` of pairs, ``NONE`` for those that don't merge."""
        pairs = a.astype(np.int64) << 20 | b
        slots = self._slots(pairs)
        found = self.keys[slots]
        out = np.where(found == pairs, self.ranks[slots] << self.BITS | at, self.NONE).astype(np.int32)
        todo = np.flatnonzero((found != pairs) & (found >= 0))
        while len(todo):
            slots[todo] = (slots[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slots[todo]]
            hit = found == pairs[todo]
            out[todo[hit]] = self.ranks[slots[todo[hit]]] << self.BITS | at[todo[hit]]
            todo = todo[~hit & (found >= 0)]
        return out

    def merged(self, sequences: list[bytes], byte_ids: np.ndarray) -> list[bytes]:
        """The packed ids of each sequence of bytes."""
        out: list[bytes] = [b""] * len(sequences)
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        low = 0
        for high in (1, 2, 3, 5, 9, 17, 33, 65, self.LONGEST):
            those = np.flatnonzero((lengths > low) & (lengths <= high))
            for at in range(0, len(those), self.WIDTH):
                own = those[at : at + self.WIDTH].tolist()
                for i, x in zip(own, self._stepped([sequences[i] for i in own], lengths[own], high, byte_ids), strict=True):
                    out[i] = x
            low = high
        for i in np.flatnonzero(lengths > self.LONGEST).tolist():
            out[i] = array("I", self.single.merged(byte_ids[np.frombuffer(sequences[i], np.uint8)].tolist())).tobytes()
        return out

    def _stepped(self, sequences: list[bytes], lengths: np.ndarray, high: int, byte_ids: np.ndarray) -> list[bytes]:
        n, none = len(sequences), self.NONE
        # symbols by position and sequence; the row after the last position stands for the end
        raw = np.frombuffer(b"".join([x.ljust(high, b"\0") for x in sequences]), np.uint8).reshape(n, high)
        ids = np.zeros((high + 1, n), np.int32)
        ids[:high] = byte_ids[raw.T]
        inside = np.arange(high)[:, None] < lengths
        if high > 1:
            pairs = high - 1
            size = 1 << (pairs - 1).bit_length()
            tree = np.full((2 * size, n), none, np.int32)
            where = np.repeat(np.arange(pairs, dtype=np.int32), n)
            tree[size : size + pairs] = np.where(inside[1:], self.leaf(ids[:pairs].ravel(), ids[1 : pairs + 1].ravel(), where).reshape(pairs, n), none)
            for i in range(size - 1, 0, -1):
                np.minimum(tree[2 * i], tree[2 * i + 1], out=tree[i])
            # places in the flat arrays are position * n + sequence; a place's neighbours that are left
            after = np.arange(n, (high + 2) * n, dtype=np.int64)
            before = np.arange(-n, (high + 1) * n, dtype=np.int64)
            flat, nodes_of, ends = ids.reshape(-1), tree.reshape(-1), lengths * n
            live = np.flatnonzero(tree[1] != none)
            while len(live):
                top = nodes_of.take(live + n)
                made = self.made.take(top >> self.BITS)
                i = (top & ((1 << self.BITS) - 1)) * n + live
                j = after.take(i)
                k = after.take(j)
                h = before.take(i)
                flat[i], flat[j], after[i], before[k] = made, -1, k, i
                right, left, second = k - live < ends.take(live), np.flatnonzero(h >= 0), j[j < pairs * n]
                hl = h.take(left)
                keys = self.leaf(np.concatenate([made, flat.take(hl)]), np.concatenate([flat.take(np.minimum(k, high * n + live)), made.take(left)]), np.concatenate([i, hl]) // n)
                keys[: len(live)][~right] = none
                # the leaf of the merged-away symbol, of the new one's pair and of the pair before it
                nodes = np.concatenate([second, i, hl]) + size * n
                values = np.concatenate([np.full(len(second), none), keys])
                nodes_of[nodes] = values
                cols = nodes % n
                level = nodes // n
                for _ in range(size.bit_length() - 1):
                    children = level // 2 * 2 * n + cols
                    level >>= 1
                    nodes_of[level * n + cols] = np.minimum(nodes_of.take(children), nodes_of.take(children + n))
                live = live[nodes_of.take(live + n) != none]
        kept = (inside & (ids[:high] >= 0)).T
        out = ids[:high].T[kept].astype("<u4").tobytes()
        ends = (4 * np.cumsum(kept.sum(axis=1))).tolist()
        return [out[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class ByteBPE:
    def __init__(self, spec: dict):
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.byte_ids = np.array([vocab[c] for c in letters], np.int32)
        self.forest = PairForest({vocab[a] << 20 | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])})
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        of_letter = {c: b for b, c in enumerate(letters)}
        # one entry more, empty, stands for all ids outside the vocabulary
        token_bytes = [b""] * (2 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            token_bytes[i] = bytes(of_letter[c] for c in token) if all(c in of_letter for c in token) else token.encode()
        for token, i in self.special.items():
            token_bytes[i] = token.encode()
        self.token_bytes = pa.array(token_bytes, pa.binary())
        self.token_lengths = np.fromiter(map(len, token_bytes), np.int64, len(token_bytes))
        self.any_cut, self.low_cut = regex.compile(PIECES).findall, low_cut(PIECES)
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = Held()

    def _of_pieces(self, pieces: list[str]) -> list[bytes]:
        return self.forest.merged([x.encode() for x in pieces], self.byte_ids)

    def cut(self, text: str) -> list[str]:
        return (self.any_cut if beyond_low(text) else self.low_cut)(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text; the distinct pieces of all texts are merged together."""
        cuts: list[list[list[str] | bytes]] = []
        distinct: set[str] = set()
        for text in texts:
            if self.specials and any(s in text for s in self.special):
                own = [np.array([self.special[x]], "<u4").tobytes() if x in self.special else self.cut(x) for x in self.specials.split(text)]
            else:
                own = [self.cut(text)]
            for x in own:
                if isinstance(x, list):
                    distinct.update(x)
            cuts.append(own)
        get = self.pieces.fill(distinct, self._of_pieces).__getitem__
        return [b"".join([x if isinstance(x, bytes) else b"".join(map(get, x)) for x in own]) for own in cuts]

    def decode(self, packed: list[bytes]) -> pa.Array:
        """The texts of packed ids."""
        ids = np.minimum(np.frombuffer(b"".join(packed), "<u4").astype(np.int64), len(self.token_bytes) - 1)
        ends = np.concatenate([[0], np.cumsum(self.token_lengths[ids])])
        offsets = ends[np.cumsum([0, *(len(x) // 4 for x in packed)])].astype(np.int32)
        data = self.token_bytes.take(pa.array(ids)).buffers()[2] or pa.py_buffer(b"")
        whole = pa.Array.from_buffers(pa.binary(), len(packed), [None, pa.py_buffer(offsets), data])
        try:
            return whole.cast(pa.string())
        except pa.ArrowInvalid:  # bytes that aren't UTF-8
            return pa.array([x.decode("utf-8", "replace") for x in whole.to_pylist()], pa.string())


_LOADED: dict[str, ByteBPE] = {}


def load(path: str) -> ByteBPE:
    """The tokenizer of a vocabulary file, once for each worker."""
    if path not in _LOADED:
        with open(path, encoding="utf-8") as f:
            _LOADED[path] = ByteBPE(json.load(f))
    return _LOADED[path]


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [i for i, n in enumerate(batch.schema.names) if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), values], names=[*(batch.schema.names[i] for i in kept), name])


def _added(df: DataFrame, name: str, kind: str):
    return df.drop(name).select("*", F.lit(None).cast(kind).alias(name)).schema


def bpe_encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ``ids`` (binary): the text's token ids as little-endian unsigned 32-bit integers.

    Strings of special tokens inside a text become those tokens, as in the tokenizer's library.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            for part in slices(batch, text):
                yield _with(part, ids, pa.array(bpe.encode([t or "" for t in part.column(text).to_pylist()]), pa.binary()))

    return df.mapInArrow(run, _added(df, ids, "binary"))


def bpe_decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds ``text`` (string): what the packed ids stand for, special tokens included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            for part in slices(batch, ids):
                yield _with(part, text, bpe.decode([x or b"" for x in part.column(ids).to_pylist()]))

    return df.mapInArrow(run, _added(df, text, "string"))


def bpe_round_trip(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``bpe_encode`` and ``bpe_decode`` of what it made, by one worker a task; the text itself is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            for part in slices(batch, text):
                packed = bpe.encode([t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()])
                kept = [i for i, n in enumerate(part.schema.names) if n not in (text, ids, decoded)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), pa.array(packed, pa.binary()), bpe.decode(packed)], names=[*(part.schema.names[i] for i in kept), ids, decoded])

    return df.mapInArrow(run, df.drop(text, ids, decoded).select("*", F.lit(None).cast("binary").alias(ids), F.lit(None).cast("string").alias(decoded)).schema)


def public_vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encodes and decodes every document and returns the digests of both."""
    out = bpe_round_trip(docs.select("doc_id", "text"), vocabulary)
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(read(spark, sf_dir, "documents"), public_vocabulary("byte_bpe_50k.json"))
