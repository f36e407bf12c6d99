"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation in numpy.

1. Words are counted over all training texts; equal words meet in one grouped sum.
2. The most frequent words get vectors of their own: ``SINGLES`` of them (the end included) are
   outcomes, the next ``CLASSES * MEMBERS`` are members of classes of like frequency. All other words
   share ``BUCKETS`` outcomes by their last two bytes, which holds unseen words too.
3. Every text becomes an array of these ids, written once by round of training.
4. The vectors of the ``CONTEXT`` tokens before a token, each through its place's matrix, sum to a
   vector that meets the outcomes' vectors and biases, and within the outcome's class its members'.
   Both are trained by noise-contrastive estimation with noise sampled from the unigrams: in each
   round, tasks step through their partitions of new training texts in minibatches, and what they
   have moved is averaged by how often each row was used. Every training token is stepped through
   once; no task holds more than a minibatch of them, and only the model reaches the driver.
5. Batched matrix products over all outcomes, and over all members of a token's class, give the
   log-probabilities, normalised exactly by their log-sums.
6. A word in a bucket has the bucket's probability times its share of it with one added to each
   count, so that the known words of a bucket and one unseen word sum to 1.

The ``HEAD`` most frequent words of at most ``WIDEST`` bytes travel to the tasks (at most 16 MB); all
other tokens meet their counts in a shuffled join. Results hold for any vocabulary size.

Defined cases: null text is empty (an end alone); a null id counts as the empty text for the split;
repeated ids are scored as rows of their own; without training texts every word is unseen; texts of
any length are taken whole; an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlake.llm.common import materialise, read, slices

#: The token that ends a text; no word holds a line feed.
END = b"\n"
HEAD, WIDEST = 131_072, 96
SINGLES, CLASSES, MEMBERS, BUCKETS = 64, 64, 256, 64
#: Ids: the end, the other singles, the members class by class, the buckets; outcomes: singles, classes, buckets.
MIDDLE, IDS, OUTCOMES = CLASSES * MEMBERS, SINGLES + CLASSES * MEMBERS + BUCKETS, SINGLES + CLASSES + BUCKETS
FOLDS, HELD_OUT = 7, 2
DIMENSIONS, CONTEXT = 32, 3
#: Noise samples for each token, of outcomes and of members; tokens of a minibatch; learning rate.
NOISE, MEMBER_NOISE, BATCH, RATE = 128, 64, 16384, 0.05
#: Words whose counts are sent on together.
COUNTED = 1 << 22
#: Rounds by the part of the training texts that each takes, in 16ths; tokens that a task steps through at least.
ROUNDS, TASK_TOKENS = (2, 2, 4, 8), 1_000_000
#: Deltas are summed as whole numbers of this, so that sums don't depend on their order.
GRAIN = 1 << 20


def fold(doc_id: int | None) -> int:
    return _crc(doc_id) % FOLDS


def _crc(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def round_of(doc_id: int | None) -> int:
    """The round that trains on a text; -1 if it is held out."""
    crc = _crc(doc_id)
    if crc % FOLDS == HELD_OUT:
        return -1
    part = crc // FOLDS % sum(ROUNDS)
    return next(i for i in range(len(ROUNDS)) if part < sum(ROUNDS[: i + 1]))


def bucket(word: bytes) -> int:
    return SINGLES + MIDDLE + zlib.crc32(word[-2:]) % BUCKETS


@functools.cache
def _endings() -> np.ndarray:
    """The buckets of words of one byte, then of all endings of two."""
    return np.array([bucket(bytes([b])) for b in range(256)] + [bucket(bytes([a, b])) for a in range(256) for b in range(256)])


def buckets(words: pa.Array) -> np.ndarray:
    """``bucket`` of each of an array of words (binary, none empty)."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset + 1 : words.offset + 1 + len(words)]
    data, short = np.frombuffer(words.buffers()[2], np.uint8), pc.binary_length(words).to_numpy() < 2
    last = data[ends - 1].astype(np.int64)
    return _endings()[np.where(short, last, 256 + 256 * data[ends - 2 + short].astype(np.int64) + last)]


def outcome(ids: np.ndarray) -> np.ndarray:
    return np.where(ids < SINGLES, ids, np.where(ids < SINGLES + MIDDLE, SINGLES + (ids - SINGLES) // MEMBERS, ids - MIDDLE + CLASSES))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, lower-cased, and how many each text has; by Arrow, as Python made an object of every word."""
    bare = pc.ascii_trim_whitespace(pc.ascii_lower(texts.fill_null("")))
    lists = pc.ascii_split_whitespace(bare)
    words, empty = lists.flatten(), pc.equal(pc.binary_length(bare), 0).to_numpy(zero_copy_only=False)
    if empty.any():  # they split into one empty word
        words = words.filter(pc.not_equal(pc.binary_length(words), 0))
    return words, lists.value_lengths().to_numpy().astype(np.int64) - empty


def count_words(docs: DataFrame) -> DataFrame:
    """doc_id, text -> word (binary), n: of the training texts, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        size = ends = 0

        def out() -> pa.RecordBatch:
            found = pa.chunked_array(held).value_counts()
            return pa.RecordBatch.from_arrays([found.field("values").cast(pa.binary()), found.field("counts")], names=["word", "n"])

        for batch in batches:
            training = pa.array([fold(i) != HELD_OUT for i in batch.column("doc_id").to_pylist()], pa.bool_())
            ends += training.true_count
            for part in slices(batch.filter(training), "text"):
                held.append(words_of(part.column("text"))[0])
                size += len(held[-1])
                if size >= COUNTED:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([ends])], names=["word", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The bounded head of the words, most frequent first, and what holds for all of them."""

    rank: dict[bytes, int]
    counts: np.ndarray
    ids: np.ndarray
    #: Tokens and distinct words of each id of the model.
    id_tokens: np.ndarray
    id_words: np.ndarray

    @property
    def tokens(self) -> int:
        return int(self.id_tokens.sum())

    @property
    def distinct(self) -> int:
        return int(self.id_words.sum())


def head_of(counts: DataFrame, most: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """The words whose count is over a threshold that at most ``most`` words pass, and all others."""
    short = F.octet_length("word") <= WIDEST
    by_n = counts.where(short).groupBy("n").agg(F.count("*").alias("words"))
    over = by_n.withColumn("total", F.sum("words").over(Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, 0)))
    least = over.where(F.col("total") <= most).agg(F.coalesce(F.min("n"), F.lit(1 << 62))).first()[0]
    inside = short & (F.col("n") >= least)
    return counts.where(inside), counts.where(~inside)


def vocabulary(counts: DataFrame, head: DataFrame) -> Vocabulary:
    head = head.toArrow()
    words, n = head.column("word").to_pylist(), head.column("n").to_pylist()
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    rank = {words[i]: r for r, i in enumerate(order)}
    ids, own = np.empty(len(order), np.int32), 1
    for w, r in rank.items():
        if w == END:
            ids[r] = 0
        elif own < SINGLES + MIDDLE:
            ids[r] = own
            own += 1
        else:
            ids[r] = bucket(w)
    held = counts.sparkSession.sparkContext.broadcast((rank, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, ids = held.value
        tokens, distinct = np.zeros(IDS, np.int64), np.zeros(IDS, np.int64)
        for b in batches:
            of = np.array([ids[rank[w]] if w in rank else 0 if w == END else bucket(w) for w in b.column("word").to_pylist()], np.int64)
            np.add.at(tokens, of, b.column("n").to_numpy())
            np.add.at(distinct, of, 1)
        some = np.flatnonzero(distinct)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(tokens[some]), pa.array(distinct[some])], names=["id", "tokens", "words"])

    sums = counts.mapInArrow(run, "id bigint, tokens bigint, words bigint").groupBy("id").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).toArrow()
    out = Vocabulary(rank, np.array([n[i] for i in order], np.int64), ids, np.zeros(IDS, np.int64), np.zeros(IDS, np.int64))
    out.id_tokens[sums.column("id").to_numpy()] = sums.column("tokens").to_numpy()
    out.id_words[sums.column("id").to_numpy()] = sums.column("words").to_numpy()
    return out


def encoded(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """doc_id, text -> doc_id, round, n_tokens, known, log_count, share (of words in their buckets), tail, ids."""
    within = np.log10(v.id_tokens + v.id_words + 1.0)
    within[: SINGLES + MIDDLE] = 0
    held = docs.sparkSession.sparkContext.broadcast((pa.array(list(v.rank), pa.binary()), v.ids, np.log10(v.counts + 1.0), within))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, inputs, logs, within = held.value
        inputs, logs = np.append(inputs, 0), np.append(logs, 0.0)
        for batch in batches:
            for part in slices(batch, "text"):
                words, sizes = words_of(part.column("text"))
                coded = words.dictionary_encode()
                distinct = pa.concat_arrays([coded.dictionary.cast(pa.binary()), pa.array([END], pa.binary())])
                own_ranks = pc.fill_null(pc.index_in(distinct, head), -1).to_numpy().astype(np.int64)
                own_ids = np.where(own_ranks < 0, buckets(distinct), inputs[own_ranks]).astype(np.int32)
                own_ids[-1] = 0
                # each text's words, then its end
                ends = np.cumsum(sizes + 1)
                starts = ends - sizes - 1
                which = np.full(ends[-1], len(distinct) - 1, np.int64)
                which[np.delete(np.arange(ends[-1]), ends - 1)] = coded.indices.to_numpy()
                ranks, ids = own_ranks[which], own_ids[which]
                log_count, known = logs[ranks], ranks >= 0
                rest = distinct.take(pa.array(which[~known]))
                share = np.where(ids >= SINGLES + MIDDLE, log_count - within[ids], 0.0)
                offsets = pa.array(np.append(0, ends).astype(np.int32))
                tails = np.concatenate([[0], np.cumsum(~known)])[np.append(0, ends)].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([round_of(i) for i in part.column("doc_id").to_pylist()], pa.int32()),
                        pa.array(sizes + 1),
                        pa.array(np.add.reduceat(known.astype(np.int64), starts)),
                        pa.array(np.add.reduceat(log_count, starts)),
                        pa.array(np.add.reduceat(share, starts)),
                        pa.ListArray.from_arrays(pa.array(tails), rest),
                        pa.ListArray.from_arrays(offsets, pa.array(ids)),
                    ],
                    names=["doc_id", "round", "n_tokens", "known", "log_count", "share", "tail", "ids"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, round int, n_tokens bigint, known bigint, log_count double, share double, tail array<binary>, ids array<int>")


def _contexts(ids: np.ndarray, starts: np.ndarray, size: int = CONTEXT) -> np.ndarray:
    """The tokens before each token, nearest first; before a text stand ends. Shape: places, tokens."""
    begins = np.zeros(len(ids), np.int64)
    begins[starts] = starts
    inside = np.arange(len(ids)) - np.maximum.accumulate(begins)
    out = np.zeros((size, len(ids)), np.int32)
    for i in range(size):
        out[i, i + 1 :] = ids[: len(ids) - i - 1]
        out[i, inside <= i] = 0
    return out


PARTS = ("q", "c", "r", "b", "w", "u")


@dataclass
class LogBilinear:
    """Context vectors q of ids, matrices c of places, vectors r and biases b of outcomes, w and u of members."""

    q: np.ndarray
    c: np.ndarray
    r: np.ndarray
    b: np.ndarray
    w: np.ndarray
    u: np.ndarray
    #: The noise: each outcome's share of all tokens, each member's of its class's.
    noise: np.ndarray
    member_noise: np.ndarray

    @classmethod
    def start(cls, id_tokens: np.ndarray, seed: int = 5) -> LogBilinear:
        rng = np.random.default_rng(seed)
        of = outcome(np.arange(IDS))
        noise = np.bincount(of, id_tokens + 0.5, OUTCOMES)
        noise /= noise.sum()
        members = id_tokens[SINGLES : SINGLES + MIDDLE].reshape(CLASSES, MEMBERS) + 0.5
        member_noise = (members / members.sum(axis=1, keepdims=True)).ravel()
        c = np.stack([np.eye(DIMENSIONS) / (i + 1) for i in range(CONTEXT)])
        parts = (rng.normal(0, 0.3, (IDS, DIMENSIONS)), c, np.zeros((OUTCOMES, DIMENSIONS)), np.log(noise), np.zeros((MIDDLE, DIMENSIONS)), np.log(member_noise))
        return cls(*(p.astype(np.float32) for p in parts), noise, member_noise)

    def hidden(self, contexts: np.ndarray) -> np.ndarray:
        return sum(self.q[x] @ m for x, m in zip(contexts, self.c, strict=True))

    def log_probabilities(self, hidden: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of all outcomes after each context, normalised."""
        s = hidden @ self.r.T + self.b
        return s - _log_sums(s)[:, None]

    def member_log_probabilities(self, hidden: np.ndarray, of: int) -> np.ndarray:
        """Natural log-probabilities of all members of a class, given the class, normalised."""
        own = slice(of * MEMBERS, (of + 1) * MEMBERS)
        s = hidden @ self.w[own].T + self.u[own]
        return s - _log_sums(s)[:, None]

    def token_log_probabilities(self, ids: np.ndarray, starts: np.ndarray, batch: int = 4 * BATCH) -> np.ndarray:
        """Natural log-probability of each token of texts that begin at ``starts`` (a bucket's for its words)."""
        contexts, targets, out = _contexts(ids, starts), outcome(ids), np.empty(len(ids))
        # a column of ones, which the nearest token brings, meets the biases
        tables = [np.hstack([self.q @ m, np.full((IDS, 1), i == 0, np.float32)]) for i, m in enumerate(self.c)]
        outcomes = np.hstack([self.r, self.b[:, None]]).T
        members = np.hstack([self.w, self.u[:, None]])
        # the same memory throughout
        most = min(batch, len(ids))
        hidden, more, room = *(np.empty((most, DIMENSIONS + 1), np.float32) for _ in range(2)), np.empty((512, max(OUTCOMES, MEMBERS)), np.float32).ravel()
        for at in range(0, len(ids), batch):
            own = slice(at, at + batch)
            h, x = hidden[: len(targets[own])], more[: len(targets[own])]
            np.take(tables[0], contexts[0, own], axis=0, out=h, mode="clip")
            for table, before in zip(tables[1:], contexts[1:, own], strict=True):
                h += np.take(table, before, axis=0, out=x, mode="clip")
            out[own] = _log_shares(h, outcomes, targets[own], room)
            rows, cuts = _by_class(ids[own])
            theirs, of = np.take(h, rows, axis=0, out=more[: len(rows)], mode="clip"), ids[own][rows] - SINGLES
            got = [_log_shares(theirs[a:b], members[c * MEMBERS : (c + 1) * MEMBERS].T, of[a:b] - c * MEMBERS, room) for c, a, b in cuts]
            if got:
                out[at + rows] += np.concatenate(got)
        return out


def _log_shares(h: np.ndarray, weights: np.ndarray, targets: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The log-probability of each row's target, a column of the weights, normalised over all columns."""
    width = weights.shape[1]
    true, sums, ones, firsts = np.empty(len(h), np.float32), np.empty(len(h), np.float32), np.ones(width, np.float32), np.arange(512) * width
    # parts that stay in the processor's cache
    for a in range(0, len(h), 512):
        part = h[a : a + 512]
        flat = room[: len(part) * width]
        s = np.matmul(part, weights, out=flat.reshape(len(part), width))
        true[a : a + 512] = flat[firsts[: len(part)] + targets[a : a + 512]]
        with np.errstate(over="ignore"):
            np.exp(s, out=s)
        np.matmul(s, ones, out=sums[a : a + 512])
    out = np.log(sums, dtype=np.float32, where=sums > 0, out=np.zeros_like(sums))
    odd = np.flatnonzero(~((sums > 1e-30) & (sums < np.inf)))
    for a in range(0, len(odd), 512):
        out[odd[a : a + 512]] = _log_sums(h[odd[a : a + 512]] @ weights)
    return true - out


def _log_sums(s: np.ndarray) -> np.ndarray:
    """The logarithm of the sum of each row's exponentials."""
    high = s.max(axis=1, keepdims=True)
    return np.log(np.exp(s - high).sum(axis=1)) + high[:, 0]


def _by_class(ids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The rows of members, by class, and each class that occurs with the bounds of its rows."""
    rows = np.flatnonzero((ids >= SINGLES) & (ids < SINGLES + MIDDLE))
    of = (ids[rows] - SINGLES) // MEMBERS
    order = np.argsort(of.astype(np.uint16), kind="stable")
    ends = np.cumsum(np.bincount(of, minlength=CLASSES)).tolist()
    return rows[order], [(c, a, b) for c, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if a < b]


#: Rows of a key that are summed one after the other; a key with more has several blocks of them.
RUN = 16


class Groups:
    """The rows of equal keys, found once for all sums by these keys.

    A key's rows are dealt into blocks of ``RUN``; the j-th rows of all blocks that have one are added
    at once. ``np.add.reduceat`` over rows starts anew for each key and column, which took longer than
    the products where most keys have few rows.
    """

    def __init__(self, keys: np.ndarray):
        # numpy sorts 16-bit keys by their digits
        order = np.argsort(keys.astype(np.uint16) if IDS <= 1 << 16 else keys, kind="stable")
        ordered = keys[order]
        firsts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        sizes = np.diff(np.append(firsts, len(keys)))
        self.keys, self.inverse = ordered[firsts], np.empty(len(keys), np.int64)
        self.inverse[order] = np.repeat(np.arange(len(firsts)), sizes)
        blocks = -(-sizes // RUN)
        heads = np.cumsum(blocks) - blocks
        inner = np.arange(blocks.sum()) - np.repeat(heads, blocks)
        begins, lengths = np.repeat(firsts, blocks) + inner * RUN, np.minimum(np.repeat(sizes, blocks) - inner * RUN, RUN)
        longest = np.argsort(-lengths, kind="stable")
        begins, lengths = begins[longest], lengths[longest]
        self.rows = [order[begins[: np.count_nonzero(lengths > j)] + j] for j in range(int(lengths[0]))]
        at = np.empty(len(longest), np.int64)
        at[longest] = np.arange(len(longest))
        #: Where each key's first block is, and the keys of several blocks with all of theirs.
        self.at, self.long = at[heads], np.flatnonzero(blocks > 1)
        self.parts = at[np.repeat(blocks > 1, blocks)]
        self.cuts = np.cumsum(blocks[self.long]) - blocks[self.long]

    def sums(self, table: np.ndarray, room: np.ndarray, out: np.ndarray) -> np.ndarray:
        """The sums of the table's rows by key; ``room`` has two rows for each row of the table."""
        total, more = room[: len(self.rows[0])], room[len(self.rows[0]) :]
        np.take(table, self.rows[0], axis=0, out=total, mode="clip")
        for rows in self.rows[1:]:
            total[: len(rows)] += np.take(table, rows, axis=0, out=more[: len(rows)], mode="clip")
        np.take(total, self.at, axis=0, out=out, mode="clip")
        if len(self.long):
            out[self.long] = np.add.reduceat(total[self.parts], self.cuts, axis=0)
        return out


class Stepper:
    """Steps a copy of a model through minibatches: row-wise Adagrad on the noise-contrastive objective."""

    def __init__(self, model: LogBilinear, seed: int, rate: float = RATE):
        self.m = LogBilinear(*(np.array(getattr(model, p)) for p in PARTS), model.noise, model.member_noise)
        self.rng, self.rate = np.random.default_rng(seed), rate
        self.seen = {p: np.zeros(len(getattr(model, p)), np.float32) for p in PARTS}
        self.uses = {p: np.zeros(len(getattr(model, p)), np.int64) for p in PARTS}
        self.log_noise = np.log(NOISE * model.noise).astype(np.float32)
        self.log_member_noise = np.log(MEMBER_NOISE * model.member_noise).astype(np.float32)
        self.ends, ends = np.cumsum(model.noise), np.cumsum(model.member_noise.reshape(CLASSES, MEMBERS), axis=1)
        #: Each class's cumulated shares, after those of the classes before it.
        self.flat_member_ends = (ends / ends[:, -1:] + np.arange(CLASSES)[:, None]).ravel()
        self.rooms: dict[str, np.ndarray] = {}

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """Memory that every minibatch uses again, as fetching new pages for each took a quarter of the time."""
        size = int(np.prod(shape))
        if name not in self.rooms or self.rooms[name].size < size:
            self.rooms[name] = np.empty(size + size // 4, np.float32)
        return self.rooms[name][:size].reshape(shape)

    def _taken(self, name: str, table: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.take(table, rows, axis=0, out=self._room(name, len(rows), table.shape[1]), mode="clip")

    def _drawn(self, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Which outcomes n draws from cumulated shares give, and how often."""
        return np.unique(np.minimum(np.searchsorted(ends, self.rng.random(n) * ends[-1], side="right"), len(ends) - 1), return_counts=True)

    def _move(self, part: str, rows: np.ndarray, grads: np.ndarray, uses: np.ndarray) -> None:
        """One ascent step of some distinct rows."""
        table = getattr(self.m, part)
        flat = grads.reshape(len(rows), -1)
        seen = self.seen[part][rows] + np.einsum("ij,ij->i", flat, flat) / flat.shape[1]
        self.seen[part][rows] = seen
        flat *= (self.rate / np.sqrt(seen + 1e-6))[:, None]
        table[rows] += grads
        self.uses[part][rows] += uses

    def _hits(self, h: np.ndarray, true: np.ndarray, levels: np.ndarray) -> np.ndarray:
        """How far each token's own logit is from certain."""
        return 1 / (1 + np.exp(np.einsum("ij,ij->i", h, true) + levels))

    def _misses(self, h: np.ndarray, others: np.ndarray, against: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Minus the probability that noise is true, times how often it was drawn; ``others`` and ``against`` negated."""
        miss = np.matmul(h, others.T, out=self._room("miss", len(h), len(others)))
        miss += against
        np.exp(miss, out=miss)
        miss += 1
        return np.divide(times, miss, out=miss)

    def _contrast(self, h: np.ndarray, ids: np.ndarray, groups: Groups, back: np.ndarray) -> None:
        """Trains the outcomes on tokens against drawn noise; ``back`` becomes the hidden vectors' gradient."""
        n, at = len(ids), outcome(ids)
        vectors, levels = self.m.r, self.m.b - self.log_noise
        noise, times = self._drawn(self.ends, NOISE)
        others, against, drawn = -vectors[noise], -levels[noise], -times.astype(np.float32)
        true = np.take(vectors, at, axis=0, out=back[:n], mode="clip")
        hit = self._hits(h[:n], true, levels[at])
        true *= hit[:, None]
        grads, moved, uses = np.zeros_like(vectors), np.bincount(at, hit, OUTCOMES).astype(np.float32), np.bincount(at, minlength=OUTCOMES)
        # ids are sorted by their outcomes, so the sums by id are summed once more
        sums, of = self._summed(h, hit, groups), outcome(groups.keys)
        firsts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        grads[of[firsts]] = np.add.reduceat(sums, firsts, axis=0)
        uses[noise] += 1
        # parts that stay in the processor's cache
        for a in range(0, n, 1024):
            own = slice(a, min(a + 1024, n))
            miss = self._misses(h[own], others, against, drawn)
            true[own] -= np.matmul(miss, others, out=self._room("product", len(miss), DIMENSIONS))
            grads[noise] += miss.T @ h[own]
            moved[noise] += np.ones(len(miss), np.float32) @ miss
        rows = np.flatnonzero(uses)
        self._move("r", rows, grads[rows], uses[rows])
        self._move("b", rows, moved[rows], uses[rows])

    def _summed(self, h: np.ndarray, by: np.ndarray, groups: Groups) -> np.ndarray:
        """The sums by id of hidden vectors times a number each; the row after the last token counts nothing."""
        product = self._room("product", len(by) + 1, DIMENSIONS)
        np.multiply(h[: len(by)], by[:, None], out=product[:-1])
        product[-1] = 0
        return groups.sums(product, self._room("sorted", 2 * len(product), DIMENSIONS), self._room("sums", len(groups.keys), DIMENSIONS))

    def _contrast_members(self, h: np.ndarray, ids: np.ndarray, groups: Groups, back: np.ndarray) -> None:
        """``_contrast`` for the members of all classes, each against its class's noise; adds to ``back``."""
        rows, cuts = _by_class(ids)
        if not cuts:
            return
        draws = np.searchsorted(self.flat_member_ends, self.rng.random((CLASSES, MEMBER_NOISE)) + np.arange(CLASSES)[:, None], side="right")
        noise, times = np.unique(np.minimum(draws, np.arange(1, CLASSES + 1)[:, None] * MEMBERS - 1), return_counts=True)
        at = ids[rows] - SINGLES
        levels = self.m.u - self.log_member_noise
        own, true = self._taken("own", h, rows), self._taken("true", self.m.w, at)
        hit = self._hits(own, true, levels[at])
        true *= hit[:, None]
        hits = np.zeros(len(ids), np.float32)
        hits[rows] = hit
        met = np.isin(noise // MEMBERS, [c for c, _, _ in cuts])
        noise, times = noise[met], times[met]
        others, against, drawn = -self.m.w[noise], -levels[noise], -times.astype(np.float32)
        grads, moved = self._room("members", MIDDLE, DIMENSIONS), np.bincount(at, hit, MIDDLE).astype(np.float32)
        used = np.bincount(at, minlength=MIDDLE)
        used[noise] += 1
        touched = np.flatnonzero(used)
        grads[touched] = 0
        found = np.searchsorted(groups.keys, [SINGLES, SINGLES + MIDDLE])
        grads[groups.keys[found[0] : found[1]] - SINGLES] = self._summed(h, hits, groups)[found[0] : found[1]]
        theirs = np.searchsorted(noise, np.arange(CLASSES + 1) * MEMBERS)
        for c, a, b in cuts:
            n = slice(theirs[c], theirs[c + 1])
            miss = self._misses(own[a:b], others[n], against[n], drawn[n])
            true[a:b] -= np.matmul(miss, others[n], out=self._room("product", len(miss), DIMENSIONS))
            grads[noise[n]] += miss.T @ own[a:b]
            moved[noise[n]] += np.ones(len(miss), np.float32) @ miss
        back[rows] += true
        self._move("w", touched, self._taken("own", grads, touched), used[touched])
        self._move("u", touched, moved[touched], used[touched])

    def step(self, ids: np.ndarray, starts: np.ndarray) -> None:
        with np.errstate(over="ignore"):  # a logit far below 0 gives 1 / inf
            self._step(ids, starts)

    def _step(self, ids: np.ndarray, starts: np.ndarray) -> None:
        m, n = self.m, len(ids)
        # each distinct token once; one more end, whose key comes first, stands where fewer than i + 1 tokens stand before a token in its text
        keys = np.append(ids, 0)
        groups = Groups(keys)
        begins = np.zeros(n, np.int64)
        begins[starts] = starts
        inside = np.arange(n) - np.maximum.accumulate(begins)
        bare = [np.flatnonzero(inside <= i) for i in range(CONTEXT)]
        own = self._taken("vectors", m.q, groups.keys)
        h, table = self._room("hidden", n + 1, DIMENSIONS), self._room("placed", *own.shape)
        h.fill(0)
        for i, c in enumerate(m.c):
            before = np.zeros(n, np.int64)
            before[i + 1 :] = groups.inverse[: max(0, n - i - 1)]
            before[bare[i]] = 0
            h[:n] += np.take(np.matmul(own, c, out=table), before, axis=0, out=self._room("product", n, DIMENSIONS), mode="clip")
        back = self._room("back", n + 1 + CONTEXT, DIMENSIONS)
        back[n:] = 0
        self._contrast(h, ids, groups, back)
        self._contrast_members(h, ids, groups, back)
        # a token's vector gathers what it did as a context of the tokens after it
        grads, times, matrices = self._room("gathered", *own.shape), np.zeros(n + 1, np.int64), np.empty_like(m.c)
        grads.fill(0)
        ends = [back[b].sum(axis=0) for b in bare]
        for i, c in enumerate(m.c):
            back[bare[i]] = 0
            did = groups.sums(back[i + 1 : i + n + 2], self._room("sorted", 2 * n + 2, DIMENSIONS), self._room("sums", *own.shape))
            did[0] += ends[i]
            matrices[i] = own.T @ did
            grads += np.matmul(did, c.T, out=table)
            times[: max(0, n - i - 1)] += inside[i + 1 :] > i
            times[n] += len(bare[i])
        self._move("q", groups.keys, grads, np.bincount(groups.inverse, times, len(groups.keys)).astype(np.int64))
        self._move("c", np.arange(CONTEXT), matrices, np.full(CONTEXT, n))

    def moved(self, model: LogBilinear) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
        """Part, first row, uses and deltas (in grains) of blocks of rows that have moved."""
        for p in PARTS:
            deltas = np.rint((getattr(self.m, p) - getattr(model, p)).astype(np.float64) * GRAIN).astype(np.int32).reshape(len(self.uses[p]), -1)
            for at in range(0, len(deltas), 1024):
                own = slice(at, at + 1024)
                if self.uses[p][own].any():
                    yield p, at, self.uses[p][own], deltas[own]


def _minibatches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and starts of runs of texts; a text longer than a minibatch goes on in the next ones."""
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        col = batch.column("ids")
        flat, at = col.values.to_numpy(), col.offsets.to_numpy()
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            for x in range(a, b, BATCH):
                held.append(flat[x : min(b, x + BATCH)])
                size += len(held[-1])
                if size >= BATCH:
                    yield np.concatenate(held), np.cumsum([0, *map(len, held[:-1])])
                    held, size = [], 0
    if held:
        yield np.concatenate(held), np.cumsum([0, *map(len, held[:-1])])


def trained(rows: DataFrame, model: LogBilinear, seed: int) -> LogBilinear:
    """One round: ids -> the model moved by the average of the tasks' steps."""
    context = rows.sparkSession.sparkContext
    held = context.broadcast(model)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        stepper = Stepper(held.value, seed * 1_000_003 + TaskContext.get().partitionId())
        for ids, starts in _minibatches(batches):
            stepper.step(ids, starts)
        for part, at, uses, deltas in stepper.moved(held.value):
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([at]), pa.array([uses.tobytes()], pa.binary()), pa.array([deltas.tobytes()], pa.binary())], names=["part", "at", "uses", "deltas"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list[np.ndarray]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                uses = np.frombuffer(r["uses"], np.int64)
                moved = np.frombuffer(r["deltas"], np.int32).reshape(len(uses), -1) * uses[:, None]
                own = found.setdefault((r["part"], r["at"]), [np.zeros_like(uses), np.zeros_like(moved)])
                own[0] += uses
                own[1] += moved
        for (part, at), (uses, moved) in found.items():
            mean = (moved / np.maximum(uses, 1)[:, None] / GRAIN).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([at]), pa.array([mean.tobytes()], pa.binary())], names=["part", "at", "mean"])

    moved = rows.select("ids").mapInArrow(steps, "part string, at bigint, uses binary, deltas binary")
    means = materialise(moved.repartition("part", "at").mapInArrow(sums, "part string, at bigint, mean binary"), "lm-steps").toArrow().to_pylist()
    out = LogBilinear(*(np.array(getattr(model, p)) for p in PARTS), model.noise, model.member_noise)
    for r in means:
        table = getattr(out, r["part"])
        own = table[r["at"] : r["at"] + 1024]
        own += np.frombuffer(r["mean"], np.float32).reshape(own.shape)
    held.unpersist()
    return out


def train(rows: DataFrame, v: Vocabulary) -> LogBilinear:
    """All rounds, each over its own training texts, in tasks of at least ``TASK_TOKENS`` tokens."""
    model = LogBilinear.start(v.id_tokens)
    for n, part in enumerate(ROUNDS):
        tasks = max(1, v.tokens * part // sum(ROUNDS) // TASK_TOKENS)
        model = trained(rows.where(F.col("round") == n).coalesce(tasks), model, n)
    return model


def score(rows: DataFrame, rest: DataFrame, v: Vocabulary, model: LogBilinear) -> DataFrame:
    """doc_id, text -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``rest``: the words beyond the head.
    """
    base = float(np.log10(v.tokens + v.distinct + 1.0))
    held = rows.sparkSession.sparkContext.broadcast(model)
    kept = ("row", "doc_id", "round", "n_tokens", "known", "log_count", "share")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                col = part.column("ids")
                cuts = col.offsets.to_numpy().astype(np.int64)
                ids, starts = col.values.to_numpy()[cuts[0] : cuts[-1]], cuts[:-1] - cuts[0]
                sums = np.add.reduceat(model.token_log_probabilities(ids, starts), starts) / np.log(10)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(sums)], names=[*kept, "model_log"])

    scored = rows.select(*kept, "ids").mapInArrow(run, "row bigint, doc_id bigint, round int, n_tokens bigint, known bigint, log_count double, share double, model_log double")
    tails = rows.select("row", F.explode("tail").alias("word")).join(rest, "word")
    tails = tails.groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("tail_log"))
    out = scored.join(tails, "row", "left")
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    return out.select(
        "doc_id",
        (F.col("round") < 0).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("bigint").alias("train_tokens"),
        (F.col("log_count") + tail_log - F.col("n_tokens") * base).alias("base_score"),
        (F.col("model_log") + F.col("share") + tail_log).alias("score"),
    )


def lm_scores(docs: DataFrame) -> DataFrame:
    """Counts, trains and scores: doc_id, text -> the columns of ``score``."""
    counts = materialise(count_words(docs), "word-counts")
    head, rest = head_of(counts)
    v = vocabulary(counts, head)
    rows = materialise(encoded(docs, v).withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    return score(rows, rest, v, train(rows, v))


def op5_neural_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read(spark, sf_dir, "documents"))
