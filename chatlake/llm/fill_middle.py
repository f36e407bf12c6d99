"""Fill-in-the-middle: texts cut at word units by a Fenwick tree, rearranged around marks, and restored.

A text's units are ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``: a word with the white space before it,
or the white space at the end. The text is read as fixed blocks of UTF-8 bytes; a Fenwick tree over the
blocks holds how many units and how many code points end in each. A cut after unit k descends the
tree by halving steps to the block in which unit k ends, and then looks through that block alone; code
points before the cut come from the same descent. Rows stay in their tasks: nothing is shuffled.

Where the cuts lie, and whether and how a text is rearranged, depends on the seed and ``doc_id`` only.

Defined cases: a null text is the empty text; a null id counts as an empty one; an empty text, or one
that holds a mark, stays plain; a text with one unit may have empty parts; repeated rows get equal
results; texts of any length are cut whole; an empty table gives an empty result; other columns pass
through, and an output column replaces one of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm.common import SPACES, column, read, slices, texts

#: Bytes of a block.
BLOCK = 1024
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES.encode())] = True


class Settings(NamedTuple):
    """Texts in a hundred that are rearranged, and of those the ones that begin with their suffix."""

    seed: int = 42
    rearranged: int = 50
    suffix_first: int = 80
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def check(self) -> None:
        """Marks must differ and begin with a character that they hold nowhere else, so that none overlaps another."""
        marks = (self.prefix, self.suffix, self.middle)
        if len(set(marks)) < 3 or any(not m or m[0] in "".join(x[1:] for x in marks) for m in marks):
            raise ValueError("marks must differ and begin with a character that occurs nowhere else in them")


class Fenwick:
    """Prefix sums of rows of counts (here units and code points), with descent to a sum of the first."""

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        sums = np.zeros((n + 1, counts.shape[1]), np.int64)
        np.cumsum(counts, axis=0, out=sums[1:])
        at = np.arange(n + 1)
        self.tree = sums - sums[at - (at & -at)]
        self.total = sums[n]

    def add(self, i: int, counts) -> None:
        """Adds counts to row i."""
        self.total = self.total + counts
        i += 1
        while i < len(self.tree):
            self.tree[i] += counts
            i += i & -i

    def descend(self, k: int) -> tuple[int, np.ndarray]:
        """The last row count i before which fewer than k of the first count lie, and the sums before it."""
        at, before = 0, np.zeros(self.tree.shape[1], np.int64)
        step = 1 << (len(self.tree) - 1).bit_length()
        while step:
            if at + step < len(self.tree) and before[0] + self.tree[at + step, 0] < k:
                at += step
                before = before + self.tree[at]
            step >>= 1
        return at, before


class Units:
    """A text's units and code points, block by block."""

    def __init__(self, text: bytes, block: int = BLOCK):
        self.text, self.block = text, block
        data = np.frombuffer(text, np.uint8)
        space = _SPACE[data]
        #: Whether a unit ends with each byte, and whether a code point begins with it.
        self.ends = np.empty(len(data), bool)
        if len(data):
            np.greater(space[1:], space[:-1], out=self.ends[:-1])
            self.ends[-1] = True
        self.begins = (data & 0xC0) != 0x80
        starts = np.arange(0, len(data), block)
        counts = np.stack([np.add.reduceat(x, starts, dtype=np.int64) if len(data) else np.empty(0, np.int64) for x in (self.ends, self.begins)], axis=1)
        self.tree = Fenwick(counts)
        self.n = int(self.tree.total[0])

    def cut(self, k: int) -> tuple[int, int]:
        """Bytes and code points before the place where unit k ends; none for 0."""
        if k <= 0:
            return 0, 0
        block, (units, points) = self.tree.descend(k)
        start = block * self.block
        end = start + int(np.flatnonzero(self.ends[start : start + self.block])[k - units - 1]) + 1
        return end, int(points) + int(np.count_nonzero(self.begins[start:end]))


def draws(seed: int, doc_id) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def rearrange(text: bytes, doc_id, settings: Settings = Settings()) -> tuple[int, str, bytes, int | None, int | None]:
    """n, form, output, and the code points of prefix and middle (None where the text stays plain)."""
    units = Units(text)
    p, s, m = (x.encode() for x in (settings.prefix, settings.suffix, settings.middle))
    h1, h2, h3, h4 = draws(settings.seed, doc_id)
    if not text or p in text or s in text or m in text or h3 % 100 >= settings.rearranged:
        return units.n, "plain", text, None, None
    first, second = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
    (a, before), (b, upto) = units.cut(first), units.cut(second)
    if h4 % 100 < settings.suffix_first:
        return units.n, "spm", b"".join((s, text[b:], p, text[:a], m, text[a:b])), before, upto - before
    return units.n, "psm", b"".join((p, text[:a], s, text[b:], m, text[a:b])), before, upto - before


def restored(output: bytes, form: str, settings: Settings = Settings()) -> bytes:
    """The text that an output of ``rearrange`` was made of."""
    p, s, m = (x.encode() for x in (settings.prefix, settings.suffix, settings.middle))
    if form == "plain":
        return output
    head, middle = output.split(m)
    first, second = (p, s) if form == "psm" else (s, p)
    if not head.startswith(first):
        raise ValueError(f"no {form} form")
    a, b = head[len(first) :].split(second)
    return a + middle + b if form == "psm" else b + middle + a


def _adding(df: DataFrame, text: str, other: str, make: Callable[[list, Iterator[bytes]], list[pa.Array]], added: str) -> DataFrame:
    """All columns but those of the added names, and the added ones, which ``make`` takes from the two given columns."""
    new = dict(x.split() for x in added.split(", "))
    kept = [c for c in df.columns if c not in new]
    mine = f"_{max(map(len, df.columns)) * '_'}"  # a name that no column has

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, f"{mine}1"):
                made = make(column(part, f"{mine}2"), texts(part, f"{mine}1"))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), *made], names=[*kept, *new])

    schema = df.select(*kept, *(F.lit(None).cast(kind).alias(c) for c, kind in new.items())).schema
    return df.select(*kept, F.col(text).alias(f"{mine}1"), F.col(other).cast("string").alias(f"{mine}2")).mapInArrow(run, schema)


def fill_middle(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, text, ... -> all columns, and n, form, output, prefix_chars, middle_chars."""

    settings.check()

    def make(ids: list, own: Iterator[bytes]) -> list[pa.Array]:
        rows = [rearrange(t, i, settings) for i, t in zip(ids, own, strict=True)]
        n, form, output, prefix, middle = zip(*rows, strict=True) if rows else [()] * 5
        return [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(output, pa.binary()).cast(pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64())]

    return _adding(docs, "text", "doc_id", make, "n bigint, form string, output string, prefix_chars bigint, middle_chars bigint")


def restore(outputs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """output, form, ... -> all columns and restored, the text before it was rearranged; null outputs are empty."""

    settings.check()

    def make(forms: list, own: Iterator[bytes]) -> list[pa.Array]:
        rows = [restored(t, f or "plain", settings) for f, t in zip(forms, own, strict=True)]
        return [pa.array(rows, pa.binary()).cast(pa.string())]

    return _adding(outputs, "output", "form", make, "restored string")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs and restored texts, as digests."""
    made = restore(fill_middle(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP11_SQL = r"""
with u as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units, sha256('42:' || coalesce(doc_id::varchar, '')) as h from documents),
k as (select *, len(units) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from u),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from k),
p as (select *, case when a = 0 then '' else array_to_string(units[1:a], '') end as prefix, case when b = a then '' else array_to_string(units[a + 1:b], '') end as middle, case when b = n then '' else array_to_string(units[b + 1:], '') end as suffix from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(prefix)::bigint end as prefix_chars, case when form <> 'plain' then length(middle)::bigint end as middle_chars,
sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
sha256(text) as restored_sha256 from p
"""
