"""Token counts of whole texts, huge ones by overlapping chunks that are spliced where they agree.

A BPE merge joins two neighbours into a piece of the vocabulary. So where no piece holds two adjacent
characters side by side, no merge ever crosses the place between them: it is a *proven* boundary, and
each side is encoded alike whatever stands on the other. A text longer than a chunk is encoded chunk
by chunk, each with its tokens' offsets and each beginning before the last one's end. The two are spliced
at the last proven boundary inside the overlap at which both have a token's edge (strictly inside
the later chunk, whose first characters carry the encoder's prefix). Where an overlap has none, it is
doubled, over the whole earlier chunk if need be, and then that chunk is doubled too: in the end the
whole text is one chunk, so no text is counted wrongly, and the work stays within a logarithm of
the text's length. Rows stay in their tasks; memory is bounded by the longest text.

Defined cases: a null text is the empty text, of no tokens; repeated rows get equal counts; texts of
any length are counted whole; an empty table gives an empty result; other columns pass through, and
an output column replaces one of the same name. Models whose normalizer changes characters, or
that aren't BPE, have no proven boundaries here: their texts go to the library whole.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm.bpe import public_vocabulary
from chatlake.llm.common import read, slices, texts

#: Code points of a chunk and, at first, of an overlap.
CHUNK, OVERLAP = 16_384, 256
#: Fixed by the format: the letter that stands for a space.
SPACE = "▁"


class ChunkedEncoder:
    """A sentencepiece model's ids of texts of any length."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.chunk, self.overlap = chunk, overlap
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = proto.ModelProto()
        spec.ParseFromString(Path(path).read_bytes())
        rules, training = spec.normalizer_spec, spec.trainer_spec
        plain = training.model_type == training.BPE and not rules.precompiled_charsmap and not rules.remove_extra_whitespaces and rules.escape_whitespaces and not training.treat_whitespace_as_suffix
        #: Pairs of characters that some piece holds side by side; None if chunks can't be spliced.
        self.inside = {p.piece[i : i + 2] for p in spec.pieces for i in range(len(p.piece) - 1)} if plain else None
        #: Whether the library's offsets count bytes.
        self.in_bytes = self.model.encode("é", return_type="proto").pieces[-1].end == 2
        self.widened = 0

    def proven(self, text: str, at: int) -> bool:
        """Whether no merge can join what stands before and after a place."""
        return text[at - 1 : at + 1].replace(" ", SPACE) not in self.inside

    def _encoded(self, text: str, start: int, end: int) -> tuple[list[int], list[int], list[int]]:
        pieces = self.model.encode(text[start:end], return_type="proto").pieces
        return [p.id for p in pieces], [p.begin for p in pieces], [p.end for p in pieces]

    def _edge(self, tokens: tuple[list[int], list[int], list[int]], text: str, start: int, at: int) -> int | None:
        """How many tokens of the chunk that begins at ``start`` end by ``at``; None if a token lies across it."""
        _, begins, ends = tokens
        offset = len(text[start:at].encode()) if self.in_bytes else at - start
        n = bisect_left(begins, offset)
        return n if n and ends[n - 1] == offset else None

    def _splice(self, text: str, a: int, first: tuple, end: int, low: int, overlap: int):
        """(place, first's tokens before it, the next chunk's start, end and tokens, those before the place) inside an overlap, or None."""
        b, upto = max(end - overlap, a), min(len(text), end + self.chunk - self.overlap)
        at = next((q for q in range(end - 1, max(b, low), -1) if self.proven(text, q)), None)
        if at is None:
            return None
        second = self._encoded(text, b, upto)
        left, right = self._edge(first, text, a, at), self._edge(second, text, b, at)
        return None if left is None or right is None else (at, left, b, upto, second, right)

    def spans(self, text: str) -> Iterator[list[int]]:
        """The ids of consecutive parts of a text, which together are the whole text's."""
        if self.inside is None or len(text) <= self.chunk:
            yield self.model.encode(text)
            return
        a, end, low, skip = 0, self.chunk, 0, 0
        tokens = self._encoded(text, a, end)
        while end < len(text):
            overlap = self.overlap
            while (found := self._splice(text, a, tokens, end, low, overlap)) is None:
                self.widened += 1
                if overlap < end - a:
                    overlap *= 2
                else:  # not even the whole chunk has a boundary that both share
                    end = min(len(text), a + 2 * (end - a))
                    tokens, overlap = self._encoded(text, a, end), self.overlap
                    if end == len(text):
                        break
            if found is None:
                break
            low, before, a, end, second, after = found
            yield tokens[0][skip:before]
            tokens, skip = second, after
        yield tokens[0][skip:]

    def count(self, text: str) -> int:
        return sum(map(len, self.spans(text)))


def token_counts(docs: DataFrame, path: str, limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """text, ... -> all columns, and n_bytes, n_tokens, over_limit (more tokens than the limit)."""
    if not path.endswith(".model"):
        raise ValueError("token_counts reads sentencepiece's .model files")
    added = ("n_bytes", "n_tokens", "over_limit")
    kept = [c for c in docs.columns if c not in added]
    mine = f"_{max(map(len, docs.columns)) * '_'}"  # a name that no column has

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkedEncoder(path, chunk, overlap)
        for batch in batches:
            for part in slices(batch, mine):
                own = list(texts(part, mine))
                counts = [encoder.count(t.decode("utf-8", "replace")) for t in own]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(c)) for c in kept), pa.array(map(len, own), pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                    names=[*kept, *added],
                )

    schema = docs.select(*kept, F.lit(None).cast("bigint").alias("n_bytes"), F.lit(None).cast("bigint").alias("n_tokens"), F.lit(None).cast("boolean").alias("over_limit")).schema
    return docs.select(*kept, F.col("text").alias(mine)).mapInArrow(run, schema)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents").select("doc_id", "text"), public_vocabulary("piece_bpe_32k.model")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
