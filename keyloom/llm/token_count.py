"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import SPACES, byte_slices, small_batches, text_of

#: Bytes of text encoded at a time, pieces remembered per worker, and the longest piece remembered.
BATCH_BYTES, REMEMBERED, LONGEST = 1 << 20, 300_000, 64
_TO_BLANK = {ord(c): " " for c in SPACES}


def tokenizer_json(path: str | None = None) -> str:
    """The definition of a public tokenizer, by default word_bpe_49k."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


class PieceCounter:
    """Counts tokens by pieces between ASCII white space, remembering the counts of short pieces.

    The boundary is safe for a tokenizer whose pre-tokenizer drops white space: no token, special string or
    normalisation reaches over it, so a long text's count is the sum over its pieces.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {"": 0}

    def _encode(self, pieces: list[str]) -> dict[str, int]:
        out, batch, size = {}, [], 0
        for i, p in enumerate(pieces):
            batch.append(p)
            size += len(p)
            if size >= BATCH_BYTES or i + 1 == len(pieces):
                for x, e in zip(batch, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False), strict=True):
                    out[x] = len(e)
                batch, size = [], 0
        return out

    def counts(self, texts: list[str]) -> list[int]:
        split = [x.translate(_TO_BLANK).split(" ") if not x.isascii() else x.replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") for x in texts]
        wanted = set().union(*split) if split else set()
        if len(self.known) > REMEMBERED:
            self.known = {"": 0}
        known = self.known
        fresh = self._encode([p for p in wanted if p not in known])
        long = {p: n for p, n in fresh.items() if len(p) > LONGEST}
        known.update((p, n) for p, n in fresh.items() if len(p) <= LONGEST)
        if not long:
            return [sum(map(known.__getitem__, x)) for x in split]
        return [sum(long[p] if p in long else known[p] for p in x) for x in split]


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens for every row of ``docs``; a null or empty text has 0 of both.

    Repeated rows and null ids give a row each; extra columns are not read. The vocabulary file (under 2 MB, whatever
    the corpus) goes to the workers as a broadcast.
    """
    spark = docs.sparkSession
    small_batches(spark)
    definition = spark.sparkContext.broadcast(tokenizer_json(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = PieceCounter(definition.value)
        for whole in batches:
            for b in byte_slices(whole, "text", BATCH_BYTES):
                n = counter.counts(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return read.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
