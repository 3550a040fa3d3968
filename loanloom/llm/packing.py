"""Pack tokenised documents into fixed windows: concatenate and cut.

Pass one tokenises every document once, ends it with an end token, and writes the ids with the
partition the document was read in and its offset there. Totals per partition, added up, place
every partition in one long sequence of tokens; pass two cuts that sequence into windows of
equal length. Each document becomes one piece per window it touches, with its place in both.
Only the last window can be short, so there is next to no padding.

Defined results: NULL and empty texts consist of the end token alone; repeated rows are packed
as often as they occur; a very long text is cut into as many pieces as it needs; an empty table
gives no piece. Ids are unsigned 32-bit little-endian bytes. Order is that of the input files.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanloom.llm.common import kept, ship

WINDOW = 1024
END = 0
ID_BYTES = 4
ROWS_AT_ONCE = 256


class Encoder:
    """Ids of texts by a byte-level BPE file of the ``tokenizers`` library.

    The merges run in ``tiktoken`` over the file's own vocabulary: the same ids (tests compare
    both libraries, random Unicode included) in a quarter of the time. With ``added`` a text that
    contains an added token of the file goes to ``tokenizers`` itself, which gives that token's id;
    without, the name of such a token is ordinary text.
    """

    def __init__(self, path: str, pattern: str, added: bool = False):
        import tiktoken
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        special = {token.content for token in tokenizer.get_added_tokens_decoder().values()}
        spelled = _spelled_bytes()
        ranks = {bytes(spelled[c] for c in token): i for token, i in tokenizer.get_vocab().items() if token not in special}
        self.tokenizer, self.added = tokenizer, sorted(special) if added else []
        self.encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        return [np.array([*self._encode(text or ""), END], dtype="<u4").tobytes() for text in texts]

    def _encode(self, text: str) -> list[int]:
        if any(token in text for token in self.added):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.encoding.encode_ordinary(text)


@cache
def encoder_of(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern, added=True)


def _spelled_bytes() -> dict[str, int]:
    """How byte-level files spell bytes: printable Latin-1 as itself, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def tokenised(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Pass one, written: ``part, place, before, doc_id, ids``.

    ``place`` numbers the documents of a partition and ``before`` counts the tokens before
    each. Partitions follow the input files, so a task that runs again gives the same rows.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, place, before = encoder_of(path, pattern), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(at, ROWS_AT_ONCE)
                ids = encoder(rows.column("text").to_pylist())
                counts = np.array([len(x) // ID_BYTES for x in ids], dtype=np.int64)
                yield pa.RecordBatch.from_pydict({
                    "part": np.full(len(ids), part, dtype=np.int64), "place": np.arange(place, place + len(ids)),
                    "before": before + np.cumsum(counts) - counts, "doc_id": rows.column("doc_id"),
                    "ids": pa.array(ids, pa.binary())})
                place, before = place + len(ids), before + int(counts.sum())

    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return kept(docs.select("doc_id", "text").mapInArrow(
        encode, f"part long, place long, before long, doc_id {kind}, ids binary"), "pack-ids")


def pack(docs: DataFrame, path: str, pattern: str, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

    Partition totals are one row per input partition; their running sum is the only step that
    one task does alone, and the only table that is broadcast.
    """
    tokens = tokenised(docs, path, pattern).withColumn("doc_tokens", (F.octet_length("ids") / ID_BYTES).cast("long"))
    totals = tokens.groupBy("part").agg(F.max(F.col("before") + F.col("doc_tokens")).alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    placed = tokens.join(F.broadcast(bases), "part").withColumn("at", F.col("base") + F.col("before"))
    first = F.floor(F.col("at") / window)
    last = F.floor((F.col("at") + F.col("doc_tokens") - 1) / window)
    cut = placed.withColumn("sequence_id", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("sequence_id") * window - F.col("at"), F.lit(0))
    stop = F.least((F.col("sequence_id") + 1) * window - F.col("at"), F.col("doc_tokens"))
    pieces = cut.withColumns({"start": start, "length": stop - start})
    return pieces.select(
        "doc_id", "start", "length", "doc_tokens", "sequence_id",
        (F.col("at") + F.col("start") - F.col("sequence_id") * window).alias("offset"),
        F.expr(f"substring(ids, cast(start * {ID_BYTES} + 1 as int), cast(length * {ID_BYTES} as int))").alias("ids"))
