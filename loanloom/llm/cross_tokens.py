"""Align two tokenizers over a corpus: which tokens of one stand where tokens of the other do.

Both tokenizers spell the same bytes, so the places where a token of each ends cut a text into
groups; the two tokens that end a group are linked. Most groups hold one token of either side with
the same bytes. An array made once from the vocabularies maps an A id to the B id of the same bytes,
and such groups are only counted in vectors as long as the vocabulary. The others, the irregular
ones, go through a shuffle keyed by the pair of ids.

Counts return to the documents in three ways, all exact: the vector of identity links and the best
count of every B id are as long as a vocabulary, the pairs with more than one in ``HOT_PAIRS`` of
all irregular links are fewer than ``HOT_PAIRS``, and every other pair is joined by its ids, where
no key can hold more than that share of the rows.

Defined results: NULL and empty texts, and texts that either tokenizer does not spell byte by byte,
have no tokens, zeros, and empty ``groups``. Repeated rows and rows without id are documents of
their own and count like any other. Very long texts are aligned whole, one at a time. An empty
table gives no row and no pair. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import kept, ship
from loanloom.llm.packing import Encoder, _spelled_bytes

SPACE = " "
# irregular pairs that are looked up instead of joined: fewer than this, each more than a share of 1 / HOT_PAIRS
HOT_PAIRS = 16384
ROWS_AT_ONCE = 256
CHARS_AT_ONCE = 1_000_000
FIELD = np.dtype("<u4")
# bits of an id while ids of a few documents are counted
ID_BITS = 20


class Alignment(NamedTuple):
    """``documents``: one row per document; ``pairs``: ``a, b, count`` of the irregular links."""

    documents: DataFrame
    pairs: DataFrame


@dataclass(frozen=True)
class Vocabularies:
    """Files of tokenizer A (byte-level BPE of ``tokenizers``, with its split pattern) and B (``sentencepiece``)."""

    a_file: str
    a_pattern: str
    b_file: str


class _Tokenizers:
    """Both tokenizers in a worker, the bytes of their tokens, and the map between them."""

    def __init__(self, files: Vocabularies):
        import sentencepiece

        self.a = Encoder(files.a_file, files.a_pattern)
        self.b = sentencepiece.SentencePieceProcessor(model_file=files.b_file)
        self.a_bytes = _byte_level_bytes(self.a.tokenizer.get_vocab())
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [_piece_bytes(p, self.b.is_byte(i)) for i, p in enumerate(pieces)]
        self.a_sizes = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        self.same = self._same_bytes()
        self.a_names, self.b_names = (np.array([f"{i}," for i in range(n)] + [f"{i}{end}" for i in range(n)], dtype=object)
                                      for n, end in ((len(self.a_bytes), "|"), (len(self.b_bytes), ";")))

    def _same_bytes(self) -> np.ndarray:
        """B id of the same bytes for every A id, else -1; a written piece goes before a byte piece."""
        ids = {x: i for i, x in reversed(list(enumerate(self.b_bytes))) if self.b.is_byte(i)}
        ids.update({x: i for i, x in reversed(list(enumerate(self.b_bytes))) if not self.b.is_byte(i)})
        return np.array([ids.get(x, -1) for x in self.a_bytes], dtype=np.int64)

    def encode(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """Ids of A and B per text; none where one of them does not spell the text."""
        pairs = zip(texts, self.b.encode([t or "" for t in texts], num_threads=1))
        return [self._checked(text, b) if text else ([], []) for text, b in pairs]

    def _checked(self, text: str, b: list[int]) -> tuple[list[int], list[int]]:
        a = self.a.encoding.encode_ordinary(SPACE + text)
        spelled = (SPACE + text).encode()
        exact = (b"".join(map(self.a_bytes.__getitem__, a)) == spelled
                 and b"".join(map(self.b_bytes.__getitem__, b)) == spelled)
        return (a, b) if exact else ([], [])


@cache
def _tokenizers(files: Vocabularies) -> _Tokenizers:
    return _Tokenizers(files)


def _byte_level_bytes(vocabulary: dict[str, int]) -> list[bytes]:
    """Bytes of every id; an added token that is not spelled in byte letters counts as its own text."""
    spelled = _spelled_bytes()
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(spelled[c] for c in token) if all(c in spelled for c in token) else token.encode()
    return out


def _piece_bytes(piece: str, is_byte: bool) -> bytes:
    return bytes([int(re.fullmatch(r"<0x(..)>", piece)[1], 16)]) if is_byte else piece.replace("▁", SPACE).encode()


def _slices(texts: list[str | None]) -> Iterator[slice]:
    """Runs of rows with few texts and few characters; a very long text is alone."""
    start = chars = 0
    for i, text in enumerate(texts):
        if i > start and (i - start >= ROWS_AT_ONCE or chars + len(text or "") > CHARS_AT_ONCE):
            yield slice(start, i)
            start, chars = i, 0
        chars += len(text or "")
    if texts:
        yield slice(start, len(texts))


def _grouped(own: _Tokenizers, encoded: list[tuple[list[int], list[int]]]) -> dict[str, list]:
    """Groups and links of a few documents at once."""
    n_a, n_b = (np.array([len(x[side]) for x in encoded], dtype=np.int64) for side in (0, 1))
    a, b = (np.array([i for x in encoded for i in x[side]], dtype=np.int64) for side in (0, 1))
    a_ends, b_ends = np.cumsum(own.a_sizes[a]), np.cumsum(own.b_sizes[b])
    size = int(a_ends[-1]) + 1 if len(a) else 1
    a_cuts, b_cuts = _among(b_ends, size)[a_ends], _among(a_ends, size)[b_ends]
    a_last, b_last = np.flatnonzero(a_cuts), np.flatnonzero(b_cuts)
    of = np.repeat(np.arange(len(encoded)), n_a)[a_last]
    link_a, link_b = a[a_last], b[b_last]
    single = (np.diff(a_last, prepend=-1) == 1) & (np.diff(b_last, prepend=-1) == 1) & (own.same[link_a] == link_b)

    # texts of the groups: every id has its place among the ids of both sides
    names = np.empty(len(a) + len(b), dtype=object)
    b_before, a_upto = np.concatenate(([0], b_last + 1)), np.concatenate((a_last + 1, [0]))
    names[np.arange(len(a)) + b_before[np.cumsum(a_cuts) - a_cuts]] = own.a_names[a + len(own.a_bytes) * a_cuts]
    names[np.arange(len(b)) + a_upto[np.cumsum(b_cuts) - b_cuts]] = own.b_names[b + len(own.b_bytes) * b_cuts]
    stops = np.cumsum(n_a + n_b)
    return {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(of, minlength=len(encoded)),
            "groups": ["".join(names[stop - n:stop].tolist())[:-1] for stop, n in zip(stops, n_a + n_b)],
            "same": _counted(of[single], [link_a[single]], len(encoded)),
            "odd": _counted(of[~single], [link_a[~single], link_b[~single]], len(encoded))}


def _among(ends: np.ndarray, size: int) -> np.ndarray:
    marks = np.zeros(size, dtype=bool)
    marks[ends] = True
    return marks


def _counted(of: np.ndarray, ids: list[np.ndarray], documents: int) -> list[bytes]:
    """Per document: its distinct ids (or pairs of ids) with their number, as unsigned 32-bit fields."""
    key = of
    for column in ids:
        key = key << ID_BITS | column
    key, n = np.unique(key, return_counts=True)
    fields = [n]
    for _ in ids:
        fields.insert(0, key & ((1 << ID_BITS) - 1))
        key = key >> ID_BITS
    table = np.stack(fields, axis=1).astype(FIELD)
    edges = np.searchsorted(key, np.arange(documents + 1))
    return [table[s:e].tobytes() for s, e in zip(edges[:-1], edges[1:])]


def _fields(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row of a batch and fields of all entries in a column written by ``_counted``."""
    values = column.to_pylist()
    rows = np.repeat(np.arange(len(values)), [len(x) // (width * FIELD.itemsize) for x in values])
    return rows, np.frombuffer(b"".join(values), dtype=FIELD).reshape(-1, width).astype(np.int64)


def token_groups(docs: DataFrame, files: Vocabularies, digest: Callable[[Column], Column] | None = None) -> DataFrame:
    """Written: ``row, doc_id, n_a, n_b, n_groups, groups, same, odd`` per document.

    ``groups`` reads ``a1,a2|b1;a3|b2,b3``; ``digest`` may shorten it before it is written. ``same``
    and ``odd`` hold the document's identity links and irregular links with their numbers.
    """
    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokenizers(files)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in _slices(texts):
                found = _grouped(own, own.encode(texts[part]))
                rows = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_pydict(
                    {"row": rows.column("row"), "doc_id": rows.column("doc_id")}
                    | {c: pa.array(found[c], pa.int64()) for c in ("n_a", "n_b", "n_groups")}
                    | {"groups": pa.array(found["groups"], pa.string())}
                    | {c: pa.array(found[c], pa.binary()) for c in ("same", "odd")})

    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(
        group, f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, groups string, same binary, odd binary")
    if digest is not None:
        found = found.withColumn("groups", digest(F.col("groups")))
    return kept(found, "token-groups")


def _identity_counts(groups: DataFrame, size: int) -> np.ndarray:
    """How often every A id is linked to the B id of its bytes: one vector a task, added up."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            _, fields = _fields(batch.column("same"), 2)
            np.add.at(total, fields[:, 0], fields[:, 1])
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"a": seen, "n": total[seen]})

    out = np.zeros(size, dtype=np.int64)
    for a, n in groups.select("same").mapInArrow(count, "a long, n long").groupBy("a").agg(F.sum("n")).collect():
        out[a] = n
    return out


def _pair_counts(groups: DataFrame) -> DataFrame:
    """Written: ``a, b, count`` of the irregular links, added up inside each batch before the shuffle."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, fields = _fields(batch.column("odd"), 3)
            keys, at = np.unique(fields[:, 0] << 32 | fields[:, 1], return_inverse=True)
            n = np.bincount(at, weights=fields[:, 2], minlength=len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"a": keys >> 32, "b": keys & 0xFFFFFFFF, "n": n})

    pairs = groups.select("odd").mapInArrow(count, "a long, b long, n long")
    return kept(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")), "token-pairs")


def align(docs: DataFrame, files: Vocabularies, digest: Callable[[Column], Column] | None = None) -> Alignment:
    """Documents with ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups``, and the irregular pairs.

    ``count_sum`` adds the corpus-wide counts of a document's links, ``n_best`` counts the links whose
    count is the highest that their B id has with any A id.
    """
    own = _tokenizers(files)
    groups = token_groups(docs, files, digest)
    same, pairs = _identity_counts(groups, len(own.a_bytes)), _pair_counts(groups)

    # as long as the vocabulary of B, and fewer than HOT_PAIRS rows
    best = np.zeros(len(own.b_bytes), dtype=np.int64)
    mapped = own.same >= 0
    np.maximum.at(best, own.same[mapped], same[mapped])
    for b, n in pairs.groupBy("b").agg(F.max("count")).collect():
        best[b] = max(best[b], n)
    total = pairs.agg(F.sum("count")).first()[0] or 0
    listed = pairs.where(F.col("count") * HOT_PAIRS > total).collect()
    hot = np.array(sorted((r["a"] << 32 | r["b"], r["count"]) for r in listed), dtype=np.int64).reshape(-1, 2)
    identity = np.where(mapped & (same == best[own.same]), same, -same)  # below zero: not the best of its B id

    def look_up(fields: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of irregular pairs (0: not listed) and whether they are their B id's best."""
        keys = fields[:, 0] << 32 | fields[:, 1]
        at = np.minimum(np.searchsorted(hot[:, 0], keys), max(len(hot) - 1, 0))
        n = np.where(hot[at, 0] == keys, hot[at, 1], 0) if len(hot) else np.zeros(len(keys), dtype=np.int64)
        return n, n == best[fields[:, 1]]

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_best, count_sum = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            at, fields = _fields(batch.column("same"), 2)
            n = identity[fields[:, 0]]
            np.add.at(n_best, at, np.where(n > 0, fields[:, 1], 0))
            np.add.at(count_sum, at, np.abs(n) * fields[:, 1])
            at, fields = _fields(batch.column("odd"), 3)
            n, is_best = look_up(fields)
            np.add.at(n_best, at, np.where((n > 0) & is_best, fields[:, 2], 0))
            np.add.at(count_sum, at, n * fields[:, 2])
            yield pa.RecordBatch.from_pydict(
                {c: batch.column(c) for c in static} | {"n_best": n_best, "count_sum": count_sum})

    def unlisted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, fields = _fields(batch.column("odd"), 3)
            cold = look_up(fields)[0] == 0
            at, fields = at[cold], fields[cold]
            yield pa.RecordBatch.from_pydict(
                {"row": batch.column("row").to_numpy()[at], "a": fields[:, 0], "b": fields[:, 1], "n": fields[:, 2],
                 "best": best[fields[:, 1]]})

    static = ("row", "doc_id", "n_a", "n_b", "n_groups", "groups")
    kind = groups.schema["doc_id"].dataType.simpleString()
    looked_up = groups.mapInArrow(
        known, f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, groups string, n_best long, count_sum long")
    joined = groups.select("row", "odd").mapInArrow(unlisted, "row long, a long, b long, n long, best long").join(
        pairs.where(F.col("count") * HOT_PAIRS <= total), ["a", "b"])
    rest = joined.groupBy("row").agg(
        F.sum(F.when(F.col("count") == F.col("best"), F.col("n")).otherwise(0)).alias("more_best"),
        F.sum(F.col("n") * F.col("count")).alias("more_sum"))
    documents = looked_up.join(rest, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups")
    return Alignment(documents, pairs)
