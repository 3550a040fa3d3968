"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. A trigram's vector binds its letters,
rotated by their place (elementwise product); a text's vector bundles its trigrams (sum). The
profile of a language bundles all its training texts, and a text gets the language whose profile
has the largest cosine with its own vector.

Letters are taken in lower case; everything else separates words and counts as one blank, so
word beginnings and ends are trigrams too. The vector of a letter depends on its code point
alone: any script works, and no table of letters is needed.

Training gathers one vector per language and task, so what reaches the driver is one vector per
language, whatever the size of the corpus; every training row is used.

Defined results: NULL text, or text without a letter: ``und`` with score 0; without any training
row everything is ``und``; equal texts get equal answers; a tie goes to the language that comes
first in code-point order. Languages and ids are never inputs of a prediction. Only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loanloom.llm.common import pieces, ship

DIMENSIONS = 1024
UNKNOWN = "und"
SEED = 20_240
# characters handled in one numpy batch
BATCH_CHARS, BATCH_TEXTS = 1_000_000, 256
GRAMS_AT_ONCE = 4096
# values below this are counted in a table, larger ones by sorting
COUNTING_LIMIT = 1 << 22
BLANK = ord(" ")


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@cache
def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


@cache
def letter_vector(code: int, dimensions: int) -> np.ndarray:
    bits = np.random.Generator(np.random.Philox(key=[SEED, code])).integers(0, 2, dimensions, dtype=np.int8)
    return 2 * bits - 1


def trigram_vectors(letters: np.ndarray, keys: np.ndarray, dimensions: int) -> np.ndarray:
    """One row per key; a key holds three places in ``letters``."""
    base = np.stack([letter_vector(int(c), dimensions) for c in letters])
    n = len(letters)
    return np.roll(base, 2, axis=1)[keys // (n * n)] * np.roll(base, 1, axis=1)[keys // n % n] * base[keys % n]


def compact(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and the place of each value among them."""
    if not len(values) or values.max() >= COUNTING_LIMIT:
        return np.unique(values, return_inverse=True)
    present = np.flatnonzero(np.bincount(values))
    places = np.zeros(present[-1] + 1, dtype=np.int64)
    places[present] = np.arange(len(present))
    return present, places[values]


def bundles(texts: list[str], groups: np.ndarray, size: int, dimensions: int) -> np.ndarray:
    """Sum of the trigram vectors of the texts of each group, as whole numbers in float32.

    Lower case; a run of other characters is one blank, and each text has one at both ends.
    """
    lowered = [f" {text.lower()} " for text in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    codes = np.where(letter_table()[codes], codes, BLANK)
    stays = np.ones(len(codes), dtype=bool)
    stays[1:] = (codes[1:] != BLANK) | (codes[:-1] != BLANK) | (owner[1:] != owner[:-1])
    codes, owner = codes[stays], owner[stays]
    letters, at = compact(codes)
    inside = owner[:-2] == owner[2:]
    keys = ((at[:-2] * len(letters) + at[1:-1]) * len(letters) + at[2:])[inside]
    grams, gram = compact(keys)
    pairs = gram * size + groups[owner[:-2][inside]]
    if len(grams) * size < COUNTING_LIMIT:
        counts = np.bincount(pairs)
        pairs = np.flatnonzero(counts)
        counts = counts[pairs]
    else:
        pairs, counts = np.unique(pairs, return_counts=True)
    out = np.zeros((size, dimensions), dtype=np.float32)
    for start in range(0, len(grams), GRAMS_AT_ONCE):
        a, b = np.searchsorted(pairs, [start * size, (start + GRAMS_AT_ONCE) * size])
        some = grams[start:start + GRAMS_AT_ONCE]
        table = np.zeros((size, len(some)), dtype=np.float32)
        table[pairs[a:b] % size, pairs[a:b] // size - start] = counts[a:b]
        out += table @ trigram_vectors(letters, some, dimensions).astype(np.float32)
    return out


def stretches(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Parts of a batch with a bounded number of texts and characters; a longer text is alone."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and (size + len(text) > BATCH_CHARS or i - start == BATCH_TEXTS):
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def profiles(rows: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Unit profile of every language in ``rows`` (``text, lang``).

    Tasks sum their texts per language and Spark adds up the sums: at most languages times
    dimensions numbers come back.
    """
    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in pieces(batches):
            texts = batch.column("text").to_pylist()
            names, groups = np.unique(np.array(batch.column("lang").to_pylist(), dtype=object), return_inverse=True)
            for a, b in stretches(texts):
                found = bundles(texts[a:b], groups[a:b], len(names), dimensions)
                for name, vector in zip(names, found, strict=True):
                    sums[name] = sums.get(name, 0) + vector.astype(np.int64)
        for name, vector in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [name] * dimensions, "at": np.arange(dimensions), "value": vector})

    ship(rows.sparkSession)
    usable = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    parts = usable.mapInArrow(bundle, "lang string, at long, value long")
    found: dict[str, np.ndarray] = {}
    for row in parts.groupBy("lang", "at").agg(F.sum("value").alias("value")).collect():
        found.setdefault(row["lang"], np.zeros(dimensions))[row["at"]] = row["value"]
    return {lang: v / np.linalg.norm(v) for lang, v in sorted(found.items()) if v.any()}


def predict(docs: DataFrame, learned: dict[str, np.ndarray], text: str = "text", pred: str = "lang_pred",
            score: str = "score") -> DataFrame:
    """All columns of ``docs`` but ``text``, with the language and its score (cosine, at least 0)."""
    names = [*learned]
    matrix = np.stack([learned[n] for n in names]) if names else np.zeros((0, 1))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column(text).to_pylist()
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            places = [i for i, t in enumerate(texts) if has_letter(t)] if names else []
            usable = [texts[i] for i in places]
            for a, b in stretches(usable):
                found = bundles(usable[a:b], np.arange(b - a), b - a, matrix.shape[1]).astype(np.float64)
                norms = np.maximum(np.linalg.norm(found, axis=1), 1e-9)
                cosines = np.round(found @ matrix.T / norms[:, None], 6)
                for i, best, row in zip(places[a:b], cosines.argmax(axis=1), cosines, strict=True):
                    langs[i], scores[i] = names[best], min(max(row[best], 0.0), 1.0)
            rest = batch.drop_columns([text])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             [*rest.schema.names, pred, score])

    ship(docs.sparkSession)
    schema = StructType([f for f in docs.schema.fields if f.name != text])
    return docs.mapInArrow(answer, schema.add(pred, "string").add(score, "double"))


def held_out(doc_id: Column) -> Column:
    """Documents kept out of training: CRC-32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, learned from the rows not held out."""
    learned = profiles(docs.where(~held_out(F.col("doc_id"))), dimensions)
    return predict(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), learned)
