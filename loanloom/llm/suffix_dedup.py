"""Remove long byte strings that occur more than once, with a logarithmic family of suffix arrays.

Only suffixes at anchors are indexed. Every string of ``LENGTH`` bytes has one anchor: the start of
the ``GRAM`` bytes inside it with the smallest hash. Equal strings have equal anchors at equal
places, so two occurrences always meet at an indexed suffix, while only one or two bytes in a
hundred start one. A suffix is ordered by the hash of its first ``GRAM`` bytes and carries the hash
of its region, all strings of which it is the anchor.

Documents come in batches. A batch is turned into an array of its distinct suffix keys, which is
scanned against every existing level for keys that both have; then levels that cover equally many
batches merge, as in a binary counter, so a key is written a logarithmic number of times. An array
holds per key whether it occurred more than once and whether its regions differ.

A key that occurs more than once with one and the same region is a match of the whole region. Where
regions differ (at the ends of a common passage), one region of each kind is spelled out into blocks
of ``BLOCK`` strings. Again a block that occurs more than once matches as a whole, and only blocks
that have something in common but differ are spelled out into single strings, one block of each
kind. All comparisons are of 128 bits, key and content together. Nothing depends on the size of a group of copies: groups are counted, never
paired.

Defined results: strings are judged on the input; matches never cross documents, but a document
may match itself, overlaps included; NULL text is empty; rows that repeat are copies of each other;
texts shorter than ``LENGTH`` bytes are never changed; an empty table gives no row. Only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import forget, kept, release, ship

LENGTH = 200
GRAM = 64
BLOCK = 16
BATCHES = 4
SEED = 7
# strings of one document handled at once; their places fit in PLACE bits
STRINGS_AT_ONCE = 1 << 19
PLACE = 20


@cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number per byte value; powers of an odd base modulo 2^64 and of its inverse."""
    values = np.random.Generator(np.random.PCG64(SEED)).integers(1, 1 << 63, 256, dtype=np.uint64)
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    n = STRINGS_AT_ONCE + LENGTH
    powers = np.concatenate([[np.uint64(1)], np.full(n, base, dtype=np.uint64)]).cumprod(dtype=np.uint64)
    inverses = np.concatenate([[np.uint64(1)], np.full(n, inverse, dtype=np.uint64)]).cumprod(dtype=np.uint64)
    return values, powers, inverses


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Rolling hash of the bytes from each place on."""
    values, powers, inverses = _powers()
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * inverses[:len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * powers[:len(data) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of every window, from running minima of blocks in both directions."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n - width + 1], forward[width - 1:n])


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """Keys and places of the anchors of a text, with the first and last start of the strings of each."""
    data = np.frombuffer(text, dtype=np.uint8)
    low = np.uint64((1 << PLACE) - 1)
    for begin in range(0, len(data) - length + 1, STRINGS_AT_ONCE):
        h = gram_hashes(data[begin:begin + STRINGS_AT_ONCE + length - 1], gram)
        least = window_minima((h & ~low) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
        anchor = (least & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(anchor) - 1]])
        yield h[anchor[first]].view(np.int64), anchor[first] + begin, first + begin, last + begin


_SUFFIX = pa.struct([("key", pa.int64()), ("region", pa.int64()), ("at", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])


def prepared(docs: DataFrame, batches: int) -> DataFrame:
    """Written: ``row, batch, doc_id, n_bytes``, the compressed text and the indexed suffixes of every row."""
    def prepare(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        shrink = zstandard.ZstdCompressor(level=1).compress
        for batch in found:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()]
                keys, places, firsts, lasts, regions, ends = [], [], [], [], [], [0]
                for text in texts:
                    for key, at, first, last in anchors(text):
                        keys.append(key)
                        places.append(at)
                        firsts.append(first)
                        lasts.append(last)
                        regions += [xxhash.xxh64_intdigest(text[a:b + LENGTH]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                    ends.append(len(regions))
                flat = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (keys, places, firsts, lasts)]
                structs = pa.StructArray.from_arrays(
                    [pa.array(flat[0]), pa.array(np.array(regions, dtype=np.uint64).view(np.int64)), *map(pa.array, flat[1:])],
                    fields=list(_SUFFIX))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                    "packed": pa.array([shrink(t) for t in texts], pa.binary()),
                    "suffixes": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)})

    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(
        prepare, f"doc_id {kind}, n_bytes long, packed binary, suffixes array<struct<key:bigint,region:bigint,at:bigint,first:bigint,last:bigint>>")
    row = F.monotonically_increasing_id()
    return kept(rows.withColumn("row", row).withColumn("batch", F.pmod(F.xxhash64("row"), F.lit(batches)).cast("int")), "suffix-rows", by="batch")


def suffixes(rows: DataFrame) -> DataFrame:
    return rows.select("row", F.explode("suffixes").alias("s")).select("row", "s.*")


class SuffixLevels:
    """Suffix arrays of the batches so far; a level covers 1, 2, 4, ... batches.

    ``repeated`` has every key that occurred more than once. Merging a level tells which keys it
    shares with the new batch, as scanning does, so levels that merge are not scanned as well.
    """

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []
        self.found: list[DataFrame] = []

    def add(self, batch: DataFrame) -> None:
        """Take in ``batch(key, region)``: sort it, scan the levels that stay, merge those it completes."""
        size, array = 1, _array(batch.select("key", "region", F.lit(False).alias("many"), F.lit(False).alias("mixed")))
        merging = []
        while self.levels and self.levels[-1][0] == size:
            merging.append(self.levels.pop()[1])
            size *= 2
        for _, level in self.levels:
            theirs = level.select(F.col("key").alias("_key"), F.col("region").alias("_region"), F.col("mixed").alias("_mixed"))
            shared = array.join(theirs, F.col("key") == F.col("_key"))
            self.found.append(kept(shared.select(
                "key", (F.col("mixed") | F.col("_mixed") | (F.col("region") != F.col("_region"))).alias("mixed")), "suffix-found"))
        if merging:
            merged = _array(reduce(DataFrame.unionByName, [array, *merging]))
            for old in [array, *merging]:
                forget(old)
            array = merged
        self.levels.append((size, array))
        release(array.sparkSession)

    def repeated(self) -> DataFrame:
        """``key, mixed``: keys that occurred more than once, and whether their regions differ."""
        inside = [level.where("many").select("key", "mixed") for _, level in self.levels]
        return kept(reduce(DataFrame.unionByName, [*inside, *self.found]).groupBy("key").agg(F.max("mixed").alias("mixed")), "suffix-repeated")

    def close(self) -> None:
        """Delete the arrays."""
        for df in [*(level for _, level in self.levels), *self.found]:
            forget(df)
        self.levels, self.found = [], []


def _array(entries: DataFrame) -> DataFrame:
    """One entry per key, in order of keys; regions and copies are counted before the shuffle."""
    whole = entries.groupBy("key").agg(F.min("region").alias("region"), F.max("region").alias("_other"), F.count("*").alias("_n"),
                                       F.max("many").alias("many"), F.max("mixed").alias("mixed"))
    return kept(whole.select("key", "region", (F.col("many") | (F.col("_n") > 1)).alias("many"),
                             (F.col("mixed") | (F.col("region") != F.col("_other"))).alias("mixed")).sortWithinPartitions("key"), "suffix-level")


def _blocks(text: bytes, r: dict) -> Iterator[tuple[int, int, int, int]]:
    """First and last string of each block of a region; hashes of what they share and of all they cover.

    Blocks are counted from the anchor, so two regions that share a string share its block.
    """
    import xxhash

    for j in range((r["at"] - r["last"]) // BLOCK, (r["at"] - r["first"]) // BLOCK + 1):
        common = r["at"] - j * BLOCK
        first, last = max(r["first"], common - BLOCK + 1), min(r["last"], common)
        yield (first, last, xxhash.xxh64_intdigest(text[common:common + LENGTH - BLOCK + 1], j),
               xxhash.xxh64_intdigest(text[first:last + LENGTH], last - common + BLOCK))


def _strings(text: bytes, r: dict) -> Iterator[tuple[int, int, int, int]]:
    import xxhash

    for a in range(r["first"], r["last"] + 1):
        content = xxhash.xxh64_intdigest(text[a:a + LENGTH])
        yield a, a, content, content


def _spelled_out(regions: DataFrame, rows: DataFrame, parts: Callable) -> DataFrame:
    """Written: ``key, row, at, first, last, shared, whole`` for all parts of the given regions."""
    def spell(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        grow = zstandard.ZstdDecompressor().decompress
        for batch in found:
            for i in range(batch.num_rows):
                text, wanted = grow(batch.column("packed")[i].as_py()), batch.column("regions")[i].as_py()
                out = [(r["key"], r["at"], *part) for r in wanted for part in parts(text, r)]
                key, at, first, last, shared, whole = (
                    np.array(x, dtype=t) for x, t in zip(zip(*out, strict=True), "qqqqQQ", strict=True))
                yield pa.RecordBatch.from_pydict({
                    "key": key, "row": np.full(len(out), batch.column("row")[i].as_py()), "at": at, "first": first, "last": last,
                    "shared": shared.view(np.int64), "whole": whole.view(np.int64)})

    wanted = regions.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("key", "at", "first", "last")).alias("regions"))
    units = kept(rows.select("row", "packed").join(wanted, F.col("row") == F.col("_row")).select("row", "packed", "regions")
                 .mapInArrow(spell, "key long, row long, at long, first long, last long, shared long, whole long"), "suffix-parts")
    release(rows.sparkSession)
    return units


def _settled(units: DataFrame, more: bool) -> tuple[DataFrame, DataFrame | None]:
    """Of ``units(key, row, at, first, last, shared, whole)``, those whose whole occurs more than once.

    With ``more``, also one unit of each kind where units share something but differ.
    """
    kinds = kept(units.groupBy(F.col("key").alias("_key"), F.col("shared").alias("_shared"), F.col("whole").alias("_whole")).agg(
        F.count("*").alias("n"), F.min(F.struct("row", "at", "first", "last")).alias("one")), "suffix-kinds")
    again = units.join(kinds.where("n > 1").select("_key", "_shared", "_whole"),
                       (F.col("key") == F.col("_key")) & (F.col("shared") == F.col("_shared")) & (F.col("whole") == F.col("_whole")), "left_semi")
    spans = kept(again.select("row", F.col("first").alias("start"), (F.col("last") + LENGTH).alias("stop")), "suffix-spans")
    differing = None
    if more:
        several = kept(kinds.groupBy(F.col("_key").alias("key"), F.col("_shared").alias("shared")).agg(
            F.min("_whole").alias("a"), F.max("_whole").alias("b")).where("a <> b").select("key", "shared"), "suffix-several")
        differing = kept(kinds.join(several, (F.col("key") == F.col("_key")) & (F.col("shared") == F.col("_shared")), "left_semi")
                         .select(F.col("_key").alias("key"), "one.*"), "suffix-differing")
        forget(several)
    forget(kinds)
    release(units.sparkSession)
    return spans, differing


def repeated_spans(rows: DataFrame, batches: int) -> DataFrame:
    """``row, start, stop``: stretches of bytes covered by strings found elsewhere; they may overlap."""
    levels = SuffixLevels()
    for i in range(batches):
        levels.add(suffixes(rows.where(F.col("batch") == i)))
    repeated = levels.repeated().withColumnRenamed("key", "_key")
    levels.close()
    met = kept(suffixes(rows).join(repeated, F.col("key") == F.col("_key")).drop("_key"), "suffix-met")
    release(rows.sparkSession)
    spans, regions = _settled(met.where("mixed").withColumn("shared", F.lit(0).cast("long")).withColumnRenamed("region", "whole"), more=True)
    found = [met.where("NOT mixed").select("row", F.col("first").alias("start"), (F.col("last") + LENGTH).alias("stop")), spans]
    for parts in (_blocks, _strings):
        units = _spelled_out(regions, rows, parts)
        spans, regions = _settled(units, more=parts is _blocks)
        forget(units)
        found.append(spans)
    return reduce(DataFrame.unionByName, found)


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal stretches of what the spans cover; spans that touch are one."""
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def dedup_substrings(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: the stretches removed from each text, and the bytes that stay."""
    def cut(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        grow = zstandard.ZstdDecompressor().decompress
        for batch in found:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                spans, left = [], []
                for packed, found_spans in zip(part.column("packed").to_pylist(), part.column("found").to_pylist(), strict=True):
                    text, runs = grow(packed), merged_spans([(s["start"], s["stop"]) for s in found_spans or []])
                    edges = [0, *(x for run in runs for x in run), len(text)]
                    left.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                    spans.append([{"start": a, "stop": b} for a, b in runs])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "n_bytes": part.column("n_bytes"),
                    "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                    "kept": pa.array(left, pa.binary())})

    rows = prepared(docs, batches)
    spans = repeated_spans(rows, batches).groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("start", "stop")).alias("found"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (rows.select("row", "doc_id", "n_bytes", "packed").join(spans, F.col("row") == F.col("_row"), "left")
            .select("doc_id", "n_bytes", "packed", "found")
            .mapInArrow(cut, f"doc_id {kind}, n_bytes long, spans array<struct<start:bigint,stop:bigint>>, kept binary"))
