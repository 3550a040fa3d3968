"""Document fingerprints of closed syncmers.

A text is a sequence of words. A stretch of ``K`` words is an anchor if, of the ``K - S + 1``
stretches of ``S`` words inside, the one with the smallest hash is the first or the last: a closed
syncmer. Whether it is one depends on its own words alone, so an edit elsewhere can neither create
nor remove it, equal passages have equal anchors at equal places, and no window of
``K - S + 1`` stretches is without one.

The fingerprint of a text keeps its ``SIZE`` smallest anchor hashes, 8 hex digits each. Two
fingerprints are as alike as the share of hashes they have in common among the smallest of both
together, an estimate of the Jaccard similarity of their anchors.

Defined results: a text of fewer than ``K`` words has one anchor, all of it; a text without words
(or NULL) has an empty fingerprint, and two of those are alike (1.0); words of more than ``WORD_PART``
code points count as several, so texts without blanks have anchors too; equal texts have equal
fingerprints. Successors are in order of id (NULL last), then of the text's hash, so rows that repeat an id
follow each other. The only document is its own successor.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanloom.functions.ordered import range_limits

K, S = 5, 2
SIZE = 64
WORD_PART = 16
DIGITS = 8
WORDS = r"[^\x20\x09-\x0D]{1,%d}"


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """All anchors in order of place: ``struct(at, hash)``."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORDS % WORD_PART), F.lit(0))
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def chosen(h):
        inner = F.transform(F.sequence(F.lit(0), F.size(h) - s), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(s)]))
        return F.flatten(F.transform(F.array(inner), lambda m: F.transform(F.filter(
            F.sequence(F.lit(0), F.size(h) - k), lambda i: _closed(m, i, k - s)),
            lambda i: F.struct(i.alias("at"), _short(F.xxhash64(*[F.get(h, i + j) for j in range(k)])).alias("hash")))))

    whole = F.transform(F.array(hashes), lambda h: F.struct(F.lit(0).alias("at"), _short(F.xxhash64(h)).alias("hash")))
    return F.flatten(F.transform(F.array(hashes), lambda h: F.when(F.size(h) >= k, chosen(h))
                                 .when(F.size(h) > 0, whole).otherwise(F.slice(whole, 1, 0))))


def _closed(inner: Column, i: Column, width: int) -> Column:
    values = [F.get(inner, i + j) for j in range(width + 1)]
    return F.least(values[0], values[-1]) <= F.least(*values[1:-1])


def _short(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << 4 * DIGITS) - 1))


def sketch(text: Column, size: int = SIZE) -> Column:
    """The smallest distinct anchor hashes, in order."""
    return F.slice(F.array_sort(F.array_distinct(F.transform(anchors(text), lambda a: a["hash"]))), 1, size)


def spelled(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), DIGITS, "0")), "")


def likeness(a: Column, b: Column, size: int = SIZE) -> Column:
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, size)
    common = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(common / F.size(union))


def with_successor(docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``docs`` with the named columns of the next row in order of ``doc_id``, as ``next_<name>``.

    Ids are cut into ranges that are sorted on their own. The first row of every range goes to the
    range before as well, where it only serves as a successor; that of the first range goes to the
    last one. The table of ranges has one row per range, fixed by the number of shuffle partitions.
    """
    limits = range_limits(docs, "doc_id")
    rows = docs.withColumn("_id", F.col("doc_id").cast("double"))
    if limits:
        rows = Bucketizer(splits=[-math.inf, *limits, math.inf], inputCol="_id", outputCol="_range", handleInvalid="keep").transform(rows)
    else:
        rows = rows.withColumn("_range", F.when(F.col("_id").isNotNull(), F.lit(0.0)))
    rows = rows.withColumn("_range", F.coalesce("_range", F.lit(len(limits) + 2.0))).drop("_id")
    by_range = Window.orderBy("_range")
    firsts = rows.groupBy("_range").agg(F.min("doc_id").alias("_first")).withColumn(
        "_before", F.coalesce(F.lag("_range").over(by_range), F.max("_range").over(Window.partitionBy())))
    marked = rows.join(F.broadcast(firsts), "_range")
    places = F.array(F.struct(F.col("_range").alias("range"), F.lit(False).alias("extra")))
    copied = F.concat(places, F.array(F.struct(F.col("_before").alias("range"), F.lit(True).alias("extra"))))
    leads = F.col("doc_id").eqNullSafe(F.col("_first"))
    spread = marked.withColumn("_at", F.explode(F.when(leads, copied).otherwise(places)))
    order = Window.partitionBy("_at.range").orderBy("_at.extra", F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    return (spread.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where("NOT _at.extra")
            .select(*docs.columns, *[f"next_{c}" for c in columns]))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Every document, the same with its second half taken from its successor, and what their fingerprints tell.

    ``doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next``.
    """
    sketched = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("sketch", sketch(F.col("text")))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    both = (with_successor(sketched, ["text", "sketch"]).withColumn("edited", edited)
            .withColumn("edited_sketch", sketch(F.col("edited"))))
    return both.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), "edited", spelled(F.col("sketch")).alias("fingerprint"),
        spelled(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
