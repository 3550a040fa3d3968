"""SimHash near-duplicates through Golay keys.

A document's 64-bit fingerprint has the majority bits of the hashes of its word shingles.
Fingerprints are cut into segments of at most 23 bits, and a segment is decoded to the indices of
the Golay codewords near it: segments that differ in one or two bits share an index.

``simhash_components`` links all fingerprints that differ in at most two bits. Of three segments
one has no error, and any other has two at most; so the exact bits of one segment with the Golay
indices of the next make keys of about 33 bits, one of which every link shares. Small buckets are
compared pair by pair. Fingerprints of larger ones (thousands of near copies) emit all words within
one bit of theirs instead: two fingerprints within two bits meet in one of these words, all that
meet are within two bits of each other, and each is linked to the smallest there. Both ways are
exact, and neither forms the pairs of a large group.

``near_duplicates`` finds documents of a Jaccard similarity of ``SIMILARITY`` over five-word shingles. It starts
from fingerprints and Golay keys: what these link and whole sets confirm is connected. Such a similarity may be
up to about a fifth of a fingerprint's bits, for which Golay keys find part of the pairs only; so for the rest the search
goes on over the shingle hashes. In any common order of the hashes two sets of that similarity share one
among the first fifth of each. By value, that fifth makes the keys, and of a document that has such a partner
about 0.8 of them recur: where less than 0.7 of them less four standard errors (``_least_shared``) do, it has none.
That is the only place left to chance: a pair at 0.8 falls below it by more than four standard errors only.
Every member of a bucket is compared with the smallest node it meets, its centre, which connects groups of near
copies at one comparison a member. Of what is not connected then, members of small buckets are paired, and
members of large ones are searched again: those of one centre by the hashes in which they differ from it
(``_twin_pairs``), those of different centres by their own hashes (``_shared_pairs``), rarest hash first.
Hashes that no other has meet nobody and only count, so a passage that many share is a key for documents with little
else. Every comparison is of whole sets.

Defined results: text without words (or NULL) has fingerprint zero and an empty shingle set, equal
to each other; texts with fewer words than a shingle are one shingle; repeated rows are documents
of their own; NULL ids come last. Only the named columns are read, others pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loanloom.llm.common import fresh, forget, kept, numbered, pieces, release, ship, sweep, written
from loanloom.llm.components import components
from loanloom.llm.golay import neighbour_keys

SEED = 42
# first bit and width of each segment
SEGMENTS = ((42, 22), (21, 21), (0, 21))
MAX_BITS = 2
# the exact search goes over the hashes in so many parts
HASH_SLICES = 4
# up to this size the members of a bucket are compared pair by pair
PAIRED_BUCKET = 32
SIMILARITY = 0.8


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; A-Z count as lower case."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    spans = zip(starts, (ends[size - 1:] - 1).tolist(), strict=False)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), dtype=np.uint64, count=len(words) - size + 1)


def majority(hashes: np.ndarray) -> int:
    """Bits that more than half of the hashes have, as a signed 64-bit number."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        rows = hashes[at:at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">u8")[0].astype(np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """All columns but ``text``, with ``fp``."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [majority(shingle_hashes(t, shingle)) for t in batch.column("text").to_pylist()]
            rest = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(found, pa.int64())], [*rest.schema.names, "fp"])

    ship(docs.sparkSession)
    return docs.mapInArrow(add, docs.drop("text").schema.add("fp", "long"))


def _segment(fp: np.ndarray, i: int) -> np.ndarray:
    first, width = SEGMENTS[i]
    return fp.astype(np.uint64) >> np.uint64(first) & np.uint64((1 << width) - 1)


def golay_keys(prints: DataFrame) -> DataFrame:
    """``key, fp``: exact bits of each segment with the Golay indices of the next one."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            fp = batch.column("fp").to_numpy()
            for i in range(len(SEGMENTS)):
                place, index = neighbour_keys(_segment(fp, (i + 1) % len(SEGMENTS)).astype(np.int64))
                exact = _segment(fp, i).astype(np.int64)[place]
                yield pa.RecordBatch.from_pydict({"key": i << 40 | exact << 12 | index, "fp": fp[place]})

    ship(prints.sparkSession)
    return prints.select("fp").mapInArrow(keys, "key long, fp long")


def differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def close_links(prints: DataFrame) -> DataFrame:
    """Links between distinct fingerprints (``fp``) within two bits: enough of them to connect all."""
    keys = kept(golay_keys(prints), "simhash-keys")
    buckets = kept(keys.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"))
                   .where("n > 1"), "simhash-buckets")
    twos = buckets.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    members = keys.join(buckets.where("n > 2").select("_key", "n"), F.col("key") == F.col("_key"))
    some = members.where(F.col("n") <= PAIRED_BUCKET).groupBy("key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    pairs = (some.select("fps", F.posexplode("fps").alias("at", "a"))
             .select("a", F.explode(F.slice("fps", F.col("at") + 2, F.size("fps"))).alias("b")))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
    crowd = members.where(F.col("n") > PAIRED_BUCKET).select("fp").distinct()
    words = kept(crowd.select("fp", F.explode(F.transform(flips, lambda bit: F.col("fp").bitwiseXOR(bit))).alias("word")), "simhash-words")
    meets = kept(words.groupBy(F.col("word").alias("_word")).agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1"), "simhash-meets")
    stars = words.join(meets, F.col("word") == F.col("_word")).select("a", F.col("fp").alias("b")).where("a <> b")
    return (twos.unionByName(pairs).where(differing(F.col("a"), F.col("b")) <= MAX_BITS).unionByName(stars)
            .where("a <> b").distinct())


def simhash_components(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fp, component_id`` per row: the smallest id reachable over links of at most two bits."""
    prints = kept(fingerprints(docs.select("doc_id", "text"), shingle), "simhash-prints")
    distinct = kept(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = components(close_links(distinct)).withColumnRenamed("root", "_root")
    rooted = kept(distinct.join(roots, F.col("fp") == F.col("node"), "left")
                  .select("fp", "first_id", F.coalesce("_root", "fp").alias("root")), "simhash-rooted")
    ids = rooted.groupBy(F.col("root").alias("_id")).agg(F.min("first_id").alias("component_id"))
    named = kept(rooted.join(ids, F.col("root") == F.col("_id")).select(F.col("fp").alias("_fp"), "component_id"), "simhash-named")
    return prints.join(named, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def fingerprint_text(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _shingle_sets(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``row, doc_id, fp, digest, size, keys``: fingerprint, 128 bits that stand for the set of hashes, its size, its first hashes by value."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in pieces(batches):
            prints, digests, sizes, keys = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingle_hashes(text, shingle)
                prints.append(majority(found))
                hashes = np.unique(found.view(np.int64))
                digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                sizes.append(len(hashes))
                keys.append(hashes[:len(hashes) - math.ceil((similarity - 1e-9) * len(hashes)) + 1])
            yield pa.RecordBatch.from_pydict({
                "row": batch.column("row"), "doc_id": batch.column("doc_id"), "fp": pa.array(prints, pa.int64()),
                "digest": pa.array(digests, pa.binary()), "size": pa.array(sizes, pa.int32()), "keys": pa.array(keys, pa.list_(pa.int64()))})

    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("row", "doc_id", "text").mapInArrow(
        add, f"row long, doc_id {kind}, fp long, digest binary, size int, keys array<long>")


def _hash_sets(texts: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """Written: ``node, hashes`` of the ``wanted`` nodes, rows of ``texts``, and the other columns of ``wanted``."""
    others = [f for f in wanted.schema.fields if f.name != "node"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = [np.unique(shingle_hashes(text, shingle).view(np.int64)) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"node": batch.column("node"), "hashes": pa.array(sets, pa.list_(pa.int64())),
                                              **{f.name: batch.column(f.name) for f in others}})

    names = wanted.select(F.col("node").alias("_of"), *[f.name for f in others])
    some = texts.select(F.col("row").alias("node"), "text").join(names, F.col("node") == F.col("_of")).drop("_of")
    kind = StructType([*StructType.fromDDL("node long, hashes array<long>"), *others])
    return kept(some.mapInArrow(add, kind), "near-sets")


def _alike(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Written: those of ``pairs(a, b)`` that are similar enough, by all hashes of both."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _hash_sets(texts, ends, shingle)
    left = sets.select(F.col("node").alias("_a"), F.col("hashes").alias("hashes_a"))
    right = sets.select(F.col("node").alias("_b"), F.col("hashes").alias("hashes_b"))
    common = F.size(F.array_intersect("hashes_a", "hashes_b"))
    links = kept(pairs.join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b"))
                 .where(common / (F.size("hashes_a") + F.size("hashes_b") - common) >= similarity).select("a", "b"), "near-links")
    forget(sets)
    release(texts.sparkSession)
    return links


def _least_shared(size: Column, similarity: float) -> Column:
    """How many of a set's keys are keys of any set of that similarity, but for chance."""
    keys = _prefix_length(size, similarity)
    return F.greatest(F.lit(1.0), F.lit(similarity - 0.1) * keys - 4 * F.sqrt(F.lit(similarity * (1 - similarity)) * keys) - 1)


def _members(nodes: DataFrame, similarity: float) -> DataFrame:
    """Written: ``key, node, size, least, hot`` with the number ``n`` and smallest node ``lo`` of the bucket.

    Only nodes that can have a partner, and keys of more than one of them. ``hot``: how many keys the node has in
    large buckets.
    """
    keys = nodes.select(F.explode("keys").alias("key"), "node", "size")
    shared = kept(keys.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("n")).where("n > 1").select("_key"), "near-shared")
    recurring = kept(keys.join(shared, F.col("key") == F.col("_key")).select("key", "node", "size"), "near-keys")
    release(nodes.sparkSession)
    can = (recurring.groupBy(F.col("node").alias("_node")).agg(F.count("*").alias("n"), F.first("size").alias("of"))
           .withColumn("least", _least_shared(F.col("of"), similarity)).where(F.col("n") >= F.col("least")).select("_node", "least"))
    able = kept(recurring.join(can, F.col("node") == F.col("_node")).select("key", "node", "size", "least"), "near-able")
    buckets = able.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("n"), F.min("node").alias("lo")).where("n > 1")
    members = kept(able.join(buckets, F.col("key") == F.col("_key")).select("key", "node", "size", "least", "n", "lo"), "near-members")
    forget(recurring)
    forget(able)
    hot = members.where(F.col("n") > PAIRED_BUCKET).groupBy(F.col("node").alias("_node")).agg(F.count("*").alias("hot"))
    return members.join(hot, F.col("node") == F.col("_node"), "left").withColumn("hot", F.coalesce("hot", F.lit(0))).drop("_node")


def _print_pairs(nodes: DataFrame) -> DataFrame:
    """Written: ``a, b``: nodes with the smallest node of their fingerprint, and of fingerprints that Golay keys link those nodes."""
    spark = nodes.sparkSession
    prints = kept(nodes.groupBy("fp").agg(F.min("node").alias("first")), "near-prints")
    mark = written()
    links = kept(close_links(prints), "near-print-links", lasting=True)
    sweep(spark, mark)
    own = prints.select(F.col("fp").alias("_fp"), "first")
    same = nodes.join(own, F.col("fp") == F.col("_fp")).select(F.col("first").alias("a"), F.col("node").alias("b")).where("a <> b")
    left = own.select(F.col("_fp").alias("_fa"), F.col("first").alias("_a"))
    right = own.select(F.col("_fp").alias("_fb"), F.col("first").alias("_b"))
    close = (links.join(left, F.col("a") == F.col("_fa")).join(right, F.col("b") == F.col("_fb"))
             .select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")))
    pairs = kept(same.unionByName(close), "near-pairs")
    forget(links)
    return pairs


def _stars(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``a, b``: every member of a bucket with the smallest node of all its buckets, if they are not connected yet."""
    stars = members.groupBy(F.col("node").alias("b")).agg(F.min("lo").alias("a")).where("a <> b")
    for end in ("a", "b"):
        known = roots.select(F.col("_node").alias(f"_{end}"), F.col("root").alias(f"root_{end}"))
        stars = stars.join(known, F.col(end) == F.col(f"_{end}"), "left")
    return stars.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _bucket_pairs(members: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: pairs of small buckets that are not connected yet and share enough keys.

    Two nodes may share keys in large buckets as well, at most as many as either has there.
    """
    small = (members.where(F.col("n") <= PAIRED_BUCKET).join(roots, F.col("node") == F.col("_node"), "left")
             .withColumn("root", F.coalesce("root", "node")))
    few = (small.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("node", "size", "least", "hot", "root"))).alias("m"),
                                    F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high"))
    x, at = F.col("x"), F.col("at")
    others = F.filter(F.slice("m", at + 2, F.size("m")), lambda y: (y["root"] != x["root"]) & (
        F.least(x["size"], y["size"]) >= F.lit(similarity - 1e-9) * F.greatest(x["size"], y["size"])))
    return (few.select("m", F.posexplode("m").alias("at", "x")).select("x", F.explode(others).alias("y"))
            .groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
            .agg(F.count("*").alias("shared"), F.first(F.greatest("x.least", "y.least")).alias("least"),
                 F.first(F.least("x.hot", "y.hot")).alias("hot"))
            .where(F.col("shared") + F.col("hot") >= F.col("least")).select("a", "b"))


def _prefix_length(size: Column, similarity: float) -> Column:
    """How many first hashes of a set meet those of every set of that similarity, in any common order."""
    # rounding may make a prefix longer, never shorter
    return size - F.ceil(F.lit(similarity - 1e-9) * size) + 1


def _by_frequency(sets: DataFrame, group: list[str]) -> DataFrame:
    """``node, shared``: the hashes of ``sets(node, hashes)`` that another set of the ``group`` has too, rarest first.

    One slice of the hashes goes after the other, so that only a slice is on its way at a time.
    """
    slices = []
    for i in range(HASH_SLICES):
        rows = sets.select("node", *group, F.explode(F.filter("hashes", lambda h: F.pmod(h, F.lit(HASH_SLICES)) == i)).alias("hash"))
        counts = rows.groupBy(F.col("hash").alias("_hash"), *[F.col(g).alias(f"_{g}") for g in group])
        common = kept(counts.agg(F.count("*").alias("n")).where("n > 1"), "near-common")
        release(sets.sparkSession)
        same = reduce(and_, [F.col(g) == F.col(f"_{g}") for g in ("hash", *group)])
        slices.append(kept(rows.join(common, same).select("node", "n", "hash"), "near-shared"))
        release(sets.sparkSession)
        forget(common)
    return (reduce(DataFrame.unionByName, slices).groupBy("node")
            .agg(F.array_sort(F.collect_list(F.struct("n", "hash"))).alias("shared")))


def _meeting(keys: DataFrame, group: list[str], open_if: str, wanted: Column, similarity: float) -> DataFrame:
    """``a, b``: pairs of ``keys`` that meet in a key, are not connected yet, fit in size and are ``wanted``.

    ``open_if`` says of a bucket's extremes whether there is something left to compare in it.
    """
    extremes = [f(c).alias(f"{name}_{c}") for c in ("root", "centre") for f, name in ((F.min, "low"), (F.max, "high"))]
    same = reduce(and_, [F.col(g) == F.col(f"_{g}") for g in ("key", *group)])
    open_ = kept(keys.groupBy(*[F.col(g).alias(f"_{g}") for g in ("key", *group)]).agg(*extremes).where(open_if)
                 .select("_key", *[f"_{g}" for g in group]), "near-open")
    left = kept(keys.join(open_, same, "left_semi"), "near-left")
    right = left.select(*[F.col(c).alias(f"_{c}") for c in left.columns])
    return (left.join(right, same)
            .where((F.col("node") < F.col("_node")) & (F.col("root") != F.col("_root")) & wanted
                   & (F.least("size", "_size") >= F.lit(similarity - 1e-9) * F.greatest("size", "_size")))
            .select(F.col("node").alias("a"), F.col("_node").alias("b")).distinct())


def _shared_pairs(crowd: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: pairs of ``crowd(node, hashes, centre, root)`` with different centres that can be of that similarity."""
    sized = _by_frequency(crowd, []).join(
        crowd.select(F.col("node").alias("_of"), F.size("hashes").alias("size"), "centre", "root"), F.col("node") == F.col("_of"))
    firsts = (sized.withColumn("alone", F.col("size") - F.size("shared"))
              .withColumn("left", (_prefix_length(F.col("size"), similarity) - F.col("alone")).cast("int")).where(F.col("left") > 0)
              .select("node", "size", "centre", "root", "alone",
                      F.posexplode(F.slice("shared", 1, F.col("left"))["hash"]).alias("at", "key")))
    # how many hashes a node has from this one on
    keys = kept(firsts.withColumn("rest", F.col("size") - F.col("alone") - F.col("at")).drop("alone", "at"), "near-prefixes")
    release(crowd.sparkSession)
    # all that two sets share lies from their first common hash on; at that one the rest of either must hold as much
    needed = F.lit(similarity / (1 + similarity) - 1e-9) * (F.col("size") + F.col("_size"))
    return _meeting(keys, [], "low_root <> high_root and low_centre <> high_centre",
                    (F.col("centre") != F.col("_centre")) & (F.least("rest", "_rest") >= needed), similarity)


def _twin_pairs(crowd: DataFrame, centres: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: pairs of ``crowd(node, hashes, centre, root)`` with the same centre that can be of that similarity.

    The sets differ in what just one of their differences from the centre holds. Where both differences
    together are small enough, either set is alike to the centre, and they are connected already. All other
    pairs must have part of their differences in common: near copies of one text share
    nearly all their hashes, but few of their differences.
    """
    base = centres.select(F.col("node").alias("_base"), F.col("hashes").alias("base"))
    apart = F.array_union(F.array_except("hashes", "base"), F.array_except("base", "hashes"))
    deltas = kept(crowd.join(base, F.col("centre") == F.col("_base"))
                  .select("node", "centre", "root", F.size("hashes").alias("size"), apart.alias("hashes")), "near-deltas")
    sized = _by_frequency(deltas, ["centre"]).join(
        deltas.select(F.col("node").alias("_of"), F.size("hashes").alias("apart"), "size", "centre", "root"), F.col("node") == F.col("_of"))
    # alike sets differ in so many hashes at most: by the size of one, and by both
    most = F.lit((1 - similarity) / similarity + 1e-9) * F.col("size")
    fewest = F.greatest(F.lit(1), F.ceil(F.col("apart") - most))
    firsts = (sized.withColumn("alone", F.col("apart") - F.size("shared"))
              .withColumn("left", (F.col("apart") - fewest + 1 - F.col("alone")).cast("int")).where(F.col("left") > 0)
              .select("node", "size", "centre", "root", "apart", "alone",
                      F.posexplode(F.slice("shared", 1, F.col("left"))["hash"]).alias("at", "key")))
    keys = kept(firsts.withColumn("rest", F.col("apart") - F.col("alone") - F.col("at")).drop("alone", "at"), "near-prefixes")
    release(crowd.sparkSession)
    differ = F.lit((1 - similarity) / (1 + similarity) + 1e-9) * (F.col("size") + F.col("_size"))
    needed = (F.col("apart") + F.col("_apart") - differ) / 2
    return _meeting(keys, ["centre"], "low_root <> high_root", F.least("rest", "_rest") >= needed, similarity)


def near_duplicates(rows: DataFrame, row: str, shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """``row, doc_id, group`` of every row; rows of near-duplicate documents share the group."""
    texts = rows.select("doc_id", F.col(row).alias("row"), "text")
    sets = kept(_shingle_sets(texts, shingle, similarity), "near-rows")
    # equal sets are one node: the smallest row that has the set
    nodes = kept(sets.groupBy("digest").agg(F.min("row").alias("node"), F.min("fp").alias("fp"), F.first("size").alias("size"), F.first("keys").alias("keys")), "near-nodes")
    sure = _alike(_print_pairs(nodes), texts, shingle, similarity)
    roots = kept(components(sure).withColumnRenamed("node", "_node"), "near-roots")
    members = kept(_members(nodes, similarity), "near-members")
    release(rows.sparkSession)
    links = sure.unionByName(_alike(kept(_stars(members, roots), "near-pairs"), texts, shingle, similarity))
    roots = kept(components(links).withColumnRenamed("node", "_node"), "near-roots")
    more = _alike(kept(_bucket_pairs(members, roots, similarity), "near-pairs"), texts, shingle, similarity)
    links = links.unionByName(more)
    roots = kept(components(links).withColumnRenamed("node", "_node"), "near-roots")
    release(rows.sparkSession)
    # large buckets in which not all are connected
    large = (members.where(F.col("n") > PAIRED_BUCKET).join(roots, F.col("node") == F.col("_node"), "left")
             .select("key", "node", F.coalesce("root", "node").alias("root")))
    open_ = large.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    unsettled = kept(large.join(open_, "key", "left_semi").select("node").distinct(), "near-unsettled")
    centre_of = members.groupBy("node").agg(F.min("lo").alias("centre"))
    placed = kept(unsettled.join(centre_of, "node").join(roots, F.col("node") == F.col("_node"), "left")
                  .select("node", "centre", F.coalesce("root", "node").alias("root")), "near-placed")
    # whole sets are written once, with the place of their node; centres that have none follow
    crowd = _hash_sets(texts, placed, shingle)
    far = placed.select(F.col("centre").alias("node")).distinct().join(placed.select(F.col("node").alias("_of")), F.col("node") == F.col("_of"), "left_anti")
    beside = _hash_sets(texts, far, shingle)
    release(rows.sparkSession)
    centres = crowd.select("node", "hashes").unionByName(beside)
    pairs = _twin_pairs(crowd, centres, similarity).unionByName(_shared_pairs(crowd, similarity))
    rest = _alike(kept(pairs, "near-pairs"), texts, shingle, similarity)
    forget(crowd)
    forget(beside)
    roots = kept(components(links.unionByName(rest)).withColumnRenamed("node", "_node"), "near-roots")
    named = nodes.select(F.col("digest").alias("_digest"), "node").join(roots, F.col("node") == F.col("_node"), "left")
    groups = named.select("_digest", F.coalesce("root", "node").alias("group"))
    return sets.select("doc_id", "row", "digest").join(groups, F.col("digest") == F.col("_digest")).select("row", "doc_id", "group")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one with the smallest id."""
    rows, row = numbered(docs, "near-rows")
    grouped = near_duplicates(rows, row, shingle, similarity)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row"))
    winner = fresh("_winner", rows.columns)
    winners = grouped.groupBy("group").agg(first.getField("row").alias(winner)).select(winner)
    return rows.join(winners, F.col(row) == F.col(winner), "left_semi").select(*docs.columns)
