"""Operators beyond SQL against brute force, round trips and held-out accuracy."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import xxhash
from cases import lines
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loanloom.llm import common, fingerprints, golay, lang_id, packing, queries, simhash, suffix_dedup
from loanloom.llm.components import components

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def brute_substrings(texts, length=suffix_dedup.LENGTH):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                covered[i:i + length] = True
        spans = int((covered[1:] & ~covered[:-1]).sum() + covered[0])
        out.append((len(t), int(covered.sum()), spans, hashlib.sha256(bytes(b for b, c in zip(t, covered) if not c)).hexdigest()))
    return out


def digests(found):
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("r"), F.size("spans"), F.sha2("kept", 256))


def test_substrings_against_brute_force(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip((r["doc_id"] for r in rows), brute_substrings([(r["text"] or "").encode() for r in rows]), strict=True))
    got = {r[0]: tuple(r)[1:5] for r in queries.QUERIES["op2_suffix_dedup"](spark, folder).collect()}
    assert got == want


def test_substrings_at_the_edges(spark, odd, nothing):
    rng = random.Random(5)
    letters = "".join(rng.choice("abcdefgh") for _ in range(3000))
    texts = [letters[:200], letters[:199], "x" + letters[:200] + "y", letters[100:420], letters[121:319], "a" * 450, "é" * 120,
             letters[1000:1400] + "-" + letters[1000:1400], letters[2000:2201], letters[2001:2203], None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r[0]: tuple(r)[1:] for r in digests(suffix_dedup.dedup_substrings(docs)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_substrings([(t or "").encode() for t in texts])
    want = brute_substrings([(r["text"] or "").encode() for r in odd.select("text").collect()])
    assert sorted(tuple(r)[1:] for r in digests(suffix_dedup.dedup_substrings(odd)).collect()) == sorted(want)
    assert suffix_dedup.dedup_substrings(nothing).count() == 0


def test_levels_merge_like_a_binary_counter(spark):
    levels = suffix_dedup.SuffixLevels()
    shapes = []
    for i in range(5):
        levels.add(spark.createDataFrame([(7, 1), (100 + i, i), (50, i)], "key long, region long"))
        shapes.append([size for size, _ in levels.levels])
    assert shapes == [[1], [2], [2, 1], [4], [4, 1]]
    assert {tuple(r) for r in levels.repeated().collect()} == {(7, False), (50, True)}


def test_packing_round_trip(odd, nothing, documents):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    for docs in (odd.select("doc_id", "text", "ids"), documents):
        pieces = packing.pack(docs, PATH, PATTERN, window=64).collect()
        stream = defaultdict(dict)
        for p in pieces:
            ids = np.frombuffer(p["ids"], dtype="<u4")
            assert len(ids) == p["length"] and p["offset"] + p["length"] <= 64
            stream[p["sequence_id"]][p["offset"]] = (ids, p)
        texts, lengths = Counter(), []
        flat = []
        for s in sorted(stream):
            at = 0
            for offset in sorted(stream[s]):
                ids, p = stream[s][offset]
                assert offset == at
                at += len(ids)
                flat.append((p["doc_id"], p["start"], p["doc_tokens"], ids))
            lengths.append(at)
        assert sorted(stream) == list(range(len(stream))) and all(n == 64 for n in lengths[:-1])
        current = []
        for doc_id, start, total, ids in flat:
            assert start == len(current)
            current += ids.tolist()
            if len(current) == total:
                texts[(doc_id, tuple(current))] += 1
                current = []
        want = Counter((r["doc_id"], (*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0)) for r in docs.select("doc_id", "text").collect())
        assert current == [] and texts == want
    assert packing.pack(nothing, PATH, PATTERN).count() == 0


def test_both_libraries_give_the_same_ids():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    rng, encoder = random.Random(3), packing.Encoder(PATH, PATTERN)
    pools = [(0, 0x24F), (0x370, 0x3000), (0x3000, 0xD7FF), (0xE000, 0x10FFFF), (9, 13), (32, 32)]
    texts = ["".join(chr(rng.randint(*rng.choice(pools))) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["a<|endoftext|>b", "ab" * 5000]
    for text, ids in zip(texts, encoder(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_added_tokens_keep_their_id(spark):
    tokenizer = Tokenizer.from_file(PATH)
    texts = ["a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> \n<|endoftext|><|endoftext|>", "no such token", "<|endoftext |>", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: np.frombuffer(r["ids"], dtype="<u4").tolist() for r in packing.pack(docs.coalesce(1), PATH, PATTERN).collect()}
    assert got == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    assert 50256 in got[0]


def test_held_out_languages(spark, folder, documents):
    out = queries.QUERIES["op4_language_id"](spark, folder).join(documents.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in out if r["held_out"] and len(r["text"] or "") > 40]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_bundles_are_sums_of_bound_letters():
    texts = ["Abba, abba!", "\u4f60\u597d", "abba 12 abba"]
    got = lang_id.bundles(texts, np.array([0, 1, 2]), 3, 64)
    spelled = [" abba abba ", " \u4f60\u597d ", " abba abba "]
    for row, text in zip(got, spelled, strict=True):
        v = [lang_id.letter_vector(ord(c), 64).astype(int) for c in text]
        assert (row == sum(np.roll(a, 2) * np.roll(b, 1) * c for a, b, c in zip(v, v[1:], v[2:]))).all()


def test_odd_languages(odd, nothing):
    out = lang_id.identify(odd).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in out if r["doc_id"] in (3, 4, 5, 10))
    assert lang_id.identify(nothing).count() == 0


def test_golay_keys_cover_two_errors():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 3000)
    flips = np.array([rng.choice(23, rng.integers(0, 3), replace=False) for _ in words], dtype=object)
    near = np.array([w ^ sum(1 << int(b) for b in f) for w, f in zip(words, flips, strict=True)])
    keys, theirs = defaultdict(set), defaultdict(set)
    for out, source in ((keys, words), (theirs, near)):
        for place, key in zip(*golay.neighbour_keys(source), strict=True):
            out[place].add(key)
    assert all(keys[i] & theirs[i] for i in range(len(words))) and max(map(len, keys.values())) <= 6


def brute_components(prints):
    fps = sorted(set(prints.values()))
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    first = {}
    for doc_id, f in prints.items():
        first[root(f)] = min(doc_id, first.get(root(f), doc_id))
    return {doc_id: first[root(f)] for doc_id, f in prints.items()}


def brute_print(text):
    words = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_brute_force(spark, folder, documents):
    prints = {r["doc_id"]: brute_print(r["text"]) for r in documents.collect()}
    want = brute_components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.QUERIES["op7_simhash_golay"](spark, folder).collect()}
    assert got == {d: (f"{f:016x}", want[d]) for d, f in prints.items()}


def test_large_buckets_are_linked_exactly(spark):
    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for b in base for _ in range(250)} | {0, 3, 7, 1 << 63}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.close_links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    want = brute_components(dict(zip(signed, [f % (1 << 64) for f in signed], strict=True)))
    groups = lambda m: {frozenset(g) for g in _inverse(m).values() if len(g) > 1}
    assert groups({f: roots.get(f, f) for f in signed}) == groups(want)


def _inverse(mapping):
    out = defaultdict(set)
    for k, v in mapping.items():
        out[v].add(k)
    return out


def test_chain_components(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5)]
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert roots == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1100)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_documents_in_simhash(odd, nothing):
    out = simhash.simhash_components(odd).collect()
    assert len(out) == odd.count()
    assert {r["component_id"] for r in out if r["doc_id"] in (3, 4, 5)} == {3}
    assert {r["component_id"] for r in out if r["doc_id"] in (1, 2, 13)} == {1}
    assert simhash.simhash_components(nothing).count() == 0


def test_near_duplicates_recall(documents):
    rows = documents.withColumn("_row", F.col("doc_id"))
    group = {r["row"]: r["group"] for r in simhash.near_duplicates(rows, "_row").collect()}
    sets = {r["doc_id"]: set(simhash.shingle_hashes(r["text"], 5).tolist()) for r in documents.collect()}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert pairs and all(group[a] == group[b] for a, b in pairs)
    # and nobody is in a group without a link
    linked = {x for pair in pairs for x in pair} | {i for i in sets if not sets[i]}
    sizes = Counter(group.values())
    assert all(sizes[group[i]] == 1 for i in sets if i not in linked)


def test_one_of_each_group_stays(odd, nothing):
    out = simhash.keep_one(odd)
    ids = Counter(r["doc_id"] for r in out.select("doc_id").collect())
    assert out.columns == odd.columns and ids[1] == 1 and ids[2] == 0 and ids[13] == 0 and ids[6] == 1 and ids[3] == 1 and ids[4] == 0
    assert ids[7] == 1 and ids[8] == 0
    assert simhash.keep_one(nothing).count() == 0


def _altered(rng, n, changed):
    """A text of ``n`` words of its own, and one with ``changed`` of them replaced, far apart."""
    words = [f"w{rng.randrange(10**9)}" for _ in range(n)]
    other = list(words)
    for i in range(changed):
        other[i * n // changed + 2] = f"x{rng.randrange(10**9)}"
    return " ".join(words), " ".join(other)


def test_long_pairs_are_verified_on_all_shingles(spark):
    rng = random.Random(17)
    # of 996 shingles 23 x 5 or 21 x 5 change: similarities just below and just above 0.8
    texts = [t for changed in (23, 21) for _ in range(40) for t in _altered(rng, 1000, changed)]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    likeness = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert all(0.78 < x < 0.8 for x in likeness[:40]) and all(0.8 <= x < 0.82 for x in likeness[40:])
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    left = {r["doc_id"] for r in simhash.keep_one(rows).select("doc_id").collect()}
    assert all({2 * i, 2 * i + 1} <= left for i in range(40))
    assert all(2 * i in left and 2 * i + 1 not in left for i in range(40, 80))


@pytest.mark.parametrize("bucket", [2, simhash.PAIRED_BUCKET])
def test_no_pair_is_lost_among_hot_passages(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "PAIRED_BUCKET", bucket)
    rng = random.Random(23)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    hot = [new(200) for _ in range(3)]
    texts = []
    for i in range(150):
        own = new(60)
        texts.append([*hot[i % 3], *own])
        if i % 5 == 0:
            # same passage and own words, but for a few at the end
            texts.append([*hot[i % 3], *own[:40], *new(20)])
    sets = [set(simhash.shingle_hashes(" ".join(t), 5).tolist()) for t in texts]
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    rows = spark.createDataFrame([(i, i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, _row long, text string").repartition(3)
    group = {r["row"]: r["group"] for r in simhash.near_duplicates(rows, "_row").collect()}
    assert len(pairs) == 30 and len(set(group.values())) == 150
    assert all(group[i] == group[j] for i, j in pairs)


def test_few_pairs_among_copies_a_little_less_alike(spark):
    # copies of one text with 3 to 5 of 300 words replaced: most pairs are just below 0.8
    rng = random.Random(29)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(120):
        words = list(base)
        for i in rng.sample(range(300), rng.choice((3, 4, 4, 4, 5))):
            words[i] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(words))
    sets = [np.unique(simhash.shingle_hashes(t, 5).view(np.int64)) for t in texts]
    alike = {(i, j) for j in range(len(sets)) for i in range(j)
             if (n := len(np.intersect1d(sets[i], sets[j]))) >= 0.8 * (len(sets[i]) + len(sets[j]) - n)}
    # all measured from the first; the pairs it connects need no comparison
    near = {i for i in range(1, len(sets)) if (0, i) in alike}
    crowd = spark.createDataFrame([(i, s.tolist(), 0, 0 if i in near else i) for i, s in enumerate(sets)],
                                  "node long, hashes array<long>, centre long, root long")
    found = {(r["a"], r["b"]) for r in simhash._twin_pairs(crowd, crowd, 0.8).collect()}
    open_ = {(i, j) for i, j in alike if i and not {i, j} <= near}
    assert len(alike) > 100 and len(open_) > 20 and open_ <= found
    # pairs whose differences touch the same places are left, a good third here
    assert len(found) < 0.4 * len(sets) * (len(sets) - 1) / 2
    # with centres of their own, the other way finds the same
    apart = crowd.withColumn("centre", F.col("node")).withColumn("root", F.col("node"))
    assert alike <= {(r["a"], r["b"]) for r in simhash._shared_pairs(apart, 0.8).collect()}
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id long, _row long, text string")
    group = {r["row"]: r["group"] for r in simhash.near_duplicates(rows, "_row").collect()}
    assert all(group[i] == group[j] for i, j in alike)
    linked = {i for pair in alike for i in pair}
    assert all(Counter(group.values())[group[i]] == 1 for i in range(len(sets)) if i not in linked)


def brute_sketch(spark, texts):
    words = [[w for w in _parts(t)] for t in texts]
    flat = sorted({w for ws in words for w in ws})
    codes = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in flat], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    return [[codes[w] for w in ws] for ws in words]


def _parts(text):
    import re
    return re.findall(r"[^\x20\x09-\x0D]{1,16}", text or "")


def test_closed_syncmers(spark):
    texts = [lines(1, 3), "one two three", "", None, "x" * 50, lines(1, 3) + " more words here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = [r["a"] for r in docs.select("i", fingerprints.anchors(F.col("text")).alias("a")).orderBy("i").collect()]
    k, s = fingerprints.K, fingerprints.S
    for anchors, hashes in zip(got, brute_sketch(spark, texts), strict=True):
        places = [a["at"] for a in anchors]
        if len(hashes) < k:
            assert places == ([0] if hashes else [])
            continue
        pairs = [(h, *hashes[i + 1:i + s]) for i, h in enumerate(hashes[:len(hashes) - s + 1])]
        inner = {r["i"]: r["h"] for r in spark.createDataFrame([(i, list(p)) for i, p in enumerate(pairs)], "i int, p array<bigint>")
                 .select("i", F.xxhash64(F.col("p")[0], F.col("p")[1]).alias("h")).collect()}
        want = [i for i in range(len(hashes) - k + 1) if min(range(i, i + k - s + 1), key=inner.get) in (i, i + k - s)]
        assert places == want
        assert all(b - a <= k - s + 1 for a, b in zip(places, places[1:], strict=False))
    assert [a["hash"] for a in got[0]] == [a["hash"] for a in got[5]][:len(got[0])]


def test_successors_and_edits(spark, odd, nothing, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    out = {r["doc_id"]: r for r in queries.QUERIES["op8_syncmer_fingerprints"](spark, folder).collect()}
    assert len(out) == len(docs)
    texts = [d["text"] or "" for d in docs]
    for i, d in enumerate(docs):
        text, following = texts[i], texts[(i + 1) % len(docs)]
        half = len(text) // 2
        r = out[d["doc_id"]]
        assert r["edited_sha256"] == hashlib.sha256((text[:len(text) - half] + following[:half]).encode()).hexdigest()
        assert r["n_chars"] == len(text) and 0 <= r["near_edited"] <= 1
    far = [r for r in out.values() if r["n_chars"] > 400]
    assert sum(r["near_edited"] > r["near_next"] for r in far) >= 0.9 * len(far)
    pairs = fingerprints.edited_pairs(odd).collect()
    assert len(pairs) == odd.count()
    assert len({r["fingerprint"] for r in pairs if r["doc_id"] in (1, 2)}) == 1
    assert fingerprints.edited_pairs(nothing).count() == 0
    assert fingerprints.edited_pairs(odd.where("doc_id = 7")).first()["near_next"] == 1


def test_near_duplicates_start_from_golay_keys(spark, monkeypatch):
    # no pair but those of fingerprints is compared
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(simhash, "_stars", lambda *_: none)
    monkeypatch.setattr(simhash, "_bucket_pairs", lambda *_: none)
    rng = random.Random(31)
    texts = [t for _ in range(30) for t in _altered(rng, 600, 1)]
    prints = [simhash.majority(simhash.shingle_hashes(t, 5)) for t in texts]
    close = {i for i in range(0, 60, 2) if ((prints[i] ^ prints[i + 1]) & (1 << 64) - 1).bit_count() <= 2}
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id long, _row long, text string")
    group = {r["row"]: r["group"] for r in simhash.near_duplicates(rows, "_row").collect()}
    assert len(close) >= 5 and {i for i in range(0, 60, 2) if group[i] == group[i + 1]} == close


def test_whole_sets_of_the_last_search_are_written_once(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRED_BUCKET", 4)
    written, kept = [], simhash.kept

    def noted(df, name, **options):
        stored = kept(df, name, **options)
        written.append((name, [r["node"] for r in stored.select("node").collect()] if "hashes" in stored.columns else []))
        return stored

    monkeypatch.setattr(simhash, "kept", noted)
    rng = random.Random(17)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(400)]
    texts = []
    for _ in range(24):
        words = list(base)
        for at in rng.sample(range(400), 20):
            words[at] = f"x{rng.randrange(10 ** 6)}"
        texts.append(" ".join(words))
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id long, _row long, text string")
    simhash.near_duplicates(rows, "_row").collect()
    names = [name for name, _ in written]
    sets = [n for _, nodes in written[names.index("near-placed"):names.index("near-deltas")] for n in nodes]
    assert len(sets) > 4 and len(sets) == len(set(sets))


def test_python_takes_small_pieces_of_large_batches():
    whole = pa.RecordBatch.from_pydict({"text": [f"t{i}" for i in range(1234)]})
    parts = list(common.pieces(iter([whole, whole.slice(0, 0), whole.slice(7, 1)])))
    assert max(p.num_rows for p in parts) <= common.BATCH_ROWS
    assert [t for p in parts for t in p.column("text").to_pylist()] == [f"t{i}" for i in [*range(1234), 7]]


def test_hash_sets_keep_what_is_known_of_their_nodes(spark):
    texts = spark.createDataFrame([(i, f"a b c d e {i}") for i in range(1100)], "row long, text string").coalesce(1)
    wanted = spark.range(5, 1100).select(F.col("id").alias("node"), (F.col("id") * 2).alias("centre"))
    got = {r["node"]: (r["centre"], r["hashes"]) for r in simhash._hash_sets(texts, wanted, 5).collect()}
    assert got == {i: (2 * i, np.unique(simhash.shingle_hashes(f"a b c d e {i}", 5).view(np.int64)).tolist()) for i in range(5, 1100)}
