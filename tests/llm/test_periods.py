"""Periodic runs against a search over all periods and places."""

import hashlib
import random

import numpy as np
import pytest

from loanloom.llm import periods
from loanloom.llm.queries import QUERIES, planted


def brute(words, least_words=6, least_times=4):
    """Runs by comparing the whole text with itself at every distance."""
    codes = np.unique(words, return_inverse=True)[1] if words else np.empty(0, int)
    found = {}
    for q in range(1, len(words) // least_times + 1):
        equal = np.concatenate(([0], (codes[:-q] == codes[q:]).astype(int), [0]))
        edges = np.diff(equal)
        for s, e in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)):
            if e - s + q >= max(least_words, least_times * q):
                found.setdefault((int(s), int(e - s + q)), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def expected(doc_id, text):
    words = planted(doc_id, (text or "").encode().split())
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    drop = set()
    for s, n, q in runs:
        drop.update(range(s + q, s + n))
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    sha = [hashlib.sha256(x).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode(), kept)]
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *sha)


def test_cover_meets_every_pair_of_remainders():
    assert {(a - b) % periods.PERIOD for a in periods.COVER for b in periods.COVER} == set(range(periods.PERIOD))
    for i in range(periods.PERIOD):
        for j in range(periods.PERIOD):
            step = periods.STEPS[i, j]
            assert {(i + step) % periods.PERIOD, (j + step) % periods.PERIOD} <= set(periods.COVER)


@pytest.mark.parametrize("seed", range(40))
def test_random_texts(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(rng.randint(1, 12)):
        letters = [b"a", b"b", b"c"][:rng.randint(1, 3)] if rng.random() < 0.6 else [b"%d" % i for i in range(50)]
        words = [rng.choice(letters) for _ in range(rng.choice((0, 1, 5, 6, 7, 30, 200, 700)))]
        if rng.random() < 0.5 and words:
            piece = words[:rng.randint(1, max(1, len(words) // 3))]
            words += piece * rng.randint(2, 9) + words[:3]
        texts.append(words)
    assert [[tuple(r) for r in runs.tolist()] for runs in periods.find_runs(texts)] == [brute(t) for t in texts]


def test_common_prefixes():
    rng = random.Random(5)
    texts = [[b"%d" % rng.randint(0, 1) for _ in range(400)], [b"x"] * 300, [b"%d" % (i % 37) for i in range(500)]]
    words = periods._numbered_words(texts)
    lookup = periods.CommonPrefixes(words)
    a, b = (np.array(x) for x in zip(*((i, j) for i in range(0, len(words) - 1, 3) for j in (i + 1, i + 31, i + 37, i + 200) if j < len(words))))
    def shared(i, j):
        n = 0
        while j + n < len(words) and words[i + n] == words[j + n]:
            n += 1
        return n
    assert lookup(a, b).tolist() == [shared(i, j) for i, j in zip(a, b)]


def test_blocks_of_places(monkeypatch):
    texts = [[b"a", b"b", b"c"] * 50, [b"z"] * 41]
    whole = [r.tolist() for r in periods.find_runs(texts)]
    monkeypatch.setattr(periods, "PLACES_AT_ONCE", 5)
    assert [r.tolist() for r in periods.find_runs(texts)] == whole == [[[0, 150, 3]], [[0, 41, 1]]]


def test_query_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    found = QUERIES["op13_periodic_runs"](spark, folder)
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, found.collect())) == sorted(expected(*d) for d in docs)


def test_odd_documents(odd):
    found = periods.periodic_runs(odd, runs_as="w", collapsed_as="group")
    assert found.count() == odd.count() and set(found.columns) == set(odd.columns) - {"text"}
    for row in found.collect():
        assert row["row"] == "x" and row["group"] is not None
    by_id = {r["doc_id"]: r for r in found.collect()}
    assert [tuple(r) for r in by_id[11]["w"]] == [(0, 40, 1)] and by_id[11]["group"] == "x"
    assert by_id[3]["w"] == [] and by_id[3]["group"] == ""
    assert [r for r in found.collect() if r["doc_id"] == 1][0] == [r for r in found.collect() if r["doc_id"] == 1][1]


def test_no_documents(nothing):
    assert periods.periodic_runs(nothing).count() == 0


def test_a_word_is_split_at_ascii_blanks_only(spark):
    text = "a b " * 8 + "\x1c"
    row = periods.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 8, 1)] and row["collapsed"] == "a b \x1c"
