"""The pipeline stage by stage against brute force."""

from collections import Counter

import corpus_pipeline
import numpy as np
from tokenizers import Tokenizer

from loanloom.llm import mixing, simhash
from loanloom.llm.common import kept
from test_lines_mix_quality import brute_lines


def staged(spark, docs, folder):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(kept(stage(spark, out[-1], folder), name, lasting=True))
    return out


def test_stages_against_brute_force(spark, documents, folder):
    start, spoken, lined, single, mixed, packed = staged(spark, documents, folder)
    assert all(df.columns == documents.columns for df in (spoken, lined, single, mixed))
    # language: only texts without any language go
    gone = {r["doc_id"] for r in start.collect()} - {r["doc_id"] for r in spoken.collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in start.collect()}
    assert all(len(texts[i]) < 60 for i in gone) and len(gone) <= 0.02 * len(texts)
    # lines
    rows = spoken.orderBy("doc_id").collect()
    want = dict(zip((r["doc_id"] for r in rows), brute_lines([r["text"] for r in rows]), strict=True))
    got = {r["doc_id"]: r for r in lined.collect()}
    assert {i: r["text"] for i, r in got.items()} == {i: t for i, t in want.items() if t.split() or t == texts[i]}
    assert all(r["n_chars"] == len(r["text"]) for i, r in got.items() if r["text"] != texts[i])
    # near duplicates: links of 0.8 and more, the smallest id of each group stays
    sets = {i: set(simhash.shingle_hashes(r["text"], 5).tolist()) for i, r in got.items()}
    left = {r["doc_id"] for r in single.collect()}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                assert not {a, b} <= left
    assert len(left) >= 0.9 * len(got)
    # mix
    plan = {r["doc_id"]: r["times"] for r in mixing.mix_plan(single).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == +Counter(plan)
    # pack: every taken document, whole
    tokenizer = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path(corpus_pipeline.TOKENIZER))
    tokenizer.encode_special_tokens = True
    tokens = Counter()
    for p in packed.collect():
        tokens[p["doc_id"]] += len(np.frombuffer(p["ids"], dtype="<u4"))
    assert tokens == Counter({i: n * (len(tokenizer.encode(got[i]["text"], add_special_tokens=False).ids) + 1) for i, n in plan.items() if n})


def test_odd_and_empty_tables_run_through(spark, odd, nothing, folder):
    for docs in (odd, nothing):
        stages = staged(spark, docs, folder)
        assert all(df.columns == docs.columns for df in stages[:-1])
        assert docs is odd or stages[-1].count() == 0


def test_run_is_the_stages(spark, documents, folder):
    last = staged(spark, documents, folder)[-1]
    pieces = lambda df: Counter((r["doc_id"], r["doc_tokens"]) for r in df.where("start = 0").collect())
    assert pieces(corpus_pipeline.run(spark, folder)) == pieces(last)
