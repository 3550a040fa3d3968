"""Alignment of two tokenizers against a plain count over the whole corpus."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loanloom.llm import cross_tokens
from loanloom.llm.packing import _spelled_bytes
from loanloom.llm.queries import QUERIES

FILES = cross_tokens.Vocabularies(P.path("byte_bpe_50k.json"), P.PATTERN, P.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def plain():
    """Tokens of both sides with their bytes, by the libraries alone."""
    a = Tokenizer.from_file(FILES.a_file)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=FILES.b_file)
    spelled = _spelled_bytes()

    def tokens(text):
        if not text:
            return [], []
        left = [(i, bytes(spelled[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            right.append((i, bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") and b.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        if b"".join(x for _, x in left) != whole or b"".join(x for _, x in right) != whole:
            return [], []
        return left, right
    return tokens


def ends(tokens):
    out, at = {}, 0
    for place, (i, spelled) in enumerate(tokens):
        at += len(spelled)
        out[at] = (place, i)
    return out


def brute(rows, tokens):
    documents, counts = [], Counter()
    for doc_id, text in rows:
        left, right = tokens(text)
        by_a, by_b = ends(left), ends(right)
        cuts = sorted(by_a.keys() & by_b.keys())
        links = [(by_a[c][1], by_b[c][1]) for c in cuts]
        counts.update(links)
        groups, i, j = [], 0, 0
        for c in cuts:
            groups.append(",".join(str(x) for x, _ in left[i:by_a[c][0] + 1]) + "|" + ",".join(str(x) for x, _ in right[j:by_b[c][0] + 1]))
            i, j = by_a[c][0] + 1, by_b[c][0] + 1
        documents.append((doc_id, len(left), len(right), links, ";".join(groups)))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(doc_id, n_a, n_b, len(links), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), groups)
            for doc_id, n_a, n_b, links, groups in documents]


def key(row):
    return tuple((x is None, x) for x in row)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def test_query_equals_brute_force(spark, folder, plain):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    found = QUERIES["op11_token_alignment"](spark, folder)
    assert found.columns == [*COLUMNS, "groups_sha256"]
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in brute(rows, plain)]
    assert sorted(map(tuple, found.collect())) == sorted(want)


@pytest.mark.parametrize("hot", [1, 40, cross_tokens.HOT_PAIRS])
def test_odd_documents(spark, odd, plain, monkeypatch, hot):
    """With every way for irregular pairs: all joined, some looked up, all looked up."""
    monkeypatch.setattr(cross_tokens, "HOT_PAIRS", hot)
    odd = odd.select("doc_id", "text", "row", "n").union(spark.createDataFrame([
        (20, "<|endoftext|> and <unk> <s>", "x", "x"), (21, "a ▁ mark", "x", "x"), (22, " two  blanks\r\n\t\x00 ​", "x", "x"),
        (23, "你好世界 " * 30 + "\U0001F600́", "x", "x"), (24, "   ", "x", "x")],
        "doc_id long, text string, row string, n string"))
    found = cross_tokens.align(odd, FILES)
    assert found.documents.columns == [*COLUMNS, "groups"]
    want = brute([tuple(r) for r in odd.select("doc_id", "text").collect()], plain)
    assert sorted(map(tuple, found.documents.collect()), key=key) == sorted(want, key=key)
    assert [r for r in want if r[0] == 21][0][1:7] == (0,) * 6


def test_pairs_are_the_irregular_links(spark, odd, plain):
    found = cross_tokens.align(odd, FILES)
    irregular = Counter()
    for _, text in odd.select("doc_id", "text").collect():
        left, right = plain(text)
        by_a, by_b = ends(left), ends(right)
        irregular.update((by_a[c][1], by_b[c][1]) for c in by_a.keys() & by_b.keys() if left[by_a[c][0]][1] != right[by_b[c][0]][1])
    assert {(r["a"], r["b"]): r["count"] for r in found.pairs.collect()} == irregular


def test_no_documents(nothing):
    found = cross_tokens.align(nothing, FILES)
    assert found.documents.count() == 0 and found.pairs.count() == 0


def test_slices_hold_every_row(monkeypatch):
    monkeypatch.setattr(cross_tokens, "CHARS_AT_ONCE", 10)
    monkeypatch.setattr(cross_tokens, "ROWS_AT_ONCE", 3)
    texts = ["abc", None, "", "x" * 50, "abc", "d", "e", "f", "g"]
    assert [t for part in cross_tokens._slices(texts) for t in texts[part]] == texts
    assert max(part.stop - part.start for part in cross_tokens._slices(texts)) <= 3
    assert slice(3, 4) in list(cross_tokens._slices(texts))
