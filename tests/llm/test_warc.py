"""Archives: round trip, revisits, index, damaged files."""

import gzip
import hashlib
import io
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loanloom.llm import warc
from loanloom.llm.queries import QUERIES


def brute(pages, least=1000):
    keeper = defaultdict(list)
    for page_id, html in pages:
        keeper[html or ""].append(page_id)
    out = []
    for page_id, html in pages:
        payload = (html or "").encode()
        ids = [i for i in keeper[html or ""] if i is not None]
        largest = max(ids) if ids and len(payload) >= least else None
        revisit = largest is not None and page_id != largest
        out.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", largest if revisit else None))
    return out


def key(row):
    return tuple((x is None, x) for x in row)


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_query_equals_brute_force(spark, folder):
    pages = [tuple(r) for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "html").collect()]
    found = QUERIES["op12_warc"](spark, folder)
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect())) == sorted(brute(pages))


BIG = "<p>café \U0001F600</p>\r\n\r\n" * 200
PAGES = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (2, "http://a/2", BIG), (7, None, BIG + "x"), (3, "", BIG + "x"),
         (4, "http://b c\r\nWARC-Type: evil", None), (5, "http://b/", ""), (None, "http://n/", BIG), (None, "http://n/", BIG + "lone"),
         (None, "http://n/", BIG + "lone"), (6, "u", "short"), (8, "u", "short"), (9, "u", "a" * 1000), (10, "u", "a" * 1000),
         (11, "u", "a" * 999), (12, "u", "a" * 999), (13, "u", "WARC/1.1\r\n\r\n" * 5 + "\x00"), (14, "u", "z" * 3_000_000)]


@pytest.fixture
def odd_pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns(
        {c: F.lit("x") for c in ("same", "keeper", "value", "offset", "joined", "payload")}).repartition(3, "page_id")


@pytest.mark.parametrize("hot", [1, 1000])
def test_odd_pages(odd_pages, monkeypatch, hot):
    """Copies that are looked up and copies that are joined."""
    monkeypatch.setattr(warc, "HOT_PAYLOADS", hot)
    found = warc.archived(odd_pages)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in found.collect()), key=key) == sorted(brute([(i, h) for i, _, h in PAGES]), key=key)
    payloads = {r["page_id"]: bytes(r["payload"]).decode() for r in found.where("record_type = 'response' and page_id is not null").collect()}
    assert payloads == {i: h or "" for i, _, h in PAGES if i in payloads} and payloads[14] == "z" * 3_000_000
    urls = {r["page_id"]: r["url"] for r in found.collect()}
    assert urls[4] == "http://b%20c%20WARC-Type:%20evil" and urls[7] == "urn:page:7" and urls[1] == "http://a/1"


def test_every_record_is_a_member_of_its_own(spark, odd_pages, tmp_path):
    streams, members = f"file://{tmp_path}/streams", f"file://{tmp_path}/members"
    warc.write_archives(warc.decide(odd_pages), streams)
    index = warc.normalise(spark, streams, members).collect()
    assert len(index) == len(PAGES) and sum(r["record_type"] == "revisit" for r in index) == sum(r[3] == "revisit" for r in brute([(i, h) for i, _, h in PAGES]))
    for archive in {r["archive"] for r in index}:
        rows = sorted((r for r in index if r["archive"] == archive), key=lambda r: r["offset"])
        data = open(archive.removeprefix("file:").replace("//", "/"), "rb").read()
        assert rows[0]["offset"] == 0 and sum(r["length"] for r in rows) == len(data)
        whole = b"".join(gzip.decompress(data[r["offset"]:r["offset"] + r["length"]]) for r in rows)
        source = archive.replace("/members/", "/streams/").replace(".warc.gz", ".txt.gz").removeprefix("file:").replace("//", "/")
        assert gzip.decompress(open(source, "rb").read()) == whole
        side = open(archive.removeprefix("file:").replace("//", "/") + ".idx").read().splitlines()
        assert [x.split("\t")[:2] for x in side] == [[str(r["offset"]), str(r["length"])] for r in rows]


def test_normalising_again_gives_the_same_bytes(spark, odd_pages, tmp_path):
    streams = f"file://{tmp_path}/streams"
    warc.write_archives(warc.decide(odd_pages), streams)
    digests = []
    for _ in range(2):
        warc.normalise(spark, streams, f"file://{tmp_path}/members")
        digests.append({f.name: hashlib.sha1(f.read_bytes()).hexdigest() for f in (tmp_path / "members").glob("*.gz")})
    assert digests[0] == digests[1] and not list((tmp_path / "members").glob("_*"))
    again = warc.normalise(spark, f"file://{tmp_path}/members", f"file://{tmp_path}/third")
    assert again.count() == len(PAGES)  # an archive that already has a member per record


def test_no_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archived(empty).count() == 0


def test_inflates_in_pieces(monkeypatch):
    monkeypatch.setattr(warc, "PIECE", 7)
    text = bytes(range(256)) * 50 + b"a" * 5000
    assert b"".join(warc.inflated(io.BytesIO(gzip.compress(text)), "x")) == text
    two = gzip.compress(text[:9000]) + gzip.compress(b"") + gzip.compress(text[9000:])
    assert b"".join(warc.inflated(io.BytesIO(two), "x")) == text
    assert max(map(len, warc.inflated(io.BytesIO(two), "x"))) <= 7
    with pytest.raises(ValueError, match="ends inside a gzip stream"):
        list(warc.inflated(io.BytesIO(gzip.compress(text)[:-9]), "x"))


def test_damaged_records_are_named():
    good = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert list(warc.split_records([good[:5], good[5:] + good], "x")) == [good, good]
    with pytest.raises(ValueError, match="x ends inside a record"):
        list(warc.split_records([good[:-3]], "x"))
    with pytest.raises(ValueError, match="x holds a record of wrong length"):
        list(warc.split_records([good.replace(b"3", b"2")], "x"))
