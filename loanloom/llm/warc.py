"""Web archives: write pages as WARC, rewrite whole-stream gzip archives record by record, read them back.

``write_archives`` stores each partition as one archive that is a single gzip stream, the shape in
which many crawls arrive and in which no record can be reached without inflating all before it.
``normalise`` inflates every such file once, front to back in small pieces, writes every record as a
gzip member of its own, and leaves a sidecar ``<archive>.idx`` that says where each member lies. A
reader then opens one record by seeking. ``read_records`` does so for every line of the index.

Equal payloads of at least ``least_bytes`` are stored once, as the record of the largest page id;
the others are ``revisit`` records that name it. Payloads are compared by SHA-256 and length. Which
payloads have copies is counted without their texts; those that hold more than one in
``HOT_PAYLOADS`` of the pages, fewer than ``HOT_PAYLOADS``, are looked up, all others are joined.

Archives lie in the shared folder and are written through a temporary name, so a task that runs
again replaces its file by the same bytes. Folders are opened by ``pyarrow.fs``.

Defined results: NULL html is an empty payload. NULL page ids are smaller than any other; copies of
which no page has an id are all responses. Rows that repeat the largest page id are responses, each
with its payload. A NULL or empty URL is written as the page's ``urn:`` name; runs of blanks and control
characters in a URL are written as ``%20``. An empty table
gives archives without records. Other columns are not read. A very long page is one record; a record
is held in memory, an archive never is. A damaged archive raises an error that names it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha1
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from loanloom.llm.common import kept, shared_folder, ship

LEAST_BYTES = 1000
HOT_PAYLOADS = 1000
RECORDS_PER_FILE = 20_000
PIECE = 1 << 20
LEVEL = 6
GZIP = 16 + zlib.MAX_WBITS
DATE = "1970-01-01T00:00:00Z"
END = "\r\n"
# ---- fixed values: names of the format (ISO 28500)
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
                   ("record_type", pa.string()), ("record_id", pa.string())])
FOUND = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("url", pa.string()),
                   ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def decide(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``page_id, url, html, payload_bytes, payload_digest, refers_to``; ``refers_to`` is NULL for responses."""
    html = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select("page_id", "url", html.alias("html")).withColumns({
        "payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha1("html"),
        "same": F.when(F.octet_length("html") >= least_bytes, F.unhex(F.sha2("html", 256)))})
    copies = kept(own.where(F.col("same").isNotNull()).groupBy("same", "payload_bytes")
                  .agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies"))
                  .where((F.col("copies") > 1) & F.col("keeper").isNotNull()), "warc-copies")
    rows = pages.count()
    much = F.col("copies") * HOT_PAYLOADS > rows
    key = ["same", "payload_bytes"]
    # fewer than HOT_PAYLOADS rows
    hot = F.broadcast(copies.where(much).select(*key, F.col("keeper").alias("hot_keeper")))
    cold = copies.where(~much).select(*key, F.col("keeper").alias("cold_keeper"))
    looked_up = own.join(hot, key, "left")
    # payloads that were looked up have no partner here and must not meet in one task
    spread = F.when(F.col("hot_keeper").isNull(), F.col("same"))
    apart = F.when(spread.isNull(), F.xxhash64("page_id", "url")).otherwise(0)
    found = looked_up.withColumns({"joined": spread, "apart": apart}).join(
        cold.select(F.col("same").alias("joined"), "payload_bytes", F.lit(0).cast("long").alias("apart"), "cold_keeper"),
        ["joined", "payload_bytes", "apart"], "left")
    keeper = F.coalesce("hot_keeper", "cold_keeper")
    return found.select("page_id", "url", "html", "payload_bytes", "payload_digest",
                        F.when(F.col("page_id").isNull() | (F.col("page_id") < keeper), keeper).alias("refers_to"))


def _name(page_id: Column) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")))


def records(decided: DataFrame, date: str = DATE) -> DataFrame:
    """One WARC record a row in the column ``value``, without the two line ends that close it."""
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    http = F.concat_ws(END, F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"),
                       F.concat(F.lit("Content-Length: "), F.col("payload_bytes").cast("string")), F.lit(""), F.lit(""))
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]+", "%20")
    own = _name(F.col("page_id"))
    head = F.concat_ws(
        END, F.lit(VERSION), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <"), own, F.lit(">")), F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.when(F.length(url) > 0, url).otherwise(own)),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <"), _name(F.col("refers_to")), F.lit(">"))),
        F.when(revisit, F.lit(f"WARC-Profile: {SAME_PAYLOAD}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.octet_length(body)).cast("string")), F.lit(""), F.lit(""))
    return decided.select(F.concat(head, http, body).alias("value"))


def write_archives(decided: DataFrame, folder: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Every partition as archives of a single gzip stream each, with at most ``records_per_file`` records."""
    (records(decided).write.option("compression", "gzip").option("lineSep", END * 2)
     .option("maxRecordsPerFile", records_per_file).mode("overwrite").text(folder))


def inflated(file, path: str) -> Iterator[bytes]:
    """The bytes of a gzip file in small pieces, whether it is one stream or many members."""
    stream = None
    while data := file.read(PIECE):
        while data:
            stream = stream or zlib.decompressobj(GZIP)
            yield stream.decompress(data, PIECE)
            stream, data = (None, stream.unused_data) if stream.eof else (stream, stream.unconsumed_tail)
    while stream and (rest := stream.decompress(b"", PIECE)):
        yield rest
    if stream and not stream.eof:
        raise ValueError(f"{path} ends inside a gzip stream")


def split_records(pieces: Iterator[bytes], path: str) -> Iterator[bytes]:
    """Whole records, each with the two line ends that close it."""
    held, need, pieces = bytearray(), None, iter(pieces)
    while True:
        if need is None and (at := held.find(b"\r\n\r\n")) >= 0:
            need = at + 4 + int(fields(bytes(held[:at]))["content-length"]) + 4
        if need is not None and len(held) >= need:
            if held[need - 4:need] != b"\r\n\r\n":
                raise ValueError(f"{path} holds a record of wrong length")
            yield bytes(held[:need])
            del held[:need]
            need = None
            continue
        piece = next(pieces, None)
        if piece is None:
            break
        held += piece
    if held:
        raise ValueError(f"{path} ends inside a record")


def fields(head: bytes) -> dict[str, str]:
    """Named fields of a record's head, names in lower case."""
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def normalise(spark: SparkSession, folder: str, target: str) -> DataFrame:
    """Rewrite every archive of ``folder`` with a member per record; returns the index, written.

    Columns ``archive, offset, length, record_type, record_id``.
    """
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                yield from _rewritten(path, target)

    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path")
    return kept(files.mapInArrow(rewrite, from_arrow_schema(INDEX)), "warc-index")


def _rewritten(path: str, target: str) -> Iterator[pa.RecordBatch]:
    store, source = fs.FileSystem.from_uri(path)
    place, home = fs.FileSystem.from_uri(target)
    place.create_dir(home, recursive=True)
    archive = path.rsplit("/", 1)[1].removesuffix(".gz").removesuffix(".txt") + ".warc.gz"
    draft = f"{home}/_{uuid4().hex}"
    entries, offset = [], 0
    with store.open_input_stream(source, compression=None) as file, place.open_output_stream(draft, compression=None) as out:
        for record in split_records(inflated(file, path), path):
            packer = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
            member = packer.compress(record) + packer.flush()
            out.write(member)
            named = fields(record[:record.find(b"\r\n\r\n")])
            entries.append({"archive": f"{target}/{archive}", "offset": offset, "length": len(member),
                            "record_type": named["warc-type"], "record_id": named["warc-record-id"]})
            offset += len(member)
    with place.open_output_stream(f"{draft}.idx", compression=None) as out:
        out.write("".join("\t".join(str(e[c]) for c in INDEX.names[1:]) + "\n" for e in entries).encode())
    place.move(f"{draft}.idx", f"{home}/{archive}.idx")
    place.move(draft, f"{home}/{archive}")
    yield pa.RecordBatch.from_pylist(entries, schema=INDEX)


def read_records(index: DataFrame) -> DataFrame:
    """Open every record at its place in the archive.

    ``record_type, record_id, refers_to, url, payload_bytes, payload_digest, payload``: length and digest
    of a response are those of the payload found, which must be the ones its head states; those of a
    revisit, which has no payload of its own, are the ones its head states.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file, rows, size = None, None, [], 0
        for batch in batches:
            for archive, offset, length in zip(*(column.to_pylist() for column in batch.columns)):
                if archive != path:
                    store, source = fs.FileSystem.from_uri(archive)
                    path, file = archive, store.open_input_file(source)
                file.seek(offset)
                record = zlib.decompress(file.read(length), GZIP)
                rows.append(_parsed(record, path))
                size += len(record)
                if size > PIECE:
                    yield pa.RecordBatch.from_pylist(rows, schema=FOUND)
                    rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=FOUND)

    ship(index.sparkSession)
    return index.select("archive", "offset", "length").mapInArrow(read, from_arrow_schema(FOUND))


def _parsed(record: bytes, path: str) -> dict:
    at = record.find(b"\r\n\r\n") + 4
    head, block = fields(record[:at - 4]), record[at:-4]
    body = block.find(b"\r\n\r\n") + 4
    stated = int(fields(block[:body - 4])["content-length"])
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    revisit = head["warc-type"] == "revisit"
    payload = None if revisit else block[body:]
    if not revisit and (len(payload), sha1(payload).hexdigest()) != (stated, digest):
        raise ValueError(f"{path}: the payload of {head['warc-record-id']} is not the one its head states")
    return {"record_type": head["warc-type"], "record_id": head["warc-record-id"], "refers_to": head.get("warc-refers-to"),
            "url": head["warc-target-uri"], "payload_bytes": stated, "payload_digest": digest, "payload": payload}


def _address(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme of its store."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def archived(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write all pages, normalise the archives, read every record back through the index.

    Columns of ``read_records`` with ``page_id`` and ``refers_to`` as page ids.
    """
    spark = pages.sparkSession
    home = _address(spark, f"{shared_folder(spark)}/loanloom-llm/{spark.sparkContext.applicationId}/warc-{uuid4().hex}")
    write_archives(decide(pages, least_bytes), f"{home}/streams")
    found = read_records(normalise(spark, f"{home}/streams", f"{home}/members"))
    kind = pages.schema["page_id"].dataType

    def page(name):
        return F.nullif(F.regexp_extract(name, r"^<urn:page:(.*)>$", 1), F.lit("")).cast(kind)

    return found.select(page("record_id").alias("page_id"), "url", "payload_bytes", "payload_digest", "record_type",
                        page("refers_to").alias("refers_to"), "payload")
