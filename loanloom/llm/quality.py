"""Quality rules with cross-document line frequency.

Counts of a text alone (words, symbols, repeated lines, repeated word windows) reject texts that
are too short or say the same thing again and again. Then lines are compared across documents:
normalised lines are hashed, and for every host the documents that have a line are counted, equal
texts once. A line that more than ``MAX_DOCUMENTS`` different documents of its host share is
boilerplate and removed; a document that loses more than ``MAX_LOST`` of its words is depleted and
rejected. ``judge`` tells counts and verdicts, ``clean`` returns the texts of all that is kept without
their boilerplate lines; both read the same removed lines.

Line counts are aggregated before they are shuffled, so a line that a third of all documents have
costs each task one row. The counts of one text are a small Python function per row.

Defined results: NULL text has no words and fails; NULL host is a host of its own; lines without a
word are not lines; a line that a document has twice counts once for it and loses its words twice;
rows that repeat id, host and text get equal answers. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from loanloom.llm.common import fresh, kept, numbered, ship

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
MAX_DOCUMENTS = 10
MAX_LOST = 0.5
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
SPAN = 3


def text_counts(text: str | None) -> dict[str, int]:
    """Counts of one text; words are runs of anything but the six blanks."""
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    seen: set[str] = set()
    repeated = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            repeated += line in seen
            seen.add(line)
    spans = [*zip(words, words[1:], words[2:], strict=False)]
    times = Counter(spans)
    inside, upto = 0, 0
    if len(times) < len(spans):
        for i, span in enumerate(spans):
            if times[span] > 1:
                inside += i + SPAN - max(i, upto)
                upto = i + SPAN
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(map(text.count, SYMBOLS)),
            "n_dup_lines": repeated, "n_repeat_words": inside}


def normal_lines(text: str | None) -> list[tuple[int, int, int]]:
    """Hash, number of words and place of every line with a word: lower case, digits as 0, single blanks."""
    import xxhash

    out = []
    for at, line in enumerate((text or "").lower().split("\n")):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", line) if w]
        if words:
            normal = re.sub(r"[0-9]", "0", " ".join(words))
            out.append((xxhash.xxh64_intdigest(normal.encode("utf-8", "surrogatepass")) - (1 << 63), len(words), at))
    return out


def counted(docs: DataFrame, *also: str) -> DataFrame:
    """``doc_id, source``, a hash of the text, the counts, the normalised lines and ``also`` of every row."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    line_type = pa.list_(pa.struct([("hash", pa.int64()), ("words", pa.int64()), ("at", pa.int64())]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = [text_counts(t) for t in texts]
            lines = pa.array([[{"hash": h, "words": n, "at": at} for h, n, at in normal_lines(t)] for t in texts], line_type)
            rest = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, *(pa.array([c[n] for c in counts], pa.int64()) for n in names), lines],
                [*rest.schema.names, *names, "lines"])

    ship(docs.sparkSession)
    rows = docs.select("doc_id", "source", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash"), "text", *also)
    schema = rows.drop("text").schema
    for name in names:
        schema = schema.add(name, "long")
    return rows.mapInArrow(count, schema.add("lines", ArrayType(StructType().add("hash", "long").add("words", "long").add("at", "long"))))


def _verdicts(docs: DataFrame, max_documents: int, max_lost: float, *also: str) -> DataFrame:
    """Counts, ``removed`` lines (place and words, in order) and verdict of every row, and ``also``."""
    rows = kept(counted(docs, *also), "quality-rows")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    lines = rows.select("source", "text_hash", F.explode("lines").alias("line")).select(
        "source", "text_hash", "line.hash", "line.words", "line.at")
    holders = lines.select("source", "hash", "text_hash").distinct()
    common = kept(holders.groupBy(F.col("source").alias("_source"), F.col("hash").alias("_hash")).agg(F.count("*").alias("n"))
                  .where(F.col("n") > max_documents).drop("n"), "quality-lines")
    # equal texts of a host lose equal lines
    removed = (lines.join(common, F.col("source").eqNullSafe(F.col("_source")) & (F.col("hash") == F.col("_hash")), "left_semi")
               .select("source", "text_hash", "at", "words").distinct()
               .groupBy(F.col("source").alias("_source"), F.col("text_hash").alias("_hash"))
               .agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("removed")))
    joined = rows.join(removed, F.col("source").eqNullSafe(F.col("_source")) & (F.col("text_hash") == F.col("_hash")), "left")
    words_lost = F.coalesce(F.aggregate("removed", F.lit(0).cast("long"), lambda n, line: n + line["words"]), F.lit(0))
    return joined.withColumns({"base_failed": base, "words_lost": words_lost}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("words_lost") <= max_lost * F.col("n_words")))


def judge(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, max_lost: float = MAX_LOST) -> DataFrame:
    """Counts and verdict of every row: ``base_failed``, ``words_lost``, ``kept``."""
    return _verdicts(docs, max_documents, max_lost).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "words_lost", "kept")


def clean(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, max_lost: float = MAX_LOST) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns, with texts without their boilerplate lines."""
    rows, row = numbered(docs, "quality-numbered")
    own, removed = fresh("_own", rows.columns), fresh("_removed", rows.columns)
    named = rows.select("doc_id", "source", "text", F.col(row).alias("_row"))
    found = _verdicts(named, max_documents, max_lost, "_row").where("kept").select(
        F.col("_row").alias(own), F.col("removed.at").alias(removed))
    text = F.array_join(F.filter(F.split("text", "\n"), lambda line, at: ~F.array_contains(F.col(removed), at.cast("long"))), "\n")
    return (rows.join(found, F.col(row) == F.col(own))
            .withColumn("text", F.when(F.col(removed).isNull(), F.col("text")).otherwise(text)).select(*docs.columns))


SQL = r"""
WITH worded AS (
  SELECT doc_id, source, text, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (
  SELECT doc_id, source, text, unnest(string_split(t, chr(10))) AS line FROM worded),
dups AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
spans AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS span FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM worded)),
twice AS (SELECT doc_id, i FROM spans QUALIFY count(*) OVER (PARTITION BY doc_id, span) > 1),
inside AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + j AS i FROM twice, (VALUES (0), (1), (2)) AS v(j)) GROUP BY doc_id),
normal AS (
  SELECT doc_id, source, text, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
         regexp_replace(array_to_string(regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+'), ' '), '[0-9]', '0', 'g') AS norm
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
common AS (SELECT source, norm FROM normal GROUP BY source, norm HAVING count(DISTINCT text) > 10),
lost AS (
  SELECT n.doc_id, sum(n.words) AS words_lost FROM normal n
  JOIN common c ON n.source IS NOT DISTINCT FROM c.source AND n.norm = c.norm GROUP BY n.doc_id),
counts AS (
  SELECT d.doc_id, len(d.w)::BIGINT AS n_words, length(array_to_string(d.w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(d.t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(u.n, 0)::BIGINT AS n_dup_lines,
         coalesce(i.n, 0)::BIGINT AS n_repeat_words, coalesce(l.words_lost, 0)::BIGINT AS words_lost
  FROM worded d LEFT JOIN dups u USING (doc_id) LEFT JOIN inside i USING (doc_id) LEFT JOIN lost l USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND words_lost <= 0.5::DOUBLE * n_words AS kept
FROM counts
"""
