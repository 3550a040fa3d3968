"""Delete runs of lines that occurred before, found by winnowing over line hashes.

Lines with a word are hashed. Of every window of two neighbouring lines the smaller hash is its
fingerprint, so equal windows have equal fingerprints at equal places, wherever they are.
Fingerprints that occur at one position only are dropped; the windows around the others are
compared by 128 bits and joined with the first occurrence of the same window. A later occurrence is
extended both ways, from window to window, as long as the next pair of lines occurred before too. A
run found so is deleted if it has ``MIN_LINES`` worded lines or ``MIN_WORDS`` words. A line of
``MIN_WORDS`` words is a run of its own, and a document of fewer than ``MIN_LINES`` worded lines is
one as a whole: it goes if an earlier document has just the same ones.

No pair of occurrences is ever formed: each joins its first occurrence only, and counting is
aggregated before it is shuffled. Neighbouring pairs of a run may have occurred in different places.

Defined results: order is by id (NULL last), then by row, then by line, so of rows that repeat
the first keeps its lines; lines are compared without blanks at their ends; lines without a word
are skipped and go only inside a deleted run; a repeat within a document counts; NULL text stays
NULL; a document may end up empty. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanloom.llm.common import WORD, fresh, kept, numbered

MIN_LINES = 3
MIN_WORDS = 50
# what a window covers
PAIR, LINE, DOCUMENT = 0, 1, 2


def text_lines(text: Column) -> Column:
    """Array of lines; empty for NULL."""
    return F.coalesce(F.split(text, "\n"), F.array().cast("array<string>"))


def _windows(text: Column, min_lines: int, min_words: int) -> Column:
    """Windows of one text: what they cover, fingerprint, its line, first and last line, 128 bits of
    content, number among the worded lines, words of the first and of the last line."""
    def entry(line, at):
        bare = F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
        return F.struct(at.alias("at"), F.xxhash64(bare).alias("h"), F.xxhash64(F.lit(1), bare).alias("g"),
                        F.regexp_count(bare, F.lit(WORD)).alias("words"))

    def window(covers, mark, mark_at, first, last, h, g, nth):
        return F.struct(F.lit(covers).alias("covers"), mark.alias("mark"), mark_at.alias("mark_at"), first["at"].alias("first"),
                        last["at"].alias("last"), h.alias("h"), g.alias("g"), nth.cast("int").alias("nth"),
                        first["words"].alias("words"), last["words"].alias("tail"))

    lines = F.filter(F.transform(text_lines(text), entry), lambda line: line["words"] > 0)

    def over(lines):
        def pair(i):
            one, two = F.get(lines, i), F.get(lines, i + 1)
            # equal hashes: the last one, so that a constant stretch has few fingerprints
            least = F.least(*[F.struct(line["h"].alias("h"), (-line["at"]).alias("at")) for line in (one, two)])
            return window(PAIR, least["h"], -least["at"], one, two, F.xxhash64(one["h"], two["h"]), F.xxhash64(one["g"], two["g"]), i)

        longs = F.transform(F.filter(lines, lambda line: line["words"] >= min_words), lambda line: window(
            LINE, line["h"], line["at"], line, line, line["h"], line["g"], F.lit(0)))
        # hashes of a whole document start with its kind, so they never meet those of a line or a pair
        ends = F.get(lines, F.lit(0)), F.get(lines, F.size(lines) - 1)
        h = F.aggregate(lines, F.xxhash64(F.lit("document h")), lambda seen, line: F.xxhash64(seen, line["h"]))
        g = F.aggregate(lines, F.xxhash64(F.lit("document g")), lambda seen, line: F.xxhash64(seen, line["g"]))
        whole = F.when(F.size(lines).between(1, min_lines - 1), F.array(window(DOCUMENT, h, ends[0]["at"], *ends, h, g, F.lit(0))))
        pairs = F.when(F.size(lines) > 1, F.transform(F.sequence(F.lit(0), F.size(lines) - 2), pair))
        none = F.slice(longs, 1, 0)
        return F.concat(F.coalesce(pairs, none), longs, F.coalesce(whole, none))

    # bound once, used several times
    return F.flatten(F.transform(F.array(lines), over))


def repeated_runs(rows: DataFrame, row: str, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``row`` and its runs to delete: sorted, disjoint ``struct(first, last)`` line numbers."""
    windows = kept(rows.select(F.col("doc_id"), F.col(row).alias("row"),
                               F.explode(_windows(F.col("text"), min_lines, min_words)).alias("w"))
                   .select("doc_id", "row", "w.*"), "line-windows")
    place = F.struct("row", "mark_at")
    marks = kept(windows.groupBy("mark").agg(F.min(place).alias("a"), F.max(place).alias("b"))
                 .where("a <> b").select(F.col("mark").alias("_mark")), "line-marks")
    shared = windows.join(marks, F.col("mark") == F.col("_mark"), "left_semi")
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row", "first")
    firsts = kept(shared.groupBy("h", "g").agg(F.min(order).alias("origin"), F.count("*").alias("n"))
                  .where("n > 1").select(F.col("h").alias("_h"), F.col("g").alias("_g"), "origin"), "line-firsts")
    later = (windows.join(firsts, (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g")))
             .where(order > F.col("origin")).select("row", "covers", "nth", "first", "last", "words", "tail"))
    # extend: pairs that share a line belong to one run
    along = Window.partitionBy("row").orderBy("covers", "nth", "first")
    previous = F.lag(F.struct("covers", "nth")).over(along)
    goes_on = (F.col("covers") == PAIR) & (previous["covers"] == PAIR) & (previous["nth"] == F.col("nth") - 1)
    chained = (later.withColumn("opens", F.when(goes_on, F.lit(0)).otherwise(F.lit(1)))
               .withColumn("run", F.sum("opens").over(along.rowsBetween(Window.unboundedPreceding, 0))))
    found = (chained.groupBy("row", "run").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.max("covers").alias("covers"), F.count("*").alias("pairs"),
        (F.sum("words") + F.max_by("tail", "last")).alias("words"))
        .where((F.col("covers") != PAIR) | (F.col("pairs") + 1 >= min_lines) | (F.col("words") >= min_words)))
    # merge what overlaps or touches
    by_line = Window.partitionBy("row").orderBy("first", "last")
    before = F.max("last").over(by_line.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("opens", F.when(F.col("first") <= before + 1, F.lit(0)).otherwise(F.lit(1)))
    runs = (marked.withColumn("run", F.sum("opens").over(by_line.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("row", "run").agg(F.min("first").alias("first"), F.max("last").alias("last")))
    return runs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def _without(text: Column, runs: Column) -> Column:
    """Text without the lines of its runs: the stretches between them, put together."""
    def rest(lines):
        def gap(run, i):
            start = F.when(i > 0, F.get(runs, i - 1)["last"] + 1).otherwise(F.lit(0))
            return F.slice(lines, start + 1, run["first"] - start)

        tail = F.get(runs, F.size(runs) - 1)["last"] + 1
        return F.concat(F.flatten(F.transform(runs, gap)), F.slice(lines, tail + 1, F.size(lines) - tail))

    return F.array_join(F.flatten(F.transform(F.array(text_lines(text)), rest)), "\n")


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, *, runs_as: str | None = None) -> DataFrame:
    """``docs`` with shortened texts; ``runs_as`` names an extra column with the deleted runs."""
    rows, row = numbered(docs, "line-rows")
    found = repeated_runs(rows, row, min_lines, min_words)
    own, runs = fresh("_own", rows.columns), runs_as or fresh("_runs", rows.columns)
    joined = rows.join(found.select(F.col("row").alias(own), F.col("runs").alias(runs)), F.col(row) == F.col(own), "left")
    text = F.when(F.col(runs).isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col(runs)))
    return joined.withColumn("text", text).select(*docs.columns, *([runs] if runs_as else []))


SQL = r"""
WITH lines AS (
  SELECT doc_id, i - 1 AS pos, string_split(text, chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
worded AS (
  SELECT doc_id, pos, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM worded),
pairs AS (
  SELECT doc_id, nth, pos AS p, lead(pos) OVER w AS q, words + lead(words) OVER w AS words, lead(words) OVER w AS tail,
         [line, lead(line) OVER w] AS content
  FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
repeated AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, p) AS copy FROM pairs WHERE q IS NOT NULL)
  WHERE copy > 1),
chains AS (
  SELECT doc_id, min(p) AS p, max(q) AS q, count(*) + 1 AS lines, sum(words) - sum(tail) + arg_max(tail, nth) AS words
  FROM (SELECT *, nth - row_number() OVER (PARTITION BY doc_id ORDER BY nth) AS chain FROM repeated) GROUP BY doc_id, chain),
long_lines AS (
  SELECT doc_id, pos AS p, pos AS q FROM worded WHERE words >= 50
  QUALIFY row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) > 1),
wholes AS (
  SELECT doc_id, p, q FROM (SELECT doc_id, min(pos) AS p, max(pos) AS q, list(line ORDER BY pos) AS content, count(*) AS lines
                            FROM worded GROUP BY doc_id) WHERE lines < 3
  QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id) > 1),
later AS (
  SELECT doc_id, p, q FROM chains WHERE lines >= 3 OR words >= 50
  UNION ALL SELECT * FROM long_lines UNION ALL SELECT * FROM wholes),
removed AS (SELECT DISTINCT doc_id, unnest(range(p, q + 1)) AS pos FROM later),
counted AS (SELECT doc_id, count(*) AS n_removed FROM removed GROUP BY doc_id),
texts AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text
  FROM lines l ANTI JOIN removed r ON l.doc_id = r.doc_id AND l.pos = r.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(c.n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(t.text, '')) END AS kept_sha256
FROM documents d LEFT JOIN counted c ON d.doc_id = c.doc_id LEFT JOIN texts t ON d.doc_id = t.doc_id
"""
