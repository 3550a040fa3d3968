"""Mix sources to target weights by weighted fair queueing.

Every source gets a target number of words. Its documents are shuffled, and each one gets a
virtual finish time: the words its source has handed out once it is through, divided by the
source's target. All documents are then taken in order of finish time until the word budget is
spent. A source may be read more than once; a second reading continues its clock.

Nothing is sorted as a whole. Documents of a source are cut into shuffle ranges that are
cumulated on their own, and the virtual clock is cut into slices whose word totals show which
slice holds the end of the budget; only that slice is put in order.

Defined results: NULL text has size 0; documents without a word are never taken; NULL source is
a source of its own and comes last; rows that repeat an id are documents of their own, ordered by
size (equal ones are interchangeable); no document or no word at all gives targets of 0. Only the
named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanloom.llm.common import fresh, kept, numbered, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
# rows cumulated in one window
ROWS_PER_RANGE = 10_000


def shuffle_key(doc_id: Column) -> Column:
    """60 bits of the MD5 of the id: an order that any engine can draw again."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
                   repeats: int = REPEATS) -> DataFrame:
    """Target words per source. ``sizes``: one row per source with ``source, source_size, docs``.

    Sources get the weights in code-point order. The budget is ``share`` of all words; a target
    stops at ``repeats`` times the source, and what it can't take is shared again by weight. With
    sources in order of limit / weight that is one level: the first source whose limit is not
    below its share of what remains, and every later one, get ``level * weight``.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name)).withColumns({
        "weight": F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                               (F.col("rank") - 1) % len(weights) + 1).cast("long"),
        "budget": F.lit(share) * F.coalesce(F.sum("source_size").over(everything), F.lit(0)),
        "limit": F.col("source_size") * repeats})
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    before, rest = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing)
    level = ((F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0)).cast("double"))
             / F.sum("weight").over(rest).cast("double"))
    stepped = ranked.withColumn("own_level", level)
    full = F.col("limit").cast("double") < F.col("own_level") * F.col("weight")
    shared = F.max(F.when(~full, F.col("own_level"))).over(everything)
    return stepped.withColumn("target", F.when(full, F.col("limit").cast("double"))
                              .otherwise(shared * F.col("weight"))).select(
        "source", "source_size", "docs", "rank", "weight", "budget", "target")


def _placed(docs: DataFrame, keys: Sequence[str], weights, share, repeats) -> DataFrame:
    """Every document with the words its source hands out before it is through (``cum``)."""
    sized = kept(docs.select(*keys, "source", word_count(F.col("text")).alias("size"),
                             shuffle_key(F.col("doc_id")).alias("shuffle")), "mix-sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    targets = source_targets(sizes, weights, share, repeats).withColumns({
        "ranges": F.ceil(F.col("docs") / ROWS_PER_RANGE),
        "slices": F.ceil(F.sum("docs").over(Window.partitionBy()) * repeats / ROWS_PER_RANGE)})
    joined = sized.join(targets.withColumnRenamed("source", "_source"),
                        F.col("source").eqNullSafe(F.col("_source")))
    # the key is uniform, so equal parts of its range hold about equally many documents
    cut = joined.withColumn("range", F.floor(F.col("shuffle") / F.lit(2.0 ** 60) * F.col("ranges")))
    inside = Window.partitionBy("rank", "range").orderBy("shuffle", *keys, "size")
    local = cut.withColumn("_local", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    across = Window.partitionBy("rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (cut.groupBy("rank", "range").agg(F.sum("size").alias("_words"))
              .select("rank", "range", F.coalesce(F.sum("_words").over(across), F.lit(0)).alias("_start")))
    placed = local.join(starts, ["rank", "range"])
    return kept(placed.select(*keys, "source", "size", "source_size", "rank", "target", "budget", "slices",
                              (F.col("_start") + F.col("_local")).alias("cum")), "mix-placed")


def _readings(repeats: int) -> Column:
    """One entry per reading of a document: finish time and words handed out by its source."""
    spent = [F.col("source_size") * i + F.col("cum") for i in range(repeats)]
    return F.array(*[F.struct((s.cast("double") / F.col("target")).alias("finish"), F.col("rank"),
                              s.alias("spent")) for s in spent])


def _end(placed: DataFrame, repeats: int) -> DataFrame:
    """One row: the last reading the budget pays for, as ``struct(finish, rank, spent)``."""
    entries = (placed.where("size > 0").select("size", "budget", "slices", F.explode(_readings(repeats)).alias("at"))
               # sources beyond four budgets of virtual time share the last slice
               .withColumn("slice", F.least(F.floor(F.col("at.finish") * F.col("slices")), 4 * F.col("slices"))))
    order = Window.orderBy("slice")
    totals = entries.groupBy("slice").agg(F.sum("size").alias("words"), F.max("at").alias("at"), F.first("budget").alias("budget"))
    sums = totals.withColumn("upto", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = sums.where("upto <= budget").select("at")
    partial = (sums.where("upto > budget").orderBy("slice").limit(1)
               .select("slice", (F.col("upto") - F.col("words")).alias("start")))
    inside = Window.partitionBy("slice").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    paid = (entries.join(partial, "slice").withColumn("running", F.col("start") + F.sum("size").over(inside))
            .where("running <= budget").select("at"))
    return whole.unionByName(paid).agg(F.max("at").alias("end"))


def _taken(docs: DataFrame, keys: Sequence[str], weights, share, repeats) -> DataFrame:
    placed = _placed(docs, keys, weights, share, repeats)
    end = _end(placed, repeats).scalar()
    times = F.size(F.filter(_readings(repeats), lambda at: at <= F.col("_end"))).cast("long")
    return (placed.withColumn("_end", end)
            .withColumn("times", F.when((F.col("size") > 0) & F.col("_end").isNotNull(), times).otherwise(F.lit(0))))


def mix_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
             repeats: int = REPEATS) -> DataFrame:
    """How often each document is taken: ``doc_id, source, size, source_size, target, times, taken``."""
    return _taken(docs, ["doc_id"], weights, share, repeats).select(
        "doc_id", "source", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """The mixed corpus itself: every row of ``docs`` as often as it is taken, same columns."""
    rows, row = numbered(docs, "mix-rows")
    plan = _taken(rows.select("doc_id", "source", "text", F.col(row).alias("row")), ["doc_id", "row"], weights, share, repeats)
    taken, copy = fresh("_taken", rows.columns), fresh("_copy", rows.columns)
    times = plan.where("times > 0").select(F.col("row").alias(taken), F.sequence(F.lit(1), "times").alias(copy))
    # as many rows as documents: never to be broadcast
    return rows.join(times.hint("merge"), F.col(row) == F.col(taken)).withColumn(copy, F.explode(copy)).select(*docs.columns)


SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15) AS shuffle
  FROM documents),
ranked AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3, 1, 2][(rank - 1) % 3 + 1] AS weight, 1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE AS budget,
         source_size * 2 AS lim FROM ranked),
stepped AS (
  SELECT *, (budget - coalesce(sum(lim) OVER (ORDER BY lim::DOUBLE / weight, rank
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(weight) OVER (ORDER BY lim::DOUBLE / weight, rank
                                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS own_level
  FROM weighed),
targets AS (
  SELECT *, CASE WHEN lim::DOUBLE < own_level * weight THEN lim::DOUBLE
                 ELSE max(own_level) FILTER (WHERE lim::DOUBLE >= own_level * weight) OVER () * weight END AS target
  FROM stepped),
placed AS (
  SELECT s.*, t.source_size, t.rank, t.target, t.budget,
         sum(s.size) OVER (PARTITION BY t.rank ORDER BY s.shuffle, s.doc_id, s.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
readings AS (
  SELECT doc_id, source, size, source_size, rank, target, budget, reading,
         reading * source_size + cum AS spent, (reading * source_size + cum)::DOUBLE / target AS finish
  FROM placed, (VALUES (0), (1)) AS r(reading)),
queue AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, spent ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
  FROM readings WHERE size > 0),
taken AS (SELECT doc_id, source, sum(size) AS taken FROM queue WHERE running <= budget GROUP BY doc_id, source)
SELECT p.doc_id, p.size::BIGINT AS size, p.source_size::BIGINT AS source_size, p.target,
       coalesce(t.taken, 0)::BIGINT AS taken
FROM placed p LEFT JOIN taken t ON p.doc_id = t.doc_id AND p.source IS NOT DISTINCT FROM t.source
"""
