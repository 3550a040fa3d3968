"""Periodic runs of words: every stretch that repeats a period four times or more, found exactly.

How far two places of a text agree is answered in constant time by a difference cover: of every
``PERIOD`` places only those whose remainder is in ``COVER`` are sampled, and any two places meet
sampled ones after the same few steps. Only the sampled suffixes are sorted; neighbours in that order
get their common prefix, and a sparse table of minima answers for any two of them. A query compares
words until both places are sampled, then looks up the rest.

A run of period q repeats words q apart over at least 3 q places, so a grid with steps of 3 q meets
it; over all periods the grid is harmonic: n log n / 3 places. From a grid place that agrees with the
one q later the run is extended right by the text and left by the reversed text. A stretch found
under several periods has the smallest of them.

Documents are worked on a few at a time as one sequence in which each has words of its own and an
end of its own, so no agreement crosses documents; grid places are worked in blocks of bounded size.

Defined results: NULL and empty texts have no words, no run and an empty collapsed text. A very long
text is searched whole. Ties cannot arise: a stretch is reported once. Repeated rows and rows
without id are searched each on its own; an empty table gives no row. Other columns are passed through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StringType, StructField, StructType

from loanloom.llm.common import fresh, ship

# a perfect difference cover: every remainder is a difference of two of these, and only once
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
LEAST_WORDS = 6
LEAST_TIMES = 4
WORDS_AT_ONCE = 200_000
PLACES_AT_ONCE = 1_000_000
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

Rewrite = Callable[[object, list[bytes]], list[bytes]]


def _steps() -> np.ndarray:
    """For two remainders the steps after which both are in the cover."""
    sampled = np.isin(np.arange(PERIOD), COVER)
    step = np.arange(PERIOD)
    both = sampled[(step[:, None, None] + step[None, :, None]) % PERIOD] & sampled[(step[:, None, None] + step[None, None, :]) % PERIOD]
    return both.argmax(axis=0)


STEPS = _steps()


class CommonPrefixes:
    """How many words two places of a sequence share, by a sorted difference-cover sample.

    Every document of ``words`` ends in a word that occurs nowhere else.
    """

    def __init__(self, words: np.ndarray):
        self.words = words
        self.places = np.flatnonzero(np.isin(np.arange(len(words)) % PERIOD, COVER))
        self.number = np.full(len(words), -1, dtype=np.int64)
        self.number[self.places] = np.arange(len(self.places))
        levels = self._sorted()
        self.rank = levels[-1]
        order = np.argsort(self.rank)
        self.minima = [self._neighbours(order, levels)]
        width = 1
        while 2 * width <= len(self.minima[0]):
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def _sorted(self) -> list[np.ndarray]:
        """Ranks of the samples by their first PERIOD words, then by twice as many, until all differ.

        Equal ones share the rank of the first. Only samples that are still equal are sorted again.
        """
        rank = np.zeros(len(self.places), dtype=np.int64)
        tied = np.arange(len(self.places))
        for step in range(PERIOD):
            tied = self._refined(rank, tied, self.words[self.places[tied] + step])
            if not len(tied):
                return [rank]
        levels, size = [rank], PERIOD
        while len(tied):
            rank = levels[-1].copy()
            tied = self._refined(rank, tied, levels[-1][self.number[self.places[tied] + size]])
            levels.append(rank)
            size *= 2
        return levels

    @staticmethod
    def _refined(rank: np.ndarray, tied: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Order equal samples by a further key, in place; returns those that are equal still."""
        order = np.lexsort((key, rank[tied]))
        tied, key = tied[order], key[order]
        old = rank[tied]
        at = np.arange(len(tied))
        new_group = np.concatenate(([True], old[1:] != old[:-1]))
        new_value = new_group | np.concatenate(([True], key[1:] != key[:-1]))
        first_of_group = np.maximum.accumulate(np.where(new_group, at, 0))
        first_of_value = np.maximum.accumulate(np.where(new_value, at, 0))
        rank[tied] = old + first_of_value - first_of_group
        alone = new_value & np.concatenate((new_value[1:], [True]))
        return tied[~alone]

    def _neighbours(self, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefix of each sampled suffix and the next in order."""
        a, b = self.places[order[:-1]], self.places[order[1:]]
        shared = np.zeros(len(a), dtype=np.int64)
        live = np.arange(len(a))
        for level in range(len(levels) - 1, -1, -1):
            equal = levels[level][self.number[a[live] + shared[live]]] == levels[level][self.number[b[live] + shared[live]]]
            shared[live[equal]] += PERIOD << level
        return self._compared(a, b, shared, PERIOD)

    def _compared(self, a: np.ndarray, b: np.ndarray, shared: np.ndarray, most: int | np.ndarray) -> np.ndarray:
        """Add equal words from ``shared`` on, ``most`` of them at the utmost."""
        live, stop = np.arange(len(a)), shared + most
        while len(live):
            live = live[shared[live] < stop[live]]
            live = live[self.words[a[live] + shared[live]] == self.words[b[live] + shared[live]]]
            shared[live] += 1
        return shared

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words shared from places ``a`` and ``b`` on; the places of a pair differ."""
        steps = STEPS[a % PERIOD, b % PERIOD]
        shared = self._compared(a, b, np.zeros(len(a), dtype=np.int64), steps)
        full = np.flatnonzero(shared == steps)
        left, right = (self.rank[self.number[x[full] + steps[full]]] for x in (a, b))
        left, right = np.minimum(left, right), np.maximum(left, right)
        level = np.frexp((right - left).astype(np.float64))[1] - 1
        for k in np.unique(level):
            these = level == k
            low = self.minima[k]
            shared[full[these]] += np.minimum(low[left[these]], low[right[these] - (1 << int(k))])
        return shared


def _numbered_words(texts: Sequence[list[bytes]]) -> np.ndarray:
    """Numbers of words; no document shares one with another, and each ends in one of its own."""
    out, base = [], 0
    for words in texts:
        known: dict[bytes, int] = {}
        out.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) + base)
        base += len(known)
        out.append(np.array([base], dtype=np.int64))
        base += 1
    return np.concatenate(out)


def _grid(starts: np.ndarray, sizes: np.ndarray, least_times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of grid places with their periods: all documents, all periods that fit often enough."""
    held, count = [], 0
    for period in range(1, int(sizes.max(initial=0)) // least_times + 1):
        step = (least_times - 1) * period
        fits = sizes >= least_times * period
        places = (sizes[fits] - period - 1) // step + 1
        first = np.repeat(starts[fits], places)
        nth = np.arange(len(first)) - np.repeat(np.cumsum(places) - places, places)
        held.append((first + nth * step, np.full(len(first), period, dtype=np.int64)))
        count += len(first)
        if count >= PLACES_AT_ONCE:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, count = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def find_runs(texts: Sequence[list[bytes]], least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> list[np.ndarray]:
    """Per text the runs as rows ``start, length, period``, by start, then period."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    words = _numbered_words(texts)
    found, ahead, behind = [], None, None
    for place, period in _grid(starts, sizes, least_times):
        agree = words[place] == words[place + period]
        place, period = place[agree], period[agree]
        if not len(place):
            continue
        if ahead is None:
            ahead, behind = CommonPrefixes(words), CommonPrefixes(_reversed(words, starts, sizes))
        right = ahead(place, place + period)
        # place i of a document stands at size - 1 - i of its reversed text
        document = np.searchsorted(starts, place, side="right") - 1
        mirror = 2 * starts[document] + sizes[document] - 1 - place
        left = behind(mirror, mirror - period)
        length = left + right - 1 + period
        good = length >= np.maximum(least_words, least_times * period)
        found.append(np.stack([document, place - left + 1 - starts[document], length, period], axis=1)[good])
    rows = np.concatenate(found) if found else np.empty((0, 4), dtype=np.int64)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.concatenate(([True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1))) if len(rows) else np.empty(0, dtype=bool)
    rows = rows[first]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    edges = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
    return [rows[s:e, 1:] for s, e in zip(edges[:-1], edges[1:])]


def _reversed(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Every document read backwards; ends stay where they are."""
    document = np.repeat(np.arange(len(sizes)), sizes + 1)
    at = np.arange(len(words))
    back = 2 * starts[document] + sizes[document] - 1 - at
    return words[np.where(back < starts[document], at, back)]


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by single spaces."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0))


def _few_at_once(batch: pa.RecordBatch, rewrite: Rewrite | None) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Words of a few rows of a batch, with the number of the first; a very long text is alone."""
    start, texts, count = 0, [], 0
    ids = batch.column(0).to_pylist()
    for i, text in enumerate(batch.column(1).to_pylist()):
        words = (text or "").encode().split()  # at the six ASCII blanks only
        words = rewrite(ids[i], words) if rewrite else words
        if texts and count + len(words) > WORDS_AT_ONCE:
            yield start, texts
            start, texts, count = i, [], 0
        texts.append(words)
        count += len(words)
    if texts:
        yield start, texts


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None, runs_as: str = "runs", collapsed_as: str = "collapsed") -> DataFrame:
    """Documents with the array ``runs`` of ``start, length, period`` (word numbers) and the ``collapsed`` text.

    ``rewrite`` may change the words of a document, given its id, before they are searched.
    """
    whole, key, text = (fresh(name, docs.columns) for name in ("_whole", "_key", "_text"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in _few_at_once(batch, rewrite):
                found = find_runs(texts)
                lists = [[dict(zip(("start", "length", "period"), map(int, row))) for row in runs] for runs in found]
                collapsed = [_collapsed(words, runs).decode() for words, runs in zip(texts, found)]
                yield pa.RecordBatch.from_pydict({whole: batch.column(2).slice(start, len(texts)), "runs": pa.array(lists, RUNS),
                                                  "collapsed": pa.array(collapsed, pa.string())})

    ship(docs.sparkSession)
    taken = {runs_as.lower(), collapsed_as.lower()}
    carried = [c for c in docs.columns if c != "text" and c.lower() not in taken]
    given = docs.select(F.col("doc_id").alias(key), F.col("text").alias(text), F.struct(*carried).alias(whole))
    schema = StructType([given.schema[whole], StructField("runs", from_arrow_type(RUNS)), StructField("collapsed", StringType())])
    found = given.mapInArrow(search, schema)
    return found.select(f"{whole}.*", F.col("runs").alias(runs_as), F.col("collapsed").alias(collapsed_as))
