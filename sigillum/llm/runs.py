"""Periodic runs of words: longest common extensions by a difference cover.

A run repeats a stretch of `q` words at least four times over. Where two places
of a text `q` words apart agree for `3 * q` words, one of the places is on the
grid of multiples of `3 * q`; so for each period only the grid is asked how far
the words there and `q` words later agree, forwards and backwards (the longest
common extensions), which is n/3 + n/6 + n/9 + ... questions for n words.

A question compares a few words until both places fall on sampled ones, and is
then answered by the sample: the suffixes that start at a residue of the
difference cover are sorted, and the least common prefix between their ranks
comes from a sparse table. No other suffix is sorted, and none at all where no
question gets so far.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

# Sent with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Every difference modulo PERIOD is one between two residues of the cover.
PERIOD = 31
COVER = np.array([0, 1, 3, 8, 12, 18])
REPEATS, LEAST_WORDS = 4, 6
QUESTIONS = 1 << 18

_PLACE = np.full(PERIOD, -1)
_PLACE[COVER] = np.arange(len(COVER))
# _FIRST[d]: a residue of the cover such that it plus d is one as well.
_FIRST = np.zeros(PERIOD, np.int64)
for _residue in COVER[::-1]:
    _FIRST[(COVER - _residue) % PERIOD] = _residue


class Sample:
    """The suffixes of `seq` at the residues of the cover, sorted, with their common prefixes.

    Words are 1 or more; the last one occurs nowhere else, so no suffix is a prefix of another.
    """

    def __init__(self, seq: np.ndarray) -> None:
        n, k = len(seq), len(COVER)
        at = (np.arange(0, n + PERIOD, PERIOD)[:, None] + COVER).ravel()
        at = at[at < n]
        ranks = [self._block_ranks(seq, at)]
        step = k
        while ranks[-1].max() < len(at) - 1:
            now = ranks[-1]
            later = np.zeros(len(at), np.int64)
            later[:-step] = now[step:] + 1
            ranks.append(np.unique(now * (len(at) + 1) + later, return_inverse=True)[1])
            step *= 2
        self.rank = ranks[-1]
        order = np.argsort(self.rank)
        a, b = order[:-1], order[1:]
        for level in range(len(ranks) - 2, -1, -1):
            inside = np.maximum(a, b) < len(at)
            same = np.zeros(len(a), bool)
            same[inside] = ranks[level][a[inside]] == ranks[level][b[inside]]
            a, b = a + same * (k << level), b + same * (k << level)
        # `a` and `b` moved by whole periods; words decide the rest.
        first, second = order[:-1], order[1:]
        common = (a - first) // k * PERIOD
        common = common + agreeing(seq, at[first] + common, at[second] + common, np.full(len(first), PERIOD))
        self.least = [common]
        while 2 << (len(self.least) - 1) <= len(common):
            last, half = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(last[:-half], last[half:]))

    @staticmethod
    def _block_ranks(seq: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the PERIOD words from each place; several words share a sort key."""
        bits = int(seq.max()).bit_length()
        lane = max(1, 63 // bits)
        padded = np.append(seq, np.zeros(PERIOD + lane, np.int64))
        keys = []
        for start in range(0, PERIOD, lane):
            key = np.zeros(len(at), np.int64)
            for j in range(start, min(start + lane, PERIOD)):
                key = key << bits | padded[at + j]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        differs = np.zeros(len(at), bool)
        for key in keys:
            differs[1:] |= key[order[1:]] != key[order[:-1]]
        ranks = np.empty(len(at), np.int64)
        ranks[order] = np.cumsum(differs)
        return ranks

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree from the sampled places `i` and `j`, which differ."""
        k = len(COVER)
        i, j = (self.rank[x // PERIOD * k + _PLACE[x % PERIOD]] for x in (i, j))
        low, high = np.minimum(i, j), np.maximum(i, j)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        found = np.empty(len(low), np.int64)
        for some in np.unique(level):
            of = np.flatnonzero(level == some)
            least = self.least[some]
            found[of] = np.minimum(least[low[of]], least[high[of] - (1 << some)])
        return found


def agreeing(seq: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words, `most` at the most, agree from `i` and `j`, word by word."""
    found = np.zeros(len(i), np.int64)
    active = np.flatnonzero(most > 0)
    step = 0
    while len(active):
        active = active[seq[i[active] + step] == seq[j[active] + step]]
        step += 1
        found[active] = step
        active = active[most[active] > step]
    return found


class Extensions:
    """Longest common extensions of `seq`, whose first and last word occur only there."""

    def __init__(self, seq: np.ndarray) -> None:
        self.seq = seq
        self.sample: Sample | None = None

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree from `i` and `j`, which differ."""
        to_sample = (_FIRST[(j - i) % PERIOD] - i) % PERIOD
        found = agreeing(self.seq, i, j, to_sample)
        on = np.flatnonzero(found == to_sample)
        # Places on the sample whose word differs need no sample.
        on = on[self.seq[i[on] + found[on]] == self.seq[j[on] + found[on]]]
        if len(on):
            if self.sample is None:
                self.sample = Sample(self.seq)
            found[on] += self.sample.common(i[on] + found[on], j[on] + found[on])
        return found


def _questions(n: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """`(place, period)` of the grids of all periods, ascending, some at a time."""
    periods = np.arange(1, longest // REPEATS + 1)
    steps = np.maximum(LEAST_WORDS, REPEATS * periods) - periods
    counts = np.maximum(0, (n - 1 - periods) // steps + 1)
    ends = np.cumsum(counts)
    first = 0
    while first < len(periods):
        base = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + QUESTIONS, "right")))
        some = slice(first, last)
        total = int(counts[some].sum())
        at = np.arange(total) - np.repeat(ends[some] - counts[some] - base, counts[some])
        yield at * np.repeat(steps[some], counts[some]), np.repeat(periods[some], counts[some])
        first = last


def runs_of(seq: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`(start, end, period)` of all runs of `seq`, by start, then period.

    `seq` has a word of its own before, between and after texts of `longest`
    words at most, so no run crosses them.
    """
    forwards, backwards = Extensions(seq), Extensions(np.ascontiguousarray(seq[::-1]))
    n = len(seq)
    found = []
    for place, period in _questions(n, longest):
        same = np.flatnonzero(seq[place] == seq[place + period])
        place, period = place[same], period[same]
        ahead = forwards(place, place + period)
        least = np.maximum(LEAST_WORDS, REPEATS * period) - period
        behind = backwards(n - place - period, n - place)
        good = np.flatnonzero(ahead + behind >= least)
        if len(good):
            start = place[good] - behind[good]
            end = place[good] + period[good] + ahead[good]
            found.append(_smallest(start, end, period[good]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, end, period = _smallest(*(np.concatenate(x) for x in zip(*found, strict=True)))
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _smallest(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row for each stretch, with its smallest period. As a run has four of them at
    least, all its periods are multiples of the smallest, and extend just as far."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    keep = np.ones(len(start), bool)
    keep[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[keep], end[keep], period[keep]


def _found_in(texts: list[list[bytes]]) -> Iterator[tuple[list[dict], bytes]]:
    """The runs of each text and what is left without their repeats."""
    ids = defaultdict(count(1).__next__)
    total = sum(map(len, texts)) + len(texts) + 1
    seq = np.empty(total, np.int64)
    starts, place = [], 0
    for words in [[], *texts]:
        starts.append(place)
        seq[place : place + len(words)] = list(map(ids.__getitem__, words))
        place += len(words) + 1
    ends = np.append(np.array(starts[1:], np.int64) - 1, total - 1)
    seq[ends] = len(ids) + 1 + np.arange(len(ends))
    start, end, period = runs_of(seq, max(map(len, texts)))
    first = np.searchsorted(start, np.append(starts[1:], total))
    for words, base, a, b in zip(texts, starts[1:], first[:-1], first[1:], strict=True):
        runs = []
        if a < b:
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, start[a:b] + period[a:b] - base, 1)
            np.add.at(edge, end[a:b] - base, -1)
            words = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
            runs = [
                {"start": s - base, "length": e - s, "period": q}
                for s, e, q in zip(start[a:b].tolist(), end[a:b].tolist(), period[a:b].tolist(), strict=True)
            ]
        yield runs, b" ".join(words)


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, raw, offsets in slices(batch.column(1)):
            texts = [raw[a:b].tobytes().split() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            runs, kept = zip(*_found_in(texts), strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, end - first),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(runs, _RUNS),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, n_words, runs, collapsed)`, one row for each row of `docs`.

    Words are runs of bytes other than 0x20 and 0x09-0x0D. `runs` has `(start,
    length, period)`, in words, of every stretch of at least `REPEATS` periods and
    `LEAST_WORDS` words that no word next to it extends, by start, then period.
    `collapsed` are the words that no run has after its first period, joined by
    one space.

    Cases. NULL and empty texts, and texts of white space, have no words: no
    runs, and an empty `collapsed`. A very long text is searched whole, by one
    task; its questions are asked some at a time, so memory follows its length.
    Runs that overlap are all reported; of equal stretches the smallest period
    counts. NULL and repeated ids and repeated rows each keep a row of their own.
    Further columns of `docs`, whatever their names, are not read. An empty table gives none.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _find,
        "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string",
    )


def with_repeats(doc_id: Column, text: Column) -> Column:
    """The text; in a tenth of the documents, by their id, a stretch repeats up to the end."""
    hashed = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    # As the element of an array the words are computed once, not for each place.
    edited = F.get(F.transform(F.array(words), lambda w: _repeated(w, F.floor(hashed / 10))), 0)
    return F.when(hashed % 10 == 0, edited).otherwise(text)


def _repeated(words: Column, g: Column) -> Column:
    n = F.size(words)
    start = F.pmod(g, n)
    period = 1 + F.floor((n - start) / (3 + F.pmod(g, F.lit(8))))
    place = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.get(words, F.when(i < start, i).otherwise(start + F.pmod(i - start, period)).cast("int")),
    )
    return F.when(n > 0, F.array_join(place, " ")).otherwise("")


def run_digests(found: DataFrame) -> DataFrame:
    """What `op13_runs` returns: the most repeated run, and digests of runs and kept words."""
    lines = F.expr("transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n'))")
    best = F.expr(
        "reduce(runs, CAST(NULL AS STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>), (best, r) ->"
        " IF(best IS NULL OR r.length * best.period > best.length * r.period, r, best))"
    )
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best.alias("best"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    edited = docs.select("doc_id", with_repeats(F.col("doc_id"), F.col("text")).alias("text"))
    return run_digests(periodic_runs(edited))
