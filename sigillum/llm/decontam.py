"""Benchmark passages in documents: q-gram lemma in diagonal bands, then alignment.

What is looked for are patterns: each whole item, and overlapping windows of
`WINDOW` bytes of the longer ones, so that a part of an item is found as well.
A pattern of m bytes with at most k edits shares m - q + 1 - k * q of its q-grams
with a text, on diagonals (place in the text less place in the pattern) that
differ by k at most. So hits are counted in overlapping diagonal bands of twice
k + 1, each hit in two; a band with fewer hits than the bound cannot hold a
passage. The others are aligned within their band, and windows that follow one
another in item and text are one region. Items too short for the lemma are
looked for as whole words.

A task has an index of some MiB of the benchmark and takes its documents once,
whole; a larger benchmark is taken in as many blocks as it has such pieces.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keys import quoted
from .common import mix64, slices, stash, table

# Sent with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Q = 9
EDIT_RATE = 0.1
# Shared q-grams that the bound leaves at least; short items get a smaller budget for it.
LEAST_SHARED = 8
# A q-gram at more places of the benchmark than this is left out, and the bound
# of each item lowered by its places, so that no passage is lost by it.
MOST_PLACES = 4
MIN_CHARS = 24
WINDOW, STEP = 64, 16
# A shorter exact match ("yes") tells nothing: reported, but no reason to drop a document.
TELLING_CHARS = 12
# Bounds that common q-grams may leave.
LEAST_KEPT = 4
BLOCK_BYTES = 1 << 22
_FILTER_BITS = 22
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _folded(code: int) -> bytes:
    """A code point from 0x80 on without its case, in UTF-8; empty if it is of no word."""
    if code > sys.maxunicode or 0xD800 <= code < 0xE000:
        return b""
    char = chr(code)
    # Marks belong to the letter before them; selectors of a glyph do not.
    is_mark = unicodedata.category(char)[0] == "M" and not 0xFE00 <= code < 0xFE10
    return char.casefold().encode() if char.isalnum() or is_mark else b""


def normalised(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`(bytes, offsets, places)`: without case, one space for each run of other signs.

    `places` has for each byte the first one in `raw` of its code point.
    """
    starts = offsets[:-1][offsets[:-1] < len(raw)]
    is_char = (raw & 0xC0) != 0x80
    is_char[starts] = True
    at = np.flatnonzero(is_char)
    low = raw[at]
    low = np.where((low >= 0x41) & (low <= 0x5A), low + np.uint8(32), low)
    is_sign = ((low >= 0x61) & (low <= 0x7A)) | ((low >= 0x30) & (low <= 0x39))
    size = np.ones(len(at), np.int64)
    wide = np.flatnonzero(low >= 0x80)
    padded = np.append(raw, np.zeros(3, np.uint8))
    lead, *more = (padded[at[wide] + k].astype(np.int64) for k in range(4))
    more = [x & 0x3F for x in more]
    code = np.select(
        [lead < 0xC0, lead < 0xE0, lead < 0xF0],
        [0xD800, (lead & 0x1F) << 6 | more[0], (lead & 0x0F) << 12 | more[0] << 6 | more[1]],
        (lead & 0x07) << 18 | more[0] << 12 | more[1] << 6 | more[2],
    )
    codes, which = np.unique(code, return_inverse=True)
    folded = [_folded(c) for c in codes.tolist()]
    sizes = np.array([len(f) for f in folded], np.int64)
    is_sign[wide] = sizes[which] > 0
    size[wide] = np.maximum(1, sizes[which])
    keep = is_sign.copy()
    keep[1:] |= is_sign[:-1]
    keep[np.searchsorted(at, starts)] = True
    first = np.cumsum(np.where(keep, size, 0)) - size
    text = np.repeat(np.where(is_sign, low, np.uint8(0x20))[keep], size[keep])
    places = np.repeat(at[keep], size[keep])
    most = int(sizes.max(initial=0))
    signs = np.frombuffer(b"".join(f.ljust(most, b" ") for f in folded), np.uint8).reshape(len(folded), most)
    for k in range(most):
        there = sizes[which] > k
        text[first[wide[there]] + k] = signs[which[there], k]
    return text, np.searchsorted(places, offsets), places


def _grams(text: np.ndarray) -> np.ndarray:
    n = max(0, len(text) - Q + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(Q):
        rolled = rolled * _BASE + (text[k : n + k].astype(np.uint64) + np.uint64(1))
    return mix64(rolled)


def align(
    text: np.ndarray, pattern: np.ndarray, low: int, high: int, budget: int, *, anchored: bool = False
) -> tuple[int, int] | None:
    """`(edits, end)` of the best match of the whole pattern on diagonals `low` to `high`.

    The match may end anywhere in `text` and start anywhere, or at its start if
    `anchored`. None if it takes more edits than `budget`. A row of the table is
    one character of the pattern.
    """
    width = high - low + 1
    far = budget + 1
    lane = np.arange(width)
    at = lane + low
    row = np.where((at >= 0) & (at <= len(text)), np.minimum(at, far) if anchored else 0, far)
    for i in range(1, len(pattern) + 1):
        at = lane + low + i  # characters of the text used so far
        inside = (at >= 1) & (at <= len(text))
        differs = np.ones(width, np.int64)
        differs[inside] = text[at[inside] - 1] != pattern[i - 1]
        best = np.where(inside, row + differs, far)
        best[:-1] = np.minimum(best[:-1], row[1:] + 1)
        best[(at < 0) | (at > len(text))] = far
        row = np.minimum(np.minimum.accumulate(best - lane) + lane, far)
        if row.min() > budget:
            return None
    end = int(row.argmin())
    return int(row[end]), end + low + len(pattern)


def edit_budget(m: int) -> int:
    """Edits allowed in an item of `m` bytes: a rate, and fewer where the lemma would ask for
    fewer than `LEAST_SHARED` common q-grams."""
    return max(0, min(int(EDIT_RATE * m), (m - Q + 1 - LEAST_SHARED) // Q))


def pattern_bytes(text: str | None) -> bytes:
    """An item as it is looked for."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return normalised(raw, np.array([0, len(raw)]))[0].tobytes().strip() if len(raw) else b""


def parts_of(m: int) -> list[tuple[int, int]]:
    """`(offset, length)` of the patterns of an item of `m` bytes: the whole, and windows of a longer one."""
    if m == 0:
        return []
    windows = [] if m <= WINDOW else [*range(0, m - WINDOW, STEP), m - WINDOW]
    return [(0, m), *((at, WINDOW) for at in windows)]


class Index:
    """The q-grams of some benchmark items, and the short ones as words."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.items: list[tuple[int, bytes]] = []
        self.words: dict[bytes, list[int]] = {}
        for item_id, text in items:
            pattern = pattern_bytes(text)
            if len(pattern) >= MIN_CHARS:
                self.items.append((item_id, pattern))
            elif pattern:
                self.words.setdefault(pattern, []).append(item_id)
        self.lengths = sorted({len(w) for w in self.words})
        start = np.zeros(1, np.int64)
        hashes = [_word_hashes(np.frombuffer(w, np.uint8), start, len(w))[0] for w in self.words]
        self.word_hashes = np.sort(np.array(hashes, np.uint64))
        m = np.array([len(pattern) for _, pattern in self.items], np.int64)
        gram = [_grams(np.frombuffer(pattern, np.uint8)) for _, pattern in self.items]
        self.gram = np.concatenate(gram) if gram else np.zeros(0, np.uint64)
        self.owner = np.repeat(np.arange(len(m)), m - Q + 1).astype(np.int32)
        self.place = (np.arange(len(self.gram)) - np.repeat(np.cumsum(m - Q + 1) - (m - Q + 1), m - Q + 1)).astype(np.int32)
        self.m = m
        # Windows of all items in one list; those of an item start at `first`.
        parts = [[at for at, _ in parts_of(n)[1:]] for n in m.tolist()]
        self.first = np.cumsum([0] + [len(p) for p in parts])
        self.offset = np.array([at for p in parts for at in p], np.int64)
        self.window_item = np.repeat(np.arange(len(m)), np.diff(self.first))
        self.budget = np.array([edit_budget(n) for n in m.tolist()], np.int64)
        self._bounds()
        order = np.argsort(self.gram, kind="stable")
        self.gram, self.owner, self.place = (x[order] for x in (self.gram, self.owner, self.place))
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[self.gram >> np.uint64(64 - _FILTER_BITS)] = True

    def _bounds(self) -> None:
        """Leaves common q-grams out, and lowers the bounds of items and windows by them.

        An item of which too much is common keeps all.
        """
        _, which, count = np.unique(self.gram, return_inverse=True, return_counts=True)
        is_common = count[which] > MOST_PLACES
        before = np.append(0, np.cumsum(is_common))
        starts = np.append(0, np.cumsum(self.m - Q + 1))
        full = self.m - Q + 1 - self.budget * Q
        whole = full - (before[starts[1:]] - before[starts[:-1]])
        at = starts[self.window_item] + self.offset
        full_window = WINDOW - Q + 1 - edit_budget(WINDOW) * Q
        window = full_window - (before[at + WINDOW - Q + 1] - before[at])
        least = whole.copy()
        np.minimum.at(least, self.window_item, window)
        keeps_all = least < LEAST_KEPT
        self.bounds = np.where(keeps_all, full, whole)
        self.window_bounds = np.where(keeps_all[self.window_item], full_window, window)
        kept = ~is_common | keeps_all[self.owner]
        self.gram, self.owner, self.place = self.gram[kept], self.owner[kept], self.place[kept]

    def _counted(self, doc, part, diagonal, step, bounds) -> dict[tuple[int, int], list[int]]:
        """The bands of each document and pattern that have as many hits as the bound."""
        band = diagonal // step
        n = max(1, len(bounds))
        key = (doc * n + part) * np.int64(1 << 30) + band + np.int64(1 << 29)
        keys, count = np.unique(np.concatenate((key, key - 1)), return_counts=True)
        pair = keys >> np.int64(30)
        keep = count >= bounds[pair % n] if len(bounds) else np.zeros(0, bool)
        found: dict[tuple[int, int], list[int]] = {}
        bands = (keys[keep] & ((1 << 30) - 1)) - (1 << 29)
        for p, b in zip(pair[keep].tolist(), bands.tolist(), strict=True):
            found.setdefault(divmod(p, n), []).append(b)
        return found

    def matches(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, int, float]]:
        """`(text, item id, edits, start, end, share)` of some texts; places are code points."""
        if not len(raw):
            return
        text, bounds, at = normalised(raw, offsets)
        for d, s, k in _short_hits(text, bounds, self.lengths, self.word_hashes):
            for item_id in self.words.get(text[s : s + k].tobytes(), ()):
                yield d, item_id, 0, *_code_points(raw, offsets, at, d, s, s + k), 1.0
        if not len(self.gram):
            return
        grams = _grams(text)
        maybe = np.flatnonzero(self.seen[grams >> np.uint64(64 - _FILTER_BITS)])
        first = np.searchsorted(self.gram, grams[maybe], "left")
        count = np.searchsorted(self.gram, grams[maybe], "right") - first
        maybe, first, count = maybe[count > 0], first[count > 0], count[count > 0]
        pos = np.repeat(maybe, count)
        entry = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        doc = np.searchsorted(bounds, pos, "right") - 1
        inside = pos + Q <= bounds[doc + 1]
        pos, entry, doc = pos[inside], entry[inside], doc[inside]
        if not len(pos):
            return
        item, place = self.owner[entry].astype(np.int64), self.place[entry].astype(np.int64)
        # Places in the text count from its own start.
        pos = pos - bounds[doc]
        whole = self._counted(doc, item, pos - place, self.budget[item] + 1, self.bounds)
        found: dict[tuple[int, int], list[tuple]] = {}
        for (d, i), bands in whole.items():
            pattern = self.items[i][1]
            best = _best(text[bounds[d] : bounds[d + 1]], pattern, int(self.budget[i]), bands)
            if best:
                found[d, i] = [(0, len(pattern), *best)]
        rows = []
        for back in range(WINDOW // STEP):
            own = place // STEP - back
            good = np.flatnonzero((own >= 0) & (own * STEP < self.m[item] - WINDOW) & (place - own * STEP <= WINDOW - Q))
            rows.append((good, self.first[item[good]] + own[good]))
        good = np.flatnonzero((self.m[item] > WINDOW) & (place >= self.m[item] - WINDOW))
        rows.append((good, self.first[item[good] + 1] - 1))
        hit, window = (np.concatenate(x) for x in zip(*rows, strict=True))
        diagonal = pos[hit] - place[hit] + self.offset[window]
        slack = edit_budget(WINDOW)
        for (d, w), bands in self._counted(doc[hit], window, diagonal, slack + 1, self.window_bounds).items():
            i, offset = int(self.window_item[w]), int(self.offset[w])
            if found.get((d, i), [(0, 0)])[0][1] == len(self.items[i][1]):
                continue
            pattern = self.items[i][1][offset : offset + WINDOW]
            best = _best(text[bounds[d] : bounds[d + 1]], pattern, slack, bands)
            if best:
                found.setdefault((d, i), []).append((offset, WINDOW, *best))
        for (d, i), own in sorted(found.items()):
            base = int(bounds[d])
            for covered, edits, start, end in _regions(own):
                places = _code_points(raw, offsets, at, d, base + start, base + end)
                yield d, self.items[i][0], edits, *places, covered / len(self.items[i][1])


def _word_hashes(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of `length` bytes from each start."""
    rolled = np.full(len(starts), length, np.uint64)
    for k in range(length):
        rolled = rolled * _BASE + (text[starts + k].astype(np.uint64) + np.uint64(1))
    return mix64(rolled)


def _short_hits(text, bounds, lengths, known) -> Iterator[tuple[int, int, int]]:
    """`(text, start, length)` of the first of each short item, as whole words."""
    if not lengths:
        return
    is_word = text != 0x20
    breaks = np.zeros(len(text) + 1, bool)
    breaks[bounds] = True
    starts = np.flatnonzero(is_word & (np.append(True, ~is_word[:-1]) | breaks[:-1]))
    is_end = np.append(~is_word, True) | breaks
    doc = np.searchsorted(bounds, starts, "right") - 1
    for k in lengths:
        inside = np.flatnonzero(starts + k <= bounds[doc + 1])
        inside = inside[is_end[starts[inside] + k]]
        hashes = _word_hashes(text, starts[inside], k)
        some = np.flatnonzero(known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes)
        _, first = np.unique(np.stack((doc[inside[some]].astype(np.uint64), hashes[some])), axis=1, return_index=True)
        for i in inside[some[np.sort(first)]].tolist():
            yield int(doc[i]), int(starts[i]), k


def _code_points(raw, offsets, at, d: int, start: int, end: int) -> tuple[int, int]:
    """Places in the text `d`, in code points, of a stretch of what `normalised` made of it."""
    base = int(offsets[d])
    own = raw[base : int(at[end - 1]) + 1]
    is_start = (own & 0xC0) != 0x80
    first = int(is_start[: int(at[start]) - base].sum())
    return first, int(is_start.sum())


def _best(text: np.ndarray, pattern: bytes, budget: int, bands: list[int]) -> tuple[int, int, int] | None:
    """`(edits, start, end)` of the best match of the pattern in the bands; bytes."""
    best = None
    goal = np.frombuffer(pattern, np.uint8)
    step = budget + 1
    for band in sorted(bands):
        low, high = band * step - budget, (band + 2) * step + budget
        start = max(0, low)
        region = text[start : min(len(text), high + len(goal))]
        exact = region.tobytes().find(pattern)
        if exact >= 0:
            found = (0, start + exact, start + exact + len(goal))
        elif best is not None and best[0] == 0:
            continue
        else:
            there = align(region, goal, low - start, high - start, budget)
            if there is None:
                continue
            edits, end = there
            back = align(region[:end][::-1], goal[::-1], -budget, budget, budget, anchored=True)
            found = (edits, start + end - back[1] if back else start, start + end)
        best = found if best is None else min(best, found)
    return best


def _regions(own: list[tuple[int, int, int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """`(bytes of the item, edits, start, end)` of `(offset, length, edits, start, end)`: what is
    in sequence in item and text is one region."""
    slack = 2 * edit_budget(WINDOW)
    region: list[tuple] = []
    for row in [*sorted(own), None]:
        last = region[-1] if region else None
        follows = row and last and row[0] - last[0] <= STEP and abs(row[3] - last[3] - row[0] + last[0]) <= slack
        if region and not follows:
            covered = last[0] + last[1] - region[0][0]
            yield covered, max(r[2] for r in region), min(r[3] for r in region), max(r[4] for r in region)
            region = []
        region.append(row)


def _matcher(items: list[tuple[int, str]]) -> Callable:
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items)
        for batch in batches:
            for first, _, raw, offsets in slices(batch.column(1)):
                rows = [(first + d, *row) for d, *row in index.matches(raw, offsets)]
                if not rows:
                    continue
                at, *columns = zip(*rows, strict=True)
                own = [batch.column(k).take(pa.array(at, pa.int64())) for k in (0, 2, 3)]
                kinds = [pa.int64()] * 4 + [pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [own[0], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), *own[1:]],
                    names=["doc_id", "item_id", "edits", "start", "end", "share", "text_hash", "text_check"],
                )

    return match


def _found(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `contaminated`, with two hashes of the document's text."""
    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"),
        F.hash("text").cast("long").alias("text_check"),
    )
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = 1 + size // block_bytes
    schema = "doc_id long, item_id long, edits long, start long, end long, share double, text_hash long, text_check long"
    found = []
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        hits = named.mapInArrow(_matcher([(r.item_id, r.text) for r in own.collect()]), schema)
        found.append(hits if blocks == 1 else stash(hits))
    return reduce(DataFrame.union, found)


def contaminated(docs: DataFrame, benchmark: DataFrame, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`(doc_id, item_id, edits, start, end, share)`: documents that hold a benchmark text or a part of it.

    Letters of either case are the same in any script, and any run of characters
    that are neither letters (with their marks) nor digits is one space; in what
    is left, in UTF-8, an item of m bytes may differ by `edit_budget(m)` edits. If
    the whole item is found, that is the one row of document and item: the place
    with the fewest edits, then the first, and a `share` of 1. Otherwise each
    region is a row: windows of `WINDOW` bytes, `STEP` bytes apart in the item,
    that are each found within their budget, one behind the other; `share` is the
    region's part of the item and `edits` the most that one window has. So a copy
    of `WINDOW + STEP - 1` bytes on end is always found. Items under `MIN_CHARS`
    bytes are found as whole words, without edits, at their first place. Places
    are code points.

    Items are taken in blocks of about `block_bytes`; each is broadcast and
    meets every document once, so neither a task nor the driver ever has more
    than one block, and the number of blocks follows the benchmark.

    Cases. NULL and empty texts hold nothing. NULL and empty items, and those
    without letters and digits, match nothing. A very long text is searched
    whole; each of its candidates reads a stretch of it only. Equal items and
    repeated rows are each reported. NULL ids are reported as NULL. Further
    columns, whatever their names, are not read. Empty tables give none.
    """
    return _found(docs, benchmark, block_bytes).drop("text_hash", "text_check")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the rows whose text holds a benchmark text or a region of one.

    Each row goes by its own text, whatever its id and those of others. Matches
    under `TELLING_CHARS` characters, as short items have, are no reason. NULL and
    empty texts stay, long ones are read whole; columns stay, whatever their
    names. An empty table stays empty.
    """
    leaks = _found(docs.select("doc_id", "text"), benchmark).where(F.col("end") - F.col("start") >= TELLING_CHARS)
    leaks = stash(leaks.select("text_hash", "text_check").distinct().withColumnsRenamed(
        {"text_hash": _HASH, "text_check": _CHECK}))
    hashed = docs.withColumns({_HASH: F.xxhash64("text"), _CHECK: F.hash("text").cast("long")})
    return hashed.join(leaks, [_HASH, _CHECK], "left_anti").select(*map(quoted, docs.columns))


_HASH, _CHECK = "__sigillum_text_hash", "__sigillum_text_check"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
