"""Quality of documents from weak labels: labellers, their accuracies by EM, a linear scorer.

1. Overlapping heuristic labellers vote on each whole text: good, bad, or neither.
2. Spark counts how often each pattern of votes occurs over all documents; the
   patterns are few, whatever the corpus. Expectation-maximisation on the counts
   estimates the share of good documents and how often each labeller votes how
   on good and on bad ones. No true label is used.
3. The posterior of a document's pattern is its label. A linear scorer over
   hashed words, word shapes and repeats is trained on a bounded sample of them
   and scores every document.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import few, in_share, mix64, slices, stash, table
from .htmltext import STOP_WORDS

# Sent with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The bound of the sample that the scorer is trained on.
SAMPLE_ROWS = 8000
BITS = 16
EPOCHS, RATE, DECAY = 12, 0.5, 1e-4
EM_ROUNDS = 200
THRESHOLD = 0.5

_WORD = re.compile(r"[^\W\d_]+")
LABELLERS = (
    "stop_words", "symbols", "capitals", "repeats", "lines", "variety", "sentences", "letters", "length",
)


def votes(text: str) -> list[int]:
    """1 for good, 0 for bad, 2 for neither, of each labeller."""
    tokens = text.split()
    words = _WORD.findall(text)
    n, chars = max(1, len(tokens)), max(1, len(text) - text.count(" ") - text.count("\n"))
    letters = sum(map(len, words))
    lower = [w.lower() for w in words]
    stops = sum(w in STOP_WORDS for w in lower) / max(1, len(words))
    raw = text.encode()
    symbols = len(raw) - len(raw.translate(None, b"#$%&*|<>{}[]^~=+\\@_!"))
    capitals = len(raw) - len(raw.translate(None, bytes(range(65, 91))))
    repeats = sum(a == b for a, b in zip(lower, lower[1:], strict=False)) / max(1, len(lower) - 1)
    lines = [line.strip() for line in text.split("\n") if line.strip()]
    copies = 1 - len(set(lines)) / max(1, len(lines))
    variety = len(set(lower)) / max(1, len(lower)) ** 0.7
    ends = text.count(".") + text.count("?")
    graded = lambda value, bad, good: 0 if value >= bad else 1 if value <= good else 2
    return [
        1 if stops >= 0.15 else 0 if stops < 0.05 and len(words) >= 10 else 2,
        graded(symbols / n, 0.25, 0.05),
        graded(capitals / max(1, letters), 0.3, 0.1),
        graded(repeats, 0.1, 0.03),
        graded(copies, 0.3, 0.1) if len(lines) > 3 else 2,
        2 if len(lower) < 20 else 0 if variety < 0.5 else 1 if variety > 1.0 else 2,
        2 if n < 10 else 1 if 3 <= n / max(1, ends) <= 40 else 0 if n / max(1, ends) > 150 or ends > n else 2,
        1 if letters / chars >= 0.85 else 0 if letters / chars < 0.65 else 2,
        0 if not words else 1 if len(words) >= 30 else 2,
    ]


@F.arrow_udf(T.StringType())
def _patterns(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        found = ["".join(map(str, votes(t or ""))) for some in few(texts) for t in some]
        yield pa.array(found, pa.string())


class Accuracies:
    """Share of good documents, and each labeller's chances of voting good on bad and on good ones.

    A labeller that has no opinion says nothing about a document: only votes count.
    """

    def __init__(self, patterns: dict[str, int]) -> None:
        seen = sorted(patterns)
        cast = np.array([[int(v) for v in p] for p in seen], np.int64).reshape(len(seen), len(LABELLERS))
        weight = np.array([patterns[p] for p in seen], np.float64)
        good, bad = (cast == 1).astype(float), (cast == 0).astype(float)
        # To begin with: a labeller is right more often than not.
        posterior = (good.sum(axis=1) + 1.0) / (good.sum(axis=1) + 3 * bad.sum(axis=1) + 2.0)
        for _ in range(EM_ROUNDS):
            self.prior = float(np.clip((weight * posterior).sum() / max(weight.sum(), 1e-9), 0.01, 0.99))
            self.chance = np.stack([
                ((weight * share) @ good + 1.0) / ((weight * share) @ (good + bad) + 2.0)
                for share in (1 - posterior, posterior)
            ])
            before, posterior = posterior, self.posterior(cast)
            if len(posterior) == 0 or np.abs(posterior - before).max() < 1e-9:
                break

    def posterior(self, cast: np.ndarray) -> np.ndarray:
        for_good = np.log(self.chance[1]) - np.log(self.chance[0])
        for_bad = np.log(1 - self.chance[1]) - np.log(1 - self.chance[0])
        odds = np.log(self.prior / (1 - self.prior)) + (cast == 1) @ for_good + (cast == 0) @ for_bad
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def of(self, pattern: str) -> float:
        return float(self.posterior(np.array([[int(v) for v in pattern]]))[0])


_SEED = np.random.Generator(np.random.PCG64(99)).integers(1, 2**63, 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
# Shapes of bytes: capitals, small letters and other scripts, digits; signs stand for themselves.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:], _SHAPE[48:58] = 65, 97, 97, 48


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    running = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)))
    return running[ends] - running[starts]


def hashed_features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`(text, bucket, words of each text)` of the words, their shapes, and repeats of the word before."""
    n = len(raw)
    in_word = (raw != 0x20) & ((raw < 0x09) | (raw > 0x0D))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts, ends = in_word.copy(), in_word.copy()
    starts[1:] &= ~in_word[:-1] | edge[1:n]
    ends[:-1] &= ~in_word[1:] | edge[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    lengths = np.diff(np.append(starts, n))  # up to the next word
    place, base = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(starts):
        place[starts[0] :] = np.arange(starts[0], n) - np.repeat(starts, lengths)
    turn = mix64((place.astype(np.uint64) + np.uint64(1)) * _ODD) | np.uint64(1)
    whole = mix64(_sums(_SEED[raw] * turn, starts, ends))
    shape = _SHAPE[raw]
    new = np.ones(n, bool)
    new[1:] = shape[1:] != shape[:-1]
    new[starts] = True
    step = np.cumsum(new)
    if len(starts):
        base[starts[0] :] = np.repeat(step[starts], lengths)
    nth = mix64(((step - base).astype(np.uint64) + np.uint64(1)) * _ODD) | np.uint64(1)
    formed = mix64(_sums(np.where(new, _SEED[shape] * nth, np.uint64(0)), starts, ends) ^ _ODD)
    repeat = np.zeros(len(starts), np.uint64)
    repeat[1:] = (whole[1:] == whole[:-1]) & (text[1:] == text[:-1])
    again = mix64(repeat + np.uint64(17))
    bucket = np.concatenate((whole, formed, again)) >> np.uint64(64 - BITS)
    return np.tile(text, 3), bucket.astype(np.int64), np.bincount(text, minlength=len(offsets) - 1)


class Scorer:
    """A logistic scorer of the mean hashed features of a text."""

    def __init__(self) -> None:
        self.weight = np.zeros(1 << BITS)
        self.bias = 0.0

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        texts = len(offsets) - 1
        if not len(raw):
            return np.full(texts, 1 / (1 + np.exp(-self.bias)))
        text, bucket, words = hashed_features(raw, offsets)
        total = np.bincount(text, self.weight[bucket], texts) / np.maximum(words, 1)
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -30, 30)))

    def train(self, column: pa.Array, target: np.ndarray) -> "Scorer":
        """Adagrad over the sample, in batches of a slice of texts."""
        parts = []
        for first, end, raw, offsets in slices(column, 1 << 16):
            if len(raw):
                text, bucket, words = hashed_features(raw, offsets)
                parts.append((text, bucket, 1 / np.maximum(words, 1), target[first:end]))
        grown, grown_bias = np.full(1 << BITS, 1e-8), 1e-8
        for _ in range(EPOCHS):
            for text, bucket, scale, goal in parts:
                total = np.bincount(text, self.weight[bucket], len(goal)) * scale + self.bias
                slope = 1 / (1 + np.exp(-np.clip(total, -30, 30))) - goal
                grad = np.bincount(bucket, (slope * scale)[text], 1 << BITS) / len(goal) + DECAY * self.weight / len(parts)
                grown += grad**2
                self.weight -= RATE * grad / np.sqrt(grown)
                grown_bias += slope.mean() ** 2
                self.bias -= 0.1 * slope.mean() / grown_bias**0.5
        return self


def fit(docs: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> tuple[Accuracies, Scorer]:
    """Labellers' accuracies over all documents, and a scorer trained on a sample of posteriors."""
    # At most 3 ** len(LABELLERS) patterns, whatever the number of documents.
    counted = docs.select(_patterns("text").alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    patterns = {r.pattern: r.n for r in counted.collect()}
    accuracies = Accuracies(patterns)
    keyed = docs.where("text IS NOT NULL").select(
        F.xxhash64("doc_id", F.octet_length("text"), F.substring("text", 1, 64)).alias("k"), "text"
    )
    some = keyed.where(in_share(F.col("k"), sample_rows, sum(patterns.values())))
    picked = some.select("k").distinct().orderBy("k").limit(sample_rows)
    # At most `sample_rows` numbers; copies of a text count once.
    once = keyed.join(F.broadcast(picked), "k").groupBy("k").agg(F.min("text").alias("text"))
    sample = stash(once.select("k", "text", _patterns("text").alias("pattern")))
    trained = _train_in_task(sample, accuracies)
    return accuracies, trained


def _train_in_task(sample: DataFrame, accuracies: Accuracies) -> Scorer:
    """Trains where the sample is, in one task: it is bounded, and the driver gets weights only."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = pa.Table.from_batches(list(batches), schema=pa.schema([("k", pa.int64()), ("text", pa.string()), ("pattern", pa.string())]))
        table_ = table_.sort_by("k").combine_chunks()
        target = np.array([accuracies.of(p) for p in table_.column("pattern").to_pylist()])
        scorer = Scorer()
        if table_.num_rows:
            scorer.train(table_.column("text").combine_chunks(), target)
        yield pa.RecordBatch.from_arrays(
            [pa.array([scorer.weight.tobytes()], pa.binary()), pa.array([scorer.bias])], names=["weight", "bias"]
        )

    row = sample.coalesce(1).mapInArrow(train, "weight binary, bias double").first()
    scorer = Scorer()
    if row is not None:
        scorer.weight, scorer.bias = np.frombuffer(row.weight), row.bias
    return scorer


def quality(docs: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """`(doc_id, score, kept)`, one row for each row of `docs`; `kept` from a score of 0.5.

    Cases. NULL and empty texts have no words and are not kept, with score 0.
    NULL and repeated ids stay as they are. Further columns are not read. An
    empty table gives none.
    """
    _, scorer = fit(docs, sample_rows=sample_rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0)]
            for _, _, raw, offsets in slices(batch.column(1)):
                found.append(np.where(np.diff(offsets) > 0, scorer.scores(raw, offsets), 0.0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(found))], names=["doc_id", "score"]
            )

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, score double")
    return scored.withColumn("kept", F.col("score") >= THRESHOLD)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
