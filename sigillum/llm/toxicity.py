"""Toxicity of documents: boosted trees over dense features, calibrated.

1. Lexicon. Over a bounded sample of labelled documents, Spark counts in how
   many toxic and clean ones each word beginning of 3 to 8 letters occurs; those
   far more frequent in toxic ones, beyond chance, are the lexicon.
2. Features of a whole text: lexicon densities, closeness of second-person words
   to lexicon words, capitals, punctuation and obfuscation rates.
3. Gradient-boosted trees on binned features, fitted in numpy on the sample's
   features; isotonic regression on scores of left-out folds calibrates them.
4. Every document is scored in the task that reads it; nothing is shuffled.
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

from ..operators.keys import quoted
from .common import few, free_name, held_out, in_share, stash, table

# Sent with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The bound of the sample that the model is fitted on: labelled rows of a class.
SAMPLE_ROWS = 10_000
LEXICON_SIZE = 600
SHORTEST, LONGEST = 3, 8
LEAST_EVIDENCE = 20.0
LEAST_LOG_ODDS = 1.0
THRESHOLD = 0.3
NEAR = 6
WINDOW = 30

# Second-person words of English, French, German and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine"
    " deinen ihr euch euer eure usted ustedes ti tú vosotros vuestro vuestra".split()
)
LEET = str.maketrans("01345@$7", "oieasast")

FEATURES = (
    "hits_per_word", "weight_per_word", "top_weight", "log_hits", "kinds", "burst", "weight_sum",
    "second_near", "second_per_word", "capitals", "shouting", "punctuation", "obfuscated",
    "obfuscated_hits", "log_words",
)
_WORD = re.compile(r"[^\W\d_]+")
_HIDDEN = re.compile(r"[^\W\d_]+[0-9@$*]+[^\W\d_]+")
_UPPER = bytes(range(65, 91))
_STRONG = b"!?"
_PUNCT = b"\"#$%&'()*+,-./:;<=>@[\\]^_`{|}~"


class Features:
    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon = lexicon
        self.heads = {entry[:SHORTEST] for entry in lexicon}

    def weight(self, word: str) -> tuple[float, str]:
        """Weight of the longest lexicon entry that the word begins with."""
        for n in range(min(len(word), LONGEST), SHORTEST - 1, -1):
            if (weight := self.lexicon.get(word[:n])) is not None:
                return weight, word[:n]
        return 0.0, ""

    def of(self, text: str) -> list[float]:
        low = text.lower()
        words = _WORD.findall(low)
        n = max(1, len(words))
        heads = self.heads
        hits, kinds, total, top = [], set(), 0.0, 0.0
        for at, word in [(i, w) for i, w in enumerate(words) if w[:SHORTEST] in heads]:
            weight, entry = self.weight(word)
            if weight:
                hits.append(at)
                kinds.add(entry)
                total += weight
                top = max(top, weight)
        second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        near = burst = 0
        if hits:
            spots = np.array(hits)
            burst = int((np.searchsorted(spots, spots + WINDOW) - np.arange(len(spots))).max())
            if second:
                places = np.array(second)
                near = int((np.searchsorted(places, spots + NEAR, "right") > np.searchsorted(places, spots - NEAR)).sum())
        raw = text.encode()
        chars = max(1, len(raw))
        hidden = _HIDDEN.findall(low)
        return [
            len(hits) / n,
            total / n,
            top,
            float(np.log1p(len(hits))),
            float(len(kinds)),
            float(burst),
            total,
            near / max(1, len(hits)),
            len(second) / n,
            (chars - len(raw.translate(None, _UPPER))) / chars,
            (chars - len(raw.translate(None, _STRONG))) / chars,
            (chars - len(raw.translate(None, _PUNCT))) / chars,
            len(hidden) / n,
            float(sum(self.weight(w.translate(LEET))[0] > 0 for w in hidden)),
            float(np.log1p(len(words))),
        ]

    def table(self, texts: list[str | None]) -> np.ndarray:
        return np.array([self.of(text or "") for text in texts], np.float64).reshape(-1, len(FEATURES))


class Trees:
    """Boosted regression trees of equal depth for the logistic loss."""

    def __init__(self, *, rounds: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 64) -> None:
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(self.cuts)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> "Trees":
        grid = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.cuts = [np.unique(np.concatenate((np.quantile(c, grid), np.quantile(c[y == 1], grid[::4]))))
                     if (y == 1).any() else np.unique(np.quantile(c, grid)) for c in x.T]
        binned, (n, m) = self._binned(x), x.shape
        wide = max(len(c) for c in self.cuts) + 1
        positive = float(np.clip((w * y).sum() / w.sum(), 1e-6, 1 - 1e-6))
        self.start = float(np.log(positive / (1 - positive)))
        score, inner, leaves = np.full(n, self.start), 2**self.depth - 1, 2**self.depth
        self.feature = np.zeros((self.rounds, inner), np.int64)
        self.cut = np.full((self.rounds, inner), wide, np.int64)
        self.leaf = np.zeros((self.rounds, leaves))
        columns = np.arange(m) * wide
        for r in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            slope, bend = w * (y - p), np.maximum(w * p * (1 - p), 1e-12)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                base, count = 2**level - 1, 2**level
                flat = (node[:, None] * (m * wide) + columns + binned).ravel()
                size = count * m * wide
                g = np.bincount(flat, np.repeat(slope, m), size).reshape(count, m, wide).cumsum(axis=2)
                h = np.bincount(flat, np.repeat(bend, m), size).reshape(count, m, wide).cumsum(axis=2)
                all_g, all_h = g[:, :, -1:], h[:, :, -1:]
                gain = g**2 / (h + 1) + (all_g - g) ** 2 / (all_h - h + 1) - all_g**2 / (all_h + 1)
                gain[(h < 1) | (all_h - h < 1)] = 0
                best = gain.reshape(count, -1).argmax(axis=1)
                useful = gain.reshape(count, -1).max(axis=1) > 1e-9
                f, c = np.where(useful, best // wide, 0), np.where(useful, best % wide, wide)
                self.feature[r, base : base + count], self.cut[r, base : base + count] = f, c
                node = node * 2 + (binned[np.arange(n), f[node]] > c[node])
            g, h = np.bincount(node, slope, leaves), np.bincount(node, bend, leaves)
            self.leaf[r] = self.rate * g / (h + 1)
            score += self.leaf[r][node]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        binned, every = self._binned(x), np.arange(len(x))
        total = np.full(len(x), self.start)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                spot = 2**level - 1 + node
                node = node * 2 + (binned[every, feature[spot]] > cut[spot])
            total += leaf[node]
        return total


def isotonic(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising curve nearest to `y` (pool adjacent violators)."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, t, v in zip(score[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        blocks.append([t * v, v, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [blocks[-1][0] + top[0], blocks[-1][1] + top[1], blocks[-1][2], top[3]]
    knots = [(k, b[0] / b[1]) for b in blocks for k in ((b[2], b[3]) if b[3] > b[2] else (b[2],))]
    return np.array([k for k, _ in knots]), np.array([v for _, v in knots])


class Model:
    def __init__(self, lexicon: dict[str, float], x: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        self.lexicon = lexicon
        self.constant = None
        if len(y) == 0 or y.min() == y.max():  # nothing to tell apart
            self.constant = float(y[0]) if len(y) else 0.0
            return
        fold = np.arange(len(y)) % 4
        left_out = np.zeros(len(y))
        for k in range(4):
            rest = fold != k
            if y[rest].min() == y[rest].max():
                self.constant = float((w * y).sum() / w.sum())
                return
            left_out[fold == k] = Trees(rounds=80).fit(x[rest], y[rest], w[rest]).score(x[fold == k])
        self.trees = Trees().fit(x, y, w)
        self.knots, self.values = isotonic(left_out, y, w)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        raw = self.trees.score(Features(self.lexicon).table(texts))
        calibrated = np.interp(raw, self.knots, self.values)
        # A trace of the raw score keeps the order within a step of the curve.
        return np.clip(calibrated * 0.999 + 0.001 / (1 + np.exp(-raw)), 0.0, 1.0)


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[DataFrame, dict[int, float]]:
    """`(text, toxic)` of at most `rows` labelled documents of a class, and what one row of it stands for."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    # Ids only; a label without a document takes no place of the sample.
    own = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    known = stash(known.join(own, "doc_id", "left_semi"))
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for toxic in (0, 1):
        key = F.xxhash64("doc_id")
        own = known.where((F.col("toxic") == toxic) & in_share(key, rows, sizes.get(toxic, 0)))
        own = own.orderBy(key, "doc_id").limit(rows)
        picked = own if picked is None else picked.union(own)
    # At most 2 * rows pairs of numbers.
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    # An id that many rows have counts once.
    sample = sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return stash(sample), {t: max(1.0, n / rows) for t, n in sizes.items()}


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """The word beginnings that tell toxic documents from clean ones, with their log odds."""
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return {}
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    starts = F.expr(
        f"array_distinct(flatten(transform(words, w -> transform(sequence({SHORTEST},"
        f" greatest({SHORTEST}, least({LONGEST}, length(w)))), n -> substring(w, 1, n)))))"
    )
    counted = (
        sample.select("toxic", words.alias("words"))
        .select("toxic", F.explode(starts).alias("entry"))
        .where(F.length("entry") >= SHORTEST)
        .groupBy("entry")
        .agg(F.sum("toxic").cast("double").alias("t"), F.count(F.lit(1)).cast("double").alias("n"))
    )
    share = toxic / (toxic + clean)
    part = lambda o, e: f"CASE WHEN {o} > 0 THEN {o} * ln({o} / ({e})) ELSE 0D END"
    evidence = F.expr(f"2D * ({part('t', f'n * {share!r}D')} + {part('(n - t)', f'n * {1 - share!r}D')})")
    odds = F.expr(f"ln((t + 0.5D) / {toxic + 1}D) - ln((n - t + 0.5D) / {clean + 1}D)")
    best = (
        counted.select("entry", odds.alias("odds"), evidence.alias("evidence"))
        .where((F.col("odds") >= LEAST_LOG_ODDS) & (F.col("evidence") >= LEAST_EVIDENCE))
        .orderBy(F.desc("evidence"), "entry")
        .limit(LEXICON_SIZE)
    )
    return {r.entry: r.odds for r in best.collect()}


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model learnt from labelled documents that are not held out."""
    sample, stands_for = _sample(docs, labels, sample_rows)
    lexicon = learn_lexicon(sample)

    @F.arrow_udf("array<double>")
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Features(lexicon)
        for texts in batches:
            rows = [row for some in few(texts) for row in reader.table(some).tolist()]
            yield pa.array(rows, pa.list_(pa.float64()))

    # 2 * sample_rows rows of a few numbers each.
    rows = sample.select(features("text").alias("x"), "toxic", F.xxhash64("doc_id", "text").alias("k")).collect()
    rows.sort(key=lambda r: r.k)
    x = np.array([r.x for r in rows]).reshape(-1, len(FEATURES))
    y = np.array([r.toxic for r in rows], np.float64)
    return Model(lexicon, x, y, np.array([stands_for.get(r.toxic, 1.0) for r in rows]))


def with_score(docs: DataFrame, model: Model, name: str = "score", *, text_col: str = "text") -> DataFrame:
    """`docs` with the toxicity of each whole text, 0 to 1; of NULL that of the empty text."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [np.zeros(0), *(model.scores(some) for some in few(texts))]
            yield pa.array(np.concatenate(found), pa.float64())

    return docs.withColumn(name, score(F.col(text_col)))


def toxicity(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """`(doc_id, held_out, score, predicted)`, one row for each row of `docs`.

    Only the text makes a score. Labels are learnt from rows that are not held
    out and have a document, at most `sample_rows` of each class, taken by a
    hash of the id.

    Cases. NULL and empty texts get the score of a text without words. A very long
    text is scored whole. Repeated rows are scored alike, and each keeps its row;
    an empty table gives none. NULL ids are not held out. Labels that are NULL, or of a NULL or unknown id, teach
    nothing; of several for one id the greatest counts. Without labels of both
    classes all scores are the class there is, or 0. Further columns are not read.
    """
    model = fit(docs, labels, sample_rows=sample_rows)
    scored = with_score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """`docs` without the rows whose text is predicted to be toxic.

    Each row goes by its own text, however long, whatever its id: rows of one id
    and NULL ids too. NULL and empty texts have the score of a text without
    words. Columns stay, whatever their names. An empty table stays empty.
    """
    name = free_name("toxicity_score", docs.columns)
    scored = with_score(docs, fit(docs, labels, sample_rows=sample_rows), name)
    return scored.where(F.col(name) < THRESHOLD).select(*map(quoted, docs.columns))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
