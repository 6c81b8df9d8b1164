"""Mixing sources to target weights: temperature, bisected, then block permutations.

A source of token share p gets the weight p^a / sum(p^a). At a = 1 the mix is
as found, at a = 0 all sources weigh the same. The exponent is the least one
(the flattest mix) at which no source is repeated more than `max_repeats` times
as often as the least repeated one, or the greatest one that reaches
`target_entropy`, whichever exponent is greater.

A source's budget is its weight times the whole budget. It is spent in epochs:
in each one the source's documents are dealt into blocks, and blocks and the
documents within them are permuted anew; the last epoch ends where the budget
does. A key in (0, 1] for each scheduled document lets any consumer sort, or
range-partition, all sources into one stream that has the target weights all
along it. Nothing here sorts the corpus.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.keys import quoted
from .common import free_name, slices, stash, table

# Sent with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_REPEATS = 2.0
BLOCKS = 1024
SEED = 20260112
_STEPS = 60


@F.arrow_udf(T.LongType())
def token_count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Runs of characters other than white space in each whole text; 0 for NULL."""
    for texts in batches:
        counts = [np.zeros(0, np.int64)]
        for _, _, raw, offsets in slices(texts):
            is_start = (raw != 0x20) & ((raw < 0x09) | (raw > 0x0D))
            blank = ~is_start
            is_first = np.zeros(len(raw) + 1, bool)
            is_first[offsets] = True
            is_start[1:] &= blank[:-1] | is_first[1:-1]
            before = np.concatenate(([0], np.cumsum(is_start)))
            counts.append(np.diff(before[offsets]))
        yield pa.array(np.concatenate(counts), pa.int64())


def _entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def _weights(shares: list[float], exponent: float) -> list[float]:
    raised = [p**exponent if p > 0 else 0.0 for p in shares]
    return [r / sum(raised) for r in raised]


def _least(is_met) -> float:
    """The least exponent in 0..1 that meets a condition which holds from there on."""
    if is_met(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(_STEPS):
        middle = (low + high) / 2
        low, high = (low, middle) if is_met(middle) else (middle, high)
    return high


def temperature(
    tokens: dict[str, int], *, max_repeats: float = MAX_REPEATS, target_entropy: float | None = None
) -> tuple[float, dict[str, float]]:
    """`(exponent, weight of each source)`; `target_entropy` is a part of log(number of sources).

    A mix's entropy falls with the exponent, so the mix as found (exponent 1)
    stands if it has the target already, and the flattest one if none has.
    """
    names = [name for name in sorted(tokens) if tokens[name] > 0]
    if not names:
        return 1.0, {}
    total = sum(tokens[name] for name in names)
    shares = [tokens[name] / total for name in names]

    def most_repeated(exponent: float) -> float:
        rates = [w / p for w, p in zip(_weights(shares, exponent), shares, strict=True)]
        return max(rates) / min(rates)

    exponent = _least(lambda a: most_repeated(a) <= max_repeats * (1 + 1e-12))
    if target_entropy is not None:
        goal = target_entropy * math.log(len(names))
        # Entropy only falls from 0 to 1: the greatest exponent that reaches the goal.
        low, high = 0.0, 1.0
        if _entropy(_weights(shares, 1.0)) >= goal:
            low = 1.0
        else:
            for _ in range(_STEPS):
                middle = (low + high) / 2
                enough = _entropy(_weights(shares, middle)) >= goal
                low, high = (middle, high) if enough else (low, middle)
        exponent = max(exponent, low)
    return exponent, dict(zip(names, _weights(shares, exponent), strict=True))


def _uniform(*parts) -> F.Column:
    """A number in (0, 1] that depends on `parts` only."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *parts), 11) + F.lit(1)) / F.lit(float(2**53))


def _added(docs: DataFrame) -> list[str]:
    """The names of the schedule's columns."""
    return [free_name(name, docs.columns) for name in ("copy", "tokens", "weight", "block", "order_key")]


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    tokens_col: str | None = None,
    max_repeats: float = MAX_REPEATS,
    target_entropy: float | None = None,
    budget_tokens: int | None = None,
    blocks: int = BLOCKS,
) -> DataFrame:
    """`docs` as scheduled, a row for each document and `copy`, with
    `tokens, weight, block, order_key`. `tokens_col` names token counts that are
    known already; otherwise the words of `text` are counted.

    Without `budget_tokens` the budget is the least one that takes each document
    at least once, so nothing is left out. With a budget, a document belongs to
    the last, partial epoch if the tokens before it in that epoch's order are
    fewer than what is left of its source's budget.

    Cases. NULL is a source of its own. A document without tokens takes nothing
    of a budget; a source without any has no weight, and its documents are
    scheduled once, unless a budget is given. Rows with equal ids are scheduled
    alike, NULL ids too; repeated rows each have their own. A very long text
    counts with all its tokens, in one task. Columns of `docs` stay, whatever
    their names; an added column whose name is taken, in any letter case, gets
    underscores behind it. An empty table gives an empty schedule.
    """
    added = _added(docs)
    own = [quoted(c) for c in docs.columns]
    read = docs.select(
        F.struct(*own).alias("row"),
        F.to_json(F.struct(F.col("source").cast("string").alias("s"))).alias("mix_source"),
        F.coalesce(quoted(tokens_col) if tokens_col else token_count("text"), F.lit(0)).alias("n_tokens"),
        quoted(id_col).cast("string").alias("mix_id"),
    )
    counts = {
        r.mix_source: (r.n, r.docs)
        for r in read.groupBy("mix_source").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs")).collect()
    }
    _, weights = temperature(
        {s: n for s, (n, _) in counts.items()}, max_repeats=max_repeats, target_entropy=target_entropy
    )
    if budget_tokens is None:
        budget = max((counts[s][0] / w for s, w in weights.items()), default=0.0)
    else:
        budget = float(budget_tokens)
    plan = []
    for source, (n, _) in counts.items():
        if source in weights:
            quota = weights[source] * budget
            epochs = int(quota / n * (1 + 1e-12))
            left = max(0, round(quota - epochs * n))
            left = left if left > n * 1e-9 else 0
            plan.append((source, weights[source], epochs, left, epochs + left / n))
        else:
            epochs = 1 if budget_tokens is None else 0
            plan.append((source, 0.0, epochs, 0, float(epochs)))
    spark = docs.sparkSession
    # A row for each source: as many as the group-by above has brought here.
    quotas = spark.createDataFrame(plan, "mix_source string, weight double, epochs int, left_tokens long, rounds double")
    dealt = read.join(F.broadcast(quotas), "mix_source")

    def block_of(epoch):
        return F.least(F.floor(_uniform(F.lit("block"), "mix_id", epoch) * blocks), F.lit(blocks - 1)).cast("int")

    def rank_of(source, epoch, block):
        return _uniform(F.lit("rank"), source, epoch, block)

    whole = dealt.where("epochs > 0").withColumn("copy", F.explode(F.expr("sequence(1, epochs)"))).withColumn(
        "block", block_of(F.col("copy"))
    )
    # The last epoch: whole blocks while the budget lasts, then a part of one.
    last = dealt.where("left_tokens > 0").withColumn("copy", F.col("epochs") + 1)
    last = last.withColumn("block", block_of(F.col("copy")))
    sums = last.groupBy("mix_source", "block", "copy", "left_tokens").agg(F.sum("n_tokens").alias("n"))
    in_order = Window.partitionBy("mix_source").orderBy(
        rank_of(F.col("mix_source"), F.col("copy"), F.col("block")), "block"
    )
    spent = sums.withColumn("before", F.sum("n").over(in_order) - F.col("n")).where("before < left_tokens")
    spent = spent.select("mix_source", "block", "before", (F.col("before") + F.col("n") > F.col("left_tokens")).alias("is_cut"))
    # At most `blocks` rows for each source.
    open_blocks = last.join(F.broadcast(spent), ["mix_source", "block"])
    # The cut block has a second level: parts of it in its own order, of which one is cut.
    place_within = _uniform(F.lit("within"), "mix_id", "copy")
    inner = open_blocks.where("is_cut").withColumn(
        "part", F.least(F.floor(place_within * blocks), F.lit(blocks - 1)).cast("int")
    )
    by_part = inner.groupBy("mix_source", "part", "before", "left_tokens").agg(F.sum("n_tokens").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("mix_source").orderBy("part")) - F.col("n")
    by_part = (
        by_part.withColumn("ahead", F.col("before") + so_far)
        .where("ahead < left_tokens")
        .select("mix_source", "part", "ahead", (F.col("ahead") + F.col("n") >= F.col("left_tokens")).alias("ends"))
    )
    # At most `blocks` rows for each source.
    inner = inner.join(F.broadcast(by_part), ["mix_source", "part"])
    within = Window.partitionBy("mix_source").orderBy(place_within, "mix_id", F.xxhash64("row")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    # A part is 1 / blocks^2 of a source.
    last_part = inner.where("ends").withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    cut = inner.where("NOT ends").drop("part", "ahead", "ends", "before", "is_cut").unionByName(
        last_part.where("ahead + inner < left_tokens").drop("inner", "part", "ahead", "ends", "before", "is_cut")
    )
    full = open_blocks.where("NOT is_cut").drop("before", "is_cut")
    scheduled = whole.unionByName(full.select(*whole.columns)).unionByName(cut.select(*whole.columns))
    place = (
        F.floor(rank_of(F.col("mix_source"), F.col("copy"), F.col("block")) * blocks)
        + _uniform(F.lit("within"), "mix_id", "copy")
    ) / (blocks + 1)
    return scheduled.select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns],
        F.col("copy").alias(added[0]),
        F.col("n_tokens").alias(added[1]),
        F.col("weight").alias(added[2]),
        F.col("block").alias(added[3]),
        F.least((F.col("copy") - 1 + place) / F.col("rounds"), F.lit(1.0)).alias(added[4]),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule of all documents: ids and places, without their texts."""
    counted = stash(
        table(spark, sf_dir, "documents").select("doc_id", "source", token_count("text").alias("n_words"))
    )
    return mix(counted, tokens_col="n_words").drop("n_words")
