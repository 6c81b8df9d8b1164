"""Quality: EM on planted labellers, features against a plain version, accuracy without labels."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigillum.llm import quality
from sigillum.llm.quality import LABELLERS, Accuracies, Scorer, hashed_features, votes

SCHEMA = "doc_id long, text string"


def test_em_recovers_planted_accuracies():
    rng = np.random.default_rng(1)
    n, j = 60_000, len(LABELLERS)
    good = rng.random(n) < 0.7
    right = rng.uniform(0.65, 0.95, (2, j))  # chance of the right vote on bad and on good ones
    silent = rng.random((n, j)) < 0.3
    is_right = rng.random((n, j)) < np.where(good[:, None], right[1], right[0])
    cast = np.where(silent, 2, np.where(is_right, good[:, None], ~good[:, None]))
    patterns = {}
    for row in cast:
        key = "".join(map(str, row))
        patterns[key] = patterns.get(key, 0) + 1
    found = Accuracies(patterns)
    assert found.prior == pytest.approx(0.7, abs=0.02)
    assert np.allclose(found.chance[1], right[1], atol=0.03) and np.allclose(1 - found.chance[0], right[0], atol=0.03)
    assert found.of("1" * j) > 0.99 > 0.01 > found.of("0" * j)
    assert found.of("2" * j) == pytest.approx(found.prior)


def test_no_patterns():
    assert 0 < Accuracies({}).of("2" * len(LABELLERS)) < 1


def test_features_of_equal_words_are_equal():
    texts = ["Ab ab ab,", "ab", "", " \n", "é é", "x" * 5000, "ab Ab"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    text, bucket, words = hashed_features(raw, offsets)
    assert words.tolist() == [len(t.split()) for t in texts]
    n = len(text) // 3
    whole = [bucket[:n][text[:n] == k].tolist() for k in range(len(texts))]
    shape = [bucket[n : 2 * n][text[:n] == k].tolist() for k in range(len(texts))]
    again = [bucket[2 * n :][text[:n] == k].tolist() for k in range(len(texts))]
    assert whole[0][1] == whole[1][0] == whole[6][0] and whole[0][0] == whole[6][1] != whole[0][1]
    assert shape[0][1] == shape[1][0] == shape[4][0] == shape[5][0] != shape[0][0]
    assert again[4][0] != again[4][1] and again[0][0] == again[0][1]


def test_scorer_learns_its_targets():
    texts = ["the water is cold and the stone is wet"] * 60 + ["### $$$ %%% ### $$$"] * 60
    target = np.array([0.9] * 60 + [0.1] * 60)
    scorer = Scorer().train(pa.array(texts), target)
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    assert np.abs(scorer.scores(raw, offsets) - target).max() < 0.1


def test_votes_of_plain_cases():
    prose = "The water of the river is cold in the spring, and it is not safe to swim in it. " * 3
    assert 0 not in votes(prose)
    for junk in ("### $$$ %%% &&& " * 20, "OF!! THE!! AND!! " * 30, "of of of of the the the the " * 20):
        assert 0 in votes(junk)
    assert votes("")[-1] == 0


def test_edge_cases(spark):
    prose = "The water of the river is cold in the spring, and it is not safe to swim in it at all."
    rows = [(k, f"{prose} Number {k} of them.") for k in range(40)] + [(100 + k, "### $$$ %%% ") for k in range(10)]
    more = [(1, None), (2, ""), (3, " \n"), (4, prose * 5000), (None, prose), (5, prose), (5, prose)]
    wide = spark.createDataFrame(rows + more, SCHEMA).withColumn("score", F.lit("x")).withColumn("k", F.lit(1))
    df = quality.quality(wide)
    assert df.columns == ["doc_id", "score", "kept"]
    found = df.collect()
    assert len(found) == len(rows) + len(more)
    assert all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in found)
    assert sum(not r.kept for r in found if r.doc_id in (1, 2)) >= 2
    assert quality.quality(wide.limit(0)).collect() == []


def test_query_against_labels_it_never_saw(spark):
    import __spark_entry__ as contract

    sf_dir = "/root/testdata/sf0.1"
    both = contract.queries()["op2_quality"](spark, sf_dir).join(
        spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id"
    ).collect()
    good, bad = ([r for r in both if r.quality == q] for q in (1, 0))
    assert np.mean([r.kept for r in good]) > 0.99
    assert np.mean([r.kept for r in bad]) < 0.03


def test_every_pattern_fits_the_bound():
    assert len(list(itertools.product("012", repeat=len(LABELLERS)))) == 19683
