"""Language: gradients against finite differences, and accuracy on rows nothing was learnt from."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigillum.llm import langid
from sigillum.llm.langid import Network, languages

SCHEMA = "doc_id long, text string, lang string"


def test_backpropagation_agrees_with_finite_differences():
    net, rng = Network(["a", "b", "c"]), np.random.default_rng(0)
    bytes_ = rng.integers(0, 256, (23, 5)).astype(np.uint8)
    mask = (rng.random((23, 5)) < 0.8).astype(float)
    mask = np.sort(mask, axis=0)[::-1]  # sequences of several lengths
    target = np.array([0, 1, 2, 0, 1])
    _, grads = net._step(bytes_, mask, target)
    for name, value in net.p.items():
        flat, slope = value.reshape(-1), grads[name].reshape(-1)
        for k in np.argsort(-np.abs(slope))[:4]:
            losses = []
            for step in (1e-5, -1e-5):
                flat[k] += step
                losses.append(net._step(bytes_, mask, target)[0])
                flat[k] -= step
            assert slope[k] == pytest.approx((losses[0] - losses[1]) / 2e-5, rel=1e-4, abs=1e-9)


def test_pooling_is_the_mean_over_every_byte_of_every_segment():
    net, rng = Network(["a", "b"]), np.random.default_rng(1)
    texts = [rng.integers(0, 256, n).astype(np.uint8) for n in (0, 1, langid.SEGMENT, langid.SEGMENT + 1, 700)]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    pooled = net.pooled(np.concatenate(texts), offsets)
    for text, found in zip(texts, pooled, strict=True):
        total = np.zeros(2)
        for a in range(0, len(text), langid.SEGMENT):
            piece = text[a : a + langid.SEGMENT][:, None]
            both = np.concatenate([net._run(d, piece)[0] for d in (0, 1)], axis=1)
            total += net._positions(both)[:, :, 0].sum(axis=0)
        assert np.allclose(found, total / max(1, len(text)))


def planted(n):
    words = {"xx": ["the", "of", "and", "water", "stone"], "yy": ["der", "und", "nicht", "wasser", "stein"]}
    rng = np.random.default_rng(2)
    return [(k, " ".join(rng.choice(words[lang], 12)), lang) for k, lang in enumerate(["xx", "yy"] * (n // 2))]


def test_edge_cases(spark):
    rows = planted(200)
    more = [(1000, None, "xx"), (1001, "", None), (1002, "123 !!", "yy"), (1004, "\u00b2 \u00bd \u2460 \u2167 \u0301 _", None), (1003, "nicht wasser " * 50_000, None), (None, "der stein und wasser", None), (3, *rows[3][1:])]
    wide = spark.createDataFrame(rows + more, SCHEMA).withColumn("held_out", F.lit("x")).withColumn("k", F.lit(1))
    df = languages(wide, steps=200)
    assert df.columns == ["doc_id", "held_out", "lang_pred", "score"]
    found = df.collect()
    assert len(found) == len(rows) + len(more)
    by_id = {r.doc_id: r for r in found}
    assert [(by_id[k].lang_pred, by_id[k].score) for k in (1000, 1001, 1002, 1004)] == [("und", 0)] * 4
    assert by_id[1003].lang_pred == by_id[None].lang_pred == "yy" and not by_id[None].held_out
    assert all(0 <= r.score <= 1 for r in found)
    assert np.mean([by_id[k].lang_pred == lang for k, _, lang in rows if by_id[k].held_out]) > 0.95
    assert languages(wide.limit(0), steps=1).collect() == []
    nothing = languages(wide.withColumn("lang", F.lit(None).cast("string")), steps=1)
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    one = languages(wide.withColumn("lang", F.lit("zz")), steps=1)
    assert {r.lang_pred for r in one.collect()} == {"zz", "und"}


def test_query_on_held_out_rows(spark):
    import __spark_entry__ as contract

    sf_dir = "/root/testdata/sf0.01"
    found = contract.queries()["op10_language"](spark, sf_dir)
    both = found.join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id").where("held_out").collect()
    assert len(both) > 200
    assert np.mean([r.lang_pred == r.lang for r in both]) > 0.97
