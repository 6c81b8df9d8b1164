"""Mixing against plain arithmetic over all documents."""

import json
import math
import random
import struct
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from sigillum.llm import mixing
from sigillum.llm.mixing import mix, temperature

SCHEMA = "doc_id long, source string, text string"


def entropy(weights):
    return -sum(w * math.log(w) for w in weights if w)


def test_exponent_meets_the_repetition_limit():
    tokens = {"a": 9000, "b": 900, "c": 100}
    for limit in (1.0, 1.5, 3.0, 90.0, 1000.0):
        exponent, weights = temperature(tokens, max_repeats=limit)
        rates = [weights[s] / tokens[s] for s in tokens]
        assert sum(weights.values()) == pytest.approx(1)
        # p^(a-1) spans 90^(1-a): the least exponent in closed form.
        assert exponent == pytest.approx(max(0, 1 - math.log(limit) / math.log(90)), abs=1e-9)
        assert max(rates) / min(rates) <= limit * (1 + 1e-9)


def test_exponent_meets_the_entropy():
    tokens = {"a": 9000, "b": 900, "c": 100}
    found = entropy(n / 10_000 for n in tokens.values())
    for goal in (found / math.log(3) / 2, 0.5, 0.8, 0.99, 1.0):
        exponent, weights = temperature(tokens, max_repeats=1e9, target_entropy=goal)
        assert entropy(weights.values()) >= min(1.0, goal) * math.log(3) - 1e-6
        assert exponent == (1 if found >= goal * math.log(3) else pytest.approx(exponent)) and 0 <= exponent <= 1
        if 0 < exponent < 1:
            assert entropy(weights.values()) == pytest.approx(goal * math.log(3), abs=1e-6)


def test_sources_without_tokens_have_no_weight():
    assert temperature({}) == (1.0, {})
    assert temperature({"a": 0}) == (1.0, {})
    assert temperature({"a": 5, "b": 0})[1] == {"a": 1.0}


def corpus(seed=1, sizes=(("a", 300), ("b", 60), ("c", 25))):
    rng = random.Random(seed)
    rows = [(s, " ".join("w" * rng.randint(1, 40))) for s, n in sizes for _ in range(n)]
    return [(k, *row) for k, row in enumerate(rows)]


def totals(rows):
    found = Counter()
    for r in rows:
        found[r.source] += r.tokens
    return found


def test_every_document_is_taken_and_weights_are_met(spark):
    rows = corpus()
    df = mix(spark.createDataFrame(rows, SCHEMA), max_repeats=3.0)
    assert df.columns == ["doc_id", "source", "text", "copy", "tokens", "weight", "block", "order_key"]
    out = df.collect()
    assert {r.doc_id for r in out} == {r[0] for r in rows}
    assert all(r.tokens == len(r.text.split()) for r in out)
    tokens = totals(out)
    share = {s: n / sum(tokens.values()) for s, n in tokens.items()}
    weights = {r.source: r.weight for r in out}
    assert all(abs(share[s] - weights[s]) < 0.01 for s in weights)
    copies = defaultdict(list)
    for r in out:
        copies[r.doc_id].append(r.copy)
    assert all(sorted(c) == list(range(1, len(c) + 1)) and len(c) <= 3 for c in copies.values())
    assert all(0 < r.order_key <= 1 for r in out)
    # The target weights hold along the stream, not only at its end.
    first = totals(r for r in out if r.order_key < 0.5)
    assert all(abs(first[s] / sum(first.values()) - weights[s]) < 0.1 for s in weights)


@pytest.mark.parametrize("blocks", [1, 16])
def test_budget_is_spent_to_the_document(spark, blocks):
    """The last epoch takes documents in its order until what is left is used up."""
    rows = corpus(2)
    budget = 3000
    out = mix(spark.createDataFrame(rows, SCHEMA), max_repeats=3.0, budget_tokens=budget, blocks=blocks).collect()
    largest = max(len(r[2].split()) for r in rows)
    spent = totals(out)
    for source, weight in {r.source: r.weight for r in out}.items():
        assert 0 <= spent[source] - round(weight * budget) < largest
    again = mix(
        spark.createDataFrame(rows[::-1], SCHEMA).repartition(7), max_repeats=3.0, budget_tokens=budget, blocks=blocks
    ).collect()
    assert sorted(out) == sorted(again)


def test_edge_cases(spark):
    rows = [(1, None, "a b"), (2, None, None), (3, "s", ""), (4, "s", " "), (4, "s", " "), (None, "t", "c d e"), (None, "t", "c d e")]
    out = mix(spark.createDataFrame(rows, SCHEMA).withColumn("mix_source", F.lit(1)).withColumn("row", F.lit(2))).collect()
    assert Counter((r.doc_id, r.source, r.copy) for r in out if r.copy == 1) == Counter((a, b, 1) for a, b, _ in rows)
    assert {r.source: r.weight for r in out}["s"] == 0
    assert mix(spark.createDataFrame([], SCHEMA)).collect() == []


def test_names_of_any_kind_stay(spark):
    rows = [(1, "s", "a b", 1, 2, 3, 4)]
    names = ["Copy", "to`kens", "we.ight", "tokens"]
    docs = spark.createDataFrame(rows, SCHEMA + ", k0 int, k1 int, k2 int, k3 int").toDF("doc_id", "source", "text", *names)
    out = mix(docs)
    assert out.columns == [*docs.columns, "copy_", "tokens_", "weight", "block", "order_key"]
    (row,) = out.collect()
    assert tuple(row)[:9] == (1, "s", "a b", 1, 2, 3, 4, 1, 2)


def uniform(*parts):
    """Spark's chained xxhash64 as a number in (0, 1]."""
    found = 42
    for part in (mixing.SEED, *parts):
        data = part.encode() if isinstance(part, str) else struct.pack("<i", part)
        found = xxhash.xxh64(data, seed=found).intdigest()
    return ((found >> 11) + 1) / 2**53


def schedule(rows, max_repeats, budget, blocks):
    """`(doc_id, copy, block)` of every scheduled row, by plain arithmetic."""
    of_source = defaultdict(list)
    for doc_id, source, text in rows:
        of_source[source].append((str(doc_id), len(text.split())))
    tokens = {json.dumps({"s": s}, separators=(",", ":")): sum(n for _, n in docs) for s, docs in of_source.items()}
    _, weights = temperature(tokens, max_repeats=max_repeats)
    whole = budget if budget is not None else max(tokens[s] / w for s, w in weights.items())
    found = set()
    for source, docs in of_source.items():
        name = json.dumps({"s": source}, separators=(",", ":"))
        quota = weights[name] * whole
        epochs = int(quota / tokens[name] * (1 + 1e-12))
        left = max(0, round(quota - epochs * tokens[name]))
        left = left if left > tokens[name] * 1e-9 else 0

        def block_of(doc_id, epoch):
            return min(int(uniform("block", doc_id, epoch) * blocks), blocks - 1)

        for epoch in range(1, epochs + 1):
            found |= {(int(d), epoch, block_of(d, epoch)) for d, _ in docs}
        epoch, before = epochs + 1, 0
        order = [(uniform("rank", name, epoch, block_of(d, epoch)), block_of(d, epoch), uniform("within", d, epoch), d, n)
                 for d, n in docs]
        for _, block, _, d, n in sorted(order):
            if before < left:
                found.add((int(d), epoch, block))
            before += n
    return found


@pytest.mark.parametrize("blocks", [1, 3, 16, 1024])
@pytest.mark.parametrize("budget", [None, 700, 3000, 9001])
def test_the_whole_schedule_equals_plain_arithmetic(spark, blocks, budget):
    rows = corpus(blocks)
    out = mix(spark.createDataFrame(rows, SCHEMA), max_repeats=3.0, budget_tokens=budget, blocks=blocks).collect()
    assert len(out) == len({(r.doc_id, r.copy) for r in out})
    assert {(r.doc_id, r.copy, r.block) for r in out} == schedule(rows, 3.0, budget, blocks)


def test_query_takes_the_whole_table(spark):
    import __spark_entry__ as contract

    sf_dir = "/root/testdata/sf0.01"
    out = contract.queries()["op8_mixing"](spark, sf_dir).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
