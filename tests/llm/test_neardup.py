"""Near-duplicates against all pairs."""

import random
import re

import pytest

from sigillum.llm import links, neardup
from sigillum.llm.neardup import drop_near_duplicates, near_duplicates

SCHEMA = "doc_id long, text string"


def word_set(text, words):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1)))


def brute_force(rows, words):
    sets = [(doc_id, word_set(text, words)) for doc_id, text in rows]
    least = {doc_id: doc_id for doc_id, _ in rows if doc_id is not None}
    changed = True
    while changed:
        changed = False
        for i, (a, left) in enumerate(sets):
            for b, right in sets[:i]:
                if a is None or b is None or not left or not right or least[a] == least[b]:
                    continue
                common = len(left & right)
                if 100 * common >= 80 * (len(left) + len(right) - common):
                    least[a] = least[b] = min(least[a], least[b])
                    changed = True
    return sorted(
        ((doc_id, len(found), least.get(doc_id), least.get(doc_id) == doc_id) for doc_id, found in sets), key=repr
    )


def run(spark, rows, words=4):
    df = near_duplicates(spark.createDataFrame(rows, SCHEMA), words=words)
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(row) for row in df.collect()), key=repr)


def families(seed, groups, copies, changes, length=(5, 160)):
    """Texts with copies that differ in a few words: near the limit, so chains and stars occur."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(500)]
    texts = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(*length))
        for _ in range(rng.randint(1, copies)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, int(len(words) * changes)))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    rng.shuffle(texts)
    return list(enumerate(texts, start=1))


def test_agrees_with_all_pairs(spark):
    rows = families(1, 40, 8, 0.06)
    expected = brute_force(rows, 4)
    assert len({c for _, _, c, _ in expected}) not in (1, len(rows))
    assert run(spark, rows) == expected


def test_links_that_no_star_shows(spark, monkeypatch):
    """One large family around the limit; blocks of four make many pairs of blocks."""
    monkeypatch.setattr(links, "BLOCK", 4)
    rows = families(2, 2, 90, 0.05, (120, 130))
    expected = brute_force(rows, 4)
    assert len({c for _, _, c, _ in expected}) > 2
    assert run(spark, rows) == expected


@pytest.mark.parametrize("words", [1, 5])
def test_edge_cases(spark, words):
    long_text = " ".join(f"x{k % 9000}" for k in range(60_000))
    rows = [
        (1, None), (2, ""), (3, " \t\r\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, long_text),
        (8, long_text + " more"), (9, "É a b c d"), (10, "é a b c d"), (11, "a b"), (12, "a b"),
        (13, "one"), (4, "one"), (None, "one"), (None, None),
    ]
    assert run(spark, rows, words) == sorted(
        [r if r[0] is not None else (None, r[1], None, True) for r in brute_force(rows, words)], key=repr
    )


def test_empty_table_and_further_columns(spark):
    assert run(spark, []) == []
    rows = spark.createDataFrame(
        [(1, "a b c d e f g", "x", 3, "k"), (2, "a b c d e f g", None, 4, None)],
        "doc_id long, text string, component_id string, node int, key string",
    )
    kept = drop_near_duplicates(rows)
    assert [tuple(r) for r in kept.collect()] == [(1, "a b c d e f g", "x", 3, "k")]
    assert kept.columns == rows.columns


def test_sketch_agrees_as_often_as_sets_overlap():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (4, 40, 4000):
        agreed = []
        for _ in range(30):
            shared, left, right = np.split(rng.integers(0, 2**64, n * 3 // 2, dtype=np.uint64), [n // 2, n])
            a, b = (np.unique(np.concatenate((shared, x))) for x in (left, right))
            agreed.append((neardup.signature(a) == neardup.signature(b)).mean())
        assert abs(np.mean(agreed) - 1 / 3) < 0.08
