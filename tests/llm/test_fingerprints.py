"""Fingerprints against sets of paragraphs and plain string work."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from sigillum.llm import fingerprints as module
from sigillum.llm.fingerprints import PIECE_WORDS, fingerprints, paragraph_digests, recovered_digests

SCHEMA = "doc_id long, text string"
SPACE = "\x20\x09-\x0D"


def pieces(text):
    found = set()
    for line in (text or "").split("\n"):
        words = list(re.finditer(rf"[^{SPACE}]+", line))
        for k in range(0, len(words), PIECE_WORDS):
            some = words[k : k + PIECE_WORDS]
            found.add(line[some[0].start() : some[-1].end()])
    return found


def likeness(a, b):
    a, b = pieces(a), pieces(b)
    return 1.0 if not a and not b else 1 - len(a ^ b) / (len(a) + len(b))


def brute_force(rows):
    """Rows in order of descending id, of equal ids in the order given."""
    rows = [(doc_id, text or "") for doc_id, text in rows]
    out = []
    for k, (doc_id, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), likeness(text, edited), likeness(text, after)))
    return out


def run(spark, rows, **options):
    df = fingerprints(spark.createDataFrame(rows, SCHEMA), **options)
    assert df.columns == [
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    ]
    return df.collect()


def corpus(seed, n):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.2:
            texts.append(rng.choice(texts))
            continue
        lines = [
            " ".join(rng.choice(["é", "b", "word", "😀", "x"]) + str(rng.randint(0, 30)) for _ in range(rng.randint(0, 40)))
            for _ in range(rng.choice([0, 1, 3, 8, 60]))
        ]
        texts.append(rng.choice(["\n", " \n\t", "\r\n"]).join(lines))
    ids = rng.sample(range(-1000, 100_000), n)
    return list(zip(ids, texts, strict=True))


def test_agrees_with_sets_of_paragraphs(spark):
    rows = corpus(1, 120)
    expected = {e[0]: e for e in brute_force(sorted(rows, reverse=True))}
    found = run(spark, rows)
    assert len(found) == len(rows)
    for r in found:
        _, n_chars, sha, near_edited, near_next = expected[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n_chars, sha)
        assert r.near_edited == pytest.approx(near_edited) and r.near_next == pytest.approx(near_next)
    texts, prints = dict(rows), {}
    for r in found:
        assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert len(set(prints.values())) == len({frozenset(pieces(t)) for t in prints})


def test_edge_cases(spark):
    long_text = "\n".join(f"line {k}" for k in range(4000))
    rows = [(9, long_text), (8, None), (7, ""), (6, " \n\n "), (5, "a"), (4, "same text"), (3, "same text"), (2, long_text)]
    expected = {e[0]: e for e in brute_force(rows)}
    for r in run(spark, rows):
        assert (r.doc_id, r.n_chars, r.edited_sha256) == expected[r.doc_id][:3]
        assert (r.near_edited, r.near_next) == pytest.approx(expected[r.doc_id][3:])
    assert run(spark, []) == []
    (alone,) = run(spark, [(1, "abc def")])
    assert alone.near_next == 1 and alone.edited_sha256 == brute_force([(1, "abc def")])[0][2]
    # Rows of one id are neighbours; one without an id is its own next document.
    twice = run(spark, [(1, "abc def"), (1, "abc def"), (None, "xyz"), (None, None)])
    assert sorted((r.doc_id or 0, r.near_next) for r in twice) == [(0, 1), (0, 1), (1, 1), (1, 1)]
    wide = spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA).withColumn("id", F.lit(1)).withColumn("run", F.lit(2))
    assert fingerprints(wide).count() == 2


@pytest.mark.parametrize("cells", [3, 36])
def test_peeling_recovers_the_digests_that_differ(spark, cells):
    rng = random.Random(4)
    rows = []
    for k in range(30):
        shared = [rng.getrandbits(63) for _ in range(rng.randint(0, 50))]
        left, right = ([rng.getrandbits(63) - 2**62 for _ in range(rng.randint(0, 3**rng.randint(0, 4)))] for _ in "ab")
        rows.append((k, shared + left, shared + right))
    df = spark.createDataFrame(rows, "id long, a array<long>, b array<long>")
    found = {(r.id, r.digest, r.is_left) for r in recovered_digests(df, "a", "b", cells=cells).collect()}
    assert found == {
        (k, d, d in set(a)) for k, a, b in rows for d in set(a) ^ set(b)
    }


def test_digests_ignore_space_around_paragraphs(spark):
    df = spark.createDataFrame([("a b\nc", "a b \t\n\n  c\r\n")], "x string, y string")
    row = df.select(paragraph_digests(F.col("x")).alias("x"), paragraph_digests(F.col("y")).alias("y")).first()
    assert row.x == row.y and len(row.x) == 2


def test_plan_has_no_python(spark):
    plan = fingerprints(spark.createDataFrame([(1, "a")], SCHEMA)).explain
    import contextlib
    import io

    with contextlib.redirect_stdout(io.StringIO()) as out:
        plan()
    assert not re.search("Python|Pandas|Arrow", out.getvalue())


def test_sketches_get_the_size_of_the_difference_at_once(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(module, "stash", lambda df, stash=module.stash: stored.append(df.columns) or stash(df))
    rows = [(k, "\n".join(f"{k} line {j}" for j in range(4 ** (k % 7)))) for k in range(21)]
    expected = {e[0]: e for e in brute_force(sorted(rows, reverse=True))}
    for r in run(spark, rows):
        assert (r.near_edited, r.near_next) == pytest.approx(expected[r.doc_id][3:])
    # Up to 5120 digests differ; from 36 cells up by 4, that would be five tries.
    assert 1 <= sum("left" in columns for columns in stored) <= 2


def test_tasks_follow_the_number_of_digests(spark, monkeypatch):
    rows = spark.createDataFrame([(k, [1, 2, 3], [4, 5]) for k in range(20)], "id long, a array<long>, b array<long>")
    sides = {"own": "a", "next": "b"}
    assert module._tasks(rows, sides) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(module, "TASK_DIGESTS", 10)
    assert module._tasks(rows, sides) == 10
    assert module._tasks(rows.limit(0), sides) == int(spark.conf.get("spark.sql.shuffle.partitions"))
