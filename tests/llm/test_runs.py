"""Periodic runs against brute force, and the query against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from sigillum.llm import runs
from sigillum.llm.common import table

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words: list[str]) -> list[tuple[int, int, int]]:
    """Every stretch of equal words `q` apart, of every `q`."""
    found: dict[tuple[int, int], int] = {}
    ids = np.unique(np.array(words, object), return_inverse=True)[1] if words else np.zeros(0)
    for q in range(1, len(words) // 4 + 1):
        edge = np.diff(np.concatenate(([0], ids[:-q] == ids[q:], [0])).astype(int))
        for start, end in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + q, strict=True):
            if end - start >= max(6, 4 * q):
                found.setdefault((int(start), int(end)), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def kept(words: list[str], found: list[tuple[int, int, int]]) -> list[str]:
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    return [w for k, w in enumerate(words) if k not in gone]


def edited(doc_id: int | None, words: list[str]) -> list[str]:
    if doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id: int | None, text: str | None) -> tuple:
    words = edited(doc_id, WORD.findall(text or ""))
    found = brute(words)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else None
    start, length, period = best or (None,) * 3
    return (
        doc_id, len(found), start, length, period, 1000 * length // period if best else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(kept(words, found))),
    )


def test_the_cover_has_every_difference():
    assert {(a - b) % runs.PERIOD for a in runs.COVER for b in runs.COVER} == set(range(runs.PERIOD))


@pytest.mark.parametrize("seed", range(6))
def test_extensions_equal_plain_comparison(seed):
    rng = np.random.default_rng(seed)
    body = rng.integers(1, 3, 700)
    body[300:500] = body[np.arange(300, 500) % (7 + seed)]
    seq = np.concatenate(([3], body, [4])).astype(np.int64)
    i, j = rng.integers(0, len(seq) - 1, (2, 4000))
    i, j = np.minimum(i, j), np.maximum(i, j)
    i, j = i[i < j], j[i < j]
    expect = []
    for a, b in zip(i, j, strict=True):
        n = 0
        while seq[a + n] == seq[b + n]:
            n += 1
        expect.append(n)
    assert runs.Extensions(seq)(i, j).tolist() == expect
    assert runs.Sample(seq).least[0].tolist()[0] >= 0


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(rng.randint(1, 6)):
        words = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            unit = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 45))]
            words += unit * rng.randint(1, 7) + unit[: rng.randint(0, len(unit))]
        texts.append(words)
    encoded = [[w.encode() for w in words] for words in texts]
    for words, (found, left) in zip(texts, runs._found_in(encoded), strict=True):
        expect = brute(words)
        assert [(r["start"], r["length"], r["period"]) for r in found] == expect
        assert left.decode().split() == kept(words, expect)


def test_a_very_long_text_of_one_word():
    (found, left), = runs._found_in([[b"la"] * 200_000])
    assert found == [{"start": 0, "length": 200_000, "period": 1}] and left == b"la"


def test_questions_come_some_at_a_time(monkeypatch):
    words = [str(k % 37).encode() for k in range(900)] + [b"x"] * 9
    whole = list(runs._found_in([words]))
    monkeypatch.setattr(runs, "QUESTIONS", 50)
    assert list(runs._found_in([words])) == whole


def test_cases(spark):
    rows = [
        (None, "a a a a a a b", 1), (1, None, 1), (2, "", 1), (3, " \t\n ", 1),
        (4, "x y x y x y x y", 1), (4, "x y x y x y x y", 1), (5, "é é é é é é é", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `runs.start` int")
    found = runs.periodic_runs(docs).collect()
    assert sorted((r.doc_id or 0, r.n_words, len(r.runs), r.collapsed) for r in found) == [
        (0, 7, 1, "a b"), (1, 0, 0, ""), (2, 0, 0, ""), (3, 0, 0, ""),
        (4, 8, 1, "x y"), (4, 8, 1, "x y"), (5, 6, 0, "é é é é é é é"),
    ]
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_ties_take_the_first_run(spark):
    docs = spark.createDataFrame([(7, "a a a a a a - b b b b b b")], "doc_id long, text string")
    row = runs.run_digests(runs.periodic_runs(docs)).first()
    assert (row.start, row.length, row.period, row.exponent_milli) == (0, 6, 1, 6000)


def test_query_equals_plain_python(spark):
    docs = table(spark, SF_DIR, "documents").select("doc_id", "text").collect()
    found = sorted(map(tuple, runs.op13_runs(spark, SF_DIR).collect()))
    assert found == sorted(expected(d.doc_id, d.text) for d in docs)
