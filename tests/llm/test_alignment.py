"""Alignment of two tokenizers against plain Python over whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sigillum.llm import alignment
from sigillum.llm.common import stash, table

SF_DIR = "/root/testdata/sf0.001"
FIRST = Tokenizer.from_file(alignment.BYTE_BPE)
FIRST.encode_special_tokens = True
SECOND = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_BPE)
TOKENIZERS = alignment.Tokenizers(alignment.BYTE_BPE, alignment.PIECE_BPE)
ALIGNER = alignment.Aligner(TOKENIZERS)
NONE: tuple[list, list, list] = ([], [], [])


def whole(text: str | None) -> tuple[list, list, list]:
    """Ids of both sides and the groups, from both tokenizers' own view of the whole text."""
    if not text:
        return NONE
    raw = (" " + text).encode()
    a = FIRST.encode(" " + text, add_special_tokens=False).ids
    b = SECOND.encode(text)
    a_bytes = [TOKENIZERS.a_bytes[k] for k in a]
    b_bytes = []
    for k in b:
        piece = SECOND.id_to_piece(k)
        b_bytes.append(bytes([int(piece[3:5], 16)]) if SECOND.is_byte(k) else piece.replace("▁", " ").encode())
    if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
        return NONE
    ends = [np.cumsum(list(map(len, x))).tolist() for x in (a_bytes, b_bytes)]
    groups, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        p, q = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
        groups.append((a[i:p], b[j:q]))
        i, j = p, q
    return a, b, groups


def expected(texts: dict) -> list[tuple]:
    found = {k: whole(text) for k, text in texts.items()}
    links = {k: Counter((x, y) for a, b in groups for x in a for y in b) for k, (_, _, groups) in found.items()}
    count = Counter(pair for own in links.values() for pair in own)
    most: dict[int, int] = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    rows = []
    for k, (a, b, groups) in found.items():
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((
            k, len(a), len(b), len(groups), links[k].total(),
            hashlib.sha256(text.encode()).hexdigest() if text else "",
            sum(t for p, t in links[k].items() if count[p] == most[p[0]]),
            sum(t * count[p] for p, t in links[k].items()),
        ))
    return sorted(rows)


def columns(df) -> list[tuple]:
    return sorted(map(tuple, df.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum").collect()))


def test_query_equals_plain_python(spark):
    docs = table(spark, SF_DIR, "documents").select("doc_id", "text").collect()
    assert columns(alignment.op12_alignment(spark, SF_DIR)) == expected({d.doc_id: d.text for d in docs})


ODD = ["a", "B", "é", "日本", "7", "42", " ", "  ", "\n", "\t", "\r\n", "'s", "'ll", "-", "...", " ", " ",
       "᠎", "\x1c", "\x85", "​", "▁", "<s>", "<|endoftext|>", "<0x41>", "😀", "́", "\x00", "ß", "_"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(ODD) | st.text(max_size=3), max_size=14).map("".join))
def test_pieces_give_the_tokens_of_the_whole_text(text):
    a, b, groups = whole(text)
    cut = TOKENIZERS.cut([text])
    assert (cut.a.tolist(), cut.b.tolist()) == (a, b)
    linked = ALIGNER.link(cut)
    assert linked.groups == [";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)]




def test_the_quick_encoder_does_the_same_for_every_plain_sign():
    assert TOKENIZERS.quick is not None
    signs = [chr(k) for k in range(0x2100) if alignment._PLAIN.fullmatch(chr(k))]
    assert len(signs) > 500
    texts = [t for c in signs for t in (f" {c}", f" a{c}b", f" {c}{c} x", f" 1{c}2", f" .{c}'s{c}", f" {c}\n{c}\n\n{c}")]
    assert TOKENIZERS._first_ids(texts) == [e.ids for e in FIRST.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abcdefghinorstuéßñ'-.,0123ABCeeeeaaa\n"), max_size=40))
def test_the_quick_encoder_makes_the_same_tokens(text):
    assert TOKENIZERS._first_ids([" " + text]) == [FIRST.encode(" " + text, add_special_tokens=False).ids]


@pytest.mark.parametrize("seed", range(10))
def test_gallop_finds_what_both_lists_have(seed):
    rng = np.random.default_rng(seed)
    for n, m in ((0, 5), (1, 1), (3, 4000), (700, 900), (900, 650)):
        x, y = (np.sort(rng.choice(6000, k, replace=False)) for k in (n, m))
        i, j = alignment.gallop(x, y)
        assert x[i].tolist() == y[j].tolist() == sorted(set(x.tolist()) & set(y.tolist()))


def test_large_groups_count_every_link(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("日本語テスト中文字") for _ in range(300)) for _ in range(3)]
    cut = TOKENIZERS.cut(texts)
    small = ALIGNER.link(cut)
    monkeypatch.setattr(alignment, "SMALL_GROUP", 1)
    large = ALIGNER.link(cut)
    for x, y in zip(small, large, strict=True):
        assert np.array_equal(x, y)


def test_cases(spark):
    long = "word " * 60_000
    rows = [(1, None), (2, ""), (3, " "), (4, "a ▁ b"), (5, "The cat sat. "), (5, "The cat sat. "), (None, "The cat"),
            (6, long), (7, "x" * 5000), (8, "<s> <|endoftext|>")]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, `n_a.b` string")
    held = stash(alignment.aligned(docs, block_links=4))
    assert held.where("links IS NULL").count() == len(rows)
    found = {r.doc_id: r for r in alignment.weighed(held).collect()}
    for k in (1, 2, 4):
        assert (found[k].n_a, found[k].n_b, found[k].n_links, found[k].count_sum, found[k].groups) == (0, 0, 0, 0, "")
    a, b, groups = whole("The cat sat. ")
    assert (found[5].n_a, found[5].n_b, found[5].n_groups) == (len(a), len(b), len(groups))
    assert found[5].count_sum > found[5].n_links  # three documents hold some of its links
    assert found[6].n_a == len(FIRST.encode(" " + long, add_special_tokens=False).ids)
    assert alignment.aligned(docs.limit(0)).count() == 0


def test_blocks_change_nothing(spark):
    docs = table(spark, SF_DIR, "documents").repartition(3)
    results = []
    for block_links in (100, 1 << 20):
        held = stash(alignment.aligned(docs, block_links=block_links))
        results.append(sorted(map(tuple, alignment.weighed(held).select("doc_id", "n_best", "count_sum").collect())))
    assert results[0] == results[1]
