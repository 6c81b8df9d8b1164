"""Which tokens of two tokenizers cover the same bytes, and how often over a corpus.

Both tokenizers cut the same bytes. Where a token of each ends at one offset,
both texts can be cut; between two such offsets lies a group, whose tokens of
one side are linked with all of the other. The common offsets come from a
galloping intersection: the shorter list of ends drives an exponential and then
a binary search into the longer one, from the place of the last anchor on;
anchors are found likewise, from coarser ones.

Steps, each a Spark job over all documents:

1. A task encodes its texts, cuts them into groups and takes each document's
   distinct links with their number. Documents with about `BLOCK_LINKS` links
   are a block; a block's links are numbered, and it counts its documents.
2. Counts of blocks are added up for each pair of ids.
3. Each block asks for its own links' counts, once for all its documents, and
   its documents are weighed against the answer. So what is shuffled follows the
   distinct links of blocks, not of documents, and no group is more than a block.
"""

from __future__ import annotations

import json
import os
import re
import sys
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, count, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lookup import lookup
from .common import slices, stash, table

# Sent with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
BLOCK_LINKS = 1 << 19
MOST_KEPT, MOST_CHARS = 1 << 18, 1 << 23  # pieces of text whose tokens a task remembers
SMALL_GROUP = 4096  # links of a group that are taken one by one
ANCHORS = (512, 64, 8, 1)

_SPACE = "▁"
_SPACE_AFTER_SPACE = re.compile("\\A |[\\s\u180e] ")
_ENDS_IN_SPACE = re.compile("[\\s\u180e]\\Z")

# How byte-level vocabularies take texts apart, and signs that every
# version of Unicode takes for the same kind of sign.
_WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\u024f\u2010-\u2027\u2030-\u203a\u20ac]*")


class Cut(NamedTuple):
    """The tokens of some texts: ids and ends in bytes, and whether they give back their text."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    a_first: np.ndarray  # of each text, and the end
    b_first: np.ndarray


def _byte_signs() -> dict[str, int]:
    """The signs byte-level vocabularies write bytes with: printable ones stand for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers. Texts are encoded piece by piece, and pieces remembered.

    A piece starts with a space that follows a sign other than white space. No
    token of either side crosses such a place: the byte-level pattern has a space
    only at the start of a word or among white space, and no piece of the other
    vocabulary has a space after another sign. Where that does not hold for a
    vocabulary, whole texts are encoded.
    """

    def __init__(self, byte_bpe: str, piece_bpe: str) -> None:
        # A task has one core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        with open(byte_bpe, encoding="utf-8") as file:
            spec = json.load(file)
        self.first = Tokenizer.from_file(byte_bpe)
        self.first.encode_special_tokens = True
        signs = _byte_signs()
        names = self.first.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, k in names.items():
            self.a_bytes[k] = bytes(signs[c] for c in name) if all(c in signs for c in name) else name.encode()
        self.second = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        pieces = [self.second.id_to_piece(k) for k in range(self.second.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.second.is_byte(k) else p.replace(_SPACE, " ").encode()
            for k, p in enumerate(pieces)
        ]
        self.space = self.second.piece_to_id(_SPACE)
        before = spec.get("pre_tokenizer") or {}
        self.has_pieces = (
            spec.get("normalizer") is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space")
            and not any(_SPACE in p.lstrip(_SPACE) for p in pieces)
            and self.second.encode("a  b \n c") == self.second.encode("a") + self.second.encode(" b \n c")
        )
        self.a_names, self.b_names = pa.array(self.a_bytes, pa.binary()), pa.array(self.b_bytes, pa.binary())
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        self.quick = self._quick(spec) if self.has_pieces else None
        self._forget()

    def _forget(self) -> None:
        self.known = defaultdict(count().__next__)
        self.kept = 0
        self.is_whole = np.zeros(0, bool)
        self.tokens = {side: (np.zeros(0, np.int32), np.zeros(1, np.int64)) for side in "ab"}

    def _pieces(self, text: str) -> list[str]:
        """The pieces of a space and `text`, each without its first space."""
        if not self.has_pieces:
            return [text]
        plain = text.split(" ")
        if not _SPACE_AFTER_SPACE.search(text):
            return plain
        found, open_end = [], None
        for piece in plain:
            if open_end is not None:
                piece, open_end = open_end + " " + piece, None
            if not piece or _ENDS_IN_SPACE.search(piece):
                open_end = piece
            else:
                found.append(piece)
        if open_end is not None:
            found.append(open_end)
        return found

    def _learn(self, pieces: list[str]) -> None:
        """Encodes new pieces, which have the next numbers."""
        for start in range(0, len(pieces), 1 << 14):
            some = pieces[start : start + (1 << 14)]
            first = self._first_ids([" " + p for p in some])
            second = self.second.encode(some, num_threads=1)
            second = [ids if piece else [self.space] for ids, piece in zip(second, some, strict=True)]
            raw = [b" " + p.encode() for p in some]
            length = np.array(list(map(len, raw)), np.int64)
            is_whole = np.ones(len(some), bool)
            for side, lists in (("a", first), ("b", second)):
                names, sizes = (self.a_names, self.a_size) if side == "a" else (self.b_names, self.b_size)
                count = np.array(list(map(len, lists)), np.int64)
                own = np.fromiter(chain.from_iterable(lists), np.int64, int(count.sum()))
                lengths = np.bincount(np.repeat(np.arange(len(lists)), count), sizes[own], len(lists))
                is_whole &= lengths == length
                if self._joined(names, own) != b"".join(raw):
                    is_whole &= [self._joined(names, np.array(x)) == r for x, r in zip(lists, raw, strict=True)]
                ids, ends = self.tokens[side]
                self.tokens[side] = np.concatenate((ids, own.astype(np.int32))), np.append(ends, ends[-1] + np.cumsum(count))
            self.is_whole = np.append(self.is_whole, is_whole)

    def _first_ids(self, pieces: list[str]) -> list[list[int]]:
        if self.quick is None:
            return [e.ids for e in self.first.encode_batch_fast(pieces, add_special_tokens=False)]
        found = [self.quick.encode_ordinary(p) if _PLAIN.fullmatch(p) else None for p in pieces]
        others = [k for k, ids in enumerate(found) if ids is None]
        encoded = self.first.encode_batch_fast([pieces[k] for k in others], add_special_tokens=False)
        for k, own in zip(others, encoded, strict=True):
            found[k] = own.ids
        return found

    def _quick(self, spec: dict) -> object | None:
        """A faster encoder of the same vocabulary, if it is sure to do the same.

        It joins what is next in the vocabulary instead of what is next in the
        list of merges. As long as every token comes out of its own bytes, and
        merges are in the order of their tokens, no other pair can be there when
        a token is made: without joints to what is around, its bytes go the same
        way as alone, and that ends with its own merge.
        """
        import tiktoken

        model = spec["model"]
        special = {t["content"] for t in spec.get("added_tokens", ())}
        vocab = {name: k for name, k in model["vocab"].items() if name not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [vocab.get(x + y, -1) for x, y in merges]
        signs = _byte_signs()
        if (
            model.get("type") != "BPE"
            or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            or made != sorted(set(made))
            or sorted([vocab[s] for s in signs if s in vocab] + made) != sorted(vocab.values())
            or min(made, default=0) < len(signs)
            or any([t.id for t in self.first.model.tokenize(name)] != [k] for name, k in vocab.items())
        ):
            return None
        ranks = {bytes(signs[c] for c in name): k for name, k in vocab.items()}
        return tiktoken.Encoding("quick", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _joined(names: pa.Array, ids: np.ndarray) -> bytes:
        """The bytes of tokens, one behind the other."""
        data = names.take(pa.array(ids, pa.int64())).buffers()[2]
        return data.to_pybytes() if data is not None else b""

    def cut(self, texts: list[str]) -> Cut:
        """The tokens of each text; none of an empty one, or of one they do not give back."""
        if len(self.known) > MOST_KEPT or self.kept > MOST_CHARS:
            self._forget()
        before = len(self.known)
        codes: list[int] = []
        first = [0]
        for text in texts:
            if text:
                codes.extend(map(self.known.__getitem__, self._pieces(text)))
            first.append(len(codes))
        new = list(islice(reversed(self.known), len(self.known) - before))[::-1]
        self.kept += sum(map(len, new))
        self._learn(new)
        code = np.array(codes, np.int64)
        of_text = np.repeat(np.arange(len(texts)), np.diff(first))
        for k in np.unique(of_text[~self.is_whole[code]]).tolist():
            own = code[first[k] : first[k + 1]]
            raw = b" " + texts[k].encode()
            if any(self._joined(names, self._ids(side, own)[0]) != raw
                   for side, names in (("a", self.a_names), ("b", self.b_names))):
                code[first[k] : first[k + 1]] = -1
        parts = []
        for side, sizes in (("a", self.a_size), ("b", self.b_size)):
            ids, at = self._ids(side, code)
            parts.append((ids, np.cumsum(sizes[ids]), at[first]))
        (a, a_ends, a_first), (b, b_ends, b_first) = parts
        return Cut(a, b, a_ends, b_ends, a_first, b_first)

    def _ids(self, side: str, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, and the place of each piece among them; -1 is a piece without any."""
        ids, ends = self.tokens[side]
        size = np.where(code < 0, 0, ends[code + 1] - ends[code])
        at = np.append(0, np.cumsum(size))
        return ids[np.repeat(ends[code] - at[:-1], size) + np.arange(at[-1])].astype(np.int64), at


def _search(long: np.ndarray, wanted: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each wanted value the first place from `low` on whose value is not less.

    Steps double until they reach it, then the last step is halved.
    """
    n = len(long)
    low, high = low.copy(), low.copy()
    span = 1
    active = np.arange(len(wanted))
    while len(active):
        active = active[high[active] < n]
        active = active[long[high[active]] < wanted[active]]
        low[active] = high[active] + 1
        high[active] = low[active] + span
        span *= 2
    high = np.minimum(high, n)
    active = np.flatnonzero(low < high)
    while len(active):
        middle = (low[active] + high[active]) // 2
        less = long[middle] < wanted[active]
        low[active[less]] = middle[less] + 1
        high[active[~less]] = middle[~less]
        active = active[low[active] < high[active]]
    return low


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in both ascending lists of the values they share."""
    if len(short) > len(long):
        j, i = gallop(long, short)
        return i, j
    if not len(short):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, last = np.zeros(1, np.int64), len(short)
    for step in ANCHORS:
        some = short[::step]
        place = _search(long, some, np.repeat(place, -(-last // step))[: len(some)])
        last = step
    there = np.flatnonzero(place < len(long))
    there = there[long[place[there]] == short[there]]
    return there, place[there]


class Linked(NamedTuple):
    groups: list[str]
    n_groups: np.ndarray
    n_links: np.ndarray
    owner: np.ndarray  # the text of each distinct link, ascending
    link: np.ndarray
    times: np.ndarray


class Aligner:
    def __init__(self, tokenizers: Tokenizers) -> None:
        self.n_a, self.n_b = len(tokenizers.a_bytes), len(tokenizers.b_bytes)
        self.names = pa.array(
            [f"{k}{sign}" for n, signs in ((self.n_a, ",|"), (self.n_b, ",;")) for k in range(n) for sign in signs]
        )

    def link(self, cut: Cut) -> Linked:
        i, j = gallop(cut.a_ends, cut.b_ends)
        # A text's last tokens end together, so no group is of two texts.
        a_first, b_first = np.append(0, i + 1), np.append(0, j + 1)
        first = np.searchsorted(a_first, cut.a_first)
        of_text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        x, y = np.diff(a_first), np.diff(b_first)
        n_links = np.bincount(of_text, x * y, len(first) - 1).astype(np.int64)
        owner, link, times = self._distinct(cut, of_text, a_first, b_first, x, y)
        return Linked(self._texts(cut, i, j, x, y, a_first, b_first, first), np.diff(first), n_links, owner, link, times)

    def _distinct(self, cut: Cut, of_text, a_first, b_first, x, y) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        space = self.n_a * self.n_b
        keys, counts = [], []
        small = np.flatnonzero(x * y <= SMALL_GROUP)
        size = (x * y)[small]
        group = np.repeat(small, size)
        at = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)
        keys.append(
            of_text[group] * space
            + cut.a[a_first[group] + at // y[group]] * self.n_b
            + cut.b[b_first[group] + at % y[group]]
        )
        counts.append(np.ones(len(group), np.int64))
        for g in np.flatnonzero(x * y > SMALL_GROUP):
            a, n = np.unique(cut.a[a_first[g] : a_first[g + 1]], return_counts=True)
            b, m = np.unique(cut.b[b_first[g] : b_first[g + 1]], return_counts=True)
            keys.append((of_text[g] * space + a[:, None] * self.n_b + b).ravel())
            counts.append((n[:, None] * m).ravel())
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        times = np.add.reduceat(counts, start) if len(keys) else counts
        owner, link = np.divmod(keys[start], space)
        return owner, (link // self.n_b) << 32 | link % self.n_b, times

    def _texts(self, cut: Cut, i, j, x, y, a_first, b_first, first) -> list[str]:
        """Each text's groups, as `a1,a2|b1;a3|b2,b3`."""
        codes = np.empty(len(cut.a) + len(cut.b), np.int64)
        a_code = cut.a * 2
        a_code[i] += 1
        b_code = (self.n_a + cut.b) * 2
        b_code[j] += 1
        codes[np.arange(len(cut.a)) + np.repeat(b_first[:-1], x)] = a_code
        codes[np.arange(len(cut.b)) + np.repeat(a_first[1:], y)] = b_code
        written = self.names.take(pa.array(codes))
        _, offsets, data = written.buffers()
        offsets = np.frombuffer(offsets, np.int32)[written.offset : written.offset + len(codes) + 1]
        bounds = offsets[(a_first + b_first)[first]].tolist()
        raw = data.to_pybytes() if data is not None else b""
        return [raw[s : max(s, e - 1)].decode("ascii") for s, e in zip(bounds[:-1], bounds[1:], strict=True)]


_ALIGNED = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string,"
    " which array<int>, times array<long>, links array<long>, docs array<long>"
)
_ARROW = pa.schema(
    [(n, pa.int64()) for n in ("block", "doc_id", "n_a", "n_b", "n_groups", "n_links")]
    + [("groups", pa.string()), ("which", pa.list_(pa.int32()))]
    + [(n, pa.list_(pa.int64())) for n in ("times", "links", "docs")]
)


def _aligner(byte_bpe: str, piece_bpe: str, block_links: int) -> Callable:
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = Tokenizers(byte_bpe, piece_bpe)
        aligner = Aligner(tokenizers)
        block = TaskContext.get().partitionId() << 32
        held: list[_Part] = []
        for batch in batches:
            for first, end, _, _ in slices(batch.column(1)):
                texts = [t or "" for t in batch.column(1).slice(first, end - first).to_pylist()]
                held.append(_part(batch.column(0).slice(first, end - first), tokenizers.cut(texts), aligner))
                if sum(len(part.link) for part in held) >= block_links:
                    yield from _block(block, held)
                    block, held = block + 1, []
        if held:
            yield from _block(block, held)

    return align


class _Part(NamedTuple):
    """Some documents of a block, and their distinct links."""

    columns: list[pa.Array]
    bounds: np.ndarray
    link: np.ndarray
    times: np.ndarray


def _part(ids: pa.Array, cut: Cut, aligner: Aligner) -> _Part:
    linked = aligner.link(cut)
    numbers = (np.diff(cut.a_first), np.diff(cut.b_first), linked.n_groups, linked.n_links)
    # A batch's slice would keep the whole batch.
    ids = pa.array(ids.to_pylist(), pa.int64())
    columns = [ids, *(pa.array(x, pa.int64()) for x in numbers), pa.array(linked.groups, pa.string())]
    return _Part(columns, np.searchsorted(linked.owner, np.arange(len(ids) + 1)).astype(np.int32), linked.link, linked.times)


def _block(block: int, held: list[_Part]) -> Iterator[pa.RecordBatch]:
    """The rows of a block's documents, and one of its links."""
    links, which = np.unique(np.concatenate([part.link for part in held]), return_inverse=True)
    docs = np.bincount(which, minlength=len(links))
    place = 0
    for columns, bounds, link, times in held:
        n = len(columns[0])
        own = which[place : place + len(link)].astype(np.int32)
        place += len(link)
        none = pa.nulls(n, pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, block)), *columns,
                pa.ListArray.from_arrays(bounds, own), pa.ListArray.from_arrays(bounds, times), none, none,
            ],
            schema=_ARROW,
        )
    if len(links):
        own = [[block], *[None] * 8, [links], [docs]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x or [None], f.type) for x, f in zip(own, _ARROW, strict=True)], schema=_ARROW
        )


def _weigh(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of a block with what the counts of their links come to."""
    at = answers.column("at").to_numpy()
    count = np.zeros(len(at), np.int64)
    count[at] = answers.column("n").to_numpy()
    best = np.zeros(len(at), np.int64)
    best[at] = answers.column("is_best").to_numpy()
    which, times = (docs.column(name).combine_chunks() for name in ("which", "times"))
    size = which.value_lengths().to_numpy()
    which, times = which.flatten().to_numpy(), times.flatten().to_numpy()
    ends = np.cumsum(size)
    sums = [np.append(0, np.cumsum(times * of[which])) for of in (best, count)]
    n_best, count_sum = (s[ends] - s[ends - size] for s in sums)
    return docs.drop_columns(["block", "which", "times"]).append_column(
        "n_best", pa.array(n_best, pa.int64())
    ).append_column("count_sum", pa.array(count_sum, pa.int64()))


def aligned(
    docs: DataFrame,
    *,
    byte_bpe: str = BYTE_BPE,
    piece_bpe: str = PIECE_BPE,
    block_links: int = BLOCK_LINKS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """`(block, doc_id, n_a, n_b, n_groups, n_links, groups, which, times)` for each row of
    `docs`, and `(block, links, docs)` for each block of them.

    `groups` writes the ids as `a1,a2|b1;a3|b2,b3`. `which` are a document's
    distinct links, by number in `links` of its block (first id times 2^32, and
    second id), `times` how often each occurs. `docs` is the
    number of the block's documents with each link. Store it before reading
    it twice: the blocks of a second run may be others.

    Cases. NULL and empty texts have no tokens, nor have texts that the tokens
    do not give back, such as those with U+2581: zeros, and empty groups. Strings
    of special tokens are plain text. A very long text is encoded whole, by one
    task, and is a block of its own; a group of n and m different ids has n * m
    links, which are all counted. NULL and repeated ids and repeated rows each
    are documents of their own. Further columns are not read. An empty table
    gives none.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return named.mapInArrow(_aligner(byte_bpe, piece_bpe, block_links), _ALIGNED)


def link_counts(held: DataFrame) -> DataFrame:
    """`(link, n, is_best)`: how many documents have each link, and whether no link of its
    first id has more."""
    counts = stash(
        held.where("links IS NOT NULL")
        .select(F.explode(F.arrays_zip("links", "docs")).alias("l"))
        .groupBy(F.col("l.links").alias("link"))
        .agg(F.sum("l.docs").alias("n"))
        .withColumn("a", F.shiftright("link", 32))
    )
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    # One row for each id of a vocabulary.
    is_best = (F.col("n") == F.col("most")).cast("long").alias("is_best")
    return counts.join(F.broadcast(most), "a").select("link", "n", is_best)


def weighed(held: DataFrame) -> DataFrame:
    """The documents of `held`, a stored result of `aligned`, with `n_best` and `count_sum`.

    `n_best` is the number of links that are the most frequent of their first
    id, `count_sum` the sum of the counts of all links. Without links both are 0.
    """
    asked = held.where("links IS NOT NULL").select(F.col("block").alias("asking"), F.posexplode("links").alias("at", "link"))
    answers = lookup(asked, stash(link_counts(held)), "link").select("asking", "at", "n", "is_best")
    docs = held.where("links IS NULL").drop("links", "docs")
    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in ("block", "which", "times")]
    return (
        docs.groupBy("block")
        .cogroup(answers.groupBy("asking"))
        .applyInArrow(_weigh, ", ".join([*own, "n_best long", "count_sum long"]))
    )


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    held = stash(aligned(table(spark, sf_dir, "documents")).withColumn("groups_sha256", digest).drop("groups"))
    return weighed(held)
