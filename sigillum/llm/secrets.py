"""Secrets in texts: keyword automaton, anchored patterns near its hits, checksums.

An Aho-Corasick automaton passes over each whole text once and finds the words
a secret starts with; a pattern is tried only where one was found, at that very
place. Runs of hex digits have no keyword: there every eighth character is
looked at, and a pattern is tried only where three in a row are hex digits, as
they are in any run of 24. Tokens with a checksum of their own are reported
only if it holds.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.keys import quoted
from .common import few, table

# Sent with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Kinds in order of report, patterns, least lengths and token prefixes.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
ASSIGN_VALUE, ACCESS_LENGTH = 6, 20
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign",
    "apikey": "assign", "api_key": "assign", "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm",
}
CHECKED = r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

MARK = "<SECRET>"
_STRIDE = 8
_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
# A type, not its text: that would need a session when the module is imported.
SPANS = T.ArrayType(
    T.StructType().add("kind", T.StringType()).add("start", T.IntegerType()).add("end", T.IntegerType())
)


def crc_base62(body: str) -> str:
    """The six characters that end a checked token."""
    left, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        left, digit = divmod(left, 62)
        digits = BASE62[digit] + digits
    return digits


class Scanner:
    def __init__(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            self.automaton.add_word(word, (len(word), kind))
        self.automaton.make_automaton()
        self.assign = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
        self.access = re.compile(ACCESS)
        self.hex = re.compile(HEX)
        self.checked = re.compile(CHECKED)
        self.probe = re.compile("[0-9a-f]{3,}")

    def _hex(self, text: str) -> Iterator[tuple[int, int]]:
        for probe in self.probe.finditer(text[::_STRIDE]):
            start, end = probe.start() * _STRIDE, probe.end() * _STRIDE
            while start and text[start - 1] in "0123456789abcdef":
                start -= 1
            for run in self.hex.finditer(text, start, min(end, len(text))):
                yield run.span()

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """`(start, place of kind, end)` in order; code points, the end exclusive."""
        lower = text.lower()
        if len(lower) != len(text):  # a few letters become two
            lower = text.translate(_UPPER)
        hits: dict[str, list[int]] = {}
        for last, (length, kind) in self.automaton.iter(lower):
            hits.setdefault(kind, []).append(last - length + 1)
        found = [(start, 2, end) for start, end in self._hex(text)]
        for kind, starts in hits.items():
            free = 0
            for start in sorted(starts):
                if start < free:
                    continue
                if kind == "assign":
                    match = self.assign.match(text, start)
                    good = match and len(match[2]) >= ASSIGN_VALUE
                elif kind == "access":
                    match = self.access.match(text, start)
                    good = match and len(match[0]) >= ACCESS_LENGTH
                else:
                    match = self.checked.match(text, start)
                    good = match and crc_base62(match[1]) == match[2]
                if match:
                    free = match.end()
                if good:
                    found.append((start, KINDS.index(kind), match.end()))
        return sorted(found)


@F.arrow_udf(SPANS)
def secret_spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """All spans of secrets in each whole text; none in a NULL or empty one."""
    scanner = Scanner()
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    for texts in batches:
        rows = [
            [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scanner.spans(text or "")]
            for some in few(texts)
            for text in some
        ]
        yield pa.array(rows, pa.list_(kind))


def _marked(scanner: Scanner, text: str | None) -> str | None:
    spans = scanner.spans(text) if text else ()
    if not spans:
        return text
    parts, at = [], 0
    for start, _, end in spans:
        if start >= at:
            parts += [text[at:start], MARK]
        at = max(at, end)
    return "".join([*parts, text[at:]])


@F.arrow_udf(T.StringType())
def redacted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The texts with a mark in place of each run of overlapping secrets; NULL stays NULL."""
    scanner = Scanner()
    for texts in batches:
        done = [pa.array([_marked(scanner, text) for text in some], pa.string()) for some in few(texts)]
        yield pa.concat_arrays(done) if done else pa.array([], pa.string())


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, secrets)`, one row for each row of `docs`; `secrets` holds all spans.

    Base kinds are leftmost and non-overlapping within their kind; a match that
    fails its length is dropped, though it has used up its characters. `github`
    and `npm` tokens must end in the checksum of their body.

    Cases. NULL and empty texts have no span; a very long text is read whole. NULL
    and repeated ids and repeated rows stay as they are. Further columns are not read. An empty table gives none.
    """
    return docs.select(F.col(id_col).alias("doc_id"), secret_spans(F.col(text_col)).alias("secrets"))


def redact_secrets(docs: DataFrame) -> DataFrame:
    """`docs` with each secret in `text` replaced by a mark, and `n_chars` of the new text.

    Every row stays, repeated rows and NULL ids too; NULL and empty texts stay as
    they are, and a very long text is read whole. Other columns stay, whatever
    their names. An empty table stays empty.
    """
    clean = docs.withColumn("text", redacted("text"))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars"))
    return clean.select(*map(quoted, docs.columns))


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    of_kind = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *(of_kind(kind).alias(f"n_{kind}") for kind in BASE_KINDS),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("secrets")).alias("spans"),
    )
