"""Near-duplicates of documents: one-permutation MinHash, buckets, star edges.

Steps, each a Spark job over all documents:

1. A task hashes the words of its texts, takes each document's set of distinct
   word shingles and sketches it: one permutation, `BANDS * ROWS` bins, the
   least hash in each. An empty bin takes the value of another one, picked by a
   random order of the bins that is its own (optimal densification), so short
   sets behave like long ones.
2. Documents of equal sets are one class; only its least document goes on.
3. `ROWS` bins hash to a key; documents that share one are a bucket. In a bucket
   the centre is linked with each other: a star, so a bucket of n has n - 1
   candidate edges, not n^2. Buckets of the same documents are one.
4. Candidates are confirmed on full sets, components found by least labels.
5. A bucket that still holds several components may hide a link between two
   members that are not its centre. It elects further centres, and what is then
   open is compared block by block, on full sets (`links`).

A pair of similarity 0.8 shares a bucket with a probability of
1 - (1 - 0.8^6)^48 > 0.9999995, a more similar one with more.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keys import quoted
from ..operators.lookup import lookup
from .common import free_name, mix64, slices, stash, table
from .links import component_ids, set_digest, sign
from .shingles import PLACE, Powers, shingle_sets

# Sent with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BANDS = 48
ROWS = 6
BINS = BANDS * ROWS
WORDS = 5
SIMILARITY_PCT = 80

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SEEDED = np.random.Generator(np.random.PCG64(20260113))
# _RANK[i, j]: how early bin i, if empty, asks bin j.
_RANK = np.argsort(np.argsort(_SEEDED.random((BINS, BINS)), axis=1), axis=1).astype(np.uint16)


def signature(found: np.ndarray) -> np.ndarray:
    """One value for each bin. `found` is sorted, so bins are runs and least values come first."""
    bins = ((found >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    own = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    full = bins[own].astype(np.int64)
    values = np.zeros(BINS, np.uint64)
    values[full] = found[own]
    if len(full) < BINS:
        is_empty = np.ones(BINS, bool)
        is_empty[full] = False
        empty = np.flatnonzero(is_empty)
        donors = full[_RANK[empty[:, None], full[None, :]].argmin(axis=1)]
        values[empty] = values[donors]
    return values


def _sketcher(words: int) -> Callable:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        places = PLACE[:ROWS]
        salts = _SEEDED_BANDS
        for batch in batches:
            ids = batch.column(0)
            for first, end, raw, offsets in slices(batch.column(1)):
                sizes, classes, bands = [], [], []
                for found in shingle_sets(raw, offsets, words, powers):
                    sizes.append(len(found))
                    classes.append(set_digest(found))
                    if not len(found):
                        bands.append(None)
                        continue
                    values = signature(found)
                    keys = mix64((values.reshape(BANDS, ROWS) * places).sum(axis=1) + salts)
                    bands.append(keys.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, end - first),
                        batch.column(2).slice(first, end - first),
                        pa.array(sizes, pa.int64()),
                        pa.array(classes, pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "class", "keys"],
                )

    return sketch


_SEEDED_BANDS = mix64(np.arange(1, BANDS + 1, dtype=np.uint64) * _BASE)


def near_duplicates(
    docs: DataFrame, *, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`(doc_id, n_shingles, component_id, kept)`, one row for each row of `docs`.

    Documents are linked where 100 * intersection >= 80 * union of their sets of
    distinct `words`-word shingles. `component_id` is the least document
    reachable over links, `kept` marks it.

    Cases. NULL and empty texts, and texts of white space, have no shingles and
    are linked with nothing. A very long text is one set like any other, compared
    in ranges. A row without an id is linked with nothing and
    kept; its component is NULL. Repeated ids are one document of several
    texts. Further columns of `docs` are not read. An empty table gives none.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = component_ids(named, sign(named, _sketcher(words)), words, SIMILARITY_PCT)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, *, words: int = WORDS) -> DataFrame:
    """One row of each component of near-duplicates in `docs`.

    Each row is a document of its own, by its own text: rows with the same id,
    or none, are linked like any others, and of repeated rows one stays. It is
    the one with the least id, NULL last. Rows without words stay, NULL and empty
    texts among them; a very long text is a set like any other. Columns stay,
    whatever their names. An empty table stays empty.
    """
    row = free_name("row_number", docs.columns)
    # Numbers of rows hold only once they are written.
    numbered = stash(docs.withColumn(row, F.monotonically_increasing_id()))
    found = stash(near_duplicates(numbered, words=words, id_col=row).select("doc_id", "component_id"))
    ids = numbered.select(F.col(row).alias("doc_id"), F.col("doc_id").cast("long").alias("own"))
    # Groups of one row need no choice.
    groups = found.where("doc_id <> component_id").select("component_id").distinct()
    several = lookup(found, groups.withColumn("is_group", F.lit(True)), "component_id").where("is_group").drop("is_group")
    choice = F.min(F.struct(F.col("own").isNull().alias("last"), "own", "doc_id")).alias("first")
    kept = several.join(ids, "doc_id").groupBy("component_id").agg(choice).select("component_id", "first.doc_id")
    kept = kept.withColumnRenamed("doc_id", "kept")
    dropped = stash(lookup(several, kept, "component_id").where("doc_id <> kept").select(F.col("doc_id").alias(row)))
    return numbered.join(dropped, row, "left_anti").select(*map(quoted, docs.columns))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
                      WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
                 END AS s
  FROM words
),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
shingles AS (SELECT doc_id, unnest(s) AS h FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2
),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 80 * (x.n + y.n - c)
),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id, doc_id AS r FROM sizes
  UNION
  SELECT ways.b, reached.r FROM reached JOIN ways ON ways.a = reached.doc_id
),
least AS (SELECT doc_id, min(r) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN least USING (doc_id)
"""
