"""Language of documents: a bidirectional gated recurrent network over bytes.

The network reads segments of a text's UTF-8 bytes in both directions and gives
each position a probability for every language; a document's are the means over
all of its positions. It is trained in numpy by backpropagation through time, on
a bounded sample of windows of documents whose language is known.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, held_out, slices, stash, table

# Sent with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The bound of the sample that the network is trained on.
SAMPLE_DOCS, WINDOWS = 3000, 4
LENGTH = 96  # bytes of a training window
SEGMENT = 128  # bytes read at once when predicting
HIDDEN = 8
STEPS, BATCH, RATE = 400, 128, 0.02
UNKNOWN = "und"
LANES = 4096



def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * 0.5) * 0.5 + 0.5


class Network:
    """Gates are rows, sequences columns. Direction 0 reads forwards, 1 backwards."""

    def __init__(self, languages: list[str], seed: int = 7) -> None:
        self.languages = languages
        rng = np.random.Generator(np.random.PCG64(seed))
        h, n = HIDDEN, len(languages)
        self.p = {
            "x": rng.normal(0, 0.3, (2, 3 * h, 256)),  # what each byte adds to the gates
            "u": rng.normal(0, 0.5 / h**0.5, (2, 3 * h, h)),
            "b": np.zeros((2, h, 1)),
            "v": rng.normal(0, 0.3, (n, 2 * h)),
            "c": np.zeros((n, 1)),
        }

    def _run(self, d: int, bytes_: np.ndarray, inside: np.ndarray | None = None, keep: bool = False):
        """Hidden states of `(time, sequences)` bytes in one direction.

        Outside of a sequence, after its end, the state is nil; so a sequence
        read backwards starts afresh, whatever length it is filled up to.
        """
        h, p = HIDDEN, self.p
        x, u, b = p["x"][d], p["u"][d], p["b"][d]
        time, n = bytes_.shape
        state = np.zeros((h, n), x.dtype)
        states = np.empty((time, h, n), x.dtype)
        kept = []
        for t in range(time) if d == 0 else range(time - 1, -1, -1):
            into, back = x[:, bytes_[t]], u @ state
            gates = _sigmoid(into[: 2 * h] + back[: 2 * h])
            z, r = gates[:h], gates[h:]
            inner = back[2 * h :] + b
            new = np.tanh(into[2 * h :] + r * inner)
            if keep:
                kept.append((t, state, z, r, inner, new))
            state = new + z * (state - new)
            if inside is not None:
                state = state * inside[t]
            states[t] = state
        return states, kept

    def _backwards(
        self, d: int, bytes_: np.ndarray, inside: np.ndarray, kept: list, slopes: np.ndarray, grads: dict
    ) -> None:
        h, u = HIDDEN, self.p["u"][d]
        carry = np.zeros_like(slopes[0])
        for t, before, z, r, inner, new in reversed(kept):
            carry = (carry + slopes[t]) * inside[t]
            d_new = carry * (1 - z) * (1 - new**2)
            d_z = carry * (before - new) * z * (1 - z)
            d_r = d_new * inner * r * (1 - r)
            into = np.concatenate((d_z, d_r, d_new))
            back = np.concatenate((d_z, d_r, d_new * r))
            for g in range(3 * h):
                grads["x"][d, g] += np.bincount(bytes_[t], into[g], 256)
            grads["u"][d] += back @ before.T
            grads["b"][d] += back[2 * h :].sum(axis=1, keepdims=True)
            carry = carry * z + u.T @ back

    def _step(self, bytes_: np.ndarray, mask: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
        """Loss over all positions and its gradients, by backpropagation through time."""
        ways = [self._run(d, bytes_, mask, keep=True) for d in (0, 1)]
        both = np.concatenate([states for states, _ in ways], axis=1)
        p = self._positions(both)
        time, _, n = both.shape
        hit = p[:, target, np.arange(n)]
        total = mask.sum()
        loss = -(np.log(np.maximum(hit, 1e-12)) * mask).sum() / total
        slope = p.copy()
        slope[:, target, np.arange(n)] -= 1
        slope *= (mask / total)[:, None, :]
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["v"] = np.einsum("tln,tkn->lk", slope, both)
        grads["c"] = slope.sum(axis=(0, 2))[:, None]
        down = np.matmul(self.p["v"].T, slope)
        for d, (_, kept) in enumerate(ways):
            self._backwards(d, bytes_, mask, kept, down[:, d * HIDDEN : (d + 1) * HIDDEN], grads)
        return float(loss), grads

    def _positions(self, both: np.ndarray) -> np.ndarray:
        """Probabilities `(time, language, sequence)`."""
        out = np.matmul(self.p["v"], both) + self.p["c"]
        out -= out.max(axis=1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=1, keepdims=True)
        return out

    def train(self, windows: list[bytes], labels: list[int], *, steps: int = STEPS, seed: int = 11) -> float:
        """Adam over random batches; the last losses' mean."""
        rng = np.random.Generator(np.random.PCG64(seed))
        data = np.zeros((len(windows), LENGTH), np.uint8)
        size = np.array([min(len(w), LENGTH) for w in windows])
        for row, w in zip(data, windows, strict=True):
            row[: min(len(w), LENGTH)] = np.frombuffer(w[:LENGTH], np.uint8)
        target = np.array(labels)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses = []
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(data), BATCH)
            mask = (np.arange(LENGTH)[:, None] < size[pick][None, :]).astype(float)
            loss, grads = self._step(data[pick].T, mask, target[pick])
            norm = np.sqrt(sum((g**2).sum() for g in grads.values()))
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                g = g * min(1.0, 5 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g**2
                self.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            losses.append(loss)
        return float(np.mean(losses[-20:]))

    def light(self) -> "Network":
        """As many digits as predicting needs."""
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        return self

    def pooled(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """`(texts, languages)`: means of the probabilities of all positions of each text; 0 without any."""
        sizes = np.diff(offsets)
        pieces = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = offsets[owner] + nth * SEGMENT
        length = np.minimum(offsets[owner + 1] - start, SEGMENT)
        total = np.zeros((len(sizes), len(self.languages)))
        order = np.argsort(length, kind="stable")  # short ones are read together
        for a in range(0, len(order), LANES):
            some = order[a : a + LANES]
            time = np.arange(int(length[some].max()))[:, None]
            inside = time < length[some][None, :]
            at = np.minimum(start[some][None, :] + time, len(raw) - 1)
            bytes_ = np.where(inside, raw[at], 0)
            full = None if inside.all() else inside.astype(np.float32)
            both = np.concatenate([self._run(d, bytes_, full)[0] for d in (0, 1)], axis=1)
            p = self._positions(both) * inside[:, None, :]
            np.add.at(total, owner[some], p.sum(axis=0).T)
        return total / np.maximum(sizes, 1)[:, None]


def _sample(docs: DataFrame, sample_docs: int) -> DataFrame:
    """`(lang, window)`: windows of at most `sample_docs` documents, about as many of each language.

    Documents are taken by the least -ln(u) * n, with u from a hash of the id
    and n the documents of their language.
    """
    known = docs.where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}")
    )
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    u = (F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    picked = (
        known.groupBy("doc_id")  # an id that many rows have counts once
        .agg(F.min("lang").alias("lang"))
        .join(sizes, "lang")
        .select("doc_id", "lang", (-F.log(u) * F.col("n")).alias("k"))
        .where(F.col("k") < 3 * sample_docs)  # about so many of each language
        .orderBy("k", "doc_id")
        .limit(sample_docs)
        .select("doc_id")
    )
    # At most `sample_docs` numbers.
    chosen = (
        known.join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id")
        .agg(F.min(F.struct("lang", "text")).alias("row"))
        .select("doc_id", "row.lang", "row.text")
    )
    starts = F.array(*[
        F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(F.char_length("text") - LENGTH // 2, F.lit(1))) + 1
        for k in range(WINDOWS)
    ])
    return chosen.select(
        "lang", F.col("doc_id"),
        F.explode(F.transform(starts, lambda s: F.substring("text", s.cast("int"), F.lit(LENGTH)))).alias("window"),
    )


def fit(docs: DataFrame, *, sample_docs: int = SAMPLE_DOCS, steps: int = STEPS) -> Network | None:
    """A network learnt from documents that are not held out; None if none has a language."""
    # WINDOWS * sample_docs rows of at most LENGTH characters.
    rows = stash(_sample(docs, sample_docs)).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.lang, r.doc_id if r.doc_id is not None else -1, r.window))
    languages = sorted({r.lang for r in rows})
    network = Network(languages)
    if len(languages) > 1:
        network.train([r.window.encode() for r in rows], [languages.index(r.lang) for r in rows], steps=steps)
    return network.light()


def languages(docs: DataFrame, *, sample_docs: int = SAMPLE_DOCS, steps: int = STEPS) -> DataFrame:
    """`(doc_id, held_out, lang_pred, score)`, one row for each row of `docs`.

    Only the text makes a prediction; `score` is the mean probability of the
    predicted language over all bytes. Languages are learnt from rows that are
    not held out, at most `sample_docs` of them.

    Cases. NULL and empty texts, and those without a letter (digits, marks and
    number signs are none), are `und` with score 0, and so is every text if no language can be learnt. With one known
    language all others are that. Of equal probabilities the first by name is
    taken. A very long text is read whole, segment by segment. Repeated rows are
    predicted alike and keep a row each; an empty table gives none. NULL ids are not held out. Further columns are not read.
    """
    network = fit(docs, sample_docs=sample_docs, steps=steps)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has_letter = [bool(t) and any(map(str.isalpha, t)) for some in few(batch.column(1)) for t in some]
            names, scores = [], []
            for first, end, raw, offsets in slices(batch.column(1)):
                pooled = network.pooled(raw, offsets) if network and len(raw) else np.zeros((end - first, 1))
                best = pooled.argmax(axis=1)
                for k in range(end - first):
                    good = has_letter[first + k] and network is not None
                    names.append(network.languages[best[k]] if good else UNKNOWN)
                    scores.append(min(1.0, float(pooled[k, best[k]])) if good else 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(
        predict, "doc_id long, held_out boolean, lang_pred string, score double"
    )


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))
