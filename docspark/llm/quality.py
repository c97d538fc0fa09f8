"""Text quality: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.hashing import mix, word_blocks
from docspark.llm.samples import held_out, labelled_sample

#: Entries of an index vector, those that aren't 0, and words before and after that count as context.
DIM, SPARSE, REACH = 48, 4, 2
#: Words share so many context vectors, by hash.
WORDS = 1 << 12
#: Tasks that add up the context vectors.
ADDERS = 8
_KIND = np.zeros((4, 256), np.int64)
_KIND[0, ord("A") : ord("Z") + 1] = 1
_KIND[1, ord("0") : ord("9") + 1] = 1
_KIND[2, [ord(c) for c in ".,;:'\"()?-"]] = 1
_KIND[3, [ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 1
SHAPES = 3 * 2 * 3 * 4 * 4
REPEAT = SHAPES  # a word equal to the one before it


def _shapes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Capitals (none, some, most), digits, punctuation, symbols and length of each word, as one number."""
    size = end - start
    upper, digit, stop, sign = (np.diff(np.concatenate([[0], np.cumsum(k[raw])])[np.stack([start, end])], axis=0)[0] for k in _KIND)
    out = np.where(upper == 0, 0, np.where(upper * 2 > size, 2, 1))
    out = out * 2 + (digit > 0)
    out = out * 3 + np.minimum(stop, 2)
    out = out * 4 + np.minimum(sign, 3)
    return out * 4 + np.searchsorted([2, 6, 14], size, "right")


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2
        return 1 / (1 + np.exp(-np.clip(z / self.temperature, -30, 30)))


def _index(names: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the SPARSE entries of each name's random index vector."""
    place = np.stack([mix(names + np.uint64(seed * SPARSE + j)) for j in range(SPARSE)])
    return (place % np.uint64(DIM)).astype(np.int64), np.where((place >> np.uint64(40)) & np.uint64(1), 1, -1)


def _keys(block: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Row of each word's context vector, and of its shape (or the mark of a repeat)."""
    owner, raw, start, end, value = block
    shape = _shapes(raw, start, end)
    shape[1:][(value[1:] == value[:-1]) & (owner[1:] == owner[:-1])] = REPEAT
    return (value % np.uint64(WORDS)).astype(np.int64), shape


def _pooled(texts: list[str | None], vectors: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """Means of the context and the shape vectors of each text's words; zeros for texts without words."""
    total, count = np.zeros((len(texts), vectors.shape[1] + shapes.shape[1])), np.zeros(len(texts))
    for block in word_blocks(texts):
        owner = block[0]
        if len(owner):
            word, shape = _keys(block)
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            total[owner[first], :DIM] += np.add.reduceat(vectors[word], first, axis=0)
            total[owner[first], DIM:] += np.add.reduceat(shapes[shape], first, axis=0)
            count[owner[first]] += np.diff(np.concatenate([first, [len(owner)]]))
    return total / np.maximum(count, 1)[:, None]


def _texts_in(batches: Iterator[pa.RecordBatch], size: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, size):
            yield batch.slice(i, size)


def word_vectors(docs: DataFrame, seed: int = 5) -> np.ndarray:
    """Random indexing over all texts: a word's vector is the sum of the sparse random index vectors of the words
    around it, wherever it stands. Words share WORDS rows. Tasks add up what they read, a few more add up the
    tasks' sums, and only the table, of a fixed size, reaches the driver."""
    column, sign = _index(mix(np.arange(WORDS, dtype=np.uint64)), seed)
    names = ["word", "sums"]

    def rows(total: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero(total.any(1))
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(total[some].ravel()), DIM).cast(pa.list_(pa.int64()))], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(WORDS * DIM, np.int64)
        for some in _texts_in(batches):
            for block in word_blocks(some.column("text").to_pylist()):
                owner, word = block[0], _keys(block)[0]
                for step in range(1, REACH + 1):
                    near = owner[step:] == owner[:-step]
                    a, b = word[step:][near], word[:-step][near]
                    for x, y in ((a, b), (b, a)):
                        for j in range(SPARSE):
                            total += np.bincount(x * DIM + column[j][y], sign[j][y], len(total)).astype(np.int64)
        yield rows(total.reshape(WORDS, DIM))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((WORDS, DIM), np.int64)
        for batch in batches:
            np.add.at(total, batch.column("word").to_numpy(), batch.column("sums").flatten().to_numpy().reshape(-1, DIM))
        yield rows(total)

    sums = docs.select("text").mapInArrow(read, "word int, sums array<long>").repartition(ADDERS, "word").mapInArrow(added, "word int, sums array<long>")
    total = np.zeros((WORDS, DIM))
    for r in sums.collect():
        total[r.word] += r.sums
    own = np.zeros((WORDS, DIM))  # a word is also told by itself, not by its context alone
    for j in range(SPARSE):
        own[np.arange(WORDS), column[j]] += sign[j] / SPARSE**0.5
    return total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9) + own


def shape_vectors(seed: int = 5) -> np.ndarray:
    column, sign = _index(mix(np.arange(WORDS, WORDS + SHAPES + 1, dtype=np.uint64)), seed)
    out = np.zeros((SHAPES + 1, DIM))
    for j in range(SPARSE):
        out[np.arange(SHAPES + 1), column[j]] += sign[j] / SPARSE**0.5
    return out


def fit_quality(x: np.ndarray, y: np.ndarray, hidden: int = 32, rounds: int = 300, seed: int = 5) -> QualityModel:
    """Train on pooled vectors and labels 0 or 1. Every fifth row is kept for the temperature. With no row of one label
    the probability is a half everywhere."""
    y, dim = y.astype(float), x.shape[1]
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(dim), np.ones(dim))
    random = np.random.default_rng(seed)
    w = [random.normal(0, dim**-0.5, (dim, hidden)), np.zeros(hidden), random.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    if len(set(y)) < 2:
        return QualityModel(mean, scale, w[0], w[1], np.zeros(hidden), 0.0, 1.0)
    deal = random.permutation(len(y)) % 5 == 0
    z, t = (x[~deal] - mean) / scale, y[~deal]
    weight = np.where(t == 1, 0.5 / max(t.mean(), 1e-3), 0.5 / max(1 - t.mean(), 1e-3))
    first, second = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    step = 0
    for _ in range(rounds // 10):
        for some in np.array_split(random.permutation(len(t)), max(1, len(t) // 256)):
            step += 1
            h = np.tanh(z[some] @ w[0] + w[1])
            p = 1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30)))
            d = (p - t[some]) * weight[some] / len(some)
            back = np.outer(d, w[2]) * (1 - h**2)
            for i, g in enumerate((z[some].T @ back + 1e-4 * w[0], back.sum(0), h.T @ d + 1e-4 * w[2], d.sum(keepdims=True))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g**2
                w[i] = w[i] - 0.005 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    model = QualityModel(mean, scale, w[0], w[1], w[2], float(w[3][0]), 1.0)
    if deal.any():
        z, t = np.tanh(((x[deal] - mean) / scale) @ w[0] + w[1]) @ w[2] + w[3], y[deal]
        grid = np.geomspace(0.25, 8, 41)
        loss = [np.logaddexp(0, -np.where(t == 1, 1, -1) * z / k).mean() for k in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = 4000, characters: int = 20_000_000, threshold: float = 0.7, keep: tuple[str, ...] = ()) -> DataFrame:
    """Probability that a text is of good quality, as ``labels`` (doc_id, quality 0/1) marks it.

    ``docs`` has doc_id and text. Word vectors come from all texts; the network is fitted on pooled vectors of at most
    ``sample`` rows of each label, ``characters`` code points together, whole texts, whose doc_id isn't held out. Every
    whole text is scored, from its words alone. Returns one row per row: doc_id, held_out, score, predicted (1 if score
    >= ``threshold``). Null and empty texts are scored as having no words; repeated rows are scored each; an empty table
    gives no rows; very long texts are read in blocks. Columns in ``keep`` are handed through. Labels that are null, or
    of doc_ids without a text, aren't learned from.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((word_vectors(docs), shape_vectors()))  # of a fixed size

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _texts_in(batches):
            x = pa.array(_pooled(some.column("text").to_pylist(), *held.value).ravel())
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("label"), pa.FixedSizeListArray.from_arrays(x, 2 * DIM).cast(pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    chosen = labelled_sample(docs, labels.select("doc_id", F.col("quality").cast("int").alias("label")), sample, characters)
    found = sorted((r.doc_id, r.label, r.x) for r in chosen.select("doc_id", "text", "label").mapInArrow(features, "doc_id long, label int, x array<double>").collect())
    x = np.array([r[2] for r in found]).reshape(-1, 2 * DIM)
    model = spark.sparkContext.broadcast(fit_quality(x, np.array([r[1] for r in found])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _texts_in(batches):
            p = model.value.probability(_pooled(some.column("text").to_pylist(), *held.value))
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(p), *map(some.column, keep)], names=["doc_id", "score", *keep])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(c for c in keep if c != "text"))
    schema = ", ".join(["doc_id long", "score double", *(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in keep)])
    scored = slim.mapInArrow(run, schema)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *keep)
