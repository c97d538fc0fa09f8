"""Language of words in code-switched text: a linear-chain conditional random field over affixes, n-grams and words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.hashing import mix, word_blocks
from docspark.llm.samples import held_out, labelled_sample

#: Rows of the tables of hashed features: trigrams of bytes, affixes, whole words.
GRAMS, AFFIXES, LEXICON = 1 << 16, 1 << 15, 1 << 17
#: Words of a chunk; chunks of a text are joined through their transfer matrices.
CHUNK = 32
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


def _hashed(n: int, size: int, kind: int, *parts: np.ndarray) -> np.ndarray:
    total = np.full(n, kind, np.uint64)
    for part in parts:
        total = total * np.uint64(0x100000001B3) + part
    return (mix(total) % np.uint64(size)).astype(np.int64)


def _features(block: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram at each byte (as a row), affix rows (two prefixes, two suffixes) and lexicon row of each word."""
    _, raw, start, end, value = block
    x = _FOLD[raw]
    grams = np.zeros(len(raw), np.int64)
    grams[:-2] = _hashed(len(raw) - 2, GRAMS, 1, x[:-2], x[1:-1], x[2:])
    n, last = len(start), len(raw) - 1
    at = lambda i: x[np.clip(i, 0, last)]
    affixes = np.stack(
        [
            _hashed(n, AFFIXES, 2, at(start), at(start + 1)),
            _hashed(n, AFFIXES, 3, at(start), at(start + 1), at(start + 2)),
            _hashed(n, AFFIXES, 4, at(end - 1), at(end - 2)),
            _hashed(n, AFFIXES, 5, at(end - 1), at(end - 2), at(end - 3)),
        ]
    )
    return grams, affixes, (value % np.uint64(LEXICON)).astype(np.int64)


@dataclass
class LanguageModel:
    names: list[str]
    grams: np.ndarray
    affixes: np.ndarray
    lexicon: np.ndarray
    moves: np.ndarray  # learned transition weights

    def emissions(self, block: tuple) -> np.ndarray:
        """Score of each word for each language: the mean of its trigrams', its affixes' and its own weights."""
        _, _, start, end, _ = block
        grams, affixes, lexicon = _features(block)
        total = np.zeros((len(grams) + 1, len(self.names)))
        np.cumsum(self.grams[grams], axis=0, out=total[1:])
        # trigrams from the space before a word to the space after it
        out = (total[end - 1] - total[start - 1]) / np.maximum(end - start, 1)[:, None]
        for row in affixes:
            out += self.affixes[row]
        return out + self.lexicon[lexicon]


def marginals(score: np.ndarray, owner: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Probability of each label of each word, exactly, by forward-backward over each run of equal ``owner``.

    Texts are cut into chunks; all chunks go forward together as transfer matrices, the chunks of a text are then
    joined in order, and the words inside follow from the messages at their chunk's ends.
    """
    n, k = score.shape
    if not n:
        return score
    emit = np.exp(score - score.max(1, keepdims=True))
    move = np.exp(moves - moves.max())
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    length = np.diff(np.concatenate([first, [n]]))
    chunks = -(-length // CHUNK)
    base = np.concatenate([[0], np.cumsum(chunks)])
    text = np.repeat(np.arange(len(first)), length)
    inside = np.arange(n) - first[text]
    place = (base[:-1][text] + inside // CHUNK) * CHUNK + inside % CHUNK
    m = int(base[-1])
    e, real = np.ones((m * CHUNK, k)), np.zeros(m * CHUNK, bool)
    e[place], real[place] = emit, True
    e, real = e.reshape(m, CHUNK, k), real.reshape(m, CHUNK)

    matrix = np.broadcast_to(np.eye(k), (m, k, k)).copy()
    for t in range(CHUNK):
        new = (matrix.reshape(m * k, k) @ move).reshape(m, k, k) * e[:, t, None, :]
        matrix = np.where(real[:, t, None, None], new, matrix)
        matrix /= matrix.max(axis=(1, 2), keepdims=True)
    into, outof = np.full((m, k), 1 / k), np.ones((m, k))
    order = np.argsort(-chunks, kind="stable")
    for c in range(1, int(chunks.max())):
        some = base[:-1][order[: np.searchsorted(-chunks[order], -c, "left")]] + c  # texts with more than c chunks
        step = np.einsum("ni,nij->nj", into[some - 1], matrix[some - 1])
        into[some] = step / step.sum(1, keepdims=True)
    for c in range(int(chunks.max()) - 1, 0, -1):
        some = base[:-1][order[: np.searchsorted(-chunks[order], -c, "left")]] + c
        step = np.einsum("nij,nj->ni", matrix[some], outof[some])
        outof[some - 1] = step / step.sum(1, keepdims=True)

    forward = np.empty_like(e)
    now = into
    for t in range(CHUNK):
        new = (now @ move) * e[:, t]
        now = np.where(real[:, t, None], new / np.maximum(new.sum(1, keepdims=True), 1e-300), now)
        forward[:, t] = now
    now = outof
    for t in range(CHUNK - 1, -1, -1):
        both = forward[:, t] * now
        forward[:, t] = both / np.maximum(both.sum(1, keepdims=True), 1e-300)
        new = (now * e[:, t]) @ move.T
        now = np.where(real[:, t, None], new / np.maximum(new.sum(1, keepdims=True), 1e-300), now)
    return forward.reshape(m * CHUNK, k)[place]


def _switching(rows: list[tuple[str, object]], names: list[str], size: int, seed: int):
    """Training texts that switch language: runs of words of different labelled texts, one after another."""
    random = np.random.default_rng(seed)
    runs = []
    for text, name in rows:
        words, at = text.split(), 0
        while at < len(words):
            n = int(random.choice([3, 6, 12, 25, 50]))
            runs.append((" ".join(words[at : at + n]), min(n, len(words) - at), names.index(name)))
            at += n
    random.shuffle(runs)
    texts, labels = [], []
    held, held_labels = [], []
    for text, n, name in runs:
        held.append(text)
        held_labels += [name] * n
        if len(held_labels) >= size:
            texts.append("\n".join(held))
            labels.append(held_labels)
            held, held_labels = [], []
    if held:
        texts.append("\n".join(held))
        labels.append(held_labels)
    return texts, labels


def fit_language(rows: list[tuple[str, object]], epochs: int = 3, rate: float = 0.3, seed: int = 3) -> LanguageModel:
    """Maximise the likelihood of the words' labels, with adaptive gradient steps; transitions are learned too."""
    names = sorted({name for _, name in rows})
    k = len(names)
    model = LanguageModel(names, *(np.zeros((n, k)) for n in (GRAMS, AFFIXES, LEXICON)), np.zeros((k, k)))
    if k < 2:
        return model
    tables = [model.grams, model.affixes, model.lexicon, model.moves]
    seen = [np.full_like(t, 1e-2) for t in tables]
    texts, labels = _switching(rows, names, 100, seed)
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        for some in np.array_split(random.permutation(len(texts)), max(1, len(texts) // 64)):
            for block in word_blocks([texts[i] for i in some]):
                owner, raw, start, end, _ = block
                truth = np.concatenate([np.array(labels[i]) for i in some])
                if len(truth) != len(start):  # words cut by white space other than ASCII's
                    continue
                score = model.emissions(block)
                p = marginals(score, owner, model.moves)
                d = p.copy()
                d[np.arange(len(truth)), truth] -= 1
                grams, affixes, lexicon = _features(block)
                size = end - start + 1  # trigrams start - 1 .. end - 2, and one more byte for none
                word = np.repeat(np.arange(len(start)), size - 1)
                pos = np.arange(len(word)) - np.repeat(np.cumsum(size - 1) - (size - 1), size - 1) + np.repeat(start - 1, size - 1)
                share = d / np.maximum(end - start, 1)[:, None]
                grads = [
                    np.stack([np.bincount(grams[pos], share[word, c], GRAMS) for c in range(k)], 1),
                    sum(np.stack([np.bincount(row, d[:, c], AFFIXES) for c in range(k)], 1) for row in affixes),
                    np.stack([np.bincount(lexicon, d[:, c], LEXICON) for c in range(k)], 1),
                ]
                # expected less seen transitions
                same = owner[1:] == owner[:-1]
                a, b = np.flatnonzero(same), np.flatnonzero(same) + 1
                pair = p[a][:, :, None] * np.exp(model.moves)[None] * p[b][:, None, :]
                pair /= pair.sum((1, 2), keepdims=True)
                move = pair.sum(0)
                np.add.at(move, (truth[a], truth[b]), -1)
                grads.append(move)
                for table, g2, g in zip(tables, seen, grads):
                    g = g + 1e-6 * table
                    g2 += g * g
                    table -= rate * g / np.sqrt(g2)
    return model


def languages(docs: DataFrame, labelled: DataFrame, sample: int = 1500, characters: int = 3_000_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """Language of every whole text of ``docs`` (doc_id, text).

    ``labelled`` (doc_id, text, lang) is learned from, where its doc_id isn't held out and lang isn't null: of each
    language at most ``sample`` rows of ``characters`` code points together, whole texts, mixed into texts that switch
    language. Every word of every text gets a probability for each language; a text's language is the one with the
    highest mean over its words with letters, ties to the first in order. Returns one row per row: doc_id, held_out,
    lang_pred, score (that mean). Texts that are null or without a letter, and all texts if nothing could be learned,
    are ``und`` with score 0. With one language learned, it is every text's. Repeated rows are judged each, an empty
    table gives none, very long texts are read in blocks. Columns in ``keep`` are handed through.
    """
    rows = labelled_sample(labelled, labelled.select("doc_id", F.col("lang").alias("label")), sample, characters)
    rows = sorted((r.doc_id, r.text, r.label) for r in rows.collect())
    model = docs.sparkSession.sparkContext.broadcast(fit_language([(text, label) for _, text, label in rows]))
    del rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        k = max(1, len(m.names))
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                some = batch.slice(i, 500)
                total, count = np.zeros((some.num_rows, k)), np.zeros(some.num_rows)
                for block in word_blocks(some.column("text").to_pylist()) if m.names else ():
                    owner, raw, start, end, _ = block
                    if not len(owner):
                        continue
                    letters = np.concatenate([[0], np.cumsum(_LETTER[raw])])
                    counts = letters[end] > letters[start]
                    p = marginals(m.emissions(block), owner, m.moves) * counts[:, None]
                    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                    total[owner[first]] += np.add.reduceat(p, first, axis=0)
                    count[owner[first]] += np.add.reduceat(counts.astype(float), first)
                mean = total / np.maximum(count, 1)[:, None]
                best = mean.argmax(1)
                name = [m.names[b] if m.names and c else None for b, c in zip(best, count)]
                score = np.where(count > 0, mean[np.arange(len(best)), best], 0.0)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("lettered"), pa.array(name, pa.string()), pa.array(np.clip(score, 0, 1)), *map(some.column, keep)], names=["doc_id", "lettered", "best", "score", *keep])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lettered, *(c for c in keep if c != "text"))
    schema = ["doc_id long", "lettered boolean", "best string", "score double", *(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in keep)]
    found = slim.mapInArrow(run, ", ".join(schema))
    known = F.col("lettered") & F.col("best").isNotNull()
    return found.select("doc_id", held_out().alias("held_out"), F.when(known, F.col("best")).otherwise("und").alias("lang_pred"), F.when(known, F.col("score")).otherwise(0.0).alias("score"), *keep)
