"""Improbable-feature digests: rare byte windows in chained Bloom filters, compared by normalised bit overlap."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.hashing import mix

#: Bytes of a window; entropy levels told apart.
WINDOW, LEVELS = 64, 1000
#: A feature is chosen if it is the rarest of at least so many of the WINDOW neighbourhoods it lies in.
POPULAR = 16
#: Bits and features of a filter, bits a feature sets, and the share of the overlap beyond chance that counts as none.
BITS, FULL, SET, CHANCE = 2048, 160, 5, 0.3
_NONE = np.uint32(0xFFFFFFFF)
_BLOCK = 1 << 19
_F = np.rint(np.arange(WINDOW + 1) * np.log2(np.maximum(np.arange(WINDOW + 1), 1)) * 4096).astype(np.int64)
_STEP = (_F[1:] - _F[:-1])[:WINDOW]


def _levels(data: np.ndarray) -> np.ndarray:
    """Shannon entropy of the window that begins at each byte, as a level of 0..LEVELS (the last ones run over the end).

    A byte's count within a window follows from how often it recurs within 63 places, so entropy is a running sum.
    """
    x = np.concatenate([np.zeros(WINDOW, np.uint8), data, np.zeros(WINDOW, np.uint8)])
    after, before = np.zeros(len(x), np.uint8), np.zeros(len(x), np.uint8)
    for lag in range(1, WINDOW):
        same = (x[lag:] == x[:-lag]).view(np.uint8)
        before[lag:] += same
        after[:-lag] += same
    change = _STEP[before[WINDOW:]] - _STEP[after[:-WINDOW]]
    total = np.cumsum(change)[WINDOW - 1 : -1] + _F[WINDOW]
    return ((6 * 64 * 4096 - total[: len(data)]) * LEVELS // (6 * 64 * 4096)).astype(np.int64)


def _joined(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Texts joined into blocks: first text, end text, bytes, their bounds."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= _BLOCK):
            size += len(texts[end])
            end += 1
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts[at:end]])]).astype(np.int64)
        yield at, end, np.frombuffer(b"".join(texts[at:end]), np.uint8), bounds
        at = end


def _whole(bounds: np.ndarray, n: int) -> np.ndarray:
    """True where a window lies inside one text."""
    good = np.ones(n, bool)
    for k in range(1, WINDOW):
        i = bounds[1:] - k
        good[i[i >= 0]] = False
    return good


def _features(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """For each text, the hashes of its chosen windows in order; for a text without any, of the text itself."""
    out: list[np.ndarray] = []
    for first, end, data, bounds in _joined(texts):
        chosen = np.zeros(0, np.int64)
        if len(data):
            rank = ranks[_levels(data)]
            place = np.arange(len(data), dtype=np.uint64)
            key = np.where(_whole(bounds, len(data)) & (rank > 0), (rank.astype(np.uint64) << np.uint64(44)) | place, np.uint64(1 << 63))
            key = np.concatenate([np.full(WINDOW - 1, 1 << 63, np.uint64), key, np.full(WINDOW - 1, 1 << 63, np.uint64)])
            width = 1
            while width < WINDOW:
                key = np.minimum(key[:-width], key[width:])
                width *= 2
            found = (key[key < np.uint64(1 << 63)] & np.uint64((1 << 44) - 1)).astype(np.int64)
            chosen = np.flatnonzero(np.bincount(found, minlength=1) >= POPULAR) if len(found) else chosen
        value = np.zeros(0, np.uint64)
        if len(chosen):
            rows = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[chosen]
            eight = np.ascontiguousarray(rows).view(np.uint64)
            value = mix(mix(eight + np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum(axis=1, dtype=np.uint64))
        for text, some in zip(texts[first:end], np.split(value, np.searchsorted(chosen, bounds[1:-1]))):
            if len(some):
                _, at = np.unique(some, return_index=True)
                out.append(some[np.sort(at)])
            elif text:
                out.append(np.frombuffer(hashlib.sha256(text).digest()[:8], np.uint64))
            else:
                out.append(some)
    return out


def _digest(features: np.ndarray) -> np.ndarray:
    """Chained filters as rows of bits, each full one with FULL features."""
    filters = np.zeros((-(-len(features) // FULL), BITS), np.uint8)
    chain = np.arange(len(features)) // FULL
    for i in range(SET):
        filters[chain, ((features >> np.uint64(11 * i)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return filters


def likeness(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> float:
    """0 to 1: for each filter of the digest with fewer features its best overlap with the other's filters, beyond
    what chance gives, averaged by features. Two empty digests are alike, an empty and another are not."""
    if not n_a or not n_b:
        return float(n_a == n_b)
    if n_a > n_b:
        a, b, n_a = b, a, n_b
    a, b = a.astype(np.float32), b.astype(np.float32)
    both, in_a, in_b = a @ b.T, a.sum(1)[:, None], b.sum(1)[None, :]
    most = np.minimum(in_a, in_b)
    chance = in_a * in_b / BITS
    least = chance + CHANCE * (most - chance)
    best = np.where(both > least, (both - least) / np.maximum(most - least, 1e-9), 0).max(1)
    weight = np.full(len(a), FULL, float)
    weight[-1] = n_a - FULL * (len(a) - 1)
    return float(min(1.0, (best * weight).sum() / weight.sum()))


def _written(filters: np.ndarray, n: int) -> str:
    return f"{n}:{base64.b64encode(np.packbits(filters, axis=1).tobytes()).decode()}"


def entropy_ranks(docs: DataFrame) -> np.ndarray:
    """Rank of every entropy level by how rare windows of it are in all texts (1: rarest; 0: never chosen, for
    windows of one byte value). What reaches the driver is one count a level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(LEVELS + 1, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").slice(i, 500).to_pylist()]
                for _, _, data, bounds in _joined(texts):
                    if len(data):
                        count += np.bincount(_levels(data)[_whole(bounds, len(data))], minlength=LEVELS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(LEVELS + 1), pa.int32()), pa.array(count)], names=["level", "n"])

    total = np.zeros(LEVELS + 1, np.int64)
    for row in docs.select("text").mapInArrow(run, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():
        total[row.level] = row.n
    ranks = np.empty(LEVELS + 1, np.int64)
    ranks[np.lexsort((np.arange(LEVELS + 1), total))] = np.arange(1, LEVELS + 2)
    ranks[0] = 0
    return ranks


def _compared(ranks):
    def done(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
        """Rows of one bucket in order; the last one is only there as the next of the one before it."""
        texts = [t for _, _, t in rows]
        edited = []
        for text, after in zip(texts, texts[1:]):
            n = len(text) // 3
            edited.append(text[: len(text) - n] + after[:n])
        plain = [t.encode("utf-8", "surrogatepass") for t in texts]
        changed = [t.encode("utf-8", "surrogatepass") for t in edited]
        found = _features(plain + changed, ranks.value)
        sizes = [len(f) for f in found]
        filters = [_digest(f) for f in found]
        n = len(edited)
        own, other = range(n), range(n + 1, 2 * n + 1)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[1] for r in rows[:n]], pa.int64()),
                pa.array([len(t) for t in texts[:n]], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in changed]),
                pa.array([_written(filters[i], sizes[i]) for i in own]),
                pa.array([_written(filters[i], sizes[i]) for i in other]),
                pa.array([likeness(filters[i], filters[j], sizes[i], sizes[j]) for i, j in zip(own, other)], pa.float64()),
                pa.array([likeness(filters[i], filters[i + 1], sizes[i], sizes[i + 1]) for i in own], pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, ended = 0, False
        for batch in batches:
            for bucket, extra, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "extra", "doc_id", "text"))):
                if held and held[-1][0] != bucket:
                    if len(held) > 1:
                        yield done(held)
                    held, size, ended = [], 0, False
                if ended:  # a repeated row of the next bucket's first document
                    continue
                held.append((bucket, doc_id, text or ""))
                size += len(text or "")
                ended = bool(extra)
                if size > 1 << 21 and len(held) > 1:
                    yield done(held)
                    held, size = held[-1:], len(held[-1][2])
        if len(held) > 1:
            yield done(held)

    return run


def fingerprints(docs: DataFrame, ranks: np.ndarray | None = None, buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike fingerprints are.

    ``docs`` has doc_id (long) and text. The edited text of a document has its last third replaced by as many
    characters of the next document's beginning (descending doc_id; after the last, the first). Returns one row per
    row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null texts count as
    empty; an empty text has no features, and only another such is like it. Texts without a full window, or whose
    windows each hold one byte value, have one feature: the text. Repeated doc_ids follow each other in order of their
    texts; null doc_ids come last. ``ranks`` as of ``entropy_ranks`` (over ``docs``, if not given).

    Documents are dealt by ranges of doc_id; the first document of each range is copied to the range above it, as the
    next of its last one. Bounds and one id a range reach the driver.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranks = spark.sparkContext.broadcast(entropy_ranks(docs) if ranks is None else ranks)
    order = F.coalesce("doc_id", F.lit(-(1 << 63)))
    buckets = buckets or min(1000, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = docs.select(F.col("doc_id").alias("id")).where("id is not null")
    bounds = sorted(set(ids.approxQuantile("id", [i / buckets for i in range(1, buckets)], 0.2 / buckets)))
    bucket: Column = F.size(F.filter(F.array(*(F.lit(int(b)) for b in bounds)), lambda b: b < order)) if bounds else F.lit(0)
    rows = docs.withColumn("bucket", bucket.cast("int")).withColumn("extra", F.lit(0))
    heads = sorted((r.bucket, r.id) for r in rows.groupBy("bucket").agg(F.max(order).alias("id")).collect())
    into = {top: heads[(i + 1) % len(heads)][0] for i, (_, top) in enumerate(heads)}  # the top range's to the lowest
    if into:
        target = F.create_map(*(F.lit(x) for pair in into.items() for x in pair))
        first = rows.where(order.isin([*into])).withColumn("bucket", target[order]).withColumn("extra", F.lit(1))
        rows = rows.unionByName(first)
    rows = rows.withColumn("order", order).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket")
    rows = rows.sortWithinPartitions("bucket", "extra", F.desc("order"), "text").select("bucket", "extra", "doc_id", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(_compared(ranks), schema)
