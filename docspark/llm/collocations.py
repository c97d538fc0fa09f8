"""Phrase collocation mining: frequent phrases of two to five words and how strongly their parts belong together.

Words get ids by their frequency in a language. Ids are split into classes, narrow ones where words are frequent, and two
classes make a tile of pairs. Each shard of text counts its pairs tile by tile: by direct address (a bincount over the
tile's cells) where a tile is full, as sorted coordinates where it is sparse. Tiles are what Spark shuffles and adds up.
Frequent pairs get ids by their frequency again, and two of them that overlap by all but a word make the next longer phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from docspark.llm.divergence import _packed, _unpacked
from docspark.plans.storage import small, written

#: Words and breaks of a shard of one language (a longer text is a shard); entries a task holds before it merges or sends them.
SHARD, HELD = 1 << 21, 1 << 21
#: Cells of tiles that are added up by direct address.
CELLS = 1 << 22
#: Tables of so many rows are broadcast; of words, with so many letters in all.
BROADCAST_ROWS, BROADCAST_LETTERS = 200_000, 1 << 24
#: Phrases are ranked in so many parts of a language first.
PARTS = 64


def _bounds() -> np.ndarray:
    """Where classes of ids begin: 64 ids wide at first, then a quarter of the ids before them, 65,536 at most."""
    out = [0]
    while out[-1] < 1 << 32:
        out.append(out[-1] + min(1 << 16, max(64, out[-1] // 4)))
    return np.array(out, np.int64)


BOUNDS = _bounds()
WIDTHS = np.diff(BOUNDS)
_CLASS = (np.searchsorted(BOUNDS, np.arange(1 << 20), "right") - 1).astype(np.int32)
#: A-Z are folded, tabs are spaces, and what ends a piece becomes a byte that no text holds.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz " + b"\xff" * 10)


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


_SHARDS = "shard long, lang string, words array<string>, counts array<long>, codes binary"


def _sharded(most: int):
    """Texts as numbers of words, 0 between pieces, with the shard's own dictionary in order of frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids: dict[str, _Ids] = {}
        held: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}

        def sent(lang: str) -> pa.RecordBatch:
            nonlocal made
            codes, words = np.concatenate(held.pop(lang)), list(ids.pop(lang))
            size.pop(lang)
            n = np.bincount(codes, minlength=len(words))
            n[0] = 0  # breaks
            order = np.concatenate([[0], 1 + np.argsort(-n[1:], kind="stable")])
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            columns = [part << 32 | made, lang, [words[i].decode("utf-8", "replace") for i in order[1:]], n[order[1:]], _packed(rank[codes])]
            made += 1
            kinds = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in _SHARDS.split(", ")])

        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                some = batch.slice(i, 500)
                for lang, text in zip(some.column("lang").to_pylist(), some.column("text").cast(pa.binary()).to_pylist()):
                    words = text.translate(_TABLE).replace(b"\xff", b" \xff ").split()
                    if lang not in ids:
                        ids[lang], held[lang], size[lang] = _Ids({b"\xff": 0}), [], 0
                    held[lang] += [np.fromiter(map(ids[lang].__getitem__, words), np.uint32, len(words)), np.zeros(1, np.uint32)]
                    size[lang] += len(words) + 1
                    if size[lang] >= most:
                        yield sent(lang)
                if sum(size.values()) > 2 * most:
                    for lang in list(ids):
                        yield sent(lang)
        for lang in list(ids):
            yield sent(lang)

    return run


def _squeezed(x: np.ndarray) -> np.ndarray:
    """Runs of zeros as one."""
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 0) | (x[:-1] != 0)
    return x[keep]


def _classes(ids: np.ndarray) -> np.ndarray:
    if len(ids) and ids.max() >= len(_CLASS):
        return np.searchsorted(BOUNDS, ids, "right") - 1
    return _CLASS[ids]


def _tiles(x: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(class, class, cells, counts) of every tile of pairs that lie side by side in ``x``; cells ascend."""
    if len(x) and x.max() < 1 << 31:
        x = x.astype(np.int32)
    at = np.flatnonzero((x[:-1] != 0) & (x[1:] != 0))
    a, b = x[at] - 1, x[at + 1] - 1
    del at
    ca, cb = _classes(a), _classes(b)
    side = int(cb.max()) + 1 if len(cb) else 1
    tile = ca.astype(np.int64) * side + cb
    order = np.argsort(tile.astype(np.uint16) if side * (int(ca.max()) + 1 if len(ca) else 1) <= 1 << 16 else tile, kind="stable")
    cell = ((a - BOUNDS[ca]) * WIDTHS[cb] + b - BOUNDS[cb])[order]
    tile = tile[order]
    edge = np.flatnonzero(np.diff(tile)) + 1
    for begin, end in zip([0, *edge], [*edge, len(tile)] if len(tile) else []):
        first, second = divmod(int(tile[begin]), side)
        some, cells = cell[begin:end], int(WIDTHS[first] * WIDTHS[second])
        if cells <= 8 * len(some):
            n = np.bincount(some, minlength=cells)
            found = np.flatnonzero(n)
            yield first, second, found, n[found]
        else:
            yield first, second, *np.unique(some, return_counts=True)


_TILED = "shard long, lang string, first int, second int, cells binary, counts binary"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, lang, codes in zip(*(batch.column(c).to_pylist() for c in ("shard", "lang", "codes"))):
            rows = [(first, second, _packed(cells), _packed(n)) for first, second, cells, n in _tiles(_unpacked(codes))]
            first, second, cells, n = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * len(rows), pa.int64()), pa.array([lang] * len(rows), pa.string()), pa.array(first, pa.int32()), pa.array(second, pa.int32()), pa.array(cells, pa.binary()), pa.array(n, pa.binary())],
                names=[c.split()[0] for c in _TILED.split(", ")],
            )


def _added(least: int, most: int, full: int):
    """Sums of tiles that come one after another; cells of at least ``least`` as pairs of ids."""

    def merged(some: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        cells, n = (np.concatenate(x) for x in zip(*some))
        order = np.argsort(cells, kind="stable")
        cells = cells[order]
        at = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
        return cells[at], np.add.reduceat(n[order], at)

    def ended(tile, dense, some) -> pa.RecordBatch:
        lang, first, second = tile
        if dense is not None:
            cells = np.flatnonzero(dense >= least)
            n = dense[cells]
        else:
            cells, n = merged(some)
            cells, n = cells[n >= least], n[n >= least]
        a, b = np.divmod(cells, WIDTHS[second])
        columns = [pa.array([lang] * len(n), pa.string()), *(pa.array([c] * len(n), pa.int32()) for c in (first, second)), pa.array(a + BOUNDS[first] + 1), pa.array(b + BOUNDS[second] + 1), pa.array(n)]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "first", "second", "a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, dense, some, size = None, None, [], 0
        for batch in batches:
            for *tile, cells, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "first", "second", "cells", "counts"))):
                if tile != now:
                    if now:
                        yield ended(now, dense, some)
                    now, some, size = tile, [], 0
                    whole = int(WIDTHS[tile[1]] * WIDTHS[tile[2]])
                    dense = np.zeros(whole, np.int64) if whole <= full else None
                cells, n = _unpacked(cells), _unpacked(n)
                if dense is not None:
                    dense[cells] += n  # a row has a cell once
                    continue
                some.append((cells, n))
                size += len(n)
                if size > most and len(some) > 1:
                    some = [merged(some)]
                    size = len(some[0][0]) // 2
        if now:
            yield ended(now, dense, some)

    return run


def _ranked(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` (lang, n, keys) written with ``id``, from 1 in each lang by n, largest first.

    Rows are sorted by ranges; a row's id is its place in its range after the sizes of the ranges before.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["lang", F.desc("n"), *keys]
    placed = written(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "phrases-placed")
    part = F.shiftrightunsigned("at", 33).alias("part")
    sizes = placed.groupBy("lang", part).agg(F.min("at").alias("least"), F.count(F.lit(1)).alias("size"))
    before = F.sum("size").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("lang", "part", (F.coalesce(before, F.lit(0)) - F.col("least") + 1).alias("shift"))  # a row a range and lang
    sizes = F.broadcast(sizes) if small(sizes, BROADCAST_ROWS) else sizes
    return written(placed.withColumn("part", part).join(sizes, ["lang", "part"]).withColumn("id", F.col("at") + F.col("shift")).drop("at", "part", "shift"), "phrases-ranked")


def _renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's own numbers of words as ids of frequent words, 0 for all others."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            codes, known = _unpacked(row.column("codes")[0].as_py()), row.column("known")[0]
            table = np.zeros(int(codes.max()) + 1 if len(codes) else 1, np.int64)
            if known.is_valid:
                pos, ids = (known.values.field(c).to_numpy() for c in ("pos", "id"))
                table[pos + 1] = ids
            yield pa.RecordBatch.from_arrays([row.column("shard"), row.column("lang"), pa.array([_packed(_squeezed(table[codes]))], pa.binary())], names=["shard", "lang", "codes"])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a shard's tile and the tile's frequent pairs: those that the shard holds, with their ids."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            second, cells = row.column("second")[0].as_py(), _unpacked(row.column("cells")[0].as_py())
            pairs = row.column("pairs")[0].values
            a, b, ids = (pairs.field(c).to_numpy() for c in ("a", "b", "id"))
            first = row.column("first")[0].as_py()
            here = np.isin((a - 1 - BOUNDS[first]) * WIDTHS[second] + b - 1 - BOUNDS[second], cells)
            if here.any():
                yield pa.RecordBatch.from_arrays([row.column("shard"), *(pa.array([_packed(x[here])], pa.binary()) for x in (a, b, ids))], names=["shard", "a", "b", "ids"])


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of frequent pairs where they begin, 0 elsewhere."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            x = _unpacked(row.column("codes")[0].as_py())
            known = row.column("known")[0].as_py()
            a, b, ids = (np.concatenate([_unpacked(k[c]) for k in known]) for c in ("a", "b", "ids"))
            if max(int(a.max()), int(b.max()), int(x.max())) >= 1 << 32:
                raise ValueError("more than four billion frequent phrases of a length in a language")
            key = a << 32 | b
            order = np.argsort(key)
            key, ids = key[order], ids[order]
            side = x[:-1] << 32 | x[1:]
            at = np.minimum(np.searchsorted(key, side), len(key) - 1)
            made = np.where(key[at] == side, ids[at], 0)
            yield pa.RecordBatch.from_arrays([row.column("shard"), row.column("lang"), pa.array([_packed(_squeezed(np.append(made, 0)))], pa.binary())], names=["shard", "lang", "codes"])


def _side(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small(df, BROADCAST_ROWS) else df


def _cuts(size: int) -> Column:
    """The cut of least score (then of the shortest first part) of a phrase of ``size`` words: score, cut, l, r."""
    wide = lambda c: c.cast("decimal(16,0)")
    cuts = []
    for k in range(1, size):
        l, r = F.element_at("heads", k), F.element_at("tails", size - k)
        # decimals of 38 digits hold the products exactly
        cuts.append(F.struct(F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide(F.col("n")) * wide(F.col("words")), wide(l) * wide(r)).alias("score"), F.lit(k).alias("cut"), l.alias("l"), r.alias("r")))
    return F.array_min(F.array(*cuts))


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, shard: int = SHARD, held: int = HELD, cells: int = CELLS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words that occur at least ``least`` times.

    ``docs`` has text and lang. A-Z are lower-cased; ``. , ; : ! ?`` and line ends end a piece; words are split by spaces and
    tabs. a counts all occurrences within pieces, overlapping ones too; l and r those of the two parts of the cut with the
    least score floor(1000 * a * n / (l * r)), n all words of the language. Phrases inside a longer one that occurs as often are left
    out. Ranks are by score and a, largest first, then by phrase. Null texts are empty; null langs are ``und``; repeated rows count
    each; a language without frequent phrases gives no row.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    shards = written(texts.mapInArrow(_sharded(shard), _SHARDS), "phrases-shards")
    each = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "own")).select("shard", "lang", "pos", F.col("own.words").alias("word"), F.col("own.counts").alias("n"))
    total = shards.select("lang", F.expr("aggregate(counts, 0L, (x, y) -> x + y)").alias("n")).groupBy("lang").agg(F.sum("n").alias("words"))
    words = _ranked(each.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "word")
    light = words.agg(F.count(F.lit(1)) <= BROADCAST_ROWS, F.coalesce(F.sum(F.length("word")), F.lit(0)) <= BROADCAST_LETTERS).first()
    dictionary = words.select("lang", "word", "id")
    known = each.select("shard", "lang", "pos", "word").join(F.broadcast(dictionary) if all(light) else dictionary, ["lang", "word"])
    known = known.groupBy("shard").agg(F.collect_list(F.struct("pos", "id")).alias("known"))  # of one shard's words
    codes = written(shards.select("shard", "lang", "codes").join(known, "shard", "left").mapInArrow(_renamed, "shard long, lang string, codes binary"), "phrases-codes")
    empty = F.array().cast("array<long>")
    shorter = words.select("lang", "id", "n", F.col("word").alias("phrase"), F.col("word").alias("last"), empty.alias("heads"), empty.alias("tails"))
    candidates = []
    for size in range(2, longest + 1):
        tiles = written(codes.mapInArrow(_counted, _TILED), "phrases-tiles")
        dealt = tiles.drop("shard").repartition(parts, "lang", "first", "second").sortWithinPartitions("lang", "first", "second")
        pairs = _ranked(dealt.mapInArrow(_added(least, held, cells), "lang string, first int, second int, a long, b long, n long"), "a", "b")
        left = shorter.select("lang", F.col("id").alias("a"), F.col("n").alias("head"), "phrase", "heads")
        right = shorter.select("lang", F.col("id").alias("b"), F.col("n").alias("tail"), "last", "tails")
        longer = pairs.select("lang", "id", "a", "b", "n").join(left, ["lang", "a"]).join(right, ["lang", "b"])
        longer = written(longer.select("lang", "id", "a", "b", "n", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", F.concat("heads", F.array("head")).alias("heads"), F.concat("tails", F.array("tail")).alias("tails")), "phrases-longer")
        if size > 2:
            over = longer.select("lang", F.col("a").alias("id"), "n").unionByName(longer.select("lang", F.col("b").alias("id"), "n"))
            over = over.groupBy("lang", "id").agg(F.max("n").alias("over"))
            candidates[-1] = candidates[-1].join(over, ["lang", "id"], "left").where("over is null or over < n").drop("over")
        candidates.append(longer.withColumn("size", F.lit(size)))
        shorter = longer
        if size == longest or not pairs.take(1):
            break
        by_tile = pairs.groupBy("lang", "first", "second").agg(F.collect_list(F.struct("a", "b", "id")).alias("pairs"))
        by_tile = F.broadcast(by_tile) if small(pairs, BROADCAST_ROWS) else by_tile
        found = tiles.drop("counts").join(by_tile, ["lang", "first", "second"]).mapInArrow(_found, "shard long, a binary, b binary, ids binary")
        found = found.groupBy("shard").agg(F.collect_list(F.struct("a", "b", "ids")).alias("known"))  # of one shard's pairs
        codes = written(codes.join(found, "shard").mapInArrow(_paired, "shard long, lang string, codes binary"), "phrases-codes")
    scored = []
    for size, some in enumerate(candidates, 2):
        some = some.join(_side(total), "lang").withColumn("best", _cuts(size))
        scored.append(some.select("lang", "phrase", F.col("n").alias("a"), "best.l", "best.r", F.col("words").alias("n"), "best.score"))
    every = scored[0]
    for some in scored[1:]:
        every = every.unionByName(some)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    every = every.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    every = every.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    every = every.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return every.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
