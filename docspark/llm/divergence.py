"""Source divergence audit: how far the words of each source of a language lie from those of its other sources.

Words are never made strings while they are counted: pointers to word starts in Arrow's buffers are sorted by
multikey quicksort, eight bytes at a time, and equal runs give counts and document frequencies for each source. Sorted
runs are dealt by a hash of the word to shards, where the same sort merges them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from docspark.llm.hashing import mix
from docspark.plans.storage import small, written

#: Bytes of text sorted at a time (a longer text is one block), and counts a task holds before it sends or merges them.
BLOCK, HELD = 1 << 23, 1 << 21
#: Slices of so many pointers are sorted as they are.
SMALL = 1 << 15
#: Terms of a tile, and sources of a block, in which pairs of sources are compared.
TERMS, SOURCES = 4096, 256
#: Tables of so many sources are broadcast.
BROADCAST_ROWS = 100_000
SCALE = 1_000_000_000

_WORD = np.zeros(256, bool)
_WORD[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_KEEP = np.array([(1 << 64) - (1 << 8 * (8 - n)) for n in range(9)], np.uint64)  # the first n of eight bytes


class _Keys:
    """Eight bytes of each word as a number that sorts as they do; bytes after the word's end are 0, which no word holds."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray):
        self.view = np.ndarray((len(data) + 1,), ">u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
        self.begin, self.size = begin, size

    def __call__(self, which: np.ndarray, depth: int) -> np.ndarray:
        left = self.size[which] - depth
        at = np.minimum(self.begin[which] + depth, len(self.view) - 1)
        return self.view[at].astype(np.uint64) & _KEEP[np.clip(left, 0, 8)]


def _slice_sorted(keys: _Keys, part: np.ndarray, key: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    part, key = part[order], key[order]
    new = np.ones(len(part), bool)
    new[1:] = key[1:] != key[:-1]
    unended = (key & np.uint64(0xFF)) != 0
    while unended.any():
        depth += 8
        at = np.flatnonzero(unended)
        run, some = np.cumsum(new)[at], part[at]
        key = keys(some, depth)
        order = np.lexsort((key, run))
        part[at], key = some[order], key[order]
        new[at[1:][(key[1:] != key[:-1]) & (run[1:] == run[:-1])]] = True
        unended[at] = (key & np.uint64(0xFF)) != 0
    return part, new


def pointer_sort(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of words (begin, size) of ``data`` by their bytes, equal ones as they came, and where a run of equal ones begins.

    Multikey quicksort: a slice is parted in three by its next eight bytes; the middle goes on eight bytes deeper.
    """
    keys = _Keys(data, begin, size)
    every = np.arange(len(begin))
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [(every, keys(every, 0), 0)] if len(every) else []
    while todo:
        part, key, depth = todo.pop()
        if key is None:
            new = np.zeros(len(part), bool)
            new[0] = True
            parts.append((part, new))
        elif len(part) <= SMALL:
            parts.append(_slice_sorted(keys, part, key, depth))
        else:
            some = np.sort(key[:: max(1, len(key) // 64)])
            pivot = some[len(some) // 2]
            less, more = key < pivot, key > pivot
            same = part[~(less | more)]
            for side, its, deep in ((part[more], key[more], depth), (same, None, 0) if pivot & np.uint64(0xFF) == 0 else (same, keys(same, depth + 8), depth + 8), (part[less], key[less], depth)):
                if len(side):
                    todo.append((side, its, deep))
    if not parts:
        return every, np.zeros(0, bool)
    return np.concatenate([p for p, _ in parts]), np.concatenate([n for _, n in parts])


def _gathered(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of some words, one after another."""
    before = np.cumsum(size) - size
    return data[np.repeat(begin - before, size) + np.arange(int(size.sum()))]


class Runs:
    """Sorted distinct words with, for each, the sources that hold it: their number, occurrences and documents."""

    def __init__(self, data: np.ndarray, size: np.ndarray, held: np.ndarray, source: np.ndarray, n: np.ndarray, docs: np.ndarray):
        self.data, self.size, self.held, self.source, self.n, self.docs = data, size, held, source, n, docs

    @classmethod
    def of_words(cls, data: np.ndarray, begin: np.ndarray, size: np.ndarray, doc: np.ndarray, source: np.ndarray) -> Runs:
        """From words in order of sources and documents."""
        order, new = pointer_sort(data, begin, size)
        doc, source = doc[order], source[order]
        entry = new.copy()
        entry[1:] |= source[1:] != source[:-1]
        first = entry.copy()
        first[1:] |= doc[1:] != doc[:-1]
        at, run = np.flatnonzero(entry), np.flatnonzero(new)
        n = np.diff(np.append(at, len(order)))
        docs = np.add.reduceat(first.astype(np.int64), at) if len(at) else n
        held = np.diff(np.append(np.searchsorted(at, run), len(at)))
        words = order[run]
        return cls(_gathered(data, begin[words], size[words]), size[words], held, source[at], n, docs)

    @classmethod
    def merged(cls, some: list[Runs]) -> Runs:
        if len(some) == 1:
            return some[0]
        data, size, held, source, n, docs = (np.concatenate([getattr(r, c) for r in some]) for c in ("data", "size", "held", "source", "n", "docs"))
        begin = np.cumsum(size) - size
        order, new = pointer_sort(data, begin, size)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new) - 1
        word = np.repeat(rank, held)
        by = np.lexsort((source, word))
        word, source, n, docs = word[by], source[by], n[by], docs[by]
        entry = np.ones(len(word), bool)
        entry[1:] = (word[1:] != word[:-1]) | (source[1:] != source[:-1])
        at, words = np.flatnonzero(entry), order[new]
        sums = (lambda x: np.add.reduceat(x, at)) if len(at) else (lambda x: x)
        return cls(_gathered(data, begin[words], size[words]), size[words], np.bincount(word[at], minlength=len(words)), source[at], sums(n), sums(docs))

    def some(self, words: np.ndarray) -> Runs:
        """Those of some words, as given."""
        begin, first = np.cumsum(self.size) - self.size, np.cumsum(self.held) - self.held
        held = self.held[words]
        at = np.repeat(first[words] - (np.cumsum(held) - held), held) + np.arange(int(held.sum()))
        return Runs(_gathered(self.data, begin[words], self.size[words]), self.size[words], held, self.source[at], self.n[at], self.docs[at])

    def shards(self, n: int) -> np.ndarray:
        """A shard for each word, by a hash of its bytes."""
        keys = _Keys(self.data, np.cumsum(self.size) - self.size, self.size)
        out, which, depth = np.zeros(len(self.size), np.uint64), np.arange(len(self.size)), 0
        while len(which):
            out[which] = mix(out[which] ^ keys(which, depth) + np.uint64(depth + 1))
            depth += 8
            which = which[self.size[which] > depth]
        return (out % np.uint64(n)).astype(np.int64)

    def words(self) -> pa.Array:
        offsets = np.append(0, np.cumsum(self.size)).astype(np.int32)
        return pa.StringArray.from_buffers(len(self.size), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(self.data)))


def _packed(x: np.ndarray) -> bytes:
    """Numbers in as many bytes each as the largest needs; the first byte says how many."""
    most = int(x.max()) if len(x) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


def _blocks(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    size = np.cumsum(pa.compute.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of texts as Arrow holds them, and start, length and text of every word."""
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = _WORD[raw]
    edge = np.zeros(len(raw) + 1, bool)  # where one text ends and the next begins
    edge[offsets] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return _LOWER[raw], begin, end - begin, np.searchsorted(offsets, begin, "right") - 1


_SHARDED = "lang string, shard int, sources array<string>, data binary, size binary, held binary, source binary, n binary, docs binary"


def _counted(shards: int, block_size: int, most: int):
    def sent(lang: str, runs: Runs, names: list[str]) -> pa.RecordBatch:
        shard = runs.shards(shards)
        order = np.argsort(shard, kind="stable")
        rows = []
        for words in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            if len(words):
                own = runs.some(words)
                used, source = np.unique(own.source, return_inverse=True)
                rows.append((lang, int(shard[words[0]]), [names[i] for i in used], own.data.tobytes(), *map(_packed, (own.size, own.held, source, own.n, own.docs))))
        kinds = [pa.string(), pa.int32(), pa.list_(pa.string()), *[pa.binary()] * 6]
        columns = list(zip(*rows)) or [()] * 9
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in _SHARDED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[Runs]] = {}
        names: dict[str, dict[str, int]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, some in held.items():
                yield sent(lang, Runs.merged(some), list(names[lang]))
            held.clear()
            names.clear()

        for batch in batches:
            for block in _blocks(batch, block_size):
                block = block.take(pa.compute.sort_indices(block, [("lang", "ascending"), ("source", "ascending")]))
                data, begin, size, doc = _words(block.column("text"))
                langs, sources = (block.column(c).to_pylist() for c in ("lang", "source"))
                ids = np.array([names.setdefault(lang, {}).setdefault(s, len(names[lang])) for lang, s in zip(langs, sources)])
                ends = [i for i in range(1, len(langs)) if langs[i] != langs[i - 1]] + [len(langs)]
                at = 0
                for end in ends:
                    a, b = np.searchsorted(doc, [at, end])
                    held.setdefault(langs[at], []).append(Runs.of_words(data, begin[a:b], size[a:b], doc[a:b], ids[doc[a:b]]))
                    at = end
                if sum(len(r.n) for some in held.values() for r in some) > most:
                    for lang, some in held.items():
                        held[lang] = [Runs.merged(some)]
                    if sum(len(r.n) for some in held.values() for r in some) > most // 2:
                        yield from flush()
        yield from flush()

    return run


def _kept(least: int, most: int):
    def ended(lang: str, some: list[Runs], names: list[str]) -> pa.RecordBatch:
        runs = Runs.merged(some)
        docs = np.add.reduceat(runs.docs, np.cumsum(runs.held) - runs.held)
        runs = runs.some(np.flatnonzero(docs >= least))
        words = runs.words()
        total = np.add.reduceat(runs.n, np.cumsum(runs.held) - runs.held) if len(runs.n) else runs.n
        every, each = np.arange(len(runs.size)), np.repeat(np.arange(len(runs.size)), runs.held)
        source = pa.array(names, pa.string()).take(pa.array(runs.source))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * (len(every) + len(each)), pa.string()),
                pa.concat_arrays([pa.nulls(len(every), pa.string()), source]),
                words.take(pa.array(np.concatenate([every, each]))),
                pa.array(np.concatenate([total, runs.n])),
                pa.array(np.concatenate([total, total[each]])),
            ],
            names=["lang", "source", "term", "n", "total"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, some, names, size = None, [], {}, 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if (row["lang"], row["shard"]) != now:
                    if some:
                        yield ended(now[0], some, list(names))
                    now, some, names, size = (row["lang"], row["shard"]), [], {}, 0
                ids = np.array([names.setdefault(s, len(names)) for s in row["sources"]], np.int64)
                length, held, source, n, docs = (_unpacked(row[c]) for c in ("size", "held", "source", "n", "docs"))
                some.append(Runs(np.frombuffer(row["data"], np.uint8), length, held, ids[source], n, docs))
                size += len(n)
                if size > most and len(some) > 1:
                    some = [Runs.merged(some)]
                    size = len(some[0].n) // 2
        if some:
            yield ended(now[0], some, list(names))

    return run


def source_counts(docs: DataFrame, least: int = 3, block: int = BLOCK, held: int = HELD) -> DataFrame:
    """(lang, source, term, n, total): how often each source of a language holds each of the language's terms that at
    least ``least`` of its documents hold, and how often all of them do; with source null once for each term.

    ``docs`` has text, lang and source; null counts as ''. Terms are runs of letters A-Z, a-z and of characters beyond
    ASCII, A-Z lower-cased. Rows are documents, repeated ones too.
    """
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    sharded = texts.mapInArrow(_counted(shards, block, held), _SHARDED)
    dealt = sharded.repartition(shards, "lang", "shard").sortWithinPartitions("lang", "shard")
    return dealt.mapInArrow(_kept(least, held), "lang string, source string, term string, n long, total long")


def _compared(sources: int):
    """Sums over a tile's terms for every two sources of two blocks. Rows without a term give a source's p of terms that it lacks."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lang, _, first, second = key
        bare = rows[rows.term.isna()].drop_duplicates("pos").sort_values("pos")
        pos, without = bare.pos.to_numpy(), bare.p.to_numpy().astype(np.uint64)
        held = rows[~rows.term.isna()].drop_duplicates(["term", "pos"])
        codes, terms = pd.factorize(held.term)
        p = np.repeat(without[:, None], len(terms), axis=1)
        p[np.searchsorted(pos, held.pos.to_numpy()), codes] = held.p.to_numpy().astype(np.uint64)
        block = pos // sources
        parts = []
        for i in np.flatnonzero(block == first):
            others = np.flatnonzero((block == second) & (pos != pos[i]))
            apart = np.maximum(p[i], p[others]) - np.minimum(p[i], p[others])
            zero = np.maximum(without[i], without[others]) - np.minimum(without[i], without[others])
            square, nothing = apart * apart, zero * zero
            parts.append(pd.DataFrame({"a": pos[i], "b": pos[others], "value": (square // p[others]).sum(1, dtype=np.uint64).astype(np.int64), "zero": (nothing // without[others]).astype(np.int64)}))
            if first != second:
                parts.append(pd.DataFrame({"a": pos[others], "b": pos[i], "value": (square // p[i]).sum(1, dtype=np.uint64).astype(np.int64), "zero": (nothing // without[i]).astype(np.int64)}))
        out = pd.concat(parts) if parts else pd.DataFrame({"a": [], "b": [], "value": [], "zero": []}).astype("int64")
        return out.assign(lang=lang, seen=len(terms))[["lang", "a", "b", "value", "zero", "seen"]]

    return run


def _p(n: str, total: str, terms: str):
    """1 + floor(SCALE * (n + 1) / (total + terms)) in decimals, so that no product overflows; 1 where there are no terms."""
    return F.expr(f"if({terms} = 0, 1L, 1L + (cast({SCALE} as decimal(10,0)) * cast({n} + 1 as decimal(20,0))) div cast({total} + {terms} as decimal(20,0)))")


def source_divergence(docs: DataFrame, top: int = 200, least: int = 3, block: int = BLOCK, held: int = HELD, tile_terms: int = TERMS, tile_sources: int = SOURCES) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) that occurs in ``docs`` (text, lang, source).

    Part ``pair``: how far the source lies from each other source of its language, summed over all terms of the language;
    all of them. Part ``term``: the source's terms that it holds more often than its language does, the ``top`` furthest. Ranks are
    by value, largest first, then by item. Null text, lang and source count as ''. A language without terms gives pairs of
    value 0; a language of one source gives no pairs; empty texts and repeated rows are documents; no rows give none.

    Pairs are summed in tiles of terms and blocks of sources, from the terms that either of two sources holds; all
    others add the same for each and are added by their number. Values fit 64 bits up to two billion terms a language.
    """
    counts = written(source_counts(docs, least, block, held), "divergence-counts")
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    by_lang = counts.where("source is null").groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_n"))
    by_source = counts.where("source is not null").groupBy("lang", "source").agg(F.sum("n").alias("source_n"))
    sources = groups.join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left").fillna(0, ["source_n", "terms", "lang_n"])
    sources = sources.withColumn("pos", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
    sources = sources.withColumn("blocks", F.ceil(F.count(F.lit(1)).over(Window.partitionBy("lang")) / tile_sources))
    sources = sources.withColumn("tiles", F.greatest(F.lit(1), F.ceil(F.col("terms") / tile_terms)))
    sources = written(sources.withColumn("without", _p("0L", "source_n", "terms")), "divergence-sources")
    side = F.broadcast(sources) if small(sources, BROADCAST_ROWS) else sources
    found = counts.where("source is not null").join(side, ["lang", "source"]).withColumn("p", _p("n", "source_n", "terms"))

    best = found.withColumn("q", _p("total", "lang_n", "terms")).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))
    by_rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = best.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= top)

    own = F.floor(F.col("pos") / tile_sources)
    spread = F.explode(F.expr("sequence(0L, blocks - 1)"))
    tile = F.pmod(F.xxhash64("term"), F.col("tiles"))
    rows = found.select("lang", tile.alias("tile"), "term", "pos", "p", spread.alias("other"))
    bare = sources.withColumn("tile", F.explode(F.expr("sequence(0L, tiles - 1)"))).select("lang", "tile", F.lit(None).cast("string").alias("term"), "pos", F.col("without").alias("p"), spread.alias("other"))
    dealt = rows.unionByName(bare).select("lang", "tile", "term", "pos", "p", F.least(own, "other").alias("first"), F.greatest(own, "other").alias("second"))
    sums = dealt.groupBy("lang", "tile", "first", "second").applyInPandas(_compared(tile_sources), "lang string, a long, b long, value long, zero long, seen long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.max("zero").alias("zero"))
    names = side.select("lang", "source", "pos", "terms")
    pairs = sums.join(names.withColumnRenamed("pos", "a"), ["lang", "a"]).join(names.select("lang", F.col("source").alias("item"), F.col("pos").alias("b")), ["lang", "b"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") + (F.col("terms") - F.col("seen")) * F.col("zero")).alias("value"))
    return pairs.withColumn("rank", F.row_number().over(by_rank)).unionByName(best).withColumn("rank", F.col("rank").cast("int"))
