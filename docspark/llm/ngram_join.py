"""Exact Jaccard join of documents' word n-gram sets in a metric space of pivots.

Distance is 1 - |A & B| / |A | B|, a metric. The join runs in three levels:

1. *Pivots and regions.* The shingles' universe is split by hash into g classes, and a document's set restricted
   to a class is a point of that class's own Jaccard space. Each distinct restricted set is a pivot; its region
   holds the documents at distance 0 from it. A set within the threshold of one of n shingles differs from it in at most
   d = n * (1 - t) / t of them, so of its c classes that are not empty the two share the regions of c - d at least: a
   document needs its d + 1 rarest regions only, which leaves out those of passages that many documents hold, and a
   document that shares fewer than c - d regions with anyone is linked to none. No link is lost. (Where c <= d, regions
   of empty classes count too, and all are kept.) g depends on the sets' size, so sizes are cut into bands; a document
   whose partners may fall into the band below is replicated there.
2. *Voronoi cells inside regions.* Regions with the same pivot document (the member that shares most regions) are one
   group. A group of more than LARGE members is divided: up to CELLS of its members, far apart, become pivots, every member goes to the
   cell of its nearest pivot, and by the triangle inequality also to each cell whose pivot is at most two thresholds'
   distance farther (its window), where it meets the members of that cell. A pair counts in the cell of the member with
   the larger name. Cells are divided again while they are large and windows don't fill them.
3. *Comparison.* What is left is compared exactly, in blocks of BLOCK members against each other. A pair counts at the
   smallest pivot document that both have. Blocks give each member's number of links, and its tie to the smallest
   member that it reaches there; ties are joined into components at the end, once.

Equal sets are one point throughout, so a large group of copies costs one row per copy and no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from docspark.llm.hashing import mix, shingles, word_hashes
from docspark.plans.components import components
from docspark.plans.storage import cut, small, written

#: Sizes of a band reach from L to below GROW * L.
GROW = 1.5
#: Classes for each shingle in which two sets of a band may differ.
SPLIT = 1.5
#: Members of a block in which links are counted, and shingles that are compared at once.
BLOCK, COLUMNS = 256, 4096
#: Groups of more members are divided around at most so many members, at most so many times.
LARGE, CELLS, LEVELS = 2048, 64, 6
#: Ids of candidates are broadcast up to this many (some 10 MB); beyond, they are joined by a shuffle.
BROADCAST_IDS = 250_000


def _bands(num: int, den: int) -> list[tuple[int, int, int]]:
    """(L, U, g) of every band: sizes L..U-1, cut into g classes. Smaller sets can only equal each other."""
    low = -(-num // (den - num)) if den > num else 1 << 62
    out = []
    while low < 1 << 40:
        high = max(low + 1, int(low * GROW))
        out.append((low, high, int(SPLIT * ((den - num) * (high - 1) // num)) + 1))
        low = high
    return out


def _signatures(values: np.ndarray, num: int, den: int, bands: list[tuple[int, int, int]]) -> list[tuple[int, int, np.ndarray]]:
    """(band, spare, names of regions) of one document: for its own band, and for the band below if a partner may be there.

    A partner shares more than ``spare`` of the regions named.
    """
    n, out = len(values), []
    mixed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)))])
    high = (values >> np.uint64(32)).astype(np.uint64)
    for i, (low, top, g) in enumerate(bands):
        if low > n:
            break
        if n < top or num * n <= den * (top - 1):  # its own, or a smaller partner may have up to top - 1
            first = np.searchsorted((high * np.uint64(g)) >> np.uint64(32), np.arange(g + 1, dtype=np.uint64))
            names = mix((mixed[first[1:]] - mixed[first[:-1]]) ^ mix(np.arange(g, dtype=np.uint64) + np.uint64((i + 1) << 40)))
            full = first[1:] > first[:-1]
            spare = int(full.sum()) - (den - num) * min(n, top - 1) // num - 1
            out.append((i, spare, names[full]) if spare >= 0 else (i, 0, names))
    return out


def _name(values: np.ndarray) -> int:
    """64 bits that stand for a whole set."""
    total = values.sum(dtype=np.uint64, keepdims=True) + mix(values).sum(dtype=np.uint64, keepdims=True) * np.array([3], np.uint64)
    return int(mix(total + np.array([len(values)], np.uint64))[0])


def _texts(batch: pa.RecordBatch) -> list[str | None]:
    return batch.column("text").to_pylist()


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingles(words, k)) for words in word_hashes(_texts(batch))]
            n, node = pa.array([len(v) for v in sets], pa.int64()), np.array([_name(v) for v in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, pa.array(node)], names=["doc_id", "n_shingles", "node"])

    return run


def _regions(k: int, num: int, den: int):
    bands = _bands(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a set's regions are named once a task; the task's rows bound this
        for batch in batches:
            for words in word_hashes(_texts(batch)):
                values = np.unique(shingles(words, k))
                node = _name(values)
                for band, spare, names in () if node in seen else _signatures(values, num, den, bands):
                    row = [np.full(len(names), x) for x in (np.array(node, np.uint64).view(np.int64), band, spare)]
                    yield pa.RecordBatch.from_arrays([pa.array(row[0]), pa.array(names.view(np.int64)), pa.array(row[1].astype(np.int32)), pa.array(row[2].astype(np.int32))], names=["node", "region", "band", "spare"])
                seen.add(node)

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingles(w, k)) for w in word_hashes(_texts(batch))]
            keys = [_name(v) for v in sets]
            at = np.concatenate([[0], np.cumsum([len(v) for v in sets])]) if sets else [0]
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))], names=["node", "items"])

    return run


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """|a & b| of every two of ``sets``, which have no repeated values."""
    m = len(sets)
    out = np.zeros((m, m), np.float32)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, bool)
    column = np.cumsum(first) - 1
    often = np.bincount(column)[column] > 1 if len(flat) else first
    column, owner = np.cumsum(first & often)[often] - 1, owner[often]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        dense = np.zeros((m, min(COLUMNS, int(column[-1]) + 1 - low)), np.float32)
        dense[owner[a:b], column[a:b] - low] = 1
        out += dense @ dense.T
    return out.astype(np.int64)


def _reached(linked: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The smallest name that each member reaches by ``linked``."""
    label = node
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], np.iinfo(np.int64).max).min(1))
        if (least == label).all():
            return label
        label = least


def _counted(num: int, den: int):
    """Of the members of each block pair (cell, i, j), whose rows follow one another: (node, links, label)."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        i, j, top = rows[0][1:4]
        node, block, inner = np.array([r[4] for r in rows], np.int64), np.array([r[5] for r in rows]), np.array([r[6] for r in rows], bool)
        sets = [r[7] for r in rows]
        n, both = np.array([len(x) for x in sets]), _overlaps(sets)
        linked = den * both >= num * (n[:, None] + n[None, :] - both)
        linked &= _overlaps([x[x < top] for x in (r[8] for r in rows)]) == 0
        linked &= np.where(node[:, None] > node[None, :], inner[:, None], inner[None, :])
        np.fill_diagonal(linked, False)
        if i != j:
            linked &= block[:, None] != block[None, :]
        found, label = linked.sum(1), _reached(linked, node)
        some = found > 0
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(found[some].astype(np.int64)), pa.array(label[some])], names=["node", "links", "label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            plain = [batch.column(c).to_pylist() for c in ("cell", "i", "j", "top", "node", "block", "inner")]
            lists = []
            for c in ("items", "pivots"):
                column = batch.column(c)
                at, flat = column.offsets.to_numpy(), column.values.to_numpy()
                lists.append([flat[a:b] for a, b in zip(at[:-1], at[1:])])
            for row in zip(*plain, *lists):
                if held and held[0][:3] != row[:3]:
                    if len(held) > 1:
                        yield batch_of(held)
                    held = []
                held.append(row)
        if len(held) > 1:
            yield batch_of(held)

    return run


def _away() -> Column:
    """Distance of the sets ``items`` and ``theirs``."""
    both = F.size(F.array_intersect("items", "theirs"))
    return 1 - both / (F.size("items") + F.size("theirs") - both)


def _divided(member: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """``member`` (cell, top, node, inner) with its large cells divided into Voronoi cells around some of their members."""
    done = None
    for level in range(LEVELS):
        size = member.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > LARGE)
        large = written(size, "ngram-large")
        if not large.limit(1).count():
            break
        rest = member.join(large, "cell", "left_anti")
        done = rest if done is None else done.unionByName(rest)
        inside = member.join(large, "cell")
        first = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("node", F.lit(level)), "node"))
        chosen = inside.select("cell", "node").distinct().withColumn("nth", first).where(F.col("nth") <= CELLS).join(sets, "node")
        chosen = written(chosen.select("cell", "nth", F.col("node").alias("pivot"), F.col("items").alias("theirs")), "ngram-candidates")
        # a candidate close to an earlier one would only repeat that one's cell
        before = chosen.select("cell", F.col("nth").alias("other"), F.col("theirs").alias("items"))
        close = chosen.join(before, "cell").where("other < nth").where(_away() <= 2 * (den - num) / den).select("cell", "pivot").distinct()
        chosen = written(chosen.join(close, ["cell", "pivot"], "left_anti").drop("nth"), "ngram-pivots")
        met = inside.join(sets, "node").join(chosen, "cell")
        met = written(met.select("cell", "size", "top", "node", "inner", "pivot", _away().alias("away")), "ngram-away")
        nearest = F.min(F.struct("away", "pivot")).over(Window.partitionBy("cell", "top", "node", "inner"))
        near = met.withColumn("home", nearest).where(F.col("away") <= F.col("home.away") + 2 * (den - num) / den + 1e-9)
        near = written(near.select("cell", "size", "top", "node", (F.col("inner") & (F.col("pivot") == F.col("home.pivot"))).alias("inner"), F.xxhash64("cell", "pivot").alias("part")), "ngram-cells")
        # windows that fill the cells make work instead of saving it: such a cell stays whole
        work = near.groupBy("cell", "part").agg(F.max("size").alias("size"), F.count(F.lit(1)).cast("double").alias("n")).groupBy("cell").agg(F.max("size").alias("size"), F.sum(F.col("n") * F.col("n")).alias("after"))
        better = written(work.where(F.col("after") * 2 < F.col("size").cast("double") * F.col("size")).select("cell"), "ngram-better")
        done = done.unionByName(inside.drop("size").join(better, "cell", "left_anti"))
        member = near.join(better, "cell", "left_semi").select(F.col("part").alias("cell"), "top", "node", "inner")
    return member if done is None else done.unionByName(member)


def _links(member: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(node, links, label) of the blocks of ``member`` (top, node): how many others each is linked with there, and the
    smallest that it reaches. Only sums and ties leave a block."""
    known = sets.join(member.groupBy("node").agg(F.collect_list("top").alias("pivots")), "node")
    cells = _divided(member.select(F.col("top").alias("cell"), "top", "node", F.lit(True).alias("inner")), sets, num, den)
    blocks = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = cells.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("cell", "top", "node", "inner", "block", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    rows = dealt.join(known, "node").select("cell", "i", "j", "top", "node", "block", "inner", "items", "pivots")
    rows = rows.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return rows.mapInArrow(_counted(num, den), "node long, links long, label long")


def _members(wanted: DataFrame, docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, items): the whole sets of the nodes in ``wanted``, from the texts that stand for them."""
    ids = cut(nodes.join(wanted, "node", "left_semi").select(F.col("rep").alias("doc_id")).where("doc_id is not null").distinct())
    side = F.broadcast(ids) if small(ids, BROADCAST_IDS) else ids
    sets = written(docs.join(side, "doc_id", "left_semi").mapInArrow(_sets(k), "node long, items array<long>"), "ngram-sets")
    return sets if sets.count() == ids.count() else written(sets.dropDuplicates(["node"]), "ngram-sets-once")  # ids that repeat


def ngram_jaccard_join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Documents linked by Jaccard similarity >= num / den of their sets of ``k``-word shingles, exactly.

    ``docs`` has doc_id (long) and text; other columns are ignored. Returns one row per row of ``docs``: doc_id,
    n_shingles (set size), component_id (smallest doc_id reachable by links, itself included), links (the number
    of other documents' sets that differ from its own and are within the threshold; equal sets count once).

    Null and empty texts, and texts of white space, have an empty set and link with nothing. Repeated rows and
    equal texts share a component. A row with a null doc_id links through equal sets only and never names a
    component. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = written(docs.mapInArrow(_sketches(k), "doc_id long, n_shingles long, node long"), "ngram-sketch")
    nodes = written(sketch.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "ngram-nodes")

    # Regions are named from the texts once more: stored, they would take as much disk as the input.
    cells = docs.select("text").mapInArrow(_regions(k, num, den), "node long, region long, band int, spare int")
    region = Window.partitionBy("region")
    shared = cells.withColumns({"low": F.min("node").over(region), "high": F.max("node").over(region), "n": F.count(F.lit(1)).over(region)})
    shared = written(shared.where("low <> high").select("node", "region", "band", "spare", "n").distinct(), "ngram-shared")
    rarest = F.row_number().over(Window.partitionBy("node", "band").orderBy(F.desc("n"), F.desc("region"))) > F.col("spare")
    shared = written(shared.withColumn("kept", rarest).where("kept").select("node", "region"), "ngram-regions")
    # A region's pivot document is its member that shares most regions: around an original, the same one for all its copies.
    weight = shared.groupBy("node").agg(F.count(F.lit(1)).alias("weight"))
    heaviest = F.max(F.struct("weight", "node")).over(region)["node"]
    met = shared.join(weight, "node").select("node", heaviest.alias("top")).distinct()
    alone = F.count(F.lit(1)).over(Window.partitionBy("top"))
    member = written(met.withColumn("size", alone).where("size > 1").select("top", "node"), "ngram-members")
    sets = _members(member.select("node").distinct(), docs, nodes, k)

    found = written(_links(member, sets, num, den), "ngram-links")
    tied = written(components(found.select("node", "label").where("node <> label"), "node", "label"), "ngram-tied")
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    # Only sets with copies or links can have another name than their own document's.
    named = nodes.join(tied, "node", "left").where("copies > 1 or component is not null").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = written(named.join(least, "component").join(degree, "node", "left").select("node", "component_id", "links"), "ngram-named")
    out = sketch.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node")).join(named, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
