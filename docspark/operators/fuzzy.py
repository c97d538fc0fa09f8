"""Where built-in functions don't reach: likeness of titles, and keys folded to ASCII."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.plans.storage import written


#: Scores are rounded to six places before they are held against a threshold.
SLACK = 1e-6
#: Titles up to this many letters get the bound below from one machine word.
_WORD = 64
#: Titles of a block, where many share a run of letters.
BLOCK = 256


def _common(xs: pd.Series, ys: pd.Series) -> np.ndarray:
    """No less than the letters that the titles of each pair have in common in order: the longest common subsequence, for
    all pairs at once, a bit for each letter of x. Letters that share a code count as equal, which only raises it. Longer
    titles get the length of the shorter one."""
    (ix, ux), (iy, uy) = pd.factorize(xs), pd.factorize(ys)
    length = lambda titles: np.array([len(t) for t in titles], np.int64)
    nx, ny = length(ux), length(uy)
    bits = np.zeros((len(ux), 129), np.uint64)  # where each code stands in x; code 128 stands nowhere
    for i, t in enumerate(ux):
        for j, c in enumerate(t[:_WORD]):
            bits[i, ord(c) & 127] |= np.uint64(1 << j)
    codes = np.full((len(uy), _WORD), 128, np.int64)
    for i, t in enumerate(uy):
        codes[i, : min(len(t), _WORD)] = [ord(c) & 127 for c in t[:_WORD]]
    free = np.full(len(xs), ~np.uint64(0))
    for j in range(int(min(_WORD, ny.max(initial=0)))):
        met = free & bits[ix, codes[iy, j]]
        free = (free + met) | (free - met)
    short = (nx[ix] <= _WORD) & (ny[iy] <= _WORD)
    return np.where(short, 64 - np.bitwise_count(free).astype(np.int64), np.minimum(nx[ix], ny[iy]))


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    out, match = np.zeros(len(a)), SequenceMatcher(None)
    possible = np.flatnonzero(2 * _common(a, b) >= (least - SLACK) * (a.str.len() + b.str.len()))
    x, y = a.to_numpy(), b.to_numpy()
    for i in possible[np.argsort(y[possible], kind="stable")]:  # the matcher keeps what it knows of its second title
        if match.b is not y[i]:
            match.set_seq2(y[i])
        match.set_seq1(x[i])
        out[i] = match.ratio()
    return pd.Series(out)


def _rarest(titles: DataFrame, width: int, keep: Column) -> DataFrame:
    """Runs of ``width`` letters of each title, numbered where one repeats: its ``keep`` rarest among all titles."""
    starts = F.sequence(F.lit(1), F.greatest(F.col("n") - (width - 1), F.lit(1)))
    runs = titles.withColumn("run", F.explode(F.transform(starts, lambda i: F.substring(F.col("title"), i, F.lit(width)))))
    runs = runs.groupBy("topic", "n", "apart", "run").agg(F.count(F.lit(1)).alias("times")).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    runs = runs.join(runs.groupBy("run", "nth").agg(F.count(F.lit(1)).alias("titles")), ["run", "nth"])
    rank = F.row_number().over(Window.partitionBy("topic").orderBy("titles", "run", "nth"))
    return runs.withColumn("rank", rank).where(F.col("rank") <= keep).select("topic", "n", "apart", "run", "nth", "titles")


def title_pairs(titles: DataFrame, least: float, apart: str | None = None) -> DataFrame:
    """Pairs (a < b) of topics whose titles are alike by ``least`` or more. ``titles`` has distinct (topic, title). With
    ``apart``, a column's name, pairs that hold the same value there are left out.

    Of s letters of both titles together m >= s * least / 2 must match on each side. The other s - 2 m cut the matched ones
    into at most s - 2 m + 1 runs, so 3 m - 1 - s or more bigrams are shared; where that is less than one, as in short titles
    or for a low ``least``, m letters are. Titles that share t of their n runs share one of each one's n - t + 1 rarest, so
    only these meet in the join, which holds numbers and lengths; titles come to the pairs that the lengths leave, and
    likeness is computed where a common subsequence is long enough.
    """
    r = least - SLACK
    spread = 1.5 * r - 1
    shared = lambda s: 3 * math.ceil(r * s / 2) - 1 - s
    # from ``long`` letters of both on, a bigram is shared; beyond 2 / spread that is so for all
    long = None if spread <= 0 else 1 + max((s for s in range(math.ceil(2 / spread) + 1) if shared(s) < 1), default=-1)
    # by their bytes, which say nothing of the work, adaptive execution would join these tasks
    tasks = int(titles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = titles.select("topic", "title", F.length("title").alias("n"), (F.col(apart) if apart else F.lit(None).cast("int")).alias("apart"))
    fewest = 2 * F.col("n") / (2 - r)  # letters of a pair of this title and the shortest partner
    letters = _rarest(slim if long is None else slim.where(fewest < long), 1, F.col("n") - F.ceil(r * F.col("n") / (2 - r)) + 1)

    def met(runs: DataFrame) -> DataFrame:
        # runs that many titles hold are met in blocks: each title as a in one of them, as b in all
        blocks = F.ceil(F.col("titles") / BLOCK).cast("int")
        one = runs.select(F.col("topic").alias("a"), F.col("n").alias("n_a"), F.col("apart").alias("apart_a"), "run", "nth", F.pmod(F.hash("topic"), blocks).alias("block"))
        all_ = runs.select(F.col("topic").alias("b"), F.col("n").alias("n_b"), F.col("apart").alias("apart_b"), "run", "nth", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
        key = ["run", "nth", "block"]
        pairs = one.repartition(tasks, *key).join(all_.repartition(tasks, *key), key)
        pairs = pairs.where((F.col("a") < F.col("b")) & (2 * F.least("n_a", "n_b") >= r * (F.col("n_a") + F.col("n_b"))))
        return pairs.where(~F.col("apart_a").eqNullSafe(F.col("apart_b"))) if apart else pairs

    total = F.col("n_a") + F.col("n_b")
    pairs = met(letters)
    if long is not None:
        enough = F.greatest(F.lit(1), F.ceil(spread * F.greatest(fewest, F.lit(long)) - 1 - SLACK))
        bigrams = _rarest(slim.where(2 * F.col("n") / r >= long), 2, F.col("n") - enough)
        pairs = pairs.where(total < long).select("a", "b").unionByName(met(bigrams).where(total >= long).select("a", "b"))
    pairs = pairs.select("a", "b").distinct()
    side = lambda s: slim.select(F.col("topic").alias(s), F.col("title").alias(f"title_{s}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").repartition(tasks, "a", "b")
    return pairs.withColumn("score", F.round(_ratio("title_a", "title_b", F.lit(least)), 6)).where(F.col("score") >= least).select("a", "b", "score")


def matched(pairs: DataFrame) -> DataFrame:
    """Of ``pairs`` (a, b, score) a matching: the best first (score, then a, then b), each topic once. In every round the
    pairs that are best for both their ends are taken, which gives what going through the sorted list would give."""
    left, taken = written(pairs, "match-pairs"), None
    while True:
        order = F.struct("score", -F.col("a"), -F.col("b"))
        ends = left.select(F.explode(F.array("a", "b")).alias("topic"), "a", "b", order.alias("o")).groupBy("topic").agg(F.max(F.struct("o", "a", "b")).alias("best"))
        best = ends.select("best.a", "best.b", F.col("best.o.score").alias("score")).groupBy("a", "b", "score").agg(F.count(F.lit(1)).alias("n"))
        new = written(best.where("n = 2").select("a", "b", "score"), "match-new")
        if not new.limit(1).count():
            return left.limit(0) if taken is None else taken
        taken = new if taken is None else taken.unionByName(new)
        used = new.select(F.explode(F.array("a", "b")).alias("topic"))
        left = left.join(used.toDF("a"), "a", "left_anti").join(used.toDF("b"), "b", "left_anti")
        left = written(left.select("a", "b", "score"), "match-pairs")


@F.pandas_udf(T.StringType())
def _folded(x: pd.Series) -> pd.Series:
    import unicodedata

    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower())


def normalized_keys(values: DataFrame) -> DataFrame:
    """(value, key) of each distinct value: decomposed, ASCII only, lower case, other runs as ``_``, at most 512."""
    key = F.left(F.regexp_replace(F.regexp_replace(_folded("value"), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit(512))
    return values.select("value").distinct().select("value", F.when(F.coalesce(key, F.lit("")) == "", "unknown").otherwise(key).alias("key"))
