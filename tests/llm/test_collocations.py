"""Collocations against plain counting, in one shard and in many, with dense and sparse tiles."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.llm import collocations as module
from docspark.llm.collocations import BOUNDS, _tiles, collocations


def plain(rows, least, longest=5, top=2000):
    f, words = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for size in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, counts in f.items():
        found = []
        often = {p: a for p, a in counts.items() if a >= least}
        inside = collections.defaultdict(int)
        for p, a in often.items():
            for i in range(len(p)):
                for j in range(i + 1, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(inside[p[i:j]], a)
        for p, a in often.items():
            if len(p) > 1 and inside[p] < a:
                score, k = min((1000 * a * words[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, words[lang], -score) for i, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def rows_of(seed, n=120):
    dice = random.Random(seed)
    words = ["a", "b", "The", "of", "é", "漢字", "x1", "(y)", "-"] + [f"w{i}" for i in range(30)]
    rows = []
    for _ in range(n):
        text = "".join(w + dice.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", " ; ", ""]) for w in dice.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=dice.randint(0, 60)))
        rows.append((text, dice.choice(["en", "en", "de", None])))
    return [*rows, (None, "en"), ("", "fr"), ("a a a a a a a a", "rr"), ("lone", "zz"), ("word " * 3000, "en"), rows[0], rows[0]]


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string").withColumn("n", F.lit("clash")).withColumn("words", F.lit(1)).withColumn("phrase", F.lit("x"))


def got(df, **more):
    return sorted(tuple(r) for r in collocations(df, **more).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("least", [2, 4])
def test_matches_plain_counting(spark, least):
    rows = rows_of(1)
    assert got(frame(spark, rows).repartition(2), least=least) == plain(rows, least)


def test_shards_sparse_tiles_and_joins_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    rows = rows_of(2, 60)
    assert got(frame(spark, rows).repartition(2), least=2, longest=4, top=15, shard=100, held=20, cells=0) == plain(rows, 2, 4, 15)


def test_tiles_hold_every_pair_once():
    dice = np.random.default_rng(4)
    for most in (40, 3000, 2_000_000):
        x = dice.integers(0, most, 5000)
        pairs = collections.Counter((int(a), int(b)) for a, b in zip(x, x[1:]) if a and b)
        seen = collections.Counter()
        for first, second, cells, n in _tiles(x):
            assert (np.diff(cells) > 0).all()
            a, b = np.divmod(cells, BOUNDS[second + 1] - BOUNDS[second])
            for i, j, m in zip((a + BOUNDS[first] + 1).tolist(), (b + BOUNDS[second] + 1).tolist(), n.tolist()):
                seen[i, j] += m
        assert seen == pairs


def test_nothing_frequent_and_no_rows(spark):
    assert got(frame(spark, [("a b c", "en")])) == []
    assert got(frame(spark, [("a b c", "en")]).limit(0)) == []
