"""Source divergence against plain counting, with odd rows, several blocks of sources and tiles of terms, and split shards."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.llm import divergence
from docspark.llm.divergence import Runs, pointer_sort, source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, top=200):
    count, docs, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for text, lang, source in ((a or "", b or "", c or "") for a, b, c in rows):
        groups.add((lang, source))
        found = TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        count[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        own = sorted(s for g, s in groups if g == lang)
        kept = [t for t, n in docs[lang].items() if n >= 3]
        p = lambda counts: {t: 1 + 1_000_000_000 * (counts[t] + 1) // (sum(counts[x] for x in kept) + len(kept)) for t in kept}
        whole = sum((count[lang, s] for s in own), collections.Counter())
        each, q = {s: p(count[lang, s]) for s in own}, p(whole)
        for s in own:
            pairs = [(-sum((each[s][t] - each[o][t]) ** 2 // each[o][t] for t in kept), o.encode()) for o in own if o != s]
            terms = [(-((each[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if count[lang, s][t] and each[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item.decode(), -value, i) for i, (value, item) in enumerate(items, 1)}
    return out


def rows_of(seed, sources=7, words=60, n=150):
    dice = random.Random(seed)
    vocabulary = ["".join(dice.choice("abcdeéßñ漢") for _ in range(dice.choice([1, 2, 3, 8, 9, 16, 17, 30]))) for _ in range(words)]
    rows = []
    for _ in range(n):
        text = "".join(w.upper() + dice.choice([" ", ".", "7", "\n", "_"]) if dice.random() < 0.2 else w + " " for w in dice.choices(vocabulary, k=dice.randint(0, 40)))
        rows.append((text, dice.choice(["en", "fr", "", None]), f"s{min(dice.randint(0, sources), dice.randint(0, sources))}"))
    return [*rows, (None, None, None), ("", "xx", "a"), ("ab", "xx", "b"), ("A" * 5000 + " b", "en", "s1"), ("12 34", "yy", None), rows[0], rows[0]]


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string").withColumn("term", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("shard", F.lit("x"))


def got(df, **more):
    return {tuple(r) for r in source_divergence(df, **more).select("lang", "source", "part", "item", "value", "rank").collect()}


def test_matches_plain_counting(spark):
    rows = rows_of(1)
    assert got(frame(spark, rows).repartition(3)) == plain(rows)


def test_blocks_tiles_and_flushed_shards_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BROADCAST_ROWS", 0)
    rows = rows_of(2)
    assert got(frame(spark, rows).repartition(2), top=5, block=300, held=50, tile_terms=8, tile_sources=3) == plain(rows, top=5)


def test_pointer_sort_orders_bytes_and_keeps_equal_ones_in_order(monkeypatch):
    dice = random.Random(3)
    words = [bytes(dice.choice(b"ab\xff") for _ in range(dice.choice([1, 7, 8, 9, 16, 40]))) for _ in range(3000)]
    size = np.array([len(w) for w in words])
    for small in (1 << 15, 2):
        monkeypatch.setattr(divergence, "SMALL", small)
        order, new = pointer_sort(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size)
        assert order.tolist() == sorted(range(len(words)), key=lambda i: words[i])
        assert [i for i in range(len(order)) if i == 0 or words[order[i]] != words[order[i - 1]]] == np.flatnonzero(new).tolist()
    assert len(pointer_sort(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))[0]) == 0


def test_equal_words_meet_in_one_shard():
    word = np.frombuffer(b"alphabetical", np.uint8)
    runs = Runs(np.concatenate([word, np.frombuffer(b"b", np.uint8), word]), np.array([12, 1, 12]), np.ones(3, int), np.zeros(3, int), np.ones(3, int), np.ones(3, int))
    shard = runs.shards(1000)
    assert shard[0] == shard[2] != shard[1]


def test_no_rows(spark):
    assert got(frame(spark, rows_of(1)).limit(0)) == set()


@pytest.mark.parametrize("texts", [["only digits 1"], [None, ""]])
def test_languages_without_terms(spark, texts):
    rows = [(t, "en", s) for t in texts for s in "abc"][:3]
    assert got(frame(spark, rows)) == plain(rows)
