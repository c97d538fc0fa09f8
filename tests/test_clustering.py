"""Clusters of topics within classes against a loop over all pairs; rounds on chains and crowds; running sums."""

import random

import pytest
from pyspark.sql import functions as F

from docspark.operators import clustering
from docspark.operators.clustering import INSIDE, OTHERWISE, THRESHOLDS, leading, title_pairs, topic_clusters
from docspark.plans.prefix import running_sums


def like(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def score(x, y):
    a, b = x["words"], y["words"]
    by_title = 0.0
    if a and b:
        s, t = " ".join(sorted(a)), " ".join(sorted(b))
        by_title = min(1.0, like(a, b) + (INSIDE if s in t or t in s else 0.0))
    return max(by_title, like(x["signature"], y["signature"]))


def plain(rows):
    led, out = {}, {}
    for topic, kind, words, signature in sorted(rows):
        x = {"words": set(words), "signature": set(signature)}
        choice = max(((s, -i) for i, y in led.get(kind, {}).items() if (s := score(x, y)) >= THRESHOLDS.get(kind, OTHERWISE)), default=None)
        if choice is None:
            led.setdefault(kind, {})[topic] = x
            out[topic] = (topic, 1.0)
        else:
            out[topic] = (-choice[1], choice[0])
    return out


SCHEMA = "topic long, topic_class string, words array<string>, signature array<string>"


def clustered(spark, rows):
    found = topic_clusters(spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit("clash")).withColumn("least", F.lit(1))).collect()
    assert len(found) == len(rows)
    return {r.topic: (r.leader, r.score) for r in found}


def rows_of(seed, n):
    dice = random.Random(seed)
    words = ["roma", "via", "viale", "scala", "tetto", "acqua", "rom", "ascensore", "a1", "zeta", "portone"]
    rows = []
    for i in range(n):
        kind = dice.choice([*THRESHOLDS, "unheard"])
        signature = [kind[:3], *dice.sample(["roma", "scala", "tetto", "x", "y"], dice.randint(0, 2)), *dice.sample(["invoice", "tax"], dice.randint(0, 1))]
        rows.append((i * 3 % (3 * n + 1), kind, dice.choices(words, weights=[1 / (j + 1) for j in range(len(words))], k=dice.randint(0, 5)), signature))
    return rows


@pytest.mark.parametrize("block", [200_000, 12])
def test_matches_the_loop(spark, monkeypatch, block):
    monkeypatch.setattr(clustering, "BLOCK", block)
    rows = rows_of(1, 260)
    assert clustered(spark, rows) == plain(rows)


def test_repeated_topics_and_odd_rows(spark):
    rows = [(i, "meeting", ["roma", "via"], ["meeting", "roma"]) for i in range(40)] + [(100, "other", [], []), (101, "other", [], []), (102, "", ["x"], [""]), (103, "other", ["x", "x"], ["a", "a"])]
    want = plain(rows)
    assert clustered(spark, rows) == want and want[39] == (0, 1.0) and want[101] == (101, 1.0)
    assert topic_clusters(spark.createDataFrame([], SCHEMA)).count() == 0


def test_title_pairs_are_exact(spark):
    dice = random.Random(7)
    letters = ["ab", "abc", "b", "c", "cd", "d", "de", "e", "f", "g"]
    sets = {tuple(sorted(set(dice.choices(letters, k=dice.randint(1, 7))))) for _ in range(150)}
    rows = [(i, dice.choice(["financial_period", "other"]), list(s)) for i, s in enumerate(sorted(sets))]
    got = {(r.a, r.b): r.score for r in title_pairs(spark.createDataFrame(rows, "id long, class string, words array<string>")).collect()}
    want = {}
    for a, kind, x in rows:
        for b, other, y in rows:
            if a < b and kind == other and (s := score({"words": set(x), "signature": set()}, {"words": set(y), "signature": set()})) >= THRESHOLDS[kind]:
                want[a, b] = s
    assert got == want and any(v - INSIDE < THRESHOLDS["financial_period"] for v in want.values())


def test_rounds_do_not_grow_with_chains_or_crowds(spark):
    """A chain of 1,000 titles, each like the next one only, and 1,000 topics at one hub."""
    ask = lambda node, hub: (node, hub, 1.0, 0.0, 0.0, 0.5)
    says = [(i, f"c{i}", 0.0) for i in range(1000)] + [(5000 + i, "crowd", 0.0) for i in range(1000)]
    asks = [ask(i, f"c{j}") for i in range(1000) for j in (i - 1, i, i + 1) if 0 <= j < 1000] + [ask(5000 + i, "crowd") for i in range(1000)]
    frame = lambda s, a: (spark.createDataFrame(s, "node long, hub string, size double"), spark.createDataFrame(a, "node long, hub string, fixed double, shared double, own double, least double"))
    led, rounds = leading(*frame(says, asks))
    assert rounds == 1
    assert {r.node for r in led.collect()} == {*range(0, 1000, 2), 5000}


def test_running_sums(spark):
    dice = random.Random(9)
    rows = [(dice.choice("aaaab"), i, dice.randint(0, 9)) for i in range(500)]
    got = {r.i: r.before for r in running_sums(spark.createDataFrame(rows, "k string, i long, n long").repartition(3), "k", "i", "n").collect()}
    assert got == {i: sum(n for x, j, n in rows if x == k and j < i) for k, i, _ in rows}
