"""Topics of a class clustered around their oldest ones, by signatures and titles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.operators.fuzzy import title_pairs as title_ratios
from docspark.plans.components import components
from docspark.plans.prefix import running_sums
from docspark.plans.storage import cut, written

#: How alike topics of a class must be, and what a title inside the other one adds.
THRESHOLDS = {"vendor_relationship": 0.42, "financial_period": 0.34, "general_administration": 0.38, "legal_matter": 0.48, "case_file": 0.48, "building_issue": 0.45, "meeting": 0.4, "other": 0.72}
OTHERWISE, INSIDE = 0.7, 0.15
#: Ties of topics and hubs that one task decides on at once.
BLOCK = 200_000
_SLACK = 1e-9


def threshold(topic_class: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in THRESHOLDS.items() for x in pair))[topic_class], F.lit(OTHERWISE))


def title_pairs(sets: DataFrame) -> DataFrame:
    """(a, b, score), each pair once with a < b: sets of words of one class whose score reaches the threshold.

    ``sets`` has id, class, words (sorted, distinct, not empty; no two of a class equal). The score is Jaccard's, plus INSIDE if
    one set's words, joined, lie inside the other's. Two prefix filters find candidates: by Jaccard, where both sets show
    their rarest words; and, for sets inside another, by an index of all words that the inner set asks for
    its rarest ones. Of k words of an inner set all but the first and the last are whole words of the outer
    one, so three rare words do for long titles.
    """
    sets = sets.withColumn("least", threshold(F.col("class")))
    words = sets.select("id", "class", "least", F.size("words").alias("k"), F.explode("words").alias("word"))
    often = words.groupBy("class", "word").agg(F.count(F.lit(1)).alias("often"))
    ranked = words.join(often, ["class", "word"]).groupBy("id", "class", "least", "k").agg(F.array_sort(F.collect_list(F.struct("often", "word"))).alias("words"))
    k, least = F.col("k"), F.col("least")
    rare = lambda n: F.explode(F.transform(F.slice("words", 1, n.cast("int")), lambda w: w["word"])).alias("word")
    jaccard = k - F.ceil(least * k - _SLACK) + 1
    shared = F.greatest(F.lit(1), k - 2, F.ceil((least - INSIDE) * k - _SLACK))
    ranked = written(ranked, "title-words")
    shown = ranked.select("id", "class", "least", "k", rare(jaccard))
    asked = ranked.select("id", "class", "least", "k", rare(k - shared + 1))
    every = ranked.select("id", "class", "k", F.explode(F.transform("words", lambda w: w["word"])).alias("word"))
    other = lambda df: df.select("class", "word", F.col("id").alias("other"), F.col("k").alias("m"))
    like = shown.join(other(shown), ["class", "word"]).where("id < other and least(k, m) >= least * greatest(k, m) - 1e-9")
    inside = asked.join(other(every), ["class", "word"]).where(f"id <> other and k >= (least - {INSIDE}) * m - 1e-9")
    ends = lambda df: df.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    found = ends(like).unionByName(ends(inside)).distinct()
    side = lambda s: sets.select(F.col("id").alias(s), F.col("words").alias(f"words_{s}"), F.array_join("words", " ").alias(f"text_{s}"), F.col("least").alias(f"least_{s}"))
    found = found.join(side("a"), "a").join(side("b").drop("least_b"), "b")
    both = F.size(F.array_intersect("words_a", "words_b")).cast("double")
    bonus = F.when(F.col("text_a").contains(F.col("text_b")) | F.col("text_b").contains(F.col("text_a")), INSIDE).otherwise(0.0)
    score = F.least(F.lit(1.0), both / (F.size("words_a") + F.size("words_b") - both) + bonus)
    return found.select("a", "b", score.alias("score"), "least_a").where("score >= least_a").select("a", "b", "score")


def _decided(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Nodes of a component that lead, oldest first: those that no hub they ask knows a leader for."""
    led: dict[str, set[int]] = {}
    out = []
    for node, own in rows.sort_values("node").groupby("node", sort=True):
        asks = own[own.asks]
        follows = False
        for hub, fixed, shared, mine, least in zip(asks.hub, asks.fixed, asks.shared, asks.own, asks.least):
            if any((fixed if fixed >= 0 else shared / (mine + size - shared)) >= least for size in led.get(hub, ())):
                follows = True
                break
        if not follows:
            out.append(node)
            says = own[~own.asks]
            for hub, size in zip(says.hub, says.own):
                led.setdefault(hub, set()).add(size)
    return pd.DataFrame({"node": out}, dtype="int64")


def _score() -> Column:
    return F.when(F.col("fixed") >= 0, F.col("fixed")).otherwise(F.col("shared") / (F.col("own") + F.col("size") - F.col("shared")))


def leading(says: DataFrame, asks: DataFrame) -> tuple[DataFrame, int]:
    """Leaders among nodes in order of their numbers, and the rounds it took: a node leads unless an older leader speaks
    at a hub that it asks, and is alike enough.

    ``says`` has node, hub, size; ``asks`` node, hub, fixed (a score, or -1), shared, own, least. Everything that meets at a hub is
    two ties, not a pair. In each round every component's oldest nodes with BLOCK ties are decided in one task, and all
    that then follow, however young, are done. So rounds grow with the ties of the largest component over BLOCK at
    most, not with the length of a chain.
    """
    says, asks = cut(says), cut(asks)
    ties = says.select("node", F.xxhash64("hub").alias("hub")).unionByName(asks.select("node", F.xxhash64("hub").alias("hub"))).distinct()
    within = components(ties.select(F.col("node").alias("a"), F.col("hub").alias("b")))  # a hash that meets another only joins two components
    size = says.groupBy("node").agg(F.count(F.lit(1)).alias("n")).join(asks.groupBy("node").agg(F.count(F.lit(1)).alias("m")), "node", "full")
    size = size.select("node", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("ties"))
    open_ = cut(size.join(within, "node", "left").select("node", "ties", F.coalesce("component", "node").alias("component")))
    led, rounds = None, 0
    while open_.limit(1).count():
        rounds += 1
        now = cut(running_sums(open_, "component", "node", "ties").where(F.col("before") < BLOCK).select("node", "component"))
        rows = now.join(says, "node").select("component", "node", "hub", F.lit(False).alias("asks"), F.lit(-1.0).alias("fixed"), F.lit(0.0).alias("shared"), F.col("size").alias("own"), F.lit(0.0).alias("least"))
        rows = rows.unionByName(now.join(asks, "node").select("component", "node", "hub", F.lit(True).alias("asks"), "fixed", "shared", "own", "least"))
        new = cut(rows.groupBy("component").applyInPandas(_decided, "node long"))
        led = new if led is None else cut(led.unionByName(new))
        open_ = open_.join(now.select("node"), "node", "left_anti")
        heard = new.join(says, "node").select("hub", "size").distinct()
        follow = asks.join(heard, "hub").where(_score() >= F.col("least")).select("node").distinct()
        open_ = cut(open_.join(follow, "node", "left_anti"))
    return (size.select("node").limit(0) if led is None else led), rounds


def topic_clusters(topics: DataFrame) -> DataFrame:
    """(topic, leader, score): in order of their numbers, each topic of a class follows the most alike leader, else leads.

    ``topics`` has topic, topic_class, words (of its title) and signature (at most five parts; arrays, repeated values count once).
    Topics are as alike as the better of their signatures' Jaccard similarity and their titles' (see ``title_pairs``); of equal scores
    the oldest leader counts. Leaders have themselves and score 1. Topics without words and signature are like nothing and lead.

    Topics of equal signature and words are one node. Signatures meet at hubs, one for every subset that can reach the
    threshold, so that a part which many share makes no pairs; titles meet at a hub for each different set of words.
    """
    df = topics.select("topic", F.coalesce("topic_class", F.lit("")).alias("class"), F.array_sort(F.array_distinct("words")).alias("words"), F.array_sort(F.array_distinct("signature")).alias("signature"))
    df = written(df, "topics-classed")
    blank = (F.size("words") == 0) & (F.size("signature") == 0)
    alone, df = df.where(blank).select("topic"), df.where(~blank)
    nodes = written(df.groupBy("class", "words", "signature").agg(F.min("topic").alias("node")), "topic-nodes").withColumn("least", threshold(F.col("class")))
    sets = cut(nodes.where(F.size("words") > 0).groupBy("class", "words").agg(F.min("node").alias("id")))
    pairs = cut(title_pairs(sets))
    hub = lambda i: F.concat(F.lit("title:"), i.cast("string"))
    titled = nodes.join(sets, ["class", "words"]).select("node", "id", "least")
    near = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "score").unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), "score"))
    near = near.unionByName(sets.select("id", F.col("id").alias("other"), F.lit(1.0).alias("score")))
    asks_title = titled.join(near, "id").select("node", hub(F.col("other")).alias("hub"), F.col("score").alias("fixed"), F.lit(0.0).alias("shared"), F.lit(0.0).alias("own"), "least")
    says_title = titled.select("node", hub(F.col("id")).alias("hub"), F.lit(0.0).alias("size"))
    subsets = F.aggregate("signature", F.array(F.array().cast("array<string>")), lambda done, x: F.concat(done, F.transform(done, lambda s: F.concat(s, F.array(x)))))
    own = F.size("signature").cast("double")
    signed = nodes.select("node", "class", "least", own.alias("own"), F.explode(subsets).alias("part")).withColumn("shared", F.size("part").cast("double"))
    signed = signed.where((F.col("shared") > 0) & (F.col("shared") / F.col("own") >= F.col("least")))
    signed = signed.select("node", F.concat(F.lit("parts:"), F.to_json(F.struct("class", "part"))).alias("hub"), "shared", "own", "least")
    asks = written(asks_title.unionByName(signed.select("node", "hub", F.lit(-1.0).alias("fixed"), "shared", "own", "least")), "topics-asked")
    says = written(says_title.unionByName(signed.select("node", "hub", F.col("own").alias("size"))), "topics-said")
    led, _ = leading(says, asks)
    led = cut(led)
    heard = led.join(says, "node").groupBy("hub", "size").agg(F.min("node").alias("leader"))
    choices = asks.join(heard, "hub").withColumn("score", _score()).where("score >= least").groupBy("node", "leader").agg(F.max("score").alias("score"))
    known = df.join(nodes.drop("least"), ["class", "words", "signature"]).select("topic", "node")
    follow = known.join(led.withColumnRenamed("node", "topic"), "topic", "left_anti").join(choices, "node").where("leader < topic")
    follow = follow.groupBy("topic").agg(F.max(F.struct("score", (-F.col("leader")).alias("back"))).alias("best"))
    led = led.select(F.col("node").alias("topic")).unionByName(alone)
    return led.select("topic", F.col("topic").alias("leader"), F.lit(1.0).alias("score")).unionByName(follow.select("topic", (-F.col("best.back")).alias("leader"), "best.score"))


def duplicate_titles(topics: DataFrame, least: float = 0.9) -> DataFrame:
    """(topic, leader): in order of titles (then topics), each topic joins the first group whose first topic's title is alike by
    ``least`` or more by difflib's ratio, else begins one. ``topics`` has topic and title.

    Titles are compared in lower case without punctuation, equal ones as one; they are numbered by ranges and decided on in
    rounds that don't grow with chains."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), r"[^\w\s]", ""), r"\s+", " "))
    named = written(topics.select("topic", "title", plain.alias("plain")), "titles")
    first = named.groupBy("plain").agg(F.min(F.struct(F.coalesce("title", F.lit("")).alias("title"), "topic")).alias("first"))
    numbered = running_sums(first.select("plain", "first", F.lit(0).alias("all"), F.lit(1).alias("one")), "all", "first", "one", "node")
    numbered = written(numbered.select("plain", "first", "node"), "titles-numbered")
    pairs = cut(title_ratios(numbered.select(F.col("node").alias("topic"), F.col("plain").alias("title")), least))
    hub = lambda c: F.col(c).cast("string").alias("hub")
    says = numbered.select("node", hub("node"), F.lit(0.0).alias("size"))
    asks = pairs.select(F.col("b").alias("node"), hub("a"), F.lit(1.0).alias("fixed"), F.lit(0.0).alias("shared"), F.lit(0.0).alias("own"), F.lit(1.0).alias("least"))
    led = cut(leading(says, asks)[0])
    joined = pairs.join(led.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("leader")).join(led, "node", "left_anti")
    found = led.select("node", F.col("node").alias("leader")).unionByName(joined)
    seed = numbered.select(F.col("node").alias("leader"), F.col("first.topic").alias("seed"))
    return named.join(numbered.select("plain", "node"), "plain").join(found, "node").join(seed, "leader").select("topic", F.col("seed").alias("leader"))
