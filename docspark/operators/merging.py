"""Topics that are one: weights, merge maps, aliases, families of meetings and of accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.text import family, slug, tokens
from docspark.plans.components import components

#: Classes of topics that are compared with each other, and families that move a topic to another group.
GROUPS = {
    **dict.fromkeys(("financial_period", "general_administration", "vendor_relationship", "other"), "admin_finance"),
    **dict.fromkeys(("legal_matter", "case_file", "building_issue"), "matter"),
}
MOVED = {"legal_matter": ("privacy", "contract", "tax", "cadastre"), "case_file": ("tax", "cadastre")}
FAMILY_SIGNED = ("tax", "statement", "cadastre", "privacy")
MEETING_WORDS = ("verbale", "assemblea", "condominiale", "condominiali", "ordinaria", "straordinaria")


def weights(topics: DataFrame, assignments: DataFrame, proposals: DataFrame | None = None) -> DataFrame:
    """(topic, weight): number of assignments, of proposals, and the sum of their confidences, which compare in this order.

    ``assignments`` has topic and confidence, ``proposals`` too (topic is the matched one, null where none is)."""
    rows = assignments.select("topic", F.lit(1).alias("a"), F.lit(0).alias("p"), "confidence")
    if proposals is not None:
        rows = rows.unionByName(proposals.where("topic is not null").select("topic", F.lit(0).alias("a"), F.lit(1).alias("p"), "confidence"))
    n = rows.groupBy("topic").agg(F.sum("a").alias("a"), F.sum("p").alias("p"), F.coalesce(F.sum("confidence"), F.lit(0)).alias("c"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return topics.select("topic").join(n, "topic", "left").select("topic", F.struct(zero("a").alias("assignments"), zero("p").alias("proposals"), zero("c").alias("confidence")).alias("weight"))


def _heaviest(topic: str = "topic") -> Column:
    return F.max_by(topic, F.struct("weight", -F.col(topic)))


def merged_map(merges: DataFrame, weighted: DataFrame) -> DataFrame:
    """(topic, survivor) of every topic in ``merges`` (source, target): of all that merges tie together the heaviest
    survives, of equal ones the smallest number. ``weighted`` is what ``weights`` gives."""
    tied = components(merges, "source", "target").toDF("topic", "group")
    best = tied.join(weighted, "topic").groupBy("group").agg(_heaviest().alias("survivor"))
    return tied.join(best, "group").select("topic", "survivor")


def merged_assignments(assignments: DataFrame, to: DataFrame) -> DataFrame:
    """``assignments`` (unit, topic, role, confidence, rationale) of merged topics, moved to their survivors. Of a unit's
    repeated role the greatest confidence stays, and the first rationale: the survivor's own, then by topic."""
    df = assignments.join(to, "topic", "left").withColumn("own", F.coalesce(F.col("survivor") != F.col("topic"), F.lit(False)))
    order = F.when(F.col("rationale").isNotNull(), F.struct("own", "topic", "rationale"))
    return df.groupBy("unit", F.coalesce("survivor", "topic").alias("topic"), "role").agg(F.max("confidence").alias("confidence"), F.min_by("rationale", order).alias("rationale"))


def merged_aliases(topics: DataFrame, to: DataFrame) -> DataFrame:
    """(topic, alias): slugs and titles of those that lost, as new aliases of their survivor; names that differ in case only
    are one (the first of them), and the survivor's own slug and title are none. ``topics`` has topic, slug, title."""
    named = lambda df, key: df.select(key, F.explode(F.array("slug", "title")).alias("alias")).where("alias is not null")
    lost = named(topics.join(to.where("topic <> survivor"), "topic"), "survivor").withColumn("low", F.lower("alias"))
    own = named(topics.join(to.select(F.col("survivor").alias("topic")).distinct(), "topic", "left_semi"), "topic").select(F.col("topic").alias("survivor"), F.lower("alias").alias("low"))
    return lost.join(own, ["survivor", "low"], "left_anti").groupBy(F.col("survivor").alias("topic"), "low").agg(F.min("alias").alias("alias")).select("topic", "alias")


def cross_class(topics: DataFrame, anchors: DataFrame) -> DataFrame:
    """(topic, signature): group of classes and anchors by which topics of different classes are one; null where none.

    ``topics`` has topic, title, topic_class; ``anchors`` topic, address, organization, person, place (or null)."""
    kind, fam = F.col("topic_class"), family(F.col("title"))
    moved = F.lit(False)
    for name, families in MOVED.items():
        moved |= (kind == name) & F.coalesce(fam.isin(*families), F.lit(False))
    group = F.when(moved, "admin_finance").otherwise(F.create_map(*(F.lit(x) for pair in GROUPS.items() for x in pair))[kind])
    near, org = F.coalesce("address", "person", "place"), F.col("organization")
    by_org = F.array_compact(F.array(group, org, F.nullif(near, org)))
    by_place = F.array_compact(F.array(group, near, F.when(fam.isin(*FAMILY_SIGNED), fam)))
    first = F.coalesce("address", "organization", "place", "person")
    admin = F.when(org.isNotNull(), by_org).when(near.isNotNull(), by_place)
    other = F.when(first.isNotNull(), F.array_compact(F.array(group, first, fam)))
    signature = F.when(group == "admin_finance", admin).when(group.isNotNull(), other)
    return topics.join(anchors, "topic", "left").select("topic", F.array_join(signature, "|").alias("signature"))


def survivors(keyed: DataFrame, weighted: DataFrame) -> DataFrame:
    """(topic, key, survivor) of the groups of two or more that share a key, a heaviest one each. ``keyed`` has topic, key."""
    df = keyed.where("key is not null").join(weighted, "topic")
    best = df.groupBy("key").agg(_heaviest().alias("survivor"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n", "weight")
    return df.join(best, "key").select("topic", "key", "survivor")


def meeting_families(topics: DataFrame, anchors: DataFrame, labels: DataFrame, weighted: DataFrame) -> DataFrame:
    """(topic, first, title, survivor) of active topics of meetings: ``first`` is the heaviest of those with its address,
    organization or place (else the first three words of the title), which takes the family's title; families whose
    titles and descriptions have the same first four words are then merged into the heaviest.

    ``topics`` has topic, title, description, tokens; ``anchors`` topic, address, organization, place; ``labels`` topic,
    label (its anchor as written, or null). Weights count what a family took over in the first step."""
    words = F.concat(F.lit("w:"), F.array_join(F.slice(F.array_sort("tokens"), 1, 3), "_"))
    key = F.coalesce(F.concat(F.lit("a:"), F.coalesce("address", "organization", "place")), F.when(F.size("tokens") > 0, words))
    df = topics.join(anchors, "topic", "left").withColumn("key", key).where("key is not null").join(weighted, "topic")
    best = df.groupBy("key").agg(_heaviest().alias("first"), F.sum("weight.assignments").alias("n"), F.sum("weight.proposals").alias("p"), F.sum("weight.confidence").alias("c"))
    told = df.where(F.col("title").contains(" - ")).select("topic", F.trim(F.regexp_extract("title", r"(?s)^.*? - (.*)$", 1)).alias("told"))
    head = best.join(topics.select(F.col("topic").alias("first"), "description"), "first").join(labels.withColumnRenamed("topic", "first"), "first", "left").join(told.withColumnRenamed("topic", "first"), "first", "left")
    head = head.withColumn("title", F.concat_ws(" - ", F.lit("Assemblee condominiali"), F.coalesce("label", "told")))
    kept = F.array_sort(F.array_except(tokens(F.concat_ws(" ", "title", "description")), F.array(*map(F.lit, MEETING_WORDS))))
    head = head.withColumn("signature", F.array_join(F.slice(kept, 1, 4), "_")).withColumn("weight", F.struct("n", "p", "c"))
    head = head.withColumn("signature", F.when(F.col("signature") == "", F.col("key")).otherwise(F.col("signature")))
    final = head.groupBy("signature").agg(_heaviest("first").alias("survivor"))
    named = head.join(final, "signature").select("key", "title", "survivor")
    return df.select("topic", "key").join(best.select("key", "first"), "key").join(named, "key").select("topic", "first", "title", "survivor")


def meeting_assignments(families: DataFrame, assignments: DataFrame, units: DataFrame, minutes: str) -> DataFrame:
    """New assignments (unit, topic, role, confidence) of units of kind ``minutes`` (or of none) to the family their meeting
    topic belongs to, with the confidence of the first of them; units that have the family already get none."""
    of = units.where((F.col("kind") == minutes) | F.col("kind").isNull()).select("unit")
    held = assignments.join(families.select("topic", "first"), "topic").join(of, "unit", "left_semi")
    new = held.groupBy("unit", "first").agg(F.min_by("confidence", F.struct("topic", "role", "confidence")).alias("confidence"))
    has = assignments.where("role = 'document_family'").select("unit", F.col("topic").alias("first")).distinct()
    return new.join(has, ["unit", "first"], "left_anti").select("unit", F.col("first").alias("topic"), F.lit("document_family").alias("role"), "confidence")


def reviewed(proposals: DataFrame, reviews: DataFrame, topics: DataFrame) -> DataFrame:
    """Every proposal after its review: proposal, unit, slug, title, confidence, matched (topic before), status, action, role,
    topic, is_new.

    ``proposals`` has proposal, unit, topic (matched, or null), slug, title, confidence, status; ``reviews`` one row a proposal:
    proposal, action, target, role. Only proposals that wait are reviewed. Merging and adding take the target, else
    the matched topic, and leave the proposal waiting where neither exists; approving takes the topic with the proposal's
    slug, else makes one (topic null, is_new). Those that wait and have a matched topic are merged into it."""
    known, by_slug = topics.select(F.col("topic").alias("found")), topics.groupBy("slug").agg(F.min("topic").alias("named"))
    df = proposals.withColumnRenamed("topic", "matched").join(reviews, "proposal", "left")
    waits, has = F.col("status") == "proposed", F.col("role").isNotNull()
    action = F.when(waits & has, F.coalesce("action", F.when(F.col("matched").isNotNull(), "merge_into_existing").otherwise("approve_new_topic")))
    df = df.withColumn("action", action).join(known, F.coalesce("target", "matched") == F.col("found"), "left").join(by_slug, "slug", "left")
    onto = F.col("action").isin("merge_into_existing", "add_secondary_topic")
    topic = F.when(onto, F.col("found")).when(F.col("action") == "approve_new_topic", F.col("named")).otherwise(F.col("matched"))
    new = F.coalesce((F.col("action") == "approve_new_topic") & F.col("named").isNull(), F.lit(False))
    done = F.when(F.col("action") == "reject", "rejected").when(onto & F.col("found").isNotNull(), "approved").when(F.col("action") == "approve_new_topic", "approved")
    status = F.coalesce(done, F.when(waits & F.col("action").isNull() & F.col("matched").isNotNull(), "merged_into_existing"), "status")
    return df.select("proposal", "unit", "slug", "title", "confidence", "matched", status.alias("status"), F.when(done.isNotNull(), F.col("action")).alias("action"), "role", topic.alias("topic"), new.alias("is_new"))


def assignments_after(decided: DataFrame, assignments: DataFrame, topics: DataFrame) -> DataFrame:
    """(unit, topic, slug, role, confidence) after what ``reviewed`` decided; slug only where the topic is yet to be made.

    Rejecting takes the unit's matched topic away. Merging replaces it, and the unit's primary topics that aren't active,
    by the target; adding and approving put a topic beside the others. ``topics`` has topic, is_active."""
    gone = decided.where("action in ('reject', 'merge_into_existing')").select("unit", "matched", (F.col("action") == "reject").alias("reject"))
    units = gone.groupBy("unit").agg(F.bool_and("reject").alias("only_rejected"))
    df = assignments.join(gone.select("unit", F.col("matched").alias("topic")).distinct(), ["unit", "topic"], "left_anti")
    df = df.join(topics.select("topic", "is_active"), "topic", "left").join(units, "unit", "left")
    provisional = (F.col("role") == "primary") & ~F.coalesce("is_active", F.lit(False)) & ~F.coalesce("only_rejected", F.lit(True))
    df = df.where(~provisional).select("unit", "topic", "role", "confidence")
    new = decided.where("action is not null and action <> 'reject'").groupBy("unit", "topic", F.when(F.col("is_new"), F.col("slug")).alias("slug"), "role").agg(F.max("confidence").alias("confidence"))
    kept = df.join(new.where("topic is not null").select("unit", "topic", "role"), ["unit", "topic", "role"], "left_anti")
    return kept.select("unit", "topic", F.lit(None).cast("string").alias("slug"), "role", "confidence").unionByName(new)


def accounting_families(units: DataFrame, mentions: DataFrame, assignments: DataFrame, topics: DataFrame, weighted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Umbrella topics of accounting units: (unit, anchor, topic, title, slug), and the assignments that go.

    A unit goes by its longest anchor (``mentions``: unit, key, value of addresses, organizations, places; ties to the first).
    The topic is the heaviest financial one that a unit of the anchor has; null where one must be made with this title and
    slug, unless ``topics`` (topic, slug, topic_class, topic_kind) has the slug. Assignments of these units to families of
    meetings go."""
    named = mentions.where("key <> ''").join(units.select("unit"), "unit", "left_semi").groupBy("unit", "key").agg(F.min_by(F.trim("value"), F.struct("ordinal", "value")).alias("value"))
    mine = named.groupBy("unit").agg(F.min_by(F.struct("key", "value"), F.struct(-F.length("key"), "key")).alias("a")).select("unit", F.col("a.key").alias("anchor"), F.col("a.value").alias("value"))
    held = assignments.join(topics, "topic").join(mine.select("unit", "anchor"), "unit")
    best = held.where("topic_class = 'financial_period'").select("anchor", "topic").distinct().join(weighted, "topic").groupBy("anchor").agg(_heaviest().alias("held"))
    label = mine.groupBy("anchor").agg(F.min_by("value", "unit").alias("value")).withColumn("title", F.concat(F.lit("Rendiconti Condominiali - "), "value")).withColumn("slug", slug(F.col("title")))
    known = topics.groupBy("slug").agg(F.min("topic").alias("known"))
    label = label.join(best, "anchor", "left").join(known, "slug", "left").select("anchor", F.coalesce("held", "known").alias("topic"), "title", "slug")
    gone = held.where("topic_class = 'meeting' and topic_kind = 'family'").select("unit", "topic", "role").distinct()
    return mine.select("unit", "anchor").join(label, "anchor").select("unit", "anchor", "topic", "title", "slug"), gone
