"""Semantic ids: assignment, quality of an id table, prefixes and constrained generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunefold.functions import vectors as V


def nearest_centers(points: DataFrame, centers: DataFrame, parent: list[str] | None = None) -> DataFrame:
    """Adds ``slot`` and ``d`` of the nearest center, with ``parent`` columns among the centers of the same parent only.

    ``centers`` has (slot, center) and the parent columns. The centers of a parent travel as one array, so a point meets
    them in one row and nothing is expanded.
    """
    book = centers.groupBy(*(parent or [])).agg(F.array_sort(F.collect_list(F.struct("slot", "center"))).alias("__book"))
    joined = points.join(book, parent) if parent else points.join(F.broadcast(book), F.lit(True))
    best = F.array_min(F.transform("__book", lambda c: F.struct(F.round(V.euclidean(F.col("v"), c["center"]), 9).alias("d"), c["slot"].alias("slot"))))
    return joined.withColumn("__best", best).withColumn("slot", F.col("__best.slot")).withColumn("d", F.col("__best.d")).drop("__book", "__best")


def overflow(assigned: DataFrame, target: int) -> DataFrame:
    counts = assigned.groupBy("slot").agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.sum(F.greatest(F.col("n") - target, F.lit(0).cast("long"))), F.lit(0)).alias("loss"))


def center_means(assigned: DataFrame) -> DataFrame:
    """(slot, k, x): the mean of each element per cluster."""
    return assigned.select("slot", F.posexplode("v").alias("k", "x")).groupBy("slot", "k").agg(F.avg("x").alias("x"))


def _songs(ids: DataFrame, k: int) -> DataFrame:
    """(l1, l2, l3, n, songs): the number of an id's songs and the first k in string order; a large id isn't gathered."""
    key = ["l1", "l2", "l3"]
    first = ids.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy("song_id"))).where(F.col("__r") <= k)
    lists = first.groupBy(*key).agg(F.array_sort(F.collect_list("song_id")).alias("songs"))
    return ids.groupBy(*key).agg(F.count("*").alias("n")).join(lists, key)


def collisions(ids: DataFrame, shown: int = 10) -> DataFrame:
    """Ids of more than one song, with their number and the first songs."""
    return _songs(ids, shown).where("n > 1").select("l1", "l2", "l3", "n", F.array_join("songs", " ").alias("songs"))


def collision_summary(ids: DataFrame) -> DataFrame:
    n = ids.groupBy("l1", "l2", "l3").agg(F.count("*").alias("n")).where("n > 1")
    return n.agg(F.count("*").alias("ids"), F.coalesce(F.sum("n"), F.lit(0)).alias("songs"), F.coalesce(F.max("n"), F.lit(0)).alias("worst"))


def id_coverage(ids: DataFrame) -> DataFrame:
    u = F.count_distinct("l1", "l2", "l3")
    return ids.agg(F.count("*").alias("songs"), u.alias("unique_ids"), F.round(F.try_divide(u, F.count("*")), 6).alias("coverage"), *[F.count_distinct(c).alias(f"unique_{c}") for c in ("l1", "l2", "l3")])


def layer_stats(ids: DataFrame) -> DataFrame:
    """Per layer: unique values, smallest and largest, and the spread of the counts over 0..largest, gaps counting as 0."""
    stacked = ids.select(F.expr("stack(3, 1, l1, 2, l2, 3, l3) AS (layer, id)"))
    counts = stacked.groupBy("layer", "id").agg(F.count("*").alias("n"))
    s = counts.groupBy("layer").agg(F.count("*").alias("unique_ids"), F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.min("n").alias("lo"), F.max("n").alias("most"), F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("tt"))
    slots = F.col("max_id") + 1
    mean = F.col("t") / slots
    return s.select("layer", "unique_ids", "min_id", "max_id", F.when(F.col("unique_ids") < slots, 0).otherwise(F.col("lo")).alias("least"), "most", F.round(mean, 6).alias("mean"), F.round(F.sqrt(F.greatest(F.col("tt") / slots - mean * mean, F.lit(0.0))), 6).alias("std"))


def combinations(ids: DataFrame, need: tuple[int, int] = (128, 128)) -> DataFrame:
    c = F.count_distinct("l1", "l2")
    return ids.agg(c.alias("combinations"), F.round(c / F.lit(need[0] * need[1]), 6).alias("utilisation"))


def spread(df: DataFrame, value: str) -> DataFrame:
    v = F.col(value)
    return df.agg(F.round(F.avg(v), 6).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.median(v).alias("median"), F.round(F.stddev_pop(v), 6).alias("std"))


def thirds_per_pair(ids: DataFrame) -> DataFrame:
    return spread(ids.groupBy("l1", "l2").agg(F.count_distinct("l3").alias("n")), "n")


def songs_per_pair(ids: DataFrame) -> DataFrame:
    return spread(ids.groupBy("l1", "l2").agg(F.count("*").alias("n")), "n")


def multiplicity(ids: DataFrame) -> DataFrame:
    n = ids.groupBy("l1", "l2", "l3").agg(F.count("*").alias("n"))
    return n.groupBy("n").agg(F.count("*").alias("ids"))


def smallest_pairs(ids: DataFrame, k: int = 10) -> DataFrame:
    return ids.groupBy("l1", "l2").agg(F.count("*").alias("songs"), F.count_distinct("l3").alias("thirds")).orderBy("songs", "l1", "l2").limit(k)


def with_prefix(ids: DataFrame, levels: tuple[int, ...]) -> DataFrame:
    for c, x in zip(("l1", "l2", "l3"), levels):
        ids = ids.where(F.col(c) == x)
    return ids


def next_tokens(ids: DataFrame) -> DataFrame:
    """(prefix, next): the children of every prefix of no, one or two levels."""
    one = ids.select(F.lit("").alias("prefix"), F.col("l1").alias("next"))
    two = ids.select(F.col("l1").cast("string").alias("prefix"), F.col("l2").alias("next"))
    three = ids.select(F.concat_ws(",", "l1", "l2").alias("prefix"), F.col("l3").alias("next"))
    return one.unionByName(two).unionByName(three).distinct()


def trie_stats(ids: DataFrame) -> DataFrame:
    """(level, children, nodes): how many nodes have how many children, level 0 the root, and level 3 the sequences."""
    one = ids.groupBy("l1").agg(F.count_distinct("l2").alias("children")).select(F.lit(1).alias("level"), "children")
    two = ids.groupBy("l1", "l2").agg(F.count_distinct("l3").alias("children")).select(F.lit(2).alias("level"), "children")
    root = ids.agg(F.count_distinct("l1").alias("children")).select(F.lit(0).alias("level"), "children")
    whole = ids.agg(F.count_distinct("l1", "l2", "l3").alias("children")).select(F.lit(3).alias("level"), "children")
    return root.unionByName(one).unionByName(two).unionByName(whole).groupBy("level", "children").agg(F.count("*").alias("nodes"))


def allowed_next(prefixes: DataFrame, ids: DataFrame, vocabulary: int) -> DataFrame:
    """Adds ``allowed`` to (key, prefix array): the children of a prefix shorter than three; after three every first-level
    token and the end mark (-1); after an unknown prefix the end mark alone."""
    nexts = next_tokens(ids).groupBy("prefix").agg(F.array_sort(F.collect_list("next")).alias("children"))
    text = F.array_join(F.transform("prefix", lambda x: x.cast("string")), ",")
    joined = prefixes.withColumn("__p", text).join(nexts.withColumnRenamed("prefix", "__p"), "__p", "left")
    end = F.array(F.lit(-1))
    fresh = F.concat(F.sequence(F.lit(0), F.lit(vocabulary - 1)), end)
    return joined.withColumn("allowed", F.when(F.size("prefix") >= 3, fresh).otherwise(F.coalesce("children", end))).drop("__p", "children")


def masked_scores(scores: Column, allowed: Column) -> Column:
    """Scores by token; those not allowed become minus infinity."""
    return F.transform(scores, lambda x, i: F.when(F.array_contains(allowed, i), x).otherwise(F.lit(float("-inf"))))


def generated_counts(generated: DataFrame, ids: DataFrame) -> DataFrame:
    """(key, l1, l2, l3, n, first): known ids of a generated list by how often they came, then where first."""
    per = generated.groupBy("key", "l1", "l2", "l3").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    return per.join(ids.select("l1", "l2", "l3").distinct(), ["l1", "l2", "l3"], "left_semi").select("key", "l1", "l2", "l3", "n", "first")


def recommendations(generated: DataFrame, ids: DataFrame, limit: int = 10, similar: int = 5) -> DataFrame:
    """(key, rank, l1, l2, l3, n, cluster_size, primary, similar): the first song of each generated id in string order and
    the next ones; cut after the join."""
    ranked = generated_counts(generated, ids)
    w = Window.partitionBy("key").orderBy(F.desc("n"), "first")
    top = ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    members = _songs(ids, similar + 1)
    return top.join(members.withColumnRenamed("n", "cluster_size"), ["l1", "l2", "l3"]).select("key", "rank", "l1", "l2", "l3", "n", "cluster_size", F.col("songs")[0].alias("primary"), F.array_join(F.slice("songs", 2, similar), " ").alias("similar"))


def invalid(generated: DataFrame, ids: DataFrame) -> DataFrame:
    bad = generated.select("key", "l1", "l2", "l3").join(ids.select("l1", "l2", "l3").distinct(), ["l1", "l2", "l3"], "left_anti")
    return bad.groupBy("key").agg(F.count("*").alias("invalid"))


def candidate_slots(allowed: DataFrame) -> DataFrame:
    """Ordinal of each allowed candidate within its (l1, l2) row."""
    w = Window.partitionBy("l1", "l2").orderBy("candidate")
    return allowed.withColumn("slot", F.row_number().over(w) - 1)
