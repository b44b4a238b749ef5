"""Scores of generated against voted lists, coverage and classifier metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunefold.operators.ordering import with_position


def coverage(votes: DataFrame, known: DataFrame) -> DataFrame:
    """One row: distinct voted songs, those known, and the rate in per cent (0 without votes)."""
    marked = votes.select("song_id").distinct().join(known.select("song_id", F.lit(1).alias("k")), "song_id", "left")
    n, k = F.count("*"), F.count("k")
    return marked.agg(n.alias("voted"), k.alias("covered"), F.when(n == 0, 0.0).otherwise(F.round(100.0 * k / F.nullif(n, F.lit(0)), 6)).alias("rate"))


def known_votes(votes: DataFrame, known: DataFrame) -> DataFrame:
    """(row_id, songs): known songs in vote order; a query left without any is dropped."""
    own = votes.join(known.select("song_id"), "song_id", "left_semi")
    return own.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("place", "song_id")))["song_id"].alias("songs"))


def list_scores(pairs: DataFrame, top: int = 20) -> DataFrame:
    """Jaccard of the song sets, and the overlap of the first ``top`` of either list over the generated ones' number.
    Queries with an empty side are left out."""
    own = pairs.where("size(voted) > 0 AND size(generated) > 0")
    jaccard = F.size(F.array_intersect("voted", "generated")) / F.size(F.array_union("voted", "generated"))
    v, g = F.slice("voted", 1, top), F.slice("generated", 1, top)
    return own.select("query", F.round(jaccard, 6).alias("jaccard"), F.round(F.size(F.array_intersect(v, g)) / F.size(g), 6).alias("precision_at_20"))


def means(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("queries"), *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in ("jaccard", "precision_at_20")])


def best_worst(scores: DataFrame, n: int) -> DataFrame:
    """The n best and the n worst queries; only they reach the ranking."""
    out = []
    for side, order in (("best", [F.desc("jaccard"), F.asc("query")]), ("worst", [F.asc("jaccard"), F.asc("query")])):
        top = scores.orderBy(*order).limit(n)
        out.append(top.select(F.lit(side).alias("side"), F.row_number().over(Window.orderBy(*order)).alias("rank"), "query", "jaccard"))
    return out[0].unionByName(out[1])


def level_scores(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Jaccard of the lists' semantic ids in full, by two levels and by one; both sides need an id."""
    sides = pairs.select("query", F.explode("voted").alias("song_id"), F.lit(True).alias("v")).unionByName(pairs.select("query", F.explode("generated").alias("song_id"), F.lit(False).alias("v")))
    own = sides.join(ids, "song_id")
    names = {"full_id": ["l1", "l2", "l3"], "l1l2": ["l1", "l2"], "l1": ["l1"]}
    lists = own.groupBy("query").agg(*[F.collect_set(F.when(F.col("v") == side, F.struct(*c))).alias(f"{n}_{side}") for n, c in names.items() for side in (True, False)])
    both = lists.where("size(l1_True) > 0 AND size(l1_False) > 0")
    return both.select("query", *[F.round(F.size(F.array_intersect(f"{n}_True", f"{n}_False")) / F.size(F.array_union(f"{n}_True", f"{n}_False")), 6).alias(n) for n in names])


def binary_metrics(scored: DataFrame, threshold: float = 0.0) -> DataFrame:
    """One row from (score, label): a score above the threshold (a sigmoid above one half) predicts 1."""
    p, y = F.col("score") > threshold, F.col("label") == 1
    tp, fp, fn, ok = F.count_if(p & y), F.count_if(p & ~y), F.count_if(~p & y), F.count_if(p == y)
    def ratio(a, b, name):
        return F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6).alias(name)

    return scored.agg(ratio(ok, F.count("*"), "accuracy"), ratio(tp, tp + fp, "precision"), ratio(tp, tp + fn, "recall"), ratio(2 * tp, 2 * tp + fp + fn, "f1"))


def nearest_rank(df: DataFrame, group: str, value: str, percents: list[int]) -> DataFrame:
    """(grp, q, value): the value at rank 1 + round(q (n - 1) / 100) of each group."""
    slim = df.select(F.col(group).alias("grp"), F.col(value).alias("value")).where("grp IS NOT NULL AND value IS NOT NULL")
    placed = with_position(slim, "grp", "value")
    ends = placed.groupBy("grp").agg(F.min("position").alias("start"), F.count("*").alias("n"), F.array(*[F.lit(q) for q in percents]).alias("qs"))
    wanted = ends.select("grp", F.explode("qs").alias("q"), "start", "n").withColumn("position", F.col("start") + F.bround(F.lit(0.01) * F.col("q") * (F.col("n") - 1), 0).cast("long"))
    return placed.join(wanted.select("grp", "q", "position"), ["grp", "position"]).select("grp", "q", "value")


def parts(df: DataFrame, order: str, n: int) -> DataFrame:
    """Adds ``part``: n nearly equal runs in order, the first ones larger by one."""
    total = df.count()
    base, more = divmod(total, n)
    p = F.col("position")
    cut = more * (base + 1)
    part = F.when(p < cut, F.floor(p / (base + 1))).otherwise(more + F.floor((p - cut) / max(base, 1))) + 1
    return with_position(df, order).withColumn("part", part.cast("int")).drop("position")
