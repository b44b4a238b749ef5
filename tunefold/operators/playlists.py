"""Playlists: grouping, filters, keyword analysis, corpus building."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunefold.functions import text as X
from tunefold.operators.ordering import with_position


def clean_rows(rows: DataFrame) -> DataFrame:
    """(playlist_id, song_id, pos) with trimmed ids; rows without either id are left out."""
    slim = rows.select("playlist_id", X.strip("song_id").alias("song_id"), "pos")
    return slim.where("playlist_id IS NOT NULL AND length(song_id) > 0")


def latest_info(info: DataFrame) -> DataFrame:
    """One row per non-empty glid, the last version; missing text fields become empty, a missing title stays null."""
    w = Window.partitionBy("glid").orderBy(F.desc_nulls_last("updated_at"), F.desc("row_id"))
    last = info.where("glid IS NOT NULL AND glid <> ''").withColumn("__r", F.row_number().over(w)).where("__r = 1")
    return last.select("glid", "listname", *[F.coalesce(c, F.lit("")).alias(c) for c in ("description", "creator", "tags")])


def clean_song_info(info: DataFrame) -> DataFrame:
    """One row per song id with trimmed fields; of several the smallest (name, singer)."""
    slim = info.select(*[X.strip(c).alias(c) for c in ("song_id", "name", "singer")]).where("length(song_id) > 0")
    best = slim.groupBy("song_id").agg(F.min(F.struct(F.coalesce("name", F.lit("")).alias("name"), F.coalesce("singer", F.lit("")).alias("singer"))).alias("x"))
    return best.select("song_id", "x.name", "x.singer")


def valid_ids(ids: DataFrame) -> DataFrame:
    """(song_id, l1, l2, l3) of the rows with three levels; repeated songs keep the smallest id."""
    s = F.col("semantic_ids")
    good = ids.where("song_id IS NOT NULL AND size(semantic_ids) = 3").where(~F.exists(s, lambda x: x.isNull()))
    one = good.groupBy("song_id").agg(F.min(F.struct(s[0].alias("l1"), s[1].alias("l2"), s[2].alias("l3"))).alias("x"))
    return one.select("song_id", "x.l1", "x.l2", "x.l3")


def as_lists(rows: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """(playlist_id, n, songs): the songs in playlist order, doubles kept."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "song_id")))
    lists = rows.groupBy("playlist_id").agg(F.count("*").alias("n"), ordered["song_id"].alias("songs"))
    return lists.where(F.col("n").between(least, most) if most else F.col("n") >= least)


def as_sets(rows: DataFrame) -> DataFrame:
    return rows.groupBy("playlist_id").agg(F.count("*").alias("n"), F.count_distinct("song_id").alias("distinct_songs"))


def islands(rows: DataFrame, file: str, *order: str) -> DataFrame:
    """(file, island, playlist_id, n): runs of consecutive rows of one playlist in a file's order."""
    w = Window.partitionBy(file).orderBy(*order)
    starts = rows.withColumn("__new", F.when(F.lag("playlist_id").over(w).eqNullSafe(F.col("playlist_id")), 0).otherwise(1))
    numbered = starts.withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(file, "island", "playlist_id").agg(F.count("*").alias("n"))


def keyword_matches(info: DataFrame, keyword: str, fields: tuple[str, ...] = ("listname", "description", "tags")) -> DataFrame:
    """Playlists with the keyword in any of the fields, whatever the case."""
    k = F.lit(keyword.lower())
    return info.where(reduce(lambda a, b: a | b, [F.coalesce(F.lower(f).contains(k), F.lit(False)) for f in fields]))


def song_frequency(rows: DataFrame, matched: DataFrame) -> DataFrame:
    """Occurrences (doubles count) and playlists of each song in the matched playlists."""
    own = rows.join(matched.select(F.col("glid").alias("playlist_id")), "playlist_id", "left_semi")
    return own.groupBy("song_id").agg(F.count("*").alias("occurrences"), F.count_distinct("playlist_id").alias("playlists"))


def top_songs(frequency: DataFrame, songs: DataFrame, n: int) -> DataFrame:
    """The n most frequent songs with their names; ties by song id."""
    best = frequency.orderBy(F.desc("occurrences"), "song_id").limit(n)
    rank = F.row_number().over(Window.orderBy(F.desc("occurrences"), "song_id"))  # n rows
    named = best.withColumn("rank", rank).join(songs, "song_id", "left")
    return named.select("rank", "song_id", "occurrences", "playlists", F.coalesce("name", F.lit("N/A")).alias("name"), F.coalesce("singer", F.lit("N/A")).alias("singer"))


def keyword_summary(rows: DataFrame, matched: DataFrame) -> DataFrame:
    """One row: matched playlists (those without songs count), songs, mean per playlist and the spread of frequencies."""
    freq = song_frequency(rows, matched)
    stats = freq.agg(
        F.count("*").alias("songs"),
        F.coalesce(F.sum("occurrences"), F.lit(0)).alias("occurrences"),
        F.avg("occurrences").alias("mean"),
        F.median("occurrences").alias("median"),
        F.stddev_pop("occurrences").alias("std"),
        F.max(F.struct("occurrences", F.col("song_id")))["occurrences"].alias("most"),
        F.min("occurrences").alias("least"),
    )
    total = matched.agg(F.count("*").alias("matched"))
    return total.join(stats, F.lit(True)).select("matched", "songs", "occurrences", F.try_divide("occurrences", "matched").alias("per_playlist"), "mean", "median", "std", "most", "least")


def creators(rows: DataFrame, matched: DataFrame) -> DataFrame:
    """Matched playlists with songs per creator; an empty creator is left out."""
    own = matched.join(rows.select(F.col("playlist_id").alias("glid")).distinct(), "glid", "left_semi")
    return own.where("creator <> ''").groupBy("creator").agg(F.count("*").alias("playlists"))


def compare_keywords(info: DataFrame, rows: DataFrame, keywords: list[str], top: int = 5, fields: tuple[str, ...] = ("listname", "description", "tags")) -> DataFrame:
    """(keyword, playlists, songs, rank, song_id, occurrences) for each keyword's top songs, in one pass over the rows."""
    hit = F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, [F.coalesce(F.lower(f).contains(k.lower()), F.lit(False)) for f in fields]), F.lit(k)) for k in keywords]))
    matched = info.select("glid", F.explode(hit).alias("keyword"))
    per = matched.groupBy("keyword").agg(F.count("*").alias("playlists"))
    freq = rows.join(matched.withColumnRenamed("glid", "playlist_id"), "playlist_id").groupBy("keyword", "song_id").agg(F.count("*").alias("occurrences"))
    w = Window.partitionBy("keyword")
    ranked = freq.withColumn("songs", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("occurrences"), "song_id"))).where(F.col("rank") <= top)
    return ranked.join(per, "keyword").select("keyword", "playlists", "songs", "rank", "song_id", "occurrences")


def with_ids(rows: DataFrame, info: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of playlists that have info and a title, with the songs' semantic ids where there are any."""
    titled = info.where("listname IS NOT NULL AND listname <> ''").select(F.col("glid").alias("playlist_id"), F.col("listname").alias("title"))
    return rows.join(titled, "playlist_id").join(ids, "song_id", "left")


def build_corpus(rows: DataFrame, info: DataFrame, ids: DataFrame, min_songs: int = 10, max_tokens: int = 384) -> DataFrame:
    """(glid, title, songs_with_id, output_sequence): songs in string order, doubles kept, as token triples; playlists with
    fewer than ``min_songs`` songs that have an id are left out."""
    own = with_ids(rows, info, ids).where("l1 IS NOT NULL")
    packed = F.array_sort(F.collect_list(F.struct("song_id", "l1", "l2", "l3")))
    lists = own.groupBy("playlist_id", "title").agg(packed.alias("x"), F.count("*").alias("songs_with_id")).where(F.col("songs_with_id") >= min_songs)
    tokens = F.flatten(F.transform("x", lambda s: X.id_tokens(s["l1"], s["l2"], s["l3"])))
    return lists.select(F.col("playlist_id").alias("glid"), "title", "songs_with_id", X.sequence_text(tokens, max_tokens - 1).alias("output_sequence"))


def corpus_stats(rows: DataFrame, info: DataFrame, ids: DataFrame, min_songs: int = 10) -> DataFrame:
    """One row of counts over the playlists that have songs: without info, without title, too few songs with ids, kept; and
    songs with and without ids among titled playlists."""
    per = rows.join(ids.select("song_id", F.lit(1).alias("has")), "song_id", "left").groupBy("playlist_id").agg(F.count("*").alias("songs"), F.count("has").alias("with_id"))
    joined = per.join(info.select(F.col("glid").alias("playlist_id"), "listname", F.lit(True).alias("known")), "playlist_id", "left")
    known, titled = F.col("known").isNotNull(), F.coalesce(F.col("listname") != "", F.lit(False))
    ok = known & titled
    return joined.agg(
        F.count("*").alias("playlists"),
        F.count_if(~known).alias("without_info"),
        F.count_if(known & ~titled).alias("without_title"),
        F.count_if(ok & (F.col("with_id") < min_songs)).alias("too_few"),
        F.count_if(ok & (F.col("with_id") >= min_songs)).alias("kept"),
        F.sum(F.when(ok, F.col("songs")).otherwise(0)).alias("songs"),
        F.sum(F.when(ok, F.col("with_id")).otherwise(0)).alias("songs_with_id"),
    )


def split(df: DataFrame, key: str, train: float = 0.98, val: float = 0.01, seed: int = 42) -> DataFrame:
    """Adds ``split``: in a seeded order the first int(n train) are train, the next int(n val) are val, the rest test."""
    n = df.count()
    first, second = int(n * train), int(n * train) + int(n * val)
    placed = with_position(df, F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key), name="__at")
    return placed.withColumn("split", F.when(F.col("__at") < first, "train").when(F.col("__at") < second, "val").otherwise("test")).drop("__at")
