"""Queries of the general problems 1 and 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunefold.operators.packed_values import split_packed
from tunefold.operators.skewed_keys import heavy_keys, per_key


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = spark.read.parquet(f"{sf_dir}/gen_playlist_info.parquet")
    return split_packed(info, "tags", ["row_id"], "tag_pos", "tag")


def p1_tag_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows hold each tag, and how often it occurs."""
    tags = p1_found(spark, sf_dir)
    return tags.groupBy("tag").agg(F.count("*").alias("occurrences"), F.countDistinct("row_id").alias("rows_with_tag"))


def p1_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that hold separators, packed in quotes by another rule in each row, come out whole."""
    info = spark.read.parquet(f"{sf_dir}/gen_playlist_info.parquet")
    a, b, c = (F.coalesce(F.regexp_replace(x, r"[\"\\\\]", ""), F.lit("none")) for x in ("listname", "creator", "nickname"))
    one, two = F.concat(F.lit("x "), a, F.lit("; "), b, F.lit(" y")), F.concat(F.lit("x|"), c, F.lit(", y"))
    field = F.concat(F.lit('"'), one, F.lit('"'), F.element_at(F.array(F.lit(", "), F.lit(";"), F.lit(" | ")), (F.pmod("row_id", F.lit(3)) + 1).cast("int")), F.lit('"'), two, F.lit('"'))
    return split_packed(info.select("row_id", field.alias("packed")), "packed", ["row_id"], "tag_pos", "tag")


def p4_song_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/gen_playlist_song.parquet")
    return per_key(rows, "song_id", "playlist_id", "ingested_at")


def p4_creator_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/gen_playlist_info.parquet")
    return per_key(rows, "creator", "glid", "updated_at")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    songs = spark.read.parquet(f"{sf_dir}/gen_playlist_song.parquet")
    infos = spark.read.parquet(f"{sf_dir}/gen_playlist_info.parquet")
    trimmed = songs.withColumn("song_id", F.trim("song_id", F.lit(" \t\n\x0b\f\r")))
    heavy = []
    for name, table, key, group, at in (("song_id", trimmed, "song_id", "playlist_id", "ingested_at"), ("creator", infos, "creator", "glid", "updated_at")):
        found = heavy_keys(per_key(table, key, group, at), table.count())
        heavy.append(found.select(F.lit(name).alias("field_name"), "key_value"))
    return heavy[0].unionByName(heavy[1])


QUERIES = {f.__name__: f for f in (p1_found, p1_tag_frequency, p1_round_trip, p4_song_stats, p4_creator_stats, p4_found)}

_BARE = "coalesce(regexp_replace({}, '[\"\\\\]', '', 'g'), 'none')"

SQL = {
    "p1_round_trip": f"""SELECT row_id, 0 AS tag_pos, 'x ' || {_BARE.format("listname")} || '; ' || {_BARE.format("creator")} || ' y' AS tag FROM gen_playlist_info
        UNION ALL SELECT row_id, 1, 'x|' || {_BARE.format("nickname")} || ', y' FROM gen_playlist_info""",
    "p4_song_stats": """
        SELECT song_id AS key_value, count(*) AS n_rows,
               count(DISTINCT coalesce('=' || playlist_id, '')) AS n_groups,
               CAST(min(ingested_at) AS TIMESTAMP) AS first_at, CAST(max(ingested_at) AS TIMESTAMP) AS last_at
        FROM gen_playlist_song WHERE song_id IS NOT NULL GROUP BY song_id""",
    "p4_creator_stats": """
        SELECT creator AS key_value, count(*) AS n_rows,
               count(DISTINCT coalesce('=' || glid, '')) AS n_groups,
               CAST(min(updated_at) AS TIMESTAMP) AS first_at, CAST(max(updated_at) AS TIMESTAMP) AS last_at
        FROM gen_playlist_info WHERE creator IS NOT NULL GROUP BY creator""",
    "p4_found": r"""
        SELECT 'song_id' AS field_name, k AS key_value FROM (
            SELECT regexp_replace(song_id, '^\s+|\s+$', '', 'g') AS k, count(*) AS n FROM gen_playlist_song WHERE song_id IS NOT NULL GROUP BY 1)
        WHERE n * 50 >= (SELECT count(*) FROM gen_playlist_song)
        UNION ALL
        SELECT 'creator', creator FROM (SELECT creator, count(*) AS n FROM gen_playlist_info WHERE creator IS NOT NULL GROUP BY 1)
        WHERE n * 50 >= (SELECT count(*) FROM gen_playlist_info)""",
}
