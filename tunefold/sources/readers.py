"""Readers of the native file formats. Every relation has one fixed schema; rows that don't fit are left out, as stated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunefold import schemas
from tunefold.functions import text as X

ENCODINGS = ("utf-8", "gbk", "gb18030", "utf-8-sig", "latin1")
NOTHING = "\uffff"  # no character, so no field holds it


def _fields(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """Raw lines cut at the separator; quotes are ordinary characters."""
    return spark.read.text(path).where("value <> ''").select(F.split("value", sep, -1).alias("f"))


def playlist_song(spark: SparkSession, path: str, sep: str = "\t", header: bool = False) -> DataFrame:
    """Lines with fewer than two fields are left out; ``pos`` grows with the place in the file."""
    if header:
        rows = spark.read.option("header", True).option("sep", sep).schema(schemas.PLAYLIST_SONG).csv(path)
        return rows.where("playlist_id IS NOT NULL AND song_id IS NOT NULL").withColumn("pos", F.monotonically_increasing_id())
    rows = _fields(spark, path, sep).where("size(f) >= 2")
    return rows.select(F.col("f")[0].alias("playlist_id"), F.col("f")[1].alias("song_id"), F.monotonically_increasing_id().alias("pos"))


def playlist_info(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """With a header, all text, columns by name; missing text columns become empty, an empty glid is left out and the last
    row of a glid counts."""
    rows = spark.read.option("header", True).option("sep", sep).option("quote", "").csv(path)
    names = [c.split()[0] for c in schemas.PLAYLIST_INFO.split(", ")]
    have = {c.strip().lower(): c for c in rows.columns}
    cols = [F.col(f"`{have[n]}`").cast("string").alias(n) if n in have else F.lit(None if n == "listname" else "").cast("string").alias(n) for n in names]
    rows = rows.select(*cols).where("glid IS NOT NULL AND glid <> ''").withColumn("__at", F.monotonically_increasing_id())
    last = rows.groupBy("glid").agg(F.max_by(F.struct(*names[1:]), "__at").alias("x"))
    return last.select("glid", "x.listname", *[F.coalesce(f"x.{n}", F.lit("")).alias(n) for n in names[2:]])


def song_info(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Lines with fewer than three fields or an empty id are left out; fields are trimmed."""
    rows = _fields(spark, path, sep).where("size(f) >= 3")
    return rows.select(*[X.strip(F.col("f")[i]).alias(n) for i, n in enumerate(("song_id", "name", "singer"))]).where("song_id <> ''")


def song_vectors(spark: SparkSession, path: str, dim: int, sep: str = ",", header: bool = False, limit: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """Lines whose numbers aren't ``dim`` in number or don't parse are left out (a header among them). ``only`` keeps the
    ids of a (small or large) table while scanning; ``limit`` takes that many lines."""
    rows = _fields(spark, path, sep)
    if limit is not None:
        rows = rows.limit(limit)
    v = F.transform(F.slice("f", 2, 1 << 20), lambda x: X.strip(x).try_cast("double"))
    out = rows.select(F.col("f")[0].alias("song_id"), v.alias("v")).where((F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull()))
    if header:
        out = out.where("song_id NOT IN ('mixsongid', 'song_id')")
    return out.join(only.select("song_id"), "song_id", "left_semi") if only is not None else out


def semantic_ids(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(song_id, semantic_ids) of the valid lines, and one row with the number of lines that aren't: broken JSON, a key
    missing, or not a list of three whole numbers."""
    raw = spark.read.text(path).where("trim(value) <> ''")
    parsed = raw.select(F.from_json("value", schemas.SEMANTIC_IDS, {"mode": "PERMISSIVE"}).alias("x"))
    fits = F.coalesce((F.size("x.semantic_ids") == 3) & F.col("x.song_id").isNotNull() & ~F.exists("x.semantic_ids", lambda i: i.isNull()), F.lit(False))
    return parsed.where(fits).select("x.*"), parsed.agg(F.count_if(~fits).alias("rejected"))


def first_level_index(ids: DataFrame) -> DataFrame:
    """(l1, songs): how many songs each first level has."""
    return ids.groupBy(F.col("semantic_ids")[0].alias("l1")).agg(F.count("*").alias("songs"))


def first_level_songs(ids: DataFrame) -> DataFrame:
    """(l1, song_id): the songs of each first level, as rows, since a level may hold any number of them."""
    return ids.select(F.col("semantic_ids")[0].alias("l1"), "song_id")


def votes(spark: SparkSession, path: str) -> DataFrame:
    """``query<TAB>song:vote,...``; a line without exactly two fields and malformed elements are left out."""
    rows = _fields(spark, path, "\t").where("size(f) = 2")
    return rows.select(F.col("f")[0].alias("query"), X.vote_items(F.col("f")[1]).alias("songs"))


def query_vote(spark: SparkSession, path: str, encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """CSV with a header; the first encoding in which no character is lost is taken. Rows without query or songs are left
    out; a field without anything is null, a quoted one may be empty or hold line ends. Reading GBK needs Spark's Java charsets, which this
    switches on for the session."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    for e in encodings:
        rows = spark.read.option("header", True).option("encoding", "utf-8" if e == "utf-8-sig" else e).option("nullValue", NOTHING).option("emptyValue", "").option("multiLine", True).csv(path)
        cols = {c.strip().lstrip("﻿").lower(): c for c in rows.columns}
        if not {"query", "song_infos"} <= set(cols):
            continue
        if rows.where(F.col(f"`{cols['query']}`").contains("�")).limit(1).count() == 0:
            named = [X.strip(F.col(f"`{cols[n]}`")).alias(n) if n in cols else F.lit(None).cast("string").alias(n) for n in ("query", "song_infos", "search_pv", "cnt")]
            return rows.select(*named).where("query IS NOT NULL AND song_infos IS NOT NULL")
    raise ValueError("no encoding fits, or query and song_infos are missing")


def corpus_text(spark: SparkSession, path: str) -> DataFrame:
    """One playlist per line, songs apart by white space."""
    return spark.read.text(path).where("trim(value) <> ''").select(F.split(F.trim("value"), r"\s+").alias("songs"))


def corpus_rows(spark: SparkSession, path: str) -> DataFrame:
    """Lines of exactly three fields."""
    rows = _fields(spark, path, "\t").where("size(f) = 3")
    return rows.select(*[F.col("f")[i].alias(n) for i, n in enumerate(("glid", "input_text", "output_sequence"))])


def ranking_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("sep", "\t").option("quote", "").schema(schemas.RANKING_PAIRS).csv(path)
