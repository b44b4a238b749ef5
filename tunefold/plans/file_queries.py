"""Round trips through the file formats: a table is written in its native format to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunefold import shared
from tunefold.config import HierarchyConfig
from tunefold.functions import text as X
from tunefold.operators import playlists as P
from tunefold.operators import ranking as K
from tunefold.plans.playlist_queries import BASE, _strip, _t, ids, info, matched, rows
from tunefold.plans.semantic_queries import points
from tunefold.sources import index_cache, readers, sinks

SEVERAL = 500_000


def _lines(df, path: str, *columns: str) -> None:
    df.select(F.concat_ws("\t", *[F.coalesce(c, F.lit("")) for c in columns]).alias("value")).write.text(path)


def file_playlist_song(s, d):
    path = shared.new_path(s, "file-playlist-song")
    _lines(rows(s, d), path, "playlist_id", "song_id")
    return readers.playlist_song(s, path).groupBy("playlist_id", "song_id").agg(F.count("*").alias("n"))


def file_playlist_sets(s, d):
    """The comma format with a header, as sets."""
    path = shared.new_path(s, "file-playlist-sets")
    rows(s, d).select("playlist_id", "song_id").write.option("header", True).csv(path)
    return P.as_sets(readers.playlist_song(s, path, ",", True))


def file_playlist_info(s, d):
    """Written without its tags, which hold line ends; they come back empty."""
    path = shared.new_path(s, "file-playlist-info")
    last = _t(s, d, "gen_playlist_info").where("glid IS NOT NULL AND glid <> ''").groupBy("glid")
    names = ["listname", "nickname", "tag_list", "feat", "collect_type", "play_count", "description", "creator"]
    kept = last.agg(F.max_by(F.struct(*names), F.struct("updated_at", "row_id")).alias("x")).select("glid", "x.*")
    sinks.tab_separated(kept, path, header=True)
    return readers.playlist_info(s, path)


def file_song_info(s, d):
    path = shared.new_path(s, "file-song-info")
    _lines(_t(s, d, "gen_song_info"), path, "song_id", "name", "singer")
    return readers.song_info(s, path)


def _usable(s, d):
    v = _t(s, d, "song_vectors").where("size(v) = 512 AND NOT exists(v, x -> x IS NULL OR isnan(x))")
    return v.select(X.strip("song_id").alias("song_id"), "v").where("song_id <> ''").dropDuplicates(["song_id"])


def file_song_vectors(s, d):
    """Written by falling frequency, read back for the songs of the rows only."""
    path = shared.new_path(s, "file-song-vectors")
    own = rows(s, d)
    sinks.vectors_csv(_usable(s, d), path, own.groupBy("song_id").agg(F.count("*").alias("n")))
    got = readers.song_vectors(s, path, 512, only=own.select("song_id").distinct())
    return got.select("song_id", F.size("v").alias("width"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


def file_semantic_ids(s, d):
    path = shared.new_path(s, "file-semantic-ids")
    sinks.semantic_ids(ids(s, d), path)
    got = readers.semantic_ids(s, path)[0]
    return got.select("song_id", *[F.col("semantic_ids")[i].alias(f"l{i + 1}") for i in range(3)])


def file_rejected_ids(s, d):
    """Lines of the unfiltered table that aren't valid, and those that are."""
    path = shared.new_path(s, "file-rejected-ids")
    _t(s, d, "semantic_ids").select("song_id", "semantic_ids").write.option("ignoreNullFields", False).json(path)
    good, bad = readers.semantic_ids(s, path)
    return bad.join(good.agg(F.count("*").alias("valid")))


def file_first_level(s, d):
    """The songs of each first level: how many, and the first and last of them."""
    path = shared.new_path(s, "file-first-level")
    sinks.semantic_ids(ids(s, d), path)
    got = readers.first_level_songs(readers.semantic_ids(s, path)[0])
    return got.groupBy("l1").agg(F.count("*").alias("songs"), F.min("song_id").alias("first"), F.max("song_id").alias("last"))


def file_votes(s, d):
    path = shared.new_path(s, "file-votes")
    v = _t(s, d, "query_vote").where("query IS NOT NULL AND song_infos IS NOT NULL")
    _lines(v.select("query", F.replace("song_infos", F.lit("@@"), F.lit(",")).alias("songs")), path, "query", "songs")
    got = readers.votes(s, path).select("query", F.explode("songs").alias("x"))
    return got.groupBy("query", "x.song_id", "x.vote").agg(F.count("*").alias("n"))


def file_query_vote(s, d):
    path = shared.new_path(s, "file-query-vote")
    _t(s, d, "query_vote").select("query", "song_infos", "search_pv", "cnt").write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.query_vote(s, path)


def file_corpus_text(s, d):
    """Corpus lines, read back as lists of terms."""
    path = shared.new_path(s, "file-corpus-text")
    P.as_lists(rows(s, d), 10, 300).select(F.array_join("songs", " ").alias("value")).write.text(path)
    return readers.corpus_text(s, path).groupBy(F.array_join("songs", " ").alias("line")).agg(F.count("*").alias("n"))


def file_corpus_lines(s, d):
    """Lines and ids stay together."""
    path = shared.new_path(s, "file-corpus-lines")
    sinks.corpus_text(P.as_lists(rows(s, d), 10, 300), path)
    return s.read.option("sep", "\t").option("quote", "").schema("playlist_id string, line string").csv(path)


def file_corpus_rows(s, d):
    path = shared.new_path(s, "file-corpus-rows")
    c = _t(s, d, "generator_corpus").where("output_sequence <> ''")
    sinks.splits(c.select("glid", F.col("input_text").alias("title"), "output_sequence", "split"), path)
    return readers.corpus_rows(s, path).groupBy("glid", "input_text").agg(F.count("*").alias("n"), F.sum(F.length("output_sequence")).alias("characters"))


def file_ranking_pairs(s, d):
    path = shared.new_path(s, "file-ranking-pairs")
    sinks.pairs(K.positives(rows(s, d), info(s, d)).select("text", "song_id", F.lit(1).alias("label")), path)
    return readers.ranking_pairs(s, path).groupBy("text", "label").agg(F.count("*").alias("songs"))


def file_frequency(s, d):
    """The exports of the keyword analysis, read back and joined."""
    path = shared.new_path(s, "file-frequency")
    own = rows(s, d).join(matched(s, d).select(F.col("glid").alias("playlist_id")), "playlist_id", "left_semi")
    sinks.frequency_csv(P.song_frequency(rows(s, d), matched(s, d)), f"{path}/csv")
    sinks.song_playlists_json(own, f"{path}/json")
    table = s.read.option("header", True).schema("song_id string, occurrences long, playlists long").csv(f"{path}/csv")
    lists = s.read.schema("song_id string, n long, playlists array<string>").json(f"{path}/json")
    return table.join(lists.select("song_id", F.col("playlists")[0].alias("first")), "song_id")


def file_compact(s, d):
    """Many small Parquet outputs into few."""
    path = shared.new_path(s, "file-compact")
    c = _t(s, d, "generator_corpus").select("rec_id", "split")
    for i in range(3):
        c.where(F.pmod(F.xxhash64("rec_id"), F.lit(3)) == i).repartition(4).write.parquet(f"{path}/chunk{i}")
    sinks.compact(s, [f"{path}/chunk{i}" for i in range(3)], f"{path}/whole")
    return s.read.parquet(f"{path}/whole").groupBy("split").agg(F.count("*").alias("records"), F.count_distinct("rec_id").alias("ids"))


def file_summary(s, d):
    """A one-row result as a JSON document."""
    path = shared.new_path(s, "file-summary")
    sinks.summary(rows(s, d).agg(F.count("*").alias("rows"), F.count_distinct("song_id").alias("songs")), path)
    return s.read.schema("rows long, songs long").json(path)


def file_checkpoints(s, d):
    """Two layers of three saved, read back, and what the folder says."""
    held = sinks.Checkpoints(s, shared.new_path(s, "file-checkpoints"))
    p = points(s, d).select("song_id", "v")
    for layer in range(2):
        held.save(layer, p)
    status = held.status(3)
    out = held.load(1).agg(F.count("*").alias("songs"))
    return out.select("songs", F.lit(held.last()).cast("int").alias("last"), F.lit(status["done"]).cast("int").alias("done"), F.lit(status["finished"]).alias("finished"))


def file_model(s, d):
    """A model's configuration and tables, saved and loaded."""
    path = shared.new_path(s, "file-model")
    config = HierarchyConfig(layer_clusters=(4, 8, 8), need_clusters=(4, 4, 4), embedding_dim=64, group_dims=(32, 32), hierarchical_weights=((0.5, 0.5), (0.3, 0.7), (0.9, 0.1)))
    centers = points(s, d).select(F.lit(1).alias("layer"), F.lit(0).alias("parent"), F.col("vec_id").cast("int").alias("slot"), F.col("v").alias("center"))
    allowed = ids(s, d).select("l1", "l2", F.col("l3").alias("candidate"), F.lit(0).alias("slot"))
    sinks.save_model(s, path, config, centers, allowed)
    again, c, a = sinks.load_model(s, path)
    same = F.lit(again == config).alias("same_config")
    return c.agg(F.count("*").alias("centers")).join(a.agg(F.count("*").alias("allowed"))).withColumn("same_config", same)


def file_index_cache(s, d):
    """Unit vectors built once and read again."""
    folder = shared.new_path(s, "file-index-cache")
    source = f"{d}/song_vectors.parquet"
    own = _one_each(s, d)
    built = [index_cache.unit_vectors(s, source, own, folder) for _ in range(2)]
    counts = built[1][0].mapInArrow(_count_units, "songs long, unit long").agg(F.coalesce(F.sum("songs"), F.lit(0)).alias("songs"), F.coalesce(F.sum("unit"), F.lit(0)).alias("unit"))
    return counts.select(F.lit(built[0][1]).alias("built"), F.lit(built[1][1]).alias("built_again"), "songs", "unit")


def _whole_vectors(batches):
    """Of rows (song_id, v) those with an id and 512 numbers."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        v = b.column(1)
        values, ends = v.values, v.offsets.to_numpy()
        bad = values.is_null().to_numpy(zero_copy_only=False) | np.isnan(values.to_numpy(zero_copy_only=False).astype("f4"))
        before = np.r_[0, np.cumsum(bad)]
        good = ~v.is_null().to_numpy(zero_copy_only=False) & (np.diff(ends) == 512) & (before[ends[1:]] == before[ends[:-1]])
        yield b.filter(pa.array(good))


def _one_each(s, d):
    """Usable vectors, one for each song; only songs with several rows are compared."""
    v = _t(s, d, "song_vectors").select(X.strip("song_id").alias("song_id"), F.col("v").cast("array<float>").alias("v")).where("song_id <> ''")
    v = v.mapInArrow(_whole_vectors, "song_id string, v array<float>")
    v = shared.materialise(v, "whole-vectors")
    several = shared.materialise(v.groupBy("song_id").agg(F.count("*").alias("n")).where("n > 1").select("song_id"), "repeated-songs")
    if several.count() <= SEVERAL:  # then the vectors of all other songs stay where they are
        several = F.broadcast(several)
    return v.join(several, "song_id", "left_anti").unionByName(v.join(several, "song_id", "left_semi").dropDuplicates(["song_id"]))


def _count_units(batches):
    import numpy as np
    import pyarrow as pa

    for b in batches:
        v = b.column(1)
        squares = np.r_[0.0, np.square(v.values.to_numpy(zero_copy_only=False))]
        at = v.offsets.to_numpy()
        sums = [float(squares[lo + 1 : hi + 1].sum()) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.record_batch([pa.array([len(v)], pa.int64()), pa.array([int((np.abs(np.array(sums) - 1) < 1e-6).sum())], pa.int64())], names=["songs", "unit"])


QUERIES = {
    f.__name__: f
    for f in (
        file_playlist_song, file_playlist_sets, file_playlist_info, file_song_info, file_song_vectors, file_semantic_ids, file_rejected_ids, file_first_level, file_votes, file_query_vote,
        file_corpus_text, file_corpus_lines, file_corpus_rows, file_ranking_pairs, file_frequency, file_compact, file_summary, file_checkpoints, file_model, file_index_cache,
    )
}

_LIST = "SELECT playlist_id, string_agg(song_id, ' ' ORDER BY pos, song_id) AS line FROM ps GROUP BY playlist_id HAVING count(*) BETWEEN 10 AND 300"
_VECTORS = f"""(SELECT DISTINCT ON (s) s, v FROM (SELECT {_strip("song_id")} AS s, CAST(v AS DOUBLE[]) AS v FROM song_vectors)
    WHERE s <> '' AND len(v) = 512 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x))) = 0)"""

SQL = {
    "file_playlist_song": BASE + "SELECT playlist_id, song_id, count(*) AS n FROM ps GROUP BY playlist_id, song_id",
    "file_playlist_sets": BASE + "SELECT playlist_id, count(*) AS n, count(DISTINCT song_id) AS distinct_songs FROM ps GROUP BY playlist_id",
    "file_playlist_info": """SELECT glid, nullif(listname, '') AS listname, coalesce(nickname, '') AS nickname, coalesce(tag_list, '') AS tag_list, coalesce(feat, '') AS feat,
        coalesce(collect_type, '') AS collect_type, coalesce(play_count, '') AS play_count, coalesce(description, '') AS description, coalesce(creator, '') AS creator, '' AS tags
        FROM (SELECT *, row_number() OVER (PARTITION BY glid ORDER BY updated_at DESC, row_id DESC) AS r FROM gen_playlist_info WHERE glid IS NOT NULL AND glid <> '') WHERE r = 1""",
    "file_song_info": f"""SELECT {_strip("song_id")} AS song_id, coalesce({_strip("name")}, '') AS name, coalesce({_strip("singer")}, '') AS singer FROM gen_song_info
        WHERE song_id IS NOT NULL AND {_strip("song_id")} <> ''""",
    "file_song_vectors": BASE + f"SELECT s AS song_id, 512 AS width, round(list_sum(v), 2) AS total FROM {_VECTORS} WHERE s IN (SELECT song_id FROM ps)",
    "file_semantic_ids": BASE + "SELECT song_id, l1, l2, l3 FROM sid",
    "file_rejected_ids": """SELECT count(*) FILTER (NOT good) AS rejected, count(*) FILTER (good) AS valid
        FROM (SELECT coalesce(song_id IS NOT NULL AND len(semantic_ids) = 3 AND len(list_filter(semantic_ids, lambda x: x IS NULL)) = 0, false) AS good FROM semantic_ids)""",
    "file_first_level": BASE + "SELECT l1, count(*) AS songs, min(song_id) AS first, max(song_id) AS last FROM sid GROUP BY l1",
    "file_votes": rf"""
        WITH a AS (SELECT query, string_split(replace(song_infos, '@@', ','), ',') AS items FROM query_vote WHERE query IS NOT NULL AND song_infos IS NOT NULL),
        b AS (SELECT query, string_split(items[i], ':') AS p FROM (SELECT query, items, unnest(range(1, len(items) + 1)) AS i FROM a)),
        c AS (SELECT query, {_strip("p[1]")} AS song_id, TRY_CAST({_strip("p[2]")} AS INTEGER) AS vote FROM b WHERE len(p) = 2)
        SELECT query, song_id, vote, count(*) AS n FROM c WHERE vote IS NOT NULL GROUP BY query, song_id, vote""",
    "file_query_vote": f"""SELECT {_strip("query")} AS query, {_strip("song_infos")} AS song_infos, {_strip("search_pv")} AS search_pv, {_strip("cnt")} AS cnt
        FROM query_vote WHERE query IS NOT NULL AND song_infos IS NOT NULL""",
    "file_corpus_text": BASE + f"SELECT line, count(*) AS n FROM ({_LIST}) GROUP BY line",
    "file_corpus_lines": BASE + _LIST,
    "file_corpus_rows": """SELECT coalesce(glid, '') AS glid, coalesce(input_text, '') AS input_text, count(*) AS n, sum(length(output_sequence)) AS characters
        FROM generator_corpus WHERE output_sequence <> '' GROUP BY 1, 2""",
    "file_ranking_pairs": BASE
    + """, pos AS (SELECT DISTINCT p.playlist_id, i.listname AS text, p.song_id FROM ps p JOIN info i ON i.glid = p.playlist_id WHERE i.listname IS NOT NULL AND i.listname <> '')
         SELECT text, 1 AS label, count(*) AS songs FROM pos GROUP BY text""",
    "file_frequency": BASE + "SELECT song_id, occurrences, playlists, (SELECT min(playlist_id) FROM ps WHERE ps.song_id = freq.song_id AND playlist_id IN (SELECT glid FROM hit)) AS first FROM freq",
    "file_compact": "SELECT split, count(*) AS records, count(DISTINCT rec_id) AS ids FROM generator_corpus GROUP BY split",
    "file_summary": BASE + "SELECT count(*) AS rows, count(DISTINCT song_id) AS songs FROM ps",
    "file_checkpoints": "SELECT count(*) AS songs, 1 AS last, 2 AS done, false AS finished FROM embeddings",
    "file_model": BASE + "SELECT (SELECT count(*) FROM embeddings) AS centers, count(*) AS allowed, true AS same_config FROM sid",
    "file_index_cache": f"SELECT true AS built, false AS built_again, count(*) AS songs, count(*) FILTER (list_sum(list_transform(v, lambda x: abs(x))) > 0) AS unit FROM {_VECTORS}",
}
