"""Queries of pair mining, extraction SQL, clustering fits, ranking and scoring."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tunefold.config import HierarchyConfig
from tunefold.functions import soft_dtw as D
from tunefold.functions import text as X
from tunefold.operators import clustering as C
from tunefold.operators import evaluation as E
from tunefold.operators import playlists as P
from tunefold.operators import ranking as K
from tunefold.operators.pair_ranker import PairRanker
from tunefold.plans.playlist_queries import BASE, _t, ids, info, rows
from tunefold.plans.semantic_queries import DIM, points

SMALL = HierarchyConfig(layer_clusters=(4, 8, 8), need_clusters=(4, 4, 4), embedding_dim=DIM, group_dims=(DIM,), iter_limit=10)

# The extraction statements: the same text runs here and in the checks.
_LISTS = "(SELECT DISTINCT glid FROM gen_playlist_info WHERE collect_type IN ('1', '2') OR feat = '1')"
_SELECTED = "(SELECT song_id FROM gen_song_info WHERE length(singer) > 12 UNION SELECT song_id FROM semantic_ids WHERE semantic_ids IS NOT NULL)"
STATEMENTS = {
    "sql_songs_cte": f"""WITH lists AS {_LISTS}, used AS (SELECT DISTINCT m.song_id FROM gen_playlist_song m JOIN lists l ON m.playlist_id = l.glid WHERE m.dt >= '2026-03-10')
        SELECT s.song_id, s.name, s.singer FROM gen_song_info s JOIN used u ON s.song_id = u.song_id""",
    "sql_songs_union": f"SELECT s.song_id, s.name, s.singer FROM gen_song_info s JOIN {_SELECTED} x ON s.song_id = x.song_id",
    "sql_playlist_song": f"SELECT l.glid, m.song_id FROM gen_playlist_song m JOIN {_LISTS} l ON m.playlist_id = l.glid WHERE m.dt >= '2026-03-10' ORDER BY l.glid",
    "sql_playlist_song_union": f"SELECT m.playlist_id, m.song_id FROM gen_playlist_song m JOIN {_SELECTED} x ON m.song_id = x.song_id WHERE m.dt >= '2026-03-10' ORDER BY m.playlist_id",
    "sql_playlist_semi": f"""SELECT i.glid, i.listname, i.nickname, i.tag_list, i.feat, i.collect_type, i.play_count FROM gen_playlist_info i
        JOIN (SELECT DISTINCT m.playlist_id FROM gen_playlist_song m JOIN {_SELECTED} x ON m.song_id = x.song_id) p ON i.glid = p.playlist_id""",
}
VIEWS = ("gen_playlist_info", "gen_playlist_song", "gen_song_info", "semantic_ids")


def _statement(name: str):
    def run(s, d):
        return s.sql(_with_tables(STATEMENTS[name], d))

    run.__name__ = name
    return run


def _with_tables(text: str, d: str) -> str:
    for v in VIEWS:
        for word in ("FROM", "JOIN"):
            text = text.replace(f"{word} {v} ", f"{word} parquet.`{d}/{v}.parquet` ")
    return text


def hard_negatives(s, d):
    return K.hard_negatives(K.positives(rows(s, d), info(s, d)), ids(s, d), 2)


def ranker_pairs(s, d):
    """Pairs by playlist: how many positives and negatives."""
    p = K.pairs(rows(s, d), info(s, d), ids(s, d), 1)
    return p.groupBy("playlist_id").agg(F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"))


def random_negative_check(s, d):
    """Negatives that stand in their own playlist: none."""
    p = K.pairs(rows(s, d), info(s, d), ids(s, d), 1)
    bad = p.where("label = 0").join(p.where("label = 1").select("playlist_id", "song_id"), ["playlist_id", "song_id"], "left_semi")
    return bad.agg(F.count("*").alias("inside"))


def missing_vectors(s, d):
    """Songs of pairs without a vector, which get zeros."""
    v = _t(s, d, "song_vectors").where("size(v) = 512").select("song_id", F.col("v").cast("array<double>").alias("v")).dropDuplicates(["song_id"])
    p = rows(s, d).select("song_id").distinct()
    z = K.with_vectors(p, v, 512)
    return z.groupBy(F.forall("v", lambda x: x == 0).alias("zeros")).agg(F.count("*").alias("songs"))


def kmeans_balanced(s, d):
    """Cluster sizes of the balanced hierarchy's first level by label."""
    out, _, _ = C.fit_hierarchy(points(s, d).select("song_id", "v"), SMALL)
    return out.groupBy("l1").agg(F.count("*").alias("songs"))


def hierarchy_ids(s, d):
    return C.fit_hierarchy(points(s, d).select("song_id", "v"), SMALL)[0]


def hierarchy_predict(s, d):
    """Share of songs whose predicted id equals the fitted one."""
    p = points(s, d).select("song_id", "v")
    fitted, centers, allowed = C.fit_hierarchy(p, SMALL)
    again = C.predict(p, centers, allowed, SMALL)
    return fitted.join(again.select("song_id", *[F.col(c).alias(f"p{c}") for c in ("l1", "l2", "l3")]), "song_id").agg(F.count("*").alias("songs"), F.count_if((F.col("l1") == F.col("pl1")) & (F.col("l2") == F.col("pl2")) & (F.col("l3") == F.col("pl3"))).alias("same"))


def stream_scoring(s, d):
    _, centers, allowed = C.fit_hierarchy(points(s, d).select("song_id", "v"), SMALL)
    return _scored(s, d, centers, allowed)


def _scored(s, d, centers, allowed):
    from tunefold.streaming.scoring import score_available

    path = f"{d}/embeddings.parquet"
    whole = os.path.isdir(path)
    reader = s.readStream.schema(_t(s, d, "embeddings").schema)
    stream = reader.parquet(path) if whole else reader.option("pathGlobFilter", "embeddings.parquet").parquet(d)
    stream = stream.select(F.col("vec_id").cast("string").alias("song_id"), F.col("embedding").cast("array<double>").alias("v"))
    return score_available(stream, centers, allowed, SMALL)


def stream_check(s, d):
    """Songs scored as a stream, and how many of them get the id that a table gives."""
    _, centers, allowed = C.fit_hierarchy(points(s, d).select("song_id", "v"), SMALL)
    table = C.predict(points(s, d).select("song_id", "v"), centers, allowed, SMALL)
    both = _scored(s, d, centers, allowed).join(table.select("song_id", *[F.col(c).alias(f"t{c}") for c in ("l1", "l2", "l3")]), "song_id", "left")
    return both.agg(F.count("*").alias("songs"), F.count_if((F.col("l1") == F.col("tl1")) & (F.col("l2") == F.col("tl2")) & (F.col("l3") == F.col("tl3"))).alias("same"))


def hierarchy_check(s, d):
    """What every fitted hierarchy keeps: each song once, all levels in range, no more slots in a group than needed."""
    out, centers, allowed = C.fit_hierarchy(points(s, d).select("song_id", "v"), SMALL)
    need = SMALL.need_clusters
    kept = out.agg(
        F.count("*").alias("songs"), F.count_distinct("song_id").alias("distinct_songs"),
        *[F.count_if((F.col(f"l{i + 1}") < 0) | (F.col(f"l{i + 1}") >= need[i])).alias(f"outside_{i + 1}") for i in range(3)],
    )
    groups = allowed.groupBy("l1", "l2").agg(F.count("*").alias("n"), F.count_distinct("candidate").alias("m"))
    wide = groups.agg(F.count_if((F.col("n") > need[2]) | (F.col("n") != F.col("m"))).alias("wide_groups"))
    layers = centers.groupBy("layer", "parent").agg(F.count("*").alias("n"))
    many = layers.agg(F.count_if(F.col("n") > F.when(F.col("layer") == 1, need[0]).when(F.col("layer") == 2, need[1]).otherwise(2 * SMALL.layer_clusters[2])).alias("wide_layers"))
    return kept.join(wide).join(many)


def balance_check(s, d):
    """A balanced assignment: every vector once, no cluster above its share."""
    import numpy as np
    import pandas as pd

    def run(f):
        x = np.stack(f["v"].to_numpy()).astype("f8")
        a = C.auction(-C.distances(x, C.kmeans(x, 8, 10, balanced=True)))
        n = np.bincount(a, minlength=8)
        return pd.DataFrame({"vectors": [len(x)], "clusters": [int((n > 0).sum())], "over": [int((n > -(-len(x) // 8)).sum())]})

    return points(s, d).groupBy().applyInPandas(run, "vectors long, clusters long, over long")


def quantization_check(s, d):
    """Songs of each level of the plain quantization, and slots outside the codebook."""
    out = C.residual_quantization(points(s, d).select("song_id", "v"), DIM, [8, 8, 8])
    return out.groupBy("level").agg(F.count("*").alias("songs"), F.count_distinct("song_id").alias("distinct_songs"), F.count_if((F.col("slot") < 0) | (F.col("slot") >= 8)).alias("outside"))


def residual_quantization(s, d):
    return C.residual_quantization(points(s, d).select("song_id", "v"), DIM, [8, 8, 8])


def soft_dtw_pairs(s, d):
    """Soft-DTW of every twentieth vector with the first one."""
    p = points(s, d)
    one = p.where("vec_id = 0").select(F.col("v").alias("w"))
    q = p.where("vec_id % 20 = 0").join(F.broadcast(one), F.lit(True))
    return q.select("vec_id", F.round(D.distance(F.col("v"), F.col("w")), 6).alias("distance"), F.round(D.distance(F.col("v"), F.col("w"), normalize=True), 6).alias("normalized"))


def plane(s, d):
    """Vectors on their two principal axes, by MLlib."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    p = points(s, d).select("vec_id", array_to_vector("v").alias("x"))
    out = PCA(k=2, inputCol="x", outputCol="y").fit(p).transform(p).withColumn("y", vector_to_array("y"))
    return out.select("vec_id", F.col("y")[0].alias("first"), F.col("y")[1].alias("second"))


def word_vectors(s, d):
    return K.skip_gram_vectors(P.as_lists(rows(s, d), 10, 300), 16)


def generated_candidates(s, d):
    c = _t(s, d, "generator_corpus")
    g = K.OverlapGenerator(c.where("split = 'train'").select(F.col("input_text").alias("text"), X.triples("output_sequence").alias("triples")))
    return g.generate(c.where("split = 'test'").select(F.col("rec_id").alias("key"), F.col("input_text").alias("text")))


def ranker_metrics(s, d):
    """Held-out accuracy, precision, recall and F1 of the baseline ranker: nine of ten pairs train, by hash."""
    v = _t(s, d, "song_vectors").where("size(v) = 512").select("song_id", "v").where(~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    ranker = PairRanker(rows(s, d), info(s, d), ids(s, d), v, 512, features=1 << 10)
    return E.binary_metrics(ranker.fit().held_out())


QUERIES = {
    f.__name__: f
    for f in (
        *map(_statement, STATEMENTS), hard_negatives, ranker_pairs, random_negative_check, missing_vectors, kmeans_balanced, hierarchy_ids, hierarchy_predict, stream_scoring,
        stream_check, hierarchy_check, balance_check, quantization_check, residual_quantization, soft_dtw_pairs, plane, word_vectors, generated_candidates, ranker_metrics,
    )
}

_POS = ", pos AS (SELECT DISTINCT p.playlist_id, i.listname AS text, p.song_id FROM ps p JOIN info i ON i.glid = p.playlist_id WHERE i.listname IS NOT NULL AND i.listname <> '')"

SQL = {
    **{k: " ".join(v.split()) for k, v in STATEMENTS.items()},
    "hard_negatives": BASE
    + _POS
    + """, dr AS (SELECT pos.playlist_id, pos.text, pos.song_id, b.song_id AS negative FROM pos JOIN sid a ON a.song_id = pos.song_id JOIN sid b ON a.l1 = b.l1 AND a.l2 = b.l2 AND a.l3 = b.l3 AND b.song_id <> a.song_id),
        fr AS (SELECT * FROM dr WHERE NOT EXISTS (SELECT 1 FROM pos q WHERE q.playlist_id = dr.playlist_id AND q.song_id = dr.negative))
        SELECT playlist_id, text, song_id, negative FROM (SELECT *, row_number() OVER (PARTITION BY playlist_id, song_id ORDER BY md5(playlist_id || '|' || song_id || '|' || negative), negative) AS r FROM fr) WHERE r <= 2""",
    "ranker_pairs": BASE + _POS + " SELECT playlist_id, count(*) AS positives, count(s.song_id) AS negatives FROM pos LEFT JOIN sid s USING (song_id) GROUP BY playlist_id",
    "random_negative_check": "SELECT 0 AS inside",
    "hierarchy_predict": "SELECT count(*) AS songs, count(*) AS same FROM embeddings",
    "stream_check": "SELECT count(*) AS songs, count(*) AS same FROM embeddings",
    "hierarchy_check": "SELECT count(*) AS songs, count(DISTINCT vec_id) AS distinct_songs, 0 AS outside_1, 0 AS outside_2, 0 AS outside_3, 0 AS wide_groups, 0 AS wide_layers FROM embeddings",
    "balance_check": "SELECT count(*) AS vectors, 8 AS clusters, 0 AS over FROM embeddings",
    "quantization_check": "SELECT unnest([0, 1, 2]) AS level, count(*) AS songs, count(DISTINCT vec_id) AS distinct_songs, 0 AS outside FROM embeddings",
    "generated_candidates": BASE
    + r""", words AS (SELECT DISTINCT rec_id, split, word FROM (SELECT rec_id, split, unnest(regexp_split_to_array(lower(input_text), '\s+')) AS word FROM generator_corpus)),
        counted AS (SELECT word, l1, l2, l3, count(*) AS n FROM words JOIN tri USING (rec_id) WHERE split = 'train' AND word <> '' GROUP BY ALL),
        summed AS (SELECT w.rec_id, l1, l2, l3, sum(n) AS n FROM words w JOIN counted c ON w.word = c.word WHERE w.split = 'test' GROUP BY ALL),
        placed AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY n DESC, l1, l2, l3) - 1 AS place FROM summed)
        SELECT rec_id AS key, place, l1, l2, l3 FROM placed WHERE place < 20""",
    "missing_vectors": BASE
    + """, v AS (SELECT DISTINCT ON (song_id) song_id, v FROM song_vectors WHERE len(v) = 512), u AS (SELECT DISTINCT song_id FROM ps)
        SELECT coalesce(len(list_filter(v, lambda x: x IS NULL OR x <> 0)) = 0, true) AS zeros, count(*) AS songs FROM u LEFT JOIN v USING (song_id) GROUP BY 1""",
}
