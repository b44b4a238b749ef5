"""Queries over vectors and semantic ids, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunefold.functions import text as X
from tunefold.functions import vectors as V
from tunefold.operators import retrieval as R
from tunefold.operators import semantic_ids as S
from tunefold.operators.ordering import with_position
from tunefold.plans.playlist_queries import BASE, _t, ids, songs, votes

DIM = 64
CENTERS = 8


def points(s, d):
    return _t(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("song_id"), F.col("vec_id"), V.doubles("embedding").alias("v"), "label")


def first_centers(s, d):
    return points(s, d).where(F.col("vec_id") < CENTERS).select(F.col("vec_id").cast("int").alias("slot"), F.col("v").alias("center"))


def vector_normalize(s, d):
    v = points(s, d).select("vec_id", F.posexplode(V.normalized(F.transform("v", lambda x: x * 3 + 1))).alias("k", "x"))
    return v.groupBy("vec_id").agg(F.round(F.sum(F.col("x") * (F.col("k") + 1)), 6).alias("checksum"), F.round(F.sum(F.col("x") * F.col("x")), 6).alias("length"))


def _queries(s, d):
    return points(s, d).where("vec_id % 20 = 0")


def cosine_topk(s, d):
    q = _queries(s, d).select(F.col("song_id").alias("query"), "v", F.array("song_id").alias("skip"))
    return R.top_k(q, points(s, d), 10, DIM).withColumn("score", F.round("score", 6))


def euclidean_topk(s, d):
    q = _queries(s, d).select(F.col("song_id").alias("query"), "v", F.array("song_id").alias("skip"))
    return R.top_k(q, points(s, d), 5, DIM, "euclidean").select("query", "rank", "song_id", F.round(-F.col("score"), 6).alias("distance"))


def cosine_topk_exclude(s, d):
    """Songs that follow a query's number by one to three don't come out."""
    skip = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.col("vec_id") + i).cast("string"))
    q = _queries(s, d).select(F.col("song_id").alias("query"), "v", skip.alias("skip"))
    return R.top_k(q, points(s, d), 10, DIM).withColumn("score", F.round("score", 6))


def same_cluster_neighbors(s, d):
    p = points(s, d).withColumnRenamed("label", "cluster")
    q = p.where("vec_id % 20 = 0").select(F.col("song_id").alias("query"), "v", "cluster")
    return R.in_cluster(q, p.select("song_id", "v", "cluster"), 10, DIM).withColumn("score", F.round("score", 6))


def seed_centroid(s, d):
    """Centroid of the seeds of each event type among the vectors; checked element by element."""
    seeds = _t(s, d, "events").select(F.col("event_type").alias("query"), F.get_json_object("props", "$.k").alias("song_id")).distinct()
    c = R.seed_centroids(seeds, points(s, d).select("song_id", "v"))
    return c.select("query", F.posexplode("v").alias("k", "x")).withColumn("x", F.round("x", 6))


def seed_centroid_topk(s, d):
    seeds = _t(s, d, "events").select(F.col("event_type").alias("query"), F.get_json_object("props", "$.k").alias("song_id")).distinct()
    c = R.seed_centroids(seeds, points(s, d).select("song_id", "v"))
    skip = seeds.groupBy("query").agg(F.collect_set("song_id").alias("skip"))
    return R.top_k(c.join(skip, "query"), points(s, d), 20, DIM).withColumn("score", F.round("score", 6))


def query_seed_topk(s, d):
    """For each row of query_vote the songs nearest to the centroid of all its seeds (gear 0 or -1); the voted songs don't
    come out."""
    v = votes(s, d).select(F.col("row_id").cast("string").alias("query"), "song_id", "gear")
    vectors = _t(s, d, "song_vectors").where("size(v) = 512").select(F.trim("song_id").alias("song_id"), F.col("v").cast("array<double>").alias("v"))
    vectors = vectors.where("song_id <> '' AND NOT exists(v, x -> x IS NULL OR isnan(x)) AND exists(v, x -> x <> 0)").groupBy("song_id").agg(F.min("v").alias("v"))
    c = R.seed_centroids(v.where("gear IN (0, -1)").select("query", "song_id").distinct(), vectors)
    skip = v.groupBy("query").agg(F.collect_set("song_id").alias("skip"))
    return R.top_k(c.join(skip, "query"), vectors, 20, 512).withColumn("score", F.round("score", 6))


def nearest_center(s, d):
    return S.nearest_centers(points(s, d), first_centers(s, d)).select("vec_id", "slot", F.round("d", 6).alias("d"))


def masked_nearest_center(s, d):
    """Only centers of the point's own label: the first four songs of each label."""
    from pyspark.sql import Window

    c = points(s, d).withColumn("slot", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).where("slot < 4").select("label", "slot", F.col("v").alias("center"))
    return S.nearest_centers(points(s, d), c, ["label"]).select("vec_id", "label", "slot", F.round("d", 6).alias("d"))


def residual_norm(s, d):
    """Residuals against the nearest center, each of two groups of elements scaled to length one."""
    a = S.nearest_centers(points(s, d), first_centers(s, d)).join(F.broadcast(first_centers(s, d)), "slot")
    r = a.select("vec_id", F.posexplode(V.residual("v", "center", [32, 32])).alias("k", "x"))
    return r.groupBy("vec_id").agg(F.round(F.sum(F.col("x") * (F.col("k") + 1)), 5).alias("checksum"), F.round(F.sum(F.col("x") * F.col("x")), 5).alias("length"))


def overflow_loss(s, d):
    return S.overflow(S.nearest_centers(points(s, d), first_centers(s, d)), 50)


def center_update(s, d):
    return S.center_means(S.nearest_centers(points(s, d), first_centers(s, d))).withColumn("x", F.round("x", 6))


def collisions(s, d):
    return S.collisions(ids(s, d))


def collision_summary(s, d):
    return S.collision_summary(ids(s, d))


def id_coverage(s, d):
    return S.id_coverage(ids(s, d))


def layer_bincount_stats(s, d):
    return S.layer_stats(ids(s, d))


def combo_utilization(s, d):
    return S.combinations(ids(s, d))


def l3_per_combo(s, d):
    return S.thirds_per_pair(ids(s, d))


def songs_per_combo(s, d):
    return S.songs_per_pair(ids(s, d))


def id_multiplicity(s, d):
    return S.multiplicity(ids(s, d))


def smallest_combos(s, d):
    return S.smallest_pairs(ids(s, d))


def prefix_search(s, d):
    return S.with_prefix(ids(s, d), X.prefix("127,104"))


def trie_next_tokens(s, d):
    return S.next_tokens(ids(s, d))


def trie_stats(s, d):
    return S.trie_stats(ids(s, d))


def generated(s, d):
    t = _t(s, d, "generator_corpus").select(F.col("rec_id").alias("key"), F.posexplode(X.triples("output_sequence")).alias("place", "x"))
    return t.select("key", "place", "x.l1", "x.l2", "x.l3")


def generation_rank(s, d):
    return S.generated_counts(generated(s, d), ids(s, d))


def primary_and_similar(s, d):
    return S.recommendations(generated(s, d), ids(s, d))


def invalid_ids(s, d):
    """Ids of the corpus that no song with a vector has."""
    have = _t(s, d, "song_vectors").where("v IS NOT NULL").select(F.trim("song_id").alias("song_id"))
    return S.invalid(generated(s, d), ids(s, d).join(have, "song_id", "left_semi"))


def unknown_ids(s, d):
    """Ids of the corpus that no song has."""
    return S.invalid(generated(s, d), ids(s, d))


def constrained_mask(s, d):
    """What may follow the first tokens of every record: none, one, two or three levels of its first triple."""
    g = generated(s, d).where("place = 0").select("key", F.slice(F.array("l1", "l2", "l3"), F.lit(1), (F.col("key") % 4).cast("int")).alias("prefix"))
    a = S.allowed_next(g, ids(s, d), 128)
    return a.select("key", F.array_join("prefix", ",").alias("prefix"), F.array_join("allowed", ",").alias("allowed"))


def candidate_slots(s, d):
    allowed = ids(s, d).select("l1", "l2", F.col("l3").alias("candidate")).distinct()
    return S.candidate_slots(allowed)


def reverse_lookup(s, d):
    """Semantic id and names of every voted song."""
    v = votes(s, d).select("song_id").distinct().join(ids(s, d), "song_id", "left").join(songs(s, d), "song_id", "left")
    return v.select("song_id", "l1", "l2", "l3", F.coalesce("name", F.lit("N/A")).alias("name"))


def metric_sample(s, d):
    """A seeded sample of 300 vectors, and the vectors that go with it."""
    e = _t(s, d, "embeddings").select("vec_id", "label")
    return with_position(e, F.md5(F.concat(F.lit("42:"), F.col("vec_id").cast("string"))), "vec_id", name="place").where("place < 300").select("vec_id", "label")


def calinski_harabasz(s, d):
    from tunefold.operators import clustering as C

    return C.calinski_harabasz(points(s, d).select("label", "v"))


def davies_bouldin(s, d):
    from tunefold.operators import clustering as C

    return C.davies_bouldin(points(s, d).select("label", "v"))


def silhouette(s, d):
    from tunefold.operators import clustering as C

    return C.silhouette(points(s, d).select("song_id", "label", "v"), DIM)


QUERIES = {
    f.__name__: f
    for f in (
        vector_normalize, cosine_topk, euclidean_topk, cosine_topk_exclude, same_cluster_neighbors, seed_centroid, seed_centroid_topk, query_seed_topk, nearest_center, masked_nearest_center,
        residual_norm, overflow_loss, center_update, collisions, collision_summary, id_coverage, layer_bincount_stats, combo_utilization, l3_per_combo, songs_per_combo,
        id_multiplicity, smallest_combos, prefix_search, trie_next_tokens, trie_stats, generation_rank, primary_and_similar, invalid_ids, unknown_ids, constrained_mask, candidate_slots,
        reverse_lookup, metric_sample, calinski_harabasz, davies_bouldin, silhouette,
    )
}

_P = """WITH p AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    c AS (SELECT CAST(vec_id AS INTEGER) AS slot, v AS center FROM p WHERE vec_id < 8),
    a AS (SELECT vec_id, v, slot, d, center FROM (SELECT vec_id, v, slot, center, round(list_distance(v, center), 9) AS d, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_distance(v, center), 9), slot) AS r FROM p, c) WHERE r = 1)"""


def _top(where: str, k: int, score: str = "list_cosine_similarity(q.v, p.v)", order: str = "DESC", name: str = "score", sign: str = "") -> str:
    return f"""SELECT query, CAST(r AS INTEGER) AS rank, song_id, round(s, 6) AS {name} FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s {order}, song_id) AS r FROM
        (SELECT CAST(q.vec_id AS VARCHAR) AS query, CAST(p.vec_id AS VARCHAR) AS song_id, round({score}, 9) AS s FROM p q, p WHERE q.vec_id % 20 = 0 AND {where})) WHERE r <= {k}"""


_G = BASE + ", g AS (SELECT rec_id AS key, place, l1, l2, l3 FROM tri), known AS (SELECT DISTINCT l1, l2, l3 FROM sid)"
_SPREAD = "SELECT round(avg(n), 6) AS mean, min(n) AS least, max(n) AS most, median(n) AS median, round(stddev_pop(n), 6) AS std FROM"
_SEEDS = "seeds AS (SELECT DISTINCT event_type AS query, CAST(json_extract_string(props, '$.k') AS INTEGER) AS vec_id FROM events)"

SQL = {
    "vector_normalize": _P
    + """, w AS (SELECT vec_id, list_transform(v, lambda x: x * 3 + 1) AS u FROM p), n AS (SELECT vec_id, u, sqrt(list_sum(list_transform(u, lambda x: x * x))) AS l FROM w),
        e AS (SELECT vec_id, unnest(u) / l AS x, unnest(range(1, len(u) + 1)) AS k FROM n) SELECT vec_id, round(sum(x * k), 6) AS checksum, round(sum(x * x), 6) AS length FROM e GROUP BY vec_id""",
    "cosine_topk": _P + _top("p.vec_id <> q.vec_id", 10),
    "euclidean_topk": _P + _top("p.vec_id <> q.vec_id", 5, "list_distance(q.v, p.v)", "ASC", "distance"),
    "cosine_topk_exclude": _P + _top("p.vec_id NOT BETWEEN q.vec_id AND q.vec_id + 3", 10),
    "same_cluster_neighbors": _P + _top("p.vec_id <> q.vec_id AND p.label = q.label", 10),
    "seed_centroid": _P
    + ", "
    + _SEEDS
    + ", e AS (SELECT query, unnest(v) AS x, unnest(range(len(v))) AS k FROM seeds JOIN p USING (vec_id)) SELECT query, CAST(k AS INTEGER) AS k, round(avg(x), 6) AS x FROM e GROUP BY query, k",
    "seed_centroid_topk": _P
    + ", "
    + _SEEDS
    + """, sd AS (SELECT * FROM seeds), e AS (SELECT query, unnest(v) AS x, unnest(range(len(v))) AS k FROM sd JOIN p USING (vec_id)),
        m AS (SELECT query, k, avg(x) AS x FROM e GROUP BY query, k), cv AS (SELECT query, list(x ORDER BY k) AS v FROM m GROUP BY query)
        SELECT query, CAST(r AS INTEGER) AS rank, song_id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, song_id) AS r FROM
        (SELECT query, CAST(vec_id AS VARCHAR) AS song_id, round(list_cosine_similarity(cv.v, p.v), 9) AS s FROM cv, p WHERE NOT EXISTS (SELECT 1 FROM sd WHERE sd.query = cv.query AND sd.vec_id = p.vec_id))) WHERE r <= 20""",
    "query_seed_topk": BASE
    + """, sv AS (SELECT song_id, min(v) AS v FROM (SELECT trim(song_id) AS song_id, list_transform(v, lambda x: CAST(x AS DOUBLE)) AS v FROM song_vectors WHERE len(v) = 512) WHERE song_id <> ''
        AND len(list_filter(v, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0 GROUP BY 1), sd AS (SELECT DISTINCT row_id, song_id FROM vote WHERE gear IN (0, -1)),
        e AS (SELECT row_id, unnest(v) AS x, unnest(range(512)) AS k FROM sd JOIN sv USING (song_id)), m AS (SELECT row_id, k, avg(x) AS x FROM e GROUP BY 1, 2), cv AS (SELECT row_id, list(x ORDER BY k) AS v FROM m GROUP BY 1)
        SELECT query, CAST(r AS INTEGER) AS rank, song_id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, song_id) AS r FROM
        (SELECT CAST(cv.row_id AS VARCHAR) AS query, sv.song_id, round(list_cosine_similarity(cv.v, sv.v), 9) AS s FROM cv, sv WHERE NOT EXISTS (SELECT 1 FROM vote w WHERE w.row_id = cv.row_id AND w.song_id = sv.song_id))) WHERE r <= 20""",
    "nearest_center": _P + "SELECT vec_id, slot, round(d, 6) AS d FROM a",
    "masked_nearest_center": _P
    + """, k AS (SELECT label, CAST(r - 1 AS INTEGER) AS slot, v AS center FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM p) WHERE r <= 4)
        SELECT vec_id, label, slot, round(d, 6) AS d FROM (SELECT vec_id, p.label, slot, round(list_distance(v, center), 9) AS d, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_distance(v, center), 9), slot) AS r FROM p JOIN k USING (label)) WHERE r = 1""",
    "residual_norm": _P
    + """, e AS (SELECT vec_id, unnest(v) - unnest(center) AS x, unnest(range(64)) AS k FROM a), n AS (SELECT vec_id, k // 32 AS g, sqrt(sum(x * x)) + 1e-8 AS l FROM e GROUP BY 1, 2),
        y AS (SELECT e.vec_id, k, x / l AS x FROM e JOIN n ON n.vec_id = e.vec_id AND n.g = e.k // 32) SELECT vec_id, round(sum(x * (k + 1)), 5) AS checksum, round(sum(x * x), 5) AS length FROM y GROUP BY vec_id""",
    "overflow_loss": _P + "SELECT CAST(coalesce(sum(greatest(n - 50, 0)), 0) AS BIGINT) AS loss FROM (SELECT slot, count(*) AS n FROM a GROUP BY slot)",
    "center_update": _P + ", e AS (SELECT slot, unnest(v) AS x, unnest(range(64)) AS k FROM a) SELECT slot, CAST(k AS INTEGER) AS k, round(avg(x), 6) AS x FROM e GROUP BY slot, k",
    "collisions": BASE + "SELECT l1, l2, l3, count(*) AS n, array_to_string(list(song_id ORDER BY song_id)[1:10], ' ') AS songs FROM sid GROUP BY 1, 2, 3 HAVING count(*) > 1",
    "collision_summary": BASE + "SELECT count(*) AS ids, CAST(coalesce(sum(n), 0) AS BIGINT) AS songs, coalesce(max(n), 0) AS worst FROM (SELECT count(*) AS n FROM sid GROUP BY l1, l2, l3 HAVING count(*) > 1)",
    "id_coverage": BASE
    + """SELECT count(*) AS songs, count(DISTINCT (l1, l2, l3)) AS unique_ids, round(count(DISTINCT (l1, l2, l3)) / count(*), 6) AS coverage, count(DISTINCT l1) AS unique_l1,
         count(DISTINCT l2) AS unique_l2, count(DISTINCT l3) AS unique_l3 FROM sid""",
    "layer_bincount_stats": BASE
    + """, z AS (SELECT 1 AS layer, l1 AS id FROM sid UNION ALL SELECT 2, l2 FROM sid UNION ALL SELECT 3, l3 FROM sid), m AS (SELECT layer, max(id) AS mx FROM z GROUP BY layer),
        q AS (SELECT layer, unnest(range(mx + 1)) AS id FROM m), k AS (SELECT q.layer, q.id, count(z.id) AS n FROM q LEFT JOIN z ON z.layer = q.layer AND z.id = q.id GROUP BY 1, 2)
        SELECT layer, count_if(n > 0) AS unique_ids, CAST(min(CASE WHEN n > 0 THEN id END) AS INTEGER) AS min_id, CAST(max(id) AS INTEGER) AS max_id, min(n) AS least, max(n) AS most,
        round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std FROM k GROUP BY layer""",
    "combo_utilization": BASE + "SELECT count(DISTINCT (l1, l2)) AS combinations, round(count(DISTINCT (l1, l2)) / 16384, 6) AS utilisation FROM sid",
    "l3_per_combo": BASE + f"{_SPREAD} (SELECT count(DISTINCT l3) AS n FROM sid GROUP BY l1, l2)",
    "songs_per_combo": BASE + f"{_SPREAD} (SELECT count(*) AS n FROM sid GROUP BY l1, l2)",
    "id_multiplicity": BASE + "SELECT n, count(*) AS ids FROM (SELECT count(*) AS n FROM sid GROUP BY l1, l2, l3) GROUP BY n",
    "smallest_combos": BASE + "SELECT l1, l2, count(*) AS songs, count(DISTINCT l3) AS thirds FROM sid GROUP BY 1, 2 ORDER BY songs, l1, l2 LIMIT 10",
    "prefix_search": BASE + "SELECT * FROM sid WHERE l1 = 127 AND l2 = 104",
    "trie_next_tokens": BASE + "SELECT '' AS prefix, l1 AS next FROM sid UNION SELECT CAST(l1 AS VARCHAR), l2 FROM sid UNION SELECT l1 || ',' || l2, l3 FROM sid",
    "trie_stats": BASE
    + """, z AS (SELECT 0 AS level, count(DISTINCT l1) AS children FROM sid UNION ALL SELECT 1, count(DISTINCT l2) FROM sid GROUP BY l1
        UNION ALL SELECT 2, count(DISTINCT l3) FROM sid GROUP BY l1, l2 UNION ALL SELECT 3, count(DISTINCT (l1, l2, l3)) FROM sid) SELECT level, children, count(*) AS nodes FROM z GROUP BY 1, 2""",
    "generation_rank": _G + "SELECT key, l1, l2, l3, count(*) AS n, CAST(min(place) AS INTEGER) AS first FROM g JOIN known USING (l1, l2, l3) GROUP BY 1, 2, 3, 4",
    "primary_and_similar": _G
    + """, r AS (SELECT key, l1, l2, l3, count(*) AS n, min(place) AS first FROM g JOIN known USING (l1, l2, l3) GROUP BY 1, 2, 3, 4),
        t AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, first) AS rank FROM r), m AS (SELECT l1, l2, l3, count(*) AS cluster_size, list(song_id ORDER BY song_id) AS s FROM sid GROUP BY 1, 2, 3)
        SELECT key, CAST(rank AS INTEGER) AS rank, l1, l2, l3, n, cluster_size, s[1] AS "primary", array_to_string(s[2:6], ' ') AS similar FROM t JOIN m USING (l1, l2, l3) WHERE rank <= 10""",
    "invalid_ids": _G + "SELECT key, count(*) AS invalid FROM g WHERE NOT EXISTS (SELECT 1 FROM sid s WHERE s.l1 = g.l1 AND s.l2 = g.l2 AND s.l3 = g.l3 AND s.song_id IN (SELECT trim(song_id) FROM song_vectors WHERE v IS NOT NULL)) GROUP BY key",
    "unknown_ids": _G + "SELECT key, count(*) AS invalid FROM g WHERE NOT EXISTS (SELECT 1 FROM sid s WHERE s.l1 = g.l1 AND s.l2 = g.l2 AND s.l3 = g.l3) GROUP BY key",
    "unknown_ids": _G + "SELECT key, count(*) AS invalid FROM g WHERE NOT EXISTS (SELECT 1 FROM known s WHERE s.l1 = g.l1 AND s.l2 = g.l2 AND s.l3 = g.l3) GROUP BY key",
    "constrained_mask": _G
    + """, f AS (SELECT key, [l1, l2, l3][1:key % 4] AS prefix FROM g WHERE place = 0), x AS (SELECT key, prefix, array_to_string(prefix, ',') AS p FROM f),
        nx AS (SELECT prefix, array_to_string(list(next ORDER BY next), ',') AS children FROM (SELECT '' AS prefix, l1 AS next FROM sid UNION SELECT CAST(l1 AS VARCHAR), l2 FROM sid UNION SELECT l1 || ',' || l2, l3 FROM sid) GROUP BY prefix)
        SELECT key, p AS prefix, CASE WHEN len(x.prefix) >= 3 THEN array_to_string(list_concat(range(128), [-1]), ',') ELSE coalesce(children, '-1') END AS allowed FROM x LEFT JOIN nx ON nx.prefix = x.p""",
    "candidate_slots": BASE + "SELECT l1, l2, l3 AS candidate, CAST(row_number() OVER (PARTITION BY l1, l2 ORDER BY l3) - 1 AS INTEGER) AS slot FROM (SELECT DISTINCT l1, l2, l3 FROM sid)",
    "reverse_lookup": BASE + "SELECT song_id, l1, l2, l3, coalesce(name, 'N/A') AS name FROM (SELECT DISTINCT song_id FROM vote) LEFT JOIN sid USING (song_id) LEFT JOIN song USING (song_id)",
    "metric_sample": "SELECT vec_id, label FROM embeddings ORDER BY md5('42:' || vec_id), vec_id LIMIT 300",
    "calinski_harabasz": _P
    + """, e AS (SELECT vec_id, label, unnest(v) AS x, unnest(range(64)) AS k FROM p), m AS (SELECT label, k, avg(x) AS m, count(*) AS n FROM e GROUP BY 1, 2), o AS (SELECT k, avg(x) AS o FROM e GROUP BY k),
        b AS (SELECT sum(n * (m - o) * (m - o)) AS b FROM m JOIN o USING (k)), w AS (SELECT sum((x - m) * (x - m)) AS w FROM e JOIN m USING (label, k)), z AS (SELECT count(DISTINCT label) AS k, count(*) AS n FROM p)
        SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz FROM b, w, z""",
    "davies_bouldin": _P
    + """, e AS (SELECT vec_id, label, unnest(v) AS x, unnest(range(64)) AS k FROM p), m AS (SELECT label, k, avg(x) AS m FROM e GROUP BY 1, 2),
        s AS (SELECT label, avg(d) AS s FROM (SELECT vec_id, label, sqrt(sum((x - m) * (x - m))) AS d FROM e JOIN m USING (label, k) GROUP BY 1, 2) GROUP BY label),
        q AS (SELECT a.label AS i, b.label AS j, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d FROM m a JOIN m b ON a.k = b.k AND a.label <> b.label GROUP BY 1, 2)
        SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT i, max((x.s + y.s) / d) AS r FROM q JOIN s x ON x.label = i JOIN s y ON y.label = j GROUP BY i)""",
    "silhouette": _P
    + """, q AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.v, b.v)) AS t, count(*) AS n FROM p a, p b GROUP BY 1, 2, 3),
        z AS (SELECT vec_id, max(CASE WHEN label = other THEN n END) AS own, max(CASE WHEN label = other AND n > 1 THEN t / (n - 1) END) AS a, min(CASE WHEN label <> other THEN t / n END) AS b FROM q GROUP BY vec_id)
        SELECT round(avg(CASE WHEN own = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM z""",
}
