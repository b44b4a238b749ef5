"""Queries over playlists, keywords, votes and corpora, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunefold.functions import text as X
from tunefold.functions import vocabulary as Y
from tunefold.operators import evaluation as E
from tunefold.operators import playlists as P

KEYWORD = "jazz"
KEYWORDS = ["jazz", "rock", "电子", "Лучший"]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rows(s, d):
    return P.clean_rows(_t(s, d, "gen_playlist_song"))


def info(s, d):
    return P.latest_info(_t(s, d, "gen_playlist_info"))


def songs(s, d):
    return P.clean_song_info(_t(s, d, "gen_song_info"))


def ids(s, d):
    return P.valid_ids(_t(s, d, "semantic_ids"))


def matched(s, d):
    return P.keyword_matches(info(s, d), KEYWORD)


def playlist_length_filter(s, d):
    return P.as_lists(rows(s, d), 10, 300).select("playlist_id", "n", F.array_join("songs", " ").alias("songs"))


def playlist_islands(s, d):
    return P.islands(_t(s, d, "gen_playlist_song").where("playlist_id IS NOT NULL"), "dt", "ingested_at", "playlist_id", "pos", "song_id")


def playlist_sets(s, d):
    return P.as_sets(rows(s, d))


def corpus_build(s, d):
    return P.build_corpus(rows(s, d), info(s, d), ids(s, d))


def corpus_stats(s, d):
    return P.corpus_stats(rows(s, d), info(s, d), ids(s, d))


def corpus_split(s, d):
    return P.split(_t(s, d, "generator_corpus").select("rec_id"), "rec_id")


def corpus_missing_info(s, d):
    return rows(s, d).select("playlist_id").distinct().join(info(s, d).select(F.col("glid").alias("playlist_id")), "playlist_id", "left_anti")


def token_count(s, d):
    return _t(s, d, "generator_corpus").select("rec_id", F.regexp_count("output_sequence", F.lit(X.TOKEN)).cast("int").alias("tokens"))


def triple_parse(s, d):
    t = _t(s, d, "generator_corpus").select("rec_id", F.posexplode(X.triples("output_sequence")).alias("place", "x"))
    return t.select("rec_id", "place", "x.l1", "x.l2", "x.l3")


def ordered_dedupe(s, d):
    t = _t(s, d, "generator_corpus").select("rec_id", F.posexplode(F.array_distinct(X.triples("output_sequence"))).alias("place", "x"))
    return t.select("rec_id", "place", "x.l1", "x.l2", "x.l3")


def truncate_pad(s, d):
    t = _t(s, d, "playlists_corpus").where("songs IS NOT NULL").select("playlist_id", F.transform("songs", lambda x: F.coalesce(x.try_cast("long"), F.lit(1).cast("long"))).alias("ids")).distinct()
    return t.select("playlist_id", F.array_join(X.padded("ids", 128), " ").alias("input_ids"), F.array_join(X.attention_mask("ids", 128), " ").alias("attention_mask"))


def token_vocabulary(s, d):
    return Y.table(s)


def tokenized_corpus(s, d):
    """Fixed-width token ids, mask and labels of every target sequence."""
    ids, labels = Y.encode(F.col("output_sequence"))
    t = _t(s, d, "generator_corpus").select("rec_id", ids.alias("ids"), labels.alias("labels"))
    mask = F.transform("ids", lambda i: (i != Y.special_id("<pad>")).cast("int"))
    return t.select("rec_id", F.array_join("ids", " ").alias("input_ids"), F.array_join(mask, " ").alias("attention_mask"), F.array_join("labels", " ").alias("labels"))


def keyword_search(s, d):
    return matched(s, d).select("glid", "listname", "creator", "tags")


def keyword_song_frequency(s, d):
    return P.top_songs(P.song_frequency(rows(s, d), matched(s, d)), songs(s, d), 50)


def keyword_summary(s, d):
    out = P.keyword_summary(rows(s, d), matched(s, d))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def keyword_compare(s, d):
    return P.compare_keywords(info(s, d), rows(s, d), KEYWORDS)


def creator_stats(s, d):
    return P.creators(rows(s, d), matched(s, d))


def song_labels(s, d):
    """Display label of every song of the rows, with defaults for unknown ones, and a safe file name."""
    used = rows(s, d).select("song_id").distinct().join(songs(s, d), "song_id", "left")
    label = X.song_label("song_id", "name", "singer")
    return used.select("song_id", label.alias("label"), X.file_name(label).alias("file"))


def votes(s, d):
    v = _t(s, d, "query_vote").where("query IS NOT NULL AND song_infos IS NOT NULL")
    return v.select("row_id", "query", F.posexplode(X.gear_items("song_infos")).alias("place", "x")).select("row_id", "query", "place", "x.song_id", "x.gear")


def gear_parse(s, d):
    return votes(s, d)


def gear_parse_seeds(s, d):
    return votes(s, d).where("gear IN (0, -1)").select("row_id", "place", "song_id")


def vote_parse(s, d):
    """The comma format, made from the packed one."""
    v = _t(s, d, "query_vote").where("song_infos IS NOT NULL").select("row_id", F.posexplode(X.vote_items(F.regexp_replace("song_infos", "@@", ","))).alias("place", "x"))
    return v.select("row_id", "place", "x.song_id", "x.vote")


def coverage_rate(s, d):
    return E.coverage(votes(s, d), ids(s, d))


def filter_known_votes(s, d):
    return E.known_votes(votes(s, d), ids(s, d)).select("row_id", F.array_join("songs", " ").alias("songs"))


def lists_pair(s, d):
    """Two lists per playlist: its songs as they stand now, and those of the older corpus."""
    now = P.as_lists(rows(s, d)).select(F.col("playlist_id").alias("query"), F.col("songs").alias("voted"))
    c = _t(s, d, "playlists_corpus").where("songs IS NOT NULL").select(F.col("playlist_id").alias("query"), F.filter(F.transform("songs", X.strip), lambda x: F.length(x) > 0).alias("generated"))
    return now.join(c.distinct(), "query")


def jaccard_songs(s, d):
    return E.list_scores(lists_pair(s, d))


def mean_scores(s, d):
    return E.means(E.list_scores(lists_pair(s, d)))


def best_worst(s, d):
    return E.best_worst(E.list_scores(lists_pair(s, d)), 10)


def jaccard_semantic_levels(s, d):
    return E.level_scores(lists_pair(s, d), ids(s, d))


def binary_metrics(s, d):
    li = _t(s, d, "lineitem").select((F.col("l_discount") * 40 - 2).alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return E.binary_metrics(li)


def nearest_rank(s, d):
    """Percentiles by nearest rank of the order totals of each status."""
    return E.nearest_rank(_t(s, d, "orders"), "o_orderstatus", "o_totalprice", [1, 50, 99])


def batches(s, d):
    """Suppliers cut into seven nearly equal parts, in order."""
    sup = E.parts(_t(s, d, "supplier").select("s_suppkey"), "s_suppkey", 7)
    return sup.groupBy("part").agg(F.count("*").alias("n"), F.min("s_suppkey").alias("first"), F.max("s_suppkey").alias("last"))


QUERIES = {
    f.__name__: f
    for f in (
        playlist_length_filter, playlist_islands, playlist_sets, corpus_build, corpus_stats, corpus_split, corpus_missing_info, token_count, triple_parse, ordered_dedupe,
        truncate_pad, token_vocabulary, tokenized_corpus, keyword_search, keyword_song_frequency, keyword_summary, keyword_compare, creator_stats, song_labels, gear_parse, gear_parse_seeds, vote_parse,
        coverage_rate, filter_known_votes, jaccard_songs, mean_scores, best_worst, jaccard_semantic_levels, binary_metrics, nearest_rank, batches,
    )
}


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


BASE = rf"""
    WITH ps AS (SELECT playlist_id, {_strip("song_id")} AS song_id, pos FROM gen_playlist_song
                WHERE playlist_id IS NOT NULL AND length({_strip("song_id")}) > 0),
    info AS (SELECT glid, listname, coalesce(description, '') AS description, coalesce(creator, '') AS creator, coalesce(tags, '') AS tags
             FROM (SELECT *, row_number() OVER (PARTITION BY glid ORDER BY updated_at DESC NULLS LAST, row_id DESC) AS r FROM gen_playlist_info WHERE glid IS NOT NULL AND glid <> '') WHERE r = 1),
    song AS (SELECT song_id, name, singer FROM (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY name, singer) AS r FROM
             (SELECT {_strip("song_id")} AS song_id, coalesce({_strip("name")}, '') AS name, coalesce({_strip("singer")}, '') AS singer FROM gen_song_info) WHERE length(song_id) > 0) WHERE r = 1),
    sid AS (SELECT song_id, l1, l2, l3 FROM (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY l1, l2, l3) AS r FROM
            (SELECT song_id, semantic_ids[1] AS l1, semantic_ids[2] AS l2, semantic_ids[3] AS l3 FROM semantic_ids
             WHERE song_id IS NOT NULL AND len(semantic_ids) = 3) WHERE l1 IS NOT NULL AND l2 IS NOT NULL AND l3 IS NOT NULL) WHERE r = 1),
    hit AS (SELECT * FROM info WHERE contains(lower(coalesce(listname, '')), 'jazz') OR contains(lower(description), 'jazz') OR contains(lower(tags), 'jazz')),
    vote AS (SELECT row_id, query, row_number() OVER (PARTITION BY row_id ORDER BY i) - 1 AS place, song_id, gear FROM
             (SELECT row_id, query, i, {_strip("parts[1]")} AS song_id, TRY_CAST({_strip("parts[2]")} AS INTEGER) AS gear FROM
              (SELECT row_id, query, i, string_split(items[i], ':') AS parts FROM (SELECT row_id, query, items, unnest(range(1, len(items) + 1)) AS i FROM
               (SELECT row_id, query, string_split(song_infos, '@@')[1:20] AS items FROM query_vote WHERE query IS NOT NULL AND song_infos IS NOT NULL)))
              WHERE len(parts) >= 2) WHERE gear IS NOT NULL),
    freq AS (SELECT song_id, count(*) AS occurrences, count(DISTINCT playlist_id) AS playlists FROM ps WHERE playlist_id IN (SELECT glid FROM hit) GROUP BY song_id),
    tri AS (SELECT rec_id, i - 1 AS place, CAST(a[i] AS INTEGER) AS l1, CAST(b[i] AS INTEGER) AS l2, CAST(c[i] AS INTEGER) AS l3 FROM
            (SELECT rec_id, a, b, c, unnest(range(1, len(a) + 1)) AS i FROM (SELECT rec_id,
             regexp_extract_all(output_sequence, '<id_l1_(\d+)> <id_l2_(\d+)> <id_l3_(\d+)>', 1) AS a,
             regexp_extract_all(output_sequence, '<id_l1_(\d+)> <id_l2_(\d+)> <id_l3_(\d+)>', 2) AS b,
             regexp_extract_all(output_sequence, '<id_l1_(\d+)> <id_l2_(\d+)> <id_l3_(\d+)>', 3) AS c FROM generator_corpus))),
    pair AS (SELECT n.query, n.voted, g.generated FROM (SELECT playlist_id AS query, list(song_id ORDER BY pos, song_id) AS voted FROM ps GROUP BY playlist_id) n JOIN
             (SELECT DISTINCT playlist_id AS query, list_filter(list_transform(songs, lambda x: {_strip("x")}), lambda x: length(x) > 0) AS generated FROM playlists_corpus WHERE songs IS NOT NULL) g ON n.query = g.query),
    score AS (SELECT query, len(list_intersect(voted, generated)) / CAST(len(list_distinct(list_concat(voted, generated))) AS DOUBLE) AS jaccard,
              len(list_intersect(voted[1:20], generated[1:20])) / CAST(len(generated[1:20]) AS DOUBLE) AS precision_at_20 FROM pair WHERE len(voted) > 0 AND len(generated) > 0),
    lev AS (SELECT query, side, l1, l2, l3 FROM (SELECT query, 'v' AS side, unnest(voted) AS song_id FROM pair UNION ALL SELECT query, 'g', unnest(generated) FROM pair) x JOIN sid USING (song_id))
"""


def _level(cols: str) -> str:
    return f"""(SELECT query, count_if(v AND g) / CAST(count(*) AS DOUBLE) AS j FROM
        (SELECT query, {cols}, bool_or(side = 'v') AS v, bool_or(side = 'g') AS g FROM lev GROUP BY query, {cols}) GROUP BY query)"""


SQL = {
    "playlist_length_filter": BASE + "SELECT playlist_id, count(*) AS n, string_agg(song_id, ' ' ORDER BY pos, song_id) AS songs FROM ps GROUP BY playlist_id HAVING count(*) BETWEEN 10 AND 300",
    "playlist_islands": """
        WITH a AS (SELECT *, CASE WHEN lag(playlist_id) OVER w = playlist_id THEN 0 ELSE 1 END AS nw FROM gen_playlist_song WHERE playlist_id IS NOT NULL
                   WINDOW w AS (PARTITION BY dt ORDER BY ingested_at, playlist_id, pos, song_id NULLS FIRST)),
        b AS (SELECT *, sum(nw) OVER (PARTITION BY dt ORDER BY ingested_at, playlist_id, pos, song_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS island FROM a)
        SELECT dt, CAST(island AS BIGINT) AS island, playlist_id, count(*) AS n FROM b GROUP BY 1, 2, 3""",
    "playlist_sets": BASE + "SELECT playlist_id, count(*) AS n, count(DISTINCT song_id) AS distinct_songs FROM ps GROUP BY playlist_id",
    "corpus_build": BASE
    + """, x AS (SELECT p.playlist_id AS glid, i.listname AS title, count(*) AS songs_with_id,
            list_concat([], flatten(list(['<id_l1_' || s.l1 || '>', '<id_l2_' || s.l2 || '>', '<id_l3_' || s.l3 || '>'] ORDER BY p.song_id))) AS tok
            FROM ps p JOIN info i ON i.glid = p.playlist_id JOIN sid s ON s.song_id = p.song_id WHERE i.listname IS NOT NULL AND i.listname <> '' GROUP BY 1, 2)
        SELECT glid, title, songs_with_id, array_to_string(tok[1:383], ' ') || ' <eos>' AS output_sequence FROM x WHERE songs_with_id >= 10""",
    "corpus_stats": BASE
    + """, p AS (SELECT playlist_id, count(*) AS songs, count(s.song_id) AS with_id FROM ps LEFT JOIN sid s USING (song_id) GROUP BY playlist_id),
        j AS (SELECT p.*, i.glid IS NOT NULL AS known, i.listname IS NOT NULL AND i.listname <> '' AS titled FROM p LEFT JOIN info i ON i.glid = p.playlist_id)
        SELECT count(*) AS playlists, count_if(NOT known) AS without_info, count_if(known AND NOT titled) AS without_title, count_if(known AND titled AND with_id < 10) AS too_few,
               count_if(known AND titled AND with_id >= 10) AS kept, CAST(sum(CASE WHEN known AND titled THEN songs ELSE 0 END) AS BIGINT) AS songs,
               CAST(sum(CASE WHEN known AND titled THEN with_id ELSE 0 END) AS BIGINT) AS songs_with_id FROM j""",
    "corpus_split": """
        WITH x AS (SELECT rec_id, row_number() OVER (ORDER BY md5('42:' || rec_id), rec_id) - 1 AS k, count(*) OVER () AS n FROM generator_corpus)
        SELECT rec_id, CASE WHEN k < floor(n * 0.98) THEN 'train' WHEN k < floor(n * 0.98) + floor(n * 0.01) THEN 'val' ELSE 'test' END AS split FROM x""",
    "corpus_missing_info": BASE + "SELECT DISTINCT playlist_id FROM ps WHERE playlist_id NOT IN (SELECT glid FROM info)",
    "token_count": r"SELECT rec_id, CAST(len(regexp_extract_all(output_sequence, '<id_l[123]_\d+>')) AS INTEGER) AS tokens FROM generator_corpus",
    "triple_parse": BASE + "SELECT rec_id, CAST(place AS INTEGER) AS place, l1, l2, l3 FROM tri",
    "ordered_dedupe": BASE + "SELECT rec_id, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY p) - 1 AS INTEGER) AS place, l1, l2, l3 FROM (SELECT rec_id, l1, l2, l3, min(place) AS p FROM tri GROUP BY ALL)",
    "truncate_pad": """
        WITH x AS (SELECT DISTINCT playlist_id, list_transform(songs, lambda s: coalesce(TRY_CAST(s AS BIGINT), 1)) AS ids FROM playlists_corpus WHERE songs IS NOT NULL)
        SELECT playlist_id, array_to_string(list_concat(ids, list_transform(range(128), lambda i: 0))[1:128], ' ') AS input_ids,
               array_to_string(list_transform(range(128), lambda i: CASE WHEN i < len(ids) THEN 1 ELSE 0 END), ' ') AS attention_mask FROM x""",
    "token_vocabulary": """
        SELECT '<id_l1_' || i || '>' AS token, CAST(i AS INTEGER) AS id, 1 AS level, CAST(i AS INTEGER) AS value FROM range(128) t(i)
        UNION ALL SELECT '<id_l2_' || i || '>', CAST(128 + i AS INTEGER), 2, CAST(i AS INTEGER) FROM range(128) t(i)
        UNION ALL SELECT '<id_l3_' || i || '>', CAST(256 + i AS INTEGER), 3, CAST(i AS INTEGER) FROM range(256) t(i)
        UNION ALL SELECT unnest(['<user>', '<eos>', '<unk>', '<pad>', '<mask>', '<sep>']), unnest([512, 513, 514, 515, 516, 517]), NULL, NULL""",
    "tokenized_corpus": r"""
        WITH w AS (SELECT rec_id, list_transform(string_split(trim(output_sequence), ' '), lambda t: CASE WHEN t = '<eos>' THEN 513
            WHEN starts_with(t, '<id_l1_') THEN CAST(regexp_extract(t, '_(\d+)>$', 1) AS INTEGER)
            WHEN starts_with(t, '<id_l2_') THEN 128 + CAST(regexp_extract(t, '_(\d+)>$', 1) AS INTEGER)
            WHEN starts_with(t, '<id_l3_') THEN 256 + CAST(regexp_extract(t, '_(\d+)>$', 1) AS INTEGER) ELSE 514 END) AS x FROM generator_corpus)
        SELECT rec_id, array_to_string(list_concat(x, list_transform(range(384), lambda i: 515))[1:384], ' ') AS input_ids,
               array_to_string(list_transform(range(384), lambda i: CASE WHEN i < len(x) THEN 1 ELSE 0 END), ' ') AS attention_mask,
               array_to_string(list_concat(x, list_transform(range(384), lambda i: -100))[1:384], ' ') AS labels FROM w""",
    "keyword_search": BASE + "SELECT glid, listname, creator, tags FROM hit",
    "keyword_song_frequency": BASE
    + """SELECT CAST(row_number() OVER (ORDER BY occurrences DESC, song_id) AS INTEGER) AS rank, f.song_id, occurrences, playlists, coalesce(name, 'N/A') AS name, coalesce(singer, 'N/A') AS singer
         FROM (SELECT * FROM freq ORDER BY occurrences DESC, song_id LIMIT 50) f LEFT JOIN song USING (song_id)""",
    "keyword_summary": BASE
    + """SELECT (SELECT count(*) FROM hit) AS matched, count(*) AS songs, CAST(coalesce(sum(occurrences), 0) AS BIGINT) AS occurrences,
         round(sum(occurrences) / (SELECT count(*) FROM hit), 6) AS per_playlist, round(avg(occurrences), 6) AS mean, round(median(occurrences), 6) AS median,
         round(stddev_pop(occurrences), 6) AS std, max(occurrences) AS most, min(occurrences) AS least FROM freq""",
    "keyword_compare": BASE
    + """, k AS (SELECT unnest(['jazz', 'rock', '电子', 'Лучший']) AS keyword),
        m AS (SELECT keyword, glid FROM info, k WHERE contains(lower(coalesce(listname, '')), lower(keyword)) OR contains(lower(description), lower(keyword)) OR contains(lower(tags), lower(keyword))),
        f AS (SELECT keyword, song_id, count(*) AS occurrences FROM ps JOIN m ON m.glid = ps.playlist_id GROUP BY 1, 2),
        r AS (SELECT *, count(*) OVER (PARTITION BY keyword) AS songs, CAST(row_number() OVER (PARTITION BY keyword ORDER BY occurrences DESC, song_id) AS INTEGER) AS rank FROM f)
        SELECT keyword, (SELECT count(*) FROM m WHERE m.keyword = r.keyword) AS playlists, songs, rank, song_id, occurrences FROM r WHERE rank <= 5""",
    "creator_stats": BASE + "SELECT creator, count(*) AS playlists FROM hit WHERE creator <> '' AND glid IN (SELECT playlist_id FROM ps) GROUP BY creator",
    "song_labels": BASE
    + r"""SELECT song_id, label, regexp_replace(label, '[^\p{L}\p{N}]', '_', 'g') AS file FROM (SELECT song_id, song_id || '-' || coalesce(name, 'N/A') || '-' || coalesce(singer, 'N/A') AS label
         FROM (SELECT DISTINCT song_id FROM ps) LEFT JOIN song USING (song_id))""",
    "gear_parse": BASE + "SELECT row_id, query, CAST(place AS INTEGER) AS place, song_id, gear FROM vote",
    "gear_parse_seeds": BASE + "SELECT row_id, CAST(place AS INTEGER) AS place, song_id FROM vote WHERE gear IN (0, -1)",
    "vote_parse": rf"""
        WITH a AS (SELECT row_id, string_split(replace(song_infos, '@@', ','), ',') AS items FROM query_vote WHERE song_infos IS NOT NULL),
        b AS (SELECT row_id, i, string_split(items[i], ':') AS p FROM (SELECT row_id, items, unnest(range(1, len(items) + 1)) AS i FROM a)),
        c AS (SELECT row_id, i, {_strip("p[1]")} AS song_id, TRY_CAST({_strip("p[2]")} AS INTEGER) AS vote FROM b WHERE len(p) = 2)
        SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY i) - 1 AS INTEGER) AS place, song_id, vote FROM c WHERE vote IS NOT NULL""",
    "coverage_rate": BASE
    + """SELECT count(*) AS voted, count(s.song_id) AS covered, CASE WHEN count(*) = 0 THEN 0 ELSE round(100.0 * count(s.song_id) / count(*), 6) END AS rate
         FROM (SELECT DISTINCT song_id FROM vote) v LEFT JOIN sid s USING (song_id)""",
    "filter_known_votes": BASE + "SELECT row_id, string_agg(song_id, ' ' ORDER BY place) AS songs FROM vote WHERE song_id IN (SELECT song_id FROM sid) GROUP BY row_id",
    "jaccard_songs": BASE + "SELECT query, round(jaccard, 6) AS jaccard, round(precision_at_20, 6) AS precision_at_20 FROM score",
    "mean_scores": BASE + "SELECT count(*) AS queries, round(coalesce(avg(round(jaccard, 6)), 0), 6) AS jaccard, round(coalesce(avg(round(precision_at_20, 6)), 0), 6) AS precision_at_20 FROM score",
    "best_worst": BASE
    + """, r AS (SELECT query, round(jaccard, 6) AS jaccard FROM score)
        SELECT 'best' AS side, * FROM (SELECT CAST(row_number() OVER (ORDER BY jaccard DESC, query) AS INTEGER) AS rank, query, jaccard FROM r) WHERE rank <= 10
        UNION ALL SELECT 'worst', * FROM (SELECT CAST(row_number() OVER (ORDER BY jaccard, query) AS INTEGER) AS rank, query, jaccard FROM r) WHERE rank <= 10""",
    "jaccard_semantic_levels": BASE
    + f"""SELECT a.query, round(a.j, 6) AS full_id, round(b.j, 6) AS l1l2, round(c.j, 6) AS l1 FROM {_level("l1, l2, l3")} a JOIN {_level("l1, l2")} b USING (query) JOIN {_level("l1")} c USING (query)
         WHERE a.query IN (SELECT query FROM lev GROUP BY query HAVING count(DISTINCT side) = 2)""",
    "binary_metrics": """
        WITH x AS (SELECT l_discount * 40 - 2 > 0 AS p, l_returnflag = 'R' AS y FROM lineitem), c AS (SELECT count(*) AS n, count_if(p AND y) AS tp, count_if(p AND NOT y) AS fp, count_if(NOT p AND y) AS fn, count_if(p = y) AS ok FROM x)
        SELECT round(ok / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""",
    "nearest_rank": """
        WITH r AS (SELECT o_orderstatus AS grp, o_totalprice AS value, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) AS k, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
        SELECT grp, q, value FROM r, (SELECT unnest([1, 50, 99]) AS q) WHERE k = 1 + CAST(round_even(0.01 * q * (n - 1), 0) AS BIGINT)""",
    "batches": "SELECT part, count(*) AS n, min(s_suppkey) AS first, max(s_suppkey) AS last FROM (SELECT s_suppkey, CAST(ntile(7) OVER (ORDER BY s_suppkey) AS INTEGER) AS part FROM supplier) GROUP BY part",
}
