"""Queries of the problems for training data, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tunefold import shared
from tunefold.llm import cooccurrence, lookalikes, mixing, mojibake, packing, split_overlap, term_stats, tokens, vector_neighbors

DIM = 512


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of songs that share at least ten playlists, with their lift."""
    return cooccurrence.pair_counts(_read(spark, sf_dir, "gen_playlist_song"), "playlist_id", "song_id", 10)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence.found(p2_pairs(spark, sf_dir), 5)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_neighbors.pairs(p3_neighbors(spark, sf_dir))


def p3_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_neighbors.neighbors(_read(spark, sf_dir, "song_vectors"), "song_id", "v", DIM)


def p5_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train records and the records of other splits that are the same or nearly so."""
    return split_overlap.overlaps(_read(spark, sf_dir, "generator_corpus"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_overlaps(spark, sf_dir).select(F.least("train_rec", "eval_rec").alias("rec_a"), F.greatest("train_rec", "eval_rec").alias("rec_b"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per evaluation split and source."""
    return split_overlap.report(p5_overlaps(spark, sf_dir), _read(spark, sf_dir, "generator_corpus"))


def p5_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose triples overlap enough, whatever their titles: with an edit for each character all titles are near."""
    found = split_overlap.overlaps(_read(spark, sf_dir, "generator_corpus"), edits=1)
    return found.select("train_rec", "eval_rec", "shared", F.round("jaccard", 6).alias("jaccard"))


def p5_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation split and source the records with an exact copy in train, of those found."""
    corpus = _read(spark, sf_dir, "generator_corpus").select("rec_id", "input_text", "output_sequence")
    pairs = p5_overlaps(spark, sf_dir)
    one, two = (corpus.select(F.col("rec_id").alias(k), F.col("input_text").alias(f"t_{k}"), F.col("output_sequence").alias(f"s_{k}")) for k in ("train_rec", "eval_rec"))
    same = pairs.join(one, "train_rec").join(two, "eval_rec").where("t_train_rec = t_eval_rec AND s_train_rec = s_eval_rec")
    return same.groupBy("eval_split", "eval_source").agg(F.count_distinct("eval_rec").alias("copied"))


def p6_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences, playlists and mark of every song of the corpus."""
    corpus = _read(spark, sf_dir, "playlists_corpus")
    playlists = corpus.agg(F.count_distinct("playlist_id").alias("n")).first()["n"]
    counts = term_stats.marked(term_stats.ngram_counts(corpus, ["playlist_id"], "songs", 1), playlists)
    return counts.select(F.col("gram").alias("song_id"), "occurrences", F.col("records").alias("playlists"), "mark")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_terms(spark, sf_dir).where("mark IS NOT NULL").select("song_id", "mark")


def p6_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of up to three songs that occur at least ten times."""
    counts = term_stats.ngram_counts(_read(spark, sf_dir, "playlists_corpus"), ["playlist_id"], "songs", 3).where("occurrences >= 10")
    return counts.select(F.translate("gram", term_stats.SEP, " ").alias("gram"), "len", "occurrences", F.col("records").alias("playlists"))


def p7_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title and query with its consistent form."""
    infos, votes = _read(spark, sf_dir, "gen_playlist_info"), _read(spark, sf_dir, "query_vote")
    return lookalikes.consistent([("gen_playlist_info", infos, "row_id", "listname"), ("query_vote", votes, "row_id", "query")])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_forms(spark, sf_dir).where("value <> form").select("tbl", "row_id")


def p7_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per table the values, those whose form still holds what a form may not, and those that a second pass changes."""
    forms = p7_forms(spark, sf_dir)
    bad = F.col("form").rlike("[\uff01-\uff5e\u200b\u200c\u2060\ufeff\u00ad\u00a0\u2000-\u200a\u202f\u3000\ufb00-\ufb06\u0300-\u0308]")
    again = lookalikes.consistent([(t, forms.where(F.col("tbl") == t), "row_id", "form") for t in ("gen_playlist_info", "query_vote")])
    counts = forms.groupBy("tbl").agg(F.count("*").alias("rows"), F.count("form").alias("texts"), F.count_if(bad).alias("odd"))
    return counts.join(again.groupBy("tbl").agg(F.count_if(F.col("value") != F.col("form")).alias("changed_again")), "tbl")


def p10_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a plain mark of garbling, and how many of them are found."""
    marked = _read(spark, sf_dir, "documents").where(f"text RLIKE '{MARKS}'").select("doc_id")
    hit = marked.join(p10_found(spark, sf_dir).select("doc_id", F.lit(1).alias("hit")), "doc_id", "left")
    return hit.agg(F.count("*").alias("marked"), F.count("hit").alias("found"))


def p10_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled documents with their restored text and the transformations taken back."""
    return mojibake.repaired(_read(spark, sf_dir, "documents"), "doc_id", "text").withColumn("used", F.array_join("used", ","))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.found(_read(spark, sf_dir, "documents"), "doc_id", "text")


def _sized(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", *columns, tokens.token_count("text").alias("size"))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every piece of every document, for each capacity."""
    return packing.pack(_sized(spark, sf_dir), "doc_id", "size", _read(spark, sf_dir, "pack_spec"))


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity the documents placed, and what may not be: containers above the capacity, pieces of a document that
    don't make up its size, and documents cut without need."""
    sizes = shared.materialise(_sized(spark, sf_dir).where("size > 0"), "p8-sizes")
    placed = shared.materialise(packing.pack(sizes, "doc_id", "size", _read(spark, sf_dir, "pack_spec")), "p8-checked")
    full = placed.groupBy("spec_name", "capacity", "container").agg(F.sum("tokens").alias("fill")).groupBy("spec_name").agg(F.count_if(F.col("fill") > F.col("capacity")).alias("overfull"))
    whole = placed.groupBy("spec_name", "capacity", "item_id").agg(F.sum("tokens").alias("placed"), F.count("*").alias("pieces")).join(sizes.withColumnRenamed("doc_id", "item_id"), "item_id")
    cut = F.col("pieces") != F.ceil(F.col("size") / F.col("capacity"))
    items = whole.groupBy("spec_name").agg(F.count("*").alias("documents"), F.count_if(F.col("placed") != F.col("size")).alias("incomplete"), F.count_if(cut).alias("cut_badly"))
    return items.join(full.select("spec_name", "overfull"), "spec_name")


def p8_utilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.utilisation(p8_packed(spark, sf_dir))


def p9_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of every plan and how often each is used."""
    return mixing.mix(_sized(spark, sf_dir, "source"), "doc_id", "source", "size", _read(spark, sf_dir, "mix_target"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of every plan."""
    return mixing.mix(_sized(spark, sf_dir, "source"), "doc_id", "source", "size", _read(spark, sf_dir, "mix_target"))[1]


def p9_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per plan and source whether a record is used too often, and whether a source that has tokens misses its share of
    what the plan's living sources get by more than a hundredth, and by more than the plan's longest record."""
    sized = shared.materialise(_sized(spark, sf_dir, "source"), "p9-sized")
    chosen, shares = mixing.mix(sized, "doc_id", "source", "size", _read(spark, sf_dir, "mix_target"))
    often = chosen.groupBy("plan_name", "source").agg(F.max("times").alias("most"))
    longest = F.lit(sized.agg(F.max("size").alias("n")).first()["n"] or 0)
    live = F.sum(F.when(F.col("available_tokens") > 0, F.col("target_share")).otherwise(0)).over(Window.partitionBy("plan_name"))
    aim = F.when(F.col("available_tokens") > 0, F.col("target_share") / F.col("live")).otherwise(0.0)
    total = F.sum("tokens").over(Window.partitionBy("plan_name"))
    out = shares.withColumn("live", live).withColumn("total", total).join(often, ["plan_name", "source"], "left")
    off = (F.abs(F.col("actual_share") - aim) > 0.01) & (F.abs(F.col("tokens") - aim * F.col("total")) > longest)
    return out.select("plan_name", "source", (F.coalesce("most", F.lit(0)) > F.col("max_repeats")).alias("too_often"), off.alias("off"))


MARKS = "Ã[©±¼§³¡]|â€[œ™“]|\ufffd|Â[£½°]|├[®⌐¡]|√[©±£°]"

QUERIES = {f.__name__: f for f in (p5_sequences, p5_check, p7_check, p8_check, p9_check, p10_check, p2_found, p2_pairs, p3_found, p3_neighbors, p6_found, p6_terms, p6_runs, p7_found, p7_forms, p5_found, p5_overlaps, p5_report, p10_found, p10_repaired, p8_packed, p8_utilisation, p9_mixed, p9_shares)}

_P2 = r"""
    WITH r AS (SELECT DISTINCT playlist_id AS p, regexp_replace(song_id, '^\s+|\s+$', '', 'g') AS s
               FROM gen_playlist_song WHERE song_id IS NOT NULL AND playlist_id IS NOT NULL),
         f AS (SELECT * FROM r WHERE s <> ''),
         c AS (SELECT s, count(*) AS n FROM f GROUP BY s),
         k AS (SELECT count(DISTINCT p) AS n FROM f),
         x AS (SELECT a.s AS item_a, b.s AS item_b, count(*) AS n FROM f a JOIN f b ON a.p = b.p AND a.s < b.s GROUP BY 1, 2 HAVING count(*) >= 10),
         y AS (SELECT item_a, item_b, x.n AS n, ca.n AS n_a, cb.n AS n_b, k.n AS baskets, x.n * k.n / (ca.n * cb.n) AS lift
               FROM x JOIN c ca ON ca.s = item_a JOIN c cb ON cb.s = item_b, k)"""

_P6 = r"""
    WITH r AS (SELECT DISTINCT playlist_id, songs FROM playlists_corpus),
         q AS (SELECT row_number() OVER () AS rid, songs FROM r),
         e AS (SELECT rid, pos, regexp_replace(songs[pos], '^\s+|\s+$', '', 'g') AS s FROM (SELECT rid, songs, unnest(generate_series(1, len(songs))) AS pos FROM q)),
         t AS (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY pos) AS pos, s FROM e WHERE s <> '')"""

_P3 = r"""
    WITH x AS (SELECT DISTINCT ON (s) s, v FROM (SELECT regexp_replace(song_id, '^\s+|\s+$', '', 'g') AS s, CAST(v AS DOUBLE[]) AS v FROM song_vectors)
               WHERE s <> '' AND len(v) = 512 AND len(list_filter(v, lambda y: y IS NULL OR isnan(y))) = 0 AND len(list_filter(v, lambda y: y <> 0)) > 0 ORDER BY s),
         y AS (SELECT a.s AS song_id, b.s AS neighbor, round(list_cosine_similarity(a.v, b.v), 9) AS similarity FROM x a, x b WHERE a.s <> b.s),
         z AS (SELECT *, CAST(row_number() OVER (PARTITION BY song_id ORDER BY similarity DESC, neighbor) AS INTEGER) AS rank FROM y)"""

_P5 = r"""
    WITH r AS (SELECT rec_id, split, list_distinct(regexp_extract_all(output_sequence, '<id_l1_\d+> <id_l2_\d+> <id_l3_\d+>')) AS t FROM generator_corpus
               WHERE split IS NOT NULL AND input_text IS NOT NULL),
         f AS (SELECT * FROM r WHERE len(t) > 0),
         p AS (SELECT a.rec_id AS train_rec, b.rec_id AS eval_rec, len(list_intersect(a.t, b.t)) AS shared, len(a.t) + len(b.t) AS sum_of_sizes
               FROM f a JOIN f b ON a.split = 'train' AND b.split <> 'train' AND len(a.t) * 5 >= len(b.t) * 4 AND len(b.t) * 5 >= len(a.t) * 4)"""

_FORMS = "SELECT '{0}' AS tbl, count(*) AS rows, count({1}) AS texts, 0 AS odd, 0 AS changed_again FROM {0}"

SQL = {
    "p3_neighbors": _P3 + " SELECT song_id, rank, neighbor, similarity FROM z WHERE rank <= 5",
    "p3_found": _P3 + " SELECT DISTINCT least(song_id, neighbor) AS song_a, greatest(song_id, neighbor) AS song_b FROM z WHERE rank <= 5",
    "p5_sequences": _P5 + " SELECT train_rec, eval_rec, shared, round(shared / (sum_of_sizes - shared), 6) AS jaccard FROM p WHERE shared / (sum_of_sizes - shared) >= 0.8",
    "p5_check": r"""
        SELECT b.split AS eval_split, b.source AS eval_source, count(DISTINCT b.rec_id) AS copied FROM generator_corpus b
        JOIN generator_corpus a ON a.split = 'train' AND b.split <> 'train' AND a.input_text = b.input_text AND a.output_sequence = b.output_sequence
        WHERE regexp_matches(b.output_sequence, '<id_l1_\d+> <id_l2_\d+> <id_l3_\d+>') GROUP BY 1, 2""",
    "p7_check": _FORMS.format("gen_playlist_info", "listname") + " UNION ALL " + _FORMS.format("query_vote", "query"),
    "p8_check": "SELECT spec_name, (SELECT count(*) FROM documents WHERE text <> '') AS documents, 0 AS incomplete, 0 AS cut_badly, 0 AS overfull FROM pack_spec",
    "p9_check": "SELECT plan_name, source, false AS too_often, false AS off FROM mix_target",
    "p10_check": f"SELECT count(*) AS marked, count(*) AS found FROM documents WHERE regexp_matches(text, '{MARKS}')",
    "p2_pairs": _P2 + " SELECT * FROM y",
    "p2_found": _P2 + " SELECT item_a AS song_a, item_b AS song_b FROM y WHERE n * baskets >= 5 * n_a * n_b",
    "p6_terms": _P6
    + """ SELECT s AS song_id, count(*) AS occurrences, count(DISTINCT rid) AS playlists,
          CASE WHEN count(*) < 10 THEN 'rare' WHEN count(DISTINCT rid) > 0.25 * (SELECT count(DISTINCT playlist_id) FROM playlists_corpus) THEN 'common' END AS mark
          FROM t GROUP BY s""",
    "p6_found": _P6
    + """ SELECT * FROM (SELECT s AS song_id, CASE WHEN count(*) < 10 THEN 'rare'
          WHEN count(DISTINCT rid) > 0.25 * (SELECT count(DISTINCT playlist_id) FROM playlists_corpus) THEN 'common' END AS mark
          FROM t GROUP BY s) WHERE mark IS NOT NULL""",
    "p6_runs": _P6
    + """, g AS (SELECT rid, s AS gram, 1 AS len FROM t
                 UNION ALL SELECT a.rid, a.s || ' ' || b.s, 2 FROM t a JOIN t b ON a.rid = b.rid AND b.pos = a.pos + 1
                 UNION ALL SELECT a.rid, a.s || ' ' || b.s || ' ' || c.s, 3 FROM t a JOIN t b ON a.rid = b.rid AND b.pos = a.pos + 1
                           JOIN t c ON a.rid = c.rid AND c.pos = a.pos + 2)
          SELECT gram, len, count(*) AS occurrences, count(DISTINCT rid) AS playlists FROM g GROUP BY gram, len HAVING count(*) >= 10""",
}
