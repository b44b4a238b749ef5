"""Command line: ``python -m tunefold.cli train|infer|votes|queryvote|keyword|compare|find``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tunefold import shared
from tunefold.config import HierarchyConfig
from tunefold.functions import text as X
from tunefold.operators import clustering, evaluation, playlists, ranking, retrieval, semantic_ids
from tunefold.plans import playlist_queries as Q
from tunefold.shipping import ship
from tunefold.sources import sinks

SETTINGS = {
    "prod": HierarchyConfig(),
    "test": HierarchyConfig(layer_clusters=(32, 64, 64), need_clusters=(32, 32, 32)),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tunefold")
    sub = p.add_subparsers(dest="command", required=True)
    t = sub.add_parser("train", help="fit semantic ids and save them with their model")
    t.add_argument("tables")
    t.add_argument("out")
    t.add_argument("--mode", choices=sorted(SETTINGS), default="test")
    t.add_argument("--resume", action=argparse.BooleanOptionalAction, default=True)
    t.add_argument("--clear-checkpoints", action="store_true")
    for name in ("keyword", "compare"):
        k = sub.add_parser(name, help="songs of the playlists with a keyword" if name == "keyword" else "top songs of several keywords")
        k.add_argument("tables")
        k.add_argument("keywords", nargs="+")
        k.add_argument("-n", type=int, default=20)
    f = sub.add_parser("find", help="songs of a semantic-id prefix, or the neighbours of a song")
    f.add_argument("tables")
    f.add_argument("query")
    f.add_argument("-n", type=int, default=10)
    i = sub.add_parser("infer", help="songs for titles, by the overlap generator and the songs of the generated ids")
    i.add_argument("tables")
    i.add_argument("titles", nargs="+")
    i.add_argument("-n", type=int, default=20)
    v = sub.add_parser("votes", help="scores of generated lists against voted ones, in means and the best and worst queries")
    v.add_argument("tables")
    v.add_argument("--out", help="folder for the summary")
    v.add_argument("-n", type=int, default=10)
    q = sub.add_parser("queryvote", help="songs near the centroid of a query's seeds, beside the voted ones")
    q.add_argument("tables")
    q.add_argument("--query", help="one query; all without it")
    q.add_argument("-n", type=int, default=20)
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("tunefold").getOrCreate()
    ship(spark)
    if a.command == "train":
        train(spark, a)
    elif a.command == "keyword":
        hit = playlists.keyword_matches(Q.info(spark, a.tables), " ".join(a.keywords))
        playlists.top_songs(playlists.song_frequency(Q.rows(spark, a.tables), hit), Q.songs(spark, a.tables), a.n).orderBy("rank").show(a.n, False)
    elif a.command == "compare":
        playlists.compare_keywords(Q.info(spark, a.tables), Q.rows(spark, a.tables), a.keywords, a.n).orderBy("keyword", "rank").show(a.n * len(a.keywords), False)
    elif a.command == "infer":
        infer(spark, a.tables, a.titles, a.n).orderBy("title", "rank").show(a.n * len(a.titles), False)
    elif a.command == "votes":
        scores = shared.materialise(evaluation.list_scores(voted_and_generated(spark, a.tables)), "votes")
        evaluation.means(scores).show()
        evaluation.best_worst(scores, a.n).orderBy("side", "rank").show(2 * a.n, False)
        if a.out:
            sinks.summary(evaluation.means(scores), a.out)
    elif a.command == "queryvote":
        side_by_side(spark, a.tables, a.query, a.n).orderBy("query", "place").show(a.n * 10, False)
    elif X.is_prefix_query(a.query):
        semantic_ids.with_prefix(Q.ids(spark, a.tables), X.prefix(a.query)).orderBy("song_id").show(a.n, False)
    else:
        v = Q._t(spark, a.tables, "song_vectors").select("song_id", F.col("v").cast("array<double>").alias("v")).where(~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
        q = v.where(F.col("song_id") == a.query).limit(1).select(F.col("song_id").alias("query"), "v", F.array("song_id").alias("skip"))
        retrieval.top_k(q, v, a.n, 512).orderBy("rank").show(a.n, False)


def train(spark: SparkSession, a: argparse.Namespace) -> None:
    """Ids, model and checkpoints of one run; a run goes on after its last complete layer unless told to start anew."""
    done = sinks.Checkpoints(spark, f"{a.out}/checkpoints")
    if a.clear_checkpoints:
        done.clear()
    config = SETTINGS[a.mode]
    v = Q._t(spark, a.tables, "song_vectors").where(~F.exists("v", lambda x: x.isNull() | F.isnan(x))).select("song_id", "v").dropDuplicates(["song_id"])
    print(done.status(6))
    fitted, centers, allowed = clustering.fit_hierarchy(v, config, checkpoint=f"{a.out}/checkpoints", resume=a.resume)
    fitted = shared.materialise(fitted, "train-ids")
    sinks.save_model(spark, f"{a.out}/model", config, centers, allowed)
    unique = sinks.semantic_ids(fitted, f"{a.out}/semantic_ids")
    sinks.summary(semantic_ids.id_coverage(fitted), f"{a.out}/statistics")
    print(f"{unique} different ids")


def infer(spark: SparkSession, tables: str, titles: list[str], n: int) -> DataFrame:
    """(title, rank, song_id, name): the songs of the generated ids in the order of generation, each song once."""
    c = Q._t(spark, tables, "generator_corpus")
    g = ranking.OverlapGenerator(c.where("split = 'train'").select(F.col("input_text").alias("text"), X.triples("output_sequence").alias("triples")))
    prompts = spark.createDataFrame(list(enumerate(titles)), "key long, text string")
    return generated_songs(g.generate(prompts, n), Q.ids(spark, tables), n).join(prompts, "key").join(Q.songs(spark, tables), "song_id", "left").select(F.col("text").alias("title"), "rank", "song_id", "name")


def generated_songs(generated: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(key, rank, song_id): the union of the songs of all generated ids of a key, by the place of the first id that has
    them, then by song id; at most n."""
    first = generated.join(ids, ["l1", "l2", "l3"]).groupBy("key", "song_id").agg(F.min("place").alias("place"))
    w = Window.partitionBy("key").orderBy("place", "song_id")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("key", "rank", "song_id")


def voted_and_generated(spark: SparkSession, tables: str) -> DataFrame:
    """(query, voted, generated): the voted songs of each row of query_vote, and what is generated for its query."""
    votes = Q.votes(spark, tables)
    c = Q._t(spark, tables, "generator_corpus")
    g = ranking.OverlapGenerator(c.where("split = 'train'").select(F.col("input_text").alias("text"), X.triples("output_sequence").alias("triples")))
    made = generated_songs(g.generate(votes.select(F.col("row_id").alias("key"), F.col("query").alias("text")).distinct()), Q.ids(spark, tables), 20)

    def listed(df, key, order, name):
        return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "song_id")))["song_id"].alias(name)).select(F.col(key).cast("string").alias("query"), name)

    return listed(votes, "row_id", "place", "voted").join(listed(made, "key", "rank", "generated"), "query")


def side_by_side(spark: SparkSession, tables: str, query: str | None, n: int) -> DataFrame:
    """(query, place, voted, near, score): the voted songs beside those nearest to the seeds' centroid."""
    from tunefold.plans import semantic_queries

    votes = Q.votes(spark, tables)
    near = semantic_queries.query_seed_topk(spark, tables).where(F.col("rank") <= n)
    if query is not None:
        votes = votes.where(F.col("query") == query)
    named = votes.select(F.col("row_id").cast("string").alias("row"), "query").distinct()
    left = votes.select(F.col("row_id").cast("string").alias("row"), F.col("place").cast("int").alias("place"), F.col("song_id").alias("voted"))
    right = near.select(F.col("query").alias("row"), (F.col("rank") - 1).cast("int").alias("place"), F.col("song_id").alias("near"), "score")
    return left.join(right, ["row", "place"], "full").join(named, "row").select("query", "place", "voted", "near", "score")


if __name__ == "__main__":
    main()
