"""Operators at the sizes where a fixed cap would bite."""

from pyspark.sql import functions as F

from tunefold.operators import ranking as K


def test_hard_negatives_of_a_large_id(spark):
    """1,500 songs share an id; a playlist that holds the first 1,200 still gets the best of the others."""
    import hashlib

    songs = sorted((f"s{i}" for i in range(1500)), key=lambda s: hashlib.md5(s.encode()).hexdigest())
    ids = spark.createDataFrame([(s, 1, 2, 3) for s in songs], "song_id string, l1 int, l2 int, l3 int")
    pos = spark.createDataFrame([("p", "title", s) for s in songs[:1200]] + [("q", "title", "s7")], "playlist_id string, text string, song_id string")
    got = K.hard_negatives(pos, ids, 2).groupBy("playlist_id", "song_id").agg(F.collect_set("negative").alias("x")).collect()
    assert len(got) == 1201
    for r in got:
        free = songs[1200:] if r["playlist_id"] == "p" else [s for s in songs if s != "s7"]
        assert set(r["x"]) == set(sorted(free, key=lambda s: hashlib.md5(f"{r['playlist_id']}|{r['song_id']}|{s}".encode()).hexdigest())[:2])


def test_random_negatives_from_the_whole_catalogue(spark):
    """Each of 3,000 songs has an id of its own, so all negatives are random."""
    import hashlib

    songs = sorted((f"s{i}" for i in range(3000)), key=lambda s: hashlib.md5(s.encode()).hexdigest())
    ids = spark.createDataFrame([(s, i % 50, i // 50, 0) for i, s in enumerate(songs)], "song_id string, l1 int, l2 int, l3 int")
    pos = spark.createDataFrame([("p", "title", s) for s in songs[:1000]] + [(f"q{i}", "title", "s7") for i in range(400)] + [("all", "title", s) for s in songs], "playlist_id string, text string, song_id string")
    hard = K.hard_negatives(pos, ids, 2)
    got = K.random_negatives(pos, ids, hard, 2)
    per = {r["playlist_id"]: r["n"] for r in got.groupBy("playlist_id").agg(F.count("*").alias("n")).collect()}
    assert per == {"p": 2000, **{f"q{i}": 2 for i in range(400)}}
    assert got.distinct().count() == 2800
    assert got.join(pos.select("playlist_id", F.col("song_id").alias("negative")), ["playlist_id", "negative"], "left_semi").count() == 0
    late = set(songs[1000:])
    assert sum(r["negative"] in late for r in got.where("playlist_id <> 'p'").collect()) > 300


def test_generator_sums_before_it_cuts(spark):
    """An id at place 61 of either word of a prompt is the best of both together."""
    corpus = [("red", [(1, 1, i)]) for i in range(60) for _ in range(3)] + [("blue", [(2, 2, i)]) for i in range(60) for _ in range(3)] + [(w, [(9, 9, 9)]) for w in ("red", "blue") for _ in range(2)]
    df = spark.createDataFrame(corpus, "text string, triples array<struct<l1:int,l2:int,l3:int>>")
    prompts = spark.createDataFrame([(1, "Red blue"), (2, "blue  red"), (3, "red"), (4, None)], "key int, text string")
    got = {}
    for r in K.OverlapGenerator(df).generate(prompts).orderBy("place").collect():
        got.setdefault(r["key"], []).append((r["l1"], r["l2"], r["l3"]))
    assert got[1] == got[2] == [(9, 9, 9)] + [(1, 1, i) for i in range(19)]
    assert got[3] == [(1, 1, i) for i in range(20)] and set(got) == {1, 2, 3}


def test_all_seeds_and_all_known_ids(spark, data):
    """Every row with a seed that has a vector is answered, and ids of songs with an odd number are known."""
    import __spark_entry__ as e
    from tunefold.plans import playlist_queries as P
    from tunefold.plans import semantic_queries as Q

    assert {"query_seed_topk", "unknown_ids"} <= set(e.queries())
    seeds = P.votes(spark, data).where("gear IN (0, -1)").join(spark.read.parquet(f"{data}/song_vectors.parquet").where("size(v) = 512 AND NOT exists(v, x -> x IS NULL OR isnan(x)) AND exists(v, x -> x <> 0)").select(F.trim("song_id").alias("song_id")), "song_id", "left_semi")
    got = Q.query_seed_topk(spark, data).groupBy("query").count()
    assert got.count() == seeds.select("row_id").distinct().count() > 0
    known = {tuple(r) for r in P.ids(spark, data).select("l1", "l2", "l3").collect()}
    want = sum((r["l1"], r["l2"], r["l3"]) not in known for r in Q.generated(spark, data).collect())
    assert (Q.unknown_ids(spark, data).agg(F.sum("invalid")).first()[0] or 0) == want


def test_more_queries_than_a_pass_holds(spark, monkeypatch):
    import numpy as np

    from tunefold.operators import retrieval

    monkeypatch.setattr(retrieval, "QUERIES", 7)
    g = np.random.default_rng(2)
    rows = [(f"s{i:02d}", g.normal(size=6).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "song_id string, v array<double>").repartition(3)
    q = df.select(F.col("song_id").alias("query"), "v", F.array("song_id").alias("skip"))
    got = {}
    for r in retrieval.top_k(q, df, 3, 6).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["song_id"])
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    np.fill_diagonal(s, -9)
    assert got == {rows[i][0]: [rows[j][0] for j in np.argsort(-s[i])[:3]] for i in range(40)}


def test_generator_sums_no_pairs_of_prompts_and_ids(spark, monkeypatch):
    """Ids in several blocks, ties by id, and no join that holds every id for every prompt."""
    import random
    from collections import Counter, defaultdict

    monkeypatch.setattr(K, "BLOCK_ROWS", 7, raising=False)
    g = random.Random(4)
    corpus = [(" ".join(g.sample("abcdefg", 2)).upper(), [(g.randrange(3), g.randrange(4), g.randrange(-2, 5)) for _ in range(6)]) for _ in range(60)]
    prompts = [(i, " ".join(g.sample("abcdefgh", g.randrange(1, 4)))) for i in range(30)] + [(30, ""), (31, None), (32, "zz")]
    counts = defaultdict(Counter)
    for text, triples in corpus:
        for w in set(text.lower().split()):
            counts[w].update(triples)
    want = set()
    for key, text in prompts:
        total = sum((counts[w] for w in set((text or "").split())), Counter())
        want |= {(key, p, *x) for p, (x, _) in enumerate(sorted(total.items(), key=lambda i: (-i[1], i[0]))[:5])}
    df = spark.createDataFrame(corpus, "text string, triples array<struct<l1:int,l2:int,l3:int>>")
    got = K.OverlapGenerator(df).generate(spark.createDataFrame(prompts, "key int, text string"), 5)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert "sum(n" not in got._jdf.queryExecution().optimizedPlan().toString()
    none = K.OverlapGenerator(df).generate(spark.createDataFrame([], "key int, text string"), 5)
    assert none.count() == 0 and none.columns == got.columns


def test_pair_ranker_equals_the_fit_over_rows(spark, monkeypatch):
    """Pairs in many blocks and pieces give the scores that MLlib gives over a row for each pair."""
    import random

    from tunefold.operators import pair_ranker as R

    for name, x in (("BLOCK_VECTORS", 9), ("PIECE_PAIRS", 30), ("CHUNK_SONGS", 40), ("KEPT_SONGS", 20), ("SLICE_LISTS", 3)):
        monkeypatch.setattr(R, name, x)
    g = random.Random(5)
    songs = [f"s{'x' * (i % 40)}{i}" for i in range(60)]
    lists = {f"p{i}": g.sample(songs, g.randrange(1, 15)) for i in range(30)} | {"all": songs, "hot": [songs[0], songs[1]], "untitled": songs[:9]}
    rows = spark.createDataFrame([(p, s) for p, x in lists.items() for s in x for _ in range(g.randrange(1, 3))], "playlist_id string, song_id string").repartition(3)
    titles = {p: g.choice(["Red jazz", "blue  blue red", " jazz", "电子 Лучший", f"only {p}"]) for p in lists} | {"untitled": ""}
    info = spark.createDataFrame([*titles.items(), ("gone", "no songs")], "glid string, listname string")
    ids = spark.createDataFrame([(s, i % 3, i % 4, 0 if i % 2 else i) for i, s in enumerate(songs[:50])], "song_id string, l1 int, l2 int, l3 int")
    vectors = spark.createDataFrame([(s, [g.choice([-1.0, 0.25, 0.5]) + (d == 1) * len(s) for d in range(4)]) for s in songs[5:] + ["other"]], "song_id string, v array<float>")
    vectors = vectors.unionByName(vectors.where("song_id = 'other'"))
    for n in (1, 2):
        p = K.with_vectors(K.pairs(rows, info, ids, n), vectors.distinct().withColumn("v", F.col("v").cast("array<double>")), 4)
        p = p.withColumn("part", F.pmod(F.xxhash64("playlist_id", "song_id", "label"), F.lit(3))).localCheckpoint()
        want = K.LogisticRanker(16).fit(p.where("part > 0")).score(p.where("part = 0")).select("score", "label").collect()
        ranker = R.PairRanker(rows, info, ids, vectors, 4, n, 16, 3).fit()
        assert len(ranker.pieces) > len(set(ranker.pieces)) > 3
        got = ranker.held_out().collect()
        assert len(got) == len(want) > 100
        for label in (0, 1):
            a, b = (sorted(r["score"] for r in x if r["label"] == label) for x in (got, want))
            assert len(a) == len(b) and max(abs(x - y) for x, y in zip(a, b)) < 1e-6


def test_pair_ranker_without_ids_or_vectors(spark):
    from tunefold.operators.evaluation import binary_metrics
    from tunefold.operators.pair_ranker import PairRanker

    rows = spark.createDataFrame([("p", f"s{i}") for i in range(50)], "playlist_id string, song_id string")
    info = spark.createDataFrame([("p", "title")], "glid string, listname string")
    ids = spark.createDataFrame([], "song_id string, l1 int, l2 int, l3 int")
    vectors = spark.createDataFrame([], "song_id string, v array<float>")
    got = PairRanker(rows, info, ids, vectors, 4).fit().held_out()
    assert got.where("label = 1").count() == got.count() == rows.where(F.pmod(F.xxhash64("playlist_id", "song_id", F.lit(1)), F.lit(10)) == 0).count() > 0
    none = PairRanker(rows.limit(0), info, ids, vectors, 4).fit().held_out()
    assert binary_metrics(none).first()["f1"] == 0


def test_ranker_metrics_joins_no_vector_to_each_pair(spark, data, monkeypatch):
    from tunefold.plans import model_queries as M

    monkeypatch.setattr(K, "with_vectors", None)
    monkeypatch.setattr(K, "pairs", None)
    got = M.ranker_metrics(spark, data).first()
    assert all(0 < got[c] < 1 for c in ("accuracy", "precision", "recall", "f1"))
