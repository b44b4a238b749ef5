import json

from pyspark.sql import functions as F

from tunefold.config import HierarchyConfig
from tunefold.operators import clustering as C
from tunefold.operators import playlists as P
from tunefold.sources import readers as R
from tunefold.sources import sinks as S


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_playlists(spark, tmp_path):
    p = write(tmp_path / "a.tsv", "p1\ts1\np1\ts2\tx\nbroken\np2\t\"s3\n")
    got = [(r["playlist_id"], r["song_id"]) for r in R.playlist_song(spark, p).orderBy("pos").collect()]
    assert got == [("p1", "s1"), ("p1", "s2"), ("p2", '"s3')]
    p = write(tmp_path / "b.tsv", "glid\tlistname\tcreator\n1\told\tc\n1\tnew\t\n\tnone\tc\n")
    got = R.playlist_info(spark, p).collect()
    assert [(r["glid"], r["listname"], r["creator"], r["description"]) for r in got] == [("1", "new", "", "")]
    p = write(tmp_path / "c.tsv", " 7 \t n \ts\nx\ty\n\tn\ts\n")
    assert [tuple(r) for r in R.song_info(spark, p).collect()] == [("7", "n", "s")]


def test_vectors(spark, tmp_path):
    p = write(tmp_path / "v.csv", "mixsongid,1,2\na,1.5,2\nb,1\nc,x,2\nd,3,4\n")
    assert {r["song_id"]: r["v"] for r in R.song_vectors(spark, p, 2, header=True).collect()} == {"a": [1.5, 2.0], "d": [3.0, 4.0]}
    only = spark.createDataFrame([("d",)], "song_id string")
    assert R.song_vectors(spark, p, 2, only=only).count() == 1
    assert R.song_vectors(spark, p, 2, limit=1).count() <= 1


def test_ids(spark, tmp_path):
    lines = ['{"song_id": "1", "semantic_ids": [1, 2, 3]}', "{broken", '{"song_id": "2"}', '{"song_id": "3", "semantic_ids": [1]}', '{"song_id": "4", "semantic_ids": "x"}']
    good, bad = R.semantic_ids(spark, write(tmp_path / "i.jsonl", "\n".join(lines)))
    assert [r["song_id"] for r in good.collect()] == ["1"] and bad.first()["rejected"] == 4
    assert R.first_level_index(good).first()["songs"] == 1


def test_votes(spark, tmp_path):
    p = write(tmp_path / "v.txt", "q\t1:2,bad\nno tab\na\tb\tc\n")
    got = R.votes(spark, p).collect()
    assert len(got) == 1 and [tuple(x) for x in got[0]["songs"]] == [("1", 2)]
    p = write(tmp_path / "q.csv", "query,song_infos\n 电音 ,1:0@@2:1\n,3:0\n", "gbk")
    assert [r["query"] for r in R.query_vote(spark, p).collect()] == ["电音"]


def test_corpora(spark, tmp_path):
    assert R.corpus_text(spark, write(tmp_path / "t.txt", "a b  c\n\nd\n")).collect()[0]["songs"] == ["a", "b", "c"]
    assert R.corpus_rows(spark, write(tmp_path / "c.tsv", "1\tt\ts\nbad\n")).count() == 1
    df = spark.createDataFrame([("t", "1", 1), ("u", "2", 0)], "text string, song_id string, label int")
    S.pairs(df, f"{tmp_path}/pairs")
    assert sorted(tuple(r) for r in R.ranking_pairs(spark, f"{tmp_path}/pairs").collect()) == [("t", "1", 1), ("u", "2", 0)]


def test_sinks(spark, tmp_path):
    lists = spark.createDataFrame([("p", ["a", "b"])], "playlist_id string, songs array<string>")
    S.corpus_text(lists, f"{tmp_path}/lists")
    assert R.playlist_song(spark, f"{tmp_path}/lists").first()["song_id"] == "a b"
    v = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "song_id string, v array<double>")
    S.vectors_csv(v, f"{tmp_path}/v", spark.createDataFrame([("b", 9), ("a", 1)], "song_id string, n int"))
    assert [r["song_id"] for r in R.song_vectors(spark, f"{tmp_path}/v", 2).collect()] == ["b", "a"]
    ids = spark.createDataFrame([("a", 1, 2, 3), ("b", 1, 2, 3)], "song_id string, l1 int, l2 int, l3 int")
    assert S.semantic_ids(ids, f"{tmp_path}/i") == 1
    assert R.semantic_ids(spark, f"{tmp_path}/i")[0].count() == 2
    S.summary(spark.range(1).select(F.lit(3).alias("n")), f"{tmp_path}/s")
    assert json.loads(spark.read.text(f"{tmp_path}/s").first()["value"]) == {"n": 3}
    rows = spark.createDataFrame([("p", "a"), ("q", "a"), ("p", "b")], "playlist_id string, song_id string")
    S.song_playlists_json(rows, f"{tmp_path}/m")
    assert spark.read.json(f"{tmp_path}/m").where("song_id = 'a'").first()["playlists"] == ["p", "q"]
    v.write.parquet(f"{tmp_path}/x1")
    S.compact(spark, [f"{tmp_path}/x1", f"{tmp_path}/x1"], f"{tmp_path}/x2")
    assert spark.read.parquet(f"{tmp_path}/x2").count() == 4


def test_checkpoints(spark, tmp_path):
    c = S.Checkpoints(spark, f"file://{tmp_path}/layers")
    assert c.last() == -1
    c.save(0, spark.range(3))
    c.save(0, spark.range(4))
    c.save(2, spark.range(1))
    assert c.last() == 0 and c.load(0).count() == 4
    assert c.status(3) == {"layers": 3, "done": 1, "finished": False}
    c.clear()
    assert c.last() == -1


def test_model_round_trip(spark, tmp_path, data):
    from tunefold.plans.model_queries import SMALL
    from tunefold.plans.semantic_queries import points

    p = points(spark, data).select("song_id", "v")
    fitted, centers, allowed = C.fit_hierarchy(p, SMALL)
    S.save_model(spark, f"{tmp_path}/model", SMALL, centers, allowed)
    config, centers, allowed = S.load_model(spark, f"{tmp_path}/model")
    assert config == SMALL and isinstance(config, HierarchyConfig)
    assert sorted(map(tuple, C.predict(p, centers, allowed, config).collect())) == sorted(map(tuple, fitted.collect()))


def test_islands(spark):
    rows = spark.createDataFrame([("f", 0, "p1"), ("f", 1, "p2"), ("f", 2, "p1")], "file string, at int, playlist_id string")
    assert P.islands(rows, "file", "at").count() == 3
    assert rows.select("playlist_id").distinct().count() == 2


def test_query_vote_keeps_empty_fields_and_line_ends(spark, tmp_path):
    from tunefold.plans.file_queries import file_query_vote

    rows = [("a", "1:0", "", None), ("", "1:0", "x", ""), ("two\nlines", "1:0", "cr\rx", "\r\n"), (None, "1:0", "x", "y"), ("b", None, "x", "y"), ('"b\\"', "", '"', '""')]
    spark.createDataFrame(rows, "query string, song_infos string, search_pv string, cnt string").write.parquet(f"{tmp_path}/query_vote.parquet")
    got = [tuple(r) for r in file_query_vote(spark, str(tmp_path)).collect()]
    want = [("a", "1:0", "", None), ("", "1:0", "x", ""), ("two\nlines", "1:0", "cr\rx", ""), ('"b\\"', "", '"', '""')]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_cached_unit_vectors_are_small_and_whole(spark, tmp_path):
    from tunefold.sources import index_cache

    rows = [("a", [3.0, 4.0]), ("z", [0.0, 0.0]), ("n", None), ("b", [1.0]), ("e", []), ("x", [1.0, None])]
    df = spark.createDataFrame(rows, "song_id string, v array<float>").coalesce(1)
    source = write(tmp_path / "source", "x")
    for fresh in (True, False):
        got, built = index_cache.unit_vectors(spark, source, df, f"{tmp_path}/cache")
        assert built == fresh
        found = {r["song_id"]: r["v"] for r in got.collect()}
        assert {k: found[k] for k in "aznbe"} == {"a": [0.6, 0.8], "z": [0.0, 0.0], "n": None, "b": [1.0], "e": []} and len(found) == 6
    kept = spark.read.parquet(*[str(p) for p in (tmp_path / "cache").iterdir()])
    assert dict(kept.dtypes)["v"] == "array<float>"
