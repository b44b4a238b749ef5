"""The hierarchy's weights and checkpoints, and the command line."""

import numpy as np
from pyspark.sql import functions as F

from tunefold import cli
from tunefold.config import HierarchyConfig
from tunefold.operators import clustering as C
from tunefold.sources.sinks import Checkpoints

SIZES = {"layer_clusters": (3, 4, 4), "need_clusters": (3, 2, 2), "embedding_dim": 8, "group_dims": (4, 4), "iter_limit": 5}


def vectors(spark, n=120):
    g = np.random.default_rng(4)
    return spark.createDataFrame([(f"s{i}", [float(x) for x in g.normal(size=8)]) for i in range(n)], "song_id string, v array<double>")


def ids(frame):
    return {r["song_id"]: (r["l1"], r["l2"], r["l3"]) for r in frame.collect()}


def test_each_layer_has_its_weights(spark):
    df = vectors(spark)
    plain, only_last = HierarchyConfig(**SIZES), HierarchyConfig(**SIZES, hierarchical_weights=((0.5, 0.5), (0.5, 0.5), (1.0, 0.0)))
    a, _, _ = C.fit_hierarchy(df, plain)
    b, centers, allowed = C.fit_hierarchy(df, only_last)
    a, b = ids(a), ids(b)
    assert {k: v[:2] for k, v in a.items()} == {k: v[:2] for k, v in b.items()}
    assert a != b
    assert all(x == 0 for r in centers.where("layer = 3").collect() for x in r["center"][4:])
    assert ids(C.predict(df, centers, allowed, only_last)) == b


def test_resume_by_layer(spark, tmp_path):
    df, config, folder = vectors(spark), HierarchyConfig(**SIZES), f"file://{tmp_path}/layers"
    whole = ids(C.fit_hierarchy(df, config, checkpoint=folder)[0])
    held = Checkpoints(spark, folder)
    assert held.status(6) == {"layers": 6, "done": 6, "finished": True}
    before = {k: (tmp_path / f"layers/layer={k}/_SUCCESS").stat().st_mtime_ns for k in range(6)}
    held.fs.delete(held._path("layer=4"), True)  # the run ended in its last layer
    assert held.last() == 3
    assert ids(C.fit_hierarchy(df, config, checkpoint=folder)[0]) == whole
    after = {k: (tmp_path / f"layers/layer={k}/_SUCCESS").stat().st_mtime_ns for k in range(6)}
    assert all(before[k] == after[k] for k in range(4)) and all(before[k] < after[k] for k in (4, 5))
    assert ids(C.fit_hierarchy(df, config, checkpoint=folder, resume=False)[0]) == whole


def test_surfaces(spark, data):
    got = cli.infer(spark, data, ["jazz", "rock und pop"], 5).collect()
    assert all(1 <= r["rank"] <= 5 and r["song_id"] for r in got)
    pairs = cli.voted_and_generated(spark, data)
    assert pairs.columns == ["query", "voted", "generated"] and pairs.where("size(generated) > 20").count() == 0
    beside = cli.side_by_side(spark, data, None, 5)
    assert beside.where("voted IS NOT NULL AND near IS NOT NULL").count() > 0
    one = beside.select("query").where("query IS NOT NULL").first()["query"]
    assert cli.side_by_side(spark, data, one, 5).agg(F.count_distinct("query")).first()[0] == 1


def test_songs_of_generated_ids(spark):
    made = spark.createDataFrame([(1, 0, 1, 1, 1), (1, 1, 2, 2, 2), (1, 2, 1, 1, 1)], "key long, place int, l1 int, l2 int, l3 int")
    known = spark.createDataFrame([("b", 1, 1, 1), ("a", 2, 2, 2), ("c", 1, 1, 1)], "song_id string, l1 int, l2 int, l3 int")
    got = [(r["rank"], r["song_id"]) for r in cli.generated_songs(made, known, 2).orderBy("rank").collect()]
    assert got == [(1, "b"), (2, "c")]
