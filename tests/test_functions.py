import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunefold.config import HierarchyConfig, iteration_limit
from tunefold.functions import soft_dtw as D
from tunefold.functions import text as X
from tunefold.functions import vectors as V
from tunefold.functions import vocabulary as Y
from tunefold.operators import clustering as C
from tunefold.operators.ordering import with_position


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, v)
    return df.select(column.alias("x")).first()["x"]


def test_votes(spark):
    got = one(spark, X.vote_items("s"), s=F.lit("10:0,11:1,bad,12:x,13:2:3"))
    assert [tuple(r) for r in got] == [("10", 0), ("11", 1)]


def test_gears(spark):
    got = one(spark, X.gear_items("s"), s=F.lit("32189764:-1@@27709143:0@@111:1@@bad@@222:x@@ 333 :0:9"))
    assert [tuple(r) for r in got] == [("32189764", -1), ("27709143", 0), ("111", 1), ("333", 0)]
    assert one(spark, X.gear_items("s"), s=F.lit(None).cast("string")) is None


def test_triples(spark):
    s = "<id_l1_3> <id_l2_99> <id_l3_7> <id_l1_3> <id_l1_4> <id_l2_1> <id_l3_2> <id_l2_5> <eos>"
    assert [tuple(r) for r in one(spark, X.triples("s"), s=F.lit(s))] == [(3, 99, 7), (4, 1, 2)]
    assert one(spark, X.triples("s"), s=F.lit("")) == []


def test_flat_triples(spark):
    ids = F.array(*[F.lit(x) for x in (1, 2, 3, 4, 5, 6, 1, 2, 3, 9)])
    assert one(spark, X.flat_triples("s"), s=ids) == [[1, 2, 3], [4, 5, 6]]
    assert one(spark, X.flat_triples("s"), s=F.array(F.lit(1))) == []


def test_truncation(spark):
    tokens = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(130)), lambda i: X.id_tokens(i, i, i)))
    got = one(spark, X.sequence_text(tokens, 383)).split(" ")
    assert len(got) == 384 and got[-1] == "<eos>" and got[-2] == "<id_l2_128>"


def test_padding(spark):
    ids = F.array(F.lit(5), F.lit(6)).cast("array<long>")
    assert one(spark, X.padded(ids, 4)) == [5, 6, 0, 0]
    assert one(spark, X.attention_mask(ids, 4)) == [1, 1, 0, 0]
    assert one(spark, X.attention_mask(ids, 1)) == [1]


def test_prefixes():
    assert X.prefix("10,55") == (10, 55)
    for bad in ("a", "1,2,3,4"):
        with pytest.raises(ValueError):
            X.prefix(bad)
    assert X.is_prefix_query("127") and not X.is_prefix_query("12345")


@pytest.mark.parametrize(("args", "limit"), [((1000, 32, 0, 50), 12), ((1_800_000, 128, 0, 100), 150), ((14_000, 128, 1, 100, True), 25), ((3_000, 128, 1, 100, True), 12)])
def test_iteration_limit(args, limit):
    assert iteration_limit(*args) == limit


def test_config():
    assert HierarchyConfig().weights == ((1.0,),) * 3
    for bad in ({"group_dims": (500,)}, {"hierarchical_weights": ((1.0,),)}, {"hierarchical_weights": ((1.0, 2.0),) * 3}):
        with pytest.raises(ValueError):
            HierarchyConfig(**bad)


def recurrence(x, y, gamma):
    n, m = len(x), len(y)
    r = np.full((n + 1, m + 1), np.inf)
    r[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            a = np.array([-r[i - 1, j - 1], -r[i - 1, j], -r[i, j - 1]]) / gamma
            r[i, j] = ((x[i - 1] - y[j - 1]) ** 2).sum() - gamma * (a.max() + np.log(np.exp(a - a.max()).sum()))
    return r[n, m]


def test_soft_dtw():
    assert D.soft_dtw([0.0], [1.0]) == 1.0
    g = np.random.default_rng(1)
    for n, m, w in ((17, 15, 2), (64, 64, 2), (20, 31, 1)):
        x, y = g.normal(size=(n, w)), g.normal(size=(m, w))
        for gamma in (0.1, 1.0):
            assert math.isclose(D.soft_dtw(x, y, gamma), recurrence(x, y, gamma), rel_tol=1e-9)
    x = g.normal(size=30)
    assert abs(D.normalized_soft_dtw(x, x)) < 1e-9
    assert D.soft_dtw(x, x[::-1], 1.0, 3) >= D.soft_dtw(x, x[::-1], 1.0)


def test_residual(spark):
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert np.allclose(one(spark, V.residual(arr(3, 4), arr(0, 0), [2])), [0.6, 0.8], atol=1e-7)
    assert one(spark, V.residual(arr(3, 4), arr(3, 4), [2])) == [0.0, 0.0]
    assert one(spark, V.residual(arr(3, 4), arr(1, 1), [2], False)) == [2.0, 3.0]
    assert one(spark, V.cosine(arr(0, 0), arr(1, 1))) is None
    assert one(spark, V.normalized(arr(0, 0))) == [0.0, 0.0]


@pytest.mark.parametrize(("n", "k"), [(40, 4), (41, 4), (7, 3), (3, 5)])
def test_auction(n, k):
    score = -np.random.default_rng(n).random((n, k))
    a = C.auction(score)
    assert len(a) == n and a.min() >= 0 and a.max() < k
    if n > k:
        assert np.bincount(a, minlength=k).max() <= -(-n // k)


def test_pick_candidates():
    g = np.random.default_rng(2)
    cand = g.normal(size=(16, 3))
    for m in (0, 1, 3, 5, 30):
        got = C.pick_candidates(g.normal(size=(m, 3)), cand, 4)
        assert len(got) == len(set(got)) == (4 if m else 0)


def test_position(spark):
    values = random.Random(3).sample(range(10_000), 500)
    df = with_position(spark.createDataFrame([(v,) for v in values], "v int").repartition(5), "v")
    assert [r["v"] for r in df.orderBy("position").collect()] == sorted(values)
    assert {r["position"] for r in df.collect()} == set(range(500))
    assert with_position(spark.createDataFrame([], "v int"), "v").count() == 0


def test_vocabulary(spark):
    assert Y.table(spark).count() == Y.size() == 518
    text = "<id_l1_0> <id_l2_127> <id_l3_255> <eos>"
    ids, labels = Y.encode(F.lit(text), 6)
    row = spark.range(1).select(ids.alias("ids"), labels.alias("labels"), Y.decode(ids).alias("text")).first()
    assert row["ids"] == [0, 255, 511, 513, 515, 515] and row["labels"] == [0, 255, 511, 513, -100, -100]
    assert row["text"] == text
    unknown, _ = Y.encode(F.lit("<id_l1_128> word"), 2)
    assert spark.range(1).select(unknown.alias("x")).first()["x"] == [514, 514]


def test_masked_scores(spark):
    from tunefold.operators import semantic_ids as S

    ids = spark.createDataFrame([("a", 0, 0, 0), ("b", 0, 2, 1), ("c", 5, 1, 1)], "song_id string, l1 int, l2 int, l3 int")
    asked = spark.createDataFrame([(1, []), (2, [0]), (3, [0, 0]), (4, [9]), (5, [0, 0, 0])], "key int, prefix array<int>")
    got = {r["key"]: r["allowed"] for r in S.allowed_next(asked, ids, 2).collect()}
    assert got == {1: [0, 5], 2: [0, 2], 3: [0], 4: [-1], 5: [0, 1, -1]}
    scores = F.array(*[F.lit(float(i)) for i in range(3)])
    assert one(spark, S.masked_scores(scores, F.array(F.lit(0), F.lit(2)))) == [0.0, float("-inf"), 2.0]
    stats = {(r["level"], r["children"]): r["nodes"] for r in S.trie_stats(ids).collect()}
    assert stats == {(0, 2): 1, (1, 2): 1, (1, 1): 1, (2, 1): 3, (3, 3): 1}


def test_command_line():
    from tunefold.cli import parser

    a = parser().parse_args(["train", "in", "out", "--mode", "prod", "--no-resume"])
    assert a.mode == "prod" and not a.resume and not a.clear_checkpoints
    assert parser().parse_args(["compare", "in", "jazz", "rock"]).keywords == ["jazz", "rock"]
