import datetime as dt
import random
from collections import defaultdict

from tunefold.operators.skewed_keys import heavy_keys, per_key

SCHEMA = "k string, g string, at timestamp, n_rows int"


def test_against_brute_force(spark):
    rnd = random.Random(4)
    day = dt.datetime(2026, 1, 1)
    rows = []
    for _ in range(6000):
        k = rnd.choice(["hot"] * 6 + [f"k{i}" for i in range(40)] + [None])
        rows.append((k, rnd.choice([None, *map(str, range(300))]), rnd.choice([None, day + dt.timedelta(minutes=rnd.randrange(9999))]), 1))
    rows += [("same", "g", day, 1)] * 500
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    own = defaultdict(list)
    for k, g, at, _ in rows:
        if k is not None:
            own[k].append((g, at))
    want = {k: (len(v), len({g for g, _ in v}), min((a for _, a in v if a), default=None), max((a for _, a in v if a), default=None)) for k, v in own.items()}
    for parts in (None, 1, 13):
        got = {r["key_value"]: (r["n_rows"], r["n_groups"], r["first_at"], r["last_at"]) for r in per_key(df, "k", "g", "at", parts).collect()}
        assert got == want
    heavy = {r["key_value"] for r in heavy_keys(per_key(df, "k", "g", "at"), len(rows)).collect()}
    assert heavy == {k for k, v in own.items() if len(v) * 50 >= len(rows)}


def test_hot_key_is_spread(spark):
    df = spark.range(40_000).selectExpr("'hot' AS k", "CAST(id AS string) AS g", "timestamp'2026-01-01' AS at")
    from pyspark.sql import functions as F

    ranged = df.repartitionByRange(8, "k", "g").groupBy(F.spark_partition_id()).count().collect()
    assert len(ranged) == 8 and max(r["count"] for r in ranged) < 15_000
    assert per_key(df, "k", "g", "at", 8).first()["n_groups"] == 40_000


def test_empty_and_null(spark):
    assert per_key(spark.createDataFrame([], SCHEMA), "k", "g", "at").count() == 0
    assert per_key(spark.createDataFrame([(None, "a", None, 1)], SCHEMA), "k", "g", "at").count() == 0
    assert heavy_keys(per_key(spark.createDataFrame([], SCHEMA), "k", "g", "at"), 0).count() == 0
