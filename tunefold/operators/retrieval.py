"""Exact similarity search of a stated query set against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunefold import shared

BLOCK = 2048
QUERIES = 65_536


def _leading(names, scores, k: int):
    """Places of the k best scores, ties by name; only what reaches the k-th score is sorted."""
    import numpy as np

    at = np.flatnonzero(scores >= np.partition(scores, -k)[-k]) if k < len(scores) else np.arange(len(scores))
    return at[np.lexsort((names[at], -scores[at]))[:k]]


def _search(uri: str, k: int, dim: int, metric: str):
    """Every Arrow batch of the collection against every block of queries; keeps the k best per query in the partition."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        data = shared.open_dataset(uri)
        blocks = [b for b in data.to_batches(batch_size=BLOCK)] if data else []
        best: dict[int, tuple] = {}

        def matrix(col):
            col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
            return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype("f8")

        prepared = []
        for b in blocks:
            q = matrix(b.column("v"))
            n = np.sqrt((q * q).sum(1, keepdims=True))
            prepared.append((b.column("query").to_pylist(), q / np.where(n > 0, n, 1) if metric == "cosine" else q, b.column("skip").to_pylist()))
        for b in batches:
            if not b.num_rows:
                continue
            names = np.array(b.column(0).to_pylist(), dtype=object)
            v = matrix(b.column(1))
            if metric == "cosine":
                n = np.sqrt((v * v).sum(1, keepdims=True))
                v = v / np.where(n > 0, n, 1)
            for x, (_, q, skips) in enumerate(prepared):
                s = q @ v.T if metric == "cosine" else -np.sqrt(np.maximum((q * q).sum(1)[:, None] + (v * v).sum(1)[None] - 2 * q @ v.T, 0))
                place = {n: i for i, n in enumerate(names.tolist())}
                for i, skip in enumerate(skips):
                    for name in skip or ():
                        if name in place:
                            s[i, place[name]] = -np.inf
                own = np.broadcast_to(names, s.shape)
                if x in best:
                    s, own = np.concatenate([best[x][0], s], 1), np.concatenate([best[x][1], own], 1)
                s = np.round(s, 9)
                order = np.stack([_leading(own[i], s[i], k) for i in range(len(s))])
                best[x] = np.take_along_axis(s, order, 1), np.take_along_axis(own, order, 1)
        for x, (s, own) in best.items():
            ids = prepared[x][0]
            rows = [(q, n, float(v)) for q, ss, ns in zip(ids, s, own) for v, n in zip(ss, ns) if v != -np.inf]
            if rows:
                cols = list(zip(*rows))
                yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], names=["query", "song_id", "score"])

    return run


def top_k(queries: DataFrame, vectors: DataFrame, k: int, dim: int, metric: str = "cosine") -> DataFrame:
    """(query, rank, song_id, score) of the k best rows per query; ties at nine decimals go to the smaller id.

    ``queries`` has (query, v, skip): skip lists ids that mustn't come out. ``vectors`` has (song_id, v). Vectors of another
    width take no part. Per partition of the collection only k rows per query leave the task, and a task holds at most
    about ``QUERIES`` queries: more of them make more passes over the collection.
    """
    fits = f"size(v) = {dim}"
    asked = shared.materialise(queries.where(fits).select(F.col("query").cast("string"), F.col("v").cast("array<double>").alias("v"), F.col("skip").cast("array<string>").alias("skip")), "queries")
    passes = max(1, -(-asked.count() // QUERIES))
    uri = shared.write_table(asked.withColumn("pass", F.pmod(F.xxhash64("query"), F.lit(passes)).cast("int")).repartition("pass"), "query-passes", "pass")
    slim = vectors.where(fits).select(F.col("song_id").cast("string"), F.col("v").cast("array<double>").alias("v"))
    parts = [slim.mapInArrow(_search(f"{uri}/pass={i}", k, dim, metric), "query string, song_id string, score double") for i in range(passes)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "song_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "rank", "song_id", "score")


def seed_centroids(seeds: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query, v): the element-wise mean of the seeds' vectors; a query none of whose seeds has one is left out."""
    own = seeds.join(vectors, "song_id").select("query", F.posexplode("v").alias("k", "x"))
    means = own.groupBy("query", "k").agg(F.avg("x").alias("m"))
    return means.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("k", "m")))["m"].alias("v"))


def _search_clusters(uri: str, k: int, dim: int):
    """Rows of a cluster against the queries of the same cluster; keeps the k best per query and Arrow batch."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def matrix(col):
            m = col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype("f8")
            n = np.sqrt((m * m).sum(1, keepdims=True))
            return m / np.where(n > 0, n, 1)

        held: dict[int, object] = {}
        for b in batches:
            names, v = np.array(b.column(0).to_pylist(), dtype=object), matrix(b.column(1)) if b.num_rows else None
            own = np.array(b.column(2).to_pylist())
            rows = []
            for c in np.unique(own).tolist():
                if c not in held:
                    held[c] = shared.open_dataset(f"{uri}/cluster={c}")
                data = held[c]
                at = np.flatnonzero(own == c)
                for q in data.to_batches(columns=["query", "v"], batch_size=BLOCK) if data else ():
                    if not q.num_rows:
                        continue
                    s = np.round(matrix(q.column("v")) @ v[at].T, 9)
                    for i, name in enumerate(q.column("query").to_pylist()):
                        near = _leading(names[at], s[i], k + 1)
                        rows += [(name, names[at[j]], float(s[i, j])) for j in near if names[at[j]] != name][:k]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], names=["query", "song_id", "score"])

    return run


def in_cluster(queries: DataFrame, vectors: DataFrame, k: int, dim: int) -> DataFrame:
    """(query, rank, song_id, score): neighbours of the same cluster only, without the query itself. ``queries`` (query, v,
    cluster), ``vectors`` (song_id, v, cluster), cluster a number. Queries lie in the shared folder by cluster and meet the
    rows in blocks; no pair leaves a task but the k best per batch."""
    fits = f"size(v) = {dim} AND cluster IS NOT NULL"
    uri = shared.write_table(queries.where(fits).select(F.col("query").cast("string"), F.col("v").cast("array<double>").alias("v"), F.col("cluster").cast("long").alias("cluster")).repartition("cluster"), "cluster-queries", "cluster")
    slim = vectors.where(fits).select(F.col("song_id").cast("string"), F.col("v").cast("array<double>").alias("v"), F.col("cluster").cast("long").alias("cluster"))
    found = slim.mapInArrow(_search_clusters(uri, k, dim), "query string, song_id string, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "song_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "rank", "song_id", "score")
