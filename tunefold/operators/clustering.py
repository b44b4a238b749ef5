"""Clustering: k-means with balance, hierarchical residual quantization, quality measures."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunefold import shared
from tunefold.config import HierarchyConfig, iteration_limit

SAMPLE_LIMIT = 50_000

# ---------------------------------------------------------------- quality


def _parts(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    e = df.select("label", F.posexplode("v").alias("k", "x"))
    return e, e.groupBy("label", "k").agg(F.avg("x").alias("m"), F.count("*").alias("n"), F.sum(F.col("x") * F.col("x")).alias("xx"))


def calinski_harabasz(df: DataFrame) -> DataFrame:
    """One row; null with fewer than two labels or as many labels as rows. One pass over the elements."""
    _, m = _parts(df)
    per = m.groupBy("k").agg(F.sum("n").alias("t"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("o"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("mm"), F.sum("xx").alias("xx"), F.count("*").alias("c"))
    s = per.agg(F.sum(F.col("mm") - F.col("t") * F.col("o") * F.col("o")).alias("b"), F.sum(F.col("xx") - F.col("mm")).alias("w"), F.max("t").alias("n"), F.max("c").alias("c"))
    ok = (F.col("c") > 1) & (F.col("n") > F.col("c"))
    return s.select(F.when(ok, F.round((F.col("b") / (F.col("c") - 1)) / (F.col("w") / (F.col("n") - F.col("c"))), 6)).alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame) -> DataFrame:
    """One row: mean over labels of the worst (s_i + s_j) / d_ij. The labels' centers meet each other in blocks."""
    from tunefold.functions import vectors as V

    _, m = _parts(df)
    centers = m.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("k", "m")))["m"].alias("c"))
    s = df.join(centers, "label").groupBy("label").agg(F.avg(V.euclidean("v", "c")).alias("s"))
    have = centers.join(s, "label").select(F.monotonically_increasing_id().alias("i"), "c", "s")  # one row per label
    uri = shared.write_table(have, "davies-bouldin")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        data = shared.open_dataset(uri)
        for f in batches:
            if not len(f):
                continue
            q, own, spread = np.stack(f["c"].to_numpy()).astype("f8"), f["i"].to_numpy(), f["s"].to_numpy()
            worst = np.full(len(q), -np.inf)
            for b in data.to_batches(batch_size=4096):
                if not b.num_rows:
                    continue
                c = b.column("c").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                with np.errstate(divide="ignore"):
                    r = (spread[:, None] + b.column("s").to_numpy()[None]) / distances(q, c)
                r[own[:, None] == b.column("i").to_numpy()[None]] = -np.inf
                worst = np.maximum(worst, r.max(1))
            yield pd.DataFrame({"r": worst[np.isfinite(worst)]})

    again = df.sparkSession.read.schema(have.schema).parquet(uri)
    return again.mapInPandas(run, "r double").agg(F.round(F.avg("r"), 6).alias("davies_bouldin"))


def silhouette(df: DataFrame, dim: int) -> DataFrame:
    """One row: the mean of (b - a) / max(a, b), Euclidean; a point alone in its label counts 0. Blocks of points meet the
    whole table, which is meant to be the (bounded) metric sample."""
    uri = shared.write_table(df.select(F.col("label").cast("int").alias("label"), "v"), "silhouette")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        data = shared.open_dataset(uri)
        for f in batches:
            if not len(f):
                continue
            q = np.stack(f["v"].to_numpy()).astype("f8")
            sums: dict[int, np.ndarray] = {}
            sizes: dict[int, int] = {}
            for b in data.to_batches(batch_size=4096):
                if not b.num_rows:
                    continue
                v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype("f8")
                d = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (v * v).sum(1)[None] - 2 * q @ v.T, 0))
                own = b.column("label").to_numpy(zero_copy_only=False)
                for c in np.unique(own).tolist():
                    sums[c] = sums.get(c, 0) + d[:, own == c].sum(1)
                    sizes[c] = sizes.get(c, 0) + int((own == c).sum())
            names = np.array(sorted(sums))
            total, n = np.stack([sums[c] for c in names]), np.array([sizes[c] for c in names])
            at = np.searchsorted(names, f["label"].to_numpy())
            rows = np.arange(len(q))
            a = total[at, rows] / np.maximum(n[at] - 1, 1)
            others = total / n[:, None]
            others[at, rows] = np.inf
            b_ = others.min(0)
            s = np.where((n[at] == 1) | np.isinf(b_), 0.0, (b_ - a) / np.maximum(np.maximum(a, b_), 1e-300))
            yield pd.DataFrame({"s": s})

    return df.select(F.col("label").cast("int").alias("label"), "v").mapInPandas(run, "s double").agg(F.round(F.avg("s"), 6).alias("silhouette"))


# ---------------------------------------------------------------- fits, on arrays


def distances(x, c):
    import numpy as np

    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T, 0))


def auction(score, rounds: int = 200):
    """Balanced assignment of rows (jobs) to columns (workers) by auction: every worker gets at most ceil(N / K) jobs.
    Each of at most ``rounds`` rounds every worker bids on its best jobs above the next one's value; what the rounds leave over is placed by
    best free score, so that every job is placed once and no worker exceeds its share."""
    import numpy as np

    n, k = score.shape
    if n <= k:
        return score.argmax(1)
    each, most = n // k, -(-n // k)
    value = score.T.astype("f8").copy()
    eps = max((value.max() - value.min()) / 50, 1e-4)  # fixed values: the bid's least step
    cost = np.zeros(n)
    owner = np.full(n, -1)
    for _ in range(rounds):
        v = value - cost
        held = np.flatnonzero(owner >= 0)
        v[owner[held], held] = value[owner[held], held]
        take = min(each + 1, n)
        top = np.argpartition(-v, take - 1, axis=1)[:, :take]
        vals = np.take_along_axis(v, top, 1)
        rank = np.argsort(-vals, axis=1)
        top, vals = np.take_along_axis(top, rank, 1), np.take_along_axis(vals, rank, 1)
        bids = vals[:, :each] - vals[:, each : each + 1] + eps if take > each else vals[:, :each] * 0 + eps
        best, who = np.full(n, -np.inf), np.full(n, -1)
        for w in range(k):
            jobs, b = top[w, :each], bids[w]
            up = b > best[jobs]
            best[jobs[up]], who[jobs[up]] = b[up], w
        owner = who
        if (who >= 0).sum() >= each * k:
            break
        cost += np.where(who >= 0, np.maximum(best, eps), 0)
    out, load = np.full(n, -1), np.zeros(k, int)
    for j in np.flatnonzero(owner >= 0):
        if load[owner[j]] < most:
            out[j] = owner[j]
            load[owner[j]] += 1
    for j in np.flatnonzero(out < 0):
        free = np.flatnonzero(load < most)
        w = free[score[j, free].argmax()]
        out[j] = w
        load[w] += 1
    return out


def start_centers(x, k: int, seed: int):
    """k rows in seeded order; again from the first when there are fewer."""
    import numpy as np

    order = np.random.default_rng(seed).permutation(len(x))
    return x[np.resize(order, k)].astype("f8").copy()


def kmeans(x, k: int, limit: int, balanced: bool = False, tol: float = 1e-3, seed: int = 42):
    """Lloyd's rounds until the squared sum of center shifts is below tol; an empty cluster gets a row of its own."""
    import numpy as np

    c = start_centers(x, k, seed)
    for r in range(max(1, limit)):
        d = distances(x, c)
        a = auction(-d) if balanced else d.argmin(1)
        new = _means(x, a, c, seed + r)
        shift = np.sqrt(((new - c) ** 2).sum(1)).sum()
        c = new
        if shift**2 < tol:
            break
    return c


def least_overflow_kmeans(x, k: int, target: int, limit: int, tol: float = 1e-3, seed: int = 42):
    """Balanced rounds that keep the centers whose plain assignment overflows the target least; fresh starts every tenth
    round; the latest of equals is kept."""
    import numpy as np

    c, best, loss = start_centers(x, k, seed), None, np.inf
    for r in range(max(1, limit)):
        if r and r % 10 == 0:
            c = start_centers(x, k, seed + r)
        a = auction(-distances(x, c))
        new = _means(x, a, c, seed + r)
        shift = np.sqrt(((new - c) ** 2).sum(1)).sum()
        c = new
        now = np.maximum(np.bincount(distances(x, c).argmin(1), minlength=k) - target, 0).sum()
        if now <= loss:
            best, loss = c, now
        if shift**2 < tol:
            break
    return best


def _means(x, a, c, seed: int):
    import numpy as np

    n = np.bincount(a, minlength=len(c))
    out = c.copy()
    order = np.argsort(a, kind="stable")
    full = n > 0
    out[full] = np.add.reduceat(x[order], (np.cumsum(n) - n)[full], axis=0) / n[full][:, None]
    for j in np.flatnonzero(~full):
        out[j] = x[np.random.default_rng(seed * 1009 + int(j)).integers(len(x))]
    return out


def pick_candidates(points, candidates, need: int, seed: int = 42):
    """The ``need`` candidates of one (l1, l2) group: for each target in turn the nearest unused one, then the lowest
    unused. Targets: the points if few, a seeded choice of ``need`` if fewer than twice as many, else sub-centers."""
    import numpy as np

    m = len(points)
    if m == 0:
        return []
    if m <= need:
        targets = points
    elif m < 2 * need:
        targets = points[np.random.default_rng(seed).permutation(m)[:need]]
    else:
        targets = kmeans(points, need, iteration_limit(m, need, 2, 20), balanced=True, seed=seed)
    d = distances(targets, candidates)
    used = np.zeros(len(candidates), bool)
    for row in d[:need]:
        used[np.where(used, np.inf, row).argmin()] = True
    for j in np.flatnonzero(~used)[: need - int(used.sum())]:
        used[j] = True
    return np.flatnonzero(used)[:need].tolist()


# ---------------------------------------------------------------- the hierarchy, on tables


def layer_weights(config: HierarchyConfig, layer: int) -> list[float]:
    """A layer's weight of every dimension."""
    return [w for g, w in zip(config.group_dims, config.weights[layer]) for _ in range(g)]


class _Kept:
    """Results of the fit in their order, in the shared folder or as checkpoints; what follows a new one is made anew."""

    def __init__(self, spark, folder: str | None, resume: bool) -> None:
        from tunefold.sources.sinks import Checkpoints

        self.held = Checkpoints(spark, folder) if folder else None
        self.old, self.next = self.held is not None and resume, 0

    def __call__(self, name: str, make) -> DataFrame:
        if self.held is None:
            return shared.materialise(make(), f"hierarchy-{name}")
        at, self.next = self.next, self.next + 1
        self.old = self.old and self.held.complete(at)
        if not self.old:
            self.held.save(at, make())
        return self.held.load(at)


def fit_hierarchy(df: DataFrame, config: HierarchyConfig, sample_limit: int = SAMPLE_LIMIT, base_limit: int | None = None, checkpoint: str | None = None, resume: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ids, centers, allowed) of a three-layer hierarchy over (song_id, v).

    * Centers of a layer, or of one parent, are fitted on at most about ``sample_limit`` of its vectors, taken by hash;
      all vectors are assigned. Each layer has its own row of weights, by which its vectors are scaled group by group.
    * Each layer's result is written: to the shared folder, or under ``checkpoint``. There a later call goes on after the
      last layer that is complete, unless ``resume`` is false; what a layer builds on must not have changed.
    * ids (song_id, l1, l2, l3), centers (layer, parent, slot, center), allowed (l1, l2, candidate, slot): 0 <= l3 < need.
    * Null vectors and those of another width take no part. An empty table gives empty results.
    """
    import numpy as np
    import pandas as pd

    from tunefold.functions import vectors as V
    from tunefold.operators import semantic_ids as S

    dim, need = config.embedding_dim, config.need_clusters
    base = base_limit or config.iter_limit
    kept = _Kept(df.sparkSession, checkpoint, resume)
    src = df.select("song_id", F.col("v").cast("array<double>").alias("v")).where(f"size(v) = {dim}")
    points = shared.materialise(src.withColumn("v", V.weighted("v", layer_weights(config, 0))), "hierarchy-0")
    n = points.count()

    def stack(f):
        return np.stack(f.sort_values("song_id")["v"].to_numpy()).astype("f8")  # the same fit in whatever order rows come

    def frame(c, **extra):
        return pd.DataFrame({**extra, "slot": range(len(c)), "center": [r.tolist() for r in c]})

    def sample(p, most):
        return p.where(F.pmod(F.xxhash64("song_id"), F.lit(1_000_003)) <= int(min(1.0, most / max(n, 1)) * 1_000_003))

    # layer 1: one fit on a sample, plain assignment
    t1 = need[1] * need[2]
    lim1 = iteration_limit(min(n, sample_limit), need[0], 0, base)

    def first(key, f):
        return frame(least_overflow_kmeans(stack(f), need[0], t1, lim1, seed=config.seed))

    c1 = kept("c1", lambda: sample(points, sample_limit).groupBy(F.lit(0).alias("g")).applyInPandas(first, "slot int, center array<double>"))
    a1 = S.nearest_centers(points, c1).withColumnRenamed("slot", "l1")
    r1_ = a1.join(F.broadcast(c1.withColumnRenamed("slot", "l1")), "l1").select("song_id", "l1", V.residual("v", "center", list(config.group_dims), config.normalize_residuals).alias("v"))
    r1 = kept("r1", lambda: r1_.withColumn("v", V.weighted("v", layer_weights(config, 1))))

    # layer 2: a fit in every parent; a large parent is fitted on a sample
    def second(key, f):
        x = stack(f)
        lim = iteration_limit(len(x), need[1], 1, base, sub=True)
        return frame(least_overflow_kmeans(x, need[1], need[2], lim, seed=config.seed), l1=int(key[0]))

    sizes = r1.groupBy("l1").agg(F.count("*").alias("__n"))
    taken = r1.join(F.broadcast(sizes), "l1").where(F.pmod(F.xxhash64("song_id", F.lit(1)), F.lit(1_000_003)) <= F.least(F.lit(1.0), F.lit(float(sample_limit)) / F.col("__n")) * 1_000_003)
    c2 = kept("c2", lambda: taken.groupBy("l1").applyInPandas(second, "l1 int, slot int, center array<double>"))
    a2 = S.nearest_centers(r1, c2, ["l1"]).withColumnRenamed("slot", "l2")
    r2_ = a2.join(c2.withColumnRenamed("slot", "l2"), ["l1", "l2"]).select("song_id", "l1", "l2", V.residual("v", "center", list(config.group_dims), config.normalize_residuals).alias("v"))
    r2 = kept("r2", lambda: r2_.withColumn("v", V.weighted("v", layer_weights(config, 2))))

    # layer 3: two fits over all residuals give the candidates; each group may use ``need`` of them
    def third(key, f):
        x = stack(f)
        k = config.layer_clusters[2]
        c = np.concatenate([kmeans(x, k, 20, balanced=b, seed=config.seed + i) for i, b in ((0, True), (1, False))])
        return frame(c)

    c3 = kept("c3", lambda: sample(r2, sample_limit).groupBy(F.lit(0).alias("g")).applyInPandas(third, "slot int, center array<double>"))
    table = c3.orderBy("slot").collect()  # twice the last layer's clusters: fixed by the configuration
    book = np.array([r["center"] for r in table])

    def allow(key, f):
        picked = pick_candidates(stack(f), book, need[2], config.seed)
        return pd.DataFrame({"l1": int(key[0]), "l2": int(key[1]), "candidate": picked, "slot": range(len(picked))})

    groups = r2.withColumn("__r", F.pmod(F.xxhash64("song_id", F.lit(2)), F.lit(1_000_003)))
    group_sizes = r2.groupBy("l1", "l2").agg(F.count("*").alias("__n"))
    bounded = groups.join(group_sizes, ["l1", "l2"]).where(F.col("__r") <= F.least(F.lit(1.0), F.lit(float(sample_limit)) / F.col("__n")) * 1_000_003)
    allowed = kept("allowed", lambda: bounded.groupBy("l1", "l2").applyInPandas(allow, "l1 int, l2 int, candidate int, slot int"))
    options = allowed.join(F.broadcast(c3.withColumnRenamed("slot", "candidate")), "candidate").select("l1", "l2", "slot", "center")
    ids = S.nearest_centers(r2, options, ["l1", "l2"]).select("song_id", "l1", "l2", F.col("slot").alias("l3"))
    centers = c1.select(F.lit(1).alias("layer"), F.lit(0).alias("parent"), "slot", "center").unionByName(c2.select(F.lit(2).alias("layer"), F.col("l1").alias("parent"), "slot", "center")).unionByName(c3.select(F.lit(3).alias("layer"), F.lit(0).alias("parent"), "slot", "center"))
    return ids, centers, allowed


def predict(df: DataFrame, centers: DataFrame, allowed: DataFrame, config: HierarchyConfig) -> DataFrame:
    """(song_id, l1, l2, l3) of new vectors under a fitted hierarchy; works on a stream as well as on a table."""
    from tunefold.functions import vectors as V
    from tunefold.operators import semantic_ids as S

    x = df.select("song_id", F.col("v").cast("array<double>").alias("v")).where(f"size(v) = {config.embedding_dim}")
    c1, c2, c3 = (centers.where(F.col("layer") == k) for k in (1, 2, 3))
    groups = list(config.group_dims)

    def step(points, book, parent, name, layer):
        points = points.withColumn("v", V.weighted("v", layer_weights(config, layer)))
        a = S.nearest_centers(points, book, parent).withColumnRenamed("slot", name)
        return a.join(F.broadcast(book.withColumnRenamed("slot", name)) if not parent else book.withColumnRenamed("slot", name), [*(parent or []), name]).withColumn("v", V.residual("v", "center", groups, config.normalize_residuals)).drop("center", "d")

    one = step(x, c1.select("slot", "center"), None, "l1", 0)
    two = step(one, c2.select(F.col("parent").alias("l1"), "slot", "center"), ["l1"], "l2", 1).withColumn("v", V.weighted("v", layer_weights(config, 2)))
    options = allowed.join(F.broadcast(c3.select(F.col("slot").alias("candidate"), "center")), "candidate").select("l1", "l2", "slot", "center")
    return S.nearest_centers(two, options, ["l1", "l2"]).select("song_id", "l1", "l2", F.col("slot").alias("l3"))


def residual_quantization(df: DataFrame, dim: int, clusters: list[int], seed: int = 42) -> DataFrame:
    """(song_id, level, slot): plain levels without hierarchy or normalization, by MLlib k-means of 20 rounds."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from tunefold.functions import vectors as V

    now = shared.materialise(df.select("song_id", F.col("v").cast("array<double>").alias("v")).where(f"size(v) = {dim}"), "rq-0")
    out = None
    for level, k in enumerate(clusters):
        model = KMeans(k=k, maxIter=20, seed=seed + level, featuresCol="x", predictionCol="slot").fit(now.select(array_to_vector("v").alias("x")))
        done = model.transform(now.withColumn("x", array_to_vector("v")))
        centers = df.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "slot int, center array<double>")
        kept = shared.materialise(done.join(F.broadcast(centers), "slot").select("song_id", "slot", V.residual("v", "center", [dim], False).alias("v")), f"rq-{level + 1}")
        part = kept.select("song_id", F.lit(level).alias("level"), "slot")
        out = part if out is None else out.unionByName(part)
        now = kept.select("song_id", "v")
    return out
