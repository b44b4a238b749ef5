"""Training pairs for a ranker, a baseline ranker and a baseline candidate generator.

The generator and the ranker are plain baselines behind the two protocols; they don't stand for neural models.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunefold import shared
from tunefold.operators.ordering import with_position

SPARE = 3
BLOCK_ROWS = 1_000_000


class CandidateGenerator(Protocol):
    def generate(self, prompts: DataFrame) -> DataFrame:
        """(key, text) to (key, place, l1, l2, l3)."""


class Ranker(Protocol):
    def score(self, pairs: DataFrame) -> DataFrame:
        """(text, v) and other columns to the same with ``score``."""


def positives(rows: DataFrame, info: DataFrame) -> DataFrame:
    titled = info.where("listname IS NOT NULL AND listname <> ''").select(F.col("glid").alias("playlist_id"), F.col("listname").alias("text"))
    return rows.select("playlist_id", "song_id").distinct().join(titled, "playlist_id")


def hard_negatives(pos: DataFrame, ids: DataFrame, n: int = 1) -> DataFrame:
    """(playlist_id, text, song_id, negative): up to n songs with the positive's semantic id that aren't in its playlist, in
    seeded order, of all songs of the id."""
    members = ids.select(F.col("song_id").alias("negative"), "l1", "l2", "l3")
    placed = pos.join(ids, "song_id")
    held = placed.groupBy("playlist_id", "l1", "l2", "l3").agg(F.collect_set("song_id").alias("held"))
    free = placed.join(held, ["playlist_id", "l1", "l2", "l3"]).join(members, ["l1", "l2", "l3"]).where(~F.array_contains("held", F.col("negative")))
    w = Window.partitionBy("playlist_id", "song_id").orderBy(F.md5(F.concat_ws("|", "playlist_id", "song_id", "negative")), "negative")
    return free.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).select("playlist_id", "text", "song_id", "negative")


def random_negatives(pos: DataFrame, ids: DataFrame, hard: DataFrame, n: int = 1) -> DataFrame:
    """For positives with an id but fewer than n hard negatives: songs from outside the playlist, the missing number.

    All songs with an id stand in one seeded order; a positive takes the first free ones from a seeded place of its own. So
    many places more than it lacks as its playlist holds songs are enough; most are served by a few. A playlist
    gets fewer only if no more songs are outside it.
    """
    have = hard.groupBy("playlist_id", "song_id").agg(F.count("*").alias("have"))
    short = pos.join(ids.select("song_id"), "song_id", "left_semi").join(have, ["playlist_id", "song_id"], "left").withColumn("lacks", F.lit(n) - F.coalesce("have", F.lit(0))).where("lacks > 0")
    order = shared.materialise(with_position(ids.select(F.col("song_id").alias("negative")).distinct(), F.md5("negative"), "negative", name="at"), "negatives")
    total = order.count()
    inside = pos.select("playlist_id", F.col("song_id").alias("negative")).distinct()
    holds = inside.join(order, "negative", "left_semi").groupBy("playlist_id").agg(F.count("*").alias("holds"))
    start = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", "playlist_id", "song_id")), 1, 15), 16, 10).cast("long"), F.lit(max(1, total)))
    short = shared.materialise(short.join(holds, "playlist_id").withColumn("start", start).select("playlist_id", "text", "song_id", "lacks", "holds", "start"), "short-positives")
    key = ["playlist_id", "text", "song_id"]

    def drawn(some: DataFrame, spare) -> DataFrame:
        places = F.sequence(F.lit(0), (F.least(F.col("lacks") + spare, F.lit(total)) - 1).cast("int"))
        tried = some.withColumn("step", F.explode(places)).withColumn("at", F.pmod(F.col("start") + F.col("step"), F.lit(max(1, total))))
        free = tried.join(order, "at").join(inside, ["playlist_id", "negative"], "left_anti")
        return free.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy("step"))).where(F.col("__r") <= F.col("lacks"))

    first = shared.materialise(drawn(short, F.least(F.col("holds"), F.lit(SPARE))).select(*key, "lacks", "negative"), "drawn-negatives")
    served = first.groupBy(*key, "lacks").agg(F.count("*").alias("got")).where("got >= lacks").select(*key)
    rest = drawn(short.join(served, key, "left_anti"), F.col("holds"))
    return first.join(served, key, "left_semi").select(*key, "negative").unionByName(rest.select(*key, "negative"))


def pairs(rows: DataFrame, info: DataFrame, ids: DataFrame, n: int = 1) -> DataFrame:
    """(playlist_id, text, song_id, label): every positive, and n negatives for each that has an id."""
    pos = positives(rows, info)
    hard = hard_negatives(pos, ids, n)
    negatives = hard.unionByName(random_negatives(pos, ids, hard, n))
    return pos.select("playlist_id", "text", "song_id", F.lit(1).alias("label")).unionByName(negatives.select("playlist_id", "text", F.col("negative").alias("song_id"), F.lit(0).alias("label")))


def with_vectors(pairs_: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """A song without a vector gets zeros."""
    return pairs_.join(vectors.select("song_id", "v"), "song_id", "left").withColumn("v", F.coalesce("v", F.array_repeat(F.lit(0.0), dim)))


class LogisticRanker:
    """Hashed title words and the song's vector into a logistic regression."""

    def __init__(self, features: int = 1 << 12, seed: int = 42) -> None:
        self.features, self.seed, self.model = features, seed, None

    def _inputs(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import HashingTF, VectorAssembler
        from pyspark.ml.functions import array_to_vector

        words = df.withColumn("__w", F.split(F.lower("text"), r"\s+")).withColumn("__v", array_to_vector(F.col("v").cast("array<double>")))
        hashed = HashingTF(inputCol="__w", outputCol="__t", numFeatures=self.features).transform(words)
        return VectorAssembler(inputCols=["__t", "__v"], outputCol="__x").transform(hashed)

    def fit(self, df: DataFrame) -> LogisticRanker:
        from pyspark.ml.classification import LogisticRegression

        self.model = LogisticRegression(featuresCol="__x", labelCol="label", maxIter=10, regParam=0.01).fit(self._inputs(df))
        return self

    def score(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        out = self.model.setFeaturesCol("__x").transform(self._inputs(df))
        return out.withColumn("score", vector_to_array("rawPrediction")[1]).drop("__w", "__v", "__t", "__x", "rawPrediction", "probability", "prediction")


class OverlapGenerator:
    """Semantic ids of the training playlists that share a title word with the prompt, most frequent first."""

    def __init__(self, corpus: DataFrame) -> None:
        """corpus (text, triples); the counts of all ids of every word are kept."""
        words = corpus.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("word"), F.explode("triples").alias("x"))
        self.table = words.where("word <> ''").groupBy("word", "x").agg(F.count("*").alias("n"))

    def generate(self, prompts: DataFrame, length: int = 20) -> DataFrame:
        """The cut comes after the sums over all words of a prompt; prompts with the same words are summed once.

        The ids are dealt into blocks; each block sums the counts of its own ids for all prompts and gives its first ones."""
        worded = prompts.select("key", F.array_sort(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("words"))
        asked = shared.materialise(worded.select("words").where("words IS NOT NULL").distinct().withColumn("at", F.monotonically_increasing_id()), "asked-words")
        path = asked.inputFiles()
        if not path:
            return prompts.sparkSession.createDataFrame([], prompts.select("key").schema.add("place", "int").add("l1", "int").add("l2", "int").add("l3", "int"))
        needed = self.table.join(asked.select(F.explode("words").alias("word")).distinct(), "word", "left_semi").select("word", "x.l1", "x.l2", "x.l3", "n")
        counts = shared.materialise(needed, "word-ids")
        blocks = max(prompts.sparkSession.sparkContext.defaultParallelism, -(-counts.count() // BLOCK_ROWS))
        blocked = counts.withColumn("block", F.pmod(F.xxhash64("l1", "l2", "l3"), F.lit(blocks)))
        near = blocked.groupBy("block").applyInPandas(_best_of_block(path[0].rsplit("/", 1)[0], length), "at long, l1 int, l2 int, l3 int, n long")
        w = Window.partitionBy("at").orderBy(F.desc("n"), "l1", "l2", "l3")
        best = near.withColumn("place", F.row_number().over(w) - 1).where(F.col("place") < length)
        return worded.join(asked, "words").join(best, "at").select("key", "place", "l1", "l2", "l3")


def _best_of_block(uri: str, length: int):
    """Of the ids of one block the first ``length`` for every list of words asked for: an id's counts all stand in one
    block, so what is first among all is first in its block."""

    def run(t):
        import numpy as np
        import pandas as pd

        ids = t[["l1", "l2", "l3"]].to_numpy()
        order = np.lexsort((ids[:, 2], ids[:, 1], ids[:, 0]))
        ids, n = ids[order], t["n"].to_numpy()[order]
        fresh = np.r_[True, (np.diff(ids, axis=0) != 0).any(1)]
        place, ids = np.cumsum(fresh) - 1, ids[fresh]  # places stand in the order of ids
        codes, words = pd.factorize(t["word"].to_numpy()[order])
        by_word = np.argsort(codes, kind="stable")
        cuts = np.searchsorted(codes[by_word], np.arange(len(words) + 1))
        held = {w: (place[by_word[lo:hi]], n[by_word[lo:hi]]) for w, lo, hi in zip(words, cuts[:-1].tolist(), cuts[1:].tolist())}
        out: list[tuple] = []
        for b in shared.open_dataset(uri).to_batches(columns=["at", "words"]):
            for at, asked in zip(b.column("at").to_pylist(), b.column("words").to_pylist()):
                lists = [held[w] for w in asked if w in held]
                if not lists:
                    continue
                if len(lists) == 1:
                    where, sums = lists[0]
                else:
                    total = np.zeros(len(ids), "i8")
                    for where, more in lists:
                        total[where] += more
                    where = np.flatnonzero(total)
                    sums = total[where]
                if len(sums) > length:
                    kept = sums >= np.partition(sums, -length)[-length]
                    where, sums = where[kept], sums[kept]
                first = np.lexsort((where, -sums))[:length]
                out.append((np.full(len(first), at), where[first], sums[first]))
        ats, where, sums = (np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, "i8"),) * 3
        return pd.DataFrame({"at": ats, "l1": ids[where, 0], "l2": ids[where, 1], "l3": ids[where, 2], "n": sums})

    return run


def rank(candidates: DataFrame, ranker: Ranker, k: int = 10) -> DataFrame:
    """The k best candidates of each key by score, ties by song id."""
    w = Window.partitionBy("key").orderBy(F.desc("score"), "song_id")
    return ranker.score(candidates).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def skip_gram_vectors(lists: DataFrame, size: int = 64, window: int = 5, min_count: int = 10, rounds: int = 1, seed: int = 42) -> DataFrame:
    """(song_id, v): playlists as sentences into MLlib's skip-gram word vectors."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    model = Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, maxIter=rounds, seed=seed, inputCol="songs", outputCol="x").fit(lists.select("songs"))
    return model.getVectors().select(F.col("word").alias("song_id"), vector_to_array("vector").alias("v"))
