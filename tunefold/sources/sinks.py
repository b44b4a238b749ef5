"""Writers: corpora, vectors, ids, pairs, analysis exports, layer checkpoints and models. All write in parallel; a folder
counts as complete only with Spark's success mark."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunefold.config import HierarchyConfig


def tab_separated(df: DataFrame, path: str, header: bool = False, partition_by: str | None = None) -> None:
    """Fields as they are, without quotes; null and empty both become nothing."""
    w = df.write.mode("overwrite").option("sep", "\t").option("quote", "").option("header", header).option("emptyValue", "")
    w = w.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    (w.partitionBy(partition_by) if partition_by else w).csv(path)


def corpus_text(lists: DataFrame, path: str) -> None:
    """(playlist_id, songs): lines and ids stay together, in two columns of one file set."""
    tab_separated(lists.select("playlist_id", F.array_join("songs", " ").alias("line")), path)


def vectors_csv(vectors: DataFrame, path: str, frequency: DataFrame | None = None) -> None:
    """Headerless lines ``song,d1,..``; by falling frequency where that is given."""
    out = vectors.select("song_id", F.concat_ws(",", "song_id", F.transform("v", lambda x: x.cast("string"))).alias("line"))
    if frequency is not None:
        out = out.join(frequency.select("song_id", "n"), "song_id", "left").orderBy(F.desc_nulls_last("n"), "song_id")
    out.select("line").write.mode("overwrite").text(path)


def semantic_ids(ids: DataFrame, path: str) -> int:
    """JSON lines; gives the number of different ids."""
    ids.select("song_id", F.array("l1", "l2", "l3").alias("semantic_ids")).write.mode("overwrite").json(path)
    return ids.select("l1", "l2", "l3").distinct().count()


def summary(one_row: DataFrame, path: str) -> None:
    """A one-row result as a JSON document."""
    one_row.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def splits(corpus: DataFrame, path: str) -> None:
    """(glid, title, output_sequence, split) as tab-separated files, one folder per split."""
    tab_separated(corpus.select("glid", "title", "output_sequence", "split"), path, partition_by="split")


def pairs(rows: DataFrame, path: str) -> None:
    tab_separated(rows.select("text", "song_id", "label"), path, header=True)


def frequency_csv(frequency: DataFrame, path: str) -> None:
    """By falling frequency, with a header."""
    frequency.orderBy(F.desc("occurrences"), "song_id").write.mode("overwrite").option("header", True).csv(path)


def song_playlists_json(rows: DataFrame, path: str, shown: int = 100) -> None:
    """Per song its number of playlists and the first ones by id."""
    from pyspark.sql import Window

    own = rows.select("song_id", "playlist_id").distinct()
    w = Window.partitionBy("song_id")
    first = own.withColumn("n", F.count("*").over(w)).withColumn("r", F.row_number().over(w.orderBy("playlist_id"))).where(F.col("r") <= shown)
    first.groupBy("song_id", "n").agg(F.array_sort(F.collect_list("playlist_id")).alias("playlists")).write.mode("overwrite").json(path)


def compact(spark: SparkSession, sources: list[str], path: str, rows_per_file: int = 1_000_000) -> None:
    """Many small Parquet outputs into few files of at most ``rows_per_file`` rows."""
    spark.read.parquet(*sources).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


class Checkpoints:
    """Layer results under a folder: written beside, read back, then renamed into place."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.folder}/{name}" if name else self.folder)

    def save(self, layer: int, df: DataFrame) -> None:
        temp, final = f"{self.folder}/layer={layer}.part", self._path(f"layer={layer}")
        df.write.mode("overwrite").parquet(temp)
        if self.spark.read.schema(df.schema).parquet(temp).columns != df.columns:
            raise OSError(f"layer {layer} can't be read back")
        self.fs.delete(final, True)
        if not self.fs.rename(self._path(f"layer={layer}.part"), final):
            raise OSError(f"layer {layer} can't be put in place")

    def load(self, layer: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/layer={layer}")

    def complete(self, layer: int) -> bool:
        return self.fs.exists(self._path(f"layer={layer}/_SUCCESS"))

    def last(self) -> int:
        """The last layer of an unbroken run from 0, or -1."""
        n = 0
        while self.complete(n):
            n += 1
        return n - 1

    def status(self, layers: int) -> dict:
        done = self.last() + 1
        return {"layers": layers, "done": min(done, layers), "finished": done >= layers}

    def clear(self) -> None:
        self.fs.delete(self._path(""), True)


def save_model(spark: SparkSession, path: str, config: HierarchyConfig, centers: DataFrame, allowed: DataFrame) -> None:
    centers.write.mode("overwrite").parquet(f"{path}/centers")
    allowed.write.mode("overwrite").parquet(f"{path}/allowed")
    fields = ("layer_clusters", "need_clusters", "embedding_dim", "group_dims", "hierarchical_weights", "iter_limit", "normalize_residuals", "seed")
    spark.createDataFrame([(json.dumps({f: getattr(config, f) for f in fields}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def load_model(spark: SparkSession, path: str) -> tuple[HierarchyConfig, DataFrame, DataFrame]:
    got = json.loads(spark.read.text(f"{path}/config").first()["value"])
    tuples = {k: tuple(tuple(x) if isinstance(x, list) else x for x in v) if isinstance(v, list) else v for k, v in got.items()}
    return HierarchyConfig(**tuples), spark.read.parquet(f"{path}/centers"), spark.read.parquet(f"{path}/allowed")
