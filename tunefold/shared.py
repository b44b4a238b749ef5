"""Tables written to the folder that all executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that setting is absent and Spark runs in
one process (tests, notebooks) a temporary folder is made. Every table written here is removed when the session's file
system closes.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _local:
        _local[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="tunefold-")
    return _local[sc.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder, removed at the end of the session."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file under the shared folder, removed at the end of the session."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(p)
    out.write(bytearray(content))
    out.close()
    fs.deleteOnExit(p)


def materialise(df: DataFrame, name: str, partition_by: str | None = None, codec: str = "zstd") -> DataFrame:
    """Write once, read many times: cuts the lineage and survives the loss of executors."""
    path = write_table(df, name, partition_by, codec)
    schema = df.schema if partition_by is None else None
    reader = df.sparkSession.read
    return (reader.schema(schema) if schema else reader).parquet(path)


def write_table(df: DataFrame, name: str, partition_by: str | None = None, codec: str = "zstd") -> str:
    path = new_path(df.sparkSession, name)
    w = df.write.option("compression", codec)
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """A table that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def open_dataset(uri: str):
    """A pyarrow dataset over one folder; called in Python workers. Gives None where the folder is absent."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    filesystem, path = fs.FileSystem.from_uri(uri)
    if filesystem.get_file_info(path).type == fs.FileType.NotFound:
        return None
    return ds.dataset(path, filesystem=filesystem, format="parquet")
