"""A cache of unit vectors for similarity search, keyed by what its source looks like."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(spark: SparkSession, path: str) -> str:
    """A hash of the names, sizes and times of change of all files at a path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files, seen = fs.listFiles(p, True), []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath().toString()}|{f.getLen()}|{f.getModificationTime()}")
    return hashlib.blake2b("\n".join(sorted(seen)).encode(), digest_size=16).hexdigest()


def _column(b, i: int):
    import pyarrow as pa

    return b.column(i).combine_chunks() if isinstance(b.column(i), pa.ChunkedArray) else b.column(i)


def _with_lengths(batches: Iterator) -> Iterator:
    """(song_id, v, length); no length for a null vector or one with a null element."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        v = _column(b, 1)
        values = v.values.to_numpy(zero_copy_only=False).astype("f8")
        starts, ends = v.offsets.to_numpy()[:-1], v.offsets.to_numpy()[1:]
        null = v.is_null().to_numpy(zero_copy_only=False)
        missing = np.r_[0, np.cumsum(v.values.is_null().to_numpy(zero_copy_only=False))]
        null = null | (missing[ends] > missing[starts])
        lengths = [0.0 if n else float(np.sqrt(np.square(values[s:e]).sum())) for s, e, n in zip(starts.tolist(), ends.tolist(), null.tolist())]
        yield pa.record_batch([_column(b, 0), v, pa.array(lengths, pa.float64(), mask=null)], names=["song_id", "v", "length"])


def _scaled(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for b in batches:
        v = _column(b, 1)
        lengths = _column(b, 2).fill_null(float("nan")).to_numpy(zero_copy_only=False)
        each = np.repeat(np.where(lengths != 0, lengths, 1.0), np.diff(v.offsets.to_numpy()))
        flat = v.values.slice(v.offsets[0].as_py(), len(each))
        gone = flat.is_null().to_numpy(zero_copy_only=False)
        scaled = pa.array(flat.to_numpy(zero_copy_only=False).astype("f8") / each, pa.float64(), mask=gone)
        null = v.is_null()
        units = pa.ListArray.from_arrays(pa.array(v.offsets.to_numpy() - v.offsets[0].as_py(), pa.int32()), scaled, mask=null)
        yield pa.record_batch([_column(b, 0), units], names=["song_id", "v"])


def unit_vectors(spark: SparkSession, source: str, vectors: DataFrame, folder: str) -> tuple[DataFrame, bool]:
    """(song_id, v) of length one, and whether it was built now.

    ``vectors`` (song_id, v) is what is read from ``source``. While the files there keep their names, sizes and times, the
    table written under ``folder`` is read again; a table without its success mark is written anew. A vector of zeros stays.
    The table holds the vectors as they are and their lengths, which is far smaller than quotients in double precision.
    """
    path = f"{folder.rstrip('/')}/unit-{fingerprint(spark, source)}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fresh = not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)
    if fresh:
        own = vectors.select(F.col("song_id").cast("string").alias("song_id"), "v")
        kind = own.schema["v"].dataType.simpleString()
        own.mapInArrow(_with_lengths, f"song_id string, v {kind}, length double").write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path).mapInArrow(_scaled, "song_id string, v array<double>"), fresh
