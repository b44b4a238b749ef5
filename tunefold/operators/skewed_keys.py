"""Per-key results where a few keys hold most records (problem 4).

Rows are range partitioned on (key, secondary order) with quantiles that Spark samples, so a heavy key is cut at places
of its secondary order and its rows lie in several neighbouring partitions of even size. Each partition is sorted and
folded into one partial state per key; only the keys at the borders have more than one state, and these are stitched in
order. What is shuffled a second time is one small state per key and partition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATE = "key string, part int, n long, n_groups long, first_group string, last_group string, min_at timestamp, max_at timestamp"


def _fold(batches: Iterator) -> Iterator:
    """Partial states of one sorted partition; batches hold (key, grp, at)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    schema = pa.schema([("key", pa.string()), ("part", pa.int32()), ("n", pa.int64()), ("n_groups", pa.int64()), ("first_group", pa.string()), ("last_group", pa.string()), ("min_at", pa.timestamp("us", "UTC")), ("max_at", pa.timestamp("us", "UTC"))])
    low, high = np.iinfo("i8").max, np.iinfo("i8").min + 1
    held: list | None = None

    def rows(states: list[list]):
        cols = list(zip(*states))
        at = [pa.array([None if v in (low, high) else v for v in c], pa.int64()).cast(pa.timestamp("us", "UTC")) for c in cols[5:]]
        return pa.record_batch([pa.array(cols[0], pa.string()), pa.array([part] * len(states), pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string()), *at], schema=schema)

    for b in batches:
        m = b.num_rows
        if not m:
            continue
        key, grp = b.column(0), b.column(1)
        at = b.column(2).cast(pa.timestamp("us", "UTC")).cast(pa.int64())
        new_key = np.ones(m, bool)
        new_grp = np.ones(m, bool)
        if m > 1:
            new_key[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
            g = grp.fill_null("\x00null")
            new_grp[1:] = new_key[1:] | pc.not_equal(g[1:], g[:-1]).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new_key)
        ends = np.append(starts[1:], m)
        has = ~at.is_null().to_numpy(zero_copy_only=False)
        t = at.fill_null(0).to_numpy()
        mins = np.minimum.reduceat(np.where(has, t, low), starts)
        maxs = np.maximum.reduceat(np.where(has, t, high), starts)
        groups = np.add.reduceat(new_grp.astype("i8"), starts)
        keys = key.take(pa.array(starts)).to_pylist()
        firsts = grp.take(pa.array(starts)).to_pylist()
        lasts = grp.take(pa.array(ends - 1)).to_pylist()
        states = [list(x) for x in zip(keys, (ends - starts).tolist(), groups.tolist(), firsts, lasts, mins.tolist(), maxs.tolist())]
        if held is not None:
            head = states[0]
            if held[0] == head[0]:
                states[0] = [held[0], held[1] + head[1], held[2] + head[2] - (held[4] == head[3]), held[3], head[4], min(held[5], head[5]), max(held[6], head[6])]
            else:
                states.insert(0, held)
        held = states.pop()
        if states:
            yield rows(states)
    if held is not None:
        yield rows([held])


def per_key(df: DataFrame, key: str, group: str, at: str, partitions: int | None = None) -> DataFrame:
    """(key_value, n_rows, n_groups, first_at, last_at) for each non-null key.

    ``group`` is the secondary order: n_groups counts its distinct values within the key, null counting as one value of
    its own. All rows count, duplicates too; null keys give no row; an empty table gives none. Only the three named
    columns are read.
    """
    slim = df.select(F.col(key).cast("string").alias("key"), F.col(group).cast("string").alias("grp"), F.col(at).cast("timestamp").alias("at")).where("key is not null")
    order = ["key", "grp", "at"]
    ranged = slim.repartitionByRange(partitions, *order) if partitions else slim.repartitionByRange(*order)
    states = ranged.sortWithinPartitions("key", "grp").mapInArrow(_fold, STATE)
    w = Window.partitionBy("key").orderBy("part")
    joined = states.withColumn("joins", F.coalesce((F.row_number().over(w) > 1) & F.lag("last_group").over(w).eqNullSafe(F.col("first_group")), F.lit(False)))
    return joined.groupBy("key").agg(
        F.sum("n").alias("n_rows"),
        (F.sum("n_groups") - F.sum(F.col("joins").cast("long"))).alias("n_groups"),
        F.min("min_at").alias("first_at"),
        F.max("max_at").alias("last_at"),
    ).withColumnRenamed("key", "key_value")


def heavy_keys(stats: DataFrame, total_rows: int, share: float = 0.02) -> DataFrame:
    """The keys of ``per_key`` that hold at least ``share`` of all rows; null keys' rows are part of ``total_rows``."""
    least = math.ceil(Fraction(str(share)) * total_rows)
    return stats.where(F.col("n_rows") >= F.lit(max(1, least)))
