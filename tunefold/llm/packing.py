"""Filling fixed-capacity containers with items (problem 8): bounded-space online packing.

Each partition keeps a fixed number of open windows per capacity. An item goes to the window that it fills best; when it
fits none and all windows are in use, the fullest is closed. The windows still open at the end of a partition are merged in
a second pass by their sizes alone: only their ids and fills move, each merging task gets a bounded number of them.
An item is split only if it exceeds the capacity alone; its full pieces are containers of their own.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunefold import shared

WINDOWS = 64
MERGE = 8192
PLACED = "spec_name string, capacity long, container string, open boolean, item_id long, start long, tokens long"


class Windows:
    """Open windows of one capacity: best fit by binary search on the fill."""

    def __init__(self, capacity: int, limit: int) -> None:
        self.capacity, self.limit, self.made = capacity, limit, 0
        self.fills: list[tuple[int, int]] = []  # (fill, window), sorted
        self.items: dict[int, list] = {}

    def place(self, size: int, item) -> tuple[int, int, list] | None:
        """Puts an item in; gives (window, fill, items) of a window that had to be closed."""
        closed = None
        at = bisect_left(self.fills, (self.capacity - size + 1, -1)) - 1
        if at >= 0:
            fill, w = self.fills.pop(at)
        else:
            if len(self.fills) >= self.limit:
                f, old = self.fills.pop()
                closed = (old, f, self.items.pop(old))
            fill, w = 0, self.made
            self.made += 1
            self.items[w] = []
        self.items[w].append(item)
        if fill + size == self.capacity and closed is None:
            return w, fill + size, self.items.pop(w)
        insort(self.fills, (fill + size, w))
        return closed

    def rest(self) -> Iterator[tuple[int, int, list]]:
        for fill, w in self.fills:
            yield w, fill, self.items[w]


def _pack(specs: list[tuple[str, int]], windows: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        open_ = {s: Windows(c, windows) for s, c in specs}
        whole = dict.fromkeys(open_, 0)
        out: list[tuple] = []

        def add(spec, name, is_open, items):
            for item, start, size in items:
                out.append((spec, open_[spec].capacity, f"{part}-{name}", is_open, item, start, size))

        def batch():
            cols = list(zip(*out))
            out.clear()
            kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["spec_name", "capacity", "container", "open", "item_id", "start", "tokens"])

        for b in batches:
            for item, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for spec, w in open_.items():
                    start, left = 0, size
                    while left > w.capacity:
                        add(spec, f"x{whole[spec]}", False, [(item, start, w.capacity)])
                        whole[spec] += 1
                        start, left = start + w.capacity, left - w.capacity
                    closed = w.place(left, (item, start, left))
                    if closed:
                        add(spec, closed[0], False, closed[2])
            if len(out) > 20_000:
                yield batch()
        for spec, w in open_.items():
            for name, _, items in w.rest():
                add(spec, name, True, items)
        if out:
            yield batch()

    return run


def _merge(batches: Iterator) -> Iterator:
    """Leftover windows of one merging task: best fit, largest first."""
    import pandas as pd

    for frame in batches:
        rows = []
        for spec, own in frame.groupby("spec_name", sort=True):
            w = Windows(int(own["capacity"].iloc[0]), len(own) + 1)
            own = own.sort_values(["fill", "container"], ascending=[False, True])
            done = []
            for name, fill in zip(own["container"], own["fill"].astype(int)):
                closed = w.place(fill, name)
                if closed:
                    done.append(closed)
            for _, _, names in [*done, *w.rest()]:
                rows += [(spec, n, names[0]) for n in names]
        yield pd.DataFrame(rows, columns=["spec_name", "container", "merged"])


def pack(df: DataFrame, item: str, size: str, specs: DataFrame, windows: int = WINDOWS) -> DataFrame:
    """(spec_name, capacity, container, item_id, start, tokens): the container of every piece of every item.

    * An item of size null or below one lies in no container. An item above the capacity is cut into full pieces and a
      rest; ``start`` is the piece's first token in the item. Repeated items are placed as often as they stand there.
    * A spec without a capacity of at least one is left out. Empty tables give no rows. Only the named columns are read.
    * ``specs`` is a table of a few capacities; it's read by the driver.
    """
    wanted = sorted({(r[0], int(r[1])) for r in specs.select("spec_name", "capacity_tokens").collect() if r[0] is not None and r[1] and r[1] > 0})
    items = df.select(F.col(item).cast("long").alias("item_id"), F.col(size).cast("long").alias("size")).where("size > 0")
    placed = shared.materialise(items.mapInArrow(_pack(wanted, windows), PLACED), "p8-placed")
    heads = shared.materialise(placed.where("open").groupBy("spec_name", "capacity", "container").agg(F.sum("tokens").alias("fill")), "p8-open")
    tasks = max(1, -(-heads.count() // MERGE))
    # whole merging tasks: one batch each
    grouped = heads.withColumn("task", F.pmod(F.xxhash64("container"), F.lit(tasks))).groupBy("task")
    merged = grouped.applyInPandas(lambda f: next(_merge(iter([f]))), "spec_name string, container string, merged string")
    named = placed.join(merged, ["spec_name", "container"], "left")
    return named.select("spec_name", "capacity", F.coalesce("merged", "container").alias("container"), "item_id", "start", "tokens")


def utilisation(placed: DataFrame) -> DataFrame:
    """(spec_name, capacity, containers, items, pieces, tokens, utilisation) per capacity."""
    by = placed.groupBy("spec_name", "capacity", "container").agg(F.sum("tokens").alias("fill"), F.count("*").alias("n"), F.sum(F.when(F.col("start") == 0, 1).otherwise(0)).alias("items"))
    return by.groupBy("spec_name", "capacity").agg(
        F.count("*").alias("containers"),
        F.sum("items").alias("items"),
        F.sum("n").alias("pieces"),
        F.sum("fill").alias("tokens"),
        F.max("fill").alias("fullest"),
    ).withColumn("utilisation", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))
