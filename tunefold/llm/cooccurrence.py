"""Items that appear together (problem 2): heavy-light counting of pairs.

An item is known by a 64-bit hash (names that share one are detected, and the hash is changed). An item in at least one of
64 baskets is heavy; at most ``MAX_HEAVY`` are, the others count as light. Per block of baskets, pairs of heavy items are
counted by popcounts over a dense bit matrix, pairs of light items by hash counting, and mixed pairs by probing each light
item's list of baskets against the heavy items. The three parts are united and scored against chance.

Most pairs meet once or twice, and none of these may travel. So the light and mixed pairs of a block are counted twice:
first only their hash slots are sent, as sorted and packed differences (about a byte for a pair), and summed by range of
slots; then the pairs themselves, of those slots only that reach the least count. The table of slots is bounded; where a
collection outgrows it, fewer pairs are held back, and the result is the same.

A basket with very many items isn't expanded: its pairs are taken from bit signatures over such baskets.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunefold import shared

HEAVY_SHARE = 1 / 64
MAX_HEAVY = 1024
LONG_BASKET = 2048
BLOCK, BLOCK_ITEMS = 16_384, 2_000_000
CHUNK, HELD = 2_500_000, 12_000_000
ITEM_BITS = 22
PAIR_BITS = 29
SPACE = " \t\n\x0b\f\r"


def _mix(a, b):
    """A 64-bit hash of a pair of hashes."""
    import numpy as np

    x = a.astype("u8") * np.uint64(0x9E3779B97F4A7C15) ^ b.astype("u8")
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(31))


class _Baskets:
    """Pairs of one partition's baskets, block by block. Items without a bit in ``frequent`` are left out."""

    def __init__(self, heavy, frequent: bytes) -> None:
        import numpy as np
        import zstandard

        self.heavy = np.sort(np.array(heavy, "i8"))
        self.frequent = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(frequent), "u1")).view(bool)
        self.dense = np.zeros((len(heavy), len(heavy)), "i8")

    def blocks(self, batches: Iterator) -> Iterator:
        """Blocks of at most about BLOCK baskets and BLOCK_ITEMS items."""
        import numpy as np

        held: list = []
        rows = items = 0
        for b in batches:
            offsets = b.column(0).offsets.to_numpy().astype("i8")
            lo = 0
            while lo < b.num_rows:
                hi = int(np.searchsorted(offsets, offsets[lo] + BLOCK_ITEMS - items, "right")) - 1
                hi = min(max(hi, lo + 1), lo + BLOCK - rows, b.num_rows)
                held.append(b.slice(lo, hi - lo))
                rows, items = rows + hi - lo, items + int(offsets[hi] - offsets[lo])
                lo = hi
                if rows >= BLOCK or items >= BLOCK_ITEMS or lo < b.num_rows:
                    yield self._split(held)
                    held, rows, items = [], 0, 0
        if rows:
            yield self._split(held)

    def _split(self, held: list):
        """(number of baskets, light and heavy items with their baskets); the light ones as places in a list of hashes."""
        import numpy as np
        import pyarrow as pa

        col = pa.Table.from_batches(held)["codes"].combine_chunks()
        codes, owner = col.flatten().to_numpy(), np.repeat(np.arange(len(col)), np.diff(col.offsets.to_numpy()))
        often = self.frequent[codes & ((1 << ITEM_BITS) - 1)]
        codes, owner = codes[often], owner[often]
        at = np.searchsorted(self.heavy, codes)
        is_heavy = self.heavy[np.minimum(at, len(self.heavy) - 1)] == codes if len(self.heavy) else np.zeros(len(codes), bool)
        names, light = np.unique(codes[~is_heavy], return_inverse=True)
        return len(col), names, light.reshape(-1), owner[~is_heavy], at[is_heavy], owner[is_heavy]

    def add_dense(self, m: int, heavy, owner) -> None:
        """Heavy with heavy: popcounts of ANDed bit rows."""
        import numpy as np

        h = len(self.heavy)
        if not h:
            return
        bits = np.zeros((h, (m + 63) // 64 * 8), "u1")
        plane = np.zeros((h, m), bool)
        plane[heavy, owner] = True
        bits[:, : (m + 7) // 8] = np.packbits(plane, axis=1)
        words = bits.view("u8")
        for i in range(h):
            self.dense[i, i:] += np.bitwise_count(words[i] & words[i:]).sum(1, dtype="i8")

    def pairs(self, m: int, names, light, lowner, heavy, howner) -> Iterator[tuple]:
        """(hashes of the one, hashes of the other, n) of light with heavy and light with light items, equal pairs summed."""
        import numpy as np

        hl, ll = np.bincount(howner, minlength=m), np.bincount(lowner, minlength=m)
        hstart, lstart = np.cumsum(hl) - hl, np.cumsum(ll) - ll
        # each light item's basket list against the heavy items of those baskets
        yield from self._counted(light, hl[lowner], hstart[lowner], heavy, names, self.heavy)
        # the items after it in the same basket, which are larger
        place = np.arange(len(light)) - lstart[lowner]
        yield from self._counted(light, ll[lowner] - 1 - place, np.arange(1, len(light) + 1), light, names, names)

    def _counted(self, items, times, first, others, left_names, right_names) -> Iterator[tuple]:
        """Each item with the ``times`` others from ``first`` on, CHUNK pairs at a time."""
        import numpy as np

        done = np.cumsum(times)
        lo = 0
        while lo < len(items):
            base = done[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(done, base + CHUNK, "right")))
            t = times[lo:hi]
            total = int(t.sum())
            if total:
                left = np.repeat(items[lo:hi].astype("i8"), t)
                right = others[np.repeat(first[lo:hi] - np.cumsum(t) + t, t) + np.arange(total)]
                key = left << 32 | right
                key.sort()
                cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                key = key[cut]
                yield left_names[key >> 32], right_names[key & 0xFFFFFFFF], np.diff(np.r_[cut, total])
            lo = hi


def _pack(values) -> bytes:
    """A sorted array of numbers: differences as byte planes, zstd."""
    import numpy as np
    import zstandard

    gaps = np.diff(values, prepend=0).astype("<u4").view("u1").reshape(-1, 4)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(gaps.T).tobytes())


def _unpack(blob: bytes):
    import numpy as np
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "u1").reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").reshape(-1), dtype="i8")


def _width(bits: int, parts: int) -> int:
    """Slots of a part, whole bytes of the bitmap."""
    return -(-(1 << bits) // (8 * parts)) * 8


def _slots(heavy, frequent: bytes, bits: int, parts: int):
    """(part, slots, counts) of one partition's pairs: its slots in the range of the part, packed; equal slots of at most
    about HELD pairs at a time are summed."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard

        edges = np.arange(parts + 1) * _width(bits, parts)

        def summed(found):
            slot = np.concatenate([f[0] for f in found])
            n = np.concatenate([f[1] for f in found])
            order = np.argsort(slot, kind="stable")
            slot, n = slot[order], n[order]
            cut = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
            slot, n = slot[cut], np.minimum(np.add.reduceat(n, cut), 255)
            at = np.searchsorted(slot, edges)
            some = [k for k in range(parts) if at[k] < at[k + 1]]
            counts = [zstandard.ZstdCompressor(level=1).compress(n[at[k] : at[k + 1]].astype("u1").tobytes()) for k in some]
            return pa.record_batch([pa.array(some, pa.int32()), pa.array([_pack(slot[at[k] : at[k + 1]] - edges[k]) for k in some], pa.binary()), pa.array(counts, pa.binary())], names=["part", "slots", "counts"])

        held, found, size = _Baskets(heavy, frequent), [], 0
        for block in held.blocks(batches):
            for a, b, n in held.pairs(*block):
                found.append(((_mix(a, b) >> np.uint64(64 - bits)).astype("i4" if bits < 31 else "i8"), np.minimum(n, 255).astype("i4")))
                size += len(n)
                if size >= HELD:
                    yield summed(found)
                    found, size = [], 0
        if found:
            yield summed(found)

    return run


def _reaching(bits: int, parts: int, least: int):
    """The slots of each part whose counts reach the least one, packed; parts arrive whole and sorted."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard

        total, now = np.zeros(_width(bits, parts), "u2"), None

        def close():
            some = np.flatnonzero(total >= least)
            return pa.record_batch([pa.array([now], pa.int32()), pa.array([_pack(some)], pa.binary())], names=["part", "slots"])

        for b in batches:
            for part, slots, counts in zip(*(c.to_pylist() for c in b.columns)):
                if part != now:
                    if now is not None:
                        yield close()
                        total[:] = 0
                    now = part
                at = _unpack(slots)
                # counts above the least one needn't be exact
                total[at] = np.minimum(total[at] + np.frombuffer(zstandard.ZstdDecompressor().decompress(counts), "u1"), 60_000)
        if now is not None:
            yield close()

    return run


def _reached(uri: str, bits: int, parts: int):
    """The bitmap of all slots that reach the least count."""
    import numpy as np

    width = _width(bits, parts)
    out = np.zeros(width * parts // 8, "u1")
    for row in shared.open_dataset(uri).to_table().to_pylist():
        own = np.zeros(width, bool)
        own[_unpack(row["slots"])] = True
        out[row["part"] * width // 8 : (row["part"] + 1) * width // 8] = np.packbits(own)
    return out


def _counts(heavy, frequent: bytes, uri: str, bits: int, parts: int):
    """Partial counts (a, b, n) of one partition's baskets: heavy pairs, and the others in slots that reach the least count."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held = _Baskets(heavy, frequent)
        reached = _reached(uri, bits, parts)

        def out(a, b, n):
            for i in range(0, len(a), 1 << 17):
                yield pa.record_batch([pa.array(np.minimum(a, b)[i : i + (1 << 17)]), pa.array(np.maximum(a, b)[i : i + (1 << 17)]), pa.array(n[i : i + (1 << 17)].astype("i8"))], names=["a", "b", "n"])

        for block in held.blocks(batches):
            held.add_dense(block[0], *block[4:])
            for a, b, n in held.pairs(*block):
                slot = (_mix(a, b) >> np.uint64(64 - bits)).astype("i8")
                good = (reached[slot >> 3] >> (7 - (slot & 7)).astype("u1") & 1).astype(bool)
                yield from out(a[good], b[good], n[good])
        i, j = np.nonzero(np.triu(held.dense, 1))
        yield from out(held.heavy[i], held.heavy[j], held.dense[i, j])

    return run


def _count_items(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for b in batches:
        code, n = np.unique(b.column(0).flatten().to_numpy(), return_counts=True)
        yield pa.record_batch([pa.array(code), pa.array(n.astype("i8"))], names=["code", "n"])


def _possible(batches: Iterator) -> Iterator:
    """The number of pairs of items in the baskets."""
    import numpy as np
    import pyarrow as pa

    total = 0
    for b in batches:
        n = np.diff(b.column(0).offsets.to_numpy()).astype("i8")
        total += int((n * (n - 1) // 2).sum())
    yield pa.record_batch([pa.array([total], pa.int64())], names=["pairs"])


def pair_counts(df: DataFrame, basket: str, item: str, min_count: int = 10, seed: int = 0) -> DataFrame:
    """(item_a, item_b, n, n_a, n_b, baskets, lift) for pairs that share at least ``min_count`` baskets, item_a < item_b.

    * Items are compared without outer white space; a null or empty item and a null basket take no part. An item counts
      once in a basket, repeated rows too. ``baskets`` counts those with at least one item.
    * lift = n * baskets / (n_a * n_b). An empty table gives no row. Only the two named columns are read.
    """
    import numpy as np
    import zstandard

    slim = df.select(F.col(basket).cast("string").alias("basket"), F.trim(F.col(item).cast("string"), F.lit(SPACE)).alias("item")).where("basket IS NOT NULL AND length(item) > 0")
    names = shared.materialise(slim.select("item").distinct().withColumn("code", F.xxhash64("item", F.lit(seed))), "p2-names")
    if names.groupBy("code").count().where("count > 1").limit(1).count():
        return pair_counts(df, basket, item, min_count, seed + 1)
    coded = slim.select("basket", F.xxhash64("item", F.lit(seed)).alias("code"))
    long = shared.materialise(coded.groupBy("basket").count().where(F.col("count") > LONG_BASKET).select("basket"), "p2-long-baskets")
    lists = coded.join(long, "basket", "left_anti").groupBy("basket").agg(F.sort_array(F.collect_set("code")).alias("codes"))
    lists = shared.materialise(lists.select("codes"), "p2-lists")
    members = shared.materialise(coded.join(long, "basket", "left_semi").distinct(), "p2-members")
    long_baskets = long.count()
    baskets = lists.count() + long_baskets

    counted = lists.mapInArrow(_count_items, "code long, n long").unionByName(members.groupBy("code").agg(F.count("*").alias("n")))
    items = shared.materialise(counted.groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count), "p2-items")
    heavy = items.where(F.col("n") >= F.lit(baskets * HEAVY_SHARE)).orderBy(F.desc("n"), "code").limit(MAX_HEAVY).toArrow()["code"].to_numpy()
    bit = F.col("code").bitwiseAND(F.lit((1 << ITEM_BITS) - 1)).cast("int").alias("bit")
    flags = np.zeros(1 << ITEM_BITS, bool)
    flags[items.select(bit).distinct().toArrow()["bit"].to_numpy()] = True
    frequent = zstandard.ZstdCompressor(level=3).compress(np.packbits(flags).tobytes())

    possible = int(lists.mapInArrow(_possible, "pairs long").agg(F.sum("pairs").alias("n")).first()["n"] or 0)
    bits = min(PAIR_BITS, max(16, possible.bit_length()))
    parts = max(1, min(1 << (bits - 22) if bits > 22 else 1, 128))
    sent = lists.mapInArrow(_slots(heavy.tolist(), frequent, bits, parts), "part int, slots binary, counts binary")
    least = max(1, min_count - long_baskets)  # what long baskets may add
    uri = shared.write_table(sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_reaching(bits, parts, least), "part int, slots binary"), "p2-slots")
    pairs = lists.mapInArrow(_counts(heavy.tolist(), frequent, uri, bits, parts), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    totals = _with_long_baskets(pairs, members, min_count).where(F.col("n") >= min_count)

    one = items.join(names, "code").select(F.col("code").alias("a"), F.col("item").alias("x"), F.col("n").alias("n_x"))
    two = one.select(F.col("a").alias("b"), F.col("x").alias("y"), F.col("n_x").alias("n_y"))
    first = F.col("x") < F.col("y")
    named = totals.join(one, "a").join(two, "b").select(
        F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"), "n",
        F.when(first, F.col("n_x")).otherwise(F.col("n_y")).alias("n_a"), F.when(first, F.col("n_y")).otherwise(F.col("n_x")).alias("n_b"),
        F.lit(int(baskets)).cast("long").alias("baskets"),
    )
    return named.withColumn("lift", F.col("n") * F.col("baskets") / (F.col("n_a") * F.col("n_b")))


def _with_long_baskets(pairs: DataFrame, members: DataFrame, min_count: int) -> DataFrame:
    """Adds the pairs of baskets longer than LONG_BASKET.

    Each such basket holds over LONG_BASKET rows, so there are at most rows / LONG_BASKET of them. Each item gets the list
    of long baskets it's in. A pair that also meets in other baskets gets the size of the intersection added; a pair that
    meets in long baskets only needs min_count of them, and only items in that many are paired.
    """
    if not members.limit(1).count():
        return pairs
    sign = shared.materialise(members.groupBy("code").agg(F.sort_array(F.collect_list(F.xxhash64("basket"))).alias("g")), "p2-signatures")
    short = shared.materialise(pairs, "p2-short")
    one, two = sign.select(F.col("code").alias("a"), F.col("g").alias("ga")), sign.select(F.col("code").alias("b"), F.col("g").alias("gb"))
    extra = F.size(F.array_intersect("ga", "gb")).cast("long")
    met = short.join(one, "a", "left").join(two, "b", "left")
    met = met.select("a", "b", (F.col("n") + F.when(F.col("ga").isNotNull() & F.col("gb").isNotNull(), extra).otherwise(0)).alias("n"))
    # pairs that no other basket holds: both items lie in at least min_count long baskets
    often = shared.materialise(sign.where(F.size("g") >= min_count), "p2-often")
    if not often.limit(1).count():
        return met
    blocks = often.select("code", "g", F.explode(F.slice("g", 1, F.size("g") - min_count + 1)).alias("one"))
    left, right = blocks.select(F.col("code").alias("a"), F.col("g").alias("ga"), "one"), blocks.select(F.col("code").alias("b"), F.col("g").alias("gb"), "one")
    only = left.join(right, "one").where("a < b").select("a", "b", extra.alias("n")).where(F.col("n") >= min_count).distinct()
    return met.unionByName(only.join(short.select("a", "b"), ["a", "b"], "left_anti"))


def found(counts: DataFrame, factor: int = 5) -> DataFrame:
    """(song_a, song_b) of the pairs that occur together at least ``factor`` times as often as by chance."""
    sure = F.col("n") * F.col("baskets") >= F.lit(factor) * F.col("n_a") * F.col("n_b")
    return counts.where(sure).select(F.col("item_a").alias("song_a"), F.col("item_b").alias("song_b"))
