"""Frequency of every distinct term or run of terms (problem 6): suffix-sorted counting.

Each record is cut at every position into a suffix of at most ``max_len`` terms. For each prefix length the suffix carries
a mark that says whether the record shows this run for the first time here, so that the number of records becomes a sum
and no set of records has to be kept. Equal suffixes of a batch are summed where they arise. Suffixes are then routed by
their first term (a frequent first term is spread over neighbouring partitions by its second), sorted in reverse
lexicographic order, and one pass with a stack sums equal suffixes and gives the counts of all prefixes; what a partition
border cuts is summed at the end.

Repeated records are told by a hash: only records whose hash slot is taken more than once travel and are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunefold import shared

SEP = "\x1f"
SLOT_BITS = 24
BLOCK = 65_536
SPACE = " \t\n\x0b\f\r"


def _tidy(lists):
    """(record, term) of a list column: terms without outer white space, null and empty ones left out."""
    import pyarrow.compute as pc

    flat = pc.utf8_trim(pc.list_flatten(lists), SPACE)
    keep = pc.fill_null(pc.greater(pc.utf8_length(flat), 0), False)
    return pc.list_parent_indices(lists).filter(keep).to_numpy().astype("i8"), flat.filter(keep)


def _record_slots(batch):
    """(record, slot) of the records that hold a term: a hash of the keys and of all terms in their places."""
    import numpy as np
    import pandas as pd

    rec, flat = _tidy(batch.column(batch.num_columns - 1))
    if not len(rec):
        return rec, rec
    first = np.flatnonzero(np.r_[True, rec[1:] != rec[:-1]])
    enc = flat.dictionary_encode()
    place = np.arange(len(rec)) - np.repeat(first, np.diff(np.r_[first, len(rec)]))
    weight = (place.astype("u8") * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    words = pd.util.hash_array(np.array(enc.dictionary.to_pylist(), object), categorize=False)
    total = np.add.reduceat(words[enc.indices.to_numpy()] * weight, first)
    rec = rec[first]
    for k in range(batch.num_columns - 1):
        keys = batch.column(k).fill_null("\x00").to_numpy(zero_copy_only=False)
        total = total * np.uint64(0xC2B2AE3D27D4EB4F) + pd.util.hash_array(keys, categorize=False)[rec]
    return rec, ((total ^ total >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).astype("i4")


def _slots_taken(batches: Iterator) -> Iterator:
    """The slots of one partition's records, with the number of records, 2 standing for more."""
    import numpy as np
    import pyarrow as pa

    total = np.zeros(1 << SLOT_BITS, "u1")
    for b in batches:
        slot, n = np.unique(_record_slots(b)[1], return_counts=True)
        total[slot] = np.minimum(total[slot] + np.minimum(n, 2), 2)
    some = np.flatnonzero(total)
    yield pa.record_batch([pa.array(some.astype("i4")), pa.array(total[some].astype("i4"))], names=["slot", "n"])


def _flags(packed: bytes):
    import numpy as np
    import zstandard

    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), "u1")).view(bool)


def _cut(max_len: int, packed: bytes | None, schema):
    """One pass over the records: the suffixes of those whose slot is taken once (of all without ``packed``), summed over
    BLOCK records, as (suffix, n, firsts); and the other records themselves, tidied. ``firsts`` has one number per length."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        flags = _flags(packed) if packed else None
        held, rows = [], 0

        def filled(rows_: int, **columns):
            return pa.record_batch([columns.get(f.name, pa.nulls(rows_, f.type)) for f in schema], schema=schema)

        def summed():
            t = pa.Table.from_batches(held).combine_chunks()
            got = _suffixes(t.column(0).chunk(0), max_len) if t.num_rows else None
            return filled(len(got[0]), suffix=got[0], n=got[1], firsts=got[2]) if got else None

        for b in batches:
            lists = b.column(b.num_columns - 1)
            if flags is not None:
                rec, slot = _record_slots(b)
                again = flags[slot]
                some = b.take(pa.array(rec[again]))
                at, flat = _tidy(some.column(some.num_columns - 1))
                offsets = np.r_[0, np.cumsum(np.bincount(at, minlength=some.num_rows))].astype("i4")
                keys = {n: c for n, c in zip(b.schema.names[:-1], some.columns[:-1])}
                if some.num_rows:
                    yield filled(some.num_rows, t=pa.ListArray.from_arrays(pa.array(offsets), flat), **keys)
                lists = lists.take(pa.array(rec[~again]))
            held.append(pa.record_batch([lists], names=["t"]))
            rows += len(lists)
            if rows >= BLOCK:
                if (out := summed()) is not None:
                    yield out
                held, rows = [], 0
        if rows and (out := summed()) is not None:
            yield out

    return run


def _suffixes(lists, max_len: int):
    """Distinct suffixes of some records with their numbers, or nothing."""
    import numpy as np
    import pyarrow as pa

    rec, flat = _tidy(lists)
    if not len(flat):
        return None
    enc = flat.dictionary_encode()
    words = enc.dictionary.to_pylist()
    code = enc.indices.to_numpy().astype("i8") + 1
    n, width = len(code), len(words) + 1
    # prefix ids of each length by repeated pairing: equal runs get equal numbers
    ids, firsts, tails = code, [], [code]
    for length in range(1, max_len + 1):
        if length > 1:
            nxt = np.zeros(n, "i8")
            k = length - 1
            if n > k:
                same = rec[:-k] == rec[k:]
                nxt[:-k] = np.where(same, code[k:], 0)
            tails.append(nxt)
            ids = np.unique(ids * width + nxt, return_inverse=True)[1].astype("i8").reshape(-1)
            whole = nxt > 0
        else:
            whole = np.ones(n, bool)
        mark = np.zeros(n, "i8")
        top = int(ids.max()) + 1
        mark[np.unique(rec * top + ids, return_index=True)[1]] = 1
        firsts.append(mark * whole)
    # ids are dense: first places and sums by number
    count = np.bincount(ids)
    at = np.zeros(len(count), "i8")
    at[ids[::-1]] = np.arange(n - 1, -1, -1)
    real = np.flatnonzero(count)
    sums = [np.bincount(ids, weights=f, minlength=len(count)).astype("i8")[real] for f in firsts]
    if max_len == 1:
        text = enc.dictionary.take(pa.array(real - 1))
    else:
        text = pa.array([SEP.join(words[t[i] - 1] for t in tails if t[i]) for i in at[real].tolist()], pa.string())
    firsts_ = pa.ListArray.from_arrays(pa.array(np.arange(0, len(real) * max_len + 1, max_len, dtype="i4")), pa.array(np.stack(sums, 1).reshape(-1)))
    return text, pa.array(count[real].astype("i8")), firsts_


def _stack(batches: Iterator) -> Iterator:
    """Prefix counts of one partition's suffixes in reverse lexicographic order."""
    import pyarrow as pa

    stack: list[list] = []  # per open prefix: term, occurrences, records
    out: list[tuple] = []

    def close(depth: int) -> None:
        while len(stack) > depth:
            out.append((SEP.join(x[0] for x in stack), len(stack), stack[-1][1], stack[-1][2]))
            stack.pop()

    def batch():
        cols = list(zip(*out))
        out.clear()
        return pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["gram", "len", "occurrences", "records"])

    for b in batches:
        for suffix, n, firsts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            terms = suffix.split(SEP)
            same = 0
            while same < len(stack) and same < len(terms) and stack[same][0] == terms[same]:
                same += 1
            close(same)
            for i in range(same):
                stack[i][1] += n
                stack[i][2] += firsts[i]
            for i in range(same, len(terms)):
                stack.append([terms[i], n, firsts[i]])
        if len(out) > 50_000:
            yield batch()
    close(0)
    if out:
        yield batch()


def _arrow(shape: T.StructType):
    import pyarrow as pa

    kinds = {"string": pa.string(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in shape.fields])


def ngram_counts(df: DataFrame, keys: list[str], terms: str, max_len: int = 1) -> DataFrame:
    """(gram, len, occurrences, records) for every run of 1..max_len terms; a gram's terms are joined by U+001F.

    * Terms are compared without outer white space; null and empty terms are left out before runs are formed. A null or
      empty array holds nothing. Records equal in ``keys`` and all terms count once.
    * ``records`` is the number of records that hold the gram. An empty table gives no row. Only the named columns are read.
    """
    import numpy as np
    import zstandard

    rows = df.select(*[F.col(k).cast("string").alias(f"__k{i}") for i, k in enumerate(keys)], F.col(terms).cast("array<string>").alias("t"))
    taken = rows.mapInArrow(_slots_taken, "slot int, n int").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1").select("slot").toArrow()["slot"].to_numpy()
    flags = np.zeros(1 << SLOT_BITS, bool)
    flags[taken] = True
    packed = zstandard.ZstdCompressor(level=3).compress(np.packbits(flags).tobytes())
    shape = T.StructType([T.StructField("suffix", T.StringType()), T.StructField("n", T.LongType()), T.StructField("firsts", T.ArrayType(T.LongType())), *rows.schema.fields])
    arrow = _arrow(shape)
    cut = shared.materialise(rows.mapInArrow(_cut(max_len, packed, arrow), shape), "p6-suffixes")
    again = cut.where("t IS NOT NULL").select(*rows.columns).distinct().select("t")
    more = again.mapInArrow(_cut(max_len, None, arrow), shape)
    parts = cut.where("suffix IS NOT NULL").unionByName(more).select("suffix", "n", "firsts")
    first, second = F.substring_index("suffix", SEP, 1), F.substring_index("suffix", SEP, 2)
    ranged = parts.repartitionByRange(first.desc(), second.desc(), F.col("suffix").desc()).sortWithinPartitions(F.col("suffix").desc())
    counts = ranged.mapInArrow(_stack, "gram string, len int, occurrences long, records long")
    return counts.groupBy("gram", "len").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked(counts: DataFrame, records: int, rare_below: int = 10, common_share: float = 0.25) -> DataFrame:
    """Adds ``mark``: rare, common or null. Rare wins where both hold (tiny collections)."""
    mark = F.when(F.col("occurrences") < rare_below, "rare").when(F.col("records") > F.lit(common_share * records), "common")
    return counts.withColumn("mark", mark)
