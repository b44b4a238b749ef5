"""Same or near-same records across splits (problem 5): a full-text index of the evaluation splits.

A record is the set of its complete triples and its title. With the triples of every record in one common order, rare
ones first, two sets of Jaccard similarity s share a triple within the first n - ceil(s n) + 1 of each (n: its size), so
only these prefixes are indexed and searched; nothing is lost. Shards of the evaluation prefixes become compressed
full-text indexes (suffix array and the inverse of the Burrows-Wheeler order) in the shared folder. The training prefixes
are streamed through them: backward search gives every maximal match, spans are merged per pair of sets into a count, and
the pairs that can still reach s are checked exactly. Equal sets are one entry on either side.

The order of triples comes from counts in a fixed number of hash slots, so what each worker holds is bounded.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunefold import shared
from tunefold.llm import lookalikes

TRIPLE = re.compile(r"<id_l1_(\d+)> <id_l2_(\d+)> <id_l3_(\d+)>")
SLOTS = 1 << 18
SHARD_TOKENS = 2_000_000


# ---------------------------------------------------------------- the index


def build_index(entries: list[tuple[int, list[int], list[int]]]) -> dict:
    """entries: (size of the set, prefix codes, their places in the set's order)."""
    import numpy as np

    r = len(entries)
    lengths = np.array([len(e[1]) for e in entries], "i8")
    codes = np.concatenate([np.array(e[1], "i8") for e in entries])
    dense, sym = np.unique(codes, return_inverse=True)
    starts = np.cumsum(lengths + 1) - lengths - 1
    n = int(lengths.sum()) + r
    text = np.empty(n, "i8")
    place = np.zeros(n, "i4")
    inside = np.ones(n, bool)
    ends = starts + lengths
    inside[ends] = False
    text[ends] = np.arange(r)  # every separator is its own smallest symbol
    text[inside] = sym.reshape(-1) + r
    place[inside] = np.concatenate([np.array(e[2], "i4") for e in entries])
    rank = np.unique(text, return_inverse=True)[1].reshape(-1).astype("i8")
    step = 1
    while True:  # prefix doubling; ends at the separators
        nxt = np.zeros(n, "i8")
        if step < n:
            nxt[:-step] = rank[step:] + 1
        key = rank * (n + 2) + nxt
        order = np.argsort(key, kind="stable")
        fresh = np.r_[True, np.diff(key[order]) != 0]
        rank[order] = np.cumsum(fresh) - 1
        if fresh.all():
            break
        step *= 2
    bwt = text[order - 1]
    by_symbol = np.argsort(bwt, kind="stable")
    first = np.searchsorted(np.sort(text), np.arange(r + len(dense) + 1))
    return {"dense": dense, "text": text, "place": place, "sa": order, "bwt": bwt, "keys": bwt[by_symbol] * (n + 1) + by_symbol, "first": first, "starts": starts, "sizes": np.array([e[0] for e in entries], "i4")}


def pack_index(index: dict) -> bytes:
    import io

    import numpy as np
    import zstandard

    slim = {k: index[k] for k in ("place", "sizes")} | {k: np.diff(index[k], prepend=0) for k in ("dense", "starts", "text", "sa")}
    f = io.BytesIO()
    np.savez(f, **slim)
    return zstandard.ZstdCompressor(level=3).compress(f.getvalue())


def unpack_index(blob: bytes) -> dict:
    import io

    import numpy as np
    import zstandard

    got = dict(np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(blob))))
    for k in ("dense", "starts", "text", "sa"):
        got[k] = np.cumsum(got[k])
    text, sa, n = got["text"], got["sa"], len(got["text"])
    got["bwt"] = text[sa - 1]
    by_symbol = np.argsort(got["bwt"], kind="stable")
    got["keys"] = got["bwt"][by_symbol] * (n + 1) + by_symbol
    got["first"] = np.searchsorted(np.sort(text), np.arange(len(got["sizes"]) + len(got["dense"]) + 1))
    return got


def maximal_matches(index: dict, queries: list[tuple[list[int], list[int]]]) -> Iterator[tuple]:
    """Backward search of all queries at once: arrays (query, entry, length, last place in query, last place in entry)."""
    import numpy as np

    lengths = np.array([len(q[0]) for q in queries], "i8")
    if not lengths.sum():
        return
    codes = np.concatenate([np.array(q[0], "i8") for q in queries])
    places = np.concatenate([np.array(q[1], "i8") for q in queries])
    owner = np.repeat(np.arange(len(queries)), lengths)
    at = np.minimum(np.searchsorted(index["dense"], codes), len(index["dense"]) - 1)
    r, n = len(index["sizes"]), len(index["text"])
    sym = np.where(index["dense"][at] == codes, at + r, -1)
    after = np.full(len(sym), -2, "i8")
    after[:-1] = np.where(owner[1:] == owner[:-1], sym[1:], -2)
    j = np.flatnonzero(sym >= 0)
    lo, hi, length = index["first"][sym[j]], index["first"][sym[j] + 1], 1
    while len(j):
        back = j - length
        prev = np.where((back >= 0) & (owner[np.maximum(back, 0)] == owner[j]), sym[np.maximum(back, 0)], -2)
        widths = hi - lo
        cuts = np.searchsorted(np.cumsum(widths), np.arange(4_000_000, int(widths.sum()) + 4_000_000, 4_000_000), "left")
        for part in np.split(np.arange(len(j)), np.unique(np.minimum(cuts + 1, len(j)))):
            if not len(part):
                continue
            w = widths[part]
            rows = np.repeat(part, w)
            i = np.repeat(lo[part], w) + np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
            pos = index["sa"][i]
            whole = (index["bwt"][i] != prev[rows]) & (index["text"][pos + length] != after[j[rows]])
            rows, pos = rows[whole], pos[whole]
            if len(rows):
                entry = np.searchsorted(index["starts"], pos, "right") - 1
                yield owner[j[rows]], entry, np.full(len(rows), length), places[j[rows]], index["place"][pos + length - 1]
        more = prev >= 0
        j, lo, hi, prev = j[more], lo[more], hi[more], prev[more]
        lo, hi = np.searchsorted(index["keys"], prev * (n + 1) + lo), np.searchsorted(index["keys"], prev * (n + 1) + hi)
        left = hi > lo
        j, lo, hi = j[left], lo[left], hi[left]
        length += 1


# ---------------------------------------------------------------- worker side


def _slot(code: int) -> int:
    return (code * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 46


def _prefix(codes: list[int], counts, share: float) -> tuple[list[int], list[int]]:
    n = len(codes)
    order = sorted(codes, key=lambda c: (counts[_slot(c)], c))
    keep = n - math.ceil(share * n - 1e-9) + 1
    return order[: min(n, keep)], list(range(min(n, keep)))


def _parse(model: dict):
    def run(batches: Iterator) -> Iterator:
        from hashlib import blake2b

        import numpy as np
        import pyarrow as pa

        rewrite = lookalikes.Rewriter(model)
        for b in batches:
            titles = [None if t is None else rewrite(t).lower() for t in b.column(1).to_pylist()]
            codes, keys = [], []
            for s in b.column(2).to_pylist():
                found = sorted({_code(*m) for m in TRIPLE.findall(s or "")})
                codes.append(found)
                keys.append(blake2b(np.array(found, "<i8").tobytes(), digest_size=16).digest())
            yield pa.record_batch([b.column(0), b.column(3), b.column(4), pa.array(titles, pa.string()), pa.array(codes, pa.list_(pa.int64())), pa.array(keys, pa.binary())], names=["rec_id", "split", "source", "title", "codes", "sk"])

    return run


def _code(a: str, b: str, c: str) -> int:
    x, y, z = int(a), int(b), int(c)
    if max(x, y, z) < 1 << 20:
        return x << 40 | y << 20 | z
    from hashlib import blake2b

    return -1 - (int.from_bytes(blake2b(f"{x} {y} {z}".encode(), digest_size=8).digest(), "big") >> 1)


def _route(counts, share: float, classes: int, subs: list[int], queries: bool):
    """Prefix codes per shard. An entry goes to one part of a class, a query to all parts of it."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for sk, codes in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                toks, places = _prefix(codes, counts, share)
                split: dict[int, tuple[list, list]] = {}
                for t, p in zip(toks, places):
                    x = split.setdefault(_slot(t) % classes, ([], []))
                    x[0].append(t)
                    x[1].append(p)
                for c, (t, p) in split.items():
                    parts = range(subs[c]) if queries else [int.from_bytes(sk[:4], "big") % subs[c]]
                    for s in parts:
                        for col, v in zip(out, (sum(subs[:c]) + s, sk, len(codes), t, p)):
                            col.append(v)
            yield pa.record_batch([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.list_(pa.int64())), pa.array(out[4], pa.list_(pa.int32()))], names=["shard", "sk", "size", "toks", "places"])

    return run


ROUTED = "shard int, sk binary, size int, toks array<long>, places array<int>"


def _build(key, frame):
    import pandas as pd

    frame = frame.sort_values("sk")
    index = build_index(list(zip(frame["size"].tolist(), [x.tolist() for x in frame["toks"]], [x.tolist() for x in frame["places"]])))
    return pd.DataFrame({"shard": [int(key[0])], "sks": [b"".join(frame["sk"])], "blob": [pack_index(index)]})


def _search(uri: str, share: float):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held: dict[int, tuple] = {}
        for b in batches:
            shards = b.column(0).to_numpy(zero_copy_only=False)
            sk, sizes, toks, places = (b.column(i).to_pylist() for i in range(1, 5))
            for shard in np.unique(shards).tolist():
                if shard not in held:
                    held.clear()
                    data = shared.open_dataset(f"{uri}/shard={shard}")
                    got = data.to_table(columns=["sks", "blob"]).to_pylist() if data else []
                    held[shard] = (got[0]["sks"], unpack_index(got[0]["blob"])) if got else None
                if held[shard] is None:
                    continue
                keys, index = held[shard]
                mine = np.flatnonzero(shards == shard)
                own = np.array([sizes[i] for i in mine], "i8")
                parts = []
                for q, e, n, i, j in maximal_matches(index, [(toks[k], places[k]) for k in mine]):
                    a, c = own[q], index["sizes"][e]
                    near = np.minimum(a, c) >= share * np.maximum(a, c) - 1e-9
                    parts.append(np.stack([q[near], e[near], n[near], i[near], j[near]]))
                m = np.concatenate(parts, 1) if parts else np.zeros((5, 0), "i8")
                if not m.shape[1]:
                    continue
                key = m[0] * len(index["sizes"]) + m[1]
                order = np.argsort(key, kind="stable")
                m, key = m[:, order], key[order]
                cut = np.flatnonzero(np.r_[True, np.diff(key) != 0])
                q, e = m[0][cut], m[1][cut]
                n, i, j = np.add.reduceat(m[2], cut), np.maximum.reduceat(m[3], cut), np.maximum.reduceat(m[4], cut)
                a, c = own[q], index["sizes"][e].astype("i8")
                yield pa.record_batch([pa.array([sk[mine[x]] for x in q], pa.binary()), pa.array([keys[16 * x : 16 * x + 16] for x in e.tolist()], pa.binary()), *(pa.array(x.astype("i8")) for x in (n, i, j, a, c))], names=["sk_a", "sk_b", "n", "i", "j", "size_a", "size_b"])

    return run


# ---------------------------------------------------------------- driver side


def overlaps(df: DataFrame, rec: str = "rec_id", title: str = "input_text", sequence: str = "output_sequence", split: str = "split", source: str = "source", train: str = "train", similarity: float = 0.8, edits: int = 5) -> DataFrame:
    """(train_rec, eval_rec, eval_split, train_source, eval_source, shared, jaccard, distance): one row per train record
    and record of another split whose triple sets have Jaccard ``similarity`` or more and whose titles, in consistent form
    and lower case, differ by at most one ``edits``-th of the longer one's characters.

    * A null or empty sequence, or one without a complete triple, has no overlaps; nor has a null title. Two empty titles
      are equal. A null split is no split; a repeated record gives its pairs again.
    * Only the named columns are read; an empty table gives none.
    """
    import numpy as np

    model = lookalikes.fit(df.select(F.col(title).cast("string").alias("t")))
    src = df.select(F.col(rec).cast("long").alias("rec_id"), F.col(title).cast("string").alias("t"), F.col(sequence).cast("string").alias("s"), F.col(split).cast("string").alias("split"), F.col(source).cast("string").alias("source"))
    parsed = src.where("split IS NOT NULL AND t IS NOT NULL").mapInArrow(_parse(model), "rec_id long, split string, source string, title string, codes array<long>, sk binary")
    recs = shared.materialise(parsed, "p5-records").where(F.size("codes") > 0)

    counted = recs.select(F.explode("codes")).mapInArrow(_count_slots, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    counts = np.zeros(SLOTS, "i8")
    for r in counted.toLocalIterator():
        counts[r["slot"]] = r["n"]
    counts = counts.tolist()

    side = F.col("split") == F.lit(train)
    trains = recs.where(side).groupBy("sk").agg(F.any_value("codes").alias("codes"))
    evals = shared.materialise(recs.where(~side).groupBy("sk").agg(F.any_value("codes").alias("codes")), "p5-evals")
    tokens = evals.agg(F.sum(F.size("codes") - F.ceil(F.size("codes") * F.lit(similarity)) + 1).alias("n")).first()["n"] or 0
    classes = max(1, -(-int(tokens) // SHARD_TOKENS))
    subs = [1] * classes
    routed = evals.mapInArrow(_route(counts, similarity, classes, subs, False), ROUTED)
    for r in routed.groupBy("shard").agg(F.sum(F.size("toks")).alias("n")).collect():
        subs[r["shard"]] = max(1, -(-r["n"] // SHARD_TOKENS))
    routed = evals.mapInArrow(_route(counts, similarity, classes, subs, False), ROUTED)
    uri = shared.write_table(routed.groupBy("shard").applyInPandas(_build, "shard int, sks binary, blob binary"), "p5-index", "shard")

    queries = trains.mapInArrow(_route(counts, similarity, classes, subs, True), ROUTED)
    queries = queries.repartition("shard", F.pmod(F.xxhash64("sk"), F.lit(16)))
    pairs = queries.mapInArrow(_search(uri, similarity), "sk_a binary, sk_b binary, n long, i long, j long, size_a long, size_b long")
    pairs = pairs.groupBy("sk_a", "sk_b").agg(F.sum("n").alias("n"), F.max("i").alias("i"), F.max("j").alias("j"), F.max("size_a").alias("size_a"), F.max("size_b").alias("size_b"))
    pairs = pairs.where(F.col("n") + F.least(F.col("size_a") - F.col("i"), F.col("size_b") - F.col("j")) - 1 >= F.lit(similarity / (1 + similarity)) * (F.col("size_a") + F.col("size_b")) - 1e-9)
    pairs = shared.materialise(pairs.select("sk_a", "sk_b", "size_a", "size_b"), "p5-pairs")
    one, two = trains.select(F.col("sk").alias("sk_a"), F.col("codes").alias("ca")), evals.select(F.col("sk").alias("sk_b"), F.col("codes").alias("cb"))
    met = pairs.join(one, "sk_a").join(two, "sk_b").select("sk_a", "sk_b", F.size(F.array_intersect("ca", "cb")).alias("shared"), (F.col("size_a") + F.col("size_b")).alias("both"))
    alike = met.withColumn("jaccard", F.col("shared") / (F.col("both") - F.col("shared"))).where(F.col("jaccard") >= similarity)

    # titles are compared once per pair of distinct titles of two alike sets, then members join in
    titles = recs.select("sk", "title", side.alias("is_train")).distinct()
    ta = titles.where("is_train").select(F.col("sk").alias("sk_a"), F.col("title").alias("title_a"))
    tb = titles.where("NOT is_train").select(F.col("sk").alias("sk_b"), F.col("title").alias("title_b"))
    named = alike.join(ta, "sk_a").join(tb, "sk_b").withColumn("longer", F.greatest(F.length("title_a"), F.length("title_b")))
    named = named.where(F.abs(F.length("title_a") - F.length("title_b")) * edits <= F.col("longer")).withColumn("distance", F.levenshtein("title_a", "title_b")).where(F.col("distance") * edits <= F.col("longer"))
    ra = recs.where(side).select(F.col("sk").alias("sk_a"), F.col("title").alias("title_a"), F.col("rec_id").alias("train_rec"), F.col("source").alias("train_source"))
    rb = recs.where(~side).select(F.col("sk").alias("sk_b"), F.col("title").alias("title_b"), F.col("rec_id").alias("eval_rec"), F.col("split").alias("eval_split"), F.col("source").alias("eval_source"))
    return named.join(ra, ["sk_a", "title_a"]).join(rb, ["sk_b", "title_b"]).select("train_rec", "eval_rec", "eval_split", "train_source", "eval_source", "shared", "jaccard", "distance")


def _count_slots(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    total = np.zeros(SLOTS, "i8")
    for b in batches:
        codes = b.column(0).to_numpy(zero_copy_only=False).astype("u8")
        total += np.bincount(((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype("i8"), minlength=SLOTS)
    some = np.flatnonzero(total)
    yield pa.record_batch([pa.array(some.astype("i4")), pa.array(total[some])], names=["slot", "n"])


def report(pairs: DataFrame, df: DataFrame, rec: str = "rec_id", split: str = "split", source: str = "source", train: str = "train") -> DataFrame:
    """(split, source, records, overlapping, pairs): how many records of each evaluation split and source overlap train."""
    records = df.where(F.col(split) != train).groupBy(F.col(split).alias("split"), F.col(source).alias("source")).agg(F.count_distinct(rec).alias("records"))
    hits = pairs.groupBy(F.col("eval_split").alias("split"), F.col("eval_source").alias("source")).agg(F.count_distinct("eval_rec").alias("overlapping"), F.count("*").alias("pairs"))
    same = records["split"].eqNullSafe(hits["split"]) & records["source"].eqNullSafe(hits["source"])
    return records.join(hits, same, "left").select(records["split"], records["source"], "records", F.coalesce("overlapping", F.lit(0)).alias("overlapping"), F.coalesce("pairs", F.lit(0)).alias("pairs"))
