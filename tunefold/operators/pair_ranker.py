"""The baseline ranker over all mined pairs, without a row per pair.

The pairs are those of ``ranking.pairs`` and the fit is that of ``ranking.LogisticRanker``. A score is the sum of one number of
the title, one of the song and the intercept, so no pair carries its title's words or its song's vector:

* The pairs of a playlist are drawn where its songs stand together; songs are looked up in a table of (song, place, block).
* Vectors are dealt into blocks. The pairs of a block name its vectors and a list of titles by number, in pieces.
* Each step of the fit scores titles and vectors of a piece once, and sums the residuals of its pairs by title and vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunefold import shared

BLOCK_VECTORS = 8_192
PIECE_PAIRS = 1_000_000
CHUNK_SONGS = 50_000
SLICE_LISTS = 1_000
KEPT_SONGS = 2_000_000
SPARING = {"batch_readahead": 1, "fragment_readahead": 1, "use_threads": False}
UNIT = "block int, train long, n long, song array<smallint>, text array<int>, label array<tinyint>, ends array<int>, word array<smallint>, times array<int>"


class PairRanker:
    """Hashed title words and the song's vector into a logistic regression; the pairs of (rows, info, ids) are mined inside."""

    def __init__(self, rows: DataFrame, info: DataFrame, ids: DataFrame, vectors: DataFrame, dim: int, n: int = 1, features: int = 1 << 12, parts: int = 10) -> None:
        """One of ``parts`` pairs, by hash of playlist, song and label, is held out. ``ids`` has one id a song; a song without a
        vector counts as zeros, and of several vectors the smallest one is taken."""
        if features > 1 << 15:
            raise ValueError("words are numbered in 16 bits")
        self.spark, self.dim, self.features = rows.sparkSession, dim, features
        vectors = vectors.where("song_id IS NOT NULL").select("song_id", F.col("v").cast("array<float>").alias("v"))
        blocks = -(-vectors.count() // BLOCK_VECTORS)
        songs, total = _song_table(ids, _numbered(vectors.select("song_id").distinct(), max(1, blocks)))
        lists = _titled_lists(rows, info, features)
        uri = songs.inputFiles()[0].rsplit("/", 1)[0] if total or blocks else ""
        units = shared.write_table(lists.mapInArrow(_drawn(uri, total, max(1, blocks), n, parts), UNIT).withColumn("unit", F.monotonically_increasing_id()), "pair-units")
        self.pieces, self.units = _pieces(self.spark.read.parquet(units))
        shared.remove(self.spark, units)
        self.vectors = _vector_blocks(vectors, blocks) if blocks else ""

    def _each_piece(self, task: Callable, schema: str) -> DataFrame:
        """One row or more of each piece: ``task(vectors, units)``."""
        vectors, units, pieces, dim = self.vectors, self.units, self.pieces, self.dim

        def run(batches: Iterator) -> Iterator:
            for b in batches:
                for i in b.column(0).to_pylist():
                    yield from task(_block(vectors, pieces[i], dim), _units(f"{units}/piece={i}"))

        return self.spark.range(0, len(pieces), 1, max(1, len(pieces))).mapInArrow(run, schema)

    def fit(self, rounds: int = 10, reg: float = 0.01) -> PairRanker:
        import numpy as np

        width = self.features + self.dim
        n, ones, total, squares = self._sums(_moments(self.features), 2 * width + 2, width)
        self.coefficients, self.intercept = np.zeros(width), 0.0
        if ones in (0, n):  # a single label, as in MLlib
            self.intercept = float(np.inf if ones else -np.inf) if n else 0.0
            return self
        mean = total / n
        var = (squares - n * mean * mean) / max(1, n - 1)
        scale = np.where(var > 1e-10 * squares / n, 1 / np.sqrt(np.maximum(var, 1e-300)), 0.0)

        def loss(x):
            u = x[:-1] * scale
            r, value, grad, _ = self._sums(_residuals(self.features, u, x[-1] - u @ mean), 2 * width + 2, width)
            grad = (grad - r * mean) * scale / n + reg * x[:-1]
            return value / n + reg / 2 * float(x[:-1] @ x[:-1]), np.append(grad, r / n)

        x = minimum(loss, np.append(np.zeros(width), np.log(ones / (n - ones))), rounds)
        self.coefficients = x[:-1] * scale
        self.intercept = float(x[-1] - self.coefficients @ mean)
        return self

    def _sums(self, task: Callable, length: int, width: int) -> tuple:
        import numpy as np

        rows = self._each_piece(task, "sums binary").collect()
        s = sum((np.frombuffer(r["sums"]) for r in rows), np.zeros(length))
        return float(s[0]), float(s[1]), s[2 : width + 2], s[width + 2 :]

    def held_out(self) -> DataFrame:
        """(score, label) of the pairs held out."""
        return self._each_piece(_scores(self.features, self.coefficients, self.intercept), "score double, label int")


def _numbered(songs: DataFrame, blocks: int) -> DataFrame:
    """Adds ``block``, and ``local``: the place of a song in its block, from 1."""
    dealt = songs.withColumn("block", F.pmod(F.xxhash64("song_id"), F.lit(blocks)).cast("int"))
    return dealt.withColumn("local", F.row_number().over(Window.partitionBy("block").orderBy("song_id")))


def _vector_blocks(vectors: DataFrame, blocks: int) -> str:
    """The folder of (block, local, v): one vector of each song, under the same number as in the table of songs."""
    placed = vectors.withColumn("block", F.pmod(F.xxhash64("song_id"), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    one = placed.withColumn("__r", F.row_number().over(Window.partitionBy("block", "song_id").orderBy("v"))).where("__r = 1").drop("__r")
    return shared.write_table(_numbered(one, blocks).select("local", "v", "block"), "ranker-vectors", "block")


def _song_table(ids: DataFrame, numbered: DataFrame) -> tuple[DataFrame, int]:
    """(song_id, hash, at, shared, block, local): the place of a song with an id in the seeded order, the first place of its id if
    others have it too, and its vector; -1 where there is none."""
    from tunefold.operators.ordering import with_position

    placed = with_position(ids.select("song_id", "l1", "l2", "l3"), F.md5("song_id"), "song_id", name="at")
    total = placed.count()
    same = placed.groupBy("l1", "l2", "l3").agg(F.count("*").alias("m"), F.min("at").alias("first")).where("m > 1")
    known = placed.join(same, ["l1", "l2", "l3"], "left").select("song_id", "at", F.col("first").alias("shared"))
    whole = known.join(numbered, "song_id", "full")
    return shared.materialise(whole.select("song_id", F.xxhash64("song_id").alias("hash"), *[F.coalesce(c, F.lit(-1)).cast("int").alias(c) for c in ("at", "shared", "block")], F.coalesce("local", F.lit(0)).alias("local")), "ranker-songs"), total


def _titled_lists(rows: DataFrame, info: DataFrame, features: int) -> DataFrame:
    """(playlist_id, text, songs, word, times): the different songs of a playlist and the hashed words of its title."""
    from pyspark.ml.feature import HashingTF

    titled = info.where("listname IS NOT NULL AND listname <> ''").select(F.col("glid").alias("playlist_id"), F.col("listname").alias("text"))
    lists = rows.where("song_id IS NOT NULL").groupBy("playlist_id").agg(F.collect_set("song_id").alias("songs")).join(titled, "playlist_id")
    hashed = HashingTF(inputCol="__w", outputCol="__t", numFeatures=features).transform(lists.withColumn("__w", F.split(F.lower("text"), r"\s+")))
    bare = F.unwrap_udt("__t")
    return hashed.select("playlist_id", "text", "songs", bare["indices"].alias("word"), F.transform(bare["values"], lambda x: x.cast("int")).alias("times"))


def _pieces(units: DataFrame) -> tuple[list[int], str]:
    """The block of each piece, and the folder of the pieces; the pairs of a block, one of heavy songs too, are cut evenly."""
    spark = units.sparkSession
    blocks, first = [], []
    for r in units.groupBy("block").agg(F.sum("n").alias("n")).orderBy("block").collect():
        k = -(-r["n"] // PIECE_PAIRS)
        first.append((r["block"], len(blocks), k))
        blocks += [r["block"]] * k
    cut = spark.createDataFrame(first, "block int, first int, k int")
    dealt = units.join(F.broadcast(cut), "block").withColumn("piece", (F.col("first") + F.pmod(F.xxhash64("unit"), F.col("k"))).cast("int")).drop("first", "k", "unit")
    return blocks, shared.write_table(dealt.repartition("piece"), "ranker-pieces", "piece")


def _block(uri: str, block: int, dim: int):
    """The vectors of a block by number, zeros at 0."""
    import numpy as np

    source = shared.open_dataset(f"{uri}/block={block}") if uri else None
    if source is None:
        return np.zeros((1, dim), "f4")
    out = np.zeros((source.count_rows() + 1, dim), "f4")
    for b in source.to_batches(columns=["local", "v"], batch_size=2048, **SPARING):
        out[b.column("local").to_numpy()] = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return out


def _units(uri: str) -> Iterator[dict]:
    """The units of a piece, some together: those that train first, then those held out; ``title`` is the title of each word."""
    import numpy as np

    source = shared.open_dataset(uri)
    for b in source.to_batches(batch_size=256, **SPARING) if source else ():
        u = {c: b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("song", "text", "label", "ends", "word", "times")}
        pairs, titles, trained = b.column("n").to_numpy(), b.column("ends").value_lengths().to_numpy(), b.column("train").to_numpy()
        before = np.cumsum(titles) - titles
        text = u["text"] + np.repeat(before, pairs)
        train = np.arange(len(text)) - np.repeat(np.cumsum(pairs) - pairs, pairs) < np.repeat(trained, pairs)
        each = np.diff(u["ends"], prepend=0)
        each[before] = u["ends"][before]  # ends begin anew in each unit
        order = np.r_[np.flatnonzero(train), np.flatnonzero(~train)]
        yield {"song": u["song"][order], "text": text[order], "label": u["label"][order], "title": np.repeat(np.arange(len(each)), each), "word": u["word"], "times": u["times"], "titles": len(each), "train": int(train.sum())}


def _times(vectors, x):
    """A product in double precision, some rows at a time."""
    import numpy as np

    return np.concatenate([vectors[i : i + 2048].astype("f8") @ x for i in range(0, len(vectors), 2048)])


def _weighted(weights, vectors):
    import numpy as np

    return sum((weights[i : i + 2048] @ vectors[i : i + 2048].astype("f8") for i in range(0, len(vectors), 2048)), np.zeros(vectors.shape[1]))


def _result(*parts) -> Iterator:
    import numpy as np
    import pyarrow as pa

    yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([np.atleast_1d(np.asarray(p, "f8")) for p in parts]).tobytes()], pa.binary())], ["sums"])


def _moments(features: int) -> Callable:
    """Pairs that train, those of label 1, and the sums and sums of squares of the features."""

    def task(vectors, units):
        import numpy as np

        n, ones, by_song = 0, 0, np.zeros(len(vectors))
        words, squares = np.zeros(features), np.zeros(features)
        for u in units:
            t = u["train"]
            n, ones = n + t, ones + int(u["label"][:t].sum())
            by_song += np.bincount(u["song"][:t], minlength=len(vectors))
            each = np.bincount(u["text"][:t], minlength=u["titles"])[u["title"]].astype("f8") * u["times"]
            words += np.bincount(u["word"], each, features)
            squares += np.bincount(u["word"], each * u["times"], features)
        more = sum((by_song[i : i + 2048] @ np.square(vectors[i : i + 2048].astype("f8")) for i in range(0, len(vectors), 2048)), np.zeros(vectors.shape[1]))
        return _result(n, ones, words, _weighted(by_song, vectors), squares, more)

    return task


def _margins(u: dict, by_song, weights, intercept: float, part: slice):
    import numpy as np

    by_text = np.bincount(u["title"], weights[u["word"]] * u["times"], u["titles"])
    return by_song[u["song"][part]] + by_text[u["text"][part]] + intercept


def _residuals(features: int, coefficients, intercept: float) -> Callable:
    """The residuals' sum, the loss, and the residuals times the features, over the pairs that train."""

    def task(vectors, units):
        import numpy as np

        weights = coefficients[:features]
        scores, by_song = _times(vectors, coefficients[features:]), np.zeros(len(vectors))
        total, loss, words = 0.0, 0.0, np.zeros(features)
        for u in units:
            part = slice(0, u["train"])
            m, y = _margins(u, scores, weights, intercept, part), u["label"][part]
            e = np.exp(-np.abs(m))
            loss += float((np.log1p(e) + np.maximum(m, 0) - y * m).sum())
            r = np.where(m >= 0, 1.0, e) / (1 + e) - y
            total += float(r.sum())
            by_song += np.bincount(u["song"][part], r, len(vectors))
            words += np.bincount(u["word"], np.bincount(u["text"][part], r, u["titles"])[u["title"]] * u["times"], features)
        return _result(total, loss, words, _weighted(by_song, vectors), np.zeros(features + vectors.shape[1]))

    return task


def _scores(features: int, coefficients, intercept: float) -> Callable:
    def task(vectors, units):
        import pyarrow as pa

        scores = _times(vectors, coefficients[features:])
        for u in units:
            part = slice(u["train"], None)
            m = _margins(u, scores, coefficients[:features], intercept, part)
            yield pa.RecordBatch.from_arrays([pa.array(m, pa.float64()), pa.array(u["label"][part], pa.int32())], ["score", "label"])

    return task


def minimum(f: Callable, x, rounds: int, tol: float = 1e-6, memory: int = 10):
    """Limited-memory BFGS with a line search for the strong Wolfe conditions, step by step as MLlib's."""
    import numpy as np

    value, grad = f(x)
    past, values = [], [value]
    for i in range(rounds):
        if np.linalg.norm(grad) <= max(tol * abs(value), 1e-8):
            break
        d, kept = grad.copy(), []
        for s, y in reversed(past):
            kept.append(s @ d / (s @ y))
            d -= kept[-1] * y
        if past:
            s, y = past[-1]
            d *= (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(kept)):
            d += (a - y @ d / (s @ y)) * s
        d = -d
        found = _step(f, x, value, grad, d, 1.0 if i else 1.0 / np.linalg.norm(d))
        if found is None:
            break
        there, value, fresh = found
        past = [*past, (there - x, fresh - grad)][-memory:]
        x, grad = there, fresh
        if abs(value - max(values)) <= tol * abs(values[0]):
            break
        values = [*values, value][-20:]
    return x


def _step(f: Callable, x, value: float, grad, d, t: float):
    """The point taken along d, its value and gradient; None if no point fits."""
    from math import sqrt

    slope = float(grad @ d)
    if not slope < 0:
        return None

    def at(t: float) -> tuple:
        there = x + t * d
        v, g = f(there)
        return t, float(g @ d), v, there, g

    def between(a: tuple, b: tuple) -> float:
        (lt, ld, lv), (rt, rd, rv) = sorted((a[:3], b[:3]))
        d1 = ld + rd - 3 * (lv - rv) / (lt - rt)
        d2 = sqrt(max(0.0, d1 * d1 - ld * rd))
        low, high = lt + 0.1 * (rt - lt), lt + 0.9 * (rt - lt)
        under = rd - ld + 2 * d2
        return min(max(rt - (rt - lt) * (rd + d2 - d1) / under, low), high) if under else (low + high) / 2

    def zoom(low: tuple, high: tuple):
        for _ in range(10):
            c = at(between(low, high))
            if c[2] > value + 1e-4 * c[0] * slope or c[2] >= low[2]:
                high = c
            elif abs(c[1]) <= 0.9 * abs(slope):
                return c[3], c[2], c[4]
            else:
                if c[1] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        return None

    low = (0.0, slope, value, x, grad)
    for i in range(10):
        c = at(t)
        if c[2] > value + 1e-4 * t * slope or (c[2] >= low[2] and i):
            return zoom(low, c)
        if abs(c[1]) <= 0.9 * abs(slope):
            return c[3], c[2], c[4]
        if c[1] >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    return None


def _drawn(uri: str, total: int, blocks: int, n: int, parts: int) -> Callable:
    """All pairs of the playlists given, as units of one block each."""
    chunk, most, few = CHUNK_SONGS, KEPT_SONGS, SLICE_LISTS

    def run(batches: Iterator) -> Iterator:
        table = _SongTable(uri, most)
        kept, songs = [], 0
        for b in (b.slice(i, few) for b in batches for i in range(0, b.num_rows, few)):
            kept.append(b)
            songs += len(b.column(b.schema.get_field_index("songs")).flatten())
            if songs >= chunk:
                yield from _pairs_of(kept, table, total, blocks, n, parts)
                kept, songs = [], 0
        if kept:
            yield from _pairs_of(kept, table, total, blocks, n, parts)

    return run


class _Part:
    """Some rows of the table of songs, with their order by hash and by place."""

    def __init__(self, b) -> None:
        import numpy as np

        self.names = b.column("song_id")
        self.at, self.shared, hashes = (b.column(c).to_numpy() for c in ("at", "shared", "hash"))
        self.spot = np.c_[b.column("block").to_numpy(), b.column("local").to_numpy()].astype("i4")
        self.by_hash, self.by_at = np.argsort(hashes).astype("i4"), np.argsort(self.at).astype("i4")
        self.hashes, self.places = hashes[self.by_hash], self.at[self.by_at]
        self.near = np.flatnonzero(self.shared >= 0)


class _SongTable:
    """The table of songs, read part by part; kept if it is small."""

    def __init__(self, uri: str, most: int) -> None:
        self.source = shared.open_dataset(uri) if uri else None
        self.kept = list(self._parts()) if self.source and self.source.count_rows() <= most else None

    def _parts(self) -> Iterator[_Part]:
        return (_Part(b) for b in self.source.to_batches(batch_size=1 << 18, **SPARING) if b.num_rows) if self.source else iter(())

    def __iter__(self) -> Iterator[_Part]:
        return self._parts() if self.kept is None else iter(self.kept)

    def find(self, names):
        """at, shared, block and local of each name; names that share a hash are told apart."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        out = np.full((len(names), 4), -1, "i8")
        out[:, 3] = 0
        hashes = xxhash64(names, None, np.full(len(names), 42, "u8")).view("i8")
        for p in self:
            left, where = np.arange(len(names)), np.searchsorted(p.hashes, hashes)
            while len(left):
                hit = p.hashes[np.minimum(where, len(p.hashes) - 1)] == hashes[left]
                hit &= where < len(p.hashes)
                left, where = left[hit], where[hit]
                row = p.by_hash[where]
                same = pc.equal(names.take(pa.array(left)), p.names.take(pa.array(row))).to_numpy(zero_copy_only=False)
                found, row = left[same], row[same]
                out[found, 0], out[found, 1], out[found, 2:] = p.at[row], p.shared[row], p.spot[row]
                left, where = left[~same], where[~same] + 1
        return out

    def at(self, places):
        """The songs at different places in ascending order, and their block and local."""
        import numpy as np
        import pyarrow as pa

        names, who, spot = [], [], []
        for p in self:
            where = np.minimum(np.searchsorted(p.places, places), len(p.places) - 1)
            hit = np.flatnonzero(p.places[where] == places)
            row = p.by_at[where[hit]]
            who.append(hit)
            spot.append(p.spot[row])
            names.append(p.names.take(pa.array(row)))
        if not names:
            return pa.array([], pa.string()), np.empty((0, 2), "i4")
        order = np.argsort(np.concatenate(who))
        return pa.concat_arrays(names).take(pa.array(order)), np.concatenate(spot)[order]

    def sharing(self, wanted) -> dict[int, list[tuple[str, int]]]:
        """(song, place) of the songs that have the ids wanted."""
        import numpy as np
        import pyarrow as pa

        out: dict[int, list[tuple[str, int]]] = {}
        for p in self if len(wanted) else ():
            hit = p.near[np.isin(p.shared[p.near], wanted)]
            for g, s, at in zip(p.shared[hit].tolist(), p.names.take(pa.array(hit)).to_pylist(), p.at[hit].tolist()):
                out.setdefault(g, []).append((s, at))
        return out


def _pairs_of(batches: list, table: _SongTable, total: int, blocks: int, n: int, parts: int) -> Iterator:
    import numpy as np
    import pyarrow as pa

    t = pa.Table.from_batches(batches).combine_chunks()
    lists, playlists = t["songs"].combine_chunks(), t["playlist_id"].to_pylist()
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    coded = lists.flatten().dictionary_encode()
    code, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    facts = table.find(coded.dictionary)[code]
    at = facts[:, 0]
    inside = np.sort(owner[at >= 0] * total + at[at >= 0])  # what each playlist holds

    def holds(who, place):
        key = who * total + place
        where = np.searchsorted(inside, key)
        return inside[np.minimum(where, len(inside) - 1)] == key

    lacks = np.where(at >= 0, n, 0)
    negative: list[tuple] = []
    near = np.flatnonzero(facts[:, 1] >= 0)
    mates = table.sharing(np.unique(facts[near, 1]))
    places = {g: np.array([p for _, p in m]) for g, m in mates.items()}
    for i in near.tolist():
        o, g = int(owner[i]), int(facts[i, 1])
        free = np.flatnonzero(~holds(o, places[g])).tolist()
        if free:
            start = f"{playlists[o]}|{names[code[i]]}|"
            best = sorted((hashlib.md5((start + mates[g][k][0]).encode()).digest(), mates[g][k]) for k in free)[:n]
            lacks[i] -= len(best)
            negative.append((np.full(len(best), o), np.array([p for _, (_, p) in best])))
    short = np.flatnonzero(lacks > 0)
    digests = b"".join(hashlib.md5(f"{playlists[o]}|{names[c]}".encode()).digest()[:8] for o, c in zip(owner[short].tolist(), code[short].tolist()))
    start = (np.frombuffer(digests, ">u8").astype("u8") >> np.uint64(4)).astype("i8") % max(1, total)
    missing, who, step = lacks[short], owner[short], 0
    while len(who) and step < total:
        place = (start + step) % total
        free = ~holds(who, place)
        negative.append((who[free], place[free]))
        missing = missing - free
        more = missing > 0
        start, missing, who, step = start[more], missing[more], who[more], step + 1

    other = np.concatenate([o for o, _ in negative]) if negative else np.empty(0, "i8")
    drawn, which = np.unique(np.concatenate([p for _, p in negative]) if negative else np.empty(0, "i8"), return_inverse=True)
    drawn_names, spot = table.at(drawn)
    seeds = xxhash64(t["playlist_id"].combine_chunks(), None, np.full(len(playlists), 42, "u8"))
    held_out = [hash_int(label, xxhash64(name, c, seeds[o])).view("i8") % parts == 0 for label, name, c, o in ((1, coded.dictionary, code, owner), (0, drawn_names, which, other))]
    both = lambda a, b: np.concatenate([a, b])
    owners, block, local, test = both(owner, other), both(facts[:, 2], spot[which, 0]), both(facts[:, 3], spot[which, 1]), both(*held_out)
    label = both(np.ones(len(owner), "i1"), np.zeros(len(other), "i1"))
    block = np.where(block < 0, owners % blocks, block)

    titles = t["text"].combine_chunks().dictionary_encode().indices.to_numpy()
    _, one = np.unique(titles, return_index=True)  # a playlist of each title
    title = titles[owners]
    order = np.lexsort((title, local, test, block))
    block, local, test, label, title = (x[order] for x in (block, local, test, label, title))
    if not len(order):
        return
    cuts = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
    unit, count = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts)), len(one)
    used, text = np.unique(unit * count + title, return_inverse=True)  # the titles of each unit, in a row
    first = np.searchsorted(used, np.arange(len(cuts)) * count)
    rows = pa.array(one[used % count])
    word, times = (t[c].combine_chunks().take(rows) for c in ("word", "times"))
    ends = np.cumsum(word.value_lengths().to_numpy(), dtype="i8")
    before = np.r_[0, ends][first]
    lists_of = lambda at, x, kind: pa.ListArray.from_arrays(pa.array(at.astype("i4")), x if isinstance(x, pa.Array) else pa.array(x, kind))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(block[cuts[:-1]], pa.int32()), pa.array(np.bincount(unit, ~test).astype("i8")), pa.array(np.diff(cuts), pa.int64()),
            lists_of(cuts, local, pa.int16()), lists_of(cuts, text - first[unit], pa.int32()), lists_of(cuts, label, pa.int8()),
            lists_of(first, ends - np.repeat(before[:-1], np.diff(first)), pa.int32()), lists_of(before, word.flatten().cast(pa.int16()), pa.int16()), lists_of(before, times.flatten(), pa.int32()),
        ],
        ["block", "train", "n", "song", "text", "label", "ends", "word", "times"],
    )


_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def _turn(x, k: int):
    import numpy as np

    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def _mixed(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(33))) * np.uint64(_P2)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(_P3)
    return h ^ (h >> np.uint64(32))


def hash_int(value: int, seeds):
    """Spark's xxhash64 of one int, by seed."""
    import numpy as np

    h = seeds + np.uint64(_P5) + np.uint64(4) ^ np.uint64(value * _P1 & 0xFFFFFFFFFFFFFFFF)
    return _mixed(_turn(h, 23) * np.uint64(_P2) + np.uint64(_P3))


def xxhash64(names, codes, seeds):
    """Spark's xxhash64 of ``names[codes]`` (all names without codes), each with its own seed."""
    import numpy as np
    import pyarrow as pa

    u = np.uint64
    if not len(names):
        return np.empty(0, "u8")
    names = names.cast(pa.large_binary())
    ends = np.frombuffer(names.buffers()[1], "i8")[names.offset : names.offset + len(names) + 1]
    data = np.frombuffer(names.buffers()[2] or b"", "u1")
    starts, lengths = ends[:-1], np.diff(ends)
    if codes is not None:
        starts, lengths = starts[codes], lengths[codes]
    out = np.empty(len(lengths), "u8")
    for size in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == size)
        for lo in range(0, len(rows), 1 << 18):
            some = rows[lo : lo + (1 << 18)]
            raw = data[starts[some][:, None] + np.arange(size)]
            seed, i = seeds[some], 0
            word = lambda i, k: np.ascontiguousarray(raw[:, i : i + k]).view(f"<u{k}")[:, 0].astype("u8")  # noqa: B023, E731
            if size >= 32:
                v = [seed + u((_P1 + _P2) & 0xFFFFFFFFFFFFFFFF), seed + u(_P2), seed.copy(), seed - u(_P1)]
                while i <= size - 32:
                    v = [_turn(x + word(i + 8 * k, 8) * u(_P2), 31) * u(_P1) for k, x in enumerate(v)]
                    i += 32
                h = _turn(v[0], 1) + _turn(v[1], 7) + _turn(v[2], 12) + _turn(v[3], 18)
                for x in v:
                    h = (h ^ _turn(x * u(_P2), 31) * u(_P1)) * u(_P1) + u(_P4)
            else:
                h = seed + u(_P5)
            h = h + u(size)
            while i + 8 <= size:
                h = _turn(h ^ _turn(word(i, 8) * u(_P2), 31) * u(_P1), 27) * u(_P1) + u(_P4)
                i += 8
            if i + 4 <= size:
                h = _turn(h ^ word(i, 4) * u(_P1), 23) * u(_P2) + u(_P3)
                i += 4
            while i < size:
                h = _turn(h ^ raw[:, i].astype("u8") * u(_P5), 11) * u(_P1)
                i += 1
            out[some] = _mixed(h)
    return out
