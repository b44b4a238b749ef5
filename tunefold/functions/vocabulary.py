"""Token ids of semantic-id sequences: the levels' tokens in order, then the special tokens, from a base number on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The special tokens in their order.
SPECIAL = ("<user>", "<eos>", "<unk>", "<pad>", "<mask>", "<sep>")
LEVELS = (128, 128, 256)


def size(levels: tuple[int, ...] = LEVELS) -> int:
    return sum(levels) + len(SPECIAL)


def special_id(token: str, levels: tuple[int, ...] = LEVELS, base: int = 0) -> int:
    return base + sum(levels) + SPECIAL.index(token)


def table(spark: SparkSession, levels: tuple[int, ...] = LEVELS, base: int = 0) -> DataFrame:
    """(token, id, level, value) of the whole vocabulary; level and value are null for special tokens."""
    rows, at = [], base
    for k, n in enumerate(levels, 1):
        rows += [(f"<id_l{k}_{i}>", at + i, k, i) for i in range(n)]
        at += n
    rows += [(t, at + i, None, None) for i, t in enumerate(SPECIAL)]
    return spark.createDataFrame(rows, "token string, id int, level int, value int")


def token_id(token: Column, levels: tuple[int, ...] = LEVELS, base: int = 0) -> Column:
    """The id of one token, without a join; a level's value beyond its size, or another word, is ``<unk>``."""
    level = F.regexp_extract(token, r"^<id_l([123])_(\d+)>$", 1)
    value = F.regexp_extract(token, r"^<id_l([123])_(\d+)>$", 2).try_cast("int")
    out = F.lit(None).cast("int")
    start = base
    for k, n in enumerate(levels, 1):
        out = F.when((level == str(k)) & (value < n), value + start).otherwise(out)
        start += n
    for i, t in enumerate(SPECIAL):
        out = F.when(token == t, F.lit(start + i)).otherwise(out)
    return F.coalesce(out, F.lit(special_id("<unk>", levels, base)))


def encode(sequence: Column, length: int = 384, levels: tuple[int, ...] = LEVELS) -> tuple[Column, Column]:
    """(ids, labels) of fixed length: padded with ``<pad>``, and with -100 where no loss is wanted."""
    words = F.filter(F.split(F.trim(sequence), r"\s+"), lambda x: x != "")
    ids = F.transform(words, lambda w: token_id(w, levels))

    def fill(x: int) -> Column:
        return F.slice(F.concat(ids, F.array_repeat(F.lit(x), length)), 1, length)

    return fill(special_id("<pad>", levels)), fill(-100)


def decode(ids: Column, levels: tuple[int, ...] = LEVELS) -> Column:
    """The tokens of an array of ids, without padding; an unknown id is ``<unk>``."""
    def one(i: Column) -> Column:
        out, start = F.lit("<unk>"), 0
        for k, n in enumerate(levels, 1):
            out = F.when((i >= start) & (i < start + n), F.concat(F.lit(f"<id_l{k}_"), (i - start).cast("string"), F.lit(">"))).otherwise(out)
            start += n
        for j, t in enumerate(SPECIAL):
            out = F.when(i == start + j, F.lit(t)).otherwise(out)
        return out

    pad = special_id("<pad>", levels)
    return F.array_join(F.transform(F.filter(ids, lambda i: (i != pad) & (i >= 0)), one), " ")
