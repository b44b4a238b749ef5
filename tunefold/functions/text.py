"""String, array and token functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRIPLE = r"<id_l1_(\d+)> <id_l2_(\d+)> <id_l3_(\d+)>"
TOKEN = r"<id_l[123]_\d+>"
EOS = "<eos>"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def id_tokens(l1: Column | str, l2: Column | str, l3: Column | str) -> Column:
    return F.array(F.format_string("<id_l1_%d>", _c(l1)), F.format_string("<id_l2_%d>", _c(l2)), F.format_string("<id_l3_%d>", _c(l3)))


def sequence_text(tokens: Column | str, limit: int) -> Column:
    """The first ``limit`` tokens and the end mark; the cut may fall inside a triple."""
    return F.concat(F.array_join(F.slice(_c(tokens), 1, limit), " "), F.lit(f" {EOS}"))


def triples(sequence: Column | str) -> Column:
    """Complete triples whose three tokens stand side by side, as array of (l1, l2, l3)."""
    s = _c(sequence)
    parts = [F.regexp_extract_all(s, F.lit(TRIPLE), F.lit(i)) for i in (1, 2, 3)]
    zipped = F.arrays_zip(*[p.alias(n) for p, n in zip(parts, "abc")])
    return F.transform(zipped, lambda x: F.struct(*[x[n].cast("int").alias(m) for n, m in zip(("a", "b", "c"), ("l1", "l2", "l3"))]))


def flat_triples(ids: Column | str) -> Column:
    """A flat id array cut by three, doubles dropped in order, an incomplete tail dropped."""
    a = _c(ids)
    n = F.floor(F.size(a) / 3).cast("int")
    return F.when(n < 1, F.array().cast("array<array<int>>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(a, i * 3 + 1, 3))))


def gear_items(packed: Column | str, first: int = 20) -> Column:
    """``song:gear@@song:gear``: the first items that count are taken before the malformed ones are left out. Parts after
    the second are ignored; the id is trimmed."""
    return _items(F.slice(F.split(_c(packed), "@@"), 1, first), "gear", exact=False)


def vote_items(packed: Column | str) -> Column:
    """``song:vote,song:vote``; an element with another number of colons than one is left out."""
    return _items(F.split(_c(packed), ","), "vote", exact=True)


def _items(parts: Column, value: str, exact: bool) -> Column:
    def one(x: Column) -> Column:
        p = F.split(x, ":")
        fits = F.size(p) == 2 if exact else F.size(p) >= 2
        number = F.when(fits, strip(F.get(p, F.lit(1)))).try_cast("int")
        return F.struct(strip(F.get(p, F.lit(0))).alias("song_id"), number.alias(value))

    return F.filter(F.transform(parts, one), lambda x: x[value].isNotNull())


def padded(ids: Column | str, length: int, pad: int = 0) -> Column:
    """Cut or filled to a fixed length."""
    return F.slice(F.concat(_c(ids), F.array_repeat(F.lit(pad).cast("long"), length)), 1, length)


def attention_mask(ids: Column | str, length: int) -> Column:
    n = F.least(F.size(_c(ids)), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1).cast("long"), n), F.array_repeat(F.lit(0).cast("long"), F.lit(length) - n))


def file_name(keyword: Column | str) -> Column:
    return F.regexp_replace(_c(keyword), r"[^\p{L}\p{N}]", "_")


def song_label(song: Column | str, name: Column | str, singer: Column | str, missing: str = "N/A") -> Column:
    return F.concat_ws("-", _c(song), F.coalesce(_c(name), F.lit(missing)), F.coalesce(_c(singer), F.lit(missing)))


def prefix(text: str) -> tuple[int, ...]:
    """``"10,55"`` as a prefix of one to three levels."""
    try:
        levels = tuple(int(x) for x in text.split(","))
    except ValueError:
        raise ValueError(f"not a semantic id prefix: {text!r}") from None
    if not 1 <= len(levels) <= 3:
        raise ValueError("a prefix has one to three levels")
    return levels


def is_prefix_query(text: str) -> bool:
    """Whether an entered text means a prefix rather than a song id."""
    return "," in text or (text.isdigit() and len(text) < 4)
