"""Mixing sources to target weights (problem 9): Sainte-Lague apportionment of equal-token blocks.

The total is the largest at which no source needs more than its cap of repeats. Each source's share becomes a number of
blocks of equal token size, given out by highest quotients (blocks to the source with the largest share / (2 seats + 1)).
A source's blocks are divided in the same way by tokens, first among groups of ``GROUP`` shards, then in each group among
its shards. In a shard the records stand in seeded order on a ring of blocks; the shard's quota is a run of blocks from a
seeded place, and a record is taken once more than the rest if its middle lies in the run; one record more or less closes the gap left.

The driver holds a number per source and group of shards; shards are divided where they are. Blocks are at least as many
as ``blocks`` and never larger than a sixteenth of a shard.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunefold import shared

SHARD_TOKENS = 1_000_000
BLOCKS = 4096
GROUP = 1024


def sainte_lague(weights: list[Fraction], seats: int) -> list[int]:
    """Seats by highest quotients weight / (2 seats + 1); ties go to the earlier entry.

    All seats that the highest quotients give for certain are set at once by the divisor, the last few by a heap.
    """
    total = sum(weights)
    if not total or seats <= 0:
        return [0] * len(weights)
    # with the quota as divisor each gets within half a seat a number of parties of its due; start just below
    got = [max(0, int(w * (seats - len(weights)) / total + Fraction(1, 2)) - 1) if w else 0 for w in weights]
    while sum(got) > seats:
        worst = min((Fraction(w) / (2 * g - 1), -i) for i, (w, g) in enumerate(zip(weights, got)) if g)
        got[-worst[1]] -= 1
    heap = [(-Fraction(w) / (2 * g + 1), i) for i, (w, g) in enumerate(zip(weights, got)) if w]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(heap)
        got[i] += 1
        heapq.heappush(heap, (-Fraction(weights[i]) / (2 * got[i] + 1), i))
    return got


def plan_blocks(targets: list[tuple[str, float, int]], available: dict[str, int], blocks: int = BLOCKS) -> tuple[Fraction, dict[str, int]]:
    """Block size in tokens and blocks per source. A source without tokens, a share that isn't positive or a cap below
    one gets none; the others keep their ratios."""
    live = [(s, Fraction(str(w)), r) for s, w, r in targets if s is not None and w and w > 0 and r and r > 0 and available.get(s, 0) > 0]
    if not live:
        return Fraction(0), {}
    total = sum(w for _, w, _ in live)
    size = min(Fraction(available[s] * r) * total / w for s, w, r in live)
    block = size / blocks
    quota = sainte_lague([w for _, w, _ in live], blocks)
    # rounding up must not break a cap
    caps = {s: int(Fraction(available[s] * r) / block) for s, _, r in live}
    return block, {s: min(q, caps[s]) for (s, _, _), q in zip(live, quota)}


def _divide(seed: int):
    """The quota of each shard of a group: ``run`` tokens in whole blocks, from the place ``turn`` on."""

    def run(key, table):
        from hashlib import blake2b

        import pandas as pd

        table = table.sort_values("shard")
        block = float(table["block"].iloc[0])
        seats = sainte_lague([Fraction(int(n)) for n in table["held"]], int(table["blocks"].iloc[0]))
        turns = []
        for shard, held in zip(table["shard"], table["held"]):
            places = max(1, int(held / block)) if block else 1
            turns.append(int.from_bytes(blake2b(f"{seed}|{key[0]}|{key[1]}|{shard}".encode(), digest_size=8).digest(), "big") % places * block)
        return pd.DataFrame({"plan_name": key[0], "source": key[1], "shard": table["shard"], "full": table["full"], "run": [n * block for n in seats], "held": table["held"], "turn": turns})

    return run


def mix(df: DataFrame, key: str, source: str, size: str, targets: DataFrame, seed: int = 9, blocks: int = BLOCKS, shard_tokens: int = SHARD_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Chosen records (plan_name, source, doc_id, times, tokens) and shares (plan_name, source, target_share, max_repeats,
    available_tokens, records, tokens, actual_share).

    * Records of a null source, or without tokens, are never chosen. A source of a plan that holds no tokens stays in the
      shares with zeros; the other sources keep their ratios to each other.
    * ``times`` is at most max_repeats. Repeated rows of a key are records of their own. Empty tables give no records.
    * ``targets`` is a table of a few rows; the driver reads it.
    """
    spark = df.sparkSession
    base = df.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(size).cast("long").alias("tokens")).where("source IS NOT NULL AND tokens > 0")
    base = shared.materialise(base, "p9-sizes")
    available = {r["source"]: int(r["n"]) for r in base.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi").groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    shards = {s: max(1, -(-n // shard_tokens)) for s, n in available.items()}
    counts = spark.createDataFrame([(s, n) for s, n in sorted(shards.items())] or [("", 1)], "source string, shards long")
    sharded = base.join(F.broadcast(counts), "source").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("shards"))).drop("shards")
    sizes = shared.materialise(sharded.groupBy("source", "shard").agg(F.sum("tokens").alias("held")).withColumn("group", (F.col("shard") / GROUP).cast("int")), "p9-shards")
    groups: dict[str, list[tuple[int, int]]] = {}
    for r in sizes.groupBy("source", "group").agg(F.sum("held").alias("n")).orderBy("source", "group").collect():
        groups.setdefault(r["source"], []).append((r["group"], int(r["n"])))

    quotas, goals = [], [tuple(r) for r in targets.select("plan_name", "source", "target_share", "max_repeats").collect()]
    for plan in sorted({g[0] for g in goals if g[0] is not None}):
        own_goals = [g[1:] for g in goals if g[0] == plan]
        whole, _ = plan_blocks(own_goals, available, 1)
        block, own = plan_blocks(own_goals, available, max(blocks, int(whole * 16 / shard_tokens)))
        for s, q in own.items():
            full, rest = divmod(q * block, available[s])  # whole repeats, and tokens of the last one
            rest_blocks = int(rest / block + Fraction(1, 2)) if block else 0
            for (group, _), b in zip(groups[s], sainte_lague([Fraction(n) for _, n in groups[s]], rest_blocks)):
                quotas.append((plan, s, group, int(full), b, float(block)))
    wanted = spark.createDataFrame(quotas or [("", "", 0, 0, 0, 0.0)], "plan_name string, source string, group int, full int, blocks long, block double")
    shape = "plan_name string, source string, shard long, full int, run double, held long, turn double"
    by_shard = sizes.join(wanted, ["source", "group"]).groupBy("plan_name", "source", "group").applyInPandas(_divide(seed), shape)

    seeded = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sharded.withColumn("middle", F.sum("tokens").over(seeded) - F.col("tokens") / 2)
    chosen = placed.join(by_shard, ["source", "shard"])
    inside = F.pmod(F.col("middle") - F.col("turn"), F.col("held").cast("double")) < F.col("run")
    # one record more or less, the one that comes nearest to what whole records leave open
    own = Window.partitionBy("plan_name", "source", "shard")
    chosen = chosen.withColumn("inside", inside)
    chosen = chosen.withColumn("gap", F.col("run") - F.coalesce(F.sum(F.when(F.col("inside"), F.col("tokens"))).over(own), F.lit(0)))
    chosen = chosen.withColumn("off", F.when(F.col("inside") == (F.col("gap") < 0), F.abs(F.col("tokens") - F.abs("gap"))))
    chosen = chosen.withColumn("nearest", F.row_number().over(own.orderBy(F.asc_nulls_last("off"), F.xxhash64(F.lit(seed), "doc_id"), "doc_id")) == 1)
    turned = F.col("nearest") & F.coalesce(F.col("off") < F.abs("gap"), F.lit(False))
    chosen = chosen.withColumn("times", F.col("full") + (F.col("inside") != turned).cast("int"))
    limits = targets.select("plan_name", "source", F.col("max_repeats").alias("cap"))
    chosen = chosen.join(F.broadcast(limits), ["plan_name", "source"]).withColumn("times", F.least("times", "cap")).where("times > 0")
    chosen = chosen.select("plan_name", "source", "doc_id", F.col("times").cast("int").alias("times"), "tokens")

    used = chosen.groupBy("plan_name", "source").agg(F.count("*").alias("records"), F.sum(F.col("tokens") * F.col("times")).alias("tokens"))
    have = spark.createDataFrame(sorted(available.items()) or [("", 0)], "source string, available_tokens long")
    shares = targets.select("plan_name", "source", "target_share", "max_repeats").join(F.broadcast(have), "source", "left").join(used, ["plan_name", "source"], "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("available_tokens", "records", "tokens")]
    shares = shares.select("plan_name", "source", "target_share", "max_repeats", *zero)
    actual = F.col("tokens") / F.nullif(F.sum("tokens").over(Window.partitionBy("plan_name")), F.lit(0))
    return chosen, shares.withColumn("actual_share", F.round(F.coalesce(actual, F.lit(0.0)), 6))
