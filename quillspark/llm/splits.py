"""Splits that keep related records together (problem 3).

Records are joined to the entities of their author and file name (problem 1) and to their
source volume. Parallel hooking and shortcutting over parent tables gives the groups of
records that are joined directly or through others. Group sizes are then placed in splits:
a subset-sum bitset over the multiplicities of the sizes finds the reachable total closest
to each split's share, and which sizes make it up.

The bitset has one bit a record. Sizes and multiplicities go to the driver, never groups:
there are at most about sqrt(2 n) different sizes. Beyond MAX_UNITS records the bitset is
over the smaller groups, which fill what the larger ones leave; the totals are the closest
at any number of records.

Odd input: records without author, file name and volume are groups of their own, as are
anonymous ones without a volume; null ids are dropped; repeated rows change nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import names
from quillspark.operators.components import components
from quillspark.session import written

#: Bits of the subset-sum bitset at most (2 MB).
MAX_UNITS = 1 << 24


def groups(df: DataFrame, key: str = "text_id", volume: str = "source_vol", **columns: str) -> DataFrame:
    """(first_key, key): every key with the smallest key of its group.

    An entity or volume is a vertex of its own beside its records, so one that holds a third of all
    records adds one edge a record and never a pair of records.
    """
    found = names.link(df, key=key, **columns)
    vol = F.nullif(F.lower(F.regexp_replace(F.trim(F.col(volume)), r"\s+", " ")), F.lit(""))
    by_vol = df.select(F.col(key).alias("rec"), vol.alias("v")).where("v IS NOT NULL AND rec IS NOT NULL").distinct()
    ends = found.recs.select("rec", F.concat(F.lit("e"), "entity").alias("hub")).unionByName(by_vol.select("rec", F.concat(F.lit("v"), "v").alias("hub")))
    # records sort before hubs and each other by their number: the smallest vertex of a component is its smallest record
    first = ends.groupBy("hub").agg(F.min("rec").alias("b"))
    edges = ends.join(first, "hub").select(F.col("rec").alias("a"), "b").distinct()
    alone = df.select(F.col(key).alias("a"), F.col(key).alias("b")).where("a IS NOT NULL").distinct()
    return components(edges.unionByName(alone).distinct()).select(F.col("component").alias(f"first_{key}"), F.col("node").alias(key))


def closest_subset(sizes: dict[int, int], target: int) -> dict[int, int]:
    """How many groups of each size to take so that their total is as close to target as any; the smaller of two as close.

    Bit t of the set says that total t can be reached. Each multiplicity is split into powers of two,
    the set after each part is kept, and the parts are read off backwards.
    """
    top = min(sum(s * n for s, n in sizes.items()), 2 * target)
    keep = (1 << (top + 1)) - 1
    reach, parts, before = 1, [], []
    for size in sorted(sizes, reverse=True):
        n, step = sizes[size], 1
        while n > 0:
            take = min(step, n)
            before.append(reach)
            parts.append((size, take))
            reach |= (reach << size * take) & keep
            n -= take
            step *= 2
    low = reach & ((1 << (target + 1)) - 1)
    best = low.bit_length() - 1
    high = reach >> (target + 1)
    if high:
        above = target + 1 + (high & -high).bit_length() - 1
        best = above if above - target < target - best else best
    chosen: dict[int, int] = {}
    for (size, take), was in zip(reversed(parts), reversed(before)):
        if not (was >> best) & 1:
            chosen[size] = chosen.get(size, 0) + take
            best -= size * take
    return chosen


def closest(sizes: dict[int, int], target: int) -> dict[int, int]:
    """closest_subset() of any number of records, without a bitset of them all where it isn't needed.

    Beyond MAX_UNITS bits the larger sizes are placed from the largest, as many as fit, and the bitset is over
    the smaller ones, which fill what is left. Totals are multiples of the greatest common divisor of all
    sizes, so a total as close as a multiple can be is the closest. Only if that isn't met is the bitset
    over all records, whatever their number.
    """
    if min(sum(s * n for s, n in sizes.items()), 2 * target) <= MAX_UNITS or not sizes:
        return closest_subset(sizes, target)
    step = math.gcd(*sizes)
    nearest = min(target % step, step - target % step)
    small: dict[int, int] = {}
    room = MAX_UNITS
    for s in sorted(sizes):
        small[s] = min(sizes[s], room // s)
        room -= s * small[s]
    left, take = target, {}
    for s in sorted(sizes, reverse=True):
        take[s] = min(sizes[s] - small[s], left // s)
        left -= s * take[s]
    small = {s: n for s, n in small.items() if n}
    fill = closest_subset(small, min(left, MAX_UNITS))
    if abs(left - sum(s * n for s, n in fill.items())) == nearest:
        return {s: n + fill.get(s, 0) for s, n in take.items()}
    return closest_subset(sizes, target)


def plan(sizes: dict[int, int], shares: list[tuple[str, float]]) -> list[tuple[str, int, int, int]]:
    """(split, size, from, to): of the groups of each size, in their order, those from up to but without to are in the split."""
    total = sum(s * n for s, n in sizes.items())
    left, used, out = dict(sizes), dict.fromkeys(sizes, 0), []
    rest = sum(p for _, p in shares)
    # the smallest shares first: they are the hardest to meet
    for k, (split, share) in enumerate(ordered := sorted(shares, key=lambda x: x[1])):
        take = dict(left) if k == len(ordered) - 1 else closest({s: n for s, n in left.items() if n}, round(total * share / rest))
        for size, n in take.items():
            if n:
                out.append((split, size, used[size], used[size] + n))
                used[size] += n
                left[size] -= n
    return out


def assign(grouped: DataFrame, shares: dict[str, float], key: str = "text_id") -> DataFrame:
    """(key, first_key, split): every group in one split, the splits' totals as close to the shares as the sizes allow."""
    first = f"first_{key}"
    if not shares or any(p < 0 for p in shares.values()) or sum(shares.values()) <= 0:
        raise ValueError("shares must be positive")
    sized = written(grouped.groupBy(first).agg(F.count("*").alias("size")))
    spark = grouped.sparkSession
    sizes = {r["size"]: r["n"] for r in sized.groupBy("size").agg(F.count("*").alias("n")).collect()}
    rows = plan(sizes, list(shares.items())) or [("none", 0, 0, 0)]
    ranges = spark.createDataFrame(rows, "split string, size long, low long, high long")
    # the groups of a size in an order spread over partitions: singletons may be most of all groups
    placed = _ranked(sized, first).join(F.broadcast(ranges), "size").where("at >= low AND at < high").select(first, "split")
    return grouped.join(placed, first).select(key, first, "split")


def _ranked(sized: DataFrame, first: str) -> DataFrame:
    """sized with at, from 0, among the groups of a size, counted in salted parts so that no size is one task."""
    parts = written(sized.withColumn("salt", F.pmod(F.xxhash64(first), F.lit(64))))
    counts = parts.groupBy("size", "salt").agg(F.count("*").alias("n"))
    w = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("base", F.coalesce(F.sum("n").over(w), F.lit(0))).select("size", "salt", "base")
    within = F.row_number().over(Window.partitionBy("size", "salt").orderBy(first)) - 1
    return parts.withColumn("_k", within).join(before, ["size", "salt"]).select(first, "size", (F.col("_k") + F.col("base")).alias("at"))
