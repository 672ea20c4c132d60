"""Metadata, labels and descriptive statistics of texts and authors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def year(text: Column) -> Column:
    """The smallest four-digit year in a string such as '1799|1801' or '1799?'; null if there is none."""
    return F.array_min(F.transform(F.regexp_extract_all(text, F.lit("[0-9]{4}"), F.lit(0)), lambda x: x.cast("int")))


def ordinal(x: Column, *cuts: float) -> Column:
    """0 below the first cut, 1 from it up to the second, and so on; null for null."""
    out = F.when(x < cuts[0], 0)
    for i, c in enumerate(cuts[1:], 1):
        out = out.when(x < c, i)
    return F.when(x.isNotNull(), out.otherwise(len(cuts)))


def file_author(name: Column) -> Column:
    return F.array_join(F.slice(F.split(name, "_"), 1, 2), "_")


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", validate: str = "one_to_one") -> DataFrame:
    """A join whose keys are proved unique first on the sides that must have one row a key; raises ValueError otherwise."""
    sides = {"one_to_one": (left, right), "many_to_one": (right,), "one_to_many": (left,), "many_to_many": ()}[validate]
    for df in sides:
        if not df.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            raise ValueError(f"keys {on} are not unique in a {validate} join")
    return left.join(right, on, how)


def group_numbers(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, group): 0, 1, ... over the distinct keys in order; the window holds one row a key."""
    return df.select(*keys).distinct().withColumn("group", F.row_number().over(Window.orderBy(*keys)) - 1)


def average_ranks(df: DataFrame, value: str, group: list[str], name: str) -> DataFrame:
    """(group, value, name): the mean rank of each distinct value of a group, from its counts."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_t"))
    w = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*group, value, (F.coalesce(F.sum("_t").over(w), F.lit(0)) + (F.col("_t") + 1) / 2).alias(name))


def spearman(df: DataFrame, x: str, y: str, group: str) -> DataFrame:
    """(group, rho, n): rank correlation over rows that have both values."""
    r = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(group).isNotNull())
    a, b = average_ranks(r, x, [group], "_rx"), average_ranks(r, y, [group], "_ry")
    return r.join(a, [group, x]).join(b, [group, y]).groupBy(group).agg(F.round(F.corr("_rx", "_ry"), 6).alias("rho"), F.count("*").alias("n"))


def upsample(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of each key repeated until all have as many as the largest: whole copies, then the first ones again."""
    w = Window.partitionBy(key)
    n = df.groupBy(key).agg(F.count("*").alias("_n"))
    most = n.agg(F.max("_n").alias("_m"))
    d = df.join(n, key).crossJoin(F.broadcast(most)).withColumn("_r", F.row_number().over(w.orderBy(order)))
    times = F.floor(F.col("_m") / F.col("_n")) + (F.col("_r") <= F.col("_m") % F.col("_n")).cast("int")
    return d.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), times))).drop("_n", "_m", "_r")


def closest_names(names: DataFrame, name: str = "name", folded: str = "a", most: int = 4) -> DataFrame:
    """(name, other, dist): the closest other name by Levenshtein distance of folded, up to most edits, the first of equals.

    No pair is lost: a string is cut into most + 1 pieces, and most edits leave one of them whole. The longer
    string of a pair then holds that piece, shifted by no more than the edits before it and those after it
    allow. Names are joined on (length, number of the piece, piece) and all candidates are verified.
    A piece may be empty, so short names meet all names that are as short. Candidates aren't shuffled,
    but they grow with the number of names that share a piece.
    """
    k = most + 1
    at = lambda n, i: f"({i} * ({n} div {k}) + greatest(0, {i} - ({k} - {n} % {k})))"
    size = lambda n, i: f"({n} div {k} + if({i} >= {k} - {n} % {k}, 1, 0))"
    base = names.where(F.col(folded).isNotNull()).select(F.col(name).alias("n"), F.col(folded).alias("a"), F.length(folded).alias("l"))
    own = f"transform(sequence(0, {most}), i -> struct(l, i, substr(a, {at('l', 'i')} + 1, {size('l', 'i')}) AS s))"
    # d: how much longer this string is than the one cut into pieces
    low = f"greatest(0, {at('(l - d)', 'i')} - i, {at('(l - d)', 'i')} + d - ({most} - i))"
    high = f"least(l - {size('(l - d)', 'i')}, {at('(l - d)', 'i')} + i, {at('(l - d)', 'i')} + d + ({most} - i))"
    held = f"if({high} >= {low}, transform(sequence({low}, greatest({low}, {high})), p -> struct(l - d AS l, i, substr(a, p + 1, {size('(l - d)', 'i')}) AS s)), array())"
    all_held = f"flatten(transform(sequence(0, least({most}, l)), d -> flatten(transform(sequence(0, {most}), i -> {held}))))"
    short = base.select(F.col("n").alias("n1"), F.col("a").alias("a1"), F.explode(F.expr(own)).alias("x")).select("n1", "a1", "x.*")
    long = base.select(F.col("n").alias("n2"), F.col("a").alias("a2"), F.explode(F.array_distinct(F.expr(all_held))).alias("x")).select("n2", "a2", "x.*")
    near = short.join(long, ["l", "i", "s"]).where("n1 <> n2").withColumn("dist", F.levenshtein("a1", "a2", most)).where("dist >= 0")
    both = near.select(F.explode(F.array(F.struct(F.col("n1").alias("n"), F.col("n2").alias("other"), "dist"), F.struct(F.col("n2").alias("n"), F.col("n1").alias("other"), "dist"))).alias("p"))
    best = both.groupBy(F.col("p.n").alias(name)).agg(F.min(F.struct("p.dist", "p.other")).alias("b"))
    return best.select(name, F.col("b.other").alias("other"), F.col("b.dist").cast("long").alias("dist"))
