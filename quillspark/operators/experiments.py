"""The query layer over evaluation results: specifications that become filters, and ranking with ties."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Experiment:
    """What to keep of an evaluation table, and how many of the best."""

    score: str = "ari"
    high_is_best: bool = True
    max_share: float | None = None
    nclust_min: int | None = None
    nclust_max: int | None = None
    attr: str | None = None
    matrix: str | None = None
    ntop: int = 30


def grid(**options: list) -> list[dict]:
    """The product of lists of options, in the order given."""
    return [dict(zip(options, x)) for x in product(*options.values())]


def sizes(text: Column) -> Column:
    """'300, 2x100' as an array of sizes; null for null, parts that are no sizes are left out."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))
    good = F.filter(parts, lambda p: p.rlike("^([0-9]+x)?[0-9]+$"))
    one = lambda p: F.array_repeat(F.element_at(F.split(p, "x"), -1).cast("long"), F.when(p.contains("x"), F.element_at(F.split(p, "x"), 1).cast("int")).otherwise(1))
    return F.flatten(F.transform(good, one))


def within_share(sizes_: Column, share: float) -> Column:
    """Is the largest cluster at most share of the texts that aren't alone in a cluster, rounded half to even."""
    total = F.aggregate(sizes_, F.lit(0).cast("long"), lambda a, x: a + x)
    alone = F.size(F.filter(sizes_, lambda x: x == 1))
    return F.array_max(sizes_) <= F.bround(share * (total - alone))


def top_with_ties(df: DataFrame, score: str, n: int, high: bool = True) -> DataFrame:
    """The n best rows and all that tie with the last; null scores never. Spark keeps n ranks a task before the shuffle."""
    w = Window.orderBy(F.desc(score) if high else F.asc(score))
    return df.where(F.col(score).isNotNull()).withColumn("_r", F.rank().over(w)).where(F.col("_r") <= n).drop("_r")


def run(evals: DataFrame, e: Experiment) -> DataFrame:
    """evals filtered and ranked by the experiment."""
    d = evals.where(F.col(e.score).isNotNull() & ~F.coalesce(F.col("file_info").contains("mirror"), F.lit(False)))
    if e.attr:
        d = d.where(F.col("attr") == e.attr)
    if e.matrix:
        d = d.where(F.col("mxname").rlike(e.matrix))
    if e.nclust_min is not None:
        d = d.where(F.col("nclust") >= e.nclust_min)
    if e.nclust_max is not None:
        d = d.where(F.col("nclust") <= e.nclust_max)
    if e.max_share is not None:
        d = d.where(within_share(sizes(F.col("clst_sizes")), e.max_share))
    return top_with_ties(d, e.score, e.ntop, e.high_is_best)


def keep_first(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row a key, the first in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
