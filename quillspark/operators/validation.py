"""Cross-validation folds, regression and classification metrics, and model selection."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_folds(df: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """(group, n, fold): whole groups, the largest first, each to the fold that is lightest so far.

    Only the distinct group sizes with their numbers go to the driver. Of the groups of one size, which
    come in the order of their names, a run of equal steps is dealt at once; a row number within the
    size says which group is which.
    """
    sized = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"))
    counts = sorted(((r["n"], r["k"]) for r in sized.groupBy("n").agg(F.count("*").alias("k")).collect()), reverse=True)
    load = [0] * folds
    deals = []
    for n, k in counts:
        order: list[int] = []
        rest = k
        while rest and (max(load) - min(load) > n or len(order) % folds or not order):
            f = min(range(folds), key=lambda i: (load[i], i))
            order.append(f)
            load[f] += n
            rest -= 1
        cycle: list[int] = []
        for _ in range(min(rest, folds)):
            f = min(range(folds), key=lambda i: (load[i], i))
            cycle.append(f)
            load[f] += n
        rest -= len(cycle)
        full, left = divmod(rest, folds)
        for i in range(folds):
            load[i] += n * full
        for f in cycle[:left]:
            load[f] += n
        deals.append((n, order, cycle or [0]))
    plan = df.sparkSession.createDataFrame(deals or [(0, [], [0])], "n long, first array<int>, cycle array<int>")
    at = F.row_number().over(Window.partitionBy("n").orderBy(group)) - 1
    d = sized.withColumn("_at", at).join(F.broadcast(plan), "n")
    size = F.size("first")
    fold = F.when(F.col("_at") < size, F.get("first", F.col("_at"))).otherwise(F.get("cycle", (F.col("_at") - size) % F.size("cycle")))
    return d.select(group, "n", fold.alias("fold"))


def regression_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """(r, r2, rmse, mae, n) over rows that have both."""
    e = F.col(y) - F.col(p)
    d = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    a = d.agg(F.corr(y, p).alias("r"), F.sum(e * e).alias("sse"), F.var_pop(y).alias("v"), F.avg(F.abs(e)).alias("mae"), F.count("*").alias("n"))
    return a.select(F.round("r", 6).alias("r"), F.round(1 - F.col("sse") / F.nullif(F.col("v") * F.col("n"), F.lit(0.0)), 6).alias("r2"), F.round(F.sqrt(F.col("sse") / F.col("n")), 6).alias("rmse"), F.round("mae", 6).alias("mae"), "n")


def classification_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """(acc, balanced_acc, f1_macro, f1_weighted) from the confusion counts; classes are those of y or p."""
    c = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n"))
    t = c.groupBy(F.col("y").alias("k")).agg(F.sum("n").alias("t"))
    q = c.groupBy(F.col("p").alias("k")).agg(F.sum("n").alias("q"))
    h = c.where("y = p").select(F.col("y").alias("k"), F.col("n").alias("h"))
    m = t.join(q, "k", "full").join(h, "k", "left").na.fill(0)
    f1 = F.expr("2 * h / nullif(t + q, 0)")
    a = m.agg((F.sum("h") / F.sum("t")).alias("acc"), F.avg(F.expr("CASE WHEN t > 0 THEN h / t END")).alias("b"), F.avg(f1).alias("f"), (F.sum(f1 * F.col("t")) / F.sum("t")).alias("w"))
    return a.select(F.round("acc", 6).alias("acc"), F.round("b", 6).alias("balanced_acc"), F.round("f", 6).alias("f1_macro"), F.round("w", 6).alias("f1_weighted"))


def harmonic_p(df: DataFrame, p: str, *keys: str) -> DataFrame:
    """Harmonic mean of p-values a key: k / sum(1 / p), 0 if any is 0."""
    return df.groupBy(*keys).agg(F.round(F.when(F.min(p) == 0, 0.0).otherwise(F.count(p) / F.sum(1 / F.nullif(F.col(p), F.lit(0.0)))), 6).alias("harmonic_p"))


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): N / (classes * n). The window holds one row a class."""
    c = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(1))
    return c.select(label, "n", F.round(F.sum("n").over(w) / (F.count("*").over(w) * F.col("n")), 6).alias("weight"))


def grid_search(df: DataFrame, estimators: list, evaluator, fold: str, label: str = "label"):
    """[(estimator number, mean score, scores)] of Spark ML estimators over the folds in column fold (0, 1, ...)."""
    folds = sorted(r[0] for r in df.select(fold).where(F.col(fold).isNotNull()).distinct().collect())
    out = []
    for i, e in enumerate(estimators):
        scores = [evaluator.evaluate(e.fit(df.where(F.col(fold) != f)).transform(df.where(F.col(fold) == f))) for f in folds]
        out.append((i, float(np.mean(scores)), scores))
    return out


def aliased_groups(df: DataFrame, group: str, alias: DataFrame) -> DataFrame:
    """df with the column group replaced by the name that alias (alias, name) gives it, where there is one."""
    a = alias.select(F.col("alias").alias("_a"), F.col("name").alias("_name"))
    return df.join(a, F.col(group) == F.col("_a"), "left").withColumn(group, F.coalesce("_name", group)).drop("_a", "_name")


def stratified_group_folds(df: DataFrame, group: str, label: str, folds: int = 5) -> DataFrame:
    """(group, fold): whole groups, each to the fold where the shares of the labels then vary least over the folds.

    Groups come by falling spread of their label counts, equal ones by name; of folds that do equally well the
    one with fewer rows, then the first. Only distinct vectors of label counts, with their numbers, go to the
    driver, in the order in which their groups are dealt; a row number within a vector says which group is which.
    """
    rows = df.where(F.col(group).isNotNull() & F.col(label).isNotNull())
    labels = [r[0] for r in rows.select(label).distinct().orderBy(label).collect()]
    vec = F.array(*[F.count_if(F.col(label) == x) for x in labels]) if labels else F.array().cast("array<long>")
    counted = rows.groupBy(group).agg(vec.alias("_v"))
    kinds = [(list(r["_v"]), r["k"]) for r in counted.groupBy("_v").agg(F.count("*").alias("k")).collect()]
    kinds.sort(key=lambda x: (-float(np.std(x[0])), x[0]))
    total = np.sum([np.array(v) * k for v, k in kinds], axis=0) if kinds else np.zeros(0)
    have = np.zeros((folds, len(labels)))
    plan = []
    for v, k in kinds:
        order = []
        for _ in range(k):
            best = None
            for f in range(folds):
                have[f] += v
                score = float(np.mean(np.std(have / total, axis=0)))
                have[f] -= v
                rank = (round(score, 12), float(have[f].sum()), f)
                best = min(best or rank, rank)
            have[best[2]] += v
            order.append(best[2])
        plan.append((v, order))
    table = df.sparkSession.createDataFrame(plan, "_v array<long>, _o array<int>")
    at = F.row_number().over(Window.partitionBy("_v").orderBy(group)) - 1
    return counted.withColumn("_at", at).join(F.broadcast(table), "_v").select(group, F.get("_o", F.col("_at")).alias("fold"))


def dropped(df: DataFrame, parts: list[str]) -> DataFrame:
    """df without the columns whose names hold one of parts."""
    return df.select(*[c for c in df.columns if not any(p in c for p in parts)])


def baseline_scores(df: DataFrame, y: str, key: str, seed: int = 1) -> DataFrame:
    """(baseline, acc) of guesses that don't look at the text: the first class for all, uniform, by the classes' shares, and one of the two largest.

    The chance of a row comes from its key and the seed alone.
    """
    rows = df.where(F.col(y).isNotNull())
    n = rows.groupBy(y).agg(F.count("*").alias("_n"))
    order = Window.orderBy(F.desc("_n"), y)
    c = n.select(y, "_n", (F.row_number().over(order) - 1).alias("_i"), F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_to"), F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_all"), F.count("*").over(Window.partitionBy(F.lit(1))).alias("_k"))
    packed = c.agg(F.sort_array(F.collect_list(F.struct("_i", F.col(y).alias("c"), "_to"))).alias("_c"), F.max("_all").alias("_all"), F.max("_k").alias("_k"), F.min(y).alias("_first"))
    u = (F.col(key) * 7919 + seed * 104729) % 1000 / 1000
    # one row of classes is broadcast
    d = rows.crossJoin(F.broadcast(packed)).withColumn("_u", u)
    by_share = F.element_at(F.filter("_c", lambda x: F.col("_u") * F.col("_all") < x["_to"]), 1)["c"]
    pick = lambda i: F.get("_c", i.cast("int"))["c"]
    guess = {"all_first": F.col("_first"), "uniform": pick(F.floor(F.col("_u") * F.col("_k"))), "by_share": by_share, "two_largest": pick(F.floor(F.col("_u") * F.least(F.col("_k"), F.lit(2)))), "half_and_quarters": pick(F.least(F.when(F.col("_u") < 0.5, 0).when(F.col("_u") < 0.75, 1).otherwise(2), F.col("_k") - 1))}
    one = d.agg(*[F.round(F.avg((g == F.col(y)).cast("double")), 6).alias(k) for k, g in guess.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("baseline"), F.col(k).alias("acc")) for k in guess])).alias("x")).select("x.*")


def nested_scores(df: DataFrame, estimators: list, label: str, outer: str, inner: int = 3, group: str = "g", refit=None) -> list[dict]:
    """One row an outer fold: the estimator that refit chooses by the inner folds, and its scores on the rows left out.

    df has features, label, the group and the outer fold (0, 1, ...). Inner folds keep groups together too. refit
    takes [(estimator number, mean metrics)] and gives a number; by default the estimator with the greatest mean r
    among those whose p-values' harmonic mean is under 0.1, else of all.
    """
    from quillspark.functions import special
    from quillspark.session import written

    def scores(p: DataFrame) -> dict:
        r = regression_metrics(p, label, "prediction").first().asDict()
        n, c = r["n"], r["r"]
        if c is None or n < 3 or not math.isfinite(c):
            return r | {"r": 0.0, "p": 1.0}
        t2 = c * c * (n - 2) / max(1e-12, 1 - c * c)
        return r | {"p": special.f_sf(t2, 1, n - 2)}

    def choose(tried):
        def harmonic(ps):
            return 0.0 if min(ps) == 0 else len(ps) / sum(1 / x for x in ps)

        good = [(np.mean([s["r"] for s in ss]), -i) for i, ss in tried if harmonic([s["p"] for s in ss]) < 0.1]
        best = max(good or [(np.mean([s["r"] for s in ss]), -i) for i, ss in tried])
        return -best[1]

    out = []
    for f in sorted(r[0] for r in df.select(outer).distinct().collect()):
        train, test = written(df.where(F.col(outer) != f)), df.where(F.col(outer) == f)
        folds = group_folds(train, group, inner).select(F.col(group).alias("_g"), F.col("fold").alias("_inner"))
        parts = written(train.join(folds, F.col(group) == F.col("_g")).drop("_g"))
        tried = [(i, [scores(e.fit(parts.where(F.col("_inner") != k)).transform(parts.where(F.col("_inner") == k))) for k in range(inner)]) for i, e in enumerate(estimators)]
        i = (refit or choose)(tried)
        model = estimators[i].fit(train)
        out.append({"fold": f, "model": i, "inner_r": float(np.mean([s["r"] for s in tried[i][1]])), **scores(model.transform(test)), "fitted": model})
    return out


def summed_importances(models: list, columns: list[str], least: float = 0.02, top: int = 30) -> list[tuple[str, float, bool]]:
    """(feature, importance summed over the models, over least), the top greatest and all that tie with the last."""
    total = np.sum([m.featureImportances.toArray() for m in models], axis=0)
    rows = sorted(zip(columns, total.tolist()), key=lambda x: (-x[1], x[0]))
    last = rows[min(top, len(rows)) - 1][1] if rows else 0.0
    return [(c, v, v > least) for c, v in rows if v >= last]
