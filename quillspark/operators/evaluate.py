"""Evaluation of clusterings of many runs at once, from contingency tables and group sums.

Rows are (run, item, cluster) with an attribute; runs are told apart by the column run, so all
are scored in the same aggregates. Null clusters and null attributes are left out; a run
without rows left has no score. Scores are rounded to 6 digits.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import special


def current_runs(runs: DataFrame) -> DataFrame:
    """(run, item, cluster): of repeated assignments of a text in a run the latest, then the greatest cluster."""
    rows = runs.where("cluster IS NOT NULL").groupBy(F.col("run_id").alias("run"), F.col("text_id").alias("item")).agg(F.max(F.struct("run_at", "cluster")).alias("m"))
    return rows.select("run", "item", F.col("m.cluster").alias("cluster"))


def contingency(rows: DataFrame, attr: str = "attr") -> DataFrame:
    """(run, cluster, attr, n)."""
    return rows.where(F.col("cluster").isNotNull() & F.col(attr).isNotNull()).groupBy("run", "cluster", F.col(attr).alias("attr")).agg(F.count("*").alias("n"))


def _pairs(n: Column) -> Column:
    return F.sum(n * (n - 1) / 2)


def _plogp(n: Column) -> Column:
    return F.sum(n * F.ln(n))


def external_scores(table: DataFrame) -> DataFrame:
    """(run, ari, fmi, mi, nmi, homogeneity, completeness, vmeasure, purity) of contingency()."""
    n = F.col("n").cast("double")
    cells = table.groupBy("run").agg(F.sum(n).alias("N"), _pairs(n).alias("pij"), _plogp(n).alias("lij"))
    a = table.groupBy("run", "cluster").agg(F.sum(n).alias("n"), F.max(n).alias("top")).groupBy("run").agg(_pairs(F.col("n")).alias("pa"), _plogp(F.col("n")).alias("la"), F.sum("top").alias("top"))
    b = table.groupBy("run", "attr").agg(F.sum(n).alias("n")).groupBy("run").agg(_pairs(F.col("n")).alias("pb"), _plogp(F.col("n")).alias("lb"))
    t = cells.join(a, "run").join(b, "run")
    e = F.expr("pa * pb / nullif(N * (N - 1) / 2, 0)")
    t = t.withColumns({"mi": F.expr("greatest((lij - la - lb) / N + ln(N), 0D)"), "ha": F.expr("ln(N) - la / N"), "hb": F.expr("ln(N) - lb / N"), "e": e})
    t = t.withColumns({"hom": F.expr("CASE WHEN hb < 1e-12 THEN 1D ELSE mi / hb END"), "com": F.expr("CASE WHEN ha < 1e-12 THEN 1D ELSE mi / ha END")})
    r = lambda c: F.round(F.expr(c), 6)
    return t.select(
        "run",
        r("CASE WHEN abs((pa + pb) / 2 - e) < 1e-12 THEN 1D ELSE (pij - e) / ((pa + pb) / 2 - e) END").alias("ari"),
        r("pij / nullif(sqrt(pa * pb), 0)").alias("fmi"),
        r("mi").alias("mi"),
        r("CASE WHEN ha + hb < 1e-12 THEN 1D ELSE 2 * mi / (ha + hb) END").alias("nmi"),
        r("hom").alias("homogeneity"),
        r("com").alias("completeness"),
        r("CASE WHEN hom + com < 1e-12 THEN 0D ELSE 2 * hom * com / (hom + com) END").alias("vmeasure"),
        r("top / N").alias("purity"),
    )


def _expected_mi(pdf: pd.DataFrame) -> pd.DataFrame:
    """Adjusted mutual information of one run: the expectation under random labels is summed over the margins."""
    t = pdf.pivot_table(index="cluster", columns="attr", values="n", aggfunc="sum", fill_value=0).to_numpy(dtype=float)
    a, b, n = t.sum(axis=1), t.sum(axis=0), t.sum()
    h = lambda p: -sum(x / n * math.log(x / n) for x in p if x > 0)
    ha, hb = h(a), h(b)
    mi = sum(t[i, j] / n * math.log(n * t[i, j] / (a[i] * b[j])) for i in range(len(a)) for j in range(len(b)) if t[i, j] > 0)
    lg = math.lgamma
    emi = 0.0
    pairs = {}
    for x in a:
        for y in b:
            pairs[(x, y)] = pairs.get((x, y), 0) + 1
    for (x, y), times in pairs.items():
        part = 0.0
        for k in range(int(max(1, x + y - n)), int(min(x, y)) + 1):
            p = lg(x + 1) + lg(y + 1) + lg(n - x + 1) + lg(n - y + 1) - lg(n + 1) - lg(k + 1) - lg(x - k + 1) - lg(y - k + 1) - lg(n - x - y + k + 1)
            part += k / n * math.log(n * k / (x * y)) * math.exp(p)
        emi += part * times
    bound = (ha + hb) / 2 - emi
    return pd.DataFrame({"run": [pdf["run"].iloc[0]], "ami": [round(1.0 if abs(bound) < 1e-12 else (mi - emi) / bound, 6)]})


def adjusted_mi(table: DataFrame) -> DataFrame:
    """(run, ami): one task a run over its contingency table, which is clusters times classes."""
    return table.groupBy("run").applyInPandas(_expected_mi, "run long, ami double")


def cluster_info(rows: DataFrame) -> DataFrame:
    """(run, nclust, clst_sizes): sizes in falling order, equal ones that follow each other as 2x100."""
    sizes = rows.groupBy("run", "cluster").agg(F.count("*").alias("n")).groupBy("run", "n").agg(F.count("*").alias("k"))
    part = F.when(F.col("k") > 1, F.concat_ws("x", F.col("k").cast("string"), F.col("n").cast("string"))).otherwise(F.col("n").cast("string"))
    return sizes.groupBy("run").agg(F.sum("k").alias("nclust"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", part.alias("p"))), asc=False), lambda s: s["p"]), ", ").alias("clst_sizes"))


def validity(rows: DataFrame) -> DataFrame:
    """(run, nclust, largest, valid): a clustering is valid with more than one cluster, not all of one text."""
    c = rows.groupBy("run", "cluster").agg(F.count("*").alias("n")).groupBy("run").agg(F.count("*").alias("nclust"), F.max("n").alias("largest"))
    return c.withColumn("valid", (F.col("nclust") > 1) & (F.col("largest") > 1))


def numeric_scores(rows: DataFrame, value: str = "value") -> DataFrame:
    """Scores of clusters on a number: (run, wcss, avg_variance, weighted_avg_variance, smallest_variance, anova_f, calinski_harabasz).

    Variances are of clusters of more than two; F is null for one cluster or as many clusters as items.
    """
    x = F.col(value)
    r = rows.where(x.isNotNull() & F.col("cluster").isNotNull())
    per = r.groupBy("run", "cluster").agg(F.count("*").alias("n"), F.avg(x).alias("m"), F.sum(x).alias("s"), F.var_samp(x).alias("v"), F.var_pop(x).alias("vp"))
    big = F.col("n") > 2
    t = per.groupBy("run").agg(
        F.count("*").alias("k"), F.sum("n").alias("N"), F.sum("s").alias("S"), F.sum(F.col("vp") * F.col("n")).alias("ssw"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"),
        F.avg(F.when(big, F.col("v"))).alias("av"), (F.sum(F.when(big, F.col("v") * F.col("n"))) / F.sum(F.when(big, F.col("n")))).alias("wv"), F.min(F.when(big, F.col("v"))).alias("mv"),
    )
    f = F.expr("((q - S * S / N) / nullif(k - 1, 0)) / nullif(ssw / nullif(N - k, 0), 0)")
    return t.select("run", F.round("ssw", 6).alias("wcss"), F.round("av", 6).alias("avg_variance"), F.round("wv", 6).alias("weighted_avg_variance"), F.round("mv", 6).alias("smallest_variance"), F.round(f, 4).alias("anova_f"), F.col("k").alias("groups"), F.col("N").alias("items"))


def anova_p(scores: DataFrame) -> DataFrame:
    """(run, anova_f, pval) by the F distribution; null where F is."""

    @F.pandas_udf("double")
    def p(f: pd.Series, k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else special.f_sf(x, a - 1, b - a) for x, a, b in zip(f, k, n)])

    return scores.select("run", "anova_f", p("anova_f", "groups", "items").alias("pval"))


def davies_bouldin(rows: DataFrame, value: str = "value") -> DataFrame:
    """(run, davies_bouldin) on one dimension; null for one cluster or equal means."""
    x = F.col(value)
    r = rows.where(x.isNotNull() & F.col("cluster").isNotNull())
    m = r.groupBy("run", "cluster").agg(F.avg(x).alias("m"))
    s = r.join(m, ["run", "cluster"]).groupBy("run", "cluster", "m").agg(F.avg(F.abs(x - F.col("m"))).alias("s"))
    # clusters of a run, not items, meet here
    o = s.select("run", F.col("cluster").alias("c2"), F.col("m").alias("m2"), F.col("s").alias("s2"))
    w = s.join(o, "run").where("cluster <> c2").groupBy("run", "cluster").agg(F.max((F.col("s") + F.col("s2")) / F.nullif(F.round(F.abs(F.col("m") - F.col("m2")), 9), F.lit(0.0))).alias("d"))
    return w.groupBy("run").agg(F.round(F.avg("d"), 4).alias("davies_bouldin"))


def kruskal(rows: DataFrame, value: str = "value") -> DataFrame:
    """(run, kruskal_h): H on average ranks, corrected for ties; null for one cluster or one value."""
    r = rows.where(F.col(value).isNotNull() & F.col("cluster").isNotNull())
    # ranks from the counts of the distinct values of a run, so no window holds the items
    vals = r.groupBy("run", value).agg(F.count("*").alias("t"))
    w = Window.partitionBy("run").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = vals.withColumn("rank", F.coalesce(F.sum("t").over(w), F.lit(0)) + (F.col("t") + 1) / 2)
    ties = vals.groupBy("run").agg(F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("tie"), F.sum("t").cast("double").alias("N"))
    per = r.join(ranked, ["run", value]).groupBy("run", "cluster").agg(F.sum("rank").alias("R"), F.count("*").alias("n"))
    q = per.groupBy("run").agg(F.sum(F.col("R") * F.col("R") / F.col("n")).alias("q"), F.count("*").alias("k")).join(ties, "run")
    h = F.expr("CASE WHEN k > 1 THEN (12 / (N * (N + 1)) * q - 3 * (N + 1)) / nullif(1 - tie / nullif(N * N * N - N, 0), 0) END")
    return q.select("run", F.round(h, 4).alias("kruskal_h"))


def ext_silhouette(rows: DataFrame, value: str = "value") -> DataFrame:
    """(run, ext_silhouette) of a number: mean distances from running sums over the sorted values, never pairs.

    For a value x and a cluster with values v: sum |x - v| = x (2 below - n) + total - 2 sum below. The sums
    below of every cluster of the run are one running map along the sorted distinct values.
    """

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        x, c = pdf["value"].to_numpy(dtype=float), pdf["cluster"].to_numpy()
        names = np.unique(c)
        if len(names) < 2:
            return pd.DataFrame({"run": [pdf["run"].iloc[0]], "ext_silhouette": [None]})
        a, b = np.zeros(len(x)), np.full(len(x), np.inf)
        for k in names:
            v = np.sort(x[c == k])
            cum = np.concatenate(([0.0], np.cumsum(v)))
            below = np.searchsorted(v, x, "right")
            total = x * (2 * below - len(v)) + cum[-1] - 2 * cum[below]
            own = c == k
            a[own] = total[own] / max(1, len(v) - 1)
            b[~own] = np.minimum(b[~own], total[~own] / len(v))
        size = pd.Series(c).map(pd.Series(c).value_counts()).to_numpy()
        top = np.maximum(a, b)
        s = np.where((size > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0)
        return pd.DataFrame({"run": [pdf["run"].iloc[0]], "ext_silhouette": [round(float(s.mean()), 6)]})

    r = rows.where(F.col(value).isNotNull() & F.col("cluster").isNotNull()).select("run", "cluster", F.col(value).alias("value"))
    return r.groupBy("run").applyInPandas(score, "run long, ext_silhouette double")


def regressed_clusters(table: DataFrame) -> DataFrame:
    """(run, acc, balanced_acc) of a balanced multinomial regression of an attribute's classes on the clusters, on the same rows.

    With a class as the only regressor the model is saturated, so its fit is known: each class predicts the cluster
    with the greatest share of its members, n(class, cluster) / n(cluster), the first of equals.
    """
    size = table.groupBy("run", "cluster").agg(F.sum("n").alias("_c"))
    cells = table.join(size, ["run", "cluster"])
    best = cells.groupBy("run", "attr").agg(F.min(F.struct((-F.round(F.col("n") / F.col("_c"), 12)).alias("s"), "cluster")).alias("b")).select("run", "attr", F.col("b.cluster").alias("cluster"))
    hit = cells.join(best, ["run", "attr", "cluster"]).groupBy("run", "cluster").agg(F.sum("n").alias("_h"))
    per = size.join(hit, ["run", "cluster"], "left").withColumn("_h", F.coalesce("_h", F.lit(0)))
    return per.groupBy("run").agg(F.round(F.sum("_h") / F.sum("_c"), 6).alias("acc"), F.round(F.avg(F.col("_h") / F.col("_c")), 6).alias("balanced_acc"))
