"""Queries of cluster evaluation and of the layer over evaluation results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.operators import evaluate as E
from quillspark.operators import experiments as Q
from quillspark.plans.registry import register
from quillspark.sources.tables import table

runs = lambda s, d: E.current_runs(table(s, d, "cluster_runs"))
RUNS = "rr AS (SELECT run_id AS run, text_id AS item, cluster FROM cluster_runs WHERE cluster IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id, text_id ORDER BY run_at DESC, cluster DESC) = 1)"
META = "md AS (SELECT DISTINCT text_id AS item, CASE WHEN gender = 'w' THEN 'f' ELSE gender END AS gender, lang, canon FROM metadata)"


def meta(s, d):
    return table(s, d, "metadata").select(F.col("text_id").alias("item"), F.expr("CASE WHEN gender = 'w' THEN 'f' ELSE gender END").alias("gender"), "lang", "canon").distinct()


def with_attr(s, d, attr, name="attr"):
    return runs(s, d).join(meta(s, d).select("item", F.col(attr).alias(name)), "item")


CONT = f"""{RUNS}, {META}, t AS (SELECT run, cluster, gender AS attr, count(*)::DOUBLE AS n FROM rr JOIN md USING (item) WHERE gender IS NOT NULL GROUP BY ALL),
c AS (SELECT run, sum(n) AS N, sum(n * (n - 1) / 2) AS pij, sum(n * ln(n)) AS lij FROM t GROUP BY run),
a AS (SELECT run, sum(n * (n - 1) / 2) AS pa, sum(n * ln(n)) AS la, sum(top) AS top FROM (SELECT run, cluster, sum(n) AS n, max(n) AS top FROM t GROUP BY run, cluster) GROUP BY run),
b AS (SELECT run, sum(n * (n - 1) / 2) AS pb, sum(n * ln(n)) AS lb FROM (SELECT run, attr, sum(n) AS n FROM t GROUP BY run, attr) GROUP BY run),
x AS (SELECT *, greatest((lij - la - lb) / N + ln(N), 0) AS mi, ln(N) - la / N AS ha, ln(N) - lb / N AS hb, pa * pb / nullif(N * (N - 1) / 2, 0) AS e FROM c JOIN a USING (run) JOIN b USING (run)),
y AS (SELECT *, CASE WHEN hb < 1e-12 THEN 1 ELSE mi / hb END AS hom, CASE WHEN ha < 1e-12 THEN 1 ELSE mi / ha END AS com FROM x)"""
EXT = {
    "ari": "CASE WHEN abs((pa + pb) / 2 - e) < 1e-12 THEN 1 ELSE (pij - e) / ((pa + pb) / 2 - e) END",
    "nmi": "CASE WHEN ha + hb < 1e-12 THEN 1 ELSE 2 * mi / (ha + hb) END",
    "fmi": "pij / nullif(sqrt(pa * pb), 0)",
    "purity": "top / N",
}
scores = lambda s, d: E.external_scores(E.contingency(with_attr(s, d, "gender")))
for k, v in EXT.items():
    register(k, lambda s, d, k=k: scores(s, d).select("run", k), f"WITH {CONT} SELECT run, round({v}, 6) AS {k} FROM y")
register("homogeneity_vmeasure", lambda s, d: scores(s, d).select("run", "homogeneity", "completeness", "vmeasure"), f"WITH {CONT} SELECT run, round(hom, 6) AS homogeneity, round(com, 6) AS completeness, round(CASE WHEN hom + com < 1e-12 THEN 0 ELSE 2 * hom * com / (hom + com) END, 6) AS vmeasure FROM y")
register("cluster_sizes_rle", lambda s, d: E.cluster_info(runs(s, d)), f"WITH {RUNS} SELECT run, sum(k)::BIGINT AS nclust, string_agg(CASE WHEN k > 1 THEN k || 'x' || n ELSE n::VARCHAR END, ', ' ORDER BY n DESC) AS clst_sizes FROM (SELECT run, n, count(*) AS k FROM (SELECT run, cluster, count(*) AS n FROM rr GROUP BY run, cluster) GROUP BY run, n) GROUP BY run")
register("cluster_validity", lambda s, d: E.validity(runs(s, d)), f"WITH {RUNS} SELECT run, count(*) AS nclust, max(n) AS largest, count(*) > 1 AND max(n) > 1 AS valid FROM (SELECT run, cluster, count(*) AS n FROM rr GROUP BY run, cluster) GROUP BY run")


def with_isolates(s, d):
    """All texts of the metadata in every run of the first matrix: those a run leaves out are one more cluster."""
    r = runs(s, d)
    info = r.groupBy("run").agg(F.max("cluster").alias("top"), F.count("*").alias("inside"))
    total = meta(s, d).agg(F.count("*").alias("n"))
    # one row is broadcast
    return info.crossJoin(F.broadcast(total)).select("run", (F.col("top") + 1).cast("long").alias("isolate_cluster"), (F.col("n") - F.col("inside")).alias("isolates"))


register("eval_with_isolates", with_isolates, f"WITH {RUNS}, {META} SELECT run, max(cluster) + 1 AS isolate_cluster, (SELECT count(*) FROM md) - count(*) AS isolates FROM rr GROUP BY run")
NUM = f"""{RUNS}, {META}, v AS (SELECT run, cluster, canon AS value FROM rr JOIN md USING (item) WHERE canon IS NOT NULL),
p AS (SELECT run, cluster, count(*) AS n, avg(value) AS m, sum(value) AS s, var_samp(value) AS v, var_pop(value) AS vp FROM v GROUP BY run, cluster),
q AS (SELECT run, count(*) AS k, sum(n) AS N, sum(s) AS S, sum(vp * n) AS ssw, sum(n * m * m) AS q, avg(v) FILTER (WHERE n > 2) AS av, sum(v * n) FILTER (WHERE n > 2) / sum(n) FILTER (WHERE n > 2) AS wv, min(v) FILTER (WHERE n > 2) AS mv FROM p GROUP BY run)"""
num = lambda s, d: with_attr(s, d, "canon", "value")
register("cluster_variance", lambda s, d: E.numeric_scores(num(s, d)).select("run", "avg_variance", "weighted_avg_variance", "smallest_variance"), f"WITH {NUM} SELECT run, round(av, 6) AS avg_variance, round(wv, 6) AS weighted_avg_variance, round(mv, 6) AS smallest_variance FROM q")
register("wcss", lambda s, d: E.numeric_scores(num(s, d)).select("run", "wcss"), f"WITH {NUM} SELECT run, round(ssw, 6) AS wcss FROM q")
FSQL = "round(((q - S * S / N) / nullif(k - 1, 0)) / nullif(ssw / nullif(N - k, 0), 0), 4)"
register("anova_f", lambda s, d: E.numeric_scores(num(s, d)).select("run", "anova_f"), f"WITH {NUM} SELECT run, {FSQL} AS anova_f FROM q")
register("calinski_harabasz", lambda s, d: E.numeric_scores(num(s, d)).select("run", F.col("anova_f").alias("calinski_harabasz")), f"WITH {NUM} SELECT run, {FSQL} AS calinski_harabasz FROM q")
#: The upper tail of F as an incomplete beta integral over an angle, by Simpson's rule.
TAIL = f"""{NUM}, f AS (SELECT run, {FSQL} AS anova_f, (k - 1)::DOUBLE AS d1, (N - k)::DOUBLE AS d2 FROM q),
w AS (SELECT run, anova_f, d1, d2, asin(sqrt(d2 / (d2 + d1 * anova_f))) AS top, lgamma(d2 / 2) + lgamma(d1 / 2) - lgamma((d1 + d2) / 2) AS lb FROM f WHERE anova_f IS NOT NULL),
si AS (SELECT run, sum((CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * CASE WHEN i = 0 AND d2 > 1 THEN 0 ELSE 2 * exp((d2 - 1) * CASE WHEN d2 = 1 THEN 0 ELSE ln(sin(top * i / 4000)) END + (d1 - 1) * CASE WHEN d1 = 1 THEN 0 ELSE ln(greatest(cos(top * i / 4000), 1e-300)) END - lb) END) * max(top) / 4000 / 3 AS p FROM w, range(0, 4001) r(i) GROUP BY run)"""
register("anova_p", lambda s, d: E.anova_p(E.numeric_scores(num(s, d))).select("run", "anova_f", F.round("pval", 6).alias("pval")), f"WITH {TAIL} SELECT f.run, f.anova_f, round(p, 6) AS pval FROM f LEFT JOIN si USING (run)")
register("logreg_attr_cluster", lambda s, d: E.regressed_clusters(E.contingency(with_attr(s, d, "gender"))), f"WITH {CONT}, sc AS (SELECT run, cluster, sum(n) AS c FROM t GROUP BY run, cluster), be AS (SELECT t.run, t.attr, t.cluster, t.n FROM t JOIN sc USING (run, cluster) QUALIFY row_number() OVER (PARTITION BY t.run, t.attr ORDER BY round(t.n / c, 12) DESC, t.cluster) = 1), hi AS (SELECT run, cluster, sum(n) AS h FROM be GROUP BY run, cluster) SELECT run, round(sum(coalesce(h, 0)) / sum(c), 6) AS acc, round(avg(coalesce(h, 0) / c), 6) AS balanced_acc FROM sc LEFT JOIN hi USING (run, cluster) GROUP BY run")
register("davies_bouldin", lambda s, d: E.davies_bouldin(num(s, d)), f"WITH {NUM}, sd AS (SELECT v.run, v.cluster, m, avg(abs(value - m)) AS s FROM v JOIN p USING (run, cluster) GROUP BY v.run, v.cluster, m) SELECT run, round(avg(d), 4) AS davies_bouldin FROM (SELECT a.run, a.cluster, max((a.s + b.s) / nullif(round(abs(a.m - b.m), 9), 0)) AS d FROM sd a JOIN sd b ON a.run = b.run AND a.cluster <> b.cluster GROUP BY a.run, a.cluster) GROUP BY run")
register("kruskal_h", lambda s, d: E.kruskal(num(s, d)), f"WITH {NUM}, vals AS (SELECT run, value, count(*) AS t FROM v GROUP BY run, value), rk AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY run ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2 AS rank FROM vals), ti AS (SELECT run, sum(t::DOUBLE * t * t - t) AS tie, sum(t)::DOUBLE AS N FROM vals GROUP BY run), rs AS (SELECT run, cluster, sum(rank) AS R, count(*) AS n FROM v JOIN rk USING (run, value) GROUP BY run, cluster), qq AS (SELECT run, sum(R * R / n) AS q, count(*) AS k FROM rs GROUP BY run) SELECT run, CASE WHEN k > 1 THEN round((12 / (N * (N + 1)) * q - 3 * (N + 1)) / nullif(1 - tie / nullif(N * N * N - N, 0), 0), 4) END AS kruskal_h FROM qq JOIN ti USING (run)")
register("ext_silhouette", lambda s, d: E.ext_silhouette(num(s, d)), f"WITH {NUM}, ii AS (SELECT row_number() OVER () AS i, run, cluster, value FROM v), dd AS (SELECT a.i, a.run, a.cluster AS ca, b.cluster AS cb, sum(abs(a.value - b.value)) AS sm, count(*) AS n FROM ii a JOIN ii b ON a.run = b.run GROUP BY a.i, a.run, a.cluster, b.cluster), ab AS (SELECT i, run, max(n) FILTER (WHERE ca = cb) AS n, max(sm / greatest(n - 1, 1)) FILTER (WHERE ca = cb) AS a, min(sm / n) FILTER (WHERE ca <> cb) AS b FROM dd GROUP BY i, run) SELECT run, CASE WHEN count(b) > 0 THEN round(avg(CASE WHEN n > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) END AS ext_silhouette FROM ab GROUP BY run")

# the layer over evaluation results
evals = lambda s, d: table(s, d, "eval_cat").distinct()
EV = "ev AS (SELECT DISTINCT * FROM eval_cat)"
COLS = "run_id, attr, ari, nclust, clst_sizes"
EXPAND = "flatten(list_transform(list_filter(list_transform(string_split(clst_sizes, ','), lambda p: trim(p, ' ')), lambda p: regexp_matches(p, '^([0-9]+x)?[0-9]+$')), lambda p: list_resize([]::BIGINT[], CASE WHEN contains(p, 'x') THEN split_part(p, 'x', 1)::INT ELSE 1 END, list_last(string_split(p, 'x'))::BIGINT)))"
SHARE = "list_max(z) <= round_even(0.6 * (list_sum(z) - len(list_filter(z, lambda x: x = 1))), 0)"
register("rle_expand", lambda s, d: evals(s, d).select("run_id", "attr", "evaluated_at", Q.sizes(F.col("clst_sizes")).alias("sizes")).select("run_id", "attr", "evaluated_at", F.array_join(F.transform("sizes", lambda x: x.cast("string")), " ").alias("sizes")), f"WITH {EV} SELECT run_id, attr, evaluated_at, array_to_string({EXPAND}, ' ') AS sizes FROM ev")
register("max_cluster_filter", lambda s, d: evals(s, d).where(Q.within_share(Q.sizes(F.col("clst_sizes")), 0.6)).select("run_id", "attr", "clst_sizes"), f"WITH {EV} SELECT run_id, attr, clst_sizes FROM (SELECT *, {EXPAND} AS z FROM ev) WHERE {SHARE}")
register("topeval_pipeline", lambda s, d: Q.run(evals(s, d), Q.Experiment(score="ari", max_share=0.6, nclust_min=2, nclust_max=500, ntop=20)).select(*COLS.split(", ")), f"WITH {EV}, z AS (SELECT *, {EXPAND} AS z FROM ev), k AS (SELECT * FROM z WHERE ari IS NOT NULL AND NOT coalesce(contains(file_info, 'mirror'), false) AND nclust BETWEEN 2 AND 500 AND {SHARE}) SELECT {COLS} FROM k QUALIFY rank() OVER (ORDER BY ari DESC) <= 20")
register("topn_with_ties", lambda s, d: Q.top_with_ties(evals(s, d), "nmi", 25).select("run_id", "attr", "nmi"), f"WITH {EV} SELECT run_id, attr, nmi FROM ev WHERE nmi IS NOT NULL QUALIFY rank() OVER (ORDER BY nmi DESC) <= 25")
register("dense_rank_eval", lambda s, d: evals(s, d).where("ari IS NOT NULL").select("run_id", "attr", "ari", F.dense_rank().over(Window.partitionBy("attr").orderBy(F.desc("ari"))).cast("long").alias("rank")), f"WITH {EV} SELECT run_id, attr, ari, dense_rank() OVER (PARTITION BY attr ORDER BY ari DESC) AS rank FROM ev WHERE ari IS NOT NULL")
register("substring_filter", lambda s, d: evals(s, d).where(F.col("mxname").rlike("delta|cosine") | F.col("clst_alg_params").contains("ward")).select("run_id", "attr", "mxname"), f"WITH {EV} SELECT run_id, attr, mxname FROM ev WHERE regexp_matches(mxname, 'delta|cosine') OR contains(clst_alg_params, 'ward')")
register("title_concat", lambda s, d: evals(s, d).select("run_id", "attr", F.concat_ws(", ", "mxname", "clst_alg_params", "attr").alias("title"), F.regexp_replace("file_info", "_[^_]*$", "").alias("no_attr")).distinct(), f"WITH {EV} SELECT DISTINCT run_id, attr, concat_ws(', ', mxname, clst_alg_params, attr) AS title, regexp_replace(file_info, '_[^_]*$', '') AS no_attr FROM ev")
register("dedupe_keep_first", lambda s, d: Q.keep_first(table(s, d, "eval_cat"), ["run_id", "attr"], F.asc_nulls_last("evaluated_at"), F.asc_nulls_last("ari"), F.asc_nulls_last("nmi"), F.asc_nulls_last("clst_sizes")).select("run_id", "attr", "evaluated_at", "ari"), "SELECT run_id, attr, evaluated_at, ari FROM eval_cat QUALIFY row_number() OVER (PARTITION BY run_id, attr ORDER BY evaluated_at ASC NULLS LAST, ari ASC NULLS LAST, nmi ASC NULLS LAST, clst_sizes ASC NULLS LAST) = 1")


def completeness(s, d):
    """Runs that were made, evaluated, both or neither."""
    made = table(s, d, "cluster_runs").select("run_id").distinct()
    done = table(s, d, "eval_cat").select("run_id").distinct()
    both = made.withColumn("made", F.lit(1)).join(done.withColumn("done", F.lit(1)), "run_id", "full")
    return both.agg(F.count("made").alias("n_made"), F.count("done").alias("n_evaluated"), F.count_if(F.col("made").isNotNull() & F.col("done").isNull()).alias("n_missing"), F.count_if(F.col("made").isNull()).alias("n_stray"))


register("completeness_check", completeness, "SELECT count(m) AS n_made, count(e) AS n_evaluated, count(*) FILTER (WHERE m IS NOT NULL AND e IS NULL) AS n_missing, count(*) FILTER (WHERE m IS NULL) AS n_stray FROM (SELECT DISTINCT run_id AS m FROM cluster_runs) FULL JOIN (SELECT DISTINCT run_id AS e FROM eval_cat) ON m = e")
register("combination_log", lambda s, d: E.validity(runs(s, d)).select("run", F.when(F.col("valid"), "success").when(F.col("nclust") <= 1, "single").otherwise("iso").alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n")), f"WITH {RUNS} SELECT outcome, count(*) AS n FROM (SELECT run, CASE WHEN count(*) > 1 AND max(n) > 1 THEN 'success' WHEN count(*) <= 1 THEN 'single' ELSE 'iso' END AS outcome FROM (SELECT run, cluster, count(*) AS n FROM rr GROUP BY run, cluster) GROUP BY run) GROUP BY outcome")
register("param_grid", lambda s, d: s.createDataFrame([(g["n"], g["linkage"], g["eps"]) for g in Q.grid(n=[5, 10, 20, 50], linkage=["single", "weighted", "centroid", "ward", "median", "average", "complete"], eps=[0.1, 0.3, 0.5])], "n long, linkage string, eps double").withColumn("key", F.concat(F.lit("nclst-"), "n", F.lit("_method-"), "linkage", F.lit("_eps-"), F.translate(F.col("eps").cast("string"), ".", "%"))), "SELECT n, linkage, eps, 'nclst-' || n || '_method-' || linkage || '_eps-' || translate(eps::VARCHAR, '.', '%') AS key FROM (SELECT unnest([5, 10, 20, 50]) AS n) CROSS JOIN (SELECT unnest(['single', 'weighted', 'centroid', 'ward', 'median', 'average', 'complete']) AS linkage) CROSS JOIN (SELECT unnest([0.1, 0.3, 0.5]::DOUBLE[]) AS eps)")


def selection(s, d):
    """Networks chosen by canon or by ari, without those on the list of failures."""
    e = evals(s, d)
    chosen = e.where("attr = 'canon' AND nmi > 0.1").select("mxname").unionByName(e.where("ari > 0.2").select("mxname")).distinct()
    bad = e.where("clst_sizes IS NULL").select("mxname").distinct()
    return chosen.join(bad, "mxname", "left_anti")


register("network_selection", selection, f"WITH {EV} SELECT DISTINCT mxname FROM ev WHERE ((attr = 'canon' AND nmi > 0.1) OR ari > 0.2) AND mxname NOT IN (SELECT mxname FROM ev WHERE clst_sizes IS NULL AND mxname IS NOT NULL)")
register("label_counts", lambda s, d: with_attr(s, d, "gender").groupBy("run", "cluster", "attr").agg(F.count("*").alias("n")).select("run", F.col("cluster").cast("long").alias("cluster"), F.col("attr").alias("gender"), "n"), f"WITH {RUNS}, {META} SELECT run, cluster, gender, count(*) AS n FROM rr JOIN md USING (item) GROUP BY ALL")


def edge_confusion(s, d):
    """Pairs of texts in one cluster against pairs of one gender, from group sizes: precision, recall and F1 of each run."""
    t = E.contingency(with_attr(s, d, "gender"))
    c2 = lambda x: x * (x - 1) / 2
    n = F.col("n").cast("double")
    tp = t.groupBy("run").agg(F.sum(c2(n)).alias("tp"))
    a = t.groupBy("run", "cluster").agg(F.sum(n).alias("n")).groupBy("run").agg(F.sum(c2(F.col("n"))).alias("pa"))
    b = t.groupBy("run", "attr").agg(F.sum(n).alias("n")).groupBy("run").agg(F.sum(c2(F.col("n"))).alias("pb"))
    r = lambda x: F.round(F.expr(x), 6)
    return tp.join(a, "run").join(b, "run").select("run", r("tp / nullif(pa, 0)").alias("precision"), r("tp / nullif(pb, 0)").alias("recall"), r("2 * tp / nullif(pa + pb, 0)").alias("f1"))


register("edge_confusion", edge_confusion, f"WITH {CONT} SELECT run, round(pij / nullif(pa, 0), 6) AS precision, round(pij / nullif(pb, 0), 6) AS recall, round(2 * pij / nullif(pa + pb, 0), 6) AS f1 FROM y")
