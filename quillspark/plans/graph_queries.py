"""Queries of distances, sparsified networks, graph measures and graph clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import distance as D
from quillspark.operators import graph as G
from quillspark.operators import ngrams as N
from quillspark.operators.components import components
from quillspark.plans.ngram_queries import G1
from quillspark.plans.registry import register
from quillspark.session import written
from quillspark.sources.tables import spread, table

docs = lambda s, d: spread(table(s, d, "documents"))
WIDTH = 100

# distances: the documents whose id is divisible by 100 against all documents
V = f"""{G1}, n AS (SELECT doc_id, sum(cnt)::DOUBLE AS n FROM g GROUP BY doc_id),
m AS (SELECT ngram, row_number() OVER (ORDER BY round(sum(cnt / n), 9) DESC, ngram) AS rank FROM g JOIN n USING (doc_id) GROUP BY ngram QUALIFY rank <= {WIDTH}),
v AS (SELECT doc_id, rank, coalesce(cnt, 0) / n AS x FROM n CROSS JOIN m LEFT JOIN g USING (doc_id, ngram)),
mid AS (SELECT rank, median(x) AS med, avg(x) AS mu, stddev_samp(x) AS ss, stddev_pop(x) AS sp FROM v GROUP BY rank),
st AS (SELECT rank, any_value(mu) AS mu, any_value(ss) AS ss, any_value(sp) AS sp, sum(abs(x - med)) / {WIDTH} AS b FROM v JOIN mid USING (rank) GROUP BY rank),
z AS (SELECT doc_id, rank, x, mu, ss, sp, b FROM v JOIN st USING (rank))"""
SUMS = {
    "burrows": f"sum(abs(a.x - b.x) / a.ss) / {WIDTH}",
    "burrows_argamon": "avg(abs(a.x - b.x) / a.ss)",
    "eder": f"sum(abs(a.x - b.x) / a.sp * ({WIDTH} - a.rank + 1) / {WIDTH}.0)",
    "edersimple": "sum(abs(sqrt(a.x) - sqrt(b.x)))",
    "quadratic": f"sqrt(sum(((a.x - b.x) / a.sp) * ((a.x - b.x) / a.sp))) / {WIDTH}",
    "quadratic_argamon": f"sqrt(sum(((a.x - b.x) / a.ss) * ((a.x - b.x) / a.ss))) / {WIDTH}",
    "linear": "sum(abs(a.x - b.x) / a.b)",
    "cosinedelta": "1 - sum(((a.x - a.mu) / a.sp) * ((b.x - a.mu) / a.sp)) / nullif(sqrt(sum(((a.x - a.mu) / a.sp) * ((a.x - a.mu) / a.sp))) * sqrt(sum(((b.x - a.mu) / a.sp) * ((b.x - a.mu) / a.sp))), 0)",
    "cosinesim": "coalesce(sum(a.x * b.x) / nullif(sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x)), 0), 0)",
    "ruzicka": "1 - coalesce(sum(least(a.x, b.x)) / nullif(sum(greatest(a.x, b.x)), 0), 0)",
    "canberra": "sum(coalesce(abs(a.x - b.x) / nullif(a.x + b.x, 0), 0))",
    "braycurtis": "coalesce(sum(abs(a.x - b.x)) / nullif(sum(a.x + b.x), 0), 0)",
    "chebyshev": "max(abs(a.x - b.x))",
    "sqeuclidean": "sum((a.x - b.x) * (a.x - b.x))",
    "correlation": f"1 - coalesce((sum(a.x * b.x) - sum(a.x) * sum(b.x) / {WIDTH}) / nullif(sqrt(sum(a.x * a.x) - sum(a.x) * sum(a.x) / {WIDTH}) * sqrt(sum(b.x * b.x) - sum(b.x) * sum(b.x) / {WIDTH}), 0), 0)",
    "manhattan": "sum(abs(a.x - b.x))",
}
NAMES = {"burrows": "delta_burrows", "burrows_argamon": "delta_burrows_argamon", "eder": "delta_eder", "edersimple": "delta_edersimple", "quadratic": "delta_quadratic", "quadratic_argamon": "delta_quadratic_argamon", "linear": "delta_linear", "cosinedelta": "delta_cosine", "cosinesim": "cosine_sim", "ruzicka": "dist_ruzicka", "canberra": "dist_canberra", "braycurtis": "dist_braycurtis", "chebyshev": "dist_chebyshev", "sqeuclidean": "dist_sqeuclidean", "correlation": "dist_correlation", "manhattan": "dist_manhattan"}


def metric_query(metric: str):
    def run(s, d):
        vec = written(N.vectors(written(N.counts(docs(s, d))), WIDTH)[0])
        return D.nearest(vec, vec.where("doc_id % 100 = 0"), metric).select("doc_id", "other", F.col("rank").cast("long").alias("rank"), "value")

    return run


for metric, name in NAMES.items():
    order = "value DESC" if metric in D.SIMILARITIES else "value"
    register(name, metric_query(metric), f"WITH {V}, p AS (SELECT a.doc_id, b.doc_id AS other, round({SUMS[metric]}, 6) + 0.0 AS value FROM z a JOIN z b USING (rank) WHERE a.doc_id % 100 = 0 AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id) SELECT doc_id, other, row_number() OVER (PARTITION BY doc_id ORDER BY {order}, other) AS rank, value FROM p QUALIFY rank <= 10")


def delta_nearest(s, d):
    """Flagship: the nearest document by Burrows' Delta of every hundredth document."""
    return metric_query("burrows")(s, d).where("rank = 1").select("doc_id", "other", "value")


register("delta_nearest", delta_nearest, f"WITH {V}, p AS (SELECT a.doc_id, b.doc_id AS other, round({SUMS['burrows']}, 6) AS value FROM z a JOIN z b USING (rank) WHERE a.doc_id % 100 = 0 AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id) SELECT doc_id, other, value FROM p QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY value, other) = 1")


def embedding_search(s, d):
    v = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return D.nearest(v, v.where("vec_id % 100 = 0"), "cosinesim", key="vec_id").select("vec_id", "other", F.col("rank").cast("long").alias("rank"), "value")


register("embedding_cosine_pairs", embedding_search, "SELECT vec_id, other, row_number() OVER (PARTITION BY vec_id ORDER BY value DESC, other) AS rank, value FROM (SELECT a.vec_id, b.vec_id AS other, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS value FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) QUALIFY rank <= 10")

# networks of texts merged by source and language
NET = r"""g AS (SELECT source || '/' || coalesce(lang, '-') AS node, word, count(*) AS c FROM (SELECT source, lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM documents WHERE source IS NOT NULL) GROUP BY ALL),
nt AS (SELECT node, sum(c)::DOUBLE AS t FROM g GROUP BY node), top AS (SELECT word FROM g JOIN nt USING (node) GROUP BY word ORDER BY round(sum(c / t), 9) DESC, word LIMIT 100), n AS (SELECT node, sum(c)::DOUBLE AS n FROM g GROUP BY node HAVING count(*) FILTER (WHERE word IN (SELECT word FROM top)) > 0),
x AS (SELECT node, word, coalesce(c, 0) / n AS x FROM n CROSS JOIN top LEFT JOIN g USING (node, word)),
e AS (SELECT a.node AS src, b.node AS dst, round(sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))), 6) AS w FROM x a JOIN x b USING (word) WHERE a.node <> b.node GROUP BY a.node, b.node)"""
CUT = f"{NET}, cut AS (SELECT quantile_cont(w, 0.9) AS q FROM e WHERE src < dst), t AS (SELECT e.* FROM e, cut WHERE w >= q)"
TOP = f"{NET}, tk AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY src ORDER BY w DESC) AS r FROM e) WHERE r <= 10)"
SIM = f"""{TOP}, nb AS (SELECT src, list_sort(list(dst)) AS n FROM tk GROUP BY src), so AS (SELECT tk.src, tk.dst, tk.w, CASE WHEN a.n = b.n THEN 0 ELSE len(list_intersect(a.n, b.n)) + CASE WHEN list_contains(b.n, tk.src) THEN 1 ELSE 0 END END AS overlap FROM tk JOIN nb a ON a.src = tk.src JOIN nb b ON b.src = tk.dst)"""
net = lambda s, d: G.network(docs(s, d))
cut = lambda s, d: written(G.threshold(net(s, d), 0.9))
register("simmx_minmax", lambda s, d: D.minmax_invert(net(s, d)), f"WITH {NET}, b AS (SELECT least(min(w), 1) AS lo, greatest(max(w), 1) AS hi FROM e) SELECT src, dst, round((w - lo) / nullif(hi - lo, 0), 6) AS w, round(1 - (w - lo) / nullif(hi - lo, 0), 6) AS dist FROM e, b")
register("triangle_count", lambda s, d: net(s, d).where("src < dst").agg(F.count("*").alias("n_cells")), f"WITH {NET} SELECT count(*) AS n_cells FROM e WHERE src < dst")
register("zero_cells", lambda s, d: net(s, d).where("w = 0").select("src", "dst"), f"WITH {NET} SELECT src, dst FROM e WHERE w = 0")
register("sim_histogram", lambda s, d: net(s, d).where("src < dst").groupBy(F.floor(F.col("w") * 20).cast("long").alias("bin")).agg(F.count("*").alias("n")), f"WITH {NET} SELECT floor(w * 20)::BIGINT AS bin, count(*) AS n FROM e WHERE src < dst GROUP BY bin")
register("sparsify_threshold", cut, f"WITH {CUT} SELECT src, dst, w FROM t")
register("sparsify_authormin", lambda s, d: G.author_bound(net(s, d), False), f"WITH {NET}, o AS (SELECT split_part(src, '/', 1) AS a, min(w) AS m FROM e WHERE split_part(src, '/', 1) = split_part(dst, '/', 1) GROUP BY 1) SELECT src, dst, w FROM e JOIN o ON split_part(src, '/', 1) = a WHERE w >= m")
register("sparsify_authormax", lambda s, d: G.author_bound(net(s, d), True), f"WITH {NET}, o AS (SELECT split_part(src, '/', 1) AS a, max(w) AS m FROM e WHERE split_part(src, '/', 1) = split_part(dst, '/', 1) AND w <> 1 GROUP BY 1) SELECT src, dst, w FROM e JOIN o ON split_part(src, '/', 1) = a WHERE w >= m")
register("topk_neighbours", lambda s, d: G.top_neighbours(net(s, d), 10), f"WITH {TOP} SELECT src, dst, w FROM tk")
register("simmelian_overlap", lambda s, d: G.simmelian(net(s, d), 10), f"WITH {SIM} SELECT src, dst, w, overlap FROM so")
register("sparsify_simmel", lambda s, d: G.backbone(net(s, d), 10, 5), f"WITH {SIM} SELECT src, dst, w FROM so WHERE overlap >= 5")


def edge_counts(s, d):
    e = net(s, d)
    tables = {"full": e, "threshold": G.threshold(e, 0.9), "authormin": G.author_bound(e, False), "simmel": G.backbone(e, 10, 5)}
    out = None
    for k, t in tables.items():
        row = t.agg(F.count("*").alias("n_edges")).select(F.lit(k).alias("mode"), "n_edges")
        out = row if out is None else out.unionByName(row)
    return out


register("edge_counts", edge_counts, f"WITH {SIM}, cut AS (SELECT quantile_cont(w, 0.9) AS q FROM e WHERE src < dst), o AS (SELECT split_part(src, '/', 1) AS a, min(w) AS m FROM e WHERE split_part(src, '/', 1) = split_part(dst, '/', 1) GROUP BY 1) SELECT 'full' AS mode, count(*) AS n_edges FROM e UNION ALL SELECT 'threshold', count(*) FROM e, cut WHERE w >= q UNION ALL SELECT 'authormin', count(*) FROM e JOIN o ON split_part(src, '/', 1) = a WHERE w >= m UNION ALL SELECT 'simmel', count(*) FROM so WHERE overlap >= 5")
register("degree_distribution", lambda s, d: G.degrees(cut(s, d)), f"WITH {CUT} SELECT src AS node, count(*) AS degree, round(sum(w), 6) AS strength FROM t GROUP BY src")
register("is_symmetric", lambda s, d: G.asymmetric(G.backbone(net(s, d), 10, 5)), f"WITH {SIM}, b AS (SELECT * FROM so WHERE overlap >= 5) SELECT count(*) AS n FROM b WHERE NOT EXISTS (SELECT 1 FROM b c WHERE c.src = b.dst AND c.dst = b.src AND c.w = b.w)")


def every(s, d):
    return G.nodes_of(net(s, d))


register("graph_overview", lambda s, d: G.overview(cut(s, d), every(s, d)), f"WITH {CUT} SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM t) AS n_edges, (SELECT min(w) FROM t) AS least, (SELECT max(w) FROM t) AS most, (SELECT count(*) FROM n WHERE node NOT IN (SELECT src FROM t)) AS n_isolated")
register("isolated_nodes", lambda s, d: every(s, d).join(G.nodes_of(cut(s, d)), "node", "left_anti"), f"WITH {CUT} SELECT node FROM n WHERE node NOT IN (SELECT src FROM t)")
REACH = CUT.replace("g AS (", "RECURSIVE g AS (", 1) + ", r AS (SELECT DISTINCT src AS node, src AS hit FROM t UNION SELECT r.node, t.dst FROM r JOIN t ON t.src = r.hit), cc AS (SELECT node, min(hit) AS component FROM r GROUP BY node)"
cc = lambda s, d: components(cut(s, d), "src", "dst")
register("connected_components", cc, f"WITH {REACH} SELECT node, component FROM cc")
register("component_sizes", lambda s, d: cc(s, d).groupBy("component").agg(F.count("*").alias("size")), f"WITH {REACH} SELECT component, count(*) AS size FROM cc GROUP BY component")
HOPS = CUT.replace("g AS (", "RECURSIVE g AS (", 1) + ", r AS (SELECT DISTINCT src AS start, src AS node, 0 AS hops FROM t UNION SELECT r.start, t.dst, r.hops + 1 FROM r JOIN t ON t.src = r.node WHERE r.hops < 12), h AS (SELECT start, node, min(hops) AS hops FROM r GROUP BY start, node)"


def first_hops(s, d):
    e = cut(s, d)
    return G.bfs(e, G.nodes_of(e).agg(F.min("node").alias("node"))).select("start", "node", F.col("hops").cast("long").alias("hops"))


register("bfs_hops", first_hops, f"WITH {HOPS} SELECT start, node, hops FROM h WHERE start = (SELECT min(src) FROM t)")


def diameter(s, d):
    e = cut(s, d)
    return G.bfs(e, G.nodes_of(e)).where("hops > 0").agg(F.max("hops").cast("long").alias("diameter"), F.round(F.avg("hops"), 6).alias("mean_path"))


register("diameter", diameter, f"WITH {HOPS} SELECT max(hops) AS diameter, round(avg(hops), 6) AS mean_path FROM h WHERE hops > 0")
register("subgraph", lambda s, d: cut(s, d).where(F.col("src").rlike("/(en|de)$") & F.col("dst").rlike("/(en|de)$")), f"WITH {CUT} SELECT src, dst, w FROM t WHERE regexp_matches(src, '/(en|de)$') AND regexp_matches(dst, '/(en|de)$')")


def mean_chars(s, d):
    return docs(s, d).where("source IS NOT NULL").groupBy(F.concat_ws("/", "source", F.coalesce("lang", F.lit("-"))).alias("node")).agg(F.round(F.avg("n_chars"), 3).alias("value"))


ATTR = "a AS (SELECT source || '/' || coalesce(lang, '-') AS node, round(avg(n_chars), 3) AS value FROM documents WHERE source IS NOT NULL GROUP BY 1)"
register("assort_numeric", lambda s, d: G.assortativity_numeric(cut(s, d), mean_chars(s, d)), f"WITH {CUT}, {ATTR} SELECT CASE WHEN stddev_pop(a.value) = 0 THEN 1.0 ELSE round(corr(a.value, b.value), 6) END AS r FROM t JOIN a ON a.node = src JOIN a b ON b.node = dst")
register("assort_categorical", lambda s, d: G.assortativity_categorical(cut(s, d), every(s, d).withColumn("value", F.substring_index("node", "/", -1))), f"WITH {CUT}, m AS (SELECT split_part(src, '/', 2) AS x, split_part(dst, '/', 2) AS y, count(*) / sum(count(*)) OVER () AS e FROM t GROUP BY 1, 2), ab AS (SELECT sum(a * b) AS ab FROM (SELECT x, sum(e) AS a FROM m GROUP BY x) JOIN (SELECT y AS x, sum(e) AS b FROM m GROUP BY y) USING (x)) SELECT round(((SELECT coalesce(sum(e), 0) FROM m WHERE x = y) - ab) / nullif(1 - ab, 0), 6) AS r FROM ab")
register("visible_edges", lambda s, d: cut(s, d).agg(F.count_distinct(F.least("src", "dst"), F.greatest("src", "dst")).alias("n")).crossJoin(F.broadcast(every(s, d).agg(F.count("*").alias("nodes")))).select("n", F.round(F.col("n") / (F.col("nodes") * F.col("nodes")), 6).alias("ratio")), f"WITH {CUT}, c AS (SELECT count(DISTINCT (least(src, dst), greatest(src, dst))) AS n FROM t) SELECT n, round(n / ((SELECT count(*) FROM n) * (SELECT count(*) FROM n)), 6) AS ratio FROM c")


def edgelist(s, d):
    from quillspark.operators.numbering import numbered

    e = cut(s, d)
    ids = written(numbered(G.nodes_of(e), "id", "node", start=1))
    return e.join(ids.select(F.col("node").alias("src"), F.col("id").alias("u")), "src").join(ids.select(F.col("node").alias("dst"), F.col("id").alias("v")), "dst").select("u", "v", "w")


register("edgelist_export", edgelist, f"WITH {CUT}, i AS (SELECT src AS node, row_number() OVER (ORDER BY src) AS id FROM (SELECT DISTINCT src FROM t)) SELECT a.id AS u, b.id AS v, w FROM t JOIN i a ON a.node = src JOIN i b ON b.node = dst")


def mirror(s, d):
    e = cut(s, d)
    twin = e.select(F.concat("src", F.lit("000")).alias("src"), F.concat("dst", F.lit("000")).alias("dst"), "w")
    first = e.agg(F.min("src").alias("m"))
    bridge = first.select(F.col("m").alias("src"), F.concat("m", F.lit("000")).alias("dst"), F.lit(1.0).alias("w"))
    return e.unionByName(twin).unionByName(bridge)


register("mirror_graph", mirror, f"WITH {CUT} SELECT src, dst, w FROM t UNION ALL SELECT src || '000', dst || '000', w FROM t UNION ALL SELECT min(src), min(src) || '000', 1.0 FROM t")


def mirror_rank(s, d):
    """Rank of each node's counterpart, the same source in the other language, among its neighbours."""
    from pyspark.sql import Window

    e = net(s, d).withColumn("r", F.rank().over(Window.partitionBy("src").orderBy(F.desc("w"))))
    twin = F.concat(F.substring_index("src", "/", 1), F.when(F.col("src").endswith("/en"), "/de").when(F.col("src").endswith("/de"), "/en"))
    return e.where(F.col("dst") == twin).select(F.col("src").alias("node"), F.col("r").cast("long").alias("mirror_rank"), F.expr("CASE WHEN w < 0.8 THEN 0.8 WHEN w < 0.9 THEN 0.9 WHEN w < 0.95 THEN 0.95 WHEN w < 0.99 THEN 0.99 ELSE 1.0 END").cast("double").alias("below"))


register("mirror_rank", mirror_rank, f"WITH {NET} SELECT src AS node, r AS mirror_rank, (CASE WHEN w < 0.8 THEN 0.8 WHEN w < 0.9 THEN 0.9 WHEN w < 0.95 THEN 0.95 WHEN w < 0.99 THEN 0.99 ELSE 1.0 END)::DOUBLE AS below FROM (SELECT *, rank() OVER (PARTITION BY src ORDER BY w DESC) AS r FROM e) WHERE dst = split_part(src, '/', 1) || CASE split_part(src, '/', 2) WHEN 'en' THEN '/de' WHEN 'de' THEN '/en' END")
register("lpa", lambda s, d: G.label_propagation(cut(s, d)), f"WITH {CUT}, l0 AS (SELECT DISTINCT src AS node, src AS label FROM t)" + "".join(f", l{i} AS (SELECT src AS node, label FROM (SELECT t.src, label, row_number() OVER (PARTITION BY t.src ORDER BY count(*) DESC, label) AS r FROM t JOIN l{i - 1} p ON p.node = t.dst GROUP BY t.src, label) WHERE r = 1)" for i in range(1, 6)) + " SELECT node, label FROM l5")
LPA = f"{CUT}, l0 AS (SELECT DISTINCT src AS node, src AS label FROM t)" + "".join(f", l{i} AS (SELECT src AS node, label FROM (SELECT t.src, label, row_number() OVER (PARTITION BY t.src ORDER BY count(*) DESC, label) AS r FROM t JOIN l{i - 1} p ON p.node = t.dst GROUP BY t.src, label) WHERE r = 1)" for i in range(1, 6))
register("cluster_relabel", lambda s, d: G.relabel(G.label_propagation(cut(s, d))), f"WITH {LPA}, z AS (SELECT label, count(*) AS n, min(node) AS f FROM l5 GROUP BY label), k AS (SELECT label, row_number() OVER (ORDER BY n DESC, f) - 1 AS cluster FROM z) SELECT node, cluster FROM l5 JOIN k USING (label)")


def lang_labels(s, d):
    return every(s, d).withColumn("label", F.substring_index("node", "/", -1))


register("modularity", lambda s, d: G.modularity(cut(s, d), lang_labels(s, d)), f"WITH {CUT}, m AS (SELECT sum(w) AS m2 FROM t), c AS (SELECT split_part(src, '/', 2) AS c, sum(CASE WHEN split_part(src, '/', 2) = split_part(dst, '/', 2) THEN w ELSE 0 END) AS i, sum(w) AS d FROM t GROUP BY 1) SELECT round(sum(i / m2 - (d / m2) * (d / m2)), 6) AS modularity FROM c, m")
register("silhouette", lambda s, d: G.silhouette(net(s, d), lang_labels(s, d)), f"WITH {NET}, mm AS (SELECT src, split_part(src, '/', 2) AS ca, split_part(dst, '/', 2) AS cb, avg(1 - w) AS m FROM e GROUP BY ALL), ab AS (SELECT src, min(m) FILTER (WHERE ca = cb) AS a, min(m) FILTER (WHERE ca <> cb) AS b FROM mm GROUP BY src) SELECT round(avg(coalesce(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / nullif(greatest(a, b), 0) END, 0)), 6) AS silhouette FROM ab")
DB = CUT.replace("g AS (", "RECURSIVE g AS (", 1) + ", nr AS (SELECT * FROM e WHERE 1 - w <= 0.05), co AS (SELECT node FROM n LEFT JOIN nr ON src = node GROUP BY node HAVING count(dst) + 1 >= 5), ce AS (SELECT src, dst FROM nr WHERE src IN (SELECT node FROM co) AND dst IN (SELECT node FROM co)), rr AS (SELECT node, node AS hit FROM co UNION SELECT rr.node, ce.dst FROM rr JOIN ce ON ce.src = rr.hit), lb AS (SELECT node, min(hit) AS label FROM rr GROUP BY node)"
db = lambda s, d: G.dbscan(net(s, d), every(s, d), 0.05, 5)
register("dbscan_core", lambda s, d: db(s, d).where("core").select("node"), f"WITH {DB} SELECT node FROM co")
register("dbscan_labels", lambda s, d: db(s, d).select("node", "label"), f"WITH {DB}, bd AS (SELECT src AS node, min(label) AS label FROM nr JOIN lb ON lb.node = nr.dst GROUP BY src) SELECT n.node, coalesce(lb.label, bd.label) AS label FROM n LEFT JOIN lb USING (node) LEFT JOIN bd ON bd.node = n.node")
register("hclust_single", lambda s, d: components(written(net(s, d).where("w >= 0.97")).unionByName(every(s, d).select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("w"))), "src", "dst"), "WITH " + NET.replace("g AS (", "RECURSIVE g AS (", 1) + ", h AS (SELECT src, dst FROM e WHERE w >= 0.97), rr AS (SELECT node, node AS hit FROM n UNION SELECT rr.node, h.dst FROM rr JOIN h ON h.src = rr.hit) SELECT node, min(hit) AS component FROM rr GROUP BY node")
register("authorship_attribution", lambda s, d: G.authorship(net(s, d)), f"WITH {NET}, r AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r, split_part(src, '/', 1) = split_part(dst, '/', 1) AS own FROM e), o AS (SELECT src, count(*) AS others FROM r WHERE own GROUP BY src) SELECT src AS node, others, round(count(*) FILTER (WHERE own AND r <= others) / others, 6) AS share, min(r) FILTER (WHERE own) AS first_hit, min(r) FILTER (WHERE own) = 1 AS hit FROM r JOIN o USING (src) GROUP BY src, others")


def stats_rollup(s, d):
    """Most, fewest and mean edges over the thresholds of a sparsifier."""
    e = net(s, d)
    rows = None
    for q in (0.8, 0.9, 0.95):
        one = G.threshold(e, q).agg(F.count("*").alias("n"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.agg(F.max("n").alias("most"), F.min("n").alias("fewest"), F.round(F.avg("n"), 6).alias("mean"))


register("network_stats_rollup", stats_rollup, f"WITH {NET}, q AS (SELECT unnest([0.8, 0.9, 0.95]) AS p), c AS (SELECT p, CASE p WHEN 0.8 THEN (SELECT quantile_cont(w, 0.8) FROM e WHERE src < dst) WHEN 0.9 THEN (SELECT quantile_cont(w, 0.9) FROM e WHERE src < dst) ELSE (SELECT quantile_cont(w, 0.95) FROM e WHERE src < dst) END AS cut FROM q), k AS (SELECT p, count(*) AS n FROM e JOIN c ON w >= cut GROUP BY p) SELECT max(n) AS most, min(n) AS fewest, round(avg(n), 6) AS mean FROM k")
