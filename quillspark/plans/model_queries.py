"""Queries of kernels and models, and of streams: what SQL can't state is checked by rows and invariants in the tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quillspark.operators import embed, kernels, neardup, segment
from quillspark.operators import graph as G
from quillspark.plans.graph_queries import LPA, NET, REACH, cut, net
from quillspark.plans.meta_queries import fa, md, xy
from quillspark.plans.ngram_queries import BALANCED, FCOLS
from quillspark.plans.registry import register
from quillspark.plans.text_queries import SENTS
from quillspark.session import shared_dir, written
from quillspark.sources.tables import spread, table
from quillspark.streaming import wordcount

docs = lambda s, d: spread(table(s, d, "documents"))
DENSITY = [("dbscan", "0.05-5"), ("dbscan", "0.02-3"), ("lpa", "0.9"), ("lpa", "0.95")]
GRID = DENSITY + [("hierarchical", f"{n}-{m}") for n in (5, 10) for m in kernels.LINKAGES] + [("spectral", "5"), ("spectral", "10"), ("medoids", "5"), ("medoids", "10")] + [("louvain", str(r)) for r in (0.1, 1.0, 10.0)]


def cluster_grid(s, d):
    e = net(s, d)
    both = e.withColumn("mxname", F.lit("cosine")).unionByName(e.select("src", "dst", F.col("w") * F.col("w")).toDF("src", "dst", "w").withColumn("mxname", F.lit("cosine2")))
    return kernels.cluster_grid(both, GRID, seconds=10)


register("cluster_grid", cluster_grid)


def resumed_grid(s, d):
    """The grid over one matrix in two goes, the second without the runs of the first: rows of each algorithm, and runs made twice."""
    e = written(net(s, d).withColumn("mxname", F.lit("cosine")))
    first = written(kernels.cluster_grid(e, GRID[::2]))
    rest = written(kernels.cluster_grid(e, GRID, done=first))
    both = first.unionByName(rest)
    twice = first.select("alg", "param").distinct().join(rest.select("alg", "param").distinct(), ["alg", "param"], "left_semi").agg(F.count("*").alias("n_twice"))
    # one row is broadcast
    return both.groupBy("alg").agg(F.count("*").alias("n"), F.count_distinct("param").alias("settings")).crossJoin(F.broadcast(twice))


register("grid_resume", resumed_grid, f"WITH {NET}, a AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {sum(x == a for x, _ in GRID)})" for a in sorted({x for x, _ in GRID})) + ") v(alg, k)) SELECT alg, k * (SELECT count(*) FROM n) AS n, k::BIGINT AS settings, 0::BIGINT AS n_twice FROM a")


def medoid(s, d):
    """The medoid of the network: with one cluster the swaps change nothing, so it has the least sum of distances."""
    return net(s, d).groupBy(F.lit(1).alias("k")).applyInPandas(_medoid, "node string, cost double")


def _medoid(p):
    names, sim = kernels.dense(p)
    dist = 1 - sim
    np.fill_diagonal(dist, 0)
    _, chosen, cost = kernels.medoids(dist, 1)
    return pd.DataFrame({"node": [names[chosen[0]]], "cost": [round(cost, 4)]})


register("medoid_cost", medoid, f"WITH {NET} SELECT src AS node, round(sum(1 - w), 4) AS cost FROM e GROUP BY src ORDER BY sum(1 - w), src LIMIT 1")


def louvain_gain(s, d):
    """Is the modularity of the communities found at least that of the components of the graph, which are communities too."""
    from quillspark.operators.components import components

    e = cut(s, d)
    lab = e.groupBy(F.lit(1).alias("k")).applyInPandas(_communities, "node string, label int")
    own = G.modularity(e, written(lab)).select(F.col("modularity").alias("found"))
    base = G.modularity(e, components(e, "src", "dst").withColumnRenamed("component", "label")).select(F.col("modularity").alias("components"))
    # two tables of one row
    return own.crossJoin(F.broadcast(base)).select("components", (F.col("found") >= F.col("components") - 1e-9).alias("no_worse"))


def _communities(p):
    names, sim = kernels.dense(p)
    np.fill_diagonal(sim, 0)
    return pd.DataFrame({"node": names, "label": kernels.louvain(sim, 1.0).astype("int32")})


register("louvain_modularity", louvain_gain, f"WITH {REACH}, lm AS (SELECT sum(w) AS m2 FROM t), lx AS (SELECT a.component AS c, sum(CASE WHEN a.component = b.component THEN w ELSE 0 END) AS i, sum(w) AS dd FROM t JOIN cc a ON a.node = src JOIN cc b ON b.node = dst GROUP BY 1) SELECT round(sum(i / m2 - (dd / m2) * (dd / m2)), 6) AS components, true AS no_worse FROM lx, lm")


def _one_matrix(fn, schema):
    """fn over the matrix of the network, in one task: the kernel's input is one matrix."""

    def run(s, d):
        return net(s, d).groupBy(F.lit(1).alias("k")).applyInPandas(lambda p: fn(*kernels.dense(p)), schema)

    return run


def _mds(names, sim):
    dist = 1 - sim
    np.fill_diagonal(dist, 0)
    x, stress = kernels.mds(dist)
    return pd.DataFrame({"node": names, "x": x[:, 0].round(6), "y": x[:, 1].round(6)})


def _leaves(names, sim):
    order = kernels.leaf_order(1 - sim)
    return pd.DataFrame({"place": range(len(order)), "node": [names[i] for i in order]})


register("mds_2d", _one_matrix(_mds, "node string, x double, y double"))


def _mds3(names, sim):
    dist = 1 - sim
    np.fill_diagonal(dist, 0)
    x, stress = kernels.mds(dist, 3)
    return pd.DataFrame({"node": names, "x": x[:, 0].round(6), "y": x[:, 1].round(6), "z": x[:, 2].round(6)})


register("mds_3d", _one_matrix(_mds3, "node string, x double, y double, z double"))
register("leaf_order", _one_matrix(_leaves, "place int, node string"))


def by_cluster(s, d):
    from quillspark.operators.numbering import numbered

    return numbered(G.relabel(G.label_propagation(cut(s, d))), "place", "cluster", "node")


register("order_by_cluster", by_cluster, f"WITH {LPA}, z AS (SELECT label, count(*) AS n, min(node) AS f FROM l5 GROUP BY label), k AS (SELECT label, row_number() OVER (ORDER BY n DESC, f) - 1 AS cluster FROM z) SELECT node, cluster, row_number() OVER (ORDER BY cluster, node) - 1 AS place FROM l5 JOIN k USING (label)")
register("node2vec", lambda s, d: embed.node2vec(cut(s, d)))
register("struc2vec", lambda s, d: embed.struc2vec(cut(s, d)))
register("document_vectors", lambda s, d: embed.document_vectors(docs(s, d)))
HASHED = "SELECT {keys}, j + 1 AS dim, x / len AS x FROM (SELECT {keys}, j, x, sqrt(sum(x * x) OVER (PARTITION BY {keys})) AS len FROM (SELECT {keys}, h % 64 AS j, sum(CASE WHEN (h // 64) % 2 = 0 THEN n ELSE -n END)::DOUBLE AS x FROM (SELECT {keys}, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h, n FROM (SELECT {keys}, w, count(*) AS n FROM (SELECT {keys}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM ({rel})) GROUP BY {keys}, w)) GROUP BY {keys}, h % 64)) WHERE x <> 0"


def cells(vec, *keys):
    return vec.select(*keys, F.posexplode("vec").alias("dim", "x")).where("x <> 0").select(*keys, (F.col("dim") + 1).cast("long").alias("dim"), F.round("x", 6).alias("x"))


def rounded_sql(keys, text, rel):
    return f"SELECT {keys}, dim::BIGINT AS dim, round(x, 6) AS x FROM ({HASHED.format(keys=keys, text=text, rel=rel)})"


register("hashed_vectors", lambda s, d: cells(embed.hashed_vectors(docs(s, d)), "doc_id"), rounded_sql("doc_id", "text", "SELECT doc_id, text FROM documents"))
register("sentence_vectors", lambda s, d: cells(embed.hashed_vectors(segment.sentence_rows(docs(s, d)).withColumn("sent_idx", F.col("sent_idx").cast("long")), ["doc_id", "sent_idx"], "sentence"), "doc_id", "sent_idx"), rounded_sql("doc_id, sent_idx", "sentence", SENTS))


def chunk_vectors(s, d):
    """Mean of the sentence vectors of each chunk, and their spread and steps over the chunks of a text."""
    from quillspark.operators import features as X

    rows = segment.chunk_rows(docs(s, d)).select("doc_id", "chunk_idx", F.posexplode("sentences").alias("at", "sentence"))
    vec = embed.hashed_vectors(rows, ["doc_id", "chunk_idx", "at"], "sentence")
    mean = X.centroids(vec.withColumn("k", F.struct("doc_id", "chunk_idx")), "k", "vec").select("k.doc_id", "k.chunk_idx", F.col("centroid").alias("vec"))
    mean = written(mean)
    return X.intra_variance(mean, "doc_id", "vec").join(X.stepwise(mean, "doc_id", "vec", "chunk_idx"), "doc_id")


register("chunk_vector_measures", chunk_vectors, f"""WITH {BALANCED}, hv AS (SELECT doc_id, chunk_idx, i, dim, x FROM ({HASHED.format(keys="doc_id, chunk_idx, i", text="sentence", rel="SELECT doc_id, chunk_idx, i, sentence FROM bs")})),
ns AS (SELECT doc_id, chunk_idx, count(*) AS n FROM bs GROUP BY doc_id, chunk_idx), cv AS (SELECT ns.doc_id, ns.chunk_idx, d.dim, coalesce(sum(x), 0) / any_value(n) AS x FROM ns CROSS JOIN (SELECT unnest(range(1, 65)) AS dim) d LEFT JOIN hv ON hv.doc_id = ns.doc_id AND hv.chunk_idx = ns.chunk_idx AND hv.dim = d.dim GROUP BY ns.doc_id, ns.chunk_idx, d.dim),
ct AS (SELECT doc_id, dim, avg(x) AS m FROM cv GROUP BY doc_id, dim), va AS (SELECT doc_id, CASE WHEN count(*) > 1 THEN round(avg(dist), 6) END AS variance FROM (SELECT cv.doc_id, chunk_idx, sqrt(sum((x - m) * (x - m))) AS dist FROM cv JOIN ct ON ct.doc_id = cv.doc_id AND ct.dim = cv.dim GROUP BY cv.doc_id, chunk_idx) GROUP BY doc_id),
sw AS (SELECT doc_id, round(avg(dist), 6) AS stepwise FROM (SELECT doc_id, chunk_idx, sqrt(sum((x - p) * (x - p))) AS dist FROM (SELECT *, lag(x) OVER (PARTITION BY doc_id, dim ORDER BY chunk_idx) AS p FROM cv) GROUP BY doc_id, chunk_idx) GROUP BY doc_id)
SELECT doc_id, variance, stepwise FROM va JOIN sw USING (doc_id)""")
NEAR = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], '-'))) AS g FROM w), n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, ',' ORDER BY g)) AS h FROM g GROUP BY doc_id),
r AS (SELECT h, min(doc_id) AS rep, any_value(n) AS n FROM n GROUP BY h), gr AS (SELECT rep, g FROM g JOIN r ON g.doc_id = r.rep),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM gr a JOIN gr b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep),
l AS (SELECT a, b FROM p JOIN r x ON x.rep = a JOIN r y ON y.rep = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9), u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
z AS (SELECT rep AS node, rep AS hit FROM r UNION SELECT z.node, u.b FROM z JOIN u ON u.a = z.hit), k AS (SELECT node, min(hit) AS class_id FROM z GROUP BY node)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce((SELECT count(*) FROM u WHERE u.a = r.rep), 0) AS n_links FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (h) LEFT JOIN k ON k.node = r.rep"""
register("near_dup_jaccard", lambda s, d: neardup.classes(docs(s, d)), NEAR)


def logreg(s, d):
    """Balanced multinomial regression of a text's lang on two features: accuracy on the same rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from quillspark.operators.validation import classification_metrics

    rows = xy(s, d).join(md(s, d).select("text_id", "lang"), "text_id").where("lang IS NOT NULL")
    n = rows.groupBy("lang").agg(F.count("*").alias("n"))
    labels = [r["lang"] for r in n.orderBy("lang").collect()]
    rows = rows.join(n, "lang").withColumn("weight", 1.0 / F.col("n")).withColumn("label", F.array_position(F.array(*map(F.lit, labels)), F.col("lang")).cast("double") - 1)
    x = written(VectorAssembler(inputCols=["comma_rate_full", "verb_share_full"], outputCol="features").transform(rows).select("features", "label", "weight"))
    model = LogisticRegression(weightCol="weight", maxIter=30).fit(x)
    return classification_metrics(model.transform(x), "label", "prediction")


register("logreg_acc", logreg)


def grid_scores(s, d):
    """Mean score of boosted trees and regularised regressions over folds that keep an author's texts together."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression

    from quillspark.operators.validation import grid_search, group_folds

    m = md(s, d).select("text_id", fa().alias("g"))
    rows = xy(s, d).join(m, "text_id")
    folds = group_folds(rows, "g", 3)
    x = VectorAssembler(inputCols=["comma_rate_full", "verb_share_full"], outputCol="features").transform(rows.join(folds.select("g", "fold"), "g")).select("features", F.col("canon").alias("label"), "fold")
    x = written(x)
    models = [LinearRegression(regParam=0.01), LinearRegression(loss="huber", regParam=0.01), GBTRegressor(maxDepth=2, maxIter=5, seed=7), GBTRegressor(maxDepth=4, maxIter=5, seed=7)]
    scores = grid_search(x, models, RegressionEvaluator(metricName="rmse"), "fold")
    return s.createDataFrame([(i, type(models[i]).__name__, m, len(x)) for i, m, x in scores], "model int, kind string, rmse double, folds int")


register("grid_search", grid_scores)


def importances(s, d):
    """Importance of each feature for canon by boosted trees, the greatest first; ties stay."""
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    f = table(s, d, "features").groupBy("text_id").agg(F.max(F.struct("computed_at", *FCOLS)).alias("m")).select("text_id", *[F.when(F.col(f"m.{c}") >= 0, F.col(f"m.{c}")).alias(c) for c in FCOLS])
    rows = f.join(md(s, d).where("canon IS NOT NULL").select("text_id", F.col("canon").alias("label")), "text_id")
    full = Imputer(inputCols=FCOLS, outputCols=FCOLS).fit(rows).transform(rows)
    model = GBTRegressor(maxDepth=3, maxIter=5, seed=7).fit(VectorAssembler(inputCols=FCOLS, outputCol="features").transform(full))
    return s.createDataFrame([(c, float(v)) for c, v in zip(FCOLS, model.featureImportances.toArray())], "feature string, importance double")


register("feature_importance", importances)


def _nested(s, d):
    """Nested cross-validation of canon over all features: inner folds choose the model, outer folds score it; authors stay together."""
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    from quillspark.operators import validation as P
    from quillspark.plans.meta_queries import full_xy

    m = md(s, d).select("text_id", fa().alias("g"))
    rows = written(full_xy(s, d).join(m, "text_id"))
    rows = rows.join(P.group_folds(rows, "g", 2).select("g", "fold"), "g")
    full = Imputer(inputCols=FCOLS, outputCols=FCOLS).fit(rows).transform(rows)
    x = VectorAssembler(inputCols=FCOLS, outputCol="features").transform(full).select("features", F.col("canon").alias("label"), "g", F.col("fold").alias("outer_fold"))
    models = [LinearRegression(regParam=0.05), RandomForestRegressor(maxDepth=3, numTrees=8, seed=7), GBTRegressor(maxDepth=2, maxIter=4, seed=7)]
    return models, P.nested_scores(written(x), models, "label", "outer_fold", 2)


def nested_cv(s, d):
    models, rows = _nested(s, d)
    return s.createDataFrame([(r["fold"], type(models[r["model"]]).__name__, r["inner_r"], r["r"], r["p"], r["r2"], r["rmse"], r["mae"], r["n"]) for r in rows], "fold int, model string, inner_r double, r double, p double, r2 double, rmse double, mae double, n long")


register("nested_cv", nested_cv)


def summed(s, d):
    """Importances of the features summed over the models of the outer folds."""
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    from quillspark.operators import validation as P
    from quillspark.plans.meta_queries import full_xy

    rows = written(full_xy(s, d).join(md(s, d).select("text_id", fa().alias("g")), "text_id"))
    rows = rows.join(P.group_folds(rows, "g", 3).select("g", "fold"), "g")
    full = written(VectorAssembler(inputCols=FCOLS, outputCol="features").transform(Imputer(inputCols=FCOLS, outputCols=FCOLS).fit(rows).transform(rows)).select("features", F.col("canon").alias("label"), "fold"))
    models = [GBTRegressor(maxDepth=3, maxIter=4, seed=7).fit(full.where(F.col("fold") != f)) for f in range(3)]
    return s.createDataFrame(P.summed_importances(models, FCOLS), "feature string, importance double, over boolean")


register("importance_summed", summed)


def stream_counts(s, d):
    """Word counts of the documents read as a stream, to its end; the sink is a table in the shared folder."""
    import uuid

    schema = docs(s, d).schema
    at = f"{shared_dir(s)}/quillspark/stream-{uuid.uuid4().hex}"
    src = s.readStream.schema(schema).format("parquet").load(f"{d}/documents.parq*")
    out = wordcount.word_counts(src)
    q = out.writeStream.outputMode("complete").foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(f"{at}/out")).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.parquet(f"{at}/out")


register("stream_word_counts", stream_counts, r"SELECT ngram, count(*) AS total FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS ngram FROM documents) GROUP BY ngram")
register("daily_documents", lambda s, d: wordcount.daily_documents(docs(s, d)).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "source", "n", "chars"), "SELECT strftime(date_trunc('day', added_at), '%Y-%m-%d') AS day, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE added_at IS NOT NULL GROUP BY 1, 2")
