"""Queries of matrices, generated graphs, centralities, merged authors, folds, baselines and evaluation rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import distance as D
from quillspark.operators import evaluate as E
from quillspark.operators import experiments as Q
from quillspark.operators import features as X
from quillspark.operators import graph as G
from quillspark.operators import ngrams as N
from quillspark.operators import segment
from quillspark.operators import validation as P
from quillspark.operators.numbering import numbered
from quillspark.plans.eval_queries import CONT, EV, META, NUM, RUNS, evals, meta, num, runs, with_attr
from quillspark.plans.graph_queries import CUT, HOPS, NET, SUMS, V, cut, net
from quillspark.plans.meta_queries import FA, MD, YEAR, fa, md, yr
from quillspark.plans.ngram_queries import BALANCED, FCOLS, G1, TAG_SQL, chunks, uni
from quillspark.plans.registry import register
from quillspark.session import written
from quillspark.sources.tables import spread, table

docs = lambda s, d: spread(table(s, d, "documents"))
union = lambda rows: reduce(DataFrame.unionByName, rows)

# matrices and graphs
register("matrix_checks", lambda s, d: G.matrix_checks(net(s, d)), f"WITH {NET}, k AS (SELECT count(DISTINCT src) AS n FROM e) SELECT n AS n_nodes, (SELECT count(*) FROM e) AS n_cells, n * (n - 1) - (SELECT count(*) FROM e) AS n_missing, 0::BIGINT AS n_repeated, (SELECT count(*) FROM e WHERE NOT EXISTS (SELECT 1 FROM e f WHERE f.src = e.dst AND f.dst = e.src AND f.w = e.w)) AS n_asymmetric, 0::BIGINT AS n_off_diagonal FROM k")
register("matrix_condensed", lambda s, d: G.condensed(net(s, d)), f"WITH {NET} SELECT row_number() OVER (ORDER BY src, dst) - 1 AS place, w FROM e WHERE src < dst")


def with_gaps(s, d):
    e = net(s, d)
    return e.withColumn("w", F.when(F.col("w") < 0.3, F.lit(None)).when(F.col("w") < 0.5, F.lit(float("nan"))).otherwise(F.col("w"))).unionByName(e.where("w > 0.99").select("src", F.col("src").alias("dst"), "w").distinct())


GAPS = f"{NET}, gx AS (SELECT src, dst, CASE WHEN w < 0.3 THEN NULL WHEN w < 0.5 THEN 'NaN'::DOUBLE ELSE w END AS w FROM e UNION ALL (SELECT DISTINCT src, src, w FROM e WHERE w > 0.99))"
register("edge_weight_check", lambda s, d: G.bad_weights(with_gaps(s, d)), f"WITH {GAPS} SELECT count(*) AS n_edges, count(*) FILTER (WHERE w IS NULL) AS n_null, count(*) FILTER (WHERE isnan(w)) AS n_nan, count(*) FILTER (WHERE src = dst) AS n_loops FROM gx")
register("edge_weight_replace", lambda s, d: G.replace_nan(with_gaps(s, d), 0.25), f"WITH {GAPS} SELECT src, dst, CASE WHEN w IS NULL OR isnan(w) THEN 0.25 ELSE w END AS w FROM gx")
register("self_loops", lambda s, d: with_gaps(s, d).where("src = dst").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n")), f"WITH {GAPS} SELECT src AS node, count(*) AS n FROM gx WHERE src = dst GROUP BY src")
COMPLETE = "k AS (SELECT a.i AS src, b.i AS dst FROM range(60) a(i), range(60) b(i) WHERE a.i <> b.i)"
register("complete_graph", lambda s, d: G.complete_graph(s, 60), f"WITH {COMPLETE} SELECT src, dst, 1.0::DOUBLE AS w FROM k")
RANDOM = f"{COMPLETE}, e AS (SELECT src, dst, ((least(src, dst) * 7919 + greatest(src, dst) * 104729 + least(src, dst) * greatest(src, dst) * 31 + 3 * 15485863) % 97) / 97 AS w FROM k)"
register("random_matrix", lambda s, d: G.random_matrix(s, 60, 3), f"WITH {RANDOM} SELECT src, dst, w FROM e")


def random_backbone(s, d):
    e = G.random_matrix(s, 60, 3)
    return G.simmelian(e.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "w"), 8)


register("random_simmelian", random_backbone, f"WITH {RANDOM}, tk AS (SELECT src::VARCHAR AS src, dst::VARCHAR AS dst, w FROM (SELECT *, rank() OVER (PARTITION BY src ORDER BY w DESC) AS r FROM e) WHERE r <= 8), nb AS (SELECT src, list_sort(list(dst)) AS n FROM tk GROUP BY src) SELECT tk.src, tk.dst, tk.w, CASE WHEN a.n = b.n THEN 0 ELSE len(list_intersect(a.n, b.n)) + CASE WHEN list_contains(b.n, tk.src) THEN 1 ELSE 0 END END AS overlap FROM tk JOIN nb a ON a.src = tk.src JOIN nb b ON b.src = tk.dst")
PATHS = HOPS + ", s0 AS (SELECT start, node, 1.0::DOUBLE AS p FROM h WHERE hops = 0)" + "".join(f", s{k} AS (SELECT h.start, h.node, sum(q.p) AS p FROM s{k - 1} q JOIN t ON t.src = q.node JOIN h ON h.start = q.start AND h.node = t.dst AND h.hops = {k} GROUP BY h.start, h.node)" for k in range(1, 13)) + ", pc AS (" + " UNION ALL ".join(f"SELECT start, node, {k} AS hops, p FROM s{k}" for k in range(13)) + ")"
register("path_counts", lambda s, d: G.path_counts(cut(s, d)).select("start", "node", F.col("hops").cast("long").alias("hops"), "paths"), f"WITH {PATHS} SELECT start, node, hops::BIGINT AS hops, p AS paths FROM pc")
CENTRAL = PATHS + ", cl AS (SELECT start AS node, round(count(*) / sum(hops) * count(*) / greatest(1, (SELECT count(*) FROM pc WHERE hops = 0) - 1), 6) AS closeness FROM pc WHERE hops > 0 GROUP BY start), bw AS (SELECT a.node, round(sum(a.p * b.p / c.p), 4) AS betweenness FROM pc a JOIN pc b ON b.start = a.node AND b.node > a.start JOIN pc c ON c.start = a.start AND c.node = b.node WHERE a.hops > 0 AND b.hops > 0 AND a.hops + b.hops = c.hops GROUP BY a.node), dg AS (SELECT src AS node, count(*) AS degree FROM t GROUP BY src), ce AS (SELECT node, degree, coalesce(closeness, 0) AS closeness, coalesce(betweenness, 0) AS betweenness FROM dg LEFT JOIN cl USING (node) LEFT JOIN bw USING (node))"
register("centralities", lambda s, d: G.centralities(cut(s, d)), f"WITH {CENTRAL} SELECT node, degree, closeness, betweenness FROM ce")


def central_corr(s, d):
    """Correlation of each centrality with the mean length of the texts of a node."""
    v = docs(s, d).where("source IS NOT NULL").groupBy(F.concat_ws("/", "source", F.coalesce("lang", F.lit("-"))).alias("node")).agg(F.avg("n_chars").alias("v"))
    c = G.centralities(cut(s, d)).join(v, "node")
    return c.agg(*[F.round(F.corr(k, "v"), 4).alias(k) for k in ("degree", "closeness", "betweenness")])


register("centrality_correlation", central_corr, f"WITH {CENTRAL}, v AS (SELECT source || '/' || coalesce(lang, '-') AS node, avg(n_chars) AS v FROM documents WHERE source IS NOT NULL GROUP BY 1) SELECT round(corr(degree, v), 4) AS degree, round(corr(closeness, v), 4) AS closeness, round(corr(betweenness, v), 4) AS betweenness FROM ce JOIN v USING (node)")
register("grid_layout", lambda s, d: numbered(G.nodes_of(net(s, d)), "i", "node").select("node", (F.col("i") % 40).alias("x"), F.floor(F.col("i") / 40).alias("y")), f"WITH {NET} SELECT node, i % 40 AS x, i // 40 AS y FROM (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i FROM n)")


def node_cosine(s, d):
    """Cosine of the nodes' vectors, the rows of the matrix with 1 on the diagonal: as for any vectors of nodes."""
    e = net(s, d)
    full = e.unionByName(G.nodes_of(e).select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("w")))
    vec = full.groupBy(F.col("src").alias("node")).agg(F.transform(F.sort_array(F.collect_list(F.struct("dst", "w"))), lambda x: x["w"]).alias("vec"))
    return D.matrix(written(vec))


register("node_vector_cosine", node_cosine, f"WITH {NET}, f AS (SELECT src, dst, w FROM e UNION ALL SELECT node, node, 1.0 FROM n) SELECT a.src, b.src AS dst, round(sum(a.w * b.w) / (sqrt(sum(a.w * a.w)) * sqrt(sum(b.w * b.w))), 6) AS w FROM f a JOIN f b USING (dst) WHERE a.src <> b.src GROUP BY a.src, b.src")


def mfw_widths(s, d):
    """The nearest document by Burrows' Delta over 500, 1000, 2000 and 5000 most frequent words, of every hundredth one."""
    rows, words = N.sparse_vectors(written(N.counts(docs(s, d))), 5000)
    rows = written(rows)
    near = D.nearest_widths(rows, rows.where("doc_id % 100 = 0"), words.count(), (500, 1000, 2000, 5000))
    return near.select("width", "doc_id", "other", F.round("value", 5).alias("value"))


WIDE = "WITH {G1}, n AS (SELECT doc_id, sum(cnt)::DOUBLE AS n FROM g GROUP BY doc_id), m AS (SELECT ngram, row_number() OVER (ORDER BY round(sum(cnt / n), 9) DESC, ngram) AS rank FROM g JOIN n USING (doc_id) GROUP BY ngram QUALIFY rank <= 5000), v AS (SELECT doc_id, rank, coalesce(cnt, 0) / n AS x FROM n CROSS JOIN m LEFT JOIN g USING (doc_id, ngram)), st AS (SELECT rank, stddev_samp(x) AS ss FROM v GROUP BY rank), z AS (SELECT doc_id, rank, x / ss AS x FROM v JOIN st USING (rank) WHERE ss > 0), p AS (SELECT width, a.doc_id, b.doc_id AS other, round(sum(abs(a.x - b.x)) / least(width, (SELECT count(*) FROM m)), 6) AS value FROM z a JOIN z b USING (rank) JOIN (VALUES (500), (1000), (2000), (5000)) w(width) ON rank <= width WHERE a.doc_id % 100 = 0 AND a.doc_id <> b.doc_id GROUP BY width, a.doc_id, b.doc_id) SELECT width, doc_id, other, round(value, 5) AS value FROM p QUALIFY row_number() OVER (PARTITION BY width, doc_id ORDER BY value, other) = 1"
register("delta_widths", mfw_widths, WIDE.replace("{G1}", G1))


def cross_check(s, d):
    """The block kernel of Burrows' Delta against sums over words, with deviations by SQL, of the same vectors: pairs, and the greatest difference as a share of the greatest distance."""
    vec = written(N.vectors(written(N.counts(docs(s, d))), 100)[0].select(F.col("doc_id").alias("_key"), "vec"))
    # one row of a number a word
    dev = vec.select(F.posexplode("vec").alias("j", "x")).groupBy("j").agg(F.stddev_samp("x").alias("sd")).orderBy("j").toPandas()["sd"].to_numpy(dtype=float)
    # more tasks than cores, as pairs are what takes the time
    rows = vec.repartition(4 * s.sparkContext.defaultParallelism, "_key")
    sums = union([D.two_ways(rows, some, dev) for some in D._passes(vec.where("_key % 100 = 0"), D.BLOCK_CELLS // 100)])
    agree = F.max("gap") <= 0.05 * F.max("top")
    return sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"), F.coalesce(agree, F.lit(True)).alias("agree"))


register("metric_cross_check", cross_check, f"WITH {G1}, n AS (SELECT doc_id FROM g GROUP BY doc_id) SELECT count(*) AS n_pairs, true AS agree FROM n a JOIN n b ON a.doc_id <> b.doc_id WHERE a.doc_id % 100 = 0")

# n-grams, tags, texts
register("ngram_row_check", lambda s, d: docs(s, d).where(F.size(T.words(F.col("text"))) > 0).agg(F.count_distinct("doc_id").alias("n_texts")).crossJoin(F.broadcast(uni(s, d).agg(F.count_distinct("doc_id").alias("n_rows")))).select("n_texts", "n_rows", (F.col("n_texts") == F.col("n_rows")).alias("equal")), f"WITH {G1}, a AS (SELECT count(DISTINCT doc_id) AS n_texts FROM documents WHERE len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) > 0), b AS (SELECT count(DISTINCT doc_id) AS n_rows FROM g) SELECT n_texts, n_rows, n_texts = n_rows AS equal FROM a, b")


def label_shares(s, d):
    """Shares of the token labels of each chunk, and of its whole text as sentd_: the form of a table of dependency labels."""
    tags = chunks(s, d).select("doc_id", "chunk_idx", F.explode("sentences").alias("sentence")).select("doc_id", "chunk_idx", F.explode(F.transform(T.tokens(F.col("sentence")), X.shape_tag)).alias("tag"))
    cnt = written(tags.groupBy("doc_id", "chunk_idx", "tag").agg(F.count("*").alias("n")))
    part = cnt.select("doc_id", "chunk_idx", "tag", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("doc_id", "chunk_idx")), 6).alias("rel"))
    book = cnt.groupBy("doc_id", "tag").agg(F.sum("n").alias("n"))
    whole = book.select("doc_id", F.lit(-1).alias("chunk_idx"), F.concat(F.lit("sentd_"), "tag").alias("tag"), F.round(F.col("n") / F.sum("n").over(Window.partitionBy("doc_id")), 6).alias("rel"))
    return part.unionByName(whole)


register("label_shares", label_shares, rf"""WITH {BALANCED}, k AS (SELECT doc_id, chunk_idx, unnest(list_transform(regexp_extract_all(sentence, '[\p{{L}}\p{{N}}_]+|[^\s\p{{L}}\p{{N}}_]'), lambda token: {TAG_SQL})) AS tag FROM bs), c AS (SELECT doc_id, chunk_idx, tag, count(*) AS n FROM k GROUP BY ALL), b AS (SELECT doc_id, tag, sum(n) AS n FROM c GROUP BY doc_id, tag)
SELECT doc_id, chunk_idx, tag, round(n / sum(n) OVER (PARTITION BY doc_id, chunk_idx), 6) AS rel FROM c UNION ALL SELECT doc_id, -1, 'sentd_' || tag, round(n / sum(n) OVER (PARTITION BY doc_id), 6) FROM b""")
register("feat_digits_paragraphs", lambda s, d: docs(s, d).where("text IS NOT NULL").select("doc_id", T.ratio(T.count_of(F.col("text"), "0123456789"), F.length("text")).alias("ratio_of_digits"), F.round(F.length(F.regexp_replace("text", "\n", "")) / F.size(F.split("text", "\n")), 6).alias("average_paragraph_length")), "SELECT doc_id, round((length(text) - length(translate(text, '0123456789', ''))) / nullif(length(text), 0), 6) AS ratio_of_digits, round(length(replace(text, chr(10), '')) / len(string_split(text, chr(10))), 6) AS average_paragraph_length FROM documents WHERE text IS NOT NULL")

# texts of an author
def author_parts(s, d):
    """The texts of each author in the order of their titles, as numbered parts under the name of the merged text.

    The merged text is these parts in order; it is never one row, since an author may hold a third of all texts.
    """
    m = md(s, d).where("file_name IS NOT NULL").select("text_id", fa().alias("author"), "title", yr().alias("y"))
    name = m.groupBy("author").agg(F.concat(F.first("author"), F.lit("_all_"), F.coalesce(F.bround(F.avg("y")).cast("int").cast("string"), F.lit("-"))).alias("name"))
    raw = table(s, d, "text_raw").where("text_id IS NOT NULL").groupBy("text_id").agg(F.max(F.struct("received_at", "text"))["text"].alias("text"))
    parts = written(m.join(raw.where("text IS NOT NULL"), "text_id").select("author", "title", "text_id", "text"))
    order = written(numbered(parts.select("author", "title", "text_id"), "_n", "author", F.asc_nulls_first("title"), "text_id"))
    first = order.groupBy("author").agg(F.min("_n").alias("_f"))
    placed = order.join(first, "author").select("text_id", (F.col("_n") - F.col("_f")).alias("part"))
    return parts.join(placed, "text_id").join(name, "author").select("author", "name", "part", "text_id", "text")


AP = f"{MD}, m AS (SELECT text_id, {FA} AS author, title, {YEAR} AS y FROM md WHERE file_name IS NOT NULL), nm AS (SELECT author, author || '_all_' || coalesce(round_even(avg(y), 0)::INT::VARCHAR, '-') AS name FROM m GROUP BY author), rw AS (SELECT text_id, text FROM text_raw WHERE text_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY received_at DESC NULLS LAST, text DESC NULLS LAST) = 1), ap AS (SELECT author, name, row_number() OVER (PARTITION BY author ORDER BY title NULLS FIRST, text_id) - 1 AS part, text_id, text FROM m JOIN rw USING (text_id) JOIN nm USING (author) WHERE text IS NOT NULL)"
register("author_texts", lambda s, d: author_parts(s, d).select("author", "name", "part", "text_id", F.md5("text").alias("digest")), f"WITH {AP} SELECT author, name, part, text_id, md5(text) AS digest FROM ap")
register("author_ngrams", lambda s, d: N.counts(author_parts(s, d).select("name", "text"), key="name"), rf"WITH {AP} SELECT name, ngram, count(*) AS cnt FROM (SELECT name, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS ngram FROM ap) GROUP BY name, ngram")
register("author_chunks", lambda s, d: segment.chunk_rows(author_parts(s, d).select(F.struct("name", "part").alias("key"), "text"), "key", size=100, method="greedy").select("key.name", "key.part", "chunk_idx", "n_sents", "n_tokens").groupBy("name").agg(F.count("*").alias("n_chunks"), F.sum("n_sents").alias("n_sents"), F.sum("n_tokens").alias("n_tokens")).drop("n_chunks"), rf"WITH {AP}, s AS (SELECT name, unnest(list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), lambda x: trim(x, ' ')), lambda x: length(x) > 0)) AS s FROM ap) SELECT name, count(*) AS n_sents, sum(len(string_split_regex(s, '[ \t\n\r\f]+')))::BIGINT AS n_tokens FROM s GROUP BY name")
register("author_vectors", lambda s, d: X.centroids(table(s, d, "embeddings").withColumn("a", F.concat(F.lit("a"), F.col("label") % 4)), "a").select("a", "n", F.round(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x * x), 6).alias("sq")), "WITH e AS (SELECT 'a' || (label % 4) AS a, i, embedding[i]::DOUBLE AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) r(i)), c AS (SELECT a, i, avg(x) AS m, count(*) AS n FROM e GROUP BY a, i) SELECT a, max(n) AS n, round(sum(m * m), 6) AS sq FROM c GROUP BY a")

# validation
register("dropped_columns", lambda s, d: P.dropped(table(s, d, "features").select("text_id", "computed_at", *FCOLS).distinct(), ["ratio", "entropy"]), "SELECT DISTINCT text_id, computed_at, " + ", ".join(c for c in FCOLS if "ratio" not in c and "entropy" not in c) + " FROM features")


def alias_map(s, d):
    """(alias, name): an author that shares a viaf number with another takes the first of their names."""
    m = md(s, d).where("author_viaf IS NOT NULL AND file_name IS NOT NULL").select(fa().alias("alias"), F.regexp_replace("author_viaf", r"\s+", "").alias("v"))
    first = m.groupBy("v").agg(F.min("alias").alias("name"))
    return m.join(first, "v").groupBy("alias").agg(F.min("name").alias("name")).where("alias <> name")


ALIAS = rf"{MD}, av AS (SELECT {FA} AS alias, regexp_replace(author_viaf, '\s+', '', 'g') AS v FROM md WHERE author_viaf IS NOT NULL AND file_name IS NOT NULL), al AS (SELECT alias, min(name) AS name FROM av JOIN (SELECT v, min(alias) AS name FROM av GROUP BY v) USING (v) GROUP BY alias HAVING alias <> min(name)), ag AS (SELECT text_id, coalesce(al.name, {FA}) AS g, gender FROM md LEFT JOIN al ON al.alias = {FA} WHERE file_name IS NOT NULL)"
grouped = lambda s, d: P.aliased_groups(md(s, d).where("file_name IS NOT NULL").select("text_id", fa().alias("g"), "gender"), "g", alias_map(s, d))
register("author_groups", lambda s, d: grouped(s, d).groupBy("g").agg(F.count("*").alias("n")), f"WITH {ALIAS} SELECT g, count(*) AS n FROM ag GROUP BY g")
DEAL = "list_reduce(l, lambda a, x: {'z': list_transform(range(1, 6), lambda i: a.z[i] + CASE WHEN i = list_position(a.z, list_min(a.z)) THEN x ELSE 0 END), 'f': list_append(a.f, list_position(a.z, list_min(a.z)) - 1)}, {'z': [0, 0, 0, 0, 0]::BIGINT[], 'f': []::INT[]})"
register("group_kfold", lambda s, d: P.group_folds(grouped(s, d), "g").groupBy("fold").agg(F.count("*").alias("groups"), F.sum("n").alias("texts")), f"WITH {ALIAS}, z AS (SELECT g, count(*) AS n FROM ag GROUP BY g), l AS (SELECT list(n ORDER BY n DESC, g) AS l FROM z), f AS (SELECT l, {DEAL} AS r FROM l), u AS (SELECT unnest(l) AS n, unnest(r.f) AS fold FROM f) SELECT fold, count(*) AS groups, sum(n)::BIGINT AS texts FROM u GROUP BY fold")
register("stratified_group_kfold", lambda s, d: P.stratified_group_folds(grouped(s, d), "g", "gender").join(grouped(s, d), "g").where("gender IS NOT NULL").groupBy("fold", "gender").agg(F.count("*").alias("texts"), F.count_distinct("g").alias("groups")))
register("baseline_guesses", lambda s, d: P.baseline_scores(docs(s, d), "lang", "doc_id"), """WITH d AS (SELECT lang AS y, ((doc_id * 7919 + 104729) % 1000) / 1000 AS u FROM documents WHERE lang IS NOT NULL), c AS (SELECT y, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, y) - 1 AS i FROM d GROUP BY y), k AS (SELECT *, sum(n) OVER (ORDER BY i) AS upto, sum(n) OVER () AS total, count(*) OVER () AS k FROM c),
g AS (SELECT d.y, (SELECT min(y) FROM c) AS a, (SELECT y FROM k WHERE i = floor(d.u * k)) AS b, (SELECT y FROM k WHERE d.u * total < upto ORDER BY i LIMIT 1) AS e, (SELECT y FROM k WHERE i = floor(d.u * least(k, 2))) AS f, (SELECT y FROM k WHERE i = least(CASE WHEN d.u < 0.5 THEN 0 WHEN d.u < 0.75 THEN 1 ELSE 2 END, k - 1)) AS h FROM d)
SELECT 'all_first' AS baseline, round(avg((y = a)::INT), 6) AS acc FROM g UNION ALL SELECT 'uniform', round(avg((y = b)::INT), 6) FROM g UNION ALL SELECT 'by_share', round(avg((y = e)::INT), 6) FROM g UNION ALL SELECT 'two_largest', round(avg((y = f)::INT), 6) FROM g UNION ALL SELECT 'half_and_quarters', round(avg((y = h)::INT), 6) FROM g""")

# evaluation
AMI = CONT.replace("x AS (SELECT *,", "x AS (SELECT *,", 1) + """, ma AS (SELECT run, cluster, sum(n) AS a FROM t GROUP BY run, cluster), mb AS (SELECT run, attr, sum(n) AS b FROM t GROUP BY run, attr),
em AS (SELECT run, sum(k / N * ln(N * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(N - a + 1) + lgamma(N - b + 1) - lgamma(N + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(N - a - b + k + 1))) AS emi
 FROM (SELECT run, a, b, N, unnest(range(greatest(1, a + b - N)::BIGINT, least(a, b)::BIGINT + 1))::DOUBLE AS k FROM ma JOIN mb USING (run) JOIN c USING (run)) GROUP BY run),
tm AS (SELECT run, sum(k / big * ln(big * k / (a * b))) AS mi FROM (SELECT t.run, t.n AS k, c.N AS big, ma.a, mb.b FROM t JOIN c ON c.run = t.run JOIN ma ON ma.run = t.run AND ma.cluster = t.cluster JOIN mb ON mb.run = t.run AND mb.attr = t.attr) GROUP BY run)"""
register("ami", lambda s, d: E.adjusted_mi(E.contingency(with_attr(s, d, "gender"))), f"WITH {AMI} SELECT run, round(CASE WHEN abs((ha + hb) / 2 - emi) < 1e-12 THEN 1 ELSE (tm.mi - emi) / ((ha + hb) / 2 - emi) END, 6) AS ami FROM y JOIN em USING (run) JOIN tm USING (run)")


def eval_rows(s, d):
    """One row a run, attribute and score: classes are scored against the clusters, numbers by their spread over them.

    Attributes are sent to the scores of their kind; missing values are left out first, and a run that then has a
    single cluster, or none of two texts, is not valid and has null scores.
    """
    kinds = {"gender": "classes", "lang": "classes", "canon": "numbers"}
    out = []
    for attr, kind in kinds.items():
        rows = written(with_attr(s, d, attr, "value").where("value IS NOT NULL"))
        valid = E.validity(rows).select("run", "valid")
        if kind == "classes":
            sc = E.external_scores(E.contingency(rows.withColumnRenamed("value", "attr"))).select("run", "ari", "nmi", "purity")
            names = ["ari", "nmi", "purity"]
        else:
            sc = E.numeric_scores(rows).select("run", "wcss", "anova_f")
            names = ["wcss", "anova_f"]
        cells = F.array(*[F.struct(F.lit(n).alias("score"), F.when(F.col("valid"), F.col(n)).alias("value")) for n in names])
        out.append(sc.join(valid, "run").select("run", F.lit(attr).alias("attr"), F.lit(kind).alias("kind"), "valid", F.explode(cells).alias("c")).select("run", "attr", "kind", "valid", "c.score", "c.value"))
    return union(out)


def _eval_sql() -> str:
    def one(attr, cte, kind, cols):
        scores = ", ".join(f"{v} AS {k}" for k, v in cols.items())
        return f"SELECT run, '{attr}' AS attr, '{kind}' AS kind, valid, unnest([{', '.join(repr(k) for k in cols)}]) AS score, unnest([{', '.join(f'CASE WHEN valid THEN {k} END' for k in cols)}]) AS value FROM (SELECT q.run, {scores} FROM ({cte}) q) JOIN (SELECT run, count(*) > 1 AND max(n) > 1 AS valid FROM (SELECT run, cluster, count(*) AS n FROM rr JOIN md USING (item) WHERE {attr} IS NOT NULL GROUP BY run, cluster) GROUP BY run) USING (run)"

    ext = {"ari": "round(CASE WHEN abs((pa + pb) / 2 - e) < 1e-12 THEN 1 ELSE (pij - e) / ((pa + pb) / 2 - e) END, 6)", "nmi": "round(CASE WHEN ha + hb < 1e-12 THEN 1 ELSE 2 * mi / (ha + hb) END, 6)", "purity": "round(top / N, 6)"}
    tail = CONT[CONT.index("t AS (") :]
    lang = tail.replace("gender", "lang")
    for x in ("t", "c", "a", "b", "x", "y"):
        lang = lang.replace(f"\n{x} AS (", f"\nl{x} AS (").replace(f"FROM {x} ", f"FROM l{x} ").replace(f"JOIN {x} ", f"JOIN l{x} ").replace(f"FROM {x})", f"FROM l{x})").replace(f"FROM {x},", f"FROM l{x},")
    lang = "l" + lang if lang.startswith("t AS (") else lang
    f = "round(((q - S * S / N) / nullif(k - 1, 0)) / nullif(ssw / nullif(N - k, 0), 0), 4)"
    numbers = NUM[NUM.index("v AS (") :].replace("\np AS (", "\nnp AS (").replace("FROM p ", "FROM np ").replace("\nq AS (", "\nnq AS (").replace("v AS (SELECT run, cluster, canon", "nv AS (SELECT run, cluster, canon").replace("FROM v ", "FROM nv ")
    return f"WITH {CONT}, {lang}, {numbers} " + " UNION ALL ".join([one("gender", "SELECT * FROM y", "classes", ext), one("lang", "SELECT * FROM ly", "classes", ext), one("canon", "SELECT * FROM nq", "numbers", {"wcss": "round(ssw, 6)", "anova_f": f})])


register("eval_rows", eval_rows, _eval_sql())
CRITERIA = ["ari", "nmi", "silhouette_score"]


def experiments(s, d):
    """Every experiment over the evaluation table: how many rows each keeps at most."""
    e = written(evals(s, d))
    out = []
    for g in Q.grid(score=CRITERIA, nclust=[(2, 10), (2, 500), (5, 5)], attr=["gender", "canon", None]):
        x = Q.Experiment(score=g["score"], nclust_min=g["nclust"][0], nclust_max=g["nclust"][1], attr=g["attr"], ntop=10)
        out.append(Q.run(e, x).agg(F.count("*").alias("n"), F.round(F.max(g["score"]), 6).alias("best")).select(F.lit(g["score"]).alias("score"), F.lit(f"{g['nclust'][0]}-{g['nclust'][1]}").alias("nclust"), F.lit(g["attr"] or "all").alias("attr"), "n", "best"))
    return union(out)


register("experiments", experiments, f"WITH {EV} " + " UNION ALL ".join(f"SELECT '{sc}' AS score, '{a}-{b}' AS nclust, '{attr or 'all'}' AS attr, count(*) AS n, round(max({sc}), 6) AS best FROM (SELECT {sc} FROM ev WHERE {sc} IS NOT NULL AND NOT coalesce(contains(file_info, 'mirror'), false) AND nclust BETWEEN {a} AND {b}" + (f" AND attr = '{attr}'" if attr else "") + f" QUALIFY rank() OVER (ORDER BY {sc} DESC) <= 10)" for sc in CRITERIA for a, b in ((2, 10), (2, 500), (5, 5)) for attr in ("gender", "canon", None)))


def top_combinations(s, d):
    """The texts of the best run of each attribute, with their cluster, gender and a colour and shape for it."""
    best = Q.keep_first(evals(s, d).where("ari IS NOT NULL"), ["attr"], F.desc("ari"), F.asc("run_id"), F.asc("evaluated_at")).select(F.col("attr").alias("of"), F.col("run_id").alias("run"))
    rows = runs(s, d).join(F.broadcast(best), "run").join(meta(s, d), "item")
    return rows.select("of", "run", F.col("item").alias("text_id"), "cluster", F.expr("CASE gender WHEN 'm' THEN 'blue' WHEN 'f' THEN 'red' WHEN 'a' THEN 'grey' WHEN 'b' THEN 'violet' ELSE 'white' END").alias("colour"), F.expr("CASE WHEN canon IS NULL THEN 'x' WHEN canon < 0.333 THEN 'v' WHEN canon < 0.666 THEN 's' ELSE '^' END").alias("shape"))


register("top_combinations", top_combinations, f"WITH {RUNS}, {META}, {EV}, b AS (SELECT attr AS of, run_id AS run FROM ev WHERE ari IS NOT NULL QUALIFY row_number() OVER (PARTITION BY attr ORDER BY ari DESC, run_id, evaluated_at) = 1) SELECT of, run, item AS text_id, cluster, CASE gender WHEN 'm' THEN 'blue' WHEN 'f' THEN 'red' WHEN 'a' THEN 'grey' WHEN 'b' THEN 'violet' ELSE 'white' END AS colour, CASE WHEN canon IS NULL THEN 'x' WHEN canon < 0.333 THEN 'v' WHEN canon < 0.666 THEN 's' ELSE '^' END AS shape FROM rr JOIN b USING (run) JOIN md USING (item)")
CORNERS = [(0.1, 1800.0), (0.9, 1810.0), (0.6, 1850.0), (0.95, 1900.0), (0.2, 1890.0)]
LASSO = " + ".join(f"CASE WHEN {min(y1, y2)} <= y AND y < {max(y1, y2)} AND x < {x1} + (y - {y1}) * {(x2 - x1) / (y2 - y1)!r} THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in zip(CORNERS, CORNERS[1:] + CORNERS[:1]))
register("lasso", lambda s, d: md(s, d).select("text_id", F.col("canon").alias("x"), yr().cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL").where(G.in_polygon(F.col("x"), F.col("y"), CORNERS)).select("text_id"), f"WITH {MD} SELECT text_id FROM (SELECT text_id, canon AS x, {YEAR}::DOUBLE AS y FROM md) WHERE x IS NOT NULL AND y IS NOT NULL AND ({LASSO}) % 2 = 1")
