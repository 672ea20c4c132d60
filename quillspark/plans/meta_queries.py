"""Queries of metadata, labels, statistics and validation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.operators import metadata as M
from quillspark.operators import validation as P
from quillspark.plans.ngram_queries import FCOLS
from quillspark.plans.registry import register
from quillspark.session import written
from quillspark.sources.tables import table

md = lambda s, d: table(s, d, "metadata").distinct()
docs = lambda s, d: table(s, d, "documents")
MD = "md AS (SELECT DISTINCT * FROM metadata)"
FA = "array_to_string(string_split(file_name, '_')[1:2], '_')"
YEAR = "list_min(list_transform(regexp_extract_all(pub_year, '[0-9]{4}'), lambda x: x::INT))"
fa = lambda: M.file_author(F.col("file_name"))
yr = lambda: M.year(F.col("pub_year"))

register("texts_per_author", lambda s, d: md(s, d).where("file_name IS NOT NULL").groupBy(fa().alias("author")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("title")), "|").alias("titles")), f"WITH {MD} SELECT {FA} AS author, count(*) AS n, coalesce(string_agg(title, '|' ORDER BY title), '') AS titles FROM md WHERE file_name IS NOT NULL GROUP BY 1")
register("author_concat", lambda s, d: md(s, d).withColumn("y", yr()).where("y IS NOT NULL").groupBy(fa().alias("author")).agg(F.concat(F.first(fa()), F.lit("_all_"), F.bround(F.avg("y")).cast("int").cast("string")).alias("name"), F.count("*").alias("n")), f"WITH {MD} SELECT {FA} AS author, {FA} || '_all_' || round_even(avg({YEAR}), 0)::INT AS name, count(*) AS n FROM md WHERE {YEAR} IS NOT NULL GROUP BY 1")


def lookup(s, d):
    """Each text with the gender of its author: that of any of the author's records, women as f, nobody as a."""
    g = md(s, d).where("gender IS NOT NULL").groupBy(fa().alias("author")).agg(F.min(F.expr("CASE WHEN gender = 'w' THEN 'f' ELSE gender END")).alias("g"))
    t = md(s, d).select("text_id", fa().alias("author"))
    return M.checked_join(t, g, ["author"], "left", "many_to_one").select("text_id", F.coalesce("g", F.lit("a")).alias("gender"))


register("left_join_lookup", lookup, f"WITH {MD}, g AS (SELECT {FA} AS author, min(CASE WHEN gender = 'w' THEN 'f' ELSE gender END) AS g FROM md WHERE gender IS NOT NULL GROUP BY 1) SELECT text_id, coalesce(g, 'a') AS gender FROM (SELECT text_id, {FA} AS author FROM md) LEFT JOIN g USING (author)")
register("semi_join_filter", lambda s, d: md(s, d).join(docs(s, d), "file_name", "left_semi").select("text_id", F.round("canon", 6).alias("canon")), f"WITH {MD} SELECT text_id, round(canon, 6) AS canon FROM md WHERE file_name IN (SELECT file_name FROM documents)")
register("full_outer_check", lambda s, d: md(s, d).select("text_id", F.lit(1).alias("m")).join(table(s, d, "text_raw").select("text_id", F.lit(1).alias("t")).distinct(), "text_id", "full").groupBy(F.col("m").isNotNull().alias("in_metadata"), F.col("t").isNotNull().alias("in_text")).agg(F.count("*").alias("n")), f"WITH {MD}, t AS (SELECT DISTINCT text_id AS t FROM text_raw) SELECT text_id IS NOT NULL AS in_metadata, t IS NOT NULL AS in_text, count(*) AS n FROM md FULL JOIN t ON text_id = t GROUP BY ALL")


def set_ops(s, d):
    a, b = md(s, d).select("file_name").distinct(), docs(s, d).where("file_name IS NOT NULL").select("file_name").distinct()
    one = lambda k, x: x.agg(F.count("*").alias("n")).select(F.lit(k).alias("op"), "n")
    return one("intersect", a.intersect(b)).unionByName(one("left_only", a.exceptAll(b))).unionByName(one("right_only", b.exceptAll(a))).unionByName(one("union", a.union(b).distinct()))


register("set_ops", set_ops, "WITH a AS (SELECT DISTINCT file_name FROM metadata), b AS (SELECT DISTINCT file_name FROM documents WHERE file_name IS NOT NULL) SELECT 'intersect' AS op, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS n UNION ALL SELECT 'left_only', (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) UNION ALL SELECT 'right_only', (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) UNION ALL SELECT 'union', (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b))")
register("duplicate_keys", lambda s, d: table(s, d, "features").groupBy("text_id").agg(F.count("*").alias("n")).where("n > 1"), "SELECT text_id, count(*) AS n FROM features GROUP BY text_id HAVING count(*) > 1")
register("year_parse", lambda s, d: md(s, d).select("text_id", yr().cast("long").alias("year"), (yr() == F.right("file_name", F.lit(4)).cast("int")).alias("as_in_name")), f"WITH {MD} SELECT text_id, {YEAR}::BIGINT AS year, {YEAR} = right(file_name, 4)::INT AS as_in_name FROM md")
register("viaf_clean", lambda s, d: md(s, d).where("author_viaf IS NOT NULL").select("text_id", F.regexp_replace("author_viaf", r"\s+", "").alias("viaf")), rf"WITH {MD} SELECT text_id, regexp_replace(author_viaf, '\s+', '', 'g') AS viaf FROM md WHERE author_viaf IS NOT NULL")
register("ordinal_bins", lambda s, d: md(s, d).select("text_id", M.ordinal(F.col("canon"), 0.333, 0.666).cast("long").alias("canon_cat"), M.ordinal(yr(), 1800, 1850, 1900).cast("long").alias("year_cat")), f"WITH {MD} SELECT text_id, CASE WHEN canon IS NULL THEN NULL WHEN canon < 0.333 THEN 0 WHEN canon < 0.666 THEN 1 ELSE 2 END AS canon_cat, CASE WHEN {YEAR} IS NULL THEN NULL WHEN {YEAR} < 1800 THEN 0 WHEN {YEAR} < 1850 THEN 1 WHEN {YEAR} < 1900 THEN 2 ELSE 3 END AS year_cat FROM md")
CUR = "cu AS (SELECT text_id, comma_rate_full, verb_share_full FROM features QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY computed_at DESC, comma_rate_full DESC, verb_share_full DESC) = 1)"


def current(s, d):
    x = table(s, d, "features").groupBy("text_id").agg(F.max(F.struct("computed_at", "comma_rate_full", "verb_share_full")).alias("m"))
    return x.select("text_id", "m.comma_rate_full", "m.verb_share_full")


register("metadata_join", lambda s, d: md(s, d).select("text_id", "canon", yr().alias("year"), F.expr("CASE gender WHEN 'm' THEN 0 WHEN 'f' THEN 1 WHEN 'w' THEN 1 WHEN 'a' THEN 2 WHEN 'b' THEN 3 END").alias("gender")).join(current(s, d), "text_id").select("text_id", F.round("canon", 6).alias("canon"), F.col("year").cast("long").alias("year"), F.col("gender").cast("long").alias("gender"), "comma_rate_full", "verb_share_full"), f"WITH {MD}, {CUR} SELECT text_id, round(canon, 6) AS canon, {YEAR}::BIGINT AS year, CASE gender WHEN 'm' THEN 0 WHEN 'f' THEN 1 WHEN 'w' THEN 1 WHEN 'a' THEN 2 WHEN 'b' THEN 3 END AS gender, comma_rate_full, verb_share_full FROM md JOIN cu USING (text_id)")
register("group_number", lambda s, d: M.group_numbers(md(s, d).where("gender IS NOT NULL AND lang IS NOT NULL"), ["gender", "lang"]).select("gender", "lang", F.col("group").cast("long").alias("group")), f"WITH {MD} SELECT DISTINCT gender, lang, dense_rank() OVER (ORDER BY gender, lang) - 1 AS \"group\" FROM md WHERE gender IS NOT NULL AND lang IS NOT NULL")
register("skew_flag", lambda s, d: docs(s, d).groupBy("lang").agg(F.round(F.skewness("n_chars"), 4).alias("skew"), (F.skewness("n_chars") >= 3).alias("skewed")), "SELECT lang, round(avg(pow(n_chars - m, 3)) / pow(avg(pow(n_chars - m, 2)), 1.5), 4) AS skew, avg(pow(n_chars - m, 3)) / pow(avg(pow(n_chars - m, 2)), 1.5) >= 3 AS skewed FROM (SELECT lang, n_chars, avg(n_chars) OVER (PARTITION BY lang) AS m FROM documents) GROUP BY lang")
register("binary_label", lambda s, d: md(s, d).join(docs(s, d).where("file_name IS NOT NULL").groupBy("file_name").agg(F.count("*").alias("n")), "file_name", "left").select("text_id", F.when(F.coalesce("n", F.lit(0)) != 0, 1).otherwise(0).cast("long").alias("label")), f"WITH {MD} SELECT text_id, CASE WHEN file_name IN (SELECT file_name FROM documents WHERE file_name IS NOT NULL) THEN 1 ELSE 0 END AS label FROM md")


def combined(s, d):
    """A text's label from two scores: short excerpts only, long ones only, or the mean of both."""
    x = docs(s, d).where("file_name IS NOT NULL AND n_chars IS NOT NULL")
    a = x.where("n_chars >= 1000").groupBy("file_name").agg(F.avg("n_chars").alias("a"))
    b = x.where("n_chars < 1000").groupBy("file_name").agg(F.avg("n_chars").alias("b"))
    return a.join(b, "file_name", "full").select("file_name", F.round(F.when(F.col("b").isNull(), F.col("a")).when(F.col("a").isNull(), F.col("b")).otherwise((F.col("a") + F.col("b")) / 2), 4).alias("label"))


register("label_combined", combined, "WITH a AS (SELECT file_name, avg(n_chars) AS a FROM documents WHERE n_chars >= 1000 AND file_name IS NOT NULL GROUP BY 1), b AS (SELECT file_name, avg(n_chars) AS b FROM documents WHERE n_chars < 1000 AND file_name IS NOT NULL GROUP BY 1) SELECT file_name, round(CASE WHEN b IS NULL THEN a WHEN a IS NULL THEN b ELSE (a + b) / 2 END, 4) AS label FROM a FULL JOIN b USING (file_name)")


def majority(s, d):
    """The most frequent language of each source, the later of equals; sources with all four languages left out."""
    c = docs(s, d).where("source IS NOT NULL AND lang IS NOT NULL").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return c.groupBy("source").agg(F.max(F.struct("n", "lang")).alias("m"), F.count("*").alias("k")).where("k < 4").select("source", F.col("m.lang").alias("label"), F.col("m.n").alias("n"))


register("label_majority", majority, "WITH c AS (SELECT source, lang, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY ALL) SELECT source, lang AS label, n FROM c WHERE source IN (SELECT source FROM c GROUP BY source HAVING count(*) < 4) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang DESC) = 1")
register("range_filter", lambda s, d: md(s, d).where(((F.col("lang") == "eng") & yr().between(1771, 1914)) | ((F.col("lang") == "ger") & yr().between(1785, 1915))).select("text_id", yr().cast("long").alias("year")), f"WITH {MD} SELECT text_id, {YEAR}::BIGINT AS year FROM md WHERE (lang = 'eng' AND {YEAR} BETWEEN 1771 AND 1914) OR (lang = 'ger' AND {YEAR} BETWEEN 1785 AND 1915)")
register("upsample", lambda s, d: M.upsample(table(s, d, "embeddings").select("vec_id", "label"), "label", "vec_id").select("label", "vec_id", F.col("copy").cast("long").alias("copy")), "WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), r AS (SELECT label, vec_id, n, max(n) OVER () AS m, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings JOIN n USING (label)) SELECT label, vec_id, unnest(range(1, (m // n + CASE WHEN r <= m % n THEN 1 ELSE 0 END + 1)::BIGINT)) AS copy FROM r")
register("group_means", lambda s, d: md(s, d).withColumn("y", yr()).groupBy("gender", "lang").agg(F.round(F.avg("canon"), 6).alias("canon"), F.round(F.avg("y"), 3).alias("year"), F.count("*").alias("n")), f"WITH {MD} SELECT gender, lang, round(avg(canon), 6) AS canon, round(avg({YEAR}), 3) AS year, count(*) AS n FROM md GROUP BY gender, lang")
register("spearman", lambda s, d: M.spearman(md(s, d).withColumn("y", yr()), "canon", "y", "lang"), f"WITH {MD}, r AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY canon) + (count(*) OVER (PARTITION BY lang, canon) - 1) / 2 AS rx, rank() OVER (PARTITION BY lang ORDER BY y) + (count(*) OVER (PARTITION BY lang, y) - 1) / 2 AS ry FROM (SELECT lang, canon, {YEAR} AS y FROM md) WHERE canon IS NOT NULL AND y IS NOT NULL AND lang IS NOT NULL) SELECT lang, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM r GROUP BY lang")
register("linregress", lambda s, d: md(s, d).withColumn("y", yr().cast("double")).where("canon IS NOT NULL AND y IS NOT NULL").groupBy("lang").agg(F.round(F.regr_slope("canon", "y"), 8).alias("slope"), F.round(F.regr_intercept("canon", "y"), 6).alias("intercept"), F.round(F.regr_r2("canon", "y"), 6).alias("r2"), F.count("*").alias("n")), f"WITH {MD} SELECT lang, round(regr_slope(canon, {YEAR}), 8) AS slope, round(regr_intercept(canon, {YEAR}), 6) AS intercept, round(regr_r2(canon, {YEAR}), 6) AS r2, count(*) AS n FROM md WHERE canon IS NOT NULL AND {YEAR} IS NOT NULL GROUP BY lang")
register("histogram10", lambda s, d: md(s, d).where("canon IS NOT NULL").groupBy(F.least(F.floor(F.col("canon") * 10), F.lit(9)).cast("long").alias("bin")).agg(F.count("*").alias("n")), f"WITH {MD} SELECT least(floor(canon * 10), 9)::BIGINT AS bin, count(*) AS n FROM md WHERE canon IS NOT NULL GROUP BY 1")
register("metadata_stats", lambda s, d: md(s, d).withColumn("y", yr()).groupBy("gender").agg(F.count("*").alias("n"), F.count_distinct(fa()).alias("authors"), F.min("y").cast("long").alias("first_year"), F.max("y").cast("long").alias("last_year")), f"WITH {MD} SELECT gender, count(*) AS n, count(DISTINCT {FA}) AS authors, min({YEAR})::BIGINT AS first_year, max({YEAR})::BIGINT AS last_year FROM md GROUP BY gender")
register("longest_shortest", lambda s, d: docs(s, d).where("n_chars IS NOT NULL").groupBy("lang").agg(F.min(F.struct("n_chars", "doc_id"))["doc_id"].alias("shortest"), F.max(F.struct("n_chars", "doc_id"))["doc_id"].alias("longest"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most")), "SELECT lang, (list(doc_id ORDER BY n_chars, doc_id))[1] AS shortest, (list(doc_id ORDER BY n_chars DESC, doc_id DESC))[1] AS longest, min(n_chars) AS least, max(n_chars) AS most FROM documents WHERE n_chars IS NOT NULL GROUP BY lang")
register("variance_per_author", lambda s, d: md(s, d).where("canon IS NOT NULL").groupBy(fa().alias("author")).agg(F.count("*").alias("n"), F.round(F.avg("canon"), 6).alias("mean"), F.round(F.stddev_samp("canon"), 6).alias("std"), F.round(F.max("canon") - F.min("canon"), 6).alias("spread")).where("n >= 2"), f"WITH {MD} SELECT {FA} AS author, count(*) AS n, round(avg(canon), 6) AS mean, round(stddev_samp(canon), 6) AS std, round(max(canon) - min(canon), 6) AS spread FROM md WHERE canon IS NOT NULL GROUP BY 1 HAVING count(*) >= 2")
register("tie_offset", lambda s, d: md(s, d).where("canon IS NOT NULL").withColumn("r", F.row_number().over(Window.partitionBy("canon", "pub_year").orderBy("text_id"))).select("text_id", F.round(F.col("canon") + 0.1 * (F.col("r") - 1), 6).alias("shifted")), f"WITH {MD} SELECT text_id, round(canon + 0.1 * (row_number() OVER (PARTITION BY canon, pub_year ORDER BY text_id) - 1), 6) AS shifted FROM md WHERE canon IS NOT NULL")
register("crosstab_binned", lambda s, d: md(s, d).withColumn("y", yr()).where("y IS NOT NULL AND canon IS NOT NULL").groupBy(F.ceil(F.col("y") / 50).cast("long").alias("half_century"), F.least(F.floor(F.col("canon") * 5), F.lit(4)).cast("long").alias("canon_bin")).agg(F.count("*").alias("n")), f"WITH {MD} SELECT ceil({YEAR} / 50)::BIGINT AS half_century, least(floor(canon * 5), 4)::BIGINT AS canon_bin, count(*) AS n FROM md WHERE {YEAR} IS NOT NULL AND canon IS NOT NULL GROUP BY 1, 2")


def author_names(s, d):
    """The spellings of authors in file names, and their letters without accents."""
    ascii_ = lambda c: F.regexp_replace(F.translate(c, "äöüÄÖÜßé", "aouAOUse"), r"[^\x00-\x7f]", "?")
    return md(s, d).where("file_name IS NOT NULL").select(fa().alias("name")).distinct().withColumn("a", ascii_(F.col("name")))


ASC = f"regexp_replace(translate({FA}, 'äöüÄÖÜßé', 'aouAOUse'), '[^\\x00-\\x7f]', '?', 'g')"
register("levenshtein_match", lambda s, d: M.closest_names(author_names(s, d)), f"WITH n AS (SELECT DISTINCT {FA} AS name, {ASC} AS a FROM metadata WHERE file_name IS NOT NULL), p AS (SELECT x.name, y.name AS other, levenshtein(x.a, y.a) AS dist FROM n x JOIN n y ON x.name <> y.name AND abs(length(x.a) - length(y.a)) <= 4) SELECT name, other, dist FROM p WHERE dist <= 4 QUALIFY row_number() OVER (PARTITION BY name ORDER BY dist, other) = 1")


# labels and validation
def xy(s, d):
    return current(s, d).where("comma_rate_full IS NOT NULL AND verb_share_full IS NOT NULL").join(md(s, d).where("canon IS NOT NULL").select("text_id", "canon"), "text_id")


XY = f"{MD}, {CUR}, xy AS (SELECT text_id, comma_rate_full, verb_share_full, canon FROM cu JOIN md USING (text_id) WHERE comma_rate_full IS NOT NULL AND verb_share_full IS NOT NULL AND canon IS NOT NULL)"


def full_xy(s, d):
    """All features of the current rows, impossible values as null, with the score to predict."""
    f = table(s, d, "features").groupBy("text_id").agg(F.max(F.struct("computed_at", *FCOLS)).alias("m")).select("text_id", *[F.when(F.col(f"m.{c}") >= 0, F.col(f"m.{c}")).alias(c) for c in FCOLS])
    return f.join(md(s, d).where("canon IS NOT NULL").select("text_id", "canon"), "text_id")


FULL_XY = f"{MD}, fc AS (SELECT text_id, {', '.join(f'CASE WHEN {c} >= 0 THEN {c} END AS {c}' for c in FCOLS)} FROM features QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY computed_at DESC, {', '.join(f'{c} DESC' for c in FCOLS)}) = 1), fx AS (SELECT fc.*, canon FROM fc JOIN md USING (text_id) WHERE canon IS NOT NULL)"
register("xy_assembly", full_xy, f"WITH {FULL_XY} SELECT * FROM fx")


def scaled(s, d):
    x = written(full_xy(s, d))
    ends = x.agg(*[F.avg(c).alias(f"_m_{c}") for c in FCOLS], *[F.stddev_samp(c).alias(f"_s_{c}") for c in FCOLS])
    # one row is broadcast
    return x.crossJoin(F.broadcast(ends)).select("text_id", *[F.round((F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), 5).alias(c) for c in FCOLS])


register("standard_scaled", scaled, f"WITH {FULL_XY} SELECT text_id, {', '.join(f'round(({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0), 5) AS {c}' for c in FCOLS)} FROM fx")
register("regression_metrics", lambda s, d: P.regression_metrics(xy(s, d).where("verb_share_full > 0").withColumn("p", F.col("verb_share_full") * 3), "canon", "p"), f"WITH {XY}, e AS (SELECT canon AS y, verb_share_full * 3 AS p FROM xy WHERE verb_share_full > 0) SELECT round(corr(y, p), 6) AS r, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(sum((y - p) * (y - p)) / count(*)), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae, count(*) AS n FROM e")
PRED = "SELECT lang AS y, CASE WHEN n_chars < 600 THEN 'de' WHEN n_chars < 2500 THEN 'en' ELSE 'fr' END AS p FROM documents WHERE lang IS NOT NULL AND n_chars IS NOT NULL"
pred = lambda s, d: docs(s, d).where("lang IS NOT NULL AND n_chars IS NOT NULL").select(F.col("lang").alias("y"), F.expr("CASE WHEN n_chars < 600 THEN 'de' WHEN n_chars < 2500 THEN 'en' ELSE 'fr' END").alias("p"))
register("classification_metrics", lambda s, d: P.classification_metrics(pred(s, d), "y", "p"), f"WITH c AS (SELECT y, p, count(*) AS n FROM ({PRED}) GROUP BY ALL), m AS (SELECT k, coalesce(t, 0) AS t, coalesce(q, 0) AS q, coalesce(h, 0) AS h FROM (SELECT y AS k, sum(n) AS t FROM c GROUP BY y) FULL JOIN (SELECT p AS k, sum(n) AS q FROM c GROUP BY p) USING (k) LEFT JOIN (SELECT y AS k, n AS h FROM c WHERE y = p) USING (k)) SELECT round(sum(h) / sum(t), 6) AS acc, round(avg(CASE WHEN t > 0 THEN h / t END), 6) AS balanced_acc, round(avg(2 * h / (t + q)), 6) AS f1_macro, round(sum(2 * h / (t + q) * t) / sum(t), 6) AS f1_weighted FROM m")
register("confusion_margins", lambda s, d: pred(s, d).cube("y", "p").agg(F.count("*").alias("n")).select(F.coalesce("y", F.lit("all")).alias("y"), F.coalesce("p", F.lit("all")).alias("p"), "n"), f"SELECT coalesce(y, 'all') AS y, coalesce(p, 'all') AS p, count(*) AS n FROM ({PRED}) GROUP BY CUBE (y, p)")
register("baseline_all0", lambda s, d: pred(s, d).agg(F.round(F.avg((F.col("y") == "en").cast("double")), 6).alias("acc")), f"SELECT round(avg(CASE WHEN y = 'en' THEN 1.0 ELSE 0.0 END), 6) AS acc FROM ({PRED})")
register("harmonic_p", lambda s, d: P.harmonic_p(table(s, d, "eval_cat").distinct().where("nmi IS NOT NULL").withColumn("p", F.abs("nmi")), "p", "mxname"), "SELECT mxname, round(CASE WHEN min(abs(nmi)) = 0 THEN 0 ELSE count(nmi) / sum(1 / nullif(abs(nmi), 0)) END, 6) AS harmonic_p FROM (SELECT DISTINCT * FROM eval_cat) WHERE nmi IS NOT NULL GROUP BY mxname")
register("balanced_weights", lambda s, d: P.balanced_weights(docs(s, d), "lang"), "SELECT lang, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang)")


def best_model(s, d):
    """The run with the best mean nmi among those with a small ari spread, or else the best of all."""
    e = table(s, d, "eval_cat").distinct().where("nmi IS NOT NULL").groupBy("run_id").agg(F.round(F.avg("nmi"), 9).alias("m"), F.round(F.avg(F.abs("ari")), 9).alias("p"))
    good = e.agg(F.max(F.when(F.col("p") < 0.1, F.struct("m", "run_id"))).alias("g"), F.max(F.struct("m", "run_id")).alias("o"))
    return good.select(F.coalesce("g", "o")["run_id"].alias("run_id"))


register("select_best_model", best_model, "WITH e AS (SELECT run_id, round(avg(nmi), 9) AS m, round(avg(abs(ari)), 9) AS p FROM (SELECT DISTINCT * FROM eval_cat) WHERE nmi IS NOT NULL GROUP BY run_id) SELECT run_id FROM e ORDER BY CASE WHEN p < 0.1 THEN 0 ELSE 1 END, m DESC, run_id DESC LIMIT 1")
register("best_feature_level", lambda s, d: table(s, d, "eval_cat").distinct().where("nmi IS NOT NULL").groupBy("mxname", "attr").agg(F.max("nmi").alias("best")).groupBy("attr").agg(F.round(F.avg("best"), 6).alias("mean_best")), "SELECT attr, round(avg(best), 6) AS mean_best FROM (SELECT mxname, attr, max(nmi) AS best FROM eval_cat WHERE nmi IS NOT NULL GROUP BY mxname, attr) GROUP BY attr")
register("unlabeled_docs", lambda s, d: docs(s, d).join(md(s, d).where("canon IS NOT NULL").select("file_name"), "file_name", "left_anti").select("doc_id"), "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM metadata m WHERE m.file_name = d.file_name AND canon IS NOT NULL)")
register("embedding_completeness", lambda s, d: table(s, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.size("embedding") == 64).alias("full"), F.count_distinct("vec_id").alias("ids")), "SELECT label, count(*) AS n, count(*) FILTER (WHERE len(embedding) = 64) AS \"full\", count(DISTINCT vec_id) AS ids FROM embeddings GROUP BY label")
