"""Queries that write a file format into the shared folder and read it again; the SQL states what must come back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import features as X
from quillspark.operators import neardup, segment
from quillspark.plans.graph_queries import CUT, NET, cut, net
from quillspark.plans.meta_queries import md
from quillspark.plans.registry import register
from quillspark.plans.text_queries import SENTS
from quillspark.session import shared_dir, written
from quillspark.sources import files
from quillspark.sources.tables import spread, table

docs = lambda s, d: spread(table(s, d, "documents"))
emb = lambda s, d: table(s, d, "embeddings")


def place(s) -> str:
    return f"{shared_dir(s)}/quillspark/files-{uuid.uuid4().hex}"


def line_lists(s, d):
    """The words of each document as a line of a file, read back as lists."""
    at = place(s)
    words = docs(s, d).where("text IS NOT NULL").select(F.concat(F.array(F.col("doc_id").cast("string")), T.words(F.col("text"))).alias("w"))
    files.write_lists(words, "w", at)
    back = files.read_lists(s, at)
    return back.select(F.col("items")[0].cast("long").alias("doc_id"), (F.size("items") - 1).cast("long").alias("n_items"), F.element_at("items", -1).alias("last"))


register("line_lists", line_lists, r"SELECT doc_id, len(w) AS n_items, CASE WHEN len(w) > 0 THEN list_last(w) ELSE doc_id::VARCHAR END AS last FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL)")


def arrays(s, d):
    at = place(s)
    files.write_arrays(emb(s, d).select("vec_id", "embedding"), at)
    return s.read.parquet(at).select("vec_id", F.size("embedding").cast("long").alias("dim"), F.round(F.array_max("embedding").cast("double"), 6).alias("most"))


register("array_file", arrays, "SELECT vec_id, len(embedding) AS dim, round(list_max(embedding)::DOUBLE, 6) AS most FROM embeddings")


def csv_roundtrip(s, d):
    """A table written as CSV with ';' and null as NA, read with the separator sniffed."""
    at = place(s)
    rows = md(s, d).select("text_id", "title", "pub_year", F.round("canon", 6).alias("canon"))
    files.append_csv(rows.where("text_id % 2 = 0"), at, ";")
    files.append_csv(rows.where("text_id % 2 = 1"), at, ";")
    return files.read_csv(s, at, "text_id long, title string, pub_year string, canon double", None)


register("csv_append_read", csv_roundtrip, "SELECT text_id, nullif(title, '') AS title, nullif(pub_year, '') AS pub_year, round(canon, 6) AS canon FROM (SELECT DISTINCT * FROM metadata)")


def csv_skip(s, d):
    """A file with two lines of remarks before its header."""
    at = place(s)
    body = md(s, d).where("file_name IS NOT NULL").select(F.concat_ws("ƒ", F.col("text_id").cast("string"), "file_name").alias("value"))
    head = s.createDataFrame([(0, "# made by a script"), (1, "# two lines to skip"), (2, "text_idƒfile_name")], "o int, value string")
    head.coalesce(1).orderBy("o").select("value").write.mode("overwrite").text(at + "/a")
    body.write.mode("append").text(at + "/a")
    whole = s.read.text(at + "/a").where(~F.col("value").startswith("#") & (F.col("value") != "text_idƒfile_name"))
    sep = files.sniff_separator(s, at + "/a/part-00000*", 2)
    return whole.select(F.split("value", sep).alias("p")).select(F.col("p")[0].cast("long").alias("text_id"), F.col("p")[1].alias("file_name"))


register("csv_skip_rows", csv_skip, "SELECT text_id, file_name FROM (SELECT DISTINCT * FROM metadata) WHERE file_name IS NOT NULL")


def vectors_file(s, d):
    """Vectors in the text format: its head against its rows, dimension and names."""
    at = place(s)
    files.write_word2vec(emb(s, d).select(F.col("vec_id").alias("node"), F.col("embedding").alias("vec")), at)
    return files.read_word2vec(s, at).select(F.col("node").cast("long").alias("vec_id"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


register("word2vec_file", vectors_file, "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")


def vectors_check(s, d):
    """Rows, numbers a row and repeated names of a file of vectors against its head and the nodes of the network."""
    at = place(s)
    nodes = cut(s, d).select(F.col("src").alias("node")).distinct()
    vec = nodes.select(F.translate("node", " ", "_").alias("node"), F.array(F.length("node").cast("double"), F.lit(1.0), F.lit(0.5)).alias("vec"))
    files.write_word2vec(vec, at)
    lines = s.read.text(at).select(F.split("value", " ").alias("p"))
    head = lines.where(F.size("p") == 2).select(F.col("p")[0].cast("long").alias("n_head"), F.col("p")[1].cast("long").alias("dim_head"))
    rows = lines.where(F.size("p") > 2).agg(F.count("*").alias("n_rows"), F.count_distinct(F.col("p")[0]).alias("n_names"), F.min(F.size("p") - 1).cast("long").alias("dim_rows"))
    # tables of one row
    return head.crossJoin(F.broadcast(rows)).crossJoin(F.broadcast(nodes.agg(F.count("*").alias("n_nodes"))))


register("vector_file_check", vectors_check, f"WITH {CUT}, k AS (SELECT count(DISTINCT src) AS n FROM t) SELECT n AS n_head, 3::BIGINT AS dim_head, n AS n_rows, n AS n_names, 3::BIGINT AS dim_rows, n AS n_nodes FROM k")


def graphml(s, d):
    at = place(s)
    files.write_graphml(cut(s, d), at)
    lines = s.read.text(at)
    return lines.agg(F.count_if(F.col("value").startswith("<node ")).alias("n_nodes"), F.count_if(F.col("value").startswith("<edge ")).alias("n_edges"), F.count_if(F.col("value").startswith("<graphml ")).alias("n_heads"))


register("graphml_file", graphml, f"WITH {CUT} SELECT (SELECT count(DISTINCT src) FROM t) AS n_nodes, (SELECT count(*) FROM t) AS n_edges, 1::BIGINT AS n_heads")


def matrix_file(s, d):
    at = place(s)
    files.write_matrix(net(s, d), at)
    return files.read_matrix(s, at)


register("matrix_file", matrix_file, f"WITH {NET} SELECT src, dst, w FROM e UNION ALL SELECT node, node, 1.0 FROM n")


def memo(s, d):
    """A table that is made once: the second reading finds what the first wrote."""
    at = place(s)
    make = lambda: X.centroids(emb(s, d)).select("label", "n")
    files.read_or_create(s, at, make).count()
    return files.read_or_create(s, at, lambda: s.createDataFrame([], "label string, n long")).select("label", "n")


register("memoised_table", memo, "SELECT label, count(*) AS n FROM embeddings GROUP BY label")


def pipeline_file(s, d):
    """A fitted scaler written, read and applied."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    at = place(s)
    rows = written(docs(s, d).where("n_chars IS NOT NULL").select("doc_id", F.col("n_chars").cast("double").alias("n_chars")))
    Pipeline(stages=[VectorAssembler(inputCols=["n_chars"], outputCol="v"), StandardScaler(inputCol="v", outputCol="z", withMean=True)]).fit(rows).write().overwrite().save(at)
    out = PipelineModel.load(at).transform(rows)
    return out.select("doc_id", F.round(vector_to_array("z")[0], 6).alias("z"))


register("saved_pipeline", pipeline_file, "SELECT doc_id, round((n_chars - avg(n_chars) OVER ()) / stddev_samp(n_chars) OVER (), 6) AS z FROM documents WHERE n_chars IS NOT NULL")

RULE_ROWS = "SELECT file_name, substr(title, 1, 5) AS old, CASE WHEN text_id % 3 = 0 THEN '' ELSE upper(substr(title, 1, 5)) END AS new, CAST(text_id % 4 AS STRING) AS priority FROM m WHERE file_name IS NOT NULL AND length(title) >= 5"


def rule_table(s, d):
    """A table of replacements for the texts, written with the separator of such tables and read again."""
    at = place(s)
    m = md(s, d).select("text_id", "file_name", "title")
    rules = m.where("file_name IS NOT NULL AND length(title) >= 5").select("file_name", F.left("title", F.lit(5)).alias("to_replace"), F.when(F.col("text_id") % 3 == 0, "''").otherwise(F.upper(F.left("title", F.lit(5)))).alias("replace_with"), (F.col("text_id") % 4).cast("string").alias("priority"))
    files.append_csv(rules, at, "ƒ")
    return files.read_rules(s, at)


RULES = "m AS (SELECT DISTINCT text_id, file_name, title FROM metadata), ru AS (" + RULE_ROWS.replace("CAST(text_id % 4 AS STRING)", "(text_id % 4)::VARCHAR") + ")"


def rule_file_replace(s, d):
    """Each document of a text with the rules of that text, in the order of their priority."""
    packed = rule_table(s, d).groupBy("file_name").agg(F.sort_array(F.collect_list(F.struct("priority", "old", "new"))).alias("rules"))
    return docs(s, d).join(packed, "file_name", "left").select("doc_id", F.coalesce(T.apply_rules(F.col("text"), F.col("rules")), F.col("text")).alias("text"))


register("rule_table_replace", rule_file_replace, f"WITH {RULES} SELECT doc_id, CASE WHEN old IS NULL THEN text ELSE replace(text, old, new) END AS text FROM documents LEFT JOIN (SELECT file_name, any_value(old) AS old, any_value(new) AS new FROM ru GROUP BY file_name) USING (file_name)")


def rule_checks(s, d):
    """Repeated rules, texts with two rules of a priority or for one word, and rules for texts that are not there."""
    r = written(rule_table(s, d).unionByName(rule_table(s, d).where("priority = '1'")))
    one = lambda kind, x: x.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    many = lambda *keys: r.groupBy(*keys).count().where("count > 1")
    stale = r.join(docs(s, d).where("file_name IS NOT NULL").select("file_name").distinct(), "file_name", "left_anti")
    return one("repeated_row", many("file_name", "old", "new", "priority")).unionByName(one("repeated_word", many("file_name", "old"))).unionByName(one("repeated_priority", many("file_name", "priority"))).unionByName(one("stale_name", stale))


register("rule_file_checks", rule_checks, f"WITH {RULES}, r AS (SELECT * FROM ru UNION ALL SELECT * FROM ru WHERE priority = '1') SELECT 'repeated_row' AS kind, count(*) AS n FROM (SELECT 1 FROM r GROUP BY file_name, old, new, priority HAVING count(*) > 1) UNION ALL SELECT 'repeated_word', count(*) FROM (SELECT 1 FROM r GROUP BY file_name, old HAVING count(*) > 1) UNION ALL SELECT 'repeated_priority', count(*) FROM (SELECT 1 FROM r GROUP BY file_name, priority HAVING count(*) > 1) UNION ALL SELECT 'stale_name', count(*) FROM r WHERE file_name NOT IN (SELECT file_name FROM documents WHERE file_name IS NOT NULL)")


def mined_rules(s, d):
    """Replacement calls in lines of code, as rules with a running priority."""
    from quillspark.operators.numbering import numbered

    code = docs(s, d).where("file_name IS NOT NULL").select("doc_id", F.concat(F.lit("text = text.replace('"), F.col("source"), F.lit("', '"), F.coalesce("lang", F.lit("")), F.lit("')")).alias("line")).where("line IS NOT NULL")
    pat = r"\.replace\('([^']*)', *'([^']*)'\)"
    hit = code.where(F.col("line").rlike(pat)).select("doc_id", F.regexp_extract("line", pat, 1).alias("old"), F.regexp_extract("line", pat, 2).alias("new"))
    return numbered(hit, "priority", "doc_id")


register("mined_rules", mined_rules, "SELECT doc_id, source AS old, coalesce(lang, '') AS new, row_number() OVER (ORDER BY doc_id) - 1 AS priority FROM documents WHERE file_name IS NOT NULL AND source IS NOT NULL")


def fuzzy_sentences(s, d):
    """Sentences that are nearly the same, anywhere in the corpus: classes by a Jaccard similarity of 0.8 on runs of five words."""
    sents = segment.sentence_rows(docs(s, d)).select((F.col("doc_id") * 100000 + F.col("sent_idx")).alias("sent_id"), F.col("sentence").alias("text"))
    return neardup.classes(sents, "sent_id").where("class_id <> sent_id OR n_links > 0")


register("fuzzy_sentences", fuzzy_sentences, rf"""WITH RECURSIVE sx AS (SELECT doc_id * 100000 + sent_idx AS id, regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}_]+') AS w FROM ({SENTS})),
g AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], '-'))) AS g FROM sx), n AS (SELECT id, count(*) AS n, md5(string_agg(g, ',' ORDER BY g)) AS h FROM g GROUP BY id),
r AS (SELECT h, min(id) AS rep, any_value(n) AS n FROM n GROUP BY h), gr AS (SELECT rep, g FROM g JOIN r ON g.id = r.rep),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM gr a JOIN gr b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep),
l AS (SELECT a, b FROM p JOIN r x ON x.rep = a JOIN r y ON y.rep = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9), u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
z AS (SELECT rep AS node, rep AS hit FROM r UNION SELECT z.node, u.b FROM z JOIN u ON u.a = z.hit), k AS (SELECT node, min(hit) AS class_id FROM z GROUP BY node)
SELECT n.id AS sent_id, class_id, coalesce((SELECT count(*) FROM u WHERE u.a = r.rep), 0) AS n_links FROM n JOIN r USING (h) JOIN k ON k.node = r.rep WHERE class_id <> n.id OR n_links > 0""")
