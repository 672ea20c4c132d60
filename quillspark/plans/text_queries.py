"""Queries of reading, cleaning and segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import segment
from quillspark.plans.registry import register
from quillspark.sources.tables import spread, table

docs = lambda s, d: spread(table(s, d, "documents"))
LINES = "string_split(text, chr(10))"
WS = r"[ \t\n\r\f]+"

register("scan_documents", lambda s, d: table(s, d, "documents").select("doc_id", "lang", "source", F.length("text").cast("long").alias("n_chars")), "SELECT doc_id, lang, source, length(text) AS n_chars FROM documents")
register("docs_by_length", lambda s, d: docs(s, d).select("doc_id", F.coalesce(F.size(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\f]+"), F.lit(0))), F.lit(0)).cast("long").alias("n_tokens")).select("doc_id", F.greatest("n_tokens", F.lit(0)).alias("n_tokens")).orderBy("n_tokens", "doc_id"), r"SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^ \t\n\r\f]+')), 0) AS n_tokens FROM documents")
register("file_stem_parts", lambda s, d: table(s, d, "metadata").distinct().select("text_id", F.regexp_extract(F.concat(F.lit("text_raw/"), "lang", F.lit("/"), "file_name", F.lit(".txt")), r"([^/]+)\.[^.]*$", 1).alias("stem")), r"SELECT text_id, regexp_extract('text_raw/' || lang || '/' || file_name || '.txt', '([^/]+)\.[^.]*$', 1) AS stem FROM (SELECT DISTINCT * FROM metadata)")
register("scan_embeddings", lambda s, d: table(s, d, "embeddings").select("vec_id", "label", F.size("embedding").cast("long").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("sq_norm")), "SELECT vec_id, label, len(embedding) AS dim, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS sq_norm FROM embeddings")
register("grep_lines", lambda s, d: docs(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.lower("line").rlike(r"(^|[^a-z])(table|list|index)([^a-z]|$)")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line"), rf"SELECT doc_id, i - 1 AS line_no, l AS line FROM (SELECT doc_id, {LINES} AS ls, unnest(range(1, len({LINES}) + 1)) AS i, unnest({LINES}) AS l FROM documents) WHERE regexp_matches(lower(l), '(^|[^a-z])(table|list|index)([^a-z]|$)')")

SQL_CLEAN = f"""trim(regexp_replace(regexp_replace(regexp_replace(translate(translate(regexp_replace(text, '<U\\+[0-9A-F]+>', '', 'g'),
 '{T.CHARS_FROM.replace("'", "''")}', '{T.CHARS_TO.replace("'", "''")}'), '{T.ACCENTS_FROM}', '{T.ACCENTS_TO}'), '[^{T.ALLOWED.replace("'", "''")}]', ' ', 'g'),
 '[0-9]+([,''.][0-9]+)*', '{T.NUMBER_TAG}', 'g'), '{WS}', ' ', 'g'), ' ')"""
register("clean_text", lambda s, d: docs(s, d).select("doc_id", T.clean(F.col("text")).alias("clean")), f"SELECT doc_id, {SQL_CLEAN} AS clean FROM documents")
register("char_normalise", lambda s, d: docs(s, d).select("doc_id", T.normalise_chars(F.col("text")).alias("text")), f"SELECT doc_id, translate(text, '{T.CHARS_FROM}', '{T.CHARS_TO.replace(chr(39), chr(39) * 2)}') AS text FROM documents")
register("strip_accents_keep_umlaut", lambda s, d: docs(s, d).select("doc_id", T.strip_accents(F.col("text")).alias("text")), f"SELECT doc_id, translate(text, '{T.ACCENTS_FROM}', '{T.ACCENTS_TO}') AS text FROM documents")
register("number_tag", lambda s, d: docs(s, d).select("doc_id", T.number_tag(F.col("text")).alias("text")), f"SELECT doc_id, regexp_replace(text, '[0-9]+([,''.][0-9]+)*', '{T.NUMBER_TAG}', 'g') AS text FROM documents")
register("bracket_strip", lambda s, d: docs(s, d).select("doc_id", F.regexp_replace(F.regexp_replace("text", r"\[[^\]]*\]", ""), r"\{[^}]*\}", "").alias("text")), r"SELECT doc_id, regexp_replace(regexp_replace(text, '\[[^\]]*\]', '', 'g'), '\{[^}]*\}', '', 'g') AS text FROM documents")
register("strip_punct_lower", lambda s, d: docs(s, d).select("doc_id", F.lower(T.drop_chars(F.col("text"), ".,;:!?\"'’‘—“”–()[]«»")).alias("text")), "SELECT doc_id, lower(translate(text, '.,;:!?\"''’‘—“”–()[]«»', '')) AS text FROM documents")


def rule_replace(s, d):
    """Literal rules in the order of their priority, read as text; each document has the rules of its language."""
    rules = s.createDataFrame([("en", "the", "THE", "1"), ("en", "THE ", "the ", "10"), ("en", "and", "&", "2"), ("de", "ß", "ss", "1"), ("de", "der ", "", "0"), ("fr", "é", "e", "3"), ("es", "ñ", "n", "3")], "lang string, old string, new string, priority string")
    packed = rules.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("priority", "old", "new"))).alias("rules"))
    # the rule table is this constant of seven rows
    return docs(s, d).join(F.broadcast(packed), "lang", "left").select("doc_id", F.coalesce(T.apply_rules(F.col("text"), F.col("rules")), F.col("text")).alias("text"))


register("rule_replace", rule_replace, "SELECT doc_id, CASE lang WHEN 'en' THEN replace(replace(replace(text, 'the', 'THE'), 'THE ', 'the '), 'and', '&') WHEN 'de' THEN replace(replace(text, 'der ', ''), 'ß', 'ss') WHEN 'fr' THEN replace(text, 'é', 'e') WHEN 'es' THEN replace(text, 'ñ', 'n') ELSE text END AS text FROM documents")


def rule_table_qa(s, d):
    """Values that two texts of the corpus share where they should differ: file names and ids, as the rule table's checks."""
    m = table(s, d, "metadata")
    rows = m.groupBy(*m.columns).count().where("count > 1").agg(F.count("*").alias("n")).withColumn("kind", F.lit("duplicate_row"))
    ids = m.distinct().groupBy("text_id").count().where("count > 1").agg(F.count("*").alias("n")).withColumn("kind", F.lit("duplicate_key"))
    titles = m.distinct().groupBy("author", "title").count().where("count > 1").agg(F.count("*").alias("n")).withColumn("kind", F.lit("duplicate_pair"))
    stale = docs(s, d).where("file_name IS NOT NULL").join(m, "file_name", "left_anti").agg(F.count("*").alias("n")).withColumn("kind", F.lit("stale_name"))
    return rows.unionByName(ids).unionByName(titles).unionByName(stale)


register("rule_table_qa", rule_table_qa, """
SELECT 'duplicate_row' AS kind, count(*) AS n FROM (SELECT count(*) FROM metadata GROUP BY ALL, text_id, file_name, author, author_viaf, title, pub_year, lang, gender, canon, source_vol, ingested_at HAVING count(*) > 1)
UNION ALL SELECT 'duplicate_key', count(*) FROM (SELECT text_id FROM (SELECT DISTINCT * FROM metadata) GROUP BY text_id HAVING count(*) > 1)
UNION ALL SELECT 'duplicate_pair', count(*) FROM (SELECT author, title FROM (SELECT DISTINCT * FROM metadata) GROUP BY author, title HAVING count(*) > 1)
UNION ALL SELECT 'stale_name', count(*) FROM documents WHERE file_name IS NOT NULL AND file_name NOT IN (SELECT file_name FROM metadata WHERE file_name IS NOT NULL)""".replace("GROUP BY ALL, text_id", "GROUP BY text_id"))
register("regex_audit", lambda s, d: docs(s, d).select("doc_id", F.regexp_extract_all("text", F.lit(r"“[^”]*”"), F.lit(0)).alias("hits")).select("doc_id", F.greatest(F.size("hits"), F.lit(0)).cast("long").alias("n_hits"), F.greatest(F.size(F.filter("hits", lambda h: F.length(h) > 80)), F.lit(0)).cast("long").alias("n_long")), "SELECT doc_id, coalesce(len(h), 0) AS n_hits, coalesce(len(list_filter(h, lambda x: length(x) > 80)), 0) AS n_long FROM (SELECT doc_id, regexp_extract_all(text, '“[^”]*”') AS h FROM documents)")


def keyword_context(s, d):
    """Each word of a list with its place in the lower-case text and 20 characters on either side."""
    words = ["note", "chapter", "kapitel", "volume", "heroine"]
    low = docs(s, d).select("doc_id", F.lower("text").alias("t"))
    rows = low.select("doc_id", "t", F.explode(F.array(*map(F.lit, words))).alias("word")).withColumn("pos", F.instr(F.col("t"), F.col("word")))
    start = F.greatest(F.col("pos") - 20, F.lit(1))
    return rows.where("pos > 0").select("doc_id", "word", F.col("pos").cast("long").alias("pos"), F.substring("t", start, F.col("pos") - start + F.length("word") + 20).alias("context"))


register("keyword_context", keyword_context, "SELECT doc_id, word, pos, substring(t, greatest(pos - 20, 1), pos - greatest(pos - 20, 1) + length(word) + 20) AS context FROM (SELECT doc_id, t, word, instr(t, word) AS pos FROM (SELECT doc_id, lower(text) AS t FROM documents), (VALUES ('note'), ('chapter'), ('kapitel'), ('volume'), ('heroine')) v(word)) WHERE pos > 0")
register("special_chars", lambda s, d: docs(s, d).select(F.explode(F.regexp_extract_all("text", F.lit(f"[^{T.ALLOWED}]"), F.lit(0))).alias("ch")).groupBy("ch").agg(F.count("*").alias("n")), f"SELECT ch, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^{T.ALLOWED.replace(chr(39), chr(39) * 2)}]')) AS ch FROM documents) GROUP BY ch")


def dup_lines(s, d):
    """Lines of more than six words that stand in a document more than once: one row a line with its places, not all pairs."""
    lines = docs(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    long = lines.where(F.size(F.regexp_extract_all(F.lower("line"), F.lit(T.WORDS), F.lit(0))) > 6)
    return long.groupBy("doc_id", F.md5("line").alias("digest")).agg(F.count("*").alias("n"), F.min("i").cast("long").alias("first_line"), F.max("i").cast("long").alias("last_line")).where("n > 1")


register("dup_lines", dup_lines, rf"SELECT doc_id, md5(l) AS digest, count(*) AS n, min(i) - 1 AS first_line, max(i) - 1 AS last_line FROM (SELECT doc_id, unnest(range(1, len({LINES}) + 1)) AS i, unnest({LINES}) AS l FROM documents) WHERE len(regexp_extract_all(lower(l), '[\p{{L}}\p{{N}}_]+')) > 6 GROUP BY doc_id, md5(l) HAVING count(*) > 1")
register("longest_lines", lambda s, d: docs(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.size(F.regexp_extract_all("line", F.lit(r"[^ \t\n\r\f]+"), F.lit(0))).cast("long").alias("n_words")).orderBy(F.desc("n_words"), "doc_id", "line_no").limit(200), rf"SELECT doc_id, i - 1 AS line_no, len(regexp_extract_all(l, '[^ \t\n\r\f]+')) AS n_words FROM (SELECT doc_id, unnest(range(1, len({LINES}) + 1)) AS i, unnest({LINES}) AS l FROM documents) ORDER BY n_words DESC, doc_id, line_no LIMIT 200")
register("dehyphenate_reflow", lambda s, d: docs(s, d).select("doc_id", T.squeeze(F.regexp_replace("text", r"([a-zäöüß])[-¬⸗]\r?\n([a-zäöüß])", "$1$2")).alias("text")), rf"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '([a-zäöüß])[-¬⸗]\r?\n([a-zäöüß])', '\1\2', 'g'), '{WS}', ' ', 'g'), ' ') AS text FROM documents")

SENTS = r"SELECT doc_id, i - 1 AS sent_idx, x AS sentence FROM (SELECT doc_id, unnest(range(1, len(ss) + 1)) AS i, unnest(ss) AS x FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), lambda x: trim(x, ' ')), lambda x: length(x) > 0) AS ss FROM documents))"
register("sentences", lambda s, d: segment.sentence_rows(docs(s, d)).select("doc_id", F.col("sent_idx").cast("long").alias("sent_idx"), "sentence"), SENTS)
register("quote_repair", lambda s, d: segment.quote_repair(segment.sentence_rows(docs(s, d))).select("doc_id", F.col("sent_idx").cast("long").alias("sent_idx"), "sentence"), f"WITH s AS ({SENTS}), l AS (SELECT *, regexp_matches(sentence, ' ''$') AS stray, coalesce(lag(regexp_matches(sentence, ' ''$')) OVER (PARTITION BY doc_id ORDER BY sent_idx), false) AS before FROM s) SELECT doc_id, sent_idx, CASE WHEN before THEN '''' ELSE '' END || CASE WHEN stray THEN regexp_replace(sentence, ' ''$', '') ELSE sentence END AS sentence FROM l")
register("word_tokens", lambda s, d: segment.token_rows(docs(s, d)).groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.count_if(F.col("token").rlike(r"^[\p{L}\p{N}_]")).alias("n_words"), F.countDistinct("token").alias("n_types")), r"SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (WHERE regexp_matches(token, '^[\p{L}\p{N}_]')) AS n_words, count(DISTINCT token) AS n_types FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]')) AS token FROM documents) GROUP BY doc_id")
CHUNKS = rf"""WITH RECURSIVE s AS (SELECT doc_id, sent_idx, len(regexp_extract_all(sentence, '[^ \t\n\r\f]+')) AS n0, len(string_split_regex(sentence, '{WS}')) AS n FROM ({SENTS})),
c AS (SELECT doc_id, sent_idx, n, n AS cur, 0 AS k FROM s WHERE sent_idx = 0
 UNION ALL SELECT s.doc_id, s.sent_idx, s.n, CASE WHEN c.cur >= 100 THEN s.n ELSE c.cur + s.n END, CASE WHEN c.cur >= 100 THEN c.k + 1 ELSE c.k END FROM c JOIN s ON s.doc_id = c.doc_id AND s.sent_idx = c.sent_idx + 1)"""
register("chunk_greedy", lambda s, d: segment.greedy_chunks(docs(s, d)), f"{CHUNKS} SELECT doc_id, k AS chunk_idx, count(*) AS n_sents, sum(n) AS n_tokens FROM c GROUP BY doc_id, k")
register("chunk_stats", lambda s, d: segment.greedy_chunks(docs(s, d)).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.min("n_tokens").alias("shortest"), F.max("n_tokens").alias("longest"), F.round(F.avg("n_tokens"), 6).alias("mean"), F.round(F.stddev_pop("n_tokens"), 6).alias("std")), f"{CHUNKS} SELECT doc_id, count(*) AS n_chunks, min(t) AS shortest, max(t) AS longest, round(avg(t), 6) AS mean, round(stddev_pop(t), 6) AS std FROM (SELECT doc_id, k, sum(n) AS t FROM c GROUP BY doc_id, k) GROUP BY doc_id")
register("chunk_count_freq", lambda s, d: segment.greedy_chunks(docs(s, d)).groupBy("doc_id").agg(F.count("*").alias("n_chunks")).groupBy("n_chunks").agg(F.count("*").alias("n_docs")), f"{CHUNKS} SELECT n_chunks, count(*) AS n_docs FROM (SELECT doc_id, max(k) + 1 AS n_chunks FROM c GROUP BY doc_id) GROUP BY n_chunks")
register("sentence_length_range", lambda s, d: segment.sentence_rows(docs(s, d)).withColumn("n", F.size(F.split("sentence", WS))).groupBy("doc_id").agg(F.min("n").cast("long").alias("shortest"), F.max("n").cast("long").alias("longest")), f"SELECT doc_id, min(n) AS shortest, max(n) AS longest FROM (SELECT doc_id, len(string_split_regex(sentence, '{WS}')) AS n FROM ({SENTS})) GROUP BY doc_id")
SWAP = {"the ": "a ", "a ": "the ", "ö": "oe", "ü": "ue", "and": "&"}
register("multi_replace", lambda s, d: docs(s, d).select("doc_id", T.replace_all(F.col("text"), SWAP).alias("text")), "SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '(?s)(?:the |a |ö|ü|and)|.'), lambda x: CASE x WHEN 'the ' THEN 'a ' WHEN 'a ' THEN 'the ' WHEN 'ö' THEN 'oe' WHEN 'ü' THEN 'ue' WHEN 'and' THEN '&' ELSE x END), '') AS text FROM documents")
