"""Queries of n-grams, stylistic features and corpus-relative features."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import features as X
from quillspark.operators import ngrams as N
from quillspark.operators import segment
from quillspark.plans.registry import register
from quillspark.sources.tables import spread, table

docs = lambda s, d: spread(table(s, d, "documents").select("doc_id", "text", "lang"))


def grams_sql(n: int, min_df: int = 1) -> str:
    """CTE g (doc_id, ngram, cnt)."""
    w = r"SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents"
    one = "unnest(w)" if n == 1 else f"unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], '-')))"
    raw = f"SELECT doc_id, ngram, count(*) AS cnt FROM (SELECT doc_id, {one} AS ngram FROM ({w})) GROUP BY doc_id, ngram"
    return f"g0 AS ({raw}), g AS (SELECT * FROM g0" + (f" WHERE ngram IN (SELECT ngram FROM g0 GROUP BY ngram HAVING count(*) >= {min_df}))" if min_df > 1 else ")")


G1, G2, G3 = grams_sql(1), grams_sql(2, 2), grams_sql(3, 2)
uni = lambda s, d: N.counts(docs(s, d))
register("unigram_counts", uni, f"WITH {G1} SELECT doc_id, ngram, cnt FROM g")
register("bigram_counts", lambda s, d: N.counts(docs(s, d), 2, 2), f"WITH {G2} SELECT doc_id, ngram, cnt FROM g")
register("trigram_counts", lambda s, d: N.counts(docs(s, d), 3, 2), f"WITH {G3} SELECT doc_id, ngram, cnt FROM g")
register("doc_vector_dense", lambda s, d: N.vectors(uni(s, d), 50)[0].select("doc_id", F.posexplode("vec").alias("pos", "x")).select("doc_id", (F.col("pos") + 1).cast("long").alias("rank"), F.round("x", 9).alias("x")), f"WITH {G1}, n AS (SELECT doc_id, sum(cnt) AS n FROM g GROUP BY doc_id), m AS (SELECT ngram, row_number() OVER (ORDER BY round(sum(cnt / n), 9) DESC, ngram) AS rank FROM g JOIN n USING (doc_id) GROUP BY ngram QUALIFY rank <= 50) SELECT doc_id, rank, round(coalesce(cnt, 0) / n, 9) AS x FROM n CROSS JOIN m LEFT JOIN g USING (doc_id, ngram)")
register("df_filter", lambda s, d: N.df_filter(uni(s, d), *N.percent_bounds(docs(s, d).count(), 5, 50)).groupBy("ngram").agg(F.count("*").alias("df"), F.sum("cnt").alias("total")), f"WITH {G1}, b AS (SELECT round_even(0.05 * count(*), 0) AS lo, round_even(0.5 * count(*), 0) AS hi FROM documents) SELECT ngram, count(*) AS df, sum(cnt) AS total FROM g GROUP BY ngram HAVING count(*) BETWEEN (SELECT lo FROM b) AND (SELECT hi FROM b)")
register("word_totals", lambda s, d: N.totals(uni(s, d)), f"WITH {G1} SELECT ngram, sum(cnt) AS total, count(*) AS df FROM g GROUP BY ngram")
register("zipf", lambda s, d: N.zipf(N.totals(uni(s, d)).select("ngram", "total")), f"WITH {G1}, t AS (SELECT ngram, sum(cnt) AS total FROM g GROUP BY ngram) SELECT ngram, total, row_number() OVER (ORDER BY total DESC, ngram) AS rank, round(max(total) OVER () / row_number() OVER (ORDER BY total DESC, ngram), 6) AS expected FROM t")
register("hapax", lambda s, d: uni(s, d).groupBy("ngram").agg(F.sum("cnt").alias("total"), F.min("doc_id").alias("doc_id")).where("total = 1").select("ngram", "doc_id"), f"WITH {G1} SELECT ngram, min(doc_id) AS doc_id FROM g GROUP BY ngram HAVING sum(cnt) = 1")
register("mfw_relfreq", lambda s, d: N.relative(uni(s, d)).select("doc_id", "ngram", F.round("rel", 9).alias("rel")), f"WITH {G1} SELECT doc_id, ngram, round(cnt / sum(cnt) OVER (PARTITION BY doc_id), 9) AS rel FROM g")
register("mfw_top", lambda s, d: N.most_frequent(uni(s, d), 500).select("ngram", F.col("rank").cast("long").alias("rank"), F.round("weight", 6).alias("weight")), f"WITH {G1}, n AS (SELECT doc_id, sum(cnt) AS n FROM g GROUP BY doc_id) SELECT ngram, row_number() OVER (ORDER BY round(sum(cnt / n), 9) DESC, ngram) AS rank, round(round(sum(cnt / n), 9), 6) AS weight FROM g JOIN n USING (doc_id) GROUP BY ngram QUALIFY rank <= 500")

# features of a document
LOW = "lower(text)"
cnt_sql = lambda chars: f"(length({LOW}) - length(translate({LOW}, '{chars.replace(chr(39), chr(39) * 2)}', '')))"
ratio_sql = lambda a, b: f"round({a} / nullif({b}, 0), 6)"
low = lambda: F.lower("text")
register("feat_punct_ratio", lambda s, d: docs(s, d).select("doc_id", T.ratio(T.count_of(low(), T.MARKS), F.length(low())).alias("punct_ratio")), f"SELECT doc_id, {ratio_sql(cnt_sql(T.MARKS), f'length({LOW})')} AS punct_ratio FROM documents")
CH = {"whitespace": " ", "exclamation": "!", "question": "?", "comma": ","}
register("feat_char_ratios", lambda s, d: docs(s, d).select("doc_id", *[T.ratio(T.count_of(low(), c), F.length(low())).alias(k) for k, c in CH.items()]), "SELECT doc_id, " + ", ".join(f"{ratio_sql(cnt_sql(c), f'length({LOW})')} AS {k}" for k, c in CH.items()) + " FROM documents")
register("feat_upper_ratio", lambda s, d: docs(s, d).select("doc_id", T.ratio(F.length(F.regexp_replace("text", r"[^\p{Lu}]", "")), F.length(F.regexp_replace("text", r"[^\p{L}]", ""))).alias("upper_ratio")), r"SELECT doc_id, round(len(regexp_extract_all(text, '\p{Lu}')) / nullif(len(regexp_extract_all(text, '\p{L}')), 0), 6) AS upper_ratio FROM documents")
from quillspark.plans.text_queries import SENTS, WS  # noqa: E402

register("feat_sentence_len", lambda s, d: segment.sentence_rows(docs(s, d)).withColumn("n", F.size(F.split("sentence", WS))).groupBy("doc_id").agg(F.round(F.avg("n"), 6).alias("mean"), F.max("n").cast("long").alias("longest")), f"SELECT doc_id, round(avg(n), 6) AS mean, max(n) AS longest FROM (SELECT doc_id, len(string_split_regex(sentence, '{WS}')) AS n FROM ({SENTS})) GROUP BY doc_id")
register("feat_counts", lambda s, d: docs(s, d).select("doc_id", F.length("text").cast("long").alias("nr_chars"), F.when(F.col("text").isNotNull(), F.size(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\f]+"), F.lit(0)))).cast("long").alias("nr_words"), F.when(F.col("text").isNotNull(), F.size(T.sentences(F.col("text")))).cast("long").alias("nr_sentences")), r"SELECT doc_id, length(text) AS nr_chars, len(regexp_extract_all(text, '[^ \t\n\r\f]+')) AS nr_words, len(list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), lambda x: trim(x, ' ')), lambda x: length(x) > 0)) AS nr_sentences FROM documents")
register("feat_word_len", lambda s, d: uni(s, d).groupBy("doc_id").agg(F.max(F.length("ngram")).cast("long").alias("longest"), F.round(F.sum(F.length("ngram") * F.col("cnt")) / F.sum("cnt"), 6).alias("mean")), f"WITH {G1} SELECT doc_id, max(length(ngram)) AS longest, round(sum(length(ngram) * cnt) / sum(cnt), 6) AS mean FROM g GROUP BY doc_id")
register("feat_ttr", lambda s, d: uni(s, d).groupBy("doc_id").agg(F.round(F.count("*") / F.sum("cnt"), 6).alias("ttr")), f"WITH {G1} SELECT doc_id, round(count(*) / sum(cnt), 6) AS ttr FROM g GROUP BY doc_id")
for k in (1, 2, 3):
    register(f"feat_entropy_{k}", lambda s, d, k=k: X.entropy(N.counts(docs(s, d), k)), f"WITH {grams_sql(k)} SELECT doc_id, round(ln(sum(cnt)) - sum(cnt * ln(cnt)) / sum(cnt), 6) AS entropy FROM g GROUP BY doc_id")
FLESCH = r"""
SELECT doc_id, round({score}, 6) AS flesch FROM (
 SELECT doc_id, lang, len(words)::DOUBLE AS w, nullif(len(list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), lambda x: trim(x, ' ')), lambda x: length(x) > 0)), 0)::DOUBLE AS s, list_sum(list_transform(words, lambda x: greatest(len(regexp_extract_all(x, '[aeiouyäöüàâéèêëîïôûùáíóú]+')), 1)))::DOUBLE AS y
 FROM (SELECT doc_id, lang, text, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS words FROM documents)) WHERE w > 0"""
register("feat_flesch", lambda s, d: X.flesch(docs(s, d)), FLESCH.replace("{score}", "206.835 - 1.015 * (w / s) - 84.6 * (y / w)"))
register("feat_flesch_german", lambda s, d: X.flesch(docs(s, d), german=True), FLESCH.replace("{score}", "CASE WHEN lang = 'de' THEN 180 - w / s - 58.5 * y / w ELSE 206.835 - 1.015 * w / s - 84.6 * y / w END"))

# features of vectors: the chunks of a book are the vectors of a label, in the order of their ids
emb = lambda s, d: table(s, d, "embeddings")
E64 = "e AS (SELECT vec_id, label, i AS dim, embedding[i]::DOUBLE AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) r(i))"
register("centroid_by_label", lambda s, d: X.centroids(emb(s, d)).select("label", F.posexplode("centroid").alias("dim", "x")).select("label", (F.col("dim") + 1).cast("long").alias("dim"), F.round("x", 6).alias("x")), f"WITH {E64} SELECT label, dim, round(avg(x), 6) AS x FROM e GROUP BY label, dim")
register("explode_embedding", lambda s, d: emb(s, d).select("vec_id", F.posexplode("embedding").alias("dim", "x")).select("vec_id", (F.col("dim") + 1).cast("long").alias("dim"), F.round(F.col("x").cast("double"), 6).alias("x")), f"WITH {E64} SELECT vec_id, dim, round(x, 6) AS x FROM e")
CENT = f"{E64}, c AS (SELECT label, dim, avg(x) AS m FROM e GROUP BY label, dim)"
register("intra_textual_variance", lambda s, d: X.intra_variance(emb(s, d)), f"WITH {CENT} SELECT label, CASE WHEN count(*) > 1 THEN round(avg(dist), 6) END AS variance FROM (SELECT label, vec_id, sqrt(sum((x - m) * (x - m))) AS dist FROM e JOIN c USING (label, dim) GROUP BY label, vec_id) GROUP BY label")
register("stepwise_distance", lambda s, d: X.stepwise(emb(s, d)), f"WITH {E64}, l AS (SELECT label, vec_id, x, lag(x) OVER (PARTITION BY label, dim ORDER BY vec_id) AS p FROM e) SELECT label, round(avg(dist), 6) AS stepwise FROM (SELECT label, vec_id, sqrt(sum((x - p) * (x - p))) AS dist FROM l GROUP BY label, vec_id) GROUP BY label")
register("overlap_score", lambda s, d: X.overlap(emb(s, d)), f"WITH {CENT}, n AS (SELECT label, count(*) AS k FROM embeddings GROUP BY label), p AS (SELECT c.label AS book, e.vec_id, any_value(e.label) AS label, round(sqrt(sum((e.x - c.m) * (e.x - c.m))), 9) AS dist FROM c JOIN e USING (dim) GROUP BY c.label, e.vec_id) SELECT book AS label, round(avg(CASE WHEN label <> book THEN 1.0 ELSE 0.0 END), 6) AS overlap FROM (SELECT p.*, k, row_number() OVER (PARTITION BY book ORDER BY dist, vec_id) AS r FROM p JOIN n ON n.label = p.book) WHERE r <= k GROUP BY book")
register("outlier_score", lambda s, d: X.outlier(emb(s, d)), f"WITH {CENT} SELECT label, round(min(dist), 6) AS outlier FROM (SELECT a.label, b.label AS other, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS dist FROM c a JOIN c b ON a.dim = b.dim AND a.label <> b.label GROUP BY a.label, b.label) GROUP BY label")

DIST = "t AS (SELECT ngram, sum(cnt)::DOUBLE AS t FROM g GROUP BY ngram), tt AS (SELECT sum(t * t) AS t2 FROM t), p AS (SELECT doc_id, sum(cnt * t) AS ct, sum(cnt::DOUBLE * cnt) AS c2 FROM g JOIN t USING (ngram) GROUP BY doc_id) SELECT doc_id, round(1 - (ct - c2) / (sqrt(t2 - 2 * ct + c2) * sqrt(c2)), 6) AS distance FROM p, tt WHERE t2 - 2 * ct + c2 > 0"
register("unigram_distance", lambda s, d: X.corpus_distance(N.counts(docs(s, d), 1, 2)), f"WITH {grams_sql(1, 2)}, {DIST}")
register("bigram_distance", lambda s, d: X.corpus_distance(N.counts(docs(s, d), 2, 2)), f"WITH {G2}, {DIST}")
register("trigram_distance", lambda s, d: X.corpus_distance(N.counts(docs(s, d), 3, 2)), f"WITH {G3}, {DIST}")
register("unigram_distance_limited", lambda s, d: X.corpus_distance(N.df_filter(uni(s, d), *N.percent_bounds(docs(s, d).count(), 5, 50))), f"WITH {G1.replace('g AS (', 'gg AS (')}, b AS (SELECT round_even(0.05 * count(*), 0) AS lo, round_even(0.5 * count(*), 0) AS hi FROM documents), g AS (SELECT * FROM gg WHERE ngram IN (SELECT ngram FROM gg GROUP BY ngram HAVING count(*) BETWEEN (SELECT lo FROM b) AND (SELECT hi FROM b))), {DIST}")
TAG_SQL = r"CASE WHEN regexp_matches(token, '^[0-9]+$') THEN 'NUM' WHEN NOT regexp_matches(token, '^[\p{L}\p{N}_]') THEN 'PUN' WHEN regexp_matches(token, '^\p{Lu}') THEN 'CAP' WHEN regexp_matches(token, '(ly|lich|ment)$') THEN 'ADV' WHEN regexp_matches(token, '(ed|te|ten|ing)$') THEN 'VRB' WHEN length(token) <= 3 THEN 'FUN' ELSE 'WRD' END"
register("tag_ngrams_rel", lambda s, d: X.tag_ngrams(docs(s, d)), rf"""WITH s AS ({SENTS}), k AS (SELECT doc_id, list_transform(regexp_extract_all(sentence, '[\p{{L}}\p{{N}}_]+|[^\s\p{{L}}\p{{N}}_]'), lambda token: {TAG_SQL}) AS t FROM s),
b AS (SELECT doc_id, unnest(list_transform(range(1, len(p)), lambda i: p[i] || '-' || p[i + 1])) AS tag FROM (SELECT doc_id, list_concat(['BOS'], t, ['EOS']) AS p FROM k)),
c AS (SELECT doc_id, tag, count(*) AS n FROM b GROUP BY doc_id, tag), top AS (SELECT tag FROM c GROUP BY tag ORDER BY sum(n) DESC, tag LIMIT 100)
SELECT doc_id, tag, round(n / sum(n) OVER (PARTITION BY doc_id), 9) AS rel FROM c WHERE tag IN (SELECT tag FROM top)""")


def feats_sql(rel: str, keys: str) -> str:
    """CTEs of the features of rel (keys, text, sentences), the last of them f."""
    k = keys.split(", ")
    using = f"USING ({keys})"
    word = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
    runs = " UNION ALL ".join(f"SELECT {keys}, {n} AS n, unnest({'w' if n == 1 else f'list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], chr(45)))'}) AS gram FROM fw" for n in (1, 2, 3))
    ent = lambda n: f"round(ln(sum(c) FILTER (WHERE n = {n})) - sum(c * ln(c)) FILTER (WHERE n = {n}) / sum(c) FILTER (WHERE n = {n}), 6)"
    lens = f"list_transform(sentences, lambda x: len(string_split_regex(x, '{WS}')))"
    return rf"""fw AS (SELECT {keys}, text, sentences, {word} AS w FROM {rel} WHERE len({word}) > 0),
fc AS (SELECT {keys}, n, gram, count(*) AS c FROM ({runs}) GROUP BY {keys}, n, gram),
fg AS (SELECT {keys}, max(length(gram)) FILTER (WHERE n = 1) AS longest_word_length, round(sum(length(gram) * c) FILTER (WHERE n = 1) / sum(c) FILTER (WHERE n = 1), 6) AS average_word_length, {ent(1)} AS unigram_entropy, {ent(2)} AS bigram_entropy, {ent(3)} AS trigram_entropy, round(count(*) FILTER (WHERE n = 1) / sum(c) FILTER (WHERE n = 1), 6) AS type_token_ratio FROM fc GROUP BY {keys}),
fp AS (SELECT {keys}, {ratio_sql(cnt_sql(T.MARKS), f'length({LOW})')} AS ratio_of_punctuation_marks, """ + ", ".join(f"{ratio_sql(cnt_sql(c), f'length({LOW})')} AS {name}" for c, name in ((" ", "ratio_of_whitespaces"), ("!", "ratio_of_exclamation_marks"), ("?", "ratio_of_question_marks"), (",", "ratio_of_commas"))) + rf""",
 round(len(regexp_extract_all(text, '\p{{Lu}}')) / nullif(len(regexp_extract_all(text, '\p{{L}}')), 0), 6) AS ratio_of_uppercase_letters, round(list_sum({lens}) / len(sentences), 6) AS average_number_of_words_in_sentence, list_max({lens}) AS maximum_number_of_words_in_sentence,
 length(text) AS nr_chars, len(regexp_extract_all(text, '[^ \t\n\r\f]+')) AS nr_words, len(sentences) AS nr_sentences,
 round(206.835 - 1.015 * (len(w)::DOUBLE / nullif(len(sentences), 0)::DOUBLE) - 84.6 * (list_sum(list_transform(w, lambda x: greatest(len(regexp_extract_all(x, '[aeiouyäöüàâéèêëîïôûùáíóú]+')), 1)))::DOUBLE / len(w)::DOUBLE), 6) AS flesch_reading_ease_score FROM fw),
f AS (SELECT {keys}, {", ".join(X.FEATURES)} FROM fp JOIN fg {using})"""


BOOK = r"bk AS (SELECT doc_id, text, list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), lambda x: trim(x, ' ')), lambda x: length(x) > 0) AS sentences FROM documents)"
#: The balanced packing: pk packs once for all documents; tr tries (inc, more) in order until the rest settles.
PACK = "list_reduce(ls, lambda a, x: CASE WHEN a.cur >= 100 + (CASE WHEN a.k < {more} THEN {inc} ELSE 0 END) THEN {{'k': a.k + 1, 'cur': x, 'ids': list_append(a.ids, a.k + 1)}} ELSE {{'k': a.k, 'cur': a.cur + x, 'ids': list_append(a.ids, a.k)}} END, {{'k': 0, 'cur': 0::BIGINT, 'ids': []::INT[]}})"
SETTLED = "(p.cur > 90 OR p.k = 0 OR p.cur <= 10)"
BALANCED = f"""RECURSIVE {BOOK},
ln AS (SELECT doc_id, sentences, list_transform(sentences, lambda x: len(string_split_regex(x, '{WS}'))) AS ls FROM bk WHERE len(sentences) > 0),
p0 AS (SELECT doc_id, ls, {PACK.format(more=0, inc=0)} AS p FROM ln),
tr AS (SELECT doc_id, ls, p, 1 AS inc, 0 AS more, {SETTLED} AS done FROM p0
 UNION ALL SELECT doc_id, ls, p, inc, more, {SETTLED} AS done FROM (
  SELECT doc_id, ls, inc, more, CASE WHEN go THEN {PACK.format(more="more", inc="inc")} ELSE p END AS p FROM (
   SELECT doc_id, ls, p, CASE WHEN p.k > more + 1 THEN inc ELSE inc + 1 END AS inc, CASE WHEN p.k > more + 1 THEN more + 1 ELSE 0 END AS more, p.k > more + 1 AS go FROM tr WHERE NOT done) WHERE inc <= 50)),
bl AS (SELECT ln.doc_id, ln.sentences, ln.ls, coalesce((SELECT any_value(t.p) FROM tr t WHERE t.doc_id = ln.doc_id AND t.done), p0.p) AS p, EXISTS (SELECT 1 FROM tr t WHERE t.doc_id = ln.doc_id AND t.done) AS ok FROM ln JOIN p0 USING (doc_id)),
bi AS (SELECT doc_id, sentences, ls, CASE WHEN p.k > 0 AND (CASE WHEN ok THEN p.cur <= 10 ELSE p.cur < 50 END) THEN list_transform(p.ids, lambda x: least(x, p.k - 1)) ELSE p.ids END AS ids FROM bl),
bs AS (SELECT doc_id, unnest(ids) AS chunk_idx, unnest(sentences) AS sentence, unnest(ls) AS n, unnest(range(1, len(ids) + 1)) AS i FROM bi),
bc AS (SELECT doc_id, chunk_idx, count(*) AS n_sents, sum(n)::BIGINT AS n_tokens, string_agg(sentence, ' ' ORDER BY i) AS text, list(sentence ORDER BY i) AS sentences FROM bs GROUP BY doc_id, chunk_idx)"""
chunks = lambda s, d: segment.chunk_rows(docs(s, d))
texts_of = lambda s, d: segment.chunk_text(chunks(s, d))
register("chunk_balanced", lambda s, d: chunks(s, d).drop("sentences"), f"WITH {BALANCED} SELECT doc_id, chunk_idx, n_sents, n_tokens FROM bc")
register("chunk_text", texts_of, f"WITH {BALANCED} SELECT doc_id, chunk_idx, text FROM bc")
register("chunk_view_sentences", lambda s, d: chunks(s, d).select("doc_id", "chunk_idx", F.posexplode("sentences").alias("place", "sentence")).select("doc_id", "chunk_idx", F.col("place").cast("long").alias("place"), F.lower("sentence").alias("sentence")), f"WITH {BALANCED} SELECT doc_id, chunk_idx, i - min(i) OVER (PARTITION BY doc_id, chunk_idx) AS place, lower(sentence) AS sentence FROM bs")
CHUNK_GRAMS = f"{BALANCED}, cw AS (SELECT doc_id, chunk_idx, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM bc), cg AS (SELECT doc_id, chunk_idx, n, ngram, count(*) AS cnt FROM (" + " UNION ALL ".join(f"SELECT doc_id, chunk_idx, {n} AS n, unnest({'w' if n == 1 else f'list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], chr(45)))'}) AS ngram FROM cw" for n in (1, 2, 3)) + ") GROUP BY ALL)"
piece = lambda s, d: N.piece_counts(texts_of(s, d), ["doc_id", "chunk_idx"])
register("chunk_ngrams", piece, f"WITH {CHUNK_GRAMS} SELECT doc_id, chunk_idx, n, ngram, cnt FROM cg")
for k, nm in ((1, "unigram"), (2, "bigram"), (3, "trigram")):
    register(f"chunk_{nm}_counts", lambda s, d, k=k: N.df_filter(piece(s, d).where(F.col("n") == k).select(F.concat_ws("_", "doc_id", "chunk_idx").alias("chunk"), "ngram", "cnt"), 2), f"WITH {CHUNK_GRAMS}, x AS (SELECT doc_id || '_' || chunk_idx AS chunk, ngram, cnt FROM cg WHERE n = {k}) SELECT chunk, ngram, cnt FROM x WHERE ngram IN (SELECT ngram FROM x GROUP BY ngram HAVING count(*) >= 2)")
register("ngram_tables", lambda s, d: N.piece_counts(docs(s, d), ["doc_id"]).groupBy("n").agg(F.count("*").alias("cells"), F.count_distinct("ngram").alias("ngrams"), F.count_distinct("doc_id").alias("texts")), "WITH " + ", ".join(grams_sql(n).replace("g0 AS", f"a{n} AS").replace("g AS (SELECT * FROM g0", f"b{n} AS (SELECT * FROM a{n}") for n in (1, 2, 3)) + " " + " UNION ALL ".join(f"SELECT {n} AS n, count(*) AS cells, count(DISTINCT ngram) AS ngrams, count(DISTINCT doc_id) AS texts FROM b{n}" for n in (1, 2, 3)))
BOOKS = f"{BOOK}, {feats_sql('bk', 'doc_id')}"
register("feature_merge", lambda s, d: X.merged(docs(s, d)), f"WITH {BOOKS}, {grams_sql(1, 2)}, {DIST[: DIST.rindex(') SELECT')]}), q AS ({DIST[DIST.rindex(') SELECT') + 2 :]}) SELECT f.*, q.distance AS unigram_distance FROM f LEFT JOIN q USING (doc_id)")
level = lambda name: lambda s, d: X.level(docs(s, d), name)
with_suffix = lambda sfx, x="f": ", ".join(f"{x}.{c} AS {c}_{sfx}" for c in X.FEATURES)
register("features_book", level("book"), f"WITH {BOOKS} SELECT doc_id, {with_suffix('full')} FROM f")
CHUNKS_F = f"{BALANCED}, {feats_sql('bc', 'doc_id, chunk_idx')}, ch AS (SELECT * FROM f)"
BOTH_F = f"{CHUNKS_F}, {feats_sql('bk', 'doc_id').replace('fw AS', 'hw AS').replace('FROM fw', 'FROM hw').replace('fc AS', 'hc AS').replace('FROM fc', 'FROM hc').replace('fg AS', 'hg AS').replace('JOIN fg', 'JOIN hg').replace('fp AS', 'hp AS').replace('FROM fp', 'FROM hp').replace('f AS (SELECT', 'h AS (SELECT')}"
register("features_chunk", level("chunk"), f"WITH {CHUNKS_F} SELECT doc_id, chunk_idx, {with_suffix('chunk', 'ch')} FROM ch")
register("features_baac", level("baac"), f"WITH {BOTH_F}, m AS (SELECT doc_id, {', '.join(f'floor(sum(round({c} * 1e6)) / count({c}) + 0.5) / 1e6 AS {c}_chunk' for c in X.FEATURES)} FROM ch GROUP BY doc_id) SELECT h.doc_id, {with_suffix('full', 'h')}, {', '.join(f'm.{c}_chunk' for c in X.FEATURES)} FROM h JOIN m USING (doc_id)")
register("features_cacb", level("cacb"), f"WITH {BOTH_F} SELECT ch.doc_id, ch.chunk_idx, {with_suffix('chunk', 'ch')}, {with_suffix('full', 'h')} FROM ch JOIN h USING (doc_id)")


def level_rows(s, d):
    """Rows of the four tables: as many books in baac as in book, as many chunks in cacb as in chunk."""
    out = None
    for name, t in X.levels(docs(s, d)).items():
        row = t.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("books")).select(F.lit(name).alias("level"), "n", "books")
        out = row if out is None else out.unionByName(row)
    return out


register("feature_row_counts", level_rows, f"WITH {BOTH_F} " + " UNION ALL ".join(f"SELECT '{name}' AS level, count(*) AS n, count(DISTINCT doc_id) AS books FROM {rel}" for name, rel in (("book", "h"), ("chunk", "ch"), ("baac", "(SELECT doc_id FROM h WHERE doc_id IN (SELECT doc_id FROM ch))"), ("cacb", "ch"))))
FCOLS = ["average_sentence_length_full", "average_word_length_full", "type_token_ratio_full", "unigram_entropy_full", "bigram_entropy_full", "trigram_entropy_full", "ratio_of_punctuation_full", "average_paragraph_length_full", "dialogue_share_full", "function_word_share_full", "comma_rate_full", "longest_word_full", "verb_share_full", "name_share_full", "intra_variance_full", "overlap_score_full"]
feat = lambda s, d: table(s, d, "features")
register("feature_null_profile", lambda s, d: X.null_profile(feat(s, d), FCOLS), " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) - count({c}) AS n_null, count(*) FILTER (WHERE {c} = 0) AS n_zero, count(*) FILTER (WHERE {c} < 0) AS n_negative, count(DISTINCT {c}) AS n_distinct FROM features" for c in FCOLS))
register("feature_corr_pairs", lambda s, d: X.correlations(feat(s, d), FCOLS), " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM features WHERE {a} >= 0 AND {b} >= 0" for i, a in enumerate(FCOLS) for b in FCOLS[i + 1 :]))
register("minmax_scaled", lambda s, d: X.minmax(feat(s, d).select("text_id", "computed_at", *FCOLS).distinct(), FCOLS).select("text_id", "computed_at", *[F.round(c, 6).alias(c) for c in FCOLS]), "WITH f AS (SELECT DISTINCT text_id, computed_at, " + ", ".join(FCOLS) + " FROM features) SELECT text_id, computed_at, " + ", ".join(f"round(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 6) AS {c}" for c in FCOLS) + " FROM f")
