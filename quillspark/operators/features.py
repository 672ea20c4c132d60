"""Stylistic features of documents, features of chunk vectors and features relative to the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import distance as D
from quillspark.operators import ngrams as N
from quillspark.operators import segment
from quillspark.operators.numbering import numbered
from quillspark.session import once, written


def entropy(cnt: DataFrame, key: str = "doc_id") -> DataFrame:
    """Natural-log Shannon entropy of the n-gram counts of each document: ln N - sum(c ln c) / N."""
    n = F.sum("cnt")
    return cnt.groupBy(key).agg(F.round(F.ln(n) - F.sum(F.col("cnt") * F.ln("cnt")) / n, 6).alias("entropy"))


def reading_ease(words: Column, n_sentences: Column) -> Column:
    """Flesch's score by the English formula; syllables are runs of vowels, at least one a word; null without sentences."""
    vowels = "[aeiouyäöüàâéèêëîïôûùáíóú]+"
    y = F.aggregate(words, F.lit(0), lambda a, x: a + F.greatest(F.size(F.regexp_extract_all(x, F.lit(vowels), F.lit(0))), F.lit(1))).cast("double")
    n, s = F.nullif(F.size(words), F.lit(0)).cast("double"), F.nullif(n_sentences, F.lit(0)).cast("double")
    return 206.835 - 1.015 * n / s - 84.6 * y / n


def flesch(df: DataFrame, key: str = "doc_id", german: bool = False) -> DataFrame:
    """Reading ease by the English formula for all texts, or with the German constants for German ones.

    Syllables are runs of vowels, at least one a word. Documents without words have no row; one without
    sentences has a null.
    """
    if not german:
        plain = df.select(key, F.col("text").alias("_t"), T.words(F.col("text")).alias("_w")).where(F.size("_w") > 0)
        return plain.select(key, F.round(reading_ease(F.col("_w"), F.size(T.sentences(F.col("_t")))), 6).alias("flesch"))
    w = df.select(key, "lang", F.col("text").alias("_t"), T.words(F.col("text")).alias("_w")).where(F.size("_w") > 0)
    vowels = "[aeiouyäöüàâéèêëîïôûùáíóú]+"
    y = F.aggregate("_w", F.lit(0), lambda a, x: a + F.greatest(F.size(F.regexp_extract_all(x, F.lit(vowels), F.lit(0))), F.lit(1))).cast("double")
    n, s = F.size("_w").cast("double"), F.nullif(F.size(T.sentences(F.col("_t"))), F.lit(0)).cast("double")
    score = F.when(F.col("lang") == "de", 180 - n / s - 58.5 * y / n).otherwise(206.835 - 1.015 * n / s - 84.6 * y / n)
    return w.select(key, F.round(score, 6).alias("flesch"))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def centroids(vectors: DataFrame, group: str = "label", vec: str = "embedding") -> DataFrame:
    """(group, centroid, n): mean vectors, summed per dimension before the shuffle."""
    dims = vectors.select(group, F.posexplode(vec).alias("dim", "x")).groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    return dims.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("centroid"), F.max("n").alias("n"))


def intra_variance(vectors: DataFrame, group: str = "label", vec: str = "embedding") -> DataFrame:
    """Mean distance of a book's chunk vectors to their centroid; null for a single chunk."""
    d = vectors.join(centroids(vectors, group, vec), group).withColumn("dist", F.sqrt(squared_distance(F.col(vec), F.col("centroid"))))
    return d.groupBy(group).agg(F.when(F.count("*") > 1, F.round(F.avg("dist"), 6)).alias("variance"))


def stepwise(vectors: DataFrame, group: str = "label", vec: str = "embedding", order: str = "vec_id") -> DataFrame:
    """Mean distance of consecutive chunk vectors; null for a single chunk."""
    w = Window.partitionBy(group).orderBy(order)
    d = vectors.withColumn("_p", F.lag(vec).over(w)).withColumn("dist", F.sqrt(squared_distance(F.col(vec), F.col("_p"))))
    return d.groupBy(group).agg(F.round(F.avg("dist"), 6).alias("stepwise"))


def _centres(vectors: DataFrame, group: str, vec: str) -> DataFrame:
    c = centroids(vectors, group, vec)
    return written(c.select(F.col(group).alias("_key"), F.col("centroid").alias("vec"), F.col("n").cast("int").alias("k")))


def overlap(vectors: DataFrame, group: str = "label", vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Share of the k vectors nearest to a book's centroid that are of other books, k being its chunks.

    Books are the stated queries, in blocks, against all chunk vectors; a task keeps the k nearest of a book
    at most. The ranks come from one sort over all books, so a book that holds a third of all chunks is no
    single task.
    """
    rows = vectors.select(F.struct(F.col(key).alias("k"), F.col(group).alias("g")).alias("_key"), F.transform(vec, lambda x: x.cast("double")).alias("vec"))
    c = _centres(vectors, group, vec)
    pairs = D.against(rows, c, "euclid", digits=9, k="k")
    ranked = numbered(pairs.select(F.col("query").alias("_book"), "value", F.col("other.k").alias("_k"), F.col("other.g").alias("_g")), "_n", "_book", "value", "_k")
    first = ranked.groupBy("_book").agg(F.min("_n").alias("_first"))
    near = ranked.join(first, "_book").join(c.select(F.col("_key").alias("_book"), F.col("k").alias("_most")), "_book").where(F.col("_n") - F.col("_first") < F.col("_most"))
    return near.groupBy(F.col("_book").alias(group)).agg(F.round(F.avg((F.col("_g") != F.col("_book")).cast("double")), 6).alias("overlap"))


def outlier(vectors: DataFrame, group: str = "label", vec: str = "embedding") -> DataFrame:
    """Distance of a book's centroid to the nearest other one."""
    c = _centres(vectors, group, vec)
    pairs = D.against(c.select("_key", "vec"), c.withColumn("k", F.lit(2)), "euclid", digits=6, k="k")
    return pairs.where("other <> query").groupBy(F.col("query").alias(group)).agg(F.min("value").alias("outlier"))


def corpus_distance(cnt: DataFrame, key: str = "doc_id") -> DataFrame:
    """Cosine distance of a document's counts to those of the rest of the corpus, from sums alone: nothing is densified."""
    cnt = once(cnt)
    total = cnt.groupBy("ngram").agg(F.sum("cnt").cast("double").alias("_t"))
    square = total.agg(F.sum(F.col("_t") * F.col("_t")).alias("_t2"))
    p = cnt.join(total, "ngram").groupBy(key).agg(F.sum(F.col("cnt") * F.col("_t")).alias("_ct"), F.sum(F.col("cnt").cast("double") * F.col("cnt")).alias("_c2"))
    rest = F.col("_t2") - 2 * F.col("_ct") + F.col("_c2")
    # the one row of the total is broadcast
    return p.crossJoin(F.broadcast(square)).where(rest > 0).select(key, F.round(1 - (F.col("_ct") - F.col("_c2")) / (F.sqrt(rest) * F.sqrt("_c2")), 6).alias("distance"))


def shape_tag(token: Column) -> Column:
    """A tag from the shape of a token: the offline stand-in for a tagger."""
    return (
        F.when(token.rlike("^[0-9]+$"), "NUM")
        .when(~token.rlike(r"^[\p{L}\p{N}_]"), "PUN")
        .when(token.rlike(r"^\p{Lu}"), "CAP")
        .when(token.rlike("(ly|lich|ment)$"), "ADV")
        .when(token.rlike("(ed|te|ten|ing)$"), "VRB")
        .when(F.length(token) <= 3, "FUN")
        .otherwise("WRD")
    )


def tag_ngrams(df: DataFrame, n: int = 2, top: int = 100, key: str = "doc_id") -> DataFrame:
    """(key, tag, rel): tag n-grams over sentences padded with n - 1 marks, relative within the corpus' top ones.

    The list of top tags has that many rows and is broadcast.
    """
    sents = segment.sentence_rows(df, key)
    tags = F.transform(T.tokens(F.col("sentence")), shape_tag)
    pad = F.concat(F.array_repeat(F.lit("BOS"), n - 1), tags, F.array_repeat(F.lit("EOS"), n - 1))
    rows = sents.select(key, pad.alias("_p")).select(key, F.explode(N.grams(F.col("_p"), n)).alias("tag"))
    cnt = rows.groupBy(key, "tag").agg(F.count("*").alias("n"))
    best = cnt.groupBy("tag").agg(F.sum("n").alias("_s")).orderBy(F.desc("_s"), "tag").limit(top).select("tag")
    kept = cnt.join(F.broadcast(best), "tag")
    return kept.select(key, "tag", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(key)), 9).alias("rel"))


#: The features of a text, whole or a chunk, in the order of their columns.
FEATURES = [
    "ratio_of_punctuation_marks", "ratio_of_whitespaces", "ratio_of_exclamation_marks", "ratio_of_question_marks", "ratio_of_commas", "ratio_of_uppercase_letters", "average_number_of_words_in_sentence", "maximum_number_of_words_in_sentence", "nr_chars", "nr_words",
    "nr_sentences", "longest_word_length", "average_word_length", "unigram_entropy", "bigram_entropy", "trigram_entropy", "type_token_ratio", "flesch_reading_ease_score",
]


def array_entropy(items: Column) -> Column:
    """Natural-log Shannon entropy of the items of an array of longs: the runs of the sorted array are counted in one pass; null if empty."""
    zero = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

    def step(s, x):
        same = s["last"].eqNullSafe(x)
        done = F.when(s["run"] > 0, s["run"] * F.ln(s["run"])).otherwise(0.0)
        return F.struct(x.alias("last"), F.when(same, s["run"] + 1).otherwise(1.0).alias("run"), F.when(same, s["sum"]).otherwise(s["sum"] + done).alias("sum"))

    n = F.nullif(F.size(items), F.lit(0)).cast("double")
    total = F.aggregate(F.sort_array(items), zero, step, lambda s: s["sum"] + F.when(s["run"] > 0, s["run"] * F.ln(s["run"])).otherwise(0.0))
    return F.ln(n) - total / n


def piece_features(df: DataFrame, keys: list[str], text: str = "text", sentences: str | None = None) -> DataFrame:
    """(keys, FEATURES) of texts or chunks with words, in one scan without a shuffle.

    sentences names a column with the sentences; without it they are cut from the text. Values are rounded to
    6 digits. N-grams are told apart by 64-bit hashes within their text; the entropy of n-grams of which a text
    has none is null.
    """
    low, t = F.lower(F.col(text)), F.col(text)
    sents = F.col(sentences) if sentences else T.sentences(t)
    base = df.select(*keys, t.alias("_t"), low.alias("_l"), sents.alias("_s"), T.words(t).alias("_w")).where(F.size("_w") > 0)
    base = base.withColumns({"_n": segment.sentence_lengths(F.col("_s")), "_h": F.transform("_w", lambda w: F.xxhash64(w)), "_z": F.transform("_w", lambda w: F.length(w))})

    def grams(n: int) -> Column:
        last = F.size("_h") - (n - 1)
        runs = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(*[F.get("_h", i - 1 + k) for k in range(n)]))
        return F.when(last >= 1, runs).otherwise(F.array().cast("array<long>"))

    share = lambda chars: T.ratio(T.count_of(F.col("_l"), chars), F.length("_l"))
    return base.select(
        *keys,
        share(T.MARKS).alias("ratio_of_punctuation_marks"), share(" ").alias("ratio_of_whitespaces"), share("!").alias("ratio_of_exclamation_marks"), share("?").alias("ratio_of_question_marks"), share(",").alias("ratio_of_commas"),
        T.ratio(F.length(F.regexp_replace("_t", r"[^\p{Lu}]", "")), F.length(F.regexp_replace("_t", r"[^\p{L}]", ""))).alias("ratio_of_uppercase_letters"),
        T.ratio(F.aggregate("_n", F.lit(0), lambda a, n: a + n), F.size("_n")).alias("average_number_of_words_in_sentence"), F.array_max("_n").cast("long").alias("maximum_number_of_words_in_sentence"),
        F.length("_t").cast("long").alias("nr_chars"), F.size(F.regexp_extract_all("_t", F.lit(r"[^ \t\n\r\f]+"), F.lit(0))).cast("long").alias("nr_words"), F.size("_s").cast("long").alias("nr_sentences"),
        F.array_max("_z").cast("long").alias("longest_word_length"), F.round(F.aggregate("_z", F.lit(0).cast("long"), lambda a, z: a + z) / F.size("_z"), 6).alias("average_word_length"),
        F.round(array_entropy(F.col("_h")), 6).alias("unigram_entropy"), F.round(array_entropy(grams(2)), 6).alias("bigram_entropy"), F.round(array_entropy(grams(3)), 6).alias("trigram_entropy"),
        F.round(F.size(F.array_distinct("_h")) / F.size("_h"), 6).alias("type_token_ratio"), F.round(reading_ease(F.col("_w"), F.size("_s")), 6).alias("flesch_reading_ease_score"),
    )


def suffixed(df: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(f"{c}_{suffix}") for c in df.columns if c not in keys])


def merged(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, FEATURES, unigram_distance): the features of a document and its distance to the rest of the corpus, in one join on the key."""
    return piece_features(df, [key]).join(corpus_distance(N.counts(df, 1, 2, key), key).withColumnRenamed("distance", "unigram_distance"), key, "left")


def level(df: DataFrame, name: str, key: str = "doc_id", size: int = 100) -> DataFrame:
    """A table of features: book, chunk, baac (books with the means of their chunks) or cacb (chunks with the features of their book)."""
    book = suffixed(piece_features(df, [key]), [key], "full") if name != "chunk" else None
    if name == "book":
        return book
    pieces = segment.chunk_rows(df, key, size=size).select(key, "chunk_idx", F.array_join("sentences", " ").alias("text"), "sentences")
    chunk = suffixed(piece_features(pieces, [key, "chunk_idx"], sentences="sentences"), [key, "chunk_idx"], "chunk")
    if name == "chunk":
        return chunk
    if name == "cacb":
        return chunk.join(book, key)
    # sums of whole millionths are exact in any order
    mean = lambda c: F.floor(F.sum(F.round(F.col(c) * 1e6)) / F.count(c) + 0.5) / 1e6
    return book.join(chunk.groupBy(key).agg(*[mean(f"{c}_chunk").alias(f"{c}_chunk") for c in FEATURES]), key)


def levels(df: DataFrame, key: str = "doc_id", size: int = 100) -> dict[str, DataFrame]:
    """The four tables of features."""
    return {name: level(df, name, key, size) for name in ("book", "chunk", "baac", "cacb")}


def merged(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, FEATURES, unigram_distance): the features of a document and its distance to the rest of the corpus, in one join on the key."""
    return piece_features(df, [key]).join(corpus_distance(N.counts(df, 1, 2, key), key).withColumnRenamed("distance", "unigram_distance"), key, "left")


def levels(df: DataFrame, key: str = "doc_id", size: int = 100) -> dict[str, DataFrame]:
    """The four tables of features: of books, of chunks, of books with the means of their chunks, and of chunks with those of their book."""
    book = written(suffixed(piece_features(df, [key]), [key], "full"))
    parts = written(segment.chunk_rows(df, key, size=size))
    pieces = parts.select(key, "chunk_idx", F.array_join("sentences", " ").alias("text"), "sentences")
    chunk = written(suffixed(piece_features(pieces, [key, "chunk_idx"], sentences="sentences"), [key, "chunk_idx"], "chunk"))
    # sums of whole millionths are exact in any order
    mean = lambda c: F.floor(F.sum(F.round(F.col(c) * 1e6)) / F.count(c) + 0.5) / 1e6
    means = chunk.groupBy(key).agg(*[mean(f"{c}_chunk").alias(f"{c}_chunk") for c in FEATURES])
    return {"book": book, "chunk": chunk, "baac": book.join(means, key), "cacb": chunk.join(book, key)}


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: nulls, zeros, negatives and distinct values, in one pass."""
    aggs = []
    for c in columns:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}|n"), F.count_if(F.col(c) == 0).alias(f"{c}|z"), F.count_if(F.col(c) < 0).alias(f"{c}|m"), F.count_distinct(c).alias(f"{c}|d")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}|n").alias("n_null"), F.col(f"{c}|z").alias("n_zero"), F.col(f"{c}|m").alias("n_negative"), F.col(f"{c}|d").alias("n_distinct")) for c in columns])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r): Pearson correlation of each pair of columns, over rows where neither is negative or null."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    ok = lambda a, b, c: F.when((F.col(a) >= 0) & (F.col(b) >= 0), F.col(c))
    one = df.agg(*[F.corr(ok(a, b, a), ok(a, b, b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(f"r{i}", 6).alias("r")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def minmax(df: DataFrame, columns: list[str]) -> DataFrame:
    """columns scaled to their range; null where the range is 0. The one row of ends is broadcast."""
    ends = df.agg(*[F.min(c).alias(f"_a_{c}") for c in columns], *[F.max(c).alias(f"_b_{c}") for c in columns])
    scaled = {c: (F.col(c) - F.col(f"_a_{c}")) / F.nullif(F.col(f"_b_{c}") - F.col(f"_a_{c}"), F.lit(0.0)) for c in columns}
    return df.crossJoin(F.broadcast(ends)).withColumns(scaled).select(*df.columns)
