"""N-gram counts, document frequencies, frequency tables and vectors of the most frequent words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.session import once


def grams(words: Column, n: int) -> Column:
    """The runs of n words of an array, joined by a hyphen; an array shorter than n has none."""
    if n == 1:
        return words
    last = F.size(words) - (n - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, n), "-"))).otherwise(F.array().cast("array<string>"))


def counts(df: DataFrame, n: int = 1, min_df: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ngram, cnt) in long form; n-grams in fewer than min_df documents are left out.

    Documents without words have no rows. The frequent n-grams are counted per task before the shuffle.
    """
    rows = df.select(key, T.words(F.col(text)).alias("_w")).select(key, F.explode(grams(F.col("_w"), n)).alias("ngram"))
    out = rows.groupBy(key, "ngram").agg(F.count("*").alias("cnt"))
    return df_filter(out, min_df) if min_df > 1 else out


def piece_counts(df: DataFrame, keys: list[str], most: int = 3, text: str = "text") -> DataFrame:
    """(keys, n, ngram, cnt) for n from 1 to most: the texts are read and cut into words once."""
    rows = df.select(*keys, T.words(F.col(text)).alias("_w"))
    tagged = lambda n: F.transform(grams(F.col("_w"), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("ngram")))
    each = F.flatten(F.array(*[tagged(n) for n in range(1, most + 1)]))
    flat = rows.select(*keys, F.explode(each).alias("x")).select(*keys, "x.n", "x.ngram")
    return flat.groupBy(*keys, "n", "ngram").agg(F.count("*").alias("cnt"))


def df_filter(cnt: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """The rows of n-grams whose document frequency is between low and high; both ends count.

    The counts are written first, since they are read twice; the corpus is then read once.
    """
    cnt = once(cnt)
    freq = cnt.groupBy("ngram").agg(F.count("*").alias("_df"))
    if low is not None:
        freq = freq.where(F.col("_df") >= low)
    if high is not None:
        freq = freq.where(F.col("_df") <= high)
    return cnt.join(freq.select("ngram"), "ngram", "left_semi")


def percent_bounds(n_docs: int, low: float, high: float) -> tuple[int, int]:
    """Document frequencies from percentages, rounded half to even."""
    return round(low / 100 * n_docs), round(high / 100 * n_docs)


def totals(cnt: DataFrame) -> DataFrame:
    return cnt.groupBy("ngram").agg(F.sum("cnt").alias("total"), F.count("*").alias("df"))


def relative(cnt: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ngram, rel): share of the document's n-grams."""
    cnt = once(cnt)
    size = cnt.groupBy(key).agg(F.sum("cnt").alias("_n"))
    return cnt.join(size, key).select(key, "ngram", (F.col("cnt") / F.col("_n")).alias("rel"))


def most_frequent(cnt: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """(ngram, rank from 1, weight): the n words with the greatest sum of relative frequencies, rounded to 9 digits.

    The sort of a limit keeps n rows a task; n is the bound of the result.
    """
    total = relative(cnt, key).groupBy("ngram").agg(F.round(F.sum("rel"), 9).alias("weight"))
    top = total.orderBy(F.desc("weight"), "ngram").limit(n)
    return top.select("ngram", F.row_number().over(Window.orderBy(F.desc("weight"), "ngram")).alias("rank"), "weight")


def vectors(cnt: DataFrame, n: int, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(key, vec ARRAY<DOUBLE>) of the n most frequent words by rank, zeros included, and the list of words.

    The list has n rows whatever the corpus, so it is broadcast. Documents that have words, but none of
    these, have a vector of zeros.
    """
    cnt = once(cnt)
    words = once(most_frequent(cnt, n, key))
    size = cnt.groupBy(key).agg(F.sum("cnt").alias("_n"))
    hit = cnt.join(F.broadcast(words.select("ngram", "rank")), "ngram").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("rank", "cnt"))).alias("_m"))
    both = size.join(hit, key, "left")
    width = words.agg(F.max("rank").alias("_width"))
    vec = F.transform(F.sequence(F.lit(1), F.col("_width")), lambda i: F.coalesce(F.try_element_at("_m", i) / F.col("_n"), F.lit(0.0)))
    return both.crossJoin(F.broadcast(width)).select(key, vec.alias("vec")), words


def sparse_vectors(cnt: DataFrame, n: int, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """vectors() without its zeros: (key, at ARRAY<INT> from 0 by rank, x ARRAY<DOUBLE>), and the list of words."""
    cnt = once(cnt)
    words = once(most_frequent(cnt, n, key))
    # n rows at most
    hit = cnt.join(F.broadcast(words.select("ngram", "rank")), "ngram", "left").groupBy(key).agg(F.sum("cnt").alias("_n"), F.sort_array(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", "cnt")))).alias("_m"))
    return hit.select(key, F.transform("_m", lambda m: (m["rank"] - 1).cast("int")).alias("at"), F.transform("_m", lambda m: m["cnt"] / F.col("_n")).alias("x")), words


def zipf(total: DataFrame) -> DataFrame:
    """(ngram, total, rank, expected): expected is the greatest total over the rank."""
    from quillspark.operators.numbering import numbered

    ranked = numbered(total, "rank", F.desc("total"), F.asc("ngram"), start=1)
    top = total.agg(F.max("total").alias("_top"))
    return ranked.crossJoin(F.broadcast(top)).select("ngram", "total", "rank", F.round(F.col("_top") / F.col("rank"), 6).alias("expected"))
