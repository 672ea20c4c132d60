"""Splitting texts into sentences, tokens and chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T


def sentence_rows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sent_idx from 0, sentence). Null and empty texts give no rows."""
    return df.select(key, F.posexplode(T.sentences(F.col(text))).alias("sent_idx", "sentence"))


def token_rows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tok_idx from 0, token): words and single marks. Null and empty texts give no rows."""
    return df.select(key, F.posexplode(T.tokens(F.col(text))).alias("tok_idx", "token"))


def quote_repair(sents: DataFrame, key: str = "doc_id") -> DataFrame:
    """A quotation mark that opens at the end of a sentence moves to the start of the next one.

    The window holds one document's sentences.
    """
    w = Window.partitionBy(key).orderBy("sent_idx")
    stray = F.col("sentence").rlike(r" '$")
    before = F.coalesce(F.lag(stray).over(w), F.lit(False))
    body = F.when(stray, F.regexp_replace("sentence", r" '$", "")).otherwise(F.col("sentence"))
    return sents.select(key, "sent_idx", F.when(before, F.concat(F.lit("'"), body)).otherwise(body).alias("sentence"))


def sentence_lengths(sents) -> Column:
    """White-space tokens of each sentence of an array."""
    return F.transform(sents, lambda s: F.size(F.split(s, r"[ \t\n\r\f]+")))


def greedy(lengths, size: int = 100) -> Column:
    """Chunk number of each sentence: whole sentences are packed until a chunk has size tokens; a fold in the JVM."""
    zero = F.struct(F.lit(0).alias("cur"), F.lit(0).alias("k"), F.array().cast("array<int>").alias("ids"))

    def step(s, n):
        full = s["cur"] >= size
        k = F.when(full, s["k"] + 1).otherwise(s["k"])
        return F.struct(F.when(full, n).otherwise(s["cur"] + n).alias("cur"), k.alias("k"), F.concat(s["ids"], F.array(k)).alias("ids"))

    return F.aggregate(lengths, zero, step, lambda s: s["ids"])


def balanced(lengths: list[int], size: int) -> list[int]:
    """Chunk number of each sentence, the short rest spread over the chunks before it.

    Packing goes on until a chunk has its limit. A rest of more than nine tenths of size stays a chunk, one of
    at most a tenth joins the last chunk. Any other rest is spread: the limits of the first m chunks grow by d
    tokens, for d from 1 to 50 and m from 1 on while the last try had more than m full chunks, until the rest is
    one of the two cases. Failing that, the first packing's rest stays if it has half of size, else it joins.
    A text that doesn't fill one chunk is one.
    """

    def pack(more: int, by: int) -> tuple[list[int], int]:
        out, chunk, have = [], 0, 0
        for n in lengths:
            if have >= size + (by if chunk < more else 0):
                chunk, have = chunk + 1, 0
            out.append(chunk)
            have += n
        return out, have

    def settle(ids: list[int], tail: int) -> list[int] | None:
        if tail > 0.9 * size or ids[-1] == 0:
            return ids
        return [min(k, ids[-1] - 1) for k in ids] if tail <= 0.1 * size else None

    if not lengths:
        return []
    first = ids, tail = pack(0, 0)
    done = settle(ids, tail)
    for by in range(1, 51):
        more = 1
        while done is None and ids[-1] > more:
            ids, tail = pack(more, by)
            done = settle(ids, tail)
            more += 1
    if done is not None:
        return done
    ids, tail = first
    return ids if tail >= size // 2 else [min(k, ids[-1] - 1) for k in ids]


def chunk_rows(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 100, method: str = "balanced") -> DataFrame:
    """(key, chunk_idx, n_sents, n_tokens, sentences): the chunks of each text, none of which crosses a document's row.

    method is greedy (packed by a fold in the JVM) or balanced (the loop needs a document's lengths only, which
    go out in Arrow batches). Null and empty texts give no rows.
    """

    @F.pandas_udf("array<int>")
    def ids(lengths: pd.Series) -> pd.Series:
        return lengths.map(lambda x: balanced([int(v) for v in x], size))

    base = df.select(key, T.sentences(F.col(text)).alias("_s")).where(F.size("_s") > 0)
    base = base.select(key, "_s", sentence_lengths(F.col("_s")).alias("_n"))
    packed = base.withColumn("_k", greedy(F.col("_n"), size) if method == "greedy" else ids("_n"))
    # a chunk's sentences lie side by side: from the first place of its number on
    last = F.element_at("_k", -1)
    each = packed.select(key, "_s", "_n", "_k", F.explode(F.sequence(F.lit(0), last)).alias("chunk_idx"))
    at = F.array_position("_k", F.col("chunk_idx")).cast("int")
    many = F.size(F.filter("_k", lambda k: k == F.col("chunk_idx")))
    cut = each.select(key, "chunk_idx", F.slice("_s", at, many).alias("sentences"), F.slice("_n", at, many).alias("_n"))
    return cut.select(key, "chunk_idx", F.size("sentences").cast("long").alias("n_sents"), F.aggregate("_n", F.lit(0).cast("long"), lambda a, n: a + n).alias("n_tokens"), "sentences")


def chunk_text(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, chunk_idx, text): the sentences of each chunk, joined by a space."""
    return chunks.select(key, "chunk_idx", F.array_join("sentences", " ").alias("text"))


def greedy_chunks(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 100) -> DataFrame:
    """(key, chunk_idx, n_sents, n_tokens) by greedy packing. The last chunk may be short."""
    return chunk_rows(df, key, text, size, "greedy").drop("sentences")


def balanced_chunks(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 100) -> DataFrame:
    """(key, chunk_idx, n_sents, n_tokens) by balanced packing."""
    return chunk_rows(df, key, text, size, "balanced").drop("sentences")
