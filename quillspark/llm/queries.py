"""The pN_ queries over whole tables, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import chunking, clusters, leaks, names, quality, scans, splits, tokenize
from quillspark.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.pairs(names.link(table(spark, sf_dir, "metadata")))


def _feature_columns(df: DataFrame) -> list[str]:
    return [c for c, kind in df.dtypes if c.endswith("_full") and kind == "double"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "features")
    members, _ = clusters.clusters(df, _feature_columns(df))
    return clusters.pairs(members)


def p2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "features")
    return clusters.clusters(df, _feature_columns(df))[1]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.groups(table(spark, sf_dir, "metadata")).where("first_text_id <> text_id")


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign(splits.groups(table(spark, sf_dir, "metadata")), {"train": 0.8, "validation": 0.1, "test": 0.1})


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.pieces(table(spark, sf_dir, "text_raw"), table(spark, sf_dir, "features"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = chunking.pieces(table(spark, sf_dir, "text_raw"), table(spark, sf_dir, "features"), with_text=False)
    return cut.where((F.col("piece_no") == 1) & (F.col("n_pieces") > 1)).select("text_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.found(table(spark, sf_dir, "text_raw"))


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repaired(table(spark, sf_dir, "text_raw"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode_corpus(table(spark, sf_dir, "documents"))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.decode_corpus(p6_ids(spark, sf_dir))


P4_SQL = """
WITH t AS (
  SELECT text_id, arg_max(text, received_at) AS text FROM text_raw GROUP BY text_id
), f AS (
  SELECT text_id, tokens_per_chunk FROM features
  QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY computed_at DESC) = 1
)
SELECT text_id FROM t JOIN f USING (text_id)
WHERE len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')) > tokens_per_chunk
"""


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.found(table(spark, sf_dir, "documents"))


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.statistics(table(spark, sf_dir, "documents"))


def p8_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.layout(table(spark, sf_dir, "documents"))


_KNOWN = ", ".join(f"'{w}'" for w in sorted(quality.COMMON))
P8_SQL = rf"""
WITH w AS (
  SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: length(trim(regexp_replace(x, '[ \t\r\f]+', ' ', 'g'))) > 0) AS lines
  FROM documents
)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN len(words) END AS n_words,
       round(list_sum(list_transform(words, lambda x: length(x))) / nullif(len(words), 0), 6) AS mean_word_length,
       round(length(regexp_replace(text, '[\p{{L}}\p{{N}}_\s]', '', 'g')) / nullif(length(text), 0), 6) AS symbol_ratio,
       round(len(list_filter(lines, lambda x: regexp_matches(x, '[.!?:;,]["''”’»)]*[ \t\r\f]*$'))) / nullif(len(lines), 0), 6) AS ended_lines,
       round(len(list_filter(words, lambda x: x IN ({_KNOWN}))) / nullif(len(words), 0), 6) AS common_share
FROM w
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p2_clusters": p2_clusters, "p2_found": p2_found, "p3_found": p3_found, "p3_splits": p3_splits, "p4_found": p4_found, "p4_pieces": p4_pieces, "p5_found": p5_found, "p5_repaired": p5_repaired, "p6_decoded": p6_decoded, "p6_ids": p6_ids, "p7_found": p7_found, "p8_found": p8_found, "p8_layout": p8_layout, "p8_statistics": p8_statistics}


def oracle_sql() -> dict[str, str]:
    return {"p4_found": P4_SQL, "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents", "p8_statistics": P8_SQL}
