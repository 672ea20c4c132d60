"""Queries against their SQL on the smallest tables, and the contract of the entry module."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pytest

from conftest import DATA

duckdb = pytest.importorskip("duckdb")
#: A query of each family; the driver compares all of them.
CHOSEN = [
    "scan_documents", "clean_text", "rule_replace", "sentences", "chunk_greedy", "chunk_balanced", "chunk_text", "chunk_ngrams", "ngram_tables", "features_book", "features_baac", "features_cacb", "feature_merge", "outlier_score", "bigram_counts", "mfw_top", "feat_entropy_2", "stepwise_distance", "overlap_score",
    "unigram_distance_limited", "tag_ngrams_rel", "delta_burrows", "delta_linear", "cosine_sim", "sparsify_authormin", "sparsify_simmel", "connected_components", "dbscan_labels", "lpa",
    "modularity", "silhouette", "ari", "nmi", "kruskal_h", "ext_silhouette", "cluster_sizes_rle", "topeval_pipeline", "max_cluster_filter", "spearman", "levenshtein_match", "line_lists", "matrix_file", "rule_table_replace", "fuzzy_sentences", "centralities", "random_simmelian", "author_texts", "baseline_guesses", "ami", "anova_p", "group_kfold", "eval_rows", "hashed_vectors", "classification_metrics", "near_dup_jaccard",
]


def plain(v):
    if v is None:
        return "NULL"
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(plain, v)) + "]"
    try:
        if pd.isna(v):
            return "NULL"
    except (TypeError, ValueError):
        pass
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating)):
        return f"{float(v):.5f}".replace("-0.00000", "0.00000")
    return str(v)


def rows(df: pd.DataFrame):
    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", CHOSEN)
def test_against_sql(spark, con, name):
    import __spark_entry__ as entry

    got = entry.queries()[name](spark, DATA).toPandas()
    want = con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_sql_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 180


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["doc_id", "other", "value"]


def test_nothing_imports_the_subpackage():
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for p in (root / "quillspark").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "quillspark.llm" not in p.read_text()


def test_levenshtein_match_against_sql(spark):
    import __spark_entry__ as entry

    data = DATA.replace("0.001", "0.01")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW metadata AS SELECT * FROM '{data}/metadata.parquet'")
    got = rows(entry.queries()["levenshtein_match"](spark, data).toPandas())
    assert got == rows(c.sql(entry.oracle_sql()["levenshtein_match"]).df())
    assert len(got) > 90
