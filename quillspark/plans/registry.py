"""All registered queries of the core operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules of quillspark.plans that register queries.
MODULES = ("text_queries", "ngram_queries", "graph_queries", "eval_queries", "meta_queries", "model_queries", "file_queries", "extra_queries")

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


#: Columns of the SQL whose type differs from Spark's BIGINT: sums are HUGEINT in DuckDB, literals INTEGER.
_LONG = {
    "chunk_greedy": ["n_tokens"],
    "chunk_stats": ["shortest", "longest"],
    "chunk_count_freq": ["n_chunks"],
    "df_filter": ["total"],
    "word_totals": ["total"],
    "zipf": ["total"],
    "bfs_hops": ["hops"],
    "diameter": ["diameter"],
    "eval_with_isolates": ["isolate_cluster"],
    "param_grid": ["n"],
    "label_counts": ["cluster"],
    "ordinal_bins": ["canon_cat", "year_cat"],
    "metadata_join": ["gender"],
    "binary_label": ["label"],
}


def register(name: str, query: Query, sql: str | None = None) -> None:
    if name in _queries:
        raise ValueError(f"query {name} is registered twice")
    _queries[name] = query
    if sql and name in _LONG:
        sql = f"SELECT * REPLACE ({', '.join(f'{c}::BIGINT AS {c}' for c in _LONG[name])}) FROM ({sql})"
    if sql:
        _sql[name] = sql


def queries() -> dict[str, Query]:
    load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(_sql)


def load() -> None:
    """Import the modules that register queries."""
    from importlib import import_module

    for name in MODULES:
        import_module(f"quillspark.plans.{name}")
