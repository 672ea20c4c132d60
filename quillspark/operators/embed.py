"""Vectors of sentences, documents and nodes: offline stand-ins with the same shapes as trained encoders."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Word2Vec
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import kernels
from quillspark.session import written


def hashed_vectors(df: DataFrame, key: str | list[str] = "doc_id", text: str = "text", dim: int = 64) -> DataFrame:
    """(key, vec): words are added to or taken from the number their hash names, and the sum scaled to length 1.

    The seeded random projection of the word counts; the hash is the first 32 bits of MD5, so any engine can check
    it. A text without words has a vector of zeros. key may be several columns.
    """
    keys = [key] if isinstance(key, str) else list(key)
    words = df.select(*keys, F.explode(T.words(F.col(text))).alias("w")).groupBy(*keys, "w").agg(F.count("*").alias("n"))
    h = F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long")
    part = words.groupBy(*keys, F.pmod(h, F.lit(dim)).alias("j")).agg(F.sum(F.when(F.floor(h / dim) % 2 == 0, F.col("n")).otherwise(-F.col("n"))).cast("double").alias("x"))
    packed = part.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("j", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("len"))
    vec = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long")), lambda j: F.coalesce(F.try_element_at("m", j) / F.nullif("len", F.lit(0.0)), F.lit(0.0)))
    zero = F.array_repeat(F.lit(0.0), dim)
    return df.select(*keys).join(packed.select(*keys, vec.alias("vec")), keys, "left").select(*keys, F.coalesce("vec", zero).alias("vec"))


def document_vectors(df: DataFrame, key: str = "doc_id", text: str = "text", dim: int = 32, seed: int = 42) -> DataFrame:
    """(key, vec): mean of the skip-gram vectors of a document's words, the stand-in for paragraph vectors."""
    words = df.select(key, T.words(F.col(text)).alias("words")).where(F.size("words") > 0)
    model = Word2Vec(vectorSize=dim, windowSize=5, minCount=5, seed=seed, maxIter=1, inputCol="words", outputCol="v").fit(words)
    from pyspark.ml.functions import vector_to_array

    return model.transform(words).select(key, vector_to_array("v").alias("vec"))


def term_hashes(df: DataFrame, key: str = "doc_id", text: str = "text", dim: int = 4096) -> DataFrame:
    """(key, features): Spark ML's hashed word counts, for estimators."""
    words = df.select(key, T.words(F.col(text)).alias("words"))
    return HashingTF(numFeatures=dim, inputCol="words", outputCol="features").transform(words.where("words IS NOT NULL")).select(key, "features")


def walks(edges: DataFrame, per_node: int = 10, length: int = 8, p: float = 1.0, q: float = 1.0, seed: int = 7) -> DataFrame:
    """(start, walk, path): second-order random walks; the draw of a step is a hash of seed, start, walk and step.

    Each step is a join of the walks with the edges of where they stand: a neighbour's key is the
    hashed uniform to the power 1 / weight, and the greatest wins, so a step is one aggregate and a
    node with many neighbours is reduced before the shuffle. Walks end where no edge leads on.
    """
    e = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.col("w").cast("double").alias("w")).where("w > 0")
    e = written(e)
    pairs = written(e.select(F.col("at").alias("prev"), "to").withColumn("near", F.lit(True)).distinct())
    start = e.select(F.col("at").alias("start")).distinct()
    now = start.withColumn("walk", F.explode(F.sequence(F.lit(1), F.lit(per_node)))).withColumns({"at": F.col("start"), "prev": F.lit(None).cast("string"), "path": F.array("start")})
    done = None
    for step in range(1, length):
        j = now.join(e, "at").join(pairs, ["prev", "to"], "left")
        bias = F.when(F.col("prev").isNull(), 1.0).when(F.col("to") == F.col("prev"), 1 / p).when(F.col("near"), 1.0).otherwise(1 / q)
        u = (F.pmod(F.xxhash64(F.lit(seed), "start", "walk", F.lit(step), "to"), F.lit(1 << 40)) + 1) / F.lit(float((1 << 40) + 1))
        best = j.groupBy("start", "walk").agg(F.max(F.struct((F.ln(u) / (F.col("w") * bias)).alias("k"), "to", "at", "path")).alias("b"))
        moved = best.select("start", "walk", F.col("b.to").alias("at"), F.col("b.at").alias("prev"), F.concat("b.path", F.array("b.to")).alias("path"))
        ended = now.join(best.select("start", "walk"), ["start", "walk"], "left_anti").select("start", "walk", "path")
        done = ended if done is None else done.unionByName(ended)
        now = written(moved)
    out = now.select("start", "walk", "path")
    return out if done is None else out.unionByName(done)


def _node_vectors(paths: DataFrame, dim: int, seed: int) -> DataFrame:
    model = Word2Vec(vectorSize=dim, windowSize=10, minCount=0, seed=seed, inputCol="path", outputCol="v").fit(paths)
    from pyspark.ml.functions import vector_to_array

    return model.getVectors().select(F.col("word").alias("node"), vector_to_array("vector").alias("vec"))


def node2vec(edges: DataFrame, dim: int = 32, per_node: int = 10, length: int = 8, p: float = 1.0, q: float = 1.0, seed: int = 7) -> DataFrame:
    """(node, vec): skip-gram vectors of the nodes over their walks."""
    return _node_vectors(walks(edges, per_node, length, p, q, seed), dim, seed)


def structure_walks(edges: DataFrame, per_node: int = 10, length: int = 8, seed: int = 7) -> DataFrame:
    """(start, walk, path): walks over the layers of structural likeness of an undirected network, from 0 hops to its diameter.

    All nodes are compared with all on every layer, so the network is one matrix in one task, as for the clustering kernels.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["src"]) | set(pdf["dst"]))
        at = {x: i for i, x in enumerate(names)}
        a = np.zeros((len(names), len(names)), dtype=bool)
        a[pdf["src"].map(at), pdf["dst"].map(at)] = True
        paths = kernels.structural_walks(kernels.structural_costs(a), per_node, length, seed)
        return pd.DataFrame({"start": [names[p[0]] for p in paths], "walk": [i % per_node + 1 for i in range(len(paths))], "path": [[names[i] for i in p] for p in paths]})

    e = edges.where("w > 0 AND src <> dst").select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    return e.groupBy(F.lit(1).alias("k")).applyInPandas(run, "start string, walk int, path array<string>")


def struc2vec(edges: DataFrame, dim: int = 32, seed: int = 7) -> DataFrame:
    """(node, vec): skip-gram vectors over structure_walks()."""
    return _node_vectors(written(structure_walks(edges, seed=seed)), dim, seed)
