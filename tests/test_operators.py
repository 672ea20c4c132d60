"""Operators against brute force on small tables, with nulls, ties, repeated rows and empty tables."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import special
from quillspark.operators import distance, embed, evaluate, experiments, features, graph, kernels, metadata, neardup, ngrams, segment, validation
from quillspark.operators.components import components
from quillspark.operators.numbering import numbered
from quillspark.sources import files
from quillspark.streaming import wordcount

DOCS = "doc_id long, text string, lang string, source string, n_chars long, added_at timestamp"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), None) for i, t in enumerate(texts)], DOCS)


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (None, 3)] * 2
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_numbered(spark):
    df = spark.createDataFrame([(x % 7, x) for x in range(500)], "g int, x int")
    got = numbered(df, "no", "g", F.desc("x"), start=1).orderBy("no").collect()
    assert [(r["g"], r["x"]) for r in got] == sorted(((x % 7, x) for x in range(500)), key=lambda t: (t[0], -t[1]))
    assert [r["no"] for r in got] == list(range(1, 501))
    assert numbered(df.where("x < 0"), "no", "x").count() == 0


def test_odd_texts(spark):
    d = docs(spark, [None, "", "   ", "One two. Three!", "x" * 50_000, "A b. " * 300])
    assert {r["doc_id"] for r in segment.sentence_rows(d).collect()} == {3, 4, 5}
    chunks = segment.greedy_chunks(d, size=10).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in chunks} == {3: 3, 4: 1, 5: 600}
    assert ngrams.counts(d, 3).where("doc_id < 3").count() == 0
    assert ngrams.vectors(ngrams.counts(d), 5)[0].count() == 3
    assert ngrams.counts(d.where("doc_id < 0")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=60), st.integers(5, 60))
def test_balanced_keeps_all_sentences(lengths, size):
    ids = segment.balanced(lengths, size)
    assert len(ids) == len(lengths) and ids[0] == 0
    assert all(b - a in (0, 1) for a, b in zip(ids, ids[1:]))


def test_distances(spark):
    rng = np.random.default_rng(2)
    x = rng.random((30, 8)) * (rng.random((30, 8)) > 0.3)
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "doc_id long, vec array<double>")
    got = {(r["doc_id"], r["other"]): r["value"] for r in distance.block_pairs(v, v.where("doc_id < 3"), "burrows").collect()}
    s = x.std(axis=0, ddof=1)
    assert len(got) == 3 * 29
    for (a, b), d in got.items():
        assert d == pytest.approx((np.abs(x[a] - x[b]) / s).mean(), abs=1e-5)
    for m in distance.METRICS:
        top = distance.nearest(v, v.where("doc_id = 1"), m, 5).collect()
        assert [r["rank"] for r in sorted(top, key=lambda r: r["rank"])] == [1, 2, 3, 4, 5]
    assert distance.nearest(v, v.where("doc_id < 0"), "manhattan").count() == 0
    assert distance.nearest(v.unionAll(v), v.where("doc_id = 1"), "manhattan").count() == 10


def test_distances_in_blocks(spark, monkeypatch):
    """Blocks of queries and rows as tables give what one broadcast block gives."""
    rng = np.random.default_rng(5)
    x = np.round(rng.random((60, 6)), 1)
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "doc_id long, vec array<double>")
    for m in ("burrows", "cosinesim", "linear"):
        one = sorted(map(tuple, distance.nearest(v, v.where("doc_id % 2 = 0"), m, 4).collect()))
        monkeypatch.setattr(distance, "BLOCK", 7)
        monkeypatch.setattr(distance, "BLOCK_CELLS", 100)
        assert sorted(map(tuple, distance.nearest(v, v.where("doc_id % 2 = 0"), m, 4).collect())) == one
        assert distance.block_pairs(v, v.where("doc_id < 9"), m).count() == 9 * 59
        monkeypatch.undo()


def test_a_task_keeps_the_nearest_of_all_its_rows(spark):
    """Of many batches a task gives away k rows a query, not k a batch; pairs found by sums are those of the kernel."""
    rng = np.random.default_rng(8)
    x = np.round(rng.random((600, 12)) * (rng.random((600, 12)) < 0.4), 2)
    x[300:330] = x[:30]
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "_key long, vec array<double>").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        for m in ("burrows", "canberra", "cosinedelta", "linear", "euclid"):
            got = distance.against(v, v.where("_key % 60 = 0").withColumn("k", F.lit(4)), m, k="k").collect()
            all_ = distance.against(v, v.where("_key % 60 = 0"), m).collect()
            want = []
            for q in range(0, 600, 60):
                mine = [tuple(r) for r in all_ if r["query"] == q]
                assert len(mine) == 600
                last = sorted(d for _, _, d in mine)[3]
                want += [r for r in mine if r[2] <= last]
            assert sorted(map(tuple, got)) == sorted(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_widths_in_one_pass(spark, monkeypatch):
    """Sparse vectors, over any number of blocks and parts of queries, give what dense ones give a width."""
    rng = np.random.default_rng(9)
    text = [(i, " ".join(f"w{int(w)}" for w in rng.zipf(1.3, 30) % 200)) for i in range(60)]
    cnt = ngrams.counts(spark.createDataFrame(text, "doc_id long, text string")).cache()
    sparse, words = ngrams.sparse_vectors(cnt, 80)
    sparse = sparse.cache()
    want = set()
    for w in (10, 40, 500):
        v = ngrams.vectors(cnt, min(w, 80))[0]
        want |= {(w, *tuple(r)) for r in distance.nearest(v, v.where("doc_id % 4 = 0"), "burrows", 2).select("doc_id", "other", "value").collect()}
    monkeypatch.setattr(distance, "SPARSE_BLOCK", 4)
    monkeypatch.setattr(distance, "QUERIES", 6)
    got = distance.nearest_widths(sparse, sparse.where("doc_id % 4 = 0"), words.count(), (10, 40, 500), 2)
    assert {tuple(r) for r in got.collect()} == want and len(want) == 90
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan  # no vector is made dense by Spark


def test_cross_check_joins_no_pairs(spark):
    from conftest import DATA
    from quillspark.plans import registry

    out = registry.queries()["metric_cross_check"](spark, DATA)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan  # only one-row tables are put beside the rows
    n, agree = out.first()
    assert n > 0 and agree


def test_two_ways_measure_every_pair(spark, tmp_path):
    """Both ways give the sums of the gaps in single and double precision, a difference is seen, and no pairs agree as in SQL."""
    from quillspark.plans import registry

    rng = np.random.default_rng(10)
    for least in (0.0, 1000.0):  # the second is summed in double precision
        x = rng.random((90, 7)) * (rng.random((90, 7)) < 0.4) + least
        v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "_key long, vec array<double>")
        sd = x.std(axis=0, ddof=1)
        want = np.abs(x[:, None] / sd - x[None] / sd).mean(axis=2)
        for part in (v.where("_key % 3 = 0"), v.where("_key < 0")):
            got = distance.two_ways(v, part, sd).collect()
            n = part.count()
            assert sum(r["n"] for r in got) == n * 89 and max(r["gap"] for r in got) < 1e-5
            assert max(r["top"] for r in got) == pytest.approx(want[::3].max() if n else 0, abs=1e-5)
        assert max(r["gap"] for r in distance.two_ways(v, v.where("_key % 3 = 0"), sd * 1e-4).collect()) > 1
    spark.createDataFrame([(1, "a b a"), (2, "b c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert tuple(registry.queries()["metric_cross_check"](spark, str(tmp_path)).first()) == (0, True)


def test_overlap_of_a_large_book(spark):
    rng = np.random.default_rng(6)
    x = [(i, "big" if i < 40 else f"b{i % 4}", [float(v) for v in rng.random(3)]) for i in range(80)]
    d = spark.createDataFrame(x, "vec_id long, label string, embedding array<float>")
    got = {r["label"]: r["overlap"] for r in features.overlap(d).collect()}
    m = np.array([np.array(v, dtype=np.float32).astype(float) for _, _, v in x])
    for b in {l for _, l, _ in x}:
        own = [i for i, l, _ in x if l == b]
        near = sorted((round(float(np.linalg.norm(m[i] - m[own].mean(axis=0))), 9), i) for i in range(80))[: len(own)]
        assert got[b] == pytest.approx(np.mean([x[i][1] != b for _, i in near]), abs=1e-6)


def test_label_free_graph(spark):
    none = spark.createDataFrame([], "src string, dst string, w double")
    assert graph.threshold(none, 0.9).count() == 0
    assert graph.backbone(none, 3, 1).count() == 0
    assert graph.bfs(none, graph.nodes_of(none)).count() == 0


def test_ami_and_special():
    a = pd.DataFrame({"run": 1, "cluster": [0, 0, 1, 1], "attr": ["x", "y", "x", "y"], "n": [10, 2, 3, 9]})
    t = a.pivot(index="cluster", columns="attr", values="n").to_numpy(float)
    labels = [(i, j) for i in range(2) for j in range(2) for _ in range(int(t[i, j]))]
    rng, values = np.random.default_rng(0), []
    c, k = np.array([x for x, _ in labels]), np.array([y for _, y in labels])

    def mi(p, q):
        m = np.array([[((p == i) & (q == j)).sum() for j in range(2)] for i in range(2)]) / len(p)
        return sum(m[i, j] * math.log(m[i, j] / (m[i].sum() * m[:, j].sum())) for i in range(2) for j in range(2) if m[i, j] > 0)

    for _ in range(3000):
        values.append(mi(c, rng.permutation(k)))
    h = lambda v: -sum(p * math.log(p) for p in np.bincount(v) / len(v))
    want = (mi(c, k) - np.mean(values)) / ((h(c) + h(k)) / 2 - np.mean(values))
    assert evaluate._expected_mi(a)["ami"][0] == pytest.approx(want, abs=0.01)
    assert special.f_sf(4.0, 2, 10) == pytest.approx(0.05296, abs=1e-4)
    assert special.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert special.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)


def test_ext_silhouette(spark):
    rng = np.random.default_rng(4)
    rows = [(1, int(c), float(v)) for c, v in zip(rng.integers(0, 4, 60), rng.random(60))] + [(1, 9, 0.5), (2, 0, 1.0), (2, None, 2.0), (2, 0, None)]
    got = {r["run"]: r["ext_silhouette"] for r in evaluate.ext_silhouette(spark.createDataFrame(rows, "run long, cluster int, value double")).collect()}
    pts = [(c, v) for r, c, v in rows if r == 1]
    scores = []
    for i, (c, v) in enumerate(pts):
        own = [abs(v - y) for j, (d, y) in enumerate(pts) if d == c and j != i]
        other = min(np.mean([abs(v - y) for d, y in pts if d == k]) for k in {d for d, _ in pts} - {c})
        scores.append(0 if not own else (other - np.mean(own)) / max(other, np.mean(own)))
    assert got[1] == pytest.approx(np.mean(scores), abs=1e-5) and got[2] is None or np.isnan(got[2])


@pytest.mark.parametrize("method", kernels.LINKAGES)
def test_linkages_find_blobs(method):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(m, 0.05, (12, 2)) for m in ((0, 0), (3, 0), (0, 3))])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    lab = kernels.hierarchical(d, 3, method)
    assert [len(set(lab[i : i + 12])) for i in (0, 12, 24)] == [1, 1, 1] and len(set(lab)) == 3
    assert sorted(kernels.leaf_order(d)) == list(range(36))


def test_other_kernels():
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(m, 0.05, (10, 2)) for m in ((0, 0), (3, 0), (0, 3))])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    lab, chosen, cost = kernels.medoids(d, 3)
    best = min(d[:, list(c)].min(axis=1).sum() for c in itertools.product(range(10), range(10, 20), range(20, 30)))
    assert cost == pytest.approx(best)
    assert len(set(kernels.spectral(np.exp(-d), 3)[:10])) == 1
    assert len(set(kernels.louvain(np.exp(-4 * d) * (d > 0)))) == 3
    y, stress = kernels.mds(d)
    e = np.sqrt(((y[:, None] - y[None]) ** 2).sum(axis=2))
    assert stress < 1e-6 and np.corrcoef(d.ravel(), e.ravel())[0, 1] > 0.999
    assert (kernels.louvain(np.zeros((3, 3))) == [0, 1, 2]).all()


def test_group_folds(spark):
    rng = np.random.default_rng(5)
    rows = [(f"g{g}",) for g, n in enumerate(rng.integers(1, 9, 200)) for _ in range(n)] + [(None,)]
    got = validation.group_folds(spark.createDataFrame(rows, "g string"), "g").collect()
    assert len({r["g"] for r in got}) == len(got) == 200
    load = pd.Series([r["n"] for r in got]).groupby([r["fold"] for r in got]).sum()
    assert len(load) == 5 and load.max() - load.min() <= 8
    assert validation.group_folds(spark.createDataFrame([], "g string"), "g").count() == 0


def test_near_duplicates(spark):
    base = [f"word{i}" for i in range(60)]
    texts = [" ".join(base), " ".join(base), " ".join(base[:-1] + ["other"]), " ".join(f"x{i}" for i in range(60)), None, "", "too short"]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in neardup.classes(docs(spark, texts)).collect()}
    assert got == {0: (0, 1), 1: (0, 1), 2: (0, 1), 3: (3, 0), 4: (4, 0), 5: (5, 0), 6: (6, 0)}


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(11)
    texts = []
    for _ in range(12):
        base = [f"v{i}" for i in rng.integers(0, 60, int(rng.integers(8, 40)))]
        for _ in range(6):
            w = list(base)
            for _ in range(int(rng.integers(0, 3))):
                at = int(rng.integers(len(w)))
                w = w[:at] + [f"y{rng.integers(5)}"] * int(rng.integers(0, 2)) + w[at + 1 :]
            texts.append(" ".join(w))
    sets = [frozenset(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for t in texts]
    links = {i: {sets[j] for j in range(len(sets)) if sets[i] != sets[j] and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in range(len(sets))}
    for hot in (1000, 1):
        monkeypatch.setattr(neardup, "HOT", hot)
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in neardup.classes(docs(spark, texts)).collect()}
        assert {i: n for i, (_, n) in got.items()} == {i: len(x) for i, x in links.items()}
        assert all(got[i][0] == got[j][0] for i in links for j in range(len(sets)) if sets[j] in links[i])


def test_chunks_hold_all_sentences(spark):
    texts = ["One two. Three four five six. Seven. " * 9, "a. " * 40, "alone", None, "", "...", "x y z. " * 3]
    for method in ("greedy", "balanced"):
        rows = segment.chunk_rows(docs(spark, texts), size=10, method=method).orderBy("doc_id", "chunk_idx").collect()
        for i, t in enumerate(texts):
            mine = [r for r in rows if r["doc_id"] == i]
            whole = [s for r in mine for s in r["sentences"]]
            assert [r["chunk_idx"] for r in mine] == list(range(len(mine)))
            assert " ".join(whole).split() == [w for w in (t or "").split() if w.strip(".")]
            assert all(r["n_tokens"] == sum(len(s.split()) for s in r["sentences"]) and r["n_sents"] == len(r["sentences"]) for r in mine)


def test_balanced_packing():
    # a rest over nine tenths stays, one of a tenth joins, others are spread, and what can't be spread is kept from half on
    assert segment.balanced([10] * 3 + [10], 10) == [0, 1, 2, 3]
    assert segment.balanced([10, 10, 1], 10) == [0, 1, 1]
    assert segment.balanced([1] * 25, 10) == [0] * 13 + [1] * 12 or max(segment.balanced([1] * 25, 10)) == 1
    assert segment.balanced([5], 10) == [0] and segment.balanced([], 10) == []
    assert segment.balanced([100, 60], 100) == [0, 1] and segment.balanced([100, 40], 100) == [0, 0]


def test_feature_levels(spark):
    texts = ["One two. Three four five six! Seven? " * 9, "a, b. " * 40, "alone", None, "", "..."]
    t = {k: v.toPandas() for k, v in features.levels(docs(spark, texts), size=10).items()}
    assert set(t["book"]["doc_id"]) == {0, 1, 2} == set(t["baac"]["doc_id"]) and len(t["cacb"]) == len(t["chunk"])
    assert len(t["book"].columns) == 1 + len(features.FEATURES) and len(t["baac"].columns) == 1 + 2 * len(features.FEATURES)
    one = t["book"].set_index("doc_id").loc[0]
    assert one["nr_sentences_full"] == 27 and one["type_token_ratio_full"] == pytest.approx(7 / 63, abs=1e-6)
    assert t["book"].set_index("doc_id").loc[2, "bigram_entropy_full"] != t["book"].set_index("doc_id").loc[2, "bigram_entropy_full"]


def test_checked_join(spark):
    a, b = spark.createDataFrame([(1, "a"), (1, "b")], "k int, x string"), spark.createDataFrame([(1, "c")], "k int, y string")
    assert metadata.checked_join(a, b, ["k"], validate="many_to_one").count() == 2
    with pytest.raises(ValueError):
        metadata.checked_join(a, b, ["k"])


def test_experiment_sizes(spark):
    df = spark.createDataFrame([("300, 2x100, 1",), (None,), ("",), ("bad, 5",)], "s string")
    assert [r[0] for r in df.select(experiments.sizes(F.col("s"))).collect()] == [[300, 100, 100, 1], None, [], [5]]


def test_walks(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 1.0), ("c", "b", 1.0), ("d", "a", 1.0)], "src string, dst string, w double")
    got = embed.walks(e, per_node=3, length=5).collect()
    assert len(got) == 12
    ok = {("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("d", "a")}
    assert all(set(zip(r["path"], r["path"][1:])) <= ok and len(r["path"]) == 5 for r in got)
    assert {tuple(r["path"]) for r in got} == {tuple(r["path"]) for r in embed.walks(e, per_node=3, length=5).collect()}


def test_files(spark, tmp_path):
    for lang, name, text in (("eng", "A_B_T_1800", "x\ny"), ("ger", "Ü_C_T_1801", "ä")):
        (tmp_path / "raw" / lang).mkdir(parents=True)
        (tmp_path / "raw" / lang / f"{name}.txt").write_text(text)
    got = {(r["file_name"], r["lang"], r["text"]) for r in files.read_corpus(spark, str(tmp_path / "raw")).collect()}
    assert got == {("A_B_T_1800", "eng", "x\ny"), ("Ü_C_T_1801", "ger", "ä")}
    v = spark.createDataFrame([("a", [1.0, 2.5]), ("b", [0.0, -1.0])], "node string, vec array<double>")
    files.write_word2vec(v, str(tmp_path / "w2v"))
    assert {(r["node"], tuple(r["vec"])) for r in files.read_word2vec(spark, str(tmp_path / "w2v")).collect()} == {("a", (1.0, 2.5)), ("b", (0.0, -1.0))}
    e = spark.createDataFrame([(1, 2, 0.5)], "src long, dst long, w double")
    files.write_edges(e, str(tmp_path / "e"))
    assert files.read_edges(spark, str(tmp_path / "e")).collect() == e.collect()
    files.write_graphml(e, str(tmp_path / "g"))
    made = []
    for _ in range(2):
        assert files.read_or_create(spark, str(tmp_path / "t"), lambda: made.append(1) or e).count() == 1
    assert made == [1]
    (tmp_path / "rules.csv").write_text("file_nameƒto_replaceƒreplace_withƒpriority\nxƒoldƒ''ƒ1\n")
    assert [tuple(r) for r in files.read_rules(spark, str(tmp_path / "rules.csv")).collect()] == [("x", "old", "", "1")]
    hits = files.search_lines(spark.createDataFrame([("p", "The cat\ncats")], "path string, text string"), "cat", whole_word=True)
    assert [(r["line_no"], r["line"]) for r in hits.collect()] == [(1, "The cat")]
    csv = str(tmp_path / "c")
    files.append_csv(e, csv)
    files.append_csv(e, csv)
    assert files.read_csv(spark, csv, "src long, dst long, w double").count() == 2


def test_stream_equals_batch(spark, tmp_path):
    d = docs(spark, ["a b a", "b c", None, ""])
    d.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = files and wordcount.word_counts(s).writeStream.outputMode("complete").format("memory").queryName("wc").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("wc").collect()} == {("a", 2), ("b", 2), ("c", 1)}
    scores = wordcount.append_scores(s.select("doc_id"), str(tmp_path / "out"), str(tmp_path / "cp"))
    scores.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_closest_names_misses_no_slip(spark):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = np.random.default_rng(3)
    names = {"Herwolsilral_Charles", "Hewolsilral_Charles", "Austen_Jane", "Austen_Iane", "Musten_Jane", "Li", "Wu_A", "", "Eliot", "Elliott_George", "aaaaaaaa", "aaaaaaaaaaaa"}
    for x in list(names):
        for _ in range(6):
            y = list(x)
            for _ in range(int(rng.integers(1, 7))):
                at = int(rng.integers(0, len(y) + 1))
                y[at : at + int(rng.integers(0, 2))] = list(rng.choice(["", "a", "e", "_"]))
            names.add("".join(y))
    got = metadata.closest_names(spark.createDataFrame([(x, x) for x in names], "name string, a string")).collect()
    want = {}
    for x in names:
        near = min((edits(x, y), y) for y in names if y != x)
        if near[0] <= 4:
            want[x] = near
    assert {r["name"]: (r["dist"], r["other"]) for r in got} == want
    assert want["Herwolsilral_Charles"][0] <= 1 and want["Austen_Jane"][0] == 1


def test_structural_costs_reach_the_diameter():
    def warp(a, b):
        d = np.full((len(a) + 1, len(b) + 1), np.inf)
        d[0, 0] = 0
        for i, j in itertools.product(range(len(a)), range(len(b))):
            d[i + 1, j + 1] = max(a[i], b[j]) / min(a[i], b[j]) - 1 + min(d[i, j + 1], d[i + 1, j], d[i, j])
        return d[-1, -1]

    def line(n, at=0):
        return {(at + i, at + i + 1) for i in range(n - 1)}

    def matrix(edges):
        a = np.zeros((max(map(max, edges)) + 1,) * 2, dtype=bool)
        for i, j in edges:
            a[i, j] = a[j, i] = True
        return a

    def rings(a, u):
        seen, front, out = {u}, [u], []
        while front:
            out.append(sorted(int(a[v].sum()) for v in front))
            front = sorted({int(y) for x in front for y in np.flatnonzero(a[x])} - seen)
            seen.update(front)
        return out

    rng = np.random.default_rng(4)
    a = matrix({(int(x), int(y)) for x, y in rng.integers(0, 25, (32, 2)) if x != y} | {(i, 24) for i in range(4)} | line(12, 25))
    a = a[a.any(axis=1)][:, a.any(axis=1)]
    around = [rings(a, u) for u in range(len(a))]
    got = kernels.structural_costs(a)
    assert len(got) == max(map(len, around)) == 12
    for u, v in itertools.combinations(range(len(a)), 2):
        want = 0.0
        for k, c in enumerate(got):
            want += warp(around[u][k], around[v][k]) if k < min(len(around[u]), len(around[v])) else np.inf
            assert c[u, v] == c[v, u] and (c[u, v] == want or abs(c[u, v] - want) < 1e-9)
    # on a path the nodes 3 and 5 differ in the third ring only
    path = kernels.structural_costs(matrix(line(12)))
    assert path[2][3, 5] == 0 < path[3][3, 5]


def test_structure_walks(spark):
    edges = [(f"{x}{i}", f"{x}{(i + 1) % 30}", 1.0) for x in "ab" for i in range(30)] + [("c", f"d{i}", 1.0) for i in range(5)]
    df = spark.createDataFrame(edges, "src string, dst string, w double")
    got = embed.structure_walks(df).collect()
    assert len(got) == 66 * 10 and all(len(r["path"]) == 8 and r["path"][0] == r["start"] for r in got)
    # nodes of the two rings are all alike, so walks reach more than ten of them and the other ring too
    reached = {y for r in got for x, y in itertools.pairwise(r["path"]) if x == "a0"}
    assert len(reached) > 10 and {y[0] for y in reached} >= {"a", "b"}
    assert sorted(map(str, got)) == sorted(map(str, embed.structure_walks(df).collect()))
    assert embed.structure_walks(df.where("w < 0")).count() == 0
    assert embed.struc2vec(df).count() == 66


def test_leaf_order_is_optimal():
    rng = np.random.default_rng(12)
    for n in (1, 2, 5, 8):
        x = rng.random((n, 2))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        order = kernels.leaf_order(d)
        assert sorted(order) == list(range(n))
        groups = [[i] for i in range(n)]
        orders = {i: [[i]] for i in range(n)}
        for i, j, _ in kernels.linkage(d, "average"):
            a, b = orders.pop(i), orders.pop(j)
            orders[i] = [p + q for x_, y_ in ((a, b), (b, a)) for p in x_ for q in y_]
        length = lambda o: sum(d[p, q] for p, q in zip(o, o[1:]))
        assert length(order) == pytest.approx(min(map(length, orders[next(iter(orders))]))) and len(groups) == n
    assert kernels.leaf_order(np.zeros((0, 0))) == []


def test_density_and_propagated_labels():
    d = np.array([[0, 1, 1, 9, 9, 9], [1, 0, 1, 9, 9, 9], [1, 1, 0, 2, 9, 9], [9, 9, 2, 0, 9, 9], [9, 9, 9, 9, 0, 9], [9, 9, 9, 9, 9, 0.0]])
    assert kernels.dbscan_labels(d, 1, 3) == [0, 0, 0, -1, -1, -1]
    assert kernels.dbscan_labels(d, 2, 3) == [0, 0, 0, 0, -1, -1]
    a = (d == 1).astype(float)
    assert len(set(kernels.propagated_labels(a)[:3])) == 1 and kernels.propagated_labels(np.zeros((3, 3))) == [0, 1, 2]


def test_clustering_grid_limits_and_resumes(spark):
    rng = np.random.default_rng(13)
    rows = [("m", f"n{i}", f"n{j}", float(rng.random())) for i in range(30) for j in range(30) if i != j]
    e = spark.createDataFrame(rows, "mxname string, src string, dst string, w double")
    settings_ = [("medoids", "3"), ("louvain", "1.0"), ("hierarchical", "4-ward"), ("dbscan", "0.00001-9")]
    one = kernels.cluster_grid(e, settings_).toPandas()
    assert len(one) == 4 * 30 and set(one["outcome"]) == {"success"} and one[one["alg"] == "dbscan"]["cluster"].isna().all()
    done = spark.createDataFrame([("m", "medoids", "3"), ("m", "louvain", "1.0")], "mxname string, alg string, param string")
    assert set(kernels.cluster_grid(e, settings_, done=done).toPandas()["alg"]) == {"hierarchical", "dbscan"}
    assert kernels.cluster_grid(e, settings_[:2], done=done).count() == 0
    assert set(kernels.cluster_grid(e, [("medoids", "9")], seconds=1e-4).toPandas()["outcome"]) == {"timeout"}


def test_centralities(spark):
    path = [("a", "b"), ("b", "c"), ("c", "d"), ("b", "e")]
    e = spark.createDataFrame([(x, y, 1.0) for p in path for x, y in (p, p[::-1])], "src string, dst string, w double")
    got = {r["node"]: (r["degree"], r["closeness"], r["betweenness"]) for r in graph.centralities(e).collect()}
    assert got["b"] == (3, 0.8, 5.0) and got["c"][2] == 3.0 and got["a"][2] == 0.0 and got["d"] == (1, pytest.approx(4 / 9, abs=1e-6), 0.0)
    ring = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")]
    e = spark.createDataFrame([(x, y, 1.0) for p in ring for x, y in (p, p[::-1])], "src string, dst string, w double")
    assert {r["betweenness"] for r in graph.centralities(e).collect()} == {0.5}
    assert graph.centralities(e.where("w > 2")).count() == 0


def test_matrix_checks(spark):
    cells = [("a", "a", 1.0), ("a", "b", 0.5), ("b", "a", 0.4), ("a", "c", 0.1), ("a", "c", 0.1), ("b", "b", 0.9)]
    d = spark.createDataFrame(cells, "src string, dst string, w double")
    r = graph.matrix_checks(d).first()
    assert (r["n_nodes"], r["n_cells"], r["n_missing"], r["n_repeated"], r["n_asymmetric"], r["n_off_diagonal"]) == (3, 6, 3, 1, 3, 1)
    bad = spark.createDataFrame([("a", "b", None), ("b", "a", float("nan")), ("c", "c", 1.0)], "src string, dst string, w double")
    assert tuple(graph.bad_weights(bad).first()) == (3, 1, 1, 1)
    assert sorted(r["w"] for r in graph.replace_nan(bad, 0.5).collect()) == [0.5, 0.5, 1.0]


def test_point_in_polygon(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (1.0, 1.0), (0.0, 2.0)]
    pts = [(0.5, 0.5, True), (1.0, 1.5, False), (0.2, 1.5, True), (3.0, 1.0, False), (1.9, 1.5, True)]
    d = spark.createDataFrame(pts, "x double, y double, inside boolean")
    assert d.where(graph.in_polygon(F.col("x"), F.col("y"), square) != F.col("inside")).count() == 0


def test_stratified_groups(spark):
    rng = np.random.default_rng(14)
    rows = [(f"g{rng.integers(40)}", str(rng.choice(["x", "y", "z"], p=[0.6, 0.3, 0.1]))) for _ in range(600)] + [(None, "x"), ("g1", None)]
    d = spark.createDataFrame(rows, "g string, y string")
    folds = {r["g"]: r["fold"] for r in validation.stratified_group_folds(d, "g", "y", 4).collect()}
    assert len(folds) == 40 and set(folds.values()) == {0, 1, 2, 3}
    table = pd.crosstab([folds[g] for g, y in rows[:-2]], [y for g, y in rows[:-2]])
    assert (table / table.sum()).to_numpy().std(axis=0).max() < 0.06
    assert validation.stratified_group_folds(d.where("g = 'none'"), "g", "y").count() == 0


def test_aliases_and_dropped_columns(spark):
    d = spark.createDataFrame([("A", 1), ("B", 2), (None, 3)], "g string, n_ratio int")
    a = spark.createDataFrame([("B", "A")], "alias string, name string")
    assert sorted((r["g"] or "") for r in validation.aliased_groups(d, "g", a).collect()) == ["", "A", "A"]
    assert validation.dropped(d, ["ratio"]).columns == ["g"]


def test_nested_scores(spark):
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.regression import LinearRegression

    rng = np.random.default_rng(15)
    rows = [(Vectors.dense([float(x)]), float(2 * x + rng.normal(0, 0.01)), f"g{i % 12}", (i % 12) % 2) for i, x in enumerate(rng.random(120))]
    d = spark.createDataFrame(rows, ["features", "label", "g", "outer"])
    got = validation.nested_scores(d, [LinearRegression(regParam=5.0), LinearRegression()], "label", "outer", 2)
    assert [r["fold"] for r in got] == [0, 1] and all(r["r"] > 0.99 for r in got)
    assert all(r["n"] == 60 for r in got)


def test_more_files(spark, tmp_path):
    d = spark.createDataFrame([(["a", "b"],), ([],), (["c"],)], "x array<string>")
    files.write_lists(d, "x", f"{tmp_path}/l")
    assert sorted(r["items"] for r in files.read_lists(spark, f"{tmp_path}/l").collect()) == [[], ["a", "b"], ["c"]]
    v = spark.createDataFrame([("a", [1.5]), ("b", [2.5])], "node string, vec array<double>")
    files.write_word2vec(v, f"{tmp_path}/v")
    assert {r["node"]: r["vec"] for r in files.read_word2vec(spark, f"{tmp_path}/v").collect()} == {"a": [1.5], "b": [2.5]}
    m = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 0.5), ("c", "a", 0.1)], "src string, dst string, w double")
    files.write_matrix(m, f"{tmp_path}/m")
    assert {(r["src"], r["dst"]): r["w"] for r in files.read_matrix(spark, f"{tmp_path}/m").collect()}[("c", "a")] == 0.1
    (tmp_path / "c.csv").write_text("# remark\nk;v\n1;x\n2;NA\n")
    assert files.sniff_separator(spark, f"{tmp_path}/c.csv", 1) == ";"
    assert [tuple(r) for r in files.read_csv(spark, f"{tmp_path}/c.csv", "k int, v string", None, skip=1).collect()] == [(1, "x"), (2, None)]


def test_folders(spark):
    from quillspark import session as S

    made = S.written(spark.range(3))
    assert S.once(made) is made and S.once(spark.range(3)) is not made
    path = made.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    import os

    assert os.path.exists(path)
    S.done_with(made, None)
    assert not os.path.exists(path)


def test_features_read_the_corpus_once(spark, tmp_path):
    """The tokens are counted in one job; what uses the counts again reads the table of counts."""
    docs(spark, ["a b c", "a b d"]).write.parquet(f"{tmp_path}/documents.parquet")
    plan = features.corpus_distance(ngrams.counts(spark.read.parquet(f"{tmp_path}/documents.parquet"), 1, 2))._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan
