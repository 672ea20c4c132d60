"""The operators for training data: against brute force, with odd input of every kind."""

from __future__ import annotations

import itertools
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import chunking, clusters, leaks, names, quality, scans, splits, tokenize

DOCS = "doc_id long, text string, ids string, block string, key string"
ODD = [None, "", "   ", "\n\n", "Hello world", "Hello world", "naïve café\r\n\tüber-\x0cmaß 𝔘𝔫𝔦 日本語 ​\x00", "a" * 30_000, "word " * 20_000, "<|endoftext|> 's 'll 12345  \n x"]


def odd(spark):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(ODD)], DOCS)


# 6 token ids
def test_ids_equal_the_library(spark):
    import tiktoken

    enc = tiktoken.Encoding("t", pat_str=tokenize.PATTERN, mergeable_ranks=tokenize._ranks(tokenize.vocabulary_path()), special_tokens={})
    df = odd(spark)
    got = {r["doc_id"]: r["ids"] for r in tokenize.encode_corpus(df).collect()}
    assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(ODD)}
    back = {r["doc_id"]: r["text"] for r in tokenize.decode_corpus(tokenize.encode_corpus(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}
    twice = tokenize.encode_corpus(df.unionAll(df).withColumn("doc_id", F.lit(None).cast("long")))
    assert twice.count() == 2 * len(ODD)
    assert tokenize.encode_corpus(df.where("doc_id < 0")).count() == 0


def test_decoding_shuffles_nothing(spark, monkeypatch):
    """Ids become text where they lie, in slices; null lists, null and unknown ids and repeated keys keep their rows."""
    monkeypatch.setattr(tokenize, "DECODED_IDS", 5, raising=False)
    word = {i: b for b, i in tokenize._ranks(tokenize.vocabulary_path()).items()}
    plain = [i for i in sorted(word) if word[i].isascii()][:40]
    rows = [(1, plain), (1, plain[:3]), (None, plain[3:5]), (2, None), (3, []), (4, [plain[0], None, -1, 10**9, plain[1]]), (5, plain[::-1])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    out = tokenize.decode_corpus(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    want = [(k, b"".join(word.get(i, b"") for i in ids or []).decode()) for k, ids in rows]
    assert [tuple(r) for r in out.coalesce(1).collect()] == want


# 4 oversized items
T = "text_id long, text string, received_at string, overlap_tokens int"
L = "text_id long, tokens_per_chunk int, overlap_tokens int, computed_at string, text string"


def test_pieces_round_trip(spark):
    rng = np.random.default_rng(0)
    words = ["alpha", "beta.", "gamma,", "delta;", "»omega!«", "x"]
    texts, limits = [], []
    for i in range(40):
        seps = rng.choice([" ", "  ", "\n", "\n\n", "\t", "\f", "\r\n"], 120)
        texts.append((i, "  " + "".join(w + s for w, s in zip(rng.choice(words, 120), seps)), "1", 9))
        limits.append((i, int(rng.integers(1, 90)), int(rng.integers(-2, 100)), "1", "clash"))
    texts += [(50, None, "1", 9), (51, "", "1", 9), (52, "one two", "1", 9), (53, "old " * 9, "1", 9), (53, "new " * 6, "2", 9), (54, "y" * 100_000 + " z", "1", 9), (55, "q " * 5, "1", 9), (None, "a b", "1", 9)]
    limits += [(50, 1, 0, "1", "c"), (51, 1, 0, "1", "c"), (52, 5, 0, "1", "c"), (53, 9, 0, "1", "c"), (53, 4, None, "2", "c"), (54, 1, 0, "1", "c"), (55, None, 0, "2", "c"), (55, 2, 0, "1", "c")]
    t, lim = spark.createDataFrame(texts + texts[:5], T), spark.createDataFrame(limits + limits[:5], L)
    got = chunking.pieces(t, lim).toPandas()
    limit = {k: (n, max(0, min(o or 0, (n or 1) - 1))) for k, n, o, at, _ in limits if not (k == 53 and at == "1") and not (k == 55 and at == "1")}
    text = {k: x for k, x, at, _ in texts if not (k == 53 and at == "1")}
    token = re.compile(r"[^ \t\n\r\f]+")
    part = re.compile(chunking.TOKEN.replace("\\A", "^"))
    want = {k for k, x in text.items() if k is not None and x and limit[k][0] is not None and len(token.findall(x)) > limit[k][0]}
    assert set(got["text_id"]) == want and 55 not in want
    for k, g in got.sort_values("piece_no").groupby("text_id"):
        n, o = limit[k]
        assert list(g["piece_no"]) == list(range(1, len(g) + 1)) and (g["n_pieces"] == len(g)).all()
        assert all(len(token.findall(p)) == m <= n for p, m in zip(g["piece"], g["n_tokens"]))
        assert list(g["overlap"]) == [0] + [o] * (len(g) - 1)
        assert "".join("".join(part.findall(p)[v:]) for p, v in zip(g["piece"], g["overlap"])) == text[k]
    assert set(chunking.pieces(t, lim, with_text=False).select("text_id").distinct().toPandas()["text_id"]) == want
    assert chunking.pieces(t.where("text_id < 0"), lim).count() == 0
    assert {r[0] for r in chunking.pieces(t, lim, whole=True).where("text_id = 52").select("piece").collect()} == {"one two"}


def test_pieces_prefer_strong_boundaries(spark):
    text = "a b c d e f. g h\n\n" + "i j k l m n o p q r"
    rows = chunking.pieces(spark.createDataFrame([(1, text, "1", 0)], T), spark.createDataFrame([(1, 10, 0, "1", "")], L)).orderBy("piece_no").collect()
    assert [r["piece"].strip() for r in rows] == ["a b c d e f. g h", "i j k l m n o p q r"]


def test_pieces_end_at_a_boundary_of_the_first_half(spark):
    plain = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    for mark in (".", ",", ".\n\n", "\n"):
        text = plain("a", 3) + mark + " " + plain("b", 12)
        df = spark.createDataFrame([(1, text, "1", 0)], T)
        got = lambda n, over: [(r["first_token"], r["n_tokens"]) for r in chunking.pieces(df, spark.createDataFrame([(1, n, over, "1", "")], L)).orderBy("piece_no").collect()]
        assert got(10, 0) == [(0, 3), (3, 10), (13, 2)]
        # the first piece still holds what the second repeats
        assert got(10, 2)[0] == (0, 3) and got(10, 4)[0] == (0, 10)


# 1 names
M = "text_id long, file_name string, author string, author_viaf string, source_vol string, rec string, entity string"


def meta(spark, rows):
    return spark.createDataFrame([(*r, *(None,) * (5 - len(r)), "x", "y") for r in rows], M)


def test_names(spark):
    rows = [
        (1, "Morgenstrund_Karl_A_1800", "Karl Morgenstrund"), (2, "Morgenstrund_Karla_B_1801", "Karla Morgenstrund"), (3, "Morgenstrund_Karl_C_1801", "MORGENSTRUND, KARL"), (4, "Morgenstrund_Karla_B2_1801", "Morgenstrund, Karla"),
        (5, "Mrogenstrund_Karl_D_1802", None), (6, "Morgenstrund_K_E_1802", "Karl Morgenstrund"), (7, "Wilbertham_William_F_1803", "Bill Wilbertham"), (8, "Wilbertham_Wm_G_1804", "Wilbertham, William"),
        (9, "Anonymous_Anonymous_H_1805", "A Lady"), (10, "Morgenstrund-Wilbertham_Karl-William_I_1806", "Karl Morgenstrund & William Wilbertham"), (11, "Reading-Society_Lunaberg_J_1807", "Reading Soc., Lunaberg"), (12, "Book-Club_Lunaberg_K_1807", "Book Club of Lunaberg"), (13, None, ""), (14, "Wilbertham_William_L_1808", " "),
    ]
    for d in (meta(spark, rows), meta(spark, rows + rows)):
        got = {tuple(r) for r in names.pairs(names.link(d)).collect()}
        same = [
            {"Morgenstrund_Karl", "Karl Morgenstrund", "MORGENSTRUND, KARL", "Mrogenstrund_Karl", "Morgenstrund_K"}, {"Morgenstrund_Karla", "Karla Morgenstrund", "Morgenstrund, Karla"},
            {"Wilbertham_William", "Bill Wilbertham", "Wilbertham_Wm", "Wilbertham, William"}, {"Reading-Society_Lunaberg", "Reading Soc., Lunaberg"}, {"Book-Club_Lunaberg", "Book Club of Lunaberg"},
        ]
        assert got == {p for s in same for p in itertools.combinations(sorted(s), 2)}
    assert names.pairs(names.link(meta(spark, rows).where("text_id < 0"))).count() == 0


def test_names_used_often(spark, monkeypatch):
    """How often two spellings are used decides nothing, nor does the size at which blocks are refined."""
    pair = {("Morgenstrund_Karl", "Mrogenstrund_Karl")}
    for n, hot in ((1, 64), (4, 1), (10, 1), (1000, 64)):
        monkeypatch.setattr(names, "HOT", hot)
        rows = [(2 * i, f"Morgenstrund_Karl_A{i}_1800", None) for i in range(n)] + [(2 * i + 1, f"Mrogenstrund_Karl_B{i}_1800", None) for i in range(n)]
        assert {tuple(r) for r in names.pairs(names.link(meta(spark, rows))).collect()} == pair


@settings(max_examples=300, deadline=None)
@given(st.text("abcd", max_size=17), st.text("abcd", max_size=17), st.integers(0, 3), st.randoms())
def test_close_cores_share_a_variant(a, b, edits, rnd):
    def shared(x):  # as variants() has it
        one = {x[:i] + x[i + 1 :] for i in range(len(x))}
        return {x} | one | ({y[:i] + y[i + 1 :] for y in one for i in range(len(y))} if len(x) >= 14 else set())

    b = b if edits == 3 else a
    for _ in range(edits % 3):
        i = rnd.randrange(len(b) + 1)
        b = rnd.choice([b[:i] + "e" + b[i:], b[:i] + b[i + 1 :], b[:i] + "e" + b[i + 1 :]])
    if names.close(a, b):
        assert shared(a) & shared(b)


def test_variants(spark):
    words = ["", "a", "abcd", "abcdefghijklmn"]
    got = {r["w"]: set(r["v"]) for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", names.variants(F.col("w")).alias("v")).collect()}
    for w in words:
        one = {w[:i] + w[i + 1 :] for i in range(len(w))}
        assert got[w] == {w} | one | ({y[:i] + y[i + 1 :] for y in one for i in range(len(y))} if len(w) >= 14 else set())


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_lcs(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i, j in itertools.product(range(len(a)), range(len(b))):
        table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
    assert names.lcs(a, b) == table[-1, -1]


# 3 splits
def test_groups_and_splits(spark):
    rows = [
        (1, "Morgenstrund_Karl_A_1800", "Karl Morgenstrund", None, None), (2, "Morgenstrund_Karl_B_1800", None, None, "Vol-1 "), (3, "Wilbertham_William_C_1800", "William Wilbertham", None, "vol-1"),
        (4, "Anonymous_Anonymous_D_1800", "Anon.", None, None), (5, "Anonymous_Anonymous_E_1800", None, None, ""), (6, "Zornental_Anna_F_1800", "Anna Zornental", None, None), (7, "Zornental-Birkenau_Anna-Otto_G_1800", "Anna Zornental | Otto Birkenau", None, None),
        (8, "Birkenau_Otto_H_1800", "Otto Birkenau", None, None), (9, None, None, None, None),
    ]
    g = splits.groups(meta(spark, rows + rows[:3]))
    got = {r["text_id"]: r["first_text_id"] for r in g.collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6, 8: 6, 9: 9}
    s = splits.assign(g, {"train": 0.6, "test": 0.4}).toPandas()
    assert len(s) == 9 and s.groupby("first_text_id")["split"].nunique().max() == 1 and dict(s["split"].value_counts()) == {"train": 5, "test": 4}
    assert splits.assign(g.where("text_id < 0"), {"train": 1.0}).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 9), st.integers(1, 5), min_size=1, max_size=4), st.integers(0, 60))
def test_closest_subset(sizes, target):
    got = splits.closest_subset(sizes, target)
    sums = {sum(s * k for s, k in zip(sizes, c)) for c in itertools.product(*[range(n + 1) for n in sizes.values()])}
    assert all(0 <= k <= sizes[s] for s, k in got.items())
    assert abs(sum(s * k for s, k in got.items()) - target) == min(abs(x - target) for x in sums)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 12).map(lambda x: x * x), st.integers(1, 9), min_size=1, max_size=6), st.integers(0, 900), st.sampled_from([1, 5, 40, 200]))
def test_closest_beyond_the_bitset(sizes, target, most):
    off = lambda got: abs(sum(s * k for s, k in got.items()) - target)
    exact, before = off(splits.closest_subset(sizes, target)), splits.MAX_UNITS
    splits.MAX_UNITS = most
    try:
        got = splits.closest(sizes, target)
    finally:
        splits.MAX_UNITS = before
    assert off(got) == exact and all(0 <= k <= sizes[s] for s, k in got.items())


def test_plan_of_very_many_records(monkeypatch):
    shares = [("train", 0.8), ("validation", 0.1), ("test", 0.1)]
    for most, sizes in ((100, {1: 500, 3: 40, 70: 5, 333: 2}), (1 << 20, {1: 10**9, 2: 10**8, 17: 10**6, 10**8: 3})):
        monkeypatch.setattr(splits, "MAX_UNITS", most)
        p, total = splits.plan(sizes, shares), sum(s * n for s, n in sizes.items())
        got = {k: sum(s * (b - a) for x, s, a, b in p if x == k) for k, _ in shares}
        assert sum(got.values()) == total and all(abs(got[k] - share * total) <= 1 for k, share in shares)
        for s, n in sizes.items():
            cells = sorted((a, b) for _, x, a, b in p if x == s)
            assert cells[0][0] == 0 and cells[-1][1] == n and all(x[1] == y[0] for x, y in zip(cells, cells[1:]))


# 2 clusters
def test_clusters(spark):
    rng = np.random.default_rng(1)
    cols = [f"f{i}_full" for i in range(8)]
    rows, truth, n = [], {}, 0
    for c in range(40):
        centre = rng.random(8)
        for _ in range(int(rng.integers(1, 9))):
            x = [float(v) for v in centre + rng.uniform(-0.01, 0.01, 8)]
            if rng.random() < 0.1:
                x[int(rng.integers(8))] = rng.choice([None, -999.0, float("nan")])
            rows.append((n, "2024-02", *x))
            truth[n] = c
            n += 1
    rows += [(n, "2024-02", *[0.5] * 8), (n + 1, "2024-02", *[0.5] * 8), (n + 2, "2024-02", *[None] * 8), (None, "2024-02", *[0.5] * 8), (0, "2024-01", *[0.9] * 8)]
    truth[n] = truth[n + 1] = "same"
    schema = "text_id long, computed_at string, " + ", ".join(f"{c} double" for c in cols)
    df = spark.createDataFrame(rows + rows[:7], schema)
    members, info = clusters.clusters(df, cols)
    want = {p for p in itertools.combinations(sorted(truth), 2) if truth[p[0]] == truth[p[1]]}
    assert {tuple(r) for r in clusters.pairs(members).collect()} == want
    i = info.toPandas().sort_values("cluster")
    assert list(i["cluster"]) == list(range(len(i))) and list(i["size"]) == sorted(i["size"], reverse=True)
    assert all(len(set(t)) == min(3, s) for t, s in zip(i["typical"], i["size"]))
    assert clusters.clusters(df.where("text_id < 0"), cols)[0].count() == 0


def test_mixture_separates_what_a_radius_cannot(spark):
    rng = np.random.default_rng(4)
    # two groups and records between them, each within NEAR of the next one: a radius joins all of them
    a = 0.5 + rng.normal(0, 0.004, (60, 4))
    b = 0.5 + rng.normal(0, 0.004, (60, 4)) + np.array([0.14, 0, 0, 0])
    bridge = np.array([[0.545, 0.5, 0.5, 0.5], [0.595, 0.5, 0.5, 0.5]])
    x = np.vstack([a, b, bridge])
    reach = np.abs(x[:, None, :] - x[None, :, :]).max(axis=2) < clusters.NEAR
    seen = {0}
    while len(more := seen | set(np.flatnonzero(reach[list(seen)].any(axis=0)))) > len(seen):
        seen = more
    assert len(seen) == 122
    label, density = clusters.components_of(x)
    assert len(set(label[:60])) == 1 and len(set(label[60:120])) == 1 and label[0] != label[60]
    # the densest member is near the middle of its group
    top = int(np.argmax(np.where(label == label[0], density, -np.inf)))
    assert np.linalg.norm(x[top] - a.mean(axis=0)) < np.median(np.linalg.norm(a - a.mean(axis=0), axis=1))
    # one group of any shape within the noise stays whole, and EM finds the number of planted components
    assert clusters.components_of(a)[0].max() == 0
    centres = rng.random((30, 6))
    many = np.vstack([c + rng.normal(0, 0.004, (int(rng.integers(1, 20)), 6)) for c in centres])
    far = np.linalg.norm(centres[:, None] - centres[None], axis=2) + np.eye(30)
    assert far.min() > 0.15 and clusters.components_of(many)[0].max() + 1 == 30


def test_clusters_of_records_that_miss_much(spark, monkeypatch):
    rng = np.random.default_rng(6)
    cols = [f"f{i}_full" for i in range(9)]
    rows, truth = [], {}
    for c in range(60):
        centre = rng.random(9)
        for k in range(4):
            n = 4 * c + k
            v = [float(x) for x in centre + rng.uniform(-0.005, 0.005, 9)]
            if k == 3 and c % 3 == 0:
                v[:6] = [None] * 6
            rows.append((n, "1", *v))
            truth[n] = c
    df = spark.createDataFrame(rows, "text_id long, computed_at string, " + ", ".join(f"{c} double" for c in cols))
    want = {p for p in itertools.combinations(sorted(truth), 2) if truth[p[0]] == truth[p[1]]}
    # cells of a few records, cells that are cut on, and one cell
    for rows_, most in ((2, 1500), (100, 20), (10_000, 1500)):
        monkeypatch.setattr(clusters, "CELL_ROWS", rows_)
        monkeypatch.setattr(clusters, "CELL_MOST", most)
        assert {tuple(r) for r in clusters.pairs(clusters.clusters(df, cols)[0]).collect()} == want


# 7 leaks
def test_leaks_both_ways(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, "Read the passage and answer the question that follows it now. " + say(60)) for i in range(12)] + [(90, None), (91, ""), (92, "short item"), (0, None)]
    items[12:12] = [items[3]]
    docs, want = [], set()
    for i in range(60):
        text = say(80)
        if i % 3 == 0:
            src = items[i % 12][1].split()[11:]
            copy = [w if rng.random() > 0.12 else "changed" for w in src[: int(len(src) * rng.choice([0.6, 1.0]))]]
            text += ", " + " ".join(copy).upper() + ". " + say(30)
            want.add((i, i % 12))
        elif i % 3 == 1:
            text += " Read the passage and answer the question that follows it now. " + " ".join(items[i % 12][1].split()[11:20])
        docs.append((i, text))
    docs += [(100, None), (101, ""), (None, docs[0][1])]
    d = spark.createDataFrame([(*x, "c") for x in docs + docs[:2]], "doc_id long, text string, item string")
    b = spark.createDataFrame(items, "item_id long, text string")
    one = {tuple(r) for r in leaks.found(d, b).collect()}
    other = {tuple(r) for r in leaks.found(d, b, broadcast_seeds=0).collect()}
    assert one == other == want
    assert leaks.found(d.where("doc_id < 0"), b).count() == 0 and leaks.found(d, b.where("item_id < 0")).count() == 0


def test_leaks_of_items_under_several_ids(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(600)]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    base = [(i, "Read the passage and answer the question that follows it now. " + say(70)) for i in range(8)]
    docs = [(i, say(40) + " " + " ".join(base[i % 8][1].split()[11:60]) + " " + say(5000 if i == 3 else 30)) for i in range(24)]
    docs += [(50 + i, "Read the passage and answer the question that follows it now. " + say(60)) for i in range(5)]
    # every seed of item 7 is in many other items, which are no copies of it
    quoting = [(1000 + i, say(70) + " " + " ".join(base[7][1].split()[a : a + 14]) + " " + say(70)) for a in range(11, 70, 10) for i in range(10 * a, 10 * a + 6)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for copies, edit, more in ((1, 0, []), (2, 0, []), (3, 0, []), (10, 0, []), (10, 1, []), (1, 0, quoting)):
        rows = []
        for k in range(copies):
            for i, t in base:
                w = t.split()
                if edit and k:
                    w[20 + 4 * k] = "edited"
                rows.append((100 * k + i, " ".join(w)))
        b = spark.createDataFrame(rows + more, "item_id long, text string")
        got = {tuple(r) for r in leaks.found(d, b).where("item_id < 1000").collect()}
        if more:
            got, want = {x for x in got if x[1] != 7}, {(i, i % 8) for i in range(24) if i % 8 != 7}
        else:
            want = {(i, 100 * k + i % 8) for i in range(24) for k in range(copies)}
        assert got == want
        if copies == 3:
            assert {tuple(r) for r in leaks.found(d, b, broadcast_seeds=0).collect()} == want
        if more:
            full, seeds, _ = leaks.prepared(b, "item_id", "text")
            assert seeds.where("item = 7").count() >= 1 or full.where("item = 7").count() == 0


def test_alignment_in_blocks(monkeypatch):
    """Blocks of any size find the stretches that the whole texts have."""
    rng = np.random.default_rng(9)
    item = rng.integers(1, 10**6, 300).astype(np.uint64)
    own = np.ones(300, dtype=np.uint8)
    doc = rng.integers(10**6, 10**7, 3000).astype(np.uint64)
    doc[500:580], doc[1500:1620], doc[2800:2900] = item[:80], item[100:220], item[200:300]
    want = 80 + 120 + 80
    assert leaks.stretches(item, doc, own) == want
    monkeypatch.setattr(leaks, "ITEM_BLOCK", 64)
    monkeypatch.setattr(leaks, "DOC_BLOCK", 256)
    assert leaks.stretches(item, doc, own) >= want - 3 * leaks.MIN_STRETCH
    monkeypatch.setattr(leaks, "MARGIN", 50)
    g = leaks.grams(item, leaks.SEED).astype(np.int64)
    order = np.argsort(g)
    n, where = leaks.places(g[order], order, 300, leaks.grams(doc, leaks.SEED).astype(np.int64))
    assert n == 76 + 116 + 96 - 16 and leaks.stretches(item, doc, own, places=where) >= want - 3 * leaks.MIN_STRETCH
    assert sum(len(x) for x in leaks.blocks(doc, [(-5, 10), (5, 30), (2990, 4000)])) == 40
    # many scraps all count, however many there are
    monkeypatch.undo()
    scraps = np.concatenate([np.concatenate([item[k : k + 12], rng.integers(10**7, 10**8, 30).astype(np.uint64)]) for k in range(0, 240, 24)])
    assert leaks.stretches(item, scraps, own) >= 10 * 12


def test_alignment_against_plain_dynamic_programme():
    rng = np.random.default_rng(3)
    for _ in range(30):
        a, b = rng.integers(0, 5, 25).astype(np.uint64), rng.integers(0, 5, 40).astype(np.uint64)
        h = np.zeros((26, 41), dtype=int)
        for i, j in itertools.product(range(25), range(40)):
            h[i + 1, j + 1] = max(0, h[i, j] + (1 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        got = leaks.stretches(a, b, np.ones(25, dtype=np.uint8), most=1)
        assert (got > 0) == (h.max() >= leaks.MIN_STRETCH) and got >= (h.max() if h.max() >= leaks.MIN_STRETCH else 0)


# 8 quality
PROSE = "The old miller walked down to the river in the evening, and nobody knew what he wanted there. It was cold, but he had a lamp with him."
KINDS = {
    "prose": [PROSE, PROSE.upper(), PROSE.lower().replace(",", "").replace(".", ""), re.sub(r"(.{20,30}) ", r"\1\n", PROSE), "Der alte Müller ging am Abend zum Fluss, und niemand wusste, was er dort wollte.", PROSE + "\n- apples\n- pears\n- plums\n" + PROSE],
    "list": ["- The Old Mill\n- The Young Mill\n- A Cold Lamp\n- The River", "1. Anna Berg\n2. Otto Tal\n3. Karl Hof\n4. Emma See", "Anna Berg / Otto Tal / Karl Hof / Emma See / Paul Au", "Anna Berg\nOtto Tal\nKarl Hof\nEmma See"],
    "table": ["Year\tTitle\tPrice\n1801\tThe Mill\t2.50\n1802\tThe Lamp\t3.10\n1803\tA River\t1.00", "| a | b | c |\n|---|---|---|\n| 1 | 2 | 3 |\n| 4 | 5 | 6 |", "1801,\"The Mill\",2.5\n1802,\"A, B\",3.5\n1803,\"C\",4.5", "Anna   1801  2.50\nOtto   1802  3.10\nKarl   1803  1.00\nEmma   1804  9.99"],
    "junk": ["xkcdq wrtzp lmnbv qrstw zxcvb plkjh mnbvc", "_" * 300, "{}|\\~^<>@#$%" * 10, "<div><span class=\"a\"></span><a href=\"x\"></a>&nbsp;</div>" * 5, "login " * 60, "Home >> Top | Login | Home >> RSS Top | Login Home | RSS >> Top Home", "Suche Home Suche >> A-Z A-Z RSS >> | (0) Print | (0) >> Suche >> << A-Z Top"],
}


def test_kinds(spark):
    rows = [(k, t) for k, ts in KINDS.items() for t in ts]
    texts = [t for _, t in rows] + [None, "", " \n\t", PROSE * 500]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, kind string")
    got = {r["doc_id"]: r["kind"] for r in quality.found(df).collect()}
    assert {i: got.get(i, "prose") for i in range(len(rows))} == {i: k for i, (k, _) in enumerate(rows)}
    assert not set(got) & set(range(len(rows), len(texts)))
    assert quality.layout(df).count() == len(texts) == quality.statistics(df).count()
    assert quality.found(df.where("doc_id < 0")).count() == 0


_NAMED = iter(f"{a}{b}{c}" for a in ("Ber", "Hol", "Mar", "Tan", "Wil") for b in ("ga", "le", "mi", "no", "ru") for c in ("ben", "dorf", "ker", "lin", "mann", "sen", "tal"))
_ENTRIES = [" ".join(itertools.islice(_NAMED, n)) for n in (14, 10, 10) * 4]
INDENTED = "\n".join("      " * (i % 2) + " ".join(x.split()[:10]) for i, x in enumerate(_ENTRIES))
LENGTHS = "\n".join(_ENTRIES)
_ALL = " ".join(_ENTRIES).split()
_SIZES = [10, 11, 12, 13, 14, 15, 16, 17, 18, 19]
INDENTS = "\n".join("    " * (i % 2) + " ".join(_ALL[sum(_SIZES[:i]) : sum(_SIZES[: i + 1])]) for i in range(len(_SIZES)))


def test_layout_that_repeats():
    f = lambda t: dict(zip(quality._NAMES, quality.describe(t)))
    a, b = f(INDENTED), f(LENGTHS)
    assert a["indent_period"] == 2 and a["indent_autocorrelation"] > 0.9
    assert b["line_period"] == 3 and b["line_autocorrelation"] > 0.8 and b["indent_period"] == 0
    # the same lines in another order have no such period
    mixed = f("\n".join(sorted(INDENTED.split("\n"))))
    assert mixed["indent_period"] == 0 and mixed["indent_autocorrelation"] == 0


def test_layout_that_repeats_decides(spark):
    verse = """arma gravi numero violentaque bella parabam
    edere, materia conveniente modis.
par erat inferior versus: risisse Cupido
    dicitur atque unum surripuisse pedem.
quis tibi, saeve puer, dedit hoc in carmina iuris?
    Pieridum vates, non tua turba sumus.
quid, si praeripiat flavae Venus arma Minervae,
    ventilet accensas flava Minerva faces?"""
    rows = [(0, INDENTED), (1, LENGTHS), (2, verse), (3, re.sub(r"(.{20,30}) ", r"\1\n      ", PROSE)), (4, "\n".join(f"{x}\n    {x}" for x in [PROSE] * 3))]
    assert quality.describe(verse)[-1] == 2
    got = {r["doc_id"]: r["kind"] for r in quality.found(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: "list", 1: "list"}


#: A table some of whose cells are empty: only the columns of characters show it.
ALIGNED = """Anna     1801     2.50   Holtal
Otto              3.10   Rumark
Karl     1803     4.00   Winsee
         1804     9.99
Emma                     Tanau
Paul     1805     7.25   Belmi
Gerd     1806"""


def test_each_signal_of_the_method_decides(spark, monkeypatch):
    """Without columns of characters, periods of indentation or of line lengths, a case of each is lost."""
    df = spark.createDataFrame([(0, INDENTS), (1, LENGTHS), (2, ALIGNED)], "doc_id long, text string")
    lay = quality.layout(df)
    kinds = lambda d: {r["doc_id"]: r["kind"] for r in d.select("doc_id", quality.kind_of().alias("kind")).where("kind IS NOT NULL").collect()}
    assert kinds(lay) == {0: "list", 1: "list", 2: "table"}
    assert kinds(lay.withColumn("indent_autocorrelation", F.lit(0.0))).get(0) is None
    assert kinds(lay.withColumn("line_autocorrelation", F.lit(0.0))).get(1) is None
    share = dict(zip(quality._NAMES, quality.describe(ALIGNED)))["table_share"]
    monkeypatch.setattr(quality, "_columns", lambda lines: 0.0)
    assert share > 0.9 and dict(zip(quality._NAMES, quality.describe(ALIGNED)))["table_share"] < 0.65


# 5 scans
def test_scans(spark):
    pure = ["The gentle farmer carried the heavy basket to the quiet village", "A modest sailor described the distant harbour before the winter", "Nobody remembered the broken wagon near the narrow bridge", "The gentle sailor carried the broken basket near the harbour"]
    base = "\n".join(f"{p}." for p in pure)
    scan = "The gentle farmer carried the hea-\nvy basket to the quiet village, and the sea-\nand river-men descr\nibed the distant harbour.\n\n- 12 -\nTHE OLD FARM    13\nA modeft sailor remembered the narrow\nbr1dge and tbe wagon near Zenwark.\nG 4\nNobody carried the ſmall basket."
    rows = [(i, base, f"A_B_T{i}_1800", str(i), "c") for i in range(30)] + [(100, scan, "Miller_Anna_The-Old-Farm_1801", "1", "c"), (101, None, None, "1", "c"), (102, "", "x", "1", "c"), (103, "stale", "x", "1", "c"), (103, "The quiet village.\n[7]", "x", "2", "c")]
    df = spark.createDataFrame(rows + rows[-5:], "text_id long, text string, file_name string, received_at string, kind string")
    got = {tuple(r) for r in scans.found(df).where("text_id >= 100").collect()}
    want = {(100, 0, "join"), (100, 2, "join"), (100, 5, "drop"), (100, 6, "drop"), (100, 8, "glyph"), (100, 9, "drop"), (100, 10, "glyph"), (103, 1, "drop")}
    assert got - {(100, 7, "glyph")} == want
    fixed = {r["text_id"]: r["text"] for r in scans.repaired(df).collect()}
    assert "heavy basket" in fixed[100] and "described the distant" in fixed[100] and "FARM" not in fixed[100] and "bridge and the wagon near Zenwark" in fixed[100]
    assert fixed[103] == "The quiet village." and 101 not in fixed and 102 not in fixed
    assert scans.found(df.where("text_id < 0")).count() == 0


def test_scans_of_a_repeated_corpus(spark):
    """A corpus ten times under other ids is read as once, and rows of one id count once."""
    rng = np.random.default_rng(16)
    pure = ["the gentle farmer carried the heavy basket", "a modest sailor described the distant harbour", "nobody remembered the broken wagon", "the quiet widow praised the narrow bridge"]
    texts = []
    for i in range(60):
        t = ".\n".join(str(x) for x in rng.choice(pure, 12)) + "."
        if i % 5 == 0:
            t = t.replace("gentle", "gcntle", 1).replace("bridge", "br1dge", 1) + "\n- 7 -\nthe har-\nbour."
        texts.append((i, t, f"A_B_T{i}_1800", "1"))
    schema = "text_id long, text string, file_name string, received_at string"
    one = spark.createDataFrame(texts, schema)
    ten = spark.createDataFrame([(100 * k + i, *r) for k in range(10) for i, *r in texts], schema)
    want = {tuple(r) for r in scans.found(one).collect()}
    got = [tuple(r) for r in scans.found(ten).collect()]
    assert want and {(100 * k + i, l, x) for i, l, x in want for k in range(10)} == set(got) and len(got) == len(set(got))
    assert {tuple(r) for r in scans.found(one.unionAll(one)).collect()} == want


def test_vectors_of_rare_words():
    """A rare word goes with the frequent one whose company it keeps; one in other company is a word of its own."""
    rng = np.random.default_rng(17)
    table = np.zeros((40, 20))
    table[:20, :10], table[20:, 10:] = rng.integers(50, 200, (20, 10)), rng.integers(50, 200, (20, 10))
    v, u = scans.skip_gram(table)
    noise = table.sum(axis=0) ** 0.75
    rare = np.zeros((2, 20))
    rare[0, :10], rare[1, 10:] = rng.integers(0, 3, 10), rng.integers(0, 3, 10)
    got = scans.company(rare, u, v, noise / noise.sum())
    assert got[0, :20].min() > scans.RARE_FIT > got[0, 20:].max() and got[1, 20:].min() > scans.RARE_FIT > got[1, :20].max()
    sp = scans.Speller(["house"], np.array([900.0]), np.array([0.0]), np.zeros((1, 2)), np.zeros((1, 2)), frozenset({"honse"}), 40.0)
    assert sp.correct("honse", False, []) is None and scans.Speller(["house"], np.array([900.0]), np.array([0.0]), np.zeros((1, 2)), np.zeros((1, 2))).correct("honse", False, []) == "house"


def test_skip_gram_puts_like_words_together():
    rng = np.random.default_rng(5)
    counts = np.zeros((20, 12))
    counts[:10, :6], counts[10:, 6:] = rng.integers(20, 60, (10, 6)), rng.integers(20, 60, (10, 6))
    v, _ = scans.skip_gram(counts)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s = v @ v.T
    assert s[:10, :10].mean() > s[:10, 10:].mean() + 0.5


def test_registered():
    from quillspark.llm import queries

    assert {f"p{n}_" for n in range(1, 9)} == {q[:3] for q in queries.queries()}
