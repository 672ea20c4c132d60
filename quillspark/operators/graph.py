"""Networks from similarity matrices: sparsification, and measures of the graphs.

Edges are (src, dst, w), both ways where undirected, without self-loops. Every function takes
an empty table to an empty (or zero) result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.components import components
from quillspark.operators.distance import matrix
from quillspark.operators.ngrams import most_frequent
from quillspark.session import written


def network(docs: DataFrame, n: int = 100) -> DataFrame:
    """Cosine similarities of the texts merged by source and language, over the n most frequent words of the merged texts
    by the sum of their relative frequencies.

    Documents without a source are left out; a null language is '-'. Merged texts without any of the
    words have no edges.
    """
    node = F.concat_ws("/", "source", F.coalesce("lang", F.lit("-")))
    rows = docs.where("source IS NOT NULL").select(node.alias("node"), F.explode(T.words(F.col("text"))).alias("ngram"))
    cnt = written(rows.groupBy("node", "ngram").agg(F.count("*").alias("cnt")))
    ranked = most_frequent(cnt, n, "node").select("ngram", "rank")
    size = cnt.groupBy("node").agg(F.sum("cnt").alias("_n"))
    # the list of words has n rows
    hit = cnt.join(F.broadcast(ranked), "ngram").groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("rank", "cnt"))).alias("_m"))
    vec = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.coalesce(F.try_element_at("_m", i) / F.col("_n"), F.lit(0.0)))
    return written(matrix(written(size.join(hit, "node").select("node", vec.alias("vec")))))


def author(node: str):
    return F.substring_index(node, "/", 1)


def threshold(edges: DataFrame, q: float) -> DataFrame:
    """Edges of at least the q quantile of the triangle, interpolated. One row is broadcast."""
    cut = edges.where("src < dst").agg(F.percentile("w", F.lit(q)).alias("_cut"))
    return edges.crossJoin(F.broadcast(cut)).where("w >= _cut").drop("_cut")


def author_bound(edges: DataFrame, largest: bool) -> DataFrame:
    """Directed: edges at least as similar as the least (or most) similar two texts of the source's author.

    Authors of a single text keep no edge; for the greatest similarity, cells of 1 don't count.
    """
    own = edges.where(author("src") == author("dst"))
    if largest:
        own = own.where("w <> 1")
    bound = own.groupBy(author("src").alias("_a")).agg((F.max if largest else F.min)("w").alias("_m"))
    return edges.join(bound, author("src") == F.col("_a")).where("w >= _m").select("src", "dst", "w")


def top_neighbours(edges: DataFrame, k: int) -> DataFrame:
    """The k most similar of each node, and all that tie with the k-th."""
    w = Window.partitionBy("src").orderBy(F.desc("w"))
    return edges.withColumn("_r", F.rank().over(w)).where(F.col("_r") <= k).drop("_r")


def simmelian(edges: DataFrame, k: int) -> DataFrame:
    """(src, dst, w, overlap) of each edge to a top neighbour: shared top neighbours, one more if it is mutual; 0 for equal lists."""
    top = top_neighbours(edges, k)
    near = top.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("_n"))
    pair = top.join(near, "src").join(near.select(F.col("src").alias("dst"), F.col("_n").alias("_m")), "dst", "left")
    m = F.coalesce("_m", F.array().cast("array<string>"))
    shared = F.size(F.array_intersect("_n", m)) + F.array_contains(m, F.col("src")).cast("int")
    return pair.select("src", "dst", "w", F.when(F.col("_n") == m, 0).otherwise(shared).cast("long").alias("overlap"))


def backbone(edges: DataFrame, k: int, least: int) -> DataFrame:
    return simmelian(edges, k).where(F.col("overlap") >= least).select("src", "dst", "w")


def degrees(edges: DataFrame, digits: int = 6) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.round(F.sum("w"), digits).alias("strength"))


def authorship(edges: DataFrame) -> DataFrame:
    """(node, others, share, first_hit, hit) for texts of authors with others: the share of the author's other texts among
    as many nearest ones, whether the nearest is one, and the rank of the first. Ties by name."""
    w = Window.partitionBy("src").orderBy(F.desc("w"), "dst")
    ranked = edges.withColumn("_r", F.row_number().over(w)).withColumn("_own", author("src") == author("dst"))
    others = edges.where(author("src") == author("dst")).groupBy("src").agg(F.count("*").alias("others"))
    top = ranked.join(others, "src").groupBy(F.col("src").alias("node"), "others")
    hit = F.sum(F.when(F.col("_own") & (F.col("_r") <= F.col("others")), 1).otherwise(0))
    first = F.min(F.when(F.col("_own"), F.col("_r")))
    return top.agg(F.round(hit / F.col("others"), 6).alias("share"), first.cast("long").alias("first_hit")).withColumn("hit", F.col("first_hit") == 1)


def asymmetric(edges: DataFrame) -> DataFrame:
    """(n): edges without an equal one back; 0 for an undirected graph."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w"))
    return edges.join(back, ["src", "dst", "w"], "left_anti").agg(F.count("*").alias("n"))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def overview(edges: DataFrame, every: DataFrame) -> DataFrame:
    """Nodes, edges, isolated nodes and the range of weights."""
    e = edges.agg(F.count("*").alias("n_edges"), F.min("w").alias("least"), F.max("w").alias("most"))
    n = every.agg(F.count("*").alias("n_nodes"))
    alone = every.join(nodes_of(edges), "node", "left_anti").agg(F.count("*").alias("n_isolated"))
    # three tables of one row
    return n.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(alone))


def bfs(edges: DataFrame, start: DataFrame, most: int | None = None, rounds: int = 1000) -> DataFrame:
    """(start, node, hops): the fewest edges from each start to each node it reaches, itself 0.

    A frontier join a level, written to the shared folder; ends when a level is empty, or after most levels.
    """
    seen = start.select(F.col("node").alias("start"), "node", F.lit(0).alias("hops"))
    front = seen
    step = edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct()
    for level in range(1, rounds):
        if most is not None and level > most:
            return seen
        new = front.join(step, "node").select("start", F.col("next").alias("node")).distinct().join(seen, ["start", "node"], "left_anti")
        front = written(new.withColumn("hops", F.lit(level)))
        if front.isEmpty():
            return seen
        seen = written(seen.unionByName(front))
    raise RuntimeError("the graph is deeper than the number of rounds")


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, label): each node takes the most frequent label of its neighbours, the smallest of those that tie; all at once, fixed rounds."""
    pairs = written(edges.select("src", "dst"))
    label = nodes_of(pairs).withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = pairs.join(label.select(F.col("node").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("src").agg(F.max(F.col("n")).alias("n")).join(votes, ["src", "n"]).groupBy("src").agg(F.min("label").alias("label"))
        label = written(label.drop("label").join(best, label["node"] == best["src"], "left").select("node", F.coalesce("label", "node").alias("label")))
    return label


def assortativity_numeric(edges: DataFrame, attr: DataFrame) -> DataFrame:
    """(r): correlation of the ends' values over the edges; 1 if the values are all the same."""
    a, b = attr.select(F.col("node").alias("src"), F.col("value").alias("x")), attr.select(F.col("node").alias("dst"), F.col("value").alias("y"))
    e = edges.join(a, "src").join(b, "dst")
    return e.agg(F.when(F.stddev_pop("x") == 0, 1.0).otherwise(F.round(F.corr("x", "y"), 6)).alias("r"))


def assortativity_categorical(edges: DataFrame, attr: DataFrame) -> DataFrame:
    """(r): (tr e - sum ab) / (1 - sum ab) of the mixing matrix."""
    a, b = attr.select(F.col("node").alias("src"), F.col("value").alias("x")), attr.select(F.col("node").alias("dst"), F.col("value").alias("y"))
    mix = edges.join(a, "src").join(b, "dst").groupBy("x", "y").agg(F.count("*").alias("n"))
    total = mix.agg(F.sum("n").alias("_t"))
    p = mix.crossJoin(F.broadcast(total)).select("x", "y", (F.col("n") / F.col("_t")).alias("e"))
    same = p.where("x = y").agg(F.coalesce(F.sum("e"), F.lit(0.0)).alias("tr"))
    ab = p.groupBy("x").agg(F.sum("e").alias("a")).join(p.groupBy(F.col("y").alias("x")).agg(F.sum("e").alias("b")), "x").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0.0)).alias("ab"))
    return same.crossJoin(F.broadcast(ab)).select(F.round((F.col("tr") - F.col("ab")) / F.nullif(1 - F.col("ab"), F.lit(0.0)), 6).alias("r"))


def modularity(edges: DataFrame, clusters: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(modularity) of an undirected graph given both ways: sum over clusters of L/m - g (D/2m)^2."""
    a, b = clusters.select(F.col("node").alias("src"), F.col("label").alias("ca")), clusters.select(F.col("node").alias("dst"), F.col("label").alias("cb"))
    e = edges.join(a, "src").join(b, "dst")
    per = e.groupBy("ca").agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("d"))
    total = edges.agg(F.sum("w").alias("m2"))
    q = per.crossJoin(F.broadcast(total))
    return q.agg(F.round(F.sum(F.col("inside") / F.col("m2") - resolution * (F.col("d") / F.col("m2")) ** 2), 6).alias("modularity"))


def dbscan(edges: DataFrame, every: DataFrame, eps: float, least: int) -> DataFrame:
    """(node, core, label) over distances 1 - w: cores have least nodes within eps, themselves included.

    Cores within eps of each other are a cluster named by its smallest core; a border node takes the
    smallest cluster within eps; noise has a null label.
    """
    near = edges.where(1 - F.col("w") <= eps)
    n = every.join(near.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n")), "node", "left").select("node", (F.coalesce("n", F.lit(0)) + 1 >= least).alias("core"))
    n = written(n)
    cores = n.where("core").select("node")
    among = near.join(cores.select(F.col("node").alias("src")), "src", "left_semi").join(cores.select(F.col("node").alias("dst")), "dst", "left_semi")
    loops = cores.select(F.col("node").alias("src"), F.col("node").alias("dst"))
    label = components(among.select("src", "dst").unionByName(loops), "src", "dst")
    border = near.join(label.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near_label"))
    out = n.join(label.withColumnRenamed("component", "own"), "node", "left").join(border, "node", "left")
    return out.select("node", "core", F.coalesce("own", "near_label").alias("label"))


def relabel(clusters: DataFrame, label: str = "label", key: str = "node") -> DataFrame:
    """(key, cluster): clusters from 0 by falling size, equal sizes by their smallest key. The window holds one row a cluster."""
    size = clusters.groupBy(label).agg(F.count("*").alias("_n"), F.min(key).alias("_f"))
    num = size.withColumn("cluster", F.row_number().over(Window.orderBy(F.desc("_n"), "_f")) - 1)
    return clusters.join(num, label).select(key, F.col("cluster").cast("long").alias("cluster"))


def silhouette(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(silhouette) over distances 1 - w: mean of (b - a) / max(a, b); nodes alone in a cluster score 0."""
    c = clusters.select("node", "label")
    d = edges.join(c.select(F.col("node").alias("src"), F.col("label").alias("ca")), "src").join(c.select(F.col("node").alias("dst"), F.col("label").alias("cb")), "dst")
    mean = d.groupBy("src", "ca", "cb").agg(F.avg(1 - F.col("w")).alias("m"))
    ab = mean.groupBy("src").agg(F.min(F.when(F.col("ca") == F.col("cb"), F.col("m"))).alias("a"), F.min(F.when(F.col("ca") != F.col("cb"), F.col("m"))).alias("b"))
    s = F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)))
    return ab.agg(F.round(F.avg(F.coalesce(s, F.lit(0.0))), 6).alias("silhouette"))


def replace_nan(edges: DataFrame, value: float = 0.0) -> DataFrame:
    """edges with value for weights that are null or no number."""
    return edges.withColumn("w", F.coalesce(F.nanvl("w", F.lit(value)), F.lit(value)))


def bad_weights(edges: DataFrame) -> DataFrame:
    """(n_edges, n_null, n_nan, n_loops): what a network shouldn't have."""
    return edges.agg(F.count("*").alias("n_edges"), F.count_if(F.col("w").isNull()).alias("n_null"), F.count_if(F.isnan("w")).alias("n_nan"), F.count_if(F.col("src") == F.col("dst")).alias("n_loops"))


def matrix_checks(cells: DataFrame) -> DataFrame:
    """(n_nodes, n_cells, n_missing, n_repeated, n_asymmetric, n_off_diagonal) of a matrix (src, dst, w) that may hold its diagonal.

    Missing are cells off the diagonal that no row gives; off the diagonal are diagonal cells other than 1.
    """
    nodes = nodes_of(cells).agg(F.count("*").alias("n_nodes"))
    one = cells.groupBy("src", "dst").agg(F.count("*").alias("_k"), F.min("w").alias("w"))
    back = one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("_b"))
    both = one.join(back, ["src", "dst"], "left")
    off = F.col("src") != F.col("dst")
    n = both.agg(
        F.sum("_k").alias("n_cells"), F.count_if(off).alias("_off"), F.coalesce(F.sum(F.col("_k") - 1), F.lit(0)).alias("n_repeated"),
        F.count_if(off & ~F.col("w").eqNullSafe(F.col("_b"))).alias("n_asymmetric"), F.count_if(~off & (F.col("w") != 1)).alias("n_off_diagonal"),
    )
    # two tables of one row
    return nodes.crossJoin(F.broadcast(n)).select("n_nodes", "n_cells", (F.col("n_nodes") * (F.col("n_nodes") - 1) - F.col("_off")).alias("n_missing"), "n_repeated", "n_asymmetric", "n_off_diagonal")


def condensed(edges: DataFrame) -> DataFrame:
    """(place, w): the triangle above the diagonal, row by row in the order of the nodes."""
    from quillspark.operators.numbering import numbered

    return numbered(edges.where("src < dst").select("src", "dst", "w"), "place", "src", "dst").select("place", "w")


def complete_graph(spark, n: int) -> DataFrame:
    """(src, dst, w) of n nodes, numbered from 0, all joined both ways with weight 1."""
    a = spark.range(n).select(F.col("id").alias("src"))
    return a.withColumn("dst", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).where("src <> dst").withColumn("w", F.lit(1.0))


def random_matrix(spark, n: int, seed: int = 1, levels: int = 97) -> DataFrame:
    """(src, dst, w) of a symmetric matrix of n nodes whose weights are multiples of 1 / levels, from the seed alone."""
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    mixed = (a * 7919 + b * 104729 + a * b * 31 + seed * 15485863) % levels
    return complete_graph(spark, n).withColumn("w", mixed / levels)


def path_counts(edges: DataFrame) -> DataFrame:
    """(start, node, hops, paths): the number of shortest paths between every two nodes that reach each other, itself included.

    The hops come from bfs(); the counts follow level by level, each a table. All pairs are the operator's
    result, so it is for networks of merged texts.
    """
    hops = written(bfs(edges, nodes_of(edges)))
    step = written(edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct())
    most = hops.agg(F.max("hops")).first()[0] or 0
    level = written(hops.where("hops = 0").withColumn("paths", F.lit(1).cast("double")))
    out = level
    for k in range(1, most + 1):
        on = level.join(step, "node").groupBy("start", F.col("next").alias("node")).agg(F.sum("paths").alias("paths"))
        level = written(on.join(hops.where(F.col("hops") == k), ["start", "node"]).select("start", "node", "hops", "paths"))
        out = out.unionByName(level)
    return out


def centralities(edges: DataFrame) -> DataFrame:
    """(node, degree, closeness, betweenness) of an undirected network given both ways.

    Closeness is (r - 1) / sum of hops, times the share of the nodes that are reached; betweenness counts each
    pair of ends once. The sums over triples run on the pairs by key.
    """
    p = written(path_counts(edges))
    n = p.where("hops = 0").count()
    near = p.where("hops > 0").groupBy(F.col("start").alias("node")).agg((F.count("*") / F.sum("hops") * F.count("*") / max(1, n - 1)).alias("closeness"))
    a = p.where("hops > 0").select(F.col("node").alias("v"), F.col("start").alias("s"), F.col("hops").alias("h1"), F.col("paths").alias("p1"))
    b = p.where("hops > 0").select(F.col("start").alias("v"), F.col("node").alias("t"), F.col("hops").alias("h2"), F.col("paths").alias("p2"))
    st = p.where("start < node").select(F.col("start").alias("s"), F.col("node").alias("t"), F.col("hops").alias("h"), F.col("paths").alias("p"))
    between = a.join(b, "v").where("s < t").join(st, ["s", "t"]).where("h1 + h2 = h").groupBy(F.col("v").alias("node")).agg(F.sum(F.col("p1") * F.col("p2") / F.col("p")).alias("betweenness"))
    d = degrees(edges).select("node", "degree")
    return d.join(near, "node", "left").join(between, "node", "left").select("node", "degree", F.round(F.coalesce("closeness", F.lit(0.0)), 6).alias("closeness"), F.round(F.coalesce("betweenness", F.lit(0.0)), 4).alias("betweenness"))


def in_polygon(x, y, corners: list[tuple[float, float]]):
    """Is the point inside the polygon: its ray to the right crosses an odd number of sides."""
    hits = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1]):
        if y1 != y2:
            crosses = (F.lit(min(y1, y2)) <= y) & (y < F.lit(max(y1, y2))) & (x < F.lit(x1) + (y - y1) * ((x2 - x1) / (y2 - y1)))
            hits = hits + F.when(crosses, 1).otherwise(0)
    return hits % 2 == 1
