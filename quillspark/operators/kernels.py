"""Clustering kernels on one matrix in memory, run one task a (matrix, parameters): a network has hundreds of nodes.

Every kernel takes a symmetric numpy matrix and gives one label a row; ties fall to the smallest index.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Coefficients of the distance from a merged pair to another cluster: sizes of the two and of the other.
LINKAGES = ("single", "complete", "average", "weighted", "centroid", "median", "ward")


def linkage(dist: np.ndarray, method: str) -> list[tuple[int, int, float]]:
    """Merges (i, j, height) of agglomerative clustering by the recurrence of its method; cluster i lives on under i < j."""
    n = len(dist)
    squared = method in ("centroid", "median", "ward")
    d = dist.astype(float) ** 2 if squared else dist.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, out = np.ones(n), []
    live = np.ones(n, dtype=bool)
    for _ in range(n - 1):
        k = int(d.argmin())
        i, j = sorted(divmod(k, n))
        h = d[i, j]
        a, b = size[i], size[j]
        x, y = d[i], d[j]
        if method == "single":
            new = np.minimum(x, y)
        elif method == "complete":
            new = np.maximum(x, y)
        elif method == "average":
            new = (a * x + b * y) / (a + b)
        elif method == "weighted":
            new = (x + y) / 2
        elif method == "centroid":
            new = (a * x + b * y) / (a + b) - a * b * h / (a + b) ** 2
        elif method == "median":
            new = (x + y) / 2 - h / 4
        elif method == "ward":
            new = ((a + size) * x + (b + size) * y - size * h) / (a + b + size)
        else:
            raise ValueError(f"no linkage is called {method}")
        live[j] = False
        new[~live] = np.inf
        new[i] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        size[i] = a + b
        out.append((i, j, float(np.sqrt(max(h, 0.0)) if squared else h)))
    return out


def hierarchical(dist: np.ndarray, n_clusters: int, method: str = "average") -> np.ndarray:
    """Labels after merging down to n_clusters."""
    n = len(dist)
    parent = np.arange(n)
    for i, j, _ in linkage(dist, method)[: max(0, n - n_clusters)]:
        parent[parent == j] = i
    return np.unique(parent, return_inverse=True)[1]


def leaf_order(dist: np.ndarray) -> list[int]:
    """The order of the leaves of average linkage, over all turns of its merges, whose neighbours are nearest in sum.

    best[v][i, j] is the least cost of the leaves of v in an order from leaf i to leaf j; a merge combines the
    tables of its two sides by the least sum over the leaves that meet.
    """
    n = len(dist)
    if n == 0:
        return []
    kids: dict[int, tuple[int, int]] = {}
    leaves, best, live = {i: [i] for i in range(n)}, {i: np.zeros((1, 1)) for i in range(n)}, {i: i for i in range(n)}
    top = 0
    for k, (i, j, _) in enumerate(linkage(dist, "average")):
        top, a, b = n + k, live.pop(i), live.pop(j)
        kids[top], live[i] = (a, b), top
        leaves[top] = leaves[a] + leaves[b]
        mid = dist[np.ix_(leaves[a], leaves[b])]
        step = np.array([(row[:, None] + mid).min(axis=0) for row in best[a]])
        cross = np.array([(row[:, None] + best[b]).min(axis=0) for row in step])
        m = np.full((len(leaves[top]),) * 2, np.inf)
        m[: len(leaves[a]), len(leaves[a]) :], m[len(leaves[a]) :, : len(leaves[a])] = cross, cross.T
        best[top] = m

    def walk(v: int, first: int, last: int) -> list[int]:
        if v < n:
            return [v]
        a, b = kids[v]
        if first not in leaves[a]:
            a, b = b, a
        i, j = leaves[a].index(first), leaves[b].index(last)
        cost = best[a][i][:, None] + dist[np.ix_(leaves[a], leaves[b])] + best[b][:, j][None, :]
        x, y = np.unravel_index(int(cost.argmin()), cost.shape)
        return walk(a, first, leaves[a][x]) + walk(b, leaves[b][y], last)

    i, j = np.unravel_index(int(best[top].argmin()), best[top].shape)
    return walk(top, leaves[top][i], leaves[top][j])


def medoids(dist: np.ndarray, k: int, rounds: int = 100) -> tuple[np.ndarray, list[int], float]:
    """Partition around medoids: greedy build, then the best swap while it lowers the cost. Labels, medoids and cost."""
    n = len(dist)
    k = min(k, n)
    chosen = [int(dist.sum(axis=1).argmin())] if n else []
    while len(chosen) < k:
        near = dist[:, chosen].min(axis=1)
        gain = np.maximum(near[:, None] - dist, 0).sum(axis=0)
        gain[chosen] = -1
        chosen.append(int(gain.argmax()))
    cost = float(dist[:, chosen].min(axis=1).sum()) if chosen else 0.0
    for _ in range(rounds):
        best = (cost - 1e-12, None)
        for m in range(k):
            rest = [c for x, c in enumerate(chosen) if x != m]
            near = dist[:, rest].min(axis=1) if rest else np.full(n, np.inf)
            costs = np.minimum(near[:, None], dist).sum(axis=0)
            costs[chosen] = np.inf
            h = int(costs.argmin())
            if costs[h] < best[0]:
                best = (float(costs[h]), (m, h))
        if best[1] is None:
            break
        chosen[best[1][0]], cost = best[1][1], best[0]
    return dist[:, chosen].argmin(axis=1), chosen, cost


def kmeans(x: np.ndarray, k: int, rounds: int = 100) -> np.ndarray:
    """Lloyd's rounds from starts that are farthest apart."""
    at = [int((x**2).sum(axis=1).argmax())]
    reach = ((x - x[at[0]]) ** 2).sum(axis=1)
    while len(at) < min(k, len(x)):
        at.append(int(reach.argmax()))
        reach = np.minimum(reach, ((x - x[at[-1]]) ** 2).sum(axis=1))
    c = x[at]
    label = np.zeros(len(x), dtype=int)
    for _ in range(rounds):
        new = ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([x[new == i].mean(axis=0) if (new == i).any() else c[i] for i in range(len(c))])
        if (new == label).all():
            break
        label = new
    return label


def spectral(sim: np.ndarray, k: int) -> np.ndarray:
    """k-means on the rows of the leading eigenvectors of the normalised similarity."""
    s = np.maximum(sim, 0)
    deg = s.sum(axis=1)
    f = 1 / np.sqrt(np.where(deg > 0, deg, 1))
    _, vec = np.linalg.eigh(f[:, None] * s * f[None, :])
    top = vec[:, -min(k, len(s)) :]
    top = top * np.where(top[np.abs(top).argmax(axis=0), np.arange(top.shape[1])] < 0, -1, 1)
    norm = np.linalg.norm(top, axis=1, keepdims=True)
    return kmeans(top / np.where(norm > 0, norm, 1), k)


def louvain(adj: np.ndarray, resolution: float = 1.0) -> np.ndarray:
    """Nodes move, in their order, to the neighbouring community of greatest gain; communities then become nodes, until none moves."""
    label = np.arange(len(adj))
    a = adj.astype(float)
    total = a.sum()
    if total <= 0:
        return label
    while True:
        n = len(a)
        com, deg = np.arange(n), a.sum(axis=1)
        moved = False
        while True:
            changed = False
            for i in range(n):
                links = np.bincount(com, weights=a[i], minlength=n)
                links[com[i]] -= a[i, i]
                weight = np.bincount(com, weights=deg, minlength=n)
                weight[com[i]] -= deg[i]
                gain = links - resolution * deg[i] * weight / total
                gain[(links == 0) & (np.arange(n) != com[i])] = -np.inf
                best = int(gain.argmax())
                if gain[best] > gain[com[i]] + 1e-12:
                    com[i], changed, moved = best, True, True
            if not changed:
                break
        names, com = np.unique(com, return_inverse=True)
        label = com[label]
        if not moved or len(names) == n:
            return label
        m = np.zeros((len(names), n))
        m[com, np.arange(n)] = 1
        a = m @ a @ m.T


def mds(dist: np.ndarray, dims: int = 2, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Stress majorisation from the classical solution: coordinates and stress."""
    n = len(dist)
    if n == 0:
        return np.zeros((0, dims)), 0.0
    j = np.eye(n) - 1 / n
    val, vec = np.linalg.eigh(-0.5 * j @ dist**2 @ j)
    x = np.zeros((n, dims))
    m = min(dims, n)
    x[:, :m] = vec[:, ::-1][:, :m] * np.sqrt(np.maximum(val[::-1][:m], 0))
    old = np.inf
    for _ in range(rounds):
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        stress = float(((d - dist) ** 2).sum() / 2)
        if old - stress < 1e-9 * max(1.0, stress):
            break
        old = stress
        ratio = np.divide(dist, d, out=np.zeros_like(d), where=d > 0)
        b = -ratio
        b[np.arange(n), np.arange(n)] = ratio.sum(axis=1)
        x = b @ x / n
    return x, stress


def _labels(alg: str, param: str, sim: np.ndarray) -> np.ndarray:
    dist = 1 - sim
    np.fill_diagonal(dist, 0)
    if alg == "hierarchical":
        n, method = param.split("-")
        return hierarchical(dist, int(n), method)
    if alg == "spectral":
        return spectral(sim, int(param))
    if alg == "medoids":
        return medoids(dist, int(param))[0]
    if alg == "dbscan":
        eps, least = param.split("-")
        return dbscan_labels(1 - sim, float(eps), int(least))
    if alg == "lpa":
        adj = np.where(sim >= float(param), sim, 0.0)
        np.fill_diagonal(adj, 0)
        return propagated_labels(adj)
    if alg == "louvain":
        adj = sim.copy()
        np.fill_diagonal(adj, 0)
        return louvain(adj, float(param))
    raise ValueError(f"no algorithm is called {alg}")


def dense(edges: pd.DataFrame, directed: bool = False) -> tuple[list, np.ndarray]:
    """Names in order, and the matrix with ones on the diagonal."""
    names = sorted(set(edges["src"]) | set(edges["dst"]))
    at = {n: i for i, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    m[edges["src"].map(at).to_numpy(dtype=int), edges["dst"].map(at).to_numpy(dtype=int)] = edges["w"].to_numpy(dtype=float)
    if not directed:
        m = np.maximum(m, m.T)
    np.fill_diagonal(m, 1.0)
    return names, m


class _TooLong(Exception):
    pass


def _within(seconds: float | None, f: Callable):
    """f(), or null if it takes longer; the limit needs the main thread of a Unix process, which a Python worker is."""
    if not seconds:
        return f()
    import signal

    on = [True]

    def stop(*_):
        if on[0]:
            raise _TooLong

    before = signal.signal(signal.SIGALRM, stop)
    try:
        signal.setitimer(signal.ITIMER_REAL, seconds)
        out = f()
        on[0] = False
        return out
    except _TooLong:
        return None
    finally:
        on[0] = False
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


GRID_SCHEMA = "mxname string, alg string, param string, node string, cluster int, outcome string"


def cluster_grid(matrices: DataFrame, grid: list[tuple[str, str]], seconds: float | None = None, done: DataFrame | None = None, parts: int = 8) -> DataFrame:
    """(mxname, alg, param, node, cluster, outcome): every algorithm of the grid on every matrix (mxname, src, dst, w).

    A matrix is one group and its grid runs in parts, so it is sent parts times whatever the size of the grid. A
    run over the limit of seconds gives one row with outcome timeout, others success; noise has a null cluster.
    Runs in done (mxname, alg, param) are not made again.
    """
    spark = matrices.sparkSession
    left = None
    if done is not None:
        left = {tuple(r) for r in done.select("mxname", "alg", "param").distinct().collect()}  # a row a run of the grid
    names_ = [r["mxname"] for r in matrices.select("mxname").distinct().collect()]
    todo = [(m, k % parts, a, p) for m in names_ for k, (a, p) in enumerate(grid) if left is None or (m, a, p) not in left]
    if not todo:
        return spark.createDataFrame([], GRID_SCHEMA)
    plan: dict[tuple[str, int], list[tuple[str, str]]] = {}
    for m, k, a, p in todo:
        plan.setdefault((m, k), []).append((a, p))
    work = spark.createDataFrame(sorted(plan), "mxname string, part int")

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        names, sim = dense(pdf)
        out = []
        for alg, param in plan[(key[0], int(key[1]))]:
            lab = _within(seconds, lambda: _labels(alg, param, sim))
            if lab is None:
                out.append(pd.DataFrame({"mxname": [key[0]], "alg": alg, "param": param, "node": None, "cluster": None, "outcome": "timeout"}))
                continue
            lab = list(lab)
            size = pd.Series([c for c in lab if c is not None and c >= 0]).value_counts()
            first = {c: i for i, c in reversed(list(enumerate(lab)))}
            order = {c: i for i, c in enumerate(sorted(size.index, key=lambda c: (-size[c], first[c])))}
            out.append(pd.DataFrame({"mxname": key[0], "alg": alg, "param": param, "node": names, "cluster": pd.array([order.get(c) for c in lab], dtype="Int32"), "outcome": "success"}))
        return pd.concat(out).astype({"cluster": "Int32"})

    # the list of runs is a parameter, not data
    spread = matrices.select("mxname", "src", "dst", "w").join(F.broadcast(work), "mxname")
    return spread.groupBy("mxname", "part").applyInPandas(run, GRID_SCHEMA)


def dbscan_labels(dist: np.ndarray, eps: float, least: int) -> list[int]:
    """Labels of density clusters; -1 for noise. Cores within eps are joined, a border node takes the first core's."""
    near = dist <= eps
    np.fill_diagonal(near, True)
    core = near.sum(axis=1) >= least
    label = [-1] * len(dist)
    k = 0
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        todo = [i]
        label[i] = k
        while todo:
            for j in np.flatnonzero(near[todo.pop()] & core):
                if label[j] < 0:
                    label[j] = k
                    todo.append(j)
        k += 1
    for i in np.flatnonzero(~core):
        hit = np.flatnonzero(near[i] & core)
        if len(hit):
            label[i] = min(label[j] for j in hit)
    return label


def propagated_labels(adjacent: np.ndarray, rounds: int = 20) -> list[int]:
    """Labels by propagation: each node takes the heaviest label beside it, the smallest of equals, all at once, until none changes."""
    n = len(adjacent)
    label = np.arange(n)
    for _ in range(rounds):
        votes = np.zeros((n, n))
        for c in np.unique(label):
            votes[:, c] = adjacent[:, label == c].sum(axis=1)
        new = np.where(votes.max(axis=1) > 0, votes.argmax(axis=1), label)
        if (new == label).all():
            break
        label = new
    return label.tolist()


def _warp(a: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Dynamic time warping of the sequence a to each row of others, of which the first sizes count; a step costs max / min - 1.

    All rows at once, one diagonal of the table after another.
    """
    n, longest = len(a), others.shape[1]
    at = np.arange(n)
    out = np.full(len(others), np.inf)
    one = two = np.full((len(others), n), np.inf)
    for t in range(n + longest - 1):
        j = t - at
        b = others[:, j.clip(0, longest - 1)]
        best = one.copy()
        best[:, 1:] = np.minimum(best[:, 1:], np.minimum(one[:, :-1], two[:, :-1]))
        if t == 0:
            best[:, 0] = 0
        best += np.maximum(a, b) / np.minimum(a, b) - 1
        best[:, (j < 0) | (j >= longest)] = np.inf
        ends = sizes + n - 2 == t
        out[ends] = best[ends, -1]
        one, two = best, one
    return out


def structural_costs(adjacent: np.ndarray) -> list[np.ndarray]:
    """One matrix of costs a number of hops from 0 to the diameter: how unlike the surroundings of two nodes are up to there.

    The costs of a layer are those of the one before plus the warping distance of the ordered degrees of the
    two rings at that many hops; infinite where a node has no such ring, and between a node and itself.
    """
    n = len(adjacent)
    a = (adjacent | adjacent.T) & ~np.eye(n, dtype=bool)
    degree = a.sum(axis=1).astype(float)
    seen = front = np.eye(n, dtype=bool)
    cost, out = np.zeros((n, n)), []
    while front.any():
        sizes = front.sum(axis=1)
        rings = np.ones((n, sizes.max()))
        for u in range(n):
            rings[u, : sizes[u]] = np.sort(degree[front[u]])
        step = np.full((n, n), np.inf)
        for u in np.flatnonzero(sizes):
            v = np.flatnonzero(sizes[u + 1 :]) + u + 1
            if len(v):
                step[u, v] = step[v, u] = _warp(rings[u, : sizes[u]], rings[v], sizes[v])
        cost = cost + step
        out.append(cost)
        front = (front.astype(np.float32) @ a.astype(np.float32) > 0) & ~seen
        seen = seen | front
    return out


def structural_walks(costs: list[np.ndarray], per_node: int, length: int, seed: int, stay: float = 0.3) -> list[list[int]]:
    """Walks from each node over the layers of structural_costs(), as published for struc2vec.

    With probability stay a walk goes on in its layer, to a node drawn by exp(-cost); otherwise it changes
    the layer: up by ln(e + edges of the node above the layer's mean weight) against 1 for down.
    """
    draws, up, there = [], [], []
    for c in costs:
        some = np.isfinite(c)
        w = np.exp(-c)
        heavy = (w > (w[some].mean() if some.any() else 0.0)).sum(axis=1)
        up.append(np.log(heavy + np.e) / (np.log(heavy + np.e) + 1))
        there.append(some.any(axis=1))
        least = np.where(there[-1], c.min(axis=1), 0.0)
        p = np.exp(least[:, None] - c).cumsum(axis=1)
        draws.append(p)
    rng = np.random.default_rng(seed)
    out = []
    for start in range(len(costs[0]) if costs else 0):
        for _ in range(per_node):
            path, k = [start], 0
            while len(path) < length:
                u = path[-1]
                if rng.random() < stay:
                    p = draws[k][u]
                    path.append(int(np.searchsorted(p, rng.random() * p[-1], side="right")))
                elif rng.random() < up[k][u]:
                    k += k + 1 < len(costs) and bool(there[k + 1][u])
                else:
                    k = max(k - 1, 0)
            out.append(path)
    return out
