"""Embedding near-dedup on a robust-pruned flat graph.

Vectors link when their labels are equal and their cosine is at least
``threshold`` (double precision).

1. *Overlapping cluster shards.* Centroids come from a bounded sample of each
   label (``SAMPLE`` rows, the smallest hashes; k-means). A vector visits the shards
   of its ``overlap`` nearest centroids and belongs to the nearest one. A shard
   of over ``SHARD`` vectors is dealt over blocks, and any two blocks meet in a
   group of their own.
2. *Graph.* In each shard a vector gets its nearest visitors as candidates,
   robustly pruned (a candidate goes when a kept one is nearer to it by the
   factor ``ALPHA``). The adjacency lists of all shards are united, and read in
   both directions.
3. *Search.* Every visitor runs a greedy beam search over the united lists,
   all at once in numpy, from the shard's medoid and from the visitor's own list (a
   dense group's lists name its members alone, so the medoid need not reach the others);
   what lies in range is then expanded through its neighbours until nothing new is in range.
4. *Verify, audit.* Hits are checked by the cosine in double precision and
   leave a shard as a spanning forest only, which joins them to components. The
   links of a vector are then counted inside its component, exactly, by blocks
   of ``BLOCK`` x ``BLOCK``: in a dense group every vector gets all its links.
   The recall of a sample is measured against brute force, node by node, and
   while it is below ``RECALL`` each vector visits further shards (``OVERLAPS``), whose
   links join those already found. Nodes with over ``DENSE`` links are judged apart, so
   that they can't speak for the others. When the last overlap falls short too, or all
   vectors of a label share one shard already, any two blocks of a label meet.

Copies of a vector are one node, with their number as its weight.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null label, link with nothing (0 links, their own
component, kept); rows that repeat id, label and vector are one vector; a null
id is a vector without a name: it counts as a link of others but names no
component unless nothing else can; vectors of another dimension never link.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.common import broadcast_if, prepare, smallest_reachable
from tandem.llm.permutation_index import matrix
from tandem.session import cut_lineage

THRESHOLD, OVERLAPS = 0.93, (2, 4, 8)
CLUSTER, SHARD, SAMPLE, MAX_CLUSTERS = 4000, 12000, 4096, 256
CANDIDATES, DEGREE, ALPHA, BEAM, ENTRIES = 48, 24, 1.2, 32, 4
AUDIT, DENSE, RECALL, BLOCK, LABEL_BLOCK, LARGE = 4096, 64, 0.999, 256, 2048, 1_000_000


def prune(x: np.ndarray, near: np.ndarray, sims: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """Robust pruning of each row's candidates ``near`` (best first): distances are 1 - cosine."""
    out = []
    for i in range(len(near)):
        cand, d = near[i], 1 - sims[i]
        between = 1 - x[cand] @ x[cand].T
        alive, kept = np.ones(len(cand), bool), []
        for j in range(len(cand)):
            if alive[j]:
                kept.append(j)
                if len(kept) == degree:
                    break
                alive &= alpha * between[j] > d
                alive[j] = False
        out.append(cand[kept])
    return out


def build(x: np.ndarray) -> list[np.ndarray]:
    """Pruned adjacency lists among the rows of ``x`` (unit vectors)."""
    n = len(x)
    if n < 2:
        return [np.zeros(0, np.int64)] * n
    k, out = min(CANDIDATES, n - 1), []
    for lo in range(0, n, 512):
        s = x[lo : lo + 512] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -2
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        sims = np.take_along_axis(s, near, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        out += prune(x, np.take_along_axis(near, order, 1), np.take_along_axis(sims, order, 1))
    return out


def _padded(lists: list[np.ndarray], n: int, x: np.ndarray) -> np.ndarray:
    """Adjacency in both directions as a matrix; the row's own number fills up.

    A row that very many lists name keeps its own list and the nearest
    ``DEGREE`` of those that name it; the others still name it.
    """
    size = np.array([len(v) for v in lists], np.int64)
    a, b = np.repeat(np.arange(n), size), np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64)
    sims = np.einsum("ij,ij->i", x[a], x[b])
    order = np.lexsort((-sims, b))
    rank = np.arange(len(b)) - np.searchsorted(b[order], b[order])
    back = order[rank < DEGREE]
    pairs = np.unique(np.concatenate((a * n + b, b[back] * n + a[back])))
    a, b = pairs // n, pairs % n
    place = np.arange(len(a)) - np.searchsorted(a, a)
    out = np.repeat(np.arange(n)[:, None], int(place.max(initial=0)) + 1, axis=1)
    out[a, place] = b
    return out


def range_search(x: np.ndarray, adjacency: np.ndarray, threshold: float, beam: int = BEAM) -> list[np.ndarray]:
    """For each row of ``x``: the other rows found with a cosine of at least ``threshold`` (with a margin for single precision)."""
    n = len(x)
    low = threshold - 1e-5
    centre = x.mean(0)
    medoid = int(np.argmax(x @ centre))
    spread = np.argsort(x @ centre, kind="stable")[:: max(1, n // ENTRIES)][:ENTRIES]  # further entries: a cluster may fall apart
    entries = np.unique(np.concatenate(([medoid], spread)))
    out: list[np.ndarray] = []
    for lo in range(0, n, 1024):
        q = x[lo : lo + 1024]
        m = len(q)
        seen = np.zeros((m, n), bool)
        ids = np.full((m, beam), -1, np.int64)
        sims = np.full((m, beam), -9.0, np.float32)
        open_ = np.zeros((m, beam), bool)
        rows = np.arange(m)
        start = np.concatenate((adjacency[lo : lo + m], np.broadcast_to(entries, (m, len(entries)))), axis=1)
        fresh = np.zeros(start.shape, bool)
        for j in range(start.shape[1]):  # a list is filled up with the row's own number, and may name an entry
            fresh[:, j] = ~seen[rows, start[:, j]]
            seen[rows, start[:, j]] = True
        first = np.where(fresh, np.einsum("ijk,ik->ij", x[start], q, optimize=False), np.float32(-9))
        top = np.argsort(-first, axis=1, kind="stable")[:, :beam]
        k = top.shape[1]
        ids[:, :k], sims[:, :k], open_[:, :k] = (np.take_along_axis(v, top, 1) for v in (start, first, fresh))
        rows = np.arange(m)
        while len(rows):
            best = np.where(open_[rows], sims[rows], -9).argmax(1)
            live = open_[rows, best]
            rows, best = rows[live], best[live]
            if not len(rows):
                break
            open_[rows, best] = False
            new = adjacency[ids[rows, best]]
            fresh = ~seen[rows[:, None], new]
            seen[rows[:, None], new] = True
            s = np.where(fresh, np.einsum("ijk,ik->ij", x[new], q[rows], optimize=False), np.float32(-9))
            all_ids, all_sims = np.concatenate((ids[rows], new), 1), np.concatenate((sims[rows], s), 1)
            all_open = np.concatenate((open_[rows], fresh), 1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[rows], sims[rows] = np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_sims, top, 1)
            open_[rows] = np.take_along_axis(all_open, top, 1)
        for i in range(m):
            hits = ids[i][sims[i] >= low]
            if len(hits) <= 1:
                out.append(hits[hits != lo + i])
                continue
            done = np.zeros(n, bool)
            found, front = [hits], hits
            done[hits] = True
            while len(front):
                nb = np.unique(adjacency[front])
                nb = nb[~done[nb]]
                done[nb] = True
                front = nb[x[nb] @ q[i] >= low]
                found.append(front)
            hits = np.concatenate(found)
            out.append(hits[hits != lo + i])
    return out


def _forest(links: list[np.ndarray]) -> list[tuple[int, int]]:
    """One link for each row that a breadth-first walk reaches first."""
    n, seen, out = len(links), np.zeros(len(links), bool), []
    back: list[list[int]] = [[] for _ in range(n)]
    for i, v in enumerate(links):
        for j in v.tolist():
            back[j].append(i)
    for s in range(n):
        if seen[s]:
            continue
        seen[s] = True
        todo = deque([s])
        while todo:
            i = todo.popleft()
            for j in (*links[i].tolist(), *back[i]):
                if not seen[j]:
                    seen[j] = True
                    out.append((i, j))
                    todo.append(j)
    return out


def _kmeans(x: np.ndarray, k: int) -> np.ndarray:
    c = x[:: max(1, len(x) // k)][:k].copy()
    for _ in range(6):
        a = (x @ c.T).argmax(1)
        for i in range(len(c)):
            m = x[a == i].sum(0)
            if np.linalg.norm(m) > 0:
                c[i] = m / np.linalg.norm(m)
    return c


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _rows(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Each vector once; ``same`` names its label and components where it can link."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"),
                          F.col(vector).cast("array<double>").alias("v")).distinct()
    good = F.col("label").isNotNull() & (F.size("v") > 0) & F.forall(
        "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.withColumn("same", F.when(F.coalesce(good, F.lit(False)), F.xxhash64("label", "v")))


def _centroids(nodes: DataFrame) -> dict[str, np.ndarray]:
    """Centroids of the labels that need more than one shard, from SAMPLE rows of each at most; one for CLUSTER vectors or more."""
    big = nodes.groupBy("label").count().where(F.col("count") > 2 * CLUSTER)
    ranked = nodes.join(broadcast_if(cut_lineage(big, "labels"), LARGE), "label").select(
        "label", "count", "node", "v", F.row_number().over(Window.partitionBy("label").orderBy("node")).alias("rank"))

    def centres(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        dim = len(pdf["v"].iloc[0])
        x = _unit(matrix([v for v in pdf["v"] if len(v) == dim]))
        c = _kmeans(x, min(MAX_CLUSTERS, max(2, round(int(pdf["count"].iloc[0]) / CLUSTER))))
        return pd.DataFrame({"label": [pdf["label"].iloc[0]] * len(c), "c": list(c)})

    got: dict[str, list] = {}
    for r in ranked.where(F.col("rank") <= SAMPLE).groupBy("label").applyInPandas(centres, "label string, c array<double>").toLocalIterator():
        got.setdefault(r["label"], []).append(r["c"])
    return {k: np.array(v) for k, v in got.items()}


def _visits(nodes: DataFrame, centroids: dict[str, np.ndarray], overlap: int) -> DataFrame:
    """(label, shard, block, node, v): a row for each shard that a vector visits, its ``overlap`` nearest ones."""
    sent = nodes.sparkSession.sparkContext.broadcast(centroids)

    def run(it):
        for pdf in it:
            out = []
            for name, part in pdf.groupby("label", sort=False):
                c = sent.value.get(name)
                dims = part["v"].map(len).to_numpy()
                for dim in np.unique(dims):
                    p = part[dims == dim]
                    if c is None or c.shape[1] != dim:
                        out.append(p.assign(shard=-int(dim)))
                        continue
                    t = min(overlap, len(c))
                    best = np.argsort(-(_unit(matrix(p["v"])) @ c.T), axis=1, kind="stable")[:, :t]
                    rep = p.loc[p.index.repeat(t)]
                    out.append(rep.assign(shard=best.ravel()))
            if out:
                yield pd.concat(out)[["label", "shard", "node", "v"]]

    visits = cut_lineage(nodes.select("label", "node", "v").mapInPandas(
        run, "label string, shard int, node long, v array<double>"), "visits")
    blocks = visits.groupBy("label", "shard").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("blocks"))
    # a large shard: its visitors are dealt over blocks, and any two blocks meet in one group
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    meet = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.concat_ws(
        "-", F.least(F.col("own"), j), F.greatest(F.col("own"), j)))).alias("block")
    return visits.join(blocks, ["label", "shard"]).withColumn("own", own).select("label", "shard", meet, "node", "v")


def _links(visits: DataFrame, threshold: float) -> DataFrame:
    """(a, b): a forest of the verified links of each shard."""
    group = ["label", "shard", "block"]

    def build_group(pdf: pd.DataFrame) -> pd.DataFrame:
        node = pdf["node"].to_numpy(np.int64)
        lists = build(_unit(matrix(pdf["v"])).astype(np.float32))
        return pd.DataFrame({"node": node, "near": [node[v] for v in lists]})

    lists = visits.groupBy(*group).applyInPandas(build_group, "node long, near array<long>")
    united = cut_lineage(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "adjacency")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        v = _unit(matrix(pdf["v"]))
        x, place = v.astype(np.float32), {int(n): i for i, n in enumerate(pdf["node"])}
        lists = [np.array([place[int(j)] for j in near if int(j) in place], np.int64) if near is not None else np.zeros(0, np.int64)
                 for near in pdf["near"]]
        found = range_search(x, _padded(lists, len(x), x), threshold)
        found = [f[v[f] @ v[i] >= threshold] if len(f) else f for i, f in enumerate(found)]
        node, tree = pdf["node"].to_numpy(np.int64), _forest(found)
        return pd.DataFrame({"a": [int(node[a]) for a, _ in tree], "b": [int(node[b]) for _, b in tree]}, dtype="int64")

    return visits.join(united, "node", "left").groupBy(*group).applyInPandas(search, "a long, b long")


def _counts(members: DataFrame, threshold: float) -> DataFrame:
    """(node, n): the weight of the others of its component that each node links with; ``members``: node, root, v, weight."""
    # components of one block need no look-up; the others are few (rows / BLOCK at most), so no member is dealt by its root alone
    members = cut_lineage(members, "members")
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    own = members.join(broadcast_if(sizes, LARGE), "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn(
        "own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = own.select("root", "node", "v", "weight", "own", other)
    sides = rows.select("root", F.col("own").alias("i"), F.col("other").alias("j"), "node", "v", "weight", F.lit(True).alias("asks")).union(
        rows.select("root", "other", "own", "node", "v", "weight", F.lit(False)))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        asks, x = pdf["asks"].to_numpy(bool), _unit(matrix(pdf["v"]))
        node, weight = pdf["node"].to_numpy(np.int64), pdf["weight"].to_numpy(np.int64)
        hit = (x[asks] @ x[~asks].T >= threshold) & (node[asks][:, None] != node[~asks][None, :])
        return pd.DataFrame({"node": node[asks], "n": hit @ weight[~asks]})

    return sides.groupBy("root", "i", "j").applyInPandas(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))


def _trees(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, place) that join what ``hit`` joins; places: the rows, then the columns."""
    n, a, b = len(hit), [], []
    row_left, col_left = np.ones(n, bool), np.ones(hit.shape[1], bool)
    for s in range(n):
        front = np.array([s]) if row_left[s] else np.zeros(0, np.int64)
        row_left[front] = False
        while len(front):
            cols = np.flatnonzero(hit[front].any(0) & col_left)
            col_left[cols] = False
            front = np.flatnonzero(hit[:, cols].any(1) & row_left)
            row_left[front] = False
            b += [n + cols, front]
            a.append(np.full(len(cols) + len(front), s))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _all_links(nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): a forest of the links of any two blocks of a label, exactly; the cost is the square of a label's size."""
    kind = F.concat(F.size("v").cast("string"), F.lit(":"), "label").alias("kind")
    rows = cut_lineage(nodes.select(kind, "node", "v"), "kinds")
    sizes = rows.groupBy("kind").agg(F.ceil(F.count("*") / LABEL_BLOCK).cast("int").alias("blocks"))
    own = rows.join(broadcast_if(sizes, LARGE), "kind").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    later = F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j")
    earlier = F.explode(F.sequence(F.lit(0), "own")).alias("i")
    sides = own.select("kind", F.col("own").alias("i"), later, "node", "v", F.lit(True).alias("asks")).union(
        own.select("kind", earlier, F.col("own").alias("j"), "node", "v", F.lit(False)))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        asks, x, node = pdf["asks"].to_numpy(bool), _unit(matrix(pdf["v"])), pdf["node"].to_numpy(np.int64)
        node = np.concatenate((node[asks], node[~asks]))
        a, b = _trees(x[asks] @ x[~asks].T >= threshold)
        return pd.DataFrame({"a": node[a], "b": node[b]}, dtype="int64")

    return sides.groupBy("kind", "i", "j").applyInPandas(link, "a long, b long")


def audit(nodes: DataFrame, counts: DataFrame, threshold: float, sample: int = AUDIT) -> float:
    """Mean share of its links that ``counts`` holds, over those of ``sample`` nodes (smallest hashes) that have links by brute force.

    Nodes of over ``DENSE`` links and the others have a mean each; the lower one counts.
    """
    asked = nodes.orderBy("node").limit(sample).join(counts, "node", "left").select("node", "label", "v", F.coalesce("n", F.lit(0)).alias("n")).collect()
    if not asked:
        return 1.0
    by: dict[tuple, list] = {}
    for r in asked:
        by.setdefault((r["label"], len(r["v"])), []).append(r)
    sent = nodes.sparkSession.sparkContext.broadcast(
        {k: (np.array([r["node"] for r in v], np.int64), _unit(matrix([r["v"] for r in v]))) for k, v in by.items()})

    def run(it):
        for pdf in it:
            for (name, dim), part in pdf.groupby([pdf["label"], pdf["v"].map(len)], sort=False):
                if (name, dim) in sent.value:
                    node, q = sent.value[name, dim]
                    hit = (q @ _unit(matrix(part["v"])).T >= threshold) & (node[:, None] != part["node"].to_numpy(np.int64)[None, :])
                    n = hit @ part["weight"].to_numpy(np.int64)
                    yield pd.DataFrame({"node": node[n > 0], "n": n[n > 0]})

    true = {r["node"]: r["n"] for r in nodes.select("node", "label", "v", "weight").mapInPandas(run, "node long, n long").groupBy(
        "node").agg(F.sum("n").alias("n")).collect()}  # sample rows at most
    shares = [(true[r["node"]] > DENSE, min(1.0, r["n"] / true[r["node"]])) for r in asked if r["node"] in true]
    return min((float(np.mean([x for d, x in shares if d == dense])) for dense in {d for d, _ in shares}), default=1.0)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, overlaps: tuple[int, ...] = OVERLAPS, key: str = "vec_id",
                    vector: str = "embedding", label: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``: one row per vector."""
    prepare(vectors.sparkSession, 2048)
    rows = cut_lineage(_rows(vectors, key, vector, label), "vectors")
    # a node is a distinct vector of a label, named by a hash of both
    nodes = cut_lineage(rows.where("same is not null").groupBy("same").agg(
        F.count("*").alias("weight"), F.min("vec_id").alias("first"), F.min("label").alias("label"), F.min("v").alias("v")).select(
        F.col("same").alias("node"), "label", "v", "weight", "first"), "nodes")
    centroids = _centroids(nodes)
    most = max((len(c) for c in centroids.values()), default=1)  # a label that has no centroids is one shard
    found = None
    for overlap in (*overlaps[:1], *(o for a, o in zip(overlaps, overlaps[1:]) if a < most), None):
        new = _all_links(nodes, threshold) if overlap is None else _links(cut_lineage(_visits(nodes, centroids, overlap), "shards"), threshold)
        found = cut_lineage(new if found is None else found.union(new), "links")
        roots = smallest_reachable(found, name="vectors").select("node", "root")
        counts = cut_lineage(_counts(nodes.select("node", "v", "weight").join(roots, "node"), threshold), "counts")
        if overlap is None or audit(nodes, counts, threshold) >= RECALL:
            break
    named = nodes.join(roots, "node", "left").select("node", "first", "weight", F.coalesce("root", "node").alias("root"))
    names = named.groupBy("root").agg(F.min("first").alias("component"))
    known = named.join(names, "root").join(counts, "node", "left").select(
        F.col("node").alias("same"), "component", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = rows.select("vec_id", "same").join(known, "same", "left")
    own = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"),
                      F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"))
