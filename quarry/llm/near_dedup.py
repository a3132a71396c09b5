"""Embedding near-duplicates over a robust-pruned flat graph.

1. Equal vectors of a label are collapsed (a weight each), so a hot vector is one node.
2. Shards: vectors go to their nearest few centroids of their label; a shard beyond SHARD rows is
   split again, so shards overlap and stay bounded. Centroids are members chosen by hash, at most
   FANOUT per shard and level: a bounded sample, while every vector is indexed.
3. Each shard builds a graph: from its nearest candidates a node keeps those that no kept one is
   clearly closer to (robust pruning). The adjacency lists of all shards are united per node.
4. Search: each node is searched for once, in its home shard, over the united graph: greedily from
   the shard's medoid and from the node itself, then the range around it is expanded along the graph
   until no node within the slackened threshold is left.
5. Every link is verified by its cosine in double precision. Link counts and a spanning forest of
   the links go out, never lists of pairs.

``audit_recall`` compares the links found with brute force for a sample of nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import connected_components
from quarry.session import ensure_checkpoint_dir

#: Rows of a shard that are indexed in one task; centroids per split; shards a vector goes to.
SHARD, FANOUT, OVERLAP = 1_024, 64, 2
#: Neighbours kept per node and shard, the pruning factor, beam width, slack of the range
#: expansion, and strong edges followed out of a shard.
DEGREE, ALPHA, BEAM, SLACK, HOPS = 16, 1.2, 8, 0.10, 2


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero (nor too large for a finite norm)."""
    square = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return vector.isNotNull() & F.coalesce((square > 0) & (square < float("inf")), F.lit(False))


def _matrix(lists: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in lists])
    return x / np.sqrt((x * x).sum(1))[:, None]


def _nearest(overlap: int):
    """Map function: rows with their shard's centroids -> a row per shard they go to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, own in pdf.groupby("shard", sort=False):
                c = _matrix(pd.Series(list(own["centroids"].iloc[0])))
                similar = _matrix(own["vector"]) @ c.T
                k = min(overlap, c.shape[0])
                near = np.argsort(-similar, axis=1, kind="stable")[:, :k]
                for r in range(k):
                    out = own[["label", "node", "weight", "vector"]].copy()
                    out["shard"] = own["shard"].to_numpy() + "/" + pd.Series(near[:, r].astype(str)).to_numpy()
                    out["home"] = own["home"].to_numpy() & (r == 0)
                    yield out[["label", "shard", "node", "weight", "vector", "home"]]

    return run


def shards(nodes: DataFrame, size: int = SHARD, fanout: int = FANOUT, overlap: int = OVERLAP) -> DataFrame:
    """(label, shard, node, weight, vector, home): overlapping shards of at most about ``size`` rows;
    home marks one shard per node."""
    schema = "label int, shard string, node long, weight long, vector array<float>, home boolean"
    rows = nodes.select("label", F.col("label").cast("string").alias("shard"), "node", "weight", "vector",
                        F.lit(True).alias("home")).checkpoint()
    done = None
    while True:
        count = rows.groupBy("shard").agg(F.count("*").alias("rows"), F.min("vector").alias("v0"),
                                          F.max("vector").alias("v1")).checkpoint()
        large = count.where((F.col("rows") > size) & (F.col("v0") != F.col("v1"))).select("shard", "rows")
        fits = rows.join(large.hint("merge"), "shard", "left_anti")
        done = fits if done is None else done.union(fits)
        if large.isEmpty():
            return done
        some = rows.join(large.hint("merge"), "shard")
        # `fanout` slots per shard (fewer for smaller shards); each takes the member of the smallest hash
        slots = F.least(F.lit(fanout), F.ceil(F.col("rows") * 2 * overlap / size)).cast("int")
        slot = F.pmod(F.hash("node", "shard"), F.greatest(slots, F.lit(2)))
        picked = some.groupBy("shard", slot.alias("slot")).agg(
            F.min_by("vector", F.xxhash64("node", "shard")).alias("vector"))
        centroids = picked.groupBy("shard").agg(F.collect_list("vector").alias("centroids")).checkpoint()
        rows = rows.join(centroids.hint("merge"), "shard").mapInPandas(_nearest(overlap), schema).checkpoint()


def _prune(similar: np.ndarray, degree: int, alpha: float) -> list[np.ndarray]:
    """Per row: nearest candidates, without those that a kept one is alpha times closer to."""
    gaps = np.sqrt(np.maximum(0.0, 2 - 2 * similar))
    n = len(gaps)
    np.fill_diagonal(gaps, np.inf)
    pool = min(n - 1, 8 * degree)
    out = []
    for i in range(n):
        near = np.argpartition(gaps[i], pool - 1)[:pool] if pool < n - 1 else np.flatnonzero(np.arange(n) != i)
        near = near[np.argsort(gaps[i][near], kind="stable")]
        kept = []
        while len(near) and len(kept) < degree:
            p = near[0]
            kept.append(int(p))
            near = near[1:]
            near = near[alpha * gaps[p][near] > gaps[i][near]]
        out.append(np.array(kept, np.int64))
    return out


def _build(threshold: float):
    """Group function: one shard's adjacency lists; edges go both ways, strong ones are within the
    slackened threshold."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["node"].to_numpy()
        if len(ids) < 2:
            return pd.DataFrame({"node": pd.Series(dtype="int64"), "near": pd.Series(dtype="int64"),
                                 "strong": pd.Series(dtype="bool")})
        x = _matrix(pdf["vector"])
        similar = x @ x.T
        lists = _prune(similar, DEGREE, ALPHA)
        a = np.repeat(np.arange(len(ids)), [len(v) for v in lists])
        b = np.concatenate(lists)
        strong = similar[a, b] >= threshold - SLACK
        return pd.DataFrame({"node": ids[np.concatenate([a, b])], "near": ids[np.concatenate([b, a])],
                             "strong": np.concatenate([strong, strong])})

    return run


def walk(similar: np.ndarray, near: np.ndarray, starts: list[np.ndarray], reach: float) -> np.ndarray:
    """Nodes that each query's search comes to know (a row per query, a column per node): greedily, the best
    open node of a beam of BEAM is expanded until none is open; then every known node with a similarity of at
    least ``reach`` is, until there are no more. ``similar``: queries x nodes; ``near``: nodes x neighbours,
    filled up with the number of nodes."""
    q, n = similar.shape
    values = np.concatenate([similar, np.full((q, 1), -np.inf)], axis=1)
    known = np.zeros((q, n + 1), bool)
    expanded = np.zeros((q, n + 1), bool)
    beam = np.full((q, BEAM), n)
    for r, s in enumerate(starts):
        fresh = ~known[np.arange(q), s]
        beam[fresh, r] = s[fresh]
        known[np.arange(q), s] = True
    known[:, n] = True  # the filling is never new
    worth = values[np.arange(q)[:, None], beam]
    is_open = beam < n
    while True:
        ahead = np.where(is_open, worth, -np.inf)
        best = ahead.argmax(1)
        rows = np.flatnonzero(ahead.max(1) > -np.inf)
        if not len(rows):
            break
        node = beam[rows, best[rows]]
        is_open[rows, best[rows]] = False
        expanded[rows, node] = True
        next_to = near[node]
        next_to = np.where(known[rows[:, None], next_to], n, next_to)
        known[rows[:, None], next_to] = True
        ids = np.concatenate([beam[rows], next_to], axis=1)
        both = np.concatenate([worth[rows], values[rows[:, None], next_to]], axis=1)
        opened = np.concatenate([is_open[rows], next_to < n], axis=1)
        top = np.argpartition(-both, BEAM - 1, axis=1)[:, :BEAM]
        at = np.arange(len(rows))[:, None]
        beam[rows], worth[rows], is_open[rows] = ids[at, top], both[at, top], opened[at, top]
    while True:  # range expansion
        rows, nodes = np.nonzero(known & ~expanded & (values >= reach))
        if not len(rows):
            return known[:, :n]
        expanded[rows, nodes] = True
        step = max(1, (1 << 20) // near.shape[1])  # a node of a dense group may have very many neighbours
        for at in range(0, len(rows), step):
            known[rows[at:at + step, None], near[nodes[at:at + step]]] = True


def _search(threshold: float):
    """Group function: a shard's nodes (and those that strong edges of its home nodes lead to), with united
    adjacency lists -> per home node its link count, and edges of a spanning forest of the links found."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("home", ascending=False, kind="stable").drop_duplicates("node").sort_values("node")
        ids, weights = pdf["node"].to_numpy(), pdf["weight"].to_numpy()
        n, home = len(ids), np.flatnonzero(pdf["home"].to_numpy())
        x = _matrix(pdf["vector"])
        lists = []
        for v in pdf["near"]:
            v = np.asarray(v if v is not None else [], np.int64)
            at = np.minimum(np.searchsorted(ids, v), n - 1)
            lists.append(at[ids[at] == v])
        near = np.full((n, max(1, *map(len, lists))), n)
        for i, v in enumerate(lists):
            near[i, :len(v)] = v
        medoid = home[np.argmax(x[home] @ x[home].mean(0))]
        counts, parent = [], np.arange(n)

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for at in range(0, len(home), 256):
            asks = home[at:at + 256]
            similar = x[asks] @ x.T
            known = walk(similar, near, [asks, np.full(len(asks), medoid)], threshold - SLACK)
            linked = known & (similar >= threshold)
            linked[np.arange(len(asks)), asks] = False
            counts.extend((linked @ weights).tolist())
            for q, i in zip(*np.nonzero(linked), strict=True):
                a, b = root(int(asks[q])), root(int(i))
                if a != b:
                    parent[max(a, b)] = min(a, b)
        roots = np.array([root(i) for i in range(n)])
        some = np.flatnonzero(roots != np.arange(n))
        return pd.DataFrame({
            "node": np.concatenate([ids[home], ids[some]]),
            "links": pd.array(counts + [None] * len(some), "Int64"),
            "other": pd.array([None] * len(home) + ids[roots[some]].tolist(), "Int64")})

    return run


def embedding_components(df: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id",
                         vector: str = "embedding", label: str = "label", shard: int = SHARD) -> DataFrame:
    """Per row: vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable by
    links) and kept (vec_id = component_id). Rows link when their labels are equal and the cosine of
    their vectors, in double precision, is at least ``threshold``.

    Vectors that are null, zero or hold null or non-finite components, and rows with a null label or
    vec_id, link with nothing (n_links 0, component_id their own id). Equal vectors of a label
    always link; repeated rows are rows each and link with each other; vectors of unlike lengths have
    no cosine and don't link (each length is indexed by itself). Ties at the threshold link. An empty table gives
    no rows; other columns are not looked at.
    """
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.select(df[vec_id].cast("long").alias("vec_id"), df[label].cast("int").alias("label"),
                     df[vector].cast("array<float>").alias("vector"))
    fine = rows.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("vector")))
    name = [F.xxhash64("label", "vector").alias("h1"), F.hash("vector", "label").alias("h2")]
    classes = (fine.groupBy("label", "vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"))
               .select("label", "vector", "node", "weight", *name).checkpoint())
    parts = None
    for (dim,) in classes.select(F.size("vector")).distinct().collect():
        own = shards(classes.where(F.size("vector") == dim), shard)
        own = own.withColumn("shard", F.concat(F.lit(f"{dim}:"), "shard"))
        parts = own if parts is None else parts.union(own)
    if parts is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.lit(True).alias("kept"))
    members = parts.checkpoint()
    edges = members.groupBy("shard").applyInPandas(_build(threshold), "node long, near long, strong boolean").checkpoint()
    graph = edges.groupBy("node").agg(F.collect_set("near").alias("near")).checkpoint()
    nodes = members.where("home").select("node", "weight", "vector").join(graph.hint("merge"), "node", "left").checkpoint()
    homes = members.where("home").select("shard", "node").checkpoint()
    # what a shard's search walks over: its members, and where up to HOPS strong edges lead from its home nodes
    strong = edges.where("strong").select("node", "near").distinct().checkpoint()
    around = homes
    for _ in range(HOPS):
        around = around.union(around.join(strong.hint("merge"), "node").select("shard", F.col("near").alias("node"))).distinct()
    around = members.select("shard", "node").union(around).distinct()
    wanted = around.join(homes.select("shard").distinct(), "shard", "left_semi").join(
        homes.withColumn("home", F.lit(True)).hint("merge"), ["shard", "node"], "left")
    local = wanted.join(nodes.hint("merge"), "node").select(
        "shard", "node", F.coalesce("home", F.lit(False)).alias("home"), "weight", "vector", "near")
    found = local.groupBy("shard").applyInPandas(_search(threshold), "node long, links long, other long").checkpoint()
    named = connected_components(found.where("other is not null"), "node", "other").withColumnRenamed("component", "root")
    links = found.where("links is not null").select("node", "links")
    joined = (classes.select("h1", "h2", "label", "vector", "node", "weight").join(links.hint("merge"), "node").join(named.hint("merge"), "node", "left")
              .select("h1", "h2", "weight", "links", F.coalesce("root", "node").alias("root")).checkpoint())
    out = rows.withColumns({
        "h1": F.when(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("vector")),
                     F.xxhash64("label", "vector")), "h2": F.hash("vector", "label")}).drop("vector", "label")
    out = out.join(joined, ["h1", "h2"], "left")
    root = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("links") + F.col("weight") - 1, F.lit(0)).cast("long").alias("n_links"),
                      root.alias("component_id"), F.coalesce(F.col("vec_id") == root, F.lit(True)).alias("kept"))


def audit_recall(df: DataFrame, result: DataFrame, share: int = 16, threshold: float = 0.98,
                 vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row: links (of the rows whose id is divisible by ``share``, by brute force against all
    rows of their label) and found (those in ``result``), for measuring recall."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = df.where(usable(df[vector]) & df[label].isNotNull()).select(
        df[vec_id].alias("id"), df[label].alias("label"), df[vector].alias("v")).withColumn(
        "v", F.transform("v", lambda x: x.cast("double") / norm))
    asks = rows.where(F.pmod("id", F.lit(share)) == 0).select(
        F.col("id").alias("q"), "label", F.col("v").alias("w"))
    dot = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    true = asks.join(rows, "label").where((F.col("q") != F.col("id")) & (dot >= threshold)).select(
        F.lit(1).alias("links"), F.lit(0).cast("long").alias("found"))
    found = result.where(F.pmod("vec_id", F.lit(share)) == 0).select(F.lit(0).alias("links"), F.col("n_links").alias("found"))
    return true.union(found).agg(F.sum("links").alias("links"), F.sum("found").alias("found"))
