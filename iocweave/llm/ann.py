"""Approximate nearest neighbours: a robust-pruned directed graph in each shard.

Rows are spread over shards by a hash. A shard's graph starts with random neighbours; greedy searches from its centre
propose neighbours for each vector, and relaxed distance pruning keeps the nearest of them that no kept neighbour is
``alpha`` times nearer to. Links are made both ways and pruned again. A query walks the graph of every shard with a
beam, and its best candidates are ranked by exact distance.

Equal vectors are one node with all their ids, else a large group of copies would fill every neighbour list.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from iocweave.llm.common import written

GRAPH_SCHEMA = "dim int, shard int, n int, vectors binary, links binary, start int, frame binary, ids array<array<long>>"


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of stacks a (q, m, d) and b (q, d)."""
    return np.maximum(
        np.einsum("qmd,qmd->qm", a, a) - 2 * np.einsum("qmd,qd->qm", a, b) + np.einsum("qd,qd->q", b, b)[:, None], 0
    )


def beam_search(
    vectors: np.ndarray, links: np.ndarray, start: int, queries: np.ndarray, beam: int, most_steps: int = 400
) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest nodes met from ``start`` for each query, nearest first, with squared distances.

    All queries step together: each expands the nearest node of its beam that it has not expanded. Unused places have
    node -1 and an infinite distance.
    """
    q, n = len(queries), len(vectors)
    rows = np.arange(q)
    nodes = np.full((q, beam), -1)
    far = np.full((q, beam), np.inf, np.float32)
    done = np.zeros((q, beam), bool)
    seen = np.zeros((q, n), bool)
    nodes[:, 0], seen[:, start] = start, True
    far[:, 0] = squared(np.broadcast_to(vectors[start], (q, 1, vectors.shape[1])), queries)[:, 0]
    active = rows
    for _ in range(most_steps):
        open_ = np.where(done[active] | (nodes[active] < 0), np.inf, far[active])
        pick = open_.argmin(axis=1)
        live = np.isfinite(open_[np.arange(len(active)), pick])
        active, pick = active[live], pick[live]
        if not len(active):
            break
        done[active, pick] = True
        near = links[nodes[active, pick]]
        fresh = (near >= 0) & ~seen[active[:, None], near]
        seen[active[:, None], np.where(near >= 0, near, nodes[active, pick][:, None])] = True
        away = np.where(fresh, squared(vectors[near], queries[active]), np.inf).astype(np.float32)
        all_far = np.concatenate([far[active], away], axis=1)
        keep = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
        keep = np.take_along_axis(keep, np.take_along_axis(all_far, keep, 1).argsort(axis=1, kind="stable"), 1)
        far[active] = np.take_along_axis(all_far, keep, 1)
        all_nodes = np.concatenate([nodes[active], np.where(fresh, near, -1)], axis=1)
        nodes[active] = np.where(np.isfinite(far[active]), np.take_along_axis(all_nodes, keep, 1), -1)
        all_done = np.concatenate([done[active], np.zeros(near.shape, bool)], axis=1)
        done[active] = np.take_along_axis(all_done, keep, 1)
    return nodes, far


def robust_prune(
    vectors: np.ndarray, own: np.ndarray, proposed: np.ndarray, degree: int, alpha: float
) -> np.ndarray:
    """At most ``degree`` of the proposed neighbours of each node: the nearest left is kept, and drops every other one
    to which it is ``alpha`` times nearer than the node is. -1 marks no proposal."""
    proposed = np.where(proposed == own[:, None], -1, proposed)
    proposed = np.sort(proposed, axis=1)
    proposed[:, 1:][proposed[:, 1:] == proposed[:, :-1]] = -1
    b, m = proposed.shape
    stack = vectors[np.maximum(proposed, 0)]
    away = np.where(proposed >= 0, squared(stack, vectors[own]), np.inf)
    order = away.argsort(axis=1, kind="stable")[:, : 4 * degree]
    proposed, away = np.take_along_axis(proposed, order, 1), np.take_along_axis(away, order, 1)
    stack = np.take_along_axis(stack, order[:, :, None], 1)
    norms = np.einsum("bmd,bmd->bm", stack, stack)
    between = np.maximum(norms[:, :, None] + norms[:, None, :] - 2 * stack @ stack.transpose(0, 2, 1), 0)
    out = np.full((b, degree), -1)
    rows = np.arange(b)
    left = np.isfinite(away)
    for k in range(degree):
        rest = np.where(left, away, np.inf)
        pick = rest.argmin(axis=1)
        some = np.isfinite(rest[rows, pick])
        if not some.any():
            break
        out[some, k] = proposed[rows, pick][some]
        left[rows, pick] = False
        left &= ~(some[:, None] & (alpha * alpha * between[rows, pick] <= away))
    return out


def build(vectors: np.ndarray, degree: int, beam: int, alpha: float, batch: int = 256) -> tuple[np.ndarray, int]:
    """Links (n x degree, -1 for none) and the node nearest to the mean, where searches start."""
    n = len(vectors)
    rng = np.random.default_rng(n)
    start = int(((vectors - vectors.mean(axis=0)) ** 2).sum(axis=1).argmin())
    width = degree + degree // 2
    links = np.full((n, width), -1)
    if n > 1:
        links[:, :degree] = rng.integers(0, n - 1, (n, degree))
        links[:, :degree] += links[:, :degree] >= np.arange(n)[:, None]
    for slack in (1.0, alpha):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            own = order[at : at + batch]
            met, _ = beam_search(vectors, links, start, vectors[own], beam)
            kept = robust_prune(vectors, own, np.concatenate([met, links[own]], axis=1), degree, slack)
            links[own, :] = -1
            links[own, :degree] = kept
            # Both ways: a node that has no room left is pruned again.
            source = np.repeat(own, degree)[kept.ravel() >= 0]
            target = kept.ravel()[kept.ravel() >= 0]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            heads, first, count = np.unique(target, return_index=True, return_counts=True)
            if not len(heads):
                continue
            extra = np.full((len(heads), count.max()), -1)
            extra[np.repeat(np.arange(len(heads)), count), np.arange(len(target)) - np.repeat(first, count)] = source
            joined = np.concatenate([links[heads], extra], axis=1)
            joined = np.where(joined == heads[:, None], -1, joined)
            room = (joined >= 0).sum(axis=1)
            for a in range(0, len(heads), batch):
                part = slice(a, a + batch)
                full = room[part] > width
                packed = np.sort(joined[part], axis=1)[:, ::-1]
                packed[:, 1:][packed[:, 1:] == packed[:, :-1]] = -1
                short = np.sort(packed, axis=1)[:, ::-1][:, :width]
                if short.shape[1] < width:
                    short = np.pad(short, ((0, 0), (0, width - short.shape[1])), constant_values=-1)
                if full.any():
                    short[full] = -1
                    short[full, :degree] = robust_prune(vectors, heads[part][full], joined[part][full], degree, slack)
                links[heads[part]] = short
    return links, start


#: How far from the middle a vector may be in a graph, in median distances; those beyond are drawn in to it.
FARTHEST = 1e4


def frame(exact: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Where the vectors of a shard lie: their middle and two scales, such that walking the graph in single precision
    tells them apart wherever they are and however large or small."""
    size = float(np.abs(exact).max()) or 1.0
    middle = np.median(exact / size, axis=0)
    away = np.sqrt((((exact / size) - middle) ** 2).sum(axis=1))
    spread = float(np.median(away)) or float(away.max()) or 1.0
    return middle, size, spread


def framed(vectors: np.ndarray, middle: np.ndarray, size: float, spread: float) -> np.ndarray:
    """Vectors in the frame of a shard, in single precision. One very far out keeps its direction."""
    moved = (vectors / size - middle) / spread
    far = np.sqrt((moved * moved).sum(axis=1, keepdims=True))
    return np.where(far > FARTHEST, moved * (FARTHEST / np.maximum(far, FARTHEST)), moved).astype(np.float32)


@dataclass(frozen=True)
class Settings:
    """``shard_rows``: vectors of a shard, on average; ``query_rows``: queries that visit a shard together."""

    degree: int = 32
    beam: int = 64
    search_beam: int = 96
    alpha: float = 1.2
    shard_rows: int = 6000
    query_rows: int = 4096


def usable(embeddings: DataFrame, vector: str) -> DataFrame:
    """(vec_id, vector) of the rows whose vector takes part: neither null, empty nor zero, all components finite."""
    v = F.col(vector).cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector"))
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & v.isNotNull()).filter(finite & F.exists(v, lambda x: x != 0))


def build_index(rows: DataFrame, k: int, settings: Settings) -> DataFrame:
    """A graph per shard over all ``rows`` (vec_id, vector); each node lists its k + 1 smallest ids.

    More ids of one vector can never be in a result of k rows, where ties go to the smaller id.
    """
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    nodes = rows.distinct().withColumn("_r", rank).filter(F.col("_r") <= k + 1)
    nodes = written(nodes.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "nodes")
    shards = F.greatest(F.ceil(F.count("*") / settings.shard_rows), F.lit(1)).cast("int")
    per_dim = nodes.groupBy(F.size("vector").alias("dim")).agg(shards.alias("shards"))
    nodes = nodes.withColumn("dim", F.size("vector")).join(per_dim, "dim")
    nodes = nodes.select("dim", F.pmod(F.xxhash64("vector"), F.col("shards")).cast("int").alias("shard"), "vector", "ids")

    def make(group: pa.Table) -> pa.Table:
        n = group.num_rows
        flat = group.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        exact = flat.reshape(n, -1).astype(np.float64)
        middle, size, spread = frame(exact)
        links, start = build(framed(exact, middle, size, spread), settings.degree, settings.beam, settings.alpha)
        return pa.table(
            {
                "dim": pa.array([exact.shape[1]], pa.int32()), "shard": group.column("shard").slice(0, 1).cast(pa.int32()),
                "n": pa.array([n], pa.int32()), "vectors": pa.array([exact.astype("<f8").tobytes()], pa.binary()),
                "links": pa.array([links.astype("<i4").tobytes()], pa.binary()), "start": pa.array([start], pa.int32()),
                "frame": pa.array([np.array([size, spread, *middle], "<f8").tobytes()], pa.binary()),
                "ids": pa.array([group.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64()))),
            }
        )

    # A shard is few bytes and much work, so run-time coalescing by size must not put many of them into one task.
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = nodes.repartition(tasks, "dim", "shard").groupBy("dim", "shard")
    return written(dealt.applyInArrow(make, GRAPH_SCHEMA), "graphs")


def search(queries: DataFrame, graphs: DataFrame, k: int = 10, settings: Settings | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each of ``queries`` (query_id, vector), itself left out.

    score is the Euclidean distance in double precision; ties go to the smaller vec_id. Vectors are compared with those
    of the same length. Queries visit each shard in groups of about ``query_rows``.
    """
    settings = settings or Settings()
    queries = queries.withColumn("dim", F.size("vector"))
    groups = queries.groupBy("dim").agg(F.greatest(F.ceil(F.count("*") / settings.query_rows), F.lit(1)).cast("int").alias("groups"))
    shards = graphs.join(groups, "dim").select("*", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"))
    places = graphs.select(F.col("dim"), F.col("shard").alias("_shard"))
    asked = queries.join(groups, "dim").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("groups")).cast("int"))
    asked = asked.join(places, "dim").select("dim", F.col("_shard").alias("shard"), "part", "query_id", "vector")

    def visit(graph: pa.Table, part: pa.Table) -> pa.Table:
        out_query, out_id, out_far = [], [], []
        if graph.num_rows and part.num_rows:
            g = graph.slice(0, 1).to_pylist()[0]
            exact = np.frombuffer(g["vectors"], "<f8").reshape(g["n"], g["dim"])
            size, spread, *middle = np.frombuffer(g["frame"], "<f8").tolist()
            vectors = framed(exact, np.array(middle), size, spread)
            links = np.frombuffer(g["links"], "<i4").reshape(g["n"], -1)
            names = part.column("query_id").to_pylist()
            asked_flat = part.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            wanted = asked_flat.reshape(len(names), -1).astype(np.float64)
            for at in range(0, len(names), 256):
                block = slice(at, at + 256)
                met, _ = beam_search(vectors, links, g["start"], framed(wanted[block], np.array(middle), size, spread), settings.search_beam)
                for name, query, nodes in zip(names[block], wanted[block], met, strict=True):
                    nodes = nodes[nodes >= 0]
                    far = np.sqrt(((exact[nodes] - query) ** 2).sum(axis=1))
                    found = [
                        (f, i) for f, node in zip(far.tolist(), nodes.tolist(), strict=True) for i in g["ids"][node] if i != name
                    ]
                    for f, i in sorted(found)[:k]:
                        out_query.append(name)
                        out_id.append(i)
                        out_far.append(f)
        return pa.table(
            {"query_id": pa.array(out_query, pa.int64()), "vec_id": pa.array(out_id, pa.int64()), "score": pa.array(out_far, pa.float64())}
        )

    left = shards.groupBy("dim", "shard", "part")
    found = left.cogroup(asked.toDF(*asked.columns).groupBy("dim", "shard", "part")).applyInArrow(visit, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def nearest(
    embeddings: DataFrame, every: int = 100, k: int = 10, vector: str = "embedding", settings: Settings | None = None
) -> DataFrame:
    """The k nearest found for each row whose vec_id is divisible by ``every``, among all other rows.

    Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do rows without an id.
    Repeated rows count once; of rows with one id and different vectors each is a candidate, and the nearest one
    answers; as queries, the row with the least vector is asked. Other columns are not read.
    """
    settings = settings or Settings()
    rows = usable(embeddings, vector)
    graphs = build_index(rows, k, settings)
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector"))
    return search(queries, graphs, k, settings)
