"""Exact top-k inner products by branch and bound over a ball tree for each shard.

Vectors become integers, floor(256 * x), and are dealt into shards of a bounded number of rows by a hash
of their ids; each shard is packed once into one row: vectors in the order of a ball tree and the
tree's centres, radii and ranges. Queries go through in blocks of a bounded size. For a block, every
shard searches its tree for each query, best first by the upper bound <q, centre> + |q| * radius, and
leaves a node out once its bound lies below the k-th score that is known. That score is shared: a few
shards go first, their k-th scores are reduced to the best for each query, and the other shards
start from them, so most of their nodes are never opened and they return only what can still enter.
A window over the block's few candidates gives the ranks.

Edge cases: null vectors and vectors with null or non-finite components take no part, nor do null ids;
vectors of different lengths do not meet; equal scores are ordered by the smaller id; a query does
not meet its own row, but other rows with its id do count, and each row of a repeated query id is a
query of its own; with fewer than k candidates all come back. Products are exact integers; sums beyond 64
bits are cut to the nearest 64-bit value.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint

#: Rows of a shard, about.
SHARD = 16_384
LEAF = 64
#: Queries of a block; with their vectors they are sent to every task.
BLOCK = 8_192
#: Shards that search first, for the scores which the others start from.
LEAD = 1
#: Largest sum of absolute products that floating-point numbers hold exactly.
EXACT = float(1 << 53)


def tree(points: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """Order of the points, and nodes (start, end, left, right; -1 for leaves), by halving along the widest of two far points' axis."""
    order = np.arange(len(points))
    nodes: list[list[int]] = [[0, len(points), -1, -1]]
    at = 0
    while at < len(nodes):
        a, z, _, _ = nodes[at]
        if z - a > LEAF:
            own = points[order[a:z]]
            far = own[np.argmax(((own - own.mean(axis=0)) ** 2).sum(axis=1))]
            other = own[np.argmax(((own - far) ** 2).sum(axis=1))]
            half = (z - a) // 2
            order[a:z] = order[a:z][np.argpartition(own @ (other - far), half)]
            nodes[at][2], nodes[at][3] = len(nodes), len(nodes) + 1
            nodes += [[a, a + half, -1, -1], [a + half, z, -1, -1]]
        at += 1
    return order, [tuple(n) for n in nodes]


def search(q: np.ndarray, k: int, floor_score: float, own: int, shard: dict) -> list[tuple[int, int]]:
    """At most k (score, id) of a shard with scores of at least floor_score, best first; own: the query's row number in it, or -1."""
    points, ids, nodes = shard["points"], shard["ids"], shard["nodes"]
    # Bounds are rounded up, so that rounding never hides a candidate.
    bound = shard["centres"] @ q + shard["radii"] * float(np.sqrt(q @ q))
    bound += 1e-9 * (np.abs(bound) + 1)
    best: list[tuple[int, int]] = []  # (score, -id), smallest first
    heap = [(-bound[0], 0)]
    while heap:
        b, at = heapq.heappop(heap)
        if -b < floor_score:
            break
        a, z, left, right = nodes[at]
        if left >= 0:
            for child in (left, right):
                if bound[child] >= floor_score:
                    heapq.heappush(heap, (-bound[child], child))
            continue
        scores = points[a:z] @ q
        for i in np.flatnonzero(scores >= floor_score):
            if a + i == own:
                continue
            item = (int(scores[i]), -int(ids[a + i]))
            if len(best) < k:
                heapq.heappush(best, item)
            elif item > best[0]:
                heapq.heapreplace(best, item)
        if len(best) == k:
            floor_score = max(floor_score, best[0][0])
    return [(s, -i) for s, i in sorted(best, reverse=True)]


def as_integers(values) -> np.ndarray:
    """floor(256 * x) of each component; Python integers where a product could be inexact."""
    v = np.floor(np.asarray(values, dtype=np.float64) * 256)
    if v.size and float(np.abs(v).max()) ** 2 * v.shape[-1] >= EXACT:
        return np.array([int(x) for x in v.reshape(-1)], dtype=object).reshape(v.shape)
    return v


def pack(rows: DataFrame, shards: int) -> DataFrame:
    """One row for each shard and vector length: its vectors in tree order, and the tree."""

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        raw = np.array(pdf["vector"].tolist(), dtype=np.float64).reshape(len(pdf), int(key[1]))
        points = np.floor(raw * 256)
        order, nodes = tree(points)
        points = points[order]
        centres = np.array([points[a:z].mean(axis=0) for a, z, _, _ in nodes])
        radii = np.array([np.sqrt(((points[a:z] - c) ** 2).sum(axis=1)).max() for (a, z, _, _), c in zip(nodes, centres, strict=True)])
        row = [key[0], key[1], len(pdf), points.tobytes(), pdf["id"].to_numpy()[order].astype("<i8").tobytes(), pdf["row"].to_numpy()[order].astype("<i8").tobytes(), np.array(nodes, dtype="<i8").tobytes(), centres.tobytes(), (radii * (1 + 1e-9) + 1e-9).tobytes()]
        return pd.DataFrame([row], columns=["shard", "dim", "n", "points", "ids", "rows", "nodes", "centres", "radii"])

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")).withColumn("dim", F.size("vector"))
    return dealt.groupBy("shard", "dim").applyInPandas(build, "shard int, dim int, n long, points binary, ids binary, rows binary, nodes binary, centres binary, radii binary")


def top_k(table: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row that is_query, a condition on the id, holds for."""
    spark = table.sparkSession
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    given = table.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    clean = given.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", finite))
    rows = checkpoint(clean.withColumn("row", F.monotonically_increasing_id()))
    total = rows.count()
    packed = checkpoint(pack(rows, max(1, -(-total // shard_rows))))
    asked = rows.filter(is_query(F.col("id"))).select("id", "row", "vector")
    n_queries = asked.count()
    blocks = max(1, -(-n_queries // block))
    asked = checkpoint(asked.withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks))))
    lead = packed.filter(F.col("shard") < LEAD)
    rest = packed.filter(F.col("shard") >= LEAD)
    schema = "query_id long, query_row long, vec_id long, score long"
    found = []

    def scan(some: DataFrame, queries: list[tuple[int, int, list[float]]], known: dict[int, int]) -> DataFrame:
        shared = spark.sparkContext.broadcast((queries, known))

        def run(batches):
            asked, floors = shared.value
            for pdf in batches:
                for r in pdf.itertuples():
                    points = np.frombuffer(r.points).reshape(r.n, r.dim)
                    own = {int(x): i for i, x in enumerate(np.frombuffer(r.rows, "<i8"))}
                    exact = not points.size or float(np.abs(points).max()) ** 2 * r.dim < EXACT / 4
                    shard = {"points": points if exact else as_integers(points / 256), "ids": np.frombuffer(r.ids, "<i8"), "nodes": [tuple(x) for x in np.frombuffer(r.nodes, "<i8").reshape(-1, 4).tolist()], "centres": np.frombuffer(r.centres).reshape(len(r.radii) // 8, r.dim), "radii": np.frombuffer(r.radii)}
                    out = []
                    for qid, row, v in asked:
                        if len(v) != r.dim:
                            continue
                        q = np.floor(np.asarray(v) * 256)
                        if not exact or q.size and float(np.abs(q).max()) ** 2 * r.dim >= EXACT / 4:
                            got = every(as_integers(v).astype(object), k, own.get(row, -1), shard)
                        else:
                            got = search(q, k, floors.get(row, -np.inf), own.get(row, -1), shard)
                        out += [(qid, row, i, max(-(1 << 63), min((1 << 63) - 1, s))) for s, i in got]
                    yield pd.DataFrame(out, columns=["query_id", "query_row", "vec_id", "score"])

        return some.mapInPandas(run, schema)

    for b in range(blocks):
        queries = [(r["id"], r["row"], list(r["vector"])) for r in asked.filter(F.col("block") == b).collect()]  # about BLOCK rows
        first = checkpoint(scan(lead, queries, {}))
        kth = first.groupBy("query_row").agg(F.array_sort(F.collect_list("score")).alias("s")).filter(F.size("s") >= k)
        floors = {r["query_row"]: r["floor"] for r in kth.select("query_row", F.element_at("s", -k).alias("floor")).collect()}
        found.append(first.unionByName(checkpoint(scan(rest, queries, floors))))
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every(q: np.ndarray, k: int, own: int, shard: dict) -> list[tuple[int, int]]:
    """The same answer from all points, in integers of any size; for components that floating-point products cannot hold."""
    points = shard["points"].astype(object)
    scores = [(int(sum(int(a) * int(b) for a, b in zip(p, q, strict=True))), -int(shard["ids"][i])) for i, p in enumerate(points) if i != own]
    return [(s, -i) for s, i in heapq.nlargest(k, scores)]
