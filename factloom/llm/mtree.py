"""Exact top-k inner products by best-first search in paged M-trees (operator 9)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINKS = "query_id long, vec_id long, score long"


def quantise(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component; null if the vector or a component is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(vector.isNotNull() & finite, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


class MTree:
    """Pages of metric objects under routing objects with covering radii and parent distances.

    Inner products become distances by one more coordinate: with a(x)^2 = M^2 - |x|^2 and a(q) = 0,
    |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the nearest objects have the largest inner products.
    Leaf pages come from halving the objects between two far ones; ``fanout`` pages in that order
    make an inner page.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, page: int = 256, fanout: int = 16):
        self.ids, self.ints = ids, vectors
        norms = np.einsum("ij,ij->i", vectors.astype(np.float64), vectors.astype(np.float64))
        self.m2 = norms.max(initial=0.0)
        self.points = np.hstack([vectors.astype(np.float64), np.sqrt(np.maximum(self.m2 - norms, 0))[:, None]])
        leaves, todo = [], [np.arange(len(ids))]
        while todo:
            rows = todo.pop()
            if len(rows) <= page:
                leaves.append(rows)
                continue
            near = self._from(rows[0], rows)
            a = rows[near.argmax()]
            da = self._from(a, rows)
            b = rows[da.argmax()]
            order = np.argsort(da - self._from(b, rows), kind="stable")
            todo += [rows[order[len(rows) // 2 :]], rows[order[: len(rows) // 2]]]
        self.leaves = []  # (router, radius, rows, distances to the router)
        for rows in leaves:
            centre = self.points[rows].mean(axis=0)
            router = rows[np.linalg.norm(self.points[rows] - centre, axis=1).argmin()]
            away = self._from(router, rows)
            self.leaves.append((router, away.max(), rows, away))
        self.inner = []  # (router, radius, leaf numbers, their routers, radii, distances to the router)
        for at in range(0, len(self.leaves), fanout):
            kids = np.arange(at, min(at + fanout, len(self.leaves)))
            routers = np.array([self.leaves[k][0] for k in kids])
            radii = np.array([self.leaves[k][1] for k in kids])
            router = routers[len(routers) // 2]
            away = self._from(router, routers)
            self.inner.append((router, (away + radii).max(), kids, routers, radii, away))

    def _from(self, i: int, rows: np.ndarray) -> np.ndarray:
        return np.linalg.norm(self.points[rows] - self.points[i], axis=1)

    def search(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (score, id) of objects with other ids: larger scores, then smaller ids."""
        q = np.append(query.astype(np.float64), 0.0)
        slack = 1e-9 * (1 + np.sqrt(self.m2) + np.linalg.norm(q))
        best_score, best_id, limit = np.empty(0, np.int64), np.empty(0, np.int64), np.inf
        queue: list[tuple[float, int, int, float]] = []
        for n, (router, radius, *_rest) in enumerate(self.inner):
            away = np.linalg.norm(self.points[router] - q)
            heapq.heappush(queue, (max(0.0, away - radius), 0, n, away))
        while queue:
            bound, leaf, n, away = heapq.heappop(queue)
            if bound > limit + slack:
                break
            if not leaf:
                _, _, kids, routers, radii, dist = self.inner[n]
                near = np.abs(away - dist) - radii <= limit + slack  # no distance for the others
                kids, routers, radii = kids[near], routers[near], radii[near]
                found = np.linalg.norm(self.points[routers] - q, axis=1)
                for kid, d, r in zip(kids.tolist(), found.tolist(), radii.tolist()):
                    if d - r <= limit + slack:
                        heapq.heappush(queue, (max(0.0, d - r), 1, kid, d))
                continue
            _, _, rows, dist = self.leaves[n]
            rows = rows[np.abs(away - dist) <= limit + slack]
            rows = rows[self.ids[rows] != query_id]
            best_score = np.concatenate([best_score, self.ints[rows] @ query])
            best_id = np.concatenate([best_id, self.ids[rows]])
            if len(best_id) > k:
                order = np.lexsort((best_id, -best_score))[:k]
                best_score, best_id = best_score[order], best_id[order]
            if len(best_id) == k:
                worst = float(best_score.min())
                limit = np.sqrt(max(0.0, float(q @ q) + self.m2 - 2 * worst))
        return list(zip(best_score.tolist(), best_id.tolist()))


def top_k(vectors: DataFrame, queries: Column, k: int = 20, block: int = 8192, query_block: int = 1024, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """The k rows of largest inner product for each row that satisfies ``queries``, itself left out.

    vector_col holds arrays of long; rows whose vector or id is null take no part, vectors of other
    lengths than the query's are no candidates, equal vectors tie and go to smaller ids, repeated
    rows count once each as candidates and once in all as queries, a query without candidates gives no rows, as does an empty table.
    Returns query_id, rank from 1, vec_id, score. Exact: every block of at most about ``block``
    rows, dealt by a hash of the id, is an M-tree that is built once; each meets every block of queries, and
    gives k rows a query, so that no task holds more than a block and the last step reads k rows
    for each block and query.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks")).where("vec_id is not null and vector is not null").withColumn("dim", F.size("vector"))
    n, n_asks = rows.agg(F.count("*"), F.count_if("asks")).first()
    if not n_asks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks, asks = -(-n // block), -(-n_asks // query_block)

    def pages(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, vecs = pdf["vec_id"].to_numpy(), np.stack(pdf["vector"].to_numpy()) if key[1] else np.zeros((len(pdf), 0), np.int64)
        return pd.DataFrame({"block": [key[0]], "dim": [key[1]], "ids": [ids.astype("<i8").tobytes()], "vectors": [vecs.astype("<i8").tobytes()]})

    shape = "block long, dim int, ids binary, vectors binary"
    data = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).groupBy("block", "dim").applyInPandas(pages, shape)
    asking = rows.where("asks").dropDuplicates(["vec_id", "vector"]).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(asks))).groupBy("block", "dim").applyInPandas(pages, shape)
    asking = asking.select(F.col("dim"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, of = None, None
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if of != (r.block, r.dim):
                    ids = np.frombuffer(r.ids, "<i8")
                    tree, of = MTree(ids, np.frombuffer(r.vectors, "<i8").reshape(len(ids), r.dim)), (r.block, r.dim)
                q_ids = np.frombuffer(r.q_ids, "<i8")
                asked = np.frombuffer(r.q_vectors, "<i8").reshape(len(q_ids), r.dim)
                found = [(i, v, s) for i, q in zip(q_ids.tolist(), asked) for s, v in tree.search(i, q, k)]
                yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    met = data.join(asking, ["block", "dim"]).sortWithinPartitions("block", "dim").mapInPandas(search, LINKS)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
