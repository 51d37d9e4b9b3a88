"""Connected components over link tables, by DataFrame joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import materialize


def broadcast_if_small(df: DataFrame, rows: int = 1_000_000, size: Column | None = None) -> DataFrame:
    """Hint a broadcast only if df, counted, has at most that many (narrow) rows; else Spark shuffles.

    Rows that hold lists are counted by ``size``, their number of entries.
    """
    n = df.count() if size is None else df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= rows else df


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(u, v): root is the smallest node that it reaches.

    Every node points to its smallest neighbour or itself, pointers are doubled until they end at
    a root, and the edges between roots go into the next round, until none is left. Each step is
    a written table of at most as many rows as there are nodes, and sums before it shuffles.
    """
    edges = materialize(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    whole = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        point = materialize(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("root")), "pointers")
        while True:
            on = point.alias("a").join(point.alias("b"), F.col("a.root") == F.col("b.node")).select("a.node", F.col("b.root").alias("root"), (F.col("a.root") != F.col("b.root")).alias("moved"))
            on = materialize(on, "pointers")
            point = on.select("node", "root")
            if on.where("moved").isEmpty():
                break
        if whole is None:
            whole = point
        else:
            after = point.select(F.col("node").alias("root"), F.col("root").alias("new"))
            whole = materialize(whole.join(after, "root", "left").select("node", F.coalesce("new", "root").alias("root")), "roots")
        step = edges.join(point.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u").join(point.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v")
        edges = materialize(step.where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "edges")
    return whole if whole is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
