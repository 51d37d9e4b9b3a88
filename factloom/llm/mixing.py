"""Mixing sources to target weights by hierarchical budgets (operator 8); DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import materialize
from factloom.llm.graph import broadcast_if_small

NULL = "(null)"
OWN = ("mix_epoch", "mix_tokens", "mix_take")
LEVELS = 3  # of 256 parts each


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")


def fill(nodes: DataFrame, parents: list[str]) -> DataFrame:
    """Share each parent's ``budget`` among its nodes by weight, none above its ``capacity``.

    With the nodes in order of capacity / weight, the level that remains once those before node k
    are full is (budget - their capacities) / (the other nodes' weights). It rises while nodes are
    full and falls after, so the largest is the true one, and a node takes
    min(capacity, weight * level): what a full node can't use goes to its siblings.
    """
    w = Window.partitionBy(*parents)
    order = w.orderBy(F.col("capacity") / F.col("weight"), "weight", "node")
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = nodes.withColumn("level", (F.col("budget") - before).cast("double") / weights)
    return level.withColumn("budget", F.least("capacity", F.floor(F.col("weight") * F.max("level").over(w)).cast("long"))).drop("level")


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, float]], total: Column, max_epochs: int) -> DataFrame:
    """Leaf budgets: leaves has the level columns and tokens. Weights pass down from the root; a
    shortage goes to siblings first and, where a whole subtree is short, to its ancestors'
    siblings, since a subtree's capacity is its leaves' tokens times the epochs."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    above = leaves.agg(F.sum("tokens").alias("all_tokens")).select(total.alias("budget"), F.lit(1).alias("root"))
    for depth, level in enumerate(levels):
        path = levels[: depth + 1]
        table = F.create_map(*[F.lit(x) for kv in weights.get(level, {}).items() for x in (kv[0], float(kv[1]))]) if weights.get(level) else None
        own = F.coalesce(table[F.col(level)], F.lit(1.0)) if table is not None else F.lit(1.0)
        nodes = leaves.groupBy(*path).agg(F.sum("capacity").alias("capacity")).withColumn("root", F.lit(1)).withColumn("weight", own).where("weight > 0")
        nodes = nodes.join(above, ["root", *path[:-1]]).withColumn("node", F.col(level))
        above = fill(nodes, ["root", *path[:-1]]).select("root", *path, "budget")
    return leaves.join(above.drop("root"), levels)


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, float]], share: float | None = None, total: int | None = None, max_epochs: int = 1, seed: int = 0, tokens: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows chosen, once for each epoch that takes them, with mix_epoch, mix_tokens and mix_take.

    ``levels`` names the tree's levels from the root, each a column expression; a leaf is one
    combination of their values (null counts as a value). The budget is ``total`` tokens or a
    ``share`` of all. A leaf of T tokens and budget b takes its documents in floor(b / T) whole
    epochs, then the prefix of the next epoch's seeded order up to b tokens; mix_take tells how
    many of the last document's tokens still belong to it, else all. Documents without tokens
    (null or empty texts) go with the whole epochs and the part before the prefix's end. Rows of equal id
    follow in text order. All columns are kept, ones named like the three are replaced; an empty table gives no rows.

    Words are counted once, in a written copy of the rows. Only counts are shuffled, summed before: per leaf, then per leaf and
    256th of the order, then 256th of the one in which the prefix ends, and so on for LEVELS steps; what is ordered
    is that last part of each leaf, one of 256^LEVELS, so a hot leaf never meets in one task. The other rows never move while the
    leaves, which are counted, are at most 100,000; beyond that Spark joins them by shuffling.
    """
    n = tokens if tokens is not None else words(F.coalesce(F.col(text_col), F.lit("")))
    names = [f"__l{i}" for i in range(len(levels))]
    held = {k: w for k, w in zip(names, (weights.get(x, {}) for x in levels))}
    rows = materialize(docs.drop(*OWN).withColumns({"__n": n} | {k: F.coalesce(c.cast("string"), F.lit(NULL)) for k, c in zip(names, levels.values())}), "counted")
    wanted = F.lit(total).cast("long") if total is not None else F.floor(F.col("all_tokens") * F.lit(1.0 if share is None else share)).cast("long")
    leaves = rows.groupBy(*names).agg(F.sum("__n").alias("tokens"))
    plan = budgets(leaves, names, held, wanted, max_epochs)
    plan = plan.select(*names, F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.greatest("tokens", F.lit(1)))).otherwise(0).cast("long").alias("__whole"), "tokens", "budget")
    plan = plan.withColumn("__rest", F.col("budget") - F.col("__whole") * F.col("tokens")).drop("tokens", "budget")
    plan = broadcast_if_small(materialize(plan, "leaves"), 100_000)
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("__whole").cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit(NULL))))
    dealt = rows.join(plan, names).withColumn("__order", order).withColumn("__part", F.substring("__order", 1, 2 * LEVELS))

    # where each leaf's prefix ends: the two hex digits of the order in which it does, then the next two, and so on
    held, ends = dealt.where("__rest > 0").select(*names, "__order", "__n", "__rest"), None
    for level in range(LEVELS):
        parts = held.withColumn("__digits", F.substring("__order", 2 * level + 1, 2)).groupBy(*names, "__digits", "__rest").agg(F.sum("__n").alias("in_part"))
        up_to = F.sum("in_part").over(Window.partitionBy(*names).orderBy("__digits").rowsBetween(Window.unboundedPreceding, 0))
        found = parts.withColumn("up_to", up_to).where(F.col("up_to") >= F.col("__rest")).groupBy(*names).agg(F.min_by(F.struct("__digits", (F.col("up_to") - F.col("in_part")).alias("before")), "__digits").alias("e"))
        found = found.select(*names, F.col("e.__digits").alias("__at"), F.col("e.before").alias("__more"))
        if ends is not None:
            found = found.join(ends, names).withColumns({"__at": F.concat("__end", "__at"), "__more": F.col("__before") + F.col("__more")}).drop("__end", "__before")
        ends = broadcast_if_small(materialize(found.toDF(*names, "__end", "__before"), "ends"), 100_000)
        held = dealt.where("__rest > 0").join(ends, names).where(F.substring("__order", 1, 2 * level + 2) == F.col("__end")).select(*names, "__order", "__n", (F.col("__rest") - F.col("__before")).alias("__rest"))
    dealt = dealt.join(ends, names, "left")

    keep = [c for c in docs.columns if c not in OWN]
    out = lambda df, epoch, take: df.select(*[F.col(c) for c in keep], epoch.cast("int").alias("mix_epoch"), F.col("__n").alias("mix_tokens"), take.alias("mix_take"))
    early = F.when(F.col("__part") < F.col("__end"), F.array(F.col("__whole"))).otherwise(F.array().cast("array<bigint>"))
    epochs = F.concat(F.when(F.col("__whole") > 0, F.sequence(F.lit(0).cast("long"), F.col("__whole") - 1)).otherwise(F.array().cast("array<bigint>")), F.coalesce(early, F.array().cast("array<bigint>")))
    whole = out(dealt.withColumn("__epoch", F.explode(epochs)), F.col("__epoch"), F.col("__n"))
    last = dealt.where(F.col("__part") == F.col("__end"))
    so_far = F.col("__before") + F.sum("__n").over(Window.partitionBy(*names).orderBy("__order", F.coalesce(F.col(text_col), F.lit(""))).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    last = last.withColumn("__from", so_far).where(F.col("__from") < F.col("__rest"))
    return whole.unionByName(out(last, F.col("__whole"), F.least("__n", F.col("__rest") - F.col("__from"))))
