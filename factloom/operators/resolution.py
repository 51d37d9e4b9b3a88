"""Entity resolution: whether the clusters of a document's candidates are one entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import lcs_ratio
from factloom.operators.knowledge import WEIGHTS

#: Fact types compared by equality, whose difference keeps clusters apart; and the limits of scores.
IDENTIFIERS = ("ssn", "tax_id", "iban", "passport_number", "national_id")
DATES = ("birth_date", "issue_date", "expiry_date")
FUZZY_LEAST, MERGE_LEAST = 0.60, 0.65


def strategy(fact_type: Column) -> Column:
    return F.when(fact_type.isin(*IDENTIFIERS), "identifier").when(fact_type.isin(*DATES), "date").otherwise("fuzzy")


def best_of_clusters(candidates: DataFrame, group: str = "group_id") -> DataFrame:
    """The most confident candidate of each group, entity and fact type, the first of equals."""
    w = Window.partitionBy(group, "entity_id", "fact_type").orderBy(F.desc("confidence"), "ord")
    return candidates.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def matches(best: DataFrame, group: str = "group_id") -> DataFrame:
    """How the clusters of a group agree on each fact type: the distinct values compared, with the numbers of pairs they stand for.

    Clusters meet by their values: each distinct value of a group and type is one row, with the number of clusters that hold it, so a
    value that very many clusters share is compared once. Pairs of the same value agree fully.
    """
    values = best.groupBy(group, "fact_type", F.col("value").alias("value")).agg(F.count("*").alias("n"))
    same = values.where("n > 1").select(group, "fact_type", F.col("value").alias("value_a"), F.col("value").alias("value_b"), (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"))
    a, b = values.alias("a"), values.alias("b")
    on = (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a.fact_type") == F.col("b.fact_type")) & (F.col("a.value") < F.col("b.value"))
    other = a.join(b, on).select(F.col(f"a.{group}").alias(group), "a.fact_type", F.col("a.value").alias("value_a"), F.col("b.value").alias("value_b"), (F.col("a.n") * F.col("b.n")).alias("pairs"))
    met = same.unionByName(other).withColumn("strategy", strategy(F.col("fact_type")))
    equal, ratio = F.col("value_a") == F.col("value_b"), F.col("ratio")
    met = met.withColumn("ratio", F.when(equal, 1.0).when(F.col("strategy") != "fuzzy", 0.0).otherwise(lcs_ratio(F.col("value_a"), F.col("value_b"))))
    confidence = F.when((F.col("strategy") == "fuzzy") & (ratio < FUZZY_LEAST), ratio * 0.5).otherwise(ratio)
    signal = F.when((F.col("strategy") != "fuzzy") & ~equal, "CONFLICT").when(confidence >= 0.9, "STRONG").when(confidence >= 0.7, "MODERATE").when(confidence >= 0.4, "WEAK").otherwise("UNKNOWN")
    return met.withColumn("confidence", confidence).withColumn("signal", signal).drop("ratio")


def agreement(best: DataFrame, group: str = "group_id") -> DataFrame:
    """For each group and fact type the pairs of clusters, the sum of their confidences, and whether they conflict.

    Identifiers and dates agree or don't, so their values are counted and never met; other types' distinct values are compared.
    """
    values = best.withColumn("strategy", strategy(F.col("fact_type"))).where("strategy <> 'fuzzy' and value is not null")
    held = values.groupBy(group, "fact_type", "value").agg(F.count("*").alias("n")).groupBy(group, "fact_type").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("same"), F.count("*").alias("kinds"))
    equal = held.where("n > 1").select(group, "fact_type", (F.col("n") * (F.col("n") - 1) / 2).alias("pairs"), F.col("same").alias("agreed"), (F.col("kinds") > 1).alias("conflict"))
    met = matches(best.where(strategy(F.col("fact_type")) == "fuzzy"), group)
    fuzzy = met.groupBy(group, "fact_type").agg(F.sum("pairs").cast("double").alias("pairs"), F.sum(F.col("confidence") * F.col("pairs")).alias("agreed"))
    return equal.unionByName(fuzzy.withColumn("conflict", F.lit(False)))


def resolve_groups(candidates: DataFrame, group: str = "group_id") -> DataFrame:
    """One row for each group: clusters, decision, score, the primary cluster and the fact types in conflict.

    One cluster is ``single`` with score 1. If identifiers or dates differ between clusters, only the primary one, that of the
    largest sum of confidences (the first of equals), is kept (``conflict``); below the merge limit the same, with
    score 1 (``apart``); else all clusters are one (``merged``). candidates(group, entity_id, fact_type, value, confidence, ord).
    """
    clusters = candidates.groupBy(group, "entity_id").agg(F.sum("confidence").alias("total"), F.min("ord").alias("first"))
    primary = clusters.groupBy(group).agg(F.count("*").alias("clusters"), F.max_by("entity_id", F.struct(F.round("total", 9).alias("t"), (-F.col("first")).alias("f"))).alias("primary_id"))
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[F.col("fact_type")], F.lit(0.5))
    found = agreement(best_of_clusters(candidates, group), group).groupBy(group).agg((F.sum(F.col("agreed") * weight) / F.sum(F.col("pairs") * weight)).alias("score"), F.array_sort(F.collect_set(F.when(F.col("conflict"), F.col("fact_type")))).alias("conflict_types"))
    met = primary.join(found, group, "left")
    hard, score = F.size(F.coalesce("conflict_types", F.array().cast("array<string>"))) > 0, F.coalesce("score", F.lit(0.0))
    decision = F.when(F.col("clusters") == 1, "single").when(hard, "conflict").when(score < MERGE_LEAST, "apart").otherwise("merged")
    shown = F.when(decision.isin("single", "apart"), 1.0).otherwise(score)
    return met.select(group, "clusters", "primary_id", decision.alias("decision"), F.round(shown, 6).alias("score"), F.array_join(F.when(decision == "conflict", F.col("conflict_types")).otherwise(F.array().cast("array<string>")), ",").alias("conflict_types"))


def canonical_values(candidates: DataFrame, resolved: DataFrame, group: str = "group_id") -> DataFrame:
    """The most confident value of each fact type over the clusters that a group keeps; the first of equals."""
    kept = candidates.join(resolved.select(group, "primary_id", "decision"), group).where((F.col("decision") == "merged") | (F.col("entity_id") == F.col("primary_id")))
    w = Window.partitionBy(group, "fact_type").orderBy(F.desc("confidence"), "ord")
    return kept.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(group, "fact_type", "value", "confidence")


def several_entities(candidates: DataFrame, group: str = "group_id") -> DataFrame:
    """Groups with candidates of more than one entity: a critical failure for the pipeline."""
    found = candidates.groupBy(group).agg(F.count_distinct("entity_id").alias("entities")).where("entities > 1")
    return found.select(group, "entities", F.lit("CRITICAL").alias("severity"))
