"""Scans and look-ups over the record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import normalize_key
from factloom.sources.shared import written

CLOSED_CASES = ("COMPLETED", "CANCELLED", "ACCEPTED", "REJECTED")
#: What a screen shows for each status of a case.
SHOWN = {"PENDING": "pending", "ASSIGNED": "pending", "IN_REVIEW": "pending", "COMPLETED": "accepted", "CANCELLED": "rejected"}


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order; nulls of a key are one key."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def latest_n(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The n first rows in the given order, with their place from 1: a top-n, each task keeps n rows."""
    top = rows.orderBy(*order).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def search(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows with ``text`` in one of the columns, whatever its case; null columns never match."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(text.lower()), F.lit(False))
    return rows.where(hit)


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with ``place``, their number from 1 in the order of all rows; equal rows are numbered as they come.

    Rows are dealt in ranges of the order and written, each range numbers its own, and the ranges' sizes, one number each, say where it begins.
    """
    dealt = written(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = sorted((r["__range"], r["n"]) for r in dealt.groupBy("__range").agg(F.count("*").alias("n")).collect())
    offsets, before = [], 0
    for number, n in sizes:
        offsets.append((number, before))
        before += n
    starts = F.broadcast(rows.sparkSession.createDataFrame(offsets, "__range int, __before long"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.join(starts, "__range").withColumn("place", (F.col("__before") + own).cast("int")).drop("__range", "__before")


def latest_of_type(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key in the order in which rows were added."""
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), order).alias("__last"))
    return last.select(*keys, "__last.*").select(*rows.columns)


def connected(relationships: DataFrame, entities: DataFrame, facts: DataFrame) -> DataFrame:
    """A row for each accepted fact of an entity that another is related to, in ``place`` order within the pair; entities without any have one row of null facts.

    relationships(source_id, target_id, relation_type), entities(entity_id, display_name), facts(entity_id, fact_id, field_name, value,
    status). Facts stand in rows, not in a list, so that an entity of very many facts is no row of its own.
    """
    targets = entities.select(F.col("entity_id").alias("target_id"), "display_name")
    held = facts.where("status = 'accepted'").select(F.col("entity_id").alias("target_id"), "fact_id", "field_name", "value")
    met = relationships.join(targets, "target_id").join(held, "target_id", "left")
    place = F.row_number().over(Window.partitionBy("source_id", "target_id", "relation_type").orderBy("field_name", "fact_id"))
    return met.select("source_id", "relation_type", "target_id", "display_name", "fact_id", "field_name", "value", F.when(F.col("fact_id").isNotNull(), place).alias("place"))


def merged_first(lists: list[DataFrame], keys: list[Column], owner: str, most: int | None = None) -> DataFrame:
    """Rows of several lists, those of an earlier list and then of smaller ``ord`` first, without later ones of the same key, at most ``most`` for each owner."""
    out = None
    for n, rows in enumerate(lists):
        part = rows.withColumn("__list", F.lit(n))
        out = part if out is None else out.unionByName(part)
    first = out.withColumn("__r", F.row_number().over(Window.partitionBy(owner, *keys).orderBy("__list", "ord"))).where("__r = 1")
    if most is not None:
        first = first.withColumn("__r", F.row_number().over(Window.partitionBy(owner).orderBy("__list", "ord"))).where(F.col("__r") <= most)
    return first.drop("__r", "__list")


def requested(rows: DataFrame, types: list[str], column: str = "fact_type") -> DataFrame:
    """Rows of the types asked for; none asked for are all."""
    return rows.where(F.col(column).isin(*types)) if types else rows


def profile_view(facts: DataFrame) -> DataFrame:
    """Accepted facts with their field's normalised name and the first value that isn't blank of canonical and display; blank ones are left out."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return facts.where("status = 'accepted'").withColumns({"field_name": normalize_key(F.col("field_name")), "value": F.coalesce(blank("canonical_value"), blank("display_value"))}).where("value is not null")


def active_entities(entities: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Active entities, newest first; with ``wanted`` (entity_id), each resolved to itself or the first active one."""
    active = entities.where("status = 'active'")
    if wanted is None:
        return numbered(active, [F.desc("created_at"), F.col("display_name")])
    first = active.orderBy(F.desc("created_at"), "display_name").limit(1).select(F.col("entity_id").alias("first_id"))
    found = wanted.join(active.select("entity_id", F.lit(True).alias("known")), "entity_id", "left").crossJoin(F.broadcast(first))  # one row
    return found.select("entity_id", F.when(F.col("known"), F.col("entity_id")).otherwise(F.col("first_id")).alias("resolved_id"))


def conflicts_of_facts(conflicts: DataFrame) -> DataFrame:
    """fact_id and the conflicts it is part of: conflicts(conflict_id, status, fact_ids)."""
    return conflicts.select("conflict_id", "status", F.explode(F.array_distinct("fact_ids")).alias("fact_id"))


def same_open_conflict(wanted: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Open conflicts of exactly the wanted set of facts, in whatever order and number."""
    key = F.array_join(F.array_sort(F.array_distinct("fact_ids")), ",").alias("key")
    return wanted.select("wanted_id", key).join(conflicts.where("status = 'open'").select("conflict_id", key), "key").select("wanted_id", "conflict_id")


def document_names(cases: DataFrame, evidence: DataFrame, sources: DataFrame, documents: DataFrame) -> DataFrame:
    """case_id and the file name behind its first evidence; an empty string if any link is missing."""
    met = cases.select("case_id", "evidence_id").join(evidence.select("evidence_id", "source_id"), "evidence_id", "left")
    met = met.join(sources.select("source_id", "document_id"), "source_id", "left").join(documents.select("document_id", "file_path"), "document_id", "left")
    return met.select("case_id", F.coalesce(F.regexp_extract("file_path", r"[^/]+$", 0), F.lit("")).alias("document_name"))


def evidence_of_documents(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Evidence with its document, numbered by time within each."""
    met = evidence.join(sources.where("document_id is not null").select("source_id", "document_id"), "source_id")
    return met.withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy("created_at", "evidence_id")))


def latest_entity(given: Column, cases: DataFrame, facts: DataFrame) -> DataFrame:
    """One row: the given entity, else the newest case's, else the newest fact's."""
    of = lambda df, key: df.agg(F.max_by("entity_id", F.struct("created_at", key)).alias("e"))
    both = of(cases, "case_id").withColumnRenamed("e", "by_case").crossJoin(F.broadcast(of(facts, "fact_id").withColumnRenamed("e", "by_fact")))  # one row each
    return both.select(F.coalesce(given, "by_case", "by_fact").alias("entity_id"))


def shown_status(status: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SHOWN.items() for x in kv])[status], F.lit("pending"))


def document_detail(documents: DataFrame, conflicts: DataFrame, cases: DataFrame) -> DataFrame:
    """Each document with the open conflicts of its entity and whether that has a pending case."""
    open_conflicts = conflicts.where("status = 'open'").groupBy("entity_id").agg(F.count("*").alias("open_conflicts"))
    waiting = cases.where("status = 'PENDING'").select("entity_id").distinct().withColumn("has_pending", F.lit(True))
    met = documents.join(open_conflicts, "entity_id", "left").join(waiting, "entity_id", "left")
    return met.select("document_id", "entity_id", F.coalesce("open_conflicts", F.lit(0)).alias("open_conflicts"), F.coalesce("has_pending", F.lit(False)).alias("has_pending"))


def document_flags(documents: DataFrame, as_of: Column) -> DataFrame:
    """expired: expires_at is reached (never if null); terminal: processed or failed."""
    return documents.select("document_id", F.coalesce(as_of >= F.col("expires_at"), F.lit(False)).alias("expired"), F.col("status").isin("processed", "failed").alias("terminal"))


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds ``violations``, the names of the rules that a row breaks; a rule that is null counts as kept."""
    return rows.withColumn("violations", F.array_compact(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()])))


def job_states(jobs: DataFrame) -> DataFrame:
    """Jobs with their priority as a number (20 if it is none) and whether they may be tried again."""
    return jobs.select("job_id", "status", F.coalesce(F.col("priority").try_cast("int"), F.lit(20)).alias("priority"), (F.col("retry_count") < F.col("max_retries")).alias("may_retry"))
