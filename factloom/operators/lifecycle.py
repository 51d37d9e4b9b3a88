"""States of cases, jobs and documents, rules between facts, and the rows that stages leave behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.fold import fold

#: The steps that each kind of record allows.
JOB_STEPS = [("PENDING", "RUNNING"), ("PENDING", "CANCELLED"), ("RUNNING", "COMPLETED"), ("RUNNING", "FAILED"), ("RUNNING", "CANCELLED"), ("RUNNING", "RETRYING"), ("FAILED", "RETRYING"), ("FAILED", "CANCELLED"), ("RETRYING", "RUNNING"), ("RETRYING", "CANCELLED")]
DOCUMENT_STEPS = [("PENDING", "PROCESSING"), ("PENDING", "FAILED"), ("PROCESSING", "PROCESSED"), ("PROCESSING", "FAILED")]
FACT_STEPS = [("pending", "accepted"), ("pending", "rejected"), ("accepted", "superseded")]


def fold_cases(actions: DataFrame) -> DataFrame:
    """Each case's status and priority after its actions in order of time, and how many were not allowed.

    actions(case_id, at, action): assign from any state, start from ASSIGNED, complete and escalate from
    IN_REVIEW (escalate: back to PENDING, CRITICAL), cancel from any open state. Others change nothing.
    """
    def step(state: dict, row: dict) -> dict:
        now, do = state.setdefault("status", "PENDING"), row["action"]
        to = {("start", "ASSIGNED"): "IN_REVIEW", ("complete", "IN_REVIEW"): "COMPLETED", ("escalate", "IN_REVIEW"): "PENDING"}.get((do, now))
        if do == "assign":
            to = "ASSIGNED"
        elif do == "cancel" and now not in ("COMPLETED", "CANCELLED"):
            to = "CANCELLED"
        state |= {"status": to or now, "priority": "CRITICAL" if to and do == "escalate" else state.get("priority", "NORMAL"), "refused": state.get("refused", 0) + (to is None), "n": state.get("n", 0) + 1}
        return {"__status": state["status"], "__priority": state["priority"], "__refused": state["refused"], "__n": state["n"]}

    after = fold(actions.select("case_id", "at", "action"), ["case_id"], ["at", "action"], dict, step, "__status string, __priority string, __refused int, __n long")
    last = after.groupBy("case_id").agg(F.max_by(F.struct(F.col("__status").alias("status"), F.col("__priority").alias("priority"), F.col("__refused").alias("refused")), "__n").alias("s"))
    return last.select("case_id", "s.*")


def open_cases_only_once(incoming: DataFrame, cases: DataFrame) -> DataFrame:
    """Incoming cases whose id is new and whose candidate has no open case."""
    still = cases.where(~F.col("status").isin("COMPLETED", "CANCELLED")).select("candidate_id").distinct()
    return incoming.join(cases.select("case_id"), "case_id", "left_anti").join(still, "candidate_id", "left_anti").select(*incoming.columns)


def with_sources(evidence: DataFrame, sources: DataFrame, documents: DataFrame) -> DataFrame:
    """The sources that evidence names but that are missing, each with its entity's latest document."""
    missing = evidence.select("source_id", "entity_id").distinct().join(sources.select("source_id"), "source_id", "left_anti")
    latest = documents.groupBy("entity_id").agg(F.max_by("document_id", F.struct("created_at", "document_id")).alias("document_id"))
    return missing.join(latest, "entity_id", "left").select("source_id", "entity_id", "document_id", F.lit("document").alias("source_type"))


def deferred_noise(candidates: DataFrame, noise: DataFrame) -> DataFrame:
    """One noise item for each place of candidates that has no active one."""
    place = ["entity_id", "document_id", "source_id", "stage"]
    active = noise.where(F.col("status").isin("open", "processing")).select(*place).distinct()
    new = candidates.select(*place).distinct().alias("c")
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"n.{k}")) for k in place]
    return new.join(active.alias("n"), same, "left_anti").withColumn("status", F.lit("open"))


def promote_noise(noise: DataFrame, cases: DataFrame) -> DataFrame:
    """Open noise items after promotion: promoted unless the same value has an active case, with confidence from 0.50 to 0.99."""
    active = cases.where(~F.col("status").isin("COMPLETED", "CANCELLED")).select("entity_id", F.col("value").alias("raw_text")).distinct().withColumn("__has", F.lit(True))
    done = noise.where("status = 'open'").join(active, ["entity_id", "raw_text"], "left")
    return done.withColumn("status", F.when(F.col("__has"), "failed").otherwise("promoted")).withColumn("confidence", F.greatest(F.lit(0.50), F.least(F.lit(0.99), "confidence"))).drop("__has")


def next_sequence(rows: DataFrame, stored: DataFrame, keys: list[str], order: list[Column], column: str = "sequence_number") -> DataFrame:
    """Numbers rows of each key on from the largest stored one."""
    top = stored.groupBy(*keys).agg(F.max(column).alias("__top"))
    numbered = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.join(top, keys, "left").withColumn(column, F.coalesce("__top", F.lit(0)) + F.col("__r")).drop("__top", "__r")


def latest_accepted(facts: DataFrame) -> DataFrame:
    """The newest accepted fact of each field, as a profile shows it."""
    w = Window.partitionBy("entity_id", "field_name").orderBy(F.desc("created_at"), F.desc("fact_id"))
    return facts.where("status = 'accepted'").withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def duplicate_rule(candidates: DataFrame, facts: DataFrame) -> DataFrame:
    """Adds ``passed``: no accepted fact of the entity's field has the same value."""
    have = facts.where("status = 'accepted'").select("entity_id", "field_name", "value").distinct().withColumn("__has", F.lit(True))
    return candidates.join(have, ["entity_id", "field_name", "value"], "left").withColumn("passed", F.col("__has").isNull()).drop("__has")


def consistency_rule(candidates: DataFrame, facts: DataFrame, primary: str, dependent: str, relation: str, kind: str) -> DataFrame:
    """Adds ``passed`` and ``error``: how the candidate of field ``primary`` stands to the entity's one accepted
    ``dependent`` fact.

    relation is one of = <> < <= > >=; kind is number, date or string (which knows = and <> only). Other
    fields pass, as does an entity without the fact; values that can't be read fail; several facts are an error.
    """
    if kind == "string" and relation not in ("=", "<>"):
        raise ValueError("strings are compared by = and <> only")
    read = {"number": lambda c: c.try_cast("double"), "date": lambda c: F.coalesce(*[F.try_to_date(c, f) for f in ("yyyy-MM-dd", "d.M.yyyy", "d/M/yyyy")]), "string": lambda c: c}[kind]
    other = facts.where((F.col("status") == "accepted") & (F.col("field_name") == dependent)).groupBy("entity_id").agg(F.count("*").alias("__n"), F.first(F.col("value").cast("string")).alias("__v"))
    a, b = read(F.col("value").cast("string")), read(F.col("__v"))
    holds = {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[relation]
    concerned = (F.col("field_name") == primary) & F.col("__n").isNotNull()
    joined = candidates.join(other, "entity_id", "left")
    return joined.withColumn("error", concerned & (F.col("__n") > 1)).withColumn("passed", F.when(~concerned, True).when(F.col("__n") > 1, False).otherwise(F.coalesce(holds, F.lit(False)))).drop("__n", "__v")


def manifest_gaps(entries: DataFrame, *known: DataFrame) -> DataFrame:
    """Entries of a package whose id none of the known tables (id) holds."""
    for table in known:
        entries = entries.join(table.select("id"), "id", "left_anti")
    return entries


def new_versions(templates: DataFrame, changed: DataFrame) -> DataFrame:
    """Changed templates with the version after the largest stored one."""
    top = templates.groupBy("template_id").agg(F.max("version").alias("__top"))
    return changed.join(top, "template_id", "left").withColumn("version", F.coalesce("__top", F.lit(0)) + 1).drop("__top")


def evidence_of_facts(links: DataFrame) -> DataFrame:
    """Evidence ids per fact and how many they are; links(fact_id, evidence_id)."""
    return links.groupBy("fact_id").agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids")).withColumn("n_evidence", F.size("evidence_ids"))
