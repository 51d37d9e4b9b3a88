"""From decided candidates to facts, evidence, links, provenance and conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.sources.ledger import write_batch


def _id(kind: str, *of: str) -> Column:
    """The same id for the same rows, in whichever batch or try they come."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(kind), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in of]), 256), 1, 32)


def candidates(found: DataFrame, keys: tuple[str, ...] = ("document_id", "fact_type", "raw_value", "span_ids")) -> DataFrame:
    """Candidates of what extractors found: a stable id, confidence from 0 to 1 with four digits, span ids that are ids.

    Valid span ids (32 hex digits) stay; where there are none the document's own id, hex digits only and padded
    with zeros, stands for them. Rows without a value or a type are none; of rows that are equal in ``keys`` the surest stays. A
    null confidence is 0.
    """
    confidence = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0)))), 4)
    valid = F.filter(F.coalesce("span_ids", F.array().cast("array<string>")), lambda s: s.rlike("^[0-9a-f]{32}$"))
    own = F.rpad(F.regexp_replace(F.lower(F.col("document_id").cast("string")), "[^0-9a-f]", ""), 32, "0")
    rows = found.where((F.trim("normalized_value") != "") & (F.trim("fact_type") != "")).withColumns({"confidence": confidence, "span_ids": F.when(F.size(valid) > 0, valid).otherwise(F.array(own))})
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct("confidence", "normalized_value")).alias("__best"))
    made = best.select(*keys, "__best.*").select(*rows.columns)
    text = [F.coalesce(F.array_join(k, ",") if k == "span_ids" else F.col(k).cast("string"), F.lit("")) for k in keys]
    return made.withColumn("candidate_id", F.substring(F.sha2(F.concat_ws("|", *text), 256), 1, 32))


def actor(stage: Column) -> Column:
    return F.when(F.lower(stage).contains("ocr"), "OCR").when(F.lower(stage).contains("mrz") | F.lower(stage).contains("regex"), "SYSTEM").when(F.lower(stage).contains("manual"), "USER").otherwise("SYSTEM")


def build(decided: DataFrame, at: Column) -> dict[str, DataFrame]:
    """Five tables of the candidates that ``decisions.decide`` went through: facts, evidence, links, provenance, conflict_facts.

    Every candidate gives one row of evidence; a candidate that is a fact gives a fact, the link to its evidence
    and a chain of one step. Where candidates of one entity and type have several values, their facts are in conflict if there
    are two or more: conflict_facts has a row for each, so that no list of an entity's facts is gathered. Ids are made
    from candidate ids, so that a batch that runs again gives the same rows. ``at`` is the time of the build. Needs
    candidate_id, entity_id, document_id, source_id, fact_type, raw_value, normalized_value, source_stage, confidence and
    metadata besides what ``decide`` adds; span_ids are kept if there are any. Repeated rows give repeated rows, null values
    are no values, an empty table gives five empty ones.
    """
    rows = decided.withColumns({"fact_id": F.when(F.col("is_fact"), _id("fact", "candidate_id")), "evidence_id": _id("evidence", "candidate_id")})
    spans = F.col("span_ids") if "span_ids" in decided.columns else F.array().cast("array<string>")
    own = {"document_id": F.col("document_id"), "candidate_fact_id": F.col("candidate_id"), "fact_type": F.col("fact_type"), "resolved_field_name": F.col("field_name")}
    known = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*own))
    metadata = F.map_concat(known, F.create_map(*[x for k, c in own.items() for x in (F.lit(k), c.cast("string"))]))
    evidence = rows.select("evidence_id", "source_id", "entity_id", "field_name", "raw_value", F.col("source_stage").alias("extraction_method"), "confidence", F.struct(spans.alias("span_ids")).alias("location"), metadata.alias("metadata"))
    kept = rows.where("is_fact")
    facts = kept.select("fact_id", "entity_id", "field_name", F.col("normalized_value").alias("canonical_value"), F.col("normalized_value").alias("display_value"), "source_stage", "confidence", at.alias("created_at"))
    links = kept.select("fact_id", "evidence_id", F.lit("PRIMARY").alias("role"))
    said = F.col("confidence").cast("string")
    note = F.concat(F.lit("raw_value='"), F.coalesce("raw_value", F.lit("")), F.lit("' confidence="), said)
    step = F.struct(F.lit(0).alias("step_order"), F.lit("extracted").alias("action"), actor(F.col("source_stage")).alias("actor"), at.alias("occurred_at"), F.col("evidence_id"), note.alias("note"))
    summary = F.concat(F.lit("Fact '"), "field_name", F.lit("' extracted from source '"), F.col("source_id").cast("string"), F.lit("' with confidence "), said)
    provenance = kept.select(_id("provenance", "candidate_id").alias("provenance_id"), "fact_id", "entity_id", F.array(step).alias("decision_chain"), summary.alias("summary"))
    group = Window.partitionBy("entity_id", "fact_type")  # a join with the groups would decide every candidate twice
    sides = {"__low": F.min("normalized_value").over(group), "__high": F.max("normalized_value").over(group), "n_facts": F.count_if(F.col("is_fact")).over(group)}
    split = rows.where("entity_id is not null and fact_type is not null").select("entity_id", "fact_type", "normalized_value", "is_fact", "fact_id").withColumns(sides).where("is_fact and __low <> __high and n_facts >= 2")
    conflict = split.select(_id("conflict", "entity_id", "fact_type").alias("conflict_id"), "entity_id", F.col("fact_type").alias("field_name"), "fact_id", "n_facts")
    return {"facts": facts, "evidence": evidence, "links": links, "provenance": provenance, "conflict_facts": conflict}


def build_batch(decided: DataFrame, at: Column, root: str, batch: str) -> bool:
    """Write a batch's five tables together, as ``ledger.write_batch``; a batch that is run again changes nothing."""
    return write_batch(build(decided, at), root, batch)
