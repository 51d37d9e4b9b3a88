"""Changes of stored tables, as the tables after the change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.reads import latest


def upsert_by_either(base: DataFrame, updates: DataFrame, key: str, other: str) -> DataFrame:
    """Rows of ``updates`` replace the row of the same ``key``, else the one of the same ``other``; the rest are new.

    Both keys are unique in base; among updates the last by ``key`` wins for each ``other``. Rows of a null
    ``other`` are met by ``key`` only.
    """
    columns = base.columns
    known = updates.join(base.select(key), key, "left_semi")
    rest = updates.join(base.select(key), key, "left_anti")
    rest = latest(rest.where(F.col(other).isNotNull()), [other], F.desc(key)).unionByName(rest.where(F.col(other).isNull()))
    left = base.join(known.select(key), key, "left_anti")
    left = left.join(rest.select(other), other, "left_anti")
    return left.select(*columns).unionByName(known.select(*columns)).unionByName(rest.select(*columns))


def delete_with_parts(templates: DataFrame, fields: DataFrame, gone: DataFrame, key: str = "template_id") -> tuple[DataFrame, DataFrame]:
    """Both tables without the templates of ``gone`` and their fields."""
    return templates.join(gone.select(key), key, "left_anti"), fields.join(gone.select(key), key, "left_anti")


def touch(templates: DataFrame, edited: DataFrame, now: Column, key: str = "template_id") -> DataFrame:
    """Templates of which a field was edited get ``now`` as their time of update."""
    hit = edited.select(key).distinct().withColumn("__hit", F.lit(True))
    met = templates.join(hit, key, "left").withColumn("updated_at", F.when(F.col("__hit"), now).otherwise(F.col("updated_at")))
    return met.select(*templates.columns)


def set_status(rows: DataFrame, changes: DataFrame, key: str, now: Column) -> DataFrame:
    """Rows with the status of their change, and ``reviewed_at`` set where one was made; the others keep theirs."""
    met = rows.join(changes.select(key, F.col("status").alias("__new")), key, "left")
    made = F.col("__new").isNotNull()
    changed = met.withColumns({"status": F.coalesce("__new", "status"), "reviewed_at": F.when(made, now).otherwise(F.col("reviewed_at"))})
    return changed.select(*rows.columns)


def apply_decisions(cases: DataFrame, decisions: DataFrame, facts: DataFrame, fields: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """What the latest decision of each case does: (results, facts after it).

    An edit needs a value and is only kept with the case; a rejection cancels the case and rejects its fact;
    an acceptance takes the edited value, else the normalised, else the raw one, fails if all are blank, and sets value, field (``other``
    if it is none of ``fields``) and status of the case's fact, or adds a fact if there is none. Cases without decisions stay out.
    cases(case_id, entity_id, fact_id, fact_type, raw_value, normalized_value), decisions(case_id, decision_id, outcome,
    edited_value, decided_at), facts(fact_id, entity_id, field_name, value, status).
    """
    last = latest(decisions, ["case_id"], F.desc("decided_at"), F.desc("decision_id")).select("case_id", "outcome", F.trim("edited_value").alias("edited"))
    met = cases.join(last, "case_id")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    value = F.when(F.col("outcome") == "accept", F.coalesce(blank("edited"), blank("normalized_value"), blank("raw_value"))).when(F.col("outcome") == "edit", blank("edited"))
    error = F.when((F.col("outcome") == "edit") & value.isNull(), "Edited value is empty").when((F.col("outcome") == "accept") & value.isNull(), "Value is empty").when(~F.col("outcome").isin("accept", "reject", "edit"), "Unknown decision")
    field = F.when(F.lower(F.trim("fact_type")).isin(*fields), F.lower(F.trim("fact_type"))).otherwise("other")
    results = met.select("case_id", "entity_id", "fact_id", "outcome", field.alias("field_name"), value.alias("value"), error.alias("error"))
    done = latest(results.where("error is null and outcome in ('accept', 'reject') and fact_id is not null"), ["fact_id"], F.desc("case_id"))
    change = done.select("fact_id", F.col("entity_id").alias("__entity"), F.col("field_name").alias("__field"), F.col("value").alias("__value"), F.col("outcome").alias("__outcome"))
    after = facts.join(change, "fact_id", "full")
    accepted, rejected = F.col("__outcome") == "accept", F.col("__outcome") == "reject"
    after = after.where(F.col("status").isNotNull() | accepted).select(
        "fact_id",
        F.coalesce("entity_id", "__entity").alias("entity_id"),
        F.when(accepted, F.col("__field")).otherwise(F.col("field_name")).alias("field_name"),
        F.when(accepted, F.col("__value")).otherwise(F.col("value")).alias("value"),
        F.when(accepted, "accepted").when(rejected, "rejected").otherwise(F.col("status")).alias("status"),
    )
    return results, after


def owners(selections: DataFrame, entities: DataFrame) -> DataFrame:
    """Each selection's owner: an active entity of that name (whatever its case) and type, the oldest, else a new one.

    A new one's id is made from name and type, so that equal selections meet. selections(case_id, owner_name, owner_type); blank
    types are ``unknown_organization``, blank names give no owner.
    """
    name, kind = F.trim("owner_name"), F.coalesce(F.nullif(F.trim("owner_type"), F.lit("")), F.lit("unknown_organization"))
    wanted = selections.select("case_id", name.alias("owner_name"), kind.alias("owner_type"), F.lower(name).alias("__name"))
    known = latest(entities.where("status = 'active'").withColumn("__name", F.lower("display_name")), ["__name", "entity_type"], F.col("created_at"), F.col("entity_id"))
    met = wanted.join(known.select("__name", F.col("entity_type").alias("owner_type"), F.col("entity_id").cast("string").alias("__id")), ["__name", "owner_type"], "left")
    new = F.concat(F.lit("new-"), F.substring(F.sha2(F.concat_ws("|", "__name", "owner_type"), 256), 1, 16))
    blank = F.col("__name") == ""
    return met.select("case_id", F.when(~blank, F.coalesce("__id", new)).alias("owner_id"), (F.col("__id").isNull() & ~blank).alias("is_new"))
