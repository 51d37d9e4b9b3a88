"""Health, profiles and personal advice, for all entities at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sections of a profile with their fields, and the fields that a profile must have.
SECTIONS = {
    "identity": ("given_names", "surname", "full_name", "date_of_birth", "place_of_birth", "nationality", "sex", "marital_status"),
    "address": ("address", "street", "house_number", "zip_code", "city", "new_address", "new_street", "new_house_number", "new_zip_code", "new_city"),
    "passport": ("passport_number", "issuing_authority", "issue_date", "valid_until", "document_number"),
    "contact": ("email", "phone", "mobile"),
    "residence": ("residence_permit_type", "residence_permit_number", "arrival_date", "move_in_date", "previous_address"),
    "tax_insurance": ("tax_id", "health_insurance", "social_security_number"),
    "work": ("employer", "job_title", "employment_start_date", "income"),
    "education": ("school", "university", "degree", "graduation_date"),
    "family": ("spouse_name", "children", "father_name", "mother_name"),
}
REQUIRED = ("given_names", "surname", "date_of_birth", "place_of_birth", "nationality", "address", "new_address", "passport_number")
#: Fields whose dates expire.
EXPIRY_FIELDS = ("expiry_date", "document_date", "passport_expiry", "id_expiry", "valid_until", "gueltig_bis", "ablaufdatum")
#: Words for being married.
MARRIED = ("married", "verheiratet", "متزوج", "متزوجة")


def counts(df: DataFrame, **how: Column) -> DataFrame:
    return df.agg(*[F.count_if(c).alias(k) for k, c in how.items()])


def health(entities: DataFrame, documents: DataFrame, facts: DataFrame, cases: DataFrame, profiles: DataFrame, outputs: DataFrame, noise: DataFrame, audit: DataFrame) -> DataFrame:
    """One row: what there is, and the stage that follows from it. Each table is counted once, by one aggregate."""
    every = F.lit(True)
    parts = [
        counts(entities, entities=F.col("status") == "active"),
        counts(documents, documents=every),
        counts(facts, facts=every, accepted_facts=F.col("status") == "accepted"),
        counts(cases, pending_cases=F.col("status") == "PENDING", accepted_cases=F.col("status") == "ACCEPTED", rejected_cases=F.col("status") == "REJECTED"),
        profiles.agg(F.count_distinct("entity_id").alias("profiles")),
        counts(outputs, outputs=every),
        counts(noise, noise=every, open_noise=F.col("status").isin("open", "processing", "failed")),
        counts(audit, audit_entries=every),
    ]
    one = parts[0]
    for part in parts[1:]:
        one = one.crossJoin(F.broadcast(part))  # one row each
    return one.withColumn("stage", stage())


def stage() -> Column:
    """The seven stages, by counts, in order."""
    return (
        F.when(F.col("entities") == 0, "Entity Start")
        .when(F.col("documents") == 0, "Document Intake")
        .when(F.col("facts") == 0, "Extraction")
        .when((F.col("pending_cases") > 0) & (F.col("accepted_facts") == 0), "Human Review")
        .when((F.col("accepted_facts") > 0) & (F.col("profiles") == 0), "Profile Build")
        .when((F.col("profiles") > 0) & (F.col("outputs") == 0), "Forms and Output")
        .otherwise("Operational")
    )


def profile_status(entities: DataFrame, documents: DataFrame, facts: DataFrame, cases: DataFrame, profiles: DataFrame) -> DataFrame:
    """What to do next for each entity."""
    per = lambda df, name: df.groupBy("entity_id").agg(F.count("*").alias(name))
    met = entities.select("entity_id")
    for part in (per(documents, "documents"), per(cases.where("status = 'PENDING'"), "pending"), per(facts.where("status = 'accepted'"), "accepted"), per(profiles, "fields")):
        met = met.join(part, "entity_id", "left")
    met = met.fillna(0)
    step = (
        F.when(F.col("documents") == 0, "Upload documents for this entity.")
        .when(F.col("pending") > 0, "Review pending extracted facts.")
        .when(F.col("accepted") == 0, "Accept facts before building a trusted profile.")
        .when(F.col("fields") == 0, "Build the profile from accepted facts.")
        .otherwise("Profile is ready.")
    )
    return met.select("entity_id", "documents", "pending", "accepted", (F.col("fields") > 0).alias("profile_exists"), step.alias("next_step"))


def section_of(field: Column) -> Column:
    out = F.lit("other")
    for section, fields in reversed(SECTIONS.items()):
        out = F.when(field.isin(*fields), section).otherwise(out)
    return out


def section_summaries(profiles: DataFrame) -> DataFrame:
    """Each entity's filled required fields by section, for sections that have required ones; blank values don't count."""
    need = {s: [f for f in fields if f in REQUIRED] for s, fields in SECTIONS.items()}
    filled = profiles.where(F.trim("value") != "").groupBy("entity_id").agg(F.collect_set(F.when(F.col("field_name").isin(*REQUIRED), F.col("field_name"))).alias("have"))
    entities = profiles.select("entity_id").distinct().join(filled, "entity_id", "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    row = lambda s, fs: F.struct(F.lit(s).alias("section"), F.lit(len(fs)).alias("total_required"), F.size(F.array_intersect("have", F.array(*[F.lit(f) for f in fs]))).alias("filled_required"))
    rows = entities.select("entity_id", F.inline(F.array(*[row(s, fs) for s, fs in need.items() if fs])))
    return rows.withColumn("completeness", F.round(F.col("filled_required") / F.col("total_required"), 2))


def profile_completeness(profiles: DataFrame) -> DataFrame:
    """Share of the required fields that have a value, and how many are missing."""
    filled = F.count_if((F.trim("value") != "") & F.col("field_name").isin(*REQUIRED))
    return profiles.groupBy("entity_id").agg(filled.alias("filled")).select("entity_id", F.round(F.col("filled") / float(len(REQUIRED)), 2).alias("completeness"), (F.lit(len(REQUIRED)) - F.col("filled")).alias("missing"))


def contexts(profiles: DataFrame, conflicts: DataFrame, as_of: Column) -> DataFrame:
    """What advice depends on, one row for each entity with a profile: field values, age, open conflicts, missing fields."""
    names = ("date_of_birth", "marital_status", "employer", "job_title", "bank_name", "iban")
    value = lambda name: F.max(F.when(F.col("field_name") == name, F.col("value"))).alias(name)
    missing = F.lit(len(REQUIRED)) - F.count_if(F.col("field_name").isin(*REQUIRED))
    base = profiles.groupBy("entity_id").agg(*[value(n) for n in names], missing.alias("n_missing"))
    open_conflicts = conflicts.where("status = 'open'").groupBy("entity_id").agg(F.count("*").alias("open_conflicts"))
    born = F.try_to_date(F.col("date_of_birth"), "yyyy-MM-dd")
    age = F.year(as_of) - F.year(born) - (F.date_format(as_of, "MMdd") < F.date_format(born, "MMdd")).cast("int")
    return base.join(open_conflicts, "entity_id", "left").select("entity_id", *names, "n_missing", F.coalesce("open_conflicts", F.lit(0)).alias("open_conflicts"), age.alias("age"))


def advice(profiles: DataFrame, conflicts: DataFrame, as_of: Column) -> DataFrame:
    """Advice for each entity by seven rules: entity_id, category, severity, rule, n (days, counts or age), most severe first."""
    days = F.date_diff(F.try_to_date(F.col("value"), "yyyy-MM-dd"), as_of)
    docs = profiles.where(F.lower("field_name").isin(*EXPIRY_FIELDS)).withColumn("n", days).where("n <= 90")
    docs = docs.select("entity_id", F.lit("documents").alias("category"), F.when(F.col("n") <= 30, "critical").otherwise("warning").alias("severity"), F.when(F.col("n") < 0, "doc_expired").otherwise("doc_expiring").alias("rule"), F.abs("n").cast("long").alias("n"))
    item = lambda ok, category, severity, rule, n: F.when(ok, F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), n.cast("long").alias("n")))
    has = lambda name: F.coalesce(F.col(name), F.lit("")) != ""
    none = F.lit(None)
    rules = F.array_compact(F.array(
        item(F.col("n_missing") > 0, "general", "warning", "missing_fields", F.col("n_missing")),
        item(F.col("open_conflicts") > 0, "conflicts", "critical", "open_conflicts", F.col("open_conflicts")),
        item(F.col("age") >= 35, "health", "info", "health_checkup", F.col("age")),
        item(F.col("iban").isNotNull() & has("bank_name"), "financial", "info", "financial_iban", none),
        item(F.lower("marital_status").isin(*MARRIED), "family", "info", "family_spouse", none),
        item(has("employer") & has("job_title"), "employment", "info", "employment_update", none),
    ))
    return docs.unionByName(contexts(profiles, conflicts, as_of).select("entity_id", F.inline(rules)))


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in ("critical", "warning", "info")]), severity).cast("int")


def advice_by_category(items: DataFrame) -> DataFrame:
    return items.groupBy("category", "severity").agg(F.count("*").alias("n"), F.count_distinct("entity_id").alias("entities"))
