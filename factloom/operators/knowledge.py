"""Facts, evidence, review, resolution, audit, forms and queues as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import values as V

PRIORITIES = ("CRITICAL", "HIGH", "NORMAL", "LOW")
#: Half-open confidence buckets of the review queue, the best first.
BUCKETS = ((0.90, 1.01), (0.80, 0.90), (0.70, 0.80), (0.60, 0.70), (0.50, 0.60), (0.0, 0.50))
#: Weights of fact types in an entity's score; all others count half.
WEIGHTS = {"ssn": 1.0, "tax_id": 1.0, "iban": 0.95, "birth_date": 0.8, "full_name": 0.7}


def priority_strict(confidence: Column) -> Column:
    return F.when(confidence < 0.4, "HIGH").when(confidence < 0.6, "NORMAL").otherwise("LOW")


def priority_lenient(confidence: Column) -> Column:
    return F.when(confidence < 0.6, "HIGH").when(confidence < 0.8, "NORMAL").otherwise("LOW")


def priority_rank(priority: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.upper(priority)), F.lit(0)).cast("int")


def bucket(confidence: Column) -> Column:
    out = F.lit(None).cast("int")
    for n, (lo, hi) in reversed(list(enumerate(BUCKETS))):
        out = F.when((confidence >= lo) & (confidence < hi), n).otherwise(out)
    return out


def bucket_top_k(cases: DataFrame, k: int = 20) -> DataFrame:
    """The k most confident, newest cases of each entity and bucket."""
    found = cases.withColumn("bucket", bucket(F.col("confidence"))).where("bucket is not null")
    w = Window.partitionBy("entity_id", "bucket").orderBy(F.desc("confidence"), F.desc("created_at"), "case_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def review_metrics(cases: DataFrame) -> DataFrame:
    open_case = ~F.col("status").isin("COMPLETED", "CANCELLED", "ACCEPTED", "REJECTED")
    shown = open_case & (F.col("confidence") >= 0.5) & ~F.col("fact_type").isin("review_candidate", "bic")
    return cases.groupBy("entity_id").agg(F.count_if(open_case).alias("pending"), F.count_if(F.col("status").isin("COMPLETED", "ACCEPTED")).alias("accepted"), F.count_if(F.col("status").isin("CANCELLED", "REJECTED")).alias("rejected"), F.count_if(shown).alias("visible"), F.count_if(open_case & ~shown).alias("hidden"))


def best_fact(facts: DataFrame, keys: list[str]) -> DataFrame:
    """The most confident fact per key, the earliest of equals."""
    w = Window.partitionBy(*keys).orderBy(F.desc("confidence"), "created_at", "fact_id")
    return facts.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def weighted_score(facts: DataFrame, keys: list[str], type_col: str = "field_name") -> DataFrame:
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[F.col(type_col)], F.lit(0.5))
    return facts.groupBy(*keys).agg((F.sum(F.col("confidence") * weight) / F.sum(weight)).alias("score"))


def completeness(facts: DataFrame, schema: list[str]) -> DataFrame:
    """Covered share of a profile's fields, and those missing."""
    wanted = F.array(*[F.lit(x) for x in schema])
    got = facts.groupBy("entity_id").agg(F.array_intersect(wanted, F.collect_set("field_name")).alias("covered"))
    return got.select("entity_id", F.size("covered").alias("n_covered"), F.round(F.size("covered") / float(len(schema)), 4).alias("completeness"), F.array_except(wanted, "covered").alias("missing"))


def conflicts(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Fields of an entity with several different values, and the facts that hold them."""
    return facts.groupBy(*keys).agg(F.count_distinct("value").alias("n_values"), F.array_sort(F.collect_set("fact_id")).alias("fact_ids")).where("n_values > 1")


def new_rows(incoming: DataFrame, stored: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows whose key is not stored, the first of each; those of null key all pass."""
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    first = incoming.where(~null_key).withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")
    return first.join(stored.select(*keys), keys, "left_anti").select(*incoming.columns).unionByName(incoming.where(null_key))


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], frozen: list[str] = ()) -> DataFrame:
    """Update by key or insert; ``frozen`` columns keep their stored value."""
    b, u = base.withColumn("__b", F.lit(True)).alias("b"), updates.withColumn("__u", F.lit(True)).alias("u")
    joined = b.join(u, [F.col(f"b.{k}") == F.col(f"u.{k}") for k in keys], "full_outer")
    value = lambda c: F.coalesce(f"b.{c}", f"u.{c}") if c in keys or c in frozen else F.when(F.col("u.__u"), F.col(f"u.{c}")).otherwise(F.col(f"b.{c}"))
    return joined.select(*[value(c).alias(c) for c in base.columns])


def transitions(requests: DataFrame, allowed: list[tuple[str, str]], from_col: str, to_col: str) -> DataFrame:
    """Adds ``legal``: whether the state machine has the step."""
    steps = F.array(*[F.lit(f"{a}>{b}") for a, b in allowed])
    return requests.withColumn("legal", F.array_contains(steps, F.concat_ws(">", from_col, to_col)))


def chain_violations(entries: DataFrame, scope: list[str], order: Column) -> DataFrame:
    """Entries whose previous hash or time does not follow from the entry before."""
    w = Window.partitionBy(*scope).orderBy(order)
    before, time = F.lag("entry_hash").over(w), F.lag("occurred_at").over(w)
    reason = F.when(~F.col("previous_hash").eqNullSafe(before), "link").when(F.col("occurred_at") < time, "time")
    return entries.withColumn("violation", reason)


def entry_hash(previous: Column, payload: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(previous, F.lit("")), payload), 256)


def signed(entries: DataFrame, key: bytes, payload: Column) -> DataFrame:
    return entries.withColumn("signature", V.hmac_sha256(key, payload))


def lease(jobs: DataFrame, now: Column, n: int = 1) -> DataFrame:
    """The next jobs: highest priority, then oldest, of those available."""
    ready = jobs.where(F.col("status").isin("pending", "retrying") & (F.col("available_at") <= now))
    return ready.orderBy(F.desc("priority"), "created_at", "job_id").limit(n)


def recovery(failures: DataFrame) -> DataFrame:
    """One decision for each job from all its failures."""
    one = failures.groupBy("job_id").agg(F.count("severity").alias("n"), F.coalesce(F.bool_or(F.col("severity") == "CRITICAL"), F.lit(False)).alias("critical"), F.coalesce(F.bool_or("is_retryable"), F.lit(False)).alias("retry"), F.coalesce(F.bool_or("requires_review"), F.lit(False)).alias("review"))
    decision = F.when(F.col("n") == 0, "CONTINUE").when(F.col("critical"), "ABORT").when(F.col("retry"), "RETRY").when(F.col("review"), "ESCALATE").otherwise("ABORT")
    return one.select("job_id", "n", decision.alias("decision"))


def expiry_advice(fields: DataFrame, as_of: Column) -> DataFrame:
    """Dates that expire within 90 days: critical up to 30 days or past, else warning; soonest first."""
    days = F.date_diff("expires_on", as_of)
    return fields.withColumn("days", days).where(days <= 90).withColumn("severity", F.when(days <= 30, "critical").otherwise("warning")).orderBy("days")


def form_preview(template: DataFrame, mapping: DataFrame, facts: DataFrame) -> DataFrame:
    """Each template field with the mapped fact's value, or why there is none."""
    found = template.join(mapping, "field_id", "left").join(facts, ["entity_id", "fact_type"], "left")
    status = F.when(F.col("fact_type").isNull(), "UNMAPPED").when(F.col("value").isNull(), "FACT_NOT_FOUND").otherwise("FILLED")
    return found.select("entity_id", "field_id", "required", "value", status.alias("status"))


def readiness(preview: DataFrame) -> DataFrame:
    need, have = F.count_if(F.col("required")), F.count_if(F.col("required") & (F.col("status") == "FILLED"))
    return preview.groupBy("entity_id").agg(F.count_if(F.col("status") == "FILLED").alias("filled"), need.alias("needed"), F.when(need == 0, 1.0).otherwise(F.round(have / need, 2)).alias("readiness"))


def validate(candidates: DataFrame, rules: list[dict]) -> DataFrame:
    """One row for each candidate and rule: passed. Kinds: range (least, most), date, format (regex)."""
    checks = []
    for r in rules:
        number = F.col("value").try_cast("double")
        ok = {"range": lambda r=r: F.coalesce(number.between(r.get("least", float("-inf")), r.get("most", float("inf"))), F.lit(False)), "date": lambda: V.parse_date(F.col("value")).isNotNull(), "format": lambda r=r: F.coalesce(F.col("value").rlike(rf"\A(?:{r.get('regex', '.*')})\z"), F.lit(False))}[r["kind"]]()
        checks.append(F.struct(F.lit(r["rule_id"]).alias("rule_id"), F.when(F.col("fact_type") == r["fact_type"], ok).otherwise(True).alias("passed"), F.lit(r.get("severity", "ERROR")).alias("severity")))
    return candidates.select("*", F.inline(F.array(*checks)))


def rollup(results: DataFrame, keys: list[str]) -> DataFrame:
    failed = lambda s: F.bool_or(~F.col("passed") & (F.col("severity") == s))
    return results.groupBy(*keys).agg(F.when(failed("ERROR"), "FAILED").when(failed("WARNING"), "WARNING").otherwise("PASSED").alias("status"))


def fuse_lines(first: DataFrame, second: DataFrame) -> DataFrame:
    """OCR lines of two engines, matched once each by their squeezed lower-case text within a page."""
    key = F.lower(F.regexp_replace(F.trim("text"), r"\s+", " "))
    ranked = lambda df: df.withColumn("key", key).withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "page", "key").orderBy("y", "x")))
    a, b = ranked(first).alias("a"), ranked(second).alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("doc_id", "page", "key")] + [F.col("a.r") == F.col("b.r"), F.col("a.r") == 1]
    both = F.col("a.key").isNotNull() & F.col("b.key").isNotNull()
    pick = lambda c: F.coalesce(f"a.{c}", f"b.{c}").alias(c)
    return a.join(b, on, "full_outer").select(pick("doc_id"), pick("page"), pick("text"), pick("x"), pick("y"), F.when(both, F.round((F.col("a.conf") + F.col("b.conf")) / 2, 4)).otherwise(F.coalesce("a.conf", "b.conf")).alias("conf"), both.alias("fused"))


def ocr_lines(words: DataFrame) -> DataFrame:
    """Words to lines: text in word order, mean confidence, enclosing box."""
    return words.groupBy("doc_id", "page", "block", "par", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda x: x["text"]), " ").alias("text"), F.round(F.avg("conf"), 4).alias("conf"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"))
