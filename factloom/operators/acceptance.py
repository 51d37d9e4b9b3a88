"""Which pending facts are accepted by themselves, and whether stored audit entries are what was signed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import values as V
from factloom.operators.knowledge import priority_strict

#: Fields that a person must always see, and the confidence that machine-readable lines need.
NEVER_ALONE = ("document_label", "review_candidate", "possible_location", "possible_date", "document_keyword", "mrz_confidence", "mrz_status", "mrz_check_passed")
MRZ_LEAST = 0.90


def split(facts: DataFrame) -> DataFrame:
    """Adds outcome and priority to pending facts with their first evidence's metadata.

    ``accepted``: from a machine-readable line whose check digits are right, of at least MRZ_LEAST, unless the field, the
    evidence's role or its flags forbid it. Others become a ``case`` if there is evidence, else they are ``rejected``.
    facts(field_name, confidence, n_evidence, source, mrz_check_passed, auto_accept, role, is_person_fact); null
    flags forbid nothing, a null source or check accepts nothing.
    """
    flag = lambda c, value: F.coalesce(F.col(c) == value, F.lit(False))
    vetoed = F.col("field_name").isin(*NEVER_ALONE) | flag("auto_accept", False) | flag("role", "document_label") | flag("is_person_fact", False)
    sure = (F.lower("source") == "mrz") & F.col("mrz_check_passed") & (F.col("confidence") >= MRZ_LEAST)
    outcome = F.when(~vetoed & F.coalesce(sure, F.lit(False)), "accepted").when(F.col("n_evidence") > 0, "case").otherwise("rejected")
    return facts.withColumns({"outcome": outcome, "priority": priority_strict(F.col("confidence"))})


def canonical_json(fields: dict[str, Column]) -> Column:
    """Fields as JSON, keys in order and spaced as Python's json.dumps(sort_keys=True) does, letters as they are; values are strings or null."""
    def quoted(c: Column) -> Column:
        out = c
        for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            out = F.replace(out, F.lit(a), F.lit(b))
        return F.coalesce(F.concat(F.lit('"'), out, F.lit('"')), F.lit("null"))

    parts = []
    for n, k in enumerate(sorted(fields)):
        parts += [F.lit(("{" if n == 0 else ", ") + f'"{k}": '), quoted(fields[k])]
    return F.concat(*parts, F.lit("}"))


def verify(entries: DataFrame, key: bytes, payload: Column, owner: str) -> DataFrame:
    """Entries, verified and failed ones of each owner: the signature is made again from the payload."""
    if len(key) < 32:
        raise ValueError("a key of 32 bytes at least")
    right = F.coalesce(F.col("signature") == V.hmac_sha256(key, payload), F.lit(False))
    return entries.groupBy(owner).agg(F.count("*").alias("n"), F.count_if(right).alias("verified"), F.count_if(~right).alias("failed"))
