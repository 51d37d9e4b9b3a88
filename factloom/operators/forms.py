"""Fields of dynamic forms: positions, labels, mappings to profile fields, what is shown and reviewed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Profile fields with the words in a label that suggest them, in order; the first that fits wins.
SUGGESTIONS = {
    "surname": ("surname", "family name", "last name", "familienname", "nachname"),
    "given_names": ("given", "given names", "first name", "vorname", "vornamen"),
    "date_of_birth": ("birth date", "date of birth", "geburtsdatum", "geburtstag"),
    "place_of_birth": ("birth place", "place of birth", "geburtsort"),
    "nationality": ("nationality", "staatsangehoerigkeit", "staatsangehörigkeit"),
    "passport_number": ("passport", "passnummer", "ausweisnummer", "seriennummer"),
    "address": ("address", "anschrift", "adresse", "strasse", "straße"),
    "new_address": ("new address", "neue wohnung", "neue adresse", "wohnung"),
    "email": ("email", "e-mail", "mail"),
    "phone": ("phone", "telefon", "mobile", "handy", "rufnummer"),
    "move_in_date": ("move in", "einzug", "einzugsdatum"),
    "sex": ("sex", "gender", "geschlecht"),
    "marital_status": ("marital", "familienstand"),
}
#: Known fields of one form by page, x and y: profile field, required, group.
KNOWN = {
    (1, 22, 85): ("surname", True, "person"),
    (1, 112, 85): ("given_names", True, "person"),
    (1, 22, 103): ("date_of_birth", True, "person"),
    (1, 112, 103): ("place_of_birth", False, "person"),
    (1, 174, 103): ("nationality", True, "person"),
    (1, 32, 243): ("address", False, "address"),
    (1, 116, 243): ("move_in_date", False, "address"),
    (1, 32, 251): ("postal_code", False, "address"),
    (1, 32, 259): ("city", False, "address"),
    (1, 32, 267): ("new_address", False, "address"),
    (2, 22, 148): ("current_date", False, "signature"),
}
#: Fixed value: how a field's name tells its place.
PLACE = r"\.p(\d+)\.x(-?\d+(?:\.\d+)?)\.y(-?\d+(?:\.\d+)?)"


def position(name: Column) -> Column:
    """struct(page, x, y) from a field's name; page 1 and zeros if it tells none."""
    part = lambda i: F.regexp_extract(name, PLACE, i)
    return F.when(part(1) != "", F.struct((part(1).try_cast("int") + 1).alias("page"), part(2).try_cast("double").alias("x"), part(3).try_cast("double").alias("y"))).otherwise(F.struct(F.lit(1).alias("page"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))


def suggest(label: Column) -> Column:
    """The profile field that a label's words suggest, else an empty string."""
    text = F.lower(F.trim(label))
    for a, b in (("_", " "), ("-", " "), (".", " "), ("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        text = F.replace(text, F.lit(a), F.lit(b))
    out = F.lit("")
    for field, words in reversed(SUGGESTIONS.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w)
        out = F.when(hit, field).otherwise(out)
    return out


def readable(name: Column) -> Column:
    """A field's name as words; with a place in it, the place."""
    at = position(name)
    words = F.trim(F.regexp_replace(F.translate(name, "_-./", "    "), " +", " "))
    placed = F.concat(F.lit("Unknown field · Page "), at["page"].cast("string"), F.lit(" · x"), at["x"].cast("int").cast("string"), F.lit(" y"), at["y"].cast("int").cast("string"))
    return F.when((at["x"] != 0) | (at["y"] != 0), placed).when(words != "", F.initcap(words)).otherwise(name)


def smart_fields(fields: DataFrame) -> DataFrame:
    """Adds position, group, status, visible and needs_review to fields(field_name, profile_field_name, field_type, confidence)."""
    at = position(F.col("field_name"))
    key = F.concat_ws(",", at["page"].cast("string"), F.round(at["x"]).cast("int").cast("string"), F.round(at["y"]).cast("int").cast("string"))
    known = F.create_map(*[v for (p, x, y), (field, required, group) in KNOWN.items() for v in (F.lit(f"{p},{x},{y}"), F.struct(F.lit(field).alias("field"), F.lit(required).alias("required"), F.lit(group).alias("group")))])[key]
    upper, mapped = F.upper("field_name"), F.coalesce(F.col("profile_field_name"), F.lit("")) != ""
    helper = upper.contains("SYSTEM") | upper.contains("DUMMY") | upper.startswith("ES100.GEMEINDE") | ((F.col("field_type") == "checkbox") & ~mapped & (F.col("confidence") < 0.5))
    found = fields.withColumns({"position": at, "known": known})
    group = F.when(F.col("known").isNotNull(), F.col("known.group")).when(mapped, "mapped").when(helper, "hidden").when(F.col("confidence") >= 0.65, "suggested").otherwise("unknown")
    found = found.withColumn("group", group).withColumn("visible", ~F.col("group").isin("hidden", "unknown"))
    status = F.when(mapped, "mapped").when(F.col("visible"), "needs_review").otherwise("hidden")
    return found.withColumn("status", status).withColumn("needs_review", F.col("status") == "needs_review")


def prepare(fields: DataFrame) -> DataFrame:
    """Counts of each template once known fields are mapped: total, recognized, auto_mapped, review, hidden."""
    found = smart_fields(fields)
    mapped = smart_fields(found.withColumn("profile_field_name", F.coalesce("known.field", "profile_field_name")).select(*fields.columns))
    mapped = mapped.withColumn("is_known", F.col("known").isNotNull())
    return mapped.groupBy("template_id").agg(
        F.count("*").alias("total"),
        F.count_if("is_known").alias("recognized"),
        F.count_if(F.coalesce(F.col("profile_field_name"), F.lit("")) != "").alias("auto_mapped"),
        F.count_if("needs_review").alias("review"),
        F.count_if(~F.col("visible")).alias("hidden"),
    )


def field_violations(values: DataFrame) -> DataFrame:
    """Rules that a value breaks: values(value, required, min_length, max_length, min_value, max_value, pattern, allowed).

    Null limits are no limits; a missing or empty value breaks ``required`` only.
    """
    v = F.coalesce(F.col("value"), F.lit(""))
    number, given = F.col("value").try_cast("double"), v != ""
    checks = {
        "required": F.col("required") & ~given,
        "min_length": given & (F.length(v) < F.col("min_length")),
        "max_length": given & (F.length(v) > F.col("max_length")),
        "min_value": given & F.coalesce(number < F.col("min_value"), F.col("min_value").isNotNull()),
        "max_value": given & F.coalesce(number > F.col("max_value"), F.col("max_value").isNotNull()),
        "pattern": given & ~F.call_function("rlike", v, F.concat(F.lit(r"\A(?:"), "pattern", F.lit(r")\z"))),
        "allowed": given & ~F.array_contains("allowed", v),
    }
    return values.withColumn("violations", F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()])))


def submissions(previews: DataFrame) -> DataFrame:
    """Previews(entity_id, required, status) to one row each: complete ones are submitted, the others stay drafts."""
    missing = F.count_if(F.col("required") & (F.col("status") != "FILLED"))
    return previews.groupBy("entity_id").agg(missing.alias("missing")).withColumn("state", F.when(F.col("missing") == 0, "submitted").otherwise("draft"))
