"""Evidence met with candidates by equality or containment, and texts cut down to a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as T

GRAM = 4


def match_text(c: Column) -> Column:
    """Lower case, single spaces, no spaces and : ; , . | at the ends; null counts as empty."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "), F.lit(" \t\r\n:;,.|"))


def _grams(c: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - GRAM + 1), lambda i: F.substring(c, i, F.lit(GRAM))))


def match_evidence(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """item_id and the first candidate of its document (by ord) that it matches: (doc_id, item_id, candidate_id, how).

    An item's texts and a candidate's match if two are equal, or one of four characters or more is contained in the other. Items
    without a match take the document's first candidate that has spans (how is then ``fallback``), or null. items(doc_id, item_id,
    texts: array of strings), candidates(doc_id, candidate_id, ord, texts, has_spans). Blank texts match nothing; item ids are
    unique in a document; repeated candidates count once.

    Texts that repeat in a document are met once: of equal candidates the first stands for all, items take what their distinct texts
    found. A text that is contained in another shares all its four-letter grams, so distinct texts meet at one gram of the shorter one, found
    among all grams of the longer one, and what meets is verified: joins on (document, gram) and (document, text), no pair of all texts. The
    gram is the one that the fewest of the document's longer texts hold, so that a word which all of them share is no meeting place.
    """
    def values(df: DataFrame, *keep: str) -> DataFrame:
        texts = F.array_distinct(F.filter(F.transform("texts", match_text), lambda t: t != ""))
        return df.select("doc_id", *keep, F.explode(texts).alias("t"))

    asked = values(items, "item_id").withColumnRenamed("t", "s")
    wanted = asked.select("doc_id", "s").distinct()
    known = values(candidates, "candidate_id", "ord").groupBy("doc_id", F.col("t").alias("c")).agg(F.min(F.struct("ord", "candidate_id")).alias("m"))
    equal = wanted.join(known, (wanted.doc_id == known.doc_id) & (wanted.s == known.c)).select(wanted.doc_id, "s", "m")
    spread = lambda df, c: df.where(F.length(c) >= GRAM).withColumn("gram", F.explode(_grams(F.col(c))))

    def within(short: DataFrame, a: str, long: DataFrame, b: str) -> DataFrame:
        """doc_id, s and m of the texts of short that stand in one of long."""
        held = spread(long, b)
        rare = held.groupBy("doc_id", "gram").agg(F.count("*").alias("__n"))
        # a text one of whose grams no longer text holds stands in none; the left join leaves it the count 0 and it meets nothing
        probes = spread(short, a).join(rare, ["doc_id", "gram"], "left").groupBy(*short.columns).agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("gram"))).alias("__p"))
        at = probes.where("__p.n > 0").select(*short.columns, F.col("__p.gram").alias("gram"))
        return at.join(held, ["doc_id", "gram"]).where(F.contains(b, a)).select("doc_id", "s", "m")

    met = equal.unionByName(within(wanted, "s", known, "c")).unionByName(within(known, "c", wanted, "s")).groupBy("doc_id", "s").agg(F.min("m").alias("m"))
    first = asked.join(met, ["doc_id", "s"]).groupBy("doc_id", "item_id").agg(F.min("m").alias("m"))
    spans = candidates.where("has_spans").groupBy("doc_id").agg(F.min(F.struct("ord", "candidate_id")).alias("f"))
    met = items.select("doc_id", "item_id").join(first, ["doc_id", "item_id"], "left").join(spans, "doc_id", "left")
    how = F.when(F.col("m").isNotNull(), "match").when(F.col("f").isNotNull(), "fallback")
    return met.select("doc_id", "item_id", F.coalesce("m.candidate_id", "f.candidate_id").alias("candidate_id"), how.alias("how"))


#: What makes a line of a long page worth keeping.
PRIORITY = ("reisepass", "passport", "surname", "name", "given", "vornamen", "birth", "geburt", "national", "staats", "sex", "geschlecht", "pass", "expiry", "gültig", "authority", "behörde", "augen", "height", "größe", "p<", "[A-Z0-9<]{25,}")


def compact_text(c: Column, short: int = 4500, head: int = 1500, tail: int = 1800, lines: int = 80, most: int = 5200) -> Column:
    """A long text's head, its first priority lines and its tail, in at most ``most`` characters; a text of up to ``short`` as it is.

    Zero characters and runs of blanks are single spaces first, three line feeds or more two; null counts as empty.
    """
    feeds = lambda t: F.btrim(F.regexp_replace(t, "\n{3,}", "\n\n"), F.lit(" \t\n\r\x0b\x0c"))
    text = feeds(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\0"), F.lit(" ")), "[ \t]+", " "))

    def chosen(t: Column) -> Column:
        kept = F.filter(F.transform(F.split(t, r"\r\n|[\n\r]", -1), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c"))), lambda x: (x != "") & x.rlike("(?iu)" + "|".join(PRIORITY)))
        parts = F.array(F.substring(t, 1, head), F.array_join(F.slice(kept, 1, lines), "\n"), F.substring(t, -tail, tail))
        joined = F.array_join(F.filter(parts, lambda p: ~p.rlike(r"^\s*$")), "\n")
        return F.when(F.length(t) <= short, t).otherwise(F.substring(feeds(joined), 1, most))

    return T.once(text, chosen)
