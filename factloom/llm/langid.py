"""Language ID by compression (operator 2)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESULT = "lang string, score double, margin double, rejected boolean"


@dataclass(frozen=True)
class LanguageModel:
    """Raw-content dictionaries by language, the most frequent language first."""

    dictionaries: tuple[tuple[str, bytes], ...]


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_docs: int = 400, sample_bytes: int = 1500, dictionary_bytes: int = 65_536, most_languages: int = 1000) -> LanguageModel:
    """Learn from a bounded sample of the labelled rows.

    The bound: at most ``sample_docs`` distinct texts of each language, those of least hash, of each
    at most ``sample_bytes`` bytes, in all ``dictionary_bytes`` a language, and the
    ``most_languages`` most frequent labels. A first cut by the hash leaves four times as many rows
    in the mean, whose copies are dropped on Spark, so a text that fills a third of all rows is drawn
    once. Rows whose text or language is null or whose text is empty take no part; an empty table gives no languages.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null and length(text) > 0")
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("text"), 0.05).alias("d")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    if not found:
        return LanguageModel(())
    span = 1 << 40
    below = {r["lang"]: span if r["d"] <= 4 * sample_docs else int(span * 4 * sample_docs / r["d"]) for r in found}
    share = F.create_map(*[F.lit(x) for kv in below.items() for x in kv])
    draw = F.pmod(F.xxhash64("text"), F.lit(span))
    drawn = rows.where(draw < share[F.col("lang")]).select("lang", draw.alias("draw"), F.lower(F.substring("text", 1, sample_bytes)).alias("part"))
    drawn = drawn.groupBy("lang", "draw").agg(F.min("part").alias("part"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    parts: dict[str, list[bytes]] = {}
    for r in drawn.withColumn("r", rank).where(F.col("r") <= sample_docs).orderBy("lang", "draw").collect():
        parts.setdefault(r["lang"], []).append(r["part"].encode()[:sample_bytes])
    return LanguageModel(tuple((r["lang"], b"\n".join(parts[r["lang"]])[:dictionary_bytes]) for r in found if r["lang"] in parts))


@lru_cache(maxsize=2)
def _coders(dictionaries: tuple[tuple[str, bytes], ...], level: int) -> tuple:
    """A coder for each language, built once in a worker process."""
    import zstandard as zs

    out = []
    for lang, content in dictionaries:
        d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append((lang, zs.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return tuple(out)


def classify(text: Column, model: LanguageModel, level: int = 6, short_level: int = 19, short_bytes: int = 400, narrow: float = 0.002, judged_bytes: int = 200, block_bytes: int = 65_536) -> Column:
    """A struct of lang, score, margin and rejected for each whole text.

    The language whose dictionary leaves the fewest compressed bytes wins; ties go to the language
    seen more often in training. ``score`` is the winner's share when each byte of difference
    halves a language's weight; ``margin`` is the difference to the second relative to its bytes.
    Texts are coded in blocks of ``block_bytes``, each against the dictionaries alone, and sizes are
    sums over the blocks: a long text would else become its own dictionary and its margin fall with length.
    Rejected: a null text, a text without letters (both ``und`` with score 0) and one of at least
    ``judged_bytes`` bytes whose margin is below ``narrow``. Shorter texts give too few bytes to
    judge a margin by. A model of no languages rejects all as ``und``.
    """
    dictionaries = model.dictionaries

    def run(texts: pa.Array) -> pa.Array:
        import regex

        letter = regex.compile(r"\p{L}")
        by_size = {short: _coders(dictionaries, at) for short, at in ((False, level), (True, short_level))}
        langs, scores, margins, rejects = [], [], [], []
        for scalar in texts:
            text = scalar.as_py()
            if not text or not dictionaries or not letter.search(text):
                best, score, margin, rejected = "und", 0.0, 0.0, True
            else:
                raw = text.lower().encode()
                blocks = [raw[i : i + block_bytes] for i in range(0, len(raw), block_bytes)]
                sizes = [(sum(len(c.compress(b)) for b in blocks), lang) for lang, c in by_size[len(raw) < short_bytes]]
                least, best = min(sizes, key=lambda x: x[0])
                score = 1 / sum(2.0 ** (least - size) for size, _ in sizes)
                second = sorted(s for s, _ in sizes)[1] if len(sizes) > 1 else least * 2
                margin = (second - least) / second
                rejected = len(raw) >= judged_bytes and margin < narrow
            langs.append(best)
            scores.append(score)
            margins.append(margin)
            rejects.append(rejected)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64()), pa.array(rejects, pa.bool_())], names=["lang", "score", "margin", "rejected"])

    # marked so, Spark never evaluates it twice where its fields are both filtered on and selected
    return F.arrow_udf(run, RESULT).asNondeterministic()(text)


def held_out(id_col: Column, parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % parts == part, F.lit(False))
