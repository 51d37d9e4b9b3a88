"""Text normalisation as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def folded(low: Column) -> Column:
    """A text in small letters with those that patterns which ignore case take for others: a long s is an s, a dotless i an i."""
    for a, b in (("ſ", "s"), ("ı", "i"), ("i\u0307", "i")):
        low = F.replace(low, F.lit(a), F.lit(b))
    return low


def holds(low: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, [low.contains(w) for w in words])


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def display(c: Column) -> Column:
    """Squeezed, without spaces and punctuation at the ends."""
    return F.trim(F.btrim(F.regexp_replace(c, r"\s+", " "), F.lit(" \t:;,.|")))


def straight_text(c: Column) -> Column:
    """Line feeds for all line breaks, straight quotes, single spaces, nothing at the ends."""
    out = F.regexp_replace(c, "\r\n?", "\n")
    for a, b in (("’", "'"), ("‘", "'"), ("“", '"'), ("”", '"')):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.btrim(F.regexp_replace(out, "[ \t]+", " "), F.lit(" \n"))


def squeeze_lines(c: Column) -> Column:
    """Single spaces, at most one empty line in a row, nothing at the ends."""
    return F.btrim(F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), "\n{3,}", "\n\n"), F.lit(" \n"))


def normalize_key(c: Column) -> Column:
    """Lower case, dashes and spaces to one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[-\s_]+", "_"), "^_+|_+$", "")


def normalize_text(c: Column) -> Column:
    """Lower case, German letters spelled out, punctuation to spaces."""
    out = F.lower(c)
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return squeeze(F.regexp_replace(out, r"[_\-:;,.()\[\]{}©]+", " "))


def normalized_label(label: str) -> str:
    """A label as normalize_text leaves it."""
    return " ".join(label.replace("-", " ").lower().split())


def normalize_value(fact_type: Column, c: Column) -> Column:
    """Identifiers in upper case without spaces, others squeezed."""
    codes = ("iban", "bic", "passport_number", "document_number", "mrz_line")
    return F.when(fact_type.isin(*codes), F.upper(F.regexp_replace(c, r"\s+", ""))).otherwise(squeeze(c))


def clean_lines(c: Column) -> Column:
    """Non-empty lines without links, squeezed, as an array."""
    lines = F.transform(F.split(F.replace(c, F.lit("\r\n"), F.lit("\n")), "\n"), squeeze)
    return F.filter(lines, lambda x: (x != "") & ~F.lower(x).rlike(r"https?://|www\."))


def vowelless(c: Column) -> Column:
    """At least seven letters from a to z and no a, e, i, o, u among them: what is left of bad OCR."""
    letters = F.regexp_replace(c, "[^A-Za-z]", "")
    return (F.length(letters) >= 7) & ~letters.rlike("[aeiouAEIOU]")


def ocr_repair_digits(c: Column) -> Column:
    return F.translate(c, "OIBSGZQ", "0185620")


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence: a column of the table is the bits of one whole number."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    all_bits = row = (1 << len(a)) - 1
    for ch in b:
        hit = row & places.get(ch, 0)
        row = (row + hit | row - hit) & all_bits
    return len(a) - row.bit_count()


def lcs_ratio(a: Column, b: Column) -> Column:
    """2 * LCS / (len a + len b) on lower case; 1 if equal, 0 if one is empty, null if one is null."""

    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        out: list[float | None] = []
        for x, y in zip(left.to_pylist(), right.to_pylist()):
            if x is None or y is None:
                out.append(None)
                continue
            x, y = x.lower(), y.lower()
            out.append(1.0 if x == y else 2 * _lcs(x, y) / (len(x) + len(y)) if x and y else 0.0)
        return pa.array(out, pa.float64())

    return F.arrow_udf(run, "double")(a, b)
