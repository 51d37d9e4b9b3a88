"""Fill-in-middle transformation by indexable skip lists (operator 13)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUTS = "n long, prefix_chars long, middle_chars long"
MARKS = ("<P>", "<S>", "<M>")


class SkipList:
    """A text's units in order, under express lanes; each link carries its width in units and in code points.

    The text never changes, so every ``step``-th node of a lane reaches into the next one and no
    coin is tossed. The lowest lane's links are single units.
    """

    def __init__(self, text: str, step: int = 16):
        self.step = step
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        letter = ((points | 32) - np.uint32(97)) < 26
        first = np.ones(len(points), bool)
        first[1:] = ~(letter[1:] & letter[:-1])
        chars = np.diff(np.append(np.flatnonzero(first), len(points)))
        self.units, self.lanes = len(chars), [(np.ones(len(chars), np.int64), chars)]
        while len(self.lanes[-1][0]) > step:
            self.lanes.append(tuple(np.add.reduceat(widths, np.arange(0, len(widths), step)) for widths in self.lanes[-1]))

    def chars_before(self, rank: int) -> int:
        """Code points of the first ``rank`` units: along each lane while its links don't pass the rank, then down."""
        at, units, chars = 0, 0, 0
        for unit_widths, char_widths in reversed(self.lanes):
            while at < len(unit_widths) and units + unit_widths[at] <= rank:
                units += int(unit_widths[at])
                chars += int(char_widths[at])
                at += 1
            at *= self.step
        return chars


def cuts(text: Column, first: Column, second: Column) -> Column:
    """A struct of n (units ``[A-Za-z]+|[^A-Za-z]`` of the text), prefix_chars and middle_chars.

    ``first`` and ``second`` are whole numbers; modulo n + 1 they are the ranks of the two cuts.
    """

    def run(texts: pa.Array, firsts: pa.Array, seconds: pa.Array) -> pa.Array:
        rows = []
        for text, a, b in zip(texts, firsts.to_pylist(), seconds.to_pylist()):
            units = SkipList(text.as_py())
            a, b = sorted((a % (units.units + 1), b % (units.units + 1)))
            before = units.chars_before(a)
            rows.append((units.units, before, units.chars_before(b) - before))
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=[c.split()[0] for c in CUTS.split(", ")])

    # marked so, Spark never evaluates it twice where several of its fields are selected
    return F.arrow_udf(run, CUTS).asNondeterministic()(text, first, second)


def transform(docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as ``<P>prefix<S>suffix<M>middle`` (psm), ``<S>suffix<P>prefix<M>middle`` (spm) or itself (plain).

    Four numbers of the SHA-256 of ``seed:id`` decide the cuts, whether a text stays plain
    (``plain_from`` of 100 on) and whether it is spm. Returns doc_id, n, form, prefix_chars,
    middle_chars (null if plain) and output. A null text is empty; empty texts and those that contain
    a mark stay plain; a null id counts as an empty one; equal ids are cut by equal numbers, repeated rows come out once
    each; other columns aren't read; an empty table gives no rows. Needs no shuffle.
    """
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring("__key", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), key.alias("__key"))
    rows = rows.withColumn("cut", cuts(F.col("text"), h[0], h[1]))
    marked = F.contains("text", F.lit(MARKS[0])) | F.contains("text", F.lit(MARKS[1])) | F.contains("text", F.lit(MARKS[2]))
    form = F.when((F.col("text") == "") | marked | (h[2] % 100 >= plain_from), "plain").when(h[3] % 100 < spm_below, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "cut.*", form.alias("form"))
    prefix = F.substring("text", F.lit(1), F.col("prefix_chars").cast("int"))
    middle = F.substring("text", F.col("prefix_chars").cast("int") + 1, F.col("middle_chars").cast("int"))
    suffix = F.substring("text", (F.col("prefix_chars") + F.col("middle_chars")).cast("int") + 1, F.lit(2**31 - 1))
    p, s, m = map(F.lit, MARKS)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    shown = [F.when(F.col("form") != "plain", F.col(c)).alias(c) for c in ("prefix_chars", "middle_chars")]
    return rows.select("doc_id", "n", "form", *shown, output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that ``transform`` made ``output`` from: the first places of its marks are its own, since such a text has none."""
    body = F.substring(output, F.lit(4), F.lit(2**31 - 1))
    head = F.split(body, F.when(form == "psm", MARKS[1]).otherwise(MARKS[0]), 2)
    tail = F.split(head[1], MARKS[2], 2)
    return F.when(form == "plain", output).when(form == "psm", F.concat(head[0], tail[1], tail[0])).otherwise(F.concat(tail[0], tail[1], head[0]))
