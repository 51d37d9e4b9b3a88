"""Line dedup by content-defined chunks of lines, grown to whole runs (operator 5); DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import materialize
from factloom.llm.graph import broadcast_if_small

MODULUS, BASE = 2_147_483_647, 31

# one-element arrays carry a value into the next lambda, computed once
once = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))


def line_chunks(text: Column, window: int = 2, divisor: int = 2, repeats: bool = False) -> Column:
    """The text's chunks in order: an array of struct(text, n_lines), as ``_placed_chunks`` cuts them."""
    return F.transform(_placed_chunks(text, window, divisor, repeats), lambda c: F.struct(c["text"].alias("text"), c["n_lines"].alias("n_lines")))


def _placed_chunks(text: Column, window: int, divisor: int, repeats: bool) -> Column:
    """Chunks in order: an array of struct(first, n_lines, text), first being the number of the chunk's first line from 0.

    Lines end at line feeds. A chunk ends after a line where the rolling hash of the last
    ``window`` line hashes (lines before the first count as 0) is a multiple of ``divisor``, so
    boundaries depend on the lines close by only, and reappear wherever a passage is moved to. With ``repeats`` one ends
    after a line that is the same as the one before it too, so that a line repeated many times is no single chunk. Chunks joined by line feeds are the text again; null gives null.
    """
    lines = F.split(text, "\n", -1)
    hashes = lambda ls: F.transform(ls, lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long") % MODULUS)
    power = [pow(BASE, j, MODULUS) for j in range(window)]

    def ends(hs: Column) -> Column:
        def rolling(i: Column) -> Column:
            total = F.lit(0).cast("long")
            for j in range(window):
                total = total + F.coalesce(F.get(hs, i - j), F.lit(0)) * F.lit(power[j]).cast("long") % MODULUS
            return total % MODULUS

        again = lambda i: F.coalesce(F.get(hs, i - 1) == F.get(hs, i - 2), F.lit(False)) if repeats else F.lit(False)
        return F.filter(F.sequence(F.lit(1), F.size(hs)), lambda i: (i == F.size(hs)) | (rolling(i - 1) % divisor == 0) | again(i))

    cut = lambda ls, es: F.transform(es, lambda e, i: once(F.coalesce(F.get(es, i - 1), F.lit(0)), lambda a: F.struct(a.alias("first"), (e - a).alias("n_lines"), F.array_join(F.slice(ls, a + 1, e - a), "\n").alias("text"))))
    return once(lines, lambda ls: once(hashes(ls), lambda hs: once(ends(hs), lambda es: cut(ls, es))))


def _units(chunks: Column) -> Column:
    """The chunks of several lines, and each chunk of one line with the chunk after it: struct(a, n, chunk, before, after), with the two chunks on either side."""

    def unit(c: Column, i: Column) -> Column:
        follows = F.get(chunks, i + 1)
        both = (c["n_lines"] == 1) & follows.isNotNull()
        text = F.when(both, F.concat(c["text"], F.lit("\n"), follows["text"])).otherwise(c["text"])
        pair = lambda near, far: F.concat_ws("\n", F.get(chunks, near)["text"], F.get(chunks, far)["text"])
        after = i + F.when(both, 2).otherwise(1)
        before = F.when(i > 0, pair(i - 2, i - 1))
        return F.struct(c["first"].alias("a"), (c["n_lines"] + F.when(both, follows["n_lines"]).otherwise(0)).alias("n"), text.alias("chunk"), before.alias("before"), F.when(after < F.size(chunks), pair(after, after + 1)).alias("after"))

    return F.transform(chunks, unit)


def ink(text: Column) -> Column:
    """Bytes that are no spaces, tabs or line ends; null has none."""
    return F.coalesce(F.octet_length(F.translate(text, " \t\n\r", "")), F.lit(0))


def _shared(a: Column, b: Column, from_end: bool) -> Column:
    """The lines that two texts share at their beginning or end, in their order; none if one is null."""
    cut = lambda c: F.reverse(F.split(c, "\n", -1)) if from_end else F.split(c, "\n", -1)
    turn = F.reverse if from_end else lambda c: c

    def of(x: Column) -> Column:
        differs = F.array_position(F.zip_with(x, cut(b), lambda p, q: p.eqNullSafe(q)), F.lit(False)).cast("int")
        return turn(F.slice(x, F.lit(1), F.when(differs > 0, differs - 1).otherwise(F.size(x))))

    return F.when(a.isNotNull() & b.isNotNull(), once(cut(a), of)).otherwise(F.array().cast("array<string>"))


def _interior(ranges: Column) -> Column:
    """Numbers of the pairs of neighbouring lines that lie in ranges of struct(a, n)."""
    return F.flatten(F.transform(ranges, lambda g: F.sequence(g["a"], g["a"] + g["n"] - 2)))


def _pairs(text: Column, without: Column) -> Column:
    """struct(i, pair) for each two neighbouring lines i and i + 1: SHA-256 of both; pairs numbered in ``without`` are left out."""

    def of(ls: Column) -> Column:
        at = F.when(F.size(ls) > 1, F.array_except(F.sequence(F.lit(0), F.size(ls) - 2), without)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(i.alias("i"), F.unhex(F.sha2(F.concat(F.get(ls, i), F.lit("\n"), F.get(ls, i + 1)), 256)).alias("pair")))

    return once(F.split(text, "\n", -1), of)


def _later_pairs(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """k, u, a, n = 2 of each pair of neighbouring lines outside of the runs that stands at a smaller k, u or line too.

    A pair within a run is no first place, so the first places of all pairs are among those that are looked at.
    """
    gone = runs.groupBy("k", "u").agg(F.collect_set(F.struct("a", "n")).alias("ranges"))  # within one document
    known = rows.join(broadcast_if_small(gone, 1_000_000, F.size("ranges") + 2), ["k", "u"], "left").withColumn("ranges", F.coalesce("ranges", F.array().cast("array<struct<a:int,n:int>>")))
    places = known.select("k", "u", F.explode(_pairs(F.col("t"), _interior(F.col("ranges")))).alias("p")).select("k", "u", "p.i", "p.pair")
    first = places.groupBy("pair").agg(F.min(F.struct("k", "u", "i")).alias("first"), F.count("*").alias("times")).where("times > 1").select("pair", "first")
    first = broadcast_if_small(materialize(first, "pairs"), 200_000)
    return places.join(first, "pair").where(F.struct("k", "u", "i") != F.col("first")).select("k", "u", F.col("i").alias("a"), F.lit(2).alias("n"))


def dedup_lines(docs: DataFrame, window: int = 2, divisor: int = 2, min_lines: int = 2, min_bytes: int = 0, pairs: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without later copies of repeated runs of lines, and array column ``chunks_cut``.

    Content-defined chunks of at least ``min_lines`` lines (a chunk of one line counts together with the next) choose the candidates: hash
    counts find those that stand anywhere else, then their bytes are compared, and the first place stays: that of the smallest document id,
    then of the smallest hash of the text, then of the earliest line. A later place grows line by line, while lines
    are equal in bytes to those around the first one, into the two chunks before and after it; what is equal beyond them holds
    repeated chunks itself. So matches reach the ends of the passage that they are in. A run of lines that are in matches goes
    if it has ``min_bytes`` bytes of ink (others than spaces and line ends), so that blank lines and closing braces, which repeat in most
    texts, stay. A repeated run that holds no whole chunk is found with ``pairs`` only: what the chunks left is then matched by
    pairs of neighbouring lines (SHA-256 of both), of each of which the first place stays, so that every later run of two lines or more is in
    matches. Runs may overlap their first place, so a repeating text keeps its first period. ``chunks_cut`` lists the runs that went, (text, n_lines).

    Rows of the same id and text are taken as the same document and treated alike, those of the
    same id and another text are other documents; rows of null id or text stay as they are (an
    empty array). All columns are kept (one named chunks_cut is replaced); an empty table gives no rows. Chunks
    are summed before they are shuffled, so that a passage which very many documents share costs a row a task;
    its places meet a written table of first places, in a join that Spark can split.
    """
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).where("k is not null and t is not null").withColumn("u", F.xxhash64("t"))
    chunks = once(_placed_chunks(F.col("t"), window, divisor, True), lambda cs: F.filter(_units(cs), lambda c: c["n"] >= min_lines))
    found = rows.select("k", "u", F.explode(chunks).alias("c"))
    places = found.select("k", "u", "c.*", F.xxhash64("c.chunk").alias("h"))

    several = materialize(places.groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h"), "several")
    candidates = places.join(broadcast_if_small(several), "h", "left_semi")
    first = candidates.groupBy("h", "chunk").agg(F.min(F.struct("k", "u", "a", "before", "after")).alias("first"), F.count("*").alias("times")).where("times > 1").select("h", "chunk", "first")
    first = broadcast_if_small(materialize(first, "chunks"), 1 << 24, F.octet_length("chunk") + F.coalesce(F.octet_length("first.before"), F.lit(0)) + F.coalesce(F.octet_length("first.after"), F.lit(0)) + 60)
    later = candidates.join(first, ["h", "chunk"]).where(F.struct("k", "u", "a") != F.struct("first.k", "first.u", "first.a"))
    grown = later.withColumns({"up": _shared(F.col("before"), F.col("first.before"), True), "down": _shared(F.col("after"), F.col("first.after"), False)})
    runs = grown.select("k", "u", (F.col("a") - F.size("up")).alias("a"), (F.col("n") + F.size("up") + F.size("down")).alias("n"))
    if pairs:
        runs = materialize(runs, "runs")
        runs = runs.unionByName(_later_pairs(rows, runs))
    cut = runs.groupBy("k", "u").agg(F.flatten(F.collect_set(F.sequence("a", F.col("a") + F.col("n") - 1))).alias("cut"))  # within one document
    cut = materialize(cut.select(F.col("k").alias("__k"), F.col("u").alias("__u"), F.array_sort(F.array_distinct("cut")).alias("__cut")), "cut")

    # texts of which nothing goes are not moved
    keyed = docs.drop("chunks_cut").withColumns({"__k": F.col(id_col), "__u": F.xxhash64(text_col)})
    hit = broadcast_if_small(cut.select("__k", "__u"))
    some = keyed.join(hit, ["__k", "__u"], "left_semi").join(cut, ["__k", "__u"])
    rest = keyed.join(hit, ["__k", "__u"], "left_anti").drop("__k", "__u").withColumn("chunks_cut", F.array().cast("array<struct<text:string,n_lines:int>>"))

    lines = lambda f: once(F.split(F.col(text_col), "\n", -1), f)
    at = lambda ls, numbers: F.array_join(F.transform(numbers, lambda j: F.get(ls, j)), "\n")
    edge = lambda step: F.filter("__cut", lambda j, i: ~F.get("__cut", i + step).eqNullSafe(j + step))
    begins, ends = edge(-1), edge(1)
    runs = lines(lambda ls: F.transform(F.arrays_zip(begins.alias("b"), ends.alias("e")), lambda r: F.struct(r["b"].alias("b"), r["e"].alias("e"), at(ls, F.sequence(r["b"], r["e"])).alias("text"))))
    some = some.withColumn("__runs", F.filter(runs, lambda r: ink(r["text"]) >= min_bytes))
    gone = F.flatten(F.transform("__runs", lambda r: F.sequence(r["b"], r["e"])))
    left = lines(lambda ls: at(ls, F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), gone)))
    listed = F.transform("__runs", lambda r: F.struct(r["text"].alias("text"), (r["e"] - r["b"] + 1).alias("n_lines")))
    some = some.withColumn("chunks_cut", listed).withColumn(text_col, left).select(*docs.drop("chunks_cut").columns, "chunks_cut")
    return rest.select(*some.columns).unionByName(some)
