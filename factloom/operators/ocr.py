"""Recognised pages: nested blocks flattened to spans in reading order, and tables found from where cells stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import once
from factloom.operators.geometry import conf_parts, mean4

#: A page's blocks and tables as ``flatten_pages`` takes them.
PAGE = """array<struct<block_id:string,confidence:double,lines:array<struct<line_id:string,words:array<struct<word_id:string,text:string,confidence:double>>>>>>"""
CELLS = "array<struct<table_id:string,row:int,col:int,text:string,confidence:double>>"


def _mean(words: Column, otherwise: Column) -> Column:
    total = F.aggregate(words, F.lit(0).cast("long"), lambda s, w: s + conf_parts(w["confidence"]))
    return F.when(F.size(words) > 0, mean4(total, F.size(words))).otherwise(otherwise)


def flatten_pages(pages: DataFrame) -> DataFrame:
    """doc_id, page, n, kind, text, confidence, block_id, line_id, word_ids, table_id, row, col for each span of a page.

    A block comes before its lines, a line before its words, and the cells of the page's tables come last; n counts them from 0.
    Blocks without lines and spans of blank text are left out, what is in a blank line too. A line's text is its words with spaces between, a
    block's its lines with line feeds between; the confidence of either is the mean of its words', or the block's own if it has none.
    pages(doc_id, page, blocks, cells) hold PAGE and CELLS; null arrays are empty. A page is one row, so nothing is shuffled.
    """
    none = lambda kind: F.lit(None).cast(kind)

    def span(kind: str, text: Column, confidence: Column, **at: Column) -> Column:
        own = {"block_id": none("string"), "line_id": none("string"), "word_ids": none("array<string>"), "table_id": none("string"), "row": none("int"), "col": none("int")} | at
        return F.struct(F.lit(kind).alias("kind"), F.trim(text).alias("text"), confidence.cast("double").alias("confidence"), *[c.alias(k) for k, c in own.items()])

    ids = lambda words: F.transform(words, lambda w: w["word_id"])
    line_text = lambda x: F.array_join(F.transform(x["words"], lambda w: w["text"]), " ")
    shown = lambda spans: F.filter(spans, lambda s: s["text"] != "")

    def of_line(block: Column, line: Column) -> Column:
        words = F.transform(line["words"], lambda w: span("word", w["text"], w["confidence"], block_id=block["block_id"], line_id=line["line_id"], word_ids=F.array(w["word_id"])))
        head = lambda text: span("line", text, _mean(line["words"], F.lit(0.0)), block_id=block["block_id"], line_id=line["line_id"], word_ids=ids(line["words"]))
        return once(line_text(line), lambda text: F.when(F.trim(text) != "", F.concat(F.array(head(text)), shown(words))).otherwise(F.slice(F.array(head(text)), 1, 0)))

    def of_block(block: Column) -> Column:
        words = F.flatten(F.transform(block["lines"], lambda x: x["words"]))
        joined = F.array_join(F.transform(block["lines"], line_text), "\n")
        head = lambda text: span("block", text, _mean(words, block["confidence"]), block_id=block["block_id"], line_id=block["lines"][0]["line_id"], word_ids=ids(words))
        inner = F.flatten(F.transform(block["lines"], lambda x: of_line(block, x)))
        return once(joined, lambda text: F.when(F.trim(F.replace(text, F.lit("\n"), F.lit(" "))) != "", F.concat(F.array(head(text)), inner)).otherwise(F.slice(F.array(head(text)), 1, 0)))

    blocks = F.filter(F.coalesce("blocks", F.from_json(F.lit("[]"), PAGE)), lambda b: F.size(b["lines"]) > 0)
    cells = F.transform(F.coalesce("cells", F.from_json(F.lit("[]"), CELLS)), lambda c: span("table_cell", c["text"], c["confidence"], table_id=c["table_id"], row=c["row"], col=c["col"]))
    spans = F.concat(F.flatten(F.transform(blocks, of_block)), shown(cells))
    return pages.select("doc_id", "page", F.posexplode(spans).alias("n", "s")).select("doc_id", "page", "n", "s.*")


def _islands(rows: DataFrame, keys: list[str], start: Column, end: Column, name: str) -> DataFrame:
    """Adds the number from 0 of the island that an interval belongs to: intervals that overlap, or reach each other over others, are one."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = rows.withColumn("__new", F.when(start > reach, 1).otherwise(0))
    return opened.withColumn(name, F.sum("__new").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")).drop("__new")


def table_cells(boxes: DataFrame, page: list[str] = ["doc_id", "page"]) -> DataFrame:  # noqa: B006
    """Cells of the table that a page's boxes form: the page, row, col, text and confidence of each.

    Rows are the islands of the boxes' extents along y, columns those along x over all of the page's rows; boxes of the same
    row and column are one cell, its texts in the order of x, its confidence their mean. Boxes need x, y, width, height, text, confidence; those with a
    null among x, y, width and height are left out. A page is one window's group.
    """
    known = boxes.where("x is not null and y is not null and width is not null and height is not null")
    rows = _islands(known, page, F.col("y"), F.col("y") + F.col("height"), "row")
    both = _islands(rows, page, F.col("x"), F.col("x") + F.col("width"), "col")
    parts = F.sort_array(F.collect_list(F.struct("x", "y", F.coalesce("text", F.lit("")).alias("text"))))
    cells = both.groupBy(*page, "row", "col").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"), mean4(F.sum(conf_parts(F.col("confidence"))), F.count("confidence")).alias("confidence"))
    return cells


def table_stats(cells: DataFrame, page: list[str] = ["doc_id", "page"]) -> DataFrame:  # noqa: B006
    """Rows, columns (the most cells of a row), cells, the mean of the rows' mean confidences, whether it is sure (0.8 or more) or poor (below 0.5)."""
    rows = cells.groupBy(*page, "row").agg(F.count("*").alias("n"), mean4(F.sum(conf_parts(F.col("confidence"))), F.count("confidence")).alias("c"))
    stats = rows.groupBy(*page).agg(F.count("*").alias("n_rows"), F.max("n").alias("n_columns"), F.sum("n").alias("n_cells"), mean4(F.sum(conf_parts(F.col("c"))), F.count("c")).alias("mean_confidence"))
    return stats.withColumns({"sure": F.col("mean_confidence") >= 0.8, "poor": F.col("mean_confidence") < 0.5})


def cell_at(cells: DataFrame, wanted: DataFrame, page: list[str] = ["doc_id", "page"]) -> DataFrame:  # noqa: B006
    """The text at each wanted row and col; null where the table has no such cell."""
    return wanted.join(cells.select(*page, "row", "col", "text"), [*page, "row", "col"], "left")
