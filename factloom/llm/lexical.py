"""Ranked lexical search: documents grouped by the mask of an item's terms that they hold (operator 12)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import materialize

#: Every byte that is no term character becomes a space, A-Z become a-z; bytes of other scripts are terms.
_TERM_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
POSTINGS = "doc_id long, n long, terms array<int>, tfs array<int>"
FOUND = "item long, doc_id long, score long, masks long, masks_read long"


def terms_of(text: str | None) -> list[bytes]:
    """The UTF-8 terms of a text: maximal runs of letters, digits and non-ASCII characters, A-Z lower-cased."""
    return (text or "").encode().translate(_TERM_BYTES).split()


def _postings(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """For each document with terms: its length n, and which of ``terms`` (by number) it holds how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(terms)}
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = terms_of(text.as_py())
                if found:
                    held, tfs = np.unique(np.array([number[t] for t in found if t in number], np.int32), return_counts=True)
                    rows.append((doc_id, len(found), held, tfs.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())))], names=["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, POSTINGS)


class MaskBlock:
    """A block of documents: for each term its documents and their parts of a score."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, total: int, total_terms: int):
        self.ids, self.m = ids, 10 + 90 * n * total // total_terms
        doc = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(terms, kind="stable")
        self.doc, self.tf, terms = doc[order], tfs[order].astype(np.int64), terms[order]
        self.names, starts = np.unique(terms, return_index=True)
        self.part = 1_000_000_000 * self.tf // (1000 * self.tf + 8 * self.m[self.doc])
        self.most_tf = np.maximum.reduceat(self.tf, starts) if len(starts) else starts
        self.span = dict(zip(self.names.tolist(), zip(range(len(starts)), starts.tolist(), [*starts[1:].tolist(), len(terms)])))

    def best(self, terms: list[int], weights: list[int], k: int) -> tuple[list[tuple[int, int]], int, int]:
        """The k best (score, place) of documents that score, how many masks there are, and how many were read.

        Bit i of a document's mask says whether it holds the item's i-th term. A mask's
        documents score at most the sum of its terms' parts for the term's largest count in the block and
        the mask's smallest m. Masks are read by falling bound, until k scores are above all bounds that are left.
        """
        held = [(w, *self.span[t]) for t, w in zip(terms, weights) if w > 0 and t in self.span]
        if not held:
            return [], 0, 0
        words = np.zeros((-(-len(held) // 63), len(self.ids)), np.int64)
        for i, (_, _, a, b) in enumerate(held):
            words[i // 63, self.doc[a:b]] |= np.int64(1) << np.int64(i % 63)
        code = np.zeros(len(self.ids), np.int64)
        for row in words:
            kinds, place = np.unique(row, return_inverse=True)
            code = np.unique(code * len(kinds) + place, return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.diff(code[order], prepend=-1))
        least_m, masks = np.minimum.reduceat(self.m[order], starts), words[:, order[starts]]
        bound = np.zeros(len(starts), np.int64)
        for i, (w, at, _, _) in enumerate(held):
            tf = self.most_tf[at]
            bound += np.where(masks[i // 63] >> np.int64(i % 63) & 1, w * (1_000_000_000 * tf // (1000 * tf + 8 * least_m)), 0)
        stops = np.append(starts[1:], len(order))
        score = np.zeros(len(self.ids), np.int64)
        scored = np.zeros(len(self.ids), bool)
        by_bound = np.argsort(-bound, kind="stable")
        by_bound = by_bound[bound[by_bound] > 0]
        best, read, step = np.zeros(0, np.int64), 0, 16
        while read < len(by_bound):
            if len(best) == k and bound[by_bound[read]] < score[best].min():
                break
            group = by_bound[read : read + step]  # the next masks together, then twice as many
            read, step = read + len(group), 2 * step
            rows = np.concatenate([order[starts[g] : stops[g]] for g in group])
            scored[rows] = True
            for w, _, a, b in held:
                of = self.doc[a:b]
                new = scored[of]
                score[of[new]] += w * self.part[a:b][new]
            scored[rows] = False
            rows = np.concatenate([best, rows[score[rows] > 0]])
            best = rows[np.lexsort((self.ids[rows], -score[rows]))[:k]]
        return [(int(score[r]), int(r)) for r in best], len(by_bound), read


def _search(postings: DataFrame, items: list[tuple[int, list[int]]], weights: list[int], total: int, total_terms: int, k: int, block: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= block:
                yield ranked(held)
                held, rows = [], 0
        if rows:
            yield ranked(held)

    def ranked(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        ids = table.column("doc_id").combine_chunks()
        lists = table.column("terms").combine_chunks()
        last = np.iinfo(np.int64).max  # a null id goes after all others
        docs = MaskBlock(ids.fill_null(last).to_numpy(), table.column("n").to_numpy(), lists.value_lengths().to_numpy(), lists.flatten().to_numpy(), table.column("tfs").combine_chunks().flatten().to_numpy(), total, total_terms)
        out = []
        for item, terms in items:
            found, masks, read = docs.best(terms, [weights[t] for t in terms], k)
            out += [(item, ids[place].as_py(), score, masks, read) for score, place in found]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(5)], names=["item", "doc_id", "score", "masks", "masks_read"])

    return postings.mapInArrow(run, FOUND)


def rank(docs: DataFrame, items: DataFrame, k: int = 10, items_at_once: int = 2048, block: int = 32_768, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The k best documents of each item by summed weights of shared terms: item, rank, doc_id, score, masks, masks_read.

    ``items`` is the stated set of queries; it is asked in blocks of ``items_at_once``, each held by the
    driver, all documents against each. Tasks keep ``block`` documents at a time, whose masks they group
    and read as in ``MaskBlock.best``, and give k rows an item, of which the last step takes the best;
    masks and masks_read tell how many masks the row's block had and how many were read.

    A document or item of null text has no terms; such documents don't count in N, such items have
    no rows, as have items of which no document scores. Equal items (id and text) are one, items of the same id and other texts
    are ranked each for itself. Repeated documents count and are ranked once each, a null doc_id after all others of
    its score. Other columns aren't read; empty tables give no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("item_text")).where("item_text is not null").distinct()
    shape = asked.schema["item_id"].dataType.simpleString()
    out, block_items, queries = None, [], asked.toLocalIterator()
    while True:
        block_items = [q for _, q in zip(range(items_at_once), queries)]
        if not block_items:
            break
        found = _rank_block(docs, [(q["item_id"], terms_of(q["item_text"])) for q in block_items], shape, k, block)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"item_id {shape}, rank int, doc_id long, score long, masks long, masks_read long")


def _rank_block(docs: DataFrame, items: list[tuple], shape: str, k: int, block: int) -> DataFrame:
    spark = docs.sparkSession
    terms = sorted({t for _, ts in items for t in ts})
    postings = materialize(_postings(docs, terms), "postings")
    total, total_terms = postings.agg(F.count("*"), F.sum("n")).first()
    df = dict(postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # at most the items' terms
    weights = [math.floor(1000 * math.log((2 * total + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(terms))]
    number = {t: i for i, t in enumerate(terms)}
    numbered = [(i, sorted({number[t] for t in ts})) for i, (_, ts) in enumerate(items)]
    found = _search(postings, numbered, weights, total, total_terms or 1, k, block)
    best = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = found.withColumn("rank", best).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(items)], f"item long, item_id {shape}")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score", "masks", "masks_read")
