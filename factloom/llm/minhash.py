"""Near-dedup by b-bit MinHash (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import materialize, words_of
from factloom.llm.graph import broadcast_if_small, components

BANDS, ROWS, BITS = 42, 6, 2
HASHES = BANDS * ROWS
SIGNATURE_LONGS = -(-HASHES * BITS // 64)


class _WordHashes(dict):
    """xxHash of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


def shingle_set(text: bytes, size: int, hashes: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes: of ``size`` words, or of all words if they are fewer."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    x = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        x = _mix(x + h[k : len(h) - n + 1 + k] + np.uint64(k + 1))
    return np.unique(x)


class Signer:
    """MinHash minima of a set; band keys and the packed low bits of the minima come from them."""

    def __init__(self) -> None:
        rng = np.random.Generator(np.random.PCG64(20240229))
        self.a = rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
        self.band = rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), 256):
            part = shingles[None, at : at + 256] * self.a[:, None]
            part += self.b[:, None]
            np.minimum(least, part.min(axis=1), out=least)
        return least

    def bands(self, minima: np.ndarray) -> np.ndarray:
        """One key for each band, which holds the band's number."""
        return _mix((_mix(minima.reshape(BANDS, ROWS)) * self.band).sum(axis=1) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)

    @staticmethod
    def packed(minima: np.ndarray) -> np.ndarray:
        """BITS bits of each minimum, BITS planes of whole bits in longs."""
        low = (minima >> np.uint64(20)).astype(np.uint8)
        bits = np.zeros(SIGNATURE_LONGS * 64, np.uint8)
        for k in range(BITS):
            bits[k::BITS][:HASHES] = (low >> k) & 1
        return np.packbits(bits).view(np.int64)


SIGNED = "doc_id long, n_shingles long, s1 long, s2 long, sig array<long>, bands array<long>"


def sign(rows: DataFrame, size: int) -> DataFrame:
    """(doc_id, text) to set size, an order-free 128-bit hash of the set, signature and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, signer = _WordHashes(), Signer()
        for batch in batches:
            ns, s1, s2, sigs, bands = [], [], [], [], []
            for text in batch.column(1).cast(pa.binary()):
                x = shingle_set(text.as_py() or b"", size, hashes)
                ns.append(len(x))
                s1.append(int(_mix(x).sum().view(np.int64)) if len(x) else 0)
                s2.append(int(_mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64)) if len(x) else 0)
                minima = signer.minima(x) if len(x) else None
                sigs.append(signer.packed(minima) if len(x) else [])
                bands.append(signer.bands(minima) if len(x) else [])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(sigs, longs), pa.array(bands, longs)], names=[c.split()[0] for c in SIGNED.split(", ")])
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, SIGNED)


def estimate(a: str, b: str):
    """Similarity from the low bits of the minima: with u the share of minima whose bits all agree,
    (u - 2^-BITS) / (1 - 2^-BITS), since unequal minima agree by chance that often."""
    agree = F.lit(0)
    for k in range(SIGNATURE_LONGS):
        x = F.get(F.col(a), F.lit(k)).bitwiseXOR(F.get(F.col(b), F.lit(k)))
        either = x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        agree = agree + F.bit_count(either)
    u = F.lit(1.0) - agree / float(HASHES)
    chance = 2.0**-BITS
    return (u - chance) / (1 - chance)


def _may_link(threshold: int, slack: float):
    """Sizes and signatures that leave a similarity of threshold % possible."""
    sizes = F.least("x.n_shingles", "y.n_shingles") * 100 >= F.greatest("x.n_shingles", "y.n_shingles") * threshold
    return sizes & (estimate("x.sig", "y.sig") >= threshold / 100 - slack)


SKETCH = 400


def sketches(rows: DataFrame, size: int) -> DataFrame:
    """(doc_id, text) to the SKETCH smallest 32-bit shingle hashes; ``top`` is null if they are all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            parts = []
            for text in batch.column(1).cast(pa.binary()):
                x = shingle_set(text.as_py(), size, hashes)
                parts.append(np.unique(((x >> np.uint64(32)).astype(np.int64) - (1 << 31)).astype(np.int32)))
            tops = [int(x[SKETCH - 1]) if len(x) > SKETCH else None for x in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[:SKETCH] for x in parts], pa.list_(pa.int32())), pa.array(tops, pa.int32())], names=["doc_id", "sketch", "top"])

    return rows.mapInArrow(run, "doc_id long, sketch array<int>, top int")


def _sketches_link(threshold: int, slack: float):
    """Whether the sketches leave a similarity of threshold % possible. If both hold all shingles, nothing is
    estimated; else both are compared up to the smaller top, where they are whole."""
    both = F.size(F.array_intersect("x.sketch", "y.sketch"))
    whole = both * 100 >= (F.size("x.sketch") + F.size("y.sketch") - both) * threshold
    top = F.least("x.top", "y.top")
    a, b = (F.filter(c, lambda v: v <= top) for c in ("x.sketch", "y.sketch"))
    some = F.size(F.array_intersect(a, b))
    return F.when(top.isNull(), whole).otherwise(some * 100 >= (F.size(a) + F.size(b) - some) * (threshold - 100 * slack))


def verify(pairs: DataFrame, texts: DataFrame, size: int, threshold: int) -> DataFrame:
    """The (u, v) of pairs whose whole shingle sets have 100 * |both| >= threshold * |either|."""
    ids = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    some = texts.join(broadcast_if_small(ids), "doc_id", "left_semi")
    met = pairs.join(some.select(F.col("doc_id").alias("u"), F.col("text").alias("u_text")), "u").join(some.select(F.col("doc_id").alias("v"), F.col("text").alias("v_text")), "v").select("u", "v", "u_text", "v_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, held = _WordHashes(), None, None
        for batch in batches:
            good = []
            for i in range(batch.num_rows):
                x = shingle_set(batch.column(2)[i].as_buffer().to_pybytes(), size, hashes)
                v_text = batch.column(3)[i].as_buffer().to_pybytes()
                if v_text != last:
                    last, held = v_text, shingle_set(v_text, size, hashes)
                at = np.searchsorted(held, x)
                both = int((held[np.minimum(at, len(held) - 1)] == x).sum()) if len(held) else 0
                good.append(100 * both >= threshold * (len(x) + len(held) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))
        pa.default_memory_pool().release_unused()

    return met.mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, threshold: int = 80, slack: float = 0.15, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked where 100 * |both| >= threshold * |either| for their sets of ``size``-word
    shingles (A-Z lower-cased; a shorter text is one shingle; one without words is linked with
    nothing). component_id is the smallest id reachable, kept tells whether that is the row's own.
    Null ids stay unlinked with a null component and are kept; rows of the same id are one
    document; other columns are not read; an empty table gives no rows.

    Equal sets are one class from the start. 42 bands of 6 minima give candidates: a pair at 0.8
    is missed in all with a chance of 3 in a million. In each band's bucket, members first meet two hubs; then the
    members outside of the bucket's largest component meet the others of other components. So a
    bucket of n copies costs O(n) pairs, and none that could join two components is left out. A
    candidate goes on if its b-bit estimate is above threshold - slack (five standard deviations)
    and, among the last ones, if sketches of up to 400 shingles allow it; it counts if the whole sets agree.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialize(sign(rows, size), "signed")
    with_set = signed.where("doc_id is not null and n_shingles > 0")
    classes = materialize(with_set.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = with_set.join(classes.select(F.col("rep").alias("doc_id"), "s1", "s2"), ["doc_id", "s1", "s2"], "left_semi").dropDuplicates(["doc_id", "s1", "s2"]).select("doc_id", "n_shingles", "sig", "bands")
    slim = reps.select("doc_id", F.explode("bands").alias("key"))
    shared = slim.groupBy("key").agg(F.min("doc_id").alias("hub1"), F.min_by("doc_id", F.xxhash64("doc_id")).alias("hub2"), F.max("doc_id").alias("top")).where("hub1 <> top")
    members = materialize(slim.join(shared.drop("top"), "key").select("key", "doc_id", "hub1", "hub2"), "members")

    texts = rows.where("doc_id is not null and text is not null")
    marks = materialize(reps.select("doc_id", "n_shingles", "sig").join(broadcast_if_small(members.select("doc_id").distinct()), "doc_id", "left_semi"), "marks")

    def confirmed(pairs: DataFrame, label: str) -> DataFrame:
        x, y = marks.alias("x"), marks.alias("y")
        likely = pairs.join(x, F.col("u") == F.col("x.doc_id")).join(y, (F.col("v") == F.col("y.doc_id")) & _may_link(threshold, slack))
        return materialize(verify(materialize(likely.select("u", "v"), label), texts, size, threshold), label)

    hubs = members.select(F.explode(F.array_distinct(F.array("hub1", "hub2"))).alias("v"), F.col("doc_id").alias("u")).where("u <> v").distinct()
    links = confirmed(hubs, "hubs")
    found = components(links)

    of = members.select("key", "doc_id").join(found.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    sizes = of.groupBy("key", "root").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1").select("key", "most")
    still = materialize(of.join(largest, "key"), "still")
    sketched = sketches(texts.join(broadcast_if_small(still.select("doc_id").distinct()), "doc_id", "left_semi"), size)
    still = materialize(still.join(marks, "doc_id").join(sketched, "doc_id"), "still")
    x, y = still.where("root <> most").alias("x"), still.alias("y")
    cross = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & _may_link(threshold, slack) & _sketches_link(threshold, 0.09)
    rest = x.join(y, cross).select(F.least("x.doc_id", "y.doc_id").alias("u"), F.greatest("x.doc_id", "y.doc_id").alias("v")).distinct()
    more = materialize(rest, "rest")
    if not more.isEmpty():
        links = links.unionByName(materialize(verify(more, texts, size, threshold), "links"))
        found = components(links)

    roots = classes.join(found, classes["rep"] == found["node"], "left").select("s1", "s2", F.coalesce("root", "rep").alias("root"))
    out = signed.select("doc_id", "n_shingles", "s1", "s2").join(roots, ["s1", "s2"], "left")
    root = F.when(F.col("n_shingles") > 0, F.col("root"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce(root, "doc_id")).alias("component_id"), F.coalesce(F.coalesce(root, "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one row left of each group of near-duplicates: that of the smallest id.

    Repeated rows of one id and text leave one row. Rows of one id and different texts are different
    documents: all but one of these are known by a large number made from id and text, so that they give way to
    other ids. Rows of null id all stay, rows without words go only as repeated rows; columns are kept as they are; an empty table gives no rows.
    """
    key = F.xxhash64(text_col)
    clash = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(key).alias("__first"), F.max(key).alias("__last")).where("__first <> __last").select("__id", "__first")
    clash = broadcast_if_small(materialize(clash, "clash"))
    own = F.col(id_col).cast("long")
    other = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(id_col, key), 2)
    known = docs.join(clash, docs[id_col] == F.col("__id"), "left").withColumn("__node", F.when(F.col("__first").isNull() | (key == F.col("__first")), own).otherwise(other)).drop("__id", "__first")
    gone = near_duplicates(known, id_col="__node", text_col=text_col, **how).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    left = known.join(broadcast_if_small(gone), F.col("__node") == F.col("__gone"), "left_anti")
    again = left.where("__node is not null").groupBy(F.col("__node").alias("__again")).agg(F.count("*").alias("__n")).where("__n > 1").select("__again")
    again = broadcast_if_small(materialize(again, "again"))
    if again.isEmpty():
        return left.select(*docs.columns)
    rank = F.row_number().over(Window.partitionBy("__node").orderBy(*[F.col(c) for c in docs.columns if c != id_col]))
    one = left.join(again, F.col("__node") == F.col("__again")).withColumn("__r", rank).where("__r = 1")
    return left.join(again, F.col("__node") == F.col("__again"), "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))
