"""Document fingerprints from prefix polynomial hashes (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODULI = ((2_147_483_647, 1_000_003), (2_147_483_629, 69_069))
_powers: list[np.ndarray] = [np.ones(1, np.uint64) for _ in MODULI]


def powers(k: int, n: int) -> np.ndarray:
    """At least n+1 powers of the k-th base, kept between calls."""
    mod, base = MODULI[k]
    while len(_powers[k]) <= n:
        have = _powers[k]
        step = np.uint64(pow(base, len(have), mod))
        _powers[k] = np.concatenate([have, have * step % np.uint64(mod)])
    return _powers[k]


class PrefixHash:
    """Prefix arrays of a text: any span's hash in constant time, common extensions by binary search."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        self.n, self.prefix = len(points), []
        for k, (mod, _) in enumerate(MODULI):
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(points * powers(k, self.n)[: self.n] % np.uint64(mod), out=sums[1:])
            self.prefix.append(sums % np.uint64(mod))

    def equal(self, a: int, other: PrefixHash, b: int, length: int) -> bool:
        """Whether length code points from a here are those from b there."""
        for k, (mod, _) in enumerate(MODULI):
            mine = int(self.prefix[k][a + length]) - int(self.prefix[k][a])
            its = int(other.prefix[k][b + length]) - int(other.prefix[k][b])
            shift = int(powers(k, abs(a - b))[abs(a - b)])
            if a >= b:
                its *= shift
            else:
                mine *= shift
            if (mine - its) % mod:
                return False
        return True

    def _longest(self, most: int, same) -> int:
        low, high = 0, most
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if same(mid) else (low, mid - 1)
        return low

    def forward(self, a: int, other: PrefixHash, b: int) -> int:
        """Longest common extension to the right of a here and b there."""
        return self._longest(min(self.n - a, other.n - b), lambda n: self.equal(a, other, b, n))

    def backward(self, a: int, other: PrefixHash, b: int) -> int:
        """Longest common extension to the left of a here and b there."""
        return self._longest(min(a, b), lambda n: self.equal(a - n, other, b - n, n))

    def likeness(self, other: PrefixHash) -> float:
        """Code points in the common prefix and suffix, which may not overlap, of the longer text's."""
        longest, least = max(self.n, other.n), min(self.n, other.n)
        if not longest:
            return 1.0
        head = self.forward(0, other, 0)
        return min(least, head + self.backward(self.n, other, other.n)) / longest

    def fingerprint(self) -> str:
        return f"{self.n:x}-" + "".join(f"{int(p[-1]):08x}" for p in self.prefix)


def range_bounds(keys: DataFrame, rows_each: int, most: int) -> list[tuple[int, int]]:
    """(sid, h) keys at which ranges start, in descending sid and ascending h; the first is the first of all.

    A draw by a hash of the distinct keys, of about one key for ``rows_each`` rows and ``most`` at
    most in the mean: the driver never gathers more. No keys give no bounds.
    """
    n, first = keys.agg(F.count("*"), F.min(F.struct(F.bitwise_not("sid").alias("sid"), "h"))).first()
    if not n:
        return []
    span = 1 << 40
    below = int(span * min(1 / rows_each, most / n))
    drawn = keys.where(F.pmod(F.xxhash64("sid", "h"), F.lit(span)) < below).distinct().collect()
    return sorted({(r["sid"], r["h"]) for r in drawn} | {(~first["sid"], first["h"])}, key=lambda k: (-k[0], k[1]))


FINGERPRINTS = "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
DEALT = "doc_id long, text string, times long, sid long, h long, bucket int, extra int"


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[f for f, _ in fields])


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: int = 3, rows_each: int = 64, most_ranges: int = 65_536) -> DataFrame:
    """Fingerprints of each whole text, of its edited text, and how alike they and the next text are.

    The next document is the one that follows in descending id order (after the last: the first;
    rows with the same id follow in order of their texts' xxHash; null ids come last). The edited text has
    its last floor(n/cut) code points replaced by as many of the next document's first (or all).
    Null text is empty; two empty texts have likeness 1. Every row gives one row; other columns
    are not read; an empty table gives no rows.

    Rows are dealt by ranges of that order, which start at keys drawn from the rows (one for
    ``rows_each`` rows, ``most_ranges`` at most in the mean), so that neither null nor far ids make a range large.
    A row at which a range starts knows so by its own key and goes to the range before as well: each text is
    shuffled once, and the first of each range twice. Equal rows are counted before they are
    shuffled.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # null ids follow the least one; each id keeps its own place in the order
    least = rows.agg(F.min("doc_id").alias("m")).first()["m"]
    h, sid = F.xxhash64("text"), F.coalesce("doc_id", F.lit(max((least if least is not None else 0) - 1, -(1 << 63))))
    rows = rows.select("doc_id", "text", sid.alias("sid"), h.alias("h"))
    bounds = range_bounds(rows.select("sid", "h"), rows_each, most_ranges)
    starts = np.array([(~s, k) for s, k in bounds], [("sid", "<i8"), ("h", "<i8")])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.empty(batch.num_rows, starts.dtype)
            keys["sid"], keys["h"] = ~batch.column(2).to_numpy(), batch.column(3).to_numpy()
            one, at, times = np.unique(keys, return_index=True, return_counts=True)
            # a structured search would be slow: ranks among the bounds and these keys
            order = np.lexsort((np.r_[np.zeros(len(starts), np.int8), np.ones(len(one), np.int8)], np.r_[starts["h"], one["h"]], np.r_[starts["sid"], one["sid"]]))
            seen = np.cumsum(order < len(starts))
            rank = np.empty(len(order), np.int64)
            rank[order] = seen
            bucket = rank[len(starts) :] - 1
            head = starts[bucket] == one
            all_at, all_times = np.r_[at, at[head]], np.r_[times, times[head]]
            bucket = np.r_[bucket, (bucket[head] - 1) % len(starts)].astype(np.int32)
            extra = np.r_[np.zeros(len(at), np.int32), np.ones(int(head.sum()), np.int32)]
            for i in range(0, len(all_at), 2000):
                part = pa.array(all_at[i : i + 2000])
                yield _batch([batch.column(0).take(part), batch.column(1).take(part), all_times[i : i + 2000], batch.column(2).take(part), batch.column(3).take(part), bucket[i : i + 2000], extra[i : i + 2000]], DEALT)

    dealt = rows.mapInArrow(deal, DEALT).repartition("bucket").sortWithinPartitions("bucket", "extra", F.desc("sid"), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (doc_id, text, times, bucket, extra, hashes) of the row that waits for its next one
        for batch in batches:
            out, size = [], 0
            for at in range(batch.num_rows):
                doc_id, text, times, bucket, extra = (batch.column(k)[at].as_py() for k in (0, 1, 2, 5, 6))
                if held and held[4] and extra and held[3] == bucket:
                    continue  # a range's start, from several tasks
                hashes = PrefixHash(text)
                if held and not held[4]:
                    for row, n in ((_compared(held, held[1], held[5], cut), held[2] - 1), (_compared(held, text, hashes, cut), 1)) if held[2] > 1 else ((_compared(held, text, hashes, cut), 1),):
                        for _ in range(n):
                            out.append(row)
                            size += len(row[2])
                            if size > 1 << 22:
                                yield _batch(list(zip(*out)), FINGERPRINTS)
                                out, size = [], 0
                held = (doc_id, text, times, bucket, extra, hashes)
            if out:
                yield _batch(list(zip(*out)), FINGERPRINTS)

    return dealt.mapInArrow(run, FINGERPRINTS)


def _compared(row: tuple, after: str, after_hashes: PrefixHash, cut: int) -> tuple:
    """The result for a row (doc_id, text, .., hashes) that ``after`` follows."""
    doc_id, text, hashes = row[0], row[1], row[5]
    n = len(text) // cut
    edited = text[: len(text) - n] + after[:n]
    its = PrefixHash(edited)
    return doc_id, len(text), edited, hashes.fingerprint(), its.fingerprint(), hashes.likeness(its), hashes.likeness(after_hashes)
