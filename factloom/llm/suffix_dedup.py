"""Suffix-array dedup with longest-previous-factor arrays (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import in_parts, materialize
from factloom.llm.graph import broadcast_if_small

GRAM = 96  # bytes of an anchor
WIDE = 64  # window starts of a segment: they share length - WIDE + 1 bytes
WORD_GRAM = 8  # words of an anchor
PRIME = 0x100000001B3 | 1
NO_ID = -(1 << 63)
SMALL = 300_000  # rows of a hash that may be broadcast
PART = 1 << 17  # bytes of texts that are looked at together; their hashes stay in a core's cache


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _least(h: np.ndarray, wide: int, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The least of each ``wide`` neighbouring hashes that are ``inside`` one text, the leftmost of equals, as runs: key, place, first and last."""
    low, have = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), 1
    while have * 2 <= wide:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if wide > have:
        low = np.minimum(low[: len(low) - (wide - have)], low[wide - have :])
    window = np.flatnonzero(inside)
    place = (low[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero(np.diff(place, prepend=-1))  # texts have no place in common
    return h[place[cut]].view(np.int64), place[cut], window[cut], window[np.append(cut[1:], len(window))[: len(cut)] - 1]


def joined(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Texts with a space between them, where each starts, and their sizes."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return b" ".join(texts), np.cumsum(sizes + 1) - sizes - 1, sizes


def anchors(text: np.ndarray, base: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The anchor of each window of ``length`` bytes of each of the joined texts, as runs of windows: text, key, place, first and last window.

    A window's anchor is its gram of least hash, the leftmost of equals: equal windows have equal
    anchors at equal places in them.
    """
    held = sizes >= length
    if not held.any():
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    step = np.zeros(len(text) - length + 2, np.int8)
    step[base[held]] = 1
    step[base[held] + sizes[held] - length + 1] = -1
    inside = np.cumsum(step[:-1], dtype=np.int8) > 0
    x = text.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        power, size, halves = PRIME, 1, {1: x}
        while size < 64:
            x = x[:-size] * np.uint64(power) + x[size:]
            power, size = power * power % (1 << 64), size * 2
            halves[size] = x
        # GRAM is 64 and then 32 bytes
        p32 = pow(PRIME, 32, 1 << 64)
        n = len(text) - GRAM + 1
        h = _mixed(halves[64][:n] * np.uint64(p32) + halves[32][64 : 64 + n])
    key, *at = _least(h, length - GRAM + 1, inside)
    owner = np.searchsorted(base, at[1], "right") - 1
    return owner, key, *(v - base[owner] for v in at)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n powers of PRIME and of its inverse modulo 2^64, kept between calls."""
    for k, base in enumerate((PRIME, pow(PRIME, -1, 1 << 64))):
        while len(_powers[k]) < n:
            with np.errstate(over="ignore"):
                _powers[k] = np.concatenate([_powers[k], _powers[k] * np.uint64(pow(base, len(_powers[k]), 1 << 64))])
    return _powers[0][:n], _powers[1][:n]


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end], from one array of prefix sums."""
    up, down = _powers_to(len(values) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:-1])])
        return _mixed((sums[ends] - sums[starts]) * down[starts])


def word_hashes(text: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text of each word ``[^\\x20\\x09-\\x0D]+`` of joined texts, and its hash."""
    inside = np.concatenate([[False], (text != 32) & ((text < 9) | (text > 13)), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return np.searchsorted(base, edges[::2], "right") - 1, _spans(text.astype(np.uint64) + np.uint64(1), edges[::2], edges[1::2])


def word_anchors(text: np.ndarray, base: np.ndarray, words: int) -> tuple[np.ndarray, ...]:
    """As ``anchors``, of windows of ``words`` words, whatever white space is between them."""
    owner, hashes = word_hashes(text, base)
    if len(hashes) < words:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    at = np.arange(len(hashes) + 1)
    grams = _spans(hashes, at[: -WORD_GRAM], at[WORD_GRAM:])
    key, *found = _least(grams, words - WORD_GRAM + 1, owner[: len(owner) - words + 1] == owner[words - 1 :])
    text_of = owner[found[1]]
    before = np.searchsorted(owner, np.arange(len(base)))
    return text_of, key, *(v - before[text_of] for v in found)


def _ranks(joined: np.ndarray, length: int) -> dict[int, np.ndarray]:
    """For 8, 16, .. and ``length`` bytes: the rank of every position's next bytes, by prefix doubling."""
    n = len(joined)
    padded = np.concatenate([joined, np.zeros(8, np.uint8)]).astype(np.uint64)
    eight = np.zeros(n, np.uint64)
    for k in range(8):
        eight = (eight << np.uint64(8)) | padded[k : k + n]
    size, out = 8, {8: np.unique(eight, return_inverse=True)[1].astype(np.int64)}
    while size < length:
        step = min(size, length - size)
        after = np.zeros(n, np.int64)
        after[: n - step] = out[size][step:] + 1
        out[size + step] = np.unique(out[size] * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
        size += step
    return out


def longest_previous(places: list, common: list[int]) -> list[int]:
    """The longest previous factor of each suffix, in suffix order.

    ``places`` are the suffixes' places in the corpus and ``common[i]`` is the longest common
    prefix of suffixes i - 1 and i. The longest earlier match of a suffix is the one with its
    previous or its next smaller place in suffix order; both are met by one pass over a stack of
    places that rise.
    """
    out, stack = [0] * len(places), []
    for i, place in enumerate(places):
        low = common[i]
        while stack and places[stack[-1][0]] > place:
            j, below = stack.pop()
            out[j] = max(out[j], low)  # i is the next smaller place of j
            low = min(low, below)
        if stack:
            out[i] = low  # the previous smaller place of i
        stack.append((i, low))
    return out


def repeats(contents: list[bytes], counts: list[int], places: list[tuple], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For contents whose first ``count`` windows of ``length`` bytes are asked for (64 at most), bits of the
    windows that stand anywhere else in these contents, and of those that stand at an earlier place.

    The contents are joined and their windows put into suffix order, with the longest common
    prefixes of neighbours; a window has an earlier match if its longest previous factor is as
    long as a window, and a later one if its longest next factor is.
    """
    joined = np.frombuffer(b"".join(contents), np.uint8)
    base = np.cumsum([0, *map(len, contents[:-1])])
    counts = np.asarray(counts)
    owner = np.repeat(np.arange(len(contents)), counts)
    shift = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = base[owner] + shift
    rank = _ranks(joined, length)
    # places in the corpus as numbers: of the content's first byte, then of the window
    key = np.array([p[0] for p in places], np.int64)[owner], np.array([p[1] for p in places], np.int64)[owner] + shift
    place = np.empty(len(at), np.int64)
    place[np.lexsort((owner, key[1], key[0]))] = np.arange(len(at))
    order = np.lexsort((place, rank[length][at]))
    a, b = at[order[:-1]], at[order[1:]]
    common = np.zeros(len(a), np.int64)
    for size in sorted((s for s in rank if s & (s - 1) == 0), reverse=True):
        i, j = np.minimum(a + common, len(joined) - 1), np.minimum(b + common, len(joined) - 1)
        common += np.where(rank[size][i] == rank[size][j], size, 0)
    common = np.where(rank[length][a] == rank[length][b], length, np.minimum(common, length - 1))
    common = [0, *common.tolist()]
    before = np.array(longest_previous(place[order].tolist(), common)) >= length
    after = np.array(longest_previous((-place[order]).tolist(), common)) >= length
    bits = np.uint64(1) << shift[order].astype(np.uint64)
    some, earlier = np.zeros(len(contents), np.uint64), np.zeros(len(contents), np.uint64)
    np.bitwise_or.at(some, owner[order], np.where(before | after, bits, np.uint64(0)))
    np.bitwise_or.at(earlier, owner[order], np.where(before, bits, np.uint64(0)))
    return some, earlier


FOUND = "uid binary, words boolean, key long, place long, first long, last long"
SEGMENTS = "core long, c1 long, c2 long, uid binary, doc_id long, m long, at long, start int, count int, windows array<long>"
FLAGS = "core long, c1 long, c2 long, some long, earlier long"
KEPT = "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>, passage_starts long"


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[f for f, _ in fields])


def find_anchors(rows: DataFrame, length: int, passage_words: int) -> DataFrame:
    """(uid, text) to the anchors of its windows of bytes and of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in in_parts(pc.binary_length(b.column(1)).to_pylist(), PART):
                raw, base, sizes = joined(b.column(1).slice(i, j - i).cast(pa.binary()).to_pylist())
                text = np.frombuffer(raw, np.uint8)
                kinds = [anchors(text, base, sizes, length), *([word_anchors(text, base, passage_words)] if passage_words else [])]
                owner, *found = (np.concatenate(c) for c in zip(*kinds))
                if len(owner):
                    yield _batch([b.column(0).slice(i, j - i).take(pa.array(owner)), np.arange(len(owner)) >= len(kinds[0][0]), *found], FOUND)

    return rows.mapInArrow(run, FOUND)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, .. of each start, as many as its count, one after the other."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def _unsigned(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).view(np.int64)


def cut_segments(marked: DataFrame, length: int, passage_words: int) -> DataFrame:
    """(uid, doc_id, m, text, anchors) to segments of windows of bytes and to runs of windows of words, with hashes of their contents."""

    def segments(texts: list[bytes], owner: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        from xxhash import xxh3_64_digest, xxh3_128_digest

        # of an anchor's windows, the j-th segment has those from place - WIDE * j - WIDE + 1 to place - WIDE * j
        most, least = (place - first) // WIDE, (place - last) // WIDE
        of = np.repeat(np.arange(len(place)), most - least + 1)
        j = least[of] + _ranges(np.zeros(len(place), np.int64), most - least + 1)
        core_at = place[of] - WIDE * j
        low, high = np.maximum(first[of], core_at - WIDE + 1), np.minimum(last[of], core_at)
        own, whole, core = owner[of], [], []
        for o, a, z, c, seed in zip(own.tolist(), low.tolist(), (high + length).tolist(), core_at.tolist(), j.tolist()):
            raw = texts[o]
            whole.append(xxh3_128_digest(raw[a:z], seed))
            core.append(xxh3_64_digest(raw[c : c + length - WIDE + 1], seed))
        pairs = _unsigned(whole)
        return own, _unsigned(core), pairs[::2], pairs[1::2], low, core_at - low, high - low + 1

    def runs(texts: list[bytes], owner: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        from xxhash import xxh3_128_digest

        raw, base, _ = joined(texts)
        text_of, hashes = word_hashes(np.frombuffer(raw, np.uint8), base)
        at = np.arange(len(hashes) + 1)
        windows = _spans(hashes, at[:-passage_words], at[passage_words:])
        start, count = np.searchsorted(text_of, owner) + first, last - first + 1
        pairs = _unsigned([xxh3_128_digest(windows[a:z].tobytes()) for a, z in zip(start.tolist(), (start + count).tolist())])
        zero = np.zeros(len(owner), np.int64)
        return owner, zero, pairs[::2], pairs[1::2], first, zero, count, windows[_ranges(start, count)].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in in_parts(pc.binary_length(b.column(3)).to_pylist(), PART):
                part = b.slice(i, j - i)
                texts, lists = part.column(3).cast(pa.binary()).to_pylist(), part.column(4)
                offsets = lists.offsets.to_numpy()
                own = slice(offsets[0], offsets[-1])
                words, place, first, last = (lists.values.field(f).to_numpy(zero_copy_only=False)[own] for f in ("words", "place", "first", "last"))
                owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
                found, windows = [segments(texts, *(v[~words] for v in (owner, place, first, last)))], np.zeros(0, np.int64)
                if words.any():
                    *told, windows = runs(texts, *(v[words] for v in (owner, first, last)))
                    found.append(told)
                owner, *columns = (np.concatenate(c) for c in zip(*found))
                n = len(found[0][0])
                counts = np.where(np.arange(len(owner)) < n, 0, columns[-1])
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(windows), mask=pa.array(np.arange(len(owner)) < n))
                yield _batch([*columns[:3], *(part.column(c).take(pa.array(owner)) for c in range(3)), *columns[3:], listed], SEGMENTS)

    return marked.mapInArrow(run, SEGMENTS)


def match(contents: DataFrame, length: int, batch: int, width: int = WIDE) -> DataFrame:
    """Bits of the windows of contents(core, c1, c2, doc_id, at, start, count, content) that others of the same core hold, too.

    Contents of few cores are put into suffix order together. A core with more than ``batch``
    contents is cut instead: the windows that hold width / 2 bytes more to its left, and the
    others, become contents of their own, of longer cores, equal ones once. That goes on as long
    as a core has so many contents, at most until a core is one whole window.
    """
    many = materialize(contents.groupBy("core").agg(F.count("*").alias("n")).where(F.col("n") > batch).select("core"), "hot")
    small = contents.join(broadcast_if_small(many), "core", "left_anti")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def masks() -> pa.RecordBatch:
            core, c1, c2, doc_id, at, count, content = zip(*held)
            some, earlier = repeats(content, count, list(zip(doc_id, at)), length)
            return _batch([core, c1, c2, some.view(np.int64), earlier.view(np.int64)], FLAGS)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if len(held) >= batch and row[0] != held[-1][0]:
                    yield masks()
                    held = []
                held.append(row)
        if held:
            yield masks()

    parts = int(contents.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the bytes are few, the work is not
    dealt = small.select("core", "c1", "c2", "doc_id", "at", "count", "content").repartition(parts, "core").sortWithinPartitions("core")
    flags = dealt.mapInArrow(sort, FLAGS)
    if width == 1 or many.isEmpty():
        return flags

    half = width // 2
    hot = contents.join(broadcast_if_small(many), "core", "left_semi")
    left = hot.where(F.col("start") >= half).select("*", F.lit(0).alias("i0"), F.least("count", F.col("start") - half + 1).alias("n1"), (F.col("start") - half).alias("s1"))
    right = hot.withColumn("i0", F.greatest(F.lit(0), F.col("start") - half + 1)).where("count > i0").withColumns({"n1": F.col("count") - F.col("i0"), "s1": F.col("start") - F.col("i0")})
    both = left.withColumn("side", F.lit(1)).unionByName(right.withColumn("side", F.lit(0)))
    own = F.substring("content", F.col("i0") + 1, F.col("n1") - 1 + length)
    both = both.withColumn("own", own).withColumn("longer", F.substring("own", F.col("s1") + 1, F.lit(length - half + 1)))
    both = materialize(both.select("core", "c1", "c2", "doc_id", (F.col("at") + F.col("i0")).alias("at"), "i0", F.col("s1").alias("start"), F.col("n1").alias("count"), F.col("own").alias("content"), F.xxhash64("core", "side", "longer").alias("k0"), F.xxhash64("own").alias("k1"), F.xxhash64("own", F.lit(1)).alias("k2")), "halves")
    least = F.min(F.struct("doc_id", "at"))
    once = materialize(both.groupBy("k0", "k1", "k2").agg(least.alias("p"), F.count("*").alias("n"), F.first("start").alias("start"), F.first("count").alias("count"), F.first("content").alias("content")), "halves")
    below = match(once.select(F.col("k0").alias("core"), F.col("k1").alias("c1"), F.col("k2").alias("c2"), "p.doc_id", "p.at", "start", "count", "content"), length, batch, half)
    known = once.select("k0", "k1", "k2", "n", "p").join(below.toDF("k0", "k1", "k2", "some", "earlier"), ["k0", "k1", "k2"])
    back = both.select("core", "c1", "c2", "doc_id", "at", "i0", "count", "k0", "k1", "k2").join(known, ["k0", "k1", "k2"])
    every = F.expr("shiftleft(1L, count) - 1")
    some = F.when(F.col("n") > 1, every).otherwise(F.col("some"))
    earlier = F.when(F.struct("doc_id", "at") > F.col("p"), every).otherwise(F.col("earlier"))
    shifted = lambda c: F.call_function("shiftleft", c, F.col("i0"))
    up = back.select("core", "c1", "c2", shifted(some).alias("some"), shifted(earlier).alias("earlier"))
    return flags.unionByName(up.groupBy("core", "c1", "c2").agg(F.bit_or("some").alias("some"), F.bit_or("earlier").alias("earlier")))


def passages(runs: DataFrame) -> DataFrame:
    """runs(uid, m, c1, c2, windows) to passage_starts of each uid: windows of words that stand anywhere else.

    Runs equal as a whole are one; the windows of these are counted apart, so that also runs that differ at an end meet.
    """
    contents = materialize(runs.groupBy("c1", "c2").agg(F.sum("m").alias("n"), F.first("windows").alias("windows")), "runs")
    windows = contents.select("c1", "c2", F.explode("windows").alias("w"))
    again = windows.groupBy("w").agg(F.count("*").alias("k")).where("k > 1").select("w")
    some = windows.join(again, "w", "left_semi").groupBy("c1", "c2").agg(F.count("*").alias("some"))
    starts = F.when(F.col("n") > 1, F.size("windows")).otherwise(F.coalesce("some", F.lit(0))).cast("long")
    flagged = materialize(contents.join(some, ["c1", "c2"], "left").select("c1", "c2", starts.alias("starts")).where("starts > 0"), "flagged")
    return runs.select("uid", "c1", "c2").join(broadcast_if_small(flagged, SMALL), ["c1", "c2"]).groupBy("uid").agg(F.sum("starts").alias("passage_starts"))


def remove(rows: DataFrame, length: int) -> DataFrame:
    """(doc_id, text, hits, passage_starts) to what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, spans_type = [f.split()[0] for f in KEPT.split(", ")], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            for part_at in range(0, b.num_rows, 200):
                part = b.slice(part_at, 200)
                hits, sizes, kept, spans = part.column(2), [], [], []
                offsets, values = hits.offsets.to_numpy(), hits.values
                at, count, mask = (values.field(f).to_numpy() for f in ("at", "count", "mask"))
                for i, text in enumerate(part.column(1).cast(pa.binary())):
                    raw = np.frombuffer(text.as_buffer(), np.uint8)
                    own = slice(offsets[i], offsets[i + 1])
                    bits = (mask[own].astype(np.uint64)[:, None] >> np.arange(WIDE, dtype=np.uint64)) & np.uint64(1)
                    row, k = np.nonzero(bits & (np.arange(WIDE) < count[own][:, None]))
                    first = at[own][row] + k
                    step = np.bincount(first, minlength=len(raw) + 1) - np.bincount(first + length, minlength=len(raw) + 1)
                    out = np.cumsum(step[:-1]) > 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]])))
                    sizes.append(len(raw))
                    spans.append([{"start": a, "end": z} for a, z in zip(edges[::2].tolist(), edges[1::2].tolist())])
                    kept.append(raw[~out].tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, spans_type), part.column(3)], names=names)

    return rows.mapInArrow(run, KEPT)


def dedup_substrings(docs: DataFrame, length: int = 400, keep_first: bool = True, passage_words: int = 51, batch: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, kept (binary), spans removed (byte ranges) and passage_starts.

    A byte goes if it lies in a string of ``length`` bytes that starts anywhere else too, in
    another document or its own; with ``keep_first`` the place of smallest document id, then
    offset, stays. Strings are judged on the input and do not cross documents. passage_starts
    counts the places where ``passage_words`` words start that stand in a row anywhere else too,
    which tells of passages that have so many words in fewer bytes (0: not looked for). Null text is
    empty; repeated rows are copies of each other, of which keep_first keeps all, as they stand at the
    same place; null ids count as the smallest id; other columns are not read; an empty table gives no rows.

    Every string is found through its anchor, so only those whose anchor repeats are looked at.
    They are cut into segments of up to 64 windows that share a core. Segments of equal content
    are one entry with the first of their places, which is the previous factor of the others; the
    contents that share a core with different ones are put into suffix order, whose longest
    previous and next factors tell the windows that match. A group of equal segments is
    one row for each task, and a core with very many contents is split by longer cores (``match``).
    """
    if length < GRAM + WIDE or passage_words and passage_words <= WORD_GRAM:
        raise ValueError(f"length must be at least {GRAM + WIDE}, passage_words above {WORD_GRAM}")
    key = F.substring(F.unhex(F.sha2("text", 256)), 1, 16)
    copies = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("doc_id", key.alias("uid"), "text")

    # written, so that both sides of the join are dealt by plain shuffles, of which a hot key's can be split
    found = materialize(find_anchors(copies.select("uid", "text"), length, passage_words), "found")
    again = materialize(found.groupBy("words", "key").agg(F.count("*").alias("n")).where("n > 1").select("words", "key"), "repeated")
    marked = materialize(found.join(again, ["words", "key"], "left_semi").groupBy("uid").agg(F.collect_set(F.struct("words", "place", "first", "last")).alias("anchors")), "anchors")
    ids = broadcast_if_small(marked.select("uid"), SMALL)
    one = copies.join(ids, "uid", "left_semi").groupBy("uid").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("m"), F.first("text").alias("text"))
    everything = materialize(cut_segments(one.join(marked, "uid").select("uid", "doc_id", "m", "text", "anchors"), length, passage_words), "segments")
    segments, runs = everything.where("windows is null"), everything.where("windows is not null")

    times = materialize(segments.groupBy("core", "c1", "c2").agg(F.sum("m").alias("n"), F.min(F.struct("doc_id", "at", "uid")).alias("one"), F.first("start").alias("start"), F.first("count").alias("count")), "contents")
    border = times.join(times.groupBy("core").agg(F.count("*").alias("k")).where("k > 1").select("core"), "core", "left_semi")
    wanted = border.groupBy("one.uid").agg(F.collect_list(F.struct("core", "c1", "c2", "start", "count", "one.doc_id", "one.at")).alias("pieces"))  # within one text
    texts = copies.join(broadcast_if_small(wanted.select("uid"), SMALL), "uid", "left_semi").groupBy("uid").agg(F.first("text").alias("text"))
    # 63 bytes on both sides of the core, or less
    pieces = texts.join(wanted, "uid").select(F.encode("text", "UTF-8").alias("raw"), F.explode("pieces").alias("p"))
    content = F.substring("raw", (F.col("p.at") + 1).cast("int"), (F.col("p.count") - 1 + length).cast("int"))
    contents = materialize(pieces.select("p.core", "p.c1", "p.c2", "p.doc_id", "p.at", "p.start", "p.count", content.alias("content")), "borders")
    flags = match(contents, length, batch)

    verdict = materialize(times.where("n > 1").select("core", "c1", "c2", "n", "one").join(flags, ["core", "c1", "c2"], "full").where("n > 1 or some <> 0"), "verdict")
    hits = (segments if keep_first else segments.where("m = 1")).drop("windows", "start", "m").join(verdict, ["core", "c1", "c2"])
    every = F.lit(-1).cast("long")
    if keep_first:
        mask = F.when(F.col("n").isNotNull() & (F.struct("doc_id", "at") > F.struct("one.doc_id", "one.at")), every).otherwise(F.coalesce("earlier", F.lit(0).cast("long")))
    else:
        mask = F.when(F.col("n").isNotNull(), every).otherwise(F.col("some"))
    gone = hits.select("uid", F.struct(F.col("at").alias("at"), F.col("count").alias("count"), mask.alias("mask")).alias("hit")).where("hit.mask <> 0").groupBy("uid").agg(F.collect_list("hit").alias("hits"))  # within one text
    told = materialize(gone.join(passages(runs), "uid", "full"), "removed")

    # of a text that is there more than once all goes, but for the first place if that stays; texts of which nothing goes are not moved
    several = materialize(everything.where("m > 1").select("uid", F.col("doc_id").alias("first_id")).distinct(), "several")
    known = copies.join(broadcast_if_small(several, SMALL), "uid", "left")
    later = F.col("first_id").isNotNull() & (F.octet_length("text") >= length) & ((F.col("doc_id") > F.col("first_id")) if keep_first else F.lit(True))
    hit = broadcast_if_small(told.where("hits is not null").select("uid", F.lit(True).alias("hit")), SMALL)
    known = known.withColumn("all_gone", F.coalesce(later, F.lit(False))).join(hit, "uid", "left")
    some = known.where("hit and not all_gone").drop("hit").join(told, "uid")
    rest = known.where("hit is null or all_gone")
    starts = told.where("hits is null" if not keep_first else "passage_starts is not null").select("uid", "passage_starts")
    rest = rest.join(broadcast_if_small(starts, SMALL), "uid", "left")
    span = "array<struct<start:bigint,end:bigint>>"
    size = F.octet_length("text").cast("long")
    spans = F.when(F.col("all_gone"), F.array(F.struct(F.lit(0).cast("long").alias("start"), size.alias("end"))).cast(span)).otherwise(F.array().cast(span))
    zero = F.coalesce("passage_starts", F.lit(0).cast("long")).alias("passage_starts")
    whole = rest.select("doc_id", size.alias("n_bytes"), F.when(F.col("all_gone"), F.lit(b"")).otherwise(F.encode("text", "UTF-8")).alias("kept"), spans.alias("spans"), zero)
    done = remove(some.select("doc_id", "text", "hits", zero), length).unionByName(whole)
    return done.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
