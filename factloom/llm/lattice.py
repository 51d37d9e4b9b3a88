"""Subword lattice likelihood of documents (operator 4)."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import materialize, words_of

END = " end"  # no word holds a space
PRIME = np.uint64(1_000_003)
MARK = "▁"  # starts a word in the vocabulary's pieces


BITS = 20  # of a slot's number in the table of pieces
LONG = 256  # longer words are handled one by one, all positions together


def _slot(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


@lru_cache(maxsize=1)
def _table(pieces: tuple[str, ...]) -> tuple[dict[int, int], int, np.ndarray, np.ndarray]:
    """Numbers of single bytes' pieces, the longest piece, and hashes and numbers by slot; once per process."""
    byte = {int(p[3:5], 16): i for i, p in enumerate(pieces) if len(p) == 6 and p.startswith("<0x")}
    plain = [(p, i) for i, p in enumerate(pieces) if p and i not in set(byte.values()) and p not in ("<unk>", "<s>", "</s>")]
    keys, ids = np.zeros(1 << BITS, np.uint64), np.full(1 << BITS, -1, np.int64)
    for p, i in plain:
        h = 0
        for c in p:
            h = (h * int(PRIME) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        at = _slot(np.array([h], np.uint64))[0]
        while ids[at] >= 0:
            at = (at + 1) % (1 << BITS)
        keys[at], ids[at] = h, i
    return byte, max((len(p) for p, _ in plain), default=1), keys, ids


class Pieces:
    """A subword vocabulary with log probabilities, looked up by hashes of code points.

    Given by parallel lists: single bytes' pieces have the form <0x..>. Positions of unknown code
    points cost the product of their UTF-8 bytes' probabilities.
    """

    def __init__(self, pieces: list[str], logp: np.ndarray):
        self.logp = np.asarray(logp, np.float64)
        self.byte, self.longest, self.keys, self.ids = _table(tuple(pieces))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers by hash, -1 where there is none."""
        at = _slot(h)
        out = np.where(self.keys[at] == h, self.ids[at], -1)
        todo = np.flatnonzero((out < 0) & (self.ids[at] >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) % (1 << BITS)
            hit = self.keys[at[todo]] == h[todo]
            out[todo[hit]] = self.ids[at[todo[hit]]]
            todo = todo[~hit & (self.ids[at[todo]] >= 0)]
        return out

    def _arcs(self, points: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """All arcs of words (rows) of one length, by start: start, end, rows that have it, pieces or -1, log probabilities."""
        n, arcs = points.shape[1], []
        codes = points.T.astype(np.uint64) + np.uint64(1)
        for i in range(n):
            h = codes[i]
            for length in range(1, min(self.longest, n - i) + 1):
                if length > 1:
                    h = h * PRIME + codes[i + length - 1]
                piece = self.find(h)
                rows = np.flatnonzero(piece >= 0) if length > 1 else np.arange(len(points))
                if not len(rows):
                    continue
                piece = piece[rows]
                logp = self.logp[piece]
                if length == 1 and (piece < 0).any():
                    logp[piece < 0] = self._unknown(points[piece < 0, i])
                arcs.append((i, i + length, rows, piece, logp))
        return arcs

    def forward(self, points: np.ndarray, arcs: list | None = None) -> np.ndarray:
        """Log of the sum over all segmentations of a prefix, for words (rows) of one length."""
        if points.shape[1] > LONG:
            found = [(len(word), self._arcs_of(word)) for word in points]
            return np.array([self._walk(n, starts, ends, logp) for n, (starts, ends, _, logp) in found]).T
        alpha = np.full((points.shape[1] + 1, len(points)), -np.inf)
        alpha[0] = 0
        for i, j, rows, _, logp in arcs if arcs is not None else self._arcs(points):
            alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + logp)
        return alpha

    def expect(self, points: np.ndarray, weights: np.ndarray, totals: np.ndarray) -> None:
        """Add to totals how often the words' segmentations are expected to use each piece."""
        if points.shape[1] > LONG:
            for word, weight in zip(points, weights):
                n, (starts, ends, piece, logp) = len(word), self._arcs_of(word)
                alpha, beta = self._walk(n, starts, ends, logp), self._walk(n, n - ends, n - starts, logp)[::-1]
                share = np.exp(alpha[starts] + logp + beta[ends] - alpha[-1]) * weight
                used = piece >= 0
                np.add.at(totals, piece[used], share[used])
                self._add_bytes(word[starts[~used]], share[~used], totals)
            return
        arcs = self._arcs(points)
        alpha = self.forward(points, arcs)
        beta = np.full(alpha.shape, -np.inf)
        beta[-1] = 0
        for i, j, rows, piece, logp in reversed(arcs):
            through = logp + beta[j, rows]
            beta[i, rows] = np.logaddexp(beta[i, rows], through)
            share = np.exp(alpha[i, rows] + through - alpha[-1, rows]) * weights[rows]
            used = piece >= 0
            np.add.at(totals, piece[used], share[used])
            if j == i + 1 and not used.all():
                self._add_bytes(points[rows[~used], i], share[~used], totals)

    def _add_bytes(self, points: np.ndarray, shares: np.ndarray, totals: np.ndarray) -> None:
        for c, s in zip(points.tolist(), shares.tolist()):
            for b in chr(c).encode("utf-8", "surrogatepass"):
                totals[self.byte[b]] += s

    def _unknown(self, points: np.ndarray) -> np.ndarray:
        """Log probabilities of code points that are no piece: of their bytes."""
        unknown, where = np.unique(points, return_inverse=True)
        return np.array([sum(self.logp[self.byte[b]] for b in chr(c).encode("utf-8", "surrogatepass")) for c in unknown.tolist()])[where]

    def _arcs_of(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All arcs of one long word: starts, ends, pieces or -1, log probabilities; looked up by length, for all starts together."""
        codes, n = word.astype(np.uint64) + np.uint64(1), len(word)
        h, found = codes, []
        for length in range(1, min(self.longest, n) + 1):
            if length > 1:
                h = h[:-1] * PRIME + codes[length - 1 :]
            piece = self.find(h)
            at = np.flatnonzero(piece >= 0) if length > 1 else np.arange(n)
            found.append((at, at + length, piece[at]))
        starts, ends, piece = (np.concatenate(c) for c in zip(*found))
        logp = self.logp[piece]
        if (piece < 0).any():
            logp[piece < 0] = self._unknown(word[starts[piece < 0]])
        return starts, ends, piece, logp

    @staticmethod
    def _walk(n: int, starts: np.ndarray, ends: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """The forward recursion over one long word, position by position."""
        order = np.argsort(ends, kind="stable")
        arcs, k, alpha = list(zip(ends[order].tolist(), starts[order].tolist(), logp[order].tolist())), 0, [0.0] * (n + 1)
        for j in range(1, n + 1):
            terms = []
            while k < len(arcs) and arcs[k][0] == j:
                terms.append(alpha[arcs[k][1]] + arcs[k][2])
                k += 1
            most = max(terms)
            alpha[j] = most + math.log(sum(math.exp(t - most) for t in terms))
        return np.array(alpha)

    @staticmethod
    def by_length(words: list[str], most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row numbers and code points of words of equal length, marked as word starts, in blocks."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for rows in np.split(order, cuts):
            if not len(rows):
                continue
            n = int(lengths[rows[0]]) + 1
            for at in range(0, len(rows), max(1, most // n)):
                part = rows[at : at + max(1, most // n)]
                joined = "".join(MARK + words[r] for r in part.tolist())
                yield part, np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(part), n)


def read_vocabulary(path: str) -> list[str]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size())]


def rank_scores(pieces: list[str]) -> np.ndarray:
    """The vocabulary's order as first scores: pieces merged earlier are likelier, by Zipf's law."""
    p = 1.0 / (np.arange(len(pieces)) + 100.0)
    return np.log(p / p.sum())


def count_tokens(rows: DataFrame, flush: int = 400_000) -> DataFrame:
    """(text, learn) to (word, c, n): how often each word and END occur in rows to learn from, and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned, others = Counter(), Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words = list(learned.keys() | others.keys())
            for at in range(0, len(words), 50_000):
                part = words[at : at + 50_000]
                c = [learned[w] for w in part]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()).cast(pa.string()), pa.array(c, pa.int64()), pa.array([a + others[w] for a, w in zip(c, part)], pa.int64())], names=["word", "c", "n"])
            learned.clear()
            others.clear()

        for batch in batches:
            for text, learn in zip(batch.column(0).cast(pa.binary()), batch.column(1)):
                into = learned if learn.as_py() else others
                into.update(words_of(text.as_py() or b""))
                into[END.encode()] += 1
                if len(learned) + len(others) > flush:
                    yield from out()
        yield from out()

    return rows.select("text", "learn").mapInArrow(run, "word string, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Batches joined until they have that many rows: words of one length are handled together."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def fit_pieces(words: DataFrame, pieces: list[str], rounds: int = 2, prior: float = 0.1) -> np.ndarray:
    """Log probabilities of the vocabulary's pieces by expectation maximisation over all learned
    words with their counts; what the driver gathers has a row for each piece at most."""
    logp = rank_scores(pieces)
    sc = words.sparkSession.sparkContext
    for _ in range(rounds):
        shared = sc.broadcast(logp)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model, totals = Pieces(pieces, shared.value), np.zeros(len(pieces))
            for batch in _gathered(batches):
                weights = batch.column(1).to_numpy().astype(np.float64)
                for rows, points in Pieces.by_length(batch.column(0).to_pylist()):
                    model.expect(points, weights[rows], totals)
            used = np.flatnonzero(totals)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(totals[used], pa.float64())], names=["piece", "share"])

        found = words.where("c > 0").where(F.col("word") != END).select("word", "c").mapInArrow(run, "piece int, share double").groupBy("piece").agg(F.sum("share").alias("share")).collect()
        totals = np.full(len(pieces), prior)
        for r in found:
            totals[r["piece"]] += r["share"]
        for i, p in enumerate(pieces):
            if p in ("<unk>", "<s>", "</s>"):
                totals[i] = 1e-12
        logp = np.log(totals / totals.sum())
    return logp


def word_scores(words: DataFrame, pieces: list[str], logp: np.ndarray, total: int, unseen: float) -> DataFrame:
    """Adds ``lattice``, the log10 marginal probability of each word over all its segmentations, and ``mixed``.

    For ``mixed`` the lattice has one more arc for a word seen in training, the word as a whole, which weighs
    (1 - unseen) * c / total; segmentations into the vocabulary's pieces weigh ``unseen``.
    """
    shared = words.sparkSession.sparkContext.broadcast(logp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces(pieces, shared.value)
        for batch in _gathered(batches):
            scores = np.zeros(batch.num_rows)
            for rows, points in Pieces.by_length(batch.column(0).to_pylist()):
                scores[rows] = model.forward(points)[-1]
            with np.errstate(divide="ignore"):
                whole = np.log(batch.column(1).to_numpy() * ((1 - unseen) / max(total, 1)))
            mixed = np.logaddexp(scores + math.log(unseen), whole)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores / math.log(10), pa.float64()), pa.array(mixed / math.log(10), pa.float64())], names=["word", "c", "n", "lattice", "mixed"])

    return words.select("word", "c", "n").mapInArrow(run, "word string, c long, n long, lattice double, mixed double")


def score(docs: DataFrame, learn: Column, vocabulary_path: str, head_words: int = 60_000, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Unigram and lattice log10 probabilities of whole texts, learned from the rows where ``learn``.

    Tokens are words (A-Z lower-cased) and one end. ``base_score`` is the smoothed unigram's.
    ``score`` is the lattice's: each word's probability is the sum, over all ways to cut it into
    pieces of the given vocabulary, of the pieces' probabilities (bytes for unknown code points),
    which are learned from all training words.
    The end has its smoothed unigram share, and the words the rest. ``mixed_score`` adds each word's
    own share of the training words as a whole; whole words and pieces are weighed by the share of
    training tokens seen once only (Good-Turing). ``mean_mixed`` is mixed_score / n_tokens. Returns
    doc_id, n_tokens, n_known, train_tokens, base_score, score, mixed_score, mean_mixed.

    Null text is empty (the end alone); every row gives one row, null ids stay null, repeated rows
    are counted and scored alike; other columns are not read; an empty table gives no rows.

    Counts and scores of the at most ``head_words`` most frequent words are sent to the tasks, a
    bound that does not grow; all other words are joined by shuffling, so frequent words never
    meet in one task and the vocabulary is never gathered.
    """
    spark = docs.sparkSession
    pieces = read_vocabulary(vocabulary_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    counts = materialize(count_tokens(rows), "counts")
    tokens, distinct, once = (n or 0 for n in counts.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1)).first())
    logp = fit_pieces(counts, pieces, rounds)
    base_of = lambda c: math.log10((c + 0.5) / (tokens + 0.5 * (distinct + 1)))
    ends = counts.where(F.col("word") == END).select("c").first()
    ends = ends["c"] if ends else 0
    words = tokens - ends
    unseen = min(0.5, max(1e-6, once / words)) if words else 1.0
    table = materialize(word_scores(counts.where(F.col("word") != END), pieces, logp, words, unseen), "words")
    end_base, spread = base_of(ends), math.log10(max(1e-9, 1 - 10 ** base_of(ends)))

    bits = table.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count("*").alias("k")).orderBy(F.desc("bits")).collect()
    least, held = 64, 0
    for r in bits:
        if held + r["k"] > head_words:
            break
        held, least = held + r["k"], r["bits"]
    head = {r["word"].encode(): (r["c"] > 0, base_of(r["c"]), r["lattice"] + spread, r["mixed"] + spread) for r in table.where(F.length(F.bin("n")) >= least).toLocalIterator()}
    shared = spark.sparkContext.broadcast(head)
    schema = "word string, doc_id long, h long, times long, n_tokens long, n_known long, base double, lattice double, mixed double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_words = shared.value
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                cols: list[list] = [[] for _ in types]
                part = batch.slice(at, 500)
                for doc_id, text, h in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()), part.column(2).to_pylist()):
                    seen = Counter(words_of(text.as_py()))
                    n, known, base, lattice, mixed, tail = 1, int(ends > 0), end_base, end_base, end_base, []
                    for word, k in seen.items():
                        n += k
                        found = known_words.get(word)
                        if found is None:
                            tail.append((word, k))
                        else:
                            known += k * found[0]
                            base += k * found[1]
                            lattice += k * found[2]
                            mixed += k * found[3]
                    for col, values in zip(cols, ([f" {doc_id} {h}".encode(), *(w for w, _ in tail)], [doc_id] * (len(tail) + 1), [h] * (len(tail) + 1), [0, *(k for _, k in tail)], [n] + [0] * len(tail), [known] + [0] * len(tail), [base] + [0.0] * len(tail), [lattice] + [0.0] * len(tail), [mixed] + [0.0] * len(tail))):
                        col += values
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()).cast(pa.string()), *(pa.array(c, t) for c, t in zip(cols[1:], types[1:]))], names=names)

    # a document's own row has a key that no word has: rows of documents spread like those of words
    split = rows.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(run, schema)
    rest = table.where(F.length(F.bin("n")) < least).select("word", "c", F.col("lattice").alias("w"), F.col("mixed").alias("v"))
    met = split.join(rest, "word", "left")
    base = F.log10((F.col("c") + 0.5) / (tokens + 0.5 * (distinct + 1)))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    summed = met.groupBy("doc_id", "h").agg(
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0))).alias("n_known"),
        (F.sum("base") + F.sum(zero(F.col("times") * base))).alias("base_score"),
        (F.sum("lattice") + F.sum(zero(F.col("times") * (F.col("w") + spread)))).alias("score"),
        (F.sum("mixed") + F.sum(zero(F.col("times") * (F.col("v") + spread)))).alias("mixed_score"),
        F.count_if(F.col("n_tokens") > 0).alias("rows"),
    )
    # a row for each repeated row, in two steps of at most 65,536
    step = F.lit(1 << 16)
    blocks = summed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / step))))
    each = blocks.withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), F.least(step.cast("long"), F.col("rows") - F.col("block") * step))))
    share = lambda c: F.col(c) / F.col("rows")
    whole = lambda c: share(c).cast("long").alias(c)
    return each.select("doc_id", whole("n_tokens"), whole("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), share("base_score").alias("base_score"), share("score").alias("score"), share("mixed_score").alias("mixed_score"), (F.col("mixed_score") / F.col("n_tokens")).alias("mean_mixed"))
