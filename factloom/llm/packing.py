"""Hierarchical multi-length packing of token documents (operator 7)."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, window int, step_group long"


class ChunkEncoder:
    """Token ids of whole texts, from bounded caches of white-space separated chunks and of words.

    The tokenizer never merges across white space, nor across the words that its own pattern cuts
    a chunk into, so a text's ids are those of its words in order. Chunks of ASCII and Latin-1
    characters are lower-cased and cut here; unknown words are encoded together, and the ids dealt out
    by the mark that ends a word. Other chunks are encoded one by one. A full cache becomes the
    old generation, from which chunks still in use are taken over.
    """

    def __init__(self, path: str, cache_size: int = 50_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.array([t.endswith("</w>") for t, _ in sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])])
        self.simple = re.compile("[!-~\u00a1-\u00ff]+").fullmatch
        # str.split cuts at these four as well, which are no white space to the tokenizer
        self.spaces = re.compile(r"[^\S\x1c-\x1f]+")
        #: The pattern by which the tokenizer's file cuts words, its letters and numbers spelled out for lower-cased Latin-1.
        letter, number = (re.escape("".join(c for c in map(chr, range(256)) if test(c))) for test in (str.isalpha, str.isnumeric))
        self.cut = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^\s{letter}{number}]+").findall
        self.new, self.old, self.words, self.cache_size = {}, {}, {}, cache_size

    def _learn_words(self, words: list[str]) -> None:
        for at in range(0, len(words), 200):
            part = words[at : at + 200]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stops) != len(part):  # a word that the tokenizer cuts in another way: each by itself
                for word in part:
                    self.words[word] = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
                continue
            raw, start = ids.tobytes(), 0
            for word, stop in zip(part, stops.tolist()):
                self.words[word] = raw[start:stop]
                start = stop

    def _learn(self, chunks: set[str]) -> None:
        if len(self.words) > 2 * self.cache_size:
            self.words.clear()
        parts = {}
        for chunk in chunks:
            if chunk in self.old:
                self.new[chunk] = self.old[chunk]
            elif chunk.isascii() and chunk.isalpha():
                parts[chunk] = (chunk.lower(),)
            elif self.simple(chunk) and "<|" not in chunk:
                parts[chunk] = self.cut(chunk.lower())
            else:
                self.new[chunk] = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        self._learn_words([w for w in dict.fromkeys(w for ws in parts.values() for w in ws) if w not in self.words])
        for chunk, ws in parts.items():
            self.new[chunk] = self.words[ws[0]] if len(ws) == 1 else b"".join(map(self.words.__getitem__, ws))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        chunks = [self.spaces.split(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split() for text in texts]
        if len(self.new) > self.cache_size:
            self.old, self.new = self.new, {}
        known = self.new
        self._learn({c for cs in chunks for c in cs if c not in known} - {""})
        known.setdefault("", b"")
        return [b"".join(map(known.__getitem__, cs)) for cs in chunks]


@lru_cache(maxsize=1)
def encoder_of(path: str, cache_size: int) -> ChunkEncoder:
    """One encoder per worker process: later tasks start from the words that earlier ones learned."""
    return ChunkEncoder(path, cache_size)


def _tier(n: int) -> int:
    """The smallest power of two that holds n tokens."""
    return 1 << (n - 1).bit_length()


class Packer:
    """Packs one partition's documents into windows whose sizes are powers of two, all exactly full.

    A document goes to the tier of the smallest window that holds it (full-length windows are cut
    off first). Tiers are packed from long to short: a window's gap takes the longest shorter
    documents that still fit, and the last bit of it is a cut piece of the shortest one. What
    stays at the end of the partition is cut into powers of two. ``step_tokens`` tokens of
    windows of the same tier make a step group, so that groups carry the same load.
    """

    def __init__(self, partition: int, max_length: int, buffer_tokens: int, step_tokens: int):
        self.max_length, self.buffer_tokens, self.step_tokens = max_length, buffer_tokens, step_tokens
        self.base, self.sequences, self.filled, self.groups = partition << 32, 0, {}, 0
        self.group_of: dict[int, int] = {}
        self.pool: list[tuple[int, int, int]] = []  # (tokens left, document, start), ascending
        self.docs: dict[int, tuple[int | None, bytes, int]] = {}
        self.serial, self.held, self.rows = 0, 0, []

    def _emit(self, pieces: list[tuple[int, int, int]]) -> None:
        """pieces: (document, start, length), together one window."""
        size = sum(p[2] for p in pieces)
        window = _tier(size)
        if window not in self.group_of or self.filled[window] + window > self.step_tokens:
            self.group_of[window], self.filled[window] = self.groups, 0
            self.groups += 1
        self.filled[window] += window
        offset = 0
        for doc, start, length in pieces:
            doc_id, ids, total = self.docs[doc]
            self.rows.append((doc_id, start, length, ids[4 * start : 4 * (start + length)], total, self.base + self.sequences, offset, window, self.base + self.group_of[window]))
            offset += length
            self.held -= length
        self.sequences += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total = len(ids) // 4
        self.docs[self.serial] = (doc_id, ids, total)
        self.held += total
        start = 0
        while total - start >= self.max_length:
            self._emit([(self.serial, start, self.max_length)])
            start += self.max_length
        if start < total:
            bisect.insort(self.pool, (total - start, self.serial, start))
        else:
            del self.docs[self.serial]
        self.serial += 1
        if self.held > self.buffer_tokens:
            self.flush(False)

    def flush(self, last: bool) -> None:
        pool, kept = self.pool, []
        while pool:
            length, doc, start = pool.pop()
            pieces, gap = [(doc, start, length)], _tier(length) - length
            while gap and pool:
                at = bisect.bisect_right(pool, (gap, self.serial, 0)) - 1
                if at >= 0:
                    length, doc, start = pool.pop(at)
                else:  # every document left is longer than the gap: cut the shortest
                    whole, doc, start = pool.pop(0)
                    length = gap
                    bisect.insort(pool, (whole - gap, doc, start + gap))
                pieces.append((doc, start, length))
                gap -= length
            if gap == 0:
                self._emit(pieces)
            else:
                kept = pieces
        if last:
            while kept:  # the tail: exactly full windows of falling powers of two
                want, window = 1 << (sum(p[2] for p in kept).bit_length() - 1), []
                while want:
                    doc, start, length = kept.pop(0)
                    take = min(want, length)
                    window.append((doc, start, take))
                    want -= take
                    if take < length:
                        kept.insert(0, (doc, start + take, length - take))
                self._emit(window)
        else:
            self.pool = sorted((length, doc, start) for doc, start, length in kept)
        open_docs = {doc for _, doc, _ in self.pool}
        self.docs = {k: v for k, v in self.docs.items() if k in open_docs}


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, max_length: int = 4096, buffer_tokens: int = 1 << 20, step_tokens: int = 1 << 17, cache_size: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, its ids (little-endian
    unsigned 32-bit), the sequence's window and step group.

    Needs no shuffle: each partition packs its own rows through a buffer of ``buffer_tokens``
    tokens, so neither a hot source nor a long text gathers anywhere. A null or empty text is the
    end id alone. ``cache_size`` bounds the chunks and words that a worker keeps, about 150 bytes each; it changes no result. Repeated rows are packed once each; a null id stays null; other columns are not
    read; an empty table gives no pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path, cache_size)
        packer = Packer(TaskContext.get().partitionId(), max_length, buffer_tokens, step_tokens)
        end = np.array([end_id], "<u4").tobytes()
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        names = [c.split()[0] for c in PIECES.split(", ")]

        def out() -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                part = batch.slice(at, 32)
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode([x or "" for x in part.column(1).to_pylist()])):
                    packer.add(doc_id, ids + end)
                if len(packer.rows) >= 1000:
                    yield out()
        packer.flush(True)
        yield out()
        pa.default_memory_pool().release_unused()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)
