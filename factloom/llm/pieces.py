"""SentencePiece ids of whole texts, from tables of distinct chunks, and texts of ids (operator 11)."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.llm.common import in_parts

MARK = "▁"


class ChunkTable:
    """Distinct chunks with their ids, each segmented once.

    A chunk is a run of white-space markers and what follows up to the next one. If no piece of
    the vocabulary goes on with a marker after another character, no merge reaches across chunks, and a
    text's ids are those of its chunks in order. The same holds for a line feed that no piece
    contains. A model for which this can't be told from its pieces, or that rewrites texts, is refused.
    A table of more than ``keep`` chunks or ``keep_chars`` characters starts anew.
    """

    def __init__(self, path: str, keep: int = 300_000, keep_chars: int = 8_000_000):
        from sentencepiece import SentencePieceProcessor

        self.sp = SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces) or MARK not in pieces or self.sp.normalize("ﬁ　x  y ") != f"{MARK}ﬁ　x{MARK * 2}y{MARK}":
            raise ValueError("chunks need a model that keeps texts as they are and whose pieces don't cross white space")
        self.mark_id = self.sp.piece_to_id(MARK)
        lines = not any("\n" in p for p in pieces)
        self.cut = re.compile(" +[^ \n]*|\n[^ \n]*" if lines else " +[^ ]*").findall
        self.keep, self.keep_chars = keep, keep_chars
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}  # a chunk's row in the table
        self.starts, self.ids, self.chars = np.zeros(1, np.int64), np.zeros(0, np.int32), 0

    def _learn(self, chunks: list[str]) -> None:
        # the library puts a marker before each text: it stands for the chunk's first, or is cut off again
        found = self.sp.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        for i, chunk in enumerate(chunks):
            if chunk == " ":
                found[i] = [self.mark_id]
            elif chunk[0] != " ":
                found[i] = found[i][1:]
        self.place.update(zip(chunks, range(len(self.place), len(self.place) + len(chunks))))
        counts = np.fromiter(map(len, found), np.int64, len(found))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum()))])
        self.chars += sum(map(len, chunks))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and the ids of all texts, one after the other."""
        rows = [self.cut(" " + text.replace(MARK, " ")) if text else [] for text in texts]
        chunks = list(chain.from_iterable(rows))
        wanted = set(chunks)
        new = wanted.difference(self.place)
        if len(self.place) + len(new) > self.keep or self.chars + sum(map(len, new)) > self.keep_chars:
            self._clear()
            new = wanted
        if new:
            self._learn(list(new))
        at = np.fromiter(map(self.place.__getitem__, chunks), np.int64, len(chunks))
        counts = self.starts[at + 1] - self.starts[at]
        before = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
        ids = self.ids[np.repeat(self.starts[at] - before[:-1], counts) + np.arange(before[-1])]
        return np.diff(before[np.cumsum([0, *map(len, rows)])]), ids


@lru_cache(maxsize=1)
def table_of(path: str) -> ChunkTable:
    """One table per worker process: later batches start from the chunks of earlier ones."""
    return ChunkTable(path)


def _ids(texts: pa.Array, model_path: str) -> pa.ListArray:
    table, counts, values = table_of(model_path), [np.zeros(1, np.int64)], [np.zeros(0, np.int32)]
    for a, b in in_parts(pc.binary_length(texts).fill_null(0).to_pylist()):
        n, ids = table.encode([t or "" for t in texts.slice(a, b - a).to_pylist()])
        counts.append(n)
        values.append(ids)
    return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)).astype(np.int32)), pa.array(np.concatenate(values)))


def _texts(rows: pa.ListArray, model_path: str) -> pa.StringArray:
    decoder, texts = table_of(model_path).sp, []
    for a, b in in_parts([4 * (n or 0) for n in rows.value_lengths().to_pylist()]):
        part = [r.values.drop_null().to_numpy(zero_copy_only=False).tolist() if r.is_valid else [] for r in rows.slice(a, b - a)]
        texts.extend(decoder.decode(part))
    return pa.array(texts, pa.string())


def encode(text: Column, model_path: str) -> Column:
    """Ids of each whole text as array<int>, as the SentencePiece library gives them without begin and end ids.

    A null or empty text has no ids; any other text counts as it is, however long, and equal texts
    have equal ids. Each distinct chunk of a range of rows is segmented once and the ids joined back by
    position; tables belong to a worker, are bounded, and are worked out again where one is lost.
    """

    return F.arrow_udf(lambda texts: _ids(texts, model_path), "array<int>")(text)


def decode(ids: Column, model_path: str) -> Column:
    """The text of each array of ids, by the library's decode; null and empty arrays give the empty text.

    A null within an array is no id and is left out; an id outside the vocabulary is an error. Decoding goes through ids one by one and
    needs no table.
    """

    return F.arrow_udf(lambda rows: _texts(rows, model_path), "string")(ids)


def round_trip(text: Column, model_path: str) -> Column:
    """struct(ids, text): what ``encode`` gives, and what ``decode`` makes of it.

    Where both are asked for, ``decode(encode(text))`` beside ``encode(text)`` is put into one evaluation by Spark, which encodes each text twice.
    """

    def run(texts: pa.Array) -> pa.Array:
        ids = _ids(texts, model_path)
        return pa.StructArray.from_arrays([ids, _texts(ids, model_path)], names=["ids", "text"])

    return F.arrow_udf(run, "ids array<int>, text string")(text)
