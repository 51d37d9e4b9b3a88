"""Folds along ordered rows of a key: state machines and hash chains, with bounded memory."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from factloom.sources.shared import written


def fold(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, dict], dict], adds: str) -> DataFrame:
    """rows with the columns of ``adds``, which ``step`` gives for each row of a key in its order.

    ``start`` makes the state of a key before its first row; ``step`` takes the state, which it may change, and the row. Keys are
    dealt to tasks and sorted there, and rows go through one by one, so a task holds one state and no list of a key's rows. ``order`` should
    tell all rows of a key apart; nulls come first and a null key is a key.
    """
    shape = StructType(rows.schema.fields + StructType.fromDDL(adds).fields)
    arrow, new = to_arrow_schema(shape), [f.name for f in StructType.fromDDL(adds).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), None
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                at = tuple(row[k] for k in keys)
                if at != key:
                    key, state = at, start()
                made.append(step(state, row))
            columns = [batch.column(i).cast(arrow.field(i).type) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([m[n] for m in made], arrow.field(n).type) for n in new)], schema=arrow)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, shape)


def _chained(rows: DataFrame, subject: str, own: str, carries: dict[int, str]) -> DataFrame:
    shape = StructType(rows.schema.fields + StructType.fromDDL("previous_hash string, entry_hash string").fields)
    arrow = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, last = None, None
        for batch in batches:
            before, after = [], []
            for r, s, o in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("__range", subject, own))):
                if (r, s) != place:
                    # a range's first subject goes on from the range before, if that ended with it
                    last = carries.get(r) if place is None or place[0] != r else None
                    place = (r, s)
                before.append(last)
                last = hashlib.sha256(((last or "") + (o or "")).encode()).hexdigest()
                after.append(last)
            columns = [batch.column(i).cast(arrow.field(i).type) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(before, pa.string()), pa.array(after, pa.string())], schema=arrow)

    return rows.mapInArrow(run, shape)


def hash_chain(entries: DataFrame, subject: str, order: list[str], own: str, ranges: int | None = None) -> DataFrame:
    """entries with previous_hash and entry_hash: SHA-256 of the entry before's hash (nothing for a subject's first) and the own one.

    Entries are dealt in ranges of (subject, order), so a subject that holds a third of all rows lies in many tasks. Each
    range but the first may go on with the subject that the one before ended with, and needs that one's last hash: these are
    worked out range by range, only over rows of such subjects, and the driver holds one hash a range. A chain can't be made at several of
    its places at once; what is bounded is what a task reads. ``order`` tells a subject's entries apart; null subjects are one subject, a null
    own hash counts as empty, an empty table gives no rows.
    """
    n = ranges or entries.sparkSession.sparkContext.defaultParallelism * 4
    dealt = entries.repartitionByRange(n, F.col(subject), *order).withColumn("__range", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    edges = {r["__range"]: (r["first"], r["last"]) for r in dealt.groupBy("__range").agg(F.min(F.struct(subject)).alias("first"), F.max(F.struct(subject)).alias("last")).collect()}
    numbers = sorted(edges)
    before = {b: a for a, b in zip(numbers, numbers[1:]) if edges[a][1] == edges[b][0]}  # ranges that go on, and from which
    whole = {r for r in before if edges[r][0] == edges[r][1]}  # ranges of one subject that itself goes on
    carries: dict[int, str] = {}
    ordered = lambda df: df.repartition(n, "__range").sortWithinPartitions("__range", subject, *order)
    while len(carries) < len(before):
        ready = {a: b for b, a in before.items() if b not in carries and (a not in whole or a in carries)}
        # only rows of the subject that a range ends with
        tails = F.broadcast(entries.sparkSession.createDataFrame([(a,) for a in ready], "__range int"))
        last = dealt.groupBy("__range").agg(F.max(F.struct(subject)).alias("__last")).join(tails, "__range")
        part = dealt.join(F.broadcast(last), "__range").where(F.struct(subject).eqNullSafe(F.col("__last"))).drop("__last")
        kept = {a: carries[a] for a in ready if a in whole}
        done = _chained(ordered(part), subject, own, kept).groupBy("__range").agg(F.max_by("entry_hash", F.struct(*order)).alias("h")).collect()
        carries |= {ready[r["__range"]]: r["h"] for r in done}
    return _chained(ordered(dealt), subject, own, carries).drop("__range")


def broken_chains(entries: DataFrame, subject: str, order: list[str], own: str, stored: str, ranges: int | None = None) -> DataFrame:
    """For each subject its entries, how many of them have another stored hash than the chain made again gives, and the first of these.

    A changed entry changes its own hash and those of all later entries of its subject.
    """
    again = hash_chain(entries, subject, order, own, ranges)
    bad = ~F.col(stored).eqNullSafe(F.col("entry_hash"))
    first = F.min(F.when(bad, F.struct(*order))).getField(order[-1])
    return again.groupBy(subject).agg(F.count("*").alias("n"), F.count_if(bad).alias("n_bad"), first.alias("first_bad"))


def compact_json(fields: dict[str, Column]) -> Column:
    """Fields as compact JSON in ASCII, keys in order: what Python's json.dumps gives with sort_keys, ensure_ascii and no spaces.

    Strings, whole numbers and booleans; null is null. Characters beyond ASCII are \\u and four hex digits for each UTF-16 unit.
    """
    short = {"0008": "\\b", "0009": "\\t", "000A": "\\n", "000C": "\\f", "000D": "\\r", "0022": '\\"', "005C": "\\\\"}

    def quoted(c: Column) -> Column:
        units = F.regexp_extract_all(F.hex(F.encode(c, "UTF-16BE")), F.lit("(.{4})"), F.lit(1))

        def shown(u: Column) -> Column:
            known = F.when(u == "0008", short["0008"])
            for k, v in list(short.items())[1:]:
                known = known.when(u == k, v)
            return known.when(u.between("0020", "007E"), F.decode(F.unhex(F.substring(u, 3, 2)), "UTF-8")).otherwise(F.concat(F.lit("\\u"), F.lower(u)))

        plain = c.rlike(r'^[ !#-\[\]-~]*$')
        return F.concat(F.lit('"'), F.when(plain, c).otherwise(F.array_join(F.transform(units, shown), "")), F.lit('"'))

    parts = []
    for n, k in enumerate(sorted(fields)):
        kind = fields[k]
        value = F.when(F.typeof(kind) == "string", quoted(kind.cast("string"))).otherwise(kind.cast("string"))
        parts += [F.lit(("{" if n == 0 else ",") + f'"{k}":'), F.coalesce(value, F.lit("null"))]
    return F.concat(*parts, F.lit("}")) if parts else F.lit("{}")
