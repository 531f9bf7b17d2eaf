"""Scans along sorted groups in which a hot group is cut across many tasks.

A window function sends every group to one task, so a key holding a third of
the rows becomes a third of the job in one task. Here the rows are
range-partitioned on (group, order) and sorted within each partition: a hot
group fills many consecutive partitions. Each task walks its own slice in
Arrow batches and carries a state (a count, the newest row) along the group. A
group can come from earlier partitions only as a partition's first group, so
what a partition needs from the ones before it is one value: it follows from
one marker row per partition, whose number is bounded by the partition count.

Cost: range partitioning samples its input first (one extra read), then one
exchange of the rows, and one written table. That table is read twice, for the
markers (a filtered read of the keys) and for the result; both must see the
same slices, so it stands in the shared checkpoint folder and survives lost
executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fonolytics.plans.materialize import materialize

_PID, _LOCAL, _HEAD, _KIND = "_sc_pid", "_sc_local", "_sc_head", "_sc_kind"
# Kinds of rows in the written table.
_ROW, _FIRST, _LAST = 0, 1, 2


def default_partitions(df: DataFrame) -> int:
    """The session's shuffle partition count, or the input's partition count
    when the setting is not a number (some platforms use ``auto``)."""
    value = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    try:
        return int(value)
    except (TypeError, ValueError):
        return max(df.rdd.getNumPartitions(), 1)


def _cols(cols: list[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _sorted(df: DataFrame, keys: list[str], order: list[str | Column], n: int | None) -> DataFrame:
    by = [F.col(k) for k in keys] + _cols(order)
    return df.repartitionByRange(n or default_partitions(df), *by).sortWithinPartitions(*by)


def _changes(batch: pa.RecordBatch, keys: list[str], last: pa.RecordBatch | None) -> np.ndarray:
    """Whether each row's group differs from that of the row before it (``last``: the row before the batch)."""
    out = np.zeros(batch.num_rows, bool)
    out[0] = last is None
    for k in keys:
        col = batch.column(k)
        if last is not None:
            col = pa.concat_arrays([last.column(k), col])
        differ = pc.fill_null(pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)), False).to_numpy(zero_copy_only=False)
        null = pc.is_null(col).to_numpy(zero_copy_only=False)
        out[0 if last is not None else 1 :] |= differ | (null[1:] != null[:-1])
    return out


def _head_of(change: np.ndarray, in_head: bool) -> np.ndarray:
    """Rows of the partition's first group, given that the batch begins in it (or begins the partition)."""
    later = np.cumsum(change) > (1 if change[0] else 0)
    return ~later if in_head else np.zeros(len(change), bool)


def _full(batch: pa.RecordBatch, n: int, **extra) -> pa.RecordBatch:
    cols = [*batch.columns, *(pa.array(np.broadcast_to(v, n), t) for v, t in extra.values())]
    return pa.RecordBatch.from_arrays(cols, [*batch.schema.names, *extra])


def row_number_by_range(
    df: DataFrame,
    partition_by: list[str],
    order_by: list[str | Column],
    out: str = "orden",
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``out`` = 1-based row number of each row in its ``partition_by``
    group, ascending by ``order_by`` (nulls first), without a per-group task.

    ``order_by`` should make the order total, otherwise ties are numbered in
    an unspecified but consistent order.
    """
    keys = list(partition_by)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        last, count, in_head = None, 0, True

        def tagged(rows: pa.RecordBatch, local, head, kind: int) -> pa.RecordBatch:
            return _full(rows, rows.num_rows, **{_PID: (pid, pa.int32()), _LOCAL: (local, pa.int64()), _HEAD: (head, pa.bool_()), _KIND: (kind, pa.int32())})

        for batch in batches:
            if not batch.num_rows:
                continue
            change = _changes(batch, keys, last)
            head = _head_of(change, in_head)
            if last is None:
                yield tagged(batch.slice(0, 1), 0, True, _FIRST)
            place = np.arange(1, batch.num_rows + 1)
            begin = np.maximum.accumulate(np.where(change, place, 0))
            local = np.where(begin > 0, place - begin + 1, place + count)
            yield tagged(batch, local, head, _ROW)
            last, count, in_head = batch.slice(batch.num_rows - 1), int(local[-1]), bool(head[-1])
        if last is not None:
            yield tagged(last, count, in_head, _LAST)

    extra = [(_PID, T.IntegerType()), (_LOCAL, T.LongType()), (_HEAD, T.BooleanType()), (_KIND, T.IntegerType())]
    schema = T.StructType([*df.schema.fields, *[T.StructField(name, kind) for name, kind in extra]])
    walked = materialize(_sorted(df, keys, order_by, num_partitions).mapInArrow(walk, schema), "checkpoint")
    # the last group's rows of each partition, added up over the partitions before the one that asks
    marks = walked.where(F.col(_KIND) != _ROW)
    before = Window.partitionBy(*keys).orderBy(_PID, _KIND).rowsBetween(Window.unboundedPreceding, -1)
    given = F.when(F.col(_KIND) == _LAST, F.col(_LOCAL))
    offsets = marks.select(_PID, _KIND, F.sum(given).over(before).alias("_sc_offset")).where((F.col(_KIND) == _FIRST) & F.col("_sc_offset").isNotNull())
    # one row per partition at most: a bounded broadcast
    joined = walked.where(F.col(_KIND) == _ROW).join(F.broadcast(offsets.select(_PID, "_sc_offset")), _PID, "left")
    carry = F.when(F.col(_HEAD), F.coalesce("_sc_offset", F.lit(0))).otherwise(F.lit(0))
    return joined.select(*df.columns, (F.col(_LOCAL) + carry).cast("bigint").alias(out))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_time: str,
    right_time: str,
    columns: list[str],
    tie: list[str] | None = None,
    strict: bool = False,
    num_partitions: int | None = None,
) -> DataFrame:
    """Every row of ``left`` with ``columns`` of the newest ``right`` row of its keys at or before its time.

    ``strict``: before its time only. Among right rows of one time the last by
    ``tie`` counts. A left row without such a row, with a null key or a null
    time gets nulls; right rows with a null key or time match nothing. Both
    sides are put together and sorted once along (keys, time), so no pairs are
    made, however many rows a key has, and a hot key is spread over tasks.
    Columns of ``left`` named like one of ``columns`` are replaced.
    """
    tie = tie or []
    kinds = {k: left.schema[k].dataType for k in on}
    picked = F.struct(*[F.col(c) for c in columns])
    known = right.where(F.col(right_time).isNotNull())
    for k in on:
        known = known.where(F.col(k).isNotNull())
    # at one time the right rows stand before the left ones, or behind them if they must be older
    # (tie columns are null on the left, and order the right rows among themselves)
    sides = [
        left.select(*[F.col(k) for k in on], F.col(left_time).cast("timestamp").alias("_t"), F.lit(1).alias("_side"),
                    *[F.lit(None).cast(right.schema[c].dataType).alias(f"_tie{i}") for i, c in enumerate(tie)],
                    F.struct(*[F.col(c) for c in left.columns]).alias("_l"), F.lit(None).cast(right.select(picked.alias("r")).schema["r"].dataType).alias("_r")),
        known.select(*[F.col(k).cast(kinds[k]) for k in on], F.col(right_time).cast("timestamp").alias("_t"), F.lit(2 if strict else 0).alias("_side"),
                     *[F.col(c).alias(f"_tie{i}") for i, c in enumerate(tie)],
                     F.lit(None).cast(left.select(F.struct("*").alias("l")).schema["l"].dataType).alias("_l"), picked.alias("_r")),
    ]
    both = sides[0].unionByName(sides[1])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        names = [*on, "_l", "_r", _PID, _HEAD, _KIND]
        last, newest, in_head = None, None, True  # newest: the group's newest right row so far, as an array of one

        def tagged(keys: list[pa.Array], l: pa.Array, r: pa.Array, head, kind: int) -> pa.RecordBatch:
            n = len(l)
            extra = [pa.array(np.broadcast_to(v, n), t) for v, t in ((pid, pa.int32()), (head, pa.bool_()), (kind, pa.int32()))]
            return pa.RecordBatch.from_arrays([*keys, l, r, *extra], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            change = _changes(batch, on, last)
            head = _head_of(change, in_head)
            l, r = batch.column("_l"), batch.column("_r")
            none = pa.nulls(1, r.type)
            if last is None:
                yield tagged([batch.column(k).slice(0, 1) for k in on], pa.nulls(1, l.type), none, True, _FIRST)
            own = np.arange(batch.num_rows)
            side = batch.column("_side").to_numpy()
            seen = np.maximum.accumulate(np.where(side != 1, own, -1))
            begin = np.maximum.accumulate(np.where(change, own, -1))
            here = seen >= np.maximum(begin, 0)  # a right row of this batch and group
            carried = (begin < 0) & (newest is not None)  # else the one that the group brought along
            # places in [the batch's rows, the carried row, a null]
            pool = pa.concat_arrays([r, newest if newest is not None else none, none])
            place = np.where(here, seen, np.where(carried, batch.num_rows, batch.num_rows + 1))
            rows = np.flatnonzero(side == 1)
            if len(rows):
                take = pa.array(rows)
                open_head = head[rows] & ~here[rows] & ~carried[rows]
                yield tagged([batch.column(k).take(take) for k in on], l.take(take), pool.take(pa.array(place[rows])), open_head, _ROW)
            end = int(place[-1])
            newest = pool.slice(end, 1) if end <= batch.num_rows and (here[-1] or carried[-1]) else None
            last, in_head = batch.slice(batch.num_rows - 1), bool(head[-1])
        if last is not None:
            none = pa.nulls(1, last.column("_r").type)
            yield tagged([last.column(k) for k in on], pa.nulls(1, last.column("_l").type), newest if newest is not None else none, in_head, _LAST)

    extra = [(_PID, T.IntegerType()), (_HEAD, T.BooleanType()), (_KIND, T.IntegerType())]
    schema = T.StructType([T.StructField(c, both.schema[c].dataType) for c in (*on, "_l", "_r")] + [T.StructField(n, k) for n, k in extra])
    order = ["_t", "_side", *[f"_tie{i}" for i in range(len(tie))]]
    walked = materialize(_sorted(both, on, order, num_partitions).mapInArrow(walk, schema), "checkpoint")
    marks = walked.where(F.col(_KIND) != _ROW)
    before = Window.partitionBy(*on).orderBy(_PID, _KIND).rowsBetween(Window.unboundedPreceding, -1)
    given = F.when(F.col(_KIND) == _LAST, F.col("_r"))
    brought = marks.select(_PID, _KIND, F.last(given, ignorenulls=True).over(before).alias("_brought")).where((F.col(_KIND) == _FIRST) & F.col("_brought").isNotNull())
    joined = walked.where(F.col(_KIND) == _ROW).join(F.broadcast(brought.select(_PID, "_brought")), _PID, "left")
    found = F.when(F.col(_HEAD), F.col("_brought")).otherwise(F.col("_r"))
    usable = F.col(f"_l.`{left_time}`").isNotNull()
    for k in on:
        usable = usable & F.col(k).isNotNull()
    out = joined.select("_l", F.when(usable, found).alias("_found"))
    return out.select(*[F.col(f"_l.`{c}`") for c in left.columns if c not in columns], *[F.col(f"_found.`{c}`").alias(c) for c in columns])
