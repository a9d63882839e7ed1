"""Positional selection of frames: indices, slices and explicit lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticelake.session import materialize

Index = int | slice | str | Sequence[int]


def parse_index(index: Index) -> int | slice | list[int]:
    """An int, a slice or a list from what a caller may pass; strings are ``5``, ``1:10:2`` and the like."""
    if isinstance(index, str):
        parts = index.split(":")
        if len(parts) == 1:
            return int(parts[0])
        if len(parts) > 3:
            raise ValueError(f"invalid index {index!r}")
        return slice(*(int(p) if p.strip() else None for p in parts))
    if isinstance(index, (int, slice)):
        return index
    return [int(i) for i in index]


def needs_count(index: int | slice | list[int]) -> bool:
    """Whether the number of frames must be known before the selection is."""
    if isinstance(index, int):
        return index < 0
    return isinstance(index, slice) and ((index.start or 0) < 0 or (index.stop or 0) < 0 or (index.step or 1) < 0)


def as_option(index: int | slice | list[int]) -> str | None:
    """The reader's ``index`` option for a forward selection; None where the count is needed."""
    if needs_count(index):
        return None
    if isinstance(index, int):
        return str(index)
    if isinstance(index, slice):
        return ":".join("" if p is None else str(p) for p in (index.start, index.stop, index.step or 1))
    return ",".join(map(str, sorted(set(index)))) if index else "0:0:1"


def numbered(df: DataFrame, *order: str, by: str | None = None) -> DataFrame:
    """Rows numbered from 0 in the given order as ``frame_index``, within each ``by`` if given.

    Without ``by`` the number is a two-level prefix sum over range partitions, so that no
    task sees all rows.
    """
    if by is not None:
        return df.withColumn("frame_index", (F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1).cast("bigint"))
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__mono", F.monotonically_increasing_id())
    # written once: bounds of a range partitioning are sampled, so a second evaluation could differ
    parts = materialize(parts.withColumn("__part", F.shiftright("__mono", 33)), "numbered")
    return _with_start(parts, F.count("*")).withColumn("frame_index", (F.col("__start") + F.col("__mono").bitwiseAND((1 << 33) - 1)).cast("bigint")).drop("__mono", "__part", "__start")


def _with_start(parts: DataFrame, size) -> DataFrame:
    """Rows with what all partitions before theirs sum up to; there is one sum for each partition."""
    sizes = parts.groupBy("__part").agg(size.alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.join(F.broadcast(sizes.select("__part", before.alias("__start"))), "__part")


def running(df: DataFrame, value: str, name: str, *order: str) -> DataFrame:
    """``name``: the sum of ``value`` over all rows before, in the given order; partitions first, then within each."""
    parts = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    parts = materialize(parts, "running")
    within = F.coalesce(F.sum(value).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return _with_start(parts, F.sum(value)).withColumn(name, (F.col("__start") + within).cast("bigint")).drop("__part", "__start")


def select(frames: DataFrame, index: Index, n_frames: int | None = None) -> DataFrame:
    """The frames asked for, as ``pos`` (place in the answer) and the frames' columns.

    A forward slice is a predicate on frame_index; a list keeps its order and repeats
    through a join with its (pos, frame_index) rows.
    """
    got = parse_index(index)
    if needs_count(got) and n_frames is None:
        n_frames = frames.agg(F.coalesce(F.max("frame_index") + 1, F.lit(0))).first()[0]
    i = F.col("frame_index")
    if isinstance(got, int):
        want = got if got >= 0 else n_frames + got
        if want < 0:
            raise IndexError(f"frame index {got} out of range: file has {n_frames} frames")
        return frames.where(i == want).withColumn("pos", F.lit(0).cast("bigint"))
    if isinstance(got, slice):
        if needs_count(got):
            start, stop, step = got.indices(n_frames)
        else:
            start, stop, step = got.start or 0, got.stop, got.step or 1
        if step == 0:
            raise ValueError("slice step cannot be zero")
        if step > 0:
            inside = (i >= start) & ((i - start) % step == 0)
            out = frames.where(inside if stop is None else inside & (i < stop))
        else:
            out = frames.where((i <= start) & (i > stop) & ((F.lit(start) - i) % -step == 0))
        return out.withColumn("pos", ((i - start) / step).cast("bigint"))
    if any(k < 0 for k in got):
        raise IndexError("an explicit list of indices must not be negative")
    asked = frames.sparkSession.createDataFrame([(p, k) for p, k in enumerate(got)], "pos bigint, frame_index bigint")
    return frames.join(F.broadcast(asked) if len(got) < 1_000_000 else asked, "frame_index")
