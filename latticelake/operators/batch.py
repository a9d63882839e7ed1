"""Batches: plans that pack frames, and dense assembly of what is packed together."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticelake.errors import BatchError
from latticelake.session import ship
from latticelake.types import SLOT


def check_strategy(
    frames_per_batch: int | None = None, atoms_per_batch: int | None = None, memory_scales_with: str | None = None, max_scaler: float | None = None,
    shuffle: bool = False, seed: int | None = None, streaming_only: bool = False,
) -> None:
    """Exactly one packing strategy, with sound numbers."""
    given = [x for x in (frames_per_batch, atoms_per_batch, memory_scales_with) if x is not None]
    if len(given) != 1:
        raise ValueError("give exactly one of frames_per_batch, atoms_per_batch and memory_scales_with")
    if frames_per_batch is not None and frames_per_batch < 1:
        raise ValueError("frames per batch must be at least 1")
    if atoms_per_batch is not None and atoms_per_batch < 1:
        raise ValueError("atoms per batch must be at least 1")
    if memory_scales_with is not None:
        if memory_scales_with not in ("n_atoms", "n_atoms_x_density"):
            raise ValueError(f"unknown memory scaling {memory_scales_with!r}")
        if max_scaler is None or not max_scaler > 0:
            raise ValueError("max_scaler must be greater than 0")
        if shuffle:
            raise ValueError("memory packing sets its own order; it cannot be shuffled")
    elif max_scaler is not None:
        raise ValueError("max_scaler goes with memory_scales_with")
    if seed is not None and not shuffle:
        raise ValueError("seed goes with shuffle")
    if streaming_only and (frames_per_batch is None or shuffle):
        raise ValueError("a compressed or remote source is read in one pass: only unshuffled frames_per_batch")


def fixed_plan(index: DataFrame, frames_per_batch: int, order: str = "frame_index") -> DataFrame:
    """Every ``frames_per_batch`` frames in a row are a batch; (frame_index, n_atoms, batch_id, pos_in_batch)."""
    at = F.col(order)
    return index.select("frame_index", "n_atoms", F.floor(at / frames_per_batch).cast("bigint").alias("batch_id"), (at % frames_per_batch).cast("bigint").alias("pos_in_batch"))


def shuffled(index: DataFrame, n_frames: int, seed: int | None) -> DataFrame:
    """The index with ``order``: the place of each frame in numpy's seeded permutation.

    The permutation is NumPy's own, so it is made on the driver, from the number of frames.
    """
    order = np.random.default_rng(seed).permutation(np.arange(n_frames))
    asked = index.sparkSession.createDataFrame(pa.table({"order": np.arange(n_frames), "frame_index": order}))
    return index.join(asked, "frame_index")


def _packed(index: DataFrame, sort: list, columns: list[str], fold) -> DataFrame:
    """An order-bound fold over the index rows (three numbers a frame), streamed through one task."""
    ship(index.sparkSession)
    # a shuffle, so that only the fold and not the scan above it runs in one task
    ordered = index.select(*columns).repartition(1).sortWithinPartitions(*sort)
    return ordered.mapInArrow(fold, "frame_index bigint, n_atoms bigint, batch_id bigint, pos_in_batch bigint")


def _plan_batch(index: np.ndarray, atoms: np.ndarray, batch: list[int], pos: list[int]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(index, pa.int64()), pa.array(atoms, pa.int64()), pa.array(batch, pa.int64()), pa.array(pos, pa.int64())], ["frame_index", "n_atoms", "batch_id", "pos_in_batch"])


def greedy_plan(index: DataFrame, atoms_per_batch: int, order: str = "frame_index") -> DataFrame:
    """Frames in order; the next frame that would pass the budget opens a batch, a larger one is alone."""

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, held, pos, first = 0, 0, 0, True
        for b in batches:
            index, atoms = b.column(0).to_numpy(), b.column(1).to_numpy()
            ids, places = [], []
            for n in atoms.tolist():
                if not first and held + n > atoms_per_batch:
                    batch, held, pos = batch + 1, 0, 0
                ids.append(batch)
                places.append(pos)
                held, pos, first = held + n, pos + 1, False
            yield _plan_batch(index, atoms, ids, places)

    return _packed(index, [order], list(dict.fromkeys(["frame_index", "n_atoms", order])), fold)


def memory_plan(index: DataFrame, max_scaler: float, weight: str = "n_atoms") -> DataFrame:
    """Best fit, heaviest first: a frame goes to the fullest batch with room (the first of equals), else opens one.

    Sums of weights are kept in a sorted list, so that the fullest bin with room is found by bisection.
    """

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right, insort

        bins: list[tuple[float, int]] = []  # (sum, -bin), so that the last of equal sums is the first bin
        counts: list[int] = []
        for b in batches:
            index, atoms, weights = (b.column(i).to_numpy() for i in range(3))
            ids, places = [], []
            for w in weights.tolist():
                i = bisect_right(bins, (max_scaler - w, 1)) - 1
                while i >= 0 and bins[i][0] + w > max_scaler:  # rounding of the difference
                    i -= 1
                while i + 1 < len(bins) and bins[i + 1][0] + w <= max_scaler:
                    i += 1
                if i < 0:
                    k, total = len(counts), w
                    counts.append(0)
                else:
                    total, k = bins[i][0] + w, -bins[i][1]
                    del bins[i]
                insort(bins, (total, -k))
                ids.append(k)
                places.append(counts[k])
                counts[k] += 1
            yield _plan_batch(index, atoms, ids, places)

    weighted = index.select("frame_index", "n_atoms", F.col(weight).cast("double").alias("__w"))
    return _packed(weighted, [F.desc("__w"), "frame_index"], ["frame_index", "n_atoms", "__w"], fold)


def with_offsets(plan: DataFrame) -> DataFrame:
    """The plan with ``atom_offset``: atoms of the batch before each frame."""
    before = Window.partitionBy("batch_id").orderBy("pos_in_batch").rowsBetween(Window.unboundedPreceding, -1)
    return plan.withColumn("atom_offset", F.coalesce(F.sum("n_atoms").over(before), F.lit(0)).cast("bigint"))


def gathered(frames: DataFrame, plan: DataFrame) -> DataFrame:
    """Frames with their batch and place in it."""
    return frames.join(plan.select("frame_index", "batch_id", "pos_in_batch"), "frame_index")


def _width(entry):
    """The flat width of a metadata entry."""
    return F.aggregate(entry["shape"], F.lit(1), lambda a, d: a * d)


def _entries(gathered: DataFrame) -> DataFrame:
    """(batch_id, pos_in_batch, axis, name, kind, width, pos): every column and metadata entry of planned frames."""
    columns = gathered.select("batch_id", "pos_in_batch", F.lit("column").alias("axis"), F.posexplode("columns").alias("pos", "e")).select("batch_id", "pos_in_batch", "axis", F.col("e.name").alias("name"), "e.kind", F.col("e.width").alias("width"), "pos")
    metadata = gathered.select("batch_id", "pos_in_batch", F.lit("metadata").alias("axis"), F.posexplode("metadata").alias("pos", "e")).select("batch_id", "pos_in_batch", "axis", F.col("e.key").alias("name"), "e.kind", _width(F.col("e")).cast("int").alias("width"), "pos")
    return columns.union(metadata)


def drift(gathered: DataFrame) -> DataFrame:
    """(batch_id, pos_in_batch, axis, name, deviation, expected, found): how frames differ from their batch's first.

    Names, kinds and widths of the first frame are the contract; Int and Real of one width
    go together.
    """
    entries = _entries(gathered).groupBy("batch_id", "pos_in_batch", "axis", "name").agg(F.max_by(F.struct("kind", "width"), "pos").alias("e"))
    first = entries.where("pos_in_batch = 0").select("batch_id", "axis", "name", F.col("e").alias("c"))
    later = gathered.where("pos_in_batch > 0").select("batch_id", "pos_in_batch")
    wanted = later.join(first, "batch_id")
    keys = ["batch_id", "pos_in_batch", "axis", "name"]
    both = wanted.join(entries, keys, "left")
    numbers = F.col("e.kind").isin("I", "R") & F.col("c.kind").isin("I", "R")
    bad = F.col("e").isNull() | (F.col("e.width") != F.col("c.width")) | ((F.col("e.kind") != F.col("c.kind")) & ~numbers)
    say = lambda s: F.concat_ws(":", F.col(f"{s}.kind"), F.col(f"{s}.width").cast("string"))
    changed = both.where(bad).select(*keys, F.when(F.col("e").isNull(), "missing").otherwise("mismatch").alias("deviation"), say("c").alias("expected"), F.when(F.col("e").isNotNull(), say("e")).alias("found"))
    new = entries.where("pos_in_batch > 0").join(first, ["batch_id", "axis", "name"], "left_anti")
    return changed.union(new.select(*keys, F.lit("unexpected").alias("deviation"), F.lit(None).cast("string").alias("expected"), say("e").alias("found")))


def check_drift(gathered: DataFrame) -> None:
    """Raise what the first frame out of line has first: columns before metadata, missing or changed before unexpected."""
    rank = F.struct("batch_id", "pos_in_batch", F.col("axis"), F.col("deviation") == "unexpected", "name")
    found = drift(gathered).orderBy(rank).limit(1).collect()
    if not found:
        return
    r = found[0]
    where = f"{r['axis']} \"{r['name']}\""
    if r["deviation"] == "mismatch":
        raise BatchError(f"frame {r['pos_in_batch']} {where}: expected {r['expected']}, found {r['found']}")
    raise BatchError(f"frame {r['pos_in_batch']} {'is missing' if r['deviation'] == 'missing' else 'has unexpected'} {where}")


def assembled(gathered: DataFrame) -> DataFrame:
    """One row for each batch: frame indices, atoms of each, and every field of its frames one behind the other.

    ``columns`` and ``metadata`` are arrays of (name, kind, width, values...), a kind being
    Real where Int and Real meet.
    """

    def stacked(of: str, key: str, width) -> DataFrame:
        e = gathered.select("batch_id", "pos_in_batch", F.posexplode(of).alias("at", "e")).select("batch_id", "pos_in_batch", "at", F.col(f"e.{key}").alias("name"), "e")
        last = e.groupBy("batch_id", "name", "pos_in_batch").agg(F.max_by(F.struct("at", "e"), "at").alias("x")).select("batch_id", "name", "pos_in_batch", "x.at", "x.e")
        rows = last.groupBy("batch_id", "name").agg(F.array_sort(F.collect_list(F.struct("pos_in_batch", "at", "e"))).alias("x"))
        real = F.exists("x", lambda v: v["e"]["kind"] == "R") & F.forall("x", lambda v: v["e"]["kind"].isin("I", "R"))
        kind = F.when(real, "R").otherwise(F.col("x")[0]["e"]["kind"])
        both = F.flatten(F.transform("x", lambda v: F.coalesce(v["e"]["r"], v["e"]["i"].cast("array<double>"), F.array().cast("array<double>"))))
        flat = {k: F.flatten(F.transform("x", lambda v: F.coalesce(v["e"][s], F.array()))) for k, s in SLOT.items() if k != "R"}
        return rows.select(
            "batch_id", F.col("x")[0]["at"].alias("at"), F.struct(F.col("x")[0]["at"].alias("at"), "name", kind.alias("kind"), width(F.col("x")[0]["e"]).cast("int").alias("width"), F.when(kind == "R", both).alias("r"), *(F.when(kind == k, v).alias(SLOT[k]) for k, v in flat.items())).alias("field")
        ).groupBy("batch_id").agg(F.array_sort(F.collect_list("field")).alias(of))

    head = gathered.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("pos_in_batch", "frame_index", "n_atoms"))).alias("f"))
    head = head.select("batch_id", F.transform("f", lambda v: v["frame_index"]).alias("frame_indices"), F.transform("f", lambda v: v["n_atoms"]).alias("n_atoms"))
    return head.join(stacked("columns", "name", lambda e: e["width"]), "batch_id", "left").join(stacked("metadata", "key", _width), "batch_id", "left")
