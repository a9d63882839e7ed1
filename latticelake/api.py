"""The public surface: reading, batching, scanning, inferring and writing, as DataFrames and as Python objects.

``frames``, ``atoms`` and ``index`` give DataFrames and stay distributed; ``read``,
``iread``, ``read_batch``, ``iread_batch``, ``scan`` and ``infer_schema`` give the Python
objects that one process can hold.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticelake.errors import BatchError, LatticeError, ParseError, SchemaError
from latticelake.operators import batch as batching
from latticelake.operators import infer as inferring
from latticelake.operators import match, project
from latticelake.operators.select import Index, as_option, needs_count, parse_index, select
from latticelake.plans.spec import Conformance, Mode, SchemaSpec, resolve
from latticelake.sources import codecs, sink
from latticelake.sources.xyzframes import register
from latticelake.types import DTYPES, SLOT, Batch, Frame, FrameIndex


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.master("local[*]").appName("latticelake").getOrCreate()


def _load(path: str, mode: str, compression: str = "infer", member: str | None = None, spark: SparkSession | None = None, **options: Any) -> DataFrame:
    spark = spark or session()
    register(spark)
    reader = spark.read.format("xyzframes").option("mode", mode).option("compression", compression)
    if member is not None:
        reader = reader.option("member", member)
    for k, v in options.items():
        if v is not None:
            reader = reader.option(k, str(v).lower() if isinstance(v, bool) else str(v))
    return reader.load(str(path))


def frames(path: str, **options: Any) -> DataFrame:
    """Frames in the canonical schema; options as of the data source."""
    return _load(path, "frames", **options)


def atoms(path: str, **options: Any) -> DataFrame:
    """One row for each atom, column and component."""
    return _load(path, "atoms", **options)


def index(path: str, with_volume: bool = False, **options: Any) -> DataFrame:
    """Place and size of each frame, without parsing atoms."""
    return _load(path, "scan", withVolume=with_volume, **options)


def frames_at(found: DataFrame) -> DataFrame:
    """The frames of index rows (source, offset, line, frame_index), read where they stand.

    For corpora whose index is kept as a table: index rows are dealt out and each task
    seeks in plain files, so no file is scanned again.
    """
    from latticelake.functions import grammar
    from latticelake.session import ship
    from latticelake.sources.index import walk
    from latticelake.sources.xyzframes import BATCH_FRAMES, frames_batch
    from latticelake.types import FRAMES

    ship(found.sparkSession)

    def run(batches: Iterable) -> Iterator:
        for b in batches:
            rows = sorted(zip(*(b.column(i).to_pylist() for i in range(4)), strict=True))
            for source in dict.fromkeys(r[0] for r in rows):
                held = []
                with codecs.open_raw(source) as f:
                    for _, offset, line, i in (r for r in rows if r[0] == source):
                        f.seek(offset)
                        s = next(walk(f, index=i, offset=offset, line=line, limit=1))
                        held.append(grammar.frame(s.head, s.note, s.block, i, offset, line))
                        if len(held) >= BATCH_FRAMES:
                            yield frames_batch(held, source, [None] * len(held))
                            held = []
                if held:
                    yield frames_batch(held, source, [None] * len(held))

    return found.select("source", "offset", "line", "frame_index").repartitionByRange("source", "offset").mapInArrow(run, FRAMES)


def frames_in(content: DataFrame, compression: str = "infer", member: str | None = None) -> DataFrame:
    """The frames of files that are already rows (path, content), one file in memory at a time.

    ``spark.read.format("binaryFile").load(...)`` gives such rows from any store that Spark
    reads; faults become rows with an ``error``, as in permissive reading.
    """
    import io

    from latticelake.functions import grammar
    from latticelake.session import ship
    from latticelake.sources.index import walk
    from latticelake.sources.xyzframes import BATCH_FRAMES, frames_batch
    from latticelake.types import FRAMES, RawFrame

    ship(content.sparkSession)

    def run(batches: Iterable) -> Iterator:
        for b in batches:
            for source, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held: list = []
                at, fault = (0, 0, 1), None
                try:
                    with codecs.decoded(io.BytesIO(data), codecs.codec_of_bytes(source, data[:4], compression), member) as f:
                        for s in walk(f):
                            at = (s.index, s.offset, s.line)
                            held.append(grammar.frame(s.head, s.note, s.block, s.index, s.offset, s.line))
                            at = (s.index + 1, s.offset, s.line + s.n_atoms + 2)
                            if len(held) >= BATCH_FRAMES:
                                yield frames_batch(held, source, [None] * len(held))
                                held = []
                except ParseError as e:
                    fault = (e.line, e.column, str(e), False)
                except OSError as e:
                    fault = (at[2], None, str(e), True)
                if held:
                    yield frames_batch(held, source, [None] * len(held))
                if fault:
                    yield frames_batch([RawFrame(*at, 0)], source, [fault])

    return content.select("path", "content").mapInArrow(run, FRAMES)


def _value(kind: str, shape: tuple[int, ...], values: list) -> Any:
    if not shape:
        return values[0]
    if kind == "S":
        return list(values) if len(shape) == 1 else [list(values[i : i + shape[1]]) for i in range(0, len(values), shape[1])]
    return np.array(values, DTYPES[kind]).reshape(shape)


def _column(kind: str, width: int, values: list) -> Any:
    if kind == "S":
        return list(values) if width == 1 else [list(values[i : i + width]) for i in range(0, len(values), width)]
    a = np.array(values, DTYPES[kind])
    return a if width == 1 else a.reshape(-1, width)


def frame_of(row: Any) -> Frame:
    """A row of the canonical schema as a frame of arrays."""
    columns = {c["name"]: _column(c["kind"], c["width"], c[SLOT[c["kind"]]]) for c in row["columns"]}
    return Frame(row["n_atoms"], columns, {m["key"]: _value(m["kind"], tuple(m["shape"]), m[SLOT[m["kind"]]]) for m in row["metadata"]})


def _raise_first(table: DataFrame) -> None:
    """Raise the fault of least frame index that permissive reading has found."""
    e = table.where("error is not null").orderBy("source", "frame_index").select("frame_index", "error").limit(1).collect()
    if e:
        _raise(e[0]["frame_index"], e[0]["error"])


def _raise(frame: int, fault: Any) -> None:
    if fault["is_io"]:
        raise OSError(fault["message"])
    raise ParseError(fault["message"].split(": ", 2 if fault["line"] else 1)[-1], frame, fault["line"], fault["column"])


def _check_threads(threads: int | None) -> None:
    if threads is not None and threads < 1:
        raise ValueError("threads must be at least 1")


def _policy(table: DataFrame, spec: SchemaSpec, level: Conformance, mode: Mode | None) -> DataFrame:
    """The frames that stay under a schema, reshaped in project mode (still in the canonical schema)."""
    project.check_projects(spec, mode)
    if (mode or spec.mode) == "validate":
        return match.enforce(table, spec, level)
    typed = project.project(table, spec)
    kept = project.enforce_projection(typed, level)
    return _canonical(kept, spec)


def _canonical(typed: DataFrame, spec: SchemaSpec) -> DataFrame:
    """Typed columns back in the tagged form, in the order of the spec."""
    def tagged(kind: str, values, *head) -> Any:
        slots = [(values if SLOT[kind] == s else F.lit(None)).cast(f"array<{t}>").alias(s) for s, t in (("r", "double"), ("i", "bigint"), ("b", "boolean"), ("s", "string"))]
        return F.struct(*head, *slots)

    columns = [tagged(r.kind.value, F.flatten(F.col(f"`{r.name}`")) if r.width > 1 else F.col(f"`{r.name}`"), F.lit(r.name).alias("name"), F.lit(r.kind.value).alias("kind"), F.lit(r.width).alias("width")) for r in spec.columns]
    shapes = {r.key: F.array(*(F.lit(n) for n in r.shape)).cast("array<int>") for r in spec.metadata}
    metadata = [tagged(r.kind.value, F.col(f"`{r.key}`") if r.shape else F.array(F.col(f"`{r.key}`")), F.lit(r.key).alias("key"), F.lit(r.kind.value).alias("kind"), shapes[r.key].alias("shape")) for r in spec.metadata]
    from latticelake.types import COLUMN, ENTRY

    put = lambda parts, kind: F.array(*parts).cast(f"array<{kind}>") if parts else F.array().cast(f"array<{kind}>")
    return typed.select("source", "frame_index", "line", "n_atoms", put(columns, COLUMN).alias("columns"), put(metadata, ENTRY).alias("metadata"))


def _is_corpus(path: str, member: str | None) -> bool:
    return member == "*" or len(codecs.expand(str(path))) > 1


def _one_order(found: DataFrame) -> DataFrame:
    """(source, file_index, frame_index, ...) of an index over many files: frames numbered through all of them, in the order of their sources."""
    from latticelake.operators.select import numbered

    return numbered(found.withColumnRenamed("frame_index", "file_index"), "source", "file_index")


def _renumbered(table: DataFrame, order: DataFrame) -> DataFrame:
    """Frames under the numbers that ``_one_order`` gave them."""
    return table.withColumnRenamed("frame_index", "file_index").join(order.select("source", "file_index", "frame_index"), ["source", "file_index"]).drop("file_index")


def _selected(path: str, at: Index, compression: str, member: str | None, schema: Any, conformance: Conformance, mode: Mode | None, spark: SparkSession | None) -> DataFrame:
    """The rows that an index asks for, with ``pos``.

    Without a schema only what the index needs is read. With one, the policy sees the whole
    file first and the index addresses the frames that stay.
    """
    got = parse_index(at)
    if mode is not None and schema is None:
        raise ValueError("mode needs a schema")
    if schema is None:
        if isinstance(got, list) and any(k < 0 for k in got):
            raise IndexError("an explicit list of indices must not be negative")
        if _is_corpus(path, member):
            table = frames(path, compression=compression, member=member, spark=spark, onError="PERMISSIVE")
            _raise_first(table)
            order = _one_order(index(path, compression=compression, member=member, spark=spark))
            return select(_renumbered(table, order), got, order.count() if needs_count(got) else None)
        table = frames(path, compression=compression, member=member, spark=spark, index=as_option(got), onError="PERMISSIVE")
        n = None
        if needs_count(got):
            n = index(path, compression=compression, member=member, spark=spark).count()
        _raise_first(table)
        return select(table, got, n)
    spec = resolve(schema)
    table = frames(path, compression=compression, member=member, spark=spark, onError="PERMISSIVE")
    _raise_first(table)
    from latticelake.operators.select import numbered

    kept = _policy(table, spec, conformance, mode)
    again = numbered(kept.withColumnRenamed("frame_index", "file_index"), "source", "file_index")
    return select(again, got, again.count() if needs_count(got) else None)


def _in_order(rows: DataFrame) -> Iterator[Any]:
    return rows.orderBy("pos").toLocalIterator()


def read(
    path: str, index: Index = ":", *, threads: int | None = None, schema: Any = None, conformance: Conformance = "required", mode: Mode | None = None,
    compression: str = "infer", member: str | None = None, spark: SparkSession | None = None,
) -> Frame | list[Frame]:
    """One frame for an int, else a list; ``threads`` is checked only, for tasks run the work."""
    _check_threads(threads)
    got = parse_index(index)
    out = [frame_of(r) for r in _in_order(_selected(path, got, compression, member, schema, conformance, mode, spark))]
    if isinstance(got, int):
        if not out:
            raise IndexError(f"frame index {got} out of range")
        return out[0]
    if isinstance(got, list) and len(out) < len(got):
        raise IndexError("frame index out of range")
    return out


def iread(
    path: str, index: Index = ":", *, schema: Any = None, conformance: Conformance = "required", mode: Mode | None = None,
    compression: str = "infer", member: str | None = None, spark: SparkSession | None = None,
) -> Iterator[Frame]:
    """The frames one after another, a partition at a time on the driver."""
    for row in _in_order(_selected(path, index, compression, member, schema, conformance, mode, spark)):
        yield frame_of(row)


def _batch_of(row: Any) -> Batch:
    sizes = np.array(row["n_atoms"], np.int64)
    columns = {f["name"]: _column(f["kind"], f["width"], f[SLOT[f["kind"]]]) for f in row["columns"] or ()}
    metadata = {f["name"]: _column(f["kind"], f["width"], f[SLOT[f["kind"]]]) for f in row["metadata"] or ()}
    return Batch(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), columns, metadata, np.array(row["frame_indices"], np.int64))


_NO_FRAMES = Batch(np.zeros(1, np.int64), {}, {}, np.zeros(0, np.int64))


def _stack(table: DataFrame, plan: DataFrame) -> Iterator[Batch]:
    got = batching.gathered(table, plan)
    batching.check_drift(got)
    for row in batching.assembled(got).orderBy("batch_id").toLocalIterator():
        yield _batch_of(row)


def read_batch(
    path: str, index: Index = ":", *, threads: int | None = None, schema: Any = None, conformance: Conformance = "required", mode: Mode | None = None,
    compression: str = "infer", member: str | None = None, spark: SparkSession | None = None,
) -> Batch:
    """The frames asked for in one batch, in the order asked for; indices address the file's frames."""
    _check_threads(threads)
    got = parse_index(index)
    picked = _selected(path, [got] if isinstance(got, int) and got >= 0 else got, compression, member, None, conformance, None, spark)
    if isinstance(got, list) or isinstance(got, int):
        want = len(got) if isinstance(got, list) else 1
        if (have := picked.count()) < want:
            raise IndexError(f"frame index out of range: {want - have} of the frames asked for are not in the file")
    if schema is not None:
        kept = _policy(picked.drop("pos"), resolve(schema), conformance, mode)
        picked = picked.select("frame_index", "pos").join(kept, "frame_index")
    elif mode is not None:
        raise ValueError("mode needs a schema")
    # places in the batch count what stays; repeats of a frame are rows of their own
    from pyspark.sql import Window

    placed = picked.withColumn("batch_id", F.lit(0).cast("bigint")).withColumn("pos_in_batch", (F.row_number().over(Window.partitionBy("batch_id").orderBy("pos")) - 1).cast("bigint"))
    batching.check_drift(placed)
    rows = batching.assembled(placed).collect()
    if not rows:
        if isinstance(got, slice) and got == slice(None):
            return _NO_FRAMES
        raise BatchError("batch is empty")
    return _batch_of(rows[0])


def iread_batch(
    path: str, *, frames_per_batch: int | None = None, atoms_per_batch: int | None = None, memory_scales_with: str | None = None, max_scaler: float | None = None,
    shuffle: bool = False, seed: int | None = None, threads: int | None = None, schema: Any = None, conformance: Conformance = "required", mode: Mode | None = None,
    compression: str = "infer", member: str | None = None, spark: SparkSession | None = None,
) -> Iterator[Batch]:
    """Batches under a packing plan, which is made from the index alone, before any frame is parsed."""
    _check_threads(threads)
    streaming = codecs.is_remote(str(path)) or member == "*" or not all(codecs.splittable(p, compression) for p in codecs.expand(str(path)))
    batching.check_strategy(frames_per_batch, atoms_per_batch, memory_scales_with, max_scaler, shuffle, seed, streaming)
    if mode is not None and schema is None:
        raise ValueError("mode needs a schema")
    found = index(path, with_volume=memory_scales_with == "n_atoms_x_density", compression=compression, member=member, spark=spark)
    table = frames(path, compression=compression, member=member, spark=spark, onError="PERMISSIVE")
    _raise_first(table)
    if _is_corpus(path, member):
        found = _one_order(found)
        table = _renumbered(table, found)
    plan = plan_batches(found, frames_per_batch, atoms_per_batch, memory_scales_with, max_scaler, shuffle, seed)
    if schema is not None:
        table = _policy(table, resolve(schema), conformance, mode)
        plan = plan.join(table.select("frame_index"), "frame_index")
        from pyspark.sql import Window

        plan = plan.withColumn("pos_in_batch", (F.row_number().over(Window.partitionBy("batch_id").orderBy("pos_in_batch")) - 1).cast("bigint"))
    yield from _stack(table, plan)


def plan_batches(
    found: DataFrame, frames_per_batch: int | None = None, atoms_per_batch: int | None = None, memory_scales_with: str | None = None, max_scaler: float | None = None,
    shuffle: bool = False, seed: int | None = None,
) -> DataFrame:
    """(frame_index, n_atoms, batch_id, pos_in_batch) for an index table."""
    from latticelake.operators.stats import density_weight

    order = "frame_index"
    if shuffle:
        found, order = batching.shuffled(found, found.count(), seed), "order"
    if frames_per_batch is not None:
        return batching.fixed_plan(found, frames_per_batch, order)
    if atoms_per_batch is not None:
        return batching.greedy_plan(found, atoms_per_batch, order)
    if memory_scales_with == "n_atoms_x_density":
        found = found.withColumn("weight", density_weight(F.col("n_atoms"), F.coalesce("volume", F.lit(float("nan")))))
        return batching.memory_plan(found, max_scaler, "weight")
    return batching.memory_plan(found, max_scaler)


def scan(path: str, *, with_volume: bool = False, compression: str = "infer", member: str | None = None, spark: SparkSession | None = None) -> FrameIndex:
    """Places and sizes of a file's frames; counts are trusted, contents not parsed."""
    try:
        rows = index(path, with_volume, compression=compression, member=member, spark=spark).orderBy("source", "frame_index").toPandas()
    except PySparkException as e:
        raise LatticeError(str(e).splitlines()[0]) from e
    return FrameIndex(rows["offset"].to_numpy(), rows["line"].to_numpy(), rows["n_atoms"].to_numpy(), rows["volume"].to_numpy() if with_volume else None)


def infer_schema(path: str, *, compression: str = "infer", member: str | None = None, spark: SparkSession | None = None) -> inferring.Schema:
    """The schema of all frames, folded by the tasks that parse them: files are read once."""
    rows = inferring.merged(_load(path, "schema", compression=compression, member=member, spark=spark, onError="PERMISSIVE")).collect()
    for r in rows:
        if r["axis"] == "error":
            _raise(r["first"]["first_frame"], r["error"])
    return inferring.of_folds(rows)


def write(path: str, obj: DataFrame | Frame | Iterable[Frame], *, append: bool = False, compression: str = "infer", level: int | None = None, threads: int | None = None) -> None:
    """Write a frames table, a frame or several; frames are serialised before the file is opened."""
    _check_threads(threads)
    if isinstance(obj, DataFrame):
        sink.write_frames(obj, str(path), append=append, compression=compression, level=level)
        return
    texts = [sink.frame_object_text(f).encode() for f in ([obj] if isinstance(obj, Frame) else obj)]
    if str(path) == "-":
        import sys

        sys.stdout.buffer.write(b"".join(texts))
        return
    out = sink.Out(str(path), append, compression, level)
    out.write(b"".join(texts))
    out.close()


Writer = sink.Writer
__all__ = ["BatchError", "LatticeError", "ParseError", "SchemaError", "Writer", "atoms", "frames", "frames_at", "frames_in", "index", "infer_schema", "iread", "iread_batch", "plan_batches", "read", "read_batch", "scan", "write"]
