"""The ``xyzframes`` data source: extended-XYZ files as rows of frames, of an index or of atoms.

Options: ``compression``, ``member`` (``*`` for every member of an archive), ``mode``
(``frames``, ``scan``, ``atoms`` or ``schema``), ``index`` (a selection in the index grammar, forward
only), ``withVolume``, ``columns`` (comma-separated names to keep), ``onError``
(``FAILFAST`` or ``PERMISSIVE``) and ``splitBytes``.

A task reads one file; a plain file beyond ``splitBytes`` is cut into ranges of whole
frames first, by counting newlines only. Filters on ``frame_index`` reach the reader, which
skips other frames uncopied and stops behind the last one asked for, so damage further on
goes unseen.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from latticelake.errors import ParseError
from latticelake.functions import grammar
from latticelake.sources import codecs
from latticelake.sources.index import Lines, walk
from latticelake.types import FRAMES, INDEX, RawFrame

SPLIT_BYTES = 128 << 20
#: Atoms or frames of one Arrow batch.
BATCH_ATOMS, BATCH_FRAMES = 200_000, 2_000
_ERROR = pa.struct([("line", pa.int64()), ("column", pa.int32()), ("message", pa.string()), ("is_io", pa.bool_())])
#: What a file holds, folded by the task that parses it: a row for each signature of a column or metadata key, for each frame size, and for a fault.
SCHEMA = (
    "source string, axis string, name string, kind string, extent array<int>, n_atoms bigint, frames bigint, first_frame bigint, first_pos int, "
    "error struct<line:bigint,column:int,message:string,is_io:boolean>"
)
ATOMS = "source string, frame_index bigint, atom_index bigint, name string, kind string, component int, r double, i bigint, b boolean, s string"


@dataclass
class Range(InputPartition):
    path: str
    member: str | None
    offset: int = 0
    line: int = 1
    index: int = 0
    limit: int | None = None
    #: Of one large frame only some rows: the first, how many, and the frame's comment line.
    rows: tuple[int, int, bytes] | None = None
    #: Frames at the start that another range reads.
    skip: int = 0


@dataclass
class Wanted:
    """Which frame indices are asked for: bounds, a step, or a set."""

    low: int = 0
    high: int | None = None
    step: tuple[int, int] | None = None
    only: frozenset[int] | None = None

    def __call__(self, i: int) -> bool:
        return i >= self.low and (self.high is None or i <= self.high) and (self.step is None or (i - self.step[0]) % self.step[1] == 0) and (self.only is None or i in self.only)

    def narrow(self, low: int | None = None, high: int | None = None, only: set[int] | None = None) -> None:
        if low is not None:
            self.low = max(self.low, low)
        if high is not None:
            self.high = high if self.high is None else min(self.high, high)
        if only is not None:
            self.only = frozenset(only) if self.only is None else self.only & only
            self.narrow(high=max(only, default=-1))


def wanted_of(option: str | None) -> Wanted:
    """A forward selection: an index, ``start:stop:step`` or a comma-separated list."""
    out = Wanted()
    if not option or option == ":":
        return out
    if ":" in option:
        start, stop, step = (*(int(p) if p else None for p in option.split(":")), None)[:3]
        if (start or 0) < 0 or (stop or 0) < 0 or (step or 1) < 1:
            raise ValueError("the index option selects forward only")
        out.narrow(low=start or 0, high=None if stop is None else stop - 1)
        if step and step > 1:
            out.step = (start or 0, step)
    else:
        out.narrow(only={int(p) for p in option.split(",")})
    return out


def _lists(parts: list, kind: pa.DataType) -> pa.Array:
    """A list array from one sequence per row, None for a null row."""
    sizes = [0 if p is None else len(p) for p in parts]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    full = [p for p in parts if p is not None and len(p)]
    if kind == pa.string():
        flat = pa.array([x for p in full for x in p], kind)
    else:
        flat = pa.array(np.concatenate(full), kind) if full else pa.array([], kind)
    return pa.ListArray.from_arrays(pa.array(offsets), flat, mask=pa.array([p is None for p in parts], pa.bool_()))


_SLOTS = (("R", "r", pa.float64()), ("I", "i", pa.int64()), ("L", "b", pa.bool_()), ("S", "s", pa.string()))


def _tagged(rows: list[list[tuple]], names: tuple[str, str], third: pa.Array) -> pa.Array:
    """list<struct> of (name, kind, width or shape, values) entries, values in the slot of their kind."""
    flat = [e for row in rows for e in row]
    fields = [pa.array([e[0] for e in flat], pa.string()), pa.array([e[1] for e in flat], pa.string()), third]
    fields += [_lists([e[3] if e[1] == kind else None for e in flat], t) for kind, _, t in _SLOTS]
    struct = pa.StructArray.from_arrays(fields, [names[0], "kind", names[1], *(s for _, s, _ in _SLOTS)])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)), struct)


def frames_batch(frames: list[RawFrame], source: str, errors: list[tuple | None]) -> pa.RecordBatch:
    """Frames as one Arrow batch in the canonical schema."""
    columns, entries = [f.columns for f in frames], [f.metadata for f in frames]
    width = pa.array([e[2] for row in columns for e in row], pa.int32())
    shape = _lists([np.array(e[2], np.int32) for row in entries for e in row], pa.int32())
    error = _errors(errors)
    ints = [pa.array([getattr(f, n) for f in frames], pa.int64()) for n in ("index", "offset", "line", "n_atoms")]
    return pa.record_batch(
        [pa.array([source] * len(frames), pa.string()), *ints, _tagged(columns, ("name", "width"), width), _tagged(entries, ("key", "shape"), shape), error],
        ["source", "frame_index", "offset", "line", "n_atoms", "columns", "metadata", "error"],
    )


def _errors(errors: list[tuple | None]) -> pa.Array:
    return pa.array([None if e is None else dict(zip(("line", "column", "message", "is_io"), e, strict=True)) for e in errors], _ERROR)


class Fold:
    """The signatures of frames as they pass: those of columns count at each occurrence, of a repeated key only the last."""

    def __init__(self):
        self.seen: dict[tuple, list[int]] = {}
        self.sizes: Counter[int] = Counter()

    def add(self, f: RawFrame) -> None:
        self.sizes[f.n_atoms] += 1
        last = {m[0]: i for i, m in enumerate(f.metadata)}
        sign = tuple(c[:3] for c in f.columns), tuple(m[:3] for i, m in enumerate(f.metadata) if last[m[0]] == i)
        self.seen.setdefault(sign, [0, f.index])[0] += 1

    def batch(self, source: str, fault: tuple | None, at: int) -> pa.RecordBatch:
        found: dict[tuple, list] = {}
        for (columns, entries), (frames, first) in self.seen.items():
            each = [("column", n, k, (w,), i) for i, (n, k, w) in enumerate(columns)] + [("metadata", n, k, tuple(shape), i) for i, (n, k, shape) in enumerate(entries)]
            for *key, pos in each:
                have = found.setdefault(tuple(key), [0, (first, pos)])
                have[0] += frames
                have[1] = min(have[1], (first, pos))
        out = [(*key, None, n, *first, None) for key, (n, first) in found.items()]
        out += [("atoms", None, None, None, size, n, None, None, None) for size, n in self.sizes.items()]
        if fault:
            out.append(("error", None, None, None, None, 0, at, 0, fault))
        axis, name, kind, extent, size, frames, first, pos, errors = zip(*out, strict=True) if out else [()] * 9
        kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        made = [pa.array(c, t) for c, t in zip((axis, name, kind, extent, size, frames, first, pos), kinds, strict=True)]
        return pa.record_batch([pa.array([source] * len(out), pa.string()), *made, _errors(list(errors))], ["source", "axis", "name", "kind", "extent", "n_atoms", "frames", "first_frame", "first_pos", "error"])


def _atoms_batch(frames: list[RawFrame], source: str, first: int = 0) -> pa.RecordBatch:
    """One row for each atom, column and component; ``first`` is the number of the first atom."""
    cols: dict[str, list] = {n: [] for n in ("frame", "atom", "name", "kind", "component")}
    slots: dict[str, list] = {k: [] for k, _, _ in _SLOTS}
    total = 0
    for f in frames:
        for name, kind, width, values in f.columns:
            n = f.n_atoms * width
            cols["frame"].append(np.full(n, f.index))
            cols["atom"].append(np.repeat(np.arange(first, first + f.n_atoms), width))
            cols["component"].append(np.tile(np.arange(width, dtype=np.int32), f.n_atoms))
            cols["name"] += [name] * n
            cols["kind"] += [kind] * n
            for k, _, t in _SLOTS:
                slots[k].append(pa.array(values, t) if k == kind else pa.nulls(n, t))
            total += n
    join = lambda parts, t: pa.array(np.concatenate(parts), t) if parts else pa.array([], t)
    made = [pa.array([source] * total, pa.string()), join(cols["frame"], pa.int64()), join(cols["atom"], pa.int64()), pa.array(cols["name"], pa.string()), pa.array(cols["kind"], pa.string()), join(cols["component"], pa.int32())]
    made += [pa.concat_arrays(slots[k]) if slots[k] else pa.array([], t) for k, _, t in _SLOTS]
    return pa.record_batch(made, ["source", "frame_index", "atom_index", "name", "kind", "component", "r", "i", "b", "s"])


class FramesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.paths = codecs.expand(options["path"])
        self.mode = options.get("mode", "frames")
        self.compression = options.get("compression", "infer")
        self.member = options.get("member")
        self.permissive = options.get("onerror", "FAILFAST").upper() == "PERMISSIVE"
        self.volume = options.get("withvolume", "false").lower() == "true"
        self.columns = set(options["columns"].split(",")) if options.get("columns") else None
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.wanted = wanted_of(options.get("index"))

    def partitions(self) -> list[Range]:
        out: list[Range] = []
        for path in self.paths:
            if self.member == "*":
                out += [Range(path, m) for m in codecs.members(path, self.compression)]
            elif codecs.is_remote(path) or os.path.getsize(path) <= self.split or not codecs.splittable(path, self.compression):
                out.append(Range(path, self.member))
            else:
                out += self._rows(path) if self.mode == "atoms" else self._ranges(path)
        return out

    def _rows(self, path: str) -> Iterator[Range]:
        """As ``_ranges``, with a frame beyond ``splitBytes`` cut into ranges of its rows."""
        for part in self._ranges(path):
            end = None
            with open(path, "rb") as f:
                f.seek(part.offset)
                lines = Lines(f, part.offset)
                n = grammar.count_at(lines.line() or b"", part.index, part.line) if part.limit == 1 else 0
                note = lines.line() if n else None
                if n and note is not None and part.limit == 1:
                    at, lo = lines.at, 0
                    lines.many(n, False)
                    end = lines.at
                    step = max(1, n * self.split // max(1, end - at))
                    if step < n:
                        f.seek(at)
                        lines = Lines(f, at)
                        while lo < n:
                            yield Range(path, None, lines.at, part.line + 2 + lo, part.index, 1, (lo, min(step, n - lo), note))
                            lines.many(min(step, n - lo), False)
                            lo += step
                        continue
            yield part

    def _ranges(self, path: str) -> Iterator[Range]:
        """Ranges of whole frames of about ``splitBytes``; what fails to scan is left to the last task, which reports it in order."""
        start, n, done, failed = None, 0, None, False
        try:
            with open(path, "rb") as f:
                for s in walk(f, last=self.wanted.high, blocks=False):
                    alone = self.mode == "atoms" and s.n_atoms * 8 >= self.split  # a large frame gets a range of its own
                    if start is not None and (alone or s.offset - start.offset >= self.split):
                        yield Range(path, None, start.offset, start.line, start.index, n)
                        start, n = None, 0
                    if alone:
                        yield Range(path, None, s.offset, s.line, s.index, 1)
                        done = s
                        continue
                    start = start or s
                    n += 1
        except (ParseError, OSError):
            failed = True
        if start is None and failed and done is not None:
            yield Range(path, None, done.offset, done.line, done.index, skip=1)
        elif start is not None or done is None:
            yield Range(path, None, *((start.offset, start.line, start.index) if start else ()))

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        source = part.path if part.member is None else f"{part.path}!{part.member}"
        if part.rows is not None:
            yield self._part_of_frame(part, source)
            return
        scan = self.mode == "scan"
        fold = Fold() if self.mode == "schema" else None
        held: list = []
        atoms = 0
        fault: tuple | None = None
        at = (part.index, part.offset, part.line)
        try:
            with codecs.open_decoded(part.path, self.compression, part.member) as f:
                if part.offset:
                    f.seek(part.offset)
                want = self.wanted if not part.skip else lambda i: i >= part.index + part.skip and self.wanted(i)
                for s in walk(f, want, self.wanted.high, notes=self.volume or not scan, blocks=not scan, index=part.index, offset=part.offset, line=part.line, limit=part.limit):
                    at = (s.index, s.offset, s.line)
                    if fold:
                        fold.add(self._parsed(s))
                    else:
                        held.append(s if scan else self._parsed(s))
                    at = (s.index + 1, s.offset, s.line + s.n_atoms + 2)
                    atoms += s.n_atoms
                    if len(held) >= BATCH_FRAMES or (held and atoms >= BATCH_ATOMS and not scan):
                        yield self._batch(held, source)
                        held, atoms = [], 0
        except ParseError as e:
            if not self.permissive:
                raise
            fault = (e.line, e.column, str(e), False)
        except OSError as e:
            if not self.permissive:
                raise
            fault = (at[2], None, str(e), True)
        if fold:
            yield fold.batch(source, fault, at[0])
        if held:
            yield self._batch(held, source)
        if fault and self.mode == "frames":
            yield frames_batch([RawFrame(*at, 0)], source, [fault])

    def _part_of_frame(self, part: Range, source: str) -> pa.RecordBatch:
        lo, n, note = part.rows
        if not self.wanted(part.index):
            return _atoms_batch([], source)
        with open(part.path, "rb") as f:
            f.seek(part.offset)
            block = Lines(f, part.offset).many(n, True)
        try:
            columns, _ = grammar.comment(note.decode().rstrip("\r"))
            have = block.count(b"\n") + (1 if block and not block.endswith(b"\n") else 0)
            parsed = grammar.rows(block, min(n, have), columns, part.line)
            if have < n:
                raise ParseError("missing atom line", line=part.line + have)
        except ParseError as e:
            if not self.permissive:
                raise ParseError(e.bare, part.index, e.line, e.column) from None
            return _atoms_batch([], source)
        kept = [c for c in parsed if self.columns is None or c[0] in self.columns]
        return _atoms_batch([RawFrame(part.index, part.offset, part.line, n, kept)], source, lo)

    def _parsed(self, s) -> RawFrame:
        out = grammar.frame(s.head, s.note, s.block, s.index, s.offset, s.line)
        if self.columns is not None:
            out.columns = [c for c in out.columns if c[0] in self.columns]
        return out

    def _batch(self, held: list, source: str) -> pa.RecordBatch:
        if self.mode == "scan":
            ints = [pa.array([getattr(s, n) for s in held], pa.int64()) for n in ("index", "offset", "line", "n_atoms")]
            volumes = pa.array([grammar.lattice_volume(s.note) if self.volume else None for s in held], pa.float64())
            return pa.record_batch([pa.array([source] * len(held), pa.string()), *ints, volumes], ["source", "frame_index", "offset", "line", "n_atoms", "volume"])
        return _atoms_batch(held, source) if self.mode == "atoms" else frames_batch(held, source, [None] * len(held))


class PushingReader(FramesReader):
    """The reader that takes filters on ``frame_index``; Spark applies all filters again above it."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) == ("frame_index",):
                if isinstance(f, EqualTo):
                    self.wanted.narrow(only={f.value})
                elif isinstance(f, In):
                    self.wanted.narrow(only=set(f.value))
                elif isinstance(f, GreaterThan):
                    self.wanted.narrow(low=f.value + 1)
                elif isinstance(f, GreaterThanOrEqual):
                    self.wanted.narrow(low=f.value)
                elif isinstance(f, LessThan):
                    self.wanted.narrow(high=f.value - 1)
                elif isinstance(f, LessThanOrEqual):
                    self.wanted.narrow(high=f.value)
            yield f


class XyzFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xyzframes"

    def schema(self) -> str:
        return {"frames": FRAMES, "scan": INDEX, "atoms": ATOMS, "schema": SCHEMA}[self.options.get("mode", "frames")]

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        options = {k.lower(): v for k, v in self.options.items()}
        return (PushingReader if options.get("pushfilters", "true") == "true" else FramesReader)(options)

    def writer(self, schema, overwrite: bool):  # noqa: ARG002
        from latticelake.sources.sink import FramesWriter

        return FramesWriter({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema):  # noqa: ARG002, N802
        from latticelake.streaming.files import FolderStream

        return FolderStream({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Make the source known to a session and let filters reach it."""
    from latticelake.session import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(XyzFrames)
