"""Writing frames as extended-XYZ text, plain, gzipped or in an archive."""

from __future__ import annotations

import gzip
import io
import os
import shutil
import tarfile
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceWriter, WriterCommitMessage

from latticelake.errors import LatticeError
from latticelake.types import SLOT, Frame

_BLANK = set(" \t\n\r\x0b\x0c")


def real(x: float) -> str:
    """The shortest text that reads back as ``x``, exponents without plus sign or padding."""
    s = repr(float(x))
    if "e" not in s:
        return s
    digits, power = s.split("e")
    return f"{digits}e{int(power)}"


def _text(kind: str, value: Any) -> str:
    if kind == "R":
        return real(value)
    if kind == "L":
        return "T" if value else "F"
    return str(value)


def _entry(key: str, kind: str, shape: tuple[int, ...], values: list) -> str:
    if not shape:
        text = _text(kind, values[0])
        if kind == "S" and (not text or set(text) & _BLANK or any(c.isspace() for c in text)):
            text = f'"{text}"'
        return f"{key}={text}"
    each = [f'"{v}"' if kind == "S" else _text(kind, v) for v in values]
    if key in ("Lattice", "pbc") and len(shape) == 1 and len(values) >= 2:
        return f'{key}="{" ".join(_text(kind, v) for v in values)}"'
    if len(shape) == 2:
        rows = ["[" + ",".join(each[i : i + shape[1]]) + "]" for i in range(0, len(each), shape[1] or 1)]
        return f"{key}=[{','.join(rows)}]"
    return f"{key}=[{','.join(each)}]"


def frame_text(n_atoms: int, columns: list[tuple[str, str, int, Any]], metadata: list[tuple[str, str, tuple[int, ...], list]]) -> str:
    """One frame: count, comment (Lattice, pbc, Properties, the rest), rows (species, pos, the rest)."""
    names = [c[0] for c in columns]
    for need in ("species", "pos"):
        if need not in names:
            raise LatticeError(f"a frame without the column {need!r} cannot be written: species and pos come first in every row")
    order = sorted(range(len(columns)), key=lambda i: (0 if names[i] == "species" else 1 if names[i] == "pos" else 2, i))
    columns = [columns[i] for i in order]
    first = [e for k in ("Lattice", "pbc") for e in metadata if e[0] == k]
    rest = [e for e in metadata if e[0] not in ("Lattice", "pbc")]
    properties = "Properties=" + ":".join(f"{name}:{kind}:{width}" for name, kind, width, _ in columns)
    note = " ".join([*(_entry(*e) for e in first), properties, *(_entry(*e) for e in rest)])
    cells: list[list[str]] = []
    for _, kind, width, values in columns:
        flat = [_text(kind, v) for v in (values.tolist() if isinstance(values, np.ndarray) else values)]
        cells += [flat[j::width] for j in range(width)]
    lines = [" ".join(row) for row in zip(*cells, strict=True)]
    return "\n".join([str(n_atoms), note, *lines]) + "\n"


def row_text(row: Any) -> str:
    """One row of the canonical frames schema as text."""
    columns = [(c["name"], c["kind"], c["width"], c[SLOT[c["kind"]]] or []) for c in row["columns"] or []]
    metadata = [(m["key"], m["kind"], tuple(m["shape"] or ()), m[SLOT[m["kind"]]] or []) for m in row["metadata"] or []]
    return frame_text(row["n_atoms"], columns, metadata)


def _kind_of(value: Any) -> str:
    a = np.asarray(value)
    return {"f": "R", "i": "I", "u": "I", "b": "L"}.get(a.dtype.kind, "S")


def frame_object_text(frame: Frame) -> str:
    """A ``Frame`` of arrays as text; floats, integers and booleans of any width."""
    columns = []
    for name, values in frame.columns.items():
        a = np.asarray(values, dtype=object if isinstance(values, list) and values and isinstance(values[0], (str, list)) else None)
        kind = "S" if a.dtype == object or a.dtype.kind in "US" else _kind_of(values)
        width = a.shape[1] if a.ndim == 2 else 1
        columns.append((name, kind, width, a.ravel().tolist()))
    metadata = []
    for key, value in frame.metadata.items():
        a = np.asarray(value)
        metadata.append((key, _kind_of(value), a.shape, [str(v) for v in a.ravel()] if _kind_of(value) == "S" else a.ravel().tolist()))
    return frame_text(frame.n_atoms, columns, metadata)


def write_codec(path: str, compression: str = "infer", append: bool = False, level: int | None = None) -> str:
    """The codec of an output, refused where it cannot be written so."""
    from latticelake.sources.codecs import _SUFFIXES, CODECS

    if compression not in CODECS:
        raise ValueError(f"unknown compression {compression!r}; use one of {', '.join(CODECS)}")
    codec = compression if compression != "infer" else next((c for s, c in _SUFFIXES if path.lower().endswith(s)), "none")
    if codec == "zstd":
        raise ValueError("zstd is read only; write gzip or plain text")
    if append and codec not in ("none", "gzip"):
        raise ValueError(f"a {codec} output cannot be appended to")
    if level is not None and not 0 <= level <= 9:
        raise ValueError(f"compression level {level}: use 0 to 9")
    return codec


def _member_name(path: str) -> str:
    stem = Path(path).name
    for suffix in (".tar.gz", ".tgz", ".tar", ".zip"):
        if stem.lower().endswith(suffix):
            stem = stem[: -len(suffix)]
    return stem if stem.lower().endswith((".xyz", ".extxyz")) else stem + ".extxyz"


class Out:
    """One output file, written piece by piece; archives are put together on closing."""

    def __init__(self, path: str, append: bool = False, compression: str = "infer", level: int | None = None):
        self.path, self.level = path, level
        self.codec = write_codec(path, compression, append, level)
        self.held: io.BytesIO | None = None
        if self.codec == "none":
            self.file = open(path, "ab" if append else "wb")  # noqa: SIM115
        elif self.codec == "gzip":
            self.file = gzip.GzipFile(filename="", mode="ab" if append else "wb", compresslevel=6 if level is None else level, mtime=0, fileobj=(raw := open(path, "ab" if append else "wb")))  # noqa: SIM115
            self.raw = raw
        else:
            self.file = self.held = io.BytesIO()
        self.closed = False

    def write(self, data: bytes) -> None:
        self.file.write(data)

    def close(self) -> None:
        if self.closed:
            return
        self.closed = True
        if self.held is not None:
            data, name = self.held.getvalue(), _member_name(self.path)
            if self.codec == "zip":
                with zipfile.ZipFile(self.path, "w", zipfile.ZIP_DEFLATED, compresslevel=self.level) as z:
                    z.writestr(name, data)
            else:
                with tarfile.open(self.path, "w:gz" if self.codec == "tar.gz" else "w") as t:
                    info = tarfile.TarInfo(name)
                    info.size = len(data)
                    t.addfile(info, io.BytesIO(data))
        self.file.close()
        if self.codec == "gzip":
            self.raw.close()


@dataclass
class Part(WriterCommitMessage):
    path: str | None
    order: int


class FramesWriter(DataSourceWriter):
    """Tasks serialise their rows into part files; the commit joins them in task order into one file.

    With the option ``single=false`` the parts stay as files of their own in a folder, which
    the reader takes as well; that is the way for data beyond one file.
    """

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].removeprefix("file://")
        self.append = options.get("append", "false") == "true"
        self.compression = options.get("compression", "infer")
        self.level = int(options["level"]) if options.get("level") else None
        self.single = options.get("single", "true") == "true"
        write_codec(self.path, self.compression, self.append, self.level)
        self.parts = f"{self.path}.parts" if self.single else self.path

    def write(self, iterator: Iterator) -> Part:
        from pyspark import TaskContext

        at = TaskContext.get()
        path = os.path.join(self.parts, f"part-{at.partitionId():05d}-{at.taskAttemptId()}.extxyz")
        out = None
        for row in iterator:
            text = row_text(row).encode()
            if out is None:
                os.makedirs(self.parts, exist_ok=True)
                out = open(path, "wb")  # noqa: SIM115
            out.write(text)
        if out is not None:
            out.close()
        return Part(path if out is not None else None, at.partitionId())

    def commit(self, messages: list[Part | None]) -> None:
        done = sorted((m for m in messages if m is not None and m.path), key=lambda m: m.order)
        if not self.single:
            kept = {m.path for m in done}
            for name in os.listdir(self.parts) if os.path.isdir(self.parts) else ():
                if name.startswith("part-") and os.path.join(self.parts, name) not in kept:
                    os.remove(os.path.join(self.parts, name))
            return
        out = Out(self.path, self.append, self.compression, self.level)
        for m in done:
            with open(m.path, "rb") as f:
                shutil.copyfileobj(f, out.file, 1 << 20)
        out.close()
        shutil.rmtree(self.parts, ignore_errors=True)

    def abort(self, messages: list[Part | None]) -> None:
        if self.single:
            shutil.rmtree(self.parts, ignore_errors=True)
        else:
            for m in messages:
                if m is not None and m.path and os.path.exists(m.path):
                    os.remove(m.path)


def write_frames(frames: DataFrame, path: str, *, append: bool = False, compression: str = "infer", level: int | None = None, single: bool = True) -> None:
    """Write a frames table in the order of (source, frame_index); the bytes do not depend on the partitioning."""
    from latticelake.sources.xyzframes import register

    write_codec(path, compression, append, level)
    register(frames.sparkSession)
    ordered = frames.repartitionByRange("source", "frame_index").sortWithinPartitions("source", "frame_index").select("n_atoms", "columns", "metadata")
    writer = ordered.write.format("xyzframes").mode("append").option("append", str(append).lower()).option("compression", compression).option("single", str(single).lower())
    if level is not None:
        writer = writer.option("level", str(level))
    writer.save(path)


class Writer:
    """Incremental writing of frames, one after another; a context manager."""

    def __init__(self, path: str, *, append: bool = False, compression: str = "infer", level: int | None = None, batch: int | None = None):
        if batch is not None and batch < 1:
            raise ValueError("batch must be at least 1")
        self.out, self.batch, self.held = Out(str(path), append, compression, level), batch or 1, []

    def write(self, obj: Frame | Iterable[Frame]) -> None:
        for frame in [obj] if isinstance(obj, Frame) else obj:
            self.held.append(frame_object_text(frame).encode())
            if len(self.held) >= self.batch:
                self._flush()

    def _flush(self) -> None:
        self.out.write(b"".join(self.held))
        self.held = []

    def close(self) -> None:
        if not self.out.closed:
            self._flush()
            self.out.close()

    def __enter__(self) -> Writer:
        return self

    def __exit__(self, *exc: object) -> None:
        self.close()
