"""Text columns through the grammar: comment lines, values, descriptors and whole frames, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticelake.functions import grammar
from latticelake.session import ship
from latticelake.types import FRAMES

#: The typer's rules for one bare token as an expression: Int before Real before Bool before Str.
_INT, _REAL, _BOOL = r"^[+-]?[0-9]+$", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eEdD][+-]?[0-9]+)?$", "^(t|T|true|True|TRUE|f|F|false|False|FALSE)$"


def kind_of(token: Column) -> Column:
    """The kind of a bare value, without Python: guarded by patterns, as casts alone are too lax."""
    whole = F.when(token.rlike(_INT), token.try_cast("bigint"))
    return F.when(whole.isNotNull(), "I").when(token.rlike(_REAL) & token.rlike("[.eEdD]"), "R").when(token.rlike(_BOOL), "L").otherwise("S")


def tokens(df: DataFrame, comment: str, *keep: str) -> DataFrame:
    """(*keep, pos, key, raw, at): the pairs of each comment line."""
    ship(df.sparkSession)
    kept = [f for f in df.schema if f.name in keep]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, p, *t) for i, line in enumerate(b.column(b.num_columns - 1).to_pylist()) for p, t in enumerate(grammar.tokenise(line))]
            take = pa.array([r[0] for r in rows], pa.int64())
            made = [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.string(), pa.string(), pa.int32()), 1)]
            yield pa.record_batch([*(b.column(i).take(take) for i in range(len(kept))), *made], [*(f.name for f in kept), "pos", "key", "raw", "at"])

    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in kept)
    return df.select(*(f.name for f in kept), comment).mapInArrow(run, f"{schema}pos int, key string, raw string, at int")


def typed(df: DataFrame, raw: str, *keep: str) -> DataFrame:
    """(*keep, kind, shape): what each raw value is."""
    ship(df.sparkSession)
    kept = [f for f in df.schema if f.name in keep]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for b in batches:
            out = []
            for v in b.column(b.num_columns - 1).to_pylist():
                if v not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[v] = grammar.type_value(v)[:2]
                out.append(known[v])
            yield pa.record_batch(
                [*(b.column(i) for i in range(len(kept))), pa.array([k for k, _ in out], pa.string()), pa.array([list(s) for _, s in out], pa.list_(pa.int32()))], [*(f.name for f in kept), "kind", "shape"]
            )

    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in kept)
    return df.select(*(f.name for f in kept), raw).mapInArrow(run, f"{schema}kind string, shape array<int>")


def described(df: DataFrame, descriptor: str, *keep: str) -> DataFrame:
    """(*keep, pos, name, kind, width): the columns that descriptors declare; expressions alone, for well-formed ones."""
    parts = F.split(descriptor, ":")
    each = F.transform(F.sequence(F.lit(0), (F.size(parts) / 3).cast("int") - 1), lambda i: F.struct(F.get(parts, i * 3).alias("name"), F.get(parts, i * 3 + 1).alias("kind"), F.get(parts, i * 3 + 2).cast("int").alias("width")))
    return df.select(*keep, F.posexplode(each).alias("pos", "c")).select(*keep, "pos", "c.*")


def parsed(df: DataFrame, text: str = "text") -> DataFrame:
    """Frames in the canonical schema from rows (source, frame_index, text), one frame of text each."""
    ship(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from latticelake.sources.xyzframes import frames_batch

        for b in batches:
            made, sources = [], b.column(0).to_pylist()
            for i, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                head, note, block = (t.encode().split(b"\n", 2) + [b"", b""])[:3]
                made.append(grammar.frame(head, note, block, i, 0, 1))
            for source in dict.fromkeys(sources):
                own = [f for f, s in zip(made, sources, strict=True) if s == source]
                yield frames_batch(own, source, [None] * len(own))

    return df.select("source", "frame_index", text).mapInArrow(run, FRAMES)


def encoded(frames: DataFrame) -> DataFrame:
    """(source, frame_index, text): each frame serialised."""
    ship(frames.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from latticelake.sources.sink import row_text

        for b in batches:
            rows = b.to_pylist()
            yield pa.record_batch([b.column(0), b.column(1), pa.array([row_text(r) for r in rows], pa.string())], ["source", "frame_index", "text"])

    return frames.select("source", "frame_index", "n_atoms", "columns", "metadata").mapInArrow(run, "source string, frame_index bigint, text string")
