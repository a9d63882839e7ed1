"""Schema inference: what columns and metadata a set of frames holds, and how they vary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticelake.types import KIND_NAMES


@dataclass(frozen=True, slots=True)
class ColumnVariant:
    kind: str
    width: int
    frames: int


@dataclass(frozen=True, slots=True)
class MetadataVariant:
    kind: str
    shape: tuple[int, ...]
    frames: int


@dataclass(frozen=True, slots=True)
class ColumnSchema:
    name: str
    variants: tuple[ColumnVariant, ...]
    frames_present: int

    @property
    def unified(self) -> tuple[str, int] | None:
        got = {(v.kind, v.width) for v in self.variants}
        if len(got) == 1:
            return got.pop()
        if len(got) == 2 and {k for k, _ in got} == {"I", "R"} and len({w for _, w in got}) == 1:
            return "R", got.pop()[1]
        return None


@dataclass(frozen=True, slots=True)
class MetadataSchema:
    key: str
    variants: tuple[MetadataVariant, ...]
    frames_present: int

    @property
    def unified(self) -> tuple[str, tuple[int, ...]] | None:
        got = {(v.kind, v.shape) for v in self.variants}
        if len(got) == 1:
            return got.pop()
        shapes = {s for _, s in got}
        if len(got) == 2 and {k for k, _ in got} == {"I", "R"} and len(shapes) == 1 and len(next(iter(shapes))) < 2:
            return "R", shapes.pop()
        return None


@dataclass(frozen=True, slots=True)
class Schema:
    n_frames: int
    total_atoms: int
    min_atoms: int | None
    max_atoms: int | None
    columns: tuple[ColumnSchema, ...]
    metadata: tuple[MetadataSchema, ...]
    mean_atoms: float | None = None
    median_atoms: float | None = None
    std_atoms: float | None = None

    @property
    def is_consistent(self) -> bool:
        return all(len(e.variants) == 1 and e.frames_present == self.n_frames for e in (*self.columns, *self.metadata))

    def report(self) -> str:
        n = self.n_frames
        lines = [f"{n} frames, {self.total_atoms} atoms" + (f" (min {self.min_atoms}, max {self.max_atoms})" if n else "")]
        for title, entries in (("per-atom columns", self.columns), ("metadata", self.metadata)):
            lines += ["", f"{title}:"]
            for e in entries:
                name = e.name if isinstance(e, ColumnSchema) else e.key
                each = ", ".join(f"{spelled(v)} ({v.frames}/{n} frames)" for v in e.variants)
                note = ""
                if len(e.variants) > 1:
                    note = " [inconsistent]" if e.unified is None else f" (unifies to {spelled_as(e, e.unified)})"
                lines.append(f"  {name}: {each}{note}")
        return "\n".join(lines) + "\n"

    __str__ = report

    def to_spec(self, *, glob_min_run: int = 3):
        from latticelake.plans.spec import spec_of

        return spec_of(self, glob_min_run)[0]


def _shape_name(kind: str, shape: tuple[int, ...]) -> str:
    base = KIND_NAMES[kind]
    return base if not shape else f"{base}Array[{shape[0]}]" if len(shape) == 1 else f"{base}Array2D[{shape[0]},{shape[1]}]"


def spelled(v: ColumnVariant | MetadataVariant) -> str:
    return f"{v.kind}:{v.width}" if isinstance(v, ColumnVariant) else _shape_name(v.kind, v.shape)


def spelled_as(e: ColumnSchema | MetadataSchema, to: tuple) -> str:
    return f"{to[0]}:{to[1]}" if isinstance(e, ColumnSchema) else _shape_name(*to)


def last_wins(entries: Column, name: str) -> Column:
    """Of entries that share a name, only the last."""
    return F.filter(entries, lambda m, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda later: later[name] == m[name]))


def fold(entries: DataFrame, name: str, signature: list[str]) -> DataFrame:
    """(name, variants, frames_present, first) from rows (name, *signature, frame_index, pos), one for each occurrence.

    Two partial aggregations: occurrences to variants, variants to names; variants come in
    the order in which they are first seen.
    """
    seen = F.min(F.struct("frame_index", "pos")).alias("first")
    variants = entries.groupBy(name, *signature).agg(F.count("*").alias("frames"), seen)
    return variants.groupBy(name).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("first", *signature, "frames"))), lambda v: F.struct(*(v[s].alias(s) for s in (*signature, "frames")))).alias("variants"),
        F.sum("frames").alias("frames_present"), F.min("first").alias("first"),
    )


def column_fold(frames: DataFrame) -> DataFrame:
    """Every occurrence of a column counts."""
    each = frames.select("frame_index", F.posexplode("columns").alias("pos", "c")).select("frame_index", "pos", "c.name", "c.kind", "c.width")
    return fold(each, "name", ["kind", "width"])


def metadata_fold(frames: DataFrame) -> DataFrame:
    """Of a key that a frame repeats only the last counts."""
    each = frames.select("frame_index", F.posexplode(last_wins(F.col("metadata"), "key")).alias("pos", "m")).select("frame_index", "pos", "m.key", "m.kind", "m.shape")
    return fold(each, "key", ["kind", "shape"])


def unified(variants: Column, extent: str) -> Column:
    """The one signature that all variants fit, as a struct, or null: a single one, or Int and Real of one extent."""
    two = (F.size(variants) == 2) & (F.array_sort(F.transform(variants, lambda v: v["kind"])) == F.array(F.lit("I"), F.lit("R"))) & (variants[0][extent] == variants[1][extent])
    if extent == "shape":
        two = two & (F.size(variants[0][extent]) < 2)
    return F.when(F.size(variants) == 1, F.struct(variants[0]["kind"].alias("kind"), variants[0][extent].alias(extent))).when(two, F.struct(F.lit("R").alias("kind"), variants[0][extent].alias(extent)))


def _schema(sizes: tuple, columns: list, metadata: list) -> Schema:
    """From (frames, total, least, most, mean, median, deviation) and (name, [(kind, extent, frames)], present) in order."""
    return Schema(
        *sizes[:4],
        tuple(ColumnSchema(name, tuple(ColumnVariant(*v) for v in variants), present) for name, variants, present in columns),
        tuple(MetadataSchema(key, tuple(MetadataVariant(kind, tuple(shape), n) for kind, shape, n in variants), present) for key, variants, present in metadata),
        *sizes[4:],
    )


def infer(frames: DataFrame) -> Schema:
    """The schema of a frames table; only its entries, not frames, reach the driver."""
    from latticelake.operators.stats import atom_stats

    s = atom_stats(frames).first()
    cols = sorted(column_fold(frames).collect(), key=lambda r: r["first"])
    meta = sorted(metadata_fold(frames).collect(), key=lambda r: r["first"])
    return _schema(
        (s["n_frames"], s["total_atoms"], s["min_atoms"], s["max_atoms"], s["mean_atoms"], s["median_atoms"], s["std_atoms"]),
        [(r["name"], [(v["kind"], v["width"], v["frames"]) for v in r["variants"]], r["frames_present"]) for r in cols],
        [(r["key"], [(v["kind"], v["shape"], v["frames"]) for v in r["variants"]], r["frames_present"]) for r in meta],
    )


def merged(folds: DataFrame) -> DataFrame:
    """The source's folds of many files as one: a row for each signature and each frame size, and one for the first fault."""
    first = F.min(F.struct("source", "first_frame", "first_pos")).alias("first")
    return folds.groupBy("axis", "name", "kind", "extent", "n_atoms").agg(F.sum("frames").alias("frames"), first, F.min_by("error", F.struct("source", "first_frame")).alias("error"))


def of_folds(rows: list) -> Schema:
    """The schema from the collected rows of ``merged``."""
    def entries(axis: str) -> list:
        names: dict[str, list] = {}
        for r in sorted((r for r in rows if r["axis"] == axis), key=lambda r: r["first"]):
            names.setdefault(r["name"], []).append((r["kind"], r["extent"][0] if axis == "column" else r["extent"], r["frames"]))
        return [(name, variants, sum(v[2] for v in variants)) for name, variants in names.items()]

    sizes = sorted((r["n_atoms"], r["frames"]) for r in rows if r["axis"] == "atoms")
    n, total = sum(c for _, c in sizes), sum(x * c for x, c in sizes)
    if not n:
        return _schema((0, 0, None, None, None, None, None), [], [])
    mean, seen, middle = total / n, 0, []
    for x, c in sizes:
        middle += [x] * sum(seen <= at < seen + c for at in ((n - 1) // 2, n // 2))
        seen += c
    deviation = (sum(c * (x - mean) ** 2 for x, c in sizes) / n) ** 0.5
    return _schema((n, total, sizes[0][0], sizes[-1][0], mean, sum(middle) / 2, deviation), entries("column"), entries("metadata"))
