"""Model-ready columns: cells, periodicity, atomic numbers and batched states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticelake.errors import LatticeError
from latticelake.functions import elements
from latticelake.types import SLOT


def entry(of: str, name: str) -> Column:
    """The last entry of a name among a frame's columns or metadata, null where absent."""
    key = "name" if of == "columns" else "key"
    return F.try_element_at(F.filter(of, lambda e: e[key] == name), F.lit(-1))


def reals(e: Column) -> Column:
    """An entry's values as doubles, Int or Real."""
    return F.coalesce(e["r"], e["i"].cast("array<double>"))


def matrix(flat: Column, rows: int = 3, cols: int = 3, transpose: bool = False) -> Column:
    """A flat array as an array of rows, or of its columns."""
    if transpose:
        return F.when(flat.isNotNull(), F.array(*(F.array(*(F.element_at(flat, r * cols + c + 1) for r in range(rows))) for c in range(cols))))
    return F.when(flat.isNotNull(), F.array(*(F.slice(flat, r * cols + 1, cols) for r in range(rows))))


def cell() -> Column:
    """The cell's three vectors as rows: the Lattice in reading order."""
    return matrix(reals(entry("metadata", "Lattice")))


def pbc(default: Column | None = None) -> Column:
    """Periodicity of the three axes: as given (one value for all, or three), else by whether there is a Lattice."""
    own = entry("metadata", "pbc")["b"]
    given = F.when(F.size(own) == 1, F.array_repeat(own[0], 3)).otherwise(own)
    has = entry("metadata", "Lattice").isNotNull() if default is None else default
    return F.coalesce(given, F.array_repeat(has, 3))


def numbers() -> Column:
    """Atomic numbers: from a column Z, else numbers, else the species; reals are rounded half to even."""
    def whole(name: str) -> Column:
        e = entry("columns", name)
        return F.coalesce(e["i"].cast("array<int>"), F.transform(e["r"], lambda v: F.rint(v).cast("int")))

    return F.coalesce(whole("Z"), whole("numbers"), elements.numbers_of(entry("columns", "species")["s"]))


def check_species(frames: DataFrame) -> None:
    """Raise where symbols that are no element would have to be read as numbers."""
    species = entry("columns", "species")["s"]
    explicit = F.exists("columns", lambda c: c["name"].isin("Z", "numbers"))
    bad = frames.where(~explicit).select(F.explode(elements.unknown(species)).alias("s")).distinct().orderBy("s").limit(20).collect()
    if bad:
        raise LatticeError(f"unknown species: {', '.join(r['s'] for r in bad)}")


def wide(e: Column, width: int) -> Column:
    """A flat column of ``width`` values an atom as an array of arrays."""
    values = reals(e)
    return F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), (F.size(values) / width).cast("int") - 1), lambda i: F.slice(values, i * width + 1, width))).when(values.isNotNull(), F.array().cast("array<array<double>>"))


def atoms(frames: DataFrame) -> DataFrame:
    """Frames as structures: numbers, positions, cell, pbc, the fixed atoms of a move_mask, and what is left as info."""
    mask = entry("columns", "move_mask")
    axes = F.when(mask["width"] == 3, F.transform(F.sequence(F.lit(0), F.col("n_atoms").cast("int") - 1), lambda i: F.transform(F.slice(mask["b"], i * 3 + 1, 3), lambda m: ~m)))
    info = F.filter("metadata", lambda m: ~m["key"].isin("Lattice", "pbc"))
    return frames.select(
        "source", "frame_index", "n_atoms", numbers().alias("numbers"), wide(entry("columns", "pos"), 3).alias("positions"), cell().alias("cell"), pbc().alias("pbc"),
        F.when(mask["width"] == 1, F.transform(mask["b"], lambda m: ~m)).alias("fixed"), axes.alias("fixed_axes"), info.alias("info"),
    )


def systems(frames: DataFrame) -> DataFrame:
    """Frames as systems: rows of the cell along axes that are not periodic are zero, ``cell_differs`` where they were not."""
    rows, own = cell(), pbc()
    zero = F.array_repeat(F.lit(0.0), 3)
    kept = F.transform(rows, lambda r, i: F.when(F.get(own, i), r).otherwise(zero))
    differs = F.exists(F.transform(rows, lambda r, i: F.exists(r, lambda v: v != 0) != F.get(own, i)), lambda x: x)
    return frames.select(
        "source", "frame_index", "n_atoms", numbers().alias("types"), wide(entry("columns", "pos"), 3).alias("positions"),
        F.coalesce(kept, F.array_repeat(zero, 3)).alias("cell"), own.alias("pbc"), F.coalesce(differs, F.lit(False)).alias("cell_differs"),
    )


def per_config(frames: DataFrame, key: str) -> DataFrame:
    """(source, frame_index, values): one metadata entry of every frame."""
    return frames.select("source", "frame_index", reals(entry("metadata", key)).alias("values"))


def per_atom(frames: DataFrame, name: str) -> DataFrame:
    """(source, frame_index, atom_index, component, value): one numeric column, a row for each value."""
    e = entry("columns", name)
    each = frames.select("source", "frame_index", e["width"].alias("w"), F.posexplode(reals(e)).alias("k", "value"))
    return each.select("source", "frame_index", F.floor(F.col("k") / F.col("w")).cast("bigint").alias("atom_index"), (F.col("k") % F.col("w")).cast("int").alias("component"), "value")


def state(frames: DataFrame) -> DataFrame:
    """One row for each frame of a batched state: transposed cell, masses from a column or the table, shared pbc checked.

    Raises where the frames' periodicities differ.
    """
    has = frames.select(F.coalesce(F.bool_or(entry("metadata", "Lattice").isNotNull()), F.lit(False))).first()[0]
    own = pbc(F.lit(has))
    kinds = frames.select(own.alias("p")).distinct().limit(2).collect()
    if len(kinds) > 1:
        raise LatticeError("all frames of a state must share one pbc")
    z = numbers()
    mass = F.coalesce(reals(entry("columns", "masses")), reals(entry("columns", "mass")), elements.masses_of(z))
    return frames.select(
        "source", "frame_index", "n_atoms", z.alias("atomic_numbers"), wide(entry("columns", "pos"), 3).alias("positions"), mass.alias("masses"),
        matrix(reals(entry("metadata", "Lattice")), transpose=True).alias("cell"), own.alias("pbc"),
    )


def batched_states(frames: DataFrame, plan: DataFrame) -> DataFrame:
    """One row for each planned batch: states one behind the other, with the system of each atom."""
    own = state(frames).join(plan.select("frame_index", "batch_id", "pos_in_batch"), "frame_index")
    each = own.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("pos_in_batch", "frame_index", "n_atoms", "atomic_numbers", "positions", "masses", "cell", "pbc"))).alias("f"))
    get = lambda name: F.transform("f", lambda v: v[name])
    return each.select(
        "batch_id", get("frame_index").alias("frame_indices"), *(F.flatten(get(c)).alias(c) for c in ("atomic_numbers", "positions", "masses")), get("cell").alias("cell"),
        F.flatten(F.transform("f", lambda v, i: F.array_repeat(i, v["n_atoms"].cast("int")))).alias("system_idx"), F.col("f")[0]["pbc"].alias("pbc"),
    )


def frames_of(structures: DataFrame) -> DataFrame:
    """Structures (species, positions, cell, pbc) back as frames of the canonical schema, for writing."""
    def tagged(name: str, kind: str, extent: Column, values: Column, names: tuple[str, str]) -> Column:
        slots = [(values if SLOT[kind] == s else F.lit(None)).cast(f"array<{t}>").alias(s) for s, t in (("r", "double"), ("i", "bigint"), ("b", "boolean"), ("s", "string"))]
        return F.struct(F.lit(name).alias(names[0]), F.lit(kind).alias("kind"), extent.alias(names[1]), *slots)

    columns = F.array(tagged("species", "S", F.lit(1), F.col("species"), ("name", "width")), tagged("pos", "R", F.lit(3), F.flatten("positions"), ("name", "width")))
    lattice = tagged("Lattice", "R", F.array(F.lit(9)), F.flatten("cell"), ("key", "shape"))
    periodic = tagged("pbc", "L", F.array(F.lit(3)), F.col("pbc"), ("key", "shape"))
    metadata = F.when(F.col("cell").isNotNull(), F.array(lattice, periodic)).otherwise(F.array(periodic))
    return structures.select("source", "frame_index", F.size("species").cast("bigint").alias("n_atoms"), columns.alias("columns"), metadata.alias("metadata"))
