"""Reading, selecting, inferring, validating, projecting, batching and writing files."""

import gzip
import json
import tarfile
import warnings
import zipfile

import numpy as np
import pytest

from latticelake import api, cli
from latticelake.errors import BatchError, ParseError, SchemaError, SchemaWarning
from latticelake.operators import batch, infer, targets
from latticelake.plans.spec import ColumnRule, FrameRule, MetadataRule, SchemaSpec, spec_of
from latticelake.sources import codecs
from latticelake.types import Frame, Kind

VARYING = """3
Properties=species:S:1:pos:R:3:forces:R:3 Lattice="10 0 0 0 10 0 0 0 10" energy=-76.3
O 0 0 0 0.1 0.2 0.3
H 0 0 1 0 0 0
H 0 1 0 0 0 -0.0
1
Lattice="1 0 0 0 1 0 0 0 1" Properties=species:S:1:pos:R:3:forces:R:3 energy=-13.6
H 0 0 0 0 0 0
2
Properties=species:S:1:pos:R:3:forces:R:3 Lattice="10 0 0 0 10 0 0 0 10" energy=-31.8
He 0 0 0 0 0 0
Li 1 1 1 0 0 0
"""
DRIFT = """1
Properties=species:S:1:pos:R:3:forces:I:3 energy=-158 stress="1.0 2.0 3.0 4.0 5.0 6.0" config_type=isolated
H 0 0 0 1 2 3
2
Properties=species:S:1:pos:R:3:forces:R:3 Lattice="5.0 0 0 0 5.0 0 0 0 5.0" energy=-412.08 stress="1.0 2 3 4 5 6 7 8 9" config_type=bulk
H 0 0 0 1.5 2 3
O 0 0 1 1 2 3
"""
MIXED = """2
Properties=species:S:1:pos:R:3:charge:R:1
H 0 0 0 0.5
O 0 0 1 -0.5
2
Properties=species:S:1:pos:R:3
H 0 0 0
O 0 0 1
"""


@pytest.fixture(scope="module")
def files(tmp_path_factory, spark):
    d = tmp_path_factory.mktemp("xyz")
    for name, text in (("varying", VARYING), ("drift", DRIFT), ("mixed", MIXED), ("empty", ""), ("broken", VARYING + "2\nProperties=species:S:1:pos:R:3\nH 0 0 0\n"), ("bad", VARYING.replace("H 0 0 1", "H 0 x 1"))):
        (d / f"{name}.xyz").write_text(text)
    many = "".join(f"{1 + i % 5}\nProperties=species:S:1:pos:R:3 i={i}\n" + "C 0.5 1.5 2.5\n" * (1 + i % 5) for i in range(500))
    (d / "many.xyz").write_text(many)
    return d


def plain(f: Frame):
    return f.n_atoms, {k: np.asarray(v).tolist() for k, v in f.columns.items()}, {k: np.asarray(v).tolist() for k, v in f.metadata.items()}


def test_read(files):
    got = api.read(files / "varying.xyz")
    assert [f.n_atoms for f in got] == [3, 1, 2] and got[0].columns["forces"].shape == (3, 3)
    assert np.signbit(got[0].columns["forces"][2, 2]) and got[1].metadata["energy"] == -13.6 and got[2].columns["species"] == ["He", "Li"]
    assert plain(api.read(files / "varying.xyz", 1)) == plain(got[1]) == plain(api.read(files / "varying.xyz", "-2"))
    assert [f.n_atoms for f in api.read(files / "varying.xyz", "::-1")] == [2, 1, 3]
    assert [f.n_atoms for f in api.read(files / "varying.xyz", [2, 0, 2])] == [2, 3, 2]
    assert [f.n_atoms for f in api.iread(files / "varying.xyz", "1:")] == [1, 2]
    assert api.read(files / "empty.xyz") == []
    for bad in (3, -4, [5], [-1]):
        with pytest.raises(IndexError):
            api.read(files / "varying.xyz", bad)
    with pytest.raises(ValueError, match="threads"):
        api.read(files / "varying.xyz", threads=0)


def test_damage_behind_the_selection_goes_unseen(files):
    assert api.read(files / "broken.xyz", 1).n_atoms == 1
    assert len(api.read(files / "broken.xyz", "0:3")) == 3
    with pytest.raises(ParseError, match="missing atom line") as e:
        api.read(files / "broken.xyz")
    assert (e.value.frame_index, e.value.line) == (3, 16)
    with pytest.raises(ParseError, match="invalid real") as e:
        api.read(files / "bad.xyz")
    assert (e.value.frame_index, e.value.line, e.value.column) == (0, 4, 5)


def test_splitting_changes_nothing(files, spark):
    whole = api.frames(files / "many.xyz")
    parts = api.frames(files / "many.xyz", splitBytes=2000)
    assert parts.rdd.getNumPartitions() > 5 and whole.rdd.getNumPartitions() == 1
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))
    assert [r[0] for r in parts.where("frame_index in (3, 400)").select("frame_index").orderBy("frame_index").collect()] == [3, 400]
    index = api.index(files / "many.xyz")
    again = api.frames_at(index.where("frame_index % 7 = 0"))
    assert sorted(map(str, again.collect())) == sorted(map(str, whole.where("frame_index % 7 = 0").collect()))
    (files / "large.xyz").write_text(VARYING + "4000\nProperties=species:S:1:pos:R:3:id:I:1\n" + "".join(f"C {i}.5 0 -1e3 {i}\n" for i in range(4000)))
    one, cut = api.atoms(files / "large.xyz"), api.atoms(files / "large.xyz", splitBytes=8000)
    assert cut.rdd.getNumPartitions() > 6 and sorted(map(str, one.collect())) == sorted(map(str, cut.collect()))
    with open(files / "large.xyz", "a") as f:
        f.write("x\n")
    with pytest.raises(Exception, match="expected a non-negative integer"):
        api.atoms(files / "large.xyz", splitBytes=8000).count()
    atoms = api.atoms(files / "many.xyz", columns="pos")
    assert atoms.count() == 3 * sum(1 + i % 5 for i in range(500))


def test_scan(files):
    s = api.scan(files / "varying.xyz", with_volume=True)
    assert s.n_atoms.tolist() == [3, 1, 2] and s.lines.tolist() == [1, 6, 9] and s.volumes.tolist() == [1000, 1, 1000]
    raw = (files / "varying.xyz").read_bytes()
    assert [raw[o:].split(b"\n")[0] for o in s.offsets] == [b"3", b"1", b"2"]
    assert len(api.scan(files / "broken.xyz")) == 4 and len(api.scan(files / "empty.xyz")) == 0
    assert np.isnan(api.scan(files / "mixed.xyz", with_volume=True).volumes).all()


def test_blank_count_line_ends_the_file(tmp_path, spark):
    (tmp_path / "a.xyz").write_text(MIXED + "\n" + MIXED)
    assert len(api.read(tmp_path / "a.xyz")) == 2
    (tmp_path / "b.xyz").write_bytes(MIXED.replace("\n", "\r\n").encode())
    assert [plain(f) for f in api.read(tmp_path / "b.xyz")] == [plain(f) for f in api.read(tmp_path / "a.xyz")]
    (tmp_path / "c.xyz").write_text("0\nProperties=species:S:1:pos:R:3 a=1\n" + MIXED.rstrip("\n"))
    assert [f.n_atoms for f in api.read(tmp_path / "c.xyz")] == [0, 2, 2]


def test_codecs(files, tmp_path, spark):
    import zstandard

    raw = VARYING.encode()
    want = [plain(f) for f in api.read(files / "varying.xyz")]
    (tmp_path / "a.xyz.gz").write_bytes(gzip.compress(raw) + gzip.compress(raw))
    (tmp_path / "a.xyz.zst").write_bytes(zstandard.compress(raw) + zstandard.compress(raw))
    (tmp_path / "sniffed").write_bytes(gzip.compress(raw))
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.xyz", raw)
        z.writestr("notes.txt", "no")
    for name, mode in (("a.tar", "w"), ("a.tar.gz", "w:gz")):
        with tarfile.open(tmp_path / name, mode) as t:
            t.add(files / "varying.xyz", "d/x.xyz")
    for name in ("a.xyz.gz", "a.xyz.zst"):
        assert [plain(f) for f in api.read(tmp_path / name)] == want * 2
    for name in ("a.zip", "a.tar", "a.tar.gz", "sniffed"):
        assert [plain(f) for f in api.read(tmp_path / name)] == want
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("a.xyz", MIXED)
        z.writestr("b.xyz", raw)
    assert len(api.read(tmp_path / "two.zip", member="a.xyz")) == 2 and api.frames(tmp_path / "two.zip", member="*").count() == 5
    with pytest.raises(ValueError, match="which member"):
        codecs.pick_member(["a.xyz", "b.xyz"], None)
    with pytest.raises(ValueError, match="nothing in the archive"):
        codecs.pick_member(["a.txt"], None)
    with pytest.raises(ValueError, match="no member"):
        codecs.pick_member(["a.xyz"], "c")
    with pytest.raises(Exception, match="non-archive"):
        api.read(files / "varying.xyz", member="a")


def test_frames_from_content_rows(files, tmp_path, spark):
    (tmp_path / "a.xyz").write_text(VARYING)
    (tmp_path / "b.xyz.gz").write_bytes(gzip.compress(MIXED.encode()))
    (tmp_path / "c.xyz").write_text(VARYING.replace("H 0 0 1", "H 0 x 1"))
    got = api.frames_in(spark.read.format("binaryFile").load(str(tmp_path)))
    rows = got.orderBy("source", "frame_index").collect()
    assert [(r["frame_index"], r["n_atoms"], r["error"] is None) for r in rows] == [(0, 3, True), (1, 1, True), (2, 2, True), (0, 2, True), (1, 2, True), (0, 0, False)]
    assert rows[-1]["error"]["line"] == 4 and rows[-1]["error"]["column"] == 5


def test_infer(files):
    s = api.infer_schema(files / "drift.xyz")
    assert (s.n_frames, s.total_atoms, s.min_atoms, s.max_atoms, s.is_consistent) == (2, 3, 1, 2, False)
    forces = next(c for c in s.columns if c.name == "forces")
    assert forces.variants == (infer.ColumnVariant("I", 3, 1), infer.ColumnVariant("R", 3, 1)) and forces.unified == ("R", 3)
    by = {m.key: m for m in s.metadata}
    assert by["energy"].unified == ("R", ()) and by["stress"].unified is None and by["Lattice"].frames_present == 1
    assert s.report().startswith("2 frames, 3 atoms (min 1, max 2)\n\nper-atom columns:\n  species: S:1 (2/2 frames)\n  pos: R:3 (2/2 frames)\n  forces: I:3 (1/2 frames), R:3 (1/2 frames) (unifies to R:3)\n\nmetadata:\n  energy: Int (1/2 frames), Real (1/2 frames) (unifies to Real)\n  stress: RealArray[6] (1/2 frames), RealArray[9] (1/2 frames) [inconsistent]\n")
    assert api.infer_schema(files / "varying.xyz").is_consistent and api.infer_schema(files / "empty.xyz").is_consistent
    spec, notes = spec_of(s)
    assert "stress" in notes and not next(r for r in spec.metadata if r.key == "Lattice").required
    assert SchemaSpec.from_yaml(spec.to_yaml(notes)) == spec == SchemaSpec.from_json(spec.to_json())


def test_infer_in_one_pass_is_the_fold_of_frames(spark, tmp_path):
    rng = np.random.default_rng(2)
    for name in ("a", "b"):
        parts = []
        for i in range(2_500 if name == "a" else 40):
            n = int(rng.integers(60, 140)) if name == "a" else i % 3
            note = f"Properties=species:S:1:x:{'R' if i % 7 else 'I'}:1 k={i if i % 5 else 'text'}" + (" k=0.5 z=T" if i % 11 == 0 else "")
            parts.append(f"{n}\n{note}\n" + "C 1\n" * n)
        (tmp_path / f"{name}.xyz").write_text("".join(parts))
    for path in (tmp_path / "a.xyz", tmp_path / "b.xyz"):
        one, two = api.infer_schema(path), infer.infer(api.frames(path))
        assert one.report() == two.report() and one.median_atoms == two.median_atoms
        assert one.mean_atoms == pytest.approx(two.mean_atoms) and one.std_atoms == pytest.approx(two.std_atoms)
    assert api.infer_schema(tmp_path / "*.xyz").n_frames == 2_540


def test_files_in_one_order(files, tmp_path):
    """Frames of several files are numbered through, in the order of the files."""
    for name, text in (("a", VARYING), ("b", VARYING.replace("-31.8", "-1.5")), ("c", VARYING)):
        (tmp_path / f"{name}.xyz").write_text(text)
    path = str(tmp_path / "*.xyz")
    sizes = [3, 1, 2] * 3
    assert [f.n_atoms for f in api.read(path, ":")] == sizes and [f.n_atoms for f in api.iread(path)] == sizes
    assert api.read(path, 5).metadata["energy"] == -1.5 and api.read(path, -1).metadata["energy"] == -31.8
    assert [f.n_atoms for f in api.read(path, [7, 3, 7])] == [1, 3, 1] and [f.n_atoms for f in api.read(path, "::4")] == [3, 1, 2]
    b = api.read_batch(path, [5, 0])
    assert b.metadata["energy"].tolist() == [-1.5, -76.3] and b.frame_indices.tolist() == [5, 0]
    got = list(api.iread_batch(path, frames_per_batch=4))
    assert [x.frame_indices.tolist() for x in got] == [[0, 1, 2, 3], [4, 5, 6, 7], [8]]
    assert np.concatenate([np.diff(x.offsets) for x in got]).tolist() == sizes
    assert sum(len(x.frame_indices) for x in api.iread_batch(path, atoms_per_batch=4)) == 9


def test_lines_across_chunks(monkeypatch):
    import io

    from latticelake.sources import index as walking

    rng = np.random.default_rng(1)
    for size in (1, 3, 7, 64):
        monkeypatch.setattr(walking, "_CHUNK", size)
        for _ in range(30):
            data = b"".join(bytes(rng.integers(97, 100, rng.integers(0, 9)).astype(np.uint8)) + b"\n" for _ in range(12))[: rng.integers(0, 60)]
            lines, rest = walking.Lines(io.BytesIO(data)), data
            while rest:
                n = int(rng.integers(0, 4))
                if n:
                    want = b"".join(rest.splitlines(keepends=True)[:n])
                    keep = bool(rng.integers(2))
                    assert lines.many(n, keep) == (want if keep else None)
                else:
                    want = rest.splitlines(keepends=True)[0]
                    assert lines.line() == want.removesuffix(b"\n")
                rest = rest[len(want) :]
                assert lines.at == len(data) - len(rest)
            assert lines.line() is None


SPEC = SchemaSpec((ColumnRule("species", Kind.STR), ColumnRule("pos", Kind.REAL, 3), ColumnRule("charge", Kind.REAL)), ())


def test_validation(files):
    with pytest.raises(SchemaError, match="frame 1, column 'charge': required as R:1, but missing") as e:
        api.read(files / "mixed.xyz", schema=SPEC)
    assert (e.value.frame_index, e.value.name) == (1, "charge")
    with pytest.warns(SchemaWarning, match="charge"):
        assert len(api.read(files / "mixed.xyz", schema=SPEC, conformance="warn")) == 2
    part = SchemaSpec(SPEC.columns[:2])
    assert len(api.read(files / "mixed.xyz", schema=part)) == 2
    with pytest.raises(SchemaError, match="unexpected"):
        api.read(files / "mixed.xyz", schema=part, conformance="strict")
    with pytest.raises(SchemaError, match=r"'n_atoms': holds 1 where the schema has \[2, \]"):
        api.read(files / "varying.xyz", schema=SchemaSpec(frame=FrameRule(n_atoms_min=2)))
    with pytest.raises(ValueError, match="mode needs a schema"):
        api.read(files / "mixed.xyz", mode="project")


def test_projection(files):
    fixed = SchemaSpec((ColumnRule("charge", Kind.REAL, required=False), ColumnRule("species", Kind.STR)), (MetadataRule("n", Kind.INT, required=False, fill=7),), None, "project")
    a, b = api.read(files / "mixed.xyz", schema=fixed)
    assert list(a.columns) == ["charge", "species"] and a.columns["charge"].tolist() == [0.5, -0.5] and np.isnan(b.columns["charge"]).all() and b.metadata == {"n": 7}
    need = SchemaSpec((ColumnRule("pos", Kind.REAL, 3),), (MetadataRule("energy", Kind.INT),), None, "project")
    with pytest.raises(SchemaError, match="holds R where the schema has I"):
        api.read(files / "drift.xyz", schema=need)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        kept = api.read(files / "drift.xyz", schema=need, conformance="warn")
        only = api.read(files / "drift.xyz", 0, schema=need, conformance="warn")
    assert [f.metadata["energy"] for f in kept] == [-158] and plain(only) == plain(kept[0])
    for bad, says in (((ColumnRule("x*", Kind.REAL),), "pattern"), ((ColumnRule("x", Kind.INT, required=False),), "natural null"), ((ColumnRule("x", Kind.INT, fill="a"),), "not a valid")):
        with pytest.raises(SchemaError, match=says):
            api.read(files / "drift.xyz", schema=SchemaSpec(bad, mode="project"))


def test_freeze(files):
    s = api.infer_schema(files / "mixed.xyz")
    frozen = SchemaSpec((ColumnRule("ch*", Kind.REAL),)).freeze(s)
    assert frozen.mode == "project" and frozen.columns == (ColumnRule("charge", Kind.REAL, 1, False),)
    with pytest.raises(SchemaError, match="varies between frames"):
        SchemaSpec((), (MetadataRule("str*", Kind.REAL),)).freeze(api.infer_schema(files / "drift.xyz"))


def test_batches(files):
    b = api.read_batch(files / "varying.xyz")
    assert b.offsets.tolist() == [0, 3, 4, 6] and b.batch.tolist() == [0, 0, 0, 1, 2, 2] and b.columns["pos"].shape == (6, 3) and b.metadata["energy"].tolist() == [-76.3, -13.6, -31.8]
    again = api.read_batch(files / "varying.xyz", [2, 0, 2])
    assert again.frame_indices.tolist() == [2, 0, 2] and again.n_atoms.tolist() == [2, 3, 2]
    assert api.read_batch(files / "empty.xyz").n_frames == 0
    with pytest.raises(BatchError, match="empty"):
        api.read_batch(files / "varying.xyz", "5:9")
    with pytest.raises(BatchError, match='frame 1 is missing column "charge"'):
        api.read_batch(files / "mixed.xyz")
    with pytest.raises(BatchError, match="stress"):
        api.read_batch(files / "drift.xyz")
    with pytest.raises(IndexError):
        api.read_batch(files / "varying.xyz", [0, 9])
    assert [x.n_frames for x in api.iread_batch(files / "varying.xyz", frames_per_batch=2)] == [2, 1]
    assert [x.frame_indices.tolist() for x in api.iread_batch(files / "varying.xyz", atoms_per_batch=3)] == [[0], [1, 2]]
    assert [x.frame_indices.tolist() for x in api.iread_batch(files / "varying.xyz", memory_scales_with="n_atoms", max_scaler=4)] == [[0, 1], [2]]
    assert sorted(i for x in api.iread_batch(files / "varying.xyz", memory_scales_with="n_atoms_x_density", max_scaler=1) for i in x.frame_indices) == [0, 1, 2]
    order = np.random.default_rng(3).permutation(np.arange(500)).tolist()
    assert [i for x in api.iread_batch(files / "many.xyz", frames_per_batch=64, shuffle=True, seed=3) for i in x.frame_indices] == order
    for bad in ({}, {"frames_per_batch": 0}, {"frames_per_batch": 1, "atoms_per_batch": 1}, {"frames_per_batch": 1, "seed": 1}, {"memory_scales_with": "n_atoms"}, {"memory_scales_with": "n_atoms", "max_scaler": 1, "shuffle": True}):
        with pytest.raises(ValueError):
            list(api.iread_batch(files / "varying.xyz", **bad))


def test_best_fit_by_brute_force(spark):
    rng = np.random.default_rng(5)
    w = rng.integers(1, 40, 300)
    bins, where = [], {}
    for i in sorted(range(300), key=lambda i: (-w[i], i)):
        room = [k for k, s in enumerate(bins) if s + w[i] <= 64]
        k = max(room, key=lambda k: (bins[k], -k), default=None)
        if k is None:
            bins.append(0)
            k = len(bins) - 1
        bins[k] += w[i]
        where[i] = k
    index = spark.createDataFrame([(i, int(n)) for i, n in enumerate(w)], "frame_index long, n_atoms long")
    assert {r["frame_index"]: r["batch_id"] for r in batch.memory_plan(index, 64).collect()} == where


def test_write(files, tmp_path, spark):
    table = api.frames(files / "varying.xyz")
    want = [plain(f) for f in api.read(files / "varying.xyz")]
    for name in ("o.xyz", "o.xyz.gz", "o.zip", "o.tar", "o.tar.gz"):
        api.write(tmp_path / name, table)
        assert [plain(f) for f in api.read(tmp_path / name)] == want
    text = (tmp_path / "o.xyz").read_text()
    assert text.startswith('3\nLattice="10 0 0 0 10 0 0 0 10" Properties=species:S:1:pos:R:3:forces:R:3 energy=-76.3\nO 0.0 0.0 0.0 0.1 0.2 0.3\n')
    api.write(tmp_path / "p.xyz", api.frames(files / "varying.xyz", splitBytes=10).repartition(3))
    assert (tmp_path / "p.xyz").read_text() == text
    api.write(tmp_path / "q.xyz", api.read(files / "varying.xyz"))
    api.write(tmp_path / "q.xyz", api.read(files / "varying.xyz", 0), append=True)
    assert [f.n_atoms for f in api.read(tmp_path / "q.xyz")] == [3, 1, 2, 3] and (tmp_path / "q.xyz").read_text().startswith(text)
    with api.Writer(tmp_path / "w.xyz.gz", batch=2) as w:
        for f in api.iread(files / "varying.xyz"):
            w.write(f)
    assert [plain(f) for f in api.read(tmp_path / "w.xyz.gz")] == want
    with pytest.raises(ValueError, match="zstd"):
        api.write(tmp_path / "o.xyz.zst", table)
    with pytest.raises(ValueError, match="appended"):
        api.write(tmp_path / "o.zip", table, append=True)
    with pytest.raises(ValueError, match="use 0 to 9"):
        api.write(tmp_path / "o.xyz.gz", table, level=10)
    with pytest.raises(ValueError, match="species"):
        api.write(tmp_path / "z.xyz", Frame(1, {"pos": np.zeros((1, 3))}, {}))
    assert not (tmp_path / "z.xyz").exists()


def test_targets(files, spark):
    a = targets.atoms(api.frames(files / "varying.xyz")).orderBy("frame_index").collect()
    assert [r["numbers"] for r in a] == [[8, 1, 1], [1], [2, 3]] and a[0]["cell"][0] == [10.0, 0.0, 0.0] and a[0]["pbc"] == [True] * 3
    assert a[0]["positions"][1] == [0.0, 0.0, 1.0]
    s = targets.state(api.frames(files / "varying.xyz")).orderBy("frame_index").first()
    assert s["masses"][0] == 15.999
    back = targets.frames_of(api.frames(files / "varying.xyz").select("source", "frame_index", targets.entry("columns", "species")["s"].alias("species"), targets.wide(targets.entry("columns", "pos"), 3).alias("positions"), targets.cell().alias("cell"), targets.pbc().alias("pbc")))
    api.write(files / "back.xyz", back)
    assert api.read(files / "back.xyz", 0).columns["species"] == ["O", "H", "H"]
    plan = batch.fixed_plan(api.index(files / "varying.xyz"), 2)
    b = targets.batched_states(api.frames(files / "varying.xyz"), plan).orderBy("batch_id").collect()
    assert b[0]["system_idx"] == [0, 0, 0, 1] and b[0]["atomic_numbers"] == [8, 1, 1, 1] and len(b[0]["cell"]) == 2 and b[1]["frame_indices"] == [2]
    with pytest.raises(ValueError, match="unknown species: Qq"):
        (files / "q.xyz").write_text("1\nProperties=species:S:1:pos:R:3\nQq 0 0 0\n")
        targets.check_species(api.frames(files / "q.xyz"))


def test_cli(files, tmp_path, capsys):
    assert cli.main(["scan", str(files / "drift.xyz")]) == 0 and "unifies to R:3" in capsys.readouterr().out
    assert cli.main(["scan", "--no-schema", "--json", str(files / "varying.xyz")]) == 0 and json.loads(capsys.readouterr().out)["total_atoms"] == 6
    spec = str(tmp_path / "s.yaml")
    assert cli.main(["scan", str(files / "varying.xyz"), "--emit-schema", spec]) == 0
    assert cli.main(["check", str(files / "varying.xyz"), "--schema", spec]) == 0 and "3 frames checked (required), no kinds" in capsys.readouterr().out
    assert cli.main(["check", str(files / "mixed.xyz"), "--schema", spec, "--json"]) == 1
    got = json.loads(capsys.readouterr().out)
    assert got["n_frames"] == 2 and {v["name"] for v in got["violations"]} == {"forces", "Lattice", "energy"}
    assert cli.main(["freeze", str(files / "varying.xyz"), "--schema", spec, "--out", str(tmp_path / "f.json")]) == 0
    assert SchemaSpec.from_file(tmp_path / "f.json").mode == "project"
    assert cli.main([]) == 2 and cli.main(["scan", "--project", str(files / "varying.xyz")]) == 1
    assert "latticelake: " in capsys.readouterr().err


def test_streaming(files, tmp_path, spark):
    from latticelake.streaming.files import count_windows, stream_frames

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.xyz").write_text(VARYING)
    q = count_windows(stream_frames(spark, str(folder)), 2).writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        (folder / "b.xyz").write_text(MIXED)
        q.processAllAvailable()
        got = spark.table("windows").groupBy("source").sum("n_frames").collect()
        assert sorted(r[1] for r in got) == [2, 3]
    finally:
        q.stop()
