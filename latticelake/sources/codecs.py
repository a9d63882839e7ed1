"""Opening plain, compressed and archived sources as byte streams."""

from __future__ import annotations

import gzip
import io
import os
import tarfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

CODECS = ("infer", "none", "gzip", "zstd", "zip", "tar", "tar.gz")
_SUFFIXES = ((".tar.gz", "tar.gz"), (".tgz", "tar.gz"), (".tar", "tar"), (".gz", "gzip"), (".zst", "zstd"), (".zip", "zip"))
_MAGIC = ((b"\x1f\x8b", "gzip"), (b"\x28\xb5\x2f\xfd", "zstd"), (b"PK\x03\x04", "zip"))
_REMOTE = ("s3://", "s3a://", "gs://", "abfs://", "abfss://", "az://", "azure://", "hdfs://", "viewfs://")


def is_remote(path: str) -> bool:
    return path.startswith(_REMOTE)


def local(path: str) -> str:
    return path.removeprefix("file://")


def open_raw(path: str):
    """A seekable binary file; remote schemes go through pyarrow's file systems."""
    if is_remote(path):
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(path.replace("s3a://", "s3://"))
        return system.open_input_file(name)
    return open(local(path), "rb")


def codec_of(path: str, compression: str = "infer") -> str:
    """The codec of a path: as forced, else by extension, else by its first bytes."""
    if compression not in CODECS:
        raise ValueError(f"unknown compression {compression!r}; use one of {', '.join(CODECS)}")
    if compression != "infer":
        return compression
    for suffix, codec in _SUFFIXES:
        if path.lower().endswith(suffix):
            return codec
    with open_raw(path) as f:
        head = f.read(4)
    return next((codec for magic, codec in _MAGIC if head.startswith(magic)), "none")


def pick_member(names: list[str], member: str | None) -> str:
    """The member asked for, or the sole one with an extxyz extension."""
    if member is not None:
        if member not in names:
            raise ValueError(f"no member {member!r} in the archive, which holds {names}")
        return member
    own = [n for n in names if n.lower().endswith((".xyz", ".extxyz"))]
    if len(own) > 1:
        raise ValueError(f"which member of the archive? It holds several: {own}; name one by member=")
    if not own:
        raise ValueError(f"nothing in the archive ends in .xyz or .extxyz: {names}")
    return own[0]


def members(path: str, compression: str = "infer") -> list[str]:
    """Names of the files in an archive; none for other sources."""
    codec = codec_of(path, compression)
    if codec == "zip":
        with open_raw(path) as f, zipfile.ZipFile(f) as z:
            return [i.filename for i in z.infolist() if not i.is_dir()]
    if codec in ("tar", "tar.gz"):
        with open_raw(path) as f, tarfile.open(fileobj=f, mode="r:*") as t:
            return [m.name for m in t.getmembers() if m.isfile()]
    return []


@contextmanager
def open_decoded(path: str, compression: str = "infer", member: str | None = None) -> Iterator[io.BufferedIOBase]:
    """The decoded stream; every member of a concatenated gzip and every zstd frame is read."""
    codec = codec_of(path, compression)
    if member is not None and codec not in ("zip", "tar", "tar.gz"):
        raise ValueError("member= given for a non-archive source")
    with open_raw(path) as raw, decoded(raw, codec, member) as f:
        yield f


def codec_of_bytes(name: str, head: bytes, compression: str = "infer") -> str:
    """As ``codec_of``, for content that is already here."""
    if compression != "infer":
        return compression
    by_name = next((codec for suffix, codec in _SUFFIXES if name.lower().endswith(suffix)), None)
    return by_name or next((codec for magic, codec in _MAGIC if head.startswith(magic)), "none")


@contextmanager
def decoded(raw: io.BufferedIOBase, codec: str, member: str | None = None) -> Iterator[io.BufferedIOBase]:
    """A binary file through its codec."""
    if codec == "none":
        yield raw
    elif codec == "gzip":
        with gzip.open(raw) as f:
            yield f
    elif codec == "zstd":
        import zstandard

        with zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as f:
            yield io.BufferedReader(f)
    elif codec == "zip":
        with zipfile.ZipFile(raw) as z, z.open(pick_member([i.filename for i in z.infolist() if not i.is_dir()], member)) as f:
            yield f
    else:
        with tarfile.open(fileobj=raw, mode="r:*") as t:
            names = [m.name for m in t.getmembers() if m.isfile()]
            yield t.extractfile(pick_member(names, member))


def splittable(path: str, compression: str = "infer") -> bool:
    return codec_of(path, compression) == "none"


def expand(path: str) -> list[str]:
    """Files of a path: itself, the files of a folder, or the matches of a pattern, in order."""
    import glob

    if is_remote(path):
        return [path]
    p = local(path)
    if os.path.isdir(p):
        return sorted(os.path.join(p, n) for n in os.listdir(p) if not n.startswith((".", "_")) and os.path.isfile(os.path.join(p, n)))
    if any(c in p for c in "*?[") and not os.path.exists(p):
        return sorted(glob.glob(p))
    return [p]
