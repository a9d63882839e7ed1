"""Operator 3 - token ids in a content-addressed store.

Documents are encoded with the tokenizers library, each followed by an end id. A rolling
(gear) hash over the last 16 ids cuts every id stream where its content says so, so equal
passages give equal chunks wherever they stand. The store has four Parquet tables below
its path, in any file system that Spark writes:

* ``chunks``   (digest, payload, uses): every distinct chunk once, as zstd of little-endian
  16-bit ids (32-bit for a vocabulary beyond 65,536), under the BLAKE2b digest of the ids;
  bucketed and sorted by digest, so that reading joins it without moving a payload;
* ``recipes``  (part, row, doc_id, local_start, n_tokens, digests, root): the documents in
  ascending doc_id order, each the list of its chunks and the Merkle root over them;
* ``manifest`` (part, start, n_docs, n_tokens, root): for each range of documents its ids
  before it and the Merkle root over its documents' roots;
* ``format``   (width, buckets, uses, parts, root, dictionary): the width of an id, what the
  other tables must hold, the root over the manifest, and the compression dictionary.

Order comes from a range partitioning of the light recipes alone and a prefix sum over
one row per partition. Payloads are shuffled once by digest to be stored and once by
document to be read. A chunk that documents use more often than one use in HOT is joined by
broadcast - there are at most HOT of them, each of at most MOST ids - so that no common
passage makes a hot key.

Reading checks everything from the top: the manifest against the format's root, the recipes
of each part against the manifest (number, tokens, places, root), each document against its
recipe, each chunk against its digest. A lost or altered chunk, recipe, part or table raises.

Defined results: a null or empty text is the end id alone; rows that repeat a doc_id
follow each other by their content; a null doc_id sorts first; an empty table gives an
empty store; other columns are ignored; text that spells a special token of the
vocabulary gets that token's id, as the library has it.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticelake.llm.common import PieceStreams, blocks, column, documents, held, map_arrow, table, texts_of
from latticelake.session import remove, scratch_path, tidied

#: The id put behind each document.
END = 0
#: Chunk sizes in ids: least, one in MEAN positions ends a chunk, most.
LEAST, MEAN, MOST = 64, 256, 2048
CACHE = 1_200_000
#: Pieces that are encoded in one call of the library.
TOGETHER = 2_000
#: The compression dictionary: documents whose chunks it may learn from, chunks it learns from, its bytes.
DICTIONARY_DOCS, DICTIONARY_CHUNKS, DICTIONARY_BYTES = 400, 4_000, 65_536
#: A chunk with more than one in so many of all uses is hot.
HOT = 2_000
#: Payload bytes of a bucket of chunks.
BUCKET_BYTES = 64 << 20
_DIGEST = 20

_GEAR = np.random.default_rng(20240229).integers(0, 1 << 63, 1 << 16, dtype=np.uint64)


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=_DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root over a list of digests; an odd one moves up as it is, no leaf gives the digest of nothing."""
    level = leaves
    while len(level) > 1:
        level = [digest(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else digest(b"")


#: The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_OTHERS = [(chr(b), chr(256 + i)) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)]


def _spelled(words: list[bytes]) -> str:
    """Words in the byte-level alphabet with a space between them; the byte FF is in no UTF-8 text."""
    text = b"\xff".join(words).decode("latin-1")
    for c, sign in _OTHERS:
        if c in text:
            text = text.replace(c, sign)
    return text.replace("\xff", " ")


class Encoder(PieceStreams):
    """Ids by the tokenizers library, many words in one call; each stream is closed by the end id."""

    def __init__(self, path: str, end: int = END):
        import public_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: The same for words that are split and in the byte-level alphabet already, with a space between them.
        self.plain = Tokenizer.from_file(path)
        self.plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab()
        #: Bytes of each token: the byte-level alphabet has one character for each.
        self.bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        self.bytes[list(vocab.values())] = [len(t) for t in vocab]
        super().__init__(public_tokenizers.PATTERN, "<u2" if len(vocab) <= 1 << 16 else "<u4", CACHE, end)

    def _ids(self, tokenizer, text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From texts of many words; tokens never cross words, so their byte lengths tell which word they are of."""
        raw = [w.encode() for w in words]
        made = [self._ids(self.plain, _spelled(raw[lo : lo + TOGETHER])) for lo in range(0, len(raw), TOGETHER)]
        ids = np.concatenate(made) if made else np.empty(0, self.kind)
        stop = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum([len(w) for w in raw])) + 1
        start = np.concatenate([[0], stop[:-1]]).astype(np.int64)
        return ids, start, stop - start

    def whole(self, texts: list[str]) -> dict[int, np.ndarray]:
        """A special token splits a text before the pattern does."""
        return {i: self._ids(self.tokenizer, t) for i, t in enumerate(texts) if any(s in t for s in self.special)}


def encoder(path: str, end: int) -> Encoder:
    return held(("idstore", path, end), lambda: Encoder(path, end))


def cuts(ids: np.ndarray) -> np.ndarray:
    """Positions behind which the rolling hash over the last 16 ids ends a chunk."""
    h = _GEAR[ids & 0xFFFF]
    for k in (1, 2, 4, 8):
        h[k:] += h[:-k] << np.uint64(k)
    return np.flatnonzero((h >> np.uint64(8)) % np.uint64(MEAN) == 0) + 1


def chunk(stream: bytes, width: int, ends: list[int]) -> list[bytes]:
    """Cut one id stream at the candidate ends, within the least and the largest size."""
    out, lo, n = [], 0, len(stream) // width
    for e in [*ends, n]:
        while e - lo > MOST:
            out.append(stream[lo * width : (lo + MOST) * width])
            lo += MOST
        if e - lo >= LEAST or e == n and e > lo:
            out.append(stream[lo * width : e * width])
            lo = e
    return out


def _chunked(flat: np.ndarray, starts: np.ndarray, width: int) -> Iterator[list[bytes]]:
    """The chunks of each stream of a block."""
    found, raw = cuts(flat), flat.tobytes()
    at = np.searchsorted(found, starts)
    for lo, hi, i, j in zip(starts.tolist(), starts[1:].tolist(), at.tolist(), at[1:].tolist(), strict=False):
        yield chunk(raw[lo * width : hi * width], width, (found[i:j] - lo).tolist())


def _dictionary(docs: DataFrame, path: str, end: int) -> bytes:
    """A zstd dictionary from DICTIONARY_CHUNKS chunks (least digest) of DICTIONARY_DOCS ids' whole texts (least hash); empty where there is too little to learn."""
    picked = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(DICTIONARY_DOCS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, end)
        for batch in batches:
            texts = texts_of(batch)
            for lo, hi in blocks(texts):
                found = [p for own in _chunked(*enc.streams(texts[lo:hi]), int(enc.kind[2])) for p in own]
                yield pa.record_batch([pa.array([digest(p) for p in found], pa.binary()), pa.array(found, pa.binary())], ["digest", "chunk"])

    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text")
    found = map_arrow(texts, run, "digest binary, chunk binary").distinct().orderBy("digest").limit(DICTIONARY_CHUNKS).select("chunk").collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [bytes(r["chunk"]) for r in found]).as_bytes() if len(found) >= 64 else b""
    except zstandard.ZstdError:
        return b""


def _codec(data: bytes, kind: type):
    """A compressor or decompressor with the dictionary, if there is one."""
    more = {"level": 3} if kind is zstandard.ZstdCompressor else {}
    return kind(dict_data=zstandard.ZstdCompressionDict(data), **more) if data else kind(**more)


def _stage(docs: DataFrame, path: str, end: int, data: bytes) -> DataFrame:
    """A row for each document (doc_id, n_tokens, digests, root) and for each chunk new to its block (digest, payload, size, uses)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, end)
        width = int(enc.kind[2])
        pack = _codec(shared.value, zstandard.ZstdCompressor).compress
        names = ["doc_id", "n_tokens", "digests", "root", "digest", "payload", "size", "uses"]
        for batch in batches:
            texts = texts_of(batch)
            for lo, hi in blocks(texts):
                flat, starts = enc.streams(texts[lo:hi])
                fresh: dict[bytes, bytes] = {}
                uses: Counter[bytes] = Counter()
                recipes = []
                for parts in _chunked(flat, starts, width):
                    recipes.append([digest(p) for p in parts])
                    fresh.update(zip(recipes[-1], parts, strict=True))
                    uses.update(recipes[-1])
                n, m = len(recipes), len(fresh)
                packed = [pack(p) for p in fresh.values()]
                ids = column(batch, "doc_id").slice(lo, n)
                yield pa.record_batch(
                    [
                        pa.concat_arrays([ids, pa.nulls(m, ids.type)]), pa.array(np.diff(starts).tolist() + [None] * m, pa.int64()),
                        pa.array(recipes + [None] * m, pa.list_(pa.binary())), pa.array([merkle(r) for r in recipes] + [None] * m, pa.binary()),
                        pa.array([None] * n + list(fresh), pa.binary()), pa.array([None] * n + packed, pa.binary()),
                        pa.array([None] * n + list(map(len, packed)), pa.int64()), pa.array([None] * n + [uses[d] for d in fresh], pa.int64()),
                    ],
                    names,
                )

    return map_arrow(documents(docs), run, f"doc_id {kind}, n_tokens long, digests array<binary>, root binary, digest binary, payload binary, size long, uses long")


def _number(recipes: DataFrame) -> DataFrame:
    """Number the rows of each range partition and sum their tokens so far."""
    kind = recipes.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        row, before = 0, 0
        for batch in batches:
            n = batch.num_rows
            tokens = column(batch, "n_tokens").to_numpy()
            sums = np.cumsum(tokens) - tokens + before
            yield pa.record_batch(
                [pa.array(np.full(n, part, np.int32)), pa.array((part << 40) + row + np.arange(n)), column(batch, "doc_id"), pa.array(sums), column(batch, "n_tokens"), column(batch, "digests"), column(batch, "root")],
                ["part", "row", "doc_id", "local_start", "n_tokens", "digests", "root"],
            )
            row, before = row + n, before + int(tokens.sum())

    return map_arrow(recipes, run, f"part int, row long, doc_id {kind}, local_start long, n_tokens long, digests array<binary>, root binary")


def write_store(docs: DataFrame, path: str, vocabulary: str | None = None, end: int = END) -> None:
    """Encode documents and write the store's tables below ``path``."""
    import public_tokenizers

    spark = docs.sparkSession
    staged_at = scratch_path(spark, "idstore-staged")
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    data = _dictionary(docs, vocabulary, end)
    # payloads are compressed already
    with tidied(spark):
        _stage(docs, vocabulary, end, data).write.option("compression", "none").parquet(staged_at)
    staged = spark.read.parquet(staged_at)
    sums = staged.agg(F.sum("size").alias("size"), F.sum("uses").alias("uses")).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(sums["size"] or 0) // BUCKET_BYTES))
    chunks = staged.where("digest is not null").select("digest", "payload", "uses").repartition(buckets, "digest").groupBy("digest").agg(F.first("payload").alias("payload"), F.sum("uses").alias("uses"))
    name = _name()
    with tidied(spark):
        chunks.write.format("parquet").option("compression", "none").option("path", f"{path}/chunks").bucketBy(buckets, "digest").sortBy("digest").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # of the catalogue; the files stay
    recipes = staged.where("digests is not null").select("doc_id", "n_tokens", "digests", "root")
    with tidied(spark):
        _number(recipes.repartitionByRange("doc_id", "root").sortWithinPartitions("doc_id", "root")).write.parquet(f"{path}/recipes")
    remove(spark, staged_at)
    rows, start = [], 0
    for r in _parts(spark, path):
        rows.append((r["part"], start, r["n_docs"], r["n_tokens"], bytes(r["root"])))
        start += r["n_tokens"]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")
    kind = Encoder(vocabulary, end).kind
    form = (int(kind[2]), buckets, sums["uses"] or 0, len(rows), merkle([r[4] for r in rows]), data)
    spark.createDataFrame([form], FORMAT).coalesce(1).write.parquet(f"{path}/format")


MANIFEST = "part int, start long, n_docs long, n_tokens long, root binary"
FORMAT = "width int, buckets int, uses long, parts int, root binary, dictionary binary"


def _name() -> str:
    return f"idstore_{uuid.uuid4().hex}"


def _parts(spark: SparkSession, path: str) -> list:
    """(part, n_docs, n_tokens, root) of the recipes as they are, in order; raises where places do not follow each other.

    There is one row for each task of the writer, so they may come to the driver.
    """
    recipes = spark.read.parquet(f"{path}/recipes").select("part", "row", "local_start", "n_tokens", "root")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, leaves, tokens = None, [], 0
        done: list[tuple] = []
        for batch in batches:
            for p, at, n, root in zip(*(column(batch, c).to_pylist() for c in ("part", "local_start", "n_tokens", "root")), strict=True):
                if p != part:
                    if leaves:
                        done.append((part, len(leaves), tokens, merkle(leaves)))
                    part, leaves, tokens = p, [], 0
                if at != tokens:
                    raise ValueError(f"part {p} of the id store: document {len(leaves)} starts at {at}, not at {tokens}")
                leaves.append(root)
                tokens += n
        if leaves:
            done.append((part, len(leaves), tokens, merkle(leaves)))
        kinds = {"part": pa.int32(), "n_docs": pa.int64(), "n_tokens": pa.int64(), "root": pa.binary()}
        yield pa.record_batch([pa.array([d[i] for d in done], kind) for i, kind in enumerate(kinds.values())], list(kinds))

    ordered = recipes.repartition("part").sortWithinPartitions("part", "row")
    return sorted(map_arrow(ordered, run, "part int, n_docs long, n_tokens long, root binary").collect(), key=lambda r: r["part"])


def _verified(spark: SparkSession, path: str):
    """The store's format, after the manifest and the recipes of all parts were found whole."""
    form = spark.read.parquet(f"{path}/format").first()
    manifest = spark.read.parquet(f"{path}/manifest").orderBy("part").collect()
    if len(manifest) != form["parts"] or merkle([bytes(r["root"]) for r in manifest]) != form["root"]:
        raise ValueError("the manifest of the id store is damaged")
    found = {r["part"]: (r["n_docs"], r["n_tokens"], bytes(r["root"])) for r in _parts(spark, path)}
    start = 0
    for r in manifest:
        if r["start"] != start:
            raise ValueError(f"part {r['part']} of the id store is not where the manifest's parts before it end")
        start += r["n_tokens"]
        if found.pop(r["part"], None) != (r["n_docs"], r["n_tokens"], bytes(r["root"])):
            raise ValueError(f"part {r['part']} of the id store is not what the manifest says")
    if found:
        raise ValueError(f"parts {sorted(found)} of the id store are not in the manifest")
    return form


def _chunks(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """The chunks as a bucketed table, registered only while it is looked up."""
    name = _name()
    spark.sql(f"CREATE TABLE {name} (digest BINARY, payload BINARY, uses BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}/chunks'")
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def _streams(spark: SparkSession, path: str, form) -> DataFrame:
    """(row, doc_id, local_start, part, n_tokens, root, pos, digest, payload) with the chunks of a document in order within one partition.

    A payload is null where its chunk is lost.
    """
    recipes = spark.read.parquet(f"{path}/recipes")
    chunks = _chunks(spark, path, form["buckets"])
    each = recipes.select("row", "doc_id", "part", "local_start", "n_tokens", "root", F.posexplode("digests").alias("pos", "digest"))
    # fewer than HOT chunks can have so many uses, of at most MOST ids each
    often = chunks.where(F.col("uses") * HOT > form["uses"]).select("digest", "payload")
    if form["uses"] > HOT and not often.isEmpty():
        each = each.join(F.broadcast(often), "digest", "left")
        known = each.where("payload is not null")
        each = known.unionByName(each.where("payload is null").drop("payload").join(chunks.select("digest", "payload"), "digest", "left"))
    else:
        each = each.join(chunks.select("digest", "payload"), "digest", "left")
    return each.repartition("row").sortWithinPartitions("row", "pos")


def read_store(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) reconstructed from the store's files and verified.

    Raises where a table lacks a row or a row is not what the digests above it say: for the
    manifest and the recipes at once, for chunks when the result is computed.
    """
    form = _verified(spark, path)
    kind, width = spark.read.parquet(f"{path}/recipes").schema["doc_id"].dataType.simpleString(), form["width"]
    shared = spark.sparkContext.broadcast(bytes(form["dictionary"]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _codec(shared.value, zstandard.ZstdDecompressor).decompress
        now, leaves, parts = None, [], []

        def close(done: list) -> None:
            row, doc_id, part, local, tokens, root = now
            stream = np.frombuffer(b"".join(parts), f"<u{width}").astype("<u4").tobytes()
            if merkle(leaves) != root or len(stream) != 4 * tokens:
                raise ValueError(f"document row {row} is not what its recipe says")
            done.append((doc_id, part, local, tokens, zlib.crc32(stream), stream))

        def batch_of(done: list, id_type: pa.DataType) -> pa.RecordBatch:
            cols = list(zip(*done, strict=True))
            made = [pa.array(cols[0], id_type), *(pa.array(c, t) for c, t in zip(cols[1:5], (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))]
            names = ["doc_id", "part", "local_start", "n_tokens", "ids_crc32"]
            return pa.record_batch(made + [pa.array(cols[5], pa.binary())] * ids, names + ["ids"] * ids)

        id_type = None
        for batch in batches:
            id_type = column(batch, "doc_id").type
            done: list = []
            rows = column(batch, "row").to_numpy()
            own = [column(batch, c) for c in ("row", "doc_id", "part", "local_start", "n_tokens", "root")]
            names, payloads = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("digest", "payload"))
            turns = np.concatenate([[0], np.flatnonzero(rows[1:] != rows[:-1]) + 1, [len(rows)]]).tolist()
            for lo, hi in zip(turns, turns[1:], strict=False):
                if lo == hi:
                    continue
                if now is None or rows[lo] != now[0]:
                    if now is not None:
                        close(done)
                    now, leaves, parts = tuple(c[lo].as_py() for c in own), [], []
                for name, payload in zip(names[lo:hi], payloads[lo:hi], strict=True):
                    if payload is None:
                        raise ValueError(f"chunk {name.hex()} is lost")
                    try:
                        payload = unpack(payload)
                    except zstandard.ZstdError:
                        payload = b""
                    if digest(payload) != name:
                        raise ValueError(f"chunk {name.hex()} is damaged")
                    leaves.append(name)
                    parts.append(payload)
            if done:
                yield batch_of(done, id_type)
        if now is not None:
            close(done := [])
            yield batch_of(done, id_type)

    got = map_arrow(_streams(spark, path, form), run, f"doc_id {kind}, part int, local_start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)
    # the manifest has a row for each task of the writer, so it may be broadcast
    manifest = spark.read.parquet(f"{path}/manifest").select("part", F.col("start").alias("base"))
    return got.join(F.broadcast(manifest), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] * ids))


def op3_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "idstore")
    write_store(table(spark, sf_dir, "documents"), path)
    return read_store(spark, path)
