"""Operator 4 - document fingerprints by improbable features.

Every window of WIDTH bytes has a rarity: how far its byte entropy lies from the entropy
usual for text (a fixed rule, so that fingerprints of different corpora compare). A window
that is the rarest of its neighbourhood often enough is a feature; features go, in the
order of the text, into a chain of Bloom filters of FILTER bits with up to LOAD features
each. Two chains are as alike as their filters' bit overlap, normalised between what
chance gives and the most possible, each filter of the shorter chain against its best
counterpart, weighted by features.

Entropies are rolled over the text in fixed-point arithmetic, so that a window's value
depends on its bytes alone, and an edited text reuses the values of what it shares with
the original.

Neighbours in doc_id order meet by one shuffle: cut points of doc_id are taken from the
table itself, every document goes to its part, and the document at a cut point also, as a
guest, to the part before. Nothing is collected but the cut points (one for PART_CHARS of
text, MOST_PARTS at most), and rows are streamed, two documents in memory at a time.

Defined results: a null text is the empty text; an empty text has the empty fingerprint,
like 1 to another empty one and 0 to any other; a text of fewer than WIDTH bytes is one
feature; a table of one row is its own next document; rows that repeat a doc_id follow
each other by a hash of their text, null ids come first; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticelake.llm.common import column, map_arrow, table, texts_of

WIDTH, NEIGHBOURS, POPULAR = 64, 64, 16
FILTER, HASHES, LOAD = 2048, 5, 160
#: The entropy of text windows in bits, from which rarity is measured.
USUAL = 4.05
#: Characters of text for which there is one cut point, and cut points at most: beyond, parts grow and are sorted with spills.
PART_CHARS, MOST_PARTS = 8_000_000, 20_000

_ONE = 1 << 20  # fixed point
_F = np.array([0] + [round(c * math.log2(c) * _ONE) for c in range(1, WIDTH + 1)], np.int64)
_STEP = np.concatenate([[0], np.diff(_F)])
_MIDDLE = round((WIDTH * math.log2(WIDTH) - WIDTH * USUAL) * _ONE)
_FAR = 1 << 29
_AT = (1 << 33) - 1


def rarity(b: np.ndarray) -> np.ndarray:
    """Distance of each window's entropy from the usual one, for at least WIDTH bytes."""
    n = len(b)
    order = np.argsort(b, kind="stable")
    key = b[order].astype(np.int64) * (n + 2 * WIDTH) + order
    rank = np.arange(n)
    ahead, behind = np.empty(n, np.int64), np.empty(n, np.int64)
    ahead[order] = np.searchsorted(key, key + WIDTH) - rank  # the same byte within the window that starts here
    behind[order] = rank + 1 - np.searchsorted(key, key - (WIDTH - 1))  # within the window that ends here
    sums = np.empty(n - WIDTH + 1, np.int64)
    sums[0] = _F[np.bincount(b[:WIDTH])].sum()
    sums[1:] = _STEP[behind[WIDTH:]] - _STEP[ahead[: n - WIDTH]]
    return np.abs(np.cumsum(sums) - _MIDDLE)


def select(far: np.ndarray) -> np.ndarray:
    """Starts of windows that are the rarest, leftmost on ties, of POPULAR neighbourhoods."""
    key = (_FAR - far << 33) + np.arange(len(far))
    if len(key) <= NEIGHBOURS:
        return np.array([key.min() & _AT])
    width = 1
    while width < NEIGHBOURS:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    best = np.bincount(key & _AT)
    found = np.flatnonzero(best >= POPULAR)
    return found if len(found) else np.array([best.argmax()])


class Digest:
    """A chain of Bloom filters."""

    def __init__(self, raw: bytes, starts: Iterable[int]):
        marks = list(dict.fromkeys(xxhash.xxh3_128_digest(raw[p : p + WIDTH]) for p in starts))
        n = len(marks)
        self.bits = np.zeros((-(-n // LOAD), FILTER), np.uint8)
        self.load = np.array([min(LOAD, n - i) for i in range(0, n, LOAD)], float)
        if n:
            low = np.frombuffer(b"".join(marks), "<u8").reshape(-1, 2)[:, 0]
            at = (low[:, None] >> (np.arange(HASHES, dtype=np.uint64) * np.uint64(11))) & np.uint64(FILTER - 1)
            self.bits[np.repeat(np.arange(n) // LOAD, HASHES), at.ravel().astype(np.int64)] = 1

    def text(self) -> str:
        return base64.b64encode(np.packbits(self.bits, axis=1).tobytes()).decode()

    def likeness(self, other: Digest) -> float:
        a, b = (self, other) if len(self.bits) <= len(other.bits) else (other, self)
        if not len(a.bits):
            return float(not len(b.bits))
        x, y = a.bits.astype(np.float32), b.bits.astype(np.float32)
        nx, ny = x.sum(1)[:, None], y.sum(1)[None]
        chance, most = nx * ny / FILTER, np.minimum(nx, ny)
        part = (x @ y.T - chance) / np.maximum(most - chance, 1e-9)
        return float(np.clip((part.max(1) * a.load).sum() / a.load.sum(), 0, 1))


class Fingerprinted:
    """One text with its bytes, window rarities and digest."""

    def __init__(self, text: str):
        self.text, self.raw = text, text.encode()
        b = np.frombuffer(self.raw, np.uint8)
        self.far = rarity(b) if len(b) >= WIDTH else None
        self.digest = _digest(self.raw, self.far)

    def edited(self, following: str) -> tuple[bytes, Digest]:
        """The edited text's bytes and digest; window values of the shared start are reused."""
        n = len(self.text)
        start = self.text[: n - n // 4].encode()
        raw = start + following[: n // 4].encode()
        if len(raw) < WIDTH:
            return raw, _digest(raw, None)
        same = len(start) - WIDTH + 1
        if self.far is None or same <= 0:
            return raw, _digest(raw, rarity(np.frombuffer(raw, np.uint8)))
        tail = np.frombuffer(raw, np.uint8)[same:]
        return raw, _digest(raw, np.concatenate([self.far[:same], rarity(tail)]) if len(tail) >= WIDTH else self.far[:same])


def _digest(raw: bytes, far: np.ndarray | None) -> Digest:
    return Digest(raw, [0] if raw and far is None else [] if far is None else select(far).tolist())


def _cut_points(docs: DataFrame) -> list[int]:
    """Values of doc_id that part the table into stretches of about PART_CHARS characters; the least comes first."""
    key = _key()
    total = docs.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 64).alias("n")).first()["n"] or 0
    parts = min(MOST_PARTS, max(1, -(-total // PART_CHARS)))
    shares = [i / parts for i in range(parts)]
    got = docs.agg(F.percentile_approx(key, shares, 20 * parts + 100).alias("at"), F.min(key).alias("least")).first()
    return sorted({got["least"], *(got["at"] or ())}) if got["least"] is not None else []


def _key():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    cuts = np.array(_cut_points(docs), np.int64)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            key = column(batch, "key").to_numpy()
            part = np.searchsorted(cuts, key, side="right") - 1
            packed = pa.array([pack(t.encode()) for t in texts_of(batch)], pa.binary())
            guest = np.flatnonzero(cuts[part] == key) if len(cuts) else np.empty(0, np.int64)
            rows = pa.array(np.concatenate([np.arange(len(key)), guest]))
            where = np.concatenate([part, (part[guest] - 1) % max(1, len(cuts))])
            flag = np.concatenate([np.zeros(len(key), bool), np.ones(len(guest), bool)])
            yield pa.record_batch(
                [pa.array(where.astype(np.int32)), pa.array(flag), *(x.take(rows) for x in (column(batch, "key"), column(batch, "tie"), column(batch, "doc_id"), packed))],
                ["part", "guest", "key", "tie", "doc_id", "packed"],
            )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        last_part, last, done = None, None, False
        for batch in batches:
            rows = []
            for part, guest, doc_id, packed in zip(*(column(batch, c).to_pylist() for c in ("part", "guest", "doc_id", "packed")), strict=True):
                if part != last_part:
                    last_part, last, done = part, None, False
                if done:
                    continue
                now = Fingerprinted(unpack(packed).decode())
                if last is not None:
                    own_id, own = last
                    raw, digest = own.edited(now.text)
                    rows.append((own_id, len(own.text), hashlib.sha256(raw).hexdigest(), own.digest.text(), digest.text(), own.digest.likeness(digest), own.digest.likeness(now.digest)))
                last, done = (doc_id, now), guest
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.record_batch([pa.array(cols[0], column(batch, "doc_id").type), *(pa.array(c, k) for c, k in zip(cols[1:], kinds, strict=True))], names)

    keyed = docs.select("doc_id", "text", _key().alias("key"), F.xxhash64("text").alias("tie"))
    dealt = map_arrow(keyed, deal, f"part int, guest boolean, key long, tie long, doc_id {kind}, packed binary")
    ordered = dealt.repartition("part").sortWithinPartitions("part", "guest", "key", "tie").select("part", "guest", "doc_id", "packed")
    return map_arrow(ordered, run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
