"""Operator 1 - byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pre-tokens of a block of documents are laid out as one array of byte
tokens. An inverted index leads from each merge (the rank of the merged token) to the
positions where its pair stands; the merges are replayed in rank order over the whole
block at once, and each application touches only the two neighbouring pairs. Encoded
pre-tokens stay in a bounded table for the blocks that follow, so a word of the corpus
is replayed about once per task, however often it occurs. No shuffle is needed, memory
is bounded by the block and the table, and a lost task only repeats its own split.

Defined results: a null text is the empty text; an empty text has no tokens; repeated
rows are encoded alike; columns other than ``doc_id`` and ``text`` are ignored, so
that names may clash with the results' names; special-token strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from latticelake.llm.common import PieceStreams, blocks, column, documents, held, map_arrow, table, texts_of

#: Entries of the tables of encoded pieces and pre-tokens in one Python worker.
CACHE = 1_200_000


class MergeReplay:
    """Replays the merges of a rank file over many words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.vocab: dict[int, bytes] = {i: b for b, i in ranks.items()}
        self.first = np.array([ranks[bytes([b])] for b in range(256)])
        self.wide = max(ranks.values()) + 1
        self.pairs: dict[int, int] = {}
        first = self.first.tolist()
        #: The rank that two bytes merge to, or -1.
        self.start = np.array([self.merged(a * self.wide + b) for a in first for b in first])

    def merged(self, key: int) -> int:
        """The rank that the pair ``key`` merges to, or -1."""
        a, b = divmod(key, self.wide)
        rank = self.pairs[key] = self.ranks.get(self.vocab[a] + self.vocab[b], -1)
        return rank

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size): the ids of all words, and where each word's lie."""
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        raw = np.frombuffer(b"\0".join(words) + b"\0", np.uint8).astype(np.int64)
        ends = np.cumsum([len(w) + 1 for w in words])
        flat = self.first[raw]
        flat[ends - 1] = -1  # a fence between words
        rank = self.start[raw[:-1] * 256 + raw[1:]]
        rank[(flat[:-1] < 0) | (flat[1:] < 0)] = -1
        order = np.argsort(rank, kind="stable")
        order = order[np.searchsorted(rank[order], 0) :]
        own, lo = np.unique(rank[order], return_index=True)
        index: dict[int, list[int]] = {r: part.tolist() for r, part in zip(own.tolist(), np.split(order, lo[1:]), strict=True)} if len(own) else {}
        ids: list[int] = flat.tolist()
        n, wide, pairs, merged, ends = len(ids), self.wide, self.pairs, self.merged, ends.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = list(index)
        heapify(heap)
        while heap:
            r = heappop(heap)
            places = index.pop(r)
            places.sort()
            wait, later = -1, []
            for p in places:
                if p < wait:  # a lower rank appeared in this word and goes first
                    later.append(p)
                    continue
                a = ids[p]
                q = after[p]
                if a < 0 or ids[q] < 0 or pairs[a * wide + ids[q]] != r:
                    continue
                ids[p], ids[q] = r, -2
                q = after[p] = after[q]
                before[q] = p
                b, o = ids[q], before[p]
                if b >= 0:
                    key = r * wide + b
                    m = pairs[key] if key in pairs else merged(key)
                    if m >= 0:
                        if m in index:
                            index[m].append(p)
                        else:
                            index[m] = [p]
                            heappush(heap, m)
                        if m < r:
                            wait = ends[bisect_right(ends, p)]
                if o >= 0 and (b := ids[o]) >= 0:
                    key = b * wide + r
                    m = pairs[key] if key in pairs else merged(key)
                    if m >= 0:
                        if m in index:
                            index[m].append(o)
                        else:
                            index[m] = [o]
                            heappush(heap, m)
                        if m < r:
                            wait = ends[bisect_right(ends, p)]
            if later:
                if r in index:
                    index[r].extend(later)
                else:
                    index[r] = later
                    heappush(heap, r)
        flat = np.array(ids)
        kept = np.concatenate([[0], np.cumsum(flat >= 0)])
        stop = kept[ends]
        start = np.concatenate([[0], stop[:-1]])
        return flat[flat >= 0], start, stop - start


class Encoder(PieceStreams):
    """Texts to id streams (little-endian unsigned 32-bit) and back, for one vocabulary."""

    def __init__(self, path: str, pattern: str):
        super().__init__(pattern, "<u4", CACHE)
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.replay = MergeReplay(self.ranks)

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A word of the vocabulary is its own token; the merges are replayed over all others at once."""
        raw = [w.encode() for w in words]
        known = np.array([w in self.ranks for w in raw], bool)
        ids, start, n = self.replay.encode([w for w in raw if w not in self.ranks])
        own = np.array([self.ranks[w] for w in raw if w in self.ranks], np.int64)
        at, size = np.empty(len(raw), np.int64), np.ones(len(raw), np.int64)
        at[~known], size[~known] = start, n
        at[known] = len(ids) + np.arange(len(own))
        return np.concatenate([ids, own]).astype(self.kind), at, size

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The id stream of each text of one block."""
        flat, starts = self.streams(texts)
        raw = flat.tobytes()
        for lo, hi in zip(starts.tolist(), starts[1:].tolist(), strict=False):
            yield raw[4 * lo : 4 * hi]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.replay.vocab.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoder(path: str, pattern: str) -> Encoder:
    return held(("bpe", path, pattern), lambda: Encoder(path, pattern))


def _default(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids): the whole texts' token ids as little-endian unsigned 32-bit integers."""
    path, pattern = _default(path, pattern)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            texts = texts_of(batch)
            for lo, hi in blocks(texts):
                ids = list(enc.encode(texts[lo:hi]))
                yield pa.record_batch(
                    [column(batch, "doc_id").slice(lo, hi - lo), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "n_tokens", "ids"],
                )

    return map_arrow(documents(docs), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, decoded): the bytes that ``encode``'s ids stand for; null ids are the empty stream."""
    path, pattern = _default(path, None)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            out = [enc.decode(x or b"") for x in column(batch, "ids").to_pylist()]
            yield pa.record_batch([column(batch, "doc_id"), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return map_arrow(encoded.select("doc_id", "ids"), run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, decoded binary")


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes, decodes and digests within one pass."""
    path, pattern = _default(path, pattern)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            texts = texts_of(batch)
            n, sums, back = [], [], []
            for lo, hi in blocks(texts):
                for ids in enc.encode(texts[lo:hi]):
                    n.append(len(ids) // 4)
                    sums.append(hashlib.sha256(ids).hexdigest())
                    back.append(hashlib.sha256(enc.decode(ids)).hexdigest())
            yield pa.record_batch([column(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(sums, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(documents(docs), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
