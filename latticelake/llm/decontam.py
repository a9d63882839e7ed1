"""Operator 9 - benchmark decontamination by winnowing.

Of every WINDOW - K + 1 consecutive k-gram hashes of words the least is kept as a
fingerprint, on the side of the benchmark as on that of the documents, so two texts
that share WINDOW consecutive words share a fingerprint. Fingerprints of both sides are
joined, and each hit is extended: the windows around it are compared word by word.

The benchmark's fingerprints are broadcast only after its size was measured to be below
``BROADCAST_CHARS``; a larger benchmark is joined by a shuffle on the fingerprint, with
document fingerprints made distinct within their document first. Either way gives the
same rows. Items shorter than a window are one window of their own length, looked up
directly by a hash of that length.

Defined results: null and empty texts have no words (counts 0, not contaminated); an
item without words owns no window; an item without id is ignored; items that repeat an
id count once; repeated documents are rows of their own; an empty benchmark leaves every
document clean; columns other than doc_id/text and item_id/text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticelake.llm.common import Memo, blocks, column, documents, held, map_arrow, table, texts_of
from latticelake.session import materialize

#: Words of a window, and of the k-grams that are winnowed: spans of WINDOW words are found for certain.
WINDOW, K = 8, 5
#: Characters of all items up to which their fingerprints are broadcast.
BROADCAST_CHARS = 1_000_000
#: Items with occurring windows from which a document counts as contaminated.
CONTAMINATED = 2
CACHE = 200_000

#: Words as asked for, with A-Z still in them; each word is lower-cased when it is first met.
_PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_WORDS, _SPANS = _PATTERN.findall, _PATTERN.finditer
_LOWER = {i: i + 32 for i in range(65, 91)}
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FENCE = 0xD1B54A32D192ED03


def lower(word: str) -> str:
    return word.translate(_LOWER)


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(lower(word).encode())


def _memo() -> Memo:
    return held("decontam", lambda: Memo(word_hash, CACHE))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams of a sequence of word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _BASE
        out += h[j : j + n]
    out ^= out >> np.uint64(29)
    return out


def winnow(g: np.ndarray, w: int) -> np.ndarray:
    """Positions kept of k-gram hashes: the rightmost least of every ``w`` in a row."""
    n = len(g) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, at = g[:n].copy(), np.arange(n)
    for j in range(1, w):
        other = g[j : j + n]
        less = other <= best
        best[less] = other[less]
        at[less] = np.flatnonzero(less) + j
    return np.unique(at)


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``among``."""
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


class Probe:
    """Fingerprints and windows of some items."""

    def __init__(self, items: Iterable[tuple[str, str | None]], window: int = WINDOW, k: int = K):
        self.window, self.k = window, k
        self.owners: dict[tuple[str, ...], set[str]] = {}
        fps, wins, short = [], [], {}
        for item, text in items:
            words = [lower(w) for w in _WORDS(text or "")]
            size = min(window, len(words))
            if not size:
                continue
            for i in range(len(words) - size + 1):
                self.owners.setdefault(tuple(words[i : i + size]), set()).add(item)
            h = np.array([word_hash(w) for w in words], np.uint64)
            if size < window:
                short.setdefault(size, []).append(grams(h, size))
            else:
                g = grams(h, k)
                fps.append(g[winnow(g, window - k + 1)])
                wins.append(grams(h, window))
        join = lambda x: np.unique(np.concatenate(x)) if x else np.empty(0, np.uint64)
        self.fps, self.wins, self.short = join(fps), join(wins), {m: join(x) for m, x in short.items()}

    def starts(self, h: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(length, starts) of windows of ``h`` that items may own, by their hashes."""
        g = grams(h, self.k)
        w = self.window - self.k + 1
        kept = winnow(g, w)
        hit = kept[member(g[kept], self.fps)]
        if len(hit):
            s = np.unique((hit[:, None] - np.arange(w)).ravel())
            s = s[(s >= 0) & (s <= len(h) - self.window)]
            around = grams(h, self.window)[s] if len(s) else np.empty(0, np.uint64)
            yield self.window, s[member(around, self.wins)]
        for m, own in self.short.items():
            yield m, np.flatnonzero(member(grams(h, m), own))


def _hashes(texts: list[str], memo: Memo) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """Words of each text, all their hashes with a fence behind each text, and where texts start."""
    words = [_WORDS(t) for t in texts]
    flat: list[int] = []
    starts = []
    get = memo.__getitem__
    for ws in words:
        starts.append(len(flat))
        flat.extend(map(get, ws))
        flat.append(_FENCE)
    return words, np.array(flat, np.uint64), np.array(starts)


def hits(texts: list[str], probe: Probe, memo: Memo) -> list[tuple[int, set[int], set[str]]]:
    """For each text: words, positions of words that are hit, items with occurring windows."""
    words, h, starts = _hashes(texts, memo)
    out = [(len(ws), set(), set()) for ws in words]
    for size, at in probe.starts(h):
        docs = np.searchsorted(starts, at, side="right") - 1
        for d, s in zip(docs.tolist(), (at - starts[docs]).tolist(), strict=True):
            if own := probe.owners.get(tuple(map(lower, words[d][s : s + size]))):
                out[d][1].update(range(s, s + size))
                out[d][2].update(own)
    return out


_SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _rows(ids: pa.Array, found: list[tuple[int, int, set[str]]]) -> pa.RecordBatch:
    digest = [hashlib.sha256(",".join(sorted(items)).encode()).hexdigest() for _, _, items in found]
    counts = [len(items) for _, _, items in found]
    return pa.record_batch(
        [
            ids, pa.array([n for n, _, _ in found], pa.int64()), pa.array([k for _, k, _ in found], pa.int64()), pa.array(counts, pa.int64()),
            pa.array(digest, pa.string()), pa.array([c >= CONTAMINATED for c in counts], pa.bool_()),
        ],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    )


def _sized(items: DataFrame) -> tuple[DataFrame, int]:
    """Items as (item_id, text), and how many characters they take."""
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    return items, items.agg(F.sum(F.length("text") + F.length("item_id") + 16).alias("n")).first()["n"] or 0


def decontaminate(docs: DataFrame, items: DataFrame, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every document."""
    items, size = _sized(items)
    if size <= broadcast_chars:
        return _by_broadcast(docs, [tuple(r) for r in items.collect()])
    return _by_shuffle(docs, items)


def _probe(shared, mark: str) -> tuple[Probe, Memo]:
    """The probe of broadcast items and the table of word hashes, made once in a worker."""
    return held(("decontam", mark), lambda: (Probe(shared.value), Memo(word_hash, CACHE)))


def _mark(items: list[tuple[str, str]]) -> str:
    return hashlib.sha256(repr(sorted(items)).encode()).hexdigest()


def _by_broadcast(docs: DataFrame, items: list[tuple[str, str]]) -> DataFrame:
    shared, mark = docs.sparkSession.sparkContext.broadcast(items), _mark(items)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe, memo = _probe(shared, mark)
        for batch in batches:
            texts = texts_of(batch)
            for lo, hi in blocks(texts):
                found = hits(texts[lo:hi], probe, memo)
                yield _rows(column(batch, "doc_id").slice(lo, hi - lo), [(n, len(at), own) for n, at, own in found])

    return map_arrow(documents(docs), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_SCHEMA}")


def _fingerprints(df: DataFrame, key: str, kind: str, short: tuple[int, ...] = ()) -> DataFrame:
    """(key, fp): distinct fingerprints of each text; of documents also all k-grams of the lengths ``short``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo()
        for batch in batches:
            keys = column(batch, "key")
            rows, fps = [], []
            for i, text in enumerate(texts_of(batch)):
                h = np.array([memo[w] for w in _WORDS(text)], np.uint64)
                if kind == "item" and len(h) < WINDOW:
                    own = grams(h, len(h)) + np.uint64(len(h)) if len(h) else h
                else:
                    g = grams(h, K)
                    own = g[winnow(g, WINDOW - K + 1)]
                    if kind == "doc":
                        own = np.concatenate([own, *(grams(h, m) + np.uint64(m) for m in short)])
                own = np.unique(own).view(np.int64)
                rows += [i] * len(own)
                fps.append(own)
            yield pa.record_batch([keys.take(pa.array(rows, pa.int64())), pa.array(np.concatenate(fps) if fps else np.empty(0, np.int64))], ["key", "fp"])

    return map_arrow(df.select(F.col(key).alias("key"), "text"), run, f"key {df.schema[key].dataType.simpleString()}, fp long")


def _count(df: DataFrame, key: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([column(batch, key), pa.array([len(_WORDS(t)) for t in texts_of(batch)], pa.int64())], [key, "n_words"])

    return map_arrow(df.select(key, "text"), run, f"{key} long, n_words long")


def _hits_by_shuffle(keyed: DataFrame, items: DataFrame) -> DataFrame:
    """(row, at, own): words hit and items with occurring windows of the documents (row, text) that have any.

    The way beyond the broadcast: fingerprints joined by a shuffle, then only matched
    pairs of texts compared.
    """
    items = materialize(items.distinct().select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "decontam-items")
    short = tuple(m for m in (r["n_words"] for r in _count(items, "item").select("n_words").distinct().where(f"n_words < {WINDOW}").collect()) if m)
    left = _fingerprints(keyed, "row", "doc", short).withColumnRenamed("key", "row")
    right = _fingerprints(items, "item", "item").withColumnRenamed("key", "item").distinct()
    pairs = left.join(right, "fp").select("row", "item").distinct()
    texts = pairs.join(items, "item").join(keyed.select("row", F.col("text").alias("doc_text")), "row")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo()
        for batch in batches:
            at, own = [], []
            for item, text, doc in zip(column(batch, "item_id").to_pylist(), texts_of(batch), texts_of(batch, "doc_text"), strict=True):
                _, where, names = hits([doc], Probe([(item, text)]), memo)[0]
                at.append(sorted(where))
                own.append(item if names else None)
            yield pa.record_batch([column(batch, "row"), pa.array(at, pa.list_(pa.int64())), pa.array(own, pa.string())], ["row", "at", "item_id"])

    found = map_arrow(texts.select("row", "item_id", "text", "doc_text"), run, "row long, at array<long>, item_id string").where("item_id is not null")
    return found.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.array_sort(F.collect_set("item_id")).alias("own"))


def _by_shuffle(docs: DataFrame, items: DataFrame) -> DataFrame:
    keyed = materialize(documents(docs).withColumn("row", F.monotonically_increasing_id()), "decontam-docs")
    each = _hits_by_shuffle(keyed, items)
    n = keyed.select("row", "doc_id").join(_count(keyed, "row"), "row")
    own, at = F.coalesce("own", F.array().cast("array<string>")), F.coalesce("at", F.array().cast("array<long>"))
    return n.join(each, "row", "left").select(
        "doc_id", "n_words", F.size(at).cast("long").alias("n_hit"), F.size(own).cast("long").alias("n_items"),
        F.sha2(F.array_join(own, ","), 256).alias("items_sha256"), (F.size(own) >= CONTAMINATED).alias("contaminated"),
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
items as (
  select item_id::varchar item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws
  from benchmark where item_id is not null),
sizes as (select distinct least(8, len(ws)) m from items where len(ws) > 0),
iw as (
  select distinct item_id, least(8, len(ws)) m, array_to_string(ws[i : i + least(8, len(ws)) - 1], ' ') win
  from (select item_id, ws, unnest(range(1, len(ws) - least(8, len(ws)) + 2)) i from items where len(ws) > 0)),
wins as (select distinct m, win from iw),
dw as (
  select doc_id, m, i, array_to_string(ws[i : i + m - 1], ' ') win
  from (select doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) i from w, sizes)),
found as (select dw.doc_id, dw.m, dw.i, dw.win from dw join wins using (m, win)),
hit as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + m)) p from found) group by doc_id),
own as (
  select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) ids
  from (select distinct doc_id, item_id from found join iw using (m, win)) group by doc_id)
select w.doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_items, 0) >= 2 contaminated
from w left join hit using (doc_id) left join own using (doc_id)
"""


def _cut(text: str, at: set[int]) -> str:
    """The text without the stretches of words that were hit."""
    spans = [(m.start(), m.end()) for m in _SPANS(text)]
    out, last = [], 0
    for i in sorted(at):
        if i - 1 not in at:
            out.append(text[last : spans[i][0]])
        last = spans[i][1]
    return "".join([*out, text[last:]])


def _rewritten(batch: pa.RecordBatch, found: list[tuple[set[int], int]]) -> pa.RecordBatch:
    """The batch with hits cut out of its texts, without contaminated rows."""
    i = batch.schema.get_field_index("text")
    new = [_cut(t, at) if at else t for t, (at, _) in zip(batch.column(i).to_pylist(), found, strict=True)]
    stay = pa.array([n < CONTAMINATED for _, n in found], pa.bool_())
    return batch.set_column(i, batch.schema.field(i), pa.array(new, batch.schema.field(i).type)).filter(stay)


def clean(docs: DataFrame, items: DataFrame, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """The rows of ``docs`` without benchmark passages: contaminated documents go, other hits are cut out.

    A cut runs from the first word hit to the last of a row of words hit; n_chars follows
    where there is such a column. All other columns stay as they are.
    """
    items, size = _sized(items)
    if size <= broadcast_chars:
        own = [tuple(r) for r in items.collect()]
        shared, mark = docs.sparkSession.sparkContext.broadcast(own), _mark(own)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            probe, memo = _probe(shared, mark)
            for batch in batches:
                texts = texts_of(batch)
                found = [(at, len(own)) for lo, hi in blocks(texts) for _, at, own in hits(texts[lo:hi], probe, memo)]
                yield _rewritten(batch, found)

        out = map_arrow(docs, run, docs.schema)
    else:
        keyed = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "decontam-docs")
        each = _hits_by_shuffle(keyed.select(F.col("__row").alias("row"), "text"), items).select(F.col("row").alias("__row"), F.col("at").alias("__at"), F.size("own").alias("__n"))

        names = docs.columns

        def rewrite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(set(at or ()), n or 0) for at, n in zip(column(batch, "__at").to_pylist(), column(batch, "__n").to_pylist(), strict=True)]
                yield _rewritten(batch, found).select(names)

        out = map_arrow(keyed.join(each, "__row", "left").drop("__row"), rewrite, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
