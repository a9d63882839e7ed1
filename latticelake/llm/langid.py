"""Operator 5 - language identification by cross-parsing entropy.

For each language a suffix automaton holds a sample of its labelled text. A text is
parsed into the longest phrases that the automaton knows; the fewer phrases it needs for
each letter, the closer the text is to that language. Words are parsed one by one (with
their end marked), so phrase counts of a word are computed once per task and summed over
the document: all words of the whole text count.

The sample is bounded by DOCS_PER_LANG rows of each language, taken by the least hash of
doc_id, and DOC_CHARS characters of each: stretches of STRETCH characters spread evenly
over the whole text. Only these bounded strings of at most LANGS languages go to the driver
and to the workers; a table with more languages is an error.

Defined results: a null text or one without any letter is ``und`` with score 0, as is
every text where no labelled document exists; equal rates go to the language that sorts
first; repeated rows are predicted alike; lang, source and doc_id are no inputs of a
prediction; columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticelake.llm.common import Memo, column, held, map_arrow, table, texts_of

LANGS, DOCS_PER_LANG, DOC_CHARS, STRETCH = 1_000, 40, 1_000, 200
#: Folds of documents by crc32 of their id; the fold HELD_OUT is never learned from.
FOLDS, HELD_OUT = 4, 2
#: Sharpness of the score: a softmax over phrases per letter.
SHARP = 20.0
#: Phrases per letter from which a text is like none of the languages.
REJECT_RATE = 0.8
CACHE = 200_000
_LANE = 40  # bits of one language's count in a packed sum

_LETTERS = re.compile(r"[^\W\d_]+").findall


class SuffixAutomaton:
    """Recognises every substring of a text; built online, a state and a link per letter."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur

    def phrases(self, word: str) -> int:
        """Phrases of the greedy longest-match parse; an unknown letter is a phrase of its own."""
        step, n, state = self.next, 0, 0
        for c in word:
            to = step[state].get(c)
            if to is None:
                n += state != 0  # the phrase so far ends before c
                to = step[0].get(c)
                if to is None:
                    n, to = n + 1, 0
            state = to
        return n + (state != 0)


def normalise(text: str) -> str:
    """Lower-cased words of letters, each followed by one space."""
    return "".join(w + " " for w in _LETTERS(text.lower()))


class Parser:
    """Phrase counts of pieces of text under every language, packed into one integer."""

    def __init__(self, model: tuple[tuple[str, str], ...]):
        self.langs = [lang for lang, _ in model]
        self.automata = [SuffixAutomaton(sample) for _, sample in model]
        self.counts = Memo(self._count, CACHE)

    def _count(self, piece: str) -> int:
        packed = 0
        for w in _LETTERS(piece.lower()):
            letters = sum(map(str.isalpha, w))
            if letters:
                packed += letters
                for i, a in enumerate(self.automata, 1):
                    packed += a.phrases(w + " ") << _LANE * i
        return packed

    def predict(self, text: str) -> tuple[str, float, float]:
        """(language, score, phrases per letter)."""
        packed = sum(map(self.counts.__getitem__, text.split()))
        mask = (1 << _LANE) - 1
        letters = packed & mask
        if not letters or not self.langs:
            return "und", 0.0, 1.0
        rates = [(packed >> _LANE * i & mask) / letters for i in range(1, len(self.langs) + 1)]
        best = min(range(len(rates)), key=rates.__getitem__)
        return self.langs[best], 1 / sum(math.exp(SHARP * (rates[best] - r)) for r in rates), rates[best]


def parser(model: tuple[tuple[str, str], ...]) -> Parser:
    return held(("langid", model), lambda: Parser(model))


def fold(docs: DataFrame, folds: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def spread(text: str) -> str:
    """The normalised text, or DOC_CHARS characters of it in stretches spread evenly from its beginning to its end."""
    whole = normalise(text)
    if len(whole) <= DOC_CHARS:
        return whole
    n = DOC_CHARS // STRETCH
    step = (len(whole) - STRETCH) / (n - 1)
    return "".join(whole[round(i * step) : round(i * step) + STRETCH] for i in range(n))


def fit(docs: DataFrame) -> tuple[tuple[str, str], ...]:
    """((language, sample), ...) from the bounded sample described above."""
    order = Window.partitionBy("lang").orderBy("h", "own")
    labelled = docs.where("lang is not null and text is not null and doc_id is not null").where(fold(docs, FOLDS) != HELD_OUT)
    labelled = labelled.select("lang", F.xxhash64(F.col("doc_id").cast("string")).alias("h"), F.md5("text").alias("own"), "text")
    light = labelled.select("lang", "h", "own").withColumn("at", F.row_number().over(order)).where(F.col("at") <= DOCS_PER_LANG)
    picked = light.select("lang", "h", "own").distinct().limit(LANGS * DOCS_PER_LANG + 1).collect()
    if len({r["lang"] for r in picked}) > LANGS:
        raise ValueError(f"more than {LANGS} languages in the column lang")
    if not picked:
        return ()
    wanted = F.broadcast(docs.sparkSession.createDataFrame(picked, "lang string, h long, own string"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array([spread(t) for t in texts_of(batch)], pa.string()))

    # rows of an id that repeats with its text give one sample
    rows = map_arrow(labelled.join(wanted, ["lang", "h", "own"]), run, "lang string, h long, own string, text string").dropDuplicates(["lang", "h", "own"]).collect()
    samples: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["h"], r["own"])):
        samples[r["lang"]] = samples.get(r["lang"], "") + r["text"]
    return tuple((lang, s) for lang, s in sorted(samples.items()) if s)


def identify(docs: DataFrame, model: tuple[tuple[str, str], ...], *keep: str) -> DataFrame:
    """(doc_id, *keep, lang_pred, score, rate) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema if f.name in ("doc_id", *keep)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser(shared.value)
        for batch in batches:
            found = [p.predict(t) for t in texts_of(batch)]
            yield pa.record_batch(
                [*(column(batch, f.name) for f in kept), *(pa.array([r[i] for r in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64())))],
                [*(f.name for f in kept), "lang_pred", "score", "rate"],
            )

    columns = list(dict.fromkeys(["doc_id", "text", *keep]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return map_arrow(docs.select(*columns), run, f"{schema}, lang_pred string, score double, rate double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, fit(docs))
    return out.select("doc_id", F.coalesce(fold(out, FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: tuple[tuple[str, str], ...]) -> DataFrame:
    """The rows of ``docs`` whose text has letters and needs fewer than REJECT_RATE phrases for each of them; all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser(shared.value)
        for batch in batches:
            found = [p.predict(t) for t in texts_of(batch)]
            yield batch.filter(pa.array([lang != "und" and rate < REJECT_RATE for lang, _, rate in found], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
