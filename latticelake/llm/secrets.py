"""Operator 2 - secret scans by a linear-chain conditional random field.

Three base patterns (assignments, access keys, hexadecimal runs) give spans for certain.
A conditional random field over tokens - tags begin, inside, outside - adds others: it
sees each token's shape, length and entropy, its neighbours, and features of the file,
and is decoded by Viterbi. Only tokens of at least CANDIDATE characters that hold a digit,
are long or dense, or follow a key word and an assignment sign may begin or continue a
secret; all others are held at outside, so that decoding around such tokens equals
decoding the whole text.

The field learns from the windows of at most SAMPLE documents (least hash of doc_id)
whose tokens the base patterns tag, cut into stretches of at most STRETCH tokens; the WINDOWS
stretches of least hash reach the driver, nothing else does.

Defined results: null and empty texts have no spans; spans are code points, end
exclusive; a span of the field that meets a base span is left out, for base spans stay as
they are; without anything to learn from, the field adds nothing; repeated rows give equal
spans; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticelake.llm.common import Memo, column, map_arrow, table, texts_of

KINDS = ("assign", "access", "hex", "crf")
#: Documents that the field learns from at most, stretches of their windows, and tokens of a stretch.
SAMPLE, WINDOWS, STRETCH = 1_000, 4_000, 120
#: Characters of a token that may be a secret; characters of context on each side of it.
CANDIDATE, CONTEXT = 8, 64
#: Characters from which a token without digits may be a secret by itself: of any kind, or of more than DENSE_BITS bits a character.
LONG, DENSE, DENSE_BITS = 20, 12, 3.5
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_DIGITS = re.compile(r"[0-9]+")
_TOKEN = re.compile(r"[\w+/.-]+|[^\w\s]")
_RUN = re.compile(rf"[\w+/.-]{{{CANDIDATE},}}")
_SET = re.compile("[:=]")
_KEY = re.compile(r"pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|credential|bearer|auth", re.I)
_O, _B, _I = 0, 1, 2


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns, each leftmost and non-overlapping within its kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def bits_of(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def strong(token: str) -> bool:
    """Whether a token may be part of a secret wherever it stands: it holds a digit, or is long or dense."""
    return len(token) >= CANDIDATE and (bool(_DIGITS.search(token)) or len(token) >= LONG or (len(token) >= DENSE and bits_of(token) > DENSE_BITS))


_MET = Memo(strong, 100_000)


def _strong(token: str) -> bool:
    return _MET[token] if len(token) < LONG else True


def _keyed(before: list[str]) -> bool:
    """Whether the four tokens before one make it a value: a sign in the last two, a key word in any."""
    return not {"=", ":"}.isdisjoint(before[-2:]) and any(_KEY.search(x) for x in before[-4:])


def _before(text: str, at: int) -> list[re.Match]:
    """The tokens before the one at ``at``, from CONTEXT characters back and at least four where there are so many."""
    size = 2 * CONTEXT
    while True:
        lo = max(0, at - size)
        found = list(_TOKEN.finditer(text, lo, at))[lo > 0 :]  # the first of a cut may be the rest of a token
        if lo == 0 or (len(found) >= 4 and found[0].start() <= at - CONTEXT):
            far = sum(m.start() <= at - CONTEXT for m in found)
            return found[max(0, min(far - 1, len(found) - 4)) :]
        size *= 4


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches of whole tokens around all that are free in the whole text, merged where they meet.

    Each has at least four tokens before a free one and one behind it, as far as the text
    has them: all that features, ``free`` and the steps from and to "outside" look at.
    """
    marks = {m.start(): m.end() for m in _RUN.finditer(text) if _strong(m[0])}
    for s in _SET.finditer(text):
        for m in islice(_TOKEN.finditer(text, s.end()), 2):
            if m.end() - m.start() >= CANDIDATE and m.start() not in marks and _keyed([x[0] for x in _before(text, m.start())]):
                marks[m.start()] = m.end()
    out: list[tuple[int, int]] = []
    for start, end in sorted(marks.items()):
        before = _before(text, start)
        lo, hi = before[0].start() if before else start, end
        for m in _TOKEN.finditer(text, end):
            hi = m.end()
            if hi >= end + CONTEXT:
                break
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def shape(token: str) -> str:
    """Runs of like characters, one sign each, up to six runs."""
    signs = ["d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in token[:64]]
    runs = [c for i, c in enumerate(signs) if not i or c != signs[i - 1]]
    return "".join(runs[:6]) + "+" * (len(runs) > 6)


def _word(token: str) -> str:
    return token.lower() if len(token) <= 16 and not _DIGITS.search(token) else "#" + shape(token)[:3]


def file_features(text: str) -> list[str]:
    n = len(text) + 1
    signs = min(3, int(400 * (text.count("=") + text.count(":") + text.count("{")) / n))
    return [f"file:signs{signs}", f"file:long{int(math.log10(n))}"]


def features(tokens: list[str], i: int, file: list[str]) -> list[str]:
    t = tokens[i]
    n = len(t)
    bits = bits_of(t)
    digits = sum(map(str.isdigit, t)) / n
    before = [_word(tokens[j]) if j >= 0 else "^" for j in (i - 1, i - 2, i - 3)]
    out = [
        "bias", "shape:" + shape(t)[:4], f"runs{min(6, len(shape(t)))}", f"len{min(9, n.bit_length() if n < 256 else 9)}", f"bits{int(2 * bits)}", f"digits{int(5 * digits)}",
        "p1:" + before[0], "p2:" + before[1], "p3:" + before[2], "n1:" + (_word(tokens[i + 1]) if i + 1 < len(tokens) else "$"), *file,
    ]
    if any(_KEY.search(tokens[j]) for j in range(max(0, i - 4), i)):
        out += ["key", "key" + ("=" if {"=", ":"} & set(tokens[max(0, i - 3) : i]) else "")]
    if not set(t) - set("0123456789abcdef"):
        out.append("hex")
    if n >= 20 and bits > 3.5:
        out.append("dense")
    return out


def free(tokens: list[str]) -> list[bool]:
    """Which tokens may be part of a secret."""
    return [len(t) >= CANDIDATE and (_strong(t) or _keyed(tokens[max(0, i - 4) : i])) for i, t in enumerate(tokens)]


class Field:
    """Weights of a linear-chain conditional random field over three tags."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, step: np.ndarray):
        self.names, self.emit, self.step = names, emit, step

    def scores(self, tokens: list[str], file: list[str], may: list[bool]) -> np.ndarray:
        out = np.zeros((len(tokens), 3))
        for i, m in enumerate(may):
            if m:
                known = [self.names[f] for f in features(tokens, i, file) if f in self.names]
                out[i] = self.emit[known].sum(0)
            else:
                out[i, 1:] = -1e9
        return out

    def tags(self, tokens: list[str], file: list[str]) -> list[int]:
        """The best tag sequence, by Viterbi."""
        may = free(tokens)
        if not any(may):
            return [_O] * len(tokens)
        e = self.scores(tokens, file, may)
        best, back = e[0] + _START, []
        for row in e[1:]:
            paths = best[:, None] + self.step
            back.append(paths.argmax(0))
            best = paths.max(0) + row
        out = [int(best.argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]

    def spans(self, text: str) -> list[tuple[int, int]]:
        out = []
        file = None
        for lo, hi in windows(text):
            file = file or file_features(text)
            found = [(m.start(), m.end()) for m in _TOKEN.finditer(text, lo, hi)]
            tags = self.tags([text[a:b] for a, b in found], file)
            for (a, b), tag in zip(found, tags, strict=True):
                if tag == _I and out:
                    out[-1] = (out[-1][0], b)
                elif tag:
                    out.append((a, b))
        return out


#: No text starts inside a secret, and nothing is inside behind what is outside.
_START = np.array([0.0, 0.0, -1e9])
_BARRED = np.array([[0.0, 0.0, -1e9], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]])


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


def train(sequences: list[tuple[list[str], list[str], list[int]]], rounds: int = 60, rate: float = 0.3, decay: float = 1e-3) -> Field | None:
    """Maximise the regularised conditional likelihood of (tokens, file features, tags) by forward-backward and Adam."""
    seqs = [s for s in sequences if any(free(s[0]))]
    if not seqs or not any(any(s[2]) for s in seqs):
        return None
    names: dict[str, int] = {}
    n, t = len(seqs), max(len(s[0]) for s in seqs)
    rows, cols, may, gold, real = [], [], np.zeros((n, t), bool), np.zeros((n, t), int), np.zeros((n, t), bool)
    for k, (tokens, file, tags) in enumerate(seqs):
        m = len(tokens)
        may[k, :m], gold[k, :m], real[k, :m] = free(tokens), tags, True
        for i in np.flatnonzero(may[k]):
            for f in features(tokens, int(i), file):
                rows.append(k * t + int(i))
                cols.append(names.setdefault(f, len(names)))
    gold[~may] = _O
    rows, cols = np.array(rows), np.array(cols)
    shut = np.where(may[..., None], 0.0, np.array([0.0, -1e9, -1e9]))
    emit, step = np.zeros((len(names), 3)), np.zeros((3, 3))
    hot = np.eye(3)[gold] * real[..., None]
    pairs = np.einsum("nti,ntj->ij", hot[:, :-1], hot[:, 1:])
    state = [(np.zeros_like(w), np.zeros_like(w)) for w in (emit, step)]
    for r in range(1, rounds + 1):
        e = np.zeros((n * t, 3))
        np.add.at(e, rows, emit[cols])
        e = e.reshape(n, t, 3) + shut
        move = step + _BARRED
        ahead, behind = np.zeros((n, t, 3)), np.zeros((n, t, 3))
        ahead[:, 0] = e[:, 0] + _START
        for i in range(1, t):
            ahead[:, i] = np.where(real[:, i, None], e[:, i] + _logsum(ahead[:, i - 1, :, None] + move, 1), ahead[:, i - 1])
        for i in range(t - 2, -1, -1):
            behind[:, i] = np.where(real[:, i + 1, None], _logsum(move + (e[:, i + 1] + behind[:, i + 1])[:, None, :], 2), behind[:, i + 1])
        total = _logsum(ahead[:, -1], 1)
        p = np.exp(ahead + behind - total[:, None, None]) * real[..., None]
        q = np.exp(ahead[:, :-1, :, None] + move + (e[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]) * real[:, 1:, None, None]
        diff = ((hot - p) * may[..., None]).reshape(n * t, 3)
        g_emit = np.zeros_like(emit)
        np.add.at(g_emit, cols, diff[rows])
        grads = (g_emit / n - decay * emit, (pairs - q.sum((0, 1))) / n - decay * step)
        for w, g, (m1, m2) in zip((emit, step), grads, state, strict=True):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            w += rate * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.99**r)) + 1e-8)
    return Field(names, emit, step + _BARRED)


def _labelled(text: str) -> Iterator[tuple[list[str], list[str], list[int]]]:
    """Windows of a text, in stretches, with the tags that the base patterns give their tokens."""
    base = base_spans(text)
    file = file_features(text)
    for lo, hi in windows(text):
        found = list(_TOKEN.finditer(text, lo, hi))
        tags, last, meets = [], None, _meeting([(m.start(), m.end()) for m in found], base)
        for m, own in zip(found, meets, strict=True):
            value = own is not None and len(m[0]) >= CANDIDATE and (own[2] != 0 or m.end() >= own[1] - 1)
            tags.append(_O if not value else _I if own == last else _B)
            last = own if value else None
        tokens = [m[0] for m in found]
        at = 0
        while at < len(tokens):
            end = min(len(tokens), at + STRETCH)
            while at + 1 < end < len(tokens) and tags[end] == _I:  # no secret is cut
                end -= 1
            yield tokens[at:end], file, tags[at:end]
            at = end


def _meeting(own: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int] | None]:
    """For each of the stretches in order the first of the spans in order that it meets."""
    out, j = [], 0
    ends: list[int] = []  # the farthest end of the spans so far
    for s in spans:
        ends.append(max(s[1], ends[-1]) if ends else s[1])
    for start, end in own:
        while j < len(spans) and ends[j] <= start:
            j += 1
        k = j
        while k < len(spans) and spans[k][0] < end and spans[k][1] <= start:
            k += 1
        out.append(spans[k] if k < len(spans) and spans[k][0] < end else None)
    return out


def fit(docs: DataFrame) -> Field | None:
    """Learn the field from a bounded sample of documents that have anything to tag."""
    some = docs.where("text rlike '[0-9]{5}' or contains(text, '=')").where("doc_id is not null")
    picked = some.select("doc_id").distinct().orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(SAMPLE)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [w for text in texts_of(batch) for w in _labelled(text)]
            yield pa.record_batch([pa.array([r[i] for r in rows], pa.list_(kind)) for i, kind in enumerate((pa.string(), pa.string(), pa.int32()))], ["tokens", "file", "tags"])

    got = map_arrow(some.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text"), run, "tokens array<string>, file array<string>, tags array<int>")
    got = got.withColumn("h", F.xxhash64("tokens", "file", "tags")).orderBy("h", "tokens", "tags").limit(WINDOWS).collect()
    return train(sorted((list(r["tokens"]), list(r["file"]), list(r["tags"])) for r in got))


def all_spans(text: str, field: Field | None) -> list[tuple[int, int, int]]:
    """Base spans and those that the field adds, by start and kind."""
    base = base_spans(text)
    if field is None:
        return base
    found = field.spans(text)
    more = [(a, b, 3) for (a, b), met in zip(found, _meeting(found, base), strict=True) if met is None]
    return sorted(base + more, key=lambda s: (s[0], s[2]))


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, field: Field | None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [all_spans(t, shared.value) for t in texts_of(batch)]
            n = [[sum(s[2] == k for s in spans) for spans in found] for k in range(4)]
            base = [hashlib.sha256(spelled([s for s in spans if s[2] < 3]).encode()).hexdigest() for spans in found]
            yield pa.record_batch(
                [column(batch, "doc_id"), *(pa.array(c, pa.int64()) for c in n[:3]), pa.array(base, pa.string()), pa.array([spelled(s) for s in found], pa.string()), pa.array(n[3], pa.int64())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long")


def redact(docs: DataFrame, field: Field | None, mark: str = "[secret]") -> DataFrame:
    """The documents with every span replaced by ``mark``; n_chars follows where there is one. Null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        at, out = 0, []
        for a, b, _ in all_spans(text, shared.value):
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index("text")
            yield batch.set_column(i, batch.schema.field(i), pa.array([clean(t) for t in batch.column(i).to_pylist()], batch.schema.field(i).type))

    out = map_arrow(docs, run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, fit(docs))
