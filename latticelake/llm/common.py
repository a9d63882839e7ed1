"""What the operators share: table access, block iteration and exact piece splitting."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticelake.session import ship

#: White space as the tokenizer libraries see it (the Unicode White_Space property).
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters of text that one block of documents holds; one longer document is a block alone.
BLOCK_CHARS = 4_000_000
#: Rows and bytes of an Arrow batch, so that a batch of very long documents stays small.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20

_ODD = re.compile(f" (?:[{WHITE}]|\\Z)")
_CUT = re.compile(f" (?=[^{WHITE}])")
#: White space before white space or the end, as RE2 spells it.
_RE2 = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_DOUBLE = rf"[{_RE2}](?:[{_RE2}]|\z)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, with a null text read as the empty one by callers."""
    return docs.select(*(F.col(c) for c in ("doc_id", "text", *columns)))


def pieces(text: str) -> list[str]:
    """Cut a text before every space that a non-space follows; the space itself is dropped.

    The tokenizer pattern starts a new match at each such space, so that the pieces
    (all but the first with their space put back) split independently of each other.
    """
    return _CUT.split(text) if _ODD.search(text) else text.split(" ")


def blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about BLOCK_CHARS characters each."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK_CHARS:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


class Memo(dict):
    """A dict that computes what is missing and starts afresh beyond ``limit`` entries.

    Words repeat within a task, so that a bounded table answers nearly all look-ups;
    the bound keeps a Python worker's memory independent of the vocabulary.
    """

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


_HELD: dict = {}


def held(key: object, make: Callable):
    """What ``make`` gives, kept in this Python worker until another key is asked for.

    Workers outlive tasks and stages; one model or table at a time keeps their memory
    bounded however many operators run one after another.
    """
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def _spread(pool: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``pool`` that begin ``at``, one behind the other, and where each ends; beyond the pool its last entry stands."""
    ends = np.cumsum(size)
    if not len(ends) or not len(pool):
        return pool[:0], ends
    return pool.take(np.repeat(at - (ends - size), size) + np.arange(ends[-1]), mode="clip"), ends


class _Table:
    """Numbers of pieces by the 128-bit hash of their text, in sorted arrays that are searched for many pieces at once.

    Texts whose hashes share the first half are told apart by the second; such a piece
    is at worst numbered again.
    """

    def __init__(self):
        self.first, self.second, self.number = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
        #: The number that the next new piece gets; 0 is none's.
        self.met = 1

    def __len__(self) -> int:
        return len(self.first)

    def numbers(self, pieces: list[str], seed: int) -> tuple[np.ndarray, np.ndarray]:
        """(the number of each of the pieces, all different; places of those that are new)."""
        n = len(pieces)
        key = np.frombuffer(b"".join([xxhash.xxh3_128_digest(p, seed) for p in pieces]), "<u8").reshape(n, 2)
        order = np.argsort(key[:, 0])
        one, two = key[order, 0], key[order, 1]
        at = np.searchsorted(self.first, one)
        found = np.full(n, -1, np.int64)
        if len(self.first):
            near = np.minimum(at, len(self.first) - 1)
            hit = (self.first[near] == one) & (self.second[near] == two)
            found[order[hit]] = self.number[near[hit]]
        new = np.flatnonzero(found < 0)
        found[new] = self.met + np.arange(len(new))
        self.met += len(new)
        late = found[order] >= self.met - len(new)
        self.first, self.second = np.insert(self.first, at[late], one[late]), np.insert(self.second, at[late], two[late])
        self.number = np.insert(self.number, at[late], found[order[late]])
        return found, new

    def spare(self) -> int:
        """A number that belongs to no piece."""
        self.met += 1
        return self.met - 1

    def keep(self, numbers: np.ndarray) -> np.ndarray:
        """Forget all other pieces; the numbers that remain, in the order that numbers them anew from 1."""
        own = np.isin(self.number, numbers)
        self.first, self.second, old = self.first[own], self.second[own], self.number[own]
        self.number = np.arange(1, len(old) + 1)
        self.met = len(old) + 1
        return old


class PieceStreams:
    """Id streams of blocks of texts: a piece is a number, the ids of all pieces lie in one pool.

    Texts are cut and their distinct pieces found by Arrow; a piece is split into words by the
    tokenizer pattern once, and a subclass tells the ids of the words; when the table is full,
    pieces met in one block only leave it. A piece of letters and one sign is the piece of the
    letters and the sign's ids. Streams are gathered from the pool with arrays.
    """

    def __init__(self, pattern: str, kind: str, limit: int, end: int | None = None):
        import regex

        # \s and \S by the Unicode property, whatever the regex library takes them for
        spelled = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")
        self.split = regex.compile(spelled).findall
        #: Signs that the pattern cuts off behind letters, whatever follows them, if they end a piece.
        self.signs = {c for c in ".,;:!?" if self.split(f" a{c} b") == [" a", c, " b"] and self.split(f"a{c}") == ["a", c]}
        self.kind, self.limit, self.end = kind, limit, end
        self._reset()

    def _reset(self) -> None:
        self.table = _Table()
        # entry 0 closes a stream
        self.pool = np.array([] if self.end is None else [self.end], self.kind)
        self.at, self.size = np.zeros(1, np.int64), np.array([len(self.pool)], np.int64)
        self.again = np.zeros(1, bool)

    def _trim(self) -> None:
        """Keep the pieces that were met in a later block again; of a table of such alone, nothing."""
        seen = np.flatnonzero(self.again)
        if len(seen) > self.limit // 2:
            self._reset()
            return
        old = np.concatenate([[0], self.table.keep(seen)])
        self.size = self.size[old]
        self.pool, ends = _spread(self.pool, self.at[old], self.size)
        self.at = ends - self.size
        self.again = np.zeros(len(old), bool)

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size) of words, each one match of the pattern."""
        raise NotImplementedError

    def whole(self, texts: list[str]) -> dict[int, np.ndarray]:
        """The ids of those texts that cannot be cut into pieces, by their place."""
        return {}

    def _add(self, numbers: np.ndarray, ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Pieces of these numbers have the ids from ``start`` on."""
        if len(self.at) < self.table.met:
            more = max(self.table.met, len(self.at) * 3 // 2) - len(self.at)
            self.at, self.size = np.append(self.at, np.zeros(more, np.int64)), np.append(self.size, np.zeros(more, np.int64))
            self.again = np.append(self.again, np.zeros(more, bool))
        self.at[numbers], self.size[numbers] = start + len(self.pool), size
        self.pool = np.concatenate([self.pool, ids])

    def _split(self, numbers: list[int], parts: list[str]) -> None:
        """Learn pieces, given with what stands before them, by the pattern."""
        words = [self.split(p) for p in parts]
        table: dict[str, int] = {}
        order = np.array([table.setdefault(w, len(table)) for ws in words for w in ws], np.int64)
        pool, at, size = self.word_ids(list(table))
        ids, ends = _spread(pool, at[order], size[order])
        stop = np.concatenate([[0], ends])[np.cumsum([len(ws) for ws in words])]
        start = np.concatenate([[0], stop[:-1]])
        self._add(np.array(numbers, np.int64), ids, start, stop - start)

    def _learn(self, rest: list[tuple[int, str]], heads: list[tuple[int, str]]) -> None:
        """Learn new pieces: heads as they are, others with the space or line end before them."""
        numbers, parts = [n for n, _ in heads], [p for _, p in heads]
        letters: list[tuple[int, str]] = []
        signed: dict[str, tuple[list[int], list[str]]] = {c: ([], []) for c in self.signs}
        for n, p in rest:
            if p.isalpha():
                letters.append((n, p))
            elif p[-1] in signed and p[:-1].isalpha():
                own, of = signed[p[-1]]
                own.append(n)
                of.append(p[:-1])
            else:
                numbers.append(n)
                parts.append(p if p[0] == "\n" else " " + p)
        bases = list(dict.fromkeys(p for _, of in signed.values() for p in of))
        known, new = self.table.numbers(bases, 0)
        letters += [(int(known[i]), bases[i]) for i in new.tolist()]
        if letters:  # letters alone are one match of the pattern
            self._add(np.array([n for n, _ in letters], np.int64), *self.word_ids([" " + p for _, p in letters]))
        if parts:
            self._split(numbers, parts)
        base = dict(zip(bases, known.tolist(), strict=True))
        for sign, (own, of) in signed.items():
            if own:
                ids, start, n = self.word_ids([sign])
                last = ids[int(start[0]) : int(start[0] + n[0])]
                under = np.array([base[p] for p in of], np.int64)
                size = self.size[under] + len(last)
                ids, ends = _spread(self.pool, self.at[under], size)  # with room for the sign behind each
                for j, x in enumerate(last):
                    ids[ends - len(last) + j] = x
                self._add(np.array(own, np.int64), ids, ends - size, size)

    def streams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The streams of one block, one behind the other; where each starts, and the end of all."""
        if len(self.table) > self.limit:
            self._trim()
        own = self.whole(texts)
        flat, n, heads = cut_pieces(["" if i in own else t for i, t in enumerate(texts)])
        coded = flat.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        differ = list(dict.fromkeys(heads))
        before = self.table.met
        rest, new = self.table.numbers(words, 0)
        led, fresh = self.table.numbers(differ, 1)
        self._learn([(int(rest[i]), words[i]) for i in new.tolist()], [(int(led[i]), differ[i]) for i in fresh.tolist()])
        self.again[rest[rest < before]] = self.again[led[led < before]] = True
        numbers = rest[coded.indices.to_numpy()]
        led = dict(zip(differ, led.tolist(), strict=True))
        first = [led[h] for h in heads]
        for i, ids in own.items():
            first[i] = self.table.spare()
            self._add(np.array([first[i]]), ids, np.zeros(1, np.int64), np.array([len(ids)]))
        # each text: its head, its other pieces, entry 0
        close = np.cumsum(n + 2) - 1
        open_ = close - n - 1
        at, other = np.zeros(int(n.sum()) + 2 * len(n), np.int64), np.ones(int(n.sum()) + 2 * len(n), bool)
        at[open_] = first
        other[open_] = other[close] = False
        at[other] = numbers
        out, ends = _spread(self.pool, self.at[at], self.size[at])
        return out, np.concatenate([[0], ends[close]]).astype(np.int64)


def cut_pieces(texts: list[str]) -> tuple[pa.Array, np.ndarray, list[str]]:
    """(pieces behind each text's head, how many each text has, heads), by ``pieces``.

    Where no white space meets white space, a line end starts a piece as well and stays in it:
    the pattern matches it alone. Such texts, nearly all, are cut by Arrow.
    """
    whole = pa.array(texts, pa.string())
    odd = set(np.flatnonzero(pc.match_substring_regex(whole, _DOUBLE).to_numpy(zero_copy_only=False)).tolist())
    if odd:
        whole = pa.array(["" if i in odd else t for i, t in enumerate(texts)], pa.string())
    cut = pc.split_pattern(pc.replace_substring(whole, "\n", " \n"), " ")
    at, flat = cut.offsets.to_numpy(), cut.values
    heads = flat.take(pa.array(at[:-1])).to_numpy(zero_copy_only=False).tolist()
    if not odd:
        keep = np.ones(len(flat), bool)
        keep[at[:-1]] = False
        return flat.filter(pa.array(keep)), np.diff(at) - 1, heads
    parts: list[pa.Array] = []
    n = np.diff(at) - 1
    for i, t in enumerate(texts):
        if i in odd:
            heads[i], *more = pieces(t)
            n[i] = len(more)
            parts.append(pa.array(more, pa.string()))
        else:
            parts.append(flat.slice(at[i] + 1, at[i + 1] - at[i] - 1))
    return pa.concat_arrays(parts), n, heads


def map_arrow(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with the package shipped and batches bounded in rows."""
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
