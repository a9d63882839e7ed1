"""Operator 8 - token counts that follow edits.

A document is kept as a segment tree: leaves hold some pre-token pieces each (a piece
starts at a space before a non-space, where the tokenizer pattern always cuts), inner
nodes hold sums of characters and tokens. An edit finds its leaves by character sums,
re-encodes only the leaves it touches - plus the leaf before or behind where a cut is no
longer valid - and updates the sums above them. The total is always the count that
encoding the whole edited text anew would give.

Defined results: null and empty texts have one empty leaf and no tokens; a null list of
edits is no edit; edits apply one after another, their offsets in code points of the text
as it then is, cut to its length; a null replacement deletes; repeated rows are counted
alike; columns other than doc_id, text and edits are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticelake.llm.common import WHITE, Memo, column, held, map_arrow, pieces, table, texts_of

#: Pieces of a leaf when a tree is built.
LEAF = 16
CACHE = 400_000
_BEGINS = re.compile(f" [^{WHITE}]").match


def counter(path: str, pattern: str) -> tuple[Memo, Memo]:
    """Token counts of first pieces, and of pieces that had a space before them."""
    return held(("tokencount", path, pattern), lambda: _counter(path, pattern))


def _counter(path: str, pattern: str) -> tuple[Memo, Memo]:
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return Memo(lambda p: len(encode(p)), CACHE // 8), Memo(lambda p: len(encode(" " + p)), CACHE)


class TokenTree:
    """A segment tree over the pieces of one text, with sums of characters and tokens."""

    def __init__(self, text: str, counts: tuple[Memo, Memo], leaf: int = LEAF):
        self.heads, self.rest = counts
        self.leaf, self.reencoded = leaf, 0
        self._build(self._cut(text))

    @classmethod
    def of_leaves(cls, leaves: list[tuple[str, int]], counts: tuple[Memo, Memo], leaf: int = LEAF) -> TokenTree:
        """The tree of (text, tokens) of kept leaves; nothing is encoded."""
        tree = cls.__new__(cls)
        tree.heads, tree.rest = counts
        tree.leaf, tree.reencoded = leaf, 0
        tree._build(leaves or [("", 0)])
        return tree

    def _cut(self, text: str) -> list[tuple[str, int]]:
        """Leaves of ``leaf`` pieces each, with their tokens."""
        cut = pieces(text)
        each = [self.heads[cut[0]], *map(self.rest.__getitem__, cut[1:])]
        return [((" " if i else "") + " ".join(cut[i : i + self.leaf]), sum(each[i : i + self.leaf])) for i in range(0, len(cut), self.leaf)]

    def _build(self, leaves: list[tuple[str, int]]) -> None:
        """The sums over these leaves."""
        n = len(leaves)
        self.size = 1 << (n - 1).bit_length()
        pad = self.size - n
        self.leaves = [text for text, _ in leaves] + [""] * pad
        self.tokens = [0] * self.size + [tokens for _, tokens in leaves] + [0] * pad
        self.chars = [0] * self.size + [len(text) for text, _ in leaves] + [0] * pad
        for i in range(self.size - 1, 0, -1):
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def kept(self) -> list[tuple[str, int]]:
        """(text, tokens) of the leaves that hold anything, to be stored."""
        return [(text, self.tokens[self.size + i]) for i, text in enumerate(self.leaves) if text]

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character ``at`` (the last one for the end) and the offset in it."""
        i = 1
        while i < self.size:
            i *= 2
            if at >= self.chars[i] and self.chars[i + 1]:
                at -= self.chars[i]
                i += 1
        return i - self.size, at

    def _beside(self, leaf: int, side: int) -> int | None:
        """The next leaf with text before (side 0) or behind (side 1), by the sums."""
        i = leaf + self.size
        while i > 1 and (i % 2 == side or not self.chars[i ^ 1]):
            i //= 2
        if i <= 1:
            return None
        i ^= 1
        while i < self.size:
            i = 2 * i + (1 - side)
            if not self.chars[i]:
                i ^= 1
        return i - self.size

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        i = leaf + self.size
        self.chars[i], self.tokens[i] = len(text), tokens
        while i > 1:
            i //= 2
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace the characters start to stop by ``new``."""
        start = max(0, min(start, self.length))
        stop = max(start, min(stop, self.length))
        lo, at = self._leaf(start)
        hi, end = self._leaf(max(start, stop - 1))
        end += stop > start
        joined = self.leaves[lo][:at] + new + self.leaves[hi][end:]
        # boundary context: the leaf behind joins where it no longer starts at a cut, this one joins the leaf before likewise
        behind = self._beside(hi, 1)
        if behind is not None and not _BEGINS(self.leaves[behind]):
            joined += self.leaves[behind]
            hi = behind
        before = self._beside(lo, 0)
        if before is not None and joined and not _BEGINS(joined):
            lo = before
            joined = self.leaves[lo] + joined
        made = self._made(joined)
        self.reencoded += len(made)
        if len(made) <= hi - lo + 1:
            made += [("", 0)] * (hi - lo + 1 - len(made))
            for i, (text, tokens) in enumerate(made, lo):
                if text or self.leaves[i]:
                    self._set(i, text, tokens)
        else:  # more leaves than there were: only sums are made anew
            self._build([(t, self.tokens[self.size + i]) for i, t in enumerate(self.leaves[:lo]) if t] + made + [(t, self.tokens[self.size + i]) for i, t in enumerate(self.leaves[hi + 1 :], hi + 1) if t])

    def _made(self, text: str) -> list[tuple[str, int]]:
        """The leaves of a changed stretch, none of more than twice ``leaf`` pieces."""
        if not text:
            return []
        cut = pieces(text)
        if len(cut) > 2 * self.leaf:
            return [x for x in self._cut(text) if x[0]]
        # a stretch that begins at a cut has an empty head
        return [(text, self.heads[cut[0]] + sum(map(self.rest.__getitem__, cut[1:])))]


EDITS = "array<struct<start:bigint,stop:bigint,new:string>>"


def count_edits(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_tokens_edited, n_chars_edited, edited_sha256, n_leaves, n_reencoded) for docs with a column ``edits``."""
    import public_tokenizers

    path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path, pattern)
        for batch in batches:
            out = []
            for text, edits in zip(texts_of(batch), column(batch, "edits").to_pylist(), strict=True):
                tree = TokenTree(text, counts)
                before, leaves = tree.total, sum(map(bool, tree.leaves))
                for e in edits or ():
                    if e:
                        tree.edit(e["start"] or 0, e["stop"] or 0, e["new"] or "")
                out.append((before, tree.total, tree.length, hashlib.sha256(tree.text().encode()).hexdigest(), leaves, tree.reencoded))
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2
            yield pa.record_batch(
                [column(batch, "doc_id"), *(pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds))],
                ["doc_id", "n_tokens", "n_tokens_edited", "n_chars_edited", "edited_sha256", "n_leaves", "n_reencoded"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, n_tokens_edited long, n_chars_edited long, edited_sha256 string, n_leaves long, n_reencoded long"
    return map_arrow(docs.select("doc_id", "text", F.col("edits").cast(EDITS).alias("edits")), run, schema)


LEAVES = "array<struct<text:string,n_tokens:bigint>>"


def build_trees(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, leaves): the tree of every document, to be kept as a table."""
    empty = docs.select("doc_id", "text", F.lit(None).cast(LEAVES).alias("leaves"), F.lit(None).cast(EDITS).alias("edits"))
    return _edited(empty, path, pattern)


def edit_trees(trees: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, leaves) of kept trees after their column ``edits``; only what the edits touch is encoded."""
    return _edited(trees.select("doc_id", F.lit(None).cast("string").alias("text"), "leaves", F.col("edits").cast(EDITS).alias("edits")), path, pattern)


def _edited(rows: DataFrame, path: str | None, pattern: str | None) -> DataFrame:
    import public_tokenizers

    path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path, pattern)
        kind = pa.list_(pa.struct([("text", pa.string()), ("n_tokens", pa.int64())]))
        for batch in batches:
            trees = []
            for text, leaves, edits in zip(texts_of(batch), column(batch, "leaves").to_pylist(), column(batch, "edits").to_pylist(), strict=True):
                tree = TokenTree(text, counts) if leaves is None else TokenTree.of_leaves([(x["text"], x["n_tokens"]) for x in leaves], counts)
                for e in edits or ():
                    if e:
                        tree.edit(e["start"] or 0, e["stop"] or 0, e["new"] or "")
                trees.append(tree)
            kept = [[{"text": text, "n_tokens": n} for text, n in t.kept()] for t in trees]
            yield pa.record_batch([column(batch, "doc_id"), pa.array([t.total for t in trees], pa.int64()), pa.array(kept, kind)], ["doc_id", "n_tokens", "leaves"])

    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, leaves {LEAVES}")


def sample_edits(docs: DataFrame) -> DataFrame:
    """Every document with three edits: a phrase put in at a third, 20 code points taken out at the half, a word exchanged near the end."""
    n = F.length(F.coalesce("text", F.lit("")))
    step = lambda start, stop, new: F.struct(start.cast("bigint").alias("start"), stop.cast("bigint").alias("stop"), F.lit(new).alias("new"))
    third, half = F.floor(n / 3), F.floor(n / 2)
    return docs.select("doc_id", "text", F.array(step(third, third, " (as amended) "), step(half, half + 20, ""), step(n - 9, n - 2, "revised 2nd")).alias("edits"))


def op8_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_edits(sample_edits(table(spark, sf_dir, "documents")))
