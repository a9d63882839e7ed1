"""Operator 6 - near-duplicate detection by order MinHash.

Each text's occurrence-labelled shingles of K words give SKETCHES sketches, each the hash
of its KEPT least shingles in the order of the text; texts that share a sketch are
candidates, and a banded alignment of their words decides: where the best in-order
alignment matches a share of SIMILARITY of the longer text's words, there is a link.
Classes are the components of the links.

1. One pass reads the texts and keeps a 128-bit key (of the words) and the sketches;
   documents of equal keys are one node from here on, however many copies there are.
2. Sketch values met by several nodes join each node to the least among them: a star,
   linear in rows. Components of these stars are candidate groups.
3. A group of up to GROUP_NODES nodes and GROUP_WORDS words is settled within one task,
   exactly: all pairs that share a sketch and are not in one class yet are aligned. Only
   nodes of groups have their text read again; what is joined for that is broadcast when
   counted to be at most BROADCAST_NODES, and joined by a shuffle otherwise.
4. A larger group is settled by distributed joins: in a few rounds each node outside the
   class of some bucket's leader is compared to one such leader; then the nodes outside the
   group's largest class are compared to all of other classes that share a sketch with
   them. No task holds such a group, and both ways give the same classes: the components of
   all links among candidates.

Result: one row for each document with its class id (the least doc_id of the class), the
documents of its class, and the class key: the MD5 of the text of the class's least row (by
doc_id, nulls last, then MD5), which tells classes apart where ids repeat.

Defined results: null and empty texts are each alone in their class (class_id is their
doc_id, class_key null); texts without words are duplicates only of the same text; rows that
repeat an id or have none are rows like others, told apart by their text; a null doc_id gets
the least id of its class, or null; columns other than doc_id and text are ignored; an empty
table gives no rows. ``keep_first`` keeps each class's least row, one where it is repeated,
all null and empty texts, and all columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from latticelake.llm.common import Memo, column, held, map_arrow, table, texts_of
from latticelake.llm.orderhash import SIMILARITY, SKETCHES, alignment, kmers, sketches, word_hash, words
from latticelake.session import discard, materialize

#: Nodes and words of a candidate group that one task settles; larger groups are settled in rounds.
GROUP_NODES, GROUP_WORDS = 20_000, 16_000_000
#: Bins that a text's words are counted in; pairs that are looked at together.
BINS, PAIRS = 1_024, 2_000_000
#: Rounds of comparisons with bucket leaders in larger groups.
ROUNDS = 2
#: Nodes (or rows to take out) that may be broadcast, some 100 bytes each.
BROADCAST_NODES = 250_000
#: Edges whose minima may all be broadcast, 16 bytes each.
BROADCAST_EDGES = 1_000_000
#: A node with more than one in so many of all edges is a hub; there are fewer hubs than that.
HUBS = 10_000
CACHE = 200_000


def node_key(h: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(h.tobytes())


def _sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, own, key, n_words, sketches); ``own`` is the MD5 of the text, the key is null where there is no text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = held("neardup", lambda: Memo(word_hash, CACHE))
        for batch in batches:
            h = [words(t, memo) for t in texts_of(batch)]
            marks = [sketches(kmers(x)) for x in h]
            yield pa.record_batch(
                [
                    column(batch, "doc_id"), column(batch, "own"), pa.array([node_key(x) if len(x) else None for x in h], pa.binary()),
                    pa.array([len(x) for x in h], pa.int64()), pa.array(marks, pa.list_(pa.int64())),
                ],
                ["doc_id", "own", "key", "n_words", "sketches"],
            )

    return map_arrow(docs.select("doc_id", "text", F.md5("text").alias("own")), run, f"doc_id {kind}, own string, key binary, n_words long, sketches array<long>")


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """(a, b, m): the edges with the least b of their a.

    Of few edges all minima are broadcast. Of many, those of hubs are: fewer than HUBS rows, as
    each has more than one in HUBS of all ``total`` edges; no other node makes a task hot.
    """
    low = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    if total <= BROADCAST_EDGES:
        return edges.join(F.broadcast(low.select("a", "m")), "a")
    hubs = low.where(F.col("n") * HUBS > total).select("a", F.col("m").alias("hub"))
    marked = edges.join(F.broadcast(hubs), "a", "left")
    rest = low.where(F.col("n") * HUBS <= total).select("a", "m")
    return marked.where("hub is not null").select("a", "b", F.col("hub").alias("m")).unionByName(marked.where("hub is null").drop("hub").join(rest, "a"))


def _counted(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The different edges, written; their number and a sum over their hashes."""
    seen = Observation()
    edges = edges.distinct().observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    edges = materialize(edges, "edges")
    return edges, (seen.get["n"], seen.get["h"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b), root the least of its component.

    Alternating large-star and small-star steps, each a join with the least neighbour,
    until the edges are the stars around the roots.
    """
    edges, now = _counted(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    before = None
    while now != before:
        before, n = now, now[0]
        large = _with_least(edges.union(edges.select("b", "a")), 2 * n).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b")
        if 2 * n > BROADCAST_EDGES:
            large, (n, _) = _counted(large)
        small = _with_least(large, n)
        after, now = _counted(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))))
        discard(edges, large)
        edges = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def _cross_pairs(met: list[np.ndarray], label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of different classes among the members of each list, some PAIRS or a member's at a time."""
    first, second, waiting = [], [], 0
    for own in met:
        of = label[own]
        for j, i in enumerate(own[:-1].tolist() if (of != of[0]).any() else ()):
            late = own[j + 1 :][of[j + 1 :] != of[j]]
            if len(late):
                first.append(np.full(len(late), i))
                second.append(late)
                waiting += len(late)
            if waiting >= PAIRS:
                yield np.concatenate(first), np.concatenate(second)
                first, second, waiting = [], [], 0
    if waiting:
        yield np.concatenate(first), np.concatenate(second)


def _settle(nodes: list[int], seqs: list[np.ndarray], similarity: float) -> list[int]:
    """For each node of one candidate group the least node of its class.

    First each sketch value's nodes are compared to one of them, which leaves most values
    with a single class; then all pairs of different classes that share a value are. Words
    counted in BINS bins bound from above what an alignment can match and spare most of them.
    """
    n = len(nodes)
    size = np.array([len(s) for s in seqs])
    bins = np.array([np.bincount((s % np.uint64(BINS)).astype(np.int64), minlength=BINS) for s in seqs], np.uint16 if size.max() < 1 << 16 else np.uint32)
    marks = np.array([sketches(kmers(s)) for s in seqs]).reshape(-1)
    order = np.argsort(marks, kind="stable")
    turns = np.flatnonzero(np.concatenate([[True], marks[order][1:] != marks[order][:-1], [True]]))
    met = [order[lo:hi] // SKETCHES for lo, hi in zip(turns, turns[1:], strict=False) if hi - lo > 1]
    label = np.arange(n)
    tested: set[int] = set()

    def compare(first: np.ndarray, second: np.ndarray) -> None:
        pairs = np.unique((np.minimum(first, second) * n + np.maximum(first, second))[label[first] != label[second]])
        x, y = pairs // n, pairs % n
        need = np.ceil(similarity * np.maximum(size[x], size[y]) - 1e-9)
        may = np.flatnonzero(np.minimum(size[x], size[y]) >= need)
        for lo in range(0, len(may), 2_000):
            at = may[lo : lo + 2_000]
            at = at[label[x[at]] != label[y[at]]]
            at = at[np.minimum(bins[x[at]], bins[y[at]]).sum(1, dtype=np.int64) >= need[at]]
            for i, k, pair in zip(x[at].tolist(), y[at].tolist(), pairs[at].tolist(), strict=True):
                if label[k] != label[i] and pair not in tested:
                    tested.add(pair)
                    if alignment(seqs[i], seqs[k], similarity) >= similarity:
                        label[label == label[k]] = label[i]

    if met:
        compare(np.concatenate([np.full(len(own) - 1, own[0]) for own in met]), np.concatenate([own[1:] for own in met]))
    for first, second in _cross_pairs(met, label):
        compare(first, second)
    least: dict[int, int] = {}
    for node, c in zip(nodes, label.tolist(), strict=True):
        least[c] = min(least.get(c, node), node)
    return [least[c] for c in label.tolist()]


def _read_again(docs: DataFrame, nodes: DataFrame, count: int) -> DataFrame:
    """(grp, node, words) of the nodes (grp, node, rep), from the text of the row ``rep``."""
    wanted = nodes.select("grp", "node", F.col("rep.doc_id").alias("rep_id"), F.col("rep.own").alias("rep_own"))
    if count <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = held("neardup", lambda: Memo(word_hash, CACHE))
        done: set[int] = set()  # rows may be repeated
        for batch in batches:
            found = [(i, n) for i, n in enumerate(column(batch, "node").to_pylist()) if not (n in done or done.add(n))]
            take = pa.array([i for i, _ in found], pa.int64())
            texts = column(batch, "text").take(take).to_pylist()
            yield pa.record_batch([column(batch, "grp").take(take), column(batch, "node").take(take), pa.array([words(t, memo).tobytes() for t in texts], pa.binary())], ["grp", "node", "words"])

    own = docs.select("doc_id", "text", F.md5("text").alias("own"))
    joined = own.join(wanted, (F.col("own") == F.col("rep_own")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))).select("grp", "node", "text")
    return map_arrow(joined, run, "grp long, node long, words binary")


def _settle_groups(found: DataFrame, similarity: float) -> DataFrame:
    """(node, root): groups are streamed in order, one in memory."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, {}

        def close() -> pa.RecordBatch:
            roots = _settle(list(rows), list(rows.values()), similarity)
            return pa.record_batch([pa.array(list(rows), pa.int64()), pa.array(roots, pa.int64())], ["node", "root"])

        for batch in batches:
            for grp, node, raw in zip(*(column(batch, c).to_pylist() for c in ("grp", "node", "words")), strict=True):
                if grp != now:
                    if rows:
                        yield close()
                    now, rows = grp, {}
                rows[node] = np.frombuffer(raw, np.uint64)
        if rows:
            yield close()

    return map_arrow(found.repartition("grp").sortWithinPartitions("grp", "node"), run, "node long, root long")


def _aligned(pairs: DataFrame, seqs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that the alignment of their words links."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [column(batch, c).to_pylist() for c in ("x", "y")]
            keep = [alignment(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity) >= similarity for x, y in zip(*cols, strict=True)]
            yield pa.record_batch([column(batch, c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    # texts of too different lengths cannot align and are not fetched
    size = seqs.select("node", F.length("words").alias("n"))
    pairs = pairs.join(size.select(F.col("node").alias("a"), F.col("n").alias("m")), "a").join(size.select(F.col("node").alias("b"), "n"), "b")
    pairs = pairs.where(F.least("n", "m") >= similarity * F.greatest("n", "m")).select("a", "b")
    both = pairs.join(seqs.select(F.col("node").alias("a"), F.col("words").alias("x")), "a").join(seqs.select(F.col("node").alias("b"), F.col("words").alias("y")), "b")
    return map_arrow(both.select("a", "b", "x", "y"), run, "a long, b long")


def _settle_in_rounds(seqs: DataFrame, group: DataFrame, members: DataFrame, similarity: float) -> DataFrame:
    """(node, root) of groups beyond one task, from (node, words), (node, grp) and (bucket, node)."""
    spark = seqs.sparkSession
    members = materialize(members, "members")
    nodes = materialize(group.select("node", "grp"), "large-nodes")
    labels = nodes.select("node", F.col("node").alias("c"))
    links = tested = spark.createDataFrame([], "a long, b long")

    def linked(pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(links, pairs tested, labels) after these pairs."""
        pairs = materialize(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        all_links = links.union(materialize(_aligned(pairs, seqs, similarity), "links"))
        root = components(all_links)
        new = nodes.join(root, "node", "left").select("node", F.coalesce("root", "node").alias("c"))
        return all_links, tested.union(pairs), materialize(new, "labels")

    pair = (F.greatest("node", "lead").alias("a"), F.least("node", "lead").alias("b"))
    for turn in range(ROUNDS):
        own = members.join(labels, "node")
        # another leader each round, the same for most buckets of a class
        order = F.xxhash64("node", F.lit(turn))
        lead = materialize(own.groupBy("bucket").agg(F.max_by(F.struct("node", "c"), F.struct(order, "node")).alias("l")).select("bucket", F.col("l.node").alias("lead"), F.col("l.c").alias("of")), "leaders")
        met = own.join(lead, "bucket").where("c <> of").groupBy("node", "lead").agg(F.count("*").alias("n"))
        best = met.groupBy("node").agg(F.max_by("lead", F.struct("n", "lead")).alias("lead"))
        links, tested, labels = linked(best.select(*pair).distinct())
        discard(lead)
    classed = materialize(nodes.join(labels, "node"), "classed")
    main = classed.groupBy("grp", "c").agg(F.count("*").alias("n")).groupBy("grp").agg(F.max_by("c", F.struct("n", "c")).alias("main"))
    strays = materialize(members.join(classed.join(main, "grp").where("c <> main").select("node", "c"), "node").select("bucket", F.col("node").alias("lead"), F.col("c").alias("of")), "strays")
    others = materialize(members.join(classed.select("node", "c"), "node"), "others")
    left = others.join(strays, "bucket").where("c <> of").select(*pair).distinct()
    links, tested, labels = linked(left)
    return labels.select("node", F.col("c").alias("root"))


def _classes(docs: DataFrame, similarity: float, group_nodes: int, group_words: int) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, own, key, ...) and the class (key, rep, class_id, class_size) of each key; ``rep`` is the class's least row."""
    sketched = materialize(_sketched(docs), "sketched")
    rep = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "own")
    nodes = sketched.where("key is not null").groupBy("key").agg(F.min(rep).alias("rep"), F.count("*").alias("n"), F.any_value("n_words").alias("n_words"), F.any_value("sketches").alias("sketches"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    each = nodes.select("node", F.explode("sketches").alias("bucket"))
    # written, so that a common bucket is a skewed join's and split
    met = materialize(each.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("bucket", "least"), "met")
    members = materialize(each.join(met, "bucket"), "buckets")
    group = components(members.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")))
    group = materialize(group.select("node", F.col("root").alias("grp")), "groups")
    sized = group.join(nodes.select("node", "rep", "n_words"), "node")
    large = sized.groupBy("grp").agg(F.count("*").alias("n"), F.sum("n_words").alias("w")).where((F.col("n") > group_nodes) | (F.col("w") > group_words)).select("grp")
    large = materialize(large, "large-groups")
    found = materialize(_read_again(docs, sized.select("grp", "node", "rep"), group.count()), "words")
    settled = _settle_groups(found.join(large, "grp", "left_anti"), similarity)
    seqs = None
    if not large.isEmpty():
        # a node may have been read in several tasks
        seqs = materialize(found.join(large, "grp", "left_semi").groupBy("node").agg(F.any_value("words").alias("words")), "large")
        own = group.join(large, "grp", "left_semi")
        settled = settled.union(_settle_in_rounds(seqs, own, members.join(own, "node", "left_semi").select("bucket", "node"), similarity))
    settled = materialize(settled.groupBy("node").agg(F.min("root").alias("root")), "settled")
    label = nodes.select("key", "node", "rep", "n").join(settled, "node", "left").select("key", "rep", "n", F.coalesce("root", "node").alias("root"))
    classes = label.groupBy("root").agg(F.min("rep").alias("rep"), F.sum("n").alias("class_size"))
    out = materialize(label.select("key", "root").join(classes, "root").select("key", "rep", F.col("rep.doc_id").alias("class_id"), "class_size"), "classes")
    discard(met, members, group, large, found, seqs, settled, nodes)
    return sketched, out


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, group_nodes: int = GROUP_NODES, group_words: int = GROUP_WORDS) -> DataFrame:
    """(doc_id, class_id, class_size, class_key) of every document."""
    rows, classes = _classes(docs, similarity, group_nodes, group_words)
    alone = F.col("key").isNull()
    return rows.select("doc_id", "key").join(classes, "key", "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), F.col("rep.own").alias("class_key"),
    )


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_first(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` of which each class keeps one: its least row, once.

    Rows that go are few beside those that stay, so their ids and texts' MD5 are taken out
    by an anti-join: broadcast when counted to be at most BROADCAST_NODES, shuffled otherwise.
    """
    rows, classes = _classes(docs, similarity, GROUP_NODES, GROUP_WORDS)
    least = F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("own") == F.col("rep.own"))
    found = materialize(rows.select("doc_id", "own", "key").join(classes.where("class_size > 1"), "key").select(F.col("doc_id").alias("__of_id"), F.col("own").alias("__of_own"), least.alias("first")), "members")
    gone = found.where("not first").select("__of_id", "__of_own").distinct()
    again = found.where("first").groupBy("__of_id", "__of_own").agg(F.count("*").alias("n")).where("n > 1").select("__of_id", "__of_own")
    same = F.col("doc_id").eqNullSafe(F.col("__of_id")) & (F.md5("text") == F.col("__of_own"))
    small = found.where("not first").count() <= BROADCAST_NODES
    kept = docs.join(F.broadcast(gone) if small else gone, same, "left_anti")
    discard(rows, classes)
    if again.isEmpty():
        return kept
    few = again.count() <= BROADCAST_NODES
    again = F.broadcast(again) if few else again
    repeated = kept.join(again, same, "left_semi").withColumn("__own", F.md5("text")).dropDuplicates(["doc_id", "__own"]).drop("__own")
    return kept.join(again, same, "left_anti").unionByName(repeated)
