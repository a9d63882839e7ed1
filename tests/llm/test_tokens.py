"""Operators 1, 3 and 8 against the tokenizer libraries."""

import base64
import hashlib
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from latticelake.llm import bpe, idstore, tokencount
from latticelake.session import scratch_path


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def le(ids):
    return np.array(ids, "<u4").tobytes()


def check_digests(df, tik):
    texts = [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]
    want = sorted(repr((d, len(tik(t)), hashlib.sha256(le(tik(t))).hexdigest(), hashlib.sha256(t.encode()).hexdigest())) for d, t in texts)
    assert sorted(repr(tuple(r)) for r in bpe.digests(df).collect()) == want


def test_bpe_matches_tiktoken(docs, odd, none, tik):
    check_digests(docs, tik)
    check_digests(odd, tik)
    assert bpe.digests(none).count() == 0


def test_bpe_fuzz(tik):
    enc = bpe.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("aab  \n\t'sl tT19é%%!　漢\x1c\x85") for _ in range(rnd.randrange(60))) for _ in range(3000)]
    for t, ids in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tik(t)
        assert enc.decode(ids) == t.encode()


def test_piece_tables_over_many_blocks(docs, odd, tik):
    """Tables that fill and are trimmed or start afresh, block after block, give the ids of whole texts."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rnd = random.Random(5)
    alphabet = ["ab", "a", "Z", ".", ",", "'s", " ", " ", "\n", "\t", "1", "é", "!?", "<|endoftext|>", "漢", "\x1c", "\u3000", "\r\n"]
    texts = [r["text"] or "" for df in (docs, odd) for r in df.collect()] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(50))) for _ in range(2000)]
    for limit in (1, 60, 2000):
        one, three = bpe.Encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), idstore.Encoder(P.path("byte_bpe_50k.json"))
        one.limit = three.limit = limit
        for lo in range(0, len(texts), 37):
            own = texts[lo : lo + 37]
            assert [np.frombuffer(ids, "<u4").tolist() for ids in one.encode(own)] == [tik(t) for t in own]
            flat, starts = three.streams(own)
            assert [flat[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)] == [[*library.encode(t, add_special_tokens=False).ids, 0] for t in own]
        assert len(one.table) < limit + 5_000


def test_merge_replay_waits_for_lower_ranks():
    """A merge may make a pair of lower rank, which then goes first in its word, as one word at a time would have it."""
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"ab": 310, b"cd": 290, b"abcd": 280, b"aab": 305}
    replay = bpe.MergeReplay(ranks)

    def alone(word):
        parts = [bytes([b]) for b in word]
        while True:
            pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
            if not pairs:
                return [ranks[p] for p in parts]
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rnd = random.Random(1)
    words = [bytes(rnd.choice(b"abcd") for _ in range(rnd.randrange(1, 12))) for _ in range(2000)]
    ids, start, size = replay.encode(words)
    assert [ids[a : a + n].tolist() for a, n in zip(start, size, strict=True)] == [alone(w) for w in words]


def test_encode_decode_round_trip(odd):
    encoded = bpe.encode(odd)
    back = sorted(repr((r["doc_id"], bytes(r["decoded"]))) for r in bpe.decode(encoded).collect())
    assert back == sorted(repr((r["doc_id"], (r["text"] or "").encode())) for r in odd.collect())


def expected_store(df, end=0):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, t.encode(r["text"] or "", add_special_tokens=False).ids + [end]) for r in df.collect()), key=lambda x: x[:2])
    out, start = [], 0
    for has, d, ids in rows:
        out.append((d if has else None, start, len(ids), zlib.crc32(le(ids))))
        start += len(ids)
    return out


def test_store_round_trip(spark, docs, odd, none):
    for df in (docs, odd):
        path = scratch_path(spark, "test-store")
        idstore.write_store(df, path)
        got = [tuple(r) for r in idstore.read_store(spark, path).collect()]
        assert sorted(got, key=lambda r: r[1]) == expected_store(df)
        chunks = spark.read.parquet(f"{path}/chunks")
        assert chunks.count() == chunks.select("digest").distinct().count()
    path = scratch_path(spark, "test-store")
    idstore.write_store(none, path)
    assert idstore.read_store(spark, path).count() == 0


def files(spark, path):
    """Parquet files of a local store table that hold rows."""
    found = sorted(Path(path.removeprefix("file://")).glob("*.parquet"))
    return [(f, pq.read_table(f)) for f in found if pq.read_metadata(f).num_rows]


def test_store_finds_damage(spark, docs):
    path = scratch_path(spark, "test-store")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several parts
    idstore.write_store(docs, path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert idstore.read_store(spark, path).count() == docs.count()

    def damaged(name, change, message, pick=0):
        (f, t) = files(spark, f"{path}/{name}")[pick]
        raw, crc = f.read_bytes(), f.with_name(f".{f.name}.crc")
        crc.unlink(missing_ok=True)
        new = change(t)
        f.unlink() if new is None else pq.write_table(new, f)
        with pytest.raises(Exception, match=message):
            idstore.read_store(spark, path).collect()
        f.write_bytes(raw)

    def bad_payload(t):
        i = t.column_names.index("payload")
        return t.set_column(i, "payload", pa.array([p[2:] + b"\1\2" for p in t["payload"].to_pylist()], pa.binary()))

    def shifted(t):
        i = t.column_names.index("start")
        return t.set_column(i, t.field(i), pc.add(t["start"], 1))

    damaged("chunks", bad_payload, "damaged")
    damaged("chunks", lambda t: t.slice(1), "lost")
    damaged("chunks", lambda t: None, "lost", pick=-1)
    damaged("recipes", lambda t: t.slice(0, t.num_rows - 1), "not what the manifest says")
    damaged("recipes", lambda t: t.slice(1), "starts at")
    damaged("recipes", lambda t: None, "not what the manifest says", pick=1)
    damaged("manifest", lambda t: t.slice(1), "manifest of the id store is damaged")
    damaged("manifest", shifted, "not where")
    assert idstore.read_store(spark, path).count() == docs.count()


def test_store_with_hot_chunks_and_wide_ids(spark, monkeypatch, tmp_path):
    """A passage that all documents share is joined by broadcast; the store knows the width of its ids."""
    from tokenizers import Tokenizer, pre_tokenizers
    from tokenizers.models import BPE

    passage = "shared passage of words that every single document holds " * 40
    df = spark.createDataFrame([(i, f"own words {i} {i * 7919} " * 30 + passage) for i in range(60)], "doc_id long, text string")
    path = scratch_path(spark, "test-store")
    idstore.write_store(df, path)
    want = expected_store(df)
    assert sorted((tuple(r) for r in idstore.read_store(spark, path).collect()), key=lambda r: r[1]) == want
    monkeypatch.setattr(idstore, "HOT", 20)
    got = idstore.read_store(spark, path)
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[1]) == want
    letters = sorted(pre_tokenizers.ByteLevel.alphabet())
    wide = Tokenizer(BPE(vocab={c: i for i, c in enumerate(letters)} | {f"filler{i}": 256 + i for i in range(70_000)}, merges=[]))
    wide.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    wide.save(str(tmp_path / "wide.json"))
    path = scratch_path(spark, "test-store")
    idstore.write_store(df, path, str(tmp_path / "wide.json"))
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in idstore.read_store(spark, path, ids=True).collect()}
    assert got == {r["doc_id"]: [*wide.encode(r["text"]).ids, 0] for r in df.collect()}


def test_store_keeps_the_order_of_string_ids(spark):
    df = spark.createDataFrame([(f"d{i % 7}", f"text {i}") for i in range(20)] + [(None, "none")], "doc_id string, text string")
    path = scratch_path(spark, "test-store")
    idstore.write_store(df, path)
    got = sorted(idstore.read_store(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, *sorted(f"d{i % 7}" for i in range(20))]
    assert got[-1]["start"] + got[-1]["n_tokens"] == sum(r["n_tokens"] for r in got)


def test_equal_passages_share_chunks():
    ids = np.random.default_rng(1).integers(0, 50_000, 20_000).astype("<u2")
    one, two = ids, np.concatenate([ids[:777] + 1, ids])
    parts = [idstore.chunk(x.tobytes(), 2, idstore.cuts(x).tolist()) for x in (one, two)]
    assert all(b"".join(p) == x.tobytes() for p, x in zip(parts, (one, two), strict=True))
    assert len(set(parts[0]) & set(parts[1])) > 0.8 * len(parts[0])


def test_tree_counts_as_encoding_anew(tik):
    counts = tokencount.counter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rnd = random.Random(2)
    for _ in range(1500):
        t = "".join(rnd.choice("ab  \n 's1é%") for _ in range(rnd.randrange(120)))
        tree = tokencount.TokenTree(t, counts, leaf=2)
        for _ in range(4):
            a = rnd.randrange(len(t) + 3)
            b, new = a + rnd.randrange(30), "".join(rnd.choice("ab  \n 's1é%") for _ in range(rnd.randrange(6)))
            tree.edit(a, b, new)
            a, b = min(a, len(t)), min(b, len(t))
            t = t[:a] + new + t[b:]
            assert (tree.text(), tree.total, tree.length) == (t, len(tik(t)), len(t))


def test_large_inserts_are_cut_into_leaves(tik):
    counts = tokencount.counter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    text = "a few words to begin with " * 20
    tree = tokencount.TokenTree(text, counts)
    new = "inserted words, many of them; " * 3_000
    tree.edit(100, 120, new)
    text = text[:100] + new + text[120:]
    assert max(map(len, tree.leaves)) < 400 and tree.total == len(tik(text))
    before = tree.reencoded
    for at in (50_000, 70_003, 12, len(text) - 3):
        tree.edit(at, at + 5, "edit")
        text = text[:at] + "edit" + text[at + 5 :]
        assert (tree.text(), tree.total) == (text, len(tik(text)))
    assert tree.reencoded - before <= 12
    tree.edit(0, len(text), "")
    assert (tree.total, tree.text(), tree.kept()) == (0, "", [])
    tree.edit(0, 0, "anew")
    assert (tree.total, tree.text()) == (len(tik("anew")), "anew")


def test_kept_trees(spark, docs, odd, none, tik):
    for df in (docs, odd):
        path = scratch_path(spark, "trees")
        tokencount.build_trees(df).write.parquet(path)
        trees = spark.read.parquet(path)
        edits = tokencount.sample_edits(df).groupBy("doc_id").agg(F.first("edits").alias("edits"))
        got = tokencount.edit_trees(trees.join(edits, trees["doc_id"].eqNullSafe(edits["doc_id"])).select(trees["doc_id"], "leaves", "edits")).collect()
        want = Counter((r["doc_id"], r["n_tokens_edited"], r["edited_sha256"]) for r in tokencount.count_edits(tokencount.sample_edits(df)).collect())
        assert Counter((r["doc_id"], r["n_tokens"], hashlib.sha256("".join(x["text"] for x in r["leaves"]).encode()).hexdigest()) for r in got) == want
    assert tokencount.build_trees(none).count() == 0


def test_edit_counts(docs, odd, none, tik):
    for df in (docs, odd):
        for r in tokencount.count_edits(tokencount.sample_edits(df)).join(df.select("doc_id", "text").distinct(), "doc_id").collect():
            t = r["text"] or ""
            n = len(t)
            for a, b, new in ((n // 3, n // 3, " (as amended) "), (n // 2, n // 2 + 20, ""), (n - 9, n - 2, "revised 2nd")):
                a = max(0, min(a, len(t)))
                b = max(a, min(b, len(t)))
                t = t[:a] + new + t[b:]
            assert (r["n_tokens"], r["n_tokens_edited"], r["n_chars_edited"]) == (len(tik(r["text"] or "")), len(tik(t)), len(t))
            assert r["edited_sha256"] == hashlib.sha256(t.encode()).hexdigest()
            assert r["n_reencoded"] <= 9
    assert tokencount.count_edits(tokencount.sample_edits(none)).count() == 0
