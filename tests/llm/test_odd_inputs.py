"""Each operator on odd rows and on no rows: no crash, one result a row, defined values."""

import hashlib
import zlib

import numpy as np
from helpers import DATA
from pyspark.sql import functions as F

from lattica.llm import bpe_codec, chat_format, common, decontaminate, exact_dedup, line_dedup, near_dedup, quality, sharding, token_store, toxicity
from lattica.llm.common import scratch


def vocabulary():
    import public_tokenizers as P

    return P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 1), (4, 1, 1), (None, 1, 1), (6, None, None), (99, 0, 0)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


def test_token_store(spark, odd, empty):
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.json")
    for df, n in ((odd, 11), (empty, 0)):
        out = scratch(spark, "test-store")
        rows = token_store.read_store(token_store.write_store(df, out, path), out).orderBy("start").collect()
        assert len(rows) == n
        assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
        if n:
            assert [r.doc_id for r in rows][:2] == [None, None] and min(r.n_tokens for r in rows) == 1
            assert rows[2].ids.endswith(b"\0\0\0\0")


def test_exact_dedup(odd, empty):
    got = exact_dedup.mark_duplicates(odd).collect()
    assert len(got) == 11 and exact_dedup.mark_duplicates(empty).count() == 0
    same = [r for r in got if r.doc_id in (1, 4)]
    assert [(r.keep_id, r.group_size) for r in same] == [(4, 3)] * 3 and sum(r.kept for r in same) == 1
    nothing = [r for r in got if r.text_sha256.startswith("e3b0c44298fc1c14")]
    assert len(nothing) == 3 and {r.keep_id for r in nothing} == {3} and sum(r.kept for r in nothing) == 1
    kept = exact_dedup.drop_duplicates(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)
    assert exact_dedup.drop_duplicates(empty).count() == 0


def test_exact_dedup_in_slices(spark, odd, monkeypatch):
    """A filter of many slices decides as one does, for keys and for whole rows, and few rows without an equal take the shuffle."""
    monkeypatch.setattr(exact_dedup, "SLICE_BITS", exact_dedup.PIECE)
    df = spark.range(50_000).select(F.col("id").alias("doc_id"), (F.col("id") % 30_000).cast("string").alias("text"))
    got = exact_dedup.mark_duplicates(df).groupBy("group_size", "kept").count().collect()
    assert {(r.group_size, r.kept): r["count"] for r in got} == {(1, True): 10_000, (2, True): 20_000, (2, False): 20_000}
    rows = exact_dedup.drop_duplicates(df.withColumns({"again": F.lit(1), "slice": F.lit("x"), "m": F.create_map(F.lit("a"), F.col("doc_id"))}))
    assert rows.columns == ["doc_id", "text", "again", "slice", "m"] and sorted(r.doc_id for r in rows.select("doc_id").collect()) == list(range(20_000, 50_000))
    tested = exact_dedup.with_again(spark.range(50_000).select(F.xxhash64("id").alias("h")), 50_000)
    assert tested.where("again").count() < 500


def test_chat_format(spark):
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.json")
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, None, "system", "first"), (1, 2, "assistant", "b"), (None, 1, None, "x"), (2, 1, "assistant", ""), (3, 0, "assistant", "é<|im_end|><\\|im_start|>\\<|| " * 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(c) for c in ("pos", "start", "ids", "mask")})
    formatted = chat_format.format_turns(df, path)
    back = chat_format.read_turns(formatted, path).orderBy("conv_id", "pos").collect()
    assert [(r.conv_id, r.role, r.text) for r in back] == [(None, "", "x"), (1, "system", "first"), (1, "user", ""), (1, "assistant", "b"), (1, "assistant", "b"), (2, "assistant", ""), (3, "assistant", rows[-1][3])]
    assert [r.loss_text for r in back][-1] == rows[-1][3] and back[0].loss_text is None
    starts = [(r.start, r.n_tokens) for r in formatted.where("conv_id = 1").orderBy("pos").collect()]
    assert all(a[0] + a[1] == b[0] for a, b in zip(starts, starts[1:], strict=False))
    assert chat_format.format_turns(df.limit(0), path).count() == 0
    d = {r.conv_id: r for r in chat_format.digest_conversations(formatted, path).collect()}
    assert d[1].n_turns == 4 and d[1].loss_chars == 2 and d[2].loss_chars == 0


def test_line_dedup(spark, odd, empty):
    assert line_dedup.drop_shared_lines(odd).count() == 11 and line_dedup.drop_shared_lines(empty).count() == 0
    rows = [(i, f"s{i % 6}", f"own {i}\nshared\n\nrare {i % 4}") for i in range(24)] + [(100, None, "shared\nshared"), (101, "s1", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r for r in line_dedup.drop_shared_lines(df).collect()}
    assert got[3].text == "own 3\n\nrare 3" and (got[3].n_lines, got[3].n_dropped) == (4, 1)
    assert got[100].text == "" and got[100].n_dropped == 2 and got[101].text == ""


def test_line_dedup_counts_near_the_threshold_exactly(spark):
    rows = [(100 * k + i, f"s{i}", f"line {k}") for k in range(2, 40) for i in range(k)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for least in (5, 17):
        gone = {r.doc_id // 100 for r in line_dedup.drop_shared_lines(df, min_sites=least).where("n_dropped > 0").collect()}
        assert gone == set(range(least, 40))


def test_sharding(spark, odd, empty):
    got = sharding.shard_rows(odd, [1.0, 2.0, 1.0]).collect()
    assert len(got) == 11 and sharding.shard_rows(empty, [1.0] * 3).count() == 0
    assert len({r.shard for r in got if r.row.doc_id == 4}) == 1
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_sharding_splits_hot_keys(spark, monkeypatch):
    """Slots stay gapless where two keys have most rows, more than a block holds."""
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 50)
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, F.lit(7)).otherwise(F.col("id")).alias("doc_id")).repartition(5)
    got = sharding.shard_rows(df, [1.0, 1.0, 1.0]).collect()
    assert len({r.shard for r in got if r.row.doc_id is None}) == 1
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_line_dedup_beyond_the_broadcast_bound(spark, monkeypatch):
    """Joins that shuffle, with hot lines apart, give what broadcasts give; rows of one id, or of none, keep their own lines."""
    rows = [(i % 90 if i % 7 else None, f"s{i % 9}", f"own {i}\nshared\nfour {i % 30}\n" + "\n".join(f"five {k}" for k in range(i % 4))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    plain = lambda: sorted(map(str, line_dedup.drop_shared_lines(df).collect()))
    want = plain()
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(common, "HOT", 4)
    assert plain() == want and len(want) == 400


def test_joins_beyond_the_broadcast_bound(spark, odd, monkeypatch):
    """What operators give doesn't depend on whether a side is broadcast."""
    items = spark.createDataFrame([(1, "b c d"), (2, "x"), (3, "word " * 20)], "item_id long, text string")
    near = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(20 + k, " ".join(f"w{i}" for i in range(80)) + f" end{k // 2}") for k in range(6)], "doc_id long, text string"))

    def every():
        frames = decontaminate.contamination(odd, items), near_dedup.near_duplicates(near), quality.quality(odd, labels(spark)), toxicity.toxicity(odd, labels(spark))
        return [sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in f.collect()) for f in frames]

    want = every()
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert every() == want


def test_sharding_moves_little_and_weighs(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    key = F.col("doc_id").cast("string")
    moved = df.select(sharding.rendezvous(key, [1.0] * 8).alias("a"), sharding.rendezvous(key, [1.0] * 9).alias("b")).where("a != b")
    assert {r.b for r in moved.select("b").distinct().collect()} == {8} and abs(moved.count() / 20_000 - 1 / 9) < 0.01
    share = df.select(sharding.rendezvous(key, [1.0, 3.0]).alias("s")).where("s = 1").count() / 20_000
    assert abs(share - 0.75) < 0.01


def test_sharding_query(spark):
    from pyspark.sql import Row

    got = sharding.op5_sharding(spark, DATA).collect()
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    assert all(r.text_crc32 == zlib.crc32(docs[r.doc_id]) and r.size == len(docs[r.doc_id]) + 1 for r in got) and isinstance(got[0], Row)


def test_decontaminate(spark, odd, empty):
    items = spark.createDataFrame([(1, "b c d"), (2, None), (3, ""), (3, "x")], "item_id long, text string").withColumn("words", F.lit(1))
    got = {(r.doc_id, r.n_words, r.n_hit, ",".join(r.item_ids)) for r in decontaminate.contamination(odd, items).collect()}
    assert (1, 6, 3, "1") in got and (2, 0, 0, "") in got and (5, 1, 1, "3") in got and (6, 40_000, 0, "") in got
    assert decontaminate.contamination(odd, items).count() == 11
    assert decontaminate.contamination(empty, items).count() == 0
    assert decontaminate.contamination(odd, items.limit(0)).where("contaminated").count() == 0


def test_toxicity(spark, odd, empty):
    got = toxicity.toxicity(odd, labels(spark)).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.toxicity(empty, labels(spark)).count() == 0
    assert toxicity.toxicity(odd, labels(spark).limit(0)).where("predicted = 1").count() == 0


def test_near_dedup(odd, empty):
    got = {(r.doc_id, r.class_id, r.kept) for r in near_dedup.near_duplicates(odd).collect()}
    assert {(1, 1, True), (4, 1, False), (2, 2, True), (3, 2, False), (None, None, True), (6, 6, True)} <= got
    assert near_dedup.near_duplicates(odd).count() == 11 and near_dedup.near_duplicates(empty).count() == 0


def test_bpe_codec(odd, empty):
    v = vocabulary()
    got = bpe_codec.decode_documents(bpe_codec.encode_documents(odd, *v), *v).collect()
    assert sorted((str(r.doc_id), r.decoded.decode()) for r in got) == sorted((str(r.doc_id), r.text or "") for r in odd.collect())
    assert bpe_codec.decode_documents(bpe_codec.encode_documents(empty, *v), *v).count() == 0 and bpe_codec.round_trip(empty, *v).count() == 0
    digests = {(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_codec.round_trip(odd, *v).collect()}
    want = set()
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        want.add((str(r.doc_id), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.decoded).hexdigest()))
    assert digests == want


def test_quality(spark, odd, empty):
    got = quality.quality(odd, labels(spark)).collect()
    assert len(got) == 11 and all(r.accepted for r in got if r.n_bytes == 0)
    assert quality.quality(empty, labels(spark)).count() == 0
    assert quality.quality(odd, labels(spark).limit(0)).where("accepted").count() == 11
