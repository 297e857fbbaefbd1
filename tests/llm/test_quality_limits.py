"""The quality classifier's limits: quantiles of held-out text, and one verdict for each row."""

import random

import numpy as np
import plain
import zstandard
from pyspark.sql import functions as F

from lattica.llm import quality
from lattica.llm.common import ROW, with_row


def test_limit_is_the_held_out_quantile(spark):
    """A language's own quantile, and its median with the distances of all languages, weighed by its documents."""
    many = [("en", 100.0 * (1 + i / 1000), 100, True) for i in range(400)]
    few = [("fr", 200.0 + i, 100, True) for i in range(3)]
    rows = spark.createDataFrame([*many, *few, ("en", 9000.0, 100, False)], "lang string, nll double, n long, held_out boolean")
    got = {r.lang: r for r in quality.thresholds(rows).collect()}
    bits = {lang: np.sort([(x + quality.PRIOR * got[lang].mean) / (100 + quality.PRIOR) for _, x, _, _ in part]) for lang, part in (("en", many), ("fr", few))}
    apart = np.sort(np.concatenate([bits["en"] - bits["en"][199], bits["fr"] - bits["fr"][1]]))[int(np.ceil(0.99 * 403)) - 1]
    assert np.isclose(got["en"].limit, (400 * bits["en"][395] + 100 * (bits["en"][199] + apart)) / 500)
    assert np.isclose(got["fr"].limit, (3 * bits["fr"][2] + 100 * (bits["fr"][1] + apart)) / 103)


def test_junk_and_clean_rows(spark):
    """Of labelled rows, held-out ones among them: at most 5 % of the junk stays and 0.5 % of the clean text goes."""
    data = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{data}/{name}.parquet") for name in ("documents", "labels"))
    judged = quality.quality(docs, labels).join(labels.select("doc_id", "quality").distinct(), "doc_id")
    share = {r.quality: r.share for r in judged.groupBy("quality").agg(F.avg(F.col("accepted").cast("int")).alias("share")).collect()}
    assert share[0] <= 0.05 and share[1] >= 0.995


def judged(docs, labels):
    return sorted((str(r.doc_id), r.lang, r.n_bytes, round(r.perplexity, 6), round(r.threshold, 6), r.accepted) for r in quality.quality(docs, labels).collect())


def test_blocks_change_nothing(spark, odd, monkeypatch):
    """Rows without an id, and rows that share one, keep their own verdicts, however blocks, pieces and tasks part the texts."""
    more = odd.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(4, "another text", "en"), (None, "qqqq", "fr"), (1, "a b c a b c", None)], "doc_id long, text string, lang string"))
    labels = spark.createDataFrame([(i, 1) for i in range(1, 8)], "doc_id long, quality int")
    whole = judged(more, labels)
    monkeypatch.setattr(quality, "BLOCK_BYTES", 5000)
    monkeypatch.setattr(quality, "PACK", 700)
    monkeypatch.setattr(quality, "ROW_GRAMS", 2)
    monkeypatch.setattr(quality, "PIECE", 7)
    monkeypatch.setattr(quality, "HELD", 5)
    assert len(whole) == 14 and judged(more.repartition(3), labels) == whole


def test_blocks_are_bounded(spark, monkeypatch):
    """However uneven the lengths, no block holds as much as two bounds; pieces give every byte of a text once, with what its first grams need."""
    monkeypatch.setattr(quality, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(quality, "PACK", 300)
    texts = {i: ("ab é"[i % 4] * n) for i, n in enumerate([0, 1, 5, 999, 1000, 1001, 4003, 20_000, *[7] * 200, 1500])}
    rows = spark.createDataFrame([(i, i, "en", t) for i, t in texts.items()], f"{ROW} long, doc_id long, lang string, text string")
    blocks = quality.in_blocks(rows.coalesce(1)).where("texts is not null").collect()
    sizes, got = {}, dict.fromkeys(texts, b"")
    for r in sorted(blocks, key=lambda r: r.block):
        raw, at = zstandard.decompress(bytes(r.texts)) if r.texts else b"", 0
        sizes[r.block] = sizes.get(r.block, 0) + sum(r.lengths)
        for i, n, skip in zip(r.rows, r.lengths, r.skips, strict=True):
            assert raw[at : at + skip] == (got[i][-skip:] if skip else b"")
            got[i] += raw[at + skip : at + n]
            at += n
    assert got == {i: t.encode() for i, t in texts.items()} and max(sizes.values()) < 2000 and len(sizes) > 25


def test_quality_is_the_plain_version(spark):
    """Perplexities, thresholds and verdicts, in scripts of one to four bytes a character, held against plain Python."""
    rng = random.Random(4)
    words = {"en": "the of and quick brown fox jumps over lazy dogs".split(), "ar": "في من على سلام كتاب مدرسة".split(), "zh": list("我们学习语言模型的方法"), "": ["🙂🙃", "ok", "ß"]}
    docs = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(1, 30))), lang) for i, lang in enumerate(rng.choice(list(words)) for _ in range(500))]
    docs += [(1000 + i, "".join(chr(rng.randrange(33, 1500)) for _ in range(60)), "en") for i in range(8)] + [(2000, "", "en"), (2001, None, "zh"), (2002, "字字字", "xx")]
    good = {d for d, _, _ in docs if d < 500 and d % 3}
    want = plain.quality(docs, good, quality.ORDER, quality.START, quality.PRIOR, quality.QUANTILE, quality.HELD_OUT_PRIOR)
    labels = spark.createDataFrame([(d, int(d in good)) for d, _, _ in docs], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3), labels).collect()}
    assert set(got) == set(want)
    for d, (perplexity, threshold, accepted) in want.items():
        assert np.isclose(got[d].perplexity, perplexity, rtol=1e-6) and np.isclose(got[d].threshold, threshold, rtol=1e-6) and got[d].accepted == accepted
    assert not all(r.accepted for r in got.values())


def test_row_keys(spark, odd, tmp_path):
    odd.repartition(3).write.parquet(str(tmp_path / "a b"))
    for df in (spark.read.parquet(str(tmp_path / "a b")), odd, odd.where("doc_id is null")):
        keyed = with_row(df)
        assert keyed.columns == [*df.columns, ROW] and keyed.count() == df.count() == keyed.select(ROW).distinct().count()
        assert sorted(map(str, keyed.collect())) == sorted(map(str, keyed.repartition(2).collect()))
