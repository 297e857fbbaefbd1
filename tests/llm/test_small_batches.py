"""How much text a Python worker of the pipeline's stages has at once."""

import random

from lattica.llm import bpe_codec, common, near_dedup, quality


def test_packs_of_texts_are_small(spark):
    """6 MB of texts in one partition are compressed about 1 MB at a time, each once."""
    r = random.Random(2)
    texts = ["".join(r.choices("abcdefgh ", k=60_000)) for _ in range(100)]
    docs = spark.createDataFrame([(i, i, "en", t) for i, t in enumerate(texts)], f"{common.ROW} long, doc_id long, lang string, text string").coalesce(1)
    packs = quality.in_blocks(docs).where("texts is not null").select("rows", "lengths").collect()
    assert max(sum(p.lengths) for p in packs) <= 3 << 19
    assert sorted(x for p in packs for x in p.rows) == list(range(100)) and sum(sum(p.lengths) for p in packs) == 6_000_000


def test_stages_ask_for_small_batches(spark):
    docs, name = spark.createDataFrame([(1, 1, "a b")], "id long, doc_id long, text string"), "spark.sql.execution.arrow.maxBytesPerBatch"
    docs, before = docs.select("id", "text", "doc_id"), spark.conf.get(name)
    for stage in (near_dedup.sign, near_dedup.bags, bpe_codec.encoded_digests):
        spark.conf.set(name, str(1 << 28))
        stage(docs)
        assert int(spark.conf.get(name)) == 1 << 20
    spark.conf.set(name, before)
