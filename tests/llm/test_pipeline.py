"""The pipeline against plain versions of all its stages, none of them the library's."""

import hashlib

import plain
from helpers import DATA

import corpus_pipeline
from lattica.llm import quality


def test_pipeline(spark):
    import public_tokenizers as P
    import tiktoken

    from lattica.llm.bpe_codec import read_ranks

    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").collect()]
    good = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r.quality == 1}
    judged = plain.quality(rows, good, quality.ORDER, quality.START, quality.PRIOR, quality.QUANTILE, quality.HELD_OUT_PRIOR)
    texts = {d: t or "" for d, t, _ in rows if judged[d][2]}
    last = {t: max(d for d, u in texts.items() if u == t) for t in texts.values()}
    texts = {d: t for d, t in texts.items() if last[t] == d}
    classes = plain.classes(texts)
    texts = {d: t for d, t in texts.items() if classes[d] == d}
    gone = plain.contaminated(texts, [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()])
    assert gone and len(judged) > len(texts) > 50
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(read_ranks(path))}, special_tokens={})
    want = []
    for d, t in texts.items():
        if d not in gone:
            ids = ranks.encode_ordinary(t)
            want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == sorted(want)


def test_stages_keep_columns(spark, odd, empty):
    """Deciding stages return the columns of their input, whatever their names, and an empty table stays empty."""
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, DATA).columns == odd.columns
        assert stage(spark, empty, DATA).count() == 0
    assert corpus_pipeline.encode(spark, odd, DATA).count() == 11
