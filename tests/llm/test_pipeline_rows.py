"""The pipeline's deciding stages on rows without an id, and on rows that share one but not the text."""

import random

from helpers import DATA

import corpus_pipeline


def test_stages_decide_by_row(spark, tmp_path):
    random.seed(11)
    base = [f"w{random.randrange(500)}" for _ in range(120)]
    near = [" ".join([*base, f"end{k}"]) for k in range(4)]
    other = [" ".join(f"v{random.randrange(500)}" for _ in range(80)) for _ in range(3)]
    passage = next(r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if len((r.text or "").split()) > 20)

    def through(stage, rows):
        path = str(tmp_path / str(random.random()))
        spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2).write.parquet(path)
        return sorted((str(r.doc_id), r.text) for r in stage(spark, spark.read.parquet(path), DATA).collect())

    # Near copies: two without an id, and 7 with another text of the same id.
    got = through(corpus_pipeline.keep_apart, [(None, near[0], "en"), (None, near[1], "en"), (7, near[2], "en"), (5, near[3], "en"), (7, other[0], "en"), (None, other[1], "en"), (None, other[1], "en")])
    assert got == sorted([("5", near[3]), ("7", other[0]), ("None", other[1])])
    # Contaminated rows go alone.
    got = through(corpus_pipeline.keep_clean, [(None, passage, "en"), (None, other[0], "en"), (3, passage, "en"), (3, other[1], "en")])
    assert got == sorted([("None", other[0]), ("3", other[1])])
    # So do rejected ones.
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    trusted = spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1")
    good = docs.join(trusted.select("doc_id"), "doc_id").where("lang = 'en' and length(text) > 300").orderBy("doc_id").first().text
    junk = "qzxj " * 400
    got = through(corpus_pipeline.keep_quality, [*map(tuple, docs.collect()), (None, junk, "en"), (None, good, "en"), (900_001, junk, "en"), (900_001, good, "en")])
    assert junk not in {text for _, text in got} and [d for d, text in got if text == good and d in ("None", "900001")] == ["900001", "None"]


def test_columns_of_any_names_pass(spark, tmp_path):
    """Columns that are called as those that stages use inside come through with their values."""
    rows = spark.createDataFrame([(1, "one text " * 20, "en"), (2, "other words " * 20, "en")], "doc_id long, text string, lang string")
    clashing = ["file", "number", "row_place", "row_file", "row_key", "Row_Key_", "gone_row", "_metadata", "row", "id"]
    from pyspark.sql import functions as F

    rows.withColumns({c: F.lit(c) for c in clashing}).write.parquet(str(tmp_path / "docs"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.read.parquet(str(tmp_path / "docs"))
        got = stage(spark, docs, DATA)
        assert got.columns == docs.columns
        assert all(r[c] == c for r in got.collect() for c in clashing) and got.count() == 2


def test_run_on_empty_tables(spark, tmp_path):
    names = ("documents", "labels", "benchmark")
    for empty in (*((n,) for n in names), names):
        folder = tmp_path / "-".join(empty)
        for name in names:
            t = spark.read.parquet(f"{DATA}/{name}.parquet")
            (t.limit(0) if name in empty else t).write.parquet(f"{folder}/{name}.parquet")
        n = corpus_pipeline.run(spark, str(folder)).count()
        assert n == 0 if "documents" in empty else n > 0
