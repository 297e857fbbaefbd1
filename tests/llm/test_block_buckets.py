"""Texts that wait for the values of their grams."""

from pyspark.sql import functions as F

from lattica.llm import quality
from lattica.llm.common import with_row


def test_texts_of_blocks_stay_where_they_lie(spark, odd, monkeypatch):
    """Only grams and their values are shuffled to the texts; the blocks' table has no entry in the catalog."""
    monkeypatch.setattr(quality, "BLOCK_BYTES", 1 << 12)
    rows = with_row(odd, "doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = quality.in_blocks(rows)
    values = quality.block_grams(blocks).select("key").distinct().withColumn("p", F.lit(-1.0))
    scored = quality.score(blocks, values)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(of#" not in plan
    assert all(r.nll == r.n for r in scored.collect()) and scored.count() == odd.count()
    assert not [t for t in spark.catalog.listTables() if "blocks" in t.name]
