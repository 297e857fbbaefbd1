"""Rendezvous hashing of record keys over weighted shards, by DataFrame functions alone.

Every shard draws a number for a key from the hash of both, and the best draw wins: a new shard takes the rows in
which it draws best, and no row moves between old ones. Weights follow the logarithmic method: the best of
-weight / ln(u). Rows of a shard get gapless slots in the order of their keys' hashes, counted block by block, so no
shard is sorted in one task; nor is a key of very many rows, which come last in their shard, dealt to blocks by a number of the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import materialize, sized, table, text_or_empty

#: Rows that a block of slots has on average; a block is one window group.
BLOCK_ROWS = 20_000


def draw(key: Column, shard: int) -> Column:
    """52 bits of the MD5 of key and shard; the same in every engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("long")


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard of a key string: the first of the best draws. A null key is an empty one."""
    key = F.coalesce(key, F.lit(""))
    if len(set(weights)) == 1:  # the score rises with the draw
        scores = [draw(key, s) for s in range(len(weights))]
    else:
        scores = [F.lit(-float(w)) / F.log((draw(key, s) + 0.5) / F.lit(2.0**52)) for s, w in enumerate(weights)]
    return (F.array_position(F.array(*scores), F.array_max(F.array(*scores))) - 1).cast("int")


def shard_rows(docs: DataFrame, weights: list[float], key_col: str = "doc_id") -> DataFrame:
    """docs with their columns in `row`, and shard and slot, the place in the shard from 0 without gaps.

    Rows of one key go to one shard, each with a slot of its own. A null key is an empty one. An empty table stays
    empty. `row` keeps columns of any names apart from ours.
    """
    key = F.coalesce(F.col(key_col).cast("string"), F.lit(""))
    placed = docs.select(F.struct("*").alias("row"), key.alias("k"), F.md5(key).alias("h"), rendezvous(key, weights).alias("shard"), F.monotonically_increasing_id().alias("nth"))
    placed = materialize(placed, "shards")  # counted and numbered below, so it is fixed here
    digits = max(0, (max(1, placed.count()) // (BLOCK_ROWS * len(weights))).bit_length() + 3) // 4
    hot = materialize(placed.groupBy("k").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > BLOCK_ROWS), "hot-keys")
    common = placed.join(sized(hot), "k", "left")
    # Blocks in order: those of other keys by the first digits of the hash; then hot ones, each in parts of its rows.
    part = F.format_string("%020d", F.floor(F.col("nth") / F.lit(BLOCK_ROWS)))
    block = F.when(F.col("rows").isNull(), F.substring("h", 1, digits) if digits else F.lit("")).otherwise(F.concat(F.lit("~"), "h", F.lit("~"), part))
    placed = common.withColumn("block", block).drop("rows")
    sizes = placed.groupBy("shard", "block").count()
    before = sizes.withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = F.row_number().over(Window.partitionBy("shard", "block").orderBy("h", "k", "nth")) - 1
    numbered = placed.withColumn("local", local).join(before.drop("count"), ["shard", "block"])
    return numbered.select("row", "shard", (F.col("before") + F.col("local")).cast("long").alias("slot"))


def op5_sharding(spark: SparkSession, sf_dir: str, shards: int = 8) -> DataFrame:
    text = text_or_empty("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shard_rows(docs, [1.0] * shards)
    grown = rendezvous(F.col("row.doc_id").cast("string"), [1.0] * (shards + 1))
    return out.select("row.*", F.lit("key").alias("law"), "shard", "slot", grown.alias("grown_shard"))


def _sql_draw(shard: int) -> str:
    return f"('0x' || substr(md5(k || ':{shard}'), 1, 13))::BIGINT"


def _sql_best(n: int) -> str:
    scores = "[" + ", ".join(_sql_draw(s) for s in range(n)) + "]"
    return f"list_position({scores}, list_max({scores})) - 1"


def op5_sql(shards: int = 8) -> str:
    """DuckDB has no CRC-32: the SQL makes its table of 256 entries and folds the bytes of a text over it."""
    return f"""
WITH RECURSIVE step(i, c, k) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, xor(c >> 1, (c & 1) * 3988292384), k + 1 FROM step WHERE k < 8),
entries AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
octets AS (SELECT doc_id, list_transform(range(1, length(h) + 1, 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT) AS o FROM hexed),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, len(o) + 1 AS size,
  xor(coalesce(list_reduce(o, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295::BIGINT), 4294967295), 4294967295) AS text_crc32 FROM octets, entries),
p AS (SELECT *, {_sql_best(shards)} AS shard, {_sql_best(shards + 1)} AS grown_shard FROM d)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(k), k) - 1 AS slot, grown_shard::INTEGER AS grown_shard
FROM p
"""
