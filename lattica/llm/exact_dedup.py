"""Exact deduplication: a Bloom filter tells the hashes that may repeat, and only their rows are shuffled.

First pass: tasks set k bits for each text's hash in two bitmaps, `once` and `twice`, the second for bits that a
second row hits. Bitmaps of several tasks merge as saturating counters do, in pieces of the hash space. Second pass:
a row all of whose bits are in `twice` may have an equal; any other row has none for certain and passes straight
through. A false positive only takes a needless way through the shuffle, where the SHA-256 of the text decides.

The filter has BITS_A_ROW bits for each counted row, whatever their number. What is broadcast at once is a slice of it of
SLICE_BITS at most: rows are written by slice of the hash space, without a shuffle, and slice after slice is counted and
tested, so the share of needless rows stays the same and no machine holds the filter as a whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import in_arrow, materialize, scratch

BITS_A_ROW, PROBES = 16, 4
#: 16 MB of broadcast at once.
SLICE_BITS = 1 << 27
#: Bits of a piece, the unit in which bitmaps are merged.
PIECE = 1 << 16


def probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit positions of each 64-bit hash, by double hashing; bits is a power of two."""
    h = hashes.astype(np.int64).view(np.uint64)
    step = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)
    shift = np.uint64(64 - (bits.bit_length() - 1))
    mixed = h * np.uint64(0x9E3779B97F4A7C15)
    return np.stack([(mixed + np.uint64(i) * step) >> shift for i in range(PROBES)], axis=1).astype(np.int64)


class Counter:
    """Two bitmaps, by pieces: bits hit at least once, and by at least two rows."""

    def __init__(self):
        self.once: dict[int, np.ndarray] = {}
        self.twice: dict[int, np.ndarray] = {}

    def _of(self, kind: dict, piece: int) -> np.ndarray:
        if piece not in kind:
            kind[piece] = np.zeros(PIECE // 8, np.uint8)
        return kind[piece]

    def add(self, positions: np.ndarray) -> None:
        found, hits = np.unique(np.sort(positions, axis=1).ravel(), return_counts=True)
        pieces = found // PIECE
        edges = np.flatnonzero(np.diff(pieces, prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            at, piece = found[a:b] % PIECE, int(pieces[a])
            once, twice = np.zeros(PIECE // 8, np.uint8), np.zeros(PIECE // 8, np.uint8)
            bit = (1 << (at & 7)).astype(np.uint8)
            np.bitwise_or.at(once, at >> 3, bit)
            again = hits[a:b] > 1
            np.bitwise_or.at(twice, at[again] >> 3, bit[again])
            self.merge(piece, once, twice)

    def merge(self, piece: int, once: np.ndarray, twice: np.ndarray) -> None:
        mine = self._of(self.once, piece)
        self._of(self.twice, piece)[:] |= twice | (mine & once)
        mine |= once

    def rows(self) -> Iterator[pa.RecordBatch]:
        for piece, once in self.once.items():
            yield pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int32()), "once": [zlib.compress(once.tobytes(), 1)], "twice": [zlib.compress(self.twice[piece].tobytes(), 1)]})


def repeat_filter(hashes: DataFrame, rows: int) -> tuple[np.ndarray, int]:
    """The `twice` bitmap of a one-column table of about so many 64-bit hashes, packed, and its size in bits."""
    bits = min(SLICE_BITS, max(PIECE, 1 << (BITS_A_ROW * max(rows, 1) - 1).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for b in batches:
            if b.num_rows:
                counter.add(probes(b.column(0).to_numpy(zero_copy_only=False), bits))
        yield from counter.rows()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for b in batches:
            for r in b.to_pylist():
                counter.merge(r["piece"], *(np.frombuffer(zlib.decompress(r[k]), np.uint8) for k in ("once", "twice")))
        yield from counter.rows()

    schema = "piece int, once binary, twice binary"
    merged = in_arrow(in_arrow(hashes, count, schema).repartition("piece"), merge, schema)
    out = np.zeros(bits // 8, np.uint8)
    for r in merged.select("piece", "twice").toLocalIterator():  # SLICE_BITS at most
        out[r.piece * PIECE // 8 : (r.piece + 1) * PIECE // 8] = np.frombuffer(zlib.decompress(r.twice), np.uint8)
    return out, bits


def may_repeat(shared: Broadcast, bits: int) -> Callable[[str], Column]:
    """Whether a second row may have this 64-bit hash. False is certain."""

    @F.arrow_udf("boolean")
    def test(h: pa.Array) -> pa.Array:
        at = probes(h.to_numpy(zero_copy_only=False), bits)
        held = np.frombuffer(shared.value, np.uint8)
        return pa.array(((held[at >> 3] >> (at & 7)) & 1).all(axis=1))

    return test


def with_again(rows: DataFrame, n: int) -> DataFrame:
    """rows (h, ...), about n of them, with `again`: whether a second row may have the same h."""
    spark, slices = rows.sparkSession, -(-BITS_A_ROW * max(n, 1) // SLICE_BITS)
    if slices == 1:
        bitmap, bits = repeat_filter(rows.select("h"), n)
        return rows.withColumn("again", may_repeat(spark.sparkContext.broadcast(bitmap.tobytes()), bits)("h"))
    parted = materialize(rows.withColumn("slice", F.pmod("h", F.lit(slices)).cast("int")), "dedup-slices", "slice")
    out = scratch(spark, "dedup-tested")
    for i in range(slices):
        part = parted.where(F.col("slice") == i).drop("slice")
        bitmap, bits = repeat_filter(part.select("h"), n // slices + 1)
        shared = spark.sparkContext.broadcast(bitmap.tobytes())
        tested = part.withColumn("again", may_repeat(shared, bits)("h"))
        tested.write.mode("append").parquet(out)
        shared.destroy()
    return spark.read.schema(tested.schema).parquet(out)


def _text(column: str, normalize) -> Column:
    text = F.coalesce(F.col(column), F.lit(""))
    return normalize(text) if normalize else text


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalize=None) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Equal texts (after `normalize`, a function from Column to Column; none by default) are a group; null is empty.
    The row with the largest id is kept, a null id counting as the smallest; of several rows with that id and text
    exactly one is kept. No text is shuffled. An empty table gives an empty one.
    """
    text = _text(text_col, normalize)
    keys = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("text_sha256"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"))
    keys = materialize(keys, "dedup-keys")
    n = keys.count()
    keys = materialize(with_again(keys, n).drop("h"), "dedup-marked")
    again = keys.where("again")
    groups = again.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("n"))
    groups = materialize(groups.where("n > 1").select("text_sha256", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "n"), "dedup-groups")
    # At most 1000 groups hold a thousandth of the rows: so many are broadcast, and no key of the other join is hot.
    hot, rest = groups.where(F.col("n") * 1000 > n), groups.where(F.col("n") * 1000 <= n)
    hot = again.join(F.broadcast(hot.withColumnRenamed("text_sha256", "k")), F.col("text_sha256") == F.col("k"), "left").drop("k")
    rest = hot.where("n is null").select("doc_id", "text_sha256", "row").join(rest, "text_sha256", "left")
    alone = keys.where("not again").select("doc_id", "text_sha256", "row", F.lit(None).cast("long").alias("keep_id"), F.lit(None).cast("long").alias("keep_row"), F.lit(None).cast("long").alias("n"))
    out = alone.unionByName(hot.where("n is not null").select(alone.columns)).unionByName(rest.select(alone.columns))
    kept = F.col("n").isNull() | (F.col("row") == F.col("keep_row"))
    return out.select("doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalize=None) -> DataFrame:
    """The rows of docs that mark_duplicates keeps, with all their columns, whatever their names.

    Of rows with equal text and id, the one whose other columns are largest is kept, in their order; columns that have no
    order, maps and what holds them, are compared by what they look like as text. Rows that cannot have an equal pass without a
    shuffle; of the rest, partial aggregation leaves a task one row a text.
    """
    text = _text(text_col, normalize)
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(text).alias("h"), F.sha2(text.cast("binary"), 256).alias("sha"))
    rows = with_again(rows, docs.count())
    unordered = ("map<", "variant")
    others = [F.to_json(F.struct(F.col("row")[f.name])) if any(x in f.dataType.simpleString() for x in unordered) else F.col("row")[f.name] for f in docs.schema.fields if f.name != id_col]
    best = rows.where("again").groupBy("sha").agg(F.max_by("row", F.struct(F.col("row")[id_col], *others)).alias("row"))
    return rows.where("not again").select("row.*").unionByName(best.select("row.*"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
