"""A quality classifier: perplexity under an interpolated modified Kneser-Ney model of the bytes of trusted text.

Symbols are the bytes of UTF-8, so every code point of every script has its own. Tasks count the ORDER-grams of all
trusted documents; everything else is aggregation and joins of counts, sharded by gram: continuation counts (of how
many grams is this one the end), discounts from counts of counts, what a context leaves to lower orders, and the
interpolated probability.

Documents are scored by joins too. A task cuts the texts it reads into blocks by running bytes, a longer text into pieces
that are blocks of their own, and writes the compressed texts and the distinct grams of each block. The corpus's
distinct grams are looked up in the model, order by order, by joins sharded by gram; the values go back to the blocks
that have the gram, where they meet the texts, and each row's are summed. The texts are written in buckets by block and
stay where they lie. So what is shuffled is the grams of blocks, no block is larger than its bound whatever the lengths of texts, and no part of the model goes to the driver.

Thresholds are per language, the QUANTILE of trusted documents that the model was not trained on, a fifth of them by
the CRC-32 of their ids: a model knows its own text too well for a measure of other text. Short documents say
little, so a perplexity counts PRIOR bytes of the language's mean besides the document's own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.bpe_words import batches
from lattica.llm.common import ROW, SMALL_BATCH_BYTES, cuts_removed, in_arrow, materialize, materialize_in_buckets, released, releasing, scratch, sized, text_or_empty, with_row

ORDER, BITS = 5, 8
SYMBOLS = 1 << BITS
#: Stands before a text; no byte of UTF-8 is 255.
START = 0xFF
PRIOR = 60.0
#: Rejected is what lies above this quantile of the language's held-out log perplexities.
QUANTILE = 0.99
#: A limit is the mean of two: the language's own quantile, weighing as much as it has held-out documents, and its median moved by the
#: quantile of all languages' distances from their medians, weighing as much as so many.
HELD_OUT_PRIOR = 100
#: What lies so little above a limit lies at it: sums are rounded.
ROUNDING = 1e-9
#: Bytes that are made into grams at once; distinct grams that a task holds.
PIECE, HELD = 1 << 19, 1 << 19
#: Bytes of text after which a block ends, and of the texts that are compressed together: those of a batch.
BLOCK_BYTES, PACK = 1 << 24, 2 * SMALL_BATCH_BYTES
#: Grams that are a row of a block's.
ROW_GRAMS = 1 << 16


def byte_grams(texts: pa.Array) -> Iterator[np.ndarray]:
    """The ORDER-grams that end at each byte of the texts, text after text, a PIECE of them at a time."""
    before = b"\xff" * (ORDER - 1)
    data = np.frombuffer(b"".join(x for t in texts.cast(pa.large_binary()).to_pylist() for x in (before, t)), np.uint8)
    for a in range(0, len(data), PIECE):
        part = data[max(0, a - ORDER + 1) : a + PIECE].astype(np.int64)
        n = max(0, len(part) - ORDER + 1)
        keys, done = part, 1
        while done < ORDER:  # a gram is put together from two that overlap in nothing
            more = min(done, ORDER - done)
            keys = (keys[: len(part) - done - more + 1] << BITS * more) | (keys if more == done else part)[done : len(part) - more + 1]
            done += more
        yield keys[:n][part[ORDER - 1 :] != START]


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct keys; keys is sorted in place."""
    keys.sort()
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def merged(keys: list[np.ndarray], c: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sorted distinct keys, and the sums of their counts, as lists of one array each."""
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return [every[first]], [np.add.reduceat(np.concatenate(c)[order], first)]


class Values:
    """Numbers by key, as an open-addressing table; every key that is asked for must be there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            s = slot[left]
            free = self.keys[s] < 0
            self.keys[s[free]] = keys[left[free]]
            placed = self.keys[s] == keys[left]
            self.values[s[placed]] = values[left[placed]]
            left = left[~placed]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        todo = np.flatnonzero(self.keys[slot] != keys)
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            todo = todo[self.keys[slot[todo]] != keys[todo]]
        return self.values[slot]


def count_grams(trusted: DataFrame) -> DataFrame:
    """key and c of every ORDER-gram of the column `text`."""
    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            (keys,), (c,) = merged(held, n)
            for i in range(0, len(keys), 65_536):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 65_536]), pa.array(c[i : i + 65_536])], names=["key", "c"])

        held, n = [], []
        for batch in releasing(rows):
            texts = batch.column(0)
            for a, b in batches(texts, PIECE):
                for more in byte_grams(texts[a:b]):
                    more.sort()
                    first = np.flatnonzero(np.concatenate([[True], more[1:] != more[:-1]])) if len(more) else np.zeros(0, np.int64)
                    held.append(more[first])
                    n.append(np.diff(first, append=len(more)))
                    if sum(map(len, held)) > 2 * HELD:
                        held, n = merged(held, n)
                        if len(held[0]) > HELD:
                            yield from out()
                            held, n = [], []
        if held:
            yield from out()

    return in_arrow(trusted.select("text"), count, "key long, c long", SMALL_BATCH_BYTES).groupBy("key").agg(F.sum("c").alias("c"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and more; customary ones where counts of counts are missing."""
    n = counts.agg(*(F.count(F.when(F.col("c") == k, 1)).alias(f"n{k}") for k in range(1, 5))).first()
    if not all(n):
        return 0.5, 1.0, 1.5
    y = n.n1 / (n.n1 + 2 * n.n2)
    raw = [1 - 2 * y * n.n2 / n.n1, 2 - 3 * y * n.n3 / n.n2, 3 - 4 * y * n.n4 / n.n3]
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


def suffix(key, n: int):
    """The last n symbols of a gram."""
    return key.bitwiseAND((1 << BITS * n) - 1)


def model_tables(trusted: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: log probabilities (key, p) of its grams, and (h, gamma), the logs of what contexts leave to the order below."""
    grams = {ORDER: materialize(count_grams(trusted), "grams")}
    for n in range(ORDER - 1, 0, -1):
        grams[n] = materialize(grams[n + 1].groupBy(suffix(F.col("key"), n).alias("key")).agg(F.count(F.lit(1)).alias("c")), f"grams{n}")
    out, lower = [], None
    for n in range(1, ORDER + 1):
        d1, d2, d3 = discounts(grams[n])
        g = grams[n].withColumn("h", F.shiftright("key", BITS)).withColumn("d", F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3))
        left = materialize(g.groupBy("h").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("gamma")), f"contexts{n}")
        g = g.join(left, "h").withColumn("own", (F.col("c") - F.col("d")) / F.col("total"))
        if lower is None:
            p = g.withColumn("p", F.col("own") + F.col("gamma") / SYMBOLS)
        else:
            p = g.withColumn("s", suffix(F.col("key"), n - 1)).join(lower, "s").withColumn("p", F.col("own") + F.col("gamma") * F.col("lower"))
        p = materialize(p.select("key", "p"), f"model{n}")
        lower = p.select(F.col("key").alias("s"), F.col("p").alias("lower"))
        out.append((p.select("key", F.log("p").alias("p")), left.select("h", F.log("gamma").alias("gamma"))))
    return out


def looked_up(grams: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """key and p, the log probability of the last symbol of each distinct ORDER-gram in the column `key`.

    That is the probability of the longest end of the gram that is known, times what the contexts above leave to it. Each
    order is two joins sharded by gram; only grams that an order doesn't know go on to the next.
    """
    left, out = grams.select("key", F.col("key").alias("end"), F.lit(0.0).alias("so_far")), None
    for n in range(ORDER, 0, -1):
        known, gamma = model[n - 1]
        found = left.join(known.select(F.col("key").alias("end"), "p"), "end", "left")
        found = materialize(found, f"lookup{n}")
        done = found.where("p is not null").select("key", (F.col("so_far") + F.col("p")).alias("p"))
        out = done if out is None else out.unionByName(done)
        rest = found.where("p is null").withColumn("h", F.shiftright("end", BITS)).join(gamma, "h", "left")
        left = rest.select("key", suffix(F.col("end"), n - 1).alias("end"), (F.col("so_far") + F.coalesce("gamma", F.lit(0.0))).alias("so_far"))
    return out.unionByName(left.select("key", (F.col("so_far") - float(np.log(SYMBOLS))).alias("p")))


def pieces(lengths: Iterable[int], longest: int, size: int) -> Iterator[list[tuple[int, int, int]]]:
    """Packs of (text, from, to): whole texts, or pieces of the longest length, of about so many bytes together, one at least."""
    pack, held = [], 0
    for i, n in enumerate(lengths):
        for a in range(0, n or 1, longest):
            b = min(n, a + longest)
            if pack and held + b - a > size:
                yield pack
                pack, held = [], 0
            pack.append((i, a, b))
            held += b - a
    if pack:
        yield pack


def in_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of the texts of docs (ROW, doc_id, lang, text), written in buckets by block: each some rows of grams (block, keys) and of texts.

    A row of texts has rows, ids, langs, lengths in bytes, skips and the texts, compressed together. A later piece of a text starts
    with the bytes that its first grams need of the one before, `skips` of them. Block numbers are a task's, so they hold as written.
    """
    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=12)  # they lie on disk until all is scored
        block, size, held = TaskContext.get().partitionId() << 32, 0, []

        def out():
            keys = distinct(np.concatenate(held)) if held else ()
            for i in range(0, len(keys), ROW_GRAMS):
                yield pa.RecordBatch.from_pylist([{"block": block, "keys": keys[i : i + ROW_GRAMS]}], schema)

        for batch in releasing(rows):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            of = [batch.column(c).to_pylist() for c in (ROW, "doc_id", "lang")]
            for pack in pieces(map(len, texts), BLOCK_BYTES, PACK):
                skips = [min(a, ORDER - 1) for _, a, _ in pack]
                raw = [texts[i][a - skip : b] for (i, a, b), skip in zip(pack, skips, strict=True)]
                row = {"block": block, "lengths": list(map(len, raw)), "skips": skips, "texts": packer.compress(b"".join(raw))}
                yield pa.RecordBatch.from_pylist([row | {name: [values[i] for i, _, _ in pack] for name, values in zip(("rows", "ids", "langs"), of, strict=True)}], schema)
                for more in byte_grams(pa.array(raw, pa.large_binary())):
                    held.append(distinct(more))
                    if sum(map(len, held)) > 2 * HELD:
                        held = [distinct(np.concatenate(held))]
                        if len(held[0]) > HELD:
                            yield from out()
                            held = []
                size += sum(row["lengths"])
                if size >= BLOCK_BYTES:
                    yield from out()
                    block, size, held = block + 1, 0, []
        yield from out()

    longs = pa.list_(pa.int64())
    schema = pa.schema([("block", pa.int64()), ("keys", longs), ("rows", longs), ("ids", longs), ("langs", pa.list_(pa.string())), ("lengths", longs), ("skips", longs), ("texts", pa.binary())])
    cuts = in_arrow(docs.select(ROW, "doc_id", "lang", "text"), cut, "block long, keys array<long>, rows array<long>, ids array<long>, langs array<string>, lengths array<long>, skips array<long>, texts binary", SMALL_BATCH_BYTES)
    return materialize_in_buckets(cuts, "blocks", "block")


def block_grams(blocks: DataFrame) -> DataFrame:
    """block and key: the distinct grams of each block; a block of very many repeats some."""
    return blocks.where("keys is not null").select("block", F.explode("keys").alias("key"))


def score(blocks: DataFrame, values: DataFrame) -> DataFrame:
    """ROW, doc_id, lang, nll and n: the negated log probability and the bytes of the text, a row for each ROW, from the values (key, p) of all grams."""
    def sums(texts: pa.Table, values: pa.Table) -> pa.Table:
        import zstandard

        known = Values(values.column("key").to_numpy(), values.column("p").to_numpy())
        del values
        out = [schema.empty_table()]
        for rows, ids, langs, lengths, skips, raw in zip(*(texts.column(c) for c in ("rows", "ids", "langs", "lengths", "skips", "texts")), strict=True):
            lengths, skips = lengths.values.to_numpy(), skips.values.to_numpy()
            ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
            text, at, nll = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths), 0, np.zeros(len(lengths) + 1)
            for i in np.flatnonzero(skips):
                text[ends[i] : ends[i] + skips[i]] = len(lengths)  # not this piece's own
            part = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(zstandard.decompress(raw.as_buffer()))])
            for keys in byte_grams(part):
                nll -= np.bincount(text[at : at + len(keys)], known.get(keys), len(nll))
                at += len(keys)
            del text, part
            out.append(pa.table([rows.values, ids.values, langs.values, pa.array(nll[:-1]), pa.array(lengths - skips)], schema=schema))
        del known
        released()
        return pa.concat_tables(out)

    schema = pa.schema([(ROW, pa.int64()), ("doc_id", pa.int64()), ("lang", pa.string()), ("nll", pa.float64()), ("n", pa.int64())])
    valued = block_grams(blocks).join(values, "key").select("block", "key", "p")
    texts = blocks.where("texts is not null").select(F.col("block").alias("of"), "rows", "ids", "langs", "lengths", "skips", "texts")
    parts = texts.groupBy("of").cogroup(valued.groupBy("block")).applyInArrow(sums, f"{ROW} long, doc_id long, lang string, nll double, n long")
    return parts.groupBy(ROW, "doc_id", "lang").agg(F.sum("nll").alias("nll"), F.sum("n").alias("n"))


def trusted_rows(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """The ids that are labelled 1, and which of them are held out of the training."""
    ids = labels.where(F.col(label_col) == 1).select(F.col(id_col).cast("long").alias("trusted_id")).where("trusted_id is not null").distinct()
    return ids.withColumn("held_out", F.crc32(F.col("trusted_id").cast("string").cast("binary")) % 5 == 0)


def thresholds(scored: DataFrame) -> DataFrame:
    """lang, mean and threshold from rows (lang, nll, n, held_out); lang null is that of all languages."""
    trusted = scored.where("held_out and n > 0")
    either = trusted.unionByName(trusted.withColumn("lang", F.lit(None).cast("string")))
    means = materialize(either.groupBy("lang").agg((F.sum("nll") / F.sum("n")).alias("mean")), "quality-means")
    bits = ((F.col("nll") + PRIOR * F.col("mean")) / (F.col("n") + PRIOR)).alias("bits")
    measured = materialize(either.join(sized(means.withColumnRenamed("lang", "l")), F.col("lang").eqNullSafe(F.col("l"))).select("lang", "mean", bits), "quality-held-out")
    own = measured.groupBy("lang").agg(F.first("mean").alias("mean"), F.count(F.lit(1)).alias("held"), F.percentile_approx("bits", [0.5, QUANTILE]).alias("q"))
    own = materialize(own, "quality-quantiles")
    medians = own.where("lang is not null").select("lang", F.col("q")[0].alias("median"))
    apart = measured.join(sized(medians), "lang").agg(F.percentile_approx(F.col("bits") - F.col("median"), QUANTILE).alias("apart"))
    blend = (F.col("held") * F.col("q")[1] + HELD_OUT_PRIOR * (F.col("q")[0] + F.col("apart"))) / (F.col("held") + HELD_OUT_PRIOR)
    limit = F.when(F.col("lang").isNull(), F.col("q")[1]).otherwise(blend)
    return materialize(own.join(F.broadcast(apart), how="cross").select("lang", "mean", limit.alias("limit")), "quality-limits")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", row_col: str | None = None) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity (per byte), threshold and accepted, one row for each row of docs.

    Documents whose id is labelled 1 are trusted. A null text is an empty one; an empty text has its language's mean and is
    accepted. A null language is the language "". A language without trusted text takes the threshold of all; without
    any trusted text nothing is rejected. Every row is judged by its own text, whatever its id. Where docs has a unique key that
    each read gives again, row_col names it, and it is the column ROW of the result. Other columns are not read.
    """
    columns = F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), text_or_empty(text_col).alias("text")
    spark = docs.sparkSession
    scores, held = scratch(spark, "quality-scores"), F.coalesce("held_out", F.lit(False)).alias("held_out")
    with cuts_removed(spark):  # texts, grams and model take much room and are not read again
        rows = docs.select(*columns, F.col(row_col).alias(ROW)) if row_col else with_row(docs, *columns)
        trusted = materialize(trusted_rows(labels, id_col, label_col), "trusted")
        blocks, values = in_blocks(rows), scratch(spark, "values")
        with cuts_removed(spark):
            model = model_tables(rows.join(sized(trusted.where("not held_out")), F.col("doc_id") == F.col("trusted_id")).select("text"))
            looked_up(block_grams(blocks).select("key").distinct(), model).write.parquet(values)
            del model
        scored = score(blocks, spark.read.schema("key long, p double").parquet(values)).join(sized(trusted), F.col("doc_id") == F.col("trusted_id"), "left")
        scored.select(ROW, "doc_id", "lang", "nll", "n", held).write.parquet(scores)
    scored = spark.read.schema(f"{ROW} long, doc_id long, lang string, nll double, n long, held_out boolean").parquet(scores)
    limits = thresholds(scored)
    every = F.broadcast(limits.where("lang is null").select(F.col("mean").alias("all_mean"), F.col("limit").alias("all_limit")))  # one row
    out = scored.join(sized(limits.where("lang is not null")), "lang", "left").join(every, how="left")
    mean, limit = F.coalesce("mean", "all_mean", F.lit(0.0)), F.coalesce("limit", "all_limit", F.lit(float("inf")))
    out = out.withColumn("m", F.when(F.col("n") > 0, (F.col("nll") + PRIOR * mean) / (F.col("n") + PRIOR)).otherwise(mean)).withColumn("limit", limit)
    return out.select(*([ROW] if row_col else []), "doc_id", "lang", F.col("n").alias("n_bytes"), F.exp("m").alias("perplexity"), F.exp("limit").alias("threshold"), ((F.col("n") == 0) | (F.col("m") <= F.col("limit") + ROUNDING)).alias("accepted"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
