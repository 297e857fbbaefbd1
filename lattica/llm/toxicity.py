"""Toxicity scores by a factorization machine over hashed terms.

Terms of a document are its distinct words, lower-cased, and the first PREFIXES bytes of longer ones, so that
inflections of a rare stem share evidence. Every hashed term has a weight and a factor: with n terms in a document,
score = sigmoid(b + sum w_i + 1/n sum over pairs of <v_i, v_j>). The part of pairs is a mean, as else all terms of a long
text would learn to tell training texts by their mere number. No term is left out.

Over all labelled training rows Spark counts the documents of each class by term; terms whose class rates differ
clearly start from these counts, all others at 0. The machine is trained on the driver, on at most SAMPLE_ROWS labelled
rows, by updates of the terms that a batch has, until the loss on a tenth of these rows, kept back, no longer falls. It
scores every document where it is: its size is fixed by BUCKETS and FACTORS.

Factors move by the plain gradient, not by one that is evened out from term to term: what a pair teaches adds up over
all texts that have it, and so outgrows what hundreds of other terms of a text teach by chance. In these steps a pair counts
as much in a long text as in a short one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.bpe_words import batches
from lattica.llm.common import in_arrow, materialize, released, sized, text_or_empty
from lattica.llm.word_hash import joined, mix, range_hashes, ranges

BUCKETS = 1 << 20
PREFIXES = (4, 5)
FACTORS = 8
#: Labelled rows that the machine is fitted on, those with the smallest hashes of their ids; counts cover all.
SAMPLE_ROWS = 20_000
BATCH, STEPS, EPOCHS = 128, 100, 40
#: The part of the rows that is kept back, as a divisor; epochs that may pass without a loss on it that is lower by GAIN.
KEPT_BACK, PATIENCE, GAIN = 10, 3, 5e-4
#: Steps of weights and factors, their decay, and the factors' spread at first; a step of all factors is no longer than LONGEST.
RATE, FACTOR_RATE, DECAY, SPREAD, LONGEST = 0.2, 1.0, 1e-3, 0.02, 1.0
#: Standard errors between the class rates of a term that starts from its counts; documents at which such a weight is halved.
CLEAR, SHRINK = 3.0, 20


def document_terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, bucket) pairs of the texts, sorted."""
    data, starts = joined([t.lower() for t in texts])
    inside = (data >= 128) | ((data >= 97) & (data <= 122))
    a, b = ranges(inside)
    text = np.searchsorted(starts, a, side="right") - 1
    words = range_hashes(data, a, b)
    order = np.lexsort((words, text))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(text[order]) != 0) | (np.diff(words[order]) != 0)
    first = order[new]
    a, b, text, hashes = a[first], b[first], text[first], [words[first]]
    texts_of = [text]
    for n in PREFIXES:
        long = b - a > n
        hashes.append(mix(range_hashes(data, a[long], a[long] + n) + np.uint64(n)))
        texts_of.append(text[long])
    bucket = (np.concatenate(hashes) & np.uint64(BUCKETS - 1)).astype(np.int64)
    pairs = np.unique(np.concatenate(texts_of) * BUCKETS + bucket)
    return pairs // BUCKETS, pairs % BUCKETS


def term_counts(train: DataFrame) -> DataFrame:
    """bucket, toxic and clean: documents of either class that have the term, over all rows of train (text, toxic)."""
    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS), np.int32)
        for batch in rows:
            texts, toxic = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in batches(texts):
                text, bucket = document_terms(texts[a:b])
                np.add.at(seen, (toxic[a:b][text], bucket), 1)
        found = np.flatnonzero(seen.any(axis=0))
        for i in range(0, len(found), 65_536):
            part = found[i : i + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(seen[1, part]), pa.array(seen[0, part])], names=["bucket", "toxic", "clean"])

    counted = in_arrow(train.select("text", "toxic"), count, "bucket int, toxic int, clean int")
    return counted.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def first_weights(counts: DataFrame, n_toxic: int, n_clean: int) -> np.ndarray:
    """The weights that terms start from: log odds, shrunk where few documents have the term, or 0 if the classes don't differ clearly."""
    c = np.zeros((BUCKETS, 2))
    found = counts.where(F.col("toxic") + F.col("clean") > 1).toArrow()  # BUCKETS rows at most
    c[found.column("bucket").to_numpy()] = np.stack([found.column("toxic").to_numpy(), found.column("clean").to_numpy()], axis=1)
    of = np.array([max(1, n_toxic), max(1, n_clean)])
    rate = (c.sum(axis=1) + 1) / (of.sum() + 2)
    apart = np.abs(c[:, 0] / of[0] - c[:, 1] / of[1]) / np.sqrt(rate * (1 - rate) * (1 / of).sum())
    odds = np.log((c[:, 0] + 0.5) / (n_toxic + 1)) - np.log((c[:, 1] + 0.5) / (n_clean + 1))
    return np.where(apart > CLEAR, odds * c.sum(axis=1) / (c.sum(axis=1) + SHRINK), 0.0)


def summed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of rows of these sizes; an empty run's is 0."""
    out = np.zeros((len(sizes), *values.shape[1:]), values.dtype)
    some = np.flatnonzero(sizes)
    if len(some):
        out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some])
    return out


class Machine:
    """A factorization machine over binary terms; a text is a run of term numbers."""

    def __init__(self, weights: np.ndarray, seed: int = 7):
        self.b = 0.0
        self.w = weights.astype(np.float32)
        self.v = np.random.default_rng(seed).standard_normal((len(weights), FACTORS), np.float32) * np.float32(SPREAD)

    def sums(self, sizes: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The scores before the sigmoid of texts of these sizes, and the sums of their terms' factors."""
        v = self.v[terms]
        whole = summed(v, sizes)
        pairs = (whole**2).sum(axis=1) - summed((v**2).sum(axis=1), sizes)
        return self.b + summed(self.w[terms], sizes) + 0.5 * pairs / np.maximum(sizes, 1), whole

    def raw(self, sizes: np.ndarray, terms: np.ndarray) -> np.ndarray:
        return self.sums(sizes, terms)[0]

    def loss(self, rows: list[np.ndarray], y: np.ndarray) -> float:
        total = 0.0
        for i in range(0, len(rows), BATCH):
            part = rows[i : i + BATCH]
            z = np.clip(self.raw(np.array([len(r) for r in part]), np.concatenate(part)), -30, 30)
            total += float(np.sum(np.log1p(np.exp(z)) - y[i : i + BATCH] * z))
        return total / len(rows)

    def fit(self, rows: list[np.ndarray], y: np.ndarray, seed: int = 7) -> None:
        """Gradient steps on the logistic loss, of the terms of a batch alone; the machine of the best epoch stays.

        Rows too few to keep any back are learnt for STEPS steps.
        """
        rng = np.random.default_rng(seed)
        rate = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
        self.b = float(np.log(rate / (1 - rate)))
        order = rng.permutation(len(rows))
        back, use = np.split(order, [len(rows) // KEPT_BACK])
        best, since, kept = np.inf, 0, None
        for epoch in range(EPOCHS if len(back) else STEPS * BATCH // max(1, len(rows)) if len(rows) else 0):
            use = rng.permutation(use)
            for i in range(0, len(use), BATCH):
                self._step([rows[k] for k in use[i : i + BATCH]], y[use[i : i + BATCH]])
            if len(back):
                now = self.loss([rows[k] for k in back], y[back])
                since = 0 if now < best - GAIN else since + 1
                if now < best and kept is None:
                    best, kept = now, (self.b, self.w.copy(), self.v.copy())
                elif now < best:  # into the arrays that are there
                    np.copyto(kept[1], self.w)
                    np.copyto(kept[2], self.v)
                    best, kept = now, (self.b, *kept[1:])
                if since >= PATIENCE and (epoch + 1) * len(use) >= STEPS * BATCH:
                    break
        if kept:
            self.b, self.w, self.v = kept

    def _step(self, rows: list[np.ndarray], y: np.ndarray) -> None:
        sizes, terms = np.array([len(r) for r in rows]), np.concatenate(rows)
        z, whole = self.sums(sizes, terms)
        e = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(rows)).astype(np.float32)
        by = np.argsort(terms, kind="stable")
        first = np.flatnonzero(np.diff(terms[by], prepend=-1))
        text, u, n = np.repeat(np.arange(len(rows)), sizes)[by], terms[by][first], np.diff(first, append=len(by))
        dw = summed(e[text], n) + DECAY * self.w[u]
        dv = summed((whole * e[:, None])[text], n) - (summed(e[text], n)[:, None] - DECAY) * self.v[u]
        self.b -= RATE * float(e.sum())
        self.w[u] -= RATE * dw
        self.v[u] -= dv * np.float32(min(FACTOR_RATE, LONGEST / max(1e-12, float(np.sqrt((dv**2).sum())))))


def train(labelled: DataFrame) -> Machine:
    """The machine, from rows (doc_id, text, toxic 0 or 1). Without rows, scores are low."""
    n = {r.toxic: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    machine = Machine(first_weights(term_counts(labelled), n.get(1, 0), n.get(0, 0)))
    part = min(1.0, 1.2 * SAMPLE_ROWS / max(1, sum(n.values())))
    bound = int(part * 1_000_000)  # of a hash modulo a million: about the rows that the limit below takes, and some more

    def features(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts, out = batch.column(1).to_pylist(), []
            for a, b in batches(texts):
                text, bucket = document_terms(texts[a:b])
                out += np.split(bucket.astype(np.int32), np.searchsorted(text, np.arange(1, b - a)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in out], pa.binary()), batch.column(2)], names=["doc_id", "x", "toxic"])

    near = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < bound).select("doc_id", "text", "toxic")
    sample = in_arrow(near, features, "doc_id long, x binary, toxic int").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)), "doc_id", "toxic", "x").limit(SAMPLE_ROWS).toArrow()
    rows = [np.frombuffer(x.as_buffer(), np.int32) for x in sample.column("x")]  # as they lie in Arrow
    machine.fit(rows, sample.column("toxic").to_numpy().astype(np.float32))
    del rows, sample
    released()
    return machine


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted, one row for each row of docs.

    Held out, and never learnt from, are ids whose CRC-32 as text is a multiple of 5. Labels other than 0 and 1, null
    ones too, are left aside, and so are ids that are labelled both; a null text is an empty one, whose score is the bias
    alone. Only the text makes a score. Without usable labels every score is low. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & ~held)
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    labelled = materialize(rows.join(sized(known), "doc_id").select("doc_id", "text", "toxic"), "labelled")
    shared = spark.sparkContext.broadcast(train(labelled))

    def score(batch_rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batch_rows:
            texts, out = batch.column(1).to_pylist(), [np.zeros(0)]
            for a, b in batches(texts):
                text, bucket = document_terms(texts[a:b])
                raw = machine.raw(np.bincount(text, minlength=b - a), bucket).astype(float)
                out.append(1 / (1 + np.exp(-np.clip(raw, -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], names=["doc_id", "score"])

    scored = in_arrow(rows, score, "doc_id long, score double")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
