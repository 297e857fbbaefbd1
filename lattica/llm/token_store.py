"""Token ids on disk: a shard file of documents compressed one by one with a shared zstandard dictionary.

A shard is MAGIC, the documents' frames, an index (INDEX, one record a document), and a footer: the index's
offset, the number of documents, bytes an id, the SHA-256 of the dictionary, MAGIC. One document is read by one
index record and one frame. The dictionary is a file of its own, named by its hash, beside the shards.

Shards are written by tasks under names that no other attempt uses. Only files named in the manifest, which Spark
commits, count; what a lost or repeated attempt left is never read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.bpe_words import BATCH, WordCache, batches
from lattica.llm.common import in_arrow, materialize, scratch, text_or_empty

MAGIC = b"TOKSHRD1"
FOOTER = "<QQB32s8s"  # index offset, documents, bytes an id, dictionary hash, MAGIC
FOOTER_SIZE = struct.calcsize(FOOTER)
INDEX = np.dtype([("doc_id", "<i8"), ("is_null", "u1"), ("offset", "<u8"), ("length", "<u4"), ("n_tokens", "<u4")])
LEVEL = 3

#: Words whose ids a worker keeps, some 170 MB of them.
KEPT_WORDS = 800_000
#: How byte-level vocabularies write a space.
SPACE = "\u0120"

_tokenizers: dict[tuple[str, bool], WordCache] = {}


def tokenizer(path: str, plain: bool = False) -> WordCache:
    """The tokenizer of a worker, kept from task to task; its ids are of 16 bits if the vocabulary allows, else of 32.

    Strings of special tokens in a text become these tokens, as is the library's default; with plain=True they are text.
    """
    if (path, plain) not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = plain

        tokens = t.get_vocab(with_added_tokens=True)
        dtype = "<u2" if max(tokens.values()) < 1 << 16 else "<u4"
        spaced = np.zeros(max(tokens.values()) + 1, bool)
        spaced[[i for piece, i in tokens.items() if piece.startswith(SPACE)]] = True

        def encode_texts(texts: list[str]) -> list[bytes]:
            return [np.array(e.ids, dtype).tobytes() for e in t.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

        def encode_words(words: list[str]) -> list[bytes]:
            """Encoded as one text some hundreds at a time, and parted where a token starts with the space of a word."""
            out = []
            for i in range(0, len(words), 512):
                ids = np.array(t.encode_batch_fast([" " + " ".join(words[i : i + 512])], add_special_tokens=False)[0].ids, dtype)
                raw, at = ids.tobytes(), (np.flatnonzero(spaced[ids]) * ids.itemsize).tolist()
                out += [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)], strict=True)]
            return out

        _tokenizers[path, plain] = WordCache(encode_texts, encode_words, dtype, KEPT_WORDS)
    return _tokenizers[path, plain]


def filesystem(uri: str):
    """A pyarrow filesystem and the path in it. Tasks write the shards through it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary from serialized id arrays; raw content where there is too little to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return (b"".join(samples) or bytes(16))[-size:].ljust(16, b"\0")


def _dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw)


def write_store(
    docs: DataFrame, out: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = 0, vocab_size: int = 50_257, dict_bytes: int = 65_536, sample_docs: int = 1024, sample_chars: int = 4096,
) -> DataFrame:
    """Writes docs under out in ascending order of id, a null id first, and returns the manifest, one row a shard.

    A null text is an empty one, whose ids are the end id alone. Rows of one id are ordered by a hash of their text, then by it,
    so that rows of an id that is very common spread over shards.
    An empty table has an empty manifest. Other columns are not read. The dictionary only affects compression; it is
    trained on the sample_docs documents of at most sample_chars characters with the smallest hashes of their ids.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), F.xxhash64(text_or_empty(text_col)).alias("hash"))
    # About as many rows as are taken get to the driver: those whose hash, modulo a million, is small enough.
    bound = min(1_000_000, 4_000_000 * sample_docs // max(1, docs.count()) + 1)
    short = docs.where((F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < bound) & (F.length("text") <= sample_chars))
    sample = short.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).collect()
    width = 2 if vocab_size <= 65_536 else 4
    ids, bounds = tokenizer(tokenizer_path).encode(pa.array([r.text for r in sample], pa.string()))
    raw = train_dictionary([ids[a:b].astype(f"<u{width}").tobytes() for a, b in zip(bounds, bounds[1:], strict=False)], dict_bytes)
    digest = hashlib.sha256(raw).digest()
    where, folder = filesystem(out)
    where.create_dir(folder, recursive=True)
    with where.open_output_stream(f"{folder}/{digest.hex()}.zdict") as f:
        f.write(raw)
    shared = spark.sparkContext.broadcast(raw)

    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        where, folder = filesystem(out)
        known = _dictionary(shared.value)
        known.precompute_compress(level=LEVEL)
        packer, tok = zstandard.ZstdCompressor(level=LEVEL, dict_data=known), tokenizer(tokenizer_path)
        name, index, at, tokens, f, first_hash = f"{uuid.uuid4().hex}.tok", [], len(MAGIC), 0, None, None
        end = np.array([end_id], f"<u{width}").tobytes()
        for batch in rows:
            keys, texts, hashes = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
            for a, b in batches(texts, BATCH):
                if f is None:
                    f, first_hash = where.open_output_stream(f"{folder}/{name}"), hashes[a].as_py()
                    f.write(MAGIC)
                ids, bounds = tok.encode(texts[a:b])
                raw, bounds = memoryview(ids.astype(f"<u{width}", copy=False).tobytes()), (bounds * width).tolist()
                for key, low, high in zip(keys[a:b], bounds, bounds[1:], strict=False):
                    n = (high - low) // width + 1
                    frame = packer.compress(b"".join([raw[low:high], end]))
                    f.write(frame)
                    index.append((key or 0, key is None, at, len(frame), n))
                    at, tokens = at + len(frame), tokens + n
        if f is not None:
            f.write(np.array(index, INDEX).tobytes() + struct.pack(FOOTER, at, len(index), width, digest, MAGIC))
            f.close()
            first = None if index[0][1] else index[0][0]
            yield pa.RecordBatch.from_pydict({"shard": [name], "first_id": pa.array([first], pa.int64()), "first_hash": [first_hash], "n_docs": [len(index)], "n_tokens": [tokens], "n_bytes": [at], "dict_sha256": [digest.hex()]})

    schema = "shard string, first_id long, first_hash long, n_docs long, n_tokens long, n_bytes long, dict_sha256 string"
    by = F.col("doc_id").asc_nulls_first(), F.col("hash")
    ordered = docs.repartitionByRange(*by).sortWithinPartitions(*by, "text").select("doc_id", "text", "hash")
    shards = materialize(in_arrow(ordered, write, schema), "shards")
    order = Window.orderBy(F.col("first_id").asc_nulls_first(), "first_hash").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    return shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))


def read_store(manifest: DataFrame, out: str) -> DataFrame:
    """The documents of the shards: doc_id, start (ids before it), n_tokens, and ids as little-endian uint32."""

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        where, folder = filesystem(out)
        unpackers = {}
        for batch in rows:
            for row in batch.to_pylist():
                with where.open_input_file(f"{folder}/{row['shard']}") as f:
                    f.seek(f.size() - FOOTER_SIZE)
                    at, n, width, digest, magic = struct.unpack(FOOTER, f.read(FOOTER_SIZE))
                    if magic != MAGIC:
                        raise ValueError(f"{row['shard']} is no token shard")
                    if digest not in unpackers:
                        with where.open_input_stream(f"{folder}/{digest.hex()}.zdict") as d:
                            raw = d.read()
                        if hashlib.sha256(raw).digest() != digest:
                            raise ValueError(f"the dictionary {digest.hex()} is damaged")
                        unpackers[digest] = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
                    unpack = unpackers[digest].decompress
                    f.seek(at)
                    index = np.frombuffer(f.read(n * INDEX.itemsize), INDEX)
                    starts = row["start"] + np.cumsum(index["n_tokens"], dtype=np.int64) - index["n_tokens"]
                    for a in range(0, n, 256):
                        part = index[a : a + 256]
                        f.seek(int(part["offset"][0]))
                        block, base = f.read(int(part["length"].sum())), int(part["offset"][0])
                        ids = [np.frombuffer(unpack(block[int(o) - base : int(o) - base + int(k)]), f"<u{width}").astype("<u4").tobytes() for o, k in zip(part["offset"], part["length"], strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(part["doc_id"], pa.int64(), mask=part["is_null"].astype(bool)), pa.array(starts[a : a + 256]), pa.array(part["n_tokens"].astype(np.int64)), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    shards = max(1, manifest.count())
    return in_arrow(manifest.select("shard", "start").repartition(shards), read, "doc_id long, start long, n_tokens long, ids binary")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written and read back."""
    import public_tokenizers

    out = scratch(spark, "token-store")
    manifest = write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), out, public_tokenizers.path("byte_bpe_50k.json"))
    return read_store(manifest, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
