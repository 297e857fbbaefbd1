"""Byte-level BPE through a sentencepiece model that is written from the vocabulary alone.

A rank file merges the adjacent pair of least rank first, the leftmost of equals; a sentencepiece BPE model merges
the pair of the highest score, the leftmost of equals. So a model whose pieces are the tokens, each byte written as
one character, scored by the negative rank, with no normalisation at all, merges alike, and its piece numbers are
the ranks. A pre-token that is a token itself is that token, as in the rank file's library.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.bpe_words import WordCache, batches
from lattica.llm.chat_format import byte_chars
from lattica.llm.common import SMALL_BATCH_BYTES, in_arrow, releasing, text_or_empty

#: Field numbers and values of the public sentencepiece model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, TYPE = 1, 2, 3
NORMAL, UNKNOWN = 1, 2
MODEL_TYPE, VOCAB_SIZE, UNK_ID, BOS_ID, EOS_ID, PAD_ID = 3, 4, 40, 41, 42, 43
BPE = 2
NAME, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE_SPACES = 1, 3, 4, 5

#: Bytes of text that are encoded at once, whose pre-tokens are lists meanwhile, and words that a worker keeps the codes of.
BATCH, KEPT_WORDS = 1 << 19, 100_000


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, b: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(b)) + b


def _score(x: float) -> bytes:
    return _varint(SCORE << 3 | 5) + struct.pack("<f", x)


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in order of rank; the ranks must be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        ranks = {int(n): base64.b64decode(t) for t, n in map(bytes.split, f)}
    return [ranks[i] for i in range(len(ranks))]


def model_proto(tokens: list[bytes]) -> bytes:
    """A serialized sentencepiece BPE model; its last piece, after the tokens, is the unknown one it must have."""
    chars = byte_chars()
    piece = lambda text, score, kind: _bytes(PIECES, _bytes(PIECE, text.encode()) + _score(score) + _number(TYPE, kind))
    out = [piece("".join(chars[b] for b in t), -float(rank), NORMAL) for rank, t in enumerate(tokens)]
    out.append(piece("<unk>", 0.0, UNKNOWN))
    out.append(_bytes(TRAINER, _number(MODEL_TYPE, BPE) + _number(VOCAB_SIZE, len(tokens) + 1) + _number(UNK_ID, len(tokens)) + b"".join(_number(x, -1) for x in (BOS_ID, EOS_ID, PAD_ID))))
    out.append(_bytes(NORMALIZER, _bytes(NAME, b"identity") + b"".join(_number(x, 0) for x in (DUMMY_PREFIX, EXTRA_SPACES, ESCAPE_SPACES))))
    return b"".join(out)


class Codec:
    """Encodes texts to ids, each pre-token by itself, and decodes ids to bytes."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        self.rank = {t: i for i, t in enumerate(self.tokens)}
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.tokens))
        self.split = regex.compile(pattern).findall
        self.chars = {i: c for i, c in byte_chars().items()}
        self.table = np.array([*self.tokens], object)
        self.dtype = "<u2" if len(self.tokens) <= 1 << 16 else "<u4"
        self.words = WordCache(self._encode, lambda words: self._encode([" " + w for w in words]), self.dtype, KEPT_WORDS)

    def _encode(self, texts: list[str]) -> list[bytes]:
        parts = [[p.encode() for p in self.split(t)] for t in texts]
        whole = self.rank
        rest = list({p for ps in parts for p in ps if p not in whole})
        coded = {}
        for i in range(0, len(rest), 4096):
            mapped = [p.decode("latin-1").translate(self.chars) for p in rest[i : i + 4096]]
            coded.update(zip(rest[i : i + 4096], self.processor.encode(mapped, num_threads=1), strict=True))
        return [np.array([i for p in ps for i in ([whole[p]] if p in whole else coded[p])], self.dtype).tobytes() for ps in parts]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and the places where each text's begin and end."""
        return self.words.encode(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.table[ids].tolist())


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a worker, kept from task to task."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (little-endian uint32) of each row of docs, without a shuffle.

    A null text is an empty one and has no ids. Rows and ids may repeat. Other columns are not read.
    """
    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in releasing(rows):
            texts = batch.column(1)
            for a, b in batches(texts, BATCH):
                ids, bounds = c.encode(texts[a:b])
                out = [ids[x:y].astype("<u4").tobytes() for x, y in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(out, pa.binary())], names=["doc_id", "ids"])

    return in_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), encode, "doc_id long, ids binary", SMALL_BATCH_BYTES)


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and decoded, the bytes that the ids stand for."""
    def decode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in rows:
            out = [c.decode(np.frombuffer(x, "<u4")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    return in_arrow(encoded.select("doc_id", "ids"), decode, "doc_id long, ids binary, decoded binary", SMALL_BATCH_BYTES)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 of the ids in decimals, joined by commas, and decoded_sha256 of what they decode to.

    Encoding and decoding as in encode_documents and decode_documents, in one Python worker a task, BATCH bytes of text at a time.
    """
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        decimals = np.array([str(i).encode() for i in range(len(c.tokens))], object)
        for batch in releasing(rows):
            texts = batch.column(1)
            for a, b in batches(texts, BATCH):
                out = []
                every, bounds = c.encode(texts[a:b])
                for x, y in zip(bounds, bounds[1:], strict=False):
                    ids = every[x:y]
                    out.append((len(ids), hashlib.sha256(b",".join(decimals[ids].tolist())).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
                n, coded, decoded = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(coded), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return in_arrow(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", SMALL_BATCH_BYTES)


def encoded_digests(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
