"""What bounds the memory of a worker that encodes."""

import random
import tracemalloc

import public_tokenizers as P
import pyarrow as pa

from lattica.llm import bpe_codec
from lattica.llm.bpe_words import batches


def test_codec_takes_little_memory_at_once():
    """4 MB of texts that are encoded as a whole, as runs of spaces make it, and of words that are all new."""
    codec, r = bpe_codec.Codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), random.Random(5)
    words = ["".join(r.choices("abcdefghij", k=7)) for _ in range(250_000)]
    texts = pa.array([("  " if i % 2 else " ").join(words[i * 500 : i * 500 + 500]) for i in range(500)] * 2)
    tracemalloc.start()
    for a, b in batches(texts, bpe_codec.BATCH):
        codec.encode(texts[a:b])
    peak, kept = tracemalloc.get_traced_memory()[1], len(codec.words.later)
    tracemalloc.stop()
    assert peak < 80e6 and kept <= 100_000
