"""Byte-pair encoding of many texts in one task, each distinct word once.

A byte-level BPE splits a text into pre-tokens before it merges, and the split never reaches over a place
where a single space follows a non-space and precedes another: there a new pre-token begins with that space.
So a text encodes to the concatenation of what its space-separated words encode to, and words repeat. Texts
with a run of white space at a space are encoded whole, by the same library call.

Arrow splits a batch of texts and numbers its distinct words; only these are looked up or encoded, and numpy puts
the ids of all occurrences in their places.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A worker keeps the codes of so many words at most, unless told otherwise, and of none that is longer.
WORDS, LONGEST = 200_000, 64
#: Punctuation after a letter or digit is a pre-token of its own, so words need not be kept with it.
STOPS = ".,;:!?"
#: Bytes of text that are encoded at once.
BATCH = 1 << 21


def batches(texts: list[str] | pa.Array, size: int = 1 << 20):
    """Index ranges of texts with about so many characters (bytes of an Arrow array) each, one text at least."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).tolist() if isinstance(texts, pa.Array) else map(len, texts)
    start, held, i = 0, 0, -1
    for i, n in enumerate(lengths):
        if held and held + n > size:
            yield start, i
            start, held = i, 0
        held += n
    if start <= i:
        yield start, i + 1


def gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of data[start : start + length]."""
    at = np.cumsum(lengths) - lengths
    return data[np.repeat(starts - at, lengths) + np.arange(int(lengths.sum()))]


#: First bytes of white space in UTF-8: of one byte, and of several.
SPACE, WIDE_SPACE = 0x20, (0xC2, 0xE1, 0xE2, 0xE3)


def unsafe_words(words: pa.Array, as_text: list[str]) -> np.ndarray:
    """Which words are empty or begin with white space: splitting before these is not exact."""
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join([words.buffers()[2] or b"", b"\0"]), np.uint8)
    first = data[np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words)]]
    out = (lengths == 0) | (first <= SPACE)
    for i in np.flatnonzero(np.isin(first, WIDE_SPACE) & ~out).tolist():
        out[i] = as_text[i][0].isspace()
    return out


class WordCache:
    """Encodes texts to ids of a numpy type.

    encode_texts gives the ids of texts, as bytes; encode_words those of words that each stand after a space, without it.
    When the cache is full, the words of the last batch stay: frequent ones are among them.
    """

    def __init__(self, encode_texts: Callable[[list[str]], list[bytes]], encode_words: Callable[[list[str]], list[bytes]], dtype: str, most: int | None = None):
        self.encode_texts, self.encode_words, self.dtype, self.most = encode_texts, encode_words, np.dtype(dtype), most or WORDS
        self.later: dict[str, bytes] = {}  # of words after a space
        self.tails: dict[str, bytes] = {}  # of punctuation after a word

    def _learn(self, words: list[str]) -> None:
        """Adds the codes of distinct words to the cache."""
        known, cores, parts = self.later, [], []
        for w in words:
            core = w.rstrip(STOPS)
            if core != w and core and core[-1].isalnum():
                cores.append((w, core))
            else:
                parts.append(w)
        parts = list({*parts, *(c for _, c in cores if c not in known)})
        known.update(zip(parts, self.encode_words(parts), strict=True))
        tails = {w[len(c) :] for w, c in cores}
        if len(self.tails) > self.most // 100:
            self.tails = {}
        new = list(tails.difference(self.tails))
        self.tails.update(zip(new, self.encode_texts(new), strict=True))
        tails = self.tails
        known.update([(w, known[c] + tails[w[len(c) :]]) for w, c in cores])

    def codes(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words that stand after a space, as bytes."""
        out = list(map(self.later.get, words))
        missing = [i for i, code in enumerate(out) if code is None]
        if missing:
            new = [words[i] for i in missing]
            self._learn(new)
            for i, w in zip(missing, new, strict=True):
                out[i] = self.later[w]
            if max(map(len, new)) > LONGEST:
                for w in new:
                    if len(w) > LONGEST:
                        self.later.pop(w, None)
                        self.later.pop(w.rstrip(STOPS), None)
        if len(self.later) > self.most:
            self.later = {w: c for w, c in zip(words, out, strict=True) if len(w) <= LONGEST} if len(words) < self.most else {}
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's begin and end: one number more than texts."""
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(1, np.int64)
        split = pc.split_pattern(texts, " ")
        pieces, bounds = split.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]).astype(np.int64)
        heads = bounds[:-1]
        numbered = pieces.dictionary_encode()
        word = numbered.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        distinct = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        is_head = np.zeros(len(word), bool)
        is_head[heads] = True
        # Splitting at single spaces is exact unless white space, or the end, follows a space.
        whole = np.add.reduceat(unsafe_words(numbered.dictionary, distinct)[word] & ~is_head, heads) > 0
        use = ~is_head & ~np.repeat(whole, np.diff(bounds))
        wanted = np.zeros(len(distinct), bool)
        wanted[word[use]] = True
        wanted = np.flatnonzero(wanted)
        codes = self.codes([distinct[i] for i in wanted.tolist()])
        first = texts.take(pa.array(np.flatnonzero(whole))).to_pylist(), pieces.take(pa.array(heads[~whole])).to_pylist()
        codes += self.encode_texts([*first[0], *first[1]])
        # Occurrences in the order of the texts: all words of a text, or the text as one.
        which = np.zeros(len(distinct), np.int64)
        which[wanted] = np.arange(len(wanted))
        code = which[word]
        code[heads[whole]] = len(wanted) + np.arange(len(first[0]))
        code[heads[~whole]] = len(wanted) + len(first[0]) + np.arange(len(first[1]))
        stays = use | is_head
        code = code[stays]
        text = np.repeat(np.arange(len(texts)), np.diff(bounds))[stays]
        lengths = np.fromiter(map(len, codes), np.int64, len(codes)) // self.dtype.itemsize
        data = np.frombuffer(b"".join(codes), self.dtype)
        n = lengths[code]
        ids = gathered(data, (np.cumsum(lengths) - lengths)[code], n)
        return ids, np.concatenate([[0], np.cumsum(np.bincount(text, n, len(texts)).astype(np.int64))])
