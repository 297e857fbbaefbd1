"""Spelling variants: each word with the words at edit distance one, and the frequent one among them as its form.

Words of one length, in code-point order, are packed into compact tries, shards of bounded bytes. Every word's automaton for distance
one walks every shard depth-first; shards of lengths that are further off than one it leaves at once. What it accepts is only counted,
and the best kept, so a row a word leaves a task, and words with very many neighbours make no pairs. Shards are broadcast in turn,
LOAD bytes of them at once: what a worker holds has a bound, and the number of rounds grows with the vocabulary, each run on all
machines over all words of the lengths that it has.

Why each neighbour is found once: two words at distance one part at one place, after their common beginning. Up to
there the walk follows the word; only where a branch of the trie leaves it is an edit made, and the rest must match.
"""

from __future__ import annotations

import pickle
from array import array
from collections import deque
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import in_arrow, materialize, sized, table

#: A shard has words of so many bytes at most, but for a single word that is longer.
SHARD_BYTES = 1 << 21
#: Bytes of serialized shards that are broadcast at once, but for a single shard that is larger.
LOAD = 1 << 24
#: Words that a task walks through the shards, on average: the walk is work, whatever the words' bytes.
TASK_WORDS = 10_000
LETTERS = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, FACTOR = 7, 2, 10


class Trie:
    """A compact trie of sorted (word, n): the words one after another in `text`, and arrays by node, the children of a node side by side.

    The first letter on the way to a node stands in `first`, the other `size` ones in the text, at the node's first word behind
    the `depth` letters before; its children are kid[node] to kid[node + 1] - 1. `n` is 0 where no word ends. Node 0 is the root, of no letters.
    """

    def __init__(self, parts: tuple[str, str, bytes, bytes, bytes, bytes, bytes]):
        self.first, self.text = parts[:2]
        self.at, self.depth, self.size, self.kid, self.n = (memoryview(x).cast(k) for x, k in zip(parts[2:], "IIIIQ", strict=True))

    @staticmethod
    def parts(words: list[str], counts: list[int]) -> tuple[str, str, bytes, bytes, bytes, bytes, bytes]:
        starts = list(accumulate(map(len, words), initial=0))
        first, at, depths, sizes, kid, n = ["\0"], array("I", [0]), array("I", [0]), array("I", [0]), array("I"), array("Q", [0])
        spans = deque([(0, len(words), 0)])  # the words of a node, and the letters read up to it
        while spans:
            lo, hi, depth = spans.popleft()
            node = len(kid)
            kid.append(len(first))
            if lo < hi and len(words[lo]) == depth:
                n[node], lo = counts[lo], lo + 1
            while lo < hi:
                letter, end = words[lo][depth], lo + 1
                while end < hi and words[end][depth] == letter:
                    end += 1
                a, b, to = words[lo], words[end - 1], depth + 1  # sorted, so what these two share all share
                most = min(len(a), len(b))
                while to < most and a[to] == b[to]:
                    to += 1
                first.append(letter)
                at.append(starts[lo])
                depths.append(depth)
                sizes.append((to if end - lo > 1 else len(a)) - depth - 1)
                n.append(0)
                spans.append((lo, end, depth + 1 + sizes[-1]))
                lo = end
        kid.append(len(first))
        return "".join(first), "".join(words), at.tobytes(), depths.tobytes(), sizes.tobytes(), kid.tobytes(), n.tobytes()

    def word(self, node: int) -> str:
        return self.text[self.at[node] : self.at[node] + self.depth[node] + 1 + self.size[node]]

    def _tail(self, node: int) -> str:
        a = self.at[node] + self.depth[node] + 1
        return self.text[a : a + self.size[node]]

    def _rest(self, node: int, word: str, i: int) -> int:
        """The node where word[i:] ends, read from the end of node's letters; -1 if there is none."""
        find, kid, size, most = self.first.find, self.kid, self.size, len(word)
        while i < most:
            node = find(word[i], kid[node], kid[node + 1])
            if node < 0:
                return -1
            i += 1
            if size[node]:
                if not word.startswith(self._tail(node), i):
                    return -1
                i += size[node]
        return node if i == most and self.n[node] else -1

    def _within(self, node: int, tail: str, word: str, i: int) -> int:
        """The same from within a node's letters, of which `tail` is yet to be read."""
        return self._rest(node, word, i + len(tail)) if word.startswith(tail, i) else -1

    def near(self, word: str, longer: int) -> list[int]:
        """The nodes of the words at distance one that are longer than word by 1, 0 or -1, each once; all of the trie must be so."""
        find, kid, size, n, out, most = self.first.find, self.kid, self.size, self.n, [], len(word)
        node, i = 0, 0  # the automaton before any edit: word[:i] is read, and ends with node's letters
        while True:
            lo, hi = kid[node], kid[node + 1]
            here = word[i : i + 1]
            follow = find(here, lo, hi) if here else -1
            j = i + 1 - longer  # where word goes on behind the edit: a letter put in, one for another, or one left out
            if longer >= 0:
                want = word[j : j + 1]
                for k in range(lo, hi) if here or longer else ():
                    if k == follow:
                        continue
                    if size[k]:
                        x = self._within(k, self._tail(k), word, j)
                    elif want:
                        x = self._rest(k, word, j) if find(want, kid[k], kid[k + 1]) >= 0 else -1
                    else:
                        x = k if n[k] else -1
                    if x >= 0:
                        out.append(x)
            elif i == most - 1:
                if n[node]:
                    out.append(node)
            elif here:
                k = find(word[i + 1], lo, hi)
                if k >= 0 and k != follow and (x := self._within(k, self._tail(k), word, j)) >= 0:
                    out.append(x)
            if follow < 0:
                return out
            i += 1
            if size[follow] and not word.startswith(self._tail(follow), i):  # at the first letter where they differ
                tail = self._tail(follow)
                a, b = 0, min(len(tail), most - i)
                while a < b:  # the longest common beginning
                    mid = (a + b + 1) // 2
                    if word.startswith(tail[:mid], i):
                        a = mid
                    else:
                        b = mid - 1
                at = i + a
                if longer < 0:
                    x = self._within(follow, tail[a:], word, at + 1)
                else:
                    x = self._within(follow, tail[a + 1 :], word, at + 1 - longer) if at < most or longer else -1
                return [*out, x] if x >= 0 else out
            node, i = follow, i + size[follow]


def runs(text: Column, letters: str = LETTERS, least: int = LEAST_LENGTH) -> Column:
    """The maximal runs of letters in a text that have `least` or more; A-Z lower-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"[{letters}]{{{least},}}"), F.lit(0)), lambda w: F.translate(w, UPPER, LOWER))


def deleted(word: Column, key: Column, one_in: int) -> Column:
    """word, or, for one in so many by the CRC-32 of key, word without the letter that this number points to."""
    h = F.crc32(key.cast("binary"))
    at = (h % F.char_length(word)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))).otherwise(word)


def tries(words: DataFrame, shard_bytes: int) -> DataFrame:
    """Shards of words (word, n): rows of a serialized trie, its bytes, and the length of its words; no word is in two."""

    def build(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            data = pickle.dumps(Trie.parts(held, counts), protocol=5)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary()), pa.array([len(data)], pa.int64()), pa.array([len(held[0])], pa.int32())], names=["trie", "bytes", "length"])

        held, counts, size = [], [], 0
        for batch in rows:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (len(word) != len(held[0]) or size + len(word) > shard_bytes):
                    yield made()
                    held, counts, size = [], [], 0
                held.append(word)
                counts.append(n)
                size += len(word)
        if held:
            yield made()

    # Strings of bytes in UTF-8 sort by code points.
    ordered = words.select("word", "n").repartitionByRange(F.char_length("word"), "word").sortWithinPartitions(F.char_length("word"), "word")
    return in_arrow(ordered, build, "trie binary, bytes long, length int")


def _loads(sizes: list[Row], load: int) -> Iterator[list[Row]]:
    """The shards that are broadcast together."""
    held, total = [], 0
    for shard in sizes:
        if held and total + shard.bytes > load:
            yield held
            held, total = [], 0
        held.append(shard)
        total += shard.bytes
    if held:
        yield held


def _walk(shards: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each word, the accepted neighbours in the broadcast shards (length, trie): how many, and the most frequent."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[int, list[Trie]] = {}
        for length, parts in shards.value:
            loaded.setdefault(length, []).append(Trie(parts))
        for batch in rows:
            out = []
            for word in batch.column(0).to_pylist():
                total, best = 0, None
                for longer in (-1, 0, 1):  # a shard of other lengths accepts nothing
                    for trie in loaded.get(len(word) + longer, ()):
                        for node in trie.near(word, longer):
                            total += 1
                            found = (-trie.n[node], trie.word(node))
                            best = found if best is None or found < best else best
                if best:
                    out.append((word, total, -best[0], best[1]))
            if out:
                word, total, n, best = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(total, pa.int64()), pa.array(n, pa.int64()), pa.array(best, pa.string())], names=["word", "n_near", "best_n", "best"])

    return run


def neighbours(words: DataFrame, shard_bytes: int = SHARD_BYTES, load: int = LOAD) -> DataFrame:
    """word, n_near, best_n and best, the near word of largest n (of equals the first in code-point order), of words that have near ones.

    words (word, n) must have each word once. The shards go through the driver one broadcast at a time, never all at once.
    """
    spark = words.sparkSession
    shards = materialize(tries(words, shard_bytes).select(F.monotonically_increasing_id().alias("number"), "*"), "tries")
    sizes = shards.select("number", "bytes", "length").orderBy("length", "number").collect()  # three numbers a shard
    hits, length = None, F.char_length("word")
    for some in _loads(sizes, load):
        held = [(r.length, pickle.loads(r.trie)) for r in shards.where(F.col("number").isin([r.number for r in some])).select("length", "trie").collect()]
        held = spark.sparkContext.broadcast(held)
        asked = words.select("word").where(length.between(some[0].length - 1, some[-1].length + 1))
        asked = asked.repartition(asked.count() // TASK_WORDS + 1, "word")
        found = materialize(in_arrow(asked, _walk(held), "word string, n_near long, best_n long, best string"), "near-words")
        held.destroy()
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return spark.createDataFrame([], "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return hits.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), "b.best")


def roots(forms: DataFrame) -> DataFrame:
    """word and root of (word, form) rows: forms followed to the last, by pointers that double their reach each round.

    A form is FACTOR times as frequent as its word, so there is no cycle and no chain of more than 20; five rounds do.
    """
    to = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = to.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = materialize(to.join(sized(on), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        to = step.select("word", "root")


def spelling_variants(counts: DataFrame, least_count: int = LEAST_COUNT, factor: int = FACTOR, shard_bytes: int = SHARD_BYTES, load: int = LOAD) -> DataFrame:
    """A row for each word of counts (word, n) with least_count occurrences: word, n, n_near, form, form_n, root.

    Near words differ by exactly one inserted, deleted or replaced code point. form is the near word of largest n, if
    that is factor times the word's n or more, else null with form_n; root is the last form on the way from the word, the word
    itself without one. Words are compared as they are, of any length; an empty table gives an empty one.
    """
    words = materialize(counts.where(F.col("n") >= least_count), "words")
    near = neighbours(words, shard_bytes, load)
    out = words.join(near, "word", "left").withColumn("is_form", F.coalesce(F.col("best_n") >= factor * F.col("n"), F.lit(False)))
    out = out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("is_form"), F.col("best")).alias("form"), F.when(F.col("is_form"), F.col("best_n")).alias("form_n"))
    out = materialize(out, "variants")
    last = roots(out.where("form is not null"))
    return out.join(sized(last), "word", "left").withColumn("root", F.coalesce("root", "word"))


def word_counts(docs: DataFrame, one_in: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n over all texts: runs of letters, some of them without one letter (see deleted), of LEAST_LENGTH letters or more.

    A null text has no words. A null id is one of no digits. Rows that repeat an id count each.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    found = docs.select(key.alias("key"), F.explode(runs(F.col(text_col))).alias("run"))
    found = found.select(deleted(F.col("run"), F.concat("key", F.lit(":"), "run"), one_in).alias("word")).where(F.char_length("word") >= LEAST_LENGTH)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(table(spark, sf_dir, "documents"))).select("word", "form", "root", "n", "n_near", "form_n")


#: SQL makes a CRC-32 table, and joins words on what is left without one letter.
OP13_SQL = f"""
WITH RECURSIVE step(i, c, k) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, xor(c >> 1, (c & 1) * 3988292384), k + 1 FROM step WHERE k < 8),
entries AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
run AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}'), lambda w: translate(w, '{UPPER}', '{LOWER}'))) AS w FROM documents),
each AS (SELECT doc_id, w, count(*) AS n FROM run GROUP BY ALL),
hexed AS (SELECT w, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS h FROM each),
hashed AS (SELECT w, n, xor(list_reduce(list_transform(range(1, length(h) + 1, 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM hexed, entries),
made AS (SELECT CASE WHEN h % 31 = 0 THEN left(w, (h % length(w))::INTEGER) || substr(w, (h % length(w))::INTEGER + 2) ELSE w END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
del AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INTEGER AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM del a JOIN del b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM del a JOIN words b ON a.d = b.word UNION SELECT b.word, a.word, a.n FROM del a JOIN words b ON a.d = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word),
v AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN other END AS form, CASE WHEN m >= 10 * w.n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)),
chain(word, root, k) AS (SELECT word, word, 0 FROM v UNION ALL SELECT c.word, v.form, k + 1 FROM chain c JOIN v ON v.word = c.root WHERE v.form IS NOT NULL)
SELECT v.word, v.form, arg_max(chain.root, k) AS root, v.n, v.n_near, v.form_n FROM v JOIN chain USING (word) GROUP BY ALL
"""
