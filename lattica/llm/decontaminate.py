"""Benchmark decontamination by winnowing, by DataFrame functions alone.

A fingerprint is the least hash of K consecutive words in a window of W such hashes. Whatever span of W + K - 1 = 13
words two texts share, its window has the same least hash in both, so both have that fingerprint there: no shared
span can be missed. Documents' fingerprints are joined with those of the items; each hit is extended to the spans of 13 words
around it, and these are held against the items' spans word by word, so no hash decides. Equal spans are one, however often a text
repeats them: the work goes with the words of a text, not with the ways in which two texts can be aligned. Hits stay rows, of a
document and a span or an item: a document's own row only gathers the windows in it and the numbers of its items.

An item of fewer than 13 words is one window of its own length L, and its fingerprint the hash of these L words;
documents give their L-word hashes for the lengths that occur among the items, at most 12.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import ROW, materialize, sized, table, text_or_empty, with_row

SPAN, K = 13, 6
W = SPAN - K + 1
#: What parts words: ASCII that is neither digit nor lower-case letter.
PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased. lower() does that for ASCII texts, quickly; others take translate()."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.array_remove(F.split(F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), PARTS), "")


def with_grams(df: DataFrame, lengths: list[int]) -> DataFrame:
    """df, with a column `words`, and g1, g2, ...: an array for each length, at i the hash of so many words from i on.

    A hash of a + b words is that of a, shifted by b bits, xor that of the b after them, so lengths are put together
    from halves. The last places, where words are missing, are null. Each step is a projection of its own: an array
    that several expressions read would otherwise be made anew in each.
    """
    df = df.withColumn("g1", F.transform("words", lambda w: F.xxhash64(w)))
    made = {1}

    def make(df: DataFrame, k: int) -> DataFrame:
        if k in made:
            return df
        a = 1 << ((k - 1).bit_length() - 1)
        df = make(make(df, a), k - a)
        made.add(k)
        later = F.slice(f"g{k - a}", a + 1, F.greatest(F.size("words") - a, F.lit(0)))
        return df.withColumn(f"g{k}", F.zip_with(f"g{a}", later, lambda x, y: F.shiftleft(x, k - a).bitwiseXOR(y)))

    for k in lengths:
        df = make(df, k)
    return df


def fingerprints(df: DataFrame, keep: list[str], short: list[int]) -> DataFrame:
    """df, with a column `words`, as a row for each distinct fingerprint (l, h) of a row; keep names further columns.

    l is the span that the fingerprint stands for: SPAN, or a short length. Of W hashes of K words the least counts.
    """
    df = with_grams(df, [K, *short]).withColumn("low", F.col(f"g{K}"))
    for step in (1, 2, 4):  # windows of 2, 4 and 8 = W
        df = df.withColumn("low", F.zip_with("low", F.slice("low", step + 1, F.greatest(F.size("words") - step, F.lit(0))), lambda x, y: F.least(x, y)))

    def distinct(column: str, span: int) -> Column:
        marks = F.array_distinct(F.slice(column, 1, F.greatest(F.size("words") - (span - 1), F.lit(0))))
        return F.transform(marks, lambda h: F.struct(F.lit(span).alias("l"), h.alias("h")))

    found = F.concat(distinct("low", SPAN), *(distinct(f"g{n}", n) for n in short))
    return df.select(*keep, F.explode(found).alias("f")).select(*keep, "f.l", "f.h")


def places(span: int, wanted: Column) -> Column:
    """The positions, from 1, of the hashes of that span's fingerprints that are among the wanted ones."""
    found = F.transform(f"g{K if span == SPAN else span}", lambda h, i: F.when(F.array_contains(wanted, h), i + 1))
    return F.array_compact(found)


def spans(found: Column, span: int) -> Column:
    """(start, span, window) of the spans around fingerprints at such places; the window is its words, parted by spaces."""
    last = F.size("words") - span + 1

    def around(at: Column) -> Column:
        low, high = (F.greatest(F.lit(1), at - (W - 1)), F.least(at, last)) if span == SPAN else (at, at)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    starts = F.array_distinct(F.flatten(F.transform(found, around)))
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(span).alias("span"), F.array_join(F.slice("words", i, span), " ").alias("window")))


def prepared(items: DataFrame, item_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame, list[int]]:
    """The distinct windows of items (window, item_id), their fingerprints (l, h), short lengths."""
    items = items.select(F.col(item_col).cast("string").alias("item_id"), words_of(text_or_empty(item_text_col)).alias("words")).distinct()
    items = items.where(F.size("words") > 0).withColumn("span", F.least(F.size("words"), F.lit(SPAN)))
    items = materialize(items, "items")
    short = sorted(r.span for r in items.where(F.col("span") < SPAN).select("span").distinct().collect())  # 12 at most
    marks = materialize(fingerprints(items, ["span"], short).where("l = span").select("l", "h").distinct(), "item-marks")
    starts = F.sequence(F.lit(1), F.size("words") - F.col("span") + 1)
    windows = items.select("item_id", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, F.col("span")), " "))).alias("window"))
    return materialize(windows.distinct(), "item-windows"), marks, short


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", part: float = 20.0, row_col: str | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, n_items, item_ids (strings, sorted), contaminated.

    A null text has no words. Items without words hit nothing; items of one id count as one, each text matched for
    itself. A document is contaminated if a word is hit and part * n_hit >= n_words. Rows that repeat an id stay rows;
    each is matched with its own words. Where docs has a unique key of rows, row_col
    names it, and it is the column ROW of the result. Other columns are not read. Without documents the result is empty, without
    items all are clean.
    """
    columns = F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")
    texts = docs.select(F.col(row_col).alias(ROW), *columns) if row_col else with_row(docs, *columns)
    windows, marks, short = prepared(items, item_col, item_text_col)
    # Documents that have an item's fingerprint, with these: no more than a document has.
    found = fingerprints(texts.select(ROW, words_of(F.col("text")).alias("words")), [ROW], short)
    hits = materialize(found.join(sized(marks), ["l", "h"]).groupBy(ROW).agg(F.collect_set("h").alias("hs")), "hit-fingerprints")
    near = texts.join(sized(hits, size=F.size("hs")), ROW).select(ROW, "hs", words_of(F.col("text")).alias("words"))
    near = with_grams(near, [K, *short]).select(ROW, "words", *(places(n, F.col("hs")).alias(f"at{n}") for n in (*short, SPAN)))
    near = near.select(ROW, F.explode(F.concat(*(spans(F.col(f"at{n}"), n) for n in (*short, SPAN)))).alias("s")).select(ROW, "s.*")
    # A row for each place of a window that an item has, then for each item that has one.
    known = windows.select("window").distinct()
    verified = materialize(near.join(sized(known), "window", "left_semi"), "hit-windows")
    named = verified.select(ROW, "window").distinct().join(sized(windows), "window").select(ROW, "item_id").distinct()
    named = named.groupBy(ROW).agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    covered = verified.groupBy(ROW).agg(F.array_sort(F.collect_set(F.struct("start", "span"))).alias("windows"))
    hit = named.join(covered, ROW)

    def further(state: Column, window: Column) -> Column:
        """Words in windows so far, and the word after them, with the next window in order of starts."""
        end = window["start"] + window["span"]
        return F.struct((state["n"] + F.greatest(F.lit(0), end - F.greatest(window["start"], state["end"]))).alias("n"), F.greatest(state["end"], end).alias("end"))

    covered = F.aggregate("windows", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), further, lambda state: state["n"])
    hit = materialize(hit.select(ROW, "item_ids", covered.alias("n_hit")), "hits")
    counted = texts.select(ROW, "doc_id", F.size(words_of(F.col("text"))).cast("long").alias("n_words")).join(sized(hit, size=F.size("item_ids")), ROW, "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    out = counted.select(*([ROW] if row_col else []), "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * part >= F.col("n_words")))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"), "contaminated")


_SQL_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), '" + UPPER + "', '" + LOWER + r"'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP6_SQL = f"""
WITH i AS (SELECT item_id::VARCHAR AS item_id, {_SQL_WORDS} AS w FROM benchmark),
s AS (SELECT *, least(len(w), {SPAN}) AS n FROM i WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[j : j + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS j FROM s)),
d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
l AS (SELECT DISTINCT n FROM s),
dg AS (SELECT doc_id, n, j, array_to_string(w[j : j + n - 1], ' ') AS gram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS j FROM d, l)),
h AS (SELECT doc_id, item_id, j, n FROM dg JOIN g USING (n, gram)),
c AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(j, j + n)) FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(d.w), false) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
