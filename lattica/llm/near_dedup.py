"""Near-duplicate classes: BagMinHash signatures of word shingles, banded, and verified on the multisets.

A document is the multiset of its runs of SHINGLE words. Every shingle has Poisson processes over its weight axis, one
for each of the dyadic stretches [0,1), [1,2), [2,4), ... of discretised weights; a point has a time, a weight level and a
signature slot, and counts if the level lies below the shingle's number of occurrences. A slot keeps its earliest point, so two
documents agree in a slot with the probability of their weighted Jaccard similarity. A stretch is generated in
order of time and left once its next point comes after the latest slot's, so a shingle mostly costs one point, and a
repeated one the logarithm of its count.

Classes are the components of the links with similarity THRESHOLD or more. Texts that share a band are candidates, but
pairs are not formed within bands: (1) equal texts are one node; (2) each node is held against the least node of its
band, which joins what is close; (3) only nodes that are still outside the main component of a band are held against
its members of other components, if sizes and 4-bit signatures allow the similarity (ALLOWED lies five standard errors off).
Bands of up to FEW members make pairs for that; in larger ones the outsiders are dealt to blocks of BLOCK shingles, and the main
component's members to others, which meet the blocks of outsiders only: where outsiders are few, each member is sent to one group.
Only links leave a task, so that a large group of texts that are not quite similar makes no pairs. So every link of two nodes that share a band ends within one component. A pair at the threshold shares no band with
probability (1 - 0.8**6)**42 = 3e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.bpe_words import batches
from lattica.llm.common import ROW, SMALL_BATCH_BYTES, in_arrow, join_hot, materialize, sized, text_or_empty, with_row
from lattica.llm.components import connected_components
from lattica.llm.word_hash import joined, mix, range_hashes, ranges

SHINGLE = 5
#: The similarity 0.8 as 4/5: inter / union >= 4/5 is 9 * inter >= 4 * (a + b).
THRESHOLD = 0.8
BANDS, ROWS = 42, 6
SLOTS = BANDS * ROWS
#: Of 252 slots at the threshold, 0.2 * 15/16 differ in 4 bits: 47.25, with a standard error of 6.2.
ALLOWED = 79
FEW, BLOCK = 32, 400_000
#: Pairs with one and the same second text that are joined in one task.
SAME = 10_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_LATE = np.int64(1) << np.int64(62)
_POINTS = 200_000


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, shingle hash and occurrences of the distinct shingles of each text, sorted by both.

    Words are what ASCII white space parts. A text of fewer words than SHINGLE, but not none, is one shingle.
    """
    data, starts = joined(texts)
    a, b = ranges(data > 32)
    words, text = range_hashes(data, a, b), np.searchsorted(starts, a, side="right") - 1
    n = np.bincount(text, minlength=len(texts))
    # Texts of 1 to SHINGLE - 1 words are filled up with zero words, which no hash of a word is expected to be.
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    fill = np.repeat(short, SHINGLE - n[short])
    order = np.argsort(np.concatenate([text, fill]), kind="stable")
    text, words = np.concatenate([text, fill])[order], np.concatenate([words, np.zeros(len(fill), np.uint64)])[order]
    k = max(0, len(words) - SHINGLE + 1)
    h = np.zeros(k, np.uint64)
    for i in range(SHINGLE):
        h = h * _GOLDEN + words[i : i + k]
    whole = text[:k] == text[SHINGLE - 1 :] if k else np.zeros(0, bool)
    text, h = text[:k][whole], mix(h[whole])
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    return text[first], h[first], np.diff(np.append(first, len(h)))


def signatures(texts: int, text: np.ndarray, h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The earliest times (int64) in the SLOTS slots of each text."""
    slots = np.full(texts * SLOTS, _LATE, np.int64)
    latest = np.full(texts, _LATE, np.int64)
    stretches = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64), 0) + 1
    of = np.repeat(np.arange(len(h)), stretches)
    level = np.arange(len(of)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
    shift = np.maximum(level - 1, 0)  # the stretch starts at 2**shift, or 0, and is 2**shift wide
    base = np.where(level > 0, np.int64(1) << shift, 0)
    seed = mix(h[of] + level.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    owner, most, time = text[of], count[of], np.zeros(len(of), np.int64)
    step = 0
    while len(owner):
        t = int(min(64, max(1, _POINTS // len(owner))))
        r = mix(seed[:, None] + np.arange(step + 1, step + t + 1, dtype=np.uint64)[None, :] * _GOLDEN)
        gap = (-np.log(((r >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) * 2.0**36).astype(np.int64) >> shift[:, None]
        at = time[:, None] + np.cumsum(gap, axis=1)
        early = at < latest[owner][:, None]
        row, _ = np.nonzero(early)
        when, r = at[early], mix(r[early] ^ np.uint64(0xA0761D6478BD642F))
        slot = ((r >> np.uint64(32)) * np.uint64(SLOTS) >> np.uint64(32)).astype(np.int64)
        high = base[row] + (((r & np.uint64(0xFFFFFFFF)).astype(np.int64) << shift[row]) >> np.int64(32))
        ok = high < most[row]
        np.minimum.at(slots, owner[row[ok]] * SLOTS + slot[ok], when[ok])
        latest = slots.reshape(texts, SLOTS).max(axis=1)
        time, step = at[:, -1], step + t
        left = time < latest[owner]
        owner, most, time, seed, shift, base = (x[left] for x in (owner, most, time, seed, shift, base))
    return slots.reshape(texts, SLOTS)


def banded(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (BANDS of them) and the 4-bit signature (16 numbers) of each row of slots."""
    bits = mix(slots.view(np.uint64) + np.arange(SLOTS, dtype=np.uint64) * _GOLDEN)
    keys = np.zeros((len(slots), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        keys = mix(keys * _GOLDEN + bits[:, i::ROWS])
    nibbles = np.zeros((len(slots), 256), np.uint64)
    nibbles[:, :SLOTS] = bits >> np.uint64(60)
    packed = np.zeros((len(slots), 16), np.uint64)
    for i in range(16):
        packed |= nibbles[:, i::16] << np.uint64(4 * i)
    return keys.view(np.int64), packed.view(np.int64)


def sign(docs: DataFrame) -> DataFrame:
    """id, doc_id, h (MD5 of the text), n (shingles with repetition), bands and f (4-bit signature) of rows (id, text, doc_id).

    Texts without a word have no bands.
    """
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = batch.column(1).to_pylist()
            for a, b in batches(texts):
                part = texts[a:b]
                text, h, count = shingles(part)
                n = np.bincount(text, count, b - a).astype(np.int32)
                some = np.flatnonzero(n)
                keys, f = banded(signatures(len(some), np.searchsorted(some, text), h, count))
                ends = np.concatenate([[0], np.cumsum(n > 0)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([hashlib.md5(t.encode()).digest() for t in part], pa.binary()), pa.array(n),
                    pa.ListArray.from_arrays(pa.array(ends * BANDS), pa.array(keys.ravel())), pa.ListArray.from_arrays(pa.array(ends * 16), pa.array(f.ravel()))], names=["id", "doc_id", "h", "n", "bands", "f"])

    return in_arrow(docs, run, "id long, doc_id long, h binary, n int, bands array<long>, f array<long>", SMALL_BATCH_BYTES)


def bags(docs: DataFrame) -> DataFrame:
    """id and bag: the multiset of shingles as distinct hashes of a shingle and the number of its occurrence."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = batch.column(1).to_pylist()
            for a, b in batches(texts):
                text, h, count = shingles(texts[a:b])
                of = np.repeat(np.arange(len(h)), count)
                nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                ends = np.concatenate([[0], np.cumsum(np.bincount(text, count, b - a))]).astype(np.int32)
                values = mix(h[of] + nth.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["id", "bag"])

    return in_arrow(docs, run, "id long, bag array<long>", SMALL_BATCH_BYTES)


def differing(f: Column, g: Column) -> Column:
    """Slots in which 4-bit signatures differ."""
    def one(i: int) -> Column:
        x = f[i].bitwiseXOR(g[i])
        for s in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, s))
        return F.bit_count(x.bitwiseAND(0x1111111111111111))

    return sum((one(i) for i in range(1, 16)), one(0))


def may_link(a: str, b: str) -> Column:
    """Whether sizes and 4-bit signatures of aliases a and b allow the threshold."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (5 * n >= 4 * m) & (5 * m >= 4 * n) & (differing(F.col(f"{a}.f"), F.col(f"{b}.f")) <= ALLOWED)


def verified(pairs: DataFrame, bag_of: DataFrame) -> DataFrame:
    """The pairs (a, b) whose multisets reach the threshold.

    b may be the lead of very many: such a text's bag is joined as several, each for SAME pairs.
    """
    pairs = materialize(pairs, "pairs")
    parts = materialize(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SAME).cast("int").alias("parts")), "pair-counts")
    several = parts.where("parts > 1")
    dealt = pairs.join(sized(several), "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    bag_b = bag_of.join(sized(parts), F.col("id") == F.col("b")).select("b", F.col("bag").alias("bag_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    both = dealt.join(bag_of.select(F.col("id").alias("a"), F.col("bag").alias("bag_a")), "a").join(bag_b, ["b", "part"])
    return both.where(9 * F.size(F.array_intersect("bag_a", "bag_b")) >= 4 * (F.size("bag_a") + F.size("bag_b"))).select("a", "b")


def block_links(ids: np.ndarray, comp: np.ndarray, main: int, block: np.ndarray, n: np.ndarray, f: np.ndarray, bags_: list[np.ndarray]) -> list[tuple[int, int]]:
    """The links between different components that an outsider of the band's main one has; of two blocks, those across."""
    of = np.repeat(np.arange(len(ids)), n)
    shingle = np.unique(np.concatenate(bags_), return_inverse=True)[1]
    at = np.cumsum(n) - n
    two, mask = block.min() != block.max(), np.int64(0x1111111111111111)
    out, held = [], np.zeros(len(shingle), bool)
    for a in np.flatnonzero(comp != main):
        near = np.flatnonzero((comp != comp[a]) & ((block != block[a]) | (not two)) & (5 * n >= 4 * n[a]) & (5 * n[a] >= 4 * n))
        x = f[near] ^ f[a]
        x |= (x >> np.int64(1)) & np.int64(0x7FFFFFFFFFFFFFFF)
        x |= (x >> np.int64(2)) & np.int64(0x3FFFFFFFFFFFFFFF)
        near = near[np.bitwise_count(x & mask).sum(axis=1) <= ALLOWED]
        if len(near):
            held[shingle[at[a] : at[a] + n[a]]] = True
            both = np.bincount(of[held[shingle]], minlength=len(ids))[near]
            held[:] = False
            out += [(int(ids[a]), int(ids[b])) for b in near[9 * both >= 4 * (n[a] + n[near])]]
    return out


def links_by_block(placed: DataFrame, marks: DataFrame, bag_of: DataFrame) -> DataFrame:
    """Links (a, b) of rows (band, id, comp, main, and shingles of the band's main component and of the others).

    Each pair of blocks of which one has outsiders is a group, of about 2 * BLOCK shingles, or two texts. Blocks are numbered
    from 0, those of outsiders first.
    """
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    rows = placed.withColumn("outer", F.greatest(F.lit(1), blocks("out_shingles"))).withColumn("inner", F.greatest(F.lit(1), blocks("main_shingles")))
    is_main = F.col("comp") == F.col("main")
    spread = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    block = F.when(is_main, F.col("outer") + spread("inner")).otherwise(spread("outer"))
    others = F.sequence(F.lit(0), F.when(is_main, F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1)
    rows = rows.select("band", "id", "comp", "main", block.alias("block"), F.explode(others).alias("other"))
    rows = rows.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "comp", "main", "block")
    rows = rows.join(marks, "id").join(bag_of, "id")

    def run(group: pa.Table) -> pa.Table:
        col = lambda c: group.column(c).to_numpy()
        f = np.array(group.column("f").to_pylist(), np.int64)
        bags_ = [np.array(x, np.int64) for x in group.column("bag").to_pylist()]
        links = block_links(col("id"), col("comp"), col("main")[0], col("block"), np.array([len(x) for x in bags_], np.int64), f, bags_)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return rows.groupBy("band", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, class_id (the least id of its class) and kept (true for one row of a class, which has that id), a row for each row of docs.

    Equal texts are of one class, empty and null ones among them; texts without words have no other link. Each row is
    compared by its own text, whatever its id: rows of one id may be of several classes, and rows without an id link as others do. A
    class none of whose rows has an id has no number. An empty table gives an empty one. Where docs has a unique key
    that each read gives again, row_col names it, and it is the column ROW of the result. Other columns are not read.
    """
    columns = F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")
    keyed = docs.select(*columns, F.col(row_col).alias(ROW)) if row_col else with_row(docs, *columns)
    rows = keyed.select(F.col(ROW).alias("id"), "text", "doc_id")  # inside, id is the key of the row
    signed = materialize(sign(rows), "signatures")
    # (1) Equal texts: the least key stands for all.
    total = signed.count()
    groups = materialize(signed.groupBy("h").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "copies")
    copies = materialize(join_hot(signed.select("id", "h"), groups, "h", "copies", total).select("id", "rep"), "copy-of")
    nodes = signed.where("n > 0").join(sized(copies.where("id != rep").select("id")), "id", "left_anti")
    # (2) Each node against the least of its band.
    banded_rows = nodes.select("id", F.explode("bands").alias("band"))
    leads = materialize(banded_rows.groupBy("band").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last").select("band", "lead"), "leads")
    members = materialize(banded_rows.join(sized(leads), "band").distinct(), "band-members")
    few = materialize(members.select("id").distinct(), "candidates")
    marks = materialize(nodes.join(sized(few), "id", "left_semi").select("id", "n", "f"), "candidate-marks")
    bag_of = materialize(bags(rows.join(sized(few), "id", "left_semi").select("id", "text")), "bags")
    star = members.where("id != lead").select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct()
    star = star.join(marks.alias("x"), F.col("a") == F.col("x.id")).join(marks.alias("y"), F.col("b") == F.col("y.id")).where(may_link("x", "y")).select("a", "b")
    edges = materialize(verified(star, bag_of), "edges")
    comps = connected_components(edges)
    # (3) What is outside its band's main component against the band's other components.
    placed = members.select("band", "id").join(sized(comps), "id", "left").join(sized(marks.select("id", "n")), "id").select("band", "id", F.coalesce("comp", "id").alias("comp"), "n")
    sizes = materialize(placed.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("shingles")), "band-comps")
    mixed = sizes.groupBy("band").agg(F.max(F.struct("count", "comp", "shingles")).alias("most"), F.count(F.lit(1)).alias("comps"), F.sum("count").alias("size"), F.sum("shingles").alias("shingles")).where("comps > 1")
    mixed = mixed.select("band", F.col("most.comp").alias("main"), "size", F.col("most.shingles").alias("main_shingles"), (F.col("shingles") - F.col("most.shingles")).alias("out_shingles"))
    placed = materialize(placed.drop("n").join(mixed, "band"), "mixed-bands")
    small = placed.where(F.col("size") <= FEW).select("band", "id", "comp", "main").join(marks, "id")
    apart = (F.col("x.comp") != F.col("y.comp")) & ((F.col("y.comp") == F.col("y.main")) | (F.col("x.id") < F.col("y.id")))
    cross = small.where("comp != main").alias("x").join(small.alias("y"), (F.col("x.band") == F.col("y.band")) & apart & may_link("x", "y")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    more = verified(cross.distinct(), bag_of).unionByName(links_by_block(placed.where(F.col("size") > FEW), marks, bag_of))
    more = materialize(more.distinct(), "edges")
    held = comps.where("id != comp").select(F.col("id").alias("a"), F.col("comp").alias("b"))  # a link a node says what all edges say
    comps = connected_components(held.unionByName(more))
    # Classes of nodes, then of their copies, by the least key; then each class's row of the least id.
    class_of_copies = copies.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("comp", "rep").alias("comp"))
    class_of_nodes = comps.join(copies.select("id"), "id", "left_anti").select("id", "comp")
    classes = materialize(class_of_copies.unionByName(class_of_nodes), "classes")
    named = materialize(signed.select("id", "doc_id").join(sized(classes), "id", "left"), "class-members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id"))
    best = named.where("comp is not null").groupBy("comp").agg(first.alias("first"), F.count(F.lit(1)).alias("rows"))
    best = materialize(best.select("comp", F.col("first.doc_id").alias("class_id"), F.col("first.id").alias("kept_id"), "rows"), "class-firsts")
    several = join_hot(named.where("comp is not null"), best, "comp", "rows", total).select("id", "doc_id", "class_id", (F.col("id") == F.col("kept_id")).alias("kept"))
    out = several.unionByName(named.where("comp is null").select("id", "doc_id", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept")))
    return out.select(*([F.col("id").alias(ROW)] if row_col else []), "doc_id", "class_id", "kept")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
