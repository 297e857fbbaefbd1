"""Fill-in-the-middle, nearest neighbours and spelling variants, against plain versions and on odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from helpers import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.llm import fill_middle, forest, spelling

# Fill-in-the-middle.


def plain_example(doc_id, text, unit="line", seed=7):
    units = re.findall(fill_middle.UNITS[unit].match, text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(s in text for s in fill_middle.SENTINELS):
        return n, "plain", text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (n, "spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else (n, "psm", f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("unit", sorted(fill_middle.UNITS))
def test_examples_are_the_plain_ones(spark, unit):
    rng = random.Random(8)
    texts = ["", None, "\n", "a", "a\nb", "a\r\nb\n\n", " \t x  y\n", "<P", "P>", "<<P>", "x<M>y", "🙂🙃\né 漢\n", "\U0001d400 \U0001d401", "w " * 5000]
    texts += ["".join(rng.choice("ab \n\t<PSM>é🙂") for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = [(None if i % 50 == 7 else i // 2, t) for i, t in enumerate(texts)]
    got = fill_middle.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), unit).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    want = [(d, *plain_example(d, t or "", unit), t or "") for d, t in rows]
    assert sorted(map(str, ((r.doc_id, r.n, r.form, r.output, r.back) for r in got))) == sorted(map(str, want))
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_rates_and_sentinels(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc\n").alias("text"))
    forms = {r.form: r["count"] for r in fill_middle.fill_in_middle(docs, rate=0.25, spm_rate=0.0).groupBy("form").count().collect()}
    assert set(forms) == {"plain", "psm"} and 50 < forms["psm"] < 150
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>"), ("ab", "bc", "<M>"), ("<P>x", "<P>", "<M>")):
        with pytest.raises(ValueError):
            fill_middle.fill_in_middle(docs, sentinels=bad)


def test_fill_in_middle_on_odd_rows(spark, odd, empty):
    got = fill_middle.fill_in_middle(odd).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(r.back for r in got) == sorted(r.text or "" for r in odd.collect())
    assert fill_middle.fill_in_middle(empty).count() == 0


# Nearest neighbours.


def brute(rows, k, chosen):
    """{query: [(id, score)]} over (id, vector) rows, each id once, ties to the smaller id."""
    usable = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable[i] = min(usable.get(i, v), v)
    ids, dim = sorted(usable), max(map(len, usable.values()), default=0)
    x = np.array([list(usable[i]) + [0.0] * (dim - len(usable[i])) for i in ids])
    out = {}
    for q in filter(chosen, ids):
        s = (x * x[ids.index(q)]).sum(1)
        out[q] = [(ids[j], s[j]) for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
    return out


def found(spark, rows, k=5, kind="double"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    out = {}
    for r in forest.Forest(forest.rows_of(df)).search(F.col("vec_id") % 20 == 0, k).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_odd_vectors(spark):
    """Null, empty, zero and not finite vectors take no part; repeated ids, shorter vectors, copies and exact ties have their place."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.integers(-2, 3, 4)]) for i in range(90)]
    rows += [(100, None), (120, []), (140, [0.0, 0.0]), (160, [1.0, None]), (180, [float("nan"), 1.0]), (200, [float("inf"), 1.0]), (None, [1.0, 1.0]), (40, [9.0, 9.0, 9.0, 9.0]), (220, [1.0, 2.0]), (240, [-0.0, 0.0])]
    rows += [(300 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(60)]
    got, want = found(spark, rows), brute(rows, 5, lambda i: i % 20 == 0)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12) for q in want)
    assert found(spark, []) == {} and found(spark, [(20, [1.0])]) == {} and found(spark, [(20, [1.0]), (21, [2.0])]) == {20: [(21, 2.0)]}


def test_recall_through_blocks_and_packs(spark, monkeypatch):
    """Clustered vectors of very different lengths: at least 0.9 of the true neighbours, whatever the size of blocks and packs."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 24))
    x = (centres[rng.integers(0, 40, 3000)] + 0.3 * rng.standard_normal((3000, 24))) * rng.uniform(0.5, 2, (3000, 1))
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).astype(float).tolist())]
    monkeypatch.setattr(forest, "BLOCK_BYTES", 1 << 13)
    monkeypatch.setattr(forest, "PACK", 16)
    got, want = found(spark, rows, 10, "float"), brute(rows, 10, lambda i: i % 20 == 0)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9


def test_nearest_query_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    want, got = brute(rows, 20, lambda i: i % 20 == 0), {}
    for r in forest.op12_nearest(spark, DATA).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


# Spelling variants.


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


WORDS = st.lists(st.text(alphabet="abé", min_size=1, max_size=6), unique=True, max_size=40)


@settings(deadline=None, max_examples=200)
@given(WORDS, st.text(alphabet="abé", min_size=1, max_size=7))
def test_automata_accept_all_near_words(words, query):
    for longer in (-1, 0, 1):
        held = sorted(w for w in words if len(w) == len(query) + longer)
        if held:
            trie = spelling.Trie(spelling.Trie.parts(held, list(range(1, len(held) + 1))))
            got = trie.near(query, longer)
            assert sorted(map(trie.word, got)) == [w for w in held if one_apart(w, query)]
            assert all(trie.n[x] == held.index(trie.word(x)) + 1 for x in got)


def plain_variants(counts, least=2, factor=10):
    words = {w: n for w, n in counts.items() if n >= least}
    form, near = {}, {}
    for w in words:
        beside = [v for v in words if one_apart(v, w)]
        near[w] = len(beside)
        best = min(beside, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= factor * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), words[w], near[w], words.get(form[w])) for w in words}


@pytest.mark.parametrize("sizes", [(spelling.SHARD_BYTES, spelling.LOAD), (40, 400)])
def test_variants_are_the_plain_ones(spark, sizes):
    """Chains of forms, ties, and words of a thousand neighbours, in one shard a length or in many."""
    rng = random.Random(3)
    counts = {"".join(rng.choice("abcé") for _ in range(rng.randrange(1, 6))): rng.choice([1, 2, 3, 20, 30, 400, 5000]) for _ in range(250)}
    counts |= {"abcdefg": 3, "abcdefh": 40, "abcdeih": 600, "abcdeihj": 9000, "zzzzzzz": 5, "zzzzzzy": 50, "zzzzzzx": 50, "a" * 3000: 2, "a" * 3001: 30}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(df, shard_bytes=sizes[0], load=sizes[1]).collect()}
    assert got == plain_variants(counts) and got["abcdefg"][1] == "abcdeihj" and got["zzzzzzz"][0] == "zzzzzzx"


def test_words_of_odd_rows(spark, odd, empty):
    want, letters = {}, re.compile("[A-Za-zÀ-ÿ]+")
    for r in odd.collect():
        for run in letters.findall(r.text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w
            if len(w) >= 7:
                want[w] = want.get(w, 0) + 1
    more = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(i, "Straßenbahn ÉCOLES×÷ naïvely, ABCDEFGHIJ") for i in range(100)], "doc_id long, text string"))
    assert {r.word: r.n for r in spelling.word_counts(odd).collect()} == want
    assert {"straßenbahn", "ÉcolesX÷".replace("X", "×"), "naïvely", "abcdefghij"} <= {r.word for r in spelling.word_counts(more).collect()}
    assert spelling.spelling_variants(spelling.word_counts(empty)).count() == 0
