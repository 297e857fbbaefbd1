"""Operators that SQL can't express against plain versions, exact round trips and held-out rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import plain
import pyarrow as pa
import pytest
from helpers import DATA, table_of
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import bpe_words, near_dedup, queries, toxicity
from lattica.llm.bpe_codec import Codec, op9_bpe_codec
from lattica.llm.chat_format import escape, op3_chat_format, unescape
from lattica.llm.common import scratch
from lattica.llm.components import connected_components
from lattica.llm.decontaminate import contamination
from lattica.llm.near_dedup import near_duplicates, shingles, signatures
from lattica.llm.token_store import op1_token_store, read_store, tokenizer, write_store
from lattica.llm.toxicity import op7_toxicity

TEXTS = st.text(alphabet=st.sampled_from(list("aé \n\t'sdlvrtm123,.$%ß漢 \x1c🙂|<>\r")), max_size=40)


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, duck, name):
    assert table_of(queries.QUERIES[name](spark, DATA).toPandas()) == table_of(duck.sql(queries.ORACLE_SQL[name]).df())


def test_token_store(spark, docs):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))

    def expected(texts):
        start = 0
        for d in sorted(texts):
            ids = [*t.encode(texts[d] or "", add_special_tokens=False).ids, 0]
            yield (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)

    assert sorted(tuple(r) for r in op1_token_store(spark, DATA).collect()) == list(expected(docs))
    # Strings of special tokens in a text become these tokens, wherever they stand.
    special = {1: "a<|endoftext|>b", 2: "<|endoftext|>", 3: "some <|endoftext|> words", 4: "ends <|endoftext|>", 5: "two  <|endoftext|>  spaces", 6: "x, <|endoftext|>. y", 7: None}
    out = scratch(spark, "special-store")
    rows = read_store(write_store(spark.createDataFrame(list(special.items()), "doc_id long, text string"), out, P.path("byte_bpe_50k.json")), out)
    assert sorted((r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in rows.collect()) == list(expected(special))
    assert 50_256 in t.encode(special[3]).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=4))
def test_words_encode_as_texts_do(texts):
    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer

    if not hasattr(test_words_encode_as_texts_do, "held"):
        path = P.path("byte_bpe_multi_50k.tiktoken")
        codec = Codec(path, P.PATTERN)
        whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        whole.encode_special_tokens = True
        test_words_encode_as_texts_do.held = codec, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.rank, special_tokens={}), whole, tokenizer(P.path("byte_bpe_50k.json"), plain=True)
    codec, ranks, whole, words = test_words_encode_as_texts_do.held
    for encode, check in ((codec.encode, ranks.encode_ordinary), (words.encode, lambda t: whole.encode(t, add_special_tokens=False).ids)):
        ids, bounds = encode(pa.array(texts, pa.string()))
        parts = [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        assert [p.tolist() for p in parts] == [check(t) for t in texts]
        if check == ranks.encode_ordinary:
            assert [codec.decode(p) for p in parts] == [t.encode() for t in texts]


def test_full_caches_change_nothing(monkeypatch):
    """Words that a full cache drops, and long ones that it never keeps, are encoded again."""
    import public_tokenizers as P
    import tiktoken

    monkeypatch.setattr(bpe_words, "WORDS", 40)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "le", "x" * 70 + ".", "mot,", "fin."]) + rng.choice("abcdefgh") * rng.randrange(3) + rng.choice(["", ".", "!?", ",;"]) for _ in range(rng.randrange(60))) for _ in range(40)]
    path = P.path("byte_bpe_multi_50k.tiktoken")
    codec = Codec(path, P.PATTERN)
    ranks = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.rank, special_tokens={})
    for i in range(0, 40, 5):
        ids, bounds = codec.encode(pa.array(texts[i : i + 5], pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [ranks.encode_ordinary(t) for t in texts[i : i + 5]]
        assert len(codec.words.later) <= 80


def test_bpe_codec_on_documents(spark, docs):
    """The query's ids of whole documents are those of the rank file's library."""
    import public_tokenizers as P
    import tiktoken

    codec = Codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    ranks = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.rank, special_tokens={})
    want = []
    for d, t in docs.items():
        ids = ranks.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, op9_bpe_codec(spark, DATA).collect())) == sorted(want)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("<|\\>im_ \n")), max_size=30))
def test_escape_is_reversible(text):
    assert unescape(escape(text)) == text and not re.search(r"<\|", escape(text))


def test_chat_format(spark):
    rows = spark.read.parquet(f"{DATA}/conversations.parquet").orderBy("conv_id", "turn").collect()
    got = {r.conv_id: r for r in op3_chat_format(spark, DATA).collect()}
    for conv, turns in itertools.groupby(rows, key=lambda r: r.conv_id):
        turns = list(turns)
        said = "".join(r.text or "" for r in turns if r.role == "assistant")
        all_ = "".join(f"{r.role}\n{r.text or ''}\n" for r in turns)
        assert (got[conv].turns_sha256, got[conv].loss_sha256, got[conv].loss_chars) == (hashlib.sha256(all_.encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest(), len(said))
        assert got[conv].formatted_chars == sum(len(f"<|im_start|>{r.role}\n{escape(r.text or '')}<|im_end|>\n") for r in turns)
    assert got[-1].n_turns == 2 and got[-1].loss_chars == 34


def test_decontaminate(spark):
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "é", "A1"]
    items = [(i, " ".join(random.choices(vocabulary, k=random.choice([1, 2, 3, 7, 12, 13, 14, 25, 40])))) for i in range(12)] + [(20, ""), (21, None), (22, "a " * 30), (3, "w1 w2 w3 w4")]
    docs = [(102, "a " * 500), (102, "a " * 500), (103, "b a a")]
    for d in range(60):
        t = random.choices(vocabulary, k=random.choice([0, 5, 13, 30, 100]))
        for _ in range(random.choice([0, 1, 3])):
            it = (random.choice(items)[1] or "").split()
            a = random.randint(0, max(0, len(it) - 5))
            p = random.randint(0, len(t))
            t[p:p] = it[a : random.randint(a, len(it))]
        docs.append((d, random.choice([" ", ", ", "-"]).join(t)))
    want = []
    for d, t in docs:
        w, hit, ids = plain.words_of(t), set(), set()
        for i, x in items:
            y = plain.words_of(x)
            n = min(13, len(y))
            for j in range(len(w) - n + 1 if n else 0):
                if any(w[j : j + n] == y[k : k + n] for k in range(len(y) - n + 1)):
                    hit |= set(range(j, j + n))
                    ids.add(str(i))
        want.append((d, len(w), len(hit), len(ids), sorted(ids), len(hit) > 0 and 20 * len(hit) >= len(w)))
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in rng.integers(0, 500, 400)]
    texts = [" ".join(base), " ".join(base[:200] * 2 + base[200:]), " ".join(base[:350] + ["q"] * 50), "x y z " * 300, "x y z " * 400]
    slots = signatures(len(texts), *shingles(texts))
    for i, j in itertools.combinations(range(len(texts)), 2):
        assert abs((slots[i] == slots[j]).mean() - plain.similar(plain.bag(texts[i]), plain.bag(texts[j]))) < 0.12


@pytest.mark.parametrize("few, block, same", [(near_dedup.FEW, near_dedup.BLOCK, near_dedup.SAME), (2, 700, 3)])
def test_near_dedup(spark, docs, monkeypatch, few, block, same):
    """Classes are those of all pairs, in pairs as well as in blocks of a few texts with leads joined in parts."""
    for name, value in (("FEW", few), ("BLOCK", block), ("SAME", same)):
        monkeypatch.setattr(near_dedup, name, value)
    random.seed(3)
    texts = {d: t or "" for d, t in docs.items()}
    base = [f"w{random.randrange(900)}" for _ in range(150)]
    for k in range(120):  # a group whose members are similar to about 0.6 to 0.95
        t = list(base)
        for _ in range(random.randrange(8)):
            t[random.randrange(150)] = f"x{k}"
        texts[10_000 + k] = " ".join(t)
    want = plain.classes(texts)
    got = near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    assert sum(r.kept for r in got) == len(set(want.values()))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (101, 102), (7, 7)]
    got = {r.id: r.comp for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 103: 100}


def test_machine_is_a_factorization_machine():
    """Scores are the plain sum over terms and pairs, and a step of the fit follows its gradient."""
    rng = np.random.default_rng(3)
    machine = toxicity.Machine(rng.normal(size=50))
    machine.b, machine.v = 0.3, rng.normal(size=(50, toxicity.FACTORS)).astype(np.float32)
    texts = [np.sort(rng.choice(50, n, replace=False)) for n in (0, 1, 2, 7, 30, 0)]

    def plain(terms, w, v, b):
        pairs = sum(float(v[i] @ v[j]) for i, j in itertools.combinations(terms, 2))
        return b + sum(float(w[i]) for i in terms) + pairs / max(1, len(terms))

    want = [plain(t, machine.w, machine.v, machine.b) for t in texts]
    assert np.allclose(machine.raw(np.array([len(t) for t in texts]), np.concatenate(texts)), want, rtol=1e-4)
    y = np.array([0, 1, 0, 1, 0, 1], np.float32)
    loss = lambda m: sum(np.log1p(np.exp(-(2 * t - 1) * plain(x, m.w, m.v, m.b))) for x, t in zip(texts, y, strict=True))
    before = loss(machine)
    machine.fit(texts, y)
    assert loss(machine) < before


def test_machine_learns_pairs_among_many_terms():
    """The label is an exclusive-or of two terms, each alone as common in either class, among ten thousand others."""
    rng = np.random.default_rng(1)
    a, b = (rng.random((2, 8000)) < 0.5).astype(int).tolist()
    rows = [np.unique(np.concatenate([[7] * x, [8] * z, rng.integers(10, 10_000, 12)])).astype(np.int64) for x, z in zip(a, b, strict=True)]
    y = (np.array(a) != np.array(b)).astype(np.float32)
    machine = toxicity.Machine(np.zeros(10_000))
    for seed in range(4):
        machine.fit(rows[:7000], y[:7000], seed)
    raw = machine.raw(np.array([len(r) for r in rows[7000:]]), np.concatenate(rows[7000:]))
    assert ((raw > 0) == (y[7000:] > 0)).mean() > 0.9


def test_toxicity_learns_pairs_in_long_texts(spark):
    """Through toxicity(), at the query's settings: the label is an exclusive-or of two words, among 200 others a text."""
    rng = np.random.default_rng(2)
    a, b = rng.random((2, 20_000)) < 0.5
    words = np.array([f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(10_000)])
    texts = [" ".join(["insult"] * int(x) + ["group"] * int(z) + rng.choice(words, 200).tolist()) for x, z in zip(a, b, strict=True)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(a != b)], "doc_id long, toxic int")
    held = toxicity.toxicity(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    assert len(held) > 3000 and (held.predicted == held.toxic).mean() > 0.9


def test_terms_and_counts_are_the_plain_ones(spark):
    """Counts of documents a class by bucket, and the weights that terms start from, against plain Python."""
    rng = random.Random(6)
    vocabulary = ["one", "Two", "threes", "élan", "ab", "sevens7", "漢字", "abcd", "abcde"]
    rows = [(" ".join(rng.choices(vocabulary, k=rng.randrange(0, 9))), int(rng.random() < 0.4)) for _ in range(300)]
    of, bucket_of = {}, {}
    for w in vocabulary:
        _, (bucket_of[w], *_) = toxicity.document_terms([w]) if len(toxicity.document_terms([w])[1]) == 1 else (None, (None,))
    for text, toxic in rows:
        for bucket in set(toxicity.document_terms([text])[1].tolist()):
            of.setdefault(bucket, [0, 0])[toxic] += 1
    got = {r.bucket: [r.clean, r.toxic] for r in toxicity.term_counts(spark.createDataFrame(rows, "text string, toxic int")).collect()}
    assert got == of
    for w in ("ab", "one"):  # a short word is one term, and occurs as a word alone
        n = [sum(w in t.lower().split() for t, k in rows if k == toxic) for toxic in (0, 1)]
        assert got[bucket_of[w]] == n


def test_toxicity_on_held_out_rows(spark):
    data = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    held = [(labels[r.doc_id], r.predicted) for r in op7_toxicity(spark, data).where("held_out").collect() if r.doc_id in labels]
    assert np.mean([p for t, p in held if t == 1]) > 0.85 and np.mean([p for t, p in held if t == 0]) < 0.01


def test_decontamination_goes_with_the_words(spark):
    """Twenty thousand times one word, in a document and in an item, and passages within such runs, as the plain windows have them."""
    import time

    long = "spam " * 20_000
    items = [(1, long), (2, "spam " * 14 + "egg " + "spam " * 14), (3, "egg " * 12)]
    docs = [(10, long), (11, "x " * 50 + "spam " * 20 + "y"), (12, "spam " * 12), (13, "a " * 300 + "spam " * 30 + "egg " + "spam " * 30), (14, "b " + "egg " * 12)]
    started = time.time()
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert time.time() - started < 90
    assert got[10] == (20_000, 20_000, ["1", "2"], True) and got[11] == (71, 20, ["1", "2"], True) and got[12] == (12, 0, [], False)
    assert got[13] == (361, 61, ["1", "2"], True) and got[14] == (13, 12, ["3"], True)
