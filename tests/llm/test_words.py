"""Spelling variants, ranked lexical search and token counts against brute force."""

import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path
from zlib import crc32

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from passageworks.llm import lexical, spelling, token_counts

FOLDER = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string"
A_TO_Z = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


# ---- spelling variants -------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute_variants(rows, letters=6, often=5, slips=199, ratio=5):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(A_TO_Z)
            h = crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % slips == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= letters and n >= often}
    by_gap = defaultdict(set)  # near words agree when one letter is left out of the longer
    for w in words:
        by_gap[w].add(w)
        for i in range(len(w)):
            by_gap[w[:i] + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for group in by_gap.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= ratio * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def rows_of(df, *names):
    return {tuple(r[n] for n in names) for r in df.collect()}


VARIANT = ("word", "form", "root", "n", "n_near", "form_n")


def test_variants_of_made_words(spark):
    r = random.Random(5)
    base = ["".join(r.choice("abcé") for _ in range(r.randint(6, 9))) for _ in range(40)]
    rows = []
    for i in range(600):
        words = []
        for _ in range(30):
            w = base[min(int(r.expovariate(0.2)), 39)]
            while r.random() < 0.3:
                at = r.randrange(len(w))
                w = w[:at] + r.choice(["", "a", "é", "zz"]) + w[at + r.randint(0, 1) :]
            words.append(w.upper() if r.random() < 0.1 else w)
        rows.append((i if i % 50 else None, r.choice([" ", "-", "\n"]).join(words)))
    rows += [(7, None), (8, ""), rows[3], rows[3], (9, "÷×÷×÷×" + " abcabc" * 9), (10, "abcabx " * 50 + "x" * 40_000)]
    want = brute_variants(rows)
    docs = spark.createDataFrame(rows, DOCS).withColumn("word", F.lit("w")).withColumn("n", F.lit(1))
    got = spelling.variants(docs)
    assert got.columns == list(VARIANT)
    assert rows_of(got, *VARIANT) == want and got.count() == len(want)
    chains = {w: f for w, f, *_ in want if f}
    assert any(f in chains for f in chains.values())  # some forms have forms
    assert spelling.variants(docs.where("doc_id < 0")).collect() == []


@here
def test_variants_of_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = brute_variants([(r.doc_id, r.text) for r in docs.collect()])
    assert len(want) > 100 and rows_of(spelling.variants(docs), *VARIANT) == want


def test_signatures_of_near_words_meet():
    r = random.Random(3)
    for _ in range(3000):
        a = "".join(r.choice("abcdeéÿ") for _ in range(r.randint(6, 12)))
        at, kind = r.randrange(len(a)), r.random()
        b = a[:at] + r.choice(["x", "a", "é"]) + a[at + (kind < 0.5) :] if kind < 0.8 else a[:at] + a[at + 1 :]
        if a == b:
            continue
        longer, shorter = (a, b) if len(a) >= len(b) else (b, a)
        own = set(spelling.signatures(longer)[0])
        assert own & set(spelling.signatures(shorter)[len(a) != len(b)])


def test_signatures_are_not_broadcast(spark):
    r = random.Random(2)
    counted = spark.createDataFrame([("".join(r.choice("abcdef") for _ in range(7)), 5) for _ in range(500)], "word string, n long")
    found = spelling.near_words(counted.distinct())
    assert found.count() > 0
    found.collect()  # as replanned while it runs, too
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


# ---- ranked lexical search ---------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall((text or "").translate(A_TO_Z))


def brute_search(docs, items, most=50):
    held = [(d, Counter(terms_of(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, total = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(terms_of(t))
    out = set()
    for i, terms in wanted.items():
        scores = []
        for d, c, n in held:
            m = 100 - 50 + (50 * n * n_docs) // total
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                for t in terms if c[t]
            )
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out |= {(i, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(scores)[:most])}
    return out


FOUND = ("item_id", "rank", "doc_id", "score")


@pytest.fixture
def corpus():
    r = random.Random(8)
    plain = ["".join(r.choice("abcé1") for _ in range(r.randint(1, 4))) for _ in range(60)] + ["日本", "a\u0085b", "ÅB", " "]
    def text(n):
        return "".join(r.choice(plain).capitalize() + r.choice([" ", ", ", "_", "\n", "\x00", "..", "-"]) for _ in range(n))
    docs = [(i, text(r.randint(0, 60))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, " .. "), docs[5], docs[5], (None, docs[6][1]), (303, text(30_000))]
    items = [(i, text(r.randint(1, 12))) for i in range(20)] + [(20, None), (21, "... "), (22, "absent"), (3, "a b c")]
    return docs, items


@pytest.mark.parametrize("most", [1, 7, 50])
def test_search_equals_brute_force(spark, corpus, most):
    docs, items = corpus
    extra = spark.createDataFrame(docs, DOCS).withColumn("n", F.lit(1)).withColumn("terms", F.lit("x"))
    got = lexical.search(extra, spark.createDataFrame(items, "item_id long, text string"), most=most)
    assert got.columns == list(FOUND)
    want = brute_search(docs, items, most)
    assert rows_of(got, *FOUND) == want and got.count() == len(want)


def test_search_in_blocks_of_items(spark, corpus, monkeypatch):
    docs, items = corpus
    whole = lexical.blocks
    monkeypatch.setattr(lexical, "blocks", lambda t: whole(t, 20, 1 << 20))
    terms = lexical.item_terms(spark.createDataFrame(items, "item_id long, text string"))
    assert len(list(lexical.blocks(terms))) > 3
    assert all(len(b.item) <= 20 or len(b.ids) == 1 for b in lexical.blocks(terms))
    got = lexical.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    assert rows_of(got, *FOUND) == brute_search(docs, items)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs, items).collect() == []
    assert lexical.search(spark.createDataFrame([(1, "a")], DOCS), items.limit(0)).collect() == []


# ---- token counts -------------------------------------------------------------


def odd_texts():
    r = random.Random(4)
    letters = "abcABC ééÉßİıŁłſ ΣςσΑ日本語 ́̈ ’'s't 12²½٣ \t\n\r\x0b\x1c\x85\xa0  <|endoftext|> .,!?_-<>|"
    out = [None, "", " ", "\n\n", "don't", "<|endoftext|>", "a<|startoftext|>b<|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "ΑΣ ΑΣ.", "é"]
    out += ["".join(r.choice(letters) for _ in range(r.randint(1, 40))) for _ in range(1500)]
    out += ["ab" * 20_000, "a" * 5_000 + "é" * 5_000, "word " * 30_000, "日本" * 3_000]
    return out


def test_counts_equal_the_library(spark):
    texts = odd_texts()
    library = Tokenizer.from_file(PATH)
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("n_tokens", F.lit("x"))
    got = token_counts.count_tokens(docs, PATH)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    rows = sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect())
    assert rows == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got.collect())
    assert token_counts.count_tokens(docs.limit(0), PATH).collect() == []
    twice = token_counts.count_tokens(docs.limit(3).union(docs.limit(3)), PATH)
    assert twice.count() == 6


@here
def test_counts_of_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    library = Tokenizer.from_file(PATH)
    want = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, PATH).collect()} == want
