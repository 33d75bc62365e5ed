"""Near copies, leaks, repeated strings and toxic passages against brute force."""

import hashlib
import random
import time
import tracemalloc
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from passageworks.llm import leaks, near_copies, suffixes, toxicity
from passageworks.llm.components import components


def words(r, n):
    return ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n)]


@pytest.fixture(scope="module")
def copies():
    """Texts with exact and near copies of several distances, nulls and short ones."""
    r = random.Random(5)
    rows, number = [], 0
    for base in range(25):
        text = words(r, r.randint(60, 160))
        for _ in range(r.randint(1, 6)):
            edited = list(text)
            for _ in range(r.randint(0, 3)):
                edited[r.randrange(len(edited))] = r.choice(words(r, 3))
            rows.append((number, " ".join(edited)))
            number += 1
        rows.append((number, " ".join(text)))
        rows.append((number + 1, " ".join(text)))
        number += 2
    rows += [(None, None), (900, ""), (901, "a b"), (902, "A, b!"), (903, "a b c"), (903, "a b c"), (None, "q r s t")]
    return rows


def brute_classes(rows):
    texts = sorted({t or "" for _, t in rows})
    labels, counts = near_copies.shingles(texts, near_copies.Hashes())
    ends = np.cumsum(counts)
    parts = [labels[e - n : e] for e, n in zip(ends, counts)]
    group = list(range(len(texts)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        x, y = parts[a].tolist(), parts[b].tolist()
        if not x or not y:
            continue
        longest = np.zeros((len(x) + 1, len(y) + 1), int)
        if len(set(x) & set(y)) / len(set(x) | set(y)) < 0.8:
            continue
        for i, u in enumerate(x):
            for j, v in enumerate(y):
                longest[i + 1, j + 1] = longest[i, j] + 1 if u == v else max(longest[i, j + 1], longest[i + 1, j])
        same = int(longest[-1, -1])
        if same / (len(x) + len(y) - same) >= 0.8:
            group[find(a)] = find(b)
    at = {t: i for i, t in enumerate(texts)}
    ids = defaultdict(list)
    for i, t in rows:
        if i is not None:
            ids[find(at[t or ""])].append(i)
    return sorted(str((i, min(ids[find(at[t or ""])], default=None))) for i, t in rows)


@pytest.mark.parametrize("module", [near_copies, leaks])
def test_hashes_of_words_are_not_held(module):
    texts = [" ".join(f"word{i}x{j}" for j in range(1_000)) for i in range(20)]
    read, known = near_copies.shingles if module is near_copies else leaks.word_hashes, module.Hashes()
    read(texts[:1], known)
    tracemalloc.start()
    try:
        counts = read(texts, known)[1].sum()
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert counts > 19_000 and held < 200_000
    assert known["word"] == xxhash.xxh3_64_intdigest("word")


def test_near_copy_classes(spark, copies):
    docs = spark.createDataFrame([(i, t, 1) for i, t in copies], "doc_id long, text string, node int").repartition(5)
    got = near_copies.classes(docs).collect()
    assert sorted(str((r.doc_id, r.class_id)) for r in got) == brute_classes(copies)
    kept = near_copies.one_of_each(docs)
    assert kept.columns == docs.columns
    classes = {str(r.class_id) for r in got if r.class_id is not None}
    rows = kept.collect()
    assert len(rows) == len(classes) + 1 and {str(r.doc_id) for r in rows if r.doc_id is not None} == classes
    assert near_copies.classes(docs.limit(0)).count() == 0


def test_no_link_is_lost_in_a_large_group_that_shares_passages(spark):
    """Pairs of links in a group whose texts are all nearly 0.8 alike; against all pairs."""
    r = random.Random(1)
    base, texts = words(r, 170), []
    for _ in range(100):
        own = words(r, 26)
        texts += [" ".join(base + own), " ".join(base + own[:14] + words(r, 10))]
    labels, counts = near_copies.shingles(texts, near_copies.Hashes())
    parts = np.split(labels, np.cumsum(counts)[:-1])
    group = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        if group[a] != group[b] and near_copies.matched(parts[a], parts[b]):
            low, high = sorted((group[a], group[b]))
            group = [low if x == high else x for x in group]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {x.doc_id: x.class_id for x in near_copies.classes(docs).collect()}
    assert len(set(group)) == 100 and got == dict(enumerate(group))


def test_linked_texts_meet_in_their_prefixes():
    r = random.Random(3)
    texts = [words(r, r.randint(5, 120)) for _ in range(30)]
    texts += [[w if r.random() > 0.02 else "x" for w in t[r.randint(0, 3) :]] for t in texts for _ in range(4)]
    labels, counts = near_copies.shingles([" ".join(t) for t in texts], near_copies.Hashes())
    parts = np.split(labels, np.cumsum(counts)[:-1])
    levels = np.random.default_rng(1).integers(0, 9, 1 << near_copies.SLOT_BITS).astype(np.uint8)
    keys, sizes = near_copies.prefixes(labels, counts, levels)
    of = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    by = np.lexsort((of, keys))
    met = near_copies.meeting(keys[by], 0 * by, of[by], of[by], counts[of][by], place[by])
    found = {tuple(p) for some in met for p in some.T.tolist()}
    linked = {(a, b) for a, b in combinations(range(len(texts)), 2) if near_copies.matched(parts[a], parts[b])}
    assert linked and linked <= found
    # Prints keep all links, and drop most pairs of texts that have little in common.
    held = near_copies._packed(*near_copies.prints(labels, counts))
    pairs = np.array(list(combinations(range(len(texts)), 2)))
    apart = near_copies.differing(held.take(pa.array(pairs[:, 0])), held.take(pa.array(pairs[:, 1])))
    kept = {tuple(p) for p in pairs[apart <= counts[pairs].sum(axis=1) / 9 + 1e-6].tolist()}
    assert linked <= kept and len(kept) < len(pairs) / 4


def test_blocks_of_one_shingle_meet_once_across_classes():
    sides, nodes = np.array([0, 0, 0, 0, 1, 1, 2, 2]), np.arange(8)
    groups, roots = np.array([1, 1, 1, 1, 2, 2, 2, 2]), np.array([0, 0, 5, 6, 5, 7, 5, 8])
    met = near_copies.meeting(groups, sides, nodes, roots, np.full(8, 50), np.zeros(8, int))
    assert {tuple(p) for some in met for p in some.T.tolist()} == {
        (0, 2), (0, 3), (1, 2), (1, 3), (2, 3), (4, 7), (5, 6), (5, 7)
    }
    many = np.zeros(100_000, np.int64)
    start = time.perf_counter()
    assert list(near_copies.meeting(many, many, np.arange(100_000), many, many + 50, many)) == []
    assert time.perf_counter() - start < 5


def test_frequent_shingles_in_blocks(spark, copies, monkeypatch):
    """All shingles taken as frequent, and dealt into blocks of two texts."""
    monkeypatch.setattr(near_copies, "HOT_LEVEL", 0)
    monkeypatch.setattr(near_copies, "HOT_ROWS", 2)
    docs = spark.createDataFrame(copies, "doc_id long, text string").repartition(5)
    own = near_copies.keyed(docs)
    texts = near_copies.distinct_texts(own)
    none = spark.createDataFrame([], "node long, root long")
    pairs = near_copies.apart(texts, none)
    found = {(r.a, r.b) for r in near_copies.links(own, texts, pairs).collect()}
    monkeypatch.setattr(near_copies, "HOT_LEVEL", 99)
    monkeypatch.setattr(near_copies, "HOT_ROWS", 8_192)
    plain = {(r.a, r.b) for r in near_copies.links(own, texts, near_copies.apart(texts, none)).collect()}
    assert plain and found == plain


def test_order_counts_in_the_alignment():
    labels, _ = near_copies.shingles([" ".join(words(random.Random(1), 60))], near_copies.Hashes())
    assert near_copies.matched(labels, labels) == 1.0
    swapped = np.concatenate([labels[28:], labels[:28]])
    assert near_copies.matched(labels, swapped) == 0.0
    assert near_copies.matched(labels, labels[:-8]) == pytest.approx(48 / 56)
    assert near_copies.matched(labels, labels[:-20]) == 0.0


def test_components_of_chains_and_stars(spark):
    r = random.Random(2)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(200, 400)]
    links = chain + star + [(b, a) for a, b in chain[:5]] + [(1000, 1000)]
    r.shuffle(links)
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, **{i: 7 for i in range(200, 400)}}


def brute_removed(rows):
    seen, out = set(), []
    order = sorted(set(rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    result = {}
    for row in order:
        data = row[2].encode()
        mask = bytearray(len(data))
        for p in range(len(data) - 99):
            window = data[p : p + 100]
            if window in seen:
                mask[p : p + 100] = b"\1" * 100
            seen.add(window)
        spans = sum(1 for i, m in enumerate(mask) if m and (i == 0 or not mask[i - 1]))
        kept = bytes(b for b, m in zip(data, mask) if not m)
        result[row] = (len(data), sum(mask), spans, hashlib.sha256(kept).hexdigest())
    for row in rows:
        out.append(str((row[0], *result[row])))
    return sorted(out)


@pytest.mark.parametrize("segment", [1 << 20, 150])
def test_repeated_strings(spark, monkeypatch, segment):
    r = random.Random(3)
    base = "".join(r.choice("abcdefgh ") for _ in range(700))
    rows = [
        (None, "dup " * 60), (None, None), (1, "a" * 350), (2, "ab" * 150), (3, base), (4, base[100:450] + "é" * 80 + base[500:]),
        (5, base[300:600]), (5, base[300:600]), (5, base[0:99]), (6, base[0:100]), (7, "x" + base[0:99] + base[250:352]),
        (8, "é" * 60), (9, "z" + "é" * 60), (10, "a" * 200), (11, ""), (12, base + base),
    ] + [(20 + i, base[:200] + str(i) * 3 + base[203:600]) for i in range(12)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, data int").repartition(4)
    if segment < 1 << 20:
        original = suffixes.pieces
        monkeypatch.setattr(suffixes, "SEGMENT", segment)
        batch = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("data")).toArrow().combine_chunks().to_batches()[0]
        found = [(int(p.rows[k]), p.base + i) for p in original(batch) for k in range(len(p.rows)) for i in range(max(0, int(p.sizes[k]) - 99))]
        lengths = [len(x) for x in batch.column("data").to_pylist()]
        assert sorted(found) == [(k, i) for k, n in enumerate(lengths) for i in range(max(0, n - 99))]
        return
    text = F.coalesce("text", F.lit(""))
    ties = {(x.doc_id, x.text): x.tie for x in docs.withColumn("tie", F.xxhash64(text).bitwiseAND(F.lit((1 << 24) - 1))).collect()}
    got = suffixes.deduplicate(docs).collect()
    assert all(hashlib.sha256(x.kept).hexdigest() == x.kept_sha256 for x in got)
    found = sorted(str((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256)) for x in got)
    assert found == brute_removed([(i, ties[i, t], t or "") for i, t in rows])
    assert suffixes.deduplicate(docs.limit(0)).count() == 0


def test_windows_are_refined_only_where_parts_agree(spark):
    """Short strings in many texts open all their runs; strings of just 100 bytes are still found,
    wherever their anchor stands."""
    r = random.Random(5)
    some = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    often = some(70)
    rows = [(i, some(150) + often + some(150)) for i in range(40)]
    shared = [some(n) for n in (100, 101, 117, 130, 140) * 12]
    rows += [(100 + i, some(90 + i) + x + some(120)) for i, x in enumerate(shared)]
    rows += [(200 + i, some(70) + x + some(100)) for i, x in enumerate(shared)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    opened = suffixes.refined(suffixes.keyed(docs).mapInArrow(suffixes._runs, suffixes.SIDED)).where("kind = 2")
    parts = suffixes.open_parts(opened)
    assert opened.where("doc_id < 100").count() >= 20 and parts.where("doc_id < 100").count() == 0
    windows = lambda df: df.agg(F.sum(F.col("more") + 1)).first()[0]
    assert windows(parts) < windows(opened)
    got = {x.doc_id: (x.n_removed, x.n_spans) for x in suffixes.deduplicate(docs).collect()}
    want = [eval(x)[:4] for x in brute_removed([(i, 0, t) for i, t in rows])]
    assert got == {i: (removed, spans) for i, _, removed, spans in want}
    assert all(got[200 + i][0] >= len(x) for i, x in enumerate(shared))


def test_leaks(spark):
    r = random.Random(4)
    items = [(i, " ".join(words(r, 30))) for i in range(5)] + [(50, "dear me"), (None, None), (51, ""), (52, " ".join(["the"] * 12))]
    w = items[1][1].split()
    docs = [
        (1, "x y " + " ".join(w[15:]) + " and then " + " ".join(w[:15])), (2, " ".join(w[:10])), (3, None), (4, "oh, Dear me!"),
        (5, items[2][1].upper() + " " + items[2][1]), (5, items[2][1]), (6, " ".join(words(r, 50))), (7, " ".join(["the"] * 2000)),
        (8, " ".join(w[:15] + ["zz"] + w[15:])), (None, items[3][1]),
    ]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, row int")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = sorted((str(x.doc_id), x.item_id, round(x.coverage, 3), x.n_tiles, x.longest) for x in leaks.find(frame, bench).collect())
    assert got == sorted(
        [
            ("1", 1, 1.0, 2, 15), ("4", 50, 1.0, 1, 2), ("5", 2, 1.0, 1, 30), ("5", 2, 1.0, 1, 30), ("7", 52, 1.0, 1, 12),
            ("8", 1, 1.0, 2, 15), ("None", 3, 1.0, 1, 30),
        ]
    )
    clean = leaks.without_leaks(frame, bench)
    assert clean.columns == frame.columns and sorted(x.doc_id for x in clean.collect()) == [2, 3, 6]
    assert leaks.find(frame, bench.limit(0)).count() == 0 and leaks.find(frame.limit(0), bench).count() == 0


def test_tiles_are_greedy_and_do_not_overlap():
    r = random.Random(6)
    for _ in range(200):
        a, b = ([r.choice("abc") for _ in range(r.randint(3, 25))] for _ in range(2))
        seeds = [(i, j) for i in range(len(a) - 2) for j in range(len(b) - 2) if a[i : i + 3] == b[j : j + 3]]
        places = np.array(seeds, int).reshape(-1, 2)
        found = leaks.tiles(places[:, 0], places[:, 1], 3)
        taken = [[], []]
        for i, j, n in found:
            assert n >= 3 and a[i : i + n] == b[j : j + n]
            taken[0] += range(i, i + n)
            taken[1] += range(j, j + n)
        assert all(len(t) == len(set(t)) for t in taken)
        # Nothing of three words is left to match.
        left = [(i, j) for i, j in seeds if not {i, i + 1, i + 2} & set(taken[0]) and not {j, j + 1, j + 2} & set(taken[1])]
        assert not left
        assert [n for *_, n in found] == sorted((n for *_, n in found), reverse=True)


def test_maximal_segments_are_those_of_the_definition():
    def brute(s, a, b):
        if a >= b:
            return []
        best = max(((sum(s[i:j]), i - j, -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)))
        if best[0] <= 0:
            return []
        i, j = best[3], best[4]
        # The longest of the best, so that parts beside it are strictly negative.
        return brute(s, a, i) + [(i, j)] + brute(s, j, b)

    r = random.Random(8)
    for _ in range(200):
        s = [r.choice([-3.1, -1.7, -0.6, 1.3, 2.9, 0.45]) + r.random() / 100 for _ in range(r.randint(0, 14))]
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(np.array(s))] == brute(s, 0, len(s))


def test_toxicity_learns_words_and_stems_from_rows_that_are_not_held_out(spark):
    r = random.Random(9)
    plain = words(r, 300)
    rows, labels = [], []
    for i in range(600):
        text, bad = [r.choice(plain) for _ in range(r.randint(20, 80))], i % 6 == 0
        if bad:
            for _ in range(3):
                text[r.randrange(len(text))] = r.choice(["vile", "nasty", "zork" + r.choice(plain)])
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    rows += [(5000, None), (5001, ""), (5002, " ".join("zork" + w for w in plain[:40])), (None, plain[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    marks = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    got = {x.doc_id: x for x in toxicity.score(docs, marks, held_out=held).withColumn("held", held).collect()}
    out = [(got[i].score >= 0.7) == bool(y) for i, y in labels if got[i].held]
    assert len(out) > 100 and np.mean(out) > 0.97
    assert got[5000].score == got[5001].score < 0.5 and got[5002].score > got[5000].score
    flipped = marks.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {x.doc_id: x.score for x in toxicity.score(docs, flipped, held_out=held).collect()}
    assert all(again[i] == got[i].score for i in again)
    none = toxicity.score(docs, marks.limit(0), held_out=held)
    assert {x.score for x in none.collect()} == {0.0}
    assert toxicity.score(docs.limit(0), marks, held_out=held).count() == 0


def brute_units(rows):
    """Weights of all words and prefixes, none left out, by the stated formula."""
    left = defaultdict(set)
    for text, toxic in rows:
        found = toxicity.words(text or "")
        for pair in zip(found, ["", *found]):
            left[pair].add(bool(toxic))
    counts = defaultdict(lambda: [0, 0])
    for (word, _), seen in left.items():
        counts[word][0] += True in seen
        counts[word][1] += False in seen
    stems = defaultdict(lambda: [0, 0])
    for word, (bad, good) in counts.items():
        for n in toxicity.PREFIXES:
            if len(word) >= n:
                stems["^" + word[:n]][0] += bad > 0
                stems["^" + word[:n]][1] += good > 0
    out = {}
    for table, least in ((counts, toxicity.MIN_SEEN), (stems, toxicity.MIN_STEM)):
        known = {u: c for u, c in table.items() if sum(c) >= least}
        n1, n0 = (sum(c[i] for c in known.values()) for i in (0, 1))
        if not n1 or not n0:
            n1, n0 = (sum(c[i] for c in table.values()) for i in (0, 1))
        a1, a0 = toxicity.PRIOR * n1 / (n1 + n0), toxicity.PRIOR * n0 / (n1 + n0)
        for unit, (bad, good) in known.items():
            y1, y0 = bad + a1, good + a0
            odds = np.log(y1 / (n1 + toxicity.PRIOR - y1)) - np.log(y0 / (n0 + toxicity.PRIOR - y0))
            out[unit] = np.sign(odds) * max(0.0, abs(odds) - toxicity.CAUTION * np.sqrt(1 / y1 + 1 / y0))
    return out


def brute_token(weights, word):
    units = [word, *("^" + word[:n] for n in sorted(toxicity.PREFIXES, reverse=True) if len(word) >= n)]
    return next((weights[u] for u in units if u in weights), 0.0) - toxicity.DRIFT


def test_toxicity_weights_are_those_of_all_units_and_whole_words(spark):
    r = random.Random(4)
    long = "z" * 60
    plain, rows = words(r, 400) + ["Stra\u00dfe", "\u0130x", "\u216bi", "a1b"], []
    for i in range(300):
        text = [r.choice(plain) for _ in range(r.randint(5, 60))]
        text.insert(r.randrange(5), long + ("vile" if i % 5 == 0 else "kind"))
        rows.append((" ".join(text), int(i % 5 == 0)))
    rows += [(None, 0), ("", 1)]
    model = toxicity.Model()
    toxicity.learn_units(model, spark.createDataFrame(rows, "text string, toxic int").repartition(5))
    whole = brute_units(rows)
    asked = {w for t, _ in rows for w in toxicity.words(t or "")} | {u[1:] + "q" for u in whole if u[0] == "^"}
    assert len(model.weights) < len(whole)
    for word in asked:
        assert model.token(word) == pytest.approx(brute_token(whole, word), abs=1e-9), word
    # Words that differ behind their fortieth letter are different words.
    assert model.token(long + "vile") > 0 > model.token(long + "kind")
