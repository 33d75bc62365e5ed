"""Search, ranking and packing against brute force and hand-made cases."""

import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from passageworks.functions import fixed
from passageworks.functions.tokens import REGEX_COUNTER, Cuts, batch_counter, counted_by_cuts, recounted
from passageworks.operators import ivf, packing, prompts, ranking, replies
from passageworks.operators.embedding import embed, hashed_columns, hashed_words, text_slices, unit_rows, word_lists
from passageworks.plans.index import build_index
from passageworks.operators.nearest import NearestRows, gather, nearest
from passageworks.session import work_path


def brute(chunks, questions, k):
    """[(qid, id)] nearest first, ties by id."""
    out = {}
    for q, p in questions.items():
        d = {i: round(float(np.sqrt(((np.array(v) - np.array(p)) ** 2).sum())), 9)
             for i, v in chunks.items()}
        out[q] = sorted(d, key=lambda i: (d[i], i))[:k]
    return out


@pytest.fixture(scope="module")
def cloud(spark):
    """300 vectors with a third of them in one source and many exact copies."""
    rng = np.random.default_rng(5)
    vectors = rng.integers(-2, 3, size=(300, 6)).astype(float).tolist()
    sources = [0 if i % 3 == 0 else None if i % 17 == 0 else i % 11 for i in range(300)]
    df = spark.createDataFrame(
        [(i, s, v) for i, (s, v) in enumerate(zip(sources, vectors))],
        "id long, source_id long, embedding array<float>",
    ).repartition(7)
    asked = {q: vectors[q] for q in range(0, 300, 9)}
    questions = spark.createDataFrame(list(asked.items()), "qid long, embedding array<float>")
    return df, questions, dict(enumerate(vectors)), asked, sources


SEARCHES = {
    "broadcast": {},
    "seeded": {"seed_fraction": 0.5},
    "blocks": {"max_questions": 3, "block_chunks": 60, "block_questions": 16},
}


@pytest.mark.parametrize("search", SEARCHES)
@pytest.mark.parametrize("k", [1, 13, 500])
def test_nearest_equals_brute_force(cloud, search, k):
    df, questions, vectors, asked, _ = cloud
    got = {}
    for r in nearest(df, questions, k, **SEARCHES[search]).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.chunk_id)
    assert got == brute(vectors, asked, k)


@pytest.mark.parametrize("search", ["broadcast", "blocks"])
def test_both_stages_equal_brute_force(cloud, search):
    df, questions, vectors, asked, sources = cloud
    got = {}
    for r in ranking.retrieve(df, questions, 40, 2, 5, **SEARCHES[search]).collect():
        got.setdefault((r.qid, r.group_rank, r.source_id), {})[r.rank] = r.chunk_id
    want = {}
    for q, ids in brute(vectors, asked, 40).items():
        sums, first = {}, {}
        for place, i in enumerate(ids):
            if sources[i] is not None:
                d = round(float(np.linalg.norm(np.array(vectors[i]) - np.array(asked[q]))), 9)
                sums[sources[i]] = sums.get(sources[i], 0.0) + 1 / (1 + d)
                first.setdefault(sources[i], place)
        best = sorted(sums, key=lambda s: (-round(sums[s], 9), first[s]))[:2]
        for place, s in enumerate(best, 1):
            inside = {i: v for i, v in vectors.items() if sources[i] == s}
            ranked = brute(inside, {q: asked[q]}, 5)[q]
            want[(q, place, s)] = dict(enumerate(ranked, 1))
    assert got == want


def test_chunk_without_source_takes_a_place(spark):
    chunks = spark.createDataFrame(
        [(1, None, [0.0]), (2, 5, [1.0]), (3, 6, [2.0])],
        "id long, source_id long, embedding array<float>",
    )
    questions = spark.createDataFrame([(1, [0.0])], "qid long, embedding array<float>")
    hits = ranking.candidates(chunks, questions, 2)
    assert [(r.source_id, r.best_rank) for r in ranking.group_scores(hits).collect()] == [(5, 2)]


def test_equal_sums_rank_by_best_hit(spark):
    hits = spark.createDataFrame(
        [(1, 7, 0.3, 1), (1, 8, 0.5, 2), (1, 7, 0.2, 3)],
        "qid long, source_id long, score double, rank int",
    )
    rows = ranking.top_groups(hits, 5).orderBy("group_rank").collect()
    assert [r.source_id for r in rows] == [7, 8]


def test_no_questions_no_hits(spark, cloud):
    df, questions, *_ = cloud
    none = questions.filter("qid < 0")
    assert nearest(df, none, 3).count() == 0
    assert ranking.retrieve(df, none).count() == 0
    assert nearest(df.filter("id < 0"), questions, 3).count() == 0


def test_ragged_vectors_are_an_error(spark):
    bad = spark.createDataFrame(
        [(1, [0.0]), (2, [0.0, 1.0])], "qid long, embedding array<float>"
    )
    with pytest.raises(ValueError, match="widths"):
        gather(bad)


def test_kernel_with_far_scales():
    """Large offsets: single precision alone could not tell the neighbours apart."""
    rng = np.random.default_rng(1)
    x = 1000 + rng.normal(size=(3000, 8)) * 1e-2
    p = 1000 + rng.normal(size=(5, 8)) * 1e-2
    best = NearestRows(5, 10)
    for i in range(0, 3000, 500):
        rows = np.arange(i, i + 500)
        best.offer(rows, rows, x[rows], np.arange(5), p)
    lane, d, ids, carried = best.result()
    for q in range(5):
        exact = np.round(np.sqrt(((x - p[q]) ** 2).sum(axis=1)), 9)
        want = np.lexsort((np.arange(3000), exact))[:10]
        assert ids[lane == q].tolist() == want.tolist()
    assert (ids == carried).all()


def test_all_probes_equal_exact_search(spark, cloud):
    df, questions, vectors, asked, _ = cloud
    centres = ivf.fit_centres(df, 8)
    path = work_path(spark, "test-ivf")
    ivf.write_index(df, centres, path)
    stored = ivf.read_index(spark, path)
    assert stored.count() == 300
    for search in ({}, SEARCHES["blocks"]):
        got = {}
        hits = ivf.ann_topk(stored, questions, centres, 8, 9, **search)
        for r in hits.orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append(r.chunk_id)
        assert got == brute(vectors, asked, 9)


def test_few_probes_read_few_cells(spark, cloud):
    df, questions, *_ = cloud
    centres = ivf.fit_centres(df, 8)
    path = work_path(spark, "test-ivf")
    ivf.write_index(df, centres, path)
    hits = ivf.ann_topk(ivf.read_index(spark, path), questions.limit(1), centres, 1, 9)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


def test_embedding(spark):
    df = spark.createDataFrame([("Alma körte alma",), ("",), (None,)], "content string")
    rows = [r.embedding for r in embed(df, dim=16).collect()]
    assert np.allclose(np.linalg.norm(rows[0]), 1) and not any(rows[1]) and not any(rows[2])
    direct = hashed_words(["ALMA körte alma"], 16)[0]
    assert np.allclose(rows[0], direct / np.linalg.norm(direct))


def test_hashing_by_columns_equals_hashing_by_texts(spark):
    """With NULL, empty and long texts, and words at the edges or none at all."""
    texts = [None, "", " ", "--", "a", "-a-", "ÁRVÍZ tűrő ΟΔΟΣ", "x1_ 2² ٣", "日本 語", "é\u0301 🙂 z", "Alma alma " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    for size in (2, 256):
        got = {r.id: r.embedding for r in embed(df, "text", dim=24, batch_size=size).collect()}
        want = unit_rows(hashed_words([t or "" for t in texts], 24)).astype(np.float32)
        assert all(got[i] == want[i].tolist() for i in range(len(texts)))
    assert embed(df.limit(0), "text").count() == 0


def test_embedding_holds_the_words_of_bounded_slices():
    """Long texts share no slice beyond the bound in bytes, however many a batch has."""
    texts = pa.array([None, "ab " * 400_000, "", "c", "d " * 300_000, "e " * 300_000, *["f"] * 40])
    slices = list(text_slices(texts, 16))
    assert pa.concat_arrays(slices).equals(texts)
    sizes = [pc.sum(pc.binary_length(s)).as_py() or 0 for s in slices]
    assert all(size <= 1 << 20 or pc.max(pc.binary_length(s)).as_py() > size - (1 << 20) for s, size in zip(slices, sizes))
    assert max(len(s) for s in slices) <= 16 and sum(size > 500_000 for size in sizes) > 1


def test_embedding_with_a_loaded_model(spark):
    def load():
        return lambda texts: np.array([[len(t), 3.0] for t in texts])

    df = spark.createDataFrame([("abcd",)], "content string")
    assert np.allclose(embed(df, load=load, dim=2).first().embedding, [0.8, 0.6])


def test_embedding_of_a_wrong_width_fails(spark):
    df = spark.createDataFrame([("abcd",)], "content string")
    with pytest.raises(Exception, match="embedder gave"):
        embed(df, load=lambda: lambda t: np.zeros((len(t), 3)), dim=2).collect()


def test_stream_answers_each_question_once(spark):
    """Two batches, a blank row, a quit word, and a restart that finds nothing new."""
    import json
    import pathlib

    from passageworks.streaming.questions import answer_stream, question_stream

    source, out, state = (work_path(spark, n) for n in ("s-in", "s-out", "s-state"))
    folder = pathlib.Path(source.removeprefix("file:"))
    folder.mkdir(parents=True)
    files = [[(1, "alma"), (2, " ")], [(3, "körte"), (4, "QUIT")]]
    for i, rows in enumerate(files):
        lines = [json.dumps({"qid": q, "question": t}) for q, t in rows]
        (folder / f"{i}.json").write_text("\n".join(lines))
    texts = spark.createDataFrame(
        [(1, 10, "alma fa"), (2, 11, "körte fa")], "id long, source_id long, content string"
    )
    chunks = embed(texts, dim=32)
    for _ in range(2):
        stream = answer_stream(
            question_stream(spark, source, files_per_batch=1), chunks, out, state,
            available_now=True, dim=32, groups=1,
        )
        stream.awaitTermination()
    rows = {r.qid: r for r in spark.read.parquet(out).collect()}
    assert set(rows) == {1, 3} and spark.read.parquet(out).count() == 2
    assert rows[1].context == "[TICKET 10]\nalma fa"
    assert rows[3].context == "[TICKET 11]\nkörte fa"
    assert {r.batch for r in rows.values()} == {0, 1}


WORDS = batch_counter(lambda texts: [len(t.split()) for t in texts])
# Counts a joined text lower than its parts, as a merging tokenizer may.
MERGING = batch_counter(lambda texts: [max(0, len(t.split()) - 2 * t.count("=" * 20)) for t in texts])


def packed(spark, blocks, counter, budget):
    rows = [(1, i, b) for i, b in enumerate(blocks, 1)]
    df = spark.createDataFrame(rows, "qid long, rank int, block string")
    return packing.pack_contexts(df, budget, 0, counter).first().context


SEP = fixed.BLOCK_SEPARATOR


@pytest.mark.parametrize("counter, header, sep", [(WORDS, 1, 1), (REGEX_COUNTER, 2, 20)])
def test_context_rules(spark, counter, header, sep):
    a, b, c = "a " * 10, "b " * 50, "c"
    a, b = a.strip(), b.strip()
    fit_a = header + 10
    # Exactly on budget; a second block too big ends it, though a third would fit.
    assert packed(spark, [a], counter, fit_a) == a
    assert packed(spark, [a, b, c], counter, fit_a + sep + 49) == a
    assert packed(spark, [a, b, c], counter, fit_a + sep + 50) == a + SEP + b
    assert packed(spark, [a, b, c], counter, fit_a + 2 * sep + 51) == SEP.join([a, b, c])
    # The first block alone too big.
    assert packed(spark, [b, c], counter, header + 49) == ""
    # No budget at all: the first block uncut.
    assert packed(spark, [b, c], counter, header) == b
    assert packed(spark, [b, c], counter, -5) == b


def test_context_counts_joined_text(spark):
    """header 1 + 4 + 1 + 4 words, minus 2 for the separator."""
    assert packed(spark, ["a a a a", "b b b b"], MERGING, 8) == SEP.join(["a a a a", "b b b b"])
    assert packed(spark, ["a a a a", "b b b b"], MERGING, 7) == "a a a a"


def joined_by_hand(blocks, count, limit):
    """The rule, with every joined text counted."""
    shown = [b for b in blocks if b is not None]
    join = lambda n: SEP.join(b for b in blocks[:n] if b is not None)
    fits = [count(fixed.CONTEXT_HEADER + join(n)) <= limit for n in range(1, len(blocks) + 1)]
    if fits[-1]:
        return SEP.join(shown)
    if fits[0]:
        return join(fits.index(False))
    budget = limit - count(fixed.CONTEXT_HEADER)
    return (blocks[0] or "") if budget <= 0 or count(blocks[0] or "") <= budget else ""


def _counters():
    """White-space runs and pieces of four letters: neither adds up where texts meet.

    Made inside a function, so that workers get them by value.
    """
    def four_letters(texts):
        import re

        return [len(re.findall(r"\s+|\S{1,4}", t)) for t in texts]

    def anew():
        return recounted(four_letters)

    def by_cuts():
        return counted_by_cuts(four_letters, r"(?<!\s)\s")

    return four_letters, {"anew": anew, "by cuts": by_cuts}


four_letters, COUNTERS = _counters()


@pytest.mark.parametrize("form", COUNTERS)
def test_running_counts(form):
    rng = random.Random(4)
    for _ in range(200):
        add, text = COUNTERS[form](), ""
        for _ in range(6):
            piece = "".join(rng.choice("ab \n") for _ in range(rng.randrange(9)))
            text += piece
            assert add(piece) == four_letters([text])[0]


def test_a_cut_is_looked_for_from_the_end():
    """A cut far from the end is found as well, and most of a long text is not searched."""
    from passageworks.functions import tokens

    seen = []

    class Cuts:
        def finditer(self, text, start=0):
            seen.append(len(text) - start)
            return re.compile(r"(?<!\s)\s").finditer(text, start)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(tokens.re, "compile", lambda _: Cuts(), raising=True)
        add = counted_by_cuts(lambda ts: [len(t.split()) for t in ts], "")
    for text, most in (("ab cd " * 5000, 256), ("x" * 9000 + " " + "y" * 5000, 16_384)):
        del seen[:]
        assert add(text) > 0 and max(seen) <= most
    assert add("z") == len(("ab cd " * 5000 + "x" * 9000 + " " + "y" * 5000 + "z").split())


@pytest.mark.parametrize("form", [*COUNTERS, "merging"])
def test_fold_equals_counting_every_prefix(spark, form):
    """Also across Arrow batches, with empty, NULL and very long blocks."""
    rng = random.Random(5)
    merging = lambda ts: [max(0, len(t.split()) - 2 * t.count("=" * 20)) for t in ts]
    fn = merging if form == "merging" else four_letters
    counter = batch_counter(fn, running=COUNTERS.get(form))
    asked = {
        q: [
            rng.choice(["", None, " a ", "b\n", "abcde " * rng.randrange(1, 9), "x" * 3000])
            for _ in range(rng.randrange(1, 8))
        ]
        for q in range(60)
    }
    rows = [(q, r, b) for q, blocks in asked.items() for r, b in enumerate(blocks, 1)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.createDataFrame(rows, "qid long, rank int, block string")
        for limit in (-1, 6, 40, 1600):
            got = {r.qid: r.context for r in packing.pack_contexts(df, limit, 0, counter).collect()}
            assert got == {q: joined_by_hand(b, lambda t: fn([t])[0], limit) for q, b in asked.items()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")


def test_no_text_comes_back_from_the_fold(spark):
    df = spark.createDataFrame([], "qid long, rank int, block string, extra string")
    counted = packing.prefix_counts(df, WORDS)
    assert counted.columns == ["qid", "rank", "header", "first", "used"]
    assert counted.count() == 0 and packing.pack_contexts(df, 9, 0, WORDS).count() == 0
    with pytest.raises(ValueError, match="running"):
        packing.prefix_counts(df, REGEX_COUNTER)


def test_blocks_show_group_and_order(spark):
    hits = spark.createDataFrame(
        [(1, 42, 1, 2, "far"), (1, 42, 1, 1, "near"), (1, 43, 2, 1, "other")],
        "qid long, source_id long, group_rank int, rank int, content string",
    )
    rows = packing.group_blocks(hits).orderBy("rank").collect()
    assert [r.block for r in rows] == ["[TICKET 42]\nnear\n\n---\n\nfar", "[TICKET 43]\nother"]


@pytest.mark.parametrize("budget", [-1, 2, 4, 30, 33, 60, 90, 1000])
def test_packing_hits_equals_packing_blocks(spark, budget):
    words = "alma, körte! szilva"
    rows = [
        (q, 40 + g, g, r, f"{words} {q} {g} " * (q + r))
        for q in range(1, 5) for g in (1, 2) for r in range(1, q + g)
    ]
    shown = spark.createDataFrame(
        [(*r, i) for i, r in enumerate(rows)],
        "qid long, source_id long, group_rank int, rank int, content string, chunk_id long",
    )
    counted = shown.select(
        F.col("chunk_id").alias("id"), "content", REGEX_COUNTER.count(F.col("content")).alias("n_tok")
    )
    by_block = packing.pack_contexts(packing.group_blocks(shown), budget, 0)
    for counts in (None, "n_tok"):
        by_hit = packing.pack_hits(shown.drop("content"), counted, budget, 0, counts=counts)
        assert sorted(by_hit.collect()) == sorted(by_block.collect())


def _halved_letters(tmp=None):
    """Half the count of `four_letters`, cut where a word begins; notes in `tmp` what it counts."""

    def noted(texts):
        if tmp is not None:
            with open(tmp, "a") as file:
                file.write("".join(f"{len(t)}\n" for t in texts))
        return four_letters(texts)

    cuts = Cuts(noted, r"(?<=\s)\S", lambda n: (n + 1) // 2)
    return batch_counter(lambda texts: [cuts.total(n) for n in noted(texts)], cuts=cuts)


def _hits_of(spark, rows, contents):
    """Hits, with contents and without, and the chunks; chunks are hit by several questions."""
    hits = spark.createDataFrame(rows, "qid long, source_id long, group_rank int, rank int, chunk_id long")
    chunks = spark.createDataFrame(list(enumerate(contents)), "id long, content string").repartition(3)
    return hits, ranking.with_content(hits, chunks), chunks


@pytest.mark.parametrize("budget", [-1, 4, 5, 20, 60, 150, 400, 5000])
def test_packing_by_cuts_equals_counting_joined_texts(spark, budget):
    rng = random.Random(7)
    kinds = ["", None, " ", "a", "ab cd", " ab\n", "x" * 70, "abc " * 30, "  abcd ef " * 9, "one " + "y" * 40]
    contents = [rng.choice(kinds) for _ in range(40)]
    rows = [
        (q, 40 + g, g, r, rng.randrange(40))
        for q in range(40) for g in range(1, rng.randrange(2, 6)) for r in range(1, rng.randrange(2, 5))
    ]
    hits, shown, chunks = _hits_of(spark, rows, contents)
    counter = _halved_letters()
    want = packing.pack_contexts(packing.group_blocks(shown), budget, 0, counter).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = packing.pack_hits_by_cuts(hits, chunks, budget, 0, cuts=counter.cuts).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    assert len(got) == 40 and sorted(got) == sorted(want)


def test_a_chunk_near_to_many_questions_is_counted_once(spark, tmp_path):
    from passageworks.plans.answer import contexts_for

    texts = [f"w{i} " * 400 for i in range(6)]
    rng = np.random.default_rng(3)
    chunks = spark.createDataFrame(
        [(i, i % 2, t, rng.normal(size=4).tolist()) for i, t in enumerate(texts)],
        "id long, source_id long, content string, embedding array<float>",
    )
    asked = spark.createDataFrame(
        [(q, rng.normal(size=4).tolist()) for q in range(30)], "qid long, embedding array<float>"
    )
    counter = _halved_letters(str(tmp_path / "counted"))
    got = contexts_for(chunks, asked, max_context=100_000, counter=counter).collect()
    assert len(got) == 30 and all(sum(t in r.context for t in texts) == 6 for r in got)
    counted = sum(map(int, (tmp_path / "counted").read_text().split()))
    assert counted < 2 * sum(map(len, texts))


def test_what_fits_is_found_without_texts(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "a b", 2)], "id long, content string, n_tok int")
    chunks.write.parquet(str(tmp_path / "chunks"))
    sizes = spark.read.parquet(str(tmp_path / "chunks")).select(F.col("id").alias("chunk_id"), "n_tok")
    hits = spark.createDataFrame([(7, 42, 1, 1, 1)], "qid long, source_id long, group_rank int, rank int, chunk_id long")
    fitted = packing.within_budget(hits, sizes)
    assert "content" not in fitted._jdf.queryExecution().executedPlan().toString()
    assert [(r.qid, r.keep) for r in fitted.collect()] == [(7, True)]


def test_words_are_split_without_the_pattern(monkeypatch):
    """Texts of words of any script and ASCII signs; others take the pattern, with the same words."""
    rng = random.Random(6)
    plain = "ab9_ áéßñж日٣²\t\n\x00\x1f .,-[]@#\x7f"
    texts = [""] + ["".join(rng.choice(plain) for _ in range(rng.randrange(40))) for _ in range(300)]
    odd = [t + rng.choice(["\u00a0", "—", "\u0301", "😀", "\u2028"]) + "x" for t in texts]
    by_pattern = pc.split_pattern_regex
    words = lambda lists: [[w for w in ws if w] for ws in lists.to_pylist()]
    want = {n: words(by_pattern(pa.array(t), r"[^\p{L}\p{N}_]+")) for n, t in (("plain", texts), ("odd", odd))}
    assert words(word_lists(pa.array(odd))) == want["odd"]
    monkeypatch.setattr(pc, "split_pattern_regex", None)
    assert words(word_lists(pa.array(texts))) == want["plain"]
    assert words(word_lists(pa.array(texts).slice(7, 90))) == want["plain"][7:97]
    assert np.array_equal(hashed_columns(pa.array(texts), 48), hashed_words(texts, 48))


def test_merging_in_two_steps(cloud, monkeypatch):
    from passageworks.operators import nearest as module

    monkeypatch.setattr(module, "THIN_BYTES", 0)
    df, questions, vectors, asked, _ = cloud
    got = {}
    for r in nearest(df, questions, 13).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.chunk_id)
    assert got == brute(vectors, asked, 13)


def test_prompts_and_requests(spark):
    questions = spark.createDataFrame([(1, "Mi?"), (2, "Hol?"), (3, "Ki?")], "qid long, question string")
    contexts = spark.createDataFrame([(1, "szöveg"), (2, "")], "qid long, context string")
    rows = {r.qid: r for r in prompts.with_prompts(questions, contexts).collect()}
    assert rows[1].prompt == "KONTEKSTUS:\nszöveg\n\nKÉRDÉS: Mi?" and rows[1].reply is None
    assert rows[2].prompt is None and rows[2].reply == fixed.NO_CONTEXT_REPLY
    assert rows[3].prompt is None and rows[3].reply == fixed.NO_CONTEXT_REPLY
    requests = prompts.chat_requests(prompts.with_prompts(questions, contexts), system="s")
    assert [(r.qid, r.request) for r in requests.collect()] == [
        (
            1,
            '{"model":"llama3.2:3b","stream":false,"messages":[{"role":"system","content":"s"},'
            '{"role":"user","content":"KONTEKSTUS:\\nszöveg\\n\\nKÉRDÉS: Mi?"}],'
            '"options":{"temperature":0.0,"num_predict":256,"stop":["\\n\\nKONTEKSTUS",'
            '"\\nKÉRDÉS:","Szabályok:","Feladat:"]}}',
        )
    ]


@pytest.mark.parametrize(
    "raw, reply",
    [
        ('{"done": true}', ""),
        ('{"message": {"content": null}}', ""),
        ('{"message": {}}', ""),
        ("not json", ""),
        ('{"message": {"content": "  jó \\n"}}', "jó"),
        ('{"message": {"content": "jó\\nKÉRDÉS: más"}}', "jó"),
        ('{"message": {"content": "Feladat: x"}}', ""),
    ],
)
def test_reply_text(spark, raw, reply):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert df.select(replies.reply_text(F.col("raw")).alias("v")).first().v == reply


def test_audit(spark):
    rows = [
        (1, '{"message":{"content":"Válasz: Egy. Kettő.\\nIdézet: \\"van itt\\""}}', "ez van itt"),
        (2, '{"message":{"content":"Válasz: Egy.\\nIdézet: \\"nincs\\""}}', "ez van itt"),
        (3, '{"message":{"content":"Nem szerepel a kontextusban."}}', "ez van itt"),
        (4, "{}", None),
    ]
    df = spark.createDataFrame(rows, "qid long, raw_json string, context string")
    got = {r.qid: r for r in replies.audit_replies(df).collect()}
    assert (got[1].answer, got[1].quote) == ("Egy. Kettő.", "van itt")
    assert [got[i].quote_found for i in (1, 2, 3, 4)] == [True, False, False, False]
    assert [got[i].length_ok for i in (1, 2, 3, 4)] == [True, False, False, False]
    assert [got[i].declined for i in (1, 2, 3, 4)] == [False, False, True, False]


def test_indexing_refreshes_the_statistics_of_its_table(spark, tmp_path):
    docs = spark.createDataFrame([(1, "egy\n\nkettő"), (2, "három")], "doc_id long, text string")
    for n, rows in ((2, docs.limit(1)), (3, docs)):
        build_index(rows, str(tmp_path / "chunks"), table="index_statistics")
        known = spark.sql("DESCRIBE TABLE EXTENDED index_statistics").filter("col_name = 'Statistics'").first()
        assert f"{n} rows" in known.data_type
    spark.sql("DROP TABLE index_statistics")


def test_repeated_question_ids_are_one_question_both_ways(spark):
    chunks = spark.createDataFrame(
        [(i, [float(i), 0.0]) for i in range(8)], "id long, embedding array<float>"
    )
    asked = spark.createDataFrame(
        [(1, [6.0, 0.0]), (1, [0.0, 0.0]), (2, [3.0, 0.0])], "qid long, embedding array<float>"
    )
    ways = [
        sorted((r.qid, r.rank, r.chunk_id) for r in nearest(chunks, asked, 3, max_questions=n).collect())
        for n in (100, 0)
    ]
    assert ways[0] == ways[1] == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 1, 3), (2, 2, 2), (2, 3, 4)]


def test_blocks_of_questions_leave_the_chunks_in_place(spark, cloud, monkeypatch):
    """No vector of a chunk is shuffled for a question table too large to gather."""
    from passageworks.operators import nearest as module
    from passageworks.session import stored

    df, questions, *_ = cloud
    plans, ranked = [], module.ranked

    def seen(found, *rest, **options):
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return ranked(found, *rest, **options)

    monkeypatch.setattr(module, "ranked", seen)
    routes = questions.select("qid", F.pmod("qid", F.lit(5)).alias("source_id"))
    for options in ({}, {"group": "source_id", "routes": routes}):
        del plans[:]
        hits = nearest(stored(df, "chunks"), questions, 4, **SEARCHES["blocks"], **options)
        assert len(plans) >= 2 and not any("Exchange hashpartitioning" in p for p in plans)
        want = nearest(df, questions, 4, **options)
        assert sorted(map(str, hits.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("search", ["broadcast", "blocks"])
def test_nothing_beyond_the_reach(spark, cloud, search):
    df, questions, *_ = cloud
    within = questions.selectExpr("qid", "CASE WHEN qid % 2 = 0 THEN 2.0D END AS reach").filter("reach IS NOT NULL")
    hits = nearest(df, questions, 13, within=within, **SEARCHES[search]).drop("rank")
    whole = nearest(df, questions, 13).drop("rank").filter("qid % 2 = 1 OR d <= 2")
    assert sorted(map(str, hits.collect())) == sorted(map(str, whole.collect()))


def test_texts_of_contexts_move_once(spark):
    hits = spark.createDataFrame(
        [(q, 40 + g, g, r, f"w{q} " * r) for q in range(3) for g in (1, 2) for r in (1, 2)],
        "qid long, source_id long, group_rank int, rank int, content string",
    )
    together = packing.group_blocks(hits.repartition("qid"))
    plan = packing.pack_contexts(together, 99, 0, WORDS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "parquet" not in plan
