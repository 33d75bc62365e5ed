"""Bounded cells, lateral lookups, key bits, table switches and keyword automata."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from passageworks.functions.automaton import automata, build, topic_label_wide
from passageworks.functions.text import topic_label
from passageworks.operators import codes, ivf, key_bits, quality, ranking
from passageworks.operators import nearest as search_module
from passageworks.operators.cells import bounded_topk, measure_cells, read_cells, write_cells
from passageworks.operators.nearest import nearest
from passageworks.operators.ordered import ordered_concat
from passageworks.plans.index import IndexCounts, build_index
from passageworks.session import shared, stored, stored_at, work_path, work_scope
from passageworks.sources import tables
from passageworks.sources.schemas import TableSpec

# ---- cells -------------------------------------------------------------------


@pytest.fixture(scope="module")
def clusters(spark):
    """600 vectors around 12 far centres, some copied, and questions near and between them."""
    rng = np.random.default_rng(2)
    middles = rng.normal(0, 10, (12, 8))
    vectors = (middles[rng.integers(0, 12, 600)] + rng.normal(0, 0.5, (600, 8))).astype(np.float32)
    vectors[500:540] = vectors[3]
    chunks = spark.createDataFrame(
        [(i, i % 5 or None, v.tolist()) for i, v in enumerate(vectors)],
        "id long, source_id long, embedding array<float>",
    ).repartition(6)
    points = np.concatenate([vectors[::40], (vectors[:10] + vectors[300:310]) / 2])
    asked = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "qid long, embedding array<float>")
    centres = ivf.fit_centres(chunks, 12)
    path = work_path(spark, "cells")
    ivf.write_index(chunks, centres, path)
    return chunks, asked, ivf.read_index(spark, path), centres


@pytest.mark.parametrize("k", [1, 12, 45, 700])
@pytest.mark.parametrize("search", [{}, {"max_questions": 3, "block_chunks": 60, "block_questions": 16}])
def test_bounded_search_is_exact(clusters, k, search):
    chunks, asked, indexed, centres = clusters
    cells = measure_cells(indexed, centres)
    assert int(cells.count.sum()) == 600
    found = bounded_topk(indexed, asked, cells, k, **search)
    want = nearest(chunks, asked, k, carry="source_id")
    columns = ["qid", "chunk_id", "source_id", "d", "rank"]
    assert sorted(map(str, found.hits.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    pairs = asked.count() * int(np.count_nonzero(cells.count))
    assert found.probed < pairs / 2 if k <= 45 else found.probed == pairs


def as_text(df):
    return sorted(map(str, df.select("qid", "chunk_id", "source_id", "d", "rank").collect()))


@pytest.mark.parametrize("fit_rows", [None, 200])
def test_written_cells_answer_as_the_chunks_do(spark, clusters, fit_rows):
    chunks, asked, _, _ = clusters
    path = work_path(spark, "index")
    write_cells(chunks.withColumn("content", F.lit("not kept")), path, 12, fit_rows)
    index = read_cells(spark, path, first=1)
    assert int(index.cells.count.sum()) == 600
    assert set(index.chunks.columns) == {"id", "source_id", "embedding", "cell"}
    want = as_text(nearest(chunks, asked, 9, carry="source_id"))
    assert as_text(ranking.candidates(chunks, asked, 9, index)) == want
    every = read_cells(spark, path, probes=12)
    assert as_text(ranking.candidates(chunks, asked, 9, every)) == want
    by_cells = ranking.retrieve(chunks, asked, 9, 2, 3, index=index)
    plain = ranking.retrieve(chunks, asked, 9, 2, 3)
    assert sorted(map(str, by_cells.select(plain.columns).collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("literals", [1000, 0])
def test_only_routed_cells_are_read(spark, clusters, literals, monkeypatch):
    """A list of cells prunes partitions: as a literal, or while running when it is long."""
    _, asked, indexed, _ = clusters
    routes = asked.select("qid", F.pmod("qid", F.lit(2)).cast("int").alias("cell"))
    want = as_text(nearest(indexed, asked, 4, carry="source_id", group="cell", routes=routes))
    monkeypatch.setattr(search_module, "MAX_LITERAL_GROUPS", literals)
    found = nearest(indexed, asked, 4, carry="source_id", group="cell", routes=routes)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("dynamicpruning" in plan) == (literals == 0)
    filters = [line for line in plan.splitlines() if "PartitionFilters: [" in line and "cell#" in line]
    assert any("PartitionFilters: []" not in line for line in filters)
    assert as_text(found) == want


def test_indexing_writes_cells_that_answer(spark):
    from passageworks.plans.answer import answer_table

    docs = spark.createDataFrame([(i, f"alma {i} körte {i % 3}") for i in range(40)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "alma 7"), (2, "körte 2")], "qid long, question string")
    path, cells = work_path(spark, "chunks"), work_path(spark, "cells")
    chunks = build_index(docs, path, cells=cells, lists=5, dim=32)
    plain = answer_table(chunks, asked, dim=32, candidate_k=6).collect()
    listed = answer_table(chunks, asked, dim=32, candidate_k=6, index=read_cells(spark, cells)).collect()
    assert sorted(plain) == sorted(listed) and len(plain) == 2


def test_a_scope_removes_what_was_made_in_it(spark):
    df = spark.range(3)
    kept, kept_path = stored_at(df, "kept")
    with pytest.raises(RuntimeError, match="stop"):
        with work_scope():
            _, path = stored_at(df, "scoped")
            value = shared(spark, [1, 2])
            with work_scope():
                _, inner = stored_at(df, "inner")
            assert spark.read.parquet(path).count() == 3 and value.value == [1, 2]
            with pytest.raises(Exception, match="PATH_NOT_FOUND"):
                spark.read.parquet(inner)
            raise RuntimeError("stop")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    with pytest.raises(Exception, match="destroyed"):
        value.unpersist()
    assert kept.count() == 3 and spark.read.parquet(kept_path).count() == 3


def test_a_stream_leaves_no_work_tables(spark, tmp_path):
    import json
    from pathlib import Path

    from passageworks.operators.embedding import embed
    from passageworks.streaming.questions import answer_stream, question_stream

    source = tmp_path / "ask"
    source.mkdir()
    for i, text in enumerate(["alma", "körte"]):
        (source / f"{i}.json").write_text(json.dumps({"qid": i, "question": text}))
    chunks = embed(spark.createDataFrame([(1, 10, "alma"), (2, 11, "körte")], "id long, source_id long, content string"), dim=16)
    chunks = stored(chunks, "few")
    cells = work_path(spark, "cells")
    write_cells(chunks, cells, 2)
    folder = Path(cells.removeprefix("file:")).parent
    before = {p.name for p in folder.iterdir()}
    stream = answer_stream(
        question_stream(spark, str(source), files_per_batch=1), chunks, str(tmp_path / "out"),
        str(tmp_path / "state"), available_now=True, dim=16, groups=1, index=read_cells(spark, cells),
    )
    stream.awaitTermination()
    rows = {r.qid: r.context for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {0: "[TICKET 10]\nalma", 1: "[TICKET 11]\nkörte"}
    assert {p.name for p in folder.iterdir()} == before


def test_bounded_search_of_nothing(spark, clusters):
    _, asked, indexed, centres = clusters
    cells = measure_cells(indexed, centres)
    assert bounded_topk(indexed, asked.limit(0), cells, 3).hits.count() == 0
    none = indexed.limit(0)
    empty = bounded_topk(none, asked, measure_cells(none, centres), 3)
    assert empty.hits.columns == ["qid", "chunk_id", "source_id", "d", "rank"]
    assert empty.hits.count() == 0 and empty.probed == 0


def test_lateral_lookup(spark, clusters):
    chunks, asked, *_ = clusters
    routed = stored(asked.withColumn("source_id", F.when(F.col("qid") % 3 > 0, F.col("qid") % 5)), "routed")
    found = ranking.lateral_chunks(stored(chunks, "lateral"), routed, 7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    groups = routed.select("qid", "source_id", F.lit(1).alias("group_rank"), F.lit(1.0).alias("score"))
    want = ranking.group_chunks(chunks, asked, groups.filter("source_id IS NOT NULL"), 7)
    columns = ["qid", "source_id", "chunk_id", "d", "rank"]
    rows = sorted(map(str, found.select(columns).collect()))
    assert rows and rows == sorted(map(str, want.select(columns).collect()))


# ---- codes -------------------------------------------------------------------


@pytest.mark.parametrize("k", [1, 12, 45, 700])
def test_coded_search_is_exact(clusters, k):
    chunks, asked, indexed, _ = clusters
    coded = codes.write_codes(indexed)
    assert set(coded.columns) == {"id", "source_id", "cell", "code", "scale", "residual"}
    few = asked.filter("qid < 4")
    columns = ["qid", "chunk_id", "source_id", "d", "rank"]
    for questions in (few, asked):
        want = nearest(chunks, questions, k, carry="source_id").select(columns).collect()
        for cell in (None, "cell"):
            found = codes.coded_topk(coded, indexed, questions, k, cell=cell)
            assert sorted(map(str, found.hits.select(columns).collect())) == sorted(map(str, want))
    # Vectors are read for about as many rows as few questions have neighbours.
    read = codes.coded_topk(coded, indexed, few, k).vectors_read
    assert read == 600 if k == 700 else read <= 4 * k + 60 + 41  # 41 equal vectors


def test_bounds_hold_the_distance():
    rng = np.random.default_rng(5)
    for size in (1e-3, 1.0, 1e4):
        x, points = rng.normal(0, size, (200, 16)), rng.normal(0, size, (30, 16))
        x[0], x[1], points[0] = 0, x[2], x[3]
        scale = np.abs(x).max(axis=1) / 127
        code = np.rint(x / np.where(scale > 0, scale, 1)[:, None]) * scale[:, None]
        lower, upper = codes.bounds(code, np.linalg.norm(x - code, axis=1), points)
        true = np.linalg.norm(points[:, None] - x[None], axis=2)
        assert (lower <= true).all() and (true <= upper).all() and (upper - lower < 0.2 * size).all()


def test_coded_search_of_nothing(spark, clusters):
    _, asked, indexed, _ = clusters
    none = indexed.limit(0)
    for found in (
        codes.coded_topk(codes.write_codes(none), none, asked, 3, cell="cell"),
        codes.coded_topk(codes.write_codes(indexed), indexed, asked.limit(0), 3, cell="cell"),
    ):
        assert found.vectors_read == 0 and found.hits.count() == 0
    zeros = spark.createDataFrame([(1, 1, [0.0] * 8), (2, None, [0.0] * 8)], "id long, source_id long, embedding array<float>")
    got = codes.coded_topk(codes.write_codes(zeros), zeros, asked.filter("qid = 0"), 1).hits.collect()
    assert [(r.chunk_id, r.rank) for r in got] == [(1, 1)]


# ---- counts of a write ---------------------------------------------------------


def test_indexing_counts_without_another_job(spark):
    rows = [(i, "" if i % 9 == 0 else f"Line {i}.\n\nAnother one, of {i} words.") for i in range(200)]
    docs = stored(spark.createDataFrame(rows + [(500, None)], "doc_id long, text string"), "counted-docs")

    def jobs(group, **options):
        spark.sparkContext.setJobGroup(group, group)
        build_index(docs, work_path(spark, "counted"), **options)
        spark.sparkContext.setJobGroup("other", "other")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    counts = IndexCounts()
    assert jobs("with-counts", counts=counts) == jobs("without-counts")
    assert counts.documents == 201 and counts.chunks == 2 * sum(i % 9 > 0 for i in range(200))
    with pytest.raises(quality.EmptyInputError):
        build_index(docs.limit(0), work_path(spark, "counted"))
    with pytest.raises(quality.EmptyInputError):
        build_index(docs.filter("text = ''"), work_path(spark, "counted"))


# ---- key bits ----------------------------------------------------------------


@pytest.mark.parametrize("spread", [1, 1_000_003])
def test_bits_report_what_the_joins_report(spark, spread):
    r = random.Random(spread)
    parents = [(i * spread - 40_000, "p") for i in range(3000) if i % 7] + [(None, "p")] * 2
    children = [(r.choice([i * spread - 40_000, None, i * spread - 40_000]),) for i in range(3100) for _ in range(2)]
    parent = spark.createDataFrame(parents + parents[:5], "id long, name string")
    child = spark.createDataFrame(children, "parent_id long")
    assert key_bits.dense_keys(parent, "id") == (spread == 1)
    for df, spec, keys in (
        (parent, TableSpec(("id",), ("name",)), {}),
        (child, TableSpec(("parent_id",), (), foreign_keys=("parent_id",)), {"parent_id": (parent, "id")}),
        (child.limit(0), TableSpec(("parent_id",), (), foreign_keys=("parent_id",)), {"parent_id": (parent, "id")}),
        (child, TableSpec(("parent_id",), (), foreign_keys=("parent_id",)), {"parent_id": (parent.limit(0), "id")}),
    ):
        assert sorted(key_bits.check_table_bits(df, spec, keys).collect()) == sorted(quality.check_table(df, spec, keys).collect())


def test_clean_keys_do_not_reach_the_join(spark):
    parent = spark.range(400_000)
    child = spark.range(390_000).selectExpr("id AS parent_id").unionByName(
        spark.createDataFrame([(500_000,), (500_000,)], "parent_id long")
    )
    left = key_bits.suspects(child, "parent_id", parent, "id")
    assert [r.parent_id for r in left.collect()] == [500_000, 500_000]
    assert key_bits.bit_table(child, "parent_id").count() <= 14


# ---- switched tables -----------------------------------------------------------


def test_a_failed_switch_keeps_the_old_rows(spark):
    name, folder = "passageworks_switch_test", work_path(spark, "switch")
    tables.drop_tables(spark, [name])
    first = spark.createDataFrame([(1, "a")], "id long, text string")
    tables.create_if_missing(spark, name, first.schema, f"{folder}/version-0")
    old = tables.switch_table(first, name, folder)
    broken = first.select("id", F.raise_error(F.lit("stop")).cast("string").alias("text"))
    with pytest.raises(Exception, match="stop"):
        tables.switch_table(broken, name, folder)
    assert [tuple(r) for r in spark.table(name).collect()] == [(1, "a")]
    reader = spark.read.parquet(old)
    tables.switch_table(spark.createDataFrame([("b", 2), ("c", 3)], "text string, id long"), name, folder)
    assert sorted(tuple(r) for r in spark.table(name).collect()) == [(2, "b"), (3, "c")]
    assert reader.count() == 1  # readers that began before go on
    with pytest.raises(ValueError):
        tables.drop_version(spark, name, tables.location(spark, name))
    tables.drop_version(spark, name, old)
    assert spark.table(name).count() == 2
    tables.drop_tables(spark, [name])


# ---- keywords ------------------------------------------------------------------


def brute_label(text, pairs, none):
    return min((t for t, w in pairs if w in text), default=none)


@pytest.mark.parametrize("most", [1 << 25, 200])
def test_automaton_equals_substring_tests(most):
    import pyarrow as pa

    r = random.Random(1)
    word = lambda n: "".join(r.choice("abcé日𝒳") for _ in range(n))
    pairs = [(r.randrange(20), word(r.randint(1, 5))) for _ in range(60)]
    texts = [word(r.randint(0, 30)) + r.choice(["", "zz", " "]) + word(r.randint(0, 3)) for _ in range(400)] + ["", None]
    tables_ = automata(pairs, 20, most)
    assert (len(tables_) > 1) == (most == 200)
    found = np.minimum.reduce([a.first_labels(pa.array(texts, pa.string())) for a in tables_])
    assert found.tolist() == [brute_label(t or "", pairs, 20) for t in texts]
    assert build([], 3).first_labels(pa.array(["a", ""])).tolist() == [3, 3]
    assert build([(1, ""), (2, "a")], 3).first_labels(pa.array(["a", ""])).tolist() == [1, 1]


def test_wide_labels_equal_the_chain(spark):
    topics = {"One": ["Keit", "keit", "é"], "Two": ["thw", "eit"], "Three": ["", "x"], "None": []}
    texts = [("KEIT",), ("eith",), ("Thwart",), ("ÉÉ",), ("",), (None,), ("zzz",)]
    docs = spark.createDataFrame(texts, "text string")
    for some in (topics, {k: v for k, v in topics.items() if k != "Three"}, {}):
        both = docs.filter("text IS NOT NULL").select(
            topic_label(F.col("text"), some).alias("chain"), topic_label_wide(spark, F.col("text"), some).alias("wide")
        )
        assert all(r.chain == r.wide for r in both.collect())


# ---- ties ------------------------------------------------------------------------


def test_ties_are_in_one_order_whatever_the_size(spark):
    rows = spark.createDataFrame([(1, 5, x) for x in "dbca"] + [(2, 5, "z")], "key int, at int, text string").repartition(4)
    forms = [
        {r.key: r.out for r in ordered_concat(
            rows, key="key", text="text", order=["at"], separator="", out="out", hot_rows=n
        ).collect()}
        for n in (2, 1000)
    ]
    assert forms == [{1: "abcd", 2: "z"}] * 2


def test_lateral_lookup_of_repeated_and_missing_vectors(spark):
    """No pair of vectors is a row of the lookup; a missing distance comes first, as it did."""
    chunks = spark.createDataFrame(
        [(i, i % 2, None if i in (4, 9) else [float(i), 1.0]) for i in range(12)] + [(2, 0, [2.0, 1.0])],
        "id long, source_id long, embedding array<float>",
    )
    asked = spark.createDataFrame(
        [(1, 0, [2.0, 1.0]), (1, 0, [3.0, 1.0]), (2, 1, None), (3, None, [1.0, 1.0]), (None, 1, [1.0, 1.0])],
        "qid long, source_id long, embedding array<float>",
    )
    found = ranking.lateral_chunks(stored(chunks, "lateral"), stored(asked, "asked"), 3)
    assert "zip_with" not in found._jdf.queryExecution().executedPlan().toString()
    rows = sorted((r.qid, r.rank, r.chunk_id, r.d) for r in found.collect())
    twice = [4, 4, 4, 4, 2, 2]  # two rows of question 1 share what either of them finds
    assert [r[2] for r in rows if r[0] == 1] == twice and [r[3] for r in rows if r[0] == 1] == [None] * 4 + [0.0] * 2
    assert [r[2:] for r in rows if r[0] == 2] == [(1, None), (3, None), (5, None)] and len(rows) == 9
