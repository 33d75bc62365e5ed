"""Document assembly, integrity report, ids, questions and tables on small rows."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from passageworks.functions import fixed
from passageworks.operators import documents, quality
from passageworks.operators.ids import dense_ids
from passageworks.operators.ordered import ordered_concat
from passageworks.plans.index import build_index
from passageworks.session import remove_work, work_path
from passageworks.sources import schemas, tables
from passageworks.sources.questions import question_rows

T0 = dt.datetime(2025, 3, 1, 9, 0)


@pytest.fixture(scope="module")
def base(spark):
    users = tables.literal_rows(
        spark, [(1, "Minta Éva", "eva@example.org", "customer", T0)], schemas.USERS
    )
    tickets = tables.literal_rows(
        spark,
        [
            (7, 1, "Nem megy", "open", "high", "account", T0, None),
            (8, 1, "Üres", "closed", "low", "billing", T0, T0 + dt.timedelta(microseconds=5)),
        ],
        schemas.TICKETS,
    )
    messages = tables.literal_rows(
        spark,
        [
            (12, 7, "agent", "Béla", "Nézzük.", T0 + dt.timedelta(minutes=2)),
            (11, 7, "customer", "Éva", "Segítség!", T0 + dt.timedelta(minutes=1)),
            (13, 7, "customer", "Éva", "Köszönöm.", T0 + dt.timedelta(minutes=2)),
        ],
        schemas.MESSAGES,
    )
    return users, tickets, messages


def test_ticket_documents(base):
    users, tickets, messages = base
    got = {r.doc_id: r.text for r in documents.ticket_documents(tickets, users, messages).collect()}
    assert got == {
        7: "Jegy ID: 7\nCím: Nem megy\nÜgyfél: Minta Éva (eva@example.org)\n"
        "Státusz: open, Prioritás: high, Kategória: account\n"
        "Létrehozva: 2025-03-01 09:00:00, Lezárva: None\n\n"
        "Beszélgetés:\n[customer] Éva: Segítség!\n[agent] Béla: Nézzük.\n"
        "[customer] Éva: Köszönöm.",
        8: "Jegy ID: 8\nCím: Üres\nÜgyfél: Minta Éva (eva@example.org)\n"
        "Státusz: closed, Prioritás: low, Kategória: billing\n"
        "Létrehozva: 2025-03-01 09:00:00, Lezárva: 2025-03-01 09:00:00.000005\n\n"
        "Beszélgetés:\n",
    }


@pytest.mark.parametrize("hot_rows", [1, 3, 7, 10_000])
def test_hot_groups_do_not_change_the_text(spark, hot_rows):
    rows = [(k, T0 + dt.timedelta(hours=(i * 7919) % 101), i, f"{k}-{i}" if i % 5 else None)
            for k, n in ((1, 60), (2, 3), (3, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz, id int, t string")
    got = ordered_concat(
        df, key="k", text="t", order=["ts", "id"], separator="\n", out="x", hot_rows=hot_rows
    )
    want = {}
    for k, _, _, t in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        want[k] = want.get(k, []) + ([t] if t else [])
    assert {r.k: r.x for r in got.collect()} == {
        k: "\n".join(v) if v else None for k, v in want.items()
    }


def test_check_table_counts_each_fault(spark):
    rows = [(1, 1, "ok", [0.0] * 3), (1, 9, "too long", [0.0]), (2, None, None, [0.0] * 3)]
    df = spark.createDataFrame(rows, "id int, parent int, name string, v array<float>")
    parents = spark.createDataFrame([(1,)], "id int")
    spec = schemas.TableSpec(
        ("id",), ("parent", "name"), {"name": 5}, ("parent",), {"v": 3}
    )
    got = quality.check_table(df, spec, {"parent": (parents, "id")}).collect()
    assert {(r.check, r.column): r.n_bad for r in got} == {
        ("not_null", "id"): 0,
        ("not_null", "parent"): 1,
        ("not_null", "name"): 1,
        ("max_length", "name"): 1,
        ("dimension", "v"): 1,
        ("unique", "id"): 1,
        ("foreign_key", "parent"): 1,
    }


def test_check_of_an_empty_table(spark):
    df = spark.createDataFrame([], schemas.TICKETS)
    report = quality.check_table(df, schemas.SPECS["tickets"]).collect()
    assert report and {r.n_bad for r in report} == {0}


def test_require_rows(spark):
    with pytest.raises(quality.EmptyInputError):
        quality.require_rows(spark.range(0), "tickets")


def test_index_of_nothing_is_an_error_and_keeps_the_table(spark):
    path = work_path(spark, "kept")
    docs = spark.createDataFrame([(1, "egy"), (2, "kettő")], "doc_id long, text string")
    assert build_index(docs, path, dim=4).count() == 2
    for empty in (docs.filter("doc_id < 0"), docs.withColumn("text", F.lit(" \n "))):
        with pytest.raises(quality.EmptyInputError):
            build_index(empty, path, dim=4)
    rows = spark.read.parquet(path).orderBy("id").collect()
    assert [(r.id, r.source_id, r.content) for r in rows] == [
        (1, 1, "[Általános] egy"),
        (2, 2, "[Általános] kettő"),
    ]
    assert {r.source_table for r in rows} == {"tickets"}


def test_dense_ids(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("x")).repartition(13)
    rows = dense_ids(df, ["x"]).orderBy("x").collect()
    assert [r.id for r in rows] == list(range(1, 1001))


def test_questions_end_with_their_session(spark):
    rows = [
        (1, 1, " first "), (1, 2, "  "), (1, 3, "EXIT"), (1, 4, "late"),
        (2, 1, None), (2, 2, "second"),
    ]
    df = spark.createDataFrame(rows, "s int, n int, q string")
    by_session = question_rows(df, question="q", order="n", session="s").collect()
    assert sorted(r.q for r in by_session) == ["first", "second"]
    together = question_rows(df, question="q", order="n").collect()
    assert sorted(r.q for r in together) == ["first", "second"]
    early = question_rows(df.filter("s = 1"), question="q", order="n").collect()
    assert [r.q for r in early] == ["first"]
    no_quit = question_rows(df.filter("s = 2"), question="q", order="n").collect()
    assert [r.q for r in no_quit] == ["second"]


def test_managed_table_life_cycle(spark):
    name = "life_cycle_chunks"
    tables.drop_tables(spark, [name])
    tables.create_if_missing(spark, name, schemas.CHUNKS)
    tables.create_if_missing(spark, name, schemas.CHUNKS)
    one = tables.literal_rows(spark, [(1, "tickets", None, "x", [0.5])], schemas.CHUNKS)
    for _ in range(2):
        tables.refresh_table(one, name)
    tables.analyze(spark, name)
    assert spark.table(name).count() == 1
    tables.drop_tables(spark, [name])
    assert not spark.catalog.tableExists(name)


def test_fixed_schemas_have_the_declared_vector_size():
    assert schemas.SPECS["rag_chunks"].vector_dims == {"embedding": fixed.EMBEDDING_DIM}


def test_work_paths(spark):
    path = work_path(spark, "a")
    assert path != work_path(spark, "a")
    spark.range(3).write.parquet(path)
    remove_work(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    with pytest.raises(ValueError):
        remove_work(spark, "/elsewhere")


@pytest.mark.parametrize("kind", ["string", "date", "timestamp", "int"])
def test_hot_keys_keep_any_order(spark, kind):
    """Segments follow all order columns, also when most rows share the first."""
    first = {"string": "'b'", "date": "date'2024-01-02'", "timestamp": "timestamp'2024-01-02 03:04:05.5'", "int": "7"}[kind]
    other = {"string": "'a'", "date": "date'2024-01-01'", "timestamp": "timestamp'2024-01-02 03:04:05.4'", "int": "6"}[kind]
    rows = spark.range(60).selectExpr(
        "id % 2 AS key", f"CASE WHEN id < 5 THEN {other} ELSE {first} END AS at", "id AS no", "concat('t', id) AS text"
    )
    found = [
        {r.key: r.out for r in ordered_concat(rows, key="key", text="text", order=["at", "no"], separator=" ", out="out", hot_rows=n).collect()}
        for n in (1000, 7)
    ]
    assert found[0] == found[1]
    assert found[0][0].split() == [f"t{i}" for i in range(0, 60, 2)]


def test_segments_follow_the_rows_not_the_size_of_a_segment(spark, monkeypatch):
    """A small `hot_rows` gives many segments, but not as many tasks and bounds; bounds hold no whole text."""
    from passageworks.operators import ordered

    monkeypatch.setattr(ordered, "SORT_ROWS", 1000)
    rows = spark.range(3000).selectExpr(
        "id % 3 AS key", "id % 7 AS at", "concat(repeat('x', 40), id) AS text"
    )
    few, many = (
        ordered_concat(rows, key="key", text="text", order=["at"], separator=" ", out="out", hot_rows=n)
        for n in (10_000, 5)
    )
    plan = many._jdf.queryExecution().executedPlan().toString()
    ranges = re.findall(r"rangepartitioning\((.*), (\d+)\), REPARTITION_BY_NUM", plan)
    assert ranges and {int(n) for _, n in ranges} == {3}
    assert not any("substring" not in by and ", text#" in by for by, _ in ranges)
    assert sorted(few.collect()) == sorted(many.collect())
