"""The registered queries of the corpus operators, and the pipeline."""

import random
from pathlib import Path

import corpus_pipeline
import pytest
from oracle import difference, duck
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry_point
from passageworks.llm import catalog, leaks, near_copies, packing, quality, secrets, stages

FOLDER = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def test_one_query_for_each_operator():
    names = [n for n in entry_point.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry_point.queries() and set(catalog.QUERIES) <= set(entry_point.queries())


@here
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    assert difference(catalog.QUERIES[name](spark, FOLDER), catalog.ORACLES[name], duck(FOLDER)) == ""


COLUMNS = {
    "op1_secret_ownership": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op2_near_copies": "doc_id class_id",
    "op3_license_rules": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op6_repeated_strings": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op7_toxic_segments": "doc_id held_out score predicted",
    "op9_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op13_token_counts": "doc_id n_bytes n_tokens over_limit",
}


@here
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_a_row_for_each_document(spark, name):
    rows = catalog.QUERIES[name](spark, FOLDER)
    assert rows.columns[: len(COLUMNS[name].split())] == COLUMNS[name].split()
    ids = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()
    assert sorted(r.doc_id for r in rows.select("doc_id").collect()) == sorted(r.doc_id for r in ids)


def test_pipeline_rows(spark, tmp_path):
    """Hand-made documents whose fate at each stage is known."""
    r = random.Random(12)
    plain = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)]

    def text(n):
        return " ".join(r.choice(plain) for _ in range(n))

    good = {i: text(60) for i in range(30)}
    near = good[3].split()
    near[30] = "changed"
    rows = list(good.items()) + [
        (100, good[5]), (101, " ".join(near)), (102, text(10)), (103, "same line here " * 30), (104, None), (105, ""),
        (106, text(40) + " token = 'abcdefgh1234' " + text(5)),
    ]
    item = text(25)
    rows.append((107, text(20) + " " + item + " " + text(20)))
    table = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    assert [f for _, f in corpus_pipeline.STAGES] == [
        stages.quality_rules, stages.near_duplicates, stages.decontamination, stages.secret_redaction, stages.curve_packing
    ]
    want = {**good, 106: rows[-2][1].replace("token = 'abcdefgh1234", "[SECRET]")}
    state = spark.read.parquet(f"{folder}/documents.parquet")
    left = [set(good) | {100, 101, 106, 107}, set(good) | {106, 107}, set(want), set(want)]
    for (_, stage), ids in zip(corpus_pipeline.STAGES, left):
        state = stage(spark, state, folder)
        assert state.columns == docs.columns and {x.doc_id for x in state.collect()} == ids
    assert {x.doc_id: x.text for x in state.collect()} == want
    assert state.where(F.length("text") != F.col("n_chars")).count() == 0
    tokenizer = Tokenizer.from_file(stages.public_tokenizers.path("word_bpe_49k.json"))
    got = {}
    for x in corpus_pipeline.run(spark, folder).collect():
        got[x.doc_id] = got.get(x.doc_id, 0) + x.length
    assert got == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}


def test_stages_keep_other_columns_and_take_no_rows(spark, tmp_path):
    schema = "doc_id long, text string, node int, _key string, _own_key int, _leak_key int, _row int, _spans int, source string"
    docs = spark.createDataFrame([(1, "a b c token=abcdef1", 1, "x", 2, 3, 4, 5, "s")], schema)
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    items = spark.createDataFrame([], "item_id long, text string")
    assert quality.kept_only(docs, quality.trusted_ids(labels)).columns == docs.columns
    long = docs.withColumn("text", F.lit(" ".join(f"word{i}" for i in range(40))))
    assert quality.kept_only(long, quality.trusted_ids(labels)).collect() == long.collect()
    redacted = stages.secret_redaction(spark, docs, "").first()
    assert redacted.text == "a b c [SECRET]" and redacted[2:] == docs.first()[2:]
    assert near_copies.one_of_each(docs).collect() == docs.collect()
    assert leaks.without_leaks(docs, items).collect() == docs.collect()
    assert near_copies.one_of_each(none).count() == leaks.without_leaks(none, items).count() == 0
    path = stages.public_tokenizers.path("word_bpe_49k.json")
    assert packing.pack(none, path).count() == 0
    assert secrets.scan(none).count() == 0
