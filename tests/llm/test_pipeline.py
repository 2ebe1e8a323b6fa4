import os

import pytest

import corpus_pipeline as cp
from loreweave.llm import mixing

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_stages_keep_the_columns_and_only_take_away(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(cp.STAGES):
        before = {r["doc_id"]: len(r["text"].split()) for r in docs.select("doc_id", "text").collect()}
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert ids and set(ids) <= set(before), name
        if name != "packing":
            assert docs.columns == columns and len(ids) == len(set(ids)), name
        if name in ("toxicity", "near copies"):
            assert all(len(r["text"].split()) == before[r["doc_id"]] for r in docs.collect())
        if name == "mixing":
            assert all(0 < len(r["text"].split()) <= 2 * before[r["doc_id"]] for r in docs.collect())
    assert docs.groupBy("sequence_id").sum("length").filter("`sum(length)` > 1024").isEmpty()


def through_all_stages(spark, folder, rows):
    """doc_id and text of each row after each stage but packing, and the packed doc_ids."""
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 0) for i, _ in rows if i is not None], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, found = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        found.append(sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str) if "text" in docs.columns else sorted({(r["doc_id"], r["sequence_id"], r["offset"]) for r in docs.collect()}, key=str))
    return found


def prose(name, n=60):
    return " ".join(f"{name}{k}" for k in range(n))


def test_one_of_two_equal_rows_stays(spark, tmp_path):
    copy = prose("b", 59) + " other"
    rows = [(1, prose("a")), (1, prose("a")), (2, prose("b")), (3, copy), (5, prose("c")), (5, prose("d"))]
    toxic, near, cut, mixed, packed = through_all_stages(spark, str(tmp_path), rows)
    assert toxic == sorted(rows, key=str)
    assert near == cut == sorted([rows[0], rows[2], rows[4], rows[5]], key=str)
    assert [(i, set(t.split())) for i, t in mixed] == [(i, set(t.split())) for i, t in near]
    assert [i for i, *_ in packed] == [1, 2, 5, 5]


def test_rows_without_a_doc_id_stay(spark, tmp_path):
    rows = [(None, prose("a")), (None, prose("a")), (None, prose("b")), (4, prose("b")), (None, prose("c")), (7, prose("d"))]
    _, near, cut, mixed, packed = through_all_stages(spark, str(tmp_path), rows)
    assert near == cut == sorted([rows[0], rows[3], rows[4], rows[5]], key=str)
    assert [(i, set(t.split())) for i, t in mixed] == [(i, set(t.split())) for i, t in near]
    assert [i for i, *_ in packed] == [4, 7, None, None]
    sizes = {r["doc_id"]: (r["size"], r["taken"] > 0) for r in mixing.op7_mixing(spark, str(tmp_path)).collect()}
    assert sizes == {None: (60, True), 4: (60, True), 7: (60, True)}
