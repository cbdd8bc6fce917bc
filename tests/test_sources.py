import json
import os

import pytest
from pyspark.sql import functions as F

from clauseloom.sources import files as S, model as M
from clauseloom.streaming import ingest as I


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_page_marks_and_form_feeds(spark, tmp_path):
    write(tmp_path / "a.txt", "lost <!-- page 1 -->one\n<!-- page 3 -->three")
    write(tmp_path / "b.txt", "one\f\fthree")
    got = {(os.path.basename(r.path), r.page_no): r.page.strip() for r in S.read_text_pages(spark, str(tmp_path)).collect()}
    assert got == {("a.txt", 1): "one", ("a.txt", 2): "", ("a.txt", 3): "three", ("b.txt", 1): "one", ("b.txt", 2): "", ("b.txt", 3): "three"}


def test_page_marks_that_repeat_or_have_no_number(spark):
    files = spark.createDataFrame([("a", "<!-- page 1 -->one<!-- page 2 -->two<!-- page 1 -->again"), ("b", " <!-- page break --> text "), ("c", ""), ("d", None)], "path string, text string")
    got = {(r.path, r.page_no): r.page for r in S.split_pages(files).collect()}
    assert got == {("a", 1): "again", ("a", 2): "two", ("b", 1): "<!-- page break --> text", ("c", 1): ""}


def test_markdown_table(spark, tmp_path):
    p = write(tmp_path / "t.md", "# x\n| qid | topic |\n| --- | :-- |\n| a_1 | pay  |\n")
    assert [tuple(r) for r in S.read_markdown_table(spark, p, ["qid", "topic"]).collect()] == [("a_1", "pay")]
    bad = write(tmp_path / "u.md", "| qid | topic |\n| a | b | c |\n")
    with pytest.raises(Exception, match="cells in a row"):
        S.read_markdown_table(spark, bad, ["qid", "topic"]).collect()


def test_batches_round_trip_and_tolerance(spark, tmp_path):
    rows = [("d", f"q{i:02}", "a", "private") for i in range(23)]
    df = spark.createDataFrame(rows, "document_id string, question_id string, answer string, _note string")
    b = S.batched(df)
    assert sorted(len(r.answers) for r in b.collect()) == [3, 10, 10] and "_note" not in b.schema.json()
    b.write.json(str(tmp_path / "out"))
    assert S.read_batches(spark, str(tmp_path / "out")).count() == 23
    lines = [json.dumps({"document_id": "d", "kind": "window", "answers": [{"question_id": "q"}]}), "{broken", json.dumps({"document_id": "d", "kind": "merged", "answers": [{"question_id": "q"}]}), json.dumps({"document_id": "d", "error": "x", "answers": [{"question_id": "q"}]})]
    p = write(tmp_path / "w.jsonl", "\n".join(lines))
    assert S.read_batches(spark, p, tolerant=True).count() == 1
    with pytest.raises(Exception):
        S.read_batches(spark, p).collect()


def test_csv_strings(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi"\nthere'), (2, "a\x01b")], "n int, t string")
    S.write_csv(df, str(tmp_path / "c"), ["t", "n"])
    got = S.read_csv_strings(spark, str(tmp_path / "c"))
    assert got.columns == ["t", "n"] and {r.t for r in got.collect()} == {'say "hi"\nthere', "ab"}


def test_upsert_pending_lookup(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "document_id string, v int")
    new = spark.createDataFrame([("b", 3), ("b", 4)], "document_id string, v int")
    assert {(r.document_id, r.v) for r in S.upsert_by_document(old, new).collect()} == {("a", 1), ("b", 3), ("b", 4)}
    assert S.pending(old, new, "document_id").count() == 1
    assert S.checked_lookup(new, old.withColumnRenamed("v", "w"), "document_id").count() == 2
    with pytest.raises(Exception, match="no partner"):
        S.checked_lookup(old, new.withColumnRenamed("v", "w"), "document_id").collect()
    with pytest.raises(ValueError):
        S.union_by_position(old, new.select("v"))


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    p = str(tmp_path / "t")
    S.write_partitioned(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), p, ["k"])
    S.write_partitioned(spark.createDataFrame([("b", 3)], "k string, v int"), p, ["k"])
    assert {(r.k, r.v) for r in spark.read.parquet(p).collect()} == {("a", 1), ("b", 3)}


def test_model_calls_are_kept_and_failures_are_not(spark):
    class Echo:  # here, so that it is sent by value
        def answer(self, payloads):
            return [None if p == "bad" else p.upper() for p in payloads]

    req = M.with_keys(spark.createDataFrame([("x",), ("x",), ("y",), ("bad",)], "payload string"))
    kept = req.where("payload = 'y'").select("request_id", F.lit("kept").alias("response"))
    got = [r.response for r in M.answered(req, kept, Echo()).collect()]
    assert sorted(got) == ["X", "kept"]
    assert M.answered(req, kept).count() == 1


def test_ingestion_is_incremental(spark, tmp_path):
    src, store = tmp_path / "src", str(tmp_path / "store")
    schema = "document_id string, text string"
    state = {"known": spark.createDataFrame([], "document_id string, source_sha256 string"), "taken": []}

    def upsert(batch, _):
        new = I.changed(I.content_hash(batch), state["known"]).collect()
        state["taken"].append(sorted(r.document_id for r in new))
        rows = {r.document_id: r.source_sha256 for r in state["known"].collect()} | {r.document_id: r.source_sha256 for r in new}
        state["known"] = spark.createDataFrame(list(rows.items()), "document_id string, source_sha256 string")

    for rows in ([("a", "1"), ("b", None)], [("a", "1"), ("b", "2"), ("c", "3")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        I.ingest_available(spark, str(src), schema, store, upsert)
    I.ingest_available(spark, str(src), schema, store, upsert)
    assert state["taken"] == [["a", "b"], ["b", "c"]]


def test_windowed_counts(spark, tmp_path, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    p = str(tmp_path / "e")
    events.write.parquet(p)
    stream = I.windowed_counts(spark.readStream.schema(events.schema).parquet(p))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) s from windows").first()["s"] == events.count()
