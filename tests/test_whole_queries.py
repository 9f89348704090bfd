"""Queries over whole tables: rows of every kind stay."""

from tamarisk.plans import catalog


def test_as_doubles_keeps_records_with_dirty_texts(spark, tmp_path):
    rows = [("a", "n/a", "24"), ("b", "1,000", "1e3"), ("c", "85f", " 7 "), ("d", "1d", "0x1p3"), ("e", None, "inf")]
    spark.createDataFrame(rows, "record_id string, insulin string, triceps string").write.parquet(str(tmp_path / "diabetes.parquet"))
    got = {r.record_id: (r.insulin, r.triceps) for r in catalog.QUERIES["as_doubles"](spark, str(tmp_path)).collect()}
    assert got == {"a": (None, 24.0), "b": (None, 1000.0), "c": (None, 7.0), "d": (None, None), "e": (None, float("inf"))}


def test_lines_and_documents_of_every_kind_stay(spark, tmp_path):
    texts = {1: "ab\bc\nplain\nx\b\b\nabc\b\bd", 2: "R&D &amp; &nbsp; &#39; <b>\u00a0\"'", 3: None, 4: "\bok"}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.text for r in catalog.QUERIES["html_round_trip"](spark, str(tmp_path)).collect()} == texts
    got = sorted((r.doc_id, r.line) for r in catalog.QUERIES["log_collapsed"](spark, str(tmp_path)).collect())
    assert got == [(1, "ac"), (1, "ad"), (1, "plain"), (2, texts[2]), (4, "ok")]
