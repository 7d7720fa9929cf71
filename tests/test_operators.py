"""Hand-computed cases of the text, quality, glossary and event operators."""

from pyspark.sql import functions as F

from textloom.functions.text import is_heading, paragraphs, sentences
from textloom.operators import chunking, events, glossary, quality


def test_paragraphs_and_sentences(spark):
    row = spark.createDataFrame([("a\n \n　b。c！\n\n\n",)], "t string").select(paragraphs(F.col("t")).alias("p"), sentences(F.lit("b。c！d")).alias("s"), sentences(F.lit("xyz")).alias("one")).first()
    assert row.p == ["a", "b。c！"] and row.s == ["b。", "c！", "d"] and row.one == ["xyz"]


def test_headings(spark):
    rows = spark.createDataFrame([("第三章 x", True), ("前言", True), ("一、x", True), ("Chapter", False), ("", False), ("第三章" + "x" * 60, False)], "t string, want boolean")
    assert all(r.got == r.want for r in rows.select("want", is_heading(F.col("t")).alias("got")).collect())


def test_chunks_break_at_headings_target_and_long_paragraphs(spark):
    text = "aaaa\nbbbb\n第一章\ncc\n" + "d。" * 6 + "\n" + "e。" * 6
    got = [(r.body, r.start_paragraph, r.is_head) for r in chunking.chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"), 8, 10).orderBy("chunk").collect()]
    d, e = "\n\n".join(["d。"] * 4), "\n\n".join(["e。"] * 4)
    assert got == [("aaaa\n\nbbbb", 0, False), ("第一章", 2, True), ("cc", 3, False), (d, 4, False), ("d。\n\nd。", 4, False), (e, 5, False), ("e。\n\ne。", 5, False)]


def test_empty_documents_have_no_chunks(spark):
    assert chunking.chunk_structure(spark.createDataFrame([(1, ""), (2, None), (3, " \n ")], "doc_id long, text string")).count() == 0


def test_alignment(spark):
    pairs = spark.createDataFrame([(1, 0, "a\nb\nc\nd\ne\nf\ng\nh", "a\nb\nc\nd\ne\nf\ng"), (2, 0, "a\nb", "a"), (3, 0, "abc", None), (4, 0, "abc", " "), (5, 0, "abcdefghij", "abcde")], "conv_id long, turn long, src string, zh string")
    got = {(r.conv_id, r.kind, r.severity) for r in quality.align_issues(pairs).collect()}
    assert got == {(1, "paragraph_mismatch", "warn"), (2, "paragraph_mismatch", "error"), (2, "length_ratio", "warn"), (3, "missing_file", "error"), (4, "empty_translation", "error"), (5, "length_ratio", "warn")}


def test_numbers_are_a_multiset(spark):
    pairs = spark.createDataFrame([(1, 0, "1 1 2 30", "1 30")], "conv_id long, turn long, src string, zh string")
    assert {(r.number, r.missing) for r in quality.number_missing(pairs).collect()} == {("1", 1), ("2", 1)}


def test_terms_need_word_boundaries(spark):
    docs = spark.createDataFrame([(1, "Ann saw Anna and ann_x, ANN.")], "doc_id long, text string")
    assert [(r.source, r.n) for r in glossary.term_occurrences(docs, spark.createDataFrame([("ann",)], "source string")).collect()] == [("ann", 2)]


def test_merge_is_the_ordered_fold(spark):
    seeds = spark.createDataFrame([("s", "x")], "source string, target string")
    rows = [("s", "x", 1), ("s", "y", 2), ("n", "p", 3), ("n", "p", 4), ("n", "q", 5), ("", "q", 6)]
    got = glossary.merge(seeds, spark.createDataFrame(rows, "source string, target string, arrival long")).orderBy("arrival").collect()
    assert [r.action for r in got] == ["unchanged", "rejected_by_lock", "inserted", "unchanged", "conflict", "invalid"]


def test_sequence_has_no_gaps(spark):
    ids = [5, 1, 99_999, 20_000, 20_001]
    got = events.sequenced(spark.createDataFrame([(i,) for i in ids], "id long"), "id", 10).collect()
    assert {r.id: r.seq for r in got} == {i: 11 + k for k, i in enumerate(sorted(ids))}


def test_happens_before(spark):
    rows = [(1, "a", 1), (1, "b", 2), (2, "b", 3), (2, "a", 4), (3, "b", 5), (4, "a", 6)]
    got = events.happens_before(spark.createDataFrame(rows, "k long, event_type string, seq long"), "a", "b", "k", "seq").collect()
    assert {r.k: r.status for r in got} == {1: "ok", 2: "out_of_order", 3: "missing"}
