"""Hand-computed cases of notes, nested blocks, tables, exports and the records of runs."""

import json
import xml.etree.ElementTree as ET

import numpy as np
import pytest

from textloom.operators import events, glossary, lifecycle, nesting, tables
from textloom.sources import exports, readers, writers

NOTE = "page long, box long, x0 long, y0 long, x1 long, y1 long, rank long"


def test_a_group_of_notes_is_what_its_first_touches():
    side_by_side = [[0, 0, 10, 100], [10, 0, 20, 100], [20, 0, 30, 100], [200, 0, 210, 100]]
    assert nesting.note_groups(np.array(side_by_side)) == [0, 0, 2, 3]
    assert nesting.note_groups(np.array([[0, 0, 100, 10], [0, 11, 100, 20], [0, 10, 100, 19]])) == [0, 1, 0]
    assert nesting.note_groups(np.zeros((0, 4))) == []


def test_notes_are_read_together(spark):
    notes = spark.createDataFrame([(1, 5, 0, 0, 10, 100, 1), (1, 6, 10, 0, 20, 100, 4), (1, 7, 500, 0, 510, 100, 9)], NOTE)
    grouped = nesting.notes(notes)
    assert sorted((r.note, r.n, r.x0, r.x1, r.rank) for r in nesting.note_blocks(grouped).collect()) == [(5, 2, 0, 20, 2.5), (7, 1, 500, 510, 9.0)]
    lines = spark.createDataFrame([(1, 1, 0), (1, 2, 2), (1, 3, 3), (1, 4, 9)], "page long, box long, rank long")
    both = nesting.with_notes(lines, grouped).orderBy("rank").collect()
    assert [r.box for r in both] == [1, 2, 5, 6, 3, 4, 7]
    assert nesting.with_notes(lines, grouped.limit(0)).count() == 4


@pytest.mark.parametrize(
    "boxes, lines, want",
    [
        ([(0, 0, 100, 100), (10, 10, 50, 50), (20, 20, 30, 30)], [1, 0, 0], [(None, "top"), (0, "child"), (0, "child")]),
        ([(0, 0, 100, 100), (10, 10, 50, 50)], [0, 2], [(None, "top"), (0, "merged")]),
        ([(0, 0, 100, 100), (10, 10, 50, 50)], [0, 0], [(None, "top"), (0, "merged")]),
        ([(20, 20, 30, 30), (10, 10, 90, 90), (0, 0, 300, 300)], [0, 0, 1], [(2, "child"), (2, "merged"), (None, "top")]),
        ([(0, 0, 100, 100), (0, 0, 150, 100), (0, 0, 151, 401)], [1, 1, 1], [(2, "merged"), (2, "merged"), (None, "top")]),
        ([], [], []),
    ],
)
def test_blocks_in_blocks(boxes, lines, want):
    assert nesting.nest(boxes, lines) == want


def test_tables_with_spans():
    cells = [(3, 3, 9, 9, "y|z"), (0, 0, 4, 9, "a<b"), (3, 3, 4, 4, None)]
    assert tables.to_html(cells) == '<table border="1"><tr><td colspan="2" rowspan="1">a&lt;b</td></tr><tr><td></td><td>y|z</td></tr></table>'
    assert tables.to_markdown(cells).split("\n") == ["| 0 | 1 |", "|---|---|", "| a<b | a<b |", "|  | y\\|z |"]
    assert tables.to_html([(0, 1, 0, 0, "t"), (0, 0, 1, 1, "u")]) == '<table border="1"><tr><td colspan="1" rowspan="2">t</td><td>u</td></tr><tr><td></td></tr></table>'
    assert (tables.to_html([]), tables.to_markdown([])) == ('<table border="1"></table>', "")


def test_a_text_may_be_in_two_cells(spark):
    texts = spark.createDataFrame([(1, 0, "b", 8, 0, 12, 10), (1, 1, "a", 0, 0, 2, 2), (1, 2, "x", 90, 90, 91, 91)], "page long, box int, text string, x0 long, y0 long, x1 long, y1 long")
    cells = spark.createDataFrame([(1, 0, 0, 0, 10, 10), (1, 1, 10, 0, 20, 10), (1, 2, 50, 50, 50, 50)], "page long, cell int, x0 long, y0 long, x1 long, y1 long")
    assert sorted(tuple(r) for r in tables.overlapping_texts(texts, cells).collect()) == [(1, 0, "ab"), (1, 1, "b"), (1, 2, "")]


def test_encoded_text_is_xml(spark):
    pages = spark.createDataFrame([(1, 0, "a.jpg", "x y/a.jpg", 10, 20), (1, 1, "b.jpg", "b.jpg", 10, 20)], "doc long, page long, name string, path string, width int, height int")
    lines = spark.createDataFrame([(1, 0, 1234, 0, 0, 5, 5, "A & <B>"), (1, 0, 0, 0, 0, 5, 5, None)], "doc long, page long, box long, x0 long, y0 long, x1 long, y1 long, text string")
    (row,) = exports.encoded_text(pages, lines).collect()
    root, ns = ET.fromstring(row.xml.encode()), {"t": exports.TEI}
    assert [z.get("{http://www.w3.org/XML/1998/namespace}id") for z in root.findall(".//t:zone", ns)] == ["L0000_000", "L0000_1234"]
    assert [lb.tail for lb in root.findall(".//t:lb", ns)] == [None, "A & <B>"]
    assert [g.get("url") for g in root.findall(".//t:graphic", ns)] == ["x%20y/a.jpg", "b.jpg"]


def test_annotations_are_written_in_parts(spark, tmp_path):
    pages = spark.createDataFrame([(7, "b.jpg", 10, 20), (3, "a.jpg", 10, 20)], "page long, file_name string, width int, height int")
    boxes = spark.createDataFrame([(7, 0, 1, 2, 3, 5, 4), (3, 1, 0, 0, 2, 2, 4), (3, 0, 0, 0, 1, 1, 4), (9, 0, 0, 0, 1, 1, 4)], "page long, box int, x0 long, y0 long, x1 long, y1 long, category_id int")
    exports.write_annotations(pages, boxes, str(tmp_path), fx=2.0)
    read = lambda name: sorted((json.loads(x) for f in (tmp_path / name).glob("*.json") for x in f.read_text().splitlines()), key=lambda r: r["id"])
    assert [(r["id"], r["file_name"], r["width"]) for r in read("images")] == [(0, "a.jpg", 20), (1, "b.jpg", 20)]
    assert [(r["id"], r["image_id"], r["bbox"], r["area"]) for r in read("annotations")] == [(0, 0, [0, 0, 2, 1], 2), (1, 0, [0, 0, 4, 2], 8), (2, 1, [2, 2, 4, 3], 12)]


def test_split_is_stable(spark):
    pages = spark.range(2000).withColumnRenamed("id", "page")
    train = {r.page for r in exports.split_pages(pages, 0.9).where("train").collect()}
    assert 1700 < len(train) < 1900
    assert {r.page for r in exports.split_pages(pages.where("page < 100"), 0.9).where("train").collect()} == {p for p in train if p < 100}


def test_broken_results_have_no_boxes(spark):
    good = json.dumps({"contents": [[{"boundingBox": [[5, 9], [1, 9], [5, 2], [1, 2]], "text": "b"}, {"text": "no box"}, {"boundingBox": [[0, 1], [1, 1]], "text": "a"}]]})
    files = spark.createDataFrame([(1, good), (2, "{"), (3, None), (4, '{"contents": []}')], "page long, json string")
    assert [tuple(r) for r in readers.recognized_boxes(files, "page", "json").orderBy("box").collect()] == [(1, 0, 0, 1, 1, 1, "a"), (1, 1, 1, 2, 5, 9, "b")]


def test_usage_of_either_form(spark):
    calls = [("x", '{"prompt_tokens": 10, "completion_tokens": 5, "prompt_tokens_details": {"cached_tokens": 0}}'), ("x", '{"prompt_tokens": 10}'), ("deepseek", '{"prompt_cache_hit_tokens": "7", "total_tokens": 9}'), ("x", None), ("x", "no"), ("x", '{"prompt_tokens": "many"}')]
    got = events.usage_samples(spark.createDataFrame(calls, "provider string, usage string")).collect()
    assert [(r.prompt_tokens, r.total_tokens, r.hit_tokens, r.miss_tokens) for r in got] == [(10, 15, 0, 10), (10, 10, 0, 0), (0, 9, 7, 0), (0, 0, 0, 0)]


def test_runs_without_chunks_do_not_comply(spark):
    order = spark.createDataFrame([("ok",)], "status string")
    owed = spark.createDataFrame([(True,)], "passed boolean")
    none, one = spark.createDataFrame([], "chunk long"), spark.createDataFrame([(1,)], "chunk long")
    assert dict(lifecycle.compliance(order, owed, none, none).collect()) == {"pre_extract_order": True, "stage_artifacts": True, "chunk_complete": False, "all": False}
    assert all(r.passed for r in lifecycle.compliance(order, owed, one, none).collect())


def test_annotated_pages(spark):
    xml = """<OCRDATASET xmlns="u"><PAGE IMAGENAME="a.jpg">
      <LINE X="1" Y="2" WIDTH="3" HEIGHT="4" TYPE="body"><CHAR MOJI="字" X="1" Y="2" WIDTH="1" HEIGHT="1"/><INLINE TYPE="note" X="1" Y="2" WIDTH="1" HEIGHT="1"/><CHAR MOJI="x" X="a"/></LINE>
      <LINE ERROR="1" X="1" Y="2" WIDTH="3" HEIGHT="4"/><LINE X="?" Y="2" WIDTH="3" HEIGHT="4"/>
      <BLOCK TYPE="広告" X="0" Y="0" WIDTH="9" HEIGHT="9"><TEXTBLOCK><SHAPE><POLYGON POINTS="5,6,1,2,3,9"/></SHAPE><LINE X="0" Y="0" WIDTH="1" HEIGHT="1"/></TEXTBLOCK></BLOCK>
      <TEXTBLOCK><SHAPE><POLYGON POINTS="1,2,3"/></SHAPE></TEXTBLOCK></PAGE><PAGE/></OCRDATASET>"""
    files = spark.createDataFrame([("f", xml), ("g", "<"), ("h", None)], "name string, xml string")
    got = readers.annotated_boxes(files, "name", "xml").orderBy("item").collect()
    assert [(r.key, r.page, r.image, r.kind, r.type, r.x0, r.y0, r.x1, r.y1) for r in got] == [
        ("f", 0, "a.jpg", "line", "body", 1, 2, 4, 6),
        ("f", 0, "a.jpg", "block", "広告", 0, 0, 9, 9),
        ("f", 0, "a.jpg", "text_block", "広告本文ブロック", 1, 2, 5, 9),
        ("f", 0, "a.jpg", "line", "", 0, 0, 1, 1),
    ]
    assert [(c.kind, c.value) for c in got[0].chars] == [("char", "字"), ("inline", "note")] and got[2].points == [5, 6, 1, 2, 3, 9]
    assert {(r.kind, r.n) for r in readers.annotated_counts(readers.annotated_boxes(files, "name", "xml")).groupBy("kind").sum("n").withColumnRenamed("sum(n)", "n").collect()} == {("line", 2), ("block", 1), ("text_block", 1)}


def test_report_lists_the_first_and_counts_the_rest(spark):
    terms = spark.createDataFrame([(True, "user"), (False, "auto")], "locked boolean, origin string")
    logged = spark.createDataFrame([(f"s{i}", 1, "a|b", "c", i == 0) for i in range(4)], "source string, nth int, existing_target string, proposed_target string, resolved boolean")
    alignment = spark.createDataFrame([(1, "missing_file", "error", None, None), (2, "length_ratio", "warn", None, 2.0)], "chunk long, kind string, severity string, delta int, ratio double")
    issues = spark.createDataFrame([("number", "warn")], "kind string, severity string")
    checks = spark.createDataFrame([("stage_artifacts", False), ("all", False)], "check string, passed boolean")
    run = {"total": 2, "done": 1, "failed": 1, "src_chars": 10, "zh_chars": 7, "path_mode": "simple", "prescan_mode": "off"}
    text = writers.delivery_report(run, terms, logged, alignment, issues, checks, files={"pdf": "x.pdf"}, most=2)
    assert [x for x in text.split("\n") if x.startswith("## ")] == ["## 1. Size and progress", "## 2. Terms", "## 3. Alignment", "## 4. Consistency", "## 5. Compliance", "## 6. Left out", "## 7. Files"]
    for line in ("| ratio | 0.7 |", "| open conflicts | 3 |", "| s1 | a\\|b | c |", "… and 1 more", "1 errors, 1 warnings", "| 1 | missing_file |  |", "| number | warn | 1 |", "not compliant", "- no prescan", "- 1 chunks failed", "| pdf | x.pdf |"):
        assert line in text
    empty = writers.delivery_report({}, terms.limit(0), logged.limit(0), alignment.limit(0), issues.limit(0), checks.limit(0))
    assert "not verified" in empty and "nothing" in empty and "| ratio | n/a |" in empty


def test_numbers_across_ranges_and_groups(spark):
    keys = [-7, -7, -1, 0, 1, 2, 3, 3, 3, 8, 9, 26, 27, 100, 1000]
    rows = spark.createDataFrame([(k, -i) for i, k in enumerate(keys)], "k long, tie long")
    got = events.sequenced(rows, "k", start=10, width=3, then=("tie",)).orderBy("seq").collect()
    assert [(r.k, r.tie) for r in got] == sorted((k, -i) for i, k in enumerate(keys)) and [r.seq for r in got] == list(range(11, 26))


def test_numbers_within_groups(spark):
    rows = [(g, k) for g, n in (("a", 50), (None, 20), ("b", 1)) for k in range(0, n * 3, 3)]
    got = events.sequenced(spark.createDataFrame(rows, "g string, k long"), "k", width=4, by="g").collect()
    assert sorted((r.g or "", r.seq, r.k) for r in got) == sorted((g or "", k // 3 + 1, k) for g, k in rows)


def test_blank_candidates_fix_no_target(spark):
    seeds = spark.createDataFrame([("k", "x")], "source string, target string")
    rows = [(" ", "a", 0), ("n", " ", 1), ("n", "p", 2), ("n", "p", 3), ("n", "q", 4), ("k", "x", 5), ("k", "y", 6), (None, "z", 7), ("n", "r", 8)]
    merged = glossary.merge(seeds, spark.createDataFrame(rows, "source string, target string, arrival long"))
    assert {r.arrival: r.action for r in merged.collect()} == dict(enumerate(["invalid", "invalid", "inserted", "unchanged", "conflict", "unchanged", "rejected_by_lock", "invalid", "conflict"]))
    assert sorted((r.source, r.nth, r.existing_target, r.proposed_target, r.resolved) for r in glossary.conflicts(merged).collect()) == [("k", 1, "x", "y", True), ("n", 1, "p", "q", False), ("n", 2, "p", "r", False)]


def test_marks_progress_and_search(spark):
    chunks = spark.createDataFrame([(1, "new"), (2, "new")], "chunk long, status string")
    marks = spark.createDataFrame([(2, "done", 5), (2, "failed", 9), (3, "done", 1)], "chunk long, status string, seq long")
    assert dict(lifecycle.marked(chunks, marks, "chunk").collect()) == {1: "new", 2: "failed", 3: "done"}
    runs = spark.createDataFrame([(8, 2, 0, 0), (0, 0, 1, 4001)], "n long, done long, failed long, chars long")
    got = runs.select(lifecycle.progress_line(runs.n, runs.done, runs.failed).alias("line"), lifecycle.estimated_chunks(runs.chars, 4000).alias("k")).collect()
    assert [tuple(r) for r in got] == [("- 2/8 (25%)", 1), ("- 0/0 (0%), 1 failed", 2)]
    terms = spark.createDataFrame([("Ab", None, None, "t", "ok"), ("c", "d", "xAB", "t", "conflict"), ("e", "f", None, "u", "ok")], "source string, target string, note string, type string, status string")
    assert [r.source for r in glossary.search(terms, " aB ").collect()] == ["Ab", "c"]
    assert [r.source for r in glossary.search(terms, "ab", "t", only_conflicts=True).collect()] == ["c"]
    assert glossary.search(terms, "").count() == 3
