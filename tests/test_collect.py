"""Files of folders, rules of a fake client, resetting a run's state, and rounds of repair."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import lifecycle, models
from textloom.sources import collect, writers


def test_files_by_name(spark, tmp_path):
    for name in ("a.xml", "b.xml", "deep/a2.xml", "deep/c.txt", "old_a.xml"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    names = lambda *a: sorted(r.name for r in collect.collect_files(spark, str(tmp_path), *a).collect())
    assert names((".xml", ".txt")) == ["a.xml", "a2.xml", "b.xml", "c.txt", "old_a.xml"]
    assert names((".xml",), "a") == ["a.xml", "a2.xml", "old_a.xml"] and names((".xml",), "a", "old") == ["a.xml", "a2.xml"]


def test_images_and_pdf(spark, tmp_path):
    for name in ("p.JPG", "q.png", "r.pdf", "s.txt", "t.jp2"):
        (tmp_path / name).write_bytes(b"x")
    found = {r.path.rsplit("/", 1)[1]: r.kind for r in collect.scan_images(spark, str(tmp_path)).collect()}
    assert found == {"p.JPG": "image", "q.png": "image", "r.pdf": "pdf", "t.jp2": "image"}


def test_rules_skip_broken_lines(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"when": {"stage": "S3", "chunk": 2}, "respond": "a"}\n\n[1]\n{"respond": \n {"when": {"tier": "fast"}, "respond": "b"}\n{"respond": "c"}\n')
    rows = collect.read_rules(spark, str(tmp_path / "r.jsonl")).orderBy("nth").drop("nth").collect()
    assert [tuple(r) for r in rows] == [("S3", 2, None, "a"), (None, None, "fast", "b"), (None, None, None, "c")]
    call = models.fake_client([r.asDict() for r in rows])
    assert [call("p", *a).text for a in (("S3", 2, "x"), ("S3", 1, "fast"), (None, None, None))] == ["a", "b", "c"]


def test_reset_keeps_what_is_asked(spark, tmp_path):
    state = tmp_path / "state"
    for turn in range(3):
        state.mkdir(exist_ok=True)
        (state / "glossary.json").write_text(str(turn))
        (state / "status.json").write_text("{}")
        old = collect.reset_state(spark, str(state), "20260101", archive=turn < 2, keep=("glossary.json", "none.json"))
        assert (state / "glossary.json").read_text() == str(turn) and not (state / "status.json").exists()
        assert all((state / f).is_dir() for f in collect.STATE_FOLDERS)
        assert old == (None, f"{state}_archive_20260101", f"{state}_archive_20260101_1")[(turn + 1) % 3]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["state", "state_archive_20260101", "state_archive_20260101_1"]
    with pytest.raises(FileNotFoundError):
        collect.reset_state(spark, str(tmp_path / "none"), "1")


def test_repair_asks_only_for_what_is_wrong(spark):
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, 9), (None, 5)], "k int, v int")
    out = models.repair_rounds(rows, "k", lambda r: r.where("v > 0"), lambda bad: bad.withColumn("v", F.col("v") - 1), 2)
    assert {(r.k, r.v) for r in out.collect()} == {(1, 0), (2, 0), (3, 7), (None, 5)}
    assert models.repair_rounds(rows.limit(0), "k", lambda r: r, lambda bad: bad).count() == 0


def test_csv_fields_and_rows(spark):
    hits = spark.createDataFrame([(1, 2, "b", 'q"q', "t", "user", None), (1, 1, "a,a", "x\ny", "t", None, "n")], "c int, position int, source string, target string, type string, origin string, note string")
    assert writers.hits_csv(hits, "c").first().csv == '日语,中文,类型,来源,备注\n"a,a","x\ny",t,自动,n\nb,"q""q",t,用户,\n'
    texts = spark.createDataFrame([("h\na\n\n \n　\nb",), ("\n\nh",), ("",)], "t string")
    assert [r.n for r in texts.select(writers.csv_rows(F.col("t")).alias("n")).collect()] == [2, 0, 0]


def test_status_of_an_empty_run(spark):
    fields = "stage_index int, stage_total int, stage_name string, total int, done int, failed int, skipped int, terms int, locked int, open_conflicts int, issues int, misaligned int, compliant boolean, message string"
    row = spark.createDataFrame([(tuple([None] * 14),)], f"run struct<{fields.replace(' ', ':').replace(',:', ',')}>")
    assert row.select(lifecycle.status_document(F.col("run")).alias("d")).first().d.startswith("### Stage 1/0 · \n\n- chunks: 0/0 (0 failed, 0 skipped)\n")
