"""Hand-computed cases of block owners, table cells and imports."""

import pytest

from textloom.operators import cells, imports


def test_owners_by_kind_then_number(spark):
    lines = spark.createDataFrame([(1, 0, 0.9, 0, 0, 10, 10), (1, 1, 0.05, 0, 0, 1, 1), (1, 2, None, 50, 50, 52, 52), (1, 3, 0.5, 90, 90, 91, 91)], "page long, box int, score double, x0 long, y0 long, x1 long, y1 long")
    blocks = spark.createDataFrame([(1, 1, "text", 0, 0, 20, 20), (1, 0, "ad", 0, 0, 60, 60), (1, 2, "text", 0, 0, 20, 20), (1, 3, "table", 40, 40, 60, 60)], "page long, block int, kind string, x0 long, y0 long, x1 long, y1 long")
    assert sorted(tuple(r) for r in cells.line_owners(lines, blocks).collect()) == [(1, 0, "text", 1), (1, 2, "ad", 0), (1, 3, "independent", None)]
    assert cells.line_owners(lines, blocks.limit(0)).where("kind = 'independent'").count() == 3


def test_texts_go_to_the_nearest_cell(spark):
    texts = spark.createDataFrame([(1, 0, "b", 0, 10, 2, 12), (1, 1, "a", 0, 0, 2, 2), (1, 2, "x", 99, 99, 100, 100), (1, 3, "c", 12, 0, 14, 2)], "page long, box int, text string, x0 long, y0 long, x1 long, y1 long")
    grid = spark.createDataFrame([(1, 0, 0, 0, 13, 20), (1, 1, 10, 0, 18, 4), (1, 2, 30, 30, 40, 40)], "page long, cell int, x0 long, y0 long, x1 long, y1 long")
    assert sorted(tuple(r) for r in cells.cell_texts(texts, grid).collect()) == [(1, 0, "ab"), (1, 1, "c"), (1, 2, "")]


def test_cells_that_are_one_grow_in_order(spark):
    rows = [(1, 0, 0, 0, 10, 10), (1, 1, 4, 0, 14, 10), (1, 2, 8, 0, 18, 10), (1, 3, 50, 0, 60, 10), (2, 0, 0, 0, 0, 0)]
    got = sorted(tuple(r) for r in cells.merged_cells(spark.createDataFrame(rows, cells.BOX)).collect())
    assert got == [(1, 0, 3, 0, 0, 18, 10), (1, 3, 1, 50, 0, 60, 10), (2, 0, 1, 0, 0, 0, 0)]


ROWS = [("a", "x", 0), ("a", "y", 1), ("n", "p", 2), ("n", "q", 3), (" n ", "p", 4), ("", "z", 5), (None, "z", 6), ("m", None, 7)]


@pytest.mark.parametrize("overwrite", [True, False])
def test_imports_are_the_fold(spark, overwrite):
    terms, want = {"a": "x"}, []
    for s, t, _ in ROWS:
        s, t = (s or "").strip(), (t or "").strip()
        if not s or not t:
            want.append("skipped")
        elif s not in terms:
            terms[s] = t
            want.append("added")
        elif overwrite:
            terms[s] = t
            want.append("updated")
        else:
            want.append("updated" if terms[s] == t else "skipped")
    had = spark.createDataFrame([("a", "x")], "source string, target string")
    new = spark.createDataFrame(ROWS, "source string, target string, arrival long")
    assert [r.outcome for r in imports.import_outcomes(had, new, overwrite).orderBy("arrival").collect()] == want
    assert {r.source: r.target for r in imports.imported(had, new, overwrite).collect()} == terms


def test_conflicts_of_overwritten_terms_are_settled(spark):
    log = spark.createDataFrame([("a", False), ("b", False)], "source string, resolved boolean")
    out = spark.createDataFrame([("a", "updated"), ("b", "added")], "source string, outcome string")
    after = imports.superseded(log, out)
    assert {r.source: r.resolved for r in after.collect()} == {"a": True, "b": False}
    issues = spark.createDataFrame([("warn",)], "severity string")
    rate = spark.createDataFrame([(0.98,)], "rate double")
    assert {r.gate: r.passed for r in imports.gates(issues, rate, after).collect()} == {"alignment": True, "terms": True, "conflicts": False}
    assert all(r.passed for r in imports.gates(issues.limit(0), rate.limit(0), after.limit(0)).collect())


def test_usage_of_two_runs(spark):
    kind = "level string, name string, calls long, tokens long"
    a, b = spark.createDataFrame([("tier", "x", 1, 10)], kind), spark.createDataFrame([("tier", "x", 2, 5), ("stage", "s", 1, 1)], kind)
    assert sorted(tuple(r) for r in imports.usage_merge(a, b).collect()) == [("stage", "s", 1, 1), ("tier", "x", 3, 15)]
