"""Staged readers, polygons, grids, table structure, upright runs and canonical JSON against plain versions of themselves."""

import hashlib
import json
import math
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import canonical, punctuation
from textloom.functions.text import archive_stamp, time_text
from textloom.operators import classes, grids, layout, lifecycle, matching, metered, polygons, quality, runs, scanner, tables, upright
from textloom.sources import readers, writers


def test_each_reader_gets_just_its_lines(spark):
    rng = random.Random(3)
    rows = [(k // 10, k % 10, rng.choice([0, 1, 2, 3, 3, 3, None]), rng.randint(1, 200), rng.randint(1, 200), rng.choice([5, 24, 25, 44, 45, 97, 98, 150])) for k in range(400)]
    calls = {k: spark.sparkContext.accumulator(0) for k in (30, 50, 100)}

    def reader(model):
        def read(given):
            @F.udf("string")
            def said(n, half):
                calls[model].add(1)
                return None if n == 5 else f"{model}{'_lr'[half]}".ljust(n, ".")

            return given.withColumn("text", said.asNondeterministic()("n", "half"))

        return read

    lines = spark.createDataFrame(rows, "page int, line int, predicted int, width int, height int, n int").repartition(4)
    got = {(r.page, r.line): (r.text, r.model) for r in runs.cascade(lines, {k: reader(k) for k in calls}).collect()}
    want, asked = {}, dict.fromkeys(calls, 0)
    for page, line, kind, w, h, n in rows:
        text = lambda model, half=0: "" if n == 5 else f"{model}{'_lr'[half]}".ljust(n, ".")  # noqa: B023, E731
        model = {3: 30, 2: 50}.get(kind, 100)
        asked[model] += 1
        while model < 100 and len(text(model)) >= {30: 25, 50: 45}[model]:
            model = {30: 50, 50: 100}[model]
            asked[model] += 1
        if model == 100 and len(text(100)) >= 98 and h < w:
            asked[100] += 2
            want[page, line] = (text(100, 1) + text(100, 2), 200)
        else:
            want[page, line] = (text(model), model)
    assert got == want and {k: v.value for k, v in calls.items()} == asked


def plain_place(x, y, points):
    """1 in, -1 out, 0 on a level or upright side, by going round the corners."""
    n, inside = len(points), False
    for i in range(n):
        (px, py), (sx, sy) = points[i], points[(i + 1) % n]
        if (py == sy == y and min(px, sx) <= x <= max(px, sx)) or (px == sx == x and min(py, sy) <= y <= max(py, sy)):
            return 0
        if min(py, sy) < y <= max(py, sy) and x <= max(px, sx) and (px == sx or x <= (y - py) * (sx - px) / (sy - py) + px):
            inside = not inside
    return 1 if inside else -1


def plain_distance(x, y, points):
    place = plain_place(x, y, points)
    best = math.inf
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1]):
        d = np.array([bx - ax, by - ay], float)
        t = 0 if not d.any() else min(1, max(0, ((x - ax) * d[0] + (y - ay) * d[1]) / (d @ d)))
        best = min(best, math.hypot(x - ax - t * d[0], y - ay - t * d[1]))
    return best * place if place else 0.0


def star(rng, corners):
    """A polygon with dents: corners around a middle at any distance."""
    x, y = rng.uniform(0, 900), rng.uniform(0, 900)
    return [(round(x + r * math.cos(a)), round(y + r * math.sin(a))) for k in range(corners) for r, a in [(rng.uniform(20, 400), 2 * math.pi * k / corners)]]


@pytest.mark.parametrize("tile", [64, 256, 5000])
def test_owners_in_dented_polygons(spark, tile):
    rng = random.Random(8)
    lines = [(k % 3, k, rng.choice([None, 0.05, 0.1, 0.9]), x, y, x + rng.randint(0, 40), y + rng.randint(0, 40)) for k in range(300) for x, y in [(rng.randint(-200, 1200), rng.randint(-200, 1200))]]
    blocks = [(k % 3, k // 3, rng.choice(["text", "text", "ad", "table", "other"]), star(rng, rng.randint(3, 9))) for k in range(45)]
    blocks += [(0, 90, "text", None), (1, 91, "text", []), (2, 92, "text", [(5, 5)])]
    df = spark.createDataFrame([(p, b, k, None if s is None else [{"x": float(x), "y": float(y)} for x, y in s]) for p, b, k, s in blocks], "page long, block long, kind string, points array<struct<x double, y double>>")
    ls = spark.createDataFrame(lines, "page long, box long, score double, x0 long, y0 long, x1 long, y1 long")
    got = {r.box: (r.kind, r.block) for r in polygons.owners(ls, df, tile=tile).collect()}
    want = {}
    for page, box, score, x0, y0, x1, y1 in lines:
        if score is not None and score < 0.1:
            continue
        x, y = (x0 + x1) // 2, (y0 + y1) // 2
        fits = []
        for p, b, kind, s in blocks:
            if p != page or not s or kind == "other":
                continue
            box_fits = min(a for a, _ in s) <= x <= max(a for a, _ in s) and min(a for _, a in s) <= y <= max(a for _, a in s)
            if plain_place(x, y, s) >= 0 if kind == "text" else box_fits:
                fits.append((("text", "ad", "table").index(kind), b, kind))
        want[box] = (min(fits)[2], min(fits)[1]) if fits else ("independent", None)
    assert got == want and len({k for k, _ in want.values()}) == 4
    plan = polygons.owners(ls, df, tile=tile)._jdf.queryExecution().optimizedPlan().toString()
    join = next(x for x in plan.split("\n") if "Join" in x)
    assert join.count(" = ") == 3


def test_signed_distance(spark):
    rng = random.Random(9)
    rows = [(rng.uniform(-100, 1000), rng.uniform(-100, 1000), star(rng, rng.randint(1, 8))) for _ in range(80)]
    rows += [(float(x), float(y), [(0, 0), (10, 0), (10, 0), (10, 10), (0, 10)]) for x in (-3, 0, 5, 10, 14) for y in (-4, 0, 5, 10, 13)]
    df = spark.createDataFrame([(k, x, y, [{"x": float(a), "y": float(b)} for a, b in s]) for k, (x, y, s) in enumerate(rows)], "k int, x double, y double, points array<struct<x double, y double>>")
    got = {r.k: r.d for r in df.select("k", polygons.signed_distance(F.col("x"), F.col("y"), F.col("points")).alias("d")).collect()}
    assert all(abs(got[k] - plain_distance(*r)) < 1e-9 for k, r in enumerate(rows))


def test_peaks_with_ties_and_borders(spark):
    rng = np.random.default_rng(4)
    heat = rng.integers(-2, 4, (3, 12, 9)) / 4.0
    rows = [(p, "a", y, x, None if (p, y, x) == (0, 0, 0) else float(v)) for (p, y, x), v in np.ndenumerate(heat) if (y * 7 + x) % 11]
    known = {(p, y, x): v for p, _, y, x, v in rows if v is not None}
    want = {(p, y, x, v) for (p, y, x), v in known.items() if v >= max([0] + [known.get((p, y + a, x + b), 0) for a in (-1, 0, 1) for b in (-1, 0, 1)])}
    df = spark.createDataFrame(rows, "page int, kind string, y int, x int, score double").repartition(3)
    found = grids.peaks(df)
    assert {(r.page, r.y, r.x, r.score) for r in found.collect()} == want
    best = sorted((r.page, r["rank"], r.y, r.x) for r in grids.leading(found, 4, 0.25).collect())
    assert best == [(p, i + 1, y, x) for p in range(3) for i, (_, y, x) in enumerate(sorted((-v, y, x) for q, y, x, v in want if q == p and v >= 0.25)[:4])]


def plain_table(tokens):
    taken, out, row, col = {}, [], -1, 0
    for token, down, wide, text in tokens:
        if token == "row":
            row, col = row + 1, 0
        elif token == "cell":
            row = r = max(row, 0)
            down, wide = max(1, down or 1), max(1, wide or 1)
            while taken.get(col, 0) > r:
                col += 1
            out.append((r, r + down - 1, col, col + wide - 1, text or ""))
            for c in range(col, col + wide):
                taken[c] = max(taken.get(c, 0), r + down)
            col += wide
    return out


def test_table_structure(spark):
    rng = random.Random(6)
    pages = [[(rng.choice(["row", "cell", "cell", "cell", "?"]), rng.choice([None, 0, 1, 1, 2, 3]), rng.choice([None, 1, 1, 2, 4]), rng.choice([None, f"t{k}"])) for k in range(rng.randint(0, 25))] for _ in range(40)]
    rows = [(p, k, *t) for p, ts in enumerate(pages) for k, t in enumerate(ts)]
    rng.shuffle(rows)
    got = {}
    for r in tables.decoded(spark.createDataFrame(rows, "page int, at int, token string, rowspan int, colspan int, text string")).orderBy("page", "box").collect():
        got.setdefault(r.page, []).append((r.row0, r.row1, r.col0, r.col1, r.text))
    assert got == {p: plain_table(t) for p, t in enumerate(pages) if plain_table(t)}


def test_structure_is_rendered_as_it_was(spark):
    """Tokens of a table without overlaps give back the table's HTML."""
    tokens = [("row", 1, 1, ""), ("cell", 2, 1, "a"), ("cell", 1, 2, "b<"), ("row", 1, 1, ""), ("cell", 1, 1, "c"), ("cell", 1, 1, "d"), ("row", 1, 1, ""), ("cell", 1, 3, "e")]
    cells = tables.decoded(spark.createDataFrame([(1, k, *t) for k, t in enumerate(tokens)], "page long, at int, token string, rowspan int, colspan int, text string"))
    html = tables.rendered(cells).first().html
    assert html == '<table border="1"><tr><td colspan="1" rowspan="2">a</td><td colspan="2" rowspan="1">b&lt;</td></tr><tr><td>c</td><td>d</td></tr><tr><td colspan="3" rowspan="1">e</td></tr></table>'


def plain_upright(width, height, boxes):
    """Bands, parts and flags from a picture of the ink, place by place."""
    if height <= width:
        return []
    ink = np.zeros((height, width), int)
    for x0, y0, x1, y1 in boxes:
        ink[max(0, y0) : max(0, y1), max(0, x0) : max(0, x1)] = 1
    found, rows = [], ink.any(1)
    for y in range(height):
        if rows[y] and found and y - found[-1][1] < 5:
            found[-1][1] = y + 1
        elif rows[y]:
            found.append([y, y + 1])
    out = []
    for k, (a, b) in enumerate(found):
        m = max(2, int((b - a) * 0.1))
        profile = ink[max(0, a - m) : b + m].sum(0)
        dark = profile > profile.max() * 0.1
        parts = sum(d and not (x and dark[x - 1]) for x, d in enumerate(dark))
        out.append((k, a, b, parts, bool(width >= 30 and b - a >= 5 and parts >= 2 and b - a <= width * 0.75)))
    return out


def plain_parts(height, found):
    out, i = [], 0
    if not any(f[4] for f in found):
        return out
    while i < len(found):
        _, a, b, _, flag = found[i]
        if flag:
            m = max(5, int((b - a) * 0.5))
            out.append((max(0, a - m), min(height, b + m), True))
            i += 1
            continue
        first = i
        while i < len(found) and not found[i][4]:
            i += 1
        start = found[first - 1][2] if first else found[0][1]
        out.append((start, found[i][1] if i < len(found) else found[-1][2], False))
    return out


def test_upright_runs_against_a_picture(spark):
    rng = random.Random(12)
    lines, ink, want, parts = [], [], {}, {}
    for k in range(60):
        width, height = rng.choice([20, 30, 45, 60]), rng.choice([40, 200, 300])
        lines.append((k, width, height))
        boxes, y = [], rng.randint(-3, 10)
        while y < height + 5:
            tall, x = rng.choice([2, 4, 8, 20, 45]), rng.randint(-2, 6)
            for _ in range(rng.randint(1, 3)):
                wide = rng.randint(3, 20)
                boxes.append((x, y, x + wide, y + tall))
                x += wide + rng.choice([0, 0, 1, 5])
            y += tall + rng.choice([0, 1, 4, 5, 9])
        ink += [(k, *b) for b in boxes]
        want[k] = plain_upright(width, height, boxes)
        parts[k] = plain_parts(height, want[k])
    ls, bs = spark.createDataFrame(lines, "line int, width int, height int"), spark.createDataFrame(ink, "line int, x0 int, y0 int, x1 int, y1 int").repartition(3)
    found = upright.upright_runs(ls, bs)
    got = {}
    for r in found.orderBy("line", "band").collect():
        got.setdefault(r.line, []).append((r.band, r.b0, r.b1, r.parts, r.upright))
    assert got == {k: v for k, v in want.items() if v} and any(f[4] for v in want.values() for f in v)
    cut = {}
    for r in upright.reading_parts(ls, found).orderBy("line", "part").collect():
        cut.setdefault(r.line, []).append((r["from"], r["to"], r.upright))
    assert cut == {k: v for k, v in parts.items() if v}
    assert [r[0] for r in spark.createDataFrame([("ab", "abc"), ("ab", "cd"), ("ab", "c")], "w string, p string").select(upright.better(F.col("w"), F.col("p"))).collect()] == ["abc", "ab", "ab"]


def test_canonical_json(spark):
    texts = ['{"b": 1, "a": {"d": [1, 2], "c": null}}', '{"a":{"c":null,"d":[1,2]},"b":1}', '{"a":{"c":null,"d":[1,2.0]},"b":1}', "{", None, "", "1", "1.0", '{"a":1,"a":2}', '"\\u00e9\\n/"', '{"\\ue000":1,"\\ud83d\\ude00":2}', '"\\ud800"']
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = [(r.c, r.h) for r in df.select("k", canonical.canonical_json(F.col("t")).alias("c"), canonical.json_hash(F.col("t")).alias("h")).orderBy("k").collect()]
    assert got[0] == got[1] != got[2] and got[6] != got[7] and got[0][1] == hashlib.sha256(got[0][0].encode()).hexdigest()
    assert [c for c, _ in got] == ['{"a":{"c":null,"d":[1,2]},"b":1}', '{"a":{"c":null,"d":[1,2]},"b":1}', '{"a":{"c":null,"d":[1,2.0]},"b":1}', None, None, None, "1", "1.0", '{"a":2}', '"é\\n/"', '{"":1,"😀":2}', '"?"']


@settings(max_examples=100, deadline=None)
@given(v=st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(exclude_categories=["Cs"]), max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(st.characters(exclude_categories=["Cs"]), max_size=3), x, max_size=3), max_leaves=8))
def test_order_of_names_does_not_matter(v):
    def turned(x):
        return {k: turned(x[k]) for k in reversed(list(x))} if isinstance(x, dict) else [turned(y) for y in x] if isinstance(x, list) else x

    assert canonical._ordered(json.dumps(v)) == canonical._ordered(json.dumps(turned(v), indent=2, ensure_ascii=False))


# Figures of a write, files by element, encodings, terms in one pass

CALLS = "id int, tier string, stage string, prompt_tokens long, completion_tokens long, total_tokens long, cache_hit_tokens long, cache_miss_tokens long"


def test_figures_come_with_the_write(spark, tmp_path):
    rows = [(k, "fast" if k % 3 else "strong", "draft" if k % 2 else None, k, 2 * k, 3 * k, k // 2, k - k // 2) for k in range(50)]
    seen, path = spark.sparkContext.accumulator(0), str(tmp_path / "calls")

    @F.udf("int")
    def passed(x):
        seen.add(1)
        return x

    calls = spark.createDataFrame(rows, CALLS).repartition(3).withColumn("id", passed.asNondeterministic()("id"))
    groups = {"tier": ("fast", "strong", "none"), "stage": ("draft",)}
    for run, part in (("a", calls.where("id < 20")), ("b", calls.where("id >= 20")), ("b", calls.where("id >= 20"))):
        metered.write_calls(part, path, run, groups, lambda df: df.repartition("tier").sortWithinPartitions("id"))
    assert seen.value == 3 * 50  # each write passes over its rows once
    got = {(r.level, r.name): (r.calls, r.prompt_tokens, r.total_tokens, r.cache_hit_rate) for r in metered.usage(spark, path).collect()}
    one = lambda rs: (len(rs), sum(r[3] for r in rs), sum(r[5] for r in rs), round(sum(r[6] for r in rs) / max(1, sum(r[3] for r in rs)), 4) if rs else 0.0)
    assert got == {("tier", "fast"): one([r for r in rows if r[1] == "fast"]), ("tier", "strong"): one([r for r in rows if r[1] == "strong"]), ("tier", "none"): one([]), ("stage", "draft"): one([r for r in rows if r[2]])}
    assert spark.read.parquet(path).count() == 50
    with pytest.raises(RuntimeError, match="20 rows became 10"):
        metered.write_calls(calls.where("id < 20"), path, "c", groups, lambda df: df.where("id % 2 = 0"))
    assert spark.read.parquet(path).count() == 50 and metered.usage(spark, path).where("name = 'fast'").first().calls == one([r for r in rows if r[1] == "fast"])[0]


def test_layout_files_are_cut_by_page(spark, tmp_path):
    line = '<LINE X="{x}" Y="2" WIDTH="3" HEIGHT="4" CONF="0.5" STRING="日本{x}"/>'
    page = lambda k: f'<PAGE IMAGENAME="p{k}.jpg" WIDTH="9"><TEXTBLOCK>{line.format(x=k)}\n{line.format(x=k + 1)}</TEXTBLOCK>{line.format(x=k + 2)}</PAGE>'
    xml = '<?xml version="1.0" encoding="utf-8"?>\n<OCRDATASET>\n' + "\n".join(map(page, range(200))) + "\n</OCRDATASET>\n"
    (tmp_path / "a.xml").write_text(xml)
    (tmp_path / "b.xml").write_text('<OCRDATASET><PAGE IMAGENAME="broken"><LINE</PAGE><PAGE/></OCRDATASET>')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = readers.read_layout_pages(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 5
        rows = got.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    names = ["block", "box", "x0", "y0", "x1", "y1", "conf", "text"]
    whole = readers.layout_boxes(spark.createDataFrame([(1, xml)], "k int, x string"), "k", "x").collect()
    assert sorted(repr((r.name, *(r[n] for n in names))) for r in rows) == sorted(repr((f"p{r.page}.jpg", *(r[n] for n in names))) for r in whole)
    assert len(rows) == 600 and {r.file.rsplit("/", 1)[1] for r in rows} == {"a.xml"}


@pytest.mark.parametrize("encoding", ["utf-8", "utf-32", "shift_jis", "euc_jp", "gb18030"])
def test_files_in_old_encodings(spark, tmp_path, encoding):
    text = "日本語のテキスト。" if encoding != "gb18030" else "简体中文，𠀀和é"
    (tmp_path / "a.txt").write_bytes(text.encode(encoding))
    assert readers.read_texts(spark, str(tmp_path)).first().text == text
    # an escape sequence is ASCII, so the first encoding takes it as it is
    assert readers.decoded("日本".encode("iso2022_jp"), readers.FILE_ENCODINGS).startswith("\x1b$B")


def test_glossary_json_keeps_reading_and_gender(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps([{"source": "a", "target": "b", "reading": "r", "gender": "f"}, {"source": "　", "target": "c"}, {"source": "d", "target": " "}]))
    assert [(r.source, r.reading, r.gender) for r in readers.read_glossary_json(spark, str(tmp_path / "g.json")).collect()] == [("a", "r", "f")]


def test_shards_of_terms_share_one_scan(spark):
    rng = random.Random(2)
    words = [f"{a}{b}" for a in "猫犬鳥魚abcd" for b in "木火土xyz"]
    texts = [(k, None if k == 7 else "".join(rng.choice([*words, " ", "。", "-"]) for _ in range(60))) for k in range(40)]
    terms = spark.createDataFrame([(w, [w, w[::-1]]) for w in words], "source string, keys array<string>")
    df = spark.createDataFrame(texts, "id int, text string")
    got = matching.term_counts(df, "id", "text", terms, shard=70)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1  # 96 keys in three shards
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, matching.term_counts(df, "id", "text", terms).collect()))
    spans = matching.term_spans(df, "id", "text", terms, shard=70).collect()
    held = dict(texts)
    assert spans and all(matching.normalized(held[r.id])[r.begin : r.finish] == r.term_key for r in spans)
    merged = {}
    for r in spans:
        merged.setdefault((r.id, r.source), []).append((r.begin, r.finish))
    assert {k: matching.merged(v) for k, v in merged.items()} == {(r.id, r.source): r.n for r in got.collect()}


def test_suggested_terms(spark):
    pairs = spark.createDataFrame([(1, "ドラゴン ドラゴン ﾄﾞﾗ", "x"), (2, "ドラゴン スライム\n```\nスライム\n```\nスライム", "かな\nよ\nx"), (3, "カタカナ カタカナ カタカナ", None), (4, None, "x")], "chunk long, src string, zh string")
    terms = spark.createDataFrame([("カタカナ", "k", "", None)], "source string, target string, type string, aliases array<string>")
    assert [tuple(r) for r in scanner.suggestions(pairs.where("src is not null"), terms).collect()] == [(1, "ドラゴン", 3)]
    found = scanner.qa_issues(pairs, ["chunk"], terms, policy="A").orderBy("id").collect()
    assert [r.id for r in found] == list(range(1, len(found) + 1)) and (found[-1].kind, found[-1].severity, found[-1].chunk, found[-1].detail, found[-1].n) == ("suggestion", "info", None, "ドラゴン", 3)
    assert not any(r.kind == "suggestion" for r in scanner.qa_issues(pairs, ["chunk"], terms).collect())
    counted = quality.qa_summary(pairs.withColumnsRenamed({"chunk": "conv_id"}).withColumn("turn", F.lit(0)))
    assert {r.kind: r.n for r in counted.collect()}["residue"] == 2


def test_a_key_with_too_many_rows_ends_the_job(spark, monkeypatch):
    monkeypatch.setattr(writers, "MOST", 2)
    rows = spark.createDataFrame([(1, k, f"s{k}", "t", "", "user", "") for k in range(1, 4)], "chunk int, position int, source string, target string, type string, origin string, note string")
    assert writers.hits_csv(rows.where("position < 3"), "chunk").count() == 1
    with pytest.raises(Exception, match="more than 2 rows"):
        writers.hits_csv(rows, "chunk").collect()


def test_newer_stores_are_refused(spark):
    df = spark.createDataFrame([(1, "A"), (None, "x")], "schema_version int, policy string")
    assert [r.policy for r in lifecycle.admitted(df).collect()] == ["A", "C"]
    with pytest.raises(Exception, match="schema_version 2 is newer than 1"):
        lifecycle.admitted(df.union(spark.createDataFrame([(2, "B")], "schema_version int, policy string"))).collect()


def test_class_names(spark):
    df = spark.createDataFrame([("3",), ("line_caption",), ("キャプション",), ("no",), (None,)], "x string")
    assert [r.class_id for r in classes.named(df, "x").collect()] == [3, 3, 3, None, None]
    assert [(r.class_id, r.class_name) for r in classes.named(spark.createDataFrame([(6,), (8,)], "x int"), "x", "run").collect()] == [(6, "inline_hinv"), (None, None)]
    assert classes.classes(spark).count() == 24


def test_files_are_counted_as_they_are_rewritten(spark, tmp_path):
    df = spark.createDataFrame([("a", "x, y!"), ("b", "好，的"), ("c", None), ("d", "你好,他")], "path string, text string")
    dry = metered.normalized_files(df)
    assert not (tmp_path / "out").exists() and metered.normalized_files(df, str(tmp_path / "out")) == dry
    rows = {r.path: r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.path: r.r for r in df.select("path", punctuation.normalize_punctuation("text").alias("r")).collect()}
    assert rows == {k: v.text for k, v in want.items()}
    assert dry == {"files": 4, "changed": sum(v.n_changes > 0 for v in want.values()), "replacements": sum(v.n_changes for v in want.values())} and dry["changed"] >= 1


def test_pages_in_order_keep_their_lines(spark):
    rng = random.Random(1)
    rows = [(p, k, 30 * (k % 4), 20 * (k // 4), 30 * (k % 4) + 25, 20 * (k // 4) + 10, None if k == 5 else f"t{k}") for p in range(3) for k in range(12)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "page long, box long, x0 long, y0 long, x1 long, y1 long, text string")
    ranks = {(r.page, r.box): r["rank"] for r in layout.layout_order(df).collect()}
    texts = {(r[0], r[1]): r[6] or "" for r in rows}
    want = {p: "|".join(texts[p, k] for k in sorted(range(12), key=lambda k: ranks[p, k])) for p in range(3)}
    assert {r.page: (r.n, r.text) for r in layout.ordered_pages(df, "|").collect()} == {p: (12, t) for p, t in want.items()}


def test_annotated_files_are_cut_by_page(spark, tmp_path):
    page = lambda k: f'<PAGE IMAGENAME="{k}.jpg"><LINE TYPE="t" X="{k}" Y="1" WIDTH="2" HEIGHT="3"><CHAR MOJI="あ" X="1" Y="1" WIDTH="1" HEIGHT="1"/></LINE><BLOCK TYPE="b" X="0" Y="0" WIDTH="9" HEIGHT="9"/><LINE ERROR="x" X="0" Y="0" WIDTH="1" HEIGHT="1"/></PAGE>'
    xml = "<DATASET>\n" + "\n".join(map(page, range(30))) + "\n</DATASET>"
    (tmp_path / "a.xml").write_text(xml)
    names = ["image", "item", "kind", "type", "x0", "y0", "x1", "y1", "points", "chars"]
    got = readers.read_annotated_pages(spark, str(tmp_path)).collect()
    whole = readers.annotated_boxes(spark.createDataFrame([(1, xml)], "k int, x string"), "k", "x").collect()
    assert sorted(repr([r[n] for n in names]) for r in got) == sorted(repr([r[n] for n in names]) for r in whole) and len(got) == 60
    assert {r.name for r in got} == {f"{k}.jpg" for k in range(30)}


def test_pages_ranked_together_are_those_ranked_alone(spark, monkeypatch):
    rng, pages = np.random.default_rng(4), []
    for k in range(150):
        n, top = int(rng.integers(1, 12)), (1000, 20, 3)[k % 3]
        b = rng.integers(0, top, (n, 4))
        if k % 2:
            b[:, 2:] = b[:, :2] + rng.integers(0, 60, (n, 2))
        pages.append(b)
    want = {(k, i): int(r) for k, b in enumerate(pages) for i, r in enumerate(layout.xy_order(b))}
    for n in range(1, 12):
        same = np.array([b for b in pages if len(b) == n])
        assert layout.xy_orders(same).tolist() == [layout.xy_order(b).tolist() for b in same]
    monkeypatch.setattr(layout, "TOGETHER", 8)
    df = spark.createDataFrame([(k, i, *map(int, x)) for k, b in enumerate(pages) for i, x in enumerate(b)], "page long, box long, x0 long, y0 long, x1 long, y1 long")
    assert {(r.page, r.box): r["rank"] for r in layout.layout_order(df).collect()} == want


def test_many_pages_take_microseconds_each():
    boxes = np.random.default_rng(5).integers(0, 1000, (2000, 4, 2))
    begun = time.process_time()
    layout.xy_orders(np.concatenate([boxes, boxes + 50], 2))
    assert time.process_time() - begun < 2, "2000 pages by themselves take over 4 s"


def test_positions_may_be_any_numbers(spark, monkeypatch):
    monkeypatch.setattr(writers, "MOST", 3)
    names = "chunk int, position long, source string, target string, type string, locked boolean, aliases array<string>, note string, status string, origin string, truncated boolean"
    rows = spark.createDataFrame([(1, p, f"s{p}", "t", "", False, ["a"], None, "ok", "user", False) for p in (5_000_000, 7, None)], names)
    assert [x.split(",")[0] for x in writers.hits_csv(rows, "chunk").first().csv.split("\n")[1:-1]] == ["sNone", "s7", "s5000000"]
    got = json.loads(writers.hits_json(rows, "chunk").first().json)
    assert got["count"] == 3 and [t["source"] for t in got["terms"]] == ["sNone", "s7", "s5000000"]


def test_times_of_long_years_have_no_sign(spark):
    epochs = spark.createDataFrame([(253402300800.5,), (253402300799.0,), (777599913601.5,), (None,)], "t double")
    got = [r.t for r in epochs.select(time_text("t").alias("t")).collect()]
    stamps = [r.t for r in epochs.select(archive_stamp("t").alias("t")).collect()]
    assert got[:2] == ["10000-01-01 00:00:00", "9999-12-31 23:59:59"] and got[2].startswith("26611-") and got[3] is None
    assert stamps == [x and re.sub("[^0-9]", "", x) for x in got]


def test_bands_do_not_hang_on_the_order_of_equal_strokes(spark):
    """Strokes that reach over the end of the line become equal; each line has the same bands, and no window or second shuffle of boxes is planned."""
    lines = spark.createDataFrame([(k, 45, 400) for k in range(40)], "line long, width long, height long")
    strokes = [(k, a, y, b, e) for k in range(40) for y, e in ((50, 90), (356, 401), (356, 405), (356, 405)) for a, b in ((2, 10), (14, 22))]
    random.Random(2).shuffle(strokes)
    found = upright.upright_runs(lines, spark.createDataFrame(strokes, "line long, x0 long, y0 long, x1 long, y1 long").distinct())
    assert {tuple(r)[1:] for r in found.collect()} == {(0, 50, 90, 2, False), (1, 356, 400, 2, False)} and found.count() == 80
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Join") == 1


def test_the_place_of_a_cell_is_looked_for_once(spark):
    """A table of many columns; the search stands once in the plan's fold."""
    rows = [(1, 0, "row", None, None, "")] + [(1, k, "cell", 1 + k % 3, 1 + k % 2, str(k)) for k in range(1, 40)] + [(1, 40, "row", None, None, ""), (1, 41, "cell", None, None, "x")]
    found = tables.decoded(spark.createDataFrame(rows, "page int, at int, token string, rowspan int, colspan int, text string"))
    assert found._jdf.queryExecution().analyzed().toString().count("filter(") == 1
    want, at = [], 0
    for k in range(1, 40):
        want.append((0, k % 3, at, at + k % 2, str(k)))
        at += 1 + k % 2
    first = next(c for r0, r1, c, _, _ in want if r1 == 0)
    got = [tuple(r)[2:] for r in found.orderBy("box").collect()]
    assert got == [*want, (1, 1, first, first, "x")]
