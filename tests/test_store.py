"""The glossary's write path against a fold that takes candidates one by one, and the rules of runs by hand."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.functions.text import is_heading, numbers
from textloom.operators import quality, runs, store

TERM = "source string, target string, reading string, type string, gender string, aliases array<string>, note string, origin string, locked boolean, status string, first_chunk long"
CANDIDATE = "arrival long, source string, target string, reading string, type string, gender string, aliases array<string>, note string, origin string, locked boolean, chunk long, phase string"


def kind(x):
    x = (x or "").strip()
    return "术语" if not x else x if x in store.TYPES else "其他"


def cleaned(aliases, source):
    return sorted({a.strip() for a in aliases if a and a.strip() and a.strip() != source})


def folded(terms, candidates, policy):
    terms, log, outcomes = {t["source"]: dict(t) for t in terms}, [], []
    for c in sorted(candidates, key=lambda c: c["arrival"]):
        source, target = (c["source"] or "").strip(), (c["target"] or "").strip()
        had = terms.get(source)
        if not source or not target:
            outcome = "invalid"
        elif policy == "D" or policy == "A" and had is None:
            outcome = "rejected_by_policy"
        elif had is None:
            outcome, origin = "inserted", c["origin"] if c["origin"] in ("user", "auto") else "auto"
            terms[source] = {"source": source, "target": target, "reading": c["reading"] or "", "type": kind(c["type"]), "gender": c["gender"] or "", "aliases": cleaned(c["aliases"] or [], source), "note": c["note"] or "", "origin": origin, "locked": origin == "user" or bool(c["locked"]), "status": "ok", "first_chunk": c["chunk"]}
        elif had["target"] == target:
            outcome = "unchanged"
            had["aliases"] = cleaned(had["aliases"] + (c["aliases"] or []), source)
            for field in ("reading", "gender", "note"):
                had[field] = had[field] or c[field] or ""
            if had["type"] == "术语" and (c["type"] or "") not in ("", "术语"):
                had["type"] = kind(c["type"])
        else:
            outcome = "rejected_by_lock" if had["locked"] else "conflict"
            log.append((len(log) + 1, source, had["target"], target, c["chunk"], c["phase"], had["locked"], "rejected_by_lock" if had["locked"] else "", c["arrival"]))
            if not had["locked"]:
                had["status"] = "conflict"
        outcomes.append((c["arrival"], outcome))
    return terms, log, outcomes


@pytest.mark.parametrize("policy", "ABCD")
def test_upsert_is_the_fold(spark, policy):
    rng = random.Random(7)
    pick = lambda *xs: rng.choice(xs)
    name = lambda: pick("", "　", " ", None, *(f"{a}s{k}{a}" for k in range(12) for a in ("", " ", "　")))
    terms = [{"source": f"s{k}", "target": f"t{k % 3}", "reading": pick("", "r"), "type": pick("术语", "人物"), "gender": "", "aliases": [" b ", "s0"][: k % 3], "note": pick("", "n"), "origin": pick("user", "auto"), "locked": k % 2 == 0, "status": "ok", "first_chunk": pick(None, k)} for k in range(5)]
    candidates = [{"arrival": k, "source": name(), "target": pick("", None, "t0", " t1", "t2　"), "reading": pick("", None, f"r{k}"), "type": pick("", None, "术语", "地名 ", "odd"), "gender": pick("", f"g{k}"), "aliases": pick(None, [], ["a", " ", "s1", f"x{k} "]), "note": pick("", f"n{k}"), "origin": pick("user", "auto", "auto", "odd", None), "locked": pick(True, False, False, None), "chunk": pick(None, k // 5), "phase": pick("pre", "post")} for k in range(200)]
    rng.shuffle(candidates)
    a = spark.createDataFrame([tuple(t.values()) for t in terms], TERM)
    b = spark.createDataFrame([tuple(c.values()) for c in candidates], CANDIDATE)
    want, log, outcomes = folded(terms, candidates, policy)
    assert sorted((r.arrival, r.outcome) for r in store.upsert_outcomes(a, b, policy).collect()) == sorted(outcomes)
    assert {r.source: r.asDict() for r in store.upserted(a, b, policy).collect()} == want
    assert [tuple(r) for r in store.upsert_log(a, b, policy).orderBy("id").collect()] == log


def test_choices_of_a_conflict(spark):
    log = spark.createDataFrame([(1, "a", "p1", 5, False), (2, "a", "p2", 6, False), (3, "a", "p3", 7, True), (4, "b", "p4", 8, True)], "id long, source string, proposed_target string, arrival long, resolved boolean")
    terms = spark.createDataFrame([("a", "ta"), ("b", "tb")], "source string, target string")
    picks = [("a", "named", None, None), ("a", None, "existing", None), ("a", "", "proposed", None), ("a", "", "proposed", 1), ("a", "", "proposed", 4), ("b", "", "proposed", None), ("c", "x", None, None)]
    got = store.choices(spark.createDataFrame(picks, "source string, target string, take string, conflict_id long"), terms, log)
    assert sorted(tuple(r) for r in got.collect()) == [("a", "named"), ("a", "p1"), ("a", "p2"), ("a", "ta")]


def test_prompt_rows_put_locked_terms_first(spark):
    rows = [(1, "z", True, 1, None), (1, "a", False, 9, 3), (1, "b", False, 9, 2), (1, "c", False, 1, 1), (2, "x", False, 0, None)]
    hits = spark.createDataFrame([(d, s, "t", "k", lk, [], "", "ok", h, c) for d, s, lk, h, c in rows], "doc_id long, source string, target string, type string, locked boolean, aliases array<string>, note string, status string, hits long, first_chunk long")
    got = lambda n: [(r.doc_id, r.position, r.source, r.truncated) for r in store.prompt_rows(hits, n).orderBy("doc_id", "position").collect()]
    assert got(2) == [(1, 1, "b", True), (1, 2, "z", True), (2, 1, "x", False)]
    assert len(got(0)) == 5 and not any(x[3] for x in got(0))


def test_headings_and_numbers_of_any_digits(spark):
    texts = ["第１章", "　第12章 序", "第十二回", "第٣部", "１. 序", "第章", "第１版", "はじめに", "x" * 61, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    assert [r.h for r in df.orderBy("i").select(is_heading(F.col("t")).alias("h")).collect()] == [True, True, True, True, True, False, False, True, False, False]
    texts = ["１２ 3", "①② x⑩", "m² ½", "٣ ۴", "㊿ 𝟙𝟚", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    assert [r.n for r in df.orderBy("i").select(numbers(F.col("t")).alias("n")).collect()] == [["12", "3"], ["12", "10"], ["2", "1", "2"], ["٣", "۴"], ["50", "12"], [], None]


def test_katakana_runs(spark):
    docs = spark.createDataFrame([(1, "アイウ アイウ カナ"), (2, "アイウ ラーメン")], "doc_id long, text string")
    assert [tuple(r) for r in quality.katakana_runs(docs).collect()] == [("アイウ", 3)]


def test_points_and_polygons(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    points = F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in square))
    df = spark.createDataFrame([(5.0, 5.0), (10.0, 5.0), (5.0, 0.0), (11.0, 5.0), (-1.0, 5.0), (5.0, 10.5)], "x double, y double")
    assert [r.p for r in df.select(runs.in_polygon(F.col("x"), F.col("y"), points).alias("p")).collect()] == [1, 0, 0, -1, -1, -1]


def test_settings():
    assert runs.merged_settings({"a": 1, "b": {"c": 2, "d": {"e": 3}}}, {"b": {"c": 4, "d": {"f": 5}}, "g": {"h": 6}}) == {"a": 1, "b": {"c": 4, "d": {"e": 3, "f": 5}}, "g": {"h": 6}}


def test_events_with_odd_fields_are_left_out(spark):
    rows = [("a", "1", "2"), ("a", "x", "2"), ("a", "1", "2.5"), ("b", "1", "2"), ("a", None, "3"), ("a", "-1", "4")]
    df = spark.createDataFrame(rows, "event_type string, chunk string, seq string")
    assert [(r.chunk, r.seq) for r in runs.valid_events(df, ("a",)).collect()] == [(1, 2), (-1, 4)]
