"""The glossary as a stateful stream, against the closed form over all batches at once, with restarts and a batch run twice."""

import json
import random
import shutil

import pytest

from textloom.operators import store
from textloom.streaming import terms

TERM = "source string, target string, reading string, type string, gender string, aliases array<string>, note string, origin string, locked boolean, status string, first_chunk long"
CANDIDATE = "arrival long, source string, target string, reading string, type string, gender string, aliases array<string>, note string, origin string, locked boolean, chunk long, phase string"


def made(seed):
    rng = random.Random(seed)
    pick = lambda *xs: rng.choice(xs)
    held = [(f"s{k}", f"t{k % 3}", pick("", "r"), pick("术语", "人物"), "", ["b"][: k % 2], pick("", "n"), "auto", k % 2 == 0, "ok", k if k % 3 else None) for k in range(5)]
    name = lambda: pick("", "　", None, "s1", "s1", *(f"{a}s{k}{a}" for k in range(12) for a in ("", " ")))
    rows = [{"arrival": k, "source": name(), "target": pick("", None, "t0", " t1", "t2　"), "reading": pick("", None, f"r{k}"), "type": pick("", None, "术语", "地名 ", "odd"), "gender": pick("", f"g{k}"), "aliases": pick(None, [], ["a", " ", "s1", f"x{k} "]), "note": pick("", f"n{k}"), "origin": pick("user", "auto", "auto", "odd", None), "locked": pick(True, False, False, None), "chunk": pick(None, k // 5), "phase": pick("pre", "post")} for k in range(150)]
    return held, rows


def plain(rows, *names):
    return sorted(repr(tuple(r[n] for n in names)) for r in rows)


@pytest.mark.parametrize("policy", ["A", "B", "D"])
def test_stream_is_the_closed_form(spark, tmp_path, policy):
    held, rows = made(3)
    given, source, out, state = spark.createDataFrame(held, TERM), tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    for batch in range(3):  # the query ends and starts again between batches
        part = rows[batch * 50 : batch * 50 + 50]
        random.Random(batch).shuffle(part)
        (source / f"{batch}.json").write_text("\n".join(map(json.dumps, part)))
        stream = spark.readStream.schema(CANDIDATE).json(str(source))
        q = terms.glossary_stream(stream, given, out, state, policy)
        assert q.awaitTermination(120) and q.exception() is None
    every = spark.createDataFrame([tuple(r[c.split(" ")[0]] for c in CANDIDATE.split(", ")) for r in rows], CANDIDATE)
    names = ("arrival", "source", "target", "outcome")
    assert plain(spark.read.parquet(out).collect(), *names) == plain(store.upsert_outcomes(given, every, policy).collect(), *names)
    fields = [c.split(" ")[0] for c in TERM.split(", ")]
    assert plain(terms.current_terms(spark, state).collect(), *fields) == plain(store.upserted(given, every, policy).collect(), *fields)
    log = [r for r in store.upsert_log(given, every, policy).collect() if not r.resolved]
    opened = terms.open_conflicts(spark, state).collect()
    assert plain(opened, "source", "arrival", "proposed_target", "chunk", "phase") == plain(log, "source", "arrival", "proposed_target", "chunk", "phase")


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    held, rows = made(4)
    given, source, out, state = spark.createDataFrame(held, TERM), tmp_path / "in", str(tmp_path / "out"), tmp_path / "state"
    source.mkdir()
    for batch in range(2):
        (source / f"{batch}.json").write_text("\n".join(map(json.dumps, rows[batch * 70 : batch * 70 + 70])))
        q = terms.glossary_stream(spark.readStream.schema(CANDIDATE).json(str(source)), given, out, str(state))
        assert q.awaitTermination(120)
    before, known = plain(spark.read.parquet(out).collect(), "arrival", "outcome"), plain(terms.current_terms(spark, str(state)).collect(), "source", "target", "aliases")
    for f in ("1", ".1.crc"):  # as if the program had died before the last batch was noted
        (state / "commits" / f).unlink(missing_ok=True)
    shutil.rmtree(source / "gone", ignore_errors=True)
    q = terms.glossary_stream(spark.readStream.schema(CANDIDATE).json(str(source)), given, out, str(state))
    assert q.awaitTermination(120)
    assert plain(spark.read.parquet(out).collect(), "arrival", "outcome") == before and len(before) == 140
    assert plain(terms.current_terms(spark, str(state)).collect(), "source", "target", "aliases") == known


def test_a_batch_reads_only_its_own_files(spark, tmp_path):
    """The plan of a batch has one file scan, of the batch's input, and no scan of what was written before."""
    held, rows = made(5)
    source = tmp_path / "in"
    source.mkdir()
    (source / "0.json").write_text("\n".join(map(json.dumps, rows)))
    q = terms.glossary_stream(spark.readStream.schema(CANDIDATE).json(str(source)), spark.createDataFrame(held, TERM), str(tmp_path / "out"), str(tmp_path / "state"))
    assert q.awaitTermination(120)
    plan = q._jsq.explainInternal(False)
    assert plan.count("FileScan") + plan.count("BatchScan") <= 1 and "parquet(" not in plan.lower()
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] > 0
