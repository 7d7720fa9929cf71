"""Hand-computed cases of model calls and of decisions on conflicts."""

from textloom.operators import lifecycle, models

RULES = [{"stage": "S3", "chunk": 2, "respond": "{a: 1,}"}, {"tier": "fast", "respond": "quick"}, {"stage": "S3", "respond": "plain"}]


def test_first_rule_that_fits():
    call = models.fake_client(RULES)
    assert call("p", "S3", 2, "fast").text == "{a: 1,}" and call("p", "S3", 1, "fast") == ("quick", 10, 5) and call("p", "S3", None, None).text == "plain"


def test_waits_double_and_are_bounded():
    assert [models.wait(k, lambda: 0.5) for k in (1, 2, 3, 9)] == [1, 2, 4, 30] and models.wait(1, lambda: 0.0) == 0.8


def test_only_passing_failures_are_tried_again():
    waits, left = [], [models.Retryable("busy"), models.Retryable("busy"), None]

    def call():
        if (e := left.pop(0)) is not None:
            raise e
        return models.Answer("x", 1, 1)

    assert models.persistent(call, 3, waits.append) == (("x", 1, 1), 3, None) and len(waits) == 2
    left = [KeyError("k")]
    assert models.persistent(call, 3, waits.append) == (None, 1, "KeyError: 'k'")
    left = [models.Retryable("busy")] * 2
    assert models.persistent(call, 2, waits.append) == (None, 2, "busy")


def test_rows_fail_alone(spark):
    rows = spark.createDataFrame([(1, "p", "S3", 2, None), (2, "p", "S3", 5, None), (3, None, None, None, None)], "id long, prompt string, stage string, chunk long, tier string")
    rules = RULES
    got = {r.id: r for r in models.complete(rows, "id", lambda: models.fake_client(rules), as_json=True, attempts=2, sleep=lambda s: None).collect()}
    assert got[1].text == '{"a": 1}' and (got[1].prompt_tokens, got[1].calls, got[1].error) == (10, 1, None)
    assert got[2].text is None and (got[2].calls, got[2].error) == (2, "the answer is not JSON")
    assert got[3].text is None and got[3].error == "ValueError: no rule fits"
    assert models.complete(rows.limit(0), "id", lambda: models.fake_client(rules)).count() == 0


def test_decisions(spark):
    log = spark.createDataFrame([(1, "a", "x", 5, False), (2, "a", "y", 3, False), (3, "b", "z", 1, True), (4, "c", "q", 1, False)], "id long, source string, proposed_target string, arrival long, resolved boolean")
    choices = spark.createDataFrame([("a", "y")], "source string, target string")
    assert sorted((r.id, r.resolved, r.resolution) for r in lifecycle.resolved(log, choices).collect()) == [(1, True, "y"), (2, True, "y"), (3, True, None), (4, False, None)]
    terms = spark.createDataFrame([("a", "x", False, "conflict"), ("c", "p", False, "conflict")], "source string, target string, locked boolean, status string")
    assert sorted(tuple(r[c] for c in terms.columns) for r in lifecycle.decided(terms, choices, lock=True).collect()) == [("a", "y", True, "ok"), ("c", "p", False, "conflict")]
    assert [r.id for r in lifecycle.new_conflicts(log.where("id < 4"), log).collect()] == [4]
    missed = spark.createDataFrame([(1, "a", "has x and y"), (2, "a", "a b"), (3, "c", "c stays"), (4, "d", "")], "key long, source string, zh string")
    assert sorted((r.key, r.found) for r in lifecycle.wrong_renderings(missed, log).collect()) == [(1, "y"), (2, "a"), (3, "c"), (4, "")]


def test_owed_artifacts(spark):
    rows = [(1, ["S0", "S1", "S4"], ["S0", "S1"], ["S0"], None), (2, ["S0"], ["S0"], None, ["S0"])]
    got = lifecycle.owed_artifacts(spark.createDataFrame(rows, "k long, planned array<string>, finished array<string>, skipped array<string>, files array<string>"))
    assert {r.k: (r.owed, r.passed) for r in got.collect()} == {1: (["S1"], False), 2: ([], True)}
