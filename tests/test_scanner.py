"""Hand-computed issues of translated segments."""

from textloom.operators import scanner

PAIRS = "chunk long, src string, zh string"


def rows(df):
    return [tuple(r) for r in df.select("id", "chunk", "kind", "severity", "detail", "line", "n", "found", "excerpt").orderBy("id").collect()]


def test_every_kind(spark):
    pairs = spark.createDataFrame(
        [
            (3, "x", None),
            (1, "7 12 7 %s {a} {b}", "ok ７\n" + "字" * 70 + "かなか"),
            (2, "a", " \n "),
            (4, None, "かな"),
            (5, "p\n\nq", "「r」."),
            (6, "s 9", "s\n```\nかな 「 9\n```\n９"),
        ],
        PAIRS,
    )
    assert rows(scanner.qa_issues(pairs, ["chunk"])) == [
        (1, 1, "residue", "error", None, 2, 3, "かな", "字" * 57 + "…"),
        (2, 1, "placeholder", "error", "brace", None, -2, "{a}, {b}", None),
        (3, 1, "placeholder", "error", "printf", None, -1, "%s", None),
        (4, 1, "number", "warn", None, None, 2, "12, 7", None),
        (5, 2, "empty", "error", "blank", None, None, None, None),
        (6, 3, "empty", "error", "missing", None, None, None, None),
        (7, 5, "punctuation", "warn", None, None, 2, "「」", None),
        (8, 5, "punctuation", "info", None, None, 1, ".", None),
        (9, 5, "paragraph", "warn", None, None, -1, None, None),
    ]


def test_terms_and_what_stands_in_their_place(spark):
    pairs = spark.createDataFrame([(1, "猫と猫と犬", "一只貓，狗"), (2, "猫", "猫\n"), (3, "犬", "猫"), (4, "猫", None)], PAIRS)
    terms = spark.createDataFrame([("猫", "喵", "", []), ("犬", "狗", "", [])], "source string, target string, type string, aliases array<string>")
    logged = spark.createDataFrame([("猫", 2, "一只"), ("猫", 1, "貓"), ("犬", 0, "汪")], "source string, arrival long, proposed_target string")
    found = scanner.term_issues(pairs, ["chunk"], terms, logged).select("chunk", "detail", "line", "n", "found", "excerpt")
    assert sorted(tuple(r) for r in found.collect()) == [(1, "猫", 1, 2, "貓", "一只貓，狗"), (2, "猫", 1, 1, "猫", "猫"), (3, "犬", None, 1, "", None)]


def test_no_pairs_no_issues_and_order(spark):
    none = scanner.qa_issues(spark.createDataFrame([], PAIRS), ["chunk"])
    assert none.count() == 0
    assert {(r.level, r.name): r.n for r in scanner.qa_counts(none).collect()} == {**{("kind", k): 0 for k in scanner.KINDS}, **{("severity", s): 0 for s in scanner.SEVERITIES}}
    issues = spark.createDataFrame([(1, 9, "info"), (2, None, "error"), (3, 1, "warn"), (4, 5, "error")], "id long, chunk long, severity string")
    assert [r.id for r in scanner.issue_order(issues, "chunk").collect()] == [2, 4, 3, 1]
