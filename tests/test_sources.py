"""Hand-computed cases of punctuation, repair, matching, layout, files and streams."""

import itertools
import json
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import punctuation as p
from textloom.operators import layout, matching
from textloom.sources import readers, writers
from textloom.streaming import log


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("「a」, b...", ("“a”， b……", 4)),
        ("見て https://a.b/c,d 終.", ("見て https://a.b/c,d 終。", 1)),
        ("mail a.b@c.de, ok", ("mail a.b@c.de， ok", 1)),
        ("`a,b` 3.14 1,000 x--y!", ("`a,b` 3.14 1,000 x——y！", 2)),
        ("see ./a.b/c.txt; end", ("see ./a.b/c.txt； end", 1)),
        ("", ("", 0)),
    ],
)
def test_punctuation(line, want):
    assert p.rewrite(line) == want


def test_fences_close_with_their_own_mark():
    assert p.fenced(["a", "```py", "b", "~~~", "c", "```", "d", "~~~"]) == [False, True, True, True, True, True, False, True]


def test_punctuation_of_columns(spark):
    df = spark.createDataFrame([("a,\n~~~\n「,\n~~~\n「`」`",), (None,)], "t string")
    rows = df.select(p.normalize_punctuation("t").alias("n"), p.bracket_counts("t").alias("b"), p.strip_fenced("t").alias("s")).collect()
    assert rows[0].n.text == "a，\n~~~\n「,\n~~~\n“`」`" and rows[0].n.n_changes == 2
    assert (rows[0].b.residue, rows[0].b.protected) == (1, 2) and rows[0].s == "a,\n\n\n\n「`」`"
    assert rows[1].n.text is None and rows[1].s is None and rows[1].b.residue == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"a": 1}', {"a": 1}),
        ('{"a": [1, 2,],}', {"a": [1, 2]}),
        ("{a: 1, b_2: 'x'}", {"a": 1, "b_2": "x"}),
        ("{'a': 'say \"hi\"'}", {"a": 'say "hi"'}),
        ('```json\n{"a": 1}\n```', {"a": 1}),
        ('so: {"a": "x\ny"} done', {"a": "x\ny"}),
        ('[1, {"b": true,}]', [1, {"b": True}]),
        ("plain text", None),
        ("", None),
        (None, None),
    ],
)
def test_json_repair(text, want):
    got, _ = p.repair(text)
    assert (None if got is None else json.loads(got)) == want


def test_json_repair_reports_whether_it_was_needed():
    assert p.repair('{"a": 1}') == ('{"a": 1}', False) and p.repair("{a: 1}")[1] and p.repair("no")[1]


def _counts(text, *keys):
    machine = matching.automaton({matching.normalized(k): [k] for k in keys})
    return matching.count_terms(text, machine)


def test_terms_by_script():
    assert _counts("Ann Anna ANN", "Ann") == {"Ann": 2}
    assert _counts("гад гадкий", "гад") == {"гад": 1}
    assert _counts("静香と静", "静") == {"静": 2}
    assert _counts("Ｃ＋＋ and c++x C++", "C++") == {"C++": 2}
    assert _counts("ﾊﾝｶｸ", "ハンカク") == {"ハンカク": 1}


def test_overlapping_spans_count_once():
    assert matching.merged([(0, 3), (2, 5), (5, 6), (8, 9)]) == 3 and matching.merged([]) == 0


@settings(max_examples=60, deadline=None)
@given(st.text("ab静é_ ", max_size=24), st.lists(st.text("ab静é", min_size=1, max_size=3), min_size=1, max_size=4, unique=True))
def test_automaton_is_a_search_of_each_key(text, keys):
    import re

    def alone(key):
        kind, left, right = matching.boundaries(key)
        c = {"ascii": "[a-z0-9_]", "word": r"\w", "none": ""}[kind]
        return len(re.findall((f"(?<!{c})" if left else "") + re.escape(key) + (f"(?!{c})" if right else ""), matching.normalized(text)))

    want = {k: alone(k) for k in keys}
    assert _counts(text, *keys) == {k: n for k, n in want.items() if n}


def test_term_rate(spark):
    terms = spark.createDataFrame([("静", "Shizuka", "", ["静香"]), ("王", "King", "", None)], "source string, target string, type string, aliases array<string>")
    pairs = spark.createDataFrame([(1, "静香と静、王", "Shizuka, king"), (2, "王", None)], "k long, src string, zh string")
    assert matching.term_rate(pairs, "k", terms).first()[:] == (4, 2, 0.5)
    assert matching.term_rate(pairs.where("k > 2"), "k", terms).first()[:] == (0, 0, 1.0)
    assert matching.term_counts(pairs, "k", "src", matching.keyed(terms), shard=2).count() == 3


def test_reading_order_of_two_columns():
    rows = [(x, y, x + 300, y + 20) for x in (0, 400) for y in (0, 40, 80)]
    assert layout.xy_order(np.array(rows)).tolist() == [0, 1, 2, 3, 4, 5]
    tall = [(x, 0, x + 20, 300) for x in (0, 40, 80)]
    assert layout.xy_order(np.array(tall)).tolist() == [2, 1, 0]
    assert layout.xy_order(np.zeros((0, 4))).tolist() == [] and layout.xy_order(np.array([(5, 5, 5, 5)])).tolist() == [0]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(0, 300), st.integers(0, 80), st.integers(0, 80)), min_size=1, max_size=12))
def test_reading_order_is_a_permutation(boxes):
    rows = np.array([(x, y, x + w, y + h) for x, y, w, h in boxes])
    assert sorted(layout.xy_order(rows)) == list(range(len(boxes)))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 50), st.integers(0, 9)), min_size=1, max_size=7))
def test_smooth_path_is_the_lightest(items):
    order = [float(o) for _, _, o in items]
    begin, end = [(x, y) for x, y, _ in items], [(x, y + 5) for x, y, _ in items]
    spread = max(order) - min(order)

    def total(path):
        return sum(float(np.hypot(begin[j][0] - end[i][0], begin[j][1] - end[i][1])) / 70 + (abs(order[i] - order[j]) / spread if spread else 0) for i, j in zip(path, path[1:]))

    n = len(items)
    paths = [q for q in itertools.permutations(range(n)) if q[0] == 0 and q[-1] == n - 1 and all(abs(a - b) <= 2 for a, b in zip(q, q[1:]))]
    assert total(layout.smooth_path(order, begin, end, 70.0)) == pytest.approx(min(map(total, paths)))


def test_lines_of_one_row_need_not_be_level():
    assert layout.sort_lines([(50, 10, 20, 10), (10, 12, 20, 10), (10, 40, 20, 10)], False) == [1, 0, 2]
    assert layout.sort_lines([(10, 0, 10, 30), (50, 5, 10, 30)], True) == [1, 0] and layout.sort_lines([], True) == []


def test_duplicate_lines(spark):
    rows = [(1, 0, 0.0, 0.0, 10.0, 10.0, 0.5), (1, 1, 0.0, 0.0, 10.0, 9.0, 0.9), (1, 2, 0.0, 20.0, 10.0, 30.0, 0.1), (2, 0, 0.0, 0.0, 0.0, 0.0, 0.1)]
    df = spark.createDataFrame(rows, "page long, box int, x0 double, y0 double, x1 double, y1 double, conf double")
    assert sorted((r.page, r.box) for r in layout.dup_lines(df).collect()) == [(1, 1), (1, 2), (2, 0)]
    order = layout.block_order(df.withColumn("block", F.col("box")).withColumn("rank", F.col("box"))).collect()
    assert sorted((r.page, r.block, r.rank) for r in order) == [(1, 0, 0), (1, 1, 1), (1, 2, 2), (2, 0, 0)]


def test_decoding(spark):
    raw = [("日本".encode(e),) for e in ("utf-8", "shift_jis", "euc_jp")] + [(b"\x81\x20",), (None,)]
    got = [r[0] for r in spark.createDataFrame(raw, "b binary").select(readers.decode_text("b")).collect()]
    assert got[:2] == ["日本", "日本"] and "�" in got[3] and got[4] is None


def test_files(spark, tmp_path):
    files = {"a.txt": "x\ny", "b.json": '{"b": [" q ", 1, ""], "a": "p"}', "c.xml": "<r><a>one <b>two</b> three</a><a/></r>", "d.bin": "?", "sub/chunk_012.txt": "twelve"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    body = '<w:document xmlns:w="u"><w:body><w:p><w:r><w:t>one</w:t><w:tab/><w:t>&amp; two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>three</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "e.docx", "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "f.docx").write_bytes(b"PK no")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in readers.read_texts(spark, str(tmp_path)).collect()}
    assert got == {"e.docx": "one\t& two\n\nthree", "f.docx": None, "a.txt": "x\ny", "b.json": "p\n\nq", "c.xml": "onetwo\nthree", "d.bin": None, "chunk_012.txt": "twelve"}
    assert [tuple(r) for r in readers.read_chunks(spark, str(tmp_path / "sub")).collect()] == [(12, "twelve")]


def test_glossaries(spark, tmp_path):
    (tmp_path / "g.csv").write_text("\ufeffsource,target,type\na,b,人名\n,x,\nc,\n d , e ,,user,n\n")
    (tmp_path / "g.json").write_text('{"terms": [{"source": "a", "target": "b", "aliases": ["z"]}, {"source": "", "target": "c"}]}')
    (tmp_path / "h.json").write_text('[{"source": "q", "target": "r"}]')
    terms = readers.read_glossary_csv(spark, str(tmp_path / "g.csv"))
    assert sorted((r.source, r.target, r.origin) for r in terms.collect()) == [("a", "b", None), ("d", "e", "user")]
    assert [r.source for f in "gh" for r in readers.read_glossary_json(spark, str(tmp_path / f"{f}.json")).collect()] == ["a", "q"]
    writers.export_glossary(terms, str(tmp_path / "out"))
    assert readers.read_glossary_csv(spark, str(tmp_path / "out")).count() == 2
    blocks = writers.prompt_blocks(spark.createDataFrame([(1, "d"), (1, "a")], "k long, source string"), terms, "k", "Keep:").first()
    assert blocks.prompt == "Keep:\n\n- a → b\n- d → e (n)"


def test_layout_documents(spark):
    xml = '<D xmlns="u"><PAGE><TEXTBLOCK><LINE X="1" Y="2" WIDTH="3" HEIGHT="4" CONF="0.5" STRING="s"/><LINE X="?"/></TEXTBLOCK><LINE X="9" Y="9" WIDTH="1" HEIGHT="1"/></PAGE></D>'
    rows = readers.layout_boxes(spark.createDataFrame([(1, xml), (2, "<"), (3, None)], "k long, x string"), "k", "x").orderBy("box").collect()
    assert [(r.key, r.block, r.box, r.x1, r.y1, r.text) for r in rows] == [("1", 0, 0, 4.0, 6.0, "s"), ("1", None, 1, 10.0, 10.0, None)]


def _drain(writer):
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert not q.isActive and q.exception() is None


def test_event_stream_numbers_without_gaps(spark, tmp_path):
    source, out, state = (tmp_path / n for n in ("in", "out", "state"))
    source.mkdir()
    for batch in range(2):
        lines = [json.dumps({"ts": batch * 10 + k, "type": "t"}) for k in range(3)] + ["broken", "[1]"]
        (source / f"{batch}.json").write_text("\n".join(lines))
        stream = log.event_stream(spark, str(source)).withColumn("at", F.col("ts").cast("bigint"))
        _drain(log.append_sequenced(stream, "at", str(out), str(state)))
    rows = spark.read.parquet(str(out)).orderBy("seq").collect()
    assert [(r.seq, r.at) for r in rows] == [(i + 1, t) for i, t in enumerate([0, 1, 2, 10, 11, 12])]


def test_only_other_encodings_become_objects(monkeypatch):
    seen, real = [], readers.decoded
    monkeypatch.setattr(readers, "decoded", lambda raw, encodings: seen.append(raw) or real(raw, encodings))
    raw = [b"", None, "字".encode(), b"\xed\xa0\x80"] + [b"plain"] * 200 + ["字".encode("shift_jis")]
    assert readers._decoded(pa.array(raw[4:-1], pa.binary()), readers.ENCODINGS).to_pylist() == ["plain"] * 200 and not seen
    assert readers._decoded(pa.array(raw, pa.binary()), readers.ENCODINGS).to_pylist() == [b if b is None else real(b) for b in raw]
    assert 2 <= len(seen) < 150
