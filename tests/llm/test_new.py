"""Language models, alignment and whitening against independent versions of themselves, on tables with nulls, empty and long texts, repeated rows, clashing names and no rows."""

import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textloom.llm import align, decontaminate, html_text, language_id, registry, whitening

SMALL, TOKENIZERS = "/root/testdata/sf0.001", "/opt/tokenizers"
LONG = " ".join(f"long{k % 997} text{k % 31}" for k in range(60_000))


def clashing(df):
    names = ["fold", "h", "n", "size", "low", "best", "limit", "lang_pred", "row", "pairs", "times", "x", "component", "dim", "high", "_k", "k", "gram", "c", "context"]
    return df.select("*", *(F.lit(k).alias(x) for k, x in enumerate(names)))


# Language identification


def plain_codes(text, order):
    import unicodedata

    kept = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower()).split()
    return " " * (order - 1) + " ".join(kept) + " " if any(c.isalpha() for w in kept for c in w) else ""


class PlainModel:
    """Interpolated Kneser-Ney by the book, over dictionaries of strings."""

    def __init__(self, texts, order, alphabet):
        self.order, self.alphabet = order, alphabet
        self.counts = {order: Counter(s[i : i + order] for t in texts for s in [plain_codes(t, order)] for i in range(len(s) - order + 1))}
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.d, self.after = {}, {}
        for k, c in self.counts.items():
            n1, n2 = (sum(v == m for v in c.values()) for m in (1, 2))
            self.d[k] = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5
            self.after[k] = defaultdict(list)
            for g, v in c.items():
                self.after[k][g[:-1]].append(v)

    def p(self, gram):
        if not gram:
            return 1 / self.alphabet
        k, shorter = len(gram), self.p(gram[1:])
        held = self.after[k].get(gram[:-1])
        if not held:
            return shorter
        return (max(self.counts[k].get(gram, 0) - self.d[k], 0) + self.d[k] * len(held) * shorter) / sum(held)

    def entropy(self, text):
        s = plain_codes(text, self.order)
        grams = [s[i : i + self.order] for i in range(len(s) - self.order + 1)]
        return -sum(math.log(self.p(g)) for g in grams) / len(grams) if grams else 0.0


@pytest.fixture(scope="module")
def many(spark):
    rng, rows = np.random.default_rng(1), []
    syllables = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["strö", "ach", "kum", "lo"], "cc": ["ni", "é", "ka", "ou"]}
    for i in range(900):
        lang = ["aa", "bb", "cc", None][i % 4]
        made = " ".join("".join(rng.choice(syllables[lang or "aa"], rng.integers(1, 4))) for _ in range(rng.integers(1, 30)))
        rows.append((i, made + rng.choice(["", ".", " 12!"]), lang))
    rows += [(1500, None, "aa"), (1501, "", "bb"), (1502, "12 345 !", "cc"), (None, "kalo mitu", "aa"), (3, rows[3][1], None), (1504, LONG, "aa"), (1505, "日本語 ﬁ Ω", None), (1506, "x", None), (1507, "strö́ach kum", "bb"), (1508, "🎉 a\U00010400", None)]
    return clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))


@pytest.mark.parametrize("order", [1, 3, 5])
def test_models_are_those_of_the_book(many, order):
    rows = many.select("doc_id", "text", "lang").collect()
    learn = [r for r in rows if r.lang and zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 4 not in (2, 3)]
    langs = sorted({r.lang for r in learn})
    alphabet = len({c for r in learn for c in plain_codes(r.text, 1)}) + 1
    plain = [PlainModel([r.text for r in learn if r.lang == x], order, alphabet) for x in langs]
    want = sorted((str(r.doc_id), r.text or "", [m.entropy(r.text) for m in plain]) for r in rows)
    for largest in (language_id.MODEL_BYTES, 0):
        fitted = language_id.fit(many, order, largest)
        assert fitted.langs == langs and (fitted.arrays is None) == (largest == 0)
        got = sorted((str(r.doc_id), r.h) for r in language_id.entropies(many, fitted).collect())
        for (i, _, w), (j, g) in zip(sorted(want, key=lambda x: (x[0], x[2])), got, strict=True):
            assert i == j and np.allclose(w, g, rtol=1e-9)


def test_probabilities_of_a_context_add_up_to_one(many):
    rows = many.where("lang = 'aa'").select("text").collect()
    m = PlainModel([r.text for r in rows], 3, 40)
    seen = sorted(m.counts[1])
    assert abs(sum(m.p("ka" + c) for c in seen) + (40 - len(seen)) * m.p("ka\0") - 1) < 1e-9


def test_languages_of_all_rows(many):
    got = {(r.doc_id, r.text): r for r in many.select("doc_id", "text", "lang").join(language_id.identify(many).withColumnRenamed("doc_id", "id"), F.expr("doc_id <=> id")).collect()}
    assert language_id.identify(many).count() == many.count() == 910
    for r in got.values():
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) == (r.entropy is None)
    judged = [r.lang_pred == r.lang for r in got.values() if r.lang and r.held_out and r.text]
    assert sum(judged) / len(judged) > 0.9
    odd = [r for r in got.values() if r.doc_id == 1504]
    assert odd[0].lang_pred != "und"
    far = language_id.identify(many.select("doc_id", "text", "lang").unionByName(many.limit(1).select(F.lit(9999).cast("long").alias("doc_id"), F.lit("qqq www zzz jjj yyy " * 4).alias("text"), F.lit(None).cast("string").alias("lang"))))
    assert far.where("doc_id = 9999").first().rejected and far.where("rejected").count() < 15


def test_languages_without_anything_to_learn(many):
    assert language_id.identify(many.limit(0)).count() == 0
    got = language_id.identify(many.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(got) == 910 and {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}


@pytest.mark.parametrize("block", [3, 1 << 19])
def test_blocks_hold_every_window_once(block, monkeypatch):
    monkeypatch.setattr(language_id, "BLOCK", block)
    sequences = [language_id.codes(t, 4) for t in ("a", "", "hello there", "12", "x y z")]
    got = [(int(o), *w) for windows, of in language_id.blocks(sequences, 4) for w, o in zip(windows.tolist(), of, strict=True)]
    assert got == [(k, *s[i : i + 4].tolist()) for k, s in enumerate(sequences) for i in range(len(s) - 3)]


def test_sorted_arrays_find_what_they_hold():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000):
        keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        held = language_id.Hashed(keys, keys)
        probe = np.concatenate([keys, keys + np.uint64(1), np.array([0, (1 << 64) - 1], np.uint64)])
        at = held.find(probe)
        assert all((p in set(keys.tolist())) == (a >= 0) and (a < 0 or held.values[a] == p) for p, a in zip(probe.tolist(), at.tolist(), strict=True))


# Alignment


@pytest.fixture(scope="module")
def files():
    return tuple(open(f"{TOKENIZERS}/{name}", "rb").read() for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def plain(files):
    """Tokens of whole texts by the two libraries, walked from cut to cut."""
    a, b = Tokenizer.from_buffer(files[0]), sentencepiece.SentencePieceProcessor(model_proto=files[1])
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in printable)}

    def groups(text):
        if not text:
            return None
        coded, ib = a.encode(" " + text, add_special_tokens=False), b.encode(text)
        ia, xs = coded.ids, [bytes(back[c] for c in t) for t in coded.tokens]
        ys = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ib for p in [b.id_to_piece(i)]]
        if not b"".join(xs) == b"".join(ys) == (" " + text).encode():
            return None
        out, here, i, j, at = [], ([], []), 0, 0, [0, 0]
        while i < len(xs) or j < len(ys):
            if at[0] <= at[1]:
                at[0] += len(xs[i])
                here[0].append(ia[i])
                i += 1
            else:
                at[1] += len(ys[j])
                here[1].append(ib[j])
                j += 1
            if at[0] == at[1]:
                out.append(here)
                here = ([], [])
        return out

    return groups


ODD = ["", None, "<s> a  b \n c\t d", "a  b", " x y", "x y ", "<|endoftext|> hi <unk>", "日本語のテキスト です 。", "é ﬁ ①   x   y", "a\x1cb \x1c c", "x　 y 　z", "▁ ▁▁ a ▁b", "1 2 333 4's don't 'S", "ab" * 3000, "\u0085 a \u0085", "a ​ b", "\x00 a \x00", "🎉 👨‍👩‍👧 a", "same text", "same text"]


def expected(rows, plain, width):
    found = [(i, plain(t)) for i, t in rows]
    pairs = [Counter((x, y) for a, b in g for x in a for y in b) if g else Counter() for _, g in found]
    count = Counter(p for c in pairs for p in c)
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for (i, g), c in zip(found, pairs, strict=True):
        sha = hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g).encode()).hexdigest() if g else ""
        sizes = (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g)) if g else (0, 0, 0)
        out.append((i, *sizes, sum(c.values()), sum(n for p, n in c.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in c.items()), sha))
    return out


def test_alignment_against_a_walk(spark, files, plain):
    rows = list(enumerate(ODD)) + [(None, "same text"), (30, LONG)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    want = sorted(map(str, expected(rows, plain, 32_000)))
    for largest in (align.PAIRS, 0):
        assert sorted(str(tuple(r)) for r in align.alignment(docs, *files, largest=largest).collect()) == want
    assert align.alignment(docs.limit(0), *files).count() == 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the generated tables")
def test_alignment_of_the_given_documents(spark, plain):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, registry.op12_alignment(spark, SMALL).collect())) == sorted(expected(rows, plain, 32_000))


@pytest.fixture(scope="module")
def aligner(files):
    return align.Aligner(align.ByteLevel(files[0]), align.Pieces(files[1]))


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(st.one_of(st.sampled_from(" ab's1\n\t　▁é日"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=4))
def test_pieces_are_tokenized_like_whole_texts(aligner, plain, texts):
    got = aligner(texts)
    for k, t in enumerate(texts):
        g = plain(t)
        assert got["sums"][k].tolist()[:3] == ([sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g)] if g else [0, 0, 0])
        assert got["digests"][k] == (hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g).encode()).hexdigest() if g else "")


def test_large_groups_and_small_caches(aligner, monkeypatch):
    texts = ["ab" * 200 + "日本 x", "a b c", "日本語 のテキスト"]
    want = aligner(texts)
    monkeypatch.setattr(align, "LARGE", 1)
    monkeypatch.setattr(align, "CACHE", 0)
    got = aligner(texts)
    assert got["digests"] == want["digests"] and all(np.array_equal(got[k], want[k]) for k in ("sums", "pairs", "times", "ends"))


@settings(max_examples=100, deadline=None)
@given(n=st.integers(1, 30), edges=st.lists(st.tuples(st.integers(0, 29), st.integers(0, 29)), max_size=40))
def test_union_find(n, edges):
    edges = [(a % n, b % n) for a, b in edges]
    root = list(range(n))
    for _ in range(n):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = align.components(n, np.array([a for a, _ in edges], int), np.array([b for _, b in edges], int))
    assert got.tolist() == root


# Whitening


def symmetric(n, kind):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, n))
    return {"full": a @ a.T, "equal": 3 * np.eye(n), "zero": np.zeros((n, n)), "ties": np.diag(rng.integers(0, 4, n).astype(float)), "low rank": a[:, :2] @ a[:, :2].T, "near ties": np.ones((n, n)) + 1e-9 * np.eye(n), "negative": -a - a.T}[kind]


@pytest.mark.parametrize("kind", ["full", "equal", "zero", "ties", "low rank", "near ties", "negative"])
@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 64])
def test_divide_and_conquer(n, kind):
    a = symmetric(n, kind)
    d, e, q = whitening.tridiagonal(a)
    t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1) if n > 1 else np.diag(d)
    assert np.allclose(q @ t @ q.T, a, atol=1e-11 * max(1, abs(a).max()))
    values, vectors = whitening.divide(d, e)
    size = max(1, abs(a).max())
    assert abs(t @ vectors - vectors * values).max() < 1e-12 * size and abs(vectors.T @ vectors - np.eye(n)).max() < 1e-12
    values, vectors = whitening.eigen((a, np.zeros_like(a)))
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * size) and abs(vectors.T @ vectors - np.eye(n)).max() < 1e-12
    assert abs(a @ vectors - vectors * values).max() < 1e-12 * size


@settings(max_examples=200, deadline=None)
@given(a=st.floats(-1e100, 1e100), b=st.floats(-1e100, 1e100))
def test_nothing_is_lost(a, b):
    s, e = whitening.two_sum(np.float64(a), np.float64(b))
    assert Fraction(float(s)) + Fraction(float(e)) == Fraction(a) + Fraction(b)
    if a == 0 or b == 0 or 1e-100 < abs(a * b):
        p, e = whitening.two_product(np.float64(a), np.float64(b))
        assert Fraction(float(p)) + Fraction(float(e)) == Fraction(a) * Fraction(b)


def exact_covariance(xs):
    n, width = len(xs), len(xs[0])
    mean = [Fraction(sum(x[k] for x in xs), n) for k in range(width)]
    return [[sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in xs) / n for j in range(width)] for i in range(width)]


def test_covariance_keeps_what_doubles_lose(spark):
    rng = np.random.default_rng(5)
    xs = np.unique(rng.integers(0, 3, (60, 4)) + np.array([10**15, 0, -(10**12), 7]), axis=0).tolist()
    df = spark.createDataFrame([(x,) for x in xs], "x array<long>").repartition(5)
    n, s = whitening.sums(df, 4)
    assert n == len(xs) and s == [sum(x[k] for x in xs) for k in range(4)]
    high, low = whitening.covariance(df, n, s)
    for i, row in enumerate(exact_covariance(xs)):
        for j, want in enumerate(row):
            assert abs(Fraction(float(high[i, j])) + Fraction(float(low[i, j])) - want) < Fraction(1, 10**28) * 10


def test_whitening_against_plain_numbers(spark):
    rng = np.random.default_rng(2)
    base = (rng.normal(size=(90, 6)) * [3, 2, 1, 0.5, 0.2, 0.1]).astype(np.float32).tolist()
    rows = [(k, v) for k, v in enumerate(base)] + [(100 + k, base[0]) for k in range(40)] + [(None, base[1]), (0, base[0])]
    rows += [(200, None), (201, []), (202, [1.0] * 5), (203, [None] + [1.0] * 5), (204, [float("nan")] + [1.0] * 5), (205, [float("-inf")] + [1.0] * 5), (206, [-0.0] * 6), (207, [-1e-30] * 6)]
    got = whitening.whiten(clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4))).collect()
    kept = [(i, [math.floor(256 * np.float64(np.float32(c))) for c in v]) for i, v in rows if v and len(v) == 6 and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    v = np.array([[float(c) for c in row] for row in exact_covariance(fit)])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 4 * len(kept) and sorted({str(r.vec_id) for r in got}) == sorted({str(i) for i, _ in kept})
    by = {(r.vec_id, r.component): r for r in got}
    for c in range(4):
        want = np.array([np.array([n * a - b for a, b in zip(x, sums, strict=True)]) / n @ vectors[:, c] / math.sqrt(values[c]) for _, x in kept])
        have = np.array([by[i, c + 1].whitened for i, _ in kept])
        assert np.allclose(have, want * np.sign(want @ have), atol=1e-11)
        assert all(abs(by[i, c + 1].explained / (values[c] / values.sum()) - 1) < 1e-12 and by[i, c + 1].n == n and by[i, c + 1].identity_error < 1e-12 for i, _ in kept)
    assert all(by[i, 1].deviation == sum((n * a - b) ** 2 for a, b in zip(x, sums, strict=True)) for i, x in kept)


def test_whitening_at_the_edges(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whiten(make([])).count() == 0 and whitening.whiten(make([(1, None)])).count() == 0
    assert [tuple(r) for r in whitening.whiten(make([(1, [1.0, 2.0])])).collect()] == [(1, c, 1, 0, None, 0.0, None) for c in (1, 2)]
    flat = whitening.whiten(make([(1, [1.0, 2.0]), (2, [3.0, 2.0])])).orderBy("vec_id", "component").collect()
    assert [(r.deviation, r.whitened and abs(r.whitened)) for r in flat] == [(512**2, 1.0), (512**2, None)] * 2 and flat[0].identity_error < 1e-15
    huge = whitening.whiten(make([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, 2.0])])).where("component = 1").orderBy("vec_id").collect()
    assert [r.deviation for r in huge] == [None, None, 2560**2 + 768**2] and all(math.isfinite(r.whitened) for r in huge)


# Main text of pages


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<main>main words here<article class="comment">reader says</article></main>', "main words here"),
        ("<article>post<article class='comment'>reader says</article></article>", "post"),
        ("<article>post<article><p>nested</p></article> more</article>", "post\nmore"),
        ("<main><h1>Title</h1><p>lead</p><article><p>rest</p></article></main>", "Title\nlead\nrest"),
        ("<nav>menu</nav><article>one</article><article>two</article><p>out", "one\ntwo"),
        ('<article><h2 id="comments">Comments on the treaty</h2><p>text</p><div id="comments">no</div></article>', "Comments on the treaty\ntext"),
        ('<article role="article" id="related-posts">no</article><main>yes</main>', "yes"),
        ("<p>menu</p><article></article>", "menu"),
    ],
)
def test_regions_of_the_parsed_page(page, want):
    assert html_text.text_of(html_text.blocks_of(page))[0] == want


def test_marks_in_comments_and_scripts_are_none(spark):
    shared = "home news sports weather travel food music films books"
    pages = [(1, "http://h.com/1", f"<!-- <article> --><div>{shared}</div><p>first text"), (2, "http://h.com/2", f"<script>'<main>'</script><div>{shared}</div><p>second text")]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "first text", 2: "second text"}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the generated tables")
@pytest.mark.parametrize("pages_an_array", [20, 500])
def test_given_pages_without_their_marks(spark, pages_an_array):
    """The given pages with the marks taken out: what eight tokens that another page of the host has cover is gone, nothing else."""
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").withColumn("html", F.regexp_replace("html", "(?i)<(/?)(article|main)", "<$1div"))
    pages = pages.withColumn("url", F.regexp_replace("url", "//[^/]*", "//one.host"))
    rows = [(r.page_id, [t.split(" ") for t, _ in html_text.blocks_of(r.html or "")]) for r in pages.collect()]
    streams = {i: [w for b in blocks for w in b] for i, blocks in rows}
    on = defaultdict(set)
    for s in streams.values():
        for k in range(len(s) - 7):
            on[tuple(s[k : k + 8])].add(tuple(s))
    want = {}
    for i, blocks in rows:
        s, gone, out, at = streams[i], set(), [], 0
        for k in range(len(s) - 7):
            if len(on[tuple(s[k : k + 8])]) > 1:
                gone.update(range(k, k + 8))
        for b in blocks:
            if left := [w for k, w in enumerate(b) if at + k not in gone]:
                out.append(" ".join(left))
            at += len(b)
        want[i] = "\n".join(out)
    assert {r.page_id: r.text for r in html_text.main_text(pages, pages_an_array=pages_an_array).collect()} == want
    assert any(want.values()) and want != {i: "\n".join(" ".join(b) for b in blocks) for i, blocks in rows}


def test_marked_pages_are_evidence_and_are_judged(spark):
    menu, plea, lead, quoted = (" ".join(f"{x}{k}" for k in range(9)) for x in ("menu", "plea", "lead", "quoted"))
    html = [
        f"<div>{menu}</div><article><p>{lead}<p>first</article><p>{plea}",
        f"<div>{menu}</div><p>no marks here",
        f"<article><p>second<p>{plea}<p>{plea} and more</article><p>{plea}<p>{lead}",
        f"<article><p>third<div>{plea}</div></article><div>{plea}</div><div>{lead}</div><aside>{quoted}</aside>",
        f"<article><p>{lead}<p>first</article><p>a copy",
        f"<main>{plea}</main>",
        f"<p>{lead}<p>{quoted}<aside>{quoted} here</aside>",
    ]
    pages = spark.createDataFrame([(k, f"http://h.com/{k}", x) for k, x in enumerate(html)], "page_id long, url string, html string")
    want = {0: f"{lead}\nfirst", 1: "no marks here", 2: f"second\n{plea} and more", 3: "third", 4: f"{lead}\nfirst", 5: plea, 6: quoted}
    for sizes in ({}, {"pages_an_array": 1}, {"seeds_sent": 0}, {"pages_an_array": 2, "seeds_sent": 0}):
        assert {r.page_id: r.text for r in html_text.main_text(pages, **sizes).collect()} == want
    elsewhere = pages.withColumn("url", F.concat(F.lit("http://h"), "page_id", F.lit(".com/")))
    assert html_text.main_text(elsewhere).where("page_id = 1").first().text == f"{menu}\nno marks here"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the generated tables")
@pytest.mark.parametrize("sizes", [{}, {"pages_an_array": 20}, {"pages_an_array": 20, "seeds_sent": 0}])
def test_given_pages_half_without_marks(spark, sizes):
    """One host; two thirds of the pages without marks, notices of ten words beside and inside articles: the rows of brute force."""
    notice = lambda c: F.concat(F.lit("<div>"), F.concat_ws(" ", *[F.concat(F.lit(f"n{k}x"), c) for k in range(10)]), F.lit("</div>"))
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").withColumn("url", F.lit("http://one.host/")).withColumn("n", F.pmod("page_id", F.lit(7)).cast("string"))
    pages = pages.withColumn("html", F.regexp_replace("html", "</article>", F.concat(notice(F.col("n")), F.lit("</article>"), notice(F.pmod("page_id", F.lit(5)).cast("string")))))
    pages = pages.withColumn("html", F.when(F.col("page_id") % 3 > 0, F.regexp_replace("html", "(?i)<(/?)(article|main)", "<$1div")).otherwise(F.col("html"))).drop("n")
    rows, outside, inside = {}, defaultdict(set), defaultdict(set)
    for r in pages.collect():
        every = html_text.blocks_of(r.html or "")
        marked = any(x > 0 for _, x in every)
        kept = [t.split(" ") for t, x in every if x > 0 or not marked]
        beside = [w for t, x in every if x == 0 for w in t.split(" ")]
        rows[r.page_id], own = (marked, kept), tuple(w for b in kept for w in b)
        for stream, on in ((beside, outside), (own if marked else (), inside)):
            for k in range(len(stream) - 7):
                on[tuple(stream[k : k + 8])].add(own)
    want = {}
    for i, (marked, kept) in rows.items():
        s, gone, out, at = [w for b in kept for w in b], set(), [], 0
        for k in range(len(s) - 7):
            if len(outside[key := tuple(s[k : k + 8])]) > 1 and (not marked or len(inside[key]) > 1):
                gone.update(range(k, k + 8))
        for b in kept:
            left = [w for k, w in enumerate(b) if at + k not in gone]
            if left:
                out.append(" ".join(b if marked else left))
            at += len(b)
        want[i] = "\n".join(out or [" ".join(b) for b in kept if marked])
    assert {r.page_id: r.text for r in html_text.main_text(pages, **sizes).collect()} == want
    assert not any("n3x4" in t for t in want.values()) and {m for m, _ in rows.values()} == {True, False}


# Decontamination against a large benchmark


def test_ten_shards_write_hits_alone(spark, monkeypatch):
    """More shards than pass at once: the same rows as with one, and what is written is smaller than one text."""
    paths, real = [], decontaminate.scratch
    monkeypatch.setattr(decontaminate, "SHARDS_AT_ONCE", 2)
    monkeypatch.setattr(decontaminate, "scratch", lambda df, name: paths.append(real(df, name)) or paths[-1])
    texts = [f"item{k} " * 15 for k in range(60)]
    items = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "item_id long, text string")
    rows = [(k % 37, f"a {texts[k % 60]} b {texts[(k * 7) % 60]} " + LONG[:50_000] * (k % 2)) for k in range(80)] + [(1, None), (None, texts[3]), (None, texts[3]), (5, "")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, id int, spans int").repartition(3)
    want = decontaminate.contamination(spark, docs, items).collect()
    assert not paths
    got = decontaminate.contamination(spark, docs, items, shard_bytes=1000).collect()
    assert len(paths) >= 5 and sorted(map(str, got)) == sorted(map(str, want)) and sum(r.contaminated for r in got) > 20
    written = sum(len(str(r.asDict())) for df in paths for r in df.drop("id", "own").collect())
    assert "text" not in paths[0].columns and written < 50_000
    kept = decontaminate.drop_contaminated(spark, docs, items, shard_bytes=1000)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, decontaminate.drop_contaminated(spark, docs, items).collect()))
