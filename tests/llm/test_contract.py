"""All operators on tables with clashing columns, nulls, long texts, repeated rows and no rows, and against independent versions of themselves."""

import hashlib
import html.parser
import math
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import decontaminate, exact_dedup, html_text, mixing, pii, registry, shared, simhash, substring_dedup, toxicity, url_filter, warc

SMALL = "/root/testdata/sf0.001"
#: Names that operators use, or once used, inside.
NAMES = ["_k", "_id", "_sha", "_items", "_spans", "_hits", "_new", "_sum", "id", "own", "part", "bucket", "node", "n", "keys", "at", "words", "present", "logits", "top", "weights", "total", "posterior", "n_tokens", "domain", "rate", "copies", "draw", "spans", "items", "hits", "new", "n_values", "gone_id", "gone_own", "score", "held_out", "host", "payload", "record_id", "fp", "key", "row"]
LONG = " ".join(f"long{k % 997} text{k % 31}" for k in range(60_000))


def clashing(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return df.select("*", *(F.lit(k).alias(x) for k, x in enumerate(NAMES)))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "one two three " * 9), (2, None), (3, ""), (None, "no id"), (5, LONG), (6, LONG), (7, "One two three " * 9), (7, "One two three " * 9), (8, "x"), (9, "é ß 中文 text")]
    return clashing(spark, rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (9, 1, 0), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return clashing(spark, [(1, "one two three one two three one two three one two three one"), (1, "one two three one two three one two three one two three one"), (2, None), (None, "x")], "item_id long, text string")


def test_filters_keep_all_columns(spark, docs, labels, bench):
    model = spark.sparkContext.broadcast((toxicity.initial(0), {}))
    results = [toxicity.drop_toxic(docs, model), exact_dedup.exact_dedup(docs), simhash.near_dedup(docs), decontaminate.drop_contaminated(spark, docs, bench)]
    for got in results:
        assert got.columns == docs.columns
        assert all(tuple(r[2:]) == tuple(range(len(NAMES))) for r in got.collect())
    assert [r.count() for r in results[1:3]] == [6, 6]
    assert sorted(r.doc_id for r in results[3].collect() if r.doc_id) == [2, 3, 5, 6, 9]


def test_new_columns_give_way(docs, labels):
    mixed = mixing.mix(docs, labels)
    assert mixed.columns == [*docs.columns, "n_tokens_", "posterior_", "domain_", "rate_", "copies_"] and mixed.count() == 10
    hidden = pii.pseudonyms(docs, "k")
    assert hidden.columns == [*docs.columns, "n_values_"] and hidden.count() == 10


def test_every_row_has_an_answer(spark, docs, labels, bench):
    model = spark.sparkContext.broadcast((toxicity.initial(0), {}))
    for got in (toxicity.toxicity(docs, model), exact_dedup.exact_groups(docs), simhash.near_groups(docs), substring_dedup.duplicate_spans(docs), decontaminate.contamination(spark, docs, bench)):
        assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(r.doc_id) for r in docs.collect())


def test_pages_with_clashing_columns(spark):
    rows = [(1, "http://a.com:8080/x", f"<article>{LONG}</article>"), (2, "http://u@A.com/y", '<a href="http://b.org:1/">'), (3, None, None), (None, "http://b.org/en/", "<p>x"), (1, "http://a.com:8080/x", f"<article>{LONG}</article>")]
    pages = clashing(spark, rows, "page_id long, url string, html string")
    assert url_filter.judge(pages).count() == html_text.main_text(pages).count() == warc.archive_round_trip(spark, pages).count() == 5
    assert url_filter.judge(pages.limit(0)).count() == html_text.main_text(pages.limit(0)).count() == 0


def test_empty_tables(spark, docs, labels, bench):
    none = docs.limit(0)
    model = toxicity.fit(spark, none, labels.limit(0))
    for got in (toxicity.toxicity(none, model), toxicity.drop_toxic(none, model), exact_dedup.exact_dedup(none), simhash.near_dedup(none), simhash.near_groups(none), mixing.mix(none, labels), pii.pseudonyms(none, "k"), decontaminate.contamination(spark, none, bench), decontaminate.drop_contaminated(spark, docs, bench.limit(0)).limit(0)):
        assert got.count() == 0


def plain_logit(p, words, grams, sizes, ids):
    """One window through the network, number by number."""
    k, sig = toxicity.HIDDEN, lambda x: 1 / (1 + math.exp(-x))
    ends = np.cumsum(sizes)
    x = [np.concatenate([p["word"][words[i]], p["gram"][grams[ends[i] - sizes[i] : ends[i]]].sum(0) / sizes[i]]) for i in ids if i]

    def run(xs, d):
        h, out = [0.0] * k, []
        for v in xs:
            a, b = [sum(v[j] * p[f"W{d}"][j][m] for j in range(len(v))) + p[f"c{d}"][m] for m in range(3 * k)], [sum(h[j] * p[f"U{d}"][j][m] for j in range(k)) for m in range(3 * k)]
            z, r = [sig(a[m] + b[m]) for m in range(k)], [sig(a[k + m] + b[k + m]) for m in range(k)]
            c = [math.tanh(a[2 * k + m] + r[m] * b[2 * k + m]) for m in range(k)]
            h = [z[m] * h[m] + (1 - z[m]) * c[m] for m in range(k)]
            out.append(h)
        return out

    states = [f + b for f, b in zip(run(x, "f"), run(x[::-1], "b")[::-1], strict=True)]
    e = [math.exp(sum(s * a for s, a in zip(h, p["att"], strict=True))) for h in states]
    return sum(w / sum(e) * sum(s * o for s, o in zip(h, p["out"], strict=True)) for w, h in zip(e, states, strict=True)) + p["bias"][0]


def test_network_is_the_plain_loop():
    p = {k: v.astype(np.float64) for k, v in toxicity.initial(6, seed=3).items()}
    p["bias"][:] = 0.3
    feats = toxicity.Features({b"aa": 1, b"bb": 2, b"cc": 3})
    ids = feats.add([b"aa bb cc dd aa ee ff aa gg bb".split()])[0]
    windows = np.zeros((3, 7), int)
    windows[0], windows[1, :3], windows[2, :1] = ids[:7], ids[7:], ids[4:5]
    arrays = feats.arrays()
    got = toxicity.forward(p, windows, toxicity.project(p, toxicity.inputs(p, *arrays)))
    assert np.allclose(got, [plain_logit(p, *arrays, w) for w in windows], atol=1e-5)


def test_held_out_rows_are_never_learnt_from(spark):
    ids = [None, *range(200)]
    df = spark.createDataFrame([(i, f"text {i}") for i in ids] + [(3, "text 3")], "doc_id long, text string")
    held = {r.doc_id: r.held_out for r in df.select("doc_id", toxicity.held_out().alias("held_out")).collect()}
    assert held == {i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0 for i in ids}
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    sample = toxicity.labelled_sample(df, labels, toxic=10, clean=1000)
    assert all(not held[int(t.split()[1])] and int(t.split()[1]) % 2 == y for t, y in sample)
    assert sum(y for _, y in sample) == 10 and len(sample) == 10 + sum(not held[i] for i in range(0, 200, 2))


def test_training_tells_classes_apart():
    rng = np.random.default_rng(0)
    make = lambda bad: [f"w{x}".encode() for x in rng.integers(0, 300, 60)] + ([b"vile", b"scum"] if bad else [])
    words, marks = [make(k % 2) for k in range(400)], [k % 2 for k in range(400)]
    model = toxicity.train([rng.permutation(w).tolist() if m else w for w, m in zip(words, marks, strict=True)], marks)
    texts = [b" ".join(make(k % 2)).decode() for k in range(60)]
    assert ((toxicity.Scorer(*model)(texts) >= 0.5) == np.arange(60) % 2).mean() > 0.9


def nonnegative_least_squares(a, b):
    """Least |a x - b| over x >= 0, by trying every set of at most as many columns as there are rows."""
    import itertools

    best = float(b @ b)
    for size in range(1, a.shape[0] + 1):
        for cols in itertools.combinations(range(a.shape[1]), size):
            x = np.linalg.lstsq(a[:, cols], b, rcond=None)[0]
            if (x >= -1e-12).all():
                best = min(best, float(((a[:, cols] @ x - b) ** 2).sum()))
    return best


@pytest.mark.parametrize("cells", [[([0.9, 0.1], 50), ([0.2, 0.8], 100), ([0.5, 0.5], 10)], [([0.6, 0.4], 50), ([0.55, 0.45], 100)], [([1.0, 0.0], 7)]])
def test_rates_are_least_squares(spark, cells):
    df = spark.createDataFrame([(p, n) for p, n in cells], "posterior array<double>, n_tokens long")
    history = mixing.fit_rates(df, ["high", "low"], {"high": 0.8, "low": 0.2}, steps=60)
    rates = [r.r for r in df.select(mixing.rate_of(F.col("posterior"), history).alias("r")).collect()]
    a = np.array([[p[k] * n for p, n in cells] for k in range(2)])
    goal = np.array([0.8, 0.2]) * sum(n for _, n in cells)
    assert min(rates) >= 0
    assert float(((a @ rates - goal) ** 2).sum()) <= nonnegative_least_squares(a, goal) + 1e-3 * float(goal @ goal)


def mover(key, tag, left, right, a, b):
    prf = lambda *x: int(hashlib.sha256("|".join([key, *map(str, x)]).encode()).hexdigest()[:12], 16)
    for k in range(pii.ROUNDS):
        left, right = ((left + prf(tag, k, right)) % a, right) if k % 2 == 0 else (left, (right + prf(tag, k, left)) % b)
    return left, right


def test_pseudonyms_are_the_feistel_images(spark):
    df = spark.createDataFrame([(1, "(212) 555-0123 10.0.200.7 123-45-6789 2001-02-03 4111111111111111")], "doc_id long, text string")
    got = pii.pseudonyms(df, "secret").first()
    phone = "{:06d}{:04d}".format(*mover("secret", "phone", 212555, 123, 10**6, 10**4))
    left, right = mover("secret", "ipv4", 10 * 256, 200 * 256 + 7, 65536, 65536)
    area, rest = mover("secret", "ssn", 122, 44 * 9999 + 6788, 898, 99 * 9999)
    area += 1 + (area >= 665)
    day = (np.datetime64("2001-02-03") - np.datetime64(pii.FIRST_DAY)).astype(int)
    high, low = mover("secret", "date", int(day) // pii.DAYS_LOW, int(day) % pii.DAYS_LOW, pii.DAYS_HIGH, pii.DAYS_LOW)
    x, y = mover("secret", "card15", 4111111, 11111111, 10**7, 10**8)
    body = f"{x:07d}{y:08d}"
    luhn = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(body))))
    want = f"({phone[:3]}) {phone[3:6]}-{phone[6:]} {left // 256}.{left % 256}.{right // 256}.{right % 256} {area:03d}-{rest // 9999 + 1:02d}-{rest % 9999 + 1:04d} {np.datetime64(pii.FIRST_DAY) + high * pii.DAYS_LOW + low} {body}{(10 - luhn % 10) % 10}"
    assert (got.text, got.n_values) == (want, 5)


class Article(html.parser.HTMLParser):
    """Blocks of the article of a page, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks, self.held = False, [], ""

    def flush(self):
        if self.held.split():
            self.blocks.append(" ".join(self.held.split()))
        self.held = ""

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside = True
        elif tag in ("p", "h1", "div"):
            self.flush()
        elif tag == "br":
            self.held += " "

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "div", "article"):
            self.flush()
        self.inside &= tag != "article"

    def handle_data(self, data):
        self.held += data if self.inside else ""


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the generated tables")
def test_marked_pages_against_the_standard_parser(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    want = {}
    for r in pages.collect():
        a = Article()
        a.feed(r.html or "")
        want[r.page_id] = "\n".join(a.blocks)
    assert {r.page_id: r.text for r in registry.op10_html_text(spark, SMALL).collect()} == want


def test_many_rules_are_looked_up_like_few(spark):
    hosts = [f"{a}.{b}.com" for a in "abc" for b in "xyz"]
    rules = [(h, p, v) for k, h in enumerate([*hosts, "x.com", "com", "y.com"]) for p, v in (("/", "allow"), (f"/p{k}", "block"), (f"/q{k % 3}/", "allow"), ("/q1/z", "block"), (f"/r{k}", "allow"), (f"/s{k}", "block"))]
    urls = spark.createDataFrame([(f"{s}{h}", p) for h in [*hosts, "x.com", "z.net"] for s in ("", "w.", "w") for p in ("", "/", "/p1x", "/p10", "/q1/zz", "/q2/", "/r11", "/s4")], "host string, path string")
    assert len(rules) > url_filter.RULES_IN_PLAN
    few = lambda r: max(((len(h + p), h + p, v) for h, p, v in rules if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)), default=(0, None, None))
    got = url_filter.with_rule(urls, rules).collect()
    assert len(got) == urls.count() and all((r.rule, r.rule_verdict) == few(r)[1:] for r in got)


def test_hosts_with_ports_are_one_node(spark):
    pages = spark.createDataFrame([(1, "http://good.net:81/de/1", '<a href="http://next.org:9/x">'), (2, "http://me@next.org:9/y", ""), (3, "http://next.org/z", "")], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.verdict, r.trust > 0) for r in url_filter.judge(pages, [("good.net:81", "/de/", "allow")]).collect()}
    assert got == {1: ("good.net:81", "allow", True), 2: ("me@next.org:9", "allow", True), 3: ("next.org", "allow", True)}


def test_shards_beyond_one_stage(spark, bench, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARDS_AT_ONCE", 1)
    texts = [f"item{k} " * 15 for k in range(5)]
    items = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"a {t} b") for k, t in enumerate([*texts, "none"])], "doc_id long, text string")
    got = decontaminate.contamination(spark, docs, items, shard_bytes=100).collect()
    assert {r.doc_id: (r.n_items, r.contaminated) for r in got} == {**{k: (1, True) for k in range(5)}, 5: (0, False)}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with planted cases, in the layout of the tables."""
    rng, folder = np.random.default_rng(11), str(tmp_path_factory.mktemp("corpus"))
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 900, n))
    items = [words(30) for _ in range(3)]
    rows, toxic = [], set()
    for k in range(400):
        bad = k % 4 == 0
        text = words(80) + (" vile scum filth" * 4 + " " + words(10) if bad else "")
        rows.append((k, text))
        toxic |= {k} if bad else set()
    clean = [t for k, t in rows if k not in toxic]
    exact = [(1200 + k, clean[k].upper()) for k in range(5)]
    near = [(1300 + k, " ".join([*clean[20 + k].split()[:40], "edited", *clean[20 + k].split()[41:]])) for k in range(5)]
    dirty = [(1400 + k, words(30) + " " + items[k % 3].upper() + " " + words(30)) for k in range(5)]
    rows += exact + near + dirty + [(1500, None), (1501, ""), (None, "no id at all here")]
    spark.createDataFrame([(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k % 3 > 0), int(k in toxic)) for k in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, toxic, items


def survivors(rows, items):
    """Brute force of the second to fourth stage: largest id of equal texts, smallest of each five-word group, no contaminated text."""
    from test_llm import five_word_groups

    best = {}
    for i, t in rows:
        key = (t or "").encode().lower()
        if key not in best or (i is not None and (best[key][0] is None or i > best[key][0])):
            best[key] = (i, t)
    kept = list(best.values())
    groups = five_word_groups(kept)
    kept = [r for k, r in enumerate(kept) if groups[k] == r[0]]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower().decode())
    windows = {tuple(w[j : j + 13]) for t in items for w in [split(t)] for j in range(max(1, len(w) - 12))}

    def dirty(t):
        w, hit = split(t), set()
        for x in windows:
            for j in range(len(w) - len(x) + 1):
                if tuple(w[j : j + len(x)]) == x:
                    hit.update(range(j, j + len(x)))
        return len(hit) > 0 and 20 * len(hit) >= len(w)

    return [r for r in kept if not dirty(r[1])]


def test_pipeline_against_brute_force(spark, corpus):
    folder, rows, toxic, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = corpus_pipeline.drop_toxic(spark, docs, folder)
    left = {r.doc_id for r in first.collect()}
    assert len(toxic & left) <= 5 and len({i for i, _ in rows if i not in toxic} - left) <= 5
    got = corpus_pipeline.run(spark, folder)
    want = survivors([(i, t) for i, t in rows if i in left], items)
    assert got.columns[: len(docs.columns)] == docs.columns
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(repr, want))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "decontamination", "mixing"]


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    import textloom.functions.lineage as lineage

    class Context:
        master, getCheckpointDir = "spark://x", lambda self: None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": lambda self, k, d: d})()

    with pytest.raises(RuntimeError):
        lineage.checkpoint_dir(Session())
    assert shared.fresh(spark.createDataFrame([(1, 2)], "A int, a_ int"), "a", "b") == ["a__", "b"]
