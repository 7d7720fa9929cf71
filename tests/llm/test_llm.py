"""The training-data operators against brute force on small tables with nulls, empty and long texts, ties and copies."""

import base64
import gzip
import hashlib
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textloom.functions import lineage
from textloom.llm import components, decontaminate, exact_dedup, html_text, mixing, near_copies, pii, simhash, substring_dedup, toxicity, url_filter, warc
from textloom.llm.components import connected_components

W = [f"w{i}" for i in range(400)]
LONG = " ".join(W[i * 7 % 400] + str(i % 11) for i in range(3000))
TEXTS = [(5, "Same TEXT here"), (9, "same text HERE"), (9, "same text here"), (None, "same text here"), (1, None), (2, ""), (3, "ÀB"), (4, "àb"), (6, LONG), (7, LONG + " x"), (8, " ".join(W[:40])), (10, "a " + " ".join(W[5:30]) + " b"), (11, " ".join(W[:40])), (12, " \n\t ")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "clash") for i, t in TEXTS], "doc_id long, text string, lang string, sha string")


@pytest.mark.parametrize("budget", [1 << 20, 1])
def test_exact_groups(spark, budget):
    texts = [*TEXTS, *TEXTS[:3], (70, "many"), *[(70, "many")] * 40, (None, ""), (None, "")]
    docs = spark.createDataFrame([(i, t, "x", k, "y") for k, (i, t) in enumerate(texts)], "doc_id long, text string, own string, row int, _k string").repartition(3)
    groups = {}
    for i, t in texts:
        groups.setdefault((t or "").encode().lower(), []).append(i)
    want = sorted(repr((i, max((x for x in v if x is not None), default=None), len(v), hashlib.sha256(k).hexdigest())) for k, v in groups.items() for i in v)
    got = exact_dedup.exact_groups(docs, budget).collect()
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == want
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = exact_dedup.exact_dedup(docs, budget)
    assert kept.columns == docs.columns
    rows = [((r.text or "").encode().lower(), r.doc_id) for r in kept.collect()]
    assert sorted(rows, key=repr) == sorted(((k, max((x for x in v if x is not None), default=None)) for k, v in groups.items()), key=repr)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_grace_tables_keep_within_their_budget():
    records = [(hashlib.sha256(b"%d" % (k % 5000)).digest(), k, 0, k % 7, 1, b"%d" % (k % 5000)) for k in range(20_000)]
    sizes, rows = [], {}

    def emit(held):
        sizes.append((held.bytes, len(held.entries)))
        for content, best, n in zip(held.contents, held.best, held.counts, strict=True):
            rows[content] = rows.get(content, ()) + ((best[0], n),)
        return ()

    list(exact_dedup.grace(iter(records), emit, 100_000, members=True))
    assert rows == {b"%d" % k: ((15_000 + k, 4),) for k in range(5000)}
    assert len(sizes) > 10 and max(b - exact_dedup.MEMBER_BYTES * n for b, n in sizes) < 110_000


def fingerprint(t):
    w = (t or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h)) if h else 0


def test_near_groups(docs):
    fps = {(i, t): fingerprint(t) for i, t in TEXTS}
    left, want = list(fps), {}
    while left:
        group = [left.pop()]
        for x in group:
            near = [y for y in left if (fps[x] ^ fps[y]).bit_count() <= 2]
            left = [y for y in left if y not in near]
            group += near
        for x in group:
            want[x] = min((i for i, _ in group if i is not None), default=None)
    got = simhash.near_groups(docs).collect()
    assert sorted(repr((r.doc_id, r.fingerprint, r.component_id)) for r in got) == sorted(repr((i, f"{fps[i, t]:016x}", want[i, t])) for i, t in TEXTS)


def five_word_groups(texts):
    """Brute force: the smallest id of each row's group under five-word Jaccard similarity 4/5."""

    def words5(t):
        w = (t or "").encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    sets, left, want = [words5(t) for _, t in texts], set(range(len(texts))), {}
    while left:
        group = [left.pop()]
        for x in group:
            near = {y for y in left if 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y])}
            left -= near
            group += near
        for x in group:
            want[x] = min((texts[y][0] for y in group if texts[y][0] is not None), default=None)
    return want


def near_texts():
    """Sources with chains of edited copies, one large group, and a passage that many texts share."""
    rng = np.random.default_rng(3)
    draw = lambda n: [f"v{x}" for x in rng.integers(0, 5000, n)]
    passage, out = draw(30), []
    for k in range(25):
        words = draw(int(rng.integers(20, 150))) + passage * (k % 2)
        for _ in range(40 if k == 0 else 4):
            out.append(" ".join(words))
            for at in rng.integers(0, len(words), int(rng.integers(1, 3))):
                words = [*words[:at], "new" + str(rng.integers(9999)), *words[at + 1 :]]
    return list(enumerate(out, 100)) + TEXTS


@pytest.mark.parametrize("block", [512, 3])
def test_near_dedup_takes_five_word_copies(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    monkeypatch.setattr(near_copies, "PAIRS", 2 * block)
    texts = near_texts()
    want = five_word_groups(texts)
    copies = spark.createDataFrame(texts, "doc_id long, text string")
    kept = sorted({i for i, _ in texts if i is not None and i in set(want.values())})
    assert sorted({r.doc_id for r in simhash.near_dedup(copies).collect()}) == kept
    got = sorted(repr(tuple(r)) for r in near_copies.near_copy_groups(copies).collect())
    assert got == sorted(repr((i, want[k])) for k, (i, _) in enumerate(texts))


def test_near_dedup_asks_fingerprints_first(spark, monkeypatch):
    """Fingerprints name candidates, which are confirmed before any is found by shingles; even classes that are no copies change no group."""
    texts, asked, pairs, real = near_texts(), [], [], near_copies._of_classes
    copies, want = spark.createDataFrame(texts, "doc_id long, text string"), five_word_groups(texts)
    kept = sorted({i for i, _ in texts if i is not None and i in set(want.values())})
    links = simhash.fingerprint_links
    monkeypatch.setattr(simhash, "fingerprint_links", lambda *a: asked.append(1) or links(*a))
    monkeypatch.setattr(near_copies, "_of_classes", lambda *a: pairs.append(real(*a)) or pairs[-1])
    assert sorted({r.doc_id for r in simhash.near_dedup(copies).collect()}) == kept
    assert asked == [1] and pairs[0].count() > 0
    monkeypatch.setattr(simhash, "alike_texts", lambda docs: docs.select(F.xxhash64("text").alias("own"), F.lit(0).alias("class")).distinct())
    assert sorted({r.doc_id for r in simhash.near_dedup(copies).collect()}) == kept


@pytest.mark.parametrize("limit", [256, 2])
def test_links_connect_all_close_fingerprints(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "LONG_RUN", limit)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64) * np.uint64(2)
    fps = sorted({int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 64, (12, 2))} | {int(b) for b in base})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    roots = {r.node: r.root for r in connected_components(links).collect()}
    root = lambda x: roots.get(x, x)
    for a, x in zip(signed, fps, strict=True):
        for b, y in zip(signed, fps, strict=True):
            if (x ^ y).bit_count() <= 2:
                assert root(a) == root(b)
    assert len({root(x) for x in signed}) == 12


def spans_by_brute_force(texts, window=13):
    ids = lambda i: float("inf") if i is None else i
    windows = {}
    for i, t in texts:
        w = (t or "").split()
        for j in range(len(w) - window + 1):
            windows[tuple(w[j : j + window])] = min(ids(i), windows.get(tuple(w[j : j + window]), float("inf")))
    want = []
    for i, t in texts:
        w, gone = (t or "").split(), set()
        for j in range(len(w) - window + 1):
            if windows[tuple(w[j : j + window])] < ids(i):
                gone.update(range(j, j + window))
        want.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(map(repr, want))


def repeating_texts():
    """Passages that many texts share, texts of very few words in any order, copies, rows repeated with one id, ids without remainder by 16."""
    rng = np.random.default_rng(5)
    passages = [[f"p{x}" for x in rng.integers(0, 60, 40)] for _ in range(4)]
    out = []
    for k in range(60):
        own = [f"q{x}" for x in rng.integers(0, 3000, 30)]
        a, b = sorted(rng.integers(0, 41, 2).tolist())
        out.append((16 * k, " ".join(own[:15] + passages[k % 4][a:b] + own[15:] + passages[(k + 1) % 4][: b - a])))
        if k % 3 == 0:
            out.append((16 * int(rng.integers(60)), " ".join(rng.choice(["x", "y"], 40))))
            out.append((None if k % 2 else 16 * k, out[-2][1]))
    return out + out[::7]


@pytest.mark.parametrize(("partitions", "part_bytes", "seed_bits", "hot"), [(4, 6 << 20, 64, 512), (1, 300, 64, 512), (16, 300, 64, 1), (4, 500, 2, 512), (4, 500, 3, 2)])
def test_duplicate_spans(spark, partitions, part_bytes, seed_bits, hot):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    texts = TEXTS + repeating_texts()
    try:
        df = spark.createDataFrame([(i, t, 1, "clash") for i, t in texts], "doc_id long, text string, part int, bucket string")
        got = substring_dedup.duplicate_spans(df, part_bytes=part_bytes, seed_bits=seed_bits, hot_parts=hot, hot_windows=hot).collect()
        assert substring_dedup.duplicate_spans(df.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(repr((r.doc_id, r.n_words, r.n_removed, r.kept_text)) for r in got) == spans_by_brute_force(texts)
    of = {}
    for i, t in texts:
        of.setdefault(i, []).append((t or "").split())
    for r in got:
        covered = set()
        own = [w for w in of[r.doc_id] if len(w) == r.n_words]
        for f in r.factors:
            assert f.words >= 13 and (r.doc_id is None or f.ref_doc < r.doc_id)
            assert any(w[f.start : f.start + f.words] == o[f.ref_start : f.ref_start + f.words] for w in own for o in of[f.ref_doc])
            covered.update(range(f.start, f.start + f.words))
        assert len(covered) == r.n_removed


@pytest.mark.parametrize("shard", [1 << 20, 100])
def test_contamination(spark, docs, shard):
    items = [(1, " ".join(W[8:25])), (2, "text, HERE!"), (3, None), (4, ""), (10, " ".join(W[:13])), (None, "àb")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word, low = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda t: (t or "").encode().lower().decode()
    patterns = [(str(i) if i is not None else "", w[j : j + 13]) for i, t in items for w in [word.findall(low(t))] if w for j in range(max(1, len(w) - 12))]
    want = []
    for i, t in TEXTS:
        w, hit, found = word.findall(low(t)), set(), set()
        for item, p in patterns:
            for j in range(len(w) - len(p) + 1):
                if w[j : j + len(p)] == p:
                    hit.update(range(j, j + len(p)))
                    found.add(item)
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    got = decontaminate.contamination(spark, docs, bench, shard_bytes=shard).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    clean = decontaminate.drop_contaminated(spark, docs, bench, shard_bytes=shard)
    assert clean.columns == docs.columns and clean.count() == sum(not x[-1] for x in want)


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(2, "u\r\nX: y", "a\r\n\r\nb"), (1, None, "a\r\n\r\nb"), (3, "v", None), (4, "v", ""), (None, "q", "é"), (5, "q", "a\r\n\r\nb")], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_round_trip(spark, pages).collect()}
    assert got == {1: (6, "response", None), 2: (6, "revisit", 1), 5: (6, "revisit", 1), 3: (0, "response", None), 4: (0, "revisit", 3), None: (2, "response", None)}
    assert warc.archive_round_trip(spark, pages.limit(0)).count() == 0


def test_archives_hold_every_payload(spark, tmp_path):
    rng = np.random.default_rng(4)
    texts = ["", "x", "\r\n\r\nWARC/1.1\r\n", LONG * 60, *("".join(map(chr, rng.integers(32, 3000, 50))) for _ in range(40))]
    rows = [(k, None if k % 5 == 0 else f"u{k}", texts[k * 7 % len(texts)]) for k in range(90)] + [(3, "again", texts[21]), (None, "q", "x")]
    records = spark.createDataFrame(rows, "record_id long, uri string, payload string")
    path = str(tmp_path / "archive")
    warc.write_warc(warc.resolve_revisits(records, least_bytes=1, archive_bytes=50_000), path, records_a_file=7, date="2020-01-02T03:04:05Z")
    got = warc.read_warc(spark, path, payload=True).collect()
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t] = min(i, first.get(t, i))
    kind = lambda i, t: "response" if t == "" or first[t] == i else "revisit"
    want = [(i, u, kind(i, t), base64.b32encode(hashlib.sha1(t.encode()).digest()).decode(), len(t.encode()), first[t] if kind(i, t) == "revisit" else None, t if kind(i, t) == "response" else "") for i, u, t in rows]
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want))
    two = gzip.compress(b"ab" * 10) + gzip.compress(b"c")
    assert b"".join(warc.inflated(two)) == b"ab" * 10 + b"c" and b"".join(warc.inflated(b"plain")) == b"plain"
    with pytest.raises(ValueError):
        list(warc.inflated(two[:-4]))


def test_url_rules_and_links(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/1", '<a href="http://b.org/x">'), (2, "http://B.org/q?x", '<a href="//a.com/">'), (3, "http://c.net/de/1", None), (4, None, "x"), (5, "no scheme", ""), (6, "http://x.example.net/de/81", "")], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert got == {1: ("a.com", "/en/1", "com/en/", "block"), 2: ("b.org", "/q", None, "block"), 3: ("c.net", "/de/1", "net/de/", "allow"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("x.example.net", "/de/81", "example.net/de/8", "block")}


def test_pagerank_matches_power_iteration(spark):
    edges = [("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 1.0), ("c", "a", 1.0)]
    got = {r.host: r.score for r in url_filter.personalised_pagerank(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame([("a", 1.0)], "host string, seed double"), rounds=6).collect()}
    m = np.array([[0, 0, 1], [0.25, 0, 0], [0.75, 1, 0]])
    x = seed = np.array([0.15, 0, 0])
    for _ in range(6):
        x = seed + 0.85 * m @ x
    assert np.allclose([got["a"], got["b"], got["c"]], x)


def test_pagerank_reaches_hosts_many_links_away(spark):
    edges = [(f"h{k}", f"h{k + 1}", 1.0) for k in range(17)]
    got = url_filter.personalised_pagerank(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame([("h0", 1.0)], "host string, seed double")).collect()
    assert {r.host: r.score for r in got} == pytest.approx({f"h{k}": 0.15 * 0.85**k for k in range(18)}, abs=1e-12)


def test_html(spark):
    pages = [
        (1, "http://h.com/1", "<div>Home page of the host with a menu of items</div><p>One unique text here &lt;b&gt;"),
        (2, "http://h.com/2", '<div>Home page of the host with a menu of items</div><p>Other &amp;amp;&nbsp;words <script>"</p>"</script>here'),
        (3, None, None), (4, "x", ""),
        (6, "http://h.com/1", "<div>Home page of the host with a menu of items</div> <p>One unique text here &lt;b&gt;</p>"),
        (7, "z", '<article><section id="share-prices"><p class="related-work">kept</section><div id="ad-slot-3">no</div><p class="x social-links">no</article>'),
        (5, "z", '<nav>no</nav><article><h1>T</h1><ul><li>a<li>b</ul><div class="comments">no</div><p title="a>b">c <b>d<br>e</p> f &am<aside>no</aside></article><p>out'),
    ]
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    want = {1: "One unique text here <b>", 2: "Other &amp; words here", 3: "", 4: "", 5: "T\na\nb\nc d e\nf &am", 6: "One unique text here <b>", 7: "kept"}
    assert got == {k: (v, len(v)) for k, v in want.items()}


def test_repeats_are_those_of_brute_force():
    rng = np.random.default_rng(1)
    streams = [[str(x) for x in rng.integers(0, 3, n)] for n in (40, 0, 25, 60, 3)]
    got = html_text.repeated(streams, 5)
    for k, s in enumerate(streams):
        want = [False] * len(s)
        for j in range(len(s) - 4):
            if any(s[j : j + 5] == o[i : i + 5] for m, o in enumerate(streams) if m != k for i in range(len(o) - 4)):
                want[j : j + 5] = [True] * 5
        assert got[k].tolist() == want


@pytest.mark.parametrize("pages_an_array", [1, 3, 500])
def test_repeats_are_found_over_the_whole_host(spark, pages_an_array):
    rng = np.random.default_rng(2)
    shared = [[f"s{k}x{i}" for i in range(12)] for k in range(6)]
    pages = []
    for k in range(24):
        own = [f"p{k}x{i}" for i in range(20)]
        mixed = own[:10] + (shared[k // 4] if k % 4 < 2 else []) + own[10:] + shared[int(rng.integers(6))][: int(rng.integers(6, 11))]
        pages.append((k, f"http://{'ab'[k % 8 == 7]}.com/{k}", f"<p>{' '.join(mixed)}</p>"))
    want = {}
    for k, url, page in pages:
        words, gone = page[3:-4].split(" "), set()
        others = [f" {p[3:-4]} " for m, u, p in pages if m != k and u[:12] == url[:12]]
        for i in range(len(words) - 7):
            if any(f" {' '.join(words[i : i + 8])} " in o for o in others):
                gone.update(range(i, i + 8))
        want[k] = " ".join(w for i, w in enumerate(words) if i not in gone)
    got = html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string"), pages_an_array=pages_an_array)
    assert {r.page_id: r.text for r in got.collect()} == want


def test_network_gradients_and_learning():
    p = {k: v.astype(np.float64) for k, v in toxicity.initial(5).items()}
    feats = toxicity.Features({b"aa": 1, b"bb": 2, b"cc": 3})
    ids = feats.add([b"aa bb cc dd aa ee ff aa".split()])[0]
    arrays, windows = feats.arrays(), np.zeros((2, 6), int)
    windows[0], windows[1, :2] = ids[:6], ids[6:]
    total = lambda: float((toxicity.forward(p, windows, toxicity.project(p, toxicity.inputs(p, *arrays))) * np.array([1.0, -2.0])).sum())
    x = toxicity.inputs(p, *arrays)
    _, kept = toxicity.forward(p, windows, toxicity.project(p, x), keep=True)
    for name, g in toxicity.gradients(p, arrays, x, kept, np.array([1.0, -2.0])).items():
        i = tuple(np.unravel_index(np.argmax(np.abs(g)), g.shape))
        p[name][i] += 1e-3
        up = total()
        p[name][i] -= 2e-3
        down = total()
        p[name][i] += 1e-3
        assert abs((up - down) / 2e-3 - g[i]) < 1e-3, name


def test_every_word_is_in_a_window():
    for n in (0, 1, 31, 32, 33, 48, 49, 200):
        assert set(range(1, n + 1)) == set(toxicity.windows_of(np.arange(1, n + 1)).ravel().tolist()) - {0}


def test_toxicity_scores(spark, docs):
    model = spark.sparkContext.broadcast((toxicity.initial(0), {}))
    got = toxicity.toxicity(docs, model)
    assert got.count() == len(TEXTS) and got.where("doc_id in (1, 2, 12)").where("score = 0").count() == 3
    assert toxicity.train([], [])[0]["bias"][0] == -4


def test_mixing(spark, docs):
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0), (8, 1, 0), (10, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = mixing.mix(docs, labels).collect()
    assert len(rows) == len(TEXTS) and all(r.rate >= 0 for r in rows)
    total = sum(r.n_tokens for r in rows)
    assert total == sum(len((t or "").split()) for _, t in TEXTS)
    names = sorted({"low", "high"})
    goal = {d: mixing.TARGETS[d] / (mixing.TARGETS["low"] + mixing.TARGETS["high"]) for d in names}
    error = lambda rate: sum((sum(r.n_tokens * r.posterior[k] * rate(r) for r in rows) - goal[d] * total) ** 2 for k, d in enumerate(names))
    assert error(lambda r: r.rate) < 1e-3 * error(lambda r: 1.0)
    assert [r.rate for r in mixing.mix(docs, labels.limit(0)).collect()] == [1.0] * len(TEXTS)


def test_pseudonyms(spark):
    text = "a 4041894974608795 b +1 (988) 555-2485, m.x1@mail8.example.com 42.144.35.254. 2024-02-29 31/12/1999 123-45-6789; bad 4041894974608796 2023-02-30 999.1.1.1"
    rows = pii.pseudonyms(spark.createDataFrame([(1, text), (2, "x 4041894974608795"), (3, None), (4, "")], "doc_id long, text string"), "key").orderBy("doc_id").collect()
    assert [r.n_values for r in rows] == [7, 1, 0, 0] and rows[2].text is None and rows[3].text == ""
    new = rows[0].text
    assert re.sub(r"[0-9a-z]", "x", new) == re.sub(r"[0-9a-z]", "x", text) or "." in new
    card = new.split()[1]
    digits = [int(c) for c in reversed(card)]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    assert rows[1].text == f"x {card}" and card != "4041894974608795"
    assert new.endswith("bad 4041894974608796 2023-02-30 999.1.1.1")


def test_phones_of_any_area_and_cards_beside_digits(spark):
    card = "4111111111111111"
    texts = ["+1 (017) 555-7713", "+1 (132) 055-1352", "017-555-7713", f"{card} 123", f"12 {card}", card, "4111 1111 1111 1111 7", "4111111111111112 123"]
    got = [r for r in pii.pseudonyms(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").orderBy("doc_id").collect()]
    assert [r.n_values for r in got] == [1, 1, 1, 1, 1, 1, 1, 0]
    new = [r.text for r in got]
    assert all(re.sub("[0-9]", "9", x) == re.sub("[0-9]", "9", y) and (x != y) == (k < 7) for k, (x, y) in enumerate(zip(new, texts, strict=True)))
    assert re.sub("[^0-9]", "", new[0])[1:] == new[2].replace("-", "")
    assert new[3] == f"{new[5]} 123" and new[4] == f"12 {new[5]}" and new[6].replace(" ", "") == f"{new[5]}7" and new[7] == texts[7]


def test_feistel_is_a_permutation(spark):
    n = 30 * 7
    df = spark.range(n).selectExpr("id div 7 l", "id % 7 r")
    from pyspark.sql import functions as F

    x = pii.feistel("k", F.lit("t"), F.col("l"), F.col("r"), F.lit(30), F.lit(7))
    assert df.select((x.l * 7 + x.r).alias("y")).distinct().count() == n


def test_a_cut_leaves_no_shuffle_files_behind(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before = files()
    setting = spark.conf.get(lineage.CLEANUP)
    sums = lineage.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    end = time.time() + 10
    while files() - before and time.time() < end:
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(lineage.CLEANUP) == setting
    assert {r["count"] for r in sums.collect()} == {142, 143}, "the rows stay"


def test_stars_are_settled_without_a_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components, "cut", lambda df: written.append(1) or lineage.cut(df))
    stars = spark.createDataFrame([(1, 5), (1, 6), (2, 7), (7, 2), (3, 3)], "a long, b long")
    assert {tuple(r) for r in components.connected_components(stars).collect()} == {(1, 1), (5, 1), (6, 1), (2, 2), (7, 2)}
    assert len(written) == 1
    chain = spark.createDataFrame([(k, k + 1) for k in range(20)], "a long, b long")
    assert {tuple(r) for r in components.connected_components(chain).collect()} == {(k, 0) for k in range(21)}
