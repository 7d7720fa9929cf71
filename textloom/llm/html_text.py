"""Main text of web pages.

The pages of a host decide together: what they have outside articles is concatenated as token streams, a suffix array finds
long substrings that distinct pages repeat, and what these cover is boilerplate on every page of the host. Of a page that marks
no article only unique runs stay. Where an article is marked (article, main, or such a role) the marks are the check that follows:
what is in a marked element that is in no other one, with its titles and leads, is the text, without its blocks of boilerplate.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import scratch, tidy
from .url_filter import host_and_path

#: Substrings of so many tokens on two pages of a host are boilerplate; so many streams go into one suffix array.
REPEAT_TOKENS, PAGES_AN_ARRAY = 8, 500
#: Up to so many substrings are sent to the tasks, more are joined, with the same result.
SEEDS_SENT = 1_000_000
#: Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg canvas title textarea select object audio video math noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CHROME = frozenset("nav footer aside form dialog menu button head search".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Class and id names of what is not the article: all their parts are of these two lists, and one is of the first.
HINTS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo recommended related replies reply respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
FRAMES = frozenset("area article articles bar block body box button buttons col column container content first form group header holder inner item items last left link links list main outer page pane panel post posts primary right row secondary section site slot space thread top bottom unit wrap wrapper".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dt dd tr td th".split())
SCOPE = frozenset("html body article main section div table td th ul ol dl blockquote aside nav footer header form figure".split())
OWN_KIND = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
TOKEN = r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|<[!?/][^>]*(?:>|\Z)|<(?=[A-Za-z]).*\Z|[^<]+|<"
ATTRIBUTE = r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?"
#: What names say nothing about: headings, whose name is a place to jump to, and frames of the whole page.
UNNAMED = frozenset("html body main h1 h2 h3 h4 h5 h6".split())
#: Regions: above 0 for what is in a marked element, 2 for what is in an article.
BODY, MAIN, ARTICLE = 0, 1, 2


def blocks_of(page: str) -> list[tuple[str, int]]:
    """(text, region) of each block outside menus and the like, in page order."""
    out: list[tuple[str, int]] = []
    held: list[str] = []
    #: name, whether its content is left out, region
    stack: list[tuple[str, bool, int]] = []
    drop, region = False, BODY

    def flush() -> None:
        if held:
            if text := " ".join("".join(held).split()):
                out.append((text, region))
            held.clear()

    def top() -> tuple[bool, int]:
        return stack[-1][1:] if stack else (False, BODY)

    raw, skip_to = None, 0
    for m in re.compile(TOKEN, re.S).finditer(page):
        if m.start() < skip_to:
            continue
        name = m[2]
        if name is None:
            if (x := m[0])[0] != "<" or x == "<":
                if not drop:
                    held.append(entities.unescape(x))
            continue
        name = name.lower()
        if m[1]:
            if name in INLINE:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        if k == len(stack) - 1:
                            stack.pop()
                        break
                    if stack[k][0] not in INLINE:
                        break
            else:
                flush()
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                    if name == "p" and stack[k][0] in SCOPE:
                        break
            drop, region = top()
            continue
        if name in RAW:
            if name not in ("svg", "math"):
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, m.end())
            else:
                end = re.compile(rf"</{name}\s*>", re.I).search(page, m.end())
            skip_to = end.end() if end else (m.end() if m[3].endswith("/") else len(page))
            continue
        if name not in INLINE:
            flush()
            if name in CLOSES_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        del stack[k:]
                        break
                    if stack[k][0] in SCOPE:
                        break
            if name in OWN_KIND:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in OWN_KIND[name]:
                        del stack[k:]
                        break
                    if stack[k][0] in SCOPE and stack[k][0] not in ("div", "section"):
                        break
            drop, region = top()
        if name in VOID:
            if name == "br":
                held.append(" ")
            continue
        left_out, own = _judged(name, m[3], region)
        stack.append((name, drop or left_out, max(region, own)))
        if left_out and not drop and name in INLINE:
            flush()
        drop, region = top()
    flush()
    return out


def _is_hint(name: str) -> bool:
    parts = [x for x in re.split(r"[^a-z]+", name) if x]
    return not HINTS.isdisjoint(parts) and all(x in HINTS or x in FRAMES for x in parts)


def _judged(name: str, attributes: str, region: int) -> tuple[bool, int]:
    """Whether an element in a region is left out, and the region that it makes. An article in an article is a comment on it."""
    left_out, own = name in CHROME or name == "header" and region == BODY or name == "article" and region == ARTICLE, BODY
    if name == "article":
        own = ARTICLE
    elif name == "main":
        own = MAIN
    if attributes.strip(" /"):
        for key, *values in re.findall(ATTRIBUTE, attributes):
            value, key = "".join(values).lower(), key.lower()
            if key == "role":
                left_out |= value in CHROME_ROLES
                own = max(own, {"article": ARTICLE, "main": MAIN}.get(value, BODY))
            elif key == "itemprop" and value == "articlebody":
                own = ARTICLE
            elif key in ("class", "id") and name not in UNNAMED:
                left_out |= any(_is_hint(x) for x in value.split())
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                left_out = True
    return left_out, own


def text_of(blocks: list[tuple[str, int]]) -> tuple[str, bool]:
    """The blocks in marked elements, or all where none is, joined by line ends; and whether any is."""
    marked = [t for t, r in blocks if r > BODY]
    return "\n".join(marked or [t for t, _ in blocks]), bool(marked)


def _windows(streams: list[list[str]], owners: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where in the concatenated streams substrings of ``least`` tokens begin, sorted by substring; where a new one begins in
    this order; the least and the greatest owner of a stream that has it.

    A suffix array of the concatenated streams, sorted by doubling as deep as ``least`` tokens; neighbours in it that
    agree to this depth are the repeats. Streams are set apart by tokens of their own.
    """
    ids: dict[str, int] = {}
    flat = []
    for k, s in enumerate(streams):
        flat += [ids.setdefault(t, len(ids)) for t in s] + [-k - 1]
    sizes = np.array([len(s) + 1 for s in streams], np.int64)
    rank = np.unique(np.array(flat, np.int64), return_inverse=True)[1].astype(np.int64)
    n, depth = len(flat), 1
    while depth < least:
        step = min(depth, least - depth)
        then = np.full(n, -1, np.int64)
        then[: max(n - step, 0)] = rank[step:]
        suffixes = np.lexsort((then, rank))
        new = np.concatenate([[0], np.cumsum((rank[suffixes][1:] != rank[suffixes][:-1]) | (then[suffixes][1:] != then[suffixes][:-1]))])
        rank[suffixes] = new[:n]
        depth += step
    at = np.flatnonzero(np.arange(n) + least < np.repeat(np.cumsum(sizes), sizes))
    own = np.repeat(owners, sizes)[at]
    order = np.lexsort((own, rank[at]))
    at, own = at[order], own[order]
    start = np.flatnonzero(np.diff(rank[at], prepend=-1))
    return at, start, own[start], own[np.append(start, len(at))[1:] - 1]


def _covered(n: int, at: np.ndarray, least: int) -> np.ndarray:
    """Which of ``n`` tokens are in a substring of ``least`` tokens that begins at one of these places."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, at, 1)
    np.subtract.at(steps, np.minimum(at + least, n), 1)
    return np.cumsum(steps[:-1]) > 0


def repeated(streams: list[list[str]], least: int = REPEAT_TOKENS) -> list[np.ndarray]:
    """Which tokens of each stream lie in a substring of ``least`` tokens that another stream has as well."""
    at, start, low, high = _windows(streams, np.arange(len(streams)), least)
    sizes = np.diff(np.append(start, len(at)))
    inside = _covered(sum(len(s) + 1 for s in streams), at[np.repeat(low != high, sizes)], least)
    cuts = np.cumsum([0, *(len(s) + 1 for s in streams)])
    return [inside[a : b - 1] for a, b in zip(cuts, cuts[1:], strict=False)]


def _hash(x: str) -> int:
    return xxhash.xxh64_intdigest(x)


def _seeds(tokens: list[str], host: str | None, least: int, known: dict[str, int]) -> np.ndarray:
    """A 64-bit hash of each ``least`` tokens in a row, and of the host; ``known`` keeps the hashes of tokens."""
    n = len(tokens) - least + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    for t in tokens:
        if t not in known:
            known[t] = _hash(t)
    each, out = np.array([known[t] for t in tokens], np.uint64), np.zeros(n, np.uint64)
    for k in range(least):
        out = out * np.uint64(0x9E3779B97F4A7C15) + each[k : k + n]
    return (out ^ np.uint64(_hash(host or ""))).view(np.int64)


#: Tokens whose hashes a task keeps, and pages whose seeds it makes at once.
KNOWN, ROWS = 200_000, 500


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of each page, one a line, whether they are marked, the digest of their tokens (pages with the same ones are one), and the text beside marked elements."""
    for b in batches:
        blocks = [blocks_of(p.as_py() or "") for p in b.column(3)]
        found = [text_of(x) for x in blocks]
        digests = [hashlib.sha256(" ".join(x.split()).encode()).digest() for x, _ in found]
        beside = ["\n".join(t for t, r in x if m and r == BODY) for x, (_, m) in zip(blocks, found, strict=True)]
        columns = [pa.array(digests, pa.binary()), pa.array([x for x, _ in found], pa.string()), pa.array([m for _, m in found], pa.bool_()), pa.array(beside, pa.string())]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], *columns], names=["page_id", "url", "host", "own", "blocks", "marked", "beside"])


def _array(least: int) -> Callable:
    """The substrings of one array's streams, by seed, with the least and the greatest owner: of a host's only array those that two have."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        streams = [re.split("[ \n]", x) for x in t.column("stream").to_pylist()]
        at, start, low, high = _windows(streams, np.asarray(t.column("owner").combine_chunks()), least)
        known: dict[str, int] = {}
        seeds = [np.append(_seeds(s, key[0].as_py(), least, known), np.zeros(min(least, len(s) + 1), np.int64)) for s in streams]
        sent = (low != high) | (key[2].as_py() > 1)
        return pa.table({"seed": np.concatenate(seeds)[at[start]][sent], "low": low[sent], "high": high[sent]})

    return run


def _has(sorted_seeds: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    if not len(sorted_seeds):
        return np.zeros(len(seeds), bool)
    return sorted_seeds[np.minimum(np.searchsorted(sorted_seeds, seeds), len(sorted_seeds) - 1)] == seeds


def _words(blocks: str) -> list[list[str]]:
    return [x.split(" ") for x in blocks.split("\n")] if blocks else []


def _without(pages: list[list[str]], gone: np.ndarray, marked: bool) -> str:
    """The blocks of a page without what is gone: of a marked one whole blocks, if any stays."""
    at, kept = 0, []
    for words in pages:
        mask = gone[at : at + len(words)]
        if marked:
            kept += [] if mask.all() else [" ".join(words)]
        elif left := [w for w, x in zip(words, mask.tolist(), strict=True) if not x]:
            kept.append(" ".join(left))
        at += len(words)
    return "\n".join(kept or ([" ".join(x) for x in pages] if marked else []))


def _asked(least: int, sent: Broadcast | None) -> Callable:
    """host, own, marked, owner and seed of each substring of the pages' own text, or of those whose seeds were sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            if len(known) > KNOWN:
                known.clear()
            seeds = [np.unique(_seeds([w for x in _words(t) for w in x], h, least, known)) for h, t in zip(b.column("host").to_pylist(), b.column("blocks").to_pylist(), strict=True)]
            if sent is not None:
                seeds = [x[_has(sent.value[0], x)] for x in seeds]
            rows = np.repeat(np.arange(len(seeds)), [len(x) for x in seeds])
            columns = [b.column(x).take(pa.array(rows)) for x in ("host", "own", "marked", "owner")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate([np.zeros(0, np.int64), *seeds]))], names=["host", "own", "marked", "owner", "seed"])

    return run


def _texts(least: int, sent: Broadcast | None) -> Callable:
    """page_id, url and the text of each page, without the substrings whose seeds were sent, or are its own ``seeds``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            if len(known) > KNOWN:
                known.clear()
            texts, own = [], None if sent is not None else b.column("seeds")
            for k, (host, blocks, marked) in enumerate(zip(*(b.column(x).to_pylist() for x in ("host", "blocks", "marked")), strict=True)):
                pages = _words(blocks)
                tokens = [w for x in pages for w in x]
                if own is None:
                    gone = sent.value[int(marked)]
                else:
                    gone = np.sort(np.asarray(own[k].values)) if own[k].is_valid else np.zeros(0, np.int64)
                at = np.flatnonzero(_has(gone, _seeds(tokens, host, least, known))) if len(gone) else gone
                texts.append(_without(pages, _covered(len(tokens), at, least), marked) if len(at) else blocks)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


_ASKED, _TEXT = "host string, own binary, marked boolean, owner long, seed long", "page_id long, url string, text string"


def _shared(rows: DataFrame) -> DataFrame:
    """The seeds that two owners have."""
    return rows.groupBy("seed").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("seed")


def _sent(seeds: DataFrame) -> np.ndarray:
    return np.sort(np.asarray(seeds.toArrow().column("seed").combine_chunks()))


def main_text(pages: DataFrame, least: int = REPEAT_TOKENS, pages_an_array: int = PAGES_AN_ARRAY, seeds_sent: int = SEEDS_SENT) -> DataFrame:
    """One row per page: page_id, url, text (blocks joined by line ends, empty if none), n_chars (code points).

    Character references are decoded once, white space inside a block becomes one space. Null html is empty. Pages are
    parsed once and their blocks written down. What every page, marked or not, has outside marked elements is dealt by host
    into suffix arrays of about ``pages_an_array`` streams, so that a host with a third of all pages does not land in one task;
    owners of a substring of ``least`` tokens are brought together over the arrays of their host by a hash, so the arrays' size
    does not change the text. A substring that two pages have there is boilerplate of the host; menus and the like do not count,
    since they are out already and adverts and footers quote articles. A page without marks loses all that boilerplate covers. A
    marked page loses blocks that are covered whole, by boilerplate that is in another article as well: what is in one article
    alone is that article's, however many pages quote it; an article of nothing else stays. What articles alone share is text,
    since articles have copies. Pages of a host whose own text has the same tokens are one page, however many rows they are.
    Pages without a host share the empty one. An empty table gives an empty result. Other columns than page_id, url and html
    are not read; long pages are read whole.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.select("page_id", "url", host_and_path(F.col("url"))[0].alias("host"), "html")
    parsed = scratch(rows.mapInArrow(tidy(_parsed), "page_id long, url string, host string, own binary, blocks string, marked boolean, beside string"), "pages")
    parsed = parsed.withColumn("owner", F.xxhash64("own"))
    outside = parsed.select("host", "owner", F.when(F.col("marked"), F.col("beside")).otherwise(F.col("blocks")).alias("stream"))
    streams = outside.where(F.size(F.split("stream", "[ \\n]")) >= least).distinct()
    arrays = streams.groupBy("host").agg(F.ceil(F.count("*") / pages_an_array).alias("arrays")).withColumnRenamed("host", "of")
    dealt = streams.join(arrays, F.col("host").eqNullSafe(F.col("of"))).withColumn("array", F.pmod(F.xxhash64("stream"), F.col("arrays")))
    found = dealt.select("owner", "stream", "host", "array", "arrays").groupBy("host", "array", "arrays").applyInArrow(_array(least), "seed long, low long, high long")
    shared = scratch(_shared(found), "boilerplate")
    n = shared.count()
    if n == 0:
        return _counted(parsed.select("page_id", "url", F.col("blocks").alias("text")))
    own = parsed.select("host", "own", "marked", "owner", "blocks")
    sc = pages.sparkSession.sparkContext
    if n <= seeds_sent:
        sent = sc.broadcast([_sent(shared)])
        articles = own.where("marked").mapInArrow(tidy(_asked(least, sent)), _ASKED)
        in_articles = _shared(articles.withColumns({"low": F.col("owner"), "high": F.col("owner")}))
        gone = sc.broadcast([sent.value[0], _sent(in_articles)])
        return _counted(parsed.select("page_id", "url", "host", "blocks", "marked").mapInArrow(tidy(_texts(least, gone)), _TEXT))
    asked = scratch(own.distinct().mapInArrow(tidy(_asked(least, None)), _ASKED).join(shared, "seed"), "covered")
    in_articles = _shared(asked.where("marked").withColumns({"low": F.col("owner"), "high": F.col("owner")}))
    lost = asked.where("not marked").unionByName(asked.where("marked").join(in_articles, "seed", "left_semi"))
    lost = lost.groupBy(*(F.col(x).alias(f"at_{x}") for x in ("host", "own", "marked"))).agg(F.collect_set("seed").alias("seeds"))
    same = [F.col(x).eqNullSafe(F.col(f"at_{x}")) for x in ("host", "own", "marked")]
    each = parsed.join(lost, same, "left").select("page_id", "url", "host", "blocks", "marked", "seeds")
    return _counted(each.mapInArrow(tidy(_texts(least, None)), _TEXT))


def _counted(texts: DataFrame) -> DataFrame:
    return texts.withColumn("n_chars", F.length("text").cast("bigint"))
