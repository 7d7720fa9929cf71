"""Terms in any script within texts, and how often their translations follow them.

ASCII terms are tokens and are matched by a join (``glossary.term_occurrences``). Terms with other letters have no token
boundary, so they are sought by an automaton over the normalised text. Terms are taken in shards of at most ``SHARD`` keys,
of which ``AT_ONCE`` pass over the texts together: that bounds what is sent to executors, however many terms there are.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Types whose aliases do not count, and scripts that put spaces between words.
SOURCE_ONLY = ("称谓", "敬称", "口癖", "固定表达")
SPACED = ("LATIN", "GREEK", "CYRILLIC")
SHARD = 100_000
#: Shards whose automata a task holds at a time; more need another scan of the texts.
AT_ONCE = 4


def normalized(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold()


def boundaries(key: str) -> tuple[str, bool, bool]:
    """(kind of neighbour that forbids a match: ``ascii``, ``word`` or ``none``; whether on the left; on the right)."""
    if key.isascii():
        return "ascii", True, True
    letters = [c for c in key if c.isalpha()]
    if letters and all(any(s in unicodedata.name(c, "") for s in SPACED) for c in letters):
        return "word", key[0].isalnum(), key[-1].isalnum()
    return "none", False, False


def _joins(kind: str, c: str) -> bool:
    return c == "_" or (c.isalnum() if kind == "word" else c.isascii() and (c.islower() or c.isdigit()))


def merged(spans: list[tuple[int, int]]) -> int:
    """How many spans are left when those that overlap count once; touching ones stay apart."""
    n, end = 0, -1
    for a, b in sorted(spans):
        if a >= end:
            n += 1
        end = max(end, b)
    return n


def spans_of(text: str, automaton: ahocorasick.Automaton) -> dict[str, list[tuple[str, int, int]]]:
    """(key, begin, end) of each term's occurrences in the normalised text; those of one key do not overlap each other."""
    text, last, found = normalized(text), {}, defaultdict(list)
    for end, (key, rule, terms) in automaton.iter(text):
        kind, left, right = rule
        a, b = end - len(key) + 1, end + 1
        if a < last.get(key, 0) or (left and a and _joins(kind, text[a - 1])) or (right and b < len(text) and _joins(kind, text[b])):
            continue
        last[key] = b
        for t in terms:
            found[t].append((key, a, b))
    return found


def count_terms(text: str, automaton: ahocorasick.Automaton) -> dict[str, int]:
    """Occurrences of each term, those of its keys merged."""
    return {t: merged([(a, b) for _, a, b in s]) for t, s in spans_of(text, automaton).items()}


def automaton(keys: dict[str, list[str]]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for key, terms in keys.items():
        out.add_word(key, (key, boundaries(key), terms))
    out.make_automaton()
    return out


def keyed(terms: DataFrame) -> DataFrame:
    """(source, keys) of terms (source, type, aliases): the source and, unless the type forbids it, its aliases."""
    both = F.concat(F.array("source"), F.coalesce("aliases", F.array().cast("array<string>")))
    return terms.select("source", F.when(F.coalesce("type", F.lit("")).isin(*SOURCE_ONLY), F.array("source")).otherwise(both).alias("keys"))


def _scanned(texts: DataFrame, key: str, text: str, terms: DataFrame, shard: int, columns: str, rows_of: Callable) -> DataFrame:
    """What ``rows_of`` (text, automaton) says of every text and shard of terms, behind the text's key: the shards of ``AT_ONCE``
    go to executors by themselves and pass over each batch of texts together."""
    context, total = texts.sparkSession.sparkContext, terms.select(F.sum(F.size("keys"))).first()[0] or 0
    parts = max(1, -(-total * 2 // shard))
    kind = texts.schema[key].dataType.simpleString()
    dealt = terms.withColumn("_part", F.pmod(F.xxhash64("source"), F.lit(parts)))
    outs = []
    for first in range(0, parts, AT_ONCE):
        shards = []
        for part in range(first, min(parts, first + AT_ONCE)):
            keys: dict[str, list[str]] = {}
            for row in dealt.where(F.col("_part") == part).toLocalIterator():  # about half of a shard's keys
                for k in {normalized(k).strip() for k in row["keys"] if k} - {""}:
                    keys.setdefault(k, []).append(row["source"])
            shards.append(context.broadcast(keys))

        def scan(frames: Iterator[pd.DataFrame], shards: list = shards) -> Iterator[pd.DataFrame]:
            machines = [automaton(b.value) for b in shards if b.value]
            for f in frames:
                rows = [(k, *r) for k, t in zip(f["k"], f["t"]) if t for m in machines for r in rows_of(t, m)]
                yield pd.DataFrame(rows, columns=[key, *(c.split()[0] for c in columns.split(", "))])

        outs.append(texts.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(scan, f"`{key}` {kind}, {columns}"))
    return reduce(DataFrame.union, outs)


def term_counts(texts: DataFrame, key: str, text: str, terms: DataFrame, shard: int = SHARD) -> DataFrame:
    """(key, source, n) for every text and term (source, keys) that it has; null texts and blank keys have none."""
    return _scanned(texts, key, text, terms, shard, "source string, n bigint", lambda t, m: count_terms(t, m).items())


def term_spans(texts: DataFrame, key: str, text: str, terms: DataFrame, shard: int = SHARD) -> DataFrame:
    """(key, source, term_key, begin, finish): where the keys of each term stand in the normalised text, ends not included."""
    return _scanned(texts, key, text, terms, shard, "source string, term_key string, begin bigint, finish bigint", lambda t, m: ((s, *x) for s, found in spans_of(t, m).items() for x in found))


def term_rate(pairs: DataFrame, key: str, terms: DataFrame) -> DataFrame:
    """One row (expected, violations, rate): occurrences of each term (source, target, type, aliases) in ``src``, and how
    many of them no occurrence of its target in ``zh`` answers; the rate is 1 where nothing is expected."""
    seen = term_counts(pairs, key, "src", keyed(terms)).join(terms.select("source", "target"), "source")
    targets = terms.select(F.col("target").alias("source")).distinct().withColumn("keys", F.array("source"))
    used = term_counts(pairs, key, "zh", targets).withColumnsRenamed({"source": "target", "n": "m"})
    both = seen.join(used, [key, "target"], "left").select("n", F.greatest(F.col("n") - F.coalesce("m", F.lit(0)), F.lit(0)).alias("v"))
    sums = both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("expected"), F.coalesce(F.sum("v"), F.lit(0)).alias("violations"))
    return sums.withColumn("rate", F.when(F.col("expected") == 0, 1.0).otherwise(F.bround(1 - F.col("violations") / F.col("expected"), 4)))
