"""Mixing to target weights with soft membership, by DataFrame functions only.

A classifier learnt from the labelled table gives every document posteriors over domains. Projected gradient descent
then fits nonnegative rates, one per document, so that the expected tokens of each domain match its target. A rate
depends on its document's posteriors alone, so documents are summed by posterior first, and an iteration passes over
those sums; only one number per domain goes to the driver.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, fresh

#: Domain of a label row, and the share of all tokens that each is to have.
DOMAINS = {"toxic": "toxic = 1", "low": "toxic = 0 and quality = 0", "high": "toxic = 0 and quality = 1"}
TARGETS = {"toxic": 0.05, "low": 0.15, "high": 0.80}
SAMPLE, WORDS, LEAST_DOCUMENTS = 20_000, 256, 3
STEPS, PLACES, TOLERANCE = 30, 3, 1e-5


def words_of(text: Column) -> Column:
    """Lower-case words between ASCII white space; splitting at one character is Java's fast path."""
    return F.array_remove(F.split(F.translate(F.lower(F.coalesce(text, F.lit(""))), "\t\n\x0b\x0c\r", "     "), " "), "")


def learn(docs: DataFrame, labels: DataFrame, domains: dict[str, str] = DOMAINS, sample: int = SAMPLE, n_words: int = WORDS) -> tuple[list[str], list[float], list[tuple]]:
    """(domains seen, their log priors, [(word, log-odds of its presence by domain)]) of a Bernoulli classifier.

    It reads at most ``sample`` labelled documents, by a hash of their id, and keeps the ``n_words`` words that tell the
    domains apart best, so what reaches the driver is bounded by the parameters.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), reduce(lambda c, d: c.when(F.expr(d[1]), F.lit(d[0])), domains.items(), F).alias("domain"))
    known = known.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(few), "doc_id")
    seen = cut(rows.select("domain", F.array_distinct(words_of(F.col("text"))).alias("words")))
    sizes = {r.domain: r.n for r in seen.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        return [], [], []
    counts = seen.select("domain", F.explode("words").alias("word")).groupBy("word").agg(*(F.count_if(F.col("domain") == d).alias(f"n{k}") for k, d in enumerate(names)))
    total = reduce(lambda a, b: a + b, (F.col(f"n{k}") for k in range(len(names))))
    rate = lambda k: (F.col(f"n{k}") + 0.5) / F.lit(sizes[names[k]] + 1.0)
    mean = (total + 0.5) / F.lit(sum(sizes.values()) + 1.0)
    # The classes' divergence from the mean in this one word, all classes alike.
    gain = reduce(lambda a, b: a + b, (rate(k) * F.log(rate(k) / mean) + (1 - rate(k)) * F.log((1 - rate(k)) / (1 - mean)) for k in range(len(names))))
    best = counts.where(total >= LEAST_DOCUMENTS).withColumn("gain", gain).orderBy(F.col("gain").desc(), "word").limit(n_words)
    n = sum(sizes.values())
    def logs(r) -> tuple:
        p = [(r[f"n{k}"] + 0.5) / (sizes[d] + 1.0) for k, d in enumerate(names)]
        return (r.word, [math.log(x) - math.log(1 - x) for x in p], [math.log(1 - x) for x in p])

    got = [logs(r) for r in best.collect()]
    prior = [math.log((sizes[d] + 1) / (n + len(names))) + sum(g[2][k] for g in got) for k, d in enumerate(names)]
    return names, prior, [(w, odds) for w, odds, _ in got]


def with_posteriors(docs: DataFrame, labels: DataFrame, domains: dict[str, str] = DOMAINS) -> tuple[DataFrame, list[str], str, str]:
    """``docs`` with a posterior (an array with a value per domain, rounded to PLACES so that documents alike are summed
    together) and its number of tokens, the domains, and the names of both columns; each step has a projection of its
    own, so that a text is split and a word looked up once."""
    names, prior, odds = learn(docs, labels, domains)
    posterior, tokens, words, present, logits, top, weights, total = fresh(docs, "posterior", "n_tokens", "words", "present", "logits", "top", "weights", "total")
    df = docs.withColumn(words, words_of(F.col("text").cast("string")))
    known = F.array(*(F.lit(w) for w, _ in odds)).cast("array<string>")
    df = df.withColumns({tokens: F.size(words).cast("bigint"), present: F.array_intersect(words, known)}).drop(words)
    if odds:
        table = F.create_map(*(x for w, o in odds for x in (F.lit(w), F.array(*(F.lit(float(v)) for v in o)))))
        df = df.withColumn(present, F.transform(present, lambda w: F.element_at(table, w)))
        logit = lambda k: F.aggregate(present, F.lit(float(prior[k])), lambda a, x: a + F.get(x, k))
    else:
        logit = lambda k: F.lit(float(prior[k]))
    df = df.withColumn(logits, F.array(*(logit(k) for k in range(len(names)))).cast("array<double>")).drop(present)
    df = df.withColumn(top, F.array_max(logits))
    df = df.withColumn(weights, F.transform(logits, lambda x: F.exp(x - F.col(top)))).drop(logits, top)
    df = df.withColumn(total, F.aggregate(weights, F.lit(0.0), lambda a, x: a + x))
    return df.withColumn(posterior, F.transform(weights, lambda x: F.round(x / F.col(total), PLACES))).drop(weights, total), names, posterior, tokens


def _dot(p: Column, v: list[float]) -> Column:
    return reduce(lambda a, b: a + b, (F.get(p, k) * F.lit(float(x)) for k, x in enumerate(v)))


def _step(p: Column, rate: Column, residual: list[float], push: list[float]) -> Column:
    """A rate after a step; one at zero that the residual would make negative stays there."""
    return F.when((rate <= 0) & (_dot(p, residual) <= 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), rate + _dot(p, push)))


def rate_of(posterior: Column, history: list[tuple[list[float], list[float]]]) -> Column:
    """The rate after the steps in ``history`` (residual and push by domain), from 1, never below 0."""
    if not history:
        return F.lit(1.0)
    of = lambda v: F.array(*(F.lit(float(x)) for x in v))
    steps = F.array(*(F.struct(of(a).alias("residual"), of(b).alias("push")) for a, b in history))
    dot = lambda v: F.aggregate(F.zip_with(posterior, v, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(steps, F.lit(1.0), lambda r, h: F.when((r <= 0) & (dot(h["residual"]) <= 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), r + dot(h["push"]))))


def fit_rates(scored: DataFrame, names: list[str], targets: dict[str, float] = TARGETS, steps: int = STEPS, posterior: str = "posterior", tokens: str = "n_tokens") -> list[tuple[list[float], list[float]]]:
    """The steps of projected-gradient least squares on the expected tokens of each domain minus its target.

    The total stays that of the documents; targets of domains that no label has are shared out among the others. The
    gradient is scaled by the curvature of the documents that are free to move; of that step, parts of it and the plain
    gradient the one with the least squares is taken. It ends where every domain is within ``TOLERANCE`` of the total from
    its target, or where no step gains any more (nonnegative rates cannot come nearer), or after ``steps``.
    """
    if not names:
        return []
    k = len(names)
    cells = cut(scored.groupBy(F.col(posterior).alias("posterior")).agg(F.sum(tokens).cast("double").alias("tokens")).where("tokens > 0"))
    p = F.col("posterior")
    sums = lambda rates: [F.coalesce(F.sum(F.col("tokens") * F.get(p, j) * x), F.lit(0.0)) for x in rates for j in range(k)]
    mass = np.array(cells.agg(*sums([F.lit(1.0)])).first(), float)
    total, share = float(mass.sum()), sum(targets.get(d, 0.0) for d in names) or 1.0
    if not total:
        return []
    goal = np.array([total * targets.get(d, 0.0) / share for d in names])
    history: list[tuple[list[float], list[float]]] = []
    residual = goal - mass
    for _ in range(steps):
        if np.abs(residual).max() <= TOLERANCE * total:
            break
        held = cells.withColumn("rate", rate_of(p, history))
        free = F.when((F.col("rate") > 0) | (_dot(p, residual) > 0), F.col("tokens")).otherwise(0.0)
        pairs = [(i, j) for i in range(k) for j in range(k)]
        curve = np.array(held.agg(*(F.sum(free * F.get(p, i) * F.get(p, j)) for i, j in pairs)).first(), float).reshape(k, k)
        whole = np.linalg.pinv(curve + 1e-9 * total * np.eye(k)) @ residual
        plain = residual / max(float(np.linalg.eigvalsh(curve)[-1]), 1e-9 * total)
        tried = [(t * whole).tolist() for t in (1.0, 0.5, 0.25, 0.06, 0.015)] + [(t * plain).tolist() for t in (1.0, 0.25)]
        got = np.array(held.agg(*sums([_step(p, F.col("rate"), residual.tolist(), v) for v in tried])).first(), float).reshape(len(tried), k)
        error = ((goal - got) ** 2).sum(1)
        best = int(np.argmin(error))
        if error[best] >= (residual**2).sum() * (1 - TOLERANCE):
            break
        history.append((residual.tolist(), tried[best]))
        residual = goal - got[best]
    return history


def mix(docs: DataFrame, labels: DataFrame, domains: dict[str, str] = DOMAINS, targets: dict[str, float] = TARGETS, steps: int = STEPS, columns: list[str] | None = None) -> DataFrame:
    """``docs`` with domain (the likeliest; ties go to the first name), posterior (array), n_tokens, rate and copies.

    ``copies`` is the rate rounded down or up by a hash of doc_id and text, so that its mean is the rate. With
    ``columns``, only these of ``docs`` stay, and the texts are read once less. Null and empty texts have no tokens and
    the priors' posteriors. Labels whose values are null or name no domain are ignored; without labels the rate is 1
    everywhere. Repeated rows get equal values; an empty table stays empty. A column of ``docs`` that has one of the new
    names stays, and the new one's name ends in an underscore. A text of any length is one row's array of words.
    """
    scored, names, posterior, tokens = with_posteriors(docs, labels, domains)
    domain, rate, copies, draw = fresh(docs, "domain", "rate", "copies", "draw")
    scored = scored.withColumn(draw, F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string")), F.lit(1_000_000)) / 1_000_000.0)
    if columns is not None:
        scored = cut(scored.select(*columns, posterior, tokens, draw))
    named = F.element_at(F.array(*(F.lit(d) for d in names)), F.array_position(posterior, F.array_max(posterior)).cast("int")) if names else F.lit(None).cast("string")
    out = scored.withColumns({domain: named, rate: rate_of(F.col(posterior), fit_rates(scored, names, targets, steps, posterior, tokens))})
    more = F.floor(rate) + (F.col(draw) < F.col(rate) - F.floor(rate)).cast("bigint")
    return out.withColumn(copies, more.cast("bigint")).drop(draw)
