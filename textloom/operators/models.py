"""Calls of a language model for every row, with an injected client, retries and token counts.

A lost executor repeats its rows' calls, so the result should be written once and read from there.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.punctuation import repair

# The fake client's token counts; longest wait and spread of a retry.
FAKE_USE = (10, 5)
LONGEST_WAIT, SPREAD = 30.0, 0.2


class Retryable(Exception):
    """A failure of the network or of the service that another call may not meet."""


class Answer(NamedTuple):
    text: str
    prompt_tokens: int
    completion_tokens: int


#: (prompt, stage, chunk, tier) to an answer.
Client = Callable[[str, str | None, int | None, str | None], Answer]


def fake_client(rules: Sequence[dict]) -> Client:
    """Answers by the first rule whose stage, chunk and tier fit; what a rule leaves out fits anything. No rule: ValueError."""

    def call(prompt: str, stage: str | None, chunk: int | None, tier: str | None) -> Answer:
        now = {"stage": stage, "chunk": chunk, "tier": tier}
        for rule in rules:
            if all(rule.get(k) is None or rule[k] == v for k, v in now.items()):
                return Answer(rule["respond"], *FAKE_USE)
        raise ValueError("no rule fits")

    return call


def wait(attempt: int, draw: Callable[[], float] = random.random) -> float:
    """Seconds before another call after the ``attempt``-th: doubling, bounded, spread by a fifth either way."""
    return min(LONGEST_WAIT, 2.0 ** (attempt - 1)) * (1 + SPREAD * (2 * draw() - 1))


def persistent(call: Callable[[], Answer], attempts: int, sleep: Callable[[float], None] = time.sleep) -> tuple[Answer | None, int, str | None]:
    """(answer, calls made, error): only ``Retryable`` failures are tried again."""
    for k in range(1, attempts + 1):
        try:
            return call(), k, None
        except Retryable as e:
            error = str(e)
            if k < attempts:
                sleep(wait(k))
        except Exception as e:  # noqa: BLE001 - one row's failure is that row's result
            return None, k, f"{type(e).__name__}: {e}"
    return None, attempts, error


def complete(rows: DataFrame, key: str, make_client: Callable[[], Client], as_json: bool = False, attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(key, text, prompt_tokens, completion_tokens, calls, error) for rows (key, prompt, stage, chunk, tier).

    One client is made for each task. With ``as_json`` an answer is repaired, and one that is still not JSON is asked for
    again. A row that fails has no text and its error; the others go on.
    """
    kind = rows.schema[key].dataType.simpleString()
    columns = [key, "text", "prompt_tokens", "completion_tokens", "calls", "error"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()

        def ask(row) -> Answer:
            chunk = None if pd.isna(row.chunk) else int(row.chunk)
            answer = client(row.prompt, row.stage, chunk, row.tier)
            if not as_json:
                return answer
            fixed, _ = repair(answer.text)
            if fixed is None:
                raise Retryable("the answer is not JSON")
            return answer._replace(text=fixed)

        for f in frames:
            out = []
            for row in f.itertuples(index=False):
                answer, calls, error = persistent(lambda row=row: ask(row), attempts, sleep)
                out.append((row.key, *(answer or (None, 0, 0)), calls, error))
            yield pd.DataFrame(out, columns=columns)

    asked = rows.select(F.col(key).alias("key"), "prompt", "stage", F.col("chunk").cast("double").alias("chunk"), "tier")
    return asked.mapInPandas(run, f"`{key}` {kind}, text string, prompt_tokens bigint, completion_tokens bigint, calls int, error string")


def repair_rounds(rows: DataFrame, key: str, wrong: Callable[[DataFrame], DataFrame], again: Callable[[DataFrame], DataFrame], most: int = 3) -> DataFrame:
    """``rows`` after at most ``most`` rounds, each of which makes those anew (``again``) that ``wrong`` still finds (key).

    Every round is checkpointed, so neither a call nor a check is repeated for those that were right.
    """
    for _ in range(most):
        bad = cut(wrong(rows).select(F.col(key).alias("_bad")).distinct())
        if bad.isEmpty():
            break
        same = F.col(key) == F.col("_bad")
        rows = cut(rows.join(bad, same, "left_anti").unionByName(again(rows.join(bad, same, "left_semi"))))
    return rows
