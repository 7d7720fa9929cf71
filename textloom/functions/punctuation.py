"""Punctuation of Japanese and Chinese lines, fenced code, and JSON that is not quite JSON.

These depend on earlier lines or on nested structure, which column expressions cannot express, so they are Arrow-batched
functions of one column; each needs no more than the text of one row.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructType

# Replacements, and what keeps its punctuation, in the order in which it is looked for.
BRACKETS = {"「": "“", "」": "”", "『": "‘", "』": "’"}
FULL_WIDTH = {",": "，", ".": "。", "!": "！", "?": "？", ":": "：", ";": "；"}
PROTECTED = (
    r"[A-Za-z][A-Za-z0-9+.\-]*://\S+",
    r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b",
    r"`[^`\n]+`",
    r"\b\d+(?:[.,]\d+)+\b",
    r"(?<![^\s(（])(?:\.{0,2}/)?(?:[\w.-]+/)+[\w.-]+",
)
FENCES = ("```", "~~~")

_PROTECTED = [re.compile(p) for p in PROTECTED]
_RUNS = ((re.compile(r"\.{3,}"), "……"), (re.compile(r"-{2,}"), "——"))
_SINGLE = str.maketrans(BRACKETS | FULL_WIDTH)
_HIDDEN = "\uf8ff"


def fenced(lines: list[str]) -> list[bool]:
    """Whether each line is in fenced code, its fences included; a fence ends at the same mark only, or with the text."""
    out, mark = [], None
    for line in lines:
        here = next((f for f in FENCES if line.lstrip().startswith(f)), None)
        out.append(mark is not None or here is not None)
        if mark is None:
            mark = here
        elif here == mark:
            mark = None
    return out


def exposed(line: str) -> list[tuple[bool, str]]:
    """The line as runs, each with whether its punctuation may change. What one pattern takes is hidden from the next."""
    hidden = line
    for p in _PROTECTED:
        hidden = p.sub(lambda m: _HIDDEN * len(m[0]), hidden)
    runs, at = [], 0
    for m in re.finditer(f"{_HIDDEN}+|[^{_HIDDEN}]+", hidden):
        runs.append((m[0][0] != _HIDDEN, line[at : m.end()]))
        at = m.end()
    return runs


def rewrite(line: str) -> tuple[str, int]:
    """The line with full-width punctuation, and how many replacements that took."""
    out, n = [], 0
    for free, run in exposed(line):
        if free:
            for p, mark in _RUNS:
                run, k = p.subn(mark, run)
                n += k
            n += sum(c in BRACKETS or c in FULL_WIDTH for c in run)
            run = run.translate(_SINGLE)
        out.append(run)
    return "".join(out), n


@F.pandas_udf(StructType().add("text", StringType()).add("n_changes", IntegerType()))
def normalize_punctuation(texts: pd.Series) -> pd.DataFrame:
    """Every line outside fenced code rewritten; null stays null, with no change."""
    rows = []
    for text in texts:
        if text is None:
            rows.append((None, 0))
            continue
        lines = text.split("\n")
        done = [(x, 0) if code else rewrite(x) for x, code in zip(lines, fenced(lines))]
        rows.append(("\n".join(x for x, _ in done), sum(n for _, n in done)))
    return pd.DataFrame(rows, columns=["text", "n_changes"])


@F.pandas_udf(StructType().add("residue", IntegerType()).add("protected", IntegerType()))
def bracket_counts(texts: pd.Series) -> pd.DataFrame:
    """Japanese brackets that a rewrite would change, and those that fenced code and protected runs keep."""
    rows = []
    for text in texts:
        lines, residue, total = (text or "").split("\n"), 0, sum((text or "").count(b) for b in BRACKETS)
        for line, code in zip(lines, fenced(lines)):
            if not code:
                residue += sum(run.count(b) for free, run in exposed(line) if free for b in BRACKETS)
        rows.append((residue, total - residue))
    return pd.DataFrame(rows, columns=["residue", "protected"])


@F.pandas_udf(StringType())
def strip_fenced(texts: pd.Series) -> pd.Series:
    """The text with the lines of fenced code emptied, so that line numbers stay."""

    def one(text):
        lines = text.split("\n")
        return "\n".join("" if code else x for x, code in zip(lines, fenced(lines)))

    return texts.map(one, na_action="ignore")


def _valid(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def _payload(text: str) -> str:
    """What a fence or prose around the outermost object or array holds."""
    text = text.strip()
    for mark in FENCES:
        if text.startswith(mark):
            text = text[len(mark) :].removeprefix("json").strip().removesuffix(mark).strip()
    starts = [i for i in (text.find("{"), text.find("[")) if i >= 0]
    if starts:
        end = text.rfind("}" if text[min(starts)] == "{" else "]")
        if end >= min(starts):
            text = text[min(starts) : end + 1]
    return text


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'|[A-Za-z_][A-Za-z0-9_]*|\s+|[\s\S]', re.S)


def repair(text: str | None) -> tuple[str | None, bool]:
    """(JSON or null, whether the text itself was not valid). Token by token: quotes become double, names before a colon
    get them, raw newlines within strings are escaped, commas before a closing bracket go."""
    if text is None or not text.strip():
        return None, False
    payload = _payload(text)
    if _valid(payload):
        return payload, not _valid(text)
    tokens = _TOKEN.findall(payload)
    solid = [i for i, t in enumerate(tokens) if not t.isspace()]
    after = {i: tokens[j] for i, j in zip(solid, solid[1:])}
    out = []
    for i, t in enumerate(tokens):
        if t == "," and after.get(i) in ("}", "]"):
            continue
        if len(t) > 1 and t[0] == "'":
            t = '"' + t[1:-1].replace("\\'", "'").replace('"', '\\"') + '"'
        elif after.get(i) == ":" and (t[0].isalpha() or t[0] == "_"):
            t = f'"{t}"'
        out.append(t.replace("\n", "\\n") if t[0] == '"' else t)
    fixed = "".join(out)
    return (fixed, True) if _valid(fixed) else (None, True)


@F.pandas_udf(StructType().add("json", StringType()).add("repaired", BooleanType()))
def repair_json(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([repair(t) for t in texts], columns=["json", "repaired"])
