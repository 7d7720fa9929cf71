"""JSON in one form, so that equal contents have equal hashes."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _ordered(text: str | None) -> str | None:
    try:
        return None if text is None else json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    except (ValueError, RecursionError):
        return None


@F.arrow_udf(StringType())
def _canonical(texts: pa.Array) -> pa.Array:
    # a lone half of a surrogate pair is no text and becomes a question mark
    return pa.array([t and t.encode("utf-8", "replace").decode() for t in map(_ordered, texts.to_pylist())], pa.string())


def canonical_json(c: Column) -> Column:
    """A JSON text with the names of every object in order of their code points, without white space, characters as they are;
    null where it is no JSON. Numbers keep their kind: 1 and 1.0 differ. Of names that repeat in an object the last counts.
    (The engine's own variants drop a number's kind, so texts go through Python.)"""
    return _canonical(c)


def json_hash(c: Column) -> Column:
    """SHA-256 of the canonical form, in hex."""
    return F.sha2(canonical_json(c), 256)
