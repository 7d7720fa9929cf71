"""The glossary as a keyed stream: each source's term lives in the state store, so a batch reads no earlier output.

Candidates are dealt by source. A source's state is its term and the conflicts that are open; both start from the terms
that the stream is given. The state store is the only place of the glossary: ``current_terms`` and ``open_conflicts``
read it back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.text import strip
from ..operators.store import DEFAULT_TYPE, ORIGINS, OTHER_TYPE, TYPES

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TERM = "target string, reading string, type string, gender string, aliases array<string>, note string, origin string, locked boolean, status string, first_chunk bigint"
OPEN = "arrival bigint, proposed_target string, chunk bigint, phase string"
DONE = "arrival bigint, source string, target string, outcome string, existing_target string, chunk bigint, phase string"
#: Groups over which candidates without a source are dealt; they change nothing.
BLANKS = 64
FIELDS = ("target", "reading", "type", "gender", "aliases", "note", "origin", "locked", "status", "first_chunk")


def _text(v) -> str:
    return v if isinstance(v, str) else ""


def _number(v) -> int | None:
    return None if v is None or pd.isna(v) else int(v)


def _kind(v) -> str:
    s = _text(v).strip()
    return DEFAULT_TYPE if not s else s if s in TYPES else OTHER_TYPE


def _names(given, source: str) -> list[str]:
    return sorted({a.strip() for a in (given if given is not None else ()) if a and a.strip() and a.strip() != source})


def _flag(v) -> bool:
    return v is not None and not pd.isna(v) and bool(v)


class Fold(StatefulProcessor):
    """Takes the candidates of one source in order of arrival."""

    def __init__(self, policy: str) -> None:
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.term, self.open = handle.getValueState("term", TERM), handle.getListState("open", OPEN)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        aliases = row["aliases"]
        self.term.update(tuple(_number(row[f]) if f == "first_chunk" else _flag(row[f]) if f == "locked" else ([] if aliases is None else list(aliases)) if f == "aliases" else _text(row[f]) for f in FIELDS))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        if not key[0] or self.policy == "D":
            yield self._answers(batch, ["rejected_by_policy" if key[0] and t else "invalid" for t in batch["target"]], None)
            return
        held = self.term.get()
        term = dict(zip(FIELDS, held, strict=True)) if held is not None else None
        outcomes, conflicts, kept = [], [], []
        for c in batch.to_dict("records"):
            outcome, term = self._take(term, key[0], c)
            if outcome == "conflict":
                conflicts.append((int(c["arrival"]), c["target"], _number(c["chunk"]), _text(c["phase"])))
            outcomes.append(outcome)
            kept.append(term["target"] if term else None)
        if term is not None:
            self.term.update(tuple(list(v) if f == "aliases" else v for f, v in term.items()))
        if conflicts:
            self.open.appendList(conflicts)
        yield self._answers(batch, outcomes, kept)

    def _take(self, term: dict | None, source: str, c: dict) -> tuple[str, dict | None]:
        target = c["target"]
        if not target:
            return "invalid", term
        if term is None:
            if self.policy == "A":
                return "rejected_by_policy", None
            origin = c["origin"] if c["origin"] in ORIGINS else "auto"
            fresh = (target, _text(c["reading"]), _kind(c["type"]), _text(c["gender"]), _names(c["aliases"], source), _text(c["note"]), origin, origin == "user" or _flag(c["locked"]), "ok", _number(c["chunk"]))
            return "inserted", dict(zip(FIELDS, fresh, strict=True))
        if target != term["target"]:
            return ("rejected_by_lock", term) if term["locked"] else ("conflict", term | {"status": "conflict"})
        kind = _kind(c["type"]) if term["type"] == DEFAULT_TYPE and _text(c["type"]) not in ("", DEFAULT_TYPE) else term["type"]
        filled = {f: term[f] or _text(c[f]) for f in ("reading", "gender", "note")}
        return "unchanged", term | filled | {"type": kind, "aliases": _names([*term["aliases"], *(c["aliases"] if c["aliases"] is not None else ())], source)}

    @staticmethod
    def _answers(batch: pd.DataFrame, outcomes: list[str], kept: list | None) -> pd.DataFrame:
        out = batch[["arrival", "source", "target", "chunk", "phase"]].copy()
        out["outcome"], out["existing_target"] = outcomes, kept if kept is not None else [None] * len(batch)
        out["chunk"] = out["chunk"].astype("Int64")
        return out[["arrival", "source", "target", "outcome", "existing_target", "chunk", "phase"]]

    def close(self) -> None:
        pass


def folded(stream: DataFrame, terms: DataFrame, policy: str = "B") -> DataFrame:
    """(arrival, source, target, outcome, existing_target, chunk, phase) of each candidate of ``stream``, as ``store.upserted``
    takes them, against ``terms`` and all candidates of the batches before.

    Source and target are stripped; null ones are blank and invalid. Arrivals must be unique and not go back between
    batches. A source's candidates of one batch meet in one task, so what the source of the stream lets into a batch bounds
    it; blank sources, which have no state, are dealt by arrival. Of several terms with one source the first is taken.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    text = lambda c: F.coalesce(strip(F.col(c)), F.lit(""))
    deal = lambda rows: rows.withColumn("dealt", F.when(F.col("source") == "", F.pmod(F.col("arrival"), F.lit(BLANKS)).cast("int")).otherwise(0))
    rows = deal(stream.withColumns({"source": text("source"), "target": text("target")}))
    given = terms.select("source", *FIELDS).withColumn("dealt", F.lit(0)).groupBy("source", "dealt")
    return rows.groupBy("source", "dealt").transformWithStateInPandas(Fold(policy), DONE, "Append", "None", initialState=given)


def glossary_stream(stream: DataFrame, terms: DataFrame, path: str, checkpoint: str, policy: str = "B", **trigger) -> StreamingQuery:
    """Starts the fold; ``path`` gets what was done with each candidate, once each, however often the query is restarted."""
    return folded(stream, terms, policy).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _state(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark.read.format("statestore").option("stateVarName", variable).load(checkpoint)


def current_terms(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The glossary as the state store has it after the last finished batch."""
    return _state(spark, checkpoint, "term").select(F.col("key.source").alias("source"), *(F.col(f"value.{f}").alias(f) for f in FIELDS))


def open_conflicts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(source, arrival, proposed_target, chunk, phase) of candidates that met another target of an unlocked term."""
    return _state(spark, checkpoint, "open").select(F.col("key.source").alias("source"), "list_element.*")
