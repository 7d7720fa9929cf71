"""Tables as files: chunks with their structure, glossaries, prompt blocks and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

# Columns of a glossary with two and with five.
CSV = {"csv2": ("source", "target"), "csv5": ("source", "target", "type", "origin", "note")}
# Header of the hits as CSV, and the names of origins there.
HITS_HEADER = ("日语", "中文", "类型", "来源", "备注")
ORIGIN_NAMES = {"user": "用户", "auto": "自动"}
#: Rows of one key that may become one file.
MOST = 1_000_000


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as Parquet, one folder for each value of a bounded hash of the document, so that one document is one folder's."""
    chunks.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(256))).write.partitionBy("part").mode("overwrite").parquet(path)


def export_glossary(terms: DataFrame, path: str, form: str = "csv5", origin: str | None = None, only_ok: bool = False) -> None:
    """A glossary as CSV or JSON lines in order of type and source, of one origin or of those with status ``ok`` if so asked."""
    rows = terms.where(F.col("origin") == origin) if origin else terms
    rows = rows.where("status = 'ok'") if only_ok else rows
    rows = rows.orderBy("type", "source").select(*CSV[form]) if form in CSV else rows.orderBy("type", "source")
    out = rows.write.mode("overwrite")
    out.option("header", "true").option("escape", '"').csv(path) if form in CSV else out.json(path)


def collapsed(c):
    """Column: the text with runs of blank lines made one blank line."""
    return F.regexp_replace(strip(c), r"\n[ \t]*\n+", "\n\n")


def term_lines(terms: DataFrame) -> DataFrame:
    """(source, line): a term as one line of a list, with its note in brackets."""
    note = F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit(" ("), "note", F.lit(")"))).otherwise("")
    return terms.select("source", F.concat(F.lit("- "), "source", F.lit(" → "), "target", note).alias("line"))


def prompt_blocks(hits: DataFrame, terms: DataFrame, key: str, policy: str) -> DataFrame:
    """(key, prompt): the policy's text, then the lines of the terms that each text has, by source. A text has no more lines
    than there are terms; cut ``hits`` by ``glossary.hits_topk`` before to bound them further."""
    rows = hits.join(term_lines(terms), "source").groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "line"))), lambda t: t["line"]), "\n").alias("lines"))
    return rows.select(key, F.concat(F.lit(policy + "\n\n"), "lines").alias("prompt"))


def _listed(rows: DataFrame, key: str, item, *sums) -> DataFrame:
    """(key, ls): all items of each key by position, whatever numbers positions are; a key of more than ``MOST`` rows ends the job, since its file would be one task's."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy("position")))
    held = ranked.groupBy(key).agg(*sums, F.array_sort(F.collect_list(F.when(F.col("_rank") <= MOST, item))).alias("ls"), F.count("*").alias("_n"))
    return held.withColumn("ls", F.when(F.col("_n") > MOST, F.raise_error(F.lit(f"a key has more than {MOST} rows; cut them by store.prompt_rows"))).otherwise(F.col("ls")))


def hits_json(rows: DataFrame, key: str) -> DataFrame:
    """(key, json): what ``store.prompt_rows`` gives for each key as one JSON object."""
    term = F.struct("position", F.struct("source", "target", "type", "locked", "aliases", "note", "status").alias("term"))
    sums = _listed(rows, key, term, F.count("*").alias("count"), F.bool_or("truncated").alias("truncated"))
    return sums.select(key, F.to_json(F.struct("count", "truncated", F.transform("ls", lambda t: t["term"]).alias("terms"))).alias("json"))


def _quoted(c):
    """Column: a CSV field, in quotes where it needs them; null is empty."""
    c = F.coalesce(c, F.lit(""))
    return F.when(c.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def hits_csv(rows: DataFrame, key: str) -> DataFrame:
    """(key, csv): the terms (position, source, target, type, origin, note) of each key as CSV with a header, in order of position."""
    origin = F.when(F.col("origin") == "user", ORIGIN_NAMES["user"]).otherwise(ORIGIN_NAMES["auto"])
    line = F.concat_ws(",", *(_quoted(c) for c in (F.col("source"), F.col("target"), F.col("type"), origin, F.col("note"))))
    sums = _listed(rows, key, F.struct("position", line.alias("line")))
    return sums.select(key, F.concat(F.lit(",".join(HITS_HEADER) + "\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), F.lit("\n")).alias("csv"))


def csv_rows(text):
    """Column: lines of a CSV text that are not blank, without the header."""
    return F.size(F.filter(F.slice(F.filter(F.split(text, "\n"), lambda x: x != ""), 2, 1 << 30), lambda x: strip(x) != ""))


def usage_report(rollup: DataFrame) -> str:
    """Totals, tiers and stages of ``events.usage_rollup`` as a Markdown table, one row for each tier and stage."""
    rows = rollup.orderBy(F.col("level") != "total", "level", "name").collect()
    return "\n".join(["| level | name | calls | tokens | hit rate |", "|---|---|---|---|---|", *(f"| {r.level} | {r.name} | {r.calls} | {r.tokens} | {r.hit_rate} |" for r in rows)]) + "\n"


def _table(head: tuple[str, ...], rows: list[tuple]) -> list[str]:
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    line = lambda r: "| " + " | ".join(map(cell, r)) + " |"
    return [line(head), "|" + "---|" * len(head), *map(line, rows), ""]


def _first(df: DataFrame, columns: list[str], order: list, most: int) -> list[str]:
    """The first ``most`` rows as a table, and how many more there are; nothing without rows."""
    n = df.count()
    rows = [tuple(r) for r in df.orderBy(*order).select(*columns).limit(most).collect()]
    rest = [f"… and {n - most} more", ""] if n > most else []
    return _table(tuple(columns), rows) + rest if rows else []


def degradations(run: dict) -> list[str]:
    """What of the full path a run left out: what it says of its path and prescan, the stages and chunks that were skipped, chunks that failed."""
    notes = [f"short path for {run['total']} chunks"] if run.get("path_mode") == "simple" else []
    notes += {"sampled": ["prescan of a sample only"], "off": ["no prescan"]}.get(run.get("prescan_mode"), [])
    notes += [f"stage {s} skipped" for s in run.get("skipped_stages") or []]
    return notes + [f"{run[k]} chunks {k}" for k in ("failed", "skipped") if run.get(k)]


def delivery_report(run: dict, terms: DataFrame, logged: DataFrame, alignment: DataFrame, issues: DataFrame, checks: DataFrame, rollup: DataFrame | None = None, files: dict[str, str] | None = None, most: int = 30) -> str:
    """A run as Markdown in seven sections, and its use as an eighth where there is a ``rollup``.

    ``run`` has total, done, failed, skipped, src_chars, zh_chars and what ``degradations`` reads; the tables are terms (locked,
    origin), the log of conflicts, ``quality.align_issues``, ``scanner.qa_issues`` and ``lifecycle.compliance``. Only sums and the
    first ``most`` rows of a list come to the driver.
    """
    ratio = round(run["zh_chars"] / run["src_chars"], 4) if run.get("src_chars") else "n/a"
    t = terms.agg(F.count("*").alias("n"), F.count_if("locked").alias("locked"), F.count_if(F.col("origin") == "auto").alias("auto"), F.count_if(F.col("origin") == "user").alias("user")).first()
    c = logged.agg(F.count("*").alias("n"), F.count_if(~F.col("resolved")).alias("open")).first()
    a = alignment.agg(F.count_if(F.col("severity") == "error").alias("error"), F.count_if(F.col("severity") == "warn").alias("warn")).first()
    kinds = [tuple(r) for r in issues.groupBy("kind", "severity").agg(F.count("*").alias("n")).orderBy("kind", "severity").collect()]
    passed = {r["check"]: r["passed"] for r in checks.collect()}  # four rows
    verdict = {None: "not verified", True: "compliant", False: "not compliant"}[passed.get("all")]
    out = ["# Delivery report", "", "## 1. Size and progress", "", *_table(("measure", "value"), [(k, run.get(k, 0)) for k in ("total", "done", "failed", "skipped", "src_chars", "zh_chars")] + [("ratio", ratio)])]
    out += ["## 2. Terms", "", *_table(("measure", "value"), [("terms", t.n), ("locked", t.locked), ("auto", t.auto), ("user", t.user), ("conflicts", c.n), ("open conflicts", c.open)])]
    out += _first(logged.where("not resolved"), ["source", "existing_target", "proposed_target"], ["source", "nth"], most)
    keys = [k for k in alignment.columns if k not in ("kind", "severity", "delta", "ratio")]
    out += ["## 3. Alignment", "", f"{a.error} errors, {a.warn} warnings", "", *_first(alignment.where("severity = 'error'"), [*keys, "kind", "delta"], [*keys, "kind"], most)]
    out += ["## 4. Consistency", "", *_table(("kind", "severity", "issues"), kinds)]
    out += ["## 5. Compliance", "", verdict, "", *_table(("check", "passed"), sorted((k, v) for k, v in passed.items() if k != "all"))]
    out += ["## 6. Left out", "", *([f"- {n}" for n in degradations(run)] or ["nothing"]), ""]
    out += ["## 7. Files", "", *_table(("name", "path"), sorted((files or {}).items()))]
    out += ["## 8. Use", "", usage_report(rollup)] if rollup is not None else []
    return "\n".join(out).rstrip() + "\n"
