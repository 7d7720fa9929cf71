"""Structure-aware chunks of documents, and what is done with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ends_open, is_heading, paragraphs, sentences, strip
from .events import sequenced

TARGET, LONGEST = 800, 1600
LINES = r"\n"


def paragraph_explode(docs: DataFrame, separator: str = LINES) -> DataFrame:
    return docs.select("doc_id", F.posexplode(paragraphs(F.col("text"), separator)).alias("para_idx", "para"))


def sentence_split(docs: DataFrame, separator: str = LINES) -> DataFrame:
    return paragraph_explode(docs, separator).select("doc_id", "para_idx", F.posexplode(sentences(F.col("para"))).alias("sent_idx", "sentence"))


def chunks(docs: DataFrame, target: int = TARGET, longest: int = LONGEST, separator: str = LINES) -> DataFrame:
    """(doc_id, chunk, body, paragraphs, start_paragraph, is_head): one fold over a document's units, without a shuffle.

    Units are paragraphs, or the sentences of a paragraph longer than ``longest``. A unit opens a chunk if it is a
    heading or follows one, if long and other paragraphs meet, if two long paragraphs meet, or if it would lift the
    chunk's characters (joiners not counted) over ``target``.
    """
    unit = lambda i, head, long, t: F.struct(i.cast("int").alias("para"), head.alias("head"), long.alias("long"), t.alias("t"))
    yes, no = F.lit(True), F.lit(False)

    def units(p, i):
        cut = F.transform(sentences(p), lambda s: unit(i, no, yes, s))
        return F.when(is_heading(p), F.array(unit(i, yes, no, p))).when(F.length(p) > longest, cut).otherwise(F.array(unit(i, no, no, p)))

    listed = docs.select("doc_id", F.flatten(F.transform(paragraphs(F.col("text"), separator), units)).alias("units"))
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("i"), F.lit(0).alias("len"), F.lit(-1).alias("para"), no.alias("head"), no.alias("long"))

    def fold(a, u):
        fresh = (a["i"] == 0) | u["head"] | a["head"] | (u["long"] != a["long"]) | (u["long"] & (u["para"] != a["para"])) | (a["len"] + F.length(u["t"]) > target)
        starts = F.when(fresh, F.concat(a["starts"], F.array(a["i"]))).otherwise(a["starts"])
        length = F.when(fresh, F.length(u["t"])).otherwise(a["len"] + F.length(u["t"]))
        return F.struct(starts.alias("starts"), (a["i"] + 1).alias("i"), length.alias("len"), u["para"].alias("para"), u["head"].alias("head"), u["long"].alias("long"))

    # The fold keeps only where chunks begin, so its state grows with the chunks and not with the text.
    begun = listed.select("doc_id", "units", F.aggregate("units", start, fold, lambda a: a["starts"]).alias("starts"))
    end = lambda k: F.coalesce(F.try_element_at("starts", k + 2), F.size("units"))
    one = begun.select("doc_id", F.posexplode(F.transform("starts", lambda s, k: F.slice("units", s + 1, end(k) - s))).alias("k", "u"))
    first = F.col("u")[0]
    return one.select("doc_id", (F.col("k") + 1).alias("chunk"), F.array_join("u.t", "\n\n").alias("body"), F.size("u").alias("paragraphs"), first["para"].alias("start_paragraph"), first["head"].alias("is_head"))


def _spread(docs: DataFrame) -> DataFrame:
    """Documents dealt by id: the windows over their chunks then need no shuffle of their own, and few large files no longer
    mean few tasks."""
    return docs.select("doc_id", "text").repartition("doc_id")


def chunk_structure(docs: DataFrame, target: int = TARGET, longest: int = LONGEST, separator: str = LINES) -> DataFrame:
    by = Window.partitionBy("doc_id").orderBy("chunk")
    opened = F.lag("body").over(by)
    return chunks(_spread(docs), target, longest, separator).select(
        "doc_id", "chunk", F.length("body").alias("chars"), "paragraphs", "start_paragraph", "is_head",
        F.sum(F.col("is_head").cast("bigint")).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("chapter_index"),
        F.coalesce(ends_open(opened), F.lit(False)).alias("starts_mid_sentence"), ends_open(F.col("body")).alias("ends_mid_sentence"), F.sha2("body", 256).alias("sha256"),
    )


def boundary_suspects(docs: DataFrame) -> DataFrame:
    """Neighbours whose boundary falls inside a sentence, with 40 characters of either side."""
    by = Window.partitionBy("doc_id").orderBy("chunk")
    pairs = chunks(_spread(docs)).select("doc_id", "chunk", "body", F.lag("body").over(by).alias("prev"))
    return pairs.where(F.col("prev").isNotNull() & ends_open(strip("prev"))).select("doc_id", (F.col("chunk") - 1).alias("prev_chunk"), F.col("chunk").alias("next_chunk"), F.right(strip("prev"), F.lit(40)).alias("prev_end"), F.left(strip("body"), F.lit(40)).alias("cur_start"))


def merge_chunks(parts: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Texts of each key in order, stripped, empty ones dropped, joined by a blank line."""
    held = parts.select(key, order, strip(F.col(text)).alias("t")).where("t <> ''").groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, "t"))).alias("ts"))
    return held.select(key, F.concat(F.array_join("ts.t", "\n\n"), F.lit("\n")).alias("merged"))


def sample_positions(sizes: DataFrame, key: str, n: str, count: int = 5) -> DataFrame:
    """At most ``count`` positions of 1..n, evenly spread with both ends; halves round to even."""
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: (F.bround(k * (F.col(n) - 1) / F.lit(count - 1)) + 1).cast("bigint")))
    return sizes.select(key, F.explode(F.when(F.col(n) <= count, F.sequence(F.lit(1).cast("bigint"), F.col(n))).otherwise(spread)).alias("position"))


def digest_packs(docs: DataFrame, group: str, size: int = 8) -> DataFrame:
    """Packs of ``size`` documents in order of their ids; a hot group is numbered by ranges of ids, not in one task. Without an id a document is in no pack."""
    rows = sequenced(docs.select(group, "doc_id", F.length("text").alias("chars")).where("doc_id is not null"), "doc_id", by=group)
    pack = (F.floor((F.col("seq") - 1) / size) + 1).alias("pack")
    return rows.select(group, "doc_id", "chars", pack).groupBy(group, "pack").agg(F.count("*").alias("n_docs"), F.sum("chars").alias("total_chars"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


# The head of a pack of digests, that of each digest, and what stands for an empty one.
PACK_HEAD = "# 梗概包 %02d（第 %d–%d 块）\n\n- 覆盖块数：%d\n\n> 说明：以下为逐块中文梗概。请先归纳本包的情节主线、登场人物与\n> 关键设定，输出一段不超过 400 字的小结，供后续汇总为全书简介。\n\n"
PACK_PART, PACK_EMPTY = "## 第 %d 块\n\n%s\n", "（本块梗概为空）"


def digest_pack_texts(docs: DataFrame, group: str, size: int = 20) -> DataFrame:
    """(group, pack, text): the packs of ``size`` documents as texts for a model, each under its number; blank ones are named so.
    A pack holds no more than ``size`` texts, however large its group."""
    rows = sequenced(docs.select(group, "doc_id", F.coalesce(strip(F.col("text")), F.lit("")).alias("t")).where("doc_id is not null"), "doc_id", by=group)
    pack = (F.floor((F.col("seq") - 1) / size) + 1).alias("pack")
    packs = rows.groupBy(group, pack).agg(F.sort_array(F.collect_list(F.struct("doc_id", "t"))).alias("ts"))
    part = lambda x: F.format_string(PACK_PART, x["doc_id"], F.when(x["t"] == "", PACK_EMPTY).otherwise(x["t"]))
    head = F.format_string(PACK_HEAD, "pack", F.element_at("ts", 1)["doc_id"], F.element_at("ts", -1)["doc_id"], F.size("ts"))
    return packs.select(group, "pack", F.concat(head, F.array_join(F.transform("ts", part), "\n")).alias("text"))
