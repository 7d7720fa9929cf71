"""Names of the classes of boxes and of marked runs inside lines, as a small table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names and labels of the classes of boxes and of marked runs, in the order of their numbers from 1.
BOXES = (
    ("text_block", "本文ブロック"), ("line_main", "本文"), ("line_caption", "キャプション"), ("line_ad", "広告文字"), ("line_note", "割注"), ("line_note_tochu", "頭注"),
    ("block_fig", "図版"), ("block_ad", "広告"), ("block_pillar", "柱"), ("block_folio", "ノンブル"), ("block_rubi", "ルビ"), ("block_chart", "組織図"), ("block_eqn", "数式"),
    ("block_cfm", "化学式"), ("block_eng", "欧文"), ("block_table", "表組"), ("line_title", "タイトル本文"),
)
RUNS = (("inline_eng", "欧文"), ("inline_reng", "回転欧文"), ("inline_color", "色付文字"), ("inline_eqn", "数式"), ("inline_cfn", "化学式"), ("inline_hinv", "縦中横"), ("inline_hand", "手書き"))


def classes(spark: SparkSession) -> DataFrame:
    """(family, id, name, label): ``box`` and ``run``; labels are unique within a family."""
    rows = [(family, i, *names) for family, listed in (("box", BOXES), ("run", RUNS)) for i, names in enumerate(listed, 1)]
    return spark.createDataFrame(rows, "family string, id int, name string, label string")


def named(rows: DataFrame, by: str, family: str = "box") -> DataFrame:
    """``rows`` with the class (class_id, class_name, class_label) that column ``by`` has the number, the name or the label of;
    null where there is none."""
    known = classes(rows.sparkSession).where(F.col("family") == family).select(F.col("id").alias("class_id"), F.col("name").alias("class_name"), F.col("label").alias("class_label"))
    keyed = known.withColumn("_key", F.explode(F.array(F.col("class_id").cast("string"), "class_name", "class_label")))
    return rows.join(F.broadcast(keyed), F.col(by).cast("string") == F.col("_key"), "left").drop("_key")  # three rows a class


def is_line(name: Column) -> Column:
    return F.startswith(name, F.lit("line_"))


def is_other_block(name: Column) -> Column:
    """Blocks besides text, without tables, which have cells of their own."""
    return F.startswith(name, F.lit("block_")) & (name != "block_table")
