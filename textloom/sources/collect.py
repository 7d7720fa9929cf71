"""Which files a folder holds, rules of a fake client, and the state folder of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Endings of page images, sub-folders of a run's state.
IMAGES = ("jpg", "png", "tiff", "jp2", "tif", "jpeg", "bmp", "webp")
STATE_FOLDERS = ("chunks", "digests", "samples", ".locks")


def collect_files(spark: SparkSession, path: str, endings: tuple[str, ...] = ("",), only: str | None = None, skip: str | None = None) -> DataFrame:
    """(path, name, length) of the files below ``path`` whose names end in one of ``endings``, have ``only`` in them and not ``skip``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    fits = F.exists(F.array(*map(F.lit, endings)), lambda e: F.endswith("name", e))
    fits = fits & F.contains("name", F.lit(only)) if only else fits
    return files.where(fits & ~F.contains("name", F.lit(skip)) if skip else fits)


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind) of the files right in ``path``: ``image``, or ``pdf`` for those that must be drawn first; others are left out."""
    files = spark.read.format("binaryFile").load(path).select("path")
    ending = F.lower(F.element_at(F.split("path", r"\."), -1))
    return files.select("path", F.when(ending.isin(*IMAGES), "image").when(ending == "pdf", "pdf").alias("kind")).where("kind is not null")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(nth, stage, chunk, tier, respond) of JSON lines; lines that are no JSON object are left out. A rule's conditions
    are in its ``when``, and a missing one fits anything; rules are few and in order of ``nth``."""
    rule = F.try_parse_json(F.trim("value"))
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("nth"), rule.alias("r")).where(F.startswith(F.schema_of_variant("r"), F.lit("OBJECT")))
    of = lambda at, kind: F.try_variant_get("r", f"$.{at}", kind)
    return lines.select("nth", *(of(f"when.{c}", k).alias(c) for c, k in (("stage", "string"), ("chunk", "bigint"), ("tier", "string"))), of("respond", "string").alias("respond"))


def reset_state(spark: SparkSession, path: str, stamp: str, archive: bool = True, keep: tuple[str, ...] = ()) -> str | None:
    """Empties a run's state folder and gives the folder in which the old state lies, or null without ``archive``.

    The old folder is renamed first and only deleted after the files in ``keep`` are back, so a failure loses nothing.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join(parts))
    fs = at(path).getFileSystem(conf)
    fs = fs.getRawFileSystem() if fs.getScheme() == "file" else fs  # other programs change local files without their checksums
    if not fs.exists(at(path)):
        raise FileNotFoundError(path)
    path = path.rstrip("/")
    old, n = f"{path}_archive_{stamp}", 0
    while fs.exists(at(old)):
        n += 1
        old = f"{path}_archive_{stamp}_{n}"
    if not fs.rename(at(path), at(old)):
        raise OSError(f"{path} cannot be renamed")
    for folder in STATE_FOLDERS:
        fs.mkdirs(at(path, folder))
    for name in keep:
        if fs.exists(at(old, name)):
            jvm.org.apache.hadoop.fs.FileUtil.copy(fs, at(old, name), fs, at(path, name), False, conf)
    if archive:
        return old
    fs.delete(at(old), True)
    return None
