"""Source trees: directory scan, repository table, path filter, decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.functions import signals
from corpusloom.functions.text import decoded

READ = ["md", "rst", "rs", "c", "h", "go", "py"]


def repositories(spark: SparkSession, repos: dict[str, tuple[list[str], bool]] = signals.REPOS) -> DataFrame:
    return spark.createDataFrame([(k, langs, md) for k, (langs, md) in repos.items()], schemas.REPO)


def suffix(path: Column) -> Column:
    """Letters after the last dot of the file name; "" for names that start with it or have none."""
    return F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(?s)^.+\.([^.]+)$", 1)


def skipped(path: Column) -> Column:
    """Whether a path component is a skipped directory, or a Markdown file's name is a skipped one."""
    parts, name = F.split(path, "/"), F.element_at(F.split(path, "/"), -1)
    stem = F.replace(F.lower(F.regexp_extract(name, r"(?s)^(.+)\.[^.]+$", 1)), F.lit("-"), F.lit("_"))
    inside = F.arrays_overlap(parts, F.array(*map(F.lit, signals.SKIP_DIRS)))
    return inside | ((F.lower(suffix(path)) == "md") & stem.isin(signals.SKIP_MD_NAMES))


def scanned(spark: SparkSession, base: str, repos: DataFrame) -> DataFrame:
    """repo, path, file (relative to base), suffix, text, langs, include_md of the files to be read below base.

    Suffixes are pruned when files are listed, and paths before contents are decoded; the repository table has a row
    for each repository, so it is small by nature, and is joined as the planner sees fit. A missing base is an error
    of Spark's reader; a missing repository below it gives no rows.
    """
    root = base.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(READ) + "}").load(root)
    plain = F.regexp_replace("path", r"^file:/+", "/")
    own = found.select(plain.alias("path"), "content")
    own = own.withColumn("file", F.substring(F.col("path"), F.lit(len(root.removeprefix("file://")) + 2), F.length("path")))
    own = own.withColumn("repo", F.split("file", "/")[0]).withColumn("suffix", suffix(F.col("file"))).where(~skipped(F.col("file")))
    wanted = F.array_contains("langs", F.col("suffix")) | (F.col("include_md") & (F.col("suffix") == "md")) | ((F.col("suffix") == "rst") & F.col("repo").isin(signals.RST_REPOS))
    return own.join(repos, "repo").where(wanted).select("repo", "path", "file", "suffix", decoded("content").alias("text"), "langs", "include_md")
