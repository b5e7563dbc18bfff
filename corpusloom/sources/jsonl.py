"""JSON Lines and JSON documents, in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import runtime, schemas
from corpusloom.sources import joined, lines

#: What parts the results of a run document that is indented by two.
_RESULT = "\n    {"


def read_tolerant(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Every line that is not blank: the schema's columns, file, line (in its file, from 0), seq (over all files, by name), malformed.

    malformed is null for a good row; for a broken line it is the line, and the other columns are null. One parse of each
    line; seq stands for the order of arrival and is the same however the files are split.
    """
    rows = lines.numbered(spark, path).where(F.trim("value", F.lit(" \t\r\n\x0b\x0c")) != "")
    parsed = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return rows.select(parsed.alias("r"), "file", "line", "seq").select("r.*", "file", "line", "seq").withColumnRenamed("_corrupt_record", "malformed")


def read_silent(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_strict(spark: SparkSession, path: str, schema: str, numbered: bool = False, **equal: str) -> DataFrame:
    """A malformed line is an error; keyword arguments keep only rows with these values. numbered: with seq, as in read_tolerant."""
    if numbered:
        rows = lines.numbered(spark, path).where(F.trim("value", F.lit(" \t\r\n\x0b\x0c")) != "")
        rows = rows.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), "seq").select("r.*", "seq")
    else:
        rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    for column, value in equal.items():
        rows = rows.where(F.col(column) == value)
    return rows


def write(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").json(path)


def write_run(results: DataFrame, path: str, tag: str, model: str) -> None:
    """A run document: header and results, in the order of seq if there is one, as one JSON file written by all tasks.

    The totals are taken while the results are written, so the document's parts are made only once.
    """
    import json

    fields = [f.split()[0] for f in schemas.RESULT.split(", ")]
    text = F.concat(F.lit("    "), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))
    seq = [F.col("seq")] if "seq" in results.columns else []
    rows, n = runtime.counted(results.select(*seq, text.alias("line"), "passed"), "run", total=F.count(F.lit(1)), passed=F.count_if("passed"))
    rows = rows.orderBy(*seq) if seq else rows
    head = json.dumps({"tag": tag, "model": model, "total": n["total"], "passed": n["passed"]}, indent=2)[:-2]
    joined.write(rows.select("line"), path, head=head + ',\n  "results": [\n', tail="\n  ]\n}\n", between=",\n")


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """A run document's results with its tag and their place.

    A document indented by two, as write_run and a plain indented dump write it, is read in splits: a result starts at a
    line of its own, as a JSON string holds no line end. Any other document is parsed in one piece.
    """
    pieces = lines.numbered(spark, path, _RESULT).select("value", F.col("line").alias("seq"))
    if pieces.where("seq > 0").limit(1).count() == 0:
        run = spark.read.schema(schemas.RUN).option("multiLine", True).json(path)
        return run.select("tag", "model", F.posexplode("results").alias("seq", "r")).select("tag", "model", "seq", "r.*")
    head = F.from_json(F.concat(F.regexp_replace("value", r"\s*$", ""), F.lit("]}")), schemas.RUN)
    named = pieces.where("seq = 0").select(head.alias("h")).select("h.tag", "h.model", "h.total", F.col("h.passed").alias("n_passed"))
    body = F.concat(F.lit("{"), F.regexp_replace("value", r"\s*(,|\]\s*\})\s*$", ""))
    results = pieces.where("seq > 0").select((F.col("seq") - 1).cast("int").alias("seq"), F.from_json(body, schemas.RESULT).alias("r"))
    return results.select("seq", "r.*").join(F.broadcast(named.drop("total", "n_passed"))).select("tag", "model", "seq", *(f.split()[0] for f in schemas.RESULT.split(", ")))


def read_run_head(spark: SparkSession, path: str) -> DataFrame:
    """tag, model, total, passed of a run document, one row; the results are not parsed where the document is indented by two."""
    first = lines.numbered(spark, path, _RESULT).where("line = 0")
    cut = F.regexp_replace("value", r'(?s)("results"\s*:\s*\[).*$', "$1]}")
    return first.select(F.from_json(cut, schemas.RUN).alias("h")).select("h.tag", "h.model", "h.total", "h.passed")
