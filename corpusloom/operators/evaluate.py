"""Evaluation: answers by a provider, keyword and external checks, pass rates, run comparison."""

from __future__ import annotations

import subprocess
import time
from collections.abc import Callable

from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import without_fences, without_thoughts
from corpusloom.operators import calls
from corpusloom.operators.compiling import Checker

# Temperature, kept part of an answer, least keywords, shown missing ones.
TEMPERATURE, MOST_ANSWER, LEAST_KEYWORDS, MOST_MISSING = 0.1, 2000, 3, 5


def required_keywords(keywords: Column) -> Column:
    return F.greatest(F.lit(LEAST_KEYWORDS), F.floor(F.size(keywords) / 2).cast("int"))


def keyword_columns(answer: Column, keywords: Column) -> dict[str, Column]:
    """n_found, n_required, passed and detail of a keyword check; no keywords fail."""
    words, low = F.coalesce(keywords, F.array().cast("array<string>")), F.lower(F.coalesce(answer, F.lit("")))
    found = F.filter(words, lambda k: F.contains(low, F.lower(k)))
    missing = F.filter(words, lambda k: ~F.contains(low, F.lower(k)))
    shown = F.concat(F.lit("["), F.array_join(F.transform(F.slice(missing, 1, MOST_MISSING), lambda k: F.concat(F.lit("'"), k, F.lit("'"))), ", "), F.lit("]"))
    detail = F.concat(F.lit("Found "), F.size(found).cast("string"), F.lit("/"), F.size(words).cast("string"), F.lit(" keywords. Missing: "), shown)
    need = required_keywords(words)
    return {"n_found": F.size(found), "n_required": need, "passed": F.size(found) >= need, "detail": detail}


def asked(problems: DataFrame, provider: Callable[[str, str, float], str], system: str, at_once: int | None = None, log: str | None = None) -> DataFrame:
    """problems with answer (cleaned; "ERROR: ..." if the call failed) and latency_s (of the call alone).

    at_once: calls over all tasks (as many as the session runs tasks, if not given); one at a time does not disturb the
    latency, but takes all rows through one task. log: see calls.called. Write the result before it is read twice, as
    asking again may give other answers.
    """
    names = problems.columns

    def one(row: dict) -> list[tuple]:
        start = time.time()
        try:
            answer = provider(system, row["prompt"], TEMPERATURE).strip()
        except Exception as e:
            answer = f"ERROR: {e}"
        return [(*(row[n] for n in names), answer, time.time() - start)]

    rows = calls.called(problems, one, T.StructType([*problems.schema.fields, T.StructField("answer", T.StringType()), T.StructField("latency_s", T.DoubleType())]), at_once or problems.sparkSession.sparkContext.defaultParallelism, log)
    clean = F.when(F.col("answer").startswith("ERROR: "), F.col("answer")).otherwise(without_fences(without_thoughts("answer")))
    return rows.withColumn("answer", clean)


def checked(answers: DataFrame, checkers: dict[str, Checker], at_once: int | None = None, log: str | None = None, profile: ResourceProfile | None = None) -> DataFrame:
    """id, category, difficulty, passed, error, latency_s, answer: keyword checks are native, all others the category's checker.

    at_once: checks over all tasks (as many as the session runs tasks, if not given). log: see calls.called. profile: the
    resources of tasks that check, where the cluster manager can tell them apart.
    """
    words = keyword_columns(F.col("answer"), F.col("keywords"))
    by_words = answers.where(F.col("check") == "keywords").withColumns({"passed": words["passed"], "error": words["detail"]})
    names = answers.columns

    def one(row: dict) -> list[tuple]:
        category, code = row["category"], row["answer"]
        try:
            passed, error = checkers[category](code) if category in checkers else (False, f"Unknown category: {category}")
        except subprocess.TimeoutExpired:
            passed, error = False, "TIMEOUT: compilation exceeded limit"
        except Exception as e:
            passed, error = False, f"ERROR: {e}"
        return [(*(row[n] for n in names), passed, error)]

    schema = T.StructType([*answers.schema.fields, T.StructField("passed", T.BooleanType()), T.StructField("error", T.StringType())])
    programs = answers.where(F.coalesce(F.col("check") != "keywords", F.lit(True)))
    by_program = calls.called(programs, one, schema, at_once or answers.sparkSession.sparkContext.defaultParallelism, log, profile)
    both = by_words.select(*schema.names).unionByName(by_program)
    seq = ["seq"] if "seq" in names else []
    return both.select(*seq, "id", "category", "difficulty", "passed", "error", F.bround("latency_s", 2).alias("latency_s"), F.left("answer", F.lit(MOST_ANSWER)).alias("answer"))


def overall(results: DataFrame) -> DataFrame:
    """total, passed, pct; pct is null without results."""
    return results.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed")).withColumn("pct", F.try_divide(100.0 * F.col("passed"), F.col("total")))


def by_category(results: DataFrame) -> DataFrame:
    return results.groupBy("category").agg(F.count_if("passed").alias("passed"), F.count("*").alias("n")).withColumn("pct", 100.0 * F.col("passed") / F.col("n"))


def last_of_each(results: DataFrame, seq: str) -> DataFrame:
    """id and passed of the last row of each id."""
    return results.groupBy("id").agg(F.max_by("passed", seq).alias("passed"))


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """id, passed_a, passed_b, outcome for the ids of a; an id that b lacks counts as failed there."""
    other = b.select("id", F.col("passed").alias("passed_b"))
    both = a.select("id", F.col("passed").alias("passed_a")).join(other, "id", "left").withColumn("passed_b", F.coalesce("passed_b", F.lit(False)))
    outcome = F.when(F.col("passed_a") == F.col("passed_b"), "unchanged").when(F.col("passed_b"), "improved").otherwise("regressed")
    return both.withColumn("outcome", outcome)


def comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: total of a, both pass counts (b's with the ids that a lacks), improved, regressed, unchanged."""
    counts = compared(a, b).agg(F.count("*").alias("total"), F.count_if("passed_a").alias("passed_a"), *(F.count_if(F.col("outcome") == x).alias(x) for x in ("improved", "regressed", "unchanged")))
    return counts.join(b.agg(F.count_if("passed").alias("passed_b")))


def breakdown(rows: DataFrame, column: str) -> DataFrame:
    """value (unknown for null), n, pct of all rows."""
    counts = rows.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))
    return counts.join(rows.agg(F.count("*").alias("all"))).select("value", "n", (100.0 * F.col("n") / F.col("all")).alias("pct"))
