"""The cleaning plan: quality rules, then exact, then near deduplication, with a count of what each step drops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom import runtime
from corpusloom.operators import dedup, quality


def steps(rows: DataFrame, topic: str = quality.TOPIC) -> tuple[DataFrame, DataFrame]:
    """(kept rows, drop counts: reason, n); rows: seq (unique), question, answer and others.

    Only seq, questions and hashes are written on the way; whole rows are read once more, to leave out what was dropped.
    """
    checked = quality.checked(rows, topic=topic)
    key, pair = dedup.hashes(F.col("question"), F.col("answer"))
    good = lambda c: F.when(F.col("reason").isNull(), c)
    marked = runtime.written(checked.select("seq", "reason", good(F.col("question")).alias("question"), good(key).alias("key"), good(pair).alias("pair")), "checked")
    passed = marked.where("reason is null")
    repeated = runtime.written(dedup.repeats(passed, "seq", "key", "pair"), "repeats")
    signed = runtime.written(dedup.signatures(passed.select("seq", "question").join(repeated, "seq", "left_anti"), "question"), "signatures")
    reasons = marked.where("reason is not null").select("seq", F.concat(F.lit("quality:"), "reason").alias("reason"))
    reasons = reasons.unionByName(repeated.select("seq", F.concat(F.lit("exact:"), "dup_reason").alias("reason")))
    reasons = runtime.written(reasons.unionByName(dedup.near_dropped(signed).select("seq", F.lit("neardup:similar_question").alias("reason"))), "dropped")
    kept = rows.join(runtime.sized(reasons.select("seq")), "seq", "left_anti")
    return kept, reasons.groupBy("reason").agg(F.count("*").alias("n"))
