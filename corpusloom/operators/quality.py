"""Ordered quality rules: the first rule that a row fails names the reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import n_words

# Thresholds and patterns that decide which rows are kept.
BAD_START = r"(?iU)^(I (don't|cannot|can't)|Sorry|I'm not sure|As an AI|I apologize)"
INCOMPLETE = r"(?iUd)\.\.\.$|to be continued|continued in part|end of response"
TOPIC = (
    r"(?iUd)\bebpf\b|\bbpf\b|\bxdp\b|\bkprobe\b|\btracepoint\b|\baya\b|"
    r"\blibbpf\b|\bcilium\b|\bmap\b|\bprobe\b|\bsyscall\b|\bverifier\b|"
    r"\bbtf\b|\bco-re\b|\bring.buf|\bperf.event\b|\bsockmap\b|\bcgroup\b"
)


@dataclass(frozen=True)
class Limits:
    question_chars: int = 20
    answer_chars: int = 150
    answer_words: int = 30
    answer_most_chars: int = 8000


def reason(question: Column, answer: Column, topic: str = TOPIC, limits: Limits = Limits()) -> Column:
    """Name of the first failed rule, null for a good row. Null counts as "" in either text."""
    q, a = F.coalesce(question, F.lit("")), F.coalesce(answer, F.lit(""))
    return (
        F.when(F.length(q) < limits.question_chars, "question_too_short")
        .when(F.length(a) < limits.answer_chars, "answer_too_short")
        .when(n_words(a) < limits.answer_words, "answer_too_few_words")
        .when(F.length(a) > limits.answer_most_chars, "answer_too_long")
        .when(F.left(a, F.lit(100)).rlike(BAD_START), "bad_answer_pattern")
        .when(F.right(a, F.lit(100)).rlike(INCOMPLETE), "incomplete_answer")
        .when(~F.concat(q, F.lit(" "), F.left(a, F.lit(500))).rlike(topic), "no_ebpf_signal")
    )


def checked(rows: DataFrame, question: str = "question", answer: str = "answer", topic: str = TOPIC, limits: Limits = Limits()) -> DataFrame:
    """rows with a column reason."""
    return rows.withColumn("reason", reason(F.col(question), F.col(answer), topic, limits))
