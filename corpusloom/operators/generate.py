"""Generation of samples from prompts by a provider, with retries, resumable by an anti-join."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.operators import calls

ANSWER = "id string, repo string, prompt_no int, style string, instruction string, answer string, error string"

# Retries and answer length.
TRIES, DELAY_S, LEAST_ANSWER = 3, 2.0, 40
_THOUGHTS = re.compile(r"<think>.*?</think>", re.S)

#: (system, message, temperature) -> answer; raises on failure. Sent to the workers.
Provider = Callable[[str, str, float], str]


def echo(system: str, message: str, temperature: float) -> str:
    """A provider for tests: tells what it was asked."""
    return f"Asked at {temperature:g}: {message}"


def answered(provider: Provider, system: str, message: str, temperature: float, tries: int = TRIES, delay: float = DELAY_S) -> str:
    """The provider's answer without its thoughts; the last try's error is raised."""
    for attempt in range(1, tries + 1):
        try:
            answer = _THOUGHTS.sub("", provider(system, message, temperature).strip()).strip()
            if len(answer) < LEAST_ANSWER:
                raise ValueError(f"Answer too short: {answer!r}")
            return answer
        except Exception:
            if attempt == tries:
                raise
            time.sleep(delay * attempt)
    raise ValueError("no try")


def pending(chunks: DataFrame, samples: DataFrame) -> DataFrame:
    """Chunks without a sample yet: those that failed after a first sample count as done, those without any are asked again."""
    done = samples.select(F.col("source_chunk_id").alias("id")).where("id is not null").distinct()
    return chunks.join(done, "id", "left_anti")


def generated(prompts: DataFrame, provider: Provider, system: str, threads: int = 12, tries: int = TRIES, delay: float = DELAY_S, log: str | None = None, n_chunks: int | None = None) -> DataFrame:
    """id, repo, prompt_no, style, instruction, answer, error: a chunk's prompts in order, up to its first failure.

    threads: calls at once, over all tasks. log: see calls.called; without it, the result must be written once and read
    for both tables, as asking twice may give other answers.
    """

    def one(chunk: dict) -> list[tuple]:
        out = []
        for p in sorted(chunk["prompts"], key=lambda p: p["prompt_no"]):
            try:
                out.append((chunk["id"], chunk["repo"], p["prompt_no"], p["style"], p["instruction"], answered(provider, system, p["message"], p["temperature"], tries, delay), None))
            except Exception as e:
                out.append((chunk["id"], chunk["repo"], p["prompt_no"], p["style"], p["instruction"], None, str(e)))
                break
        return out

    asked = F.array_sort(F.collect_list(F.struct("prompt_no", "style", "instruction", "message", "temperature")))
    return calls.called(prompts.groupBy("id", "repo").agg(asked.alias("prompts")), one, ANSWER, threads, log, n_rows=n_chunks)


def samples(answers: DataFrame, system: str) -> DataFrame:
    turn = lambda who, value: F.struct(F.lit(who).alias("from"), value.alias("value"))
    talk = F.array(turn("system", F.lit(system)), turn("human", F.col("instruction")), turn("gpt", F.col("answer")))
    return answers.where("error is null").select(talk.alias("conversations"), F.col("id").alias("source_chunk_id"), "repo", "style")


def failures(answers: DataFrame) -> DataFrame:
    return answers.where("error is not null").select(F.col("id").alias("chunk_id"), "error", "repo")


SAMPLE_SCHEMA, FAILURE_SCHEMA = schemas.SAMPLE, schemas.FAILURE
