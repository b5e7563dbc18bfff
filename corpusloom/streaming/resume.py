"""Resumable generation as a stream of chunk files: every new file's chunks that have no sample yet are asked once.

Samples and failures are appended by batch (sources.batches): answers are staged once for a batch id, each table's
folder of that batch can be written again, and the marker makes both visible. A batch that died on the way is played
again from its answers; one that had its marker is passed over. Answers are logged as they come (operators.calls), so
that a batch that died while asking asks only for the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom import runtime, schemas
from corpusloom.operators import generate, prompts
from corpusloom.sources import batches


def step(chunks: DataFrame, batch: str, samples_dir: str, failures_dir: str, provider: generate.Provider, system: str, log: str, **options: float) -> dict[str, int]:
    """Ask for a batch's chunks that no committed batch has a sample of, and append both tables; can be repeated.

    Returns the numbers of pending chunks, good and bad answers, taken while they were written; empty if the batch was
    committed or its answers were whole before.
    """
    spark, numbers = chunks.sparkSession, {}
    if batches.is_committed(spark, log, batch):
        return numbers
    seen = Observation()

    def made() -> DataFrame:
        done = batches.read(spark, log, samples_dir, schemas.SAMPLE)
        left, n = runtime.counted(generate.pending(chunks, done), "pending", pending=F.count(F.lit(1)))
        numbers.update(n)
        answers = generate.generated(prompts.expanded(left), provider, system, log=f"{log}/answers/batch={batch}", n_chunks=n["pending"], **options)
        return answers.observe(seen, F.count_if(F.col("error").isNull()).alias("good"), F.count_if(F.col("error").isNotNull()).alias("bad"))

    answers = batches.staged(spark, log, batch, made)
    if numbers:
        numbers.update(seen.get)
    batches.append(spark, log, batch, {samples_dir: generate.samples(answers, system), failures_dir: generate.failures(answers)})
    return numbers


def generation(spark: SparkSession, chunks_dir: str, samples_dir: str, failures_dir: str, provider: generate.Provider, system: str, checkpoint: str, **options: float) -> StreamingQuery:
    """Read new JSON Lines files of chunks, append samples and failures, stop when all files are read; read both by `samples` and `failures`."""

    def run(rows: DataFrame, batch: int) -> None:
        step(rows, str(batch), samples_dir, failures_dir, provider, system, f"{checkpoint}/batches", **options)

    source = spark.readStream.schema(schemas.CHUNK).json(chunks_dir)
    return source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def samples(spark: SparkSession, samples_dir: str, checkpoint: str) -> DataFrame:
    """The samples of all committed batches."""
    return batches.read(spark, f"{checkpoint}/batches", samples_dir, schemas.SAMPLE)


def failures(spark: SparkSession, failures_dir: str, checkpoint: str) -> DataFrame:
    """The failures of all committed batches."""
    return batches.read(spark, f"{checkpoint}/batches", failures_dir, schemas.FAILURE)
