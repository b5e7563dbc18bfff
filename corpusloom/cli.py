"""Commands for spark-submit: extract, synthesise, clean, evaluate, compare."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusloom import runtime, schemas
from corpusloom.functions.text import first_turn
from corpusloom.operators import chunkers, compiling, endpoint, evaluate, generate
from corpusloom.plans import clean, reports
from corpusloom.sources import batches, files, jsonl
from corpusloom.streaming import resume


SYSTEM = "Answer the task."


def _endpoint(x: argparse.ArgumentParser) -> None:
    x.add_argument("--model-name", default="echo")
    x.add_argument("--url", help="chat-completions endpoint; without it, the caller's provider answers")
    x.add_argument("--seconds", type=float, default=endpoint.SECONDS)
    x.add_argument("--tokens", type=int, default=endpoint.MOST_TOKENS)


def synthesised(spark: SparkSession, chunks: str, samples: str, failures: str, provider: generate.Provider, threads: int = 12, tries: int = generate.TRIES) -> str:
    """Ask for the chunks without a sample; malformed lines of either file are passed over. The report counts what was done.

    A run is a batch (streaming.resume.step) with its log beside the samples: a run that died is finished first.
    """
    log = f"{samples.rstrip('/')}_log"
    numbers: dict[str, int] = {}
    while not numbers:
        batch = str(batches.committed(spark, log).count())
        numbers = resume.step(jsonl.read_silent(spark, chunks, schemas.CHUNK), batch, samples, failures, provider, SYSTEM, log, threads=threads, tries=tries)
    return f"Chunks pending : {numbers['pending']}\nSamples        : {numbers['good']}\nFailures       : {numbers['bad']}"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    x = sub.add_parser("extract", help="chunks of source trees")
    x.add_argument("base")
    x.add_argument("out")
    x = sub.add_parser("synthesise", help="ask for samples of chunks that have none yet; appends to both outputs")
    x.add_argument("chunks")
    x.add_argument("samples")
    x.add_argument("failures")
    x.add_argument("--threads", type=int, default=12)
    x.add_argument("--tries", type=int, default=generate.TRIES)
    _endpoint(x)
    x = sub.add_parser("clean", help="quality rules, exact and near deduplication of samples")
    x.add_argument("samples")
    x.add_argument("out")
    x = sub.add_parser("evaluate", help="ask, check and report")
    _endpoint(x)
    x.add_argument("--tag", required=True)
    x.add_argument("--problems", required=True)
    x.add_argument("--category")
    x.add_argument("--templates", default="templates")
    x.add_argument("--out", default="results")
    x.add_argument("--at-once", type=int, help="calls at once, over all tasks; as many as the session runs tasks, if not given; 1 leaves latencies undisturbed")
    x.add_argument("--log", help="folder for answers and checks as they come; a run that stopped goes on from it")
    x = sub.add_parser("compare", help="two runs")
    x.add_argument("runs", nargs=2)
    x.add_argument("--out", help="file for the whole report")
    return p


def main(args: list[str] | None = None, provider: generate.Provider = generate.echo) -> str:
    """Run a command; the provider of answers is injected by the caller."""
    a, spark = parser().parse_args(args), SparkSession.builder.getOrCreate()
    if getattr(a, "url", None):
        provider = endpoint.chat(a.url, a.model_name, seconds=a.seconds, tokens=a.tokens)
    if a.command == "extract":
        found = runtime.written(chunkers.chunked(files.scanned(spark, a.base, files.repositories(spark))), "chunks")
        jsonl.write(found, a.out)
        report = reports.text(reports.chunks_by_repo(chunkers.summary(found)))
    elif a.command == "synthesise":
        report = synthesised(spark, a.chunks, a.samples, a.failures, provider, a.threads, a.tries)
    elif a.command == "clean":
        rows = jsonl.read_tolerant(spark, a.samples, schemas.SAMPLE).withColumns({"question": first_turn("conversations", "human"), "answer": first_turn("conversations", "gpt")})
        good = F.col("malformed").isNull()
        rows, n = runtime.counted(rows, "samples", good=F.count_if(good), bad=F.count_if(~good))
        kept, drops = clean.steps(rows.where(good))
        kept, m = runtime.counted(kept, "kept", kept=F.count(F.lit(1)))
        jsonl.write(kept.select("conversations", "source_chunk_id", "repo", "style"), a.out)
        report = reports.text(reports.cleaning(n["good"], m["kept"], kept, drops))
        if n["bad"]:
            where = f"{a.out.rstrip('/')}_malformed"
            jsonl.write(rows.where(~good).select("file", "line", "malformed"), where)
            report = f"Malformed lines skipped: {n['bad']}, listed in {where}\n\n{report}"
    elif a.command == "evaluate":
        equal = {"category": a.category} if a.category else {}
        problems = jsonl.read_strict(spark, a.problems, schemas.PROBLEM, numbered=True, **equal)
        logs = {x: f"{a.log.rstrip('/')}/{x}" if a.log else None for x in ("answers", "checks")}
        asked = runtime.written(evaluate.asked(problems, provider, SYSTEM, a.at_once, logs["answers"]), "asked")
        results = runtime.written(evaluate.checked(asked, compiling.compilers(a.templates), log=logs["checks"]), "results")
        jsonl.write_run(results, f"{a.out}/{a.tag}_results.json", a.tag, a.model_name)
        lines = reports.evaluation(results, a.tag, a.model_name)
        reports.write(lines, f"{a.out}/{a.tag}_report.txt")
        report = reports.text(lines)
    else:
        tags = [jsonl.read_run_head(spark, r).first()["tag"] for r in a.runs]
        lines = reports.comparison(*(evaluate.last_of_each(jsonl.read_run(spark, r), "seq") for r in a.runs), *tags)
        if a.out:
            reports.write(lines, a.out)
        report = reports.text(lines)
    print(report)
    return report


if __name__ == "__main__":
    main()
