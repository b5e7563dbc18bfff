"""Queries of sources, sinks, chunkers, generation, checks and reports over whole test tables, with their DuckDB oracles.

The tables hold prose, so source files, JSON Lines with broken lines, and problems are made from every row of them.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import runtime, schemas
from corpusloom.functions import signals, tables
from corpusloom.operators import chunkers, compiling, endpoint, evaluate, fixer, generate, prompts
from corpusloom.plans import reports
from corpusloom.runtime import table
from corpusloom.sources import files, joined, jsonl, lines
from corpusloom.streaming import resume

_SUFFIXES = ["md", "rst", "rs", "c", "h", "go", "py", "txt"]
_TREES = ["aya", "tetragon", "linux-bpf-docs", "redbpf", "unknown"]
_FOLDERS = ["src", "vendor", "docs/deep"]


def _pick(values: list[str], by: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


def _id(name: str = "doc_id") -> Column:
    return F.col(name).cast("string")


def _line(c: Column | str = "text", marks: str = "") -> Column:
    """A text as one line."""
    return F.regexp_replace(c, rf"[\r\n{marks}]", " ")


def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file of its own, with carriage returns and a broken byte, then scanned."""
    root = runtime.scratch_path(spark, "tree")
    folder = runtime.local_path(root)
    i = F.col("doc_id")
    name = F.concat_ws("/", _pick(_TREES, i), _pick(_FOLDERS, F.floor(i / 5)), F.concat(F.lit("f"), _id(), F.lit("."), _pick(_SUFFIXES, F.floor(i / 15))))

    def save(rows) -> None:
        for r in rows:
            to = os.path.join(folder, r["name"])
            os.makedirs(os.path.dirname(to), exist_ok=True)
            with open(to, "wb") as f:
                f.write(r["text"].replace("\n", "\r\n").encode() + b"\xff\rend")

    os.makedirs(folder)
    table(spark, sf_dir, "documents").select(name.alias("name"), F.coalesce("text", F.lit("")).alias("text")).foreachPartition(save)
    found = files.scanned(spark, root, files.repositories(spark))
    return found.select("repo", "file", "suffix", F.md5(F.encode("text", "utf-8")).alias("text_md5"), F.array_join("langs", ",").alias("langs"), "include_md")


def repo_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    repos = files.repositories(spark).select("repo", F.array_join("langs", ",").alias("langs"), "include_md")
    name = F.when(F.col("doc_id") % 11 == 0, "unknown").otherwise(_pick(list(signals.REPOS), F.col("doc_id")))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("repo")).join(repos, "repo").select("doc_id", "repo", "langs", "include_md")


def _broken(spark: SparkSession, sf_dir: str) -> str:
    """A folder of JSON Lines: all turns, a broken line for each first turn, and blank lines."""
    path = runtime.scratch_path(spark, "jsonl")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    jsonl.write(rows.where("turn % 2 = 0"), path)
    jsonl.write(rows.where("turn % 2 = 1"), path, append=True)
    bad = rows.where("turn = 0").select(F.explode(F.array(F.concat(F.lit('{"conv_id": '), F.col("conv_id").cast("string"), F.lit(', "turn"')), F.lit("  "))))
    bad.write.mode("append").text(path)
    return path


_TURN = "conv_id long, turn long, role string, text string"


def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = runtime.scratch_path(spark, "jsonl")
    jsonl.write(table(spark, sf_dir, "conversations"), path)
    return jsonl.read_strict(spark, path, _TURN)


def jsonl_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good rows and broken lines, in one parse."""
    rows = jsonl.read_tolerant(spark, _broken(spark, sf_dir), _TURN)
    none = {"conv_id": F.lit(-1).cast("long"), "turn": F.lit(-1).cast("long"), "role": F.lit(""), "text": F.lit("")}
    return rows.select(*(F.coalesce(c, none[c]).alias(c) for c in none), F.coalesce("malformed", F.lit("")).alias("line"))


def jsonl_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines in one text file, written by all tasks and read in splits of 32 KB: where good and broken lines stand."""
    path = runtime.scratch_path(spark, "numbered")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "[\\r\\x0B\\x0C]", " ")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\n", F.lit('{"a": 1}'), F.lit(" "), text, F.to_json(F.struct("doc_id"))).alias("value"))
    joined.write(rows.orderBy("doc_id").select("value"), f"{path}/all.jsonl")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32768")
    try:  # the numbers are settled when the table is written
        found = runtime.written(jsonl.read_tolerant(spark, path, "doc_id long, a int").drop("file"), "numbers")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    bad = F.md5(F.encode(F.coalesce("malformed", F.lit("")), "utf-8"))
    return found.select("line", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), F.coalesce("a", F.lit(0)).alias("a"), bad.alias("malformed_md5"))


def jsonl_silent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonl.read_silent(spark, _broken(spark, sf_dir), _TURN)


def jsonl_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = runtime.scratch_path(spark, "jsonl")
    jsonl.write(table(spark, sf_dir, "conversations"), path)
    return jsonl.read_strict(spark, path, _TURN, role="user")


def jsonl_strict_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strict reader over all turns, without and with broken lines among them: rows read, or the error's condition."""
    whole = runtime.scratch_path(spark, "jsonl")
    jsonl.write(table(spark, sf_dir, "conversations"), whole)
    out = []
    for name, path in (("whole", whole), ("broken", _broken(spark, sf_dir))):
        for numbered in (False, True):
            try:
                read = jsonl.read_strict(spark, path, _TURN, numbered).agg(F.count("text").alias("n"), F.sum(F.length("text")).alias("size")).first()
                out.append((name, numbered, read["n"], read["size"], ""))
            except Exception as e:
                out.append((name, numbered, 0, 0, "malformed" if "malformed" in str(e).lower() else str(e)))
    return spark.createDataFrame(out, "name string, numbered boolean, n long, size long, error string")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    passed = F.col("quality") == 1
    error = F.when(passed, "").otherwise(F.concat(F.lit("no good text: "), _line()))
    fields = {"id": _id(), "category": F.coalesce("lang", F.lit("none")), "difficulty": F.col("source"), "passed": passed, "error": error, "latency_s": (F.col("doc_id") % 17).cast("double") / 8, "answer": F.coalesce("text", F.lit(""))}
    return rows.select(F.col("doc_id").alias("seq"), *(c.alias(n) for n, c in fields.items()))


def run_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run document, written by all tasks as one file and read again in splits."""
    path = f"{runtime.scratch_path(spark, 'run')}/t1_results.json"
    jsonl.write_run(_results(spark, sf_dir), path, "t1", "m")
    head = jsonl.read_run_head(spark, path).select("total", F.col("passed").alias("n_passed"))
    read = jsonl.read_run(spark, path).join(F.broadcast(head))
    return read.select("tag", "model", "total", "n_passed", F.col("seq").alias("place"), "id", "category", "difficulty", "passed", F.md5(F.col("error")).alias("error_md5"), "latency_s", F.md5(F.encode("answer", "utf-8")).alias("answer_md5"))


def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.numbered(reports.evaluation(_results(spark, sf_dir), "t1", "m"))


def comparison_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.numbered(reports.comparison(*(x.select("id", "passed") for x in _two_runs(spark, sf_dir)), "first", "second"))


def _fenced(code: str, lang: str = "C") -> str:
    return f"\n```{lang}\n{code}\n```\n"


_SNIPPETS = [f"int snippet_{i}(void) {{ return {i}; }} // code" for i in range(5)]


def _chunks_of(rows: DataFrame) -> DataFrame:
    """Chunks of rows (repo, path, suffix, text), every suffix wanted."""
    whole = rows.select("repo", "path", F.concat(F.lit("t/"), "path").alias("file"), "suffix", "text", F.array(*map(F.lit, _SUFFIXES)).alias("langs"), F.lit(True).alias("include_md"))
    found = chunkers.chunked(whole)
    return found.select("id", "source", "repo", "file", "lang", "kind", "title", F.md5(F.encode("body", "utf-8")).alias("body_md5"), F.size("code").alias("n_code"), F.md5(F.encode(F.array_join("code", "\n--\n"), "utf-8")).alias("code_md5"))


def _as_files(spark: SparkSession, sf_dir: str, suffix: str, text: Column, stem: Column | None = None) -> DataFrame:
    stem = F.concat(F.lit("d"), _id()) if stem is None else stem
    return table(spark, sf_dir, "documents").where("text is not null").select(F.lit("r").alias("repo"), F.concat(stem, F.lit("." + suffix)).alias("path"), F.lit(suffix).alias("suffix"), text.alias("text"))


def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a section of paragraphs with five snippets (four are kept) and a short one; a section that is too
    short, a plain one, and one with a title that was there before. Every third file has no heading."""
    body = F.replace(F.regexp_replace("text", "[#`]", ""), F.lit("\n"), F.lit("\n\n"))
    code = F.lit("".join(_fenced(x) for x in [_SNIPPETS[0], "tiny", *_SNIPPETS[1:]]))
    headed = F.concat(F.lit("bpf preamble\n# Part A\n"), body, code, F.lit("## Part B\nshort\n### Part C\n" + "x" * 80 + "\n# Part A\n" + "y" * 90))
    return _chunks_of(_as_files(spark, sf_dir, "md", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("bpf "), body, code)).otherwise(headed), F.concat(F.lit("my-doc_"), _id())))


def rst_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under a heading with a code block, before a section that is too short; every third without heading, with a literal block."""
    line = _line(marks='=~^"#*+:.`-')
    code = "\n\n.. code-block:: c\n\n    int main(void) { return 0; } // code\n\nAfter"
    headed = F.concat(F.lit("Intro bpf\n=========\n\n"), line, F.lit(code + "\n\nShort\n-----\n\nx\n"))
    plain = F.concat(F.lit("bpf "), line, F.lit(code + "\n\nExample::\n\n    int lit(void) { return 1; } // literal\n\nEnd"))
    return _chunks_of(_as_files(spark, sf_dir, "rst", F.when(F.col("doc_id") % 3 == 0, plain).otherwise(headed), F.concat(F.lit("my-doc_"), _id())))


def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document inside a Rust, C, header, Go and Python file; files of every fifth document have no signal.

    Functions stand twice (the first counts), one of C has a brace that is never closed.
    """
    return _chunks_of(_code_files(spark, sf_dir))


def _code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of code_chunks."""
    line, n = _line(marks="{}/*()"), _id()
    on = F.col("doc_id") % 5 != 0
    say = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    lead = lambda yes: F.when(on, F.lit(yes)).otherwise(F.lit("// nothing\n"))
    rust = say(lead("use aya::x;\n"), "/// ", line, "\nfn f_", n, "(a: u32) -> u32 { if a > 1 { a } else { 2 } }\n/// Twice.\nfn f_", n, "(b: u32) -> u32 { 1 }\n")
    c = say(lead("#include <vmlinux.h>\n"), "/** ", line, " */\nint run_", n, "(void *ctx) { int a = 0; return a; }\nstatic int aux_", n, "(int a) { {", line)
    go = say(lead('import "github.com/cilium/ebpf"\n'), "// ", line, "\nfunc Run", n, "(n int) error { return nil }\n")
    py = say(F.when(on, "b = BPF(text='x')\n").otherwise("b = 1\n"), F.col("text"))
    made = [_as_files(spark, sf_dir, s, t) for s, t in (("rs", rust), ("c", c), ("h", c), ("go", go), ("py", py))]
    rows = made[0]
    for x in made[1:]:
        rows = rows.unionByName(x)
    return rows


def rust_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the comment of a struct, a trait and an undocumented function, which counts only where nothing is documented: in every third file."""
    line, n = _line(marks="{}/*()"), _id()
    bare = F.concat(F.lit("use aya::x;\npub fn bare_"), n, F.lit("(a: u32) { let b = { a + 1 }; drop(b); }\n"))
    items = F.concat(F.lit("use aya::x;\n/// "), line, F.lit("\npub struct S_"), n, F.lit(" { first: u32, second: Option<u64> }\n/// Does it.\npub(crate) trait T_"), n, F.lit(" { fn go(&self) -> u32 { 1 } }\n"), bare)
    return _chunks_of(_as_files(spark, sf_dir, "rs", F.when(F.col("doc_id") % 3 == 0, bare).otherwise(items)))


def code_chunks_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code_chunks by the table function: a LATERAL join in SQL, with C headers read by an argument's parser."""
    tables.register(spark)
    rows = _code_files(spark, sf_dir).withColumns({"langs": F.array(*map(F.lit, _SUFFIXES)), "include_md": F.lit(True)})
    routed = chunkers.routed(rows).withColumn("suffix", F.when(F.col("suffix") == "h", "header").otherwise(F.col("suffix")))
    return spark.sql(
        """
        SELECT id, x.source, x.repo, x.file, x.lang, x.kind, x.title, md5(encode(x.body, 'utf-8')) AS body_md5, size(x.code) AS n_code, md5(encode(array_join(x.code, '\n--\n'), 'utf-8')) AS code_md5
        FROM (
          SELECT substr(sha1(concat_ws(':', f.repo, f.path, c.key)), 1, 12) AS id,
            min_by(struct(c.source, f.repo, concat('t/', f.path) AS file, c.lang, c.kind, c.title, c.body, c.code), struct(f.path, c.place)) AS x
          FROM {files} f, LATERAL file_chunks(f.suffix, f.text, f.path, map('header', 'c')) c
          GROUP BY 1)
        """,
        files=routed,
    )


_SIGNS = ["", " KProbe", ' SEC("xdp")', " use aya::", " link.AttachXDP", " perf.NewReader", " BPF_HASH (", " ebpf", " NewReader x ringbuf"]


def gate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files' texts pass the gate of their suffix: every document with each suffix, and a sign of one language or none."""
    ascii_ = F.regexp_replace("text", r"[^\x00-\x7F]", "_")
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.concat(ascii_, _pick(_SIGNS, F.col("doc_id"))).alias("text"))
    rows = rows.select("*", F.explode(F.array(*map(F.lit, signals.GATES))).alias("suffix"))  # the text is made once for all suffixes
    rows = rows.withColumns({"langs": F.array(*map(F.lit, _SUFFIXES)), "include_md": F.col("doc_id") % 2 == 0})
    return chunkers.routed(rows).select("doc_id", "suffix")


def chunk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = _pick(["tutorial_section", "doc_code", "raw_code"], F.col("doc_id"))
    return reports.numbered(reports.chunks_by_repo(chunkers.summary(table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), kinds.alias("kind")))))


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = _pick(["tutorial_section", "raw_code"], F.col("doc_id"))
    rows = table(spark, sf_dir, "documents").where("text is not null").select(_id().alias("id"), F.lit("r").alias("repo"), F.lit("c").alias("lang"), kind.alias("kind"), F.lit("T").alias("title"), F.col("text").alias("body"), F.array("text").alias("code"))
    return prompts.expanded(rows)


def _moody():
    """A provider whose answer hangs on the length of the message: fails always, is too short, or fails twice first."""
    seen: dict[tuple[int, str], int] = {}  # by thread, as each call makes its tries in one

    def provider(system: str, message: str, temperature: float) -> str:
        from threading import get_ident

        n, key = len(message), (get_ident(), message)
        seen[key] = seen.get(key, 0) + 1
        if n % 5 == 0:
            raise ValueError(f"no answer to {n} characters")
        if n % 3 == 0 and seen[key] % 3:
            raise ValueError("not yet")
        return "short" if n % 7 == 0 else f"<think>hm\n</think> {n} characters were asked at {temperature:g}, tell I {system}"

    return provider


def retry_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tries a call; a chunk's prompts end with its first failure."""
    got = generate.generated(_prompts(spark, sf_dir), _moody(), "as a test", delay=0)
    return got.select("id", "prompt_no", "style", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("error", F.lit("")).alias("error"))


def stream_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk files as a stream: samples and failures are appended, one row for each."""
    root = runtime.scratch_path(spark, "stream")
    rows = table(spark, sf_dir, "documents").where("text is not null")
    made = rows.select(_id().alias("id"), F.lit("s").alias("source"), F.lit("r").alias("repo"), F.lit("f").alias("file"), F.lit("c").alias("lang"), F.lit("raw_code").alias("kind"), F.lit("T").alias("title"), F.lit("").alias("body"), F.array("text").alias("code"))
    jsonl.write(made, f"{root}/chunks")
    resume.generation(spark, f"{root}/chunks", f"{root}/samples", f"{root}/failures", _moody(), "as a test", f"{root}/checkpoint", tries=3, delay=0).awaitTermination()
    good = resume.samples(spark, f"{root}/samples", f"{root}/checkpoint").select(F.col("source_chunk_id").alias("id"), "style", F.lit("").alias("error"))
    return good.unionByName(resume.failures(spark, f"{root}/failures", f"{root}/checkpoint").select(F.col("chunk_id").alias("id"), F.lit("").alias("style"), "error"))


def evaluate_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the answer to a problem: keyword checks, a program, a checker that fails, one that times out, none."""
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").where("text is not null")
    problems = rows.select(_id().alias("id"), _pick(["aya_user", "raises", "late", "lost", "words"], i).alias("category"), F.lit("easy").alias("difficulty"), F.when(i % 5 == 4, "keywords").otherwise("compile").alias("check"), F.col("text").alias("prompt"), F.array().cast("array<string>").alias("concepts"), F.when(i % 10 == 4, F.array(*map(F.lit, ("the", "of", "und", "que")))).alias("keywords"))

    def provider(system: str, message: str, temperature: float) -> str:
        if len(message) % 2:
            raise ValueError("odd")
        return "```rust\n" + message + "\n```"

    def raises(code: str) -> tuple[bool, str]:
        raise ValueError(f"{len(code)} characters")

    def late(code: str) -> tuple[bool, str]:
        import subprocess

        raise subprocess.TimeoutExpired("x", 1)

    program = compiling.command_checker(["sh", "-c", "test $(wc -c < src/main.rs) -gt 400 || { echo small; exit 1; }"], "src/main.rs")
    asked = runtime.written(evaluate.asked(problems, provider, "s"), "asked")  # it is read by both kinds of check
    got = evaluate.checked(asked, {"aya_user": program, "raises": raises, "late": late})
    return got.select("id", "category", "difficulty", "passed", "error", F.md5(F.encode("answer", "utf-8")).alias("answer_md5"))


#: Tools that say what they were asked, without the folders of the check, and pass code that holds "the".
_TOOL = """#!/bin/sh
[ "$1" = mod ] && exit 0
grep -q the src/main.rs main.go prog.bpf.c 2>/dev/null && exit 0
for a; do case $a in */*/*) a=${a%%/*}${a##*/};; esac; printf '%s ' "$a"; done
exit 1
"""


def compile_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as code for one of the four compilers, for which tools stand that show their command lines."""
    folder = runtime.local_path(runtime.scratch_path(spark, "tools"))
    for name in ("cargo", "go", "clang"):
        os.makedirs(f"{folder}/bin", exist_ok=True)
        with open(f"{folder}/bin/{name}", "w") as f:
            f.write(_TOOL)
        os.chmod(f"{folder}/bin/{name}", 0o755)
    for name in ("aya_kernel/.cargo/config.toml", "aya_kernel/Cargo.toml", "aya_user/Cargo.toml"):
        os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
        open(f"{folder}/{name}", "w").close()
    rows = table(spark, sf_dir, "documents").where("text is not null")
    none = {c: F.lit("") for c in ("difficulty", "prompt")} | {"check": F.lit("compile"), "keywords": F.lit(None).cast("array<string>"), "latency_s": F.lit(0.0)}
    answers = rows.select(_id().alias("id"), _pick(list(compiling.COMMANDS), F.col("doc_id")).alias("category"), F.col("text").alias("answer")).withColumns(none)
    got = evaluate.checked(answers, compiling.compilers(folder, f"{folder}/bin"), log=f"{folder}/log")
    return got.select("id", "category", "passed", F.regexp_replace(F.regexp_replace("error", "corpusloom-build-[0-9a-f]+", "target"), r"-Itmp\w+", "-I").alias("error"))


class _Echo:
    """A provider that asks over HTTP a server of its own process, which starts with the first call and ends with the provider.

    The server answers with what it was sent, and is broken for some.
    """

    def __init__(self) -> None:
        import threading

        self.server, self.lock = None, threading.Lock()

    def __reduce__(self) -> tuple:
        return _Echo, ()

    def start(self) -> None:
        import json
        import threading
        from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

        class Server(BaseHTTPRequestHandler):
            def do_POST(self) -> None:
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                n = len(body["messages"][1]["content"])
                said = f"<think>{n}</think> {self.path} {body['model']} {body['temperature']} {body['max_tokens']} {body['messages'][0]['content']}: {n} characters"
                self.send_response(500 if n % 5 == 0 else 200)
                self.end_headers()
                self.wfile.write(json.dumps({"choices": [{"message": {"content": said}}]}).encode())

            def log_message(self, *_: object) -> None:
                pass

        server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        self.server = server

    def __call__(self, system: str, message: str, temperature: float) -> str:
        with self.lock:
            if not self.server:
                self.start()
        return endpoint.chat(f"http://127.0.0.1:{self.server.server_port}/v1", "some-model", tokens=7)(system, message, temperature)

    def __del__(self) -> None:
        if self.server:
            self.server.shutdown()
            self.server.server_close()


def endpoint_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the prompt of a chunk, asked over HTTP: each task has a server beside it, so that none answers for all."""
    got = runtime.written(generate.generated(_prompts(spark, sf_dir), _Echo(), "as a test", threads=max(12, spark.sparkContext.defaultParallelism), tries=1, delay=0), "answers")
    return got.select("id", "prompt_no", "style", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("error", F.lit("")).alias("error"))


def _two_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq"), _id().alias("id"), *(F.lit("").alias(c) for c in ("category", "difficulty", "error", "answer")), F.lit(0.5).alias("latency_s"), "quality", "toxic", "doc_id")
    return rows.where("doc_id % 7 <> 3").withColumn("passed", F.col("quality") == 1), rows.where("doc_id % 5 <> 1").withColumn("passed", F.col("toxic") == 0)


def compare_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compare command over two run documents, and the report it writes."""
    from corpusloom import cli

    root = runtime.scratch_path(spark, "commands")
    for tag, rows in zip(("first", "second"), _two_runs(spark, sf_dir)):
        jsonl.write_run(rows, f"{root}/{tag}.json", tag, "m")
    cli.main(["compare", f"{root}/first.json", f"{root}/second.json", "--out", f"{root}/report.txt"])
    return lines.numbered(spark, f"{root}/report.txt").select(F.col("line").cast("int").alias("line_no"), F.col("value").alias("line"))


def evaluate_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluate command over a problem for each document, answered by itself; the results of its run document."""
    from corpusloom import cli

    root = runtime.scratch_path(spark, "commands")
    rows = table(spark, sf_dir, "documents").where("text is not null").orderBy("doc_id")
    problems = rows.select(_id().alias("id"), F.coalesce("lang", F.lit("none")).alias("category"), F.lit("easy").alias("difficulty"), F.lit("keywords").alias("check"), F.col("text").alias("prompt"), F.array().cast("array<string>").alias("concepts"), F.array(*map(F.lit, ("the", "of", "und", "que"))).alias("keywords"))
    joined.write(problems.select(F.to_json(F.struct("*"))), f"{root}/problems.jsonl")
    cli.main(["evaluate", "--tag", "t", "--problems", f"{root}/problems.jsonl", "--out", f"{root}/out", "--log", f"{root}/log"], lambda system, message, temperature: message)
    got = jsonl.read_run(spark, f"{root}/out/t_results.json")
    return got.select("tag", "seq", "id", "category", "passed", "error", F.md5(F.encode("answer", "utf-8")).alias("answer_md5"))


def fixed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the comment of a C and a Go answer that lacks or has what it uses; fixed by the table of rules."""
    i, line = F.col("doc_id"), _line(marks="()._/")
    some = lambda by, yes, no="": F.when(i % by == 0, yes).otherwise(no)
    c = F.concat(some(2, "#include <vmlinux.h>\n"), some(5, "#include <bpf/bpf_endian.h>\n"), F.lit("// "), line, F.lit("\n"), some(3, "int x = bpf_htons(1);\n", "int x;\n"))
    go = F.concat(F.lit("package main\n"), some(2, 'import (\n\t"fmt"\n\t"x/y"\n)\n', 'import "fmt"\n'), F.lit("// "), line, F.lit("\n"), some(3, "var a = fmt.Sprint(1)\n"), some(5, "var l = link.Kprobe\n"))
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.explode(F.create_map(F.lit("c"), c, F.lit("go"), go)).alias("lang", "code"))
    return rows.select("doc_id", "lang", F.md5(F.encode(fixer.fixed(F.col("code"), F.col("lang")), "utf-8")).alias("code_md5"))


_NOT_QUERIES = {"table", "oracle_sql", "queries"}


def queries() -> dict:
    return {k: v for k, v in globals().items() if getattr(v, "__module__", "") == __name__ and k[0].islower() and k not in _NOT_QUERIES}


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(_sql(x) for x in values) + "]"


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def _packed(source: str, most: int = 4000) -> str:
    """CTE body parted(doc_id, part, body) of a source (doc_id, body): paragraphs packed in order."""
    two = "chr(10) || chr(10)"
    return f"""d AS (SELECT doc_id, body, string_split(body, {two}) AS p FROM {source}),
    s(doc_id, i, part, size) AS (SELECT doc_id, 1, 0, length(p[1]) FROM d WHERE length(body) > {most}
      UNION ALL SELECT s.doc_id, s.i + 1, CASE WHEN s.size + length(d.p[s.i + 1]) > {most} THEN s.part + 1 ELSE s.part END,
        CASE WHEN s.size + length(d.p[s.i + 1]) > {most} THEN length(d.p[s.i + 1]) ELSE s.size + length(d.p[s.i + 1]) END FROM s JOIN d USING (doc_id) WHERE s.i < len(d.p)),
    parted AS (SELECT s.doc_id, s.part, string_agg(d.p[s.i], {two} ORDER BY s.i) AS body FROM s JOIN d USING (doc_id) GROUP BY s.doc_id, s.part UNION ALL SELECT doc_id, 0, body FROM d WHERE length(body) <= {most})"""


def oracle_sql() -> dict[str, str]:
    pick = lambda values, by: f"{_list(values)}[({by}) % {len(values)} + 1]"
    configs = ", ".join(f"({_sql(k)}, {_sql(','.join(v))}, {str(md).lower()})" for k, (v, md) in signals.REPOS.items())
    repos = f"repos AS (SELECT * FROM (VALUES {configs}) AS v(repo, langs, include_md))"
    one = lambda marks: f"regexp_replace(text, '[\\r\\n{marks}]', ' ', 'g')"
    results = f"""r AS (SELECT doc_id AS seq, doc_id::varchar AS id, coalesce(lang, 'none') AS category, source AS difficulty, quality = 1 AS passed,
    CASE WHEN quality = 1 THEN '' ELSE 'no good text: ' || {one('')} END AS error, (doc_id % 17)::double / 8 AS latency_s, coalesce(text, '') AS answer FROM labels JOIN documents USING (doc_id))"""
    turn = "conv_id, turn, role, text"
    ident = lambda key: f"substr(sha1('r:' || path || ':' || {key}), 1, 12)"
    chunk = lambda key, source, lang, kind, title, body, n, code: f"{ident(key)} AS id, '{source}' AS source, 'r' AS repo, 't/' || path AS file, '{lang}' AS lang, '{kind}' AS kind, {title} AS title, md5({body}) AS body_md5, {n}::INT AS n_code, md5({code}) AS code_md5"
    body = f"{_STRIP.format('''replace(regexp_replace(text, '[#`]', '', 'g'), chr(10), chr(10) || chr(10))''')}"
    joined = lambda n: _sql("\n--\n".join(_SNIPPETS[:n]))
    path = "'my-doc_' || doc_id || '.{}' AS path"
    rst_line = one('=~^"#*+:.`-')
    int_main, lit = "int main(void) { return 0; } // code", "int lit(void) { return 1; } // literal"
    line = one("{}/*()")
    code = f"docs AS (SELECT doc_id, text, {line} AS line, doc_id::varchar AS n FROM documents WHERE text IS NOT NULL AND doc_id % 5 <> 0)"
    of = lambda suffix: f"(SELECT *, 'd' || n || '.{suffix}' AS path FROM docs)"
    stripped = _STRIP.format("line")
    rust_code, go_code = "'fn f_' || n || '(a: u32) -> u32 {' || chr(10) || '{ if a > 1 { a } else { 2 } }'", "'func Run' || n || '(n int) error {' || chr(10) || '{ return nil }'"
    c_code = "'int run_' || n || '(void *ctx) {' || chr(10) || '{ int a = 0; return a; }'"
    aux = f"{_STRIP.format('''left('static int aux_' || n || '(int a) {' || chr(10) || left('{ {' || line, 600), 1200)''')}"
    c = lambda s: f"SELECT {chunk(chr(39) + 'run_' + chr(39) + ' || n', 'source', 'c', 'doc_code', chr(39) + 'run_' + chr(39) + ' || n', stripped, 1, c_code)} FROM {of(s)} UNION ALL SELECT {chunk(chr(39) + 'aux_' + chr(39) + ' || n', 'source', 'c', 'raw_code', chr(39) + 'aux_' + chr(39) + ' || n', chr(39) * 2, 1, aux)} FROM {of(s)}"
    gate = lambda s: signals.GATES[s].split(")", 1)[1].replace("'", "''")
    gates = " OR ".join(f"(suffix = '{s}' AND {'include_md AND ' if s == 'md' else ''}regexp_matches(t, '{gate(s)}', '{'i' if s in ('md', 'rst') else 'c'}'))" for s in signals.GATES)
    ask = f"""c AS (SELECT doc_id, doc_id::varchar AS id, doc_id % 2 AS raw, text, {_STRIP.format('text')} AS b FROM documents WHERE length(text || text) >= 150),
    two AS (SELECT id, 0 AS k, 'concept' AS style, '0.6' AS t, length(left(b, 1500)) + length('Explain the concept of ''T'' in the context of eBPF development.') + 7 AS n FROM c WHERE raw = 0 AND b <> ''
      UNION ALL SELECT id, 1, 'code_walkthrough', '0.3', length(left(b, 800)) + CASE WHEN b = '' THEN 0 ELSE 7 END + length('Walk me through this eBPF code step by step and explain what it does:') + 2 + length(left(text, 1200)) + 9 FROM c WHERE raw = 0 AND text <> ''
      UNION ALL SELECT id, 0, 'code_analysis', '0.3', length('Analyze this c eBPF code and explain what it does, how it works, and what eBPF concepts it demonstrates:') + 2 + length(left(text, 1500)) + 9 FROM c WHERE raw = 1 AND text <> ''),
    told AS (SELECT *, CAST(row_number() OVER w - 1 AS INT) AS prompt_no, CASE WHEN n % 5 = 0 THEN 'no answer to ' || n || ' characters' WHEN n % 7 = 0 THEN 'Answer too short: ''short''' ELSE '' END AS error FROM two WINDOW w AS (PARTITION BY id ORDER BY k)),
    upto AS (SELECT *, coalesce(sum(CASE WHEN error <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS failed FROM told)"""
    ended = "CASE WHEN answer_ok THEN b ELSE 'ERROR: odd' END"
    sql = {
        "scan_files": f"""WITH {repos}, f AS (SELECT text, {pick(_TREES, 'doc_id')} AS repo, {pick(_FOLDERS, 'doc_id // 5')} AS folder, {pick(_SUFFIXES, 'doc_id // 15')} AS suffix, doc_id FROM documents)
    SELECT repo, repo || '/' || folder || '/f' || doc_id || '.' || suffix AS file, suffix, md5(coalesce(text, '') || chr(65533) || chr(10) || 'end') AS text_md5, langs, include_md FROM f JOIN repos USING (repo)
    WHERE folder <> 'vendor' AND (list_contains(string_split(langs, ','), suffix) OR (include_md AND suffix = 'md') OR (suffix = 'rst' AND repo = 'linux-bpf-docs'))""",
        "repo_config": f"WITH {repos} SELECT doc_id, repo, langs, include_md FROM (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'unknown' ELSE {pick(list(signals.REPOS), 'doc_id')} END AS repo FROM documents) JOIN repos USING (repo)",
        "jsonl_roundtrip": f"SELECT {turn} FROM conversations",
        "jsonl_tolerant": f"SELECT {turn}, '' AS line FROM conversations UNION ALL SELECT -1, -1, '', '', '{{\"conv_id\": ' || conv_id || ', \"turn\"' FROM conversations WHERE turn = 0",
        "jsonl_numbers": """WITH l AS (SELECT doc_id, list_concat(['{"a": 1}', ' '], string_split(regexp_replace(coalesce(text, ''), '[\\r\\x0B\\x0C]', ' ', 'g'), chr(10)), ['{"doc_id":' || doc_id || '}']) AS l FROM documents),
    u AS (SELECT doc_id, len(l) AS n, unnest(l) AS v, generate_subscripts(l, 1) AS i FROM l), f AS (SELECT *, row_number() OVER (ORDER BY doc_id, i) - 1 AS line FROM u)
    SELECT line, CASE WHEN i = n THEN doc_id ELSE -1 END AS doc_id, CASE WHEN i = 1 THEN 1 ELSE 0 END AS a, md5(CASE WHEN i IN (1, n) THEN '' ELSE v END) AS malformed_md5 FROM f WHERE regexp_replace(v, '^[\\x20\\x09-\\x0D]+', '') <> ''""",
        "jsonl_strict_error": "WITH c AS (SELECT count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS size FROM conversations), b AS (SELECT unnest([false, true]) AS numbered) SELECT 'whole' AS name, numbered, n, size, '' AS error FROM c, b UNION ALL SELECT 'broken', numbered, 0, 0, 'malformed' FROM b",
        "jsonl_silent": f"SELECT {turn} FROM conversations",
        "jsonl_strict": f"SELECT {turn} FROM conversations WHERE role = 'user'",
        "run_roundtrip": f"WITH {results} SELECT 't1' AS tag, 'm' AS model, CAST(count(*) OVER () AS INT) AS total, CAST(count(*) FILTER (passed) OVER () AS INT) AS n_passed, CAST(row_number() OVER (ORDER BY seq) - 1 AS INT) AS place, id, category, difficulty, passed, md5(error) AS error_md5, latency_s, md5(answer) AS answer_md5 FROM r",
        "evaluation_report": f"""WITH {results}, lines AS (SELECT 0 AS a, 0 AS b, ['Evaluation results', repeat('=', 50), 'Model  : m', 'Tag    : t1', '', 'Overall pass@1 : ' || count(*) FILTER (passed) || '/' || count(*) || ' (' || printf('%.1f', 100 * count(*) FILTER (passed) / count(*)) || '%)', '', 'By category:'] AS l FROM r
      UNION ALL SELECT 1, row_number() OVER (ORDER BY category), [format('  {{:<20}} {{}}/{{}}  ({{}}%)', category, count(*) FILTER (passed), count(*), printf('%.0f', 100 * count(*) FILTER (passed) / count(*)))] FROM r GROUP BY category
      UNION ALL SELECT 2, 0, ['', 'Per-problem results:']
      UNION ALL SELECT 3, seq, CASE WHEN passed THEN [head] ELSE [head, '         ↳ ' || left(error, 120)] END FROM (SELECT *, format('  [{{}}] {{:<15}} ({{}}) {{}}s', CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END, id, category, printf('%.1f', latency_s)) AS head FROM r)),
    flat AS (SELECT a, b, generate_subscripts(l, 1) AS c, unnest(l) AS line FROM lines) SELECT CAST(row_number() OVER (ORDER BY a, b, c) - 1 AS INT) AS line_no, regexp_replace(line, '\\s+$', '') AS line FROM flat""",
        "comparison_report": f"""WITH a AS (SELECT doc_id::varchar AS id, quality = 1 AS passed FROM labels WHERE doc_id % 7 <> 3), b AS (SELECT doc_id::varchar AS id, toxic = 0 AS passed FROM labels WHERE doc_id % 5 <> 1),
    c AS (SELECT id, a.passed AS x, coalesce(b.passed, false) AS y FROM a LEFT JOIN b USING (id)),
    t AS (SELECT count(*) AS n, count(*) FILTER (x) AS px, (SELECT count(*) FILTER (passed) FROM b) AS py, count(*) FILTER (y AND NOT x) AS up, count(*) FILTER (x AND NOT y) AS down, count(*) FILTER (x = y) AS same FROM c),
    lines AS (SELECT 0 AS p, '' AS id, ['Comparison: first vs second', repeat('=', 60)] AS l UNION ALL SELECT 1, id, [CASE WHEN y THEN '  IMPROVED : ' ELSE '  REGRESSED: ' END || id] FROM c WHERE x <> y
      UNION ALL SELECT 2, '', ['', 'first pass@1: ' || px || '/' || n, 'second pass@1: ' || py || '/' || n, 'Improved  : ' || up, 'Regressed : ' || down, 'Unchanged : ' || same] FROM t),
    flat AS (SELECT p, id, generate_subscripts(l, 1) AS k, unnest(l) AS line FROM lines) SELECT CAST(row_number() OVER (ORDER BY p, id, k) - 1 AS INT) AS line_no, line FROM flat""",
        "markdown_sections": f"""WITH RECURSIVE docs AS (SELECT doc_id, {body} AS raw, doc_id % 3 = 0 AS bare FROM documents WHERE text IS NOT NULL), m AS (SELECT doc_id, {_STRIP.format("CASE WHEN bare THEN 'bpf ' || replace(regexp_replace(text, '[#`]', '', 'g'), chr(10), chr(10) || chr(10)) ELSE raw END")} AS body FROM docs JOIN documents USING (doc_id)),
    {_packed('m')}, f AS (SELECT *, {path.format('md')} FROM parted)
    SELECT {chunk("'Part A_' || part", 'markdown', 'text', 'tutorial_section', "'Part A'", 'body', 4, joined(4))} FROM f WHERE doc_id % 3 <> 0
    UNION ALL SELECT {chunk("'full_' || part", 'markdown', 'text', 'tutorial_section', "'My Doc ' || doc_id", 'body', 3, joined(3))} FROM f WHERE doc_id % 3 = 0
    UNION ALL SELECT {chunk("'Part C_0'", 'markdown', 'text', 'tutorial_section', "'Part C'", "repeat('x', 80)", 0, "''")} FROM f WHERE doc_id % 3 <> 0 AND part = 0""",
        "rst_sections": f"""WITH RECURSIVE m AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'bpf ' || {rst_line} || chr(10) || chr(10) || 'After' || chr(10) || chr(10) || 'ExampleEnd' ELSE {_STRIP.format(rst_line + " || chr(10) || chr(10) || 'After'")} END AS body FROM documents WHERE text IS NOT NULL),
    {_packed('m')}, f AS (SELECT *, {path.format('rst')} FROM parted)
    SELECT {chunk("'Intro bpf_' || part", 'kernel_docs', 'text', 'tutorial_section', "'Intro bpf'", 'body', 1, _sql(int_main))} FROM f WHERE doc_id % 3 <> 0
    UNION ALL SELECT {chunk("'full_' || part", 'kernel_docs', 'text', 'tutorial_section', "'My Doc ' || doc_id", 'body', 2, _sql(int_main + chr(10) + '--' + chr(10) + lit))} FROM f WHERE doc_id % 3 = 0 AND doc_id IN (SELECT doc_id FROM m WHERE length(body) >= 80)""",
        "code_chunks": f"""WITH {code} SELECT {chunk("'f_' || n", 'source', 'rust', 'doc_code', "'f_' || n", stripped, 1, rust_code)} FROM {of('rs')}
    UNION ALL {c('c')} UNION ALL {c('h')}
    UNION ALL SELECT {chunk("'Run' || n", 'source', 'go', 'doc_code', "'Run' || n", stripped, 1, go_code)} FROM {of('go')}
    UNION ALL SELECT {chunk("''", 'source', 'python', 'raw_code', "'d' || n", "''", 1, "left('b = BPF(text=''x'')' || chr(10) || text, 3000)")} FROM {of('py')}""",
        "compile_checks": f"""WITH d AS (SELECT doc_id, text, contains(text, 'the') AS ok FROM documents WHERE text IS NOT NULL)
    SELECT doc_id::varchar AS id, {pick(list(compiling.COMMANDS), 'doc_id')} AS category, ok AS passed, CASE WHEN ok THEN '' ELSE {pick([' '.join([*(re.sub('/[^ ]*/', '', x.replace('{dir}', '/x').replace('{target}', 'target')) if x not in ('-I{dir}', '{dir}/prog.bpf.c', '{dir}/prog.o') else {'-I{dir}': '-I', '{dir}/prog.bpf.c': 'prog.bpf.c', '{dir}/prog.o': 'prog.o'}[x] for x in c[1:])]) + ' ' for c in compiling.COMMANDS.values()], 'doc_id')} END AS error FROM d""",
        "endpoint_answers": f"WITH {ask}, e AS (SELECT id, prompt_no, style, k, n % 5 = 0 AS bad, '/v1/chat/completions some-model ' || t || ' 7 as a test: ' || n || ' characters' AS answer FROM told), u AS (SELECT *, coalesce(sum(bad::INT) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS failed FROM e) SELECT id, prompt_no, style, CASE WHEN bad THEN '' ELSE answer END AS answer, CASE WHEN bad THEN 'HTTP Error 500: Internal Server Error' ELSE '' END AS error FROM u WHERE failed = 0",
        "evaluate_command": """WITH p AS (SELECT doc_id, text, coalesce(lang, 'none') AS category, ['the', 'of', 'und', 'que'] AS words, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS b FROM documents WHERE text IS NOT NULL),
    k AS (SELECT *, list_filter(words, lambda w: contains(lower(b), w)) AS found, list_filter(words, lambda w: NOT contains(lower(b), w)) AS missing FROM p)
    SELECT 't' AS tag, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS INT) AS seq, doc_id::varchar AS id, category, len(found) >= 3 AS passed,
      'Found ' || len(found) || '/4 keywords. Missing: [' || array_to_string(list_transform(missing, lambda w: chr(39) || w || chr(39)), ', ') || ']' AS error, md5(left(b, 2000)) AS answer_md5 FROM k""",
        "fixed_answers": f"""WITH d AS (SELECT doc_id, doc_id % 2 = 0 AS two, doc_id % 3 = 0 AS three, doc_id % 5 = 0 AS five, {one('()._/')} AS line FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, 'c' AS lang, CASE WHEN two THEN '#include <vmlinux.h>' || chr(10) ELSE '' END || CASE WHEN five OR three THEN '#include <bpf/bpf_endian.h>' || chr(10) ELSE '' END || '// ' || line || chr(10) || CASE WHEN three THEN 'int x = bpf_htons(1);' ELSE 'int x;' END || chr(10) AS code FROM d),
    g AS (SELECT doc_id, 'go' AS lang, 'package main' || chr(10) || CASE WHEN two THEN 'import (' || chr(10) || CASE WHEN five THEN chr(9) || '"github.com/cilium/ebpf/link"' || chr(10) ELSE '' END || CASE WHEN three THEN chr(9) || '"fmt"' || chr(10) ELSE '' END || chr(9) || '"x/y"' || chr(10) || ')' || chr(10)
      ELSE CASE WHEN five THEN 'import "github.com/cilium/ebpf/link"' || chr(10) ELSE '' END || CASE WHEN three THEN 'import "fmt"' || chr(10) ELSE '' END END || '// ' || line || chr(10) || CASE WHEN three THEN 'var a = fmt.Sprint(1)' || chr(10) ELSE '' END || CASE WHEN five THEN 'var l = link.Kprobe' || chr(10) ELSE '' END AS code FROM d)
    SELECT doc_id, lang, md5(code) AS code_md5 FROM (SELECT * FROM c UNION ALL SELECT * FROM g)""",
        "rust_items": f"""WITH docs AS (SELECT doc_id, doc_id::varchar AS n, 'd' || doc_id || '.rs' AS path, {line} AS line FROM documents WHERE text IS NOT NULL)
    SELECT {chunk("'bare_' || n", 'source', 'rust', 'raw_code', "'bare_' || n", "''", 1, "'pub fn bare_' || n || '(' || chr(10) || '{ let b = { a + 1 }; drop(b); }'")} FROM docs WHERE doc_id % 3 = 0
    UNION ALL SELECT {chunk("'S_' || n", 'source', 'rust', 'doc_code', "'S_' || n", stripped, 1, "'struct S_' || n || ' {' || chr(10) || '{ first: u32, second: Option<u64> }'")} FROM docs WHERE doc_id % 3 <> 0
    UNION ALL SELECT {chunk("'T_' || n", 'source', 'rust', 'doc_code', "'T_' || n", "'Does it.'", 1, "'trait T_' || n || ' {' || chr(10) || '{ fn go(&self) -> u32 { 1 } }'")} FROM docs WHERE doc_id % 3 <> 0""",
        "gate_filter": f"WITH f AS (SELECT doc_id, doc_id % 2 = 0 AS include_md, regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g') || {pick(_SIGNS, 'doc_id')} AS t, unnest({_list(list(signals.GATES))}) AS suffix FROM documents WHERE text IS NOT NULL) SELECT doc_id, suffix FROM f WHERE {gates}",
        "chunk_report": "SELECT CAST(row_number() OVER (ORDER BY n DESC, source) - 1 AS INT) AS line_no, format('  {:<30} {:>6}', source, n) AS line FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)",
        "retry_calls": f"WITH {ask} SELECT id, prompt_no, style, CASE WHEN error = '' THEN n || ' characters were asked at ' || t || ', tell I as a test' ELSE '' END AS answer, error FROM upto WHERE failed = 0",
        "stream_generation": f"""WITH c AS (SELECT doc_id::varchar AS id, text, length('Analyze this c eBPF code and explain what it does, how it works, and what eBPF concepts it demonstrates:') + 2 + length(left(text, 1500)) + 9 AS n FROM documents WHERE length(text) >= 150)
    SELECT id, CASE WHEN error = '' THEN 'code_analysis' ELSE '' END AS style, error FROM (SELECT id, CASE WHEN n % 5 = 0 THEN 'no answer to ' || n || ' characters' WHEN n % 7 = 0 THEN 'Answer too short: ''short''' ELSE '' END AS error FROM c)""",
        "evaluate_checks": f"""WITH p AS (SELECT doc_id::varchar AS id, {pick(['aya_user', 'raises', 'late', 'lost', 'words'], 'doc_id')} AS category, doc_id, length(text) % 2 = 0 AS answer_ok, {_STRIP.format('text')} AS b FROM documents WHERE text IS NOT NULL),
    e AS (SELECT *, {ended} AS answer, CASE WHEN doc_id % 10 = 4 THEN ['the', 'of', 'und', 'que'] ELSE CAST([] AS VARCHAR[]) END AS words FROM p),
    k AS (SELECT *, list_filter(words, lambda w: contains(lower(answer), w)) AS found, list_filter(words, lambda w: NOT contains(lower(answer), w)) AS missing FROM e)
    SELECT id, category, 'easy' AS difficulty, CASE category WHEN 'aya_user' THEN strlen(answer) > 400 WHEN 'words' THEN len(found) >= 3 ELSE false END AS passed,
    CASE category WHEN 'aya_user' THEN CASE WHEN strlen(answer) > 400 THEN '' ELSE 'small' || chr(10) END WHEN 'raises' THEN 'ERROR: ' || length(answer) || ' characters' WHEN 'late' THEN 'TIMEOUT: compilation exceeded limit' WHEN 'lost' THEN 'Unknown category: lost'
      ELSE 'Found ' || len(found) || '/' || len(words) || ' keywords. Missing: [' || array_to_string(list_transform(missing, lambda w: '''' || w || ''''), ', ') || ']' END AS error, md5(left(answer, 2000)) AS answer_md5 FROM k""",
    }
    return sql | {"code_chunks_sql": sql["code_chunks"], "compare_command": sql["comparison_report"]}
