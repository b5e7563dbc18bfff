"""What survives: batches played again, lost tasks, file splits, forking checkers, parts of one file."""

import json
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom import cli, runtime, schemas
from corpusloom.operators import calls, compiling, evaluate
from corpusloom.plans import reports
from corpusloom.sources import batches, joined, jsonl, lines
from corpusloom.streaming import resume

ROOT = Path(__file__).resolve().parents[1]


def chunk(i, code):
    return {"id": str(i), "source": "s", "repo": "r", "file": "f", "lang": "c", "kind": "raw_code", "title": "t", "body": "", "code": [code * 40]}


def noting(folder):
    """A provider that notes each call as a file, and fails for some."""
    folder.mkdir()

    def provider(system, message, temperature):
        import uuid

        (folder / uuid.uuid4().hex).write_text(message)
        if "broken" in message:
            raise ValueError("no answer")
        return f"{uuid.uuid4().hex} is an answer that is never the same twice and long enough."

    return provider


def tables(spark, where):
    good = resume.samples(spark, str(where / "samples"), str(where / "state")).collect()
    bad = resume.failures(spark, str(where / "failures"), str(where / "state")).collect()
    return sorted(r["source_chunk_id"] for r in good), sorted((r["chunk_id"], r["error"]) for r in bad), sorted(r["conversations"][2]["value"] for r in good)


def streamed(spark, where, provider):
    args = [str(where / x) for x in ("in", "samples", "failures")]
    resume.generation(spark, *args, provider, "sys", str(where / "state"), tries=1).awaitTermination()


@pytest.mark.parametrize("moment", ["between the tables", "before the marker", "after the marker"])
def test_batch_that_dies_is_played_again(spark, tmp_path, monkeypatch, moment):
    rows = [chunk(i, "broken " if i % 3 == 0 else "fine ") for i in range(12)]
    for name in ("clean", "killed"):
        (tmp_path / name / "in").mkdir(parents=True)
        for half in (0, 1):
            (tmp_path / name / "in" / f"{half}.json").write_text("".join(json.dumps(r) + "\n" for r in rows[half * 6 : half * 6 + 6]))
    streamed(spark, tmp_path / "clean", noting(tmp_path / "calls_clean"))
    whole = batches.append

    def dies(spark_, log, batch, parts):
        if moment == "between the tables":
            path, first = next(iter(parts.items()))
            first.write.mode("overwrite").json(f"{path}/batch={batch}")
        elif moment == "before the marker":
            for path, df in parts.items():
                df.write.mode("overwrite").json(f"{path}/batch={batch}")
        else:
            whole(spark_, log, batch, parts)
        raise RuntimeError("killed")

    where, provider = tmp_path / "killed", noting(tmp_path / "calls_killed")
    monkeypatch.setattr(batches, "append", dies)
    with pytest.raises(Exception, match="killed"):
        streamed(spark, where, provider)
    before = tables(spark, where)
    assert before[0] == [] or moment == "after the marker"
    monkeypatch.setattr(batches, "append", whole)
    streamed(spark, where, provider)
    assert tables(spark, where)[:2] == tables(spark, tmp_path / "clean")[:2]
    assert len({r[0] for r in tables(spark, where)[1]}) == 4 and set(before[2]) <= set(tables(spark, where)[2])
    assert len(list((tmp_path / "calls_killed").iterdir())) == len(list((tmp_path / "calls_clean").iterdir())) == 12
    streamed(spark, where, provider)  # nothing is left to do
    assert len(list((tmp_path / "calls_killed").iterdir())) == 12


def test_synthesise_finishes_a_run_that_died(spark, tmp_path, monkeypatch):
    (tmp_path / "chunks").mkdir()
    (tmp_path / "chunks" / "a.json").write_text("".join(json.dumps(chunk(i, "fine ")) + "\n" for i in range(4)))
    provider, whole = noting(tmp_path / "calls"), batches.append
    args = [str(tmp_path / x) for x in ("chunks", "samples", "failures")]
    monkeypatch.setattr(batches, "append", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        cli.synthesised(spark, *args, provider)
    monkeypatch.setattr(batches, "append", whole)
    (tmp_path / "chunks" / "b.json").write_text(json.dumps(chunk(9, "broken ")) + "\n")
    report = cli.synthesised(spark, *args, provider, tries=1)
    assert report.split("\n") == ["Chunks pending : 1", "Samples        : 0", "Failures       : 1"]
    assert len(list((tmp_path / "calls").iterdir())) == 5
    assert batches.read(spark, f"{args[1]}_log", args[1], schemas.SAMPLE).count() == 4


_LOST = """
import os, sys, uuid
from pathlib import Path
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from corpusloom.operators import calls
def one(row):
    Path({asked!r}, str(row["i"]) + "-" + uuid.uuid4().hex).write_text("")
    if row["i"] == 17 and not os.path.exists({died!r}):
        Path({died!r}).write_text("")
        os._exit(1)
    return [(row["i"], row["i"] * 2)]
rows = calls.called(spark.range(40).withColumnRenamed("id", "i"), one, "i long, twice long", calls=2, log={log!r}).collect()
assert sorted((r.i, r.twice) for r in rows) == [(i, 2 * i) for i in range(40)]
assert sorted(r.i for r in calls.logged(spark, {log!r}, "i long, twice long").collect()) == list(range(40))
spark.stop()
"""


def test_task_that_died_asks_only_for_the_rest(tmp_path):
    """A worker process dies in a call; the retried task asks for what was not logged: the call in flight alone is made twice."""
    asked = tmp_path / "asked"
    asked.mkdir()
    code = _LOST.format(root=str(ROOT), asked=str(asked), died=str(tmp_path / "died"), log=str(tmp_path / "log"))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    times = {}
    for f in asked.iterdir():
        times[int(f.name.split("-")[0])] = times.get(int(f.name.split("-")[0]), 0) + 1
    assert times == {i: 2 if i == 17 else 1 for i in range(40)}


def test_calls_are_bounded_over_all_tasks(spark, tmp_path):
    """Twelve rows, three calls at once: files mark the running calls."""
    running, most = tmp_path / "running", tmp_path / "most"
    running.mkdir()
    most.mkdir()

    def one(row):
        import uuid

        mine = running / uuid.uuid4().hex
        mine.write_text("")
        (most / str(len(list(running.iterdir())))).write_text("")
        time.sleep(0.1)
        mine.unlink()
        return [(row["id"],)]

    assert calls.called(spark.range(24), one, "id long", calls=3).count() == 24
    assert max(int(p.name) for p in most.iterdir()) <= 3


def test_null_columns_and_no_rows_in_calls(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (None, "x"), (None, None), (None, None)], "bucket long, row string")
    got = calls.called(df, lambda r: [(r["bucket"], r["row"])], "a long, b string", log=str(tmp_path / "log")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, None), (None, "x"), (None, None), (None, None)], key=str)
    assert calls.called(df.limit(0), lambda r: [(1,)], "a long").count() == 0


def talk(q, a):
    return {"conversations": [{"from": "human", "value": q}, {"from": "gpt", "value": a}], "source_chunk_id": a[:4], "repo": "r", "style": "concept"}


def test_order_does_not_hang_on_file_splits(spark, tmp_path):
    """The same rows stay for 1, 3 and 8 splits: exact duplicates keep the first in file order, near ones the last."""
    source = tmp_path / "in"
    source.mkdir()
    number = 0
    for name in ("b.jsonl", "a.jsonl"):
        out = []
        for i in range(30):
            number += 1
            out += [json.dumps(talk(f"What is a bpf map of kind {i % 10}, please, and why?", f"{number:04d} A bpf map is " + "a word " * 40)), "", "{broken"][: 3 if i % 5 == 0 else 1]
        (source / name).write_text("\n".join(out) + "\n")
    size = max(p.stat().st_size for p in source.iterdir())
    kept, orders = [], []
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for splits in (1, 3, 8):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // splits + 1))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = jsonl.read_tolerant(spark, str(source), schemas.SAMPLE)
        orders.append(sorted((r["seq"], r["line"], r["file"][-7:], r["source_chunk_id"] or "", r["malformed"] or "") for r in rows.collect()))
        report = cli.main(["clean", str(source), str(tmp_path / f"out{splits}")])
        assert report.startswith("Malformed lines skipped: 12")
        bad = spark.read.json(str(tmp_path / f"out{splits}_malformed")).collect()
        assert sorted((r["file"][-7:], r["line"]) for r in bad) == sorted((f, 2 + 7 * k) for f in ("a.jsonl", "b.jsonl") for k in range(6))
        kept.append(sorted(r["source_chunk_id"] for r in spark.read.json(str(tmp_path / f"out{splits}")).collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert kept[0] == kept[1] == kept[2] and kept[0] and orders[0] == orders[1] == orders[2]
    assert [o[2] for o in orders[0]] == ["a.jsonl"] * 36 + ["b.jsonl"] * 36 and set(kept[0]) <= {f"{i:04d}" for i in range(31, 41)}


def test_line_numbers_of_any_separator(spark, tmp_path):
    (tmp_path / "t.txt").write_text("".join(f"row {i};;" for i in range(500)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("64", "1000", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = sorted((r["line"], r["value"]) for r in lines.numbered(spark, str(tmp_path / "t.txt"), ";;").collect())
        assert got == [(i, f"row {i}") for i in range(500)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_joined_file(spark, tmp_path):
    to = str(tmp_path / "out" / "whole.txt")
    rows = spark.range(0, 1000, 1, 7).select(F.col("id").cast("string"))
    for head in ("first\n", "again\n"):  # a file that is there is replaced
        joined.write(rows, to, head=head, tail="\nend", between=",")
        assert Path(to).read_text() == head + ",".join(map(str, range(1000))) + "\nend"
    joined.write(rows.limit(0), to, head="[", tail="]")
    assert Path(to).read_text() == "[]" and [p.name for p in (tmp_path / "out").iterdir()] == ["whole.txt"]
    with pytest.raises(Exception):  # a failed write leaves the file and no parts
        joined.write(rows.select(F.raise_error("no").cast("string")), to)
    assert Path(to).read_text() == "[]" and [p.name for p in (tmp_path / "out").iterdir()] == ["whole.txt"]


def results(spark, n):
    rows = [(i, f"p{i}", f"c{i % 3}", "easy", i % 4 == 0, "" if i % 4 == 0 else 'bad "x"\n    {' + str(i), i / 8, None if i % 5 == 0 else "é\n    {\"a\": [1]},") for i in range(n)]
    return spark.createDataFrame(rows, "seq long, " + schemas.RESULT).repartition(5)


def test_run_document_in_any_layout(spark, tmp_path):
    """Ours, an indented dump and a compact one give the same rows; ours is read by a plain JSON parser."""
    df = results(spark, 200)
    ours = tmp_path / "t_results.json"
    jsonl.write_run(df, str(ours), "t", 'mo"del')
    whole = json.loads(ours.read_text())
    assert (whole["tag"], whole["model"], whole["total"], whole["passed"]) == ("t", 'mo"del', 200, 50)
    assert [r["id"] for r in whole["results"]] == [f"p{i}" for i in range(200)]
    (tmp_path / "indented.json").write_text(json.dumps(whole, indent=2))
    (tmp_path / "compact.json").write_text(json.dumps(whole))
    want = [("t", 'mo"del', r["seq"], *list(r.asDict().values())[1:]) for r in df.orderBy("seq").collect()]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    for name in ("t_results.json", "indented.json", "compact.json"):
        got = sorted(map(tuple, jsonl.read_run(spark, str(tmp_path / name)).collect()), key=lambda r: r[2])
        assert got == want, name
        assert tuple(jsonl.read_run_head(spark, str(tmp_path / name)).first()) == ("t", 'mo"del', 200, 50)
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    jsonl.write_run(df.limit(0), str(ours), "t", "m")
    assert json.loads(ours.read_text())["results"] == [] and jsonl.read_run(spark, str(ours)).count() == 0


def test_report_is_written_in_order(spark, tmp_path):
    """The whole report as one file, against a plain program's; ties of decimals go to the even digit of the exact value."""
    df = results(spark, 120)
    rows = sorted(df.collect(), key=lambda r: r["seq"])
    want = ["T", "=" * 50, "Model  : m", "Tag    : t", "", f"Overall pass@1 : 30/120 ({30 / 120 * 100:.1f}%)", "", "By category:"]
    for c in ("c0", "c1", "c2"):
        own = [r["passed"] for r in rows if r["category"] == c]
        want.append(f"  {c:<20} {sum(own)}/{len(own)}  ({sum(own) / len(own) * 100:.0f}%)")
    want += ["", "Per-problem results:"]
    for r in rows:
        want.append(f"  [{'PASS' if r['passed'] else 'FAIL'}] {r['id']:<15} ({r['category']}) {r['latency_s']:.1f}s")
        want += [f"         ↳ {r['error'][:120]}"] if not r["passed"] else []
    report = reports.evaluation(df, "t", "m", "T")
    reports.write(report, str(tmp_path / "report.txt"))
    assert (tmp_path / "report.txt").read_text() == "\n".join(want) == reports.text(report)
    assert [tuple(r) for r in reports.numbered(report).orderBy("line_no").collect()] == [(i, x.rstrip(" ")) for i, x in enumerate(want)]


def test_numbers_are_taken_while_writing(spark):
    df, n = runtime.counted(spark.range(100), "x", all=F.count(F.lit(1)), odd=F.count_if(F.col("id") % 2 == 1))
    assert df.count() == 100 and n == {"all": 100, "odd": 50}


def alive(mark):
    """Processes whose command line holds the mark."""
    found = []
    for p in Path("/proc").glob("[0-9]*/cmdline"):
        try:
            found += [p] if mark in p.read_bytes().decode(errors="replace").replace("\0", " ") else []
        except OSError:
            pass
    return found


def test_forking_checker_is_gone_after_its_limit(tmp_path):
    mark = f"9{time.time_ns() % 10**6}"
    check = compiling.command_checker(["sh", "-c", f"sleep 3{mark} & sleep 4{mark}"], "x.c", seconds=1)
    with pytest.raises(subprocess.TimeoutExpired):
        check("int x;")
    # one that ends, while its child holds its output open, neither waits nor leaves the child
    start = time.time()
    assert compiling.command_checker(["sh", "-c", f"echo said; sleep 5{mark} & exit 3"], "x.c", seconds=30)("int x;") == (False, "said\n")
    assert time.time() - start < 10
    time.sleep(0.2)
    assert not [p for n in "345" for p in alive(f"sleep {n}{mark}")]


def test_compilers_run_the_four_command_lines(spark, tmp_path, monkeypatch):
    """Stub tools note their arguments, folder and files; cargo's build folder is one copy, used by one check at a time."""
    tools, seen, templates = tmp_path / "bin", tmp_path / "seen", tmp_path / "templates"
    tools.mkdir()
    seen.mkdir()
    for tool in ("cargo", "go", "clang"):
        stub = f"""#!/bin/sh
f={seen}/{tool}-$$
printf '%s|' "$@" > $f
ls -A . >> $f
case "$*" in *--target-dir*) for a; do [ "$p" = --target-dir ] && d=$a; p=$a; done; mkdir $d/lock || echo collision >> $f; ls $d >> $f; sleep 0.1; rmdir $d/lock;; esac
cat src/main.rs main.go prog.bpf.c 2>/dev/null | grep -q good && exit 0
printf out; printf 'error: panic_handler %0700d' 0 >&2; exit 1
"""
        (tools / tool).write_text(stub)
        (tools / tool).chmod(0o755)
    monkeypatch.setenv("PATH", f"{tools}:/usr/bin:/bin")
    for k, files in {"aya_kernel": ["Cargo.toml", ".cargo/config.toml", "target/warm"], "aya_user": ["Cargo.toml", "Cargo.lock", "target/warm"], "cilium_go": ["go.mod", "other"], "libbpf_c": ["vmlinux.h"]}.items():
        for f in files:
            (templates / k / f).parent.mkdir(parents=True, exist_ok=True)
            (templates / k / f).write_text("x")
    checkers = compiling.compilers(str(templates))
    for k, c in checkers.items():
        assert c("good") == (True, "")
        assert c("bad") == (False, ("out" + "error: panic_handler " + "0" * 700)[:600]), k  # a missing panic handler alone fails as well
    notes = sorted(p.read_text() for p in seen.iterdir())

    def target(k):
        with compiling.cache(f"{templates}/{k}/target") as folder:
            return folder

    kernel = f"+nightly|check|-Z|build-std=core|--target|bpfel-unknown-none|--target-dir|{target('aya_kernel')}|--message-format|short|.cargo\nCargo.toml\nsrc\nlock\nwarm\n"
    user = f"check|--target-dir|{target('aya_user')}|--message-format|short|Cargo.lock\nCargo.toml\nsrc\nlock\nwarm\n"
    assert notes.count(kernel) == 2 and notes.count(user) == 2
    assert sum(n.startswith("mod|tidy|go.mod\nmain.go") for n in notes) == 2 and sum(n.startswith("build|./...|go.mod\nmain.go") for n in notes) == 2
    clang = [n for n in notes if n.startswith("-target|bpf|-O2|-g|-I/")]
    assert len(clang) == 2 and all("|-I/usr/include/bpf|-I/usr/include/linux|-I/usr/include/aarch64-linux-gnu|-c|/" in n and n.endswith("prog.bpf.c\nvmlinux.h\n") for n in clang)
    rows = [(str(i), "aya_user", "easy", "compile", "p", None, None, "good" if i % 2 else "bad", 0.5) for i in range(8)]
    df = spark.createDataFrame(rows, schemas.PROBLEM + ", answer string, latency_s double")
    monkeypatch.setattr(compiling, "COMMANDS", {k: [str(tools / c[0]), *c[1:]] for k, c in compiling.COMMANDS.items()})  # workers have a PATH of their own
    checkers = compiling.compilers(str(templates))
    got = evaluate.checked(df, checkers, log=str(tmp_path / "log")).collect()
    assert sorted((int(r["id"]), r["passed"]) for r in got) == [(i, i % 2 == 1) for i in range(8)]
    assert not any("collision" in p.read_text() for p in seen.iterdir())
    n = len(list(seen.iterdir()))
    assert evaluate.checked(df, checkers, log=str(tmp_path / "log")).count() == 8 and len(list(seen.iterdir())) == n  # nothing is compiled again


def test_quick_answers_do_not_make_a_file_each(spark, tmp_path):
    """200 quick calls, one at a time, leave a few files in the log; a second run asks nothing."""
    asked = tmp_path / "asked"
    asked.mkdir()

    def one(row):
        (asked / str(row["id"])).write_text("")
        return [(row["id"], "x")]

    log = tmp_path / "log"
    assert calls.called(spark.range(200), one, "i long, x string", calls=1, log=str(log)).count() == 200
    files = [p for p in log.rglob("*") if p.is_file() and not p.name.endswith(".crc")]
    assert len(files) <= 20 and not any(p.name.endswith(".journal") for p in files)
    for p in asked.iterdir():
        p.unlink()
    assert sorted(r.i for r in calls.called(spark.range(200), one, "i long, x string", calls=1, log=str(log)).collect()) == list(range(200))
    assert not list(asked.iterdir())


def test_checks_at_once_have_build_folders_of_their_own(tmp_path, monkeypatch):
    monkeypatch.setattr("tempfile.tempdir", str(tmp_path))
    monkeypatch.setattr("os.cpu_count", lambda: 2)
    with compiling.cache("t") as a, compiling.cache("t") as b:
        assert a != b
    with compiling.cache("t") as c:
        assert c == a


def test_asking_takes_all_tasks(spark):
    problems = spark.createDataFrame([(str(i), "p") for i in range(40)], "id string, prompt string")

    def provider(system, message, temperature):
        from pyspark import TaskContext

        return str(TaskContext.get().partitionId())

    assert evaluate.asked(problems, provider, "s").select("answer").distinct().count() > 1
    assert evaluate.asked(problems, provider, "s", at_once=1).select("answer").distinct().count() == 1


def test_small_splits_share_tasks(spark, tmp_path, monkeypatch):
    """Line numbers hold, and tasks are few, where a file has many more splits than tasks."""
    from corpusloom.sources import lines

    monkeypatch.setattr(lines, "MOST_TASKS", 3)
    (tmp_path / "a.txt").write_text("\n".join(f"{i} {'x' * (i % 50)}" for i in range(2000)))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        found = lines.numbered(spark, str(tmp_path / "a.txt"))
        assert spark.read.text(str(tmp_path / "a.txt")).rdd.getNumPartitions() > 30 and found.rdd.getNumPartitions() <= 3
        assert all(r["value"].split(" ")[0] == str(r["line"]) for r in found.collect()) and found.count() == 2000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
