"""Files, JSON Lines, chunkers, streaming and commands."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom import cli, schemas
from corpusloom.operators import chunkers, generate
from corpusloom.sources import files, jsonl
from corpusloom.streaming import resume


def test_path_filter(spark):
    paths = {"a/vendor/x.c": True, "README.md": True, "a/Code-of-Conduct.MD": True, "vendor.c": False, "docs/guide.md": False, ".md": False, "a/readme": False}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r["p"]: r["s"] for r in df.select("p", files.skipped(F.col("p")).alias("s")).collect()} == paths


def test_scan_decodes_and_routes(spark, tmp_path):
    def put(name, data):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)

    put("aya/a.rs", b"use aya::x;\r\nfn main() {\xff}\r\nfn other_name() { let xyz = 12345; }\n")
    put("aya/b.c", b"SEC(")
    put("aya/vendor/c.rs", b"use aya::x;")
    put("aya/guide.md", b"about bpf\n# One\n" + b"text " * 30)
    put("linux-bpf-docs/d.rst", b"bpf docs\n\nTitle\n=====\n\n" + b"words " * 30)
    put("unknown/e.rs", b"use aya::x;")
    got = files.scanned(spark, str(tmp_path), files.repositories(spark))
    rows = {r["file"]: r for r in got.collect()}
    assert set(rows) == {"aya/a.rs", "aya/guide.md", "linux-bpf-docs/d.rst"}
    assert "�" in rows["aya/a.rs"]["text"] and "\r" not in rows["aya/a.rs"]["text"]
    chunks = chunkers.chunked(got).collect()
    assert {(c["kind"], c["title"]) for c in chunks} >= {("tutorial_section", "One"), ("tutorial_section", "Title"), ("raw_code", "other_name")}
    out = tmp_path / "chunks"
    assert "aya" in cli.main(["extract", str(tmp_path), str(out)])
    assert spark.read.schema(schemas.CHUNK).json(str(out)).count() == len(chunks)


def test_markdown_edges():
    code = "```C\n" + "x" * 30 + "\n```"
    text = f"preamble\n# A\n{'b' * 80}\n##### no heading\n# A\nshort\n{code}\n# C\nshort\n```\n# inside {'y' * 30}\n```\n"
    got = list(chunkers.markdown(text, "the-file"))
    assert [c.title for c in got] == ["A", "A"] or [c.title for c in got][:2] == ["A", "A"]
    assert got[0].key == got[1].key == "A_0" and got[1].code == ("x" * 30,)
    whole = list(chunkers.markdown("w" * 90, "my-long_name"))
    assert whole[0].title == "My Long Name" and whole[0].key == "full_0"
    assert not list(chunkers.markdown("# A\nshort", "f"))


def test_parts(spark):
    para = "p" * 1500
    assert chunkers.parts("x" * 4000) == ["x" * 4000]
    assert chunkers.parts("") == [""]
    assert chunkers.parts("y" * 5000) == ["y" * 5000]
    texts = ["", "x" * 4000, "\n\n".join([para] * 5), "y" * 5000 + "\n\nz", "\n\n".join(["a" * 2000, "b" * 2000, "c"])]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r["p"] for r in df.select(chunkers.parts_column(F.col("t")).alias("p")).collect()] == [chunkers.parts(t) for t in texts]


def test_balanced():
    assert chunkers.balanced("x{a{b}c}d", 1) == "{a{b}c}"
    assert chunkers.balanced("{" + "a" * 3000 + "}", 0) == "{" + "a" * 599
    assert chunkers.balanced("abc", -1) == "c"
    assert chunkers.balanced("a}b{c}", 1) == "}b{c}"[:600]


def test_code_chunkers():
    rust = "/// Doc one.\n#[inline]\npub fn alpha(x: u32) -> u32 { x + 1 + 2 + 3 }\n/// Doc two.\npub struct Beta<T> { field_name: T, other: u8 }\n/// Again.\nfn alpha(y: u32) -> u32 { y + 100 + 200 }\nfn bare() { let a = 1; let b = 2; }\n"
    got = list(chunkers.rust(rust, "f"))
    assert [(c.title, c.kind, c.body) for c in got] == [("alpha", "doc_code", "Doc one."), ("Beta", "doc_code", "Doc two.")]
    assert got[0].code[0].startswith("fn alpha(x: u32) -> u32 {\n{ x + 1")
    bare = list(chunkers.rust("pub fn only_bare(x: u32) { let a = x; }\nfn no_brace(x: u32);", "f"))
    assert bare[0].kind == "raw_code" and bare[0].code[0].startswith("pub fn only_bare(\n{ let a")
    c = "/** Adds * two. */\nint add(int a, int b) { return a + b + 0; }\nint add(int a, int b) { return a; }\nstatic void other(void) { do_something_long(1, 2); }\n"
    assert [(x.title, x.kind) for x in chunkers.c(c, "f")] == [("add", "doc_code"), ("other", "raw_code")]
    go = "// Run runs.\n// Twice.\nfunc (s *S) Run(n int) error { return s.x(n) }\nfunc Bare() {}\n"
    got = list(chunkers.go(go, "f"))
    assert [(x.title, x.body) for x in got] == [("func", "Run runs.\nTwice.")] and got[0].code[0].startswith("func (s *S) Run(n int) error {\n{ return")
    assert list(chunkers.python("z" * 5000, "tool"))[0].code == ("z" * 3000,)


def test_rst():
    code = "   int long_enough_code_line = 12345;\n"
    text = f"Title\n=====\n\nSome words::\n\n{code}\n\n.. code-block:: c\n\n{code}\nEnd\n" + "w " * 50
    got = list(chunkers.rst(text, "a_b"))
    assert got[0].title == "Title" and got[0].code == ("int long_enough_code_line = 12345;\n\nEnd",)[:0] or len(got[0].code) == 1
    plain = list(chunkers.rst("w " * 50 + f"::\n\n{code}\n.. code-block::\n\n{code}\n", "a_b"))
    assert plain[0].title == "A B" and len(plain[0].code) >= 1
    assert not list(chunkers.rst("short", "x"))


def test_jsonl(spark, tmp_path):
    p = tmp_path / "in.jsonl"
    p.write_text('{"id": "a", "category": "x"}\n\n{bad\n{"id": "b", "category": "y"}\n')
    schema = "id string, category string"
    rows = jsonl.read_tolerant(spark, str(p), schema)
    assert sorted((r["line"], r["id"] or "", r["malformed"] or "") for r in rows.collect()) == [(0, "a", ""), (2, "", "{bad"), (3, "b", "")]
    good = rows.where("malformed is null").select("id", "category")
    assert jsonl.read_silent(spark, str(p), schema).where("id is not null").count() == 2
    with pytest.raises(Exception):
        jsonl.read_strict(spark, str(p), schema).collect()
    jsonl.write(good, str(tmp_path / "out"))
    jsonl.write(good, str(tmp_path / "out"), append=True)
    assert jsonl.read_strict(spark, str(tmp_path / "out"), schema, category="x").count() == 2


def test_run_document_and_commands(spark, tmp_path):
    rows = [("a", "keywords-only", "easy", True, "", 1.25, "ans"), ("b", "other", "hard", False, "bad", 2.0, "ans")]
    for tag, passed in (("one", True), ("two", False)):
        df = spark.createDataFrame([(*r[:3], passed if r[0] == "b" else r[3], *r[4:]) for r in rows], schemas.RESULT)
        jsonl.write_run(df, str(tmp_path / tag), tag, "m")
    assert jsonl.read_run(spark, str(tmp_path / "one")).count() == 2
    assert "REGRESSED: b" in cli.main(["compare", str(tmp_path / "one"), str(tmp_path / "two")])
    problem = {"id": "k", "category": "concept", "difficulty": "easy", "check": "keywords", "prompt": "bpf map xdp", "concepts": [], "keywords": ["bpf", "map", "xdp"]}
    (tmp_path / "p.jsonl").write_text(json.dumps(problem) + "\n")
    report = cli.main(["evaluate", "--tag", "t", "--problems", str(tmp_path / "p.jsonl"), "--out", str(tmp_path / "results")])
    assert "1/1 (100.0%)" in report and (tmp_path / "results" / "t_report.txt").exists()
    talk = [{"from": "human", "value": "what is a bpf map, please?"}, {"from": "gpt", "value": "A bpf map is " + "a word " * 40}]
    (tmp_path / "s.jsonl").write_text("".join(json.dumps({"conversations": talk, "source_chunk_id": str(i), "repo": "r", "style": "concept"}) + "\n" for i in range(2)))
    assert "exact:duplicate_qa" in cli.main(["clean", str(tmp_path / "s.jsonl"), str(tmp_path / "clean")])


def test_streaming_resume(spark, tmp_path):
    def ask(i):
        row = {"id": str(i), "source": "s", "repo": "aya", "file": "f", "lang": "rust", "kind": "raw_code", "title": "t", "body": "", "code": ["c" * 200]}
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(row) + "\n")
        where = [str(tmp_path / x) for x in ("in", "samples", "failures")]
        resume.generation(spark, *where, generate.echo, "sys", str(tmp_path / "state"), tries=1).awaitTermination()
        return sorted(r["source_chunk_id"] for r in resume.samples(spark, where[1], str(tmp_path / "state")).collect())

    assert ask(0) == ["0"]
    assert ask(1) == ["0", "1"]


def test_chunks_leave_a_task_in_pieces(spark, monkeypatch):
    """One Arrow batch of many files: chunks leave the task as soon as they have so many characters."""
    import pyarrow as pa
    from corpusloom.operators import chunkers

    runs = []
    monkeypatch.setattr(chunkers, "RUN_CHARS", 1000)
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, run, schema: runs.append(run) or self.selectExpr(*(f"cast(null AS {t}) AS {n}" for n, t in (f.split() for f in schema.split(", ")))))
    files = spark.range(1).selectExpr("'r' AS repo", "'d.rst' AS path", "'d.rst' AS file", "'rst' AS suffix", "'bpf' AS text", "array('rst') AS langs", "true AS include_md")
    chunkers.chunked(files)
    rows = [{"repo": "r", "path": f"d{i}.rst", "file": "f", "suffix": "rst", "text": "bpf " + "word " * 100} for i in range(300)]
    got = list(runs[0](iter([pa.RecordBatch.from_pylist(rows)])))
    assert sum(b.num_rows for b in got) == 300 and max(b.num_rows for b in got) <= 2
