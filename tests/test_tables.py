"""Table functions in SQL, and prompts from a table."""

import json

import pytest

from corpusloom.functions import tables
from corpusloom.operators import chunkers, prompts


def test_file_chunks(spark):
    tables.register(spark)
    code = "/** Adds * two. */\nint add(int a, int b) { return a + b + 0; }\nint other(int a) { return a; }\n"
    spark.createDataFrame([("c", code, "a/x.c"), ("hpp", code, "x.hpp"), ("txt", code, "x.txt"), ("c", None, "y.c"), (None, code, None)], "suffix string, text string, path string").createOrReplaceTempView("source_files")
    got = spark.sql("SELECT f.path, c.* FROM source_files f, LATERAL file_chunks(f.suffix, f.text, f.path, map('hpp', 'c')) c").collect()
    want = [(x.key, x.kind, x.title, x.body, list(x.code)) for x in chunkers.c(code, "x")]
    for path in ("a/x.c", "x.hpp"):
        assert [(r.key, r.kind, r.title, r.body, r.code) for r in sorted(got, key=lambda r: r.place) if r.path == path] == want
    assert {r.path for r in got} == {"a/x.c", "x.hpp"}
    rust = "/// A point.\npub struct Point { x: u32, yy: u32, zzz: u32 }\n"
    bare = "pub fn only_bare(x: u32) { let a = x; let b = a + 1; }\n"
    assert [r.kind for r in spark.sql("SELECT * FROM file_chunks('rs', {a}, 'p.rs') UNION ALL SELECT * FROM file_chunks('rs', {b}, 'q.rs')", a=rust, b=bare).collect()] == ["doc_code", "raw_code"]
    with pytest.raises(Exception, match="no parser for cobol"):
        spark.sql("SELECT c.* FROM source_files f, LATERAL file_chunks(f.suffix, f.text, f.path, map('cob', 'cobol')) c")
    with pytest.raises(Exception, match="text must be StringType"):
        spark.sql("SELECT c.* FROM LATERAL file_chunks('c', 1, 'x') c")


def test_chunk_prompts_are_the_native_ones(spark):
    tables.register(spark)
    rows = [(str(i), repo, "c", kind, "T {body} %s", body, code) for i, (repo, kind, body, code) in enumerate((r, k, b, c) for r in ("aya", "none", None) for k in ("tutorial_section", "doc_code", "raw_code", None) for b in (None, "", "  text {title} " * 30) for c in (None, [], [None], ["int x;" * 300, "y"]))]
    df = spark.createDataFrame(rows, "id string, repo string, lang string, kind string, title string, body string, code array<string>")
    df.createOrReplaceTempView("some_chunks")
    ours = spark.sql("SELECT c.id, p.* FROM some_chunks c, LATERAL chunk_prompts(c.kind, c.repo, c.lang, c.title, c.body, c.code) p").collect()
    native = prompts.expanded(df).select("id", "prompt_no", "instruction", "style", "context").collect()
    assert sorted(map(tuple, ours)) == sorted(map(tuple, native)) and len(ours) > 20


def test_prompt_table_is_a_parameter(spark):
    tables.register(spark)
    own = [prompts.Prompt("doc_code", "body", "summary", "Sum up {title}{using}: {{{body:3}}}"), prompts.Prompt("doc_code", "code", "again", "{code:2}", "{lang}")]
    df = spark.createDataFrame([("1", "aya", "c", "doc_code", "T", "abcdef" * 40, ["int"])], "id string, repo string, lang string, kind string, title string, body string, code array<string>")
    want = [(0, "Sum up T using the aya Rust eBPF framework: {abc}", "summary", ""), (1, "in", "again", "c")]
    assert [tuple(r) for r in prompts.expanded(df, prompts=own).select("prompt_no", "instruction", "style", "context").orderBy("prompt_no").collect()] == want
    table = json.dumps([vars(p) for p in own])
    got = spark.sql("SELECT p.* FROM {df} c, LATERAL chunk_prompts(c.kind, c.repo, c.lang, c.title, c.body, c.code, {table}) p ORDER BY prompt_no", df=df, table=table).collect()
    assert [tuple(r) for r in got] == want
    bad = json.dumps([{"kind": "k", "needs": "body", "style": "s", "instruction": "{nothing}"}])
    with pytest.raises(Exception, match="no such field"):
        spark.sql("SELECT * FROM chunk_prompts('k', 'r', 'c', 't', 'b', array('c'), {table})", table=bad)
    with pytest.raises(ValueError):
        prompts.checked([prompts.Prompt("k", "title", "s", "x")])
