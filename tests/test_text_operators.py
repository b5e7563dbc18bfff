"""Edge rows of the quality rules, deduplication, prompts and evaluation."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.functions import text
from corpusloom.operators import compiling, dedup, evaluate, generate, prompts, quality
from corpusloom.plans import clean, reports

GOOD = "the bpf map " + "word " * 40


def reasons(spark, rows):
    df = spark.createDataFrame([(i, q, a) for i, (q, a) in enumerate(rows)], "seq long, question string, answer string")
    return [r["reason"] for r in quality.checked(df).orderBy("seq").collect()]


def test_quality_rules_in_order(spark):
    q = "a question of 20 chr"
    assert len(q) == 20
    rows = [(q[:19], GOOD), (q, "x" * 149), (q, "w" * 5 + " w" * 28 + " " * 0 + "x" * 150), (q, "bpf " + "w " * 4500), (q, "Sorry, " + GOOD), (q, "I can't " + GOOD), (q, GOOD + "..."), (q, GOOD + "To Be Continued"), (q, "w " * 100), (q, GOOD), (None, None), (q, "...\n" + GOOD)]
    assert reasons(spark, rows) == ["question_too_short", "answer_too_short", "answer_too_few_words", "answer_too_long", "bad_answer_pattern", "bad_answer_pattern", "incomplete_answer", "incomplete_answer", "no_ebpf_signal", None, "question_too_short", None]


def test_strip_and_words_follow_python(spark):
    values = ["", "  ", " a\u001cb \n", "x y", "a\n", "\x1f"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = df.select(text.strip("v").alias("s"), text.n_words("v").alias("n")).collect()
    assert [(r["s"], r["n"]) for r in got] == [(v.strip(), len(v.split())) for v in values]


def test_exact_dedup_edges(spark):
    rows = [("q", "a1"), ("q", "a2"), ("q", "a2"), ("q", "a1"), ("Q ", "a1"), ("other", "a1")]
    df = spark.createDataFrame([(i, q, a, 1) for i, (q, a) in enumerate(rows)], "seq long, question string, answer string, pair_hash int")
    got = [r["dup_reason"] for r in dedup.exact_reasons(df).orderBy("seq").collect()]
    assert got == [None, "duplicate_question", "duplicate_question", "duplicate_qa", "duplicate_question", None]


def brute_dropped(signed):
    rows = [(r["seq"], r["signature"]) for r in signed]
    return {j for j, y in rows for i, x in rows if i > j and sum(a == b for a, b in zip(x, y)) >= 109}


@pytest.mark.parametrize("parts", [1, 5])
def test_near_dedup_is_the_brute_force_set(spark, parts):
    draw = random.Random(3)
    base = ["".join(draw.choices("abcdefgh ", k=120)) for _ in range(6)]
    texts = [t[:k] + "".join(draw.choices("xyz", k=draw.randint(0, 3))) + t[k:] for t in base for k in draw.choices(range(120), k=8)] + ["", "ab", "cd", base[0], base[0]]
    draw.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, text string").repartition(parts)
    signed = dedup.signatures(df, "text").cache()
    got = {r["seq"] for r in dedup.near_dropped(signed).collect()}
    assert got == brute_dropped(signed.collect()) and got
    assert dedup.near_deduplicated(df, "text").count() == len(texts) - len(got)


def test_threshold_is_109_of_128(spark):
    one = list(range(128))
    rows = [(0, one), (1, one[:108] + [-1] * 20), (2, [-2] * 20 + one[20:108] + [-2] * 20), (3, one[:109] + [-3] * 19)]
    df = spark.createDataFrame(rows, "seq long, signature array<long>")
    assert {(r["i"], r["j"]) for r in dedup.near_pairs(df).collect()} == {(3, 0)}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "seq long, question string, answer string, repo string, style string")
    kept, drops = clean.steps(df)
    assert kept.count() == 0 and drops.count() == 0
    assert "FINAL DATASET: 0" in reports.text(reports.cleaning(0, 0, kept, drops))
    none = spark.createDataFrame([], schemas.RESULT)
    assert evaluate.overall(none).first()["pct"] is None
    assert "0/0 (-)" in reports.text(reports.evaluation(none, "t", "m"))


def chunk(i, kind, body, code, repo="aya"):
    return (str(i), "s", repo, "f", "rust", kind, "T", body, code)


def test_prompts_by_kind(spark):
    long = "b" * 200
    rows = [chunk(0, "tutorial_section", long, []), chunk(1, "tutorial_section", long, ["c"]), chunk(2, "doc_code", "", [long], "none"), chunk(3, "doc_code", long, []), chunk(4, "raw_code", "", [long]), chunk(5, "raw_code", "b", ["c"]), chunk(6, "tutorial_section", " " * 200, [])]
    got = prompts.expanded(spark.createDataFrame(rows, schemas.CHUNK)).orderBy("id", "prompt_no").collect()
    assert [(r["id"], r["style"]) for r in got] == [("0", "concept"), ("1", "concept"), ("1", "code_walkthrough"), ("2", "api_explain"), ("2", "usage_example"), ("4", "code_analysis")]
    assert "in eBPF and show" in got[3]["instruction"] and got[3]["temperature"] == 0.4
    assert got[0]["message"] == long + "\n\n---\n\n" + got[0]["instruction"]


def test_generation_stops_at_the_first_failure_and_resumes(spark):
    def provider(system, message, temperature):
        if "Walk me" in message or "other" in message:
            raise RuntimeError("down")
        return "<think>hm</think>" + "an answer of more than forty characters, surely"

    rows = [chunk(0, "tutorial_section", "b" * 200, ["c" * 40]), chunk(1, "raw_code", "", ["other" * 40])]
    chunks = spark.createDataFrame(rows, schemas.CHUNK)
    answers = generate.generated(prompts.expanded(chunks), provider, "sys", tries=2, delay=0).cache()
    made, failed = generate.samples(answers, "sys"), generate.failures(answers)
    assert [(r["source_chunk_id"], r["style"]) for r in made.collect()] == [("0", "concept")]
    assert {(r["chunk_id"], r["error"]) for r in failed.collect()} == {("0", "down"), ("1", "down")}
    assert [r["id"] for r in generate.pending(chunks, made).collect()] == ["1"]
    assert made.first()["conversations"][2]["value"].startswith("an answer")


def test_short_answers_fail():
    with pytest.raises(ValueError):
        generate.answered(lambda *_: "<think>x</think>" + "y" * 39, "", "", 0.5, tries=1)
    assert generate.answered(lambda *_: "y" * 40, "", "", 0.5, tries=1)


def test_answer_cleanup(spark):
    values = ["<think>a\nb</think> x", "<think>open", "```py\ncode\n```", "say ```x``` no", "```a```"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r["x"] for r in df.select(text.without_fences(text.without_thoughts("v")).alias("x")).collect()]
    assert got == ["x", "<think>open", "code", "say ```x``` no", ""]


def test_keyword_requirements(spark):
    words = [f"k{i}" for i in range(11)]
    rows = [("K0 k1", words[:2]), ("k0 k1 k2", words[:3]), ("k0 k1 k2", words[:8]), ("k0 k1 k2 k3 k4", words), ("x", None), ("x", [])]
    df = spark.createDataFrame(rows, "answer string, keywords array<string>")
    got = df.select(*(c.alias(k) for k, c in evaluate.keyword_columns(F.col("answer"), F.col("keywords")).items())).collect()
    assert [(r["n_required"], r["passed"]) for r in got] == [(3, False), (3, True), (4, False), (5, True), (3, False), (3, False)]
    assert got[2]["detail"] == "Found 3/8 keywords. Missing: ['k3', 'k4', 'k5', 'k6', 'k7']"


def test_checks_and_comparison(spark, tmp_path):
    problems = spark.createDataFrame([("k", "concept", "easy", "keywords", "p", None, ["bpf", "map", "xdp"]), ("c", "own", "easy", "compile", "p", None, None), ("u", "none", "easy", "compile", "p", None, None)], schemas.PROBLEM)
    asked = evaluate.asked(problems, lambda s, m, t: "```c\nbpf map xdp\n```", "s")
    ok = compiling.command_checker(["grep", "-q", "bpf", "{dir}/code.c"], "code.c")
    results = evaluate.checked(asked, {"own": ok}).cache()
    got = {r["id"]: (r["passed"], r["error"]) for r in results.collect()}
    assert got["k"][0] and got["c"] == (True, "") and got["u"] == (False, "Unknown category: none")
    a = spark.createDataFrame([("x", True), ("y", False), ("z", False), ("o", True)], "id string, passed boolean")
    b = spark.createDataFrame([("x", False), ("y", True), ("z", False), ("n", True)], "id string, passed boolean")
    assert {r["id"]: r["outcome"] for r in evaluate.compared(a, b).collect()} == {"x": "regressed", "y": "improved", "z": "unchanged", "o": "regressed"}
    r = evaluate.comparison(a, b).first()
    assert (r["total"], r["passed_a"], r["passed_b"], r["improved"], r["regressed"], r["unchanged"]) == (4, 2, 2, 1, 2, 1)
    assert "IMPROVED : y" in reports.text(reports.comparison(a, b, "A", "B"))


def test_failing_provider_is_an_answer(spark):
    def down(s, m, t):
        raise OSError("no route")

    problems = spark.createDataFrame([("c", "own", "easy", "compile", "p", None, None)], schemas.PROBLEM)
    assert evaluate.asked(problems, down, "s").first()["answer"] == "ERROR: no route"


def test_evaluate_checks_asks_once(spark, monkeypatch):
    """Two kinds of check read the answers, so these are written before."""
    from corpusloom import runtime
    from corpusloom.plans import source_catalogue

    names, written = [], runtime.written
    monkeypatch.setattr(runtime, "written", lambda df, name: names.append(name) or written(df, name))
    assert source_catalogue.evaluate_checks(spark, "/root/testdata/sf0.001").count() > 100
    assert names == ["asked"]


def test_quick_gates_are_the_gates(spark):
    """Both forms of each gate on words and parts of words, whole and cut, in both cases, with letters that fold to k and s."""
    import random

    from corpusloom.functions import signals
    from pyspark.sql import functions as F

    parts = [x for p in set(signals.GATES.values()) for x in re.sub(r"\(\?\w+\)|\\[bs][+*]?|\\|[()\[\]]", " ", p).replace("|", " ").split()]
    draw = random.Random(1)
    made = parts + ["".join(draw.choice([*parts, *" \n_-.(#éKſ‍1", "SEC (", "b = BPF (", "NewReader x ringbuf"]) for _ in range(draw.randint(1, 5))) for _ in range(4000)]
    made += [x.upper() for x in made] + [x.replace("k", "K").replace("s", "ſ") for x in made]
    df = spark.createDataFrame([(x,) for x in made], "t string")
    got = df.agg(*(F.count_if(F.col("t").rlike(g) != F.col("t").rlike(signals.QUICK_GATES[s])).alias(s) for s, g in signals.GATES.items()), *(F.count_if(F.col("t").rlike(g)).alias(f"n_{s}") for s, g in signals.GATES.items())).first()
    assert all(got[s] == 0 and got[f"n_{s}"] > 20 for s in signals.GATES)
    assert set(signals.QUICK_GATES) == set(signals.GATES) and all(signals.QUICK_GATES[s] != g for s, g in signals.GATES.items())


def test_each_shingle_is_permuted_once(monkeypatch):
    import numpy as np
    from corpusloom.operators import dedup

    sizes, permuted = [], dedup.permuted
    monkeypatch.setattr(dedup, "permuted", lambda h: sizes.append(len(h)) or permuted(h))
    texts = ["abcdefgh" * 3, "", "abcdefgh" * 3, "abcdefgz", "abcd"]
    of, gram, grams = dedup.shingles(texts)
    hashed = np.array([dedup.Hashed()[g] for g in grams], np.int64)
    got = dedup.minima(of, gram, hashed, len(texts))
    a, b = dedup.permutations()
    for i in range(len(texts)):
        own = [int(hashed[g]) for g in gram[of == i]]
        assert got[i].tolist() == [min((int(x) * h + int(y)) % dedup.PRIME for h in own) if own else 0 for x, y in zip(a, b)]
    assert sizes == [len(set(grams))]


def shuffled(spark, job):
    """Bytes that the stages of job wrote for shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    java, quantiles = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = lambda: java.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, quantiles, None))
    before = {s.stageId() for s in stages()}
    got = job()
    return got, sum(s.shuffleWriteBytes() for s in stages() if s.stageId() not in before)


def test_near_dedup_shuffles_few_bytes_a_row(spark):
    """Rows that share keys by chance, and match none, go to tasks without their signatures (512 bytes for each of 20 keys)."""
    draw = random.Random(5)
    values = [draw.choices(range(1 << 31), k=3) for _ in range(128)]
    rows = [(i, [draw.choice(v) for v in values]) for i in range(3000)]
    signed = spark.createDataFrame(rows, "seq long, signature array<long>").cache()
    signed.count()
    got, n = shuffled(spark, lambda: dedup.near_dropped(signed).collect())
    assert not got and n < 2600 * len(rows)


@pytest.mark.parametrize("block, small", [(8192, 32), (7, 3)])
def test_near_dedup_tells_108_from_109_places(spark, monkeypatch, block, small):
    """Places that agree in their low bits only, in small tasks, in large ones and between blocks."""
    monkeypatch.setattr(dedup, "BLOCK", block)
    monkeypatch.setattr(dedup, "SMALL", small)
    draw, rows = random.Random(8), []
    for _ in range(4):
        one = draw.choices(range(1 << 20), k=128)
        for n in [0, *draw.choices([17, 18, 19, 20, 20, 21, 22], k=60)]:
            at = set(draw.sample(range(draw.choice([22, 128])), n))
            rows.append([x + (draw.randint(1, 1 << 20) << draw.choice([0, 4, 8])) * (i in at) for i, x in enumerate(one)])
    draw.shuffle(rows)
    signed = spark.createDataFrame(list(enumerate(rows)), "seq long, signature array<long>").repartition(3).cache()
    brute = [(i, j, n) for i, x in enumerate(rows) for j, y in enumerate(rows[:i]) if (n := sum(a == b for a, b in zip(x, y))) >= 109]
    assert {r["seq"] for r in dedup.near_dropped(signed).collect()} == {j for _, j, _ in brute}
    assert sorted(map(tuple, dedup.near_pairs(signed).collect())) == sorted(brute) and brute
