"""Large clusters of near-duplicate candidates: boilerplate without links, families with links, all against brute force."""

import random
import subprocess
import sys
from pathlib import Path

import pytest
from corpusloom import runtime
from corpusloom.llm import superminhash


def texts_with_boilerplate(n, own, shared, seed=1):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefghij", k=5))
    common = [word() for _ in range(shared)]
    return [" ".join([word() for _ in range(own)] + common) for _ in range(n)]


def brute(texts, k, percent):
    sets = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if 100 * both >= percent * (len(x) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("group", [2, 64])
def test_parted_clusters_are_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(superminhash, "CLUSTER", 8)
    monkeypatch.setattr(superminhash, "GROUP", group)
    draw = random.Random(4)
    texts = texts_with_boilerplate(60, 30, 40)
    for i in range(90):  # near copies, some below the threshold, and copies of copies
        w = draw.choice(texts[:20] + texts[60:]).split()
        for _ in range(draw.choice((1, 2, 3, 6))):
            w[draw.randrange(len(w))] = f"new{i}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in superminhash.grouped(df, 3, 85).collect()}
    want = brute(texts, 3, 85)
    assert [got[i] for i in range(len(texts))] == want and 20 < len(set(want)) < 140


def test_boilerplate_is_no_cluster(spark, monkeypatch):
    """Texts that chain by chance candidates are parted without a comparison of each with each."""
    met = []
    blocks = superminhash._in_blocks
    monkeypatch.setattr(superminhash, "_in_blocks", lambda *a: met.append(1) or blocks(*a))
    df = spark.createDataFrame(list(enumerate(texts_with_boilerplate(1200, 60, 70))), "doc_id long, text string")
    assert superminhash.grouped(df, 5, 80).where("kept").count() == 1200
    assert not met


def test_a_task_needs_one_worker(spark, monkeypatch):
    """No task hands rows from one Python worker to another: each that did would keep a second one alive, beside the JVM."""
    monkeypatch.setattr(superminhash, "CLUSTER", 8)
    monkeypatch.setattr(superminhash, "FOREST", 4, raising=False)
    plans = []
    written = runtime.written
    monkeypatch.setattr(runtime, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan()) or written(df, name))
    texts = texts_with_boilerplate(30, 30, 40) * 2
    texts += [x.rsplit(" ", 1)[0] + f" new{i}" for i, x in enumerate(texts[:25] * 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def workers(node):
        below = [workers(node.children().apply(i)) for i in range(node.children().size())]
        own = max(below, default=0) + ("InArrow" in node.nodeName())
        assert own < 2, node.treeString()
        return 0 if "Exchange" in node.nodeName() else own

    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else a plan shows its stages only after it ran
    try:
        whole = superminhash.grouped(df, 3, 85)
        plans.append(whole._jdf.queryExecution().executedPlan())
        got = {r["doc_id"]: r["component_id"] for r in whole.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert [got[i] for i in range(len(texts))] == brute(texts, 3, 85)
    for plan in plans:
        workers(plan)


_IDLE = """
import re, sys
from pathlib import Path
sys.path.insert(0, {root!r})
import numpy as np
from corpusloom.llm import arrays
resident = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", Path("/proc/self/status").read_text())[1]) // 1024
last = []
def run(batches):
    held = [np.ones(100_000, np.uint8) for _ in range(1000)]
    last.append(held[-1])  # what lies below the last piece stays with the process by itself
    yield from batches
before = resident()
assert list(run([1])) == [1] and resident() > before + 60
assert list(arrays.released(run)([1, 2])) == [1, 2] and resident() < before + 30
"""


def test_an_idle_worker_gives_free_memory_back():
    """In a process of its own: what others left free there would be taken again first."""
    done = subprocess.run([sys.executable, "-c", _IDLE.format(root=str(Path(__file__).resolve().parents[2]))], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
