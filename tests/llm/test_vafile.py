"""Hard negatives against brute force, on edge rows, ties and several shards."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import vafile

ROWS = "vec_id long, embedding array<float>, label int, rank int, SHARD string, w int, kind int"


def made(n, seed=0, dim=8):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    rows = [(i, [x + draw.gauss(0, 0.4) for x in centres[i % 4]], i % 4 if draw.random() < 0.8 else draw.randrange(4), 1, "s", 2, 3) for i in range(n)]
    return rows + [(5000 + i, rows[7][1], i % 2, 1, "s", 2, 3) for i in range(60)]  # one very common vector: ties throughout


def brute(rows, every, k, m, low, high, scale):
    ok = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        ok[i, label, tuple(int(np.floor(float(np.float32(x)) * scale)) for x in v)] = True
    out = []
    for i, label, v in ok:
        if i % every:
            continue
        scores = [(-sum(a * b for a, b in zip(v, w)), j, l) for j, l, w in ok if j != i and len(w) == len(v)]
        for s, j, _ in sorted(x for x in scores if x[2] == label)[:k]:
            inside = sorted(x for x in scores if x[2] != label and -low * s <= -100 * x[0] <= -high * s)
            out += [(i, j, r, x[1], -s, -x[0]) for r, x in enumerate(inside[:m], 1)]
    return sorted(out)


@pytest.mark.parametrize("shards", [None, 5])
def test_hard_negatives_are_brute_force(spark, shards):
    rows = made(400) + [(None, [1.0] * 8, 1, 1, "s", 2, 3), (9000, None, 1, 1, "s", 2, 3), (9100, [1.0, None] * 4, 1, 1, "s", 2, 3), (9200, [float("nan")] * 8, 1, 1, "s", 2, 3), (9300, [1.0] * 8, None, 1, "s", 2, 3), (9400, [], 0, 1, "s", 2, 3), (9500, [1.0, 2.0], 0, 1, "s", 2, 3), (9510, [1.0, 1.5], 0, 1, "s", 2, 3), (9511, [0.5, 0.5], 1, 1, "s", 2, 3), (9600, [float("inf")] * 8, 1, 1, "s", 2, 3)]
    df = spark.createDataFrame(rows + rows[:50], ROWS)
    got = vafile.hard_negatives(df, df.where(F.col("vec_id") % 20 == 0), 3, 4, 30, 90, 256, shards=shards).collect()
    assert sorted(map(tuple, got)) == brute(rows, 20, 3, 4, 30, 90, 256)


def test_bounds_hold_and_prune():
    draw = np.random.default_rng(1)
    vectors, q = draw.integers(-200, 200, (3000, 16)), draw.integers(-200, 200, (5, 16))
    file = vafile.VAFile(np.arange(3000), np.zeros(3000, np.int64), vectors)
    low, high = file.bounds(q)
    exact = vectors @ q.T
    assert (low <= exact).all() and (exact <= high).all()
    assert (high >= np.partition(low, -10, axis=0)[-10]).mean() < 0.2


def test_no_rows(spark):
    df = spark.createDataFrame([], ROWS)
    assert vafile.hard_negatives(df, df).count() == 0


def test_whole_table_at_a_larger_size(spark):
    import duckdb

    from corpusloom.llm import catalogue

    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM read_parquet('/root/testdata/sf0.1/embeddings.parquet')")
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({catalogue.OP11_SQL})").fetchall()
    assert sorted(map(tuple, catalogue.op11_vafile(spark, "/root/testdata/sf0.1").select(*names).collect())) == sorted(want)
