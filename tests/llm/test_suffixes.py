"""Repeated byte strings against brute force: slices, hot buckets, equal rows, broken characters."""

import random
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import suffixes

DOCS = "doc_id long, text string, b int, c string, x int, n_bytes int"


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        out.append((len(r), int(gone.sum()), int((edge == 1).sum()), bytes(np.frombuffer(r, np.uint8)[~gone])))
    return out


def made(seed=1):
    draw = random.Random(seed)
    word = lambda n: " ".join("".join(draw.choices("abcdeé", k=draw.randint(2, 6))) for _ in range(n))
    passage, line = word(40), word(14)
    texts = [None, "", "short", passage, passage, "x" * 300, "ab" * 200, "é" * 90, word(2000)]
    for i in range(60):
        t = word(draw.randint(5, 60))
        if i % 3 == 0:
            t += " " + passage[draw.randint(0, 60) :] + word(3)
        if i % 4 == 0:
            t = line + t
        if i % 7 == 0:
            t = t + t[draw.randint(0, 10) :]
        texts.append(t)
    base = word(80)
    for i in range(20):  # near copies
        at = draw.randrange(len(base) - 5)
        texts.append(base[:at] + "ZZ" + base[at + draw.randint(0, 3) :])
    return texts + [texts[8][:700] + "!" + texts[8][700:]]


@pytest.mark.parametrize(("length", "change"), [(64, {}), (100, {"SLICE": 333, "BIG": 3}), (200, {"ARRAY_BYTES": 2000}), (64, {"BIG": 0})])
def test_removal_is_brute_force(spark, monkeypatch, length, change):
    for k, v in change.items():
        monkeypatch.setattr(suffixes, k, v)
    texts = made()
    ids = [None, None, *range(len(texts) - 2)]
    texts += texts[20:24] + [texts[30]]
    ids += ids[20:24] + [9999]  # equal rows, and a copy under another id
    df = spark.createDataFrame([(i, t, 1, "c", 2, 3) for i, t in zip(ids, texts)], DOCS).repartition(5)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.deduplicated(df, length).collect()]
    want = [(i, *w) for i, w in zip(ids, brute(texts, length))]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_hot_passage_is_shared_out(spark, monkeypatch):
    """A bucket of many contexts goes by windows; a third of all rows are one text."""
    monkeypatch.setattr(suffixes, "BIG", 50)
    draw = random.Random(4)
    passage = " ".join("".join(draw.choices("abcdefgh", k=5)) for _ in range(30))
    texts = [f"{draw.random()} {passage} {draw.random()}" for _ in range(200)] + [passage * 2] * 100
    df = spark.createDataFrame([(i, t, 1, "c", 2, 3) for i, t in enumerate(texts)], DOCS).repartition(4)
    got = [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.deduplicated(df, 120).orderBy("doc_id").collect()]
    assert got == brute(texts, 120)


@pytest.mark.parametrize("length", [48, 100, 200, 286])
def test_identifiers_name_strings(length):
    draw = np.random.default_rng(length)
    raw = np.concatenate([draw.integers(0, 2, 900), np.zeros(400), draw.integers(0, 256, 500)]).astype(np.uint8)
    raw = np.concatenate((raw, raw[200:1400], raw[::-1], raw[3:900]))
    own = suffixes.identifiers(raw, length)
    by = {}
    for i in range(len(raw) - length + 1):
        assert by.setdefault(raw[i : i + length].tobytes(), own[i]) == own[i]
    assert len(set(own[: len(raw) - length + 1].tolist())) == len(by)


def test_marks_cover_every_window():
    draw = random.Random(2)
    texts = ["".join(draw.choices("ab", k=n)).encode() for n in (0, 10, 199, 200, 201, 900, 5000)]
    raw, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    doc, place, far, near, gram, _ = suffixes.marks(raw, at, 200)
    windows = sorted((d, p - j) for d, p, a, b in zip(doc.tolist(), place.tolist(), far.tolist(), near.tolist()) for j in range(b, a + 1))
    assert windows == [(d, s) for d, t in enumerate(texts) for s in range(len(t) - 199)]
    assert len(doc) < len(windows) / 50
    same = {}
    for d, p, g in zip(doc.tolist(), place.tolist(), gram.tolist()):
        assert same.setdefault(texts[d][p : p + suffixes.GRAM], g) == g


def test_no_rows_and_bounds(spark):
    df = spark.createDataFrame([], DOCS)
    assert suffixes.deduplicated(df).count() == 0
    with pytest.raises(ValueError):
        suffixes.deduplicated(df, 300)
