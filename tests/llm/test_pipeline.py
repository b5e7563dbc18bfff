"""The pipeline's stages on planted rows and on edge tables; the models' scores by plain loops."""

import math
import random
from collections import Counter

import pytest

import corpus_pipeline
from corpusloom.llm import langid, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS, BENCHMARK = "doc_id long, quality int, toxic int", "item_id long, text string"


def saved(spark, folder, docs, labels, benchmark, extra=""):
    names = extra.split(",") if extra else []
    rows = [(*r, *(f"{n}-{r[0]}" for n in names)) for r in docs]
    spark.createDataFrame(rows, DOCS + "".join(f", `{n}` string" for n in names)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, BENCHMARK).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def stages(spark, folder):
    """doc_id -> text after each stage, and the last one's rows."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        columns = docs.columns
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        assert docs.columns == columns, name
        out.append(sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str))
    return out, corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()


def test_planted_rows_go_and_others_stay(spark, tmp_path):
    draw = random.Random(11)
    known = ["".join(draw.choices("abcdefghijklm", k=draw.randint(3, 8))) for _ in range(900)]
    say = lambda n: " ".join(draw.choices(known, k=n)) + "."
    texts, labels = {}, []
    for i in range(400):
        lines = [say(12) for _ in range(4)]
        if i < 80:
            lines.insert(2, f"you total {draw.choice(['blargh', 'snorfle'])} {draw.choice(known)}!")
        if i % 2 == 0 and i >= 80:
            lines.append(f"All rights of issue {i} are with the {draw.choice(known)} house of record")
        texts[i] = "\n".join(lines)
        labels.append((i, 1, int(i < 80)))
    items = [say(30) for _ in range(20)]
    near, copies, leaks = range(400, 410), range(410, 420), range(420, 440)
    for i in near:
        w = texts[i - 300].split(" ")
        w[0] = "changed"
        texts[i] = " ".join(w)
    for i in copies:
        texts[i] = texts[i - 290]
    for i, item in zip(leaks, items):
        texts[i] = f"{say(40)}\n{item}\n{say(40)}"
    folder = saved(spark, tmp_path, [(i, t, "en", f"s{i % 7}", len(t)) for i, t in texts.items()], labels, list(enumerate(items)))
    (tox, lined, single, clean), packed = stages(spark, folder)
    left = [{i for i, _ in x} for x in (tox, lined, single, clean)]
    assert left[0] >= set(range(80, 440)) and len(left[0] & set(range(80))) <= 2
    assert left[1] == left[0]
    kept = dict(lined)
    lost = [i for i in range(80, 400) if i % 2 == 0 and "All rights" not in kept[i]]
    assert len(lost) >= 150 and all(kept[i] == "\n".join(x for x in texts[i].split("\n") if "All rights" not in x) for i in lost)
    assert not left[2] & set(near) and not left[2] & set(copies) and left[2] == left[1] - set(near) - set(copies)
    assert not left[3] & set(leaks) and left[3] == left[2] - set(leaks)
    assert {r["doc_id"] for r in packed} == left[3]
    assert sum(r["n_tokens"] for r in packed) == sum(len(t.split()) + 1 for _, t in clean)


@pytest.mark.parametrize("given", ["nothing", "edges", "edges with labels"])
def test_edge_tables(spark, tmp_path, given):
    """Empty tables, null and empty texts, repeated rows, a long text, columns that clash with working names."""
    rows = []
    if given != "nothing":
        draw = random.Random(2)
        long = " ".join("".join(draw.choices("abcdefgh", k=6)) for _ in range(200_000))
        some = [None, "", " \n ", "one", "the same words in a row again and again", "the same words in a row again and again", long]
        rows = [(i, t, None, None if i % 2 else "s", None) for i, t in enumerate(some)]
        rows += [rows[3], (None, "no id here but some words", "en", "s", 1), (None, None, None, None, None)]
    labels = [(4, None, 1), (3, 1, 0), (None, 1, 1), (99, 1, 1)] if given == "edges with labels" else []
    folder = saved(spark, tmp_path, rows, labels, [(1, None), (2, "")] if labels else [], "TEXT_KEY,rank,toxic,b,n,node")
    found, packed = stages(spark, folder)
    if given == "nothing":
        assert found == [[]] * 4 and packed == []
    elif given == "edges":
        assert len(found[0]) == len(found[1]) == len(rows) and found[0] == sorted(((r[0], r[1]) for r in rows), key=str)
        assert Counter(t for _, t in found[2])["the same words in a row again and again"] == 1 and max(len(t or "") for _, t in found[3]) > 1_000_000
    assert corpus_pipeline.run(spark, folder).count() == len(packed)


def test_language_posterior_is_plain_bayes(spark):
    """Counts, smoothing, prior and posterior by plain loops over the same buckets; of equally likely languages the first by name."""
    draw = random.Random(6)
    rows = [(i, "".join(draw.choices("abcdef é" if i % 3 else "efghij ß", k=draw.randint(1, 60))), ("aa", "bb", "cc")[i % 3]) for i in range(90)]
    df = spark.createDataFrame(rows + [(900, None, "aa"), (901, "12 3", "bb"), (902, "zzz", None)], "doc_id long, text string, lang string")
    names, matrix = langid.learn(df)
    grams = lambda t: langid.grams([t])[0].tolist()
    counts, n = {x: Counter() for x in names}, Counter()
    for _, t, lang in [*rows, (900, None, None), (901, "12 3", "bb")]:
        if lang:
            counts[lang].update(grams(t))
            n[lang] += 1
    size = 1 << langid.BITS
    for r in langid.predict(df, names, matrix).collect():
        t = r["text"] if "text" in r else {i: t for i, t, _ in [*rows, (900, None, ""), (901, "12 3", ""), (902, "zzz", "")]}[r["doc_id"]]
        if t is None or not any(c.isalpha() for c in t):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        joint = {x: math.log(n[x] / sum(n.values())) + sum(math.log((counts[x][g] + langid.ALPHA) / (sum(counts[x].values()) + langid.ALPHA * size)) for g in grams(t)) for x in names}
        top = max(joint.values())
        assert abs(r["score"] - 1 / sum(math.exp(v - top) for v in joint.values())) < 1e-3 and joint[r["lang_pred"]] > top - 1e-3
    same = spark.createDataFrame([(i, "abc", lang) for i, lang in enumerate(["nn", "mm"] * 5)], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], round(r["score"], 6)) for r in langid.predict(same, *langid.learn(same)).collect()} == {("mm", 0.5)}


def test_toxicity_score_is_a_plain_noisy_or(spark):
    """1 - product over sentences of (1 - their score), which `sentences` returns; the worst sentence is the largest of them."""
    draw = random.Random(4)
    known = ["".join(draw.choices("abcdefgh", k=5)) for _ in range(60)]
    texts = [" ".join(draw.choices(known, k=8)) + ". " + (f"you {draw.choice(['blargh', 'snorfle'])}! " if i % 4 == 0 else "") + " ".join(draw.choices(known, k=5)) + "?\nEnd." for i in range(300)]
    docs = spark.createDataFrame([*enumerate(texts), (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], LABELS)
    model = toxicity.train(docs, labels)
    parts = {}
    for r in toxicity.sentences(docs, *model, least=0.0).collect():
        parts.setdefault(r["doc_id"], []).append((r["score"], -r["start"]))
    for r in toxicity.score(docs, *model).collect():
        own = parts.get(r["doc_id"], [])
        assert abs(r["score"] - (1 - math.prod(1 - p for p, _ in own))) < 1e-6 and r["n_sentences"] == len(own)
        assert r["predicted"] == int(r["score"] >= 0.5)
        assert (r["worst_start"], round(r["worst_score"], 6)) == ((-max(own)[1], round(max(own)[0], 6)) if own else (-1, 0))
