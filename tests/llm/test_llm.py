"""The training-data operators against brute force, on edge rows and small tables."""

import math
import random
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import catalogue, components, kneser_ney, langid, latent, packing, simple8b, superminhash, templates, token_ids, topk, toxicity, wrappers

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank_in_group int, TEXT_KEY int, drop_lines string"
DRAW = random.Random(7)
VOCABULARY = ["".join(DRAW.choices("abcdefghij", k=DRAW.randint(2, 7))) for _ in range(300)]


def words(n, draw=DRAW):
    return " ".join(draw.choices(VOCABULARY, k=n))


def edge_texts():
    base = words(60)
    near = base.split()
    near[30] = "changed"
    return [None, "", "  \n", "one", "two words", base, base, base.upper(), " ".join(near), words(5000), "%%% 123 !!!", "a\n\nb\n" + words(10), "ünï çödé x", base + " tail"]


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(i, t, "en", None if i % 4 == 0 else f"s{i % 3}", len(t or ""), 1, 2, "x") for i, t in enumerate(edge_texts())]
    rows += [rows[5], (None, words(30), None, "s1", 1, 1, 2, "x"), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def split(t):
    return (t or "").encode().lower().split()


def shingle_set(t, k):
    w = split(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute_groups(rows, k, percent):
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in sets:
        for b, y in sets:
            if a is not None and b is not None and a < b and x and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in root}


@pytest.mark.parametrize("cluster", [512, 4])
def test_near_duplicates(spark, edges, cluster, monkeypatch):
    monkeypatch.setattr(superminhash, "CLUSTER", cluster)
    draw = random.Random(1)
    rows = [(r["doc_id"], r["text"]) for r in edges.select("doc_id", "text").collect()]
    for g in range(3):
        base = words(80, draw).split()
        for _ in range(25):
            own = list(base)
            for _ in range(draw.randint(0, 6)):
                own[draw.randrange(80)] = "edit" + str(draw.randrange(10**6))
            rows.append((100 + len(rows), " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for k, percent in ((3, 85), (5, 80)):
        want = brute_groups(rows, k, percent)
        got = superminhash.grouped(df, k, percent).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r["component_id"] == want.get(r["doc_id"]) and r["kept"] == (r["doc_id"] is None or want[r["doc_id"]] == r["doc_id"])
    sizes = {r["doc_id"]: r["n_shingles"] for r in superminhash.grouped(df, 3, 85).where("doc_id is not null").collect()}
    assert all(sizes[i] == len(shingle_set(t, 3)) for i, t in rows if i is not None)


def test_near_duplicates_keep_columns(edges, none):
    kept = superminhash.deduplicated(edges)
    assert kept.columns == edges.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(None) == 2 and ids.count(5) == 1 and not {6, 7} & set(ids) and {0, 1, 2, 3, 4} <= set(ids)
    assert superminhash.deduplicated(none).count() == 0


def test_superminhash_estimates():
    draw = random.Random(2)
    a = {draw.getrandbits(63) for _ in range(900)}
    shared = set(list(a)[:700])
    b = shared | {draw.getrandbits(63) for _ in range(200)}
    flat = np.array(sorted(a) + sorted(b), np.uint64)
    s = superminhash.signatures(flat, np.array([0, 900, 1800]), 512)
    assert abs((s[0] == s[1]).mean() - 700 / 1100) < 0.07
    tiny = superminhash.signatures(np.array([5, 9], np.uint64), np.array([0, 2, 2]), 64)
    assert (tiny[0] >> np.uint64(32)).max() < 64 and (tiny[1] == np.iinfo(np.uint64).max).all()


@pytest.mark.parametrize("local", [0, 1000])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(components, "LOCAL_LINKS", local)
    links = [(i, i + 1) for i in range(40) if i != 20] + [(100, 7), (50, 50)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 21)}, **{i: 21 for i in range(22, 41)}, 100: 0}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simple8b_round_trips():
    draw = np.random.default_rng(0)
    for n in (0, 1, 127, 128, 129, 1000):
        for shift in (0, 20, 48, 63):
            v = draw.integers(0, 2**64, n, dtype=np.uint64) >> np.uint64(shift)
            assert (simple8b.decode(simple8b.encode(v)) == v).all()
    ones = np.ones(1280, np.uint64)
    assert len(simple8b.encode(ones)) < 400
    with pytest.raises(ValueError):
        simple8b.decode(b"nope" + b"\0" * 40)


def test_token_ids(spark, edges, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path(catalogue.VOCABULARY))
    whole = Tokenizer.from_file(path)
    rows = [(r["doc_id"], r["text"]) for r in edges.select("doc_id", "text").collect()] + [(900, "I'LL don't <|endoftext|> x"), (901, "½ ﬁ é 12 a\x01b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = token_ids.encoded(df, path).orderBy("start").collect()
    at = 0
    texts = Counter((i, tuple(whole.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in rows)
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        match = next(k for k in texts if k[0] == r["doc_id"] and zlib.crc32(np.array(k[1], "<u4").tobytes()) == r["ids_crc32"] and len(k[1]) == r["n_tokens"] and texts[k])
        texts[match] -= 1
    assert not +texts and [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert token_ids.encoded(none, path).count() == 0


@pytest.mark.parametrize("sampled", [False, True])
def test_topk_is_brute_force(spark, monkeypatch, sampled):
    draw = np.random.default_rng(4)
    vectors = [(i, draw.integers(-4, 5, 6).astype(float).tolist()) for i in range(700)]
    rows = [*vectors, (700, None), (800, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (900, [float("nan")] * 6), (1000, [float("inf")] * 6), (1100, []), (1200, [1.0] * 3), (1300, [2.0] * 3), vectors[100], (None, [1.0] * 6)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    queries = df.where("vec_id % 100 = 0")
    if sampled:  # thresholds from a sample, over several shards
        monkeypatch.setattr(topk, "SAMPLE_ROWS", 40)
    got = topk.top_k(df, queries, k=5, scale=1, shards=3).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = vectors + [(1200, [1.0] * 3), (1300, [2.0] * 3)]
    for q, v in good:
        if q % 100 == 0:
            scores = sorted((-int(np.dot(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:5]
            assert sorted(found.pop(q)) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert not found
    assert topk.top_k(df.limit(0), queries.limit(0)).count() == 0


def test_a_tree_is_built_once_for_each_shard(spark, tmp_path, monkeypatch):
    """However many blocks of queries there are; and a shard's rows are shuffled once."""
    built = topk.BallTree.__init__

    def noted(self, *args):
        import uuid

        (tmp_path / uuid.uuid4().hex).write_text("")
        built(self, *args)

    monkeypatch.setattr(topk.BallTree, "__init__", noted)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    draw = np.random.default_rng(8)
    df = spark.createDataFrame([(i, draw.normal(size=4).tolist()) for i in range(600)], "vec_id long, embedding array<double>")
    rows = topk.top_k(df, df, k=3, scale=256, shards=4)
    assert rows.count() == 1800 and len(list(tmp_path.iterdir())) == 4


def test_ball_tree_prunes_and_stays_exact():
    draw = np.random.default_rng(5)
    v = draw.integers(-1000, 1000, (3000, 8))
    tree = topk.BallTree(np.arange(3000), v, 64)
    q = v[:50]
    best = np.full((50, 7), np.iinfo(np.int64).min), np.full((50, 7), np.iinfo(np.int64).max)
    tree.search(np.arange(50), q, 7, best)
    for i in range(50):
        want = sorted((-int(q[i] @ w), j) for j, w in enumerate(v) if j != i)[:7]
        assert list(zip((-best[0][i]).tolist(), best[1][i].tolist())) == want


def test_language_model_is_brute_force(spark, edges, none):
    rows = [(r["doc_id"], r["text"]) for r in edges.select("doc_id", "text").collect()] + [(2000 + i, words(20)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    texts = [(i, [*split(t), "<end>"]) for i, t in rows]
    count, triples = Counter(), Counter()
    for i, t in texts:
        if not held(i):
            count.update(t)
            triples.update(zip(["<start>", "<start>", *t[:-2]][: len(t)], ["<start>", *t[:-1]], t))
    n, v, pairs = sum(count.values()), len(count), Counter(x[1:] for x in triples)
    cont = Counter(w for _, w in pairs)
    d1, d2, d3 = (kneser_ney._discounts([sum(c == k for c in x.values()) for k in (1, 2, 3, 4)]) for x in (cont, pairs, triples))
    total, by = Counter(), {}
    for x, c in [*pairs.items(), *triples.items()]:
        total[x[:-1]] += c
        by.setdefault(x[:-1], Counter())[min(c, 3)] += 1
    mass = sum(d1[min(c, 3)] for c in cont.values()) / len(pairs)

    def p(a, b, w):
        out = max(cont[w] - d1[min(cont[w], 3)], 0) / len(pairs) + mass / (v + 1)
        for context, c, d in (((b,), pairs[b, w], d2), ((a, b), triples[a, b, w], d3)):
            if total[context]:
                out = (max(c - d[min(c, 3)], 0) + sum(d[k] * x for k, x in by[context].items()) * out) / total[context]
        return out

    some = next(x for x in triples if x[0] != "<start>")
    for a, b in (("<start>", "<start>"), some[:2], ("?", some[1])):
        assert abs(sum(p(a, b, w) for w in count) + p(a, b, "?") - 1) < 1e-9
    want = Counter()
    for i, t in texts:
        want[i, held(i), len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), 6), round(sum(math.log10(p(a, b, w)) for a, b, w in zip(["<start>", "<start>", *t[:-2]][: len(t)], ["<start>", *t[:-1]], t)), 6)] += 1
    got = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in kneser_ney.learned_and_scored(df).collect())
    assert got == want
    scores = Counter()
    for k, c in want.items():
        scores[k[0], k[6]] += c
    learned = df.where(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) != 2)
    one, many = (Counter((r["doc_id"], round(r["score"], 6)) for r in kneser_ney.scored(df, kneser_ney.train(learned, buckets=x)).collect()) for x in (1, 40))  # the more buckets, the more words are hot
    assert one == many == scores
    assert kneser_ney.learned_and_scored(none).count() == 0
    empty = kneser_ney.scored(df, kneser_ney.train(none)).collect()
    assert all(r["score"] == r["base_score"] == 0 for r in empty)


def test_language_id(spark, edges, none):
    draw = random.Random(3)
    rows = [(i, "".join(draw.choices("aeioust " if i % 2 else "bcdfgüö ", k=80)), "xx" if i % 2 else "yy") for i in range(200)]
    df = spark.createDataFrame(rows + [(500, "123 %%", "xx"), (501, None, "xx"), (502, "aei", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows if got[i]["held_out"])
    assert got[500]["lang_pred"] == got[501]["lang_pred"] == "und" and got[500]["score"] == 0 and got[502]["lang_pred"] == "xx"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(none).count() == 0
    assert {r["lang_pred"] for r in langid.predict(edges, *langid.learn(none)).collect()} == {"und"}


def test_toxicity(spark, edges, none):
    draw = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        lines = [words(8, draw) + "." for _ in range(draw.randint(1, 12))]
        if bad:
            lines.insert(draw.randrange(len(lines) + 1), f"you total {draw.choice(['blargh', 'snorfle'])}!")
        rows.append((i, "\n".join(lines)))
        labels.append((i, 1, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    got = {r["doc_id"]: r for r in toxicity.score(docs, *model).collect()}
    held = [i for i in got if got[i]["held_out"]]
    assert held and all(got[i]["predicted"] == int(i % 5 == 0) for i in held)
    text = dict(rows)
    for i in held:
        if i % 5 == 0:
            assert text[i].encode()[got[i]["worst_start"] :].startswith(b"you") or got[i]["worst_start"] >= 0
    found = toxicity.sentences(docs, *model).where("doc_id % 5 = 0").collect()
    assert found and all("blargh" in r["sentence"] or "snorfle" in r["sentence"] for r in found)
    assert {r["doc_id"] for r in toxicity.accepted(docs, *model).collect()} == {i for i in got if not got[i]["predicted"]}
    assert toxicity.scored(edges, marks.limit(0)).count() == edges.count()
    assert toxicity.accepted(edges, *model).columns == edges.columns
    assert all(r["score"] == 0 for r in toxicity.score(edges, *model).where("doc_id in (0, 1, 2)").collect())
    assert toxicity.scored(none, marks).count() == 0


def test_line_templates(spark, edges, none):
    same = "This exact line is in many texts."
    logs = [f"User session opened for account name{chr(97 + i)} on the main host" for i in range(6)]
    rows = [(i, f"{words(9)}\n{same}\n{logs[i]}\nid {i} of 9 pages here\n") for i in range(6)] + [(10, same), (11, same), (12, None), (13, "of it"), (None, same + "\nlast " + words(5))]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, n_dropped string")
    got = {r["doc_id"]: r["text"] for r in templates.deduplicated(df).collect()}
    text = dict(rows)
    assert got[0] == text[0]
    for i in range(1, 6):
        assert got[i] == text[i].split("\n")[0] + "\n"
    assert got[10] == got[11] == "" and got[12] is None and got[13] == "of it" and got[None].startswith("last ")
    out = templates.deduplicated(edges)
    assert out.columns == edges.columns and out.count() == edges.count()
    assert templates.deduplicated(none).count() == 0


def test_latent_retrieval(spark, edges, none):
    draw = random.Random(6)
    items = [(i, words(12 + 6 * i, draw) + ". " + words(8, draw) + ".") for i in range(12)] + [(50, None), (51, ""), (52, "few words")]
    benchmark = spark.createDataFrame(items + items[:1], "item_id long, text string")
    rows = [(100 + i, words(draw.randint(0, 300), draw)) for i in range(60)]
    planted = {}
    for i, t in items[:12]:
        planted[200 + i] = i
        rows.append((200 + i, words(70, draw) + " " + t.upper() + " " + words(90, draw)))
        changed = t.split()
        changed[3] = changed[7] = "other"
        planted[300 + i] = i
        rows.append((300 + i, words(40, draw) + " " + " ".join(changed)))
    docs = spark.createDataFrame(rows + [(None, items[4][1]), (1, None), (2, "")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in latent.leaks(docs, benchmark).collect()}
    assert set(planted.items()) | {(None, 4)} == got
    kept = {r["doc_id"] for r in latent.decontaminated(docs, benchmark).collect()}
    assert kept == {i for i, _ in rows if i not in planted} | {None, 1, 2}
    assert latent.leaks(none, benchmark).count() == 0 and latent.leaks(edges, benchmark.limit(0)).count() == 0
    assert latent.decontaminated(edges, benchmark).columns == edges.columns


def test_latent_retrieval_of_short_and_frequent_items(spark):
    draw = random.Random(9)
    fresh = lambda n: " ".join("".join(draw.choices("abcdefghij", k=5)) for _ in range(n))
    items = [(i, fresh(n)) for i, n in enumerate((2, 3, 5, 6, 7, 9, 12, 15, 18))] + [(50, " ".join(f"often{i}" for i in range(12))), (51, "...")]
    docs = [(100 * i + j, f"{fresh(37 + j)} {t.upper()} {fresh(40)}") for i, t in items[:9] for j in range(4)]
    docs += [(5000 + i, fresh(30) + " " + items[9][1] + " " + fresh(30)) for i in range(100)]
    docs += [(9000, items[1][1].split()[0] + " x " + items[1][1].split()[2])]
    got = {(r["doc_id"], r["item_id"]) for r in latent.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(100 * i + j, i) for i in range(9) for j in range(4)} | {(5000 + i, 50) for i in range(100)}
    short = spark.createDataFrame(items[:2], "item_id long, text string")
    assert latent.decontaminated(spark.createDataFrame(docs, "doc_id long, text string"), short).count() == len(docs) - 8


def test_latent_retrieval_keeps_pace_with_the_benchmark(spark):
    draw = random.Random(8)
    fresh = lambda n: " ".join("".join(draw.choices("abcdefghij", k=5)) for _ in range(n))
    items = [(i, fresh(draw.randint(32, 60))) for i in range(1000)]
    docs = [(i, fresh(25) + " " + items[i][1] + " " + fresh(25)) for i in range(0, 1000, 5)]
    got = {(r["doc_id"], r["item_id"]) for r in latent.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i) for i, _ in docs}


def test_randomised_svd_spans_the_rows(spark):
    items = spark.createDataFrame([(i, words(20)) for i in range(30)], "item_id long, text string")
    rows = latent.passages(items).cache()
    used = np.unique(np.concatenate([np.frombuffer(r["words"], "<i4") for r in rows.collect()]))
    place = np.full(1 << latent.BITS, -1)
    place[used] = np.arange(len(used))
    idf = np.ones(1 << latent.BITS)
    basis = latent.svd(rows, place, idf, len(used), 64)
    column, value, at = latent._rows([r["words"] for r in rows.collect()], place, idf)
    dense = np.zeros((30, len(used)))
    dense[np.repeat(np.arange(30), np.diff(at)), column] = value
    assert np.allclose(dense @ basis @ basis.T, dense, atol=1e-6) and np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-8)


def brute_best_fit(lengths, sources, clusters, capacity):
    bins, out = [], []
    for n, s, c in zip(lengths, sources, clusters):
        fits = [(capacity - b[0], i) for i, b in enumerate(bins) if capacity - b[0] >= n and not b[1] & s and not b[2] & c]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([0, 0, 0])
        out.append((i, bins[i][0]))
        bins[i][0] += n
        bins[i][1] |= s
        bins[i][2] |= c
    return out


def test_best_fit_is_brute_force():
    draw = random.Random(8)
    for _ in range(30):
        n = draw.randint(0, 80)
        sizes = sorted((draw.randint(1, 100) for _ in range(n)), reverse=True)
        sources, clusters = ([1 << draw.randrange(6) if draw.random() < 0.8 else 0 for _ in range(n)] for _ in range(2))
        assert packing.best_fit(sizes, sources, clusters, 100) == brute_best_fit(sizes, sources, clusters, 100)


def test_packing(edges, none):
    for shard_rows in (4096, 5):
        got = packing.packed(edges, capacity=100, shard_rows=shard_rows).collect()
        assert sum(r["n_tokens"] for r in got) == sum(len(split(r["text"])) + 1 for r in edges.collect())
        bins = {}
        for r in got:
            bins.setdefault(r["bin_id"], []).append(r)
        for b in bins.values():
            assert sum(r["n_tokens"] for r in b) <= 100
            own = [r["source"] for r in b if r["source"] is not None]
            assert len(own) == len(set(own))
            at = 0
            for r in sorted(b, key=lambda r: r["bin_start"]):
                assert r["bin_start"] == at
                at += r["n_tokens"]
    assert packing.packed(edges.withColumn("cluster", F.lit(1)), capacity=100, cluster="cluster").groupBy("bin_id").agg(F.countDistinct("doc_id").alias("n")).agg(F.max("n")).first()[0] == 1
    assert packing.packed(none).count() == 0


def test_wrapper_extraction(spark):
    article = "<html><head><title>no</title></head><body><nav>menu</nav><article><h1>T &amp; t</h1><p>One\n two<br>three<p>Four <b>bold</b></article><div class='comments'><p>no</div><footer>no</footer>"
    rows = [(1, "http://a.com/1", article), (2, None, None), (3, "x", ""), (4, "http://b.com", "plain &lt;text&gt;"), (5, "http://b.com", "<div><script>var a='<p>no</p>';</script><p>yes</div><!-- <p>no -->"), (1, "http://a.com/1", article)]
    rows += [(10 + i, "https://C.com/x", f"<body><div><p>Same banner text</p></div><div><p>Own text {i}</p></div><div><p>Copyright line</p></div>") for i in range(6)]
    rows += [(30, "http://d.com", "<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int").repartition(3)
    got = {r["page_id"]: r["text"] for r in wrappers.extracted(df).collect()}
    assert got[1] == "T & t\nOne two three\nFour bold" and got[2] == got[3] == "" and got[4] == "plain <text>" and got[5] == "yes" and got[30] == "deep"
    assert all(got[10 + i] == f"Own text {i}" for i in range(6))
    assert wrappers.extracted(df.limit(0)).count() == 0 and wrappers.extracted(df).count() == len(rows)


def test_wrapper_induction_in_marked_pages(spark):
    page = "<body><div><p>Same banner</p></div><article><h1>Title {0}</h1><p>Own text {0}</p><div><p>Same share text</p></div></article><div><p>Same end</p></div>{1}"
    rows = [(i, "http://a.com/x", page.format(i, "")) for i in range(6)]
    rows += [(10 + i, "http://b.com/x", page.format(0, f"<script>{i}</script>")) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in wrappers.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Title {i}\nOwn text {i}" for i in range(6))
    assert all("Title 0\nOwn text 0" in got[10 + i] for i in range(6))  # copies count once


def test_tree_matching():
    a = ["r", [["x", []], ["y", [["z", []]]], ["x", []]]]
    b = ["r", [["y", [["q", []], ["z", []]]], ["x", []]]]
    assert wrappers.match(a, b) == {0: 0, 2: 1, 3: 3, 4: 4}
    assert wrappers.match(["a", []], ["b", []]) == {}


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_oracles(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    theirs, ours = con.execute(catalogue.oracle_sql()[name]).fetchdf(), catalogue.queries()[name](spark, DATA).toPandas()
    columns = sorted(theirs.columns)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (ours, theirs))
    assert sorted(ours.columns) == columns and a.equals(b)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA).cache()
        assert out.columns == columns and 0.6 * docs.count() < out.count() <= docs.count()
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == docs.count() < n
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontaminate", "pack"]
