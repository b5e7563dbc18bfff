"""The template tree against a brute-force version, and the cases that a single template for each leaf would miss."""

import random
from collections import Counter, defaultdict

import pytest
from corpusloom.llm import templates


def documents(spark, texts):
    return spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, source string")


def dropped(spark, texts, **options):
    return {r["doc_id"]: r["n_dropped"] for r in templates.deduplicated(documents(spark, texts), counts=True, **options).collect()}


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_families_of_one_leaf(spark, monkeypatch, most):
    monkeypatch.setattr(templates, "MOST_BROADCAST", most)
    draw = random.Random(1)
    word = lambda: "".join(draw.choices("abcdefgh", k=9))
    shapes = ["get the page {} from cache node {} in time", "get the page {} was sold out {} last week", "get the page {} never came back {} said they"]
    texts = [f"{word()} {word()} {word()} {word()}\n" + shapes[k % 3].format(word(), word()) for k in range(17)]
    got = dropped(spark, texts)
    assert [i for i in range(17) if got[i] == 0] == [0, 1, 2] and set(got.values()) == {0, 1}


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_families_of_a_leaf_are_all_found(spark, seed):
    """Leaves with 2, 3, 5 or 12 templates of equally many lines, 20 of each kind: the truth is what was planted, not a rule."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefghijklmnop", k=8))
    common, texts, planted = [word() for _ in range(40)], [], []
    for leaf in range(80):
        lead, size = f"leaf {word()} {leaf + 10000:d}".replace("1", "x"), 9
        lead = " ".join((lead.split() + ["x"])[:3])
        for f in range((2, 3, 5, 12)[leaf % 4]):
            slots = sorted(draw.sample(range(size), 3))
            fixed = [draw.choice(common) for _ in range(size)]
            for copy in range(4):
                line = " ".join([*lead.split(), *(word() if p in slots else fixed[p] for p in range(size))])
                planted.append((leaf, f, copy))
                texts.append(f"{word()} {word()} {word()} {word()}\n{line}")
    got = dropped(spark, texts)
    kept = [p for i, p in enumerate(planted) if got[i] == 0]
    assert sorted(set(kept)) == [(leaf, f, 0) for leaf, f, copy in planted if copy == 0] and len(kept) == 440


def test_numbers_alone_are_no_template(spark):
    texts = [f"{i} {i * 7} {i * 13}\nrow {i} of the table {i + 1}" for i in range(6)]
    got = dropped(spark, texts)
    assert got == {0: 0, **{i: 1 for i in range(1, 6)}}
    assert dropped(spark, ["1 2 3"] * 2 + [f"1 2 3\nword{'abcdef'[i]} and more" for i in range(3)]) == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1}


def test_lines_without_blanks(spark):
    long = "文" * 50
    assert dropped(spark, [f"{long}\n{w}" for w in "甲乙丙丁"]) == {0: 0, 1: 1, 2: 1, 3: 1}


def brute(rows, min_docs=3):
    """doc_id -> lines that go; families by the same rounds, over plain Python groups."""
    masked = lambda line: [("<*>" if any(c in "0123456789" for c in w) else w) for w in line.split()]
    seen = defaultdict(set)
    for text in {t for _, t in rows}:
        for line in text.split("\n"):
            w = line.split() if set(masked(line)) == {"<*>"} else masked(line)
            if len(w) >= 3:
                seen[tuple(w)].add(text)
    first_id = {t: min(i for i, x in rows if x == t) for _, t in rows}
    leaves = defaultdict(list)
    for line in seen:
        leaves[len(line), line[:3]].append(line)
    family = {}
    for leaf, group in leaves.items():
        groups = {leaf: group} if leaf[0] > 3 else {}
        for _ in range(4):
            after = defaultdict(list)
            for node, own in groups.items():
                if len(own) < 2 or sum(len(seen[x]) for x in own) < min_docs:
                    continue
                size, shape, best = leaf[0] - 3, [], None
                for p in range(size):
                    n = Counter()
                    for x in own:
                        n[x[3 + p]] += len(seen[x])
                    top, total = max(n.values()), sum(n.values())
                    tops = [w for w in n if n[w] == top]
                    shape.append(tops if top >= 0.5 * total else None)
                    often = sum(v for v in n.values() if v >= min_docs)
                    if len(n) > 1 and top >= min_docs and (best is None or often > best[0]):
                        best = (often, p, n)
                fixed = sum(x is not None for x in shape)
                fit = []
                if 0.5 * size <= fixed < size:
                    assert all(x is None or len(x) == 1 for x in shape), "a tie hangs on hashes"
                    fit = [x for x in own if all(s is None or x[3 + p] == s[0] for p, s in enumerate(shape))]
                n = sum(len(seen[x]) for x in fit)
                if n >= min_docs and (n >= 0.25 * total or best is None):
                    for x in own:
                        if x in fit:
                            family[x] = node
                        else:
                            after[(node, "rest")].append(x)
                elif best:
                    for x in own:
                        w = x[3 + best[1]]
                        after[(node, best[1], w) if best[2][w] >= min_docs else (node, "other")].append(x)
            groups = after
    texts_of = defaultdict(set)
    for x, texts in seen.items():
        texts_of[family.get(x, x)] |= texts
    keeps = {k: min(v, key=first_id.get) for k, v in texts_of.items() if len(v) >= min_docs}
    out = {}
    for i, text in rows:
        out[i] = 0
        for line in text.split("\n"):
            w = tuple(line.split() if set(masked(line)) == {"<*>"} else masked(line))
            k = family.get(w, w)
            out[i] += len(w) >= 3 and k in keeps and keeps[k] != text
    return out


def test_tree_is_brute_force(spark):
    draw = random.Random(5)
    word = lambda n: "w" + "abcdefghijklmnopqrstuvwxyz"[draw.randrange(n)]
    texts = []
    for i in range(150):
        out = []
        for _ in range(draw.randint(1, 6)):
            kind = draw.randrange(4)
            if kind == 0:
                out.append(f"in the end {word(3)} of {word(26)}{word(26)} and {word(26)}{word(26)} fell")
            elif kind == 1:
                out.append(f"in the end we {word(26)}{word(26)} all {draw.randint(1, 99)} said")
            elif kind == 2:
                out.append(" ".join(word(26) + word(26) for _ in range(draw.randint(3, 7))))
            else:
                out.append(f"{draw.randint(1, 5)} {draw.randint(1, 5)} {draw.randint(1, 5)}")
        texts.append("\n".join(out))
    texts += texts[:20]
    rows = list(enumerate(texts))
    want = brute(rows)
    assert dropped(spark, texts) == want and sum(want.values()) > 100
