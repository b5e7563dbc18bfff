"""HTML main text by wrapper induction: trees of same-host pages are aligned, constant nodes become template.

A page is parsed once into blocks of text and a skeleton: its tree of block elements, in which equal neighbours (the
paragraphs of an article, the entries of a list) fall together. Every host gets SEEDS seed skeletons at most, those of
most of its pages; every other skeleton of the host is aligned with each of them by simple tree matching (once for each
distinct skeleton) and stands with the seed of which it matches most. A block that stands with the same text at the
same node on most of a seed's distinct pages is template, inside a marked article as well as outside; what varies is
content. Pages are distinct by the text of their blocks, so copies of one page count once. Elements that HTML marks as
no article (nav, footer, forms, ...) are left out before, and so are those that their names call adverts, notices,
sidebars and the like, unless an article lies in them, or, on a page without a marked one, most of its text (reader
comments always go). A seed
with fewer than PAGES distinct pages has no template. Children are matched within BAND places of the diagonal, so that
no page costs the square of its size.

Defined cases: null or empty html has an empty text; a page without markup is its own text; unclosed elements end
with their parents; a page without a host stands with the others that have none; repeated rows are pages of their
own, but count once in what is constant; `br` is white space; other columns are ignored.
"""

from __future__ import annotations

import html as references
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import runtime

#: A block is constant if so large a share of the host's distinct pages has it at the same node, of so many pages at least.
SHARE, PAGES = 0.6, 4
#: Seeds of a host; depth of a skeleton (what lies deeper stands at the node there); places off the diagonal; tags with unclosed quotes after which quotes no longer count.
SEEDS, DEEPEST, BAND, UNCLOSED = 3, 100, 64, 50
#: Bytes of all seeds and templates that may be broadcast; more are joined by a shuffle.
MOST_BROADCAST = 32_000_000

_OTHER = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)"
_TOKEN = re.compile(_OTHER + r"(?:((?:\"[^\"]*\"|'[^']*'|[^\"'>])*+)>|([^>]*)(?:>|\Z))", re.S)
_UNQUOTED = re.compile(_OTHER + r"([^>]*)(?:>|\Z)()", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "title"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_OUT = {"nav", "footer", "aside", "button", "select", "dialog", "menu", "head"}
_OUT_NAMES = set("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription sidebar menu nav navbar navigation breadcrumb breadcrumbs footer share sharing social related recommended recommendations pagination pager widget login signup search skip toolbar complementary contentinfo".split())
_COMMENT_NAMES = {"comment", "comments", "reply", "replies", "disqus"}
#: Words that may follow such a name, and words that deny it (no-sidebar, page-with-widget, alert-free).
_HOLDERS = set("area bar block body box button buttons container content form frame group holder icons inner item items left link links list module panel posts region right section slot stories thread top unit wrap wrapper".split())
_DENIED = {"has", "with", "no", "without", "not", "is", "free", "less"}
_HEAD_NAMES = {"header", "masthead"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
_FLOOR = {"table", "ul", "ol", "dl", "select", "article", "section", "div", "body", "html"}


def called(words: list[str], names: set[str]) -> bool:
    """Whether a class or id, as words, is one of the names: it ends with one, or starts with one that only holders follow."""
    words = [w for w in words if len(w) > 1]
    if not words or not _DENIED.isdisjoint(words):
        return False
    return words[-1] in names or words[0] in names and all(w in names or w in _HOLDERS for w in words[1:])


def only(words: list[str], names: set[str]) -> bool:
    """Whether a class or id, as words, is one of the names by all its words: share-box is, lunch-menu is not."""
    words = [w for w in words if len(w) > 1]
    return called(words, names) and all(w in names or w in _HOLDERS for w in words)


class Page:
    """Blocks (node, text) and the skeleton of one page."""

    def __init__(self, source: str):
        self.labels, self.parents, self.children = ["page"], [-1], [[]]
        self.out, self.named, self.strict, self.form = [False], [False], [False], [False]
        self.head, self.main, self.title = [False], [False], [False]
        blocks: list[tuple[int, str]] = []
        stack, open_, held, at, token, unclosed = [("page", 0)], Counter(), [], 0, _TOKEN, 0

        def flush() -> None:
            if held:
                text = " ".join(references.unescape("".join(held)).split())
                held.clear()
                if text:
                    blocks.append((stack[-1][1], text))

        while at < len(source):
            m = token.search(source, at)
            if m is None:
                held.append(source[at:])
                break
            if m.start() > at:
                held.append(source[at : m.start()])
            at = m.end()
            if m[1] is not None:
                held.append(references.escape(m[1]))
            if m[3] is None:
                continue
            if m[5]:
                unclosed += 1
                token = _UNQUOTED if unclosed > UNCLOSED else _TOKEN
            tag = m[3].lower()
            if m[2]:
                if tag in _INLINE:
                    continue
                if not open_[tag]:
                    if tag == "p":
                        flush()
                    continue
                flush()
                while stack[-1][0] != tag:
                    open_[stack.pop()[0]] -= 1
                open_[stack.pop()[0]] -= 1
                continue
            if tag == "br" or tag == "hr":
                held.append(" ") if tag == "br" else flush()
                continue
            if tag in _RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            if tag in _INLINE or tag in _VOID:
                continue
            flush()
            closes = _CLOSES.get(tag, set())
            while stack[-1][0] == "p" or stack[-1][0] in closes and stack[-1][0] not in _FLOOR:
                open_[stack.pop()[0]] -= 1
            stack.append((tag, self._node(tag, m[4] or m[5] or "", stack[-1][1])))
            open_[tag] += 1
        flush()
        self._finish(blocks)

    def _node(self, tag: str, attributes: str, parent: int) -> int:
        given = [x for m in _NAMES.finditer(attributes) for x in (m[1] or m[2] or m[3] or "").split()] if attributes.strip() else []
        words = [[w.lower() for w in _PARTS.findall(x)] for x in given]
        n = len(self.labels)
        main = tag in ("article", "main") or tag == "div" and ["main"] in words and "role" in attributes
        plain = tag not in ("html", "body", "article", "main")
        self.out.append(tag in _OUT or plain and any(called(w, _COMMENT_NAMES) for w in words))
        self.named.append(plain and any(called(w, _OUT_NAMES) for w in words))
        self.strict.append(plain and any(only(w, _OUT_NAMES) for w in words))
        self.form.append(tag == "form")
        self.head.append(tag == "header" or any(called(w, _HEAD_NAMES) for w in words))
        self.main.append(main)
        self.title.append(tag == "h1")
        names = sorted({w for x in words for w in x})
        self.labels.append(tag + ("." + ".".join(names) if names else ""))
        self.parents.append(parent)
        self.children.append([])
        self.children[parent].append(n)
        return n

    def _content(self, blocks: list[tuple[int, str]]) -> list[bool]:
        """Whether each block is left: not in what HTML or its names mark as no article."""
        count = len(self.labels)
        size, holds = [0] * count, [m or t for m, t in zip(self.main, self.title)]
        out, head, main = self._closed(blocks), list(self.head), list(self.main)
        for n in range(1, count):  # parents come first
            p = self.parents[n]
            out[n], head[n], main[n] = out[n] or out[p], head[n] or head[p], main[n] or main[p]
        for n, text in blocks:
            size[n] += 0 if out[n] else len(text)
        for n in range(count - 1, 0, -1):
            size[self.parents[n]] += size[n]
            holds[self.parents[n]] |= holds[n]
        marked = any(m and size[n] and not out[n] for n, m in enumerate(self.main))
        for n in range(1, count):
            # in an article, a name decides only as a whole: what merely ends with one stays, unless alignment finds it constant
            inside = main[self.parents[n]]
            name = self.strict[n] if inside else self.named[n]
            out[n] = out[n] or out[self.parents[n]] or name and not holds[n] and (marked and not inside or 2 * size[n] <= size[0])
        heading = [re.match(r"h[1-6](?:\.|$)", x) is not None for x in self.labels]
        return [not out[n] and not (head[n] and not (heading[n] and main[n])) for n, _ in blocks]

    def _closed(self, blocks: list[tuple[int, str]]) -> list[bool]:
        """Which nodes HTML marks as no article; a form does not count if it holds an article, a title or half of the page's text, as one around the whole page does."""
        out, size, holds = list(self.out), [0] * len(self.labels), [m or t for m, t in zip(self.main, self.title)]
        for n, text in blocks:
            size[n] += len(text)
        for n in range(len(out) - 1, 0, -1):
            size[self.parents[n]] += size[n]
            holds[self.parents[n]] |= holds[n]
        for n in range(1, len(out)):
            out[n] = out[n] or self.form[n] and not holds[n] and 2 * size[n] < size[0]
        return out

    def _finish(self, blocks: list[tuple[int, str]]) -> None:
        kept = [b for b, good in zip(blocks, self._content(blocks)) if good]
        place, depth = [0] * len(self.labels), [0] * len(self.labels)
        for n in range(1, len(self.labels)):
            depth[n] = depth[self.parents[n]] + 1
        shapes, known = [0] * len(self.labels), {}
        for n in range(len(self.labels) - 1, -1, -1):
            parts: list[int] = []
            for c in self.children[n] if depth[n] < DEEPEST else ():
                if not parts or parts[-1] != shapes[c]:
                    parts.append(shapes[c])
            shapes[n] = known.setdefault((self.labels[n], tuple(parts)), len(known))

        def number(n: int, count: list[int]) -> list:
            place[n] = count[0]
            count[0] += 1
            own, last = [], None
            for c in self.children[n] if depth[n] < DEEPEST else ():
                if last is not None and shapes[c] == shapes[last]:
                    same(c, last)
                else:
                    own.append(number(c, count))
                    last = c
            return [self.labels[n], own]

        def same(n: int, to: int) -> None:
            pairs = [(n, to)]
            while pairs:
                a, b = pairs.pop()
                place[a] = place[b]
                ours, theirs = (self.children[a], self.children[b]) if depth[a] < DEEPEST else ([], [])
                j = 0
                for i, c in enumerate(ours):
                    if i and shapes[c] != shapes[ours[i - 1]]:
                        j += 1
                        while j < len(theirs) and shapes[theirs[j]] == shapes[theirs[j - 1]]:
                            j += 1
                    pairs.append((c, theirs[min(j, len(theirs) - 1)]))

        tree = number(0, [0])
        for n in range(1, len(self.labels)):
            if depth[n] > DEEPEST:
                place[n] = place[self.parents[n]]
        self.skeleton = json.dumps(tree, separators=(",", ":"))
        self.blocks = [(place[n], text) for n, text in kept]


def _flat(tree: list) -> tuple[list[str], list[list[int]]]:
    """Labels and children of a skeleton's nodes in preorder."""
    labels, children, left = [], [], [(tree, -1)]
    while left:
        (label, own), parent = left.pop()
        n = len(labels)
        labels.append(label)
        children.append([])
        if parent >= 0:
            children[parent].append(n)
        left += [(c, n) for c in reversed(own)]
    return labels, children


def match(a: list, b: list) -> dict[int, int]:
    """Simple tree matching of two skeletons: preorder number in a -> preorder number in b of a largest matching."""
    (ours, ours_below), (theirs, theirs_below) = _flat(a), _flat(b)
    if ours[0] != theirs[0]:
        return {}
    score: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}  # nodes matched below and with the pair, and its children's pairs

    def near(i: int, j: int) -> list[tuple[int, int, int, int]]:
        """(place, place, child, child) of the children with equal labels near the diagonal."""
        x, y = ours_below[i], theirs_below[j]
        wide = max(BAND, 2 * len(y) // max(len(x), 1))
        mid = [p * len(y) // len(x) for p in range(len(x))]
        return [(p, q, x[p], y[q]) for p, m in enumerate(mid) for q in range(max(0, m - wide), min(len(y), m + wide + 1)) if ours[x[p]] == theirs[y[q]]]

    left = [(0, 0, False)]
    while left:
        i, j, ready = left.pop()
        if (i, j) in score:
            continue
        pairs = near(i, j)
        if not ready:
            left.append((i, j, True))
            left += [(c, d, False) for _, _, c, d in pairs if (c, d) not in score]
            continue
        width, rows = len(theirs_below[j]) + 1, {}
        for p, q, c, d in pairs:
            rows.setdefault(p, []).append((q, c, d))
        best, back = [0] * width, {}
        for p in range(len(ours_below[i])):
            after = list(best)
            taken = {q: (c, d) for q, c, d in rows.get(p, ())}
            for q in range(1, width):
                after[q] = max(best[q], after[q - 1])
                if q - 1 in taken and best[q - 1] + score[taken[q - 1]][0] > after[q]:
                    after[q] = best[q - 1] + score[taken[q - 1]][0]
                    back[p, q] = taken[q - 1]
                elif after[q] == after[q - 1] and after[q] > best[q]:
                    back[p, q] = None
            best = after
        found, p, q = [], len(ours_below[i]) - 1, width - 1
        while p >= 0 and q > 0:
            if (p, q) not in back:
                p -= 1
            elif back[p, q] is None:
                q -= 1
            else:
                found.append(back[p, q])
                p, q = p - 1, q - 1
        score[i, j] = 1 + best[-1], found
    out, left = {}, [(0, 0)]
    while left:
        i, j = left.pop()
        out[i] = j
        left += score[i, j][1]
    return out


_PARSED = "page_id long, url string, host string, page_hash long, skeleton string, nodes array<int>, texts array<string>"


def parsed(pages: DataFrame) -> DataFrame:
    """Blocks and skeleton of every page; page_hash is of the blocks' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, len(b), 200):
                part = b.slice(start, 200)
                got = [Page(x or "") for x in part.column(3).to_pylist()]
                same = pa.array([_key("\n".join(t for _, t in p.blocks)) for p in got], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), same, pa.array([p.skeleton for p in got]), pa.array([[n for n, _ in p.blocks] for p in got], pa.list_(pa.int32())), pa.array([[t for _, t in p.blocks] for p in got], pa.list_(pa.string()))], ["page_id", "url", "host", "page_hash", "skeleton", "nodes", "texts"])

    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit("")))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), "html").mapInArrow(run, _PARSED)


def _joined(rows: DataFrame, hosts: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    return rows.join(F.broadcast(hosts) if small else hosts, "host", how)


def _bytes(df: DataFrame, column: str) -> int:
    return df.agg(F.sum(F.length(F.col(column).cast("string")) + 64).alias("n")).first()["n"] or 0


class _Aligned:
    """Best seed of a skeleton and the seed's node of each of its nodes, remembered for each skeleton and list of seeds."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, str], tuple[int, dict[int, int]]] = {}

    def __call__(self, skeleton: str, seeds: list[str]) -> tuple[int, dict[int, int]]:
        key = skeleton, "\n".join(seeds)
        if key not in self.known:
            if len(self.known) > 5000:
                self.known.clear()
            if skeleton in seeds:
                self.known[key] = seeds.index(skeleton), {i: i for i in range(skeleton.count('["'))}
            else:
                tree = json.loads(skeleton)
                found = [match(tree, json.loads(x)) for x in seeds]
                best = max(range(len(seeds)), key=lambda i: (len(found[i]), -i))
                self.known[key] = best, found[best]
        return self.known[key]


def _key(text: str) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def extracted(pages: DataFrame, share: float = SHARE, least: int = PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = runtime.written(parsed(pages), "page-blocks")
    by_shape = rows.groupBy("host", "skeleton").agg(F.count("*").alias("n"))
    order = Window.partitionBy("host").orderBy(F.desc("n"), F.xxhash64("skeleton"), "skeleton")
    often = by_shape.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SEEDS)
    seeds = often.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "skeleton"))), lambda x: x["skeleton"]).alias("seeds"))
    seeds = runtime.written(seeds, "page-seeds")
    small = _bytes(seeds, "seeds") <= MOST_BROADCAST

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligned = _Aligned()
        for b in batches:
            hosts, places, keys, hashes = [], [], [], []
            for r in b.to_pylist():
                seed, to = aligned(r["skeleton"], r["seeds"])
                found = {(f"{seed}:{to[n]}", _key(t)) for n, t in zip(r["nodes"], r["texts"]) if n in to}
                for place, key in [*found, (f"{seed}", 0)]:  # the last row counts the page
                    hosts.append(r["host"])
                    places.append(place)
                    keys.append(key)
                    hashes.append(r["page_hash"])
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(places, pa.string()), pa.array(keys, pa.int64()), pa.array(hashes, pa.int64())], ["host", "place", "key", "page_hash"])

    full = rows.where(F.size("nodes") > 0).select("host", "page_hash", "skeleton", "nodes", "texts")
    same = _joined(full, seeds, small).select("host", "page_hash", "skeleton", "nodes", "texts", "seeds").mapInArrow(texts_of, "host string, place string, key long, page_hash long")
    same = same.distinct().groupBy("host", "place", "key").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    same = runtime.written(same.withColumn("seed", F.split("place", ":")[0]), "page-constants")
    counts = same.where(~F.contains("place", F.lit(":"))).select("host", "seed", F.col("n").alias("pages"))
    constant = same.where(F.contains("place", F.lit(":"))).join(counts, ["host", "seed"]).where(F.col("n") >= share * F.col("pages"))
    template = runtime.written(constant.groupBy("host").agg(F.collect_set(F.concat_ws(":", "place", F.col("key").cast("string"))).alias("constant")), "page-templates")
    wrappers = seeds.join(template, "host", "left").withColumn("constant", F.coalesce("constant", F.array().cast("array<string>")))

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligned = _Aligned()
        for b in batches:
            out = []
            for r in b.to_pylist():
                texts = r["texts"]
                if r["constant"]:
                    (seed, to), known = aligned(r["skeleton"], r["seeds"]), set(r["constant"])
                    texts = [t for n, t in zip(r["nodes"], texts) if f"{seed}:{to.get(n)}:{_key(t)}" not in known]
                out.append("\n".join(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    small = small and _bytes(template, "constant") <= MOST_BROADCAST
    return _joined(rows, wrappers, small, "left").select("page_id", "url", "skeleton", "nodes", "texts", "seeds", "constant").mapInArrow(contents, "page_id long, url string, text string, n_chars long")
