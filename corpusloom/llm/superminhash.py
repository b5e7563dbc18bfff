"""Near-duplicates: SuperMinHash signatures, banding, verification on full sets, and union-find grouping.

1. Every text becomes its set of distinct word shingles (64-bit hashes; sets of two words or fewer are one shingle), a
   128-bit fingerprint of the set, and the keys of its signature's bands. 2. Texts with equal sets form a class and go
   on as one representative, the smallest id. 3. Representatives
   that share a band key hang on the key's smallest one; the components of these candidate links are the clusters in
   which links can lie (a miss of all bands at the threshold has a chance of MISS or less). 4. Inside each cluster
   links are confirmed on the full sets, and each task hands on a spanning forest, not pairs. A cluster that is too
   large for a task need not hold a link at all, as candidates chain (texts with much boilerplate in common). It is
   parted by prefixes: two sets that are similar enough share one of the 1 - t rarest parts of their shingles, which
   boilerplate is not. Texts that share a rare prefix shingle are confirmed pair by pair; those that share one with
   over GROUP others form a cluster of their own, which, if still too large, is dealt in blocks: all meet a block of
   pivots, and only texts that this leaves outside the cluster's largest component meet all blocks, so that a group
   of near copies costs in proportion to its size. 5. The components of the confirmed links give the classes.

Defined cases: null, empty and blank texts have size 0, are linked with nothing and stay; a null id takes part in
nothing, has a null component and stays; rows that repeat an id are separate texts with one component, and all of
them have kept true where the id is the component's smallest; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import runtime
from corpusloom.llm.arrays import Words, chunks, mix, released, sums
from corpusloom.llm.components import components, forest

#: Signature values in a band, and the chance of missing a pair at the threshold that sets the number of bands.
ROWS, MISS = 4, 1e-8
#: Texts of a cluster that are compared with each other in one task.
CLUSTER = 512
#: Bytes of their sets (6 for each shingle); a larger set is compared alone with each block.
CLUSTER_BYTES = 48_000_000
#: Texts that share a prefix shingle and are confirmed pair by pair; counts that order shingles by how rare they are.
GROUP, COUNTS = 64, 1 << 20
#: Ids of candidate texts that may be broadcast (16 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 2_000_000
#: Confirmed links (16 bytes each) that are reduced to one forest, whatever the task keys they come from.
FOREST = 10_000


def bands_for(threshold: float) -> int:
    return int(np.ceil(np.log(MISS) / np.log1p(-(threshold**ROWS))))


def shingles(raw: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and n + 1 offsets."""
    w = Words(raw, at)
    h, n = w.hashes(), np.diff(w.at)
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    full = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    row = w.texts()
    for i in range(k):
        full = mix(full * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(full)] + np.uint64(k - 1 - i))
    inside = row[: len(full)] == row[k - 1 :] if len(full) else np.zeros(0, bool)
    rows, values = [row[: len(full)][inside]], [full[inside]]
    short = np.flatnonzero((n > 0) & (n < k))
    for size in range(1, k):
        own = short[n[short] == size]
        part = np.zeros(len(own), np.uint64)
        for i in range(size):
            part = mix(part * np.uint64(0x9E3779B97F4A7C15) + h[w.at[own] + i] + np.uint64(size - 1 - i))
        rows.append(own)
        values.append(mix(part + np.uint64(size)))
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return value[first], np.searchsorted(row[first], np.arange(len(at)))


def signatures(value: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash: step j of each element's own random permutation offers j + r at the permutation's place j.

    All elements take a step together; a text stops when every place holds less than the next step could offer. The
    permutation is a Fisher-Yates shuffle, of which only the swaps so far are kept.
    """
    texts = len(at) - 1
    out = np.full((texts, m), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    row, h = np.repeat(np.arange(texts), np.diff(at)), value
    drawn, moved = [], []
    for j in range(m):
        x = mix(h + np.uint64((j + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
        k = j + ((x >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        here, there = np.full(len(k), j), k.copy()
        for d, v in zip(drawn, moved):
            here = np.where(d == j, v, here)
            there = np.where(d == k, v, there)
        np.minimum.at(flat, row * m + there, np.uint64(j << 32) | (x & np.uint64(0xFFFFFFFF)))
        open_ = (out.max(1) >> np.uint64(32)) > j
        on = open_[row]
        if not on.any():
            break
        drawn = [d[on] for d in drawn] + [k[on]]
        moved = [v[on] for v in moved] + [here[on]]
        row, h = row[on], h[on]
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    keys = np.empty((len(signature), bands), np.int64)
    for b in range(bands):
        key = np.full(len(signature), b + 1, np.uint64)
        for i in range(ROWS):
            key = mix(key * np.uint64(0x100000001B3) ^ signature[:, b * ROWS + i])
        keys[:, b] = key.view(np.int64)
    return keys


def _described(df: DataFrame, k: int, bands: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, end, raw, at in chunks(b.column(1)):
                value, own = shingles(raw, at, k)
                n = np.diff(own)
                keys = band_keys(signatures(value, own, bands * ROWS), bands)
                some = np.flatnonzero(n > 0)
                size = np.where(n > 0, bands, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(keys[some].reshape(-1)))
                prints = [sums(mix(value ^ np.uint64(s)), own).view(np.int64) for s in (0x5BD1E995, 0xC2B2AE35)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, end - start), pa.array(n.astype(np.int64)), pa.array(prints[0]), pa.array(prints[1]), lists], ["doc_id", "n_shingles", "f1", "f2", "bands"])

    return df.mapInArrow(released(run), "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>")


def _sets(df: DataFrame, k: int) -> DataFrame:
    """doc_id, cluster and the set as 48-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, end, raw, at in chunks(b.column(1)):
                value, own = shingles(raw, at, k)
                low = np.ascontiguousarray(value >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]
                packed = low.tobytes()
                data = [packed[6 * i : 6 * j] for i, j in zip(own[:-1], own[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, end - start), b.column(2).slice(start, end - start), pa.array(data, pa.binary())], ["doc_id", "cluster", "words"])

    return df.select("doc_id", "text", "cluster").mapInArrow(released(run), "doc_id long, cluster long, words binary")


def linked(sets: list[np.ndarray], left: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) with i < left and j != i of which 100 * intersection >= percent * union."""
    size = np.array([len(s) for s in sets], np.int64)
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    first = np.ones(len(flat), bool)
    first[1:] = flat[1:] != flat[:-1]
    word = np.cumsum(first) - 1
    often = np.bincount(word) > 1
    keep = often[word]
    word, row = (np.cumsum(often) - 1)[word[keep]], row[keep]
    both = np.zeros((left, len(sets)), np.float32)
    for start in range(0, int(often.sum()), 2048):  # counts below 2**24 are exact
        own = slice(*np.searchsorted(word, (start, start + 2048)))
        part = np.zeros((len(sets), 2048), np.float32)
        part[row[own], word[own] - start] = 1
        both += part[:left] @ part.T
    common = both.astype(np.int64)
    i, j = np.nonzero(100 * common >= percent * (size[:left, None] + size[None] - common))
    return i[i != j], j[i != j]


def _confirmed(rows: DataFrame, percent: int, parts: int) -> DataFrame:
    """Spanning forests (u, v) of the links in runs of task keys; rows: key, side (0: all links, 1: only with side 0), doc_id, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, met, n = None, [], [], 0

        def done() -> int:
            left = sum(x[0] == 0 for x in held)
            if left and len(held) > 1:
                sets = [_unpacked(x[2]) for x in held]
                ids = np.array([x[1] for x in held], np.int64)
                i, j = linked(sets, left, percent)
                if len(i):
                    met.append(forest(ids[i], ids[j]))
                    return len(met[-1][0])
            return 0

        def reduced() -> pa.RecordBatch:
            u, v = forest(*(np.concatenate(x) for x in zip(*met)))
            met.clear()
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for b in batches:
            for k, side, doc, words in zip(*(c.to_pylist() for c in b.columns)):
                if k != key:
                    n += done()
                    if n >= FOREST:
                        yield reduced()
                        n = 0
                    key, held = k, []
                held.append((side, doc, words))
        if n + done():
            yield reduced()

    dealt = rows.select("key", "side", "doc_id", "words").repartition(parts, "key").sortWithinPartitions("key", "side", "doc_id")
    return dealt.mapInArrow(released(run), "u long, v long")


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return np.unique(out.reshape(-1).view("<u8"))


def grouped(documents: DataFrame, k: int = 5, percent: int = 80, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row: k-word shingles, links at a Jaccard similarity of percent / 100."""
    spark = documents.sparkSession
    bands, parts = bands_for(percent / 100), runtime.shuffle_partitions(spark)
    texts = documents.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"))
    every = runtime.written(_described(texts, k, bands), "signatures")
    real = every.where("n_shingles > 0 and doc_id is not null")
    classes = runtime.written(real.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.count("*").alias("n")), "classes")

    keys = classes.select("rep", F.explode("bands").alias("key"))
    leaders = keys.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1").select("key", "leader")
    near = keys.join(leaders, "key").where("rep <> leader").select("rep", "leader").distinct()
    clusters = components(near)  # (node, root), without the roots
    members = clusters.unionByName(clusters.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("doc_id"), F.col("root").alias("cluster"))
    members = runtime.written(members, "clusters")
    count = members.count()
    if count <= MOST_BROADCAST:
        members = F.broadcast(members)
    own = runtime.written(_sets(texts.join(members, "doc_id"), k), "sets")

    large = _too_large(own)
    small = own.join(large, "cluster", "left_anti")
    links = None
    if large.limit(1).count():
        parted, links = _parted(own.join(large.select("cluster"), "cluster", "left_semi"), percent)
        large = _too_large(parted)
        small = small.unionByName(parted.join(large, "cluster", "left_anti"))
        if large.limit(1).count():
            links = links.unionByName(_in_blocks(parted.join(large, "cluster"), percent, parts))
    found = _confirmed(small.select(F.col("cluster").alias("key"), F.lit(0).alias("side"), "doc_id", "words"), percent, parts)
    roots = components(found if links is None else links.unionByName(found), reduced=True)

    named = classes.select("f1", "f2", "rep", "n").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    named = runtime.written(named.select("f1", "f2", "n", F.coalesce("root", "rep").alias("component")), "class-components")
    whole = runtime.spread_join(real, named, ["f1", "f2"])
    whole = whole.select("doc_id", "n_shingles", F.col("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))
    alone = every.where("not (n_shingles > 0 and doc_id is not null)")
    return whole.unionByName(alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))


def _too_large(own: DataFrame) -> DataFrame:
    """cluster, blocks of the clusters with over CLUSTER texts or CLUSTER_BYTES bytes."""
    sizes = own.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.length("words")).alias("b"))
    blocks = F.greatest(F.ceil(F.col("n") / CLUSTER), F.ceil(F.col("b") / CLUSTER_BYTES)).cast("int")
    return runtime.written(sizes.select("cluster", blocks.alias("blocks")).where("blocks > 1"), "large")


def _rows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (48 bits) of a column of packed sets, and n + 1 offsets."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    out = np.zeros(((at[-1] - at[0]) // 6, 8), np.uint8)
    if len(out):
        out[:, :6] = np.frombuffer(data, np.uint8)[at[0] : at[-1]].reshape(-1, 6)
    return out.reshape(-1).view("<u8"), (at - at[0]) // 6


def _parted(own: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, cluster, words of the texts with frequent prefix shingles, in new clusters; confirmed links u, v of all others)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTS, np.int64)
        for b in batches:
            total += np.bincount((_rows_of(b.column(0))[0] % np.uint64(COUNTS)).astype(np.int64), minlength=COUNTS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["place", "n"])

    counted = own.select("words").mapInArrow(count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # COUNTS rows at most
    often = np.zeros(COUNTS, np.int64)
    often[counted.column("place").to_numpy()] = counted.column("n").to_numpy()
    shared = own.sparkSession.sparkContext.broadcast(often)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = shared.value
        for b in batches:
            value, at = _rows_of(b.column(2))
            size = np.diff(at)
            row = np.repeat(np.arange(len(b)), size)
            order = np.lexsort((value, n[(value % np.uint64(COUNTS)).astype(np.int64)], row))
            keep = np.arange(len(value)) - at[row] < (size + (-percent * size) // 100 + 1)[row]
            value, row = value[order][keep], row[keep]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(value.view(np.int64)), pa.array(size[row])], ["doc_id", "cluster", "word", "size"])

    rows = runtime.written(own.select("doc_id", "cluster", "words").mapInArrow(prefixes, "doc_id long, cluster long, word long, size long"), "prefixes")
    groups = rows.groupBy("cluster", "word").agg(F.count("*").alias("n"), F.min("doc_id").alias("leader")).where("n > 1")
    groups = runtime.written(groups, "prefix-groups")
    few = rows.join(groups.where(F.col("n") <= GROUP).select("cluster", "word"), ["cluster", "word"])
    one, two = (few.select("cluster", "word", F.col("doc_id").alias(x), F.col("size").alias(f"n_{x}")) for x in "uv")
    alike = 100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v")
    pairs = runtime.written(one.join(two, ["cluster", "word"]).where(F.col("u") < F.col("v")).where(alike).select("u", "v").distinct(), "pairs")
    for x in "uv":
        pairs = pairs.join(own.select(F.col("doc_id").alias(x), F.col("words").alias(f"words_{x}")), x)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = np.zeros(len(b), bool)
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3))):
                x, y = _unpacked(x.as_py()), _unpacked(y.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = 100 * both >= percent * (len(x) + len(y) - both)
            u, v = forest(b.column(0).to_numpy()[good], b.column(1).to_numpy()[good])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    links = runtime.written(pairs.select("u", "v", "words_u", "words_v").mapInArrow(confirm, "u long, v long"), "pair-links")
    many = rows.join(groups.where(F.col("n") > GROUP), ["cluster", "word"]).select("doc_id", "leader").distinct()
    near = components(many)
    members = near.unionByName(near.select(F.col("root").alias("node"), "root").distinct())
    parted = own.drop("cluster").join(members.select(F.col("node").alias("doc_id"), F.col("root").alias("cluster")), "doc_id")
    return runtime.written(parted.select("doc_id", "cluster", "words"), "parted"), links


def _in_blocks(own: DataFrame, percent: int, parts: int) -> DataFrame:
    """Spanning forests of the links in clusters that are dealt in blocks (column blocks)."""
    blocked = own.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    every_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with")
    pivots = blocked.where("block = 0").select("*", every_block).select(F.xxhash64("cluster", "with").alias("key"), F.lit(0).alias("side"), "doc_id", "words")
    others = blocked.where("block > 0").select(F.xxhash64("cluster", "block").alias("key"), F.lit(1).alias("side"), "doc_id", "words")
    first = runtime.written(_confirmed(pivots.unionByName(others), percent, parts), "first-links")
    named = _labelled(blocked, components(first))
    shares = named.groupBy("cluster", "label").agg(F.count("*").alias("c"))
    main = shares.groupBy("cluster").agg(F.max(F.struct("c", "label")).alias("m")).select("cluster", F.col("m.label").alias("main"))
    split = runtime.written(named.join(main, "cluster").withColumn("out", F.col("label") != F.col("main")).drop("label", "main"), "split")
    left = split.where("out")
    rest = left.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / CLUSTER), F.ceil(F.sum(F.length("words")) / CLUSTER_BYTES)).cast("int").alias("sides"))
    left = left.join(rest, "cluster").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("sides")).cast("int"))
    asked = left.select("*", every_block).select(F.xxhash64("cluster", "part", "with").alias("key"), F.lit(0).alias("side"), "doc_id", "words")
    against = split.join(rest, "cluster").select("*", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("part")).select(F.xxhash64("cluster", "part", "block").alias("key"), F.lit(1).alias("side"), "doc_id", "words")
    return first.unionByName(_confirmed(asked.unionByName(against), percent, parts))


def _labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("root", "doc_id")).drop("root")


def deduplicated(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents without all but one of each group: the row with the smallest doc_id, and of rows that share it, the first by text."""
    kept = grouped(documents, k, percent).where("kept").select("doc_id").distinct()
    stay = documents.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    rank = runtime.unused(documents.columns, "rank_in_group")
    stay = stay.withColumn(rank, F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where(F.col(rank) == 1).drop(rank)
    return stay.unionByName(documents.where("doc_id is null"))
