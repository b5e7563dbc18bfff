"""Line deduplication by a log-template tree, in DataFrame operations alone.

Words of a line that hold a digit become a wildcard (unless all of them do: such a line stands for itself alone). The
tree has a fixed depth: number of words, then the first DEPTH words; its leaves are groups of lines. A leaf holds as
many templates as it has families of lines. In a round, every group of lines does one of two things. If AGREE of the
places behind the leading words or more (but not all) are fixed, and the fixed words together fit PEELED of its lines or
more, it has a template: a place is fixed if FIXED of the group's lines or more (a line counts once in a text) have the
same word there, of equally frequent words the one with the larger hash. The lines with the fixed words belong to the
template, all others stay a group for the next round. Otherwise, so also where equally frequent families would mix their
words, the group is split at the place where most of its lines have a word that min_docs lines share: by these words, and
one group of the rest. There are ROUNDS rounds at most; what none of them puts into a template is its own.

A template that occurs in min_docs different texts or more recurs: its lines are dropped from all of them but the
first (the smallest doc_id), so that copies of one text are no recurrence by themselves, and no line is lost
altogether. Lines and texts are told by 128 bits of hash.

Lines are parted by line feeds; white space in a line counts as one blank, and at its ends as none. Lines of fewer than
min_words words are never dropped, but for those of LONG characters or more (scripts without blanks). Defined cases: a
null text stays null and has no lines; an empty text stays empty; a text that loses all its lines becomes empty; the
rows stay as many as they were; rows with the same text are treated alike; a null doc_id comes last in the order;
columns whose names clash with working columns do not matter, as only text and doc_id are read, and the result joins on
the text's hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import runtime

#: Leading words in the tree, share of lines that fixes a place, share of fixed places behind them that makes a template, share of lines that it must fit.
DEPTH, FIXED, AGREE, PEELED = 3, 0.5, 0.5, 0.25
MIN_DOCS, MIN_WORDS = 3, 3
#: Rounds of templates and splits in a leaf; characters that make a line of few words long enough.
ROUNDS, LONG = 4, 40
#: Bytes of lost lines' numbers that may be broadcast.
MOST_BROADCAST = 32_000_000
WILD = "<*>"


def _masked(text: str) -> Column:
    """The text's lines with single blanks, and wildcards for words with a digit.

    The patterns run only on lines that need them, and each line is an array element, so that it is made once, whatever
    reads it.
    """
    gaps, trimmed = r"[ \t\r\f\x0B]+", lambda x: F.trim(x)
    single = F.transform(F.split(text, "\n"), lambda x: F.when(F.contains(x, F.lit("  ")) | x.rlike(r"[\t\r\f\x0B]"), F.regexp_replace(x, gaps, " ")).otherwise(x))
    wild = lambda x: F.regexp_replace(x, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", WILD)
    digits = lambda x: x.rlike("[0-9]") & x.rlike(r"(?<![^ ])[^ 0-9]++(?![^ ])")
    return F.transform(F.transform(single, trimmed), lambda x: F.when(digits(x), wild(x)).otherwise(x))


def _hash(c: str) -> list[Column]:
    """Two independent 64-bit hashes."""
    return [F.xxhash64(c), F.xxhash64(F.lit(1), F.col(c))]


def lines(documents: DataFrame, min_words: int) -> DataFrame:
    """d (doc_id), t, t2 (hashes of the text), i (line), masked, leaf, line, line2 (hashes)."""
    t, t2 = _hash("text")
    rows = documents.select(F.col("doc_id").alias("d"), t.alias("t"), t2.alias("t2"), F.posexplode(_masked("text")).alias("i", "masked"))
    rows = rows.withColumn("n", F.length("masked") - F.length(F.replace("masked", F.lit(" "))) + 1)
    rows = rows.where(((F.col("n") >= min_words) | (F.length("masked") >= LONG)) & (F.col("masked") != ""))
    line, line2 = _hash("masked")
    return rows.select("d", "t", "t2", "i", "masked", F.xxhash64("n", F.substring_index("masked", " ", DEPTH)).alias("leaf"), line.alias("line"), line2.alias("line2"))


def _rest(masked: str) -> Column:
    """Hashes of the words behind the leading ones."""
    return F.transform(F.slice(F.split(masked, " "), DEPTH + 1, 1 << 30), lambda w: F.xxhash64(w))


def families(texts: DataFrame, min_docs: int = MIN_DOCS, rounds: int = ROUNDS) -> DataFrame:
    """leaf, line, line2, family of the lines that belong to a template; texts: leaf, line, line2, rest (word hashes), n (texts with the line)."""
    left = texts.withColumn("node", F.col("leaf"))
    columns = ["leaf", "line", "line2", "rest", "n", "node"]
    out = None
    for turn in range(rounds):
        words = left.select("node", "n", F.posexplode("rest").alias("place", "word")).groupBy("node", "place", "word").agg(F.sum("n").alias("n"))
        often = F.sum(F.when(F.col("n") >= min_docs, F.col("n")).otherwise(0))
        places = words.groupBy("node", "place").agg(F.max(F.struct("n", "word")).alias("top"), F.sum("n").alias("all"), often.alias("often"), F.count("*").alias("kinds"))
        word = F.when(F.col("top.n") >= FIXED * F.col("all"), F.col("top.word"))
        # a place where all lines have one word splits nothing; of equal places, the first one
        split = F.max(F.when((F.col("kinds") > 1) & (F.col("top.n") >= min_docs), F.struct("often", (-F.col("place")).alias("at")))).alias("split")
        shape = F.transform(F.array_sort(F.collect_list(F.struct("place", word.alias("word")))), lambda x: x["word"]).alias("shape")
        nodes = places.groupBy("node").agg(shape, split, F.max("all").alias("all"))
        fixed = F.size(F.filter("shape", lambda x: x.isNotNull()))
        good = (fixed >= AGREE * F.size("shape")) & (fixed < F.size("shape"))
        nodes = runtime.written(nodes.select("node", "all", F.when(good, F.col("shape")).alias("shape"), (-F.col("split.at")).alias("at")).where(good | F.col("split.at").isNotNull()), "template-nodes")
        fits = F.coalesce(F.forall(F.zip_with("shape", "rest", lambda s, w: s.isNull() | (s == w)), lambda x: x), F.lit(False))
        met = runtime.written(left.join(runtime.sized(nodes), "node").withColumn("fits", fits), "template-lines")
        # a shape that mixes words of several families fits few lines or none: its group is split
        held = met.groupBy("node").agg(F.sum(F.when(F.col("fits"), F.col("n")).otherwise(0)).alias("fit"), F.first("all").alias("all"), F.first("at").alias("at"))
        enough = (F.col("fit") >= min_docs) & ((F.col("fit") >= PEELED * F.col("all")) | F.col("at").isNull())
        held = runtime.written(held.select("node", enough.alias("good")), "template-fits")
        met = met.join(runtime.sized(held), "node")
        own = met.where("good and fits").select("leaf", "line", "line2", F.col("node").alias("family"))
        out = own if out is None else out.unionByName(own)
        if turn == rounds - 1:
            break
        parts = met.where("not good and at is not null").withColumn("key", F.element_at("rest", (F.col("at") + 1).cast("int")))
        counts = parts.groupBy("node", "key").agg(F.sum("n").alias("held")).where(F.col("held") >= min_docs)
        again = met.where("good and not fits").withColumn("node", F.xxhash64("node", F.lit("rest")))
        parted = parts.join(runtime.sized(runtime.written(counts, "template-splits")), ["node", "key"], "left")
        parted = parted.withColumn("node", F.when(F.col("held").isNull(), F.xxhash64("node", F.lit("other"))).otherwise(F.xxhash64("node", "at", "key")))
        left = again.select(*columns).unionByName(parted.select(*columns))
        full = left.groupBy("node").agg(F.count("*").alias("kinds"), F.sum("n").alias("all")).where((F.col("kinds") > 1) & (F.col("all") >= min_docs)).select("node")
        full = runtime.written(full, "template-groups")
        if not full.limit(1).count():
            break
        left = runtime.written(left.join(runtime.sized(full), "node", "left_semi"), "template-left")
    return out


def recurring(documents: DataFrame, min_docs: int = MIN_DOCS, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """The written table of line hashes (t, t2, i, line, line2), and of the recurring ones (line, line2, first, first2: hashes of the text that keeps it)."""
    every = lines(documents, min_words)
    hashed = runtime.written(every.select("d", "t", "t2", "i", "leaf", "line", "line2"), "line-hashes")
    by_text = hashed.groupBy("leaf", "line", "line2", "t", "t2").agg(F.min("d").alias("d"))
    first = F.min_by(F.struct("t", "t2"), F.struct(F.col("d").isNull(), "d", "t", "t2")).alias("first")
    by_line = runtime.written(by_text.groupBy("leaf", "line", "line2").agg(F.count("*").alias("n"), first), "lines")
    leaves = by_line.groupBy("leaf").agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).where((F.col("kinds") > 1) & (F.col("n") >= min_docs)).select("leaf")
    leaves = runtime.sized(runtime.written(leaves, "leaves"))

    texts = every.join(leaves, "leaf", "left_semi").groupBy("leaf", "line", "line2").agg(F.first(_rest("masked")).alias("rest")).where(F.size("rest") > 0)
    texts = runtime.written(texts.join(by_line.select("line", "line2", "n"), ["line", "line2"]), "leaf-lines")
    grouped = runtime.written(families(texts, min_docs), "families")

    of_family = by_text.join(runtime.sized(grouped), ["leaf", "line", "line2"]).groupBy("family", "t", "t2").agg(F.min("d").alias("d"))
    of_family = of_family.groupBy("family").agg(F.count("*").alias("n"), first).where(F.col("n") >= min_docs)
    own = by_line.join(grouped, ["leaf", "line", "line2"], "left_anti").where(F.col("n") >= min_docs).select("line", "line2", "first")
    often = own.unionByName(grouped.join(of_family, "family").select("line", "line2", "first"))
    return hashed, runtime.written(often.select("line", "line2", F.col("first.t").alias("first"), F.col("first.t2").alias("first2")), "recurring-lines")


def deduplicated(documents: DataFrame, min_docs: int = MIN_DOCS, min_words: int = MIN_WORDS, counts: bool = False) -> DataFrame:
    """The documents with the lines of recurring templates taken out of their texts (and n_dropped, if counts).

    A text's lost lines are one row, whatever the number of its copies. All of them are broadcast if they have
    MOST_BROADCAST bytes or less; else those of texts with many copies are, so that no task gathers these copies
    (runtime.spread_join).
    """
    hashed, often = recurring(documents, min_docs, min_words)
    out = hashed.join(runtime.sized(often), ["line", "line2"]).where("t <> first or t2 <> first2")
    out = out.groupBy("t", "t2").agg(F.collect_set("i").alias("out"), F.count("*").alias("lost"))
    key, drop, own, own2, n = (runtime.unused(documents.columns, x) for x in ("text_key", "drop_lines", "text_hash", "text_hash2", "n_copies"))
    t, t2 = _hash("text")
    columns = [F.col(f"`{c}`") for c in documents.columns]
    keyed = documents.select(*columns, t.alias(own), t2.alias(own2))
    out = runtime.written(out.select(F.col("t").alias(own), F.col("t2").alias(own2), F.col("out").alias(drop), (F.col("lost") / F.size("out")).cast("long").alias(n)), "lost-lines")
    size = out.agg(F.sum(48 + 4 * F.size(drop))).first()[0] or 0
    if size <= MOST_BROADCAST:
        joined = keyed.join(F.broadcast(out.drop(n)), [own, own2], "left")
    else:
        joined = runtime.spread_join(keyed, out, [own, own2], "left", n)
    # both arrays are bound once for a text, not looked up anew for each line
    kept = lambda ls, gone: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), gone), lambda i: F.get(ls, i)), "\n")
    text = F.get(F.transform(F.array(F.split("text", "\n")), lambda ls: kept(ls, F.col(drop))), 0)
    text = F.when(F.col(drop).isNull(), F.col("text")).otherwise(text)
    columns = [text.alias(c) if c == "text" else F.col(f"`{c}`") for c in documents.columns]
    return joined.select(*columns, *([F.coalesce(F.size(drop), F.lit(0)).alias("n_dropped")] if counts else []))
