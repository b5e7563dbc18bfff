"""Conversation structure repair: cheapest edits by a dynamic programme over turns, time-major in numpy.

A conversation is well-formed if its roles' first letters read (s?(ua)+)?. Going backwards over the turns, the least
cost to finish is kept for each of the expression's four states, for all conversations of a length bucket at once; the
edits are then traced forwards, again for all at once, taking the ASCII-least of the cheapest (Delete, Insert, Keep,
Rerole). Conversations lie in turn order in a sorted partition and are worked on in batches of bounded size.

Conversations of more than LONG_ROWS rows or LONG_BYTES bytes of text go another way to the same result: equal rows are
counted first, all are dealt by ranges of turns, and each segment of SEGMENT rows yields its least costs between any
two states; chained from the last segment to the first, these give each segment the costs that follow it, so that all
segments are traced at once. Only the last step, whose hash is sequential by definition, reads a conversation in one
task, as a stream in turn order that holds a batch of rows (and one byte a turn of the audit).

Defined cases: null roles and texts count as one space, a null conv_id is a conversation of its own, null turns come
first; rows of one turn stand in the order of their roles and texts; roles are told by their first character; a turn's
crc32 key writes nulls as one space; conversations that lost all rows are returned with zeros, an empty audit and the
hash of the empty text; gaps stop at 2**63 - 1; an empty table gives no row; other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom import runtime

#: Rows and bytes of text from which a conversation is cut in segments, rows of a segment (a power of two), rows worked on at once.
LONG_ROWS, LONG_BYTES, SEGMENT, BATCH_ROWS, BATCH_BYTES = 8192, 16_000_000, 8192, 16_384, 16_000_000

_SPACE = " \t\n\x0b\f\r"
_FAR = np.int64(1) << 40
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. The state after the role that a state can take by Insert or Rerole.
_NEXT = np.array([2, 2, 3, 2])
#: The state after keeping a role (another, s, u, a); -1 where the state cannot take it.
_KEEP = np.array([[-1, 1, 2, -1], [-1, -1, 2, -1], [-1, -1, -1, 3], [-1, -1, 2, -1]])
_ROLES = {"s": 1, "u": 2, "a": 3}
#: Cost to finish after the last turn: all is well in states 0 and 3, two turns or one are missing in 1 and 2.
_END = np.array([0, 4, 2, 0])
_SUMS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
RESULT = "conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id {}, place long, role string, text string"


def costs(role: np.ndarray, forced: np.ndarray, extra: np.ndarray, live: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least cost to finish before each turn: turns + 1 x conversations x states.

    role: 0 to 3; forced: the turn must go; extra: what a turn that stays costs; live: False past a conversation's end
    (all turns x conversations). end: conversations x states.
    """
    turns, n = role.shape
    back = np.empty((turns + 1, n, 4), np.int64)
    back[turns] = end
    for t in range(turns - 1, -1, -1):
        after = back[t + 1]
        kept = _KEEP[:, role[t]].T
        keep = np.where((kept >= 0) & ~forced[t][:, None], np.take_along_axis(after, np.maximum(kept, 0), 1) + extra[t][:, None], _FAR)
        rerole = np.where(forced[t][:, None], _FAR, after[:, _NEXT] + extra[t][:, None] + 2)
        base = np.minimum(np.minimum(after + 3, keep), rerole)
        two, three = np.minimum(base[:, 2], base[:, 3] + 2), np.minimum(base[:, 3], base[:, 2] + 2)
        now = np.stack((np.minimum(base[:, 0], two + 2), np.minimum(base[:, 1], two + 2), two, three), 1)
        back[t] = np.where(live[t][:, None], np.minimum(now, _FAR), after)
    return back


def traced(back: np.ndarray, role: np.ndarray, forced: np.ndarray, extra: np.ndarray, live: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ASCII-least cheapest edits as one byte a turn (4 x inserts before it + 0 Delete, 1 Keep, 2 Rerole), and the last states."""
    turns, n = role.shape
    state, edits, every = start.copy(), np.zeros((turns, n), np.uint8), np.arange(n)
    for t in range(turns):
        after, open_ = back[t + 1], live[t].copy()
        while open_.any():
            best = back[t, every, state]
            gone = open_ & (after[every, state] + 3 == best)
            put = open_ & ~gone & (back[t, every, _NEXT[state]] + 2 == best)
            kept = _KEEP[state, role[t]]
            keep = open_ & ~gone & ~put & ~forced[t] & (kept >= 0) & (after[every, np.maximum(kept, 0)] + extra[t] == best)
            rerole = open_ & ~gone & ~put & ~keep
            edits[t] += (4 * put + keep + 2 * rerole).astype(np.uint8)
            state = np.where(put | rerole, _NEXT[state], np.where(keep, kept, state))
            open_ = put
    return edits, state


class Walk:
    """Carries out a conversation's edits, turn by turn, and counts what the result reports."""

    def __init__(self, conv: object, whole: bool):
        self.conv, self.sha, self.state, self.audit = conv, hashlib.sha256(), 0, []
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.turns = self.n = 0
        self.low = self.high = self.last = None
        self.kept = [] if whole else None

    def put(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.n else ''}{role}:{text}".encode())
        if self.kept is not None:
            self.kept.append((self.conv, self.n, role, text))
        self.n += 1

    def insert(self, times: int) -> None:
        for _ in range(times):
            self.put("assistant" if self.state == 2 else "user", "")
            self.state = int(_NEXT[self.state])
        self.cost += 2 * times

    def row(self, turn: int | None, role: str, text: str, copies: int, fault: int, edit: int) -> None:
        self.blank += copies if fault == 1 else 0
        self.duplicate += (copies if fault == 2 else copies - 1) if fault != 1 else 0
        self.truncated += fault == 3
        self.illegal += copies - 1 + (self.last is not None and (self.last, role[:1]) not in (("s", "u"), ("u", "a"), ("a", "u")))
        self.last = role[:1]
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        self.insert(edit >> 2)
        if edit & 3 == 1:
            self.put(role, text)
            self.state = int(_KEEP[self.state, _ROLES.get(role[:1], 0)])
        elif edit & 3 == 2:
            self.put("assistant" if self.state == 2 else "user", text)
            self.state = int(_NEXT[self.state])
        self.cost += (3, 0, 2)[edit & 3] + (fault == 3 and edit & 3 > 0) + 3 * (copies - 1)
        self.audit.append("I" * (edit >> 2) + "DKR"[edit & 3] + "D" * (copies - 1))

    def result(self) -> tuple:
        missing = int(_END[self.state]) // 2
        self.insert(missing)
        gaps = min(2**63 - 1, self.high - self.low + 1 - self.turns) if self.turns else 0
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit) + "I" * missing, self.sha.hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows with the faults that a checksum of conversation and turn picks; copies 0: dropped."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    code, role, text = F.crc32(key.cast("binary")) % 20, F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(code == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.when(code == 0, 0).when(code == 3, 2).otherwise(1).cast("long").alias("copies"))


def _faulty(rows: DataFrame) -> DataFrame:
    """With c (conv_id as text that is never null) and fault: 1 blank, 3 truncated, else 0; duplicates are told later."""
    last = F.right(F.rtrim("text", F.lit(_SPACE)), F.lit(1))
    c = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "copies")
    return rows.withColumns({"c": c, "fault": F.when(last == "", 1).when(last.isin(".", "!", "?"), 0).otherwise(3)})


def _solved(held: list[list[tuple]]) -> Iterator[tuple[int, np.ndarray]]:
    """(place in held, edits) of each conversation of (turn, role, text, copies, fault) rows."""
    buckets: dict[int, list[int]] = {}
    for i, rows in enumerate(held):
        if rows:
            buckets.setdefault((len(rows) - 1).bit_length(), []).append(i)
    for size, own in buckets.items():
        role, fault, live = np.zeros((1 << size, len(own)), np.int64), np.zeros((1 << size, len(own)), np.int64), np.zeros((1 << size, len(own)), bool)
        for j, i in enumerate(own):
            role[: len(held[i]), j] = [_ROLES.get(r[1][:1], 0) for r in held[i]]
            fault[: len(held[i]), j] = [r[4] for r in held[i]]
            live[: len(held[i]), j] = True
        forced, extra = (fault == 1) | (fault == 2), (fault == 3).astype(np.int64)
        back = costs(role, forced, extra, live, np.tile(_END, (len(own), 1)))
        edits, _ = traced(back, role, forced, extra, live, np.zeros(len(own), np.int64))
        for j, i in enumerate(own):
            yield i, edits[: len(held[i]), j]


def _rows(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out), schema)], schema=schema)


def _arrow(conv: str, whole: bool) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    first = pa.field("conv_id", kinds[conv])
    if whole:
        return pa.schema([first, ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    return pa.schema([first, *((x, pa.int64()) for x in _SUMS), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _usual(conv: str, whole: bool) -> Callable:
    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, names, held, seen, size, rows = _arrow(conv, whole), [], [], set(), 0, 0

        def flushed(names: list, held: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
            walks = [Walk(c, whole) for c in names]
            for i, edits in _solved(held):
                for r, e in zip(held[i], edits.tolist()):
                    walks[i].row(*r, e)
            out = [w.result() for w in walks]
            out = [r for w in walks for r in w.kept] if whole else out
            if out:
                yield _rows(out, schema)

        at = None
        for b in batches:
            for c, name, turn, role, text, copies, fault in zip(*(b.column(x).to_pylist() for x in ("c", "conv_id", "turn", "role", "text", "copies", "fault"))):
                if c != at:
                    if rows >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield from flushed(names, held)
                        names, held, size, rows = [], [], 0, 0
                    at, seen = c, set()
                    names.append(name)
                    held.append([])
                if copies:
                    fault = 2 if fault != 1 and (role, text) in seen else fault
                    seen.add((role, text))
                    held[-1].append((turn, role, text, copies, fault))
                    size, rows = size + len(text), rows + 1
        yield from flushed(names, held)

    return visit


def _flags(t: pa.Table) -> tuple[np.ndarray, ...]:
    """role, forced, extra, live of one segment, as four conversations of the same turns."""
    t = t.sort_by("pos")
    role, fault = (np.repeat(t.column(x).to_numpy().astype(np.int64)[:, None], 4, 1) for x in ("r", "fault"))
    return role, (fault == 1) | (fault == 2), (fault == 3).astype(np.int64), np.ones(role.shape, bool)


def _between(t: pa.Table) -> pa.Table:
    """Least costs from each state before a segment to each state after it."""
    back = costs(*_flags(t), np.where(np.eye(4, dtype=bool), 0, _FAR))[0]
    return pa.table({"c": t.column("c")[:1], "seg": t.column("seg")[:1], "m": pa.array([back.T.ravel().tolist()], pa.list_(pa.int64()))})


def _chained(t: pa.Table) -> pa.Table:
    """The costs to finish that follow each segment of a conversation."""
    t = t.sort_by("seg")
    after, out = _END, []
    for m in reversed(t.column("m").to_pylist()):
        out.append(after.tolist())
        after = np.minimum((np.array(m).reshape(4, 4) + after).min(1), _FAR)
    return pa.table({"c": t.column("c"), "seg": t.column("seg"), "after": pa.array(out[::-1], pa.list_(pa.int64()))})


def _segment(t: pa.Table) -> pa.Table:
    """A segment's edits from each of the four states before it."""
    flags = _flags(t)
    back = costs(*flags, np.tile(np.array(t.column("after")[0].as_py()), (4, 1)))
    edits, _ = traced(back, *flags, np.arange(4))
    return pa.table({"c": t.column("c")[:1], "seg": t.column("seg")[:1], "edits": pa.array([[edits[:, q].tobytes() for q in range(4)]], pa.list_(pa.binary()))})


def _long(conv: str, whole: bool) -> Callable:
    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, walk, at, edits = _arrow(conv, whole), None, None, None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["c"] != at:
                    if walk is not None:
                        last = walk.result()
                        out += walk.kept if whole else [last]
                    at, walk = r["c"], Walk(r["conv_id"], whole)
                if r["edits"] is not None:
                    edits = iter(r["edits"][walk.state])
                else:
                    walk.row(r["turn"], r["role"], r["text"], r["copies"], r["fault"], next(edits))
            if whole and walk is not None:
                out += walk.kept
                walk.kept = []
            if out:
                yield _rows(out, schema)
        if walk is not None:
            last = walk.result()
            out = walk.kept if whole else [last]
            if out:
                yield _rows(out, schema)

    return visit


def _long_rows(rows: DataFrame) -> DataFrame:
    """c, conv_id, seg, pos, edits, and a turn's columns: each segment's edits, then its turns."""
    key = F.sha2(F.concat_ws(":", F.char_length("role").cast("string"), "role", "text"), 256)
    counted = rows.where("copies > 0").groupBy("c", "conv_id", "turn", "role", "text", "fault").agg(F.sum("copies").alias("copies"))
    counted = runtime.written(counted.withColumn("k", key), "long_turns")
    first = counted.groupBy("c", "k").agg(F.min(F.struct(F.col("turn").isNotNull(), F.col("turn").alias("first"))).alias("f"), F.count("*").alias("n")).select("c", "k", "f.first", "n")
    seen = runtime.spread_join(counted, runtime.written(first, "first_turns"), ["c", "k"])
    seen = seen.withColumn("fault", F.when((F.col("fault") != 1) & ~F.col("turn").eqNullSafe(F.col("first")), 2).otherwise(F.col("fault"))).drop("k", "first")
    order = ["c", "turn", "role", "text"]
    placed = seen.repartitionByRange(runtime.shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    placed = runtime.written(placed.withColumn("seg", F.shiftright("pos", SEGMENT.bit_length() - 1)), "placed_turns")
    role = F.left("role", F.lit(1))
    flags = placed.select("c", "seg", "pos", F.when(role == "s", 1).when(role == "u", 2).when(role == "a", 3).otherwise(0).alias("r"), "fault")
    after = flags.groupBy("c", "seg").applyInArrow(_between, "c string, seg long, m array<long>").groupBy("c").applyInArrow(_chained, "c string, seg long, after array<long>")
    edits = flags.join(after, ["c", "seg"]).groupBy("c", "seg").applyInArrow(_segment, "c string, seg long, edits array<binary>")
    names = placed.groupBy("c", "seg").agg(F.first("conv_id").alias("conv_id"))
    return edits.join(names, ["c", "seg"]).unionByName(placed.withColumn("edits", F.lit(None).cast("array<binary>")), allowMissingColumns=True)


def _run(rows: DataFrame, whole: bool) -> DataFrame:
    conv = rows.schema["conv_id"].dataType.simpleString()
    schema = (TURNS if whole else RESULT).format(conv)
    rows = _faulty(rows)
    long = rows.groupBy("c").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).where((F.col("n") > LONG_ROWS) | (F.col("b") > LONG_BYTES)).select("c")
    long = runtime.written(long, "long_conversations")
    usual = rows
    if long.limit(1).count():
        usual = rows.join(runtime.sized(long), "c", "left_anti")
    order = ["c", "turn", "role", "text"]
    out = usual.select("c", "conv_id", "turn", "role", "text", "copies", "fault").repartition("c").sortWithinPartitions(*order).mapInArrow(_usual(conv, whole), schema)
    if not long.limit(1).count():
        return out
    mine = rows.join(runtime.sized(long), "c", "left_semi")
    found = _long_rows(mine).repartition("c").sortWithinPartitions("c", "seg", F.asc_nulls_first("pos")).mapInArrow(_long(conv, whole), schema)
    lost = mine.groupBy("c", "conv_id").agg(F.max("copies").alias("n")).where("n = 0").select("c", "conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("copies"), F.lit(0).alias("fault"))
    return out.unionByName(found).unionByName(lost.mapInArrow(_usual(conv, whole), schema))


def repaired(rows: DataFrame) -> DataFrame:
    """One row for each conversation of conv_id (integer or string), turn, role, text, copies: what was wrong, the edits, the result's hash."""
    return _run(rows, False)


def turns(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, text: the repaired conversations."""
    return _run(rows, True)
