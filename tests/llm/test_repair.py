"""Conversation repair against a forward search over audits, by both ways through the operator."""

import hashlib
import random
import re
import zlib

import pytest

from corpusloom.llm import catalogue, repair

ROWS = "conv_id long, turn long, role string, text string, C int, pos string, fault int"
SPACE = " \t\n\x0b\x0c\r"


def spoilt(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def brute(rows):
    """All (cost, audit) pairs are kept for each prefix of role letters' automaton state: an independent forward search."""
    after = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    need = {0: "user", 1: "user", 2: "assistant", 3: "user"}
    result = []
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in spoilt(rows) if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.strip(SPACE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))

        def grown(states):
            states = dict(states)
            for _ in range(4):
                for q, (cost, audit, lines) in list(states.items()):
                    to = after[q][need[q][0]]
                    states[to] = min(states.get(to, (10**9,)), (cost + 2, audit + "I", lines + (need[q] + ":",)))
            return states

        states = grown({0: (0, "", ())})
        for (_, role, text), fault in zip(own, faults):
            now = {}

            def put(q, way):
                now[q] = min(now.get(q, (10**9,)), way)

            for q, (cost, audit, lines) in states.items():
                put(q, (cost + 3, audit + "D", lines))
                if fault in ("blank", "duplicate"):
                    continue
                more = fault == "truncated"
                if role[:1] in after[q]:
                    put(after[q][role[:1]], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
                put(after[q][need[q][0]], (cost + 2 + more, audit + "R", (*lines, f"{need[q]}:{text}")))
            states = grown(now)
        cost, audit, lines = min(states[q] for q in (0, 3) if q in states)
        turns = {r[0] for r in own} - {None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        result.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(result, key=str)


def made(seed=3):
    draw = random.Random(seed)
    says = ["Yes.", "No!", "And then", "  ", "", "Why?", "x", "ok \t\n.", "été.", None]
    rows = []
    for conv in range(60):
        for turn in range(draw.choice([1, 2, 3, 5, 9, 17])):
            rows.append((conv, draw.choice([turn, turn, turn, None, turn - 1]), draw.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "unknown"]), draw.choice(says), 1, "p", 7))
    for turn in range(300):  # a long one, with many equal turns
        rows.append((77, draw.choice([turn, turn, 5, None]), draw.choice(["user", "assistant", "user"]), draw.choice([*says, f"Turn {turn}."]), 1, "p", 7))
    rows += [(None, t, "user", "Hm.", 1, "p", 7) for t in range(9)] + [(78, 3, "user", "Again.", 1, "p", 7)] * 40
    gone = next(c for c in range(1000, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return rows + [(gone, 0, "user", "Lost.", 1, "p", 7), (79, 0, "user", "word " * 300_000 + "end.", 1, "p", 7)]


@pytest.mark.parametrize("long", [False, True])
def test_repair_is_brute_force(spark, monkeypatch, long):
    rows = made()
    if long:  # segments of 4 rows, from conversations of 6 on, and of one by its bytes
        monkeypatch.setattr(repair, "LONG_ROWS", 6)
        monkeypatch.setattr(repair, "LONG_BYTES", 1_000_000)
        monkeypatch.setattr(repair, "SEGMENT", 4)
    else:
        monkeypatch.setattr(repair, "BATCH_ROWS", 40)
    got = repair.repaired(repair.damaged(spark.createDataFrame(rows, ROWS)))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_long_conversation_without_rows_left(spark, monkeypatch):
    monkeypatch.setattr(repair, "LONG_ROWS", 2)
    conv = next(c for c in range(99999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(conv, 0, "user", f"Lost {t}.", 1, "p", 7) for t in range(4)], ROWS)
    assert list(map(tuple, repair.repaired(repair.damaged(df)).collect())) == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("long", [False, True])
def test_repaired_turns_give_the_hash(spark, monkeypatch, long):
    monkeypatch.setattr(repair, "LONG_ROWS", 6 if long else 8192)
    monkeypatch.setattr(repair, "SEGMENT", 4)
    df = repair.damaged(spark.createDataFrame([r for r in made(5) if r[0] != 79], ROWS))
    lines = {}
    for r in sorted(repair.turns(df).collect(), key=lambda r: (str(r.conv_id), r.place)):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert r.place == len(lines[r.conv_id]) - 1
    for r in repair.repaired(df).collect():
        own = lines.get(r.conv_id, [])
        assert hashlib.sha256("\n".join(own).encode()).hexdigest() == r.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in own))


def test_no_rows(spark):
    assert repair.repaired(repair.damaged(spark.createDataFrame([], ROWS))).count() == 0


def test_oracle(spark):
    import duckdb

    con = duckdb.connect()
    con.register("conversations", spark.createDataFrame(made(8), ROWS).where("conv_id is null or conv_id != 79").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    names = "conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256"
    assert sorted(con.execute(f"SELECT {names} FROM ({catalogue.OP12_SQL})").fetchall(), key=str) == brute([r for r in made(8) if r[0] != 79])
