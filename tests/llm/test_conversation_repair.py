import heapq
import hashlib
import random
import re
import zlib
from itertools import product

import duckdb
import pytest

from mercato.llm import conversation_repair as op

SCHEMA = "conv_id long, turn long, role string, text string, letter string, copy int, a string"


def best(letters):
    """Dijkstra over (row, state), cheapest cost, then ASCII-least audit."""
    steps = {("0", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a", ("0", "s"): "s"}
    heap, done = [(0, "", 0, "0")], set()
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(letters) and q in "0a":
            return cost, audit
        for (p, x), new in steps.items():
            if p == q and x != "s":
                heapq.heappush(heap, (cost + 3, audit + "I", i, new))
        if i < len(letters):
            x = letters[i]
            extra = 3 if x.isupper() else 0
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q))
            if x != "-":
                for (p, y), new in steps.items():
                    if p == q and y == x.lower():
                        heapq.heappush(heap, (cost + extra, audit + "K", i + 1, new))
                    elif p == q and y != "s":
                        heapq.heappush(heap, (cost + extra + 3, audit + "R", i + 1, new))


def test_every_short_conversation_against_search():
    for n in range(5):
        for letters in product("suaUAx-", repeat=n):
            assert op.repair("".join(letters)) == best("".join(letters)), letters


@pytest.mark.parametrize("block", [1, 2, 5, 40])
def test_blocks_of_a_long_conversation_give_the_same(block):
    rng = random.Random(block)
    for n in (3, 11, 26, 39):
        for weights in ((1, 5, 5, 1, 1, 1, 1, 1), (1, 1, 1, 1, 1, 1, 3, 3)):
            letters = "".join(rng.choices("suaSUAx-", weights, k=n))
            assert op.repair(letters, block) == best(letters)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        n = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if n == 0:
            continue
        text = "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text
        out += [(conv, turn, "user" if n == 4 else role, text)] * (2 if n == 3 else 1)
    return out


def expected(rows, original=None):
    out = []
    for conv in {r[0] for r in (original if original is not None else rows)}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, letters, faults = set(), [], []
        for _, _, role, text in own:
            ended = text.rstrip(" \t\n\v\f\r")
            fault = ("blank" if not ended else "duplicate" if (role, text) in seen
                     else "truncated" if ended[-1] not in ".!?" else "")
            seen.add((role, text))
            x = role[:1] if role[:1] and role[:1] in "sua" else "x"
            letters.append("-" if fault in ("blank", "duplicate") else x.upper() if fault else x)
            faults.append(fault)
        cost, audit = best("".join(letters))
        turns = {r[1] for r in own if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        size, made, i = len(audit) - audit.count("D"), [], 0
        for edit in audit:
            new = "su"[1] if not size % 2 else "s"
            k = len(made) - size % 2
            new = "s" if k < 0 else ("user", "assistant")[k % 2]
            if edit == "I":
                made.append(f"{new}:")
                continue
            _, _, role, text = own[i]
            i += 1
            if edit != "D":
                made.append(f"{role if edit == 'K' else new}:{text}")
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
                    hashlib.sha256("\n".join(made).encode()).hexdigest()))
    return sorted(out, key=repr)


NAMES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def found(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=repr)


def awkward():
    rng = random.Random(4)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(1, 8)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "ünï"])
            text = rng.choice(["Yes.", "No", " \n", "", None, "Why? \t", "Ö!", f"t{turn}.", "x " * 3000 + "."])
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), role, text))
    rows += rows[:20]
    rows += [(99, t, "ua"[t % 2] + "x", f"{t}{'.' if t % 7 else ''}") for t in range(300)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z", 3, "y") for r in rows], SCHEMA)


def test_awkward_conversations_against_search(spark):
    rows = awkward()
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert found(op.repair_conversations(frame(spark, rows))) == expected(plain)


def test_damage_and_repaired_rows(spark):
    rows = awkward()
    hurt = op.damaged(op.plain(frame(spark, rows)))
    assert sorted(((r.conv_id, r.turn, r.role, r.text) for r in hurt.collect()), key=repr) == sorted(damage(rows), key=repr)
    made = {}
    for r in sorted(op.repaired_rows(hurt).collect(), key=lambda r: r.position):
        made.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in op.repair_conversations(hurt).collect():
        assert hashlib.sha256("\n".join(made.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256


def test_query_against_search_and_sql_on_awkward_rows(spark, tmp_path):
    rows = awkward()
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = found(op.op12_conversation_repair(spark, str(tmp_path)))
    assert got == expected(damage(rows), rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT conv_id, turn, role, text FROM '{tmp_path}/conversations.parquet/*.parquet'")
    sql = con.execute(op.ORACLE_SQL["op12_conversation_repair"]).fetchall()
    assert sorted(sql, key=repr) == got


def test_empty_table(spark):
    assert op.repair_conversations(frame(spark, [])).count() == 0
    assert op.repaired_rows(frame(spark, [])).count() == 0
