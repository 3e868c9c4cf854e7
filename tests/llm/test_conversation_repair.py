"""Conversation repair against plain versions."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from feedlake.llm import conversation_repair as C
from feedlake.llm import queries as Q

LEGAL = re.compile(r"(s?(ua)+)?\Z")


def faults(turns):
    seen, out = set(), []
    for role, text in turns:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def plain(turns):
    """Cheapest cost, least audit and repaired lines of turns (role, text): plain strings, state by state."""
    fault = faults(turns)
    best = {"": (0, "", ())}                    # legal prefix, shortened to what matters -> (cost, audit, lines)

    def short(x):
        return x if len(x) < 2 else x[-1]

    def offer(to, key, value):
        if key not in to or value[:2] < to[key][:2]:
            to[key] = value
            return True
        return False

    def legal(state, role):
        return (state, role) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}

    def insert(to):
        again = True
        while again:
            again = any([offer(to, r, (to[s][0] + 3, to[s][1] + "I", to[s][2] + (f"{n}:",)))
                         for s in list(to) for r, n in (("u", "user"), ("a", "assistant")) if legal(s, r)])

    insert(best)
    for (role, text), f in zip(turns, fault):
        new = {}
        more = 3 if f == "truncated" else 0
        for s, (cost, audit, lines) in best.items():
            offer(new, s, (cost + 4, audit + "D", lines))
            if f not in ("blank", "duplicate"):
                if legal(s, role[:1]):
                    offer(new, role[:1], (cost + more, audit + "K", lines + (f"{role}:{text}",)))
                for r, n in (("u", "user"), ("a", "assistant")):
                    if legal(s, r):
                        offer(new, r, (cost + 3 + more, audit + "R", lines + (f"{n}:{text}",)))
        insert(new)
        best = new
    return min(v for k, v in best.items() if k in ("", "a"))


def exhaustive(turns):
    """Every way of edits, up to two insertions at a place."""
    fault = faults(turns)
    best = None
    for kinds in itertools.product("KRD", repeat=len(turns)):
        for gaps in itertools.product(range(3), repeat=len(turns) + 1):
            cost, n = 3 * sum(gaps), sum(gaps) + sum(k != "D" for k in kinds)
            audit, roles = "I" * gaps[0], ["?"] * gaps[0]
            for k, (role, _), f, g in zip(kinds, turns, fault, gaps[1:]):
                if k != "D" and f in ("blank", "duplicate"):
                    break
                cost += {"K": 0, "R": 3, "D": 4}[k] + (3 if k != "D" and f == "truncated" else 0)
                audit += k + "I" * g
                roles += ([] if k == "D" else [role[:1]] if k == "K" else ["?"]) + ["?"] * g
            else:
                want = ("s" if n % 2 else "") + "ua" * (n // 2)
                if LEGAL.match(want) and all(x == y or (x == "?" and y != "s") for x, y in zip(roles, want)) and (best is None or (cost, audit) < best):
                    best = cost, audit
    return best


def drawn(r, n):
    say = ["Yes.", "no", "Why?", " \t", "", "Go!", "and\n", "So. ", "é."]
    return [(r.choice(["user", "assistant", "user", "assistant", "system", "tool", "sys", "", " "]), r.choice(say) if r.random() < .7 else f"t{r.randrange(99)}.") for _ in range(n)]


def test_plain_version_against_every_way():
    r = random.Random(1)
    for _ in range(60):
        turns = drawn(r, r.randint(0, 4))
        assert plain(turns)[:2] == exhaustive(turns)


def test_least_audits():
    r = random.Random(2)
    for _ in range(400):
        turns = drawn(r, r.randint(1, 40))
        ends = {s: (c, a) for s, c, a in C.repaired_from(C.NONE, [(x[:1], f) for (x, _), f in zip(turns, faults(turns))])}
        assert min(ends[s] for s in (C.NONE, C.ASSISTANT) if s in ends) == plain(turns)[:2]


def test_audit_order_verifies_hashes(monkeypatch):
    monkeypatch.setattr(C, "MODULUS", 5)        # hashes that collide nearly always
    r = random.Random(3)
    a = C.Audits()
    nodes = [0]
    for _ in range(300):
        nodes.append(a.add(r.choice(nodes), r.choice("DK")))
    for _ in range(3000):
        x, y = r.choice(nodes), r.choice(nodes)
        assert a.less(x, y) == (a.text(x) < a.text(y))


def illegal(turns):
    return sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))


@pytest.mark.parametrize("chunk", [1, 3, 2048])
def test_report_and_turns(spark, monkeypatch, chunk):
    """Conversations cut into chunks and over tasks, with nulls, ties and repeated rows."""
    monkeypatch.setattr(C, "CHUNK", chunk)
    r = random.Random(4)
    rows = []
    for conv in [None, *range(40)]:
        for k, (role, text) in enumerate(drawn(r, r.choice([1, 2, 5, 30]))):
            rows.append((conv, None if r.random() < .1 else k * r.choice([1, 1, 2]), None if role == " " else role, None if text == "" else text))
    rows += rows[::7]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit("x")).withColumn("part", F.lit(1))
    want, lines = {}, {}
    for conv in {x[0] for x in rows}:
        own = sorted(((t is not None, t or 0, " " if role is None else role, " " if text is None else text) for c, t, role, text in rows if c == conv))
        turns, f = [x[2:] for x in own], faults([x[2:] for x in own])
        cost, audit, out = plain(turns)
        numbers = {x[1] for x in own if x[0]}
        key = None if conv is None else str(conv)
        lines[key] = list(out)
        want[key] = (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, f.count("blank"), f.count("duplicate"), f.count("truncated"),
                     illegal(turns), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())
    shuffled = df.repartition(6)
    assert {x[0]: tuple(x)[1:] for x in C.repair_report(shuffled).collect()} == want
    if chunk == 3:
        got = sorted((x for x in C.repaired_turns(shuffled).collect()), key=lambda x: x.place)
        assert {k: [f"{x.role}:{x.text}" for x in got if x.conv_id == k] for k in lines} == lines


def test_damage(spark):
    rows = [(c, t, r, x) for c in (None, 3, 4) for t in (None, *range(30)) for r, x in (("user", "Is. it! so?"), (None, None))]
    got = C.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", " " if x is None else x
        if k:
            want += [(c, t, "user" if k == 4 else r, "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x)] * (2 if k == 3 else 1)
    key = lambda x: tuple((y is None, y or 0) if not isinstance(y, str) else y for y in x)
    assert sorted((tuple(x) for x in got), key=key) == sorted(want, key=key)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.repair_report(df).collect() == [] and C.repaired_turns(df).collect() == []


def test_conversation_lost_to_the_damage(spark, tmp_path):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(lost, 0, "user", "x.")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    r = Q.REGISTRY["op11_conversation_repair"](spark, str(tmp_path)).first()
    assert tuple(r) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
