"""Conversation repair against a plain row-by-row program over whole audits."""

import hashlib
import itertools
import random
import zlib

import pytest

from qualmark.llm import conv_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, n string, ord string, letters string"
NEXT = {"": ("u", "user"), "s": ("u", "user"), "u": ("a", "assistant"), "a": ("u", "user")}
BLANK = " \t\n\x0b\x0c\r"


def cheapest(turns):
    """turns: (role, text, fault). Least (cost, audit) with the lines written,
    every state's best edit string carried along."""
    def insert(states):
        states = dict(states)
        for _ in range(4):
            for q, (cost, audit, lines) in list(states.items()):
                to, name = NEXT[q]
                new = (cost + 5, audit + "I", (*lines, name + ":"))
                if to not in states or new[:2] < states[to][:2]:
                    states[to] = new
        return states

    states = insert({"": (0, "", ())})
    for role, text, fault in turns:
        new = {}

        def put(q, to):
            if q not in new or to[:2] < new[q][:2]:
                new[q] = to

        for q, (cost, audit, lines) in states.items():
            put(q, (cost + 2, audit + "D", lines))
            if fault not in ("B", "D"):
                extra, i = 5 if fault == "T" else 0, role[:1]
                if (i, q) in (("s", ""), ("u", ""), ("u", "s"), ("u", "a"), ("a", "u")):
                    put(i, (cost + extra, audit + "K", (*lines, f"{role}:{text}")))
                to, name = NEXT[q]
                put(to, (cost + 1 + extra, audit + "R", (*lines, f"{name}:{text}")))
        states = insert(new)
    return min((states[q] for q in ("", "a") if q in states), key=lambda v: v[:2])


def brute(rows, damaged=True):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        show = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        convs[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, turns in convs.items():
        turns.sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), v[2].encode()))
        seen, faults = set(), []
        for _, role, text in turns:
            bare = text.strip(BLANK)
            faults.append("B" if not bare else "D" if (role, text) in seen else "" if bare[-1] in ".!?" else "T")
            seen.add((role, text))
        at = [t for t, _, _ in turns if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]
        cost, audit, lines = cheapest([(r, x, f) for (_, r, x), f in zip(turns, faults)])
        out.append((conv, max(at) - min(at) + 1 - len(set(at)) if at else 0, *[faults.count(k) for k in "BDT"],
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def odd_rows():
    rng = random.Random(5)
    rows = []
    for conv, n in ((None, 80), (7, 900), (8, 80), (-4, 40)):
        for _ in range(n):
            turn = rng.choice([None, *range(60)]) if rng.random() < 0.5 else rng.randrange(500)
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", None, "", "ü"]),
                         rng.choice(["Yes.", "no", "", " \n", None, f"text {rng.randrange(30)}.", "What?", "é!\t"])))
    rows += [(9, 1, "user", "Same.")] * 300  # one turn, many copies
    rows += [(10, i, "user", f"x{i}.") for i in range(500)]  # one long run
    rows += [(11, i, "assistant", "x" * 200_000 + ".") for i in range(3)]
    for c in range(20, 120):
        rows += [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "b", f"c{t}?", f"d{t}!"]))
                 for t in range(rng.randrange(1, 9))]
    return rows


@pytest.mark.parametrize("partitions", [1, 23])
def test_against_plain(spark, partitions):
    """23 ranges cut the long conversations into many blocks."""
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    conf = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = sorted(map(tuple, cr.digest(df).collect()), key=str)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute(rows)


def test_empty_and_dropped(spark):
    empty = cr.digest(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = cr.digest(spark.createDataFrame([(gone, 0, "user", "Hi.", "", "", "")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_program_on_all_short_conversations():
    """Runs, powers and unrolling against the plain program, for every sequence
    of up to four symbols."""
    symbols = [r + f for r in "suao" for f in "-T"] + [cr.AGAIN]
    for size in range(5):
        for seq in itertools.product(symbols, repeat=size) if size < 4 else random.Random(1).sample(
                list(itertools.product(symbols, repeat=4)), 1500):
            turns = [("?" if s[0] == "o" else s[0], "t", {"-": "", "T": "T", "X": "B"}[s[1]]) for s in seq]
            steps = list(cr.unroll(cr.runs_of((s, 1) for s in seq)))
            audit = "".join(s[0] for s in steps) + cr.closing(steps[-1][2] if steps else 0)[0]
            assert audit == cheapest(turns)[1], seq


def test_run_matrix_is_the_product():
    for symbol in ("u-", "aT", cr.AGAIN):
        m = cr.UNIT
        for n in range(1, 40):
            m = cr.times(m, cr.power(symbol, 0))
            assert m == cr.run_matrix(symbol, n)


def test_repair_writes_turns(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Yes."), (2, 0, "user", "Hm?")]
    got = cr.repair(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)).orderBy("ord").collect()
    assert [(r.letters, [tuple(x) for x in r.repaired]) for r in got] == [
        ("K", [("K", "system", "Be brief.")]), ("R", [("R", "user", "Hello.")]), ("K", [("K", "assistant", "Yes.")]),
        ("D", [])]
