from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

from evidloom.llm.conversation_repair import BEGIN, Repair, damaged_turns, repair_report, repaired_turns, step

SCHEMA = "conv_id long, turn long, role string, text string"
WHOLE = re.compile("(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        out += [(conv, turn, "user" if f == 4 else role, text)] * (f != 0) * (2 if f == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        inner = text.strip(SPACE)
        out.append(1 if not inner else 2 if (role, text) in seen else 0 if inner[-1] in ".!?" else 3)
        seen.add((role, text))
    return out


def cheapest(rows, fault):
    """Least (cost, edits, repaired) over all ways, grown from the front by whole strings."""
    best = None
    names = {"u": "user", "a": "assistant"}
    limit = 4 * len(rows) + 7

    def grow(at, roles, cost, edits, lines):
        nonlocal best
        if cost > (best[0] if best else limit):
            return
        if at == len(rows):
            if WHOLE.fullmatch(roles):
                found = (cost, edits, lines)
                if best is None or found[:2] < best[:2]:
                    best = found
        else:
            role, text = rows[at][2], rows[at][3]
            grow(at + 1, roles, cost + 4, edits + "D", lines)
            if fault[at] not in (1, 2):
                pay = 3 if fault[at] == 3 else 0
                if role[:1] in ("s", "u", "a") and not (role[0] == "s" and roles):
                    grow(at + 1, roles + role[0], cost + pay, edits + "K", lines + [f"{role}:{text}"])
                for new in "ua":
                    grow(at + 1, roles + new, cost + 3 + pay, edits + "R", lines + [f"{names[new]}:{text}"])
        for new in "ua":
            if not (roles and roles[-1] == new):
                grow(at, roles + new, cost + 3, edits + "I", lines + [f"{names[new]}:"])

    grow(0, "", 0, "", [])
    return best


def order(row):
    return (row[1] is not None, row[1] or 0, hashlib.md5(f"{row[2]}\0{row[3]}".encode()).hexdigest())


def brute(rows):
    out = []
    kept = damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in kept if r[0] == conv), key=order)
        fault = faults(own)
        turns = {r[1] for r in own} - {None}
        roles = [r[2][:1] for r in own]
        cost, edits, lines = cheapest(own, fault)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, fault.count(1), fault.count(2), fault.count(3),
                    sum(x + y not in ("su", "ua", "au") for x, y in itertools.pairwise(roles)), cost, edits,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def some_rows(n=120, seed=4):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "Why?", " \t", "", None, "Ünï!", "a\nb", "done. "]
    rows = []
    for conv in range(n):
        for _ in range(rng.randint(1, 5)):
            turn = rng.choice([None, 0, 1, 2, 2, 3, 9, 2**40])
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), rng.choice(texts)))
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (-5, None, None, None), (700, 1, "user", "x" * 200_000)]
    return rows + rows[:4]


def test_against_all_edit_sequences(spark):
    rows = some_rows()
    turns = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = brute(rows)
    for block in (1, 2, 1 << 16):
        got = repair_report(damaged_turns(turns), turns, block).drop("n_turns").collect()
        assert sorted(map(tuple, got), key=repr) == want


def test_giant_conversation_in_blocks(spark):
    rng = random.Random(9)
    rows = [(1, i // 2, rng.choice(["user", "assistant"]), f"line {rng.randint(0, 2500)}" + rng.choice(".?,")) for i in range(6000)]
    frame = spark.createDataFrame(rows + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")], SCHEMA)
    small, large = (repair_report(frame, block=b).collect() for b in (250, 1 << 16))
    assert sorted(small) == sorted(large)
    giant = next(r for r in small if r.conv_id == 1)
    ordered = sorted(rows, key=order)
    assert giant.duplicate == faults(ordered).count(2)
    # the cost of a plain forward table over the same rows
    fault, costs = faults(ordered), {"": 0}
    for (_, _, role, _), f in zip(ordered, fault, strict=True):
        after = {}

        def put(state, cost, after=after):
            after[state] = min(cost, after.get(state, cost))

        for state in ("", "u", "a"):
            if state in costs:
                put(state, costs[state] + 4)
        pay = 3 if f == 3 else 0
        for state, cost in list(costs.items()):
            for pre, extra in ((state, 0), ("a" if state == "u" else "u", 3)):
                want = "a" if pre == "u" else "u"
                if f not in (1, 2):
                    put(want, cost + extra + pay + (0 if role[0] == want else 3))
        closed = dict(after)
        for state, cost in after.items():
            other = "a" if state == "u" else "u"
            closed[other] = min(closed.get(other, 1 << 60), cost + 3)
        costs = closed
    assert giant.cost == min(costs.get("", 1 << 60), costs["a"], costs["u"] + 3)
    turns = sorted(((r.place, r.edit, r.role, r.text) for r in repaired_turns(frame, block=250).where("conv_id = 1").collect()))
    assert [t[0] for t in turns] == list(range(1, giant.n_turns + 1))
    assert re.fullmatch("(s?(ua)+)?", "".join(t[2][0] for t in turns))
    assert hashlib.sha256("\n".join(f"{t[2]}:{t[3]}" for t in turns).encode()).hexdigest() == giant.repaired_sha256
    assert "".join(t[1] for t in turns) == giant.audit.replace("D", "")


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair_report(damaged_turns(none), none).collect() == []
    assert repaired_turns(none).collect() == []
    only = spark.createDataFrame([(4, 1, "user", "Hi.")], SCHEMA)
    row = repair_report(none, only).first()
    assert tuple(row) == (4, 0, 0, 0, 0, 0, 0, "", 0, hashlib.sha256(b"").hexdigest())
    odd = spark.createDataFrame([(1, 0, "user", "Hi.", "x", 3, 2.0), (1, 1, "assistant", "Ho.", "y", 4, 1.0)],
                                SCHEMA + ", kind string, place int, cost double")
    assert repair_report(damaged_turns(odd), odd).first().conv_id == 1
    assert [r.edit for r in repaired_turns(odd).orderBy("place").collect()] == ["K", "K"]


def test_a_choice_is_one_byte():
    seen = {step(c, role, fault)[1] for c in itertools.product((0, 3, 6), repeat=4) for role in range(4) for fault in range(4)}
    assert max(seen) < 256
    walk = Repair("1", None)
    assert walk.state == BEGIN
    assert list(walk.end()) == []
