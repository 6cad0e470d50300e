"""Conversation repair against a dynamic program and full enumeration in plain Python."""

import hashlib
import random
import re
import zlib

from sparquill.llm import conversations as C
from tests.llm.helpers import rows

NEXT = {("s", "0"): "s", ("u", "0"): "u", ("u", "s"): "u", ("a", "u"): "a", ("u", "a"): "u"}
ROLE = {"u": "user", "a": "assistant"}
BLANKS = " \t\n\x0b\x0c\r"


def _program(turns):
    """(cost, audit, repaired lines) by the best prefix for each state; turns are (role, text, fault)."""
    states = {"0": (0, "", ())}

    def better(where, state, found):
        if state is not None and (state not in where or found[:2] < where[state][:2]):
            where[state] = found

    def insert():
        for _ in range(3):
            for state, (cost, audit, lines) in list(states.items()):
                for r in "ua":
                    better(states, NEXT.get((r, state)), (cost + 3, audit + "I", (*lines, ROLE[r] + ":")))

    for role, text, fault in turns:
        insert()
        new = {}
        for state, (cost, audit, lines) in states.items():
            better(new, state, (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            extra = 3 if fault == "truncated" else 0
            to = state if not role else NEXT.get((role[0], state))
            better(new, to, (cost + extra, audit + "K", (*lines, f"{role}:{text}")))
            for r in "ua":
                better(new, NEXT.get((r, state)), (cost + 3 + extra, audit + "R", (*lines, f"{ROLE[r]}:{text}")))
        states = new
    insert()
    return min((states[s] for s in "0a" if s in states), key=lambda f: f[:2])


def _enumerated(initials, faults):
    best = None

    def go(i, roles, cost, audit, inserted):
        nonlocal best
        if i == len(initials) and re.fullmatch("(s?(ua)+)?", "".join(roles)):
            best = min(best or (cost, audit), (cost, audit))
        for r in "ua" if inserted < 2 else "":
            go(i, [*roles, r], cost + 3, audit + "I", inserted + 1)
        if i == len(initials):
            return
        go(i + 1, roles, cost + 4, audit + "D", 0)
        if faults[i] in (C.SOUND, C.TRUNCATED):
            extra = 3 * (faults[i] == C.TRUNCATED)
            go(i + 1, [*roles, initials[i]], cost + extra, audit + "K", 0)
            for r in "ua":
                go(i + 1, [*roles, r], cost + 3 + extra, audit + "R", 0)

    go(0, [], 0, "", 0)
    return best


NAMES = ["", "blank", "duplicate", "truncated"]


def test_search_against_enumeration_and_program():
    r = random.Random(5)
    for n in range(1200):
        size = r.randrange(4) if n < 100 else r.randrange(13)
        initials = [r.choice(["s", "u", "a", "u", "a", "x", ""]) for _ in range(size)]
        faults = bytes(r.choice([0, 0, 0, 1, 2, 3]) for _ in range(size))
        found = C.repair(initials, faults)
        assert found == _program([(i, "t", NAMES[f]) for i, f in zip(initials, faults)])[:2]
        if n < 100:
            assert found == _enumerated(initials, faults)


def test_long_conversations_are_linear():
    r = random.Random(1)
    n = 5000
    initials, faults = [r.choice("sua") for _ in range(n)], bytes(r.choice([0, 0, 0, 1, 2, 3]) for _ in range(n))
    assert C.repair(initials, faults) == _program([(i, "", NAMES[f]) for i, f in zip(initials, faults)])[:2]
    bounds = C.suffix_bounds(initials, faults)
    cost = C.repair(initials, faults)[0]
    assert cost - C.INSERT <= bounds[0][0] <= cost


def _expected(data):
    """conv_id -> all columns, from (conv_id, turn, role, text) rows."""
    out = {}
    for conv in {d[0] for d in data}:
        kept = []
        for _, turn, role, text in (d for d in data if d[0] == conv):
            key = ":".join(" " if x is None else str(x) for x in (conv, turn))
            kind = zlib.crc32(key.encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
            for copy in range([1, 0][kind == 0] + (kind == 3)):
                digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
                kept.append((turn is not None, turn or 0, digest, copy, turn, role, text))
        kept.sort(key=lambda k: k[:4])
        seen, turns, counts = set(), [], dict.fromkeys(NAMES, 0)
        for *_, role, text in kept:
            bare = text.strip(BLANKS)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            turns.append((role, text, fault))
        numbers = [k[4] for k in kept if k[4] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(x[0][:1] + y[0][:1] not in ("su", "ua", "au") for x, y in zip(turns, turns[1:]))
        cost, audit, lines = _program(turns)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest)
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _check(spark, data, id_type="long"):
    df = spark.createDataFrame([(*d, 1, "x") for d in data], f"conv_id {id_type}, turn long, role string, text string, copy int, digest string")
    found = rows(C.repair_conversations(C.damaged(df)))
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in found} == _expected(data) and len(found) == len({d[0] for d in data})


def test_rows_against_plain_python(spark):
    r = random.Random(2)
    text = lambda: r.choice(["Yes.", "No!  ", "Cut", "", " \t\n", None, "été?\n", "a\nb.", f"Number {r.randrange(99)}."])
    role = lambda t: r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "User"]) if r.random() < 0.3 else ["user", "assistant"][t % 2]
    data = [(c, t if r.random() > 0.05 else None, role(t), text()) for c in [*range(120), None] for t in range(r.randrange(1, 12))]
    data += [(7, 1, "user", "Yes."), (7, 1, "user", "Yes."), (7, 1, "assistant", "Tie."), (500, None, None, None)]
    data += [(600, t, ["user", "assistant"][t % 2], f"Turn {t}." + "z" * 3000) for t in range(700)]
    data += [(c, 0, "user", "Hi.") for c in range(1000, 1100)]  # some of them are dropped whole
    _check(spark, data)


def test_other_ids_and_empty_tables(spark):
    _check(spark, [("a", 0, "user", "Hi."), ("a", 1, "assistant", "Ho."), ("", 3, "s", "x"), (None, None, "user", "")], "string")
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.repair_conversations(C.damaged(empty)).count() == 0
