"""Repairs against every possible audit, and against a plain table of whole audits."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from quernstone.llm import repair as module
from quernstone.llm.repair import Audits, Repair, damaged, repair

WORD = re.compile(r"[^\x20\x09-\x0D]")


def fate(rows):
    """The fault of each row (turn, role, text), in order."""
    seen, out = set(), []
    for _, role, text in rows:
        solid = WORD.findall(text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cost_of(rows, faults, audit):
    """The cost of an audit and what it makes of the rows; None if it isn't allowed."""
    size = len(audit.replace("D", ""))
    roles = [""] * size if size == 0 else ["s"] * (size % 2) + ["u", "a"] * (size // 2)
    if size == 1:
        return None
    at, where, cost, lines = 0, 0, 0, []
    for edit in audit:
        if edit != "I" and at == len(rows):
            return None
        cost += {"K": 0, "R": 3, "D": 4, "I": 3}[edit]
        if edit == "D":
            at += 1
            continue
        wanted = roles[where]
        where += 1
        if edit in "RI" and wanted == "s":
            return None
        speaker = {"u": "user", "a": "assistant"}.get(wanted)
        if edit == "I":
            lines.append(f"{speaker}:")
            continue
        _, role, text = rows[at]
        if faults[at] in ("blank", "duplicate") or edit == "K" and role[:1] != wanted:
            return None
        cost += 3 * (faults[at] == "truncated")
        lines.append(f"{role if edit == 'K' else speaker}:{text}")
        at += 1
    return (cost, "\n".join(lines)) if at == len(rows) else None


def exhaustive(rows):
    faults, best = fate(rows), None
    for length in range(2 * len(rows) + 3):
        for letters in product("KRDI", repeat=length):
            audit = "".join(letters)
            if (found := cost_of(rows, faults, audit)) and (best is None or (found[0], audit) < best[:2]):
                best = (found[0], audit, found[1])
    return best


def table(rows):
    """The same by a table of whole audits over positions and states; inserted turns by relaxing until nothing changes."""
    faults = fate(rows)
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    names = {"u": "user", "a": "assistant"}
    best = {0: (0, "", ())}

    def relax(best):
        changed = True
        while changed:
            changed = False
            for (state, letter), to in step.items():
                if letter != "s" and state in best:
                    new = (best[state][0] + 3, best[state][1] + "I", (*best[state][2], names[letter] + ":"))
                    if to not in best or new[:2] < best[to][:2]:
                        best[to], changed = new, True
        return best

    for (_, role, text), fault in zip(rows, faults):
        now, best = relax(best), {}
        for state, (cost, audit, lines) in now.items():
            ways = [(state, 4, "D", lines)]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if (state, role[:1]) in step:
                    ways.append((step[state, role[:1]], more, "K", (*lines, f"{role}:{text}")))
                ways += [(step[state, x], 3 + more, "R", (*lines, f"{names[x]}:{text}")) for x in "ua" if (state, x) in step]
            for to, price, edit, told in ways:
                new = (cost + price, audit + edit, told)
                if to not in best or new[:2] < best[to][:2]:
                    best[to] = new
    now = relax(best)
    won = min((now[s] for s in (0, 3) if s in now), key=lambda e: e[:2])
    return won[0], won[1], "\n".join(won[2])


def run(rows):
    machine, before = Repair(), None
    for row, fault in zip(rows, fate(rows)):
        machine.row(*row, fault == "blank", fault == "duplicate", fault == "truncated")
    return machine.result()


def drawn(rng, n):
    roles = ["user", "assistant", "system", "tool", " "]
    texts = ["Yes.", "No!", "cut", " ", "", "Well?", "ends. \n", "a", "b."]
    return sorted(((rng.choice([None, *range(n + 2)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


@pytest.mark.parametrize("seed", range(4))
def test_against_every_audit(seed):
    rng = random.Random(seed)
    for _ in range(6):
        rows = drawn(rng, rng.randrange(0, 4))
        cost, audit, told = exhaustive(rows)
        assert table(rows) == (cost, audit, told)
        found = run(rows)
        assert found[5:] == (cost, audit, hashlib.sha256(told.encode()).hexdigest())


@pytest.mark.parametrize("nodes", [40, 1 << 15])
def test_against_a_table(nodes, monkeypatch):
    monkeypatch.setattr(module, "NODES", nodes)  # 40: audits are written off while rows still come
    rng = random.Random(nodes)
    for _ in range(300):
        rows = drawn(rng, rng.randrange(0, 40))
        if rng.random() < 0.3:
            rows = [(i, rng.choice(["tool", "tool", "user"]), f"{i}.") for i in range(rng.randrange(60))]  # many ties
        cost, audit, told = table(rows)
        assert run(rows)[5:] == (cost, audit, hashlib.sha256(told.encode()).hexdigest())


def test_collisions_are_noticed(monkeypatch):
    monkeypatch.setattr(module, "PRIME", 7)
    rng = random.Random(1)
    for _ in range(100):
        rows = drawn(rng, rng.randrange(0, 25))
        assert run(rows)[5:7] == table(rows)[:2]


def test_common_prefix():
    audits = Audits()

    def node(text):
        at = 0
        for edit in text:
            at = audits.add(at, edit)
        return at

    rng = random.Random(3)
    for _ in range(300):
        start = "".join(rng.choice("DK") for _ in range(rng.randrange(40)))
        base = node(start)
        a, b = ["".join(rng.choice("DIKR") for _ in range(rng.randrange(12))) for _ in range(2)]

        def grown(at, text):
            for edit in text:
                at = audits.add(at, edit)
            return at

        assert audits.less(grown(base, a), grown(base, b)) == (start + a < start + b)


def test_a_long_conversation_is_fast():
    machine = Repair()
    for i in range(30_000):
        machine.row(i, "tool" if i % 3 else "user", f"{i}.", i % 5 == 0, False, i % 7 == 0)
    assert len(machine.audits.edit) < 300_000 and len(machine.result()[6]) >= 30_000


def expected(raw):
    """All of the result, from raw rows (conv_id, turn, role, text)."""
    out, rows = {}, {}
    for conv, turn, role, text in raw:
        rows.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if draw == 0:
            continue
        if draw == 1:
            text = ""
        if draw == 2:
            text = re.sub("[.!?]", "", text)
        if draw == 4:
            role = "user"
        rows[conv] += [(turn, role, text)] * (2 if draw == 3 else 1)
    for conv, kept in rows.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        cost, audit, told = table(kept)
        turns, faults = [t for t, _, _ in kept if t is not None], fate(kept)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[1][:1] for r in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(told.encode()).hexdigest())
    return out


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_whole_results(spark, few, monkeypatch):
    monkeypatch.setattr(module, "FEW", few)  # 0: repeated texts come by a shuffle
    rng = random.Random(5)
    raw = [(c, rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", None, "tool", ""]), rng.choice([None, "", "Yes.", "No", "é 😀!", "x ", "long " * 2000 + "."])) for c in range(40) for _ in range(rng.randrange(1, 12))]
    raw += raw[:20] + [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (99, 7, "user", "one."), (100, -(2**62), "user", "a."), (100, 2**62, "assistant", "b.")]
    raw += [(7000, t, "user" if t % 2 == 0 else "assistant", "Same." if t % 3 else "Other") for t in range(700)]
    df = spark.createDataFrame(raw, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS again", "2 AS content", "3 AS gone", "4 AS first_", "5 AS copy", "6 AS conv_")
    found = [tuple(r) for r in repair(damaged(df)).collect()]
    assert len(found) == len({r[0] for r in found})
    assert {r[0]: r[1:] for r in found} == expected(raw)


def test_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair(damaged(df)).collect() == []


def test_given_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    raw = [tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()]
    assert {r[0]: tuple(r)[1:] for r in repair(damaged(rows)).collect()} == expected(raw)
