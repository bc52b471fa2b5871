"""Repair of conversations against a search through all edits by cost."""

import hashlib
import random
import re
import zlib

from stintlake.llm import repair

TURNS = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    out = []
    for conv_id, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv_id, turn))
        fate = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if fate == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fate, text)
        out += [(conv_id, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def cheapest(rows, faults):
    """The least (cost, audit, texts) by dynamic programming from the end, states as role strings."""
    best = {"": (0, "", ()), "a": (0, "", ())}  # behind the last row: accepted states

    def spread(best):
        """Inserts before what stands next; twice is enough to reach any state."""
        out = dict(best)
        for _ in range(3):
            for state in ("", "s", "u", "a"):
                new, role = ("a", "assistant") if state == "u" else ("u", "user")
                if new in out:
                    cost, audit, texts = out[new]
                    way = cost + 5, "I" + audit, ((role, ""), *texts)
                    out[state] = min(out.get(state, way), way)
        return out

    best = spread(best)
    for (_, _, role, text), fault in reversed(list(zip(rows, faults, strict=True))):
        now = {}
        for state in ("", "s", "u", "a"):
            ways = []
            if state in best:
                cost, audit, texts = best[state]
                ways.append((cost + 2, "D" + audit, texts))
            if fault not in ("blank", "duplicate"):
                late = 5 if fault == "truncated" else 0
                allowed = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
                initial = role[:1]
                if initial and initial in allowed and initial in best:
                    cost, audit, texts = best[initial]
                    ways.append((cost + late, "K" + audit, ((role, text), *texts)))
                for new in ("user", "assistant"):
                    if new[0] in allowed and new[0] in best:
                        cost, audit, texts = best[new[0]]
                        ways.append((cost + late + 1, "R" + audit, ((new, text), *texts)))
            if ways:
                now[state] = min(ways)
        best = spread(now)
    return best[""]


def brute(originals, rows):
    out = []
    for conv_id in {r[0] for r in originals}:
        mine = [r for r in rows if r[0] == conv_id]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, faults = set(), []
        for _, _, role, text in mine:
            letters = WORD.findall(text)
            if not letters:
                faults.append("blank")
            elif (role, text) in seen:
                faults.append("duplicate")
            elif letters[-1] not in ".!?":
                faults.append("truncated")
            else:
                faults.append("")
            seen.add((role, text))
        initials = [r[2][:1] for r in mine]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, texts = cheapest(mine, faults)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in texts).encode()).hexdigest()
        numbers = [faults.count(x) for x in ("blank", "duplicate", "truncated")]
        out.append((conv_id, gaps, *numbers, illegal, cost, audit, digest))
    return sorted(out, key=repr)


def result(spark, rows, kinds=TURNS, extra=()):
    df = spark.createDataFrame([(*r, *extra) for r in rows], kinds)
    return sorted((tuple(r) for r in repair.repaired(df, repair.damaged(df)).collect()), key=repr)


def chats(seed, n=120, longest=14):
    pick = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", "u", "User", None]
    texts = ["Yes.", "No!", "Why?", "cut off", " ", "", None, "Ok. \n", "é.", "a.b", "…", " ", "..", "Yes. 1"]
    rows = []
    for conv_id in range(n):
        good = pick.random() < 0.5
        for turn in range(pick.randint(1, longest)):
            role = ("user", "assistant")[turn % 2] if good else pick.choices(roles, [6, 6, 2, 1, 1, 1, 1, 1])[0]
            text = pick.choice(texts) if pick.random() < 0.4 else f"Line {conv_id} {turn}."
            rows.append((conv_id, pick.choice([turn, turn, turn, None, 2 * turn]), role, text))
    return rows


def test_equals_all_edits(spark):
    rows = chats(1) + [(None, 1, "user", "A."), (None, None, "assistant", "B."), (None, 2, "user", None)]
    rows += rows[:20]  # repeated rows
    assert result(spark, rows) == brute(rows, damage(rows))


def test_pieces_give_the_same(spark, monkeypatch):
    rows = chats(2, n=25, longest=40)
    monkeypatch.setattr(repair, "PIECE", 4)
    assert result(spark, rows) == brute(rows, damage(rows))


def test_odd_tables(spark):
    edge = [(7, -(1 << 63), "user", "A."), (7, (1 << 63) - 1, "assistant", "B."), (8, None, None, None)]
    found = {r[0]: r for r in result(spark, edge)}
    assert found.keys() == {7, 8} and found[7][1] is None
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hello.")]
    nothing = hashlib.sha256(b"").hexdigest()
    assert result(spark, rows) == [(gone, 0, 0, 0, 0, 0, 0, "", nothing)] == brute(rows, [])
    assert result(spark, []) == []
    rows = chats(3, n=10)
    clashing = TURNS + ", pos long, piece string, blank long, digest string, audit string"
    assert result(spark, rows, clashing, (1, "x", 2, "y", "z")) == brute(rows, damage(rows))


def test_a_long_conversation_and_a_long_text(spark):
    pick = random.Random(5)
    rows = [
        (1, i, pick.choice(["user", "assistant", "system", "user", "assistant"]), pick.choice(["Yes.", f"T {i}.", "cut", f"L{i}!"]))
        for i in range(1500)
    ]
    rows += [(2, 1, "user", "long " * 200_000 + "."), (2, 2, "assistant", "Short.")]
    assert result(spark, rows) == brute(rows, damage(rows))


def test_search_is_cheapest_and_least():
    pick = random.Random(9)
    roles = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    for _ in range(300):
        codes = "".join(pick.choices("suaxSUAX-", [1, 5, 5, 1, 1, 2, 2, 1, 2], k=pick.randint(0, 9)))
        rows = [(0, 0, roles.get(c.lower(), "tool"), "t") for c in codes]
        faults = ["blank" if c == "-" else "truncated" if c.isupper() else "" for c in codes]
        wanted = cheapest(rows, faults)[:2]
        assert repair.search(codes, repair.START, repair.ACCEPTED, True) == wanted
        assert repair.needs(codes)[0] <= wanted[0]
