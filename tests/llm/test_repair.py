"""Conversation repair against a dynamic program that keeps whole audits."""

import hashlib
import random
import re
import zlib

import pytest

from tracewright.llm import repair as x

WHITE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit) over rows of (initial, must go, truncated): every state's least (cost, audit) string."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    now = {"": (0, "")}
    for initial, gone, cut in rows:
        for _ in range(3):
            for s, (c, a) in list(now.items()):
                for r in "ua":
                    if t := after.get((s, r)):
                        now[t] = min(now.get(t, (c + 2, a + "I")), (c + 2, a + "I"))
        new = {}
        for s, (c, a) in now.items():
            ways = [(s, c + 3, a + "D")]
            if not gone:
                ways += [(after[s, initial], c + cut, a + "K")] if (s, initial) in after else []
                ways += [(after[s, r], c + 2 + cut, a + "R") for r in "ua" if (s, r) in after]
            for t, *way in ways:
                new[t] = min(new.get(t, tuple(way)), tuple(way))
        now = new
    for _ in range(3):
        for s, (c, a) in list(now.items()):
            for r in "ua":
                if t := after.get((s, r)):
                    now[t] = min(now.get(t, (c + 2, a + "I")), (c + 2, a + "I"))
    return min(now[s] for s in ("", "a") if s in now)


def plain(table):
    convs = {}
    for c, t, r, s in table:
        convs.setdefault(c, []).append((t, r, s))
    out = []
    for c, rows in convs.items():
        hurt = []
        for t, r, s in rows:
            r, s = " " if r is None else r, " " if s is None else s
            k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            if k:
                s = "" if k == 1 else re.sub("[.!?]", "", s) if k == 2 else s
                hurt += [(t, "user" if k == 4 else r, s)] * (2 if k == 3 else 1)
        hurt.sort(key=lambda h: (h[0] is not None, h[0] or 0, h[1], h[2]))
        faults, seen = [], set()
        for _, r, s in hurt:
            end = s.rstrip(WHITE)
            faults.append("blank" if not end else "duplicate" if (r, s) in seen else "truncated" if end[-1] not in ".!?" else None)
            seen.add((r, s))
        turns = [h[0] for h in hurt if h[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(hurt, hurt[1:]))
        cost, audit = cheapest([(h[1][:1], f in ("blank", "duplicate"), f == "truncated") for h, f in zip(hurt, faults)])
        lines, at = [], 0
        for a in audit:
            if a != "I":
                _, r, s = hurt[at]
                at += 1
            if a == "D":
                continue
            turn = "assistant" if lines and lines[-1][0][:1] == "u" else "user"
            lines.append((turn, "") if a == "I" else (turn if a == "R" else r, s))
        sha = hashlib.sha256("\n".join(f"{r}:{s}" for r, s in lines).encode()).hexdigest()
        out.append((c, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha))
    return sorted(out, key=repr)


def test_solve_and_blocks_against_whole_audits():
    rng = random.Random(3)
    for n in [*range(1, 9)] * 40 + [60, 200]:
        kinds = bytes(rng.randrange(12) for _ in range(n))
        want = cheapest([(x.INITIALS[k % 4], k // 4 == 2, k // 4 == 1) for k in kinds])[1]
        whole = kinds + bytes([x.END])
        assert "".join(x.solve(whole, 0, 0)) == want
        size = rng.randrange(1, 6)
        blocks = [whole[i : i + size] for i in range(0, len(whole), size)]
        at = x.cuts([x.matrix(b) for b in blocks], 0, 0)
        assert "".join(w for b, s, e in zip(blocks, at, at[1:]) for w in x.solve(b, s, e)) == want


def made(seed):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "Why?", "", " \t", "ok!", "a.b", "end. \n", None, "é."]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "", None, "User"]), rng.choice(texts)) for c in range(60) for t in range(rng.randrange(12))]
    rows += [(c, rng.choice([None, 1, 2, 9]), rng.choice(["user", "assistant"]), rng.choice(texts)) for c in range(60, 80) for _ in range(6)]
    rows += [(None, t, "user", "Hi.") for t in (0, 1, None)] + [(99, t, ("assistant", "user")[t % 2], f"Turn {t}.") for t in range(-3, 90)]
    rows += [(100, 5, "user", "same.")] * 3 + [(101, 4, "user", "x" * 300_000 + ".")]
    rows += [(c, 0, "user", "Alone.") for c in range(200, 240)]
    return rows


@pytest.mark.parametrize("block", [x.BLOCK, 4])
def test_all_columns_against_plain_python(spark, block):
    rows = made(block)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for clash in ("key", "kind", "block", "letters", "copy"):
        df = df.selectExpr("*", f"'x' as {clash}")
    got = sorted((tuple(r) for r in x.repair(df, block=block).collect()), key=repr)
    assert got == plain(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert x.repair(df).count() == 0
