"""The prefix trie against plain Python, node by node."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tracewright.llm import prefix_trie as x, turns as tn


def plain(table):
    own = defaultdict(list)
    for c, t, r, s in table:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", s or ""))
    own = {c: [v[2:] for v in sorted(rows)] for c, rows in own.items()}
    nodes = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        seq = tuple(own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append((c, len(seq)))
    kids = defaultdict(list)
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[j] for j in kids[k]) or 1
        saved[k] = (len(nodes[k]) - 1) * (len(k[-1][1]) if k else 0) + sum(saved[j] for j in kids[k])
    out = []
    for k, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c, n in members if n == len(k))))
        parent = min(c for c, _ in nodes[k[:-1]]) if k else None
        out.append((min(c for c, _ in members), len(k), parent, len(members), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def check(spark, rows, shares=(1, 3)):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for clash in ("seq", "depth", "p", "size", "host"):
        df = df.withColumn(clash, F.lit("x"))
    got = sorted((tuple(r) for r in x.prefix_trie(df, shares).select(*COLUMNS).collect()), key=repr)
    assert got == plain(rows)


def made(seed, convs=150):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        n = rng.choice([0, 1, 2, 3, 5, 8, 13])
        rows += [(c * rng.choice([1, 1, 7]) + seed, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "ccc"])) for t in range(n)]
    return list({r[:2]: r for r in rows}.values())


@pytest.mark.parametrize("shares", [(1,), (1, 1, 2)])
def test_few_symbols_many_branches(spark, shares):
    check(spark, made(3), shares)


def test_odd_rows(spark):
    rows = made(0, 40) + [(None, 1, "user", "gone"), (500, None, None, None), (500, None, "user", "x"), (500, 1, "user", "x"), (500, 1, "user", "x"), (-150, 0, "user", "below"), (-150, 1, "user", "zero"), (-101, 4, "assistant", "é" * 3)]
    rows += [(700, t, "user", f"long {t}") for t in range(40)] + [(701, t, "user", f"long {t}") for t in range(33)] + [(702, 0, "user", "y" * 100_000)]
    rows += [(c, 0, "user", "Only.") for c in range(900, 960)]  # some have no turn left
    check(spark, rows)


def test_many_copies_of_one_conversation(spark, monkeypatch):
    monkeypatch.setattr(x, "CHUNK", 50)
    rows = [(c, t, "user", f"same {t}") for c in range(1, 900) for t in range(3)]
    check(spark, rows)


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert x.prefix_trie(df).count() == 0


def test_two_fattest(spark):
    def slow(lo, hi):
        return max(range(lo + 1, hi + 1), key=lambda v: v & -v)

    pairs = [(lo, hi) for lo in range(40) for hi in range(lo + 1, 41)]
    df = spark.createDataFrame(pairs, "lo long, hi long").select("lo", "hi", x.two_fattest(F.col("lo"), F.col("hi")))
    assert all(r[2] == slow(r[0], r[1]) for r in df.collect())


def test_positions_and_ranges_over_several_spans(spark, monkeypatch):
    monkeypatch.setattr(tn, "SPAN", 4)
    rng = random.Random(1)
    rows = [(rng.randrange(3), rng.choice([None, *range(-9, 30)]), rng.choice("ab")) for _ in range(200)]
    got = tn.numbered(spark.createDataFrame(rows, "k long, t long, s string"), "k", "t", ["s"]).collect()
    for k in range(3):
        mine = sorted((r[1] is not None, r[1] or 0, r[2]) for r in rows if r[0] == k)
        assert [(r.t is not None, r.t or 0, r.s) for r in sorted((g for g in got if g.k == k), key=lambda r: r.pos)] == mine
        assert {r.size for r in got if r.k == k} == {len(mine)}
    df = spark.createDataFrame([(1, 0, 9), (2, 5, 4), (3, 7, 7)], "i long, lo long, hi long")
    assert sorted((r.i, r.d) for r in tn.ranges(F.col("lo"), F.col("hi"), "d", df).collect()) == [(1, d) for d in range(10)] + [(3, 7)]
