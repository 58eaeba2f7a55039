"""Exact dedup: filters, snapshots and groups against plain Python."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import exact_dedup as x


def plain(rows):
    groups = defaultdict(list)
    for i, t in rows:
        t = t or ""
        groups["".join(c for c in t if c not in x.WHITE)].append((-len(t), i is None, i if i is not None else 0))
    out = []
    for norm, members in groups.items():
        members.sort()
        sha = hashlib.sha256(norm.encode()).hexdigest()
        keep = None if members[0][1] else members[0][2]
        out += [(None if m[1] else m[2], keep, len(members), k == 0, sha) for k, m in enumerate(members)]
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=repr)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 50_000])
def test_filter_holds_its_keys_and_few_others(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    f = x.build_filter(keys)
    assert x.may_hold(keys, *f).all()
    assert len(f[3]) < 1.35 * n + 100
    other = rng.integers(0, 2**64, 20_000, dtype=np.uint64)
    assert x.may_hold(other, *f).mean() < 0.02 or n < 10


ROWS = [
    (1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \t\n\x0b\x0c\r"), (7, "a b"), (8, "é" * 3), (9, "é é é"), (10, "x" * 200_000), (11, "x " * 200_000),
    (None, "ab"), (None, "ab"), (None, "only null"), (12, "twice"), (12, "twice"), (12, "twice"), (12, "t w i c e"), (13, "AB"), (-5, "a  b"), (14, "other"), (14, "more"),
]


@pytest.mark.parametrize("digest", [F.xxhash64, lambda c: F.pmod(F.xxhash64(c), F.lit(3))])
def test_all_rows_against_plain_python(spark, digest):
    """Also with a digest of three values, where only the bytes tell texts apart."""
    rng = random.Random(5)
    rows = ROWS + [(1000 + i, f"{rng.choice('abcd')}{' ' * rng.randrange(3)}{rng.randrange(12)}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h": F.lit("x"), "norm": F.lit(None), "batch": F.lit(1), "kept": F.lit(2)})
    assert got(x.exact_duplicates(x.deal(df, (2, 1, 1), "doc_id"), digest=digest)) == plain(rows)


def test_many_rows_alike(spark):
    rows = [(7, "same text")] * 9000 + [(8, "same text")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(x.exact_duplicates(x.deal(df, (1, 1), "doc_id"))) == plain(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    out = x.exact_duplicates(x.deal(df, (2, 1), "doc_id"))
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and out.count() == 0


def test_later_batch_meets_the_buckets_only_where_a_filter_answers(spark):
    """New texts of a batch are screened out but for false positives; the snapshot's own texts all pass."""
    old = spark.range(3000).select(F.xxhash64("id").alias("h"))
    new = spark.range(3000, 6000).select(F.xxhash64("id").alias("h"))
    s = x.Snapshot(0, old, x.materialise(x._filters(old, 4), "filters"), 4)
    assert x.screen(old, 3000, s).count() == 3000
    assert x.screen(new, 3000, s).count() < 60
