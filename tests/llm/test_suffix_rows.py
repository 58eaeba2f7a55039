"""Suffix-array dedup on repeated rows: equal texts under one id, null ids or ids of their own."""

import random
import time
from collections import Counter

import numpy as np

from tracewright.llm import suffix_dedup


def plain(rows):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + 200] for r in raws for i in range(len(r) - 199))
    out = []
    for (doc, _), r in zip(rows, raws):
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - 199):
            if seen[r[k : k + 200]] > 1:
                gone[k : k + 200] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc, len(r), int(gone.sum()), runs, bytes(np.frombuffer(r, np.uint8)[~gone])))
    return sorted(out, key=repr)


def test_repeated_rows_by_brute_force(spark):
    rng = random.Random(8)
    word = lambda k: "".join(rng.choices("abcdefghij é", k=k))
    passage, long = word(300), word(700)
    texts = [word(500), passage + word(100), word(90) + passage, long, "x" * 450, word(150), None, "", word(250)]
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(None, texts[0])] * 7 + [(3, long)] * 40 + [(None, long[100:400] + word(50)), (None, None), (8, texts[8][:220]), (20, "x" * 199), (21, "x" * 200), (22, word(30) + long)]
    rows += [(5, texts[5])] * 3  # copies that are too short to repeat
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df).collect()), key=repr)
    assert got == plain(rows)


def test_many_rows_alike_cost_no_more_than_rows_apart(spark):
    rng = random.Random(2)
    text = "".join(rng.choices("abcdefghijklmnop ", k=3500))
    apart = [(k, "".join(rng.choices("abcdefghijklmnop ", k=3500))) for k in range(5000)]
    took = []
    for rows in (apart, [(None, text)] * 5000):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
        began = time.time()
        got = {(r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(df).select("n_bytes", "n_removed").collect()}
        took.append(time.time() - began)
        assert got == {(3500, 0 if rows is apart else 3500)}
    assert took[1] < 2 * took[0] + 5
