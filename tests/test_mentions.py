"""Names in texts by the n-gram index: against a plain search, and on a unit of 20,000 files and failures."""

import random
import time

from pyspark.sql import functions as F

from tracewright.operators import detect
from tracewright.operators.mentions import mentions


def test_against_a_plain_search(spark):
    rng = random.Random(4)
    word = lambda k: "".join(rng.choices("ab./é", k=k))
    names = [(u, word(rng.choice([0, 1, 2, 3, 4, 5, 8]))) for u in range(4) for _ in range(25)] + [(0, None), (9, "only")]
    texts = [(u, i, word(rng.choice([0, 1, 3, 10, 60]))) for u in range(5) for i in range(40)] + [(0, 99, None)]
    for few in (0, 18, 100):  # all by the index, some, none
        got = sorted(tuple(r) for r in mentions(spark.createDataFrame(texts, "unit_id long, idx long, text string"), spark.createDataFrame(names, "unit_id long, name string").distinct(), few).collect())
        assert got == sorted({(u, i, n) for u, i, t in texts for v, n in names if u == v and n and t and n in t})


def test_large_unit_in_seconds(spark):
    n = 20_000
    i = F.col("id")
    name = F.format_string("/src/module_%05d.py", i)
    touched = spark.range(n).select(F.lit("u").alias("unit_id"), F.lit(0).alias("session_ix"), i.alias("idx"), F.lit("Edit").alias("kind"), name.alias("file_path"), F.lit(None).cast("string").alias("command"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("is_error"), F.lit(None).cast("string").alias("lane"))
    failed = spark.range(n).select(F.lit("u").alias("unit_id"), F.lit(0).alias("session_ix"), (i + n).alias("idx"), F.lit("Bash").alias("kind"), F.lit(None).cast("string").alias("file_path"), F.lit("pytest -x").alias("command"), F.concat(F.lit("Traceback: error in "), F.format_string("module_%05d.py", (i * 7) % n), F.lit(" line 3")).alias("error"), F.lit(True).alias("is_error"), F.lit(None).cast("string").alias("lane"))
    began = time.time()
    out = detect.attribute_failures(touched.unionByName(failed)).collect()
    assert time.time() - began < 40
    assert {(r.idx, r.file_path, r.by_proximity) for r in out} == {(k + n, f"/src/module_{k * 7 % n:05d}.py", False) for k in range(n)}
