"""Shrinking of the serialised payload: one token less drops one item, files before findings."""

import json
import math

from pyspark.sql import functions as F

from tracewright.operators import shrink


def made(spark):
    files = [(1, r, f"/p/{'long/' * 40 if r == 3 else ''}f{r}.py", "code", 9 - r, {"churn": 2, "rework": r}) for r in range(1, 7)]
    ranked = spark.createDataFrame(files, "unit_id long, rank long, file string, class string, edits long, breakdown map<string,long>")
    found = [(1, 0, "churn", "T1", True, "high", list(range(15 if r == 2 else 3)), files[r - 1][2], None, {"relative_churn": 0.5}) for r in range(1, 7)]
    found += [(1, 2, "rework", "T2", True, "high", [k, k + 1], files[0][2], "n", None) for k in range(7)]
    findings = spark.createDataFrame(found, "unit_id long, detector_ord int, kind string, tier string, exact boolean, confidence string, idxs array<long>, file string, note string, nums map<string,double>")
    units = spark.createDataFrame([(1, '{"id":"u"}'), (2, '{"id":"none"}')], "unit_id long, session string")
    return units, findings, ranked


def payload(spark, cap, unit=1):
    units, findings, ranked = made(spark)
    r = shrink.struggle_payloads(units, findings, ranked, cap=cap).where(F.col("unit_id") == unit).first()
    return r.files, r.per_file, r.payload, json.loads(r.payload)


def test_one_token_less_drops_one_item(spark):
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        _one_token_less(spark)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def _one_token_less(spark):
    files, per, text, p = payload(spark, 10_000)
    assert (files, per, p["files_total"], p["truncated"]) == (6, 4, 6, True)  # 8 findings of the first file, 15 indices of the second
    assert [len(f["findings"]) for f in p["files"]] == [4, 1, 1, 1, 1, 1] and p["files"][0]["findings_omitted"] == 4
    assert p["files"][1]["findings"][0]["idxs_total"] == 15 and len(p["files"][1]["findings"][0]["idxs"]) == 10
    assert "chars elided" in p["files"][2]["file"] and p["files"][1]["findings"][0]["nums"] == {"relative_churn": 0.5} and p["files"][0]["findings"][0]["note"] == "n"
    steps = [(files, per)]
    while steps[-1] != (1, 0):
        cap = math.ceil(len(text.encode()) / 3.5)
        files, per, again, _ = payload(spark, cap)
        assert again == text  # it fits exactly
        files, per, text, p = payload(spark, cap - 1)
        assert math.ceil(len(text.encode()) / 3.5) < cap and p["truncated"]
        steps.append((files, per))
    assert steps == [(k, 4) for k in range(6, 0, -1)] + [(1, p) for p in (3, 2, 1, 0)]
    assert payload(spark, 1)[:2] == (1, 0)  # nothing left to drop


def test_unit_without_ranked_files(spark):
    files, per, _, p = payload(spark, 1500, unit=2)
    assert (files, per, p["files"], p["truncated"], p["session"]) == (0, 4, [], False, {"id": "none"})
