"""Boundaries, goldens of the study, order independence and detectors that must stay silent."""

from pyspark.sql import functions as F

from tests.conftest import SF
from tracewright.operators import adapters, detect, order, privacy, rank, relations, study
from tracewright.plans import registry, unit_queries
from tracewright.streaming import live


def test_gap_of_exactly_half_an_hour_joins(spark):
    t = spark.createDataFrame([("p", "a", 0, 100), ("p", "b", 1900, 2000), ("p", "c", 3801, 3900), ("p", "d", 3850, 3860)], "project string, path string, first long, last long")
    got = {r.path: r.unit for r in order.work_units(t).collect()}
    assert got["a"] == got["b"] and got["c"] == got["d"] != got["b"]


def test_published_relative_risk(spark):
    t = spark.createDataFrame([(19, 34, 20, 479)], "a int, b int, c int, d int")
    lo, hi = study.rr_interval()
    r = t.select(study.relative_risk().alias("rr"), lo.alias("lo"), hi.alias("hi"), study.precision().alias("p"), study.miss_rate().alias("m"), study.thin_cells().alias("thin")).first()
    assert (round(r.rr, 2), round(r.lo, 2), round(r.hi, 2), round(r.p, 2), round(r.m, 2), r.thin) == (8.94, 5.11, 15.67, 0.36, 0.51, "")


def test_findings_do_not_depend_on_row_order(spark):
    a, t = adapters.actions_from_events(spark, SF), adapters.turns_from_events(spark, SF)
    one = sorted(map(str, detect.all_findings(a, t).collect()))
    two = sorted(map(str, detect.all_findings(a.repartition(7, "kind").orderBy(F.rand(3)), t.orderBy(F.rand(4))).collect()))
    assert one == two and one


def test_quiet_session_has_no_findings(spark):
    a = adapters.actions_from_events(spark, SF).where("kind = 'Read'").dropDuplicates(["unit_id", "file_path"]).where("file_path not like '%.pem'").withColumn("input_hash", F.lit(None).cast("string"))
    assert detect.all_findings(a, adapters.turns_from_events(spark, SF)).count() == 0


def test_detector_registry(spark):
    detect.register_detector("extra", lambda t: detect.finding(t["actions"].limit(1).withColumn("idxs", F.array("idx")), 99, "churn", "T3", True, "low"))
    try:
        a, t = adapters.actions_from_events(spark, SF), adapters.turns_from_events(spark, SF)
        assert detect.all_findings(a, t).where("detector_ord = 99").count() == 1
    finally:
        detect._extra.clear()


def test_greedy_skip_is_a_fold(spark):
    costs = [(1, i, c) for i, c in enumerate([5, 90, 10, 3, 200, 1])]
    got = rank.greedy_skip(spark.createDataFrame(costs, "g int, o int, c int"), "g", "o", "c", 20).first()
    assert (got.n, got.used, got.kept) == (6, 19, [0, 2, 3, 5])


def test_pseudonyms_keep_structure_only(spark):
    secret = '{"type":"user","cwd":"/home/me/a.py","odd":"my words","message":{"content":"see /home/me/a.py Exit code 2"},"my question?":"x"}'
    r = privacy.pseudonymise(spark.createDataFrame([(1, secret), (2, "{bad"), (3, None)], "k int, value string"), ["k"]).orderBy("k").collect()
    assert "home/me" not in r[0].value and "my words" not in r[0].value and "Exit code 2" in r[0].value and r[0].unknown == ["<content-key>", "my question?", "odd"]
    assert r[0].value.count(privacy.pseudonym("/home/me/a.py")) == 2 and r[1].value == "xxxx" and r[2].value is None


def test_sessions_are_counted_without_pairs(spark):
    import random

    r = random.Random(5)
    s = [(r.choice("pq"), str(i), a, a + r.randrange(6)) for i in range(60) for a in [r.randrange(40)]] + [("p", "open", None, 9), (None, "lost", 1, 9)]
    s = spark.createDataFrame(s, "project string, path string, first long, last long")
    c = spark.createDataFrame([(r.choice("pqz"), i, r.randrange(60)) for i in range(40)], "project string, sha long, epoch long")
    w = relations.commit_windows(c)
    pairs = relations.sessions_in_windows(s, w).groupBy("project", "sha").count()
    got = relations.sessions_per_window(s, w)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.collect())) and pairs.count() > 10
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_audit_scrubs_lines_once(spark):
    before = spark.createDataFrame([("s", 1, '{"type":"user","uuid":"a"}'), ("s", 2, '{"type":"user"}'), ("t", 1, "{bad")], "s string, n int, value string")
    out = privacy.audit(before, privacy.pseudonymise(before, ["s", "n"]).where("s = 's'"), "s", ["/home"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = {r.s: (r.lines_before, r.lines_after, r.structure_kept, r.ids_kept, r.usage_kept, r.leaks) for r in out.collect()}
    assert got == {"s": (2, 2, True, True, True, 0), "t": (1, None, False, True, False, 0)}


def test_state_carries_over_batches(spark, tmp_path):
    rows = [(i, f"2026-01-01 00:00:0{i}", 1, "click", 0, k) for i, k in enumerate([3, 3, 3, 10, 5])]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, project long, k long").withColumn("ts", F.to_timestamp("ts"))
    for i in range(5):
        df.where(F.col("event_id") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "landing"))
    # rows are given out once the watermark is past them: a mark without an id moves it
    mark = spark.sql("SELECT CAST(NULL AS long) event_id, timestamp '2026-01-02' ts, CAST(NULL AS long) user_id, CAST(NULL AS string) event_type, CAST(NULL AS long) project, CAST(NULL AS long) k")
    mark.write.mode("append").parquet(str(tmp_path / "landing"))
    schema = "event_id long, ts timestamp, user_id long, event_type string, project long, k long"
    out = live.run_to_table(live.live_loops(live.tail(spark, str(tmp_path / "landing"), schema, 1)), str(tmp_path / "loops"))
    assert [(r.event_id, r.repeats) for r in out.collect()] == [(2, 3)]
    out = live.run_to_table(live.nudges(live.tail(spark, str(tmp_path / "landing"), schema, 1)), str(tmp_path / "nudges"))
    assert [(r.event_id, r.edits) for r in out.collect()] == [(2, 3)]


def test_locate_seeks_every_event(spark):
    """All events are candidates, ties and the cut at five included, and no window gets more than five rows a marker and task."""
    rows = [(m, u, 100 * u % 700 + m) for m in range(1, 6) for u in range(m * m)] + [(1, 0, 5), (None, 7, 1)]
    hits = spark.createDataFrame(rows, "marker long, user_id long, t long").select("marker", "user_id", F.timestamp_seconds("t").alias("ts"))
    got = {r.marker: (r.sessions, r.verdict, r.candidates) for r in unit_queries.locate(hits).collect()}
    want = {}
    for m in {r[0] for r in rows}:
        newest = {}
        for _, u, t in (r for r in rows if r[0] == m):
            newest[u] = max(t, newest.get(u, t))
        top = sorted(newest, key=lambda u: (-newest[u], u))[:5]
        want[m] = (len(newest), "verified" if len(newest) == 1 else "ambiguous", ",".join(map(str, top)))
    assert got == want
    assert "WindowGroupLimit" in unit_queries.locate(hits)._jdf.queryExecution().executedPlan().toString()
    found = registry.queries()["j18_locate_all_tool_ids"](spark, SF)
    assert {r.marker for r in found.collect()} == {r.event_id % 5000 for r in adapters.events(spark, SF).select("event_id").collect()}
