"""Units of more than sixteen transcripts, for queries that keep all members."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.test_logs import LINES, at, call, transcript
from tests.test_queries import SQL, rows
from tracewright.operators import assemble, detect
from tracewright.plans import registry
from tracewright.plans.log_queries import LOGS, WHOLE_LOGS

PER_DAY = 24


@pytest.fixture(scope="module")
def events(tmp_path_factory):
    """Events of four days of one project: each day its 24 users' transcripts overlap, so they are one unit."""
    pick, out = random.Random(11), []
    for day in range(4):
        for user in range(PER_DAY):
            for n in range(5):
                kind = ["view", "click", "purchase", "error", "signup"][pick.randrange(5)] if n else "click"
                out.append((len(out), f"2024-03-{day + 1:02d} 10:{pick.randrange(user, 60):02d}:{pick.randrange(60):02d}", 5 + 50 * user, kind, pick.randrange(90000) / 100, json.dumps({"k": pick.randrange(100)})))
    folder = tmp_path_factory.mktemp("whole")
    con = duckdb.connect()
    con.execute("CREATE TABLE e (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO e VALUES (?, ?, ?, ?, ?, ?)", out)
    con.execute(f"COPY e TO '{folder}/events.parquet' (FORMAT parquet)")
    con.execute("ALTER TABLE e RENAME TO events")
    return str(folder), con


def by_sql(con, sql):
    got = con.execute(sql)
    return rows([c[0] for c in got.description], got.fetchall())


@pytest.mark.parametrize("name", ["l01_logs_to_actions", "v02_unit_pairs", "v09_unit_false_alarms", "v12_unit_hypothesis", "v13_unit_verdict"])
def test_all_members_of_a_unit_count(spark, events, name):
    """The query gives what its SQL does, and not what the newest sixteen members would."""
    folder, con = events
    df = registry.queries()[name](spark, folder)
    got = rows(df.columns, df.collect())
    assert WHOLE_LOGS in SQL[name] and LOGS not in SQL[name]
    assert got == by_sql(con, SQL[name])
    assert got != by_sql(con, SQL[name].replace(WHOLE_LOGS, LOGS))


def test_every_call_becomes_an_action(spark, events):
    folder, con = events
    a = registry.queries()["l01_logs_to_actions"](spark, folder)
    assert [r.n for r in a.groupBy("unit_id").agg(F.count_distinct("session_ix").alias("n")).collect()] == [PER_DAY] * 4
    # those of sibling files are there once for each unit, so only the transcripts' own are counted here
    n = con.execute("SELECT count(*) FROM events WHERE event_type<>'signup' AND NOT (event_id%5=0 AND user_id%7=3)").fetchone()[0]
    assert a.where("kind <> 'Task' and not startswith(lane, 's')").count() == n


def test_without_a_cap_all_members_are_kept(spark):
    lines = [r for k in range(20) for r in transcript(f"m{k:02d}", 10 * k)]
    lines += [("p/gone/subagents/agent-a.jsonl", "gone", "a", 0, call(at(5), "x", "Read", file_path="/b.py")), ("p/agent-z.jsonl", None, "z", 0, call(at(5), "x", "Read", file_path="/b.py"))]
    u = assemble.assemble(spark.createDataFrame(lines, LINES), cap=None)
    assert {r.session_id: (r.session_ix, r.kept, r.dropped) for r in u.members.collect()} == {f"m{k:02d}": (k, True, 0) for k in range(20)}
    # neither a folder without its transcript nor a file that no one claims gives actions
    assert sorted((r.idx, r.session_id) for r in u.actions.collect()) == [(k, f"m{k:02d}") for k in range(20)]
    assert [(r.members, len(r.session_ids)) for r in u.units.collect()] == [(20, 20)]


def joined(plan):
    """Rows that each join of an executed plan gave."""
    kind, out = plan.getClass().getSimpleName(), []
    if kind == "AdaptiveSparkPlanExec":
        out += joined(plan.executedPlan())
    elif kind.endswith("QueryStageExec"):
        out += joined(plan.plan())
    elif "Join" in kind:
        out.append(plan.metrics().apply("numOutputRows").value())
    for i in range(plan.children().size()):
        out += joined(plan.children().apply(i))
    return out


def test_overlaps_of_many_edits_meet_by_range(spark):
    """The earliest overlap is that of a comparison of all pairs, hunks without lines and backward ones too; edits of one range meet as one row."""
    pick = random.Random(5)
    some = [(f"u{n % 2}", "/a" if n % 3 else "/b", n, "Edit", [(lo := pick.randrange(200), lo + pick.choice([-60, -2, 0, 0, 1, 3, 70])) for _ in range(pick.randrange(4))]) for n in range(160)]
    schema = "unit_id string, file_path string, idx int, kind string, hunks array<struct<lo: int, hi: int>>"
    got = {(r.unit_id, r.file_path, r.idx): r.earlier for r in detect.hunk_overlaps(spark.createDataFrame(some, schema)).collect()}
    want = {}
    for u, f, i, _, hunks in some:
        early = [j for v, g, j, _, others in some if (u, f) == (v, g) and j < i and any(a < d and c < b for a, b in hunks for c, d in others)]
        want |= {(u, f, i): min(early)} if early else {}
    assert got == want and len(want) > 40
    same = spark.createDataFrame([("u", "/a", n, "Edit", [(n % 3, n % 3 + 5)]) for n in range(300)], schema)
    pairs = detect.hunk_overlaps(same)
    pairs.collect()
    made = joined(pairs._jdf.queryExecution().executedPlan())
    assert made and max(made) <= 300
