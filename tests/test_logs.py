"""Units assembled from raw lines: members, shared subagent files, merged order and counters."""

import json

from pyspark.sql import functions as F

from tracewright.operators import assemble, detect, payloads

LINES = "file string, session_id string, agent_id string, line_no long, value string"


def call(ts, i, name, **args):
    return json.dumps({"type": "assistant", "timestamp": ts, "cwd": "/w", "message": {"id": f"m{i}", "usage": {"input_tokens": 1, "output_tokens": 2}, "content": [{"type": "tool_use", "id": i, "name": name, "input": args}]}})


def result(ts, i, **more):
    return json.dumps({"type": "user", "timestamp": ts, "message": {"content": [{"type": "tool_result", "tool_use_id": i, "content": "fine"}]}, "toolUseResult": more})


def at(minute, second=0):
    return f"2026-01-01T{minute // 60:02d}:{minute % 60:02d}:{second:02d}.000000Z"


def transcript(name, minute, spawns=(), edits=1):
    rows, n = [], 0
    for child in spawns:
        rows += [(f"p/{name}.jsonl", name, None, n, call(at(minute), f"s{n}", "Task", prompt="x")), (f"p/{name}.jsonl", name, None, n + 1, result(at(minute), f"s{n}", agentId=child))]
        n += 2
    for k in range(edits):
        rows += [(f"p/{name}.jsonl", name, None, n, call(at(minute, k), f"e{n}", "Edit", file_path="/a.py", old_string="x", new_string="y")), (f"p/{name}.jsonl", name, None, n + 1, result(at(minute, k), f"e{n}"))]
        n += 2
    return rows


def test_shared_sibling_is_merged_once_and_not_missing(spark):
    """Two members name one child: the older owns it, and neither counts it missing; one child isn't there."""
    rows = transcript("m1", 0, ["c", "gone"]) + transcript("m2", 10, ["c"]) + transcript("far", 300, ["c"])
    rows += [("p/agent-c.jsonl", None, "c", 0, call(at(5), "x", "Read", file_path="/b.py"))]
    u = assemble.assemble(spark.createDataFrame(rows, LINES))
    acts = u.actions.collect()
    assert sorted((r.session_id, r.lane) for r in acts if r.lane) == [("far", "c"), ("m1", "c")]
    assert {r.session_id: r.missing for r in u.sessions.collect()} == {"m1": 1, "m2": 0, "far": 0}
    units = {tuple(r.session_ids): r for r in u.units.collect()}
    assert set(units) == {("m1", "m2"), ("far",)} and units[("m1", "m2")].missing == 1 and units[("m1", "m2")].input == 6


def test_idx_is_contiguous_over_members_and_lanes(spark):
    rows = [r for k in range(17) for r in transcript(f"m{k:02d}", 20 * k, edits=k % 3 + 1)]
    rows += [("p/m16/subagents/agent-a.jsonl", "m16", "a", 0, call(at(320), "x", "Read", file_path="/b.py")), ("p/m16/subagents/agent-b.jsonl", "m16", "b", 0, json.dumps({"sessionId": "other", "type": "user"})), ("p/m16/subagents/agent-d.jsonl", "m16", "d", 0, "{damaged")]
    u = assemble.assemble(spark.createDataFrame(rows, LINES))
    members = {r.session_id: r for r in u.members.collect()}
    assert not members["m00"].kept and {r.dropped for r in members.values()} == {1}
    assert [s for s, r in sorted(members.items()) if r.kept] == [f"m{k:02d}" for k in range(1, 17)] and members["m16"].session_ix == 15
    acts = sorted(u.actions.collect(), key=lambda r: r.idx)
    assert [r.idx for r in acts] == list(range(len(acts))) and len(acts) == sum(k % 3 + 1 for k in range(1, 17)) + 1
    assert [(r.effective_ts, r.session_ix) for r in acts] == sorted((r.effective_ts, r.session_ix) for r in acts)
    # a file of another session and one without actions count as missing
    assert {r.session_id: r.missing for r in u.sessions.where("missing > 0").collect()} == {"m16": 2}


def test_detectors_keep_members_apart(spark):
    """An edit undone in the next transcript is no revert; one undone in the same transcript is."""
    undo = lambda name, minute, i, old, new: [(f"p/{name}.jsonl", name, None, i, call(at(minute, i), f"e{i}", "Edit", file_path="/a.py", old_string=old, new_string=new)), (f"p/{name}.jsonl", name, None, i + 1, result(at(minute, i), f"e{i}"))]
    rows = undo("m1", 0, 0, "x", "y") + undo("m2", 10, 0, "y", "x")
    u = assemble.assemble(spark.createDataFrame(rows, LINES))
    assert detect.all_findings(u.actions, u.turns).where("kind = 'true_revert'").count() == 0
    u = assemble.assemble(spark.createDataFrame(rows + undo("m2", 10, 2, "q", "y"), LINES))
    assert [r.idxs for r in detect.all_findings(u.actions, u.turns).where("kind = 'true_revert'").collect()] == [[1, 2]]


def test_interrupt_closes_a_claim(spark):
    prose = spark.createDataFrame([("u", 0, 1, 0, "first"), ("u", 0, 3, 0, "second"), ("u", 0, 3, 1, "third"), ("u", 1, 2, 0, "other")], "unit_id string, session_ix int, line_no long, block_pos int, text string")
    turns = spark.createDataFrame([("u", 0, 2, "go on", "Human"), ("u", 0, 5, "[Request interrupted by user]", "Unknown"), ("u", 1, 1, "[Request interrupted by user]", "Human"), ("u", 1, 4, "[Request interrupted by user]", "NonHuman")], "unit_id string, session_ix int, line_no long, text string, origin string")
    got = sorted((r.session_ix, r.text, r.interrupted) for r in payloads.claims(prose, turns).collect())
    assert got == [(0, "first", False), (0, "third", True), (1, "other", False)]


def test_empty_logs(spark):
    u = assemble.assemble(spark.createDataFrame([], LINES))
    assert u.actions.count() == u.units.count() == 0
    assert detect.all_findings(u.actions, u.turns.withColumn("ts", F.col("ts"))).count() == 0


def test_members_that_the_cap_drops_are_not_parsed(spark, tmp_path, monkeypatch):
    """Only kept members' lines and claimed siblings are parsed; the rest of a unit is scanned for its stamps."""
    import uuid

    from pyspark.sql import functions as F

    from tracewright.operators import assemble

    def log(n):
        return f"p/{uuid.UUID(int=n)}.jsonl", str(uuid.UUID(int=n))

    def call(minute):
        return '{"type":"assistant","timestamp":"2024-05-01T10:%02d:00Z","message":{"content":[{"type":"tool_use","id":"t","name":"Bash","input":{"command":"ls"}}]}}' % minute

    rows = [(*log(n), None, 0, call(n)) for n in range(20)] + [("p/agent-x.jsonl", None, "x", 0, call(1))]
    lines = spark.createDataFrame(rows, "file string, session_id string, agent_id string, line_no long, value string")
    seen, parse = [], assemble.T.parse

    def counted(df):
        seen.append(df.agg(F.sort_array(F.collect_set("file"))).head()[0])
        return parse(df)

    monkeypatch.setattr(assemble.T, "parse", counted)
    u = assemble.assemble(lines, cap=3)
    assert sorted(f for some in seen for f in some) == [log(n)[0] for n in (17, 18, 19)]
    assert u.actions.count() == 3 and [r.dropped for r in u.units.join(u.members.where("kept"), "unit_id").select("dropped").collect()] == [17] * 3


def test_lines_are_numbered_before_they_are_made(spark):
    from tests.conftest import SF
    from tracewright.plans.log_queries import log_lines

    plan = log_lines(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    below = plan[plan.index("Exchange hashpartitioning"):]
    assert "tool_use" not in below and "user_id" in below


def test_lines_are_made_by_as_many_tasks_as_there_are_partitions(spark):
    from tests.conftest import SF
    from tracewright.plans.log_queries import log_lines

    assert log_lines(spark, SF)._jdf.queryExecution().toRdd().getNumPartitions() == 4


def test_only_main_transcripts_are_parsed_for_their_stamps(spark):
    rows = [("p/m.jsonl", "m", None, 0, result(at(1), "x")), ("p/m/subagents/agent-a.jsonl", "m", "a", 0, result(at(2), "x")), ("p/agent-s.jsonl", None, "s", 0, result(at(3), "x"))]
    got = assemble.T.stamped(spark.createDataFrame(rows, LINES)).select("file", "own_ts").collect()
    assert {r.file: r.own_ts for r in got} == {"p/m.jsonl": at(1), "p/m/subagents/agent-a.jsonl": None, "p/agent-s.jsonl": None}


def test_spans_are_grouped_once(spark):
    """Transcripts without stamps are units of their own, found in the windows that place the others."""
    rows = [(f"p/{n}.jsonl", n, None, 0, result(ts, "x")) for n, ts in (("a", at(0)), ("b", at(10)), ("c", None), ("d", "once"), ("e", at(300)))]
    m = assemble.unit_members(assemble.T.stamped(spark.createDataFrame(rows, LINES)))
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(file") == 1
    assert {r.session_id: (r.unit_id, r.session_ix, r.kept, r.dropped, r.gap_min) for r in m.collect()} == {
        "a": ("p/1", 0, True, 0, None), "b": ("p/1", 1, True, 0, 10.0), "c": ("?p/c.jsonl", 0, True, 0, None), "d": ("?p/d.jsonl", 0, True, 0, None), "e": ("p/2", 0, True, 0, None),
    }


def test_lines_are_made_by_code_that_the_jvm_compiles(spark):
    """No expression of the lines is walked node by node, and no method made for their stamps is past what HotSpot compiles."""
    import re

    from tests.conftest import SF
    from tracewright.plans.log_queries import log_lines

    lines = log_lines(spark, SF)
    assert "lambdafunction" not in lines._jdf.queryExecution().executedPlan().toString()
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [int(n) for df in (lines, assemble.unit_members(assemble.T.stamped(lines))) for n in re.findall(r"maxMethodCodeSize:(\d+)", df._jdf.queryExecution().explainString(mode))]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) < 8000


def test_lines_that_no_member_keeps_are_not_written(spark, monkeypatch):
    rows = [(f"p/{n:02d}.jsonl", f"m{n:02d}", None, 0, result(at(n), "x")) for n in range(20)] + [("p/agent-s.jsonl", None, "s", 0, result(at(3), "x"))]
    lines, seen, write = spark.createDataFrame(rows, LINES), {}, assemble.written

    def counted(df, name):
        out = write(df, name)
        seen.setdefault(name, sorted(r.file for r in out.select("file").collect()) if "file" in out.columns else None)
        return out

    monkeypatch.setattr(assemble, "written", counted)
    assemble.assemble(lines, cap=3)
    assert seen["lines"] == ["p/17.jsonl", "p/18.jsonl", "p/19.jsonl", "p/agent-s.jsonl"]
    monkeypatch.setattr(assemble.T, "MAX_SPLITS", 0)  # as many members as are joined by a shuffle
    seen.clear()
    assemble.assemble(lines, cap=3)
    assert seen["lines"] == ["p/17.jsonl", "p/18.jsonl", "p/19.jsonl", "p/agent-s.jsonl"]
