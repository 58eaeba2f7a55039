"""Studies, decisions and payloads of units on small hand-made rows."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tracewright.operators import assemble, context, detect, rank, study, unit_payloads


def test_outcomes_look_ahead(spark):
    """Against plain loops: places, days, strong outcomes and a last session that edits nothing."""
    day = 86400
    starts = [0, 0, 3 * day, 10 * day, 17 * day, 40 * day, 41 * day]  # session 6 edits no file
    rows = [(0, "f", False), (1, "f", True), (1, "g", False), (3, "g", False), (4, "f", False), (5, "f", True), (5, "g", False)]
    df = spark.createDataFrame([("p", s, starts[s], f, 1, 0, 0, False, False, strong, 6) for s, f, strong in rows], "project string, seq long, start long, file string, edits long, lines long, failed long, flagged_nr boolean, flagged_top3 boolean, strong boolean, last_seq long")
    got = {(r.seq, r.file): (r.next3_weak, r.next3_strong, r.within14d_weak, r.within14d_strong) for r in study.build_pairs(df).collect()}

    def seen(s, f, test, strong):
        return any(g == f and t > s and test(t) and (x or not strong) for t, g, x in rows)

    want = {(s, f): tuple(seen(s, f, test, strong) for test in (lambda t: t <= s + 3, lambda t: starts[t] <= starts[s] + 14 * day) for strong in (False, True)) for s, f, _ in rows}
    assert got == want


def test_corpus_filter_counts_each_reason_once(spark):
    df = spark.createDataFrame([("fresh", 3, 950), ("small", 19, 100), ("kept", 20, 400), ("unknown", 20, None)], "unit_id string, actions long, modified long")
    got = {r.unit_id: r.excluded for r in study.corpus_filter(df, F.lit(1000)).collect()}
    assert got == {"fresh": "recent", "small": "low_actions", "kept": None, "unknown": None}


def test_decisions_found_missing_and_doubled(spark):
    asked = spark.createDataFrame([("u", 0, 1, "a", ["x", "y", "x"], "x"), ("u", 0, 2, "b", ["x"], None), ("u", 1, 1, "c", [], "z")], "unit_id string, session_ix int, line_no long, question string, options array<string>, answer string")
    acts = spark.createDataFrame([("u", 0, 1, "AskUserQuestion", 4), ("u", 0, 1, "Bash", 5), ("u", 0, 2, "AskUserQuestion", 6), ("u", 0, 2, "AskUserQuestion", 7), ("v", 1, 1, "AskUserQuestion", 0)], "unit_id string, session_ix int, line_no long, kind string, idx long")
    got = {r.question: (r.resolution, r.idxs, r.rejected) for r in context.resolve_decisions(asked, acts).collect()}
    assert got == {"a": ("resolved", [4], ["y"]), "b": ("ambiguous", [], ["x"]), "c": ("not_found", [], [])}


@pytest.fixture(scope="module")
def units(spark):
    """Two transcripts of one unit, one that has no stamp, and nine types that the engine has no table for."""
    def line(file, session, n, stamp, **more):
        return (file, session, None, n, json.dumps(dict(more, **({"timestamp": stamp} if stamp else {}))))

    edit = {"type": "assistant", "message": {"id": "m", "usage": {"input_tokens": 3, "cache_read_input_tokens": 1}, "content": [{"type": "tool_use", "id": "t", "name": "Edit", "input": {"file_path": "/p/a.rs"}}]}}
    rows = [line("p/s1.jsonl", "11111111-x", 0, "2024-01-01T00:00:00Z", **edit), line("p/s2.jsonl", "22222222-x", 0, "2024-01-01T00:10:00Z", **edit), line("p/s3.jsonl", "33333333-x", 0, None, **edit)]
    rows += [line("p/s2.jsonl", "22222222-x", 1 + i * 3 + j, "2024-01-01T00:11:00Z", type=f"odd{i}") for i in range(9) for j in range(1 + (i == 8))]
    u = assemble.assemble(spark.createDataFrame(rows, "file string, session_id string, agent_id string, line_no long, value string"))
    u.actions.persist()
    return u


def test_disclosure(spark, units):
    lost = spark.createDataFrame([("p/1", 2)], "unit_id string, n long")
    got = {r.unit_id: json.loads(r.work_unit) for r in unit_payloads.disclosure(units, lost).collect()}
    assert got["p/1"] == {"rule": unit_payloads.RULE, "sessions": 2, "joined_gaps_min": [10.0], "span_start": "2024-01-01T00:00:00Z", "span_end": "2024-01-01T00:11:00Z", "session_ids": ["11111111", "22222222"], "dropped": 0, "members_unreadable": 2, "siblings_unplaced": 1}
    assert got["?p/s3.jsonl"]["siblings_unplaced"] == 1 and got["?p/s3.jsonl"]["span_start"] == ""


def test_overview_gives_way_by_single_types(units):
    ranked = rank.rank_files(detect.all_findings(units.actions, units.turns), units.actions)

    def at(cap):
        r = unit_payloads.overviews(units, units.actions, units.turns, ranked, cap=cap).where("unit_id = 'p/1'").collect()[0]
        return r.types_shown, r.payload

    shown, text = at(unit_payloads.CAP_TOKENS)
    x = json.loads(text)
    assert shown == 8 and "odd8" in x["flags"]["unknown_event_types"] and "odd7" not in x["flags"]["unknown_event_types"]
    assert x["flags"]["unknown_event_types_total"] == 9 and x["truncated"] is True and x["top_struggles"][0]["file"] == "/p/a.rs" and x["work_unit"]["sessions"] == 2
    tokens = math.ceil(len(text) / 3.5)
    assert at(tokens)[0] == 8
    fewer = at(tokens - 1)
    assert fewer[0] == 7 and math.ceil(len(fewer[1]) / 3.5) <= tokens - 1
    assert at(1)[0] == 0


def test_health_drops_its_note(units):
    whole = {r.unit_id: json.loads(r.payload) for r in unit_payloads.health(units, units.actions).collect()}["p/1"]
    assert whole["note"] and not whole["truncated"] and whole["tokens"]["input_uncached"] == 6 and whole["cache_hit_ratio"] == 0.25
    bare = {r.unit_id: json.loads(r.payload) for r in unit_payloads.health(units, units.actions, 10).collect()}["p/1"]
    assert bare["note"] == "" and bare["truncated"] is True


@pytest.fixture(scope="module")
def talked(spark):
    """A transcript with thirty requests, five decisions of three options, tasks and prose."""
    rows = []

    def add(kind, content, **more):
        rows.append(("p/s1.jsonl", "11111111-x", None, len(rows), json.dumps({"type": kind, "timestamp": f"2024-01-01T00:00:{len(rows) % 60:02d}Z", "message": {"id": f"m{len(rows)}", "content": content}, **more})))

    for i in range(30):
        add("user", f'say "{i}" ' + "é" * (600 if i == 2 else 40), origin={"kind": "human"})
        add("assistant", [{"type": "text", "text": f"done {i}"}])
    for i in range(5):
        add("assistant", [{"type": "tool_use", "id": f"q{i}", "name": "AskUserQuestion", "input": {"questions": [{"question": f"Q{i}", "options": [{"label": x} for x in "ABC"]}]}}])
        add("user", [{"type": "tool_result", "tool_use_id": f"q{i}"}], toolUseResult={"answers": {f"Q{i}": "B"}})
    add("assistant", [{"type": "tool_use", "id": "k", "name": "TaskCreate", "input": {"subject": "S"}}])
    add("user", [{"type": "tool_result", "tool_use_id": "k"}], toolUseResult={"task": {"id": "1"}})
    u = assemble.assemble(spark.createDataFrame(rows, "file string, session_id string, agent_id string, line_no long, value string"))
    u.actions.persist(), u.turns.persist()
    return u


def test_review_context_gives_way_by_one_in_all_lists(talked):
    def at(cap):
        r = unit_payloads.review_contexts(talked, talked.actions, talked.turns, cap=cap).collect()
        assert len(r) == 1
        return r[0].list_cap, r[0].payload, json.loads(r[0].payload)

    k, text, x = at(unit_payloads.CONTEXT_CAP)
    assert k == x["list_cap"] == 12 and x["truncated"] is True and "work_unit" not in x
    assert x["totals"] == {"requests": 30, "files_edited": 0, "decisions": 5, "unfinished_tasks": 1, "failing_commands": 0, "claims": 30, "agent_texts_excluded": 0}
    assert [r["line"] for r in x["scope"]["requests"]] == list(range(0, 24, 2)) and x["scope"]["requests"][0]["text"].startswith('say "0" é') and "elided" in x["scope"]["requests"][2]["text"]
    assert x["decisions"][1] == {"question": "Q1", "chosen": "B", "options_not_chosen_total": 2, "idxs": [1], "line": 62, "options_not_chosen": ["A", "C"]}
    assert x["incomplete"]["unfinished_tasks"] == [{"subject": "S", "last_status": "pending", "line": 70}]
    assert x["claims"][0] == {"text": "done 0", "line": 1, "window_interrupted": False}
    size = math.ceil(len(text.encode()) / 3.5)
    assert at(size)[0] == 12
    fewer = at(size - 1)
    assert fewer[0] == 11 and len(fewer[2]["claims"]) == 11 and math.ceil(len(fewer[1].encode()) / 3.5) < size
    least = at(1)
    assert least[0] == 0 and least[2]["claims"] == [] and least[2]["totals"]["requests"] == 30
