"""Raw logs written to files: line numbers, damage, replays, subagents, decisions, tasks, tokens."""

import hashlib
import json
from pathlib import Path

from pyspark.sql import functions as F

from tests.conftest import SF
from tracewright.plans import registry
from tracewright.sources import manifest, transcripts as T

SID = "5e551011-0b0e-4a11-9c0d-e5f0a1b2c3d4"


def use(i, name, ts, mid="m1", **args):
    return {"type": "assistant", "timestamp": ts, "message": {"id": mid, "usage": {"input_tokens": 3, "output_tokens": 5}, "content": [{"type": "tool_use", "id": i, "name": name, "input": args}]}}


def got(i, ts=None, error=False, extra=None):
    line = {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": i, "is_error": error, "content": "boom" if error else "ok"}]}, "toolUseResult": extra or {}}
    return line | ({"timestamp": ts} if ts else {})


def write(tmp_path, lines, sub=()):
    d = tmp_path / "projects" / "-home-x"
    d.mkdir(parents=True)
    (d / f"{SID}.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    if sub:
        s = d / SID / "subagents"
        s.mkdir(parents=True)
        (s / "agent-helper.jsonl").write_text("\n".join(map(json.dumps, sub)) + "\n")
    return str(tmp_path / "projects")


def test_lines_damage_and_replays(spark, tmp_path):
    lines = [
        {"type": "user", "timestamp": "2026-01-01T00:00:00Z", "cwd": "/home/x", "permissionMode": "acceptEdits", "message": {"content": "go on"}},
        "{broken", "",
        use("t1", "Read", "2026-01-01T00:00:01Z", file_path="/a.py"), got("t1", extra={"file": {"totalLines": 12}}),
        use("t1", "Read", "2026-01-01T00:00:01Z", file_path="/a.py"),
        {"type": "mode", "mode": "default"},
        use("t2", "Edit", "2026-01-01T00:00:05Z", "m2", file_path="/a.py", old_string="x", new_string="y\nz\n"), got("t2", "2026-01-01T00:00:07Z", True, {"stderr": "bad", "structuredPatch": [{"oldStart": 3, "oldLines": 2}, {"oldLines": 1}]}),
    ]
    ev = T.parse(T.scan_lines(spark, write(tmp_path, lines)))
    s = T.sessions(ev).first()
    assert (s.parse_errors, s.untimestamped_lines, s.auto_accept, s.project) == (1, 2, True, "-home-x")
    assert s.type_counts == {"assistant": 3, "mode": 1, "user": 3}
    b = T.blocks(ev)
    acts = {r.tool_use_id: r for r in T.actions(T.tool_calls(b), T.results(b)).collect()}
    assert set(acts) == {"t1", "t2"}
    assert (acts["t1"].line_no, acts["t1"].read_total_lines, acts["t1"].idx) == (3, 12, 0)
    e = acts["t2"]
    assert (e.error, e.write_len, e.write_lines, e.approval_latency_s, e.auto_accept_here) == ("boom bad", 4, 2, 2.0, False)
    assert [(h.lo, h.hi) for h in e.hunks] == [(3, 5)]
    u = T.usage(ev).first()
    assert (u.input, u.output) == (6, 10)  # the last line of each message


def test_subagents_decisions_and_tasks(spark, tmp_path):
    q = [{"question": "Which?", "options": [{"label": "A"}, {"label": "B"}]}]
    lines = [
        use("s1", "Task", "2026-01-01T00:00:00Z"), got("s1", extra={"agentId": "helper"}), use("s2", "Agent", "2026-01-01T00:00:00Z"), got("s2", extra={"agentId": "gone"}),
        use("q1", "AskUserQuestion", "2026-01-01T00:00:03Z", questions=q), got("q1", extra={"answers": {"Which?": "B"}}),
        use("c1", "TaskCreate", "2026-01-01T00:00:04Z", subject="do it"), got("c1", extra={"task": {"id": "9"}}),
        use("c2", "TaskUpdate", "2026-01-01T00:00:05Z", taskId="9", status="in_progress"), got("c2", extra={"success": True, "statusChange": "completed"}),
        {"type": "assistant", "timestamp": "2026-01-01T00:00:06Z", "message": {"model": "<synthetic>", "content": [{"type": "text", "text": "limit"}]}},
        {"type": "assistant", "timestamp": "2026-01-01T00:00:07Z", "message": {"content": [{"type": "text", "text": " done　"}]}},
    ]
    sub = [use("e1", "Edit", "2026-01-01T00:00:01Z", "n1", file_path="/b"), use("e2", "Edit", "2026-01-01T00:00:02Z", "n2", file_path="/b")]
    rows = T.scan_lines(spark, write(tmp_path, lines, sub))
    ev = T.parse(rows)
    b = T.blocks(ev)
    calls, res = T.tool_calls(b), T.results(b)
    acts = T.actions(calls, res).orderBy("idx").collect()
    assert [a.lane for a in acts if a.lane] == ["helper", "helper"] and {a.session_id for a in acts} == {SID}
    assert [a.idx for a in acts] == list(range(len(acts)))
    m = T.missing_children(T.spawns(calls, res), rows).first()
    assert (m.spawned, m.missing) == (2, 1)
    d = T.decisions(calls, res).first()
    assert (d.question, d.options, d.answer) == ("Which?", ["A", "B"], "B")
    assert sorted((t.id, t.status) for t in T.task_events(calls, res).collect()) == [("9", "completed"), ("9", "pending")]
    assert [t.text for t in T.agent_texts(ev).collect()] == ["done"]


def test_sibling_agents_go_to_the_oldest_claimant(spark, tmp_path):
    """Sibling files by spawns' ids: the oldest claimant has one, no claimant misses it, foldered sessions claim none."""
    d = tmp_path / "-home-x"
    sid = [f"{i}aaaaaaa-1111-2222-3333-444444444444" for i in range(4)]
    spawn = lambda day, *ids: [x for i in ids for x in (use(f"s{i}", "Task", f"2026-01-0{day}T00:00:00Z"), got(f"s{i}", extra={"agentId": i}))]
    files = {
        f"{sid[0]}.jsonl": spawn(2, "a", "both", "gone"), f"{sid[1]}.jsonl": spawn(1, "both"), f"{sid[2]}.jsonl": spawn(3, "a", "in"),
        f"{sid[2]}/subagents/agent-in.jsonl": [use("e", "Edit", "2026-01-03T00:00:00Z")], f"{sid[3]}.jsonl": spawn(4, *[f"m{i:02d}" for i in range(70)]),
        **{f"agent-{i}.jsonl": [use("e", "Edit", "2026-01-03T00:00:00Z")] for i in ("a", "both", "unclaimed", *[f"m{i:02d}" for i in range(70)])},
    }
    for name, lines in files.items():
        (d / name).parent.mkdir(parents=True, exist_ok=True)
        (d / name).write_text("\n".join(map(json.dumps, lines)) + "\n")
    ev = T.parse(T.scan_lines(spark, str(tmp_path)))
    b = T.blocks(ev)
    spawned = T.spawns(T.tool_calls(b), T.results(b))

    def owners(rows):
        b = T.blocks(rows)
        return sorted((r.lane, r.session_id) for r in T.actions(T.tool_calls(b), T.results(b)).where("lane is not null").collect())

    many = [(f"m{i:02d}", sid[3]) for i in range(64)]
    claims = T.sibling_claims(ev, spawned)
    assert owners(T.with_siblings(ev, claims)) == sorted([("a", sid[0]), ("both", sid[1]), ("in", sid[2]), *many])
    missing = {r.session_id: (r.spawned, r.missing) for r in T.missing_children(spawned, ev, claims).collect()}
    assert missing == {sid[0]: (3, 1), sid[1]: (1, 0), sid[2]: (2, 1), sid[3]: (70, 6)}
    units = spark.createDataFrame([(s, i) for i, s in enumerate(sid)], "session_id string, unit_id long")
    assert owners(T.with_siblings(ev, T.sibling_claims(ev, spawned, units))) == sorted([("a", sid[0]), ("both", sid[0]), ("both", sid[1]), ("in", sid[2]), *many])


def test_manifest_finds_changes(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("1\n")
    (tmp_path / "b.jsonl").write_text("2\n")
    known = spark.createDataFrame(manifest.scan(spark, str(tmp_path)).collect(), "path string, size bigint, mtime timestamp, sha256 string")
    (tmp_path / "b.jsonl").write_text("22\n")
    (tmp_path / "c.jsonl").write_text("3\n")
    found = manifest.scan(spark, str(tmp_path))
    assert {r.path[-7:] for r in manifest.changed(found, known).collect()} == {"b.jsonl", "c.jsonl"}
    assert {r.path[-7:]: r.state for r in manifest.verify(found, known).collect()} == {"a.jsonl": "ok", "b.jsonl": "corrupt", "c.jsonl": "unlisted"}


def test_manifest_hashes_files_beyond_a_row(spark, tmp_path):
    """A file that Spark refuses as one row is hashed all the same, to its plain SHA-256."""
    sizes = {"one.bin": 1, "whole chunk.bin": manifest.CHUNK, "odd name %41.bin": manifest.CHUNK * 2 + 17}
    (tmp_path / "sub").mkdir()
    for name, n in sizes.items():
        (tmp_path / "sub" / name).write_bytes(bytes(i * 7 % 251 for i in range(n)))
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)
    try:
        got = {r.path.rsplit("/", 1)[-1]: (r.size, r.sha256) for r in manifest.scan(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert got == {name: (n, hashlib.sha256((tmp_path / "sub" / name).read_bytes()).hexdigest()) for name, n in sizes.items()}


def test_s08_is_the_inventory(spark):
    """Every file once as ok, or once as new and once as unlisted, against the folder itself."""
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)
    try:
        got = {}
        for r in registry.queries()["s08_manifest"](spark, SF).collect():
            got.setdefault((r.name, r.size), []).append(r.state)
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert set(got) == {(p.name, p.stat().st_size) for p in Path(SF).rglob("*.parquet")}
    paths = spark.createDataFrame([(f"file:{p}", p.name) for p in Path(SF).rglob("*.parquet")], "path string, name string")
    known = {r.name for r in paths.where(F.pmod(F.xxhash64("path"), F.lit(2)) == 0).collect()}
    assert {n: sorted(s) for (n, _), s in got.items()} == {n: ["ok"] if n in known else ["new", "unlisted"] for n, _ in got}
