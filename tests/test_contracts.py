"""Contracts of nested payloads: each rule by a payload that breaks it, with the place."""

import json

from tracewright.operators import quality


def payload(**changes):
    p = {
        "v": 2, "session": {"id": "abc", "identified_by": "explicit"}, "truncated": False, "ranking_rule": "by edits",
        "files": [{"class": "code", "edits": 3, "breakdown": {"churn": 2}, "findings": [{"kind": "churn", "tier": "T1", "confidence": "high", "idxs": [0, 4]}]}, {"class": "docs", "edits": 0}],
        "work_unit": {"sessions": 2, "joined_gaps_min": [5.0], "session_ids": ["12345678", "abcdefgh"], "rule": "half an hour"},
    }
    for path, value in changes.items():
        *way, last = path.split("__")
        at = p
        for k in way:
            at = at[int(k)] if k.isdigit() else at[k]
        if value is None:
            del at[last]
        else:
            at[last] = value
    return json.dumps(p)


CASES = [
    (payload(), []), (payload(v=1), [("version", "$.v")]), (payload(v="2"), [("version", "$.v")]), ("{bad", [("unreadable", "$")]), (payload(session__id=" "), [("session_id", "$.session.id")]),
    (payload(session__identified_by="guess"), [("provenance", "$.session.identified_by")]), (payload(truncated="no"), [("truncated", "$.truncated")]), (payload(ranking_rule=None), [("ranking_rule", "$.ranking_rule")]),
    (payload(weights={"a": 1}), [("weights", "$.weights")]), (payload(files__1__class=None), [("class", "$.files[1].class")]), (payload(files__0__edits=None, files__0__score=9), [("edits", "$.files[0].edits"), ("score", "$.files[0].score")]),
    (payload(files__0__breakdown=None), [("breakdown", "$.files")]), (payload(files__0__findings__0__kind="odd"), [("finding_kind", "$.files[0].findings[0].kind")]), (payload(files__0__findings__0__idxs=[]), [("finding_idxs", "$.files[0].findings[0].idxs")]),
    (payload(files__0__findings__0__confidence=3), [("finding_confidence", "$.files[0].findings[0].confidence")]), (payload(work_unit__sessions=3), [("unit_gaps", "$.work_unit.joined_gaps_min"), ("unit_ids", "$.work_unit.session_ids")]),
    (payload(work_unit__session_ids=["12345678", "short"]), [("unit_ids", "$.work_unit.session_ids")]), (payload(work_unit__sessions=0), [("unit_sessions", "$.work_unit.sessions")]), (payload(work_unit__rule=""), [("unit_rule", "$.work_unit.rule")]),
    (payload(files=None, work_unit=None, ranking_rule=None), []), (payload(note="x" * 4000), [("too_large", "$")]),
]


def test_each_rule_and_its_place(spark):
    df = spark.createDataFrame([(k, j) for k, (j, _) in enumerate(CASES)], "unit_id long, json string")
    got = {}
    for r in quality.check_reports(df, 500).collect():
        got.setdefault(r.unit_id, []).append((r.rule, r.place))
    assert {k: sorted(got.get(k, [])) for k in range(len(CASES))} == {k: sorted(want) for k, (_, want) in enumerate(CASES)}


def test_debriefs_name_the_top_files(spark):
    said = spark.createDataFrame([(1, "a.py was rewritten"), (2, None)], "unit_id long, text string")
    files = spark.createDataFrame([(1, "/p/a.py"), (1, "/p/b.py"), (2, "/p/c.py"), (3, "/p/d.py")], "unit_id long, file string")
    assert sorted((r.unit_id, r.file) for r in quality.check_top_files(said, files).collect()) == [(1, "/p/b.py"), (2, "/p/c.py")]
