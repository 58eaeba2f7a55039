"""Streams: rows in order whatever order they land in, forgotten keys, files that grow line by line."""

import datetime as dt
import os

from tracewright.sources import tail
from tracewright.streaming import live

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, project long, k long"
T0 = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)


def land(spark, folder, rows):
    data = [(e, T0 + dt.timedelta(minutes=m), u, t, 0, k) for e, m, u, t, k in rows]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/landing")


def modes(spark, folder, **options):
    out = live.run_to_table(live.carried_modes(live.tail(spark, f"{folder}/landing", SCHEMA, 1), **options), folder)
    return {r.event_id: r.mode for r in out.collect()}


def test_rows_land_out_of_order_and_late(spark, tmp_path):
    d = str(tmp_path)
    land(spark, d, [(1, 0, 7, "view", 5), (4, 30, 7, "view", 6), (2, 10, 7, "view", 10)])
    land(spark, d, [(3, 20, 7, "view", 11), (9, 300, 8, "view", 5)])  # 3 comes after 4 but in time
    assert modes(spark, d, late="1 hour") == {1: False, 2: True, 3: False, 4: False}
    # 5 is behind the watermark (300 - 60 minutes) and goes; 6 isn't
    land(spark, d, [(5, 200, 7, "view", 10), (6, 250, 7, "view", 8)])
    land(spark, d, [(None, 5000, None, None, None)])
    assert modes(spark, d, late="1 hour") == {1: False, 2: True, 3: False, 4: False, 6: False, 9: False}


def test_a_silent_key_is_forgotten(spark, tmp_path):
    d, hour = str(tmp_path), 3_600_000
    land(spark, d, [(1, 0, 7, "view", 10), (2, 0, 8, "view", 10)])
    land(spark, d, [(3, 90, 8, "view", 5)])
    land(spark, d, [(4, 400, 9, "view", 5)])  # moves the watermark behind 7's and 8's last rows and an hour more
    land(spark, d, [(5, 500, 7, "view", 5), (6, 500, 8, "view", 5)])
    land(spark, d, [(None, 5000, None, None, None)])
    got = modes(spark, d, late="10 minutes", forget_ms=2 * hour)
    assert got == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False}


def test_a_large_key_is_held_by_chunks(spark, tmp_path):
    d = str(tmp_path)
    rows = [(i, i // 50, 7, "click", 5) for i in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        land(spark, d, rows[::-1])
        land(spark, d, [(None, 9999, None, None, None)])
        out = live.run_to_table(live.nudges(live.tail(spark, f"{d}/landing", SCHEMA, 1), 3), d)
        assert sorted((r.event_id, r.edits) for r in out.collect()) == [(i, i + 1) for i in range(2, 3000, 3)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def read_all(folder):
    out = []
    for top, _, names in os.walk(folder):
        for n in names:
            at = 0
            for line in open(os.path.join(top, n), "rb").read().split(b"\n")[:-1]:
                out.append((os.path.join(top, n), at, line.decode()))
                at += len(line) + 1
    return sorted(out)


def run(spark, logs, out, **options):
    q = tail.tail(spark, str(logs), **options).writeStream.format("parquet").option("checkpointLocation", f"{out}/log").option("path", f"{out}/rows").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(f"{out}/rows").collect())


def append(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "ab") as f:
        f.write(data)


def test_appended_lines_are_read_once(spark, tmp_path):
    logs, out = tmp_path / "logs", tmp_path / "out"
    files = [str(logs / n) for n in ("a.jsonl", "p/b.jsonl", "p/c c.jsonl")]
    for k, f in enumerate(files):
        append(f, b"".join(b'{"n": %d, "s": "\xc3\xa9"}\n' % (k * 100 + i) for i in range(20)) + b'{"half')
    assert run(spark, logs, out, range_bytes=64) == read_all(logs)
    append(files[0], b' line": 1}\n\n')
    append(files[1], b"".join(b'{"more": %d}\n' % i for i in range(5000)))
    append(str(logs / "d.jsonl"), b"x" * 300_000 + b"\nlast")  # one line over several ranges, one that waits
    append(str(logs / "other.txt"), b"not a log\n")
    want = [r for r in read_all(logs) if not r[0].endswith(".txt")]
    assert run(spark, logs, out, range_bytes=1000) == want  # a new query from the checkpoint
    append(str(logs / "d.jsonl"), b" line\n")
    assert run(spark, logs, out) == [r for r in read_all(logs) if not r[0].endswith(".txt")]
    assert run(spark, logs, out) == [r for r in read_all(logs) if not r[0].endswith(".txt")]  # nothing new


def test_batches_of_bounded_size(spark, tmp_path):
    logs = tmp_path / "logs"
    for k in range(3):
        append(str(logs / f"{k}.jsonl"), b"".join(b"%d\n" % i for i in range(1000)))
    append(str(logs / "9.jsonl"), b"y" * 5000 + b"\nz\n")
    reader = tail.TailReader({"path": str(logs), "maxBytesPerTrigger": "1500"})
    before, seen = {}, 0
    while (now := reader.latestOffset()) != before:
        rows = [r for p in reader.partitions(before, now) for b in reader.read(p) for r in b.to_pylist()]
        assert sum(len(r["value"]) + 1 for r in rows) <= 1500 or len(rows) == 1
        before, seen = now, seen + len(rows)
    assert seen == 3002


def test_small_keys_wait_in_one_value(spark, tmp_path):
    """However many minutes a small key's rows lie in, it has one value, one timer and no entries of map state."""
    d = str(tmp_path)
    land(spark, d, [(u * 1000 + i, (i * 7) % 40 * 60, u, "click", 5) for u in range(5) for i in range(40)])
    live.run_to_table(live.nudges(live.tail(spark, f"{d}/landing", SCHEMA, 1), 3, late="100 hours"), d)
    held = spark.read.format("statestore").option("stateVarName", "held").load(f"{d}/log").select("key.user_id", "value.runs").collect()
    timers = spark.read.format("statestore").option("readRegisteredTimers", True).load(f"{d}/log").count()
    assert sorted(tuple(r) for r in held) == [(u, 0) for u in range(5)] and timers == 5
    land(spark, d, [(9999, 90_000, 77, "view", 5)])
    out = live.run_to_table(live.nudges(live.tail(spark, f"{d}/landing", SCHEMA, 1), 3, late="100 hours"), d)
    assert sorted((r.user_id, r.edits) for r in out.collect()) == sorted((u, 3 * n) for u in range(5) for n in range(1, 14))
