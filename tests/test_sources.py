"""Log files: line numbers over many splits, listings with what is skipped."""

import hashlib
import os
import uuid

from pyspark.sql import functions as F

from tests.conftest import SF
from tracewright.plans import registry
from tracewright.sources import manifest, sinks, transcripts as T


def test_line_numbers_without_moving_text(spark, tmp_path):
    files = {}
    for k in range(4):
        lines = [f"{k} {i} " + "x" * (i * 37 % 90) if i % 7 else "" for i in range(3000)] + ["a\rb"]
        p = tmp_path / f"p{k % 2}" / f"{uuid.uuid4()}.jsonl"
        p.parent.mkdir(exist_ok=True)
        p.write_bytes("\n".join(lines).encode() + (b"\n" if k % 2 else b""))
        files[str(p)] = lines
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    spark.conf.set("spark.sql.files.openCostInBytes", 1000)
    try:
        rows = T.scan_lines(spark, str(tmp_path))
        got = {}
        for r in rows.collect():
            got.setdefault(r.file.removeprefix("file:").replace("///", "/"), {})[r.line_no] = r.value
        assert rows.rdd.getNumPartitions() > 20
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {f: dict(enumerate(x)) for f, x in files.items()} == got
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan.split("BroadcastExchange")[0]  # only the table of splits is shuffled


def test_listing_tells_what_is_skipped(spark, tmp_path):
    ids = [str(uuid.uuid4()) for _ in range(4)]
    sizes = {f"p/{ids[0]}.jsonl": 10, f"p/{ids[1]}.jsonl": 500, f"p/{ids[2]}.jsonl": 20, "p/notes.jsonl": 5, f"q/{ids[3]}.jsonl": 7, f"p/{ids[0]}/subagents/agent-x.jsonl": 9}
    for k, (name, n) in enumerate(sizes.items()):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"y" * n)
        os.utime(p, (1_700_000_000 + k, 1_700_000_000 + k))
    got = {r.file.split(str(tmp_path) + "/")[1]: r for r in T.listing(spark, str(tmp_path), max_bytes=100).collect()}
    assert {k: (r.project, r.skipped, r.newest) for k, r in got.items()} == {
        f"p/{ids[0]}.jsonl": ("p", None, 1), f"p/{ids[1]}.jsonl": ("p", "oversize", None), f"p/{ids[2]}.jsonl": ("p", None, 0), "p/notes.jsonl": ("p", "name", None),
        f"q/{ids[3]}.jsonl": ("q", None, 0), f"p/{ids[0]}/subagents/agent-x.jsonl": ("p", None, None),
    }
    assert T.scan_lines(spark, str(tmp_path), max_bytes=100).count() == 5


def test_manifest_hashes_only_what_changed(spark, tmp_path):
    folder, table = tmp_path / "corpus", str(tmp_path / "manifest")
    for k in range(5):
        (folder / f"p{k % 2}").mkdir(parents=True, exist_ok=True)
        (folder / f"p{k % 2}" / f"{k}.jsonl").write_bytes(b"line %d\n" % k * (k + 1))

    def run():
        n = spark.sparkContext.accumulator(0)
        rows = manifest.update(spark, str(folder), table, "*.jsonl", n)
        return {r.path.rsplit("/", 1)[1]: r.sha256 for r in rows.collect()}, n.value

    first, n = run()
    assert n == 5 and first == {f"{k}.jsonl": hashlib.sha256(b"line %d\n" % k * (k + 1)).hexdigest() for k in range(5)}
    assert run() == ({}, 0)
    (folder / "p0" / "2.jsonl").write_bytes(b"other")
    assert run() == ({"2.jsonl": hashlib.sha256(b"other").hexdigest()}, 1)
    assert run() == ({}, 0)
    now = manifest.current(manifest.read(spark, table))
    assert now.count() == 5 and now.where("run = 2").count() == 1 and manifest.read(spark, table).count() == 6
    (folder / "p1" / "1.jsonl").unlink()
    os.utime(folder / "p1" / "3.jsonl", (1, 1))
    stamp = os.stat(folder / "p0" / "4.jsonl")
    (folder / "p0" / "4.jsonl").write_bytes(b"LINE 4\n" * 5)  # same size, same time: only hashing tells
    os.utime(folder / "p0" / "4.jsonl", ns=(stamp.st_atime_ns, stamp.st_mtime_ns))
    assert run()[1] == 1
    states = {r.path.rsplit("/", 1)[1]: r.state for r in manifest.verify(manifest.scan(spark, str(folder)), manifest.current(manifest.read(spark, table))).collect()}
    assert states == {"0.jsonl": "ok", "1.jsonl": "missing", "2.jsonl": "ok", "3.jsonl": "ok", "4.jsonl": "corrupt"}


def test_registered_manifest_by_brute_force(spark):
    got = {r.name: (r.size, r.sha256, r.run) for r in registry.queries()["s08_manifest_update"](spark, SF).collect()}
    want = {n: (os.path.getsize(f"{SF}/{n}"), hashlib.sha256(open(f"{SF}/{n}", "rb").read()).hexdigest(), 1) for n in os.listdir(SF) if n.endswith(".parquet")}
    assert got == want
    assert {(r.name, r.state) for r in registry.queries()["s09_manifest_verify"](spark, SF).collect()} == {(n, "ok") for n in want}


def test_sinks_replace_projects_and_batches(spark, tmp_path):
    d = str(tmp_path / "out")
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 3, "é"), (None, 4, "n")], "project string, k long, s string")

    def now():
        return sorted((r.project or "", r.payload) for r in sinks.read_payloads(spark, d).collect())

    sinks.write_payloads(sinks.as_json(rows), d)
    whole = now()
    assert whole == [("", '{"k":4,"s":"n"}'), ("a", '{"k":1,"s":"x"}'), ("a", '{"k":2}'), ("b", '{"k":3,"s":"é"}')]
    sinks.write_payloads(sinks.as_json(rows), d)
    assert now() == whole
    sinks.write_payloads(sinks.as_json(rows.where("project = 'a'").withColumn("k", F.col("k") + 10)), d)
    assert [x for x in now() if x[0] != "a"] == [x for x in whole if x[0] != "a"] and len(now()) == 4
    assert "\n" in sinks.as_json(rows, pretty=True).first().payload
    stream = str(tmp_path / "stream")
    write = sinks.batch_writer(stream)
    write(rows, 0)
    write(rows.limit(2), 1)
    write(rows, 0)  # a batch that is tried again
    assert spark.read.parquet(stream).groupBy("batch").count().orderBy("batch").collect() == [(0, 4), (1, 2)]


def test_skipped_files_are_disclosed(spark, tmp_path):
    p = tmp_path / "logs" / "p"
    p.mkdir(parents=True)
    (p / f"{uuid.uuid4()}.jsonl").write_bytes(b"z" * 200)
    (p / f"{uuid.uuid4()}.jsonl").write_bytes(b"z\n")
    for _ in range(2):
        sinks.write_skipped(T.listing(spark, str(tmp_path / "logs"), max_bytes=100), str(tmp_path / "skipped"))
    assert [(r.project, r["size"], r.skipped) for r in spark.read.parquet(str(tmp_path / "skipped")).collect()] == [("p", 200, "oversize")]
