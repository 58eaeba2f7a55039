"""Exact duplicates: binary-fuse filters over immutable snapshots, exact buckets, byte checks.

Rows arrive in batches. The copies of a batch are grouped by themselves, by digest and text. Once taken
in, a batch's distinct texts are a snapshot that never changes: a table bucketed by digest (the exact
buckets) and static filters over the digests that were new with it. A later batch asks the filters
first; only digests that a filter has seen meet the buckets, where texts are compared byte by byte,
so a false positive costs a comparison and joins nothing. Everything else is new.

Texts are equal when they are identical without the characters of ``[\\x20\\x09-\\x0D]``. Of equal texts
the row with the most code points in the original stays, then the smallest id, null ids last.

Defined cases: a null text counts as empty, and all texts without other characters are one group; ids
may be null or repeat; of rows alike in id, text and length exactly one stays; texts of any length are
read whole; an empty table gives an empty table; columns other than id and text are ignored, whatever
their names.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialise, scratch_path

WHITE = " \t\n\x0b\x0c\r"
FILTER_KEYS = 200_000  # digests of one filter, and those that ask it in one task
FILTERS = "shard int, seed long, segment int, segments int, slots binary"
_BLOCK = 4096


# ---- binary-fuse filters (Graf and Lemire, 2022), three slots a key, one byte a slot


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(32))


def _slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """The three slots of each hash, in three segments that follow each other."""
    first = ((h >> np.uint64(32)) * np.uint64(segments * segment) >> np.uint64(32)).astype(np.int64)
    mask = np.uint64(segment - 1)
    second = (first + segment) ^ (h >> np.uint64(18) & mask).astype(np.int64)
    third = (first + 2 * segment) ^ (h & mask).astype(np.int64)
    return np.stack([first, second, third], 1)


def _fingerprints(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(40))).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segments, slots) of a static filter over distinct unsigned 64-bit keys.

    Slots that only one key uses are peeled in rounds; fingerprints are written in the opposite order,
    so each key's three slots add up to its own. A seed that can't be peeled to the end gives way to the next.
    """
    n = max(len(keys), 2)
    segment = min(1 << max(2, int(math.log(n) / math.log(3.33) + 2.25)), 1 << 18)
    room = round(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n)))
    segments = max(1, -(-room // segment) - 2)
    for seed in range(1000):
        h = _mixed(keys, seed)
        at = _slots(h, segment, segments)
        size = (segments + 2) * segment
        uses = np.bincount(at.ravel(), minlength=size)
        users = np.zeros(size, np.int64)  # of a slot that one key uses, that key
        np.add.at(users, at.ravel(), np.repeat(np.arange(len(keys)), 3))
        peeled: list[tuple[np.ndarray, np.ndarray]] = []
        lone, left = np.flatnonzero(uses == 1), len(keys)
        while len(lone):
            key, one = np.unique(users[lone], return_index=True)
            peeled.append((key, lone[one]))
            left -= len(key)
            touched = at[key].ravel()
            np.subtract.at(uses, touched, 1)
            np.subtract.at(users, touched, np.repeat(key, 3))
            touched = np.unique(touched)
            lone = touched[uses[touched] == 1]
        if not left:
            break
    else:
        raise RuntimeError("no seed gives a filter; are the keys distinct?")
    slots, marks = np.zeros(size, np.uint8), _fingerprints(h)
    for key, own in reversed(peeled):
        slots[own] = marks[key] ^ np.bitwise_xor.reduce(slots[at[key]], 1)
    return seed, segment, segments, slots.tobytes()


def may_hold(keys: np.ndarray, seed: int, segment: int, segments: int, slots: bytes) -> np.ndarray:
    """False only for keys that the filter was not built over; true for about one in 256 of those."""
    h = _mixed(keys, seed)
    return np.bitwise_xor.reduce(np.frombuffer(slots, np.uint8)[_slots(h, segment, segments)], 1) == _fingerprints(h)


# ---- snapshots


class Snapshot:
    """A batch once taken in: its distinct texts bucketed by digest, and filters over its new digests."""

    def __init__(self, number: int, texts: DataFrame, filters: DataFrame, shards: int):
        self.number, self.texts, self.filters, self.shards = number, texts, filters, shards


def bucketed(df: DataFrame, name: str, key: str = "h") -> DataFrame:
    """A table in the shared folder whose files are bucketed by ``key``: joins on it don't shuffle it."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    w = df.repartition(n, key).write.bucketBy(n, key).sortBy(key)
    w.option("path", scratch_path(spark, name)).option("compression", "zstd").format("parquet").saveAsTable(table)
    return spark.table(table)


def _filters(digests: DataFrame, shards: int) -> DataFrame:
    """A filter for each shard of distinct digests."""

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        seed, segment, segments, slots = build_filter(rows.column("h").to_numpy().view(np.uint64))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "seed": pa.array([seed], pa.int64()), "segment": pa.array([segment], pa.int32()), "segments": pa.array([segments], pa.int32()), "slots": pa.array([slots], pa.binary())})

    return digests.select(_shard(shards).alias("shard"), "h").groupBy("shard").applyInArrow(build, FILTERS)


def _sha(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int")


def screen(digests: DataFrame, many: int, snapshot: Snapshot) -> DataFrame:
    """Those of ``many`` distinct digests that the snapshot's filters may hold.

    A shard's digests meet its filter in groups of bounded size: the filter is dealt to each group.
    """
    groups = max(1, -(-many // (snapshot.shards * FILTER_KEYS)))

    def ask(rows: pa.Table, filters: pa.Table) -> pa.Table:
        if not rows.num_rows or not filters.num_rows:
            return pa.table({"h": pa.array([], pa.int64())})
        f = filters.to_pylist()[0]
        held = may_hold(rows.column("h").to_numpy().view(np.uint64), f["seed"], f["segment"], f["segments"], f["slots"])
        return pa.table({"h": rows.column("h").filter(pa.array(held))})

    asked = digests.select(_shard(snapshot.shards).alias("shard"), F.pmod(F.xxhash64("h", F.lit(1)), F.lit(groups)).alias("g"), "h")
    dealt = snapshot.filters.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    return asked.groupBy("shard", "g").cogroup(dealt.groupBy("shard", "g")).applyInArrow(ask, "h long")


def take_in(batch: DataFrame, snapshots: list[Snapshot]) -> tuple[DataFrame, Snapshot]:
    """A batch of (id, n, h, norm) against earlier snapshots.

    Gives (h, sha, best, copies, owner) of the batch's distinct texts, owner the number of the snapshot
    that had the text first, and the batch as a snapshot of its own.
    """
    number = len(snapshots)
    best = F.max(F.struct("n", F.bitwise_not("id").alias("not_id")))  # the largest complement is the smallest id
    texts = batch.groupBy("h", "norm").agg(best.alias("best"), F.count("n").alias("copies")).withColumn("sha", _sha(F.col("norm")))
    texts = bucketed(texts, f"snapshot{number}")
    many = texts.count()
    links = texts.select("h", "sha", "best", "copies", F.lit(None).cast("int").alias("owner"))
    if snapshots:
        digests = texts.select("h").distinct()
        found = None
        for s in snapshots:
            seen = materialise(screen(digests, many, s), "seen")
            asked = texts.join(seen, "h", "left_semi").select("h", "norm", "sha")
            known = s.texts.select("h", F.col("norm").alias("_norm"))
            same = asked.join(known, "h").where(F.col("norm") == F.col("_norm")).select("h", "sha", F.lit(s.number).alias("owner"))
            found = same if found is None else found.unionByName(same)
        found = materialise(found.groupBy("h", "sha").agg(F.min("owner").alias("owner")), "found")
        links = links.drop("owner").join(found, ["h", "sha"], "left")
    links = materialise(links, "links")
    fresh = links.where("owner is null").select("h").distinct()
    shards = max(1, -(-links.where("owner is null").count() // FILTER_KEYS))
    snapshot = Snapshot(number, texts, materialise(_filters(fresh, shards), "filters"), shards)
    return links.withColumn("owner", F.coalesce("owner", F.lit(number))).withColumn("batch", F.lit(number)), snapshot


def deal(df: DataFrame, shares: tuple[int, ...], id_col: str) -> list[DataFrame]:
    """All rows in batches of about these shares, by a hash of the id."""
    total, at, out = sum(shares), 0, []
    draw = F.pmod(F.xxhash64(id_col), F.lit(total))
    for k in shares:
        out.append(df.where((draw >= at) & (draw < at + k)))
        at += k
    return out


def exact_duplicates(batches: list[DataFrame], id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of the batches, taken in one after another."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = [
        b.select(F.col(id_col).cast("long").alias("id"), F.length(text).alias("n"), F.translate(text, WHITE, "").alias("norm")).withColumn("h", digest(F.col("norm")))
        for b in batches
    ]
    snapshots: list[Snapshot] = []
    links: DataFrame | None = None
    for batch in rows:
        new, snapshot = take_in(batch, snapshots)
        snapshots.append(snapshot)
        links = new if links is None else links.unionByName(new)

    key = ["batch", "h", "sha"]
    members = None
    for k, batch in enumerate(rows):
        some = batch.select(F.lit(k).alias("batch"), "h", _sha(F.col("norm")).alias("sha"), "id", "n")
        members = some if members is None else members.unionByName(some)
    members = materialise(members, "members")
    groups = links.groupBy("owner", "h", "sha").agg(F.max("best").alias("best"), F.sum("copies").alias("size"))
    resolved = links.select(*key, "owner").join(groups, ["owner", "h", "sha"])
    resolved = resolved.select(*key, "owner", F.col("best.n").alias("keep_n"), F.bitwise_not("best.not_id").alias("keep_id"), "size")
    # rows alike in id, length and text: the group's line says how many there are of the one that stays
    alike = members.groupBy("h", "sha", "id", "n").agg(F.count("h").alias("alike")).where("alike > 1")
    alike = alike.select(F.col("h").alias("_h"), F.col("sha").alias("_sha"), F.col("id").alias("_id"), F.col("n").alias("_n"), "alike")
    its = (F.col("h") == F.col("_h")) & (F.col("sha") == F.col("_sha")) & (F.col("keep_n") == F.col("_n")) & F.col("keep_id").eqNullSafe(F.col("_id"))
    resolved = materialise(resolved.join(alike, its, "left").drop("_h", "_sha", "_id", "_n"), "resolved")
    best = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n"))
    joined = members.join(resolved, key).withColumn("best", best)
    plain = joined.where(~F.col("best") | F.col("alike").isNull()).select("id", "keep_id", "size", F.col("best").alias("kept"), "sha")
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("alike") - 1) / _BLOCK)))
    spread = resolved.where("alike is not null and batch = owner").select("*", blocks.alias("_b"))
    one = F.explode(F.sequence(F.col("_b") * _BLOCK, F.least(F.col("alike"), (F.col("_b") + 1) * _BLOCK) - 1))
    spread = spread.select(F.col("keep_id").alias("id"), "keep_id", "size", "sha", one.alias("_i")).select("id", "keep_id", "size", (F.col("_i") == 0).alias("kept"), "sha")
    return plain.unionByName(spread).select(F.col("id").alias("doc_id"), "keep_id", F.col("size").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256"))
