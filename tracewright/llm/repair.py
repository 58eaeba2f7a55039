"""Repair of damaged conversations by Hirschberg's divide and conquer over four states.

A conversation is right when its role initials are ``(s?(ua)+)?``. State 0 is the start, 1 after s, 2
after u, 3 after a. Each row is kept, given another role or deleted, and empty turns are inserted
before it; what that costs, and the letters it adds to the audit, depends on the row's class and on
the states before and after it. Of all cheapest edits the audit that is least in ASCII counts.

Costs run forward from the first row and backward from the last one and meet in the middle, as vectors of
four states. Beside its cost a state has the rank of its least audit among the four: two audits that
end with a row's letter at the same row are equal or differ before their ends, so ranks and the next
letters are all that later comparisons need, and no audit is stored. The crossing with least cost, then
least ranks, divides the rows; each half is solved alike. So time is n log n and memory linear.

Conversations are cut into blocks of BLOCK rows, which are tasks' work of their own: of a
conversation with several blocks each block first gives its sixteen costs from state to state, the
states at the cuts are chosen from these in the same way, then every block is solved between its states.

Defined cases: null ids, turns, roles and texts read as one space, a null id is a conversation; rows sort by
turn, nulls first, then role and text after damage; rows alike are duplicates of the first; texts of any
length are read whole and stream through the digest; an empty table gives an empty table; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialise
from .turns import numbered

BLOCK = 32_768
STATES = range(4)
WHITE = r"[\x20\x09-\x0D]"
ROLES = {"u": "user", "a": "assistant"}

# ---- row classes: the role's initial (s, u, a, other) times the fault (none or truncated or must go); END ends a conversation

INITIALS = "sua?"
END = 12
CLEAN, CUT, GONE = 0, 4, 8
_MOVES = {"u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "s": {0: 1}, "?": {}}


def _steps(kind: int) -> dict[tuple[int, int], tuple[int, str]]:
    """(state before, state after) -> (cost, letters) of the cheapest, then least, way over a row of this class."""
    found: dict[tuple[int, int], tuple[int, str]] = {}
    for start in STATES:
        state = start
        for inserted in range(3):
            ways: list[tuple[int, int, str]] = []
            if kind == END:
                ways += [(0, 0, "")] if state in (0, 3) else []
            else:
                ways.append((state, 3, "D"))
                extra = 1 if kind // 4 == 1 else 0
                if kind // 4 != 2:
                    own = INITIALS[kind % 4]
                    ways += [(_MOVES[own][state], extra, "K")] if state in _MOVES[own] else []
                    ways += [(_MOVES[r][state], 2 + extra, "R") for r in ROLES if state in _MOVES[r]]
            for end, cost, letter in ways:
                way = (cost + 2 * inserted, "I" * inserted + letter)
                found[start, end] = min(found.get((start, end), way), way)
            state = 3 if state == 2 else 2
    return found


STEPS = [_steps(k) for k in range(13)]
Vector = tuple[tuple[int, int] | None, ...]  # of each state (cost, rank), None if it can't be reached


def _ranked(found: Sequence[tuple | None]) -> Vector:
    """Costs from the least one on, and places of the sort keys that come with them; equal keys share a place."""
    least = min((f[0] for f in found if f), default=0)
    place = {k: i for i, k in enumerate(sorted({f[1] for f in found if f}))}
    return tuple(f and (f[0] - least, place[f[1]]) for f in found)


@functools.lru_cache(200_000)
def forward(vector: Vector, kind: int) -> Vector:
    """One row on. A vector may have several groups of four states, one for each state at the start."""
    out: list[tuple | None] = [None] * len(vector)
    for at, v in enumerate(vector):
        if v:
            for end in STATES:
                if step := STEPS[kind].get((at % 4, end)):
                    way = (v[0] + step[0], (v[1], step[1]))
                    to = at - at % 4 + end
                    out[to] = min(out[to], way) if out[to] else way
    return _ranked(out)


@functools.lru_cache(200_000)
def backward(vector: Vector, kind: int) -> Vector:
    out: list[tuple | None] = [None] * 4
    for (start, end), (cost, letters) in STEPS[kind].items():
        if v := vector[end]:
            way = (v[0] + cost, (letters, v[1]))
            out[start] = min(out[start], way) if out[start] else way
    return _ranked(out)


def only(state: int) -> Vector:
    return tuple((0, 0) if s == state else None for s in STATES)


def crossing(left: Vector, right: Vector) -> int:
    """The state where a cheapest way, of these the least audit, crosses."""
    return min((lv[0] + rv[0], lv[1], rv[1], s) for s, (lv, rv) in enumerate(zip(left, right, strict=True)) if lv and rv)[3]


def solve(kinds: bytes, start: int, end: int) -> list[str]:
    """The letters of each row between two states."""
    out: list[str] = []
    todo = [(0, len(kinds), start, end)]
    while todo:
        lo, hi, s, e = todo.pop()
        if hi - lo == 1:
            out.append(STEPS[kinds[lo]][s, e][1])
            continue
        mid = (lo + hi) // 2
        left, right = only(s), only(e)
        for k in kinds[lo:mid]:
            left = forward(left, k)
        for k in reversed(kinds[mid:hi]):
            right = backward(right, k)
        m = crossing(left, right)
        todo += [(mid, hi, m, e), (lo, mid, s, m)]
    return out


def matrix(kinds: bytes) -> list[list[int] | None]:
    """(cost, rank) from each state to each, sixteen entries; ranks compare all of them."""
    vector: Vector = tuple((0, 0) if at % 4 == at // 4 else None for at in range(16))
    base = 0
    for k in kinds:
        base += min(v[0] + c for at, v in enumerate(vector) if v for (s, _), (c, _) in STEPS[k].items() if s == at % 4)
        vector = forward(vector, k)
    return [v and [v[0] + base, v[1]] for v in vector]


def cuts(blocks: list[list[list[int] | None]], start: int, end: int) -> list[int]:
    """States before, between and after blocks, by halving over their matrices as ``solve`` does over rows."""

    def on(vector: Vector, m: list, back: bool) -> Vector:
        out: list[tuple | None] = [None] * 4
        for at, entry in enumerate(m):
            here, to = (at % 4, at // 4) if back else (at // 4, at % 4)
            if entry and (v := vector[here]):
                way = (v[0] + entry[0], (entry[1], v[1]) if back else (v[1], entry[1]))
                out[to] = min(out[to], way) if out[to] else way
        return _ranked(out)

    states = [start] * len(blocks) + [end]
    todo = [(0, len(blocks), start, end)]
    while todo:
        lo, hi, s, e = todo.pop()
        if hi - lo == 1:
            continue
        mid = (lo + hi) // 2
        left, right = only(s), only(e)
        for m in blocks[lo:mid]:
            left = on(left, m, False)
        for m in reversed(blocks[mid:hi]):
            right = on(right, m, True)
        states[mid] = crossing(left, right)
        todo += [(lo, mid, s, states[mid]), (mid, hi, states[mid], e)]
    return states


# ---- rows


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, key, turn, role, text) after damage by crc32(``conv_id:turn``) % 20."""
    spoken = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    k = F.crc32(F.concat(spoken[0], F.lit(":"), spoken[1]).cast("binary")) % 20
    rows = conversations.select("conv_id", spoken[0].alias("key"), "turn", spoken[2].alias("role"), spoken[3].alias("text"), k.cast("int").alias("k")).where("k <> 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("role", F.when(F.col("k") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("copy", F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("k")


def classify(rows: DataFrame) -> DataFrame:
    """Adds pos, size, fault (blank, duplicate, truncated or null) and kind, the row's class."""
    rows = numbered(rows, "key", "turn", ["role", "text", "copy"]).withColumn("said", F.struct(F.xxhash64("role", "text").alias("a"), F.xxhash64("text", "role", F.lit(1)).alias("b")))
    return rows.withColumn("blank", ~F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("whole", F.col("text").rlike(rf"[.!?]{WHITE}*\z"))


def _kinds(rows: DataFrame, first: DataFrame) -> DataFrame:
    fault = F.when(F.col("blank"), "blank").when(F.col("pos") > F.col("first"), "duplicate").when(~F.col("whole"), "truncated")
    initial = F.substring("role", 1, 1)
    own = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    base = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", CUT).otherwise(CLEAN)
    return rows.join(first, ["key", "said"]).withColumn("fault", fault).withColumn("initial", initial).withColumn("kind", (own + base).cast("int"))


def _by_block(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Rows (key, block, kind, start, end), sorted, to a row a block: its audit by rows, or its matrix."""
    key: object = None
    kinds, ends = bytearray(), (0, 0)
    done: list[tuple[str, int, list[str] | None, list | None]] = []

    def close() -> None:
        if kinds:
            m = None if whole else matrix(bytes(kinds))
            done.append((*key, solve(bytes(kinds), *ends) if whole else None, m and [e or [] for e in m]))

    def flush() -> pa.RecordBatch:
        cols = [*zip(*done, strict=True)]
        kind = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kind, strict=True)], ["key", "block", "letters", "costs"])

    for b in batches:
        for k, block, kind, s, e in zip(*(b.column(c).to_pylist() for c in ("key", "block", "kind", "start", "end")), strict=True):
            if (k, block) != key:
                close()
                key, ends = (k, block), (s, e)
                kinds.clear()
            kinds.append(kind)
        if len(done) >= 5000:
            yield flush()
            done = []
    close()
    if done:
        yield flush()


_SOLVED = "key string, block long, letters array<string>, costs array<array<long>>"


def _states(rows: DataFrame) -> DataFrame:
    """Of conversations with several blocks the states at the cuts: (key, block, start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks, out = None, [], []

        def close() -> None:
            if blocks:
                at = cuts(blocks, 0, 0)
                out.extend((now, i, at[i], at[i + 1]) for i in range(len(blocks)))

        for b in batches:
            for k, m in zip(b.column("key").to_pylist(), b.column("costs").to_pylist(), strict=True):
                if k != now:
                    close()
                    now, blocks = k, []
                blocks.append([e or None for e in m])
        close()
        if out:
            cols = [*zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.string(), pa.int64(), pa.int32(), pa.int32()], strict=True)], ["key", "block", "start", "end"])

    nothing = rows.select("key", "block", "pos", "kind", F.lit(0).alias("start"), F.lit(0).alias("end"))
    costs = _sorted(nothing).mapInArrow(lambda it: _by_block(it, False), _SOLVED)
    return costs.select("key", "block", "costs").repartition("key").sortWithinPartitions("key", "block").mapInArrow(run, "key string, block long, start int, end int")


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "block").sortWithinPartitions("key", "block", "pos")


def audits(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, block, letters): for each row of (key, pos, size, kind) its letters; a last one closes a conversation."""
    last = rows.where("pos = size").select("key", (F.col("pos") + 1).alias("pos"), "size", F.lit(END).alias("kind"))
    rows = rows.select("key", "pos", "size", "kind").unionByName(last)
    rows = rows.withColumn("block", F.floor((F.col("pos") - 1) / block)).withColumns({"start": F.lit(0), "end": F.lit(0)})
    several = rows.where(F.col("size") >= block)
    if several.limit(1).count():
        states = materialise(_states(several), "states")
        rows = rows.drop("start", "end").join(states, ["key", "block"], "left").fillna(0, ["start", "end"])
    return _sorted(rows.select("key", "block", "pos", "kind", "start", "end")).mapInArrow(lambda it: _by_block(it, True), _SOLVED).select("key", "block", "letters")


class _Repair:
    """One conversation's rows and letters, streamed in order."""

    def __init__(self, key: str):
        self.key, self.digest, self.audit = key, hashlib.sha256(), []
        self.cost, self.lines, self.before = 0, 0, ""

    def line(self, role: str, text: str) -> None:
        if self.lines:
            self.digest.update(b"\n")
        self.digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.lines += 1
        self.before = role[:1]

    def turn(self) -> str:
        return "a" if self.before == "u" else "u"

    def row(self, letters: str, role: str | None, text: str | None, cut: bool) -> None:
        self.audit.append(letters)
        for x in letters:
            if x == "I":
                self.line(ROLES[self.turn()], "")
            elif x == "R":
                self.line(ROLES[self.turn()], text)
            elif x == "K":
                self.line(role, text)
            self.cost += {"I": 2, "R": 2, "K": 0, "D": 3}[x] + (cut and x in "RK")


_ROWS = "key string, cost long, audit string, repaired_sha256 string"


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's letters come before its rows; the closing letters have no row."""
    now: _Repair | None = None
    letters: list[str] = []
    at = 0
    done: list[tuple] = []

    def rest() -> None:
        if now and at < len(letters):
            now.row(letters[at], None, None, False)

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), [pa.string(), pa.int64(), pa.string(), pa.string()], strict=True)], ["key", "cost", "audit", "repaired_sha256"])

    def close() -> None:
        rest()
        if now:
            done.append((now.key, now.cost, "".join(now.audit), now.digest.hexdigest()))

    for b in batches:
        cols = (b.column(c).to_pylist() for c in ("key", "letters", "role", "text", "fault"))
        for key, some, role, text, fault in zip(*cols, strict=True):
            if now is None or key != now.key:
                close()
                now, letters, at = _Repair(key), [], 0
            if some is not None:
                rest()
                letters, at = some, 0
            else:
                now.row(letters[at], role, text, fault == "truncated")
                at += 1
        if len(done) >= 5000:
            yield flush()
            done = []
    close()
    if done:
        yield flush()


def _count(fault: str) -> Column:
    return F.count_if(F.col("fault") == fault).alias(fault)


def repair(conversations: DataFrame, rows: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    ``rows`` are the damaged rows as ``damage`` gives them; without it, ``conversations`` are damaged here.
    """
    said = classify(damage(conversations) if rows is None else rows)
    said = materialise(said, "turns")
    first = said.groupBy("key", "said").agg(F.min("pos").alias("first"))
    kinds = materialise(_kinds(said.select("key", "turn", "pos", "size", "said", "blank", "whole", "role"), first).select("key", "turn", "pos", "size", "fault", "initial", "kind"), "kinds")

    # neighbours meet at the place of the second one
    then = kinds.select("key", (F.col("pos") + 1).alias("pos"), F.col("initial").alias("before"))
    pairs = kinds.join(then, ["key", "pos"], "left").withColumn("bad", F.col("before").isNotNull() & ~F.concat("before", "initial").isin("su", "ua", "au"))
    turns = kinds.select("key", "turn").distinct().groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    counts = pairs.groupBy("key").agg(_count("blank"), _count("duplicate"), _count("truncated"), F.count_if("bad").alias("illegal"))

    letters = audits(kinds, block).select("key", "block", F.lit(0).cast("long").alias("pos"), "letters", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("fault"))
    texts = said.select("key", "pos", "role", "text").join(kinds.select("key", "pos", "fault"), ["key", "pos"])
    texts = texts.select("key", F.floor((F.col("pos") - 1) / block).alias("block"), "pos", F.lit(None).cast("array<string>").alias("letters"), "role", "text", "fault")
    stream = letters.unionByName(texts).repartition("key").sortWithinPartitions("key", "block", "pos")
    fixed = stream.mapInArrow(_repaired, _ROWS)

    every = conversations.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("key")).distinct()
    out = every.join(turns, "key", "left").join(counts, "key", "left").join(fixed, "key", "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256().hexdigest()
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
