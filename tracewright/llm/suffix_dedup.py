"""Removal of repeated byte strings by suffix arrays in shards.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same
document or another. Which starts repeat is found in four steps:

1. Every string of ``length`` bytes has an anchor: the least hash of its ``ANCHOR``-byte strings,
   leftmost on ties. Equal strings have equal anchors, so only strings of one anchor are compared.
   Consecutive starts of one anchor make a window of text; anchors seen once anywhere are done.
2. Windows go to shards by anchor, identical ones collapsed into one with a count. A shard's suffix
   array comes from Larsson-Sadakane refinement (ranks of h bytes double to 2h; groups that are
   already apart aren't sorted again), stopped once ``length`` bytes are told apart.
3. Kasai's common prefixes of neighbours in that order, at least ``length`` long, mark repeats: the
   prefix is measured once for a run of starts whose neighbour moves along, and falls by one a step.
4. Shards hold a bounded amount of text. Where an anchor's windows lie in several shards, each
   shard's starts are looked up in the others' arrays by binary search. Anchors with more windows
   than one task should hold are dealt out as pairs of chunks.

Windows identical elsewhere repeat as a whole. No window is dropped, whatever its anchor's count.
Texts are told apart by 128 bits of hash. A text that several rows have is read for its windows once a
task, and all its rows lose all of it, so copies cost what they cost to read.

Defined cases: null and empty texts and those shorter than ``length`` keep all; rows of equal text, with
equal ids or not, repeat each other; ids may be null; an empty table gives an empty table; documents of any
size are cut into overlapping stretches of starts; other columns are ignored
unless carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialise, release, trim

ANCHOR = 64
#: Starts of a document that are handled at once.
STRETCH = 4 << 20
#: Bytes of windows in a shard; windows of one anchor in a task.
SHARD_BYTES = 1 << 19
TASK_WINDOWS = 30_000
#: Documents whose windows or results a task holds at a time.
ROWS = 200
_MULT = [np.uint64(int(m, 16)) for m in ("9E3779B97F4A7C15", "C2B2AE3D27D4EB4F", "165667B19E3779F9", "D6E8FEB86659FD93")]


def words_at(x: np.ndarray, kind: str) -> np.ndarray:
    """The 8-byte word that begins at each byte of ``x`` but the last seven."""
    x = np.ascontiguousarray(x)
    return np.ndarray((max(0, len(x) - 7),), kind, x, strides=(1,)).astype(np.uint64)


def anchors(x: np.ndarray, length: int, size: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first start, last start) of each run of starts that share an anchor."""
    n = len(x) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = words_at(x, "<u8")
    k = len(x) - size + 1
    h = np.zeros(k, np.uint64)
    for i in range(0, size, 8):
        h ^= w[i : i + k]
        h *= _MULT[i // 8 % 4]
        h ^= h >> np.uint64(29)
    h *= _MULT[1]
    h ^= h >> np.uint64(32)
    span = length - size + 1
    low = np.uint64((1 << 24) - 1)
    key = (h & ~low) | np.arange(k, dtype=np.uint64)  # the least is the leftmost of the least hashes
    blocks = -(-k // span)
    padded = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
    padded[:k] = key
    grid = padded.reshape(blocks, span)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(grid, axis=1).ravel()
    at = (np.minimum(ahead[:n], behind[span - 1 : span - 1 + n]) & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return h[at[first]], first, np.append(first[1:], n) - 1


def stretches(raw: bytes, length: int) -> Iterator[tuple[int, np.ndarray]]:
    x = np.frombuffer(raw, np.uint8)
    for at in range(0, max(0, len(x) - length + 1), STRETCH):
        yield at, x[at : at + STRETCH + length - 1]


class Shard:
    """Windows laid end to end, with the order of the starts they own by their first ``length`` bytes."""

    def __init__(self, windows: list[bytes], group: np.ndarray, length: int):
        sizes = np.array([len(w) for w in windows])
        own = sizes - length + 1
        begins = np.cumsum(sizes) - sizes
        text = np.frombuffer(b"".join(windows) + bytes(length + 16), np.uint8)
        self.length, self.own, self.group = length, own, group
        self.word = words_at(text, ">u8")
        total = int(sizes.sum())
        self.window_of_start = np.repeat(np.arange(len(windows)), own)
        self.starts = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own) + np.repeat(begins, own)
        past = np.arange(total) - np.repeat(begins, sizes) - np.repeat(own, sizes)
        self.order = self._refine(total, past)
        self.number = np.full(total, -1, np.int32)
        self.number[self.starts] = np.arange(len(self.starts))

    def _refine(self, total: int, past: np.ndarray) -> np.ndarray:
        """Larsson-Sadakane refinement; past: how far a byte lies behind its window's last own start."""
        length = self.length
        steps, h = [], 8
        while 2 * h <= length:
            steps.append((h, 2 * h))
            h *= 2
        if h < length:
            steps.append((length - h, length))
        reach = [0]  # ranks of a step are needed this far behind the own starts
        for h, _ in reversed(steps):
            reach.insert(0, reach[0] + h)
        at = np.flatnonzero(past < reach[0])
        key = self.word[at]
        by = np.argsort(key, kind="stable")
        order, key = at[by], key[by]
        rank = np.zeros(total + length + 16, np.int64)
        new = np.concatenate([[True], key[1:] != key[:-1]])[: len(order)]
        for (h, _), need in zip(steps, reach[1:], strict=True):
            head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            rank[order] = head + 1
            keep = past[order] < need
            order, head = order[keep], head[keep]
            new = np.concatenate([[True], head[1:] != head[:-1]])[: len(order)]
            alone = new & np.append(new[1:], True)
            rest = np.flatnonzero(~alone)
            if not len(rest):
                continue
            member = order[rest]
            pair = head[rest] * (total + 2) + rank[member + h]
            by = np.argsort(pair, kind="stable")
            order[rest] = member[by]
            pair = pair[by]
            new[rest[1:]] |= pair[1:] != pair[:-1]
        return order

    def common_prefixes(self) -> np.ndarray:
        """Kasai: the prefix that each start in the order shares with the one before it, long enough to compare with ``length``."""
        n = len(self.order)
        lcp = np.zeros(n, np.int64)
        if n < 2:
            return lcp
        before = np.full(len(self.number) + 1, -2)
        before[self.order[1:]] = self.order[:-1]
        i = np.sort(self.order[1:])
        j = before[i]
        # where the start before has the neighbour before and shares a byte with it, the prefix is one less
        shares = (self.word[i[:-1]] ^ self.word[j[:-1]]) >> np.uint64(56) == 0
        moves = np.concatenate([[False], (i[1:] == i[:-1] + 1) & (j[1:] == j[:-1] + 1) & shares])
        runs = np.flatnonzero(~moves)
        size = np.diff(np.append(runs, len(i)))
        a, b, most = i[runs], j[runs], self.length + size
        got = np.zeros(len(runs), np.int64)
        live = np.arange(len(runs))
        top = len(self.word)
        while len(live):
            p, q = a[live] + got[live], b[live] + got[live]
            inside = np.maximum(p, q) < top
            live, p, q = live[inside], p[inside], q[inside]
            differ = self.word[p] ^ self.word[q]
            same = differ == 0
            got[live[same]] += 8
            bits = np.frexp(differ[~same].astype(np.float64))[1]
            # a word rounded up to the next power of two would seem one bit longer
            bits = np.minimum(bits, 64)
            bits = np.where((bits > 0) & ((differ[~same] >> (bits - 1).astype(np.uint64)) == 0), bits - 1, bits)
            got[live[~same]] += (64 - bits) // 8
            live = live[same]
            live = live[got[live] < most[live]]
        value = np.repeat(got, size) - (np.arange(len(i)) - np.repeat(runs, size))
        place = np.empty(len(self.number) + 1, np.int64)
        place[self.order] = np.arange(n)
        lcp[place[i]] = value
        return lcp

    def repeats(self) -> np.ndarray:
        """For each own start whether its string is in the shard again."""
        long = self.common_prefixes() >= self.length
        found = np.zeros(len(self.starts), bool)
        found[self.number[self.order[long]]] = True
        found[self.number[self.order[:-1][long[1:]]]] = True
        return found

    def compare(self, mine: np.ndarray, other: Shard, theirs: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for the strings at ``mine`` against those at ``theirs`` in the other shard."""
        out = np.zeros(len(mine), np.int64)
        live = np.arange(len(mine))
        for at in [*range(0, self.length - 7, 8), self.length - 8]:
            p, q = self.word[mine[live] + at], other.word[theirs[live] + at]
            apart = p != q
            out[live[apart]] = np.where(p[apart] < q[apart], -1, 1)
            live = live[~apart]
            if not len(live):
                break
        return out

    def of_group(self, group: int) -> np.ndarray:
        """The starts of a group, in order."""
        return self.order[self.group[self.window_of_start[self.number[self.order]]] == group]

    def found_in(self, other: Shard, group: int) -> np.ndarray:
        """Own starts of ``group`` whose strings the other shard has, by binary search in its order."""
        mine, theirs = self.of_group(group), other.of_group(group)
        lo, hi = np.zeros(len(mine), np.int64), np.full(len(mine), len(theirs))
        if not len(mine) or not len(theirs):
            return mine[:0]
        while True:
            live = np.flatnonzero(lo < hi)
            if not len(live):
                break
            mid = (lo[live] + hi[live]) // 2
            less = self.compare(mine[live], other, theirs[mid]) > 0
            lo[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
        there = np.flatnonzero(lo < len(theirs))
        return mine[there[self.compare(mine[there], other, theirs[lo[there]]) == 0]]


def _runs(flags: np.ndarray) -> bytes:
    """[first, last] pairs of the runs of set flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1], axis=1).astype("<i4").tobytes()


def _shard_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Windows sorted by task group -> the runs of repeated starts of each."""
    open_: list[tuple[Shard, np.ndarray, list, list, np.ndarray]] = []  # shards that share the last group
    rows: list[list] = []
    size, number, last = 0, -1, None

    def give(done: list) -> Iterator[pa.RecordBatch]:
        for shard, found, anchor, wid, many in done:
            found |= many[shard.window_of_start]
            cuts = np.cumsum(shard.own) - shard.own
            some = np.flatnonzero(np.add.reduceat(found.astype(np.int64), cuts) > 0) if len(cuts) else cuts
            runs = [_runs(found[cuts[i] : cuts[i] + shard.own[i]]) for i in some]
            yield pa.RecordBatch.from_arrays([pa.array([anchor[i] for i in some], pa.int64()), pa.array([wid[i] for i in some], pa.int64()), pa.array(runs, pa.binary())], ["anchor", "wid", "runs"])

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal open_, rows, size
        group = np.array([r[0] for r in rows])
        shard = Shard([r[3] for r in rows], group, length)
        now = (shard, shard.repeats(), [r[1] for r in rows], [r[2] for r in rows], np.array([r[4] > 1 for r in rows]))
        rows, size = [], 0
        first = group[0]
        if open_ and open_[-1][0].group[-1] == first:
            for other, found, *_ in open_:
                mine = shard.found_in(other, first)
                now[1][shard.number[mine]] = True
                theirs = other.found_in(shard, first)
                found[other.number[theirs]] = True
        else:
            yield from give(open_)
            open_ = []
        open_.append(now)
        if group[-1] != first and len(open_) > 1:  # the earlier shards' last group ends here
            yield from give(open_[:-1])
            open_ = open_[-1:]

    for b in batches:
        cols = (b.column(c).to_pylist() for c in ("anchor", "part", "wid", "win", "n"))
        for anchor, part, wid, win, n in zip(*cols, strict=True):
            if (anchor, part) != last:
                last, number = (anchor, part), number + 1
            elif rows and rows[-1][0] == number and rows[-1][2] == wid:
                rows[-1][4] += n
                continue
            if size >= SHARD_BYTES:
                yield from close()
            rows.append([number, anchor, wid, win, n])
            size += len(win)
    if rows:
        yield from close()
    yield from give(open_)
    open_ = []
    trim()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


#: Texts that a task remembers as read.
REMEMBERED = 100_000
TEXT = ["rid", "rid2"]
WINDOWS = "anchor long, wid long, rid long, rid2 long, starts binary, n int, win binary"
_WINDOWS_ARROW = pa.schema([("anchor", pa.int64()), ("wid", pa.int64()), ("rid", pa.int64()), ("rid2", pa.int64()), ("starts", pa.binary()), ("n", pa.int32()), ("win", pa.binary())])


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Each text's anchors, with 2 for those it has more than once and 1 for others; its first one counts its rows.

    Of a text that the task has met before only that count goes on, with its first anchor.
    """
    met: dict[tuple[int, int], int] = {}
    for b in _slices(batches):
        found, owner, many, copies = [], [], [], []
        for *text, raw in zip(*(b.column(c).to_pylist() for c in (*TEXT, "raw")), strict=True):
            if (again := met.get(tuple(text))) is not None:
                found.append(np.array([again], np.uint64))
                owner.append(np.array([text]))
                many.append(np.ones(1, np.int64))
                copies.append(np.ones(1, np.int32))
                continue
            for at, x in stretches(raw, length):
                h, n = np.unique(anchors(x, length)[0], return_counts=True)
                if not at:
                    if len(met) >= REMEMBERED:
                        met.clear()
                    met[tuple(text)] = int(h[0])
                found.append(h)
                owner.append(np.tile(np.array(text), (len(h), 1)))
                many.append(np.minimum(n, 2))
                copies.append((np.arange(len(h)) == 0).astype(np.int32) if not at else np.zeros(len(h), np.int32))
        if found:
            own = np.concatenate(owner)
            cols = [np.concatenate(found).view(np.int64), own[:, 0], own[:, 1], np.concatenate(many).astype(np.int32), np.concatenate(copies)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["anchor", *TEXT, "n", "copies"])


def _window_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Windows of the anchors in ``anchors``: a row with the text for each distinct window of a batch,
    and a row with the starts for each document that has it, unless other rows have its whole text (``twin``)."""
    import xxhash

    met: set[tuple[int, int]] = set()
    for b in _slices(batches):
        texts: dict[tuple[int, bytes], int] = {}
        rows: list[tuple] = []
        for *rid, raw, twin, wanted in zip(*(b.column(c).to_pylist() for c in (*TEXT, "raw", "twin")), b.column("anchors"), strict=True):
            if twin:
                if tuple(rid) in met:
                    continue
                if len(met) >= REMEMBERED:
                    met.clear()
                met.add(tuple(rid))
            wanted = np.unique(wanted.values.to_numpy()).view(np.uint64)
            own: dict[tuple[int, bytes], list[int]] = {}
            for at, x in stretches(raw, length):
                h, first, last = anchors(x, length)
                for i in np.flatnonzero(np.isin(h, wanted)):
                    lo = at + int(first[i])
                    own.setdefault((int(h[i].view(np.int64)), raw[lo : at + int(last[i]) + length]), []).append(lo)
            for key, starts in own.items():
                texts[key] = texts.get(key, 0) + len(starts) + bool(twin)
                if not twin:
                    rows.append((key, *rid, np.array(starts, "<i4").tobytes()))
        name = {key: (xxhash.xxh64_intdigest(key[1]) ^ (1 << 63)) - (1 << 63) for key in texts}
        for at in range(0, len(rows), 50_000):
            some = rows[at : at + 50_000]
            k = len(some)
            yield pa.RecordBatch.from_arrays([pa.array([r[0][0] for r in some], pa.int64()), pa.array([name[r[0]] for r in some], pa.int64()), pa.array([r[1] for r in some], pa.int64()), pa.array([r[2] for r in some], pa.int64()), pa.array([r[3] for r in some], pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], schema=_WINDOWS_ARROW)
        keys = list(texts)
        for at in range(0, len(keys), 10_000):
            some = keys[at : at + 10_000]
            k = len(some)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.int64()), pa.array([name[x] for x in some], pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array([min(texts[x], 2) for x in some], pa.int32()), pa.array([x[1] for x in some], pa.binary())], schema=_WINDOWS_ARROW)


def _cut(raw: bytes, spans: list[dict] | None, twin: bool | None, length: int, characters: bool = False) -> tuple[int, int, bytes]:
    """(bytes removed, removed runs, the rest); a twin goes whole, with ``characters`` those that are cut in part."""
    if twin and len(raw) >= length:
        return len(raw), 1, b""
    if not spans:
        return 0, 0, raw
    step = np.zeros(len(raw) + 1, np.int32)
    for s in spans:
        starts = np.frombuffer(s["starts"], "<i4")
        runs = np.frombuffer(s["runs"], "<i4").reshape(-1, 2)
        np.add.at(step, (starts[:, None] + runs[None, :, 0]).ravel(), 1)
        np.add.at(step, (starts[:, None] + runs[None, :, 1] + length).ravel(), -1)
    gone = np.cumsum(step[:-1]) > 0
    if characters:
        begins = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        begins[0] = True
        gone = np.logical_or.reduceat(gone, np.flatnonzero(begins))[np.cumsum(begins) - 1]
    edges = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
    return int(gone.sum()), edges, np.frombuffer(raw, np.uint8)[~gone].tobytes()


def _dealt(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Windows of anchors with too many for one task: chunks by window, each pair of chunks a part."""
    size = hot.select("anchor", F.ceil(2 * F.col("variants") / TASK_WINDOWS).cast("int").alias("chunks"))
    chunk = F.pmod("wid", F.coalesce("chunks", F.lit(1))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1))
    pairs = rows.join(size, "anchor", "left").select("*", chunk.alias("c"), other.alias("d"))
    part = F.when(F.coalesce("chunks", F.lit(1)) > 1, F.least("c", "d") * F.col("chunks") + F.greatest("c", "d")).otherwise(F.lit(0))
    return pairs.select("anchor", part.cast("int").alias("part"), "wid", "n", "win")


def remove_repeats(df: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), characters: bool = False) -> DataFrame:
    """Rows of (doc_id, carried columns, n_bytes, n_removed, n_spans, kept binary).

    With ``characters`` what is left is UTF-8 again: a character that a cut would halve goes whole.
    """
    if length < ANCHOR + 8:
        raise ValueError(f"length must be at least {ANCHOR + 8}")
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    own = [f"_c{i}" for i in range(len(carry))]  # carried columns may have any name meanwhile
    docs = df.select(F.col(id_col).alias("doc_id"), *[F.col(c).alias(o) for c, o in zip(carry, own, strict=True)], F.xxhash64(raw).alias("rid"), F.xxhash64(F.lit(1), raw).alias("rid2"), raw.alias("raw"))
    seen = materialise(docs.select(*TEXT, "raw").mapInArrow(lambda it: _anchor_rows(it, length), "anchor long, rid long, rid2 long, n int, copies int"), "anchors")
    twins = materialise(seen.where("copies > 0").groupBy(*TEXT).agg(F.sum("copies").alias("copies")).where("copies > 1").select(*TEXT, F.lit(True).alias("twin")), "twins")
    twice = seen.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    wanted = seen.join(twice, "anchor", "left_semi").groupBy(*TEXT).agg(F.collect_set("anchor").alias("anchors")).join(twins, TEXT, "left")
    windows = materialise(docs.select(*TEXT, "raw").join(wanted, TEXT).mapInArrow(lambda it: _window_rows(it, length), WINDOWS), "windows")
    release(seen)

    texts = windows.where("win is not null")
    hot = texts.groupBy("anchor").agg(F.count("wid").alias("variants")).where(F.col("variants") > TASK_WINDOWS)
    dealt = texts.select("anchor", F.lit(0).alias("part"), "wid", "n", "win")
    if hot.limit(1).count():
        dealt = _dealt(texts.select("anchor", "wid", "n", "win"), hot)
    runs = dealt.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "wid").mapInArrow(lambda it: _shard_rows(it, length), "anchor long, wid long, runs binary")

    places = windows.where("starts is not null").select("anchor", "wid", *TEXT, "starts")
    spans = places.join(runs, ["anchor", "wid"]).groupBy(*TEXT).agg(F.collect_list(F.struct("starts", "runs")).alias("spans"))
    gone = spans.withColumn("twin", F.lit(False)).unionByName(twins.withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType)))
    names = ["doc_id", *carry]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            raws = b.column("raw").to_pylist()
            out = [_cut(r, s, t, length, characters) for r, s, t in zip(raws, b.column("spans").to_pylist(), b.column("twin").to_pylist(), strict=True)]
            cols = [b.column(c) for c in ["doc_id", *own]]
            cols += [pa.array([len(r) for r in raws], pa.int64()), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, [*names, "n_bytes", "n_removed", "n_spans", "kept"])
        trim()

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[o]}" for c, o in zip(names, ["doc_id", *own], strict=True)) + ", n_bytes long, n_removed long, n_spans long, kept binary"
    # an anchor of several parts gives the runs of a window once a part; they add up
    return docs.join(gone, TEXT, "left").mapInArrow(cut, schema)
