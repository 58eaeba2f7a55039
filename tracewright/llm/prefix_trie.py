"""Prefix trie of conversations, built as a z-fast trie in distributed tables.

A node is a distinct sequence of first turns, known by the digest of these turns. Only compacted nodes are
kept while building: the root, ends of conversations and branchings. Each is entered in a hash table under
its handle: the digest of its prefix at the two-fattest depth of its edge, the number in (parent's depth,
own depth] that the largest power of two divides. Fat binary search looks a conversation up in as many
steps as its length has bits: probe the two-fattest depth left, go below a node whose whole prefix is
met, above otherwise; a step is a join of all searching conversations with the table of handles.
From the deepest node met, the edge under the next turn's digest leads to the exit node, and the
conversation's common prefix with that edge ends where it leaves the trie.

Conversations are inserted in batches. Those of a batch that leave the trie at one place with one turn are
led by one of them, drawn by hash, which becomes a path of its own; the others are compared with its
path, and leave it further down, until none is left. Every branch cuts the path it leaves. At the
end, sums of conversations at compacted nodes are spread over edges, which expand to a row each depth.

All tables hold a row a turn or less, and no conversation is gathered: digests of prefixes are running
XORs of digests of (depth, role, text), made a span of depths at a time. Sequences that occur more than
once are built once; ids of conversations that end together are hashed from sorted chunks, in one stream a node.

Defined cases: rows with a null id belong to no conversation; null roles and texts are empty; turns sort by
turn, nulls first, then role and text; texts of any length are digested whole; an empty table gives
an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialise, release
from .turns import SPAN, numbered, ranges

MOST_SHARED = 6  # turns are taken from the donor below crc32(id) % MOST_SHARED
DONORS = 100
CHUNK = 2000  # ids of one chunk of a node's list


# ---- rebuilt conversations


def shared_turns(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % MOST_SHARED


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id) of every conversation, and (conv_id, depth, a, b, len) of its rebuilt turns.

    a and b are two digests of role and text. The first shared turns come from conversation c - c%100.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    said = numbered(rows, "conv_id", "turn", ["role", "text"])
    said = materialise(said.select("conv_id", "pos", "size", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(7), "text", "role").alias("b"), F.length("text").cast("long").alias("len")), "said")
    every = said.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % DONORS).alias("donor"), shared_turns(F.col("conv_id")).alias("h"))
    given = said.where(F.col("pos") < MOST_SHARED).select(F.col("conv_id").alias("donor"), "pos", "size", "a", "b", "len")
    lent = every.join(given, "donor").where(F.col("pos") <= F.col("h")).select("conv_id", F.col("pos").alias("depth"), "a", "b", "len")
    sizes = given.where("pos = 1").select("donor", "size")
    shift = every.join(sizes, "donor", "left").select("conv_id", "h", F.least("h", F.coalesce("size", F.lit(0))).alias("m"))
    own = said.select("conv_id", "pos", "a", "b", "len").join(shift, "conv_id").where(F.col("pos") > F.col("h"))
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("depth"), "a", "b", "len")
    return every.select("conv_id"), own.unionByName(lent)


def with_prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, p, len, upto): the digest of the first depth turns and their code points."""
    turns = turns.withColumn("x", F.xxhash64("depth", "a", "b")).withColumn("y", F.xxhash64("b", "depth", "a", F.lit(3))).withColumn("_span", F.floor((F.col("depth") - 1) / SPAN))
    spans = turns.groupBy("conv_id", "_span").agg(F.bit_xor("x").alias("_x"), F.bit_xor("y").alias("_y"), F.sum("len").alias("_len"))
    before = Window.partitionBy("conv_id").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    spans = spans.select("conv_id", "_span", *[F.coalesce(f.over(before), zero).alias(c) for f, c in ((F.bit_xor("_x"), "_bx"), (F.bit_xor("_y"), "_by"), (F.sum("_len"), "_bl"))])
    upto = Window.partitionBy("conv_id", "_span").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    own = turns.select("*", F.bit_xor("x").over(upto).alias("_ox"), F.bit_xor("y").over(upto).alias("_oy"), F.sum("len").over(upto).alias("_ol"))
    p = F.struct(F.col("_ox").bitwiseXOR(F.col("_bx")).alias("x"), F.col("_oy").bitwiseXOR(F.col("_by")).alias("y"))
    return own.join(spans, ["conv_id", "_span"]).select("conv_id", F.col("depth").cast("long").alias("depth"), p.alias("p"), "len", (F.col("_ol") + F.col("_bl")).alias("upto"))


def sequences(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct sequences (seq, size, copies, total, p), seq the smallest id that has it, and (conv_id, seq) of those with copies."""
    last = turns.groupBy("conv_id").agg(F.max_by(F.struct("depth", "p", "upto"), "depth").alias("e")).select("conv_id", F.col("e.depth").alias("size"), "e.p", F.col("e.upto").alias("total"))
    last = materialise(last, "ends")
    found = last.groupBy("size", "p").agg(F.min("conv_id").alias("seq"), F.count("conv_id").alias("copies"), F.max("total").alias("total"))
    found = materialise(found, "sequences")
    return found, last.join(found.where("copies > 1").select("size", "p", "seq"), ["size", "p"]).select("conv_id", "seq")


# ---- the trie: paths (seq, above, size) and cuts (seq, depth); compacted nodes are made of both


def two_fattest(lo: Column, hi: Column) -> Column:
    """The number in (lo, hi] that the largest power of two divides."""
    return hi.bitwiseAND(-F.pow(F.lit(2.0), F.length(F.bin(lo.bitwiseXOR(hi))) - 1).cast("long"))


def compacted(paths: DataFrame, cuts: DataFrame, rows: DataFrame) -> DataFrame:
    """(seq, lo, hi, p, above, handle, hp, edge): edges of each path from cut to cut, their node at hi.

    above is the digest at lo (null at the root), edge that of the first turn below it, hp that at the handle's depth.
    """
    before = F.lag("depth").over(Window.partitionBy("seq").orderBy("depth"))
    edges = cuts.withColumn("lo", before).join(paths.select("seq", "above"), "seq")
    edges = edges.select("seq", F.coalesce("lo", "above").alias("lo"), F.col("depth").alias("hi")).withColumn("handle", two_fattest(F.col("lo"), F.col("hi")))
    asked = edges.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), d.alias("depth")) for k, d in enumerate((F.col("hi"), F.col("lo"), F.col("lo") + 1, F.col("handle")))])).alias("q"))
    told = asked.select("seq", "lo", "hi", "handle", "q.*").join(rows.select("seq", "depth", "p"), ["seq", "depth"])
    of = lambda k: F.max(F.when(F.col("k") == k, F.col("p")))
    return told.groupBy("seq", "lo", "hi", "handle").agg(of(0).alias("p"), of(1).alias("above"), of(2).alias("edge"), of(3).alias("hp"))


def locate(batch: DataFrame, nodes: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """(seq, size, host, m): of each sequence the first m turns are in the trie; host is the path it leaves there.

    host is null where it leaves the trie at a node for which no path has to be cut.
    """
    at = rows.select("seq", "depth", "p")
    now = batch.select("seq", "size", F.lit(0).cast("long").alias("a"), F.col("size").alias("b"))
    done: DataFrame | None = None
    handles = nodes.select(F.col("handle").alias("f"), F.col("hp").alias("fp"), F.col("hi").alias("_hi"), F.col("p").alias("_p"))
    for _ in range(most.bit_length() + 1):
        probe = now.withColumn("f", two_fattest(F.col("a"), F.col("b"))).join(at.select("seq", F.col("depth").alias("f"), F.col("p").alias("fp")), ["seq", "f"])
        hit = probe.join(handles, ["f", "fp"], "left")
        whole = at.select("seq", F.col("depth").alias("_hi"), F.col("p").alias("_p"), F.lit(True).alias("met"))
        hit = hit.join(whole, ["seq", "_hi", "_p"], "left")
        now = materialise(hit.select("seq", "size", F.when(F.col("met"), F.col("_hi")).otherwise(F.col("a")).alias("a"), F.when(F.col("met"), F.col("b")).otherwise(F.col("f") - 1).alias("b")), "searching")
        found = now.where("a >= b").select("seq", "size", "a")
        done = found if done is None else done.unionByName(found)
        now = now.where("a < b")
        if not now.limit(1).count():
            break
    else:
        raise RuntimeError("a search took more steps than its length has bits")
    out = done.withColumn("depth", F.col("a") + 1).join(at.withColumnRenamed("p", "edge"), ["seq", "depth"], "left").drop("depth")
    exits = nodes.select(F.col("seq").alias("host"), F.col("lo").alias("a"), "edge", "hi")
    out = materialise(out.join(exits, ["a", "edge"], "left").select("seq", "size", "a", "host", "hi"), "exits")
    shared = common(out.where("host is not null").select("seq", "host", F.col("a").alias("m"), F.least("size", "hi").alias("end")), rows)
    return out.join(shared, "seq", "left").select("seq", "size", "host", F.coalesce("m", "a").alias("m"))


def common(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(seq, m): the depth up to which seq and host have the same turns, of (seq, host, m, end), where m is known to be shared."""
    own = rows.select("seq", "depth", "p")
    mine = pairs.join(own, "seq").where((F.col("depth") > F.col("m")) & (F.col("depth") <= F.col("end"))).select("seq", "host", "depth", "p")
    theirs = own.withColumnRenamed("seq", "host")
    return mine.join(theirs, ["host", "depth", "p"]).groupBy("seq").agg(F.max("depth").alias("m"))


def insert(batch: DataFrame, paths: DataFrame | None, cuts: DataFrame | None, rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Paths and cuts of the trie with the batch's sequences (seq, size) in it."""
    if paths is None:
        pending = batch.select("seq", "size", F.lit(None).cast("long").alias("host"), F.lit(0).cast("long").alias("m"))
    else:
        nodes = materialise(compacted(paths, cuts, rows), "nodes")
        pending = materialise(locate(batch, nodes, rows, most), "pending")
        release(nodes)
    new_paths, new_cuts = paths, cuts
    at = rows.select("seq", "depth", "p", (F.col("upto") - F.col("len")).alias("before"))

    def more(all_: DataFrame | None, some: DataFrame) -> DataFrame:
        return some if all_ is None else all_.unionByName(some)

    while True:
        new_cuts = more(new_cuts, pending.where("host is not null").select(F.col("host").alias("seq"), F.col("m").alias("depth")))
        leaving = pending.where("m < size").withColumn("depth", F.col("m") + 1).join(at, ["seq", "depth"])
        leaving = materialise(leaving.select("seq", "size", "m", "p", "before"), "leaving")
        leads = materialise(leaving.groupBy("m", "p").agg(F.min_by("seq", F.xxhash64("seq")).alias("lead"), F.count("seq").alias("n")), "leads")
        led = leaving.join(leads.select("m", "p", "lead", "n"), ["m", "p"])
        first = led.where("seq = lead")
        new_paths = more(new_paths, first.select("seq", F.col("m").alias("above"), "size", "before"))
        new_cuts = new_cuts.unionByName(first.select("seq", F.col("size").alias("depth")))
        others = led.where("seq <> lead")
        if not leads.where("n > 1").limit(1).count():
            break
        others = materialise(others.select("seq", "size", F.col("lead").alias("host"), "m"), "others")
        shared = common(others.withColumn("end", F.col("size")), rows)
        pending = materialise(others.drop("m").join(shared, "seq"), "pending")
        release(others)
    return materialise(new_paths, "paths"), materialise(new_cuts.distinct(), "cuts")


# ---- lists of ids that end at a node


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (seq, conv_id) to (seq, first, ids): up to CHUNK ids joined by commas."""
    now, ids, done = None, [], []

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["seq", "first", "ids"])

    for b in batches:
        for seq, conv in zip(b.column("seq").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
            if ids and (seq != now or len(ids) == CHUNK):
                done.append((now, ids[0], ",".join(map(str, ids))))
                ids = []
            now = seq
            ids.append(conv)
        if len(done) >= 200:
            yield flush()
            done = []
    if ids:
        done.append((now, ids[0], ",".join(map(str, ids))))
    if done:
        yield flush()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, digest, done = None, None, []
    for b in batches:
        for seq, ids in zip(b.column("seq").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if seq != now:
                if digest:
                    done.append((now, digest.hexdigest()))
                now, digest = seq, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
    if digest:
        done.append((now, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), (pa.int64(), pa.string()), strict=True)], ["seq", "ends_sha256"])


def ends_digests(members: DataFrame) -> DataFrame:
    """(seq, ends_sha256) of (conv_id, seq): ids in ascending order, chunks of a range of (seq, id) each."""
    chunks = members.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(_chunks, "seq long, first long, ids string")
    return chunks.repartition("seq").sortWithinPartitions("seq", "first").mapInArrow(_digests, "seq long, ends_sha256 string")


# ---- the whole


def prefix_trie(conversations: DataFrame, shares: tuple[int, ...] = (1, 3)) -> DataFrame:
    """A row for each node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    Sequences are inserted in batches of about these shares, by a hash of their ids.
    """
    every, turns = rebuild(conversations)
    turns = materialise(with_prefixes(turns), "turns")
    every = materialise(every, "every")
    seqs, shared = sequences(turns)
    rows = materialise(turns.withColumnRenamed("conv_id", "seq").join(seqs.select("seq", "size", "copies", "total"), "seq"), "rows")
    most = seqs.agg(F.max("size")).head()[0] or 0

    paths = cuts = None
    draw, at = F.pmod(F.xxhash64("seq", F.lit(11)), F.lit(sum(shares))), 0
    for k in shares:
        batch = seqs.where((draw >= at) & (draw < at + k)).select("seq", "size")
        at += k
        paths, cuts = insert(batch, paths, cuts, rows, most)

    nodes = materialise(compacted(paths, cuts, rows), "nodes")
    children = nodes.groupBy(F.col("lo").alias("hi"), F.col("above").alias("p")).agg(F.count("seq").alias("n_children"))
    tops = nodes.select("hi", "p", "seq", "lo", "above").join(children.where("hi > 0"), ["hi", "p"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    tops = materialise(tops, "tops")

    # a sequence's code points from a node on, once for each copy, less those of the nodes that are its path's own
    leaf = seqs.select("seq", F.col("size").alias("hi"), "p").join(tops.where("n_children = 0").select("hi", "p"), ["hi", "p"]).select("seq", F.lit(1).alias("leaf"))
    owns = paths.select("seq", F.col("above").alias("own_above"), "before")
    seq_of = seqs.select("seq").join(leaf, "seq", "left").join(owns, "seq", "left")
    passing = rows.withColumnRenamed("depth", "hi").join(tops.select("hi", "p"), ["hi", "p"]).join(seq_of, "seq")
    rest = F.col("total") - F.col("upto") + F.col("len")
    mine = F.when(F.col("own_above").isNull(), 0).when(F.col("hi") > F.col("own_above"), rest).otherwise(F.col("total") - F.col("before"))
    sums = passing.groupBy("hi", "p").agg(F.min("seq").alias("conv_id"), F.sum("copies").alias("n_convs"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), F.sum(F.col("copies") * rest - mine).alias("saved"))
    single = seqs.where("copies = 1").select("seq", F.sha2(F.col("seq").cast("string").cast("binary"), 256).alias("ends_sha256"))
    ends = seqs.select("seq", F.col("size").alias("hi"), "p").join(single.unionByName(ends_digests(shared)), "seq").select("hi", "p", "ends_sha256")
    empty = F.lit(hashlib.sha256().hexdigest())
    full = materialise(tops.join(sums, ["hi", "p"]).join(ends, ["hi", "p"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", empty)), "full")

    # edges expand to a row each depth: all of them have the members of the node below
    least = every.agg(F.min("conv_id")).head()[0]
    above = full.select(F.col("hi").alias("lo"), F.col("p").alias("above"), F.col("conv_id").alias("parent"))
    edges = full.join(above, ["lo", "above"], "left").withColumn("parent", F.coalesce("parent", F.lit(least).cast("long")))
    one = ranges(F.col("lo") + 1, F.col("hi"), "depth", edges.select("seq", "lo", "hi", "conv_id", "parent", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256"))
    here = one.join(rows.select("seq", "depth", "len", "upto"), ["seq", "depth"])
    foot = rows.select("seq", F.col("depth").alias("hi"), (F.col("upto") - F.col("len")).alias("foot"))
    here = here.join(foot, ["seq", "hi"])
    last = F.col("depth") == F.col("hi")
    saved = F.col("saved") + F.when(last, 0).otherwise((F.col("n_convs") - 1) * (F.col("foot") - F.col("upto") + F.col("len")))
    out = here.select("conv_id", "depth", F.when(F.col("depth") == F.col("lo") + 1, F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs", F.when(last, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves", saved.alias("saved_tokens"), F.when(last, F.col("ends_sha256")).otherwise(empty).alias("ends_sha256"))

    # the root: conversations without turns end there
    turnless = every.join(turns.where("depth = 1").select("conv_id"), "conv_id", "left_anti").select("conv_id", F.lit(0).cast("long").alias("seq"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    parts = every.select("conv_id", F.lit(1).alias("n"), zero.alias("kids"), zero.alias("leaves"), zero.alias("saved")).unionByName(
        out.where("depth = 1").select(none.alias("conv_id"), F.lit(0).alias("n"), F.lit(1).cast("long").alias("kids"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
    root = parts.agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("kids").alias("n_children"), F.greatest(F.sum("leaves"), F.lit(1)).alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    root = root.where("n_convs > 0").withColumn("seq", zero).join(ends_digests(turnless), "seq", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", empty))
    return out.unionByName(root.withColumns({"depth": zero, "parent_conv_id": none}).drop("seq"))
