"""SimHash fingerprints and near-duplicate groups by a binary trie self-join.

``fingerprints`` lower-cases A-Z, takes words between ASCII white space and shingles of ``width``
words, repeats included, and sets a bit where over half of the shingles' XXH64 (seed 42) have it.

``link`` joins the distinct fingerprints with themselves. The bits are cut into ``blocks`` parts, so
two fingerprints within the error budget agree on all of ``blocks - budget`` parts; for each such
choice of parts the fingerprints that agree on them share a trie, whose node pairs are walked down
together, level by level: the differing bits add up, and a pair of nodes is dropped once they exceed
the budget. No pair is lost whatever ``blocks`` is; more parts make more, smaller tries. A task keeps
a spanning forest of the links it finds, never the pairs, and walks a frontier of bounded size.

Defined cases: a null or empty text, or one without words, has fingerprint zero and links like any
other; a text of fewer words than a shingle is one shingle; equal ids of different texts are one
node; a row without an id gets a fingerprint and the component of its fingerprint's links to rows
with ids, else null; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import connected_components, materialise, release, trim

SEED = 42
#: Node pairs of one frontier; more are walked in turns.
FRONTIER = 1_000_000


def fingerprint(text: str, width: int = 4) -> int:
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(map((1).__add__, map(len, words))))  # one past the space after each word
    last = max(1, len(words) - width + 1)
    spans = zip([0, *ends], ends[min(width, len(words)) - 1 :])
    hashes = np.array([h(joined[i : j - 1], SEED) for i, j in spans], dtype="<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > last, bitorder="little").tobytes(), "little")


def _fingerprint_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The first column and the fingerprint of the last, the text."""
    for b in batches:
        fp = np.array([fingerprint(t, width) for t in b.column(b.num_columns - 1).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], [b.schema.names[0], "fp"])


def fingerprints(df: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of (doc_id long, fp long); fp is the 64 bits as a signed number."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(lambda it: _fingerprint_rows(it, width), "doc_id long, fp long")


def _parts(blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of each part of the 64 bits, from the top."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [(64 - hi, hi - lo) for lo, hi in zip(edges, edges[1:], strict=False)]


def _choices(blocks: int, budget: int) -> list[tuple[int, ...]]:
    return list(combinations(range(blocks), blocks - budget))


def _key(fp: Column, parts: list[tuple[int, int]], chosen: tuple[int, ...]) -> Column:
    key = F.lit(0).cast("long")
    for i in chosen:
        shift, width = parts[i]
        key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
    return key


def _arranged(fp: np.ndarray, parts: list[tuple[int, int]], chosen: tuple[int, ...]) -> np.ndarray:
    """The bits with the chosen parts first."""
    out = np.zeros(len(fp), np.uint64)
    for i in [*chosen, *(i for i in range(len(parts)) if i not in chosen)]:
        shift, width = parts[i]
        out = (out << np.uint64(width)) | ((fp >> np.uint64(shift)) & np.uint64((1 << width) - 1))
    return out


class Forest:
    """Spanning forest over 0..n-1 of links that come in arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def trie_links(bits: np.ndarray, trie: np.ndarray, shared: int, budget: int, step: int = 4) -> np.ndarray:
    """For each of the distinct ``bits`` the least position it is linked with inside its trie.

    ``bits`` is sorted within ``trie`` (numbers of the tries, ascending); the first ``shared`` bits
    are alike within a trie.
    """
    n = len(bits)
    levels = [*range(shared, 64, step), 64]
    starts = []  # of the nodes of each level, as positions in bits
    for depth in levels:
        prefix = bits >> np.uint64(64 - depth) if depth else np.zeros(n, np.uint64)
        new = np.ones(n, bool)
        new[1:] = (trie[1:] != trie[:-1]) | (prefix[1:] != prefix[:-1])
        starts.append(np.flatnonzero(new))
    forest = Forest(n)
    roots = np.arange(len(starts[0]))
    stack = [(0, roots, roots)]
    while stack:
        level, a, b = stack.pop()
        if len(a) > FRONTIER:
            half = len(a) // 2
            stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
            continue
        if level == len(levels) - 1:
            apart = a != b
            forest.add(starts[level][a[apart]], starts[level][b[apart]])
            continue
        below = starts[level + 1]
        first = np.searchsorted(below, starts[level])
        many = np.diff(np.append(first, len(below)))
        pairs = many[a] * many[b]
        if pairs.sum() > 8 * FRONTIER and len(a) > 1:
            half = len(a) // 2
            stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
            continue
        of = np.repeat(np.arange(len(a)), pairs)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        ca = first[a[of]] + nth // many[b[of]]
        cb = first[b[of]] + nth % many[b[of]]
        differ = np.bitwise_count((bits[below[ca]] ^ bits[below[cb]]) >> np.uint64(64 - levels[level + 1]))
        keep = (differ <= budget) & (ca <= cb)
        if keep.any():
            stack.append((level + 1, ca[keep], cb[keep]))
    return forest.root


def link(nodes: DataFrame, budget: int = 4, blocks: int | None = None) -> DataFrame:
    """(u, v) links that span the groups of (node long, fp long) rows with distinct fp within ``budget`` bits."""
    if blocks is None:  # tries of some 64 fingerprints on average
        n, blocks = nodes.count(), budget + 1
        while blocks < budget + 4 and n >> sum(w for _, w in _parts(blocks)[: blocks - budget]) > 64:
            blocks += 1
    parts, choices = _parts(blocks), _choices(blocks, budget)
    keyed = nodes.select("node", "fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), _key(F.col("fp"), parts, c).alias("key")) for t, c in enumerate(choices)])).alias("k")).select("node", "fp", "k.t", "k.key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        all_ = pa.Table.from_batches(got)
        node, fp, t, key = (all_.column(c).to_numpy() for c in ("node", "fp", "t", "key"))
        for i, chosen in enumerate(choices):
            at = np.flatnonzero(t == i)
            if len(at) < 2:
                continue
            bits = _arranged(fp[at].astype(np.int64).view(np.uint64), parts, chosen)
            order = np.lexsort((bits, key[at]))
            at, bits = at[order], bits[order]
            trie = np.cumsum(np.concatenate([[0], key[at][1:] != key[at][:-1]]))
            root = trie_links(bits, trie, sum(parts[j][1] for j in chosen), budget)
            linked = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(node[at[linked]]), pa.array(node[at[root[linked]]])], ["u", "v"])
        trim()

    return keyed.repartition("t", "key").mapInArrow(run, "u long, v long")


def near_duplicates(df: DataFrame, budget: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of (doc_id, fingerprint, component_id); component_id is the least id reachable by links."""
    docs = materialise(fingerprints(df, width, id_col, text_col), "fingerprints")
    by_fp = docs.groupBy("fp").agg(F.min("doc_id").alias("node"))
    nodes = materialise(by_fp.where("node is not null"), "nodes")
    # an id given to several texts is one node: its fingerprints hang together
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("doc_id")
    same = docs.join(ids, "doc_id").select("doc_id", "fp").distinct().join(nodes, "fp").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    comp = connected_components(link(nodes, budget).unionByName(same))
    named = nodes.join(comp, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    out = docs.join(named, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, budget: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of linked texts, with all its columns: that of the least id, null last.

    Groups come from texts alone: texts that aren't linked stay, whatever ids they have. Of equal ids
    the least hash of the whole row stays, so a lost and repeated task chooses the same row.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    others = F.to_json(F.struct(F.col(text_col).isNull().alias("no"), *[F.col(f"`{c}`") for c in df.columns if c != text_col]))
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = F.xxhash64(text, others)
    rows = df.select(F.struct(F.col(id_col).isNull().alias("no"), F.col(id_col).cast("long").alias("id"), own.alias("h")).alias("key"), text.alias("text"))
    keyed = materialise(rows.mapInArrow(lambda it: _fingerprint_rows(it, width), "key struct<no: boolean, id: long, h: long>, fp long"), "keys")
    nodes = materialise(keyed.groupBy("fp").agg(F.min("key").alias("key")).select(F.col("fp").alias("node"), "fp", "key"), "nodes")
    comp = connected_components(link(nodes.select("node", "fp"), budget))
    grouped = nodes.join(comp, "node", "left").select(F.coalesce("component", "node").alias("c"), "key")
    first = materialise(grouped.groupBy("c").agg(F.min("key").alias("key")).select("key.no", "key.id", "key.h"), "first")
    release(keyed)
    out = df.select(row.alias("r"), F.col(id_col).isNull().alias("no"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), own.alias("h"))
    first = first.select("no", F.coalesce("id", F.lit(0)).alias("id"), "h")
    # rows alike in every column have one key: one of them stays
    return out.join(first, ["no", "id", "h"], "left_semi").groupBy("no", "id", "h").agg(F.first("r").alias("r")).select("r.*")
