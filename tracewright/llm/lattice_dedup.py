"""Embedding near-duplicates by lattice hashing.

Each of ``tables`` projects unit vectors onto random orthonormal directions, eight to a block, and
decodes each block to the nearest point of the E8 lattice; the points of ``blocks`` blocks name a
cell. A vector is stored in its own cell of each table and probes every cell whose points lie within
``radius`` of its projection, so neighbouring cells are searched too.

Vectors don't travel with their probes. First only ids and 64 signs of orthogonal projections meet in
the cells; a pair whose signs differ in more than ``SIGNS`` places is no candidate. Then the vectors
that have a candidate in a cell are sent to it, once each, and pairs are verified by cosine in double
precision. Projections are rounded to a fixed grid, so lattice distances are exact, and whether two
vectors meet in a table can be told from their projections alone: a pair that meets several times is
counted only in its first table (there, from the lower side if both probe). Tasks count links and
keep a spanning forest, and no pair is ever written. Equal vectors are one node with a count. Cells
with more than ``TASK_VECTORS`` stored vectors are dealt out over several tasks, to each of which the
probes of the cell go; a task holds one cell's stored vectors and streams the probes.

Defined cases: null, empty and zero vectors and those with null or non-finite components link with
nothing and keep their own id as component; vectors of different lengths don't link; ids may repeat
(each row counts) or be null (no part in components' ids); an empty table gives an empty table;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import connected_components, materialise, release
from .simhash import Forest

GRID = 1 << 10
TASK_VECTORS = 4096
#: Signs of 64 that a candidate pair may differ in; pairs at cosine 0.95 differ in six or seven.
SIGNS = 17
#: Pairs compared by their signs at once; pairs of a cell from which on it is one product.
CHUNK, MATRIX = 1 << 21, 1 << 14
#: More blocks make more cells, which large tables need; DEFAULT is taken at every size. Tests measure the recall of each.
SHAPES = {"small": {"tables": 4, "blocks": 1, "width": 0.6, "radius": 1.0}, "large": {"tables": 6, "blocks": 2, "width": 0.7, "radius": 1.0}}
DEFAULT = "large"


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """Twice the nearest E8 point of each row: the better of D8 and D8 shifted by a half."""

    def d8(z: np.ndarray) -> np.ndarray:
        r = np.rint(z)
        odd = r.sum(axis=1) % 2 != 0
        worst = np.abs(z - r).argmax(axis=1)
        row = np.flatnonzero(odd)
        col = worst[row]
        r[row, col] += np.where(z[row, col] >= r[row, col], 1, -1)
        return r

    a, b = d8(y), d8(y - 0.5) + 0.5
    far = ((y - b) ** 2).sum(axis=1) < ((y - a) ** 2).sum(axis=1)
    return np.where(far[:, None], 2 * b, 2 * a).astype(np.int64)


def short_points() -> np.ndarray:
    """Twice the E8 points of squared norm 0, 2 and 4."""
    found = {(0,) * 8}
    for n, sizes in ((2, (2,)), (4, (2,)), (1, (4,))):  # +-1 twice, +-1 four times, +-2 once
        for at in combinations(range(8), n):
            for signs in product(*[[s * v for v in sizes for s in (1, -1)]] * n):
                p = [0] * 8
                for i, s in zip(at, signs, strict=True):
                    p[i] = s
                found.add(tuple(p))
    for signs in product((1, -1), repeat=8):
        if sum(signs) % 4 == 0:
            found.add(signs)
        for i in range(8):
            p = list(signs)
            p[i] *= 3
            if sum(p) % 4 == 0:
                found.add(tuple(p))
    return np.array(sorted(found), np.int64)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of 64 signs differ."""
    return np.bitwise_count((a ^ b).view(np.uint64))  # of a negative number the count would be its absolute's


class Lattice:
    """Projections, cells and probes of vectors of one length."""

    def __init__(self, dim: int, tables: int, blocks: int, width: float, radius: float, seed: int = 17):
        rng = np.random.default_rng([seed, dim])
        self.tables, self.blocks, self.radius = tables, blocks, radius
        many = tables * blocks * 8
        self.directions = np.zeros((dim, many))
        for t in range(0, many, 8):
            q, r = np.linalg.qr(rng.standard_normal((max(dim, 8), 8)))
            self.directions[:, t : t + 8] = (q * np.sign(np.diag(r)))[:dim]
        self.scale = width * np.sqrt(8 / max(dim, 8))
        self.near = short_points()
        made: list[np.ndarray] = []
        while sum(m.shape[1] for m in made) < 64:
            made.append(np.linalg.qr(rng.standard_normal((dim, dim)))[0] if dim > 1 else np.ones((1, 1)))
        self.planes = np.hstack(made)[:, :64]
        self.salt = rng.integers(1, 1 << 62, size=(tables, 8 * blocks + 1), dtype=np.int64) | 1

    def project(self, unit: np.ndarray) -> np.ndarray:
        """(n, tables, blocks, 8) projections on the grid, as whole numbers."""
        y = np.rint(unit @ self.directions / self.scale * GRID)
        return np.clip(y, -32000, 32000).astype(np.int16).reshape(len(unit), self.tables, self.blocks, 8)

    def signs(self, unit: np.ndarray) -> np.ndarray:
        """64 signs of each row as one number."""
        return np.packbits(unit @ self.planes > 0, axis=1).view(np.int64).ravel()

    def homes(self, y: np.ndarray) -> np.ndarray:
        """Twice the lattice points of the own cells, shaped like y."""
        return nearest_e8(y.reshape(-1, 8) / GRID).reshape(y.shape)

    def key(self, points: np.ndarray, table: int, dim: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (points.reshape(len(points), -1) * self.salt[table, :-1]).sum(axis=1) + self.salt[table, -1] * (table + 1) * (dim + 3)
            h ^= h >> 29
            h *= np.int64(0x1B873593CC9E2D51)
            return h ^ (h >> 32)

    def probes(self, y: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, twice the points of a cell) for every cell within the radius of a row in every block."""
        row, cell = np.arange(len(y)), np.zeros((len(y), 0), np.int64)
        for b in range(self.blocks):
            z = y[:, table, b].astype(np.int64) * 2  # all in units of half the grid
            home = nearest_e8(y[:, table, b] / GRID)
            rest = z - home * GRID
            # whole numbers far below 2^53, so floats are exact
            off = (rest**2).sum(axis=1)[:, None] - 2 * rest.astype(float) @ (self.near * float(GRID)).T + (self.near**2).sum(axis=1) * GRID**2
            r, p = np.nonzero(off <= (2 * GRID * self.radius) ** 2)
            n = np.bincount(r, minlength=len(y))
            begin = np.cumsum(n) - n
            take = np.repeat(np.arange(len(row)), n[row])
            nth = np.arange(len(take)) - np.repeat(np.cumsum(n[row]) - n[row], n[row])
            at = begin[row[take]] + nth
            cell = np.hstack([cell[take], home[row[take]] + self.near[p[at]]])
            row = row[take]
        return row, cell

    def meets(self, home: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether y's vectors probe the cells of home, row by row: (n, tables)."""
        gap = ((2 * y.astype(np.int64) - home * GRID) ** 2).sum(axis=-1)
        return (gap <= (2 * GRID * self.radius) ** 2).all(axis=-1)


def _units(rows: pa.Array, dim: int, kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(rows.to_pylist()), kind).reshape(-1, dim).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_size(rows: pa.Array) -> dict[int, np.ndarray]:
    """Positions of the rows of each number of bytes."""
    size = np.array([len(x) for x in rows.to_pylist()], np.int64)
    return {int(n): np.flatnonzero(size == n) for n in np.unique(size)}


def _vectors(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Each embedding as bytes, null if it can't link; doubles are scaled by their largest component."""
    for b in batches:
        out = []
        lists = b.column("embedding")
        at = lists.offsets.to_numpy()
        values = lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
        valid = lists.is_valid().to_numpy(zero_copy_only=False)
        for i in range(len(lists)):
            v = values[at[i] : at[i + 1]] if valid[i] else values[:0]
            top = np.abs(v).max() if len(v) else 0.0
            if np.isfinite(top) and top > 0:
                out.append(((v if kind == "<f4" else v / top) + 0.0).astype(kind).tobytes())
            else:
                out.append(None)
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "x"])


CELLS = "key long, t int, role int, node long, signs long"


def _cell_rows(batches: Iterator[pa.RecordBatch], shape: tuple, kind: str, homes_only: bool) -> Iterator[pa.RecordBatch]:
    """A row for each node's own cell and, unless only those are asked for, each probed cell."""
    lattices: dict[int, Lattice] = {}
    for b in batches:
        node = b.column("node").to_numpy()
        for size, at in _by_size(b.column("x")).items():
            dim = size // int(kind[2])
            lattice = lattices.setdefault(dim, Lattice(dim, *shape))
            for lo in range(0, len(at), 512):
                some = at[lo : lo + 512]
                unit = _units(b.column("x").take(pa.array(some)), dim, kind)
                y, signs, own = lattice.project(unit), lattice.signs(unit), node[some]
                home = lattice.homes(y)
                for t in range(lattice.tables):
                    sets = [(0, np.arange(len(some)), home[:, t].reshape(len(some), -1))]
                    if not homes_only:
                        sets.append((1, *lattice.probes(y, t)))
                    for role, row, cell in sets:
                        cols = [lattice.key(cell, t, dim), np.full(len(row), t, np.int32), np.full(len(row), role, np.int32), own[row], signs[row]]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "t", "role", "node", "signs"])


def _candidates(key: np.ndarray, salt: np.ndarray, role: np.ndarray, node: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Which rows have a candidate in their cell; rows come by cell, stored ones first."""
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])
    begin = np.flatnonzero(new)
    cell = np.cumsum(new) - 1
    stored = np.add.reduceat((role == 0).astype(np.int64), begin)
    found = np.zeros(len(key), bool)
    probes = np.flatnonzero(role == 1)
    many = stored[cell[probes]]
    upto = np.cumsum(many)
    lo = 0
    while lo < len(probes):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + CHUNK, side="right")))
        some, n = probes[lo:hi], many[lo:hi]
        of = np.repeat(some, n)
        with_ = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[cell[some]], n)
        near = np.flatnonzero((differing(signs[of], signs[with_]) <= SIGNS) & (node[of] != node[with_]))
        found[of[near]] = True
        found[with_[near]] = True
        lo = hi
    return found


def _seat_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, salt, t, role, node, signs) rows by cell, stored ones first, those that have a candidate there."""
    names = ["key", "salt", "t", "role", "node", "signs"]
    held = [np.zeros(0, np.int64)] * 6  # the stored rows of the last cell, whose probes may go on
    given = np.zeros(0, bool)  # those given out already
    for b in batches:
        if not b.num_rows:
            continue
        cols = [np.concatenate([h, b.column(c).to_numpy().astype(np.int64)]) for h, c in zip(held, names, strict=True)]
        key, salt, _, role, node, signs = cols
        found = _candidates(key, salt, role, node, signs)
        fresh = found.copy()
        fresh[: len(given)] &= ~given
        given = np.concatenate([given, np.zeros(b.num_rows, bool)]) | found
        some = np.flatnonzero(fresh)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(cols[i][some]) for i in (0, 1, 2, 3, 4)], ["key", "salt", "t", "role", "node"])
        last = (key == key[-1]) & (salt == salt[-1]) & (role == 0)
        held, given = [c[last] for c in cols], given[last]


class _Seats:
    """Vectors that sit in cells, row by row, with their projections."""

    def __init__(self, lattice: Lattice, place: np.ndarray, node: np.ndarray, n: np.ndarray, unit: np.ndarray):
        self.lattice, self.place, self.node, self.n, self.unit = lattice, place, node, n, unit
        self.y = lattice.project(unit)
        self.home = lattice.homes(self.y)

    @staticmethod
    def joined(a: _Seats | None, b: _Seats) -> _Seats:
        if a is None:
            return b
        out = object.__new__(_Seats)
        out.lattice = b.lattice
        for name in ("place", "node", "n", "unit", "y", "home"):
            setattr(out, name, np.concatenate([getattr(a, name), getattr(b, name)]))
        return out

    def part(self, at: np.ndarray) -> _Seats:
        out = object.__new__(_Seats)
        out.lattice = self.lattice
        for name in ("place", "node", "n", "unit", "y", "home"):
            setattr(out, name, getattr(self, name)[at])
        return out

    def near(self, probes: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(stored, probe) rows of one cell whose vectors are near, for the given probes; rows come by cell, stored ones first."""
        key, salt, role = self.place[:, 0], self.place[:, 1], self.place[:, 3]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])
        begin, cell = np.flatnonzero(new), np.cumsum(new) - 1
        stored = np.add.reduceat((role == 0).astype(np.int64), begin)
        many = stored[cell[probes]]
        # cells with many pairs one by one, as products; all others together, pair by pair
        pairs = np.bincount(cell[probes], weights=many, minlength=len(begin))
        for c in np.flatnonzero(pairs >= MATRIX):
            own = probes[cell[probes] == c]
            ours = np.arange(begin[c], begin[c] + stored[c])
            for lo in range(0, len(own), 2048):
                i, j = np.nonzero(self.unit[ours] @ self.unit[own[lo : lo + 2048]].T >= least)
                yield ours[i], own[lo + j]
        few = np.flatnonzero(pairs[cell[probes]] < MATRIX)
        probes, many = probes[few], many[few]
        upto = np.cumsum(many)
        lo = 0
        while lo < len(probes):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + 40_000, side="right")))
            n = many[lo:hi]
            j = np.repeat(probes[lo:hi], n)
            i = np.arange(len(j)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[cell[probes[lo:hi]]], n)
            hit = np.einsum("ij,ij->i", self.unit[i], self.unit[j]) >= least
            yield i[hit], j[hit]
            lo = hi

    def links(self, probes: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
        """(node, links, other): partial link counts and forest edges of the pairs that count in their cell's table."""
        for i, j in self.near(probes, least):
            apart = self.node[i] != self.node[j]
            i, j = i[apart], j[apart]
            keep = np.zeros(len(i), bool)
            for lo in range(0, len(i), 100_000):
                a, b = i[lo : lo + 100_000], j[lo : lo + 100_000]
                t = self.place[b, 2]
                there = self.lattice.meets(self.home[a], self.y[b])
                back = self.lattice.meets(self.home[b], self.y[a])
                row = np.arange(len(a))
                first = (there | back).argmax(axis=1) == t
                keep[lo : lo + 100_000] = first & there[row, t] & (~back[row, t] | (self.node[a] < self.node[b]))
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            node, at = np.unique(np.concatenate([self.node[i], self.node[j]]), return_inverse=True)
            links = np.bincount(at, weights=np.concatenate([self.n[j], self.n[i]])).astype(np.int64)
            forest = Forest(len(node))
            forest.add(at[: len(i)], at[len(i) :])
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(node[forest.root])], ["node", "links", "other"])


def _pair_rows(batches: Iterator[pa.RecordBatch], shape: tuple, kind: str, least: float) -> Iterator[pa.RecordBatch]:
    """Seats with their vectors, by cell, stored ones first -> (node, links, other)."""
    lattices: dict[int, Lattice] = {}
    held: dict[int, _Seats] = {}  # of each length, the stored seats of the last cell, whose probes may go on
    for b in (b.slice(at, 4096) for b in batches for at in range(0, b.num_rows, 4096)):
        place = np.stack([b.column(c).to_numpy() for c in ("key", "salt", "t", "role")], axis=1)
        node, n = b.column("node").to_numpy(), b.column("n").to_numpy()
        for size, at in _by_size(b.column("x")).items():
            dim = size // int(kind[2])
            lattice = lattices.setdefault(dim, Lattice(dim, *shape))
            fresh = _Seats(lattice, place[at], node[at], n[at], _units(b.column("x").take(pa.array(at)), dim, kind))
            seats = _Seats.joined(held.get(dim), fresh)
            old = len(seats.node) - len(fresh.node)
            yield from seats.links(old + np.flatnonzero(fresh.place[:, 3] == 1), least)
            last = (seats.place[:, :2] == seats.place[-1, :2]).all(axis=1) & (seats.place[:, 3] == 0)
            held[dim] = seats.part(last)


def near_duplicates(df: DataFrame, cosine: float = 0.95, shape: dict | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows of (vec_id, n_links, component_id, kept) for every row of ``df``.

    ``shape`` is SHAPES[DEFAULT] unless given, whatever the number of vectors.
    """
    kind = "<f4" if dict(df.dtypes)[vector_col] == "array<float>" else "<f8"
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).mapInArrow(lambda it: _vectors(it, kind), "vec_id long, x binary")
    # 128 bits of hash tell vectors apart
    rows = materialise(rows.select("*", F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(7), "x").alias("h2")), "vectors")
    nodes = rows.where("x is not null").groupBy("h1", "h2").agg(F.first("x").alias("x"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    shape = shape or SHAPES[DEFAULT]
    form = (shape["tables"], shape["blocks"], shape["width"], shape["radius"])
    given = nodes.select("node", "x")
    cells = given.mapInArrow(lambda it: _cell_rows(it, form, kind, False), CELLS)
    hot = given.mapInArrow(lambda it: _cell_rows(it, form, kind, True), CELLS).groupBy("key").agg(F.count("*").alias("stored")).where(F.col("stored") > TASK_VECTORS)
    hot = materialise(hot.select("key", F.ceil(F.col("stored") / TASK_VECTORS).cast("int").alias("parts")), "hot_cells")
    if hot.limit(1).count():
        parts = F.coalesce("parts", F.lit(1))
        salts = F.when(F.col("role") == 0, F.array(F.pmod("node", parts).cast("int"))).otherwise(F.sequence(F.lit(0), parts - 1))
        cells = cells.join(hot, "key", "left").withColumn("salt", F.explode(salts)).drop("parts")
    else:
        cells = cells.withColumn("salt", F.lit(0))
    cells = cells.select("key", "salt", "t", "role", "node", "signs").repartition("key", "salt").sortWithinPartitions("key", "salt", "role")
    seats = cells.mapInArrow(_seat_rows, "key long, salt long, t long, role long, node long").join(nodes.select("node", "n", "x"), "node")
    seats = seats.repartition("key", "salt").sortWithinPartitions("key", "salt", "role")
    found = materialise(seats.mapInArrow(lambda it: _pair_rows(it, form, kind, cosine), "node long, links long, other long"), "links")
    release(hot)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = connected_components(found.select(F.col("node").alias("u"), F.col("other").alias("v")))
    named = nodes.select("h1", "h2", "n", "least", "node").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    info = named.join(least, "component").join(counts, "node", "left").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    usable = rows.where("x is not null").select("vec_id", "h1", "h2").join(info, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("x is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return usable.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
