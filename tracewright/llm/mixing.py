"""Mixing sources to target weights by hierarchical budgeting.

Documents hang in a tree of domain, language and source. A token budget at the root goes down by the
weights of the children; a child can take at most its tokens times ``epochs``. What a child can't
take goes to its siblings by their weights, and only what no sibling can take is a shortage of the
parent, shared out among the parent's own siblings. Each leaf then takes whole epochs of its
documents and, of one more, the prefix in a seeded order whose tokens fit.

A tree of at most ``MAX_LEAVES`` leaves is solved on the driver; a larger one by joins and grouped sums,
a level at a time, with the same result. Sums over ranges of the seeded hash tell in which range a
leaf's budget ends; ranges are divided until few rows are left, and only those are summed one by one,
without their texts. Documents then meet their leaf's cut in a join, a broadcast one while there are at
most ``MAX_LEAVES`` leaves; then they are never shuffled.

Defined cases: null and empty texts have no tokens and stay with their leaf's full epochs, or where the order puts them
before the cut; null domains, languages and sources are leaves of their own; weights default to 1; a
child of weight 0 takes nothing; ids may be null or repeat (ties go by text); an empty table gives
an empty table; other columns are kept by ``mix`` and ignored by ``plan_mix``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialise, release

LEVELS = ("domain", "lang", "source")
MAX_LEAVES = 200_000
#: Rows of a leaf that are summed one by one.
SMALL = 50_000


def default_domain() -> Column:
    """Sources fall into four domains by a checksum of their names."""
    return F.concat(F.lit("domain"), F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")), F.lit(4)).cast("string"))


def word_tokens(text: Column) -> Column:
    """Tokens as words between white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")


def share_out(budget: float, children: list[tuple[float, float]]) -> list[float]:
    """Split a budget among (weight, capacity) children; what one can't take goes to the others by weight."""
    given = [0.0] * len(children)
    open_ = [i for i, (w, c) in enumerate(children) if w > 0 and c > 0]
    left = budget
    while open_ and left > 1e-9:
        total = sum(children[i][0] for i in open_)
        full = [i for i in open_ if children[i][1] - given[i] <= left * children[i][0] / total]
        if not full:
            for i in open_:
                given[i] += left * children[i][0] / total
            break
        for i in full:
            left -= children[i][1] - given[i]
            given[i] = children[i][1]
        open_ = [i for i in open_ if i not in set(full)]
    return given


def solve(leaves: dict[tuple, int], budget: float, weights: Mapping[tuple, float], epochs: int) -> dict[tuple, float]:
    """Tokens of each leaf; ``weights`` maps path prefixes, (domain,), (domain, lang) ..., to weights."""

    def capacity(path: tuple) -> float:
        """What a node can take: children of weight 0 take nothing."""
        if path in leaves:
            return float(leaves[path] * epochs)
        return sum(capacity(c) for c in kids[path] if weights.get(c, 1.0) > 0)

    kids: dict[tuple, list[tuple]] = {}
    for leaf in sorted(leaves, key=lambda p: tuple((x is not None, x or "") for x in p)):
        for n in range(len(leaf)):
            below = kids.setdefault(leaf[:n], [])
            if leaf[: n + 1] not in below[-1:]:
                below.append(leaf[: n + 1])
    out: dict[tuple, float] = {}

    def down(path: tuple, tokens: float) -> None:
        if path in leaves:
            out[path] = tokens
            return
        parts = share_out(tokens, [(weights.get(c, 1.0), capacity(c)) for c in kids[path]])
        for c, t in zip(kids[path], parts, strict=True):
            down(c, t)

    if leaves:
        down((), min(budget, capacity(())))
    return out


LEAF = ["d", "l", "s"]


def _shared(children: DataFrame, above: DataFrame, by: list[str]) -> DataFrame:
    """``share_out`` for all parents at once: children (by, name columns, w, cap) with ``tokens``.

    Children that can't take their share are filled and leave, a grouped sum a round; rounds end when
    no parent has one.
    """
    rows = materialise(children.where("w > 0 and cap > 0").withColumn("full", F.lit(False)), "children")
    while True:
        taken = rows.groupBy(*by).agg(F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).alias("used"), F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).alias("open"))
        level = above.join(taken, _equal(above, taken, by)).select(*[above[c] for c in by], (above["budget"] - taken["used"]).alias("left"), taken["open"])
        share = F.when(F.col("open") > 0, F.col("left") * F.col("w") / F.col("open")).otherwise(0.0)
        now = rows.join(level, _equal(rows, level, by)).select(*[rows[c] for c in rows.columns], share.alias("share"))
        now = materialise(now.select(*[c for c in rows.columns if c != "full"], (F.col("full") | (F.col("cap") <= F.col("share"))).alias("full"), F.col("full").alias("was"), "share"), "children")
        release(rows)
        rows = now.select(*[c for c in now.columns if c not in ("was", "share")])
        if not now.where("full and not was").limit(1).count():
            return now.select("*", F.when(F.col("full"), F.col("cap")).otherwise(F.greatest("share", F.lit(0.0))).alias("tokens")).drop("full", "was", "share")


def _equal(a: DataFrame, b: DataFrame, by: list[str]) -> Column:
    on = F.lit(True)
    for c in by:
        on = on & a[c].eqNullSafe(b[c])
    return on


def solve_table(leaves: DataFrame, budget_share: float, weights: Mapping[tuple, float], epochs: int) -> DataFrame:
    """``solve`` for any number of leaves (d, l, s, n): adds ``tokens``, 0 for leaves that take nothing."""
    spark = leaves.sparkSession

    def weighted(rows: DataFrame, depth: int) -> DataFrame:
        own = [(*k, float(v)) for k, v in weights.items() if len(k) == depth]
        if not own:
            return rows.withColumn("w", F.lit(1.0))
        table = spark.createDataFrame(own, ", ".join(f"{c} string" for c in LEAF[:depth]) + ", given double")
        return rows.join(F.broadcast(table), _equal(rows, table, LEAF[:depth]), "left").select(*[rows[c] for c in rows.columns], F.coalesce("given", F.lit(1.0)).alias("w"))

    def summed(rows: DataFrame, depth: int) -> DataFrame:
        return weighted(rows.where("w > 0").groupBy(*LEAF[:depth]).agg(F.sum("cap").alias("cap")), depth)

    sources = materialise(weighted(leaves.select(*LEAF, (F.col("n") * epochs).cast("double").alias("cap")), 3), "sources")
    langs = materialise(summed(sources, 2), "langs")
    domains = materialise(summed(langs, 1), "domains")
    room = domains.where("w > 0").agg(F.sum("cap").alias("cap"))
    root = leaves.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).join(room).select(F.least(F.col("n") * budget_share, F.coalesce("cap", F.lit(0.0))).alias("budget"))
    top = _shared(domains, root, []).select("d", F.col("tokens").alias("budget"))
    middle = _shared(langs, top, ["d"]).select("d", "l", F.col("tokens").alias("budget"))
    given = _shared(sources, middle, ["d", "l"])
    return leaves.join(given, _same(leaves, given), "left").select(*[leaves[c] for c in LEAF], leaves["n"], F.coalesce("tokens", F.lit(0.0)).alias("tokens"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    """Rows of one leaf, whose names may be null."""
    return a["d"].eqNullSafe(b["d"]) & a["l"].eqNullSafe(b["l"]) & a["s"].eqNullSafe(b["s"])


def _last_inside(keys: DataFrame, quota: DataFrame, bits: int, small: bool = True) -> DataFrame:
    """(leaf, cut): the greatest order of each leaf up to which its documents' tokens fit into ``rest``.

    Sums over ranges of the order tell in which range a leaf's budget ends; that range is divided
    again, until it holds at most SMALL rows, and those are summed one by one. Leaves whose documents
    all fit are given no cut.
    """
    shift = 63
    ranges = quota.where("rest >= 0").select(*LEAF, "rest", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("before"))
    while True:
        hi = F.lit((1 << shift) - 1)
        own = ranges.withColumnsRenamed({c: f"q{c}" for c in LEAF})
        inside = keys.join(F.broadcast(own) if small else own, F.col("d").eqNullSafe(F.col("qd")) & F.col("l").eqNullSafe(F.col("ql")) & F.col("s").eqNullSafe(F.col("qs")) & (F.col("o") >= F.col("lo")) & (F.col("o") - F.col("lo") <= hi))
        most = inside.groupBy(*LEAF).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= SMALL or shift == 0:
            break
        shift = max(0, shift - bits)
        part = inside.groupBy(*LEAF, "rest", "before", F.shiftright("o", shift).alias("k")).agg(F.sum("n").alias("n"))
        upto = Window.partitionBy(*LEAF).orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        running = part.withColumn("upto", F.col("before") + F.sum("n").over(upto)).where(F.col("upto") > F.col("rest") + 1e-6)
        ends = running.groupBy(*LEAF).agg(F.min_by(F.struct("rest", "k", "upto", "n"), "k").alias("e"))
        done = ranges
        ranges = materialise(ends.select(*LEAF, "e.rest", F.shiftleft("e.k", shift).alias("lo"), (F.col("e.upto") - F.col("e.n")).alias("before")), "ranges")
        release(done)
    peers = Window.partitionBy(*LEAF).orderBy("o").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    fits = inside.withColumn("sum", F.col("before") + F.sum("n").over(peers)).groupBy(*LEAF).agg(F.max(F.when(F.col("sum") <= F.col("rest") + 1e-6, F.col("o"))).alias("last"), F.max_by("sum", "o").alias("all"), F.first("rest").alias("rest"), F.first("lo").alias("lo"))
    whole = F.lit((1 << 63) - 1)
    return fits.select(*LEAF, F.when(F.col("all") <= F.col("rest") + 1e-6, whole).otherwise(F.coalesce("last", F.col("lo") - 1)).alias("cut"))


def _planned(docs: DataFrame, budget_share: float, weights: Mapping[tuple, float] | None, epochs: int, seed: int, buckets_log2: int, domain: Column | None, tokens: Column | None) -> DataFrame:
    """(row, d, copies): every document as a struct, its domain and how often it is taken."""
    weights = weights or {}
    tokens = word_tokens(F.col("text")) if tokens is None else tokens
    order = F.xxhash64(F.lit(seed), "doc_id", "text").bitwiseAND(F.lit((1 << 63) - 1))
    leaf = [(default_domain() if domain is None else domain).alias("d"), F.col("lang").alias("l"), F.col("source").alias("s")]
    keys = materialise(docs.select(*leaf, order.alias("o"), F.coalesce(tokens, F.lit(0)).cast("long").alias("n")), "keys")
    totals = materialise(keys.groupBy(*LEAF).agg(F.sum("n").alias("n")), "leaves")
    small = totals.count() <= MAX_LEAVES
    if small:
        leaves = {(r["d"], r["l"], r["s"]): r["n"] for r in totals.collect()}
        solved = solve(leaves, budget_share * sum(leaves.values()), weights, epochs)
        tokens_of = docs.sparkSession.createDataFrame([(*path, leaves[path], float(t)) for path, t in solved.items()], "d string, l string, s string, n long, tokens double")
    else:
        tokens_of = solve_table(totals, budget_share, weights, epochs)
    never = [k for k, v in weights.items() if v <= 0]
    path = [F.col(c) for c in LEAF]
    barred = F.lit(False)
    for k in never:
        same = F.lit(True)
        for c, v in zip(path, k, strict=False):
            same = same & c.eqNullSafe(F.lit(v))
        barred = barred | same
    # a leaf without tokens takes all of its documents once, unless its weight is 0
    full = F.when(F.col("n") > 0, F.floor((F.col("tokens") + 1e-6) / F.col("n"))).otherwise(F.when(barred, 0).otherwise(1)).cast("int")
    quota = tokens_of.withColumn("full", full).withColumn("rest", F.when((F.col("n") > 0) & ~barred & (F.col("full") < epochs), F.greatest(F.col("tokens") - F.col("full") * F.col("n"), F.lit(0.0))).otherwise(-1.0))
    quota = materialise(quota.select(*LEAF, "full", "rest"), "quota")
    cuts = _last_inside(keys, quota, buckets_log2, small)
    plan = quota.join(cuts, _same(quota, cuts), "left").select(*[quota[c] for c in LEAF], "full", F.coalesce("cut", F.when(F.col("rest") >= 0, (1 << 63) - 1).otherwise(-1)).alias("cut"))
    plan = materialise(plan, "leaf_plan")
    for table in (keys, quota, totals):
        release(table)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *leaf, order.alias("o"))
    # a plan of at most MAX_LEAVES rows is broadcast
    out = rows.join(F.broadcast(plan) if small else plan, _same(rows, plan), "left")
    copies = F.coalesce("full", F.lit(0)) + F.when(F.col("o") <= F.col("cut"), 1).otherwise(0)
    return out.select("row", rows["d"].alias("d"), copies.cast("int").alias("copies"))


def plan_mix(docs: DataFrame, budget_share: float = 0.5, weights: Mapping[tuple, float] | None = None, epochs: int = 2, seed: int = 5, buckets_log2: int = 8, domain: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """All documents with their columns and ``_domain`` and ``_copies``, how often each is taken.

    The budget is ``budget_share`` of all tokens. Columns of those two names are replaced.
    """
    out = _planned(docs, budget_share, weights, epochs, seed, buckets_log2, domain, tokens)
    keep = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("_domain", "_copies")]
    return out.select(*keep, F.col("d").alias("_domain"), F.col("copies").alias("_copies"))


def mix(docs: DataFrame, budget_share: float = 0.8, weights: Mapping[tuple, float] | None = None, seed: int = 5) -> DataFrame:
    """The documents taken, each at most once, with the columns of ``docs``."""
    out = _planned(docs, budget_share, weights, 1, seed, 8, None, None).where("copies > 0")
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
