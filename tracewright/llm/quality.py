"""Quality by a sparse ensemble of rules over text statistics.

Statistics of a whole text (lengths, repetition, symbols, case, table bars, lines ...) are computed
once a document. Training takes a bounded sample of labelled documents (``max_docs``, by hash),
grows shallow trees on random halves and statistics, takes every path from a root as a conjunctive
rule, fits logistic weights with a lasso penalty (accelerated proximal gradient), and compiles the
rules that are left into one Spark column expression over the statistics.

Defined cases: null and empty texts have statistics 0 and a score like any other; without labels the
score is 0.5, with labels of one kind near that kind's; ids may be null or repeat; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

STATS = ["chars", "words", "word_len", "repeat", "distinct", "top_word", "upper", "shout", "symbol_end", "bars", "digits", "marks", "wide", "lines", "line_repeat", "line_len", "long_words", "run"]
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LETTER[128:] = True


def statistics(text: str) -> list[float]:
    if not text:
        return [0.0] * len(STATS)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    share = np.bincount(raw, minlength=256) / len(raw)
    words = text.split()
    n = max(1, len(words))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = text.split("\n")
    same = [a == b for a, b in zip(words, words[1:], strict=False)]
    run = best = 0
    for s in same if any(same) else ():
        run = run + 1 if s else 0
        best = max(best, run)
    ends = sum(v for w, v in counts.items() if w[-1] in "%*&$#@^~+=<>")
    return [
        float(np.log1p(len(text))),
        float(np.log1p(len(words))),
        sum(map(len, words)) / n,
        sum(same) / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        float(share[65:91].sum()),
        sum(v for w, v in counts.items() if len(w) > 1 and w.isupper()) / n,
        ends / n,
        counts.get("|", 0) / n,
        float(share[48:58].sum()),
        float(share[33:48].sum() + share[58:65].sum() + share[91:97].sum() + share[123:127].sum()),
        float(share[128:].sum()),
        float(np.log1p(len(lines))),
        1 - len(set(lines)) / len(lines),
        float(np.log1p(len(text) / len(lines))),
        sum(v for w, v in counts.items() if len(w) > 12) / n,
        float(np.log1p(best)),
    ]


def with_statistics(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns and the statistics of ``text``."""
    rows = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in b.column("_text").to_pylist()]).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(x[:, i]) for i in range(len(STATS)))], [*keep, *STATS])

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{s} double" for s in STATS)])
    return rows.mapInArrow(run, schema)


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above?, threshold) and ...


@dataclass
class Ensemble:
    base: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def column(self) -> Column:
        """The probability as an expression over the statistics' columns."""
        z = F.lit(self.base)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for i, above, t in rule:
                holds = holds & (F.col(STATS[i]) > t if above else F.col(STATS[i]) <= t)
            z = z + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def grow(bins: np.ndarray, cuts: list[np.ndarray], y: np.ndarray, depth: int, rng: np.random.Generator) -> list[Rule]:
    """Paths of a tree by Gini gain on binned statistics."""
    rules: list[Rule] = []
    fewest, leaf = max(4, min(40, len(y) // 20)), max(2, min(10, len(y) // 100))

    def node(at: np.ndarray, path: Rule) -> None:
        if path:
            rules.append(path)
        if len(path) == depth or len(at) < fewest or y[at].min() == y[at].max():
            return
        best = (1e-9, None)
        for i in rng.choice(bins.shape[1], size=max(4, bins.shape[1] // 2), replace=False):
            k = len(cuts[i])
            if not k:
                continue
            n = np.cumsum(np.bincount(bins[at, i], minlength=k + 1))
            p = np.cumsum(np.bincount(bins[at, i], weights=y[at], minlength=k + 1))
            left, right = n[:-1], n[-1] - n[:-1]
            ok = (left >= leaf) & (right >= leaf)
            gain = p[:-1] ** 2 / np.maximum(left, 1) + (p[-1] - p[:-1]) ** 2 / np.maximum(right, 1) - p[-1] ** 2 / n[-1]
            gain = np.where(ok, gain, 0)
            j = int(gain.argmax())
            if gain[j] > best[0]:
                best = (gain[j], (int(i), j))
        if best[1] is None:
            return
        i, j = best[1]
        below = bins[at, i] <= j
        node(at[below], (*path, (i, False, float(cuts[i][j]))))
        node(at[~below], (*path, (i, True, float(cuts[i][j]))))

    node(rng.choice(len(y), size=max(1, len(y) // 2), replace=False), ())
    return rules


def _holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for i, above, t in rule:
        out &= (x[:, i] > t) == above
    return out


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, penalty: float = 1e-3, most: int = 300, seed: int = 7) -> Ensemble:
    if not len(y):
        return Ensemble(0.0)
    mean = (y.sum() + 0.5) / (len(y) + 1)
    if y.min() == y.max():
        return Ensemble(float(np.log(mean / (1 - mean))))
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, 42)[1:-1])) for i in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], axis=1)
    found: dict[bytes, Rule] = {}
    for _ in range(trees):
        for rule in grow(bins, cuts, y, depth, rng):
            hold = _holds(x, rule)
            if 0 < hold.sum() < len(y):
                key = np.packbits(hold).tobytes()
                if key not in found or len(rule) < len(found[key]):
                    found[key] = rule
    rules = list(found.values())
    if not rules:
        return Ensemble(float(np.log(mean / (1 - mean))))
    columns = np.stack([_holds(x, r) for r in rules], axis=1).astype(np.float32)
    apart = np.abs(columns.T @ (y - y.mean()).astype(np.float32)) / np.sqrt(columns.sum(axis=0))
    best = np.argsort(-apart, kind="stable")[:most]
    rules, columns = [rules[i] for i in best], columns[:, best]
    scale = columns.std(axis=0) + 1e-6
    z = (columns - columns.mean(axis=0)) / scale
    # accelerated proximal gradient; the step comes from the largest eigenvalue of the Gram matrix
    step = 4.0 / float(np.linalg.eigvalsh((z.T @ z / len(y)).astype(np.float64))[-1])
    w = v = np.zeros(z.shape[1], np.float32)
    b = vb = float(np.log(mean / (1 - mean)))
    t = 1.0
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(z @ v + vb, -30, 30)))
        g = z.T @ (p - y).astype(np.float32) / len(y)
        moved = v - step * g
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        nb = vb - min(step, 4.0) * float((p - y).mean())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        done = np.abs(new - w).max() < 1e-6
        w, b, t = new, nb, t2
        if done:
            break
    weight = w / scale
    base = b - float((weight * columns.mean(axis=0)).sum())
    return Ensemble(float(base), [(r, float(x)) for r, x in zip(rules, weight, strict=True) if abs(x) > 1e-6])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, max_docs: int = 12_000) -> Ensemble:
    """Train on at most ``max_docs`` documents among the labels where ``learn`` holds."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & learn)
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    some = known.orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(max_docs)
    # max_docs ids of 8 bytes go to every executor
    sample = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    got = with_statistics(sample, ["label"]).toPandas()
    return fit_rules(got[STATS].to_numpy(float), got["label"].to_numpy(float))


def score(df: DataFrame, model: Ensemble, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of (doc_id, score, predicted); predicted is 1 from a score of 0.7 on."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    p = model.column()
    return with_statistics(rows, ["doc_id"]).select("doc_id", p.alias("score")).select("doc_id", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
