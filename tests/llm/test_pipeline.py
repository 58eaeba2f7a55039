"""Each stage on its own input, and the whole pipeline, against plain Python on odd rows and the smallest tables."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.conftest import SF
from tracewright.llm import mixing, simhash, toxicity
from tracewright.llm.common import read_table
from tracewright.llm.queries import vocabulary

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return [tuple(r) for r in df.select(*P.COLUMNS).collect()]


def order_of(rows):
    return sorted(rows, key=repr)


def odd_rows():
    """Copies, near copies, repeated passages, insults, nulls, repeated ids, broken characters, long texts."""
    rng = random.Random(12)
    syll = ["an", "er", "to", "li", "mo", "ka", "su", "re", "vü", "né"]

    def prose(n):
        return " ".join("".join(rng.choices(syll, k=rng.randrange(1, 5))) for _ in range(n))

    passage, long_passage = prose(45), prose(400)
    rows = []
    for i in range(120):
        text = prose(rng.randrange(5, 90))
        if i % 4 == 0:
            text = f"{text} grubnik {prose(3)} {rng.choice(['vozzle', 'v.o.z.z.l.e', 'vozzxle'])}."
        if i % 7 == 1:
            text = f"{text} é{passage}é {prose(4)}"
        if i % 30 == 5:
            text += long_passage
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s2", "s3", None]), len(text)))
    rows += [(200 + k, rows[k][1], "en", "s1", 5) for k in (1, 2, 3)]  # copies
    rows += [(300 + k, rows[k][1].replace(" ", "  ", 1), "fr", "s4", 5) for k in (9, 10)]  # alike after splitting
    rows += [(400, None, None, None, None), (401, "", "en", "s1", 0), (None, prose(60), "en", "s2", 3), (None, None, "en", "s2", None), (None, rows[6][1], None, None, 1)]
    rows += [(1, prose(50), "en", "s1", 9), (1, prose(50), "de", "s2", 9)]  # other texts of one id
    rows += [rows[11], rows[11]]  # repeated rows
    rows += [(500, "keep � mark " + passage, "en", "s1", 7), (501, prose(9000), "en", "s5", 1)]
    return rows


def labels_of(rows):
    return [(i, 1, int("grubnik" in (t or ""))) for i, t, *_ in rows if i is not None and i < 120 and i != 1]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    rows = odd_rows()
    spark.createDataFrame(rows, KINDS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels_of(rows), "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def plain_toxic(spark, rows, sf_dir):
    """Scores word by word from the trained machine's table."""
    docs = spark.createDataFrame(rows, KINDS)
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)

    def word(w):
        s, feats = [0, *[toxicity._LETTER.get(c) or 27 + ord(c) % 5 for c in w], 0], Counter()
        for i in range(len(s)):
            for j in range(i + 1, min(len(s), i + toxicity.SPAN - 1)):
                for k in range(j + 1, min(len(s), i + toxicity.SPAN)):
                    feats[(s[i] * 32 + s[j]) * 32 + s[k]] += toxicity.DECAY ** (k - i - 2)
        return sum(model.table[c] * v for c, v in feats.items()) / sum(v * v for v in feats.values()) ** 0.5

    def token(t):
        return max((word(w) for w in toxicity.words_of(t)), default=0.0)

    out = []
    for r in rows:
        found = [[token(t) for t in s] for s in toxicity.sentences(r[1] or "")] or [[0.0]]
        flat = [x for s in found for x in s]
        x = [max(flat), max(max(sum(s) + model.bias, -5.0) for s in found), *(np.log1p(sum(v > lv for v in flat)) for lv in toxicity.LEVELS)]
        z = model.slope[0] + sum(a * b for a, b in zip(model.slope[1:], x, strict=True))
        if 1 / (1 + np.exp(-z)) < 0.5:
            out.append(r)
    return out


def plain_near(rows):
    fp = [simhash.fingerprint(r[1] or "") for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r)
    return list(groups.values())


def plain_repeats(rows):
    raws = [(r[1] or "").encode() for r in rows]
    seen = Counter(r[i : i + 200] for r in raws for i in range(len(r) - 199))
    out = []
    for r, raw in zip(rows, raws, strict=True):
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 199):
            if seen[raw[k : k + 200]] > 1:
                gone[k : k + 200] = True
        text, at = "", 0
        for c in r[1] or "":
            n = len(c.encode())
            text += "" if gone[at : at + n].any() else c
            at += n
        if not gone.any():
            out.append((r[0], r[1] or "", *r[2:]))
        elif text.strip(" "):
            out.append((r[0], text, r[2], r[3], len(text)))
    return out


def fill(budget, nodes):
    """Equal shares by bisection of the level: what each node of a capacity takes."""
    lo, hi = 0.0, float(budget) + 1
    if sum(nodes) <= budget:
        return list(map(float, nodes))
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(min(c, mid) for c in nodes) < budget:
            lo = mid
        else:
            hi = mid
    return [min(c, lo) for c in nodes]


def plain_mix(spark, rows, share=0.8, seed=5):
    docs = spark.createDataFrame(rows, KINDS)
    order = F.xxhash64(F.lit(seed), "doc_id", "text").bitwiseAND(F.lit((1 << 63) - 1))
    got = docs.select(*P.COLUMNS, mixing.default_domain().alias("d"), order.alias("o")).collect()
    leaves = defaultdict(list)
    for r in got:
        leaves[(r.d, r.lang, r.source)].append((r.o, len((r.text or "").split()), tuple(r)[:5]))
    size = {k: sum(n for _, n, _ in v) for k, v in leaves.items()}

    def down(path, budget):
        if len(path) == 3:
            return {path: budget}
        kids = sorted({k[: len(path) + 1] for k in leaves if k[: len(path)] == path}, key=repr)
        parts = fill(budget, [sum(n for k, n in size.items() if k[: len(c)] == c) for c in kids])
        return {k: v for c, t in zip(kids, parts, strict=True) for k, v in down(c, t).items()}

    out = []
    for k, t in down((), share * sum(size.values())).items():
        total = 0
        for _, group in sorted((o, [x for x in leaves[k] if x[0] == o]) for o in {x[0] for x in leaves[k]}):
            total += sum(n for _, n, _ in group)
            if total > t + 1e-3:
                break
            out += [x[2] for x in group]
    return out


def stage(name):
    return dict(P.STAGES)[name]


def frame(spark, rows):
    return spark.createDataFrame(rows, KINDS + ", extra int, score double, _copies int, d string").repartition(3)


def widened(rows):
    return [(*r, 1, 0.5, 7, "x") for r in rows]


def check_near(groups, got):
    """One row of each group, with the least id; got holds the kept rows."""
    left = Counter(got)
    for g in groups:
        least = min(g, key=lambda r: (r[0] is None, r[0] or 0))[0]
        hit = [r for r in set(g) if r[0] == least and left[r]]
        assert len(hit) == 1 and left[hit[0]] == 1, g[:2]
        left[hit[0]] -= 1
    assert not +left


def test_stages_by_brute_force(spark, tables):
    rows = odd_rows()
    kept = rows_of(stage("toxicity")(spark, frame(spark, widened(rows)), tables))
    assert order_of(kept) == order_of(plain_toxic(spark, rows, tables)) and 60 < len(kept) < len(rows) - 20

    near = rows_of(stage("simhash")(spark, frame(spark, widened(rows)), tables))
    check_near(plain_near(rows), near)
    assert sum(r[0] == 1 for r in near) == 3  # different texts of one id

    cut = rows_of(stage("suffix_array")(spark, frame(spark, widened(rows)), tables))
    assert order_of(cut) == order_of(plain_repeats(rows))
    assert any("keep � mark" in r[1] for r in cut)

    mixed = rows_of(stage("mixing")(spark, frame(spark, widened(rows)), tables))
    assert order_of(mixed) == order_of(plain_mix(spark, rows)) and len(mixed) < len(rows)

    packed = stage("packing")(spark, frame(spark, widened(rows)), tables).collect()
    check_packed(rows, packed)


def check_packed(rows, packed):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    want, got, bins = Counter(), Counter(), defaultdict(list)
    for r in rows:
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want.update((r[0], k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096)))
    for r in packed:
        got[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)] += 1
        bins[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == list(np.cumsum([0, *(n for _, n in b[:-1])])) and sum(n for _, n in b) <= 4096
    assert len(bins) <= 1.1 * -(-sum(r.length for r in packed) // 4096) + 1


def test_run_by_brute_force(spark, tables):
    rows = plain_toxic(spark, odd_rows(), tables)
    # of rows that tie, the query chooses: take its choice where it is one of the group's
    chosen = rows_of(stage("simhash")(spark, spark.createDataFrame(rows, KINDS), tables))
    check_near(plain_near(rows), chosen)
    check_packed(plain_mix(spark, plain_repeats(chosen)), P.run(spark, tables).collect())


def test_empty_tables(spark, tables):
    docs = spark.createDataFrame([], KINDS)
    for name, f in P.STAGES:
        out = P.materialise(f(spark, docs, tables), name)
        assert out.count() == 0 and (name == "packing" or out.columns == P.COLUMNS)
        docs = out if name != "packing" else docs


def test_stages_on_the_smallest_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, f in P.STAGES[:-1]:
        out = P.materialise(f(spark, docs, SF), name)
        assert out.columns == P.COLUMNS and 0 < out.count() <= docs.count(), name
        docs = out
    assert docs.count() < before and docs.select("doc_id").distinct().count() == docs.count()
    packed = P.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
