"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and its odd inputs."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tracewright.llm import chat, common, lattice_dedup, media, mixing, packing, quality, queries, simhash, suffix_dedup, token_counts, toxicity

DOCS = "doc_id long, text string, n_bytes string, rid int, score string"  # with columns that clash


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "x", 1, "y") for i, t in enumerate(texts)], DOCS)


ODD = [None, "", " ", "one", "a b c", "a b c", "É" * 3000, "word " * 5000, "<|endoftext|> tail", "x\u0085y z\x1cq", "İstanbul ΣΑΣ ß", "12.5%% Don't", "日本語 \U0001f600", "\n\n\t", "<\\|im_end|>"]


def unions(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(60)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = unions(600, edges)
    assert got == {i: want[i] for i in {x for e in edges if e[0] != e[1] for x in e}}
    assert common.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    t = Tokenizer.from_file(path)
    sample = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    texts = ODD + sample
    got = {r.doc_id: r for r in token_counts.count_tokens(docs(spark, texts), path).collect()}
    for i, x in enumerate(texts):
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((x or "").encode()), n, n > 2048), x
    assert token_counts.count_tokens(docs(spark, []), path).count() == 0


def test_packing_is_whole_and_tight(spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    t = Tokenizer.from_file(path)
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(80).collect()]
    rows = packing.pack(docs(spark, texts).repartition(5), path, capacity=300, slack=4, fan_in=2).collect()
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), 300)) and sum(r.length for r in own) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    for b in bins.values():
        b.sort(key=lambda r: r.offset)
        assert [r.offset for r in b] == list(np.cumsum([0, *(r.length for r in b[:-1])])) and sum(r.length for r in b) <= 300
    total = sum(r.length for r in rows)
    assert len(bins) <= 1.02 * -(-total // 300) + 1
    assert packing.pack(docs(spark, []), path).count() == 0


def test_simhash_groups(spark):
    rng = random.Random(2)
    words = ["w%d" % i for i in range(300)]
    base = [" ".join(rng.choices(words, k=120)) for _ in range(25)]
    texts = ODD + base + [b.replace(rng.choice(b.split()), "zz", 1) for b in base for _ in range(3)] + base[:3]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    fp = [simhash.fingerprint(t or "") for t in texts]
    want = unions(len(texts), [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4])
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [int(got[i].fingerprint, 16) for i in range(len(texts))] == fp
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    none = simhash.near_duplicates(docs(spark, ["a", "a", "b"], [None, 4, None])).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in none if r.component_id is not None) == [(False, 4), (True, 4)]


def test_fingerprint_by_definition():
    import xxhash

    text = "The Quick  brown\tFox jumps\nover ÀB the the the the the"
    w = text.encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(len(w) - 3)]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert simhash.fingerprint("Two Words") == xxhash.xxh64_intdigest(b"two words", 42) and simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize("blocks", [5, 6, 7])
def test_trie_finds_every_link(blocks):
    rng = np.random.default_rng(blocks)
    fp = np.unique(np.concatenate([rng.integers(0, 1 << 63, 60), *[rng.integers(0, 1 << 63, 1) ^ (1 << rng.integers(0, 63, (40, 3))).sum(axis=1)]])).astype(np.uint64)
    parts, pairs = simhash._parts(blocks), []
    for c in simhash._choices(blocks, 4):
        bits, key = simhash._arranged(fp, parts, c), np.zeros(len(fp), np.uint64)
        shared = sum(parts[i][1] for i in c)
        order = np.argsort(bits, kind="stable")
        key = bits[order] >> np.uint64(64 - shared)
        root = simhash.trie_links(bits[order], np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])), shared, 4)
        pairs += [(order[i], order[r]) for i, r in enumerate(root) if i != r]
    want = unions(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if int(fp[i] ^ fp[j]).bit_count() <= 4])
    assert unions(len(fp), pairs) == want


def test_media_round_trip(spark):
    texts = ODD + ["é" * 288, "a" * 576, "a" * 577]
    got = {r.doc_id: r for r in media.media_features(docs(spark, texts).repartition(3)).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        p = b + b"\xff" * (-len(b) % 576 if b else 576)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert r.media_sha256 == hashlib.sha256(media.png_of(p)).hexdigest() and r.media_bytes == len(media.png_of(p))
    assert got[4][1:] == got[5][1:]
    assert media.media_features(docs(spark, [])).count() == 0


def test_media_ranges_and_retries(spark, tmp_path):
    folder = f"file://{tmp_path}/archives"
    assert media.store(docs(spark, [str(i) * 400 for i in range(50)]).repartition(2), folder) == 50
    r = media.MemberReader(folder, 2048)
    parts = r.partitions()
    assert len(parts) > 10
    assert sorted(i for p in parts for b in r.read(p) for i in b.column("doc_id").to_pylist()) == list(range(50))
    part = next(tmp_path.glob("archives/*.tar"))
    raw = bytearray(part.read_bytes())
    raw[530] ^= 255
    part.write_bytes(raw)
    with pytest.raises(OSError, match="checksum"):
        [list(r.read(p)) for p in parts]


def test_suffix_dedup_by_brute_force(spark):
    rng = random.Random(5)
    shared = ["".join(rng.choices("abcdefghij é", k=k)) for k in (150, 199, 260, 900)]
    texts = [None, "", "short"]
    for _ in range(60):
        texts.append("".join(rng.choice(shared) if rng.random() < 0.4 else "hahe " * rng.randrange(90) if rng.random() < 0.2 else "".join(rng.choices("klmnopqrst", k=rng.randrange(400))) for _ in range(rng.randrange(5))))
    texts += texts[10:14]
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + 200] for r in raws for i in range(len(r) - 199))
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs(spark, texts).repartition(3)).collect()}
    for i, r in enumerate(raws):
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - 199):
            if seen[r[k : k + 200]] > 1:
                gone[k : k + 200] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len(r), int(gone.sum()), runs, bytes(np.frombuffer(r, np.uint8)[~gone]))
    assert suffix_dedup.remove_repeats(docs(spark, [])).count() == 0
    twins = suffix_dedup.remove_repeats(docs(spark, ["q" + shared[3]] * 2, [7, 7]), carry=("rid",)).collect()
    assert [(r.doc_id, r.rid, len(r.kept)) for r in twins] == [(7, 1, 0)] * 2


@pytest.mark.parametrize("size", [2000, 1 << 20])
def test_shards_merge(size, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", size)
    import pyarrow as pa

    rng = random.Random(8)
    core = bytes(rng.choices(range(97, 103), k=230))
    wins = sorted({bytes(rng.choices(range(97, 100), k=rng.randrange(40))) + core[rng.randrange(3) :] + bytes(rng.choices(range(97, 99), k=rng.randrange(30))) for _ in range(60)})
    table = pa.table({"anchor": [1] * len(wins), "part": pa.array([0] * len(wins), pa.int32()), "wid": list(range(len(wins))), "win": wins, "n": pa.array([1] * len(wins), pa.int32())})
    got = {x["wid"]: np.frombuffer(x["runs"], "<i4").reshape(-1, 2) for b in suffix_dedup._shard_rows(iter(table.to_batches(max_chunksize=7)), 200) for x in b.to_pylist()}
    seen = Counter(w[i : i + 200] for w in wins for i in range(len(w) - 199))
    for k, w in enumerate(wins):
        starts = [i for i in range(len(w) - 199) if seen[w[i : i + 200]] > 1]
        assert [i for lo, hi in got.get(k, []) for i in range(lo, hi + 1)] == starts


def test_hot_anchors_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "TASK_WINDOWS", 4)
    rng = random.Random(9)
    core = "".join(rng.choices("abcdef", k=120))
    texts = ["".join(rng.choices("xyz", k=2)) * 60 + core + "".join(rng.choices("uvw", k=1)) * 150 for _ in range(40)]
    raws = [t.encode() for t in texts]
    seen = Counter(r[i : i + 200] for r in raws for i in range(len(r) - 199))
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(docs(spark, texts)).collect()}
    for i, r in enumerate(raws):
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - 199):
            gone[k : k + 200] |= seen[r[k : k + 200]] > 1
        assert got[i] == int(gone.sum())


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "z") for i, v in rows], "vec_id long, embedding array<float>, label int, n_links string")


@pytest.mark.parametrize("shape", sorted(lattice_dedup.SHAPES))
def test_lattice_links(spark, shape):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 64))
    near = np.repeat(x[:15], 6, axis=0) + 0.14 * rng.standard_normal((90, 64))
    rows = [(i, [float(v) for v in np.float32(r)]) for i, r in enumerate(np.concatenate([x, near]))]
    rows += [(900, rows[0][1]), (901, rows[0][1])]
    bad = [(1000, None), (1001, []), (1002, [0.0] * 64), (1003, [float("nan")] * 64), (1004, [None] * 64), (1005, [1.0, 2.0])]
    got = {r.vec_id: r for r in lattice_dedup.near_duplicates(vectors(spark, rows + bad), shape=lattice_dedup.SHAPES[shape]).collect()}
    m = np.array([r[1] for r in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    link = (m @ m.T >= 0.95) & ~np.eye(len(m), dtype=bool)
    ids = [r[0] for r in rows]
    want = unions(len(ids), [(i, j) for i, j in zip(*np.nonzero(link), strict=True)])
    assert link.sum() > 100
    for k, i in enumerate(ids):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (int(link[k].sum()), ids[want[k]], want[k] == k)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, _ in bad)
    assert lattice_dedup.near_duplicates(vectors(spark, [])).count() == 0


def test_lattice_hot_cells(spark, monkeypatch):
    monkeypatch.setattr(lattice_dedup, "TASK_VECTORS", 8)
    rng = np.random.default_rng(4)
    c = rng.standard_normal(64)
    rows = [(i, [float(v) for v in np.float32(c + 0.05 * rng.standard_normal(64))]) for i in range(70)]
    got = lattice_dedup.near_duplicates(vectors(spark, rows)).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(69, 0)}
    odd = [(None, rows[0][1]), (5, rows[0][1]), (5, rows[1][1]), (None, None)]
    got = lattice_dedup.near_duplicates(spark.createDataFrame(odd, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id is None, r.n_links, r.component_id, r.kept) for r in got if r.n_links) == [(False, 2, 5, True), (False, 2, 5, True), (True, 2, 5, False)]


@pytest.mark.parametrize("dim", [8, 64, 384])
@pytest.mark.parametrize("shape", sorted(lattice_dedup.SHAPES))
def test_lattice_recall_at_the_threshold(shape, dim):
    """Pairs at cosine 0.9501 that meet in a cell of some table and pass the signs there."""
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.9501 * x + np.sqrt(1 - 0.9501**2) * z
    grid = lattice_dedup.Lattice(dim, *(lattice_dedup.SHAPES[shape][k] for k in ("tables", "blocks", "width", "radius")))
    a, b = grid.project(x), grid.project(y)
    met = (grid.meets(grid.homes(a), b) | grid.meets(grid.homes(b), a)).any(axis=1)
    met &= lattice_dedup.differing(grid.signs(x), grid.signs(y)) <= lattice_dedup.SIGNS
    assert met.mean() > 0.998


def test_e8_points():
    p = lattice_dedup.short_points()
    assert dict(zip(*np.unique((p**2).sum(axis=1) // 4, return_counts=True), strict=True)) == {0: 1, 2: 240, 4: 2160}
    y = np.random.default_rng(1).normal(size=(200, 8)) * 2
    home = lattice_dedup.nearest_e8(y)
    other = home[:, None] + p[None]
    assert (((2 * y - home) ** 2).sum(axis=1) <= ((2 * y[:, None] - other) ** 2).sum(axis=2).min(axis=1) + 1e-9).all()


def test_toxicity_held_out(spark):
    rng = random.Random(6)
    syll = ["an", "er", "to", "li", "mo", "ka", "su", "re"]
    bad = ["grubnik", "vozzle", "trashag"]

    def text(toxic):
        w = ["".join(rng.choices(syll, k=rng.randrange(1, 5))) for _ in range(rng.randrange(15, 60))]
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            b = rng.choice(bad)
            w.insert(rng.randrange(len(w)), rng.choice([b, ".".join(b), b[:3] + "x" + b[3:], " ".join(b)]) if rng.random() < 0.4 else b)
        return " ".join(w)

    label = [int(rng.random() < 0.3) for _ in range(500)]
    d = docs(spark, [text(t) for t in label])
    lab = spark.createDataFrame([(i, t) for i, t in enumerate(label)], "doc_id long, toxic int")
    model = toxicity.fit(d, lab, F.col("doc_id") < 350)
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    held = range(350, 500)
    assert np.mean([got[i].predicted == label[i] for i in held]) > 0.9
    odd = toxicity.score(docs(spark, ODD + [text(1) for _ in range(3)]), model, carry=("text", "rid")).collect()
    assert len(odd) == len(ODD) + 3 and all(0 <= r.score <= 1 for r in odd) and odd[0].text is None and odd[0].predicted == 0
    nothing = toxicity.fit(d, lab.where("toxic = 5"), F.lit(True))
    assert {r.score for r in toxicity.score(d, nothing).collect()} == {0.0}
    assert toxicity.score(docs(spark, []), model).count() == 0


def test_word_scores_are_kernel_sums():
    rng = np.random.default_rng(2)
    model = toxicity.Model(rng.normal(size=32**3))
    words = ["a", "ab", "aaaa", "abababab", "thereeth", "idiot", "é" * 9, "x" * 24]
    code, weight = toxicity.subsequences(words)
    assert np.allclose(model.scores(words), (model.table[code] * weight).sum(axis=1), atol=1e-5)


def test_string_kernel_by_definition():
    w = ["idiot", "idxiot"]
    code, weight = toxicity.subsequences(w)
    dense = np.zeros((2, 32**3))
    for i in range(2):
        np.add.at(dense[i], code[i], weight[i])
    want = []
    for x in w:
        s, feats = [0, *[ord(c) - 96 for c in x], 0], Counter()
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + toxicity.SPAN)):
                    if j - i < toxicity.SPAN - 1:
                        feats[(s[i] * 32 + s[j]) * 32 + s[k]] += toxicity.DECAY ** (k - i - 2)
        n = sum(v * v for v in feats.values()) ** 0.5
        want.append({c: v / n for c, v in feats.items()})
    for i in range(2):
        assert {int(c): round(float(dense[i, c]), 9) for c in np.flatnonzero(dense[i])} == {c: round(v, 9) for c, v in want[i].items()}


def test_quality_rules(spark):
    d, lab = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(d, lab, F.col("doc_id") % 4 != 2)
    got = quality.score(d, model).join(lab, "doc_id").where("doc_id % 4 = 2").collect()
    assert got and np.mean([r.predicted == r.quality for r in got]) > 0.85
    odd = quality.score(docs(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert {r.score for r in quality.score(docs(spark, ODD), quality.fit(d, lab.where("quality = 7"), F.lit(True))).collect()} == {0.5}
    x = np.random.default_rng(0).random((2000, len(quality.STATS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] <= 0.4)).astype(float)
    e = quality.fit_rules(x, y)
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{s} double" for s in quality.STATS))
    p = np.array([r.p for r in frame.select(e.column().alias("p")).collect()])
    assert ((p > 0.5) == y).mean() > 0.97 and len(e.rules) < 300


def test_mixing_budgets(spark):
    assert mixing.share_out(100, [(1, 10), (1, 200), (2, 1000)]) == [10, 30, 60]
    leaves = {("a", "x", "1"): 10, ("a", "x", "2"): 1000, ("b", "y", "3"): 1000}
    got = mixing.solve(leaves, 500, {}, 1)
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 240, ("b", "y", "3"): 250}  # siblings first
    assert mixing.solve(leaves, 1500, {("b",): 0}, 1)[("b", "y", "3")] == 0
    rng = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 40))), rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s1", "s2"]), 0) for i in range(600)] + [(5, None, "en", "s1", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.plan_mix(d, 0.5, epochs=2, buckets_log2=3).collect()
    assert len(out) == len(rows)
    tokens = {(r[0], r[1]): len((r[1] or "").split()) for r in rows}
    have, took, size = Counter(), Counter(), Counter()
    for r in out:
        k, n = (r._domain, r.lang, r.source), tokens[(r.doc_id, r.text)]
        have[k] += n
        took[k] += n * r._copies
        size[k] = max(size[k], n)
    want = mixing.solve(dict(have), 0.5 * sum(have.values()), {}, 2)
    for k in have:
        assert want[k] - size[k] <= took[k] <= want[k] + 1e-6
    kept = mixing.mix(d, 0.8)
    assert kept.columns == d.columns and mixing.mix(d.limit(0)).count() == 0


def test_chat_round_trip(spark):
    own = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", own), (1, 2, "assistant", own), (1, 3, "user", "<\\|a <|b \\"), (1, 4, "assistant", None), (1, 4, "assistant", "tie"), (2, 0, "user", "alone"), (None, 0, "we\nird\\", "x"), (None, 1, "assistant", "ü" * 2000), (3, 0, "user", ""), (3, 0, "user", "")]
    turns = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    seg = chat.format_turns(turns)
    got = {r.conv_id: r for r in chat.read_back(seg).collect()}
    for c in {r[0] for r in rows}:
        own_rows = sorted([r for r in rows if r[0] == c], key=lambda r: (r[1], r[2], r[3] or ""))
        loss = "".join(r[3] or "" for r in own_rows if r[2] == "assistant")
        text = "".join(f"{r[2]}\n{r[3] or ''}\n" for r in own_rows)
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(own_rows), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    full = chat.expand(seg).where("conv_id = 1").orderBy("example").collect()
    assert [chat.unescape(r.text[r.loss_start : r.loss_end]) for r in full] == [own, "", "tie"]
    assert full[1].text.startswith(full[0].text) and sum(len(r.text) for r in full) == got[1].expanded_chars
    assert all(own not in r.text for r in full)
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0


def test_chat_digests_come_from_written_examples(spark, monkeypatch):
    """Every assistant turn is written with all turns before it, and what is counted is what was written."""
    rows = [(c, t, "assistant" if t % 2 else "user", f"<|im_end|>{c} {t} " * (t + 1)) for c in range(7) for t in range(c)] + [(9, 0, "user", "no reply"), (None, 0, "assistant", "x")]
    seg = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.read_back(seg).collect()}
    text = {r: f"<|im_start|>{r[2]}\n{r[3].replace('<|', '<' + chr(92) + '|')}<|im_end|>\n" for r in rows}
    for c in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == c]
        want = ["".join(text[x] for x in own[: i + 1]) for i, r in enumerate(own) if r[2] == "assistant"]
        assert [r.text for r in chat.expand(seg).where(F.col("conv_id").eqNullSafe(c)).orderBy("example").collect()] == want
        assert (got[c].n_turns, got[c].n_examples, got[c].formatted_chars) == (len(own), len(want), sum(map(len, want)))
    read = []
    monkeypatch.setattr(chat, "_written", lambda s, f=chat._written: read.append(s) or f(s))
    chat.read_back(seg)
    assert read == [seg]


def test_chat_digests_follow_the_stored_examples(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"text {c} {t}") for c in range(4) for t in range(2 * c + 1)]
    stored = chat.store(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    want = {r.conv_id: r for r in chat.digest(stored).collect()}
    swapped = stored.withColumn("text", F.when(F.col("conv_id") == 2, F.replace("text", F.lit("text 2 1"), F.lit("TEXT 2 1"))).otherwise(F.col("text")))
    got = {r.conv_id: r for r in chat.digest(swapped).collect()}
    assert got[2].loss_sha256 != want[2].loss_sha256 and got[2].turns_sha256 != want[2].turns_sha256 and got[3] == want[3]
    masked = stored.withColumn("loss_end", F.when((F.col("conv_id") == 3) & (F.col("example") == 1), F.col("loss_end") - 1).otherwise(F.col("loss_end")))
    got = {r.conv_id: r for r in chat.digest(masked).collect()}
    assert got[3].loss_chars == want[3].loss_chars - 1 and got[2] == want[2]
    for broken in (stored.where("not (conv_id = 3 and example = 0)"), stored.withColumn("text", F.when((F.col("conv_id") == 3) & (F.col("example") == 0), F.replace("text", F.lit("text 3 0"), F.lit("text 3 9"))).otherwise(F.col("text")))):
        with pytest.raises(Exception, match="conversation 3"):
            chat.digest(broken).collect()


def test_tokens_equal_the_library_for_all_code_points():
    """Every code point below U+20000 beside a contraction and inside a word, and random odd strings."""
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    t, count, encoder = Tokenizer.from_file(path), token_counts.counter(path).text, packing.encoder_of(path)
    texts = [f"'{chr(x)}> a{chr(x)}b" for x in range(0x20000) if not 0xD800 <= x < 0xE000]
    rng = random.Random(1)
    odd = [chr(x) for x in [*range(32, 0x250), *range(0x300, 0x400), 0x130, 0x1C5, 0x3A3, 0xA7CB, 0xA7DC, 0x85, 0x2028, 0x3000, 0x200B, 0x1F88, 0xAC00, 0x1100, 0x1161, 0x11A8, 0x1D15E, 0x2ADC, 0xFB1D]] + list("<|endoftext|> \n\t'sSdDlLmM")
    texts += ["".join(rng.choices(odd, k=rng.randrange(1, 14))) for _ in range(20_000)]
    wrong = []
    for at in range(0, len(texts), 2000):
        some = texts[at : at + 2000]
        for x, want, got in zip(some, t.encode_batch(some, add_special_tokens=False), packing.encode_texts(some, encoder), strict=True):
            if count(x) != len(want.ids) or np.asarray(want.ids, "<u4").tobytes() != got:
                wrong.append(x)
    assert not wrong


def test_mixing_keeps_columns_of_any_name(spark):
    names = ["full", "cut", "k", "before", "rest", "qd", "ql", "qs", "_order", "d", "l", "s", "o", "n", "row", "copies"]
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(30), "en", rng.choice(["s1", "s2"]), *range(len(names))) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{x} int" for x in names))
    kept = mixing.mix(d, 0.5)
    assert kept.columns == d.columns and {tuple(r)[4:] for r in kept.collect()} == {tuple(range(len(names)))}
    own = d.withColumn("_domain", F.lit("mine")).withColumn("_copies", F.lit(9))
    out = mixing.plan_mix(own, 0.5)
    assert sorted(out.columns) == sorted(own.columns) and out.where("_domain = 'mine' or _copies = 9").count() == 0


@pytest.mark.parametrize("weights", [{}, {("domain1",): 3.0, ("domain0", "de"): 0.0, ("domain2", "en", "s2"): 0.5}])
def test_mixing_of_more_sources_than_the_driver_takes(spark, monkeypatch, weights):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randrange(40), rng.choice(["en", "de", None]), rng.choice([None, *(f"s{k * k}" for k in range(9))])) for i in range(400)] + [(900, "", "xx", "empty")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = []
    for most in (200_000, 3):
        monkeypatch.setattr(mixing, "MAX_LEAVES", most)
        got.append(sorted((r.doc_id, r._copies) for r in mixing.plan_mix(d, 0.7, weights, epochs=2, buckets_log2=2).collect()))
    assert got[0] == got[1] and len({c for _, c in got[0]}) > 1


@pytest.mark.parametrize("small", [1, 7, 1000])
def test_mixing_prefix_is_the_longest_that_fits(spark, monkeypatch, small):
    """Ranges are divided until they are small; the cut is where plain Python finds it."""
    monkeypatch.setattr(mixing, "SMALL", small)
    rng = random.Random(small)
    rows = [("a", "x", str(i % 3), rng.randrange(1 << 63) if i % 5 else 77, rng.randrange(20)) for i in range(300)] + [(None, None, None, 5, 3)]
    quota = [("a", "x", "0", 0, 400.0), ("a", "x", "1", 0, 0.0), ("a", "x", "2", 0, 1e6), (None, None, None, 1, 2.0)]
    keys = spark.createDataFrame(rows, "d string, l string, s string, o long, n long")
    got = {(r.d, r.l, r.s): r.cut for r in mixing._last_inside(keys, spark.createDataFrame(quota, "d string, l string, s string, full int, rest double"), 4).collect()}
    for d, l, s, _, rest in quota:  # noqa: E741
        own = [(o, n) for a, b, c, o, n in rows if (a, b, c) == (d, l, s)]
        fits = [o for o, _ in own if sum(n for p, n in own if p <= o) <= rest]
        taken = {o for o, _ in own if o <= got.get((d, l, s), 1 << 63)}
        assert taken == set(fits)


def test_toxicity_carries_columns_of_any_name(spark):
    model = toxicity.Model(np.zeros(32**3), 0.0, (0.1,) * (len(toxicity.FEATURES) + 1))
    d = docs(spark, ["a b. c", None]).withColumns({c: F.lit(5) for c in ("top", "past0", "sentence", "_text", "_c0", "_p")})
    out = toxicity.score(d, model, carry=("top", "past0", "sentence", "_text", "_c0", "_p", "text")).collect()
    assert [(r.top, r.past0, r._c0, r._p) for r in out] == [(5, 5, 5, 5)] * 2 and {r.text for r in out} == {"a b. c", None}
    with pytest.raises(ValueError, match="carried"):
        toxicity.score(d, model, carry=("predicted",))


def test_toxicity_reads_texts_alike_by_arrow_and_by_word():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    model = toxicity.Model(rng.normal(size=32**3), -0.3, (0.0,))
    texts = [t or "" for t in ODD] + ["i d i o t you. a b", "a " * 100, "One two. Three! four? No.x y", "x" * 90 + " " + "ab." * 40, "\u2003wide space. tail"]
    got = toxicity._text_features(pa.array(texts), toxicity.Scores(model))
    seen = toxicity.Scores(model)
    for t, x in zip(texts, got, strict=True):
        s = toxicity.sentences(t) or [[""]]
        flat = [v for w in s for v in seen.learn(w)]
        want = [max(flat), max(max(sum(seen.learn(w)) - 0.3, -5) for w in s), *(np.log1p(sum(v > lv for v in flat)) for lv in toxicity.LEVELS)]
        assert np.allclose(x, want), t
