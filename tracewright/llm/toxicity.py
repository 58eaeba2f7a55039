"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two words is the weighted count of the subsequences of three letters that they share,
word ends included, a factor ``DECAY`` for each letter skipped inside a span of ``SPAN`` letters, over
the words' own norms; that of two sentences is the sum over their pairs of words. So gaps and inserted
letters lower a word's likeness to an insult but don't hide it; other characters inside a word
(``i.d.i.o.t``) and single letters in a row are read through.

The machine is trained on labelled sentences. A document lends its label to its sentences (stretches
of at most ``SENTENCE`` words), though most sentences of a toxic document are clean, so training goes
in rounds: the first takes two sentences of each document at random; each later one takes the
sentences that the last machine finds likeliest to be toxic, of toxic documents (the witnesses) and
clean ones (the hard negatives) alike, and a copy of each with a letter put into its most telling
word. Landmarks are words of those sentences: the most telling of the witnesses, the most telling of
the hard negatives, and others of both. A squared-hinge machine is fitted to the sentences' Nystroem
coordinates. It is linear in the landmarks' subsequences, so a word's part in any sentence's score is a
sum over one table. A document's probability is a logistic of its highest word and sentence scores
and the numbers of its words past some scores, fitted to the sample's documents.

Bounds, all of which concern training alone: at most ``max_docs`` labelled documents of each label, the
least by hash, one of near copies (texts with the same least shingle); of each at most three sentences
a round; ``landmarks`` landmark words. Scoring reads every word of every text.

Defined cases: null and empty texts and texts without letters score like clean texts whose words say
nothing; long tokens are read in overlapping windows, whole, very long texts are read whole, in sentences;
without labels of both kinds every score is 0 (nothing is known to be toxic); ids may be null or
repeat, repeated rows score alike; an empty table gives an empty table; other columns are ignored
unless carried, and carried ones may have any name but those of the result (ValueError).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialise, release, trim

DECAY, SPAN = 0.5, 5
_PATTERNS = [(a, b, DECAY ** (b - 2)) for a in range(1, SPAN - 1) for b in range(a + 1, SPAN)]
LONGEST, CACHE_ENTRIES = 24, 250_000
#: Words of a sentence at most.
SENTENCE = 32
#: Documents that a task scores at a time.
ROWS = 256
#: Word scores past which a document's words are counted.
LEVELS = (0.0, 0.5, 0.8, 1.2, 1.6)
FEATURES = ["top", "sentence", *(f"past{i}" for i in range(len(LEVELS)))]
_LETTER = {c: i + 1 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}


def words_of(token: str) -> list[str]:
    """A token's letters in stretches of LONGEST, each half over the next."""
    w = token if token.isalpha() else "".join(filter(str.isalpha, token))
    if len(w) <= LONGEST:
        return [w] if w else []
    return [w[i : i + LONGEST] for i in range(0, len(w) - LONGEST // 2, LONGEST // 2)]


def tokens_of(text: str) -> list[str]:
    """Lower-case tokens; three or more single letters in a row are one."""
    out: list[str] = []
    run: list[str] = []
    for t in [*pc.utf8_lower(pa.scalar(text)).as_py().split(), ""]:  # Arrow lower-cases, as it does in scoring
        if len(t) == 1 and t.isalpha():
            run.append(t)
            continue
        out += ["".join(run)] if len(run) > 2 else run
        run = []
        out.append(t)
    return out[:-1]


def ends_sentence(token: str) -> bool:
    return len(token) > 2 and token[-1] in ".!?"


def sentences(text: str) -> list[list[str]]:
    """Stretches of at most SENTENCE tokens up to one that ends a sentence."""
    out: list[list[str]] = []
    now: list[str] = []
    for t in tokens_of(text):
        now.append(t)
        if len(now) == SENTENCE or ends_sentence(t):
            out.append(now)
            now = []
    return [*out, now] if now else out


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code, weight) of each word's subsequences, weight 0 where a word is too short; weights over the norm."""
    size = max(map(len, words)) + 2
    letters = np.zeros((len(words), size + SPAN), np.int32)
    for i, w in enumerate(words):
        letters[i, 1 : len(w) + 1] = [_LETTER.get(c) or 27 + ord(c) % 5 for c in w]
    length = np.array([len(w) + 2 for w in words])[:, None]
    at = np.arange(size)[None, :]
    codes, weights = [], []
    for a, b, weight in _PATTERNS:
        codes.append((letters[:, :size] * 32 + letters[:, a : a + size]) * 32 + letters[:, b : b + size])
        weights.append(np.where(at + b < length, weight, 0.0))
    code, weight = np.concatenate(codes, axis=1), np.concatenate(weights, axis=1)
    order = np.argsort(code, axis=1)
    code, weight = np.take_along_axis(code, order, 1), np.take_along_axis(weight, order, 1)
    # weights of equal codes of a word come together on the last of them
    total = np.cumsum(weight, axis=1)
    last = np.ones(code.shape, bool)
    last[:, :-1] = code[:, 1:] != code[:, :-1]
    upto = np.maximum.accumulate(np.where(last, total, 0.0), axis=1)
    before = np.concatenate([np.zeros((len(words), 1)), upto[:, :-1]], axis=1)
    weight = np.where(last, total - before, 0.0)
    norm = np.sqrt((weight**2).sum(axis=1, keepdims=True))
    return code, weight / np.maximum(norm, 1e-12)


def _plain(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, weight) of each occurrence of a subsequence, not yet brought together, and each word's norm."""
    size = max(map(len, words)) + 2
    letters = np.zeros((len(words), size + SPAN), np.int32)
    flat = np.array([_LETTER.get(c) or 27 + ord(c) % 5 for c in "".join(words)], np.int32)
    length = np.array([len(w) for w in words])
    at = np.arange(size)
    letters[:, 1 : size + 1][at[None, :] < length[:, None]] = flat
    code = np.concatenate([(letters[:, :size] * 32 + letters[:, a : a + size]) * 32 + letters[:, b : b + size] for a, b, _ in _PATTERNS], axis=1)
    weight = np.concatenate([np.where(at[None, :] + b < length[:, None] + 2, np.float32(v), np.float32(0)) for _, b, v in _PATTERNS], axis=1)
    norm = np.sqrt((weight**2).sum(axis=1))
    # a subsequence that a word has twice weighs the sum: only such words need their codes sorted out
    apart = np.where(weight > 0, code, (1 << 16) + np.arange(code.shape[1], dtype=np.int32))
    apart.sort(axis=1)
    twice = np.flatnonzero((apart[:, 1:] == apart[:, :-1]).any(axis=1))
    if len(twice):
        order = np.argsort(code[twice], axis=1)
        c, w = np.take_along_axis(code[twice], order, 1), np.take_along_axis(weight[twice], order, 1).astype(np.float64)
        new = np.ones(c.shape, bool)
        new[:, 1:] = c[:, 1:] != c[:, :-1]
        sums = np.add.reduceat(w.ravel(), np.flatnonzero(new.ravel()))
        row = np.repeat(np.arange(len(twice)), new.sum(axis=1))
        norm[twice] = np.sqrt(np.bincount(row, weights=sums**2, minlength=len(twice)))
    return code, weight, np.maximum(norm, 1e-12)


@dataclass
class Model:
    table: np.ndarray | None
    bias: float = 0.0
    slope: tuple[float, ...] = ()

    def scores(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_size.setdefault(-(-len(w) // 4), []).append(i)
        for some in by_size.values():
            for at in range(0, len(some), 10_000):
                part = some[at : at + 10_000]
                code, weight, norm = _plain([words[i] for i in part])
                out[part] = (self.table[code] * weight).sum(axis=1) / norm
        return out


class Scores(dict):
    """Token -> score, that of its likeliest stretch; learned in batches."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def learn(self, tokens: list[str]) -> np.ndarray:
        """The scores of distinct tokens."""
        if len(self) + len(tokens) > CACHE_ENTRIES:
            self.clear()
        new = [t for t in tokens if t not in self]
        split = [words_of(t) for t in new]
        got = iter(self.model.scores([w for ws in split for w in ws]).tolist() if any(split) else [])
        for t, ws in zip(new, split, strict=True):
            self[t] = max((next(got) for _ in ws), default=0.0)
        return np.fromiter(map(self.__getitem__, tokens), float, len(tokens))


def _features(score: np.ndarray, starts: np.ndarray, first: np.ndarray, bias: float) -> np.ndarray:
    """(documents, FEATURES) from token scores, the tokens that begin sentences and those that begin documents."""
    begin = np.flatnonzero(starts)
    sentence = np.maximum(np.add.reduceat(score, begin) + bias, -5.0)
    columns = [np.maximum.reduceat(score, first), np.maximum.reduceat(sentence, np.searchsorted(begin, first))]
    columns += [np.log1p(np.add.reduceat((score > v).astype(np.int64), first)) for v in LEVELS]
    return np.stack(columns, axis=1)


def _text_features(texts: pa.Array, seen: Scores) -> np.ndarray:
    """FEATURES of each text: tokens are told apart by Arrow, and each distinct one is scored once."""
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(texts)))  # an empty text has one token, the empty one
    first = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
    coded = lists.flatten().dictionary_encode()
    at = coded.indices.to_numpy()
    tokens = coded.dictionary
    score = seen.learn(tokens.to_pylist())[at]
    ends = pc.match_substring_regex(tokens, r"[.!?]$").to_numpy(zero_copy_only=False) & (pc.utf8_length(tokens).to_numpy() > 2)
    starts = np.zeros(len(at) + 1, bool)
    starts[1:] = ends[at]
    starts[first] = True
    starts = starts[:-1]
    place = np.arange(len(at))
    starts |= (place - np.maximum.accumulate(np.where(starts, place, 0))) % SENTENCE == 0
    out = _features(score, starts, first, seen.model.bias)
    # texts with three single letters in a row are read again with those as one token
    single = pc.match_substring_regex(tokens, r"^\pL$").to_numpy(zero_copy_only=False)[at]
    if single.any():
        row = np.flatnonzero(single[2:] & single[1:-1] & single[:-2])
        for i in np.unique(np.searchsorted(first, row, side="right") - 1).tolist():
            s = sentences(texts[i].as_py())
            flat = [t for x in s for t in x]
            some = dict.fromkeys(flat)
            known = dict(zip(some, seen.learn(list(some)).tolist(), strict=True))
            begins = np.zeros(len(flat), bool)
            begins[np.cumsum([0, *map(len, s[:-1])])] = True
            out[i] = _features(np.array([known[t] for t in flat]), begins, np.zeros(1, np.int64), seen.model.bias)[0]
    return out


def _document_rows(batches: Iterator[pa.RecordBatch], model: Model, names: list[str]) -> Iterator[pa.RecordBatch]:
    """All columns but the last, the text, and the features after them."""
    seen = Scores(model)
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            part = b.slice(lo, ROWS)
            x = _text_features(part.column(part.num_columns - 1), seen)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(x[:, i]) for i in range(x.shape[1]))], names)
    del seen
    trim()


def with_insertion(word: str, rng: np.random.Generator) -> str:
    """The word with a letter put in or doubled, as evasive spellings have it."""
    if len(word) < 4:
        return word
    i = int(rng.integers(1, len(word)))
    return word[:i] + (word[i - 1] if rng.random() < 0.3 else chr(97 + int(rng.integers(26)))) + word[i:]


def _instance_rows(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    """(words of a sentence, its most telling word, label) of the sentences that a round trains on."""
    seen = Scores(model) if model else None
    for b in batches:
        rows: list[tuple] = []
        for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
            found = [w for w in ([w for t in s for w in words_of(t)] for s in sentences(text)) if w]
            if not found:
                continue
            rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
            other = found[int(rng.integers(len(found)))]
            if seen is None:
                rows += [(found[int(rng.integers(len(found)))], None, label), (other, None, label)]
                continue
            flat = list(dict.fromkeys(w for s in found for w in s))
            score = dict(zip(flat, seen.learn(flat).tolist(), strict=True)).__getitem__
            best = sorted(found, key=lambda s: -max(map(score, s)))
            word = max(best[0], key=score)
            rows.append((best[0], word, label))
            if label and len(best) > 1 and sum(map(score, best[1])) + model.bias > 0:
                rows.append((best[1], max(best[1], key=score), label))
            elif not label:
                rows.append((other, None, label))
            rows.append(([with_insertion(w, rng) if w == word else w for w in best[0]], None, label))
        columns = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(list(columns[0]), pa.list_(pa.string())), pa.array(list(columns[1]), pa.string()), pa.array(list(columns[2]), pa.int32())], ["words", "word", "label"])


class Landmarks:
    """The Nystroem map that landmark words span: kernel values with them, turned to coordinates."""

    def __init__(self, words: list[str]):
        code, weight = subsequences(words)
        row, col = np.nonzero(weight)
        self.row, self.code, self.weight = row, code[row, col], weight[row, col].astype(np.float32)
        self.codes, self.column = np.unique(self.code, return_inverse=True)
        gram = np.zeros((len(words), len(words)))
        for lo in range(0, len(self.codes), 4096):  # a few columns at a time
            part = np.zeros((len(words), 4096), np.float32)
            here = (self.column >= lo) & (self.column < lo + 4096)
            part[row[here], self.column[here] - lo] = self.weight[here]
            gram += part @ part.T
        value, vector = np.linalg.eigh(gram)
        good = value > 1e-4 * value.max()
        self.root = (vector[:, good] / np.sqrt(value[good])).astype(np.float32)

    def kernel(self, words: list[str]) -> np.ndarray:
        """(words, landmarks) kernel values."""
        code, weight = subsequences(words)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        known = [np.flatnonzero(x) for x in (self.codes[at] == code) & (weight > 0)]
        weight = weight.astype(np.float32)
        out = np.zeros((len(words), len(self.root)), np.float32)
        for lo in range(0, len(self.root), 256):  # a few landmarks at a time
            columns = np.zeros((len(self.codes), 256), np.float32)
            here = (self.row >= lo) & (self.row < lo + 256)
            columns[self.column[here], self.row[here] - lo] = self.weight[here]
            for i, some in enumerate(known):
                out[i, lo : lo + 256] = (weight[i, some] @ columns[at[i, some]])[: len(self.root) - lo]
        return out

    def table(self, beta: np.ndarray) -> np.ndarray:
        """The weight of each subsequence in a machine with weights ``beta`` of the coordinates."""
        out = np.zeros(32**3)
        np.add.at(out, self.code, self.weight * (self.root.astype(np.float64) @ beta)[self.row])
        return out


def _coordinate_rows(batches: Iterator[pa.RecordBatch], marks: Landmarks) -> Iterator[pa.RecordBatch]:
    """(label, z) of each sentence: the sum of its words' coordinates as bytes of 16-bit floats."""
    for b in batches:
        for lo in range(0, b.num_rows, 500):
            some = b.slice(lo, 500)
            lists = some.column("words")
            flat = lists.flatten().dictionary_encode()
            z = (marks.kernel(flat.dictionary.to_pylist()) @ marks.root)[flat.indices.to_numpy()]
            z = np.add.reduceat(z, lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py())
            yield pa.RecordBatch.from_arrays([some.column("label"), pa.array([r.tobytes() for r in z.astype(np.float16)], pa.binary())], ["label", "z"])
    trim()


def _signed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text with the least hash of its runs of four words, which near copies mostly share."""
    import xxhash

    for b in batches:
        least = []
        for t in b.column("text").to_pylist():
            w = t.encode("utf-8", "surrogatepass").split()
            runs = {b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))}
            least.append(min(map(xxhash.xxh64_intdigest, runs)) >> 1)
        yield pa.RecordBatch.from_arrays([b.column("text"), b.column("label"), pa.array(least, pa.int64())], ["text", "label", "signature"])


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, learn: Column, limit: int) -> DataFrame:
    """(text, label) of at most ``limit`` labelled documents of each label, the least by a hash of the id."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull() & learn)
    known = known.groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    order = F.xxhash64(F.lit("sample"), "doc_id")
    some = known.where("label = 1").orderBy(order, "doc_id").limit(limit).unionByName(known.where("label = 0").orderBy(order, "doc_id").limit(limit))
    # at most 2 * limit ids of 8 bytes go to every executor
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id").select("text", "label")
    # copies would make all words of a text stand out: of texts with the same least shingle one stays
    signed = rows.mapInArrow(_signed_rows, "text string, label int, signature long")
    return signed.groupBy("signature", "label").agg(F.min("text").alias("text")).select("text", "label")


def _machine(z: np.ndarray, y: np.ndarray, cost: float = 1.0) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by Newton steps, both classes weighing the same; ``z`` is read in slices."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y) * cost
    width = z.shape[1] + 1
    beta = np.zeros(width)
    ridge = np.eye(width)
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        left, right = ridge.copy(), np.zeros(width)
        for lo in range(0, len(y), 2000):
            x = np.hstack([z[lo : lo + 2000].astype(np.float32), np.ones((len(z[lo : lo + 2000]), 1), np.float32)])
            active = y[lo : lo + 2000] * (x @ beta) < 1
            x, w, t = x[active], weight[lo : lo + 2000][active], y[lo : lo + 2000][active]
            left += (x * w[:, None].astype(np.float32)).T @ x
            right += (w * t) @ x
        new = np.linalg.solve(left, right)
        if np.abs(new - beta).max() < 1e-5:
            break
        beta = new
    return beta[:-1], float(beta[-1])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.hstack([np.ones((len(x), 1)), x])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def _telling(words: list[str | None], most: int) -> list[str]:
    """The words that are most often a sentence's most telling one."""
    counts = Counter(w for w in words if w)
    return [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most]]


def _others(lists: list[list[str]], most: int, seed: int) -> list[str]:
    words = sorted({w for ws in lists for w in ws})
    return [words[i] for i in np.random.default_rng(seed).permutation(len(words))[:most]]


def fit(docs: DataFrame, labels: DataFrame, learn: Column, max_docs: int = 3000, landmarks: int = 1024, rounds: int = 4) -> Model:
    """Train on at most ``max_docs`` documents of each label among the labels where ``learn`` holds."""
    sample = materialise(labelled_sample(docs, labels, "toxic", learn, max_docs), "sample")
    known = {r["label"] for r in sample.select("label").distinct().collect()}
    model: Model | None = None
    for turn in range(rounds) if known == {0, 1} else ():
        chosen = materialise(sample.mapInArrow(lambda it, m=model: _instance_rows(it, m), "words array<string>, word string, label int"), "sentences")
        got = chosen.toArrow()
        label = got.column("label").to_numpy()
        words = [got.column("words").filter(pa.array(label == v)).to_pylist() for v in (1, 0)]
        if not all(words):
            release(chosen)
            break
        quarter = landmarks // 4 if model else 0
        marks = [w for v in (1, 0) for w in _telling(got.column("word").filter(pa.array(label == v)).to_pylist(), quarter)]
        for ws in words:
            marks += _others(ws, landmarks // 2 - quarter, turn)
        del got, words
        basis = Landmarks(list(dict.fromkeys(marks)))
        rows = chosen.mapInArrow(lambda it, m=basis: _coordinate_rows(it, m), "label int, z binary").toArrow()
        z = np.concatenate([np.frombuffer(b"".join(c.to_pylist()), np.float16).reshape(len(c), -1) for c in rows.column("z").chunks if len(c)])
        y = np.where(rows.column("label").to_numpy() > 0, 1.0, -1.0)
        del rows
        beta, bias = _machine(z, y)
        model = Model(basis.table(beta), bias)
        release(chosen)
    if model is not None:
        trained = model
        names = ["label", *FEATURES]
        scored = sample.select("label", "text").mapInArrow(lambda it: _document_rows(it, trained, names), "label int, " + ", ".join(f"{x} double" for x in FEATURES)).toArrow()
        x = np.stack([scored.column(c).to_numpy() for c in FEATURES], axis=1)
        model.slope = tuple(float(v) for v in _logistic(x, scored.column("label").to_numpy().astype(float)))
    release(sample)
    return model or Model(None)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows of (doc_id, carried columns, score, predicted); predicted is 1 from a score of 0.5 on."""
    keep = ["doc_id", *carry]
    if len({*keep, "score", "predicted"}) != len(keep) + 2:
        raise ValueError("carried columns can't be named like the result's")
    own = [f"_c{i}" for i in range(len(keep))]  # carried columns may have any name meanwhile
    rows = df.select(F.col(id_col).alias(own[0]), *[F.col(f"`{c}`").alias(o) for c, o in zip(carry, own[1:], strict=True)], F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    back = [F.col(o).alias(c) for o, c in zip(own, keep, strict=True)]
    if model.table is None:
        return rows.select(*back, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = df.sparkSession.sparkContext.broadcast(model)  # 256 KB, whatever the input
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{o} {kinds[o]}" for o in own), *(f"{x} double" for x in FEATURES)])
    z = F.lit(model.slope[0])
    for weight, name in zip(model.slope[1:], FEATURES, strict=True):
        z = z + F.lit(weight) * F.col(name)
    out = rows.mapInArrow(lambda it: _document_rows(it, shared.value, [*own, *FEATURES]), schema)
    out = out.withColumn("_p", 1 / (1 + F.exp(-z)))
    return out.select(*back, F.col("_p").alias("score"), (F.col("_p") >= 0.5).cast("int").alias("predicted"))
