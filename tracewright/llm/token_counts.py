"""Token counts by heap-and-linked-list byte-pair merging.

``count_tokens`` adds ``n_bytes``, ``n_tokens`` and ``over_limit`` to (id, text) rows. A word's count
is its number of initial symbols minus the merges made: adjacent pairs wait in a heap by rank, the
symbols of a word form a doubly linked list, and the lowest-ranked, leftmost pair merges first. No
identifiers are made. Words repeat, so each task remembers counts of white-space separated chunks.

Chunks of ASCII characters, and of Latin-1 letters with ASCII marks behind them, are split into words
here; all others by the library's own normalizer and splitter, whose Unicode tables are its own.

Defined cases: a null or empty text has 0 bytes and 0 tokens; a null id is kept; repeated rows give
repeated rows; very long texts and words are counted whole; equal ranks in a word merge from the left;
an empty table gives an empty table; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Chunks and words a worker remembers before it starts anew; this bounds memory, not results.
CACHE_ENTRIES = 600_000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies, made by their public rule."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {}, 0
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols are left when every merge has been made."""
    n = len(symbols)
    if n < 2:
        return n
    sym = list(symbols)
    before = list(range(-1, n - 1))
    after = list(range(1, n)) + [-1]
    heap = []
    for i in range(n - 1):
        r = ranks.get((sym[i], sym[i + 1]))
        if r is not None:
            heap.append((r, i, sym[i], sym[i + 1]))
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if j < 0 or sym[i] != a or sym[j] != b:
            continue  # one of the two has merged since
        sym[i], sym[j] = a + b, ""
        k = after[i] = after[j]
        left -= 1
        if k >= 0:
            before[k] = i
            r = ranks.get((sym[i], sym[k]))
            if r is not None:
                heapq.heappush(heap, (r, i, sym[i], sym[k]))
        h = before[i]
        if h >= 0:
            r = ranks.get((sym[h], sym[i]))
            if r is not None:
                heapq.heappush(heap, (r, h, sym[h], sym[i]))
    return left


class WordSplitter:
    """The words that the vocabulary's normalizer and splitter make of a chunk without special strings."""

    #: Letters that every version of Unicode since 1.1 has as letters, composed, and marks behind them.
    plain = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)").fullmatch

    def __init__(self, tokenizer_file: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.spec = json.load(open(tokenizer_file, encoding="utf-8"))
        self.suffix = self.spec["model"].get("end_of_word_suffix") or ""
        steps = self.spec["pre_tokenizer"]["pretokenizers"]
        pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")
        # \s of the library's engine is the property White_Space; this engine's has a few more
        self.find = regex.compile(pattern.replace(r"^\s", r"^\p{White_Space}")).findall
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in self.spec["added_tokens"]) or r"(?!)")

    def __call__(self, chunk: str) -> list[str] | None:
        """Words as texts; None if only the library can tell."""
        m = self.plain(chunk)
        if m:
            return [m[1].lower(), m[2]] if m[2] else [m[1].lower()]
        return self.find(chunk.lower()) if chunk.isascii() else None

    def symbols(self, chunk: str) -> list[str]:
        """Words as the symbols of their bytes, by the library's normalizer and splitter."""
        t = self.tokenizer
        return [w for w, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(chunk))]


class Counter(dict):
    """Chunk of text without spaces or line ends -> number of tokens; missing chunks are counted."""

    def __init__(self, tokenizer_file: str):
        super().__init__()
        self.split = WordSplitter(tokenizer_file)
        merges = self.split.spec["model"]["merges"]
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(merges)}
        self.suffix = self.split.suffix
        self.symbols = byte_symbols()
        self.words: dict[str, int] = {}

    def merged(self, symbols: Iterable[str]) -> int:
        s = list(symbols)
        s[-1] += self.suffix
        return merged_length(s, self.ranks)

    def word(self, word: str) -> int:
        n = self.words.get(word)
        if n is None:
            n = self.words[word] = self.merged(self.symbols[b] for b in word.encode("utf-8", "surrogatepass"))
        return n

    def piece(self, chunk: str) -> int:
        words = self.split(chunk)
        return sum(map(self.merged, self.split.symbols(chunk))) if words is None else sum(map(self.word, words))

    def __missing__(self, chunk: str) -> int:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        if len(self.words) > CACHE_ENTRIES:
            self.words.clear()
        if "<|" in chunk:
            pieces = self.split.special.split(chunk)
            n = len(pieces) - 1 + sum(map(self.piece, pieces))
        else:
            n = self.piece(chunk)
        self[chunk] = n
        return n

    def text(self, text: str) -> int:
        return sum(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_counters: dict[str, Counter] = {}


def counter(tokenizer_file: str) -> Counter:
    """One counter a worker process and vocabulary."""
    if tokenizer_file not in _counters:
        _counters[tokenizer_file] = Counter(tokenizer_file)
    return _counters[tokenizer_file]


def count_tokens(df: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Rows of (``id_col``, n_bytes, n_tokens, over_limit); over_limit means more than ``limit`` tokens."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(tokenizer_file).text
        for b in batches:
            n = pa.array([tokens(t) for t in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])

    kind = dict(rows.dtypes)["doc_id"]
    out = rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("doc_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
