"""Best-fit packing of documents into training sequences by hierarchical residual packing.

Round 0 runs where the documents are read: every partition tokenizes its documents, cuts those
longer than a sequence into pieces, and packs its pieces best-fit, longest first. Nearly full bins
are final. Underfull bins go on as items of their fill: rounds merge neighbouring partitions
(``fan_in`` to one, without a shuffle), pack the items best-fit again and emit what is nearly full,
until so few partitions are left that each root has up to ``root_items`` items. A bin carries its
pieces' places, at most ``capacity`` of them, so no join is needed to find where a piece went. The
rounds' bins are written to the shared folder, so a lost executor never changes a finished round.

Defined cases: a null or empty text is the end token alone; a null id is kept; repeated rows are
packed each; an empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import materialise, trim
from .token_counts import WordSplitter

#: Chunks and words a worker remembers; past half of them the older half goes. This bounds memory, not results.
CACHE_ENTRIES = 600_000


class Encoder:
    """Ids of chunks of text without spaces or line ends, as little-endian 32-bit bytes.

    The vocabulary drops white space and marks word ends, so words encode alone, and the ids of many
    words given to the library in one call fall apart again at the ids that end a word. Chunks that
    only the library can split are given to it whole. A plain word is a chunk, too, and remembered
    once; other words are remembered behind a space.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.split = WordSplitter(tokenizer_file)
        self.tokenizer = self.split.tokenizer
        suffix = self.split.suffix
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith(suffix)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def encode_words(self, words: list[str]) -> Iterator[bytes]:
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            ids = self.encode(" ".join(some))
            cut = 4 * np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
            raw = ids.tobytes()
            if len(cut) == len(some) + 1:
                yield from [raw[i:j] for i, j in zip(cut.tolist(), cut[1:].tolist(), strict=False)]
            else:
                yield from [self.encode(w).tobytes() for w in some]

    def learn(self, chunks: list[str]) -> dict[str, bytes]:
        """What is known, with all of the distinct ``chunks`` in it."""
        if len(self.known) + len(chunks) > CACHE_ENTRIES // 2:
            self.known, self.older = {}, self.known
        known, older, split = self.known, self.older, self.split
        plain, find = split.plain, split.find
        parts: list[tuple[str, list[str]]] = []
        new: dict[str, None] = {}
        for c in chunks:
            if c in known:
                continue
            if c in older:
                known[c] = older[c]
                continue
            m = plain(c)
            if m:
                keys = [m[1].lower(), " " + m[2]] if m[2] else [m[1].lower()]
            elif c.isascii() and "<|" not in c:
                keys = [w if w.isalpha() else " " + w for w in find(c.lower())]
            else:
                known[c] = self.encode(c).tobytes()
                continue
            parts.append((c, keys))
            for k in keys:
                if k not in known:
                    if k in older:
                        known[k] = older[k]
                    else:
                        new[k] = None
        known.update(zip(new, self.encode_words([k.lstrip(" ") for k in new]), strict=True))
        for c, keys in parts:
            known[c] = known[keys[0]] if len(keys) == 1 else b"".join([known[k] for k in keys])
        return known


_encoders: dict[str, Encoder] = {}


def encoder_of(tokenizer_file: str) -> Encoder:
    """One encoder a worker process and vocabulary."""
    if tokenizer_file not in _encoders:
        _encoders[tokenizer_file] = Encoder(tokenizer_file)
    return _encoders[tokenizer_file]


def encode_texts(texts: list[str], encoder: Encoder) -> Iterator[bytes]:
    """The ids of each text as bytes."""
    for at in range(0, len(texts), 256):
        chunked = [t.replace("\n", " ").split(" ") for t in texts[at : at + 256]]
        ids = encoder.learn(list(set(chain.from_iterable(chunked)))).__getitem__
        for c in chunked:
            yield b"".join(map(ids, c))


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers, longest item first, each to the bin with the least room that holds it.

    Rooms in use are the bits of one integer, so the best bin is found without a scan.
    """
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        room -= n
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
    return bins


PIECE = "struct<doc_id: long, piece: int, start: long, length: long, ids_crc32: long, offset: long>"
BIN = f"sequence_id long, fill long, done boolean, pieces array<{PIECE}>"
_PIECE_ARROW = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
_BIN_ARROW = pa.schema([("sequence_id", pa.int64()), ("fill", pa.int64()), ("done", pa.bool_()), ("pieces", pa.list_(_PIECE_ARROW))])


def _emit(items: list[tuple[int, list[dict]]], capacity: int, slack: int, level: int) -> Iterator[pa.RecordBatch]:
    """Pack (fill, pieces) items and yield the bins in batches."""
    part = TaskContext.get().partitionId()
    rows: list[dict] = []
    for n, members in enumerate(best_fit([f for f, _ in items], capacity)):
        pieces, fill = [], 0
        for m in members:
            for p in items[m][1]:
                pieces.append(p | {"offset": p["offset"] + fill})
            fill += items[m][0]
        rows.append({"sequence_id": (level << 56) | (part << 32) | n, "fill": fill, "done": capacity - fill <= slack, "pieces": pieces})
        if len(rows) >= 2000:
            yield pa.RecordBatch.from_pylist(rows, _BIN_ARROW)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _BIN_ARROW)


def pack(df: DataFrame, tokenizer_file: str, capacity: int = 4096, end_id: int = 1, slack: int = 16, fan_in: int = 8, root_items: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = []
        encoder = encoder_of(tokenizer_file)
        end = int(end_id).to_bytes(4, "little")
        for b in batches:
            ids = encode_texts(b.column("text").to_pylist(), encoder)
            for doc, raw in zip(b.column("doc_id").to_pylist(), ids, strict=True):
                raw += end
                for k, at in enumerate(range(0, len(raw) // 4, capacity)):
                    cut = raw[4 * at : 4 * (at + capacity)]
                    n = len(cut) // 4
                    items.append((n, [{"doc_id": doc, "piece": k, "start": at, "length": n, "ids_crc32": zlib.crc32(cut), "offset": 0}]))
        # workers outlive the stage, so what they remember goes with the task
        encoder.forget()
        trim()
        yield from _emit(items, capacity, slack, 0)

    def merge(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = [(f, p) for b in batches for f, p in zip(b.column("fill").to_pylist(), b.column("pieces").to_pylist(), strict=True)]
            yield from _emit(items, capacity, slack, level)

        return run

    bins = materialise(rows.mapInArrow(leaf, BIN), "bins0")
    finished = []
    parts, level = len(bins.inputFiles()), 0
    while parts > 1:
        finished.append(bins.where("done"))
        open_bins = bins.where("not done")
        n = open_bins.count()
        roots = max(1, -(-n // root_items))
        fewer = max(roots, -(-parts // fan_in))
        if fewer >= parts or not n:
            break
        level += 1
        parts = fewer
        bins = materialise(open_bins.coalesce(parts).mapInArrow(merge(level), BIN), f"bins{level}")
    else:
        finished.append(bins.where("done"))
    finished.append(bins.where("not done"))
    out = finished[0]
    for f in finished[1:]:
        out = out.unionByName(f)
    return out.select("sequence_id", F.explode("pieces").alias("p")).select("p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", "p.offset")
