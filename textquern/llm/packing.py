"""Packing: vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

Each partition streams its documents. What fills a whole sequence alone leaves at once; the rest
waits in a window of WINDOW pieces. A sequence is filled from the window by the dot-product
heuristic: of the pieces that fit in all three dimensions, the one whose demand has the largest dot
product with what is left (both in shares of the limits) goes in, until none fits; then the piece
with the largest product is cut to what is left. At the end of a partition what remains, less than a
sequence, is cut to powers of two, which need no padding. A sequence stays short only where the
limit on segments or loss-bearing tokens stops it.

No shuffle is needed, memory is bounded by the window, and a partition that is run again gives the
same sequences with the same ids (partition number and count), as its input does not change.

Edge cases: a null or empty text is a document with the end id alone; repeated rows are packed each;
a null doc_id stays null; documents of any length are cut; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquern.llm.common import KEPT, Memo, arrow_map, texts

#: Pieces that wait for a place, in each partition.
WINDOW = 256
#: Most remembered words and parts of words in each Python worker.
WORDS = 600_000
#: What only the tokenizer itself normalises and cuts as it should.
_RARE = re.compile("[\\x1c-\\x1f\\u0130-\\U0010ffff]")
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u012f", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: The tokenizer's pattern, for lower-case text below U+0130.
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")

#: How the vocabulary writes the bytes of UTF-8 that aren't plain characters; the space only parts the parts here.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _PLAIN) if b != 32}


@dataclass(frozen=True)
class Limits:
    """Most tokens, segments and loss-bearing tokens of a sequence."""

    tokens: int = 4096
    segments: int = 128
    loss: int = 4096


class WordTokenizer:
    """A tokenizer that drops white space and lowers case, with a memo of words and of their parts.

    Words (between white space), and the parts that the tokenizer's own pattern cuts them into, are
    encoded independently of each other, so their ids can be kept. Parts that are new are encoded in
    one call, whose ids are cut after each token that ends a part. That call goes to the same model
    without its normaliser and pattern, as parts are lowered and cut already.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            bare = json.load(f) | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.model = Tokenizer.from_str(json.dumps(bare))
        vocabulary = bare["model"]["vocab"]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.path, self.tokenizer = path, None
        self.memo = Memo(WORDS)

    def _whole(self, text: str) -> bytes:
        if self.tokenizer is None:  # few texts need the tokenizer itself, and it is large
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
            self.tokenizer.encode_special_tokens = True
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode(self, parts: list[str]) -> dict[str, bytes]:
        """The ids of new parts."""
        if not parts:
            return {}
        joined = " ".join(parts)
        if not (joined.isascii() and joined.isprintable()):
            joined = joined.encode("utf-8").decode("latin-1").translate(_BYTES)
        ids = np.array(self.model.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(parts):  # not how the vocabulary ends parts: one by one
            return {p: self._whole(p) for p in parts}
        packed, cuts = ids.tobytes(), (4 * cuts).tolist()
        return dict(zip(parts, map(packed.__getitem__, map(slice, [0, *cuts[:-1]], cuts))))

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of words that the newer generation of the memo doesn't have."""
        known, unknown = self.memo.recall(words)
        pieces = {w: [w] if w.isalpha() else _PARTS.findall(w) for w in unknown}
        here, late = self.memo.new, self.memo.old
        parts: dict[str, bytes | None] = {p: here.get(p) or late.get(p) for ps in pieces.values() for p in ps}
        fresh = self._encode(sorted(p for p, f in parts.items() if f is None))
        parts.update(fresh)
        fresh.update((w, b"".join([parts[p] for p in ps])) for w, ps in pieces.items())
        self.memo.keep({w: f for w, f in fresh.items() if len(w) <= 64})
        return known | fresh

    def packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if _RARE.search(text):
            return self._whole(text)
        # below U+0130 lower() goes letter by letter, nothing composes, and split() cuts at White_Space
        words = text.lower().split()
        found = list(map(self.memo.new.get, words))
        if None in found:
            fresh = self._learn({w for w, f in zip(words, found) if f is None})
            found = [f if f is not None else fresh[w] for w, f in zip(words, found)]
        return b"".join(found)


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


KEPT[__name__] = word_tokenizer.cache_clear


@dataclass
class Item:
    """A document's ids from `start` on, and the running count of its loss-bearing tokens (None: all bear loss)."""

    doc_id: int | None
    ids: np.ndarray
    loss: np.ndarray | None
    start: int = 0

    def demand(self) -> tuple[int, int]:
        n = len(self.ids) - self.start
        return n, n if self.loss is None else int(self.loss[-1] - self.loss[self.start])

    def fitting(self, tokens: int, loss: int) -> int:
        """The length of the longest piece from `start` within both limits."""
        n = min(tokens, len(self.ids) - self.start)
        if self.loss is None:
            return min(n, loss)
        return min(n, int(np.searchsorted(self.loss, self.loss[self.start] + loss, "right")) - 1 - self.start)


Piece = tuple[Item, int, int]


class Packer:
    """Fills sequences from a window of items; `add` and `finish` yield lists of (item, start, length)."""

    def __init__(self, limits: Limits, window: int = WINDOW):
        self.limits, self.window = limits, window
        self.items: list[Item | None] = [None] * window
        self.free = list(range(window - 1, -1, -1))
        # of each place of the window: demand for tokens, segments and loss-bearing tokens; none fits an empty one
        self.demands = np.full((window, 3), np.inf)
        self.worth = np.zeros((window, 3))
        self.scale = np.array([limits.tokens, limits.segments, limits.loss], float)

    def _put(self, i: int, item: Item | None) -> None:
        self.items[i] = item
        if item is None:
            self.free.append(i)
            self.demands[i], self.worth[i] = np.inf, 0.0
        else:
            n, loss = item.demand()
            self.demands[i] = (n, 1, loss)
            self.worth[i] = self.demands[i] / self.scale

    def add(self, item: Item) -> Iterator[list[Piece]]:
        top = self.limits
        while len(item.ids) - item.start >= top.tokens and item.fitting(top.tokens, top.loss) == top.tokens:
            yield [(item, item.start, top.tokens)]
            item.start += top.tokens
        if item.start < len(item.ids):
            self._put(self.free.pop(), item)
        while not self.free:
            yield self.fill(top.tokens)

    def finish(self) -> Iterator[list[Piece]]:
        while len(self.free) < self.window:
            total = int(sum(self.demands[i, 0] for i, x in enumerate(self.items) if x is not None))
            yield self.fill(self.limits.tokens if total >= self.limits.tokens else 1 << (total.bit_length() - 1))

    def fill(self, tokens: int) -> list[Piece]:
        left = np.array([tokens, self.limits.segments, self.limits.loss], float)
        placed: list[Piece] = []
        while left[0] > 0 and left[1] > 0 and len(self.free) < self.window:
            product = self.worth @ (left / self.scale)
            i = int(np.where((self.demands <= left).all(axis=1), product, -1.0).argmax())
            item = self.items[i]
            if item is not None and (self.demands[i] <= left).all():
                n = int(self.demands[i, 0])
            else:  # nothing fits whole: the piece of the largest product is cut
                i = int(product.argmax())
                item = self.items[i]
                n = item.fitting(int(left[0]), int(left[2]))
                if n <= 0:
                    break
            left -= (n, 1, self._take(i, n, placed))
        if not placed:  # no token may bear loss here: the piece goes alone, as no limit can hold it
            i = next(i for i, x in enumerate(self.items) if x is not None)
            self._take(i, min(tokens, len(self.items[i].ids) - self.items[i].start), placed)
        return placed

    def _take(self, i: int, n: int, placed: list[Piece]) -> float:
        """Place n tokens of item i; the loss-bearing tokens among them."""
        item, before = self.items[i], self.demands[i, 2]
        placed.append((item, item.start, n))
        item.start += n
        rest = item.start < len(item.ids)
        self._put(i, item if rest else None)
        return before - self.demands[i, 2] if rest else before


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def rows_of(number: int, pieces: Iterable[Piece]) -> Iterator[tuple]:
    """One row for each piece of a sequence, as SCHEMA has it."""
    offset = 0
    for item, start, n in pieces:
        loss = n if item.loss is None else int(item.loss[start + n] - item.loss[start])
        yield (item.doc_id, start, n, zlib.crc32(item.ids[start : start + n].tobytes()), len(item.ids), number, offset, loss)
        offset += n


def _pack(items: Iterable[Item], limits: Limits, first: int) -> Iterator[pa.RecordBatch]:
    packer, out, number = Packer(limits), [], first

    def sequences():
        for item in items:
            yield from packer.add(item)
        yield from packer.finish()

    for pieces in sequences():
        out += rows_of(number, pieces)
        number += 1
        if len(out) >= 4096:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [x.split()[0] for x in SCHEMA.split(", ")])


def _first() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 32


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, limits: Limits = Limits()) -> DataFrame:
    """Pieces of all documents; every token of a document bears loss."""

    def run(batches):
        tokenizer, end = word_tokenizer(path), np.array([end_id], "<u4").tobytes()

        def items():
            for b in batches:
                for i, t in zip(b.column("doc_id").to_pylist(), texts(b)):
                    yield Item(i, np.frombuffer(tokenizer.packed(t) + end, "<u4"), None)

        yield from _pack(items(), limits, _first())

    return arrow_map(docs.select("doc_id", "text"), run, SCHEMA)


def pack_conversations(turns: DataFrame, path: str, end_id: int = 2, limits: Limits = Limits(4096, 64, 3072), loss_role: str = "assistant") -> DataFrame:
    """Pieces of all conversations (conv_id, turn, role, text), given as doc_id; only turns of `loss_role` bear loss.

    The turns of one conversation meet in one task, as its sequence needs them in order.
    """
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))

    def run(batches):
        tokenizer, end = word_tokenizer(path), np.array([end_id], "<u4").tobytes()

        def items():
            for b in batches:
                for i, ts in zip(b.column("conv_id").to_pylist(), b.column("turns").to_pylist()):
                    ids = [np.frombuffer(tokenizer.packed(t["text"]) + end, "<u4") for t in ts]
                    bears = np.concatenate([np.full(len(x), t["role"] == loss_role) for x, t in zip(ids, ts)])
                    yield Item(i, np.concatenate(ids), np.concatenate([[0], np.cumsum(bears)]))

        yield from _pack(items(), limits, _first())

    return arrow_map(rows, run, SCHEMA)
