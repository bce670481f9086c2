"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decode.

Encoding. A sequence of tokens is the BPE encoding of its bytes exactly when every two neighbours
are the encoding of theirs, so the merges compile into a nondeterministic transducer: a state is
(the last whole token, a node of the trie of all tokens), a byte moves along the trie, and at a node
that is a token the token may end if it may follow the last one. This is determinised while texts
are read: a subset state holds the live branches with the tokens that each would still emit, the
prefix that all branches share is emitted, and the steps are remembered by (state, byte). A branch
dies when its trie path ends, so tokens leave after a lookahead of at most the longest token. The
steps and the encodings of whole pieces that were seen are remembered up to fixed numbers of
entries (steps are forgotten together, pieces by generations): memory is bounded whatever the texts.

Decoding. Ids become bytes by a table. `Utf8Machine` is a state machine that takes bytes in any
chunks, hands out all whole characters and keeps the at most three bytes of an unfinished one.

Edge cases: a null text counts as empty, which has no tokens and the digests of no bytes; lone
surrogates can't occur in Spark strings; a piece of any length takes time in proportion; repeated
rows are encoded each; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from textquern.llm.common import Memo, arrow_map, texts

#: Most remembered steps of the transducer and most remembered pieces, in each Python worker.
STEPS = 400_000
PIECES = 400_000
#: What the white-space class of the splitting pattern holds (Unicode White_Space).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters and numbers below U+0130, and what is beyond: texts without that are split by Python's own expressions.
_LETTERS, _NUMBERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u012f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_BEYOND = re.compile("[\u0130-\U0010ffff]")


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """The encoder of single pieces (bytes between the cuts of the splitting pattern)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int | None] = [None]
        self.bytes_of: dict[int, bytes] = {}
        for data, rank in ranks.items():
            self.bytes_of[rank] = data
            node = 0
            for b in data:
                step = self.children[node].get(b)
                if step is None:
                    step = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token.append(None)
                node = step
            self.token[node] = rank
        self.spines: dict[tuple[int, bool], list[tuple[bytes, float]]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self._forget()

    def _forget(self) -> None:
        # a branch: (last token or -1, trie node, tokens not yet emitted); a state: a tuple of branches
        start = ((-1, 0, ()),)
        self.numbers = {start: 0}
        self.states = [start]
        self.steps: list[dict[int, tuple[tuple[int, ...], int]]] = [{}]
        self.known = 0

    def _halves(self, data: bytes) -> tuple[bytes, bytes] | None:
        """The two parts whose merge makes the token; None for a byte and for what no merge makes."""
        top, parts = self.ranks[data], [bytes([b]) for b in data]
        while len(parts) > 2:
            best, at = top, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], top)
                if r < best:
                    best, at = r, i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _spine(self, token: int, right: bool) -> list[tuple[bytes, float]]:
        """The parts at the token's right (left) end while it grows, largest first, each with the rank of the merge that uses it up."""
        found = self.spines.get((token, right))
        if found is None:
            found, data, until = [], self.bytes_of[token], float("inf")
            while True:
                found.append((data, until))
                halves = self._halves(data)
                if halves is None:
                    break
                until, data = self.ranks[data], halves[1 if right else 0]
            if len(data) > 1:  # no merges make it: it never stands beside another token
                found = []
            self.spines[token, right] = found
        return found

    def follows(self, a: int, b: int) -> bool:
        """Whether the encoding of the two tokens' bytes is just the two: no merge crosses their border."""
        found = self.fits.get((a, b))
        if found is None:
            left, right = self._spine(a, True), self._spine(b, False)
            found = bool(left and right)
            for x, x_until in left:
                for y, y_until in right:
                    r = self.ranks.get(x + y)
                    if r is not None and r < x_until and r <= y_until:
                        found = False
            if len(self.fits) >= STEPS:
                self.fits.clear()
            self.fits[a, b] = found
        return found

    def _step(self, state: int, byte: int) -> tuple[tuple[int, ...], int]:
        out: list[tuple[int, int, tuple[int, ...]]] = []
        for last, node, due in self.states[state]:
            child = self.children[node].get(byte)
            if child is None:
                continue
            if self.children[child]:
                out.append((last, child, due))
            token = self.token[child]
            if token is not None and (last < 0 or self.follows(last, token)):
                out.append((token, 0, (*due, token)))
        n = 0
        if out:
            shortest = min((d for _, _, d in out), key=len)
            while n < len(shortest) and all(d[n] == shortest[n] for _, _, d in out):
                n += 1
        branches = tuple((last, node, due[n:]) for last, node, due in out)
        number = self.numbers.get(branches)
        if number is None:
            number = self.numbers[branches] = len(self.states)
            self.states.append(branches)
            self.steps.append({})
        self.steps[state][byte] = found = (out[0][2][:n] if n else (), number)
        self.known += 1
        return found

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if self.known > STEPS:
            self._forget()
        ids: list[int] = []
        state, steps = 0, self.steps
        for byte in piece:
            found = steps[state].get(byte)
            if found is None:
                found = self._step(state, byte)
                if self.known > 2 * STEPS:  # a very long piece: keep only the state that it is in
                    branches = self.states[found[1]]
                    self._forget()
                    steps = self.steps
                    self.numbers[branches] = len(self.states)
                    self.states.append(branches)
                    steps.append({})
                    found = (found[0], len(self.states) - 1)
            if found[0]:
                ids += found[0]
            state = found[1]
        for _, node, due in self.states[state]:
            if node == 0:
                return ids + list(due)
        if not piece:
            return ids
        raise ValueError("the vocabulary can't encode every byte")


class Codec:
    """Encoding and decoding of whole texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.split = regex.compile(pattern.replace(r"[^\s\p{L}", f"[^{SPACE}\\p{{L}}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{SPACE}{_LETTERS}{_NUMBERS}]").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
        plain = plain.replace(r"\p{L}", f"[{_LETTERS}]").replace(r"\p{N}", f"[{_NUMBERS}]")
        self.plain = None if "\\p" in plain or "[[" in plain else re.compile(plain)
        self.table = np.empty(max(ranks.values(), default=-1) + 1, object)
        for data, rank in ranks.items():
            self.table[rank] = data
        self.memo = Memo(PIECES)

    def _pieces(self, text: str) -> list[str]:
        return (self.split if self.plain is None or _BEYOND.search(text) else self.plain).findall(text)

    def _one(self, piece: str) -> bytes:
        ids = self.transducer.encode(piece.encode("utf-8", "surrogatepass"))
        return pack(f"<{len(ids)}I", *ids)

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        pieces = self._pieces(text)
        found = list(map(self.memo.new.get, pieces))
        if None in found:
            known, unknown = self.memo.recall({p for p, f in zip(pieces, found) if f is None})
            fresh = {p: self._one(p) for p in unknown}
            self.memo.keep({p: f for p, f in fresh.items() if len(p) <= 64})
            known |= fresh
            found = [f if f is not None else known[p] for p, f in zip(pieces, found)]
        return b"".join(found)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode_bytes(self, ids) -> bytes:
        return b"".join(self.table[np.asarray(ids, np.int64)].tolist())

    def stream(self, chunks, final: bool = True):
        """Texts of whole characters for chunks of ids."""
        machine = Utf8Machine()
        for ids in chunks:
            yield machine.feed(self.decode_bytes(ids))
        if final:
            yield machine.end()


# ---- UTF-8 as a state machine: states are what must follow; any byte outside the range of a state is an error
_NEEDS = {  # state: (lowest, highest next byte, next state)
    1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0xA0, 0xBF, 1), 4: (0x80, 0x9F, 1), 5: (0x80, 0xBF, 2), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2),
}
_LEAD = {**{b: 0 for b in range(0x80)}, **{b: 1 for b in range(0xC2, 0xE0)}, **{b: 2 for b in range(0xE1, 0xF0)}, 0xE0: 3, 0xED: 4, **{b: 5 for b in range(0xF1, 0xF4)}, 0xF0: 6, 0xF4: 7}


class Utf8Machine:
    """Incremental UTF-8: takes bytes in any cuts; malformed bytes come out as U+FFFD."""

    def __init__(self):
        self.rest = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """The number of bytes at the end that begin a character without ending it."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead < 0x80:
                return 0
            if lead >= 0xC0:
                state = _LEAD.get(lead, 0)
                for b in data[len(data) - back + 1 :]:
                    if state == 0 or not _NEEDS[state][0] <= b <= _NEEDS[state][1]:
                        return 0
                    state = _NEEDS[state][2]
                return back if state else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.rest + data
        n = self.unfinished(data)
        self.rest = data[len(data) - n :]
        return data[: len(data) - n].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.rest = self.rest, b""
        return rest.decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One codec in each worker; a lost worker builds its own anew."""
    return Codec(read_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the token ids of every whole text."""

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            for text, i in zip(texts(b), b.column("doc_id").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([c.encode(text)], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, ids array<long>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            out = ["".join(c.stream([i or []])) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return arrow_map(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes, then decodes the ids in chunks."""

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            n_tokens, ids_sha, text_sha = [], [], []
            for text in texts(b):
                packed = c.encode_packed(text)
                ids, digest = np.frombuffer(packed, "<u4"), hashlib.sha256()
                for part in c.stream(ids[i : i + 65536] for i in range(0, len(ids), 65536)):
                    digest.update(part.encode("utf-8"))
                n_tokens.append(len(ids))
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
