"""License scans by ordered signature rules.

A text becomes its lower-case words with one space between them. A keyword prefilter, the words of a
text met with the gates of all rules, says which of the hand-written patterns in `license_rules` run
at all. Overlapping detections are resolved by priority and containment: a detection that overlaps
one that stays with a higher priority goes; of one priority, a detection whose interval lies inside
another's goes, and of the same interval the first rule stays. This is one sweep for each priority
over disjoint intervals, so a text takes time in proportion (but for a sort), however long its chains
of overlaps are.

Base phrases are found beside the rules, whatever these say, at all their places.

The score is the largest priority of what stays, as a share of 100 (base phrases count as 90).

Edge cases: a null text counts as empty: no words, no places (first and last word null), empty
labels, score 0; repeated rows are scanned each; texts of any length are scanned whole; other
columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from textquern.llm.common import LETTERS, arrow_map, texts
from textquern.llm.license_rules import parse

BASE = {b" under the mit license ": "mit", b" apache license version 2 ": "apache-2", b" cc by nc ": "cc-by-nc"}
_GATES = frozenset({b"mit", b"apache", b"nc"})  # a word of each base phrase

Detection = tuple[int, int, int, int, str]  # start word, end word, priority, rule, label


class Scanner:
    def __init__(self, rules=None):
        self.by_gate: dict[bytes, list[tuple[int, str, int, re.Pattern]]] = {}
        for n, (label, priority, gate, pattern) in enumerate(rules if rules is not None else parse()):
            rule = (n, label, priority, re.compile(f" (?:{pattern})(?= )".encode()))
            for word in gate.split("|"):
                self.by_gate.setdefault(word.encode(), []).append(rule)
        self.gates = frozenset(self.by_gate) | _GATES

    def detections(self, norm: bytes, present: frozenset[bytes]) -> list[Detection]:
        """Everything that the rules find, resolved, by place."""
        found: list[Detection] = []
        for gate in present:
            for n, label, priority, pattern in self.by_gate.get(gate, ()):
                at = words = 0
                for m in pattern.finditer(norm):
                    words += norm.count(b" ", at, m.start())
                    at = m.start()
                    found.append((words, words + norm.count(b" ", m.start(), m.end()), priority, n, label))
        return resolve(found)

    def scan(self, text: str) -> tuple[int, list[tuple[int, str]], list[Detection]]:
        """The number of words, the base places (word, label) and the detections of a text."""
        words = text.encode("utf-8", "surrogatepass").translate(LETTERS).split()
        present = self.gates.intersection(words)
        if not present:
            return len(words), [], []
        norm = b" " + b" ".join(words) + b" "
        base = []
        for phrase, label in BASE.items():
            at, last, place = norm.find(phrase), 0, 0
            while at >= 0:
                place += norm.count(b" ", last, at)
                base.append((place, label))
                last, at = at, norm.find(phrase, at + 1)
        return len(words), base, self.detections(norm, present)


def resolve(found: list[Detection]) -> list[Detection]:
    """Suppression by priority and containment; what stays, in order."""
    by_priority: dict[int, list[Detection]] = {}
    for d in set(found):
        by_priority.setdefault(d[2], []).append(d)
    out: list[Detection] = []
    starts: list[int] = []  # what higher priorities cover, as disjoint intervals in order
    ends: list[int] = []
    for priority in sorted(by_priority, reverse=True):
        kept, reach = [], -1
        for d in sorted(by_priority[priority], key=lambda d: (d[0], -d[1], d[3])):
            i = bisect_left(starts, d[1])
            if d[1] > reach and not (i and ends[i - 1] > d[0]):
                kept.append(d)
                reach = d[1]
        out += kept
        covered: list[list[int]] = []
        for s, e in sorted([*zip(starts, ends), *((d[0], d[1]) for d in kept)]):
            if covered and s <= covered[-1][1]:
                covered[-1][1] = max(covered[-1][1], e)
            else:
                covered.append([s, e])
        starts, ends = [s for s, _ in covered], [e for _, e in covered]
    return sorted(out)


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, label, start_word, end_word, priority): all detections that stay."""

    def run(batches):
        for b in batches:
            rows = [(i, d[4], d[0], d[1], d[2]) for i, t in zip(b.column("doc_id").to_pylist(), texts(b)) for d in scanner().scan(t)[2]]
            cols = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "label", "start_word", "end_word", "priority"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, label string, start_word long, end_word long, priority int")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            for i, t in zip(b.column("doc_id").to_pylist(), texts(b)):
                n, base, rest = scanner().scan(t)
                places, names = [w for w, _ in base], {x for _, x in base}
                row = (i, n, len(base), min(places, default=None), max(places, default=None), ",".join(sorted(names)), ",".join(sorted(names | {d[4] for d in rest})), max([*(d[2] for d in rest), 90 if base else 0]) / 100)
                for c, v in zip(cols, row):
                    c.append(v)
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
