"""Benchmark decontamination by pigeonhole edit matching.

The unit is the whole test item, of any length. An item with an error budget of k edits is split
into k + 1 pieces. Whatever lies within k edits of it holds at least one piece unchanged, so an
automaton over all pieces finds every candidate; Myers' bit-parallel distance then verifies the text
around the hits. Verification climbs: pieces are halved down from the item, a run of j pieces may
have j - 1 edits, and one of its halves stays within its own budget, so most hits end after the
piece's neighbour. Items and texts are lower-cased words between single spaces, with a space at both
ends, so an item without a budget occurs only between word ends.

Parts of items are a question of their own and have a column of their own: of an item of more than
``PASSAGE_WORDS`` words, any run of that many words counts as a passage, wherever it starts, within
the budget of its own length. The passages of an item share their pieces: the item is cut into
pieces short enough that each passage holds k + 2 whole ones, of which two stay unchanged, shifted by
no more than k against each other. Every passage around a piece holds the words before or after it
to about half a passage, so these halves are verified first and passages only if one is there.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean

#: Edits allowed for each character of an item or passage.
ERROR_RATE = 0.08
#: Words of a passage, the least run of an item that is found.
PASSAGE_WORDS = 24
#: Characters of test items that are searched for in one pass over the documents. Larger test sets
#: are searched for in as many passes as they need.
PASS_CHARS = 4_000_000

_words = re.compile(r"\w+").findall


def normal(text: str | None) -> str:
    """Lower-cased words, one space between them."""
    return " ".join(_words(text.lower())) if text else ""


def padded(text: str | None) -> str:
    """The normal form between spaces, or nothing."""
    line = normal(text)
    return f" {line} " if line else ""


def budget(line: str) -> int:
    """Edits allowed for a normal form; spaces around it don't count."""
    return int(len(line.strip()) * ERROR_RATE)


def split_evenly(line: str, parts: int) -> list[tuple[int, str]]:
    n = len(line)
    edges = [n * j // parts for j in range(parts + 1)]
    return [(a, line[a:b]) for a, b in zip(edges, edges[1:])]


@dataclass
class Passage:
    item: int
    text: str
    errors: int
    masks: dict[str, int]

    @classmethod
    def of(cls, item: int, text: str, errors: int | None = None) -> Passage:
        masks: dict[str, int] = defaultdict(int)
        for i, c in enumerate(text):
            masks[c] |= 1 << i
        return cls(item, text, budget(text) if errors is None else errors, dict(masks))

    def distance(self, window: str) -> int:
        """Least edit distance of the passage to any part of the window (Myers' bit vectors)."""
        m = len(self.text)
        full, top = (1 << m) - 1, 1 << (m - 1)
        up, down, score = full, 0, m
        best, mask = m, self.masks.get
        for c in window:
            eq = mask(c, 0)
            vertical = eq | down
            horizontal = (((eq & up) + up) ^ up) | eq
            plus = down | (full & ~(horizontal | up))
            minus = up & horizontal
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
                if score < best:
                    best = score
            plus <<= 1
            up = ((minus << 1) | ~(vertical | plus)) & full
            down = plus & vertical & full
        return best


class WholeItem:
    """An item as one unit, with its pieces and the runs of pieces that verification climbs."""

    def __init__(self, item: int, line: str):
        self.item, self.line, self.errors = item, line, budget(line)
        self.pieces = split_evenly(line, self.errors + 1)
        self.edges = [*(a for a, _ in self.pieces), len(line)]
        self.runs: dict[tuple[int, int], Passage] = {}

    def run(self, lo: int, hi: int) -> Passage:
        if (lo, hi) not in self.runs:
            self.runs[lo, hi] = Passage.of(self.item, self.line[self.edges[lo] : self.edges[hi]], hi - lo - 1)
        return self.runs[lo, hi]

    def path(self, piece: int) -> list[tuple[int, int]]:
        """Runs of pieces around one, from two or three pieces up to just below the item."""
        lo, hi, found = 0, len(self.pieces), []
        while hi - lo > 1:
            found.append((lo, hi))
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if piece < mid else (mid, hi)
        return found[:0:-1]

    def distance(self, line: str, hits: list[tuple[int, int]]) -> int:
        """Least distance of the item to a part of the text, if within the budget; hits are (piece,
        place where the item would begin)."""
        alive = set()
        for piece, begin in hits:
            if begin in alive:
                continue
            for lo, hi in self.path(piece):
                part, at = self.run(lo, hi), begin + self.edges[lo]
                if part.distance(line[max(0, at - part.errors) : max(0, at + len(part.text) + part.errors)]) > part.errors:
                    break
            else:
                alive.add(begin)
        return Matcher._verify(self.run(0, len(self.pieces)), line, sorted(alive)) if alive else self.errors + 1


class LongItem:
    """An item of more than PASSAGE_WORDS words: its line, pieces and passages, built when needed."""

    def __init__(self, item: int, line: str):
        self.item, self.line = item, line
        words = line.split(" ")
        self.begins = [0, *accumulate(len(w) + 1 for w in words[:-1])]
        self.ends = [b + len(w) for b, w in zip(self.begins, words)]
        sizes = [e - b for b, e in zip(self.begins, self.ends[PASSAGE_WORDS - 1 :])]
        budgets = [int(n * ERROR_RATE) for n in sizes]
        self.most = max(budgets)
        self.longest = max(sizes)
        # A passage of n characters holds at least (n - size + 1) // size whole pieces: k + 2 here.
        self.size = min((n + 1) // (k + 3) for n, k in zip(sizes, budgets))

    def pieces(self) -> list[tuple[int, str]]:
        return [(at, self.line[at : at + self.size]) for at in range(0, len(self.line) - self.size + 1, self.size)]

    def around(self, at: int) -> list[tuple[int, str]]:
        """The halves beside a piece, of which each passage with the piece holds one: place, text."""
        first, last = bisect_right(self.begins, at) - 1, bisect_right(self.begins, at + self.size - 1) - 1
        half = (PASSAGE_WORDS - (last - first)) // 2
        found = []
        if first >= half:
            found.append((self.begins[first - half], self.line[self.begins[first - half] : self.ends[last]]))
        if last + half < len(self.ends):
            found.append((self.begins[first], self.line[self.begins[first] : self.ends[last + half]]))
        return found

    def paired(self, hits: dict[int, set[int]]) -> dict[int, set[int]]:
        """The hits that have one of another piece beside them, near enough for a common passage."""
        found: dict[int, set[int]] = defaultdict(set)
        if len(hits) < 2:
            return found
        listed = sorted((b, at) for at, begins in hits.items() for b in begins)
        reach = self.longest - self.size
        for i, (begin, at) in enumerate(listed):
            for step in (1, -1):
                j = i + step
                while 0 <= j < len(listed) and abs(listed[j][0] - begin) <= self.most:
                    if listed[j][1] != at and abs(listed[j][1] - at) <= reach:
                        found[at].add(begin)
                        break
                    j += step
        return found

    def matched(self, line: str, hits: dict[int, set[int]]) -> list[int]:
        """Least distances of the passages that a text holds; ``hits`` are, by piece, the places
        where the item would begin."""
        live = {}
        for at, begins in self.paired(hits).items():
            for place, text in self.around(at):
                half = Passage.of(self.item, text, self.most)
                if Matcher._verify(half, line, sorted(b + place for b in begins)) <= self.most:
                    live[at] = begins
                    break
        found = []
        for begin, end in zip(self.begins, self.ends[PASSAGE_WORDS - 1 :]) if live else ():
            places = {b + begin for at, begins in live.items() if begin <= at and at + self.size <= end for b in begins}
            if places:
                p = Passage.of(self.item, self.line[begin:end])
                best = Matcher._verify(p, line, sorted(places))
                if best <= p.errors:
                    found.append(best)
        return found


class Matcher:
    """Finds the test items of one pass in texts."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [i for i, _ in items]
        self.whole, self.long = [], {}
        places: dict[str, list[tuple[int, int, int]]] = defaultdict(list)
        for k, (_, text) in enumerate(items):
            line = padded(text)
            self.whole.append(WholeItem(k, line))
            for j, (at, piece) in enumerate(self.whole[k].pieces if line else ()):
                places[piece].append((k, j, at))
            if line.count(" ") > PASSAGE_WORDS + 1:
                # Passages have numbers below zero among the places of pieces.
                self.long[-1 - k] = LongItem(k, line[1:-1])
                for at, piece in self.long[-1 - k].pieces():
                    places[piece].append((-1 - k, 0, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> dict[int, tuple[int | None, int]]:
        """item -> (distance of the whole item, None beyond its budget; passages found), for the items
        of which a text holds the whole or a passage. An item that has no more words than a passage
        is its own passage."""
        line = padded(text)
        found: dict[int, tuple[int | None, int]] = {}
        if not len(self.automaton) or not line:
            return found
        starts: dict[int, set[tuple[int, int]]] = defaultdict(set)
        begins: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for end, (size, where) in self.automaton.iter(line):
            for k, j, at in where:
                if k < 0:
                    begins[k][at].add(end + 1 - size - at)
                else:
                    starts[k].add((j, end + 1 - size - at))
        for k, hits in starts.items():
            best = self.whole[k].distance(line, sorted(hits))
            if best <= self.whole[k].errors:
                found[k] = (best, 0 if -1 - k in self.long else 1)
        for k, hits in begins.items():
            if distances := self.long[k].matched(line, hits):
                found[-1 - k] = (found.get(-1 - k, (None, 0))[0], len(distances))
        return found

    @staticmethod
    def _verify(p: Passage, line: str, hits: list[int]) -> int:
        best, k, reach = p.errors + 1, p.errors, len(p.text) + p.errors
        at, end = hits[0] - k, hits[0] + reach
        for s in [*hits[1:], None]:
            if s is not None and s - k <= end:
                end = s + reach
                continue
            best = min(best, p.distance(line[max(0, at) : max(0, end)]))
            if s is None or best == 0:
                break
            at, end = s - k, s + reach
        return best


def _passes(benchmark: DataFrame) -> list[DataFrame]:
    """The test items, split by hash into passes of about PASS_CHARS characters."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + size // PASS_CHARS
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


#: A worker keeps the matcher of the last pass it worked on.
_kept: dict[str, Matcher] = {}


def _matcher(name: str, items: list[tuple[int, str]]) -> Matcher:
    if name not in _kept:
        _kept.clear()
        _kept[name] = Matcher(items)
    return _kept[name]


def _sent(part: DataFrame) -> tuple[str, Broadcast]:
    """A name for a pass's items, and the items as broadcast: about PASS_CHARS characters, or one
    longer item, which a task must hold whole."""
    return uuid.uuid4().hex, part.sparkSession.sparkContext.broadcast(sorted(((r.item_id, r.text) for r in part.collect()), key=lambda i: (i[1], i[0] is None, i[0] or 0)))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, whole, distance, passages): the test items that whole texts contain.

    ``whole``: the whole item occurs within its error budget, at ``distance`` edits at least (null if
    not). ``passages``: how many runs of ``PASSAGE_WORDS`` words of the item occur, each within its
    own budget; an item of no more words is its own only passage. There is a row if either is so.
    Null texts are skipped, as are items without words; an item without an id is searched for like
    any other and has a null item_id; repeated documents give repeated rows, repeated items one row for each. Other columns are ignored. Nothing contained, or
    an empty table: no rows.
    """
    found = None
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    for part in _passes(benchmark):
        name, shared = _sent(part)

        def run(batches: Iterator[pa.RecordBatch], name=name, shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(name, shared.value)
            for batch in batches:
                rows = [
                    (d.as_py(), matcher.items[k], best is not None, best, n)
                    for d, t in zip(batch.column(0), batch.column(1))
                    for k, (best, n) in sorted(matcher.find(t.as_py()).items())
                ]
                columns = zip(*rows) if rows else ((), (), (), (), ())
                kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["doc_id", "item_id", "whole", "distance", "passages"])

        hits = texts.mapInArrow(lean(run), "doc_id long, item_id long, whole boolean, distance int, passages int")
        found = hits if found is None else found.unionByName(hits)
    return found


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no test item and no passage of one, with all their columns.

    Null and empty texts stay. Only the items' texts matter: one without an id counts like any other,
    one without a text not at all.
    """
    place = docs.columns.index("text")
    for part in _passes(benchmark):
        name, shared = _sent(part)

        def run(batches: Iterator[pa.RecordBatch], name=name, shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(name, shared.value)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.find(t.as_py()) for t in batch.column(place)], pa.bool_()))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs
