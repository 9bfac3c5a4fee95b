"""Text quality from overlapping heuristic labellers.

Each labeller votes good, bad or nothing on a whole text. Expectation-maximisation over the vote
patterns of all documents estimates every labeller's accuracy without any gold label; the posterior
of a pattern labels the documents that show it. These labels train a linear scorer over hashed
features, which then scores every document, also those on which no labeller votes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_sample, lean

GOOD, BAD, NONE = 1, 0, 2
BUCKETS = 1 << 15
#: Bound of the scorer's training sample: documents that come to the driver.
SAMPLE = 4000
#: Words remembered by a worker; the memory is emptied when full.
REMEMBERED = 150_000
#: Weight of the labellers' prior against all documents.
PRIOR = 0.002

_SYMBOLS = "#$%&*|<>{}[]\\^~=_@+"
_END = (".", "!", "?", ":", '"', "'", ")", "。", "…")
_AROUND = ".,;:!?\"'()-"
_digits = regex.compile(r"\p{N}+")
_lower = regex.compile(r"\p{Ll}+")
_upper = regex.compile(r"\p{Lu}+")


@dataclass
class Facts:
    """What the labellers look at."""

    words: list[str]
    symbols: float
    capitals: float
    distinct: float
    twice: float
    closed: float
    length: float
    plain: float
    marked: float


def _marks(word: str) -> bool:
    """Whether a word ends in a doubled mark."""
    return len(word) > 1 and word[-1] == word[-2] and not word[-1].isalnum()


def facts(text: str | None) -> Facts:
    text = text or ""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    return Facts(
        words,
        sum(map(text.count, _SYMBOLS)) / chars,
        sum(map(str.isupper, words)) / n,
        len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        sum(x.rstrip().endswith(_END) for x in lines) / max(1, len(lines)),
        sum(map(len, words)) / n,
        sum(w.strip(_AROUND).isalpha() for w in words) / n,
        sum(map(_marks, words)) / n,
    )


def _vote(value: float, good: bool, bad: bool) -> int:
    return BAD if bad else GOOD if good else NONE


#: name -> vote on a text's facts. The bounds are parameters of the labellers.
LABELLERS = {
    "few_symbols": lambda f: _vote(f.symbols, f.symbols < 0.01, f.symbols > 0.06),
    "few_capitals": lambda f: _vote(f.capitals, f.capitals < 0.1, f.capitals > 0.35),
    "varied_words": lambda f: NONE if len(f.words) < 30 else _vote(f.distinct, f.distinct > 0.4, f.distinct < 0.2),
    "plain_words": lambda f: NONE if len(f.words) < 5 else _vote(f.plain, f.plain > 0.85, f.plain < 0.6),
    "few_marks": lambda f: NONE if len(f.words) < 5 else _vote(f.marked, f.marked < 0.05, f.marked > 0.25),
    "no_stutter": lambda f: NONE if len(f.words) < 10 else _vote(f.twice, f.twice < 0.05, f.twice > 0.25),
    "closed_lines": lambda f: _vote(f.closed, f.closed > 0.6, f.closed < 0.15),
    "enough_words": lambda f: _vote(len(f.words), len(f.words) >= 40, len(f.words) < 4),
    "word_length": lambda f: NONE if not f.words else _vote(f.length, 3.0 <= f.length <= 9.5, f.length > 14 or f.length < 2),
}


def votes(f: Facts) -> list[int]:
    return [labeller(f) for labeller in LABELLERS.values()]


@dataclass
class LabelModel:
    """Share of good texts, and each labeller's chance of voting bad, if it votes, on bad and good ones.

    Staying silent says nothing about a text.
    """

    good: float
    bad_vote: np.ndarray  # (labellers, 2 classes)

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        """Chance that a text with these votes is good; patterns are rows."""
        against = np.log(self.bad_vote[:, BAD] / self.bad_vote[:, GOOD])
        instead = np.log((1 - self.bad_vote[:, BAD]) / (1 - self.bad_vote[:, GOOD]))
        odds = (pattern == BAD) @ against + (pattern == GOOD) @ instead
        return 1 / (1 + np.exp(np.clip(odds + math.log((1 - self.good) / self.good), -60, 60)))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300) -> LabelModel:
    """Fits the label model to vote patterns and how many documents show them.

    It starts from labellers that seldom blame a good text and see a part of the bad ones; a prior
    worth PRIOR of all documents keeps a labeller from changing sides.
    """
    start = np.tile([0.4, 0.02], (patterns.shape[1], 1))
    model, total = LabelModel(0.85, start), counts.sum()
    for _ in range(rounds):
        good = model.posterior(patterns)
        weight = np.stack([(1 - good) * counts, good * counts])
        bad = np.einsum("cp,pl->lc", weight, patterns == BAD)
        cast = np.einsum("cp,pl->lc", weight, patterns != NONE)
        new = LabelModel(float(np.clip(weight[1].sum() / total, 1e-3, 1 - 1e-3)), (bad + PRIOR * total * start) / (cast + PRIOR * total))
        done = np.abs(new.bad_vote - model.bad_vote).max() < 1e-9
        model = new
        if done:
            break
    return model


def _shape(word: str) -> str:
    return _upper.sub("A", _lower.sub("a", _digits.sub("0", word)))


def word_features(word: str) -> tuple[int, int]:
    """Hashed features of a word: its ending's characters and its shape."""
    shape = _shape(word)
    return crc32(f"s{shape}".encode("utf-8", "replace")) % BUCKETS, crc32(f"e{shape[0]}{word[-1]}{word[-3:]}".encode("utf-8", "replace")) % BUCKETS


def text_features(f: Facts) -> list[int]:
    """Hashed features of a whole text: its facts in steps."""
    steps = {
        "symbols": min(9, int(f.symbols * 50)),
        "capitals": min(9, int(f.capitals * 10)),
        "distinct": min(9, int(f.distinct * 10)),
        "twice": min(9, int(f.twice * 20)),
        "closed": int(f.closed * 4),
        "plain": int(f.plain * 10),
        "marked": int(f.marked * 10),
        "size": min(9, int(math.log2(len(f.words) + 1))),
        "length": min(20, int(f.length)),
    }
    return [crc32(f"{k}{v}".encode()) % BUCKETS for k, v in steps.items()]


def vector(f: Facts) -> Counter:
    """Features of a text: its words' features by their share, and its own at one each."""
    found: Counter = Counter()
    for w, n in Counter(f.words).items():
        for k in word_features(w):
            found[k] += n / len(f.words)
    for k in text_features(f):
        found[k] += 1.0
    return found


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float


def train(rows: list[Counter], targets: np.ndarray, epochs: int = 150, rate: float = 0.2, decay: float = 1e-3) -> Scorer:
    """Logistic regression on soft labels, full-batch Adam."""
    ids = np.fromiter((k for r in rows for k in r), np.int64)
    values = np.fromiter((v for r in rows for v in r.values()), np.float64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, bias = np.zeros(BUCKETS), 0.0
    m, v = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for step in range(1, epochs + 1):
        odds = np.bincount(owner, w[ids] * values, len(rows)) + bias
        error = (1 / (1 + np.exp(-np.clip(odds, -60, 60))) - targets) / len(rows)
        g = np.append(np.bincount(ids, error[owner] * values, BUCKETS) + decay * w / len(rows), error.sum())
        m += 0.1 * (g - m)
        v += 0.02 * (g * g - v)
        move = rate * (1 - step / (epochs + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-6)
        w -= move[:-1]
        bias -= move[-1]
    return Scorer(w, float(bias))


class _Memory(dict):
    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        self[word] = found = float(sum(self.weights[k] for k in word_features(word)))
        return found


def scoring(scorer: Scorer):
    """A function from facts to the chance that a text is good."""
    memory = _Memory(scorer.weights)

    def score(f: Facts) -> float:
        if len(memory) > REMEMBERED:
            memory.clear()
        odds = scorer.bias + sum(scorer.weights[k] for k in text_features(f))
        if f.words:
            odds += sum(map(memory.__getitem__, f.words)) / len(f.words)
        return 1 / (1 + math.exp(-min(max(float(odds), -60.0), 60.0)))

    return score


def vote_table(docs: DataFrame) -> DataFrame:
    """(doc_id, pattern): the votes of all labellers on each whole text, as a string of digits.

    Null and empty texts are voted on like any other (no words, no lines).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = ["".join(map(str, votes(facts(t.as_py())))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "pattern"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, pattern string")


def fit(docs: DataFrame) -> tuple[LabelModel, Scorer] | None:
    """Label model from the votes on all documents, scorer from a sample of at most SAMPLE of them
    (those whose texts have the smallest hash; ids play no part). None for an empty table.

    At most 3 ** labellers patterns come to the driver.
    """
    counted = [(r.pattern, r["count"]) for r in vote_table(docs).groupBy("pattern").count().collect()]
    if not counted:
        return None
    counted.sort()
    patterns = np.array([[int(c) for c in p] for p, _ in counted])
    model = expectation_maximisation(patterns, np.array([n for _, n in counted], float))
    keyed = docs.select(F.lit(0).alias("one"), F.coalesce("text", F.lit("")).alias("text"))
    sample = bounded_sample(keyed, "one", {0: sum(n for _, n in counted)}, SAMPLE)
    seen = [facts(t) for t in sorted(r.text for r in sample.collect())]
    targets = model.posterior(np.array([votes(f) for f in seen]))
    return model, train([vector(f) for f in seen], targets)


def score_quality(docs: DataFrame, fitted: tuple[LabelModel, Scorer] | None) -> DataFrame:
    """(doc_id, pattern, posterior, score, keep) of every row's whole text.

    ``posterior`` is the label model's, ``score`` the hashed scorer's chance that the text is good,
    ``keep`` 1 from a score of 0.5 on. Null texts count as empty. Repeated rows stay, other columns
    are ignored, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    schema = "doc_id long, pattern string, posterior double, score double, keep int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.value is None:
            return
        model, scorer = shared.value
        score = scoring(scorer)
        for batch in batches:
            seen = [facts(t.as_py()) for t in batch.column(1)]
            if not seen:
                continue
            cast = [votes(f) for f in seen]
            scores = [score(f) for f in seen]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(["".join(map(str, v)) for v in cast], pa.string()),
                    pa.array(model.posterior(np.array(cast))),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                ],
                ["doc_id", "pattern", "posterior", "score", "keep"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), schema)
