"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams and of the word itself, all
hashed into one table; a softmax layer on top gives the word's odds. A text's odds are the mean odds
of all its words, so a few bad words in a long text are not averaged away in the vectors. Table and
layer are trained together by the cross-entropy of whole texts. Misspellings share most n-grams with
the words they come from. Since the layer is linear, scoring looks each word up once.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_sample, lean

BUCKETS = 1 << 16
WIDTH = 8
GRAMS = (3, 4, 5)
#: Bound of the training sample: labelled rows of each class that come to the driver, with their whole texts.
DOCS_PER_CLASS = {0: 2400, 1: 1100}
#: Table rows that fewer training texts use stay zero: what one text alone has would only learn that text.
LEAST_TEXTS = 8
#: Adam's floor under the step's divisor, in units of the table's root mean square gradient:
#: n-grams of a text or two move little, those that many toxic texts share move far.
FLOOR = 10.0
#: Part of the table that each step takes away, at the full rate.
DECAY = 0.1
#: Every so many documents of the sample is kept from training and used for calibration.
CALIBRATION = 5
#: A missed toxic text counts as much as so many false alarms when the odds are calibrated.
MISS_COST = 3.0
#: Words remembered by a worker; the memory is emptied when full.
REMEMBERED = 300_000
#: Rows that training gathers at once.
_AT_ONCE = 200_000
#: Log-odds of a word are kept within this.
_MOST = 60.0

_words = regex.compile(r"[\p{L}\p{M}\p{N}]+").findall


def words_of(text: str | None) -> list[str]:
    return _words(text.lower()) if text else []


def subwords(word: str) -> list[int]:
    """Table rows of a word: itself and its n-grams with the word's ends marked."""
    marked = f"<{word}>"
    if word.isascii():
        raw, n = marked.encode(), len(marked)
        return [crc32(raw) % BUCKETS, *[crc32(raw[i : i + k]) % BUCKETS for k in GRAMS if k < n for i in range(n - k + 1)]]
    grams = [marked, *(marked[i : i + k] for k in GRAMS if k < len(marked) for i in range(len(marked) - k + 1))]
    return [crc32(g.encode("utf-8", "replace")) % BUCKETS for g in grams]


@dataclass
class Model:
    """A word's log-odds are ``bias`` plus the mean of ``rows`` over its subwords."""

    rows: np.ndarray
    bias: float
    #: A text's log-odds are its pooled ones times slope plus shift.
    slope: float = 1.0
    shift: float = 0.0


def _sums(rows: np.ndarray, picked: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the picked rows from each start to the next, a bounded number of them in memory."""
    out = np.empty((len(starts), rows.shape[1]), np.float32)
    at = 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + _AT_ONCE)))
        lo, hi = starts[at], starts[end] if end < len(starts) else len(picked)
        out[at:end] = np.add.reduceat(rows[picked[lo:hi]], starts[at:end] - lo)
        at = end
    return out


def _pool(odds: np.ndarray, times: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the mean odds of each text's words, and each word's part in it; a word counts as often
    as it occurs."""
    spans = np.diff([*starts, len(odds)])
    top = np.repeat(np.maximum.reduceat(odds, starts), spans)
    raised = times * np.exp(odds - top)
    total = np.add.reduceat(raised, starts)
    return top[starts] + np.log(total / sizes), raised / np.repeat(total, spans)


def train(texts: list[Counter], labels: list[int], epochs: int = 50, rate: float = 0.3, seed: int = 5) -> Model:
    """Full-batch Adam on the cross-entropy of whole texts (words with their counts), table and
    softmax layer together; both classes weigh the same."""
    pairs = [(bag, label) for bag, label in zip(texts, labels) if bag]
    y = np.array([label for _, label in pairs], np.float32)
    places: dict[str, int] = {}
    ids = np.fromiter((places.setdefault(w, len(places)) for bag, _ in pairs for w in bag), np.int32)
    times = np.fromiter((n for bag, _ in pairs for n in bag.values()), np.float32)
    spans = np.array([len(bag) for bag, _ in pairs])
    sizes = np.array([sum(bag.values()) for bag, _ in pairs], np.float32)
    text_from = np.cumsum(spans) - spans
    found, sub_size = array("i"), np.empty(len(places), np.int64)
    for k, w in enumerate(places):
        rows = subwords(w)
        found.extend(rows)
        sub_size[k] = len(rows)
    used, sub_ids = np.unique(np.frombuffer(found, np.int32), return_inverse=True)
    sub_ids = sub_ids.astype(np.int32)
    sub_from = np.cumsum(sub_size) - sub_size
    spread = np.zeros(len(used), np.int32)
    for a, n in zip(text_from, spans):
        spread[np.unique(np.concatenate([sub_ids[sub_from[w] : sub_from[w] + sub_size[w]] for w in ids[a : a + n]]))] += 1
    alive = (spread >= min(LEAST_TEXTS, len(pairs)))[:, None].astype(np.float32)
    order = np.argsort(sub_ids, kind="stable")
    sub_at = np.searchsorted(sub_ids[order], np.arange(len(used)))
    sub_word = np.repeat(np.arange(len(places), dtype=np.int32), sub_size)[order]
    scaled = (1 / sub_size)[:, None].astype(np.float32)
    per_class = (0.5 / np.bincount(y.astype(int), minlength=2).clip(1))[y.astype(int)].astype(np.float32)
    rng = np.random.default_rng(seed)
    weights = [rng.normal(0, s, n).astype(np.float32) for s, n in ((0.1, (len(used), WIDTH)), (0.5, (WIDTH, 2)), (0.01, 2))]
    weights[0] *= alive
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, epochs + 1):
        table, layer, bias = weights
        vectors = _sums(table, sub_ids, sub_from) * scaled
        scores = vectors @ layer + bias
        pooled, parts = _pool((scores[:, 1] - scores[:, 0])[ids], times, text_from, sizes)
        error = (1 / (1 + np.exp(-pooled)) - y) * per_class
        up = np.bincount(ids, np.repeat(error, spans) * parts, len(places)).astype(np.float32)[:, None]
        grad = np.concatenate([-up, up], axis=1)
        of_table = _sums((grad @ layer.T) * scaled, sub_word, sub_at) * alive
        slow = rate * (1 - step / (epochs + 1))
        for k, (w, g) in enumerate(zip(weights, (of_table, vectors.T @ grad, grad.sum(axis=0)))):
            m, v = first[k], second[k]
            m += 0.1 * (g - m)
            v += 0.05 * (g * g - v)
            floor = 0.0
            if w is table:
                floor = FLOOR * np.sqrt(float(v.mean()))
                w *= 1 - slow * DECAY
            w -= slow * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.95**step)) + floor + 1e-12)
    table, layer, bias = weights
    rows = np.zeros(BUCKETS)
    rows[used] = table @ (layer[:, 1] - layer[:, 0])
    return Model(rows.astype(np.float32), float(bias[1] - bias[0]))


def calibrate(model: Model, texts: list[list[str]], labels: list[int], odds: float) -> Model:
    """Sets slope and shift by logistic regression on texts that were not trained on.

    ``odds`` is the ratio of class 1 to class 0 among all labelled rows, times the cost of a miss; a
    weak pull towards slope 1 and shift 0 decides where there are few texts.
    """
    score = _Scorer(model)
    x, y = np.array([score.pooled(t) for t in texts]), np.array(labels, float)
    x = np.clip(x, -30, 30)
    weight = np.where(y == 1, odds * max(1, (y == 0).sum()) / max(1, (y == 1).sum()), 1.0)
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(slope * x + shift)))
        e, c = weight * (p - y), weight * p * (1 - p)
        g = np.array([(e * x).sum() + (slope - 1), e.sum() + 0.1 * shift])
        hess = np.array([[(c * x * x).sum() + 1, (c * x).sum()], [(c * x).sum(), c.sum() + 0.1]])
        move = np.linalg.solve(hess, g)
        slope, shift = slope - np.clip(move[0], -0.5, 0.5), shift - np.clip(move[1], -2, 2)
    return Model(model.rows, model.bias, max(float(slope), 0.05), float(shift))


def fit(labelled: DataFrame, odds: float | None = None, docs_per_class: dict[int, int] = DOCS_PER_CLASS) -> Model | None:
    """Trains on rows (doc_id, text, toxic). At most ``docs_per_class`` rows of each class, the ones
    with the smallest hash, come to the driver with their whole texts; every fifth of them
    calibrates. ``odds`` is the ratio of class 1 to class 0 where the rows are drawn from, their own
    if not given. None without both classes."""
    known = labelled.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))
    counts = dict(known.groupBy("toxic").count().collect())
    if len(counts) < 2:
        return None
    found = bounded_sample(known, "toxic", counts, docs_per_class).collect()
    rows = sorted((r.toxic, crc32(str(r.doc_id).encode()), r.text) for r in found)
    return fit_texts([(t, y) for y, _, t in rows], odds or counts[1] / counts[0])


def fit_texts(rows: list[tuple[str, int]], odds: float) -> Model:
    """The model of (text, label) rows; every fifth of them calibrates it."""
    held = [k % CALIBRATION == 0 for k in range(len(rows))]
    taught = [(Counter(words_of(t)), y) for (t, y), h in zip(rows, held) if not h]
    model = train([bag for bag, _ in taught], [y for _, y in taught])
    return calibrate(model, [words_of(t) for (t, _), h in zip(rows, held) if h], [y for (_, y), h in zip(rows, held) if h], odds * MISS_COST)


class _Memory(dict):
    """Odds of words, made on first sight."""

    def __init__(self, model: Model):
        self.rows, self.bias = model.rows.tolist(), model.bias

    def __missing__(self, word: str) -> float:
        ids = subwords(word)
        odds = self.bias + sum(map(self.rows.__getitem__, ids)) / len(ids)
        self[word] = found = math.exp(min(max(odds, -_MOST), _MOST))
        return found


class _Scorer:
    def __init__(self, model: Model):
        self.model, self.memory = model, _Memory(model)

    def pooled(self, words: list[str]) -> float:
        """Log of the mean odds of the words."""
        if not words:
            return self.model.bias
        memory = self.memory
        if len(memory) >= REMEMBERED:
            memory.clear()
        return math.log(sum(map(memory.__getitem__, words)) / len(words))

    def __call__(self, text: str | None) -> float:
        odds = self.model.slope * self.pooled(words_of(text)) + self.model.shift
        return 1 / (1 + math.exp(-min(max(odds, -60.0), 60.0)))


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) of whole texts: the chance that a text is toxic.

    Null and empty texts and texts without words get the model's bias alone; without a model every
    score is 0. Nulls in other columns, repeated rows and other columns don't matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _Scorer(shared.value) if shared.value else lambda text: 0.0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([float(score(t.as_py())) for t in batch.column(1)], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, score double")
