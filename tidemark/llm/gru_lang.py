"""Language identification by a bidirectional gated recurrent network over bytes.

The network labels every byte of a text; the document's probabilities are the mean of its
positions' probabilities. Texts run through it whole, in windows of ``WINDOW`` bytes; each window
starts from an empty state, so a byte sees its window and nothing beyond. It is trained
in numpy by backpropagation through time on windows drawn from a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_sample, lean

WINDOW = 64
HIDDEN = 12
#: The symbol after a text's last byte, up to the end of its last window.
PAD = 256
#: Bounds of the training sample: documents of each language and windows of each document.
DOCS_PER_LANGUAGE = 200
WINDOWS_PER_DOC = 6
UNDETERMINED = "und"
#: Windows that are computed at once.
_BATCH = 1024


@dataclass
class Direction:
    """One direction's weights: a row of gate inputs for each symbol, and the recurrent matrix.

    Gates are stacked as reset, update, candidate.
    """

    inputs: np.ndarray  # (3H, 257)
    hidden: np.ndarray  # (3H, H)


@dataclass
class Network:
    labels: list[str]
    ahead: Direction
    back: Direction
    out: np.ndarray  # (labels, 2H)
    bias: np.ndarray  # (labels, 1)


def _squash(x: np.ndarray) -> None:
    """Logistic function in place."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5


def _run(d: Direction, ids: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (T, H, B) of one direction over symbols (T, B); keep collects what backpropagation needs."""
    steps, width = ids.shape
    h_size = d.hidden.shape[1]
    state = np.zeros((h_size, width), d.hidden.dtype)
    states = np.empty((steps, h_size, width), d.hidden.dtype)
    for t in range(steps):
        x = np.take(d.inputs, ids[t], axis=1)
        g = d.hidden @ state
        gates = g[: 2 * h_size]
        gates += x[: 2 * h_size]
        _squash(gates)
        inner = g[2 * h_size :]
        candidate = inner * gates[:h_size]
        candidate += x[2 * h_size :]
        np.tanh(candidate, out=candidate)
        if keep is not None:
            keep.append((state, gates, inner, candidate))
        state = candidate + gates[h_size:] * (state - candidate)
        states[t] = state
    return states


def _run_back(d: Direction, ids: np.ndarray, kept: list, above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of (inputs, hidden) from those of the states, back through time."""
    h_size = d.hidden.shape[1]
    of_inputs, of_hidden = np.zeros_like(d.inputs.T), np.zeros_like(d.hidden)
    carried = np.zeros_like(above[0])
    for t in range(len(ids) - 1, -1, -1):
        state, gates, inner, candidate = kept[t]
        reset, update = gates[:h_size], gates[h_size:]
        grad = above[t] + carried
        of_candidate = grad * (1 - update) * (1 - candidate**2)
        of_update = grad * (state - candidate) * update * (1 - update)
        of_reset = of_candidate * inner * reset * (1 - reset)
        gx = np.concatenate([of_reset, of_update, of_candidate])
        gh = np.concatenate([of_reset, of_update, of_candidate * reset])
        np.add.at(of_inputs, ids[t], gx.T)
        of_hidden += gh @ state.T
        carried = grad * update + d.hidden.T @ gh
    return of_inputs.T, of_hidden


def _probabilities(net: Network, ahead: np.ndarray, back: np.ndarray) -> np.ndarray:
    """(T, labels, B) for states of both directions."""
    h_size = ahead.shape[1]
    scores = net.out[:, :h_size] @ ahead + net.out[:, h_size:] @ back + net.bias
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    return scores


def train(windows: list[bytes], labels: list[str], steps: int = 400, batch: int = 96, rate: float = 0.02, seed: int = 7) -> Network:
    """A network for the given windows (at most WINDOW bytes each) and their labels."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    target = np.array([names.index(x) for x in labels])
    ids = np.full((len(windows), WINDOW), PAD, np.int64)
    for k, w in enumerate(windows):
        ids[k, : len(w)] = np.frombuffer(w, np.uint8)
    h = HIDDEN
    weights = [rng.normal(0, s, n) for s, n in ((0.3, (3 * h, 257)), (0.3, (3 * h, h)), (0.3, (3 * h, 257)), (0.3, (3 * h, h)), (0.3, (len(names), 2 * h)), (0.01, (len(names), 1)))]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    by_label = [np.flatnonzero(target == k) for k in range(len(names))]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(own, max(1, batch // len(names))) for own in by_label])
        x, y = ids[pick].T.copy(), target[pick]
        cut = rng.integers(1, WINDOW + 1, len(pick))
        short = rng.random(len(pick)) < 0.2
        x[(np.arange(WINDOW)[:, None] >= cut[None, :]) & short[None, :]] = PAD
        net = Network(names, Direction(*weights[:2]), Direction(*weights[2:4]), *weights[4:])
        kept_a, kept_b = [], []
        ahead = _run(net.ahead, x, kept_a)
        back = _run(net.back, x[::-1], kept_b)[::-1]
        grad = _probabilities(net, ahead, back)
        grad[:, y, np.arange(len(y))] -= 1
        real = (x != PAD)[:, None, :]
        grad *= real / max(1, real.sum())
        of_ahead = np.matmul(net.out[:, :h].T, grad)
        of_back = np.matmul(net.out[:, h:].T, grad)
        of_out = np.concatenate([np.einsum("tlb,thb->lh", grad, ahead), np.einsum("tlb,thb->lh", grad, back)], axis=1)
        grads = [*_run_back(net.ahead, x, kept_a, of_ahead), *_run_back(net.back, x[::-1], kept_b, of_back[::-1]), of_out, grad.sum(axis=(0, 2))[:, None]]
        norm = np.sqrt(sum((g**2).sum() for g in grads))
        slow = rate * (1 - step / (steps + 1))
        for w, g, m, v in zip(weights, grads, first, second):
            g = g * min(1.0, 1.0 / (norm + 1e-12))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= slow * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    weights = [np.ascontiguousarray(w, np.float32) for w in weights]
    return Network(names, Direction(*weights[:2]), Direction(*weights[2:4]), *weights[4:])


def score_texts(net: Network, texts: list[bytes]) -> np.ndarray:
    """(texts, labels): mean over all byte positions of each text; zeros for empty texts."""
    total = np.zeros((len(texts), len(net.labels)))
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(texts)), counts)
    ids = np.full(int(counts.sum()) * WINDOW, PAD, np.int16)
    at = 0
    for text, n in zip(texts, counts.tolist()):
        ids[at : at + len(text)] = np.frombuffer(text, np.uint8)
        at += n * WINDOW
    ids = ids.reshape(-1, WINDOW)
    for k in range(0, len(ids), _BATCH):
        x = np.ascontiguousarray(ids[k : k + _BATCH].T)
        chances = _probabilities(net, _run(net.ahead, x), _run(net.back, x[::-1])[::-1])
        chances *= (x != PAD)[:, None, :]
        np.add.at(total, owner[k : k + _BATCH], chances.sum(axis=0).T)
    return total / np.maximum(sizes, 1)[:, None]


def fit(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> Network | None:
    """Trains on rows (doc_id, text, lang) whose language and text are not null.

    At most ``docs_per_language`` rows of each language (those with the smallest hash) and ``WINDOWS_PER_DOC`` windows spread over each of them come to the driver. None if there
    are no such rows.
    """
    known = labelled.where("lang is not null and doc_id is not null").select("doc_id", "text", "lang").where(F.col("text").rlike(r"\p{L}"))
    counts = dict(known.groupBy("lang").count().collect())
    if not counts:
        return None
    windows = F.transform(
        F.sequence(F.lit(0), F.lit(WINDOWS_PER_DOC - 1)),
        lambda i: F.substring(F.col("text"), (F.floor(i * F.length("text") / WINDOWS_PER_DOC) + 1).cast("int"), F.lit(WINDOW)),
    )
    rows = bounded_sample(known, "lang", counts, docs_per_language).select("doc_id", "lang", windows.alias("ws")).collect()
    pairs = sorted((r.doc_id, r.lang, w.encode("utf-8", "replace")[:WINDOW]) for r in rows for w in r.ws if w)
    if not pairs:
        return None
    return train([w for _, _, w in pairs], [lang for _, lang, _ in pairs])


def identify(docs: DataFrame, net: Network | None, columns: tuple[str, ...] = ("doc_id",), named: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The given columns, and the predicted language and its score for each row's whole ``text``.

    ``named`` are the names of the two, which the given columns must not have.

    ``und`` with score 0 if the text is null or has no letter, or if nothing could be learnt. Equal
    probabilities: the first label in order. Other columns are ignored; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(net)
    kept = len(columns)
    schema = docs.select(*columns).schema.add(named[0], "string").add(named[1], "double")

    def flush(batch: pa.RecordBatch, start: int, texts: list[bytes], sane: list[bool]) -> pa.RecordBatch:
        chances = score_texts(model.value, texts) if model.value else np.zeros((len(texts), 1))
        best = chances.argmax(axis=1)
        labels = [model.value.labels[b] if ok and model.value else UNDETERMINED for b, ok in zip(best.tolist(), sane)]
        scores = np.where(sane, np.clip(chances[np.arange(len(best)), best], 0, 1), 0.0) if model.value else np.zeros(len(texts))
        part = batch.slice(start, len(texts))
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in range(kept)), pa.array(labels, pa.string()), pa.array(scores)], [*columns, *named])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, texts, sane, held = 0, [], [], 0
            for k, (text, letters) in enumerate(zip(batch.column(kept), batch.column(kept + 1))):
                ok = bool(letters.as_py())
                texts.append(text.as_py().encode("utf-8", "replace") if ok else b"")
                sane.append(ok)
                held += len(texts[-1])
                if held >= _BATCH * WINDOW * 8 or len(texts) >= 2048:
                    yield flush(batch, start, texts, sane)
                    start, texts, sane, held = k + 1, [], [], 0
            if texts:
                yield flush(batch, start, texts, sane)

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters_")
    return docs.select(*columns, F.col("text"), letters).mapInArrow(lean(run), schema)
