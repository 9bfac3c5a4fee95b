import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from tidemark.llm import brown_lm as B
from tidemark.llm import q_brown_lm

SCHEMA = "doc_id long, text string, held_out boolean, score string, word string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def test_counts_and_base_equal_brute_force(spark, data):
    texts = {r.doc_id: (r.text or "").encode().lower().split() for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    held = {d: crc32(str(d).encode()) % 7 == 2 for d in texts}
    count, ends = Counter(), 0
    for d, words in texts.items():
        if not held[d]:
            count.update(words)
            ends += 1
    total, types = sum(count.values()) + ends, len(count) + 1
    base = lambda c: math.log10((c + 1) / (total + types + 1))
    got = q_brown_lm.query(spark, data).collect()
    assert len(got) == len(texts)
    for r in got:
        words = texts[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(words) + 1, total)
        assert r.n_known == sum(count[w] > 0 for w in words) + 1
        assert r.base_score == pytest.approx(sum(base(count[w]) for w in words) + base(ends), rel=1e-12)
    scored = [r for r in got if r.held_out]
    assert sum(r.score for r in scored) > sum(r.base_score for r in scored)


def plain(rows, frequent):
    """The whole operator again in loops over small texts: seeds, the exchange of all other words,
    transitions and scores."""
    texts = [(d, B.tokens_of(t), held) for d, t, held in rows]
    train = [w for _, w, held in texts if not held]
    count = Counter(w for words in train for w in words)
    top = [w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:frequent]]
    n = len(top) + B.SPELLINGS + 1
    unit = lambda w: top.index(w) if w in top else len(top) + B.spelling(w)
    bigrams = np.zeros((n, n))
    for words in train:
        line = [n - 1, *map(unit, words), n - 1]
        for a, b in zip(line, line[1:]):
            bigrams[a, b] += 1
    of = B.exchange(bigrams, B.CLASSES)
    first = lambda w: int(of[unit(w)])
    pairs = np.zeros((B.CLASSES, B.CLASSES))
    for a in range(n):
        for b in range(n):
            pairs[of[a], of[b]] += bigrams[a, b]
    smooth = pairs + B.PAIR
    gain = Counter()
    for words in train:
        line = [0, *map(first, words), 0]
        for k, w in enumerate(words):
            for c in range(1, B.CLASSES):
                gain[w, c] += math.log(smooth[line[k], c]) + math.log(smooth[c, line[k + 2]]) - math.log(smooth[c].sum()) - math.log(smooth[:, c].sum())
    best = {w: first(w) if w in top else max(range(1, B.CLASSES), key=lambda c: gain[w, c]) for w in count}
    cls = lambda w: best.get(w, first(w))
    steps, tokens, types = np.zeros((B.CLASSES, B.CLASSES)), Counter({0: len(train)}), Counter({0: 1})
    for words in train:
        line = [0, *map(cls, words), 0]
        for a, b in zip(line, line[1:]):
            steps[a, b] += 1
    for w, c in count.items():
        tokens[cls(w)] += c
        types[cls(w)] += 1
    whole = (steps.sum(axis=0) + 1) / (steps.sum() + B.CLASSES)
    out = []
    for d, words, _ in texts:
        score, before = 0.0, 0
        for w in [*words, None]:
            c = 0 if w is None else cls(w)
            score += math.log10((steps[before, c] + B.TRANSITION * whole[c]) / (steps[before].sum() + B.TRANSITION))
            score += math.log10(((len(train) if w is None else count[w]) + B.EMISSION) / (tokens[c] + B.EMISSION * (types[c] + 1)))
            before = c
        out.append((d, round(score, 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("frequent", [3, 1000])
def test_scores_equal_a_plain_version(spark, monkeypatch, frequent):
    rng = np.random.default_rng(frequent)
    parts = [[f"{x}{k}" for k in range(8)] for x in ("det", "noun", "verb")]
    made = lambda: " ".join(rng.choice(parts[k % 3]) for k in range(rng.integers(1, 30)))
    rows = [(k, made(), k % 5 == 0) for k in range(60)] + [(90, "det1 zebra verb2 unseen", True), (91, None, False)]
    monkeypatch.setattr(B, "FREQUENT", frequent)
    monkeypatch.setattr(B, "BLOCK_DOCS", 7)
    got = sorted(((r.doc_id, round(r.score, 6)) for r in B.score_documents(docs(spark, rows)).collect()), key=str)
    assert got == plain(rows, frequent)


def test_held_out_perplexity_is_well_below_the_unigram(spark, larger):
    held = [r for r in q_brown_lm.query(spark, larger).collect() if r.held_out]
    n = sum(r.n_tokens for r in held)
    assert 10 ** (-sum(r.score for r in held) / n) < 0.65 * 10 ** (-sum(r.base_score for r in held) / n)


def test_the_model_is_a_distribution(spark):
    rows = [(k, " ".join(["red", "fish", "blue", "fish"][k % 4 :] + ["one two"] * (k % 3)), False) for k in range(40)]
    table = B.blocks(docs(spark, rows))
    seeds = B.seed(table)
    model = B.fit(B.classified(table, seeds), seeds)
    counts = Counter(w for _, t, _ in rows for w in B.tokens_of(t))
    assert np.allclose((10**model.transition).sum(axis=1), 1)
    of = model.seeds.classes(list(counts))
    chance = 10 ** model.emission(of, np.array(list(counts.values()), float))
    for c in set(of.tolist()):
        unknown = 10 ** model.emission(np.array([c]), np.zeros(1))[0]
        assert chance[of == c].sum() + unknown == pytest.approx(1)


def test_exchange_raises_the_likelihood_and_parts_alternating_words():
    n = 9
    bigrams = np.zeros((n, n))
    for a in range(4):
        for b in range(4, 8):
            bigrams[a, b] = bigrams[b, a] = 10
    bigrams[8, 0] = bigrams[7, 8] = 1

    def likelihood(of):
        hot = np.eye(3)[of]
        p = hot.T @ bigrams @ hot
        return B._xlogx(p).sum() - B._xlogx(p.sum(axis=0)).sum() - B._xlogx(p.sum(axis=1)).sum()

    of = B.exchange(bigrams, 3)
    start = np.append(1 + np.arange(n - 1) % 2, 0)
    assert likelihood(of) > likelihood(start)
    assert len(set(of[:4])) == 1 and len(set(of[4:8])) == 1 and of[0] != of[4] and of[8] == 0 and 0 not in of[:8]


def test_blocks_do_not_change_scores(spark, monkeypatch):
    rows = [(k, f"word{k % 5} and word{k % 7} then", k % 6 == 0) for k in range(60)]
    whole = {r.doc_id: (r.n_known, round(r.score, 9)) for r in B.score_documents(docs(spark, rows)).collect()}
    monkeypatch.setattr(B, "BLOCK_DOCS", 3)
    monkeypatch.setattr(B, "BLOCK_BYTES", 10)
    assert {r.doc_id: (r.n_known, round(r.score, 9)) for r in B.score_documents(docs(spark, rows).coalesce(1)).collect()} == whole


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, None, False), (2, "", True), (None, "a b", False), (3, "A\tb", True), (3, "A\tb", True)]
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in B.score_documents(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 1, 1, 4), (2, 1, 1, 4), (None, 3, 3, 4), (3, 3, 3, 4), (3, 3, 3, 4)], key=str)
    assert all(r.n_known == 0 for r in B.score_documents(docs(spark, [(1, "a", True), (2, "b", True)])).collect())
    assert B.score_documents(docs(spark, [])).count() == 0


def test_the_plan_does_not_spell_out_the_gains(spark, monkeypatch):
    """Spark keeps the text of each plan in the driver; gains as constants made it megabytes long."""
    monkeypatch.setattr(B, "FREQUENT", 2)
    table = B.blocks(docs(spark, [(k, f"a b{k} c d{k % 3} a", False) for k in range(40)]))
    seeds = B.seed(table)
    words = B._classified(B._entries(table, spark.sparkContext.broadcast(seeds)).repartition("word"), seeds)
    assert words.count() > 0
    assert len(words._jdf.queryExecution().toString()) < 200_000
