import math
import os
import random
from zlib import crc32

import numpy as np
import pytest
import regex

from tidemark.llm import q_subword_tox
from tidemark.llm import subword_tox as S
from tidemark.llm.shared import bounded_sample


def corpus(n=240):
    rng = random.Random(6)
    calm = ["".join(rng.choice("aeiou") + rng.choice("mnrst") for _ in range(rng.randint(2, 4))) for _ in range(120)]
    bad = ["scumbag", "worthless", "pathetic"]
    rows = []
    for k in range(n):
        words = rng.choices(calm, k=rng.randint(20, 80))
        if k % 4 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((" ".join(words), int(k % 4 == 0)))
    return rows


def test_unseen_misspellings_score_like_what_they_come_from():
    rows = corpus(800)
    score = S._Scorer(S.fit_texts(rows[:700], 1 / 3))
    held = rows[700:]
    right = sum((score(t) >= 0.5) == bool(y) for t, y in held)
    assert right >= 0.9 * len(held)
    calm = held[1][0]
    assert score(f"{calm} worthles pathetik scumbags") > 0.5 > score(calm)


def test_scores_equal_a_plain_version():
    """Whole texts and whole words: every n-gram of every word, however long."""
    rows = np.random.default_rng(3).normal(0, 2, S.BUCKETS).astype("float32")
    score = S._Scorer(S.Model(rows, -1.0, 0.7, 0.2))
    texts = ["", "one", "One, two! one", "x" * 100_000 + " tail", "straße ÉTÉ 東京 " * 50, "a b " * 30_000 + "end"]
    for text in texts:
        odds = []
        for word in regex.findall(r"[\p{L}\p{M}\p{N}]+", text.lower()):
            marked = f"<{word}>"
            grams = [marked] + [marked[i : i + k] for k in (3, 4, 5) if k < len(marked) for i in range(len(marked) - k + 1)]
            odds.append(math.exp(-1.0 + sum(float(rows[crc32(g.encode()) % S.BUCKETS]) for g in grams) / len(grams)))
        pooled = math.log(sum(odds) / len(odds)) if odds else -1.0
        assert score(text) == pytest.approx(1 / (1 + math.exp(-(0.7 * pooled + 0.2))), rel=1e-6)


def test_a_bad_word_counts_wherever_it_stands():
    score = S._Scorer(S.fit_texts(corpus(800), 1 / 3))
    calm = corpus(2)[1][0]
    assert score(f"{calm} scumbag pathetic") == pytest.approx(score(f"scumbag pathetic {calm}"))


def test_held_out_toxic_documents_are_found(spark):
    folder = os.environ.get("TIDEMARK_TEST_DATA_LARGEST", "/root/testdata/sf0.1")
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in q_subword_tox.query(spark, folder).where("held_out").collect() if r.doc_id in truth]
    toxic, calm = [p for p, y in held if y], [p for p, y in held if not y]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(calm) <= 0.02 * len(calm)


def test_repeated_ids_do_not_fill_the_sample(spark):
    rows = [(1, f"word{k} again", 0) for k in range(500)] + [(2 + k, f"scumbag loser{k}", 1) for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    counts = dict(df.groupBy("toxic").count().collect())
    taken = bounded_sample(df, "toxic", counts, {0: 60, 1: 40}).collect()
    assert sum(r.toxic == 0 for r in taken) == 60 and sum(r.toxic == 1 for r in taken) == 40
    assert sorted(taken) == sorted(bounded_sample(df.repartition(7), "toxic", counts, {0: 60, 1: 40}).collect())


def test_query(spark, data):
    got = q_subword_tox.query(spark, data).collect()
    assert len(got) == spark.read.parquet(f"{data}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got) and 0 < sum(r.held_out for r in got) < len(got)


def test_nulls_and_empty_tables(spark):
    rows = [(k, t, y, "x") for k, (t, y) in enumerate(corpus(60))] + [(90, None, 1, "x"), (91, "", 0, "x"), (None, "a", 1, "x"), (92, "b", None, "x"), (93, "...", 7, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, score string")
    model = S.fit(df)
    got = {r.doc_id: r.score for r in S.score_documents(df, model).collect()}
    assert got[90] == got[91] == got[93] and 0 <= got[90] < 0.5 and None in got
    assert S.fit(df.limit(0)) is None and S.fit(df.where("toxic = 1")) is None
    assert {r.score for r in S.score_documents(df, None).collect()} == {0.0}
    assert S.score_documents(df.limit(0), model).count() == 0
