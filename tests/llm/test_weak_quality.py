import numpy as np

from tidemark.llm import q_weak_quality
from tidemark.llm import weak_quality as Q


def test_expectation_maximisation_recovers_accuracies():
    rng = np.random.default_rng(0)
    n, truth = 20000, np.array([[0.7, 0.02], [0.5, 0.05], [0.6, 0.01], [0.3, 0.03]])
    good = rng.random(n) < 0.8
    bad_vote = rng.random((n, 4)) < np.where(good[:, None], truth[None, :, 1], truth[None, :, 0])
    silent = rng.random((n, 4)) < 0.2
    votes = np.where(silent, Q.NONE, np.where(bad_vote, Q.BAD, Q.GOOD))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = Q.expectation_maximisation(patterns, counts.astype(float))
    assert abs(model.good - 0.8) < 0.04 and np.abs(model.bad_vote - truth).max() < 0.08
    assert ((model.posterior(votes) > 0.5) == good).mean() > 0.9


def test_labels_of_the_test_tables_are_met(spark, data):
    gold = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    got = {r.doc_id: r for r in q_weak_quality.query(spark, data).collect()}
    assert len(got) == spark.read.parquet(f"{data}/documents.parquet").count()
    known = [(got[d].keep, y) for d, y in gold.items() if y is not None and d in got]
    assert sum(k == y for k, y in known) >= 0.95 * len(known)


def test_votes():
    assert Q.votes(Q.facts("Every plain line with some words that ends well. " * 5))[:2] == [Q.GOOD, Q.GOOD]
    assert Q.votes(Q.facts("THIS IS ALL LOUD!! VERY LOUD!!"))[1] == Q.BAD
    assert len(Q.votes(Q.facts(None))) == len(Q.LABELLERS) == len(Q.votes(Q.facts("")))


def test_nulls_and_empty_tables(spark):
    rows = [(k, "Some fine words stand here, one after another, in good order. " * (k % 3 + 1), "x", "y") for k in range(40)]
    rows += [(90 + k, "&&& *** ### $$$ %%% word&&& " * 9, "x", "y") for k in range(12)] + [(200, None, "x", "y"), (201, "", "x", "y"), (None, "x" * 100000, "x", "y"), (200, None, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string, pattern string")
    got = Q.score_quality(df, Q.fit(df)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[3].keep == 1 and by[95].keep == 0 and by[200].score == by[201].score
    assert Q.fit(df.limit(0)) is None and Q.score_quality(df.limit(0), None).count() == 0


def test_ids_play_no_part(spark):
    rows = [(k, "Some fine words stand here, one after another, in good order. " * (k % 3 + 1)) for k in range(40)] + [(90 + k, f"&&& *** ### $$$ %%% word&&& {k} " * 9) for k in range(12)]
    shown = spark.createDataFrame(rows, "doc_id long, text string")
    hidden = spark.createDataFrame([(None, t) for _, t in rows], "doc_id long, text string")
    mixed = spark.createDataFrame([(k % 3, t) for k, t in rows], "doc_id long, text string")
    scores = [sorted((r.pattern, r.score, r.keep) for r in Q.score_quality(df, Q.fit(df)).collect()) for df in (shown, hidden, mixed)]
    assert len(scores[0]) == len(rows) and scores[0] == scores[1] == scores[2]
