import numpy as np

from tidemark.llm import gru_lang as G
from tidemark.llm import q_gru_lang


def small(rng):
    h = G.HIDDEN
    make = lambda *n: rng.normal(0, 0.4, n)
    return [make(3 * h, 257), make(3 * h, h)], rng.integers(0, 257, (5, 3)), make(5, h, 3)


def test_backpropagation_through_time_equals_finite_differences():
    rng = np.random.default_rng(0)
    (inputs, hidden), ids, above = small(rng)
    kept = []
    G._run(G.Direction(inputs, hidden), ids, kept)
    gi, gh = G._run_back(G.Direction(inputs, hidden), ids, kept, above)

    def loss(a, b):
        return (G._run(G.Direction(a, b), ids) * above).sum()

    for grad, which in ((gi, 0), (gh, 1)):
        for _ in range(30):
            at = tuple(int(rng.integers(0, n)) for n in grad.shape)
            if which == 0:
                at = (at[0], int(rng.choice(ids.ravel())))
            moved = [inputs.copy(), hidden.copy()]
            moved[which][at] += 1e-5
            up = loss(*moved)
            moved[which][at] -= 2e-5
            assert abs((up - loss(*moved)) / 2e-5 - grad[at]) < 1e-6


def test_every_position_counts_and_windows_add_up():
    rng = np.random.default_rng(1)
    net = G.train([b"aaaa bbbb" * 7, b"xxxx yyyy" * 7] * 20, ["a", "x"] * 20, steps=40)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (1, 64, 65, 1000, 0)]
    together = G.score_texts(net, texts)
    assert np.allclose(together[:4].sum(axis=1), 1, atol=1e-5) and (together[4] == 0).all()
    for k, t in enumerate(texts):
        assert np.allclose(G.score_texts(net, [t])[0], together[k], atol=1e-6)
    assert net.labels[G.score_texts(net, [b"aaaa bbbb aaaa"])[0].argmax()] == "a"


def test_held_out_documents_are_told_apart(spark, data):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in q_gru_lang.query(spark, data).collect()]
    assert len(got) == len(truth) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_nulls_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, letters_ string"
    rows = [(k, f"the thing {k} goes there with them", "en", "x") for k in range(8)] + [(20 + k, f"le chose {k} est dans une rue", "fr", "x") for k in range(8)]
    odd = [(50, None, None, "x"), (51, "12 34!", None, "x"), (52, "", None, "x"), (None, "the thing", None, "x"), (53, None, "en", "x")]
    df = spark.createDataFrame(rows + odd, schema)
    net = G.fit(df)
    assert net.labels == ["en", "fr"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in G.identify(df, net).collect()}
    assert got[50] == got[51] == got[52] == ("und", 0.0) and got[None][0] == "en"
    named = G.identify(df.withColumnRenamed("lang", "score"), net, ("doc_id", "text", "score"), ("a", "b"))
    assert named.columns == ["doc_id", "text", "score", "a", "b"] and named.count() == 21
    none = G.fit(df.limit(0))
    assert none is None and {r.lang_pred for r in G.identify(df, none).collect()} == {"und"}
    assert G.identify(df.limit(0), net).count() == 0
