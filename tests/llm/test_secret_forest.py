import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import q_secret_forest
from tidemark.llm import secret_forest as S

KEY = "ghp_" + "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6q7R8"
SCHEMA = "doc_id long, text string, hits string, probability string"


@pytest.fixture(scope="module")
def forest(spark):
    return S.fit(S.labelled_findings(spark))


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def plain_features(before, c, after):
    n, low = len(c), c.lower()
    kinds = ["0" if x.isdigit() else "a" if x.islower() else "B" if x.isupper() else "." for x in c]
    words = "|".join(sorted(S.DICTIONARY.split(), key=lambda w: (-len(w), w)))
    near = lambda listed: re.search("(?:^|[^a-z0-9])(?:" + "|".join(sorted(listed.split(), key=lambda w: (-len(w), w))) + ")(?:$|[^a-z0-9])", before.lower()) is not None
    return [
        n, sum(x.isdigit() for x in c) / n, sum(x.isupper() for x in c) / n, sum(a != b for a, b in zip(kinds, kinds[1:])) / n, len(set(c)) / min(n, 40),
        (n - len(re.sub(words, "", low))) / n, c.count("/") / n,
        float(bool(re.search(r"[/\\.:~]$", before) or re.search(r"^(?:\.[A-Za-z]|/|\\)", after) or c.startswith("/"))),
        float(near(S.SECRET_WORDS)), float(near(S.PLAIN_WORDS)), float(bool(re.search(r"[:=]\s*[\"']?$", before))), float(bool(re.search("[\"'`]$", before))),
    ]


def verdict(forest, x):
    def walk(node):
        while node.feature >= 0:
            node = node.low if x[node.feature] <= node.bound else node.high
        return node.share

    return sum(walk(t) for t in forest) / len(forest)


def brute(text, forest):
    found = []
    for m in re.finditer(r"[A-Za-z0-9+/_\-]{16,}={0,2}", text):
        if re.search("[0-9]", m.group()):
            previous = max((k.end() for k in re.finditer(r"[A-Za-z0-9+/_\-]{16,}={0,2}", text) if k.end() <= m.start()), default=0)
            following = min((k.start() for k in re.finditer(r"[A-Za-z0-9+/_\-]{16,}={0,2}", text) if k.start() >= m.end()), default=len(text))
            before, after = text[previous : m.start()][-S.BEFORE :], text[m.end() : following][: S.AFTER]
            found.append((m.start(), m.group(), verdict(forest, plain_features(before, m.group(), after))))
    return found


def test_all_documents_equal_brute_force(spark, data, forest):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {}
    for r in S.scan(spark.read.parquet(f"{data}/documents.parquet"), forest).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.candidate, r.probability))
    for d, t in texts.items():
        mine, theirs = sorted(got.get(d, [])), brute(t, forest)
        assert [x[:2] for x in mine] == [x[:2] for x in theirs] and np.allclose([x[2] for x in mine], [x[2] for x in theirs])
    assert q_secret_forest.query(spark, data).count() == sum(map(len, got.values())) > 0


def test_forest_tells_secrets_from_look_alikes(spark, forest):
    rows = [
        (1, f'api_key = "{KEY}" and more'), (2, "commit 3f786850e387550fdab836ed7e6dc881de23001b fixed it"), (3, "see /usr/share/module7/config/settings9 there"),
        (4, "call 4716201234567890 now"), (5, f"two: token={KEY}, secret: {'9f' * 20}"), (6, "password = your-api-key-here-1"), (7, f'TOKEN = "{"AB12" * 10}"'),
    ]
    flagged = {}
    for r in S.scan(docs(spark, rows), forest).collect():
        flagged.setdefault(r.doc_id, []).append(r.is_secret)
    assert flagged[1] == [True] and flagged[2] == [False] and flagged[3] == [False] and flagged[4] == [False] and flagged[5] == [True, True] and flagged[6] == [False] and flagged[7] == [True]


def test_redaction_keeps_the_rest(spark, forest):
    text = f'é 😀 token = "{KEY}" then {"1" * 16} and secret: {"0a" * 20}\nend'
    made = S.redact(docs(spark, [(1, text), (2, None), (3, ""), (4, "plain")]), forest)
    assert made.columns == ["doc_id", "text", "hits", "probability"]
    got = {r.doc_id: r.text for r in made.collect()}
    assert got == {1: f'é 😀 token = "[SECRET]" then {"1" * 16} and secret: [SECRET]\nend', 2: None, 3: "", 4: "plain"}


def test_nulls_repeats_long_texts_and_empty_tables(spark, forest):
    rows = [(1, None), (2, ""), (None, f"token={KEY}"), (3, f"token={KEY}"), (3, f"token={KEY}"), (4, "A1" * 30000), (5, "a" * 40)]
    got = sorted((r.doc_id or 0, r.start, len(r.candidate)) for r in S.scan(docs(spark, rows), forest).collect())
    assert got == [(0, 6, len(KEY)), (3, 6, len(KEY)), (3, 6, len(KEY)), (4, 0, 60000)]
    assert S.scan(docs(spark, []), forest).count() == 0 and S.redact(docs(spark, []), forest).count() == 0


def test_findings_that_people_label_train_it(spark):
    rows = [("token = ", "k3y" * 8 + str(k), "", 1) for k in range(40)] + [("file ", "some/path/name/" + str(k), "", 0) for k in range(40)] + [(None, None, None, None)]
    own = S.fit(spark.createDataFrame(rows, "before string, candidate string, after string, label int"))
    assert verdict(own, plain_features("token = ", "k3y" * 8 + "7", "")) > 0.5 > verdict(own, plain_features("file ", "some/path/name/7", ""))
    assert verdict(S.fit(spark.createDataFrame([], "before string, candidate string, after string, label int")), [0.0] * 12) == 0.0
    x, y = np.random.default_rng(0).random((200, 12)), np.zeros(200)
    assert S.grow_forest(x, y)[0].feature == -1 and F is not None
