import hashlib
import re

import corpus_pipeline as P
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import decontaminate, gru_lang, near_copies, q_gru_lang, secret_forest
from tidemark.llm.shared import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def near(a, b):
    return a == b or bool(a and b) and len(a & b) >= 0.8 * len(a | b)


def test_run_equals_a_plain_version(spark, data):
    """Stage by stage in plain Python: the same trained models, decisions taken without Spark."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    net = gru_lang.fit(q_gru_lang.training_rows(docs))
    sure = {d: t for d, t in rows.items() if t and re.search(r"[^\W\d_]", t) and gru_lang.score_texts(net, [t.encode()])[0].max() >= P.LEAST_SURE}
    marks = {d: set(near_copies.shingles(t).tolist()) for d, t in sure.items()}
    kept, left = {}, set(sure)
    while left:
        group, edge = set(), {min(left)}
        while edge:
            group |= edge
            edge = {d for d in left - group if any(near(marks[d], marks[e]) for e in edge)}
        kept[min(group)] = sure[min(group)]
        left -= group
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    matcher = decontaminate.Matcher(bench)
    clean = {d: t for d, t in kept.items() if not matcher.find(t)}
    forest = secret_forest.fit(secret_forest.labelled_findings(spark))
    secrets = {}
    for r in secret_forest.scan(docs, forest).where("is_secret").orderBy("start").collect():
        secrets.setdefault(r.doc_id, []).append((r.start, len(r.candidate)))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = {}
    for d, t in clean.items():
        for start, n in reversed(secrets.get(d, [])):
            t = t[:start] + secret_forest.REDACTED + t[start + n :]
        ids = library.encode(t, add_special_tokens=False).ids
        expected[d] = (len(ids), hashlib.sha256(t.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in P.run(spark, data).collect()}
    assert got == expected and 0 < len(got) < len(rows)


def test_stages_keep_columns_and_take_odd_rows(spark, data):
    schema = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, lang_score double, hits string, kept_id long, n_rows long"
    word = "thing about the other thing that was there with them "
    rows = [(k, f"{word * 3}{chr(97 + k % 26) * 5} {k * k} {chr(98 + k % 20) * 4} {word}", "en", None, 9, None, None, None, None, None) for k in range(12)]
    rows += [(50, None, None, None, None, "x", 1.0, "h", 1, 1), (51, "", None, None, None, None, None, None, None, None), (3, rows[3][1], "en", None, 9, None, None, None, None, None), (None, "a lonely line of other words here", "en", "s", 1, None, None, None, None, None)]
    more = ["there was not one of them with that", "all of the other things were about this one then", "then this is what they said about it"]
    rows += [(d, t, "en", None, 1, None, None, None, None, None) for d, t in zip((None, 60, 60), more)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in P.STAGES[:-1]:
        docs = written(stage(spark, docs, data), name)
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
    ids = [r.doc_id for r in docs.collect()]
    assert sorted(d for d in ids if d is not None) == sorted({*range(12), 3, 60}) + [60] and ids.count(None) == 2
    assert P.STAGES[-1][1](spark, docs, data).count() == len(ids)
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, data).count() == 0
