import random

import pytest

from tidemark.llm import decontaminate as D
from tidemark.llm import q_decontaminate

SCHEMA = "doc_id long, text string, item_id string, distance string"
ITEM = "the quick brown foxes jumped over seventeen lazy dogs while nobody at the riverside cafe was looking at them"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def plain_distance(p, t):
    before = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        now = [i]
        for j, d in enumerate(t, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (c != d)))
        before = now
    return min(before)


def test_bit_vectors_equal_the_table(spark):
    rng = random.Random(2)
    for _ in range(400):
        p = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 90)))
        t = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 120)))
        assert D.Passage.of(0, p).distance(t) == plain_distance(p, t)


def test_pieces_find_whatever_the_budget_allows():
    rng = random.Random(3)
    matcher = D.Matcher([(1, ITEM)])
    hits = 0
    for _ in range(300):
        s = list(ITEM)
        for _ in range(rng.randint(0, 12)):
            k = rng.randrange(len(s))
            s[k] = rng.choice(["", "x", s[k] + "q"])
        text = "noise before it " + "".join(s) + " and after it"
        line, item = D.padded(text), D.padded(ITEM)
        best = plain_distance(item, line)
        expected = best <= D.budget(item)
        assert matcher.find(text) == ({0: (best, 1)} if expected else {})
        hits += expected
    assert 50 < hits


def test_exact_short_and_split_items(spark):
    long_item = " ".join(f"word{k} thing{k * 7}" for k in range(40))
    bench = items(spark, [(1, ITEM), (2, "Tiny answer"), (3, long_item), (4, None), (5, "  "), (None, "x y z"), (2, "Tiny answer")])
    rows = [
        (10, "PREFIX " + ITEM.upper().replace(" ", "\n") + "!"), (11, "a tiny, ANSWER indeed"), (12, "tiny answers"), (13, " ".join(long_item.split()[20:60])),
        (14, None), (15, ""), (16, "the the the " * 3000), (17, ITEM[: len(ITEM) // 3]), (None, ITEM),
    ]
    got = {(r.doc_id, r.item_id) for r in D.contamination(docs(spark, rows), bench).collect()}
    assert got == {(10, 1), (11, 2), (13, 3), (None, 1)}
    kept = D.without_benchmark(docs(spark, rows), bench)
    assert kept.columns == ["doc_id", "text", "item_id", "distance"]
    assert sorted(r.doc_id for r in kept.collect()) == [12, 14, 15, 16, 17]


def test_items_without_ids_count(spark):
    bench = items(spark, [(None, ITEM), (None, "x y z"), (4, None)])
    rows = [(1, f"see {ITEM} there"), (2, "w x y z"), (3, "nothing of it"), (4, None)]
    assert {(r.doc_id, r.item_id, r.whole) for r in D.contamination(docs(spark, rows), bench).collect()} == {(1, None, True), (2, None, True)}
    assert sorted(r.doc_id for r in D.without_benchmark(docs(spark, rows), bench).collect()) == [3, 4]


@pytest.mark.parametrize("limit", [20_000_000, 50])
def test_passes_add_up(spark, monkeypatch, limit):
    monkeypatch.setattr(D, "PASS_CHARS", limit)
    rng = random.Random(9)
    made = [(k, " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(12))) for k in range(12)]
    rows = [(100 + k, f"start {t} end") for k, t in made if k % 2] + [(1, "nothing")]
    got = {(r.doc_id, r.item_id) for r in D.contamination(docs(spark, rows), items(spark, made)).collect()}
    assert got == {(100 + k, k) for k, _ in made if k % 2}
    assert [r.doc_id for r in D.without_benchmark(docs(spark, rows), items(spark, made)).collect()] == [1]


def test_empty_tables(spark):
    assert D.contamination(docs(spark, []), items(spark, [(1, ITEM)])).count() == 0
    assert D.contamination(docs(spark, [(1, ITEM)]), items(spark, [])).count() == 0
    assert D.without_benchmark(docs(spark, [(1, ITEM)]), items(spark, [])).count() == 1


def test_a_run_of_passage_length_is_found_wherever_it_starts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    for words in (25, 26, 60, 151):
        item = [word() for _ in range(words)]
        matcher = D.Matcher([(1, " ".join(item))])
        for start in range(words - D.PASSAGE_WORDS + 1):
            run = " ".join(item[start : start + D.PASSAGE_WORDS])
            assert matcher.find(f"{word()} {word()} {run} {word()} {word()}")[0][1] >= 1


def test_long_items_equal_brute_force():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 7)))
    seen = []
    for _ in range(60):
        item = [word() for _ in range(rng.randint(25, 40))]
        start = rng.randrange(len(item) - 20)
        run = list(" ".join(item[start : start + rng.randint(20, 32)]))
        for _ in range(rng.randint(0, 14)):
            k = rng.randrange(len(run))
            run[k] = rng.choice(["", "x", run[k] + "q"])
        line = D.padded(f"{word()} {word()} {''.join(run)} {word()} {word()}")
        parts = [" ".join(item[k : k + D.PASSAGE_WORDS]) for k in range(len(item) - D.PASSAGE_WORDS + 1)]
        near = sum(plain_distance(p, line[1:-1]) <= D.budget(p) for p in parts)
        whole = D.padded(" ".join(item))
        best = plain_distance(whole, line)
        expected = {0: (best if best <= D.budget(whole) else None, near)} if near or best <= D.budget(whole) else {}
        assert D.Matcher([(1, " ".join(item))]).find(line) == expected
        seen.append(bool(near))
    assert 15 < sum(seen) < 50


def test_whole_items_of_any_length_keep_the_budget():
    """One rule from one word to hundreds: k edits are found, and what brute force finds."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 7)))
    for words in (1, 2, 3, 5, 24, 25, 26, 120):
        for _ in range(12):
            item = " ".join(word() for _ in range(words))
            line = D.padded(item)
            s = list(item)
            for _ in range(rng.randint(0, D.budget(line) + 1)):
                k = rng.randrange(len(s))
                s[k] = rng.choice(["", "x", s[k] + "q"])
            text = D.padded(f"zz {''.join(s)} zz")
            best = D.Passage.of(0, line).distance(text)
            found = D.Matcher([(1, item)]).find(text).get(0, (None, 0))
            assert found[0] == (best if best <= D.budget(line) else None)


def test_query_equals_brute_force_over_whole_tables(spark, data):
    """Every document against every item, without pieces: Myers over the whole text."""
    texts = {r.doc_id: D.padded(r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    bench = {r.item_id: D.padded(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    expected = {}
    for i, line in bench.items():
        p = D.Passage.of(0, line)
        for d, text in texts.items():
            if (best := p.distance(text)) <= p.errors:
                expected[d, i] = best
    got = q_decontaminate.query(spark, data).collect()
    assert {(r.doc_id, r.item_id): r.distance for r in got if r.whole} == expected and expected
    for r in got:
        words = bench[r.item_id].split()
        if not r.whole:
            parts = [" ".join(words[k : k + D.PASSAGE_WORDS]) for k in range(len(words) - D.PASSAGE_WORDS + 1)]
            assert r.passages == sum(D.Passage.of(0, p).distance(texts[r.doc_id][1:-1]) <= D.budget(p) for p in parts) > 0
