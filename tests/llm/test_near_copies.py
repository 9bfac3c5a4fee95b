import random
from pathlib import Path

import corpus_pipeline as P
import pytest

from tidemark.llm import near_copies as N
from tidemark.llm.components import connected_components
from tidemark.llm.shared import shared_folder

SCHEMA = "doc_id long, text string"


def plain(rows):
    def parts(text):
        w = (text or "").lower().split()
        k = min(5, len(w))
        return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    sets = {d: parts(t) for d, t in rows}
    near = lambda a, b: a == b or len(a & b) * 5 >= len(a | b) * 4
    of, left = {}, set(sets)
    while left:
        least = min(left)
        group, edge = set(), {least}
        while edge:
            group |= edge
            edge = {d for d in left - group if any(near(sets[d], sets[e]) for e in edge)}
        of |= dict.fromkeys(group, least)
        left -= group
    return of


def made(seed, copies):
    """Chains of edited copies, a crowd around the limit, odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(5))
    texts = [None, "", "  \t", "one two", "One  two", "a b c d e", "a b c d e f"]
    for _ in range(12):
        line = [word() for _ in range(rng.randint(20, 300))]
        for _ in range(4):
            texts.append(" ".join(line))
            line = [word() if rng.random() < 0.02 else w for w in line]
    base = [word() for _ in range(120)]
    for _ in range(copies):
        texts.append(" ".join(word() if rng.random() < 0.025 else w for w in base))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("rounds", [0, 3])
def test_components_equal_brute_force(spark, monkeypatch, rounds):
    monkeypatch.setattr(N, "ROUNDS", rounds)
    rows = made(7, 60)
    expected = plain(rows)
    got = {r.doc_id: r.component_id for r in N.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == expected and 10 < len(set(expected.values())) < len(rows) - 40


def test_rows_and_ids(spark):
    rows = [(4, "x y z"), (4, "x y z"), (None, "x y z"), (None, "lonely"), (9, "X  Y z"), (9, "other words")]
    got = sorted(((r.doc_id, r.component_id) for r in N.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(4, 4), (4, 4), (None, 4), (None, None), (9, 4), (9, 9)], key=str)
    assert N.near_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stage_drops_edited_copies(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    expected = set(plain([(r.doc_id, r.text) for r in docs.collect()]).values())
    assert {r.doc_id for r in P.drop_near_duplicates(spark, docs, data).collect()} == expected


def test_pages_of_one_template_are_not_compared_in_pairs(spark, monkeypatch):
    """300 texts that share most of their words, but less than the limit, beside copies of some of them."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(6))
    template = [word() for _ in range(160)]
    texts = [" ".join(template[:80] + [word() for _ in range(34)] + template[80:]) for _ in range(300)]
    texts += [t + " " + word() for t in texts[:20]] + ["some passage " * 3 + " ".join(template[:40])]
    rows = list(enumerate(texts))
    seen, real = [], N._verified
    monkeypatch.setattr(N, "_verified", lambda pairs, *rest: seen.append(pairs.count()) or real(pairs, *rest))
    got = {r.doc_id: r.component_id for r in N.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == plain(rows)
    # A pivot round costs a text its keys at most; the prefixes then leave next to nothing.
    assert sum(seen[:-1]) < N.ROUNDS * N.BANDS * len(rows) and seen[-1] < len(rows), seen


def test_prefixes_are_exact(spark, monkeypatch):
    """Without any round of pivots, sets around the limit over few different words."""
    monkeypatch.setattr(N, "ROUNDS", 0)
    rng = random.Random(12)
    rows = [(k, " ".join(rng.choice("ab") for _ in range(rng.randint(1, 12)))) for k in range(400)]
    expected = plain(rows)
    assert {r.doc_id: r.component_id for r in N.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()} == expected


def test_edited_copies_of_one_text_are_linked_by_few_comparisons(spark, monkeypatch):
    """A large group of copies with an edit or two each: what earlier rounds leave apart is not compared with all of it."""
    monkeypatch.setattr(N, "ROUNDS", 0)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(250):
        line = list(base)
        for _ in range(1 if k % 25 == 0 else 2):
            line[rng.randrange(150)] = f"x{rng.randrange(12)}"
        rows.append((k, " ".join(line)))
    seen, real = [], N._verified
    monkeypatch.setattr(N, "_verified", lambda pairs, *rest: seen.append(pairs.count()) or real(pairs, *rest))
    got = {r.doc_id: r.component_id for r in N.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == plain(rows)
    assert seen[-1] == 0, seen


def test_few_rows_leave_few_files(spark):
    """What goes from step to step is made in as many tasks as its rows need, whatever the number of shuffle partitions."""
    rows = made(9, 30)
    folder = Path(shared_folder(spark).removeprefix("file://"))
    parts = lambda: {f for f in folder.rglob("part-*")}
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    held = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        before = parts()
        got = {r.doc_id: r.component_id for r in N.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
        made_now = len(parts() - before)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert got == plain(rows)
    # Before: 1166.
    assert made_now < 300, made_now


def test_components_of_few_links_take_few_tasks(spark):
    """Every step was dealt to all shuffle partitions; the reports of so many tasks fill the driver."""
    links = spark.createDataFrame([(k, k + 1) for k in range(300) if k % 60 != 59], "a long, b long")
    before, context = spark.conf.get("spark.sql.shuffle.partitions"), spark.sparkContext
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        context.setJobGroup("few-links", "")
        got = {(r.node, r.component) for r in connected_components(links, 300).collect()}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {(k, k // 60 * 60) for k in range(300)}
    tracker = context.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup("few-links") for s in tracker.getJobInfo(job).stageIds}
    assert stages and sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s))) < 200


def test_texts_at_the_limit_need_no_luck(spark, monkeypatch):
    """Pairs just at the limit share keys of hashes by chance only; without any such key the exact join finds all."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(7))
    rows = []
    for k in range(40):
        line = [word() for _ in range(49)]
        # 45 shingles, 40 in common of 50; every other copy has 39 of 51.
        rows += [(2 * k, " ".join(line)), (2 * k + 1, " ".join(line[: 44 - k % 2] + [word() for _ in range(5 + k % 2)]))]
    expected = plain(rows)
    assert len(set(expected.values())) == 60
    monkeypatch.setattr(N, "ROUNDS", 0)
    assert {r.doc_id: r.component_id for r in N.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()} == expected


def test_fingerprints_link_edited_copies(spark):
    """The stage's links come from SimHash: copies of a text lie within its radius, other texts far outside, and share keys."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(6))
    base = [[word() for _ in range(200)] for _ in range(40)]
    texts = [" ".join(b) for b in base] + [" ".join(b[:100] + [word()] + b[101:]) for b in base]
    sets = [N.shingles(t) for t in texts]
    bits = [N._fingerprint(x) for x in sets]
    apart = lambda x, y: sum(((int(a) ^ int(b)) & (1 << 64) - 1).bit_count() for a, b in zip(x, y))
    assert all(apart(bits[k], bits[k + 40]) <= N.RADIUS < apart(bits[k], bits[(k + 1) % 40]) for k in range(40))
    nodes = spark.createDataFrame([(k, len(sets[k]), b.tolist()) for k, b in enumerate(bits)], "node long, n long, bits array<long>")
    assert {tuple(r) for r in N._fingerprint_pairs(nodes, 80, 80).collect()} == {(k, k + 40) for k in range(40)}
