import numpy as np
import xxhash

from tidemark.llm import q_simhash, simhash
from tidemark.llm.components import connected_components

SCHEMA = "doc_id long, text string, fp string, component string"


def plain_fingerprint(text):
    words = [w for w in __import__("re").split("[ \t\n\x0b\x0c\r]+", "".join(c.lower() if c < "\x80" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute(found):
    """id -> least id reachable over links of at most two bits, from (id, fingerprint) rows."""
    rows = list(found)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k)) for k in range(len(rows))]


def test_fingerprints(spark):
    texts = ["", None, "  \n", "One", "a b", "A b\tC", "É é x y z" * 9, "the cat sat on the mat " * 4000]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_components_equal_brute_force(spark, data):
    got = q_simhash.query(spark, data).collect()
    rows = [(r.doc_id, int(r.fingerprint, 16)) for r in got]
    assert [r.component_id for r in got] == brute(rows)


def test_crowded_buckets_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2**63, 3)]
    fps = {b ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False)) for b in base for _ in range(60)}
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    df = spark.createDataFrame([(simhash._signed(f),) for _, f in rows], "fp long")
    expected = brute(rows)
    for crowd in (256, 3):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        links = simhash.fingerprint_links(df)
        place = {simhash._signed(f): i for i, f in rows}
        parts = {place[r.node]: place[r.component] for r in connected_components(links).collect()}
        groups = {}
        for i, _ in rows:
            groups.setdefault(parts.get(i, i), []).append(i)
        assert sorted(map(min, groups.values())) == sorted(set(expected)) and sorted(map(len, groups.values())) == sorted(np.unique(expected, return_counts=True)[1].tolist())


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(5, None, "x", "y"), (3, "", "x", "y"), (None, " ", "x", "y"), (7, "same words here now", "x", "y"), (7, "same words here now", "x", "y"), (None, "quite another text", "x", "y")]
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (None, 3), (7, 7), (7, 7), (None, None)], key=str)
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(201, 202), (202, 203), (203, 201), (7, 7), (None, 1)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {i: 201 for i in (201, 202, 203)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
