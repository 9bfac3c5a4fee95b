import numpy as np
import pytest

from tidemark.llm import q_tiled_cosine
from tidemark.llm import tiled_cosine as C

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, node string"


def brute(rows, threshold=0.98):
    """(id, links, component) of every row, by comparing all pairs."""
    x = [None if v is None or any(e is None for e in v) else np.array(v, np.float32).astype(float) for _, v, _ in rows]
    fine = [v is not None and len(v) > 0 and np.isfinite(v).all() and (v != 0).any() for v in x]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if fine[i] and fine[j] and rows[i][2] is not None and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]):
                if x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, links[k], least.get(find(k))) for k, (i, _, _) in enumerate(rows)), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(i, None if v is None else [None if e is None else float(e) for e in v], lab, "x", "y") for i, v, lab in rows], SCHEMA)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in C.near_duplicates(df).collect()), key=str)


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(max(1, n // 6), dim))
    rows = []
    for k in range(n):
        v = base[rng.integers(len(base))] + rng.normal(0, rng.choice([0.0, 0.02, 0.1, 0.2]), dim)
        rows.append((k, (v * rng.choice([1, 3, 1e-3])).tolist(), int(rng.integers(0, 3))))
    return rows


@pytest.mark.parametrize(("dim", "tile"), [(16, 512), (16, 7), (3, 5), (40, 20)])
def test_links_equal_brute_force(spark, monkeypatch, dim, tile):
    monkeypatch.setattr(C, "TILE", tile)
    rows = vectors(150, dim, dim + tile)
    assert run(spark, rows) == brute(rows)


def test_odd_vectors_copies_and_nulls(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [
        (9, v, 1), (4, v, 1), (4, v, 1), (None, v, 1), (5, [2.0, 4.0, 6.0, 8.0], 1), (6, v, 2), (7, v, None), (8, None, 1), (10, [0.0] * 4, 1), (11, [0.0, -0.0, 0.0, 0.0], 1),
        (12, [1.0, None, 3.0, 4.0], 1), (13, [float("nan"), 1.0, 1.0, 1.0], 1), (14, [float("inf"), 1.0, 1.0, 1.0], 1), (15, [1.0, 2.0], 1), (16, [], 1), (17, [-1.0, -2.0, -3.0, -4.0], 1), (18, [0.0, 0.0, 0.0, 1e-30], 3), (19, [-0.0, 0.0, 0.0, 2e-30], 3),
    ]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_all_embeddings_equal_brute_force(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    got = q_tiled_cosine.query(spark, data).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute([(r.vec_id, r.embedding, r.label) for r in table])
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_bounds_drop_no_pair():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(80, 24)) * np.linspace(3, 0.1, 24)
    b = a[rng.integers(0, 80, 60)] + rng.normal(0, 0.1, (60, 24))
    a, b = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (a, b))
    for t in (0.9, 0.98, 0.999):
        i, j = C.close_pairs(a, b, t)
        assert set(zip(*np.nonzero(a @ b.T >= t))) <= set(zip(i.tolist(), j.tolist()))
        assert (a[i] * b[j]).sum(axis=1).min(initial=1) >= t - 1e-5
