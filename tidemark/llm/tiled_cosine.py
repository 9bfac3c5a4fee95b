"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are normed and turned into the axes of a principal component analysis, so that the leading
dimensions hold most of what tells them apart. Two unit vectors with cosine t or more are at most
sqrt(2 - 2t) apart, in every axis, so each label's vectors are dealt into cells of that width along
the first axes and only neighbouring cells meet. Cells are cut into tiles of bounded size. A pair of
tiles is compared as matrix products over the leading dimensions first; the product of the rest is
at most the product of both suffix norms, and a pair is dropped as soon as that bound cannot lift it
to the threshold. What is left is verified on the vectors as they came, in double precision.
Identical vectors are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .shared import bounded_sample, cut, hot_join, written

THRESHOLD = 0.98
#: Vectors in a tile, about; leading axes that are dealt into cells; dimensions in a step.
TILE = 512
CELL_AXES = 3
STEPS = (8, 16, 32)
#: Vectors that the axes are computed from. Any axes give right results; good ones prune more.
AXES_SAMPLE = 4000
#: Room for rounding when a bound is tested; the verification decides.
SLACK = 1e-6


def principal_axes(sample: np.ndarray, dim: int) -> np.ndarray:
    """Orthonormal axes as columns, by falling spread of the sample."""
    if len(sample) < 2:
        return np.eye(dim)
    values, vectors = np.linalg.eigh(np.cov(sample, rowvar=False))
    return vectors[:, np.argsort(-values, kind="stable")]


def close_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows whose products can reach the threshold (and all that do).

    Rows are unit vectors in PCA order. After each step of leading dimensions the bound by the
    suffix norms decides which pairs go on.
    """
    dim = a.shape[1]
    rest_a = np.sqrt(np.maximum(np.cumsum((a * a)[:, ::-1], axis=1)[:, ::-1], 0))
    rest_b = np.sqrt(np.maximum(np.cumsum((b * b)[:, ::-1], axis=1)[:, ::-1], 0))
    edges = [0, *(s for s in STEPS if s < dim), dim]
    head = a[:, : edges[1]] @ b[:, : edges[1]].T
    if edges[1] < dim:
        head_bound = head + np.outer(rest_a[:, edges[1]], rest_b[:, edges[1]])
        i, j = np.nonzero(head_bound >= threshold - SLACK)
    else:
        i, j = np.nonzero(head >= threshold - SLACK)
    sums = head[i, j]
    for lo, hi in zip(edges[1:], edges[2:]):
        sums = sums + np.einsum("ij,ij->i", a[i, lo:hi], b[j, lo:hi])
        bound = sums + (rest_a[i, hi] * rest_b[j, hi] if hi < dim else 0)
        keep = bound >= threshold - SLACK
        i, j, sums = i[keep], j[keep], sums[keep]
    return i, j


def _usable() -> Column:
    """Whether a row's vector can link: label and vector not null, all components finite, not zero."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return F.coalesce(F.col("label").isNotNull() & ~bad & some, F.lit(False))


def _axes(nodes: DataFrame) -> Broadcast:
    """Axes for every number of dimensions, from a bounded sample of vectors."""
    sized = nodes.select(F.size("embedding").alias("dim"), "embedding")
    counts = dict(sized.groupBy("dim").count().collect())
    rows = bounded_sample(sized, "dim", counts, AXES_SAMPLE).collect()
    found = {}
    for dim in counts:
        found[dim] = principal_axes(_turn(np.array([r.embedding for r in rows if r.dim == dim], float), np.eye(dim)), dim)
    return nodes.sparkSession.sparkContext.broadcast(found)


def _turn(raw: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit vectors in PCA order of rows in double precision."""
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)) @ axes


def _placed(nodes: DataFrame, axes: Broadcast, threshold: float) -> DataFrame:
    """Adds each vector's cell along the first axes, with its number of dimensions."""
    width = float(np.sqrt(max(2 - 2 * threshold, 0)) * (1 + 1e-6) + 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for v in batch.column(2):
                x = v.values.to_numpy().astype(float)[None, :]
                cells.append([x.shape[1], *np.floor(_turn(x, axes.value[x.shape[1]])[0, :CELL_AXES] / width).astype(int).tolist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], ["label", "node", "embedding", "n", "cell"])

    columns = nodes.select("label", "node", "embedding", "n")
    return columns.mapInArrow(run, T.StructType([*columns.schema.fields, T.StructField("cell", T.ArrayType(T.IntegerType()))]))


def _tiles(placed: DataFrame) -> DataFrame:
    """(tile, label, cell, nodes, copies, raw): cells cut into tiles of about TILE vectors by a hash of the node."""
    sizes = placed.groupBy("label", "cell").agg(F.count("*").alias("crowd"))
    dealt = placed.join(sizes, ["label", "cell"]).withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("crowd") / TILE)))
    held = dealt.groupBy("label", "cell", "part").agg(F.collect_list(F.struct("node", "n", "embedding")).alias("m"))
    named = F.concat_ws("/", F.col("label").cast("string"), F.array_join(F.transform("cell", lambda c: c.cast("string")), ","), F.col("part").cast("string"))
    return held.select(named.alias("tile"), "label", "cell", F.col("m.node").alias("nodes"), F.col("m.n").alias("copies"), F.flatten("m.embedding").alias("raw"))


def _meet(tiles: DataFrame) -> DataFrame:
    """Pairs of tiles whose cells are the same or touch, each pair once, with the vectors of both.

    The pairs are found on names and cells alone.
    """
    shifts = F.array(*[F.array(*[F.lit(k) for k in (0, *s)]) for s in product((-1, 0, 1), repeat=CELL_AXES)])
    # A cell of fewer axes than the shifts have takes the first of each.
    shifted = F.array_distinct(F.transform(shifts, lambda s: F.transform(F.arrays_zip(F.col("cell").alias("c"), F.slice(s, F.lit(1), F.size("cell")).alias("d")), lambda x: x["c"] + x["d"])))
    left = tiles.select("label", F.col("tile").alias("tile_a"), F.explode(shifted).alias("cell"))
    pairs = left.join(tiles.select("label", "cell", F.col("tile").alias("tile_b")), ["label", "cell"]).where("tile_a <= tile_b").select("tile_a", "tile_b").distinct()
    side = lambda s: tiles.select(F.col("tile").alias(f"tile_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("nodes", "copies", "raw")])
    return pairs.join(side("a"), "tile_a").join(side("b"), "tile_b")


def _joined(i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
    """Least index that each of ``size`` places reaches over the links (i, j)."""
    least = np.arange(size)
    while True:
        new = least.copy()
        np.minimum.at(new, i, least[j])
        np.minimum.at(new, j, least[i])
        new = new[new]
        if (new == least).all():
            return least
        least = new


def _compare(pairs: DataFrame, axes: Broadcast, threshold: float) -> DataFrame:
    """(a, b, m) from the verified links of each pair of tiles, as many rows as the tiles have
    vectors and not as they have links: m copies that node a links with, where b is null; and links
    (a, b) that join what the tiles' links join."""
    names = ("nodes_a", "copies_a", "raw_a", "nodes_b", "copies_b", "raw_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids_a, n_a, raw_a, ids_b, n_b, raw_b = (batch.column(name)[k].values.to_numpy(zero_copy_only=False) for name in names)
                raw_a, raw_b = raw_a.astype(float).reshape(len(ids_a), -1), raw_b.astype(float).reshape(len(ids_b), -1)
                turn = axes.value[raw_a.shape[1]]
                i, j = close_pairs(_turn(raw_a, turn), _turn(raw_b, turn), threshold)
                same = batch.column("same")[k].as_py()
                if same:
                    i, j = i[ids_a[i] < ids_b[j]], j[ids_a[i] < ids_b[j]]
                sure = []
                for at in range(0, len(i), 1 << 16):
                    x, y = raw_a[i[at : at + (1 << 16)]], raw_b[j[at : at + (1 << 16)]]
                    sure.append(np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y)) >= threshold)
                if not sure:
                    continue
                keep = np.concatenate(sure)
                i, j = i[keep], j[keep]
                if not len(i):
                    continue
                ids, copies, shift = (ids_a, n_a, 0) if same else (np.concatenate([ids_a, ids_b]), np.concatenate([n_a, n_b]), len(ids_a))
                j = j + shift
                partners = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
                least = _joined(i, j, len(ids))
                some, moved = np.flatnonzero(partners), np.flatnonzero(least != np.arange(len(ids)))
                ends = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(ids[least[moved]])])
                counts = np.concatenate([partners[some].astype(np.int64), np.zeros(len(moved), np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[some], ids[moved]])), ends, pa.array(counts)], ["a", "b", "m"])

    return pairs.select((F.col("tile_a") == F.col("tile_b")).alias("same"), *names).mapInArrow(run, "a long, b long, m long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors link if their labels are equal and not null and their cosine, in double precision, is at
    least ``threshold``. Null, zero, or partly null or non-finite vectors, and those of different
    dimensions, link with nothing. Rows with the same vec_id are rows of their own, with links to
    each other if their vectors link. A null vec_id is kept: it links, and its component is the
    least id it reaches, or null. Other columns are ignored; an empty table gives no rows.
    """
    exact = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(exact).alias("embedding"), "label")
    usable = rows.where(_usable())
    # Zeros of either sign are equal; identical vectors are counted once.
    plain = usable.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)).cast(exact))
    key = (F.xxhash64("label", "embedding"), F.xxhash64(F.lit(1), "embedding", "label"))
    marked = cut(plain.select("vec_id", "label", "embedding", key[0].alias("k1"), key[1].alias("k2")))
    groups = marked.groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.min(F.struct("label", "embedding")).alias("v"))
    # Numbers, fixed by the checkpoint, name the vectors: 128 bits tell them apart.
    nodes = cut(groups.select("k1", "k2", "least", "n", F.monotonically_increasing_id().alias("node"), "v.label", "v.embedding"))
    axes = _axes(nodes)
    tiles = written(_tiles(_placed(nodes, axes, threshold)), "cosine-tiles")
    links = cut(_compare(_meet(tiles), axes, threshold))
    others = links.groupBy(F.col("a").alias("node")).agg(F.sum("m").alias("m"))
    placed = nodes.select("node", "n", "least").join(connected_components(links.select("a", "b")), "node", "left").withColumn("component", F.coalesce("component", "node"))
    roots = placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("of"))
    rooted = hot_join(placed, roots, ["component"], "of", nodes.count())
    facts = rooted.join(others, "node", "left").select("node", "component_id", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"))
    known = nodes.select("k1", "k2", "n", "node").join(facts, "node")
    linked = hot_join(marked.select("vec_id", "k1", "k2"), known, ["k1", "k2"], "n", marked.count()).select("vec_id", "n_links", "component_id")
    single = rows.where(~_usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(single).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
