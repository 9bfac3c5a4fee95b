"""SimHash near-duplicates found by pigeonhole blocks.

Fingerprints are split into ``BLOCKS`` blocks. Two that differ in at most ``BITS`` bits agree in at
least ``BLOCKS - BITS`` whole blocks, so they meet under one of the block combinations as join key;
then the Hamming distance is verified. Equal fingerprints are one node from the start. A bucket of
more than ``CROWD`` fingerprints is not paired: its members are dealt again under every pair of
bits outside the agreed blocks, with those two bits cleared. At most four different fingerprints
share such a key, and all that do are within two bits, so nothing is lost and the work stays linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import cut, hot_join, lean

SEED = 42
BITS = 2
#: Widths of the blocks, from the lowest bit up.
WIDTHS = (13, 13, 13, 13, 12)
CROWD = 256
#: Shingles whose bits are unpacked at once.
_CHUNK = 8192


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint as an unsigned number; 0 for null texts and texts without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    width = min(shingle, len(words))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in spans], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits((counts * 2 > len(hashes)).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_signed(fingerprint(t.as_py())) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of whole texts; fp is the fingerprint as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_fingerprints), "doc_id long, fp long")


def _combinations() -> list[tuple[int, list[int]]]:
    """For each choice of blocks that must agree: the mask of their bits and the bits outside."""
    edges = np.cumsum((0, *WIDTHS)).tolist()
    blocks = [range(a, b) for a, b in zip(edges, edges[1:])]
    found = []
    for kept in combinations(range(len(blocks)), len(blocks) - BITS):
        inside = [i for k in kept for i in blocks[k]]
        found.append((_signed(sum(1 << i for i in inside)), [i for i in range(64) if i not in set(inside)]))
    return found


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) within two bits; enough of them to join
    whatever is linked, each verified."""
    combos = _combinations()
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m, _ in combos])
    dealt = distinct.select("fp", F.posexplode(keys).alias("combo", "key"))
    crowds = dealt.groupBy("combo", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(hot_join(dealt, crowds, ["combo", "key"], "n", distinct.count() * len(combos)).select("combo", "key", "fp", "n"))
    few = met.where(F.col("n") <= CROWD)
    other = few.select("combo", "key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= BITS
    pairs = few.join(other, (few.combo == other.combo) & (few.key == other.key) & (few.fp < other.b) & near).select(few.fp.alias("a"), "b")
    masks = F.array(*[F.array(*[F.lit(_signed((1 << i) | (1 << j))) for i, j in combinations(free, 2)]) for _, free in combos])
    cleared = (
        met.where(F.col("n") > CROWD)
        .select("fp", F.explode(F.element_at(masks, F.col("combo") + 1)).alias("mask"))
        .select("fp", "mask", F.col("fp").bitwiseAND(F.bitwise_not("mask")).alias("rest"))
        .groupBy("mask", "rest")
        .agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all"))
        .where(F.size("all") > 1)
    )
    crowded = cleared.select("a", F.explode("all").alias("b")).where("a <> b")
    return pairs.union(crowded).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fp, component_id (least doc_id reachable over links).

    Null, empty and wordless texts have fingerprint zero and are linked like any other. Repeated
    rows stay. A null doc_id is kept; its component is the least id of its group, or null. Columns
    other than doc_id and text are ignored. An empty table gives no rows.
    """
    marked = cut(fingerprints(docs))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    groups = connected_components(fingerprint_links(nodes.select("fp")))
    placed = nodes.join(groups, nodes.fp == groups.node, "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("component"))
    roots = placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("of"))
    known = hot_join(placed, roots, ["component"], "of", nodes.count()).select("fp", "n", "component_id")
    return hot_join(marked, known, ["fp"], "n", marked.count()).select("doc_id", "fp", "component_id")
