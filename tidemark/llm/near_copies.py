"""Near copies: SimHash of word shingles, and every link verified by the exact Jaccard similarity.

Fingerprints. A text's set of shingles has a SimHash of ``WORDS`` times 64 bits. ``BANDS`` choices of its
bits, as many in each as the number of texts calls for, are keys. In each bucket all members within
``RADIUS`` bits of one of ``ROUNDS`` members are compared with it, so a bucket of copies of one text takes
work in proportion to its size. Equal sets are one node from the start, named by 128 bits and numbered.

The rest. Two sets of similarity 0.8 agree in so few whole keys of fingerprints that some would be missed.
What fingerprints leave apart is therefore joined exactly: of a set's shingles, put in one order for all
texts, the first n - ceil(n * s) + 1 are keys, and two sets that are similar enough share one. Any order
does; shingles that are frequent in a sample of texts stand last, so that few sets share a key that are not
similar. Sets that have few of their first shingles in common cannot be similar and go without being read.

Crowds. Members of keys that more than ``CROWD`` sets share and that are not one component by then (pages of
one template, texts with one common passage) are joined by prefixes in order of rarity among themselves: what
such crowds have in common is frequent, so it stands last and is no key. Before that join, ``PREFIX_ROUNDS``
rounds of pivots go over the same keys, each with a pivot for ``DEALT`` members and ``TRIES`` ways to deal them
at most, so that a set which is similar to many of a component is linked to it by few comparisons; only what
they leave apart is joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import ROWS_PER_TASK, cut, hot_join, lean, shuffles_dropped, text_mark, written

SHINGLE = 5
#: Least similarity, in hundredths.
SIMILARITY = 80
#: 64-bit words of a fingerprint, its keys, and the bits in which two may differ that are compared.
WORDS, BANDS, RADIUS = 4, 32, 56
#: Members of a fingerprint key with which the others are compared.
ROUNDS = 2
#: Bits that a fingerprint key has beyond those that number the texts.
MORE_BITS = 4
#: Most sets that are compared in pairs because they share one key of the exact join.
CROWD = 128
PREFIX_ROUNDS = 2
#: Members of a prefix key that are compared with one of them, and how often a large key's are dealt in a round.
DEALT, TRIES = 16, 3
#: Texts, about, from which frequent shingles are learnt, how many of them have one at least, and most shingles that
#: are listed. They set the order of keys only; whatever they are, the join is exact.
SAMPLE, OFTEN, LISTED = 16_000, 3, 1 << 16
#: Keys that are looked through at once for those that several sets have.
BLOCK = 1 << 17
#: Pairs whose sets one task compares.
PAIRS_PER_TASK = 5_000
#: Sets of a crowd whose shingles one task deals.
SETS_PER_TASK = 100
#: Most bits of a map of marks that tells which texts are read again.
FILTER = 1 << 25
#: So few nodes are looked up by broadcast.
FEW = 20_000
SEED = 42
#: Shingles whose bits are unpacked at once.
_CHUNK = 4096
#: Keys are 40 bits of a hash, so they take little room; that different ones meet costs a comparison only.
_KEY_BYTES, _KEY_SHIFT = 5, 24


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct word shingles; a shorter text is one shingle, no words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    width = min(width, len(words))
    spans = zip((ends - sizes)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in spans], "<u8"))


def _name(found: np.ndarray) -> bytes:
    """128 bits that name a set of shingles."""
    return xxhash.xxh3_128_digest(found.tobytes())


def _fingerprint(found: np.ndarray) -> np.ndarray:
    """The SimHash of a set of shingles in signed words: a bit is 1 if it is set in over half of them."""
    counts = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(found), _CHUNK):
        z = found[at : at + _CHUNK, None] + np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        counts += np.unpackbits(z.astype("<u8").view(np.uint8).reshape(-1, 8 * WORDS), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits((counts * 2 > len(found)).astype(np.uint8), bitorder="little").view("<i8")


def _prefix(found: np.ndarray, often: np.ndarray, counts: np.ndarray, similarity: int) -> bytes:
    """Keys of the first n - ceil(n * s) + 1 shingles, those that are ``often`` found last, in order of ``counts``."""
    n = len(found)
    if n and len(often):
        at = np.minimum(np.searchsorted(often, found), len(often) - 1)
        found = found[np.argsort(np.where(often[at] == found, counts[at], 0), kind="stable")]
    first = found[: n - (n * similarity + 99) // 100 + 1] if n else found
    return (first >> np.uint64(_KEY_SHIFT)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_KEY_BYTES].tobytes()


def _frequent(docs: DataFrame, width: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that several texts of a sample have, and how many do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                found = [shingles(t.as_py(), width).view("<i8") for t in batch.column(0).slice(at, 64)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found), pa.int64())], ["key"])

    share = int(min(1.0, SAMPLE / max(1, total)) * (1 << 20)) + 1
    texts = docs.where(F.pmod(F.xxhash64("mark"), F.lit(1 << 20)) < share).groupBy("mark").agg(F.min("text").alias("text"))
    counted = texts.select("text").mapInArrow(lean(run), "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    listed = counted.orderBy(F.desc("n"), "key").limit(LISTED).toArrow()
    keys, counts = listed.column("key").to_numpy().astype("<i8").view("<u8"), listed.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def _sketches(docs: DataFrame, width: int, similarity: int, total: int) -> DataFrame:
    often, counts = _frequent(docs, width, total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sets = [shingles(text.as_py(), width) for text in part.column(2)]
                made = [
                    part.column(0), part.column(1), pa.array([_name(x) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([_fingerprint(x) for x in sets], pa.list_(pa.int64())), pa.array([_prefix(x, often, counts, similarity) for x in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(made, ["doc_id", "mark", "name", "n", "bits", "keys"])

    return docs.select("doc_id", "mark", "text").mapInArrow(lean(run), "doc_id long, mark string, name binary, n long, bits array<long>, keys binary")


def _bit_keys(bits: str, total: int) -> Column:
    """The keys of a fingerprint: choices of its bits, more of them for more texts."""
    chosen, wide = np.random.default_rng(SEED), 64 * WORDS
    keys = []
    for k in range(BANDS):
        mask = np.zeros(wide, np.uint8)
        mask[chosen.permutation(wide)[: min(wide // 4, max(8, total.bit_length()) + MORE_BITS)]] = 1
        words = np.packbits(mask, bitorder="little").view("<i8").tolist()
        keys.append(F.xxhash64(F.lit(k), *[F.get(bits, F.lit(j)).bitwiseAND(F.lit(w)) for j, w in enumerate(words)]))
    return F.array(*keys)


#: Bytes of a row of ``_shared``: key, node, n, place.
_WIDTHS = (_KEY_BYTES, 8, 4, 2)


def _packed(columns: list[np.ndarray]) -> bytes:
    """The low bytes of whole numbers, first bytes of all rows first, so that what repeats stands together."""
    return b"".join(c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w].T.tobytes() for c, w in zip(columns, _WIDTHS))


def _unpacked(parts: list[bytes]) -> list[np.ndarray]:
    found: list[list[np.ndarray]] = [[] for _ in _WIDTHS]
    for part in parts:
        planes, at = np.frombuffer(part, np.uint8).reshape(sum(_WIDTHS), -1), 0
        for column, width in zip(found, _WIDTHS):
            wide = np.zeros((planes.shape[1], 8), np.uint8)
            wide[:, :width] = planes[at : at + width].T
            column.append(wide.view("<i8")[:, 0])
            at += width
    return [np.concatenate(column) for column in found]


def _flat(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All keys of rows of whole hashes or of packed keys, and how many each row has."""
    if pa.types.is_list(keys.type):
        return keys.flatten().to_numpy().view("<u8") >> np.uint64(_KEY_SHIFT), keys.value_lengths().to_numpy().astype(np.int64)
    held = keys.to_pylist()
    sizes = np.array([len(k) // _KEY_BYTES for k in held])
    wide = np.zeros((sizes.sum(), 8), np.uint8)
    wide[:, :_KEY_BYTES] = np.frombuffer(b"".join(held), np.uint8).reshape(-1, _KEY_BYTES)
    return wide.view("<u8")[:, 0], sizes


def _shared(nodes: DataFrame, n_keys: int) -> DataFrame:
    """(key, node, n, place, of): the keys of ``nodes`` (node, n, keys), ``n_keys`` of them, that several have.

    ``place`` counts a node's keys up to this one (no further than two bytes do), ``of`` the rows of a key. Keys
    are dealt to blocks in a packed form, so that those which one node alone has, nearly all, cost few bytes.
    """
    blocks = 1 + n_keys // BLOCK

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keys, sizes = _flat(part.column(2))
                place = np.arange(1, len(keys) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                columns = [keys, *[np.repeat(part.column(c).to_numpy(), sizes) for c in (0, 1)], np.minimum(place, 65535)]
                block = (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(blocks)
                order = np.argsort(block, kind="stable")
                columns, (found, first) = [c[order] for c in columns], np.unique(block[order], return_index=True)
                rows = [_packed([c[a:b] for c in columns]) for a, b in zip(first, [*first[1:], len(keys)])]
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64), pa.int64()), pa.array(rows, pa.binary())], ["block", "packed"])

    def meet(table: pa.Table) -> pa.Table:
        columns = _unpacked(table.column("packed").to_pylist())
        _, inverse, of = np.unique(columns[0], return_inverse=True, return_counts=True)
        of = of[inverse]
        return pa.table([pa.array(c[of > 1], pa.int64()) for c in (*columns, of)], ["key", "node", "n", "place", "of"])

    dealt = nodes.select("node", "n", "keys").mapInArrow(lean(deal), "block long, packed binary")
    return dealt.groupBy("block").applyInArrow(meet, "key long, node long, n long, place long, of long")


def _fingerprint_pairs(nodes: DataFrame, total: int, similarity: int) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, n, bits), ``total`` of them, that share a key and are within RADIUS bits;
    those with ROUNDS members of each key."""
    met = cut(_shared(nodes.where("n > 0").select("node", "n", _bit_keys("bits", total).alias("keys")), total * BANDS), total * BANDS)
    n_met = met.count()
    met = met.coalesce(1 + n_met // ROWS_PER_TASK)
    pivots = met.groupBy("key").agg(
        F.array_distinct(F.array(*[F.min_by("node", F.xxhash64("node", "key", F.lit(turn))) for turn in range(ROUNDS)])).alias("others"), F.count("*").alias("members")
    )
    pairs = hot_join(met.select("key", "node"), pivots, ["key"], "members", n_met).select("node", F.explode("others").alias("other")).where("node <> other")
    pairs = cut(pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), n_met * ROUNDS)
    facts = nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
    named = lambda end, size, bits: facts.select(F.col("node").alias(end), F.col("n").alias(size), F.col("bits").alias(bits))
    both = pairs.join(named("a", "n", "x"), "a").join(named("b", "m", "y"), "b")
    apart = sum((F.bit_count(F.get("x", F.lit(j)).bitwiseXOR(F.get("y", F.lit(j)))) for j in range(WORDS)), F.lit(0))
    return both.where(_sizes_near(similarity) & (apart <= RADIUS)).select("a", "b")


def _sizes_near(similarity: int) -> Column:
    return F.least("n", "m") * 100 >= F.greatest("n", "m") * similarity


def _prefix_pairs(keyed: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) that can be similar enough by the keys they share, from ``keyed`` (key, node, n, place).

    Let two sets of n and m shingles share c of their first p and q. What else they share comes after the last
    of these in both: n - place and m - place at most. It also comes after the end of that first part which ends
    earlier in the order: max(n - p, m - q) at most, and the larger set has the larger rest.
    """
    # Both sides are the same frame, so they are dealt once.
    one, two = keyed.select("key", "node", "n", "place").alias("x"), keyed.select("key", "node", "n", "place").alias("y")
    named = {"x.node": "a", "y.node": "b", "x.n": "n", "y.n": "m", "x.place": "i", "y.place": "j"}
    met = one.join(two, F.col("x.key") == F.col("y.key")).where("x.node < y.node").select(*[F.col(c).alias(name) for c, name in named.items()])
    # By one shared key alone: what comes before it and after it in both.
    met = met.where(_sizes_near(similarity) & F.expr(f"(least(i, j) + least(n - i, m - j)) * {100 + similarity} >= (n + m) * {similarity}"))
    common = met.groupBy("a", "b", "n", "m").agg(F.count("*").alias("c"), F.max("i").alias("i"), F.max("j").alias("j"))
    most = f"c + least(n - i, m - j, (greatest(n, m) * {similarity} + 99) div 100 - 1)"
    return common.where(F.expr(f"({most}) * {100 + similarity} >= (n + m) * {similarity}")).select("a", "b")


def _sets(docs: DataFrame, nodes: DataFrame, width: int, total: int) -> DataFrame:
    """(node, hashes) for the nodes (node, least_mark), of ``total`` documents: read again from one document of each.

    Texts that no node needs, but for a few, go where they are read, by a map of marks with FILTER bits at most. Of
    the many copies of one text each task sends on one.
    """
    bits = min(FILTER, 1 << (8 * max(4096, total)).bit_length())
    at = F.pmod(F.xxhash64("mark"), F.lit(bits))
    facts = nodes.select("node", F.col("least_mark").alias("mark"))
    maps = facts.select(at.alias("at")).groupBy(F.expr("at div 32768").alias("part")).agg(F.expr("bitmap_construct_agg(at % 32768)").alias("map"))
    filled = np.zeros((bits // 32768, 4096), np.uint8)
    for row in maps.collect():
        filled[row.part] = np.frombuffer(row.map, np.uint8)
    held = filled.tobytes()

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(held, np.uint8)
        for batch in batches:
            place = batch.column(2).to_numpy()
            yield batch.filter(pa.array((known[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1)).select([0, 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [shingles(t.as_py(), width).view("<i8") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "hashes"])

    texts = docs.select("mark", "text", at.alias("at")).mapInArrow(lean(pick), "mark string, text string")
    rows = texts.groupBy("mark").agg(F.min("text").alias("text")).join(facts, "mark").select("node", "text")
    return written(rows.mapInArrow(lean(run), "node long, hashes array<long>"), "near-sets")


def _prefixed(crowd: DataFrame, sets: DataFrame, similarity: int, size: int) -> DataFrame:
    """(key, node, n, rest, indexed): the crowd (node, n) of ``size`` sets under the shingles of their
    prefixes; ``rest`` counts a set's shingles from the key on, in order of rarity.

    Of two sets that are similar enough, the larger one's prefix of n - ceil(n * s) + 1 shingles meets
    the smaller one's of m - ceil(m * 2s / (1 + s)) + 1; keys of the shorter prefix are ``indexed``.
    Shingles that only one set has are no keys, but they take up their places in its prefix.
    """
    held = crowd.join(sets, "node").coalesce(1 + size // SETS_PER_TASK).select("node", F.explode("hashes").alias("key"))
    often = held.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    common = held.select("node", "key").join(often, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("shared"))
    # Whole numbers throughout: an upper part is (x + y - 1) div y.
    own = F.col("n") - F.size("shared")
    longer = F.expr(f"n - (n * {similarity} + 99) div 100 + 1") - own
    shorter = F.expr(f"n - (2 * n * {similarity} + {99 + similarity}) div {100 + similarity} + 1") - own
    keyed = crowd.join(common, "node").where(longer > 0).select("node", "n", own.alias("own"), shorter.alias("shorter"), F.posexplode(F.slice("shared", F.lit(1), longer.cast("int"))).alias("place", "s"))
    return keyed.select(F.col("s.key").alias("key"), "node", "n", (F.col("n") - F.col("own") - F.col("place")).alias("rest"), (F.col("place") < F.col("shorter")).alias("indexed"))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Those of the pairs (a, b) that are similar enough."""
    first = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
    second = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    met = pairs.join(first, "a").join(second, "b")
    return met.where(both * 100 >= (F.size("ha") + F.size("hb") - both) * similarity).select("a", "b")


def _placed(keyed: DataFrame, groups: DataFrame | None, rows: int) -> DataFrame:
    """``keyed``, about as many ``rows``, with the component that each node has come to."""
    if groups is None:
        return cut(keyed.withColumn("component", F.col("node")), rows)
    return cut(keyed.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")), rows)


def _pivots(placed: DataFrame, turn: int, *facts: str) -> DataFrame:
    """(key, other, m, place, members): one member of every key whose members are not all in one component, with
    ``p_`` and the name for further ``facts``."""
    order = F.xxhash64("node", "key", F.lit(turn))
    pivots = placed.groupBy("key").agg(
        F.min_by(F.struct(*facts, "component"), order).alias("p"), F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members")
    ).where("low < high")
    return pivots.select("key", F.col("p.node").alias("other"), F.col("p.n").alias("m"), F.col("p.component").alias("place"), *[F.col(f"p.{f}").alias(f"p_{f}") for f in facts[2:]], "members")


def _linked(pairs: DataFrame, sets: DataFrame, similarity: int, groups: DataFrame | None, tried: DataFrame | None, n_linked: int) -> tuple[DataFrame, DataFrame, int]:
    """The components that ``groups`` (node, component), about ``n_linked`` rows, come to by those of the pairs that
    are similar enough, all pairs tried so far, and about how many rows the components have."""
    n_pairs = pairs.count()
    pairs = pairs.coalesce(1 + n_pairs // PAIRS_PER_TASK)
    if 2 * n_pairs <= FEW:
        # Only the sets that are compared are dealt.
        sets = sets.join(F.broadcast(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "node", "left_semi")
    found = cut(_verified(pairs, sets, similarity).coalesce(1 + n_pairs // PAIRS_PER_TASK))
    if groups is None:
        groups = connected_components(found, n_pairs)
    elif not found.isEmpty():
        groups = connected_components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found), n_linked + n_pairs)
    return groups, pairs if tried is None else tried.union(pairs), n_linked + n_pairs


def _crowds(crowd: DataFrame, sets: DataFrame, similarity: int, groups: DataFrame, tried: DataFrame, n_linked: int) -> DataFrame:
    """``groups`` with all links between the sets of a crowd (node, n), which are joined in order of rarity."""
    near = _sizes_near(similarity)
    # From the first key that two sets share on, there must be enough left for what they have in common.
    enough = F.least("rest", "other_rest") * (100 + similarity) >= (F.col("n") + F.col("m")) * similarity
    keyed = cut(_prefixed(crowd, sets, similarity, crowd.count()))
    n_keyed = keyed.count()
    keyed = keyed.coalesce(1 + n_keyed // ROWS_PER_TASK)
    keyed = cut(keyed.join(keyed.groupBy("key").agg(F.count("*").alias("of")), "key"), n_keyed)
    for turn in range(PREFIX_ROUNDS + 1):
        placed, n_placed = _placed(keyed, groups, n_keyed), n_keyed
        if turn < PREFIX_ROUNDS:
            # A key's members are dealt to its pivots anew in each round, large keys' several times over.
            parts = F.ceil(F.col("of") / DEALT)
            again = F.explode(F.sequence(F.lit(1), F.least(parts, F.lit(TRIES)).cast("int")))
            placed = placed.select("*", again.alias("again"))
            placed = cut(placed.withColumn("key", F.xxhash64("key", "again", F.pmod(F.xxhash64("node", "key", "again", F.lit(-3 - turn)), parts))))
            n_placed = placed.count()
            placed = placed.coalesce(1 + n_placed // ROWS_PER_TASK)
            pivots = cut(_pivots(placed, turn, "node", "n", "rest").withColumnRenamed("p_rest", "other_rest"), n_placed)
            left = hot_join(placed, pivots, ["key"], "members", n_placed).where((F.col("component") != F.col("place")) & enough)
        else:
            several = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("indexed").alias("any")).where("low < high and any").select("key")
            mixed = placed.join(several, "key")
            others = mixed.where("indexed").select("key", F.col("node").alias("other"), F.col("n").alias("m"), F.col("component").alias("place"), F.col("rest").alias("other_rest"))
            left = mixed.join(others, "key").where((F.col("component") != F.col("place")) & (F.col("n") >= F.col("m")) & enough)
        pairs = left.where(near).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        pairs = cut(pairs.join(tried, ["a", "b"], "left_anti"), n_placed)
        groups, tried, n_linked = _linked(pairs, sets, similarity, groups, tried, n_linked)
    return groups


def near_copies(docs: DataFrame, width: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, mark (a digest of its text), component (a number that the rows of
    a group share) and component_id (least doc_id reachable over links).

    Documents are linked if the Jaccard similarity of their shingles is ``similarity`` hundredths or
    more. Null, empty and wordless texts are linked to each other. Repeated rows stay. A null doc_id
    is kept; the component_id is the least id of its group, or null. Other columns are ignored. An
    empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_mark(F.col("text")).alias("mark"), "text")
    with shuffles_dropped(docs.sparkSession):
        return _near_copies(docs, width, similarity)


def _near_copies(docs: DataFrame, width: int, similarity: int) -> DataFrame:
    rows = docs.count()
    marked = written(_sketches(docs, width, similarity, rows), "near-sketches")
    named = marked.groupBy("name").agg(
        F.min("doc_id").alias("least"), F.min("mark").alias("least_mark"), F.min("n").alias("n"), F.count("*").alias("rows"), F.min("bits").alias("bits"), F.min("keys").alias("keys")
    )
    nodes = written(named.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    total = nodes.count()
    pairs = {}
    if ROUNDS:
        pairs["bits"] = cut(_fingerprint_pairs(nodes.select("node", "n", "bits"), total, similarity), total)
    n_keys = nodes.agg(F.sum(F.length("keys") / _KEY_BYTES).cast("long")).first()[0] or 0
    keyed = written(_shared(nodes, n_keys).coalesce(1 + n_keys // ROWS_PER_TASK), "near-keyed")
    pairs["prefix"] = cut(_prefix_pairs(keyed.where(F.col("of") <= CROWD), similarity), rows)
    crowded = cut(keyed.where(F.col("of") > CROWD).select("key", "node", "n"), rows)
    ends = [p.select(F.explode(F.array("a", "b")).alias("node")) for p in pairs.values()]
    wanted = crowded.select("node")
    for end in ends:
        wanted = wanted.union(end)
    sets = _sets(docs, nodes.join(wanted.distinct(), "node", "left_semi"), width, rows)
    groups = tried = None
    n_linked = 0
    for found in pairs.values():
        if groups is not None:
            at = lambda end, name: groups.select(F.col("node").alias(end), F.col("component").alias(name))
            apart = F.coalesce("one", "a") != F.coalesce("two", "b")
            found = cut(found.join(at("a", "one"), "a", "left").join(at("b", "two"), "b", "left").where(apart).select("a", "b").join(tried, ["a", "b"], "left_anti"), rows)
        groups, tried, n_linked = _linked(found, sets, similarity, groups, tried, n_linked)
    n_crowded = crowded.count()
    placed = _placed(crowded, groups, n_crowded)
    unsettled = cut(_pivots(placed, ROUNDS, "node", "n").select("key", "members"), n_crowded)
    if not unsettled.isEmpty():
        crowd = cut(hot_join(placed, unsettled, ["key"], "members", n_crowded).select("node", "n").distinct(), n_crowded)
        groups = _crowds(crowd, sets, similarity, groups, tried, n_linked)
    placed = nodes.join(groups, "node", "left").select("name", "least", "rows", F.coalesce("component", "node").alias("component"))
    roots = placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("of"))
    known = hot_join(placed, roots, ["component"], "of", total).select("name", "rows", "component", "component_id")
    return hot_join(marked.select("doc_id", "mark", "name"), known, ["name"], "rows", rows).select("doc_id", "mark", "component", "component_id")
