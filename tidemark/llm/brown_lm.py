"""Brown class-based n-grams: words get classes by exchange clustering, a text's probability comes
from class transitions and word emissions.

Clustering. Every training word has a class. Seeds first: the ``FREQUENT`` most frequent words and
``SPELLINGS`` groups of all others (by their spelling) are exchanged one by one on their bigrams,
which all training documents count. Then one exchange of all other training words at once: each goes
to the class that raises the likelihood of the seeds' class bigrams most, by the classes before and
after all its occurrences. So what is learnt about words grows with the vocabulary; only words that
training has not seen keep the class of their spelling. Transitions are then counted anew between
the final classes.

Counts. Documents are read once into blocks (tables of some MB of text each): distinct words of
the block, and the text as numbers of those words. Each block sends its words with their contexts to
the words' tasks and gets counts and classes back. So what is shuffled is a row for each distinct
word of a block, not for each token; no task holds the corpus vocabulary, and the frequent words,
of which there are few, are broadcast and not shuffled, so no word's task is large.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import lean, written

#: Words that are seeds of their own, and groups by spelling of all others.
FREQUENT = 1000
SPELLINGS = 500
#: Most frequent words of each block that seeds are chosen from.
POOL = 2000
CLASSES = 48
#: Bytes of text, at most (a longer text has a block of its own), and documents in a block.
BLOCK_BYTES = 6_000_000
BLOCK_DOCS = 20_000
SWEEPS = 8
#: Compression level of blocks.
LEVEL = 3
#: Added counts: for each word of a class, and weight of the class distribution in transitions.
EMISSION, TRANSITION = 0.5, 20.0
#: Added to the seeds' class bigrams when single words are weighed against them.
PAIR = 0.5


def tokens_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at space and x09 to x0D."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def spelling(word: bytes) -> int:
    """The spelling group of a word: by its last three bytes and its size in steps."""
    end = word.rstrip(b".,;:!?") or word
    return crc32(b"%b|%d" % (end[-3:], min(len(end), 12) // 4)) % SPELLINGS


# ---------------------------------------------------------------- blocks

_KINDS = {"block": pa.int64(), "doc_ids": pa.binary(), "held": pa.binary(), "sizes": pa.binary(), "tokens": pa.binary(), "words": pa.binary(), "counts": pa.binary()}
_BLOCK = "block long, doc_ids binary, held binary, sizes binary, tokens binary, words binary, counts binary"


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers of 32 bits, compressed byte by byte of equal weight."""
    return zstandard.compress(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), LEVEL)


def _unpack(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _words(packed: bytes) -> list[bytes]:
    """Words hold no white space, so one space parts them."""
    return zstandard.decompress(packed).split()


def _block(number: int, rows: list[tuple[int | None, bool, np.ndarray]], place: dict[bytes, int]) -> pa.RecordBatch:
    numbers = [n for _, _, n in rows]
    train = [n for _, held, n in rows if not held]
    counts = np.bincount(np.concatenate(train), minlength=len(place)) if train else np.zeros(len(place), np.int64)
    made = {
        "block": number,
        "doc_ids": np.array([0 if d is None else d for d, _, _ in rows], "<i8").tobytes(),
        "held": np.array([(2 if d is None else 0) + held for d, held, _ in rows], np.uint8).tobytes(),
        "sizes": _pack(np.array([len(n) for n in numbers])),
        "tokens": _pack(np.concatenate(numbers)),
        "words": zstandard.compress(b" ".join(place), LEVEL),
        "counts": _pack(counts),
    }
    return pa.RecordBatch.from_arrays([pa.array([made[k]], t) for k, t in _KINDS.items()], list(_KINDS))


def blocks(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, held_out) as compressed blocks, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, place, size, first = [], {}, 0, None
        for batch in batches:
            for doc_id, text, held, number in zip(*(batch.column(k) for k in range(4))):
                if first is None:
                    first = number.as_py()
                line = text.as_py()
                rows.append((doc_id.as_py(), held.as_py(), np.array([place.setdefault(w, len(place)) for w in tokens_of(line)], np.int32)))
                size += len(line or "")
                if size >= BLOCK_BYTES or len(rows) >= BLOCK_DOCS:
                    yield _block(first, rows, place)
                    rows, place, size, first = [], {}, 0, None
        if rows:
            yield _block(first, rows, place)

    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out", F.monotonically_increasing_id().alias("number"))
    return written(numbered.mapInArrow(lean(run), _BLOCK), "brown-blocks")


def _frequent(table: DataFrame) -> list[bytes]:
    """The FREQUENT most frequent training words, by counts in the blocks where a word is among the
    first POOL."""
    most = max(POOL, FREQUENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts in zip(*(batch.column(k).to_pylist() for k in range(2))):
                found = _unpack(counts)
                first = np.argsort(-found, kind="stable")[:most]
                first = pa.array(first[found[first] > 0])
                yield pa.RecordBatch.from_arrays([pa.array(_words(words), pa.binary()).take(first), pa.array(found).take(first)], ["word", "c"])

    words = table.select("words", "counts").mapInArrow(lean(run), "word binary, c int").groupBy("word").agg(F.sum("c").alias("c"))
    return [bytes(r.word) for r in words.orderBy(F.desc("c"), "word").limit(FREQUENT).collect()]


# ---------------------------------------------------------------- clustering


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = SWEEPS, seed: int = 1) -> np.ndarray:
    """Class of every unit: units move, one by one, to the class that raises the likelihood of the
    class bigrams most, until a sweep moves none.

    ``bigrams[u, v]`` counts u before v. The last unit is the text's end and keeps class 0 for itself.
    """
    n = len(bigrams)
    total = bigrams.sum(axis=0) + bigrams.sum(axis=1)
    order = np.argsort(-total[:-1], kind="stable")
    of = np.zeros(n, np.int64)
    of[order] = 1 + np.arange(n - 1) % (classes - 1)
    hot = np.eye(classes)[of]
    pairs = hot.T @ bigrams @ hot
    right, left = bigrams @ hot, bigrams.T @ hot  # unit x class: what follows, what precedes
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not total[u]:
                continue
            a, own = of[u], bigrams[u, u]
            r, le = right[u].copy(), left[u].copy()
            # Take u out of its class.
            pairs[a] -= r
            pairs[:, a] -= le
            pairs[a, a] += own
            r[a] -= own
            le[a] -= own
            rows, cols = pairs.sum(axis=1), pairs.sum(axis=0)
            nr, nl = r.sum() + own, le.sum() + own
            # Gain of putting u into class c, for all c at once.
            with_r = _xlogx(pairs + r[None, :]) - _xlogx(pairs)
            with_l = _xlogx(pairs + le[:, None]) - _xlogx(pairs)
            gain = with_r.sum(axis=1) + with_l.sum(axis=0)
            diag = pairs.diagonal()
            gain += _xlogx(diag + r + le + own) - _xlogx(diag + r) - _xlogx(diag + le) + _xlogx(diag)
            gain -= _xlogx(rows + nr) - _xlogx(rows) + _xlogx(cols + nl) - _xlogx(cols)
            gain[0] = -np.inf
            c = int(gain.argmax())
            if gain[c] <= gain[a] + 1e-9:
                c = a
            pairs[c] += r
            pairs[:, c] += le
            pairs[c, c] += own
            if c != a:
                moved += 1
                of[u] = c
                right[:, a] -= bigrams[:, u]
                right[:, c] += bigrams[:, u]
                left[:, a] -= bigrams[u]
                left[:, c] += bigrams[u]
        if not moved:
            break
    return of


# ---------------------------------------------------------------- the model


@dataclass
class Seeds:
    """Frequent words and the class of every seed; the end is the last seed, class 0.

    ``pairs`` are the bigrams of the seeds' classes in the training texts.
    """

    frequent: dict[bytes, int]
    counts: np.ndarray  # of the frequent words
    of: np.ndarray
    pairs: np.ndarray

    def units(self, words: list[bytes]) -> np.ndarray:
        known, n = self.frequent, len(self.frequent)
        return np.array([u if (u := known.get(w)) is not None else n + spelling(w) for w in words], np.int64)

    def classes(self, words: list[bytes]) -> np.ndarray:
        return self.of[self.units(words)]

    def gains(self) -> np.ndarray:
        """(class before * CLASSES + class after, class): what an occurrence between them adds to the
        likelihood of the class bigrams when its word joins the class, to first order."""
        log = np.log(self.pairs + PAIR)
        alone = np.log(self.pairs.sum(axis=1) + PAIR * CLASSES) + np.log(self.pairs.sum(axis=0) + PAIR * CLASSES)
        gain = (log[:, None, :] + log.T[None, :, :] - alone).reshape(CLASSES * CLASSES, CLASSES)
        gain[:, 0] = -np.inf
        return gain


@dataclass
class Model:
    seeds: Seeds
    transition: np.ndarray  # log10 of the chance of the column's class after the row's
    tokens: np.ndarray  # training tokens of each class
    types: np.ndarray  # distinct training words of each class, the end included
    total: int  # training tokens, ends included
    vocabulary: int  # distinct training tokens, the end included
    ends: int  # training documents

    def emission(self, of: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of a word's chance in its class; words that training has not seen share one place."""
        return np.log10((counts + EMISSION) / (self.tokens[of] + EMISSION * (self.types[of] + 1)))

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1.0) / (self.total + 1.0 * (self.vocabulary + 1)))


def _views(row: dict) -> tuple[np.ndarray, ...]:
    return (np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["held"], np.uint8), _unpack(row["sizes"]), _unpack(row["tokens"]))


def _sequence(tokens: np.ndarray, sizes: np.ndarray, of_word: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of all tokens with an end after each text, and the place of each end."""
    ends = np.cumsum(sizes.astype(np.int64) + 1) - 1
    line = np.full(len(tokens) + len(sizes), end, np.int64)
    inside = np.ones(len(line), bool)
    inside[ends] = False
    line[inside] = of_word[tokens]
    return line, ends


def _training(held: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, of_word: np.ndarray, end: int) -> tuple[np.ndarray, ...]:
    """Of the training texts: all values with an end after each text, the value before each (a text
    follows an end), which of them are words, and the words' numbers."""
    train = (held & 1) == 0
    keep = tokens[np.repeat(train, sizes)]
    line, ends = _sequence(keep, sizes[train], of_word, end)
    inside = np.ones(len(line), bool)
    inside[ends] = False
    return line, np.concatenate([[end], line[:-1]]).astype(np.int64) if len(line) else line, inside, keep


def _summed_pairs(found: DataFrame, n: int) -> np.ndarray:
    """The matrix of rows (pair = before * n + after, n)."""
    summed = found.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n * n)
    out[summed["pair"].to_numpy()] = summed["n"].to_numpy()
    return out.reshape(n, n)


def seed(table: DataFrame) -> Seeds:
    """The frequent words, and the classes of the seeds by exchange on their bigrams.

    FREQUENT words and the bigrams of the seeds (at most FREQUENT + SPELLINGS + 1 squared) come to
    the driver.
    """
    frequent = {w: k for k, w in enumerate(_frequent(table))}
    empty = Seeds(frequent, np.zeros(0), np.zeros(0, np.int64), np.zeros(0))
    n = len(frequent) + SPELLINGS + 1
    shared = table.sparkSession.sparkContext.broadcast(empty)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(n * n, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                _, held, sizes, tokens = _views(row)
                line, before, _, _ = _training(held, sizes, tokens, shared.value.units(_words(row["words"])), n - 1)
                seen += np.bincount(before * n + line, minlength=n * n)
        at = np.flatnonzero(seen)
        for k in range(0, len(at), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 50_000]), pa.array(seen[at[k : k + 50_000]])], ["pair", "n"])

    bigrams = _summed_pairs(table.select("held", "doc_ids", "sizes", "tokens", "words").mapInArrow(lean(run), "pair long, n long"), n)
    of = exchange(bigrams, CLASSES)
    hot = np.eye(CLASSES)[of]
    return Seeds(frequent, bigrams.sum(axis=0)[: len(frequent)], of, hot.T @ bigrams @ hot)


#: A context as a number: 1 << 62 on a word's first one in a block, pair of classes << 32, how often.
_FIRST = 1 << 62
_ENTRY = T.StructType([T.StructField(name, kind, False) for name, kind in (("word", T.BinaryType()), ("block", T.LongType()), ("place", T.IntegerType()), ("met", T.LongType()))])


def _entries(table: DataFrame, shared: Broadcast) -> DataFrame:
    """(word, block, place, met): a row for each context (classes before and after) that a word has in
    a block's training texts, or a row without one; for all words but the frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, square = shared.value, CLASSES * CLASSES
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                listed = _words(row["words"])
                _, held, sizes, tokens = _views(row)
                units = seeds.units(listed)
                rare = units >= len(seeds.frequent)
                line, before, inside, keep = _training(held, sizes, tokens, seeds.of[units], 0)
                after = np.append(line[1:], 0)
                found, times = np.unique(keep.astype(np.int64) * square + before[inside] * CLASSES + after[inside], return_counts=True)
                place = found // square
                met = (found % square) << 32 | times
                met[np.flatnonzero(np.diff(place, prepend=-1))] |= _FIRST
                silent = np.setdiff1d(np.arange(len(listed)), place)
                place, met = np.concatenate([place, silent]), np.concatenate([met, np.full(len(silent), _FIRST)])
                place, met = place[rare[place]].astype(np.int32), met[rare[place]]
                words = pa.array(listed, pa.binary())
                for at in range(0, len(place), 50_000):
                    part = place[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([words.take(pa.array(part)), pa.array(np.full(len(part), row["block"], np.int64)), pa.array(part), pa.array(met[at : at + 50_000])], ["word", "block", "place", "met"])

    return table.select("block", "doc_ids", "held", "sizes", "tokens", "words").mapInArrow(lean(run), _ENTRY)


def _gain_rows(spark: SparkSession, seeds: Seeds) -> DataFrame:
    """(pair, g1, g2, ...): the gains of each pair of classes, one column for each class but the end's."""
    gains = seeds.gains()[:, 1:]
    made = {"pair": pa.array(np.arange(len(gains), dtype=np.int32))} | {f"g{k}": pa.array(column) for k, column in enumerate(gains.T, 1)}
    kinds = [T.StructField(name, T.IntegerType() if name == "pair" else T.DoubleType(), False) for name in made]
    return spark.createDataFrame(pa.table(made), T.StructType(kinds))


def _classified(entries: DataFrame, seeds: Seeds) -> DataFrame:
    """(word, c, class, home): count and class of each training word, and the mark of one place that has it.

    Sums by class of what the contexts add; built-in functions and the broadcast of the gains (a row for
    each pair of classes) keep the entries' partitioning by word, so nothing is shuffled here. As constants
    the gains would be written out wherever Spark describes the plan, by megabytes in the driver.
    """
    times, pair = F.expr("met & 4294967295L"), F.expr("cast(shiftright(met, 32) & 1073741823L as int)")
    met = entries.select("word", pair.alias("pair"), times.alias("n"), F.when(times > 0, F.xxhash64("block", "place")).alias("here"))
    met = met.join(F.broadcast(_gain_rows(entries.sparkSession, seeds)), "pair")
    sums = [F.sum(F.col("n") * F.col(f"g{k}")).alias(f"g{k}") for k in range(1, CLASSES)]
    words = met.groupBy("word").agg(F.sum("n").alias("c"), F.min("here").alias("home"), *sums).where("c > 0")
    gained = F.array(*[F.col(f"g{k}") for k in range(1, CLASSES)])
    return words.select("word", "c", F.array_position(gained, F.array_max(gained)).cast("int").alias("class"), "home")


_KNOWN = "doc_ids binary, held binary, sizes binary, tokens binary, counts binary, classes binary, homes binary"


def classified(table: DataFrame, seeds: Seeds) -> DataFrame:
    """The blocks with training count and class of each of their words (written to the shared folder).

    ``homes`` marks words that are counted here when types are counted: each training word in one block.
    """
    shared = table.sparkSession.sparkContext.broadcast(seeds)
    entries = _entries(table, shared).repartition("word")
    # Both sides of the join read the same columns of the same exchange and no filter may be moved
    # below one of them, so the entries are made and shuffled once: later contexts of a word in a
    # block give nulls, which collect_list drops.
    told = entries.join(_classified(entries, seeds), "word")
    first = F.col("met") >= F.lit(_FIRST)
    at = F.col("place").cast("long") * (CLASSES * 2) + F.col("class") * 2 + (F.col("home") == F.xxhash64("block", "place")).cast("int")
    # Two flat lists, filled row by row in the same order, take a third of a list of structs.
    known = told.groupBy("block").agg(F.collect_list(F.when(first, at)).alias("ats"), F.collect_list(F.when(first, F.col("c"))).alias("cs"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value.frequent
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                units = shared.value.units(_words(row["words"]))
                counts = np.append(shared.value.counts, np.zeros(1))[np.minimum(units, len(frequent))]
                made = [row["block"], row["doc_ids"], row["held"], row["sizes"], row["tokens"], _pack(counts), zstandard.compress(shared.value.of[units].astype(np.uint8).tobytes(), LEVEL)]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in made], ["block", "doc_ids", "held", "sizes", "tokens", "counts", "classes"])

    bare = table.select("block", "doc_ids", "held", "sizes", "tokens", "words").mapInArrow(lean(own), "block long, doc_ids binary, held binary, sizes binary, tokens binary, counts binary, classes binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.slice(k, 1)
                row = part.select(["doc_ids", "held", "sizes", "tokens", "counts", "classes"]).to_pylist()[0]
                counts, classes = _unpack(row["counts"]).copy(), np.frombuffer(zstandard.decompress(row["classes"]), np.uint8).copy()
                homes = np.zeros(len(counts), np.uint8)
                if part.column("ats")[0].is_valid:
                    at, c = part.column("ats")[0].values.to_numpy(), part.column("cs")[0].values.to_numpy()
                    place = at // (CLASSES * 2)
                    counts[place], classes[place], homes[place] = c, at // 2 % CLASSES, at % 2
                made = [row["doc_ids"], row["held"], row["sizes"], row["tokens"], _pack(counts), *(zstandard.compress(x.tobytes(), LEVEL) for x in (classes, homes))]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in made], ["doc_ids", "held", "sizes", "tokens", "counts", "classes", "homes"])

    joined = bare.join(known, "block", "left").select("doc_ids", "held", "sizes", "tokens", "counts", "classes", "ats", "cs")
    return written(joined.mapInArrow(lean(run), _KNOWN), "brown-known")


def fit(known: DataFrame, seeds: Seeds) -> Model:
    """Transitions between the final classes and the sizes of the classes, from all training texts.

    Only numbers for classes and pairs of classes come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Pairs of classes, and after them the types of each class.
        seen = np.zeros(CLASSES * CLASSES + CLASSES, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                _, held, sizes, tokens = _views(row)
                classes = np.frombuffer(zstandard.decompress(row["classes"]), np.uint8)
                homes = np.frombuffer(zstandard.decompress(row["homes"]), np.uint8)
                line, before, _, _ = _training(held, sizes, tokens, classes, 0)
                seen[: CLASSES * CLASSES] += np.bincount(before * CLASSES + line, minlength=CLASSES * CLASSES)
                seen[CLASSES * CLASSES :] += np.bincount(classes[homes > 0], minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(seen))), pa.array(seen)], ["pair", "n"])

    rows = known.mapInArrow(lean(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    sums = np.zeros(CLASSES * CLASSES + CLASSES)
    for r in rows:
        sums[r.pair] = r.n
    pairs, types = sums[: CLASSES * CLASSES].reshape(CLASSES, CLASSES), sums[CLASSES * CLASSES :]
    types += np.bincount(seeds.of[: len(seeds.frequent)], minlength=CLASSES)
    ends = int(pairs[:, 0].sum())
    whole = (pairs.sum(axis=0) + 1) / (pairs.sum() + CLASSES)
    transition = np.log10((pairs + TRANSITION * whole[None, :]) / (pairs.sum(axis=1, keepdims=True) + TRANSITION))
    vocabulary = int(types.sum()) + (1 if ends else 0)
    types[0] = 1
    return Model(seeds, transition, pairs.sum(axis=0), types, int(pairs.sum()), vocabulary, ends)


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(row: dict, model: Model) -> pa.RecordBatch:
    ids, held, sizes, tokens = _views(row)
    counts, of_word = _unpack(row["counts"]).astype(float), np.frombuffer(zstandard.decompress(row["classes"]), np.uint8)
    per_word = np.stack([(counts > 0).astype(float), model.base(counts), model.emission(of_word, counts)])
    end_count = np.array([model.ends], float)
    per_end = np.array([float(model.ends > 0), model.base(end_count)[0], model.emission(np.zeros(1, int), end_count)[0]])
    line, ends = _sequence(tokens, sizes, of_word, 0)
    before = np.concatenate([[0], line[:-1]])
    steps = model.transition[before, line]
    starts = np.concatenate([[0], ends[:-1] + 1])
    inside = np.ones(len(line), bool)
    inside[ends] = False
    sums = []
    for values, last in zip(per_word, per_end):
        full = np.full(len(line), last)
        full[inside] = values[tokens]
        sums.append(np.add.reduceat(full, starts))
    score = sums[2] + np.add.reduceat(steps, starts)
    nobody = (held & 2) > 0
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, mask=nobody),
            pa.array((held & 1) == 1),
            pa.array(sizes.astype(np.int64) + 1),
            pa.array(np.rint(sums[0]).astype(np.int64)),
            pa.array(np.full(len(ids), model.total, np.int64)),
            pa.array(sums[1]),
            pa.array(score),
        ],
        ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores of rows (doc_id, text, held_out), learnt from those that are not held out.

    Per row: doc_id, held_out, n_tokens (words and the end), n_known, train_tokens, base_score (the
    unigram with one added count) and score (log10 probability under the class bigram). Null text
    counts as empty; a null doc_id stays null; repeated rows are counted and scored again; other
    columns are ignored. Without training rows nothing is known and the score is that of the
    smoothing alone. An empty table gives no rows.
    """
    table = blocks(docs)
    seeds = seed(table)
    known = classified(table, seeds)
    shared = docs.sparkSession.sparkContext.broadcast(fit(known, seeds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield _score(batch.slice(k, 1).to_pylist()[0], shared.value)

    return known.select("doc_ids", "held", "sizes", "tokens", "counts", "classes").mapInArrow(lean(run), _SCORES)
