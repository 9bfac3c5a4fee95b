"""Alignment of two tokenizers over the same bytes by pointer jumping.

Tokens of both tokenizers are intervals over the bytes of one text. Every token points to the token
of the other side that overlaps it and reaches farthest right. Pointers only lead to the right, so
doubling them (each takes its target's target) ends, in as many steps as the logarithm of the
longest chain, at the last token of each component of overlapping tokens. Those last tokens end at
the byte offsets where both sides end, and they name the groups.

How often two ids are linked in the whole corpus is counted in two levels: a block of texts sends one
row for each pair of ids it holds, and gets the corpus-wide count of those pairs back. The links
of a text refer to its block's list of pairs, so no link is shuffled by itself.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import byte_alphabet
from .shared import lean, written

#: Bytes of text that are aligned in one array, and that make one block of counts.
SLICE_BYTES, BLOCK_BYTES = 1 << 20, 8 << 20
#: The pre-tokenizer's pattern: a fixed value of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizers:
    """A byte-level BPE vocabulary (A, JSON) and a sentencepiece model (B), with the bytes of their tokens."""

    def __init__(self, vocabulary: str, model: bytes):
        spec = json.loads(vocabulary)
        alphabet, special = byte_alphabet(), {t["content"] for t in spec["added_tokens"]}
        self.a_bytes = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in special}
        self._first = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={b: i for i, b in self.a_bytes.items()}, special_tokens={})
        self._second = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = range(self._second.get_piece_size())
        self.b_bytes = {i: self._piece(i) for i in pieces}
        self.a_length, self.b_length = self._lengths(self.a_bytes), self._lengths(self.b_bytes)
        self.a_text, self.b_text = self._decimals(len(self.a_length)), self._decimals(len(self.b_length))

    def _piece(self, i: int) -> bytes:
        piece = self._second.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self._second.is_byte(i) else piece.replace("▁", " ").encode()

    @staticmethod
    def _lengths(tokens: dict[int, bytes]) -> np.ndarray:
        found = np.zeros(max(tokens) + 1, np.int64)
        found[list(tokens)] = [len(b) for b in tokens.values()]
        return found

    @staticmethod
    def _decimals(n: int) -> np.ndarray:
        """The decimal digits of every id, filled up with zero bytes, and one byte left for what follows."""
        width = len(str(n))
        rows = np.array([str(i).encode().ljust(width, b"\0") for i in range(n)], f"S{width}")
        return np.pad(rows.view(np.uint8).reshape(n, width) if n else np.zeros((0, width), np.uint8), ((0, 0), (0, 1)))

    def pair(self, text: str | None) -> tuple[list[int], list[int], int]:
        """Ids of both sides and the bytes of space and text; no ids if either side's bytes differ from those."""
        if not text:
            return [], [], 0
        whole = f" {text}"
        raw = whole.encode("utf-8", "replace")
        a, b = self._first.encode_ordinary(whole), self._second.encode(text)
        if b"".join(map(self.b_bytes.__getitem__, b)) != raw or b"".join(map(self.a_bytes.__getitem__, a)) != raw:
            return [], [], 0
        return a, b, len(raw)


@lru_cache(maxsize=1)
def _loaded(vocabulary: str, model: bytes) -> Tokenizers:
    return Tokenizers(vocabulary, model)


def jump(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Targets of both sides' pointers, and for both sides the A token at which each chain stops.

    Ends are ascending byte offsets, over any number of texts laid one after the other. A token's
    farthest overlapping token is the other side's first one that ends no earlier. Where both end
    together, the A token points to itself and so stops the chain.
    """
    n = len(a_ends)
    to_b, to_a = np.searchsorted(b_ends, a_ends), np.searchsorted(a_ends, b_ends)
    together = b_ends[to_b] == a_ends
    pointer = np.concatenate([np.where(together, np.arange(n), to_b + n), to_a])
    while True:
        further = pointer[pointer]
        if np.array_equal(further, pointer):
            return to_b, to_a, pointer[:n], pointer[n:]
        pointer = further


class _Aligned:
    """The alignment of some texts, laid one after the other."""

    def __init__(self, tokens: Tokenizers, texts: list[str | None]):
        rows = [tokens.pair(t) for t in texts]
        self.n_a, self.n_b = np.array([len(a) for a, _, _ in rows], np.int64), np.array([len(b) for _, b, _ in rows], np.int64)
        self.a = np.fromiter((i for a, _, _ in rows for i in a), np.int64, int(self.n_a.sum()))
        self.b = np.fromiter((i for _, b, _ in rows for i in b), np.int64, int(self.n_b.sum()))
        self.a_ends, self.b_ends = tokens.a_length[self.a].cumsum(), tokens.b_length[self.b].cumsum()
        if len(self.a):
            self.to_b, self.to_a, a_stop, b_stop = jump(self.a_ends, self.b_ends)
        else:
            self.to_b = self.to_a = a_stop = b_stop = np.zeros(0, np.int64)
        self.a_last = a_stop == np.arange(len(self.a))
        self.a_group = self.a_last.cumsum() - self.a_last
        self.b_group = self.a_group[b_stop]
        self.a_doc, self.b_doc = np.repeat(np.arange(len(texts)), self.n_a), np.repeat(np.arange(len(texts)), self.n_b)
        self.n_groups = np.bincount(self.a_doc[self.a_last], minlength=len(texts))
        #: A link is found at the end of an A token, or of a B token that no A token ends with.
        self.b_alone = self.a_ends[self.to_a] != self.b_ends if len(self.a) else np.zeros(0, bool)

    def links(self, n_ids: int) -> tuple[np.ndarray, np.ndarray]:
        """(pair, text) of every overlapping pair of tokens; a pair is its A id times ``n_ids`` plus its B id."""
        alone = self.b_alone
        pairs = np.concatenate([self.a * n_ids + self.b[self.to_b], self.a[self.to_a[alone]] * n_ids + self.b[alone]])
        docs = np.concatenate([self.a_doc, self.b_doc[alone]])
        order = np.argsort(docs, kind="stable")
        return pairs[order], docs[order]

    def digests(self, tokens: Tokenizers) -> list[str]:
        """Of every text the digest of its groups as ``a1,a2|b1;a3|b2,b3``, empty for one without tokens."""
        if not len(self.a):
            return [""] * len(self.n_a)
        a_until = np.bincount(self.a_group).cumsum()
        in_group = np.bincount(self.b_group)
        b_until = in_group.cumsum()
        a_at, b_at = np.arange(len(self.a)) + (b_until - in_group)[self.a_group], np.arange(len(self.b)) + a_until[self.b_group]
        width = max(tokens.a_text.shape[1], tokens.b_text.shape[1])
        out = np.zeros((len(self.a) + len(self.b), width), np.uint8)
        out[a_at, : tokens.a_text.shape[1]] = tokens.a_text[self.a]
        out[b_at, : tokens.b_text.shape[1]] = tokens.b_text[self.b]
        out[a_at, -1] = np.where(self.a_last, ord("|"), ord(","))
        b_last = np.append(self.b_group[1:] != self.b_group[:-1], True)
        out[b_at, -1] = np.where(b_last, ord(";"), ord(","))
        ends = (self.n_a + self.n_b).cumsum()
        out[ends[self.n_b > 0] - 1, -1] = 0
        shown = out != 0
        flat = out[shown]
        places = np.concatenate([[0], shown.sum(axis=1).cumsum()])[np.concatenate([[0], ends])]
        return [hashlib.sha256(flat[x:y]).hexdigest() if y > x else "" for x, y in pairwise(places)]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str | None]]]:
    """Keys and texts of about ``SLICE_BYTES`` at a time; a longer text is a slice of its own."""
    keys, texts, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1)):
            keys.append(key.as_py())
            texts.append(text.as_py())
            size += len(texts[-1] or "")
            if size >= SLICE_BYTES:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def _shipped(docs: DataFrame, vocabulary: str, model: str):
    """Both files' contents, of fixed size, as a broadcast."""
    return docs.sparkSession.sparkContext.broadcast((open(vocabulary, encoding="utf-8").read(), open(model, "rb").read()))


def align_groups(docs: DataFrame, vocabulary: str, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, groups) of whole texts; a group is (start, end, a_ids, b_ids), its byte offsets within space and text.

    Null and empty texts, and those that a tokenizer doesn't give back byte for byte, have no
    groups. A null key, repeated rows and other columns don't matter. A text must fit a task.
    """
    content = _shipped(docs, vocabulary, model)
    group = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _loaded(*content.value)
        for keys, texts in _slices(batches):
            rows = []
            for t in texts:
                one = _Aligned(tokens, [t])
                ends = one.a_ends[one.a_last].tolist()
                a_cut, b_cut = (np.searchsorted(g, np.arange(len(ends) + 1)).tolist() for g in (one.a_group, one.b_group))
                spans = zip([0, *ends], ends, pairwise(a_cut), pairwise(b_cut))
                rows.append([{"start": s, "end": e, "a_ids": one.a[a0:a1].tolist(), "b_ids": one.b[b0:b1].tolist()} for s, e, (a0, a1), (b0, b1) in spans])
            yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(rows, pa.list_(group))], [key, "groups"])

    simple = docs.schema[key].dataType.simpleString()
    kind = pa.string() if simple == "string" else pa.int64()
    cast = docs.select((F.col(key) if simple == "string" else F.col(key).cast("long")).alias(key), F.col(text))
    return cast.mapInArrow(lean(run), f"`{key}` {'string' if simple == 'string' else 'long'}, groups array<struct<start:long,end:long,a_ids:array<int>,b_ids:array<int>>>")


_FACTS = ("n_a", "n_b", "n_groups", "n_links")
_BLOCKS = "block string, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digest array<string>, links binary, pairs array<long>, counts array<long>"


def _blocks(docs: DataFrame, content, n_ids: int) -> DataFrame:
    """One row for each block of texts: what its texts have, its pairs of ids with their counts, and
    the places of its links' pairs in that list, text after text."""

    def row(block: str, facts: list, codes: list[np.ndarray]) -> pa.RecordBatch:
        places, pairs = pd.factorize(np.concatenate(codes))
        counts = np.bincount(places, minlength=len(pairs))
        # Frequent pairs get small numbers, which compress well.
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        packed = zstandard.ZstdCompressor(level=1).compress(rank[places].view(np.uint8).reshape(-1, 4).T.tobytes())
        keys, digests = [k for f in facts for k in f[0]], [d for f in facts for d in f[-1]]
        columns = [keys, *[np.concatenate([f[1][c] for f in facts]) for c in range(4)]]
        return pa.RecordBatch.from_arrays(
            [pa.array([block]), *[pa.array([c], pa.list_(pa.int64())) for c in columns], pa.array([digests], pa.list_(pa.string())), pa.array([packed], pa.binary()), pa.array([pairs[order]], pa.list_(pa.int64())), pa.array([counts[order]], pa.list_(pa.int64()))],
            ["block", "doc_id", *_FACTS, "digest", "links", "pairs", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _loaded(*content.value)
        part, number, size, facts, codes = TaskContext.get().partitionId(), 0, 0, [], []
        for keys, texts in _slices(batches):
            one = _Aligned(tokens, texts)
            pairs, owners = one.links(n_ids)
            facts.append((keys, (one.n_a, one.n_b, one.n_groups, np.bincount(owners, minlength=len(texts))), one.digests(tokens)))
            codes.append(pairs)
            size += int(one.a_ends[-1]) if len(one.a) else 0
            if size >= BLOCK_BYTES:
                yield row(f"{part}-{number}", facts, codes)
                number, size, facts, codes = number + 1, 0, [], []
        if facts:
            yield row(f"{part}-{number}", facts, codes)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), _BLOCKS)


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            r = {name: batch.column(name)[k] for name in batch.schema.names}
            packed = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["links"].as_py()), np.uint8)
            links = np.ascontiguousarray(packed.reshape(4, -1).T).view(np.uint32).ravel()
            place, total, best = (r["totals"].values.field(c).to_numpy(zero_copy_only=False) if r["totals"].values is not None else np.zeros(0, np.int64) for c in ("place", "total", "best"))
            score, top = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
            score[place], top[place] = total, best
            n_links = r["n_links"].values.to_numpy()
            until = np.concatenate([[0], n_links.cumsum()])
            sums = [np.concatenate([[0], v[links].cumsum()]) for v in (top, score)]
            added = [pa.array((s[until[1:]] - s[until[:-1]]).astype(np.int64)) for s in sums]
            yield pa.RecordBatch.from_arrays([r["doc_id"].values, *[r[c].values for c in _FACTS], *added, r["digest"].values], ["doc_id", *_FACTS, "n_best", "count_sum", "groups_sha256"])


def align_digests(docs: DataFrame, vocabulary: str, model: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs``.

    A link is a pair of overlapping tokens of both sides. Its count is how many links of the corpus
    have the same two ids; n_best counts a text's links whose count is the highest that their B id
    has anywhere (ties included), count_sum adds the counts up. Null and empty texts, and those
    that a tokenizer doesn't give back byte for byte, have zeros and an empty digest and count
    for nothing. Rows that repeat are rows of their own; a null id and other columns don't
    matter. An empty table gives no rows. A text, however long, must fit a task.
    """
    content = _shipped(docs, vocabulary, model)
    n_ids = sentencepiece.SentencePieceProcessor(model_proto=content.value[1]).get_piece_size()
    blocks = written(_blocks(docs, content, n_ids), "token-align")
    held = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "p")).select("block", "place", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    totals = held.groupBy("pair").agg(F.sum("n").alias("total"))
    # One row for each B id: bounded by the vocabulary.
    highest = totals.groupBy((F.col("pair") % n_ids).alias("b")).agg(F.max("total").alias("highest"))
    ranked = totals.withColumn("b", F.col("pair") % n_ids).join(F.broadcast(highest), "b")
    judged = ranked.select("pair", "total", (F.col("total") == F.col("highest")).cast("long").alias("best"))
    back = held.select("block", "place", "pair").join(judged, "pair")
    lists = back.groupBy("block").agg(F.collect_list(F.struct("place", "total", "best")).alias("totals"))
    whole = blocks.drop("pairs", "counts").join(lists, "block", "left")
    empty = F.array().cast("array<struct<place:int,total:long,best:long>>")
    return whole.withColumn("totals", F.coalesce("totals", empty)).mapInArrow(lean(_scored), _RESULT)
