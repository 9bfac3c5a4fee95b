"""Byte-level BPE with contiguous rank arrays.

A short word holds its part boundaries and the ranks of adjacent part pairs in two plain lists. The
least rank is found by a scan, its boundary deleted, and the ranks on both sides refreshed. For the
few very long words a heap over linked boundaries does the same merges without the quadratic scan.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean

#: Words up to this many bytes are merged by scanning.
SHORT = 256
#: Words remembered by a worker; the memory is emptied when full.
REMEMBERED = 200_000
_NONE = 1 << 60
#: The pre-tokenizer's pattern and its white space: fixed values of byte-level BPE.
_SPACES = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_SPACE = "".join(map(chr, _SPACES))
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteBpe:
    """Encoder and decoder of one vocabulary file in the tokenizers library's JSON form."""

    def __init__(self, content: str):
        spec = json.loads(content)
        self.alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        plain = {t: i for t, i in vocab.items() if t not in self.added}
        self.tokens = {i: self._raw(t) for t, i in plain.items()}
        self.ids = {b: i for i, b in self.tokens.items()}
        #: The rank of a part that two parts merge into is its place in the list of merges.
        self.ranks: dict[bytes, int] = {}
        for k, pair in enumerate(spec["model"]["merges"]):
            pair = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(self._raw("".join(pair)), k)
        self.tokens |= {i: t.encode() for t, i in self.added.items()}
        self.words = regex.compile(PATTERN).findall
        self.specials = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.memory: dict[str, tuple[int, ...]] = {}

    def _raw(self, token: str) -> bytes:
        return bytes(self.alphabet[c] for c in token)

    def merge(self, word: bytes) -> list[bytes]:
        """The parts of a word after all merges."""
        if len(word) > SHORT:
            return self._merge_long(word)
        rank = self.ranks.get
        bounds = list(range(len(word) + 1))
        adjacent = [rank(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
        while adjacent:
            least = min(adjacent)
            if least == _NONE:
                break
            i = adjacent.index(least)
            del bounds[i + 1], adjacent[i]
            if i < len(adjacent):
                adjacent[i] = rank(word[bounds[i] : bounds[i + 2]], _NONE)
            if i:
                adjacent[i - 1] = rank(word[bounds[i - 1] : bounds[i + 1]], _NONE)
        return [word[a:b] for a, b in zip(bounds, bounds[1:])]

    def _merge_long(self, word: bytes) -> list[bytes]:
        n, rank = len(word), self.ranks.get
        after, before = list(range(1, n + 2)), list(range(-1, n))
        alive = bytearray(b"\1") * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(word[i : i + 2], _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i]:
                continue
            j = after[i]
            if j >= n or after[j] != end:
                continue
            alive[j] = 0
            after[i] = end
            if end < n:
                before[end] = i
                if (r := rank(word[i : after[end]], _NONE)) != _NONE:
                    heapq.heappush(heap, (r, i, after[end]))
            if i and (r := rank(word[before[i] : end], _NONE)) != _NONE:
                heapq.heappush(heap, (r, before[i], end))
        starts = [i for i in range(n) if alive[i]]
        return [word[a:b] for a, b in zip(starts, [*starts[1:], n])]

    def _word(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8", "replace")
        found = tuple(self.ids[p] for p in self.merge(raw))
        if len(raw) <= SHORT:
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            self.memory[word] = found
        return found

    def _plain(self, text: str, ids: array) -> None:
        known, found = self.memory.get, []
        add = found.extend
        for word in self.words(text):
            add(known(word) or self._word(word))
        ids.extend(array("I", found))

    def encode(self, text: str | None) -> array:
        """Ids as unsigned 32-bit numbers; strings of added tokens become their ids."""
        ids = array("I")
        if not text:
            return ids
        at = 0
        if self.specials is not None:
            for hit in self.specials.finditer(text):
                self._plain(text[at : hit.start()], ids)
                ids.append(self.added[hit.group()])
                at = hit.end()
        self._plain(text[at:] if at else text, ids)
        return ids

    def decode(self, ids: array) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _codec(content: str) -> ByteBpe:
    return ByteBpe(content)


def encode_documents(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array, decoded) of whole texts, decoded from the ids.

    ``vocabulary`` is the path of the vocabulary file on the driver; its content, of fixed size,
    travels with the task. Null text counts as empty, empty text has no ids; a null key, repeated
    rows and other columns don't matter. An empty table gives no rows.
    """
    content = docs.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(content.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [codec.encode(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([r.tolist() for r in rows], pa.list_(pa.int32())), pa.array([codec.decode(r) for r in rows], pa.string())],
                    [key, "ids", "decoded"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text)).mapInArrow(lean(run), f"`{key}` {kind}, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (little-endian unsigned 32-bit ids) and decoded_sha256 (UTF-8).

    The digests of ``encode_documents``, made where the ids are, so that only they leave the
    worker. Same handling of nulls, empty texts and other columns.
    """
    content = docs.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(content.value)
        for batch in batches:
            counts, coded, back = [], [], []
            for t in batch.column(1):
                ids = codec.encode(t.as_py())
                counts.append(len(ids))
                coded.append(hashlib.sha256(ids.tobytes()).hexdigest())
                back.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
