import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import q_token_align, token_align
from tidemark.llm.byte_bpe import byte_alphabet

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(libraries, text):
    """Groups and links of one text, token pair by token pair."""
    first, second = libraries
    if not text:
        return [], []
    alphabet, raw = byte_alphabet(), f" {text}".encode()
    a = first.encode(f" {text}", add_special_tokens=False).ids
    b = second.encode(text)
    a_raw = [bytes(alphabet[c] for c in first.id_to_token(i)) for i in a]
    b_raw = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [second.id_to_piece(i)]]
    if b"".join(a_raw) != raw or b"".join(b_raw) != raw:
        return [], []

    def spans(parts):
        at, out = 0, []
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    sa, sb = spans(a_raw), spans(b_raw)
    links, j = [], 0
    for i, (s, e) in enumerate(sa):
        while sb[j][1] <= s:
            j += 1
        k = j
        while k < len(sb) and sb[k][0] < e:
            links.append((a[i], b[k]))
            k += 1
    groups, x, y = [], 0, 0
    for end in sorted({e for _, e in sa} & {e for _, e in sb}):
        ga, gb = [], []
        while x < len(sa) and sa[x][1] <= end:
            ga.append(a[x])
            x += 1
        while y < len(sb) and sb[y][1] <= end:
            gb.append(b[y])
            y += 1
        groups.append((ga, gb))
    return groups, links


def expected(libraries, rows):
    done = [(i, *plain(libraries, t)) for i, t in rows]
    count = Counter(x for _, _, links in done for x in links)
    best = {}
    for (a, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for i, groups, links in done:
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), digest))
    return sorted(out, key=str)


def result(frame):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in frame.collect()), key=str)


def odd_rows():
    rng = random.Random(9)
    bits = ["a", "'s", " ", "  ", "\n", "\t", "\xa0", "\x85", "\x1c", "é", "1", "²", "!", "中", "😀", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "　", "\x00", "́", "▁", "ﬁ", "the", "ing", "Straße"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for k in range(400)]
    return [*rows, (7, rows[7][1]), (None, "same text"), (None, "same text"), (9000, None), (9001, ""), (9002, " "), (9003, "a" * 3000), (9004, " " * 900), (9005, "ab \n" * 900), (9006, "▁"), (9007, "<|endoftext|>")]


def test_odd_texts_against_token_pairs(spark, libraries, monkeypatch):
    monkeypatch.setattr(token_align, "SLICE_BYTES", 500)
    monkeypatch.setattr(token_align, "BLOCK_BYTES", 3000)
    rows = odd_rows()
    frame = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], "doc_id long, text string, block string, pair string, n_a string").repartition(3)
    assert result(token_align.align_digests(frame, A, B)) == expected(libraries, rows)


def test_all_documents_against_token_pairs(spark, data, libraries):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert result(q_token_align.query(spark, data)) == expected(libraries, rows)


def test_groups_with_offsets(spark, libraries):
    rows = [("x", "Straße naïve"), (None, None), ("x", "the thing, the thing"), ("y", "")]
    frame = spark.createDataFrame(rows, "doc_id string, text string")
    got = token_align.align_groups(frame, A, B).collect()
    assert sorted((r.doc_id or "", len(r.groups)) for r in got) == sorted((i or "", len(plain(libraries, t)[0])) for i, t in rows)
    for r in got:
        for g, n in zip(r.groups, r.groups[1:]):
            assert g.end == n.start
    found = next(r for r in got if r.doc_id == "x" and r.groups[-1].end == len(" Straße naïve".encode()))
    assert [(g.a_ids, g.b_ids) for g in found.groups] == plain(libraries, "Straße naïve")[0]


def test_jumps_over_long_chains():
    # Ends that meet only at the last byte make one chain through all tokens.
    a, b = np.arange(2, 4002, 2), np.append(np.arange(1, 4000, 2), 4000)
    to_b, to_a, a_stop, b_stop = token_align.jump(a, b)
    assert set(a_stop) == set(b_stop) == {len(a) - 1}


def test_empty_table(spark):
    assert token_align.align_digests(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
    none = token_align.align_digests(spark.createDataFrame([(1, None)], "doc_id long, text string"), A, B).collect()
    assert [tuple(r) for r in none] == [(1, 0, 0, 0, 0, 0, 0, "")]
