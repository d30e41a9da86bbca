"""Operators on tokens against the tokenizers library itself."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from sparkguard.llm import bpe, encoding, packing, token_counts, token_output

from .helpers import BASE, awkward

tokenizers = pytest.importorskip("tokenizers")
BYTE, WORD = encoding.tokenizer_path("byte_bpe_50k.json"), encoding.tokenizer_path("word_bpe_49k.json")


def library(path):
    t = tokenizers.Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def odd_texts(n=600):
    random.seed(5)
    some = list("abcXYZ '’stremdl019.,!?-<|>\n\t\r\x1c\x85\xa0é́ßÅΣσς中🙂İıǅﬁ​­½²٣  ") + ["<|endoftext|>", "<|startoftext|>", "'s", "'LL"]
    return ["".join(random.choice(some) for _ in range(random.randrange(50))) for _ in range(n)] + ["a" * 3000, "ab" * 900 + "!" * 300]


@pytest.mark.parametrize(("path", "space"), [(BYTE, True), (WORD, False)])
def test_chunked_encoding_equals_the_library(path, space):
    import pyarrow as pa

    enc, ids = encoding.ChunkEncoder(path, space), library(path)
    texts = [*odd_texts(), None, ""]
    for at, part in encoding.slices(pa.array(texts, pa.string()), 4000):
        got, offsets = enc.encode(part)
        for k in range(len(part)):
            assert got[offsets[k] : offsets[k + 1]].tolist() == ids(texts[at + k])


def test_forced_boundaries_give_the_librarys_ids_and_text():
    made, t = bpe.ForcedBoundaryBPE(WORD), tokenizers.Tokenizer.from_file(WORD)
    for text in odd_texts():
        ids = t.encode(text, add_special_tokens=False).ids
        assert made.encode(text) == ids
        assert made.decode(ids) == t.decode(ids, skip_special_tokens=False)


def test_counts(spark):
    rows, ids = [*BASE, BASE[0], BASE[0], BASE[6], (1, "another text"), (77, "long words, " * 800_000)], library(BYTE)
    docs = awkward(spark, rows)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs).collect())
    want = sorted((str(i), len((t or "").encode()), n := len(ids(t)), n > 1024) for i, t in rows)
    assert got == want
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def test_repeated_and_long_texts_make_the_round_trip(spark):
    t = tokenizers.Tokenizer.from_file(WORD)
    rows = [BASE[0], BASE[0], (1, "another text"), (None, "n"), (None, "n"), (2, "Some words again, " * 500_000)]
    digest = lambda text: hashlib.sha256(struct.pack(f"<{len(ids := t.encode(text, add_special_tokens=False).ids)}I", *ids)).hexdigest()
    got = [(str(r.doc_id), r.ids_sha256) for r in bpe.round_trip_digests(awkward(spark, rows)).collect()]
    assert sorted(got) == sorted((str(i), digest(text)) for i, text in rows)


def test_round_trip_digests(spark):
    t = tokenizers.Tokenizer.from_file(WORD)
    got = {r.doc_id: r for r in bpe.round_trip_digests(awkward(spark)).collect()}
    for i, text in BASE:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("width", [1, 7, 8, 13, 16, 17, 32])
def test_bit_packing_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 777, dtype=np.uint64).astype(np.uint32)
    packed = token_output.pack(ids, width)
    assert len(packed) == -(-777 * width // 8)
    assert token_output.unpack(packed, width, 0, 777).tolist() == ids.tolist()
    assert token_output.unpack(packed, width, 100, 333).tolist() == ids[100:333].tolist()


def test_written_ids(spark):
    ids = library(BYTE)
    path = token_output.write_ids(awkward(spark), block_ids=500)
    got = {r.doc_id: r for r in token_output.read_digests(spark, path).collect()}
    at = 0
    for i, text in sorted(BASE, key=lambda r: (r[0] is not None, r[0] or 0)):
        mine = [*ids(text), 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(mine), zlib.crc32(struct.pack(f"<{len(mine)}I", *mine)))
        at += len(mine)
    assert token_output.document_ids(spark, path, 7) == [*ids(BASE[7][1]), 0]
    assert token_output.document_ids(spark, path, 999) == []
    assert token_output.read_digests(spark, token_output.write_ids(awkward(spark).limit(0))).count() == 0


def test_packing_places_every_piece_once(spark):
    ids = library(WORD)
    rows = packing.pack_documents(awkward(spark), capacity=64, group_pieces=6).collect()
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append(r)
    for i, text in BASE:
        mine, at = [*ids(text), 1], 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            part = mine[at : at + r.length]
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
            assert r.length == 64 or at + r.length == len(mine)
            at += r.length
        assert at == len(mine)
    for held in by_bin.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert packing.pack_documents(awkward(spark).limit(0)).count() == 0


def plain_best_two_fit(lengths, capacity):
    left, bins = sorted(lengths, reverse=True), []
    while left:
        held, gap = [], capacity
        for x in list(left):
            if x <= gap:
                held.append(x)
                left.remove(x)
                gap -= x
        if gap and left and len(held) > 1:
            room = gap + held[-1]
            pairs = [(a + b, a, b) for i, a in enumerate(left) for b in left[i + 1 :] if a + b <= room]
            best = max((p[0] for p in pairs), default=0)
            if best > held[-1]:
                _, a, b = next(p for p in sorted(pairs, key=lambda p: (-p[0], p[1])) if p[0] == best)
                left.append(held.pop())
                left.remove(a)
                left.remove(b)
                left.sort(reverse=True)
                held += [a, b]
        bins.append(sorted(held))
    return bins


def test_packing_equals_a_plain_best_two_fit():
    for seed in range(12):
        rng = np.random.default_rng(seed)
        lengths = rng.integers(1, int(rng.integers(20, 101)), 60)
        bins, _ = packing.best_two_fit(lengths, 100)
        got = [sorted(lengths[bins == b].tolist()) for b in range(bins.max() + 1)]
        assert got == plain_best_two_fit(lengths.tolist(), 100)


def test_repeated_and_full_pieces_are_spread_over_groups(spark):
    rows = spark.createDataFrame([(7, 50)] * 300 + [(8, 100)] * 40, "doc_id long, length long")
    got = packing.pack_lengths(rows, 100, 50).collect()
    assert len({r.sequence_id >> 32 for r in got if r.length == 50}) > 1
    full = [r for r in got if r.length == 100]
    assert len({r.sequence_id for r in full}) == 40 and {r.offset for r in full} == {0}


def test_written_ids_of_repeated_and_long_rows(spark):
    ids = library(BYTE)
    rows = [(5, "same"), (5, "same"), (5, "other"), (None, "n"), (None, "n"), (9, "word " * 2_000_000), (2**53 + 1, "x"), (-3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = token_output.write_ids(docs, block_ids=100, bucket_bytes=1 << 20)
    got = sorted(token_output.read_digests(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, -3, 5, 5, 5, 9, 2**53 + 1]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    sizes = {i: len(ids(t)) + 1 for i, t in rows if i not in (5, None)}
    assert {r.doc_id: r.n_tokens for r in got if r.doc_id in sizes} == sizes
    assert token_output.document_ids(spark, path, 2**53 + 1) == [*ids("x"), 0]
    assert token_output.document_ids(spark, path, 5) in ([*ids("same"), 0], [*ids("other"), 0])


def test_best_two_fit_is_near_the_bound():
    for seed, top in ((1, 4096), (2, 1200), (3, 90)):
        lengths = np.random.default_rng(seed).integers(1, top + 1, 3000)
        bins, offsets = packing.best_two_fit(lengths, 4096)
        assert np.bincount(bins, lengths).max() <= 4096
        assert bins.max() + 1 <= -(-lengths.sum() // 4096) * 1.02 + 1
    # Greedy gives [6, 3] and [4, 2, ...]; the pair 4 + ... fits the gap of 10 exactly.
    bins, _ = packing.best_two_fit(np.array([6, 3, 2, 2, 7]), 10)
    assert bins.max() == 1
