from __future__ import annotations

import base64
import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from clientela.llm import byte_bpe, packing, queries

SF = "/root/testdata/sf0.001"
TRICKY = [
    "", " ", "  a   b    c", "a\n\n  b\t \tc \r\n", "it's we'll 'tis 1234567", "é漢字😀 👩‍👩‍👧 ﷺ", "x" * 3000, "=" * 700 + " " * 65 + "\t" * 9,
    "<|endoftext|> <|startoftext|>", "\u00a0\u3000 \u2003x \x1c\x1d y", "e\u0301 I\u0307 ÀÉ Σς", "a\x00b", "tail ",
]


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.BYTE_RANKS, "rb"))}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check_encoding(plain, texts, result):
    assert sorted(r.doc_id for r in result) == sorted(texts)
    for r in result:
        text = texts[r.doc_id] or ""
        ids = plain.encode_ordinary(text)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(packed).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_byte_bpe_query_equals_the_rank_library(spark, corpus, plain):
    check_encoding(plain, {own: text for own, text, _ in corpus}, queries.op9_byte_bpe(spark, SF).collect())


def random_texts(n):
    rng = random.Random(n)
    parts = [*" \n\t.,'=-_#19aé漢😀", "  ", " the", "'s", "ing", "\r\n", "\u3000", "\xa0"]
    return ["".join(rng.choice(parts) * rng.choice([1, 1, 2, 7]) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_units_encode_as_whole_texts(plain):
    vocabulary = byte_bpe._vocabulary(queries.BYTE_RANKS, public_tokenizers.PATTERN)
    texts = TRICKY + random_texts(3000)
    for text, packed in zip(texts, vocabulary.cache.pack(texts)):
        assert np.frombuffer(packed, "<u4").tolist() == plain.encode_ordinary(text), text
        assert byte_bpe.decode_bytes(packed, vocabulary) == text.encode()


def test_offsets_and_split_characters(spark, make_docs, plain):
    rows = [(k, text) for k, text in enumerate(TRICKY)]
    for r in byte_bpe.encode_documents(make_docs(rows), queries.BYTE_RANKS, public_tokenizers.PATTERN).collect():
        ids, starts = np.frombuffer(r.ids, "<u4").tolist(), np.frombuffer(r.starts, "<u4").tolist()
        assert starts == plain.decode_with_offsets(ids)[1] or "\ufffd" in "".join(plain.decode([i]) for i in ids)
        raw, at = TRICKY[r.doc_id].encode(), 0
        for token, start in zip(ids, starts):  # the character that holds the token's first byte
            assert start == len(raw[:at].decode(errors="ignore"))
            at += len(plain.decode_single_token_bytes(token))
    half = plain.encode_ordinary("👩")[:1]
    assert byte_bpe.decoded_text(struct.pack("<I", half[0]), queries.BYTE_RANKS, public_tokenizers.PATTERN) == "\ufffd"
    ids = spark.createDataFrame([(1, struct.pack("<2I", 64, 10**9), "clash"), (2, None, "clash")], "doc_id long, ids binary, decoded string")
    decoded = {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode_documents(ids, queries.BYTE_RANKS, public_tokenizers.PATTERN).collect()}
    assert decoded == {1: plain.decode_single_token_bytes(64) + "\ufffd".encode(), 2: b""}


def test_byte_bpe_edge_cases(make_docs, plain):
    rows = [(1, None), (2, ""), (3, "same"), (3, "same"), (4, "long word " * 40_000)]
    encoded = byte_bpe.encode_documents(make_docs(rows), queries.BYTE_RANKS, public_tokenizers.PATTERN)
    assert sorted((r.doc_id, len(r.ids) // 4) for r in encoded.collect()) == sorted((k, len(plain.encode_ordinary(t or ""))) for k, t in rows)
    assert byte_bpe.encode_documents(make_docs(), queries.BYTE_RANKS, public_tokenizers.PATTERN).collect() == []


# Packing ------------------------------------------------------------------------------------------------


def check_pieces(rows, pieces):
    tokenizer = Tokenizer.from_file(queries.WORD_VOCABULARY)
    whole = {own: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2] for own, text in rows}
    by_document = {}
    for p in pieces:
        by_document.setdefault(p.doc_id, []).append(p)
    assert set(by_document) == set(whole)
    for own, parts in by_document.items():
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(whole[own]) and 0 < p.length <= 4096
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{p.length}I", *whole[own][at : at + p.length]))
            at += p.length
        assert at == len(whole[own])
    sequences = [p.sequence_id for p in pieces]
    assert len(set(sequences)) == len(sequences) and all(p.offset == 0 for p in pieces)  # one piece a sequence
    assert all(p.length & (p.length - 1) == 0 for p in pieces)  # so none is padded


def test_packing_query(spark, corpus):
    check_pieces([(own, text) for own, text, _ in corpus], queries.op8_packing(spark, SF).collect())


def test_word_units_encode_as_whole_texts():
    tokenizer = Tokenizer.from_file(queries.WORD_VOCABULARY)
    texts = TRICKY + random_texts(2000)
    for text, packed in zip(texts, packing._cache(queries.WORD_VOCABULARY).pack(texts)):
        assert np.frombuffer(packed, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_packing_edge_cases(make_docs):
    from pyspark.sql import functions as F

    rows = [(1, None), (2, ""), (3, "a b " * 30_000), (4, "<|endoftext|> x"), (-5, "\n")]
    pieces = packing.pack_documents(make_docs(rows), queries.WORD_VOCABULARY)
    check_pieces(rows, pieces.withColumn("ids_crc32", F.crc32("ids")).collect())
    twice = packing.pack_documents(make_docs([(7, "x y z"), (7, "x y z"), (None, "x")]), queries.WORD_VOCABULARY).collect()
    assert sorted((p.doc_id or 0, p.length) for p in twice) == [(0, 2), (7, 4), (7, 4)] and len({p.sequence_id for p in twice}) == 3
    assert packing.pack_documents(make_docs(), queries.WORD_VOCABULARY).collect() == []
    with pytest.raises(ValueError):
        packing.pack_documents(make_docs(), queries.WORD_VOCABULARY, longest=1000)


def test_piece_lengths():
    assert packing.piece_lengths(1) == [1] and packing.piece_lengths(2 * 4096 + 5) == [4096, 4096, 4, 1]
    assert all(sum(packing.piece_lengths(n)) == n for n in range(1, 9000, 37))


def test_buckets_are_written_by_length(make_docs, tmp_path):
    pieces = packing.pack_documents(make_docs([(1, "a b c d e"), (2, "a")]), queries.WORD_VOCABULARY)
    packing.write_buckets(pieces, str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {"length=2", "length=4"}


def test_words_before_any_signs_pack_as_the_library_encodes_them():
    import random

    from tokenizers import Tokenizer

    from clientela.llm import packing

    library, cache = Tokenizer.from_file(queries.WORD_VOCABULARY), packing._cache(queries.WORD_VOCABULARY)
    rng = random.Random(6)
    letters = "aBzE é'sS.,!?<>|()[]{}#$%&*~`^_-+=@:;\"\\/ 9\n"
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 30))) for _ in range(5000)]
    texts += ["word<|endoftext|>", "a<|startoftext|>!!", "it's!!", "x'll??", "no" + "!" * 500, "." * 300]
    want = [np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes() for text in texts]
    assert cache.pack(texts) == want


def test_kept_units_are_bounded_and_change_no_ids():
    small, large = packing._cache(queries.WORD_VOCABULARY, 30, 30), packing._cache(queries.WORD_VOCABULARY)
    for k in range(20):
        text = " ".join(f"{a}{b}, {k}" for a in "abcde" for b in ("lpha", "eta", "amma"))
        assert small.pack([text]) == large.pack([text])
        assert len(small.kept) <= 30 + 46 and len(small.words) <= 30 + 46
