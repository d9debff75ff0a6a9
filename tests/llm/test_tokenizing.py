"""Encoding, counting and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidegauge.llm import queries, word_ids
from tidegauge.llm.bpe_encoding import decode, encode, encoder
from tidegauge.llm.packing import binary_lengths, pack, word_encoder
from tidegauge.llm.segmenter import words
from tidegauge.llm.token_counts import count_tokens, counter

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
SF = "/root/testdata/sf0.001"
ODD = ["a", "e", " ", "  ", "\n", "'", "'s", "'re", "'ll", "1", "23", "é", "ß", "՘", "͸", "漢", "!", "?!", "<|endoftext|>", "<|", "\t", " ", "\x1c",
       "\x85", "ing", "the", "zzzzzz", "𝒳", "\U00013455", "'v", "'l", "'r", "S", "Σ", "İ", "é", "<|startoftext|>", "́", "Ⅷ"]
HARD = ["", " ", "a" * 30000, "'" * 999, " " * 999, "\n \n x", "<|endoftext|>" * 3, "ab " * 20000]


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def odd_texts(seed, n=4000):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(ODD, k=rnd.randint(0, 14))) for _ in range(n)] + HARD


@pytest.mark.parametrize("seed", [1, 2])
def test_encoder_equals_library(seed):
    texts = odd_texts(seed)
    want = [e.ids for e in library(BYTES).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(p, "<u4").tolist() for p in encoder(BYTES)(texts)] == want
    assert counter(BYTES)(texts).tolist() == [len(x) for x in want]


def test_word_encoder_equals_library():
    texts = odd_texts(3)
    want = [e.ids for e in library(WORDS).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(p, "<u4").tolist() for p in word_encoder(WORDS)(texts)] == want


def test_words_of_settled_characters_equal_library():
    texts = [f"{chr(c)} x{chr(c)}y {chr(c)}{chr(c)}1" for c in range(0x400)]
    want = [e.ids for e in library(WORDS).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(p, "<u4").tolist() for p in word_encoder(WORDS)(texts)] == want


@pytest.mark.parametrize("held", [0, 20, 1000])
def test_held_words_keep_their_ids(monkeypatch, held):
    monkeypatch.setattr(word_ids, "WAITING", held // 10)
    asked = []

    def encode(new):
        asked.extend(new)
        return np.array([b for w in new for b in w], np.uint32), np.array([len(w) for w in new], np.int64)

    ids, rnd = word_ids.WordIds(encode, held), random.Random(held)
    for _ in range(40):
        texts = [" ".join(rnd.choices(["often"] * 9 + [f"w{rnd.randrange(300)}" for _ in range(9)] + ["l" * 70], k=12)) for _ in range(5)]
        flat, counts = ids(words(texts, plain=True), len(texts))
        want = ["".join(t.split()).encode() for t in texts]
        assert counts.tolist() == [len(w) for w in want] and bytes(flat.astype(np.uint8).tolist()) == b"".join(want)
    assert held == 0 or asked.count(b"often") == 1 and asked.count(b"l" * 70) > 1
    assert sum(len(level.keys) for level in ids.levels) <= held + held // 10 + 70


def test_every_character_is_classed_as_by_the_library():
    texts = [f"a{chr(c)}1{chr(c)}!'{chr(c)}" for c in range(0x3200) if not 0xD800 <= c < 0xE000]
    assert counter(BYTES)(texts).tolist() == [len(e.ids) for e in library(BYTES).encode_batch(texts, add_special_tokens=False)]


def test_whole_tables_equal_library(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    by_bytes, by_words = library(BYTES), library(WORDS)
    ids = {d: by_bytes.encode(t, add_special_tokens=False).ids for d, t in docs.items()}
    for r in queries.QUERIES["op6_bpe_encoding"](spark, SF).collect():
        assert r.n_tokens == len(ids[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids[r.doc_id])).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(by_bytes.decode(ids[r.doc_id], skip_special_tokens=False).encode()).hexdigest()
    got = {r.doc_id: r for r in queries.QUERIES["op8_token_counts"](spark, SF).collect()}
    assert {d: (r.n_tokens, r.n_bytes, r.over_limit) for d, r in got.items()} == {
        d: (len(x), len(docs[d].encode()), len(x) > 1024) for d, x in ids.items()}
    pieces, rows = {}, queries.QUERIES["op2_packing"](spark, SF).collect()
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 4096 for r in rows)
    for d, t in docs.items():
        want, at = np.array([*by_words.encode(t, add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(pieces.pop(d), key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(want), zlib.crc32(want[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(want)
    assert not pieces


def test_decode_of_ids_that_split_a_character(spark):
    rows = spark.createDataFrame([(1, [447, 247]), (2, [447]), (3, None), (4, [])], "n int, ids array<int>")
    got = {r.n: r.decoded for r in decode(rows, BYTES).collect()}
    t = library(BYTES)
    assert got == {1: t.decode([447, 247]), 2: t.decode([447]), 3: None, 4: ""}


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(1, None, "x", 0), (1, None, "x", 0), (None, "a b", "y", 1), (3, "", None, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, sequence_id int")
    assert sorted((r.doc_id or 0, len(r.ids)) for r in encode(df, BYTES).collect()) == [(0, 2), (1, 0), (1, 0), (3, 0)]
    assert sorted((r.doc_id or 0, r.n_tokens) for r in count_tokens(df, BYTES, 1).collect()) == [(0, 2), (1, 0), (1, 0), (3, 0)]
    packed = pack(df, WORDS).collect()
    assert sorted((r.doc_id or 0, r.length) for r in packed) == [(0, 1), (0, 2), (1, 1), (1, 1), (3, 1)]
    assert len({r.sequence_id for r in packed}) == 5
    empty = df.limit(0)
    assert encode(empty, BYTES).count() == count_tokens(empty, BYTES, 1).count() == pack(empty, WORDS).count() == 0


def test_binary_lengths():
    assert binary_lengths(1, 4096) == [1] and binary_lengths(4096, 4096) == [4096] and binary_lengths(8192 + 5, 4096) == [4096, 4096, 4, 1]
    with pytest.raises(ValueError):
        pack(None, WORDS, largest=100)
