import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from tokenizers import Tokenizer

from litsieve.llm import byte_bpe, token_counts, token_files
from litsieve.llm.pieces import load_ranks

from .data import frame, texts

ALPHABET = ["'", "s", "re", "ll", "ve", " ", "  ", "\n", "\t", "a", "É", "1", "23", ".", "!", "x" * 9, "日本", "\x1c", "\xa0", "ß", "'t", "<|endoftext|>", "<|startoftext|>", "İ", "Σ", "é"]
key = lambda x: tuple((y is None, y) for y in x)


def odd_texts():
    rnd = random.Random(11)
    out = ["".join(rnd.choices(ALPHABET[: rnd.choice([16, len(ALPHABET)])], k=rnd.randint(0, 80))) for _ in range(300)]
    word = "a"
    for _ in range(11):  # two words that polynomial hashes modulo a power of two take as one
        word += word.translate(str.maketrans("ab", "ba"))
    out += [word, word.translate(str.maketrans("ab", "ba")), word + " " + word.translate(str.maketrans("ab", "ba"))]
    return out + ["a" * 3000, " " * 2000, "ab" * 1500 + " x", "日" * 1000, "\n" * 900 + "b"]


def rows():
    return texts() + [(2000 + k, t) for k, t in enumerate(odd_texts())]


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("plain", pat_str=public.PATTERN, mergeable_ranks=load_ranks(public.path("byte_bpe_50k.tiktoken")), special_tokens={})


@pytest.mark.parametrize("leaf", [16, 100, 4096])
def test_tree_encoding_is_the_library_s(plain, leaf):
    codec = byte_bpe.TreeCodec(public.path("byte_bpe_50k.tiktoken"), public.PATTERN, leaf)
    for text in odd_texts()[:: 4 if leaf == 16 else 1]:
        raw = np.frombuffer(text.encode(), np.uint8)
        ids, _ = codec.encode(raw, np.array([0, len(raw)]))
        assert ids.tolist() == plain.encode_ordinary(text)


def test_long_pieces_join_by_tokens(plain):
    codec = byte_bpe.TreeCodec(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    rnd = random.Random(2)
    for _ in range(20):
        word = "".join(rnd.choices(["a", "the", "ing", "é", "zz"], k=900)).encode()
        assert codec.encode_piece(word) == plain._encode_single_piece(word)


def test_byte_bpe(spark, plain):
    got = byte_bpe.encode_decode(frame(spark, rows()), public.path("byte_bpe_50k.tiktoken"), public.PATTERN).collect()
    want = []
    for i, t in rows():
        ids = plain.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_token_counts(spark, monkeypatch):
    library = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    want = []
    for i, t in rows():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 100))
    for hot in (1, 50):
        got = token_counts.count_tokens(frame(spark, rows()), public.path("word_bpe_49k.json"), limit=100, hot=hot).collect()
        assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_token_files(spark):
    library = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    blocks = token_files.write_blocks(frame(spark, rows()), public.path("byte_bpe_50k.json"), block_ids=3000)
    assert blocks.count() > 4
    got = token_files.read_documents(blocks).orderBy("start").collect()
    ordered = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, want = 0, []
    for i, t in ordered:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want


def test_re_pair_round_trip_and_random_access():
    rnd = np.random.default_rng(4)
    for ids in (rnd.integers(0, 20, 5000), np.zeros(999, int), rnd.integers(0, 50257, 3000), np.zeros(0, int), np.array([7])):
        rules, sizes, seq = token_files.compress(ids, 50257, least=2)
        assert (token_files.decode(rules, sizes, seq, 50257) == ids).all()
        for a in range(0, len(ids), 371):
            assert (token_files.decode_range(rules, sizes, seq, 50257, a, a + 40) == ids[a : a + 40]).all()
    assert len(token_files.compress(np.tile([1, 2, 3, 4], 500), 50257)[2]) < 200


def test_empty_tables(spark):
    none = frame(spark, [])
    assert byte_bpe.encode_decode(none, public.path("byte_bpe_50k.tiktoken"), public.PATTERN).collect() == []
    assert token_counts.count_tokens(none, public.path("word_bpe_49k.json")).collect() == []
    assert token_files.read_documents(token_files.write_blocks(none, public.path("byte_bpe_50k.json"))).collect() == []
