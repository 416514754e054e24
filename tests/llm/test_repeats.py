import hashlib
import random
import re
from dataclasses import replace

import numpy as np
import pytest

from litsieve.llm import repeats, substring_dedup, suffix_dedup
from litsieve.llm.suffix_dedup import COVER, PERIOD

from .data import frame, repeats_brute, texts

key = lambda x: tuple((y is None, y) for y in x)


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def test_cover_is_a_difference_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


@pytest.mark.parametrize("alphabet", [b"ab", b"abcdefgh", b"z"])
def test_byte_window_classes_are_those_of_the_windows(alphabet):
    rnd = random.Random(3)
    base = bytes(rnd.choices(alphabet, k=300))
    strings = [base[k : k + rnd.randint(50, 120)] for k in rnd.choices(range(180), k=40)]
    strings += [bytes(rnd.choices(alphabet, k=70)) for _ in range(20)]
    strings += [s[:25] + b"b" + s[26:] for s in strings[:20]]
    strings = list(dict.fromkeys(strings))
    classes, counts = suffix_dedup.window_classes(50)(strings)
    windows = [s[k : k + 50] for s in strings for k in range(len(s) - 49)]
    assert counts.tolist() == [len(s) - 49 for s in strings]
    number: dict[bytes, int] = {}
    expected = np.array([number.setdefault(w, len(number)) for w in windows])
    pairs = set(zip(expected.tolist(), classes.tolist(), strict=True))
    assert len(pairs) == len(number) == len(set(classes.tolist()))


def test_suffix_dedup_equals_brute_force(spark):
    rows = texts()
    got = suffix_dedup.remove_repeats(frame(spark, rows)).collect()
    want = repeats_brute(rows, lambda t: list(t.encode()), bytes, 50)
    assert any(w[2] for w in want)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=key) == sorted(((i, n, g, k, sha(b)) for i, n, g, k, b in want), key=key)
    assert all(sha(bytes(r.kept)) == r.kept_sha256 for r in got)


def test_substring_dedup_equals_brute_force(spark):
    rows = texts()
    got = substring_dedup.remove_repeats(frame(spark, rows)).collect()
    want = repeats_brute(rows, lambda t: re.findall(rb"[^\x20\x09-\x0D]+", t.encode()), b" ".join, 50)
    assert any(w[2] for w in want)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=key) == sorted(((i, n, g, sha(b)) for i, n, g, _, b in want), key=key)


def hot_rows():
    """One phrase in many surroundings, some of which repeat."""
    rnd = random.Random(11)
    word = lambda: f"w{rnd.randint(0, 400)}"
    phrase = " ".join(f"p{k}" for k in range(12))
    sides = [(" ".join(word() for _ in range(rnd.randint(0, 60))), " ".join(word() for _ in range(rnd.randint(0, 60)))) for _ in range(40)]
    return [(k, f"{rnd.choice(sides)[0]} {phrase} {rnd.choice(sides)[1]}".strip()) for k in range(160)]


@pytest.mark.parametrize("words", [True, False])
def test_hot_minimisers_split_by_context_equal_brute_force(spark, monkeypatch, words):
    seen = []
    real = repeats.by_context

    def by_context(hot, windows):
        seen.append(hot.count())
        return real(hot, windows)

    monkeypatch.setattr(repeats, "by_context", by_context)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")  # so that a partition's share is small
    rows = hot_rows()
    try:
        if words:
            monkeypatch.setattr(substring_dedup, "word_windows", lambda width, f=substring_dedup.word_windows: f(width, 3))
            got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()]
            want = repeats_brute(rows, lambda t: re.findall(rb"[^\x20\x09-\x0D]+", t.encode()), b" ".join, 50)
        else:
            monkeypatch.setattr(suffix_dedup, "byte_windows", lambda width, f=suffix_dedup.byte_windows: replace(f(width), hot=3))
            got = [(r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect()]
            want = repeats_brute(rows, lambda t: list(t.encode()), bytes, 50)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] > 0 and any(w[2] for w in want)
    assert sorted(got) == sorted((i, n, g, sha(b)) for i, n, g, _, b in want)


@pytest.mark.parametrize("module", [substring_dedup, suffix_dedup])
def test_nothing_shared(spark, module):
    """No partition has a minimiser of two documents."""
    rows = [(k, " ".join(f"d{k}w{n}x{n * n + k}" for n in range(70))) for k in range(3)]
    assert [r.n_removed for r in module.remove_repeats(frame(spark, rows)).collect()] == [0, 0, 0]


@pytest.mark.parametrize("module", [substring_dedup, suffix_dedup])
def test_empty_table(spark, module):
    assert module.remove_repeats(frame(spark, [])).collect() == []
