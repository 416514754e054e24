import hashlib
import re

import pytest

from litsieve.llm import decontamination

from .data import frame, texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
key = lambda x: tuple((y is None, y) for y in x)


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, bench, width):
    windows = {}
    for item, text in bench:
        w = words(text)
        size = min(width, len(w))
        for k in range(len(w) - size + 1) if size and item is not None else ():
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(item))
    out = []
    for i, text in rows:
        w = words(text)
        hit, items = [False] * len(w), set()
        for k in range(len(w)):
            for size in range(1, width + 1):
                found = windows.get(tuple(w[k : k + size])) if k + size <= len(w) else None
                if found:
                    hit[k : k + size] = [True] * size
                    items |= found
        out.append((i, len(w), sum(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), any(hit)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_equals_brute_force(spark, block_bytes):
    rows = texts()
    long = [t for _, t in rows if t and len(words(t)) > 60]
    bench = [(1, " ".join(long[0].split()[5:40])), (2, long[3].upper()), (3, "Thetion, REÉ"), (4, None), (5, ""), (6, "x17"), (7, " ".join(long[2].split()[:14])), (7, long[5][:90]), (None, long[1]), (10, long[0]), (11, "absent words " * 9)]
    frame_b = spark.createDataFrame([(a, b, "x", None) for a, b in bench], "item_id long, text string, doc_id string, rid long")
    got = decontamination.find_windows(frame(spark, rows), frame_b, 10, block_bytes).collect()
    want = brute(rows, bench, 10)
    assert 3 < sum(w[5] for w in want) < len(want)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=key) == sorted(want, key=key)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_windows(frame(spark, []), none).collect() == []
    assert not any(r.contaminated for r in decontamination.find_windows(frame(spark), none).collect())
