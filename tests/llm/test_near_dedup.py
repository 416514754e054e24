import random
import re

import pytest

from litsieve.llm import near_dedup

from .data import frame, texts


def brute(rows, size, percent):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and rows[x][0] is not None and rows[y][0] is not None and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                parent[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(rows):
        least[find(x)] = min(least.get(find(x), i), i) if i is not None else i
    return [(i, len(sets[x]), least[find(x)], least[find(x)] == i) for x, (i, _) in enumerate(rows)]


def near_rows():
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    rows = texts()
    base = rnd.choices(words, k=160)
    for k in range(40):  # a drifting chain and a star of near copies
        if k % 2:
            base[rnd.randrange(160)] = "new" + str(k)
        copy = list(base)
        for _ in range(k % 3):
            copy[rnd.randrange(160)] = "edit" + str(k)
        rows.append((1000 + k * 37 % 41, " ".join(copy)))
    return rows


def same(spark, rows, size, percent):
    got = near_dedup.near_duplicates(frame(spark, rows), size, percent).collect()
    key = lambda x: tuple((y is None, y) for y in x)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=key) == sorted(brute(rows, size, percent), key=key)


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_equals_brute_force(spark, size, percent):
    same(spark, near_rows(), size, percent)


def test_a_large_group_about_the_threshold(spark):
    """Copies of one text with 0 to 14 random edits, some edits shared, some lines longer."""
    rnd = random.Random(9)
    words = [f"w{k}" for k in range(900)]
    base = rnd.choices(words, k=150)
    shared = {at: f"s{at}" for at in rnd.sample(range(150), 12)}
    rows = []
    for k in range(500):
        copy = list(base)
        for _ in range(rnd.randrange(15)):
            at = rnd.randrange(150)
            copy[at] = shared[at] if at in shared and rnd.random() < 0.8 else rnd.choice(words)
        if k % 9 == 0:
            copy += rnd.choices(words, k=rnd.randrange(20))
        if k % 13 == 0:
            del copy[: rnd.randrange(20)]
        rows.append((k, " ".join(copy)))
    same(spark, rows, 3, 85)


def test_few_pairs_of_a_large_group_are_compared(spark, monkeypatch):
    """Variants with edits in common places, hardly any of which are linked: the pairs that
    are left to confirm don't grow with the square of their number."""
    rnd = random.Random(4)
    words = [f"w{k}" for k in range(2000)]
    base = rnd.choices(words, k=146)
    rows, seen = [(0, " ".join(base))], []
    for k in range(1, 600):
        copy = list(base)
        for at in rnd.sample(range(146), rnd.choice([1, 3, 4, 5])):
            copy[at] = ""  # a word goes
        rows.append((k, " ".join(copy)))
    real = near_dedup.ray_pairs

    def ray_pairs(apart, percent):
        pairs = real(apart, percent)
        seen.append((apart.where("component <> at").count(), pairs.count()))
        return pairs

    monkeypatch.setattr(near_dedup, "ray_pairs", ray_pairs)
    same(spark, rows, 5, 80)
    ((rays, pairs),) = seen
    assert rays > 100 and pairs < 3 * rays, seen


def test_components_of_long_paths(spark):
    """In an order that leaves many least members at first, and in one that leaves one."""
    rnd = random.Random(2)
    ids = rnd.sample(range(1000), 300)
    links = [*zip(ids, ids[1:], strict=False), *((k, k + 1) for k in range(2000, 2200)), (5000, 4000)]
    links += [(b, a) for a, b in links[:20]] + links[:5]
    label = near_dedup.components(spark.createDataFrame(links, "a long, b long"))
    want = {k: min(ids) for k in ids} | {k: 2000 for k in range(2000, 2201)} | {4000: 4000, 5000: 4000}
    got = [(r.id, r.component) for r in label.collect()]
    assert len(got) == len(want) and dict(got) == want
    more = near_dedup.components(near_dedup.renamed(spark.createDataFrame([(2100, 8000), (5000, ids[3])], "a long, b long"), label))
    joined = near_dedup.relabelled(label, more).unionByName(more.join(label, "id", "left_anti"))
    got = {r.id: r.component for r in joined.collect()}
    assert got == want | {4000: min(ids), 5000: min(ids), 8000: 2000}


def test_texts_that_defeat_polynomial_hashes_stay_apart(spark):
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word)]
    same(spark, rows, 3, 85)


def test_signatures_of_small_sets_agree_bin_by_bin():
    import numpy as np

    rnd = np.random.default_rng(3)
    hits = []
    for _ in range(300):
        x = np.sort(rnd.integers(0, 2**63, 4).astype(np.uint64) * np.uint64(2))
        hits.append((near_dedup.signature(x) == near_dedup.signature(x[1:])).mean())
    assert abs(np.mean(hits) - 3 / 4) < 0.03


def test_one_row_of_each_group_stays(spark):
    docs = frame(spark, near_rows())
    left = near_dedup.first_of_group(docs)
    assert left.columns == docs.columns
    again = near_dedup.near_duplicates(left, 5, 80).where("n_shingles > 0 and doc_id is not null")
    assert again.where("not kept").count() == 0
    assert left.where("doc_id in (103, 104)").count() == 2


def test_empty_table(spark):
    assert near_dedup.near_duplicates(frame(spark, [])).collect() == []


def test_estimate_of_signatures():
    import numpy as np

    rnd = np.random.default_rng(1)
    for n, shared in ((40, 30), (900, 800)):
        hits = []
        for _ in range(40):
            x = rnd.integers(0, 2**63, 2 * n - shared).astype(np.uint64) * np.uint64(2)
            a, b = np.sort(x[:n]), np.sort(x[n - shared :])
            hits.append((near_dedup.signature(a) == near_dedup.signature(b)).mean())
        assert abs(np.mean(hits) - shared / (2 * n - shared)) < 0.05
