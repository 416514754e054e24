"""Small documents with nulls, copies, near copies, shared passages, ties and clashes."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, bucket int, k int, h string, word string, string string, copy boolean"


def texts(seed: int = 7) -> list[tuple[int | None, str | None]]:
    rnd = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("the", "Ré", "in", "on", "st", "x1", "l'é", "b.") for b in ("", "a", "ng", "tion", "ß", "7")]
    passage = " ".join(rnd.choices(vocabulary, k=140))
    out: list[tuple[int | None, str | None]] = []
    for i in range(60):
        words = rnd.choices(vocabulary, k=rnd.choice([0, 1, 2, 3, 9, 60, 120, 400]))
        text = " ".join(words)
        if i % 4 == 1:
            text = text[:100] + " " + passage[rnd.randint(0, 300) :] + "\n" + text[100:]
        if i % 7 == 3:
            text = (out[rnd.randrange(len(out))][1] or "") + rnd.choice(["", " more words here", "."])
        if i % 11 == 5:
            words = (out[rnd.randrange(len(out))][1] or "").split()
            if words:
                words[rnd.randrange(len(words))] = "changed"
            text = " ".join(words)
        out.append((i * 3 % 61, text))
    line = "the same short line again and again "
    out += [(100, line * 60), (101, line * 30 + "end"), (102, None), (103, ""), (104, " \n\t "), (105, "z" * 300), (106, "zz" * 40)]
    out += [(None, passage), (None, None), (100, line * 60), (101, "other text under one id " + passage), (200, passage), (200, passage)]
    return out


def frame(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, 3, "h", "w", "s", None) for i, t in rows], SCHEMA).repartition(3)


def repeats_brute(rows, split, join, width):
    """Removed units by definition: (doc_id, units, removed, runs, kept) of each row."""
    first: dict[tuple, int] = {}
    units = [split(t or "") for _, t in rows]
    for (i, _), u in zip(rows, units, strict=True):
        for k in range(len(u) - width + 1) if i is not None else ():
            w = tuple(u[k : k + width])
            first[w] = min(first.get(w, i), i)
    out = []
    for (i, _), u in zip(rows, units, strict=True):
        gone = [False] * len(u)
        for k in range(len(u) - width + 1) if i is not None else ():
            if first[tuple(u[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(u), sum(gone), runs, join([x for x, g in zip(u, gone, strict=True) if not g])))
    return out
