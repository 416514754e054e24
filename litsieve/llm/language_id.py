"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. The
probability of a word is the sum over all its segmentations into pieces, found by a
forward pass; any byte may also stand alone at a small probability, so that every text
has a segmentation. A text's log-probability is the sum over its words (a word takes the
white space before it along), and the score is the winner's share of the sum over
languages, with equal priors.

Piece probabilities are learnt from at most ``SAMPLE_DOCS`` labelled documents of each
language, the first in the order of a hash of the doc_id, segmented by the vocabulary's
own library and smoothed. Nothing but these (at most vocabulary times languages) counts
goes to the driver. Everything else covers all rows and whole texts.

A distinct word of a chunk is scored once, words of one length in step. A background
language, in which all pieces are equally probable, tells texts of the learnt languages
from gibberish and other languages; it takes no part in the prediction.

Defined cases: ``und`` with score 0 if a text is null or has no letter, or if nothing
could be learnt; rows with null doc_id or lang aren't learnt from and are predicted as
any others; equal probabilities go to the language first in order; repeated rows each
get a row; columns other than doc_id, text and (in learning) lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .vec import BYTE_TABLE, LOWER, U64, ascii_words, groups, mix, powers, row_runs, span_hashes, text_buffers

SAMPLE_DOCS = 400
#: Pseudo-count of every piece, and the probability of a byte by itself.
SMOOTHING = 0.1
BYTE_PROBABILITY = 1e-7
MARK = 0x20
HELD_WORDS = 1 << 17
TABLE_BITS = 18
#: Numbers of a forward pass (words times bytes times languages) that are held at once.
STEP_CELLS = 500_000
#: A text is of none of the learnt languages if the background, in which all pieces are
#: equally probable, is likelier by so many nats.
BACKGROUND_NATS = 10.0
_PREDICTION = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64())])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Vocabulary:
    """Pieces as bytes (a word's start is one mark byte) in a two-choice hash table."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.vocab_size()
        special = lambda k: self.model.is_control(k) or self.model.is_unknown(k) or self.model.is_byte(k)
        self.pieces = [b"" if special(k) else self.model.id_to_piece(k).replace("▁", chr(MARK)).encode() for k in range(size)]
        self.longest = max(map(len, self.pieces))
        ends = np.cumsum([len(p) for p in self.pieces])
        starts = ends - [len(p) for p in self.pieces]
        raw = np.frombuffer(b"".join(self.pieces), np.uint8)
        key = self.hashes(raw, starts, ends)
        usable = np.flatnonzero(ends > starts)
        self.key = [np.zeros(1 << TABLE_BITS, U64) for _ in range(3)]
        self.piece = [np.zeros(1 << TABLE_BITS, np.int32) for _ in range(3)]
        left = usable
        for level in range(3):
            slot = self.slot(key[left], level)
            _, first = np.unique(slot, return_index=True)
            self.key[level][slot[first]] = key[left[first]]
            self.piece[level][slot[first]] = left[first]
            left = np.delete(left, first)
        assert not len(left)

    @staticmethod
    def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        power, inverse = powers(len(raw) + 1)
        total = np.append(U64(0), np.cumsum(BYTE_TABLE[raw] * power[: len(raw)]))
        return (total[ends] - total[starts]) * inverse[starts]

    @staticmethod
    def slot(key: np.ndarray, level: int) -> np.ndarray:
        return (mix(key + U64(level)) >> U64(64 - TABLE_BITS)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Piece number of each hash, 0 for none."""
        slot = self.slot(key, 0)
        out = np.where(self.key[0][slot] == key, self.piece[0][slot], 0)
        rest = np.flatnonzero((out == 0) & (self.key[0][slot] != 0))
        for level in (1, 2):
            slot = self.slot(key[rest], level)
            out[rest] = np.where(self.key[level][slot] == key[rest], self.piece[level][slot], out[rest])
        return out

    def forward(self, words: np.ndarray, probability: np.ndarray) -> np.ndarray:
        """Log-probability of each row of a (words, length) byte matrix by language."""
        n, length = words.shape
        languages = probability.shape[1]
        power, inverse = powers(length + 1)
        total = np.zeros((length + 1, n), U64)
        for j in range(length):
            total[j + 1] = total[j] + BYTE_TABLE[words[:, j]] * power[j]
        alpha = np.zeros((length + 1, n, languages))
        alpha[0] = 1
        scale = np.zeros((n, languages))
        for j in range(1, length + 1):
            now = alpha[j - 1] * BYTE_PROBABILITY
            for i in range(max(0, j - self.longest), j):
                piece = self.find((total[j] - total[i]) * inverse[i])
                hit = np.flatnonzero(piece)
                if len(hit):
                    now[hit] += alpha[i, hit] * probability[piece[hit]]
            alpha[j] = now
            low = now < 1e-120
            if low.any():
                back = alpha[max(0, j - self.longest) : j + 1]
                back *= np.where(low, 1e100, 1.0)
                scale -= np.where(low, np.log(1e100), 0.0)
        return np.log(np.maximum(alpha[length], 1e-300)) + scale


@cache
def vocabulary_of(path: str) -> Vocabulary:
    """For predicting: without the library's model."""
    out = Vocabulary(path)
    del out.model
    return out


def with_background(probability: np.ndarray) -> np.ndarray:
    return np.column_stack([probability, np.full(len(probability), 1 / len(probability))])


class Scorer:
    """Scores texts; a direct-mapped cache of ``HELD_WORDS`` words keeps what it has scored."""

    def __init__(self, vocabulary: Vocabulary, probability: np.ndarray):
        self.vocabulary, self.probability = vocabulary, probability
        self.held = np.zeros(HELD_WORDS, U64)
        self.value = np.zeros((HELD_WORDS, probability.shape[1]))

    def words(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Log-probabilities of distinct words with fingerprints h."""
        slot = (h & U64(HELD_WORDS - 1)).astype(np.int64)
        out = self.value[slot]
        missing = np.flatnonzero(self.held[slot] != h)
        size = (ends - starts)[missing]
        for length in np.unique(size).tolist():
            rows = missing[size == length]
            step = max(1, STEP_CELLS // ((length + 1) * self.probability.shape[1]))
            for x in range(0, len(rows), step):
                part = rows[x : x + step]
                matrix = np.full((len(part), length + 1), MARK, np.uint8)
                matrix[:, 1:] = raw[starts[part][:, None] + np.arange(length)]
                out[part] = self.vocabulary.forward(matrix, self.probability)
        self.held[slot[missing]], self.value[slot[missing]] = h[missing], out[missing]
        return out

    def texts(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log-probability by language, whether there is a letter) of each row."""
        n = len(off) - 1
        low = LOWER[buf]
        total = np.zeros((n, self.probability.shape[1]))
        starts, ends, bounds = ascii_words(low, off)
        if len(starts):
            first, group = groups(low, starts, ends)
            each = self.words(low, starts[first], ends[first], span_hashes(low, starts[first], ends[first]))
            row = np.repeat(np.arange(n), np.diff(bounds))
            for k in range(total.shape[1]):
                total[:, k] = np.bincount(row, weights=each[group, k], minlength=n)
        plain = np.append(0, np.cumsum((low >= 97) & (low <= 122)))
        letter = plain[off[1:]] > plain[off[:-1]]
        for r in np.flatnonzero(~letter & (off[1:] > off[:-1])).tolist():
            letter[r] = any(c.isalpha() for c in buf[off[r] : off[r + 1]].tobytes().decode("utf-8", "replace"))
        return total, letter


def learn(docs: DataFrame, vocabulary_path: str, sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray]:
    """(languages, probability of each piece by language) from rows with lang."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Vocabulary(vocabulary_path).model
        for batch in batches:
            langs, pieces = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low = text.encode().translate(bytes(LOWER)).decode("utf-8", "replace")
                ids = model.encode(low, num_threads=1)
                langs += [lang] * len(ids)
                pieces += ids
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(pieces, pa.int32())], names=["lang", "piece"])

    labelled = docs.where("lang is not null and text is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    # the choice is made on ids alone; the sample is small enough to be sent to every scan
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = labelled.select("lang", "doc_id").withColumn("_order", order).where(F.col("_order") <= sample_docs)
    chosen = F.broadcast(chosen.select("lang", "doc_id").distinct())  # sample_docs a language
    sample = labelled.join(chosen, ["lang", "doc_id"], "left_semi")
    counts = sample.select("lang", "text").mapInArrow(count, "lang string, piece int").groupBy("lang", "piece").count().collect()
    langs = sorted({r["lang"] for r in counts})
    vocabulary = Vocabulary(vocabulary_path)
    table = np.full((len(vocabulary.pieces), len(langs)), SMOOTHING)
    for r in counts:
        table[r["piece"], langs.index(r["lang"])] += r["count"]
    table /= table.sum(0)
    return langs, table


def prediction(spark: SparkSession, text: Column, langs: list[str], probability: np.ndarray, vocabulary_path: str) -> Column:
    """lang_pred, score and margin (how many nats likelier that language is than the
    background, null for ``und``) of a text column. Only texts go to Python: what else a row has stays where it is."""
    shared = spark.sparkContext.broadcast(probability)

    def predict(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(vocabulary_of(vocabulary_path), with_background(shared.value)) if langs else None
        for array in arrays:
            parts = [pa.array([], _PREDICTION)]
            buf, off = text_buffers(array)
            for a, b in row_runs(off):
                if scorer:
                    logs, letter = scorer.texts(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                    logs, background = logs[:, :-1], logs[:, -1]
                    best, most = logs.argmax(1), logs.max(1)
                    score = 1 / np.exp(logs - most[:, None]).sum(1)
                    margin = most - background
                else:
                    best, letter, score, margin = np.zeros(b - a, int), np.zeros(b - a, bool), np.zeros(b - a), np.zeros(b - a)
                names = [langs[k] if ok else "und" for k, ok in zip(best.tolist(), letter.tolist(), strict=True)]
                columns = [pa.array(names, pa.string()), pa.array(np.where(letter, score, 0.0)), pa.array(margin, mask=~letter)]
                parts.append(pa.StructArray.from_arrays(columns, fields=list(_PREDICTION)))
            yield pa.concat_arrays(parts)

    predict.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf("lang_pred string, score double, margin double")(predict)(text)


def identify(docs: DataFrame, vocabulary_path: str, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, margin."""
    langs, probability = learn(docs, vocabulary_path, sample_docs)
    found = prediction(docs.sparkSession, F.col("text"), langs, probability, vocabulary_path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), found.alias("found"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "found.lang_pred", "found.score", "found.margin")


def accepted(docs: DataFrame, vocabulary_path: str, sample_docs: int = SAMPLE_DOCS, background_nats: float = BACKGROUND_NATS) -> DataFrame:
    """The rows of docs that are of a learnt language: they have letters, and the background
    isn't ``background_nats`` likelier than the predicted language (so a few letters, which
    tell nothing, stay). If nothing could be learnt, those with letters."""
    langs, probability = learn(docs, vocabulary_path, sample_docs)
    if not langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = prediction(docs.sparkSession, F.col("text"), langs, probability, vocabulary_path)
    return docs.where(F.coalesce(found["margin"] >= -background_nats, F.lit(False)))
