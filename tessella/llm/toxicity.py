"""Operator 9, toxicity: boosted trees over dense features of whole texts, with isotonic calibration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import seqhash
from .common import batch_of, buffers, crc32_text, documents, longs, slices, stage, table, unstage
from .learn import Isotonic, Trees, labelled_sample

SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
CODES = pa.schema([("y", pa.int32()), ("code", pa.int64())])
#: Seed lexicon, learned stems are added; and words that address the reader.
SEED = "idiot stupid moron loser scum trash worthless pathetic disgusting clown".split()
SECOND = "you your yours du dein deine dich dir tu ton ta vous votre usted tus".split()
#: Bytes a stem may have.
STEMS = (4, 5, 6, 7, 8)
#: Words to either side in which address counts as near.
NEAR = 5

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[65:91] = LETTER[128:] = True
MARKS = np.zeros(256, bool)
MARKS[list(b"!?*#$%&@")] = True
DISGUISE = np.zeros(256, bool)
DISGUISE[list(b"013457@$*!")] = True
FEATURES = 13


def _packed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letters that each word starts with, up to 8 bytes in lower case, as a number with zeros after them; and how many they are."""
    padded = np.append(data, np.zeros(8, np.uint8))
    raw = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))[start]
    live = np.logical_and.accumulate(LETTER[raw] & (np.arange(8) < (end - start)[:, None]), axis=1)
    low = LOWER[raw] * live
    return low.view(">u8")[:, 0].astype(np.uint64), live.sum(axis=1)


def _stems(packed: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """Codes of the words' first n bytes; 0 of shorter words."""
    return np.where(size >= n, packed & ~np.uint64((1 << (64 - 8 * n)) - 1), np.uint64(0)).view(np.int64)


def codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Codes of the stems of the words, all lengths one after another."""
    packed, size = _packed(data, start, end)
    return np.concatenate([_stems(packed, size, n) for n in STEMS])


def _code(word: str) -> int:
    b = word.encode()[:8]
    return int(np.frombuffer(b.ljust(8, b"\0"), ">i8")[0])


class Lexicon:
    """Sorted codes of words and stems; a table of bits spares most words the search."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.unique(codes[codes != 0])
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self._slot(self.codes)] = True

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return (codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)

    def holds(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes), bool)
        maybe = np.flatnonzero(self.bits[self._slot(codes)])
        if len(maybe) and len(self.codes):
            at = np.minimum(np.searchsorted(self.codes, codes[maybe]), len(self.codes) - 1)
            out[maybe] = self.codes[at] == codes[maybe]
        return out


SECOND_CODES = Lexicon(np.array([_code(w) for w in SECOND], np.int64))


def features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """Dense features of each UTF-8 text, from all of it and from nothing else: no window reaches into a neighbour."""
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    s, e, _, bounds = seqhash.words(data, offsets)
    count = lambda hits: np.append(0, np.cumsum(hits))
    per = lambda hits: np.diff(count(hits)[bounds])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    packed, size = _packed(data, s, e)
    hits, which = np.zeros(len(s), bool), np.zeros(len(s), np.int64)
    for n in STEMS[::-1]:  # the shortest stem that is known names the word
        own = _stems(packed, size, n)
        hit = lexicon.holds(own)
        hits |= hit
        which[hit] = own[hit]
    second = SECOND_CODES.holds(packed.view(np.int64))
    at, seconds = np.flatnonzero(hits), count(second)
    low, high = np.maximum(at - NEAR, bounds[text[at]]), np.minimum(at + NEAR + 1, bounds[text[at] + 1])
    near = np.bincount(text[at][seconds[high] > seconds[low]], minlength=len(offsets) - 1)
    pairs = np.unique(np.stack([text[at], which[at]]), axis=1)[0] if len(at) else text[at]
    kinds = np.bincount(pairs, minlength=len(offsets) - 1)
    span = lambda table: np.diff(count(table[data])[offsets])
    first = data[s]
    disguise = count(DISGUISE[data])
    disguised = LETTER[first] & LETTER[data[np.maximum(e - 1, 0)]] & (disguise[e] > disguise[s])
    n_bytes, n_words = np.maximum(1, np.diff(offsets)), np.maximum(1, np.diff(bounds))
    n_hits = per(hits)
    return np.column_stack([
        n_hits, n_hits / n_words, kinds, near, near / n_words, per(second) / n_words,
        span(UPPER) / n_bytes, per(UPPER[first]) / n_words, span(MARKS) / n_bytes, per(disguised) / n_words,
        per(disguised), np.log1p(np.diff(bounds)), n_bytes / n_words,
    ])


class ToxicityModel:
    def __init__(self, lexicon: Lexicon, trees: Trees, calibration: Isotonic):
        self.lexicon, self.trees, self.calibration = lexicon, trees, calibration

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.calibration.predict(self.trees.predict(x))


def _lexicon(sample: DataFrame, least: int, ratio: float, limit: int) -> Lexicon:
    """The seed words and stems that far more toxic texts hold than others, counted once a text."""

    def rows(batches):
        for batch in batches:
            offsets, data = buffers(batch.column("text"))
            y = longs(batch.column("y"))
            for k in range(batch.num_rows):
                s, e, _, _ = seqhash.words(data, offsets[k : k + 2])
                found = np.unique(codes(data, s, e))
                yield batch_of(CODES, np.full(len(found), y[k], np.int32), found)

    found = sample.select("text", "y").mapInArrow(rows, "y int, code long").filter("code <> 0")
    totals = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    t, c = totals.get(1, 0) + 1.0, totals.get(0, 0) + 1.0
    rate = (F.col("toxic") / t) / ((F.col("clean") + 0.5) / c)
    counts = found.groupBy("code").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
    best = counts.filter((F.col("toxic") >= least) & (rate >= ratio)).orderBy(F.desc("toxic"), "code").limit(limit).collect()
    return Lexicon(np.array(sorted({_code(w) for w in SEED} | {r.code for r in best}), np.int64))


def train(docs: DataFrame, labels: DataFrame, label: str, learn, limit: int = 4000, least: int = 4, ratio: float = 12.0, stems: int = 1000) -> ToxicityModel:
    """Fits on at most `limit` labelled texts of each label, whole; of their features 13 numbers a text come to the driver.

    The lexicon and the trees learn from four fifths of them (by a hash of doc_id), the calibration from the rest. Null texts are
    empty; labels that are null or neither 0 nor 1 and null ids teach nothing; of a repeated id one text stands for all.
    """
    fold = F.pmod(crc32_text(F.col("doc_id")), F.lit(5)) == 0
    sample = labelled_sample(docs, labels, label, learn, limit).withColumn("fold", fold)
    sample = stage(sample.repartition(F.col("doc_id")), "toxic-sample")
    lexicon = _lexicon(sample.filter("not fold"), least, ratio, stems)
    names = [f"f{k}" for k in range(FEATURES)]
    given = ["doc_id", "y", "weight", "fold"]

    def rows(batches):
        for batch in batches:
            offsets, data = buffers(batch.column("text"))
            for i, j in slices(offsets):
                x = features(data, offsets[i : j + 1], lexicon)
                yield pa.RecordBatch.from_arrays([batch.column(c)[i:j] for c in given] + [pa.array(c) for c in x.T], names=[*given, *names])

    made = sample.mapInArrow(rows, "doc_id long, y int, weight double, fold boolean, " + ", ".join(f"{n} double" for n in names)).collect()
    unstage(sample)
    made.sort(key=lambda r: (r.doc_id, tuple(r)))
    y, w = np.array([r.y for r in made], float), np.array([r.weight for r in made], float)
    x = np.array([tuple(r)[len(given) :] for r in made]).reshape(-1, FEATURES)
    fold = np.array([r.fold for r in made], bool)
    trees = Trees().fit(x[~fold], y[~fold], w[~fold])
    use = fold if fold.any() else ~fold
    return ToxicityModel(lexicon, trees, Isotonic().fit(trees.predict(x[use]), y[use], w[use]))


def score(self, x: np.ndarray) -> np.ndarray:
        return self.calibration.predict(self.trees.predict(x))


def _lexicon(sample: DataFrame, least: int, ratio: float, limit: int) -> Lexicon:
    """Codes of the seed words and of stems that far more toxic texts hold than others, counted once a text."""

    def rows(batches):
        for batch in batches:
            offsets, data = buffers(batch.column("text"))
            y = longs(batch.column("y"))
            for k in range(batch.num_rows):
                s, e, _, _ = seqhash.words(data, offsets[k : k + 2])
                found = np.unique(codes(data, s, e))
                yield batch_of(CODES, np.full(len(found), y[k], np.int32), found)

    found = sample.select("text", "y").mapInArrow(rows, "y int, code long").filter("code <> 0")
    totals = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    t, c = totals.get(1, 0) + 1.0, totals.get(0, 0) + 1.0
    rate = (F.col("toxic") / t) / ((F.col("clean") + 0.5) / c)
    counts = found.groupBy("code").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
    best = counts.filter((F.col("toxic") >= least) & (rate >= ratio)).orderBy(F.desc("toxic"), "code").limit(limit).collect()
    return Lexicon(np.array(sorted({_code(w) for w in SEED} | {r.code for r in best}), np.int64))


def train(docs: DataFrame, labels: DataFrame, label: str, learn, limit: int = 4000, least: int = 4, ratio: float = 12.0, stems: int = 1000) -> ToxicityModel:
    """Fits on at most `limit` labelled texts of each label, whole; of their features 13 numbers a text come to the driver."""
    sample = stage(labelled_sample(docs, labels, label, learn, limit).repartition(F.col("doc_id")), "toxic-sample")
    lexicon = _lexicon(sample, least, ratio, stems)
    names = [f"f{k}" for k in range(FEATURES)]

    def rows(batches):
        for batch in batches:
            offsets, data = buffers(batch.column("text"))
            for i, j in slices(offsets):
                x = features(data, offsets[i : j + 1], lexicon)
                yield pa.RecordBatch.from_arrays([batch.column(c)[i:j] for c in ("doc_id", "y", "weight")] + [pa.array(c) for c in x.T], names=["doc_id", "y", "weight", *names])

    made = sample.mapInArrow(rows, "doc_id long, y int, weight double, " + ", ".join(f"{n} double" for n in names)).collect()
    unstage(sample)
    made.sort(key=lambda r: (r.doc_id, tuple(r)))
    y, w = np.array([r.y for r in made], float), np.array([r.weight for r in made], float)
    x = np.array([tuple(r)[3:] for r in made]).reshape(-1, FEATURES)
    fold = np.array([r.doc_id % 5 == 0 for r in made], bool)
    trees = Trees().fit(x[~fold], y[~fold], w[~fold])
    use = fold if fold.any() else ~fold
    return ToxicityModel(lexicon, trees, Isotonic().fit(trees.predict(x[use]), y[use], w[use]))


def score(docs: DataFrame, model: ToxicityModel, *more: str, name: str = "score") -> DataFrame:
    """(doc_id, score) of every row's whole text; null is the empty text, repeated rows and null ids are scored like any other.

    A score depends on its text alone. `more` names columns to pass along, `name` the score's. Without labels every score is 0.5.
    """
    names = list(dict.fromkeys(["doc_id", "text", *more]))
    kept = [n for n in names if n in ("doc_id", *more)]

    def rows(batches):
        for batch in batches:
            offsets, data = buffers(batch.column("text"))
            for i, j in slices(offsets):
                values = model.score(features(data, offsets[i : j + 1], model.lexicon))
                yield pa.RecordBatch.from_arrays([batch.column(n)[i:j] for n in kept] + [pa.array(values)], names=[*kept, name])

    schema = ", ".join(f"`{n}` {dict(docs.dtypes)[n]}" for n in kept)
    return docs.select(*names).mapInArrow(rows, f"{schema}, `{name}` double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    held = F.pmod(crc32_text(F.col("doc_id")), F.lit(4)) == 2
    model = train(docs, labels, "toxic", ~held)
    return score(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
