"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

A text's features are its words and pairs of neighbouring words, hashed to 2^18 places, with the share of each among
the text's n-grams as its value; the score is a sparse dot product. A word stands in the n-grams twice: as written
and as its form (letter case, digits, punctuation, whether it repeats the word before), since most words of a new
text were in no training text but their forms were. The weights follow per-coordinate FTRL-proximal updates with L1
and L2 terms.

Training reads a bounded sample of labelled rows (``sample_rows``, the rows with the smallest hashes of their ids,
as many of each label; of rows that repeat an id, the greatest text), a few MB however large the corpus is; scoring
covers every whole text. The model has one
weight per place, 1 MB, which bounds what is sent to the executors.

Defined results: a null text counts as empty; an empty text is scored by the bias alone; rows with a null label or
without a label don't train; without training rows every score is 0.5; repeated rows repeat their result; extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, held_by_worker, id_remainder, text_or_empty, trim

PLACES_BITS = 18
PLACES = 1 << PLACES_BITS
CACHED_WORDS = 200_000
SAMPLE_ROWS = 6000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 1e-5, 1e-4, 3
SCALE = 8.0
THRESHOLD = 0.7
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hashes(word: bytes) -> tuple[int, int]:
    """Hashes of a word as written and of its form."""
    w = word.decode("utf-8", "replace")
    letters = "".join(c for c in w if c.isalpha())
    case = "u" if letters.isupper() and len(letters) > 1 else "l" if letters.islower() else "c" if letters else "-"
    marks = "".join(c if not c.isalnum() else "0" if c.isdigit() else "" for c in w)
    form = f"{case}{min(len(letters), 1)}{marks[:4]}"
    return zlib.crc32(word), zlib.crc32(form.encode(), 1)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(places, offsets): the places of text k's n-grams are places[offsets[k]:offsets[k + 1]]."""
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    flat = np.empty(int(sizes.sum()), object)
    at = 0
    for w in words:
        flat[at : at + len(w)] = w
        at += len(w)
    codes, distinct = pd.factorize(flat)
    hashes = held_by_worker(("quality",), lambda: lru_cache(CACHED_WORDS)(_hashes))
    table = np.array([hashes(w) for w in distinct], np.uint64).reshape(-1, 2)
    word, form = table[codes, 0], table[codes, 1]
    first = np.zeros(len(flat), bool)
    first[(ends - sizes)[sizes > 0]] = True
    again = np.zeros(len(flat), bool)
    again[1:] = (codes[1:] == codes[:-1]) & ~first[1:]
    form = form + again.astype(np.uint64)
    place = lambda x: ((x * _MIX) >> np.uint64(64 - PLACES_BITS)).astype(np.int32)
    before = lambda x: np.where(first, np.uint64(7), np.concatenate([[np.uint64(7)], x[:-1]]) if len(x) else x)
    out = np.stack([place(word), place(form * np.uint64(3) + np.uint64(1)), place(before(word) * np.uint64(1_000_003) + word), place(before(form) * np.uint64(998_244_353) + form)], 1)
    return out.reshape(-1), np.concatenate([[0], ends * 4])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of the places, with the bias last, by FTRL-proximal in the order of the rows."""
    z, n, w = np.zeros(PLACES + 1), np.zeros(PLACES + 1), np.zeros(PLACES + 1)
    rows = []
    for low in range(0, len(texts), 250):
        part = texts[low : low + 250]
        places, offsets = features(part)
        for k in range(len(part)):
            i, c = np.unique(places[offsets[k] : offsets[k + 1]], return_counts=True)
            rows.append((np.append(i, PLACES).astype(np.int32), np.append(SCALE * c / max(1, c.sum()), 1.0)))
    for _ in range(epochs):
        for (i, x), y in zip(rows, labels, strict=True):
            zi, ni = z[i], n[i]
            wi = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            g = (_sigmoid(wi @ x) - y) * x
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[i], n[i] = zi + g - step * wi, ni + g * g
    np.copyto(w, np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)))
    return w


def score(texts: list[str], w: np.ndarray) -> np.ndarray:
    places, offsets = features(texts)
    sums = np.concatenate([[0.0], np.cumsum(w[places])])
    total = sums[offsets[1:]] - sums[offsets[:-1]]
    return _sigmoid(w[PLACES] + SCALE * total / np.maximum(1, np.diff(offsets)))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Train on at most sample_rows rows of labels (doc_id, quality) whose crc32 remainder isn't 2, in one task."""
    known = labels.where((id_remainder("doc_id", 4) != 2) & F.col("quality").isNotNull()).select("doc_id", (F.col("quality") == 1).cast("int").alias("label"))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    each = sample_rows // 2
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("label = 1").orderBy(*order).limit(each).unionByName(known.where("label = 0").orderBy(*order).limit(each))
    # a row an id, so that ids which repeat don't make the sample larger
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.max("text").alias("text"))
    texts = texts.select(F.xxhash64("doc_id").alias("h"), "text", "label")

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"h": [], "text": [], "label": []}), *frames]).sort_values(["h", "text"])
        if len(rows):
            yield pd.DataFrame({"weights": [train(list(rows["text"]), rows["label"].to_numpy(float)).astype("<f4").tobytes()]})

    bound_batches(docs.sparkSession)
    found = texts.repartition(1).mapInPandas(learn, "weights binary").collect()
    return np.frombuffer(bytes(found[0].weights), "<f4").astype(float) if found else np.zeros(PLACES + 1)


def classify(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score, predicted) of docs (doc_id, text)."""
    spark = docs.sparkSession
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value.astype(float)
        for batch in batches:
            s = score(batch.column("text").to_pylist(), w)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """The rows of docs that aren't rejected, with all their columns."""
    spark = docs.sparkSession
    bound_batches(spark)
    sent, at = spark.sparkContext.broadcast(weights.astype(np.float32)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value.astype(float)
        for batch in batches:
            good = score([t or "" for t in batch.column(at).to_pylist()], w) >= THRESHOLD
            yield batch.filter(pa.array(good))
        trim()

    return docs.mapInArrow(run, docs.schema)
