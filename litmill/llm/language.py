"""Language identification: averaged embeddings of hashed subwords under a linear softmax.

A text's letters (lower-cased in ASCII; anything else in ASCII is a space) are cut into byte n-grams of
GRAMS lengths, hashed to BUCKETS embeddings, averaged, and fed to a softmax over the languages learned.
Both layers are trained by stochastic gradient descent in numpy on at most `per_lang` documents of each
language and `most` in all (the smallest hashes of their ids). A fifth of these sets the softmax
temperature and the score below which a prediction is called rejected.

Defined cases: a null or empty text, or one without a letter, is 'und' with score 0; without training rows
every text is 'und'; ties go to the language first in order; repeated rows are judged alike, and one row of an id
and language is learned from; null doc_id: not held out, as its remainder is unknown, but never learned from; a very
long text is a step of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litmill.llm.common import chunks, flat, held_out, pick, spaced

PER_LANG, MOST = 500, 8000
BUCKETS, DIM = 4096, 16
GRAMS = (2, 3)
EPOCHS, RATE, BATCH = 40, 0.5, 32
#: Texts whose features are made at once.
ROWS = 256
#: Documents with crc32(doc_id) mod FOLDS = HELD are held out.
FOLDS, HELD = 4, 2
UNKNOWN = "und"

PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # BUCKETS x languages: embeddings times softmax layer
    bias: np.ndarray
    temperature: float
    least: float  # a lower score is rejected

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = (x @ self.weights + self.bias) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def _letters() -> np.ndarray:
    t = np.full(256, 32, np.uint8)
    t[65:91] = t[97:123] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    return t


def features(raw: np.ndarray, off: np.ndarray, i: int, j: int) -> np.ndarray:
    """Shares of the buckets among each row's n-grams."""
    gap = max(GRAMS)
    buf, begin = spaced(raw, off, i, j, gap)
    b = _letters()[buf].astype(np.uint32)
    row = np.repeat(np.arange(j - i, dtype=np.int64) * BUCKETS, np.diff(begin))
    x = np.zeros((j - i) * BUCKETS, np.int64)
    for n in GRAMS:
        h = np.full(len(b) - n + 1, n, np.uint32)
        for t in range(n):
            h = h * np.uint32(0x01000193) ^ b[t : len(b) - n + 1 + t]
        h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
        used = (b[: len(h)] != 32) | (b[n - 1 : n - 1 + len(h)] != 32)
        x += np.bincount((row[: len(h)] + h)[used], minlength=len(x))
    x = x.reshape(j - i, BUCKETS).astype(np.float32)
    return x / np.maximum(x.sum(axis=1, keepdims=True), 1)


def has_letter(raw: np.ndarray, off: np.ndarray, i: int, j: int) -> np.ndarray:
    """Whether each row has a letter of any script."""
    out = np.zeros(j - i, bool)
    for k in range(j - i):
        b = raw[off[i + k] : off[i + k + 1]]
        out[k] = bool((((b | 32) >= 97) & ((b | 32) <= 122)).any()) or any(c.isalpha() for c in b.tobytes().decode("utf-8", "ignore"))
    return out


def fit(x: np.ndarray, y: np.ndarray, langs: list[str]) -> Model:
    """SGD on four fifths of the rows, temperature and rejection from the rest."""
    rng = np.random.default_rng(7)
    held = np.arange(len(x)) % 5 == 4 if len(x) >= 50 else np.zeros(len(x), bool)
    tx, ty = x[~held], y[~held]
    spread = tx.std(axis=0)
    scale = np.where(spread > 0, 1 / np.maximum(spread, 1e-4), 0)  # rare n-grams count as much as common ones
    scale /= np.sqrt(max((spread > 0).sum(), 1))
    emb = rng.normal(0, 1 / np.sqrt(DIM), (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(tx))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            xs = tx[rows] * scale.astype(np.float32)
            hidden = xs @ emb
            z = hidden @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), ty[rows]] -= 1
            p /= len(rows)
            back = p @ out.T
            out -= rate * hidden.T @ p
            bias -= 0.1 * rate * p.sum(axis=0)
            emb -= rate * xs.T @ back
    model = Model(langs, ((scale[:, None] * emb) @ out).astype(np.float32), bias, 1.0, 0.0)
    vx, vy = (x[held], y[held]) if held.any() else (x, y)
    losses = []
    for t in (temps := np.geomspace(0.2, 8, 40)):
        model.temperature = float(t)
        losses.append(-np.log(np.maximum(model(vx)[np.arange(len(vy)), vy], 1e-9)).mean())
    model.temperature = float(temps[int(np.argmin(losses))])
    p = model(vx)
    right = p.max(axis=1)[p.argmax(axis=1) == vy]
    model.least = float(np.quantile(right, 0.01)) if len(right) else 1.0
    return model


def _sample(ids: DataFrame, per_lang: int, most: int) -> DataFrame:
    """doc_id of at most per_lang ids of each language, those with the least hashes, and of `most` in all.

    Only ids whose hash lies below four times the share that is wanted are ranked, so that no task gets all of a
    language, however common it is.
    """
    h = F.shiftrightunsigned(F.xxhash64("doc_id"), 11)
    counts = ids.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).orderBy("lang").limit(most)
    near = ids.join(F.broadcast(counts), "lang").filter(h.cast("double") * F.col("n") < 4.0 * per_lang * 2.0**53).select("doc_id", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(h, "doc_id")
    return near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_lang).orderBy("r", "lang").limit(most).select("doc_id").distinct()


def train(docs: DataFrame, per_lang: int = PER_LANG, most: int = MOST) -> Model | None:
    rows = pick(docs, "doc_id", "lang", "text")
    ids = rows.filter("doc_id is not null and lang is not null and text is not null").filter(~held_out("doc_id", FOLDS, HELD)).select("doc_id", "lang")
    sample = _sample(ids, per_lang, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = flat(batch.column(2))
            at, value = [], []
            for i, j in chunks(off, rows=ROWS):
                x, letter = features(raw, off, i, j), has_letter(raw, off, i, j)
                for k in range(j - i):
                    some = np.flatnonzero(x[k]) if letter[k] else np.zeros(0, np.int64)
                    at.append(some.astype(np.uint16).tobytes())
                    value.append(x[k][some].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.binary()), pa.array(value, pa.binary())], names=["doc_id", "lang", "at", "value"])

    made = rows.filter("lang is not null").join(F.broadcast(sample), "doc_id").mapInArrow(run, "doc_id long, lang string, at binary, value binary")
    one = made.filter("length(at) > 0").groupBy("doc_id", "lang").agg(F.min(F.struct("at", "value")).alias("x"))  # of rows with equal ids one is learned from
    got = one.select("doc_id", "lang", "x.at", "x.value").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r.doc_id * 2654435761 % (1 << 32), r.doc_id, r.lang))
    langs = sorted({r.lang for r in got})
    x = np.zeros((len(got), BUCKETS), np.float32)
    for k, r in enumerate(got):
        x[k, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r.value, np.float32)
    return fit(x, np.array([langs.index(r.lang) for r in got]), langs)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = flat(batch.column(2))
            lang, score = [], []
            for i, j in chunks(off, rows=ROWS):
                letter = has_letter(raw, off, i, j)
                if model is None:
                    lang += [UNKNOWN] * (j - i)
                    score.append(np.zeros(j - i))
                    continue
                p = model(features(raw, off, i, j)).astype(np.float64)
                lang += [model.langs[k] if ok else UNKNOWN for k, ok in zip(p.argmax(axis=1), letter)]
                score.append(np.where(letter, p.max(axis=1), 0).clip(0, 1))
            s = np.concatenate(score) if score else np.zeros(0)
            least = model.least if model else 1.0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(s), pa.array(s < least)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return pick(docs, "doc_id", "text").select("doc_id", held_out("doc_id", FOLDS, HELD).alias("held_out"), "text").mapInArrow(run, PREDICTED)
