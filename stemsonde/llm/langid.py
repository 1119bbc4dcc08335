"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is lower-cased, everything but letters becomes a word boundary, and the 1- to 4-grams of its words (boundaries
marked) are hashed into ``BUCKETS`` rows of an embedding table. The embeddings are averaged and a linear softmax reads
the average. Both tables are trained by plain stochastic gradient descent in numpy.

*Training rows* are a bounded sample, as documented by ``SAMPLE``: of the labelled rows, the ``SAMPLE`` with the least
``xxhash64(doc_id, text)``, found by one top-k over the table. Tasks turn their whole texts into bags of at most
``BUCKETS`` counts. Of them one in five is set aside for calibration. Every other figure covers all rows.

*Calibration*: the temperature that minimises the log loss of the set-aside rows. *Rejection*: a text is rejected if
it has no letter, or if its calibrated probability is below the least one of the set-aside rows that were predicted
rightly, lowered by ``MARGIN`` in log odds so that clean texts have a margin (never above ``CEILING``). As no best
probability is below chance, a level that comes out below it rejects no text with a letter.

*Scoring* is one pass: since averaging and the linear layer commute, each bucket's row is multiplied into the softmax
once (a table of buckets x languages), which is all that the tasks get; its size is fixed by the parameters. A text's
logits are sums over its n-grams, taken slice by slice over the whole text.

Defined cases: null text, or none of its characters is a letter: ``und``, score 0, rejected. No labelled row with a
letter: every text is ``und``, score 0. One learned language: that one, score 1. Equal scores: the first in sorted
order. A null lang is not learned from. Repeated rows get equal results. Columns other than doc_id, text and lang are
not read, and only the text is an input of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _offsets, batch_of, columns_of, mix, slices

BUCKETS, DIM, GRAMS = 1 << 15, 16, (1, 2, 3, 4)
SAMPLE, STEPS, EPOCHS, RATE = 4000, 13_000, 40, 0.5
CEILING, MARGIN = 0.6, 1.0
_U = np.uint64
_CODES: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point its lower case if it is a letter, else 0."""
    if not _CODES:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if (x := chr(c)).isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _CODES.append(table)
    return _CODES[0]


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each row, their rows, and the number of letters of each row."""
    data, off = _offsets(column)
    starts = (data & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(starts)])[off]
    code = _letters()[np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
    n = len(code)
    row = np.repeat(np.arange(len(column)), np.diff(at))
    letters = np.bincount(row[code > 0], minlength=len(column))
    space = code == 0
    keep = ~(space & np.concatenate([[False], space[:-1]]) & np.concatenate([[True], row[1:] == row[:-1]]) if n else space)
    code, row = code[keep].astype(np.uint64), row[keep]  # one boundary between words
    n = len(code)
    buckets, rows = [], []
    for k in GRAMS:
        if n < k:
            continue
        m = n - k + 1
        value = np.full(m, _U(k))
        for i in range(k):
            value = (value * _U(0x100000001B3)) ^ code[i: m + i]
        ok = row[:m] == row[k - 1:]
        for i in range(k) if k == 1 else range(1, k - 1):  # a boundary only at the ends
            ok = ok & (code[i: m + i] > 0)
        ok = np.flatnonzero(ok)
        buckets.append((mix(value[ok]) % _U(BUCKETS)).astype(np.int64))
        rows.append(row[ok])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), letters
    return np.concatenate(buckets), np.concatenate(rows), letters


@dataclass
class Model:
    """langs in sorted order, logits of each bucket (BUCKETS x langs), bias, temperature and rejection level."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        bucket, row, letters = grams(column)
        n = np.maximum(np.bincount(row, minlength=len(column)), 1)
        out = np.stack([np.bincount(row, self.table[bucket, j], len(column)) / n + self.bias[j] for j in range(len(self.langs))], axis=1)
        return out, letters

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, calibrated probability and rejection of each text."""
        if not self.langs:
            return ["und"] * len(column), np.zeros(len(column)), np.ones(len(column), bool)
        z, letters = self.logits(column)
        p = _softmax(z / self.temperature)
        best = p.argmax(axis=1)
        score = np.where(letters > 0, p[np.arange(len(p)), best], 0.0)
        return [self.langs[i] if n else "und" for i, n in zip(best, letters)], score, (score < self.least) | (letters == 0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams and how often each occurs; none without a letter."""
    bucket, _, letters = grams(pa.array([text], pa.string()))
    return np.unique(bucket if letters[0] else bucket[:0], return_counts=True)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int = 7) -> Model:
    """Train and calibrate on these rows; every fifth is set aside."""
    use = [i for i, (b, _) in enumerate(bags) if len(b)]
    langs = sorted({labels[i] for i in use})
    if not use:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    y = np.array([langs.index(labels[i]) for i in use])
    rows = [(b, c / c.sum()) for b, c in (bags[i] for i in use)]
    aside = np.arange(0, len(rows), 5) if len(rows) >= 10 else np.arange(len(rows))
    learn = np.setdiff1d(np.arange(len(rows)), aside) if len(rows) >= 10 else aside
    emb = rng.normal(0, 0.1, (BUCKETS, DIM))
    soft, bias = np.zeros((DIM, len(langs))), np.zeros(len(langs))
    epochs = min(EPOCHS, -(-STEPS // len(learn)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for i in rng.permutation(learn):
            bucket, weight = rows[i]
            h = weight @ emb[bucket]
            g = _softmax((h @ soft + bias)[None])[0]
            g[y[i]] -= 1
            back = soft @ g
            soft -= rate * np.outer(h, g)
            bias -= rate * 0.1 * g
            emb[bucket] -= (rate * 20 * weight)[:, None] * back  # a bag's step is shared by its many n-grams
    model = Model(langs, emb @ soft, bias)
    z = np.stack([rows[i][1] @ model.table[rows[i][0]] + bias for i in aside])
    losses = {t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(z)), y[aside]], 1e-12)).mean() for t in np.geomspace(0.25, 8, 41)}
    model.temperature = float(min(losses, key=losses.get))
    p = _softmax(z / model.temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y[aside]]
    if len(right) and len(langs) > 1:
        model.least = level(float(right.min()))
    return model


def level(q: float) -> float:
    """The rejection level for a least right probability q: below q, whatever q is."""
    q = min(q, 1 - 1e-9)
    return min(q / (q + (1 - q) * float(np.exp(MARGIN))), CEILING)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [bag(x) for x in batch.column("text").to_pylist()]
        yield batch_of({"order": (batch.column("order"), None), "lang": (batch.column("lang"), None),
                        "bucket": ([b.astype(np.int32).tobytes() for b, _ in found], pa.binary()), "n": ([c.astype(np.float32).tobytes() for _, c in found], pa.binary())})


def train(docs: DataFrame, learn_from: Column | None = None, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text, lang. learn_from: which rows may be learned from (all with a lang, if not given)."""
    rows = columns_of(docs, "doc_id", "text", "lang").where("lang is not null and text is not null")
    if learn_from is not None:
        rows = rows.where(learn_from)
    rows = rows.select(F.xxhash64(F.col("doc_id").cast("string"), "text", "lang").alias("order"), "text", "lang")
    least = [r[0] for r in rows.select("order").distinct().orderBy("order").limit(sample).collect()]
    if not least:
        return fit([], [])
    rows = rows.where(F.col("order") <= least[-1]).dropDuplicates(["order"])  # equal rows count once
    got = sorted(rows.mapInArrow(_bags, "order long, lang string, bucket binary, n binary").collect(), key=lambda r: (r.order, r.lang))
    return fit([(np.frombuffer(r.bucket, np.int32), np.frombuffer(r.n, np.float32)) for r in got], [r.lang for r in got])


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            lang, score, rejected = model.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                                             names=[*batch.schema.names, "lang_pred", "score", "rejected"])
    return run


def predicted(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep with lang_pred, score and rejected, for each row."""
    cols = [F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])]
    given = docs.select(*cols)
    out = given.mapInArrow(_scored(model), _ddl(given) + ", lang_pred string, score double, rejected boolean")
    return out.select(*keep, "lang_pred", "score", "rejected")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)), F.lit(0))


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of each row, learned from the rows that are not held out."""
    model = train(docs, fold() != 0)
    return predicted(docs, model).select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score", "rejected")
