"""What the operators of this package share: tables in the shared folder, and words and hashes over Arrow batches.

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D``. Batches are cut into slices of about ``SLICE`` bytes of
text before numpy arrays are made from them, so a worker's memory does not depend on the rows of an Arrow batch; a
longer text is a slice by itself.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FOLD = _LOWER.copy()
_FOLD[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32
_BYTE = np.random.default_rng(20260101).integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_STEP = 0xD6E8FEB86659FD93
_U = np.uint64


# ---------------------------------------------------------------- shared folder
def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        top = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{top.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows written once as Parquet to the shared folder and read again: lineage ends here."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, so that others cannot clash with an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


# ---------------------------------------------------------------- slices and words
def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches again, cut so that one holds about ``limit`` bytes of ``column`` or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.diff(_offsets(batch.column(column))[1]))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def _offsets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column (null: none) and the offsets of its rows."""
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset: col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0]: off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of an odd base and of its inverse, modulo 2**64; grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * _U(pow(self.base, m, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * _U(pow(self.inverse, m, 1 << 64))])
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_BASE), _Powers(_STEP)


class Words:
    """The words of the texts of one slice: their bounds in the bytes, 64-bit hashes and rows.

    ``first[r]`` to ``first[r + 1]`` are the words of row r."""

    def __init__(self, column: pa.Array, lower: bool = False, fold: bool = False):
        """lower: A-Z count as a-z; fold: ASCII punctuation also separates words."""
        data, off = _offsets(column)
        data = _FOLD[data] if fold else _LOWER[data] if lower else data
        self.data = data
        self.rows = len(column)
        inside = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)
        self.offsets = off
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(out):  # long texts in pieces
            lo = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, lo + 2 * SLICE, "right")))
            piece = self.data[lo: self.end[to - 1]]
            up, down = _BYTES.to(len(piece) + 1)
            total = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(_BYTE[piece] * up[:-1], out=total[1:])
            s, e = self.start[at:to] - lo, self.end[at:to] - lo
            out[at:to] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
            at = to
        return out

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.count)

    def left(self) -> np.ndarray:
        """For each word, how many words of its text there are from it on."""
        return np.repeat(self.first[1:], self.count) - np.arange(len(self.hash))

    def prefix(self) -> np.ndarray:
        """Sums from which span() hashes any run of words."""
        up, _ = _WORDS.to(len(self.hash) + 1)
        total = np.zeros(len(self.hash) + 1, np.uint64)
        np.cumsum(self.hash * up[:-1], out=total[1:])
        return total

    def span(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the words from start to end (exclusive)."""
        _, down = _WORDS.to(len(prefix))
        return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the k-word windows that lie in one text, and their hashes."""
        start = np.flatnonzero(self.left() >= k)
        return start, self.span(self.prefix(), start, start + k)


def sliding(x: np.ndarray, w: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over x[i:i+w], for each i with a whole window."""
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = best(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def batch_of(columns: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in columns.values()], names=list(columns))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def struct(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)
