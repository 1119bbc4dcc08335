"""The draws of ``draws``, of many keys at once in numpy.

A key is a head (its leading parts, joined by ``draws.draw_head``) and a last part, a whole number.  The md5 of a short key is one
block, whose 64 steps are taken for thousands of keys together; long keys and last parts beyond 9,999 go through hashlib.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from .draws import SPAN

LANES = 1 << 13  # keys whose steps are taken together
ROOM = 48  # bytes of a head that leaves room for the last part in one block

_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SINES = tuple(np.uint32(int(abs(math.sin(k + 1)) * 2 ** 32)) for k in range(64))
_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_WORD = (lambda k: k, lambda k: (5 * k + 1) % 16, lambda k: (3 * k + 5) % 16, lambda k: 7 * k % 16)


def _md5(words: list[np.ndarray | None]) -> list[np.ndarray]:
    """The first three words of the digests of one block each; a word that is None is 0 in every block."""
    n = len(words[14])
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for k in range(64):
        turn = k // 16
        if turn == 0:  # d ^ (b & (c ^ d))
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif turn == 1:  # c ^ (d & (b ^ c))
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:  # c ^ (b | ~d)
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        np.add(f, _SINES[k], out=f)
        word = words[_WORD[turn](k)]
        if word is not None:
            np.add(f, word, out=f)
        s = _SHIFTS[turn][k % 4]
        np.left_shift(f, np.uint32(s), out=t)
        np.right_shift(f, np.uint32(32 - s), out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    return [x + np.uint32(s) for x, s in zip((a, b, c), _START)]


def _ends(most: int) -> np.ndarray:
    """The digits of 0..most and the mark that follows a message, as little-endian numbers of at most five bytes."""
    out = np.arange(most + 1).astype("S8").view(np.uint64)
    size = np.searchsorted([10, 100, 1000], np.arange(most + 1), side="right") + 1
    return out | (np.uint64(0x80) << (8 * size).astype(np.uint64))


def key_numbers(heads: Sequence[str], which: np.ndarray, last: np.ndarray, words: int = 3) -> np.ndarray:
    """For every key, the head ``heads[which]`` and ``last``: ``words`` numbers below 2^32, each of eight hex digits of its md5."""
    out = np.empty((len(last), words), np.int64)
    raw = [h.encode() for h in heads]
    long = np.array([len(h) for h in raw], np.int64)
    packed = np.array([h if len(h) <= ROOM else b"" for h in raw], f"S{ROOM + 4}").view("<u4").reshape(len(raw), ROOM // 4 + 1).T.copy()
    plain = (long[which] <= ROOM) & (last >= 0) & (last < 10000)
    for k in np.flatnonzero(~plain):
        out[k] = np.frombuffer(hashlib.md5(raw[which[k]] + str(int(last[k])).encode()).digest(), ">u4", words)
    ends = _ends(int(last[plain].max(initial=0)))
    size = np.searchsorted([10, 100, 1000], np.arange(len(ends)), side="right") + 1
    for length in np.unique(long[which[plain]]):  # heads of one length end in the same byte of the same word
        rows = np.arange(len(last)) if plain.all() and (long == length).all() else np.flatnonzero(plain & (long[which] == length))
        at, shifted = int(length) // 4, ends << np.uint64(8 * (int(length) % 4))
        low, high = (shifted & np.uint64(0xFFFFFFFF)).astype(np.uint32), (shifted >> np.uint64(32)).astype(np.uint32)
        bits = (8 * (size + length)).astype(np.uint32)
        for start in range(0, len(rows), LANES):
            mine = rows[start: start + LANES]
            head, end = which[mine], last[mine]
            block = [packed[k].take(head) for k in range(at)] + [packed[at].take(head) | low.take(end), high.take(end)]
            got = _md5(block + [None] * (14 - len(block)) + [bits.take(end), None])
            for k in range(words):
                out[mine, k] = got[k].byteswap()
    return out


def slabs(sizes: np.ndarray, most: int = 4 * LANES) -> Iterator[tuple[int, int]]:
    """Stretches of consecutive rows whose sizes add up to ``most`` at most, or of one row."""
    start, total = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if k > start and total + n > most:
            yield start, k
            start, total = k, 0
        total += n
    if len(sizes):
        yield start, len(sizes)


def lists_of(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lengths of the lists of a column, 0 where there is none, and their entries."""
    return np.asarray(column.value_lengths().fill_null(0), np.int64), column.flatten()


def places(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists laid end to end, of every entry: which list it is in, and its index there."""
    which = np.repeat(np.arange(len(lengths)), lengths)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def with_draws(df: DataFrame, heads: Column, last: Column, out: str) -> DataFrame:
    """Adds ``out``, an array for each of the ``heads`` (``draws.draw_head``): draws in [0, 1) of the whole numbers of its list
    in ``last``."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.ArrayType(T.DoubleType())))])
    names = schema.fieldNames()

    def run(batches):
        for batch in batches:
            n_heads, lists = lists_of(batch.column("__heads"))[0], batch.column("__last")
            if (lists_of(lists)[0] != n_heads).any():
                raise ValueError("a list for every head")
            sizes = np.r_[0, np.cumsum(lists_of(lists.flatten())[0])]
            ends = np.r_[0, np.cumsum(n_heads)]
            for start, end in slabs(np.diff(sizes[ends])):
                part = batch.slice(start, end - start)
                size, numbers = lists_of(part.column("__last").flatten())
                got = key_numbers(part.column("__heads").flatten().to_pylist(), places(size)[0], np.asarray(numbers, np.int64), 1)[:, 0] / float(SPAN)
                inner = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.array(got))
                rows = pa.ListArray.from_arrays(pa.array(ends[start: end + 1] - ends[start], pa.int32()), inner)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:-1]), rows], names=names)

    return df.withColumns({"__heads": heads, "__last": last.cast("array<array<bigint>>")}).mapInArrow(run, schema)
