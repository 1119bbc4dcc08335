"""MD5 of many messages of one length as array arithmetic, for draws made inside tasks."""

from __future__ import annotations

import math

import numpy as np

_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_ADD = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def md5_words(messages: np.ndarray) -> np.ndarray:
    """(n, length) bytes to (4, n): the digest's hex digits in eights, as integers below 2^32."""
    n, length = messages.shape
    blocks = (length + 8) // 64 + 1
    padded = np.zeros((n, blocks * 64), np.uint8)
    padded[:, :length] = messages
    padded[:, length] = 0x80
    padded[:, -8:] = np.frombuffer((8 * length).to_bytes(8, "little"), np.uint8)
    words = np.ascontiguousarray(padded.view("<u4").T)
    state = [np.full(n, x, np.uint32) for x in _START]
    for at in range(0, len(words), 16):
        state = [x + y for x, y in zip(state, _block(words[at: at + 16], *state))]
    return np.stack(state).astype("<u4", copy=False).byteswap()


def _block(m, a, b, c, d):
    f, t, high = (np.empty_like(a) for _ in range(3))
    a, b, c, d = (x.copy() for x in (a, b, c, d))
    for i in range(64):
        turn = i // 16
        if turn == 0:
            np.bitwise_and(np.bitwise_xor(c, d, out=f), b, out=f)
            np.bitwise_xor(f, d, out=f)
            g = i
        elif turn == 1:
            np.bitwise_and(np.bitwise_xor(b, c, out=f), d, out=f)
            np.bitwise_xor(f, c, out=f)
            g = (5 * i + 1) % 16
        elif turn == 2:
            np.bitwise_xor(np.bitwise_xor(b, c, out=f), d, out=f)
            g = (3 * i + 5) % 16
        else:
            np.bitwise_or(np.invert(d, out=f), b, out=f)
            np.bitwise_xor(f, c, out=f)
            g = 7 * i % 16
        np.add(f, a, out=f)
        np.add(f, m[g], out=f)
        np.add(f, _ADD[i], out=f)
        by = _SHIFTS[turn][i % 4]
        np.left_shift(f, np.uint32(by), out=t)
        np.right_shift(f, np.uint32(32 - by), out=high)
        np.bitwise_or(t, high, out=t)
        np.add(t, b, out=a)  # the old a is used up
        a, b, c, d = d, a, b, c
    return a, b, c, d
