"""Packing of tokenised documents into training sequences, online and in bounded space.

A document is its tokens and an end token. Every partition is read once, in its order, with ``WINDOWS`` open windows of
``CAPACITY`` tokens. A piece goes into the open window that it fills best; a window that is full is emitted. Where none
has room and all windows are open, the fullest is emitted: it is topped up with the first tokens of the piece, so nothing
is padded, and the rest of the piece is placed again. Documents of ``CAPACITY`` tokens and more give full sequences of their
own first. At the end of a partition its open windows are merged: the emptiest fills the fullest, piece by piece, until
one window is left. The last windows of ``FAN`` partitions (their tokens travel with them) meet in a task and are merged in
the same way, level by level, until one is left of the whole table. Sequences are padded to ``CAPACITY`` unless their length is a power of two; so
the last one is cut into sequences whose lengths are the powers of two that add up to it, and no token is padded.

Plan. Texts are read and tokenised in one pass without a shuffle; only the last windows of partitions, of fewer than
``CAPACITY`` tokens each, are shuffled. Placements are stored before anything is derived from them. Words are cut at ASCII white
space, which the vocabulary drops, and where its pattern parts them; a segment is encoded once while it is remembered.

Defined cases: a null or empty text has the end token alone. Repeated rows and doc_ids are documents of their own; a null
doc_id is carried along. Very long texts are cut. Columns other than doc_id and text are not read. An empty table gives no rows.
Which pieces share a sequence follows the partitions; that each token lies in exactly one piece, and what a piece says of its
tokens, do not.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, batch_of, columns_of, slices, stored

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
CAPACITY, WINDOWS, FAN, END = 2048, 64, 64, 1
_KIND = np.zeros(256, np.uint8)  # white space, ASCII letters, digits, other ASCII, beyond ASCII
_KIND[:128] = [0 if chr(c) in " \t\n\v\f\r" else 1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 3 for c in range(128)]
_KIND[128:] = 4
_PARTS = np.zeros((5, 5), bool)
_PARTS[1:4, 1:4] = True
_PARTS[[1, 3], [1, 3]] = False
FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class Segments(Words):
    """Words, lower-cased in A-Z and cut where the vocabulary's pattern parts them whatever stands around: between ASCII
    letters and other ASCII characters, and around each digit. Next to a character beyond ASCII nothing is cut, nor in a
    word with an apostrophe or the opening of a special token."""

    def __init__(self, column: pa.Array):
        super().__init__(column, lower=True)

    def _hashes(self) -> np.ndarray:
        kind = _KIND[self.data]
        cut = np.flatnonzero(_PARTS[kind[:-1], kind[1:]]) + 1
        whole = np.zeros(len(self.start) + 1, bool)
        odd = self.data == ord("'")
        odd[:-1] |= (self.data[:-1] == ord("<")) & (self.data[1:] == ord("|"))
        whole[np.searchsorted(self.start, np.flatnonzero(odd), "right") - 1] = True
        cut = cut[~whole[np.searchsorted(self.start, cut, "right") - 1]]
        for name in ("start", "end"):
            edge = np.zeros(len(self.data) + 1, bool)
            edge[getattr(self, name)] = edge[cut] = True
            setattr(self, name, np.flatnonzero(edge))
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        return super()._hashes()


class Encoder:
    """Token numbers of whole texts; the last segments are remembered under their hash."""

    KEEP = 1_000_000
    #: what the pattern keeps in one piece and byte-level encoding leaves as it is; the model alone encodes it
    PLAIN = re.compile(rb"[a-z]+|[0-9]|(?!.*<\|)[^\x00-\x20'0-9A-Za-z\x7f-\xff]+")

    def __init__(self, vocabulary: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(vocabulary)
        self.model = self.tokenizer.model
        self._forget()

    def _forget(self) -> None:
        self.known, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes in order, and their segments' numbers
        self.tokens, self.begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, segments: list[bytes], value: np.ndarray) -> None:
        odd = [w.decode("utf-8", "replace") for w in segments if not self.PLAIN.fullmatch(w)]
        rest = iter(self.tokenizer.encode_batch_fast(odd, add_special_tokens=False))
        ids = [[t.id for t in self.model.tokenize(w.decode())] if self.PLAIN.fullmatch(w) else next(rest).ids for w in segments]
        number = len(self.begin) - 1 + np.arange(len(ids))
        self.tokens = np.concatenate([self.tokens, np.array([i for x in ids for i in x], np.uint32)])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(np.array([len(x) for x in ids], np.int64))])
        value, number = np.concatenate([self.known, value]), np.concatenate([self.number, number])
        order = np.argsort(value, kind="stable")
        self.known, self.number = value[order], number[order]

    def encode(self, column: pa.Array, end: int = END) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all rows, each row's followed by the end token, and where rows begin."""
        words = Segments(column)
        value, at, back = np.unique(words.hash, return_index=True, return_inverse=True)
        if len(self.known) > self.KEEP:
            self._forget()
        place = np.minimum(np.searchsorted(self.known, value), max(0, len(self.known) - 1))
        new = self.known[place] != value if len(self.known) else np.ones(len(value), bool)
        data = words.data.tobytes()
        self._learn([data[s:e] for s, e in zip(words.start[at[new]].tolist(), words.end[at[new]].tolist())], value[new])
        number = self.number[np.searchsorted(self.known, value)][back]
        n = self.begin[number + 1] - self.begin[number]
        ends = np.cumsum(n)
        first = np.append(0, ends)[words.first] + np.arange(words.rows + 1)
        out, place = np.full(first[-1], end, np.uint32), np.arange(n.sum())
        out[place + np.repeat(words.row, n)] = self.tokens[place + np.repeat(self.begin[number] - ends + n, n)]
        return out, first


class Piece:
    __slots__ = ("doc", "start", "ids", "doc_tokens")

    def __init__(self, doc, start: int, ids: np.ndarray, doc_tokens: int):
        self.doc, self.start, self.ids, self.doc_tokens = doc, start, ids, doc_tokens

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[:n], self.doc_tokens), Piece(self.doc, self.start + n, self.ids[n:], self.doc_tokens)


class Packer:
    """At most ``windows`` open windows; emit(pieces) takes each full one."""

    def __init__(self, emit, capacity: int = CAPACITY, windows: int = WINDOWS):
        self.emit, self.capacity, self.windows = emit, capacity, windows
        self.room: list[tuple[int, int]] = []  # of each open window, in order: free tokens, number
        self.held: dict[int, list[Piece]] = {}
        self.number = 0

    def place(self, piece: Piece) -> None:
        while len(piece.ids) >= self.capacity:
            full, piece = piece.cut(self.capacity)
            self.emit([full])
        while len(piece.ids):
            k = bisect_left(self.room, (len(piece.ids), -1))
            if k < len(self.room):
                return self._put(k, piece)
            if len(self.room) < self.windows:
                self.held[self.number] = []
                insort(self.room, (self.capacity, self.number))
                self.number += 1
            else:
                first, piece = piece.cut(self.room[0][0])
                self._put(0, first)

    def _put(self, k: int, piece: Piece) -> None:
        free, number = self.room.pop(k)
        self.held[number].append(piece)
        if free == len(piece.ids):
            self.emit(self.held.pop(number))
        else:
            insort(self.room, (free - len(piece.ids), number))

    def open(self, pieces: list[Piece]) -> None:
        """A window that comes with pieces."""
        self.held[self.number] = list(pieces)
        insort(self.room, (self.capacity - sum(len(p.ids) for p in pieces), self.number))
        self.number += 1

    def merged(self) -> list[Piece]:
        """What is left when the emptiest windows have filled the fullest: pieces of one window."""
        while len(self.room) > 1:
            for piece in self.held.pop(self.room.pop()[1]):
                while len(piece.ids):
                    if not self.room:  # all the others are full
                        self.open([piece])
                        break
                    first, piece = piece.cut(min(len(piece.ids), self.room[0][0]))
                    self._put(0, first)
        return self.held.pop(self.room.pop()[1]) if self.room else []


def powers_of_two(pieces: list[Piece], emit) -> None:
    """The pieces in sequences whose lengths are powers of two, largest first."""
    left, pieces = sum(len(p.ids) for p in pieces), list(pieces)
    while left:
        size = free = 1 << (left.bit_length() - 1)
        own = []
        while free:
            first, rest = pieces[0].cut(free)
            own.append(first)
            free -= len(first.ids)
            pieces[:1] = [rest] if len(rest.ids) else []
        emit(own)
        left -= size


class _Rows:
    """Rows of sequences numbered from ``base``."""

    def __init__(self, base: int):
        self.base, self.number, self.rows = base, 0, []

    def emit(self, pieces: list[Piece], stays_open: bool = False) -> None:
        offset = 0
        for p in pieces:
            raw = p.ids.astype("<u4").tobytes()
            self.rows.append((p.doc, p.start, len(p.ids), zlib.crc32(raw), p.doc_tokens, self.base + self.number, offset, raw if stays_open else None))
            offset += len(p.ids)
        self.number += bool(pieces)

    def taken(self, kind: pa.DataType) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        kinds = [kind, *[pa.int64()] * 6, pa.binary()]
        return batch_of({n: ([r[k] for r in rows], t) for k, (n, t) in enumerate(zip((*FIELDS, "ids"), kinds))})


def _base(level: int, group: int) -> int:
    """Sequence numbers of one group of one level begin here."""
    return ((level << 24) + group) << 32


_ENCODER: dict = {}


def _packed(vocabulary: bytes, capacity: int, windows: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(vocabulary)
        if key not in _ENCODER:
            _ENCODER[key] = Encoder(vocabulary)
        encoder, out, kind = _ENCODER[key], _Rows(_base(0, TaskContext.get().partitionId())), None
        packer = Packer(out.emit, capacity, windows)
        for batch in slices(batches, "text"):
            docs = batch.column("doc_id")
            kind = docs.type
            ids, first = encoder.encode(batch.column("text"), end)
            for doc, a, b in zip(docs.to_pylist(), first[:-1].tolist(), first[1:].tolist()):
                packer.place(Piece(doc, 0, ids[a:b].copy(), b - a))
            yield out.taken(kind)
        if kind is not None:
            out.emit(packer.merged(), stays_open=True)
            yield out.taken(kind)
    return run


def _met(level: int, last: bool, capacity: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        out = _Rows(_base(level, key[0].as_py()))
        packer, held = Packer(out.emit, capacity), {}
        columns = [table.column(n).to_pylist() for n in ("sequence_id", "offset", "doc_id", "start", "ids", "doc_tokens")]
        for row in sorted(zip(*columns), key=lambda r: r[:2]):
            held.setdefault(row[0], []).append(Piece(row[2], row[3], np.frombuffer(row[4], "<u4"), row[5]))
        for pieces in held.values():
            packer.open(pieces)
        if last:
            powers_of_two(packer.merged(), out.emit)
        else:
            out.emit(packer.merged(), stays_open=True)
        return pa.Table.from_batches([out.taken(table.column("doc_id").type)])
    return run


def packed(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, windows: int = WINDOWS, fan: int = FAN, end: int = END) -> DataFrame:
    """docs: doc_id, text. A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset."""
    with open(vocabulary, "rb") as f:
        tokens = f.read()
    docs = columns_of(docs, "doc_id", "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{n} long' for n in FIELDS[1:])}, ids binary"
    rows = stored(docs.mapInArrow(_packed(tokens, capacity, windows, end), schema))
    placed, left = rows.where("ids is null").select(*FIELDS), rows.where("ids is not null")
    level, groups = 0, 0
    while groups != 1 and (n := left.select("sequence_id").distinct().count()):
        level, groups = level + 1, -(-n // fan)
        group = F.pmod(F.xxhash64("sequence_id"), F.lit(groups)).alias("g")
        rows = stored(left.groupBy(group).applyInArrow(_met(level, groups == 1, capacity), schema))
        placed, left = placed.unionByName(rows.where("ids is null").select(*FIELDS)), rows.where("ids is not null")
    return placed
