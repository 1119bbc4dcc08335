"""Removal of repeated word sequences by a compacted de Bruijn graph of token k-mers.

A word is removed if it is covered by a window of ``window`` words whose sequence also starts earlier (smaller doc_id,
or the same document at an earlier word). The graph is built over content-selected edges, so that not every position
of the corpus is shuffled:

1. *Edges.* Each window is filed under its least k-mer (k = 6 of 20 words; the leftmost of equal ones). The windows
   under one k-mer occurrence are neighbours and form one edge: the k-mer's hash and the hash of all words that these
   windows cover. Equal windows always lie under equal k-mers, whatever surrounds them.
2. *Degree.* One aggregate over the k-mers: occurrences, least and greatest content, and where it first occurs. A k-mer
   with one occurrence is dropped. One whose occurrences all have the same content does not branch: its windows are
   all equal, so one source coordinate stands for them. A k-mer with several contents branches.
3. *Compaction.* Occurrences join the degrees. In each document, consecutive edges that do not branch and run along
   the same source compact into one path. Only at branching edges (the ends of repeats, variants inside near copies)
   are single windows hashed and counted, and there once for each distinct content, not for each occurrence.
4. *Verification.* The words of each path are held against the words at its source coordinates; paths that differ are
   not removed.

Hot groups: counts and minima are combined before the shuffle, and every join is one that adaptive execution may split.
Texts are shuffled once and that exchange is used again by the later joins.

Defined cases: null or empty text: no words, nothing removed, the hash of the empty string. A null doc_id counts as
smaller than all others. Rows that repeat a doc_id are not earlier than one another; each is judged by smaller doc_ids
and by its own earlier words. Ties do not arise otherwise. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, batch_of, columns_of, mix, signed, slices, stored

WINDOW, KMER = 20, 6
_ROW = (1 << 26) - 1
NO_ID = -(1 << 63)
_U = np.uint64


def _first_least(h: np.ndarray, w: int) -> np.ndarray:
    """For each i the position of the leftmost least value of h[i:i+w]."""
    at = np.arange(len(h))
    have = 1
    while have < w and len(at):
        step = min(have, w - have)
        a, b = at[:-step], at[step:]
        at = np.where(h[a] <= h[b], a, b)
        have += step
    return at


def edges_of(words: Words, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Of each edge: the row, the first and last window start, the k-mer's hash and the content's hash."""
    left, prefix = words.left(), words.prefix()
    h = np.full(len(left), ~_U(0))
    inside = np.flatnonzero(left >= k)
    h[inside] = words.span(prefix, inside, inside + k)
    start = np.flatnonzero(left >= window)
    at = _first_least(h, window - k + 1)[start]
    new = np.flatnonzero(np.diff(at, prepend=-1))
    first, last = start[new], start[np.append(new[1:], len(start)) - 1] if len(new) else start[:0]
    content = words.span(prefix, first, last + window) ^ mix((at[new] - first).astype(np.uint64))
    return words.row[first], first, last, h[at[new]], content


def _again(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether the value has come before in its row (positions ascend)."""
    order = np.lexsort((np.arange(len(row)), value, row))
    same = np.zeros(len(row), bool)
    same[order[1:]] = (row[order[1:]] == row[order[:-1]]) & (value[order[1:]] == value[order[:-1]])
    return same


def _edges(window: int, k: int):
    """pack: first window start (31 bits), number of further windows (6), whether the k-mer has come before in the row
    (1), the row's own number (26)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"))
            row, first, last, kmer, content = edges_of(words, window, k)
            rid = batch.column("rid").to_numpy().astype(np.int64)[row]
            pack = (first - words.first[row]) | (last - first) << 31 | _again(row, kmer).astype(np.int64) << 37 | rid << 38
            yield batch_of({"kmer": (signed(kmer), pa.int64()), "content": (signed(content), pa.int64()), "key": (batch.column("key").take(pa.array(row)), None), "pack": (pack, pa.int64())})
    return run


FIRST, MORE, AGAIN, RID = "cast(pack & 2147483647 as int)", "cast(shiftright(pack, 31) & 63 as int)", "(shiftright(pack, 37) & 1) = 1", f"cast(shiftright(pack, 38) & {_ROW} as int)"


def _entries(batch: pa.RecordBatch, *names: str) -> tuple[np.ndarray, ...]:
    """Of the listed structs that belong to the row (same rid): the row and the named fields, in order of the first
    field, once each."""
    column = batch.column("list")
    n = np.diff(column.offsets.to_numpy())
    row = np.repeat(np.arange(len(n)), n)
    flat = column.flatten()
    field = lambda x: flat.field(x).to_numpy(zero_copy_only=False)
    own = np.flatnonzero(field("rid") == batch.column("rid").to_numpy(zero_copy_only=False)[row])
    got = [row[own], *(field(x)[own] for x in names)]
    order = np.lexsort((got[1], got[0]))
    got = [x[order] for x in got]
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(got[0]) != 0) | (np.diff(got[1]) != 0)
    return tuple(x[new] for x in got)


def _contents(window: int):
    """The contents of branching edges, which were left out of the first shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            row, first, more, kmer, pack = _entries(batch, "first", "more", "kmer", "pack")
            words = Words(batch.column("text"))
            at = words.first[row] + first
            yield batch_of({"kmer": (kmer, pa.int64()), "content": (signed(words.span(words.prefix(), at, at + more + window)), pa.int64()), "key": (batch.column("key").take(pa.array(row)), None), "pack": (pack, pa.int64())})
    return run


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            row, first, more, kmer, content = _entries(batch, "first", "more", "kmer", "content")
            words = Words(batch.column("text"))
            n = more.astype(np.int64) + 1
            j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row, first, kmer, content = (np.repeat(x, n) for x in (row, first, kmer, content))
            at = words.first[row] + first + j
            yield batch_of({"kmer": (kmer, pa.int64()), "content": (content, pa.int64()), "j": (j, pa.int32()), "value": (signed(words.span(words.prefix(), at, at + window)), pa.int64()),
                            "src": (batch.column("key").take(pa.array(row)), None)})
    return run


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _texts(batch: pa.RecordBatch, rows: np.ndarray) -> dict[int, list[bytes]]:
    text = batch.column("text")
    return {i: (text[i].as_py() or "").encode().split() for i in np.unique(rows).tolist()}


def _paths(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            row, first, more, src, at = _entries(batch, "first", "more", "src", "src_first")
            last = first + more
            new = np.ones(len(row), bool)
            if len(row):
                new[1:] = (np.diff(row) != 0) | (first[1:] != last[:-1] + 1) | (np.diff(src) != 0) | (np.diff(first - at) != 0)
            begin = np.flatnonzero(new)
            end = last[np.append(begin[1:], len(row)) - 1] + window if len(row) else last
            row, first, src, at = row[begin], first[begin], src[begin], at[begin]
            texts = _texts(batch, row)
            take = pa.array(row)
            yield batch_of({
                "key": (batch.column("key").take(take), None), "rid": (batch.column("rid").take(take), None),
                "start": (first, pa.int32()), "n": (end - first, pa.int32()), "src": (src, pa.int64()), "at": (at, pa.int32()),
                "digest": ([_digest(texts[i][a:b]) for i, a, b in zip(row.tolist(), first.tolist(), end.tolist())], pa.binary()),
            })
    return run


def _sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        asked = batch.column("list").to_pylist()
        texts = _texts(batch, np.arange(batch.num_rows))
        flat = [(i, x["at"], x["n"]) for i, xs in enumerate(asked) for x in xs]
        yield batch_of({
            "src": (batch.column("key").take(pa.array([i for i, *_ in flat], pa.int64())), None), "at": ([a for _, a, _ in flat], pa.int32()), "n": ([n for *_, n in flat], pa.int32()),
            "digest": ([_digest(texts[i][a: a + n]) for i, a, n in flat], pa.binary()),
        })


SPAN, MASK, OWN = 0, 1, 2  # what an entry's value is: words to remove; windows to remove; windows to remove if they came before in the row


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rids, out = batch.column("rid").to_pylist(), []
            for i, (text, listed) in enumerate(zip(batch.column("text").to_pylist(), batch.column("list").to_pylist())):
                words = (text or "").encode().split()
                own = [x for x in listed or () if x["rid"] == rids[i]]
                if not own:
                    out.append((len(words), 0, b" ".join(words)))
                    continue
                keep = np.ones(len(words), bool)
                if any(x["kind"] == OWN for x in own):
                    start, value = Words(batch.column("text").slice(i, 1)).windows(window)
                    before = np.zeros(len(words) + 64, bool)
                    before[start] = _again(np.zeros(len(start), np.int64), value)
                for x in own:
                    if x["kind"] == SPAN:
                        keep[x["start"]: x["start"] + x["value"]] = False
                        continue
                    for j in range(x["value"].bit_length()):
                        if x["value"] >> j & 1 and (x["kind"] == MASK or before[x["start"] + j]):
                            keep[x["start"] + j: x["start"] + j + window] = False
                out.append((len(words), len(words) - int(keep.sum()), b" ".join(compress(words, keep.tolist()))))
            yield batch_of({
                "key": (batch.column("key"), None), "n_words": ([x[0] for x in out], pa.int64()), "n_removed": ([x[1] for x in out], pa.int64()),
                "kept_text": ([x[2].decode() for x in out], pa.string()),
            })
    return run


def _hashed(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(window)(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([hashlib.sha256(x.as_py().encode()).hexdigest() for x in batch.column("kept_text")], pa.string())],
                                             names=["key", "n_words", "n_removed", "kept_sha256"])
    return run


def repeated_spans(texts: DataFrame, window: int = WINDOW, k: int = KMER) -> DataFrame:
    """texts: key, rid, text. Returns key, rid, start, value, kind: what to remove; see SPAN, MASK, OWN."""
    if not 0 < window - k + 1 <= 62:
        raise ValueError("a window must have at most 62 k-mers")
    edges = texts.select("key", "rid", "text").mapInArrow(_edges(window, k), "kmer long, content long, key long, pack long")
    degree = edges.groupBy("kmer").agg(F.count("*").alias("n"), F.min("content").alias("low"), F.max("content").alias("high"), F.min("key").alias("src"), F.min_by(F.expr(FIRST), "key").alias("src_first"))
    degree = degree.where("n > 1").select("kmer", (F.col("low") != F.col("high")).alias("branch"), "src", "src_first")
    repeated = edges.drop("content").join(degree, "kmer").where(f"branch or key > src or (key = src and {AGAIN})")
    only = lambda c, test: F.when(F.expr(test), F.col(c)).alias(c)
    # written once: what the parts below need of it differs, so they could not share its exchanges
    repeated = stored(repeated.select("key", "pack", "branch", only("kmer", "branch"), *[only(c, "not branch") for c in ("src", "src_first")]))
    lists = repeated.where("branch").groupBy("key").agg(F.collect_list(F.struct(F.expr(RID).alias("rid"), F.expr(FIRST).alias("first"), F.expr(MORE).alias("more"), "kmer", "pack")).alias("list"))
    branching = texts.join(lists, "key").select("key", "rid", "text", "list").mapInArrow(_contents(window), "kmer long, content long, key long, pack long")

    contents = branching.groupBy("kmer", "content").agg(F.min("key").alias("least"), F.min_by("pack", "key").alias("pack"))
    shown = contents.groupBy(F.col("least").alias("key")).agg(F.collect_list(F.struct(F.expr(RID).alias("rid"), F.expr(FIRST).alias("first"), F.expr(MORE).alias("more"), "kmer", "content")).alias("list"))
    windows = texts.join(shown, "key").select("key", "rid", "text", "list").mapInArrow(_windows(window), "kmer long, content long, j int, value long, src long")
    # in which earlier document, if any, a window of a content occurs: under another content of the same k-mer
    earliest = F.min("src").over(Window.partitionBy("kmer", "value"))
    before = windows.withColumn("first", earliest).where("first < src").groupBy("kmer", "content").agg(F.bit_or(F.expr("shiftleft(1L, j)")).alias("mask"))
    found = contents.select("kmer", "content", "least").join(before, ["kmer", "content"], "left")
    every = F.expr(f"shiftleft(1L, {MORE} + 1) - 1")
    later = F.col("key") > F.col("least")  # the whole content occurs in an earlier document
    marked = branching.join(found, ["kmer", "content"]).select(
        "key", "pack", F.when(later, every).otherwise(F.coalesce("mask", F.lit(0))).alias("mask"), F.when(~later & F.expr(AGAIN), every).otherwise(F.lit(0)).alias("own"))
    entry = lambda value, kind: marked.where(f"{value} != 0").select("key", F.expr(RID).alias("rid"), F.expr(FIRST).alias("start"), F.col(value).alias("value"), F.lit(kind).alias("kind"))

    lying = repeated.where("not branch").groupBy("key").agg(F.collect_list(F.struct(F.expr(RID).alias("rid"), F.expr(FIRST).alias("first"), F.expr(MORE).alias("more"), "src", "src_first")).alias("list"))
    paths = texts.join(lying, "key").select("key", "rid", "text", "list").mapInArrow(_paths(window), "key long, rid int, start int, n int, src long, at int, digest binary")
    asked = paths.select("src", "at", "n").distinct().groupBy("src").agg(F.collect_list(F.struct("at", "n")).alias("list")).withColumnRenamed("src", "key")
    source = texts.join(asked, "key").select("key", "rid", "text", "list").mapInArrow(_sources, "src long, at int, n int, digest binary")
    verified = paths.join(source, ["src", "at", "n", "digest"], "left_semi").select("key", "rid", "start", F.col("n").cast("long").alias("value"), F.lit(SPAN).alias("kind"))
    return verified.unionByName(entry("mask", MASK)).unionByName(entry("own", OWN))


def _keyed(docs: DataFrame) -> DataFrame:
    docs = columns_of(docs, "doc_id", "text")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.coalesce(F.hash("text").bitwiseAND(_ROW), F.lit(0)).alias("rid"), "text")


def _removed(docs: DataFrame, window: int, k: int, last, schema: str) -> DataFrame:
    texts = _keyed(docs)
    spans = repeated_spans(texts, window, k).groupBy("key").agg(F.collect_list(F.struct("rid", "start", "value", "kind")).alias("list"))
    out = texts.join(spans, "key", "left").select("key", "rid", "text", "list").mapInArrow(last(window), schema)
    return out.withColumn("doc_id", F.expr(f"if(key = {NO_ID}, null, key)")).drop("key")


def deduplicated(docs: DataFrame, window: int = WINDOW, k: int = KMER) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by single spaces (kept_text) of every row."""
    return _removed(docs, window, k, _cut, "key long, n_words long, n_removed long, kept_text string").select("doc_id", "n_words", "n_removed", "kept_text")


def deduplicated_digest(docs: DataFrame, window: int = WINDOW, k: int = KMER) -> DataFrame:
    """As deduplicated(), with the SHA-256 of the kept words instead of them."""
    return _removed(docs, window, k, _hashed, "key long, n_words long, n_removed long, kept_sha256 string").select("doc_id", "n_words", "n_removed", "kept_sha256")
