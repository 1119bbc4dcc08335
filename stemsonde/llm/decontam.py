"""Benchmark decontamination: a BM25 inverted index of test items, searched by every passage with block-max WAND.

*Index.* Test items are few against the corpus, so they are indexed and the passages are the queries. Items are dealt
into shards of at most ``SHARD_WORDS`` words (that bounds what a task is sent; each shard is one pass over the
documents) and, within a shard, into classes by length: a class of items of up to S words is searched by passages of
2 S words every S words, so each occurrence lies whole in a passage. Impacts are BM25 weights over the sum that the
item reaches against itself; document frequencies count all items of all shards. Postings are in item order, cut into
blocks of ``BLOCK`` items with the greatest impact of each.

*Search.* For all passages of a slice at once: the sums of the terms' greatest impacts (passages below the threshold
have no result), of the maxima of ``COARSE`` blocks together, and of block maxima; blocks below the threshold are jumped
over. In the blocks left open, item at a time: cursors in item order, and the pivot is the first item whose preceding
upper bounds reach the threshold; items before it are skipped, others scored. All items that score ``SCORE`` and above
are found, no top-k.

*Verification.* Word trigrams of the item's question (first three quarters of its words) and answer (the rest) are
looked up in the passage; both shares must reach ``OVERLAP`` (all of them for items under ``SHORT`` words).

Words are runs of letters and digits: A-Z count as a-z and ASCII punctuation separates. Defined cases: null or empty
text or item: no words, no result. Repeated items are items of their own; items with the same text are all reported.
Repeated documents get equal results. Null ids are carried along. Ties (a pair found in several passages): the passage
with the greatest score, then the first. Columns other than doc_id, text, item_id are not read. No items: no results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, batch_of, columns_of, slices, stored

K1, B = 1.2, 0.75
SCORE, OVERLAP, SHORT = 0.5, 0.6, 13
BLOCK, COARSE, SHARD_WORDS = 4, 4, 100_000
MIN_CLASS = 32
_LOSS = 1e-4  # bounds are kept in single precision


@dataclass
class Index:
    """Items of one length class: terms (sorted hashes), postings by term, bounds, and what verification needs."""

    size: int
    item_ids: list
    terms: np.ndarray
    first: np.ndarray
    items: np.ndarray
    impact: np.ndarray
    best: np.ndarray
    coarse: np.ndarray
    block_best: np.ndarray
    parts: list[tuple[tuple[int, np.ndarray], tuple[int, np.ndarray], float]]  # gram length and grams of question and answer

    def term_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each term, -1 if it is in no item."""
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def wand(self, terms: np.ndarray, blocks: np.ndarray, least: float) -> list[tuple[int, float]]:
        """All items of the open blocks that the distinct terms score at least at, with their scores."""
        out = []
        for block in blocks.tolist():
            cursor, end = {}, {}
            for t in terms[self.block_best[terms, block] > 0].tolist():
                items = self.items[self.first[t]: self.first[t + 1]]
                cursor[t], end[t] = (int(self.first[t] + np.searchsorted(items, x)) for x in (block * BLOCK, (block + 1) * BLOCK))
            while cursor:
                order = sorted(cursor, key=lambda t: (self.items[cursor[t]], t))
                bound, pivot = 0.0, None
                for t in order:
                    bound += float(self.block_best[t, block])
                    if bound >= least - _LOSS:
                        pivot = int(self.items[cursor[t]])
                        break
                if pivot is None:
                    break
                score = 0.0
                for t in order:
                    while cursor[t] < end[t] and self.items[cursor[t]] < pivot:
                        cursor[t] += 1
                    if cursor[t] < end[t] and self.items[cursor[t]] == pivot:
                        score += float(self.impact[cursor[t]])
                        cursor[t] += 1
                    if cursor[t] == end[t]:
                        del cursor[t]
                if score >= least - 1e-9:
                    out.append((pivot, score))
        return out


def _trigrams(words: np.ndarray, k: int = 3) -> np.ndarray:
    """Hashes of the word trigrams; of all words together where there are fewer."""
    k = max(1, min(k, len(words)))
    if not len(words):
        return words
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + (words[i: len(out) + i] ^ (out >> np.uint64(29)))
    return out


def build(item_ids: list, words: list[np.ndarray], df: dict[int, int], n_items: int, mean: float) -> list[Index]:
    """Indexes of these items by length class. df: of each term hash, in how many of all n_items items it occurs."""
    classes: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if len(w):
            classes.setdefault(max(MIN_CLASS, 1 << (len(w) - 1).bit_length()), []).append(i)
    out = []
    for size, members in sorted(classes.items()):
        rows = []
        for k, i in enumerate(members):
            term, tf = np.unique(words[i], return_counts=True)
            n = np.array([df[int(t)] for t in term])
            weight = np.log(1 + (n_items - n + 0.5) / (n + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words[i]) / mean))
            rows.append((term, np.full(len(term), k), weight / weight.sum()))
        term, item, impact = (np.concatenate(x) for x in zip(*rows))
        order = np.lexsort((item, term))
        term, item, impact = term[order], item[order], impact[order]
        terms, first = np.unique(term, return_index=True)
        number = np.repeat(np.arange(len(terms)), np.diff(np.append(first, len(term))))
        blocks = -(-len(members) // (BLOCK * COARSE)) * COARSE
        block_best = np.zeros((len(terms), blocks), np.float32)
        np.maximum.at(block_best, (number, item // BLOCK), impact.astype(np.float32))
        coarse = block_best.reshape(len(terms), -1, COARSE).max(axis=2)
        parts = []
        for i in members:
            cut = len(words[i]) - max(1, len(words[i]) // 4)
            parts.append((*((min(3, len(x)), _trigrams(x)) for x in (words[i][:cut], words[i][cut:])), OVERLAP if len(words[i]) >= SHORT else 1.0))
        out.append(Index(size, [item_ids[i] for i in members], terms, np.append(first, len(term)), item, impact, block_best.max(axis=1), coarse, block_best, parts))
    return out


def _passages(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages of 2 * size words every size words: their rows, first and end words."""
    n = np.maximum(1, -(-words.count // size) - 1) * (words.count > 0)
    row = np.repeat(np.arange(words.rows), n)
    start = words.first[row] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * size
    return row, start, np.minimum(start + 2 * size, words.first[row + 1])


def _bounded(index: Index, words: Words, start: np.ndarray, end: np.ndarray, least: float):
    """Passages in which a block's bound reaches the threshold, each with its distinct terms and those blocks."""
    term = index.term_ids(words.hash)
    n = end - start
    place = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
    passage, term = np.repeat(np.arange(len(start)), n), term[place]
    known = term >= 0
    code = np.unique(passage[known] * len(index.terms) + term[known])
    passage, term = code // len(index.terms), code % len(index.terms)
    able = np.bincount(passage, index.best[term], len(start)) >= least - _LOSS
    for bounds in (index.coarse, index.block_best):
        passage, term = passage[able[passage]], term[able[passage]]
        if not len(passage):
            return
        begin = np.flatnonzero(np.diff(passage, prepend=-1))
        reach = np.concatenate([np.add.reduceat(bounds[term, at: at + 64], begin, axis=0) >= least - _LOSS for at in range(0, bounds.shape[1], 64)], axis=1)
        able[passage[begin]] = reach.any(axis=1)
    for i, a, b in zip(range(len(begin)), begin.tolist(), np.append(begin[1:], len(term)).tolist()):
        if (blocks := np.flatnonzero(reach[i])).size:
            yield int(passage[a]), term[a:b], blocks


def search(indexes: list[Index], words: Words, least: float = SCORE) -> list[tuple]:
    """Of each (row, item) retrieved in some passage: row, item_id, score, first word of the passage, share of the
    question's and the answer's trigrams in it, and whether both suffice."""
    found: dict[tuple, tuple] = {}
    for c, index in enumerate(indexes):
        row, start, end = _passages(words, index.size)
        for p, terms, blocks in _bounded(index, words, start, end, least):
            r, hashes = int(row[p]), words.hash[start[p]: end[p]]
            grams: dict[int, np.ndarray] = {}
            for item, score in index.wand(terms, blocks, least):
                *parts, need = index.parts[item]
                share = []
                for k, part in parts:
                    if k not in grams:
                        grams[k] = _trigrams(hashes, k)
                    share.append(float(np.isin(part, grams[k]).mean()) if len(part) else 1.0)
                got = (score, -int(start[p] - words.first[r]), *share, share[0] >= need and share[1] >= need)
                key = (r, c, item)
                if key not in found or (got[4], got[0], got[1]) > (found[key][4], found[key][0], found[key][1]):
                    found[key] = got
    return [(r, indexes[c].item_ids[i], s, -at, q, a, ok) for (r, c, i), (s, at, q, a, ok) in sorted(found.items())]


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        words = Words(batch.column("text"), fold=True)
        rows = [words.hash[words.first[i]: words.first[i + 1]].view(np.int64) for i in range(words.rows)]
        yield batch_of({"item_id": (batch.column("item_id"), None), "words": (rows, pa.list_(pa.int64()))})


def indexes_of(items: DataFrame) -> Iterator[list[Index]]:
    """One list of indexes for each shard of the items (item_id, text)."""
    items = columns_of(items, "item_id", "text").where("text is not null")
    rows = stored(items.mapInArrow(_worded, f"item_id {items.schema['item_id'].dataType.simpleString()}, words array<long>").where("size(words) > 0"))
    n, total = rows.agg(F.count("*"), F.sum(F.size("words"))).first()
    shards = -(-(total or 0) // SHARD_WORDS)
    terms = rows.select(F.explode(F.array_distinct("words")).alias("term"))
    df = stored(terms.groupBy("term").agg(F.count("*").alias("df"))) if shards > 1 else None
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("item_id", "words"), F.lit(max(1, shards))))
    for s in range(shards):
        part = rows.where(F.col("shard") == s)
        got = sorted(part.select("item_id", "words").collect(), key=lambda r: (len(r.words), str(r.item_id), r.words))
        words = [np.array(r.words, np.int64).view(np.uint64) for r in got]
        if df is None:
            term, count = np.unique(np.concatenate([np.unique(w) for w in words]), return_counts=True)
            known = dict(zip(term.tolist(), count.tolist()))
        else:
            own = part.select(F.explode("words").alias("term")).distinct()
            known = {r.term % (1 << 64): r.df for r in df.join(own, "term", "left_semi").collect()}
        yield build([r.item_id for r in got], words, known, n, total / n)


def _searched(indexes: list[Index], item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            got = search(indexes, Words(batch.column("text"), fold=True))
            cols = list(zip(*got)) or [()] * 7
            yield batch_of({
                "doc_id": (batch.column("doc_id").take(pa.array(list(cols[0]), pa.int64())), None), "item_id": (list(cols[1]), item_type), "score": (list(cols[2]), pa.float64()), "passage_word": (list(cols[3]), pa.int64()),
                "question_overlap": (list(cols[4]), pa.float64()), "answer_overlap": (list(cols[5]), pa.float64()), "contaminated": (list(cols[6]), pa.bool_()),
            })
    return run


def retrieved(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each pair of a document and a test item that one of its passages retrieves; contaminated: verified."""
    from pyspark.sql.pandas.types import to_arrow_type

    docs = columns_of(docs, "doc_id", "text")
    kind = items.schema["item_id"].dataType
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {kind.simpleString()}, score double, passage_word long, question_overlap double, answer_overlap double, contaminated boolean"
    out = None
    for indexes in indexes_of(items):
        part = docs.mapInArrow(_searched(indexes, to_arrow_type(kind)), schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], T._parse_datatype_string(schema)) if out is None else out


def _clean(indexes: list[Index]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            bad = {r for r, *_, ok in search(indexes, Words(batch.column("text"), fold=True)) if ok}
            yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))
    return run


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that hold no verified test item."""
    for indexes in indexes_of(items):
        docs = docs.mapInArrow(_clean(indexes), docs.schema)
    return docs
