"""Periodic runs of words by maximal pairs: a bottom-up LCP-interval tree with left-word class lists.

A run is a stretch of words with smallest period q, at least ``max(LEAST, 4 * q)`` words long, that no neighbouring word
extends keeping that period. Two places i < j of a text are a maximal pair of length m if the m words from either on are
equal, the words before them differ (or i is the first word) and the words after them differ (or j's end is the text's).
With ``j - i = q`` and ``m >= 3 * q`` the stretch from i of ``m + q`` words has period q and is not extended by a word on
either side, so the maximal pairs whose distance keeps to ``m >= max(3 * q, LEAST - q)`` are the runs: nothing is
extended afterwards. A stretch also shows up under multiples of its smallest period; the least distance stays.

In one text. Suffixes are put in order by prefix doubling (numpy, all texts of a slice at once) and the ranks of every
doubling give the common prefixes of neighbours. Intervals of the LCP array are closed bottom-up. An interval keeps its
places in order and, for each left word, the list of its places (its class). Where a child joins an interval of length m,
each place x of the smaller side is looked up in the larger one within ``m // 3`` words. Equal stretches so close lie on
one arithmetic progression, and every place but its first has the same left word; so all places behind x are of one
class, and of those before x only the first in reach can be of another. Two look-ups give exactly the pairs of unlike
classes, and smaller sides are merged into larger ones: n log n steps and the runs themselves.

Intervals shorter than ``LEAST - 1`` hold no run. Texts in which no window of that many words occurs twice, or only so
far apart that no stretch of repeated windows holds four periods, are not sorted. A text is worked on by one task, with memory in proportion to
its words; nothing is shuffled.

Defined cases: a null or empty text has no words and no run. Rows that repeat a doc_id or are equal each get their own
result. A null doc_id is carried along. Among runs of equal length the one with the smaller start, then the smaller period
is the greatest. Columns other than doc_id and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Words, batch_of, columns_of, slices

LEAST, PERIODS = 6, 4


def ordered_suffixes(word: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, and the number of first words each shares with the one before it.

    word: a number for each place, the same for equal words of one text and another for those of other texts; end: where
    the text of each place ends."""
    n = len(word)
    order = np.argsort(word, kind="stable")
    new = np.append(True, word[order[1:]] != word[order[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    alone = new & np.append(new[1:], True)
    open_, levels, step = order[~alone], [rank], 1
    while len(open_):
        far = open_ + step
        second = np.where(far < end[open_], rank[np.minimum(far, n - 1)], -1)
        by = np.lexsort((second, rank[open_]))
        at, first, second = open_[by], rank[open_][by], second[by]
        group = np.append(True, first[1:] != first[:-1])
        new = group.copy()
        new[1:] |= second[1:] != second[:-1]
        place = np.arange(len(at))
        rank = rank.copy()
        rank[at] = first + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        levels.append(rank)
        open_ = at[~(new & np.append(new[1:], True))]
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    common = np.zeros(n, np.int64)
    i, j = order[:-1], order[1:]
    for k in range(len(levels) - 1, -1, -1):
        a, b = i + common[1:], j + common[1:]
        inside = (a < end[i]) & (b < end[j])
        same = levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)]
        common[1:] += (inside & same).astype(np.int64) << k
    return order, common


def _join(one: tuple, other: tuple, length: int, left: list, out: list) -> tuple:
    """Both sides of an interval as one; the maximal pairs between them go to out as (start, words, distance)."""
    if len(one[0]) < len(other[0]):
        one, other = other, one
    (order, classes), reach = one, length // (PERIODS - 1)
    for x in other[0]:
        k = bisect_right(order, x)
        if k < len(order) and order[k] - x <= reach and left[order[k]] != left[x]:
            behind = classes[left[order[k]]]
            for y in range(bisect_right(behind, x), len(behind)):
                if behind[y] - x > reach:
                    break
                out.append((x, length + behind[y] - x, behind[y] - x))
        k = bisect_left(order, x - reach)
        if k < len(order) and order[k] < x and left[order[k]] != left[x]:
            out.append((order[k], length + x - order[k], x - order[k]))
    for x in other[0]:
        insort(order, x)
    for word, places in other[1].items():
        mine = classes.setdefault(word, places)
        if mine is not places:
            for x in places:
                insort(mine, x)
    return one


def maximal_pairs(places: list[int], common: list[int], left: list) -> list[tuple[int, int, int]]:
    """(start, words, distance) of the maximal pairs at most a third of their length apart.

    places: suffixes in order that share words; common[k]: how many the k-th shares with the next; left: the word before
    each place, and a value of its own before a text's first word."""
    out: list[tuple[int, int, int]] = []
    stack: list[list] = []
    for x, after in zip(places, [*common, 0]):
        child = ([x], {left[x]: [x]})
        while stack and stack[-1][0] > after:
            length, node = stack.pop()
            child = _join(node, child, length, left, out)
        if stack and stack[-1][0] == after:
            stack[-1][1] = _join(stack[-1][1], child, after, left, out)
        elif after:
            stack.append([after, child])
    return out


def _worth(words: Words) -> np.ndarray:
    """Rows with a stretch of repeated windows that is long enough for the least distance of equal ones."""
    start, value = words.windows(LEAST - 1)
    row = words.row[start]
    by = np.lexsort((start, value, row))
    same = (row[by[1:]] == row[by[:-1]]) & (value[by[1:]] == value[by[:-1]])
    apart = np.full(words.rows, np.iinfo(np.int64).max // PERIODS)
    np.minimum.at(apart, row[by[1:]][same], (start[by[1:]] - start[by[:-1]])[same])
    twice = np.zeros(len(words.hash) + 1, bool)
    twice[start[by[1:]][same]] = twice[start[by[:-1]][same]] = True
    edge = np.diff(np.concatenate([[False], twice]).astype(np.int8))
    begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # a text's last places start no window
    longest = np.zeros(words.rows, np.int64)
    if len(begin):
        np.maximum.at(longest, words.row[begin], stop - begin)
    return np.flatnonzero(longest + LEAST - 2 >= PERIODS * apart)


def runs_of(words: Words) -> dict[int, list[tuple[int, int, int]]]:
    """Of each row with runs: (start, length, period) in order of start, then period; starts count from the row's first word."""
    rows = _worth(words)
    if not len(rows):
        return {}
    count, first = words.count[rows], words.first[rows]
    begin = np.cumsum(count) - count
    place = np.arange(count.sum()) + np.repeat(first - begin, count)
    text = np.repeat(np.arange(len(rows)), count)
    by = np.lexsort((words.hash[place], text))
    new = np.append(True, (text[by[1:]] != text[by[:-1]]) | (words.hash[place][by[1:]] != words.hash[place][by[:-1]]))
    word = np.empty(len(by), np.int64)
    word[by] = np.cumsum(new)
    order, common = ordered_suffixes(word, np.repeat(begin + count, count))
    left = np.append(0, word[:-1])
    left[begin] = 0
    # blocks of suffixes that share LEAST - 1 words; those whose places all lie too far apart hold no pair
    inside = common >= LEAST - 1
    block = np.cumsum(~inside) - 1
    size = np.bincount(block)
    by = np.lexsort((order, block))
    gap = np.where(np.diff(block, prepend=-1) == 0, np.diff(order[by], prepend=0), len(order))
    start = np.cumsum(size) - size
    live = (size > 1) & ((PERIODS - 1) * np.minimum.reduceat(gap, start) <= np.maximum.reduceat(np.where(inside, common, 0), start))
    left, found = left.tolist(), {}
    for b in np.flatnonzero(live):
        a, z = start[b], start[b] + size[b]
        for i, length, period in maximal_pairs(order[a:z].tolist(), common[a + 1: z].tolist(), left):
            if length >= LEAST:
                found[i, length] = min(period, found.get((i, length), period))
    out: dict[int, list] = {}
    for (i, length), period in found.items():
        t = text[i]
        out.setdefault(int(rows[t]), []).append((int(i - begin[t]), int(length), int(period)))
    return {r: sorted(x, key=lambda run: (run[0], run[2])) for r, x in out.items()}


def collapsed(text: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but those that lie in a run after its first period."""
    step = np.zeros(len(text) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return [text[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]


def _found(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"))
            texts, runs = batch.column("text").cast(pa.binary()).to_pylist(), runs_of(words)
            every, kept = [runs.get(r, []) for r in range(batch.num_rows)], []
            for text, own in zip(texts, every):
                split = (text or b"").split()  # bytes split at exactly the six characters that part words
                kept.append(b" ".join(collapsed(split, own) if own else split))
            best = [min(own, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None)) for own in every]
            long = pa.int64()
            out = {
                "doc_id": (batch.column("doc_id"), None), "n_words": (words.count, long), "n_runs": ([len(x) for x in every], long),
                "start": ([b[0] for b in best], long), "length": ([b[1] for b in best], long), "period": ([b[2] for b in best], long),
                "exponent_milli": ([None if b[0] is None else 1000 * b[1] // b[2] for b in best], long),
                "runs_sha256": ([hashlib.sha256("".join(f"{i},{n},{q}\n" for i, n, q in own).encode()).hexdigest() for own in every], pa.string()),
                "collapsed_sha256": ([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
            }
            if with_text:
                kind = pa.list_(pa.struct([("start", long), ("length", long), ("period", long)]))
                out["runs"] = ([[{"start": i, "length": n, "period": q} for i, n, q in own] for own in every], kind)
                out["collapsed_text"] = (pa.array(kept, pa.binary()).cast(pa.string()), None)
            yield batch_of(out)
    return run


def periodic_runs(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_runs, the greatest run (start, length, period, exponent_milli), digests of the runs and of the
    words that stay; with_text also the runs themselves and the text that stays. One row for each row of docs."""
    docs = columns_of(docs, "doc_id", "text")
    more = ", runs array<struct<start: long, length: long, period: long>>, collapsed_text string" if with_text else ""
    return docs.mapInArrow(_found(with_text), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_runs long, start long, length long, period long, "
                                              f"exponent_milli long, runs_sha256 string, collapsed_sha256 string{more}")
