"""Hard negatives by an inverted multi-index over vectors of whole numbers.

Score: the inner product. An anchor's positives are its ``positives`` best other rows of its label; for each of them its
negatives are the ``negatives`` best rows of other labels whose score lies in the window from ``low`` to ``high`` percent of
the positive's score. Ties go to the smaller vec_id. The result is exact.

*Index.* Each half of the vectors has a codebook (k-means in numpy on a bounded sample, ``SAMPLE`` rows on average); a row lies in
the cell of its two nearest centroids, and every row is filed. A cell holds ``CELL`` rows on average up to ``BOOK`` centroids a
half. Of each cell the number of rows, the greatest distance from either centroid and the greatest length of either half are kept
(at most BOOK * BOOK rows, the only thing besides the codebooks that tasks are sent).

*Search.* A half-score is at most ``q.c + |q| r`` and at most ``|q|`` times the greatest length. A heap over both sorted
lists of half-score bounds (multi-sequence) gives the cells in order of the summed bound. An anchor visits them until its
windows are certified: no unvisited cell can hold a score as high as the last place of a full list, or the lower end of a
window. Cells whose own bound is lower are passed over. Visits go in rounds, each with ``GROWTH`` times the rows of the
round before (the heap is walked again from its start, nothing of it is stored): anchors are sent to the cells they ask for,
rows of a cell meet them in blocks of both, and the best of each list are kept by a ranking that cuts before it shuffles.
First the positives, then the windows of all of them. No round joins rows with rows of their own label or cell: only
anchors (a stated query set) meet rows.

Equal vectors of one label are one row of the index with their smallest vec_ids, as many as a list can take.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no part; neither do those whose squared
length is 2**62 or more (their scores would not fit). Shorter vectors count as filled up with zeros. A null vec_id is no anchor and comes
last among ties. Rows that repeat a vec_id are rows of their own; an anchor row that occurs n times gives its rows n times. A
window of a negative positive score is empty. Columns other than vec_id, label and the vector are not read. An empty table
gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, stored

SAMPLE, CELL, BOOK, STEPS = 20_000, 64, 256, 10
FIRST, GROWTH = 4096, 8
BLOCK, ASKED = 2048, 256
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


# ---------------------------------------------------------------- rows
def _whole(scale: float, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vector = batch.column("vector")
            n = vector.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            x = np.floor(scale * vector.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            row, place = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            good = np.ones(len(n), bool)
            good[row[~np.isfinite(x)]] = False
            good &= ~np.bincount(row, np.where(np.isfinite(x), np.minimum(np.abs(x), 2.0**32), 0.0) ** 2, len(n)).__ge__(2.0**62)
            good &= vector.is_valid().to_numpy(zero_copy_only=False) & batch.column("label").is_valid().to_numpy(zero_copy_only=False)
            out = np.zeros((len(n), size), "<i4")
            use = good[row]
            out[row[use], place[use]] = x[use].astype(np.int32)
            keep = pa.array(good)
            yield batch_of({"id": (batch.column("id").filter(keep), None), "label": (batch.column("label").filter(keep), None),
                            "vec": ([v.tobytes() for v in out[good]], pa.binary())})
    return run


def whole_vectors(rows: DataFrame, vec_id: str = "vec_id", label: str | Column = "label", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """id, label and the vector as bytes of 32-bit numbers floor(scale * x), of the rows that take part."""
    given = rows.select(F.coalesce(F.col(vec_id).cast("long"), F.lit(_MOST)).alias("id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), F.col(vector).alias("vector"))
    size = given.agg(F.max(F.size("vector"))).first()[0] or 0
    return given.mapInArrow(_whole(scale, max(2, size)), "id long, label long, vec binary")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<i4").reshape(len(rows), -1)


# ---------------------------------------------------------------- index
def codebook(x: np.ndarray, k: int, steps: int = STEPS, seed: int = 7) -> np.ndarray:
    """Centroids of k-means."""
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float64)
    for _ in range(steps):
        near = nearest(x, centre)[0]
        size = np.bincount(near, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre[size > 0] = total[size > 0] / size[size > 0, None]
    return centre


def nearest(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and its distance."""
    near = ((centre**2).sum(axis=1)[None, :] - 2 * (x @ centre.T)).argmin(axis=1)
    return near, np.sqrt(((x - centre[near]) ** 2).sum(axis=1))


class Index:
    """Codebooks of both halves, and what is known of each cell."""

    def __init__(self, sample: np.ndarray, k: int):
        self.half = sample.shape[1] // 2
        self.books = [codebook(x, k) for x in self._halves(sample)]
        self.shape = tuple(len(b) for b in self.books)

    def _halves(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[..., : self.half].astype(np.float64), x[..., self.half:].astype(np.float64)]

    def file(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                halves = self._halves(_matrix(batch.column("vec")))
                (i, r1), (j, r2) = (nearest(x, b) for x, b in zip(halves, self.books))
                n1, n2 = (np.sqrt((x**2).sum(axis=1)) for x in halves)
                yield batch_of({**{c: (batch.column(c), None) for c in ("label", "vec", "ids")}, "cell": (i * self.shape[1] + j, pa.int64()),
                                **{c: (x, pa.float64()) for c, x in (("r1", r1), ("r2", r2), ("n1", n1), ("n2", n2))}})

    def describe(self, cells: list) -> Index:
        """cells: cell, rows, r1, r2, n1, n2."""
        table = np.zeros((5, self.shape[0] * self.shape[1]))
        for cell, *known in cells:
            table[:, cell] = known
        self.rows, self.r1, self.r2, self.n1, self.n2 = table.reshape(5, *self.shape)
        return self

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Upper bounds of the half-scores for each centroid, and of the score for each cell."""
        out = []
        for x, book, r, n, axis in zip(self._halves(q), self.books, (self.r1, self.r2), (self.n1, self.n2), (1, 0)):
            long = np.sqrt((x**2).sum())
            at, slack = book @ x, 1e-9 * long * (np.sqrt((book**2).sum(axis=1)) + r.max(axis=axis)) + 1e-3
            out.append(np.minimum(at + long * r.max(axis=axis), long * n.max(axis=axis)) + slack)
            at, slack = (np.expand_dims(v, axis) for v in (at, slack))
            out.append(np.minimum(at + long * r, long * n) + slack)
        return out[0], out[2], out[1] + out[3]


def in_order(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """Multi-sequence: (sum, i, j) for all pairs in order of the sum, greatest first."""
    one, two = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    a, b = first[one].tolist(), second[two].tolist()
    done = [0] * len(a)  # pairs given of each place of the first list
    heap = [(-(a[0] + b[0]), 0, 0)]
    while heap:
        minus, x, y = heapq.heappop(heap)
        yield -minus, one[x], two[y]
        done[x] = y + 1
        if x + 1 < len(a) and done[x + 1] == y:
            heapq.heappush(heap, (-(a[x + 1] + b[y]), x + 1, y))
        if y + 1 < len(b) and (x == 0 or done[x - 1] > y + 1):
            heapq.heappush(heap, (-(a[x] + b[y + 1]), x, y + 1))


# ---------------------------------------------------------------- search
def _visits(index: Index, budget: int):
    """The next cells of each anchor: until they hold ``budget`` rows, or no further one can matter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, seen, bound = [], [], []
            for vec, need, past in zip(*(batch.column(c).to_pylist() for c in ("vec", "need", "seen"))):
                first, second, own = index.bounds(np.frombuffer(vec, "<i4"))
                least, at, rows, mine, top = min(need), 0, 0, [], None
                for total, i, j in in_order(first, second):
                    if total < least:
                        break
                    if rows >= budget:
                        top = total
                        break
                    at += 1
                    if at > past and index.rows[i, j] and own[i, j] >= least:
                        mine.append(i * index.shape[1] + j)
                        rows += int(index.rows[i, j])
                cells.append(mine)
                seen.append(at)
                bound.append(top)
            yield batch_of({**{c: (batch.column(c), None) for c in ("a", "own", "label", "vec", "low", "high", "need")}, "seen": (seen, pa.int64()),
                            "cells": (cells, pa.list_(pa.int64())), "bound": (bound, pa.float64())})
    return run


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point where every partial sum is a whole number below 2**52."""
    long = [np.sqrt((v.astype(np.float64) ** 2).sum(axis=1).max()) for v in (q, x)]
    if long[0] * long[1] < 2.0**52:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def _scored(same: bool, take: int):
    """The best of each window among the rows of one block, for each anchor that asks for it."""
    def run(key, asked: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if asked.num_rows and rows.num_rows:
            q, x = _matrix(asked.column("vec")), _matrix(rows.column("vec"))
            scores = _products(q, x)
            label, ids = rows.column("label").to_numpy(), rows.column("ids").to_pylist()
            square = lambda v: (v.astype(np.int64) ** 2).sum(axis=1)
            q_square, x_square = square(q), square(x)
            for k, (a, own, mine, high, need) in enumerate(zip(*(asked.column(c).to_pylist() for c in ("a", "own", "label", "high", "need")))):
                other = np.flatnonzero((label == mine) == same)
                s = scores[k, other]
                for w, (least, most) in enumerate(zip(need, high)):
                    inside = np.flatnonzero((s >= least) & (s <= most))
                    if len(inside) > take + 1:  # one may be the anchor itself
                        inside = inside[s[inside] >= np.partition(s[inside], -take - 1)[-take - 1]]
                    found = []
                    for r in other[inside].tolist():
                        known = list(ids[r])
                        if same and own in known and scores[k, r] == q_square[k] == x_square[r]:  # equal vectors: its own class
                            known.remove(own)
                        found += [(-int(scores[k, r]), i) for i in known[:take]]
                    out += [(a, w, -s_, i) for s_, i in sorted(found)[:take]]
        return pa.table({c: pa.array([r[n] for r in out], t) for n, (c, t) in enumerate((("a", pa.int64()), ("w", pa.int32()), ("score", pa.int64()), ("id", pa.int64())))})
    return run


def _search(anchors: DataFrame, filed: DataFrame, sizes: DataFrame, index: Index, same: bool, take: int) -> DataFrame:
    """a, w, score, id, rank: the best of each window (low, high) of each anchor."""
    state = "a long, own long, label long, vec binary, low array<long>, high array<long>, need array<long>, seen long"
    parts = lambda n, size: F.ceil(F.col(n) / size).cast("long")
    best = Window.partitionBy("a", "w").orderBy(F.col("score").desc(), "id")
    pending, found, budget = anchors.withColumn("need", F.col("low")).withColumn("seen", F.lit(0).cast("long")), None, FIRST
    while True:
        visits = stored(pending.mapInArrow(_visits(index, budget), f"{state}, cells array<long>, bound double"))
        asked = visits.select("a", "own", "label", "vec", "high", "need", F.explode("cells").alias("cell"))
        met = stored(asked.groupBy("cell").agg(F.count("*").alias("n")).join(sizes, "cell").select("cell", parts("n", ASKED).alias("q_parts"), parts("rows", BLOCK).alias("parts")))
        left = asked.join(met, "cell").withColumn("i", F.pmod(F.xxhash64("a"), F.col("q_parts"))).withColumn("j", F.explode(F.expr("sequence(0L, parts - 1L)")))
        right = filed.join(met, "cell").withColumn("j", F.pmod(F.xxhash64("vec", "label"), F.col("parts"))).withColumn("i", F.explode(F.expr("sequence(0L, q_parts - 1L)")))
        right = right.select(F.col("cell").alias("c"), F.col("i").alias("k"), F.col("j").alias("m"), "label", "vec", "ids")
        new = left.drop("parts", "q_parts").groupBy("cell", "i", "j").cogroup(right.groupBy("c", "k", "m")).applyInArrow(_scored(same, take), "a long, w int, score long, id long")
        every = new if found is None else found.drop("rank").unionByName(new)
        found = stored(every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= take))
        last = found.where(F.col("rank") == take).groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("last"))  # a window each
        need = F.expr("transform(low, (x, w) -> greatest(x, coalesce(try_element_at(last, w), x)))")
        pending = visits.where("bound is not null").join(last, "a", "left").withColumn("need", need).where("bound >= array_min(need)")
        pending = stored(pending.select("a", "own", "label", "vec", "low", "high", "need", "seen"))
        if pending.isEmpty():
            return found
        budget *= GROWTH


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """rows: id, label, vec (see whole_vectors); is_anchor: a condition on them. anchor_id, positive_id, rank, negative_id,
    positive_score and negative_score of every negative."""
    rows = stored(rows)
    size = rows.agg(F.max(F.length("vec"))).first()[0]
    if not size:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    anchors = stored(rows.where(is_anchor & (F.col("id") < _MOST)).groupBy("id", "label", "vec").agg(F.count("*").alias("copies")).withColumn("a", F.monotonically_increasing_id()))
    first = F.row_number().over(Window.partitionBy("label", "vec").orderBy("id"))
    classes = stored(rows.withColumn("place", first).where(F.col("place") <= max(positives + 1, negatives)).groupBy("label", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    n = classes.count()
    drawn = F.pmod(F.xxhash64("vec", "label"), F.lit(1 << 32)) < F.lit(min(1 << 32, (1 << 32) * SAMPLE // n))
    sample = sorted(r[0] for r in classes.where(drawn).select("vec").collect())  # SAMPLE rows on average
    index = Index(np.frombuffer(b"".join(sample), "<i4").reshape(len(sample), -1), int(np.clip(np.ceil(np.sqrt(n / CELL)), 1, BOOK)))
    filed = stored(classes.mapInArrow(index.file, "label long, vec binary, ids array<long>, cell long, r1 double, r2 double, n1 double, n2 double"))
    known = ("r1", "r2", "n1", "n2")
    cells = filed.groupBy("cell").agg(F.count("*").alias("rows"), *[F.max(c).alias(c) for c in known]).collect()  # at most BOOK * BOOK
    index.describe([tuple(r) for r in cells])
    filed = filed.drop(*known)
    sizes = rows.sparkSession.createDataFrame([(r.cell, r.rows) for r in cells], "cell long, rows long")

    ends = lambda a, b: [F.array(F.lit(a)).cast("array<long>").alias("low"), F.array(F.lit(b)).cast("array<long>").alias("high")]
    own = anchors.select("a", F.col("id").alias("own"), "label", "vec")
    near = _search(own.select("*", *ends(_LEAST, _MOST)), filed, sizes, index, True, positives)
    # whole scores in the window, from low percent rounded up to high percent rounded down; in parts, as score * 100 may not fit
    part = lambda percent, more: F.expr(f"(score - pmod(score, 100)) div 100 * {percent} + (pmod(score, 100) * {percent} + {more}) div 100")
    window = near.select("a", F.col("rank").alias("p"), part(low, 99).alias("low"), part(high, 0).alias("high"))
    window = window.withColumn("low", F.when(F.col("low") > F.col("high"), F.lit(_MOST)).otherwise(F.col("low")))
    windows = window.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("p", "low", "high"))).alias("of")).select("a", F.col("of.p").alias("p"), F.col("of.low").alias("low"), F.col("of.high").alias("high"))
    windows = stored(windows)
    far = _search(own.join(windows.drop("p"), "a"), filed, sizes, index, False, negatives)
    told = near.select("a", F.col("rank").alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = far.select("a", (F.col("w") + 1).alias("p"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(told, ["a", "p"])
    out = out.join(anchors.select("a", F.col("id").alias("anchor_id"), "copies"), "a").withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    name = lambda c: F.when(F.col(c) < _MOST, F.col(c)).alias(c)
    return out.select("anchor_id", name("positive_id"), "rank", name("negative_id"), "positive_score", "negative_score")
