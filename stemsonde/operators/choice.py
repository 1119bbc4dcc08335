"""Replicates that choose the k smallest keyed draws of a group, for groups of any size.

A label shuffle within a stratum and a half-split are both a choice of k of n items, made anew in every replicate.  An item
has three numbers of its own (``draws.seeds``); its draw in replicate r is a polynomial in r over a prime field, so the
draws of different items are independent and those of one item are so in any three replicates, and a draw costs two
multiplications wherever the item lies.

Items are packed once into records of at most ``BLOCK`` items (the one exchange of rows).  A group that lies whole in a
record is decided there.  For a group of several records the draws are counted in ``BINS`` ranges, the counts are combined
before they are exchanged, and only the range that holds the k-th draw is ranked; the threshold then goes back to the
records.  What leaves a record are sums by replicate and cell, never a row for each item and replicate.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import PRIME, seeds
from ..sources.shared import shared_path
from .joins import salted_join

BLOCK, BINS = 4096, 256
WORK = 1 << 22  # draws held at once


def draw_table(numbers: np.ndarray, first: int, last: int) -> np.ndarray:
    """Draws of replicates first..last, a row each; numbers has three columns."""
    r = np.arange(first, last + 1, dtype=np.int64)[:, None]
    return ((numbers[:, 2] * r + numbers[:, 1]) % PRIME * r + numbers[:, 0]) % PRIME


def smallest(draws: np.ndarray, take: int) -> np.ndarray:
    """Where the ``take`` smallest of each row are; of equal draws the earlier column."""
    m = draws.shape[1]
    if take <= 0 or take >= m:
        return np.full(draws.shape, take > 0)
    unique = draws * m + np.arange(m)
    return unique <= np.partition(unique, take - 1, axis=1)[:, take - 1: take]


FEW = 8  # items of a group that is put in order by comparing rows


@lru_cache(maxsize=8)
def _powers(first: int, last: int) -> np.ndarray:
    r = np.arange(first, last + 1, dtype=np.float64)
    return np.stack([np.ones_like(r), r, r * r])


def draw_rows(numbers: np.ndarray, first: int, last: int) -> np.ndarray:
    """``draw_table`` with a row for each item, as 32-bit numbers.

    Up to replicate 1,447 the polynomial itself and its quotient by ``PRIME`` are exact in floating point.
    """
    if last * last + last + 1 >= 1 << 21:
        return draw_table(numbers, first, last).T.astype(np.int32)
    return _within(numbers.astype(np.float64) @ _powers(first, last)).astype(np.int32)


def _within(value: np.ndarray) -> np.ndarray:
    """Remainders of ``PRIME`` in place."""
    turns = value / PRIME
    np.floor(turns, out=turns)
    turns *= PRIME
    value -= turns
    return value


def ordered_items(numbers: np.ndarray, first: int, last: int) -> np.ndarray:
    """For each replicate (row) the items in order of their draws, of equal ones the earlier first."""
    exact = last * last + last + 1 < 1 << 21
    value = _within(_powers(first, last).T @ numbers.T.astype(np.float64)) if exact else draw_table(numbers, first, last).astype(np.float64)
    bits = (len(numbers) - 1).bit_length()  # a draw and an item's place make one whole number
    value *= 1 << bits
    value += np.arange(len(numbers))
    value.sort(axis=1)
    return value.astype(np.int64) & (1 << bits) - 1


@lru_cache(maxsize=None)
def _exchanges(n: int) -> tuple[tuple[int, int], ...]:
    """Places to compare in turn so that n rows are put in order (odd-even merging)."""
    out, p = [], 1
    while p < n:
        k = p
        while k >= 1:
            out += [(i + j, i + j + k) for j in range(k % p, n - k, 2 * k) for i in range(min(k, n - j - k)) if (i + j) // (2 * p) == (i + j + k) // (2 * p)]
            k //= 2
        p *= 2
    return tuple(out)


def _last_chosen(draws: np.ndarray, places: list[np.ndarray], takes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each group of items, a row with its ``takes``-th smallest draw in every replicate; and the replicates in which
    the next one of some group equals it."""
    out, tied = np.empty((len(places), draws.shape[1]), np.int32), np.zeros(draws.shape[1], bool)
    few = [g for g, at in enumerate(places) if len(at) <= FEW]
    for g in set(range(len(places))).difference(few):
        rows, k = np.ascontiguousarray(draws[places[g]].T), takes[g]
        rows = np.sort(rows, axis=1) if rows.shape[1] <= 64 else np.partition(rows, (k - 1, k), axis=1)
        out[g] = rows[:, k - 1]
        tied |= rows[:, k] == out[g]
    if few:
        most = max(len(places[g]) for g in few)
        rows = [np.full((len(few), draws.shape[1]), PRIME, np.int32) for _ in range(most)]
        for k, g in enumerate(few):
            for row, item in zip(rows, places[g]):
                row[k] = draws[item]
        spare = np.empty_like(rows[0])
        for i, j in _exchanges(most):
            np.minimum(rows[i], rows[j], out=spare)
            np.maximum(rows[i], rows[j], out=rows[j])
            rows[i], spare = spare, rows[i]
        for k, g in enumerate(few):
            out[g] = rows[takes[g] - 1][k]
            tied |= rows[takes[g]][k] == out[g]
    return out, tied


def shuffled_rows(draws: np.ndarray, own: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which items (rows) are chosen in each replicate: of each group as many as are its ``own``, by the smallest draws and
    of equal ones the earlier item; items of no group (-1) keep their own state."""
    item = np.where(own, 1, 0)  # limits 0 and 1: none and all
    places, takes = [], []
    for g in np.unique(group[group >= 0]):
        at = np.flatnonzero(group == g)
        take = int(own[at].sum())
        if 0 < take < len(at):
            item[at] = 2 + len(places)
            places.append(at)
            takes.append(take)
        else:
            item[at] = take > 0
    limits, tied = _last_chosen(draws, places, takes)
    ends = np.repeat(np.array([[-1], [PRIME]], np.int32), draws.shape[1], axis=1)
    chosen = draws <= np.concatenate([ends, limits])[item]
    for r in np.flatnonzero(tied):
        for at, take in zip(places, takes):
            chosen[at, r] = smallest(draws[at, r][None, :].astype(np.int64), take)[0]
    return chosen


def replicate_slices(items: int, reps: int) -> Iterator[tuple[int, int]]:
    step = max(1, WORK // max(1, items))
    for first in range(1, reps + 1, step):
        yield first, min(reps, first + step - 1)


def _number_list(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, 3)


class _Record:
    """The items of one record, in order of their keys."""

    def __init__(self, items: pa.StructArray):
        self.keys = items.field("key")
        self.numbers = _number_list(items.field("b"))
        self.take = items.field("take")
        self.own = np.asarray(items.field("own").fill_null(False))
        group = items.field("grp").dictionary_encode()
        self.group = np.asarray(group.indices.fill_null(-1))
        self.groups = len(group.dictionary)
        cells = items.field("cells")
        value = cells.flatten()
        item = np.repeat(np.arange(len(items)), np.asarray(cells.value_lengths().fill_null(0)))
        x = np.asarray(value.field("value").cast(pa.float64()).fill_null(np.nan), np.float64)
        cell = np.asarray(value.field("cell"), np.int64)
        there = ~np.isnan(x)
        self.listed = len(cell) > 0
        self.cells, at = np.unique(cell[there], return_inverse=True)
        self.sums, self.counts = np.zeros((len(items), len(self.cells))), np.zeros((len(items), len(self.cells)))
        np.add.at(self.sums, (item[there], at), x[there])
        np.add.at(self.counts, (item[there], at), 1)

    def chosen(self, first: int, last: int) -> np.ndarray:
        """For a record of whole groups; items of no group keep their own state."""
        draws, out = draw_table(self.numbers, first, last), np.tile(self.own, (last - first + 1, 1))
        for g in range(self.groups):
            at = np.flatnonzero(self.group == g)
            out[:, at] = smallest(draws[:, at], self.take[int(at[0])].as_py())
        return out

    def below(self, first: int, last: int, draw: np.ndarray, key: list) -> np.ndarray:
        """Items up to a threshold (draw, key) of each replicate."""
        draws = draw_table(self.numbers, first, last)
        out, limit = draws < draw[first - 1: last, None], draws == draw[first - 1: last, None]
        for r, i in zip(*np.nonzero(limit)):
            out[r, i] = self.keys[int(i)].as_py() <= key[first - 1 + r]
        return out

    def totals(self, chosen: np.ndarray) -> list[np.ndarray]:
        inside, outside = chosen.astype(np.float64), (~chosen).astype(np.float64)
        return [x @ y for x in (inside, outside) for y in (self.counts, self.sums)]


_SUMS = ("n_in", "s_in", "n_out", "s_out")
_NUMBERS = {"rep": pa.int32(), "cell": pa.int32(), **dict.fromkeys(_SUMS, pa.float64())}


def _records(batch: pa.RecordBatch, by: Sequence[str]) -> Iterator[tuple[int, _Record, pa.RecordBatch]]:
    lists = batch.column("items")
    for i in range(batch.num_rows):
        yield i, _Record(lists.slice(i, 1).flatten()), batch.select(list(by)).slice(i, 1)


def _with_head(head: pa.RecordBatch, columns: dict[str, tuple]) -> pa.RecordBatch:
    n = len(next(iter(columns.values()))[0])
    at = pa.array(np.zeros(n, np.int64))
    arrays = [c.take(at) for c in head.columns] + [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=[*head.schema.names, *columns])


def _told(head, record: _Record, first: int, last: int, chosen: np.ndarray) -> pa.RecordBatch:
    n, w = last - first + 1, len(record.cells)
    sums = record.totals(chosen)
    return _with_head(head, {"rep": (np.repeat(np.arange(first, last + 1), w), pa.int32()), "cell": (np.tile(record.cells, n), pa.int32()),
                             **{c: (x.ravel(), pa.float64()) for c, x in zip(_SUMS, sums)}})


def _whole(by, reps):
    def run(batches):
        for batch in batches:
            for _, record, head in _records(batch, by):
                for first, last in replicate_slices(len(record.keys), reps):
                    yield _told(head, record, first, last, record.chosen(first, last))
    return run


def _whole_max(by, reps, share):
    """Of units that lie whole in a record: the quantile over replicates of the largest ratio of means."""
    def run(batches):
        for batch in batches:
            upper = []
            for _, record, _ in _records(batch, by):
                best = []
                for first, last in replicate_slices(len(record.keys), reps):
                    n_in, s_in, n_out, s_out = record.totals(record.chosen(first, last))
                    with np.errstate(divide="ignore", invalid="ignore"):
                        p, u = s_in / n_in, s_out / n_out
                        ratio = np.where((n_in > 0) & (n_out > 0), np.where(u > 1e-10, p / u, 0.0), 0.0)
                    best.append(np.maximum(ratio.max(axis=1, initial=0.0), 0.0))
                upper.append(np.quantile(np.concatenate(best), share) if record.listed else None)
            yield pa.RecordBatch.from_arrays([*batch.select(list(by)).columns, pa.array(upper, pa.float64())], names=[*by, "upper"])
    return run


def _counted(by, reps):
    def run(batches):
        for batch in batches:
            for _, record, head in _records(batch, by):
                for first, last in replicate_slices(len(record.keys), reps):
                    bins = draw_table(record.numbers, first, last) * BINS // PRIME + np.arange(last - first + 1)[:, None] * BINS
                    at, n = np.unique(bins, return_counts=True)
                    yield _with_head(head, {"rep": (at // BINS + first, pa.int32()), "bin": (at % BINS, pa.int32()), "n": (n, pa.int64())})
    return run


def _edge(by, reps):
    """Items whose draw lies in the range of the threshold."""
    def run(batches):
        for batch in batches:
            ranges = batch.column("bins").to_pylist()
            for i, record, head in _records(batch, by):
                want = np.array(ranges[i])
                for first, last in replicate_slices(len(record.keys), reps):
                    draws = draw_table(record.numbers, first, last)
                    r, k = np.nonzero(draws * BINS // PRIME == want[first - 1: last, None])
                    yield _with_head(head, {"rep": (r + first, pa.int32()), "draw": (draws[r, k], pa.int64()), "key": (record.keys.take(pa.array(k)), None)})
    return run


def _parted(by, reps):
    def run(batches):
        for batch in batches:
            draws, keys = (batch.column(c).to_pylist() for c in ("draws", "keys"))
            for i, record, head in _records(batch, by):
                for first, last in replicate_slices(len(record.keys), reps):
                    yield _told(head, record, first, last, record.below(first, last, np.array(draws[i]), keys[i]))
    return run


def chosen_sums(items: DataFrame, by: Sequence[str], group: Column, key: str, take: Column, own: Column, cells: str, reps: int, seed: str,
                block: int | None = None) -> DataFrame:
    """by…, rep, cell, n_in, s_in, n_out, s_out: numbers and sums of the values of chosen and of other items.

    A row of items has a ``key`` unique in its unit ``by``, a group within the unit (null: it keeps its ``own`` state) and
    ``cells``, an array of (cell int, value double); ``take`` is an aggregate over a group, the number to choose of it.
    """
    packed, sizes, block = _packed(items, by, group, key, take, own, cells, seed, block)
    return _sums_of(packed, sizes, list(by), reps, block)


def chosen_maxima(items: DataFrame, by: Sequence[str], group: Column, key: str, take: Column, own: Column, cells: str, reps: int, seed: str,
                  share: float, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(by…, upper) of units that lie whole in a record, nothing of which is exchanged after packing: that quantile over
    replicates of the largest mean of the chosen over that of the others; and the sums of ``chosen_sums`` of larger units.
    A unit without cells has a null."""
    packed, sizes, block = _packed(items, by, group, key, take, own, cells, seed, block)
    kinds, lone = dict(packed.dtypes), F.col("__p") == ""
    head = ", ".join(f"`{b}` {kinds[b]}" for b in by)
    small = packed.filter(lone).mapInArrow(_whole_max(list(by), reps, share), f"{head}, upper double")
    return small, _sums_of(packed.filter(~lone), sizes, list(by), reps, block)


def _packed(items, by, group, key, take, own, cells, seed, block):
    by, block = list(by), block or BLOCK
    rows = items.select(*by, F.col(key).alias("key"), group.cast("string").alias("grp"), own.alias("own"), F.col(cells).alias("cells"))
    source = items.withColumn("__grp", group.cast("string"))
    sizes = source.groupBy(*by, "__grp").agg(F.count(F.lit(1)).alias("n"), take.cast("bigint").alias("take"))
    unit = sizes.groupBy(*by).agg(F.sum("n").alias("__unit"))
    same = [F.col(f"s.{b}").eqNullSafe(F.col(f"u.{b}")) for b in by]
    sizes = sizes.alias("s").join(unit.alias("u"), same).select(*[F.col(f"s.{b}").alias(b) for b in by], _name("__grp").alias("__g"), "n", "take", "__unit")
    rows = salted_join(rows.withColumn("__g", _name("grp")), sizes, [*by, "__g"], F.col("key"))
    whole_unit = F.col("__unit") <= block
    part = F.when(whole_unit, F.lit(0)).otherwise(F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / block)))
    rows = rows.withColumn("__p", F.when(whole_unit, F.lit("")).otherwise(F.concat(F.lit("#"), "__g"))).withColumn("__q", part)
    rows = rows.withColumn("__whole", whole_unit | (F.col("n") <= block) | F.col("grp").isNull()).withColumn("b", seeds(seed, *[F.col(b) for b in by], F.col("key")))
    packed = rows.groupBy(*by, "__p", "__q", "__whole").agg(F.sort_array(F.collect_list(F.struct("key", "grp", "take", "own", "b", "cells"))).alias("items"))
    path = shared_path(items.sparkSession, "records")
    packed.write.parquet(path)
    return items.sparkSession.read.parquet(path), sizes, block


def _sums_of(packed: DataFrame, sizes: DataFrame, by: list[str], reps: int, block: int) -> DataFrame:
    kinds = dict(packed.dtypes)
    head = ", ".join(f"`{b}` {kinds[b]}" for b in by)
    out = f"{head}, rep int, cell int, n_in double, s_in double, n_out double, s_out double"
    cut = [*by, "__p"]
    named = f"{head}, __p string"
    sums = packed.filter("__whole").mapInArrow(_whole(by, reps), out)
    parts = packed.filter("not __whole")
    total = lambda df: df.groupBy(*by, "rep", "cell").agg(*[F.sum(c).alias(c) for c in _SUMS])
    if parts.isEmpty():
        return total(sums)
    counts = parts.mapInArrow(_counted(cut, reps), f"{named}, rep int, bin int, n bigint").groupBy(*cut, "rep", "bin").agg(F.sum("n").alias("n"))
    over = Window.partitionBy(*cut, "rep").orderBy("bin")  # at most BINS rows
    takes = sizes.filter(f"__unit > {block}").select(*by, F.concat(F.lit("#"), "__g").alias("__p"), "take", "n").withColumnRenamed("n", "__n")
    bound = counts.withColumn("upto", F.sum("n").over(over)).join(takes, cut)
    want = F.least(F.greatest(F.col("take"), F.lit(1)), F.col("__n"))
    bound = bound.withColumn("k", want - (F.col("upto") - F.col("n"))).filter((F.col("k") >= 1) & (F.col("k") <= F.col("n"))).select(*cut, "rep", "bin", "k", "take")
    in_order = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("rep", c))), lambda x: x[c])  # noqa: E731  a value for each replicate
    bins = bound.groupBy(*cut).agg(in_order("bin").alias("bins"))
    edge = parts.join(bins, cut).select(*cut, "items", "bins").mapInArrow(_edge(cut, reps), f"{named}, rep int, draw bigint, key {_key_type(kinds)}")
    place = F.row_number().over(Window.partitionBy(*cut, "rep").orderBy("draw", "key"))
    limit = edge.withColumn("place", place).join(bound, [*cut, "rep"]).filter("place = k")
    limit = limit.withColumn("draw", F.when(F.col("take") >= 1, F.col("draw")).otherwise(F.lit(-1).cast("bigint")))
    limits = limit.groupBy(*cut).agg(in_order("draw").alias("draws"), in_order("key").alias("keys"))
    split = parts.join(limits, cut).select(*cut, "items", "draws", "keys").mapInArrow(_parted(by, reps), out)
    return total(sums.unionByName(split))


def _name(group: str) -> Column:
    """A group's name that no null shares."""
    return F.coalesce(F.concat(F.lit("="), group), F.lit(""))


def _key_type(kinds: dict) -> str:
    return kinds["items"].split("key:", 1)[1].split(",", 1)[0]
