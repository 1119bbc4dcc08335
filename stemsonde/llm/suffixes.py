"""Repeated passages by a sparse suffix array.

Only suffixes that start at content-selected positions are kept: a word position whose k-mer hash is the least of some
window of ``SPARSE`` consecutive k-mers. Equal passages select equal positions, so two copies of a passage of
SPARSE + k - 1 words and more have a suffix start in common within its first SPARSE words.

A suffix is the row of the hashes of its leading blocks of words (first a long block, then short ones), with doc_id and
position. Range partitioning over all of these sorts the suffixes of the whole corpus: the partitions in order are the
sparse suffix array. Since doc_id and position are part of the order, a passage that a third of all documents share is
cut over partitions like anything else. One streaming pass compares each suffix with the one before it and, where their
last blocks differ, for each number of leading blocks with the least (doc_id, position) so far among the suffixes that
share them; what a partition's ends leave open meets through a table with a few rows for each partition. Those that share the long block are matched
pairs, so of suffixes that share it all but the least are the later place of one, whatever order their tails put them
in; pairs of one diagonal (documents and distance) are one match.

Matches are extended left and right on the words themselves. What is at least ``MIN_WORDS`` long is a repeat. A passage
of MIN_WORDS + SPARSE - 1 words that occurs twice always gives its later occurrence a match of at least MIN_WORDS words;
shorter ones do unless all those it is paired with, which agree on the right, differ within the first SPARSE words on
the left.

Defined cases: null or empty text and texts under MIN_WORDS words match nothing. A null doc_id counts as smaller than
all others and is returned as null. Rows that share a doc_id (or have none) are documents of their own text: with the
hash of the text as a second part of their key (0 where the doc_id is alone) they match each other like any others. Rows
equal in doc_id and text are one document, for which one row says that its whole text repeats. A passage repeated within
one document matches there. Ties: equal suffixes are ordered by doc_id, then position. Columns
other than doc_id and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE, WORD, Words, batch_of, columns_of, signed, slices, sliding, stored

MIN_WORDS, SPARSE, KMER = 50, 15, 8
LEAD = 32  # words of the long block; an occurrence of MIN_WORDS words has 36 from its first kept suffix on
BLOCKS = (40, 48, 64)  # ends of the short blocks
NO_ID = -(1 << 63)
_U = np.uint64


def selected(words: Words) -> np.ndarray:
    """Positions of the kept suffixes: minimisers with LEAD words of text from them on."""
    left, prefix = words.left(), words.prefix()
    h = np.full(len(left), ~_U(0))
    inside = np.flatnonzero(left >= KMER)
    h[inside] = words.span(prefix, inside, inside + KMER)
    least = sliding(h, SPARSE, np.minimum)
    least = np.where(left[: len(least)] >= SPARSE + KMER - 1, least, _U(0))  # windows inside one text
    if not len(least):
        return np.zeros(0, np.int64)
    around = np.concatenate([np.zeros(SPARSE - 1, np.uint64), least, np.zeros(SPARSE - 1, np.uint64)])
    best = sliding(around, SPARSE, np.maximum)[: len(h)]
    return np.flatnonzero((h == best) & (left >= LEAD))


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        words = Words(batch.column("text"))
        at, prefix = selected(words), words.prefix()
        row = words.row[at]
        end = words.first[row + 1]
        lead, short, last = signed(words.span(prefix, at, at + LEAD)), np.zeros(len(at), np.uint64), at + LEAD
        for b in BLOCKS:  # beyond the end of the text a block is empty, which sorts by itself
            to = np.minimum(at + b, end)
            short = short << _U(BITS) | words.span(prefix, last, to) >> _U(64 - BITS)
            last = to
        yield batch_of({"lead": (lead, pa.int64()), "short": (signed(short), pa.int64()),
                        **{c: (batch.column(c).take(pa.array(row)), None) for c in ("key", "ord")}, "at": (at - words.first[row], pa.int32())})


PLACE = ("key", "ord", "at")
BITS = 63 // len(BLOCKS)  # of the hash of a short block; all of them travel as one number
STORED = ["lead", "short", *PLACE]
ORDER = ["lead", *[f"b{i}" for i in range(len(BLOCKS))], *PLACE]
_SUFFIX = "lead long, short long, key long, ord long, at int"
_PAIR = "kind int, part int, level int, lead long, rest string, key long, ord long, at int, other long, other_ord long, other_at int"
PAIR, FIRST, LAST = 0, 1, 2
LEVELS = len(BLOCKS)  # prefixes of a suffix: the long block alone, then one short block more each, but not all of them
NEXT = -1  # level of the rows about the first and last suffix itself


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition: each suffix that shares the long block with the one before it, paired with that one; if it
    does not share all blocks with it (else it is the later place), also, for each level, with the least place so far
    of the suffixes that share its prefix. A new least is paired with the one that it replaces, so of a run all but its
    least are the later place of a pair. And the partition's first and last suffix, and the least of its first and last
    run of each level."""
    from pyspark import TaskContext

    part, before, least, first = TaskContext.get().partitionId(), None, None, None

    def rows(kind, level, lead, rest, place, other):
        n = len(place[0])
        kinds = (pa.int64(), pa.int64(), pa.int32())
        return batch_of({"kind": (np.full(n, kind, np.int32), None), "part": (np.full(n, part, np.int32), None), "level": (np.asarray(level, np.int32), None), "lead": (lead, pa.int64()),
                         "rest": (rest, pa.string()), **{c: (x, t) for c, x, t in zip(PLACE, place, kinds)}, **{c: (x, t) for c, x, t in zip(("other", "other_ord", "other_at"), other, kinds)}})

    def edge(kind, cols, i, ends):
        """The suffix at i and the ends of its runs, one for each level."""
        place = [np.array([cols[c][i], *x]) for c, x in zip(PLACE, ends)]
        rest = [None, *[",".join(str(cols[f"b{k}"][i]) for k in range(level)) for level in range(LEVELS)]]
        return rows(kind, [NEXT, *range(LEVELS)], np.repeat(cols["lead"][i], LEVELS + 1), rest, place, place)

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {c: batch.column(c).to_numpy() for c in STORED}
        cols |= {f"b{i}": cols["short"] >> BITS * (len(BLOCKS) - 1 - i) & (1 << BITS) - 1 for i in range(len(BLOCKS))}
        if before is None:  # the first suffix stands before itself, so it begins the runs and makes no pair
            before = {c: x[:1] for c, x in cols.items()}
            least = [np.repeat(before[c], LEVELS) for c in PLACE]
            first = [before, [x.copy() for x in least], np.ones(LEVELS, bool)]
        n = batch.num_rows
        place = [np.concatenate([x, before[c], cols[c]]) for c, x in zip(PLACE, least)]  # least ones, the one before, the batch
        order = np.lexsort(place[::-1])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        here = np.arange(LEVELS + 1, LEVELS + 1 + n)
        alike = np.logical_and.accumulate([cols[c] == np.append(before[c], cols[c][:-1]) for c in ORDER[: LEVELS + 1]])
        mine, others = [here[alike[0]]], [here[alike[0]] - 1]
        for level, same in enumerate(alike[:-1]):
            run = np.append(0, np.cumsum(~same))
            so_far = np.minimum.accumulate(np.append(rank[level], rank[here]) - run * len(order)) + run * len(order)
            ask = same & ~alike[-1]
            mine.append(here[ask])
            others.append(order[so_far[:-1][ask]])
            end = order[so_far[-1]]
            if first[2][level]:
                stop = np.searchsorted(run, 0, "right") - 1
                for x, y in zip(first[1], place):
                    x[level] = y[order[so_far[stop]]]
                first[2][level] = run[-1] == 0
            for x, y in zip(least, place):
                x[level] = y[end]
        pair = np.unique(np.concatenate(mine) * len(order) + np.concatenate(others))
        i, j = pair // len(order), pair % len(order)
        hit = np.any([x[i] != x[j] for x in place], axis=0)
        i, j = i[hit], j[hit]
        yield rows(PAIR, np.full(len(i), NEXT), pa.nulls(len(i), pa.int64()), pa.nulls(len(i), pa.string()), [x[i] for x in place], [x[j] for x in place])
        before = {c: x[-1:] for c, x in cols.items()}
    if before is not None:
        yield edge(FIRST, first[0], 0, first[1])
        yield edge(LAST, before, 0, least)


def matched(texts: DataFrame) -> DataFrame:
    """texts: key, ord, text. Pairs of places that share LEAD words: key, ord, at and other, other_ord, other_at."""
    suffixes = texts.select("key", "ord", "text").mapInArrow(_suffixes, _SUFFIX)
    array = suffixes.repartitionByRange(*STORED).sortWithinPartitions(*STORED)
    rows = stored(array.mapInArrow(_neighbours, _PAIR))
    ends = rows.where(F.col("kind") != PAIR)  # 2 (LEVELS + 1) rows for each partition of the array
    edges = Window.orderBy("part", "kind")
    before = {c: F.lag(c).over(edges) for c in ("lead", *PLACE)}
    names = ("other", "other_ord", "other_at")
    differ = "(key != other or ord != other_ord or at != other_at)"
    seams = ends.where(F.col("level") == NEXT).select("kind", "lead", *PLACE, before["lead"].alias("l"), *[before[c].alias(n) for c, n in zip(PLACE, names)])
    seams = seams.where(f"kind = {FIRST} and l = lead and {differ}").select(*PLACE, *names)
    runs = Window.partitionBy("level", "lead", "rest").orderBy("part", "kind").rowsBetween(Window.unboundedPreceding, -1)
    cut = ends.where(F.col("level") != NEXT).select(*PLACE, F.min(F.struct(*PLACE)).over(runs).alias("least"))
    cut = cut.where("least is not null").select(*PLACE, *[F.col(f"least.{c}").alias(n) for c, n in zip(PLACE, names)]).where(differ)
    return rows.where(F.col("kind") == PAIR).select(*PLACE, *names).unionByName(seams).unionByName(cut)


def near(pairs: DataFrame) -> DataFrame:
    """One pair for each diagonal of two documents, the later place first."""
    late = F.expr("struct(key, ord, at) > struct(other, other_ord, other_at)")
    pick = lambda a, b: F.when(late, F.col(a)).otherwise(F.col(b))
    both = (("key", "other", "src"), ("ord", "other_ord", "src_ord"), ("at", "other_at", "src_at"))
    turned = pairs.select(*[pick(a, b).alias(a) for a, b, _ in both], *[pick(b, a).alias(c) for a, b, c in both])
    return turned.groupBy("key", "ord", "src", "src_ord", (F.col("at") - F.col("src_at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"))


def extended(words: list[bytes], other: list[bytes], at: int, diagonal: int) -> tuple[int, int]:
    """The greatest run around the place where both agree, as a start and an end in words."""
    start, end = at, at
    while end < len(words) and end - diagonal < len(other) and words[end] == other[end - diagonal]:
        end += 1
    while start > 0 and start - diagonal > 0 and words[start - 1] == other[start - 1 - diagonal]:
        start -= 1
    return start, end


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as Zstandard frames, for their two shuffles."""
    codec = pa.Codec("zstd", 1)
    for batch in slices(batches, "text"):
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        yield batch_of({**{c: (batch.column(c), None) for c in ("key", "ord")}, "body": ([codec.compress(t, asbytes=True) for t in texts], pa.binary()),
                        "size": ([len(t) for t in texts], pa.int32())})


def _extend(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in slices(slices(batches, "body", SLICE // 4), "src_body", SLICE // 4):
            out = []
            ids = ("key", "ord", "src")
            bodies = ("body", "size", "src_body", "src_size")
            for key, own, src, body, size, src_body, src_size, diagonal, ats in zip(*(batch.column(c).to_pylist() for c in (*ids, *bodies, "diagonal", "ats"))):
                words, there, done = codec.decompress(body, size, asbytes=True).split(), codec.decompress(src_body, src_size, asbytes=True).split(), -1
                for at in sorted(ats):
                    if at >= done and at < len(words) and 0 <= at - diagonal < len(there):
                        start, done = extended(words, there, at, diagonal)
                        if done - start >= least:
                            out.append((key, own, start, done - start, src, start - diagonal))
                        done = max(done, at + 1)
            cols = list(zip(*out)) or [()] * 6
            yield batch_of({n: (list(c), pa.int64()) for n, c in zip(("key", "ord", "start_word", "n_words", "src", "src_start_word"), cols)})
    return run


def keyed(docs: DataFrame) -> DataFrame:
    """key, ord, text and copies: rows by doc_id and, where it is shared or null, by text; equal rows are one."""
    docs = columns_of(docs, "doc_id", "text").where("text is not null").withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    shared = stored(docs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit(True).alias("shared")))
    rows = docs.select("key", "text").join(shared, "key", "left")
    alone = rows.where("shared is null").select("key", F.lit(0).cast("long").alias("ord"), "text", F.lit(1).cast("long").alias("copies"))
    several = rows.where("shared").groupBy("key", F.xxhash64("text").alias("ord")).agg(F.any_value("text").alias("text"), F.count("*").alias("copies"))
    return alone.unionByName(several)


def repeats(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """doc_id, start_word, n_words, src_doc_id, src_start_word: each maximal match of at least that many words between
    paired suffixes, its later place first."""
    if least < MIN_WORDS:
        raise ValueError(f"the suffixes are selected for matches of {MIN_WORDS} words and more")
    texts = keyed(docs)
    pairs = stored(near(matched(texts)))
    own = texts.select("key", "ord", "text").mapInArrow(_packed, "key long, ord long, body binary, size int")
    other = {c: F.col(c).alias(n) for c, n in zip(own.columns, ("src", "src_ord", "src_body", "src_size"))}
    out = pairs.join(own, ["key", "ord"]).join(own.select(*other.values()), ["src", "src_ord"])
    kinds = ", ".join(f"{c} long" for c in ("key", "ord", "start_word", "n_words", "src", "src_start_word"))
    found = out.select("key", "ord", "src", "body", "size", "src_body", "src_size", "diagonal", "ats").mapInArrow(_extend(least), kinds).distinct().drop("ord")
    n = F.regexp_count("text", F.lit(WORD)).cast("long")
    zero = F.lit(0).cast("long")
    copies = texts.where("copies > 1").select("key", zero.alias("start_word"), n.alias("n_words"), F.col("key").alias("src"), zero.alias("src_start_word")).where(F.col("n_words") >= least)
    name = lambda c, to: F.expr(f"if({c} = {NO_ID}, null, {c})").alias(to)
    return found.unionByName(copies).select(name("key", "doc_id"), "start_word", "n_words", name("src", "src_doc_id"), "src_start_word")
