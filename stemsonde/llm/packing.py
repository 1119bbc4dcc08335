"""Conflict-constrained best-fit packing of documents into training sequences.

A bin holds ``capacity`` words. No bin holds two pieces of one source or of one duplicate cluster. Texts longer than the
capacity are cut into pieces: full ones have a bin of their own, the rest is packed like a shorter text.

Pieces are dealt by the hash of their row and number into packing groups of about ``GROUP`` pieces; their number follows the
table, so a group is bounded whatever doc_id, source or cluster is hot, and every group has its share of the hot source.
Rows are numbered where they are stored, so which group a piece joins follows the partitions, not the doc_id. In a group pieces come in order of size (largest first; ties by doc_id, then piece). Bins are ordered by
residual: a bit for each residual that some bin has, and a list of bins under it. A successor search starts at the
least residual that holds the piece and goes on, bin by bin, until one without a conflict is found: that is the tightest
compatible bin. A bin's sources and clusters are bitmaps over the group's values. Without a compatible bin a new one is
opened.

Defined cases: a null or empty text has no words; it gets one row with ``n_words = 0`` and no bin (null). A null source
conflicts with nothing, as does a null cluster. Repeated rows are pieces of their own and, being of one cluster, never
share a bin. A null doc_id sorts before others. Columns other than those named are not read. An empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, batch_of, slices, stored

CAPACITY, GROUP = 2048, 4096


def pack(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each piece, in the given order. sources and clusters are small numbers, -1 for none."""
    place: list[tuple[int, int]] = []
    used: list[int] = []
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    under: dict[int, list[int]] = {}  # bins by residual
    present = 0  # bit r: some bin has residual r
    for size, source, cluster in zip(sizes, sources, clusters):
        s, c = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        found, above = None, present >> size << size
        while above and found is None:
            residual = (above & -above).bit_length() - 1
            found = next((i for i, b in enumerate(under[residual]) if not (source_bits[b] & s or cluster_bits[b] & c)), None)
            above &= above - 1
        if found is None:
            b = len(used)
            used.append(0)
            source_bits.append(0)
            cluster_bits.append(0)
        else:
            b = under[residual].pop(found)
            if not under[residual]:
                present &= ~(1 << residual)
        place.append((b, used[b]))
        used[b] += size
        source_bits[b] |= s
        cluster_bits[b] |= c
        if used[b] < capacity:
            under.setdefault(capacity - used[b], []).append(b)
            present |= 1 << (capacity - used[b])
    return place


def _numbers(values: list) -> list[int]:
    known: dict = {}
    return [-1 if v is None else known.setdefault(v, len(known)) for v in values]


def _packed(capacity: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_words", "descending"), ("order", "ascending"), ("piece", "ascending"), ("cluster", "ascending"), ("source", "ascending")])
        rows = table.to_pydict()
        place = pack(rows["n_words"], _numbers(rows["source"]), _numbers(rows["cluster"]), capacity)
        return pa.table({**{k: table[k] for k in ("doc_id", "piece", "first_word", "n_words", "source", "cluster")}, "packing_group": pa.array([key[0].as_py()] * len(place), pa.int64()),
                         "bin": pa.array([b for b, _ in place], pa.int64()), "offset": pa.array([o for _, o in place], pa.int64())})
    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        yield batch_of({"doc_id": (batch.column("doc_id"), None), "source": (batch.column("source"), None), "cluster": (batch.column("cluster"), None),
                        "words": (Words(batch.column("text")).count, pa.int64())})


def copies_of(text: Column) -> Column:
    """Cluster of a text: equal words, whatever the case and the white space between them; null without words."""
    folded = F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+", " ")
    folded = F.trim(folded)
    return F.when(F.length(folded) > 0, F.sha2(folded, 256))


def packed(docs: DataFrame, cluster: Column | None = None, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """docs: doc_id, text, source. A row for each piece: doc_id, piece, first_word, n_words, source, cluster,
    packing_group, bin (numbered within the group) and offset. A bin is named by packing_group and bin."""
    given = docs.select("doc_id", "source", (copies_of(F.col("text")) if cluster is None else cluster).cast("string").alias("cluster"), "text")
    kinds = {n: t for n, t in given.dtypes}
    rows = stored(given.mapInArrow(_counted, f"doc_id {kinds['doc_id']}, source {kinds['source']}, cluster string, words long"))
    pieces = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("piece", F.explode(F.expr(f"sequence(0L, greatest(ceil(words / {capacity}) - 1, 0L))")))
    pieces = pieces.withColumn("first_word", F.col("piece") * capacity).withColumn("n_words", F.least(F.lit(capacity), F.col("words") - F.col("piece") * capacity))
    n = rows.where("words > 0").agg(F.sum(F.ceil(F.col("words") / capacity))).first()[0] or 0
    dealt = pieces.where("words > 0").select(
        F.pmod(F.xxhash64("row", "piece"), F.lit(max(1, -(-int(n) // group)))).alias("packing_group"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), "doc_id", "piece", "first_word", "n_words", "source", "cluster")
    schema = f"doc_id {kinds['doc_id']}, piece long, first_word long, n_words long, source {kinds['source']}, cluster string, packing_group long, bin long, offset long"
    order = F.col("doc_id") if kinds["doc_id"] in ("bigint", "int") else F.col("name")
    filled = dealt.withColumn("order", order).groupBy("packing_group").applyInArrow(_packed(capacity), schema)
    empty = rows.where("words = 0").select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ("piece", "first_word", "n_words")], "source", "cluster",
                                           *[F.lit(None).cast("long").alias(c) for c in ("packing_group", "bin", "offset")])
    return filled.unionByName(empty)
