"""Sharding by extendible hashing, in DataFrame operations only.

The first 60 bits of the md5 of a row's key are its code. A directory over code prefixes maps to buckets; a bucket that
is larger than the byte limit splits on the next bit, others keep their local depth, until every bucket fits.

The rows are read once for a histogram over prefixes some bits longer than the depth that the total size suggests; the
splits are decided on these sums, which are combined before the shuffle. Only prefixes that are oversized even then are
counted again with more bits. Each row then finds its bucket by an equality join of its prefix with the directory (no
texts are moved); the directory has a few entries for each shard, and the hash spreads rows evenly whatever the hot
source, so no key is hot but a repeated key.

Defined cases: a null key is hashed as the empty string, a null size counts as 0. Rows of one key share a bucket; a
bucket with a single code cannot be split and keeps ``fits = false`` if it is over the limit, as does one row larger
than the limit. An empty table has no rows. Equal rows get equal results. Columns of the input other than the key and
those in the size expression are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

BITS = 60
FINER, COARSER = 3, 3


def code(key: Column) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _prefix(column: str, bits: int, depth: str) -> Column:
    return F.expr(f"shiftright({column}, cast({bits} - {depth} as int))")


def _buckets(cells: DataFrame, bits: int, low: int, limit: int) -> DataFrame:
    """For each cell of that many bits: depth, shard and size of the bucket that it is in. cell, bytes, least and most
    code -> cell, depth, shard, shard_bytes, done (false: it must be counted with more bits)."""
    levels = cells.select("*", F.explode(F.expr(f"sequence({low}, {bits})")).alias("depth")).withColumn("shard", _prefix("cell", bits, "depth"))
    sizes = levels.groupBy("depth", "shard").agg(F.sum("bytes").alias("shard_bytes"), F.min("least").alias("l"), F.max("most").alias("m"))
    ends = sizes.where(f"shard_bytes <= {limit} or l = m or depth = {bits}")
    found = levels.select("cell", "depth", "shard").join(ends.hint("merge"), ["depth", "shard"])
    first = found.groupBy("cell").agg(F.min(F.struct("depth", "shard", "shard_bytes", "l", "m")).alias("x"))
    return first.select("cell", "x.depth", "x.shard", "x.shard_bytes", F.expr(f"x.shard_bytes <= {limit} or x.l = x.m").alias("done"))


def directory(items: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """items: code, bytes. A list of (bits, entries): the entries map prefixes of so many bits to buckets."""
    total = items.agg(F.sum("bytes")).first()[0] or 0
    guess = max(0, math.ceil(math.log2(max(1, total / limit))))
    bits, out, left, low = min(BITS, guess + FINER), [], items, max(0, guess - COARSER)
    while True:
        cells = stored(left.groupBy(_prefix("code", BITS, str(bits)).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.min("code").alias("least"), F.max("code").alias("most")))
        entries = stored(_buckets(cells, bits, low, limit))
        while low and not out and entries.where(f"depth = {low} and done").limit(1).count():  # a shorter prefix may fit as well
            low = max(0, low - COARSER)
            entries = stored(_buckets(cells, bits, low, limit))
        out.append((bits, entries.where("done").drop("done")))
        open_cells = entries.where("not done").select("cell")
        if bits == BITS or not open_cells.limit(1).count():
            return out
        left = left.withColumn("cell", _prefix("code", BITS, str(bits))).join(open_cells, "cell", "left_semi").select("code", "bytes")
        low, bits = bits + 1, min(BITS, bits + 2 * FINER)


def sharded(docs: DataFrame, key: str, size: Column, limit: int) -> DataFrame:
    """The key of each row with bytes, depth and shard (the bucket: so many leading bits and their value), shard_bytes
    and fits."""
    items = docs.select(F.col(f"`{key}`").alias("key"), code(F.col(f"`{key}`")).alias("code"), F.coalesce(size.cast("long"), F.lit(0)).alias("bytes"))
    out = None
    for bits, entries in directory(items.select("code", "bytes"), limit):
        part = items.withColumn("cell", _prefix("code", BITS, str(bits))).join(entries.hint("merge"), "cell")  # the directory grows with the table
        part = part.select(F.col("key").alias(key), "bytes", "depth", "shard", "shard_bytes", (F.col("shard_bytes") <= limit).alias("fits"))
        out = part if out is None else out.unionByName(part)
    return out


def write_shards(docs: DataFrame, key: str, size: Column, limit: int, path: str) -> None:
    """The rows of docs as Parquet, a folder for each shard. Rows with equal keys are in the same shard."""
    names = sharded(docs, key, size, limit).select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("name"), F.concat_ws("-", "depth", "shard").alias("shard")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("name")).join(names, "name")
    rows.select("row", "shard").repartition("shard").write.partitionBy("shard").parquet(path)
