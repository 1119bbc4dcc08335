"""Near-duplicates by SuperMinHash (Ertl 2017): signatures, banding, verification on full sets, union-find grouping.

Each element visits the slots of the signature in the order of its own random permutation; at its j-th slot it offers
j + r with r uniform in [0, 1). A slot keeps the least offer. Ranks of one element are thus spread over the slots (the
correlation that lowers the variance against independent minima), and a text is finished as soon as its largest slot
is below j + 1: later offers cannot win.

Plan. Texts with equal sets form a class with a number of its own, represented by the text of its smallest doc_id; only
representatives are compared.
Sixteen bits of each of 128 slots give 32 bands of four slots. In a bucket every member is compared with the smallest
member (a star, never all pairs); links are confirmed on the full sets and grouped. Then, in the buckets that still
hold more than one component, the members outside the bucket's main component are queries against all its members in
blocks; what the signatures put above ``FLOOR`` is confirmed on the full sets, which meet once for each block of a
component, and only links leave the task. So no link between different texts is lost because its ends met only in a bucket whose pivot is unlike them. A pair with similarity 0.75 misses all bands with
probability 5e-6 and falls below the floor with about the same.

Defined cases: null text or no word: empty set, linked with nothing, component is the own doc_id. Fewer than five
words: the whole sequence is the one shingle. Rows that repeat a doc_id are documents of their own text: two texts
under one doc_id may lie in different components, both named by it (``cluster`` tells them apart); equal rows get equal results. A null doc_id keeps its n_shingles, gets a null component and is kept. Columns other than doc_id and
text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, batch_of, columns_of, mix, signed, slices, stored
from .components import components

SHINGLE, SLOTS, BANDS = 5, 128, 32
SIMILAR = (75, 100)
FLOOR = 0.58
BLOCK = 1024
_U = np.uint64


def shingle_sets(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the shingles, in order within each row, and the offsets of the rows."""
    prefix = words.prefix()
    start = np.flatnonzero(words.left() >= k)
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    row = np.concatenate([words.row[start], short])
    value = np.concatenate([words.span(prefix, start, start + k), words.span(prefix, words.first[short], words.first[short + 1])])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return value[new], np.searchsorted(row[new], np.arange(words.rows + 1))


def superminhash(value: np.ndarray, offsets: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Slots of each row as (rank << 48 | 48 random bits); all ones for an empty row."""
    rows = len(offsets) - 1
    out = np.full((rows, slots), ~_U(0))
    flat = out.reshape(-1)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    order = None
    for j in range(slots):
        if not len(row):
            break
        draw = mix(value + _U((0x9E3779B97F4A7C15 * (2 * j + 1)) & (2**64 - 1)))
        pick = mix(draw ^ _U(0xA5A5A5A5A5A5A5A5)) >> _U(32)
        k = j + ((pick * _U(slots - j)) >> _U(32)).astype(np.int64)
        if order is None:
            slot = k
        else:
            at = np.arange(len(row))
            slot = order[at, k].astype(np.int64)
            order[at, k] = order[:, j]
        np.minimum.at(flat, row * slots + slot, (_U(j) << _U(48)) | (draw >> _U(16)))
        live = (out.max(axis=1) >> _U(48)) > _U(j)
        keep = live[row]
        if order is None:  # the first swap: place 0 goes to where k was
            value, row, k = value[keep], row[keep], k[keep]
            order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(row), 1))
            order[np.arange(len(row)), k] = 0
        elif not keep.all():
            value, row, order = value[keep], row[keep], order[keep]
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        value, off = shingle_sets(Words(batch.column("text"), lower=True))
        n = np.diff(off)
        sig = (mix(superminhash(value, off)) >> _U(48)).astype(">u2")
        pad = np.append(value, _U(0))
        total = [np.where(n > 0, np.add.reduceat(x, np.minimum(off[:-1], len(value))), _U(0)) for x in (mix(pad), mix(pad ^ _U(0x5BD1E995)))]
        yield batch_of({
            "doc_id": (batch.column("doc_id"), None), "text_hash": (batch.column("text_hash"), None), "n_shingles": (n, pa.int64()),
            "d1": (signed(total[0]), pa.int64()), "d2": (signed(total[1]), pa.int64()),
            "sig": ([x.tobytes() for x in sig], pa.binary()),
        })


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, a 128-bit digest of the set (d1, d2) and the signature of each row."""
    docs = _hashed(docs)
    return docs.mapInArrow(_signatures, "doc_id long, text_hash long, n_shingles long, d1 long, d2 long, sig binary")


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(slices(batches, "text_a"), "text_b"):
        (va, oa), (vb, ob) = (shingle_sets(Words(batch.column(c), lower=True)) for c in ("text_a", "text_b"))
        ok = []
        for i in range(batch.num_rows):
            a, b = va[oa[i]: oa[i + 1]], vb[ob[i]: ob[i + 1]]
            both = len(np.intersect1d(a, b, assume_unique=True))
            ok.append(bool(both) and SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both))
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def texts_of(nodes: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """The text that represents each node (one column, distinct): of rows equal in doc_id and text any one."""
    wanted = nodes.join(reps.select("node", F.col("doc").alias("doc_id"), "text_hash"), "node")
    rows = _hashed(docs).where("doc_id is not null and text is not null").join(wanted, ["doc_id", "text_hash"])
    return rows.groupBy("node").agg(F.any_value("text").alias("text"))


def confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar enough. Both joins are shuffled at every size."""
    text = stored(texts_of(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), reps, docs))
    return (pairs.hint("merge").join(text.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").hint("merge")
            .join(text.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
            .select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a long, b long"))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        value, off = shingle_sets(Words(batch.column("text"), lower=True))
        yield batch_of({"node": (batch.column("node"), None), "members": ([value[off[i]: off[i + 1]].tobytes() for i in range(batch.num_rows)], pa.binary())})


def _close(q: np.ndarray, m: np.ndarray, q_size, size, q_comp, comp, band: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the two blocks, of different components, with close signatures, whose first common band is this one."""
    alike = np.zeros((len(q), len(m)), np.uint8)
    for qs, ms in zip(q.T, m.T):  # slot by slot, for all pairs
        alike += qs[:, None] == ms[None, :]
    low, high = np.minimum(q_size[:, None], size[None, :]), np.maximum(q_size[:, None], size[None, :])
    i, j = np.nonzero((alike >= floor * SLOTS) & (q_comp[:, None] != comp[None, :]) & (SIMILAR[1] * low >= SIMILAR[0] * high))
    own = np.zeros(len(i), bool)
    for at in range(0, len(i), 8192):
        part = slice(at, at + 8192)
        own[part] = (q[i[part]] == m[j[part]]).reshape(-1, BANDS, SLOTS // BANDS).all(axis=2).argmax(axis=1) == band
    return i[own], j[own]


def _block_pairs(floor: float):
    def pairs(key, left, right):
        """For each query and block of another component, the members whose signatures are close to the query's. A
        group holds one pair of blocks of a large bucket or many small buckets."""
        import pandas as pd

        right = right.rename(columns=lambda c: c.removeprefix("m_"))
        left, right = (x.sort_values(["bucket", "i", "j"], kind="stable") for x in (left, right))
        q, m = (np.frombuffer(b"".join(x["sig"]), np.uint16).reshape(-1, SLOTS) for x in (left, right))
        size, comp, node, block = (right[c].to_numpy() for c in ("n", "comp", "node", "block"))
        q_size, q_comp, q_node, band = (left[c].to_numpy() for c in ("n", "comp", "node", "band"))
        place = lambda x: pd.MultiIndex.from_arrays([x["bucket"], x["i"], x["j"]])
        at, codes = place(left), {}
        ends = place(right)
        edges = lambda x: np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        starts = edges(ends)
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(ends)).tolist()):
            codes[ends[a]] = (a, b)
        found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        starts = edges(at)
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(at)).tolist()):
            c, d = codes[at[a]]
            i, j = _close(q[a:b], m[c:d], q_size[a:b], size[c:d], q_comp[a:b], comp[c:d], int(band[a]), floor)
            found_i.append(i + a)
            found_j.append(j + c)
        i, j = np.concatenate(found_i), np.concatenate(found_j)
        order = np.lexsort((node[j], block[j], comp[j], i))
        i, j = i[order], j[order]
        new = np.ones(len(i), bool)
        new[1:] = (np.diff(i) != 0) | (np.diff(comp[j]) != 0) | (np.diff(block[j]) != 0)
        first = np.flatnonzero(new)
        return pd.DataFrame({"comp": comp[j[first]], "block": block[j[first]], "q": q_node[i[first]], "ms": pd.Series(np.split(node[j], first[1:]) if len(first) else [], dtype=object)})
    return pairs


def _block_links(key, left, right):
    """Links of the queries to members of one block of a component, one for each query."""
    import pandas as pd

    out = []
    sets = {m: np.frombuffer(x, np.uint64) for m, x in zip(right["m"], right["members"])}
    for q, ms, members in zip(left["q"], left["ms"], left["q_members"]):
        mine = np.frombuffer(members, np.uint64)
        for m in ms:
            both = len(np.intersect1d(mine, sets[m], assume_unique=True)) if m in sets else 0
            if both and SIMILAR[1] * both >= SIMILAR[0] * (len(mine) + len(sets[m]) - both):
                out.append((min(q, m), max(q, m)))
                break
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _bands(reps: DataFrame) -> DataFrame:
    width = 2 * SLOTS // BANDS
    return reps.select("node", F.col("n_shingles").alias("n"), F.explode(F.expr(
        f"transform(sequence(0, {BANDS - 1}), b -> struct(b as band, xxhash64(b, substring(sig, b * {width} + 1, {width})) as bucket))")).alias("x")).select("node", "n", "x.*")


def _cross(bands: DataFrame, reps: DataFrame, grouped: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between different components that meet in a bucket: in each such bucket the members outside its largest
    component are queries against all its members, in blocks of both. Signatures say which pairs are close; their sets
    then meet once for each block of a component, not once for each bucket."""
    parts = lambda k: F.ceil(F.greatest(k / BLOCK, F.lit(1))).cast("int")
    large = grouped.groupBy("comp").agg(parts(F.count("*")).alias("comp_parts")).where("comp_parts > 1")
    labelled = reps.select("node").join(grouped, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    labelled = labelled.join(large, "comp", "left").withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.coalesce("comp_parts", F.lit(1)))).drop("comp_parts")
    labelled = stored(labelled)
    rows = bands.join(labelled, "node")
    sizes = rows.groupBy("band", "bucket", "comp").agg(F.count("*").alias("k"))
    mixed = sizes.groupBy("band", "bucket").agg(F.max(F.struct(F.col("k"), (-F.col("comp")).alias("comp"))).alias("top"), F.sum("k").alias("k"), F.count("*").alias("comps")).where("comps > 1")
    mixed = mixed.select("band", "bucket", (-F.col("top.comp")).alias("main"), parts(F.col("k")).alias("blocks"), parts(F.col("k") - F.col("top.k")).alias("q_blocks"))
    rows = stored(rows.join(mixed, ["band", "bucket"]).join(reps.select("node", "sig"), "node"))
    spread = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n))
    asked = rows.where("comp != main").withColumn("i", spread("q_blocks", 1)).withColumn("j", F.explode(F.expr("sequence(0L, blocks - 1L)")))
    held = rows.withColumn("j", spread("blocks", 2)).withColumn("i", F.explode(F.expr("sequence(0L, q_blocks - 1L)")))
    # small buckets share a group, as each call has its cost; a pair of blocks of a large one has its own
    few = max(1, rows.count() // (4 * BLOCK))
    group = F.when(F.expr("blocks = 1 and q_blocks = 1"), F.pmod("bucket", F.lit(few))).otherwise(F.xxhash64("bucket", "i", "j")).alias("g")
    cols = [group, "bucket", "band", "i", "j", "node", "comp", "n", "sig", "block"]
    held = held.select(*cols).toDF("m_g", *[f"m_{c}" for c in cols[1:]])  # own names: both come from the same rows
    close = asked.select(*cols).groupBy("g").cogroup(held.groupBy("m_g")).applyInPandas(_block_pairs(FLOOR), "comp long, block long, q long, ms array<long>")
    close = stored(close)

    asking = close.groupBy("comp", "block").agg(parts(F.count("*")).alias("q_parts"))
    needed = stored(labelled.join(asking, ["comp", "block"]).select(F.col("comp").alias("c"), F.col("block").alias("b"), "node", "q_parts"))
    nodes = needed.select("node").unionByName(close.select(F.col("q").alias("node"))).distinct()
    sets = stored(texts_of(nodes, reps, docs).mapInArrow(_sets, "node long, members binary"))
    asked = close.join(asking, ["comp", "block"]).withColumn("part", F.pmod(F.xxhash64("q"), F.col("q_parts"))).join(sets.select(F.col("node").alias("q"), F.col("members").alias("q_members")), "q")
    held = needed.withColumn("p", F.explode(F.expr("sequence(0L, q_parts - 1L)")))
    held = held.join(sets, "node").select("c", "b", "p", F.col("node").alias("m"), "members")
    return asked.select("comp", "block", "part", "q", "ms", "q_members").groupBy("comp", "block", "part").cogroup(held.groupBy("c", "b", "p")).applyInPandas(_block_links, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; see the module's text. Also text_hash, xxhash64 of the text,
    and cluster, which together with component_id names the component (null without shingles or doc_id)."""
    sig = stored(signatures(docs))
    some = sig.where("n_shingles > 0 and doc_id is not null")
    digest = ["d1", "d2", "n_shingles"]
    least = some.groupBy(*digest).agg(F.min(F.struct("doc_id", "text_hash")).alias("m"), F.any_value("sig").alias("sig"))
    reps = stored(least.select(F.monotonically_increasing_id().alias("node"), F.col("m.doc_id").alias("doc"), F.col("m.text_hash").alias("text_hash"), *digest, "sig"))
    bands = _bands(reps)
    star = bands.join(bands.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1"), "bucket").where("node != pivot")
    star = stored(star.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct())
    links = stored(confirmed(star, reps, docs))
    grouped = components(links).withColumnsRenamed({"component": "comp"})
    more = stored(_cross(bands, reps, grouped, docs))
    low, high = (grouped.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp")) for c in ("a", "b"))
    second = components(more.join(low, "a", "left").join(high, "b", "left").select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b")))
    second = second.withColumnsRenamed({"node": "comp", "component": "further"})
    named = reps.select("node", "doc", *digest).join(grouped, "node", "left").withColumn("comp", F.coalesce("comp", "node")).join(second, "comp", "left")
    named = stored(named.select("doc", *digest, F.coalesce("further", "comp").alias("comp")))
    first = named.groupBy("comp").agg(F.min(F.struct("doc", "d1", "d2")).alias("m")).select("comp", F.col("m.doc").alias("component_id"), F.xxhash64("m.d1", "m.d2").alias("cluster"))
    found = sig.drop("sig").join(named.join(first, "comp").select(*digest, "component_id", "cluster"), digest, "left")
    with_id = lambda c: F.when(F.col("doc_id").isNotNull(), c)
    found = found.select("doc_id", "n_shingles", with_id(F.coalesce("component_id", "doc_id")).alias("component_id"), "text_hash", with_id(F.col("cluster")).alias("cluster"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
