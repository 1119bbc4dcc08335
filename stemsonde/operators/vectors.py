"""Embedding geometry.

Embeddings are long rows (unit_id, [variant,] layer, row, vec).  Distances are
expressions; spectra come from one Gram matrix per key, summed where the rows
lie, so vectors never cross the network for them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.draws import draw
from ..functions.vectors import cosine_distance, norm
from .aggregates import spearman
from .joins import compare_variants, salted_join
from .ranking import cumulative_counts, draw_rank, first_by, top_k, value_counts


def delta_profile(emb: DataFrame, mut_pos: str = "mut_pos", pos: str = "row") -> DataFrame:
    """deltas(unit, layer, mut_pos, pos, delta) at every position but the mutated one."""
    d = compare_variants(emb)
    return d.filter(F.col(pos) != F.col(mut_pos))


def self_delta(emb: DataFrame, mut_pos: str = "mut_pos", pos: str = "row") -> DataFrame:
    """The distance at the mutated position itself; other rows are cut before the join."""
    at = emb.filter((F.col("variant") == "wt") | (F.col(pos) == F.col(mut_pos)))
    return compare_variants(at)


def same_span(ref_rows: DataFrame, mut_rows: DataFrame, by: Sequence[str] = ("unit_id", "pos")) -> DataFrame:
    """Whether the mutated position kept its token span: inputs carry start and end."""
    a = ref_rows.select(*by, F.struct("start", "end").alias("__a"))
    b = mut_rows.select(*by, F.struct("start", "end").alias("__b"))
    return a.join(b, list(by)).select(*by, (F.col("__a") == F.col("__b")).alias("same_span"))


def noop_floor(emb: DataFrame, repeat: str = "repeat", by: Sequence[str] = ("unit_id",)) -> DataFrame:
    """Largest distance between two passes of one unmutated input."""
    two = emb.filter(F.col("variant").isin("wt", repeat))
    return compare_variants(two).groupBy(*by).agg(F.max("delta").alias("noop_floor"))


# ------------------------------------------------------------------ pooling

def pooled(emb: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean vector per key.  Dimensions are averaged map-side, then reassembled;
    a key contributes one row per dimension to the exchange, whatever its size."""
    dims = emb.select(*by, F.posexplode(F.col("vec").cast("array<double>")).alias("dim", "x"))
    mean = dims.groupBy(*by, "dim").agg(F.avg("x").alias("x"))
    return mean.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))),
                                             lambda e: e["x"]).alias("vec"))


def pooled_distance(emb: DataFrame, key: str, by: Sequence[str] = ("layer",), reference: Column | None = None) -> DataFrame:
    """Distance of each variant's mean vector from the reference variant's, per layer.

    The reference is the smallest ``key`` unless a condition is given.
    """
    p = pooled(emb, [*by, key])
    if reference is None:
        low = p.groupBy(*by).agg(F.min(key).alias(key))
        ref = p.join(low, [*by, key], "left_semi")
    else:
        ref = p.filter(reference)
    ref = ref.select(*by, F.col("vec").alias("__ref"))
    return p.join(ref, list(by)).withColumn("distance", cosine_distance(F.col("__ref"), F.col("vec"))) \
        .drop("__ref", "vec")


def graded_best_layer(dist: DataFrame, key: str, layer: str = "layer", by: Sequence[str] = ()) -> DataFrame:
    """Layer whose distances track the graded key most strongly; layers with a null are out."""
    whole = dist.groupBy(*by, layer).agg(F.count_if(F.col("distance").isNull()).alias("__miss")).filter("__miss = 0")
    rho = spearman(dist.join(whole.select(*by, layer), [*by, layer], "left_semi"), key, "distance", [*by, layer], bounded=True)
    rho = rho.filter(F.col("rho").isNotNull()).withColumns({"abs_rho": F.abs("rho"), "__g": F.lit(0)})
    return first_by(rho, [*by, "__g"], "abs_rho", [layer], ["rho"]).drop("__g")


# ------------------------------------------------------- region-aligned slots

def align_regions(emb: DataFrame, flank: int, slots: int, width: str = "middle",
                  by: Sequence[str] = ("unit_id", "variant", "layer")) -> DataFrame:
    """slots(…, slot, region, vec): left flank, pooled middle, right flank.

    ``width`` is the number of middle rows of the variant.  Middle rows pool into
    ``slots`` equal blocks and a remainder is dropped; with fewer middle rows than
    slots each row is its own slot.  Slots without rows are zero vectors.
    """
    r, m = F.col("row"), F.col(width)
    block = F.floor(m / slots)
    mid = r - flank
    slot = (F.when(r < flank, r)
            .when((mid < m) & (block >= 1) & (mid < block * slots), flank + F.floor(mid / block))
            .when((mid < m) & (block < 1), flank + mid)
            .when((r >= flank + m) & (r < 2 * flank + m), r - m + slots))
    placed = emb.withColumn("slot", slot.cast("int")).filter(F.col("slot").isNotNull())
    means = pooled(placed, [*by, "slot"])
    grid = emb.groupBy(*by).agg(F.max(F.size("vec")).alias("__d")).withColumn(
        "slot", F.explode(F.sequence(F.lit(0), F.lit(2 * flank + slots - 1))))
    region = F.when(F.col("slot") < flank, "left").when(F.col("slot") < flank + slots, "middle").otherwise("right")
    return (grid.join(means, [*by, "slot"], "left")
            .withColumn("vec", F.coalesce("vec", F.array_repeat(F.lit(0.0), F.col("__d"))))
            .withColumn("region", region).drop("__d"))


def direction_instability(aligned: DataFrame, variant: str = "variant", reference: str = "wt",
                          by: Sequence[str] = ("unit_id", "layer"), eps: float = 1e-10) -> DataFrame:
    """1 - cos per slot against the reference variant, norms padded by ``eps``."""
    keys = [*by, "slot"]
    ref = aligned.filter(F.col(variant) == reference).select(*keys, F.col("vec").alias("__ref"))
    d = aligned.filter(F.col(variant) != reference).join(ref, keys)
    inner = F.aggregate(F.zip_with("__ref", "vec", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    di = 1.0 - inner / ((norm(F.col("__ref")) + eps) * (norm(F.col("vec")) + eps))
    return d.withColumn("di", di).drop("__ref", "vec")


def instability_summary(di: DataFrame, by: Sequence[str] = ("unit_id", "layer")) -> DataFrame:
    """Region means of the mean profile, middle over left, and the profile's range."""
    profile = di.groupBy(*by, "slot", "region").agg(F.avg("di").alias("di"))
    mean = lambda r: F.avg(F.when(F.col("region") == r, F.col("di")))
    g = profile.groupBy(*by).agg(mean("left").alias("left_di"), mean("middle").alias("middle_di"),
                                 mean("right").alias("right_di"), (F.max("di") - F.min("di")).alias("di_range"))
    return g.withColumn("elevation", F.when(F.col("left_di") > 0, F.col("middle_di") / F.col("left_di"))
                        .otherwise(F.lit(float("inf"))))


def instability_by_deviation(di: DataFrame, deviation: str, variant: str = "variant",
                             by: Sequence[str] = ("unit_id", "layer")) -> DataFrame:
    """Correlation of a variant's mean instability with its deviation from the reference."""
    per = di.groupBy(*by, variant, deviation).agg(F.avg("di").alias("di"))
    return spearman(per, deviation, "di", by, bounded=True)


# ------------------------------------------------------------------ norms

def window_norm(emb: DataFrame, sizes: Sequence[int], by: Sequence[str], centre: Column | None = None) -> DataFrame:
    """Mean row norm in centred windows and the same over sqrt(rows).

    Rows are 0-based and dense; the centre is half the row count unless given.
    """
    n = emb.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    rows = salted_join(emb.select(*by, "row", norm(F.col("vec")).alias("__x")), n, list(by), F.col("row"))
    c = centre if centre is not None else F.floor(F.col("__n") / 2)
    w = rows.withColumn("window", F.explode(F.array(*[F.lit(int(s)) for s in sizes])))
    half = F.floor(F.col("window") / 2)
    inside = (F.col("row") >= F.greatest(F.lit(0), c - half)) & (F.col("row") < F.least(F.col("__n"), c + half))
    g = w.filter(inside).groupBy(*by, "window").agg(F.avg("__x").alias("mean_norm"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("corrected", F.col("mean_norm") / F.sqrt("n"))


def dimension_norm(emb: DataFrame, by: Sequence[str], k: int = 20) -> DataFrame:
    """Per-dimension norm over the rows, divided by sqrt(rows); the ``k`` largest."""
    dims = emb.select(*by, F.posexplode(F.col("vec").cast("array<double>")).alias("dim", "x"))
    g = dims.groupBy(*by, "dim").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.count(F.lit(1)).alias("n"))
    g = g.withColumn("corrected", F.col("norm") / F.sqrt("n"))
    return top_k(g, by, [F.desc("corrected"), F.col("dim")], k, key=["dim"])


def region_norm(emb: DataFrame, inside: Column, by: Sequence[str]) -> DataFrame:
    """Mean norm inside a region and outside it."""
    x = norm(F.col("vec"))
    return emb.groupBy(*by).agg(F.avg(F.when(inside, x)).alias("mean_norm_inside"),
                                F.avg(F.when(~inside, x)).alias("mean_norm_outside"))


# ------------------------------------------------------- spectra and subspaces

def _schema(df: DataFrame, by: Sequence[str], rest: str) -> T.StructType:
    fields = [df.schema[c] for c in by]
    return T.StructType(fields + list(T._parse_datatype_string(rest).fields))


GRAM = "n LONG, s ARRAY<DOUBLE>, g ARRAY<DOUBLE>"
MAX_HELD = 1 << 28  # bytes of partial Gram matrices a task holds before it emits them


def gram(emb: DataFrame, by: Sequence[str], vec: str = "vec", fan: int = 32) -> DataFrame:
    """Row count, vector sum and Gram matrix (flattened) per key.

    Each task adds its own rows up and emits one partial per key; partials are
    merged over ``fan`` sub-keys and then over the key, so neither a hot key nor
    many partials meet in one task.
    """
    by = list(by)

    def partial(batches):
        held, size = {}, 0
        for pdf in batches:
            for key, part in pdf.groupby(by, sort=False):
                x = np.stack(part[vec].to_numpy()).astype(np.float64)
                n, s, g = held.get(key, (0, 0.0, 0.0))
                size += 0 if n else 8 * x.shape[1] ** 2
                held[key] = (n + len(x), s + x.sum(axis=0), g + x.T @ x)
            if size > MAX_HELD:
                yield _rows(held)
                held, size = {}, 0
        if held:
            yield _rows(held)

    def _rows(held):
        keys = list(held)
        out = {c: [k[j] for k in keys] for j, c in enumerate(by)}
        out["n"] = [held[k][0] for k in keys]
        out["s"] = [held[k][1].tolist() for k in keys]
        out["g"] = [held[k][2].ravel().tolist() for k in keys]
        return pd.DataFrame(out)

    def merge(pdf):
        head = {c: [pdf[c].iloc[0]] for c in pdf.columns if c not in ("n", "s", "g")}
        return pd.DataFrame({**head, "n": [int(pdf["n"].sum())],
                             "s": [np.sum(np.stack(pdf["s"].to_numpy()), axis=0).tolist()],
                             "g": [np.sum(np.stack(pdf["g"].to_numpy()), axis=0).tolist()]})

    parts = emb.select(*by, vec).mapInPandas(partial, _schema(emb, by, GRAM))
    salted = parts.withColumn("fan", F.pmod(F.xxhash64("n", "s"), F.lit(fan)).cast("int"))
    level = salted.groupBy(*by, "fan").applyInPandas(merge, _schema(salted, [*by, "fan"], GRAM))
    return level.drop("fan").groupBy(*by).applyInPandas(merge, _schema(emb, by, GRAM))


EIGEN = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("d", T.IntegerType()),
    T.StructField("values", T.ArrayType(T.DoubleType())),
    T.StructField("components", T.ArrayType(T.DoubleType()))])


def _eigen(centred: bool, keep: int):
    @F.pandas_udf(EIGEN)
    def run(n: pd.Series, s: pd.Series, g: pd.Series) -> pd.DataFrame:
        out = []
        for ni, si, gi in zip(n, s, g):
            si = np.asarray(si, float)
            d = len(si)
            m = np.asarray(gi, float).reshape(d, d)
            if centred:
                m = m - np.outer(si, si) / ni
            val, vec = np.linalg.eigh((m + m.T) / 2.0)
            order = np.argsort(val)[::-1]
            val = np.maximum(val[order], 0.0)[:min(int(ni), d)]
            k = min(keep, len(val))
            out.append((int(ni), d, val.tolist(), vec[:, order[:k]].T.ravel().tolist()))
        return pd.DataFrame(out, columns=["n", "d", "values", "components"])

    return run


def spectra(emb: DataFrame, by: Sequence[str], centred: bool = True, keep: int = 10, vec: str = "vec") -> DataFrame:
    """Descending eigenvalues and the first ``keep`` unit eigenvectors per key."""
    run = _eigen(centred, keep)
    return gram(emb, by, vec).select(*by, run("n", "s", "g").alias("e")).select(*by, "e.*")


def _rank_at(values: Column, share: float) -> Column:
    """1-based count of leading values whose cumulative share reaches ``share``."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    start = F.struct(F.lit(0.0).alias("c"), F.lit(0).alias("k"))
    return F.aggregate(values, start, lambda a, x: F.struct(
        (a["c"] + x).alias("c"), (a["k"] + F.when((a["c"] + x) / total < share, 1).otherwise(0)).alias("k")),
        lambda a: a["k"] + 1)


def effective_dim(spec: DataFrame, by: Sequence[str], share: float = 0.95) -> DataFrame:
    """Effective dimension, first component's share, and number of components."""
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return spec.select(*by, _rank_at(F.col("values"), share).alias("effective_dim"),
                       F.when(total > 0, F.get("values", F.lit(0)) / total).alias("first_share"),
                       F.size("values").alias("n_components"), "n")


def explained_variance(spec: DataFrame, by: Sequence[str], k: int = 20) -> DataFrame:
    """Share of variance of the first ``k`` components, one row each."""
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    shares = F.transform(F.slice("values", 1, k), lambda x: x / total)
    return spec.select(*by, F.posexplode(shares).alias("component", "share"))


def spectrum(spec: DataFrame, by: Sequence[str], top: int = 20, share: float = 0.95) -> DataFrame:
    """Effective rank, decay of the first over the tenth singular value, leading values.

    ``spec`` comes from ``spectra(centred=False)``; singular values are the roots.
    """
    sv = F.transform("values", lambda x: F.sqrt(x))
    tenth = F.get("__sv", F.least(F.lit(9), F.size("__sv") - 1))
    return spec.withColumn("__sv", sv).select(
        *by, _rank_at(F.col("values"), share).alias("effective_rank"),
        F.when(tenth > 0, F.get("__sv", F.lit(0)) / tenth).alias("decay"),
        F.slice("__sv", 1, top).alias("top_values"))


ANGLES = T.StructType([T.StructField("geodesic", T.DoubleType()), T.StructField("max_angle_deg", T.DoubleType()),
                       T.StructField("mean_cos", T.DoubleType())])


def principal_angles(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Angles between the row spaces of two orthonormal sets, largest first."""
    c = np.linalg.svd(u @ v.T, compute_uv=False)
    resid = v - (v @ u.T) @ u
    s = np.sort(np.linalg.svd(resid, compute_uv=False)[:len(c)])
    c = np.clip(np.sort(c)[::-1], 0.0, 1.0)
    # arcsin keeps small angles that arccos loses
    ang = np.where(c ** 2 >= 0.5, np.arcsin(np.clip(s, 0.0, 1.0)), np.arccos(c))
    return np.sort(ang)[::-1]


@F.pandas_udf(ANGLES)
def _angles(d: pd.Series, u: pd.Series, v: pd.Series) -> pd.DataFrame:
    out = []
    for di, ui, vi in zip(d, u, v):
        a, b = np.asarray(ui, float).reshape(-1, di), np.asarray(vi, float).reshape(-1, di)
        k = min(len(a), len(b))
        th = principal_angles(a[:k], b[:k])
        out.append((float(np.sqrt(np.sum(th ** 2))), float(np.degrees(th.max())), float(np.mean(np.cos(th)))))
    return pd.DataFrame(out, columns=["geodesic", "max_angle_deg", "mean_cos"])


def subspace_distance(spec: DataFrame, by: Sequence[str], member: str, reference: Column) -> DataFrame:
    """Geodesic and largest principal angle of every member's subspace from the reference's."""
    ref = spec.filter(reference).select(*by, F.col("components").alias("__r"))
    m = spec.filter(~reference).join(ref, list(by))
    return m.select(*by, member, _angles("d", "__r", "components").alias("a")).select(
        *by, member, "a.geodesic", "a.max_angle_deg")


def layer_similarity(spec: DataFrame, by: Sequence[str], layer: str = "layer") -> DataFrame:
    """Mean cosine of the principal angles for every pair of a key's layers (a handful)."""
    a = spec.select(*by, F.col(layer).alias("layer_a"), "d", F.col("components").alias("__u"))
    b = spec.select(*by, F.col(layer).alias("layer_b"), F.col("components").alias("__v"))
    return a.join(b, list(by)).select(*by, "layer_a", "layer_b", _angles("d", "__u", "__v").alias("x")) \
        .select(*by, "layer_a", "layer_b", F.col("x.mean_cos").alias("mean_cos"))


CORRS = T.ArrayType(T.StructType([T.StructField("component", T.IntegerType()), T.StructField("share", T.DoubleType()),
                                  T.StructField("r", T.DoubleType())]))


def _component_corr(k: int):
    @F.pandas_udf(CORRS)
    def run(n: pd.Series, s: pd.Series, g: pd.Series) -> pd.Series:
        out = []
        for ni, si, gi in zip(n, s, g):
            si = np.asarray(si, float)
            d = len(si)
            m = np.asarray(gi, float).reshape(d, d) - np.outer(si, si) / ni
            x, xy, yy = m[:-1, :-1], m[:-1, -1], m[-1, -1]
            val, vec = np.linalg.eigh((x + x.T) / 2.0)
            order = np.argsort(val)[::-1][:min(k, int(ni), d - 1)]
            total = max(float(np.maximum(val, 0).sum()), 1e-300)
            rows = []
            for c, o in enumerate(order):
                scale = max(val[o], 0.0) * yy
                rows.append({"component": c + 1, "share": float(max(val[o], 0.0) / total),
                             "r": float(vec[:, o] @ xy / np.sqrt(scale)) if scale > 0 else 0.0})
            out.append(rows)
        return pd.Series(out)

    return run


def component_correlation(emb: DataFrame, covariate: str, by: Sequence[str], k: int = 10) -> DataFrame:
    """|r| of each leading component's scores with a covariate of the rows.

    The covariate rides along as one more dimension of the Gram matrix, so scores
    are never materialised: r = u . cov(x, y) / sqrt(lambda var y).
    """
    wide = emb.withColumn("__v", F.concat(F.col("vec").cast("array<double>"), F.array(F.col(covariate).cast("double"))))
    got = gram(wide.select(*by, "__v"), by, "__v")
    return got.select(*by, F.inline(_component_corr(k)("n", "s", "g"))).withColumn("abs_r", F.abs("r")).drop("r")


def best_component(corr: DataFrame, by: Sequence[str]) -> DataFrame:
    """Component of the largest |r|, the first on ties."""
    return first_by(corr, by, "abs_r", ["component"])


# ------------------------------------------------------------------ attention

def attention_contact(attn: DataFrame, contacts: DataFrame, by: Sequence[str] = ("unit_id",),
                      flat: float = 1e-10) -> DataFrame:
    """Spearman agreement of symmetrised attention with contacts per (layer, head).

    attn(…, layer, head, r, c, w), contacts(…, r, c).  Near-constant heads are out.  The
    cells of a head are one record, packed by one exchange; see ``head_agreement``.
    """
    keys = [*by, "layer", "head"]
    heads = attn.filter(F.col("r") != F.col("c")).groupBy(*keys).agg(F.collect_list(F.struct(
        F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("w").cast("double").alias("w"))).alias("__w"))
    heads = heads.select(*keys, F.col("__w.r").alias("r"), F.col("__w.c").alias("c"), F.col("__w.w").alias("w"))
    upper = contacts.filter(F.col("r") < F.col("c")).groupBy(*by).agg(F.collect_set(F.struct(
        F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"))).alias("contacts"))
    return head_agreement(heads.join(upper, list(by), "left"), keys, flat)


HEADS = 64  # at once in a task
Weights = Callable[[pa.RecordBatch], np.ndarray]


def head_agreement(heads: DataFrame, keys: Sequence[str], flat: float = 1e-10, weights: Weights | None = None) -> DataFrame:
    """keys…, n, rho of heads as records: r, c, w arrays of cells off the diagonal (or w alone,
    a square matrix row by row) and contacts, an array of structs (r, c).

    With ``weights`` heads have no cells: it maps a batch of them, ``HEADS`` at most, to their matrices
    (heads x n x n), which are made in the task that reads them and never leave it.

    Contacts are yes or no, so Spearman's rho is the rank sum of the contact cells, centred
    and over the spread of both sides, tied weights with their mean rank.  The deviation that
    tells a flat head comes from the same pass.  No contact, or nothing but contacts: 0.
    """
    kinds = dict(heads.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", n long, rho double"
    if weights is not None:
        return heads.mapInArrow(_made(list(keys), flat, weights), schema)
    many = [F.col(c) if c in kinds else F.lit(None).cast("array<int>").alias(c) for c in ("r", "c")]
    return heads.select(*keys, *many, "w", "contacts").mapInArrow(_agreement(list(keys), flat), schema)


def _contact_cells(contacts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Head and cell (i * size + j) of every contact above the diagonal, each once."""
    head = np.repeat(np.arange(len(contacts)), np.asarray(contacts.value_lengths().fill_null(0)))
    ends = contacts.flatten()
    i, j = (np.asarray(ends.field(k), np.int64) for k in range(2))
    inside = (i < j) & (j < size)
    return tuple(np.unique(np.stack([head, i * size + j], axis=1)[inside], axis=0).T)


def rank_agreement(x: np.ndarray, near: np.ndarray) -> float:
    """Spearman's rho of weights with a few yes among many no, at ``near``."""
    n, k = len(x), len(near)
    if not 0 < k < n:
        return 0.0
    s = np.sort(x)
    rank = (np.searchsorted(s, x[near], "left") + np.searchsorted(s, x[near], "right") + 1) / 2.0
    spread = n * (n * n - 1.0)
    if (s[1:] == s[:-1]).any():
        ties = np.diff(np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))).astype(np.float64)
        spread -= (ties**3 - ties).sum()
    spread *= k * (n - k) / n / 12.0
    return float((rank.sum() - k * (n + 1) / 2.0) / math.sqrt(spread)) if spread > 0 else 0.0


def _told(batch: pa.RecordBatch, keys: list[str], got: list[tuple[int, float | None]]) -> pa.RecordBatch:
    keep = pa.array([rho is not None for _, rho in got], pa.bool_())
    return pa.RecordBatch.from_arrays([*[batch.column(k).filter(keep) for k in keys], pa.array([n for n, _ in got], pa.int64()).filter(keep),
                                       pa.array([rho for _, rho in got], pa.float64()).filter(keep)], names=[*keys, "n", "rho"])


def _made(keys: list[str], flat: float, weights: Weights):
    def run(batches):
        for batch in (whole.slice(at, HEADS) for whole in batches for at in range(0, whole.num_rows, HEADS)):
            w = weights(batch)
            size = w.shape[1]
            i, j = np.triu_indices(size, 1)
            x = (w[:, i, j] + w[:, j, i]) / 2.0
            place = np.full(size * size, -1)
            place[i * size + j] = np.arange(len(i))
            head, cell = _contact_cells(batch.column("contacts"), size)
            near = np.split(place[cell], np.searchsorted(head, np.arange(1, len(x))))
            live = np.zeros(len(x), bool) if not len(i) else x.std(axis=1) >= flat
            yield _told(batch, keys, [(len(i), rank_agreement(v, at) if ok else None) for v, at, ok in zip(x, near, live)])
    return run


def _agreement(keys: list[str], flat: float):
    def one(r, c, w, contacts):
        w = np.asarray(w, np.float64)
        if r is None:
            size = math.isqrt(len(w))
            r, c = np.divmod(np.arange(len(w)), size)
        else:
            r, c = np.asarray(r, np.int64), np.asarray(c, np.int64)
            size = int(max(r.max(initial=-1), c.max(initial=-1))) + 1
        off = r != c
        lo, hi = np.minimum(r, c)[off], np.maximum(r, c)[off]
        cell, at = np.unique(lo * size + hi, return_inverse=True)
        w = np.bincount(at, w[off], len(cell)) / 2.0
        if not len(w) or w.std() < flat:
            return len(w), None
        return len(w), rank_agreement(w, np.flatnonzero(np.isin(cell, _contact_cells(contacts, size)[1])))

    def run(batches):
        for batch in batches:
            cells = lambda x, i: batch.column(x)[i].values.to_numpy(zero_copy_only=False) if batch.column(x)[i].is_valid else None
            yield _told(batch, keys, [one(*(cells(x, i) for x in ("r", "c", "w")), batch.column("contacts").slice(i, 1)) for i in range(batch.num_rows)])
    return run


def best_head(rho: DataFrame, by: Sequence[str] = ("unit_id",)) -> DataFrame:
    """Largest agreement of a unit, starting from 0 at layer 0."""
    g = first_by(rho, by, "rho", ["layer", "head"])
    up = F.col("rho") > 0
    return g.select(*by, F.when(up, F.col("rho")).otherwise(0.0).alias("best_corr"),
                    F.when(up, F.col("layer")).otherwise(0).alias("best_layer"))


# ------------------------------------------------------------------ probe

def fold_plan(sizes: DataFrame, folds: int = 5, unit: str = "unit_id", size: str = "n") -> DataFrame:
    """Group folds balanced by size, from one row per unit, by one rule at every size.

    Units in descending order of size (ties by the digest of their name) are dealt round and back over the folds, so the
    loads of two folds differ by at most the largest unit.  Ranks are distributed: counts of distinct sizes, and a rank
    by digest within a size.
    """
    rows = sizes.select(unit, size, (-F.col(size)).alias("__s"), draw("fold", F.col(unit)).alias("__h"))
    before = cumulative_counts(value_counts(rows, [], "__s"), [], "__s").select("__s", "lo")
    ranked = draw_rank(rows, ["__s"], "__h", [unit], "place").join(before, "__s").withColumn("__i", (F.col("lo") + F.col("place") - 1).cast("long"))
    turn, place = F.floor(F.col("__i") / folds), F.col("__i") % folds
    return ranked.select(unit, size, F.when(turn % 2 == 0, place).otherwise(folds - 1 - place).cast("int").alias("fold"))


def probe(emb: DataFrame, labels: DataFrame, folds: int = 5, c: float = 1.0, max_iter: int = 1000,
          unit: str = "unit_id", keys: Sequence[str] = ("unit_id", "row")) -> DataFrame:
    """Linear probe per layer: L2 logistic regression over rows, group folds by unit,
    balanced accuracy mean and sd.

    labels(…, label 0/1).  All fits take their Newton steps together, ``max_iter`` at most, each from one pass over the
    rows: gradients and Hessians are added up where the rows lie and by Spark, so the driver sees one of a model a step,
    whatever the number of rows and tasks, and at the end one recall per class.
    """
    rows = emb.join(labels, list(keys))
    plan = fold_plan(rows.groupBy(unit).agg(F.count(F.lit(1)).alias("n")), folds, unit)
    data = rows.join(plan.select(unit, "fold"), unit).select(
        "layer", "fold", unit, F.col("label").cast("int").alias("label"), F.col("vec").cast("array<double>").alias("vec")).persist()
    seen = data.groupBy("layer").agg(
        F.countDistinct("label").alias("k"), F.countDistinct("fold").alias("f"), F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d"),
        F.countDistinct(unit).alias("n_units"), F.array_sort(F.collect_set("fold")).alias("folds")) \
        .filter("k = 2 and f >= 2").orderBy("layer").collect()
    ones = {(r["layer"], r["fold"]): (r["n"], r["ones"]) for r in
            data.groupBy("layer", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones")).collect()}
    found = {}
    for r in seen:
        for f in r["folds"]:
            n, k = (sum(ones[(r["layer"], g)][i] for g in r["folds"] if g != f) for i in (0, 1))
            w = np.zeros(r["d"] + 1)
            w[-1] = np.inf if k == n else -np.inf if not k else np.log(k / (n - k))
            found[(r["layer"], f)] = w
    found |= _newton(data, {m: w for m, w in found.items() if np.isfinite(w[-1])}, c, max_iter)
    parts = data.select("layer", "fold", "label", "vec").mapInArrow(_hits(found), "layer int, fold int, label int, hits long, n long")
    recall = parts.groupBy("layer", "fold", "label").agg((F.sum("hits") / F.sum("n")).alias("recall")).groupBy("layer", "fold").agg(F.avg("recall").alias("accuracy"))
    got = {(r["layer"], r["fold"]): r["accuracy"] for r in recall.collect()}
    data.unpersist()
    scores = [(r["layer"], f, got[(r["layer"], f)], r["n"], r["n_units"]) for r in seen for f in r["folds"]]
    out = emb.sparkSession.createDataFrame(scores, "layer int, fold int, accuracy double, n_rows long, n_units long")
    return out.groupBy("layer").agg(
        F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("sd_accuracy"),
        F.first("n_rows").alias("n_rows"), F.first("n_units").alias("n_units"))


def _by_layer(batches, layers):
    """Design matrix with a last column of ones, labels and folds of the rows of each of these layers, batch by batch."""
    for batch in batches:
        at = np.asarray(batch.column("layer"))
        for layer in set(at.tolist()) & layers:
            part = batch.filter(pa.array(at == layer))
            x = np.asarray(part.column("vec").flatten(), np.float64).reshape(part.num_rows, -1)
            yield layer, np.hstack([x, np.ones((len(x), 1))]), np.asarray(part.column("label")), np.asarray(part.column("fold"))


def _sums(models: dict):
    """Loss, gradient and Hessian of every model over a partition's rows outside its fold, as rows (layer, fold, at, value)."""
    def run(batches):
        total = {}
        for layer, x, y, fold in _by_layer(batches, {k for k, _ in models}):
            for (k, f), w in models.items():
                if k == layer:
                    xs, ys = x[fold != f], y[fold != f]
                    z = xs @ w
                    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                    new = np.concatenate([[(np.logaddexp(0, z) - ys * z).sum()], xs.T @ (p - ys), (xs.T @ (xs * (p * (1 - p))[:, None])).reshape(-1)])
                    total[(k, f)] = total.get((k, f), 0) + new
        for (k, f), v in total.items():
            n = len(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)), pa.array(np.full(n, f, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(v)],
                                             names=["layer", "fold", "at", "value"])
    return run


def _newton(data: DataFrame, models: dict, c: float, max_iter: int, tol: float = 1e-10) -> dict:
    """The minimum of each model's log loss plus |w|^2 / 2c (the intercept free), from its start; a step that does not
    lower it is halved."""
    slim, best, live = data.select("layer", "fold", "label", "vec"), {}, dict(models)
    for _ in range(max_iter):
        if not live:
            break
        parts = slim.mapInArrow(_sums(live), "layer int, fold int, at int, value double")
        sums = parts.groupBy("layer", "fold", "at").agg(F.sum("value").alias("value")).toPandas().sort_values("at")
        for m, v in sums.groupby(["layer", "fold"])["value"]:
            w, v = live[m], v.to_numpy()
            d = len(w)
            ridge = np.append(np.full(d - 1, 1 / c), 0.0)
            loss, gradient, hessian = v[0] + (ridge * w * w).sum() / 2, v[1: d + 1] + ridge * w, v[d + 1:].reshape(d, d) + np.diag(ridge + 1e-12)
            if m in best and not loss <= best[m][1] * (1 + 1e-12):
                step = best[m][2] / 2
            else:
                step = -np.linalg.solve(hessian, gradient)
                if -gradient @ step <= tol * max(loss, 1.0):
                    best[m] = (w, loss, step * 0)
                    del live[m]
                    continue
                best[m] = (w, loss, step)
            best[m] = (*best[m][:2], step)
            live[m] = best[m][0] + step
    return {m: w for m, (w, _, _) in best.items()}


def _hits(models: dict):
    """How many rows of each fold and label its model, which has not seen them, tells rightly."""
    def run(batches):
        out = {}
        for layer, x, y, fold in _by_layer(batches, {k for k, _ in models}):
            for f in set(fold.tolist()):
                right = ((x[fold == f] @ models[(layer, f)]) > 0) == (y[fold == f] == 1)
                for label in (0, 1):
                    mine = right[y[fold == f] == label]
                    if len(mine):
                        out[(layer, f, label)] = out.get((layer, f, label), 0) + np.array([mine.sum(), len(mine)])
        rows = [(*k, *v.tolist()) for k, v in out.items()]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(list(zip(*rows)) or [()] * 5, kinds)], names=["layer", "fold", "label", "hits", "n"])
    return run


# ------------------------------------------------------------------ encoder hook

ENCODED = 64  # sequences


def encode(variants: DataFrame, fn: Callable[[list[str]], list[list[np.ndarray]]], keys: Sequence[str],
           sequence: str = "sequence") -> DataFrame:
    """Apply a user encoder batch by batch: (keys…, layer, row, vec).

    ``fn`` maps a list of sequences, ``ENCODED`` at most, to, per sequence, one (rows, d) array per layer.  What comes
    of them is handed on before the next are encoded, so a worker never holds the vectors of a whole Arrow batch.
    """
    keys = list(keys)

    def run(batches):
        for pdf in (whole.iloc[at: at + ENCODED] for whole in batches for at in range(0, len(whole), ENCODED)):
            out = {c: [] for c in [*keys, "layer", "row", "vec"]}
            for rec, per_layer in zip(pdf.to_dict("records"), fn(pdf[sequence].tolist())):
                for layer, mat in enumerate(per_layer):
                    for row, vec in enumerate(mat):
                        for c in keys:
                            out[c].append(rec[c])
                        out["layer"].append(layer)
                        out["row"].append(row)
                        out["vec"].append(np.asarray(vec, float).tolist())
            yield pd.DataFrame(out)

    return variants.select(*keys, sequence).mapInPandas(
        run, _schema(variants, keys, "layer INT, row INT, vec ARRAY<DOUBLE>"))
