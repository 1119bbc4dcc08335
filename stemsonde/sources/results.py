"""Stored results: nested per-unit maps, newest file per model, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RATIO_ENTRY = """best_ratio DOUBLE, best_layer INT, nuc_null_95th DOUBLE, exceeds_nuc_null BOOLEAN,
 dinuc_null_95th DOUBLE, exceeds_dinuc_null BOOLEAN, n_stem INT, n_loop INT, noop_floor DOUBLE,
 skipped STRING"""

SPECIFICITY_ENTRY = """best_ps DOUBLE, best_layer INT, per_layer_ps ARRAY<DOUBLE>, n_eligible_pairs INT,
 n_stems INT, n_wc_pairs_total INT,
 positive_control STRUCT<pass: BOOLEAN, p_value: DOUBLE, mean_stem_delta: DOUBLE, mean_loop_delta: DOUBLE>,
 h3_precision STRUCT<fraction: DOUBLE, n: INT, partner_max_count: INT, p_value: DOUBLE>,
 precision_per_layer ARRAY<DOUBLE>, chance_per_layer ARRAY<DOUBLE>, chance_per_layer_n ARRAY<INT>,
 h3_chance_fraction DOUBLE, h3_chance_fraction_matched DOUBLE, nearer_neighbor_larger DOUBLE,
 noop_floor STRUCT<best_ps_noop: DOUBLE>,
 decoys MAP<STRING, STRUCT<scope: STRING, decoy_set: STRING, rate: ARRAY<DOUBLE>, pairs: ARRAY<INT>,
  comparisons: ARRAY<INT>, ties: ARRAY<INT>>>,
 null_95th_primary DOUBLE, null_95th_conservative DOUBLE, exceeds_null_primary BOOLEAN,
 exceeds_null_conservative BOOLEAN, null_available BOOLEAN, quarantined BOOLEAN, skipped STRING, reason STRING"""


def read_results(spark: SparkSession, path: str, section: str, entry: str = RATIO_ENTRY) -> DataFrame:
    """results(file, unit_id, status, reason, ...) of whole JSON result files.

    ``section`` is the dotted path of the object holding ``per_rna``.
    """
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return per_unit_rows(text, "value", f"$.{section}.per_rna", entry)


def per_unit_rows(df: DataFrame, json: str, json_path: str, entry: str) -> DataFrame:
    """One row per unit of a JSON map column."""
    blob = F.get_json_object(json, json_path)
    parsed = F.from_json(blob, f"MAP<STRING, STRUCT<{_colons(entry)}>>")
    rows = df.select(*[c for c in df.columns if c != json], F.explode(parsed).alias("unit_id", "e"))
    skipped = F.col("e.skipped").isNotNull()
    has_reason = "reason" in [f.name for f in rows.schema["e"].dataType.fields]
    reason = F.coalesce(F.col("e.reason"), F.col("e.skipped")) if has_reason else F.col("e.skipped")
    out = rows.withColumns({"status": F.when(skipped, "skipped").otherwise("scored"),
                            "reason": F.when(skipped, reason)})
    names = [f.name for f in rows.schema["e"].dataType.fields if f.name not in ("skipped", "reason")]
    return out.select(*[c for c in out.columns if c != "e"], *[F.col(f"e.{n}").alias(n) for n in names])


def _colons(fields: str) -> str:
    """Top-level ``name TYPE`` pairs to ``name: TYPE``."""
    out, depth, start, parts = [], 0, 0, []
    for k, c in enumerate(fields + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            parts.append(fields[start:k])
            start = k + 1
    for p in parts:
        name, kind = p.strip().split(None, 1)
        out.append(f"{name}: {kind}")
    return ", ".join(out)


def scored(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("status") == "scored")


def layers(rows: DataFrame, arrays: list[str], keep: list[str]) -> DataFrame:
    """Per-layer arrays to long rows (…, layer, value columns)."""
    zipped = F.arrays_zip(*[F.col(a) for a in arrays])
    return (rows.select(*keep, F.posexplode(zipped).alias("layer", "v"))
            .select(*keep, "layer", *[F.col(f"v.{a}").alias(a) for a in arrays]))


def latest_by(df: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """The row of the largest ``order`` per key, as one hash aggregate."""
    order = F.col(order) if isinstance(order, str) else order
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r"))
            .select(*keys, "__r.*"))


def write_results(df: DataFrame, path: str, by: tuple[str, ...] = ("model", "arm"),
                  fmt: str = "parquet", mode: str = "append") -> None:
    """Partitioned result sink."""
    df.write.mode(mode).partitionBy(*by).format(fmt).save(path)


def position_export(dist: DataFrame, unit: str = "unit_id") -> DataFrame:
    """One row per unit: symbols, labels, same-span flags and the layer x position matrix.

    ``dist`` is long (unit, pos, sym, label, same_span, layer, value, valid); the
    collected group is one unit's own cells.
    """
    per_layer = dist.groupBy(unit, "layer").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(
            "pos", F.round(F.coalesce("value", F.lit(0.0)), 6).alias("v"), "valid"))), lambda e: e).alias("a"))
    mats = per_layer.groupBy(unit).agg(F.array_sort(F.collect_list(F.struct(
        "layer", F.transform("a", lambda e: e["v"]).alias("d"),
        F.array_join(F.transform("a", lambda e: F.when(e["valid"], "1").otherwise("0")), "").alias("m")))).alias("l"))
    first = dist.groupBy(unit, "pos").agg(F.first("sym").alias("sym"), F.first("label").alias("label"),
                                          F.bool_and("same_span").alias("same_span"))
    heads = first.groupBy(unit).agg(F.array_sort(F.collect_list(F.struct(
        "pos", "sym", F.when(F.col("label") == "paired", "S").otherwise("L").alias("label"),
        F.when(F.col("same_span"), "1").otherwise("0").alias("same")))).alias("h"))
    text = lambda f: F.array_join(F.transform("h", lambda e: e[f]), "")
    return heads.join(mats, unit).select(
        unit, text("sym").alias("symbols"), text("label").alias("labels"), text("same").alias("same_span"),
        F.transform("l", lambda e: e["d"]).alias("layer_distances"),
        F.transform("l", lambda e: e["m"]).alias("layer_valid"))
