"""Texts derived from the tables are not stored in a file for every few units."""

import glob

import duckdb
import pytest

import __spark_entry__ as entry_point


@pytest.mark.parametrize("name, kind", [("s4_read_fasta", "fasta"), ("s3_read_alignments", "stockholm")])
def test_files_do_not_grow_in_number_with_units(name, kind, spark, sf):
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{shared}/{kind}-*/**/part-*", recursive=True))
    got = entry_point.queries()[name](spark, sf)
    have = sorted(tuple(r[c] for c in sorted(got.columns)) for r in got.collect())
    made = set(glob.glob(f"{shared}/{kind}-*/**/part-*", recursive=True)) - before
    assert 0 < len(made) <= 8
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(entry_point.oracle_sql()[name])
    at = [want.columns.index(c) for c in sorted(got.columns)]
    assert have == sorted(tuple(r[k] for k in at) for r in want.fetchall())
