"""The stages one by one against plain versions of their decisions, and the queries against DuckDB."""

import duckdb
import pytest

import corpus_pipeline
from stemsonde.llm import queries
from stemsonde.llm.common import read_table, shared_dir

from . import plain


@pytest.fixture(scope="module")
def made(spark, sf):
    docs, out, top = read_table(spark, sf, "documents"), {}, shared_dir(spark)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{top}/{name}")
        out[name] = (docs, docs := spark.read.parquet(f"{top}/{name}"))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_keep_the_columns_of_documents(made):
    for name in ("language", "near_duplicates", "decontamination", "secrets"):
        assert set(made[name][1].columns) == set(corpus_pipeline.COLUMNS)


def test_language_keeps_clean_documents(made):
    before, after = map(texts, made["language"])
    assert len(after) >= 0.98 * len(before) and all(before[i] == t for i, t in after.items())


def test_near_duplicates_keep_one_of_each_group(made):
    before, after = map(texts, made["near_duplicates"])
    assert set(after) == {c for _, _, c in plain.groups(sorted(before.items()))}


def test_near_duplicates_drop_rows_not_ids(spark, sf):
    """Texts that are nobody's copies stay whatever doc_id they share; of a group one row stays."""
    a, b, c, d = (plain.prose(i, 60) for i in range(4))
    near = " ".join(["other", *c.split()[1:]])
    rows = [(1, a), (5, a), (5, b), (6, c), (6, d), (7, c), (8, d), (6, c), (6, near), (None, a), (None, a), (9, "")]
    df = spark.createDataFrame([(i, t, "en", f"s{k % 2}", len(t)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, df, sf).collect()), key=str)
    assert [x for x in got if x[1] not in (c, near)] == sorted([(1, a), (5, b), (6, d), (None, a), (None, a), (9, "")], key=str)
    assert [i for i, t in got if t in (c, near)] == [6]


def test_decontamination_drops_documents_with_whole_items(made, spark, sf):
    before, after = map(texts, made["decontamination"])
    flat = lambda t: " ".join(plain.words(t)).lower()
    items = [flat(r.text) for r in read_table(spark, sf, "benchmark").collect()]
    assert set(before) - set(after) == {i for i, t in before.items() if any(x in flat(t) for x in items)}


def test_secrets_are_masked_and_rows_stay(made):
    from stemsonde.llm.secrets import MASK, base_spans

    before, after = map(texts, made["secrets"])
    assert set(before) == set(after)
    assert all(not base_spans(t) for t in after.values())
    assert all(MASK in after[i] for i, t in before.items() if base_spans(t))
    assert sum(before[i] != t for i, t in after.items()) <= sum(bool(base_spans(t)) for t in before.values()) + 0.02 * len(before)


def test_packing_holds_every_word(made):
    before = texts(made["packing"][0])
    rows = made["packing"][1].collect()
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_words
    assert got == {i: len(plain.words(t)) for i, t in before.items()}


def test_stages_take_awkward_and_empty_tables(spark, sf):
    docs = spark.createDataFrame([r[:5] for r in plain.awkward()], "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, sf)
            assert out.count() <= max(200, table.count()) and (table.count() or not out.count()), name


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_duckdb(name, spark, sf):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    have = sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)
    assert have == sorted(cur.fetchall(), key=str)
