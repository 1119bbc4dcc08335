"""The dealt operators over the given tables, with production parameters and whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemsonde.functions.binding import let

from . import debruijn, decontam, fertility, langid, minhash, multiindex, packing, runs, secrets, sharding, suffixes, warc, windows
from .common import read_table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(read_table(spark, sf_dir, "documents"))


SHARD_BYTES = 1 << 20

_SHARD_SQL = f"""
with item as (select doc_id, cast(coalesce(octet_length(encode(text)), 0) as bigint) as bytes, md5(cast(doc_id as varchar)) as h from documents),
bits as (select *, list_reduce(list_transform(range(1, 16), lambda i: cast(instr('0123456789abcdef', substr(h, cast(i as integer), 1)) - 1 as bigint)), lambda a, b: a * 16 + b) as code from item),
prefix as (select doc_id, bytes, d, code >> (60 - d) as shard from bits, (select unnest(range(0, 25)) as d)),
size as (select d, shard, sum(bytes) as shard_bytes, count(distinct doc_id) as k from prefix group by d, shard),
fit as (select p.doc_id, p.bytes, p.d, p.shard, s.shard_bytes, row_number() over (partition by p.doc_id order by p.d) as k
  from prefix p join size s on p.d = s.d and p.shard = s.shard where s.shard_bytes <= {SHARD_BYTES} or s.k = 1)
select doc_id, bytes, cast(d as integer) as depth, cast(shard as bigint) as shard, cast(shard_bytes as bigint) as shard_bytes, shard_bytes <= {SHARD_BYTES} as fits
from fit where k = 1
"""


@query("op2_sharding", _SHARD_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return sharding.sharded(docs, "doc_id", F.octet_length("text"), SHARD_BYTES).select("doc_id", "bytes", "depth", "shard", "shard_bytes", "fits")


@query("op3_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.retrieved(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).where("contaminated")


@query("op4_quality_rules")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judged(read_table(spark, sf_dir, "documents"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# Counts of the fixed rules alone; the verdict of op4 rests on vocabularies and has no SQL.
_COUNTS_SQL = f"""
with given as (select doc_id, coalesce(text, '') as text, {_WORDS} as w from documents),
win as (select doc_id, i, md5(array_to_string(w[i + 1 : i + 8], ' ')) as g from (select *, unnest(range(0, len(w) - 7)) as i from given)),
twice as (select doc_id, i from win qualify count(*) over (partition by doc_id, g) > 1),
rep as (select doc_id, count(distinct i + k) as n from twice, (select unnest(range(0, 8)) as k) group by doc_id),
line as (select doc_id, count(*) - count(distinct l) as n from (select doc_id, unnest(string_split(text, chr(10))) as l from given) where regexp_matches(l, '[^\\x20\\x09-\\x0D]') group by doc_id)
select g.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
  cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, coalesce(line.n, 0) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words,
  len(w) < {fertility.MIN_WORDS} or 100 * coalesce(rep.n, 0) > {fertility.REPEAT_SHARE} * len(w) as base_failed
from given g left join line on line.doc_id = g.doc_id left join rep on rep.doc_id = g.doc_id
"""


@query("quality_base_counts", _COUNTS_SQL)
def base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judged(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


_REMOVED_SQL = f"""
with given as (select doc_id, {_WORDS} as w from documents),
win as (select doc_id, i, md5(array_to_string(w[i + 1 : i + 20], ' ')) as g from (select *, unnest(range(0, len(w) - 19)) as i from given)),
later as (select doc_id, i from win qualify row_number() over (partition by g order by doc_id, i) > 1),
gone as (select distinct doc_id, i + k as i from later, (select unnest(range(0, 20)) as k)),
word as (select doc_id, w[i + 1] as x, i from (select *, unnest(range(0, len(w))) as i from given)),
left_ as (select word.doc_id, string_agg(x, ' ' order by word.i) as kept, count(*) as n from word left join gone on gone.doc_id = word.doc_id and gone.i = word.i where gone.i is null group by word.doc_id)
select g.doc_id, cast(len(w) as bigint) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from given g left join left_ l on l.doc_id = g.doc_id
"""


@query("op5_substring_dedup", _REMOVED_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.deduplicated_digest(read_table(spark, sf_dir, "documents"))


@query("op6_secret_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(read_table(spark, sf_dir, "documents"))


_WARC_SQL = """
with body as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as sha from pages),
first as (select page_id, html, sha, min(page_id) over (partition by html) as first from body)
select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + cast((cast('0x' || substr(sha, 1 + 5 * (i // 4), 5) as integer) >> (15 - 5 * (i % 4))) & 31 as integer), 1)), '') as payload_digest,
  case when first < page_id then 'revisit' else 'response' end as record_type,
  case when first < page_id then first end as refers_to
from first
"""


@query("op7_suffix_array")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats(read_table(spark, sf_dir, "documents"))


@query("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read_table(spark, sf_dir, "documents"))


@query("op9_warc", _WARC_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return warc.records(warc.written(pages), with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_NEAR_SQL = r"""
with recursive given as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
item as (select distinct doc_id, md5(array_to_string(w[i + 1 : i + 5], ' ')) as s from (select *, unnest(range(0, greatest(len(w) - 4, least(len(w), 1)))) as i from given)),
size as (select doc_id, count(*) as n from item group by doc_id),
link as (select x.doc_id as a, y.doc_id as b from item x join item y on x.s = y.s and x.doc_id <> y.doc_id join size p on p.doc_id = x.doc_id join size q on q.doc_id = y.doc_id
  group by x.doc_id, y.doc_id having 100 * count(*) >= 75 * (any_value(p.n) + any_value(q.n) - count(*))),
reach as (select doc_id, doc_id as other from given union select r.doc_id, l.b from reach r join link l on l.a = r.other),
least_ as (select doc_id, min(other) as component_id from reach group by doc_id)
select g.doc_id, coalesce(n, 0) as n_shingles, component_id, g.doc_id = component_id as kept from given g join least_ using (doc_id) left join size using (doc_id)
"""


@query("op10_near_duplicates", _NEAR_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def looped(docs: DataFrame) -> DataFrame:
    """Every tenth document, by the checksum h of its doc_id, as words that repeat from word a on with period p."""
    g = F.floor(F.col("h") / 10)
    n = lambda w: F.size(w).cast("long")
    p = lambda w, a: F.lit(1).cast("long") + F.floor((n(w) - a) / (F.lit(3) + g % 8))
    at = lambda i, a, p: F.when(i < a, i).otherwise(a + (i - a) % p)
    repeated = lambda w: let(g % n(w), lambda a: let(p(w, a), lambda p: F.array_join(
        F.transform(F.sequence(F.lit(0).cast("long"), n(w) - 1), lambda i: F.element_at(w, (at(i, a, p) + 1).cast("int"))), " ")))
    words = F.expr(r"regexp_extract_all(text, '([^\\x20\\x09-\\x0D]+)', 1)")
    docs = docs.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    text = F.when(F.col("h") % 10 == 0, let(words, lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.col("text")))).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


# Every pair of equal 5-word windows of a text, stretches of such pairs at one distance, and the least distance of a stretch.
_RUNS_SQL = """
with given as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w,
  xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, 1 + length(cast(doc_id as varchar))), lambda i: cast(ascii(substr(cast(doc_id as varchar), cast(i as integer), 1)) as bigint))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda x, i: case when x % 2 = 1 then xor(x >> 1, 3988292384) else x >> 1 end))) as h from documents),
loop as (select *, len(w) as n, case when h % 10 = 0 and len(w) > 0 then (h // 10) % len(w) end as a from given),
text as (select doc_id, n, case when a is null then w else list_transform(range(0, n), lambda i: w[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) end]) end as w from loop),
word as (select doc_id, w, n, unnest(range(0, n)) as i from text),
win as (select doc_id, n, i, md5(array_to_string(w[i + 1 : i + 5], ' ')) as g from word where i + 5 <= n),
pair as (select x.doc_id, x.i, y.i - x.i as q from win x join win y on x.doc_id = y.doc_id and x.g = y.g and x.i < y.i and 4 * (y.i - x.i) <= x.n),
part as (select *, i - row_number() over (partition by doc_id, q order by i) as island from pair),
stretch as (select doc_id, min(i) as start, count(*) + 4 + q as length, q from part group by doc_id, q, island),
run as (select doc_id, start, length, min(q) as period from stretch where length >= greatest(6, 4 * q) group by doc_id, start, length),
best as (select *, row_number() over (partition by doc_id order by length desc, start, period) as k from run),
said as (select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as said from run group by doc_id),
gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from run),
kept as (select word.doc_id, string_agg(word.w[word.i + 1], ' ' order by word.i) as kept from word left join gone on word.doc_id = gone.doc_id and word.i = gone.i where gone.i is null group by word.doc_id)
select t.doc_id, coalesce(n_runs, 0) as n_runs, b.start, b.length, b.period, 1000 * b.length // b.period as exponent_milli,
  sha256(coalesce(said, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256
from text t left join best b on t.doc_id = b.doc_id and b.k = 1 left join said s on t.doc_id = s.doc_id left join kept k on t.doc_id = k.doc_id
"""


@query("op11_periodic_runs", _RUNS_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(looped(read_table(spark, sf_dir, "documents")), with_text=False).drop("n_words")


_NEGATIVES_SQL = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
score as (select a.vec_id as a, b.vec_id as b, a.label = b.label as same, cast(list_sum(list_transform(range(1, 1 + len(a.q)), lambda i: a.q[i] * b.q[i])) as bigint) as s
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
positive as (select a, b, s from score where same qualify row_number() over (partition by a order by s desc, b) <= 5)
select p.a as anchor_id, p.b as positive_id, cast(row_number() over (partition by p.a, p.b order by n.s desc, n.b) as integer) as rank, n.b as negative_id, p.s as positive_score, n.s as negative_score
from positive p join score n on p.a = n.a and not n.same and 80 * p.s <= 100 * n.s and n.s <= p.s
qualify row_number() over (partition by p.a, p.b order by n.s desc, n.b) <= 5
"""


@query("op12_hard_negatives", _NEGATIVES_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return multiindex.hard_negatives(multiindex.whole_vectors(rows, label=label), F.col("id") % 100 == 0)


@query("op13_online_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.packed(read_table(spark, sf_dir, "documents"))
